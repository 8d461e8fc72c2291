import numpy as np
import xxhash

from geohotspots.llm import simhash_bk as q


def brute_print(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    codes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(c >> b & 1 for c in codes) > len(codes))


def brute_components(rows):
    prints = [brute_print(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            r = find(i)
            least[r] = min(least.get(r, doc), doc)
    return sorted(((d, f"{p:016x}", least.get(find(i))) for i, ((d, _), p) in enumerate(zip(rows, prints))), key=str)


def test_equals_brute_force(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in small["documents"].select("doc_id", "text").collect()]
    rng = np.random.default_rng(2)
    for i in range(150):
        words = rows[i % 12][1].split()
        words[int(rng.integers(0, len(words)))] = "changed"
        rows.append((10_000 + i, " ".join(words)))
    rows += [(20_000, None), (20_001, ""), (None, "one two"), (None, rows[0][1]), rows[3], rows[3], (5, "three words only")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = q.near_duplicates(docs).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_components(rows)


def test_keep_one(odd_docs, no_docs):
    kept = q.keep_one(odd_docs)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == odd_docs.columns
    assert ids.count(100) == 1 and not any(i in ids for i in range(101, 120))
    assert ids.count(0) == 1 and 1 not in ids and ids.count(5) == 3 and ids.count(None) == 2
    assert q.keep_one(no_docs).count() == 0 and q.near_duplicates(no_docs).count() == 0
