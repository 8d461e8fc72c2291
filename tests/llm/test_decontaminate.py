from itertools import combinations

import numpy as np

from geohotspots.llm import decontaminate as q


def words(rng, n):
    return ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(n)]


def brute(texts, items):
    """Documents and items that share an aligned run with enough equal words."""
    found = set()
    for d, text in texts:
        doc = [q.bare(w) for w in (text or "").encode().split()]
        for i, item in items:
            it = [q.bare(w) for w in item.encode().split()]
            width = min(q.OVERLAP, len(it))
            for offset in range(-len(it), len(doc)):
                for a in range(max(0, offset), min(len(doc), offset + len(it)) - width + 1):
                    if sum(doc[a + k] == it[a - offset + k] for k in range(width)) >= np.ceil(width * q.SIMILARITY):
                        found.add((d, i))
    return found


def test_finds_substituted_passages_and_nothing_else(spark):
    rng = np.random.default_rng(3)
    items = [(i, " ".join(words(rng, int(rng.integers(3, 50))))) for i in range(20)]
    texts = []
    for d in range(80):
        body = words(rng, int(rng.integers(0, 60)))
        if d % 2:
            passage = items[d % 20][1].split()
            for at in range(7, len(passage), 14):
                passage[at] = "replaced"
            cut = int(rng.integers(0, len(body) + 1))
            body = body[:cut] + [w.upper() + "," for w in passage] + body[cut:]
        texts.append((d, " ".join(body)))
    texts += [(200, None), (201, ""), (202, " ".join(items[0][1].split()[:2]))]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame([*items, (99, None), (98, ""), items[0]], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in q.overlaps(docs, bench).collect()}
    assert got == brute(texts, items)
    kept = {r["doc_id"] for r in q.drop_contaminated(docs, bench).collect()}
    assert kept == {d for d, _ in texts} - {d for d, _ in got}


def test_masks_fit_every_run_with_allowed_replacements():
    most = q.OVERLAP - int(np.ceil(q.OVERLAP * q.SIMILARITY))
    for gone in combinations(range(q.OVERLAP), most):
        assert any(
            all(seed[g - at] == "0" for g in gone if 0 <= g - at < len(seed))
            for seed in q.SEEDS
            for at in range(q.OVERLAP - len(seed) + 1)
        )


def test_blocks_do_not_change_the_result(spark, small, monkeypatch):
    want = sorted(q.overlaps(small["documents"], small["benchmark"]).collect())
    monkeypatch.setattr(q, "BLOCK_WORDS", 200)
    assert sorted(q.overlaps(small["documents"], small["benchmark"]).collect()) == want and want


def test_odd_rows(spark, odd_docs, no_docs, small):
    out = q.drop_contaminated(odd_docs, small["benchmark"])
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    assert q.drop_contaminated(odd_docs, small["benchmark"].limit(0)).count() == odd_docs.count()
    assert q.drop_contaminated(no_docs, small["benchmark"]).count() == 0
    assert q.overlaps(no_docs, small["benchmark"]).count() == 0
