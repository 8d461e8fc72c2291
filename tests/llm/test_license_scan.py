import numpy as np

from geohotspots.llm import license_scan as q
from geohotspots.llm.common import WordCodes, bare, window_codes, words_of


def brute(text, templates):
    """Templates whose shingles some run of their own length holds to the required share."""
    codes = WordCodes(bare)
    doc, found = codes.of(words_of(text or "")), set()
    for name, template in templates.items():
        t = codes.of(words_of(template))
        k = min(q.SHINGLE, len(t))
        if not k:
            continue
        mine = set(window_codes(t, range(k)).tolist())
        s = window_codes(doc, range(k)).tolist()
        for a in range(len(s)):
            if len(mine & set(s[a : a + len(t) - k + 1])) / len(mine) >= q.CONTAINMENT - 1e-9:
                found.add(name)
    return found


def test_finds_planted_notices(spark):
    rng = np.random.default_rng(5)
    vocabulary = ["".join(rng.choice(list("abcdefg"), 5)) for _ in range(300)]
    names, texts = sorted(q.TEMPLATES), []
    for d in range(150):
        body = rng.choice(vocabulary, int(rng.integers(0, 120))).tolist()
        if d % 3:
            notice = q.TEMPLATES[names[d % len(names)]].upper().split()
            if len(notice) > 30:
                notice[len(notice) // 2] = "changed"
            cut = int(rng.integers(0, len(body) + 1))
            body[cut:cut] = notice
        texts.append((d, " ".join(body)))
    texts += [(500, None), (501, ""), (None, "All rights reserved.")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: set(filter(None, r["licenses"].split(","))) for r in q.scan(docs).collect()}
    assert got == {d: brute(t, q.TEMPLATES) for d, t in texts}


def test_bands_keep_the_promise():
    for length, k in ((3, 3), (5, 5), (8, 5), (40, 5)):
        bands = q.bands_for([(length, k)])
        assert (1 - q.jaccard_bound(length, k)) ** bands <= q.MISS


def test_odd_rows(odd_docs, no_docs):
    assert q.scan(odd_docs).count() == odd_docs.count()
    assert q.scan(odd_docs, {}).filter("n_matches > 0").count() == 0
    assert q.scan(odd_docs, {"empty": "", "one": "three"}).filter("n_matches > 0").count() >= 3
    assert q.scan(no_docs).count() == 0
