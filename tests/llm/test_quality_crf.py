import zlib
from itertools import product

import numpy as np
import pytest

from geohotspots.llm import quality_crf as q

GOOD = "This is a plain line of text that ends well.\nAnother one follows it here."
BAD = "BUY!! NOW!! CHEAP!! ### $$$\nCLICK!! HERE!! | | |"


@pytest.fixture(scope="module")
def model():
    texts = [f"{GOOD} {i}" for i in range(40)] + [f"{BAD} {i}" for i in range(40)]
    return q.fit(texts, [1] * 40 + [0] * 40, steps=40)


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    emit, trans = rng.normal(size=(2, 5, 2)), rng.normal(size=(2, 2))
    lengths = np.array([5, 3])
    marginal, moves, total = q.forward_backward(emit, lengths, trans)
    for c, n in enumerate(lengths):
        scores = {
            path: sum(emit[c, t, s] for t, s in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:]))
            for path in product((0, 1), repeat=int(n))
        }
        z = np.log(sum(np.exp(v) for v in scores.values()))
        assert np.isclose(z, total[c])
        for t in range(n):
            want = sum(np.exp(v - z) for p, v in scores.items() if p[t] == 1)
            assert np.isclose(marginal[c, t, 1], want)
        want = sum(np.exp(v - z) for p, v in scores.items() for a, b in zip(p, p[1:]) if (a, b) == (0, 1))
        assert np.isclose(moves[c, :, 0, 1].sum(), want)


def test_scores_do_not_depend_on_the_batch(model):
    texts = [GOOD, BAD, "", GOOD * 50, "\n".join([BAD] * 30), "x"]
    together = model.score(texts)
    assert np.allclose(together, [model.score([t])[0] for t in texts])
    assert together[0] > 0.9 > 0.1 > together[1]


def test_odd_rows(model, odd_docs, no_docs):
    out = q.score(odd_docs, model)
    assert sorted(out.columns) == sorted(odd_docs.columns)
    rows = out.select("doc_id", "held_out", "score", "predicted").collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    assert q.score(no_docs, model).count() == 0


def test_held_out_accuracy(spark, small):
    model = q.train(small["documents"], small["labels"])
    scored = q.score(small["documents"], model).join(small["labels"], "doc_id").filter("held_out").toPandas()
    assert (scored["predicted"] == scored["quality"]).mean() > 0.9
    again = q.train(small["documents"].repartition(7), small["labels"].repartition(5))
    assert np.array_equal(model.weights, again.weights)


def test_one_class_is_refused():
    with pytest.raises(ValueError):
        q.fit(["a", "b"], [1, 1])


def test_nothing_to_learn(small, no_docs, odd_docs):
    assert q.train(no_docs, small["labels"]).value == 1.0
    assert q.train(small["documents"], small["labels"].filter("quality = 0")).value == 0.0
    assert q.keep_good(odd_docs, small["labels"].limit(0)).count() == odd_docs.count()
