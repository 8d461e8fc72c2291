"""Every stage of the pipeline against a brute-force version, on its own input."""

from collections import Counter

import numpy as np
import pytest
from test_decontaminate import q as seeds
from test_line_dedup import brute_surplus
from test_near_documents import brute_components
from test_pfair_mix import brute, furthest, whole

import __spark_entry__
import corpus_pipeline
from geohotspots.llm import quality_crf
from geohotspots.llm.pfair_mix import NO_SOURCE

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows that go into and come out of each stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) < 4000")
    out, folder = [], tmp_path_factory.mktemp("stages")
    for no, (_, stage) in enumerate(corpus_pipeline.STAGES):
        result = stage(spark, docs, SF)
        result.write.parquet(f"{folder}/{no}")
        result = spark.read.parquet(f"{folder}/{no}")
        if no < len(corpus_pipeline.STAGES) - 1:
            assert result.columns == docs.columns
        out.append((docs.collect(), result.collect()))
        docs = result
    return out


def ids(rows):
    return {r["doc_id"] for r in rows}


def test_quality(spark, stages):
    before, after = stages[0]
    frames = [spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels")]
    whole = spark.createDataFrame(before)
    model = quality_crf.train(whole, frames[1])
    assert ids(after) == {r["doc_id"] for r in before if model.score([r["text"]])[0] >= 0.3}
    assert ids(after) < ids(before)


def test_lines(stages):
    before, after = stages[1]
    gone = brute_surplus([(r["doc_id"], r["text"]) for r in before])
    texts = {r["doc_id"]: r["text"] for r in after}
    assert gone and len(after) == len(before)
    for r in before:
        kept = [x for n, x in enumerate(r["text"].split("\n")) if (r["doc_id"], n) not in gone]
        assert texts[r["doc_id"]] == "\n".join(kept)


def test_near_duplicates(stages):
    before, after = stages[2]
    groups = brute_components([(r["doc_id"], r["text"]) for r in before])
    assert ids(after) == {least for _, _, least in groups} and len(after) < len(before)


def test_decontamination(spark, stages):
    before, after = stages[3]
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def words(text):
        return np.array([seeds.bare(w) for w in text.encode().split()], object)

    def leaks(doc, item):
        width = min(seeds.OVERLAP, len(item))
        if len(doc) < width:
            return False
        same = (doc[:, None] == item[None]).astype(int)
        least = np.ceil(width * seeds.SIMILARITY)
        for k in range(-len(doc) + width, len(item) - width + 1):
            run = np.convolve(same.diagonal(k), np.ones(width, int), "valid")
            if (run >= least).any():
                return True
        return False

    found = {r["doc_id"] for r in before if any(leaks(words(r["text"]), words(i)) for i in items)}
    assert ids(after) == ids(before) - found


def test_mixing(stages):
    before, after = stages[4]
    assert Counter(map(str, ids(before))) == Counter(str(r["doc_id"]) for r in after)
    assert len({r["mix_position"] for r in after}) == len(after)
    # Weights are square roots of the sources' rows.
    sizes = Counter(r["source"] for r in before)
    blocks = {s or NO_SOURCE: -(-n // 4) for s, n in sizes.items()}
    weights = whole({s or NO_SOURCE: n**0.5 for s, n in sizes.items()})
    slots = sorted({(r["mix_slot"], r["source"] or NO_SOURCE) for r in after})
    assert [t for t, _ in slots] == list(range(sum(blocks.values())))
    assert [s for _, s in slots] == brute(blocks, weights)
    assert furthest([s for _, s in slots], blocks, weights) < 1


def test_odd_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            result = stage(spark, docs, SF)
            if name != "mixing":
                assert result.columns == docs.columns
            assert result.count() <= docs.count()


def test_registered(spark):
    names = list(__spark_entry__.queries())
    assert "pipeline" in names
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11))
