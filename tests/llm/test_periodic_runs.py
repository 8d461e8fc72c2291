"""Runs against all periods and starts of small texts, and the report against its rules."""

import hashlib
import re
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from geohotspots.llm import periodic_runs as pr
from geohotspots.llm import queries


def all_runs(words, least=6, repeats=4):
    """Every maximal stretch of every period; the smallest period of a stretch counts."""
    n, found = len(words), {}
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, repeats * q) and j > i:
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1) if j > i else i + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def plain(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = all_runs(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    return (
        doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
        hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
        hashlib.sha256(kept.encode()).hexdigest(),
    )


def search(texts, least=6, repeats=4):
    found = pr._search([" ".join(t) for t in texts], least, repeats)
    return [[(r["start"], r["length"], r["period"]) for r in runs] for runs in found["runs"]]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=60), max_size=6))
def test_runs_of_two_words(texts):
    assert search(texts) == [all_runs(t) for t in texts]


def test_runs_of_built_texts():
    rng = np.random.default_rng(5)
    texts = []
    for _ in range(300):
        text = []
        while len(text) < 120:
            unit = [str(c) for c in rng.integers(0, 4, rng.integers(1, 20))]
            text += (unit * 8)[: rng.integers(1, 8 * len(unit) + 1)]
        texts.append(text)
    assert search(texts) == [all_runs(t) for t in texts]
    assert search(texts, 1, 3) == [all_runs(t, 1, 3) for t in texts]


def test_batches_do_not_change_runs(monkeypatch):
    texts = [["x"] * k for k in range(40)] + [["x", "y"] * k for k in range(20)]
    whole = search(texts)
    monkeypatch.setattr(pr, "BATCH_WORDS", 7)
    assert search(texts) == whole


def test_large_names_sort_the_same():
    name = np.array([1 << 60, 5, 1 << 60, 5, 7])
    got = pr._by_name(name, np.arange(5), 5)
    assert got[0].tolist() == [5, 5, 7, 1 << 60, 1 << 60] and got[1].tolist() == [1, 3, 4, 0, 2]


def test_short_repeats_are_refused(spark):
    with pytest.raises(ValueError, match="repeats"):
        pr.find_runs(spark.createDataFrame([("a",)], "text string"), repeats=2)


def test_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    short = [(i, t) for i, t in rows if len(t or "") < 1000]
    got = pr.run_report(odd_docs).collect()
    assert len(got) == len(rows)
    key = lambda r: tuple((v is not None, v) for v in r)
    ids = {i for i, t in rows if len(t or "") >= 1000}
    assert sorted((tuple(r) for r in got if r.doc_id not in ids), key=key) == sorted((plain(*r) for r in short), key=key)
    long = [r for r in got if r.doc_id in ids]
    # crc32("6") ends in 0: from word 2,083 on, 11,584 words of the long text repeat.
    assert [(r.doc_id, r.start, r.length, r.period) for r in long] == [(6, 2083, 57918, 11584)]
    assert pr.run_report(no_docs).count() == 0
    found = pr.find_runs(odd_docs)
    assert found.select("row.*").columns == odd_docs.columns
    assert found.filter("runs is null or collapsed is null").count() == 0


def test_query_equals_plain(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r) for r in queries.op11_basic_factors(spark, "/root/testdata/sf0.001").collect()}
    chosen = [r for r in docs if len(r.text or "") < 12_000]
    assert len(got) == len(docs) and len(chosen) > 150
    assert [got[r.doc_id] for r in chosen] == [plain(*r) for r in chosen]
