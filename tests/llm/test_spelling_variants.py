"""Spelling variants against all pairs of words."""

import re
from collections import Counter
from zlib import crc32

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from geohotspots.llm import queries
from geohotspots.llm import spelling_variants as sv

SCHEMA = "word string, form string, root string, n long, n_near long, form_n long"


def shorter(word):
    return {word[:i] + word[i + 1 :] for i in range(len(word))}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and a in shorter(b)


def plain_counts(rows):
    seen = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            if doc_id is not None:
                h = crc32(f"{doc_id}:{run}".encode())
                if h % 97 == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 5 and n >= 3}


def plain_variants(counts):
    form, near_of = {}, {}
    for w, n in counts.items():
        around = [v for v in counts if abs(len(v) - len(w)) <= 1 and near(v, w)]
        near_of[w] = len(around)
        best = min(around, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 2 * n else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, near_of[w], counts.get(form[w])))
    return sorted(out)


def test_slips_and_letters(spark):
    rows = [(i, "Größe ÀÉ×÷ä naïve-Word word's ĀĀ日本 wordy Wordy WÖRDY" * 3) for i in range(200)]
    rows += [(None, "wordy wordy wordy wordy"), (5, None), (6, ""), (7, "a bb ccc dddd")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.word: r.n for r in sv.count_words(docs).collect()}
    assert got == plain_counts(rows)
    assert sum(got.values()) < sum(n for n in plain_counts([(None, t) for _, t in rows]).values())


@settings(max_examples=200, deadline=None)
@given(st.text("abcé", min_size=5, max_size=14), st.data())
def test_near_words_share_a_signature(word, data):
    at = data.draw(st.integers(0, len(word)))
    letter = data.draw(st.sampled_from("abcéz"))
    for other in (word[:at] + letter + word[at:], word[:at] + letter + word[at + 1 :], word[:at] + word[at + 1 :]):
        if len(other) < 5 or not near(word, other):
            continue
        a, b = sv.signatures([word.encode("latin-1"), other.encode("latin-1")])
        own = len(a) // 2
        # One of the two stands under its own length, as the join asks.
        assert set(a[:own]) & set(b) or set(a) & set(b[:own])


def group(spark, counts):
    return sorted(tuple(r) for r in sv.group_variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect())


def test_against_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(3)
    words = {"".join(rng.choice(list("abe"), rng.integers(5, 9))) for _ in range(900)}
    counts = {w: int(n) for w, n in zip(sorted(words), 3 * 2 ** rng.integers(0, 8, len(words)))}
    wanted = plain_variants(counts)
    assert group(spark, counts) == wanted
    assert max(r[4] for r in wanted) > 5 and any(r[2] != r[1] and r[1] for r in wanted)
    # Every shared signature crowded: all pairs come from deletions.
    monkeypatch.setattr(sv, "CROWDED", 1)
    assert group(spark, counts) == wanted


def test_one_crowded_group(spark):
    """Two thousand words around one form, most of them in the same groups."""
    letters = [chr(c) for c in [*range(97, 123), *range(0xC0, 0x100)]]
    base = "abcdefghijklmnop"
    counts = {base: 100_000}
    for at in range(len(base) + 1):
        for c in letters:
            counts.setdefault(base[:at] + c + base[at:], 3)
            counts.setdefault(base[:at] + c + base[at + 1 :] if at < len(base) else base + c, 4)
    got = {r[0]: r for r in group(spark, counts)}
    assert len(counts) > 2000 and got[base][4] == len(counts) - 1
    assert all(r[1] == base and r[2] == base for w, r in got.items() if w != base)


def test_chain_and_ties(spark):
    counts = {"aaaaa": 3, "aaaab": 6, "aaabb": 12, "aabbb": 24, "abbbb": 48, "zaaaa": 3, "aaaaz": 5, "qqqqqq": 9}
    got = {r[0]: r for r in group(spark, counts)}
    assert [got["aaaaa"][k] for k in (1, 2)] == ["aaaab", "abbbb"]
    assert got["aabbb"][1:3] == ("abbbb", "abbbb") and got["abbbb"][1:3] == (None, "abbbb")
    assert got["qqqqqq"] == ("qqqqqq", None, "qqqqqq", 9, 0, None)
    ties = {"xxxxx": 3, "xxxxé": 9, "xxxxz": 9, "xxxxa": 9}
    assert {r[0]: r for r in group(spark, ties)}["xxxxx"][1] == "xxxxa"


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in sv.variants(odd_docs).collect())
    assert got == plain_variants(plain_counts(rows)) and got
    empty = sv.variants(no_docs)
    assert empty.count() == 0
    assert ", ".join(f"{n} {'long' if t == 'bigint' else t}" for n, t in empty.dtypes) == SCHEMA


def test_query_equals_plain(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = sorted(tuple(r) for r in queries.op13_partenum(spark, "/root/testdata/sf0.001").collect())
    assert got == plain_variants(plain_counts([tuple(r) for r in docs.collect()])) and len(got) > 1000
