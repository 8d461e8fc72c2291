import random
import re
from collections import Counter

import pytest

from geohotspots.llm import rule_ledger as q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)
    )


def test_equals_brute_force(odd_docs, no_docs, small):
    for docs in (odd_docs, small["documents"]):
        texts = {(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()}
        want = Counter((d, *brute(t)) for d, t in texts)
        rows = q.verdicts(docs).collect()
        assert len(rows) == docs.count()
        assert {tuple(r[:6]) for r in rows} == set(want)
        for r in rows:
            assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
            assert not (r["base_failed"] and r["kept"])
    assert q.verdicts(no_docs).count() == 0


@pytest.mark.parametrize("bits", [1, 4, 8, 12])
def test_equal_hashes_of_unlike_windows(spark, odd_docs, small, bits):
    draw = random.Random(bits)
    made = [
        (i, " ".join(draw.choice(["a", "b", "c", "a b", "\u00e9", "dd"]) for _ in range(draw.randrange(0, 90))))
        for i in range(60)
    ]
    for docs in (odd_docs, small["documents"].limit(80), spark.createDataFrame(made, "doc_id long, text string")):
        rows = q.measure(docs.select("doc_id", "text"), hash_bits=bits).collect()
        assert rows
        for r in rows:
            assert r["n_repeat_words"] == brute(r["text"])[4]


def test_other_columns_stay(odd_docs):
    out = q.ledger(odd_docs)
    replaced = {"fail_bits", "n_words"}
    assert set(odd_docs.columns) <= set(out.columns)
    row = out.filter("doc_id = 5").first()
    assert row["words"] == "words" and row["row"] == "row" and all(row[c] != c for c in replaced)


def test_policies_and_ablations(small):
    stored = q.apply_policies(q.ledger(small["documents"])).cache()
    bits = [r["fail_bits"] for r in stored.collect()]
    for policy in q.POLICIES:
        name = f"{policy.name}@{policy.version}"
        kept = sum(b & policy.mask == 0 for b in bits)
        assert stored.filter(f"array_contains(kept_by, '{name}')").count() == kept
    number = {r.name: r.bit for r in q.RULES}
    rows = q.ablations(stored).collect()
    assert len(rows) == sum(len(p.rules) for p in q.POLICIES)
    for r in rows:
        mask = next(p.mask for p in q.POLICIES if (p.name, p.version) == (r["policy"], r["version"]))
        bit = 1 << number[r["rule"]]
        assert r["n_kept"] == sum(b & mask == 0 for b in bits)
        assert r["n_fail_rule"] == sum(b & bit != 0 for b in bits)
        assert r["n_only_rule"] == sum(b & mask == bit for b in bits)
