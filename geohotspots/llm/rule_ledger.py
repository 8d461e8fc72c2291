"""Quality rules as a bitmask ledger.

Every rule is evaluated once. The ledger stores each document's measurements and one bit
for each rule it fails; policies (named, versioned sets of rules) are applied to the bits,
and the effect of every rule on every policy comes from a bitwise aggregation. Everything
is DataFrame and SQL functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geohotspots.llm.common import carried, with_columns

_BREAK = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``fails`` (SQL over the measurements) is true."""

    bit: int
    name: str
    fails: str


#: Bits are stored, so they keep their meaning: new rules take new bits.
RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "duplicate_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule(4, "short_words", "word_chars < 2 * n_words"),
    Rule(5, "long_words", "word_chars > 20 * n_words"),
    Rule(6, "marks", "10 * n_marks > 3 * n_words"),
    Rule(7, "one_word_runs", "10 * n_same_as_previous > n_words"),
    Rule(8, "few_stops", "n_words >= 50 and n_stops = 0"),
)
BASE = frozenset({"few_words", "repeated_windows"})


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: frozenset[str]

    @property
    def mask(self) -> int:
        bits = {r.name: r.bit for r in RULES}
        return sum(1 << bits[name] for name in self.rules)


POLICIES = (
    Policy("base", 1, BASE),
    Policy("symbols", 1, BASE | {"symbols", "marks"}),
    Policy("default", 1, BASE | {"symbols", "marks", "duplicate_lines"}),
    Policy("default", 2, BASE | {"symbols", "marks", "duplicate_lines", "one_word_runs", "long_words"}),
)
DEFAULT = POLICIES[-1]


def _count_of(text: Column, characters: str) -> Column:
    """Characters of ``text`` that are in ``characters``."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _neighbours_equal(sorted_list: Column, part) -> Column:
    """Members of a sorted list whose ``part`` is that of the member before or after them."""
    return F.filter(
        sorted_list,
        lambda x, i: (part(x) == part(F.get(sorted_list, i + 1))) | (part(x) == part(F.get(sorted_list, i - 1))),
    )


def measure(docs: DataFrame, text_col: str = "text", hash_bits: int = 64) -> DataFrame:
    """``docs`` with the measurements that rules refer to; same-named columns are replaced.

    Words are runs of characters other than space and U+0009 to U+000D. Null and empty texts
    measure zero everywhere. ``n_dup_lines`` counts lines with a word that equal an earlier
    one, ``n_repeat_words`` the words in three-word windows found at least twice. Windows are
    found by their hashes, of which the first ``hash_bits`` are used, and compared by words;
    results do not depend on the hash.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = F.filter(F.split(text, _BREAK, -1), lambda w: w != "")
    full_lines = F.filter(
        F.split(text, "\n", -1), lambda x: F.length(F.regexp_replace(x, _BREAK, "")) > 0
    )
    frame = carried(docs, {"text": text, "words": split, "lines": full_lines}).withColumn(
        "n", F.size("words").cast("long")
    )
    # A window's hash keeps its high bits and gives the low ones to its place, so one sort of
    # plain numbers brings equal windows together with their places. The low bits are as
    # many as the text's length needs.
    frame = frame.withColumn(
        "low",
        F.greatest(F.expr("shiftleft(1L, cast(ceil(log2(n + 1)) as int)) - 1"), F.lit((1 << (64 - hash_bits)) - 1)),
    )
    words, low, packed, hits = F.col("words"), F.col("low"), F.col("packed"), F.col("hits")

    def window(i: Column) -> Column:
        code = F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
        return code.bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long"))

    places = F.sequence(F.lit(0), F.col("n").cast("int") - 3)
    frame = frame.withColumn("packed", F.when(F.col("n") >= 3, F.sort_array(F.transform(places, window))))

    def high(x: Column) -> Column:
        return x.bitwiseAND(F.bitwise_not(low))

    def word(x: Column, k: int) -> Column:
        return F.get(words, x.bitwiseAND(low).cast("int") + k)

    def other_words(x: Column, y: Column) -> Column:
        return (word(x, 0) != word(y, 0)) | (word(x, 1) != word(y, 1)) | (word(x, 2) != word(y, 2))

    frame = frame.withColumn("hits", _neighbours_equal(packed, high))
    # Where unlike windows share a hash, two of them are neighbours. The windows of such a
    # text, a rare one, are sorted by their words; no word has a space in it.
    clashes = F.filter(
        hits, lambda x, i: (high(x) == high(F.get(hits, i + 1))) & other_words(x, F.get(hits, i + 1))
    )
    frame = frame.withColumn("clash", F.size(clashes) > 0)

    def spelled(i: Column) -> Column:
        joined = F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
        return F.struct(joined.alias("words"), i.cast("long").alias("place"))

    frame = frame.withColumn("spelled", F.when(F.col("clash"), F.sort_array(F.transform(places, spelled))))
    found = F.when(
        F.col("clash"),
        F.transform(_neighbours_equal(F.col("spelled"), lambda x: x["words"]), lambda x: x["place"]),
    ).otherwise(F.transform(hits, lambda x: x.bitwiseAND(low)))
    frame = frame.withColumn("places", F.sort_array(found))
    covered = F.aggregate(
        F.col("places"),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("long").alias("last")),
        lambda s, p: F.struct((s["n"] + F.least(p - s["last"], F.lit(3))).alias("n"), p.alias("last")),
        lambda s: s["n"],
    )
    same = F.filter(F.transform(words, lambda w, i: w == F.get(words, i - 1)), lambda x: x)
    text = F.col("text")
    measured = {
        "n_words": F.col("n"),
        "word_chars": F.length(F.array_join("words", "")),
        "n_symbols": _count_of(text, SYMBOLS),
        "n_lines": F.size("lines"),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
        "n_marks": _count_of(text, "!?"),
        "n_same_as_previous": F.size(same),
        "n_stops": _count_of(text, ".,;:!?|"),
    }
    new = [c.cast("long").alias(n) for n, c in measured.items()]
    kept = [F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in measured]
    return frame.select("row", F.struct(*new).alias("new")).select(*kept, "new.*")


def ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``measure(docs)`` with ``fail_bits``: bit b is set if the rule of bit b fails."""
    bits = F.lit(0).cast("long")
    for rule in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long"))
    return with_columns(measure(docs, text_col), {"fail_bits": bits})


def passes(policy: Policy, bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def apply_policies(stored: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """The ledger with ``kept_by``: names of the policies each document passes."""
    names = F.array(*[F.when(passes(p), F.lit(f"{p.name}@{p.version}")) for p in policies])
    return with_columns(stored, {"kept_by": F.array_compact(names)})


def ablations(stored: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """Effect of every rule on every policy, from the stored bits alone.

    ``policy, version, rule, n_docs, n_kept, n_fail_rule, n_only_rule``: the last one counts
    documents that the policy would keep without this rule. Documents are first counted by
    their bits, at most one row for each combination of rules, and only these are expanded.
    """
    counts = stored.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    pairs = [
        F.struct(
            F.lit(p.name).alias("policy"),
            F.lit(p.version).alias("version"),
            F.lit(p.mask).cast("long").alias("mask"),
            F.lit(r.name).alias("rule"),
            F.lit(1 << r.bit).cast("long").alias("bit"),
        )
        for p in policies
        for r in RULES
        if r.name in p.rules
    ]

    def where(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    failed = F.col("fail_bits").bitwiseAND(F.col("mask"))
    return (
        counts.select("fail_bits", "n", F.inline(F.array(*pairs)))
        .groupBy("policy", "version", "rule")
        .agg(
            F.sum("n").alias("n_docs"),
            where(failed == 0).alias("n_kept"),
            where(F.col("fail_bits").bitwiseAND(F.col("bit")) != 0).alias("n_fail_rule"),
            where(failed == F.col("bit")).alias("n_only_rule"),
        )
    )


def verdicts(docs: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """Measurements with ``base_failed`` and ``kept`` under ``policy``."""
    base = sum(1 << r.bit for r in RULES if r.name in BASE)
    failed = F.col("fail_bits").bitwiseAND(F.lit(base).cast("long")) != 0
    return ledger(docs).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & passes(policy)).alias("kept"),
        "fail_bits",
    )


_SQL_BREAK = r"[\x20\x09-\x0D]+"
_WORDS_SQL = f"list_filter(string_split_regex(coalesce(text, ''), '{_SQL_BREAK}'), lambda w: w <> '')"


def oracle_sql() -> str:
    """DuckDB SQL of ``verdicts``; rows of one document are told apart by their place."""
    bits = " + ".join(f"(case when {r.fails} then {1 << r.bit} else 0 end)" for r in RULES)

    def count(characters: str) -> str:
        return f"length(t) - length(translate(t, '{characters}', ''))"

    base = sum(1 << r.bit for r in RULES if r.name in BASE)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {_WORDS_SQL} AS w FROM documents),
g AS (SELECT r, i, concat_ws(' ', w[i], w[i+1], w[i+2]) AS x
      FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS c FROM g) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT p) AS c FROM (SELECT r, unnest([i, i+1, i+2]) AS p FROM rep) GROUP BY r),
ln AS (SELECT d.r, l FROM d, unnest(string_split(t, chr(10))) AS s(l)
       WHERE length(regexp_replace(l, '{_SQL_BREAK}', '', 'g')) > 0),
lc AS (SELECT r, count(*) AS n, count(DISTINCT l) AS k FROM ln GROUP BY r),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
  CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST({count(SYMBOLS)} AS BIGINT) AS n_symbols,
  CAST(coalesce(lc.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(lc.n - lc.k, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(cov.c, 0) AS BIGINT) AS n_repeat_words, {count('!?')} AS n_marks,
  len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i-1])) AS n_same_as_previous,
  {count('.,;:!?|')} AS n_stops
  FROM d LEFT JOIN cov USING (r) LEFT JOIN lc USING (r)),
f AS (SELECT *, CAST({bits} AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
 (fail_bits & {base}) <> 0 AS base_failed, (fail_bits & {base | DEFAULT.mask}) = 0 AS kept, fail_bits
FROM f"""
