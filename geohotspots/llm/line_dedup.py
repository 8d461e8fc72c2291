"""Fuzzy line dedup: one occurrence of every group of alike lines stays.

Lines are normalised and hashed to SimHash fingerprints. Fingerprints that agree in enough
blocks of bits meet, those within the radius become candidate links, and the links whose
lines have an edit similarity of at least ``SIMILARITY`` connect lines into groups.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from geohotspots.llm.common import BATCH_CHARS, byte_codes, carried, mixed, run_hashes, struct_udf
from geohotspots.llm.pigeonhole import hamming_links
from geohotspots.operators.components import connected_components
from geohotspots.session import store

RADIUS, BLOCKS, SIMILARITY = 3, 5, 0.8

_OTHER, _DIGITS = re.compile(r"[^a-z0-9\x80-\U0010ffff]+"), re.compile(r"[0-9]+")
#: Distinct words of one sum of 16-bit counters.
_SUMMED = 60_000


def normal_line(line: str) -> str:
    """Lower case, digit runs as 0, words of letters and digits with one space between.

    Characters beyond ASCII count as letters.
    """
    return _DIGITS.sub("0", _OTHER.sub(" ", line.lower())).strip()


def _byte_table() -> np.ndarray:
    """0 for what parts words, 1 for a line feed, one value for all digits, else the byte."""
    table = np.zeros(256, np.uint8)
    table[128:] = np.arange(128, 256)
    for c in b"abcdefghijklmnopqrstuvwxyz":
        table[c] = c
    table[list(b"0123456789")] = ord("0")
    table[ord("\n")] = 1
    return table


_BYTES = _byte_table()
_CODES = byte_codes(23)
_BASE = 0x9E3779B97F4A7C15


def word_hashes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of ``text`` (see :func:`normal_line`) and the line of each."""
    raw = _BYTES[np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)]
    digit = raw == ord("0")
    if digit.any():
        raw = raw[~(digit & np.r_[False, digit[:-1]])]
    hashes, starts = run_hashes(raw, raw > 1, _CODES)
    return hashes, np.searchsorted(np.flatnonzero(raw == 1), starts)


#: The bits of a byte as eight counters of 16 bits, in two numbers.
_COUNTERS = (
    np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.uint16).view(np.uint64)
)


def simhashes(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A bit is 1 if it is set in over half of the codes between two starts."""
    lengths = np.diff(np.r_[starts, len(codes)])
    cuts = starts
    if len(codes) > _SUMMED:
        cuts = np.unique(np.r_[starts, np.arange(0, len(codes), _SUMMED)])
    octets = codes.view(np.uint8).reshape(-1, 8)
    sums = np.concatenate(
        [np.add.reduceat(_COUNTERS[octets[:, i]], cuts, axis=0).view(np.uint16) for i in range(8)], axis=1
    ).astype(np.int64)
    if len(cuts) > len(starts):
        sums = np.add.reduceat(sums, np.searchsorted(cuts, starts), axis=0)
    return np.packbits(2 * sums > lengths[:, None], axis=1, bitorder="little").view(np.int64).ravel()


def _line_hashes(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hashes of the sequences of words."""
    place = np.arange(len(codes)) - np.repeat(starts, lengths)
    weight = (place + 1).astype(np.uint64) * np.uint64(_BASE)
    weight = (weight ^ (weight >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) | np.uint64(1)
    return mixed(np.add.reduceat(codes * weight, starts))


def line_prints(texts: list[str]) -> dict:
    """For every text, the numbers, hashes and SimHashes of its lines that have a word.

    A line's SimHash counts each of its distinct words once, so that the few words that
    every line repeats do not make unlike lines alike.
    """
    out: dict[str, list] = {"at": [], "line": [], "fp": []}
    group: list[str] = []

    def flush() -> None:
        # A line feed between texts; the lines of a text are numbered from its first one.
        codes, number = word_hashes("\n".join(group))
        ends = np.cumsum([text.count("\n") + 1 for text in group])
        used, starts, counts = np.unique(number, return_index=True, return_counts=True)
        hashes = fps = np.empty(0, np.int64)
        if len(codes):
            hashes = _line_hashes(codes, starts, counts).view(np.int64)
            pairs = codes + number.astype(np.uint64) * np.uint64(_BASE)
            once = np.sort(np.unique(pairs, return_index=True)[1])
            fps = simhashes(codes[once], np.searchsorted(once, starts))
        begin, cut = 0, np.searchsorted(used, [0, *ends])
        for end, low, high in zip(ends.tolist(), cut.tolist(), cut[1:].tolist()):
            out["at"].append((used[low:high] - begin).astype(np.int32))
            out["line"].append(hashes[low:high])
            out["fp"].append(fps[low:high])
            begin = end
        group.clear()

    size = 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size >= BATCH_CHARS:
            flush()
            size = 0
    if group:
        flush()
    return out


def _trimmed(a: str, b: str) -> tuple[str, str]:
    """Both texts without their common beginning and end, which cost no edit."""

    def common(x: str, y: str) -> int:
        low, high = 0, min(len(x), len(y))
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if x[low:middle] == y[low:middle] else (low, middle - 1)
        return low

    n = common(a, b)
    a, b = a[n:], b[n:]
    n = common(a[::-1], b[::-1])
    return (a[:-n], b[:-n]) if n else (a, b)


def edit_distance_within(a: str, b: str, most: int) -> bool:
    """Whether the Levenshtein distance is at most ``most``.

    A bound from the characters alone comes first; then one bit vector for each character
    of ``b`` holds a whole column of differences (whole numbers of any length).
    """
    a, b = _trimmed(a, b)
    if abs(len(a) - len(b)) > most:
        return False
    if not a or not b:
        return True
    left, right = Counter(a), Counter(b)
    if max((left - right).total(), (right - left).total()) > most:
        return False
    if len(a) < len(b):
        a, b = b, a
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full, last = (1 << len(a)) - 1, len(a) - 1
    up, down, distance = full, 0, len(a)
    for left_over, c in zip(range(len(b) - 1, -1, -1), b):
        same = at.get(c, 0)
        x = same | down
        diagonal = (((x & up) + up) ^ up) | x
        plus = (down | ~(diagonal | up)) & full
        minus = diagonal & up
        distance += (plus >> last & 1) - (minus >> last & 1)
        if distance - left_over > most:
            return False
        plus, minus = plus << 1 | 1, minus << 1
        up = (minus | ~(diagonal | plus)) & full
        down = plus & diagonal & full
    return distance <= most


def similar(a: str, b: str, similarity: float = SIMILARITY) -> bool:
    """Edit similarity of two normalised lines: 1 - distance / longer length."""
    longest = max(len(a), len(b))
    return edit_distance_within(a, b, int(longest * (1 - similarity) + 1e-9))


@F.pandas_udf(BooleanType())
def _verified(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([similar(normal_line(a), normal_line(b)) for a, b in zip(left, right)])


def _keys() -> dict[str, Column]:
    """``doc``, the id, and ``copy``, a hash of id and text: together they name a text.

    The id alone does not: rows without one, or with one in common, have texts of their own.
    """
    return {"doc": F.col("doc_id").cast("long"), "copy": F.xxhash64("doc_id", "text")}


def _same_text(left: DataFrame, right: DataFrame) -> Column:
    return left["doc"].eqNullSafe(right["doc"]) & (left["copy"] == right["copy"])


def _lines(docs: DataFrame) -> DataFrame:
    """``doc, copy, at, line, fp``: one row for each line with a word."""
    prints = struct_udf(line_prints, "at array<int>, line array<long>, fp array<long>")
    return (
        docs.select(*[c.alias(n) for n, c in _keys().items()], prints(F.col("text")).alias("p"))
        .select("doc", "copy", F.inline(F.arrays_zip("p.at", "p.line", "p.fp")))
    )


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``line, text`` for ``wanted(line, doc, copy, at)``."""
    asked = wanted.groupBy("doc", "copy").agg(F.collect_list(F.struct("line", "at")).alias("asked"))
    source = docs.select(*[c.alias(n) for n, c in _keys().items()], "text")
    found = source.join(asked, _same_text(source, asked))
    return (
        found.select(F.split("text", "\n", -1).alias("parts"), F.inline("asked"))
        .select("line", F.get("parts", F.col("at")).alias("text"))
        .filter("text is not null")
    )


def group_lines(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored lines ``doc, copy, at, line, fp`` and the groups ``line, root`` of alike lines.

    Only lines with a link are in the second table. Equal normalised lines are one node
    from the start; nodes of equal or close fingerprints become candidates.
    """
    lines = store(_lines(docs))
    nodes = lines.groupBy("line").agg(
        F.min("fp").alias("fp"), F.min(F.struct("doc", "copy", "at")).alias("first")
    )
    nodes = store(nodes.select("line", "fp", "first.doc", "first.copy", "first.at"))
    pairs = store(hamming_links(nodes.select(F.col("line").alias("node"), "fp"), RADIUS, BLOCKS))

    def checked(candidates: DataFrame) -> DataFrame:
        ends = candidates.select(F.explode(F.array("u", "v")).alias("line")).distinct()
        texts = _texts_of(docs, nodes.join(ends, "line", "left_semi")).groupBy("line").agg(
            F.min("text").alias("text")
        )
        both = candidates.join(texts.select(F.col("line").alias("u"), F.col("text").alias("a")), "u").join(
            texts.select(F.col("line").alias("v"), F.col("text").alias("b")), "v"
        )
        return store(both.select("u", "v", _verified("a", "b").alias("same")))

    tested = checked(pairs)
    roots = store(connected_components(tested.filter("same").select("u", "v")))
    rejected = tested.filter("not same")
    if not rejected.isEmpty():
        # The candidates span their groups. Where one of them fails, its ends lie in
        # different parts, and other pairs between such parts may still hold: all are tested.
        def part_of(end: str) -> DataFrame:
            known = rejected.select(F.col(end).alias("node")).join(roots, "node", "left")
            return known.select(F.coalesce("root", "node").alias("part"))

        torn = part_of("u").union(part_of("v")).distinct()
        alone = torn.select(F.col("part").alias("node"), "part")
        members = roots.join(torn, F.col("root") == F.col("part")).select("node", "part").union(alone).distinct()
        parts = store(members.join(nodes.select(F.col("line").alias("node"), "fp"), "node"))
        more = checked(hamming_links(parts, RADIUS, BLOCKS, label="part")).filter("same")
        if not more.isEmpty():
            part = parts.select("node", "part")
            bridges = more.join(part.toDF("u", "pu"), "u").join(part.toDF("v", "pv"), "v")
            joined = connected_components(bridges.select(F.col("pu").alias("u"), F.col("pv").alias("v")))
            joined = joined.toDF("part", "whole")
            everyone = roots.union(joined.select("part", "part").toDF("node", "root")).distinct()
            roots = everyone.join(joined, F.col("root") == F.col("part"), "left").select(
                "node", F.coalesce("whole", "root").alias("root")
            )
    return lines, roots.select(F.col("node").alias("line"), "root")


def surplus_lines(docs: DataFrame) -> DataFrame:
    """``doc, copy, dropped``: the numbers (from 0) of the lines to drop from each text.

    In every group the occurrence with the smallest document and line number stays.
    """
    lines, roots = group_lines(docs)
    counted = lines.groupBy("line").agg(F.min(F.struct("doc", "copy", "at")).alias("first"), F.count("*").alias("n"))
    named = counted.join(roots, "line", "left").withColumn("root", F.coalesce("root", "line"))
    keepers = named.groupBy("root").agg(F.min("first").alias("keep"), F.sum("n").alias("n")).filter("n > 1")
    repeated = named.join(keepers.drop("n"), "root").select("line", "keep")
    return (
        lines.join(repeated, "line")
        .filter(~F.struct("doc", "copy", "at").eqNullSafe(F.col("keep")))
        .groupBy("doc", "copy")
        .agg(F.sort_array(F.collect_set("at")).alias("dropped"))
    )


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the surplus lines cut out of ``text``; no row is dropped.

    Lines are what stands between line feeds; lines without a letter or digit are never
    surplus. A text that loses all its lines becomes empty; null texts stay null. Rows equal
    in id and text count as copies of one document: a line number that is surplus goes from
    all of them. Rows that share an id, or have none, but differ in text are documents of
    their own. ``n_chars``, if there is such a column, follows the text.
    """
    rows, gone = carried(docs, _keys()), surplus_lines(docs)
    both = rows.join(gone, _same_text(rows, gone), "left")
    text = F.col("row.text")
    kept = F.filter(F.split(text, "\n", -1), lambda _, i: ~F.array_contains("dropped", i))
    new = both.select("row", F.when(F.col("dropped").isNull(), text).otherwise(F.concat_ws("\n", kept)).alias("new"))
    columns = []
    for field in docs.schema.fields:
        value = F.col(f"row.`{field.name}`")
        if field.name == "text":
            value = F.col("new")
        elif field.name == "n_chars":
            value = F.length("new").cast(field.dataType)
        columns.append(value.alias(field.name))
    return new.select(*columns)


def line_report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_dropped, dropped``: the surplus line numbers of each row's text."""
    gone = surplus_lines(docs)
    keys = [c.alias(n) for n, c in _keys().items()]
    slim = docs.select("doc_id", *keys, F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long").alias("n_lines"))
    return slim.join(gone, _same_text(slim, gone), "left").select(
        "doc_id",
        "n_lines",
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce(F.array_join("dropped", ","), F.lit("")).alias("dropped"),
    )
