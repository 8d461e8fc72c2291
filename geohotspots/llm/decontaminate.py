"""Benchmark decontamination with spaced-seed hashing.

A seed is a fixed mask over a window of words; the words under its zeros are ignored, so a
replaced word does not hide a window. Hashes of the training windows are joined with the
hashes of the benchmark windows, and each hit is verified by comparing the document with
the item word by word along the hit's alignment.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geohotspots.llm.common import WordCodes, bare, carried, struct_udf, window_codes, word_batches, words_of

#: An overlap is an aligned run of this many words (the whole item, if it is shorter) ...
OVERLAP = 13
#: ... of which this share is equal.
SIMILARITY = 0.8
#: Masks of six words over a span of eight. However the words that a run of ``OVERLAP`` may
#: lack are placed, one mask fits at one place of the run (a test tries all placements).
SEEDS = ("11010111", "11110011")
#: Benchmark words of one block; each block is one index of a proven size bound.
BLOCK_WORDS = 1_000_000
_BLOOM_BITS = 22

_CODES = WordCodes(bare)


class ItemIndex:
    """Sorted window hashes of one block of benchmark items."""

    def __init__(self, ids: list[int], texts: list[str]):
        words = [_CODES.of(words_of(t)) for t in texts]
        kept = [i for i, w in enumerate(words) if len(w)]
        self.ids = np.array([ids[i] for i in kept], np.int64)
        self.words = [words[i] for i in kept]
        #: Windows are hashed by the offsets under the ones of a mask. Items shorter than an
        #: overlap have masks of their own, one for each choice of the words they may lack.
        self.tables = []
        for seed in SEEDS:
            shape = tuple(i for i, bit in enumerate(seed) if bit == "1")
            self.tables.append((shape, self._entries(shape, lambda w: len(w) >= OVERLAP)))
        for n in sorted({len(w) for w in self.words if len(w) < OVERLAP}):
            for shape in combinations(range(n), math.ceil(n * SIMILARITY - 1e-9)):
                self.tables.append((shape, self._entries(shape, lambda w, n=n: len(w) == n)))

    def _entries(self, shape, chosen):
        codes, items, places = [], [], []
        for no, w in enumerate(self.words):
            if chosen(w):
                h = window_codes(w, shape)
                codes.append(h)
                items.append(np.full(len(h), no))
                places.append(np.arange(len(h)))
        if not codes:
            return None
        codes, items, places = map(np.concatenate, (codes, items, places))
        order = np.argsort(codes, kind="stable")
        codes = codes[order]
        bloom = np.zeros(1 << _BLOOM_BITS, bool)
        bloom[codes >> np.uint64(64 - _BLOOM_BITS)] = True
        return codes, items[order], places[order], bloom

    def hits(self, text_codes: np.ndarray):
        """Candidate alignments ``(item, offset)``: document word minus item word."""
        found = set()
        for shape, entries in self.tables:
            if entries is None:
                continue
            codes, items, places, bloom = entries
            h = window_codes(text_codes, shape)
            at = np.flatnonzero(bloom[h >> np.uint64(64 - _BLOOM_BITS)])
            low, high = (np.searchsorted(codes, h[at], side) for side in ("left", "right"))
            for p, a, b in zip(at[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist()):
                for e in range(a, b):
                    found.add((int(items[e]), p - int(places[e])))
        return found

    def overlaps(self, codes: np.ndarray, item: int, offset: int, begin: int, end: int):
        """Verified overlap ``(start, end, equal words)`` in words of one document, which
        spans ``begin`` to ``end`` of ``codes``, or None."""
        words = self.words[item]
        first, last = max(offset, begin), min(offset + len(words), end)
        width = min(OVERLAP, len(words))
        if last - first < width:
            return None
        equal = codes[first:last] == words[first - offset : last - offset]
        sums = np.r_[0, np.cumsum(equal)]
        good = np.flatnonzero(sums[width:] - sums[:-width] >= math.ceil(width * SIMILARITY - 1e-9))
        if not len(good):
            return None
        start, stop = int(good[0]), int(good[-1]) + width
        inside = np.flatnonzero(equal[start:stop])
        start, stop = start + int(inside[0]), start + int(inside[-1]) + 1
        return first - begin + start, first - begin + stop, int(equal[start:stop].sum())

    def find(self, texts: list[str]) -> dict:
        """For every text a list of ``(item, start, end, equal words)``."""
        out: list[list] = [[] for _ in texts]
        for first, codes, starts in word_batches(texts, _CODES):
            best: dict[tuple, tuple] = {}
            for item, offset in self.hits(codes):
                # An alignment may touch two texts of the batch; each is verified alone.
                low = np.searchsorted(starts, max(offset, 0), "right") - 1
                high = np.searchsorted(starts, offset + len(self.words[item]), "left")
                for doc in range(max(low, 0), min(high, len(starts) - 1)):
                    got = self.overlaps(codes, item, offset, int(starts[doc]), int(starts[doc + 1]))
                    if got:
                        # Of alignments that begin at one word the one that reaches furthest counts.
                        row = (int(self.ids[item]), *got)
                        best[doc, item, got[0]] = max(row, best.get((doc, item, got[0]), row))
            for (doc, _, _), row in sorted(best.items()):
                out[first + doc].append(row)
        return {"hits": out}


_HITS = "hits array<struct<item:long,first:long,last:long,equal:long>>"


def _block_indexes(benchmark: DataFrame) -> list[ItemIndex]:
    """Indexes of the benchmark, split by a hash into blocks of about ``BLOCK_WORDS``.

    Items without an id or a word are left out; repeated items count once.
    """
    items = (
        benchmark.filter("item_id is not null and text is not null")
        .select(F.col("item_id").cast("long").alias("item_id"), "text")
        .distinct()
    )
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / (6 * BLOCK_WORDS)))
    indexes = []
    for no in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == no).toPandas()
        rows = rows.sort_values(["item_id", "text"])
        indexes.append(ItemIndex(rows["item_id"].tolist(), rows["text"].tolist()))
    return indexes


def overlap_column(docs: DataFrame, benchmark: DataFrame):
    """Column with the verified overlaps of each text with any item."""
    context = docs.sparkSession.sparkContext

    def finder(shared):
        return struct_udf(lambda texts: shared.value.find(texts), _HITS)

    columns = [
        finder(context.broadcast(index))(F.col("text"))["hits"] for index in _block_indexes(benchmark)
    ]
    return reduce(F.concat, columns)


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, first_word, last_word, n_equal``: one row for each verified overlap.

    Words are numbered from 0, ``last_word`` is the last one that is equal. Null and empty
    texts have no overlap; rows without an id are reported with a null id; repeated rows
    are reported repeatedly.
    """
    return (
        docs.select("doc_id", overlap_column(docs, benchmark).alias("hits"))
        .select("doc_id", F.inline("hits"))
        .select(
            "doc_id",
            F.col("item").alias("item_id"),
            F.col("first").alias("first_word"),
            (F.col("last") - 1).alias("last_word"),
            F.col("equal").alias("n_equal"),
        )
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without any verified overlap, with all their columns."""
    found = carried(docs, {"hits": overlap_column(docs, benchmark)})
    return found.filter(F.size("hits") == 0).select("row.*")


def oracle_sql() -> str:
    """DuckDB SQL of ``overlaps``: all pairs of equal words, by alignment."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    marks = r"[!-/:-@\[-`{-~]+"

    def words(text: str) -> str:
        parts = f"string_split_regex(coalesce({text}, ''), '[\\x20\\x09-\\x0D]+')"
        word = f"translate(w, '{upper}', '{lower}')"
        bare_word = f"regexp_replace(regexp_replace({word}, '^{marks}', ''), '{marks}$', '')"
        return (
            f"list_transform(list_filter({parts}, lambda w: w <> ''), "
            f"lambda w: coalesce(nullif({bare_word}, ''), {word}))"
        )

    return f"""
WITH dl AS (SELECT row_number() OVER () AS r, doc_id, {words('text')} AS ws FROM documents),
il AS (SELECT row_number() OVER () AS it, item_id, {words('text')} AS ws
  FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL) x),
d AS (SELECT r, doc_id, len(ws) AS nd, unnest(ws) AS x, unnest(range(len(ws))) AS p FROM dl),
i AS (SELECT it, item_id, len(ws) AS ni, least({OVERLAP}, len(ws)) AS width, unnest(ws) AS x, unnest(range(len(ws))) AS p FROM il),
g AS (SELECT r, doc_id, nd, it, item_id, ni, width, CAST(ceil(width * {SIMILARITY} - 1e-9) AS BIGINT) AS need, d.p - i.p AS o, d.p AS p
  FROM d JOIN i USING (x) QUALIFY count(*) OVER (PARTITION BY r, it, d.p - i.p) >= need),
k AS (SELECT DISTINCT r, it, o, width, need, greatest(o, 0) AS lo, least(o + ni, nd) AS hi FROM g),
a AS (SELECT r, it, o, width, need, unnest(range(lo, hi - width + 1)) AS a FROM k WHERE hi - lo >= width),
f AS (SELECT r, it, o, a, width FROM a JOIN g USING (r, it, o, width, need) WHERE p >= a AND p < a + width
  GROUP BY r, it, o, a, width, need HAVING count(*) >= need),
s AS (SELECT r, it, o, min(a) AS lo, max(a) + max(width) AS hi FROM f GROUP BY r, it, o),
z AS (SELECT r, doc_id, it, item_id, min(p) AS first_word, max(p) AS last_word, count(*) AS n_equal
  FROM s JOIN g USING (r, it, o) WHERE p >= lo AND p < hi GROUP BY r, doc_id, it, item_id, o)
SELECT doc_id, item_id, first_word, t.l AS last_word, t.n AS n_equal FROM (
  SELECT doc_id, item_id, first_word, max({{'l': last_word, 'n': n_equal}}) AS t FROM z GROUP BY r, it, doc_id, item_id, first_word) y"""
