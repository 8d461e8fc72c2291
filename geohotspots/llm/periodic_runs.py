"""Periodic runs of words, found with a dictionary of basic factors.

A *run* is a stretch of words that repeats with a smallest period ``q``, at least
``repeats`` times, and that no neighbouring word extends. For every power of two ``b`` the
factors of ``b`` words get names: equal factors of a text share a name, made from the names
of their two halves. Neighbouring starts whose factor comes again at the same distance
``q`` (its successor) form an arithmetic progression of equal factors and propose ``q``.

With ``b / 2 < q <= b`` a factor is at least one period long. Inside a run with at least
three periods its successor is then exactly ``q`` words on, and no start outside the run
has that successor, so a progression is the whole run, already extended as far as it goes,
and each run is proposed by one length only. Longer successors, up to twice ``b``, belong
to the next length. Only factors that come twice are kept from one length to the next.

The work is one Arrow pass without a shuffle. Batches of texts are named together, so that
short texts cost no calls of their own; a text stays whole in one task.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geohotspots.llm.common import BATCH_WORDS, carried, words_of

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


class _Ids(dict):
    """Running numbers of words."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def _by_name(name: np.ndarray, pos: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Names and positions in the order of (name, position)."""
    shift = max(int(n).bit_length(), 1)
    if int(name.max()).bit_length() + shift < 63:
        both = np.sort((name << shift) | pos)
        return both >> shift, both & ((1 << shift) - 1)
    order = np.lexsort((pos, name))
    return name[order], pos[order]


def runs_of(words: np.ndarray, ends: np.ndarray, least: int, repeats: int) -> np.ndarray:
    """Rows ``(start, length, period)`` by start, then period.

    ``words`` are numbers, equal only for equal words of one text; ``ends[i]`` is where the
    text of position ``i`` ends. Positions count over the whole batch.
    """
    n, b, found = len(words), 1, []
    if not n:
        return np.empty((0, 3), np.int64)
    longest = int((ends - np.arange(n)).max())
    name, pos = words.astype(np.int64), np.arange(n)
    while len(pos):
        name, pos = _by_name(name, pos, n)
        again = name[1:] == name[:-1]
        gap = pos[1:] - pos[:-1]
        near = again & (gap <= b) & (2 * gap > b)
        successor = np.zeros(n + 1, np.int64)
        successor[pos[:-1][near]] = gap[near]
        cuts = np.flatnonzero(np.diff(successor, prepend=0))
        period = successor[cuts]
        start, stop = cuts[period > 0], np.append(cuts[1:], n)[period > 0]
        period = period[period > 0]
        length = stop - start - 1 + b + period
        fits = length >= np.maximum(least, repeats * period)
        found.append(np.stack([start, length, period], 1)[fits])

        b *= 2
        if repeats * (b // 2 + 1) > longest:
            break
        twice = np.append(again, False) | np.insert(again, 0, False)
        rank = np.full(n, -1, np.int64)
        rank[pos] = np.where(twice, np.cumsum(np.insert(~again, 0, True)) - 1, -1)
        pos = np.flatnonzero(rank >= 0)
        pos = pos[pos + b <= ends[pos]]
        pos = pos[rank[pos + b // 2] >= 0]
        name = rank[pos] * (int(rank.max()) + 1) + rank[pos + b // 2]
    runs = np.concatenate(found)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _batches(texts: list[str]):
    """Whole texts as lists of words, together about ``BATCH_WORDS`` words."""
    batch, size = [], 0
    for text in texts:
        batch.append(words_of(text))
        size += len(batch[-1])
        if size >= BATCH_WORDS:
            yield batch
            batch, size = [], 0
    if batch:
        yield batch


def _search(texts: list[str], least: int, repeats: int) -> dict:
    runs, collapsed = [], []
    for batch in _batches(texts):
        ids = _Ids()
        sizes = np.array([len(words) for words in batch])
        edges = np.insert(np.cumsum(sizes), 0, 0)
        numbers = np.fromiter((ids[w] for words in batch for w in words), np.int64, edges[-1])
        numbers += np.repeat(np.arange(len(batch)), sizes) * len(ids)
        found = runs_of(numbers, np.repeat(edges[1:], sizes), least, repeats)
        depth = np.zeros(edges[-1] + 1, np.int64)
        np.add.at(depth, found[:, 0] + found[:, 2], 1)
        np.add.at(depth, found[:, 0] + found[:, 1], -1)
        kept = np.cumsum(depth) == 0
        first = np.searchsorted(found[:, 0], edges)
        for i, words in enumerate(batch):
            mine = found[first[i] : first[i + 1]]
            if len(mine):
                words = compress(words, kept[edges[i] : edges[i + 1]])
            collapsed.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            runs.append(
                [{"start": s, "length": n, "period": p} for s, n, p in (mine - [edges[i], 0, 0]).tolist()]
            )
    return {"runs": runs, "collapsed": collapsed}


def find_runs(docs: DataFrame, least: int = 6, repeats: int = 4) -> DataFrame:
    """``row`` (all columns of ``docs``), ``runs`` and ``collapsed`` for each row.

    ``runs`` lists start (word number), length and period of each run of at least ``least``
    words and ``repeats`` periods, by start, then period. ``collapsed`` is the text with
    single spaces between its words, without the words that stand in a run behind that
    run's first period.

    Null and empty texts, and texts of white space, have no runs and an empty ``collapsed``.
    Every row is searched for itself, so repeated rows and rows without id come back as they
    are; an empty table gives an empty one; names of other columns cannot clash.
    """
    if repeats < 3:
        raise ValueError("repeats must be at least 3: shorter runs have other successors")

    def search(texts: pd.Series) -> pd.DataFrame:
        found = _search([t if t is not None else "" for t in texts.tolist()], least, repeats)
        return pd.DataFrame(found, columns=["runs", "collapsed"], dtype=object)

    udf = F.pandas_udf(search, f"runs {RUNS}, collapsed string").asNondeterministic()
    found = carried(docs, {"found": udf(F.col("text"))})
    return found.select("row", "found.runs", "found.collapsed")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Texts of every tenth document, by crc32 of its id, get one stretch of repeated words.

    With ``h = crc32(doc_id)``, ``g = h div 10`` and ``n`` words, each word ``i >= a``
    becomes word ``a + (i - a) mod p``, where ``a = g mod n`` and
    ``p = 1 + (n - a) div (3 + g mod 8)``. Other texts, and those without words or id, stay.
    """
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    h = F.crc32(F.col("doc_id").cast("string"))

    def planted(words):
        n, g = F.size(words), F.floor(h / 10)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        moved = F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p)),
        )
        return F.array_join(moved, " ")

    # The transform over one element names the words once for all uses.
    text = F.when((h % 10 == 0) & F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.get(F.transform(F.array(words), planted), F.lit(0)))
    return docs.withColumn("text", F.coalesce(text, "text"))


def run_report(docs: DataFrame) -> DataFrame:
    """One row for each document: its runs after :func:`with_planted_runs`, as digests.

    ``doc_id``, ``n_runs``, then ``start``, ``length``, ``period`` and ``exponent_milli`` of
    the longest run (ties: smallest start, then period; null without runs), ``runs_sha256``
    (``start,length,period`` and a line feed for each run) and ``collapsed_sha256``.
    Odd rows are handled as in :func:`find_runs`; a null ``doc_id`` gives nothing planted.
    """
    found = find_runs(with_planted_runs(docs.select("doc_id", "text")))
    best = F.array_min(F.transform("runs", lambda r: F.struct(-r["length"], r["start"], r["period"], r["length"].alias("n"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return found.select("row.doc_id", "runs", "collapsed", best.alias("best")).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.n").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.n div best.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
