"""Text helpers shared by the operators: words, word codes, batches, struct UDFs."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geohotspots.session import store

#: Words a worker keeps in its code table; further words are hashed each time.
CACHED_WORDS = 400_000
#: Words of one numpy batch. It bounds memory; a longer text is a batch of its own.
BATCH_WORDS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket(key: Column, buckets: int) -> Column:
    """crc32 of the key as text, modulo ``buckets``; null keys give null."""
    return F.crc32(key.cast("string")) % buckets


def with_columns(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns; an input column of the same name, in any case, is replaced."""
    new = {c.lower() for c in columns}
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in new]
    return df.select(*kept, *[c.alias(n) for n, c in columns.items()])


def carried(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``row``, a struct of all columns of ``df``, beside new columns.

    The names of the new columns may clash with any name in ``df``; ``select("row.*")``
    gives the input columns back.
    """
    return df.select(F.struct("*").alias("row"), *[c.alias(n) for n, c in columns.items()])


def struct_udf(fn: Callable[[list], dict], schema: str):
    """Arrow-batched function of one text column.

    ``fn`` gets a list of texts (nulls as empty) and returns lists by field name. It is
    marked as not deterministic, so that a later filter does not evaluate it twice.
    """

    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(fn([t if t is not None else "" for t in texts.tolist()]))

    run.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, schema).asNondeterministic()


class WordCodes(dict):
    """64-bit codes of words (bytes), after an optional normalisation of the word."""

    def __init__(self, normal: Callable[[bytes], bytes] | None = None):
        super().__init__()
        self.normal = normal

    def __missing__(self, word: bytes) -> int:
        code = xxhash.xxh64_intdigest(self.normal(word) if self.normal else word)
        if len(self) < CACHED_WORDS:
            self[word] = code
        return code

    def of(self, words: Sequence[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def bare(word: bytes) -> bytes:
    """Lower-case letters A-Z and strip ASCII punctuation around the word, if it has more."""
    word = word.lower()
    return word.strip(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") or word


def words_of(text: str) -> list[bytes]:
    """Runs of characters other than space and U+0009 to U+000D, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split()


def word_batches(
    texts: list[str], codes: WordCodes
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first text, codes, starts)`` for batches of whole texts.

    ``starts`` has one entry more than the batch has texts.
    """
    first, words, starts = 0, [], [0]
    for i, text in enumerate(texts):
        words += words_of(text)
        starts.append(len(words))
        if len(words) >= BATCH_WORDS:
            yield first, codes.of(words), np.array(starts)
            first, words, starts = i + 1, [], [0]
    if len(starts) > 1:
        yield first, codes.of(words), np.array(starts)


#: Odd multipliers of the positions in a window, from one fixed seed.
_ODD = np.random.default_rng(11).integers(1, 1 << 62, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread sums over all bits (a bijection)."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def window_codes(codes: np.ndarray, offsets: Sequence[int]) -> np.ndarray:
    """One code for every window start, from the words at ``offsets`` (the last one is
    the largest). Windows that would leave the array are left out."""
    n = len(codes) - offsets[-1]
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for o in offsets:
        total += codes[o : o + n] * _ODD[o % len(_ODD)]
    return mixed(total)


#: Characters hashed together by :func:`run_hashes`; a longer text is a batch of its own.
BATCH_CHARS = 250_000
_BASE = 0x9E3779B97F4A7C15


class _Powers:
    """Powers of an odd base and of its inverse, modulo 2 ** 64."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 2 * BATCH_CHARS)
            inverse = pow(_BASE, -1, 1 << 64)
            self.up, self.down = (
                np.r_[np.uint64(1), np.full(size - 1, base, np.uint64)].cumprod(dtype=np.uint64)
                for base in (_BASE, inverse)
            )
        return self.up, self.down


_POWERS = _Powers()


def byte_codes(seed: int) -> np.ndarray:
    """A random number for each byte, for :func:`run_hashes`."""
    return np.random.default_rng(seed).integers(1, 1 << 62, 256, dtype=np.uint64)


def run_hashes(raw: np.ndarray, inside: np.ndarray, codes: np.ndarray):
    """Hash and first byte of every run of ``inside`` bytes.

    Equal runs have equal hashes wherever they stand: sums of ``codes`` times powers of the
    place are shifted back to the run's start.
    """
    change = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = change[::2], change[1::2]
    up, down = _POWERS.upto(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(codes[raw] * up[: len(raw)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts]), starts


def found_sample(texts: DataFrame, finds: Callable[[str], object], found: int, rest: int) -> list[str]:
    """Distinct ``text`` values: ``found`` of those in which ``finds`` finds something, and
    ``rest`` of the others, at most, each the first in the order of a hash.

    All texts are searched before any is sampled, so rare findings are not missed. Only
    hashes are ordered, so no task sends more texts to the driver than are sampled.
    """

    def run(column: pd.Series) -> pd.Series:
        return pd.Series([bool(finds(t)) for t in column], dtype=bool)

    run.__annotations__ = {"column": pd.Series, "return": pd.Series}
    coded = texts.filter("text is not null").select("text", F.xxhash64("text").alias("h"))
    searched = coded.select("h", F.pandas_udf(run, "boolean").asNondeterministic()("text").alias("found"))
    marks = store(searched.distinct())
    first = [marks.filter(c).orderBy("h").limit(n).select("h") for c, n in (("found", found), ("not found", rest))]
    hashes = [r["h"] for f in first for r in f.collect()]
    if not hashes:
        return []
    rows = coded.filter(F.col("h").isin(hashes)).distinct().collect()
    return [r["text"] for r in sorted(rows, key=lambda r: (r["h"], r["text"]))]
