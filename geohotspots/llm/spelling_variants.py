"""Groups of spelling variants by PartEnum signatures.

Words count in the whole corpus. Two words are near if one inserted, deleted or replaced
letter turns one into the other. Their letter multisets, as binary vectors with one place
for each letter and occurrence number, then differ in at most two places. PartEnum deals
the places over ``PARTS`` parts; two differing places touch at most two parts, so near
words agree on all letters of some choice of ``PARTS - 2`` parts. Each choice gives one
signature, and equal signatures are joined by key and verified by edit distance.

Words made of the same letters in another order share all signatures. Each signature is
therefore tied to half a word: where the shorter of two near words has ``m`` letters, the
edit leaves the first ``m // 2`` or the last ``m - m // 2`` letters as they were. A word
stands under its own length and, as the longer word, under one less. That loses no pair.

Signatures shared by more than ``CROWDED`` words are not compared pairwise: their words go
once more under each string that one deletion leaves (near words share one), so rows grow
with the words and not with their square.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geohotspots.session import store

PARTS = 4
CROWDED = 400
LEAST_LETTERS = 5
LEAST_COUNT = 3
#: Distinct words that a task counts before it hands them on.
COUNTED_WORDS = 400_000

#: Bytes of Latin-1 text: letters stay, A-Z become small, all else ends a word.
_LETTERS = bytes(
    c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256)
)


def letter_runs(text: str) -> list[bytes]:
    """Runs of ``[A-Za-z\\u00C0-\\u00FF]``, only A-Z lower-cased, as Latin-1."""
    return text.encode("latin-1", "replace").translate(_LETTERS).split()


def _altered(run: bytes, seed: int, rate: int) -> bytes:
    """The run, short of one letter if ``rate`` divides its hash with the document."""
    h = crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
    if h % rate:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def count_words(docs: DataFrame, slip_rate: int | None = 97) -> DataFrame:
    """``word, n`` for words of at least 5 letters that occur at least 3 times.

    With ``slip_rate``, a run of letters whose ``crc32("<doc_id>:<run>")`` it divides loses
    the letter at that hash modulo its length; rows without id lose none. Texts are counted
    one by one, then over what a task has read, then by word; null texts have no words.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in seen], pa.string())
            out = pa.RecordBatch.from_arrays([words, pa.array(seen.values(), pa.int64())], ["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(*(column.to_pylist() for column in batch.columns)):
                if text is None:
                    continue
                mine = Counter(letter_runs(text))
                if slip_rate and doc_id is not None:
                    seed = crc32(f"{doc_id}:".encode())
                    for run, n in mine.items():
                        word = _altered(run, seed, slip_rate)
                        if len(word) >= LEAST_LETTERS:
                            seen[word] += n
                else:
                    for run, n in mine.items():
                        if len(run) >= LEAST_LETTERS:
                            seen[run] += n
                if len(seen) > COUNTED_WORDS:
                    yield flush()
        yield flush()

    texts = docs.select(F.col("doc_id").cast("string"), "text")
    counted = texts.mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


#: Random 64-bit numbers for letters and occurrence numbers, from one fixed seed.
_PLACES = np.random.default_rng(13).integers(1, 1 << 62, (256, 64), dtype=np.uint64)
_CHOICES = list(combinations(range(PARTS), PARTS - 2))
_SPREAD = np.random.default_rng(14).integers(1, 1 << 62, (len(_CHOICES) + 1, PARTS), dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def signatures(words: list[bytes]) -> np.ndarray:
    """One row of signatures for each word (Latin-1): first those under its own length,
    then, as many, those under one letter less.

    A place is a letter with the number of its occurrence. Places go to parts by letter and
    number in turn.
    """
    sizes = np.array([len(w) for w in words])
    letters = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
    owner = np.repeat(np.arange(len(words)), sizes)
    order = np.lexsort((letters, owner))
    owner, letters = owner[order], letters[order]
    new = np.r_[True, (owner[1:] != owner[:-1]) | (letters[1:] != letters[:-1])]
    at = np.arange(len(letters))
    nth = at - np.maximum.accumulate(np.where(new, at, 0))
    value = _PLACES[letters, nth % 64]
    parts = np.zeros((len(words), PARTS), np.uint64)
    np.add.at(parts, (owner, (letters + 2 * nth) % PARTS), value)
    parts = _mixed(parts)

    enumerated = []
    for no, choice in enumerate(_CHOICES):
        base = np.zeros(len(words), np.uint64)
        for p in choice:
            base += parts[:, p] * (_SPREAD[no, p] | np.uint64(1))
        enumerated.append(base)
    out = []
    for m in (sizes, sizes - 1):
        first = [crc32(w[: k // 2], k) for w, k in zip(words, m.tolist())]
        last = [crc32(w[len(w) - (k - k // 2) :], ~k & 0xFFFFFFFF) for w, k in zip(words, m.tolist())]
        for half, salt in ((first, 40), (last, 41)):
            end = _mixed(np.array(half, np.uint64) + (np.uint64(1) << np.uint64(salt)))
            out += [_mixed(base + end) for base in enumerated]
    return np.stack(out, 1).view(np.int64)


def _signature_rows(counted: DataFrame) -> DataFrame:
    def sign(words: pd.Series) -> pd.Series:
        if not len(words):
            return pd.Series([], dtype=object)
        return pd.Series(list(signatures([w.encode("latin-1") for w in words])))

    sign.__annotations__ = {"words": pd.Series, "return": pd.Series}
    udf = F.pandas_udf(sign, "array<bigint>").asNondeterministic()
    signed = counted.select("word", "n", F.posexplode(udf("word")).alias("no", "sig"))
    return signed.select("sig", "word", "n", (F.col("no") < 2 * len(_CHOICES)).alias("own"))


def _pairs(rows: DataFrame, key: str) -> DataFrame:
    """Verified near pairs ``a < b`` of rows that share ``key``, one of them under its own
    length (two longer words meet under theirs)."""

    def side(name: str) -> DataFrame:
        return rows.select(
            key,
            *[F.col(c).alias(f"{name}{c}") for c in ("word", "n", "own")],
            F.length("word").alias(f"{name}size"),
        )

    near = (
        F.expr("aword < bword and (aown or bown) and abs(asize - bsize) <= 1")
        & (F.levenshtein("aword", "bword", 1) == 1)
    )
    a, b = side("a"), side("b")
    return a.join(b, (a[key] == b[key]) & near).selectExpr("aword a", "an a_n", "bword b", "bn b_n")


def near_words(counted: DataFrame) -> DataFrame:
    """Each pair of near words of ``counted(word, n)`` once: ``a, a_n, b, b_n``, ``a < b``."""
    rows = store(_signature_rows(counted))
    crowded = store(rows.groupBy("sig").count().filter(F.col("count") > CROWDED).select("sig"))
    calm = rows.join(crowded, "sig", "left_anti")
    rest = rows.join(crowded, "sig", "left_semi").select("word", "n").distinct()
    size = F.length("word")
    shorter = F.transform(
        F.sequence(F.lit(1), size),
        lambda i: F.concat(F.substring("word", F.lit(1), i - 1), F.substring("word", i + 1, size)),
    )
    variants = rest.select(
        "word", "n", F.lit(True).alias("own"), F.explode(F.array_distinct(F.concat(F.array("word"), shorter))).alias("variant")
    )
    return _pairs(calm, "sig").union(_pairs(variants, "variant")).distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for words with a form, by pointer doubling.

    Counts at least double from a word to its form, so chains are shorter than the bits of
    the largest count, and rounds are the logarithm of that.
    """
    current = store(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = current.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = store(
            current.join(ahead, "root", "left").select(
                "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
            )
        )
        current = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return current


def group_variants(counted: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each row of ``counted(word, n)``.

    The form is the near word of largest ``n`` (ties: smallest word) if that is at least
    twice the word's own; the root is the last form of the chain. Words without near words
    have ``n_near`` 0 and are their own root. An empty table gives an empty one.
    """
    counted = store(counted)
    links = store(near_words(counted))
    both = links.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n")).union(
        links.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("other_n"))
    )
    best = both.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"),
        F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best"),
    )

    def if_larger(value: Column) -> Column:
        return F.when(-F.col("best.less") >= 2 * F.col("n"), value)

    formed = store(
        counted.join(best, "word", "left").select(
            "word",
            if_larger(F.col("best.form")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            if_larger(-F.col("best.less")).alias("form_n"),
        )
    )
    roots = _roots(formed.filter("form is not null"))
    return formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def variants(docs: DataFrame) -> DataFrame:
    """Spelling variants of the words of all texts, with planted slips; one row a word.

    Null and empty texts have no words; repeated rows count each time; rows without id get
    no slips; other columns are not read; an empty table gives an empty one.
    """
    return group_variants(count_words(docs))
