"""Secrets: patterns, and a character convolutional network over every candidate string.

The patterns give the base spans, which always stay. A candidate is a run of the characters
that keys are made of; the network reads it with the text on both sides. It is trained in numpy, in
shards that tasks train apart, on the labelled findings of all texts: those of the patterns, and
altered ones (see ``altered``) that no pattern covers. Its calibrated threshold is the highest that keeps the required recall on findings set
aside.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geohotspots.llm import altered
from geohotspots.llm.common import struct_udf
from geohotspots.session import store

#: Base kinds in listed order; spans that the network adds come after them.
KINDS = ("assign", "access", "hex", "model")
#: Windows of a shard, rounds over all shards, and units of the parameters' sums.
SHARD, ROUNDS, FIXED = 8192, 5, 1 << 32
#: Steps of a score; scores end at 30.
RAW_STEPS = 1000
#: Share of the findings set aside that the threshold has to keep.
RECALL = 0.98
CONTEXT, BODY = 24, 48
WIDTH = 2 * CONTEXT + BODY
EMBED, FILTERS, KERNEL = 10, 24, 5
AT_ONCE = 512
#: Altered copies of a training text with a finding; training steps of 64 candidates.
ALTERED_COPIES, STEPS = 3, 600

_ASSIGN = re.compile(
    r"(?ai:(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+))"
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}+")
#: A run of at least 12 key characters with a digit, or one behind an assignment sign.
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-][A-Za-z0-9+/_=.-]{10,}[A-Za-z0-9+/_=-]")
#: Parts of a run between assignment signs; signs at its end belong to the last part (padding).
_PART = re.compile(r"[^=]+(?:=+\Z)?")
_KEY_CHARS = 12
_DIGIT = re.compile(r"[0-9]")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` in code points, sorted."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def span_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _assigned(text: str, at: int) -> bool:
    """Whether an assignment sign stands before ``at``, with spaces and a quote between."""
    if at and text[at - 1] in "\"'":
        at -= 1
    while at and text[at - 1] == " ":
        at -= 1
    return at > 0 and text[at - 1] in ":="


def _whole_keys(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Candidates of a run: its parts between assignment signs, as far as they are keys
    themselves, and what lies before, between and behind such parts."""
    rest = start

    def left_over(upto: int) -> Iterator[tuple[int, int]]:
        if upto - rest >= _KEY_CHARS and (_DIGIT.search(text, rest, upto) or _assigned(text, rest)):
            yield rest, upto

    for m in _PART.finditer(text[start:end]):
        s, e = start + m.start(), start + m.end()
        if e - s >= _KEY_CHARS and (_DIGIT.search(text, s, e) or _assigned(text, s)):
            yield from left_over(s)
            yield s, e
            rest = e
    yield from left_over(end)


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Every candidate of the text. Texts without a digit or an assignment sign have none."""
    if not (_DIGIT.search(text) or ":" in text or "=" in text):
        return
    for m in _CANDIDATE.finditer(text):
        yield from _whole_keys(text, *m.span())


def _class_table() -> np.ndarray:
    table = np.full(257, 1, np.int64)
    for c in range(256):
        ch = chr(c)
        table[c] = 2 if ch.isalpha() else 3 if ch.isspace() else 1
    for no, ch in enumerate("abcdefghijklmnopqrstuvwxyz"):
        table[ord(ch)] = 4 + no
        table[ord(ch.upper())] = 30 + (no >= 6)
    for ch in "0123456789":
        table[ord(ch)] = 32
    for no, ch in enumerate("+/_=.-:\"'@(), "):
        table[ord(ch)] = 33 + no
    table[256] = 2
    return table


_CLASSES = _class_table()
N_CLASSES = 33 + 15


def windows(start: int, end: int) -> list[tuple[int, int]]:
    """Stretches of at most ``BODY`` characters that cover a candidate; they overlap by half."""
    if end - start <= BODY:
        return [(start, end)]
    return [(s, s + BODY) for s in (*range(start, end - BODY, BODY // 2), end - BODY)]


def encode(text: str, start: int, end: int) -> np.ndarray:
    """Classes of a window with the text on both sides."""
    body = text[start:end]
    left, right = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    points = np.frombuffer((left + body + right).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.zeros(WIDTH, np.int64)
    at = CONTEXT - len(left)
    row[at : at + len(points)] = _CLASSES[np.minimum(points, 256)]
    return row


@dataclass
class SecretNet:
    """Embedding, one convolution, maximum over the width, one hidden and one output layer."""

    p: dict[str, np.ndarray]
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5
    recall: float = field(default=float("nan"))

    @classmethod
    def fresh(cls, seed: int = 3) -> SecretNet:
        rng = np.random.default_rng(seed)

        def draw(*shape):
            return rng.normal(0, np.sqrt(2 / shape[0]), shape).astype(np.float32)

        return cls({
            "embed": draw(N_CLASSES, EMBED) * 3,
            "conv": draw(KERNEL * (EMBED + 1), FILTERS),
            "cbias": np.zeros(FILTERS, np.float32),
            "hidden": draw(2 * FILTERS, 16),
            "hbias": np.zeros(16, np.float32),
            "out": draw(16, 1),
            "obias": np.zeros(1, np.float32),
        })

    def _patches(self, x: np.ndarray) -> np.ndarray:
        n = len(x)
        inside = np.zeros((n, WIDTH, 1), np.float32)
        inside[:, CONTEXT : CONTEXT + BODY] = 1.0
        z = np.concatenate([self.p["embed"][x] * (x > 0)[:, :, None], inside], axis=2)
        slid = np.lib.stride_tricks.sliding_window_view(z, KERNEL, axis=1)
        return slid.transpose(0, 1, 3, 2).reshape(n, WIDTH - KERNEL + 1, -1)

    def forward(self, x: np.ndarray):
        p = self.p
        patches = self._patches(x)
        conv = np.maximum(patches @ p["conv"] + p["cbias"], 0)
        # Maximum and mean over the width: which patterns occur, and how much of them.
        top = conv.argmax(1)
        pooled = np.concatenate([np.take_along_axis(conv, top[:, None], 1)[:, 0], conv.mean(1)], axis=1)
        hidden = np.maximum(pooled @ p["hidden"] + p["hbias"], 0)
        return (hidden @ p["out"] + p["obias"])[:, 0], (patches, conv, top, pooled, hidden)

    def gradient(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        score, (patches, conv, top, pooled, hidden) = self.forward(x)
        n = len(x)
        d = ((1 / (1 + np.exp(-np.clip(score, -30, 30))) - y) * weight / n).astype(np.float32)[:, None]
        g = {"out": hidden.T @ d, "obias": d.sum(0)}
        dh = (d @ p["out"].T) * (hidden > 0)
        g["hidden"], g["hbias"] = pooled.T @ dh, dh.sum(0)
        dp = dh @ p["hidden"].T
        dconv = np.repeat(dp[:, None, FILTERS:] / conv.shape[1], conv.shape[1], axis=1)
        np.add.at(dconv, (np.arange(n)[:, None], top, np.arange(FILTERS)[None]), dp[:, :FILTERS])
        dconv *= conv > 0
        g["conv"], g["cbias"] = np.einsum("nwk,nwf->kf", patches, dconv), dconv.sum((0, 1))
        dpatch = (dconv @ p["conv"].T).reshape(n, -1, KERNEL, EMBED + 1)[..., :EMBED]
        dz = np.zeros((n, WIDTH, EMBED), np.float32)
        for k in range(KERNEL):
            dz[:, k : k + dpatch.shape[1]] += dpatch[:, :, k]
        g["embed"] = np.zeros_like(p["embed"])
        np.add.at(g["embed"], x, dz * (x > 0)[:, :, None])
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 300, batch: int = 64, seed: int = 9) -> SecretNet:
        """Adam, then Platt calibration and the threshold on a fifth set aside."""
        rng = np.random.default_rng(seed)
        aside = np.arange(len(x)) % 5 == 0
        if not (y[aside] == 1).any() or not (y[~aside] == 1).any():
            aside = np.zeros(len(x), bool)
        tx, ty = x[~aside], y[~aside].astype(np.float32)
        self._descend(tx, ty, ty.mean(), (rng.integers(0, len(tx), min(batch, len(tx))) for _ in range(steps)), steps)
        cx, cy = (x[aside], y[aside]) if aside.any() else (x, y)
        return self.calibrate(self.raw(cx), cy, np.ones(len(cx), np.int64))

    def _descend(self, x, y, share: float, chosen: Iterator[np.ndarray], steps: int, done=0.0, part=1.0) -> None:
        """Steps of Adam; the rate falls from ``done`` on by ``part`` of its way to zero."""
        share = np.clip(share, 0.02, 0.98)
        weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step, at in enumerate(chosen, 1):
            rate = 0.01 * (1 - done - part * step / (steps + 1))
            for k, g in self.gradient(x[at], y[at], weight[at]).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g**2
                self.p[k] = (
                    self.p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
                ).astype(np.float32)

    def learn(self, x: np.ndarray, y: np.ndarray, share: float, no: int, batch: int = 64) -> None:
        """Round ``no``: passes over all windows, until there are enough steps."""
        rng = np.random.default_rng([9, no])
        passes = max(1, -(-STEPS // ROUNDS * batch // len(x)))
        order = np.concatenate([rng.permutation(len(x)) for _ in range(passes)])
        chosen = [order[a : a + batch] for a in range(0, len(order), batch)]
        self._descend(x, y.astype(np.float32), share, iter(chosen), len(chosen), no / ROUNDS, 1 / ROUNDS)

    def calibrate(self, raw: np.ndarray, y: np.ndarray, n: np.ndarray) -> SecretNet:
        """Platt calibration and threshold from scores that occur ``n`` times each."""
        beta, z = np.array([1.0, 0.0]), np.stack([raw, np.ones(len(raw))], axis=1)
        for _ in range(30):
            q = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
            hessian = (z * (n * q * (1 - q))[:, None]).T @ z + 1e-1 * np.eye(2)
            beta += np.clip(np.linalg.solve(hessian, z.T @ (n * (y - q)) - 1e-1 * (beta - [1.0, 0.0])), -1, 1)
        self.scale, self.shift = float(max(beta[0], 0.05)), float(beta[1])
        order = np.argsort(raw[y == 1], kind="stable")
        found, upto = self.probability(raw[y == 1])[order], np.cumsum(n[y == 1][order])
        if len(found):
            # The highest threshold that misses no more findings than the recall allows.
            at = np.searchsorted(upto, int(np.floor((1 - RECALL) * upto[-1] + 1e-9)), side="right")
            self.threshold = float(found[at])
            self.recall = float(n[y == 1][order][found >= self.threshold].sum() / upto[-1])
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Scores in whole thousandths, so that each has a count."""
        parts = [self.forward(x[a : a + AT_ONCE])[0] for a in range(0, len(x), AT_ONCE)]
        scores = np.concatenate(parts) if parts else np.empty(0)
        return np.round(np.clip(scores.astype(np.float64), -30, 30) * RAW_STEPS) / RAW_STEPS

    def probability(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * raw + self.shift, -60, 60)))


def altered_text(text: str, copy: int) -> tuple[str, list[tuple[int, int]]]:
    """The text with its base spans, and as many gaps between its words, replaced by altered
    findings and by runs that are none, in equal parts.

    Returns the new text and the keys written into it, without those that a pattern still
    covers. It depends on the text and ``copy`` alone.
    """
    rng = np.random.default_rng([zlib.crc32(text.encode("utf-8", "surrogatepass")), copy])
    words = re.findall(r"[a-z]{3,}", text)[:200] or ["none"]
    places: list[tuple[int, int]] = []
    for s, _, e in base_spans(text):
        if not places or places[-1][1] <= s:
            places.append((s, e))
    gaps = [m.start() for m in re.finditer(r"\x20", text)]
    taken = altered.Taken(places)
    chosen = {int(g) for g in rng.choice(gaps, len(places) + 1)} if gaps else set()
    places += [(g, g + 1) for g in sorted(chosen) if not taken.touches(g, g + 1)]
    spaced = [text[s:e] == " " for s, e in places]

    def drawn(no: int):
        new, key = altered.secret(rng, "") if rng.random() < 0.5 else (altered.no_secret(rng, words), None)
        if spaced[no]:
            new, key = f" {new} ", key and (key[0] + 1, key[1] + 1)
        return new, key

    new, spans = altered.rewritten(text, places, drawn)
    taken = altered.Taken([(s, e) for s, _, e in base_spans(new)])
    return new, [(s, e) for _, s, e in spans if not taken.touches(s, e)]


def labelled_candidates(texts: list[str], copies: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The windows of every candidate of ``texts`` and of altered ``copies`` of each text; the
    label is 1 if a window has at least ``_KEY_CHARS`` characters in common with the key of a
    base span (its value, where it is an assignment) or of an altered finding."""
    rows, labels = [], []
    labelled = [(text, []) for text in texts]
    labelled += [altered_text(text, c) for c in range(copies) for text in texts if base_spans(text)]
    for text, written in labelled:
        keys = [(s, e) for s, kind, e in base_spans(text) if kind] + written
        keys += [m.span(1) for m in _ASSIGN.finditer(text) if len(m[1]) >= _KEY_CHARS]
        keys = sorted((b, f) for b, f in keys if f - b >= _KEY_CHARS)
        starts, ends = [b for b, _ in keys], list(accumulate((f for _, f in keys), max))
        for span in candidates(text):
            for s, e in windows(*span):
                rows.append(encode(text, s, e))
                upto = bisect_right(starts, e - _KEY_CHARS)
                labels.append(e - s >= _KEY_CHARS and upto > 0 and ends[upto - 1] >= s + _KEY_CHARS)
    return np.array(rows, np.int64).reshape(-1, WIDTH), np.array(labels, np.int64)


def labelled_windows(docs: DataFrame) -> DataFrame:
    """``x, y, h``: the distinct labelled windows of all texts and of their altered copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text").to_pylist():
                x, y = labelled_candidates([text], ALTERED_COPIES)
                for at in range(0, len(y), SHARD):
                    rows = [r.tobytes() for r in x[at : at + SHARD].astype(np.uint8)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rows, pa.binary()), pa.array(y[at : at + SHARD], pa.int8())], ["x", "y"]
                    )

    texts = docs.select("text").filter(F.col("text").rlike("[0-9:=]")).distinct()
    found = texts.mapInArrow(run, "x binary, y byte").distinct()
    return store(found.withColumn("h", F.xxhash64("x")))


def _rows(x) -> np.ndarray:
    return np.frombuffer(b"".join(x), np.uint8).reshape(-1, WIDTH).astype(np.int64)


def _trained(windows: DataFrame, total: int, share: float) -> SecretNet:
    """Parameters after rounds over all ``windows``, in shards of about ``SHARD``.

    In a round every shard trains the same parameters on all its windows, and their means over
    the shards, summed as whole numbers, are those of the next round: neither partitions nor
    the order of tasks matter.
    """
    net, shards = SecretNet.fresh(), -(-total // SHARD)
    dealt = windows.select("x", "y", "h", F.pmod(F.xxhash64("h"), F.lit(shards)).alias("shard"))
    shapes = {k: v.shape for k, v in net.p.items()}

    def round_of(no: int, p: dict[str, np.ndarray]):
        def learn(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["h", "x", "y"])
            local = SecretNet({k: v.copy() for k, v in p.items()})
            local.learn(_rows(pdf["x"]), pdf["y"].to_numpy(), share, no)
            flat = np.concatenate([local.p[k].ravel() for k in shapes]).astype(np.float64)
            return pd.DataFrame({"i": np.arange(len(flat)), "v": np.round(flat * FIXED).astype(np.int64)})

        return learn

    for no in range(ROUNDS):
        sums = dealt.groupBy("shard").applyInPandas(round_of(no, net.p), "i long, v long").groupBy("i")
        rows = sums.agg(F.sum("v").alias("v"), F.count("v").alias("n")).orderBy("i").toPandas()
        flat = rows["v"].to_numpy() / rows["n"].to_numpy() / FIXED
        ends = np.cumsum([int(np.prod(s)) for s in shapes.values()])[:-1]
        net.p = {
            k: part.reshape(shapes[k]).astype(np.float32) for k, part in zip(shapes, np.split(flat, ends))
        }
    return net


def train(docs: DataFrame) -> SecretNet | None:
    """Train on the candidates of all documents; None without both classes.

    Every distinct window counts once. A fifth of them, by hash, is set aside: calibration and
    threshold come from how often each score, in thousandths, occurs among all of those.
    """
    windows = labelled_windows(docs)
    aside = F.pmod("h", F.lit(5)) == 0
    counts = {
        (r["aside"], r["y"]): r["n"]
        for r in windows.groupBy(aside.alias("aside"), "y").agg(F.count(F.lit(1)).alias("n")).collect()
    }
    if len({y for _, y in counts}) < 2:
        return None
    if (True, 1) in counts and (False, 1) in counts:
        kept, held = windows.filter(~aside), windows.filter(aside)
        ones, zeros = counts[False, 1], counts.get((False, 0), 0)
    else:
        kept = held = windows
        ones, zeros = (sum(n for (_, y), n in counts.items() if y == k) for k in (1, 0))
    net = _trained(kept, ones + zeros, ones / (ones + zeros))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.round(net.raw(_rows(batch.column("x").to_pylist())) * RAW_STEPS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(raw), batch.column("y")], ["raw", "y"])

    held = held.select("x", "y").mapInArrow(scored, "raw long, y byte")
    found = held.groupBy("raw", "y").agg(F.count(F.lit(1)).alias("n")).orderBy("raw", "y").toPandas()
    return net.calibrate(found["raw"].to_numpy() / RAW_STEPS, found["y"].to_numpy(), found["n"].to_numpy())


def find(texts: list[str], net: SecretNet | None) -> dict:
    """Base spans of each text, and all spans with those that the network adds.

    An added span is a candidate with a window at or over the threshold that overlaps no
    base span.
    """
    base = [base_spans(t) for t in texts]
    added: list[list] = [[] for _ in texts]
    if net is not None:
        places, rows = [], []
        last: list = [None] * len(texts)

        def flush():
            if rows:
                chance = net.probability(net.raw(np.array(rows)))
                for (no, s, e), q in zip(places, chance):
                    # Windows come in order: those of one candidate follow each other.
                    if q >= net.threshold and last[no] != (s, e):
                        last[no] = (s, e)
                        added[no].append((s, 3, e))
            places.clear()
            rows.clear()

        for no, text in enumerate(texts):
            taken = altered.Taken([(s, e) for s, _, e in base[no]])
            for s, e in candidates(text):
                if taken.touches(s, e):
                    continue
                for a, z in windows(s, e):
                    places.append((no, s, e))
                    rows.append(encode(text, a, z))
                    if len(rows) == AT_ONCE:
                        flush()
        flush()
    counts = {
        f"n_{kind}": [sum(k == no for _, k, _ in b) for b in base] for no, kind in enumerate(KINDS[:3])
    }
    return counts | {
        "base_sha256": [hashlib.sha256(span_text(b).encode()).hexdigest() for b in base],
        "spans": [span_text(sorted(b + a)) for b, a in zip(base, added)],
        "n_added": [len(a) for a in added],
    }


_FOUND = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long"


def secrets(docs: DataFrame, net: SecretNet | None) -> DataFrame:
    """``doc_id`` with the base counts and hash, all spans, and the number of added ones.

    Offsets are code points, the end exclusive. Null and empty texts have no span; rows
    without an id and repeated rows are reported like any other.
    """
    found = struct_udf(lambda texts: find(texts, net), _FOUND)
    return docs.select("doc_id", found(F.col("text")).alias("f")).select("doc_id", "f.*")
