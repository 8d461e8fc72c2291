"""Quality classifier: a linear-chain conditional random field over the lines of a text.

Every line is labelled good or bad from its own features and those of the lines around it.
Forward-backward gives the probability of each label; a document's quality is the mean of
its lines' probabilities, weighted by their length, after a logistic calibration.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geohotspots.llm.common import bucket, carried, struct_udf, with_columns

#: Labelled documents that the model is fitted on, the first in the order of a hash.
TRAINING_DOCS = 2000
#: Longest text that may be sampled, as the sample comes to the driver.
TRAINING_CHARS = 50_000
#: A training chain; longer documents give several. Scoring has no such limit.
CHAIN = 16
#: Documents scored together; their chains are padded to the longest of them.
CHAINS_AT_ONCE = 512
THRESHOLD = 0.3

_SYMBOLS, _DIGITS, _MARKS = "#*$%&|<>", "0123456789", "!?"
FEATURES = (
    "log_chars log_words upper symbols digits marks word_length repeats distinct copied "
    "blank ended"
).split()
F_N = len(FEATURES)


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features of each line (split at line feeds) and the lines' lengths in characters."""
    lines = text.split("\n")
    seen: dict[str, int] = {}
    for line in lines:
        seen[line] = seen.get(line, 0) + 1
    rows, lengths = [], []
    for line in lines:
        words = line.split()
        n, k = len(line), len(words)
        lengths.append(n)
        if not k:
            rows.append((0.0,) * (F_N - 2) + (1.0, 0.0))
            continue
        rows.append((
            np.log1p(n),
            np.log1p(k),
            sum(map(str.isupper, words)) / k,
            sum(map(line.count, _SYMBOLS)) / k,
            sum(map(line.count, _DIGITS)) / n,
            sum(map(line.count, _MARKS)) / k,
            (n - k + 1) / k,
            sum(map(str.__eq__, words, words[1:])) / k,
            len(set(words)) / k,
            1.0 if seen[line] > 1 else 0.0,
            0.0,
            1.0 if line.rstrip()[-1:] in ".!?" else 0.0,
        ))
    return np.array(rows), np.array(lengths, float)


def _around(x: np.ndarray) -> np.ndarray:
    """A line's features with those of the line before and after, and a constant."""
    edge = np.zeros((1, x.shape[1]))
    return np.hstack([x, np.vstack([edge, x[:-1]]), np.vstack([x[1:], edge]), np.ones((len(x), 1))])


def _log_add(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def forward_backward(emit: np.ndarray, lengths: np.ndarray, trans: np.ndarray):
    """Marginals ``(chain, line, 2)``, transition expectations and log partitions.

    ``emit`` is padded to the longest chain; lines beyond a chain's length do not count.
    """
    n, width, _ = emit.shape
    forward, backward = np.zeros_like(emit), np.zeros_like(emit)
    forward[:, 0] = emit[:, 0]
    for t in range(1, width):
        step = emit[:, t] + _log_add(forward[:, t - 1, :, None] + trans, 1)
        forward[:, t] = np.where((t < lengths)[:, None], step, forward[:, t - 1])
    for t in range(width - 2, -1, -1):
        step = _log_add(trans + (emit[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
        backward[:, t] = np.where((t + 1 < lengths)[:, None], step, 0.0)
    total = _log_add(forward[:, -1], 1)
    marginal = np.exp(forward + backward - total[:, None, None])
    moves = np.exp(
        forward[:, :-1, :, None]
        + trans
        + (emit[:, 1:] + backward[:, 1:])[:, :, None, :]
        - total[:, None, None, None]
    )
    moves *= (np.arange(1, width) < lengths[:, None])[:, :, None, None]
    return marginal, moves, total


@dataclass
class LineCrf:
    """Fitted weights; small enough to travel with every task."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    trans: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def emissions(self, x: np.ndarray) -> np.ndarray:
        score = _around((x - self.mean) / self.scale) @ self.weights
        return np.stack([np.zeros(len(x)), score], axis=1)

    def shares(self, texts: list[str]) -> np.ndarray:
        """Length-weighted mean probability of good lines, before calibration."""
        out = np.empty(len(texts))
        order = sorted(range(len(texts)), key=lambda i: texts[i].count("\n"))
        at = 0
        while at < len(order):
            chosen, size = [], 0
            while at < len(order) and len(chosen) < CHAINS_AT_ONCE:
                size = max(size, texts[order[at]].count("\n") + 1)
                if chosen and size * (len(chosen) + 1) > 100_000:
                    break
                chosen.append(order[at])
                at += 1
            parts = [line_features(texts[i]) for i in chosen]
            emit, lengths = _padded([self.emissions(x) for x, _ in parts])
            marginal, _, _ = forward_backward(emit, lengths, self.trans)
            for i, m, (_, chars) in zip(chosen, marginal, parts):
                weight = chars + 1e-9
                out[i] = (m[: len(chars), 1] * weight).sum() / weight.sum()
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        share = np.clip(self.shares(texts), 1e-6, 1 - 1e-6)
        z = self.slope * np.log(share / (1 - share)) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _padded(chains: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(c) for c in chains])
    out = np.zeros((len(chains), lengths.max(), chains[0].shape[1]))
    for row, chain in zip(out, chains):
        row[: len(chain)] = chain
    return out, lengths


def fit(texts: list[str], labels: list[int], steps: int = 80, decay: float = 1e-3) -> LineCrf:
    """Maximum conditional likelihood with Adam; every line takes its document's label."""
    if len(set(labels)) < 2:
        raise ValueError("the labelled documents must have both classes")
    chains, truth = [], []
    for text, label in zip(texts, labels):
        x, _ = line_features(text)
        for at in range(0, len(x), CHAIN):
            chains.append(x[at : at + CHAIN])
            truth.append(label)
    every = np.vstack(chains)
    model = LineCrf(every.mean(0), every.std(0) + 1e-3, np.zeros(3 * F_N + 1), np.zeros((2, 2)))
    x, lengths = _padded([_around((c - model.mean) / model.scale) for c in chains])
    y = np.array(truth)
    real = np.arange(x.shape[1]) < lengths[:, None]
    gold = np.where(y[:, None] == 1, real, False)
    gold_moves = np.zeros((2, 2))
    for label in (0, 1):
        gold_moves[label, label] = (lengths[y == label] - 1).sum()
    flat = np.concatenate([model.weights, model.trans.ravel()])
    first, second = np.zeros_like(flat), np.zeros_like(flat)
    for step in range(1, steps + 1):
        w, trans = flat[: 3 * F_N + 1], flat[3 * F_N + 1 :].reshape(2, 2)
        emit = np.stack([np.zeros(real.shape), x @ w], axis=2)
        marginal, moves, _ = forward_backward(emit, lengths, trans)
        off = np.where(real, gold - marginal[:, :, 1], 0.0)
        grad = np.concatenate([
            np.einsum("nl,nlf->f", off, x), (gold_moves - moves.sum((0, 1))).ravel()
        ]) / len(chains) - decay * flat
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad**2
        flat = flat + 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    model.weights, model.trans = flat[: 3 * F_N + 1], flat[3 * F_N + 1 :].reshape(2, 2)
    model.slope, model.shift = _calibrate(model.shares(texts), np.array(labels, float))
    return model


def _calibrate(share: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression of the label on the log odds, by damped Newton steps."""
    share = np.clip(share, 1e-6, 1 - 1e-6)
    z = np.stack([np.log(share / (1 - share)), np.ones(len(y))], axis=1)
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        hessian = (z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2)
        beta += np.clip(np.linalg.solve(hessian, z.T @ (y - p) - 1e-2 * (beta - [1.0, 0.0])), -1, 1)
    return float(max(beta[0], 0.05)), float(beta[1])


@dataclass
class Constant:
    """Stands in where there is nothing to learn from: one score for every text."""

    value: float

    def score(self, texts: list[str]) -> np.ndarray:
        return np.full(len(texts), self.value)


def train(docs: DataFrame, labels: DataFrame, sample: int = TRAINING_DOCS) -> LineCrf | Constant:
    """Fit on at most ``sample`` labelled documents outside the held-out fold, of at most
    ``TRAINING_CHARS`` characters each.

    The sample is the first in the order of a hash of the id, so it does not depend on
    partitioning. Labels other than 0 and 1 and labels without a document are left out.
    With labels of one class every score is that class; with none, 1: nothing is rejected.
    """
    chosen = (
        labels.filter(F.col("quality").isin(0, 1) & (bucket(F.col("doc_id"), 5) != 0))
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    # The sample has a fixed bound, so it may be broadcast.
    rows = (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .filter(F.length("text") <= TRAINING_CHARS)
        .join(F.broadcast(chosen), "doc_id")
        .select(F.col("quality").cast("int").alias("quality"), "text", "doc_id")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "text")
        .limit(sample)
        .toPandas()
    )
    truth = rows["quality"].tolist()
    if len(set(truth)) < 2:
        return Constant(float(truth[0]) if truth else 1.0)
    return fit(rows["text"].tolist(), truth)


def score(docs: DataFrame, model: LineCrf | Constant) -> DataFrame:
    """Add ``held_out``, ``score`` and ``predicted``; such columns of ``docs`` are replaced.

    Null texts count as empty. An empty text is one blank line and gets the score the model
    gives it, between 0 and 1. Rows without an id are not held out.
    """
    scored = struct_udf(lambda texts: {"score": model.score(texts)}, "score double")
    out = with_columns(docs, {"score": scored(F.col("text"))["score"]})
    return with_columns(
        out,
        {
            "held_out": F.coalesce(bucket(F.col("doc_id"), 5) == 0, F.lit(False)),
            "predicted": (F.col("score") >= THRESHOLD).cast("int"),
        },
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that a model fitted on ``labels`` does not reject."""
    model = train(docs, labels)
    scored = struct_udf(lambda texts: {"score": model.score(texts)}, "score double")
    rows = carried(docs, {"score": scored(F.col("text"))["score"]})
    return rows.filter(F.col("score") >= THRESHOLD).select("row.*")
