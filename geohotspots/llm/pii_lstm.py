"""Personal data: patterns, and a character-level bidirectional LSTM with a CRF on top.

The patterns give the base spans, which always stay. The network is trained in numpy on the
training texts, once as they are with base spans as labels, and with findings altered so that
no pattern covers them (see ``altered``) as labels; it adds spans where it reads one that the
patterns do not. Every span of the four kinds has a digit, an @ or a bracketed at, so a stretch
of text without one near is outside all spans by definition; the stretches around such
characters are read in overlapping windows, each character takes its scores from the window
that sees most around it, and one decoding over the whole stretch reconciles them. What the
network adds must have the numbers of its kind (:func:`plausible`).
"""

from __future__ import annotations

import hashlib
import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geohotspots.llm import altered
from geohotspots.llm.common import found_sample, struct_udf

KINDS = ("email", "ip", "card", "phone")
#: Documents with a base span that the network is trained on, the first in a hash order.
TRAINING_DOCS = 500
WINDOW, STEP, AROUND = 96, 48, 24
HIDDEN, EMBED = 16, 12
#: Windows that go through the network together.
WINDOWS_AT_ONCE = 512
#: Training steps of 64 windows.
STEPS = 300

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_AT = r"[\[(]\x20?(?:at|AT)\x20?[\])]"
_ANCHOR = re.compile(rf"[0-9@]+|{_AT}")
_ADDRESS = re.compile(rf"(?:@|{_AT}).*(?:[.,]|dot|DOT)", re.DOTALL)
_NUMBER = re.compile(r"[0-9]+")
#: Altered copies of a training text.
ALTERED_COPIES = 3
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        total += v if i % 2 == 0 else 2 * v - 9 * (v > 4)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each @ so that a long run of letters
    is read once."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
            free = domain.end()
        else:
            free = at + 1
        at = text.find("@", free)
    return out


def _octets(match: re.Match) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p[-9:]) <= 255 for p in match[0].split("."))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind number, start, end)`` in code points, by kind and start."""
    if not _ANCHOR.search(text):
        return []
    out = [(0, s, e) for s, e in _emails(text)]
    out += [(1, *m.span()) for m in _IP.finditer(text) if _octets(m)]
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def span_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def plausible(kind: int, value: str) -> bool:
    """Whether a span that the network reads has the parts of its kind: a sign for at and one
    for a dot; four numbers up to 255; 13 to 19 digits that pass Luhn; 9 to 15 digits. A letter
    O counts as 0."""
    if kind == 0:
        return bool(_ADDRESS.search(value))
    if kind == 1:
        parts = [p.lstrip("0") for p in _NUMBER.findall(value)]
        return len(parts) == 4 and all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)
    found = _digits(value.replace("O", "0").replace("o", "0"))
    if kind == 2:
        return 13 <= len(found) <= 19 and luhn(found)
    return 9 <= len(found) <= 15


def _class_table() -> np.ndarray:
    """Character class of every code point below 256; the rest is class 1 or 2."""
    table = np.full(257, 1, np.int64)
    for c in range(256):
        ch = chr(c)
        table[c] = 2 if ch.isalpha() else 3 if ch.isspace() else 1
    for no, ch in enumerate("abcdefghijklmnopqrstuvwxyz"):
        table[ord(ch)] = 4 + no
        table[ord(ch.upper())] = 30
    for ch in "0123456789":
        table[ord(ch)] = 31
    for no, ch in enumerate("@.-_+() %,:;\n/"):
        table[ord(ch)] = 32 + no
    table[256] = 2
    return table


_CLASSES = _class_table()
#: Class 0 is padding.
N_CLASSES = 32 + 14
#: Tag 0 is outside; 1 + 2k begins kind k, 2 + 2k goes on with it.
N_TAGS = 1 + 2 * len(KINDS)
_ALLOWED = np.ones((N_TAGS, N_TAGS), bool)
for _k in range(len(KINDS)):
    _ALLOWED[:, 2 + 2 * _k] = False
    _ALLOWED[[1 + 2 * _k, 2 + 2 * _k], 2 + 2 * _k] = True
_FORBIDDEN = np.where(_ALLOWED, 0.0, -1e4)


def char_classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _CLASSES[np.minimum(points, 256)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


@dataclass
class Tagger:
    """Network weights. All arrays are small, so the model travels with the tasks."""

    p: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, seed: int = 5) -> Tagger:
        rng = np.random.default_rng(seed)

        def draw(*shape):
            return rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)

        p = {"embed": draw(N_CLASSES, EMBED) * 2}
        for side in "fb":
            p["w" + side] = draw(EMBED, 4 * HIDDEN)
            p["u" + side] = draw(HIDDEN, 4 * HIDDEN)
            p["c" + side] = np.zeros(4 * HIDDEN, np.float32)
            p["c" + side][HIDDEN : 2 * HIDDEN] = 1.0
        p["out"] = draw(2 * HIDDEN, N_TAGS)
        p["bias"] = np.zeros(N_TAGS, np.float32)
        p["trans"] = np.zeros((N_TAGS, N_TAGS), np.float32)
        return cls(p)

    def _direction(self, side: str, x: np.ndarray, keep: bool):
        """Hidden states in reading order of ``side``; ``x`` is (time, window) classes."""
        gates = (self.p["embed"] @ self.p["w" + side] + self.p["c" + side])[x]
        u = self.p["u" + side]
        steps, n, _ = gates.shape
        h = np.zeros((n, HIDDEN), np.float32)
        c = np.zeros_like(h)
        out = np.empty((steps, n, HIDDEN), np.float32)
        saved = []
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            z = gates[t] + h @ u
            s = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            if keep:
                saved.append((t, h, c, i, f, o, g))
            c = f * c + i * g
            h = o * np.tanh(c)
            out[t] = h
        return out, saved

    def emissions(self, windows: np.ndarray) -> np.ndarray:
        """Tag scores (window, time, tag)."""
        x = windows.T
        both = np.concatenate([self._direction(s, x, False)[0] for s in "fb"], axis=2)
        return (both @ self.p["out"] + self.p["bias"]).transpose(1, 0, 2)

    def loss(self, windows: np.ndarray, tags: np.ndarray):
        """Mean negative log likelihood of the tags, and its gradient."""
        x, y, p = windows.T, tags.T, self.p
        steps, n = x.shape
        sides = {s: self._direction(s, x, True) for s in "fb"}
        both = np.concatenate([sides["f"][0], sides["b"][0]], axis=2)
        emit = both @ p["out"] + p["bias"]
        trans = p["trans"] + _FORBIDDEN
        alpha, beta = np.empty_like(emit), np.zeros_like(emit)
        alpha[0] = emit[0]
        for t in range(1, steps):
            alpha[t] = emit[t] + np.logaddexp.reduce(alpha[t - 1][:, :, None] + trans, axis=1)
        for t in range(steps - 2, -1, -1):
            beta[t] = np.logaddexp.reduce(trans + (emit[t + 1] + beta[t + 1])[:, None, :], axis=2)
        total = np.logaddexp.reduce(alpha[-1], axis=1)
        rows = np.arange(n)
        gold = emit[np.arange(steps)[:, None], rows, y].sum(0) + trans[y[:-1], y[1:]].sum(0)
        d_emit = np.exp(alpha + beta - total[:, None])
        d_emit[np.arange(steps)[:, None], rows, y] -= 1
        d_emit = (d_emit / n).astype(np.float32)
        moves = np.zeros((N_TAGS, N_TAGS))
        for t in range(steps - 1):
            moves += np.exp(
                alpha[t][:, :, None] + trans + (emit[t + 1] + beta[t + 1])[:, None, :] - total[:, None, None]
            ).sum(0)
        np.add.at(moves, (y[:-1], y[1:]), -1)
        grad = {k: np.zeros_like(v) for k, v in p.items()}
        grad["trans"] = (moves / n).astype(np.float32)
        grad["out"] = np.einsum("tnh,tno->ho", both, d_emit)
        grad["bias"] = d_emit.sum((0, 1))
        d_both = d_emit @ p["out"].T
        embedded = p["embed"][x]
        for no, side in enumerate("fb"):
            d_out = d_both[:, :, no * HIDDEN : (no + 1) * HIDDEN]
            dh = np.zeros((n, HIDDEN), np.float32)
            dc = np.zeros_like(dh)
            for t, h0, c0, i, f, o, g in reversed(sides[side][1]):
                c1 = np.tanh(f * c0 + i * g)
                dh = dh + d_out[t]
                dc = dc + dh * o * (1 - c1**2)
                dz = np.concatenate(
                    [dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * c1 * o * (1 - o), dc * i * (1 - g**2)],
                    axis=1,
                )
                grad["u" + side] += h0.T @ dz
                grad["w" + side] += embedded[t].T @ dz
                grad["c" + side] += dz.sum(0)
                np.add.at(grad["embed"], x[t], dz @ p["w" + side].T)
                dh, dc = dz @ p["u" + side].T, dc * f
        return float((total - gold).mean()), grad

    def train(self, windows: np.ndarray, tags: np.ndarray, steps: int = 220, batch: int = 64, seed: int = 7):
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, steps + 1):
            chosen = rng.integers(0, len(windows), min(batch, len(windows)))
            _, grad = self.loss(windows[chosen], tags[chosen])
            norm = np.sqrt(sum(float((g**2).sum()) for g in grad.values()))
            rate = 0.02 * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, g in grad.items():
                g = g * min(1.0, 5.0 / (norm + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g**2
                change = rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
                self.p[k] = (self.p[k] - change).astype(np.float32)
        return self

    def decode(self, emits: list[np.ndarray]) -> list[np.ndarray]:
        """Best tags of each stretch; stretches are padded to the longest of their group."""
        out: list = [None] * len(emits)
        order = sorted(range(len(emits)), key=lambda i: len(emits[i]))
        trans = self.p["trans"] + _FORBIDDEN
        while order:
            group = order[:WINDOWS_AT_ONCE]
            while len(group) > 1 and len(emits[group[-1]]) * len(group) > 400_000:
                group = group[: len(group) // 2]
            order = order[len(group) :]
            lengths = np.array([len(emits[i]) for i in group])
            width = lengths.max()
            e = np.zeros((width, len(group), N_TAGS), np.float32)
            for row, i in enumerate(group):
                e[: lengths[row], row] = emits[i]
            back = np.zeros((width, len(group), N_TAGS), np.int8)
            best = e[0].copy()
            best[:, 2::2] -= 1e4
            last = best.copy()
            for t in range(1, width):
                reach = best[:, :, None] + trans
                back[t] = reach.argmax(1)
                best = e[t] + reach.max(1)
                last = np.where((t < lengths)[:, None], best, last)
            tags = np.zeros((width, len(group)), np.int8)
            now = last.argmax(1)
            rows = np.arange(len(group))
            for t in range(width - 1, -1, -1):
                live = t < lengths
                tags[t] = np.where(live, now, 0)
                now = np.where(live, back[t, rows, now], now)
            for row, i in enumerate(group):
                out[i] = tags[: lengths[row], row]
        return out

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """Spans ``(kind, start, end)`` that the network reads in each text."""
        stretches = [(no, a, b) for no, text in enumerate(texts) for a, b in stretches_of(text)]
        out: list[list] = [[] for _ in texts]
        for at in range(0, len(stretches), 2000):
            part = stretches[at : at + 2000]
            emits = self._stretch_emissions(texts, part)
            for (no, a, _), tags in zip(part, self.decode(emits)):
                out[no] += [(k, a + s, a + e) for k, s, e in tag_spans(tags)]
        return out

    def _stretch_emissions(self, texts, stretches) -> list[np.ndarray]:
        places, rows = [], []
        emits = [np.zeros((b - a, N_TAGS), np.float32) for _, a, b in stretches]

        def flush():
            if not rows:
                return
            scores = self.emissions(np.array(rows))
            for (i, at, low, high), s in zip(places, scores):
                emits[i][low:high] = s[low - at : high - at]
            places.clear()
            rows.clear()

        for i, (no, a, b) in enumerate(stretches):
            classes = char_classes(texts[no][a:b])
            for at, low, high in window_plan(b - a):
                row = np.zeros(WINDOW, np.int64)
                part = classes[at : at + WINDOW]
                row[: len(part)] = part
                rows.append(row)
                places.append((i, at, low, high))
                if len(rows) == WINDOWS_AT_ONCE:
                    flush()
        flush()
        return emits


def window_plan(length: int):
    """``(start, from, to)``: windows over a stretch and the characters each decides, those
    that are nearer to its middle than to any other window's."""
    starts = [0]
    while starts[-1] + WINDOW < length:
        starts.append(starts[-1] + STEP)
    inner = (WINDOW - STEP) // 2
    for no, at in enumerate(starts):
        low = 0 if no == 0 else at + inner
        high = length if no == len(starts) - 1 else at + STEP + inner
        yield at, low, high


def stretches_of(text: str) -> list[tuple[int, int]]:
    """Parts of the text within ``AROUND`` characters of a digit, @ or bracketed at, merged."""
    out: list[list[int]] = []
    for m in _ANCHOR.finditer(text):
        a, b = max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def tag_spans(tags: np.ndarray) -> list[tuple[int, int, int]]:
    out: list[list[int]] = []
    for t, tag in enumerate(tags.tolist()):
        if tag == 0:
            continue
        kind = (tag - 1) // 2
        if tag % 2 == 1 or not out or out[-1][2] != t or out[-1][0] != kind:
            out.append([kind, t, t + 1])
        else:
            out[-1][2] = t + 1
    return [tuple(x) for x in out]


def altered_text(text: str, copy: int) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with its base spans replaced by altered findings and by plain numbers.

    Each place gets a finding of any kind (an address only where the text has one) or, one time
    in four, a number that is none. Returns the new text and the spans written into it, without
    those that a pattern still covers in part. It depends on the text and ``copy`` alone.
    """
    rng = np.random.default_rng([zlib.crc32(text.encode("utf-8", "surrogatepass")), copy])
    base = sorted((s, e) for _, s, e in base_spans(text))
    places = [p for p, before in zip(base, [(0, 0), *base]) if before[1] <= p[0]]
    addresses = [text[s:e] for k, s, e in base_spans(text) if k == 0]
    kinds = range(0 if addresses else 1, len(KINDS))
    drawn_kinds = [altered.one_of(rng, kinds) for _ in places]

    def drawn(no: int):
        if rng.random() < 0.25:
            return altered.no_person(rng), None
        kind = drawn_kinds[no]
        value = altered.PERSONAL[kind](rng, altered.one_of(rng, addresses) if kind == 0 else "")
        return value, (0, len(value))

    new, spans = altered.rewritten(text, places, drawn)
    taken = altered.Taken([(s, e) for _, s, e in base_spans(new)])
    return new, [(drawn_kinds[no], s, e) for no, s, e in spans if not taken.touches(s, e)]


def labelled_windows(texts: list[str], copies: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Windows over the stretches of ``texts`` with the tags of their base spans, and of as many
    altered ``copies`` of each text with the tags of altered and base spans."""
    rows, tags = [], []
    labelled = [(text, []) for text in texts]
    labelled += [altered_text(text, c) for c in range(copies) for text in texts if base_spans(text)]
    for text, extra in labelled:
        y = np.zeros(len(text), np.int64)
        for k, s, e in reversed(base_spans(text) + extra):
            y[s:e] = 2 + 2 * k
            y[s] = 1 + 2 * k
        for a, b in stretches_of(text):
            classes = char_classes(text[a:b])
            for at, _, _ in window_plan(b - a):
                row, tag = np.zeros(WINDOW, np.int64), np.zeros(WINDOW, np.int64)
                part = classes[at : at + WINDOW]
                row[: len(part)] = part
                tag[: len(part)] = y[a + at : a + at + len(part)]
                # A later kind that overlaps a base span leaves parts without a beginning.
                for t in range(1, WINDOW):
                    if tag[t] and tag[t] % 2 == 0 and not _ALLOWED[tag[t - 1], tag[t]]:
                        tag[t] -= 1
                rows.append(row)
                tags.append(tag)
    return np.array(rows).reshape(-1, WINDOW), np.array(tags).reshape(-1, WINDOW)


def train(docs: DataFrame, sample: int = TRAINING_DOCS) -> Tagger | None:
    """Train on at most ``sample`` documents with a base span and a quarter as many without;
    None if there is no span.

    Both are the first in the order of a hash of the text, among all texts of their sort
    with a digit or @. Only short documents may be sampled, as whole texts come to the
    driver: up to 20,000 characters.
    """
    usable = docs.select("text").filter(F.col("text").rlike("[0-9@]") & (F.length("text") <= 20_000))
    texts = found_sample(usable, base_spans, sample, sample // 4)
    windows, tags = labelled_windows(texts, ALTERED_COPIES)
    return Tagger.fresh().train(windows, tags, STEPS) if tags.any() else None


def find(texts: list[str], tagger: Tagger | None) -> dict:
    """Base spans of each text, and all spans with those that the network adds.

    An added span is plausible for its kind, has at least seven characters and overlaps no
    base span.
    """
    base = [base_spans(t) for t in texts]
    added: list[list] = [[] for _ in texts]
    if tagger is not None:
        for no, found in enumerate(tagger.spans(texts)):
            taken = altered.Taken([(s, e) for _, s, e in base[no]])
            for k, s, e in found:
                if e - s >= 7 and plausible(k, texts[no][s:e]) and not taken.touches(s, e):
                    added[no].append((k, s, e))
    counts = {f"n_{kind}": [sum(k == no for k, _, _ in b) for b in base] for no, kind in enumerate(KINDS)}
    return counts | {
        "base_sha256": [hashlib.sha256(span_text(b).encode()).hexdigest() for b in base],
        "spans": [span_text(sorted(b + a)) for b, a in zip(base, added)],
        "n_added": [len(a) for a in added],
    }


_FOUND = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def personal_data(docs: DataFrame, tagger: Tagger | None) -> DataFrame:
    """``doc_id`` with the base counts and hash, all spans, and the number of added ones.

    Offsets are code points, the end exclusive. Null and empty texts have no span; rows
    without an id and repeated rows are reported like any other.
    """
    found = struct_udf(lambda texts: find(texts, tagger), _FOUND)
    return docs.select("doc_id", found(F.col("text")).alias("f")).select("doc_id", "f.*")
