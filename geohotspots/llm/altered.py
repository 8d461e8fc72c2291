"""Findings in spellings that no pattern covers, written into texts with their offsets.

Networks that learn from the patterns' own matches can only repeat them. Here a finding of a
text is replaced by an altered one: other separators, spelled-out signs, letters for digits,
keys behind other names. Values are drawn anew, so that no value is learned by heart. What is
drawn depends on the generator alone.
"""

from __future__ import annotations

import re
import string
from bisect import bisect_right
from collections.abc import Callable, Sequence

import numpy as np

Span = tuple[int, int]

_ALNUM = string.ascii_letters + string.digits
#: Names that keys stand behind and no pattern lists.
_NAMES = (
    "auth", "pwd", "pass", "passphrase", "credential", "credentials", "bearer", "private_key",
    "client_key", "access_key", "signing_key", "session", "cookie", "license_key", "pin", "key",
)
#: Starts of issued keys.
_STARTS = ("", "", "", "ghp_", "sk-", "xoxb-", "pk_", "AIza")


def digits(rng: np.random.Generator, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def one_of(rng: np.random.Generator, values: Sequence):
    return values[int(rng.integers(len(values)))]


def luhn_number(rng: np.random.Generator, n: int) -> str:
    """``n`` digits whose last one makes the Luhn sum."""
    body = digits(rng, n - 1)
    total = 0
    for i, c in enumerate(reversed(body)):
        v = int(c) * (2 if i % 2 == 0 else 1)
        total += v - 9 * (v > 9)
    return body + str(-total % 10)


def email(rng: np.random.Generator, value: str) -> str:
    """An address like ``value``, with other digits and its signs spelled otherwise."""
    value = re.sub("[0-9]", lambda m: digits(rng, 1), value)
    local, domain = value.split("@", 1)
    return one_of(rng, (
        f"{local} @ {domain}",
        f"{local}(at){domain}",
        f"{local} [at] {domain.replace('.', ' [dot] ')}",
        f"{local}[at]{domain.replace('.', '[dot]')}",
        f"{local}@{domain.replace('.', ',')}",
    ))


def ip(rng: np.random.Generator, _: str) -> str:
    return one_of(rng, ("[.]", "(.)", " . ")).join(map(str, rng.integers(1, 256, 4)))


def card(rng: np.random.Generator, _: str) -> str:
    number = luhn_number(rng, 16)
    sign = one_of(rng, (".", "/", "_", "  ", "O"))
    if sign == "O":
        number, sign = number.replace("0", "O"), one_of(rng, (" ", "-"))
    return sign.join(number[i : i + 4] for i in range(0, 16, 4))


def phone(rng: np.random.Generator, _: str) -> str:
    area, office, line = (digits(rng, n) for n in (3, 3, 4))
    return one_of(rng, (
        f"({area}) {office}-{line}",
        f"{area}/{office}/{line}",
        f"{area}.{office}.{line}",
        f"+{digits(rng, 1)}/{area}/{office}-{line}",
        f"00{one_of(rng, '123456789')} {area} {office} {line}",
    ))


#: By number of the kind.
PERSONAL = (email, ip, card, phone)


def no_person(rng: np.random.Generator) -> str:
    """Numbers that are no personal data: dates, amounts, versions, counts, clock times."""
    return one_of(rng, (
        f"20{digits(rng, 2)}-0{one_of(rng, '123456789')}-1{digits(rng, 1)}",
        f"{digits(rng, 1)},{digits(rng, 3)},{digits(rng, 3)}",
        f"{digits(rng, 1)}.{digits(rng, 1)}.{digits(rng, 2)}",
        f"1{digits(rng, 1)}:{digits(rng, 2)}:{digits(rng, 2)}",
        digits(rng, int(rng.integers(1, 8))),
        f"@{one_of(rng, _NAMES)}",
        f"{digits(rng, 2)}/{digits(rng, 2)}/{digits(rng, 4)}",
    ))


def _drawn(rng: np.random.Generator, letters: str, n: int) -> str:
    return "".join(letters[i] for i in rng.integers(0, len(letters), n))


def secret(rng: np.random.Generator, _: str) -> tuple[str, Span]:
    """A key behind a name that no pattern lists, and where the key stands in it."""
    letters = one_of(rng, (_ALNUM, _ALNUM + "+/", string.digits + "ABCDEF", string.digits + string.ascii_lowercase))
    key = one_of(rng, _STARTS) + _drawn(rng, letters, int(rng.integers(16, 48)))
    name = one_of(rng, _NAMES)
    name = one_of(rng, (name, name.upper(), f"{name}_{_drawn(rng, string.ascii_lowercase, 3)}"))
    before = name + one_of(rng, ("=", ": ", " = '", " ", ":", '": "'))
    return before + key, (len(before), len(before) + len(key))


def no_secret(rng: np.random.Generator, words: Sequence[str]) -> str:
    """Runs of key characters that are no keys, of the text's own words: names, paths, dates."""
    a, b, c = (one_of(rng, words) for _ in range(3))
    n = digits(rng, int(rng.integers(1, 5)))
    return one_of(rng, (
        f"{a}-{b}-{c}-{n}",
        f"{a}/{b}/{c}{n}",
        f"{a}_{b}_{c}_{n}",
        f"{a}.{b}.{c}/{a}{n}",
        f"20{digits(rng, 2)}-0{digits(rng, 1)}-1{digits(rng, 1)}_{a}",
        f"{a}={b}{c}{n}",
        f"{a}: {b}{c}{a}",
        digits(rng, 12),
        "-" * 14 + n,
    ))


def rewritten(
    text: str, places: Sequence[Span], drawn: Callable[[int], tuple[str, Span | None]]
) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with every place replaced by what is drawn for its number.

    Places must not overlap. Also returns ``(number, start, end)``, offsets in the new text of
    the labelled part of each replacement that has one.
    """
    parts, spans, at, size = [], [], 0, 0
    for no, (s, e) in sorted(enumerate(places), key=lambda p: p[1]):
        new, inner = drawn(no)
        parts += [text[at:s], new]
        size += s - at
        if inner:
            spans.append((no, size + inner[0], size + inner[1]))
        size += len(new)
        at = e
    return "".join([*parts, text[at:]]), spans


class Taken:
    """Places of a text that are taken by spans, which may overlap each other."""

    def __init__(self, spans: Sequence[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s, e in sorted(spans):
            if self.ends and s <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def touches(self, start: int, end: int) -> bool:
        at = bisect_right(self.ends, start)
        return at < len(self.starts) and self.starts[at] < end
