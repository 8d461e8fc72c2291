"""Pages as nested block elements with texts, and union-free regular expressions over them.

A page is read into :class:`Item` trees: elements with a label, and texts. Inline and
unknown tags are part of the text around them, missing end tags are implied, and scripts, styles, comments
and the head are left out. :func:`fold` turns neighbouring alike items into repeated groups
and :func:`align` lays two sequences over each other, making items that only one of them
has optional. Both only ever add repetition and options, never alternatives, so the outcome
is a union-free regular expression; texts keep the list of what was matched into them.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from functools import lru_cache

#: Items of one sequence. Longer ones become one repeated group of optional labels.
MAX_ITEMS = 48
#: So do sequences in which a label stands more often, apart from containers without a name.
MAX_SAME = 3
#: Neighbouring groups of up to this many items are compared for repetition.
MAX_GROUP = 4
#: Elements below this depth are not nested further; their texts belong to the last level.
MAX_DEPTH = 60

# Names of the HTML standard, and words that pages use for classes and roles.
_BREAKS = frozenset("br hr img input meta link area base col embed source track param".split())
_UNREAD = frozenset("script style head title template noscript iframe object svg canvas audio video math".split())
_RAW = frozenset("script style title iframe noscript textarea xmp".split())
_NOISE_TAGS = frozenset("nav footer aside form menu dialog button select textarea datalist fieldset".split())
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup html li main menu nav ol optgroup option p pre "
    "section select summary table tbody td tfoot th thead tr ul button textarea datalist caption".split()
)
_NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsbygoogle alert alertdialog aside banner "
    "breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie "
    "cookies dialog disqus feedback footer form login menu menubar modal nav navbar navigation "
    "newsletter notice notices notification pager pagination paywall popup promo promos promoted "
    "promotion recommendations recommended related replies reply respond search share sharing sidebar "
    "sidebars signup social sponsor sponsored sponsors subscribe subscription toolbar widget "
    "widgets".split()
)
_HEAD_WORDS = frozenset("header masthead topbar".split())
_TEXT_WORDS = frozenset("article articlebody body content entry main post story text".split())
#: Behind these a word says what the page has elsewhere, as in ``with-sidebar``.
_ABOUT = frozenset("has is with without no".split())
#: An open element that ends where one of these starts.
_ENDS = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]),
    "tbody": frozenset(["tr", "td", "th", "thead"]), "tfoot": frozenset(["tr", "td", "th", "tbody"]),
    "option": frozenset(["option"]),
}
#: Elements that an implied end never crosses.
_FENCES = frozenset("ul ol dl table select body html article section div main".split())
_WHOLE_TEXT = frozenset("p li h1 h2 h3 h4 h5 h6 td th dt dd blockquote pre figcaption caption summary".split())

_TOKEN = re.compile(
    r"<!--(?:-?>|.*?-->|.*)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^<>])*+)>|<[!?/][^>]*>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([A-Za-z:-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in _RAW}


class Item:
    """An element (``e``), a text (``#``) or a group of items (``g``)."""

    __slots__ = ("kind", "label", "seq", "texts", "plus", "opt")

    def __init__(self, kind, label="", seq=(), texts=None, plus=False, opt=False):
        self.kind, self.label, self.plus, self.opt = kind, label, plus, opt
        self.seq = list(seq)
        self.texts = texts if texts is not None else []


@lru_cache(50_000)
def label_of(tag: str, attributes: str) -> str:
    """``tag``, a mark and up to two names: ``N`` noise by tag, ``n`` by name, ``h`` page
    header, ``a`` article or main, ``c`` named after its text, ``-`` none of them."""
    values = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)}
    names = []
    for key in ("id", "class", "role", "itemprop"):
        for name in values.get(key, "").split():
            words = [w.lower() for w in _WORD.findall(name)]
            names.append([w for i, w in enumerate(words) if not (i and words[i - 1] in _ABOUT) and w not in _ABOUT])
    words = [w for name in names for w in name]
    style = values.get("style", "").replace(" ", "").lower()
    if tag in _NOISE_TAGS:
        mark = "N"
    elif tag in ("html", "body"):
        mark = "-"
    elif _NOISE_WORDS.intersection(words) or "hidden" in values or "display:none" in style or values.get("aria-hidden") == "true":
        mark = "n"
    elif tag == "header" or _HEAD_WORDS.intersection(words):
        mark = "h"
    elif tag in ("article", "main") or values.get("role") in ("main", "article"):
        mark = "a"
    elif _TEXT_WORDS.intersection(words):
        mark = "c"
    else:
        mark = "-"
    known = tag if tag in _BLOCKS else "x"
    return ".".join([known + "/" + mark, *sorted({w for w in words if len(w) > 1})[:2]])


def read(page: str) -> tuple[list[Item], list[str], list[int]]:
    """Top items of the page, its texts in page order and how much of each is in links."""
    root: list[Item] = []
    texts: list[str] = []
    linked: list[int] = []
    stack: list[tuple[str, Item]] = []
    open_tags: Counter = Counter()
    run: list[str] = []
    marks = [0, 0]  # open links, characters in links of the current run

    def put(item: Item) -> None:
        (stack[-1][1].seq if stack else root).append(item)

    def end_run() -> None:
        text = " ".join("".join(run).split())
        if text:
            put(Item("#", texts=[len(texts)]))
            texts.append(text)
            linked.append(min(marks[1], len(text)))
        run.clear()
        marks[1] = 0

    def close(tag: str) -> None:
        end_run()
        while stack:
            name, _ = stack.pop()
            open_tags[name] -= 1
            if name == tag:
                return

    def add_text(raw: str) -> None:
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            run.append(text)
            if marks[0] > 0:
                marks[1] += len(" ".join(text.split()))

    at, skipped, size = 0, 0, len(page)
    unread: list[str] = []
    for token in _TOKEN.finditer(page):
        if token.start() < skipped:
            continue
        if not unread:
            add_text(page[max(at, skipped) : token.start()])
        at = token.end()
        tag = token.group(2)
        if not tag:
            continue
        tag = tag.lower()
        ending = bool(token.group(1))
        if tag in _RAW and not ending:
            end = _RAW_END[tag].search(page, at)
            skipped = end.end() if end else size
            continue
        if tag in _UNREAD:
            if tag in _RAW:
                continue
            if ending:
                if unread and tag in unread:
                    del unread[unread.index(tag) :]
            elif not token.group(3).endswith("/"):
                unread.append(tag)
            continue
        if unread:
            if tag == "body" and not ending:
                unread.clear()
            else:
                continue
        if tag in _BREAKS:
            run.append(" ")
            continue
        if tag not in _BLOCKS:
            if tag == "a":
                marks[0] = max(marks[0] + (-1 if ending else 1), 0)
            label = "" if ending or not token.group(3) else label_of(tag, token.group(3))
            if ending and open_tags[tag]:
                close(tag)
            elif "/n" in label and len(stack) < MAX_DEPTH:
                end_run()
                element = Item("e", label)
                put(element)
                stack.append((tag, element))
                open_tags[tag] += 1
            elif not ending and open_tags[tag]:
                # A name of its own for nested tags, so that the inner end does not close the outer.
                stack.append((tag, stack[-1][1]))
                open_tags[tag] += 1
            continue
        if ending:
            if open_tags[tag]:
                close(tag)
            else:
                end_run()
            continue
        end_run()
        if open_tags["p"] and tag in _BLOCKS:
            close("p")
        ended = _ENDS.get(tag)
        if ended:
            for depth in range(len(stack) - 1, -1, -1):
                name = stack[depth][0]
                if name in ended:
                    close(name)
                    break
                if name in _FENCES:
                    break
        if len(stack) < MAX_DEPTH:
            element = Item("e", label_of(tag, token.group(3)))
            put(element)
        else:
            element = stack[-1][1]
        if not token.group(3).endswith("/") or tag in _BLOCKS:
            stack.append((tag, element))
            open_tags[tag] += 1
    if not unread:
        add_text(page[max(at, skipped) :])
    end_run()
    return root, texts, linked


def _kids(item: Item) -> set:
    found = set()
    for x in item.seq:
        if x.kind == "g":
            found |= _kids(x)
        else:
            found.add(x.label if x.kind == "e" else "#")
    return found


def alike(x: Item, y: Item) -> bool:
    """Texts, elements of one label, or groups that share half of all their labels. So must
    containers without a name, whose label says nothing."""
    if x.kind != y.kind or x.label != y.label:
        return False
    if x.kind == "#" or (x.kind == "e" and not _unnamed(x)):
        return True
    a, b = _kids(x), _kids(y)
    return not a or not b or 2 * len(a & b) >= len(a | b)


def merge(x: Item, y: Item) -> Item:
    """Both alike items as one. ``x`` is changed and returned; ``y`` must not be used again."""
    x.plus |= y.plus
    x.opt |= y.opt
    if x.kind == "#":
        x.texts.extend(y.texts)
    else:
        x.seq = align(x.seq, y.seq)
    return x


def _unnamed(item: Item) -> bool:
    return item.kind == "e" and item.label in ("div/-", "section/-")


def fold(seq: list[Item]) -> list[Item]:
    """The sequence with neighbouring alike groups as one repeated group each.

    Containers without a name hold different things as a rule; only three of them in a row
    make a repetition.
    """
    for width in range(1, MAX_GROUP + 1):
        out, i = [], 0
        while i < len(seq):
            group = seq[i : i + width]
            end = i + width
            while end + width <= len(seq) and all(map(alike, group, seq[end : end + width])):
                end += width
            times = (end - i) // width
            if times < (3 if all(map(_unnamed, group)) else 2):
                out.append(group[0])
                i += 1
                continue
            for at in range(i + width, end, width):
                group = [merge(x, y) for x, y in zip(group, seq[at : at + width])]
            i = end
            if width == 1:
                group[0].plus = True
                out.append(group[0])
            else:
                out.append(Item("g", "", group, plus=True))
        seq = out if width == 1 or len(out) == len(seq) else _absorb(out)
    if len(seq) > MAX_ITEMS or max(Counter(x.label for x in seq if x.kind == "e" and not _unnamed(x)).values(), default=0) > MAX_SAME:
        return _by_label(seq)
    return seq


def _absorb(seq: list[Item]) -> list[Item]:
    """Repeated groups with the single passes that stand right before or behind them."""
    out: list[Item] = []
    i = 0
    while i < len(seq):
        item = seq[i]
        i += 1
        if item.kind == "g":
            k = len(item.seq)
            while i + k <= len(seq) and all(map(alike, item.seq, seq[i : i + k])):
                item.seq = [merge(a, b) for a, b in zip(item.seq, seq[i : i + k])]
                i += k
            while len(out) >= k and all(map(alike, item.seq, out[-k:])):
                before = out[-k:]
                del out[-k:]
                item.seq = [merge(a, b) for a, b in zip(before, item.seq)]
        out.append(item)
    return out


def _by_label(seq: list[Item]) -> list[Item]:
    """A sequence without enough order to name it: one repeated group of optional labels."""
    flat, grouped = [], seq
    while grouped:
        flat, grouped = [], grouped
        for item in grouped:
            flat.extend(item.seq if item.kind == "g" else [item])
        grouped = flat if any(item.kind == "g" for item in flat) else []
    for coarse in (False, True):
        if coarse:
            for item in flat:
                item.label = item.label.split(".")[0]
        found: dict = {}
        for item in flat:
            key = (item.kind, item.label)
            if key in found:
                merge(found[key], item).plus = True
            else:
                found[key] = item
                item.opt = True
        flat = list(found.values())
        if len(flat) <= MAX_ITEMS:
            break
    return [Item("g", "*", flat, plus=True)]


def _grouped(seq: list[Item], other: list[Item]) -> list[Item]:
    """``seq`` with what reads as one pass of a group of ``other`` as a group, too."""
    groups = [x.seq for x in other if x.kind == "g"]
    if not groups:
        return seq
    out, i = [], 0
    while i < len(seq):
        for group in groups:
            run = seq[i : i + len(group)]
            if len(run) == len(group) and all(map(alike, group, run)):
                out.append(Item("g", "", run, plus=True))
                i += len(run)
                break
        else:
            out.append(seq[i])
            i += 1
    return out


def align(a: list[Item], b: list[Item]) -> list[Item]:
    """Both sequences as one: alike items merged, all others optional, repetition folded."""
    if len(a) == len(b) and all(map(alike, a, b)):
        return [merge(x, y) for x, y in zip(a, b)]
    if any(x.label == "*" and x.kind == "g" for x in (*a, *b)):
        return _by_label(a + b)
    a, b = _grouped(a, b), _grouped(b, a)
    n, m = len(a), len(b)
    weight = [[0] * m for _ in a]
    kids_b = [_kids(y) for y in b]
    for i, x in enumerate(a):
        kids = _kids(x)
        for j, y in enumerate(b):
            if x.kind == y.kind and x.label == y.label and alike(x, y):
                weight[i][j] = 2 + len(kids & kids_b[j])
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = max(best[i + 1][j], best[i][j + 1])
            if weight[i][j]:
                best[i][j] = max(best[i][j], weight[i][j] + best[i + 1][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and weight[i][j] and best[i][j] == weight[i][j] + best[i + 1][j + 1]:
            out.append(merge(a[i], b[j]))
            i, j = i + 1, j + 1
            continue
        if j == m or (i < n and best[i][j] == best[i + 1][j]):
            item, i = a[i], i + 1
        else:
            item, j = b[j], j + 1
        item.opt = True
        out.append(item)
    return fold(out)


def folded(seq: list[Item]) -> list[Item]:
    """All levels of a page folded, from the inside out."""
    for item in seq:
        if item.kind != "#":
            item.seq = folded(item.seq)
    return fold(seq)


def write(seq: list[Item]) -> str:
    """The regular expression as text; :func:`parse` reads it."""
    out = []
    for x in seq:
        inner = "#" if x.kind == "#" else f"{x.label}({write(x.seq)})" if x.kind == "e" else f"{x.label}[{write(x.seq)}]"
        out.append(inner + "+" * x.plus + "?" * x.opt)
    return " ".join(out)


_PART = re.compile(r"#|\*?\[|\]|\)|\+|\?| |[^#*\[\]()+? ]+\(")


def parse(text: str) -> list[Item]:
    """The items of :func:`write`; texts hold their own number, in order."""
    levels: list[list[Item]] = [[]]
    done = Item("#")
    leaves = 0
    for part in _PART.findall(text):
        if part == " ":
            continue
        if part == "+":
            done.plus = True
        elif part == "?":
            done.opt = True
        elif part in ")]":
            levels.pop()
            done = levels[-1][-1]
        else:
            done = Item("#", texts=[leaves]) if part == "#" else Item("g" if part[-1] == "[" else "e", part[:-1])
            leaves += part == "#"
            levels[-1].append(done)
            if part != "#":
                levels.append(done.seq)
    return levels[0]


def leaves(seq: list[Item]) -> list[Item]:
    """All texts in order."""
    out = []
    for x in seq:
        out.extend([x] if x.kind == "#" else leaves(x.seq))
    return out


def paths(seq: list[Item], above: str = "") -> list[str]:
    """For each text the labels around it, without names that only tell neighbours apart."""
    out = []
    for x in seq:
        if x.kind == "#":
            out.append(above)
        else:
            out.extend(paths(x.seq, above + (x.label.split(".")[0] + " " if x.kind == "e" else "")))
    return out


def places(expression: str, wrapper: str) -> list[int]:
    """For each text of ``expression``, the text of ``wrapper`` that it is aligned with.

    A wrapper whose order became too loose to align every text with still has all their
    elements: such texts go to the first text under the same elements; -1 if there is none.
    """
    ours, theirs = parse(expression), parse(wrapper)
    under: dict = {}
    for slot, path in enumerate(paths(theirs)):
        under.setdefault(path, slot)
    placed = [under.get(path, -1) for path in paths(ours)]
    for leaf in leaves(ours):
        leaf.texts = [-1 - leaf.texts[0]]
    for leaf in leaves(align(theirs, ours)):
        slot = next((t for t in leaf.texts if t >= 0), None)
        for t in leaf.texts:
            if t < 0 and slot is not None:
                placed[-1 - t] = slot
    return placed


def main_texts(wrapper: str, chars: list[int], link_chars: list[int], fixed: list[bool]) -> list[bool]:
    """Which texts of the wrapper are the main text.

    A text weighs its characters outside of links; texts that are the same on all pages
    (``fixed``) and texts in noise weigh nothing, unless nothing is left then. The region is
    the heaviest article; else the element named after its text, or without names any
    element, to which most of the weight leads down. All of the region counts but noise
    inside it.
    """
    items = parse(wrapper)
    total = len(chars)
    for use_fixed, marks in ((True, "Nnh"), (False, "Nnh"), (True, "N"), (False, "N"), (False, "")):
        weight = [0.0] * total

        def weigh(seq: list[Item], noise: bool) -> None:
            for x in seq:
                if x.kind == "#":
                    i = x.texts[0]
                    if not noise and not (use_fixed and fixed[i]):
                        weight[i] = max(chars[i] - link_chars[i], 0)
                else:
                    weigh(x.seq, noise or (x.kind == "e" and _mark(x) in marks))

        weigh(items, False)
        if sum(weight):
            break
    else:
        return [False] * total
    region = _region(items, weight, marks)
    kept = [False] * total

    def keep(seq: list[Item]) -> None:
        for x in seq:
            if x.kind == "#":
                kept[x.texts[0]] = True
            elif x.kind == "g" or _mark(x) not in marks.replace("h", ""):
                keep(x.seq)

    keep(region)
    return kept


def _mark(item: Item) -> str:
    """The mark in the label, or a space for groups, which no list of marks has."""
    return item.label.split("/", 1)[1][0] if item.kind == "e" else " "


def _region(items: list[Item], weight: list[float], marks: str) -> list[Item]:
    def mass(x: Item) -> float:
        return sum(weight[leaf.texts[0]] for leaf in leaves([x]))

    total = sum(weight)
    articles: list[Item] = []
    named: list[Item] = []

    def search(seq: list[Item]) -> None:
        for x in seq:
            if x.kind == "e" and _mark(x) in marks:
                continue
            if x.kind == "e" and _mark(x) == "a":
                articles.append(x)
            elif x.kind == "e" and _mark(x) == "c":
                named.append(x)
            search(x.seq)

    search(items)
    # Inner articles come later and win where they hold nearly all of the outer one.
    for share, candidates in ((0.25, articles), (0.5, named)):
        good = [x for x in candidates if mass(x) >= share * total]
        if good:
            best = max(map(mass, good))
            return [[x for x in good if mass(x) >= 0.9 * best][-1]]
    seq = items
    while True:
        below = [x for x in seq if x.kind != "#" and mass(x) >= 0.6 * sum(map(mass, seq))]
        if not below or (below[0].kind == "e" and (below[0].label.split("/")[0] in _WHOLE_TEXT or below[0].plus)):
            return seq
        seq = below[0].seq
