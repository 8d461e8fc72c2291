"""Main text of HTML pages by wrappers, union-free regular expressions of whole hosts.

Every page is read as nested tokens and folded into an expression of its own, with
repeated groups. Equal expressions of a host are one row, whatever the number of pages. The
distinct ones are aligned one by one in groups of about ``FAN_IN``, the outcomes again, up
to one wrapper a host: mismatching tokens become optional or repeated groups, texts become
slots. Groups are dealt by hash and sorted, so the wrapper does not depend on partitioning,
and no task holds all pages or expressions of a large host.

Slots get their sizes, their share of links and whether they are the same on all pages from
sums over all pages. From those, and the names of the elements, the main region is chosen
once a host. Pages are read a second time; each text finds its slot through the page's own
expression, joined by host and expression.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geohotspots.llm import markup
from geohotspots.llm.common import carried
from geohotspots.session import store

#: Expressions aligned by one task call, on average.
FAN_IN = 64
#: Rows of statistics that a task holds before it hands them on.
HELD_ROWS = 50_000

_STATS = (
    "host string, page_form long, leaf int, expression string, pages long, blocks long, chars long, "
    "link_chars long, low long, high long"
)


def host_of(url: Column) -> Column:
    """Lower-case host of an absolute address; empty where there is none."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.coalesce(F.lower(host), F.lit(""))


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _read(page: str | None) -> tuple[str, list[list[int]], list[str], list[int]]:
    """The page's expression, the texts of each of its slots, all texts, characters in links."""
    items, texts, linked = markup.read(page or "")
    items = markup.folded(items)
    return markup.write(items), [leaf.texts for leaf in markup.leaves(items)], texts, linked


def _statistics(pages: DataFrame) -> DataFrame:
    """Sums for each host, page expression and slot; slot -1 carries the expression."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def flush() -> pa.RecordBatch:
            rows = [[*key, *value] for key, value in held.items()]
            held.clear()
            columns = list(zip(*rows)) if rows else [()] * 10
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), *[pa.int64()] * 6]
            names = [c.split()[0] for c in _STATS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        def add(host, form, leaf, expression, blocks, chars, links, code) -> None:
            seen = held.get((host, form, leaf))
            if seen is None:
                held[host, form, leaf] = [expression, 1, blocks, chars, links, code, code]
            else:
                seen[1] += 1
                seen[2] += blocks
                seen[3] += chars
                seen[4] += links
                seen[5] = min(seen[5], code)
                seen[6] = max(seen[6], code)

        for batch in batches:
            for host, page in zip(*(column.to_pylist() for column in batch.columns)):
                expression, slots, texts, linked = _read(page)
                form = _hash(expression)
                add(host, form, -1, expression, 0, 0, 0, 0)
                for leaf, mine in enumerate(slots):
                    parts = [texts[t] for t in mine]
                    code = _hash("\n".join(parts))
                    add(host, form, leaf, None, len(parts), sum(map(len, parts)), sum(linked[t] for t in mine), code)
                if len(held) > HELD_ROWS:
                    yield flush()
        yield flush()

    rows = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(measure, _STATS)
    return rows.groupBy("host", "page_form", "leaf").agg(
        F.max("expression").alias("expression"),
        *[F.sum(c).alias(c) for c in ("pages", "blocks", "chars", "link_chars")],
        F.min("low").alias("low"),
        F.max("high").alias("high"),
    )


def _merge(expressions: list[str]) -> str:
    """All expressions aligned, in the order of their text."""
    first, *others = sorted(set(expressions))
    wrapper = markup.parse(first)
    for other in others:
        wrapper = markup.align(wrapper, markup.parse(other))
        wrapper = markup.parse(markup.write(wrapper))
    return markup.write(wrapper)


def _infer(expressions: DataFrame) -> DataFrame:
    """``host, wrapper`` from ``host, page_form, expression``."""

    def combine(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        merged = _merge(frame["expression"].tolist())
        return pd.DataFrame({"host": [key[0]], "page_form": [int(frame["page_form"].min())], "expression": [merged]}, dtype=object)

    most = expressions.groupBy("host").count().agg(F.max("count")).first()[0] or 0
    rounds = 1
    while FAN_IN**rounds < most:
        rounds += 1
    current = expressions.select("host", "page_form", "expression")
    for level in range(rounds - 1, -1, -1):
        dealt = F.pmod(F.xxhash64("page_form"), F.lit(FAN_IN**level)).alias("part")
        current = current.groupBy("host", dealt).applyInPandas(combine, "host string, page_form long, expression string")
        if level:
            current = store(current)
    return current.select("host", F.col("expression").alias("wrapper"))


def wrappers(pages: DataFrame) -> DataFrame:
    """``host, wrapper``: the expression of all pages of each host, as text.

    ``label(...)`` is an element, ``#`` a slot, ``[...]`` a group, ``+`` repetition and ``?``
    an option. Pages without a host in their address share the empty host.
    """
    return _infer(_statistics(pages).filter("leaf < 0"))


def _decisions(pages: DataFrame) -> DataFrame:
    """``host, page_form, kept``: for each slot of a page expression, whether it is main text."""
    stats = store(_statistics(pages))
    forms = stats.filter("leaf < 0").select("host", "page_form", "expression")
    wrapper = store(_infer(forms))

    def place(expression: pd.Series, wrapper: pd.Series) -> pd.Series:
        return pd.Series([markup.places(e, w) for e, w in zip(expression, wrapper)], dtype=object)

    place.__annotations__ = {"expression": pd.Series, "wrapper": pd.Series, "return": pd.Series}
    placed = store(
        forms.join(wrapper, "host").select(
            "host", "page_form", F.pandas_udf(place, "array<int>")("expression", "wrapper").alias("slots")
        )
    )
    slots = placed.select("host", "page_form", F.posexplode("slots").alias("leaf", "slot")).filter("slot >= 0")
    sums = (
        stats.join(slots, ["host", "page_form", "leaf"])
        .groupBy("host", "slot")
        .agg(
            *[F.sum(c).alias(c) for c in ("pages", "chars", "link_chars")],
            (F.sum("pages") > 1).alias("shared"),
            (F.min("low") == F.max("high")).alias("same"),
        )
    )
    listed = sums.groupBy("host").agg(
        F.array_sort(F.collect_list(F.struct("slot", "chars", "link_chars", F.expr("shared and same").alias("fixed")))).alias("sums")
    )

    def choose(wrapper: pd.Series, sums: pd.Series, slots: pd.Series) -> pd.Series:
        return pd.Series([_main_slots(*row) for row in zip(wrapper, sums, slots)], dtype=object)

    choose.__annotations__ = dict.fromkeys(["wrapper", "sums", "slots", "return"], pd.Series)
    chosen = placed.join(wrapper.join(listed, "host", "left"), "host")
    kept = F.pandas_udf(choose, "array<boolean>")("wrapper", "sums", "slots").alias("kept")
    return store(chosen.select("host", "page_form", kept))


def _main_slots(expression: str, sums, slots) -> list[bool]:
    """For each slot of a page expression: does the wrapper's main region hold it?

    A host may have pages of several layouts. Where a page has text, but none of it in the
    region of the whole host, the region is chosen among the texts that it has.
    """
    n = len(markup.leaves(markup.parse(expression)))
    chars, links, fixed = [0] * n, [0] * n, [False] * n
    for row in sums if sums is not None else ():
        chars[row["slot"]], links[row["slot"]], fixed[row["slot"]] = row["chars"], row["link_chars"], row["fixed"]
    main = markup.main_texts(expression, chars, links, fixed)
    mine = {s for s in slots if s >= 0}
    if not any(main[s] for s in mine):
        own = [c if s in mine else 0 for s, c in enumerate(chars)]
        main = markup.main_texts(expression, own, links, fixed)
    return [bool(s >= 0 and main[s]) for s in slots]


def extract(pages: DataFrame) -> DataFrame:
    """``row`` (all columns of ``pages``) and ``text``, the main text, of each page.

    Blocks stand in page order, one a line; character references are decoded, white space
    inside a block is one space. Null and empty pages, and pages without text, have an
    empty text. Pages with a null address, or one without host, share the empty host.
    Repeated pages come back as often as they are there; names of other columns cannot
    clash; an empty table gives an empty one.
    """
    decisions = _decisions(pages)

    def blocks(column: pd.Series) -> pd.DataFrame:
        out = {"page_form": [], "leaves": [], "blocks": []}
        for page in column.tolist():
            expression, slots, texts, _ = _read(page)
            owner = [0] * len(texts)
            for leaf, mine in enumerate(slots):
                for t in mine:
                    owner[t] = leaf
            out["page_form"].append(_hash(expression))
            out["leaves"].append(owner)
            out["blocks"].append(texts)
        return pd.DataFrame(out, dtype=object)

    udf = F.pandas_udf(blocks, "page_form long, leaves array<int>, blocks array<string>").asNondeterministic()
    read = carried(pages, {"host": host_of(F.col("url")), "read": udf("html")})
    read = read.select("row", "host", "read.page_form", "read.leaves", "read.blocks")
    joined = read.join(decisions, ["host", "page_form"], "left")
    main = F.filter("blocks", lambda b, i: F.coalesce(F.get(F.col("kept"), F.get(F.col("leaves"), i)), F.lit(False)))
    return joined.select("row", F.array_join(main, "\n").alias("text"))


def page_texts(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of each page; odd rows as in :func:`extract`."""
    found = extract(pages.select("page_id", "url", "html"))
    return found.select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))
