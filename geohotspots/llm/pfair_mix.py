"""Mixing sources to target weights by Pfair scheduling.

A source's documents are cut into blocks, one block fills one slot. In the ideal mix all
sources flow at rates in the ratio of their weights, and when one ends, the others go on in
the same ratio: at virtual time v a source with weight u and b blocks has given min(u v, b)
blocks, and the slot reached is the sum over all sources, t(v). The k-th block of a source may
not start before slot floor(t(k / u)) (release) and must be placed before slot
ceil(t((k + 1) / u)) (deadline). Earliest deadline first fills the slots, and every source is
less than one block away from the ideal mix after any number of slots, however many. No row is
dropped or repeated. Everything here is DataFrame and SQL functions.

The schedule is not made in one piece. Which of the blocks that lie open at a slot t are placed
before t depends on no block that closed before the first of them was released: of those, only
the number matters, and it is known (blocks released less slots passed). So stretches of slots,
as long as the longest window between release and deadline, are scheduled apart from each
other, each one with the stretch before it as a run-up. The whole is the schedule that slot by
slot from the beginning would give.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geohotspots.llm.common import carried
from geohotspots.operators.ordering import running_sums
from geohotspots.session import store

BLOCK_ROWS = 4
#: Slots of a stretch, if no window is longer.
STRETCH = 1024
#: Weights are whole multiples of the largest one's part by this. Over t slots a source moves
#: by less than t / GRID of a block for it.
GRID = 1 << 40
#: Name that rows without a source are mixed under.
NO_SOURCE = "(none)"

_WHOLE = "decimal(18,0)"


def _weighted(sizes: DataFrame, weights: Mapping[str, float] | None, block_rows: int) -> DataFrame:
    """``src, blocks, u``: blocks and whole-number weight of each source."""
    if weights is None:
        weight = F.sqrt(F.col("n_rows").cast("double"))
        largest = sizes.agg(F.max(weight)).first()[0] or 1.0
    else:
        if not weights or any(not 0 < w < float("inf") for w in weights.values()):
            raise ValueError("weights must be positive")
        known = F.create_map(*[F.lit(x) for s, w in weights.items() for x in (s, float(w))])
        weight = F.coalesce(F.element_at(known, F.col("src")), F.lit(float(min(weights.values()))))
        largest = float(max(weights.values()))
    return sizes.select(
        "src",
        F.ceil(F.col("n_rows") / block_rows).cast(_WHOLE).alias("blocks"),
        F.greatest(F.floor(weight / largest * F.lit(float(GRID)) + 0.5), F.lit(1)).cast(_WHOLE).alias("u"),
    )


def _windows(blocks: DataFrame, sources: DataFrame) -> DataFrame:
    """``src, k, release, deadline`` of every block ``src, k, u``.

    t(v) is the blocks of all sources that end by v, and v times the weights of the others:
    two running sums over the ends of blocks and sources in the order of v.
    """
    total = sources.agg(F.coalesce(F.sum("u"), F.lit(0)).cast(_WHOLE)).first()[0]
    nothing = F.lit(0).cast(_WHOLE)
    edges = blocks.select(
        "src", "k", "u", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"), nothing.alias("b"), nothing.alias("w")
    ).withColumn("place", F.col("k") + F.col("side"))
    ends = sources.select(
        "src", F.lit(-1).cast("long").alias("k"), "u", F.lit(0).alias("side"), F.col("blocks").alias("b"),
        F.col("u").alias("w"), F.col("blocks").cast("long").alias("place"),
    )
    # Doubles order the edges. Where two of them are equal, either order gives the same t.
    v = F.col("place").cast("double") / F.col("u").cast("double")
    summed = running_sums(
        edges.unionByName(ends).withColumn("v", v),
        [F.col(c) for c in ("v", "k", "src", "side")],
        {"ended": F.col("b"), "gone": F.col("w")},
    ).filter("k >= 0")
    whole = {c: F.col(c).cast(_WHOLE) for c in ("ended", "gone", "place")}
    # t(v) is top / u.
    top = whole["ended"] * F.col("u") + whole["place"] * (F.lit(total).cast(_WHOLE) - whole["gone"]).cast(_WHOLE)
    return (
        summed.withColumn("top", top)
        .selectExpr("src", "k", "side", "top div u AS lower", "(top + u - 1) div u AS upper")
        .groupBy("src", "k")
        .agg(
            F.max(F.when(F.col("side") == 0, F.col("lower"))).alias("release"),
            F.max(F.when(F.col("side") == 1, F.col("upper"))).alias("deadline"),
        )
    )


def _placed(slots: Column, waiting: Column) -> Column:
    """Earliest deadline first: the block ``(deadline, src, k)`` that each slot gets.

    ``slots`` has an array of the blocks released in each slot. ``waiting`` older blocks, which
    come first, are given by number alone.
    """
    block = "struct<deadline:bigint,src:string,k:bigint>"
    older = F.transform(
        F.sequence(F.lit(1).cast("long"), waiting),
        lambda i: F.struct(F.lit(-1).cast("long").alias("deadline"), F.lit("").alias("src"), (-i).alias("k")),
    )
    none = F.array().cast(f"array<{block}>")
    start = F.struct(
        F.when(waiting > 0, older).otherwise(none).cast(f"array<{block}>").alias("ready"), none.alias("order")
    )

    def place(state: Column, released: Column) -> Column:
        ready = F.concat(state["ready"], released)
        first = F.array_min(ready)
        return F.struct(
            F.array_remove(ready, first).alias("ready"), F.concat(state["order"], F.array(first)).alias("order")
        )

    return F.aggregate(slots, start, place, lambda state: state["order"])


def schedule(windows: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """``src, k, slot``: the slot of every block of ``src, k, release, deadline``.

    A stretch is scheduled by one task: it has ``stretch`` slots, or as many as the longest
    window, which is about one over the smallest share. In each slot the blocks that lie open,
    at most one for each source, are compared.
    """
    size = windows.agg(F.count(F.lit(1)).alias("n"), F.max(F.col("deadline") - F.col("release")).alias("longest")).first()
    total, length = size["n"], max(stretch, size["longest"] or 0)
    home = F.floor(F.col("release") / length)
    last = (total - 1) // length
    counts = windows.groupBy(home.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    # One row for each stretch: blocks released before the stretch that is its run-up.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -2)
    first = F.greatest(F.col("part") - 1, F.lit(0)) * length
    parts = counts.select(
        "part", first.alias("first"), (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - first).alias("waiting")
    )
    slots = parts.select(
        "part",
        F.explode(
            F.sequence(F.col("first"), F.least((F.col("part") + 1) * length, F.lit(total)).cast("long") - 1)
        ).alias("slot"),
        F.col("waiting"),
        F.lit(None).cast("struct<deadline:bigint,src:string,k:bigint>").alias("block"),
    )
    blocks = windows.select(
        F.explode(F.array(home, home + 1)).alias("part"),
        F.col("release").alias("slot"),
        F.lit(None).cast("long").alias("waiting"),
        F.struct("deadline", "src", "k").alias("block"),
    ).filter(F.col("part") <= last)
    placed = (
        slots.unionByName(blocks)
        .repartition("part")
        .groupBy("part", "slot")
        .agg(F.collect_list("block").alias("blocks"), F.max("waiting").alias("waiting"))
        .groupBy("part")
        .agg(
            F.sort_array(F.collect_list(F.struct("slot", "blocks"))).alias("slots"),
            F.max("waiting").alias("waiting"),
        )
        .select("part", F.get("slots.slot", F.lit(0)).alias("first"), _placed(F.col("slots.blocks"), F.col("waiting")).alias("order"))
        .select("part", "first", F.posexplode("order").alias("at", "block"))
        .withColumn("slot", F.col("first") + F.col("at"))
    )
    return placed.filter(F.col("slot") >= F.col("part") * length).select("block.src", "block.k", "slot")


def mix(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    block_rows: int = BLOCK_ROWS,
    source_col: str = "source",
    key_col: str = "doc_id",
    stretch: int = STRETCH,
) -> DataFrame:
    """Every row of ``docs`` with ``mix_slot`` (its block's slot) and ``mix_position``.

    ``mix_position`` numbers the rows from 0 in mixed order, with gaps where the last block
    of a source is not full: it is ``mix_slot * block_rows`` plus the place in the block.
    Within a source rows are ordered by a hash of the key, the key and a hash of all their
    columns, so the blocks do not depend on partitioning; fully equal rows are
    interchangeable. Null sources mix as one source of their own. Columns of ``docs`` named
    like the two new ones are replaced. Without weights a source weighs as the square root of
    its rows; sources without a given weight take the smallest given one. An empty table gives
    an empty table. ``stretch`` decides how much is scheduled by one task, not the result.

    Rows are numbered within range partitions, so a hot source is spread over many tasks;
    the counts by partition and source shift the numbers. Counts and slots are stored, so
    that Spark knows their size when it chooses how to join them.
    """
    columns = [c for c in docs.columns if c.lower() not in ("mix_slot", "mix_position")]
    docs = docs.select(*[F.col(f"`{c}`") for c in columns])
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def hashable(field) -> Column:
        column = F.col(f"`{field.name}`")
        # Maps have no hash of their own.
        return F.to_json(F.struct(column)) if "map<" in field.dataType.simpleString() else column

    keyed = carried(
        docs,
        {
            "src": F.coalesce(F.col(source_col).cast("string"), F.lit(NO_SOURCE)),
            "mixed": F.md5(F.col(key_col).cast("string")),
            "tie": F.xxhash64(F.lit(0), *map(hashable, docs.schema.fields)),
        },
    )
    ranged = keyed.repartitionByRange(parts, "src", "mixed", "tie")
    # Range bounds are sampled anew in each job: they are stored with the rows.
    stored = store(ranged.withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = store(
        stored.groupBy("src", "part")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("src", "part", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    )
    sources = store(_weighted(shifts.groupBy("src").agg(F.sum("n").alias("n_rows")), weights, block_rows))
    # Blocks that begin in a part of a source.
    begins = [F.ceil(c / block_rows).cast("long") for c in (F.col("shift"), F.col("shift") + F.col("n"))]
    blocks = (
        shifts.join(sources, "src")
        .select("src", "u", begins[0].alias("low"), begins[1].alias("high"))
        .filter("low < high")
        .repartition(parts, "src", "low")
        .select("src", "u", F.explode(F.sequence(F.col("low"), F.col("high") - 1)).alias("k"))
    )
    slots = store(schedule(store(_windows(blocks, sources)), stretch))
    inside = Window.partitionBy("part", "src").orderBy("mixed", "tie")
    return (
        stored.withColumn("row_no", F.row_number().over(inside))
        .join(shifts.select("src", "part", "shift"), ["src", "part"])
        .withColumn("at", F.col("row_no") - 1 + F.col("shift"))
        .withColumn("k", F.floor(F.col("at") / block_rows))
        .join(slots, ["src", "k"])
        .withColumn("mix_slot", F.col("slot").cast("long"))
        .withColumn(
            "mix_position",
            (F.col("mix_slot") * block_rows + F.pmod(F.col("at"), F.lit(block_rows))).cast("long"),
        )
        .select("row.*", "mix_slot", "mix_position")
    )


def oracle_sql(table: str = "documents", block_rows: int = BLOCK_ROWS) -> str:
    """DuckDB SQL of ``mix`` without given weights: exact windows by pairs of sources, then one
    slot after the other from the beginning."""
    return f"""
WITH RECURSIVE
sz AS (SELECT coalesce(source, '{NO_SOURCE}') AS src, count(*) AS n FROM {table} GROUP BY 1),
so AS (SELECT src, CAST((n + {block_rows} - 1) // {block_rows} AS HUGEINT) AS b,
  CAST(greatest(floor(sqrt(CAST(n AS DOUBLE)) / max(sqrt(CAST(n AS DOUBLE))) OVER () * {float(GRID)} + 0.5), 1) AS HUGEINT) AS u FROM sz),
edges AS (SELECT src, u, b, unnest(range(0, CAST(b AS BIGINT) + 1)) AS k FROM so),
t AS (SELECT e.src, e.k, e.u, e.b, sum(CASE WHEN o.b * e.u <= e.k * o.u THEN o.b * e.u ELSE e.k * o.u END)::HUGEINT AS top
  FROM edges e CROSS JOIN so o GROUP BY ALL),
lists AS (SELECT src, list(CAST(top // u AS BIGINT) ORDER BY k) AS lower, list(CAST((top + u - 1) // u AS BIGINT) ORDER BY k) AS upper,
  CAST(any_value(b) AS BIGINT) AS b FROM t GROUP BY src),
al AS (SELECT list(src ORDER BY src) AS s, list(lower ORDER BY src) AS lo, list(upper ORDER BY src) AS up, list(b ORDER BY src) AS n,
  CAST(sum(b) AS BIGINT) AS total FROM lists),
edf AS (
  SELECT CAST(0 AS BIGINT) AS slot, list_transform(n, lambda x: CAST(0 AS BIGINT)) AS done, CAST(NULL AS BIGINT) AS pick FROM al
  UNION ALL
  SELECT slot + 1, list_transform(range(1, len(done) + 1), lambda i: done[i] + CASE WHEN i = p THEN 1 ELSE 0 END), p
  FROM (SELECT slot, done, list_min(list_filter(list_transform(range(1, len(n) + 1), lambda i:
      CASE WHEN done[i] < n[i] AND lo[i][done[i] + 1] <= slot THEN {{'d': up[i][done[i] + 2], 'i': i}} END), lambda x: x IS NOT NULL)).i AS p
    FROM edf, al WHERE slot < total) y),
placed AS (SELECT slot - 1 AS slot, s[pick] AS src, done[pick] - 1 AS k FROM edf, al WHERE pick IS NOT NULL),
d AS (SELECT doc_id, source, coalesce(source, '{NO_SOURCE}') AS src,
  row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR))) - 1 AS nr FROM {table})
SELECT doc_id, source, CAST(slot AS BIGINT) AS mix_slot, CAST(slot * {block_rows} + nr % {block_rows} AS BIGINT) AS mix_position
FROM d JOIN placed p ON d.src = p.src AND d.nr // {block_rows} = p.k"""
