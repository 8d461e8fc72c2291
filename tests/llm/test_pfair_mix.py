from collections import Counter
from fractions import Fraction
from math import ceil, floor

import pytest
from pyspark.sql import functions as F

from geohotspots.llm import pfair_mix as q


def ideal(blocks, weights, v):
    """Blocks of each source at virtual time ``v``."""
    return {s: min(weights[s] * v, n) for s, n in blocks.items()}


def brute(blocks, weights):
    """Earliest deadline first from the unrounded weights, one slot after the other."""
    lower, upper = {}, {}
    for s, n in blocks.items():
        ends = [sum(ideal(blocks, weights, Fraction(k) / weights[s]).values()) for k in range(n + 1)]
        lower[s], upper[s] = [floor(t) for t in ends[:-1]], [ceil(t) for t in ends[1:]]
    done, order = Counter(), []
    for t in range(sum(blocks.values())):
        ready = [(upper[s][done[s]], s) for s, n in blocks.items() if done[s] < n and lower[s][done[s]] <= t]
        s = min(ready)[1]
        done[s] += 1
        order.append(s)
    return order


def furthest(order, blocks, weights):
    """Largest distance of any source from the ideal mix, after any slot."""
    ends = sorted((Fraction(n) / weights[s], s) for s, n in blocks.items())
    worst, seen, v, gone = Fraction(0), Counter(), Fraction(0), 0
    rate = sum(weights[s] for s in blocks)
    reached = Fraction(0)
    for t, s in enumerate(order, 1):
        seen[s] += 1
        # Move on in virtual time until slot t is reached.
        while gone < len(ends) and reached + rate * (ends[gone][0] - v) <= t:
            reached += rate * (ends[gone][0] - v)
            v = ends[gone][0]
            rate -= weights[ends[gone][1]]
            gone += 1
        if gone < len(ends):
            v += (t - reached) / rate
            reached = Fraction(t)
        worst = max(worst, max(abs(seen[s] - x) for s, x in ideal(blocks, weights, v).items()))
    return worst


def whole(weights):
    top = max(weights.values())
    return {s: Fraction(max(1, floor(w / top * q.GRID + 0.5))) for s, w in weights.items()}


def mixed_order(spark, blocks, weights, **options):
    rows = [(s,) for s, n in blocks.items() for _ in range(n)]
    docs = spark.createDataFrame(rows, "source string").withColumn("doc_id", F.monotonically_increasing_id())
    out = q.mix(docs, weights, block_rows=1, **options).select("mix_slot", "source").toPandas()
    assert out["mix_slot"].is_unique and len(out) == len(rows)
    return out.sort_values("mix_slot")["source"].tolist()


@pytest.mark.parametrize(
    "sizes, shares, stretch",
    [
        ((5, 3, 2), (0.5, 0.3, 0.2), 4),
        ((40, 40, 40), (1, 1, 1), 3),
        ((100, 7, 1, 33), (0.2, 0.5, 0.1, 0.2), 5),
        (tuple(range(1, 25)), tuple(1 / (i + 2) for i in range(24)), 16),
        ((300, 2, 90, 90, 90), (0.9, 0.001, 0.03, 0.03, 0.03), 50),
        ((12,), (3.0,), 5),
    ],
)
def test_stretches_join_to_the_schedule_slot_by_slot(spark, sizes, shares, stretch):
    blocks = {f"s{i:02d}": n for i, n in enumerate(sizes)}
    weights = {f"s{i:02d}": w for i, w in enumerate(shares)}
    order = mixed_order(spark, blocks, weights, stretch=stretch)
    assert order == brute(blocks, whole(weights))
    assert furthest(order, blocks, whole(weights)) < 1


def test_many_slots_stay_within_a_block_of_uneven_weights(spark):
    weights = {"a": 0.333, "b": 0.333, "c": 0.333, "d": 0.001}
    blocks = {"a": 4000, "b": 4000, "c": 4000, "d": 12}
    order = mixed_order(spark, blocks, weights)
    exact = {s: Fraction(str(w)) for s, w in weights.items()}
    seen = Counter()
    for t, s in enumerate(order[:12_000], 1):
        seen[s] += 1
        assert all(abs(seen[x] - t * w) < 1 for x, w in exact.items())


def test_thousand_sources(spark):
    blocks = {f"s{i:04d}": 1 + i * 7919 % 13 for i in range(1000)}
    weights = {s: 1 + (no % 17) / 3 for no, s in enumerate(blocks)}
    order = mixed_order(spark, blocks, weights)
    assert Counter(order) == Counter(blocks)
    assert furthest(order[:500], blocks, whole(weights)) < 1


def test_blocks_do_not_depend_on_partitions(spark):
    rows = [(i, "a" if i % 10 < 7 else "b" if i % 10 < 9 else "c", "x" * (i % 5)) for i in range(5000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    mixed = q.mix(docs, stretch=100)
    out = mixed.toPandas()
    assert len(out) == 5000 and out["mix_position"].is_unique
    slots = out.drop_duplicates("mix_slot").sort_values("mix_slot")
    assert slots["mix_slot"].tolist() == list(range(len(slots)))
    again = q.mix(docs.repartition(7))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, mixed.collect()))


def test_odd_rows(odd_docs, no_docs):
    out = q.mix(odd_docs)
    assert out.count() == odd_docs.count()
    assert set(out.columns) == set(odd_docs.columns) and dict(out.dtypes)["mix_slot"] == "bigint"
    rows = out.collect()
    assert len({r["mix_position"] for r in rows}) == len(rows)
    assert Counter(r["source"] for r in rows) == Counter(r["source"] for r in odd_docs.collect())
    assert q.mix(no_docs).count() == 0


@pytest.mark.parametrize("weights", [{"s0": 0.0}, {}, {"s0": float("inf")}])
def test_bad_weights(odd_docs, weights):
    with pytest.raises(ValueError):
        q.mix(odd_docs, weights)
