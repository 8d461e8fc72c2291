"""All pairs of 64-bit fingerprints within a Hamming radius, without comparing all pairs.

The 64 bits are cut into blocks. Two fingerprints that differ in at most ``radius`` bits
agree in at least ``blocks - radius`` whole blocks, so they meet under the key of one such
choice of blocks (a *shard*). A shard holds a BK-tree: the children of a node are keyed by
their Hamming distance to it, and a search follows only the edges within the radius.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pairs (query, tree node) held at once; queries go through a tree in slices.
FRONTIER = 1_000_000


def shard_keys(fp: Column, radius: int, blocks: int) -> Column:
    """Array of one key for each choice of ``blocks - radius`` blocks."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    keys = []
    for no, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        key, at = F.lit(no).cast("long"), 0
        for b in chosen:
            width = edges[b + 1] - edges[b]
            part = F.shiftrightunsigned(fp, edges[b]).bitwiseAND((1 << width) - 1)
            key = F.shiftleft(key, width).bitwiseOR(part)
            at += width
        keys.append(key)
    return F.array(*keys)


def grow_forest(fps: np.ndarray, groups: np.ndarray):
    """BK-trees of all groups at once, as if the rows were inserted in their order.

    ``groups`` is sorted. Returns the root of every row's tree, and the child edges sorted
    by ``parent * 128 + distance`` with the child each leads to.
    """
    n = len(fps)
    new = np.r_[True, groups[1:] != groups[:-1]]
    roots = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    left = np.flatnonzero(~new)
    at = roots[left]
    edges, children = [], []
    while len(left):
        edge = at * 128 + np.bitwise_count(fps[left] ^ fps[at]).astype(np.int64)
        keys, firsts, inverse = np.unique(edge, return_index=True, return_inverse=True)
        edges.append(keys)
        children.append(left[firsts])
        at = left[firsts][inverse]
        stay = np.ones(len(left), bool)
        stay[firsts] = False
        left, at = left[stay], at[stay]
    if not edges:
        return roots, np.empty(0, np.int64), np.empty(0, np.int64)
    edges, children = np.concatenate(edges), np.concatenate(children)
    order = np.argsort(edges, kind="stable")
    return roots, edges[order], children[order]


def search_forest(fps, roots, edges, children, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slices of pairs ``(row, earlier row of its group)`` within the radius."""
    sizes = np.bincount(roots, minlength=len(fps))[roots]
    done = 0
    while done < len(fps):
        # A query meets at most all rows of its group.
        upto = done + max(1, int(np.searchsorted(np.cumsum(sizes[done:]), FRONTIER)))
        query = np.arange(done, min(upto, len(fps)))
        node = roots[query]
        found_q, found_n = [], []
        while len(query):
            d = np.bitwise_count(fps[query] ^ fps[node]).astype(np.int64)
            hit = (d <= radius) & (node < query)
            found_q.append(query[hit])
            found_n.append(node[hit])
            low = np.searchsorted(edges, node * 128 + np.maximum(d - radius, 0))
            high = np.searchsorted(edges, node * 128 + d + radius + 1)
            count = high - low
            starts = np.cumsum(count) - count
            step = np.arange(count.sum()) - np.repeat(starts, count)
            query = np.repeat(query, count)
            node = children[np.repeat(low, count) + step]
            keep = node < query
            query, node = query[keep], node[keep]
        yield np.concatenate(found_q), np.concatenate(found_n)
        done = upto


def _find(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def spanning_links(fps: np.ndarray, groups: np.ndarray, radius: int, labels: np.ndarray | None = None):
    """Pairs of rows within the radius that connect each group as all such pairs would.

    With ``labels``, all pairs of different labels are returned instead.
    """
    roots, edges, children = grow_forest(fps, groups)
    parent = list(range(len(fps)))
    left, right = [], []
    for q, n in search_forest(fps, roots, edges, children, radius):
        if labels is not None:
            differ = labels[q] != labels[n]
            left += q[differ].tolist()
            right += n[differ].tolist()
            continue
        if len(q) > 1000:
            # One pair for each (row, known component) is enough.
            known = np.fromiter((_find(parent, x) for x in n.tolist()), np.int64, len(n))
            _, first = np.unique(q * len(fps) + known, return_index=True)
            q, n = q[first], n[first]
        for a, b in zip(q.tolist(), n.tolist()):
            x, y = _find(parent, a), _find(parent, b)
            if x != y:
                parent[max(x, y)] = min(x, y)
                left.append(a)
                right.append(b)
    return np.array(left, np.int64), np.array(right, np.int64)


def _link_partition(radius: int, labelled: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(part: list[np.ndarray]) -> pa.RecordBatch:
            key, fp, node, *label = part
            new = np.r_[True, key[1:] != key[:-1]]
            group = np.cumsum(new) - 1
            many = np.bincount(group)[group] > 1
            fp, node, group = fp[many].view(np.uint64), node[many], group[many]
            a, b = (
                spanning_links(fp, group, radius, label[0][many] if labelled else None)
                if len(fp)
                else (np.empty(0, np.int64),) * 2
            )
            return pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["u", "v"])

        width = 4 if labelled else 3
        rest = [np.empty(0, np.int64)] * width
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(width)]
            part = [np.concatenate(x) for x in zip(rest, columns)]
            # The last shard may go on in the next batch.
            cut = int(np.searchsorted(part[0], part[0][-1])) if len(part[0]) else 0
            if cut > 50_000:
                yield links([x[:cut] for x in part])
                part = [x[cut:] for x in part]
            rest = part
        if len(rest[0]):
            yield links(rest)

    return run


def hamming_links(nodes: DataFrame, radius: int, blocks: int, label: str | None = None) -> DataFrame:
    """Links ``(u, v)`` between ``nodes(node, fp)`` within the radius.

    They connect the nodes exactly as all pairs within the radius would, but a group of m
    alike nodes yields about m links under each key, not m squared. With ``label``, all
    pairs of different labels are returned.
    """
    extra = [F.col(label).alias("label")] if label else []
    sharded = (
        nodes.select(F.explode(shard_keys(F.col("fp"), radius, blocks)).alias("key"), "fp", "node", *extra)
        .repartition("key")
        .sortWithinPartitions("key", "node")
    )
    return sharded.mapInArrow(_link_partition(radius, label is not None), "u long, v long").distinct()
