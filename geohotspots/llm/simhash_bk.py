"""Near-duplicate documents: SimHash fingerprints searched in BK-trees."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geohotspots.llm.common import struct_udf
from geohotspots.llm.pigeonhole import hamming_links
from geohotspots.operators.components import connected_components
from geohotspots.session import store

RADIUS, BLOCKS, SHINGLE, SEED = 4, 6, 4, 42

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_HASH = xxhash.xxh64_intdigest
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """SimHash of the word shingles: a bit is 1 if it is set in over half of their XXH64.

    Shingles count as often as they occur. A text with fewer words is one shingle; a text
    without words has fingerprint zero.
    """
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return _HASH(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = (ends - lengths + 1)[: len(words) - shingle + 1].tolist()
    ends = ends[shingle - 1 :].tolist()
    hashes = np.fromiter(
        (_HASH(joined[s:e], SEED) for s, e in zip(starts, ends)), np.uint64, len(ends)
    )
    octets = hashes.view(np.uint8).reshape(-1, 8)
    # How often each value of each byte occurs, times the bits set in that value.
    total = np.concatenate([np.bincount(octets[:, i], minlength=256) @ _BITS for i in range(8)])
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(texts: list[str]) -> dict:
    values = np.fromiter(map(fingerprint, texts), np.uint64, len(texts))
    return {"fp": values.view(np.int64)}


def group_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp, component)`` for every row of ``docs``, and ``copies`` of its fingerprint.

    ``component`` is the smallest id that can be reached over links of at most ``RADIUS``
    differing bits. Null texts count as empty: fingerprint zero, linked like any other.
    Rows without an id keep their fingerprint; their component is the smallest id among
    the rows linked to them, or null if there is none. Repeated rows stay repeated.

    Equal fingerprints are one node. Nodes are spread over shards by blocks of bits, so a
    BK-tree goes only to the tasks that search it and nothing grows on the driver.
    """
    prints = store(
        docs.select(
            F.col(id_col).cast("long").alias("id"),
            struct_udf(_fingerprints, "fp long")(F.col(text_col))["fp"].alias("fp"),
        )
    )
    nodes = prints.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
    # The fingerprint itself names a node in the graph.
    links = hamming_links(nodes.select("fp", F.col("fp").alias("node")), RADIUS, BLOCKS)
    roots = connected_components(links)
    nodes = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "least", "copies", F.coalesce("root", "fp").alias("root")
    )
    least = nodes.groupBy("root").agg(F.min("least").alias("component"))
    named = nodes.join(least, "root").select("fp", "component", "copies")
    return prints.join(named, "fp").select("id", "fp", "component", "copies")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` and the number of rows with that fingerprint."""
    groups = group_documents(docs)
    return groups.select(
        F.col("id").alias("doc_id"),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
        F.col("copies").alias("n_same_fingerprint"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id names their group of near duplicates.

    Rows of one id are one document: they stay or go together. Rows without an id stay, as
    no other row can stand for them by name.
    """
    gone = group_documents(docs).filter("id <> component").select(F.col("id").alias("_gone"))
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
