"""License scans: MinHash bands over overlapping windows retrieve license templates, and the
exact share of a template's shingles in the window verifies the match.

For a template of L words, windows of ``L + s`` words start at every multiple of
``s = max(1, L // 2)``, so any run of L words lies whole in one of them. If the run holds the
required share of the template's shingles, the Jaccard similarity of window and template has
a lower bound that depends on L alone; the number of bands follows from the largest chance
of a miss that is allowed.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geohotspots.llm.common import WordCodes, bare, struct_udf, window_codes, word_batches, words_of

SHINGLE, CONTAINMENT = 5, 0.8
#: Largest chance that no band of a true match agrees. A band is one MinHash value.
MISS = 1e-3
#: Words of all templates together; the index travels with the tasks.
MOST_TEMPLATE_WORDS = 200_000
_BLOOM_BITS = 20

# Common license notices, as published.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
        "except in compliance with the License. You may obtain a copy of the License at"
    ),
    "apache-2.0-warranty": (
        "Unless required by applicable law or agreed to in writing, software distributed under the "
        "License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied."
    ),
    "mit-notice": "Released under the MIT License.",
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
        "and associated documentation files (the \"Software\"), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software"
    ),
    "bsd-redistribution": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met"
    ),
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the "
        "GNU General Public License as published by the Free Software Foundation"
    ),
    "cc-by-4.0-notice": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-nd-4.0-notice": "Licensed under CC BY-ND 4.0.",
    "all-rights-reserved": "All rights reserved.",
}

_CODES = WordCodes(bare)


def jaccard_bound(length: int, shingle: int, containment: float = CONTAINMENT) -> float:
    """Least Jaccard similarity of a template of ``length`` words with the window around a
    run that holds the share ``containment`` of its shingles."""
    own = length - shingle + 1
    shared = math.ceil(containment * own - 1e-9)
    window = own + max(1, length // 2)
    return shared / (own + window - shared)


def bands_for(lengths: list[tuple[int, int]], miss: float = MISS) -> int:
    """Bands of one row that miss a true match with a chance of at most ``miss``."""
    least = min(jaccard_bound(n, k) for n, k in lengths)
    return math.ceil(math.log(miss) / math.log(1 - least)) if least < 1 else 1


class TemplateIndex:
    """MinHash bands of the templates, grouped by their length and shingle size."""

    def __init__(self, templates: dict[str, str], seed: int = 17):
        self.names, self.shingles, shapes = [], [], []
        total = 0
        for name, text in sorted(templates.items()):
            codes = _CODES.of(words_of(text))
            total += len(codes)
            if not len(codes):
                continue
            k = min(SHINGLE, len(codes))
            self.names.append(name)
            self.shingles.append(np.unique(window_codes(codes, range(k))))
            shapes.append((len(codes), k))
        if total > MOST_TEMPLATE_WORDS:
            raise ValueError(f"templates have {total} words, more than {MOST_TEMPLATE_WORDS}")
        self.bands = bands_for(shapes) if shapes else 0
        rng = np.random.default_rng(seed)
        self.factors = rng.integers(0, 1 << 62, self.bands, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        #: By shape: band values to templates, and the shingles of all its templates.
        self.groups: dict[tuple[int, int], list[dict]] = {}
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for no, shape in enumerate(shapes):
            tables = self.groups.setdefault(shape, [{} for _ in range(self.bands)])
            for table, value in zip(tables, self.signature(self.shingles[no]).tolist()):
                table.setdefault(value, []).append(no)
        for k in {k for _, k in shapes}:
            every = np.unique(np.concatenate([s for s, (_, sk) in zip(self.shingles, shapes) if sk == k]))
            bloom = np.zeros(1 << _BLOOM_BITS, bool)
            bloom[every >> np.uint64(64 - _BLOOM_BITS)] = True
            self.known[k] = every, bloom

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """One MinHash value for each band. The permutations are bijections of 64-bit codes."""
        mixed = shingles[None, :] * self.factors[:, None]
        return (mixed ^ (mixed >> np.uint64(31))).min(axis=1)

    def _windows(self, shingles: np.ndarray, length: int, k: int, hits: np.ndarray):
        """Windows ``(first, last)`` of shingle numbers that hold a hit."""
        step = max(1, length // 2)
        size = length + step - k + 1
        # Windows start at multiples of the step; those around each hit.
        low = np.maximum(0, -((size - 1 - hits) // step)) * step
        found = set()
        for h, a in zip(hits.tolist(), low.tolist()):
            for start in range(a, h + 1, step):
                if start + size > h:
                    found.add(start)
        return [(s, min(s + size, len(shingles))) for s in sorted(found)]

    def scan(self, codes: np.ndarray) -> list[tuple[str, int, int, float]]:
        """Matches ``(template, first word, last word, containment)`` in one text's words."""
        best: dict[tuple[int, int], tuple] = {}
        for k, (every, bloom) in self.known.items():
            shingles = window_codes(codes, range(k))
            hits = np.flatnonzero(bloom[shingles >> np.uint64(64 - _BLOOM_BITS)])
            hits = hits[np.isin(shingles[hits], every)]
            if not len(hits):
                # A band can agree only in a shingle that a template has.
                continue
            for (length, sk), tables in self.groups.items():
                if sk != k:
                    continue
                for first, last in self._windows(shingles, length, k, hits):
                    part = shingles[first:last]
                    drawn = {
                        no
                        for table, value in zip(tables, self.signature(np.unique(part)).tolist())
                        for no in table.get(value, ())
                    }
                    for no in drawn:
                        mine = self.shingles[no]
                        inside = np.flatnonzero(np.isin(part, mine))
                        share = len(np.unique(part[inside])) / len(mine)
                        if share >= CONTAINMENT - 1e-9:
                            a, b = first + int(inside[0]), first + int(inside[-1]) + k - 1
                            old = best.get((no, a))
                            if old is None or (share, -b) > (old[2], -old[1]):
                                best[no, a] = (a, b, share)
        out = []
        for (no, _), (a, b, share) in sorted(best.items()):
            # Overlapping windows see one match from several starts.
            if out and out[-1][0] == self.names[no] and a <= out[-1][2]:
                name, x, y, s = out[-1]
                out[-1] = (name, x, max(y, b), max(s, share))
            else:
                out.append((self.names[no], a, b, share))
        return out

    def find(self, texts: list[str]) -> dict:
        found: list[list] = [[] for _ in texts]
        for first, codes, starts in word_batches(texts, _CODES):
            touched = set()
            for k, (_, bloom) in self.known.items():
                shingles = window_codes(codes, range(k))
                hits = np.flatnonzero(bloom[shingles >> np.uint64(64 - _BLOOM_BITS)])
                touched.update((np.searchsorted(starts, hits, "right") - 1).tolist())
            for doc in touched:
                found[first + doc] = self.scan(codes[starts[doc] : starts[doc + 1]])
        return {"matches": found}


_MATCHES = "matches array<struct<template:string,first:long,last:long,containment:double>>"


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """``doc_id, n_matches, licenses, matches``: one row for each row of ``docs``.

    ``licenses`` lists the names found, sorted and joined by commas; ``matches`` has
    name:first word:last word for each match, in the order of name and place. Words are
    compared in lower case and without punctuation around them. Templates with fewer words
    than a shingle are one shingle. Null and empty texts have no match; no templates, none.
    """
    index = TemplateIndex(TEMPLATES if templates is None else templates)
    find = struct_udf(index.find, _MATCHES)
    found = docs.select("doc_id", find(F.col("text"))["matches"].alias("m"))
    return found.select(
        "doc_id",
        F.size("m").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct("m.template")), ",").alias("licenses"),
        F.array_join(
            F.transform("m", lambda x: F.concat_ws(":", x["template"], x["first"], x["last"])), ","
        ).alias("matches"),
    )
