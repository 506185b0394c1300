"""License scans by patience alignment.

A text is matched with license templates. Words that occur once in the text's region
and once in the template are anchors; the longest increasing run of anchors is kept,
and the gaps between them are aligned in the same way, with equal ends where no
anchor is left. Coverage is the share of the template's words that are aligned.

Regions come from telling words, those of a template that are not common ones: a
region reaches a template's length beyond telling words that stand close together,
so a text of any length costs what its regions cost. Words are runs of letters and
digits in lower case. Missing and empty texts have no finding; rows are scanned one
by one, repeated or not.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from pointproc.llm.common import Bytes, pieces

#: Share of a template's words, and of the words from the first to the last one aligned, that make a finding.
COVERAGE, DENSITY = 0.8, 0.6

#: Texts of public licenses, as written by those who use them.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
                "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
                "copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
                         "in compliance with the License. You may obtain a copy of the License at",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                      "General Public License as published by the Free Software Foundation, either version 3 of the License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
                "that the following conditions are met",
}
#: Words that tell nothing of a license.
COMMON = frozenset("a an and any as at be by copy for in is it may not of on or that the this to use with you your".split())
_KEEP = np.arange(256, dtype=np.uint8)
_KEEP[:128] = [c if chr(c).isalnum() else 32 for c in range(128)]


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, ascending by the first, whose second rises too."""
    tops, ends, back = [], [], [-1] * len(pairs)
    for k, (_, y) in enumerate(pairs):
        p = bisect_left(tops, y)
        back[k] = ends[p - 1] if p else -1
        if p == len(tops):
            tops.append(y)
            ends.append(k)
        else:
            tops[p], ends[p] = y, k
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places of equal words, ascending in both, by patience."""
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        many_a, many_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: j for j, w in enumerate(b[b0:b1], b0) if many_b[w] == 1}
        anchors = increasing([(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if many_a[w] == 1 and w in place])
        found.extend(anchors)
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        if anchors:
            todo.extend((p + 1, x, q + 1, y) for (p, q), (x, y) in zip(edges, edges[1:]) if p + 1 < x and q + 1 < y)
    return sorted(found)


class Scanner:
    def __init__(self, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE, density: float = DENSITY):
        self.templates = {name: words_of(text) for name, text in templates.items()}
        self.coverage, self.density = coverage, density
        self.telling = {name: set(words) - COMMON for name, words in self.templates.items()}
        self.vocabulary = sorted(set().union(*self.telling.values()))
        self.hashes = np.sort(np.array([Bytes(x, np.array([0, len(x)])).ranges(np.array([0]), np.array([len(x)]))[0]
                                        for x in (np.frombuffer(w.encode(), np.uint8) for w in self.vocabulary)], np.uint64))

    def regions(self, places: list[int], n: int, width: int) -> list[tuple[int, int]]:
        out: list[list[int]] = []
        for p in places:
            if out and p - out[-1][1] <= width:
                out[-1][1] = p
            else:
                out.append([p, p])
        return [(max(0, a - width), min(n, z + width + 1)) for a, z in out]

    def scan(self, words: list[str], hits: list[int]) -> list[tuple[str, float, int, int]]:
        """license, coverage, first and last word (exclusive) of the findings in a text, given its telling words' places."""
        found = []
        for name, template in self.templates.items():
            telling = self.telling[name]
            places = [p for p in hits if words[p] in telling]
            for lo, hi in self.regions(places, len(words), len(template)):
                if len(telling & set(words[lo:hi])) < self.coverage * len(telling) - 1:
                    continue
                pairs = align(words[lo:hi], template)
                share = len(pairs) / len(template)
                if pairs and share >= self.coverage and len(pairs) >= self.density * (pairs[-1][0] - pairs[0][0] + 1):
                    found.append((name, share, lo + pairs[0][0], lo + pairs[-1][0] + 1))
        return found


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE, density: float = DENSITY) -> DataFrame:
    """doc_id, license, coverage, start_word, end_word: a row for each finding."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        scanner = Scanner(templates, coverage, density)
        for batch in batches:
            low = pc.utf8_lower(batch.column("text").cast(pa.large_string()).fill_null(""))
            ids, rows = [], []
            for lo, hi, b in pieces(low):
                w = Bytes(_KEEP[b.data], b.offsets)
                start, end, doc = w.words()
                hit = np.isin(w.ranges(start, end), scanner.hashes)
                first = np.searchsorted(doc, np.arange(hi - lo + 1))
                for d in np.unique(doc[hit]).tolist():
                    words = words_of(low[lo + d].as_py())
                    known = set(scanner.vocabulary)
                    places = [k for k, x in enumerate(words) if x in known] if len(words) != first[d + 1] - first[d] \
                        else np.flatnonzero(hit[first[d]:first[d + 1]]).tolist()
                    for row in scanner.scan(words, places):
                        ids.append(lo + d)
                        rows.append(row)
            if rows:
                cols = list(zip(*rows))
                yield pa.record_batch([batch.column("doc_id").take(pa.array(ids)), pa.array(cols[0]), pa.array(cols[1]),
                                       pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())],
                                      names=["doc_id", "license", "coverage", "start_word", "end_word"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, license string, coverage double, start_word long, end_word long")
