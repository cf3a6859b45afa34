"""Operator 2, license scans by patience alignment of texts with notice templates.

Words are lower-cased runs of letters, digits and dots. Anchors are words unique to both sides; the
longest increasing subsequence of their places is kept, and the gaps between are aligned the same way.
Coverage is the share of template words aligned inside the best stretch of the text. A template is
reported at COVERAGE or more, if its telling words are among those aligned; a text without at least that share of a template's words is not aligned,
as it cannot reach it. Null, empty and blank texts give an empty list; ties go to the earlier template.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame

from chronolap.llm import words

COVERAGE = 0.8
#: Notices by license name; /text and /header are a licence's permission text and its header for files.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Apache-2.0/header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "MIT/text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "ISC/text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "GPL-2.0/header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0/header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-2.1/header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "Unlicense/text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib/text": "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
}
#: Words of a related licence; a stretch with one of them is not that notice.
OTHERS = {k: {"lesser", "library", "affero"} for k in ("GPL-2.0/header", "GPL-3.0/header", "GPL-3.0")}
#: Words that tell a licence from those with a like notice; a stretch without all of them is not that notice.
TELLING = {"Apache-2.0": {"apache", "2.0"}, "MIT": {"mit"}, "GPL-3.0": {"gnu", "general", "3"}, "CC-BY-NC-4.0": {"by-nc", "4.0"}, "MPL-2.0": {"mozilla", "2.0"}, "Apache-2.0/header": {"apache", "2.0"}, "GPL-2.0/header": {"general", "2"}, "GPL-3.0/header": {"general", "3"}, "LGPL-2.1/header": {"lesser", "2.1"}, "ISC/text": {"fee"}, "Unlicense/text": {"unencumbered"}}
_TOKEN = re.compile(r"\w+(?:[.-]\w+)*")


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs, ordered by the first, whose second rises."""
    tops, piles, back = [], [], {}
    for p in pairs:
        i = bisect_left(tops, p[1])
        back[p] = piles[i - 1] if i else None
        if i == len(tops):
            tops.append(p[1])
            piles.append(p)
        else:
            tops[i], piles[i] = p[1], p
    out, p = [], piles[-1] if piles else None
    while p:
        out.append(p)
        p = back[p]
    return out[::-1]


def patience(a: list[str], b: list[str], lo: int = 0, at: int = 0) -> list[tuple[int, int]]:
    """Aligned places of a and b, rising on both sides."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            found.append((i + lo, k + at))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            found.append((j + lo, m + at))
        if i >= j or k >= m:
            continue
        ca, cb = Counter(a[i:j]), Counter(b[k:m])
        where = {w: x for x, w in enumerate(b[k:m], k) if cb[w] == 1}
        anchors = rising([(x, where[a[x]]) for x in range(i, j) if ca[a[x]] == 1 and a[x] in where])
        if not anchors:
            continue
        x0, y0 = i, k
        for x, y in anchors:
            todo.append((x0, x, y0, y))
            found.append((x + lo, y + at))
            x0, y0 = x + 1, y + 1
        todo.append((x0, j, y0, m))
    return sorted(found)


def stretches(t: list[str], w: list[str], need: int) -> Iterator[tuple[int, int]]:
    """Ranges of the text, from a template word on, that share `need` words with the template: the shortest, as long as it, twice as long."""
    want, have, shared, r = Counter(w), Counter(), 0, 0
    hits = [i for i, x in enumerate(t) if x in want]
    for n, p in enumerate(hits):
        while r < len(hits) and hits[r] < p + 2 * len(w):
            x = t[hits[r]]
            have[x] += 1
            shared += have[x] <= want[x]
            r += 1
        if shared >= need:
            part, k, m = Counter(), 0, n
            while k < need:
                part[t[hits[m]]] += 1
                k += part[t[hits[m]]] <= want[t[hits[m]]]
                m += 1
            for end in sorted({hits[m - 1] + 1, p + len(w), p + 2 * len(w)}):
                yield p, min(end, len(t))
        shared -= have[t[p]] <= want[t[p]]
        have[t[p]] -= 1


def scan(text: str | None, templates: dict[str, list[str]], share: float = COVERAGE) -> list[tuple[str, float, int, int]]:
    """(license, coverage, first word, end word) of each template found."""
    t = tokens(text or "")
    have = set(t)
    out = []
    for name, w in templates.items():
        if not w or sum(x in have for x in w) < share * len(w):
            continue
        best, telling = (0.0, 0, 0), TELLING.get(name, set()) & set(w)
        for lo, end in stretches(t, w, ceil(share * len(w) - 1e-9)):
            pairs = patience(t[lo:end], w, lo)
            if pairs and len(pairs) / len(w) > best[0] and telling <= {w[y] for _, y in pairs} and not OTHERS.get(name, set()) & set(t[pairs[0][0] : pairs[-1][0] + 1]):
                best = (len(pairs) / len(w), pairs[0][0], pairs[-1][0] + 1)
            if best[0] == 1:
                break
        if best[0] >= share:
            out.append((name, *best))
    return out


def licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id and the licenses found: name, coverage, and the words' range."""
    cut = {k: tokens(v) for k, v in (templates or TEMPLATES).items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in words.parts(batches, "text"):
            found = [[dict(zip(("license", "coverage", "first", "end"), x)) for x in scan(t, cut)] for t in b.column(1).to_pylist()]
            kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("first", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], names=["doc_id", "found"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, found array<struct<license:string,coverage:double,first:long,end:long>>")


def query(docs: DataFrame) -> DataFrame:
    return licenses(docs).selectExpr("doc_id", "array_join(array_distinct(transform(found, x -> split(x.license, '/')[0])), ',') as licenses", "found")
