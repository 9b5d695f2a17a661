"""Licences by sparse TF-IDF cosine to templates, then inheritance from the nearest directory."""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_row, rows_of

#: Notices by which texts state a licence, by SPDX name.
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License", "SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version"],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0"],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"],
    "ISC": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["Released under CC0 1.0.", "Dedicated to the public domain under CC0 1.0 Universal."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "Proprietary": ["All rights reserved.", "All rights reserved. Unauthorized copying of this file is strictly prohibited. Proprietary and confidential."],
}
TERM = re.compile(rb"[a-z0-9]+")
#: Lines and wider windows are looked at around each of these.
STEM = re.compile(rb"licen[sc]e|copyright|spdx|public domain|redistribut|hereby granted|creative commons|under cc|rights reserved")
#: Words before and after a stem in the two windows compared.
WINDOWS = ((8, 14), (24, 60))
#: The least share of documents that a template's term counts with, and that of all other terms.
RARE, OTHER = 1e-4, 1e-2
LICENCE_FILE = r"(?i)(^|/)(LICEN[SC]E|COPYING|NOTICE)[^/]*$"


def template_terms() -> list[tuple[str, Counter]]:
    return [(name, Counter(t.decode() for t in TERM.findall(text.lower().encode()))) for name, texts in TEMPLATES.items() for text in texts]


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[int, dict[str, int]]:
    """Number of documents, and how many hold each template term; the driver gets a row for each term of TEMPLATES."""
    vocabulary = frozenset(t.encode() for _, terms in template_terms() for t in terms)

    def count(batches):
        n: Counter = Counter()
        for batch in batches:
            for text in rows_of(batch, "t"):
                n[b""] += 1
                n.update(vocabulary & frozenset(TERM.findall(text.lower())))
        if n:
            yield pa.RecordBatch.from_pydict({"term": [t.decode() for t in n], "n": list(n.values())}, schema=pa.schema([("term", pa.string()), ("n", pa.int64())]))

    found = docs.select(F.col(text_col).alias("t")).mapInArrow(count, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    by = {r["term"]: r["n"] for r in found}
    return by.pop("", 0), by


class Matcher:
    """Cosine of word windows to templates, weights term frequency by 1 - log(share of documents with the term).

    Each template has anchors: its terms of largest weight, so many that what is left of it is
    under the threshold. A window that reaches the threshold holds an anchor of that template.

    Shares below RARE count as RARE and terms that no template has as OTHER, so no weight grows with the number of documents.
    """

    def __init__(self, n: int, df: dict[str, int], threshold: float = 0.6):
        self.threshold = threshold
        self.idf = {t: 1 - math.log(max(df.get(t, 0) / max(n, 1), RARE)) for _, terms in template_terms() for t in terms}
        self.other = 1 - math.log(OTHER)  # a term that no template has
        self.templates = []
        for name, terms in template_terms():
            weights = {t: k * self.idf[t] for t, k in terms.items()}
            self.templates.append((name, weights, math.sqrt(sum(w * w for w in weights.values()))))
        # (name, length, weights, norm, terms that no other licence has) of each template
        holders = {t: {name for name, terms in template_terms() if t in terms} for t in self.idf}
        self.own = [(name, sum(terms.values()), w, size, {t for t in terms if len(holders[t]) == 1}) for (name, terms), (_, w, size) in zip(template_terms(), self.templates)]
        self.longest = max(length for _, length, *_ in self.own)
        self.anchored: dict[str, list] = {}
        for template in self.own:
            _, _, weights, size, _ = template
            rest = size * size
            for t in sorted(weights, key=lambda t: (-self.idf[t], t)):
                if rest < (self.threshold * size) ** 2 * 0.999999:
                    break
                self.anchored.setdefault(t, []).append(template)
                rest -= weights[t] ** 2
        self.anchors = frozenset(t.encode() for t in self.anchored)

    def best(self, terms: list[str]) -> tuple[float, str]:
        weights = {t: k * self.idf.get(t, self.other) for t, k in Counter(terms).items()}
        norm = math.sqrt(sum(w * w for w in weights.values())) or 1.0
        return max(((sum(w * weights[t] for t, w in own.items() if t in weights) / (size * norm), name) for name, own, size in self.templates), key=lambda x: (round(x[0], 9), x[1]))

    def slid(self, near: list[str], at: int):
        """(cosine, name, length) of the best window of each template's own length that holds its anchor near[at], where it reaches the threshold.

        The window must hold a term that only this licence has, if the template has any.
        """
        present, least = frozenset(near), self.threshold
        for name, length, weights, size, only in self.anchored[near[at]]:
            # the cosine is at most the norm of the template's terms at hand over that of all
            if (only and not only & present) or sum(weights[t] ** 2 for t in present if t in weights) < (least * size) ** 2:
                continue
            best = 0.0
            for start in range(max(0, at - length + 1), max(0, min(at, len(near) - length)) + 1):
                terms = near[start : start + length]
                if not only or not only.isdisjoint(terms):
                    x = {t: k * self.idf.get(t, self.other) for t, k in Counter(terms).items()}
                    best = max(best, sum(w * weights[t] for t, w in x.items() if t in weights) / (size * math.sqrt(sum(w * w for w in x.values()))))
            if best >= least:
                yield best, name, length

    def scan(self, text: bytes) -> tuple[str | None, float, float]:
        """Best template and its cosine over windows around anchors and stems, and the largest share of the text's terms in a window of that licence.

        A template of three terms, such as the words that go with many licences' copyright lines,
        counts only where no longer one reaches the threshold.
        """
        low = text.lower()
        raw = TERM.findall(low)
        if self.anchors.isdisjoint(raw):
            return None, 0.0, 0.0
        terms, starts = [t.decode() for t in raw], [m.start() for m in TERM.finditer(low)]
        stems = {max(0, bisect.bisect_right(starts, m.start()) - 1) for m in STEM.finditer(low)}
        met: dict[tuple, list] = {}
        for at in sorted(stems | {k for k, t in enumerate(raw) if t in self.anchors}):
            spans = []
            if at in stems:
                line = low.rfind(b"\n", 0, starts[at]) + 1, low.find(b"\n", starts[at])
                line = bisect.bisect_left(starts, line[0]), bisect.bisect_left(starts, line[1]) if line[1] >= 0 else len(terms)
                spans = [line, *((max(0, at - before), at + after) for before, after in WINDOWS)]
            for s, e in spans:
                if (key := (s, e) if e - s > 200 else tuple(terms[s:e])) not in met:
                    met[key] = [(*self.best(terms[s:e]), min(e, len(terms)) - s)]
            if raw[at] in self.anchors:
                first = max(0, at - self.longest)
                near = terms[first : at + self.longest]
                if (key := (at - first, *near)) not in met:
                    met[key] = list(self.slid(near, at - first))
        score, name, bare, shares = 0.0, None, (0.0, None), {}
        for cosine, which, length in (x for got in met.values() for x in got):
            if cosine >= self.threshold:
                shares[which] = max(shares.get(which, 0.0), length / len(terms))
            if length <= 3 and which == "Proprietary":
                bare = max(bare, (cosine, which))
            elif cosine > score + 1e-9:
                score, name = cosine, which
        if score < self.threshold and bare[0] > score:
            score, name = bare
        return name, score, min(1.0, shares.get(name, 0.0))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path", threshold: float = 0.6) -> DataFrame:
    """id, path, own (licence named in the text, null if none), score, is_licence_file.

    Whole texts are looked at. Cosines under threshold give null. A licence file is one named so
    by its path, or one whose notice is half its text. Null and empty texts have no licence; a
    null path is the empty one. Rows map one to one, so repeated rows get equal results. Of
    templates with equal cosines the one met first in the text counts, then the last by name.
    Extra columns are ignored; an empty table gives no rows.
    """
    n, df = document_frequencies(docs, text_col)
    matcher = Matcher(n, df, threshold)

    def rows(x):
        found = [matcher.scan(t) for t in x["t"]]
        hit = [s >= threshold for _, s, _ in found]
        return {"id": x["id"], "path": [p.decode() for p in x["path"]], "own": [name if h else None for (name, _, _), h in zip(found, hit)], "score": [round(s, 6) for _, s, _ in found], "share": [s for _, _, s in found]}

    got = per_row(docs.select(F.col(id_col).alias("id"), F.col(path_col).alias("path"), F.col(text_col).alias("t")), rows, "id bigint, path string, own string, score double, share double")
    named = F.col("own").isNotNull() & (F.col("path").rlike(LICENCE_FILE) | (F.col("share") >= 0.5))
    return got.select(F.col("id").alias(id_col), "path", "own", "score", named.alias("is_licence_file"))


def inherited(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """scanned with licence and licence_from: the row's own, else that of the nearest directory above with a licence file.

    A directory's licence is that of its file with the largest score, then the first name. Each
    distinct directory, not each file, is joined to its ancestors. A path without a slash lies
    in the root directory "". Files without either have null. Repeated rows are files of their
    own and get equal results; rows of a null id do so by their path. Extra columns of scanned
    are dropped; an empty table gives no rows.
    """
    at = scanned.withColumn("dir", F.regexp_replace("path", r"/?[^/]*$", ""))
    rank = F.struct((-F.col("score")).alias("s"), F.col("own").alias("own"))
    given = at.filter("is_licence_file").groupBy("dir").agg(F.min(rank)["own"].alias("given"))
    parts = F.split("dir", "/")
    dirs = at.select("dir").distinct().withColumn("depth", F.explode(F.sequence(F.lit(0), F.size(parts))))
    above = dirs.select("dir", "depth", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/").alias("up"))
    nearest = above.join(given.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(F.max(F.struct("depth", "up", "given")).alias("n"))
    out = at.join(nearest, "dir", "left")
    return out.select(
        id_col, "path", "own", "score", "is_licence_file",
        F.coalesce("own", F.col("n.given")).alias("licence"), F.when(F.col("own").isNull(), F.col("n.up")).alias("licence_from"),
    )
