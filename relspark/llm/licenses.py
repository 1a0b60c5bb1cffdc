"""License scans, in DataFrame functions only: MinHash bands over text windows retrieve templates, shingle containment verifies them.

Texts are lower-cased words of letters and digits; a shingle is five words. A template under five words is one shingle of all its words,
and the texts that hold the longest word of such a template are looked through in shingles of that width too. Windows of SCALES shingles overlap by half. A template (or,
where it is longer than half the widest window, each of its pieces) belongs to the narrowest scale whose half window holds it, so some
window contains it whole. A window and a template collide where one of BANDS one-row bands, each the least shingle under its own hash,
is equal. A template found at a containment of 0.8 or more fills at least an eighth of its window, so they collide with a probability
of at least 1 - (7/8)**BANDS > 1 - 1e-7. A band can only be equal where the template's own least shingle stands in the window, so
windows without any such shingle are passed over, which loses nothing. Candidates are verified by the exact share of the template's
shingles within reach of the window. Templates are a fixed list, so everything broadcast is bounded by it.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORDS, SCALES, BANDS, CONTAINMENT, CELL = 5, (8, 32, 128), 128, 0.8, 32

# Short notices and standard headers of public licenses.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    # Of these the words that tell them from their kin: BSD-2-Clause and the GPL headers share the rest.
    "BSD-3-Clause": "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "GPL-2.0-or-later": "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
    "LGPL-2.1-or-later": "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License",
    "LGPL-3.0-or-later": "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License",
    "AGPL-3.0-or-later": "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License",
    "BSD-3-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "MIT-license-notice": "Licensed under the MIT license.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so,",
    "BSL-1.0-notice": "Distributed under the Boost Software License, Version 1.0.",
    "Artistic-2.0-notice": "Licensed under the terms of the Artistic License 2.0.",
    "CDDL-1.0": "The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\"). You may not use this file except in compliance with the License.",
    "CC0-1.0": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
} | {
    f"{x}-spdx": f"SPDX-License-Identifier: {x}"
    for x in (
        "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "BSL-1.0", "Artistic-2.0",
        "CDDL-1.0", "EPL-2.0", "MIT OR Apache-2.0", "Apache-2.0 OR MIT", "GPL-2.0 OR MIT", "MIT OR GPL-2.0", "GPL-2.0 OR BSD-3-Clause", "BSD-3-Clause OR GPL-2.0", "GPL-2.0 OR BSD-2-Clause", "EPL-2.0 OR GPL-2.0",
    )
}
# Those under five words.
SHORT = {
    "All-rights-reserved": "All rights reserved.",
    "CC0-1.0-notice": "CC0 1.0 Universal",
    "MIT-spdx": "SPDX-License-Identifier: MIT",
    "ISC-spdx": "SPDX-License-Identifier: ISC",
    "Zlib-spdx": "SPDX-License-Identifier: Zlib",
}
# What tells a license from its kin: of each phrase a shingle that holds it whole has to stand, however much of the rest does.
MUST = {
    "MIT-notice": ["the MIT License"], "MIT-license-notice": ["the MIT license"], "Apache-2.0-notice": ["Apache License", "Version 2 0"], "Apache-2.0": ["Apache License"],
    "GPL-2.0-notice": ["GNU General Public", "version 2"], "GPL-3.0-notice": ["GNU General Public", "version 3"], "GPL-2.0-only": ["GNU General Public License version 2"],
    "GPL-2.0-or-later": ["GNU General Public", "version 2 of"], "GPL-3.0-or-later": ["GNU General Public", "version 3 of"], "AGPL-3.0-or-later": ["Affero", "version 3 of"],
    "LGPL-2.1-or-later": ["Lesser", "version 2 1 of"], "LGPL-3.0-or-later": ["Lesser", "version 3 of"], "CC-BY-4.0": ["Attribution 4 0"], "CC-BY-SA-4.0": ["ShareAlike 4 0"], "CC-BY-NC-4.0-notice": ["NC 4 0"],
    "MPL-2.0": ["Mozilla Public License"], "EPL-2.0": ["Eclipse Public License 2 0"], "BSL-1.0-notice": ["Boost Software License"], "Artistic-2.0-notice": ["Artistic License 2 0"], "CDDL-1.0": ["Common Development and Distribution License"],
}


def shingles(text: Column, width: int = WORDS) -> Column:
    """Hashes of a text's shingles of `width` words in order; fewer words: none."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def slide(h: Column) -> Column:
        return F.when(F.size(h) >= width, F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)]))).otherwise(F.expr("cast(array() as array<bigint>)"))

    return F.transform(F.array(F.transform(words, lambda w: F.xxhash64(w))), slide)[0]


def musts(name: str, text: str, width: int) -> list[list[str]]:
    """For each phrase that the template must have, its shingles (as texts) that hold the phrase whole; an SPDX line must stand whole.

    A phrase of more words than a shingle stands where each of its own shingles does.
    """
    w = _words(text)
    runs = [w[i : i + width] for i in range(len(w) - width + 1)]
    if name.endswith("-spdx"):
        return [[" ".join(r)] for r in runs]
    phrases = [p[i : i + width] for p in map(_words, MUST.get(name, [])) for i in range(max(1, len(p) - width + 1))]
    return [[" ".join(r) for r in runs if any(r[i : i + len(p)] == p for i in range(width - len(p) + 1))] for p in phrases]


def signature(window: Column) -> Column:
    """The least shingle of a window under each of BANDS hashes: BANDS bands of one row."""
    least = lambda i: F.array_min(F.transform(window, lambda x: F.struct(F.xxhash64(x, i).alias("h"), x.alias("x"))))["x"]
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), least)


def pieces(spark: SparkSession, templates: dict[str, str], width: int = WORDS) -> tuple[DataFrame, list[tuple[str, list[int]]]]:
    """(license, scale, signature) of each template piece, and each template's distinct shingles."""
    df = spark.createDataFrame(list(templates.items()), "license string, text string").select("license", shingles(F.col("text"), width).alias("s"))
    all_ = [(r["license"], list(dict.fromkeys(r["s"]))) for r in df.collect()]
    widest = SCALES[-1] // 2
    cut = [(name, next(k for k in SCALES if k // 2 >= min(len(s), widest)), s[i : i + widest]) for name, s in all_ for i in range(0, len(s), widest)]
    return spark.createDataFrame(cut, "license string, scale int, s array<bigint>").select("license", "scale", signature(F.col("s")).alias("signature")), all_


def _words(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, license, containment, n_windows, best: one row for each license found in a document.

    containment: the greatest share of the template's distinct shingles near one of its n_windows colliding windows. best: in some window
    no other template that overlaps it is held better, as a notice is by the text that quotes it or one license by its kin. A license whose
    distinguishing words (MUST: name, version) do not stand is not found, whatever its share. Null and empty texts have no row, an empty
    table has none. A text's shingles are held as one array, however long it is. Repeated rows give repeated rows, ids that differ only in text are kept apart. Other columns are not looked at.
    A template without a word is never found.
    """
    groups: dict[int, dict[str, str]] = {}
    for name, t in (templates or TEMPLATES | SHORT).items():
        groups.setdefault(min(len(_words(t)), WORDS), {})[name] = t
    docs, out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), []
    for width, group in groups.items():
        if 0 < width < WORDS:  # a found template stands in the text as a whole, its longest word too
            words = sorted({max(_words(t), key=len) for t in group.values()})
            out.append(_scan(docs.where(reduce(or_, [F.lower("text").contains(w) for w in words])), group, width, containment))
        elif width:
            out.append(_scan(docs, group, width, containment))
    return reduce(DataFrame.unionAll, out) if out else _scan(docs.limit(0), TEMPLATES, WORDS, containment)


def _scan(docs: DataFrame, templates: dict[str, str], width: int, containment: float) -> DataFrame:
    """scan() for templates of one shingle width."""
    spark = docs.sparkSession
    parts, all_ = pieces(spark, templates, width)
    held = parts.collect()  # a fixed list
    literal = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>")
    asked = [(name, i, s) for name, text in templates.items() for i, group in enumerate(musts(name, text, width)) for s in group]
    hashed = spark.createDataFrame(asked, "license string, i int, s string").select("license", "i", shingles(F.col("s"), width)[0].alias("h")).collect() if asked else []
    must: dict[str, dict[int, list[int]]] = {}
    for r in hashed:
        must.setdefault(r["license"], {}).setdefault(r["i"], []).append(r["h"])
    anchors = {k: sorted({x for r in held if r["scale"] == k for x in r["signature"]}) for k in SCALES}
    reach = max((len(s) for _, s in all_), default=0)
    df = docs.select("doc_id", shingles(F.col("text"), width).alias("s")).withColumn("row", F.monotonically_increasing_id())
    df = df.where(F.arrays_overlap("s", literal(sorted({x for v in anchors.values() for x in v}))))

    def starts(scale: int) -> Column:
        """Starts of the scale's windows that hold an anchor: multiples of half a window."""
        half = scale // 2
        at = F.filter(F.transform("s", lambda x, i: F.when(F.array_contains(literal(anchors[scale]), x), i)), lambda i: i.isNotNull())
        both = F.flatten(F.transform(at, lambda i: F.array((F.floor(i / half) * half).cast("int"), (F.floor(i / half) * half - half).cast("int"))))
        return F.transform(F.array_distinct(F.filter(both, lambda i: i >= 0)), lambda i: F.struct(F.lit(scale).alias("scale"), i.alias("start")))

    used = [k for k in SCALES if anchors[k]]
    windows = df.select("row", "doc_id", "s", F.explode(F.concat(*[starts(k) for k in used])).alias("w"))
    near = F.slice("s", F.greatest(F.col("w.start") - reach, F.lit(0)) + 1, F.col("w.scale") + 2 * reach)
    windows = windows.select("row", "doc_id", "w.scale", "w.start", near.alias("near"), signature(F.slice("s", F.col("w.start") + 1, F.col("w.scale"))).alias("signature"))
    bands = parts.select("license", "scale", F.posexplode("signature").alias("band", "value"))
    hits = windows.select("row", "doc_id", "scale", "start", "near", F.posexplode("signature").alias("band", "value")).join(F.broadcast(bands), ["scale", "band", "value"])
    full = F.create_map(*[x for name, s in all_ for x in (F.lit(name), literal(s) if s else F.expr("cast(array() as array<bigint>)"))])
    share = F.size(F.array_intersect("near", F.element_at(full, F.col("license")))) / F.size(F.element_at(full, F.col("license")))
    hits = hits.withColumn("share", share).where(F.col("share") >= containment)
    for name, groups in must.items():
        hits = hits.where((F.col("license") != name) | reduce(and_, [F.arrays_overlap("near", literal(sorted(g))) for g in groups.values()]))
    # Of templates found about one place the best has the greatest share, then the most shingles.
    rank = F.struct("share", F.size(F.element_at(full, F.col("license"))).alias("size"))
    cells = F.sequence(F.floor(F.col("start") / CELL), F.floor((F.col("start") + F.col("scale") - 1) / CELL))
    hits = hits.select("row", "doc_id", "license", "scale", "start", "share", rank.alias("rank"), F.explode(cells).alias("cell"))
    hits = hits.withColumn("top", F.max("rank").over(Window.partitionBy("row", "cell")))
    hits = hits.groupBy("row", "license", "scale", "start").agg(F.first("doc_id").alias("doc_id"), F.first("share").alias("share"), F.min(F.col("rank") == F.col("top")).alias("best"))
    found = hits.groupBy("row", "license").agg(F.first("doc_id").alias("doc_id"), F.max("share").alias("containment"), F.count(F.lit(1)).alias("n_windows"), F.max("best").alias("best"))
    return found.select("doc_id", "license", "containment", "n_windows", "best")
