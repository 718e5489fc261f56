"""License notices in documents, retrieved by MinHash bands and verified by exact shingle containment.

DataFrame operations only.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import CONSTANTS, constants, words
from .scratch import BROADCAST_BYTES, joined, measured, stored

#: Notices as their publishers word them, long licenses in several named parts.
TEMPLATES = {
    "mit-line": "Released under the MIT License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "mit-0": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND",
    "apache-2-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache-2-limits": "See the License for the specific language governing permissions and limitations under the License.",
    "gpl-3-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-2-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-2-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "gpl-received": "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    "lgpl-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl-3": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl-3": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "fdl-1.3": "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation; with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-2-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-3-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-4-advertising": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "bsd-warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "bsd-liability": "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY",
    "bsd-0": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE",
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "mpl-1.1": "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/",
    "epl-2": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "cddl": "The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\"). You may not use this file except in compliance with the License.",
    "eupl-1.2": "Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL (the \"Licence\"); You may not use this work except in compliance with the Licence.",
    "cc-by-line": "Licensed under CC BY 4.0.",
    "cc-by-sa-line": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-nd-line": "Licensed under CC BY-ND 4.0.",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-nd": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "cc-by-nc-sa": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "cc-by-nc-nd": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "cc-by-sa-3": "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
    "boost": "Distributed under the Boost Software License, Version 1.0.",
    "wtfpl": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
    "public-domain-line": "This work is in the public domain.",
    "all-rights-reserved-line": "All rights reserved.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
}

#: Words of a shingle, and shingles of a window.
SHINGLE, WINDOW = 5, 4
#: Each band's masks.  The least of hashes x under x XOR mask is a MinHash for each mask.
BANDS = ((0x1B873593CC9E2D51, -0x61C8864680B583EB), (0x52DCE729A0761D64, -0x2917014799A6026D))


def templates(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """template and text of each notice."""
    return spark.createDataFrame(sorted((TEMPLATES if texts is None else texts).items()), "template string, text string")


def _notices(notices: DataFrame) -> DataFrame:
    """template, words w, length, the shingles' hashes (one, of all words, for a notice of fewer than five) and distinct shingles."""
    cut = notices.select("template", words(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("w")).filter(F.size("w") > 0).select("*", F.size("w").alias("length"))
    each = F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("length") - SHINGLE + 1))
    return stored(cut.select(
        "template", "w", "length", F.transform(each, lambda i: F.xxhash64(F.slice("w", i, SHINGLE))).alias("hashes"),
        F.array_distinct(F.transform(each, lambda i: F.array_join(F.slice("w", i, SHINGLE), " "))).alias("shingles"),
    ))


def _set(values: list) -> str:
    return ", ".join("bigint(-9223372036854775808)" if v == -(1 << 63) else f"{v}L" if isinstance(v, int) else f"'{v}'" for v in values) or "null"


def _marked(docs: DataFrame, known: DataFrame, most: int) -> DataFrame:
    """One pass over the texts: doc_id, text_hash, first, words w from there on, and marks and shorts, of rows that have some.

    marks are the places, from 1, of shingles that a notice has; shorts those
    of notices of fewer than five words.  A window without a mark collides
    with none of a notice.  Shingles are looked up only around anchors: the
    longest word of each shingle of a notice.  w reaches a notice's length
    beyond the outer marks.
    """
    longest = known.agg(F.max("length")).first()[0] or 0
    pad = longest + longest // 5 + SHINGLE + WINDOW
    each = known.select("length", F.explode("shingles").alias("s"))
    anchor = F.array_max(F.transform(F.split("s", " "), lambda x: F.struct(F.char_length(x).alias("n"), x.alias("x"))))["x"]
    anchors = constants(each.select(anchor), most)
    long = constants(known.filter(F.col("length") >= SHINGLE).select(F.explode("hashes")), most)
    short = {n: constants(known.filter(F.col("length") == n).select(F.explode("shingles")), most) for n in range(1, SHINGLE)}
    anchored = anchors is not None and long is not None and None not in short.values()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), words(text).alias("w"))
    # No filter stands above these columns: the optimizer would compute them below it, and w anew at each use.
    all_of = "if(size(w) > 0, sequence(1, size(w)), array())"
    rows = rows.withColumn("spots", F.expr(f"filter({all_of}, i -> w[i - 1] IN ({_set(anchors)}))" if anchored else all_of))
    around = lambda n: f"if(size(w) < {n}, array(), array_distinct(flatten(transform(spots, i -> sequence(greatest(1, i - {n - 1}), least(i, size(w) - {n - 1}))))))"
    wanted = f"filter({around(SHINGLE)}, p -> xxhash64(slice(w, p, {SHINGLE})) IN ({_set(long)}))" if anchored else around(SHINGLE)
    some = [
        f"transform(filter({around(n)}, p -> array_join(slice(w, p, {n}), ' ') IN ({_set(short[n])})), p -> named_struct('at', p, 'length', {n}))"
        if anchored else f"transform({around(n)}, p -> named_struct('at', p, 'length', {n}))"
        for n in range(1, SHINGLE) if short[n] != []
    ]
    rows = rows.withColumns({"marks": F.expr(wanted), "shorts": F.expr(f"concat({', '.join(some)})" if some else "cast(array() as array<struct<at:int,length:int>>)")})
    low = f"greatest(0, least(array_min(marks), array_min(transform(shorts, x -> x.at))) - {pad})"
    high = f"greatest(array_max(marks), array_max(transform(shorts, x -> x.at))) + {pad}"
    cut = f"array(named_struct('first', {low}, 'w', slice(w, {low} + 1, {high} - {low}), 'marks', marks, 'shorts', shorts))"
    rows = rows.withColumn("found", F.expr(f"if(size(marks) + size(shorts) > 0, {cut}, array())")).select("doc_id", "text_hash", F.explode_outer("found").alias("f"))
    return stored(rows.filter("f is not null").select("doc_id", "text_hash", "f.*"))


def _band(size: int, band: int) -> str:
    """The name of a band of size hashes h."""
    masks = BANDS[band] if size == WINDOW else BANDS[band][:1]
    least = [f"least({', '.join(f'h[{k}] ^ {m}L' for k in range(size))})" if size > 1 else f"h[0] ^ {m}L" for m in masks]
    return f"xxhash64({size}, {band}, {', '.join(least)})"


def _bands(places: str, hashed: str, size: int) -> str:
    """at (from 0) and band of each of the windows of size shingles at places; hashed: the hash of the shingle at place p."""
    each = ", ".join(f"named_struct('at', p - 1, 'band', {_band(size, band)})" for band in range(len(BANDS) if size == WINDOW else 1))
    hashes = f"array({', '.join(hashed.replace('p', f'(p + {k})', 1) for k in range(size))})"
    return f"flatten(transform({places}, p -> flatten(transform(array({hashes}), h -> array({each})))))"


def _long(marked: DataFrame, known: DataFrame, containment: float, limit: int) -> DataFrame:
    known = known.filter(F.col("length") >= SHINGLE)
    sizes = sorted(r[0] for r in known.select(F.least(F.size("hashes"), F.lit(WINDOW))).distinct().collect())  # WINDOW values at most
    if not sizes:
        return marked.select("doc_id", F.lit("").alias("template"), F.lit(0.0).alias("containment"), F.lit(0).alias("first_word")).filter(F.lit(False))
    # A notice has one size of windows: all of its shingles, or WINDOW of them at every place.
    signs = None
    for size in sizes:
        mine = known.filter(F.least(F.size("hashes"), F.lit(WINDOW)) == size)
        mine = mine.select("template", "length", F.expr(_bands(f"sequence(1, size(hashes) - {size - 1})", "hashes[p - 1]", size)).alias("b"))
        mine = mine.select("template", "length", F.inline_outer("b"))
        signs = mine if signs is None else signs.unionByName(mine)
    signs = stored(signs.select("template", "length", F.col("at").alias("offset"), "band").distinct())
    longest = known.agg(F.max("length")).first()[0]
    pad = longest + longest // 5 + SHINGLE + WINDOW
    places = lambda s: f"if(size(w) + first < {s + 4}, array(), array_distinct(flatten(transform(marks, m -> sequence(greatest(1, m - {s - 1}), least(m, size(w) + first - {s + 3}))))))"
    windows = marked.filter(F.size("marks") > 0).withColumn("b", F.expr(f"concat({', '.join(_bands(places(s), f'xxhash64(slice(w, p - first, {SHINGLE}))', s) for s in sizes)})"))
    windows = windows.select("doc_id", "text_hash", "first", "w", F.inline_outer("b")).filter("band is not null")
    if measured(signs) <= limit:
        hits = windows.join(F.broadcast(signs), "band")
    else:  # the words around a window travel, not those of the text
        low = F.greatest(F.lit(0), F.col("at") - F.col("first") - pad)
        near = windows.select("doc_id", "text_hash", "at", "band", (F.col("first") + low).alias("first"), F.slice("w", low + 1, F.lit(2 * pad)).alias("w"))
        hits = near.join(signs, "band")
    slack = F.floor(F.col("length") / 5).cast("int")
    place = F.col("at") - F.col("offset")
    low = F.greatest(F.lit(0), place - slack - F.col("first"))
    stretch = F.slice("w", low + 1, F.greatest(F.lit(0), place + F.col("length") + slack - F.col("first") - low))
    found = hits.select("doc_id", "text_hash", "template", place.alias("place"), stretch.alias("stretch"))
    found = found.groupBy("doc_id", "text_hash", "template", "place").agg(F.first("stretch").alias("stretch")).filter(F.size("stretch") >= SHINGLE)
    found = joined(found, known.select("template", "shingles"), ["template"], "inner", F.struct("text_hash", "place"), limit)
    there = F.transform(F.sequence(F.lit(1), F.size("stretch") - SHINGLE + 1), lambda i: F.array_join(F.slice("stretch", i, SHINGLE), " "))
    share = F.size(F.array_intersect("shingles", there)) / F.size("shingles")
    found = found.select("doc_id", "text_hash", "template", "place", share.alias("share")).filter(F.col("share") >= containment)
    best = found.groupBy("doc_id", "text_hash", "template").agg(F.max("share").alias("containment"), F.greatest(F.lit(0), F.min("place")).cast("int").alias("first_word"))
    return best.select("doc_id", "template", "containment", "first_word")


def _short(marked: DataFrame, known: DataFrame, limit: int) -> DataFrame:
    known = known.filter(F.col("length") < SHINGLE).select("template", "length", F.element_at("shingles", 1).alias("notice")).distinct()
    each = marked.select("doc_id", "text_hash", "first", "w", F.inline_outer("shorts")).filter("at is not null")
    each = each.select("doc_id", "text_hash", "at", "length", F.array_join(F.slice("w", F.col("at") - F.col("first"), F.col("length")), " ").alias("notice"))
    known = stored(known)
    hits = each.join(F.broadcast(known) if measured(known) <= limit else known, ["notice", "length"])
    best = hits.groupBy("doc_id", "text_hash", "template").agg(F.min(F.col("at") - 1).cast("int").alias("first_word"))
    return best.select("doc_id", "template", F.lit(1.0).alias("containment"), "first_word")


def find(docs: DataFrame, notices: DataFrame, containment: float = 0.8, limit: int = BROADCAST_BYTES, most: int = CONSTANTS) -> DataFrame:
    """The notices (template, text) of five words or more that each row of docs (doc_id, text) holds.

    Words are those of the decontamination operator.  A window is four
    consecutive shingles of five words, at every place; a notice with fewer
    shingles is one window.  Windows that agree in a band of the MinHash
    signature (two bands of two rows) retrieve the notice and its place.  Then
    the stretch of text there, a fifth of the notice longer on both sides,
    must hold at least that share of the notice's distinct shingles.  A window
    that is whole collides surely; a stretch that holds four fifths of a notice
    in its order has one.  Signatures are made only of windows that hold a
    shingle of a notice, as others can't collide.  Returns doc_id, template,
    containment (the best of the row's) and first_word (the least place, in
    words from 0), a row for each template found.  Null texts find nothing;
    rows with equal doc_id and text are one; other columns are not used.
    """
    known = _notices(notices)
    return _long(_marked(docs, known, most), known, containment, limit)


def find_short(docs: DataFrame, notices: DataFrame, limit: int = BROADCAST_BYTES, most: int = CONSTANTS) -> DataFrame:
    """The notices of one to four words that each row of docs holds, as find() gives longer ones.

    Such a notice is one shingle of its own length, so it is there whole or
    not at all.
    """
    known = _notices(notices)
    return _short(_marked(docs, known, most), known, limit)


def find_all(docs: DataFrame, notices: DataFrame, containment: float = 0.8, limit: int = BROADCAST_BYTES, most: int = CONSTANTS) -> DataFrame:
    """The notices of any length that each row of docs holds, with one pass over the texts."""
    known = _notices(notices)
    marked = _marked(docs, known, most)
    return _long(marked, known, containment, limit).unionByName(_short(marked, known, limit))
