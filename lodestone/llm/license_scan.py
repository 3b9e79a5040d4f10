"""License notices in texts, found by MinHash and verified by their shingles.

Shingles are three words. Texts are cut into windows of two neighbouring blocks of shingles, which
overlap by one block, and templates into pieces of at most a block and one, so that a piece that occurs
lies wholly within a window. Windows and pieces that agree in one of the MinHash bands meet; with
bands of one value each, those of similarity s meet but for a chance of (1 - s) ** bands. The bands'
permutations are exclusive-ors of uniform hashes. What has met is verified: at least four fifths of the
template's shingles must stand together in the text. Only DataFrame functions are used.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, functions as F

from lodestone.llm.common import stored

GRAM = 3
BLOCK = 4
BANDS = 16
CONTAINED = 0.8
# Band keys of templates that are looked up within the row; with more, keys are joined as rows.
INLINE_KEYS = 4096

# fixed values: notices as they stand in files
NOTICES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "mit": "Released under the MIT License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
    " and associated documentation files, to deal in the Software without restriction",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided"
    " that the following conditions are met",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance"
    " with the License. You may obtain a copy of the License at",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public"
    " License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public"
    " License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "lgpl-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General"
    " Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "agpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public"
    " License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,"
    " provided that the above copyright notice and this permission notice appear in all copies.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,"
    " compile, sell, or distribute this software, either in source code form or as a compiled binary",
    "bsl-1.0-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and"
    " accompanying documentation covered by this license",
    "zlib-notice": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable"
    " for any damages arising from the use of this software.",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
}
# fixed values: names of licenses in tags
TAGGED = [
    "MIT", "ISC", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "EPL-2.0", "BSL-1.0", "Zlib", "Unlicense", "CC0-1.0", "CC-BY-4.0",
    "CC-BY-SA-4.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later",
    "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later",
]
TAG = "SPDX-License-Identifier: {name}"


def miss_chance(similarity: float, bands: int = BANDS) -> float:
    """Chance that a window and a piece of a similarity agree in no band."""
    return (1 - similarity) ** bands


def _constants(bands: int) -> list[int]:
    """Numbers that part the hash range evenly, one in each part."""
    out = []
    for i in range(bands):
        x = (i * 0x9E3779B97F4A7C15 + 0x2545F4914F6CDD1D) & ((1 << 64) - 1)
        x = (i << 60 if bands == 16 else x) ^ (x >> 4)
        out.append(x - (1 << 64) if x >> 63 else x)
    return out


def _shingles(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Hashes of the shingles of a text in order, in ``_h``; a text of fewer words has all of them as one.

    Texts without words are left out here, by the text itself: a filter on ``_h`` would be pushed below
    and work out the words again for every shingle.
    """
    df = df.filter(F.col(text).rlike(r"[\p{L}\p{N}]"))
    words = F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    held = df.select(*keep, words.alias("_words"))
    last = F.greatest(F.size("_words") - GRAM, F.lit(0))
    hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get("_words", i + j) for j in range(GRAM)]))
    return held.select(*keep, hashes.alias("_h"))


def _least(hashes: Column, constant: int) -> Column:
    """The hash that comes first in one permutation."""
    return F.array_min(F.transform(hashes, lambda h: h.bitwiseXOR(F.lit(constant).cast("long"))))


def _least_by(constant: int):
    return lambda hashes: _least(hashes, constant)


def _template_keys(templates: DataFrame, id: str, text: str, bands: int) -> DataFrame:
    """``_template``, its distinct shingles, their number, and the keys of its pieces by band."""
    held = _shingles(templates.select(F.col(id).alias("_template"), text), text, ["_template"])
    held = held.withColumn("_n", F.size("_h"))
    many = F.ceil(F.col("_n") / (BLOCK + 1)).cast("int")
    # pieces of nearly equal length
    piece = F.transform(
        F.sequence(F.lit(0), many - 1),
        lambda i: F.slice("_h", (i * F.col("_n") / many).cast("int") + 1, ((i + 1) * F.col("_n") / many).cast("int") - (i * F.col("_n") / many).cast("int")),
    )
    pieces = held.select("_template", F.array_distinct("_h").alias("_t"), "_n", F.explode(piece).alias("_piece"))
    keys = F.array(*[F.xxhash64(F.lit(b), _least(F.col("_piece"), c)) for b, c in enumerate(_constants(bands))])
    return pieces.select("_template", "_t", "_n", F.posexplode(keys).alias("_band", "_key")).distinct()


def scan_licenses(
    docs: DataFrame, templates: DataFrame, id: str = "doc_id", text: str = "text", template_id: str = "license", template_text: str = "text",
    bands: int = BANDS, contained: float = CONTAINED, inline_keys: int = INLINE_KEYS,
) -> DataFrame:
    """One row per document and template found: id, ``license``, ``contained``, ``n_places``, ``first_shingle``.

    ``contained`` is the largest share of the template's shingles that stand together (within its
    length and a window's), ``first_shingle`` the start of the first such place, counted from 0 and
    rounded down to a block, and ``n_places`` the number of windows that led to one. Rows that share an id are
    one document; rows without one are reported together under null. Null and empty texts hold nothing, nor do
    templates without words. A very long text is scanned whole. Templates that share an id are variants of one; of templates
    that differ in few words each is reported with its own share, so the largest tells which it is. Equal rows count once.
    Other columns are not read.
    """
    keys = stored(_template_keys(templates, template_id, template_text, bands))
    by_key = keys.select("_band", "_key").distinct()
    n_keys = by_key.count()
    keys = keys.drop("_band")
    held = _shingles(docs.select(F.col(id).alias("_id"), text), text, ["_id"])
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("_h") - 1) / BLOCK).cast("int")), lambda i: F.slice("_h", i * BLOCK + 1, BLOCK))
    held = held.select("_id", "_h", blocks.alias("_blocks"))
    held = held.select("_id", "_h", *[F.transform("_blocks", _least_by(c)).alias(f"_m{i}") for i, c in enumerate(_constants(bands))])
    both = lambda i: F.transform(f"_m{i}", lambda m, at: F.xxhash64(F.lit(i), F.least(m, F.get(f"_m{i}", at + 1))))
    # least() passes over the null after the last block
    held = held.select("_id", "_h", F.array(*[both(i) for i in range(bands)]).alias("_k"))
    # rows of a generator: filters on them stay above it, so that nothing is worked out twice
    one = held.select("_id", F.inline_outer(F.array(F.struct("_h", "_k"))))
    if n_keys <= inline_keys:
        wanted: list[list[int]] = [[] for _ in range(bands)]
        for r in by_key.collect():
            wanted[r["_band"]].append(r["_key"])
        of_band = F.lit(wanted).cast("array<array<bigint>>")
        one = one.withColumn("_hits", F.transform("_k", lambda k, band: F.array_intersect(k, F.get(of_band, band)))).filter(F.exists("_hits", lambda h: F.size(h) > 0))
    bandwise = one.select("_id", "_h", F.explode("_k").alias("_row"))
    entries = bandwise.select("_id", "_h", F.posexplode("_row").alias("_at", "_key"))
    if n_keys <= inline_keys:
        met = entries.join(F.broadcast(keys), "_key")
    else:
        met = entries.join(keys, "_key")
    start = F.greatest(F.col("_at") * BLOCK - F.col("_n"), F.lit(0))
    near = F.slice("_h", start + 1, F.least(2 * F.col("_n") + 2 * BLOCK, F.size("_h") - start))
    share = F.size(F.array_intersect("_t", near)) / F.size("_t")
    found = met.select("_id", "_template", "_at", share.alias("_share")).filter(F.col("_share") >= contained)
    return found.groupBy(F.col("_id").alias(id), F.col("_template").alias("license")).agg(
        F.max("_share").alias("contained"), F.countDistinct("_at").alias("n_places"), (F.min("_at") * BLOCK).cast("int").alias("first_shingle")
    )


def notices(spark) -> DataFrame:
    """The usual notices and tags as a table."""
    tags = [(f"spdx:{name}", TAG.format(name=name)) for name in TAGGED]
    return spark.createDataFrame([*NOTICES.items(), *tags], "license string, text string")
