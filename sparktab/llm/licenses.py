"""License scans by MinHash bands over overlapping text windows, with DataFrame functions only.

Words are as in decontaminate.py; shingles are SHINGLE consecutive words (a shorter template is one shingle of all its
words). A template of n words is sought in windows of W words, W the least power of two of 2 * n or more, that start every
W / 2 words, so each occurrence lies whole in a window. A window and a template meet where one of BANDS bands of a single
minimum hash each is equal. A window that holds LEAST per cent of a template's shingles has similarity 1/12 at least with
it, so it shares a band with a chance above 1 - 1e-6. Whether it holds that many is then counted exactly.

A band of a window can equal a template's only if the window holds the shingle with the template's minimum hash. So minimum
hashes are computed for windows that hold such a shingle, and of these only until a band is equal; the pairs that meet are
those that all bands of all windows would give.

scan() takes its templates as an argument, id to text; without one it seeks USUAL, the twelve short notices of TEMPLATES and
those of license_texts.py, whose docstring says what they cover. op9_licenses seeks USUAL, op9_notices TEMPLATES alone.
Templates are a table of few rows, broadcast.

Defined results: null, empty and wordless texts have no licences; rows that share doc_id and text get one result each; an
empty table gives an empty result; other columns are not looked at; texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialise, text_hash
from .decontaminate import words
from .license_texts import MORE

SHINGLE, BANDS, LEAST = 5, 160, 80
#: Short notices of public licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-notice": "Use of this source code is governed by a BSD-style license",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "MIT": "Released under the MIT License",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}
#: What scan() seeks by default.
USUAL = TEMPLATES | MORE


def _shingled(df: DataFrame, n: int, out: str) -> DataFrame:
    """Adds the hashes of all shingles of n words; df has word hashes in h."""
    tail = F.slice("h", F.lit(1), F.greatest(F.size("h") - F.lit(n - 1), F.lit(0)))
    return df.withColumn(out, F.transform(tail, lambda x, i: F.xxhash64(F.lit(n), x, *[F.get("h", i + j) for j in range(1, n)])))


def _prepared(df: DataFrame) -> DataFrame:
    df = df.withColumn("w", words(F.col("text")))
    return df.withColumn("h", F.transform("w", lambda x: F.xxhash64(x))).withColumn("n_words", F.size("w"))


def templates(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """license, span (words of its windows), n (words of its shingles), shingles (distinct hashes)."""
    rows = F.array(*[F.struct(F.lit(k).alias("license"), F.lit(v).alias("text")) for k, v in texts.items()])
    df = _prepared(spark.range(1).select(F.explode(rows).alias("t")).select("t.*"))
    parts = None
    for n in range(1, SHINGLE + 1):
        some = _shingled(df.where(F.least("n_words", F.lit(SHINGLE)) == n), n, "all")
        some = some.select("license", F.pow(F.lit(2), F.ceil(F.log2(F.col("n_words") * 2))).cast("int").alias("span"), F.lit(n).alias("n"), F.array_distinct("all").alias("shingles"))
        parts = some if parts is None else parts.unionByName(some)
    return materialise(parts)


def _bands(shingles: str):
    """BANDS structs of a band's number, the least hash under its seed, and the shingle that has it."""

    def least(b: int):
        return F.array_min(F.transform(shingles, lambda x: F.struct(F.xxhash64(F.lit(b), x).alias("least"), x.alias("of"))))

    return F.array(*[F.struct(F.lit(b).alias("band"), least(b)["least"].alias("least"), least(b)["of"].alias("of")) for b in range(BANDS)])


def _in(own: list[int]) -> str:
    return "({})".format(", ".join(f"{x}L" if x > -(1 << 63) else "(-9223372036854775807L - 1L)" for x in own))


def _windows(span: int, n: int, own: list[int]):
    """The windows of span words that hold one of own wholly, with their distinct shingles of n words."""
    hits = F.expr(f"filter(hit{n}, t -> t.x IN {_in(own)})")
    half = span // 2
    last = F.transform(hits, lambda t: F.floor(t["i"] / F.lit(half)).cast("int"))
    first = F.transform(hits, lambda t: F.greatest(F.ceil((t["i"] + F.lit(n - span)) / F.lit(half)), F.lit(0)).cast("int"))
    inside = lambda k: F.array_distinct(F.slice(f"s{n}", k * F.lit(half) + 1, F.lit(span - n + 1)))
    return F.transform(F.array_distinct(F.concat(last, first)), lambda k: F.struct(F.lit(span).alias("span"), F.lit(n).alias("n"), (k * F.lit(half)).alias("start"), inside(k).alias("shingles")))


def scan(docs: DataFrame, texts: dict[str, str] | None = None) -> DataFrame:
    """doc_id, text_key, copies, n_words, matches: (license, best containment in per cent, start of that window), by license.

    texts are the templates to seek, id to text (USUAL by default).
    """
    spark = docs.sparkSession
    known = materialise(templates(spark, USUAL if texts is None else texts).withColumn("bands", _bands("shingles")))
    # as few rows as the templates' lengths; the shingles that have a template's minimum hash
    kinds = known.groupBy("span", "n").agg(F.array_distinct(F.flatten(F.collect_list("bands.of"))).alias("s"))
    kinds = [(r["span"], r["n"], r["s"]) for r in kinds.collect()]
    df = _prepared(docs.select("doc_id", "text", text_hash(F.col("text")).alias("text_key")))
    sizes = sorted({n for _, n, _ in kinds})
    for n in sizes:
        df = _shingled(df, n, f"s{n}")
        every = sorted({x for _, size, own in kinds if size == n for x in own})
        df = df.withColumn(f"hit{n}", F.expr(f"filter(transform(s{n}, (x, i) -> struct(i AS i, x AS x)), t -> t.x IN {_in(every)})"))
    windows = []
    for span, n, own in kinds:
        df = df.withColumn(f"w{span}_{n}", _windows(span, n, own))
        windows.append(F.col(f"w{span}_{n}"))
    itself = F.array(F.struct(F.lit(0).alias("span"), F.lit(0).alias("n"), F.lit(0).alias("start"), F.array().cast("array<bigint>").alias("shingles")))
    df = df.select("doc_id", "text_key", F.col("n_words").cast("long").alias("n_words"), F.explode_outer(F.concat(itself, *windows)).alias("x"))
    df = df.select("doc_id", "text_key", "n_words", "x.*")
    # windows meet templates, and what they hold is counted, before anything is shuffled or written
    wanted = F.broadcast(known.select("license", F.col("span").alias("k_span"), F.col("n").alias("k_n"), F.col("shingles").alias("of"), "bands"))
    pairs = df.join(wanted, (F.col("span") == F.col("k_span")) & (F.col("n") == F.col("k_n")), "left")
    least = lambda b: F.array_min(F.transform("shingles", lambda x: F.xxhash64(b["band"], x)))
    meets = F.exists(F.filter("bands", lambda b: F.array_contains("shingles", b["of"])), lambda b: least(b) == b["least"])
    held = F.size(F.array_intersect("of", "shingles"))
    pairs = pairs.where((F.col("span") == 0) | (F.arrays_overlap("shingles", F.col("bands.of")) & meets))
    pairs = pairs.withColumn("held", F.when(F.col("span") > 0, held)).where((F.col("span") == 0) | (F.col("held") * 100 >= F.size("of") * LEAST))
    held = F.floor(F.col("held") * 100 / F.size("of")).cast("int").alias("held")
    found = materialise(pairs.select("doc_id", "text_key", "n_words", "span", "license", "start", held))
    base = found.where("span = 0").groupBy("doc_id", "text_key", "n_words").agg(F.count("*").alias("copies"))
    pairs = found.where("span > 0")
    best = F.max(F.struct("held", (-F.col("start")).alias("back"))).alias("best")
    best = pairs.groupBy("doc_id", "text_key", "license").agg(best).groupBy("doc_id", "text_key")
    best = best.agg(F.sort_array(F.collect_list(F.struct("license", F.col("best.held").alias("contained"), (-F.col("best.back")).alias("start")))).alias("matches"))
    b, m = base.alias("b"), best.alias("m")
    out = b.join(m, F.col("b.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("b.text_key") == F.col("m.text_key")), "left")
    return out.select("b.doc_id", "b.text_key", "copies", "n_words", F.coalesce("matches", F.array().cast("array<struct<license:string,contained:int,start:int>>")).alias("matches"))


def _listed(found: DataFrame) -> DataFrame:
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    each = F.transform("matches", lambda x: F.concat_ws(":", x["license"], x["contained"].cast("string"), x["start"].cast("string")))
    return found.select("doc_id", "n_words", F.size("matches").cast("long").alias("n_licenses"), F.array_join(each, ",").alias("licenses"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_licenses, licenses (ids with the share held and the window's start) for every document."""
    return _listed(scan(documents(spark, sf_dir, "doc_id", "text")))


def op9_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9_licenses with the short notices of TEMPLATES alone."""
    return _listed(scan(documents(spark, sf_dir, "doc_id", "text"), TEMPLATES))


_ROWS = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in TEMPLATES.items())
_LIST = "regexp_extract_all(translate(COALESCE({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE_NOTICES = f"""
WITH t0 AS (SELECT license, {_LIST.format("text")} AS w FROM (VALUES {_ROWS}) AS v(license, text)),
t AS (SELECT license, w, LEAST(len(w), {SHINGLE}) AS n, CAST(pow(2, CEIL(LOG2(2 * len(w)))) AS BIGINT) AS span FROM t0),
ts AS (SELECT DISTINCT license, n, span, array_to_string(w[p : p + n - 1], ' ') AS s FROM (SELECT *, UNNEST(range(1, len(w) - n + 2)) AS p FROM t)),
tn AS (SELECT license, COUNT(*) AS m FROM ts GROUP BY license),
d AS (SELECT doc_id, {_LIST.format("text")} AS w FROM documents),
ds AS (SELECT doc_id, n, p, array_to_string(w[p + 1 : p + n], ' ') AS s
  FROM (SELECT doc_id, w, n, UNNEST(range(0, len(w) - n + 1)) AS p FROM d, (SELECT DISTINCT n FROM ts) WHERE len(w) >= n)),
h AS (SELECT doc_id, license, span, ts.s, p, ds.n, UNNEST([p // (span // 2), p // (span // 2) - 1]) AS k FROM ds JOIN ts ON ds.s = ts.s AND ds.n = ts.n),
c AS (SELECT doc_id, license, k * (span // 2) AS start, COUNT(DISTINCT s) AS held FROM h
  WHERE k >= 0 AND p + n <= k * (span // 2) + span GROUP BY doc_id, license, k * (span // 2)),
g AS (SELECT doc_id, license, CAST(floor(held * 100 / m) AS BIGINT) AS contained, start FROM c JOIN tn USING (license) WHERE held * 100 >= m * {LEAST}),
b AS (SELECT doc_id, license, MAX(contained) AS contained, arg_min(start, (-contained, start)) AS start FROM g GROUP BY doc_id, license),
r AS (SELECT doc_id, COUNT(*) AS n_licenses, string_agg(license || ':' || contained || ':' || start, ',' ORDER BY license) AS licenses FROM b GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, COALESCE(n_licenses, 0) AS n_licenses, COALESCE(licenses, '') AS licenses FROM d LEFT JOIN r USING (doc_id)
"""
ORACLE = ORACLE_NOTICES.replace(_ROWS, ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in USUAL.items()))
