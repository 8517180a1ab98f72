"""License scan: phrase places, and an exact set-similarity join of text blocks with license templates.

Main path: DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.store import cut

#: Phrase -> label.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Template words -> label of the method's own.
TEMPLATES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache-2.0",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl-any",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license": "lgpl-any",
    "released under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit-text",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4.0",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa-4.0",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2.0",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "to the extent possible under law the author has waived all copyright and related rights": "cc0",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
THRESHOLD = 0.8
#: ASCII bytes that separate words, after A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_CLASS = 8


def normalised(text: Column) -> Column:
    """Words joined by one space."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS, " "))


def _spaces(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))


def class_of(n: int) -> int:
    """Templates of ``n`` words are compared with windows of twice so many words: a power of two, not less than ``n``."""
    return max(LEAST_CLASS, 1 << (n - 1).bit_length())


def rivals(sets: Sequence[tuple[int, set[str]]], threshold: float) -> dict[int, list[int]]:
    """Templates (class, words) of one class that a block may match together, as they share ``threshold`` of the words of either."""
    out: dict[int, list[int]] = {k: [] for k in range(len(sets))}
    for k, (c, a) in enumerate(sets):
        out[k] = [j for j, (d, b) in enumerate(sets) if j != k and c == d and a != b and len(a & b) >= threshold * min(len(a), len(b))]
    return out


def scan(documents: DataFrame, templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: one row for each input row.

    Base: places where a phrase's words stand consecutively (``n_base`` counts all, the word positions are the smallest
    and largest start, null without any). Method: blocks are windows of the text's words, twice as long as the longest template
    of a length class, half overlapping, so any stretch of a template's length lies whole in one. A block matches a
    template if it holds ``threshold`` of the template's distinct words. Template words are ordered by the number of
    documents that hold them, counted over all documents; block and template meet on a word within both prefixes,
    then the length filter, the positional bound and the exact overlap decide. Of templates that differ in a few decisive
    words (``rivals``) a block keeps the one that it holds better (larger containment, then more words), and the other only if the block without one notice of the
    better one still reaches the threshold: both notices give both labels, one notice gives one. ``score`` is the largest containment
    of a matching template, or 1 where a base phrase stands, else 0.

    Null or empty text: no words and no labels. Repeated rows stay rows; ties give the same labels; an empty table gives
    no rows; other columns are ignored. Long texts are handled whole.
    """
    spark = documents.sparkSession
    sets = [(label, sorted(set(words.split())), len(words.split())) for words, label in templates.items()]
    vocabulary = sorted({w for _, s, _ in sets for w in s})
    need = {k: -(-int(round(threshold * 1e6)) * len(s) // 10**6) for k, (_, s, _) in enumerate(sets)}
    listed = lambda xs: F.array(*[F.lit(x) for x in xs])

    text = documents.select("doc_id", normalised(F.col("text")).alias("_norm"))
    text = text.withColumn("_words", F.split("_norm", " "))
    text = text.withColumn("_held", F.array_intersect("_words", listed(vocabulary)))
    # A block holds no template word that its document lacks.
    able = F.lit(False)
    for k, (_, s, _) in enumerate(sets):
        able = able | (F.size(F.array_intersect("_held", listed(s))) >= need[k])
    phrase = "(?:" + "|".join(BASE_PHRASES) + ")"
    padded = F.concat(F.lit(" "), F.col("_norm"), F.lit(" "))
    rough = F.lit(False)
    for p in BASE_PHRASES:
        rough = rough | F.contains("_norm", F.lit(p))
    any_base = F.when(rough, F.regexp_count(padded, F.lit(f"(?<= ){phrase}(?= )"))).otherwise(0)
    found = text.select(
        F.monotonically_increasing_id().alias("_row"),
        "doc_id",
        F.when(F.col("_norm") == "", 0).otherwise(_spaces(F.col("_norm")) + 1).cast("long").alias("n_words"),
        any_base.cast("long").alias("n_base"),
        F.when(rough, padded).alias("_padded"),
        "_held",
        F.when(able, F.col("_words")).alias("_block_words"),
    )
    first = F.expr(f"substring(_padded, 1, regexp_instr(_padded, '(?<= ){phrase}(?= )') - 1)")
    final = F.regexp_extract("_padded", f"(?s)^(.* ){phrase} ", 1)
    labels = F.array_compact(F.array(*[F.when(F.contains("_padded", F.lit(f" {p} ")), F.lit(label)) for p, label in BASE_PHRASES.items()]))
    found = found.select(
        "_row", "doc_id", "n_words", "n_base",
        F.when(F.col("n_base") > 0, _spaces(first) - 1).cast("long").alias("first_word"),
        F.when(F.col("n_base") > 0, _spaces(final) - 1).cast("long").alias("last_word"),
        F.when(F.col("n_base") > 0, F.array_sort(F.array_distinct(labels))).otherwise(F.array().cast("array<string>")).alias("_base"),
        "_held", "_block_words",
    )
    found = cut(found, "licenses")

    # One row a template word at most reaches the driver.
    counts = {r["w"]: r["n"] for r in found.select(F.explode("_held").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    order = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}

    rows = []
    for k, (label, s, n) in enumerate(sets):
        inside = sorted(s, key=rank.__getitem__)
        for at, w in enumerate(inside[: len(inside) - need[k] + 1]):
            rows.append((class_of(n), w, k, label, at, len(inside), need[k], inside))
    # The template table is a constant of the code, a row for each prefix word.
    prefixes = F.broadcast(spark.createDataFrame(rows, "_class int, _word string, _template int, _label string, _at int, _size int, _need int, _set array<string>"))

    ranked = F.map_from_arrays(listed(order), F.array(*[F.lit(i) for i in range(len(order))]))
    classes = sorted({class_of(n) for _, _, n in sets})
    def cut_up(c: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size("_block_words"), F.lit(1)), F.lit(c))
        return F.transform(starts, lambda i: F.struct(F.lit(c).alias("c"), F.slice(F.col("_block_words"), i, 2 * c).alias("s"), F.array_intersect(F.slice(F.col("_block_words"), i, 2 * c), listed(order)).alias("w")))

    windows = F.flatten(F.array(*[cut_up(c) for c in classes]))
    least = {c: min(need[k] for k, (_, _, n) in enumerate(sets) if class_of(n) == c) for c in classes}
    at_least = F.element_at(F.map_from_arrays(listed(classes), listed(list(least.values()))), F.col("_b.c"))
    blocks = found.filter("_block_words is not null").select("_row", F.posexplode(windows).alias("_number", "_b"))
    blocks = blocks.filter(F.size("_b.w") >= at_least).withColumn("_least", at_least)
    blocks = blocks.withColumn("_in_order", F.array_sort(F.transform("_b.w", lambda w: F.struct(F.element_at(ranked, w).alias("r"), w.alias("w")))))
    blocks = blocks.select("_row", "_number", F.col("_b.c").alias("_class"), F.col("_b.w").alias("_block"), F.col("_b.s").alias("_said"), F.posexplode(F.slice("_in_order", F.lit(1), F.size("_in_order") - F.col("_least") + 1)).alias("_place", "_w"))
    met = blocks.withColumn("_word", F.col("_w.w")).join(prefixes, ["_class", "_word"])
    met = met.filter(F.size("_block") >= F.col("_need"))  # length
    met = met.filter(F.least(F.size("_block") - F.col("_place"), F.col("_size") - F.col("_at")) >= F.col("_need"))  # position
    met = met.withColumn("_overlap", F.size(F.array_intersect("_block", "_set"))).filter("_overlap >= _need")
    # A block has one entry a template at most.
    twice = F.filter(F.array_intersect("_set", "_block"), lambda w: F.size(F.filter("_said", lambda x: x == w)) > 1)
    hit = F.struct("_template", "_label", "_size", "_need", (F.col("_overlap") / F.col("_size")).alias("_share"), "_set", F.array_intersect("_set", "_block").alias("_once"), twice.alias("_twice"))
    hits = met.groupBy("_row", "_number").agg(F.collect_set(hit).alias("_hits"))
    against = rivals([(class_of(n), set(s)) for _, s, n in sets], threshold)
    table = F.map_from_arrays(listed(list(against)), F.array(*[listed(r).cast("array<int>") for r in against.values()]))
    better = lambda o, h: (o["_share"] > h["_share"]) | ((o["_share"] == h["_share"]) & (o["_size"] > h["_size"]))
    # Apart from one notice of the better template, is the other still there?
    only = lambda o, h: F.size(F.array_union(F.array_except(h["_once"], o["_set"]), h["_twice"])) < h["_need"]
    beaten = lambda h: F.exists("_hits", lambda o: better(o, h) & F.array_contains(F.element_at(table, h["_template"]), o["_template"]) & only(o, h))
    kept = hits.select("_row", F.explode(F.filter("_hits", lambda h: ~beaten(h))).alias("_hit"))
    matched = kept.groupBy("_row").agg(F.collect_set("_hit._label").alias("_own"), F.max("_hit._share").alias("_containment"))

    out = found.join(matched, "_row", "left")
    own = F.coalesce("_own", F.array().cast("array<string>"))
    score = F.greatest(F.coalesce("_containment", F.lit(0.0)), F.when(F.col("n_base") > 0, 1.0).otherwise(0.0))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("_base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("_base", own)), ",").alias("labels"),
        score.alias("score"),
    )
