"""License scans by diagonal voting.

All rolling word k-gram hashes of the documents meet the positions of the
templates' k-grams in a Spark join. A hit votes for the diagonal (document
position minus template position); neighbouring diagonals of one template
merge, so that small insertions do not split a copy, and the merged spans are
verified by the share of the template that they hold. The base phrases are
templates like the others: a place stands where all k-grams of a phrase vote
for one diagonal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.llm.common import ascii_lower

# Base phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Wording of well-known licenses and notices, by label.
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    "mit-notice": "released under the mit license",
    "apache-2": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl-3": "licensed under the gnu general public license version 3",
    "lgpl": "under the terms of the gnu lesser general public license as published by the free software foundation",
    "agpl-3": "under the terms of the gnu affero general public license",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa": "licensed under a creative commons attribution sharealike",
    "cc-by-nc": "licensed under a creative commons attribution noncommercial",
    "cc0": "to the extent possible under law the author has waived all copyright and related or neighboring rights",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "all-rights-reserved": "all rights reserved no part of this publication may be reproduced",
}

WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words in a rolling k-gram; the shortest phrase has as many.
K = 3
#: Diagonals this far apart merge.
GAP = 4
#: Share of a template's words that a verified span holds.
COVER = 0.7


def words(text: Column) -> Column:
    """Words of the A-Z-lower-cased text: runs of a-z, digits and non-ASCII characters."""
    return F.filter(F.split(ascii_lower(text), WORD_BREAK, -1), lambda w: w != "")


def gram_hashes(w: Column, k: int) -> Column:
    """array<long> of hashes of all k consecutive words."""
    return F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(k))))).otherwise(F.array().cast("array<long>"))


def template_positions(docs: DataFrame, phrases: dict[str, str], templates: dict[str, str], k: int) -> DataFrame:
    """(gram, tpl, label, base, at, grams): the k-grams of each template; a table as small as the templates."""
    rows = [(i, label, base, t) for i, (label, base, t) in enumerate([*((v, True, p) for p, v in phrases.items()), *((v.removesuffix("-notice"), False, t) for v, t in templates.items())])]
    schema = T.StructType([T.StructField("tpl", T.IntegerType()), T.StructField("label", T.StringType()), T.StructField("base", T.BooleanType()), T.StructField("t", T.StringType())])
    tpl = docs.sparkSession.createDataFrame(rows, schema).withColumn("g", gram_hashes(words(F.col("t")), k))
    return tpl.select("tpl", "label", "base", F.size("g").alias("grams"), F.posexplode("g").alias("at", "gram"))


def rising(hits: Column) -> Column:
    """How many template positions follow each other in the document as they do in the template, each counted once.

    ``hits``: array<struct<pos, down>>, ``down`` being the template position below
    zero, so that of hits at one place of the document one counts. The longest
    chain that rises in both: element i of the fold is the least template position
    that ends a chain of i + 1; there are no more than the template has.
    """

    def step(tails: Column, hit: Column) -> Column:
        at = -hit["down"]
        i = F.size(F.filter(tails, lambda t: t < at))
        return F.concat(F.slice(tails, F.lit(1), i), F.array(at), F.slice(tails, i + 2, F.size(tails)))

    return F.size(F.aggregate(F.array_sort(hits), F.array().cast("array<int>"), step))


def scan_licenses(docs: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, places array<struct<at, label>>, spans array<struct<label, first, last, cover>>.

    ``places`` are whole base phrases; ``spans`` are verified spans of any
    template, in words from 0, last included: the k-grams that follow each other as
    in the template, each counted once, make up the share ``cover`` of it. K-grams
    are compared by hashes of 64 bits. Null texts are empty. Rows that repeat an id
    are told apart by a hash of their texts; equal rows come out as often as they
    stand. Null ids are kept. Texts of any length are read whole; an empty table
    gives no rows; spans of equal cover all stand, so no tie is broken; columns
    besides the two named are not read, whatever their names.
    """
    phrases, templates = phrases or PHRASES, templates or TEMPLATES
    grams = template_positions(docs, phrases, templates, K)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    src = src.select("doc_id", F.xxhash64("text").alias("twin"), words(F.col("text")).alias("w")).select("doc_id", "twin", F.size("w").cast("long").alias("n_words"), gram_hashes(F.col("w"), K).alias("g"))
    # Element 0 is no gram: it keeps a row of each document, and counts rows that are alike.
    rolled = src.select("doc_id", "twin", "n_words", F.posexplode(F.concat(F.array(F.lit(None).cast("long")), F.col("g"))).alias("pos", "gram"))
    hits = rolled.join(F.broadcast(grams), "gram", "left").where("pos = 0 or tpl is not null")
    key = ["doc_id", "twin"]

    # Votes of each diagonal. Row 0 of a document stands beside them with a null template.
    votes = hits.groupBy(*key, "tpl", "label", "base", "grams", F.when(F.col("tpl").isNotNull(), F.col("pos") - 1 - F.col("at")).alias("diag")).agg(
        F.size(F.collect_set("at")).alias("votes"), F.collect_list(F.when(F.col("tpl").isNotNull(), F.struct("pos", (-F.col("at")).alias("down")))).alias("hits"), F.min(F.col("pos") - 1).alias("lo"), F.max(F.col("pos") - 1).alias("hi"), F.max("n_words").alias("n_words"), F.sum(F.when(F.col("pos") == 0, 1).otherwise(0)).alias("copies")
    )
    near = Window.partitionBy(*key, "tpl").orderBy("diag")
    cluster = votes.withColumn("new", F.coalesce((F.col("diag") - F.lag("diag").over(near) > GAP).cast("int"), F.lit(1)))
    cluster = cluster.withColumn("cluster", F.sum("new").over(near.rowsBetween(Window.unboundedPreceding, 0)))
    whole = F.col("base") & (F.col("votes") == F.col("grams"))
    spans = cluster.groupBy(*key, "tpl", "label", "base", "grams", "cluster").agg(
        rising(F.flatten(F.collect_list("hits"))).alias("votes"), F.min("lo").alias("first"), (F.max("hi") + K - 1).alias("last"), F.max("n_words").alias("n_words"), F.sum("copies").alias("copies"),
        F.collect_list(F.when(whole, F.col("diag"))).alias("places"),
    )
    cover = (F.col("votes") + F.when(F.col("votes") > 0, K - 1).otherwise(0)) / (F.col("grams") + K - 1)
    good = F.col("tpl").isNotNull() & ((F.size("places") > 0) | (~F.col("base") & (cover >= COVER)))
    per_doc = spans.groupBy(*key).agg(
        F.max("n_words").alias("n_words"), F.sum("copies").alias("copies"),
        F.array_sort(F.flatten(F.collect_list(F.transform("places", lambda p: F.struct(p.cast("long").alias("at"), F.col("label").alias("label")))))).alias("places"),
        F.array_sort(F.collect_list(F.when(good, F.struct("label", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), F.least(cover, F.lit(1.0)).alias("cover"))))).alias("spans"),
    )
    return per_doc.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc_id", "n_words", "places", "spans")
