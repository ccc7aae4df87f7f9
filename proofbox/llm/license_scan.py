"""License scan by exact set-similarity join (operator 10), DataFrame functions only.

Base: places where a phrase's words stand consecutively. The method adds labels of license
statements that are worded otherwise: a text block (a line) has a template's label if it
contains at least ``CONTAINMENT`` of the template's distinct words. The join is exact:

* the templates' words are ordered by their frequency in the whole corpus, rarest first
  (one counting scan);
* prefix filter: a block that contains enough of a template holds one of its first
  t - need + 1 words, so only occurrences of these words make candidates;
* positional filter: a candidate counts at the first prefix word that its block holds, at
  place i; the block lacks the i words before, so at most t - i can be shared;
* length filter: the block has at least ``need`` different words;
* what passes is verified with the whole block.

Templates are the fixed list below, a few hundred words, so broadcasting them is bounded.
Null text counts as empty: no words, no labels, score 0. Rows that repeat id and text each
get the result. An empty table gives no rows. Other columns are ignored. ``score`` is 1 with
a base place, else the best containment found, else 0.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofbox.llm.words import duck_words, folded, key, words

# The phrases of the base, and license statements with their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
TEMPLATES = (
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lgpl"),
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license", "apache"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)
CONTAINMENT = 0.9


def _table(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A fixed table of literals, without Python rows."""
    items = F.array(*[F.struct(*[F.lit(v).alias(n) if not isinstance(v, (list, tuple)) else F.array(*[F.lit(x) for x in v]).alias(n) for v, n in zip(r, names, strict=True)]) for r in rows])
    return F.broadcast(spark.range(1).select(F.explode(items).alias("x")).select("x.*"))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), text).alias("h"), text.alias("text"))


def base_places(texts: DataFrame) -> DataFrame:
    """(doc_id, h, pos, label) of every place of a base phrase."""
    tokens = texts.select("doc_id", "h", words(F.col("text")).alias("ws")).select("doc_id", "h", "ws", F.posexplode("ws").alias("pos", "w"))
    firsts = {}
    for phrase, label in PHRASES:
        firsts.setdefault(phrase.split()[0], []).append((phrase, label))
    found = tokens.where(key(F.col("w")).isin(sorted(firsts)))
    phrases = _table(texts.sparkSession, [(p.split()[0], p, len(p.split()), x) for p, x in PHRASES], ["first", "phrase", "n", "label"])
    met = found.withColumn("first", key(F.col("w"))).join(phrases, "first")
    return met.where(folded(F.array_join(F.slice("ws", F.col("pos") + 1, F.col("n")), " ")) == F.col("phrase")).select("doc_id", "h", "pos", "label")


def template_rows(texts: DataFrame, containment: float) -> list[tuple[int, str, list[str], int]]:
    """(template, label, words by rising corpus frequency, words needed)."""
    sets = [sorted(set(t.split())) for t, _ in TEMPLATES]
    vocabulary = sorted({w for s in sets for w in s})
    tokens = texts.select(F.explode(words(F.col("text"))).alias("w")).select(key(F.col("w")).alias("w")).where(F.col("w").isin(vocabulary))
    count = {r["w"]: r["count"] for r in tokens.groupBy("w").count().collect()}  # at most the templates' words
    return [(i, label, sorted(s, key=lambda w: (count.get(w, 0), w)), math.ceil(containment * len(s) - 1e-9)) for i, (s, (_, label)) in enumerate(zip(sets, TEMPLATES, strict=True))]


def template_matches(texts: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, h, label, share) of every block that contains enough of a template."""
    templates = template_rows(texts, containment)
    prefix = [(w, i, place, label, s, need) for i, label, s, need in templates for place, w in enumerate(s[: len(s) - need + 1])]
    rows = _table(texts.sparkSession, prefix, ["word", "template", "place", "label", "all", "need"])
    blocks = texts.select("doc_id", "h", F.explode(F.split("text", "\n")).alias("block")).select("doc_id", "h", words(F.col("block")).alias("ws"))
    tokens = blocks.select("doc_id", "h", "ws", F.explode("ws").alias("w")).withColumn("word", key(F.col("w"))).where(F.col("word").isin(sorted({p[0] for p in prefix})))
    met = tokens.join(rows, "word").withColumn("have", F.array_distinct(F.transform("ws", folded))).where(F.size("have") >= F.col("need"))
    first = F.size(F.array_intersect(F.slice("all", F.lit(1), F.col("place")), F.col("have"))) == 0
    shared = F.size(F.array_intersect("all", "have"))
    good = met.where(first & (F.size("all") - F.col("place") >= F.col("need"))).withColumn("shared", shared).where("shared >= need")
    return good.select("doc_id", "h", "label", (F.col("shared") / F.size("all")).alias("share"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    texts = _texts(docs, id_col, text_col)
    base = base_places(texts).select("doc_id", "h", "pos", F.col("label").alias("base"), "label", F.lit(1.0).alias("share"))
    more = template_matches(texts, containment).select("doc_id", "h", F.lit(None).cast("int").alias("pos"), F.lit(None).cast("string").alias("base"), "label", "share")
    # Rows that repeat id and text repeat their places; a place counts once for each such row. Labels of a document are few.
    found = base.unionByName(more).distinct().groupBy("doc_id", "h").agg(
        F.count("pos").alias("n_base"), F.min("pos").cast("long").alias("first_word"), F.max("pos").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set("base")), ",").alias("base_labels"), F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.max("share").alias("score"),
    )
    rows = texts.select("doc_id", "h", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    same = (F.col("d.h") == F.col("f.h")) & F.col("d.doc_id").eqNullSafe(F.col("f.doc_id"))
    none = lambda c, v: F.coalesce(F.col(c), F.lit(v)).alias(c)
    return rows.alias("d").join(found.alias("f"), same, "left").select(F.col("d.doc_id").alias("doc_id"), "n_words", none("n_base", 0), "first_word", "last_word", none("base_labels", ""), none("labels", ""), none("score", 0.0))


_VALUES = ", ".join(f"('{p}', {len(p.split())}, '{x}')" for p, x in PHRASES)
_SETS = ", ".join(f"([{', '.join(repr(w) for w in sorted(set(t.split())))}], '{x}')" for t, x in TEMPLATES)
SQL = f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text, {duck_words('text')} as w from documents),
phrases(phrase, n, label) as (values {_VALUES}),
place as (
  select r, s - 1 as pos, label
  from (select r, w, unnest(generate_series(1, len(w))) as s from d) join phrases
    on array_to_string(w[s : s + n - 1], ' ') = phrase
),
templates(words, label) as (values {_SETS}),
block as (select r, {duck_words('line')} as w from (select r, unnest(string_split(text, chr(10))) as line from d)),
match as (
  select r, label, len(list_intersect(words, w)) / len(words) as share
  from block, templates
  where len(list_intersect(words, w)) >= ceil({CONTAINMENT} * len(words) - 1e-9)
),
b as (
  select r, count(*) as n_base, min(pos) as first_word, max(pos) as last_word, array_to_string(list_sort(list(distinct label)), ',') as base_labels
  from place group by r
),
a as (
  select r, array_to_string(list_sort(list(distinct label)), ',') as labels, max(share) as score
  from (select r, label, 1.0::double as share from place union all select r, label, share from match) group by r
)
select d.doc_id, len(d.w) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word,
       coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0)::double as score
from d left join b on d.r = b.r left join a on d.r = a.r
"""
