"""Benchmark decontamination with a positional inverted index (operator 4), DataFrame functions only.

A window is ``size`` consecutive words of an item (all words of a shorter one). The index
stores postings (term, document, position, words around) of the training texts, but only for
the terms that the search starts from:

1. the corpus frequency of every test term (one scan, counted before any shuffle);
2. each window's ``RAREST`` rarest terms; their postings are stored;
3. the list of a window's rarest term, shifted by the term's offset, is intersected with the
   shifted list of its second rarest; what is left is compared word by word with the window
   (exact phrase).

``proximity`` intersects the lists of all terms of a query instead and returns places where
they stand near the rarest one, in any order.

Test terms and windows are broadcast when they are at most ``BROADCAST_ROWS`` rows (counted
first). Beyond that they are joined by a shuffle: words are counted by task before any moves, an occurrence moves
as its term and place alone, and a text moves once, to the places found in it. Windows that several items share are searched once. A
document is known by its id and a hash of id and text, so rows that repeat both are one
entry of the index and each gets the result. Null or empty text has no words; an item
without words has no window; an item with a null id marks words but is not listed. Empty
tables: without benchmark nothing is hit, without documents there are no rows. Other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofbox.llm.common import scratch, stored
from proofbox.llm.words import duck_words, folded, key, words

SIZE, RAREST, BROADCAST_ROWS = 10, 2, 50_000


def _small(df: DataFrame) -> DataFrame:
    """``df``, marked for broadcast if its counted rows allow it."""
    return F.broadcast(df) if _fits(df) else df


def _fits(df: DataFrame) -> bool:
    return df.count() <= BROADCAST_ROWS


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), text).alias("h"), text.alias("text"))


def windows(benchmark: DataFrame, item_col: str, text_col: str, size: int) -> DataFrame:
    """(item_id, phrase, words) of every window of every item."""
    items = benchmark.select(F.col(item_col).alias("item_id"), words(F.coalesce(F.col(text_col), F.lit(""))).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    cut = items.select("item_id", "w", F.explode(starts).alias("s")).select("item_id", F.slice("w", F.col("s"), F.lit(size)).alias("w"))
    return cut.select("item_id", folded(F.array_join("w", " ")).alias("phrase")).distinct().withColumn("words", F.split("phrase", " "))


def frequencies(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): how often each of ``terms`` stands in the texts."""
    tokens = texts.select(F.explode(words(F.col("text"))).alias("w")).select(key(F.col("w")).alias("term"))
    if _fits(terms):
        counted = tokens.join(F.broadcast(terms), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    else:
        counted = tokens.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return terms.join(counted, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def postings(texts: DataFrame, terms: DataFrame, around: int) -> DataFrame:
    """(term, doc_id, h, pos, near, at): occurrences of ``terms``, with the ``around`` words on each side; the term is near[at]."""
    if _fits(terms):
        tokens = texts.select("doc_id", "h", words(F.col("text")).alias("ws")).select("doc_id", "h", "ws", F.posexplode("ws").alias("pos", "w"))
        found = tokens.withColumn("term", key(F.col("w"))).join(F.broadcast(terms), "term")
    else:
        tokens = texts.select("doc_id", "h", F.posexplode(words(F.col("text"))).alias("pos", "w")).select("doc_id", "h", "pos", key(F.col("w")).alias("term"))
        places = tokens.join(terms, "term").groupBy("doc_id", "h").agg(F.collect_set(F.struct("pos", "term")).alias("places"))  # of one text
        own = places.select(F.col("doc_id").alias("of"), F.col("h").alias("of_h"), "places")
        whole = texts.join(own, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("h") == F.col("of_h")))
        found = whole.select("doc_id", "h", words(F.col("text")).alias("ws"), F.explode("places").alias("place")).select("doc_id", "h", "ws", "place.pos", "place.term")
    first = F.greatest(F.col("pos") - around, F.lit(0))
    return found.select("term", "doc_id", "h", "pos", F.slice("ws", first + 1, F.lit(2 * around + 1)).alias("near"), (F.col("pos") - first).alias("at"))


def phrase_hits(texts: DataFrame, phrases: DataFrame, size: int) -> DataFrame:
    """(phrase, doc_id, h, start, n): every occurrence of each phrase (phrase, words)."""
    places = phrases.select("phrase", F.size("words").alias("n"), F.posexplode("words").alias("offset", "w")).withColumn("term", key(F.col("w")))
    counts = frequencies(texts, places.select("term").distinct())
    order = Window.partitionBy("phrase").orderBy("f", "offset")
    ranked = places.join(counts.withColumnRenamed("n", "f"), "term").withColumn("r", F.row_number().over(order)).where(F.col("r") <= RAREST)
    probes = stored(
        ranked.groupBy("phrase", "n").agg(
            F.max(F.when(F.col("r") == 1, F.col("term"))).alias("term"), F.max(F.when(F.col("r") == 1, F.col("offset"))).alias("offset"),
            F.max(F.when(F.col("r") == 2, F.col("term"))).alias("term2"), F.max(F.when(F.col("r") == 2, F.col("offset"))).alias("offset2"),
        ),
        "decontaminate-probes",
    )
    terms = probes.select(F.explode(F.array("term", "term2")).alias("term")).where("term is not null").distinct()
    index = stored(postings(texts, terms, size - 1), "decontaminate-postings")
    first = index.join(_small(probes), "term").withColumn("start", F.col("pos") - F.col("offset")).where("start >= 0")
    second = index.select(F.col("term").alias("term2"), F.col("doc_id").alias("of"), F.col("h").alias("of_h"), F.col("pos").alias("pos2")).distinct()
    both = (F.col("first.term2") == F.col("second.term2")) & F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("h") == F.col("of_h")) & (F.col("start") + F.col("offset2") == F.col("pos2"))
    # A window of one word has no second list.
    met = first.where("term2 is not null").alias("first").join(second.alias("second"), both, "left_semi").unionByName(first.where("term2 is null"))
    there = folded(F.array_join(F.slice("near", F.col("at") - F.col("offset") + 1, F.col("n")), " ")) == F.col("phrase")
    return met.where((F.col("at") >= F.col("offset")) & there).select("phrase", "doc_id", "h", "start", "n").distinct()


def proximity(docs: DataFrame, queries: DataFrame, within: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(query_id, doc_id, pos): places of a query's rarest term that have all its other terms at most ``within`` words away.

    ``queries``: query_id, terms (array of words). Repeated and null terms count once.
    """
    texts = _texts(docs, id_col, text_col)
    wanted = queries.select("query_id", F.explode(F.array_distinct(F.array_compact(F.transform("terms", key)))).alias("term")).distinct()
    counts = frequencies(texts, wanted.select("term").distinct())
    index = stored(postings(texts, wanted.select("term").distinct(), 0).select("term", "doc_id", "h", "pos").distinct(), "proximity-postings")
    ranked = wanted.join(counts, "term").withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("n", "term"))).withColumn("terms", F.count(F.lit(1)).over(Window.partitionBy("query_id")))
    centre = index.join(ranked.where("r = 1").select("query_id", "term", "terms"), "term").select("query_id", "terms", "doc_id", "h", "pos")
    cell = F.floor(F.col("pos") / within)
    around = centre.withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1)))
    other = index.join(ranked.where("r > 1").select("query_id", "term"), "term").select(F.col("query_id").alias("q"), "term", F.col("doc_id").alias("of"), F.col("h").alias("of_h"), F.col("pos").alias("p"), cell.alias("c"))
    near = around.join(other, (F.col("query_id") == F.col("q")) & (F.col("h") == F.col("of_h")) & F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("cell") == F.col("c"))).where(F.abs(F.col("p") - F.col("pos")) <= within)
    full = near.groupBy("query_id", "doc_id", "h", "pos", "terms").agg(F.count_distinct("term").alias("k")).where("k = terms - 1")
    return centre.where("terms = 1").select("query_id", "doc_id", "pos").unionByName(full.select("query_id", "doc_id", "pos"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = SIZE) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (and h, its hash)."""
    texts = _texts(docs, id_col, text_col)
    cut = stored(windows(benchmark, item_col, item_text_col, size), "decontaminate-windows")
    hits = stored(phrase_hits(texts, cut.select("phrase", "words").distinct(), size), "decontaminate-hits")
    # Words under any occurrence: what each span adds behind the furthest end so far. One document's spans at most meet in a task.
    spans = hits.select("doc_id", "h", "start", (F.col("start") + F.col("n")).alias("end")).distinct()
    before = Window.partitionBy("doc_id", "h").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    added = spans.withColumn("reached", F.max("end").over(before)).withColumn("new", F.greatest(F.col("end") - F.greatest("start", F.coalesce("reached", F.lit(0))), F.lit(0)))
    n_hit = added.groupBy("doc_id", "h").agg(F.sum("new").cast("long").alias("n_hit"))
    items = hits.join(_small(cut.select("phrase", "item_id")), "phrase").groupBy("doc_id", "h").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    same = lambda t: (F.col("base.h") == F.col(f"{t}.h")) & F.col("base.doc_id").eqNullSafe(F.col(f"{t}.doc_id"))
    base = texts.select("doc_id", "h", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    joined = base.alias("base").join(n_hit.alias("hit"), same("hit"), "left").join(items.alias("item"), same("item"), "left")
    listed = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return joined.select(
        F.col("base.doc_id").alias("doc_id"), F.col("base.h").alias("h"), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(listed).cast("long").alias("n_items"), F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without documents in which a window of the benchmark occurs."""
    with scratch(docs.sparkSession) as keep:
        dirty = contamination(docs, benchmark, id_col, text_col, **options).where("contaminated").select(F.col("doc_id").alias("__id"), F.col("h").alias("__h")).distinct()
        dirty = keep(stored(dirty, "decontaminate-dirty"))
    h = F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))
    return docs.join(dirty, (h == F.col("__h")) & F.col(id_col).eqNullSafe(F.col("__id")), "left_anti")


SQL = f"""
with d as (select row_number() over () as r, doc_id, {duck_words('text')} as w from documents),
b as (select item_id, {duck_words('text')} as w from benchmark),
win as (
  select distinct item_id, array_to_string(w[s : s + 9], ' ') as phrase, least(len(w), 10) as n
  from (select item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) as s from b where len(w) > 0)
),
sizes as (select distinct n from win),
g as (
  select r, s, n, array_to_string(w[s : s + n - 1], ' ') as phrase
  from (select r, w, n, unnest(generate_series(1, len(w) - n + 1)) as s from d join sizes on len(w) >= n)
),
hit as (select g.r, g.s, g.n, win.item_id from g join win on g.phrase = win.phrase and g.n = win.n),
covered as (select r, count(*) as n_hit from (select distinct r, unnest(generate_series(s, s + n - 1)) as p from hit) group by r),
items as (select r, list_sort(list(distinct cast(item_id as varchar))) as items from hit group by r)
select d.doc_id, len(d.w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(len(items), 0) as n_items,
       sha256(coalesce(array_to_string(items, ','), '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join covered on d.r = covered.r left join items on d.r = items.r
"""
