"""Near-duplicate classes with ProbMinHash, banding and verification (operator 7).

* Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased; a shingle is five
  neighbouring words (all words of a shorter text), weighted by its occurrences.
* Signature: every shingle is a Poisson process of arrivals at the rate of its weight, and
  each arrival falls on one of ``m`` registers; a register keeps the shingle that came
  first. Two texts agree on a register with their probability Jaccard similarity. A text's
  shingles stop arriving once their next arrival is later than its latest register.
  A text that repeats shingles has a second signature, of the same arrivals with weight 1, so
  that repetition inside a text keeps nobody from its similar texts.
* Banding: ``bands`` groups of registers of each signature; texts that share a group meet in a
  bucket, by whichever signature.
* Verification: the exact Jaccard similarity of the shingle sets (32-bit hashes inside a
  pair), at least ``threshold``.

A bucket does not emit all its pairs. First each member is compared with the bucket's
smallest member, and links make components. In buckets that still hold several components,
members are compared with a member drawn at random. What is still unsettled is linked exactly
by its differences from a consensus (``consensus_join``), at a cost that grows with the
texts and not with the square of a group. A pair at the threshold shares no bucket with
probability (1 - 0.8^5)^32 = 3e-6, by the signatures of weight 1; a similar pair in one
component needs no link of its own.

Texts with the same words are one node (64-bit hash), so copies meet in the first
aggregate. Null, empty or wordless texts are alone in their class. Rows that repeat an id
are classified each; a null id has no say in the class id (null if all ids of a class are).
An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofbox.llm.common import LOWER, U64, WORD, as_bytes, chunks, mix, scratch, slice_hashes, stored, tidy, words_of
from proofbox.llm.components import components
from proofbox.llm.consensus_join import distinct_groups, settle

_STEP = U64(0xD6E8FEB86659FD93)


def shingles(words: np.ndarray, doc: np.ndarray, n_docs: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, weight) of each document's distinct shingles, ordered by document and hash."""
    count = np.bincount(doc, minlength=n_docs)
    first = np.concatenate(([0], np.cumsum(count)))
    rolling = words.copy()
    for k in range(1, size):  # value at i covers words i to i + k, as far as the document goes
        more = np.flatnonzero(np.arange(len(words)) + k < first[doc + 1])
        rolling[more] = mix(rolling[more] * _STEP + words[more + k] + U64(k))
    place = np.arange(len(words)) - first[doc]
    start = (place + size <= count[doc]) | (place == 0)
    value, owner = rolling[start], doc[start]
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return value[at], owner[at], np.diff(np.append(at, len(value)))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((mix(x) >> U64(11)).astype(np.float64) + 0.5) / (1 << 53)


def signatures(value: np.ndarray, owner: np.ndarray, weight: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """The shingle that arrives first at each register, one row per document (0 where a document has none)."""
    earliest, who = np.full(n_docs * m, np.inf), np.zeros(n_docs * m, U64)
    latest = np.full(n_docs, np.inf)
    when, rate = np.zeros(len(value)), 1.0 / weight
    turn, look = 0, 1
    while len(value):
        turn += 1
        seed = value + U64(turn * 0x9E3779B97F4A7C15 % (1 << 64))
        when = when - np.log(_uniform(seed)) * rate
        soon = when < latest[owner]
        if not soon.all():  # early termination
            value, owner, rate, when, seed = value[soon], owner[soon], rate[soon], when[soon], seed[soon]
        cell = owner * m + (mix(seed ^ U64(0x5851F42D4C957F2D)) % U64(m)).astype(np.int64)
        np.minimum.at(earliest, cell, when)
        won = earliest[cell] == when
        who[cell[won]] = value[won]
        if turn >= look:
            live = np.unique(owner)
            latest[live] = earliest.reshape(n_docs, m)[live].max(axis=1)
            look = turn + max(1, turn // 4)
    return who.reshape(n_docs, m)


def _band_keys(sign: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """The buckets of each signature, one row per document."""
    sign = sign.reshape(len(sign), bands, rows)
    key = np.full(sign.shape[:2], 1, U64) * (np.arange(bands, dtype=U64) + U64(1))
    for r in range(rows):
        key = mix(key * _STEP + sign[:, :, r])
    return key


def _sign(size: int, bands: int, rows: int):
    def run(batches):
        for batch in batches:
            data, offsets = as_bytes(batch.column(0))
            for a, b in chunks(offsets):
                part = LOWER[data[offsets[a] : offsets[b]]]
                s, e, doc = words_of(part, offsets[a : b + 1] - offsets[a], WORD)
                word, n = slice_hashes(part, s, e), b - a
                value, owner, weight = shingles(word, doc, n, size)
                keys = _band_keys(signatures(value, owner, weight, n, bands * rows), bands, rows)
                count = np.bincount(doc, minlength=n)
                none = count == 0
                # Texts that repeat shingles: also with weight 1, into the same buckets.
                again = np.unique(owner[weight > 1])
                mine = np.isin(owner, again)
                flat = signatures(value[mine], np.searchsorted(again, owner[mine]), np.ones(int(mine.sum())), len(again), bands * rows)
                at, key = np.repeat(np.arange(n)[~none], bands), keys[~none].reshape(-1)
                at, key = np.concatenate((at, np.repeat(again, bands))), np.concatenate((key, _band_keys(flat, bands, rows).reshape(-1)))
                key = key[np.argsort(at, kind="stable")]
                per_text = np.where(none, 0, bands)
                per_text[again] += bands
                # The node: all words in order, by their places.
                first = np.concatenate(([0], np.cumsum(count)))
                term = mix(word + mix((np.arange(len(word)) - first[doc]).astype(U64)))
                total = np.concatenate((np.zeros(1, U64), np.cumsum(term)))
                node = mix(total[first[1:]] - total[first[:-1]] + count.astype(U64)).view(np.int64)
                cut = np.searchsorted(owner, np.arange(n + 1))
                small = (value >> U64(32)).astype("<u4")
                sets = [np.unique(small[i:j]).tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)]
                key_rows = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(per_text))), pa.int32()), pa.array(key.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, n), pa.array(node, mask=none), key_rows, pa.array(sets, pa.binary()), batch.column(2).slice(a, n)], names=["doc_id", "node", "bands", "shingles", "h"])

    return run


def _similar(threshold: float):
    def run(batches):
        for batch in batches:
            a, b = batch.column("set_a"), batch.column("set_b")
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = np.frombuffer(a[i].as_buffer(), "<u4"), np.frombuffer(b[i].as_buffer(), "<u4")
                low, high = sorted((len(x), len(y)))
                if low < threshold * high:
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = both >= threshold * (low + high - both) - 1e-9
            chosen = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(chosen), batch.column("b").filter(chosen)], names=["a", "b"])

    return run


def _classified(docs: DataFrame, id_col: str, text_col: str, shingle: int, threshold: float, bands: int, rows: int) -> DataFrame:
    """near_duplicates with ``label``, which tells classes apart (null for texts without words), and ``h``, a hash of the row's text."""
    id_type = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(text.alias("text"), F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("h"))
    signed = texts.mapInArrow(tidy(_sign(shingle, bands, rows)), f"doc_id {id_type}, node long, bands array<long>, shingles binary, h long")
    signed = stored(signed.withColumn("row", F.monotonically_increasing_id()), "near-signed")
    with scratch(docs.sparkSession) as keep:
        labels = _labels(signed, threshold)
        # Copies are counted before they meet: one row per text.
        copies = signed.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
        copies = stored(copies.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"), "least", "copies"), "near-texts")
        n_texts, n_rows = copies.agg(F.count(F.lit(1)), F.coalesce(F.sum("copies"), F.lit(0))).first()
        classes = copies.groupBy("label").agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_size"), F.count(F.lit(1)).alias("weight"))
        of_text = join_unique(copies.select("node", "label", "copies"), classes, "label", n_texts).withColumnRenamed("copies", "weight")
        of_text = keep(stored(of_text, "near-classes"))
    out = ["doc_id", "class_id", "class_size", "label", "h"]
    classified = join_unique(signed.where("node is not null").select("doc_id", "node", "h"), of_text, "node", n_rows).select(out)
    alone = signed.where("node is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(None).cast("long").alias("label"), "h")
    return classified.unionByName(alone)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: float = 0.8, bands: int = 32, rows: int = 5) -> DataFrame:
    """One row per document: doc_id, class_id (the smallest id of its class), class_size (rows of the class)."""
    return _classified(docs, id_col, text_col, shingle, threshold, bands, rows).drop("label", "h")


_HOT_SHARE = 200
#: Rows of two or three longs that may be broadcast; they are counted first. More go through the shuffle.
BROADCAST_ROWS = 500_000


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def join_unique(rows: DataFrame, by_key: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` joined to the one row of their key in ``by_key``; ``weight`` says how many of the ``total`` rows that is.

    Keys of more than one in 200 rows, fewer than 200 of them, are broadcast; the others meet in the shuffle.
    """
    hot = by_key.where(F.col("weight") * _HOT_SHARE > total).drop("weight")
    often = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(by_key.where(F.col("weight") * _HOT_SHARE <= total).drop("weight"), key)
    return often.unionByName(rest)


def _labels(signed: DataFrame, threshold: float) -> DataFrame:
    """(node, label) of every text that has a similar one; the label is shared by its class."""
    members = signed.where("node is not null").select("node", F.explode("bands").alias("band"))
    # Buckets of two nodes or more, with their members (a node once, however many copies).
    shared = members.groupBy("band").agg(F.min("node").alias("lead"), F.max("node").alias("last")).where("lead != last").select("band", "lead")
    buckets = stored(members.join(shared, "band").groupBy("band", "lead", "node").agg(F.lit(1).alias("one")).drop("one"), "near-buckets")
    # One row of each text in a bucket brings its shingles; nodes and rows move before any set does.
    chosen = signed.select("node", "row").join(buckets.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("row").alias("row"))
    chosen = _small(stored(chosen, "near-chosen"))  # the shingles of all rows stay where they are if it is small
    sets = stored(signed.select("row", "shingles").join(chosen, "row").select("node", "shingles"), "near-sets")
    links = None

    def link(new: DataFrame) -> DataFrame:
        """The labels after the links ``new`` too."""
        nonlocal links
        new = stored(new, "near-links")
        links = new if links is None else links.unionByName(new)
        return components(links)

    def verified(pairs: DataFrame) -> DataFrame:
        ordered = _small(stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-pairs"))
        with_b = ordered.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b")), "b")
        with_both = with_b.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a")), "a")
        return with_both.mapInArrow(tidy(_similar(threshold)), "a long, b long")

    def unsettled(labels: DataFrame) -> DataFrame:
        """Members of buckets that hold several components."""
        labelled = buckets.join(labels, "node", "left").select("band", "lead", "node", F.coalesce("label", "node").alias("label"))
        open_ = labelled.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min_by("node", F.xxhash64("band", "node")).alias("drawn")).where("low != high")
        return stored(labelled.join(open_.select("band", "drawn"), "band"), "near-open")

    labels = link(verified(buckets.where("lead != node").select(F.col("lead").alias("a"), F.col("node").alias("b"))))
    labels = link(verified(unsettled(labels).where("drawn != node").select(F.col("drawn").alias("a"), F.col("node").alias("b"))))
    # Buckets with the same smallest member are one group: whoever shares a bucket shares a group.
    open_ = unsettled(labels).select(F.col("lead").alias("g"), "node", "label").distinct()
    groups = open_.join(distinct_groups(open_, ["g"]), "g").select("g", "node").join(sets, "node")
    groups = groups.select("g", "node", F.expr("cast(octet_length(shingles) div 4 as long)").alias("n"), F.col("shingles").alias("x"))
    return settle(stored(groups, "near-rest"), labels, threshold, link)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: float = 0.8, bands: int = 32, rows: int = 5) -> DataFrame:
    """``docs`` with one row of each class: of the rows with the smallest id the first text in byte order; all columns stay.

    The row is chosen, not its id: rows that share an id with a kept one, or have none, go with their own
    class. A class without any id keeps a row too. Null, empty and wordless texts all stay.
    Rows are told apart by id and text; of rows with both the same, which are copies, one stays, whichever.
    """
    with scratch(docs.sparkSession) as keep:
        classified = _classified(docs, id_col, text_col, shingle, threshold, bands, rows).where("label is not null")
        keys = stored(classified.groupBy("label", "doc_id", "h").agg(F.count(F.lit(1)).alias("n")), "near-keys")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")).alias("first")
        chosen = keys.groupBy("label").agg(first, F.count(F.lit(1)).alias("keys")).select("label", "keys", F.col("first.doc_id").alias("first_id"), F.col("first.h").alias("first_h"))
        # Rows that go, and chosen ones of which there are several.
        told = keys.join(chosen.where("keys > 1"), "label", "left")
        stays = F.col("keys").isNull() | (F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("h") == F.col("first_h")))
        gone = keep(stored(told.where(~stays).select(F.col("doc_id").alias("__id"), F.col("h").alias("__h")), "near-gone"))
        several = keep(stored(told.where(stays & (F.col("n") > 1)).select(F.col("doc_id").alias("__id"), F.col("h").alias("__h")), "near-several"))
    same = docs[id_col].eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == F.col("__h"))
    single = docs.join(_small(gone.unionByName(several)), same, "left_anti")
    return single.unionByName(docs.join(_small(several), same, "left_semi").dropDuplicates([id_col, text_col]))
