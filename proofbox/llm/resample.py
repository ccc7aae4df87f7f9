"""Target-distribution importance resampling with length-bucketed CRC matrices (operator 12).

Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased; features are all runs
of ``low`` to ``high`` consecutive words, joined by one space, with repeats. A feature's bucket is
the unsigned crc32 of its UTF-8 bytes modulo ``buckets``.

The crc of many features at once: the distinct features of a stretch of text are grouped by
byte length; a group is a two-dimensional uint8 array (one row a feature), and one table
lookup per column moves the crc of all its rows on. The buckets are scattered back to the
places where the features stand. (Features over ``LONG`` bytes are rare and not worth a
matrix of their own: zlib takes them one by one.)

A text is read once: its buckets are stored with it (2 bytes a feature). Bucket counts leave a
task as at most ``buckets`` sums. The gain of a bucket, floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))),
needs only the ``buckets`` sums of both sides (a parameter, not the data, bounds them), which
come to the driver and go back as one array. A document's weight is the floored mean gain; the
score adds Gumbel noise that sha256 draws from its id. The share ``percent`` of the documents with at least
``least_words`` words that scores highest is drawn, ties to the smaller id.

Ranks without a global sort: scores are integers, spread by the noise, so the rows above a score
are counted from the scores' histogram (in bins, then in a bin), and only rows of one score are
ordered together.

A null or empty text has no features: weight 0, never drawn while ``least_words`` > 0. A null id counts as empty text in
the noise and comes first among ties. Rows that repeat an id are rows of their own; equal in all
returned columns, they take neighbouring ranks. Without benchmark texts T and t are 0. No documents give no rows. Other columns
are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofbox.llm.common import LOWER, WORD, as_bytes, chunks, stored, tidy, words_of
from proofbox.llm.words import duck_words

LONG = 4096
_BIN = 512  # scores in a bin of the histogram


def _crc_table() -> np.ndarray:
    """The byte table of the reflected polynomial 0xEDB88320, by its rule."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


TABLE = _crc_table()


def crc32_matrix(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Unsigned crc32 of each data[start : start + length], whole groups of equal length at a time."""
    out = np.zeros(len(start), np.uint32)
    if not len(start):
        return out
    order = np.argsort(length, kind="stable")
    size, first = np.unique(length[order], return_index=True)
    for n, a, b in zip(size.tolist(), first, np.append(first[1:], len(order)), strict=True):
        rows = order[a:b]
        if n > LONG:
            out[rows] = [zlib.crc32(data[s : s + n]) for s in start[rows].tolist()]
            continue
        step = max(1, (1 << 22) // max(n, 1))
        for lo in range(0, len(rows), step):
            some = rows[lo : lo + step]
            matrix = data[start[some] + np.arange(n)[:, None]]  # a row of the matrix is one byte place of all features
            crc = np.full(len(some), 0xFFFFFFFF, np.uint32)
            for column in matrix:
                crc = TABLE[(crc ^ column) & 0xFF] ^ (crc >> 8)
            out[some] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def _gather(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the slices one after another."""
    offsets = np.concatenate(([0], np.cumsum(length)))
    return data[np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], length)], offsets


def feature_buckets(data: np.ndarray, offsets: np.ndarray, low: int, high: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, document) of every feature, ordered by document, and the words of each document, of lower-cased texts."""
    s, e, doc = words_of(data, offsets, WORD)
    n_docs = len(offsets) - 1
    count = np.bincount(doc, minlength=n_docs)
    # The words, each with one space behind it, so that a run of words is one slice.
    size = e - s
    spaced = np.full(int(size.sum()) + len(size), 32, np.uint8)
    at = np.cumsum(size + 1) - (size + 1)
    spaced[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = _gather(data, s, size)[0]
    last = np.cumsum(count)[doc] if len(doc) else doc
    found, owner = [], []
    for n in range(low, high + 1):
        whole = np.flatnonzero(np.arange(len(s)) + n <= last)
        end = at[whole + n - 1] + size[whole + n - 1]
        flat, cut = _gather(spaced, at[whole], end - at[whole])
        column = pa.Array.from_buffers(pa.large_binary(), len(whole), [None, pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat))])
        coded = column.dictionary_encode()
        kinds, place = as_bytes(coded.dictionary)
        bucket = crc32_matrix(kinds, place[:-1], np.diff(place)) % np.uint32(buckets)
        found.append(bucket[coded.indices.to_numpy()])
        owner.append(doc[whole])
    found, owner = np.concatenate(found), np.concatenate(owner)
    if high > low:
        order = np.argsort(owner, kind="stable")
        found, owner = found[order], owner[order]
    return found, owner, count


def _width(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def _features(low: int, high: int, buckets: int):
    def run(batches):
        for batch in batches:
            data, offsets = as_bytes(batch.column(0))
            for a, b in chunks(offsets):
                bucket, doc, words = feature_buckets(LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a], low, high, buckets)
                n = np.bincount(doc, minlength=b - a)
                flat, cut = bucket.astype(_width(buckets)), np.concatenate(([0], np.cumsum(n)))
                held = [flat[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), pa.array(words.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(held, pa.binary())], names=["doc_id", "n_words", "n_features", "buckets"])

    return run


def _sums(buckets: int):
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            flat = np.frombuffer(as_bytes(batch.column(0))[0].tobytes(), _width(buckets))
            total += np.bincount(flat, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(total[at])], names=["bucket", "n"])

    return run


def bucket_counts(featured: DataFrame, buckets: int) -> np.ndarray:
    """Occurrences in each bucket over the whole frame (``buckets`` sums)."""
    out = np.zeros(buckets, np.int64)
    for r in featured.select("buckets").mapInArrow(_sums(buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))) of each bucket."""
    b, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + b) / ((s + 1) * (t_all + b)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def _weights(gain):
    def run(batches):
        of = gain.value
        for batch in batches:
            flat = np.frombuffer(as_bytes(batch.column("buckets"))[0].tobytes(), _width(len(of)))
            cut = np.concatenate(([0], np.cumsum(batch.column("n_features").to_numpy())))
            total = np.concatenate(([0], np.cumsum(of[flat])))
            n = np.diff(cut)
            weight = np.where(n > 0, (total[cut[1:]] - total[cut[:-1]]) // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), batch.column("n_features"), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    return run


def ranked(rows: DataFrame, eligible, percent: int) -> DataFrame:
    """``rows`` with ``rank`` 1, 2, ... of the floor(percent * N / 100) highest of the N ``eligible`` rows, by score, then doc_id; null for the others."""
    rows = rows.withColumn("may", eligible)
    hist = rows.where("may").groupBy("score").agg(F.count(F.lit(1)).alias("c")).withColumn("bin", F.floor(F.col("score") / _BIN))
    hist = stored(hist, "resample-scores")
    bins = hist.groupBy("bin").agg(F.sum("c").alias("in_bin"))
    before = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each _BIN scores
    bins = bins.select("bin", F.coalesce(F.sum("in_bin").over(before), F.lit(0)).alias("above_bin"))
    higher = Window.partitionBy("bin").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    above = hist.join(bins, "bin").select("score", (F.col("above_bin") + F.coalesce(F.sum("c").over(higher), F.lit(0))).alias("above"))
    n = hist.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    k = percent * n // 100
    reached = above.where(F.col("above") < k)
    lowest = reached.agg(F.min("score")).first()[0]
    inside = F.col("may") & (F.col("score") >= F.lit(lowest)) if lowest is not None else F.lit(False)
    same = Window.partitionBy("score").orderBy("doc_id", "n_features", "weight")
    place = (F.col("above") + F.row_number().over(same)).cast("long")
    top = rows.where(inside).join(reached, "score").withColumn("rank", place).withColumn("rank", F.when(F.col("rank") <= k, F.col("rank"))).drop("above")
    rest = rows.where(~inside).withColumn("rank", F.lit(None).cast("long"))
    return top.unionByName(rest).drop("may")


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", low: int = 1, high: int = 1, buckets: int = 10_000,
    least_words: int = 20, percent: int = 10, seed: int = 2024,
) -> DataFrame:
    """doc_id, n_features, weight, score, rank (null if not drawn) of every row of ``docs``, weighed towards the texts of ``target``."""
    id_type = docs.schema[id_col].dataType.simpleString()
    run = tidy(_features(low, high, buckets))
    made = "n_words long, n_features long, buckets binary"
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    featured = stored(docs.select(text, F.col(id_col).alias("doc_id")).mapInArrow(run, f"doc_id {id_type}, {made}"), "resample-features")
    wanted = target.select(F.coalesce(F.col(target_col), F.lit("")).alias("text"), F.lit(0).cast("long").alias("doc_id")).mapInArrow(run, f"doc_id long, {made}")
    gain = docs.sparkSession.sparkContext.broadcast(gains(bucket_counts(featured, buckets), bucket_counts(wanted, buckets)))
    weighed = featured.mapInArrow(tidy(_weights(gain)), f"doc_id {id_type}, n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = stored(weighed.withColumn("score", (F.col("weight") + noise).cast("long")), "resample-scored")
    return ranked(scored, F.col("n_words") >= least_words, percent).select("doc_id", "n_features", "weight", "score", "rank")


SQL = f"""
with dw as (select doc_id, row_number() over () as rid, {duck_words('text')} as ws from documents),
bw as (select {duck_words('text')} as ws from benchmark),
bits as (
  select list(v order by i) as t from (
    select i, list_reduce(list_concat([i], range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v
    from range(256) r(i))
),
dwords as (select rid, unnest(ws) as w from dw),
bwords as (select unnest(ws) as w from bw),
bucketed as (
  select w, xor(list_reduce(
      list_concat([4294967295], list_transform(range(strlen(w)), lambda i: cast('0x' || substr(hex(w), cast(2 * i + 1 as integer), 2) as bigint))),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 as bucket
  from (select distinct w from (select w from dwords union all select w from bwords)), bits
),
s as (select bucket, count(*) as n from dwords join bucketed using (w) group by bucket),
t as (select bucket, count(*) as n from bwords join bucketed using (w) group by bucket),
tot as (select (select count(*) from dwords) as sa, (select count(*) from bwords) as ta),
gain as (
  select s.bucket, cast(floor(1000 * ln(cast((coalesce(t.n, 0) + 1) * (sa + 10000) as double) / cast((s.n + 1) * (ta + 10000) as double))) as bigint) as g
  from s left join t using (bucket), tot
),
weighed as (
  select rid, count(*) as n, cast(floor(cast(sum(g) as double) / count(*)) as bigint) as w
  from dwords join bucketed using (w) join gain using (bucket) group by rid
),
scored as (
  select dw.doc_id, dw.rid, coalesce(n, 0) as n_features, coalesce(weighed.w, 0) as weight,
    coalesce(weighed.w, 0) + cast(floor(-1000 * ln(-ln((cast('0x' || substr(sha256('2024:' || coalesce(cast(dw.doc_id as varchar), '')), 1, 8) as bigint) + 0.5) / 4294967296.0))) as bigint) as score
  from dw left join weighed using (rid)
),
ranked as (
  select rid, row_number() over (order by score desc, doc_id nulls first) as r, count(*) over () as n from scored where n_features >= 20
)
select scored.doc_id, cast(n_features as bigint) as n_features, weight, score, case when r <= 10 * n // 100 then r end as rank
from scored left join ranked using (rid)
"""
