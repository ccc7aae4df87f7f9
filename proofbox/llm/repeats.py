"""Removal of repeated byte strings with a run-length index (operator 6).

A byte goes if it lies in a string of ``length`` bytes that also starts anywhere else, in
any document; strings are judged on the input and never cross documents.

One index over a whole corpus fits no task, so positions meet by content first:

1. For each start of a ``length``-byte string, the smallest ``GRAM``-byte hash inside the
   string is its anchor (the last of equal ones). It depends on the string alone, so equal
   strings have equal anchors at equal distances. Neighbouring starts share an anchor;
   such a stretch of starts with the bytes they cover is a context, about 570 bytes for
   170 starts.
2. Contexts are counted by (anchor hash, distances, context hash). A context that occurs
   twice or more is repeated as a whole, and copies cost one aggregated row.
3. Where one anchor hash has different contexts, one copy of each goes, by anchor hash, to
   a bucket of about ``bucket_bytes``. There a run-length index (``run_index``) is built and
   the matching statistics are streamed over it; starts whose longest match elsewhere
   reaches ``length`` are repeated. Only contexts that occur once need an answer.
4. An anchor hash whose different contexts exceed ``hot_bytes`` (a passage that very many
   documents share, each with other surroundings) is split by content: its starts are
   counted one by one by the hash of their string, which spreads over all tasks.

Texts are read twice; the second reading joins each text with its own contexts. Equality is
by 64-bit hashes of whole contexts within equal 64-bit anchor hashes.

Null or empty text: nothing to remove. Rows that repeat an id and text count as occurrences
of each other. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from proofbox.llm.common import BYTE_VALUE, U64, as_bytes, chunks, consecutive, mix, powers, stored, text_bytes
from proofbox.llm.run_index import RunIndex

GRAM = 64
_PLACE = 20  # bits of a position inside a segment
_SEGMENT = (1 << _PLACE) - 4096
_MASK = U64((1 << _PLACE) - 1)
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _prefix(data: np.ndarray) -> np.ndarray:
    up, _ = powers(len(data))
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE_VALUE[data] * up[: len(data)], out=total[1:])
    return total


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbouring values."""
    n = len(x)
    rows = -(-n // width)
    grid = np.full(rows * width, np.iinfo(np.uint64).max, U64)
    grid[:n] = x
    grid = grid.reshape(rows, width)
    left = np.minimum.accumulate(grid, axis=1).reshape(-1)
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def contexts(data: np.ndarray, offsets: np.ndarray, length: int):
    """(document, first start, last start, anchor hash, anchor position, context hash) of some documents."""
    if len(data) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    total, (_, down) = _prefix(data), powers(len(data))
    size = len(data) - GRAM + 1
    gram = mix((total[GRAM:] - total[:size]) * down[:size])
    # The smallest hash, and of equal ones the last.
    key = (gram & ~_MASK) | (_MASK - np.arange(size, dtype=U64))
    low = _sliding_min(key, length - GRAM + 1)
    anchor = (_MASK - (low & _MASK)).astype(np.int64)
    doc = np.searchsorted(offsets, np.arange(len(low)), side="right") - 1
    start = np.flatnonzero(np.arange(len(low)) + length <= offsets[doc + 1])
    anchor, doc = anchor[start], doc[start]
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    first, last = start[at], start[np.append(at[1:], len(start)) - 1] if len(at) else start[at]
    anchor, doc = anchor[at], doc[at]
    whole = mix((total[last + length] - total[first]) * down[first] + U64(1))
    return doc, first, last, gram[anchor], anchor, whole


def _segments(data: np.ndarray, offsets: np.ndarray, length: int):
    """(document, offset in it, bytes, offsets) pieces; a document longer than a segment is cut with an overlap that keeps every start once."""
    for a, b in chunks(offsets, _SEGMENT):
        part, cut = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        if len(part) <= _SEGMENT:
            yield a, 0, part, cut
            continue
        for lo in range(0, len(part) - length + 1, _SEGMENT - length + 1):
            piece = part[lo : lo + _SEGMENT]
            yield a, lo, piece, np.array([0, len(piece)])


def _find(length: int):
    def run(batches):
        for batch in batches:
            data, offsets = as_bytes(batch.column(0))
            for a, lo, part, cut in _segments(data, offsets, length):
                doc, first, last, gram, anchor, whole = contexts(part, cut, length)
                row = pa.array(doc + a, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).take(row), batch.column(2).take(row), pa.array(gram.view(np.int64)), pa.array(((anchor - last) << 10 | (anchor - first)).astype(np.int32)), pa.array(whole.view(np.int64)), pa.array((first - cut[doc] + lo).astype(np.int32))],
                    names=["doc_id", "h", "gram", "span", "context", "start"],
                )

    return run


def _covered(n: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, begin, 1)
    np.add.at(edge, end, -1)
    return np.cumsum(edge[:-1]) > 0


def _result(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[int, int, int, str]:
    """(bytes, removed bytes, removed runs, hash of what stays)."""
    if not len(begin):
        return len(data), 0, 0, hashlib.sha256(data.tobytes()).hexdigest()
    gone = _covered(len(data), begin, end)
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return len(data), int(gone.sum()), runs, hashlib.sha256(data[~gone].tobytes()).hexdigest()


_WORK = "kind int, doc_id {id}, h long, gram long, solo boolean, start int, piece binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_NAMES = [c.split()[0] for c in _WORK.split(", ")]


def _cut_out(length: int, id_type: pa.DataType):
    """From a text and its listed contexts: its result (kind 0), or the text and what is known of it (kind 1, 2) and contexts (3) or starts (4) to compare."""
    types = [pa.int32(), id_type, pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def run(batches):
        for batch in batches:
            rows = []
            data, offsets = as_bytes(batch.column("text"))
            lists = batch.column("list").to_pylist()
            ids, hs = batch.column("doc_id").to_pylist(), batch.column("h").to_pylist()
            for i, listed in enumerate(lists):
                text = data[offsets[i] : offsets[i + 1]]
                listed = listed or []
                known = np.array([(x["start"], x["start"] + x["size"]) for x in listed if x["full"]], np.int64).reshape(-1, 2)
                tail = (None, None, None, None)
                if any(x["solo"] for x in listed):  # answers are still to come
                    rows.append((1, ids[i], hs[i], None, None, None, text.tobytes(), *tail))
                    rows.append((2, ids[i], hs[i], None, None, None, known.tobytes(), *tail))
                else:
                    rows.append((0, ids[i], hs[i], None, None, None, None, *_result(text, known[:, 0], known[:, 1])))
                hot = [x for x in listed if x["compare"] and x["hot"]]
                if hot:
                    total, (_, down) = _prefix(text), powers(len(text))
                for x in listed:
                    if not x["compare"]:
                        continue
                    if not x["hot"]:
                        rows.append((3, ids[i], hs[i], x["gram"], x["solo"], x["start"], text[x["start"] : x["start"] + x["size"]].tobytes(), *tail))
                        continue
                    s = np.arange(x["start"], x["start"] + x["size"] - length + 1)
                    key = mix(mix((total[s + length] - total[s]) * down[s]) + U64(x["gram"] % (1 << 64)))
                    rows += [(4, ids[i], hs[i], g, x["solo"], p, None, *tail) for g, p in zip(key.view(np.int64).tolist(), s.tolist(), strict=True)]
                if len(rows) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=_NAMES)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=_NAMES)

    return run


def _compare(length: int):
    """Repeated stretches of the contexts of one bucket."""

    def run(batches):
        for _, rows in consecutive(batches, "bucket"):
            pieces, at = rows.column("piece").to_pylist(), [0]
            text = bytearray()
            for i, piece in enumerate(pieces):
                # 255 is in no UTF-8 text; the number makes every mark different, so no match runs over it.
                text += piece + bytes((255, i & 127, i >> 7 & 127, i >> 14 & 127, i >> 21 & 127))
                at.append(len(text))
            longest = RunIndex(np.frombuffer(bytes(text), np.uint8)).longest_elsewhere()
            solo, start = rows.column("solo").to_pylist(), rows.column("start").to_pylist()
            out, begin, end = [], [], []
            for i in range(len(pieces)):
                if not solo[i]:
                    continue
                hit = longest[at[i] : at[i] + len(pieces[i]) - length + 1] >= length
                if hit.any():
                    edge = np.diff(np.concatenate(([0], hit.view(np.int8), [0])))
                    for x, y in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
                        out.append(i)
                        begin.append(start[i] + x)
                        end.append(start[i] + y - 1 + length)
            pick = pa.array(out, pa.int64())
            for b in pa.table({"doc_id": rows.column("doc_id").take(pick), "h": rows.column("h").take(pick), "begin": pa.array(begin, pa.int32()), "end": pa.array(end, pa.int32())}).combine_chunks().to_batches():
                yield b

    return run


def _finish(batches):
    for batch in batches:
        data, offsets = as_bytes(batch.column("text"))
        known, found = batch.column("known").to_pylist(), batch.column("found").to_pylist()
        rows = []
        for i in range(batch.num_rows):
            spans = np.concatenate((np.frombuffer(known[i] or b"", np.int64).reshape(-1, 2), np.array([(x["begin"], x["end"]) for x in found[i] or []], np.int64).reshape(-1, 2)))
            rows.append(_result(data[offsets[i] : offsets[i + 1]], spans[:, 0], spans[:, 1]))
        n_bytes, n_removed, n_spans, sha = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, bucket_bytes: int = 1 << 20, hot_bytes: int = 2 << 20) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    if not GRAM < length <= GRAM + 1000:
        raise ValueError(f"length must be over {GRAM} and at most {GRAM + 1000}")
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(id_col).alias("doc_id")).withColumn("h", F.xxhash64("doc_id", "text"))
    found = stored(
        texts.where(F.octet_length("text") >= length).select("text", "doc_id", "h").mapInArrow(_find(length), f"doc_id {id_type}, h long, gram long, span int, context long, start int"), "repeat-contexts"
    )
    key = ["gram", "span", "context"]
    grams = found.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram")
    shared = stored(found.join(grams, "gram", "left_semi"), "repeat-shared")
    size = (F.col("span").bitwiseAND(1023) - F.shiftright("span", 10) + F.lit(length)).alias("size")
    distinct = shared.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("h", "start")).alias("copy"))
    several = distinct.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds"), F.sum(size).alias("volume")).where("kinds > 1").withColumn("hot", F.col("volume") > hot_bytes).drop("kinds", "volume")
    judged = stored(distinct.join(several, "gram", "left").where("n > 1 or hot is not null"), "repeat-judged")
    listed = shared.join(judged, key).select(
        "doc_id", "h",
        F.struct(
            "gram", "start", size, (F.col("n") > 1).alias("full"), ((F.col("n") == 1) & F.col("hot").isNotNull()).alias("solo"),
            (F.col("hot").isNotNull() & ((F.col("copy.h") == F.col("h")) & (F.col("copy.start") == F.col("start")))).alias("compare"), F.coalesce("hot", F.lit(False)).alias("hot"),
        ).alias("item"),
    )
    # One list per document: at most one entry for 170 bytes or so of its own text.
    per_doc = listed.groupBy("doc_id", "h").agg(F.collect_set("item").alias("list")).withColumnRenamed("doc_id", "of")
    joined = texts.join(per_doc.withColumnRenamed("h", "of_h"), (F.col("h") == F.col("of_h")) & F.col("doc_id").eqNullSafe(F.col("of")), "left").select("doc_id", "h", "text", "list")
    arrow_id = to_arrow_type(docs.schema[id_col].dataType)
    work = stored(joined.mapInArrow(_cut_out(length, arrow_id), _WORK.format(id=id_type)), "repeat-work")
    pieces = work.where("kind = 3")
    volume = pieces.agg(F.coalesce(F.sum(F.octet_length("piece")), F.lit(0))).first()[0]
    buckets = max(1, math.ceil(volume / bucket_bytes))
    parts = max(buckets, int(spark.conf.get("spark.sql.shuffle.partitions")))
    by_index = (
        pieces.withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(buckets))).select("bucket", "doc_id", "h", "solo", "start", "piece").repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_compare(length), f"doc_id {id_type}, h long, begin int, end int")
    )
    starts = work.where("kind = 4").select("gram", "doc_id", "h", "solo", "start")
    twice = starts.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram")
    by_start = starts.where("solo").join(twice, "gram", "left_semi").select("doc_id", "h", F.col("start").alias("begin"), (F.col("start") + length).alias("end"))
    answers = by_index.unionByName(by_start).groupBy("doc_id", "h").agg(F.collect_set(F.struct("begin", "end")).alias("found")).withColumnsRenamed({"doc_id": "of", "h": "of_h"})
    known = work.where("kind = 2").select("doc_id", "h", F.col("piece").alias("known")).withColumnsRenamed({"doc_id": "k_id", "h": "k_h"}).dropDuplicates(["k_id", "k_h"])
    waiting = work.where("kind = 1").select("doc_id", "h", F.col("piece").alias("text"))
    waiting = waiting.join(known, (F.col("h") == F.col("k_h")) & F.col("doc_id").eqNullSafe(F.col("k_id")), "left")
    waiting = waiting.join(answers, (F.col("h") == F.col("of_h")) & F.col("doc_id").eqNullSafe(F.col("of")), "left").select("doc_id", "text", "known", "found")
    finished = waiting.mapInArrow(_finish, f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return work.where("kind = 0").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").unionByName(finished)
