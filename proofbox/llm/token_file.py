"""Token-id files with an adaptive context-mixing range coder (operator 8).

Layout: the documents in ascending id order are cut into frames; a frame is one row of the
written table (``part``, ``frame`` number in the part, ``first``: ids before it in the part,
``payload``), written by Spark's committer, so a lost task leaves no half file. The payload,
all numbers little-endian:

    "PBT3" | n documents, n blocks, bytes of shares: uint32 | crc32 of all that follows: uint32
    | number of ids of each document: uint32 | number of ids, coded bytes, crc32 of the ids, of each block: uint32
    | order 0 shares of the frame's ids, zlib: uint16 steps from id to id, then the four byte planes of the uint32 shares
    | the coded blocks (``coder``), each with a fresh model

Document ids are kept beside it in the row's ``doc_ids`` column, in the same order.
A document lies in one frame; a block holds up to ``coder.BLOCK`` ids whatever documents
they belong to, and is checked by itself. Reading is one pass over the frames: no shuffle
but the sum of ids by part, which gives each document its global start.

Null or empty text: the end id alone. Rows with equal ids stand side by side, ordered by
text; null ids come first. An empty table gives no files' rows. Other columns are ignored.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofbox.llm import coder
from proofbox.llm.common import as_bytes, chunks, stored, text_bytes, tidy
from proofbox.llm.tokens import BATCH, Encoder, default_path

MAGIC = b"PBT3"


def _pack_shares(share: np.ndarray) -> bytes:
    there = np.flatnonzero(share)
    planes = share[there].astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zlib.compress(np.diff(there, prepend=0).astype("<u2").tobytes() + planes.tobytes())


def _unpack_shares(raw: bytes) -> coder.Shares:
    raw = zlib.decompress(raw)
    n = len(raw) // 6
    share = np.zeros(1 << 16, np.uint32)
    share[np.cumsum(np.frombuffer(raw, "<u2", n), dtype=np.int64)] = np.frombuffer(raw, np.uint8, offset=2 * n).reshape(4, n).T.copy().view("<u4")[:, 0]
    return coder.Shares(share)


def pack_frame(ids: np.ndarray, sizes: np.ndarray) -> bytes:
    """The payload of documents with ``sizes`` ids each, back to back in ``ids``; ids over 65,535 raise ValueError."""
    if len(ids) and int(ids.max()) > 0xFFFF:
        raise ValueError("the coder takes ids up to 65535")
    blocks = [ids[i : i + coder.BLOCK] for i in range(0, len(ids), coder.BLOCK)]
    shares = coder.Shares.of(ids)
    coded, share = coder.encode(blocks, shares), _pack_shares(shares.share)
    head = np.asarray(sizes, "<u4").tobytes()
    index = np.array([(len(b), len(c), zlib.crc32(b.astype("<u4").tobytes())) for b, c in zip(blocks, coded, strict=True)], "<u4").tobytes()
    body = b"".join((head, index, share, *coded))
    return MAGIC + struct.pack("<IIII", len(sizes), len(blocks), len(share), zlib.crc32(body)) + body


def unpack_frame(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ids of each document) of a payload; damage raises ValueError."""
    if payload[:4] != MAGIC:
        raise ValueError("not a token frame")
    n_docs, n_blocks, n_share, crc = struct.unpack_from("<IIII", payload, 4)
    if zlib.crc32(memoryview(payload)[20:]) != crc:
        raise ValueError("frame checksum differs")
    sizes = np.frombuffer(payload, "<u4", n_docs, 20)
    index = np.frombuffer(payload, "<u4", 3 * n_blocks, 20 + 4 * n_docs).reshape(-1, 3)
    begin = 20 + 4 * n_docs + 12 * n_blocks
    shares = _unpack_shares(payload[begin : begin + n_share])
    at = begin + n_share + np.concatenate(([0], np.cumsum(index[:, 1].astype(np.int64))))
    blocks = coder.decode([payload[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], index[:, 0].tolist(), shares)
    for block, (_, _, block_crc) in zip(blocks, index.tolist(), strict=True):
        if zlib.crc32(block.astype("<u4").tobytes()) != block_crc:
            raise ValueError("block checksum differs")
    return np.concatenate(blocks) if blocks else np.zeros(0, np.uint32), sizes


def _write(path: str, end_id: int, frame_ids: int):
    def run(batches):
        held, sizes, names, first, frame, part = [], [], [], 0, 0, None

        def flush():
            nonlocal held, sizes, names, first, frame
            ids = np.concatenate(held)
            row = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int64()), pa.array([frame], pa.int32()), pa.array([first], pa.int64()), pa.array([pa.concat_arrays(names).to_pylist()], pa.list_(names[0].type)), pa.array([pack_frame(ids, np.array(sizes))], pa.binary())],
                names=["part", "frame", "first", "doc_ids", "payload"],
            )
            held, sizes, names, first, frame = [], [], [], first + len(ids), frame + 1
            return row

        count = 0
        for batch in batches:
            texts, part = batch.column(0), batch.column(2)[0].as_py()
            _, offsets = as_bytes(texts)
            for a, b in chunks(offsets, BATCH):
                ids, cut = Encoder.of(path).encode(texts.slice(a, b - a))
                size = np.diff(cut)
                whole = np.full(len(ids) + len(size), end_id, np.uint32)
                whole[np.arange(len(ids)) + np.repeat(np.arange(len(size)), size)] = ids
                held.append(whole)
                sizes += (size + 1).tolist()
                names.append(batch.column(1).slice(a, b - a))
                count += len(whole)
                if count >= frame_ids:
                    yield flush()
                    count = 0
        if held:
            yield flush()

    return run


def write_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, tokenizer: str | None = None, part_bytes: int = 16 << 20, frame_ids: int = 8_000_000) -> DataFrame:
    """Frames of the texts' ids in ascending id order: (part, frame, first, doc_ids, payload)."""
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(id_col).alias("doc_id"))
    _, size = text_bytes(rows, "text")
    dealt = rows.repartitionByRange(max(1, math.ceil(size / part_bytes)), "doc_id").sortWithinPartitions("doc_id", "text")
    return dealt.withColumn("part", F.spark_partition_id().cast("long")).mapInArrow(tidy(_write(tokenizer or default_path(), end_id, frame_ids)), f"part long, frame int, first long, doc_ids array<{id_type}>, payload binary")


def _read(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            ids, sizes = unpack_frame(batch.column("payload")[i].as_py())
            ends = np.cumsum(sizes.astype(np.int64))
            raw = ids.astype("<u4").tobytes()
            crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
            n = len(sizes)
            yield pa.RecordBatch.from_arrays(
                [pa.array([batch.column("part")[i].as_py()] * n, pa.int64()), batch.column("doc_ids")[i].values, pa.array(batch.column("first")[i].as_py() + ends - sizes), pa.array(sizes.astype(np.int64)), pa.array(crc, pa.int64())],
                names=["part", "doc_id", "inner", "n_tokens", "ids_crc32"],
            )


def read_ids(frames: DataFrame) -> DataFrame:
    """One row per document of written frames: doc_id, start, n_tokens, ids_crc32."""
    id_type = frames.schema["doc_ids"].dataType.elementType.simpleString()
    docs = stored(frames.mapInArrow(tidy(_read), f"part long, doc_id {id_type}, inner long, n_tokens long, ids_crc32 long"), "token-rows")
    # One row per part of about 10 MB of text: a few bytes each for the running sum.
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = docs.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("before"))
    return docs.join(parts, "part").select("doc_id", (F.col("before") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """Write the ids of ``docs`` in the shared scratch folder and read them back."""
    return read_ids(stored(write_ids(docs, **options), "token-frames"))
