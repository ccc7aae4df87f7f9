"""Helpers shared by the operators of this subpackage: scratch tables, row grouping, byte-level words.

Text is handled in bulk as UTF-8 bytes: a batch of documents is one byte array with
offsets, words are found with one table lookup per byte, and word hashes come from one
prefix sum (a polynomial hash modulo 2**64, so the hash of any slice is a difference of
two prefix values times an inverse power). Work arrays are bounded by ``CHUNK`` bytes of
text (or one document, if it is longer).
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 1 << 20
U64 = np.uint64


# ---------------------------------------------------------------- scratch tables


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only for a local session that names none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="proofbox-llm-")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


_scopes: list[list[str]] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared scratch folder and read it back.

    Cuts lineage so that lost executors cost at most the running stage. The folder is
    removed at the end of the ``scratch`` scope around it, or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    if _scopes:
        _scopes[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables stored inside are removed at the end, but for those passed to the yielded function, which go to the scope outside.

    What leaves the scope must depend on kept tables only.
    """
    mine, kept = [], []
    _scopes.append(mine)

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df._scratch_path)
        return df

    try:
        yield keep
    finally:
        _scopes.pop()
        for path in set(mine) - set(kept):
            hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)
        if _scopes:
            _scopes[-1] += kept
        else:  # the driver's handles of dropped frames go now, and with them their shuffle files on the executors
            spark._jvm.System.gc()


def text_bytes(docs: DataFrame, text_col: str) -> tuple[int, int]:
    """(rows, UTF-8 bytes of text) of a frame, in one aggregate."""
    row = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.col(text_col))), F.lit(0))).first()
    return int(row[0]), int(row[1])


def crc_mod(id_col, n: int):
    """crc32 of the id's text, modulo ``n`` (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % F.lit(n)


# ---------------------------------------------------------------- grouping rows of a sorted partition


def consecutive(batches, key: str):
    """Yield (key, table) for each run of equal keys in an iterator of record batches sorted by ``key``."""
    held, held_key = [], None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [n]))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and keys[a] != held_key:
                yield held_key, pa.Table.from_batches(held)
                held = []
            held_key = keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield held_key, pa.Table.from_batches(held)


# ---------------------------------------------------------------- memory of workers


def give_back() -> None:
    """Return what this worker has freed to the system; a worker outlives its task and idles beside other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


@contextlib.contextmanager
def batches_of(spark: SparkSession, limit: int):
    """What runs inside gets Arrow batches of about ``limit`` bytes (a row at least), or of the session's own bound, if that is smaller.

    Spark's 10,000 rows of text are some 30 MB, which the executor (twice, while its buffer grows) and the worker hold at once.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.conf.get(key, None)
    if own is not None and 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(own) <= limit:
        yield
        return
    spark.conf.set(key, str(limit))
    try:
        yield
    finally:
        if own is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, own)


def tidy(run):
    """``run`` over a task's batches, then ``give_back``."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


# ---------------------------------------------------------------- text as bytes


def as_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string or binary column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):  # no chunks at all
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK):
    """(first, last) document ranges of at most ``limit`` bytes each, one document at least."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1)
        yield a, b
        a = b


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F] (of lower-cased text) and of words [^\x20\x09-\x0D].
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True
GRAPH = np.ones(256, bool)
GRAPH[32] = GRAPH[9:14] = False


def words_of(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of each word; a word is a maximal run of ``member`` bytes in one document."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = member[data]
    start, stop = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    stop[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    start[edge] = inside[edge]
    stop[edge - 1] = inside[edge - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(stop) + 1
    return s, e, np.searchsorted(offsets, s, side="right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _stream(seed: int, n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


BYTE_VALUE = _stream(11, 256)
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse, 0 to n."""
    if not _powers or len(_powers[0]) <= n:
        m = max(n, CHUNK) + 1
        _powers[:] = [np.cumprod(np.concatenate((np.ones(1, U64), np.full(m, b, U64)))) for b in (_BASE, _INVERSE)]
    return _powers[0], _powers[1]


def slice_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each data[start:end]."""
    up, down = powers(len(data))
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE_VALUE[data] * up[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start])
