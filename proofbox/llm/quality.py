"""Supervised subword embeddings for document quality (operator 5).

A text is the mean of the learned vectors of its features: whole words, pairs of
neighbouring words (all pairs of equal words are one feature), and the character n-grams
(``MIN_N`` to ``MAX_N`` bytes) of each word between boundary marks, all hashed into
``buckets`` rows. A softmax layer over the mean gives the class. Vectors and layer are
trained together by stochastic gradient descent (Adagrad steps) in numpy.

Training takes a bounded sample, ``max_train`` labelled rows (those with the smallest
hashes of their id, so the same at every run): workers turn these texts into feature counts,
and one fit reads all features of these texts (a text has at most ``buckets`` different
ones, of 8 bytes each). Scoring reads every whole text. As the layer is linear, a feature
adds a fixed amount to the logit, so scoring sums one number for each feature instead of a
vector. Buckets that no training text has add nothing.

Nulls and empty texts score with the layer's bias alone (their mean is the zero vector).
Rows that repeat an id are scored each; a label row with a null id, null label or an id
with contradicting labels (the larger wins) does no harm. With no usable labels, or one
class only, every score is the share of label 1 (0.5 without labels). Other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofbox.llm.common import GRAPH, U64, _stream, as_bytes, chunks, crc_mod, give_back, mix, scratch, slice_hashes, stored, tidy, words_of

MIN_N, MAX_N, PART, SAMPLE_ROWS = 3, 4, 1 << 18, 500
REPEAT = U64(0x9FB21C651E98DF25)
_GRAM = [_stream(100 + j, 256) for j in range(MAX_N)]


def features(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, document) of every feature occurrence of some documents."""
    s, e, doc = words_of(data, offsets, GRAPH)
    if not len(s):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word_hash = slice_hashes(data, s, e)
    pair, same = mix(word_hash[:-1] * U64(0xD6E8FEB86659FD93) + word_hash[1:]), word_hash[:-1] == word_hash[1:]
    inside = doc[:-1] == doc[1:]
    ids, owners = [word_hash, np.where(same, REPEAT, pair)[inside]], [doc, doc[1:][inside]]
    # Words between boundary marks, back to back: "<word>".
    length = e - s + 2
    first = np.concatenate(([0], np.cumsum(length)))
    marked = np.empty(first[-1], np.uint8)
    inner = np.arange(len(marked)) - np.repeat(first[:-1], length)
    word = np.repeat(np.arange(len(s)), length)
    body = (inner > 0) & (inner < length[word] - 1)
    marked[body] = data[(s[word] + inner - 1)[body]]
    marked[first[:-1]], marked[first[1:] - 1] = 2, 3
    left = length[word] - inner
    value = np.zeros(len(marked), U64)
    for n in range(1, MAX_N + 1):
        size = len(marked) - n + 1
        if size <= 0:
            break
        value = value[:size] + _GRAM[n - 1][marked[n - 1 :]]
        if n >= MIN_N:
            ok = np.flatnonzero(left[:size] >= n)
            ids.append(mix(value[ok] + U64(n)))
            owners.append(doc[word[ok]])
    return (np.concatenate(ids) >> U64(20)).astype(np.int64) % buckets, np.concatenate(owners)


def _id_type(buckets: int):
    return np.uint16 if buckets <= 1 << 16 else np.int32


class _Shares:
    """The shares of each text's features; worked out when asked for, so only the counts are held."""

    def __init__(self, counts: list[np.ndarray]):
        self.counts = counts

    def __getitem__(self, i: int) -> np.ndarray:
        count = self.counts[i]
        return (count / max(1, int(count.sum()))).astype(np.float32)


def _bags(buckets: int):
    """Feature ids and counts of each text, for training; two bytes each as a rule."""

    def run(batches):
        for batch in batches:
            data, offsets = as_bytes(batch.column(0))
            ids_out, count_out = [], []
            for a, b in chunks(offsets, PART):
                ids, doc = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], buckets)
                key, count = np.unique(doc * buckets + ids, return_counts=True)
                cut = np.searchsorted(key, np.arange(b - a + 1) * buckets)
                for i, j in zip(cut[:-1], cut[1:], strict=True):
                    ids_out.append((key[i:j] % buckets).astype(_id_type(buckets)).tobytes())
                    count_out.append(count[i:j].astype(np.uint16 if count[i:j].max(initial=0) < 1 << 16 else np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(ids_out, pa.binary()), pa.array(count_out, pa.binary())], names=["label", "h", "ids", "count"])

    return run


def _bag(ids: bytes, count: bytes, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, _id_type(buckets))
    return ids, np.frombuffer(count, np.uint16 if len(count) == 2 * len(ids) else np.uint32)


def fit(ids: list[np.ndarray], share: list[np.ndarray], label: np.ndarray, buckets: int, dim: int = 8, epochs: int = 4, min_steps: int = 400, rate: float = 0.4, batch: int = 32, seed: int = 7) -> tuple[np.ndarray, float]:
    """Train embeddings and the softmax layer; returns (logit of class 1 over class 0 for each bucket, bias).

    ``epochs`` passes, or more until ``min_steps`` steps are made.
    """
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    layer = rng.uniform(-0.5, 0.5, (dim, 2)).astype(np.float32)
    bias = np.log(np.bincount(label, minlength=2) / len(label)).astype(np.float32)
    past_table, past_layer = np.full(buckets, 1e-10), np.full(layer.shape, 1e-6)
    onehot = np.eye(2, dtype=np.float32)[label]
    met = np.zeros(buckets, bool)
    for i in ids:
        met[i] = True
    for _ in range(max(epochs, -(-min_steps * batch // len(ids)))):
        order = rng.permutation(len(ids))
        for lo in range(0, len(order), batch):
            rows = order[lo : lo + batch]
            used, column = np.unique(np.concatenate([ids[r] for r in rows]), return_inverse=True)
            if not len(used):
                continue
            bag = np.zeros((len(rows), len(used)), np.float32)
            bag[np.repeat(np.arange(len(rows)), [len(ids[r]) for r in rows]), column] = np.concatenate([share[r] for r in rows])
            mean = bag @ table[used]
            prob = mean @ layer + bias
            prob = np.exp(prob - prob.max(axis=1, keepdims=True))
            prob /= prob.sum(axis=1, keepdims=True)
            error = (prob - onehot[rows]) / len(rows)
            slope, layer_slope = bag.T @ (error @ layer.T), mean.T @ error
            past_table[used] += (slope**2).mean(axis=1)
            past_layer += layer_slope**2
            table[used] -= rate * slope / np.sqrt(past_table[used])[:, None]
            layer -= rate * layer_slope / np.sqrt(past_layer)
            bias -= 0.25 * rate * error.sum(axis=0)
    return np.where(met, table @ (layer[:, 1] - layer[:, 0]), 0).astype(np.float64), float(bias[1] - bias[0])


def _score(logits, bias: float, fixed: float | None, text_at: int, keep_at: list[int], score_col: str):
    """Columns ``keep_at`` and the score of the text in column ``text_at``, in batches of at most ``CHUNK`` bytes of text."""

    def run(batches):
        table = logits.value
        for batch in batches:
            data, offsets = as_bytes(batch.column(text_at))
            names = [batch.schema.names[i] for i in keep_at]
            for lo, hi in chunks(offsets):
                out = np.full(hi - lo, 0.5 if fixed is None else fixed)
                if fixed is None:
                    for i, j in chunks(offsets[lo : hi + 1], PART):
                        a, b = lo + i, lo + j
                        ids, doc = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], len(table))
                        total = np.bincount(doc, weights=table[ids], minlength=b - a)
                        size = np.bincount(doc, minlength=b - a)
                        out[i:j] = 1 / (1 + np.exp(-np.clip(total / np.maximum(size, 1) + bias, -500, 500)))
                cols = [batch.column(c).slice(lo, hi - lo) for c in keep_at]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(out)], names=[*names, score_col])

    return run


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", buckets: int = 1 << 16, max_train: int = 8_000, **fit_options):
    """Fit on at most ``max_train`` labelled rows of ``docs``; returns (logits by bucket, bias, fixed score or None)."""
    y = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    # The sample is drawn from ids alone; only its texts, one row for an id, move.
    drawn = docs.select(F.col(id_col).alias("id")).distinct().join(y, "id").withColumn("h", F.xxhash64("id")).orderBy("h", "id").limit(max_train)
    x = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sample = x.join(F.broadcast(drawn), "id").groupBy("id", "label", "h").agg(F.min("text").alias("text"))  # at most ``max_train`` ids are broadcast
    # The bags come to the driver a partition at a time, each row's bytes once; a partition is a few hundred of ``max_train`` rows.
    sample = sample.repartition(-(-max_train // SAMPLE_ROWS), "h")
    with scratch(docs.sparkSession):
        bags = stored(sample.select("text", "label", "h").mapInArrow(tidy(_bags(buckets)), "label int, h long, ids binary, count binary"), "quality-bags")
        rows = sorted(((r["h"], r["label"], *_bag(r["ids"], r["count"], buckets)) for r in bags.toLocalIterator()), key=lambda r: r[0])
    label = np.array([r[1] for r in rows], np.int64)
    if len(set(label.tolist())) < 2:
        return np.zeros(buckets), 0.0, float(label.mean()) if len(label) else 0.5
    ids, share = [r[2] for r in rows], _Shares([r[3] for r in rows])
    logits, bias = fit(ids, share, label, buckets, **fit_options)
    del rows, ids, share
    give_back()  # the driver goes on for long after the fit
    return logits, bias, None


def score_quality(docs: DataFrame, model, text_col: str = "text", keep: list[str] | None = None, score_col: str = "score") -> DataFrame:
    """``keep`` columns of every row (all by default) and its score, the probability of label 1, as ``score_col``."""
    keep = docs.columns if keep is None else keep
    logits, bias, fixed = model
    shared = docs.sparkSession.sparkContext.broadcast(np.asarray(logits))  # ``buckets`` numbers
    # The text goes to the workers once, also where it is kept.
    picked = docs.select(*[F.col(f"`{c}`") for c in keep], *([] if text_col in keep else [F.col(f"`{text_col}`")]))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in picked.schema.fields[: len(keep)])
    return picked.mapInArrow(tidy(_score(shared, bias, fixed, picked.columns.index(text_col), list(range(len(keep))), score_col)), f"{schema}`{score_col}` double")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held_out_mod: int = 5, threshold: float = 0.3, **options) -> DataFrame:
    """doc_id, held_out, score and predicted for every row; learns from rows whose crc32(id) mod ``held_out_mod`` is not 0."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), (crc_mod(id_col, held_out_mod) == 0).alias("held_out"))
    # The text is read again for the sample; a label needs no text until the sample is drawn.
    model = train(rows.where("not held_out"), labels.withColumnRenamed(id_col, "doc_id"), "doc_id", "text", label_col, **options)
    return score_quality(rows, model, "text", ["doc_id", "held_out"]).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
