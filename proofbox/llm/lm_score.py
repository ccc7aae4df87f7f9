"""Language-model scoring with a weighted backoff automaton (operator 1).

The model is an n-gram model with Dirichlet smoothing,

    p(w | h) = (c(h w) + k p(w | h')) / (c(h) + k),    h' = h without its first word,

over the base p(w) = (c + 0.1) / (N + 0.1 (V + 1)). As an automaton: every seen history is
a state, every seen n-gram is an arc that carries log10 p, and an unseen continuation takes
the state's failure arc, of weight log10(k / (c(h) + k)), to the state of the shorter
history. One left-to-right traversal of a text carries the state and adds up the weights.

The counts are as large as the corpus, so no task holds the whole automaton:

1. Documents form blocks of about ``block_bytes``. Each block lists its distinct n-grams
   (64-bit hashes) with their training counts and sends a slice of the list to each shard.
2. A shard adds up the counts of its slice of the hash space over all blocks and answers
   each block with the totals of the n-grams it asked for.
3. A block compiles the part of the automaton that its texts can reach and traverses them.

N-grams are spread by the hash of the whole n-gram, so a frequent word or history makes no
large shard, and a block sends an n-gram once however often it occurs. N-grams are told
apart by 64-bit hashes; with D distinct ones about D^2 / 2^65 pairs collide.

Nulls, empty texts: a text without words is the end token alone. Repeated rows and ids:
each row is trained on and scored on its own. A null id hashes as empty text. An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofbox.llm.common import GRAPH, LOWER, U64, as_bytes, chunks, consecutive, crc_mod, mix, slice_hashes, stored, text_bytes, words_of

END, START = U64(0x2545F4914F6CDD1D), U64(0x9FB21C651E98DF25)
#: The low three bits of a key: the order of the n-gram, 0 for the start of a text.
ORDER_MASK = U64(7)


class Block:
    """The n-grams of a run of documents: token hashes, and for each order the ids of the n-grams that end at each token."""

    def __init__(self, texts, order: int):
        hashes, owners = [], []
        data, offsets = as_bytes(texts)
        for a, b in chunks(offsets):
            part = LOWER[data[offsets[a] : offsets[b]]]
            s, e, doc = words_of(part, offsets[a : b + 1] - offsets[a], GRAPH)
            hashes.append(slice_hashes(part, s, e))
            owners.append(doc + a)
        n_docs = len(offsets) - 1
        words = np.concatenate(hashes) if hashes else np.zeros(0, U64)
        doc = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        per_doc = np.bincount(doc, minlength=n_docs)
        self.first = np.concatenate(([0], np.cumsum(per_doc + 2)))  # a start token, the words, an end token
        token = np.empty(self.first[-1], U64)
        token[np.arange(len(words)) + 2 * doc + 1] = words
        token[self.first[:-1]], token[self.first[1:] - 1] = START, END
        place = np.arange(len(token)) - np.repeat(self.first[:-1], per_doc + 2)
        self.doc, self.n_tokens = np.repeat(np.arange(n_docs), per_doc + 2), per_doc + 1
        gram, keys, self.last = token, [], []
        for k in range(1, order + 1):
            if k > 1:
                gram = np.concatenate((gram[:1], mix(gram[:-1] * U64(0xD6E8FEB86659FD93) + token[1:])))
            tag = np.full(len(token), k, U64)
            if k == 1:
                tag[self.first[:-1]] = 0
            keys.append(np.where(place >= k - 1, (gram & ~ORDER_MASK) | tag, U64(0)))
        self.keys, inverse = np.unique(np.concatenate(keys) if len(token) else np.zeros(0, U64), return_inverse=True)
        self.gram = inverse.astype(np.int32).reshape(order, -1)  # 0 stands for "reaches over the start" unless no such n-gram exists
        self.whole = np.stack([place >= k - 1 for k in range(1, order + 1)])

    def counts(self, train: np.ndarray) -> np.ndarray:
        """How often each key occurs in documents flagged ``train``."""
        use = self.whole & train[self.doc][None, :]
        return np.bincount(self.gram[use], minlength=len(self.keys))

    def check(self) -> int:
        return int(np.bitwise_xor.reduce(mix(self.keys)) >> U64(1)) if len(self.keys) else 0


class Automaton:
    """States, arcs and failure arcs that the texts of one block can reach."""

    def __init__(self, block: Block, counts: np.ndarray, n: int, v: int, k: float):
        order = len(block.gram)
        self.block = block
        uni = np.log10((counts + 0.1) / (n + 0.1 * (v + 1)))  # of keys of order 1
        p = np.power(10.0, uni)
        self.base, self.order = uni, order
        self.arcs: list[dict[int, float]] = [{} for _ in range(order)]  # by order: key of the n-gram -> weight
        self.fail = np.log10(k / (counts + k))  # of a state, by the key of its history
        smooth = p.copy()
        for o in range(1, order):
            pos = np.flatnonzero(block.whole[o])
            _, first = np.unique(block.gram[o][pos], return_index=True)
            pos = pos[first]
            key, history, shorter = block.gram[o][pos], block.gram[o - 1][pos - 1], block.gram[o - 1][pos]
            smooth[key] = (counts[key] + k * smooth[shorter]) / (counts[history] + k)
            seen = counts[key] > 0
            self.arcs[o] = dict(zip(key[seen].tolist(), np.log10(smooth[key[seen]]).tolist(), strict=True))
        self.seen = counts > 0

    def scores(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log10 probability, base score, known tokens) of each document."""
        b, order = self.block, self.order
        out, base, known = np.zeros(len(b.n_tokens)), np.zeros(len(b.n_tokens)), np.zeros(len(b.n_tokens), np.int64)
        scored = np.ones(b.gram.shape[1], bool)
        scored[b.first[:-1]] = False
        np.add.at(base, b.doc[scored], self.base[b.gram[0][scored]])
        np.add.at(known, b.doc[scored], self.seen[b.gram[0][scored]])
        fail, seen, uni = self.fail.tolist(), self.seen.tolist(), self.base.tolist()
        for d in range(len(b.n_tokens)):
            lo, hi = b.first[d], b.first[d + 1]
            rows = b.gram[:, lo:hi].tolist()
            words = rows[0]
            # The state is the longest seen history, by its length and the keys of its suffixes.
            length, total = (1 if order > 1 and seen[words[0]] else 0), 0.0
            for i in range(1, hi - lo):
                while length:
                    weight = self.arcs[length].get(rows[length][i])
                    if weight is not None:
                        total += weight
                        break
                    total += fail[rows[length - 1][i - 1]]  # the failure arc
                    length -= 1
                else:
                    total += uni[words[i]]
                length = min(length + 1, order - 1)
                while length and not seen[rows[length - 1][i]]:
                    length -= 1
            out[d] = total
        return out, base, known


def _cut(batches, block_bytes: int):
    """Runs of rows of about ``block_bytes`` of text, numbered within the partition.

    Only the rows' own sizes decide, so another reading with other batches cuts alike.
    """
    held, size, number = [], 0, 0
    for batch in batches:
        _, offsets = as_bytes(batch.column(0))
        a, n = 0, batch.num_rows
        cost = np.diff(offsets) + 64
        while a < n:
            total = size + np.cumsum(cost[a:])
            b = a + int(np.searchsorted(total, block_bytes)) + 1
            if b > n:
                held.append(batch.slice(a))
                size = int(total[-1])
                break
            held.append(batch.slice(a, b - a))
            yield number, pa.Table.from_batches(held)
            held, size, number, a = [], 0, number + 1, b
    if held:
        yield number, pa.Table.from_batches(held)


def _block_id(table: pa.Table, number: int) -> int:
    return (table.column("part")[0].as_py() << 24) + number


def _ask(order: int, shards: int, block_bytes: int):
    def run(batches):
        for number, table in _cut(batches, block_bytes):
            block = Block(table.column("text"), order)
            counts = block.counts(table.column("train").to_numpy().astype(bool)).astype(np.uint32)
            cuts = np.searchsorted(block.keys, (np.arange(shards + 1, dtype=object) * (1 << 64) // shards)[:-1].astype(U64))
            cuts = np.append(cuts, len(block.keys))
            pack, rows = zstandard.ZstdCompressor(level=1), []
            for s in np.flatnonzero(np.diff(cuts)):
                a, b = cuts[s], cuts[s + 1]
                rows.append((int(s), block.keys[a:b].tobytes(), pack.compress(counts[a:b].tobytes())))
            shard, keys, packed = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard, pa.int32()), pa.array([_block_id(table, number)] * len(rows), pa.int64()), pa.array([block.check()] * len(rows), pa.int64()), pa.array(keys, pa.binary()), pa.array(packed, pa.binary())],
                names=["shard", "block", "check", "keys", "counts"],
            )

    return run


def _answer(rows: pd.DataFrame) -> pd.DataFrame:
    pack, unpack = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
    keys = [np.frombuffer(k, U64) for k in rows["keys"]]
    counts = np.concatenate([np.frombuffer(unpack.decompress(c), np.uint32) for c in rows["counts"]])
    distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(inverse, weights=counts, minlength=len(distinct)).astype(np.int64)
    order = distinct & ORDER_MASK
    ends = np.cumsum([len(k) for k in keys])
    out = [pack.compress(total[inverse[e - len(k) : e]].tobytes()) for k, e in zip(keys, ends, strict=True)]
    seen = (order == 1) & (total > 0) & (distinct != 0)
    return pd.DataFrame(
        {"block": rows["block"], "shard": rows["shard"], "check": rows["check"], "totals": out, "v": int(seen.sum()) * (np.arange(len(rows)) == 0), "n": int(total[seen].sum()) * (np.arange(len(rows)) == 0)}
    )


def _traverse(order: int, n: int, v: int, k: float):
    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for _, table in consecutive(batches, "block"):
            kind = table.column("kind").to_numpy()
            answers, docs = table.slice(0, int((kind == 0).sum())), table.slice(int((kind == 0).sum()))
            block = Block(docs.column("text"), order)
            if not answers.num_rows or answers.column("check")[0].as_py() != block.check():
                raise RuntimeError("the input's partitions changed between two readings; store the table first")
            counts = np.concatenate([np.frombuffer(unpack.decompress(x.as_py()), np.int64) for x in answers.column("totals")])
            score, base, known = Automaton(block, counts, n, v, k).scores()
            yield pa.RecordBatch.from_arrays(
                [docs.column("doc_id").combine_chunks(), docs.column("held_out").combine_chunks(), pa.array(block.n_tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(score), n), pa.int64()), pa.array(base), pa.array(score)],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return run


def lm_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 2, k: float = 4.0, held_out_mod: int = 10, block_bytes: int = 3 << 20, shard_bytes: int = 8 << 20) -> DataFrame:
    """Score every text with the automaton learnt from rows whose crc32(id) mod ``held_out_mod`` is not 0.

    ``docs`` is read twice and must give the same partitions both times, as a stored table
    does (checked: a difference raises). Returns doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score and score (log10 probability).
    """
    if not 1 <= order <= 6:
        raise ValueError("order must be 1 to 6")
    id_type = docs.schema[id_col].dataType.simpleString()
    spark = docs.sparkSession
    rows = docs.select(
        F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(id_col).alias("doc_id"), (crc_mod(id_col, held_out_mod) == 0).alias("held_out")
    ).withColumn("part", F.spark_partition_id().cast("long"))
    n_rows, size = text_bytes(rows, "text")
    shards = max(1, math.ceil(size / shard_bytes))
    asked = rows.select("text", (~F.col("held_out")).cast("byte").alias("train"), "part").mapInArrow(_ask(order, shards, block_bytes), "shard int, block long, check long, keys binary, counts binary")
    answers = stored(
        asked.groupBy("shard").applyInPandas(_answer, "block long, shard int, check long, totals binary, v long, n long"), "lm-answers"
    )
    v, n = answers.agg(F.coalesce(F.sum("v"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()

    def number(batches):
        for i, table in _cut(batches, block_bytes):
            for b in table.append_column("block", pa.array([_block_id(table, i)] * table.num_rows, pa.int64())).to_batches():
                yield b.select(["block", "doc_id", "held_out", "text"])

    numbered = rows.mapInArrow(number, f"block long, doc_id {id_type}, held_out boolean, text string")
    both = answers.select("block", F.lit(0).alias("kind"), "shard", "check", "totals", F.lit(None).cast(id_type).alias("doc_id"), F.lit(None).cast("boolean").alias("held_out"), F.lit(None).cast("string").alias("text")).unionByName(
        numbered.select("block", F.lit(1).alias("kind"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("check"), F.lit(None).cast("binary").alias("totals"), "doc_id", "held_out", "text")
    )
    blocks = max(1, math.ceil(size / block_bytes))
    return (
        both.repartition(max(blocks, int(spark.conf.get("spark.sql.shuffle.partitions"))), "block")
        .sortWithinPartitions("block", "kind", "shard")
        .mapInArrow(_traverse(order, int(n), int(v), k), f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    )
