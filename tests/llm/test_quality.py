import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from proofbox.llm import common, quality
from proofbox.llm.common import as_bytes
from proofbox.llm.quality import classify, features


def corpus(n, seed):
    rng = random.Random(seed)
    good = lambda: " ".join(rng.choices(["the", "ration", "heather", "onward", "and", "stone", "reading"], k=rng.randint(5, 60)))
    bad = lambda: " ".join(rng.choices(["BUY!!", "$$$", "CLICK!!", "&&&", "FREE!!"], k=rng.randint(5, 60)))
    return [(i, (good if i % 4 else bad)(), int(i % 4 > 0)) for i in range(n)]


def test_held_out_accuracy(spark):
    rows = corpus(400, 1)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").selectExpr("*", "1 as score", "2 as label")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    got = {r.doc_id: r for r in classify(docs, labels).collect()}
    assert len(got) == 400 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [(got[i].score, q) for i, _, q in rows if got[i].held_out]
    assert sum((s > 0.5) == (q == 1) for s, q in held) >= 0.97 * len(held)


def test_odd_rows(spark):
    rows = [(1, "good text"), (2, None), (3, ""), (3, "good text"), (None, "good text"), (4, "w " * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in classify(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (1, None), (None, 0), (4, 7)], "doc_id long, quality int")
    assert all(r.score in (0.5, 1.0) for r in classify(docs, one).collect())
    both = spark.createDataFrame([(1, 1), (4, 0), (2, 1), (3, 0), (3, 1)], "doc_id long, quality int")
    got = classify(docs, both).collect()
    assert len(got) == len(rows) and len({r.score for r in got if r.doc_id == 2 or (r.doc_id == 3 and r.score == got[1].score)}) == 1
    assert classify(docs.limit(0), both).count() == 0


def test_fit_reads_every_feature_of_a_long_text(spark, monkeypatch):
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(10**9)}" for _ in range(n)) for n in (900, 400, 30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "doc_id long, quality int")
    seen, fit = {}, quality.fit
    monkeypatch.setattr(quality, "fit", lambda ids, share, label, *a, **o: seen.update(ids=ids, share=share) or fit(ids, share, label, *a, **o))
    logits, _, _ = quality.train(docs, labels)
    every = [set(features(*as_bytes(pa.array([t])), 1 << 16)[0].tolist()) for t in texts]
    assert max(map(len, every)) > 1000
    assert sorted(map(len, every)) == sorted(len(i) for i in seen["ids"]) and all(set(i.tolist()) in every for i in seen["ids"])
    assert all(abs(s.sum() - 1) < 1e-3 for s in seen["share"])
    unseen = np.setdiff1d(np.arange(1 << 16), list(set().union(*every)))
    assert len(unseen) and not logits[unseen].any()


M = (1 << 64) - 1


def plain_mix(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & M
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & M
    return x ^ (x >> 31)


def plain_features(text, buckets):
    """The features of one text, word by word and byte by byte."""
    values, grams = common.BYTE_VALUE.tolist(), [g.tolist() for g in quality._GRAM]
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode()) if w]
    hashes = [plain_mix(sum(values[b] * pow(common._BASE, i, 1 << 64) for i, b in enumerate(w)) & M) for w in words]
    found = list(hashes)
    for a, b in zip(hashes, hashes[1:]):
        found.append(int(quality.REPEAT) if a == b else plain_mix(a * 0xD6E8FEB86659FD93 + b & M))
    for w in words:
        marked = b"\x02" + w + b"\x03"
        for n in (3, 4):
            for i in range(len(marked) - n + 1):
                found.append(plain_mix(sum(grams[j][marked[i + j]] for j in range(n)) + n & M))
    return Counter((h >> 20) % buckets for h in found)


def plain_fit(bags, label, buckets, dim, epochs, min_steps, rate, batch, seed):
    """The training of ``quality.fit``, text by text and component by component."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).tolist()
    layer = rng.uniform(-0.5, 0.5, (dim, 2)).tolist()
    bias = [math.log(label.count(c) / len(label)) for c in (0, 1)]
    past_table, past_layer = [1e-10] * buckets, [[1e-6] * 2 for _ in range(dim)]
    for _ in range(max(epochs, -(-min_steps * batch // len(bags)))):
        order = rng.permutation(len(bags)).tolist()
        for lo in range(0, len(order), batch):
            rows = order[lo : lo + batch]
            slope, layer_slope, error_sum = {}, [[0.0] * 2 for _ in range(dim)], [0.0, 0.0]
            for r in rows:
                total = sum(bags[r].values())
                mean = [sum(n / total * table[f][d] for f, n in bags[r].items()) for d in range(dim)]
                z = [sum(mean[d] * layer[d][c] for d in range(dim)) + bias[c] for c in (0, 1)]
                p = [math.exp(x - max(z)) for x in z]
                error = [(p[c] / sum(p) - (label[r] == c)) / len(rows) for c in (0, 1)]
                for d in range(dim):
                    back = sum(error[c] * layer[d][c] for c in (0, 1))
                    for c in (0, 1):
                        layer_slope[d][c] += mean[d] * error[c]
                    for f, n in bags[r].items():
                        slope.setdefault(f, [0.0] * dim)[d] += n / total * back
                error_sum = [error_sum[c] + error[c] for c in (0, 1)]
            for f, s in slope.items():
                past_table[f] += sum(x * x for x in s) / dim
                table[f] = [t - rate * x / math.sqrt(past_table[f]) for t, x in zip(table[f], s)]
            for d in range(dim):
                for c in (0, 1):
                    past_layer[d][c] += layer_slope[d][c] ** 2
                    layer[d][c] -= rate * layer_slope[d][c] / math.sqrt(past_layer[d][c])
            bias = [bias[c] - 0.25 * rate * error_sum[c] for c in (0, 1)]
    return table, layer, bias


def test_scores_equal_a_plain_training_and_scoring(spark):
    rng = random.Random(12)
    bag = ["Éclair", "the", "the", "x", "日本語", "BUY!!", "long" * 9, "a b", "7"]
    rows = [(i, " ".join(rng.choices(bag, k=rng.randint(0, 9))) + rng.choice(["", "\n", "\t!"])) for i in range(40)] + [(40, None), (41, "")]
    quality_of = {i: int("BUY" in (t or "")) for i, t in rows if i % 3}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame(list(quality_of.items()), "doc_id long, quality int")
    options = {"dim": 3, "epochs": 2, "min_steps": 6, "rate": 0.3, "batch": 5, "seed": 7}
    buckets = 1 << 12
    got = {r.doc_id: r.score for r in classify(docs, labels, buckets=buckets, **options).collect()}
    order = [r.doc_id for r in docs.select("doc_id").orderBy(F.xxhash64("doc_id")).collect()]
    text = dict(rows)
    learnt = [i for i in order if i in quality_of and zlib.crc32(str(i).encode()) % 5]
    bags = [plain_features(text[i], buckets) for i in learnt]
    met = set().union(*bags)
    table, layer, bias = plain_fit(bags, [quality_of[i] for i in learnt], buckets, **options)
    for i, t in rows:
        own = plain_features(t, buckets)
        mean = [sum(n * table[f][d] for f, n in own.items() if f in met) / max(1, sum(own.values())) for d in range(options["dim"])]
        z = [sum(mean[d] * layer[d][c] for d in range(options["dim"])) + bias[c] for c in (0, 1)]
        assert abs(got[i] - 1 / (1 + math.exp(z[0] - z[1]))) < 2e-3, (i, t)


def test_bags_hold_four_bytes_a_feature_and_give_the_shares_back():
    """The driver holds the sample's bags: eight bytes a feature before; a count beyond 65,535 takes eight still."""
    import pyarrow as pa

    texts = ["some plain words and some more", "", "x " * 70_000]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([0, 1, 1], pa.int32()), pa.array([1, 2, 3])], names=["text", "label", "h"])
    (out,) = quality._bags(1 << 16)(iter([batch]))
    for text, ids, count, width in zip(texts, out.column("ids").to_pylist(), out.column("count").to_pylist(), (2, 2, 4), strict=True):
        raw = text.encode()
        data = np.frombuffer(raw, np.uint8)
        want, n = np.unique(quality.features(data, np.array([0, len(raw)]), 1 << 16)[0], return_counts=True)
        assert len(ids) == 2 * len(want) and len(count) == width * len(want)
        got, counts = quality._bag(ids, count, 1 << 16)
        assert np.array_equal(got, want) and np.array_equal(quality._Shares([counts])[0], (n / max(1, n.sum())).astype(np.float32))
