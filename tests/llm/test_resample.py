import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np

from proofbox.llm import resample as rs


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, target, low=1, high=1, buckets=10_000, least=20, percent=10):
    def features(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(low, high + 1) for i in range(len(w) - n + 1)]

    held = [features(t) for _, t in docs]
    s, t = Counter(b for f in held for b in f), Counter(b for _, x in target for b in features(x))
    s_all, t_all = sum(s.values()), sum(t.values())

    def gain(b):
        return math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))

    rows = []
    for (i, text), f in zip(docs, held):
        weight = math.floor(sum(map(gain, f)) / len(f)) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    may = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for rank, r in enumerate(may[: percent * len(may) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in rows), key=str)


def run(spark, docs, target, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as buckets", "2 as score", "3 as rank", "4 as may").repartition(3)
    return sorted((tuple(r) for r in rs.resample(d, spark.createDataFrame(target, "item_id string, text string"), **options).collect()), key=str)


def corpus(n, seed):
    rng = np.random.default_rng(seed)
    bag = ["the", "Été", "x", "naïve", "日本", "data", "q" * 200, "A-B", "7", "spark"] + [f"w{i}" for i in range(300)]
    docs = [(int(i), " ".join(rng.choice(bag, rng.integers(1, 80)))) for i in range(n)]
    target = [(f"b{i}", " ".join(rng.choice(bag[:60], 30))) for i in range(9)]
    return docs, target


def test_matches_brute_force(spark):
    docs, target = corpus(400, 3)
    docs += [(900, None), (901, ""), (902, " ,;"), (5, docs[5][1]), (5, docs[8][1]), (None, docs[9][1]), (903, "long " * 50_000), (904, "y" * 300_000), (905, docs[6][1])]
    target += [("n", None), ("e", "")]
    assert run(spark, docs, target) == brute(docs, target)
    assert run(spark, docs, target, low=1, high=3, buckets=100_000, least_words=5, percent=37) == brute(docs, target, 1, 3, 100_000, 5, 37)


def test_small_tables(spark):
    docs, target = corpus(4, 1)
    assert run(spark, [], target) == []
    assert run(spark, docs, []) == brute(docs, [])
    assert run(spark, docs, target, percent=100, least_words=0) == brute(docs, target, percent=100, least=0)
    assert run(spark, [(1, None)], [("a", None)]) == brute([(1, None)], [("a", None)])


def test_scores_in_many_bins(spark):
    rng = np.random.default_rng(8)
    rows = [(int(i), 30, 1, int(s)) for i, s in enumerate(np.concatenate((rng.integers(-9000, 9000, 3000), np.zeros(500, int))))]
    df = spark.createDataFrame(rows, "doc_id long, n_features long, weight long, score long").repartition(5)
    got = sorted((r["rank"], r["doc_id"]) for r in rs.ranked(df, df.doc_id % 7 != 0, 60).where("rank is not null").collect())
    order = sorted((-s, i) for i, _, _, s in rows if i % 7)
    assert got == [(r, i) for r, (_, i) in enumerate(order[: 60 * len(order) // 100], 1)]


def test_crc_by_columns_is_crc32():
    rng = np.random.default_rng(2)
    kinds = [bytes(rng.integers(0, 256, n).astype(np.uint8)) for n in [*rng.integers(0, 40, 500).tolist(), 4096, 4097, 9000]]
    data, cut = np.frombuffer(b"".join(kinds), np.uint8), np.concatenate(([0], np.cumsum([len(k) for k in kinds])))
    assert rs.crc32_matrix(data, cut[:-1], np.diff(cut)).tolist() == [zlib.crc32(k) for k in kinds]
