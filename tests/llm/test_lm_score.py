import math
import re
import zlib
from collections import Counter

from proofbox.llm.lm_score import lm_score


def brute(rows, order, k):
    def toks(t):
        return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]

    held = [zlib.crc32(str(i if i is not None else "").encode()) % 10 == 0 for i, _ in rows]
    c = Counter()
    for (_, t), h in zip(rows, held, strict=True):
        if not h:
            seq = ["START", *toks(t)]
            for n in range(1, order + 1):
                for j in range(len(seq) - n + 1):
                    c[tuple(("w", x) if i + j else "START" for i, x in enumerate(seq[j : j + n]))] += 1
    uni = {g[0]: v for g, v in c.items() if len(g) == 1 and g[0] != "START"}
    n, v = sum(uni.values()), len(uni)

    def p(w, h):
        if not h:
            return (uni.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))
        total = c[h]
        return (c[(*h, w)] + k * p(w, h[1:])) / (total + k)

    out = []
    for (i, t), h in zip(rows, held, strict=True):
        ws = [("w", x) for x in toks(t)]
        hist, score, base = ("START",)[: order - 1], 0.0, 0.0
        for w in ws:
            base += math.log10(p(w, ()))
            hh = hist
            score += math.log10(p(w, hh))
            hist = (*hist, w)[-(order - 1) :] if order > 1 else ()
        out.append((i, h, len(ws), sum(w in uni for w in ws), n, round(base, 6), round(score, 6)))
    return out


DOCS = [(i, t) for i, t in enumerate(
    ["the cat sat on the mat", "The cat sat\ton the  MAT", None, "", " ", "the dog sat on the mat the dog", "é É café the cat", "a " * 5000, "b", "x\x1cy z the", "the cat sat on the mat"] * 3)] + [(None, "the cat"), (5, "the cat"), (5, "the cat")]


def test_matches_brute_force(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string").selectExpr("*", "'x' as score", "1 as block")
    for order, block in ((1, 1 << 20), (2, 1 << 20), (3, 2000)):
        got = lm_score(df, order=order, k=2.5, block_bytes=block, shard_bytes=3000).collect()
        rows = sorted((r.doc_id if r.doc_id is not None else -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got)
        assert rows == sorted((i if i is not None else -1, *x) for i, *x in brute(DOCS, order, 2.5))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert lm_score(df).count() == 0


def test_history_helps_on_real_text(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    row = lm_score(df).where("held_out").selectExpr("sum(score) s", "sum(base_score) b").first()
    assert row.s > row.b
