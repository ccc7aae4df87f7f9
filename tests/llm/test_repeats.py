import hashlib
import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from proofbox.llm.repeats import remove_repeats
from proofbox.llm.run_index import RunIndex


def brute(rows, length):
    count = Counter()
    texts = [(t or "").encode() for _, t in rows]
    for b in texts:
        count.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for (d, _), b in zip(rows, texts, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def check(spark, rows, length, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as h", "2 as start").repartition(4)
    got = Counter(tuple(r) for r in remove_repeats(df, length=length, **options).collect())
    assert got == brute(rows, length)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda n: " ".join("".join(rng.choices("abcdeéß", k=rng.randint(1, 9))) for _ in range(n))
    passages = [word(n) for n in (20, 40, 80, 200)]
    rows = []
    for i in range(60):
        parts = [rng.choice([word(rng.randint(0, 60)), rng.choice(passages)]) for _ in range(rng.randint(0, 5))]
        rows.append((i, "\n".join(parts)))
    rows += [(60, None), (61, ""), (62, "ab" * 700), (63, "z" * 1500), (64, rows[3][1]), (3, rows[3][1]), (None, rows[5][1]), (65, passages[3][:-3] + "q" + passages[3]), (66, "z" * 399 + "y")]
    return rows


def test_matches_brute_force(spark):
    check(spark, corpus(1), 100)


def test_long_strings_and_many_buckets(spark):
    check(spark, corpus(2), 400, bucket_bytes=3000)


def test_hot_contexts_are_split_by_content(spark):
    check(spark, corpus(3), 90, hot_bytes=500, bucket_bytes=2000)


def test_long_document_in_segments(spark):
    rng = random.Random(4)
    long = "".join(rng.choices("abcdefgh ", k=1_100_000))
    check(spark, [(1, long), (2, "q" + long[1_044_000:1_046_000] + "r"), (3, "s" + long[10:900])], 400)


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(97, 99), min_size=1, max_size=120))
def test_matching_statistics(values):
    text = np.array(values, np.uint8)
    b, n = text.tobytes(), len(values)
    index = RunIndex(text)
    for i, got in enumerate(index.longest_elsewhere().tolist()):
        best = 0
        while i + best < n and any(b[j : j + best + 1] == b[i : i + best + 1] for j in range(n - best) if j != i):
            best += 1
        assert got == best
    assert index.runs()[1].sum() == n
