import hashlib
import random
import re
from collections import Counter

import pytest

from proofbox.llm import decontaminate
from proofbox.llm.decontaminate import contamination, drop_contaminated, proximity

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ws(t):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items):
    out = []
    for d, t in docs:
        w, hit, found = ws(t), set(), set()
        for i, b in items:
            bw = ws(b)
            for s in range(max(1, len(bw) - 9) if bw else 0):
                win = bw[s : s + 10]
                for p in range(len(w) - len(win) + 1):
                    if w[p : p + len(win)] == win:
                        hit.update(range(p, p + len(win)))
                        found |= {str(i)} if i is not None else set()
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return Counter(out)


@pytest.mark.parametrize("broadcast_rows", [decontaminate.BROADCAST_ROWS, 0])
def test_matches_brute_force(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", broadcast_rows)
    rng = random.Random(2)
    vocabulary = ["The", "the", "of", "É", "é", "kø", "12"] + [f"w{i}" for i in range(25)]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choices(vocabulary, k=n))
    items = [(i, text(rng.choice([0, 1, 2, 9, 10, 11, 30]))) for i in range(14)] + [(3, "the of"), (None, "w1 w2 w3"), (20, None), (21, items_text := "w9 " * 12), (22, items_text)]
    docs = []
    for i in range(60):
        parts = [text(rng.randint(0, 25)) for _ in range(3)] + ([rng.choice(items)[1] or ""] if i % 3 == 0 else [])
        rng.shuffle(parts)
        docs.append((i, " ".join(parts).upper() if i % 7 == 0 else " ".join(parts)))
    docs += [(60, None), (61, ""), (62, "w9 " * 3000), (0, docs[0][1]), (0, docs[0][1]), (0, "w1 w2 w3"), (None, "w1 W2 w3")]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as h", "'x' as item_id", "2 as n").repartition(4)
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as doc_id")
    want = brute(docs, items)
    got = Counter(tuple(r) for r in contamination(d, b).drop("h").collect())
    assert got == want
    clean = Counter(r.doc_id for r in drop_contaminated(d, b).collect())
    assert clean == Counter(k[0] for k, n in want.items() if not k[5] for _ in range(n))


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit) for r in contamination(d, b).collect()] == [(2, 0)]
    assert contamination(d.limit(0), b).count() == 0


def test_proximity(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choices("a b c d e f g h".split(), k=40))) for i in range(30)]
    queries = [(1, ["a", "B", "c"]), (2, ["h"]), (3, ["zz", "a"]), (4, ["d", "d", None, "e"])]
    got = {tuple(r) for r in proximity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "query_id long, terms array<string>"), 2).collect()}
    count = Counter(w for _, t in docs for w in t.split())
    want = set()
    for q, terms in queries:
        terms = sorted({t.lower() for t in terms if t}, key=lambda w: (count[w], w))
        for d, t in docs:
            w = t.split()
            want |= {(q, d, p) for p in range(len(w)) if w[p] == terms[0] and all(x in w[max(0, p - 2) : p + 3] for x in terms[1:])}
    assert got == want
