import random
import zlib
import re

import numpy as np
import pytest

from proofbox.llm.components import components
from proofbox.llm import consensus_join, near_dup
from proofbox.llm.consensus_join import settle
from proofbox.llm.near_dup import keep_one, near_duplicates, signatures

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sets(text):
    w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows, threshold=0.8):
    s = [sets(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and len(s[i] & s[j]) >= threshold * len(s[i] | s[j]) - 1e-9:
                parent[find(i)] = find(j)
    group = {}
    for i in range(len(rows)):
        group.setdefault(find(i), []).append(rows[i][0])
    return sorted(tuple(sorted(g)) for g in group.values())


def classes(df, **options):
    group = {}
    for r in near_duplicates(df, **options).collect():
        group.setdefault(r.class_id, []).append(r.doc_id)
    assert all(k == min(g) for k, g in group.items())
    return sorted(tuple(sorted(g)) for g in group.values())


def test_matches_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for base in range(12):
        text = [rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 60, 200]))]
        for _ in range(rng.randint(1, 12)):
            copy = list(text)
            for _ in range(rng.randint(0, max(1, len(copy) // 40))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows), rng.choice([" ", ", ", "\n"]).join(copy).title()))
    rows += [(len(rows) + i, t) for i, t in enumerate([None, "", "  !!", None, "long " * 30000, "long " * 29000, "é à ü ö ß", "É à ü ö ß"])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as node", "2 as label").repartition(5)
    assert classes(df) == brute(rows)


def test_hot_group_of_near_copies(spark):
    rng = random.Random(9)
    text = [f"t{i}" for i in range(120)]
    rows = []
    for i in range(300):
        copy = list(text)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    got, want = classes(spark.createDataFrame(rows, "doc_id long, text string")), brute(rows)
    assert got == want


def mixed_groups(seed):
    """Members of three groups that are alike, less alike or strangers, some of them linked already."""
    rng = random.Random(seed)
    data, as_set = [], []
    for g in range(6):
        base = rng.sample(range(2**32), 60)
        for _ in range(60 if g < 2 else 12):
            kept = base if rng.random() < 0.2 else rng.sample(base, rng.randint(45, 60))
            own = set(kept) | set(rng.sample(range(g * 40, g * 40 + 40), rng.randint(0, 6))) | {rng.randrange(2**32) for _ in range(rng.randint(0, 4))}
            as_set.append(own)
            data.append((g // 2, len(data), len(own), np.array(sorted(own), "<u4").tobytes()))
    similar = [(i, j) for j in range(len(data)) for i in range(j) if data[i][0] == data[j][0] and len(as_set[i] & as_set[j]) >= 0.8 * len(as_set[i] | as_set[j])]
    return data, as_set, similar


@pytest.mark.parametrize("in_task", [consensus_join.IN_TASK, 1500, 200])
def test_consensus_join_links_every_similar_pair(spark, in_task):
    """In one task, and spread with sub-groups of sub-groups: the components are those of all similar pairs inside groups."""
    data, as_set, similar = mixed_groups(11)
    groups = spark.createDataFrame(data, "g long, node long, n long, x binary")
    start = spark.createDataFrame([(i, i - i % 2) for i in range(0, 30)], "node long, label long")
    links = [(i - i % 2, i) for i in range(30)]
    asked = []

    def link(new):
        got = [(r.a, r.b) for r in new.collect()]
        asked.extend(got)
        links.extend(got)
        return components(spark.createDataFrame(links, "a long, b long"))

    label = {r.node: r.label for r in settle(groups, start, 0.8, link, in_task).collect()}
    assert len(similar) > 400 and all(label[a] == label[b] for a, b in similar)
    assert all(len(as_set[a] & as_set[b]) >= 0.8 * len(as_set[a] | as_set[b]) for a, b in asked)


def loose_group(n, seed):
    """Texts that differ from one in 2 to 10 of 200 words."""
    rng = random.Random(seed)
    text, rows = [f"t{i}" for i in range(200)], []
    for i in range(n):
        copy = list(text)
        for p in rng.sample(range(200), rng.randint(2, 10)):
            copy[p] = f"x{rng.randrange(10**9)}"
        rows.append((i, " ".join(copy)))
    return rows


def test_a_loose_group_grows_with_its_size(spark, monkeypatch):
    """Links, and rows of the spread form, are in proportion to the texts; a group of 300 equals brute force."""
    rows = loose_group(300, 300)
    assert classes(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
    counted = []

    def counting(df, name):
        out = stored(df, name)
        counted.append(out.count())
        return out

    stored = consensus_join.stored
    monkeypatch.setattr(consensus_join, "stored", counting)
    spread, linked = [], []
    for n in (300, 600, 1200):
        counted.clear()
        data = []
        for i, text in loose_group(n, n):
            w = text.split()
            x = np.unique([zlib.crc32(" ".join(w[j : j + 5]).encode()) for j in range(196)]).astype("<u4")
            data.append((1, i, len(x), x.tobytes()))
        links = []

        def link(new):
            links.extend((r.a, r.b) for r in new.collect())
            return components(spark.createDataFrame([(0, 0), *links], "a long, b long"))

        settle(spark.createDataFrame(data, "g long, node long, n long, x binary"), spark.createDataFrame([], "node long, label long"), 0.8, link, in_task=20_000)
        spread.append(sum(counted))
        linked.append(len(links))
    assert linked[2] < 5 * linked[0] and spread[2] < 7 * spread[0], (linked, spread)


def test_registers_estimate_probability_jaccard():
    rng = np.random.default_rng(2)
    value = rng.integers(1, 2**63, 300).astype(np.uint64)
    x, y = rng.integers(1, 6, 300).astype(float), rng.integers(1, 6, 300).astype(float)
    x[:50], y[50:100] = 0, 0
    exact = sum(1 / np.maximum(x / x[d], y / y[d]).sum() for d in range(300) if x[d] and y[d])
    m = 4096
    a, b = (signatures(value[w > 0], np.zeros((w > 0).sum(), np.int64), w[w > 0], 1, m)[0] for w in (x, y))
    assert abs((a == b).mean() - exact) < 5 * np.sqrt(exact / m)


def test_components(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(50), 100 + rng.randrange(50)) for _ in range(30)] + [(-5, 40), (7, 7)]
    label = {r.node: r.label for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(label[a] == label[b] for a, b in pairs if a != b)
    assert label[40] == -5 and all(label[v] == v for v in set(label.values()))


def test_empty_table_and_repeated_rows(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (3, None), (4, None), (None, "q r s")]
    kept = keep_one(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "5 as band")).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id) for r in kept) == [-1, 1, 3, 4]


def test_keep_one_chooses_rows_not_ids(spark):
    words = [f"w{i}" for i in range(60)]
    a, near, b, c = " ".join(words), " ".join([*words, "more"]), "another text of its own kind here", "one more text that nobody else has"
    rows = [(3, a), (5, near), (5, b), (None, near), (None, c), (None, c), (7, None), (7, None), (7, ""), (8, b), (9, "?!"), (3, a)]
    kept = keep_one(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "5 as h", "6 as row", "7 as label").repartition(3))
    assert kept.columns == ["doc_id", "text", "h", "row", "label"]
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(3, a), (5, b), (None, c), (7, None), (7, None), (7, ""), (9, "?!")], key=str)


def test_scratch_tables_go_when_they_are_done_with(spark):
    import os

    from proofbox.llm.common import scratch_dir

    folder = scratch_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    kept = keep_one(spark.createDataFrame(loose_group(40, 2), "doc_id long, text string"))
    n = kept.count()
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before if not x.startswith(".")}
    assert left == {"near-gone", "near-several"} and kept.count() == n


def test_repeated_lines_keep_nobody_from_similar_texts(spark):
    rng = random.Random(8)
    rows = []
    for g in range(4):
        text = [f"g{g}w{i}" for i in range(204)]
        line = rng.sample(text, 5)
        rows += [(len(rows), " ".join(text)), (len(rows) + 1, " ".join(text) + ("\n" + " ".join(line)) * 200), (len(rows) + 2, "\n".join([" ".join(line)] * 150 + [" ".join(text)]))]
    assert len(brute(rows)) == 4
    assert classes(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
