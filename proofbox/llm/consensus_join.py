"""Exact set-similarity links inside dense groups, without comparing all pairs (for operator 7).

Texts of one group are mostly alike, so a group is held as its consensus (the tokens of more than
half of its members) and each member X as the difference d of its tokens from it. With
c = (1 - t) / (1 + t), two members have Jaccard similarity t or more exactly if |dA xor dB| <= c (|A| + |B|); with
s(X) = |dX| - c |X| that is |dA and dB| >= (s(A) + s(B)) / 2. Two kinds of pairs remain:

* s(A) + s(B) <= 0. Then both are similar to the group's member of the smallest s (the triangle
  inequality), so one link each to that member settles all of these pairs, without looking at them.
* Otherwise they share a difference token, of which there are few.

A group of at most ``IN_TASK`` tokens is linked inside one task: each member that is not linked yet counts, over the
postings of its difference tokens, what it shares with every other. A larger group stays spread: a member
keeps its difference tokens in the order of frequency, rarest first, up to the place
that the overlap it needs allows (prefix filter; any similar partner then has one of them too), and each such
token makes a sub-group with its own consensus. At most half of a group have a difference token, so
sub-groups halve at least, and soon fit a task.

Members of one component need no further link, and a group of one component none at all. What a member
can share at most (its tokens that are not its alone) rules it out where no partner needs so little.
So the work grows with the members and their differences, not with the square of a group.
Nothing is capped or drawn: every similar pair of different components is linked, or both ends are to a third.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofbox.llm.common import stored, tidy

IN_TASK = 2_000_000  # tokens of a group that one task may hold
_EPS = 1e-6


def group_links(nodes: np.ndarray, labels: np.ndarray, sets: list[np.ndarray], threshold: float) -> tuple[list[int], list[int]]:
    """Links (a, b) that join all members of one group whose Jaccard similarity is ``threshold`` or more and whose labels differ."""
    c, n = (1 - threshold) / (1 + threshold), len(nodes)
    size = np.array([len(x) for x in sets], np.int64)
    row = np.repeat(np.arange(n), size)
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    common = 2 * np.bincount(token) > n
    # Differences: rare tokens a member has, and common ones it lacks.
    at = np.cumsum(common) - 1
    has = np.zeros((n, int(common.sum())), bool)
    mine = common[token]
    has[row[mine], at[token[mine]]] = True
    lack_row, lack = np.nonzero(~has)
    d_row, d_token = np.concatenate((row[~mine], lack_row)), np.concatenate((token[~mine], np.flatnonzero(common)[lack]))
    k = np.bincount(d_row, minlength=n)
    s = k - c * size
    lab = np.unique(labels, return_inverse=True)[1]
    a, b = [], []

    def join(i: int, j: int) -> None:
        if lab[i] != lab[j]:
            a.append(int(nodes[i]))
            b.append(int(nodes[j]))
            lab[lab == lab[j]] = lab[i]

    lead = int(np.lexsort((nodes, s))[0])
    for i in np.flatnonzero(s + s[lead] <= _EPS):
        join(lead, int(i))
    shared = np.bincount(d_token)[d_token] > 1
    d_row, d_token = d_row[shared], d_token[shared]
    by_token = np.lexsort((d_row, d_token))
    posting = d_row[by_token]
    first = np.concatenate(([0], np.cumsum(np.bincount(d_token)))) if len(d_token) else np.zeros(1, np.int64)
    by_row = np.argsort(d_row, kind="stable")
    of_row, cut = d_token[by_row], np.searchsorted(d_row[by_row], np.arange(n + 1))
    for i in np.lexsort((nodes, s)).tolist():
        if lab[i] == lab[lead] and i != lead and s[i] + s[lead] <= _EPS:
            continue  # its partners outside this component find it themselves
        near = [posting[first[t] : first[t + 1]] for t in of_row[cut[i] : cut[i + 1]].tolist()]
        both = np.bincount(np.concatenate(near), minlength=n) if near else np.zeros(n, np.int64)
        for j in np.flatnonzero((k[i] + k - 2 * both <= c * (size[i] + size) + _EPS) & (lab != lab[i])).tolist():
            join(i, j)
    return a, b


def _in_task(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x.as_buffer(), "<u4") for x in table.column("d")]
        a, b = group_links(table.column("node").to_numpy(), table.column("label").to_numpy(), sets, threshold)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _exploded(names: list[str]):
    """Rows of (``names``, token) for the tokens of each set."""

    def run(batches):
        for batch in batches:
            sets = [np.frombuffer(x.as_buffer(), "<u4") for x in batch.column("d")]
            row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint32)
            for a in range(0, len(flat), 1 << 16):
                at = pa.array(row[a : a + (1 << 16)])
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in names], pa.array(flat[a : a + (1 << 16)].astype(np.int64))], names=[*names, "token"])

    return run


def _flipped(batches):
    """Each set's difference from the consensus of its group."""
    for batch in batches:
        out = []
        for d, common in zip(batch.column("d"), batch.column("common"), strict=True):
            x = np.frombuffer(d.as_buffer(), "<u4")
            if common.is_valid:
                m = np.array(common.as_py(), np.int64).astype("<u4")
                x = np.setxor1d(x, m, assume_unique=True)
            out.append(x.astype("<u4").tobytes())
        size = [len(x) // 4 for x in out]
        yield pa.RecordBatch.from_arrays([batch.column("g"), batch.column("node"), batch.column("label"), batch.column("n"), batch.column("x"), pa.array(size, pa.int64()), pa.array(out, pa.binary())], names=["g", "node", "label", "n", "x", "k", "d"])


def _tokens(groups: DataFrame, *names: str) -> DataFrame:
    types = dict(groups.dtypes)
    made = ", ".join(f"{c} {types[c]}" for c in names)
    return groups.select(*names, "d").mapInArrow(tidy(_exploded(list(names))), f"{made}, token long")


def round_of(groups: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """One round over ``groups`` (g, node, label, n, x, d: the difference of x so far): links (a, b), and the sub-groups (g, node, n, x, d) that remain."""
    c = (1 - threshold) / (1 + threshold)
    size = groups.groupBy("g").agg(F.count(F.lit(1)).alias("size"))
    often = _tokens(groups, "g").groupBy("g", "token").agg(F.count(F.lit(1)).alias("f")).join(size, "g").where(F.col("f") * 2 > F.col("size"))
    common = often.groupBy("g").agg(F.collect_list("token").alias("common"))
    flipped = stored(groups.join(common, "g", "left").mapInArrow(tidy(_flipped), "g long, node long, label long, n long, x binary, k long, d binary"), "near-groups")
    s = F.col("k") - F.col("n") * c
    scored = flipped.select("g", "node", "label", "n", "k", s.alias("s"))
    lead = scored.groupBy("g").agg(F.min(F.struct("s", "node", "label")).alias("lead"))
    near_lead = scored.join(lead, "g").where((F.col("label") != F.col("lead.label")) & (F.col("s") + F.col("lead.s") <= _EPS)).select(F.col("lead.node").alias("a"), F.col("node").alias("b"))

    tokens = _tokens(flipped, "g", "node")
    shared = tokens.groupBy("g", "token").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    listed = tokens.join(shared, ["g", "token"]).groupBy("g", "node").agg(F.sort_array(F.collect_list(F.struct("f", "token"))).alias("list"))
    known = listed.join(scored, ["g", "node"]).withColumn("own", F.size("list"))
    # A partner B needs (s(A) + s(B)) / 2 common tokens, and neither has more than its shared ones.
    known = stored(known.withColumn("reach", 2 * F.col("own") - F.col("s")), "near-listed")
    bounds = known.groupBy("g").agg(F.max("reach").alias("furthest"), F.min("s").alias("least"))
    known = known.join(bounds, "g").where((F.col("s") <= F.col("furthest") + _EPS) & (F.col("least") <= F.col("reach") + _EPS)).join(lead.select("g", F.col("lead.s").alias("lead_s")), "g")
    linked = F.col("s") + F.col("lead_s") <= _EPS
    need = F.greatest(F.lit(1), F.when(linked, F.floor((F.col("s") - F.col("lead_s")) / 2 - _EPS) + 1).otherwise(F.ceil((F.col("s") + F.col("lead_s")) / 2 - _EPS)))
    prefix = (F.col("own") - need + 1).cast("int")
    rows = known.where(prefix > 0).select("g", "node", "label", F.explode(F.slice("list", F.lit(1), prefix)).alias("item")).select("g", "node", "label", F.col("item.token").alias("token"))
    rows = stored(rows, "near-prefixes")
    subs = distinct_groups(rows, ["g", "token"]).withColumn("sub", F.xxhash64("g", "token"))
    subs = rows.join(subs, ["g", "token"]).select("g", "sub", "node").join(flipped.select("g", "node", "n", "x", "d"), ["g", "node"])
    return near_lead, subs.select(F.col("sub").alias("g"), "node", "n", "x", "d")


def distinct_groups(rows: DataFrame, key: list[str]) -> DataFrame:
    """The keys of groups (key, node, label) of several components; of groups with the same members (a changed word changes five shingles) one."""
    sets = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("f"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("who"), F.min("label").alias("low"), F.max("label").alias("high")).where("low != high")
    return sets.groupBy("f", "who").agg(F.min(F.struct(*key)).alias("one")).select("one.*")


def settle(groups: DataFrame, labels: DataFrame, threshold: float, link: Callable[[DataFrame], DataFrame], in_task: int = IN_TASK) -> DataFrame:
    """Link what is similar inside ``groups`` (g, node, n, x: sorted 32-bit tokens) and return the labels after it.

    ``link`` takes links (a, b) and returns the labels (node, label) after them. Nodes without a label are their own.
    """
    groups = groups.withColumn("d", F.col("x"))
    while True:
        of = groups.join(labels, "node", "left").select("g", "node", F.coalesce("label", "node").alias("label"), "n", "x", "d")
        open_ = of.groupBy("g").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.sum("n").alias("tokens")).where("low != high").select("g", "tokens")
        of = stored(of.join(open_, "g"), "near-open-groups")
        # ``in_task`` tokens at most meet in a task; x is the whole set, so d is not needed there.
        small = of.where(F.col("tokens") <= in_task).select("g", "node", "label", F.col("x").alias("d"))
        links = small.groupBy("g").applyInArrow(_in_task(threshold), "a long, b long")
        large = of.where(F.col("tokens") > in_task).drop("tokens")
        if large.isEmpty():
            return link(links)
        near_lead, subs = round_of(large, threshold)
        groups = stored(subs, "near-subgroups")
        labels = link(links.unionByName(near_lead))
