"""Best-fit packing by bin completion (operator 9).

Whole documents (their ids and an end id) go into as few sequences of ``capacity`` tokens
as the search finds; only documents longer than a sequence are cut, into full pieces after
a first piece that holds the remainder. Pieces of one length are interchangeable, so the
search runs on the histogram of lengths, which has at most ``capacity`` entries however
many documents there are:

* the largest remaining length opens a sequence; its completions come by falling sum, larger lengths first, each found from subset sums over
  at most ``capacity`` tokens (a bit set for each length), so no branch ends without one. A completion is dropped if another dominates it: if some
  of its lengths can give way to one larger length that is left over. A filling is used as often as the counts allow;
* the first path takes the first completion everywhere. If it needs more sequences than the lower bound of all packings (Martello and Toth's L2),
  best fit decreasing is the other incumbent and branch and bound goes back: fewer uses of a filling, then the completions after it. A branch whose
  sequences and lower bound are no fewer than the incumbent's is pruned. The search ends when the incumbent meets the
  lower bound, when no branch is left (then it is the least number), or after ``effort`` fillings (None: no end but these two): the problem is NP-hard, so
  there the best packing found is used. It holds every piece all the same.

Each filling becomes a few rows (length, range of ranks, first sequence, offset), and the
pieces, numbered within their length, find their place there. Numbering is distributed:
a running count by length inside a partition, plus the totals of the partitions before it.

Null or empty text: a piece of the end id alone. Rows that repeat an id are packed each.
An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofbox.llm.common import as_bytes, batches_of, chunks, stored, tidy
from proofbox.llm.tokens import Encoder, default_path

#: Bytes of text that a worker holds and tokenizes at a time: a quarter of the token file's, for its work arrays take about 15 bytes for each byte of text.
SLICE = 2 << 20

# ---------------------------------------------------------------- bin completion


def _reach(size: list[int], copies: list[int], room: int) -> list[int]:
    """For each length: bit t is set if it and smaller ones can fill exactly t tokens."""
    mask, reach = (1 << room + 1) - 1, [1]
    for x, m in zip(reversed(size), reversed(copies)):
        sums, step, m = reach[-1], 1, min(m, room // x)
        while m:
            step = min(step, m)
            sums = (sums | sums << x * step) & mask
            m -= step
            step *= 2
        reach.append(sums)
    reach.reverse()
    return reach


def complete(lengths: np.ndarray, left: np.ndarray, room: int) -> list[tuple[int, int]]:
    """The filling of ``room`` with the least waste: (length, copies), largest first.

    ``lengths`` are the remaining lengths in descending order, ``left`` how many there are.
    """
    fits = lengths <= room
    size, copies = lengths[fits].tolist(), left[fits].tolist()
    incumbent, free = [], room
    for x, m in zip(size, copies):
        if x <= free:
            incumbent.append((x, min(m, free // x)))
            free -= x * incumbent[-1][1]
    if not free or not size:
        return incumbent
    reach = _reach(size, copies, room)
    goal = reach[0].bit_length() - 1
    if room - goal == free:
        return incumbent
    best = []
    for i, x in enumerate(size):
        c = min(copies[i], goal // x)
        while not reach[i + 1] >> goal - c * x & 1:  # some number of copies reaches the goal: reach[i] says so
            c -= 1
        if c:
            best.append((x, c))
            goal -= c * x
    return best


def _undominated(fill: list[tuple[int, int]], size: list[int], copies: list[int], room: int) -> bool:
    """Whether no length left over fits beside the filling or can take the place of smaller lengths of it."""
    waste, held = room - sum(x * c for x, c in fill), dict(fill)
    one, several = 0, 0  # sums of single lengths, of two and more
    for x, c in fill:
        for _ in range(c):
            several |= (several | one) << x
            one |= 1 << x
    for x, m in zip(size, copies):
        if m > held.get(x, 0):
            low = max(1, x - waste)
            if x <= waste or several >> low & (1 << x - low + 1) - 1 or one >> low & (1 << x - low) - 1:
                return False
    return True


def completions(lengths: np.ndarray, left: np.ndarray, room: int):
    """The undominated fillings of ``room``, least waste first, then larger lengths first (None for each dominated one); the first is ``complete``'s."""
    fits = lengths <= room
    size, copies = lengths[fits].tolist(), left[fits].tolist()
    reach = _reach(size, copies, room)

    def fill(i: int, goal: int):
        if not goal:
            yield []
            return
        for j in range(i, len(size)):
            x = size[j]
            for c in range(min(copies[j], goal // x), 0, -1):
                if reach[j + 1] >> goal - c * x & 1:
                    for rest in fill(j + 1, goal - c * x):
                        yield [(x, c), *rest]
            if not reach[j + 1] >> goal & 1:
                return

    for goal in range(reach[0].bit_length() - 1, -1, -1):
        if reach[0] >> goal & 1:
            yield from (f if _undominated(f, size, copies, room) else None for f in fill(0, goal))


def lower_bound(lengths: np.ndarray, left: np.ndarray, capacity: int) -> int:
    """Sequences that any packing needs (L2: lengths over half a sequence stand alone, those below fill only the room beside them)."""
    count = np.zeros(capacity + 1, np.int64)
    count[lengths] = left
    n, volume = np.concatenate(([0], np.cumsum(count))), np.concatenate(([0], np.cumsum(count * np.arange(capacity + 1))))  # of lengths below i
    low = np.arange(capacity // 2 + 1)  # lengths below it are left out
    half, high = capacity // 2 + 1, capacity - low + 1
    alone, middle = n[-1] - n[high], n[high] - n[half]
    small = volume[half] - volume[low] - (middle * capacity - (volume[high] - volume[half]))
    return int((alone + middle + np.maximum(0, -(-small // capacity))).max())


def best_fit(lengths: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best fit decreasing: each length goes where the least room is left that takes it."""
    free: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {capacity: [(int(left.sum()), [])]}
    for x, c in zip(lengths.tolist(), left.tolist()):
        while c:
            room = min(r for r, held in free.items() if held and r >= x)
            times, fill = free[room].pop()
            m = min(c, room // x)
            k = min(times, c // m)
            free.setdefault(room - m * x, []).append((k, [*fill, (x, m)]))
            if times > k:
                free[room].append((times - k, fill))
            c -= k * m
    return [(times, fill) for held in free.values() for times, fill in held if fill]


def pack_lengths(counts: dict[int, int], capacity: int, effort: int | None = 5000) -> list[tuple[int, list[tuple[int, int]]]]:
    """(times, [(length, copies)...]) fillings that use up all ``counts``."""
    lengths = np.array(sorted((x for x, c in counts.items() if c), reverse=True), np.int64)
    if not len(lengths):
        return []
    left = np.array([counts[x] for x in lengths.tolist()], np.int64)
    least = lower_bound(lengths, left, capacity)

    def rest_of(left: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        """The next sequence's length, the lengths left beside it and how many there are."""
        rest = left.copy()
        top = int(np.flatnonzero(left)[0])
        rest[top] -= 1
        return int(lengths[top]), lengths[rest > 0], rest[rest > 0]

    def uses(left: np.ndarray, top: int, more: list[tuple[int, int]]) -> tuple[int, dict[int, int], np.ndarray]:
        """How often a filling can be used, the filling, and its lengths' copies."""
        fill = {top: 1}
        for x, c in more:
            fill[x] = fill.get(x, 0) + c
        used = np.zeros_like(left)
        for x, c in fill.items():
            used[place[x]] = c
        return int((left[used > 0] // used[used > 0]).min()), fill, used

    place = {x: i for i, x in enumerate(lengths.tolist())}
    # A frame: counts before it, sequences before it, times, filling, its copies, the completion, completions after it (None: not asked for yet).
    stack, best, n_best, seen = [], [], 0, 0
    now, n, after, end = left, 0, None, None
    while True:
        # Down: the first completion, or the next one where the search went back.
        while now is not None and now.any():
            if n_best and n + lower_bound(lengths, now, capacity) >= n_best:
                break
            top, beside, many = rest_of(now)
            more = complete(beside, many, capacity - top) if after is None else next(after, False)
            if more is None and (end is None or seen < end):
                seen += 1
                continue
            if not isinstance(more, list):
                break
            times, fill, used = uses(now, top, more)
            stack.append([now, n, times, fill, used, more, after])
            now, n, after, seen = now - times * used, n + times, None, seen + 1
        else:
            if now is not None and (not n_best or n < n_best):
                best, n_best = [(f[2], sorted(f[3].items(), reverse=True)) for f in stack], n
                if seen == len(stack):  # the first path
                    other = best_fit(lengths, left, capacity) if n_best > least else []
                    if other and sum(t for t, _ in other) < n_best:
                        best, n_best = other, sum(t for t, _ in other)
                    end = None if effort is None else seen + effort
        if n_best <= least or not stack or (end is not None and seen >= end):
            return best
        # Back: one use less of the last filling, and the completions after it.
        before, m, times, fill, used, more, after = stack.pop()
        seen += 1
        if times > 1:
            stack.append([before, m, times - 1, fill, used, more, after])
            before, m, after = before - (times - 1) * used, m + times - 1, None
        if after is None:
            top, beside, many = rest_of(before)
            after = completions(beside, many, capacity - top)
            for skipped in after:
                seen += 1
                if skipped == more or end is not None and seen >= end:
                    break
        now, n = before, m


def slots(fillings: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, copies in a sequence, offset), sorted by length and rank."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for times, fill in fillings:
        offset = 0
        for x, c in fill:
            rows.append((x, rank.get(x, 0), sequence, c, offset))
            rank[x] = rank.get(x, 0) + times * c
            offset += x * c
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


# ---------------------------------------------------------------- on Spark


def _pieces(path: str, capacity: int, end_id: int, keep_pieces: bool):
    def run(batches):
        coder, seen = Encoder.of(path), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            texts = batch.column(0)
            _, offsets = as_bytes(texts)
            for a, b in chunks(offsets, SLICE):
                ids, cut = coder.encode(texts.slice(a, b - a))
                rows, part, piece, start, length, crc = [], batch.column(2)[0].as_py(), [], [], [], []
                for i in range(b - a):
                    own = np.append(ids[cut[i] : cut[i + 1]], np.uint32(end_id)).astype("<u4").tobytes()
                    n = len(own) // 4
                    at, k = 0, 0
                    while at < n:
                        size = min(n, (n - 1) % capacity + 1) if at == 0 else capacity
                        rows.append(a + i)
                        piece.append(k)
                        start.append(at)
                        length.append(size)
                        crc.append(zlib.crc32(own[4 * at : 4 * (at + size)]))
                        at, k = at + size, k + 1
                size = np.array(length)
                order = np.argsort(size, kind="stable")
                same = np.searchsorted(size[order], size[order])
                local = np.empty(len(size), np.int64)
                local[order] = np.arange(len(size)) - same + seen[size[order]]
                seen += np.bincount(size, minlength=capacity + 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.full(len(size), part), pa.int64()), pa.array(local)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "local"],
                )
        if not keep_pieces:
            Encoder.drop(path)

    return run


def _place(table: np.ndarray):
    """Sequence and offset of pieces by (length, rank)."""
    key = table[:, 0] * (1 << 48) + table[:, 1] if len(table) else np.zeros(0, np.int64)

    def run(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            row = table[np.searchsorted(key, length * (1 << 48) + rank, side="right") - 1]
            inner = rank - row[:, 1]
            cols = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(row[:, 2] + inner // row[:, 3]), pa.array(row[:, 4] + inner % row[:, 3] * length)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, tokenizer: str | None = None, keep_pieces: bool = True) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``keep_pieces``: workers remember the ids of pieces from task to task (faster, about 100 MB a worker).
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    base = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long"
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(id_col).alias("doc_id"), F.spark_partition_id().cast("long").alias("part"))
    with batches_of(docs.sparkSession, SLICE):
        pieces = stored(rows.mapInArrow(tidy(_pieces(tokenizer or default_path(), capacity, end_id, keep_pieces)), f"{base}, part long, local long"), "packing-pieces")
    by_part = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {int(r["length"]): int(r["n"]) for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    table = slots(pack_lengths(histogram, capacity))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    firsts = by_part.select("part", "length", F.coalesce(before, F.lit(0)).alias("first"))
    ranked = pieces.join(firsts, ["part", "length"]).withColumn("rank", F.col("first") + F.col("local"))
    return ranked.mapInArrow(_place(table), f"{base}, sequence_id long, offset long")
