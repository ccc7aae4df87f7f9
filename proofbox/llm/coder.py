"""Adaptive context-mixing range coder for token ids, many blocks side by side.

A block is up to ``BLOCK`` ids and starts from a fresh model, so blocks are coded alone and
numpy runs one step of all blocks of a frame at once (a block is a lane). For each id:

* order 2: the id that last followed the same two ids; order 1: the id that last followed
  the same id. Each prediction carries its run of hits as confidence. The share of the
  first prediction is an adaptive probability chosen by its confidence or, where both
  orders name the same id, by the pair of confidences; order 1 gets its adaptive share of
  what is left.
* order 0: what remains goes to all ids by ``Shares``, both bytes of an id at once: whole
  numbers of 2**20 that the caller has measured and keeps beside the blocks (equal ones without).

The mixed probabilities drive a range coder with a 63-bit window and 32-bit output: an id
narrows the interval once, to 2 at least, so one word at most goes out for an id. The bit
above the window takes a sum that passes it: such a carry leaves with the word it belongs to and
is settled at the end. All state is in integers, so the decoder repeats the encoder's
steps exactly. The two orders are the two rows of one array, so a step of both is one numpy call.
The encoder knows all ids, so it has what the predictions were from a sort of each block by slot.

Coded block: the words, 32 bits each, little-endian.
"""

from __future__ import annotations

import numpy as np

BLOCK = 8192
ONE = 1 << 16
_SLOTS, _CELLS = 4096, 80
_TOP = 1 << 31
_LEAST, _MOST = 64, ONE - 2048
#: By an entry xor the id met (with 0 for its run), which is the run of hits after a hit and 8 or more after a miss: the entry's next run; the goal of its share.
_NEXT = np.array([1, 2, 3, 4, 5, 6, 7, 7, 1], np.uint32)
_GOAL = np.array([_MOST] * 8 + [_LEAST], np.int32)
_SHIFT = 20  # order 0 shares of 2**20
_IDS = 1 << 16
_STEPS = 64  # of the encoder at a time
_LANES = 32  # of the encoder's sort at a time
#: Numbers of the decoder's steps: numpy takes arrays faster than Python's integers.
_RUN, _THREE, _APART, _FOUR = (np.array(x, t) for x, t in ((7, np.uint32), (3, np.uint32), (64, np.uint32), (4, np.int32)))
_SIXTEEN, _FINER, _WORD, _LOW = (np.array(x, np.uint64) for x in (16, _SHIFT, 32, _TOP))
#: Slots of order 2 by the id before the last and, with it, by the last; slots of order 1.
_OLDER, _LAST2, _LAST1 = np.random.RandomState(8).randint(0, _SLOTS, (3, _IDS)).astype(np.uint16)
#: The same side by side, four to an id, for one look.
_ALL = np.stack((_OLDER, _LAST2, _LAST1, _LAST1), axis=1).view(np.uint64)[:, 0]


class Shares:
    """Order 0: the share of each id below 2**16, whole numbers that sum to 2**20."""

    def __init__(self, share: np.ndarray):
        share = np.asarray(share, np.uint32)
        if len(share) != _IDS or int(share.sum(dtype=np.int64)) != 1 << _SHIFT:
            raise ValueError("shares of 65536 ids sum to 2**20")
        self.share = share
        self.begin = np.cumsum(share, dtype=np.uint32) - share
        self._id = None
        #: (begin, share) of each id, as the range coder needs them.
        self.both = np.stack((self.begin, share), axis=1).astype(np.uint64)

    @property
    def id(self) -> np.ndarray:
        """The id at each of the 2**20 points."""
        if self._id is None:
            self._id = np.repeat(np.arange(_IDS, dtype=np.uint16), self.share)
        return self._id

    @classmethod
    def of(cls, ids: np.ndarray) -> Shares:
        """Shares by the counts of ``ids``, one at least for each id that occurs."""
        count = np.bincount(ids, minlength=_IDS).astype(np.int64)
        if not len(ids):
            return cls.even()
        there = count > 0
        share = there + count * ((1 << _SHIFT) - int(there.sum())) // len(ids)
        share[np.argmax(share)] += (1 << _SHIFT) - int(share.sum())
        return cls(share)

    @classmethod
    def even(cls) -> Shares:
        return cls(np.full(_IDS, (1 << _SHIFT) // _IDS))


def _odds(lanes: int):
    """(adaptive shares of all lanes, in ``_CELLS`` cells each; where those of a lane begin for either order).

    The first prediction's cell: by the runs of both where they name the same id (8 times the xor of the runs, and its run), else 64 and its run; the second's: 72 and its run.
    """
    odds = np.full((lanes, _CELLS), ONE // 3, np.int32)
    odds[:, [*range(0, 64, 9), *range(0, 80, 8)]] = _LEAST  # a run of 0: nothing met
    return odds.reshape(-1), np.arange(lanes) * _CELLS + np.array([[0], [72]])


def _entries(slot: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """What an order's table holds for each id of some blocks (rows): the id that last came in the slot << 3 | its run of hits, 1 to 7; 0: none came."""
    order = np.argsort(slot, axis=1, kind="stable")
    order += np.arange(len(slot))[:, None] * slot.shape[1]
    slots, now = slot.reshape(-1).take(order, mode="clip"), ids.reshape(-1).take(order, mode="clip")
    again = np.zeros(slot.shape, bool)
    np.equal(slots[:, 1:], slots[:, :-1], out=again[:, 1:])
    hit = np.zeros(slot.shape, bool)
    np.equal(now[:, 1:], now[:, :-1], out=hit[:, 1:])
    hit &= again
    entry = np.zeros(slot.shape, np.uint32)
    entry[:, 1:] = now[:, :-1]
    entry <<= 3
    entry *= again
    run = again.astype(np.uint8)
    for k in range(1, 7):  # one more for each hit in a row before
        again[:, k:] &= hit[:, :-k]
        again[:, :k] = False
        run += again
    entry += run
    held = np.empty(slot.size, np.uint32)
    held[order] = entry
    return held.reshape(slot.shape)


def mixed(apart: np.ndarray, share: np.ndarray):
    """(share of the first prediction, of both) from whether they name different ids and the shares of each, which are in the last axis but one."""
    share = share.view(np.uint32)
    first = share[..., 0, :]
    both = ONE - first
    both *= share[..., 1, :]
    both >>= 16
    both *= apart
    both += first
    return first, both


def _by_length(size):
    order = np.argsort(-np.asarray(size), kind="stable")
    return order, np.asarray(size)[order]


def encode(blocks: list[np.ndarray], shares: Shares | None = None) -> list[bytes]:
    """The coded bytes of each block of ids below 2**16, each of which has a share."""
    if not blocks:
        return []
    shares = shares or Shares.even()
    order, size = _by_length([len(b) for b in blocks])
    lanes, steps = len(blocks), int(size[0])
    ids = np.zeros((lanes, steps), np.uint16)
    for j, i in enumerate(order):
        ids[j, : size[j]] = blocks[i]
    # For each step and lane: whether the predictions name different ids, are right, and their cells.
    apart, right, cells = np.empty((steps, lanes), bool), np.empty((steps, 2, lanes), bool), np.empty((steps, 2, lanes), np.uint8)
    for a in range(0, lanes, _LANES):
        own = ids[a : a + _LANES]
        last = np.zeros((len(own), steps + 2), np.uint16)
        last[:, 2:] = own
        entry = [_entries(slot, own) for slot in (_LAST2.take(last[:, 1:-1]) ^ _OLDER.take(last[:, :-2]), _LAST1.take(last[:, 1:-1]))]
        differ = entry[0] ^ entry[1]
        apart[:, a : a + _LANES] = (differ > 7).T
        cells[:, 0, a : a + _LANES] = (np.minimum(differ << 3, 64) + (entry[0] & 7)).T
        cells[:, 1, a : a + _LANES] = (entry[1] & 7).T
        for j in range(2):
            right[:, j, a : a + _LANES] = ((entry[j] >> 3) == own).T
    ids = np.ascontiguousarray(ids.T)
    low, width = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 63) - 1, np.uint64)
    gone, where = [], []  # the words that went out, with the lanes they belong to
    odds, cell0 = _odds(lanes)
    t = 0
    while t < steps:
        # Steps of the same lanes, a few at a time; what does not depend on the step before is worked out for all of them.
        alive = int(np.searchsorted(-size, -t, side="left"))
        n = min(_STEPS, int(size[alive - 1]) - t)
        now, met = ids[t : t + n, :alive], right[t : t + n, :, :alive]
        cell, goal = cells[t : t + n, :, :alive] + cell0[:, :alive], np.where(met, np.int32(_MOST), np.int32(_LEAST))
        share = np.empty((n, 2, alive), np.int32)
        for at, before, after in zip(cell, share, goal, strict=True):
            # Each step goes a sixteenth of the way to its goal, so shares stay from _LEAST to _MOST.
            odds.take(at, mode="clip", out=before)
            after -= before
            after >>= 4
            after += before
            odds[at] = after
        first, both = mixed(apart[t : t + n, :alive], share)
        hit1, other = met[:, 0], ~(met[:, 0] | met[:, 1])
        # An id begins at ``begin`` and has ``part`` of 2**16; order 0 then begins at ``low0`` and has ``part0`` of 2**20 of that.
        begin = np.where(other, both, first * ~hit1).astype(np.uint64)
        part = np.where(other, ONE - both, np.where(hit1, first, both - first)).astype(np.uint64)
        own = shares.both.take(now, axis=0)
        low0, part0 = own[..., 0] * other, np.where(other, own[..., 1], 1)
        finer = other.astype(np.uint64) * np.uint64(_SHIFT)
        lows, widths = low[:alive], width[:alive]
        for k in range(n):
            unit = widths >> 16
            lows += unit * begin[k]
            unit *= part[k]
            unit >>= finer[k]
            lows += unit * low0[k]
            np.multiply(unit, part0[k], out=widths)
            full = (widths < _TOP).nonzero()[0]
            value = lows.take(full)
            gone.append(value >> 31)
            where.append(full.astype(np.uint32))
            value &= _TOP - 1
            value <<= 32
            lows[full] = value
            widths[full] = widths.take(full) << 32
        t += n
    # One more word names a point of the last interval (zeros follow it); then words come together by lane, and carries settle.
    out, lane = np.concatenate((*gone, (low + (_TOP - 1)) >> 31)), np.concatenate((*where, np.arange(lanes, dtype=np.uint32)))
    del gone, where
    out = out[np.argsort(lane.astype(np.uint16) if lanes <= ONE else lane, kind="stable")]
    while (carry := np.flatnonzero(out >> 32)).size:
        out[carry] &= (1 << 32) - 1
        out[carry - 1] += 1
    ends = np.cumsum(np.bincount(lane, minlength=lanes)).tolist()
    out = out.astype("<u4")
    coded: list[bytes] = [b""] * lanes
    for a, b, i in zip([0, *ends], ends, order.tolist()):
        coded[i] = out[a:b].tobytes()
    return coded


def decode(coded: list[bytes], lengths: list[int], shares: Shares | None = None) -> list[np.ndarray]:
    """The ids of each block."""
    if not coded:
        return []
    shares = shares or Shares.even()
    order, size = _by_length(lengths)
    lanes, steps = len(coded), int(size[0])
    span = max(len(c) // 4 for c in coded) + 3
    words = np.zeros((lanes, span), np.uint32)
    for j, i in enumerate(order):
        words[j, : len(coded[i]) // 4] = np.frombuffer(coded[i], "<u4")
    gap, width = words[:, 0].astype(np.uint64) << 31 | words[:, 1] >> 1, np.full(lanes, (1 << 63) - 1, np.uint64)
    words[:, :-1] = words[:, :-1] << 31 | words[:, 1:] >> 1  # what comes into the window, which is a bit short of two words
    read = np.arange(lanes) * span + 1
    words = words.reshape(-1)
    ids = np.zeros((steps, lanes), np.uint16)
    lane = np.arange(lanes)
    slot0 = lane * 2 * _SLOTS + np.array([[0], [_SLOTS]])
    table = np.zeros(2 * _SLOTS * lanes, np.uint32)  # as ``_entries``
    odds, cell0 = _odds(lanes)
    older, hashes = np.full(lanes, _OLDER[0]), np.full((lanes, 4), _ALL[:1].view(np.uint16))
    alive = -1
    for t in range(steps):
        if alive < 0 or size[alive - 1] <= t:
            alive = int(np.searchsorted(-size, -t, side="left"))
            gap, width, read, older, hashes = gap[:alive], width[:alive], read[:alive], older[:alive], hashes[:alive]
            slot0, cell0, slot = slot0[:, :alive].copy(), cell0[:, :alive].copy(), np.empty((2, alive), np.uint16)
            # Where each way begins, how wide it is and what id it gives: the first prediction, the second, order 0.
            begin, part, name = np.zeros((3, alive), np.uint64), np.empty((3, alive), np.uint64), np.empty((3, alive), np.int64)
            way0, way1, way2 = np.arange(3 * alive).reshape(3, alive)
        np.bitwise_xor(hashes[:, 1], older, out=slot[0])
        slot[1] = hashes[:, 2]
        at = slot + slot0
        entry = table.take(at, mode="clip")
        differ = entry[0] ^ entry[1]
        run = entry & _RUN
        cell = run + cell0
        cell[0] += np.minimum(differ << _THREE, _APART)
        share = odds.take(cell, mode="clip")
        begin[1], begin[2] = mixed(differ > _RUN, share)
        unit = width >> _SIXTEEN
        begin[1:] *= unit
        beyond = gap >= begin[1:]
        way = np.where(beyond[1], way2, np.where(beyond[0], way1, way0))
        unit <<= _SIXTEEN
        unit -= begin[2]
        unit >>= _FINER
        # Where order 0 does not apply the point is any number, and not used.
        code = shares.id.take(((gap - begin[2]) // unit).view(np.int64), mode="clip")
        np.right_shift(entry, _THREE, out=name[:2])
        name[2] = code
        code = name[2]
        part[0] = begin[1]
        np.subtract(begin[2], begin[1], out=part[1])
        own = shares.both.take(code, axis=0, mode="clip")
        np.multiply(unit, own[:, 1], out=part[2])
        unit *= own[:, 0]
        begin[2] += unit
        now = name.take(way, mode="clip")
        gap -= begin.take(way, mode="clip")
        width = part.take(way, mode="clip")
        full = (width < _LOW).nonzero()[0]
        spot, value = read.take(full), gap.take(full)
        value <<= _WORD
        value |= words.take(spot, mode="clip")
        spot += 1
        gap[full], width[full], read[full] = value, width.take(full) << _WORD, spot
        ids[t, :alive] = now
        # Learn the id: the odds go as in the encoder; the entry's next run follows from whether it named the id.
        key = now.astype(np.uint32)
        key <<= _THREE
        place = (entry ^ key).astype(np.int64)
        goal = _GOAL.take(place, mode="clip")
        goal -= share
        goal >>= _FOUR
        goal += share
        odds[cell] = goal
        entry = _NEXT.take(place, mode="clip")
        entry += key
        table[at] = entry
        older, hashes = hashes[:, 0], _ALL.take(now, mode="clip").view(np.uint16).reshape(-1, 4)
    plain: list[np.ndarray] = [np.zeros(0, np.uint32)] * lanes
    for j, i in enumerate(order):
        plain[i] = ids[: size[j], j].astype(np.uint32)
    return plain
