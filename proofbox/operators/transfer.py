"""Balance transfer functions: what a run of ordered moves does to any opening balance.

A deposit shifts every balance; a withdrawal shifts the balances that cover it and leaves the others; a
payment is a withdrawal that, where it is covered, earns too; a
revert shifts the balances that cover it and sets the others to 0. So a run of moves is a
piecewise function of the opening balance: on each interval between sorted breakpoints the closing
balance is the opening balance plus an offset, or a constant (after a floor). A move only splits
intervals at one balance each or merges neighbours, and two runs in a row are one function again. With
these a key's balance can be looked up after any run without replaying what came before it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LOWEST = -(1 << 62)
HIGHEST = 1 << 62
_LEAF = 32
# Kinds of moves.
DEPOSIT, WITHDRAW, PAYMENT, REVERT = "deposit", "withdraw", "payment", "revert"


@dataclass
class Transfer:
    """Intervals [start[i], start[i+1]): closing balance = offset[i] + opening balance if slope[i] else offset[i]."""

    start: np.ndarray
    slope: np.ndarray
    offset: np.ndarray

    def __call__(self, balance: int) -> int:
        i = int(np.searchsorted(self.start, balance, side="right")) - 1
        return int(self.offset[i]) + (balance if self.slope[i] else 0)

    def __len__(self) -> int:
        return len(self.start)


def identity() -> Transfer:
    return Transfer(np.array([LOWEST], np.int64), np.ones(1, bool), np.zeros(1, np.int64))


def _merged(start: np.ndarray, slope: np.ndarray, offset: np.ndarray) -> Transfer:
    new = np.ones(len(start), bool)
    new[1:] = (slope[1:] != slope[:-1]) | (offset[1:] != offset[:-1])
    return Transfer(start[new], slope[new], offset[new])


def after_move(f: Transfer, kind: str, amount: int, earn: int = 0) -> Transfer:
    """``f`` followed by one move; ``earn`` is what a covered payment brings."""
    if kind == DEPOSIT:
        return Transfer(f.start, f.slope, f.offset + amount)
    if kind not in (WITHDRAW, PAYMENT, REVERT):
        return f
    end = np.append(f.start[1:], HIGHEST)
    # The least opening balance of each interval that covers the amount.
    covers = np.where(f.slope, amount - f.offset, np.where(f.offset >= amount, LOWEST, HIGHEST))
    split = (f.start < covers) & (covers < end)
    at = np.repeat(np.arange(len(f.start)), 1 + split)
    upper = np.zeros(len(at), bool)
    upper[1:] = at[1:] == at[:-1]
    start = np.where(upper, covers[at], f.start[at])
    paid = start >= covers[at]
    slope, offset = f.slope[at], f.offset[at]
    if kind != REVERT:
        return _merged(start, slope, np.where(paid, offset - amount + (earn if kind == PAYMENT else 0), offset))
    return _merged(start, slope & paid, np.where(paid, offset - amount, 0))


def then(f: Transfer, g: Transfer) -> Transfer:
    """The function of both runs, first ``f``, then ``g``."""
    end = np.append(f.start[1:], HIGHEST)
    shift = np.where(f.slope, f.offset, 0)
    low = np.where(f.slope, f.start + shift, f.offset)
    high = np.where(f.slope, end - 1 + shift, f.offset)
    first = np.maximum(np.searchsorted(g.start, low, side="right") - 1, 0)
    last = np.maximum(np.searchsorted(g.start, high, side="right") - 1, 0)
    n = last - first + 1
    at = np.repeat(np.arange(len(f.start)), n)
    piece = first[at] + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    start = np.where(piece == first[at], f.start[at], g.start[piece] - shift[at])
    slope = f.slope[at] & g.slope[piece]
    offset = g.offset[piece] + np.where(g.slope[piece], f.offset[at], 0)
    return _merged(start, slope, offset)


def of_moves(kinds: list[str], amounts: list[int], earns: list[int] | None = None) -> Transfer:
    """The function of a run of moves: short runs move by move, then joined pair by pair."""
    parts, moves = [], list(zip(kinds, amounts, earns or [0] * len(kinds)))
    for lo in range(0, len(moves), _LEAF):
        f = identity()
        for move in moves[lo : lo + _LEAF]:
            f = after_move(f, *move)
        parts.append(f)
    while len(parts) > 1:
        parts = [then(parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] if parts else identity()


def replay(kinds: list[str], amounts: list[int], balance: int, earns: list[int] | None = None) -> tuple[list[bool], list[int], list[str | None], int]:
    """Apply moves in order: accepted, balance after and reason of each, and the closing balance."""
    accepted, after, reasons = [], [], []
    for kind, amount, earn in zip(kinds, amounts, earns or [0] * len(kinds)):
        ok, reason = True, None
        if kind == DEPOSIT:
            balance += amount
        elif kind in (WITHDRAW, PAYMENT):
            if balance >= amount:
                balance += (earn if kind == PAYMENT else 0) - amount
            else:
                ok, reason = False, "insufficient_balance"
        elif kind == REVERT:
            balance = max(0, balance - amount)
        else:
            ok, reason = False, "unknown_kind"
        accepted.append(ok)
        after.append(balance)
        reasons.append(reason)
    return accepted, after, reasons, balance
