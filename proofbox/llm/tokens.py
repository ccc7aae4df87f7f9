"""Token ids of whole texts with a public tokenizer file (shared by the token-file and packing operators).

A byte-level BPE splits a text into pre-tokens and merges inside each, so a text's ids are
the ids of its pieces, cut where a pre-token surely begins: where a run of Latin letters
ends before another ASCII character, where a run of white space begins, before the last
character of a longer run (a space there belongs to the next word) and after a last
character that is no space. No cut stands beside white space outside ASCII. numpy finds the
cuts and Arrow the distinct pieces of a call; each distinct piece goes through the
tokenizers library (a word of Latin letters alone, which is one pre-token, straight to its
model), and the ids of the texts are then gathered by numpy. A text for which
the cuts are not certain (control separators, special-token strings) goes through the
library whole. At most ``MAX_PIECES`` pieces are remembered; when they are full, only those that
a later call met again stay (most pieces of natural text occur once). Arrow looks the pieces of a call up among those remembered; a look
costs a pass over these, so callers hand over texts of some ``BATCH`` bytes at a time.
"""

from __future__ import annotations

import json
import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from proofbox.llm.common import as_bytes

MAX_PIECES = 400_000
BATCH = 8 << 20
_SPACE, _LETTER, _OTHER, _UNSURE = 1, 2, 4, 8
#: ASCII white space; letters; ASCII that is no letter; control characters that engines differ on.
KIND = np.zeros(256, np.uint8)
KIND[:128] = _OTHER
KIND[65:91] = KIND[97:123] = _LETTER
KIND[9:14] = KIND[32] = _OTHER | _SPACE
KIND[0] = KIND[28:32] = _OTHER | _UNSURE


def _wide_space(data: np.ndarray) -> np.ndarray | None:
    """Marks the bytes of white space outside ASCII (and of U+180E, which engines differ on)."""
    out = None
    for lead, second, last in ((0xC2, (0x85, 0xA0), None), (0xE1, (0x9A,), (0x80,)), (0xE1, (0xA0,), (0x8E,)), (0xE2, (0x80,), (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), (0xE2, (0x81,), (0x9F,)), (0xE3, (0x80,), (0x80,))):
        at = np.flatnonzero(data == lead)
        at = at[np.isin(data[at + 1], second)]
        if last is not None and len(at):
            at = at[np.isin(data[at + 2], last)]
        if len(at):
            out = np.zeros(len(data), bool) if out is None else out
            for k in range(2 if last is None else 3):
                out[at + k] = True
    return out


def cuts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts of the pieces of some texts in their UTF-8 bytes, texts without certain cuts)."""
    n = len(data)
    kind = KIND[data]
    space, letter = (kind & _SPACE).astype(bool), (kind & _LETTER).astype(bool)
    letter[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)  # the last bytes of U+00C0 to U+00FF
    wide = _wide_space(data)
    blank = space if wide is None else space | wide
    mark = np.zeros(n + 1, bool)
    here = mark[1:n]  # a cut before byte i is here[i - 1]
    here |= letter[:-1] & (kind[1:] & _OTHER).astype(bool)
    here |= space[1:] & ~blank[:-1]
    edge = np.zeros(n, bool)  # bytes at which a text begins
    edge[offsets[:-1][offsets[:-1] < n]] = True
    if n > 2:
        here[:-1] |= space[:-2] & space[1:-1] & ~blank[2:] & ~edge[2:]
    after = space[:-1] & (data[:-1] != 32) & ~blank[1:]
    if wide is not None:
        after[1:] &= ~wide[:-2]
    here |= after
    mark[:n] |= edge
    mark[n] = False
    odd = np.flatnonzero((kind & _UNSURE).astype(bool) | np.append((data[:-1] == 60) & (data[1:] == 124), False))
    return np.flatnonzero(mark), np.unique(np.searchsorted(offsets, odd, side="right") - 1)


def _byte_characters() -> dict[int, str]:
    """The character that a byte-level vocabulary writes for each byte: itself where it can be seen, else one from U+0100 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(seen)))}


_CHARACTER = _byte_characters()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of texts, as one flat array with offsets."""

    _held: dict[str, Encoder] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]

    @classmethod
    def drop(cls, path: str) -> None:
        """Forget the encoder of this worker, its tokenizer with it."""
        cls._held.pop(path, None)

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Bytes of each id: a byte-level vocabulary writes each byte as one character.
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.length = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, i in vocabulary.items():
            self.length[i] = len(token)
        # Whether a run of letters and the space before it is one pre-token, and its ids are what the model makes of it.
        told = json.loads(self.tokenizer.to_str())
        split, model = told["pre_tokenizer"] or {}, told["model"]
        self.plain = (
            told["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split["add_prefix_space"]
            and model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix"))
        )
        self.forget()

    def forget(self) -> None:
        self.names = pa.array([], pa.string())
        self.flat, self.start = array("I"), array("I", [0])
        self.again = np.zeros(MAX_PIECES, bool)  # met by a call after the one that learned it

    @property
    def number(self) -> dict[str, int]:
        """The number of each piece that is remembered."""
        return {name: i for i, name in enumerate(self.names.to_pylist())}

    def _make_room(self) -> np.ndarray:
        """Keep the pieces met again since the last time; all go if those fill most of the room. Returns the new number of each, -1 where it went."""
        n = len(self.names)
        new = np.full(n, -1)
        stay = np.flatnonzero(self.again[:n])
        if len(stay) > MAX_PIECES * 3 // 4:
            self.forget()
            return new
        names, flat, start = self.names, np.array(self.flat, np.uint32), np.array(self.start, np.int64)
        size = np.diff(start)
        kept = np.zeros(n, bool)
        kept[stay] = True
        self.forget()
        self.names = names.take(pa.array(stay))
        self.flat.frombytes(flat[np.repeat(kept, size)].tobytes())
        self.start.frombytes(np.cumsum(size[stay]).astype(np.uint32).tobytes())
        new[stay] = np.arange(len(stay))
        return new

    def _learn(self, pieces: pa.StringArray) -> np.ndarray:
        """The numbers of pieces that none is known of; words go through the library many at a time."""
        # Words with one space before them, end to end, stay apart; their lengths in bytes show where each ends.
        names, size = pieces.to_pylist(), pc.binary_length(pieces).to_numpy()
        data, offsets = as_bytes(pieces)
        latin = (np.maximum.reduceat(data, offsets[:-1]) < 0xC9).tolist()  # up to U+023F, where engines agree what a letter is
        letters, words, other, learned = [], [], [], []
        for i, p in enumerate(names):
            if p[0] != " ":
                other.append(i)
            elif latin[i] and self.plain and p[1:].isalpha():
                letters.append(i)
            else:
                (words if p[1:].split() == [p[1:]] else other).append(i)

        def together(part, ids):
            ids = np.array(ids, np.uint32)
            reach, wanted = self.length[ids].cumsum(), size[part].cumsum()
            ends = reach.searchsorted(wanted) + 1
            if ends[-1] != len(ids) or not np.array_equal(reach[ends - 1], wanted):  # a tokenizer that doesn't keep words apart
                other.extend(part)
                return
            at = len(self.flat) + ends
            self.flat.frombytes(ids.tobytes())
            self.start.frombytes(at.astype(np.uint32).tobytes())
            learned.extend(part)

        for lo in range(0, len(letters), 32):
            part = letters[lo : lo + 32]
            whole = "".join([names[i] for i in part]).encode().decode("latin-1").translate(_CHARACTER)
            together(part, [t.id for t in self.tokenizer.model.tokenize(whole)])
        for lo in range(0, len(words), 64):
            part = words[lo : lo + 64]
            together(part, self.tokenizer.encode_batch_fast(["".join([names[i] for i in part])], add_special_tokens=False)[0].ids)
        for lo in range(0, len(other), 4096):
            part = other[lo : lo + 4096]
            for coded in self.tokenizer.encode_batch_fast([names[i] for i in part], add_special_tokens=False):
                self.flat.extend(coded.ids)
                self.start.append(len(self.flat))
            learned += part
        number = np.empty(len(names), np.int64)
        number[learned] = len(self.names) + np.arange(len(learned))
        self.names = pa.concat_arrays([self.names, pieces.take(pa.array(learned, pa.int64()))])
        return number

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): the ids of text i are ids[offsets[i]:offsets[i + 1]]. Texts: a list or an Arrow string column; null counts as empty."""
        data, offsets = as_bytes(pa.array(texts, pa.string()) if isinstance(texts, list) else texts)
        n = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        at, unsure = cuts(data, offsets)
        if len(unsure):
            drop = np.zeros(n, bool)
            drop[unsure] = True
            whole = {i: np.array(self.tokenizer.encode(data[offsets[i] : offsets[i + 1]].tobytes().decode(), add_special_tokens=False).ids, np.uint32) for i in unsure.tolist()}
        column = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(data)).astype(np.int32)), pa.py_buffer(data)).dictionary_encode()
        names, place = column.dictionary, column.indices.to_numpy()
        known = pc.fill_null(pc.index_in(names, value_set=self.names), -1).to_numpy().astype(np.int64)
        fresh = np.flatnonzero(known < 0)
        if len(self.names) + len(fresh) > MAX_PIECES:
            new = self._make_room()
            known = np.where(known < 0, -1, new[known]) if len(new) else known
            if len(self.names) + int((known < 0).sum()) > MAX_PIECES:
                self.forget()
                known[:] = -1
            fresh = np.flatnonzero(known < 0)
        self.again[known[known >= 0]] = True
        if len(fresh):
            known[fresh] = self._learn(names.take(pa.array(fresh)))
        start = np.frombuffer(self.start, np.uint32)
        first, size = start[known].astype(np.int64)[place], (start[known + 1] - start[known]).astype(np.int64)[place]
        ends = np.concatenate(([0], np.cumsum(size)))
        flat = np.frombuffer(self.flat, np.uint32)
        ids = flat[np.arange(ends[-1]) + np.repeat(first - ends[:-1], size)]
        cut = ends[np.searchsorted(at, offsets)]
        if not len(unsure):
            return ids, cut
        parts = [whole[i] if drop[i] else ids[cut[i] : cut[i + 1]] for i in range(n)]
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
