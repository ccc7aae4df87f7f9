"""Secret scan: fixed patterns, and dictionary-primed zstandard novelty (operator 3).

Base spans are the leftmost, non-overlapping matches of each fixed pattern that are long
enough. The method adds the kind ``novel``: a string of at least ``MIN_CANDIDATE`` token
characters with letters and digits that starts within ``REACH`` characters after a
sensitive word is a candidate; its marginal size is what zstandard needs for it when primed
with the identifier dictionary and the text around it (``AROUND`` characters on each side,
without the candidate). Names, paths and repeated identifiers are copied from the dictionary
and cost little; a candidate that still costs ``NOVELTY`` of its length, or what its own
alphabet needs (a long key of few characters is entropy-coded), is incompressible there and
is reported, unless a base span covers it already.

Every text is scanned whole, by itself: no shuffle. Nulls count as empty and give no spans.
Rows that repeat an id are scanned each. An empty table gives no rows. ``scan`` returns its
own columns only; ``redact`` keeps those of its input.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofbox.llm.common import as_bytes, chunks, tidy

# The base patterns, their least lengths and the order of kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "novel")

# Words that make a context sensitive, and common identifiers of code and configuration.
SENSITIVE = re.compile(r"password|passwd|passphrase|secret|token|api[ _-]?key|private[ _-]?key|access[ _-]?key|credential|bearer|authorization|signature", re.ASCII | re.IGNORECASE)
IDENTIFIERS = (
    "abstract access account address algorithm application argument array assert async attribute authentication authorization await background base64 "
    "boolean buffer callback certificate char class client column command compile component config configuration connection constant constructor container "
    "content context control convert count create current database debug declare default define delete dependency description development device dictionary "
    "directory document domain double download dynamic element encoding encryption endpoint environment error event example exception execute export "
    "expression extension false field file filter final float folder format function generate generator handler header height hidden host http https "
    "identifier image implementation implements import index information initialize input install instance integer interface internal iterator javascript "
    "keyword language length library license localhost location logger manager master memory message metadata method minimum model module namespace network "
    "notification null number object operation option output package parameter password path pattern permission placeholder platform plugin pointer port "
    "position primary private process production profile program project property protected protocol provider public python query random receive record "
    "reference register release remote repository request require resource response return runtime sample schema script secret section security select "
    "sequence server service session setting signature size source standard static status storage string struct style subscription super switch system table "
    "target template test text thread timeout timestamp token transaction transform true type undefined update upload user username utility validation value "
    "variable version virtual void volume warning website window workspace 0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ"
)
MIN_CANDIDATE, REACH, AROUND, NOVELTY = 16, 48, 256, 0.6
#: Bytes that zstandard takes besides, as for a run of one character.
FIXED = 10
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIN_CANDIDATE},}}")
#: One of these is in every lower-cased text that ASSIGN or SENSITIVE matches.
HINTS = ("pass", "secret", "token", "api", "key", "credential", "bearer", "authorization", "signature")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base spans."""
    low = text.lower()
    found = []
    if any(h in low for h in ("password", "passwd", "secret", "token", "api")):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def marginal_bytes(candidate: str, around: str) -> int:
    """Bytes that zstandard needs for ``candidate`` after the identifiers and ``around``."""
    primed = zstandard.ZstdCompressionDict((IDENTIFIERS + "\n" + around).encode("utf-8", "replace"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    pack = zstandard.ZstdCompressor(level=19, dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False)
    return len(pack.compress(candidate.encode())) - len(pack.compress(b""))


def novelty_bar(candidate: str) -> float:
    """The marginal bytes from which ``candidate`` is incompressible."""
    return min(NOVELTY * len(candidate), len(candidate) * math.log2(len(set(candidate))) / 8 + FIXED)


def novel_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    low = text.lower()
    if not any(h in low for h in HINTS):
        return []
    found, reached = [], -1
    for word in SENSITIVE.finditer(text):
        m = CANDIDATE.search(text, max(reached, word.end()))
        while m and m.start() <= word.end() + REACH:
            start, end = m.span()
            reached, m = end, CANDIDATE.search(text, end)
            value = text[start:end]
            if not (any(c.isdigit() for c in value) and any(c.isalpha() for c in value)):
                continue
            if any(s <= start and end <= e for s, _, e in base):
                continue
            around = text[max(0, start - AROUND) : start] + text[end : end + AROUND]
            if marginal_bytes(value, around) >= novelty_bar(value):
                found.append((start, 3, end))
    return found


def spans(text: str) -> list[tuple[int, int, int]]:
    base = base_spans(text)
    return sorted(base + novel_spans(text, base))


def _joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def _scan(batches):
    for batch in batches:
        rows = []
        column = batch.column(0)
        _, offsets = as_bytes(column)
        for a, b in chunks(offsets):
            for text in column.slice(a, b - a).to_pylist():
                found = spans(text)
                base = [x for x in found if x[1] < 3]
                n = np.bincount([k for _, k, _ in found], minlength=4).tolist()
                rows.append((*n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(found)))
        cols = list(zip(*rows, strict=True)) if rows else [()] * 6
        yield pa.RecordBatch.from_arrays(
            [batch.column(1), *[pa.array(c, pa.int64()) for c in cols[:4]], *[pa.array(c, pa.string()) for c in cols[4:]]], names=["doc_id", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"]
        )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, n_novel, base_sha256, spans."""
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(id_col).alias("doc_id"))
    id_type = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(tidy(_scan), f"doc_id {id_type}, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string")


def redacted(text: str, mark: str) -> str:
    """``text`` with every secret (overlapping spans as one) replaced by ``mark``."""
    out, at = [], 0
    for s, _, e in spans(text):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", length_col: str | None = None) -> DataFrame:
    """``docs`` with secrets replaced in ``text_col``; ``length_col``, if named, follows the new text."""
    place = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            _, offsets = as_bytes(batch.column(place))
            for a, b in chunks(offsets):
                part = batch.slice(a, b - a)
                texts = [t if t is None else redacted(t, mark) for t in part.column(place).to_pylist()]
                yield part.set_column(place, batch.schema.names[place], pa.array(texts, batch.schema.types[place]))

    out = docs.mapInArrow(tidy(run), T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema.fields]))
    if length_col:
        out = out.withColumn(length_col, F.char_length(F.col(text_col)).cast(docs.schema[length_col].dataType))
    return out
