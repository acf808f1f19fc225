"""Secret scans with a recursive decoding worklist.

Patterns are searched in the text and in every layer hidden in it. A layer is the text with all regions of one encoding
- percent escapes, Unicode escapes, base64 in a run or in lines - replaced by what they decode to; bytes that turn out to be
compressed are inflated until they are not, over all members. Layers wait in a
worklist; each is scanned and decoded again until nothing new appears. A layer seen before is not taken up again, so
texts that decode to themselves end. Every character of a layer knows the span of the original text it stems from, and a
find in a layer is reported there if it touches decoded characters.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import unicodedata
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effortloom.llm.common import pin_python

KINDS = ("assign", "access", "hex")
#: The patterns of the three kinds, with the group that has to reach the least length.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST_VALUE = 6

PERCENT = r"(?:%[0-9A-Fa-f]{2})+"
ESCAPE = r"\\u\{[0-9A-Fa-f]{1,6}\}|(?:\\u[0-9A-Fa-f]{4})+"
BASE64 = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}(?![A-Za-z0-9+/_=-])"
#: Base64 cut into lines, as mail and command line tools do.
WRAPPED = r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/]{60,76}\r?\n)+[A-Za-z0-9+/]{1,76}={0,2}(?![A-Za-z0-9+/_=-])"
#: What a layer takes in at most; it bounds a worker's memory. A compressed region beyond it is not put into the layer but
#: scanned by itself, chunk by chunk, and the row says so in ``layers_cut``.
MAX_LAYER = 1 << 26
#: Share of a decoded region that may be no text.
ODD_SHARE = 0.1
#: Characters by which chunks of a streamed region overlap.
OVERLAP = 4096

_assign = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
_access, _hex = re.compile(ACCESS), re.compile(HEX)
_decodable = {
    "url": re.compile(PERCENT), "unicode": re.compile(ESCAPE), "wrapped": re.compile(WRAPPED), "base64": re.compile(BASE64),
}


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the plain patterns, leftmost and not overlapping per kind. Runs of the two plain kinds are
    whole runs, so the least length may stand in the pattern."""
    found = [("assign", m.start(), m.end()) for m in _assign.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    found += [("access", *m.span()) for m in _access.finditer(text)]
    return found + [("hex", *m.span()) for m in _hex.finditer(text)]


def _is_text(c: str) -> bool:
    return c.isprintable() or c.isspace() or unicodedata.category(c) == "Cf"


def _text(data: bytes) -> str | None:
    """The bytes as text, wrong bytes as lone surrogates; None where more than ``ODD_SHARE`` is no text."""
    text = data.decode(errors="surrogateescape")
    if not text or (text.isascii() and text.isprintable()):
        return text or None
    return text if sum(not _is_text(c) for c in text) <= ODD_SHARE * len(text) else None


def _widths(text: str) -> np.ndarray:
    """Bytes that each character of ``_text`` stands for."""
    return np.array([1 if "\udc80" <= c <= "\udcff" else len(c.encode("utf-8", "surrogatepass")) for c in text], dtype=np.int64)


def _packed(data: bytes) -> bool:
    return data[:2] == b"\x1f\x8b" or (data[:1] == b"\x78" and len(data) > 1 and int.from_bytes(data[:2]) % 31 == 0)


def _inflated(data: bytes, step: int) -> Iterator[bytes]:
    """Decompressed bytes of all gzip or zlib members in ``data``, in pieces of ``step`` or less. Ends where a member breaks."""
    while _packed(data):
        machine = zlib.decompressobj(47)
        while not machine.eof:
            try:
                out = machine.decompress(data, step)
            except zlib.error:
                return
            data = machine.unconsumed_tail
            if out:
                yield out
            elif not data:
                return
        data = machine.unused_data


def _unpacked(data: bytes, limit: int) -> tuple[bytes, bool]:
    """``data`` inflated until it is no longer compressed, and whether it was at all; OverflowError beyond ``limit``."""
    was = False
    while _packed(data):
        out, size = [], 0
        for piece in _inflated(data, max(1, min(limit + 1, 1 << 20))):
            out.append(piece)
            size += len(piece)
            if size > limit:
                raise OverflowError
        if not size:
            break
        data, was = b"".join(out), True
    return data, was


def _kinds_in(data: bytes, step: int = 1 << 20) -> set[str]:
    """Kinds of secrets in what compressed ``data`` holds, read as a stream: its pieces are scanned with an overlap and with
    the layers inside them, none is kept. Compressed pieces in it are streamed in turn as far as they are whole."""
    found: set[str] = set()
    tail = ""
    for piece in _inflated(data, step):
        if _packed(piece):
            found |= _kinds_in(piece, step)
        text = tail + piece.decode("utf-8", "surrogateescape")
        found |= {kind for kind, _, _ in scan(text, step * 4)[1]}
        if len(found) == len(KINDS):
            break
        tail = text[-OVERLAP:]
    return found


def _bytes_of(kind: str, region: str) -> bytes | None:
    if kind == "url":
        return bytes.fromhex(region.replace("%", ""))
    body = re.sub("[\r\n]", "", region).rstrip("=").translate(str.maketrans("-_", "+/"))
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4))
    except binascii.Error:
        return None


def _decode(kind: str, region: str, limit: int) -> tuple[str, list[tuple[int, int]] | None] | None:
    """Decoded text of a region and, per character, its span in the region (None: the whole region). None if the region
    is not valid; OverflowError if it would be too large."""
    if kind == "unicode":
        if region.startswith("\\u{"):
            code = int(region[3:-1], 16)
            return (chr(code), None) if code < 0x110000 and _is_text(chr(code)) else None
        try:
            text = bytes.fromhex(region.replace("\\u", "")).decode("utf-16-be")
        except UnicodeDecodeError:
            return None
        if not all(map(_is_text, text)):
            return None
        ends = np.cumsum([6 if ord(c) < 0x10000 else 12 for c in text]).tolist()
        return text, list(zip([0, *ends[:-1]], ends, strict=True))
    data = _bytes_of(kind, region)
    if data is None:
        return None
    data, was = _unpacked(data, limit)
    text = _text(data)
    if text is None or was:
        return None if text is None else (text, None)
    ends = np.cumsum(_widths(text)).tolist()
    if kind == "url":
        return text, [(3 * a, 3 * b) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    at = [k for k, c in enumerate(region) if c not in "\r\n="]  # places of the digits; wrapped lines are one run
    return text, [(at[a * 4 // 3], at[min(len(at), -(-b * 4 // 3)) - 1] + 1) for a, b in zip([0, *ends[:-1]], ends, strict=True)]


class Layer:
    """A text with, per character, its span in the original text and whether it was decoded."""

    def __init__(self, text: str, starts: np.ndarray, ends: np.ndarray, decoded: np.ndarray):
        self.text, self.starts, self.ends, self.decoded = text, starts, ends, decoded
        self.cut = False
        self.streamed: list[tuple[str, int, int]] = []  # finds in regions that are too large for a layer

    @classmethod
    def plain(cls, text: str) -> Layer:
        at = np.arange(len(text) + 1)
        return cls(text, at[:-1], at[1:], np.zeros(len(text), dtype=bool))

    def unwrap(self, kind: str, limit: int) -> Layer | None:
        """The layer with every region of ``kind`` decoded; None if there is none."""
        pieces, starts, ends, decoded, last, size = [], [], [], [], 0, 0
        for m in _decodable[kind].finditer(self.text):
            try:
                got = _decode(kind, m.group(), limit - size)
            except OverflowError:
                a, b = m.span()
                span = int(self.starts[a]), int(self.ends[b - 1])
                self.streamed += [(found, *span) for found in _kinds_in(_bytes_of(kind, m.group()))]
                self.cut = True
                continue
            if got is None:
                continue
            text, inner = got
            a, b = m.span()
            for part, source in ((pieces, self.text), (starts, self.starts), (ends, self.ends), (decoded, self.decoded)):
                part.append(source[last:a])
            pieces.append(text)
            if inner is None:
                starts.append(np.full(len(text), self.starts[a]))
                ends.append(np.full(len(text), self.ends[b - 1]))
            else:
                spans = np.array(inner) + a
                starts.append(self.starts[spans[:, 0]])
                ends.append(self.ends[spans[:, 1] - 1])
            decoded.append(np.ones(len(text), dtype=bool))
            last, size = b, size + len(text)
        if not last:
            return None
        for part, source in ((pieces, self.text), (starts, self.starts), (ends, self.ends), (decoded, self.decoded)):
            part.append(source[last:])
        return Layer("".join(pieces), np.concatenate(starts), np.concatenate(ends), np.concatenate(decoded))


def scan(text: str, limit: int = MAX_LAYER) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]], int, bool]:
    """Base finds, all finds (both sorted by start and kind), number of layers and whether a region was too large for a layer and was
    scanned as a stream."""
    order = {kind: k for k, kind in enumerate(KINDS)}

    def place(s: tuple[str, int, int]) -> tuple:
        return s[1], order[s[0]], s[2]

    base = sorted(find(text), key=place)
    if not any(p.search(text) for p in _decodable.values()):
        return base, base, 1, False
    spans, cut, layers = set(base), False, 1
    seen = {hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()}
    work = deque([Layer.plain(text)])
    while work:
        layer = work.popleft()
        for kind in _decodable:
            inner = layer.unwrap(kind, limit)
            if inner is None:
                continue
            mark = hashlib.blake2b(inner.text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
            if mark in seen:
                continue
            seen.add(mark)
            work.append(inner)
            layers += 1
            for kind_found, a, b in find(inner.text):
                if inner.decoded[a:b].any():
                    spans.add((kind_found, int(inner.starts[a:b].min()), int(inner.ends[a:b].max())))
        spans.update(layer.streamed)
        cut |= layer.cut
    return base, sorted(spans, key=place), layers, cut


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_layer: int = MAX_LAYER) -> DataFrame:
    """``doc_id``, ``base`` and ``spans`` (arrays of kind, start, end in code points of the text, end exclusive),
    ``layers`` and ``layers_cut`` of every row.

    A NULL or empty text has no finds. Rows with equal ids are scanned one by one. An empty table gives an empty result.
    """
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def as_rows(found: list[tuple[str, int, int]]) -> list[dict]:
        return [{"kind": k, "start": a, "end": b} for k, a, b in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                scan(text or "", max_layer)
                for at in range(0, batch.num_rows, 64)
                for text in batch.column(1).slice(at, 64).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([as_rows(r[0]) for r in rows], pa.list_(span)), pa.array([as_rows(r[1]) for r in rows], pa.list_(span)),
                    pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.bool_()),
                ],
                names=["doc_id", "base", "spans", "layers", "layers_cut"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = "array<struct<kind: string, start: bigint, end: bigint>>"
    return pin_python(rows.mapInArrow(run, f"doc_id bigint, base {kind}, spans {kind}, layers bigint, layers_cut boolean"))
