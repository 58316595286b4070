"""Harmonic packing of token sequences (operator 8).

A document's ids are cut into full sequences of CAPACITY tokens and a rest of
r < CAPACITY tokens. The rest belongs to the reciprocal-capacity class
k = min(CAPACITY // r, CLASSES): its length lies in (CAPACITY/(k+1),
CAPACITY/k], so a bin of class k takes exactly k rests. The gap of a bin that
has its k rests is topped up with pieces cut from one filler document, so full
sequences carry no padding and most documents stay uncut. Every task packs its
own rows, with no exchange: it holds at most one open bin per class and one
filler. What is left at its end is laid end to end, cut at CAPACITY, and the
last stretch is cut into powers of two, which need no padding either.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import cached_property
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from plexnet.llm.common import read_table
from plexnet.llm.merges import WHITE, MergeTable, in_a_row
from plexnet.shipping import ensure_importable

CAPACITY, CLASSES, END_ID = 4096, 32, 2
#: Bytes of the pieces that a worker remembers, and of their ids, before it starts anew (bounds its memory).
CACHE_BYTES = 24_000_000
#: Bytes at which a block of texts ends (bounds its arrays).
BLOCK_BYTES = 2_000_000

_WHITE, _LETTER, _DIGIT, _SIGN, _ODD = range(5)
_SPACES = re.findall(f"[{WHITE}]", "".join(map(chr, range(0x3001))))
#: Chunks made of these characters are composed (NFC) already, and their lower
#: case is one of them and does not depend on the neighbours; others go to the
#: library whole.
_RANGE = frozenset(chr(c) for c in (*range(33, 127), *range(0xC0, 0x250)))
_PLAIN = frozenset(c for c in _RANGE if c.lower() in _RANGE)


def _kind(c: str) -> int:
    if c in _SPACES:
        return _WHITE
    if c not in _PLAIN:
        return _ODD
    return _DIGIT if c in "0123456789" else _LETTER if c.isalpha() else _SIGN


#: By code point, up to one past the last white space: how a character counts; by byte: the same, and ASCII lower case.
_KINDS = np.array([_kind(chr(c)) for c in range(0x3002)], np.uint8)
_BYTE_KINDS = bytes(_KINDS[:128]) + bytes([_ODD]) * 128
_BYTE_LOWER = bytes(range(256)).lower()
#: The lower case of two-byte characters, by code point.
_LOWER = np.array([ord(c.lower()) if c in _PLAIN else ord(c) for c in map(chr, range(0x800))], np.uint16)


def _blocks(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in blocks that end once they have BLOCK_BYTES bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK_BYTES)) + 1
        yield texts[at:to]
        at = to


def pieces_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The pieces of all texts (strings without nulls) in a row, and their
    number up to the end of each text. A piece is a word, a digit or a run of
    signs, in lower case, or a chunk between white space for the library, as
    it came."""
    at = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    raw = memoryview(texts.buffers()[2] or b"")[at[0]:at[-1]].tobytes()
    at = at - at[0]
    byte, low = np.frombuffer(raw, np.uint8), np.frombuffer(bytearray(raw.translate(_BYTE_LOWER)), np.uint8)
    kind = np.frombuffer(bytearray(raw.translate(_BYTE_KINDS)), np.uint8)
    two = np.flatnonzero((byte >= 0xC2) & (byte < 0xE0))
    code = (byte[two] & 31).astype(np.int64) << 6 | byte[two + 1] & 63
    kind[two] = kind[two + 1] = _KINDS[code]
    low[two], low[two + 1] = 0xC0 | _LOWER[code] >> 6, 0x80 | _LOWER[code] & 63
    three = np.flatnonzero((byte >= 0xE1) & (byte <= 0xE3))
    code = (byte[three] & 15).astype(np.int64) << 12 | (byte[three + 1] & 63).astype(np.int64) << 6 | byte[three + 2] & 63
    three = three[_KINDS[np.minimum(code, len(_KINDS) - 1)] == _WHITE]
    for i in range(3):
        kind[three + i] = _WHITE

    word = kind != _WHITE
    # a place past the end counts as white space
    head = np.zeros(len(raw) + 1, bool)  # where a text begins
    head[at] = True
    first = word.copy()  # where a chunk begins
    first[1:] &= ~word[:-1] | head[1:-1]
    cut = first | (kind == _DIGIT)
    cut[1:] |= word[1:] & (kind[1:] != kind[:-1])
    # 's 't 'm 'd 're 've 'll are one piece where no sign stands before
    mark = np.flatnonzero((byte == 39) & cut)
    after = np.append(low, np.zeros(2, np.uint8))
    ends = np.append(~word, [True, True])
    ends[:-1] |= head
    one, second = after[mark + 1], after[mark + 2]
    size = np.where(np.isin(one, list(b"stmd")), 1, 0)
    size[~ends[mark + 2] & (np.isin(one, list(b"rv")) & (second == ord("e")) | (one == ord("l")) & (second == ord("l")))] = 2
    size[ends[mark + 1]] = 0
    mark, size = mark[size > 0], size[size > 0]
    cut[mark + 1] = False
    mark = (mark + size + 1)[~ends[mark + size + 1]]
    cut[mark] = True

    odd = np.flatnonzero(kind == _ODD)
    if b"<|" in raw:
        odd = np.union1d(odd, np.flatnonzero((byte[:-1] == 60) & (byte[1:] == 124)))
    if len(odd):
        begin = np.flatnonzero(first)
        whole = np.unique(np.searchsorted(begin, odd, "right") - 1)
        last = np.flatnonzero(word & ends[1:-1])
        inside = np.zeros(len(raw) + 1, np.int8)
        inside[begin[whole]] += 1
        inside[last[whole] + 1] -= 1
        inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
        cut[inside] = first[inside]
        low[inside] = byte[inside]
    starts = np.append(np.flatnonzero(cut[word]), np.count_nonzero(word))
    pieces = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(low[word])])
    return pieces, np.searchsorted(np.flatnonzero(cut), at[1:])


class WordIds:
    """Ids of whole texts, equal to the tokenizers library's. The vocabulary
    splits at white space and then into words, digits and runs of signs, and
    merges inside these only; so the ids of a text are those of its pieces in
    a row. Pieces of plain characters are merged by the vocabulary's ranks,
    all new ones of a block at once; others go through the library. Texts are
    cut by the classes of their bytes, and only a block's distinct pieces are
    looked up."""

    def __init__(self, path: str):
        self.path = path
        self.table = MergeTable(path)
        #: Remembered pieces, and the ids of each, little-endian 32-bit.
        self.known, self.ids = pa.array([], pa.large_binary()), pa.array([], pa.large_binary())

    @cached_property
    def tok(self):
        """The library's tokenizer, loaded when a text needs it."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        tok = Tokenizer.from_file(self.path)
        tok.no_truncation()
        tok.no_padding()
        return tok

    def _ids_of(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of new pieces."""
        lines = b"\n".join(pieces)
        if b"<|" not in lines and _PLAIN.issuperset(lines.decode().replace("\n", "")):
            return self.table.merge_many(pieces)
        whole = [k for k, p in enumerate(pieces) if b"<|" in p or not _PLAIN.issuperset(p.decode())]
        found = self.tok.encode_batch([pieces[k].decode() for k in whole], add_special_tokens=False)
        rest = pieces.copy()
        for k in whole:
            rest[k] = b""
        out = self.table.merge_many(rest)
        for k, e in zip(whole, found, strict=True):
            out[k] = np.array(e.ids, "<u4").tobytes()
        return out

    def _places(self, pieces: pa.Array) -> np.ndarray:
        """Where distinct pieces stand among the remembered ones, new ones added."""
        found = pc.index_in(pieces, value_set=self.known)
        place, lacks = found.fill_null(0).to_numpy().copy(), found.is_null().to_numpy(zero_copy_only=False)
        if lacks.any():
            if self.known.nbytes + self.ids.nbytes > CACHE_BYTES:  # all but this block's are forgotten
                kept = pa.array(place[~lacks])
                self.known, self.ids = self.known.take(kept), self.ids.take(kept)
                place[~lacks] = np.arange(len(kept))
            new = pieces.filter(pa.array(lacks))
            place[lacks] = len(self.known) + np.arange(len(new))
            ids = pa.array(self._ids_of(new.to_pylist()), pa.large_binary())
            self.known, self.ids = pa.concat_arrays([self.known, new]), pa.concat_arrays([self.ids, ids])
        return place

    def __call__(self, texts: pa.Array | list[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text (null as empty)."""
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        texts.validate(full=True)
        for block in _blocks(texts):
            pieces, ends = pieces_of(block.fill_null("") if block.null_count else block)
            coded = pieces.dictionary_encode()
            place = self._places(coded.dictionary)
            at, ids = in_a_row(self.ids, place[coded.indices.to_numpy()])
            ids, ends = np.frombuffer(ids, "<u4", at[-1] // 4), (at[ends] // 4).tolist()
            for a, b in pairwise([0, *ends]):
                yield ids[a:b]


class HarmonicPacker:
    """Packs a stream of (doc, ids); yields (doc, start, ids, doc_tokens,
    sequence, offset) with sequences numbered from ``first``."""

    def __init__(self, first: int = 0, capacity: int = CAPACITY, classes: int = CLASSES):
        self.capacity, self.classes, self.next = capacity, classes, first
        self.open: dict[int, list] = {}
        self.filler: list = []  # pieces to cut top-ups from
        self.waiting: tuple[list, int] | None = None  # a bin with its k rests, and its gap

    def _emit(self, pieces: list) -> Iterator[tuple]:
        offset = 0
        for doc, start, ids, n in pieces:
            yield doc, start, ids, n, self.next, offset
            offset += len(ids)
        self.next += 1

    def _top_up(self) -> Iterator[tuple]:
        pieces, gap = self.waiting
        while gap and self.filler:
            doc, start, ids, n = self.filler.pop()
            pieces.append((doc, start, ids[:gap], n))
            if len(ids) > gap:
                self.filler.append((doc, start + gap, ids[gap:], n))
            gap -= min(gap, len(ids))
        self.waiting = (pieces, gap)
        if not gap:
            self.waiting = None
            yield from self._emit(pieces)

    def add(self, doc, ids: np.ndarray) -> Iterator[tuple]:
        n, at = len(ids), 0
        while n - at >= self.capacity:
            yield from self._emit([(doc, at, ids[at:at + self.capacity], n)])
            at += self.capacity
        if at == n:
            return
        rest = (doc, at, ids[at:], n)
        if self.waiting:
            self.filler.append(rest)
            yield from self._top_up()
            return
        k = min(self.capacity // (n - at), self.classes)
        bin_ = self.open.setdefault(k, [])
        bin_.append(rest)
        if len(bin_) == k:
            del self.open[k]
            self.waiting = (bin_, self.capacity - sum(len(p[2]) for p in bin_))
            yield from self._top_up()

    def finish(self) -> Iterator[tuple]:
        left = [*(self.waiting[0] if self.waiting else []), *self.filler, *(p for b in self.open.values() for p in b)]
        self.open, self.filler, self.waiting = {}, [], None
        total = sum(len(p[2]) for p in left)
        left.reverse()
        while total:
            size = self.capacity if total >= self.capacity else 1 << (total.bit_length() - 1)
            total -= size
            take = []
            while size:
                doc, start, ids, n = left.pop()
                take.append((doc, start, ids[:size], n))
                if len(ids) > size:
                    left.append((doc, start + size, ids[size:], n))
                size -= min(size, len(ids))
            yield from self._emit(take)


_IDS: dict[str, WordIds] = {}


def _pack_task(path: str, end_id: int, capacity: int, classes: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        if path not in _IDS:  # one per Python worker, reused by its later tasks
            _IDS[path] = WordIds(path)
        ids_of = _IDS[path]
        end = np.array([end_id], "<u4")
        packer = HarmonicPacker(TaskContext.get().partitionId() << 40, capacity, classes)
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

        def table(rows: list) -> pa.RecordBatch:
            cols = [[r[0] for r in rows], [r[1] for r in rows], [len(r[2]) for r in rows],
                    [zlib.crc32(np.ascontiguousarray(r[2])) for r in rows], *([r[i] for r in rows] for i in (3, 4, 5))]
            arrays = [pa.array(c, pa.int64()) for c in cols]
            if with_ids:
                arrays.append(pa.array([r[2].astype("i4") for r in rows], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(arrays, names + ["ids"] * with_ids)

        for batch in batches:
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), ids_of(batch.column(1)), strict=True):
                rows.extend(packer.add(doc, np.concatenate([ids, end])))
                if len(rows) >= 1000:
                    yield table(rows)
                    rows = []
            if rows:
                yield table(rows)
        if rows := list(packer.finish()):
            yield table(rows)
    return run


def pack(spark: SparkSession, docs: DataFrame, path: str | None = None, end_id: int = END_ID,
         capacity: int = CAPACITY, classes: int = CLASSES, with_ids: bool = False) -> DataFrame:
    """Pack ``docs(doc_id, text, ...)`` into sequences of at most ``capacity``
    tokens: one row per piece with doc_id, start (ids of its document before
    it), length, ids_crc32 (unsigned CRC-32 of its little-endian 32-bit ids),
    doc_tokens, sequence_id, offset, and with ``with_ids`` the ids themselves.

    A document's ids are those of its whole text by the tokenizers library
    (null as empty), then ``end_id``. Empty texts give a piece of one id.
    Repeated rows and null ids are packed like any row. Other columns are
    ignored; an empty table gives an empty result. Sequence ids are unique:
    the task's number in the high bits, a count in the low 40.
    """
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("word_bpe_49k.json")
    ensure_importable(spark)
    schema = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
              "sequence_id bigint, offset bigint" + ", ids array<int>" * with_ids)
    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(
        _pack_task(str(path), end_id, capacity, classes, with_ids), schema)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over the whole ``documents`` table."""
    return pack(spark, read_table(spark, sf_dir, "documents"))
