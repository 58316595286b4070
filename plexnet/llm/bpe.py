"""Byte-level BPE encoding and decoding (operator 4).

Frequent words of the corpus are compiled on the driver into a minimal acyclic
automaton: states with equal right languages are merged, so words share
suffixes as well as prefixes. Each transition carries the number of words
that sort before it at its state, so the sum along a path is the word's
number, and the word's ids stand in a table at that number (the id outputs of
the transducer). The arrays lie in one file that Spark ships to every
executor, and workers memory-map it. Words that the automaton does not accept
are merged exactly by the merge ranks of the vocabulary.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexnet.llm.common import count_words, discard, least_count, map_arrays, materialize, read_table, save_arrays
from plexnet.llm.merges import SEPARATOR, WHITE, MergeTable, in_a_row
from plexnet.shipping import ensure_importable

#: The lexicon holds the word pieces of this many most frequent words.
LEXICON_WORDS = 40_000
#: Chunks kept in a worker's cache before it starts anew (bounds its memory).
CACHE_CHUNKS = 300_000
#: Characters at which a block of texts ends (bounds its arrays).
BLOCK_CHARS = 4_000_000

#: Fixed value: how this family of vocabularies splits text into pieces.
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
#: The same for bytes that are all ASCII.
_PLAIN_PIECES = rb"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
#: A coarser split whose chunks contain whole pieces: a word with its space, or white space.
_CHUNKS = rf" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"


def compile_lexicon(words: dict[bytes, list[int]]) -> dict[str, np.ndarray]:
    """Minimal acyclic automaton of ``words`` (built from the sorted words,
    freezing each finished suffix into a register of known states), as flat
    arrays: sorted transition keys state*256+byte, their targets and word
    counts, final flags, and the id table by word number."""
    register: dict[tuple, int] = {}
    frozen: list[tuple] = []  # state -> (final, ((byte, target), ...))

    def freeze(final: bool, edges: dict[int, int]) -> int:
        key = (final, tuple(sorted(edges.items())))
        if key not in register:
            register[key] = len(frozen)
            frozen.append(key)
        return register[key]

    path: list[list] = [[False, {}]]  # the unfrozen states of the last word: [final, edges]
    last = b""
    for w in [*sorted(words), b""]:
        common = len(os.path.commonprefix([w, last]))
        for depth in range(len(last), common, -1):
            path[depth - 1][1][last[depth - 1]] = freeze(*path.pop())
        path.extend([False, {}] for _ in w[common:])
        if w:
            path[-1][0] = True
        last = w
    root = freeze(*path[0])
    below = [0] * len(frozen)  # words below a state; targets are frozen before their sources
    keys, targets, before = [], [], []
    for s, (final, edges) in enumerate(frozen):
        n = int(final)
        for byte, to in edges:
            keys.append(s * 256 + byte)
            targets.append(to)
            before.append(n)
            n += below[to]
        below[s] = n
    ids = [words[w] for w in sorted(words)]
    return {"keys": np.array(keys or [-1], np.int64), "targets": np.array(targets or [0], np.int32),
            "before": np.array(before or [0], np.int32), "final": np.array([f for f, _ in frozen], np.int8),
            "root": np.array([root], np.int32), "starts": np.cumsum([0, *map(len, ids)], dtype=np.int64),
            "ids": np.array([x for i in ids for x in i] or [0], np.uint32)}


class Lexicon:
    """A compiled lexicon, memory-mapped from its file."""

    def __init__(self, path: str):
        self.__dict__.update((k, np.asarray(a)) for k, a in map_arrays(path).items())
        starts, ids = (4 * self.starts).tolist(), self.ids.astype("<u4").tobytes()
        self.outputs = [ids[a:b] for a, b in pairwise(starts)]  # by word number

    def find(self, words: list[bytes]) -> list[bytes | None]:
        """Ids (little-endian 32-bit) of each word, None where it is not in the
        lexicon. All words walk the automaton together, one byte a step."""
        n = len(words)
        sizes = np.fromiter(map(len, words), np.int64, n)
        flat = np.frombuffer(b"".join(words), np.uint8)
        first = np.cumsum(sizes) - sizes
        state, number = np.full(n, self.root[0], np.int64), np.zeros(n, np.int64)
        alive = np.flatnonzero(sizes > 0)
        ok = np.zeros(n, bool)
        step = 0
        while len(alive):
            key = state[alive] * 256 + flat[first[alive] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            alive, at = alive[hit], at[hit]
            number[alive] += self.before[at]
            state[alive] = self.targets[at]
            step += 1
            done = sizes[alive] == step
            ends = alive[done]
            ok[ends] = self.final[state[ends]] == 1
            alive = alive[~done]
        outputs = self.outputs
        return [outputs[k] if y else None for k, y in zip(number.tolist(), ok.tolist(), strict=True)]


def _blocks(texts: list[str | None]) -> Iterator[list[str | None]]:
    """The texts in blocks of 500, or fewer once they have BLOCK_CHARS characters."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t or "")
        if len(held) == 500 or size >= BLOCK_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def _is_utf8(raw: bytes) -> bool:
    try:
        raw.decode()
    except UnicodeDecodeError:
        return False
    return True


class Encoder:
    """Encodes and decodes whole texts with a lexicon and a vocabulary. A
    block's texts are cut into chunks by the classes of their bytes; what is
    done per chunk in Python is done once per distinct chunk of a block."""

    def __init__(self, vocab_path: str, lexicon_path: str | None = None):
        import re

        import regex
        self.vocab = MergeTable(vocab_path)
        self.lexicon = Lexicon(lexicon_path) if lexicon_path else None
        self.chunks_of, self.pieces_of = re.compile(_CHUNKS).findall, regex.compile(PIECES).findall
        self.plain_pieces_of = re.compile(_PLAIN_PIECES).findall
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.vocab.special, key=len, reverse=True))) + ")").split
        self.marks = list(self.vocab.special)
        spaces = re.findall(f"[{WHITE}]", "".join(map(chr, range(0x3001))))
        self.odd_space = re.compile("[" + "".join(c for c in spaces if not c.isascii()) + "]").search
        self.blank = tuple(c.encode() for c in spaces)
        self.white = np.zeros(256, bool)
        self.white[[ord(c) for c in spaces if c.isascii()]] = True
        self.cache: dict[bytes, bytes] = {}  # chunk -> its ids, little-endian 32-bit
        self.pieces: dict[bytes, bytes] = {}  # the same for pieces
        ids = range(max(self.vocab.bytes) + 1)
        self.decimal = pa.array([b"%d," % i for i in ids], pa.large_binary())
        self.spelled = pa.array([self.vocab.bytes.get(i) for i in ids], pa.large_binary())

    def _learn(self, chunks: list[bytes]) -> None:
        plain, other, blank = [], [], []
        for c in chunks:
            if c.isascii():
                (blank if self.white[c[-1]] else plain).append(c)
            else:
                (blank if c.endswith(self.blank) else other).append(c)
        # all pieces in a row, a newline after each chunk's; a run of white space is one piece
        found = self.plain_pieces_of(b"\n".join([*plain, b""]))
        found.extend(p.encode() for p in self.pieces_of(b"\n".join([*other, b""]).decode()))
        new = set(found).difference(self.pieces, (b"\n",))
        if len(self.pieces) + len(new) > CACHE_CHUNKS:
            self.pieces.clear()
            new = set(found).difference((b"\n",))
        raw = [*new, *blank]
        out = self.lexicon.find(raw) if self.lexicon else [None] * len(raw)
        unseen = [k for k, x in enumerate(out) if x is None]
        for k, x in zip(unseen, self.vocab.merge_many([raw[k] for k in unseen]), strict=True):
            out[k] = x
        self.pieces.update(zip(raw[:len(new)], out, strict=False))
        self.pieces[b"\n"] = SEPARATOR
        self.cache.update(zip(blank, out[len(new):], strict=True))
        self.cache.update(zip([*plain, *other], b"".join(map(self.pieces.__getitem__, found)).split(SEPARATOR), strict=False))

    def _odd_chunks(self, text: str) -> list[str]:
        """Chunks of a text, special tokens that it spells out among them."""
        return [c for i, part in enumerate(self.split(text)) for c in ([part] if i % 2 else self.chunks_of(part))]

    def _chunks(self, texts: list[str | None]) -> tuple[pa.Array, np.ndarray]:
        """The chunks of all texts in a row, and their number up to the end of each text."""
        parts: list[bytes] = []
        units: list[int] = []  # parts up to the end of each text
        whole: list[int] = []  # parts that are one chunk
        for t in texts:
            t = t or ""
            if any(m in t for m in self.marks) or not t.isascii() and self.odd_space(t):
                odd = self._odd_chunks(t)
                whole.extend(range(len(parts), len(parts) + len(odd)))
                parts.extend(c.encode() for c in odd)
            else:
                parts.append(t.encode())
            units.append(len(parts))
        raw = b"".join(parts)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        ends = np.cumsum(sizes)
        byte = np.frombuffer(raw, np.uint8)
        white = self.white[byte]
        cut = white.copy()  # the last of a run, which stands before a word
        cut[:-1] &= ~white[1:]
        cut[ends[sizes > 0] - 1] = False
        # a run begins, or a word that no space stands before
        cut[1:] |= (white[1:] != white[:-1]) & (white[1:] | (byte[:-1] != 32))
        if whole:
            one = np.zeros(len(parts), bool)
            one[whole] = True
            cut[np.repeat(one, sizes)] = False
        cut[(ends - sizes)[sizes > 0]] = True
        first = np.flatnonzero(cut)
        chunks = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(np.append(first, len(raw))), pa.py_buffer(raw)])
        return chunks, np.searchsorted(first, np.append(0, ends)[units])

    def _encoded(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, list[int]]]:
        """Per block of texts: the ids of all of them in a row, and their number up to the end of each text."""
        for block in _blocks(texts):
            chunks, ends = self._chunks(block)
            coded = chunks.dictionary_encode()
            need = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
            found = list(map(self.cache.get, need))
            new = [c for c, x in zip(need, found, strict=True) if x is None]
            if len(self.cache) + len(new) > CACHE_CHUNKS:
                self.cache.clear()
                new = need
            if new:
                self.cache.update((m.encode(), np.array([i], "<u4").tobytes()) for m, i in self.vocab.special.items())
                self._learn([c for c in new if c not in self.cache])
                found = [x or self.cache[c] for c, x in zip(need, found, strict=True)]
            at, ids = in_a_row(pa.array(found, pa.large_binary()), coded.indices)
            yield np.frombuffer(ids, "<u4", at[-1] // 4), (at[ends] // 4).tolist()

    def _write(self, ids: np.ndarray) -> tuple[tuple[np.ndarray, memoryview], tuple[np.ndarray, memoryview]]:
        """A block's ids in decimal, a comma after each, and decoded; with the place of each."""
        return in_a_row(self.decimal, ids), in_a_row(self.spelled, ids)

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text, as the tokenizers library gives them without
        added special tokens (null as empty)."""
        for ids, ends in self._encoded(texts):
            for a, b in pairwise([0, *ends]):
                yield ids[a:b]

    def digests(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        """(number of ids, SHA-256 of the ids in decimal joined by commas,
        SHA-256 of the decoded ids) per text."""
        for ids, ends in self._encoded(texts):
            (at, written), (to, decoded) = self._write(ids)
            ends = [0, *ends]
            for (a, b), (i, j), (k, m) in zip(pairwise(ends), pairwise(at[ends].tolist()), pairwise(to[ends].tolist()), strict=True):
                raw = bytes(decoded[k:m])
                text = raw if _is_utf8(raw) else raw.decode("utf-8", "replace").encode()
                yield b - a, hashlib.sha256(written[i:max(i, j - 1)]).hexdigest(), hashlib.sha256(text).hexdigest()

    def decode(self, ids: list[int]) -> str:
        """The text of the ids, special tokens included; ids outside the
        vocabulary raise KeyError."""
        return b"".join(map(self.vocab.bytes.__getitem__, ids)).decode("utf-8", "replace")


def vocabulary_path() -> str:
    import public_tokenizers
    return str(public_tokenizers.path("byte_bpe_50k.json"))


def build_lexicon(spark: SparkSession, docs: DataFrame, vocab_path: str, words: int = LEXICON_WORDS) -> str:
    """Count all words of ``docs.text`` on the cluster, compile the pieces of
    the most frequent ones (``words`` at most; of a count that would pass that
    number, none), ship the file; returns its name."""
    ensure_importable(spark)
    counts = materialize(spark, docs.select("text").mapInArrow(count_words, "w string, n bigint").groupBy("w").agg(F.sum("n").alias("n")), "word-counts")
    top = [r.w for r in counts.where(F.col("n") > least_count(counts, "n", words)).select("w").toLocalIterator()]
    discard(counts)
    enc = Encoder(vocab_path)
    pieces = {p.encode() for w in top for form in (w, " " + w) for p in enc.pieces_of(form)}
    arrays = compile_lexicon({p: enc.vocab.merge(p) for p in pieces})
    name = f"lexicon-{uuid.uuid4().hex[:12]}.bin"
    path = os.path.join(tempfile.mkdtemp(prefix="plexnet-"), name)  # the driver's own copy, which Spark serves
    save_arrays(arrays, path)
    spark.sparkContext.addFile(path)
    return name


_ENCODERS: dict[tuple, Encoder] = {}


def _encoder(vocab_path: str, lexicon: str | None) -> Encoder:
    """One per Python worker, reused by its later tasks."""
    key = (vocab_path, lexicon)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(vocab_path, SparkFiles.get(lexicon) if lexicon else None)
    return _ENCODERS[key]


def encode(spark: SparkSession, docs: DataFrame, vocab_path: str | None = None, lexicon: str | None = None) -> DataFrame:
    """``(doc_id, ids array<int>)`` of every whole text of ``docs(doc_id,
    text, ...)``. Null text counts as empty and has no ids; repeated rows and
    null ids stay; other columns are ignored; an empty table gives an empty
    result."""
    vocab_path = vocab_path or vocabulary_path()
    lexicon = lexicon or build_lexicon(spark, docs, vocab_path)
    ensure_importable(spark)

    def run(batches):
        enc = _encoder(vocab_path, lexicon)
        for b in batches:
            ids = [x.astype("i4") for x in enc.encode(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])
    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(spark: SparkSession, encoded: DataFrame, vocab_path: str | None = None) -> DataFrame:
    """``(doc_id, text)`` of ``(doc_id, ids)``; null ids give an empty text."""
    vocab_path = vocab_path or vocabulary_path()
    ensure_importable(spark)

    def run(batches):
        enc = _encoder(vocab_path, None)
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([enc.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def round_trip(spark: SparkSession, docs: DataFrame, vocab_path: str | None = None) -> DataFrame:
    """Digests of encoding each text and of decoding its ids, in one pass:
    doc_id, n_tokens, ids_sha256 (ids in decimal, joined by commas),
    decoded_sha256. Cases as for :func:`encode`."""
    vocab_path = vocab_path or vocabulary_path()
    lexicon = build_lexicon(spark, docs, vocab_path)
    ensure_importable(spark)

    def run(batches):
        enc = _encoder(vocab_path, lexicon)
        for b in batches:
            n, a, d = zip(*enc.digests(b.column(1).to_pylist()), strict=True) if len(b) else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()),
                                              pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(
        run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over the whole ``documents`` table."""
    return round_trip(spark, read_table(spark, sf_dir, "documents"))
