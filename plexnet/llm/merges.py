"""Byte-pair merges of many pieces at once, by the merge ranks of a vocabulary
file in the tokenizers library's JSON form."""

from __future__ import annotations

import heapq
import json

import numpy as np
import pyarrow as pa

#: Fixed value: white space in such vocabularies' patterns, as the inside of a character class.
WHITE = r"\t-\r \x85\xa0  -     　"
_NONE = np.int32(2**31 - 1)
_FREE = np.int64(-(2**63))  # a place without a pair
_LONG = 64  # longer pieces are merged one by one
#: Stands between the ids of two chunks; no id below 2**24 has a byte pattern that forms it.
SEPARATOR = b"\xff\xff\xff\xff"


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in such vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in keep:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


def in_a_row(values: pa.Array, indices: pa.Array | np.ndarray) -> tuple[np.ndarray, memoryview]:
    """The places (one more than indices) and the bytes of ``values`` at
    ``indices``, all in a row; an index without a value raises KeyError."""
    taken = values.take(pa.array(indices))
    if taken.null_count:
        raise KeyError("an id outside the vocabulary")
    if not len(taken):
        return np.zeros(1, np.int64), memoryview(b"")
    _, at, raw = taken.buffers()
    return np.frombuffer(at, np.int64, len(taken) + 1), memoryview(raw or b"")


class MergeTable:
    """Vocabulary, special tokens and merge ranks. With an end-of-word suffix
    the last byte of a piece starts as the symbol that carries the suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        chars, ids = byte_chars(), j["model"]["vocab"]
        suffix = j["model"].get("end_of_word_suffix") or ""
        back = {c: b for b, c in enumerate(chars)}
        self.special = {t["content"]: t["id"] for t in j["added_tokens"]}
        self.bytes: dict[int, bytes] = {i: bytes(back[c] for c in t) for t, i in ids.items() if all(c in back for c in t)}
        self.bytes.update((i, t.encode()) for t, i in self.special.items())
        self.first = np.array([ids[c] for c in chars], np.int32)
        self.last = np.array([ids[c + suffix] for c in chars], np.int32)
        pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(j["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            pairs.setdefault((ids[a], ids[b]), (rank, ids[a + b]))
        #: (left id, right id) -> (rank, merged id)
        self.pairs = pairs
        self._merged = np.zeros(max((r for r, _ in pairs.values()), default=0) + 1, np.int32)
        for r, new in pairs.values():
            self._merged[r] = new
        keys = np.array([a << 32 | b for a, b in pairs], np.int64)
        # hashed places of the pairs, at most a quarter of them taken; a taken one passes on to the next
        self._shift = np.uint64(64 - max(4, (4 * len(keys)).bit_length()))
        self._keys = np.full((1 << (64 - int(self._shift))) + len(keys) + 1, _FREE)
        self._ranks = np.full(len(self._keys), _NONE)
        ranks = np.array([r for r, _ in pairs.values()], np.int32)
        at = self._place(keys)
        while len(keys):
            at += self._keys[at] != _FREE
            free = np.flatnonzero(self._keys[at] == _FREE)
            self._keys[at[free]] = keys[free]  # of several keys at a place one stays
            stays = self._keys[at] == keys
            self._ranks[at[stays]] = ranks[stays]
            keys, ranks, at = keys[~stays], ranks[~stays], at[~stays]

    def _place(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs (a, b); _NONE where a pair does not merge (-1
        stands for no neighbour and is in no pair)."""
        key = a.astype(np.int64) << 32 | b
        at = self._place(key)
        held = self._keys[at]
        out = np.where(held == key, self._ranks[at], _NONE)
        left = np.flatnonzero((held != key) & (held != _FREE))
        key, at = key[left], at[left]
        while len(left):
            at += 1
            held = self._keys[at]
            hit = held == key
            out[left[hit]] = self._ranks[at[hit]]
            on = ~hit & (held != _FREE)
            left, key, at = left[on], key[on], at[on]
        return out

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece: the adjacent pair of lowest rank merges first, of
        equal ranks the leftmost, until none merges. A heap of pairs over a
        linked list keeps the time near-linear."""
        n, get = len(piece), self.pairs.get
        cur = [int(self.first[b]) for b in piece]
        if n:
            cur[-1] = int(self.last[piece[-1]])
        prev, nxt = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(m[0], i, cur[i], cur[i + 1], m[1]) for i in range(n - 1) if (m := get((cur[i], cur[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = nxt[i]
            if cur[i] != a or j < 0 or cur[j] != b:
                continue  # one of the two has been merged since
            cur[i], cur[j], nxt[i] = new, -1, nxt[j]
            if nxt[i] >= 0:
                prev[nxt[i]] = i
                if m := get((new, cur[nxt[i]])):
                    heapq.heappush(heap, (m[0], i, new, cur[nxt[i]], m[1]))
            if prev[i] >= 0 and (m := get((cur[prev[i]], new))):
                heapq.heappush(heap, (m[0], prev[i], cur[prev[i]], new, m[1]))
        return [x for x in cur if x >= 0]

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """Ids (little-endian 32-bit) of each piece. Pieces of similar length
        are rows of a matrix; each step merges one pair in every row."""
        out: list[bytes] = [b""] * len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        low = 0
        for high in (6, 12, 24, _LONG):
            rows = np.flatnonzero((sizes > low) & (sizes <= high))
            for at in range(0, len(rows), 20_000):
                self._merge_rows(rows[at:at + 20_000], sizes, pieces, high, out)
            low = high
        for i in np.flatnonzero(sizes > _LONG).tolist():
            out[i] = np.array(self.merge(pieces[i]), "<u4").tobytes()
        return out

    def _merge_rows(self, rows: np.ndarray, sizes: np.ndarray, pieces: list[bytes], width: int, out: list[bytes]) -> None:
        raw = np.frombuffer(b"".join(pieces[i].ljust(width, b"\0") for i in rows.tolist()), np.uint8).reshape(len(rows), width)
        n = sizes[rows]
        line, wide = np.arange(len(rows)), width + 1
        table = np.full((len(rows), wide), -1, np.int32)  # the last column stays absent: what is before and after a row
        table[:, :-1] = np.where(np.arange(width) < n[:, None], self.first[raw], -1)
        table[line, n - 1] = self.last[raw[line, n - 1]]
        ids = table.ravel()
        ranks = np.full(ids.shape, _NONE)
        pairs = np.flatnonzero(ids[1:] >= 0)
        ranks[pairs] = self._rank(ids[pairs], ids[pairs + 1])
        # symbols form linked lists, so a merge moves nothing
        after, before = np.arange(1, len(ids) + 1), np.arange(-1, len(ids) - 1)
        by_row = ranks.reshape(table.shape)
        while len(line):
            near = by_row[line]
            j = near.argmin(1)
            best = near[np.arange(len(line)), j]
            go = best < _NONE
            if not go.all():
                line, j, best = line[go], j[go], best[go]
            i = line * wide + j
            gone = after[i]
            right, left, new = after[gone], before[i], self._merged[best]
            ids[i], ids[gone], ranks[gone] = new, -1, _NONE
            after[i], before[right] = right, i
            ranks[i] = self._rank(new, ids[right])
            ranks[left] = self._rank(ids[left], new)
        stay = table >= 0
        done, ends = ids[stay.ravel()].astype("<u4").tobytes(), np.cumsum(4 * stay.sum(1)).tolist()
        for i, a, b in zip(rows.tolist(), [0, *ends], ends, strict=False):
            out[i] = done[a:b]
