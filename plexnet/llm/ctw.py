"""Language-model scoring by context-tree weighting (operator 9).

A byte is eight binary decisions; each decision node has its own context tree
over the DEPTH bytes before it. Every context s holds the counts (n0, n1) of
its decisions and the Krichevsky-Trofimov block probability Pe(s), and is
weighted against its children, the contexts one byte longer:

    Pw(s) = 1/2 Pe(s) + 1/2 prod Pw(children),    Pw(leaf) = Pe(leaf)

The share w(s) = 1/2 Pe(s) / Pw(s) of stopping at s then gives, top-down, the
mixed estimate of a decision for every context: the KT estimates
(n1 + 1/2) / (n0 + n1 + 1) along the path from the root, weighted by w and the
shares not yet spent. A decision is judged by the longest known context, so
the eight decisions of a byte always make a proper distribution over bytes.

Spark counts the (DEPTH+1)-grams of all texts and deals them out by the last
SPLIT bytes of context. A task then holds whole subtrees: it computes all
depths from DEPTH to SPLIT at once and sends only the sums at their roots.
The levels above are at most 255 * 256 nodes each; they are computed on the
driver and broadcast, and a second pass over the grams goes down the subtrees
and writes the log probability of every gram that occurs. No tree is stored,
shipped or held whole; the table of grams grows with the input.

Texts are scored with the FREQUENT_GRAMS most common grams in a table that
every task holds; the others are joined by a shuffle.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plexnet.llm.common import crc_mod, discard, least_count, materialize, read_table
from plexnet.shipping import ensure_importable

DEPTH, SPLIT = 5, 2
#: Grams and tokens whose values every task holds (16 bytes a gram); the others
#: are joined by a shuffle.
FREQUENT_GRAMS, FREQUENT = 3_000_000, 200_000
#: Grams of whole subtrees that a task works on at once.
CHUNK = 500_000
#: Marks the end of a text and fills the context before its start; never occurs in UTF-8.
END = 0xFF
_PIECE = 4 << 20  # bytes that are counted or scored at once
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _parts(texts: list[bytes | None]) -> Iterator[list[tuple[int, bytes, bytes]]]:
    """Groups of (text number, DEPTH bytes of context, bytes) of about _PIECE
    bytes each; a longer text spans several parts. The last part of every text
    ends with END."""
    group, size = [], 0
    for i, t in enumerate(texts):
        raw = bytes([END]) * DEPTH + (t or b"").translate(_LOWER) + bytes([END])
        for at in range(DEPTH, len(raw), _PIECE):
            body = raw[at:at + _PIECE]
            group.append((i, raw[at - DEPTH:at], body))
            size += len(body)
            if size >= _PIECE:
                yield group
                group, size = [], 0
    if group:
        yield group


def _grams(group: list[tuple[int, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The (DEPTH+1)-gram that ends at each byte of the parts, as an integer
    (the oldest byte highest), and the number of them per part."""
    buf = np.frombuffer(b"".join(c + b for _, c, b in group), np.uint8)
    sizes = np.fromiter((len(b) for _, _, b in group), np.int64, len(group))
    g = buf[DEPTH:].astype(np.int64)
    for d in range(1, DEPTH + 1):
        g |= buf[DEPTH - d:len(buf) - d].astype(np.int64) << (8 * d)
    keep = np.ones(len(g), bool)  # without the grams that end in the context of a later part
    starts = np.cumsum(sizes[:-1] + DEPTH)
    for d in range(DEPTH):
        keep[starts - DEPTH + d] = False
    return g[keep], sizes


def _add_up(keys: np.ndarray, *sums: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of each column by key."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return (keys[first], *(np.add.reduceat(c[order], first) if len(keys) else c for c in sums))


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, n, m) of (text, learn): how often a gram occurs in the texts to
    learn from and in all texts."""
    held, size = [], 0
    for b in batches:
        learn = b.column(1).to_numpy(zero_copy_only=False)
        for group in _parts(b.column(0).cast(pa.binary()).to_pylist()):
            g, sizes = _grams(group)
            known = np.repeat(np.array([learn[i] for i, _, _ in group], np.int64), sizes)
            keys, m = np.unique(g << 1 | known, return_counts=True)
            held.append(_add_up(keys >> 1, np.where(keys & 1, m, 0), m))
            size += len(held[-1][0])
            if size > 3_000_000:
                held = [_add_up(*(np.concatenate(c) for c in zip(*held, strict=True)))]
                size = len(held[0][0])
    if held:
        g, n, m = _add_up(*(np.concatenate(c) for c in zip(*held, strict=True)))
        for i in range(0, len(g), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[i:i + 200_000].astype(np.int64)) for c in (g, n, m)], ["gram", "n", "m"])


def _ln_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma(x), x >= 1/2: Stirling's series at x + 8 (error below 1e-10)
    less the factors between."""
    z = x + 8
    lower = np.ones_like(x)
    for i in range(8):
        lower = lower * (x + i)
    return (z - 0.5) * np.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z ** 3) + 1 / (1260 * z ** 5) - np.log(lower)


def ln_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov block probability of n0 zeros and n1 ones."""
    return _ln_gamma(n0 + 0.5) + _ln_gamma(n1 + 0.5) - _ln_gamma(n0 + n1 + 1.0) - math.log(math.pi)


class _Level:
    """Nodes of one depth: keys = context << 8 | decision (1..255), in order."""

    def __init__(self, keys: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray | None):
        """``below``: ln of the product of the children's Pw; None for leaves."""
        self.keys, self.n0, self.n1 = keys, n0.astype(float), n1.astype(float)
        kt = ln_kt(self.n0, self.n1)
        self.pw = kt if below is None else np.logaddexp(kt, below) - math.log(2)
        self.stop = np.ones(len(keys)) if below is None else np.minimum(1, np.exp(kt - self.pw - math.log(2)))

    def mix(self, above: "_Level | None", depth: int) -> None:
        """Estimates of a one and of a zero (each, so that neither is lost to
        rounding), and what the path leaves to longer contexts."""
        one = zero = 0.0
        rest = 1.0
        if above is not None:
            at = np.searchsorted(above.keys, self.keys & ((1 << (8 * depth)) - 1))
            one, zero, rest = above.passed_one[at], above.passed_zero[at], above.rest[at]
        met = self.n0 + self.n1 + 1
        self.one, self.zero = one + rest * (self.n1 + 0.5) / met, zero + rest * (self.n0 + 0.5) / met
        self.passed_one, self.passed_zero = one + rest * self.stop * (self.n1 + 0.5) / met, zero + rest * self.stop * (self.n0 + 0.5) / met
        self.rest = rest * (1 - self.stop)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of ``keys`` and which of them are there."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys


def subtrees(grams: np.ndarray, n: np.ndarray) -> dict[int, _Level]:
    """Levels DEPTH to SPLIT of the tree of these grams, bottom-up."""
    grams, n = grams[n > 0], n[n > 0]
    byte, ctx = grams & 255, grams >> 8 << 8
    keys = np.concatenate([ctx | (1 << k) | (byte >> (8 - k)) for k in range(8)])
    bit = np.concatenate([(byte >> (7 - k)) & 1 for k in range(8)])
    count = np.tile(n, 8)
    keys, n0, n1 = _add_up(keys, count * (1 - bit), count * bit)
    levels = {DEPTH: _Level(keys, n0, n1, None)}
    for d in range(DEPTH - 1, SPLIT - 1, -1):
        up = levels[d + 1]
        levels[d] = _Level(*_add_up(up.keys & ((1 << (8 * (d + 1))) - 1), up.n0, up.n1, up.pw))
    return levels


def top_levels(roots: tuple[np.ndarray, ...]) -> dict[int, _Level]:
    """Levels SPLIT - 1 to 0, mixed, from the sums (key, n0, n1, below) at SPLIT - 1."""
    levels = {SPLIT - 1: _Level(*_add_up(*roots))}
    for d in range(SPLIT - 2, -1, -1):
        up = levels[d + 1]
        levels[d] = _Level(*_add_up(up.keys & ((1 << (8 * (d + 1))) - 1), up.n0, up.n1, up.pw))
    for d in range(SPLIT):
        levels[d].mix(levels.get(d - 1), d)
    return levels


def log_values(grams: np.ndarray, levels: dict[int, _Level]) -> np.ndarray:
    """log10 P(last byte | bytes before) of each gram, under mixed levels."""
    out = np.zeros(len(grams))
    byte = grams & 255
    for k in range(8):
        node, bit = (1 << k) | (byte >> (8 - k)), (byte >> (7 - k)) & 1
        p, todo = np.full(len(grams), 0.5), np.arange(len(grams))
        for d in range(DEPTH, -1, -1):
            at, hit = levels[d].find(((grams[todo] >> 8) & ((1 << (8 * d)) - 1)) << 8 | node[todo])
            at, found = at[hit], todo[hit]
            p[found] = np.where(bit[found] == 1, levels[d].one[at], levels[d].zero[at])
            todo = todo[~hit]
            if not len(todo):
                break
        out += np.log10(p)
    return out


def _subtree_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns of rows that come sorted by subtree, in chunks of whole subtrees."""
    held: list[tuple[np.ndarray, ...]] = []
    for b in batches:
        held.append(tuple(c.to_numpy() for c in b.columns))
        if sum(len(h[0]) for h in held) >= CHUNK:
            cols = tuple(np.concatenate(c) for c in zip(*held, strict=True))
            cut = int(np.searchsorted(cols[0], cols[0][-1]))  # the last subtree may go on
            if cut:
                yield tuple(c[:cut] for c in cols)
            held = [tuple(c[cut:] for c in cols)]
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held, strict=True))


def _roots_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, grams, n, _ in _subtree_chunks(batches):
        root = subtrees(grams, n)[SPLIT]
        keys, n0, n1, below = _add_up(root.keys & ((1 << (8 * SPLIT)) - 1), root.n0, root.n1, root.pw)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n0.astype(np.int64)), pa.array(n1.astype(np.int64)), pa.array(below)], ["key", "n0", "n1", "below"])


def _values_task(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = shared.value
        for _, grams, n, m in _subtree_chunks(batches):
            levels = top | subtrees(grams, n)
            for d in range(SPLIT, DEPTH + 1):
                levels[d].mix(levels[d - 1], d)
            yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(m), pa.array(log_values(grams, levels))], ["gram", "m", "value"])
    return run


def gram_values(spark: SparkSession, grams: DataFrame) -> DataFrame:
    """``(gram, m, value)``: log10 of the probability of the last byte of each
    gram of ``grams(gram, n, m)`` (one row per gram, read twice) after the
    bytes before, under the tree of the grams with counts n > 0."""
    ensure_importable(spark)
    subtree = F.col("gram").bitwiseAND((1 << (8 * (SPLIT + 1))) - 256)
    dealt = grams.select(subtree.alias("subtree"), "gram", "n", "m").repartition("subtree").sortWithinPartitions("subtree")
    roots = dealt.mapInArrow(_roots_task, "key bigint, n0 bigint, n1 bigint, below double").groupBy("key").agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("below").alias("below")).toArrow()
    top = top_levels(tuple(roots.column(c).to_numpy() for c in ("key", "n0", "n1", "below")))
    return dealt.mapInArrow(_values_task(spark.sparkContext.broadcast(top)), "gram bigint, m bigint, value double")


def learn_values(spark: SparkSession, docs: DataFrame, learn: Column) -> DataFrame:
    """Values of all grams of ``docs.text``, learnt from the rows of ``learn``; stored."""
    ensure_importable(spark)
    counts = docs.select("text", F.coalesce(learn, F.lit(False)).alias("learn")).mapInArrow(count_grams, "gram bigint, n bigint, m bigint")
    grams = materialize(spark, counts.groupBy("gram").agg(F.sum("n").alias("n"), F.sum("m").alias("m")), "grams")
    values = materialize(spark, gram_values(spark, grams), "gram-values")
    discard(grams)
    return values


def tokens(raw: bytes | None) -> list[bytes]:
    """Words with A-Z lower-cased, then one space for the end of the text (no
    word holds a space). Bytes split at ASCII white space only."""
    return [*(raw or b"").translate(_LOWER).split(), b" "]


def count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def rows() -> Iterator[pa.RecordBatch]:
        words, counts = list(held), list(held.values())
        for i in range(0, len(words), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(words[i:i + 100_000], pa.binary()).cast(pa.string()), pa.array(counts[i:i + 100_000], pa.int64())], ["w", "n"])
        held.clear()
    for b in batches:
        for t in b.column(0).cast(pa.binary()):
            held.update(tokens(t.as_py()))
            if len(held) > 500_000:
                yield from rows()
    yield from rows()


def _gram_scores(texts: list[bytes | None], keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per text the sum of the values of the grams in ``keys``, and (text,
    gram, count) of those that are not."""
    out, left = np.zeros(len(texts)), []
    for group in _parts(texts):
        g, sizes = _grams(group)
        uniq, inverse = np.unique(g, return_inverse=True)
        at = np.minimum(np.searchsorted(keys, uniq), max(0, len(keys) - 1))
        hit = keys[at] == uniq if len(keys) else np.zeros(len(uniq), bool)
        known = np.where(hit, values[at], 0.0) if len(keys) else np.zeros(len(uniq))
        of = np.array([i for i, _, _ in group])
        np.add.at(out, of, np.add.reduceat(known[inverse], np.cumsum(sizes) - sizes))
        rare = np.flatnonzero(~hit[inverse])
        if len(rare):
            left.append((np.repeat(of, sizes)[rare], g[rare]))
    text, gram = (np.concatenate([x[i] for x in left]) if left else np.zeros(0, np.int64) for i in (0, 1))
    order = np.lexsort((gram, text))
    text, gram = text[order], gram[order]
    first = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (gram[1:] != gram[:-1]))) if len(text) else np.zeros(0, np.int64)
    return out, text[first], gram[first], np.diff(np.append(first, len(text)))


ROWS_SCHEMA = "row bigint, w string, gram bigint, score double, base double, n bigint, n_known bigint, size bigint"


def _score_task(shared):
    """Per text one row (``size`` bytes) with the sums of its frequent grams and
    tokens, one per rare token, and one per rare gram with its count ``n``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values, table = shared.value
        for b in batches:
            for lo in range(0, len(b), 2000):
                ids, texts = b.column(0)[lo:lo + 2000].to_pylist(), b.column(1)[lo:lo + 2000].cast(pa.binary()).to_pylist()
                score, text, gram, count = _gram_scores(texts, keys, values)
                n = len(ids)
                base, sure, rare_of, rare = np.zeros(n), np.zeros(n, np.int64), [], []
                for i, t in enumerate(texts):
                    found = tokens(t)
                    known = [v for v in map(table.get, found) if v is not None]
                    base[i], sure[i] = math.fsum(known), len(known)
                    if len(known) < len(found):
                        new = [w for w in found if w not in table]
                        rare.extend(new)
                        rare_of.extend([ids[i]] * len(new))
                k, row_of = len(rare), np.array(ids)[text] if len(text) else text
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([ids, np.array(rare_of, np.int64), row_of]).astype(np.int64)),
                     pa.array([None] * n + rare + [None] * len(gram), pa.binary()).cast(pa.string()),
                     pa.concat_arrays([pa.nulls(n + k, pa.int64()), pa.array(gram.astype(np.int64))]),
                     pa.concat_arrays([pa.array(score), pa.nulls(k + len(gram), pa.float64())]), pa.concat_arrays([pa.array(base), pa.nulls(k + len(gram), pa.float64())]),
                     pa.concat_arrays([pa.array(sure), pa.nulls(k, pa.int64()), pa.array(count.astype(np.int64))]),
                     pa.concat_arrays([pa.array(sure), pa.nulls(k + len(gram), pa.int64())]),
                     pa.concat_arrays([pa.array([len(t or b"") for t in texts], pa.int64()), pa.nulls(k + len(gram), pa.int64())])],
                    ["row", "w", "gram", "score", "base", "n", "n_known", "size"])
    return run


def scores(spark: SparkSession, docs: DataFrame, learn: Column) -> DataFrame:
    """Tree scores and unigram scores of ``docs(row, text)``, both learnt from
    the rows of ``learn``: row, n_tokens, n_known, train_tokens, base_score,
    score (log10 probability of the whole text and its end, A-Z lower-cased)
    and bits_per_byte (its code length; the end counts as a byte). The unigram
    counts have 0.1 added to each.

    Null counts as empty; repeated rows and rows with a null ``learn`` are
    scored, the latter not learnt from; texts of any length are counted and
    scored whole, 4 MB at a time; other columns are ignored; an empty table
    gives an empty result. ``row`` must be unique.

    One pass over the texts looks up the most common grams and tokens in tables
    of bounded size; only the others are joined with their values by a shuffle,
    summed per text before, and none of them can be hot."""
    ensure_importable(spark)
    values = learn_values(spark, docs, learn)
    counts = materialize(spark, docs.where(learn).select("text").mapInArrow(count_tokens, "w string, n bigint").groupBy("w").agg(
        F.sum("n").alias("c")), "token-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    z = float(total) + 0.1 * (distinct + 1)
    least = least_count(counts, "c", FREQUENT)
    often = {r.w.encode(): math.log10((r.c + 0.1) / z) for r in counts.where(F.col("c") > least).toLocalIterator()}
    least_gram = least_count(values, "m", FREQUENT_GRAMS)
    top = values.where(F.col("m") > least_gram).select("gram", "value").toArrow()
    keys, logs = top.column("gram").to_numpy(), top.column("value").to_numpy()
    order = np.argsort(keys)
    shared = spark.sparkContext.broadcast((keys[order], logs[order], often))
    parts = materialize(spark, docs.select("row", "text").mapInArrow(_score_task(shared), ROWS_SCHEMA), "score-parts")
    cols = ["row", "score", "base", "n", "n_known", "size"]
    none, zero = F.lit(None).cast("bigint"), F.lit(0.0)
    whole = parts.where("size IS NOT NULL").select(cols)
    c = F.coalesce(F.col("c"), F.lit(0))
    rare = parts.where("w IS NOT NULL").select("row", "w").join(counts.where(F.col("c") <= least), "w", "left").select(
        "row", zero.alias("score"), F.log10((c + 0.1) / F.lit(z)).alias("base"), F.lit(1).cast("bigint").alias("n"), (c > 0).cast("bigint").alias("n_known"), none.alias("size"))
    grams = parts.where("gram IS NOT NULL").select("row", "gram", "n").join(values.where(F.col("m") <= least_gram), "gram").select(
        "row", (F.col("n") * F.col("value")).alias("score"), zero.alias("base"), F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("n_known"), none.alias("size"))
    return whole.unionAll(rare).unionAll(grams).groupBy("row").agg(
        F.sum("n").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.lit(int(total)).cast("bigint").alias("train_tokens"),
        F.sum("base").alias("base_score"), F.sum("score").alias("score"),
        (-F.sum("score") * math.log2(10) / (F.max("size") + 1)).alias("bits_per_byte"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over the whole ``documents`` table: the tree and the
    token counts come from rows whose crc32 remainder by 10 is not 0.

    Null and empty texts have one token, the end; repeated rows and null ids
    keep a row each; an empty table gives an empty result."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    held = crc_mod(F.col("doc_id"), 10) == 0
    return docs.select("row", "doc_id", held.alias("held_out")).join(scores(spark, docs, ~held), "row").select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
