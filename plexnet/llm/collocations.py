"""Phrase collocation mining by stripes (operator 13).

One structure answers everything: a *stripe* per prefix, an associative
counter of the words that follow it. Tasks build stripes of their own texts,
stripes of a prefix are merged elementwise, and then

* the entries of a stripe are the prefix's extensions (longer phrases),
* its total, the end of a piece counted as a word, is the prefix's own count,
* its largest entry decides whether the prefix is subsumed.

Prefixes of one word come first. A phrase of three words can reach the
minimum count only if both pairs in it do; so the pairs that reach it are put
into a Bloom filter of fixed size, and stripes of two-word prefixes are built
only where both pairs pass it. The filter errs on the side of counting, so
the result is exact at any size.

A stripe is dealt out in PARTS by a hash of the following word, so that a
prefix that holds a third of the corpus is merged by many tasks; a task sends
one row per prefix and part, however often it has met the prefix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexnet.llm.common import materialize, read_table
from plexnet.shipping import ensure_importable

LEAST, SUBSUMED, TOP = 10, 50, 2000
PARTS = 16
#: Words that a task holds before it sends its stripes, and distinct ones.
HELD_WORDS, HELD_VOCABULARY = 4_000_000, 2_000_000
#: Bits of the Bloom filter of frequent pairs (16 MB), and probes.
BLOOM_BITS, PROBES = 1 << 27, 2
_PIECE = 4 << 20  # bytes of a text that are split at once

_END = b"\xff"  # the end of a piece; never occurs in UTF-8
_FOLD = bytes(0xFF if chr(b) in ".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def words(raw: bytes) -> Iterator[list[bytes]]:
    """Words of a text (UTF-8), A-Z lower-cased, with ``_END`` after each
    piece. A long text comes in several lists, cut at the ends of pieces."""
    folded = raw.translate(_FOLD)
    at = 0
    while at < len(folded):
        to = folded.find(_END, at + _PIECE) if len(folded) - at > _PIECE else -1
        to = len(folded) if to < 0 else to + 1
        yield [*folded[at:to].replace(_END, b" \xff ").split(), _END]
        at = to


class _Ids(dict):
    """Numbers of words in the order of their first use; END is 0."""

    def __init__(self):
        super().__init__({_END: 0})

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def _hashes(vocabulary: list[bytes]) -> np.ndarray:
    import xxhash
    return np.fromiter(map(xxhash.xxh3_64_intdigest, vocabulary), np.uint64, len(vocabulary))


def _bits(lang: str, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Places of pairs of words (by hash) in the Bloom filter, a row per probe."""
    import xxhash
    h = _mix(left * np.uint64(3) + _mix(right + np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))))
    step = _mix(h) | np.uint64(1)
    return np.stack([(h + np.uint64(i) * step) % np.uint64(BLOOM_BITS) for i in range(PROBES)]).astype(np.int64)


class _Held:
    """The words of one language that a task holds."""

    def __init__(self):
        self.ids, self.runs, self.size = _Ids(), [], 0

    def add(self, found: list[bytes]) -> None:
        self.runs.append(np.fromiter(map(self.ids.__getitem__, found), np.int32, len(found)))
        self.size += len(found)

    def full(self) -> bool:
        return self.size >= HELD_WORDS or len(self.ids) >= HELD_VOCABULARY


def _first_stripes(lang: str, held: _Held, _: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Stripes of one-word prefixes."""
    a = np.concatenate([*held.runs, np.zeros(1, np.int32)]).astype(np.int64)
    vocabulary = list(held.ids)
    part = (_hashes(vocabulary) % np.uint64(PARTS)).astype(np.int64)
    at = np.flatnonzero(a[:-1])
    keys, n = np.unique(a[at] << 35 | part[a[at + 1]] << 31 | a[at + 1], return_counts=True)
    yield from _rows(lang, vocabulary, keys >> 35, None, (keys >> 31) & 15, keys & ((1 << 31) - 1), n)


def _second_stripes(lang: str, held: _Held, bloom: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Stripes of two-word prefixes, of phrases whose two pairs pass the filter."""
    a = np.concatenate([*held.runs, np.zeros(2, np.int32)]).astype(np.int64)
    vocabulary = list(held.ids)
    h = _hashes(vocabulary)
    pair = np.flatnonzero((a[:-1] > 0) & (a[1:] > 0))
    passes = np.zeros(len(a), bool)
    for lo in range(0, len(pair), 1 << 20):
        p = pair[lo:lo + (1 << 20)]
        ok = np.ones(len(p), bool)
        for bit in _bits(lang, h[a[p]], h[a[p + 1]]):
            ok &= (bloom[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
        passes[p] = ok
    at = np.flatnonzero(passes[:-1] & passes[1:])
    pairs, number = np.unique(a[at] << 31 | a[at + 1], return_inverse=True)
    part = (h % np.uint64(PARTS)).astype(np.int64)
    keys, n = np.unique(number.astype(np.int64) << 35 | part[a[at + 2]] << 31 | a[at + 2], return_counts=True)
    of = pairs[keys >> 35] if len(keys) else keys
    yield from _rows(lang, vocabulary, of >> 31, of & ((1 << 31) - 1), (keys >> 31) & 15, keys & ((1 << 31) - 1), n)


def _rows(lang: str, vocabulary: list[bytes], first: np.ndarray, second: np.ndarray | None, part: np.ndarray, following: np.ndarray,
          n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row per prefix and part; the entries of a stripe stand together."""
    vocabulary = [b"", *vocabulary[1:]]
    text = pa.array(vocabulary, pa.binary()).cast(pa.string())
    new = (first[1:] != first[:-1]) | (part[1:] != part[:-1])
    if second is not None:
        new |= second[1:] != second[:-1]
    starts = np.flatnonzero(np.append(True, new))[:len(first)]
    for lo in range(0, len(starts), 50_000):
        s = starts[lo:lo + 50_000]
        end = starts[lo + 50_000] if lo + 50_000 < len(starts) else len(first)
        offsets = pa.array(np.append(s - s[0], end - s[0]).astype(np.int32))
        cols = [pa.array([lang] * len(s), pa.string()), text.take(pa.array(first[s]))]
        cols.append(text.take(pa.array(second[s])) if second is not None else pa.nulls(len(s), pa.string()))
        cols += [pa.array(part[s].astype(np.int32)), pa.ListArray.from_arrays(offsets, text.take(pa.array(following[s[0]:end]))),
                 pa.ListArray.from_arrays(offsets, pa.array(n[s[0]:end].astype(np.int64)))]
        yield pa.RecordBatch.from_arrays(cols, ["lang", "first", "second", "part", "following", "counts"])


STRIPES = "lang string, first string, second string, part int, following array<string>, counts array<bigint>"


def _stripes_task(build, bloom: Broadcast | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = np.frombuffer(bloom.value, np.uint8) if bloom is not None else None
        held: dict[str, _Held] = {}
        for b in batches:
            for lang, raw in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
                own = held.setdefault(lang, _Held())
                for found in words(raw.as_py()):
                    own.add(found)
                    if own.full():
                        yield from build(lang, held.pop(lang), filter_)
                        own = held.setdefault(lang, _Held())
            if sum(h.size for h in held.values()) >= 2 * HELD_WORDS:  # many languages, few words of each
                for lang in list(held):
                    yield from build(lang, held.pop(lang), filter_)
        for lang, own in held.items():
            yield from build(lang, own, filter_)
    return run


def _bits_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lang, left, right = (b.column(c).to_pylist() for c in range(3))
        of = np.array(lang, object)
        for x in sorted(set(lang)):
            k = np.flatnonzero(of == x)
            yield pa.RecordBatch.from_arrays([pa.array(_bits(x, _hashes([left[i].encode() for i in k]), _hashes([right[i].encode() for i in k])).ravel())], ["bit"])


def merged(stripes: DataFrame, least: int) -> DataFrame:
    """Stripes of one part of a prefix merged elementwise: (lang, first, second,
    part, following, n), with the entries below ``least`` in one sum where
    ``following`` is null. Stripes are shuffled whole, once."""
    key = ["lang", "first", "second", "part"]
    entries = stripes.repartition(*key).select(*key, F.explode(F.arrays_zip("following", "counts")).alias("e")).select(
        *key, F.col("e.following").alias("following"), F.col("e.counts").alias("n"))
    entries = entries.groupBy(*key, "following").agg(F.sum("n").alias("n"))
    entries = entries.select(*key, F.when((F.col("n") >= least) & (F.col("following") != ""), F.col("following")).alias("following"), "n")
    return entries.groupBy(*key, "following").agg(F.sum("n").alias("n"))


def _bloom(pairs: DataFrame) -> bytes:
    """The filter of ``pairs(lang, first, following)``: BLOOM_BITS bits, whatever their number."""
    bits = pairs.select("lang", "first", "following").mapInArrow(_bits_task, "bit bigint")
    bitmaps = bits.groupBy(F.expr("bit div 32768").alias("bucket")).agg(F.expr("bitmap_construct_agg(bit % 32768)").alias("bits"))
    out = np.zeros(BLOOM_BITS // 8, np.uint8)
    for r in bitmaps.toLocalIterator():
        out[r.bucket * 4096:(r.bucket + 1) * 4096] = np.frombuffer(r.bits, np.uint8)
    return out.tobytes()


def count_phrases(spark: SparkSession, docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(totals, single, pairs, triples) of ``docs(text, lang, ...)``: words per
    lang, and counts of one, two and three words that reach ``least``."""
    ensure_importable(spark)
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    one = materialize(spark, merged(texts.mapInArrow(_stripes_task(_first_stripes, None), STRIPES), least), "stripes1")
    single = materialize(spark, one.groupBy("lang", "first").agg(F.sum("n").alias("n")), "word-counts")
    totals = single.groupBy("lang").agg(F.sum("n").alias("n"))
    pairs = materialize(spark, one.where("following IS NOT NULL").select("lang", "first", F.col("following").alias("second"), "n"), "pairs")
    shared = spark.sparkContext.broadcast(_bloom(pairs.withColumnRenamed("second", "following")))
    two = materialize(spark, merged(texts.mapInArrow(_stripes_task(_second_stripes, shared), STRIPES), least).where("following IS NOT NULL").select(
        "lang", "first", "second", F.col("following").alias("third"), "n"), "stripes2")
    return totals, single.where(F.col("n") >= least), pairs, two


def _cut(a: str, left: str, right: str) -> str:
    """SQL for floor(1000000 a a / (l r)), in integers of 38 digits."""
    d = "CAST({} AS DECIMAL(15,0))".format
    return f"(CAST(1000000 AS DECIMAL(7,0)) * ({d(a)} * {d(a)})) div ({d(left)} * {d(right)})"


def collocations(spark: SparkSession, docs: DataFrame, least: int = LEAST, subsumed: int = SUBSUMED, top: int = TOP) -> DataFrame:
    """Phrases of 2 to 3 words of ``docs(text, lang, ...)``, per language.

    Returns lang, rank, phrase, a (its count), l and r (counts of the two
    sides of its lowest-scoring cut, of equal scores the first cut), n (words
    of the language) and score, for each language's first ``top`` phrases by
    score and count descending, then phrase. Only phrases with a >= ``least``
    count; one goes if a longer one that contains it has ``subsumed`` per cent
    of its count or more.

    Null text counts as empty, null lang as ``und``; repeated rows count each
    time; texts of any length are read whole, in pieces of 4 MB; other columns
    are ignored; an empty table gives an empty result. Counts from 10^15 on raise.
    """
    totals, single, pairs, triples = count_phrases(spark, docs, least)
    inside = triples.select("lang", "first", "second", "n").unionAll(
        triples.select("lang", F.col("second").alias("first"), F.col("third").alias("second"), "n"))
    longest = inside.groupBy("lang", "first", "second").agg(F.max("n").alias("longest"))
    word = single.select("lang", F.col("first").alias("word"), F.col("n").alias("count"))

    def of(name: str, count: str) -> DataFrame:
        return word.select("lang", F.col("word").alias(name), F.col("count").alias(count))
    two = pairs.withColumnRenamed("n", "a").join(longest, ["lang", "first", "second"], "left").where(
        F.col("longest").isNull() | (100 * F.col("longest") < subsumed * F.col("a")))
    two = two.join(of("first", "l"), ["lang", "first"]).join(of("second", "r"), ["lang", "second"]).select(
        "lang", F.concat_ws(" ", "first", "second").alias("phrase"), "a", "l", "r", F.expr(_cut("a", "l", "r")).alias("score"))
    pair = pairs.withColumnRenamed("n", "count")
    three = triples.withColumnRenamed("n", "a").join(of("first", "l1"), ["lang", "first"]).join(of("third", "r2"), ["lang", "third"])
    three = three.join(pair.select("lang", F.col("first").alias("second"), F.col("second").alias("third"), F.col("count").alias("r1")), ["lang", "second", "third"])
    three = three.join(pair.select("lang", "first", "second", F.col("count").alias("l2")), ["lang", "first", "second"])
    three = three.withColumn("s1", F.expr(_cut("a", "l1", "r1"))).withColumn("s2", F.expr(_cut("a", "l2", "r2")))
    cut1 = F.col("s1") <= F.col("s2")
    three = three.select("lang", F.concat_ws(" ", "first", "second", "third").alias("phrase"), "a", F.when(cut1, F.col("l1")).otherwise(F.col("l2")).alias("l"),
                         F.when(cut1, F.col("r1")).otherwise(F.col("r2")).alias("r"), F.least("s1", "s2").alias("score"))
    best = F.row_number().over(_order())
    ranked = two.unionAll(three).withColumn("rank", best).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _order():
    from pyspark.sql import Window
    return Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over the whole ``documents`` table."""
    return collocations(spark, read_table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH piece AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
ws AS MATERIALIZED (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM piece),
spots AS MATERIALIZED (SELECT lang, unnest(w) AS x, unnest(list_append(w[2:], NULL)) AS y, unnest(list_append(list_append(w[3:], NULL), NULL)) AS z
                       FROM ws WHERE len(w) > 0),
one AS MATERIALIZED (SELECT lang, x, count(*)::HUGEINT AS f FROM spots WHERE x IS NOT NULL GROUP BY ALL),
two AS MATERIALIZED (SELECT lang, x, y, count(*)::HUGEINT AS f FROM spots WHERE y IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
three AS MATERIALIZED (SELECT lang, x, y, z, count(*)::HUGEINT AS f FROM spots WHERE z IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
longer AS (SELECT lang, x, y, max(f) AS f FROM (SELECT lang, x, y, f FROM three UNION ALL SELECT lang, y, z, f FROM three) GROUP BY ALL),
pair AS (SELECT t.lang, t.x || ' ' || t.y AS phrase, t.f AS a, p.f AS l, q.f AS r, 1000000 * t.f * t.f // (p.f * q.f) AS score
         FROM two t JOIN one p ON p.lang = t.lang AND p.x = t.x JOIN one q ON q.lang = t.lang AND q.x = t.y
         LEFT JOIN longer g ON g.lang = t.lang AND g.x = t.x AND g.y = t.y WHERE g.f IS NULL OR 100 * g.f < 50 * t.f),
cuts AS (SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z AS phrase, t.f AS a, p.f AS l1, q.f AS r1, u.f AS l2, v.f AS r2,
                1000000 * t.f * t.f // (p.f * q.f) AS s1, 1000000 * t.f * t.f // (u.f * v.f) AS s2
         FROM three t JOIN one p ON p.lang = t.lang AND p.x = t.x JOIN two q ON q.lang = t.lang AND q.x = t.y AND q.y = t.z
         JOIN two u ON u.lang = t.lang AND u.x = t.x AND u.y = t.y JOIN one v ON v.lang = t.lang AND v.x = t.z),
low AS (SELECT * FROM pair UNION ALL
        SELECT lang, phrase, a, if(s1 <= s2, l1, l2), if(s1 <= s2, r1, r2), least(s1, s2) FROM cuts),
n AS (SELECT lang, sum(f) AS n FROM one GROUP BY lang),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM low)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
