"""N-gram Jaccard join by a MinHash LSH forest (operator 3).

Every text is the set of its 5-word shingles; texts with equal sets are one
*node* from the start. A node's signature is TREES x DEPTH MinHash values:
its path in each of TREES prefix tries. Nodes that share a path down to some
depth meet in a bucket of that tree, and meet sooner or later if they are
alike: two sets of similarity s share a path of length k in one of the trees
with probability 1 - (1 - s^k)^TREES.

The join starts with paths of full length and shortens them by one level at a
time. After each round it estimates its recall from the links found so far: a
link of similarity s stands for 1 / P(s) links that exist. It stops as soon as
the estimate reaches TARGET. A round looks at new pairs only, those that share
no longer path, and every pair is looked at in the first tree where it meets,
so no pair is counted twice and none is emitted.

All candidates are verified exactly on their shingle sets. A bucket of more
than BLOCK nodes (or BLOCK_SHINGLES shingles) is dealt into blocks by a hash,
and each pair of blocks is compared in one task. Texts are sent only where a
node has a new pair. What a task returns is each node's number of links and
the root of its group, once per node. Classes are the connected components.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexnet.llm.common import components, discard, id_filter, materialize, maybe_in, read_table
from plexnet.shipping import ensure_importable

WORDS, THRESHOLD, TARGET = 5, 0.8, 0.9999
TREES, DEPTH = 24, 6
#: Nodes and shingles of a block; larger buckets are split.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 20
#: Rows of a block that are verified at once.
ROWS_AT_ONCE = 256
#: Similarities of links are counted in so many steps from the threshold to 1.
STEPS = 200


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingles(text: str | bytes | None, hashes: _Hashes, words: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles. A text of fewer words is
    one shingle of all its words; null or blank text has none."""
    found = (text.encode() if isinstance(text, str) else text or b"").split()  # bytes split at ASCII white space only
    n = len(found)
    a = np.fromiter(map(hashes.__getitem__, found), np.uint64, n)
    if not n:
        return a
    size = min(n, words)
    h = np.full(n - size + 1, size, np.uint64)
    for i in range(size):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + a[i:n - size + 1 + i])
    return np.unique(h)


_FACTORS = np.random.default_rng(2024).integers(1 << 62, 1 << 63, TREES * DEPTH, np.uint64) * np.uint64(2) + np.uint64(1)


def signature(s: np.ndarray) -> np.ndarray:
    """MinHash fingerprints (16 bits) of a non-empty set: TREES paths of DEPTH values."""
    least = np.full(TREES * DEPTH, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(s), 2048):
        np.minimum(least, (s[at:at + 2048, None] * _FACTORS).min(0), out=least)
    return (_mix(least) >> np.uint64(48)).astype(np.uint16).reshape(TREES, DEPTH)


def paths(signatures: np.ndarray, depth: int) -> np.ndarray:
    """A 64-bit key of each node's path of length ``depth`` in each tree."""
    h = np.broadcast_to(np.arange(1, TREES + 1, dtype=np.uint64), signatures.shape[:2])
    for d in range(depth):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + signatures[:, :, d])
    return h


def meets(similarity: np.ndarray, depth: int) -> np.ndarray:
    """Probability that two sets share a path of ``depth`` in one of the trees."""
    return 1 - (1 - np.asarray(similarity, float) ** depth) ** TREES


def estimated_recall(counts: dict[int, int], depth: int, threshold: float = THRESHOLD) -> float:
    """Share of the links found, by the links' similarities (``counts`` by step)."""
    if not counts:
        return 1.0
    s = threshold + (1 - threshold) * np.minimum(1, (np.array(list(counts)) + 0.5) / STEPS)
    n = np.array(list(counts.values()), float)
    return float(n.sum() / (n / meets(s, depth)).sum())


def marks(shorter: np.ndarray, longer: np.ndarray | None, tree: int) -> np.ndarray:
    """What tells the new pairs of a bucket of tree ``tree``: the paths of a node
    in the earlier trees, and its ``longer`` ones in this and the later trees."""
    return shorter[..., :tree] if longer is None else np.concatenate([shorter[..., :tree], longer[..., tree:]], -1)


def unlike(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The pairs of nodes that have no mark in common."""
    new = np.ones((len(left), len(right)), bool)
    for k in range(left.shape[1]):
        new &= left[:, k, None] != right[None, :, k]
    return new


def new_pairs(left: np.ndarray, right: np.ndarray, tree: int, depth: int) -> np.ndarray:
    """For signatures that share tree ``tree``'s path: the pairs that no earlier
    tree and no longer path has brought together."""
    return unlike(*(marks(paths(x, depth), paths(x, depth + 1) if depth < DEPTH else None, tree) for x in (left, right)))


def _label_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest, size and signature of every text's set; a set that the task has
    met before comes without its signature."""
    import xxhash
    hashes, met = _Hashes(), set()
    for b in batches:
        for at in range(0, len(b), 2000):
            part = b.slice(at, 2000)
            digests, sizes, found = [], [], []
            for t in part.column(2).cast(pa.binary()):
                s = shingles(t.as_py(), hashes)
                digest = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None
                digests.append(digest)
                sizes.append(len(s))
                found.append(None if digest is None or digest in met else signature(s).tobytes())
                met.add(digest)
            if len(met) > 500_000:
                met.clear()
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(found, pa.binary())],
                                             ["row", "doc_id", "set", "size", "sig"])


def _signatures(column: pa.Array | list[bytes]) -> np.ndarray:
    raw = column.to_pylist() if isinstance(column, pa.Array) else column
    return np.frombuffer(b"".join(raw), np.uint16).reshape(-1, TREES, DEPTH)


def _count_task(depth: int):
    """(key, size) of every node's path in each tree."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = paths(_signatures(b.column(1)), depth)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), b.column(0).take(pa.array(np.repeat(np.arange(len(b)), TREES)))], ["key", "size"])
    return run


def _members_task(depth: int, shared):
    """The nodes' paths that the filter of crowded buckets lets pass, with their marks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sigs = _signatures(b.column(1))
            shorter, longer = paths(sigs, depth), paths(sigs, depth + 1) if depth < DEPTH else None
            keys = shorter.ravel().view(np.int64)
            at = np.flatnonzero(maybe_in(shared.value, keys))
            told = [marks(shorter[r], None if longer is None else longer[r], t).tobytes() for r, t in zip((at // TREES).tolist(), (at % TREES).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(keys[at]), pa.array((at % TREES).astype(np.int32)), b.column(0).take(pa.array(at // TREES)), pa.array(told, pa.binary())],
                                             ["key", "tree", "node", "marks"])
    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with the same (tree, key, i, j); rows come sorted by these and ``side``."""
    key, held = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[:4] != key:
                if len(held) > 1:
                    yield key, held
                key, held = row[:4], []
            held.append(row[4:])
    if len(held) > 1:
        yield key, held


def _sides(held: list[tuple]) -> int | None:
    """Number of rows of the left block; None where a block meets itself."""
    n = sum(h[0] == 0 for h in held)
    return n if n < len(held) else None


def _pairs_of(held: list[tuple], cut: int | None) -> np.ndarray:
    told = np.frombuffer(b"".join(h[2] for h in held), np.uint64).reshape(len(held), -1)
    if cut is None:
        return np.triu(unlike(told, told), 1)
    return unlike(told[:cut], told[cut:])


def _active_task():
    """The rows of a bucket that have a new pair there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [()] * 7
            out.clear()
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["tree", "key", "i", "j", "side", "node", "marks"])
        for key, held in _groups(batches):
            cut = _sides(held)
            if cut == 0:
                continue
            new = _pairs_of(held, cut)
            on = new.any(1) | new.any(0) if cut is None else np.concatenate([new.any(1), new.any(0)])
            out.extend((*key, *held[k][:3]) for k in np.flatnonzero(on).tolist())
            if len(out) > 50_000:
                yield batch()
        yield batch()
    return run


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all ``left`` with all ``right`` sets."""
    if len(left) == len(right) == 1:
        return np.array([[len(np.intersect1d(left[0], right[0], assume_unique=True))]])
    a, b = np.concatenate(left), np.concatenate(right)
    ra, rb = (np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right))
    both = np.intersect1d(a, b)
    out = np.zeros((len(left), len(right)), np.float32)
    if not len(both):
        return out

    def columns(x: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(both, x), len(both) - 1)
        keep = both[at] == x
        order = np.argsort(at[keep], kind="stable")
        return at[keep][order], r[keep][order]
    (ca, ra), (cb, rb) = columns(a, ra), columns(b, rb)
    for lo in range(0, len(both), 2048):
        part = []
        for c, r, n in ((ca, ra, len(left)), (cb, rb, len(right))):
            x, y = np.searchsorted(c, [lo, lo + 2048])
            m = np.zeros((n, min(2048, len(both) - lo)), np.float32)
            m[r[x:y], c[x:y] - lo] = 1
            part.append(m)
        out += part[0] @ part[1].T  # whole numbers below 2^24, exact
    return out


class _Found:
    """What a task has found: links per node, groups, similarities of the links."""

    def __init__(self):
        self.links: dict[int, int] = {}
        self.parent: dict[int, int] = {}
        self.steps: dict[int, int] = {}

    def root(self, x: int) -> int:
        p = self.parent
        while p.setdefault(x, x) != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def add(self, left: list[int], right: list[int], near: np.ndarray, sims: np.ndarray, threshold: float) -> None:
        """``near`` marks the links, each once: rows are the left nodes, columns the right ones."""
        for side, counts in ((left, near.sum(1)), (right, near.sum(0))):
            for k in np.flatnonzero(counts).tolist():
                self.links[side[k]] = self.links.get(side[k], 0) + int(counts[k])
        for k in np.flatnonzero(near.any(1)).tolist():
            others = np.flatnonzero(near[k]).tolist()
            roots = {self.root(left[k]), *(self.root(right[y]) for y in others)}
            low = min(roots)
            self.parent.update(dict.fromkeys(roots, low))
        step = np.minimum(STEPS - 1, ((sims[near] - threshold) / (1 - threshold) * STEPS).astype(int))
        for k, n in zip(*np.unique(step, return_counts=True), strict=True):
            self.steps[int(k)] = self.steps.get(int(k), 0) + int(n)

    def batch(self) -> pa.RecordBatch:
        nodes, steps = list(self.links), list(self.steps)
        none = [None] * len(steps)
        out = pa.RecordBatch.from_arrays(
            [pa.array(nodes + none, pa.int64()), pa.array([self.root(x) for x in nodes] + none, pa.int64()),
             pa.array([*self.links.values(), *self.steps.values()], pa.int64()), pa.array([None] * len(nodes) + steps, pa.int32())], ["node", "root", "n", "step"])
        self.__init__()
        return out


def _verify_task(threshold: float):
    """Exact similarities of the new pairs of each bucket (or pair of its blocks)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, found = _Hashes(), _Found()
        for key, held in _groups(batches):
            cut = _sides(held)
            if cut == 0:
                continue
            new = _pairs_of(held, cut)
            sets = [shingles(zlib.decompress(h[3]), hashes) for h in held]
            left, right = (sets, sets) if cut is None else (sets[:cut], sets[cut:])
            nodes, sizes = [h[1] for h in held], np.array([len(x) for x in right], np.float64)
            for lo in range(0, len(left), ROWS_AT_ONCE):  # of the left block, against the whole right one
                rows = new[lo:lo + ROWS_AT_ONCE]
                if not rows.any():
                    continue
                part = left[lo:lo + ROWS_AT_ONCE]
                both = overlaps(part, right).astype(np.float64)
                sims = both / (np.array([len(x) for x in part], np.float64)[:, None] + sizes - both)
                near = rows & (sims >= threshold)
                if near.any():
                    found.add(nodes[lo:lo + len(part)], nodes[cut or 0:], near, sims, threshold)
            if len(found.parent) > 1_000_000:
                yield found.batch()
        yield found.batch()
    return run


def _texts_task(shared):
    """Texts of the rows that the filter lets pass, packed (they are shuffled
    twice, the second time once a bucket)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                b = b.filter(pa.array(maybe_in(shared.value, b.column(0).to_numpy())))
                packed = [zlib.compress(t.as_buffer()) if t.is_valid else None for t in b.column(1).cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed, pa.binary())], ["row", "packed"])
    return run


def _round(spark: SparkSession, rows: DataFrame, nodes: DataFrame, depth: int, threshold: float) -> DataFrame | None:
    """Links of the new pairs of one depth: (node, root, n) and (n, step); None
    where no two nodes meet."""
    keys = nodes.select("size", "sig").mapInArrow(_count_task(depth), "key bigint, size bigint")
    parts = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_SHINGLES)).cast("int")
    crowded = materialize(spark, keys.groupBy("key").agg(F.count("*").alias("n"), parts.alias("parts")).where("n > 1").select("key", "parts"), "buckets")
    if crowded.isEmpty():
        return None
    shared = spark.sparkContext.broadcast(id_filter(crowded.select("key")))
    members = nodes.select("node", "sig").mapInArrow(_members_task(depth, shared), "key bigint, tree int, node bigint, marks binary")
    large = crowded.where("parts > 1")  # the other buckets are one block each
    dealt = members.join(large, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    dealt = dealt.select("tree", "key", "node", "marks", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("with"))
    dealt = dealt.select("tree", "key", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), (F.col("own") > F.col("with")).cast("int").alias("side"), "node", "marks")
    bucket = ["tree", "key", "i", "j"]

    def together(rows_: DataFrame) -> DataFrame:
        return rows_.repartition(*bucket).sortWithinPartitions(*bucket, "side", "node")
    active = materialize(spark, together(dealt).mapInArrow(
        _active_task(), "tree int, key bigint, i int, j int, side int, node bigint, marks binary"), "active")
    wanted = spark.sparkContext.broadcast(id_filter(active.select("node")))
    texts = rows.select("row", "text").mapInArrow(_texts_task(wanted), "row bigint, packed binary").withColumnRenamed("row", "node")
    both = active.join(texts, "node").select(*bucket, "side", "node", "marks", "packed")
    links = materialize(spark, together(both).mapInArrow(
        _verify_task(threshold), "node bigint, root bigint, n bigint, step int"), "links")
    discard(crowded, active)
    return links


def link(spark: SparkSession, docs: DataFrame, threshold: float = THRESHOLD, target: float = TARGET) -> tuple[DataFrame, float]:
    """(members, recall) of ``docs(doc_id, text, ...)``.

    ``members``: one row per input row with row (place in the scan), doc_id,
    node (smallest row with the same shingle set; null without words), comp
    (smallest node of the class) and n_links (nodes found with similarity
    ``threshold`` or more to it, all verified). ``recall`` is the estimated
    share of such links that were found; ``target`` is reached unless even
    paths of one level do not reach it.
    """
    ensure_importable(spark)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    labels = materialize(spark, rows.mapInArrow(_label_task, "row bigint, doc_id bigint, set binary, size bigint, sig binary"), "labels")
    nodes = materialize(spark, labels.where("set IS NOT NULL").groupBy("set").agg(
        F.min("row").alias("node"), F.first("size").alias("size"), F.first("sig", ignorenulls=True).alias("sig")), "nodes")
    members = materialize(spark, labels.select("row", "doc_id", "set").join(nodes.select("set", "node"), "set", "left").select("row", "doc_id", "node"), "rows")
    discard(labels)
    found, recall = None, 1.0
    for depth in range(DEPTH, 0, -1):
        links = _round(spark, rows, nodes, depth, threshold)
        if links is not None:
            found = links if found is None else found.unionAll(links)
            recall = estimated_recall({r.step: r.n for r in found.where("step IS NOT NULL").groupBy("step").agg(F.sum("n").alias("n")).collect()}, depth, threshold)
        if recall >= target:
            break
    discard(nodes)
    if found is None:
        return materialize(spark, members.select("*", F.col("node").alias("comp"), F.lit(0).cast("bigint").alias("n_links")), "members"), recall
    linked = found.where("node IS NOT NULL")
    degree = linked.groupBy("node").agg(F.sum("n").alias("n_links"))
    groups = components(spark, linked.select(F.col("node").alias("a"), F.col("root").alias("b")))
    members = members.join(groups.join(degree, "node"), "node", "left").select(
        "row", "doc_id", "node", F.coalesce("comp", "node").alias("comp"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
    return materialize(spark, members, "members"), recall


def classes(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: row, doc_id, class_id (smallest doc_id of
    its class), n_links (other shingle sets of similarity THRESHOLD or more),
    class_size (rows), kept (the class's smallest doc_id, of repeated rows one).

    Null and blank texts are classes of their own. Null ids lose to any other
    id; of equal ids the first row of the scan stays. Copies share their links.
    Texts of any length are read whole. Other columns are ignored; an empty
    table gives an empty result.
    """
    members, _ = link(spark, docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    heads = materialize(spark, members.where("comp IS NOT NULL").groupBy("comp").agg(
        first.alias("h"), F.count("*").alias("class_size")), "heads")
    out = members.join(heads, "comp", "left")
    alone = F.col("comp").isNull()
    return out.select("row", "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("h.doc_id")).alias("class_id"),
                      "n_links",
                      F.coalesce("class_size", F.lit(1)).cast("bigint").alias("class_size"),
                      (alone | (F.col("row") == F.col("h.row"))).alias("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class, all columns as they were."""
    key = "_row_of_scan"
    while key in docs.columns:
        key += "_"
    gone = classes(spark, docs).where("NOT kept").select(F.col("row").alias(key))
    return docs.withColumn(key, F.monotonically_increasing_id()).join(gone, key, "left_anti").select(*docs.columns)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over the whole ``documents`` table."""
    return classes(spark, read_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "class_size", "kept")
