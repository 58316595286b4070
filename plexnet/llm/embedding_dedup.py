"""Embedding near-dedup within labels (operator 12).

Vectors with the same label and the same entries are one *node* from the
start. Spherical k-means, fitted on a bounded sample, assigns every node to
the cell of its nearest centroid. Two unit vectors of cosine t are
sqrt(2 - 2t) apart; so a node whose distance from the boundary between its
cell and another one (the plane halfway between the two centroids) is larger
than that has no link into the other cell. A node *visits* each higher-numbered
cell of which this does not hold, and is compared there with the nodes at
home: every pair that can be a link meets exactly once, and none is lost.

A cell of more than BLOCK nodes is dealt into blocks by a hash, and each pair
of blocks is one task's matrix product of bounded size. A task returns the
number of links of each node and the root of its group, never the pairs. The
groups are joined by connected components, and the member with the smallest
id stands for its group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexnet.llm.common import components, materialize, read_table
from plexnet.shipping import ensure_importable

THRESHOLD = 0.93
#: Nodes of a label that a cell should hold, and the number of cells at most
#: (it bounds the broadcast; beyond it, cells grow and their blocks multiply).
CELL, MAX_CELLS = 2048, 4096
#: Nodes that the centroids are fitted on (expected number), and rounds.
SAMPLE, ROUNDS = 65_536, 8
#: Nodes of a block.
BLOCK = 4096
_ROUNDING = 1e-9


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in double precision; no entry over- or underflows."""
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def spherical_kmeans(v: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """``k`` unit centroids of the unit rows ``v`` (fewer where there are fewer
    rows). An empty cell keeps its centroid; ties go to the lower cell."""
    rng = np.random.default_rng(seed)
    c = v[np.sort(rng.choice(len(v), min(k, len(v)), replace=False))]
    for _ in range(rounds):
        home = np.concatenate([(part @ c.T).argmax(1) for part in np.array_split(v, max(1, len(v) // 4096))])
        sums = np.zeros_like(c)
        np.add.at(sums, home, v)
        length = np.sqrt((sums * sums).sum(1))
        c = np.where(length[:, None] > 0, sums / np.where(length > 0, length, 1)[:, None], c)
    return c


def visits(v: np.ndarray, c: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Home cell of each row of ``v``, and (row, cell) of the cells with a
    higher number whose boundary is within ``reach``."""
    sims = v @ c.T
    home = sims.argmax(1)
    apart = np.sqrt(np.maximum(0, 2 - 2 * (c @ c.T)))[home]  # of the centroids
    beyond = sims[np.arange(len(v)), home][:, None] - sims > (reach + _ROUNDING) * apart + _ROUNDING
    row, cell = np.nonzero(~beyond & (np.arange(len(c)) > home[:, None]))
    return home, row, cell


def compare(left: np.ndarray, right: np.ndarray | None, may: tuple[np.ndarray, np.ndarray | None], weight: tuple[np.ndarray, np.ndarray | None],
            threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Links among unit rows: of ``left`` with ``right``, or of ``left`` with
    itself where that is None. ``may`` marks the rows at home (two visitors are
    not compared), ``weight`` counts the copies of each. Returns per row
    (left, then right) the weighted number of links and its group's first row."""
    cross = right is not None
    other, at_home, copies = (right, may[1], weight[1]) if cross else (left, may[0], weight[0])
    near = np.zeros((len(left), len(other)), bool)
    for lo in range(0, len(left), 1024):
        part = left[lo:lo + 1024] @ other.T >= threshold
        near[lo:lo + 1024] = part & (may[0][lo:lo + 1024, None] | at_home)
    if not cross:
        np.fill_diagonal(near, False)
    n = len(left)
    links = near @ copies
    if cross:
        links = np.concatenate([links, weight[0] @ near])
    root = np.arange(len(links))
    todo = links > 0
    while todo.any():
        first = int(todo.argmax())
        todo[first] = False
        front = np.array([first])
        while len(front):
            root[front] = first
            reached = np.zeros(len(links), bool)
            reached[n if cross else 0:] = near[front[front < n]].any(0)
            if cross:
                reached[:n] = near[:, front[front >= n] - n].any(1)
            front = np.flatnonzero(reached & todo)
            todo[front] = False
    return links, root


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _place_task(shared, reach: float):
    """(node, cell, home) of each node and of its visits, with its vector."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for b in batches:
            sizes = b.column("size").to_numpy()
            for size in np.unique(sizes).tolist():
                own = b.filter(pa.array(sizes == size))
                for at in range(0, len(own), 2000):
                    part = own.slice(at, 2000)
                    home, row, cell = visits(unit(_matrix(part.column("vector"))), books[size], reach)
                    n = len(part)
                    out = part.take(pa.array(np.concatenate([np.arange(n), row])))
                    yield pa.RecordBatch.from_arrays(
                        [*(out.column(c) for c in ("node", "copies", "label", "size", "vector")),
                         pa.array(np.concatenate([home, cell]).astype(np.int32)), pa.array(np.arange(n + len(row)) < n)],
                        ["node", "copies", "label", "size", "vector", "cell", "home"])
    return run


def _compare_task(threshold: float):
    def run(group: pa.Table) -> pa.Table:
        b = group.combine_chunks()
        side = b.column("side").to_numpy()
        node, copies, home = (b.column(c).to_numpy() for c in ("node", "copies", "home"))
        v = unit(_matrix(b.column("vector").chunk(0)))
        left, right = np.flatnonzero(side != 2), np.flatnonzero(side == 2)
        if b.column("i")[0].as_py() != b.column("j")[0].as_py():
            links, root = compare(v[left], v[right], (home[left], home[right]), (copies[left], copies[right]), threshold)
            order = np.concatenate([left, right])
        else:
            links, root = compare(v, None, (home, None), (copies, None), threshold)
            order = np.arange(len(v))
        linked = links > 0
        return pa.table({"node": node[order][linked], "root": node[order][root[linked]], "links": links[linked].astype(np.int64)})
    return run


def _fit_cells(nodes: DataFrame, cell: int, max_cells: int, sample: int) -> dict[int, np.ndarray]:
    """Centroids by vector length, from a sample of the nodes drawn by hash."""
    books = {}
    for r in nodes.groupBy("label", "size").agg(F.count("*").alias("n")).groupBy("size").agg(
            F.max("n").alias("most"), F.sum("n").alias("n")).collect():
        k = min(max_cells, 1 << max(0, int(np.ceil(np.log2(r.most / cell)))))
        draw = F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < int(min(1.0, sample / r.n) * (1 << 30))
        some = nodes.where(F.col("size") == r["size"]).where(draw).orderBy("node").select("vector").toArrow().column(0).combine_chunks()
        v = unit(_matrix(some.chunk(0) if isinstance(some, pa.ChunkedArray) else some)) if len(some) else np.ones((1, r["size"])) / np.sqrt(r["size"])
        books[r["size"]] = spherical_kmeans(v, k)
    return books


def link(spark: SparkSession, vectors: DataFrame, threshold: float = THRESHOLD, column: str = "embedding",
         cell: int = CELL, max_cells: int = MAX_CELLS, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """Near duplicates of ``vectors(vec_id, <column>, label, ...)`` among rows
    of one label, by cosine in double precision.

    One row per input row: row (place in the scan), vec_id, label, n_links
    (other rows of cosine ``threshold`` or more), component_id (smallest
    vec_id that links reach, its own included), kept (one row of each group:
    the smallest vec_id; of repeated ids the first row of the scan).

    Rows whose label or vector is null, whose vector is empty, zero or holds
    null or non-finite entries link with nothing, nor do vectors of different
    lengths. Equal rows are linked. Null ids lose to any other id; a group of
    null ids only has a null component_id. Other columns are ignored; an empty
    table gives an empty result. The result is the same for any cells and
    blocks: these decide what is compared where.
    """
    ensure_importable(spark)
    v = f"`{column}`"
    usable = (f"label IS NOT NULL AND {v} IS NOT NULL AND size({v}) > 0 AND exists({v}, c -> c <> 0) "
              f"AND NOT exists({v}, c -> c IS NULL OR isnan(c) OR abs(c) = double('infinity'))")
    scan = vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("bigint").alias("vec_id"), "label", v,
                          F.expr(f"coalesce({usable}, false)").alias("usable")).withColumnRenamed(column, "vector")
    # two 64-bit hashes of different seeds stand for a vector where only equality counts
    rows = materialize(spark, scan.select(
        "row", "vec_id", "label", "usable", F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit("second"), "vector").alias("h2")), "embedding-rows")
    nodes = materialize(spark, scan.where("usable").groupBy("label", "vector").agg(F.min("row").alias("node"), F.count("*").alias("copies")).select(
        "node", "copies", "label", F.size("vector").alias("size"), "vector"), "embedding-nodes")
    shared = spark.sparkContext.broadcast(_fit_cells(nodes, cell, max_cells, sample))
    kinds = dict(nodes.dtypes)
    placed = materialize(spark, nodes.mapInArrow(
        _place_task(shared, float(np.sqrt(2 - 2 * threshold))),
        f"node bigint, copies bigint, label {kinds['label']}, size int, vector {kinds['vector']}, cell int, home boolean"), "embedding-cells")
    key = ["label", "size", "cell"]
    parts = placed.groupBy(*key).agg(F.ceil(F.count("*") / block).cast("int").alias("parts")).where("parts > 1")
    dealt = placed.join(materialize(spark, parts, "embedding-parts"), key, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("with")).select(
        "node", "copies", "home", "vector", *key, F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"),
        F.when(F.col("own") > F.col("with"), 2).otherwise(1).alias("side"))
    found = materialize(spark, dealt.groupBy(*key, "i", "j").applyInArrow(_compare_task(threshold), "node bigint, root bigint, links bigint"), "embedding-links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(spark, found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    of_node = nodes.select("node", "copies", "label", F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit("second"), "vector").alias("h2"))
    of_node = materialize(spark, of_node.join(links, "node", "left").join(groups, "node", "left").select(
        "node", "label", "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("comp", "node").alias("comp")), "embedding-groups")
    members = rows.where("usable").join(of_node, ["label", "h1", "h2"]).select("row", "vec_id", "label", "n_links", "comp")
    members = materialize(spark, members.unionAll(rows.where("NOT usable").select(
        "row", "vec_id", "label", F.lit(0).cast("bigint"), F.col("row").alias("comp"))), "embedding-members")
    head = F.min(F.struct(F.col("vec_id").isNull().alias("no_id"), "vec_id", "row"))
    heads = members.groupBy("comp").agg(head.alias("head"))
    return members.join(heads, "comp").select("row", "vec_id", "label", "n_links", F.col("head.vec_id").alias("component_id"),
                                              (F.col("row") == F.col("head.row")).alias("kept"))


def drop_near_copies(spark: SparkSession, vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``vectors`` with one row of each group, all columns as they were."""
    key = "_row_of_scan"
    while key in vectors.columns:
        key += "_"
    gone = link(spark, vectors, threshold).where("NOT kept").select(F.col("row").alias(key))
    return vectors.withColumn(key, F.monotonically_increasing_id()).join(gone, key, "left_anti").select(*vectors.columns)


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over the whole ``embeddings`` table."""
    return link(spark, read_table(spark, sf_dir, "embeddings")).select(
        "vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


OP12_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT r, vec_id, label, e FROM v
       WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda c: c <> 0)) > 0
         AND len(list_filter(e, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0),
pair AS MATERIALIZED (SELECT a.r AS a, b.r AS b FROM ok a JOIN ok b ON a.label = b.label AND a.r < b.r AND len(a.e) = len(b.e)
         AND list_cosine_similarity(a.e, b.e) >= 0.93),
edge AS (SELECT a, b FROM pair UNION ALL SELECT b, a FROM pair),
reach AS (WITH RECURSIVE w(x, y) AS (SELECT r, r FROM v UNION SELECT w.x, edge.b FROM w JOIN edge ON edge.a = w.y) SELECT * FROM w),
comp AS (SELECT reach.x AS r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.y GROUP BY reach.x),
deg AS (SELECT a AS r, count(*) AS n FROM edge GROUP BY a)
SELECT v.vec_id, coalesce(deg.n, 0) AS n_links, comp.component_id, v.vec_id IS NOT DISTINCT FROM comp.component_id AS kept
FROM v JOIN comp USING (r) LEFT JOIN deg USING (r)
"""
