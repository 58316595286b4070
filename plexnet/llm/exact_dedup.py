"""Exact dedup over a persistent digest index (operator 2, DataFrame only).

The index is a Parquet table of (digest, keep_id, keep_row), hash-bucketed
and sorted by ``digest``. A batch of documents is reduced to one row per
digest (pre-aggregated in each task), sort-merge anti-joined against the
index, and only digests that are new are appended. Because the index is
bucketed by the join key, the index itself is never shuffled.

Texts are equal when they are identical after replacing each run of ASCII
white space by one space; the digest is the SHA-256 of that text in UTF-8.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plexnet.llm.common import WS_CLASS, materialize
from plexnet.session import scratch_path

#: A digest with more than 1/HEAVY of all rows is joined by broadcast; there
#: can be at most HEAVY such digests, whatever the data.
HEAVY = 1000


def digest(text: Column) -> Column:
    """SHA-256 (binary) of the normalised text; null counts as empty."""
    norm = F.regexp_replace(F.coalesce(text, F.lit("")), WS_CLASS + "+", " ")
    return F.unhex(F.sha2(norm, 256))


class DigestIndex:
    """A digest index at ``path`` (any shared file system Spark can write).

    Opening a path that holds an index registers it under a session table
    name; an absent one is created. The number of buckets is stored beside the
    index, in ``<path>.meta``: an index that is opened again has the buckets it
    was made with, whatever the session's settings, and asking for another
    number raises. ``add`` may be repeated after a failure: digests that are
    already in the index are not appended again.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        stored = self._stored_buckets()
        if stored is not None and buckets not in (None, stored):
            raise ValueError(f"the index at {self.path} has {stored} buckets, not {buckets}")
        self.buckets = stored or buckets or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
        if stored is None:
            spark.createDataFrame([(self.buckets,)], "buckets int").coalesce(1).write.json(f"{self.path}.meta")
        self.name = "digest_index_" + hashlib.sha256(self.path.encode()).hexdigest()[:24]
        spark.sql(f"""CREATE TABLE IF NOT EXISTS {self.name}
            (digest BINARY, keep_id BIGINT, keep_row BIGINT) USING PARQUET
            CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'""")

    def _stored_buckets(self) -> int | None:
        try:
            return self.spark.read.schema("buckets int").json(f"{self.path}.meta").first().buckets
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, groups: DataFrame) -> None:
        """Append the rows of ``groups(digest, keep_id, keep_row)`` whose
        digest the index does not hold yet (one row per digest)."""
        new = groups.select("digest", "keep_id", "keep_row").hint("merge").join(
            self.table().select("digest").hint("merge"), "digest", "left_anti")
        (new.repartition(self.buckets, "digest").sortWithinPartitions("digest")
            .write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest")
            .mode("append").option("path", self.path).saveAsTable(self.name))
        self.spark.catalog.refreshTable(self.name)


def dedup(spark: SparkSession, docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """Decide for each row of ``docs(doc_id, text, ...)`` which row stays.

    Returns one row per input row: ``row`` (row number of the scan), doc_id,
    keep_id, group_size (rows of this batch with the text), kept, digest. Of
    equal texts the smallest doc_id stays (a null id loses to any other; of
    repeated rows with one id exactly one stays). With an ``index`` that
    already holds a text, no row of the batch is kept and ``keep_id`` is the
    id noted in the index. Other columns are ignored; an empty table gives an
    empty result.
    """
    index = index or DigestIndex(spark, scratch_path(spark, "digest-index"))
    rows = materialize(spark, docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"),
        digest(F.col("text")).alias("digest")), "digests")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    groups = materialize(spark, rows.groupBy("digest").agg(first.alias("first"), F.count("*").alias("group_size"))
                         .select("digest", F.col("first.doc_id").alias("keep_id"),
                                 F.col("first.row").alias("keep_row"), "group_size"), "digest-groups")
    known = groups.join(index.table().select("digest", F.col("keep_id").alias("old_id")), "digest")
    known = materialize(spark, known.groupBy("digest").agg(F.min("old_id").alias("old_id")), "digest-known")  # one row per digest
    index.add(groups)
    total = rows.count()
    cols = ["row", "doc_id", "digest", "keep_id", "keep_row", "group_size"]
    heavy = groups.where(F.col("group_size") * HEAVY > F.lit(total))
    rest = groups.where(F.col("group_size") * HEAVY <= F.lit(total))
    many = rows.join(F.broadcast(heavy), "digest").select(cols)
    few = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti").join(rest, "digest").select(cols)
    out = many.union(few).withColumn("old_id", F.lit(None).cast("bigint"))
    in_index = F.lit(False)
    if not known.isEmpty():  # texts that an earlier batch has already put into the index
        out = out.drop("old_id").join(known.withColumn("in_index", F.lit(True)), "digest", "left")
        in_index = F.coalesce(F.col("in_index"), F.lit(False))
    return out.select(
        "row", "doc_id", F.when(in_index, F.col("old_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        "group_size", (~in_index & (F.col("row") == F.col("keep_row"))).alias("kept"), "digest")


def drop_copies(spark: SparkSession, docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """``docs`` without exact copies, all columns as they were. Rows are told
    apart by their place in the scan, so null and repeated ids are safe."""
    key = "_row_of_scan"
    while key in docs.columns:
        key += "_"
    gone = dedup(spark, docs, index).where("NOT kept").select(F.col("row").alias(key))
    return docs.withColumn(key, F.monotonically_increasing_id()).join(gone, key, "left_anti").select(*docs.columns)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: a fresh index over the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(spark, docs).select("doc_id", "keep_id", "group_size", "kept",
                                     F.lower(F.hex("digest")).alias("text_sha256"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h)
"""
