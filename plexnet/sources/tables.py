"""Examples from Parquet tables.

Every fixture becomes ``examples(id BIGINT, features ARRAY<DOUBLE>,
label DOUBLE, split STRING)``: a plain projection of the source table, so
Catalyst prunes the scan to the columns used and pushes filters down.
"""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plexnet.functions.random import md5_id, md5_uniform

# ---------------------------------------------------------------------------
# Fixed values of the fixtures (FIXTURES.md)
#   validation share .............. 0.2 of rows, md5_uniform(id, 'split') < 0.2
#   L features .................... l_quantity/50, l_extendedprice/105000,
#                                   l_discount*10, l_tax*12.5
#   L label ....................... l_extendedprice*(1-l_discount) > 50000
#   LM label ...................... l_returnflag A, N, R -> 0, 1, 2
#   Z scalar ...................... (l_quantity - 25) / 5
#   V features .................... ln(1 + value), hour(ts) / 24
#   V label ....................... event_type = 'purchase'
#   D features .................... ln(n_chars), shares of digits, newlines,
#                                   ASCII punctuation and whitespace in text
# ---------------------------------------------------------------------------
VAL_FRACTION = 0.2
PUNCT_CLASS = "[!-/:-@\\[-`{-~]"        # the 32 ASCII punctuation characters
SPACE_CLASS = "[ \\t\\n\\r]"

FIXTURE_NAMES = ("E", "E2", "ES", "D", "DT", "L", "LM", "V")


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """A source table. ``spread`` deals the rows of a file that gives fewer
    input partitions than the cluster has cores (a single Parquet row group is
    read by one task) round-robin over the cores first. It is for small files
    only: by default the scan's own partitions stay."""
    from plexnet.operators.passes import balance
    t = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return balance(t) if spread else t


def split_column(id_col: Column, val_fraction: float = VAL_FRACTION, seed=None) -> Column:
    parts = [id_col, "split"] + ([seed] if seed is not None else [])
    return F.when(md5_uniform(*parts) < F.lit(float(val_fraction)), F.lit("val")).otherwise(
        F.lit("train"))


def examples_from_table(df: DataFrame, features, label: Column, id_col: Column,
                        split: Column | None = None) -> DataFrame:
    """Project any table to the examples schema.

    ``features`` is a list of numeric Columns or one array Column."""
    if isinstance(features, (list, tuple)):
        feats = F.array(*[c.cast("double") for c in features])
    else:
        feats = F.transform(features, lambda x: x.cast("double"))
    out = df.select(id_col.cast("bigint").alias("id"), feats.alias("features"),
                    label.cast("double").alias("label"))
    return out.withColumn("split", split if split is not None else split_column(F.col("id")))


def lineitem_id() -> Column:
    """Unique key of lineitem rows (six columns; (orderkey, linenumber) alone
    repeats). Price in cents and the ship day keep the text identical in SQL."""
    return md5_id(F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"),
                  F.col("l_suppkey"), F.round(F.col("l_extendedprice") * 100).cast("bigint"),
                  F.date_format(F.col("l_shipdate"), "yyyyMMdd"))


def _lineitem_features() -> list[Column]:
    return [F.col("l_quantity") / 50.0, F.col("l_extendedprice") / 105000.0,
            F.col("l_discount") * 10.0, F.col("l_tax") * 12.5]


def fixture(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """The named fixture of FIXTURES.md over the whole source table; for
    ``spread`` see :func:`table`."""
    if name in ("E", "E2", "ES"):
        t = table(spark, sf_dir, "embeddings", spread)
        if name == "E":
            lab = F.col("label")
        elif name == "E2":
            lab = (F.col("label") >= 5).cast("double")
        else:
            lab = ((F.element_at("embedding", 1).cast("double")
                    + F.element_at("embedding", 2).cast("double")) > 0).cast("double")
        return examples_from_table(t, F.col("embedding"), lab, F.col("vec_id"))
    if name in ("L", "LM"):
        t = table(spark, sf_dir, "lineitem", spread)
        if name == "L":
            lab = (F.col("l_extendedprice") * (1.0 - F.col("l_discount")) > 50000.0).cast("double")
        else:
            lab = (F.when(F.col("l_returnflag") == "A", 0.0)
                   .when(F.col("l_returnflag") == "N", 1.0)
                   .when(F.col("l_returnflag") == "R", 2.0))
        return examples_from_table(t, _lineitem_features(), lab, lineitem_id())
    if name in ("D", "DT"):
        # the five numbers are made before the join, so texts never cross it
        n = F.col("n_chars").cast("double")

        def share(pattern: str) -> Column:
            # characters matching the class, over the whole text
            hits = F.length("text") - F.length(F.regexp_replace(F.col("text"), pattern, ""))
            return hits.cast("double") / n

        docs = table(spark, sf_dir, "documents", spread).select("doc_id", F.array(
            F.log(n), share("[0-9]"), share("\\n"), share(PUNCT_CLASS), share(SPACE_CLASS)).alias("shares"))
        t = docs.join(table(spark, sf_dir, "labels"), "doc_id")
        feats = F.col("shares")
        lab = F.col("quality") if name == "D" else F.col("toxic")
        return examples_from_table(t, feats, lab, F.col("doc_id"))
    if name == "V":
        return events_examples(table(spark, sf_dir, "events", spread))
    raise ValueError(f"unknown fixture {name!r}; known: {FIXTURE_NAMES}")


def events_examples(events: DataFrame) -> DataFrame:
    """Fixture V from an events DataFrame (batch or streaming)."""
    feats = [F.log1p(F.col("value")), F.hour(F.col("ts")) / 24.0]
    lab = (F.col("event_type") == "purchase").cast("double")
    return examples_from_table(events, feats, lab, F.col("event_id"))


def events_stream(spark: SparkSession, sf_dir: str, max_files: int | None = None) -> DataFrame:
    """The events table read as a stream (file source; schema from the file)."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    r = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet")
    if max_files:
        r = r.option("maxFilesPerTrigger", int(max_files))
    return r.parquet(sf_dir)


def z_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture Z: one scalar per lineitem row for the activation functions."""
    t = table(spark, sf_dir, "lineitem")
    return t.select(lineitem_id().alias("id"),
                    ((F.col("l_quantity") - 25.0) / 5.0).alias("z"))


def fixture_names() -> Iterable[str]:
    return FIXTURE_NAMES
