"""Wide sparse examples: (id, indices ARRAY<INT>, values ARRAY<DOUBLE>, label,
split). ``indices`` are 0-based feature numbers, ``values`` what stands there;
every other feature is 0. No dense row is ever built.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexnet.functions.random import md5_id
from plexnet.shipping import ensure_importable
from plexnet.sources.lines import numbered_lines
from plexnet.sources.tables import split_column

_WORD = re.compile(r"[^\x20\x09-\x0d]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


class _Buckets(dict):
    def __init__(self, n: int):
        super().__init__()
        self.n = n

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        k = self[word] = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % self.n
        return k


def hashed_words(docs: DataFrame, n_features: int, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(indices, values, *keep) of every whole text: words (A-Z lower-cased)
    hashed by md5 into ``n_features`` buckets, with the share of the text's
    words that fall into each. A narrow pass: nothing is shuffled. Null and
    blank texts have no entries; texts of any length are read whole."""
    ensure_importable(docs.sparkSession)
    src = docs.select(F.col(text).alias("_text"), *keep)
    names = ["indices", "values", *keep]
    schema = "indices array<int>, values array<double>" + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in src.drop("_text").schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = _Buckets(n_features)
        for b in batches:
            for at in range(0, len(b), 1000):
                part = b.slice(at, 1000)
                ids, shares = [], []
                for t in part.column(0).to_pylist():
                    found = _WORD.findall((t or "").translate(_LOWER))
                    k, n = np.unique(np.fromiter(map(bucket.__getitem__, found), np.int32, len(found)), return_counts=True)
                    ids.append(k)
                    shares.append(n / max(1, len(found)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float64())), *(part.column(i) for i in range(1, part.num_columns))],
                    names)
    return src.mapInArrow(run, schema)


def read_libsvm_sparse(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Sparse examples of LibSVM text files (``label index:value ...``, indices
    from 1). Blank lines and lines that start with ``#`` are no examples. The
    id is md5 of the file and the line's number in it, so it does not depend
    on how the file is cut into splits. A label or an entry that is no number
    raises; entries may come in any order."""
    lines = numbered_lines(spark, path).where("trim(value) <> '' AND NOT startswith(ltrim(value), '#')")
    # steps of their own: named in one, tokens and entries would be split anew for every use
    lines = lines.select("file", "line", F.split(F.trim(F.col("value")), r"\s+").alias("_tokens"))
    lines = lines.select("file", "line", F.col("_tokens")[0].cast("double").alias("label"),
                         F.transform(F.slice("_tokens", 2, F.size("_tokens")), lambda t: F.split(t, ":")).alias("_entries"))
    out = lines.select(
        md5_id(F.col("file"), F.col("line")).alias("id"),
        F.transform("_entries", lambda e: (e[0].cast("int") - 1)).alias("indices"), F.transform("_entries", lambda e: e[1].cast("double")).alias("values"), "label")
    sp = F.lit(split) if split is not None else split_column(F.col("id"))
    return out.select("id", "indices", "values", "label", sp.alias("split"))


def write_libsvm_sparse(examples: DataFrame, path: str, mode: str = "overwrite") -> None:
    """LibSVM text of sparse examples, entries in the order they stand in."""
    pairs = F.transform(F.arrays_zip("indices", "values"), lambda e: F.concat((e["indices"] + 1).cast("string"), F.lit(":"), e["values"].cast("string")))
    examples.select(F.concat_ws(" ", F.col("label").cast("string"), F.array_join(pairs, " ")).alias("value")).write.mode(mode).text(path)


def sparse_width(examples: DataFrame) -> int:
    """Least width that holds every index (one aggregate; 0 without entries)."""
    return int(examples.agg(F.coalesce(F.max(F.array_max("indices")) + 1, F.lit(0)).alias("w")).first()["w"])


def to_dense(examples: DataFrame, n_features: int) -> DataFrame:
    """Dense ``features`` of sparse examples, for narrow data: each example's
    entries are placed by a map from index to value."""
    at = F.map_from_arrays("indices", "values")
    dense = F.transform(F.sequence(F.lit(0), F.lit(n_features - 1)), lambda i: F.coalesce(F.try_element_at(at, i), F.lit(0.0)))
    rest = [c for c in examples.columns if c not in ("indices", "values")]
    return examples.select(*rest, dense.alias("features"))
