"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plexnet.session import scratch_path

#: ASCII white space that separates words, as a Java/Python character class.
WS_CLASS = r"[\x20\x09-\x0D]"
#: The white space other than the space itself, for ``translate``.
_WS_OTHER = "\t\n\x0b\x0c\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder of ``spark.checkpoint.dir``
    and read it back: lineage is cut, a lost executor loses nothing."""
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*stored: DataFrame) -> None:
    """Delete tables of :func:`materialize` whose readers have all been
    committed. Only for tables that no result still reads."""
    for df in stored:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id's decimal text modulo ``m`` (a null id counts as '')."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % m


def count_words(batches) -> Iterator[pa.RecordBatch]:
    """(w, n): words ``[^\\x20\\x09-\\x0D]+`` of the texts of one column, counted
    in the task; what it holds is sent on whenever it has 500,000 words."""
    held: Counter = Counter()

    def rows():
        found, counts = list(held), list(held.values())
        for i in range(0, len(found), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(found[i:i + 100_000], pa.binary()).cast(pa.string()), pa.array(counts[i:i + 100_000], pa.int64())], ["w", "n"])
        held.clear()
    for b in batches:
        for t in b.column(0).cast(pa.binary()):
            held.update((t.as_py() or b"").split())  # bytes split at ASCII white space only
            if len(held) > 500_000:
                yield from rows()
    yield from rows()


def least_count(counts: DataFrame, column: str, most: int) -> int:
    """A count (0 at least) with at most ``most`` rows above it, near the smallest
    such: exact up to 1000, a power of two less one beyond."""
    c = F.col(column)
    step = F.when(c > 1000, 1000 + F.floor(F.log2(c))).otherwise(c)
    left, least = most, 1 << 62
    for r in counts.groupBy(step.cast("int").alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect():  # some 1050 rows at most
        left -= r.n
        if left < 0:
            break
        least = r.step - 1 if r.step <= 1000 else max(1000, (1 << (r.step - 1000)) - 1)
    return max(0, least)


def flat_text(text: Column) -> Column:
    """Null as empty; every ASCII white space character becomes a space."""
    return F.translate(F.coalesce(text, F.lit("")), _WS_OTHER, " " * len(_WS_OTHER))


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` as an array; none for null or blank text."""
    t = F.trim(flat_text(text))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " +"))


#: Bits of a filter of ids (16 MB), whatever their number, and probes.
FILTER_BITS, PROBES = 1 << 27, 2


def _filter_bits(ids: np.ndarray) -> np.ndarray:
    """Places of 64-bit ids in a filter, a row per probe."""
    h = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    step = (h >> np.uint64(13)) | np.uint64(1)
    return np.stack([(h + np.uint64(i) * step) % np.uint64(FILTER_BITS) for i in range(PROBES)]).astype(np.int64)


def id_filter(ids: DataFrame) -> bytes:
    """A Bloom filter of the one bigint column of ``ids``, built on the cluster:
    FILTER_BITS bits come to the driver, however many ids there are."""
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_filter_bits(b.column(0).to_numpy()).ravel())], ["bit"])
    maps = ids.mapInArrow(run, "bit bigint").groupBy(F.expr("bit div 32768").alias("bucket")).agg(F.expr("bitmap_construct_agg(bit % 32768)").alias("bits"))
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in maps.toLocalIterator():
        out[r.bucket * 4096:(r.bucket + 1) * 4096] = np.frombuffer(r.bits, np.uint8)
    return out.tobytes()


def maybe_in(filter_: bytes, ids: np.ndarray) -> np.ndarray:
    """Whether each id is in the filter; now and then also for one that is not."""
    bits, ok = np.frombuffer(filter_, np.uint8), np.ones(len(ids), bool)
    for at in _filter_bits(ids):
        ok &= (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return ok


def components(spark: SparkSession, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge list ``edges(a, b)``.

    Returns ``(node, comp)`` with ``comp`` the smallest node of the component,
    one row per node that occurs in an edge. Each round takes the smallest
    label among the neighbours and then follows the label's own label
    (pointer jumping), so long chains shrink by halves. Every round is written
    to the shared folder. Both join sides are plain scans, so that adaptive
    execution can split the partition of a hub node; minima are pre-aggregated
    per task. An empty edge list gives an empty result; nulls are dropped.
    """
    e = edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    e = materialize(spark, e.union(e.select("b", "a")).distinct(), "edges")
    if e.isEmpty():
        return e.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    lab = materialize(spark, e.groupBy(F.col("a").alias("node")).agg(
        F.least(F.min("b"), F.col("a")).alias("comp")), "labels")
    for _ in range(max_rounds):
        near = e.join(lab, e.b == lab.node).select(F.col("a").alias("node"), "comp",
                                                   F.lit(None).cast(lab.schema["comp"].dataType).alias("old"))
        own = lab.select("node", "comp", F.col("comp").alias("old"))
        hooked = materialize(spark, near.union(own).groupBy("node").agg(
            F.min("comp").alias("comp"), F.max("old").alias("old")), "hooked")
        up = hooked.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        lab2 = materialize(spark, hooked.join(up, "comp", "left").select(
            "node", F.least("comp", "up").alias("comp"), "old"), "labels")
        lab = lab2.select("node", "comp")
        if lab2.where("comp <> old").isEmpty():
            return lab
    raise RuntimeError(f"components: not settled after {max_rounds} rounds")


def array_file_head(spec: dict[str, tuple[str, int]]) -> tuple[bytes, dict[str, int], int]:
    """For a file of arrays of these types and lengths: its first line (JSON
    with the layout), the place of each array in the file, and the file's size."""
    layout, at = {}, 0
    for k, (dtype, n) in spec.items():
        layout[k] = [dtype, n, at]
        at += -(-n * np.dtype(dtype).itemsize // 8) * 8
    head = json.dumps(layout).encode()
    head += b" " * (-(len(head) + 1) % 8) + b"\n"
    return head, {k: len(head) + x[2] for k, x in layout.items()}, len(head) + at


def save_arrays(arrays: dict[str, np.ndarray], path: str) -> None:
    """Write arrays to one file: a JSON line with the layout, then the bytes."""
    head, _, _ = array_file_head({k: (a.dtype.str, len(a)) for k, a in arrays.items()})
    with open(path, "wb") as f:
        f.write(head)
        for a in arrays.values():
            f.write(a.tobytes() + bytes(-a.nbytes % 8))


def map_arrays(path: str) -> dict[str, np.ndarray]:
    """The arrays of :func:`save_arrays`, memory-mapped: the workers of a
    machine share the pages."""
    with open(path, "rb") as f:
        head = f.readline()
    return {k: np.memmap(path, dtype, "r", len(head) + at, (n,)) for k, (dtype, n, at) in json.loads(head).items()}
