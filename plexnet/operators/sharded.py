"""Passes of models that are larger than one broadcast.

Weights stay in a table of tiles: tile (layer, kb, cb) holds the weights from
TILE inputs to TILE units, and (layer, -1, cb) the bias row. Examples become
blocks of ROWS rows, and consecutive blocks a group whose activations of all
layers fit HELD doubles. A group is shuffled once; the tiles of all layers come
to it in the order of the pass and are held one at a time:

    forward   z(cb)    += a(kb) . W(kb, cb)                 layer by layer
    backward  e(kb)    += e(cb) . W(kb, cb)' * f'(z(kb))    from the last layer down
    gradient  g(kb, cb) = a(kb)' . e(cb)                    summed over the groups

So a pass shuffles the examples once, and the weights and gradients once per
group (the weights twice for gradients); activations never leave their task.
Nothing is broadcast or brought to the driver but the layer widths, the number
of blocks and the numbers of the groups. Tiles and blocks are stored under
``spark.checkpoint.dir``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, groupby
from operator import attrgetter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexnet.functions.activations import get_activation
from plexnet.operators import kernel as K
from plexnet.operators.params import layer_shapes
from plexnet.session import scratch_path
from plexnet.shipping import ensure_importable

TILE, ROWS = 256, 256
#: Doubles that a task holds of a group: pre-activations, activations and errors of its rows.
HELD = 8_000_000
_TILES = "model_id string, layer int, kb int, cb int, m binary"


class _Row(NamedTuple):
    """A row that comes to a group: a block of examples (no model, step 0) or a tile."""

    g: int
    model: str | None
    step: int
    layer: int
    kb: int
    cb: int
    rb: int
    ids: list
    labels: list
    m: bytes


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, f"sharded-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _array(raw: bytes, cols: int) -> np.ndarray:
    return np.frombuffer(raw, np.float64).reshape(-1, cols)


def weight_tiles(params: DataFrame, tile: int = TILE, value: str = "theta") -> DataFrame:
    """(model_id, layer, kb, cb, m): the weights as row-major tiles, one per
    group of at most ``tile`` x ``tile`` rows of the parameter table."""
    ensure_importable(params.sparkSession)

    def pack(group: pa.Table) -> pa.Table:
        g = group.combine_chunks()
        row, col, v = (g.column(c).to_numpy() for c in ("row", "col", "v"))
        m = np.zeros((row.max() - row.min() + 1, col.max() - col.min() + 1))
        if m.size != len(v):
            raise ValueError(f"model {g.column('model_id')[0].as_py()} layer {g.column('layer')[0].as_py()}: {len(v)} weights for a tile of {m.shape}")
        m[row - row.min(), col - col.min()] = v
        return pa.table({**{c: g.column(c).slice(0, 1) for c in ("model_id", "layer", "kb", "cb")}, "m": pa.array([m.tobytes()], pa.binary())})
    kb = F.when(F.col("row") == 0, -1).otherwise(F.expr(f"(row - 1) div {tile}")).cast("int")
    cells = params.select("model_id", "layer", kb.alias("kb"), F.expr(f"CAST(col div {tile} AS INT)").alias("cb"), "row", "col", F.col(value).alias("v"))
    return cells.groupBy("model_id", "layer", "kb", "cb").applyInArrow(pack, "model_id string, layer int, kb int, cb int, m binary")


def _blocks(examples: DataFrame, rows: int) -> DataFrame:
    """(rb, ids, labels, x) with x the features of up to ``rows`` examples."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        rb = TaskContext.get().partitionId() << 33
        for b in batches:
            for at in range(0, len(b), rows):
                part = b.slice(at, rows)
                x = part.column("features").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([rb], pa.int64()), *(pa.array([part.column(c).to_pylist()], pa.list_(t)) for c, t in (("id", pa.int64()), ("label", pa.float64()))),
                     pa.array([x.tobytes()], pa.binary())], ["rb", "ids", "labels", "x"])
                rb += 1
    return examples.select(F.col("id").cast("bigint").alias("id"), F.col("label").cast("double").alias("label"), "features").mapInArrow(
        run, "rb bigint, ids array<bigint>, labels array<double>, x binary")


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[_Row]:
    for b in batches:
        for i in range(len(b)):
            yield _Row(*(c[i].as_py() for c in b.columns))


def _tile_rows(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows (model_id, layer, kb, cb, m) in batches of about 32 MB."""
    kinds, names = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary()), ["model_id", "layer", "kb", "cb", "m"]

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
    out, size = [], 0
    for row in found:
        out.append(row)
        size += len(row[-1])
        if size > 32 << 20:
            yield batch()
            out, size = [], 0
    if out:
        yield batch()


class _Shapes:
    """Widths of the layers of models that have the same number of layers."""

    def __init__(self, widths: dict[str, list[int]], tile: int):
        self.widths, self.tile = widths, tile

    def size(self, model: str, layer: int, block: int) -> int:
        """Units of a block of layer ``layer`` (0: the input; block -1: the bias input)."""
        return 1 if block < 0 else min(self.tile, self.widths[model][layer] - block * self.tile)

    def count(self, model: str, layer: int) -> int:
        return -(-self.widths[model][layer] // self.tile)

    def at(self, block: int) -> slice:
        """Units of a block among those of its layer."""
        return slice(block * self.tile, (block + 1) * self.tile)


def _summed(parts: DataFrame) -> DataFrame:
    """Adds up the matrices of one (model_id, layer, kb, cb), one at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sums() -> Iterator[tuple]:
            rows = (tuple(c[i].as_py() for c in b.columns) for b in batches for i in range(len(b)))
            for key, same in groupby(rows, key=lambda r: r[:4]):
                total = np.frombuffer(next(same)[4], np.float64).copy()
                for r in same:
                    total += np.frombuffer(r[4], np.float64)
                yield (*key, total.tobytes())
        yield from _tile_rows(sums())
    key = ["model_id", "layer", "kb", "cb"]
    return parts.select(*key, "m").repartition(*key).sortWithinPartitions(*key).mapInArrow(run, _TILES)


class ShardedPass:
    """Forward and backward passes of ``models`` with the weights ``params``
    over ``examples`` (id, features, label), in tiles. Models of one pass have
    the same number of layers and the examples' width."""

    def __init__(self, examples: DataFrame, params: DataFrame, models: DataFrame, tile: int = TILE, rows: int = ROWS):
        spark = examples.sparkSession
        ensure_importable(spark)
        widths: dict[str, dict[int, tuple[int, int]]] = {}
        for r in layer_shapes(params).collect():  # one row per model and layer
            widths.setdefault(r["model_id"], {})[r["layer"]] = (r["rows"], r["cols"])
        sizes = {m: [s[0][0] - 1, *(s[k][1] for k in range(len(s)))] for m, s in widths.items()}
        if len({len(w) for w in sizes.values()}) != 1 or len({w[0] for w in sizes.values()}) != 1:
            raise ValueError("models of one sharded pass must share the input width and the number of layers")
        self.spec = {r["model_id"]: K.NetSpec(r["model_id"], [np.zeros((1, int(r["outputs"])))], r["activation"], int(r["outputs"]) > 1, r["loss"] or "log")
                     for r in models.select("model_id", "outputs", "activation", "loss").collect()}
        self.tile, self.layers = tile, len(next(iter(sizes.values()))) - 1
        self.shapes = _Shapes(sizes, tile)
        self.acts = {s.activation: (get_activation(s.activation).numpy, get_activation(s.activation).d_numpy) for s in self.spec.values()}
        most = max(1, HELD // (3 * max(sum(w) for w in sizes.values())))  # rows of a group
        rows = min(rows, most)
        self.tiles = _stored(weight_tiles(params, tile), "tiles")
        blocks = _stored(_blocks(examples, rows), "blocks")
        spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
        # numbers of blocks leave wide gaps between partitions, so no group has blocks of two
        each = max(1, min(most // rows, -(-blocks.count() // spread)))
        self.blocks = blocks.withColumn("g", F.expr(f"rb div {each}"))

    def _steps(self, backward: bool) -> DataFrame:
        """The rows of every group in the order of the pass: its blocks, then for
        each model the tiles forward (steps 1 to layers) and those backward (to
        2 * layers - 1, layer 1)."""
        def none(kind):
            return F.lit(None).cast(kind)
        blocks = self.blocks.select("g", none("string").alias("model_id"), F.lit(0).alias("step"), F.lit(-1).alias("layer"), F.lit(-1).alias("kb"), F.lit(-1).alias("cb"),
                                    "rb", "ids", "labels", F.col("x").alias("m"))
        forward = self.tiles.withColumn("step", F.col("layer") + 1)
        tiles = forward
        if backward:
            tiles = forward.unionByName(self.tiles.where("layer > 0 AND kb >= 0").withColumn("step", F.lit(2 * self.layers) - F.col("layer")))
        dealt = tiles.crossJoin(F.broadcast(self.blocks.select("g").distinct()))  # one number per group
        tiles = dealt.select("g", "model_id", "step", "layer", "kb", "cb", none("bigint").alias("rb"), none("array<bigint>").alias("ids"),
                             none("array<double>").alias("labels"), "m")
        return blocks.unionAll(tiles).repartition("g").sortWithinPartitions("g", "model_id", "step", "kb", "cb", "rb")

    def _groups(self):
        """(batches) -> (model, ids, labels, activations, pre-activations of the
        hidden layers and of the output, rows of the steps backward) of every group and model."""
        shapes, spec, acts, layers = self.shapes, self.spec, self.acts, self.layers

        def forward(model: str, x: np.ndarray, steps: Iterator) -> tuple:
            a, zs = [x], []
            for layer in range(layers):
                z = np.zeros((len(x), shapes.widths[model][layer + 1]))
                for t in next(steps)[1]:
                    w = _array(t.m, shapes.size(model, layer + 1, t.cb))
                    z[:, shapes.at(t.cb)] += w if t.kb < 0 else a[layer][:, shapes.at(t.kb)] @ w
                if layer + 1 < layers:
                    zs.append(z)
                    a.append(acts[spec[model].activation][0](z))
            return a, zs, z

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            for _, rows in groupby(_each(batches), key=attrgetter("g")):
                models = groupby(rows, key=attrgetter("model"))
                blocks = list(next(models)[1])
                ids, labels = (list(chain.from_iterable(v)) for v in ([b.ids for b in blocks], [b.labels for b in blocks]))
                x = np.frombuffer(b"".join(b.m for b in blocks), np.float64)
                width = next(iter(shapes.widths.values()))[0]
                if len(x) != len(ids) * width:
                    raise ValueError(f"ragged features: {len(x)} values for {len(ids)} rows of width {width}")
                x, y = x.reshape(-1, width), np.array(labels, np.float64)
                del blocks, labels
                for model, tiles in models:
                    steps = groupby(tiles, key=attrgetter("step"))
                    yield (model, ids, y, *forward(model, x, steps), steps)
        return run

    def score(self) -> DataFrame:
        """(id, model_id, p ARRAY<DOUBLE>)."""
        spec, groups = self.spec, self._groups()

        def run(batches):
            for model, ids, _, _, _, z, _ in groups(batches):
                for at in range(0, len(ids), 10_000):
                    part = ids[at:at + 10_000]
                    p = K.output_probs(spec[model], z[at:at + 10_000])
                    ends = pa.array(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([model] * len(part), pa.string()), pa.ListArray.from_arrays(ends, pa.array(p.ravel()))],
                                                     ["id", "model_id", "p"])
        return self._steps(False).mapInArrow(run, "id bigint, model_id string, p array<double>")

    def gradient_tiles(self, with_grads: bool = True) -> DataFrame:
        """(model_id, layer, kb, cb, m): gradient sums over all examples, as tiles,
        and the scalar sums named in ``kernel.SCALAR_NAMES`` as a tile of layer -1."""
        shapes, spec, acts, layers, groups = self.shapes, self.spec, self.acts, self.layers, self._groups()

        def scalars(s: K.NetSpec, y: np.ndarray, z: np.ndarray, p: np.ndarray) -> np.ndarray:
            out, cost = np.zeros(K.N_SCALARS), K.row_costs(s, z, p, y).sum()
            for k, v in ((K.S_VAL_COST, cost), (K.S_VAL_N, len(y)), (K.S_VAL_CORRECT, (K.predictions(s, p) == y).sum()), (K.S_VAL_SUM_Y, y.sum()),
                         (K.S_VAL_SUM_Y2, (y * y).sum()), (K.S_BATCH_N, len(y)), (K.S_BATCH_COST, cost), (K.S_VAL_SQE, 0.0 if s.multi else ((y - p[:, 0]) ** 2).sum())):
                out[k] = v
            return out

        def outer(model: str, layer: int, a: np.ndarray, e: np.ndarray) -> Iterator[tuple]:
            for cb in range(shapes.count(model, layer + 1)):
                right = e[:, shapes.at(cb)]
                yield model, layer, -1, cb, right.sum(0).tobytes()
                for kb in range(shapes.count(model, layer)):
                    yield model, layer, kb, cb, (a[:, shapes.at(kb)].T @ right).tobytes()

        def each(batches) -> Iterator[tuple]:
            for model, _, y, a, zs, z, steps in groups(batches):
                s = spec[model]
                K.check_labels(s, y)
                p = K.output_probs(s, z)
                yield model, -1, -1, 0, scalars(s, y, z, p).tobytes()
                if not with_grads:
                    continue
                e = K.output_error(s, p, y)
                for layer in range(layers - 1, 0, -1):
                    yield from outer(model, layer, a[layer], e)
                    below = np.zeros_like(a[layer])
                    for t in next(steps)[1]:
                        w = _array(t.m, shapes.size(model, layer + 1, t.cb))
                        below[:, shapes.at(t.kb)] += e[:, shapes.at(t.cb)] @ w.T
                    e = below * acts[s.activation][1](zs[layer - 1])
                yield from outer(model, 0, a[0], e)

        def run(batches):
            yield from _tile_rows(each(batches))
        return _summed(self._steps(with_grads).mapInArrow(run, _TILES))

    def gradient_sums(self, with_grads: bool = True) -> DataFrame:
        """(model_id, layer, row, col, value) with the scalar rows of layer -1, as ``passes.gradient_sums``."""
        shapes, tile = self.shapes, self.tile

        def run(batches):
            for b in batches:
                for i in range(len(b)):
                    model, layer, kb, cb, m = (c[i].as_py() for c in b.columns)
                    g = _array(m, shapes.size(model, layer + 1, cb) if layer >= 0 else 1)
                    r, c = np.indices(g.shape)
                    r, c = (r if layer < 0 else np.zeros_like(r) if kb < 0 else r + kb * tile + 1).ravel(), (c + cb * tile).ravel()
                    yield pa.RecordBatch.from_arrays([pa.array([model] * g.size, pa.string()), pa.array(np.full(g.size, layer, np.int32)),
                                                      pa.array(r.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(g.ravel())], ["model_id", "layer", "row", "col", "value"])
        return self.gradient_tiles(with_grads).mapInArrow(run, "model_id string, layer int, row int, col int, value double")

    def scalars(self) -> DataFrame:
        """(model_id, layer -1, row, col 0, value): the scalar sums named in ``kernel.SCALAR_NAMES``."""
        return self.gradient_sums(with_grads=False)

    def evaluate(self) -> DataFrame:
        """Count, mean cost, accuracy and squared errors per model, as ``passes.evaluate``."""
        s = self.scalars().groupBy("model_id").agg(*(F.sum(F.when(F.col("row") == i, F.col("value"))).alias(c) for i, c in enumerate(K.SCALAR_NAMES)))
        n = F.col("val_n")
        return s.select("model_id", n.cast("bigint").alias("n"), (F.col("val_cost") / n).alias("cost"), (F.col("val_correct") / n).alias("accuracy"),
                        F.col("val_sqe").alias("sqe"), (F.col("val_sum_y2") - F.col("val_sum_y") * F.col("val_sum_y") / n).alias("sst"))
