"""Embedding whitening by a bit-sliced scatter matrix (operator 11, DataFrame only).

Entries become integers x = floor(SCALE * c). The fit list is every distinct
x vector once. Each dimension is shifted by its minimum, so its values are
short unsigned numbers, and its bits are sliced into planes: the same bit of
64 vectors is one 64-bit word. The sum of products of two dimensions is then

    sum over planes i, j of  2^(i+j) * popcount(plane_i AND plane_j)

in exact integers. A dimension that is 1 everywhere is packed with the others,
so its products give n and the sums S from the same structure. Only the
(D+1)^2 totals come to the driver, where they are centred as integers,
n * sum(xy) - S S', before the eigenvectors are taken.

Words hold 64 rows that stand together in the stored fit list, so the planes
are built by a map-side aggregate, and what is shuffled is their bits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexnet.llm.common import materialize, read_table

SCALE, COMPONENTS = 256, 4
#: Bit planes of one unit; a dimension of more bits is cut into several units.
#: A sum of products of two units stays below rows * 2^(2 * UNIT_BITS).
UNIT_BITS = 12
#: Eigenvalues below this share of the largest are rounding, not variance.
NO_VARIANCE = 1e-12


@dataclass
class Scatter:
    """Exact integers of a fit list: number of vectors, and per dimension sums,
    least and greatest value, and the centred products n * sum(xy) - S S'."""

    n: int
    sums: list[int]
    least: list[int]
    most: list[int]
    centred: np.ndarray  # of Python integers

    @property
    def covariance(self) -> np.ndarray:
        n2 = self.n * self.n
        return np.array([[c / n2 for c in row] for row in self.centred.tolist()], float)


def with_integers(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """``vectors`` without the rows whose vector is null, empty or holds null
    or non-finite entries, and with the integer vector ``x``."""
    v = f"`{column}`"
    ok = f"size({v}) > 0 AND NOT exists({v}, c -> c IS NULL OR isnan(c) OR abs(c) = double('infinity'))"
    return vectors.where(f"{v} IS NOT NULL").where(ok).withColumn(
        "x", F.expr(f"transform({v}, c -> CAST(floor({SCALE}D * CAST(c AS DOUBLE)) AS BIGINT))"))


def planes(fit: DataFrame, least: list[int], bits: int) -> DataFrame:
    """``(block, unit, p0, p1, ...)``: for 64 vectors of ``fit(x)`` the bit
    planes of each unit. Unit 0 belongs to the dimension that is 1 everywhere."""
    units = max(1, -(-bits // UNIT_BITS))
    width = min(bits, UNIT_BITS)
    each = fit.select(F.monotonically_increasing_id().alias("id"), F.concat(F.array(F.lit(1).cast("bigint")), "x").alias("x")).select(
        "id", F.posexplode("x").alias("dim", "v"))
    low = F.lit([0, *least]).cast("array<bigint>")
    each = each.withColumn("u", F.col("v") - F.element_at(low, F.col("dim") + 1))
    if units > 1:
        each = each.select("id", "dim", "u", F.explode(F.sequence(F.lit(0), F.lit(units - 1))).alias("k"))
        each = each.select("id", (F.col("dim") * units + F.col("k")).alias("unit"),
                           F.expr(f"shiftright(u, CAST({UNIT_BITS} * k AS INT)) & {(1 << UNIT_BITS) - 1}L").alias("u"))
    else:
        each = each.withColumnRenamed("dim", "unit")
    lane = "CAST(id & 63 AS INT)"
    return each.groupBy(F.expr("shiftright(id, 6)").alias("block"), "unit").agg(
        *(F.expr(f"coalesce(bit_or(shiftleft(shiftright(u, {b}) & 1L, {lane})), 0L)").alias(f"p{b}") for b in range(width)))


def products(sliced: DataFrame, width: int) -> DataFrame:
    """``(a, b, total)`` for units a <= b: the sum of the products of their
    values over all blocks, by weighted AND-popcounts."""
    names = [f"p{i}" for i in range(width)]
    blocks = sliced.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("unit", *names))).alias("units"))
    left = blocks.select("units", F.posexplode("units").alias("at", "l"))
    both = left.select("l", F.explode(F.expr("slice(units, at + 1, size(units))")).alias("r"))
    both = both.select(F.col("l.unit").alias("a"), F.col("r.unit").alias("b"),
                       *(F.col(f"l.{p}").alias(f"l{p}") for p in names), *(F.col(f"r.{p}").alias(f"r{p}") for p in names))
    weighted = []
    for s in range(2 * width - 1):
        same = " + ".join(f"bit_count(lp{i} & rp{s - i})" for i in range(max(0, s - width + 1), min(width, s + 1)))
        weighted.append(f"shiftleft(CAST({same} AS BIGINT), {s})")
    return both.groupBy("a", "b").agg(F.sum(F.expr(" + ".join(weighted))).alias("total"))


def scatter(fit: DataFrame) -> Scatter | None:
    """The exact scatter of a stored table ``fit(x array<bigint>)``; None where
    it is empty. Vectors of different lengths and entries that span 2^52 steps
    or more raise ValueError."""
    ends = fit.select(F.posexplode("x").alias("dim", "v")).groupBy("dim").agg(
        F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n")).orderBy("dim").collect()
    if not ends:
        return None
    if len({r.n for r in ends}) > 1:
        raise ValueError("vectors of different lengths")
    least, most = [r.lo for r in ends], [r.hi for r in ends]
    bits = max(1, *((hi - lo).bit_length() for lo, hi in zip(least, most, strict=True)))
    if bits > 52:
        raise ValueError("entries of one dimension span 2^52 steps or more")
    units, dims = max(1, -(-bits // UNIT_BITS)), len(ends) + 1
    whole = np.zeros((dims, dims), object)
    for r in products(planes(fit, least, bits), min(bits, UNIT_BITS)).collect():
        (d, i), (e, j) = divmod(r.a, units), divmod(r.b, units)
        value = r.total << (UNIT_BITS * (i + j))
        whole[d, e] += value
        if r.a != r.b:
            whole[e, d] += value
    n, shifted = whole[0, 0], whole[0, 1:]
    centred = n * whole[1:, 1:] - np.outer(shifted, shifted)
    return Scatter(n, [s + n * lo for s, lo in zip(shifted.tolist(), least, strict=True)], least, most, centred)


def _dot(values: str, weights: list[float]) -> str:
    w = ", ".join(f"{x!r}D" for x in weights)
    return f"aggregate(zip_with({values}, array({w}), (p, w) -> p * w), 0D, (t, p) -> t + p)"


def whiten(spark: SparkSession, vectors: DataFrame, components: int = COMPONENTS, column: str = "embedding") -> DataFrame:
    """Principal components of ``vectors``, whitened.

    Returns for each remaining row of ``vectors``, with its columns, and each
    component 1.. (at most the number of dimensions): component int, n (vectors
    of the fit list), deviation (exact sum over dimensions of (n x - S)^2:
    bigint, or decimal(38,0) where a bigint may be too small), whitened,
    explained (share of the total variance), identity_error (largest deviation
    of the whitened fit list's covariance from the identity).

    Rows whose vector is null, empty or holds null or non-finite entries go;
    repeated rows stay and count once in the fit list; equal eigenvalues keep
    the order and the vectors that eigh gives. A component without variance
    has whitened null and explained 0 and no part in identity_error. Columns
    of ``vectors`` named like one of the results (or ``x``, ``_away``, ``_cell``) go; an
    empty table gives an empty result; vectors of different lengths raise.
    """
    rows = with_integers(vectors, column)
    fit = materialize(spark, rows.select("x").distinct(), "whitening-fit")
    sc = scatter(fit)
    if sc is None:
        sc = Scatter(0, [], [], [], np.zeros((0, 0), object))
    dims = len(sc.sums)
    values, vecs = np.linalg.eigh(sc.covariance) if dims else (np.zeros(0), np.zeros((0, 0)))
    order = np.argsort(-values, kind="stable")[:components]
    trace = float(np.trace(sc.covariance)) if dims else 0.0
    alive = [bool(values[k] > NO_VARIANCE * max(values)) for k in order]
    explained = [float(values[k] / trace) if up else 0.0 for k, up in zip(order, alive, strict=True)]
    mean = [s / sc.n for s in sc.sums]
    away = f"zip_with(x, array({', '.join(f'{m!r}D' for m in mean)}), (a, m) -> a - m)"
    white = [_dot("_away", (vecs[:, k] / np.sqrt(values[k])).tolist()) if up else "CAST(NULL AS DOUBLE)" for k, up in zip(order, alive, strict=True)]
    error = _identity_error(fit.select(F.expr(away).alias("_away")), [w for w, up in zip(white, alive, strict=True) if up])
    far = sum(max(abs(sc.n * lo - s), abs(sc.n * hi - s)) ** 2 for lo, hi, s in zip(sc.least, sc.most, sc.sums, strict=True))
    kind, suffix = ("BIGINT", "L") if far < 1 << 63 else ("DECIMAL(38,0)", "BD")
    off = ", ".join(f"{s}{suffix}" for s in sc.sums)
    square = f"aggregate(zip_with(x, array({off}), (a, s) -> CAST(CAST({sc.n}{suffix} * a - s AS {kind}) * CAST({sc.n}{suffix} * a - s AS {kind}) AS {kind})), CAST(0 AS {kind}), (t, v) -> CAST(t + v AS {kind}))"
    own = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
    kept = [c for c in vectors.columns if c not in (*own, "x", "_away", "_cell")]
    if not dims:
        return vectors.select(*kept).limit(0).selectExpr(
            *(f"`{c}`" for c in kept), "CAST(NULL AS INT) AS component", "CAST(NULL AS BIGINT) AS n", "CAST(NULL AS BIGINT) AS deviation",
            "CAST(NULL AS DOUBLE) AS whitened", "CAST(NULL AS DOUBLE) AS explained", "CAST(NULL AS DOUBLE) AS identity_error")
    cells = ", ".join(f"struct({k + 1} AS component, {w} AS whitened, {explained[k]!r}D AS explained)" for k, w in enumerate(white))
    out = rows.select(*(F.col(f"`{c}`") for c in kept), "x", F.expr(away).alias("_away"))  # computed once a row, used for every component
    out = out.select(*(F.col(f"`{c}`") for c in kept), F.expr(square).alias("deviation"), F.explode(F.expr(f"array({cells})")).alias("_cell"))
    return out.selectExpr(*(f"`{c}`" for c in kept), "_cell.component AS component", f"{sc.n}L AS n", "deviation",
                          "_cell.whitened AS whitened", "_cell.explained AS explained", f"{error!r}D AS identity_error")


def _identity_error(away: DataFrame, white: list[str]) -> float:
    """Largest entry of |covariance of the whitened fit list - identity|."""
    if not white:
        return 0.0
    w = away.selectExpr(*(f"{x} AS w{i}" for i, x in enumerate(white)))
    mean = w.agg(*(F.avg(f"w{i}").alias(f"w{i}") for i in range(len(white)))).first()
    pairs = [(i, j) for i in range(len(white)) for j in range(i + 1)]
    cov = w.agg(*(F.avg((F.col(f"w{i}") - mean[i]) * (F.col(f"w{j}") - mean[j])).alias(f"c{i}_{j}") for i, j in pairs)).first()
    return float(max(abs(c - (i == j)) for c, (i, j) in zip(cov, pairs, strict=True)))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over the whole ``embeddings`` table."""
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return whiten(spark, vectors).selectExpr("CAST(vec_id AS BIGINT) AS vec_id", "component", "n", "try_cast(deviation AS BIGINT) AS deviation",
                                             "whitened", "explained", "identity_error")
