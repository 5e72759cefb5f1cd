"""Whitening of embeddings over a covariance that is computed in tiles.

Entries become whole numbers (``floor(64 c) + 1000000``), so sums and products over any number of vectors are exact and do
not depend on the order of tasks. The fit list holds each distinct vector once. Its rows are cut into row blocks, and these
into column blocks, which meet by row block in one shuffle; every pair of them gives a part of one tile of the covariance,
and parts are summed per tile, with partial sums before their shuffle. The driver sees one covariance matrix.

Centred before multiplying: entries are taken relative to the whole number nearest to their mean, which keeps products
exact; what is left of the mean, at most one half, is taken off the covariance.

Defined cases: rows whose vector is null, empty or holds a null or non-finite entry give nothing; rows with a null id or a
repeated one give their own rows. Vectors of another width are a space of their own. Entries beyond 2**46 count as 2**46.
A component without variance has explained 0 (null where no component has any) and no whitened value (null). A deviation
beyond 63 bits is null. An empty table gives no rows. Columns other than the two named ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import map_slices, materialise, slices

SCALE, SHIFT, FARTHEST = 64, 1_000_000, float(1 << 46)
COMPONENTS = 16
#: Rows of a row block: so many, or so many for each dimension, so that the parts of its tiles are smaller than itself.
BLOCK_ROWS, BLOCK_ROWS_PER_DIMENSION = 2048, 8
#: Columns of a column block: at least so many, and enough that there are at most so many blocks.
TILE_LEAST, TILE_BLOCKS = 32, 16
#: Rows whose sums fit 64 bits whatever the entries are.
SAFE_ROWS = 1024


@dataclass
class Model:
    """n vectors with sums ``total``; one column of ``axes`` and one entry of ``values`` and ``explained`` a component."""

    n: int
    total: list[int]
    axes: np.ndarray
    values: np.ndarray
    explained: list[float | None]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less the mean: the mean's whole part is taken off exactly, so only its fraction is rounded."""
        whole, rest = zip(*(divmod(s, self.n) for s in self.total), strict=True)
        return (x - np.array(whole)).astype(float) - np.array([r / self.n for r in rest])

    def whiten(self, centred: np.ndarray) -> np.ndarray:
        """NaN on components without variance."""
        return centred @ self.axes / np.sqrt(np.where(self.values > 0, self.values, np.nan))

    def deviations(self, x: np.ndarray, centred: np.ndarray) -> list[int | None]:
        """Sums of (n x - total)**2. Sums that fit 63 bits are exact in arithmetic that wraps at 64."""
        apart = x * np.int64(self.n) - np.array([s % (1 << 64) for s in self.total], np.uint64).view(np.int64)
        wrapped, size = (apart * apart).sum(axis=1).tolist(), ((self.n * centred) ** 2).sum(axis=1) / 2.0**63
        exact = lambda row: sum((self.n * v - s) ** 2 for v, s in zip(row.tolist(), self.total, strict=True))
        close = {i: exact(x[i]) for i in np.flatnonzero(np.abs(size - 1) < 1e-6).tolist()}
        return [(v if v < 1 << 63 else None) if (v := close.get(i)) is not None else wrapped[i] if size[i] < 1 else None for i in range(len(x))]


def _usable(vector: Column) -> Column:
    odd = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~odd, F.lit(False))


def whole_vectors(rows: DataFrame, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """vec_id, width, x (little-endian 64-bit integers) of every row that takes part."""
    own = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")).where(_usable(F.col("vector")))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column("vector")
        ends = lists.offsets.to_numpy()
        entries = np.clip(lists.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]].astype(float), -FARTHEST, FARTHEST)
        raw, at = (np.floor(SCALE * entries).astype("<i8") + SHIFT).tobytes(), (8 * (ends - ends[0])).tolist()
        packed = [raw[a:b] for a, b in zip(at, at[1:], strict=False)]
        return pa.record_batch({"vec_id": batch.column("vec_id"), "width": pa.array(np.diff(ends), pa.int32()), "x": pa.array(packed, pa.binary())})

    return map_slices(own, run, "vec_id long, width int, x binary", 4096)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, width)


def sums(fit: DataFrame, width: int) -> tuple[int, list[int], list[int], list[int]]:
    """n, and each dimension's sum, least and largest entry."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = _matrix(batch.column("x"), width)
        found = {"sum": x.sum(axis=0), "least": x.min(axis=0), "most": x.max(axis=0)} if len(x) else dict.fromkeys(("sum", "least", "most"), np.zeros(0, np.int64))
        size = width if len(x) else 0
        return pa.record_batch({"d": pa.array(np.arange(size), pa.int32()), "n": pa.array(np.full(size, len(x)))} | {k: pa.array(v) for k, v in found.items()})

    part = map_slices(fit.select("x"), run, "d int, n long, sum long, least long, most long", SAFE_ROWS)
    rows = sorted(part.groupBy("d").agg(F.sum("n"), F.sum(F.col("sum").cast("decimal(20,0)")), F.min("least"), F.max("most")).collect())  # a row a dimension
    return rows[0][1], [int(r[2]) for r in rows], [r[3] for r in rows], [r[4] for r in rows]


def column_blocks(fit: DataFrame, width: int, middle: np.ndarray, tile: int) -> DataFrame:
    """row_block, col_block, data: entries less ``middle``, row by row."""
    most = max(BLOCK_ROWS, BLOCK_ROWS_PER_DIMENSION * width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in slices(batches, most):
            x = _matrix(batch.column("x"), width) - middle
            pieces = [np.ascontiguousarray(x[:, at : at + tile]).tobytes() for at in range(0, width, tile)]
            yield pa.record_batch({"row_block": pa.array(np.full(len(pieces), block)), "col_block": pa.array(np.arange(len(pieces)), pa.int32()), "data": pa.array(pieces, pa.binary())})
            block += 1

    return fit.select("x").mapInArrow(run, "row_block long, col_block int, data binary")


def product(a: np.ndarray, b: np.ndarray, peak: int) -> np.ndarray:
    """a' b of integers no larger than ``peak``: in doubles over as many rows as keep it exact, then in 64 bits."""
    rows = max(1, (1 << 53) // max(1, peak * peak))
    parts = (a[at : at + rows].astype(float).T @ b[at : at + rows].astype(float) for at in range(0, len(a), rows))
    return sum(p.astype(np.int64) for p in parts) if peak * peak < 1 << 53 else sum(parts)


def covariance(fit: DataFrame, width: int, n: int, total: list[int], least: list[int], most: list[int], tile: int | None = None) -> np.ndarray:
    tile = tile or max(TILE_LEAST, -(-width // TILE_BLOCKS))
    middle = [(2 * s + n) // (2 * n) for s in total]
    peak = max(max(h - m, m - lo) for lo, h, m in zip(least, most, middle, strict=True))
    kind = "long" if n * peak * peak < 1 << 62 else "double"

    def multiply(data: pa.Table) -> pa.Table:
        blocks = {j: np.frombuffer(raw, "<i8") for j, raw in zip(data.column("col_block").to_pylist(), data.column("data").to_pylist(), strict=True)}
        columns = {j: raw.reshape(-1, min(tile, width - j * tile)) for j, raw in blocks.items()}
        pairs = list(combinations_with_replacement(sorted(columns), 2))
        made = [product(columns[i], columns[j], peak).ravel().tolist() for i, j in pairs]
        return pa.table({"i": pa.array([p[0] for p in pairs], pa.int32()), "j": pa.array([p[1] for p in pairs], pa.int32()), "part": pa.array(made, pa.list_(pa.int64() if kind == "long" else pa.float64()))})

    parts = column_blocks(fit, width, np.array(middle), tile).groupBy("row_block").applyInArrow(multiply, f"i int, j int, part array<{kind}>")
    found = parts.select("i", "j", F.posexplode("part").alias("at", "v")).groupBy("i", "j", "at").agg(F.sum("v").alias("v")).toArrow()  # width**2 numbers
    i, j, at, v = (found.column(c).to_numpy() for c in ("i", "j", "at", "v"))
    across = np.minimum(tile, width - j * tile)
    row, col = i * tile + at // across, j * tile + at % across
    left = np.array([(s - m * n) / n for s, m in zip(total, middle, strict=True)])
    made = np.empty((width, width))
    made[row, col] = made[col, row] = v / n - left[row] * left[col]
    return made


def fitted(fit: DataFrame, width: int, components: int = COMPONENTS, tile: int | None = None) -> Model:
    n, total, least, most = sums(fit, width)
    v = covariance(fit, width, n, total, least, most, tile)
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    values = np.where(values > max(values[0], 0) * width * 2.0**-50, values, 0.0)
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])] < 0, -1, 1)
    trace = float(np.trace(v))
    return Model(n, total, axes, values, [float(e) / trace if trace > 0 else None for e in values])


def identity_error(fit: DataFrame, width: int, model: Model) -> float | None:
    """Largest absolute entry of the whitened fit list's covariance minus the identity, over components with variance."""
    own = np.flatnonzero(model.values > 0)
    if not len(own):
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((len(own), len(own) + 1))
        for batch in slices(batches, 4096):
            w = model.whiten(model.centred(_matrix(batch.column("x"), width)))[:, own]
            found += np.column_stack([w.T @ w, w.sum(axis=0)])
        yield pa.record_batch({"part": pa.array([found.ravel().tolist()], pa.list_(pa.float64()))})

    parts = fit.select("x").mapInArrow(run, "part array<double>").select(F.posexplode("part").alias("at", "v"))
    rows = sorted(parts.groupBy("at").agg(F.sum("v")).collect())
    found = np.array([r[1] for r in rows]).reshape(len(own), -1) / model.n
    mean = found[:, -1]
    return float(np.abs(found[:, :-1] - np.outer(mean, mean) - np.eye(len(own))).max())


def whiten(rows: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", components: int = COMPONENTS, tile: int | None = None) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of each row and component up to ``components``."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    whole = whole_vectors(rows, vector, vec_id)
    fits = materialise(whole.select("width", "x").distinct(), "whitening-fit")
    out = rows.sparkSession.createDataFrame([], schema)
    for width in sorted(r.width for r in fits.select("width").distinct().collect()):
        fit = fits.where(F.col("width") == width)
        model = fitted(fit, width, components, tile)
        error = identity_error(fit, width, model)

        def run(batch: pa.RecordBatch, width: int = width, model: Model = model, error: float | None = error) -> pa.RecordBatch:
            x = _matrix(batch.column("x"), width)
            centred, k = model.centred(x), len(model.values)
            white = model.whiten(centred).ravel()
            repeat = lambda c: c.take(pa.array(np.repeat(np.arange(len(x)), k)))
            return pa.record_batch({
                "vec_id": repeat(batch.column("vec_id")), "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), "n": pa.array(np.full(len(white), model.n)), "deviation": repeat(pa.array(model.deviations(x, centred), pa.int64())),
                "whitened": pa.array(white, mask=np.isnan(white)), "explained": pa.array(model.explained * len(x), pa.float64()), "identity_error": pa.array([error] * len(white), pa.float64()),
            })

        out = out.unionByName(map_slices(whole.where(F.col("width") == width), run, schema, 4096))
    return out


def op13(rows: DataFrame) -> DataFrame:
    return whiten(rows)
