"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Entries become integers (``floor(scale * entry)``), so counts and sums are exact.  The fit list
holds each distinct integer vector once, as blocks of rows in a stored table.  With X the centred
rows of that list, each step takes two passes over the blocks:

- ``p = X v`` for the newest right vector, and ``h = U' p`` with all left vectors so far,
- ``p - U h``, whose products with X' and U' give the next right vector and what is left to correct.

Left vectors are as long as the list and are never stored: a left vector is X times a short vector
of coefficients, so each task makes its rows of U from its own rows of X.  Tasks return one short
row of sums; there are at most ``TASKS_PER_CORE`` tasks for each core of the cluster, so what comes
to the driver is bounded by the cluster and the dimension, not by the rows.  Both sides are
reorthogonalised against all earlier vectors twice.  The recurrence runs through all dimensions (a
new orthogonal vector is taken where it breaks down), so equal eigenvalues are not missed; the
singular values and right vectors of the small bidiagonal matrix are the deviations and components.

Defined results: rows whose vector is null, or holds nulls, NaN or infinities, are dropped; so are
vectors of another length than the most frequent one (of equally frequent ones, the longer).  Entries
beyond ``LIMIT`` after scaling count as that limit.  Repeated rows are fitted once and each returned.
Components whose deviation is 0, as far as double precision tells, are left out, so one distinct vector,
like an empty table, gives no rows.  A null key is returned as such; other input columns are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podspark.llm.common import stored

SCALE = 256
COMPONENTS = 4
#: Integers up to this are exact as doubles, and a block's sums of them exact as 64-bit integers.
LIMIT = 1 << 53
BLOCK_BYTES = 1 << 20
BLOCK_ROWS = 512
TASKS_PER_CORE = 2
#: Deviations and steps of the recurrence below this part of the largest count as 0.
ZERO = 1e-12
SEED = 20


@dataclass(frozen=True)
class Whitening:
    """What was fitted: exact counts and sums, components as columns, their eigenvalues, and the bidiagonal matrix."""

    dim: int
    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float
    diagonal: np.ndarray
    above: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def _whole(values: np.ndarray, scale: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(values * scale), -LIMIT, LIMIT).astype(np.int64)


def _packed(x: np.ndarray) -> list[bytes]:
    """Rows of integers as bytes; the width of an integer depends on the row alone, so equal rows have equal bytes."""
    narrow = (np.abs(x) < 1 << 15).all(axis=1)
    short = x.astype("<i2")
    return [short[k].tobytes() if narrow[k] else x[k].astype("<i8").tobytes() for k in range(len(x))]


def _unpacked(rows: list[bytes], dim: int) -> np.ndarray:
    if all(len(r) == 2 * dim for r in rows):
        return np.frombuffer(b"".join(rows), "<i2").reshape(len(rows), dim).astype(np.int64)
    return np.array([np.frombuffer(r, "<i2" if len(r) == 2 * dim else "<i8") for r in rows], np.int64).reshape(len(rows), dim)


def integers(df: DataFrame, key: str, vector: str, scale: int = SCALE) -> DataFrame:
    """Rows (key, dim, x) of the vectors that hold finite numbers only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, dims, packed = [], [], []
            column = batch.column("vector")
            lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            values = column.flatten()
            flat = np.asarray(values.cast(pa.float64()).fill_null(np.nan), np.float64)
            ends = np.cumsum(lengths)
            for dim in np.unique(lengths[lengths > 0]).tolist():
                mine = np.flatnonzero(lengths == dim)
                rows = flat[(ends[mine] - dim)[:, None] + np.arange(dim)]
                good = np.isfinite(rows).all(axis=1)
                keep += mine[good].tolist()
                dims += [dim] * int(good.sum())
                packed += _packed(_whole(rows[good], scale))
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(keep, pa.int64())), pa.array(dims, pa.int32()), pa.array(packed, pa.binary())], ["key", "dim", "x"])

    asked = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").cast("array<double>").alias("vector")).filter("vector is not null")
    return asked.mapInArrow(run, asked.select("key").schema.add("dim", "integer").add("x", "binary"))


def _blocks(rows: DataFrame, dim: int) -> DataFrame:
    """Each distinct vector once, many to a block of bytes."""
    size = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * dim)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, size):
                x = _unpacked(batch.column("x").slice(lo, size).to_pylist(), dim)
                yield pa.RecordBatch.from_arrays([pa.array([x.astype("<i8").tobytes()], pa.binary())], ["block"])

    return stored(rows.select("x").distinct().mapInArrow(run, "block binary"))


def _summed(blocks: DataFrame, dim: int, part: Callable[[np.ndarray], list]) -> list:
    """Sums over all blocks of the short lists that ``part`` makes of a block of integer rows; one row comes from each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for raw in batch.column("block").to_pylist():
                now = part(np.frombuffer(raw, "<i8").reshape(-1, dim))
                total = now if total is None else [a + b for a, b in zip(total, now, strict=True)]
        if total is not None:
            # Exact sums are whole numbers of any size and travel as text, others as doubles.
            whole = isinstance(total[0], int)
            out = [pa.array([[str(v) for v in total] if whole else None], pa.list_(pa.string())), pa.array([None if whole else np.concatenate([np.ravel(v) for v in total])], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(out, ["whole", "real"])

    rows = blocks.mapInArrow(run, "whole array<string>, real array<double>").collect()
    if not rows:
        return []
    if rows[0].whole is not None:
        return [sum(map(int, column)) for column in zip(*(r.whole for r in rows), strict=True)]
    return np.sum(np.array([r.real for r in rows]), axis=0)


def _counts(x: np.ndarray) -> list[int]:
    """Rows, sum of squares, sums by dimension; exact."""
    squares = int((x.astype(object) ** 2).sum()) if np.abs(x).max() >= 1 << 20 else int((x * x).sum())
    return [len(x), squares, *map(int, x.sum(axis=0))]


def _away(vector: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The vector without its parts along the columns of ``basis``, taken off twice."""
    for _ in range(2):
        vector = vector - basis @ (basis.T @ vector)
    return vector


def bidiagonalise(blocks: DataFrame, dim: int, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal and right vectors (as columns) of the centred rows, through all dimensions."""
    rng = np.random.default_rng(SEED)
    right, made = np.zeros((dim, dim)), np.zeros((dim, dim))  # made: left vectors are X @ made
    diagonal, above = np.zeros(dim), np.zeros(dim)

    def new(k: int) -> np.ndarray:
        v = _away(rng.standard_normal(dim), right[:, :k])
        return v / np.linalg.norm(v)

    right[:, 0] = new(0)
    for k in range(dim):
        v, w = right[:, k], made[:, :k]

        def first(x: np.ndarray, v=v, w=w) -> list:
            x = x - mean
            return [(x @ w).T @ (x @ v), np.zeros(1)]

        h = _summed(blocks, dim, first)[:k]

        def second(x: np.ndarray, v=v, w=w, h=h) -> list:
            x = x - mean
            u = x @ w
            p = x @ v - u @ h
            return [u.T @ p, x.T @ p, np.array([p @ p])]

        out = _summed(blocks, dim, second)
        rest, product, square = out[:k], out[k : k + dim], out[-1]
        scale = max(diagonal.max(), above.max(), np.sqrt(max(square, 0.0)))
        alpha = np.sqrt(max(square - rest @ rest, 0.0))
        r = np.zeros(dim)
        if alpha > ZERO * scale:
            diagonal[k] = alpha
            made[:, k] = (v - w @ (h + rest)) / alpha
            # X' applied to the correction of p is made of the products of the earlier left vectors.
            along = np.zeros(dim)
            if k:
                along = right[:, :k] @ (diagonal[:k] * rest) + right[:, 1 : k + 1] @ (above[:k] * rest)
            r = _away((product - along) / alpha - alpha * v, right[:, : k + 1])
        if k + 1 < dim:
            beta = np.linalg.norm(r)
            if beta > ZERO * scale:
                above[k] = beta
                right[:, k + 1] = r / beta
            else:
                right[:, k + 1] = new(k + 1)
    return diagonal, above, right


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of packed rows (see ``integers``); None if there are none.  ``rows`` is read more than once and should be stored."""
    common = rows.groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    if not common:
        return None
    dim = common[0]["dim"]
    blocks = _blocks(rows.filter(F.col("dim") == dim), dim)
    blocks = blocks.coalesce(TASKS_PER_CORE * blocks.sparkSession.sparkContext.defaultParallelism).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n, squares, *sums = _summed(blocks, dim, _counts)
        mean = np.array([s / n for s in sums])
        diagonal, above, right = bidiagonalise(blocks, dim, mean)
        _, deviations, turned = np.linalg.svd(np.diag(diagonal) + np.diag(above[:-1], 1))
        kept = min(components, int((deviations > ZERO * max(deviations[0], 1e-300)).sum()))
        axes = right @ turned[:kept].T
        axes = axes / np.linalg.norm(axes, axis=0)
        axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(kept)]) if kept else axes
        eigenvalues = deviations[:kept] ** 2 / n

        def spread(x: np.ndarray) -> list:
            y = (x - mean) @ axes / np.sqrt(eigenvalues)
            return [y.sum(axis=0), y.T @ y]

        error = 0.0
        if kept:
            out = _summed(blocks, dim, spread) / n
            error = float(np.abs(out[kept:].reshape(kept, kept) - np.outer(out[:kept], out[:kept]) - np.eye(kept)).max())
    finally:
        blocks.unpersist()
    trace = (n * squares - sum(s * s for s in sums)) / (n * n)
    return Whitening(dim, n, tuple(sums), axes, eigenvalues, trace, error, diagonal, above)


def _deviations(x: np.ndarray, model: Whitening) -> list[Decimal | None]:
    """Sum over dimensions of (n * x - sum)^2, exact; None beyond 38 digits."""
    most = max(model.n * int(np.abs(x).max(initial=0)), 1) + max(map(abs, model.sums))
    if most * most * model.dim < 1 << 62:
        apart = model.n * x - np.array(model.sums, np.int64)
        found = (apart * apart).sum(axis=1).tolist()
    else:
        apart = model.n * x.astype(object) - np.array(model.sums, object)
        found = (apart * apart).sum(axis=1).tolist()
    return [Decimal(int(v)) if v < 10**38 else None for v in found]


def apply(rows: DataFrame, model: Whitening) -> DataFrame:
    """For each packed row and component: key, component (from 1), deviation decimal(38,0), whitened."""
    axes, mean, count = model.components / np.sqrt(model.eigenvalues), model.mean, len(model.eigenvalues)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not count:
                continue
            x = _unpacked(batch.column("x").to_pylist(), model.dim)
            twice = pa.array(np.repeat(np.arange(len(x)), count))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key").take(twice),
                    pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))),
                    pa.array(_deviations(x, model), pa.decimal128(38, 0)).take(twice),
                    pa.array(((x - mean) @ axes).ravel()),
                ],
                ["key", "component", "deviation", "whitened"],
            )

    schema = rows.select("key").schema.add("component", "integer").add("deviation", "decimal(38,0)").add("whitened", "double")
    return rows.filter(F.col("dim") == model.dim).select("key", "x").mapInArrow(run, schema)


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """Per row with a usable vector and per component: key, component, n, deviation, whitened, explained, identity_error."""
    rows = stored(integers(df, key, vector, scale))
    model = fit(rows, components)
    explained = F.lit(None).cast("double")
    if model is None or not len(model.eigenvalues):
        found = rows.limit(0).select("key", F.lit(1).alias("component"), F.lit(None).cast("decimal(38,0)").alias("deviation"), explained.alias("whitened"))
    else:
        found = apply(rows, model)
        explained = F.element_at(F.array(*(F.lit(float(e / model.trace)) for e in model.eigenvalues)), F.col("component"))
    return found.select(
        F.col("key").alias(key),
        "component",
        F.lit(model.n if model else 0).cast("long").alias("n"),
        "deviation",
        "whitened",
        explained.alias("explained"),
        F.lit(model.identity_error if model else 0.0).alias("identity_error"),
    )
