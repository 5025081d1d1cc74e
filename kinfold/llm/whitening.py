"""Whitening of embeddings from polarised variances.

Every component c becomes the integer floor(1024 c) + 100000. All sums are exact:
integers of any length on the driver, limbs of 40 bits on the way there. A first
pass gives the sum of every dimension. A second one centres the integers at the
floor of their means and adds up the square of every dimension and of the sum of
every two dimensions. With the remainders of the means put back, these are the
exact squared centred values, and

    2 cov(i, j) = var(i + j) - var(i) - var(j)

gives all cross-covariances, rounded once, for the eigenvectors. What reaches the
driver is set by the number of dimensions alone.
"""

from __future__ import annotations

import decimal
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.blocks import bound_batches
from kinfold.session import materialize

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
LIMB_BITS, LIMBS = 40, 5
_LIMIT = 1 << 61  # integers beyond it stand at it, so that they fit a long
_EXACT = 1 << 53
_RANK = 1e-12  # eigenvalues below this share of the trace belong to dimensions without variance


def limbs(value: int) -> list[int]:
    """A non-negative or negative integer as signed limbs whose sums over many tasks fit a long."""
    sign, rest = (-1, -value) if value < 0 else (1, value)
    return [sign * (rest >> (LIMB_BITS * k) & ((1 << LIMB_BITS) - 1)) for k in range(LIMBS)]


def from_limbs(parts) -> int:
    return sum(int(x) << (LIMB_BITS * k) for k, x in enumerate(parts))


_LIMB_SCHEMA = ", ".join(f"l{k} long" for k in range(LIMBS))


def _limb_sums() -> list:
    return [F.sum(f"l{k}").alias(f"l{k}") for k in range(LIMBS)]


def to_integers(values: np.ndarray) -> np.ndarray:
    """floor(1024 c) + 100000 of finite doubles, exact below 2^53 and standing at +-2^61 beyond."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values * SCALE)
    return np.clip(scaled, -_LIMIT, _LIMIT).astype(np.int64) + SHIFT


def vectors_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows that hold a whole finite vector, where each begins in the flat values, and these values."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become nan
    starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    odd = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
    rows = np.flatnonzero((lengths > 0) & (odd[starts + lengths] == odd[starts]))
    return rows, starts, flat


def matrix_of(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``column`` that are whole finite vectors of ``size``, and their integers."""
    rows, starts, flat = vectors_of(column)
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    rows = rows[lengths[rows] == size]
    values = flat[starts[rows][:, None] + np.arange(size)]
    return rows, to_integers(values)


def _exact_sum(values: np.ndarray) -> list[int]:
    """Column sums of an integer matrix as Python integers."""
    top = int(np.abs(values).max(initial=0))
    if top * max(1, len(values)) < 1 << 62:
        return [int(x) for x in values.sum(0)]
    return [int(x) for x in values.astype(object).sum(0)]


def _square_sums(centred: np.ndarray) -> Iterator[tuple[int, np.ndarray | list[int]]]:
    """For every dimension i, the sums of squares of i (first) and of i + j for every j > i."""
    top = int(np.abs(centred).max(initial=0))
    fast = 4 * top * top * max(1, len(centred)) < _EXACT  # then doubles add up exactly
    columns = np.ascontiguousarray(centred.T.astype(np.float64 if fast else object))
    for i in range(len(columns)):
        both = columns[i + 1 :] + columns[i]
        if fast:
            yield i, np.concatenate(([columns[i] @ columns[i]], np.einsum("ij,ij->i", both, both))).astype(np.int64)
        else:
            yield i, [int((columns[i] ** 2).sum()), *(int((row**2).sum()) for row in both)]


@dataclass(frozen=True)
class Moments:
    """Exact counts and sums of the fit list: sums by dimension, centred products by pair."""

    n: int
    sums: list[int]
    squares: list[list[int]]  # [i][j - i]: sum over rows of (u_i + u_j)^2 for j > i, of u_i^2 for j = i; u = n x - S

    @property
    def size(self) -> int:
        return len(self.sums)

    def covariance(self) -> np.ndarray:
        """Covariances of the integers, each rounded once from its exact fraction."""
        v = np.zeros((self.size, self.size))
        below = self.n**3
        for i in range(self.size):
            v[i, i] = self.squares[i][0] / below
            for j in range(i + 1, self.size):
                cross = self.squares[i][j - i] - self.squares[i][0] - self.squares[j][0]
                v[i, j] = v[j, i] = cross / (2 * below)
        return v


def moments(vectors: DataFrame, *, vec_col: str = "embedding") -> Moments | None:
    """Exact moments of the usable vectors, or None where there is none.

    Usable: not null or empty, all entries finite, and of the commonest length (of
    equally common ones the longest).
    """
    bound_batches(vectors.sparkSession)
    column = vectors.select(F.col(vec_col).alias("v"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[int, list[int]]] = {}
        for batch in batches:
            rows, starts, flat = vectors_of(batch["v"])
            lengths = batch["v"].value_lengths().fill_null(0).to_numpy(zero_copy_only=False)[rows]
            for size in np.unique(lengths):
                mine = rows[lengths == size]
                own = _exact_sum(to_integers(flat[starts[mine][:, None] + np.arange(size)]))
                n, old = found.get(int(size), (0, [0] * int(size)))
                found[int(size)] = (n + len(mine), [a + b for a, b in zip(old, own)])
        for size, (n, sums) in found.items():
            parts = np.array([limbs(s) for s in sums], np.int64).reshape(size, LIMBS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(size, size)), pa.array(np.arange(size)), pa.array(np.full(size, n)), *map(pa.array, parts.T)],
                ["size", "i", "n", *(f"l{k}" for k in range(LIMBS))],
            )

    schema = f"size long, i long, n long, {_LIMB_SCHEMA}"
    sums = column.mapInArrow(add, schema).groupBy("size", "i").agg(F.sum("n").alias("n"), *_limb_sums())
    sums = materialize(sums)
    chosen = sums.where("i = 0").orderBy(F.desc("n"), F.desc("size")).select("size", "n").first()
    if chosen is None:
        return None
    size, n = chosen
    first = [from_limbs(r[1:]) for r in sorted(sums.where(F.col("size") == size).select("i", *(f"l{k}" for k in range(LIMBS))).collect())]
    middle = np.array([s // n for s in first], np.int64)

    def polarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[list[int]] = [[0] * (size - i) for i in range(size)]
        fast = [np.zeros(size - i, np.int64) for i in range(size)]
        rows_since, seen = 0, False
        for batch in batches:
            rows, x = matrix_of(batch["v"], size)
            for start in range(0, len(rows), 4096):
                centred = x[start : start + 4096] - middle
                seen = True
                for i, sums in _square_sums(centred):
                    if isinstance(sums, np.ndarray) and rows_since < 512:
                        fast[i] += sums  # below 2^53 each, emptied long before 2^62
                    else:
                        total[i] = [a + int(b) for a, b in zip(total[i], sums)]
                rows_since += 1
                if rows_since >= 512:
                    for i in range(size):
                        total[i] = [a + int(b) for a, b in zip(total[i], fast[i])]
                        fast[i][:] = 0
                    rows_since = 0
        if not seen:
            return
        for i in range(size):
            parts = np.array([limbs(a + int(b)) for a, b in zip(total[i], fast[i])], np.int64).reshape(size - i, LIMBS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(size - i, i)), pa.array(np.arange(i, size)), *map(pa.array, parts.T)],
                ["i", "j", *(f"l{k}" for k in range(LIMBS))],
            )

    pairs = column.mapInArrow(polarise, f"i long, j long, {_LIMB_SCHEMA}").groupBy("i", "j").agg(*_limb_sums())
    squares = [[0] * (size - i) for i in range(size)]
    rest = [s - n * int(m) for s, m in zip(first, middle)]
    for i, j, *parts in pairs.collect():  # one row for each two dimensions
        off = rest[i] if i == j else rest[i] + rest[j]
        # u = n d - r with sum(d) = r, so sum(u^2) = n^2 sum(d^2) - n r^2
        squares[i][j - i] = n * n * from_limbs(parts) - n * off * off
    return Moments(n, first, squares)


@dataclass(frozen=True)
class Whitener:
    """The leading components of the fitted covariance, with what is needed to apply them."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray  # eigenvalues of the components, falling
    directions: np.ndarray  # unit eigenvectors, one a column
    trace: float


def fit(vectors: DataFrame, *, vec_col: str = "embedding", components: int = COMPONENTS) -> Whitener | None:
    """Components of the covariance of all usable vectors; None where there are none.

    Components without variance (eigenvalue below 1e-12 of the trace, as in copies
    of one vector, constant dimensions, or fewer rows than dimensions) do not exist.
    Each direction's largest entry is positive.
    """
    found = moments(vectors, vec_col=vec_col)
    if found is None:
        return None
    v = found.covariance()
    values, directions = np.linalg.eigh(v)
    values, directions = values[::-1][:components], directions[:, ::-1][:, :components]
    trace = math.fsum(np.diag(v))
    real = values > _RANK * trace
    values, directions = values[real], directions[:, real]
    if len(values):
        top = np.abs(directions).argmax(0)
        directions = directions * np.sign(directions[top, np.arange(len(values))])
    return Whitener(found.n, tuple(found.sums), values, directions, trace)


def transform(
    vectors: DataFrame, model: Whitener, *, vec_col: str = "embedding", keep: list[str] | None = None
) -> DataFrame:
    """Usable rows with ``deviation`` decimal(38,0) and ``whitened`` array<double>.

    ``deviation`` is the exact sum over dimensions of (n x - S)^2, null beyond 38
    digits. Input columns of these two names give way; others, or those in
    ``keep``, and repeated rows stay. Unusable rows are left out.
    """
    bound_batches(vectors.sparkSession)
    kept = [c for c in vectors.columns if c not in ("deviation", "whitened") and (keep is None or c in keep)]
    rows_in = vectors.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{vec_col}`").alias("__vector"))
    shared = vectors.sparkSession.sparkContext.broadcast(model)  # set by the number of dimensions

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        size = len(m.sums)
        middle = np.array([s // m.n for s in m.sums], np.int64)
        rest = [s - m.n * int(x) for s, x in zip(m.sums, middle)]
        offset = np.array([r / m.n for r in rest])
        turn = m.directions / np.sqrt(m.values)
        for batch in batches:
            rows, x = matrix_of(batch["__vector"], size)
            if not len(rows):
                continue
            d = x - middle
            top = int(np.abs(d).max(initial=0))
            # n^2 sum(d^2) - 2 n sum(d r) + sum(r^2), in longs where every term fits one
            small = m.n * m.n * (top * top + 2 * top + 1) * size < 1 << 62
            if small:
                r = np.array(rest, np.int64)
                deviation = m.n * m.n * (d * d).sum(1) - 2 * m.n * (d @ r) + int((r * r).sum())
                exact = pa.array(deviation).cast(pa.decimal128(19, 0)).cast(pa.decimal128(38, 0))
            else:
                wide, r = d.astype(object), np.array(rest, object)
                deviation = m.n * m.n * (wide * wide).sum(1) - 2 * m.n * (wide * r).sum(1) + (r * r).sum()
                exact = pa.array(
                    [decimal.Decimal(int(v)) if v < 10**38 else None for v in deviation], pa.decimal128(38, 0)
                )
            white = (d - offset) @ turn
            flat = pa.array(white.ravel())
            ends = pa.array(np.arange(0, white.size + 1, max(1, white.shape[1]), dtype=np.int32)) if white.size else None
            lists = pa.ListArray.from_arrays(ends, flat) if ends is not None else pa.array([[]] * len(rows), pa.list_(pa.float64()))
            taken = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*(taken[c] for c in kept), exact, lists], [*kept, "deviation", "whitened"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows_in.select(*[F.col(f"`{c}`") for c in kept]).schema)
    return rows_in.mapInArrow(apply, f"{schema}{', ' if schema else ''}deviation decimal(38,0), whitened array<double>")


def identity_error(whitened: DataFrame, count: int) -> float:
    """Largest absolute entry of the covariance of ``whitened`` minus the identity, measured on its rows."""
    if not count:
        return 0.0
    part = [F.element_at("whitened", k + 1) for k in range(count)]
    pairs = [(a, b) for a in range(count) for b in range(a, count)]
    row = whitened.agg(*[F.covar_pop(part[a], part[b]).alias(f"c{a}_{b}") for a, b in pairs]).first()
    return max((abs(c - (a == b)) for (a, b), c in zip(pairs, row) if c is not None), default=0.0)


def whiten(
    vectors: DataFrame, *, vec_col: str = "embedding", components: int = COMPONENTS, keep: list[str] | None = None
) -> DataFrame:
    """One row for every usable vector and component, fitted on these vectors.

    Returns the columns in ``keep`` and ``component`` (from 1), ``n``, ``deviation``,
    ``whitened``, ``explained`` and ``identity_error``; see ``fit`` and ``transform``
    for null, odd, repeated and degenerate rows. Without any component (no usable
    vector, or no variance) there is no row.
    """
    keep = [c for c in vectors.columns if c != vec_col] if keep is None else keep
    made = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
    keep = [c for c in keep if c not in made]
    model = fit(vectors, vec_col=vec_col, components=components)
    if model is None:
        empty = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.select(*[F.col(f"`{c}`") for c in keep]).schema)
        schema = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
        return vectors.sparkSession.createDataFrame([], f"{empty}{', ' if empty else ''}{schema}")
    table = materialize(transform(vectors, model, vec_col=vec_col, keep=keep))
    error = identity_error(table, len(model.values))
    shares = [float(v / model.trace) for v in model.values]
    exploded = table.select(
        *[F.col(f"`{c}`") for c in keep],
        F.posexplode("whitened").alias("__place", "__value"),
        "deviation",
    )
    return exploded.select(
        *[F.col(f"`{c}`") for c in keep],
        (F.col("__place") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        F.col("__value").alias("whitened"),
        F.element_at(F.array(*[F.lit(s) for s in shares] or [F.lit(0.0)]), F.col("__place") + 1).alias("explained"),
        F.lit(float(error)).alias("identity_error"),
    )
