"""Exact interpolated quantiles that never gather a column in one task."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.session import materialize

# Rank error of a sketch is one part in this many.
_ACCURACY = 10_000
_MARGIN = 3 / _ACCURACY
# By default, brackets of up to this many values are sorted.
_SMALL = 10 * _ACCURACY


def melt(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long form ``column, value`` of numeric columns, nulls and NaN left out."""
    entries = [
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns
    ]
    value = F.col("value")
    return df.select(F.inline(F.array(*entries))).where(value.isNotNull() & ~F.isnan(value))


@dataclass
class _Bracket:
    """Where the value of one rank lies: among ``size`` values from ``low`` to ``high``, ``rank`` places after ``low``."""

    column: int
    rank: int
    low: float
    high: float
    size: int

    @property
    def found(self) -> bool:
        return self.low == self.high

    def key(self) -> tuple[int, float, float]:
        return self.column, self.low, self.high

    def inside(self) -> Column:
        return F.col(f"c{self.column}").between(F.lit(self.low), F.lit(self.high))


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], *, small_rows: int = _SMALL
) -> DataFrame:
    """Quantiles with linear interpolation: ``column, prob, value``; none for a column without values.

    Every wanted rank has a bracket of values around it, at first its whole column. A
    pass sketches all brackets, another counts what lies below, between and above the
    two values the sketch gives for each; the part with the rank is the next bracket,
    some thousandth of the last. Brackets of at most ``small_rows`` values are sorted
    and read. A pass is one row of sums, so no task sees more than a bracket's worth
    of values, however many a column has and whatever value repeats. The columns are
    written once, as each pass reads them again; the driver holds the brackets.
    """
    names = [f"c{i}" for i in range(len(columns))]
    numbers = [F.col(f"`{c}`").cast("double") for c in columns]
    values = materialize(df.select(*[F.when(~F.isnan(v), v).alias(n) for v, n in zip(numbers, names)]))
    first = values.agg(*[f(n).alias(f"{n}_{k}") for n in names for k, f in enumerate((F.count, F.min, F.max))]).first()
    brackets: dict[tuple[int, int], _Bracket] = {}
    wanted = []
    for i, (name, column) in enumerate(zip(names, columns)):
        n, low, high = (first[f"{name}_{k}"] for k in range(3))
        for p in probs if n else ():
            position = float(p) * (n - 1)
            ends = math.floor(position), math.ceil(position)
            wanted.append((column, float(p), position, [(i, k) for k in ends]))
            for k in ends:
                brackets.setdefault((i, k), _Bracket(i, k, low + 0.0, high + 0.0, n))
    while True:
        wide = [b for b in brackets.values() if not b.found and b.size > small_rows]
        if not wide:
            break
        _narrow(values, wide)
    _read_ranks(values, [b for b in brackets.values() if not b.found])
    rows = []
    for column, p, position, ends in wanted:
        low, high = (brackets[e].low for e in ends)
        rows.append((column, p, low + (high - low) * (position - math.floor(position))))
    return df.sparkSession.createDataFrame(rows, "column string, prob double, value double")


def _narrow(values: DataFrame, brackets: list[_Bracket]) -> None:
    """One step of all brackets: cut each at two values near its rank and keep the part that holds it."""
    cuts = []
    for i, b in enumerate(brackets):
        at = (b.rank + 0.5) / b.size
        near = [max(at - _MARGIN, 0.0), min(at + _MARGIN, 1.0)]
        cuts.append(F.percentile_approx(F.when(b.inside(), F.col(f"c{b.column}")), near, _ACCURACY).alias(f"p{i}"))
    pairs = list(values.agg(*cuts).first())
    sums = []
    for i, (b, (low, high)) in enumerate(zip(brackets, pairs)):
        v, inside = F.col(f"c{b.column}"), b.inside()
        parts = [v < low, v == low, (v > low) & (v < high), (v == high) & F.lit(high > low), v > high]
        sums += [F.count(F.when(inside & part, 1)).alias(f"n{i}_{k}") for k, part in enumerate(parts)]
        for k in (0, 2, 4):
            sums += [f(F.when(inside & parts[k], v)).alias(f"{name}{i}_{k}") for name, f in (("min", F.min), ("max", F.max))]
    row = values.agg(*sums).first()
    for i, (b, (low, high)) in enumerate(zip(brackets, pairs)):
        for k in range(5):
            count = row[f"n{i}_{k}"]
            if b.rank < count:
                break
            b.rank -= count
        b.size = count
        b.low, b.high = {1: (low, low), 3: (high, high)}.get(k) or (row[f"min{i}_{k}"], row[f"max{i}_{k}"])


def _read_ranks(values: DataFrame, brackets: list[_Bracket]) -> None:
    """Sort the values of small brackets and read their ranks; brackets of the same values share one list."""
    by_key: dict[tuple, list[_Bracket]] = {}
    for b in brackets:
        by_key.setdefault(b.key(), []).append(b)
    reads = []
    for same in by_key.values():
        ordered = F.sort_array(F.collect_list(F.when(same[0].inside(), F.col(f"c{same[0].column}"))))
        reads.append(F.transform(F.array(*[F.lit(b.rank) for b in same]), _reader(ordered)))
    if not reads:
        return
    # lists of at most ``small_rows`` values are put together, a few numbers come back
    for same, found in zip(by_key.values(), values.agg(*[r.alias(f"r{i}") for i, r in enumerate(reads)]).first()):
        for b, value in zip(same, found):
            b.low = b.high = value


def _reader(ordered: Column) -> Callable[[Column], Column]:
    return lambda at: F.get(ordered, at)


def quantile_row(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """One row with a struct per column: fields ``q0, q1, ...``; null where no values."""
    long = exact_quantiles(df, columns, probs)
    return long.agg(
        *[
            F.struct(
                *[
                    F.max(
                        F.when((F.col("column") == c) & (F.col("prob") == float(p)), F.col("value"))
                    ).alias(f"q{i}")
                    for i, p in enumerate(probs)
                ]
            ).alias(c)
            for c in columns
        ]
    )
