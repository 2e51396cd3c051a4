"""Aggregate measures with results that do not depend on row order.

Doubles with a known number of decimals are summed as two whole numbers per value, the multiple of
1024 below it and the decimal units above that, plus the remainder of each value, which is exactly
zero for values that keep to those decimals. Unlike a sum of doubles the result is the same for
every partitioning, retry and task order; unlike a decimal sum the buffers are primitives and stay
in generated code. The two sums are joined as decimals at the end. They hold totals up to 9e21
and 9e11 rows; what does not fit raises an error, with ANSI arithmetic or without. Infinities and
NaN go through the remainder.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

_LIMB = "1024D"
_LIMIT = "9e21D"
_TOO_LARGE = "raise_error('a sum of money or hours exceeds 9e21')"


@dataclass(frozen=True)
class Measure:
    """One aggregate over one column: ``rows``, ``count``, ``sum`` or ``mean``.

    ``decimals`` marks a double column and its decimals; None marks an integer column.
    ``only`` names a 0/1 column: rows where it is not 1 are left out.
    """

    how: str
    column: str | None = None
    decimals: int | None = None
    only: str | None = None

    @property
    def name(self) -> str:
        return "_".join(part for part in (self.how, self.only, self.column) if part)

    @property
    def source_columns(self) -> set[str]:
        return {name for name in (self.column, self.only) if name}

    @property
    def whole(self) -> bool:
        """Whether the result is an integer."""
        return self.how in ("rows", "count") or (self.how == "sum" and self.decimals is None)

    @property
    def _stem(self) -> str:
        return f"{self.only}__{self.column}" if self.only else self.column

    def inputs(self) -> dict[str, str]:
        """Expressions to project before grouping, so that they are computed once per row."""
        if self.how == "rows":
            return {}
        value = f"CASE WHEN {self.only} = 1 THEN {self.column} END" if self.only else self.column
        if self.how == "count" or self.decimals is None:
            return {self._stem: value}
        factor = f"{10**self.decimals}D"
        fits = f"abs({value}) < {_LIMIT}"
        present = f"{self.column} IS NOT NULL{self._kept}"
        high = f"floor(({value}) / {_LIMB})"
        low = f"rint((({value}) - {high} * {_LIMB}) * {factor})"
        too_large = f"if(abs({value}) < double('inf'), CAST({_TOO_LARGE} AS BIGINT), 0L)"
        return {
            f"{self._stem}__high": f"CASE WHEN {fits} THEN {high} WHEN {present} THEN {too_large} END",
            f"{self._stem}__low": f"CASE WHEN {fits} THEN CAST({low} AS BIGINT) WHEN {present} THEN 0L END",
            # Up to 2**53 units both parts join without rounding, so a value with the declared decimals leaves 0.
            f"{self._stem}__rest": f"CASE WHEN abs({value}) < {2**52 // 10**self.decimals}D "
            f"THEN ({value}) - ({high} * {_LIMB} * {factor} + {low}) / {factor} "
            f"WHEN {fits} THEN (({value}) - {high} * {_LIMB}) - {low} / {factor} ELSE {value} END",
        }

    @property
    def _kept(self) -> str:
        return f" AND {self.only} = 1" if self.only else ""

    def combine(self) -> str:
        """The aggregate over the projected inputs."""
        if self.how == "rows":
            return "count(1)"
        if self.how == "count":
            return f"count({self._stem})"
        if self.decimals is None:
            total, present, nothing = f"sum({self._stem})", f"count({self._stem})", "0L"
        else:
            high, low, rest = (f"{self._stem}__{part}" for part in ("high", "low", "rest"))
            scale = 1024 * 10**self.decimals
            units = f"CAST(try_sum({high}) AS DECIMAL(20, 0)) * CAST({scale} AS DECIMAL(10, 0)) + try_sum({low})"
            whole = f"CASE WHEN count({low}) > 0 THEN coalesce(CAST({units} AS DOUBLE), CAST({_TOO_LARGE} AS DOUBLE)) END"
            total = f"({whole} / {10**self.decimals}D + sum({rest}))"
            present, nothing = f"count({low})", "0D"
        if self.how == "sum":
            return f"coalesce({total}, {nothing})"
        return f"try_divide({total}, {present})"


def rows() -> Measure:
    return Measure("rows")


def count(column: str) -> Measure:
    """Number of rows with a value in the column."""
    return Measure("count", column)


def total(column: str, decimals: int | None = None, only: str | None = None) -> Measure:
    """Sum; 0 where there is nothing to sum."""
    return Measure("sum", column, decimals, only)


def mean(column: str, decimals: int | None = None) -> Measure:
    """Mean of the present values; null where there are none."""
    return Measure("mean", column, decimals)


def named(expressions: dict[str, str]) -> list[str]:
    """``expression AS name`` items of a select list."""
    return [f"{expression} AS `{name}`" for name, expression in expressions.items()]


def all_inputs(measures: Iterable[Measure]) -> list[str]:
    """Select items of every input the measures need, each once."""
    merged: dict[str, str] = {}
    for measure in measures:
        merged.update(measure.inputs())
    return named(merged)
