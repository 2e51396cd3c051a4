"""Row-wise expressions. All are built-in functions, so they stay inside whole-stage codegen."""

from __future__ import annotations

import math
from collections.abc import Sequence

_WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def text(value: str) -> str:
    """A string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def array(values: Sequence[str]) -> str:
    return f"array({', '.join(text(value) for value in values)})"


def pick(labels: Sequence[str], index: str) -> str:
    """The label at a 0-based index; null for an unknown index (``element_at`` is planned as never
    null under ANSI, and then gives some label)."""
    return f"get({array(labels)}, CAST({index} AS INT))"


def ordinal(label: str, order: Sequence[str]) -> str:
    """1-based place of a label in ``order``; labels outside it come after all others."""
    return f"coalesce(nullif(array_position({array(order)}, {label}), 0), {len(order) + 1})"


def cut(value: str, edges: Sequence[float], labels: Sequence[str]) -> str:
    """Label of the bin ``(low, high]`` that holds the value; null outside all bins."""
    cases = []
    for low, high, label in zip(edges, edges[1:], labels):
        upper = "" if math.isinf(high) else f" AND {value} <= {high}"
        cases.append(f"WHEN {value} > {low}{upper} THEN {text(label)}")
    return f"CASE {' '.join(cases)} END"


def flag(condition: str) -> str:
    """1 where the condition holds, else 0; an unknown condition counts as false."""
    return f"CAST(coalesce({condition}, false) AS BIGINT)"


def at_least(value: str, low: int) -> str:
    """Clip from below, keeping null (``greatest`` would replace it)."""
    return f"CASE WHEN {value} < {low} THEN {low} ELSE {value} END"


def at_most(value: str, high: int) -> str:
    """Clip from above, keeping null."""
    return f"CASE WHEN {value} > {high} THEN {high} ELSE {value} END"


def round_scaled(value: str, digits: int) -> str:
    """Half-even rounding of ``value * 10^digits``: the rounding of stored feature columns."""
    factor = f"{10**digits}D"
    return f"(rint(({value}) * {factor}) / {factor})"


def round_exact(value: str, digits: int) -> str:
    """Half-even rounding of the exact binary value: the rounding of served numbers.

    ``2.675`` is slightly below the decimal tie, so it gives 2.67 although ``2.675 * 100`` is
    267.5 in doubles. The error of that product is recovered exactly (split multiplication, exact
    because the factor is small) and settles the ties.
    """
    if digits == 0:
        return f"rint({value})"
    x, factor = f"({value})", f"{10**digits}D"
    product = f"({x} * {factor})"
    spread = f"({x} * 134217729D)"  # 2^27 + 1 splits a double into two halves
    high = f"({spread} - ({spread} - {x}))"
    error = f"(({high} * {factor} - {product}) + ({x} - {high}) * {factor})"
    tie = f"abs({product} - rint({product})) = 0.5D"
    # From 2^53 / factor on, doubles are too coarse to hold further decimals.
    coarse = f"abs({x}) >= {2**53 / 10**digits!r}D"
    return f"""CASE WHEN {coarse} THEN {x}
        WHEN {tie} AND {error} > 0 THEN CAST(ceil({product}) AS DOUBLE) / {factor}
        WHEN {tie} AND {error} < 0 THEN CAST(floor({product}) AS DOUBLE) / {factor}
        ELSE (rint({product}) + rint({error})) / {factor} END"""


def month_label(time: str) -> str:
    """``2023-01``. Built from integers: cheaper than ``date_format`` and free of the session zone."""
    months = [f"-{month:02d}" for month in range(1, 13)]
    return f"concat(CAST(year({time}) AS STRING), {pick(months, f'month({time}) - 1')})"


def quarter_label(time: str) -> str:
    """``2023Q1``."""
    return f"concat(CAST(year({time}) AS STRING), 'Q', CAST(quarter({time}) AS STRING))"


def weekday_label(time: str) -> str:
    """English day name."""
    return pick(_WEEKDAYS, f"weekday({time})")


def hour_label(hour: str) -> str:
    """``07:00``."""
    return f"format_string('%02d:00', {hour})"
