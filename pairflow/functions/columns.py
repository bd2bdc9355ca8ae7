"""Column expressions: calendar classes, binning, ids, guards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Edges of the elevation-difference classes and feet to metres.
ELEVATION_EDGES = (-20.0, -10.0, -5.0, 0.0, 5.0, 10.0, 20.0, 30.0, 50.0, 75.0, 100.0)
FEET_TO_METRES = 0.3048
DAYS_A_YEAR = 365.25


def season(month: Column) -> Column:
    """Winter is December to February, then three months each; other numbers count as Fall."""
    return (
        F.when(month.isin(12, 1, 2), "Winter").when(month.isin(3, 4, 5), "Spring").when(month.isin(6, 7, 8), "Summer").otherwise("Fall")
    )


def season_order(name: Column) -> Column:
    return F.when(name == "Spring", 1).when(name == "Summer", 2).when(name == "Fall", 3).when(name == "Winter", 4).otherwise(5)


def month_name(month: Column) -> Column:
    return F.date_format(F.make_date(F.lit(2000), month, F.lit(1)), "MMM")


def month_index(date: Column) -> Column:
    return F.year(date) * 12 + F.month(date)


def quarter_index(date: Column) -> Column:
    return F.year(date) * 4 + F.quarter(date)


def mid_month(date: Column) -> Column:
    return F.date_add(F.trunc(date, "month"), 14)


def ordinal(date: Column) -> Column:
    """Days with 0001-01-01 as 1."""
    return F.unix_date(date) + 719163


def before(date: Column, k: int, unit: str) -> Column:
    """The date ``k`` years, months or days earlier; month ends are clipped."""
    if unit == "years":
        return F.add_months(date, -12 * k)
    if unit == "months":
        return F.add_months(date, -k)
    if unit == "days":
        return F.date_sub(date, k)
    raise ValueError(f"unit is years, months or days, not {unit!r}")


def clean_id(c: Column) -> Column:
    """An id as text: a closing ``.0`` goes, empty texts and the text ``nan`` are null."""
    text = F.regexp_replace(F.trim(c.cast("string")), r"\.0$", "")
    return F.nullif(F.nullif(text, F.lit("nan")), F.lit(""))


def missing(c: Column) -> Column:
    """NaN and infinities as null, so that aggregates skip them."""
    return F.when(F.abs(c) < F.lit(float("inf")), c)


def right_closed_bins(x: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """The label of ``(edge, next edge]``; open at both ends, null stays null."""
    out = F.when(x <= edges[0], labels[0])
    for edge, label in zip(edges[1:], labels[1:-1], strict=True):
        out = out.when(x <= edge, label)
    return out.when(x > edges[-1], labels[-1])


def bin_labels(edges: Sequence[float]) -> list[str]:
    show = lambda v: f"{v:g}"
    return [f"< {show(edges[0])}", *[f"{show(a)} to {show(b)}" for a, b in zip(edges[:-1], edges[1:], strict=True)], f">= {show(edges[-1])}"]


def bin_order(x: Column, edges: Sequence[float]) -> Column:
    return sum((F.when(x > e, 1).otherwise(0) for e in edges), F.lit(0))


def threshold_class(x: Column, classes: Sequence[tuple[str, float, float | None]]) -> Column:
    """The first class whose half-open range ``[low, high)`` holds x."""
    out = None
    for name, low, high in classes:
        inside = (x >= low) & (F.lit(True) if high is None else x < high)
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out


def equal_width_bin(x: Column, low: Column, high: Column, k: int) -> Column:
    """Which of k equal bins of [low, high] holds x; the maximum falls in the last, a constant in the first."""
    at = F.floor((x - low) * k / F.nullif(high - low, F.lit(0.0))).cast("int")
    return F.coalesce(F.least(at, F.lit(k - 1)), F.lit(0))


def p_text(p: Column) -> Column:
    """A p-value as text."""
    return F.when(p.isNull(), "n/a").when(p < 0.0001, "< 0.0001").otherwise(F.format_string("%.4f", p))


def minus_log10(p: Column) -> Column:
    return -F.log10(F.greatest(p, F.lit(1e-300)))


def unplaced(c: Column) -> Column:
    """A text key in a form that Spark doesn't take as partitioned already, so that hot keys of a join can be split at run time."""
    return F.concat(c, F.lit(""))
