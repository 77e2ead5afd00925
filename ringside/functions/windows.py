"""Windows of a competitor's past. Dates are cut strictly: bouts of one date never see each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

OWNER, DAY, BOUT = "fighter_id", "fight_date", "bout_id"


def prior(days: int | None = None, owner: str = OWNER) -> WindowSpec:
    """All earlier dates, or those of the last so many days."""
    start = Window.unboundedPreceding if days is None else -days
    return Window.partitionBy(owner).orderBy(F.unix_date(DAY)).rangeBetween(start, -1)


def until(days: int, owner: str = OWNER) -> WindowSpec:
    """All dates more than so many days earlier: what prior() holds and prior(days) doesn't."""
    return Window.partitionBy(owner).orderBy(F.unix_date(DAY)).rangeBetween(Window.unboundedPreceding, -days - 1)


def ordered(rows: DataFrame, owner: str = OWNER) -> DataFrame:
    """rows by owner, date and bout: the one shuffle and the one sort that all windows of this module make do with.

    All of them name the date as ranges need it, as a number, so that Spark sees that it's the same order.
    """
    return rows.repartition(owner).sortWithinPartitions(owner, F.unix_date(DAY), BOUT)


def in_order(owner: str = OWNER) -> WindowSpec:
    return Window.partitionBy(owner).orderBy(F.unix_date(DAY), BOUT)


def same_day(owner: str = OWNER) -> WindowSpec:
    return Window.partitionBy(owner, F.unix_date(DAY)).orderBy(BOUT)


def last_prior(value: Column, k: int, owner: str = OWNER) -> Column:
    """value, an aggregate, over the last k rows of earlier dates.

    For the first bout of a date these are the k rows before it; the date's other bouts take its value. Both windows
    share one partitioning and one order, so it's a single sort, and no list is ever gathered.
    """
    before = in_order(owner).rowsBetween(-k, -1)
    return _First(value.over(before), same_day(owner))  # type: ignore[return-value]


class _First:
    """A windowed value to be taken from the first row of its date: resolved by `resolve` in two selects."""

    def __init__(self, inner: Column, outer: WindowSpec):
        self.inner, self.outer = inner, outer


def with_columns(df, **columns):
    """withColumns that knows last_prior."""
    steps = {n: c for n, c in columns.items() if isinstance(c, _First)}
    df = df.withColumns({n: c.inner if n in steps else c for n, c in columns.items()})
    return df.withColumns({n: F.first(n).over(c.outer) for n, c in steps.items()}) if steps else df


def share(part: Column, whole: Column) -> Column:
    """part / whole, null for a whole of zero."""
    return F.try_divide(part.cast("double"), F.nullif(whole.cast("double"), F.lit(0.0)))
