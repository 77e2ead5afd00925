"""What competitors did in earlier bouts: sums and means over a career, the last bouts and the last days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringside.functions.parsing import completed_seconds
from ringside.functions.windows import BOUT, OWNER, last_prior, prior, share, until, with_columns
from ringside.sources.proxy import METRICS

#: Window -> its days, or the number of bouts that it holds.
SPANS: dict[str, tuple[int | None, int | None]] = {"career": (None, None), "recent_3": (None, 3), "recent_5": (None, 5), "days_365": (365, None), "days_730": (730, None)}
ABSORBED = ("knockdowns", "significant_strikes_landed", "significant_strikes_attempted", "total_strikes_landed", "total_strikes_attempted", "takedowns_landed", "takedowns_attempted")
#: Rate -> metric and its factor to the unit of time: strikes by the minute, takedowns by the quarter hour.
PACES = {
    "strikes_per_minute": ("significant_strikes_landed", 60), "total_strikes_per_minute": ("total_strikes_landed", 60),
    "takedowns_per_15": ("takedowns_landed", 900), "submissions_per_15": ("submission_attempts", 900), "control_share": ("control_seconds", 1),
}
ACCURACY = {"strike": ("significant_strikes_landed", "significant_strikes_attempted"), "total": ("total_strikes_landed", "total_strikes_attempted"), "takedown": ("takedowns_landed", "takedowns_attempted")}


def over(value: Column, span: str) -> Column:
    """An aggregate over one of SPANS; the last k bouts hold their places even where a metric is missing."""
    days, k = SPANS[span]
    return last_prior(value, k) if k else value.over(prior(days))


def window_stats(rows: DataFrame, metrics: tuple[str, ...] = METRICS, spans: tuple[str, ...] = tuple(SPANS)) -> DataFrame:
    """observed, missing, sum (null if nothing was observed) and mean of each metric in each window.

    Over days, counts and sums of whole numbers are those of the career less those of the dates before the window: both
    frames only grow, where a sliding one is read again for each row.
    """
    whole = {n for n, t in rows.dtypes if t in ("int", "bigint")}
    columns = {}
    for span in spans:
        days = SPANS[span][0]
        for m in metrics:
            stats = {"observed": F.count(m), "missing": F.count_if(F.col(m).isNull()), "sum": F.sum(m)}
            if days and m in whole:
                zero = F.lit(0).cast("long")
                inside = {x: F.coalesce(c.over(prior()), zero) - F.coalesce(c.over(until(days)), zero) for x, c in stats.items()}
                columns |= {f"{span}_{m}_{x}": F.when(inside["observed"] > 0, c) if x == "sum" else c for x, c in inside.items()}
            else:
                columns |= {f"{span}_{m}_{x}": over(c, span) for x, c in stats.items()}
    rows = with_columns(rows, **columns)
    return rows.withColumns({f"{s}_{m}_mean": share(F.col(f"{s}_{m}_sum"), F.col(f"{s}_{m}_observed")) for s in spans for m in metrics})


def accuracy(rows: DataFrame, span: str = "career") -> DataFrame:
    """Landed over attempted; null without an attempt."""
    return rows.withColumns({f"{span}_{n}_accuracy": share(F.col(f"{span}_{a}_sum"), F.col(f"{span}_{b}_sum")) for n, (a, b) in ACCURACY.items()})


def with_opponent(rows: DataFrame, metrics: tuple[str, ...] = ABSORBED) -> DataFrame:
    """Adds what the opponent did in the same bout, as opp_<metric>: an equal join on bout and competitor."""
    other = rows.select(F.col(BOUT), F.col(OWNER).alias("opponent_id"), *(F.col(m).alias(f"opp_{m}") for m in metrics))
    return rows.join(other, [BOUT, "opponent_id"], "left")


def absorbed(rows: DataFrame, metrics: tuple[str, ...] = ABSORBED) -> DataFrame:
    """count, missing, sum and mean of what opponents did in earlier bouts, and the defence that this shows."""
    rows = with_opponent(rows, metrics)
    rows = rows.withColumns({
        k: c for m in metrics for k, c in (
            (f"absorbed_{m}_observed", F.count(f"opp_{m}").over(prior())),
            (f"absorbed_{m}_missing", F.count_if(F.col(f"opp_{m}").isNull()).over(prior())),
            (f"absorbed_{m}_sum", F.sum(f"opp_{m}").over(prior())),
        )
    })
    rows = rows.withColumns({f"absorbed_{m}_mean": share(F.col(f"absorbed_{m}_sum"), F.col(f"absorbed_{m}_observed")) for m in metrics})
    return rows.withColumns({f"{n}_defense": 1 - share(F.col(f"absorbed_{a}_sum"), F.col(f"absorbed_{b}_sum")) for n, (a, b) in ACCURACY.items()})


def durations(bouts: DataFrame) -> DataFrame:
    return bouts.select(BOUT, completed_seconds(F.col("finish_round"), F.col("finish_time")).alias("duration"))


def pace(rows: DataFrame, bouts: DataFrame) -> DataFrame:
    """Counts of earlier bouts with and without a duration, and rates by time over bouts that have both metric and duration."""
    rows = rows.join(durations(bouts), BOUT, "left")
    rows = rows.withColumns({"timed_bouts": F.count("duration").over(prior()), "untimed_bouts": F.count_if(F.col("duration").isNull()).over(prior())})
    both = lambda m, x: F.sum(F.when(F.col(m).isNotNull() & F.col("duration").isNotNull(), F.col(x))).over(prior())
    return rows.withColumns({n: share(both(m, m) * factor, both(m, "duration")) for n, (m, factor) in PACES.items()})


def landed_above_attempted(rows: DataFrame) -> DataFrame:
    """Rows that land more than they attempt, by kind: a healthy table has none."""
    return rows.agg(*(F.count_if(F.col(a) > F.col(b)).alias(f"{n}_violations") for n, (a, b) in ACCURACY.items()))


def prefight_performance(rows: DataFrame, bouts: DataFrame) -> DataFrame:
    """All of it, a row for each competitor and bout."""
    return pace(absorbed(accuracy(window_stats(rows))), bouts)
