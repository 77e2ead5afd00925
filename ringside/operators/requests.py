"""Predictions for pairs that have no bout yet: what is known of both before a date, for many requests in one pass.

A request names two competitors and a date. Windows give each competitor's standing after every date that they have bouts
on: records, performance, ratings and adjusted observations. Requests join the standings in one order of dates and take
the last one before theirs; what is counted by days is the difference of two standings. No request sees another, no bout
is repeated for a request, and the work grows with bouts and requests.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ringside.functions.windows import BOUT, DAY, OWNER, share
from ringside.operators import evaluate
from ringside.operators.adjusted import ADJUSTED
from ringside.operators.history import OUTCOMES, STREAKS, finish_category, sides
from ringside.operators.pairwise import oriented, pairs, swapped
from ringside.operators.performance import SPANS
from ringside.operators.ratings import START
from ringside.plans.shared import shelve
from ringside.sources.proxy import METRICS

REQUEST, ASKED = "request_id", "request_date"
#: Spans of days over which bouts are counted.
ACTIVE = (180, 365, 730)


def history_rows(bouts: DataFrame, performance: DataFrame, rated: DataFrame, observed: DataFrame) -> DataFrame:
    """One row for each competitor and bout: outcome, what was done, ratings and adjusted observations.

    The last three come from ratings.overall() and adjusted.observations() over the same bouts.
    """
    long = sides(bouts, "finish_method").drop("winner_id", "is_no_contest", "is_draw")
    for own in (performance.drop(DAY, "opponent_id"), rated, observed.drop(DAY)):
        long = long.join(own, [BOUT, OWNER], "left")
    return long


def standings(rows: DataFrame, metrics: tuple[str, ...], adjusted: tuple[str, ...]) -> DataFrame:
    """What is known of each competitor after each date with bouts of theirs; counts are never null. One shuffle and one sort."""
    order = Window.partitionBy(OWNER).orderBy(DAY, BOUT)
    so_far, last = order.rowsBetween(Window.unboundedPreceding, 0), lambda k: order.rowsBetween(1 - k, 0)
    is_ = lambda *names: F.col("outcome").isin(*names)
    rated = ~is_("no_contest")
    n = F.count("*").over(so_far)
    rows = rows.withColumns({"seq": n, "category": finish_category(F.col("finish_method")), "_rated": F.when(rated, F.col("rating_after"))})
    back = lambda value, k: F.expr(f"lag({value}, {k}) IGNORE NULLS OVER (PARTITION BY {OWNER} ORDER BY {DAY}, {BOUT})")
    out: dict[str, Column] = {"prior_bouts": n, "prior_decisive": F.count_if(is_("win", "loss")).over(so_far), "rated_bouts": F.count_if(rated).over(so_far)}
    out |= {f"prior_{p}": F.count_if(is_(o)).over(so_far) for o, p in zip(OUTCOMES, ("wins", "losses", "draws", "no_contests"), strict=True)}
    out |= {f"recent_5_{o}": F.count_if(is_(o)).over(last(5)) for o in OUTCOMES}
    out |= {s: F.col("seq") - F.coalesce(F.max(F.when(~is_(*kept), F.col("seq"))).over(so_far), F.lit(0)) for s, kept in STREAKS.items()}
    out |= {f"prior_{k}_wins": F.count_if(is_("win") & (F.col("category") == k)).over(so_far) for k in ("ko_tko", "submission", "decision", "other")}
    for span, (days, k) in SPANS.items():
        if not days:
            frame = last(k) if k else so_far
            out |= {c: x for m in metrics for c, x in ((f"{span}_{m}_observed", F.count(m).over(frame)), (f"{span}_{m}_sum", F.sum(m).over(frame)))}
    out |= {"rating": F.col("rating_after"), "peak": F.greatest(F.lit(START), F.coalesce(F.max("_rated").over(so_far), F.lit(START)))}
    out |= {"third_last": F.when(rated, back("_rated", 2)).otherwise(back("_rated", 3)), "opponents_mean": F.avg(F.when(rated, F.col("opponent_rating"))).over(so_far)}
    for m in adjusted:
        value = F.col(f"adjusted_{m}")
        out |= {f"adjusted_{m}_count": F.count(value).over(so_far), f"adjusted_{m}_mean": F.avg(value).over(so_far)}
        out |= {f"_{m}_{k}": back(f"adjusted_{m}", k) for k in range(1, 6)}
    known = rows.withColumns(out | {"_next": F.lead(DAY).over(order)}).where(F.col("_next").isNull() | (F.col("_next") > F.col(DAY)))

    def latest(m: str, k: int) -> Column:
        own = F.col(f"adjusted_{m}")
        values = [own, *(F.col(f"_{m}_{i}") for i in range(1, k))], [F.col(f"_{m}_{i}") for i in range(1, k + 1)]
        total = lambda vs: reduce(Column.__add__, (F.coalesce(v, F.lit(0.0)) for v in vs)) / F.nullif(reduce(Column.__add__, (v.isNotNull().cast("int") for v in vs)), F.lit(0))
        return F.when(own.isNotNull(), total(values[0])).otherwise(total(values[1]))

    return known.select(OWNER, DAY, *(c for c in out if not c.startswith("_")), *(latest(m, k).alias(f"adjusted_{m}_last_{k}") for m in adjusted for k in (3, 5)))


def vectors(requests: DataFrame, rows: DataFrame, metrics: tuple[str, ...] = METRICS, adjusted: tuple[str, ...] = ADJUSTED) -> DataFrame:
    """request_id and competitor with everything known before the request's date; two rows a request.

    requests: request_id, fighter_a_id, fighter_b_id, request_date; rows: history_rows(). A competitor without an earlier
    bout has counts of zero, the starting rating, and null where nothing was observed.
    """
    asked = requests.select(REQUEST, ASKED, F.explode(F.array_distinct(F.array("fighter_a_id", "fighter_b_id"))).alias(OWNER))
    after = standings(rows.join(asked.select(OWNER).distinct(), OWNER, "left_semi"), metrics, adjusted)
    counts = [n for n, t in after.dtypes if t == "bigint"]
    state = F.struct(*(c for c in after.columns if c != OWNER))
    # what is counted by days takes a few of the columns
    summed = F.struct("prior_bouts", *(f"career_{m}_{x}" for m in metrics for x in ("observed", "sum")))
    both = after.select(OWNER, F.unix_date(DAY).alias("at"), state.alias("state"), summed.alias("summed")).unionByName(asked.select(OWNER, F.unix_date(ASKED).alias("at"), REQUEST), allowMissingColumns=True)
    until = lambda days, what="summed": F.last(what, ignorenulls=True).over(Window.partitionBy(OWNER).orderBy("at").rangeBetween(Window.unboundedPreceding, -days - 1))
    spans = {n for n, _ in SPANS.values() if n} if metrics else set()
    met = both.withColumns({"state": until(0, "state")} | {f"until_{n}": until(n) for n in sorted({*ACTIVE, *spans})}).where(F.col(REQUEST).isNotNull())
    within = lambda name, n: F.coalesce(f"state.{name}", F.lit(0)) - F.coalesce(f"until_{n}.{name}", F.lit(0))
    full = met.select(
        REQUEST, OWNER, *(F.coalesce(f"state.{n}", F.lit(0).cast("long")).alias(n) if n in counts else F.col(f"state.{n}") for n in after.columns if n not in (OWNER, DAY)),
        (F.col("at") - F.unix_date(F.col(f"state.{DAY}"))).cast("long").alias("days_since_last"), *(within("prior_bouts", n).alias(f"bouts_last_{n}d") for n in ACTIVE),
        *(c for span, (n, _) in SPANS.items() if n for m in metrics for c in (
            within(f"career_{m}_observed", n).alias(f"{span}_{m}_observed"), F.when(within(f"career_{m}_observed", n) > 0, within(f"career_{m}_sum", n)).alias(f"{span}_{m}_sum"),
        )),
    ).fillna(START, ["rating", "peak"]).withColumns({f"career_{m}_sum": F.when(F.col(f"career_{m}_observed") > 0, F.col(f"career_{m}_sum")) for m in metrics})
    wins = F.col("prior_wins")
    return full.withColumns({
        "prior_win_rate": share(wins, F.col("prior_decisive")), "prior_loss_rate": share(F.col("prior_losses"), F.col("prior_decisive")), "is_debut": F.col("prior_bouts") == 0,
        "recent_5_win_rate": share(F.col("recent_5_win"), F.col("recent_5_win") + F.col("recent_5_loss")), "finish_win_rate": share(wins - F.col("prior_decision_wins"), wins),
        "change_last_3": F.when(F.col("rated_bouts") >= 3, F.col("rating") - F.col("third_last")),
    } | {f"{s}_{m}_mean": share(F.col(f"{s}_{m}_sum"), F.col(f"{s}_{m}_observed")) for s in SPANS for m in metrics}).drop("third_last")


def answered(requests: DataFrame, stored: DataFrame, rows: DataFrame, features: list[str], **what: tuple[str, ...]) -> DataFrame:
    """Each request with its pair's features and the route by which they came.

    exact: a stored pair of that date and order (of several the one with the least bout id); reversed: one of the other
    order, with sides swapped; rebuilt: vectors() of both competitors, for requests that have neither.
    stored: bout, date, fighter_a_id, fighter_b_id and the oriented features.
    """
    names = oriented(features)
    kept = stored.select(DAY, "fighter_a_id", "fighter_b_id", BOUT, *names)
    both = kept.withColumn("route", F.lit("exact")).unionByName(swapped(kept).withColumn("route", F.lit("reversed")))
    first = both.groupBy(F.col(DAY).alias(ASKED), "fighter_a_id", "fighter_b_id").agg(F.min_by(F.struct("route", *names), F.struct("route", BOUT)).alias("x"))
    # written once: what is asked for again is read by several branches
    met = shelve(requests.join(first, [ASKED, "fighter_a_id", "fighter_b_id"], "left").select(*requests.columns, "x.*"))
    there = met.where("route IS NOT NULL")
    asked = met.where("route IS NULL").select(requests.columns)
    known = vectors(asked, rows, **what).withColumnRenamed(REQUEST, BOUT)
    rebuilt = pairs(asked.withColumnRenamed(REQUEST, BOUT), known, features, missing=False).withColumnRenamed(BOUT, REQUEST)
    return there.unionByName(rebuilt.withColumn("route", F.lit("rebuilt")).select(there.columns))


@dataclass(frozen=True)
class Bundle:
    """A linear model as it's served: what fills gaps, weights of oriented features, and margins at which it speaks."""

    features: tuple[str, ...]
    intercept: float
    weights: dict[str, float]
    fill: dict[str, float]
    margins: dict[str, float] = field(default_factory=dict)

    def text(self) -> str:
        return json.dumps({"features": self.features, "intercept": self.intercept, "weights": self.weights, "fill": self.fill, "margins": self.margins}, sort_keys=True)

    def sha256(self) -> str:
        return hashlib.sha256(self.text().encode()).hexdigest()

    @classmethod
    def of_text(cls, text: str, sha256: str | None = None) -> Bundle:
        """Fails where the text isn't the one that the digest was taken of."""
        said = json.loads(text)
        bundle = cls(tuple(said["features"]), said["intercept"], said["weights"], said["fill"], said["margins"])
        if sha256 and bundle.sha256() != sha256:
            raise ValueError("the bundle isn't the one in the manifest")
        return bundle

    @classmethod
    def of_model(cls, model: PipelineModel, features: list[str], margins: dict[str, float]) -> Bundle:
        """From models.logistic(): medians fill gaps, and scales are folded into the weights."""
        imputer, _, scaler, fitted = model.stages
        names = oriented(features)
        medians = imputer.surrogateDF.first().asDict()
        weights = {n: float(w / s) if s else 0.0 for n, w, s in zip(names, fitted.coefficients, scaler.std, strict=True)}
        intercept = float(fitted.intercept) - sum(weights[n] * float(m) for n, m in zip(names, scaler.mean, strict=True))
        return cls(tuple(features), intercept, weights, {n: float(medians[f"x_{n}"]) for n in names}, margins)

    def logit(self, swap: bool = False) -> Column:
        """Of a row, or of the row with its sides exchanged; no second copy of the rows is made for that."""
        total = F.lit(self.intercept)
        for n, w in self.weights.items():
            side, _, f = n.partition("_")
            value = F.col(n) if not swap else -F.col(n) if side == "diff" else F.col(f"{'b' if side == 'a' else 'a'}_{f}")
            total = total + F.coalesce(value.cast("double"), F.lit(self.fill[n])) * w
        return total

    def predicted(self, rows: DataFrame) -> DataFrame:
        """Forward, swapped and symmetric probability of A, the winner, its tier, and which margins it passes."""
        sigmoid = lambda x: 1 / (1 + F.exp(-x))
        rows = rows.withColumns({"p_forward": sigmoid(self.logit()), "p_swap": sigmoid(self.logit(swap=True))})
        rows = rows.withColumn("p", evaluate.symmetric(F.col("p_forward"), F.col("p_swap")))
        p = F.col("p")
        speaks = {f"speaks_{n}": F.abs(p - 0.5) >= m for n, m in self.margins.items()}
        return rows.withColumns({"predicted_id": evaluate.predicted(p, F.col("fighter_a_id"), F.col("fighter_b_id")), "tier": evaluate.tier(p)} | speaks)


def save_bundle(spark: SparkSession, bundle: Bundle, path: str) -> str:
    """Write a bundle and a manifest with its digest; a bundle that's there has to be the same. Returns the digest."""
    from ringside.plans.publish import read_text, write_text_once

    write_text_once(spark, f"{path}/bundle.json", bundle.text())
    write_text_once(spark, f"{path}/manifest.json", json.dumps({"bundle.json": bundle.sha256()}))
    return json.loads(read_text(spark, f"{path}/manifest.json"))["bundle.json"]


def load_bundle(spark: SparkSession, path: str) -> Bundle:
    from ringside.plans.publish import read_text

    return Bundle.of_text(read_text(spark, f"{path}/bundle.json"), json.loads(read_text(spark, f"{path}/manifest.json"))["bundle.json"])


def limitations(requests: DataFrame, cutoff: str, stale_days: int = 365) -> DataFrame:
    """requests with the days from the training cutoff to the date asked for, and a warning where these are too many."""
    days = F.date_diff(ASKED, F.lit(cutoff).cast("date")).cast("long")
    warning = F.lit(f"The history ends on {cutoff}; this date is more than {stale_days} days later, so the sources may be stale.")
    return requests.withColumn("days_after_cutoff", days).withColumn("limitation", F.when(F.col("days_after_cutoff") > stale_days, warning))
