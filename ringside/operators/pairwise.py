"""One row a bout: both sides' features, their differences, and the swap of sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringside.functions.windows import BOUT, DAY, OWNER


def oriented(names: list[str]) -> list[str]:
    """Feature names of a pair: a_ and b_ by turns, then the differences."""
    return [f"{side}_{n}" for n in names for side in "ab"] + [f"diff_{n}" for n in names]


def signed_difference(a: Column, b: Column) -> Column:
    """a - b, flags as 0 and 1; null if either is unknown."""
    return a.cast("double") - b.cast("double")


def pairs(bouts: DataFrame, snapshots: DataFrame, features: list[str], missing: bool = True) -> DataFrame:
    """bout x snapshot of A x snapshot of B: a_, b_, diff_ of each feature and, if asked for, whether each is missing.

    One join and one aggregate on the bout, which share a partitioning: snapshots are made once, not once a side.
    """
    return sides_met(bouts.join(snapshots.select(BOUT, OWNER, *features), BOUT), bouts.columns, features, missing)


def sides_met(met: DataFrame, columns: list[str], features: list[str], missing: bool = True) -> DataFrame:
    """The same from rows of either side that bear their bout's columns, so that no join brings these back."""
    is_side = lambda side: F.col(OWNER) == F.col(f"fighter_{side}_id")
    of = lambda side, f: F.max(F.when(is_side(side), F.col(f))).alias(f"{side}_{f}")
    both = F.max(is_side("a")) & F.max(is_side("b"))
    joined = met.groupBy(*columns).agg(*(of(side, f) for f in features for side in "ab"), both.alias("_both")).where("_both").drop("_both")
    joined = joined.withColumns({f"diff_{f}": signed_difference(F.col(f"a_{f}"), F.col(f"b_{f}")) for f in features})
    if missing:
        joined = joined.withColumns({f"{n}_missing": F.col(n).isNull() for n in oriented(features)})
    return joined


def model_ready(paired: DataFrame, features: list[str]) -> DataFrame:
    """Decisive bouts alone, in fixed columns, with the label."""
    names = oriented(features)
    label = (F.col("winner_id") == F.col("fighter_a_id")).cast("int").alias("a_won")
    return paired.where(~F.col("is_draw") & ~F.col("is_no_contest")).select(BOUT, DAY, "fighter_a_id", "fighter_b_id", *names, *(f"{n}_missing" for n in names), label)


def swapped(rows: DataFrame) -> DataFrame:
    """A and B exchanged: a_ and b_ change places, differences change sign, labels and probabilities complement."""
    out = []
    for name in rows.columns:
        if name.endswith("_missing") and name.startswith("diff_"):
            out.append(F.col(name))
        elif name == "a_won" or name.startswith("p_"):
            out.append((1 - F.col(name)).cast(rows.schema[name].dataType).alias(name))
        elif name.startswith("diff_"):
            out.append((-F.col(name)).alias(name))
        elif name.startswith("a_") or name.startswith("b_"):
            out.append(F.col(f"{'b' if name[0] == 'a' else 'a'}_{name[2:]}").alias(name))
        elif name in ("fighter_a_id", "fighter_b_id"):
            out.append(F.col("fighter_b_id" if name == "fighter_a_id" else "fighter_a_id").alias(name))
        else:
            out.append(F.col(name))
    return rows.select(*out)


def augmented(rows: DataFrame) -> DataFrame:
    """Training rows and their swaps."""
    return rows.withColumn("is_swap", F.lit(False)).unionByName(swapped(rows).withColumn("is_swap", F.lit(True)))


def missing_mismatches(rows: DataFrame, features: list[str]) -> DataFrame:
    """Rows in which a missing flag contradicts its column, by column, in one pass."""
    return rows.agg(*(F.count_if(F.col(f"{n}_missing") != F.col(n).isNull()).alias(f"{n}_mismatches") for n in oriented(features)))


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join that fails where a key stands twice on the right: feature packs may not multiply rows."""
    n = F.count("*").over(Window.partitionBy(*keys))
    checked = right.withColumn("_n", n).withColumn("_n", F.when(F.col("_n") > 1, F.raise_error(F.lit("key is not unique"))).otherwise(F.col("_n")))
    return left.join(checked.where("_n = 1").drop("_n"), keys, "left")
