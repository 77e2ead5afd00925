import uuid

import pytest
from pyspark.sql import functions as F

from ringside.functions import names, parsing
from ringside.operators import quality


def values(spark, column, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(column(F.col("t")).alias("v")).collect()]


def test_counts_and_clocks(spark):
    assert values(spark, parsing.count, "3", "--", None, "N/A", " 12 ") == [3, None, None, None, 12]
    assert values(spark, parsing.clock_seconds, "4:59", "0:5", "1:60", "x", None) == [299, 5, None, None, None]
    assert [tuple(v) if v else None for v in values(spark, parsing.pair, "2 of 5", "---", None)] == [(2, 5), None, None]
    assert values(spark, parsing.lenient_number, "2.5", "x", None) == [2.5, 0.0, 0.0]


@pytest.mark.parametrize(("column", "text"), [(parsing.count, "x"), (parsing.count, "-1"), (parsing.pair, "3 of 2"), (parsing.pair, "3"), (parsing.strict_clock, "1:75"), (parsing.strict_clock, "late")])
def test_malformed_text_fails(spark, column, text):
    with pytest.raises(Exception, match="not a"):
        values(spark, column, text)


def test_rounds_and_dates(spark):
    texts = ("5", "3 Rnd (5-5-5)", "1 Rnd + 2OT (15-3-3)", "1 Rnd + OT (12-3)", "No Time Limit", None, "0")
    assert values(spark, parsing.positive_rounds, *texts) == [5, 3, 3, 2, None, None, None]
    assert values(spark, parsing.leading_rounds, "5", "3 Rnd", "5x", None) == [5, 3, None, None]
    assert [str(v) for v in values(spark, parsing.any_date, "2020-02-01", "1/2/2020", "soon")] == ["2020-02-01", "2020-02-01", "None"]
    assert values(spark, parsing.optional_whole, "3", "3.0", "3.5", "0", "x") == [3, 3, None, None, None]


def test_names(spark):
    assert values(spark, names.normal_name, "José  O'Neil-Smith", "  ", None, "Łukasz") == ["jose oneil smith", None, None, "łukasz"]
    assert values(spark, names.ascii_name, "Jose O'Neil-Smith", "--") == ["jose oneil smith", None]
    assert values(spark, names.name_uuid, "fighter:x") == [str(uuid.uuid5(uuid.NAMESPACE_URL, "fighter:x"))]
    assert values(spark, names.division_code, "Light Heavyweight Bout", "Women's Flyweight", "Lightweight", "Open", None) == ["light_heavyweight", "womens_flyweight", "lightweight", None, None]


def test_column_gate():
    quality.forbid(["prior_bouts", "fight_date"])
    with pytest.raises(ValueError, match="winner"):
        quality.forbid(["prior_bouts", "winner"])
    assert quality.leakage_class("R_avg_strikes") == "corner_statistic" and quality.leakage_class("reach_dif") == "difference"
