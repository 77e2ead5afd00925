"""Text of the sources to values. What cannot be read is null, or an error where a column says so."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How the sources write that a count is missing.
MISSING = ("", "--", "---", "N/A")


def count(text: Column) -> Column:
    """A whole number; missing marks are null and anything else fails."""
    t = F.trim(text)
    return F.when(text.isNull() | t.isin(*MISSING), None).when(t.rlike("^[0-9]+$"), t.try_cast("bigint")).otherwise(F.raise_error(F.concat(F.lit("not a count: "), text)))


def pair(text: Column) -> Column:
    """'x of y' as struct(landed, attempted); fails for other text, and where x > y."""
    t = F.trim(text)
    x, y = F.regexp_extract(t, "^([0-9]+) of ([0-9]+)$", 1).try_cast("bigint"), F.regexp_extract(t, "^([0-9]+) of ([0-9]+)$", 2).try_cast("bigint")
    return F.when(text.isNull() | t.isin(*MISSING), None).when(x <= y, F.struct(x.alias("landed"), y.alias("attempted"))).otherwise(F.raise_error(F.concat(F.lit("not a pair: "), text)))


def clock_seconds(text: Column) -> Column:
    """'m:ss' in seconds, null where it's nothing of the kind or has 60 seconds and more."""
    minutes, seconds = (F.regexp_extract(F.trim(text), "^([0-9]+):([0-9]{1,2})$", i).try_cast("bigint") for i in (1, 2))
    return F.when(seconds < 60, minutes * 60 + seconds)


def strict_clock(text: Column) -> Column:
    """clock_seconds that fails instead, but for missing marks."""
    return F.when(text.isNull() | F.trim(text).isin(*MISSING), None).otherwise(F.coalesce(clock_seconds(text), F.raise_error(F.concat(F.lit("not a clock: "), text)).cast("bigint")))


def lenient_number(text: Column) -> Column:
    return F.coalesce(F.trim(text).try_cast("double"), F.lit(0.0))


def completed_seconds(round_no: Column, clock: Column) -> Column:
    """Time from the start to the finish of a bout of five-minute rounds; null for a malformed or impossible one."""
    elapsed = clock_seconds(clock)
    total = (round_no.cast("bigint") - 1) * 300 + elapsed
    return F.when((round_no > 0) & (elapsed <= 300) & (total > 0), total)


def leading_rounds(text: Column) -> Column:
    """The number that a text is, or begins with before a space; else null."""
    return F.regexp_extract(F.trim(text), r"^([0-9]+)(\s|$)", 1).try_cast("int")


def positive_rounds(text: Column) -> Column:
    """Rounds with overtime: 'N Rnd + kOT' counts N + k (k is 1 if it isn't there); else a leading number; null if not above zero."""
    over = r"^([0-9]+)\s*Rnd\s*\+\s*([0-9]*)\s*OT"
    n, k = F.regexp_extract(text, over, 1).try_cast("int"), F.coalesce(F.regexp_extract(text, over, 2).try_cast("int"), F.lit(1))
    found = F.coalesce(n + k, F.regexp_extract(F.trim(text), r"^([0-9]+)", 1).try_cast("int"))
    return F.when(found > 0, found)


def time_format_rounds(text: Column) -> Column:
    """Rounds of a time format, one more for '+ OT', two for '+ 2OT'; none for 'No Time Limit'."""
    digits = F.regexp_replace(F.element_at(F.split(text, " "), 1), "[^0-9]", "").try_cast("int")
    extra = F.when(text.contains("+ 2OT"), 2).when(text.contains("+ OT"), 1).otherwise(0)
    return F.when(text == "No Time Limit", None).otherwise(digits + extra)


def any_date(text: Column) -> Column:
    """ISO first, then day/month/year."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")), F.try_to_timestamp(text, F.lit("d/M/yyyy"))).cast("date")


def whole(text: Column) -> Column:
    return text.try_cast("double").cast("bigint")


def optional_whole(text: Column) -> Column:
    """A positive whole number, written with or without decimals."""
    d = F.trim(text).try_cast("double")
    return F.when((d > 0) & (d == F.floor(d)), d.cast("bigint"))


def text_or_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def side_outcome(label: Column) -> Column:
    """A source's outcome as red, blue, draw or no_contest; other labels as they are, marked."""
    low = F.lower(F.trim(label))
    return (
        F.when(low.isin("red", "red_win"), "red").when(low.isin("blue", "blue_win"), "blue").when(low.isin("draw", "draws"), "draw")
        .when(low.isin("nc", "no contest", "no_contest", "overturned"), "no_contest").otherwise(F.concat(F.lit("uninterpreted:"), low))
    )


def detail(json: Column, key: str) -> Column:
    return F.element_at(F.from_json(json, "map<string,string>"), F.lit(key))
