"""Names, keys and digests."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the namespace of URLs for name-based identifiers (RFC 4122).
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def _plain(name: str | None) -> str | None:
    if name is None:
        return None
    text = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c)).casefold()
    text = "".join(c if c.isalnum() else " " for c in text if c not in "'`’")
    return " ".join(text.split()) or None


@F.pandas_udf(T.StringType())
def normal_name(names: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Key of a name: compatibility decomposition without marks, case folded, apostrophes dropped, else words of letters and digits.

    There is no built-in decomposition, so it runs in Arrow batches; a name that leaves nothing has a null key.
    """
    for batch in names:
        yield batch.map(_plain, na_action="ignore")


def ascii_name(name: Column) -> Column:
    """normal_name for ASCII text, in the JVM."""
    words = F.regexp_replace(F.regexp_replace(F.lower(name), "['`]", ""), "[^a-z0-9]+", " ")
    return F.nullif(F.trim(words), F.lit(""))


def division_code(text: Column) -> Column:
    """Labels in the order in which they are looked for, each a part of the division's text."""
    labels = (
        "women's strawweight",
        "women's flyweight",
        "women's bantamweight",
        "women's featherweight",
        "light heavyweight",
        "heavyweight",
        "middleweight",
        "welterweight",
        "lightweight",
        "featherweight",
        "bantamweight",
        "flyweight",
        "catch weight",
    )
    low, out = F.lower(text), None
    for label in labels:
        code = label.replace("'", "").replace(" ", "_")
        out = F.when(low.contains(label), code) if out is None else out.when(low.contains(label), code)
    return out


def weight_class(text: Column) -> Column:
    return F.trim(F.regexp_replace(ascii_name(text), " bout$", ""))


def method_code(text: Column) -> Column:
    return F.replace(ascii_name(text), F.lit(" "), F.lit("_"))


def pair_key(day: Column, one: Column, other: Column) -> Column:
    """One key for a date and two names in either order."""
    return F.concat_ws("|", day.cast("string"), F.least(one, other), F.greatest(one, other))


def digest(*parts: Column | str) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def row_digest(*columns: str) -> Column:
    """Digest of a row's values as JSON, names in order, nulls written out."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def short_id(prefix: str, *parts: Column | str) -> Column:
    return F.concat(F.lit(prefix), F.upper(F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 12)))


def name_uuid(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """Version 5 identifier: SHA-1 of namespace and name, with version and variant put in."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(63).bitwiseOR(128)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12))
