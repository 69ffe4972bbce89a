"""ISO times and JSON text as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_utc(ts: Column) -> Column:
    """ISO 8601 in UTC: six digits of a fraction, or none on a whole second. The session's time zone must be UTC."""
    ts = ts.cast("timestamp")
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssxxx")
    return F.when(F.pmod(F.unix_micros(ts), F.lit(1_000_000)) == 0, whole).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"))


def json_string(text: Column) -> Column:
    """A JSON string, or null as JSON writes it."""
    inner = F.to_json(F.array(text))
    return F.when(text.isNull(), F.lit("null")).otherwise(F.substring(inner, F.lit(2), F.length(inner) - 2))


def json_strings(texts: Column) -> Column:
    """A JSON list of strings with a comma and a blank between them."""
    return F.concat(F.lit("["), F.array_join(F.transform(texts, json_string), ", "), F.lit("]"))


def json_boolean(flag: Column) -> Column:
    return F.coalesce(flag.cast("string"), F.lit("null"))
