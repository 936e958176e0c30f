"""PDF dates (D:YYYYMMDDHHmmSSOHH'mm') as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

PATTERN = r"^(?:D:)?(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\d{2})?"


def parse(text: Column) -> Column:
    """Local time, the offset ignored; missing parts are 1 or 0; null if it cannot be read."""
    part = lambda i, d: F.coalesce(F.nullif(F.regexp_extract(text, PATTERN, i), F.lit("")), F.lit(d))
    said = F.concat_ws("", part(1, ""), part(2, "01"), part(3, "01"), part(4, "00"), part(5, "00"), part(6, "00"))
    return F.when(text.rlike(PATTERN), F.try_to_timestamp(said, F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz"))


def offset_minutes(text: Column, default: int = 0) -> Column:
    """Minutes east of UTC; Z is 0; default where there is none."""
    sign = F.regexp_extract(text, r"([+-])\d{2}'?(\d{2})?'?$", 1)
    hours = F.regexp_extract(text, r"[+-](\d{2})'?(?:\d{2})?'?$", 1).try_cast("int")
    minutes = F.coalesce(F.regexp_extract(text, r"[+-]\d{2}'?(\d{2})'?$", 1).try_cast("int"), F.lit(0))
    return F.when(sign != "", F.when(sign == "-", -1).otherwise(1) * (hours * 60 + minutes)).otherwise(default)


def format_date(ts: Column) -> Column:
    return F.concat(F.lit("D:"), F.date_format(ts, "yyyyMMddHHmmss"))


def to_xmp(text: Column) -> Column:
    """ISO 8601 with the offset that is given."""
    minutes = offset_minutes(text)
    zone = F.when(text.rlike(r"[+-]\d{2}'?(\d{2})?'?$"), F.concat(F.when(minutes < 0, "-").otherwise("+"), F.lpad(F.floor(F.abs(minutes) / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.abs(minutes) % 60).cast("string"), 2, "0"))).when(text.endswith("Z"), "Z").otherwise("")
    return F.concat(F.date_format(parse(text), "yyyy-MM-dd'T'HH:mm:ss"), zone)


def xmp_type(text: Column) -> Column:
    """integer, real, date or text, as an XMP value reads."""
    return (
        F.when(text.rlike(r"^[+-]?\d{1,9}$"), "integer").when(text.rlike(r"^[+-]?(\d+\.\d*|\.\d+|\d{10,})$"), "real")
        .when(text.rlike(r"^\d{4}(-\d{2}(-\d{2}(T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})?)?)?)?$"), "date").otherwise("text")
    )
