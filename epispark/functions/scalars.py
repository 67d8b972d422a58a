"""Scalar building blocks: dates, text, numbers and JSON as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def week_label(ts: Column) -> Column:
    """The Monday on or after the calendar day: weeks run Tuesday to Monday and carry their last day."""
    return F.next_day(F.date_sub(F.to_date(ts), 1), "MON")


def iso_week(d: Column) -> Column:
    return F.weekofyear(d)


def iso_year(d: Column) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), d)


def month_mondays(day: Column) -> Column:
    """ISO weeks of the Mondays in the day's month."""
    first = F.trunc(day, "MM")
    return F.transform(F.filter(F.sequence(first, F.last_day(day)), lambda d: F.dayofweek(d) == 2), lambda d: F.weekofyear(d))


def season(day: Column) -> Column:
    m = F.month(day)
    return F.when(m.isin(3, 4, 5), "spring").when(m.isin(6, 7, 8), "summer").when(m.isin(9, 10, 11), "autumn").otherwise("winter")


def season_weight(day: Column, weights: Mapping[tuple[int, ...], float], default: float = 1.0) -> Column:
    out = None
    for months, w in weights.items():
        hit = F.month(day).isin(*months)
        out = F.when(hit, F.lit(w)) if out is None else out.when(hit, F.lit(w))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def year_month(text: Column, pattern: str = r"(\d{4})\D{1,2}(\d{1,2})") -> Column:
    """yyyy-MM out of free text, null when absent."""
    y, m = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
    return F.when(y != "", F.concat_ws("-", y, F.lpad(m, 2, "0")))


def first_match(text: Column, patterns: Sequence[str], group: int = 1) -> Column:
    """The group of the first pattern that matches, with white space removed from the text first."""
    tight = F.regexp_replace(text, r"\s+", "")
    return F.coalesce(*[F.nullif(F.regexp_extract(tight, p, group), F.lit("")) for p in patterns])


def micros(c: Column) -> Column:
    """Microseconds since the epoch; times without a zone are taken in the session's."""
    return F.unix_micros(c.cast("timestamp"))


def whole_hours(a: Column, b: Column) -> Column:
    return F.floor((micros(a) - micros(b)) / 3_600_000_000).cast("long")


def whole_days(a: Column, b: Column) -> Column:
    return F.floor((micros(a) - micros(b)) / 86_400_000_000).cast("long")


def lenient_time(c: Column, formats: Sequence[str] = ("yyyyMMdd", "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss")) -> Column:
    """First format that fits; bad values are null."""
    return F.coalesce(*[F.try_to_timestamp(c.cast("string"), F.lit(f)) for f in formats])


def lenient_double(c: Column) -> Column:
    """Number or null."""
    return c.try_cast("double")


def count_after(text: Column, label: str) -> Column:
    """The integer in the table cell after a label, else the first one behind it on its line."""
    cell = rf"(?is)\Q{label}\E\s*</t[dh][^>]*>\s*<t[dh][^>]*>\s*(\d{{1,7}})\s*</t[dh]>"
    line = rf"(?is)\Q{label}\E[^\n\r\d]*(\d{{1,7}})"
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in (cell, line)]).cast("long")


def raised(labs: Column) -> Column:
    """How many values of a map of packed features (z|slope|flag) carry the flag."""
    return F.coalesce(F.size(F.filter(F.map_values(labs), lambda v: F.endswith(v, F.lit("|1")))), F.lit(0))


def squeezed(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", "")


def dose_mg(text: Column, strict: bool = False) -> Column:
    """First number of a dosage. A leading dot means a decimal fraction; strict divides by 100 instead."""
    t = F.trim(text)
    number = F.nullif(F.regexp_extract(t, r"(\d+\.?\d*)", 1), F.lit("")).try_cast("double")
    dotted = F.startswith(t, F.lit("."))
    if strict:
        return F.when(dotted, number / 100).otherwise(number)
    return F.when(dotted, F.concat(F.lit("0."), F.regexp_extract(t, r"^\.(\d+)", 1)).try_cast("double")).otherwise(number)


def dose_parts(text: Column) -> Column:
    """struct(value, unit) of an anchored dosage; a plain number has no unit."""
    p = r"^\s*(\d+(?:\.\d+)?)\s*([^\d\s]+)\s*$"
    value = F.coalesce(F.nullif(F.regexp_extract(text, p, 1), F.lit("")).try_cast("double"), text.try_cast("double"))
    return F.struct(value.alias("value"), F.nullif(F.regexp_extract(text, p, 2), F.lit("")).alias("unit"))


def first_keyword(text: Column, rules: Sequence[tuple[str, Sequence[str]]], other: str = "Other") -> Column:
    """Ordered keyword classification: the first category of which any keyword occurs; null text is `other`."""
    out = None
    for category, words in rules:
        hit = F.contains(text, F.lit(words[0]))
        for w in words[1:]:
            hit = hit | F.contains(text, F.lit(w))
        out = F.when(hit, F.lit(category)) if out is None else out.when(hit, F.lit(category))
    return F.lit(other) if out is None else out.otherwise(F.lit(other))


def any_keyword(columns: Sequence[Column], words: Sequence[str]) -> Column:
    """1 if any word occurs, in either case, in any of the columns; nulls count as no."""
    pattern = "(?i)" + "|".join(words)
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(c.rlike(pattern), F.lit(False))
    return out.cast("int")


def clamp(c: Column, lo: float, hi: float) -> Column:
    """Bounds kept; null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), c)))


def ordered_quantiles(low: Column, mid: Column, high: Column) -> Column:
    """Non-negative and in order; missing outer levels take the middle."""
    m = F.greatest(F.coalesce(mid, F.lit(0.0)), F.lit(0.0))
    lo = F.least(F.greatest(F.coalesce(low, m), F.lit(0.0)), m)
    return F.struct(lo.alias("q05"), m.alias("q50"), F.greatest(F.coalesce(high, m), m).alias("q95"))


def json_number(text: Column, paths: Sequence[str]) -> Column:
    return F.coalesce(*[F.get_json_object(text, p).try_cast("double") for p in paths])


def labelled_text(parts: Sequence[tuple[str, Column]], sep: str = "; ") -> Column:
    """label: value of the non-empty columns."""
    return F.concat_ws(sep, *[F.when(F.length(F.coalesce(c, F.lit(""))) > 0, F.concat(F.lit(label + ": "), c)) for label, c in parts])
