"""Column expressions that read what people typed: blanks, days, instants, kinds, names, numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Placeholders that say nothing.
PLACEHOLDERS = ("", "-", "--", "?", ".", "n/a", "na", "none", "null", "nil", "nan", "tbd", "unknown", "undefined")


def usable_text(c: Column) -> Column:
    """True for text that says something; false for null, empty, blank or a placeholder."""
    return F.coalesce(~F.lower(F.trim(F.regexp_replace(c, r"^\s+|\s+$", ""))).isin(*PLACEHOLDERS), F.lit(False))


def usable_score(c: Column) -> Column:
    """True for a score that is not null, NaN or negative."""
    return F.coalesce(~F.isnan(c) & (c >= 0), F.lit(False))


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def _month(c: Column) -> Column:
    """Number of a month from its English name or the first three letters of it; null if it is none."""
    at = F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.lower(F.substring(c, 1, 3)))
    return F.when((at > 0) & ((at - 1) % 3 == 0), ((at - 1) / 3 + 1).cast("int"))


def _ymd(y: Column, m: Column, d: Column) -> Column:
    return F.expr("null").cast("date") if y is None else F.try_to_date(F.concat_ws("-", y, m.cast("string"), d.cast("string")))


def publication_day(c: Column) -> Column:
    """The day (DATE) that a text names, null if none. A day known only to the month is the 15th.

    Reads 2025-03-07, 2025/03/07, 20250307, instants, 7 Mar 2025, March 7, 2025, 2025-03 and March 2025.
    """
    s = F.regexp_replace(c, r"^\s+|\s+$", "")
    dmy, mdy, my = r"(?i)^(\d{1,2})\.?\s+([a-z]{3,9})\.?,?\s+(\d{4})$", r"(?i)^([a-z]{3,9})\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})$", r"(?i)^([a-z]{3,9})\.?,?\s+(\d{4})$"
    g = F.regexp_extract
    return (
        F.when(s.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(s))
        .when(s.rlike(r"^\d{4}-\d{1,2}$"), F.try_to_date(F.concat(s, F.lit("-15"))))
        .when(s.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d"), F.to_date(instant(s)))
        .when(s.rlike(r"^\d{4}/\d{1,2}/\d{1,2}$"), F.try_to_date(F.replace(s, F.lit("/"), F.lit("-"))))
        .when(s.rlike(r"^\d{4}/\d{1,2}$"), F.try_to_date(F.concat(F.replace(s, F.lit("/"), F.lit("-")), F.lit("-15"))))
        .when(s.rlike(r"^\d{8}$"), F.try_to_date(F.concat_ws("-", F.substring(s, 1, 4), F.substring(s, 5, 2), F.substring(s, 7, 2))))
        .when(s.rlike(dmy), _ymd(g(s, dmy, 3), _month(g(s, dmy, 2)), g(s, dmy, 1)))
        .when(s.rlike(mdy), _ymd(g(s, mdy, 3), _month(g(s, mdy, 1)), g(s, mdy, 2)))
        .when(s.rlike(my), _ymd(g(s, my, 2), _month(g(s, my, 1)), F.lit("15")))
    )


def instant(c: Column) -> Column:
    """The instant (TIMESTAMP) that a text names, null if none; a date alone is its midnight UTC.

    Reads ISO 8601 with or without an offset (without: UTC) and epoch seconds or milliseconds.
    """
    s = F.regexp_replace(c, r"^\s+|\s+$", "")
    return (
        F.when(s.rlike(r"^\d{12,14}$"), F.timestamp_millis(F.expr("0L") + s.try_cast("long")))
        .when(s.rlike(r"^\d{9,11}$"), F.timestamp_seconds(s.try_cast("long")))
        .when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(F.concat(s, F.lit("T00:00:00Z"))))
        .when(s.rlike(r"^\d{4}-\d{2}-\d{2}[T ].*(?:[Zz]|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(s))
        .when(s.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d"), F.try_to_timestamp(F.concat(s, F.lit("Z"))))
    )


def kind_key(c: Column) -> Column:
    """A source kind as the list of kinds writes it: 'Github Repo ' and 'github-repo' give 'github_repo'."""
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), r"[\s\-_]+", "_")


def name_key(c: Column, keep: str = "") -> Column:
    """Lower case without anything but letters a-z, digits and the characters in ``keep``."""
    return F.regexp_replace(F.lower(c), rf"[^a-z0-9{keep}]+", "")


def narrow(c: Column) -> Column:
    """Full-width letters, digits and signs as their plain forms."""
    wide = [chr(x) for x in range(0xFF01, 0xFF5F)]
    return F.translate(F.translate(c, "".join(wide), "".join(chr(ord(x) - 0xFEE0) for x in wide)), "\u3000", " ")


def page_key(c: Column) -> Column:
    """The page or repository that a link names, however written; null for blanks and the front page of a host."""
    s = F.regexp_replace(c, r"^\s+|\s+$", "")
    s = F.regexp_replace(s, r"(?i)^(?:[a-z][a-z0-9+.\-]*:)?//", "")
    s = F.regexp_replace(s, r"[?#].*$", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(s, r"^([^/]*)", 1)), r"^www\d?\.", ""), r":\d+$", "")
    path = F.regexp_replace(F.regexp_extract(s, r"^[^/]*(/.*)$", 1), r"/{2,}", "/")
    path = F.regexp_replace(path, r"/(?:tree|blob)/(?:main|master)/?$", "")
    path = F.regexp_replace(F.regexp_replace(path, r"/+$", ""), r"(?i)(?:\.git|/index\.html?)$", "")
    return F.when(host.contains(".") & (F.length(path) > 1), F.concat(host, path))


def decimals(c: Column) -> Column:
    """Decimal places that a score is written with, 0 to 4."""
    out = F.lit(4)
    for k in (3, 2, 1, 0):
        out = F.when(F.abs(c * 10**k - F.round(c * 10**k)) < 1e-6 * 10 ** max(0, k - 1), F.lit(k)).otherwise(out)
    return out
