"""Lenient readings of text as numbers, dates and booleans, as column
expressions, so that a scan of raw strings stays inside generated code."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.columns import let

#: What counts as missing, and as true or false.
NULL_TOKENS = ["", "null", "NULL", "Null", "na", "NA", "n/a", "N/A", "nan", "NaN", "none", "None", "nil", "-", "--", "undefined"]
TRUE_TOKENS = ["true", "yes", "y", "1", "да", "t"]
FALSE_TOKENS = ["false", "no", "n", "0", "нет", "f"]
CURRENCY = "$€£¥₽₴₸"
#: Java's \s leaves out the no-break spaces.
BLANKS = r"\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"

#: The forms of numbers, dates and names of keys that are read.
NUMBER = r"^\d*\.?\d+(?:[eE][+-]?\d+)?$"
ISO = r"^(\d{4})-(\d{2})-(\d{2})(?:[T ](\d{2}):(\d{2})(?::(\d{2})(\.\d+)?)?)?(Z|[+-]\d{2}:?\d{2})?$"
SLASH = r"^(\d{1,2})[./](\d{1,2})[./](\d{4})(?:[T ](\d{1,2}):(\d{2})(?::(\d{2}))?)?$"
YEAR_FIRST = r"^(\d{4})[./](\d{1,2})[./](\d{1,2})$"
YEAR_MONTH = r"^(\d{4})-(\d{1,2})$"
EPOCH = (631_152_000, 4_102_444_800)  # 1990 to 2100, in seconds
ID_NAME = re.compile(r"(^|[_\s.-])(id|uuid|guid|key|code|no|num|number|ключ|код|номер)$", re.I)


def trimmed(raw: Column) -> Column:
    return F.regexp_replace(raw, f"^[{BLANKS}]+|[{BLANKS}]+$", "")


def without_null_tokens(raw: Column) -> Column:
    """Trimmed text, null where it is a token for a missing value."""
    t = trimmed(raw)
    return F.when(~t.isin(NULL_TOKENS), t)


def number_of(raw: Column, ready: bool = False) -> Column:
    """Double, or null: parentheses and minus negate, a percent sign scales,
    currency signs and blanks go, and of comma and point the last is decimal.
    Commas alone separate thousands if all groups have three digits. ``ready``
    text is trimmed already."""
    return let(raw if ready else trimmed(raw), lambda s: let(trimmed(F.regexp_replace(s, r"(?s)^\((.*)\)$", "$1")), lambda body: _signed(s, body)))


def _signed(s: Column, body: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(body, r"%$", ""), f"[{re.escape(CURRENCY)}{BLANKS}]", "")
    scale = F.when(body.endswith("%"), F.lit(0.01)).otherwise(F.lit(1.0))

    def value(p: Column) -> Column:
        negative = s.rlike(r"(?s)^\(.*\)$").cast("int") + p.startswith("-").cast("int") == 1
        return let(let(F.regexp_replace(p, r"^[+-]", ""), _digits), lambda v: F.when(negative, -v).otherwise(v) * scale)

    return let(let(plain, value), lambda x: F.when(F.abs(x) < float("inf"), x))


def _digits(digits: Column) -> Column:
    comma, point = F.contains(digits, F.lit(",")), F.contains(digits, F.lit("."))
    text = (
        F.when(comma & point & digits.rlike(r",[^.]*$"), F.regexp_replace(F.regexp_replace(digits, r"\.", ""), r"^([^,]*),", "$1."))
        .when(comma & point, F.regexp_replace(digits, ",", ""))
        .when(comma & digits.rlike(r"^[^,]*(?:,\d{3})+$"), F.regexp_replace(digits, ",", ""))
        .when(comma, F.regexp_replace(digits, r"^([^,]*),", "$1."))
        .otherwise(digits)
    )
    return let(text, lambda t: F.when(t.rlike(NUMBER), t.try_cast("double")))


def _group(s: Column, pattern: str, k: int) -> Column:
    return F.regexp_extract(s, pattern, k).try_cast("int")


def _moment(y: Column, m: Column, d: Column, seconds: Column) -> Column:
    """Microseconds of a day that may roll over into the next month."""
    months = F.make_date(F.when(y > 0, y), F.lit(1), F.lit(1))
    day = F.date_add(F.add_months(months, m - 1), d - 1)
    return F.unix_date(day).cast("long") * 86_400_000_000 + seconds


def date_of(raw: Column, day_first: bool = False) -> Column:
    """Timestamp in UTC, or null. Epoch stamps of ten or thirteen digits count
    within 1990 to 2100; day and month of slashed dates follow ``day_first``;
    days beyond the month roll over; texts of eight digits are no dates."""
    s = trimmed(raw)
    stamp = s.try_cast("long")
    zero = F.lit(0)
    clock = lambda p, k: ((F.coalesce(_group(s, p, k), zero) * 3600 + F.coalesce(_group(s, p, k + 1), zero) * 60 + F.coalesce(_group(s, p, k + 2), zero)).cast("long") * 1_000_000)
    fraction = F.coalesce((F.regexp_extract(s, ISO, 7).try_cast("double") * 1_000).cast("long") * 1_000, F.lit(0).cast("long"))
    zone = F.regexp_extract(s, ISO, 8)
    shift = F.when(zone.rlike(r"^[+-]"), F.when(zone.startswith("-"), -1).otherwise(1) * (F.substring(zone, 2, 2).try_cast("int") * 3600 + F.substring(F.regexp_replace(zone, ":", ""), 4, 2).try_cast("int") * 60)).otherwise(0)
    a, b = _group(s, SLASH, 1), _group(s, SLASH, 2)
    day, month = (a, b) if day_first else (b, a)
    iso_m, iso_d, hour, minute, second = (_group(s, ISO, k) for k in (2, 3, 4, 5, 6))
    valid = iso_m.between(1, 12) & iso_d.between(1, 31) & (F.coalesce(hour, zero) < 24) & (F.coalesce(minute, zero) < 60) & (F.coalesce(second, zero) < 60)
    micros = (
        F.when(s.rlike(r"^\d{10}$") & (stamp > EPOCH[0]) & (stamp < EPOCH[1]), stamp * 1_000_000)
        .when(s.rlike(r"^\d{13}$") & (stamp > EPOCH[0] * 1000) & (stamp < EPOCH[1] * 1000), stamp * 1000)
        .when(s.rlike(SLASH), F.when(month.between(1, 12) & day.between(1, 31), _moment(_group(s, SLASH, 3), month, day, clock(SLASH, 4))))
        .when(s.rlike(ISO), F.when(valid, _moment(_group(s, ISO, 1), iso_m, iso_d, clock(ISO, 4) + fraction - F.when(hour.isNotNull(), shift).otherwise(0).cast("long") * 1_000_000)))
        .when(s.rlike(YEAR_FIRST), _moment(_group(s, YEAR_FIRST, 1), _group(s, YEAR_FIRST, 2), _group(s, YEAR_FIRST, 3), F.lit(0).cast("long")))
        .when(s.rlike(YEAR_MONTH), _moment(_group(s, YEAR_MONTH, 1), _group(s, YEAR_MONTH, 2), F.lit(1), F.lit(0).cast("long")))
    )
    return F.timestamp_micros(micros)


_MONTH, _DAY = "(?:0?[1-9]|1[0-2])", "(?:0?[1-9]|[12][0-9]|3[01])"
_YEAR, _ANY_CLOCK = "(?!0000)[0-9]{4}", "(?:[T ][0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?)?"
#: Texts that ``date_of`` reads, epoch stamps aside, as one pattern each.
_OTHER_DATES = rf"{_YEAR}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])(?:[T ](?:[01][0-9]|2[0-3]):[0-5][0-9](?::[0-5][0-9](?:\.[0-9]+)?)?)?(?:Z|[+-][0-9]{{2}}:?[0-9]{{2}})?|{_YEAR}[./][0-9]{{1,2}}[./][0-9]{{1,2}}|{_YEAR}-[0-9]{{1,2}}"


def is_date(s: Column, day_first: bool = False) -> Column:
    """Whether ``date_of`` reads the trimmed text ``s``, without reading it."""
    a, b = (_DAY, _MONTH) if day_first else (_MONTH, _DAY)
    stamp = F.when(s.rlike("^(?:[0-9]{10}|[0-9]{13})$"), s.try_cast("long"))
    seconds = F.when(F.length(s) == 13, stamp / 1000).otherwise(stamp)
    return s.rlike(rf"^(?:{a}[./]{b}[./]{_YEAR}{_ANY_CLOCK}|{_OTHER_DATES})$") | F.coalesce((seconds > EPOCH[0]) & (seconds < EPOCH[1]), F.lit(False))


def has_clock(raw: Column) -> Column:
    """Whether a date's text has a time of day or is an epoch stamp."""
    return raw.rlike(r"[T ]\d{1,2}:\d{2}") | trimmed(raw).rlike(r"^\d{10,13}$")


def boolean_of(raw: Column) -> Column:
    t = F.lower(trimmed(raw))
    return F.when(t.isin(TRUE_TOKENS), F.lit(True)).when(t.isin(FALSE_TOKENS), F.lit(False))


def over_twelve(raw: Column, k: int) -> Column:
    """Whether component ``k`` of a slashed date exceeds 12."""
    return F.coalesce(F.regexp_extract(trimmed(raw), r"^(\d{1,2})[./](\d{1,2})[./](\d{4})", k).try_cast("int") > 12, F.lit(False))


def looks_like_id(name: str) -> bool:
    return bool(ID_NAME.search(name))
