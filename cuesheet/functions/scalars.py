"""Column expressions that the planning operators are made of."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def align_down(frames: Column | str, base: Column | str | int) -> Column:
    """The largest multiple of ``base`` up to ``frames``."""
    f, b = _col(frames), _col(base)
    return (F.floor(f / b) * b).cast("long")


def align_up(frames: Column | str, base: Column | str | int) -> Column:
    """The smallest multiple of ``base`` from ``frames`` on; 0 for anything up to 0."""
    f, b = _col(frames), _col(base)
    return F.when(f <= 0, F.lit(0)).otherwise(F.ceil(f / b) * b).cast("long")


def truncated(x: Column | str) -> Column:
    """Towards zero, as a whole number."""
    return _col(x).cast("long")


def half_even(x: Column | str) -> Column:
    """The nearest whole number, halves to the even one."""
    return F.bround(_col(x)).cast("long")


def half_up(x: Column | str) -> Column:
    """The nearest whole number, halves upwards (also below zero)."""
    return F.floor(_col(x) + 0.5)


def floored_half(x: Column | str) -> Column:
    return F.floor(_col(x) / 2)


def clamp(x: Column | str, low: Column | float, high: Column | float) -> Column:
    return F.greatest(F.least(_col(x), _col(high)), _col(low))


def pad3(n: Column | str) -> Column:
    """Three digits at least; larger numbers keep all of theirs."""
    return F.format_string("%03d", _col(n))


def sanitized(name: Column | str) -> Column:
    """Without the characters that file names must not have."""
    return F.regexp_replace(_col(name), r'[\\/*?:"<>|]', "")


def unquoted(path: Column | str) -> Column:
    """Without white space and one double quote at either end."""
    return F.regexp_replace(F.regexp_replace(F.trim(_col(path)), '^"', ""), '"$', "")


def extension(name: Column | str) -> Column:
    """Lower-case, with its dot; empty where there is none."""
    return F.lower(F.regexp_extract(_col(name), r"(\.[^./]+)$", 1))


def stem(name: Column | str) -> Column:
    return F.regexp_replace(_col(name), r"\.[^./]+$", "")


def has_extension(name: Column | str, extensions: tuple[str, ...]) -> Column:
    return extension(name).isin(*extensions)


def within(base: Column | str, path: Column | str) -> Column:
    """Whether ``path`` is ``base`` or lies below it; a longer name with the same beginning doesn't."""
    b, p = F.regexp_replace(_col(base), "/+$", ""), _col(path)
    return ~p.rlike(r"(^|/)\.\.(/|$)") & ((p == b) | p.startswith(F.concat(b, F.lit("/"))))


def affixed(prefix: Column | str, text: Column | str, suffix: Column | str) -> Column:
    return F.concat(*(F.coalesce(_col(x), F.lit("")) for x in (prefix, text, suffix)))


def safe_int(value: Column | str, default: int = 0) -> Column:
    return F.coalesce(_col(value).try_cast("double").cast("long"), F.lit(default).cast("long"))


def clock(seconds: Column | str) -> Column:
    """m:ss.ff"""
    s = _col(seconds)
    return F.format_string("%d:%05.2f", F.floor(s / 60), s - F.floor(s / 60) * 60)


def leading_number(name: Column | str) -> Column:
    """The digits a name begins with, as a number; null where there are none."""
    return F.regexp_extract(_col(name), r"^(\d+)", 1).try_cast("long")


def numbered_name(n: Column | str, name: Column | str) -> Column:
    """``NNN_name``, where one number of three digits that ``name`` has already is replaced."""
    return F.concat(pad3(n), F.lit("_"), F.regexp_replace(_col(name), r"^\d{3}_(.+)", "$1"))
