"""Number, duration and date formatting as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_fixed2(x: Column) -> Column:
    """Two decimals of a double, half up on its exact binary value, so 1.005 gives 1.00.

    |x| * 100 is not a double; its rounding error is recovered exactly
    (Dekker's product), and decides a value that seems to lie half way.
    """
    a = F.abs(x)
    p = a * 100.0
    big = a * 134217729.0
    hi = big - (big - a)
    error = (hi * 100.0 - p) + (a - hi) * 100.0
    whole = F.floor(p)
    n = (whole + F.when((p - whole) + error >= 0.5, 1).otherwise(0)).cast("decimal(30,0)")
    digits = F.lpad(F.pmod(n, F.lit(100).cast("decimal(30,0)")).cast("string"), 2, "0")
    sign = F.when((x < 0) & (n > 0), "-").when(x < 0, "-").otherwise("")
    return F.concat(sign, F.floor(n / F.lit(100)).cast("decimal(30,0)").cast("string"), F.lit("."), digits)


def clock(seconds: Column) -> Column:
    """HH:MM:SS."""
    s = F.floor(seconds).cast("bigint")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60)))


def short_duration(seconds: Column) -> Column:
    """h:m:ss with zero parts left out and nothing padded; hours modulo 24."""
    part = lambda div, mod: F.floor(F.pmod(seconds.cast("double") / div, F.lit(mod).cast("double"))).cast("bigint")
    h, m = part(3600, 24), part(60, 60)
    s = F.floor(F.pmod(seconds.cast("double"), F.lit(60.0))).cast("bigint")
    return F.concat(F.when(h > 0, F.concat(h, F.lit(":"))).otherwise(""), F.when(m > 0, F.concat(m, F.lit(":"))).otherwise(""), s, F.lit("s"))


def megabytes(size: Column) -> Column:
    return F.concat(to_fixed2(size / F.lit(1048576.0)), F.lit(" MB"))


def day(date: Column) -> Column:
    return F.coalesce(F.date_format(date, "EEE MMM dd yyyy"), F.lit("Unknown"))


#: Date tokens and what they mean in Spark's patterns; WW, a and A are made apart.
TOKENS = {"YYYY": "yyyy", "YY": "yy", "MMMM": "MMMM", "MMM": "MMM", "MM": "MM", "M": "M", "DD": "dd", "D": "d", "DDDD": "EEEE", "DDD": "EEE", "HH": "HH", "H": "H", "hh": "hh", "h": "h", "mm": "mm", "m": "m", "ss": "ss", "s": "s"}


def date_token(date: Column, token: str) -> Column:
    """A token's text, empty for a missing date. Weeks are ISO weeks, whatever year stands beside them."""
    if token == "WW":
        out = F.lpad(F.weekofyear(date).cast("string"), 2, "0")
    elif token in ("a", "A"):
        out = F.when(F.hour(date) < 12, "AM").otherwise("PM")
        out = F.lower(out) if token == "a" else out
        out = F.when(date.isNotNull(), out)
    else:
        out = F.date_format(date, TOKENS[token])
    return F.coalesce(out, F.lit(""))


def coerce_date(*texts: Column) -> Column:
    """The first text that reads as a time, else null."""
    forms = ("yyyy-MM-dd HH:mm:ss", "yyyy:MM:dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd")
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for t in texts for f in forms])
