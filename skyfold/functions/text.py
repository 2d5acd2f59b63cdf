"""Small text and time helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 of a zone-less timestamp, to the microsecond."""
    origin = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00"))
    return F.timestamp_diff("MICROSECOND", origin, ts.cast("timestamp_ntz")) / F.lit(1e6)


def clock_seconds(text: Column) -> Column:
    """The first hours:minutes:seconds of the text as seconds; 0 when there is none.

    Hours may have any number of digits; a fraction of one to six digits may
    follow a point or a comma.
    """
    clock = F.regexp_substr(text, F.lit(r"[0-9]+(:[0-5]?[0-9]){2}([.,][0-9]{1,6})?"))
    fields = F.transform(F.split(F.translate(clock, ",", "."), ":"), lambda s: s.cast("double"))
    return F.coalesce(F.aggregate(fields, F.lit(0.0), lambda total, field: total * 60 + field), F.lit(0.0))


# Signs, a bare fraction and an exponent are allowed; a unit may follow.
_NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"


def labelled_number(text: Column, names: str) -> Column:
    """The number after ``name:`` or ``name=``, names being a regex alternation that no letter or digit precedes."""
    labelled = F.regexp_substr(text, F.lit(rf"(?i)(?<![a-z0-9])(?:{names})\s*[:=]\s*{_NUMBER}"))
    return F.regexp_substr(labelled, F.lit(_NUMBER + "$")).try_cast("double")


def filled(c: Column) -> Column:
    """NULL for an empty or blank string."""
    return F.nullif(F.trim(c), F.lit(""))


def frame_name(index: Column) -> Column:
    return F.format_string("frame_%06d", index)
