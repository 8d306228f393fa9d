"""Durations, stamps and percentages as columns; "now" is always an argument."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-free timestamp, whatever the session time zone is."""
    since = ts.cast("timestamp_ntz") - F.expr(_EPOCH)

    def part(unit: str) -> Column:
        return F.extract(F.lit(unit), since)

    whole = (part("DAY").cast("bigint") * 24 + part("HOUR")) * 60 + part("MINUTE")
    return whole * 60_000_000 + (part("SECOND") * 1_000_000).cast("bigint")


def elapsed_text(seconds: Column) -> Column:
    """``H:MM:SS`` with a day count in front from one day on, fractions cut off."""
    whole = F.floor(seconds).cast("bigint")
    days = F.floor(whole / 86400)
    rest = F.pmod(whole, F.lit(86400))
    clock = F.format_string("%d:%02d:%02d", F.floor(rest / 3600), F.floor(rest % 3600 / 60), rest % 60)
    prefix = (F.when(days == 0, F.lit(""))
              .when(F.abs(days) == 1, F.format_string("%d day, ", days))
              .otherwise(F.format_string("%d days, ", days)))
    return F.when(whole.isNotNull(), F.concat(prefix, clock))


def parse_created_at(text: Column) -> Column:
    """ISO text (``Z`` or an offset allowed) or epoch seconds, as a UTC zone-free timestamp."""
    iso = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?"
    zone = F.regexp_extract(text, r"([+-])(\d{2}):?(\d{2})$", 0)
    local = F.regexp_extract(text, iso, 0).try_cast("timestamp_ntz")
    sign = F.when(F.startswith(zone, F.lit("-")), -1).otherwise(1)
    minutes = F.when(
        text.rlike(r"T.*[+-]\d{2}:?\d{2}$"),
        sign * (F.substring(zone, 2, 2).cast("int") * 60 + F.right(zone, F.lit(2)).cast("int"))
    ).otherwise(0)
    from_iso = F.timestamp_add("MINUTE", -minutes, local)
    from_epoch = F.timestamp_add("SECOND", _epoch_number(text), F.expr(_EPOCH))
    return F.when(text.rlike(r"^\d+$"), from_epoch).when(text.rlike(iso), from_iso)


def _epoch_number(text: Column) -> Column:
    return F.when(text.rlike(r"^\d{1,15}$"), text.try_cast("bigint"))


def percent_text(done: Column, total: Column) -> Column:
    return F.concat(percent(done, total).cast("string"), F.lit("%"))


def percent(done: Column, total: Column) -> Column:
    """Whole percent done; a missing or zero total counts as one."""
    return F.floor(F.lit(100) * F.coalesce(done, F.lit(0)) / usable_total(total)).cast("bigint")


def usable_total(total: Column) -> Column:
    return F.when(total.isNull() | (total == 0), F.lit(1)).otherwise(total)


def eta_seconds(created_at: Column, now: Column, done: Column, total: Column) -> Column:
    """Remaining seconds at the pace so far, null unless some but not all is done."""
    elapsed = (epoch_micros(now) - epoch_micros(created_at)) / F.lit(1e6)
    done, total = F.coalesce(done, F.lit(0)), usable_total(total)
    return F.when((done > 0) & (done < total), F.floor(elapsed * (total - done) / done).cast("bigint"))


def eta_text(created_at: Column, now: Column, done: Column, total: Column) -> Column:
    return F.coalesce(elapsed_text(eta_seconds(created_at, now, done, total)), F.lit("n/a"))
