"""Wall-clock arithmetic on epoch seconds that does not depend on the session time zone.

Day, hour and five-minute window are read off a zone-less timestamp in an explicit zone, so one cluster can serve several
cities and a test gives the same answer whatever the session zone is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from headwise.schemas import WINDOW_SECONDS

UNIX_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def local_time(epoch_seconds: Column, zone: str = "UTC") -> Column:
    """Wall-clock (TIMESTAMP_NTZ) of an epoch second in ``zone``; NULL stays NULL."""
    utc = F.timestamp_add("SECOND", epoch_seconds, F.expr(UNIX_EPOCH))
    return utc if zone == "UTC" else F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def instant_to_local(instant: Column, zone: str = "UTC") -> Column:
    """Wall-clock of an absolute TIMESTAMP, keeping microseconds."""
    utc = F.timestamp_add("MICROSECOND", F.unix_micros(instant), F.expr(UNIX_EPOCH))
    return utc if zone == "UTC" else F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def epoch_sql(column: str) -> str:
    """Whole epoch seconds of a zone-less UTC timestamp, as SQL. Read off its fields: ``timestampdiff`` would pass through
    the session zone."""
    return (
        f"(datediff(to_date({column}), date'1970-01-01') * 86400L + hour({column}) * 3600L + minute({column}) * 60L"
        f" + second({column}))"
    )


def window_start(epoch_seconds: Column, zone: str = "UTC", seconds: int = WINDOW_SECONDS) -> Column:
    """Start of the tumbling window that holds the instant (floor, also before 1970)."""
    return local_time(epoch_seconds - F.pmod(epoch_seconds, F.lit(seconds).cast("bigint")), zone)
