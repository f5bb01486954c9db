"""As-of joins: to the next own trading day, or to the last snapshot before.

Both are a union and one window over the key, so a key's rows are sorted once and nothing grows with the
product of the sides.
"""

from __future__ import annotations

from datetime import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CUTOFF = time(15, 30)


def effective_date(ts: Column, cutoff: time = CUTOFF) -> Column:
    """The day, or the next one for what comes after the cutoff."""
    seconds = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.extract(F.lit("SECOND"), ts).cast("double")
    limit = cutoff.hour * 3600 + cutoff.minute * 60 + cutoff.second
    return F.date_add(F.to_date(ts), (seconds > limit).cast("int"))


def forward(left: DataFrame, date: str, calendar: DataFrame, by: list[str], out: str = "trade_date") -> DataFrame:
    """Each left row with the least calendar day on or after `date`; rows beyond the calendar go.

    calendar: `by` columns and trade_date. Left rows with a null date go too.
    """
    names = left.columns
    row = F.struct(*[F.col(c) for c in names if c not in by])
    events = left.where(F.col(date).isNotNull()).select(*by, F.col(date).alias("_at"), F.lit(0).alias("_side"), row.alias("_row"))
    days = calendar.select(*by, F.col("trade_date").alias("_at")).distinct().select("*", F.lit(1).alias("_side"), F.lit(None).cast(events.schema["_row"].dataType).alias("_row"))
    part = by or [F.lit(0)]
    # latest first: a frame that grows is summed up once, one that shrinks would be read again for each row
    w = Window.partitionBy(*part).orderBy(F.desc("_at"), F.desc("_side")).rowsBetween(Window.unboundedPreceding, 0)
    day = F.last(F.when(F.col("_side") == 1, F.col("_at")), ignorenulls=True).over(w)
    both = events.unionByName(days).withColumn(out, day).where((F.col("_side") == 0) & F.col(out).isNotNull())
    return both.select(*[F.col(c) if c in by else F.col("_row")[c].alias(c) for c in names], out)


def backward_intervals(snapshots: DataFrame, date: str) -> DataFrame:
    """Distinct snapshot days with the day each one ends, for an interval join; a few hundred rows of months."""
    days = snapshots.select(F.col(date).alias("effective_date")).distinct()
    w = Window.orderBy("effective_date")
    return days.select("effective_date", F.lead("effective_date").over(w).alias("_next"))


def backward(left: DataFrame, date: str, snapshots: DataFrame, snapshot_date: str) -> DataFrame:
    """Each left row with the last snapshot day on or before its date, null before the first."""
    days = left.select(F.col(date).alias("_d")).distinct()
    marks = days.select("_d", F.lit(0).alias("_s")).unionByName(snapshots.select(F.col(snapshot_date).alias("_d"), F.lit(-1).alias("_s")).distinct())
    month = Window.orderBy("_d", "_s").rowsBetween(Window.unboundedPreceding, 0)  # over distinct days only
    found = marks.withColumn("effective_date", F.last(F.when(F.col("_s") == -1, F.col("_d")), ignorenulls=True).over(month)).where("_s = 0").drop("_s")
    return left.join(found, left[date] == found["_d"], "left").drop("_d")
