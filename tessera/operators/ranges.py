"""First of many, possibly overlapping, ranges of days that holds a day, by an equi-join on nested bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.lineage import sized, written

#: Days before 1970 and levels of bins, each twice as long as those below: dates of all years from 1 to 9999 fit.
BEFORE, LEVELS = 1 << 20, 23


def number(day: str | Column) -> Column:
    return F.unix_date(F.to_date(day)).cast("long") + BEFORE


def bins(start: Column, end: Column) -> Column:
    """The fewest bins (level, bin) that make up the days from ``start`` to ``end``, at most two of a level: from either end, the odd ones that the level above can't cover."""

    def of(level: Column) -> Column:
        width = F.call_function("shiftleft", F.lit(1).cast("long"), level)
        first = F.floor((start + width - 1) / width)
        behind = F.floor((end + 1) / width)
        odd = lambda x: F.pmod(x, F.lit(2)) == 1
        lower = F.when((first < behind) & odd(first), F.struct(level.alias("level"), first.alias("bin")))
        upper = F.when((first < behind) & odd(behind), F.struct(level.alias("level"), (behind - 1).alias("bin")))
        return F.array(lower, upper)

    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), of)))


def first_range(points: DataFrame, ranges: DataFrame, day: str, rank: str) -> DataFrame:
    """``points`` with ``rank``: the least of ``ranges`` (rank, start, end) that holds the day, null where none does.

    A range goes to the few bins that make it up and a day to its one bin of each level, so a day and a range that
    holds it meet in one bin and nothing else is compared. Of a bin's ranges only the least is kept, and days are
    looked up once each, so neither a popular day nor a million ranges over one day make a hot key. Ranges without a
    start or end, or that end before they start, hold no day; a null day is in none.
    """
    place = bins(number("start"), number("end"))
    least = ranges.select(rank, F.inline(place)).groupBy("level", "bin").agg(F.min(rank).alias(rank))
    days = points.select(F.to_date(day).alias("_day")).where("_day is not null").distinct()
    at = F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda k: F.struct(k.alias("level"), F.call_function("shiftright", number("_day"), k).alias("bin")))
    found = days.select("_day", F.inline(at)).join(least, ["level", "bin"]).groupBy("_day").agg(F.min(rank).alias(rank))
    return points.withColumn("_day", F.to_date(day)).join(sized(written(found)), "_day", "left").drop("_day")
