"""Exact selection and ranks over whole tables. The driver sees counts and sums of digits or of partitions, never rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.llm.common import stored

#: Binary digits that one pass looks at; so many rows, to the power of two, come to the driver at most.
DIGIT = 12
SIGN = -(1 << 63)


def first_value(df: DataFrame, column: str, sums: dict[str, Column], fits: Callable[[dict[str, int], int], bool]) -> tuple[int | None, dict[str, int]]:
    """Of the values of a long column without nulls, ascending, the first for which fits(sums of all rows up to it, value)
    is false, and the sums of the rows below it; None and the sums of all rows if there is none. fits must not become true
    again. By radix passes, most significant digit first; a pass reads only the rows of the digit that the last one left."""
    low, high = df.agg(F.min(column), F.max(column)).head()
    before = dict.fromkeys(sums, 0)
    if low is None:
        return None, before
    while True:
        shift = max(0, ((low - SIGN) ^ (high - SIGN)).bit_length() - DIGIT)
        digit = F.call_function("shiftrightunsigned", F.col(column).bitwiseXOR(F.lit(SIGN)), F.lit(shift))
        told = df.filter(F.col(column).between(low, high)).groupBy(digit.alias("digit"))
        for row in sorted(told.agg(F.min(column).alias("low"), F.max(column).alias("high"), *(c.alias(k) for k, c in sums.items())).collect(), key=lambda r: r["low"]):
            here = {k: before[k] + row[k] for k in sums}
            if not fits(here, row["high"]):
                break
            before = here
        else:
            return None, before
        if row["low"] == row["high"]:
            return row["low"], before
        low, high = row["low"], row["high"]


def kth_key(df: DataFrame, columns: list[str], k: int) -> tuple[int, ...] | None:
    """The k-th least key (from 1) of these long columns, the first one most significant; None if there are fewer rows."""
    key: tuple[int, ...] = ()
    for c in columns:
        value, before = first_value(df, c, {"n": F.count(F.lit(1))}, lambda here, _, k=k: here["n"] < k)
        if value is None:
            return None
        k, key, df = k - before["n"], (*key, value), df.filter(F.col(c) == value)
    return key


def up_to(columns: list[str], key: tuple[int, ...]) -> Column:
    """Whether the columns' key is the given one or less."""
    told = F.lit(True)
    for c, value in reversed(list(zip(columns, key, strict=True))):
        told = (F.col(c) < value) | ((F.col(c) == value) & told)
    return told


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with its rows' places, from 1, in this order: range partitions are sorted side by side, and a place is that in
    the partition plus the counts of the partitions before it. Rows that the order leaves equal must be interchangeable."""
    parts = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("rk_at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("rk_at", 33)
    counts = parts.groupBy(part.alias("rk_part")).agg(F.count(F.lit(1)).alias("rk_n"))  # one row a partition
    before = counts.select("rk_part", (F.sum("rk_n").over(W.orderBy("rk_part")) - F.col("rk_n")).alias("rk_before"))
    place = F.col("rk_before") + F.col("rk_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return parts.withColumn("rk_part", part).join(before, "rk_part").withColumn(name, place).drop("rk_part", "rk_before", "rk_at")
