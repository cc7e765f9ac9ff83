"""Deduplication and order: first wins, adjacent repeats, outermost intervals, canonical ranks.

Nothing here relies on the order of rows; each operator takes the columns that
say what comes first, ending in a unique one.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Cols = Sequence[str | Column]


def first_wins(df: DataFrame, keys: Cols, order: Cols) -> DataFrame:
    """One row for each key: the first in order (null keys are a key). Spark limits each group before the shuffle."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_nth", nth).filter("_nth = 1").drop("_nth")


def filter_then_first(df: DataFrame, test: Column, keys: Cols, order: Cols) -> DataFrame:
    """The first copy that passes the test."""
    return first_wins(df.filter(test), keys, order)


def first_then_filter(df: DataFrame, test: Column, keys: Cols, order: Cols) -> DataFrame:
    """The first copy, if it passes the test: later copies are never looked at."""
    return first_wins(df, keys, order).filter(test)


def adjacent_dedup(df: DataFrame, within: Cols, order: Cols, same: Sequence[str]) -> DataFrame:
    """Drops a row that equals the one before it in `same`, nulls being equal; equal rows that others separate stay."""
    w = Window.partitionBy(*within).orderBy(*order)
    before = df.withColumn("_before", F.lag(F.struct(*same)).over(w)).withColumn("_now", F.struct(*same))
    return before.filter(~F.col("_now").eqNullSafe(F.col("_before"))).drop("_before", "_now")


def outermost_intervals(df: DataFrame, within: Cols, start: str, end: str, tie: Cols = ()) -> DataFrame:
    """Keeps an interval that begins at or after the end of all before it: drops those nested in another."""
    w = Window.partitionBy(*within).orderBy(start, F.desc(end), *tie).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_reach", F.max(end).over(w)).filter(F.col("_reach").isNull() | (F.col(start) >= F.col("_reach"))).drop("_reach")


def largest(df: DataFrame, within: Cols, size: str | Column, tie: Cols) -> DataFrame:
    """The row with the greatest size in each group; the first in `tie` among equals."""
    size = F.col(size) if isinstance(size, str) else size
    return first_wins(df, within, [size.desc(), *tie])


def ordinal(col: Column, order: Sequence[str]) -> Column:
    """Position of a value in a closed vocabulary, for sorts by ordinal; unknown values come last."""
    pairs = ((F.lit(v), k) for k, v in enumerate(order))
    first = next(pairs)
    chain = reduce(lambda c, p: c.when(col == p[0], p[1]), pairs, F.when(col == first[0], first[1]))
    return chain.otherwise(len(order))


def canonical_rank(df: DataFrame, within: Cols, order: Cols, name: str = "rank") -> DataFrame:
    """Numbers rows from 1 in a total order; give nulls their place in `order` (asc_nulls_first)."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*within).orderBy(*order)))


def renamed_on_collision(df: DataFrame, key: str, kind: str, order: Cols, name: str = "name") -> DataFrame:
    """The first row of a key keeps it; a later one is named key + kind; what collides again is dropped."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    named = df.withColumn("_again", nth > 1)
    named = named.withColumn(name, F.when(F.col("_again"), F.concat(F.col(key), F.col(kind))).otherwise(F.col(key)))
    return first_wins(named, [name], ["_again", *order]).drop("_again")


def unique_suffix(df: DataFrame, name: str, order: Cols, out: str = "unique_name") -> DataFrame:
    """Makes names unique: the second of a name gets 2, and so on."""
    nth = F.row_number().over(Window.partitionBy(name).orderBy(*order))
    return df.withColumn("_n", nth).withColumn(out, F.when(F.col("_n") == 1, F.col(name)).otherwise(F.concat(F.col(name), F.col("_n").cast("string")))).drop("_n")


def capped(df: DataFrame, order: Cols, most: int) -> tuple[DataFrame, DataFrame]:
    """(first rows in order, one row with how many more there are)."""
    return df.orderBy(*order).limit(most), df.agg(F.greatest(F.count("*") - most, F.lit(0)).alias("more"))
