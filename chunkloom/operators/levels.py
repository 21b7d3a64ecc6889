"""Running results in two levels: within cells of the key's range, and over one row per cell.

A window over a whole table runs in one task. Here the key's range is cut into at most
``cells`` equal cells; windows run within cells, and the one window without a partition
is over a row for each cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELLS = 4096


def celled(df: DataFrame, key: str, cells: int = CELLS) -> DataFrame:
    """Adds __cell, which grows with the key (a whole number); an empty table stays so."""
    bounds = df.agg(F.min(key).alias("lo"), F.max(key).alias("hi")).first()
    lo, hi = (bounds["lo"], bounds["hi"]) if bounds["lo"] is not None else (0, 0)
    return df.withColumn("__cell", F.call_function("div", F.col(key) - F.lit(lo).cast("long"), F.lit(max(1, -(-(hi - lo + 1) // cells))).cast("long")))


def _before() -> object:
    return Window.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)


def running_sum(df: DataFrame, key: str, value: str, name: str, cells: int = CELLS) -> DataFrame:
    """Adds the sum of value over all rows up to this one, in order of the key, which doesn't repeat."""
    df = celled(df, key, cells)
    sums = df.groupBy("__cell").agg(F.sum(value).alias("__sum"))
    sums = sums.select("__cell", F.coalesce(F.sum("__sum").over(_before()), F.lit(0)).alias("__base"))
    inner = F.sum(value).over(Window.partitionBy("__cell").orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("__inner", inner).join(F.broadcast(sums), "__cell").withColumn(name, F.col("__base") + F.col("__inner")).drop("__cell", "__base", "__inner")


def previous(df: DataFrame, key: str, value: str, name: str, cells: int = CELLS) -> DataFrame:
    """Adds the value of the row before, in order of the key, which doesn't repeat; null for the first."""
    df = celled(df, key, cells)
    lasts = df.groupBy("__cell").agg(F.max_by(value, key).alias("__end"))
    lasts = lasts.select("__cell", F.lag("__end").over(Window.orderBy("__cell")).alias("__end"))
    inner = Window.partitionBy("__cell").orderBy(key)
    first, lag = F.row_number().over(inner) == 1, F.lag(value).over(inner)
    df = df.withColumn("__first", first).withColumn("__lag", lag).join(F.broadcast(lasts), "__cell")
    return df.withColumn(name, F.when(F.col("__first"), F.col("__end")).otherwise(F.col("__lag"))).drop("__cell", "__end", "__first", "__lag")


def absorbed(pieces: DataFrame, joins: Column, *sums: str, top: str | None = None) -> DataFrame:
    """Pieces (__cell, s, ..) that join what comes before them, put into it; only the first pieces of a cell may join.

    ``sums`` are added up and of ``top`` the largest counts. What takes others in is the
    last piece of its cell that doesn't join, so one row per cell is all that is ordered.
    """
    df = pieces.withColumn("__joins", F.coalesce(joins, F.lit(False)))
    others = [c for c in pieces.columns if c not in ("__cell", "s")]
    own = F.max(F.when(~F.col("__joins"), F.struct("s", *others))).alias("__own")
    gains = [F.sum(F.when(F.col("__joins"), F.col(c))).alias(f"__{c}") for c in sums] + ([F.max(F.when(F.col("__joins"), F.col(top))).alias(f"__{top}")] if top else [])
    cells = df.groupBy("__cell").agg(own, *gains)
    head = F.last(F.when(F.col("__own").isNotNull(), F.col("__cell")), ignorenulls=True).over(_before())
    gained = cells.withColumn("__head", head).groupBy("__head").agg(*(F.sum(f"__{c}").alias(f"+{c}") for c in sums), *([F.max(f"__{top}").alias(f"+{top}")] if top else []))
    ends = cells.filter("__own is not null").select("__cell", "__own.*").join(gained, F.col("__cell") == F.col("__head"), "left")
    for c in sums:
        ends = ends.withColumn(c, F.col(c) + F.coalesce(F.col(f"+{c}"), F.lit(0)))
    if top:
        ends = ends.withColumn(top, F.greatest(top, F.coalesce(F.col(f"+{top}"), F.col(top))))
    whole = ["s", *others]
    inner = df.filter(~F.col("__joins")).join(F.broadcast(cells.select("__cell", F.col("__own.s").alias("__end"))), "__cell").filter("s <> __end").select(*whole)
    return inner.unionByName(ends.select(*whole))
