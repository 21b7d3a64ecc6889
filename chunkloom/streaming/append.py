"""A sink that appends a stream of values along an array's first axis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.selection import ranked


def append_stream(stream: DataFrame, order: str, value: str, folder: str, checkpoint: str) -> StreamingQuery:
    """Writes each micro-batch as the next cells (d0, v), in ``order``, below ``folder``.

    A batch is one folder, named by its number and written over if the batch is run
    again; where it begins is the number of cells in the folders before it. So a
    restart neither repeats nor loses cells.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = 0
        if number:
            done = spark.read.schema("d0 long, v double, batch long").parquet(folder).filter(F.col("batch") < number)
            before = done.agg(F.coalesce(F.max("d0") + 1, F.lit(0))).first()[0]
        n = batch.agg(F.max(order)).first()[0]
        cells = ranked(batch, [order], [(n or 0) + 1], "d0") if n is not None else batch.withColumn("d0", F.lit(0).cast("long")).limit(0)
        cells.select((F.col("d0") + before).alias("d0"), F.col(value).cast("double").alias("v")).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
