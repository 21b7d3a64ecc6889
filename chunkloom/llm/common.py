"""Helpers that several of the training-data operators share."""

from __future__ import annotations

import ctypes
import os
import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that parts words, and the same as a character class.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Where it is unset, and driver and executors are one
    process (as in tests), a temporary folder; on a cluster that is an error, as executors could not see it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir is unset: name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(os.path.join(tempfile.gettempdir(), f"chunkloom-{uuid.uuid4().hex}"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: a reliable checkpoint in the shared folder, so a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def give_back() -> None:
    """Hand what this process has freed back to the system; else a Python worker keeps the most that any task of it took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None
    if trim:
        trim(0)


def lean(work: Callable[..., Any]) -> Callable[..., Any]:
    """``work`` on a group's table, or on a table from either side; what it leaves behind is given back after each group."""

    def one(table: pa.Table) -> pa.Table:
        try:
            return work(table)
        finally:
            give_back()

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return work(left, right)
        finally:
            give_back()

    return one if work.__code__.co_argcount == 1 else two


def lean_batches(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` on a partition's batches; what it leaves behind is given back at the partition's end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def in_one_task(rows: DataFrame, make: Callable[[list[dict]], Any]) -> Any:
    """What ``make`` returns for a bounded number of rows, called in a task: the driver gets the result alone."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [row for batch in batches for row in batch.to_pylist()]
        yield pa.RecordBatch.from_pydict({"made": pa.array([pickle.dumps(make(got))], pa.binary())})

    made = rows.repartition(1).mapInArrow(lean_batches(work), "made binary").first()
    return pickle.loads(made["made"]) if made else make([])


def sampled_texts(docs: DataFrame, marks: DataFrame, sample: int, label: str) -> DataFrame:
    """(text, label) of at most ``sample`` different documents, those whose id hashes lowest; ids and hashes of texts are
    picked first, so that whole texts move for these alone. marks: (doc_id, text_hash, label), a row for each."""
    picked = marks.orderBy(F.xxhash64("doc_id"), "doc_id", "text_hash").limit(sample)
    picked = F.broadcast(picked.select(F.col("doc_id").alias("own_id"), F.col("text_hash").alias("own_hash"), label))
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    rows = texts.join(picked, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("text_hash") == F.col("own_hash")))
    return rows.select("doc_id", "text_hash", "text", label).dropDuplicates(["doc_id", "text_hash"])


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def word_array(text: Column) -> Column:
    """The words of a text; null and blank texts have none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_CLASS + "+"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_CLASS + "+")), F.lit(0)).cast("long")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
