"""What the operators share: checkpoints, column names, Arrow helpers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.shared import shared_folder

#: Text bytes that a worker handles at once; bounds its memory.
CHUNK_BYTES = 2 << 20
#: Tables up to this size by Spark's own estimate are dealt to all cores if their files don't do so.
SMALL = 64 << 20
#: Rows of an Arrow batch, at most: whole texts of 10,000 rows (Spark's own bound) would fill JVM and worker several times over.
BATCH_ROWS = 2000


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once into the shared checkpoint folder; its lineage ends there."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def col(df: DataFrame, name: str) -> Column:
    """The column of that very name, dots and all."""
    return df["`" + name.replace("`", "``") + "`"]


def fresh(df: DataFrame, name: str) -> str:
    """A name like this that no column of df has (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def spread(df: DataFrame) -> DataFrame:
    """df; a small table in fewer pieces than there are cores (one file, one row group) is dealt out first."""
    small_batches(df.sparkSession)
    cores = df.sparkSession.sparkContext.defaultParallelism
    plans = df._jdf.queryExecution()
    if int(str(plans.optimizedPlan().stats().sizeInBytes())) > SMALL or "Exchange" in plans.executedPlan().toString():
        return df  # large, or dealt out already (and counting its pieces would run its shuffles)
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's bound on rows of an Arrow batch to BATCH_ROWS."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns that matter, under fixed names; other columns can't clash with ours."""
    return spread(docs.select(col(docs, id_col).cast("long").alias("doc_id"), col(docs, text_col).cast("string").alias("text")))


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return pc.fill_null(column, "").cast(pa.binary()).to_pylist()


def chunks(batches: Iterator[pa.RecordBatch], text: str | int = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut into slices of about `most` bytes of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        a = total = 0
        for b, x in enumerate(size.tolist()):
            if total and total + x > most:
                yield batch.slice(a, b - a)
                a, total = b, 0
            total += x + 1
        yield batch.slice(a)


def total_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of text, for sizing buckets."""
    return docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
