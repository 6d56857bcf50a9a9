"""The corpus pipeline: quality classifier, near-dedup, decontamination, secret scans, encoding.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame; all but the
last return the columns of documents.  run() writes each stage's rows as Parquet under the shared folder of
spark.checkpoint.dir and reads them again, so a lost executor costs no more than the stage at hand.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import bpe, decontaminate, secret_scan, verified, weak_quality
from quarry.llm.queries import tokenizer_file, tokenizer_pattern
from quarry.sources.shared import shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return weak_quality.keep_good(docs, weak_quality.train(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id.  Covering tables of SimHash
    fingerprints propose, and only pairs that share 0.8 of their five-word shingles are linked."""
    return verified.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with enough words of the benchmark go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are masked."""
    return secret_scan.redact(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document.  The workers have done the stages before, so they remember less than the operator's own."""
    return bpe.bpe_encode(docs, tokenizer_file("byte_bpe_50k.tiktoken"), tokenizer_pattern(), emit_ids=True, memo=100_000)


STAGES = [
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("secret_scan", secrets),
    ("bpe_encoding", encoding),
]
#: Fitted scores, fingerprints and token ids are beyond SQL; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def _store(spark: SparkSession, path: str) -> tuple:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _remove(spark: SparkSession, path: str) -> None:
    store, where = _store(spark, path)
    store.delete(where, True)


def _finished(spark: SparkSession, path: str) -> bool:
    store, where = _store(spark, f"{path}/_SUCCESS")
    return store.exists(where)


def run(spark: SparkSession, sf_dir: str, run_id: str | None = None) -> DataFrame:
    """The last stage's rows for documents.  A stage's table goes once the next one's is whole; the one that the
    result reads stays, in the shared folder, until remove(run_id).  A run that is started again under its id goes on after the last
    stage that it finished."""
    folder = f"{shared_folder(spark)}/corpus_pipeline-{run_id or uuid.uuid4().hex}"
    outs = [f"{folder}/{k}_{name}" for k, (name, _) in enumerate(STAGES[:-1])]
    done = max((k + 1 for k, out in enumerate(outs) if run_id and _finished(spark, out)), default=0)
    docs = spark.read.parquet(outs[done - 1] if done else f"{sf_dir}/documents.parquet")
    for k in range(done, len(outs)):
        STAGES[k][1](spark, docs, sf_dir).write.mode("overwrite").parquet(outs[k])
        docs = spark.read.parquet(outs[k])
        if k:
            _remove(spark, outs[k - 1])
    return STAGES[-1][1](spark, docs, sf_dir)


def remove(spark: SparkSession, run_id: str) -> None:
    """Removes what a run left in the shared folder."""
    _remove(spark, f"{shared_folder(spark)}/corpus_pipeline-{run_id}")
