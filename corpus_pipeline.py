"""Corpus pipeline: quality rules, near duplicates, decontamination, secrets, SentencePiece.

Every stage takes what its predecessor wrote and returns documents with all their columns; the
last one returns their pieces.

1. quality: documents that the rules reject go (op 9).
2. near_duplicates: of every group linked by J >= 0.8 over five-word shingles, the document with
   the smallest doc_id stays. Of several rows of one doc_id one stays: the least by the hash of the
   text, then of the whole row, so a retry keeps the same. Rows without doc_id stay (op 2).
3. decontamination: documents that contain a benchmark item go (op 10).
4. secrets: every secret in a text is replaced by its kind; n_chars follows (op 6).
5. pieces: doc_id, n_tokens, ids and whether the ids decode to the text (op 5).

Nulls, empty texts and empty tables have the results that the operators define.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeflow.llm import decontamination, near_duplicates, pieces, quality, secrets
from noticeflow.llm.queries import PIECES, table
from noticeflow.session import bounded_batches, materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def bounded(stage: Stage) -> Stage:
    """A stage whose Arrow batches hold bounded bytes, also where it runs alone."""

    @wraps(stage)
    def run_bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        return stage(spark, docs, sf_dir)

    return run_bounded


@bounded
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


@bounded
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = near_duplicates.near_duplicates(docs)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone"))
    named = docs.where("doc_id IS NOT NULL").join(gone.hint("merge"), docs.doc_id.cast("long") == gone["__gone"], "left_anti")
    plain = [F.to_json(F.struct(f.name)) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(f.name) for f in docs.schema]
    first = Window.partitionBy(docs.doc_id).orderBy(F.xxhash64(docs.text), F.xxhash64(*plain))
    place = _free("place", docs.columns)
    one = named.withColumn(place, F.row_number().over(first)).where(F.col(place) == 1).drop(place)
    return one.unionByName(docs.where("doc_id IS NULL"))


def _free(name: str, taken: list[str]) -> str:
    """A column name that the table does not have."""
    while name in taken:
        name = f"_{name}"
    return name


@bounded
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


@bounded
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


@bounded
def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs, pieces.load(PIECES))


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("pieces", encode_pieces),
]

#: Shingle joins, learned rules and pieces are not for SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
