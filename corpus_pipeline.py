"""A training corpus from documents: language, repeated lines, near copies, benchmark text, token ids.

Every stage takes the session, the rows that the stage before kept, and the folder of the tables; all but
the last return the columns of documents. Stages are written as Parquet and read again between each other.

Null texts go in the first stage, as do empty ones. Rows that repeat an id are one document for lines and for
near copies: they stay or go together. A null id comes before all others for lines and is no copy of anything.
Texts of any length are taken whole, empty tables give empty tables, and extra columns, whatever their names,
are carried along to the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from colligate.llm import bpe, decontaminate, language_id, line_dedup, near_dup
from colligate.llm.queries import vocabulary
from colligate.llm.shared import table, written

#: A text whose vector is farther than this from every language is rejected, as are texts without letters.
LEAST_SCORE = 0.05


def _names(docs: DataFrame, *wanted: str) -> tuple[str, ...]:
    """Names for added columns that no column of docs has, whatever its case."""
    taken = {c.lower() for c in docs.columns}
    longest = max(map(len, taken), default=0)
    return tuple(w if w not in taken else w + "_" * longest for w in wanted)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, without text, or like no language go. A tie goes to the first language by name."""
    lang, score = _names(docs, "cg_lang", "cg_score")
    found = language_id.identify(docs, language_id.learn(docs), added=(lang, score))
    kept = (F.col(lang) != language_id.UNKNOWN) & (F.col(score) >= LEAST_SCORE)
    return found.where(kept).select(docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later matches of earlier lines go from the texts; a document left without any word goes.

    A text of null stays as it is.
    """
    lines, removed = _names(docs, "cg_lines", "cg_removed")
    found = line_dedup.dedup_lines(docs, added=(lines, removed))
    kept = (F.col(removed) == 0) | F.col("text").rlike(r"\S")
    columns = [F.coalesce(F.char_length("text").cast("long"), F.col(c)).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return found.where(kept).select(*columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays; texts of null and null ids stay."""
    found = near_dup.near_duplicates(docs)
    gone = written(found.where("not kept").select("doc_id").distinct(), spark)
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go; texts of null stay."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def encode_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the hashes of ids and decoded text; a text of null has no ids."""
    return bpe.encode_documents(docs, vocabulary("byte_bpe_50k.json"), decoded=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("decontamination", decontaminate_documents),
    ("bpe", encode_documents),
]

#: BPE encoding and language vectors have no SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), spark)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
