"""Corpus pipeline: five stages over ``documents``, each written as Parquet and read by the next.

``docs`` may have any columns beside doc_id and text; each stage but the last returns the
columns that it was given.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairground.llm import line_dedup, ngram_join, packing, suffix_dedup, toxicity
from fairground.llm.common import stored, table
from fairground.llm.queries import PATTERN, RANKS, TOKENIZER, toxicity_model


#: Passages of over 50 words go: 200 bytes are 50 words of three letters and a space.
REPEATS = suffix_dedup.Settings(length=200, seed=64)


def _applied(docs: DataFrame, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``operator`` on id and text; other columns travel in a struct, so their names can't clash."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    carried = F.struct(F.lit(0).alias("nothing"), *[F.col(f"`{c}`") for c in others]).alias("carried")
    out = operator(docs.select("doc_id", "text", carried))
    return out.select([F.col("carried").getField(c).alias(c) if c in others else F.col(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the table's training folds.

    A null or empty text is judged like any text without words. Each row is judged by itself,
    so rows that repeat go or stay together.
    """
    model = toxicity_model(spark, sf_dir)
    return _applied(docs, lambda d: toxicity.score_documents(d, model).where("predicted = 0"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand in three documents or more go from all but the one with the largest id.

    No document goes: one that loses all lines becomes an empty text, and so does a null
    text. Rows that repeat an id count as one document.
    """
    return _applied(docs, line_dedup.dedup_lines)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id stays.

    Documents without words (null and empty texts, too) all stay. Of rows that repeat the
    smallest id and its text, one stays.
    """
    return _applied(docs, ngram_join.keep_one)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of repeated strings of ``REPEATS.length`` go from all copies; documents stay, also those that become empty.

    Null texts are empty ones. Rows that repeat an id and a text are copies of each other.
    """
    return _applied(docs, lambda d: suffix_dedup.dedup_spans(d, settings=REPEATS))


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens; a row for each piece of a document."""
    return packing.pack(docs, RANKS, PATTERN, capacity=1024, end_id=0, with_ids=False, tokenizer_path=TOKENIZER)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("packing", pack_tokens),
]

#: Tokens, trained scores and byte spans are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what is between the stages is kept in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"stage{i}")
    return docs
