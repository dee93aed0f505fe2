"""The corpus pipeline: five stages over documents, each written and read again.

Every stage takes (spark, docs, sf_dir) and gives all rows that it keeps; all but the last
return the columns of documents. In all of them a null text counts as empty, no rows give none, rows with null ids are
documents of their own, repeated rows stay or go together, and only the columns of documents are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortline.llm.decontaminate import contaminated, find_contamination
from cohortline.llm.neardup import near_duplicates
from cohortline.llm.pieces import encode_pieces
from cohortline.llm.quality import classify
from cohortline.llm.queries import piece_model, table
from cohortline.llm.repeats import remove_repeats
from cohortline.llm.tables import rows_without, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labels that aren't held out. Rows with null ids are scored too."""
    return classify(docs, table(spark, sf_dir, "labels")).filter("predicted = 1").select(*COLUMNS)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (similarity 0.8 or more), that of the smallest id.

    Rows without words, and rows with null ids, are linked with nothing and stay.
    """
    gone = written(near_duplicates(docs, per_cent=80).filter("NOT kept").select("doc_id").distinct(), "gone")
    return rows_without(docs, gone, "doc_id").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 100 bytes or more that stand earlier; n_chars follows the text where it changes.

    All rows stay, maybe with an empty text; earlier: in a row of a smaller id (null first), or before in the same text.
    """
    done = remove_repeats(docs)
    changed = F.size("removed") > 0
    return done.withColumns({"text": F.when(changed, F.col("kept_text")).otherwise(F.col("text")), "n_chars": F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))}).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lie in benchmark windows; those without words stay."""
    return find_contamination(docs, table(spark, sf_dir, "benchmark")).filter(~contaminated()).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document, the text that they decode to, and how many they are; an empty text has the end id alone."""
    done = encode_pieces(docs, piece_model(), decoded="decoded")
    return done.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicate),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding and decoding", encoding),
]

#: SQL can't express the trained stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
