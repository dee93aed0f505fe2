"""One query for each operator, over whole tables, with the settings used in production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import licenses, oracles, preferences
from .alignment import align_tokens, with_link_counts
from .decontaminate import contaminated, find_contamination
from .fingerprint import with_neighbours
from .maxent import score_texts
from .neardup import near_duplicates
from .pieces import encode_pieces
from .quality import classify
from .repeats import remove_repeats
from .sharding import shuffle_to_shards
from .simhash import hex_digits, simhash_duplicates
from .spelling import spelling_variants
from .tables import small_batches

N_SHARDS = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model() -> bytes:
    """The bytes of the model file, whose place is a setting of the box."""
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def byte_vocabulary() -> str:
    """The JSON of the byte-level vocabulary, whose place is a setting of the box."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return with_neighbours(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that lie in 13-word windows of benchmark items."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def op3_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations against the same ones with the neighbour's last answer."""
    turns = table(spark, sf_dir, "conversations")
    pairs = preferences.preference_pairs(turns, preferences.swapped_answers(turns))
    spans = {c: F.array_join(F.transform(c, lambda x: F.concat_ws("-", x["first"], x["end"])), ",") for c in ("chosen_mask", "rejected_mask")}
    return pairs.withColumns(spans)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards whose row counts differ by one at most."""
    dealt = shuffle_to_shards(table(spark, sf_dir, "documents"), N_SHARDS, seed=20)
    text = F.coalesce("text", F.lit(""))
    return dealt.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from four fifths of the labelled ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    return classify(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document and the text that they decode to."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = encode_pieces(docs, piece_model(), decoded="decoded")
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents at a Jaccard similarity of 0.85 or more."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document by the model and by smoothed counts of its words."""
    return score_texts(table(spark, sf_dir, "documents"))


def op9_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes of 100-byte strings that start earlier."""
    done = remove_repeats(table(spark, sf_dir, "documents"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    return done.select(
        "doc_id",
        (F.octet_length("kept") + gone).alias("n_bytes"),
        gone.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that all pages declare or inherit from the directories of their addresses."""
    path = F.coalesce(F.regexp_extract("url", "^[a-z]+://([^?#]*)", 1), F.lit(""))
    files = table(spark, sf_dir, "pages").select("page_id", path.alias("path"), F.regexp_replace("html", "<[^>]*>", "\n").alias("text"))
    return licenses.scan_licenses(files, spark.createDataFrame(licenses.TEMPLATES, "license string, template string"), file="page_id")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of tokens of two vocabularies that cover the same bytes of every document, and how frequent their links are."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = align_tokens(docs, byte_vocabulary(), piece_model()).drop("text")
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    done = with_link_counts(done.withColumn("groups_sha256", digest).drop("groups"))
    return done.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their components at four differing bits at most."""
    done = simhash_duplicates(table(spark, sf_dir, "documents"))
    return done.select("doc_id", hex_digits("simhash").alias("fingerprint"), "component_id")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants of the words of all documents."""
    return spelling_variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprint": op1_fingerprint,
    "op2_decontaminate": op2_decontaminate,
    "op3_preferences": op3_preferences,
    "op4_sharding": op4_sharding,
    "op5_quality": op5_quality,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_minhash": op7_minhash,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_suffix_array": op9_suffix_array,
    "op10_licenses": op10_licenses,
    "op11_alignment": op11_alignment,
    "op12_simhash": op12_simhash,
    "op13_spelling": op13_spelling,
}
SQL: dict[str, str] = {**oracles.SQL, "op3_preferences": preferences.SQL, "op10_licenses": licenses.SQL}
