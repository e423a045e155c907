"""From raw documents to packed training sequences, in five stages of the ``phonolith.llm`` operators.

Every stage gets what the one before it kept, written as Parquet and read again. All but the last return the columns of
``documents`` (``COLUMNS``); further columns are dropped, whatever their names. Nulls in other columns than the text pass
through every stage. An empty table gives an empty one at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonolith.llm import mixing, near_copies, packing, pii, quality
from phonolith.llm.queries import tokenizer
from phonolith.llm.store import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule of the current policy go: null, empty and short texts too. Repeated rows fare alike, a text
    of any length is measured whole."""
    return quality.ledger(docs.select(*COLUMNS)).where(quality.passes(quality.V1)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (0.8 or more on 5-word shingles) the row with the smallest id stays. Rows without an id stay.

    Ball hashing of fingerprints names candidates, bands of MinHash those that it misses; all are compared exactly."""
    return near_copies.without_near_copies(docs.select(*COLUMNS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to the name of their kind; n_chars follows the text. Null and empty texts stay as they are (n_chars
    null and 0), repeated rows fare alike."""
    return pii.redact(pii.find(docs.select(*COLUMNS))).withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix uses it: not at all, once or twice; a use of half or more counts as one.

    Documents without a word have nothing to use and go; rows without an id and repeated rows are documents of their own."""
    uses = F.round(F.col("taken") / F.col("size")).cast("int")
    taken = mixing.mix(docs, carried=COLUMNS).where("size > 0").select("row", uses.alias("uses")).where("uses > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), "uses"))).select("row.*")


def token_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens: one row for each piece of a document. A null or empty text is its end token alone,
    repeated rows and rows without an id are packed like others."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"), end_id=0)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("source_mix", source_mix), ("token_packing", token_packing)]

#: Hashes of shingles, the random field and the tokenizer have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
