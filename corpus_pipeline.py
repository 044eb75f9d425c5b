"""From raw documents to packed training sequences, in five stages.

Each stage takes what its predecessor kept, written and read again, and works on all of it. All but the last return the columns of their input,
whatever they are called, with the types they had; an empty table stays empty. What else is defined stands with each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lernwerk.llm import mixing, ngram_join, packing, pii, tokens, toxicity
from lernwerk.llm.common import fresh, lean, settle, stored
from lernwerk.llm.registry import TOKENIZER

#: Documents that are packed together, at least: consecutive ones of the mix.
RUN_ROWS = 8000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold of their language go.

    A null or empty text has the score of no words and is judged by it; a null language has the threshold of all; null ids stay; repeated rows stay or go together.
    """
    lean(spark)
    model = toxicity.train_from(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = fresh(docs, "score")
    scored = toxicity.score(docs, model, name=score)
    return scored.filter(~toxicity.rejected(model, name=score)).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar ones stays, that of the smallest id.

    Documents without words, null texts included, are one class. Rows with a null id stay; rows that repeat the id of the one that stays stay with it.
    """
    lean(spark)
    return ngram_join.keep_one(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Confirmed spans become their kind in brackets; n_chars follows, null for a null text. No row goes."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the order of the mix: files and rows follow the slots. No row goes; a null source is one of its own; rows of equal id follow each other in any order."""
    mixed = mixing.mix(docs)
    return mixed.repartitionByRange("slot", "place").sortWithinPartitions("slot", "place").select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document with its place in a sequence of 4096 ids; sequences follow the order in which documents are stored, and so the mix.

    What is packed together is a run of documents that are stored one after the other, and runs follow each other.
    Every row gives its pieces, null and repeated ids too; a null or empty text is one piece, the end id.
    """
    lean(spark)
    own = docs.select(F.struct(*stored(docs), "doc_id").alias("_id"), "text")
    cut = settle(tokens.pieces(own, TOKENIZER, key="_id").select("_id.*", "piece", "start", "length", "ids_crc32"), "pieces")
    runs = packing.in_runs(cut, ["part", "file"], "row", RUN_ROWS)
    return packing.place_runs(runs, "run", ["part", "file", "row", "piece"], packing.best_fit).drop("part", "file", "row", "run")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: A trained classifier and MinHash have no equal in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
