"""A corpus from documents to packed training sequences, in five stages.

Each stage takes what its predecessor wrote and decides on all of it: rejected
documents go, one document of each near-duplicate class stays, personal data is
replaced, documents are repeated or dropped to meet the sources' targets, and what
remains is packed.  All stages but the last return the columns of documents.

Edge cases: a null or empty text is one empty line for the classifier, is in no
class of near-duplicates, stays null or empty in the third stage, has no words and
so no copy in the mix, and is a piece of one id if packed by itself; a null source
is a source of its own; repeated rows and null or repeated ids count one by one and
of equal rows one stays; an empty table stays empty; columns beyond those of
documents pass through all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.durable import durable
from tessera.llm import jaccard, mixing, packing, pii, quality
from tessera.llm.graph import every


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    judged = quality.classify(docs, model, keep=docs.columns)
    return judged.filter(F.col(judged.columns[-1]) == 1).select(*every(docs))


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near-duplicates."""
    return jaccard.first_of_classes(docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; lengths follow."""
    return pii.redact(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*every(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.repeated(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequences; a document that the mix repeats has its pieces as often."""
    return packing.best_fit_pack(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_of_each_class),
    ("PII", replace_personal_data),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack),
]

#: Classifier, hashes of n-gram sets and tokens are beyond SQL; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
