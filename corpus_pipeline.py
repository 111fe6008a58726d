"""The corpus pipeline: quality, language, near-duplicates, mix and packing, one after the other.

Each stage takes (spark, docs, sf_dir) and works on all rows it is given; ``run`` writes every
stage's result as Parquet in the shared folder and reads it again for the next, so a lost
executor costs no more than a stage. Every stage but the last returns the columns it got.

Defined results: null and empty texts fail the quality rules and go; a corpus without any
``lang`` passes language ID whole, since nothing tells languages apart; of repeated rows and
near copies one stays; rows with a null id are kept or dropped by their text like all others;
a null source is a source; an empty table gives an empty result. Further columns are carried
along, whatever their names.
"""

from pyspark.sql import DataFrame, SparkSession

from chatgauge.llm import apportion, gru, packing, simhash_bk, weak_rules
from chatgauge.session import new_folder

#: A document stays if its language was recognised with at least this mean probability.
SURE = 0.4


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or whose posterior quality is below one half."""
    return weak_rules.keep_good(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or of no recognisable language."""
    return gru.keep_recognised(docs, SURE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest doc_id of each group of near-duplicates."""
    return simhash_bk.keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents (whole, in part, or twice) that the mix takes from each source."""
    return apportion.mixed_documents(docs)


def length_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, batch and slot of every piece of every document."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("SimHash near-dedup", near_duplicates),
    ("mixing sources to target weights", source_mix),
    ("packing", length_packing),
]
#: A network and EM are learned on the way, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
