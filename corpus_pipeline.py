"""The corpus pipeline: language, near copies, benchmark leaks, source weights, shards.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet
and reads again as the next one's docs. All but the last keep the columns of documents.

Defined cases, as the operators state them: null and empty texts have no letters, so the first stage drops them; of rows equal in text one
stays, whatever their doc_ids, null ids last; texts of any length are read whole; repeated benchmark items count once; an empty table gives
an empty result at every stage. Columns beside those of documents are left out at the start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidlake.llm import decontamination, language, mixing, ngram_join, sharding
from evidlake.llm.common import staged, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in none of the languages that the labelled rows teach go."""
    found = language.identify(docs, language.train(docs), "found_language")
    return found.where(~F.col("found_language.rejected")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the least doc_id."""
    return ngram_join.one_of_each(docs, 5, 80)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    mixed = mixing.mix_sources(docs, out="mix_of_sources")
    again = F.explode(F.sequence(F.lit(1), F.col("mix_of_sources.copies")))
    return mixed.where("mix_of_sources.copies > 0").withColumn("copy_of_document", again).select(*docs.columns)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and slot; copies that the mix makes are rows of their own, equal texts in one shard."""
    return sharding.shard_documents(docs, 16)


STAGES = [("language", languages), ("near_copies", near_copies), ("decontamination", leaks), ("mixing", weights), ("sharding", shards)]

#: No SQL: language models and the minimax cuts can't be said in it; tests compare every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir))
    return docs
