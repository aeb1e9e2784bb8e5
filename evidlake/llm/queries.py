"""The registered queries of the corpus operators; each is a thin application of one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidlake.llm import chat, decontamination, divergence, filter_audit, language, mixing, ngram_join, search, secrets, sharding, substrings, toxicity, url_filter
from evidlake.llm.common import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(table(spark, sf_dir, "documents"), 3, 90)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    third = language.fold(F.col("doc_id"), 3)
    model = language.train(docs.where(third != 1))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (third == 1).alias("held_out"), "language.lang_pred", "language.score", "language.cross_entropy", "language.rejected")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fifth = language.fold(F.col("doc_id"), 5)
    model = toxicity.train(toxicity.labelled(docs, table(spark, sf_dir, "labels"), fifth != 0))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (fifth == 0).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removal_digest(table(spark, sf_dir, "documents"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_copies(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op6_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 16)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets_digest(table(spark, sf_dir, "documents"))


def op9_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_documents(table(spark, sf_dir, "documents"), F.col("doc_id") % 50 == 0, 10)


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    formatted = chat.format_trees(chat.conversation_nodes(rows.unionByName(own)))
    read = chat.read_back(formatted)
    return read.select(F.col("root.conv_id").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"), 30, 50)


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_pages(table(spark, sf_dir, "pages"), url_filter.RULES)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_ngram_join": op2_ngram_join,
    "op3_language": op3_language,
    "op4_toxicity": op4_toxicity,
    "op5_mix_sources": op5_mix_sources,
    "op6_shard": op6_shard,
    "op7_secrets": op7_secrets,
    "op8_repeats": op8_repeats,
    "op9_search": op9_search,
    "op10_chat": op10_chat,
    "op11_source_divergence": op11_source_divergence,
    "op12_url_filter": op12_url_filter,
    "op13_filter_audit": op13_filter_audit,
}

_CONTROL = "|".join([chat.ESCAPE, *(c.replace("|", r"\|").replace("[", r"\[").replace("]", r"\]").replace("/", r"\/") for c in chat.CONTROL)])

ORACLES: dict[str, str] = {
    "op11_source_divergence": divergence.ORACLE,
    "op12_url_filter": url_filter.ORACLE,
    "op13_filter_audit": filter_audit.ORACLE,
    # Every control string, and the escape itself, grows by one character; a turn adds 24 of the template's own.
    "op10_chat": f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r0, text AS t0 FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]', 'user', '</s>[INST] ok [/INST]'
           UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]', 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(text) + length(role) + 24 + len(regexp_extract_all(text, '{_CONTROL}')) + len(regexp_extract_all(role, '{_CONTROL}')))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id""",
    "op9_search": f"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM documents),
     p AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY 1, 2), z AS (SELECT doc_id, count(*) AS n FROM w GROUP BY 1),
     g AS (SELECT (SELECT count(*) FROM documents) AS total, (SELECT count(*) FROM w) / (SELECT count(*) FROM documents)::DOUBLE AS mean), f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
     s AS (SELECT q.doc_id AS query_id, d.doc_id, sum(ln(1 + (total - df + 0.5) / (df + 0.5)) * (d.tf * {search.K1 + 1} / (d.tf + {search.K1} * ({1 - search.B} + {search.B} * z.n / mean)))) AS score
           FROM p q JOIN p d ON q.term = d.term JOIN f ON f.term = q.term JOIN z ON z.doc_id = d.doc_id CROSS JOIN g WHERE q.doc_id % 50 = 0 AND q.doc_id <> d.doc_id GROUP BY 1, 2)
SELECT query_id, rank, doc_id, score FROM (SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM s) WHERE rank <= 10""",
}
