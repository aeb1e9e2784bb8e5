"""Lockfiles and advisories over tables of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidlake.sources.reports import known_keys, once

ADVISORY = "struct<schema_version:string,advisories:array<struct<id:string,ecosystem:string,package:string,affected_versions:array<string>,summary:string>>>"
CACHE_KEYS = ("ecosystem", "name", "version", "fetched_at", "advisories")
VERSIONS_MOST, CACHE_MOST, PAGES_MOST = 1000, 10_000, 16


def cargo_packages(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(repo_id, ecosystem, name, version) of Cargo lockfiles (repo_id, path, content), and rejected files: no record, one without name or version, or an escape."""
    blocks = files.select("repo_id", "path", F.posexplode(F.split("content", r"(?m)^\[\[package\]\]\s*$")).alias("nth", "block")).where("nth > 0")
    field = lambda k: F.regexp_extract("block", rf'(?m)^{k}\s*=\s*"([^"\n]*)"\s*$', 1)
    rows = blocks.select("repo_id", "path", field("name").alias("name"), field("version").alias("version"))
    bad = (F.col("name") == "") | (F.col("version") == "") | F.col("name").contains("\\") | F.col("version").contains("\\")
    wrong = rows.groupBy("repo_id", "path").agg(F.bool_or(bad).alias("bad"))
    rejects = files.select("repo_id", "path").join(wrong, ["repo_id", "path"], "left").where("bad is null or bad").select("repo_id", "path", F.when(F.col("bad").isNull(), "NO_RECORD").otherwise("BAD_RECORD").alias("reject_reason"))
    ok = rows.join(rejects.select("repo_id", "path"), ["repo_id", "path"], "left_anti")
    return ok.select("repo_id", F.lit("cargo").alias("ecosystem"), "name", "version").distinct(), rejects


def npm_packages(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As ``cargo_packages``, of npm lockfiles of version 2 and 3; links and the root don't count."""
    body = F.from_json("content", "struct<lockfileVersion:int,packages:map<string,struct<name:string,version:string,link:boolean>>>")
    docs = once(files.select("repo_id", "path", "content"), d=body).drop("content")
    bad = F.when(F.col("d.lockfileVersion").isNull() | F.col("d.packages").isNull(), "MALFORMED").when(~F.col("d.lockfileVersion").isin(2, 3), "UNSUPPORTED_VERSION")
    docs = docs.withColumn("reject_reason", bad)
    rows = docs.where("reject_reason is null").select("repo_id", F.explode("d.packages").alias("at", "p")).where(F.col("at") != "").where(~F.coalesce("p.link", F.lit(False)))
    name = F.coalesce("p.name", F.substring_index("at", "node_modules/", -1))
    ok = rows.where("p.version is not null").select("repo_id", F.lit("npm").alias("ecosystem"), name.alias("name"), F.col("p.version").alias("version")).distinct()
    return ok, docs.where("reject_reason is not null").select("repo_id", "path", "reject_reason")


def read_advisories(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_advisories(spark.read.text(path, wholetext=True).withColumnRenamed("value", "body"))


def parse_advisories(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Advisories of catalogue documents (body), and rejects: wrong version, an id twice, none or too many versions."""
    docs = raw.select(F.from_json("body", ADVISORY).alias("d"))
    each = docs.where(F.col("d.schema_version") == "1").select(F.explode("d.advisories").alias("a")).select(F.col("a.id").alias("advisory_id"), "a.ecosystem", "a.package", "a.affected_versions", "a.summary")
    twice = each.groupBy("advisory_id").agg(F.count("*").alias("k"))
    rows = each.join(twice, "advisory_id")
    n = F.coalesce(F.size("affected_versions"), F.lit(0))
    bad = F.when(F.col("k") > 1, "DUPLICATE_ID").when(n < 1, "NO_VERSION").when(n > VERSIONS_MOST, "TOO_MANY_VERSIONS")
    rows = rows.withColumn("reject_reason", bad).drop("k")
    version = docs.where(~F.col("d.schema_version").eqNullSafe("1")).select(F.lit(None).cast("string").alias("advisory_id"), F.lit("UNSUPPORTED_VERSION").alias("reject_reason"))
    return rows.where("reject_reason is null").drop("reject_reason"), rows.where("reject_reason is not null").select("advisory_id", "reject_reason").unionByName(version)


def parse_cache(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cache entries of JSON lines (file_id, value), keys exactly those of the contract; past CACHE_MOST entries a file is rejected as a whole."""
    rows = raw.withColumn("extra", known_keys(F.col("value"), CACHE_KEYS)).withColumn("e", F.from_json("value", "ecosystem string, name string, version string, fetched_at bigint, advisories array<string>"))
    bad = F.when(F.size("extra") > 0, "UNKNOWN_FIELD").when(F.col("e.name").isNull() | F.col("e.fetched_at").isNull(), "MALFORMED")
    over = raw.groupBy("file_id").agg((F.count("*") > CACHE_MOST).alias("over"))
    rows = rows.withColumn("bad", bad).join(over, "file_id").withColumn("reject_reason", F.when(F.col("over"), "TOO_MANY_ENTRIES").otherwise(F.col("bad")))
    return rows.where("reject_reason is null").select("e.*"), rows.where("reject_reason is not null").select("value", "reject_reason")


def merge_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One summary per (package, advisory), the first in page order; a package with a page token twice or too many pages is rejected.

    pages: package, page_no, page_token, advisory_id, summary.
    """
    tokens = pages.select("package", "page_no", "page_token").distinct().groupBy("package").agg((F.countDistinct("page_token") < F.count("page_token")).alias("again"), (F.count("*") > PAGES_MOST).alias("many")).where("again or many")
    rejects = tokens.select("package", F.when(F.col("again"), "REPEATED_TOKEN").otherwise("TOO_MANY_PAGES").alias("reject_reason"))
    ok = pages.join(rejects.select("package"), "package", "left_anti").groupBy("package", "advisory_id").agg(F.min_by("summary", "page_no").alias("summary"))
    return ok, rejects


def strip_quotes(c: Column) -> Column:
    return F.regexp_replace(c, '^"|"$', "")
