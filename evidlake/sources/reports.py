"""Tool reports, traces and occurrence indexes: parsing with a reject row beside every main row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidlake.functions.identity import edge_id, node_id
from evidlake.functions.predicates import first_reason, normalised_tool_path

ITEMS_MOST, RUNS_MOST, FRAME_BYTES = 4096, 64, 1 << 20
TOOL = "struct<schema_version:string,evidence:array<struct<observation:string,security_interpretation:string,category:string,epistemic_class:string,confidence_band:string,subjects:array<struct<kind:string,id:string>>,locations:array<struct<repo_relative_path:string,start_line:bigint,start_column:bigint,end_line:bigint,end_column:bigint,symbol:string,content_digest:string>>,attributes:map<string,string>,reproduction:struct<method:string,input_digest:string,notes:string>>>>"
SARIF = "struct<version:string,runs:array<struct<tool:struct<driver:struct<name:string,semanticVersion:string,version:string>>,results:array<struct<ruleId:string,level:string,message:struct<text:string,markdown:string>,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string,uriBaseId:string>,region:struct<startLine:bigint,startColumn:bigint,endLine:bigint,endColumn:bigint>>>>>>>>>"


def read_repo_files(spark: SparkSession, root: str, repo_id: str, snapshot_id: str) -> DataFrame:
    """(repo_id, snapshot_id, path, length, content) of the files under ``root``; content is only read where it is selected.

    Spark's file listing passes over empty files and names that begin with a dot or an underscore.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    tail = F.regexp_replace("path", r"^.*?\Q" + root.rstrip("/").split(":")[-1] + r"\E/", "")
    return files.select(F.lit(repo_id).alias("repo_id"), F.lit(snapshot_id).alias("snapshot_id"), tail.alias("path"), "length", "content")


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that Spark works out once a row. Filters on plain columns are moved below them, where every use repeats the expression (a parsed body, say); they stay above a generator."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def ingest_tool_json(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items of native tool JSON (run_id, body), and rejects: documents that are malformed, of another version or too long, and items out of bounds."""
    docs = once(raw, d=F.from_json("body", TOOL, {"mode": "PERMISSIVE"}))
    reason = first_reason((F.col("d.schema_version").isNull(), "MALFORMED"), (F.col("d.schema_version") != "1", "UNSUPPORTED_VERSION"), (F.col("d.evidence").isNull(), "MALFORMED"), (F.size("d.evidence") > ITEMS_MOST, "TOO_MANY_ITEMS"))
    docs = docs.withColumn("reject_reason", reason)
    items = docs.where("reject_reason is null").select("run_id", F.posexplode("d.evidence").alias("item", "e"))
    items = once(items, paths=F.transform("e.locations", lambda p: normalised_tool_path(p["repo_relative_path"])))
    paths = F.col("paths")
    bad = F.when(F.col("e.observation").isNull() | (F.trim("e.observation") == ""), "BLANK_OBSERVATION").when(F.col("e.category").isNull(), "NO_CATEGORY").when(F.octet_length("e.observation") > 8192, "TOO_LONG").when(F.exists(F.coalesce(paths, F.array().cast("array<string>")), lambda p: p.isNull()), "PATH_OUTSIDE_ROOT")
    items = items.withColumn("reject_reason", bad)
    ok = items.where("reject_reason is null").select("run_id", "item", "e.observation", F.col("e.security_interpretation").alias("interpretation"), "e.category", "e.epistemic_class", "e.subjects", paths.alias("paths"), "e.attributes", "e.reproduction")
    rejects = docs.where("reject_reason is not null").select("run_id", F.lit(None).cast("int").alias("item"), "reject_reason").unionByName(items.where("reject_reason is not null").select("run_id", "item", "reject_reason"))
    return ok, rejects


def ingest_sarif(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Evidence of SARIF 2.1.0 logs (run_id, body), and rejects. A finding's words are interpretation, its class INFERENCE."""
    docs = once(raw, d=F.from_json("body", SARIF, {"mode": "PERMISSIVE"}))
    reason = first_reason((F.col("d.version").isNull(), "MALFORMED"), (F.col("d.version") != "2.1.0", "UNSUPPORTED_VERSION"), (F.col("d.runs").isNull(), "MALFORMED"), (F.size("d.runs") > RUNS_MOST, "TOO_MANY_RUNS"))
    docs = docs.withColumn("reject_reason", reason)
    runs = docs.where("reject_reason is null").select("run_id", F.posexplode_outer("d.runs").alias("nth", "r"))
    items = runs.select("run_id", "nth", "r.tool.driver", F.posexplode("r.results").alias("item", "x"))
    message = F.coalesce(F.when(F.trim("x.message.text") != "", F.col("x.message.text")), F.when(F.trim("x.message.markdown") != "", F.col("x.message.markdown")))
    where = F.coalesce("x.locations", F.array().cast("array<struct<physicalLocation:struct<artifactLocation:struct<uri:string,uriBaseId:string>,region:struct<startLine:bigint,startColumn:bigint,endLine:bigint,endColumn:bigint>>>>"))
    items = once(items, paths=F.transform(where, lambda p: normalised_tool_path(p["physicalLocation"]["artifactLocation"]["uri"])))
    paths = F.col("paths")
    bad = (
        F.when(F.col("x.ruleId").isNull() | (F.trim("x.ruleId") == ""), "NO_RULE").when(message.isNull(), "NO_MESSAGE").when(F.exists(where, lambda p: p["physicalLocation"].isNull()), "NOT_PHYSICAL")
        .when(F.exists(where, lambda p: p["physicalLocation"]["artifactLocation"]["uriBaseId"].isNotNull()), "URI_BASE").when(F.exists(paths, lambda p: p.isNull()), "PATH_OUTSIDE_ROOT")
    )
    items = items.withColumn("reject_reason", bad)
    version = F.coalesce("driver.semanticVersion", "driver.version")
    ok = items.where("reject_reason is null").select("run_id", "nth", "item", F.col("driver.name").alias("producer_id"), version.alias("producer_version"), F.concat(F.lit("sarif:"), "x.ruleId").alias("category"), F.lit("INFERENCE").alias("epistemic_class"), message.alias("interpretation"), paths.alias("paths"))
    rejects = docs.where("reject_reason is not null").select("run_id", F.lit(None).cast("int").alias("item"), "reject_reason").unionByName(items.where("reject_reason is not null").select("run_id", "item", "reject_reason"))
    return ok, rejects


def read_traces(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Frames of JSONL traces: id, method, params, result, and reject_reason for one that is too long or malformed."""
    text = (spark.readStream if stream else spark.read).text(path)
    return parse_frames(text)


def parse_frames(text: DataFrame) -> DataFrame:
    frame = F.from_json("value", "id bigint, method string, params string, result string")
    whole = F.trim("value").rlike(r"^\{.*\}$") & F.try_parse_json("value").isNotNull()
    bad = F.when(F.octet_length("value") > FRAME_BYTES, "TOO_LONG").when(~F.coalesce(whole, F.lit(False)), "MALFORMED")
    return text.where(F.trim("value") != "").select(frame.alias("f"), bad.alias("reject_reason")).select("f.*", "reject_reason")


def ingest_occurrences(occurrences: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, REFS edges and coverage of (repo_id, path, symbol, line, is_definition, quality); a heuristic index is PARTIAL."""
    file_key, symbol_key = F.concat_ws(":", "repo_id", "path"), F.concat_ws(":", "repo_id", "symbol")
    ref_key = F.concat_ws(":", "repo_id", "path", "line", "symbol")
    # Each kind on its own: its rows are told apart by repository and key alone.
    kind = lambda rows, name, key: rows.select("repo_id", key.alias("key")).distinct().select("repo_id", F.lit(name).alias("kind"), "key")
    nodes = kind(occurrences, "FILE", file_key).unionByName(kind(occurrences, "SYMBOL", symbol_key)).unionByName(kind(occurrences.where("not is_definition"), "REFERENCE", ref_key))
    nodes = nodes.withColumn("node_id", node_id(F.col("kind"), F.col("key")))
    source, target = node_id(F.lit("REFERENCE"), ref_key), node_id(F.lit("SYMBOL"), symbol_key)
    edges = occurrences.where("not is_definition").select("repo_id", source.alias("source"), F.lit("REFS").alias("relation"), target.alias("target")).distinct()
    edges = edges.withColumn("edge_id", edge_id(F.col("source"), F.col("relation"), F.col("target")))
    heuristic = F.bool_or(F.col("quality") != "EXACT")
    coverage = occurrences.groupBy("repo_id").agg(F.when(heuristic, "PARTIAL").otherwise("COVERED").alias("state"), F.when(heuristic, F.lit("HEURISTIC_INDEX")).alias("reason"))
    return nodes, edges, coverage


def occurrence_gaps(repos: DataFrame, indexes: DataFrame) -> DataFrame:
    """A coverage row for each repository whose index is absent, unsupported or failed. indexes: repo_id, status."""
    rows = repos.join(indexes, "repo_id", "left").where(F.col("status").isNull() | (F.col("status") != "READY"))
    return rows.select("repo_id", F.when(F.col("status").isNull(), "UNAVAILABLE").when(F.col("status") == "UNSUPPORTED", "UNSUPPORTED").otherwise("FAILED").alias("state"), F.concat(F.lit("INDEX_"), F.coalesce("status", F.lit("ABSENT"))).alias("reason"))


def known_keys(body: Column, allowed: tuple[str, ...]) -> Column:
    """Keys of a JSON object that the contract doesn't know."""
    return F.array_except(F.coalesce(F.json_object_keys(body), F.array().cast("array<string>")), F.array(*map(F.lit, allowed)))
