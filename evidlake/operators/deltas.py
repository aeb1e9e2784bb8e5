"""Differences between two snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def file_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(repo_id, kind, path, previous_path) of files (repo_id, path, oid, mode).

    Deleted and added files of equal content and mode pair up one to one in path order, as renames.
    """
    b, a = before.alias("b"), after.alias("a")
    rows = b.join(a, (F.col("b.repo_id") == F.col("a.repo_id")) & (F.col("b.path") == F.col("a.path")), "full_outer")
    rows = rows.select(F.coalesce("b.repo_id", "a.repo_id").alias("repo_id"), F.col("b.path").alias("old"), F.col("a.path").alias("new"), F.col("b.oid").alias("old_oid"), F.col("a.oid").alias("new_oid"), F.col("b.mode").alias("old_mode"), F.col("a.mode").alias("new_mode"))
    same = rows.where("old is not null and new is not null")
    changed = same.where("old_oid <> new_oid or old_mode <> new_mode").select("repo_id", F.when(F.col("old_mode") != F.col("new_mode"), "TYPE_CHANGED").otherwise("MODIFIED").alias("kind"), F.col("new").alias("path"), F.lit(None).cast("string").alias("previous_path"))
    number = lambda path: F.row_number().over(Window.partitionBy("repo_id", "oid", "mode").orderBy(path))
    gone = rows.where("new is null").select("repo_id", F.col("old_oid").alias("oid"), F.col("old_mode").alias("mode"), F.col("old").alias("was")).withColumn("k", number("was"))
    come = rows.where("old is null").select("repo_id", F.col("new_oid").alias("oid"), F.col("new_mode").alias("mode"), F.col("new").alias("now")).withColumn("k", number("now"))
    pairs = gone.join(come, ["repo_id", "oid", "mode", "k"], "full_outer")
    kind = F.when(F.col("was").isNull(), "ADDED").when(F.col("now").isNull(), "DELETED").otherwise("RENAMED")
    return changed.unionByName(pairs.select("repo_id", kind.alias("kind"), F.coalesce("now", "was").alias("path"), F.when(F.col("now").isNotNull(), F.col("was")).alias("previous_path")))


def set_delta(before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct rows that are only after, and only before."""
    return after.subtract(before), before.subtract(after)


def advisory_matches(added: DataFrame, advisories: DataFrame) -> DataFrame:
    """Added packages (ecosystem, name, version) in an advisory's affected versions (advisory_id, ecosystem, package, affected_versions)."""
    each = advisories.select("advisory_id", "ecosystem", F.col("package").alias("name"), F.explode("affected_versions").alias("version")).distinct()
    return added.join(each, ["ecosystem", "name", "version"])


def cache_status(packages: DataFrame, cache: DataFrame, now: Column, max_age: int, offline: bool = True) -> DataFrame:
    """Cached answers (ecosystem, name, version, fetched_at) by age in seconds; one from the future isn't fresh."""
    rows = packages.join(cache, ["ecosystem", "name", "version"], "left")
    fresh = (now - F.col("fetched_at")).between(0, max_age)
    return rows.withColumn("status", F.when(fresh, "FRESH_CACHE").when(F.col("fetched_at").isNotNull(), "STALE_CACHE").otherwise("SKIPPED_BY_POLICY" if offline else "NETWORK_UNAVAILABLE"))


def record_diff(before: DataFrame, after: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, change) by stable id and content digest: ADDED, REMOVED, MODIFIED; equal rows aren't shown."""
    b, a = before.select(key, F.col(digest).alias("was")), after.select(key, F.col(digest).alias("now"))
    change = F.when(F.col("was").isNull(), "ADDED").when(F.col("now").isNull(), "REMOVED").when(F.col("was") != F.col("now"), "MODIFIED")
    return b.join(a, key, "full_outer").select(key, change.alias("change")).where("change is not null")


def policy_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(repo_id, relation, policy, change): how policies widened.

    Policies: repo_id, relation, policy, command, roles, has_using, has_with_check, provenance. Both sides need provenance; that a policy
    is new isn't a change here, since its absence before was never shown.
    """
    keys = ["repo_id", "relation", "policy"]
    side = lambda df, k: df.where("provenance is not null").select(*keys, *[F.col(c).alias(f"{c}_{k}") for c in ("command", "roles", "has_using", "has_with_check")], F.lit(True).alias(f"in_{k}"))
    rows = side(before, "b").join(side(after, "a"), keys, "full_outer").where("in_b")
    both = F.col("in_a").isNotNull()
    more = F.size(F.array_except("roles_a", "roles_b")) > 0
    public = F.array_contains("roles_a", "public") & ~F.array_contains("roles_b", "public")
    superset = more & (F.size(F.array_except("roles_b", "roles_a")) == 0)
    clause = lambda c, name: [F.when(both & F.col(f"{c}_b") & ~F.col(f"{c}_a"), f"{name}_REMOVED"), F.when(both & ~F.col(f"{c}_b") & F.col(f"{c}_a"), f"{name}_PRESENCE_CHANGED")]
    rules = [F.when(~both, "POLICY_REMOVED"), F.when(both & (F.col("command_a") == "ALL") & (F.col("command_b") != "ALL"), "COMMAND_SCOPE_EXPANDED_TO_ALL"), F.when(both & (public | superset), "ROLE_SCOPE_EXPANDED"), *clause("has_using", "USING"), *clause("has_with_check", "WITH_CHECK")]
    return rows.select(*keys, F.explode(F.array_compact(F.array(*rules))).alias("change"))
