"""Before and after: revision pairs, pairing of their objects, and regression records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidlake.functions.identity import content_id

#: What a change of state may be called.
ALLOWED = (("SATISFIED", "VIOLATED", "REGRESSION"), ("VIOLATED", "SATISFIED", "IMPROVEMENT"), ("SATISFIED", "SATISFIED", "UNCHANGED"), ("VIOLATED", "VIOLATED", "UNCHANGED"), ("NOT_APPLICABLE", "NOT_APPLICABLE", "UNCHANGED"), ("NOT_APPLICABLE", "VIOLATED", "REGRESSION"), ("VIOLATED", "NOT_APPLICABLE", "IMPROVEMENT"), ("UNKNOWN", "UNKNOWN", "UNKNOWN"))


def revision_pairs(base: DataFrame, candidate: DataFrame, version: str = "1") -> tuple[DataFrame, DataFrame]:
    """Pairs of (repo_id, revision, role) rows with their id, and rejects."""
    rows = base.select("repo_id", F.col("revision").alias("base"), F.col("role").alias("base_role")).join(candidate.select("repo_id", F.col("revision").alias("candidate"), F.col("role").alias("candidate_role")), "repo_id")
    bad = F.when(F.col("base_role") != "TRUSTED_BASE", "BASE_ROLE").when(F.col("candidate_role") != "CANDIDATE", "CANDIDATE_ROLE").when(F.col("base") == F.col("candidate"), "SAME_REVISION")
    rows = rows.withColumn("reject_reason", bad)
    ok = rows.where("reject_reason is null").select("repo_id", "base", "candidate", content_id("regression.pair", {"version": F.lit(version), "base": F.col("base"), "candidate": F.col("candidate")}).alias("pair_id"))
    return ok, rows.where("reject_reason is not null")


def pair_invariants(base: DataFrame, candidate: DataFrame) -> DataFrame:
    """(invariant_id, presence, continuity) by definition digest."""
    rows = base.select("invariant_id", F.col("definition_digest").alias("b")).join(candidate.select("invariant_id", F.col("definition_digest").alias("c")), "invariant_id", "full_outer")
    presence = F.when(F.col("b").isNull(), "CANDIDATE_ONLY").when(F.col("c").isNull(), "BASE_ONLY").otherwise("MATCHED")
    return rows.select("invariant_id", presence.alias("presence"), F.when(presence != "MATCHED", "UNPAIRED").when(F.col("b") == F.col("c"), "COMPATIBLE").otherwise("CONFLICT").alias("continuity"))


def pair_objects(base: DataFrame, candidate: DataFrame) -> DataFrame:
    """(kind, id, presence) of paths, observations, nodes and edges in one join on exact ids."""
    rows = base.select("kind", "id", F.lit(True).alias("b")).distinct().join(candidate.select("kind", "id", F.lit(True).alias("c")).distinct(), ["kind", "id"], "full_outer")
    return rows.select("kind", "id", F.when(F.col("b").isNull(), "CANDIDATE_ONLY").when(F.col("c").isNull(), "BASE_ONLY").otherwise("MATCHED").alias("presence"))


def snapshot_compatibility(pairs: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(pair_id, compatibility): the first mismatch of contract, schema, producers, configuration."""
    fields = ("contract", "schema_version", "producers", "configuration")
    side = lambda k, c: snapshots.select(F.col("revision").alias(c), *[(F.array_sort(f) if f == "producers" else F.col(f)).alias(f"{f}_{k}") for f in fields])
    rows = pairs.join(side("b", "base"), "base", "left").join(side("c", "candidate"), "candidate", "left")
    state = F.when(F.col("contract_b").isNull() | F.col("contract_c").isNull(), "MISSING_SNAPSHOT")
    for f in fields:
        state = state.when(F.col(f"{f}_b") != F.col(f"{f}_c"), f"{f.upper()}_MISMATCH")
    return rows.select("pair_id", state.otherwise("COMPATIBLE").alias("compatibility"))


def compose_snapshot(members: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(revision, n, input_digest) over distinct members (revision, id, digest), and references (revision, id, needs) to what isn't there."""
    once = members.dropDuplicates(["revision", "id"])
    lost = links.join(once.select("revision", F.col("id").alias("needs")), ["revision", "needs"], "left_anti").select("revision", "id", "needs")
    sums = once.groupBy("revision").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.concat_ws("=", "id", "digest"))).alias("all"))
    return sums.select("revision", "n", F.sha2(F.array_join("all", "\n"), 256).alias("input_digest")), lost


def bilateral_support(records: DataFrame, base: DataFrame, candidate: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records whose references exist on their own side, and rejects (J29). records: record_id, base_refs, candidate_refs; sides: id."""
    lost = lambda refs, side, name: records.select("record_id", F.explode(refs).alias("id")).join(side.select("id"), "id", "left_anti").select("record_id", F.lit(name).alias("side"), F.col("id").alias("missing"))
    rejects = lost("base_refs", base, "BASE").unionByName(lost("candidate_refs", candidate, "CANDIDATE"))
    return records.join(rejects.select("record_id").distinct(), "record_id", "left_anti"), rejects


def pair_coverage(base: DataFrame, candidate: DataFrame) -> DataFrame:
    """Coverage of both sides by (capability, scope, producer, dimension), null-safe."""
    keys = ("capability", "scope", "producer", "dimension")
    b, c = base.alias("b"), candidate.alias("c")
    on = None
    for k in keys:
        one = F.col(f"b.{k}").eqNullSafe(F.col(f"c.{k}"))
        on = one if on is None else on & one
    rows = b.join(c, on, "full_outer")
    was, now = F.col("b.state"), F.col("c.state")
    change = F.when(was.isNull() | ((was != "COVERED") & (now == "COVERED")), "COVERAGE_GAINED").when(now.isNull() | ((was == "COVERED") & (now != "COVERED")), "COVERAGE_LOST").otherwise("SAME")
    return rows.select(*[F.coalesce(f"b.{k}", f"c.{k}").alias(k) for k in keys], was.alias("base_state"), now.alias("candidate_state"), change.alias("change"))


def transition(base: Column, candidate: Column) -> Column:
    """The disposition that a pair of states allows (RG1); null if none."""
    return F.coalesce(*[F.when((base == b) & (candidate == c), F.lit(d)) for b, c, d in ALLOWED])


def disposition(pairs: DataFrame) -> DataFrame:
    """Adds disposition and reason (RG2): overflow, then conflict, presence, coverage, transition.

    pairs: base_state, candidate_state, base_coverage, candidate_coverage, presence, continuity, capped, removal_proven.
    """
    lost = (F.col("base_coverage") == "COVERED") & (F.col("candidate_coverage") != "COVERED")
    gained = (F.col("base_coverage") != "COVERED") & (F.col("candidate_coverage") == "COVERED")
    partial = (F.col("base_coverage") != "COVERED") & (F.col("candidate_coverage") != "COVERED")
    known = transition(F.col("base_state"), F.col("candidate_state"))
    cases = (
        (F.col("capped"), "UNKNOWN", "CAP_REACHED"), (F.col("continuity") == "CONFLICT", "UNKNOWN", "DEFINITION_CONFLICT"), ((F.col("presence") == "BASE_ONLY") & F.col("removal_proven"), "REGRESSION", "INVARIANT_REMOVED"),
        (F.col("presence") == "BASE_ONLY", "UNKNOWN", "BASE_ONLY"), ((F.col("presence") == "CANDIDATE_ONLY") & (F.col("candidate_state") == "VIOLATED"), "UNKNOWN", "NEW_WITHOUT_BASE"), (F.col("presence") == "CANDIDATE_ONLY", "UNKNOWN", "CANDIDATE_ONLY"),
        (lost, "COVERAGE_LOST", "CANDIDATE_NOT_COVERED"), (gained, "COVERAGE_GAINED", "BASE_NOT_COVERED"), (partial, "UNKNOWN", "BOTH_NOT_COVERED"),
    )
    d, r = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for condition, name, why in cases:
        d, r = d.when(F.coalesce(condition, F.lit(False)), name), r.when(F.coalesce(condition, F.lit(False)), why)
    return pairs.withColumn("disposition", d.otherwise(F.coalesce(known, F.lit("UNKNOWN")))).withColumn("reason", r.otherwise(F.when(known.isNull(), "NO_TRANSITION").otherwise("STATE_TRANSITION")))


def seal_records(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records (record_key, disposition, refs, coverage_keys) with sorted references and their id, and those that repeat a coverage key (RG3)."""
    twice = F.size(F.array_distinct("coverage_keys")) != F.size("coverage_keys")
    rows = records.withColumn("refs", F.array_sort(F.array_distinct("refs"))).withColumn("coverage_keys", F.array_sort("coverage_keys"))
    ok = rows.where(~twice).withColumn("regression_id", content_id("regression.record", {c: F.col(c) for c in ("record_key", "disposition", "refs", "coverage_keys")}))
    return ok, rows.where(twice).withColumn("reject_reason", F.lit("DUPLICATE_COVERAGE_KEY"))
