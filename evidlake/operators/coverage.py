"""Coverage: what was looked at, and every gap as a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Precedence of states in a roll-up, and areas of a cross-layer evaluation.
PRECEDENCE = ("FAILED", "TIMED_OUT", "UNSUPPORTED", "UNAVAILABLE", "SKIPPED", "PARTIAL", "COVERED")
AREAS = ("ROUTES", "ACTORS", "GUARDS", "VALUES", "OPERATIONS", "CLIENTS", "LINKS", "PATHS", "POLICY", "INVARIANTS")
TERMINATIONS = (("COMPLETED", "COVERED", None), ("FAILED", "FAILED", "ENGINE_FAILED"), ("TIMED_OUT", "TIMED_OUT", "ENGINE_TIMED_OUT"), ("CANCELLED", "SKIPPED", "ENGINE_CANCELLED"), ("UNAVAILABLE", "UNAVAILABLE", "ENGINE_UNAVAILABLE"), ("UNSUPPORTED", "UNSUPPORTED", "ENGINE_UNSUPPORTED"), ("OUTPUT_LIMIT", "PARTIAL", "OUTPUT_LIMIT_REACHED"))


def rank(state: Column, order: tuple[str, ...] = PRECEDENCE) -> Column:
    return F.array_position(F.array(*map(F.lit, order)), state)


def coverage_matrix(expected: DataFrame, observed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Expected against observed by (subject, capability, producer), null-safe; and keys that either side repeats.

    A missing expectation is an UNAVAILABLE row, never an absent one.
    """
    keys = ("subject", "capability", "producer")
    trim = lambda df: df.withColumns({k: F.trim(k) for k in keys})
    e, o = trim(expected), trim(observed)
    repeated = e.groupBy(*keys).count().where("count > 1").withColumn("side", F.lit("EXPECTED")).unionByName(o.groupBy(*keys).count().where("count > 1").withColumn("side", F.lit("OBSERVED")))
    e, o = e.dropDuplicates(list(keys)).alias("e"), o.dropDuplicates(list(keys)).alias("o")
    on = [F.col(f"e.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys]
    here, there = F.col("e.subject").isNotNull(), F.col("o.subject").isNotNull()
    entry = F.when(here & there, "OBSERVED_EXPECTED").when(there, "OBSERVED_UNEXPECTED").otherwise("MISSING_EXPECTED")
    rows = e.join(o, on[0] & on[1] & on[2], "full_outer")
    state = F.when(there, F.col("o.state")).otherwise(F.lit("UNAVAILABLE"))
    return rows.select(*[F.coalesce(f"e.{k}", f"o.{k}").alias(k) for k in keys], entry.alias("entry"), state.alias("state"), F.when(~there, F.lit("PRODUCER_NOT_REPORTED")).alias("reason")), repeated


def gap_count(matrix: DataFrame, *by: str) -> DataFrame:
    return matrix.groupBy(*by).agg(F.count_if(F.col("state") != "COVERED").alias("gaps"), F.count("*").alias("entries"))


def profile_matrix(subjects: DataFrame, packs: DataFrame, dimensions: tuple[str, ...]) -> DataFrame:
    """Subject by dimension; packs: subject, dimension. The dimensions are a fixed list, so the product only multiplies rows by it."""
    grid = subjects.select("subject", F.explode(F.array(*map(F.lit, dimensions))).alias("dimension"))
    rows = grid.join(packs.select("subject", "dimension", F.lit(True).alias("has")).distinct(), ["subject", "dimension"], "left")
    state = F.when(F.col("dimension") == "DETECTION", "COVERED").when(F.col("has"), "UNAVAILABLE").otherwise("UNSUPPORTED")
    reason = F.when(F.col("dimension") == "DETECTION", F.lit(None)).when(F.col("has"), "PACK_NOT_RUN").otherwise("NO_PACK")
    return rows.select("subject", "dimension", state.alias("state"), reason.alias("reason"))


def project_profile(detections: DataFrame, packs: DataFrame) -> DataFrame:
    """Detected subjects and the packs that serve them; packs: pack_id, subject. Each pair counts once, before the join."""
    rows = detections.select("repo_id", "subject").distinct().join(packs.select("pack_id", "subject").distinct(), "subject", "left")
    return rows.groupBy("repo_id", "subject").agg(F.sort_array(F.collect_set("pack_id")).alias("pack_ids")).withColumn("availability", F.when(F.size("pack_ids") > 0, "AVAILABLE").otherwise("NOT_INSTALLED"))


def roll_up(areas: DataFrame, key: str, required: tuple[str, ...] = AREAS) -> tuple[DataFrame, DataFrame]:
    """The worst state over exactly the required areas, once each; keys that lack or repeat one are rejected. A state without a rank is the worst.

    Areas are summed as bits and states as ranks, so Spark hashes the sums; texts among them would be sorted, all rows of a task. Only states without a rank are summed by name.
    """
    ranked = rank(F.col("state"))
    bits = [F.coalesce(*[F.when(F.col("area") == a, F.lit(1 << i).cast("long")) for i, a in enumerate(required[at : at + 63])], F.lit(0).cast("long")) for at in range(0, len(required), 63)]
    n = areas.groupBy(key).agg(F.count("*").alias("rows_of_key"), F.min(ranked).cast("int").alias("rank_of_key"), *[F.bit_or(b).alias(f"bits{i}") for i, b in enumerate(bits)])
    n = n.withColumn("areas_of_key", sum(F.bit_count(f"bits{i}") for i in range(len(bits))))
    good = (F.col("rows_of_key") == len(required)) & (F.col("areas_of_key") == len(required))
    other = areas.where(ranked == 0).groupBy(F.col(key).alias("of_key")).agg(F.min("state").alias("other"))
    rows = n.where(good).join(other, F.col(key).eqNullSafe(F.col("of_key")), "left")
    state = F.when(F.col("rank_of_key") == 0, F.col("other")).otherwise(F.get(F.array(*map(F.lit, PRECEDENCE)), F.col("rank_of_key") - 1))
    return rows.select(key, state.alias("state")), n.where(~good).select(key, F.when(F.col("areas_of_key") < len(required), "MISSING_AREA").otherwise("DUPLICATE_AREA").alias("reject_reason"))


def run_coverage(runs: DataFrame, rejects: DataFrame) -> DataFrame:
    """Engine runs to coverage; a completed run whose output was rejected FAILED as MALFORMED. rejects: run_id."""
    table = [F.struct(F.lit(t).alias("t"), F.lit(s).alias("s"), F.lit(r).cast("string").alias("r")) for t, s, r in TERMINATIONS]
    row = F.get(F.filter(F.array(*table), lambda x: x["t"] == F.col("termination")), F.lit(0))
    rows = runs.join(rejects.select("run_id", F.lit(True).alias("bad")).distinct(), "run_id", "left")
    bad = F.coalesce("bad", F.lit(False)) & (F.col("termination") == "COMPLETED")
    return rows.select("run_id", F.when(bad, "FAILED").otherwise(F.coalesce(row["s"], F.lit("FAILED"))).alias("state"), F.when(bad, "MALFORMED").otherwise(row["r"]).alias("reason"))


def reasoning_coverage(steps: DataFrame) -> DataFrame:
    """Outcomes of a reasoning step: disabled leaves no row."""
    o = F.col("outcome")
    return steps.where(o != "DISABLED").select("step_id", F.when(o == "NETWORK_POLICY", "SKIPPED").when(o == "FAILED", "FAILED").otherwise("COVERED").alias("state"), F.when(o == "NETWORK_POLICY", "SKIPPED_BY_POLICY").when(o == "FAILED", "REASONER_FAILED").alias("reason"))


def evaluation_outputs(evaluations: DataFrame) -> DataFrame:
    """Each evaluation as an observation and an interpretation."""
    both = F.array(F.struct(F.lit("OBSERVATION").alias("part"), F.concat(F.lit("evaluated "), F.col("invariant_id")).alias("text")), F.struct(F.lit("INTERPRETATION").alias("part"), F.concat(F.col("invariant_id"), F.lit(" is "), F.col("state")).alias("text")))
    return evaluations.select("evaluation_id", F.explode(both).alias("p")).select("evaluation_id", "p.part", "p.text")
