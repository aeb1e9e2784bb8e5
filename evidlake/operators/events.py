"""Agent event chains, verdicts and approvals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidlake.functions.identity import content_id
from evidlake.operators.ranks import SEGMENT_ROWS, in_order, ranked


def event_hash(fields: tuple[str, ...] = ("session_id", "sequence", "kind", "payload", "previous_event_hash")) -> Column:
    return content_id("agent.event", {c: F.col(c) for c in fields})


def _chained(rows: DataFrame) -> DataFrame:
    """Rows with ``rank`` (from 1) and ``prior`` hash in their session, by sequence and hash. A session's rows are dealt in segments of its sequence."""
    segment = F.floor(F.col("sequence") / SEGMENT_ROWS)
    return in_order(rows.withColumn("segment_of_session", segment), ["session_id"], ["sequence", "event_hash"], "segment_of_session", "event_hash").drop("segment_of_session")


def verify_sessions(events: DataFrame, heads: DataFrame, recomputed: Column) -> DataFrame:
    """(session_id, outcome, n_events): the first failing row decides, and within a row hash, then sequence, then previous hash.

    events: session_id, sequence, event_hash, previous_event_hash; heads: session_id, head_hash (trusted).
    """
    rows = _chained(events.withColumn("own", recomputed)).withColumn("rn", F.col("rank") - 1)
    code = F.when(F.col("event_hash") != F.col("own"), "EVENT_HASH_MISMATCH").when(F.col("sequence") != F.col("rn"), "SEQUENCE_GAP").when(~F.col("previous_event_hash").eqNullSafe(F.col("prior")), "PREVIOUS_HASH_MISMATCH")
    first = F.min_by(code, F.when(code.isNotNull(), F.col("rn")))
    state = rows.groupBy("session_id").agg(first.alias("code"), F.max_by("event_hash", "sequence").alias("last_hash"), F.count("*").alias("n_events"))
    rows = state.join(heads, "session_id", "full_outer")
    outcome = F.when(F.col("n_events").isNull(), "MISSING_SESSION").when(F.col("code").isNotNull(), F.col("code")).when(F.col("head_hash").isNull(), "NO_TRUSTED_HEAD").when(F.col("head_hash") != F.col("last_hash"), "HEAD_MISMATCH").otherwise("VERIFIED")
    return rows.select("session_id", outcome.alias("outcome"), F.coalesce("n_events", F.lit(0)).alias("n_events"))


def session_heads(events: DataFrame) -> DataFrame:
    return events.groupBy("session_id").agg(F.max_by("event_hash", "sequence").alias("head_hash"), F.count("*").alias("n_events"))


def chain_append(new: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that extend their session's chain without a gap, and rejects (K6); a row already in the log is neither."""
    # Log and new rows are dealt once, by session and segment of its sequence; windows, the segments' sums and the last join keep that deal.
    rows = new.withColumn("in_log", F.lit(False)).unionByName(log.select("session_id", "sequence", "event_hash", F.lit(True).alias("in_log")), allowMissingColumns=True)
    rows = rows.withColumn("segment_of_session", F.coalesce(F.floor(F.col("sequence") / SEGMENT_ROWS), F.lit(-(1 << 62))))
    same = Window.partitionBy("session_id", "segment_of_session", "sequence").orderBy("event_hash")
    whole = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    held = F.when(F.col("in_log"), F.col("event_hash"))
    rows = rows.withColumns({"held_least": F.min(held).over(whole), "held_most": F.max(held).over(whole), "again": F.lag("event_hash").over(same).eqNullSafe(F.col("event_hash"))}).where("not in_log")
    fork = rows.where("held_least <> event_hash or held_most <> event_hash").select(*new.columns, F.lit("FORK").alias("reject_reason"))
    local = Window.partitionBy("session_id", "segment_of_session").orderBy("sequence", "event_hash")
    rows = rows.where("held_least is null and not again")
    rows = rows.withColumns({"own_rank": F.row_number().over(local), "own_prior": F.lag("event_hash").over(local), "first_sequence": F.first("sequence").over(local)})
    # Past the first row of a segment, a row's place among the others says whether it is bad, if the first isn't.
    gap = F.coalesce(F.col("sequence") - F.col("first_sequence") != F.col("own_rank") - 1, F.lit(False))
    own_bad = F.when(F.col("own_rank") > 1, F.when(gap, "SEQUENCE_GAP").when(~F.col("previous_event_hash").eqNullSafe(F.col("own_prior")), "PREVIOUS_HASH"))
    rows = rows.withColumn("own_bad", own_bad)
    heads = log.groupBy("session_id").agg(F.max("sequence").alias("last"), F.max_by("event_hash", "sequence").alias("last_hash"))
    sums = [F.count("*").alias("n"), F.max_by("event_hash", "own_rank").alias("tail"), F.min("first_sequence").alias("first_sequence"), F.min_by("previous_event_hash", "own_rank").alias("first_previous")]
    broken = F.min(F.when(F.col("own_bad").isNotNull(), F.struct("own_rank", F.col("own_bad").alias("reason")))).alias("own_broken")
    along = Window.partitionBy("session_id").orderBy("segment_of_session")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("session_id", "segment_of_session").agg(*sums, broken).join(heads, "session_id", "left")
    parts = parts.withColumns({"ahead": F.coalesce(F.sum("n").over(before), F.lit(0)), "tail_before": F.lag("tail").over(along)})
    first_gap = F.coalesce(F.col("first_sequence") != F.coalesce("last", F.lit(-1)) + F.col("ahead") + 1, F.lit(False))
    prior = F.when(F.col("ahead") == 0, F.col("last_hash")).otherwise(F.col("tail_before"))
    first_bad = F.when(first_gap, "SEQUENCE_GAP").when(~F.col("first_previous").eqNullSafe(prior), "PREVIOUS_HASH")
    parts = parts.withColumn("broken", F.when(first_bad.isNotNull(), F.struct(F.lit(1).alias("own_rank"), first_bad.alias("reason"))).otherwise(F.col("own_broken")))
    # What comes after a session's first bad row is rejected for that row's reason.
    parts = parts.withColumn("earlier", F.first("broken", ignorenulls=True).over(before))
    late_from = F.when(F.col("earlier").isNotNull(), F.lit(1)).otherwise(F.col("broken.own_rank"))
    parts = parts.select(F.col("session_id").alias("of_session"), F.col("segment_of_session").alias("of_segment"), late_from.alias("late_from"), F.coalesce("earlier.reason", "broken.reason").alias("reject_reason")).where("late_from is not null")
    rows = rows.join(parts, (F.col("session_id") == F.col("of_session")) & (F.col("segment_of_session") == F.col("of_segment")), "left").withColumn("late", F.coalesce(F.col("own_rank") >= F.col("late_from"), F.lit(False)))
    return rows.where("not late").select(*new.columns), fork.unionByName(rows.where("late").select(*new.columns, "reject_reason"))


def compose_verdicts(actions: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """DENY absorbs; else nothing or an UNDECIDABLE is UNDECIDABLE; else ASK; else ALLOW (A2)."""
    any_of = lambda v: F.coalesce(F.bool_or(F.col("verdict") == v), F.lit(False))
    rows = actions.select(key).join(verdicts.select(key, "verdict"), key, "left").groupBy(key).agg(any_of("DENY").alias("d"), any_of("UNDECIDABLE").alias("u"), any_of("ASK").alias("a"), F.count("verdict").alias("n"))
    verdict = F.when(F.col("d"), "DENY").when(F.col("u") | (F.col("n") == 0), "UNDECIDABLE").when(F.col("a"), "ASK").otherwise("ALLOW")
    return rows.select(key, verdict.alias("verdict"))


def kernel_floor(composed: DataFrame, invariants: dict[str, Column], undecidable: str = "ASK") -> DataFrame:
    """A failed invariant denies, and its id is kept; an UNDECIDABLE is resolved to ASK or DENY (A3). invariants: id to "holds"."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in sorted(invariants.items())]))
    rows = composed.withColumn("violated", broken)
    final = F.when(F.size("violated") > 0, "DENY").when(F.col("verdict") == "UNDECIDABLE", undecidable).otherwise(F.col("verdict"))
    return rows.withColumn("final_verdict", final)


def narrowing(base: DataFrame, repo: DataFrame, key: str) -> DataFrame:
    """A repository's policy may only tighten the base (A4): rows with verdicts, outcome and reason."""
    level = lambda c: F.when(F.col(c) == "ALLOW", 0).when(F.col(c) == "ASK", 1).when(F.col(c) == "DENY", 2)
    rows = base.select(key, F.col("verdict").alias("base"), F.col("logging").alias("base_logging")).join(repo.select(key, F.col("verdict").alias("repo"), F.col("logging").alias("repo_logging")), key, "left")
    reason = F.when(F.col("repo").isNull(), F.lit(None)).when((F.col("repo") == "UNDECIDABLE") | (F.col("base") == "UNDECIDABLE"), "UNDECIDABLE").when(F.col("base_logging") & ~F.col("repo_logging"), "LOGGING_OFF").when(level("repo") < level("base"), "WIDENS")
    rows = rows.withColumn("reason", reason)
    return rows.select(key, "base", "repo", "reason", F.when(F.col("reason").isNotNull() | F.col("repo").isNull(), F.col("base")).otherwise(F.col("repo")).alias("verdict"))


def bind_decisions(decisions: DataFrame, actions: DataFrame) -> DataFrame:
    """Decisions whose action digest and authority are those expected (V11): adds ``binding``."""
    rows = decisions.join(actions.select("action_id", F.col("digest").alias("wanted"), F.col("authority").alias("wanted_authority")), "action_id", "left")
    return rows.withColumn("binding", F.when(F.col("wanted").isNull(), "UNKNOWN_ACTION").when(F.col("digest") != F.col("wanted"), "OTHER_ACTION").when(F.col("authority") != F.col("wanted_authority"), "OTHER_AUTHORITY").otherwise("BOUND")).drop("wanted", "wanted_authority")


def authorize(invocations: DataFrame, approvals: DataFrame) -> DataFrame:
    """Invocations (invocation_id, digest, verdict, at) with an outcome; each approval (approval_id, digest) serves one ASK of its digest, in order."""
    asks = ranked(invocations.where("verdict = 'ASK'"), ["digest"], ["at", "invocation_id"]).withColumnRenamed("rank", "k")
    rows = asks.unionByName(invocations.where("verdict is null or verdict <> 'ASK'").withColumn("k", F.lit(None).cast("long")))
    have = ranked(approvals, ["digest"], ["approval_id"]).withColumnRenamed("rank", "k")
    rows = rows.join(have, ["digest", "k"], "left")
    outcome = F.when(F.col("verdict") == "ALLOW", "PASSED").when((F.col("verdict") == "ASK") & F.col("approval_id").isNotNull(), "APPROVED").when(F.col("verdict") == "ASK", "WAITING").otherwise("BLOCKED")
    return rows.select("invocation_id", outcome.alias("outcome"), F.when(F.col("verdict") == "ASK", F.col("approval_id")).alias("approval_id"))
