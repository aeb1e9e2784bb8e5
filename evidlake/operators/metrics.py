"""Quality metrics as integer numerators and denominators; a zero denominator is NOT_APPLICABLE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidlake.operators.graph import cut_lineage

HIGH = ("BLOCK", "HIGH")
BROADCAST_KEYS = 100_000


def applicable(den: Column) -> Column:
    return F.when(den > 0, "MEASURED").otherwise("NOT_APPLICABLE")


def finding_quality(cases: DataFrame, expected: DataFrame, emitted: DataFrame) -> DataFrame:
    """One row per metric (A9). cases: case_id; expected and emitted: case_id, finding_id, severity."""
    e = expected.select("case_id", "finding_id", F.col("severity").alias("want")).distinct()
    m = emitted.select("case_id", "finding_id", F.col("severity").alias("got")).distinct()
    pairs = e.join(m, ["case_id", "finding_id"], "full_outer")
    hit, miss, false = (F.col("want").isNotNull() & F.col("got").isNotNull(), F.col("got").isNull(), F.col("want").isNull())
    high = F.col("got").isin(*HIGH)
    sums = pairs.agg(F.count_if(hit).alias("tp"), F.count_if(miss).alias("fn"), F.count_if(false).alias("fp"), F.count_if(hit & high).alias("high_tp"), F.count_if(high).alias("high_all"), F.count_if(hit & (F.col("want") != F.col("got"))).alias("severity_mismatches"))
    clean = cases.join(e.select("case_id"), "case_id", "left_anti")
    wrong = clean.join(m.select("case_id"), "case_id", "left_semi")
    one = sums.crossJoin(clean.agg(F.count("*").alias("clean"))).crossJoin(wrong.agg(F.count("*").alias("clean_fp")))  # three one-row tables
    row = lambda name, num, den: F.struct(F.lit(name).alias("metric"), num.cast("long").alias("num"), den.cast("long").alias("den"))
    total = F.col("tp") + F.col("fn")
    unit = F.lit(1)
    rows = F.array(row("true_positives", F.col("tp"), unit), row("false_negatives", F.col("fn"), unit), row("false_positives", F.col("fp"), unit), row("recall", F.col("tp"), total), row("miss_rate", F.col("fn"), total), row("high_precision", F.col("high_tp"), F.col("high_all")), row("severity_mismatches", F.col("severity_mismatches"), unit), row("clean_false_positive_rate", F.col("clean_fp"), F.col("clean")))
    return one.select(F.explode(rows).alias("m")).select("m.*").withColumn("status", applicable(F.col("den")))


def coverage_metrics(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """(case_id, expected, completed, gap, missing, unexpected) (A10). expected: case_id, dimension; observed: also state."""
    rows = expected.select("case_id", "dimension", F.lit(True).alias("e")).join(observed.select("case_id", "dimension", "state"), ["case_id", "dimension"], "full_outer")
    e, o = F.col("e").isNotNull(), F.col("state").isNotNull()
    return rows.groupBy("case_id").agg(F.count_if(e).alias("expected"), F.count_if(e & (F.col("state") == "COVERED")).alias("completed"), F.count_if(e & o & (F.col("state") != "COVERED")).alias("gap"), F.count_if(e & ~o).alias("missing"), F.count_if(~e & o).alias("unexpected"))


def provenance_metrics(required: DataFrame, emitted: DataFrame, known: DataFrame) -> DataFrame:
    """(case_id, required, complete, incomplete, dangling) (A11). required and emitted: case_id, finding_id, evidence_ids; known: case_id, evidence_id."""
    rows = required.withColumnRenamed("evidence_ids", "want").join(emitted, ["case_id", "finding_id"], "left")
    whole = F.col("evidence_ids").isNotNull() & (F.size(F.array_except("want", F.coalesce("evidence_ids", F.array().cast("array<string>")))) == 0)
    sums = rows.groupBy("case_id").agg(F.count("*").alias("required"), F.count_if(whole).alias("complete"), F.count_if(~whole).alias("incomplete"))
    loose = emitted.select("case_id", F.explode("evidence_ids").alias("evidence_id")).distinct().join(known, ["case_id", "evidence_id"], "left_anti").groupBy("case_id").agg(F.count("*").alias("dangling"))
    return sums.join(loose, "case_id", "full_outer").select("case_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("required", "complete", "incomplete", "dangling")])


def failed_assertions(assertions: DataFrame) -> DataFrame:
    return assertions.groupBy("suite").agg(F.count("*").alias("assertions"), F.count_if(~F.col("holds")).alias("failed"))


def replay_differences(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """(key, fields): rows of two runs that differ, with the columns that do (A13); ``*missing*`` where one run lacks the row."""
    columns = [c for c in first.columns if c != key]
    a, b = first.select(key, F.struct(*columns).alias("a")), second.select(key, F.struct(*columns).alias("b"))
    rows = a.join(b, key, "full_outer")
    differ = F.array_compact(F.array(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in sorted(columns)]))
    fields = F.when(F.col("a").isNull() | F.col("b").isNull(), F.array(F.lit("*missing*"))).otherwise(differ)
    return rows.select(key, fields.alias("fields")).where(F.size("fields") > 0)


def nearest_rank(samples: DataFrame, by: str, percent: int = 95, cells: int = 1024, few: int = 4096) -> DataFrame:
    """(by, n, value): of each key the ceil(percent / 100 * n)-th sample, exact, by refining histograms; nulls count as least.

    A round counts the samples between a key's bounds in ``cells`` cells and goes on in the cell that holds the rank, whose least and
    greatest samples are the new bounds. A key is done when its bounds meet or hold ``few`` samples; only those are put in order. Counts are combined before
    the shuffle, so a hot key costs ``cells`` rows a task.
    """
    rank = F.floor((F.col("n") * percent + 99) / 100).cast("long")
    start = samples.groupBy(by).agg(F.count("*").alias("n"), F.min("sample").alias("low"), F.max("sample").alias("high"), F.count("sample").alias("inside"))
    state = cut_lineage(start.select(F.col(by).alias("key"), "n", "low", "high", "inside", (rank - (F.col("n") - F.col("inside"))).alias("rank")))
    going = (F.col("inside") > few) & (F.col("low") < F.col("high")) & (F.col("rank") > 0)
    held = F.broadcast if state.count() <= BROADCAST_KEYS else (lambda df: df)
    within = lambda keys: samples.select(F.col(by).alias("k"), "sample").join(held(keys), F.col("k").eqNullSafe(F.col("key"))).where("sample between low and high")
    while not (open_ := state.where(going)).isEmpty():
        cell = F.least(F.floor((F.col("sample") - F.col("low")) / (F.col("high") - F.col("low")) * cells), F.lit(cells - 1)).alias("cell")
        counts = within(open_).groupBy("key", "n", "rank", cell).agg(F.count("*").alias("inside"), F.min("sample").alias("low"), F.max("sample").alias("high"))
        lists = counts.groupBy("key", "n", "rank").agg(F.sort_array(F.collect_list(F.struct("cell", "inside", "low", "high"))).alias("cells"))  # at most ``cells``

        def down(found: Column, c: Column) -> Column:
            """Goes along the cells until the rank that is left lies in one."""
            here = F.struct((found["left"] - c["inside"]).alias("left"), c["inside"].alias("inside"), c["low"].alias("low"), c["high"].alias("high"))
            return F.when(found["left"] > 0, here).otherwise(found)

        kind = F.lit(None).cast(samples.schema["sample"].dataType)
        none = F.struct(F.col("rank").alias("left"), F.lit(0).cast("long").alias("inside"), kind.alias("low"), kind.alias("high"))
        found = lists.select("key", "n", F.aggregate("cells", none, down).alias("f"))
        found = found.select("key", "n", "f.low", "f.high", "f.inside", (F.col("f.left") + F.col("f.inside")).alias("rank"))
        state = cut_lineage(state.where(~going).unionByName(found))
    met = F.col("low") == F.col("high")
    few_left = within(state.where((F.col("rank") > 0) & ~met)).groupBy("key").agg(F.sort_array(F.collect_list("sample")).alias("ordered"))
    few_left = few_left.withColumnRenamed("key", "k")
    rows = state.join(few_left, F.col("key").eqNullSafe(F.col("k")), "left")
    value = F.when(F.col("rank") > 0, F.when(met, F.col("low")).otherwise(F.get("ordered", (F.col("rank") - 1).cast("int"))))
    return rows.select(F.col("key").alias(by), "n", value.alias("value"))


def latency_summary(samples: DataFrame, cap: float, by: str, qualified: Column | None = None) -> DataFrame:
    """Nearest-rank p95, the ceil(0.95 n)-th sample, in integers so that no rounding steps over a rank."""
    p95 = nearest_rank(samples, by).withColumnRenamed("value", "p95")
    known = F.lit(True) if qualified is None else qualified
    return p95.withColumn("result", F.when(~known, "UNQUALIFIED").when(F.col("p95") < cap, "PASS").otherwise("FAIL"))


def guard_quality(expected: DataFrame, decided: DataFrame) -> DataFrame:
    """(metric, n) of expected and decided verdicts by case (A17); a case without a decision was rejected as malformed."""
    rows = expected.select("case_id", F.col("verdict").alias("want")).join(decided.select("case_id", F.col("verdict").alias("got")), "case_id", "left")
    w, g = F.col("want"), F.col("got")
    sums = rows.agg(F.count_if((w == "ALLOW") & (g == "ALLOW")).alias("allowed"), F.count_if((w == "ALLOW") & g.isin("DENY", "ASK")).alias("false_blocks"), F.count_if((w == "DENY") & (g == "DENY")).alias("denied"), F.count_if((w == "DENY") & (g == "ALLOW")).alias("incorrect_allows"), F.count_if((w == "MALFORMED") & g.isNull()).alias("malformed_rejected"))
    names = ("allowed", "false_blocks", "denied", "incorrect_allows", "malformed_rejected")
    return sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("n")) for c in names])).alias("m")).select("m.*")


def release_gates(metrics: DataFrame, policy: DataFrame) -> DataFrame:
    """Metrics (suite, metric, num, den) against caps (metric, max_num, max_den), cross-multiplied."""
    rows = policy.join(metrics, "metric", "left")
    ok = F.col("num") * F.col("max_den") <= F.col("max_num") * F.col("den")
    return rows.select("suite", "metric", F.when(F.col("num").isNull() | (F.col("den") == 0), "NOT_MEASURED").when(ok, "PASS").otherwise("FAIL").alias("gate"))


def metric_changes(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """(metric, change) of (metric, num, den, higher_is_better), never one score."""
    b = baseline.select("metric", F.col("num").alias("bn"), F.col("den").alias("bd"), F.col("higher_is_better").alias("bh"))
    rows = b.join(candidate, "metric", "full_outer")
    move = F.col("num") * F.col("bd") - F.col("bn") * F.col("den")
    better = F.when(F.col("higher_is_better"), move > 0).otherwise(move < 0)
    change = F.when(F.col("bn").isNull(), "NEWLY_MEASURED").when(F.col("num").isNull(), "NO_LONGER_MEASURED").when((F.col("bd") == 0) | (F.col("den") == 0) | (F.col("bh") != F.col("higher_is_better")), "INCOMPARABLE").when(move == 0, "UNCHANGED").when(better, "IMPROVED").otherwise("REGRESSED")
    return rows.select("metric", change.alias("change"))
