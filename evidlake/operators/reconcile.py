"""Evidence to findings: the only job that makes findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidlake.functions.identity import content_id, finding_id
from evidlake.functions.predicates import claim_reason, split

#: Attributes that take part in the correlation fingerprint.
STABLE = ("rule", "resource", "operation", "provider", "symbol_key")
#: So many pairs go to every task.
MOST_PAIRS = 10_000


def fingerprint(category: Column, subjects: Column, locations: Column, attributes: Column) -> Column:
    """Identity of what evidence is about. subjects: array<struct<kind,id>>; locations: array<struct<path,symbol,...>>."""
    about = F.array_sort(F.array_distinct(F.transform(subjects, lambda s: F.concat_ws(":", s["kind"], s["id"]))))
    where = F.array_sort(F.array_distinct(F.transform(locations, lambda p: F.concat(p["path"], F.lit("#"), F.coalesce(p["symbol"], F.lit(""))))))
    stable = F.transform(F.array(*map(F.lit, STABLE)), lambda k: F.coalesce(attributes[k], F.lit("")))
    return content_id("finding.correlation", {"category": category, "locations": where, "stable": stable, "subjects": about})


def seal_evidence(claims: DataFrame, fields: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Admitted claims with their evidence_id over producer and claim, and rejects with a reason."""
    ok, rejects = split(claims, claim_reason({c: F.col(c) for c in ("schema_version", "observation", "interpretation", "epistemic_class", "producer_kind", "verified", "runtime_test", "reproduction_digest", "input_digests")}))
    return ok.withColumn("evidence_id", content_id("evidence", {c: F.col(c) for c in fields})), rejects


def seal_drafts(drafts: DataFrame, fields: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Drafts of a reasoning model: as evidence whose producer is a model, whatever they claim to be."""
    return seal_evidence(drafts.withColumn("producer_kind", F.lit("LLM")).withColumn("verified", F.lit(False)), fields)


def reconcile(evidence: DataFrame, rules: DataFrame, collect_ids: bool = False) -> tuple[DataFrame, DataFrame]:
    """Findings and rejected groups.

    evidence: evidence_id, category, epistemic_class, producer, subjects, locations, attributes; rules: rule_id, category. Sums are
    combined before the shuffle on the fingerprint. The members of groups are rows of their own (``finding_evidence``, by finding_id), so groups
    may have any size; ``collect_ids`` adds them as lists, for groups known to be small.
    """
    rows = evidence.join(rules, "category").withColumn("fingerprint", fingerprint(F.col("category"), F.col("subjects"), F.col("locations"), F.col("attributes")))
    contra = F.col("epistemic_class") == "CONTRADICTION"
    paths = F.transform("locations", lambda p: p["path"])
    aggs = [
        F.count("*").alias("n_evidence"), F.count_if(contra).alias("n_contradictions"), F.countDistinct(F.when(~contra, F.col("producer"))).alias("n_producers"),
        F.min(F.when(~contra, F.array_min(paths))).alias("primary_path"),
    ]
    if collect_ids:
        aggs += [F.sort_array(F.collect_set("evidence_id")).alias("evidence_ids"), F.sort_array(F.collect_set(F.when(contra, F.col("evidence_id")))).alias("contradiction_ids")]
    groups = rows.groupBy("rule_id", "category", "fingerprint").agg(*aggs)
    support = F.col("n_evidence") - F.col("n_contradictions")
    state = F.when(F.col("n_contradictions") > 0, "CONTESTED").when(F.col("n_producers") >= 2, "CORROBORATED").otherwise("DETECTED")
    groups = groups.withColumn("finding_id", finding_id(F.col("fingerprint"), F.col("category")))
    return groups.where(support > 0).withColumn("support_state", state), groups.where(support <= 0).withColumn("reject_reason", F.lit("CONTRADICTION_ONLY"))


def finding_evidence(evidence: DataFrame, rules: DataFrame) -> DataFrame:
    """(finding_id, evidence_id, contradicts): the members of findings as rows."""
    rows = evidence.join(rules, "category").withColumn("fingerprint", fingerprint(F.col("category"), F.col("subjects"), F.col("locations"), F.col("attributes")))
    return rows.select(finding_id(F.col("fingerprint"), F.col("category")).alias("finding_id"), "evidence_id", (F.col("epistemic_class") == "CONTRADICTION").alias("contradicts")).distinct()


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def apply_transitions(findings: DataFrame, requests: DataFrame, allowed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Workflow changes, one request per finding and step; requests: finding_id, step, to_state.

    Steps of one finding are folded in order: a request is taken if the last state allows it. FIX_VERIFIED is never
    reached by request; a state may follow itself. Requests per finding are few, so the fold is an expression over their sorted list.
    """
    if allowed.limit(MOST_PAIRS + 1).count() > MOST_PAIRS:
        raise ValueError(f"a workflow has at most {MOST_PAIRS} pairs of states")
    pairs = allowed.agg(F.collect_set(F.concat_ws(">", "from_state", "to_state")).alias("pairs"))
    lists = requests.groupBy("finding_id").agg(F.sort_array(F.collect_list(F.struct("step", "to_state"))).alias("steps"))
    rows = findings.join(lists, "finding_id").crossJoin(F.broadcast(pairs))

    def fold(acc: Column, s: Column) -> Column:
        good = (s["to_state"] != "FIX_VERIFIED") & ((s["to_state"] == acc["state"]) | F.array_contains(F.col("pairs"), F.concat_ws(">", acc["state"], s["to_state"])))
        return F.struct(F.when(good, s["to_state"]).otherwise(acc["state"]).alias("state"), F.when(good, acc["bad"]).otherwise(F.concat(acc["bad"], F.array(s))).alias("bad"))

    start = F.struct(F.col("state").alias("state"), F.array().cast("array<struct<step:int,to_state:string>>").alias("bad"))
    rows = rows.withColumn("r", F.aggregate("steps", start, fold))
    ok = rows.select("finding_id", F.col("state").alias("from_state"), F.col("r.state").alias("to_state"), (F.size("steps") - F.size("r.bad")).alias("applied"), (F.col("r.state") == "NEW").alias("metadata_cleared"))
    return ok, rows.select("finding_id", F.explode("r.bad").alias("b")).select("finding_id", "b.step", "b.to_state")


def explain(findings: DataFrame) -> DataFrame:
    """Presentation columns of findings, in order of state and id."""
    text = F.format_string("%s: %d evidence item(s) of %d producer(s)", F.col("support_state"), F.col("n_evidence"), F.col("n_producers"))
    where = F.when(F.col("primary_path").isNull() | F.col("primary_path").rlike(r"[\x00-\x1F\x7F]"), F.lit("(no location)")).otherwise(F.col("primary_path"))
    return findings.select("finding_id", F.concat(F.lit("Category "), F.col("category")).alias("impact"), text.alias("evidence_line"), where.alias("technical_line"))


def capped(df: DataFrame, key: str, most: int, code: str) -> tuple[DataFrame, DataFrame]:
    """Rows of keys within the cap, and one diagnostic per key beyond it: nothing is cut short unseen."""
    n = df.groupBy(key).agg(F.count("*").alias("n"))
    over = n.where(F.col("n") > most).select(key, F.lit(code).alias("diagnostic"), "n")
    return df.join(over.select(key), key, "left_anti"), over


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key that is last in ``order``."""
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), order).alias("last_row")).select("last_row.*")


def presented(df: DataFrame, of: list[str], order: list[str]) -> DataFrame:
    """Rows in the order they are shown (W10): ``position`` in each result set ``of``, by the ids and tie-breaks of ``order``, nulls first.

    A result set is what one reader sees at once, so its rows are ordered in one task; the sets themselves are spread.
    """
    by = [F.col(c).asc_nulls_first() for c in order]
    return df.withColumn("position", F.row_number().over(Window.partitionBy(*of).orderBy(*by))).orderBy(*of, "position")
