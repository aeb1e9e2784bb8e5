"""Registered queries: each operator over columns derived from the driver's tables, beside the same question in SQL.

A carrier is a projection written once for either engine; it grows with its table. Names begin with the operator's id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidlake.functions import identity as I
from evidlake.functions import predicates as P
from evidlake.operators import coverage, deltas, detect, events, graph, invariants, metrics, paths, posture, reconcile, regression
from evidlake.sources import ddl, packages, reports, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def sid(namespace: str, json: str) -> str:
    return f"'sha256:' || sha256('evidlake.v1' || chr(0) || '{namespace}' || chr(0) || ({json}))"


# --- evidence from events --------------------------------------------------------------------------------------------

EV = "SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"


def ev(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))


def evidence(s: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("src/"), (F.col("k") % 4).cast("string"), F.lit(".js"))
    return ev(s, d).select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("evidence_id"), F.col("event_type").alias("category"), F.when(F.col("event_id") % 17 == 0, "CONTRADICTION").otherwise("FACT").alias("epistemic_class"),
        F.struct(F.concat(F.lit("p"), (F.col("event_id") % 3).cast("string")).alias("id"), F.lit("1").alias("version"), F.lit("STATIC_RULE").alias("kind")).alias("producer"),
        F.array(F.struct(F.lit("user").alias("kind"), F.col("user_id").cast("string").alias("id"))).alias("subjects"), F.array(F.struct(path.alias("path"), F.lit(None).cast("string").alias("symbol"))).alias("locations"),
        F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("attributes"), "event_id", "user_id", "k",
    )


def rules(s: SparkSession, d: str) -> DataFrame:
    return ev(s, d).select(F.concat(F.lit("rule-"), "event_type").alias("rule_id"), F.col("event_type").alias("category")).distinct()


FP = sid("finding.correlation", """'{"category":"' || event_type || '","locations":["src/' || (k % 4) || '.js#"],"stable":["","","","",""],"subjects":["user:' || user_id || '"]}'""")
FINDINGS = f"""WITH e AS (SELECT *, {FP} AS fp, event_id % 17 = 0 AS contra FROM ({EV})), g AS (SELECT event_type AS category, fp, count(*) AS n_evidence, count(*) FILTER (contra) AS n_contradictions,
  count(DISTINCT event_id % 3) FILTER (NOT contra) AS n_producers, min('src/' || (k % 4) || '.js') FILTER (NOT contra) AS primary_path, string_agg('e' || event_id, ',' ORDER BY 'e' || event_id) AS ids FROM e GROUP BY 1, 2)"""
FID = sid("finding", """'{"category":"' || category || '","fingerprint":"' || fp || '"}'""")


@query("a1_reconcile", f"{FINDINGS} SELECT {FID} AS finding_id, 'rule-' || category AS rule_id, CASE WHEN n_contradictions > 0 THEN 'CONTESTED' WHEN n_producers >= 2 THEN 'CORROBORATED' ELSE 'DETECTED' END AS support_state, n_evidence, n_contradictions, n_producers, primary_path, ids AS evidence_ids FROM g WHERE n_evidence > n_contradictions")
def a1(s, d):
    found, _ = reconcile.reconcile(evidence(s, d), rules(s, d), collect_ids=True)
    return found.select("finding_id", "rule_id", "support_state", "n_evidence", "n_contradictions", "n_producers", "primary_path", F.array_join("evidence_ids", ",").alias("evidence_ids"))


@query("a1_rejects", f"{FINDINGS} SELECT {FID} AS finding_id, n_evidence FROM g WHERE n_evidence = n_contradictions")
def a1_rejects(s, d):
    return reconcile.reconcile(evidence(s, d), rules(s, d), collect_ids=False)[1].select("finding_id", "n_evidence")


@query("a1_members", f"{FINDINGS.split(', g AS')[0]} SELECT DISTINCT {FID.replace('category', 'event_type').replace('event_type\":', 'category\":')} AS finding_id, 'e' || event_id AS evidence_id, contra AS contradicts FROM e")
def a1_members(s, d):
    return reconcile.finding_evidence(evidence(s, d), rules(s, d))


@query("a15_duplicates", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def a15(s, d):
    return reconcile.duplicate_keys(ev(s, d), "user_id", "event_type")


@query("w12_explain", f"{FINDINGS} SELECT {FID} AS finding_id, 'Category ' || category AS impact, CASE WHEN n_contradictions > 0 THEN 'CONTESTED' WHEN n_producers >= 2 THEN 'CORROBORATED' ELSE 'DETECTED' END || ': ' || n_evidence || ' evidence item(s) of ' || n_producers || ' producer(s)' AS evidence_line, coalesce(primary_path, '(no location)') AS technical_line FROM g WHERE n_evidence > n_contradictions")
def w12(s, d):
    return reconcile.explain(reconcile.reconcile(evidence(s, d), rules(s, d), collect_ids=False)[0])


@query("w11_capped_diagnostics", "SELECT user_id, 'TOO_MANY' AS diagnostic, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 60")
def w11(s, d):
    return reconcile.capped(ev(s, d), "user_id", 60, "TOO_MANY")[1]


@query("w10_latest", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1")
def w10(s, d):
    return reconcile.latest(ev(s, d), "user_id", "event_id").select("user_id", "event_id")


CLAIM_JSON = """'{"category":"' || event_type || '","observation":"seen ' || event_id || '","producer":"p' || (event_id % 3) || '"}'"""
CLAIM_REASON = "CASE WHEN event_id % 13 = 0 THEN 'SCHEMA_VERSION' WHEN event_id % 11 = 0 THEN 'BLANK_OBSERVATION' WHEN event_id % 7 = 0 AND event_id % 2 = 0 THEN 'FACT_WITH_INTERPRETATION' WHEN event_id % 5 = 0 AND event_id % 3 <> 0 AND event_id % 2 = 0 THEN 'MODEL_CLAIMS_TOO_MUCH' WHEN k = 3 THEN 'VERIFIED_CLAIM' WHEN k = 4 THEN 'DIGEST_NOT_AN_INPUT' END"


def claims(s, d):
    i = F.col("event_id")
    fact = i % 2 == 0
    return ev(s, d).select(
        "event_id", F.col("event_type").alias("category"), F.concat(F.lit("p"), (i % 3).cast("string")).alias("producer"), F.when(i % 13 == 0, "2").otherwise("1").alias("schema_version"), F.when((i % 11 == 0) & (i % 13 != 0), " ").otherwise(F.concat(F.lit("seen "), i.cast("string"))).alias("observation"),
        F.when(i % 7 == 0, "because").alias("interpretation"), F.when(fact, "FACT").otherwise("INFERENCE").alias("epistemic_class"), F.when((i % 5 == 0) & (i % 3 != 0), "LLM").otherwise("STATIC_RULE").alias("producer_kind"),
        (F.col("k") == 3).alias("verified"), F.lit(False).alias("runtime_test"), F.when(F.col("k") == 4, "sha256:x").alias("reproduction_digest"), F.array(F.lit("sha256:y")).alias("input_digests"),
    )


@query("v4_seal_evidence", f"SELECT event_id, {sid('evidence', CLAIM_JSON)} AS evidence_id FROM ({EV}) WHERE ({CLAIM_REASON}) IS NULL")
def v4(s, d):
    return reconcile.seal_evidence(claims(s, d), ("category", "producer", "observation"))[0].select("event_id", "evidence_id")


@query("v5_claim_rules", f"SELECT event_id, {CLAIM_REASON} AS reject_reason FROM ({EV}) WHERE ({CLAIM_REASON}) IS NOT NULL")
def v5(s, d):
    return reconcile.seal_evidence(claims(s, d), ("category", "producer", "observation"))[1].select("event_id", "reject_reason")


@query("v7_seal_drafts", f"SELECT event_id, {sid('evidence', CLAIM_JSON)} AS evidence_id FROM ({EV}) WHERE event_id % 13 <> 0 AND event_id % 11 <> 0 AND event_id % 2 = 1 AND k <> 4")
def v7(s, d):
    return reconcile.seal_drafts(claims(s, d), ("category", "producer", "observation"))[0].select("event_id", "evidence_id")


@query("v6_forged_ids", f"SELECT event_id FROM ({EV}) WHERE event_id % 97 = 0")
def v6(s, d):
    own = I.content_id("event", {"id": F.col("event_id"), "kind": F.col("event_type")})
    stored = ev(s, d).withColumn("stored", F.when(F.col("event_id") % 97 == 0, F.concat(own, F.lit("x"))).otherwise(own))
    return I.recheck(stored, "stored", own).select("event_id")


@query("v1_content_id", f"SELECT event_id, {sid('event', chr(39) + '{' + chr(34) + 'id' + chr(34) + ':' + chr(39) + ' || event_id || ' + chr(39) + ',' + chr(34) + 'kind' + chr(34) + ':' + chr(34) + chr(39) + ' || event_type || ' + chr(39) + chr(34) + ',' + chr(34) + 'note' + chr(34) + ':null}' + chr(39))} AS id FROM events")
def v1(s, d):
    return ev(s, d).select("event_id", I.content_id("event", {"kind": F.col("event_type"), "id": F.col("event_id"), "note": F.lit(None).cast("string")}).alias("id"))


@query("v2_float_fragments", "SELECT l_orderkey, l_linenumber, l_quantity <> floor(l_quantity) OR l_linenumber % 2 = 0 AS has_float FROM lineitem")
def v2(s, d):
    fragment = F.concat(F.lit('{"q":'), F.when(F.col("l_linenumber") % 2 == 0, "1.5").otherwise(F.col("l_quantity").cast("long").cast("string")), F.lit(',"s":"2.5"}'))
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", I.has_float(fragment).alias("has_float"))


@query("v3_semantic_id", f"SELECT c_custkey, CASE WHEN c_custkey % 10 <> 0 THEN {sid('actor', chr(39) + '[' + chr(34) + chr(39) + ' || c_name || ' + chr(39) + chr(34) + ',' + chr(34) + chr(39) + ' || c_mktsegment || ' + chr(39) + chr(34) + ']' + chr(39))} END AS id FROM customer")
def v3(s, d):
    segment = F.when(F.col("c_custkey") % 10 == 0, " ").otherwise(F.col("c_mktsegment"))
    return table(s, d, "customer").select("c_custkey", I.semantic_id("actor", F.col("c_name"), segment).alias("id"))


NODE = lambda kind, key: sid("graph.node", f"""'{{"key":"' || {key} || '","kind":"{kind}"}}'""")
EDGE = lambda a, r, b: sid("graph.edge", f"""'{{"relation":"{r}","source":"' || {a} || '","target":"' || {b} || '"}}'""")


@query("v8_graph_ids", f"SELECT n_nationkey, {NODE('NATION', 'n_name')} AS node, {EDGE(NODE('NATION', 'n_name'), 'PART_OF', NODE('REGION', 'r_name'))} AS edge FROM nation JOIN region ON n_regionkey = r_regionkey")
def v8(s, d):
    n = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    a, b = I.node_id(F.lit("NATION"), F.col("n_name")), I.node_id(F.lit("REGION"), F.col("r_name"))
    return n.select("n_nationkey", a.alias("node"), I.edge_id(a, F.lit("PART_OF"), b).alias("edge"))


@query("v9_finding_id", f"SELECT event_id, {sid('finding', chr(39) + '{' + chr(34) + 'category' + chr(34) + ':' + chr(34) + chr(39) + ' || event_type || ' + chr(39) + chr(34) + ',' + chr(34) + 'fingerprint' + chr(34) + ':' + chr(34) + 'f' + chr(39) + ' || user_id || ' + chr(39) + chr(34) + '}' + chr(39))} AS finding_id FROM events")
def v9(s, d):
    return ev(s, d).select("event_id", I.finding_id(F.concat(F.lit("f"), F.col("user_id").cast("string")), F.col("event_type")).alias("finding_id"))


@query("v10_action_digest", f"SELECT event_id, {sid('action', chr(39) + '{' + chr(34) + 'kind' + chr(34) + ':' + chr(34) + chr(39) + ' || event_type || ' + chr(39) + chr(34) + ',' + chr(34) + 'params' + chr(34) + ':null,' + chr(34) + 'target' + chr(34) + ':{' + chr(34) + 'a' + chr(34) + ':' + chr(34) + chr(39) + ' || user_id || ' + chr(39) + chr(34) + ',' + chr(34) + 'z' + chr(34) + ':' + chr(34) + '1' + chr(34) + '}}' + chr(39))} AS digest FROM events")
def v10(s, d):
    target = F.create_map(F.lit("z"), F.lit("1"), F.lit("a"), F.col("user_id").cast("string"))
    return ev(s, d).select("event_id", I.action_digest(F.col("event_type"), target, F.lit(None).cast("string")).alias("digest"))


# --- predicates ------------------------------------------------------------------------------------------------------


@query("v12_paths", "SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'ABSOLUTE' WHEN 1 THEN 'DRIVE' WHEN 2 THEN 'BACKSLASH' WHEN 3 THEN 'DOT_OR_EMPTY_PART' WHEN 4 THEN 'DOT_OR_EMPTY_PART' WHEN 5 THEN 'BLANK' WHEN 6 THEN 'PADDED' END AS reason FROM events")
def v12(s, d):
    shape = ["/src/a.py", "C:src/a.py", "src\\a.py", "src/../a.py", "src//a.py", " ", " src/a.py", "src/a.py", "src/b/c.rs"]
    return ev(s, d).select("event_id", P.path_reason(F.get(F.array(*map(F.lit, shape)), (F.col("event_id") % 9).cast("int"))).alias("reason"))


@query("v13_tool_paths", "SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'src/a b.py' WHEN 1 THEN 'a.py' WHEN 4 THEN 'src/a+b.py' WHEN 6 THEN 'src/' || user_id || '.py' END AS path FROM events")
def v13(s, d):
    shape = F.array(*map(F.lit, ["src/a%20b.py", "src/../a.py", "../a.py", "file:///a.py", "./src/a+b.py", "src/%zz.py"]), F.concat(F.lit("src/./"), F.col("user_id").cast("string"), F.lit(".py")))
    return ev(s, d).select("event_id", P.normalised_tool_path(F.get(shape, (F.col("event_id") % 7).cast("int"))).alias("path"))


@query("v14_formats", "SELECT event_id, event_id % 4 <> 3 AS utc, event_id % 2 = 0 AS digest FROM events")
def v14(s, d):
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("event_id") % 4 == 3, "+00:00").when(F.col("event_id") % 4 == 2, ".123Z").otherwise("Z"))
    return ev(s, d).select("event_id", P.is_utc_timestamp(text).alias("utc"), P.is_digest(F.concat(F.lit("sha256:"), F.when(F.col("event_id") % 2 == 0, F.sha2("event_type", 256)).otherwise("ABC"))).alias("digest"))


@query("v15_attributes", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'TOO_DEEP' WHEN event_id % 3 = 1 THEN 'VALUE_TOO_LONG' END AS reason FROM events")
def v15(s, d):
    value = F.when(F.col("event_id") % 3 == 0, F.lit("[[[[1]]]]")).when(F.col("event_id") % 3 == 1, F.repeat(F.lit("x"), 200)).otherwise(F.lit('"[[[[["'))
    return ev(s, d).select("event_id", P.attribute_reason(F.create_map(F.lit("a"), value), value_bytes=100, depth=3).alias("reason"))


@query("v16_packs", "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'BLANK_ID' WHEN p_partkey % 5 = 1 THEN 'REPEATED_CAPABILITY' WHEN p_partkey % 5 = 2 THEN 'UNKNOWN_DIMENSION' END AS reason FROM part")
def v16(s, d):
    k = F.col("p_partkey") % 5
    return table(s, d, "part").select("p_partkey", P.pack_reason(F.when(k == 0, " ").otherwise(F.col("p_name")), F.lit("1"), F.when(k == 1, F.array(F.lit("a"), F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b"))), F.when(k == 2, F.array(F.lit("OTHER"))).otherwise(F.array(F.lit("DETECTION")))).alias("reason"))


@query("v18_graph_contract", f"SELECT 'NODE_ID' AS code, 'bad' || p_partkey AS id FROM part WHERE p_partkey % 5 = 0 AND p_partkey % 7 <> 0 UNION ALL SELECT 'BLANK_KEY', CASE WHEN p_partkey % 5 = 0 THEN 'bad' || p_partkey ELSE {NODE('PART', chr(39) + ' ' + chr(39))} END FROM part WHERE p_partkey % 7 = 0 UNION ALL SELECT 'CONFIDENCE', {EDGE(chr(39) + 'a' + chr(39) + ' || p_partkey', 'REFS', chr(39) + 'b' + chr(39))} FROM part WHERE p_partkey % 11 = 0")
def v18(s, d):
    p = table(s, d, "part")
    key = F.when(F.col("p_partkey") % 7 == 0, " ").otherwise(F.col("p_partkey").cast("string"))
    nodes = p.select(F.lit("PART").alias("kind"), key.alias("key"), F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("bad"), F.col("p_partkey").cast("string"))).otherwise(I.node_id(F.lit("PART"), key)).alias("node_id"))
    edges = p.select(F.concat(F.lit("a"), F.col("p_partkey").cast("string")).alias("source"), F.lit("REFS").alias("relation"), F.lit("b").alias("target"), F.when(F.col("p_partkey") % 11 == 0, "GUESSED").otherwise("EXTRACTED").alias("confidence"))
    return graph.contract_check(nodes, edges.withColumn("edge_id", I.edge_id(F.col("source"), F.col("relation"), F.col("target"))))


@query("v19_accepted_risk", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'BLANK_REASON' WHEN o_orderkey % 4 = 1 THEN 'EXPIRES_FIRST' WHEN o_orderkey % 4 = 2 THEN 'EXPIRED' WHEN o_orderkey % 3 = 0 THEN 'OTHER_AUTHORIZATION' END AS reason FROM orders")
def v19(s, d):
    o = F.col("o_orderkey")
    return table(s, d, "orders").select("o_orderkey", P.risk_reason(F.when(o % 10 == 0, " ").otherwise("r"), F.lit("a"), F.lit(100), F.when(o % 4 == 1, 50).when(o % 4 == 2, 150).otherwise(900), F.when(o % 3 == 0, "x").otherwise("y"), F.lit("y"), F.lit(200)).alias("reason"))


@query("v20_transitions", "SELECT o_orderkey AS finding_id, 'NEW' AS from_state, CASE WHEN o_orderkey % 3 = 0 THEN 'IN_PROGRESS' WHEN o_orderkey % 3 = 1 THEN 'NEW' ELSE 'TRIAGED' END AS to_state, CASE WHEN o_orderkey % 3 = 0 THEN 2 WHEN o_orderkey % 3 = 1 THEN 0 ELSE 1 END AS applied, o_orderkey % 3 = 1 AS metadata_cleared FROM orders")
def v20(s, d):
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("finding_id"))
    m = F.col("finding_id") % 3
    steps = F.array(F.struct(F.lit(2).alias("step"), F.when(m == 2, "FIX_VERIFIED").otherwise("IN_PROGRESS").alias("to_state")), F.struct(F.lit(1).alias("step"), F.when(m == 1, "FIX_PROPOSED").otherwise("TRIAGED").alias("to_state")))
    requests = o.select("finding_id", F.explode(steps).alias("r")).select("finding_id", "r.*")
    allowed = s.createDataFrame(list(P.TRANSITIONS), "from_state string, to_state string")
    return reconcile.apply_transitions(o.withColumn("state", F.lit("NEW")), requests, allowed)[0]


@query("v21_project_invariants", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'BAD_ID' WHEN c_custkey % 4 = 1 THEN 'AUTHORITY_KEY' WHEN c_custkey % 4 = 2 THEN 'UNKNOWN_KEY' END AS reason FROM customer")
def v21(s, d):
    m = F.col("c_custkey") % 4
    keys = F.when(m == 1, F.array(F.lit("scope"), F.lit("authority"))).when(m == 2, F.array(F.lit("colour"))).otherwise(F.array(F.lit("scope")))
    name = F.when(m == 0, F.col("c_name")).otherwise(F.concat(F.lit("inv-"), F.col("c_custkey").cast("string")))
    return table(s, d, "customer").select("c_custkey", P.invariant_reason(name, keys, ("scope", "kind", "authority"), ("authority",)).alias("reason"))


@query("v23_coverage_flags", "SELECT event_id, event_id % 3 = 0 AS complete, event_id % 3 <> 0 AS gap, event_id % 3 = 0 AND event_id % 2 = 0 AS supports_posture FROM events")
def v23(s, d):
    flags = P.coverage_flags(F.when(F.col("event_id") % 3 == 0, "COVERED").when(F.col("event_id") % 3 == 1, "PARTIAL"), F.when(F.col("event_id") % 2 == 0, "STATIC_POSTURE").otherwise("DETECTION"))
    return ev(s, d).select("event_id", *[v.alias(k) for k, v in flags.items()])


# --- coverage --------------------------------------------------------------------------------------------------------

EXPECTED = "(SELECT u.user_id, t.event_type FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT DISTINCT event_type FROM events) t WHERE NOT (t.event_type = 'error' AND u.user_id % 4 = 0))"
OBSERVED = "(SELECT user_id, event_type, max(event_id) AS m FROM events WHERE event_id % 7 <> 0 AND user_id % 5 <> 0 GROUP BY 1, 2)"


def expected_observed(s, d):
    e = ev(s, d)
    kinds = e.groupBy(F.lit(1).alias("one")).agg(F.collect_set("event_type").alias("kinds"))
    users = e.select("user_id").distinct().withColumn("one", F.lit(1)).join(kinds, "one").select("user_id", F.explode("kinds").alias("event_type"))
    want = users.where("not (event_type = 'error' and user_id % 4 = 0)").select(F.col("user_id").cast("string").alias("subject"), F.col("event_type").alias("capability"), F.lit(None).cast("string").alias("producer"))
    got = e.where("event_id % 7 <> 0 and user_id % 5 <> 0").groupBy("user_id", "event_type").agg(F.max("event_id").alias("m"))
    return want, got.select(F.concat(F.lit(" "), F.col("user_id").cast("string")).alias("subject"), F.col("event_type").alias("capability"), F.lit(None).cast("string").alias("producer"), F.when(F.col("m") % 2 == 0, "COVERED").otherwise("PARTIAL").alias("state"))


MATRIX = f"SELECT coalesce(e.user_id, o.user_id) AS user_id, coalesce(e.event_type, o.event_type) AS capability, CASE WHEN e.user_id IS NULL THEN 'OBSERVED_UNEXPECTED' WHEN o.user_id IS NULL THEN 'MISSING_EXPECTED' ELSE 'OBSERVED_EXPECTED' END AS entry, CASE WHEN o.user_id IS NULL THEN 'UNAVAILABLE' WHEN o.m % 2 = 0 THEN 'COVERED' ELSE 'PARTIAL' END AS state, CASE WHEN o.user_id IS NULL THEN 'PRODUCER_NOT_REPORTED' END AS reason FROM {EXPECTED} e FULL JOIN {OBSERVED} o USING (user_id, event_type)"


@query("j5_coverage_matrix", f"SELECT CAST(user_id AS VARCHAR) AS subject, capability, entry, state, reason FROM ({MATRIX})")
def j5(s, d):
    return coverage.coverage_matrix(*expected_observed(s, d))[0].select("subject", "capability", "entry", "state", "reason")


@query("j5_gap_count", f"SELECT capability, count(*) FILTER (state <> 'COVERED') AS gaps, count(*) AS entries FROM ({MATRIX}) GROUP BY 1")
def j5_gaps(s, d):
    return coverage.gap_count(coverage.coverage_matrix(*expected_observed(s, d))[0], "capability")


@query("j6_profile_matrix", "SELECT p_brand AS subject, dimension, CASE WHEN dimension = 'DETECTION' THEN 'COVERED' WHEN has THEN 'UNAVAILABLE' ELSE 'UNSUPPORTED' END AS state, CASE WHEN dimension = 'DETECTION' THEN NULL WHEN has THEN 'PACK_NOT_RUN' ELSE 'NO_PACK' END AS reason FROM (SELECT p_brand, dimension, bool_or(dimension = 'STATIC_POSTURE' AND p_size > 48) AS has FROM part CROSS JOIN (SELECT unnest(['DETECTION','STATIC_POSTURE','LIVE_POSTURE','DYNAMIC_VERIFICATION','REMEDIATION']) AS dimension) GROUP BY 1, 2)")
def j6(s, d):
    p = table(s, d, "part")
    return coverage.profile_matrix(p.select(F.col("p_brand").alias("subject")).distinct(), p.where("p_size > 48").select(F.col("p_brand").alias("subject"), F.lit("STATIC_POSTURE").alias("dimension")), P.DIMENSIONS)


@query("j7_project_profile", "SELECT s_nationkey AS repo_id, subject, coalesce(string_agg(DISTINCT pack, ',' ORDER BY pack), '') AS pack_ids, CASE WHEN count(pack) > 0 THEN 'AVAILABLE' ELSE 'NOT_INSTALLED' END AS availability FROM (SELECT s_nationkey, 'k' || (s_suppkey % 6) AS subject FROM supplier) a LEFT JOIN (SELECT DISTINCT 'pack-' || (c_nationkey % 3) AS pack, 'k' || (c_nationkey % 4) AS subject FROM customer) b USING (subject) GROUP BY 1, 2")
def j7(s, d):
    found = table(s, d, "supplier").select(F.col("s_nationkey").alias("repo_id"), F.concat(F.lit("k"), (F.col("s_suppkey") % 6).cast("string")).alias("subject"))
    packs = table(s, d, "customer").select(F.concat(F.lit("pack-"), (F.col("c_nationkey") % 3).cast("string")).alias("pack_id"), F.concat(F.lit("k"), (F.col("c_nationkey") % 4).cast("string")).alias("subject"))
    return coverage.project_profile(found, packs).withColumn("pack_ids", F.array_join("pack_ids", ","))


AREA_LIST = "[" + ",".join(f"'{a}'" for a in coverage.AREAS) + "]"
ROLL = f"SELECT u, i, a, CASE (u * 7 + i * 3) % 9 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'PARTIAL' ELSE 'COVERED' END AS state FROM (SELECT c_custkey AS u, unnest(range(0, 10)) AS i, unnest({AREA_LIST}) AS a FROM customer) WHERE NOT (u % 6 = 0 AND i = 4)"


def areas(s, d):
    rows = table(s, d, "customer").select(F.col("c_custkey").alias("evaluation"), F.posexplode(F.array(*map(F.lit, coverage.AREAS))).alias("i", "area"))
    m = (F.col("evaluation") * 7 + F.col("i") * 3) % 9
    return rows.where("not (evaluation % 6 = 0 and i = 4)").select("evaluation", "area", F.when(m == 0, "FAILED").when(m == 1, "PARTIAL").otherwise("COVERED").alias("state"))


@query("a5_roll_up", f"SELECT u AS evaluation, CASE WHEN bool_or(state = 'FAILED') THEN 'FAILED' WHEN bool_or(state = 'PARTIAL') THEN 'PARTIAL' ELSE 'COVERED' END AS state FROM ({ROLL}) GROUP BY 1 HAVING count(*) = 10")
def a5(s, d):
    return coverage.roll_up(areas(s, d), "evaluation")[0]


@query("a5_roll_up_rejects", "SELECT c_custkey AS evaluation, 'MISSING_AREA' AS reject_reason FROM customer WHERE c_custkey % 6 = 0")
def a5_rejects(s, d):
    return coverage.roll_up(areas(s, d), "evaluation")[1]


@query("a6_run_coverage", "SELECT o_orderkey AS run_id, CASE o_orderkey % 8 WHEN 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'FAILED' ELSE 'COVERED' END WHEN 1 THEN 'FAILED' WHEN 2 THEN 'TIMED_OUT' WHEN 3 THEN 'SKIPPED' WHEN 4 THEN 'UNAVAILABLE' WHEN 5 THEN 'UNSUPPORTED' WHEN 6 THEN 'PARTIAL' ELSE 'FAILED' END AS state, CASE o_orderkey % 8 WHEN 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'MALFORMED' END WHEN 1 THEN 'ENGINE_FAILED' WHEN 2 THEN 'ENGINE_TIMED_OUT' WHEN 3 THEN 'ENGINE_CANCELLED' WHEN 4 THEN 'ENGINE_UNAVAILABLE' WHEN 5 THEN 'ENGINE_UNSUPPORTED' WHEN 6 THEN 'OUTPUT_LIMIT_REACHED' END AS reason FROM orders")
def a6(s, d):
    names = [t for t, *_ in coverage.TERMINATIONS] + ["OTHER"]
    runs = table(s, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.get(F.array(*map(F.lit, names)), (F.col("o_orderkey") % 8).cast("int")).alias("termination"))
    return coverage.run_coverage(runs, runs.where("run_id % 3 = 0"))


@query("a7_evaluation_outputs", "SELECT o_orderkey AS evaluation_id, part, CASE part WHEN 'OBSERVATION' THEN 'evaluated ' || o_orderpriority ELSE o_orderpriority || ' is ' || o_orderstatus END AS text FROM orders CROSS JOIN (SELECT unnest(['OBSERVATION', 'INTERPRETATION']) AS part)")
def a7(s, d):
    return coverage.evaluation_outputs(table(s, d, "orders").select(F.col("o_orderkey").alias("evaluation_id"), F.col("o_orderpriority").alias("invariant_id"), F.col("o_orderstatus").alias("state")))


@query("a16_reasoning_coverage", "SELECT event_id AS step_id, CASE event_id % 4 WHEN 1 THEN 'SKIPPED' WHEN 2 THEN 'FAILED' ELSE 'COVERED' END AS state, CASE event_id % 4 WHEN 1 THEN 'SKIPPED_BY_POLICY' WHEN 2 THEN 'REASONER_FAILED' END AS reason FROM events WHERE event_id % 4 <> 0")
def a16(s, d):
    return coverage.reasoning_coverage(ev(s, d).select(F.col("event_id").alias("step_id"), F.get(F.array(*map(F.lit, ("DISABLED", "NETWORK_POLICY", "FAILED", "DONE"))), (F.col("event_id") % 4).cast("int")).alias("outcome")))


# --- verdicts and chains ---------------------------------------------------------------------------------------------

VERDICT = "CASE l_partkey % 11 WHEN 0 THEN 'DENY' WHEN 1 THEN 'UNDECIDABLE' WHEN 2 THEN 'ASK' WHEN 3 THEN 'ASK' WHEN 4 THEN NULL ELSE 'ALLOW' END"
COMPOSED = f"SELECT o_orderkey, CASE WHEN bool_or(v = 'DENY') THEN 'DENY' WHEN coalesce(bool_or(v = 'UNDECIDABLE'), false) OR count(v) = 0 THEN 'UNDECIDABLE' WHEN bool_or(v = 'ASK') THEN 'ASK' ELSE 'ALLOW' END AS verdict FROM orders LEFT JOIN (SELECT l_orderkey, {VERDICT} AS v FROM lineitem) ON o_orderkey = l_orderkey GROUP BY 1"


def verdicts(s, d):
    m = F.col("l_partkey") % 11
    v = F.when(m == 0, "DENY").when(m == 1, "UNDECIDABLE").when(m.isin(2, 3), "ASK").when(m != 4, "ALLOW")
    return events.compose_verdicts(table(s, d, "orders"), table(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), v.alias("verdict")), "o_orderkey")


@query("a2_compose_verdicts", COMPOSED)
def a2(s, d):
    return verdicts(s, d)


@query("a3_kernel_floor", f"SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'k1' ELSE '' END AS violated, CASE WHEN o_orderkey % 5 = 0 THEN 'DENY' WHEN verdict = 'UNDECIDABLE' THEN 'ASK' ELSE verdict END AS final_verdict FROM ({COMPOSED})")
def a3(s, d):
    return events.kernel_floor(verdicts(s, d), {"k1": F.col("o_orderkey") % 5 != 0, "k2": F.lit(True)}).select("o_orderkey", F.array_join("violated", ",").alias("violated"), "final_verdict")


@query("a4_narrowing", f"SELECT o_orderkey, verdict AS base, CASE WHEN o_orderkey % 4 <> 0 THEN r END AS repo, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN r = 'UNDECIDABLE' OR verdict = 'UNDECIDABLE' THEN 'UNDECIDABLE' WHEN o_orderkey % 7 = 1 THEN 'LOGGING_OFF' WHEN lr < lb THEN 'WIDENS' END AS reason FROM (SELECT *, CASE r WHEN 'ALLOW' THEN 0 WHEN 'ASK' THEN 1 WHEN 'DENY' THEN 2 END AS lr, CASE verdict WHEN 'ALLOW' THEN 0 WHEN 'ASK' THEN 1 WHEN 'DENY' THEN 2 END AS lb FROM (SELECT *, CASE o_orderkey % 3 WHEN 0 THEN 'ALLOW' WHEN 1 THEN 'ASK' ELSE 'DENY' END AS r FROM ({COMPOSED})))")
def a4(s, d):
    base = verdicts(s, d).withColumn("logging", F.lit(True))
    repo = table(s, d, "orders").where("o_orderkey % 4 <> 0").select("o_orderkey", F.get(F.array(F.lit("ALLOW"), F.lit("ASK"), F.lit("DENY")), (F.col("o_orderkey") % 3).cast("int")).alias("verdict"), (F.col("o_orderkey") % 7 != 1).alias("logging"))
    return events.narrowing(base, repo, "o_orderkey").drop("verdict")


@query("v11_decision_binding", "SELECT o_orderkey AS action_id, CASE WHEN o_orderkey % 6 = 0 THEN 'UNKNOWN_ACTION' WHEN o_orderkey % 6 = 1 THEN 'OTHER_ACTION' WHEN o_orderkey % 6 = 2 THEN 'OTHER_AUTHORITY' ELSE 'BOUND' END AS binding FROM orders")
def v11(s, d):
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("action_id"), F.sha2("o_orderpriority", 256).alias("digest"))
    m = F.col("action_id") % 6
    decisions = o.select("action_id", F.when(m == 1, "x").otherwise(F.col("digest")).alias("digest"), F.when(m == 2, "y").otherwise("kernel").alias("authority"))
    return events.bind_decisions(decisions, o.where("action_id % 6 <> 0").withColumn("authority", F.lit("kernel"))).select("action_id", "binding")


@query("w9_approvals", "WITH i AS (SELECT event_id, user_id AS g, CASE WHEN event_id % 3 = 0 THEN 'ASK' WHEN event_id % 3 = 1 THEN 'ALLOW' ELSE 'DENY' END AS v FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY g, v ORDER BY event_id) AS k FROM i), a AS (SELECT o_orderkey, o_custkey AS g, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders WHERE o_orderkey % 2 = 0) SELECT event_id AS invocation_id, CASE v WHEN 'ALLOW' THEN 'PASSED' WHEN 'ASK' THEN CASE WHEN o_orderkey IS NULL THEN 'WAITING' ELSE 'APPROVED' END ELSE 'BLOCKED' END AS outcome, o_orderkey AS approval_id FROM r LEFT JOIN a ON r.v = 'ASK' AND r.g = a.g AND r.k = a.k")
def w9(s, d):
    m = F.col("event_id") % 3
    asked = ev(s, d).select(F.col("event_id").alias("invocation_id"), F.col("user_id").alias("digest"), F.when(m == 0, "ASK").when(m == 1, "ALLOW").otherwise("DENY").alias("verdict"), F.col("event_id").alias("at"))
    return events.authorize(asked, table(s, d, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("approval_id"), F.col("o_custkey").alias("digest")))


CHAIN = "SELECT *, lag(h) OVER (PARTITION BY user_id ORDER BY q) AS prev FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS q, sha256(user_id || '-' || event_id) AS h FROM events)"


def chain(s, d, tampered=True):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    rows = ev(s, d).select("user_id", "event_id", (F.row_number().over(w) - 1).cast("long").alias("sequence"), F.sha2(F.concat_ws("-", "user_id", "event_id"), 256).alias("event_hash"))
    rows = rows.withColumn("previous_event_hash", F.lag("event_hash").over(w)).withColumn("own", F.col("event_hash")).withColumnRenamed("user_id", "session_id")
    if not tampered:
        return rows
    rows = rows.withColumn("event_hash", F.when(F.col("event_id") % 997 == 1, F.concat("event_hash", F.lit("x"))).otherwise(F.col("event_hash"))).withColumn("previous_event_hash", F.when(F.col("event_id") % 1009 == 2, F.lit("y")).otherwise(F.col("previous_event_hash")))
    return rows.where("event_id % 1013 <> 3")


TAMPERED = f"SELECT user_id, event_id, q, h AS own, CASE WHEN event_id % 997 = 1 THEN h || 'x' ELSE h END AS h, CASE WHEN event_id % 1009 = 2 THEN 'y' ELSE prev END AS prev FROM ({CHAIN}) WHERE event_id % 1013 <> 3"


@query("w7_verify_sessions", f"WITH t AS ({TAMPERED}), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY q) - 1 AS rn, lag(h) OVER (PARTITION BY user_id ORDER BY q) AS p FROM t), c AS (SELECT *, CASE WHEN h <> own THEN 'EVENT_HASH_MISMATCH' WHEN q <> rn THEN 'SEQUENCE_GAP' WHEN prev IS DISTINCT FROM p THEN 'PREVIOUS_HASH_MISMATCH' END AS code FROM r) SELECT user_id AS session_id, coalesce(arg_min(code, rn) FILTER (code IS NOT NULL), CASE WHEN user_id % 9 = 0 THEN 'NO_TRUSTED_HEAD' WHEN user_id % 9 = 1 THEN 'HEAD_MISMATCH' ELSE 'VERIFIED' END) AS outcome, count(*) AS n_events FROM c GROUP BY user_id")
def w7(s, d):
    rows = chain(s, d)
    heads = events.session_heads(rows).where("session_id % 9 <> 0").select("session_id", F.when(F.col("session_id") % 9 == 1, "z").otherwise(F.col("head_hash")).alias("head_hash"))
    return events.verify_sessions(rows, heads, F.col("own"))


@query("w8_session_heads", f"SELECT user_id AS session_id, arg_max(h, q) AS head_hash, count(*) AS n_events FROM ({CHAIN}) GROUP BY 1")
def w8(s, d):
    return events.session_heads(chain(s, d, False))


@query("k6_chain_append", f"SELECT user_id AS session_id, q AS sequence FROM ({CHAIN}) WHERE q >= 5 AND (user_id % 4 <> 0 OR q < 9)")
def k6(s, d):
    rows = chain(s, d, False).select("session_id", "sequence", "event_hash", "previous_event_hash")
    new = rows.where("sequence >= 3 and not (session_id % 4 = 0 and sequence = 9)")
    return events.chain_append(new, rows.where("sequence < 5"))[0].select("session_id", "sequence")


@query("k6_chain_rejects", f"SELECT user_id AS session_id, q AS sequence, 'SEQUENCE_GAP' AS reject_reason FROM ({CHAIN}) WHERE q >= 10 AND user_id % 4 = 0")
def k6_rejects(s, d):
    rows = chain(s, d, False).select("session_id", "sequence", "event_hash", "previous_event_hash")
    new = rows.where("sequence >= 3 and not (session_id % 4 = 0 and sequence = 9)")
    return events.chain_append(new, rows.where("sequence < 5"))[1].select("session_id", "sequence", "reject_reason")


# --- deltas ----------------------------------------------------------------------------------------------------------

DOCS_SQL = "SELECT doc_id, 'p' || doc_id AS path, sha256(coalesce(text, '')) AS oid FROM documents"


def snapshots(s, d):
    rows = table(s, d, "documents").select(F.lit("r").alias("repo_id"), F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("oid"), F.lit("100644").alias("mode"), "doc_id")
    after = rows.where("doc_id % 3 <> 1").withColumn("oid", F.when(F.col("doc_id") % 6 == 2, F.concat("oid", F.lit("!"))).otherwise(F.col("oid"))).withColumn("mode", F.when(F.col("doc_id") % 30 == 5, "100755").otherwise(F.col("mode")))
    return rows.where("doc_id % 3 <> 0"), after


@query("j1_file_changes", f"WITH b AS (SELECT doc_id, path, oid, '100644' AS mode FROM ({DOCS_SQL}) WHERE doc_id % 3 <> 0), a AS (SELECT doc_id, path, CASE WHEN doc_id % 6 = 2 THEN oid || '!' ELSE oid END AS oid, CASE WHEN doc_id % 30 = 5 THEN '100755' ELSE '100644' END AS mode FROM ({DOCS_SQL}) WHERE doc_id % 3 <> 1), gone AS (SELECT *, row_number() OVER (PARTITION BY oid, mode ORDER BY path) AS k FROM b WHERE path NOT IN (SELECT path FROM a)), come AS (SELECT *, row_number() OVER (PARTITION BY oid, mode ORDER BY path) AS k FROM a WHERE path NOT IN (SELECT path FROM b)) SELECT CASE WHEN a.mode <> b.mode THEN 'TYPE_CHANGED' ELSE 'MODIFIED' END AS kind, a.path, NULL AS previous_path FROM a JOIN b USING (path) WHERE a.oid <> b.oid OR a.mode <> b.mode UNION ALL SELECT CASE WHEN g.path IS NULL THEN 'ADDED' WHEN c.path IS NULL THEN 'DELETED' ELSE 'RENAMED' END, coalesce(c.path, g.path), CASE WHEN c.path IS NOT NULL THEN g.path END FROM gone g FULL JOIN come c ON g.oid = c.oid AND g.mode = c.mode AND g.k = c.k")
def j1(s, d):
    return deltas.file_changes(*snapshots(s, d)).drop("repo_id")


@query("j22_graph_diff", f"WITH b AS (SELECT * FROM ({DOCS_SQL}) WHERE doc_id % 3 <> 0), a AS (SELECT doc_id, path, CASE WHEN doc_id % 6 = 2 THEN oid || '!' ELSE oid END AS oid FROM ({DOCS_SQL}) WHERE doc_id % 3 <> 1) SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'ADDED' WHEN a.path IS NULL THEN 'REMOVED' ELSE 'MODIFIED' END AS change FROM b FULL JOIN a ON a.path = b.path WHERE a.oid IS DISTINCT FROM b.oid")
def j22(s, d):
    return graph.graph_diff(*snapshots(s, d), "path", "oid")


PACK = "SELECT DISTINCT 'e' || (l_suppkey % 2) AS ecosystem, l_partkey AS name, l_linenumber AS version FROM lineitem"


def package_sets(s, d):
    rows = table(s, d, "lineitem").select(F.concat(F.lit("e"), (F.col("l_suppkey") % 2).cast("string")).alias("ecosystem"), F.col("l_partkey").alias("name"), F.col("l_linenumber").alias("version"), (F.year("l_shipdate") >= 1998).alias("late"))
    return rows.where("not late").drop("late"), rows.where("late").drop("late")


ADDED = f"({PACK} WHERE year(l_shipdate) >= 1998 EXCEPT {PACK} WHERE year(l_shipdate) < 1998)"


@query("j2_dependency_added", f"SELECT * FROM {ADDED}")
def j2(s, d):
    return deltas.set_delta(*package_sets(s, d))[0]


@query("j2_dependency_removed", f"{PACK} WHERE year(l_shipdate) < 1998 EXCEPT {PACK} WHERE year(l_shipdate) >= 1998")
def j2_removed(s, d):
    return deltas.set_delta(*package_sets(s, d))[1]


@query("j3_advisory_matches", f"SELECT a.*, 'adv' || p_partkey AS advisory_id FROM {ADDED} a JOIN part ON a.name = p_partkey AND a.ecosystem = 'e' || (p_partkey % 2) AND a.version IN (p_size % 7, 3) WHERE p_partkey % 4 = 0")
def j3(s, d):
    advisories = table(s, d, "part").where("p_partkey % 4 = 0").select(F.concat(F.lit("adv"), F.col("p_partkey").cast("string")).alias("advisory_id"), F.concat(F.lit("e"), (F.col("p_partkey") % 2).cast("string")).alias("ecosystem"), F.col("p_partkey").alias("package"), F.array((F.col("p_size") % 7).cast("int"), F.lit(3)).alias("affected_versions"))
    return deltas.advisory_matches(deltas.set_delta(*package_sets(s, d))[0], advisories)


@query("j4_cache_status", f"SELECT a.*, CASE WHEN p_partkey IS NULL THEN 'SKIPPED_BY_POLICY' WHEN 1000 - p_size * 30 BETWEEN 0 AND 500 THEN 'FRESH_CACHE' ELSE 'STALE_CACHE' END AS status FROM {ADDED} a LEFT JOIN part ON a.name = p_partkey AND a.ecosystem = 'e0' AND a.version = 1")
def j4(s, d):
    cache = table(s, d, "part").select(F.lit("e0").alias("ecosystem"), F.col("p_partkey").alias("name"), F.lit(1).alias("version"), (F.col("p_size") * 30).alias("fetched_at"))
    return deltas.cache_status(deltas.set_delta(*package_sets(s, d))[0], cache, F.lit(1000), 500).drop("fetched_at")


# --- posture ---------------------------------------------------------------------------------------------------------

KIND = "CASE event_type WHEN 'signup' THEN 'CREATE' WHEN 'view' THEN 'ALTER' WHEN 'error' THEN 'DROP' WHEN 'click' THEN 'GRANT' ELSE 'REVOKE' END"
DDL = f"SELECT event_id, user_id AS obj, {KIND} AS kind, 'role' || (k % 3) AS role, CASE WHEN (k // 3) % 4 = 3 THEN 'ALL' ELSE 'priv' || ((k // 3) % 4) END AS privilege, k FROM ({EV})"


def statements(s, d):
    t = F.col("event_type")
    kind = F.when(t == "signup", "CREATE").when(t == "view", "ALTER").when(t == "error", "DROP").when(t == "click", "GRANT").otherwise("REVOKE")
    p = F.floor(F.col("k") / 3) % 4
    return ev(s, d).select(F.col("user_id").alias("obj"), kind.alias("kind"), kind.alias("action"), posture.position(F.lit(0), F.col("event_id")).alias("pos"), F.concat(F.lit("role"), (F.col("k") % 3).cast("string")).alias("role"), F.when(p == 3, "ALL").otherwise(F.concat(F.lit("priv"), p.cast("string"))).alias("privilege"), F.when(F.col("k") % 2 == 0, F.concat(F.lit("cmd"), (F.col("k") % 5).cast("string"))).alias("command"), F.array(F.concat(F.lit("role"), (F.col("k") % 3).cast("string"))).alias("roles"), (F.col("k") % 3 == 0).alias("has_using"), F.when(F.col("k") % 4 == 0, F.col("k") % 8 == 0).alias("has_with_check"), "k", "event_id")


@query("w2_last_value", f"SELECT obj, arg_max('cmd' || (k % 5), event_id) AS command, max(event_id) AS event_id FROM ({DDL}) WHERE k % 2 = 0 GROUP BY 1")
def w2(s, d):
    return posture.last_value(statements(s, d), ["obj"], "command").select("obj", "command", F.col("provenance.statement_index").alias("event_id"))


@query("w3_policies", f"WITH p AS (SELECT *, count(*) FILTER (kind IN ('CREATE', 'DROP')) OVER (PARTITION BY obj ORDER BY event_id) AS epoch FROM ({DDL}) WHERE kind IN ('CREATE', 'ALTER', 'DROP')), f AS (SELECT * FROM (SELECT *, max(epoch) OVER (PARTITION BY obj) AS m FROM p) WHERE epoch = m), g AS (SELECT obj, arg_min(kind, event_id) AS o, count(*) FILTER (kind = 'ALTER') AS a, arg_max('cmd' || (k % 5), event_id) FILTER (k % 2 = 0) AS c, arg_max(k % 3 = 0, event_id) AS has_using, arg_max(k % 8 = 0, event_id) FILTER (k % 4 = 0) AS has_with_check FROM f GROUP BY obj), s AS (SELECT *, CASE WHEN o = 'CREATE' THEN 'LIVE' WHEN o = 'DROP' AND a = 0 THEN 'DROPPED' WHEN o = 'DROP' THEN 'ALTERED_AFTER_DROP' ELSE 'ALTERED_ONLY' END AS status FROM g) SELECT obj, status, CASE status WHEN 'LIVE' THEN c WHEN 'DROPPED' THEN NULL ELSE 'UNKNOWN' END AS command, has_using, has_with_check FROM s")
def w3(s, d):
    return posture.policies(statements(s, d).where("kind in ('CREATE', 'ALTER', 'DROP')"), ["obj"]).select("obj", "status", "command", "has_using", "has_with_check")


GRANTS = f"SELECT g.obj, g.role, g.privilege, g.at FROM (SELECT obj, role, privilege, max(event_id) AS at FROM ({DDL}) WHERE kind = 'GRANT' GROUP BY 1, 2, 3) g LEFT JOIN (SELECT obj, role, privilege, max(event_id) AS r FROM ({DDL}) WHERE kind = 'REVOKE' GROUP BY 1, 2, 3) o USING (obj, role, privilege) LEFT JOIN (SELECT obj, role, max(event_id) AS r FROM ({DDL}) WHERE kind = 'REVOKE' AND privilege = 'ALL' GROUP BY 1, 2) e USING (obj, role) WHERE g.at > coalesce(o.r, -1) AND g.at > coalesce(e.r, -1)"


@query("w4_grants", GRANTS)
def w4(s, d):
    return posture.grants(statements(s, d).where("kind in ('GRANT', 'REVOKE')"), ["obj"]).select("obj", "role", "privilege", F.col("granted_at.statement_index").alias("at"))


@query("w3_removals", f"SELECT obj, max(event_id) AS removed_at FROM ({DDL}) WHERE kind = 'DROP' GROUP BY 1")
def w3_removals(s, d):
    return posture.removals(statements(s, d), ["obj"]).select("obj", F.col("removed_at.statement_index").alias("removed_at"))


@query("w5_functions", f"WITH s AS (SELECT *, CASE WHEN k % 2 = 0 THEN 'DEFINER' END AS sm FROM ({DDL})), l AS (SELECT s.* FROM s LEFT JOIN (SELECT obj, max(event_id) AS x FROM s WHERE kind = 'DROP' GROUP BY 1) USING (obj) WHERE event_id > coalesce(x, -1)), m AS (SELECT l.* FROM l LEFT JOIN (SELECT obj, max(event_id) AS y FROM l WHERE kind = 'CREATE' GROUP BY 1) USING (obj) WHERE kind IN ('CREATE', 'ALTER') AND event_id >= coalesce(y, -1)), v AS (SELECT obj, event_id, CASE WHEN kind = 'CREATE' THEN coalesce(sm, 'INVOKER') ELSE sm END AS sm FROM m) SELECT obj, arg_max(sm, event_id) FILTER (sm IS NOT NULL) AS security_mode, max(event_id) AS at FROM v GROUP BY 1")
def w5(s, d):
    rows = statements(s, d).withColumns({"security_mode": F.when(F.col("k") % 2 == 0, "DEFINER"), "search_path": F.lit(None).cast("string")})
    return posture.functions(rows, ["obj"])[0].select("obj", "security_mode", F.col("provenance.statement_index").alias("at"))


@query("w5_execute_grants", f"WITH s AS (SELECT * FROM ({DDL})), l AS (SELECT s.* FROM s LEFT JOIN (SELECT obj, max(event_id) AS x FROM s WHERE kind = 'DROP' GROUP BY 1) USING (obj) WHERE event_id > coalesce(x, -1)), g AS (SELECT obj, role, max(event_id) FILTER (kind = 'GRANT') AS g, max(event_id) FILTER (kind = 'REVOKE') AS r FROM l GROUP BY 1, 2) SELECT obj, role, g AS at FROM g WHERE g > coalesce(r, -1)")
def w5_grants(s, d):
    rows = statements(s, d).withColumns({"security_mode": F.lit(None).cast("string"), "search_path": F.lit(None).cast("string")})
    return posture.functions(rows, ["obj"])[1].select("obj", "role", F.col("granted_at.statement_index").alias("at"))


@query("w6_gaps", f"SELECT user_id AS repo_id, count(*) FILTER (event_id % 10 < 2 OR event_id % 10 = 2 AND event_id % 3 = 0) AS gaps, CASE WHEN count(*) FILTER (event_id % 10 < 2 OR event_id % 10 = 2 AND event_id % 3 = 0) > 0 THEN 'PARTIAL' ELSE 'COVERED' END AS state FROM events GROUP BY 1")
def w6(s, d):
    m = F.col("event_id") % 10
    rows = ev(s, d).select(F.col("user_id").alias("repo_id"), posture.position(F.lit(0), F.col("event_id")).alias("pos"), F.when(m == 0, "UNSUPPORTED").when(m == 1, "MALFORMED").when(m == 2, "SUPPORTED").otherwise("IGNORED_SAFE").alias("outcome"), F.when(F.col("event_id") % 3 != 0, "public").alias("object_schema"))
    return posture.gaps(rows)[1]


CONFIG = "SELECT n_nationkey AS repo_id, n_nationkey % 3 <> 0 AS api_enabled, ['public', 'api'] AS schemas, CASE WHEN n_nationkey % 5 = 0 THEN 'PARTIAL' ELSE 'COVERED' END AS parse_coverage FROM nation"
EXPO = "CASE WHEN repo_id % 5 = 0 THEN 'UNKNOWN' WHEN repo_id % 3 <> 0 AND object_schema IN ('public', 'api') THEN 'EXPOSED' ELSE 'HIDDEN' END"
RELS = "SELECT c_nationkey AS repo_id, CASE c_custkey % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'storage' ELSE 'private' END AS object_schema, c_name AS object_name, CASE c_custkey % 4 WHEN 0 THEN true WHEN 1 THEN false END AS rls_enabled, c_custkey FROM customer"


def config(s, d):
    k = F.col("n_nationkey")
    return table(s, d, "nation").select(k.alias("repo_id"), (k % 3 != 0).alias("api_enabled"), F.array(F.lit("public"), F.lit("api")).alias("schemas"), F.when(k % 5 == 0, "PARTIAL").otherwise("COVERED").alias("parse_coverage"))


def relations(s, d):
    k = F.col("c_custkey")
    return table(s, d, "customer").select(F.col("c_nationkey").alias("repo_id"), F.when(k % 3 == 0, "public").when(k % 3 == 1, "storage").otherwise("private").alias("object_schema"), F.col("c_name").alias("object_name"), F.when(k % 4 == 0, True).when(k % 4 == 1, False).alias("rls_enabled"), "c_custkey")


@query("j8_row_security", f"SELECT repo_id, object_name, {EXPO} AS exposure, CASE WHEN rls_enabled IS NULL THEN 'UNKNOWN' WHEN rls_enabled THEN 'ENABLED' ELSE 'DISABLED' END AS row_security FROM ({RELS}) WHERE {EXPO} <> 'HIDDEN'")
def j8(s, d):
    return posture.row_security(relations(s, d), config(s, d)).select("repo_id", "object_name", "exposure", "row_security")


@query("j9_api_grants", f"SELECT object_name, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 6 = 0 THEN 'COVERAGE_GAP' ELSE 'EVIDENCE' END AS output FROM ({RELS}) WHERE {EXPO} = 'EXPOSED' AND c_custkey % 9 <> 0")
def j9(s, d):
    k = F.col("c_custkey")
    rows = relations(s, d).withColumns({"role": F.when(k % 9 == 0, "owner").otherwise("anon"), "privilege": F.when(k % 2 == 0, "ALL").otherwise("SELECT"), "granted_at": posture.position(F.lit(1), F.lit(1)), "revoked_at": F.when(k % 6 == 0, posture.position(F.lit(1), F.lit(2)))})
    return posture.api_grants(rows, config(s, d)).select("object_name", "output")


@query("j10_api_schemas", f"SELECT repo_id, 'API' AS kind, CASE WHEN api_enabled THEN 'ENABLED' ELSE 'DISABLED' END AS name FROM ({CONFIG}) UNION ALL SELECT repo_id, 'SCHEMA', unnest(schemas) FROM ({CONFIG}) WHERE api_enabled")
def j10(s, d):
    return posture.api_schemas(config(s, d))


@query("j11_function_authority", f"SELECT repo_id, object_name, 'SECURITY_MODE' AS fact, 'DEFINER' AS value FROM ({RELS}) WHERE c_custkey % 2 = 0 UNION ALL SELECT repo_id, object_name, 'SEARCH_PATH', 'public' FROM ({RELS}) WHERE c_custkey % 3 = 0 UNION ALL SELECT repo_id, object_name, 'EXPOSURE', {EXPO} FROM ({RELS}) WHERE {EXPO} <> 'UNKNOWN' UNION ALL SELECT repo_id, object_name, 'EXECUTE_GRANT', 'anon' FROM ({RELS}) WHERE c_custkey % 7 = 0")
def j11(s, d):
    k = F.col("c_custkey")
    rows = relations(s, d).withColumns({"security_mode": F.when(k % 2 == 0, "DEFINER"), "search_path": F.when(k % 3 == 0, "public")})
    return posture.function_authority(rows, rows.where("c_custkey % 7 = 0").withColumn("role", F.lit("anon")), config(s, d)).drop("object_schema")


LIVE = f"SELECT *, 'pol' || c_custkey AS policy_name, CASE WHEN c_custkey % 2 = 0 THEN 'LIVE' ELSE 'DROPPED' END AS status FROM ({RELS})"


def live(s, d):
    k = F.col("c_custkey")
    return relations(s, d).withColumns({"policy_name": F.concat(F.lit("pol"), k.cast("string")), "status": F.when(k % 2 == 0, "LIVE").otherwise("DROPPED"), "command": F.lit("ALL"), "roles": F.array(F.lit("b"), F.lit("a")), "has_using": k % 4 == 0, "has_with_check": F.lit(False)})


@query("j12_policy_posture", f"SELECT repo_id, object_name, policy_name, 'ALL' AS command, 'a,b' AS roles, c_custkey % 4 = 0 AS has_using FROM ({LIVE}) WHERE status = 'LIVE'")
def j12(s, d):
    return posture.policy_posture(live(s, d)).drop("object_schema", "has_with_check")


@query("j13_policy_delta", "WITH p AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 11 <> 0) SELECT k AS policy, 'POLICY_REMOVED' AS change FROM p WHERE k % 5 = 0 UNION ALL SELECT k, 'COMMAND_SCOPE_EXPANDED_TO_ALL' FROM p WHERE k % 5 = 1 UNION ALL SELECT k, 'ROLE_SCOPE_EXPANDED' FROM p WHERE k % 5 <> 0 AND k % 3 = 0 UNION ALL SELECT k, 'USING_REMOVED' FROM p WHERE k % 5 <> 0 AND k % 7 = 0")
def j13(s, d):
    k = F.col("policy")
    rows = table(s, d, "customer").select(F.lit(1).alias("repo_id"), F.lit("t").alias("relation"), F.col("c_custkey").alias("policy"))
    before = rows.withColumns({"command": F.lit("SELECT"), "roles": F.array(F.lit("a")), "has_using": F.lit(True), "has_with_check": F.lit(False), "provenance": F.when(k % 11 != 0, "x")})
    after = before.where(k % 5 != 0).withColumns({"command": F.when(k % 5 == 1, "ALL").otherwise("SELECT"), "roles": F.when(k % 3 == 0, F.array(F.lit("a"), F.lit("public"))).otherwise(F.array(F.lit("a"))), "has_using": k % 7 != 0})
    return deltas.policy_delta(before, after).select("policy", "change")


@query("j14_storage_posture", f"SELECT repo_id, object_name, 'RELATION' AS kind, NULL AS policy_name FROM ({RELS}) WHERE object_schema = 'storage' UNION ALL SELECT repo_id, object_name, 'POLICY', policy_name FROM ({LIVE}) WHERE object_schema = 'storage' AND status = 'LIVE'")
def j14(s, d):
    return posture.storage_posture(relations(s, d), live(s, d))


@query("j15_edge_auth", "SELECT s_nationkey AS repo_id, s_name AS function FROM supplier WHERE s_suppkey % 3 = 0 AND s_suppkey % 4 = 1")
def j15(s, d):
    return posture.edge_auth(*edge_sides(s, d))[0].select("repo_id", "function")


def edge_sides(s, d):
    k = F.col("s_suppkey")
    rows = table(s, d, "supplier")
    cfg = rows.select(F.col("s_nationkey").alias("repo_id"), F.col("s_name").alias("function"), F.when(k % 3 == 0, False).when(k % 3 == 1, True).alias("verify_jwt"))
    src = rows.where("s_suppkey % 4 > 0").select(F.col("s_nationkey").alias("repo_id"), F.col("s_name").alias("function"), F.when(k % 4 == 2, "await jwtVerify(token)").when(k % 4 == 3, "await import (name)").otherwise("return new Response()").alias("line"))
    return cfg, src


@query("j16_config_coverage", "SELECT n_nationkey AS repo_id, CASE WHEN n_nationkey % 4 = 0 THEN 'UNAVAILABLE' WHEN n_nationkey % 3 = 0 THEN 'PARTIAL' ELSE 'COVERED' END AS state, CASE WHEN n_nationkey % 3 = 0 THEN 2 ELSE 0 END AS diagnostics FROM nation")
def j16(s, d):
    repos = config(s, d)
    return posture.config_coverage(repos.select("repo_id"), repos.where("repo_id % 4 <> 0"), repos.where("repo_id % 3 = 0").select("repo_id", F.explode("schemas")))


@query("v17_admit_outputs", "SELECT event_id AS evidence_id, CASE WHEN event_type = 'error' THEN 'UNKNOWN_CAPABILITY' WHEN event_id % 5 = 0 THEN 'PRODUCER_KIND' WHEN event_id % 7 = 0 THEN 'PRODUCER_PREFIX' END AS reject_reason FROM events WHERE event_type = 'error' OR event_id % 5 = 0 OR event_id % 7 = 0")
def v17(s, d):
    i = F.col("event_id")
    e = ev(s, d)
    out = e.select(i.alias("evidence_id"), F.col("event_type").alias("capability"), F.when(i % 5 == 0, "LLM").otherwise("STATIC_RULE").alias("producer_kind"), F.when(i % 7 == 0, "other").otherwise("evid.x").alias("producer_id"))
    mapping = e.where("event_type <> 'error'").select(F.lit("evid.").alias("producer_prefix"), F.col("event_type").alias("capability"), F.lit("STATIC_POSTURE").alias("dimension")).distinct()
    return posture.admit_outputs(out, mapping)[1].select("evidence_id", "reject_reason")
