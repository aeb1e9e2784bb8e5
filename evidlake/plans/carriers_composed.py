"""Registered queries of composed operators, and of results that stand for themselves as rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidlake.operators import detect, graph, invariants, paths, posture, reconcile
from evidlake.plans.carriers import edge_sides, query
from evidlake.plans.carriers_more import ELEVATED, PROTECTED, ROLE, TENANT_STATES, layers, observations, scope_sides, known_clients, role_guards, table, tenant_inputs, tenant_states, tree_graph, versions
from evidlake.sources import sinks

# --- W1: migrations to posture ---------------------------------------------------------------------------------------

#: What migration k of a repository says, by k % 13; {j} is one of two objects.
SCRIPTS = (
    "create table app.t{j} (id int);",
    "alter table app.t{j} enable row level security;",
    "-- off; again\nalter table app.t{j} disable row level security;",
    "create policy p on app.t{j} for select to anon using (name = 'a;b');",
    "alter policy p on app.t{j} to authenticated;",
    "drop policy if exists p on app.t{j};",
    "grant select, insert on table app.t{j} to anon;",
    "revoke all on table app.t{j} from anon;",
    "create function app.f{j}() returns int language sql security definer as 'select 1'; grant execute on function app.f{j}() to anon;",
    "alter function app.f{j}() security invoker;",
    "drop function if exists app.f{j}();",
    "do $$ begin null; end $$;",
    "create schema app; create view app.v with (security_invoker = true) as select 1;",
)


def migrations(s, d):
    k, repo = F.col("o_orderkey"), F.col("o_custkey")
    script = F.get(F.array(*map(F.lit, SCRIPTS)), (k % 13).cast("int"))
    text = F.replace(script, F.lit("{j}"), (F.floor(k / 13) % 2).cast("string"))
    key = F.when(repo % 10 == 9, F.lit("1" * 14)).otherwise(F.lpad(k.cast("string"), 14, "0"))
    path = F.concat(F.lit("supabase/migrations/"), key, F.lit("_"), k.cast("string"), F.lit(".sql"))
    return table(s, d, "orders").select(repo.alias("repo_id"), path.alias("path"), text.alias("content"))


W1_SQL = """
WITH g AS (
  SELECT o_custkey AS r, o_orderkey AS k, o_orderkey % 13 AS m, (o_orderkey // 13) % 2 AS j,
         o_custkey % 10 = 9 AND count(*) OVER (PARTITION BY o_custkey) > 1 AS bad
  FROM orders),
s AS (SELECT * FROM g WHERE NOT bad),
t AS (
  SELECT r, j, bool_or(m <= 7) AS is_table, bool_or(m = 0) AS made, arg_max(m, k) FILTER (m IN (1, 2)) AS rls,
         coalesce(max(k) FILTER (m = 3), -1) AS made_p, coalesce(max(k) FILTER (m = 4), -1) AS altered_p,
         coalesce(max(k) FILTER (m = 5), -1) AS dropped_p,
         coalesce(max(k) FILTER (m = 6), -1) AS granted, coalesce(max(k) FILTER (m = 7), -1) AS revoked,
         coalesce(max(k) FILTER (m = 8), -1) AS made_f, coalesce(max(k) FILTER (m = 9), -1) AS altered_f,
         coalesce(max(k) FILTER (m = 10), -1) AS dropped_f
  FROM s GROUP BY r, j)
SELECT r AS repo_id, 'repository' AS part, '' AS object,
       CASE WHEN bool_or(bad) THEN 'REJECTED' WHEN bool_or(m = 11) THEN 'PARTIAL' ELSE 'COVERED' END AS detail
FROM g GROUP BY r
UNION ALL
SELECT r, 'gap', '', count(*)::VARCHAR FROM s WHERE m = 11 GROUP BY r
UNION ALL
SELECT r, 'schema', 'app', '' FROM s WHERE m = 12 GROUP BY r
UNION ALL
SELECT r, 'VIEW', 'v', 'true UNKNOWN ENABLED 0' FROM s WHERE m = 12 GROUP BY r
UNION ALL
SELECT r, 'TABLE', 't' || j,
       made || ' ' || CASE rls WHEN 1 THEN 'ENABLED' WHEN 2 THEN 'DISABLED' ELSE 'UNKNOWN' END || ' UNKNOWN '
       || CASE WHEN greatest(made_p, altered_p) > dropped_p THEN 1 ELSE 0 END
FROM t WHERE is_table
UNION ALL
SELECT r, 'policy', 't' || j,
       CASE WHEN made_p > dropped_p THEN 'SELECT' ELSE 'UNKNOWN' END || ' '
       || CASE WHEN altered_p > made_p THEN 'authenticated' ELSE 'anon' END || ' '
       || CASE WHEN made_p > dropped_p THEN 'true' ELSE '' END
FROM t WHERE greatest(made_p, altered_p) > dropped_p
UNION ALL
SELECT r, 'policy removal', 't' || j, '' FROM t WHERE dropped_p > made_p
UNION ALL
SELECT r, 'grant', 't' || j, p || ' anon' FROM t, (SELECT unnest(['SELECT', 'INSERT']) AS p) WHERE granted > revoked
UNION ALL
SELECT r, 'function', 'f' || j, (made_f > dropped_f) || ' ' || CASE WHEN altered_f > made_f THEN 'INVOKER' ELSE 'DEFINER' END
FROM t WHERE greatest(made_f, altered_f) > dropped_f
UNION ALL
SELECT r, 'execute', 'f' || j, 'anon' FROM t WHERE made_f > dropped_f
"""


@query("w1_reduce_posture", W1_SQL)
def w1(s, d):
    found = posture.reduce_posture(migrations(s, d))
    blank = F.lit("")
    words = lambda *c: F.concat_ws(" ", *[F.coalesce(F.col(x).cast("string"), blank) for x in c])
    relations = found["relations"]
    rows = [
        found["repositories"].select("repo_id", F.lit("repository"), blank, F.col("state")),
        found["gaps"].groupBy("repo_id").count().select("repo_id", F.lit("gap"), blank, F.col("count").cast("string")),
        found["schemas"].select("repo_id", F.lit("schema"), "schema_name", blank),
        relations.select("repo_id", "relation_kind", "object_name", words("created", "rls_state", "view_security_invoker", "n_policies")),
        found["policies"].withColumn("who", F.array_join("roles", ",")).select("repo_id", F.lit("policy"), "object_name", words("command", "who", "has_using")),
        found["policy_removals"].select("repo_id", F.lit("policy removal"), "object_name", blank),
        found["grants"].select("repo_id", F.lit("grant"), "object_name", words("privilege", "role")),
        found["functions"].select("repo_id", F.lit("function"), "object_name", words("created", "security_mode")),
        found["function_grants"].select("repo_id", F.lit("execute"), "object_name", "role"),
    ]
    out = rows[0].toDF("repo_id", "part", "object", "detail")
    for r in rows[1:]:
        out = out.unionByName(r.toDF("repo_id", "part", "object", "detail"))
    return out


@query(
    "w1_provenance",
    """
WITH g AS (SELECT o_custkey AS r, o_orderkey AS k, o_orderkey % 13 AS m, (o_orderkey // 13) % 2 AS j, o_custkey % 10 = 9 AND count(*) OVER (PARTITION BY o_custkey) > 1 AS bad FROM orders),
     s AS (SELECT *, 'supabase/migrations/' || CASE WHEN r % 10 = 9 THEN '11111111111111' ELSE lpad(k::VARCHAR, 14, '0') END || '_' || k || '.sql' AS path FROM g WHERE NOT bad),
     t AS (SELECT r, j, max(k) FILTER (m = 6) AS granted, max(k) FILTER (m = 7) AS revoked, max(k) FILTER (m <= 7) AS changed FROM s GROUP BY r, j),
     f AS (SELECT r, 'grant' AS part, j, granted AS k FROM t WHERE granted > coalesce(revoked, -1) UNION ALL SELECT r, 'relation', j, changed FROM t WHERE changed IS NOT NULL),
     b AS (SELECT f.*, m, path, ['create table app.t' || f.j || ' (id int);', 'alter table app.t' || f.j || ' enable row level security;',
             '-- off; again' || chr(10) || 'alter table app.t' || f.j || ' disable row level security;', 'create policy p on app.t' || f.j || ' for select to anon using (name = ''a;b'');',
             'alter policy p on app.t' || f.j || ' to authenticated;', 'drop policy if exists p on app.t' || f.j || ';', 'grant select, insert on table app.t' || f.j || ' to anon;',
             'revoke all on table app.t' || f.j || ' from anon;'][m + 1] AS content FROM f JOIN s USING (r, k))
SELECT r AS repo_id, part, 't' || j AS object, path, 0 AS statement_index, CASE WHEN m = 2 THEN 14 ELSE 0 END AS start_byte,
       length(content) - 1 AS end_byte, 'sha256:' || sha256(content) AS content_digest FROM b
""",
)
def w1_provenance(s, d):
    found = posture.reduce_posture(migrations(s, d))
    granted = found["grants"].select("repo_id", F.lit("grant").alias("part"), F.col("object_name").alias("object"), F.col("granted_at").alias("provenance")).distinct()
    changed = found["relations"].where("relation_kind = 'TABLE'").select("repo_id", F.lit("relation").alias("part"), F.col("object_name").alias("object"), F.col("last_security_change").alias("provenance"))
    return posture.located(granted.unionByName(changed), found["statements"]).drop("provenance")


# --- I5: project-declared invariants ---------------------------------------------------------------------------------

KINDS = ("TENANT_BINDING", "REQUIRED_ROLE", "PROTECTED_PROPERTIES", "ELEVATED_CLIENT_CONTEXT")


def project_states(s, d):
    inv, rows = scope_sides(s, d)
    n = F.col("invariant_id") % 5
    kind = F.get(F.array(*map(F.lit, [*KINDS, "TENANT_BINDING"])), n.cast("int"))
    declared = inv.withColumns({"invariant_kind": kind, "source": F.when(n == 4, "BUILTIN").otherwise("PROJECT_DECLARATION")})
    coverage = F.when(F.col("path_id") % 13 == 0, "PARTIAL").otherwise("COVERED")
    rows = rows.withColumns({"client_id": F.when(F.col("client_id") % 9 != 0, F.col("client_id")), "guard_coverage": coverage})
    support = known_clients(s, d).withColumn("exact", F.col("client_id") % 7 != 1)
    return invariants.project_states(declared, rows, *tenant_inputs(s, d), role_guards(s, d), support)


I5_SQL = f"""
WITH c AS (SELECT o_orderkey AS path_id, o_custkey AS c FROM orders),
p AS (
  SELECT * FROM ({TENANT_STATES}) WHERE invariant_id % 5 = 0
  UNION ALL SELECT invariant_id, path_id, CASE WHEN state <> 'NOT_APPLICABLE' AND path_id % 13 = 0 THEN 'UNKNOWN' ELSE state END FROM ({ROLE}) WHERE invariant_id % 5 = 1
  UNION ALL SELECT * FROM ({PROTECTED}) WHERE invariant_id % 5 = 2
  UNION ALL SELECT invariant_id, path_id, CASE WHEN state <> 'NOT_APPLICABLE' AND (path_id % 13 = 0 OR c.c % 7 = 1) THEN 'UNKNOWN' ELSE state END
  FROM ({ELEVATED}) e JOIN c USING (path_id) WHERE invariant_id % 5 = 3 AND c.c % 9 <> 0 AND c.c % 7 <> 0)
SELECT invariant_id, path_id,
       CASE WHEN bool_or(state = 'VIOLATED') THEN 'VIOLATED' WHEN bool_or(state = 'UNKNOWN') THEN 'UNKNOWN'
            WHEN bool_or(state = 'SATISFIED') THEN 'SATISFIED' ELSE 'NOT_APPLICABLE' END AS state
FROM (SELECT * FROM p UNION ALL SELECT * FROM ({TENANT_STATES})) GROUP BY 1, 2
"""


@query("i5_project_invariants", I5_SQL)
def i5(s, d):
    return invariants.tightened(tenant_states(s, d), project_states(s, d)[0])


@query(
    "i5_project_rejects",
    """
SELECT n_nationkey AS invariant_id, NULL AS path_id, 'NOT_PROJECT_DECLARATION' AS reject_reason FROM nation WHERE n_nationkey % 5 = 4
UNION ALL
SELECT n_nationkey, o_orderkey, CASE WHEN o_custkey % 9 = 0 THEN 'MISSING_PROVIDER_CLIENT' ELSE 'MISSING_STATIC_SUPPORT' END
FROM nation JOIN orders ON n_nationkey % 40 = o_custkey % 40 WHERE n_nationkey % 5 = 3 AND (o_custkey % 9 = 0 OR o_custkey % 7 = 0)
""",
)
def i5_rejects(s, d):
    return project_states(s, d)[1]


# --- W10, D14 --------------------------------------------------------------------------------------------------------


@query(
    "w10_presented",
    """
SELECT l_orderkey, l_linenumber,
       row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity NULLS FIRST, l_partkey NULLS FIRST, l_linenumber NULLS FIRST) AS position
FROM lineitem
""",
)
def w10_presented(s, d):
    rows = table(s, d, "lineitem").select("l_orderkey", "l_quantity", "l_partkey", "l_linenumber")
    return reconcile.presented(rows, ["l_orderkey"], ["l_quantity", "l_partkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "position")


#: Put behind texts, so that every rule and near misses occur.
PHRASES = (
    "please IGNORE previous notes", "ignore prior work", "Disregard Previous", "override policy 4", "bypass POLICY", "disable guard", "ignore policy",
    "reveal secret", "reveal credentials", "send credential", "print API key", "show api key", "execute command", "run shell", "run command now",
    "execute shell", "the system prompt", "do not tell the user", "keep this secret", "ignore the previous", "print the api key", "policy bypass", "", "run a command",
    "ignore policy and run shell",
)
#: Ids and needles of the text rules.
RULES = {
    "mcp.untrusted.ignore-prior-authority": ["ignore previous", "ignore prior", "disregard previous"],
    "mcp.untrusted.policy-override": ["override policy", "bypass policy", "disable guard", "ignore policy"],
    "mcp.untrusted.secret-exfiltration": ["reveal secret", "reveal credential", "send credential", "print api key", "show api key"],
    "mcp.untrusted.command-directive": ["execute command", "run shell", "run command", "execute shell"],
    "mcp.untrusted.hidden-instruction": ["system prompt", "do not tell the user", "keep this secret"],
}
_FLAGS = ", ".join(f"CASE WHEN {' OR '.join(f'contains(low, {chr(39)}{n}{chr(39)})' for n in needles)} THEN '{rule}' END" for rule, needles in RULES.items())
_PHRASE = "list_extract([" + ", ".join(f"'{p}'" for p in PHRASES) + f"], 1 + (conv_id * 7 + turn) % {len(PHRASES)})"


@query(
    "d14_untrusted_texts",
    f"""
WITH t AS (SELECT conv_id, turn, text || ' ' || {_PHRASE} AS text FROM conversations),
l AS (SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM t)
SELECT conv_id, turn, 'sha256:' || sha256(text) AS content_hash, octet_length(encode(text)) AS byte_len, concat_ws(',', {_FLAGS}) AS rule_ids
FROM l WHERE octet_length(encode(text)) <= 65536
""",
)
def d14_untrusted(s, d):
    at = ((F.col("conv_id") * 7 + F.col("turn")) % len(PHRASES)).cast("int")
    text = F.concat("text", F.lit(" "), F.get(F.array(*map(F.lit, PHRASES)), at))
    flagged = detect.flag_instructions(table(s, d, "conversations").select("conv_id", "turn", text.alias("text")))
    return flagged.withColumn("rule_ids", F.array_join("rule_ids", ","))


# --- results as rows -------------------------------------------------------------------------------------------------


@query(
    "k3_node_revisions",
    """
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS revision,
       o_orderstatus || CASE WHEN o_orderkey % 4 = 0 THEN '!' ELSE '' END AS digest, CASE WHEN o_orderkey % 2 = 1 THEN 'INSERTED' ELSE 'REVISED' END AS outcome
FROM orders WHERE o_orderkey % 3 <> 0 AND (o_orderkey % 2 = 1 OR o_orderkey % 4 = 0)
""",
)
def k3_rows(s, d):
    new, held = versions(s, d)
    return sinks.upsert_versioned(new, held.withColumn("revision", F.lit(1)), "o_orderkey", "digest")[1].select("o_orderkey", "revision", "digest", "outcome")


@query(
    "k4_edge_revisions",
    """
SELECT c_custkey::VARCHAR AS edge_id, 'c' || c_custkey AS source, 'n' || c_nationkey AS target, 1 AS revision, 'INSERTED' AS outcome
FROM customer WHERE c_nationkey % 6 <> 0
""",
)
def k4_rows(s, d):
    nodes, edges = tree_graph(s, d)
    new = edges.select(F.substring_index("source", "c", -1).alias("edge_id"), "source", "target", F.lit("d").alias("digest"))
    held = new.limit(0).withColumn("revision", F.lit(1))
    return sinks.upsert_edges(new, held, nodes.distinct())[0].select("edge_id", "source", "target", "revision", "outcome")


@query(
    "g3_link_rows",
    """
SELECT repo_id, source, target, relation FROM (
  SELECT c_custkey // 100 AS repo_id, 'r' || c_custkey AS source, 'm' || c_custkey AS target, 'HANDLED_BY' AS relation FROM customer
  UNION ALL SELECT c_custkey // 100, 'm' || c_custkey, 'h' || c_custkey, 'NEXT' FROM customer
  UNION ALL SELECT c_custkey // 100, 'a' || c_custkey, 'v' || c_custkey, 'PROVIDES' FROM customer
  UNION ALL SELECT c_custkey // 100, 'a' || c_custkey, 'g' || c_custkey, 'CHECKED_BY' FROM customer WHERE c_custkey % 4 = 0
  UNION ALL SELECT o_custkey // 100, 'v' || o_custkey, 'o' || o_orderkey, 'FILTERS' FROM orders
  UNION ALL SELECT o_custkey // 100, 'h' || o_custkey, 'o' || o_orderkey, 'PERFORMS' FROM orders
  UNION ALL SELECT o_custkey // 100, 'o' || o_orderkey, 'k' || o_orderkey, 'USES' FROM orders WHERE o_orderkey % 3 = 0)
""",
)
def g3_rows(s, d):
    return paths.intrinsic_links(*layers(s, d)[:6]).select("repo_id", "source", "target", "relation")


@query(
    "j20_edge_rows",
    """
SELECT 'REFS' AS relation, 'r' || c_custkey AS source, 'h' || (c_custkey // 20) AS target, 1 AS n_evidence, 'e' || c_custkey AS evidence_id FROM customer
UNION ALL
SELECT relation, 'h' || h, 't' || t, count(*) OVER (PARTITION BY relation, h, t), 'o' || o_orderkey
FROM (SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'READS_FROM' ELSE 'WRITES_TO' END AS relation, o_custkey // 20 AS h, o_orderkey % 5 AS t, o_orderkey
      FROM orders WHERE o_orderkey % 4 <> 3)
""",
)
def j20_rows(s, d):
    nodes, edges, told = graph.observation_records(*observations(s, d))
    name = lambda end: nodes.select(F.col("node_id").alias(end), F.col("key").alias(f"{end}_key"))
    named = edges.join(name("source"), "source").join(name("target"), "target").join(told.withColumnRenamed("record_id", "edge_id"), "edge_id")
    return named.select("relation", F.col("source_key").alias("source"), F.col("target_key").alias("target"), "n_evidence", "evidence_id")


@query(
    "j15_edge_auth_matrix",
    """
SELECT s_nationkey AS repo_id, s_name AS function,
       CASE s_suppkey % 3 WHEN 0 THEN 'DISABLED' WHEN 1 THEN 'ENABLED' ELSE 'UNKNOWN' END AS token_check,
       CASE s_suppkey % 4 WHEN 2 THEN 'PROVEN' WHEN 1 THEN 'NOT_PROVEN' ELSE 'UNKNOWN' END AS source_check
FROM supplier
""",
)
def j15_matrix(s, d):
    return posture.edge_auth_matrix(*edge_sides(s, d))
