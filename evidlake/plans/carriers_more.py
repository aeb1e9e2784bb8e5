"""Registered queries of detection, sources, graph, paths, invariants, regression, metrics, sinks and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from evidlake.functions import identity as I
from evidlake.operators import detect, graph, invariants, metrics, paths, regression
from evidlake.plans.carriers import EDGE, EV, NODE, ev, query, sid, table
from evidlake.sources import ddl, packages, reports, sinks
from evidlake.sources.store import RecordStore
from evidlake.streaming import jobs

# --- detection -------------------------------------------------------------------------------------------------------


def doc_files(s, d):
    return table(s, d, "documents").select(F.lit(1).alias("repo_id"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"))


HEX_LINES = r"(SELECT doc_id, i, l, regexp_extract_all(l, '(?i:token|secret|password|api_?key)\s*[:=]\s*[\"'']?[0-9a-f]{32,}') AS m FROM (SELECT doc_id, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS l FROM (SELECT doc_id, string_split_regex(text, '\r?\n') AS p FROM documents)))"


@query("d1_secret_lines", f"SELECT 'd' || doc_id AS path, i AS line_no, len(m) AS n FROM {HEX_LINES} WHERE len(m) > 0")
def d1(s, d):
    return detect.scan_secrets(doc_files(s, d)).where("rule = 'assigned-hex'").groupBy("path", "line_no").agg(F.count("*").alias("n"))


@query("d1_first_column", f"SELECT 'd' || doc_id AS path, i AS line_no, instr(l, m[1]) AS start_col, instr(l, m[1]) + length(m[1]) AS end_col FROM {HEX_LINES} WHERE len(m) > 0")
def d1_first(s, d):
    rows = detect.scan_secrets(doc_files(s, d)).where("rule = 'assigned-hex'")
    return rows.groupBy("path", "line_no").agg(F.min("start_col").alias("start_col"), F.min_by("end_col", "start_col").alias("end_col"))


@query("d2_redact", "SELECT conv_id, turn, replace(replace(text, 'the ', '[redacted]'), 'la', '[redacted]') AS text FROM conversations WHERE NOT (contains(replace(replace(text, 'the ', '[redacted]'), 'la', '[redacted]'), 'the ') OR contains(replace(replace(text, 'the ', '[redacted]'), 'la', '[redacted]'), 'la')) UNION ALL SELECT conv_id, turn, '' FROM conversations WHERE contains(replace(replace(text, 'the ', '[redacted]'), 'la', '[redacted]'), 'the ') OR contains(replace(replace(text, 'the ', '[redacted]'), 'la', '[redacted]'), 'la')")
def d2(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", detect.redact(F.col("text"), ["the ", "la"]).alias("text"))


@query("d2_secret_forms", "SELECT c_custkey, sha256(c_name) AS digest FROM customer")
def d2_forms(s, d):
    return table(s, d, "customer").select("c_custkey", F.element_at(detect.secret_forms(F.col("c_name")), 2).alias("digest"))


NEEDLES = (("that", ("than the", "that the")), ("der", ("in der",)))


@query("d14_instruction_flags", "SELECT conv_id, turn, 'sha256:' || sha256(text) AS content_hash, octet_length(encode(text)) AS byte_len, concat_ws(',', CASE WHEN contains(lower(text), 'than the') OR contains(lower(text), 'that the') THEN 'that' END, CASE WHEN contains(lower(text), 'in der') THEN 'der' END) AS rule_ids FROM conversations WHERE octet_length(encode(text)) <= 65536")
def d14(s, d):
    return detect.flag_instructions(table(s, d, "conversations").select("conv_id", "turn", "text"), NEEDLES).withColumn("rule_ids", F.array_join("rule_ids", ","))


def workflow(s, d, after):
    i = F.col("event_id")
    lines = [F.lit("name: x"), F.when(i % 5 == 0, "on: pull_request_target").otherwise("on: push"), F.lit("permissions:"), F.when((i % 4 == 0) & F.lit(after), "  contents: write").otherwise("  contents: read"), F.lit("jobs:"), F.when(i % 7 == 0, "    runs-on: self-hosted").otherwise("    runs-on: ubuntu"), F.lit("    steps:"), F.lit("      - uses: actions/checkout@v4"), F.lit("      - run: |"), F.when(i % 3 == 0, "          echo ${{ github.event.issue.title }}").otherwise("          echo hi"), F.lit("      - name: ${{ github.event.x }}")]
    return ev(s, d).select(F.lit(1).alias("repo_id"), F.concat(F.lit("w"), i.cast("string")).alias("path"), F.array_join(F.array(*lines), "\n").alias("content"))


@query("d3_workflow_rules", "SELECT 'w' || event_id AS path, 'permission-widening' AS rule FROM events WHERE event_id % 4 = 0 UNION ALL SELECT 'w' || event_id, 'untrusted-expression' FROM events WHERE event_id % 3 = 0")
def d3(s, d):
    return detect.scan_workflows(workflow(s, d, False), workflow(s, d, True)).select("path", "rule")


@query("d3_new_workflows", "SELECT 'w' || event_id AS path, unnest(list_concat(['mutable-action'], CASE WHEN event_id % 4 = 0 THEN ['permission-widening'] ELSE [] END, CASE WHEN event_id % 3 = 0 THEN ['untrusted-expression'] ELSE [] END, CASE WHEN event_id % 5 = 0 THEN ['pull-request-target'] ELSE [] END, CASE WHEN event_id % 7 = 0 THEN ['self-hosted-runner'] ELSE [] END)) AS rule FROM events")
def d3_new(s, d):
    after = workflow(s, d, True)
    return detect.scan_workflows(after.where("false"), after).select("path", "rule")


@query("d4_patterns", r"SELECT page_id, 'script' AS rule_id, len(regexp_extract_all(b, '<script')) AS n FROM (SELECT page_id, regexp_replace(html, '/\*(?s:.*?)\*/|//[^\n]*|\"(?:[^\"\\\n]|\\.)*\"|''(?:[^''\\\n]|\\.)*''', '', 'g') AS b FROM pages) WHERE len(regexp_extract_all(b, '<script')) > 0 UNION ALL SELECT page_id, 'link', len(regexp_extract_all(b, '<a\s')) FROM (SELECT page_id, regexp_replace(html, '/\*(?s:.*?)\*/|//[^\n]*|\"(?:[^\"\\\n]|\\.)*\"|''(?:[^''\\\n]|\\.)*''', '', 'g') AS b FROM pages) WHERE len(regexp_extract_all(b, '<a\s')) > 0")
def d4(s, d):
    files = table(s, d, "pages").select(F.col("page_id").alias("repo_id"), F.lit("x").alias("path"), F.col("html").alias("content"), F.lit("HTML").alias("language"))
    rules = s.createDataFrame([("script", "HTML", "<script"), ("link", "HTML", r"<a\s"), ("eval", "JavaScript", r"eval\(")], "rule_id string, language string, pattern string")
    return detect.scan_patterns(files, rules).select(F.col("repo_id").alias("page_id"), "rule_id", "n")


NAMES = ["src/main.rs", "Cargo.lock", "web/app.tsx", "package.json", "README", "supabase/migrations/20240101000000_x.sql", ".github/workflows/ci.yml", "supabase/config.toml"]
PATHS = "list_extract([" + ",".join(f"'{n}'" for n in NAMES) + "], 1 + event_id % 8)"


def tree(s, d):
    return ev(s, d).select(F.col("user_id").alias("repo_id"), F.get(F.array(*map(F.lit, NAMES)), (F.col("event_id") % 8).cast("int")).alias("path"))


@query("d5_languages", f"SELECT user_id AS repo_id, coalesce(string_agg(DISTINCT CASE WHEN p LIKE '%.rs' THEN 'Rust' WHEN p LIKE '%.tsx' THEN 'TypeScript' WHEN p LIKE '%.sql' THEN 'SQL' END, ',' ORDER BY CASE WHEN p LIKE '%.rs' THEN 'Rust' WHEN p LIKE '%.tsx' THEN 'TypeScript' WHEN p LIKE '%.sql' THEN 'SQL' END), '') AS languages, coalesce(string_agg(DISTINCT CASE p WHEN 'Cargo.lock' THEN 'cargo' WHEN 'package.json' THEN 'npm' END, ',' ORDER BY CASE p WHEN 'Cargo.lock' THEN 'cargo' WHEN 'package.json' THEN 'npm' END), '') AS ecosystems FROM (SELECT user_id, {PATHS} AS p FROM events) GROUP BY 1")
def d5(s, d):
    return detect.languages(tree(s, d)).select("repo_id", F.array_join("languages", ",").alias("languages"), F.array_join("ecosystems", ",").alias("ecosystems"))


STACK = f"SELECT user_id AS repo_id, CASE WHEN p LIKE '.github/workflows/%' THEN 'github-actions' WHEN p LIKE 'supabase/%' THEN 'supabase' END AS stack, string_agg(DISTINCT p, ',' ORDER BY p) AS paths FROM (SELECT user_id, {PATHS} AS p FROM events) WHERE p LIKE '.github/workflows/%' OR p LIKE 'supabase/%' GROUP BY 1, 2"


@query("d7_stacks", STACK)
def d7(s, d):
    return detect.stacks(tree(s, d)).withColumn("paths", F.array_join("paths", ","))


@query("d6_ci_systems", f"SELECT repo_id, stack FROM ({STACK}) WHERE stack = 'github-actions'")
def d6(s, d):
    ci = tuple(r for r in detect.STACKS if r[2] in ("github-actions", "gitlab-ci", "circleci"))
    return detect.stacks(tree(s, d), ci).select("repo_id", "stack")


@query("d8_service_signals", f"SELECT user_id AS repo_id, string_agg(DISTINCT CASE WHEN p LIKE '%config.toml' THEN 'CONFIG' ELSE 'MIGRATION' END, ',' ORDER BY CASE WHEN p LIKE '%config.toml' THEN 'CONFIG' ELSE 'MIGRATION' END) AS signals FROM (SELECT user_id, {PATHS} AS p FROM events) WHERE p LIKE 'supabase/%' GROUP BY 1")
def d8(s, d):
    return detect.service_signals(tree(s, d)).withColumn("signals", F.array_join("signals", ","))


def sources(s, d):
    i = F.col("event_id")
    word = F.when(i % 4 == 0, F.concat(F.lit("'sb_secret_abc"), i.cast("string"), F.lit("'"))).when(i % 4 == 1, "env.SUPABASE_SERVICE_ROLE_KEY").when(i % 4 == 2, "env.publicAnonKey").otherwise("nothing")
    path = F.concat(F.when(i % 3 == 0, "src/client/a").when(i % 3 == 1, "src/server/a").otherwise("tests/a"), i.cast("string"), F.lit(".ts"))
    head = F.when(i % 5 == 0, "'use client'\n").otherwise("")
    return ev(s, d).select(F.col("user_id").alias("repo_id"), path.alias("path"), F.concat(head, F.lit("const x = "), word).alias("content"), "event_id")


SRC = "SELECT *, CASE event_id % 3 WHEN 0 THEN 'src/client/a' WHEN 1 THEN 'src/server/a' ELSE 'tests/a' END || event_id || '.ts' AS path, CASE WHEN event_id % 3 = 2 THEN 'TEST' WHEN event_id % 3 = 1 AND event_id % 5 = 0 THEN 'UNKNOWN' WHEN event_id % 3 = 1 THEN 'SERVER' ELSE 'BROWSER' END AS context, CASE event_id % 4 WHEN 0 THEN 'ELEVATED' WHEN 1 THEN 'ELEVATED' WHEN 2 THEN 'PUBLISHABLE' END AS authority FROM events"


@query("d9_key_literals", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'ELEVATED' WHEN 1 THEN 'PUBLISHABLE' WHEN 2 THEN 'UNKNOWN' END AS class FROM events")
def d9(s, d):
    text = F.get(F.array(*map(F.lit, ["sb_secret_abc", "sb_publishable_abc-1", "sb_other_abc", "eyJx"])), (F.col("event_id") % 4).cast("int"))
    return ev(s, d).select("event_id", detect.key_literal_class(text).alias("class"))


@query("d10_key_names", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'ELEVATED' WHEN 1 THEN 'ELEVATED' WHEN 2 THEN 'PUBLISHABLE' END AS class FROM events")
def d10(s, d):
    text = F.get(F.array(*map(F.lit, ["supabase-service-role-key", "mySecretKey", "NEXT_PUBLIC_ANON_KEY", "password"])), (F.col("event_id") % 4).cast("int"))
    return ev(s, d).select("event_id", detect.key_name_class(text).alias("class"))


@query("d11_key_observations", f"SELECT path, CASE WHEN event_id % 5 = 0 THEN 2 ELSE 1 END AS line_no, CASE WHEN event_id % 4 = 0 THEN 12 ELSE 11 END AS start_col, authority, CASE event_id % 4 WHEN 0 THEN '[redacted]' WHEN 1 THEN 'env.SUPABASE_SERVICE_ROLE_KEY' ELSE 'env.publicAnonKey' END AS display FROM ({SRC}) WHERE authority IS NOT NULL")
def d11(s, d):
    return detect.key_observations(sources(s, d)).drop("repo_id", "fingerprint")


@query("d12_source_context", f"SELECT path, context FROM ({SRC})")
def d12(s, d):
    return detect.source_context(sources(s, d)).select("path", "context")


@query("d13_elevated_in_browser", f"SELECT path FROM ({SRC}) WHERE authority = 'ELEVATED' AND context = 'BROWSER'")
def d13(s, d):
    files = sources(s, d)
    return detect.elevated_in_browser(detect.key_observations(files), detect.source_context(files)).select("path")


def tools(s, d):
    k = F.col("p_partkey")
    return table(s, d, "part").select(F.expr("p_partkey div 100").alias("server_id"), F.when((k % 400 < 100) & (k % 40 == 3), "same").otherwise(F.concat("p_name", k.cast("string"))).alias("name"), F.col("p_type").alias("description"), F.create_map(F.lit("b"), F.col("p_brand"), F.lit("a"), F.lit("x")).alias("schema"), "p_partkey")


TOOL_SQL = "SELECT p_partkey // 100 AS server_id, CASE WHEN p_partkey % 400 < 100 AND p_partkey % 40 = 3 THEN 'same' ELSE p_name || p_partkey END AS name, p_type, p_brand FROM part"


@query("d15_tool_inventory", f"SELECT server_id, name, {sid('tool.description', chr(39) + '{' + chr(34) + 'description' + chr(34) + ':' + chr(34) + chr(39) + ' || p_type || ' + chr(39) + chr(34) + ',' + chr(34) + 'name' + chr(34) + ':' + chr(34) + chr(39) + ' || name || ' + chr(39) + chr(34) + '}' + chr(39))} AS description_hash FROM ({TOOL_SQL}) WHERE server_id NOT IN (SELECT server_id FROM ({TOOL_SQL}) GROUP BY server_id HAVING count(DISTINCT name) < count(*))")
def d15(s, d):
    return detect.tool_inventory(tools(s, d))[0].select("server_id", "name", "description_hash")


@query("d16_invocation_scope", f"SELECT event_id, {sid('tool.scope', chr(39) + '{' + chr(34) + 'arguments' + chr(34) + ':' + chr(34) + chr(39) + ' || sha256(props) || ' + chr(39) + chr(34) + ',' + chr(34) + 'server' + chr(34) + ':' + chr(34) + 's' + chr(34) + ',' + chr(34) + 'tool' + chr(34) + ':' + chr(34) + chr(39) + ' || event_type || ' + chr(39) + chr(34) + '}' + chr(39))} AS scope_digest FROM events")
def d16(s, d):
    return detect.invocation_scope(ev(s, d).select("event_id", F.lit("s").alias("server"), F.col("event_type").alias("tool"), F.col("props").alias("arguments"))).select("event_id", "scope_digest")


# --- sources ---------------------------------------------------------------------------------------------------------


@query(
    "s1_repo_files",
    """
SELECT 'kind=' || event_type AS folder, sum(strlen(props) + 1)::BIGINT AS length, sum(strlen(props) + 1)::BIGINT AS content_bytes, count(*) AS n_lines
FROM events GROUP BY event_type
""",
)
def s1(s, d):
    """The properties of events written out as a snapshot of files, a folder for each kind, and scanned."""
    root = f"{graph.shared_folder(s)}/snapshot-{uuid.uuid4().hex}"
    ev(s, d).select(F.col("event_type").alias("kind"), "props").write.partitionBy("kind").option("maxRecordsPerFile", 10_000).text(root)
    files = reports.read_repo_files(s, root, "events", "now").where(~F.col("path").startswith("_"))
    lines = F.octet_length("content") - F.octet_length(F.translate(F.decode("content", "utf-8"), "\n", "").cast("binary"))
    return files.groupBy(F.substring_index("path", "/", 1).alias("folder")).agg(F.sum("length").alias("length"), F.sum(F.octet_length("content")).alias("content_bytes"), F.sum(lines).alias("n_lines"))


@query("s2_tool_json", "SELECT event_id AS run_id, event_type AS category, 'src/' || user_id || '.py' AS path FROM events WHERE event_id % 10 > 2")
def s2(s, d):
    return reports.ingest_tool_json(tool_json(s, d))[0].select("run_id", "category", F.array_join("paths", ",").alias("path"))


def tool_json(s, d):
    i = F.col("event_id")
    item = F.struct(F.when(i % 10 == 1, " ").otherwise("seen").alias("observation"), F.col("event_type").alias("category"), F.array(F.struct(F.concat(F.when(i % 10 == 2, "../").otherwise("./src/"), F.col("user_id").cast("string"), F.lit(".py")).alias("repo_relative_path"))).alias("locations"))
    return ev(s, d).select(i.alias("run_id"), F.to_json(F.struct(F.when(i % 10 == 0, "2").otherwise("1").alias("schema_version"), F.array(item).alias("evidence"))).alias("body"))


@query("s2_tool_json_rejects", "SELECT event_id AS run_id, CASE event_id % 10 WHEN 0 THEN 'UNSUPPORTED_VERSION' WHEN 1 THEN 'BLANK_OBSERVATION' ELSE 'PATH_OUTSIDE_ROOT' END AS reject_reason FROM events WHERE event_id % 10 <= 2")
def s2_rejects(s, d):
    return reports.ingest_tool_json(tool_json(s, d))[1].select("run_id", "reject_reason")


def sarif(s, d):
    i = F.col("event_id")
    where = F.array(F.struct(F.struct(F.struct(F.concat(F.lit("src/a%20"), F.col("user_id").cast("string")).alias("uri"), F.when(i % 10 == 2, "ROOT").alias("uriBaseId")).alias("artifactLocation")).alias("physicalLocation")))
    result = F.struct(F.when(i % 10 != 1, F.col("event_type")).alias("ruleId"), F.struct(F.when(i % 2 == 0, " ").otherwise("text").alias("text"), F.lit("mark").alias("markdown")).alias("message"), where.alias("locations"))
    run = F.struct(F.struct(F.struct(F.lit("tool").alias("name"), F.when(i % 3 == 0, "1.2.3").alias("semanticVersion"), F.lit("1").alias("version")).alias("driver")).alias("tool"), F.array(result).alias("results"))
    return ev(s, d).select(i.alias("run_id"), F.to_json(F.struct(F.when(i % 10 == 0, "2.0.0").otherwise("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("body"))


@query("s3_sarif", "SELECT event_id AS run_id, 'sarif:' || event_type AS category, CASE WHEN event_id % 3 = 0 THEN '1.2.3' ELSE '1' END AS producer_version, CASE WHEN event_id % 2 = 0 THEN 'mark' ELSE 'text' END AS interpretation, 'src/a ' || user_id AS path FROM events WHERE event_id % 10 > 2")
def s3(s, d):
    return reports.ingest_sarif(sarif(s, d))[0].select("run_id", "category", "producer_version", "interpretation", F.array_join("paths", ",").alias("path"))


@query("s3_sarif_rejects", "SELECT event_id AS run_id, CASE event_id % 10 WHEN 0 THEN 'UNSUPPORTED_VERSION' WHEN 1 THEN 'NO_RULE' ELSE 'URI_BASE' END AS reject_reason FROM events WHERE event_id % 10 <= 2")
def s3_rejects(s, d):
    return reports.ingest_sarif(sarif(s, d))[1].select("run_id", "reject_reason")


LINE = "SELECT DISTINCT l_orderkey, l_partkey, l_linenumber FROM lineitem"


@query("s4_cargo_packages", f"SELECT l_orderkey AS repo_id, 'p' || l_partkey AS name, '1.' || l_linenumber AS version FROM ({LINE}) WHERE l_orderkey % 7 <> 0")
def s4(s, d):
    block = F.concat(F.lit('\n[[package]]\nname = "p'), F.col("l_partkey").cast("string"), F.when(F.col("l_orderkey") % 7 == 0, '\\"').otherwise('"'), F.lit('\nversion = "1.'), F.col("l_linenumber").cast("string"), F.lit('"\n'))
    files = table(s, d, "lineitem").select("l_orderkey", block.alias("b")).distinct().groupBy(F.col("l_orderkey").alias("repo_id")).agg(F.concat(F.lit("version = 3\n"), F.array_join(F.collect_list("b"), "")).alias("content")).withColumn("path", F.lit("Cargo.lock"))
    return packages.cargo_packages(files)[0].select("repo_id", "name", "version")


@query("s5_npm_packages", f"SELECT DISTINCT l_orderkey AS repo_id, 'p' || l_partkey AS name, '1.' || l_linenumber AS version FROM ({LINE}) WHERE l_orderkey % 7 <> 0 AND l_linenumber <> 2")
def s5(s, d):
    entry = F.struct(F.concat(F.lit("node_modules/x/node_modules/p"), F.col("l_partkey").cast("string"), F.lit("#"), F.col("l_linenumber").cast("string")).alias("key"), F.struct(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("name"), F.concat(F.lit("1."), F.col("l_linenumber").cast("string")).alias("version"), (F.col("l_linenumber") == 2).alias("link")).alias("value"))
    lists = table(s, d, "lineitem").select("l_orderkey", entry.alias("e")).distinct().groupBy(F.col("l_orderkey").alias("repo_id")).agg(F.map_from_entries(F.collect_list("e")).alias("packages"))
    files = lists.select("repo_id", F.lit("package-lock.json").alias("path"), F.to_json(F.struct(F.when(F.col("repo_id") % 7 == 0, 1).otherwise(3).alias("lockfileVersion"), "packages")).alias("content"))
    return packages.npm_packages(files)[0].select("repo_id", "name", "version")


@query("s6_advisories", "SELECT 'adv' || p_partkey AS advisory_id, p_name AS package FROM part WHERE p_partkey % 9 <> 0 AND p_partkey % 5 <> 0")
def s6(s, d):
    k = F.col("p_partkey")
    item = F.struct(F.concat(F.lit("adv"), F.when(k % 9 == 0, F.lit(0)).otherwise(k).cast("string")).alias("id"), F.lit("npm").alias("ecosystem"), F.col("p_name").alias("package"), F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("1"))).alias("affected_versions"))
    return packages.parse_advisories(table(s, d, "part").select(F.to_json(F.struct(F.lit("1").alias("schema_version"), F.array(item).alias("advisories"))).alias("body")))[0].select("advisory_id", "package")


@query("s7_advisory_cache", "SELECT p_name AS name, p_size AS fetched_at FROM part WHERE p_partkey % 4 <> 0")
def s7(s, d):
    k = F.col("p_partkey")
    body = F.to_json(F.struct(F.lit("npm").alias("ecosystem"), F.col("p_name").alias("name"), F.lit("1").alias("version"), F.col("p_size").alias("fetched_at"), F.array(F.lit("a")).alias("advisories"), F.when(k % 4 == 0, 1).alias("extra")))
    return packages.parse_cache(table(s, d, "part").select(F.expr("p_partkey div 2000").alias("file_id"), body.alias("value")))[0].select("name", "fetched_at")


@query("s8_merge_pages", "SELECT l_orderkey AS package, l_partkey % 5 AS advisory_id, arg_min('s' || l_linenumber, l_linenumber) AS summary FROM lineitem WHERE l_orderkey % 6 <> 0 GROUP BY 1, 2")
def s8(s, d):
    n = F.col("l_linenumber")
    token = F.when((F.col("l_orderkey") % 6 == 0), F.lit("t")).otherwise(F.concat(F.lit("t"), n.cast("string")))
    pages = table(s, d, "lineitem").select(F.col("l_orderkey").alias("package"), n.alias("page_no"), token.alias("page_token"), (F.col("l_partkey") % 5).alias("advisory_id"), F.concat(F.lit("s"), n.cast("string")).alias("summary"))
    return packages.merge_pages(pages)[0].where("package % 6 <> 0")


def ddl_files(s, d):
    i = F.col("event_id")
    t = F.col("event_type")
    obj = F.concat(F.lit("public.t"), (F.col("user_id") % 50).cast("string"))
    text = F.when(t == "signup", F.concat(F.lit("-- it's; a note\nCREATE POLICY \"P;1\" ON "), obj, F.lit(" FOR SELECT TO anon USING (name = 'a;b');"))).when(t == "view", F.concat(F.lit("create function "), obj, F.lit("() returns void language sql security definer as $$ select 1; drop table x; $$;"))).when(t == "error", F.concat(F.lit("DO $$ begin null; end $$; alter table "), obj, F.lit(" enable row level security;"))).when(t == "click", F.concat(F.lit("grant select, insert on table "), obj, F.lit(" to anon, authenticated;"))).otherwise("select 'unclosed; /* x")
    key = F.lpad((i % 100_000_000).cast("string"), 14, "0")
    return ev(s, d).select((i % 7).alias("repo_id"), F.concat(F.lit("supabase/migrations/"), key, F.lit("_x.sql")).alias("path"), text.alias("content"), "event_id")


@query("s9_migrations", "SELECT event_id, row_number() OVER (PARTITION BY event_id % 7 ORDER BY event_id) - 1 AS migration_order FROM events")
def s9(s, d):
    return ddl.discover_migrations(ddl_files(s, d))[0].select("event_id", "migration_order")


OBJ = "'t' || (user_id % 50)"


@query("s10_ddl_statements", f"SELECT event_id % 7 AS repo_id, 0 AS statement_index, 'SUPPORTED' AS outcome, 'CREATE_POLICY' AS kind, {OBJ} AS object_name, 'P1' AS policy_name, 'anon' AS roles, NULL AS security_mode, event_id FROM events WHERE event_type = 'signup' UNION ALL SELECT event_id % 7, 0, 'SUPPORTED', 'CREATE_FUNCTION', {OBJ}, NULL, NULL, 'DEFINER', event_id FROM events WHERE event_type = 'view' UNION ALL SELECT event_id % 7, 0, 'UNSUPPORTED', NULL, NULL, NULL, NULL, NULL, event_id FROM events WHERE event_type = 'error' UNION ALL SELECT event_id % 7, 1, 'SUPPORTED', 'ENABLE_RLS', {OBJ}, NULL, NULL, NULL, event_id FROM events WHERE event_type = 'error' UNION ALL SELECT event_id % 7, 0, 'SUPPORTED', 'GRANT', {OBJ}, NULL, 'anon,authenticated', NULL, event_id FROM events WHERE event_type = 'click' UNION ALL SELECT event_id % 7, i, 'MALFORMED', NULL, NULL, NULL, NULL, NULL, event_id FROM events CROSS JOIN (SELECT unnest([0, 1]) AS i) WHERE event_type NOT IN ('signup', 'view', 'error', 'click')")
def s10(s, d):
    files = ddl_files(s, d)
    rows = ddl.extract_ddl(ddl.discover_migrations(files)[0])
    return rows.join(files.select("path", "event_id"), "path").select("repo_id", "statement_index", "outcome", "kind", "object_name", F.replace("policy_name", F.lit(";"), F.lit("")).alias("policy_name"), F.array_join("roles", ",").alias("roles"), "security_mode", "event_id")


@query("s11_api_config", "SELECT user_id AS repo_id, user_id % 2 = 0 AS api_enabled, 'public,' || 's' || (user_id % 3) AS schemas, CASE WHEN user_id % 5 = 0 THEN 'PARTIAL' ELSE 'COVERED' END AS parse_coverage FROM (SELECT DISTINCT user_id FROM events)")
def s11(s, d):
    u = F.col("repo_id")
    text = F.concat(F.lit("# c\n[api]\nenabled = "), F.when(u % 2 == 0, "true").otherwise("false"), F.lit('\nschemas = ["public", "s'), (u % 3).cast("string"), F.lit('"]\n[other]\nenabled = x\n[functions.hello]\nverify_jwt = false\n'), F.when(u % 5 == 0, "colour = 1\n").otherwise(""))
    return ddl.extract_api_config(ev(s, d).select(F.col("user_id").alias("repo_id")).distinct().withColumn("content", text))[0].select("repo_id", "api_enabled", F.array_join("schemas", ",").alias("schemas"), "parse_coverage")


def occurrences(s, d):
    k = F.col("l_linenumber")
    return table(s, d, "lineitem").select((F.col("l_orderkey") % 50).cast("string").alias("repo_id"), F.concat(F.lit("f"), F.col("l_orderkey").cast("string")).alias("path"), F.concat(F.lit("s"), F.col("l_partkey").cast("string")).alias("symbol"), k.cast("string").alias("line"), (k == 1).alias("is_definition"), F.when(F.col("l_orderkey") % 50 == 7, "HEURISTIC").otherwise("EXACT").alias("quality"))


OCC = "SELECT (l_orderkey % 50)::VARCHAR AS r, 'f' || l_orderkey AS f, 's' || l_partkey AS y, l_linenumber::VARCHAR AS n FROM lineitem"


@query("s12_occurrence_edges", f"SELECT DISTINCT r AS repo_id, {NODE('REFERENCE', chr(39) * 0 + 'r || ' + chr(39) + ':' + chr(39) + ' || f || ' + chr(39) + ':' + chr(39) + ' || n || ' + chr(39) + ':' + chr(39) + ' || y')} AS source, {NODE('SYMBOL', 'r || ' + chr(39) + ':' + chr(39) + ' || y')} AS target FROM ({OCC}) WHERE n <> '1'")
def s12(s, d):
    return reports.ingest_occurrences(occurrences(s, d))[1].select("repo_id", "source", "target")


@query("s12_occurrence_nodes", f"SELECT DISTINCT r AS repo_id, 'FILE' AS kind, r || ':' || f AS key FROM ({OCC}) UNION ALL SELECT DISTINCT r, 'SYMBOL', r || ':' || y FROM ({OCC}) UNION ALL SELECT DISTINCT r, 'REFERENCE', r || ':' || f || ':' || n || ':' || y FROM ({OCC}) WHERE n <> '1'")
def s12_nodes(s, d):
    return reports.ingest_occurrences(occurrences(s, d))[0].select("repo_id", "kind", "key")


@query("s13_occurrence_gaps", "SELECT n_nationkey AS repo_id, CASE n_nationkey % 4 WHEN 0 THEN 'UNAVAILABLE' WHEN 1 THEN 'UNSUPPORTED' ELSE 'FAILED' END AS state FROM nation WHERE n_nationkey % 4 <> 3")
def s13(s, d):
    n = table(s, d, "nation").select(F.col("n_nationkey").alias("repo_id"))
    m = F.col("repo_id") % 4
    return reports.occurrence_gaps(n, n.where(m != 0).withColumn("status", F.when(m == 1, "UNSUPPORTED").when(m == 2, "BROKEN").otherwise("READY"))).select("repo_id", "state")


@query("s14_traces", "SELECT event_id AS id, CASE WHEN event_id % 6 <> 0 THEN event_type END AS method, CASE WHEN event_id % 6 = 0 THEN 'MALFORMED' END AS reject_reason FROM events WHERE event_id % 6 <> 0 UNION ALL SELECT NULL, NULL, 'MALFORMED' FROM events WHERE event_id % 6 = 0")
def s14(s, d):
    i = F.col("event_id")
    body = F.to_json(F.struct(i.alias("id"), F.col("event_type").alias("method"), F.struct(F.col("user_id").alias("user")).alias("params")))
    frames = reports.parse_frames(ev(s, d).select(F.when(i % 6 == 0, F.concat(F.lit("{broken "), i.cast("string"))).otherwise(body).alias("value")))
    return frames.select("id", "method", "reject_reason")


# --- graph -----------------------------------------------------------------------------------------------------------


def part_edges(s, d):
    p = table(s, d, "part")
    n = p.agg(F.max("p_partkey").alias("m"))
    rows = p.select("p_partkey").crossJoin(F.broadcast(n))  # one row
    both = F.explode(F.array(F.struct(F.lit("A").alias("relation"), ((F.col("p_partkey") * 7 + 3) % (F.col("m") + 1)).alias("target")), F.struct(F.lit("B").alias("relation"), ((F.col("p_partkey") * 3 + 1) % (F.col("m") + 1)).alias("target"))))
    return rows.select(F.col("p_partkey").alias("source"), both.alias("e")).select("source", "e.relation", "e.target").select("source", "relation", "target", F.concat_ws("-", "source", "relation", "target").alias("edge_id"))


PE = "SELECT p_partkey AS s, (p_partkey * 7 + 3) % n AS t FROM part, (SELECT max(p_partkey) + 1 AS n FROM part) UNION ALL SELECT p_partkey, (p_partkey * 3 + 1) % n FROM part, (SELECT max(p_partkey) + 1 AS n FROM part)"


@query("g1_reverse_reach", f"WITH RECURSIVE e AS ({PE}), w(node, depth) AS (SELECT p_partkey, 0 FROM part UNION SELECT e.s, depth + 1 FROM w JOIN e ON e.t = w.node WHERE depth < 4), r AS (SELECT x.p_partkey AS seed FROM part x), v(seed, node, depth) AS (SELECT seed, seed, 0 FROM r UNION SELECT v.seed, e.s, v.depth + 1 FROM v JOIN e ON e.t = v.node WHERE v.depth < 4) SELECT seed, node, min(depth) AS depth FROM v GROUP BY 1, 2")
def g1(s, d):
    seeds = table(s, d, "part").select(F.col("p_partkey").alias("seed"))
    return graph.reverse_reach(part_edges(s, d), seeds, 4).select("seed", "node", "depth")


@query("g1_witness_lengths", f"WITH RECURSIVE e AS ({PE}), v(seed, node, depth) AS (SELECT p_partkey, p_partkey, 0 FROM part UNION SELECT v.seed, e.s, v.depth + 1 FROM v JOIN e ON e.t = v.node WHERE v.depth < 3) SELECT seed, node, min(depth) AS edges FROM v GROUP BY 1, 2")
def g1_witness(s, d):
    seeds = table(s, d, "part").select(F.col("p_partkey").alias("seed"))
    e = part_edges(s, d)
    return graph.witnesses(graph.reverse_reach(e, seeds, 3), e, 3).select("seed", "node", F.size("witness_edges").alias("edges"))


@query("g2_subtree", f"WITH RECURSIVE e AS ({PE}), v(seed, node, depth) AS (SELECT p_partkey, p_partkey, 0 FROM part UNION SELECT v.seed, e.t, v.depth + 1 FROM v JOIN e ON e.s = v.node WHERE v.depth < 3) SELECT seed, node, min(depth) AS depth FROM v GROUP BY 1, 2")
def g2(s, d):
    roots = table(s, d, "part").select(F.col("p_partkey").alias("seed"))
    return graph.subtree(part_edges(s, d), roots, 3)[0]


def tree_graph(s, d):
    o, c, n = (table(s, d, t) for t in ("orders", "customer", "nation"))
    nodes = c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node_id")).unionByName(n.where("n_nationkey % 6 <> 0").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node_id")))
    nodes = nodes.unionByName(nodes.where("node_id in ('c1', 'n1')"))
    edges = c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("source"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("target")).withColumn("edge_id", F.concat_ws(">", "source", "target"))
    return nodes, edges


@query("j24_graph_check", "SELECT 'DUPLICATE_NODE' AS code, x AS id FROM (SELECT 'c' || c_custkey AS x FROM customer UNION ALL SELECT 'n' || n_nationkey FROM nation WHERE n_nationkey % 6 <> 0) WHERE x IN ('c1', 'n1') UNION ALL SELECT 'MISSING_TARGET', 'c' || c_custkey || '>n' || c_nationkey FROM customer WHERE c_nationkey % 6 = 0")
def j24(s, d):
    return graph.graph_check(*tree_graph(s, d))


def observations(s, d):
    c, o = table(s, d, "customer"), table(s, d, "orders")
    routes = c.select(F.concat(F.lit("r"), F.col("c_custkey").cast("string")).alias("route_id"), F.concat(F.lit("h"), F.floor(F.col("c_custkey") / 20).cast("string")).alias("handler"), F.concat(F.lit("e"), F.col("c_custkey").cast("string")).alias("evidence_id"))
    kinds = F.array(*map(F.lit, ("READ", "INSERT", "UPDATE", "CALL")))
    ops = o.select(F.concat(F.lit("h"), F.floor(F.col("o_custkey") / 20).cast("string")).alias("handler"), F.concat(F.lit("t"), (F.col("o_orderkey") % 5).cast("string")).alias("resource"), F.get(kinds, (F.col("o_orderkey") % 4).cast("int")).alias("operation"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("evidence_id"))
    return routes, ops, c.where("c_custkey % 50 = 0").select(F.concat(F.lit("i"), F.col("c_custkey").cast("string")).alias("invariant_id"), F.lit("x").alias("evidence_id"))


@query(
    "j20_graph_edges",
    """
SELECT relation, sum(n)::BIGINT AS provenance, count(*) AS edges
FROM (SELECT 'REFS' AS relation, c_custkey AS a, 0 AS b, 1 AS n FROM customer
      UNION ALL SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'READS_FROM' ELSE 'WRITES_TO' END, o_custkey // 20, o_orderkey % 5, count(DISTINCT o_orderkey)
      FROM orders WHERE o_orderkey % 4 <> 3 GROUP BY 1, 2, 3) GROUP BY 1
""",
)
def j20(s, d):
    edges = graph.observation_records(*observations(s, d))[1]
    return edges.groupBy("relation").agg(F.sum("n_evidence").alias("provenance"), F.count("*").alias("edges"))


@query("j23_finding_context", "SELECT o_orderkey AS finding_id, (o_custkey % 100)::VARCHAR AS symbol, CASE WHEN o_custkey % 100 < 20 THEN 'REMOVED' WHEN o_custkey % 100 < 40 THEN 'ADDED' WHEN o_custkey % 100 < 60 THEN 'MODIFIED' WHEN o_custkey % 100 < 80 THEN 'UNCHANGED' ELSE 'UNRESOLVED' END AS state FROM orders")
def j23(s, d):
    o = table(s, d, "orders")
    found = o.select(F.col("o_orderkey").alias("finding_id"), F.array(F.lit("file:x"), F.concat(F.lit("symbol:"), (F.col("o_custkey") % 100).cast("string"))).alias("subjects"))
    keys = o.select((F.col("o_custkey") % 100).alias("k")).distinct()
    before = keys.where("k < 20 or k between 40 and 79").select(F.col("k").cast("string").alias("key"), F.lit("a").alias("digest"))
    after = keys.where("k between 20 and 79").select(F.col("k").cast("string").alias("key"), F.when(F.col("k").between(40, 59), "b").otherwise("a").alias("digest"))
    return graph.finding_context(found, before, after)


# --- paths and invariants --------------------------------------------------------------------------------------------


def layers(s, d):
    """Customers as routes, orders as operations, line items as their filters."""
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    c, o = table(s, d, "customer"), table(s, d, "orders")
    repo = F.lit(1)
    routes = c.select(F.expr("c_custkey div 100").alias("repo_id"), text("r", "c_custkey").alias("route_id"), F.array(text("m", "c_custkey"), text("h", "c_custkey")).alias("callback_chain"), F.when(F.col("c_custkey") % 9 == 0, "PARTIAL").otherwise("COVERED").alias("coverage_state"))
    filters = F.array(F.struct(F.lit("tenant").alias("field"), F.lit("EQ").alias("operator"), text("v", "o_custkey").alias("value_origin")))
    ops = o.select(F.expr("o_custkey div 100").alias("repo_id"), text("o", "o_orderkey").alias("operation_id"), text("h", "o_custkey").alias("handler_symbol"), filters.alias("filters"), text("k", "o_orderkey").alias("provider_client"), F.lit("COVERED").alias("coverage_state"), "o_orderkey", "o_custkey")
    none = s.createDataFrame([], "repo_id long, actor_id string")
    values = c.select(F.expr("c_custkey div 100").alias("repo_id"), text("v", "c_custkey").alias("value_id"), text("a", "c_custkey").alias("source_actor"), F.array().cast("array<string>").alias("derivation_inputs"))
    guards = c.where("c_custkey % 4 = 0").select(F.expr("c_custkey div 100").alias("repo_id"), text("g", "c_custkey").alias("guard_id"), text("a", "c_custkey").alias("subject_actor"))
    clients = o.where("o_orderkey % 3 = 0").select(text("k", "o_orderkey").alias("client_id"))
    return routes, none, guards, values, ops, clients, repo


def path_rows(s, d):
    routes, actors, guards, values, ops, clients, _ = layers(s, d)
    links = paths.intrinsic_links(routes, actors, guards, values, ops, clients)
    links = links.withColumn("basis", F.when((F.col("relation") == "NEXT") & (F.substring("source", 2, 20).cast("long") % 7 == 0), "INFERRED").otherwise(F.col("basis")))
    return paths.correlate_paths(routes, ops, links)


@query("g3_paths", "SELECT 'r' || c_custkey AS route_id, 'o' || o_orderkey AS operation_id, 4 AS nodes, CASE WHEN c_custkey % 9 = 0 OR c_custkey % 7 = 0 THEN 'PARTIAL' ELSE 'SUPPORTED' END AS state FROM customer JOIN orders ON c_custkey = o_custkey")
def g3(s, d):
    return path_rows(s, d)[0].select("route_id", "operation_id", F.size("nodes").alias("nodes"), "state")


@query("g3_links", "SELECT relation, count(*) AS n FROM (SELECT 'HANDLED_BY' AS relation FROM customer UNION ALL SELECT 'NEXT' FROM customer UNION ALL SELECT 'PROVIDES' FROM customer UNION ALL SELECT 'CHECKED_BY' FROM customer WHERE c_custkey % 4 = 0 UNION ALL SELECT 'FILTERS' FROM orders UNION ALL SELECT 'PERFORMS' FROM orders UNION ALL SELECT 'USES' FROM orders WHERE o_orderkey % 3 = 0) GROUP BY 1")
def g3_links(s, d):
    return paths.intrinsic_links(*layers(s, d)[:6]).groupBy("relation").agg(F.count("*").alias("n"))


@query("g3_ambiguous_ids", "SELECT o_custkey % 40 AS id FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) > 1")
def g3_ambiguous(s, d):
    return paths.unambiguous(table(s, d, "orders").select((F.col("o_custkey") % 40).alias("id"), "o_orderpriority"), "id")[1].select("id")


@query("g4_qualified_paths", "SELECT 'r' || c_custkey AS route_id, 'o' || o_orderkey AS operation_id, CASE WHEN c_custkey % 9 <> 0 AND c_custkey % 7 <> 0 AND c_custkey % 2 = 0 THEN 1 ELSE 0 END AS role_guards, c_custkey % 9 <> 0 AND c_custkey % 7 <> 0 AND c_custkey % 2 = 0 AS changed FROM customer JOIN orders ON c_custkey = o_custkey")
def g4(s, d):
    found, _ = path_rows(s, d)
    guards = table(s, d, "customer").where("c_custkey % 2 = 0").select(F.concat(F.lit("m"), F.col("c_custkey").cast("string")).alias("guard_id"), F.lit("ROLE").alias("guard_kind"))
    rows = paths.qualify_paths(found, guards, found.select("operation_id").limit(0))
    return rows.select("route_id", "operation_id", F.size("role_guards").alias("role_guards"), (F.col("path_id") != F.col("qualified_path_id")).alias("changed"))


@query("j17_support", "SELECT 's' || c_custkey AS subject_id, 'e' || o_orderkey AS evidence_id FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderkey % 3 <> 0")
def j17(s, d):
    return paths.support(*support_rows(s, d))[0]


def support_rows(s, d):
    subjects = table(s, d, "customer").select(F.concat(F.lit("s"), F.col("c_custkey").cast("string")).alias("subject_id"))
    evidence = table(s, d, "orders").select(F.concat(F.lit("e"), F.col("o_orderkey").cast("string")).alias("evidence_id"), F.array(F.concat(F.lit("s"), F.col("o_custkey").cast("string"))).alias("subjects"), F.when(F.col("o_orderkey") % 3 == 0, "UNSUPPORTED").otherwise("SUPPORTED").alias("status"))
    return subjects, evidence


@query("j17_support_diagnostics", "SELECT 's' || c_custkey AS subject_id, 'UNMATCHED' AS diagnostic FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 <> 0) UNION ALL SELECT DISTINCT 's' || o_custkey, 'UNSUPPORTED_EVIDENCE' FROM orders WHERE o_orderkey % 3 = 0 AND o_custkey IN (SELECT c_custkey FROM customer)")
def j17_lost(s, d):
    return paths.support(*support_rows(s, d))[1]


def file_links(s, d):
    k, t = F.col("c_custkey"), lambda p: F.concat(F.lit(p), F.col("c_custkey").cast("string"))
    c = table(s, d, "customer").withColumn("repo_id", k % 40)
    routes = c.select("repo_id", t("f").alias("path"), t("r").alias("route_id"), F.array(F.lit("auth"), t("h")).alias("callback_chain"))
    imports = c.where(k % 5 != 0).select("repo_id", t("f").alias("path"), t("h").alias("local_name"), t("x").alias("target_path"), F.lit("run").alias("exported_name"), (k % 5 == 1).alias("shadowed"))
    imports = imports.unionByName(imports.where("local_name like '%7'"))
    exports = c.where(k % 3 != 0).select("repo_id", t("x").alias("path"), F.lit("run").alias("exported_name"), t("sym").alias("symbol"), F.when(k % 4 == 0, "DYNAMIC").otherwise("DIRECT").alias("kind"))
    return routes, imports, exports


DIAG = "CASE WHEN c_custkey % 5 = 0 THEN 'NO_BINDING' WHEN c_custkey % 10 = 7 THEN 'AMBIGUOUS_BINDING' WHEN c_custkey % 5 = 1 THEN 'SHADOWED' WHEN c_custkey % 3 = 0 THEN 'NO_EXPORT' WHEN c_custkey % 4 = 0 THEN 'UNSUPPORTED_EXPORT' END"


@query("j18_file_links", f"SELECT 'h' || c_custkey AS source, 'sym' || c_custkey AS target FROM customer WHERE ({DIAG}) IS NULL")
def j18(s, d):
    return paths.link_files(*file_links(s, d))[0].select("source", "target")


@query("j18_link_diagnostics", f"SELECT 'r' || c_custkey AS route_id, {DIAG} AS diagnostic FROM customer WHERE ({DIAG}) IS NOT NULL")
def j18_lost(s, d):
    return paths.link_files(*file_links(s, d))[1].select("route_id", "diagnostic")


@query("j19_occurrence_links", "SELECT c_nationkey AS repo_id, CASE WHEN bool_or(c_custkey % 10 = 0) THEN 'PARTIAL' ELSE 'COVERED' END AS state FROM customer WHERE c_custkey % 3 <> 0 GROUP BY 1")
def j19(s, d):
    k = F.col("c_custkey")
    edges = table(s, d, "customer").select(F.col("c_nationkey").alias("repo_id"), F.concat(F.lit("a"), k.cast("string")).alias("source"), F.when(k % 3 == 0, "DEFINES").otherwise("REFS").alias("relation"), F.lit("b").alias("target"), F.when(k % 10 == 0, "INFERRED").otherwise("EXTRACTED").alias("confidence"))
    return paths.occurrence_links(edges)[1]


@query("j21_review_context", "SELECT 'p' || o_orderkey AS path_id, 'f' || (c_custkey % 30) AS file, coalesce(string_agg('i' || l_linenumber || '=' || l_returnflag, ',' ORDER BY 'i' || l_linenumber || '=' || l_returnflag), '') AS evaluations, c_custkey % 30 < 5 AS changed FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 4")
def j21(s, d):
    p = table(s, d, "orders").select(F.concat(F.lit("p"), F.col("o_orderkey").cast("string")).alias("path_id"), F.col("o_custkey").alias("route_id"))
    routes = table(s, d, "customer").select(F.col("c_custkey").alias("route_id"), F.concat(F.lit("f"), (F.col("c_custkey") % 30).cast("string")).alias("file"))
    evals = table(s, d, "lineitem").select(F.concat(F.lit("p"), F.col("l_orderkey").cast("string")).alias("path_id"), F.concat(F.lit("i"), F.col("l_linenumber").cast("string")).alias("invariant_id"), F.col("l_returnflag").alias("state"))
    changed = routes.where("route_id % 30 < 5").select("file")
    return paths.review_context(p, routes, evals, changed)[0].select("path_id", "file", F.array_join("evaluations", ",").alias("evaluations"), "changed")


@query("j32_explanation_chains", "SELECT DISTINCT o_orderkey AS finding_id, l_orderkey AS path_id, l_orderkey || '-' || l_linenumber AS evaluation_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 2 = 0 OR l_linenumber = 1 OR o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1)")
def j32(s, d):
    key = F.col("o_orderkey").cast("string")
    exact = F.array(F.concat(F.lit("cross_layer_path:"), key), F.concat(F.lit("invariant_evaluation:"), key, F.lit("-1")))
    found = table(s, d, "orders").select(F.col("o_orderkey").alias("finding_id"), F.when(F.col("o_orderkey") % 2 == 0, F.slice(exact, 1, 1)).otherwise(exact).alias("affected_subjects"))
    contexts = table(s, d, "lineitem").select(F.col("l_orderkey").alias("path_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("evaluation_id"), F.lit("inv").alias("invariant_id"))
    return paths.explanation_chains(found, contexts)


@query("j33_control_layers", "SELECT event_id AS finding_id, CASE event_id % 4 WHEN 0 THEN 'DATABASE_POLICY' WHEN 1 THEN 'DATABASE_PRIVILEGE' END AS layer FROM events WHERE event_id % 4 < 2")
def j33(s, d):
    category = F.get(F.array(*map(F.lit, ("rls.off", "grant.wide", "storage.open", "other"))), (F.col("event_id") % 4).cast("int"))
    covered = ev(s, d).select(F.when(F.col("event_id") % 2 == 0, "DATABASE_POLICY").otherwise("DATABASE_PRIVILEGE").alias("layer"), F.lit("COVERED").alias("state"))
    return paths.control_layers(ev(s, d).select(F.col("event_id").alias("finding_id"), category.alias("category")), covered)




def scope_sides(s, d):
    none = F.array().cast("array<string>")
    inv = table(s, d, "nation").select((F.col("n_nationkey") % 40).alias("repo_id"), F.col("n_nationkey").alias("invariant_id"), none.alias("routes"), F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("F"))).otherwise(none).alias("methods"), none.alias("resources"), none.alias("kinds"), none.alias("target_paths"))
    o = F.col("o_orderkey")
    rows = table(s, d, "orders").select((F.col("o_custkey") % 40).alias("repo_id"), o.alias("path_id"), F.lit("/x").alias("route_pattern"), F.col("o_orderstatus").alias("method"), F.lit("t").alias("resource"), F.lit("READ").alias("kind"), o.alias("operation_id"), F.when(o % 11 == 0, "GROUP").otherwise("TENANT").alias("identity"), F.lit("tenant").alias("field"), F.array(F.lit("admin")).alias("roles"), F.array(F.lit("owner")).alias("protected"), F.when(o % 4 == 0, "REQUEST_OBJECT").when(o % 4 == 1, "EXPLICIT").when(o % 4 == 2, "EXPLICIT").otherwise("DYNAMIC").alias("mutation_mode"), F.array(F.when(o % 4 == 1, "owner").otherwise("name")).alias("mutation_fields"), F.col("o_custkey").alias("client_id"), F.when(o % 3 == 0, "STANDARD").when(o % 3 == 1, "ELEVATED").otherwise("UNRESOLVED").alias("authority"), F.when(o % 2 == 0, "SERVER").otherwise("BROWSER").alias("context"), (o % 5 != 0).alias("has_guard"))
    return inv, rows


def scoped(s, d):
    return invariants.in_scope(*scope_sides(s, d))


SCOPED = "SELECT n_nationkey AS inv, o_orderkey AS o, o_custkey AS c, n_nationkey % 2 = 1 OR o_orderstatus = 'F' AS applies FROM nation JOIN orders ON n_nationkey % 40 = o_custkey % 40"


@query("i0_scope", f"SELECT inv AS invariant_id, o AS path_id, applies FROM ({SCOPED})")
def i0(s, d):
    return scoped(s, d).select("invariant_id", "path_id", "applies")


TENANT = f"SELECT inv AS invariant_id, o AS path_id, CASE WHEN NOT applies THEN 'NOT_APPLICABLE' WHEN o % 11 = 0 THEN 'UNKNOWN' WHEN coalesce(u, false) THEN 'UNKNOWN' WHEN n = 0 OR coalesce(v, false) THEN 'VIOLATED' ELSE 'SATISFIED' END AS state FROM ({SCOPED}) LEFT JOIN (SELECT l_orderkey, count(*) AS n, bool_or(l_linenumber % 5 = 4 OR l_suppkey % 6 = 0) AS u, bool_or(l_suppkey % 6 = 1) AS v FROM lineitem WHERE l_linenumber <> 7 GROUP BY 1) ON l_orderkey = o"


def tenant_inputs(s, d):
    filters = table(s, d, "lineitem").select(F.col("l_orderkey").alias("operation_id"), F.when(F.col("l_linenumber") == 7, "other").otherwise("tenant").alias("field"), F.when(F.col("l_linenumber") % 5 == 4, "LIKE").otherwise("EQ").alias("operator"), F.col("l_suppkey").alias("value_origin"))
    k = F.col("s_suppkey")
    p = table(s, d, "supplier")
    values = p.select(k.alias("value_id"), k.alias("source_actor"))
    actors = p.select(k.alias("actor_id"), F.when(k % 6 == 1, "ROLE").otherwise("TENANT").alias("identity_kind"), F.when(k % 6 == 0, "REQUEST_BODY").otherwise("TOKEN_CLAIM").alias("source_kind"), F.lit("VERIFIED").alias("trust_basis"))
    return filters, values, actors


TENANT_STATES = TENANT.replace("n = 0", "n IS NULL")


def tenant_states(s, d):
    return invariants.tenant_binding(scoped(s, d), *tenant_inputs(s, d))


@query("i1_tenant_binding", TENANT_STATES)
def i1(s, d):
    return tenant_states(s, d)


ROLE = f"SELECT inv AS invariant_id, o AS path_id, CASE WHEN NOT applies THEN 'NOT_APPLICABLE' WHEN o % 4 = 0 THEN 'SATISFIED' WHEN o % 4 = 1 THEN 'UNKNOWN' ELSE 'VIOLATED' END AS state FROM ({SCOPED})"


def role_guards(s, d):
    o = F.col("path_id")
    return table(s, d, "orders").select(F.col("o_orderkey").alias("path_id")).where(o % 4 != 3).select("path_id", F.concat(F.lit("g"), o.cast("string")).alias("guard_id"), F.lit("ROLE").alias("guard_kind"), F.when(o % 4 == 2, "other").otherwise("t").alias("guard_resource"), F.array(F.lit("admin")).alias("values"), (o % 4 != 1).alias("resolved"))


@query("i2_required_role", ROLE)
def i2(s, d):
    return invariants.required_role(scoped(s, d), role_guards(s, d)).select("invariant_id", "path_id", "state")


PROTECTED = f"SELECT inv AS invariant_id, o AS path_id, CASE WHEN NOT applies THEN 'NOT_APPLICABLE' WHEN o % 4 IN (0, 1) THEN 'VIOLATED' WHEN o % 4 = 2 THEN 'SATISFIED' ELSE 'UNKNOWN' END AS state FROM ({SCOPED})"


@query("i3_protected_properties", PROTECTED)
def i3(s, d):
    return invariants.protected_properties(scoped(s, d))


ELEVATED = f"SELECT inv AS invariant_id, o AS path_id, CASE WHEN NOT applies OR o % 3 = 0 THEN 'NOT_APPLICABLE' WHEN o % 3 = 2 OR c % 7 = 0 THEN 'UNKNOWN' WHEN o % 2 = 1 OR o % 5 = 0 THEN 'VIOLATED' ELSE 'SATISFIED' END AS state FROM ({SCOPED})"


def known_clients(s, d):
    return table(s, d, "orders").where("o_custkey % 7 <> 0").select(F.col("o_custkey").alias("client_id"))


@query("i4_elevated_client", ELEVATED)
def i4(s, d):
    return invariants.elevated_client(scoped(s, d), known_clients(s, d))


@query("a8_tightened", f"SELECT invariant_id, path_id, CASE WHEN bool_or(state = 'VIOLATED') THEN 'VIOLATED' WHEN bool_or(state = 'UNKNOWN') THEN 'UNKNOWN' WHEN bool_or(state = 'SATISFIED') THEN 'SATISFIED' ELSE 'NOT_APPLICABLE' END AS state FROM ({TENANT.replace('n = 0', 'n IS NULL')} UNION ALL {PROTECTED}) GROUP BY 1, 2")
def a8(s, d):
    return invariants.tightened(tenant_states(s, d), invariants.protected_properties(scoped(s, d)))


# --- regression ------------------------------------------------------------------------------------------------------


@query("v22_revision_pairs", "SELECT o_orderkey AS repo_id, CASE WHEN o_orderkey % 5 = 0 THEN 'BASE_ROLE' WHEN o_orderkey % 5 = 1 THEN 'CANDIDATE_ROLE' ELSE 'SAME_REVISION' END AS reject_reason FROM orders WHERE o_orderkey % 5 IN (0, 1, 2)")
def v22(s, d):
    o = F.col("o_orderkey")
    rows = table(s, d, "orders")
    base = rows.select(o.alias("repo_id"), F.lit("x").alias("revision"), F.when(o % 5 == 0, "OTHER").otherwise("TRUSTED_BASE").alias("role"))
    cand = rows.select(o.alias("repo_id"), F.when(o % 5 == 2, "x").otherwise("y").alias("revision"), F.when(o % 5 == 1, "OTHER").otherwise("CANDIDATE").alias("role"))
    return regression.revision_pairs(base, cand)[1].select("repo_id", "reject_reason")


@query("j25_pair_invariants", "SELECT o_orderkey AS invariant_id, CASE WHEN o_orderkey % 3 = 0 THEN 'BASE_ONLY' WHEN o_orderkey % 5 = 0 THEN 'CANDIDATE_ONLY' ELSE 'MATCHED' END AS presence, CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 5 = 0 THEN 'UNPAIRED' WHEN o_orderkey % 4 = 0 THEN 'CONFLICT' ELSE 'COMPATIBLE' END AS continuity FROM orders WHERE NOT (o_orderkey % 3 = 0 AND o_orderkey % 5 = 0)")
def j25(s, d):
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("invariant_id"), F.lit("a").alias("definition_digest"))
    return regression.pair_invariants(o.where("invariant_id % 5 <> 0"), o.where("invariant_id % 3 <> 0").withColumn("definition_digest", F.when(F.col("invariant_id") % 4 == 0, "b").otherwise("a")))


@query("j26_pair_objects", "SELECT event_type AS kind, event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'BASE_ONLY' WHEN event_id % 5 = 0 THEN 'CANDIDATE_ONLY' ELSE 'MATCHED' END AS presence FROM events WHERE NOT (event_id % 3 = 0 AND event_id % 5 = 0)")
def j26(s, d):
    e = ev(s, d).select(F.col("event_type").alias("kind"), F.col("event_id").alias("id"))
    return regression.pair_objects(e.where("id % 5 <> 0"), e.where("id % 3 <> 0"))


@query("j27_compatibility", "SELECT o_orderkey AS pair_id, CASE WHEN o_orderkey % 4 = 0 THEN 'MISSING_SNAPSHOT' WHEN o_orderkey % 4 = 1 THEN 'CONTRACT_MISMATCH' WHEN o_orderkey % 4 = 2 THEN 'CONFIGURATION_MISMATCH' ELSE 'COMPATIBLE' END AS compatibility FROM orders")
def j27(s, d):
    o = F.col("o_orderkey")
    rows = table(s, d, "orders")
    pairs = rows.select(o.alias("pair_id"), (o * 2).alias("base"), (o * 2 + 1).alias("candidate"))
    b = rows.select((o * 2).alias("revision"), F.lit("1").alias("contract"), F.lit("1").alias("schema_version"), F.array(F.lit("b"), F.lit("a")).alias("producers"), F.lit("c").alias("configuration"))
    c = rows.where("o_orderkey % 4 <> 0").select((o * 2 + 1).alias("revision"), F.when(o % 4 == 1, "2").otherwise("1").alias("contract"), F.lit("1").alias("schema_version"), F.array(F.lit("a"), F.lit("b")).alias("producers"), F.when(o % 4 == 2, "d").otherwise("c").alias("configuration"))
    return regression.snapshot_compatibility(pairs, b.unionByName(c))


@query("j28_snapshots", "SELECT r AS revision, count(*) AS n, sha256(string_agg(i || '=' || p, chr(10) ORDER BY i || '=' || p)) AS input_digest FROM (SELECT DISTINCT l_orderkey AS r, l_linenumber || '-' || l_partkey AS i, l_partkey AS p FROM lineitem) GROUP BY 1")
def j28(s, d):
    rows = table(s, d, "lineitem").select(F.col("l_orderkey").alias("revision"), F.concat_ws("-", "l_linenumber", "l_partkey").alias("id"), F.col("l_partkey").cast("string").alias("digest"))
    return regression.compose_snapshot(rows.unionByName(rows), rows.select("revision", "id", F.lit("1").alias("needs")))[0]


@query("j29_bilateral_support", "SELECT o_orderkey AS record_id, 'BASE' AS side FROM orders WHERE o_custkey % 10 = 0 UNION ALL SELECT o_orderkey, 'CANDIDATE' FROM orders WHERE o_custkey % 15 = 0")
def j29(s, d):
    o = table(s, d, "orders")
    refs = o.select(F.col("o_orderkey").alias("record_id"), F.array("o_custkey").alias("base_refs"), F.array("o_custkey").alias("candidate_refs"))
    ids = o.select(F.col("o_custkey").alias("id")).distinct()
    return regression.bilateral_support(refs, ids.where("id % 10 <> 0"), ids.where("id % 15 <> 0"))[1].select("record_id", "side")


@query("j30_pair_coverage", "SELECT c_custkey::VARCHAR AS scope, CASE WHEN c_custkey % 3 = 0 THEN 'COVERAGE_LOST' WHEN c_custkey % 3 = 1 THEN 'COVERAGE_GAINED' ELSE 'SAME' END AS change FROM customer")
def j30(s, d):
    k = F.col("c_custkey")
    rows = table(s, d, "customer").select(F.lit("x").alias("capability"), k.cast("string").alias("scope"), F.lit(None).cast("string").alias("producer"), F.lit("y").alias("dimension"), k.alias("k"))
    base = rows.where("k % 3 <> 1").withColumn("state", F.lit("COVERED"))
    cand = rows.withColumn("state", F.when(F.col("k") % 3 == 0, "PARTIAL").otherwise("COVERED"))
    return regression.pair_coverage(base.drop("k"), cand.drop("k")).select("scope", "change")


STATE = "CASE o_orderstatus WHEN 'F' THEN 'SATISFIED' WHEN 'O' THEN 'VIOLATED' ELSE 'UNKNOWN' END"
CANDIDATE = "CASE o_orderpriority[1] WHEN '1' THEN 'SATISFIED' WHEN '2' THEN 'VIOLATED' WHEN '3' THEN 'NOT_APPLICABLE' ELSE 'UNKNOWN' END"
MOVE = "CASE WHEN b = 'SATISFIED' AND c = 'VIOLATED' THEN 'REGRESSION' WHEN b = 'VIOLATED' AND c IN ('SATISFIED', 'NOT_APPLICABLE') THEN 'IMPROVEMENT' WHEN b = c AND b = 'UNKNOWN' THEN 'UNKNOWN' WHEN b = c THEN 'UNCHANGED' WHEN b = 'NOT_APPLICABLE' AND c = 'VIOLATED' THEN 'REGRESSION' END"


def states(s, d):
    p = F.substring("o_orderpriority", 1, 1)
    b = F.when(F.col("o_orderstatus") == "F", "SATISFIED").when(F.col("o_orderstatus") == "O", "VIOLATED").otherwise("UNKNOWN")
    c = F.when(p == "1", "SATISFIED").when(p == "2", "VIOLATED").when(p == "3", "NOT_APPLICABLE").otherwise("UNKNOWN")
    return table(s, d, "orders").select("o_orderkey", b.alias("base_state"), c.alias("candidate_state"))


@query("rg1_transitions", f"SELECT o_orderkey, {MOVE} AS disposition FROM (SELECT o_orderkey, {STATE} AS b, {CANDIDATE} AS c FROM orders)")
def rg1(s, d):
    return states(s, d).select("o_orderkey", regression.transition(F.col("base_state"), F.col("candidate_state")).alias("disposition"))


@query("rg2_dispositions", f"SELECT o_orderkey, CASE WHEN k % 13 = 0 THEN 'UNKNOWN' WHEN k % 11 = 0 THEN 'UNKNOWN' WHEN k % 7 = 0 THEN CASE WHEN k % 2 = 0 THEN 'REGRESSION' ELSE 'UNKNOWN' END WHEN k % 5 = 0 THEN 'COVERAGE_LOST' WHEN k % 5 = 1 THEN 'COVERAGE_GAINED' ELSE coalesce({MOVE}, 'UNKNOWN') END AS disposition, CASE WHEN k % 13 = 0 THEN 'CAP_REACHED' WHEN k % 11 = 0 THEN 'DEFINITION_CONFLICT' WHEN k % 7 = 0 THEN CASE WHEN k % 2 = 0 THEN 'INVARIANT_REMOVED' ELSE 'BASE_ONLY' END WHEN k % 5 = 0 THEN 'CANDIDATE_NOT_COVERED' WHEN k % 5 = 1 THEN 'BASE_NOT_COVERED' WHEN ({MOVE}) IS NULL THEN 'NO_TRANSITION' ELSE 'STATE_TRANSITION' END AS reason FROM (SELECT o_orderkey, o_orderkey AS k, {STATE} AS b, {CANDIDATE} AS c FROM orders)")
def rg2(s, d):
    k = F.col("o_orderkey")
    rows = states(s, d).withColumns({"base_coverage": F.when(k % 5 == 1, "PARTIAL").otherwise("COVERED"), "candidate_coverage": F.when(k % 5 == 0, "PARTIAL").otherwise("COVERED"), "presence": F.when(k % 7 == 0, "BASE_ONLY").otherwise("MATCHED"), "continuity": F.when(k % 11 == 0, "CONFLICT").otherwise("COMPATIBLE"), "capped": k % 13 == 0, "removal_proven": k % 2 == 0})
    return regression.disposition(rows).select("o_orderkey", "disposition", "reason")


@query("rg3_records", "SELECT o_orderkey AS record_key, 'a,b' AS refs FROM orders WHERE o_orderkey % 4 <> 0")
def rg3(s, d):
    k = F.col("o_orderkey")
    rows = table(s, d, "orders").select(k.alias("record_key"), F.col("o_orderstatus").alias("disposition"), F.array(F.lit("b"), F.lit("a"), F.lit("b")).alias("refs"), F.when(k % 4 == 0, F.array(F.lit("x"), F.lit("x"))).otherwise(F.array(F.lit("x"))).alias("coverage_keys"))
    return regression.seal_records(rows)[0].select("record_key", F.array_join("refs", ",").alias("refs"))


# --- metrics ---------------------------------------------------------------------------------------------------------


def quality(s, d):
    docs = table(s, d, "documents").select("doc_id", F.col("source").alias("case_id"), "n_chars").join(table(s, d, "labels"), "doc_id")
    severity = F.when(F.col("n_chars") > 2000, "HIGH").when(F.col("n_chars") > 1000, "BLOCK").otherwise("LOW")
    expected = docs.where("toxic = 1").select("case_id", F.col("doc_id").alias("finding_id"), severity.alias("severity"))
    emitted = docs.where("quality = 0 or doc_id % 7 = 0").select("case_id", F.col("doc_id").alias("finding_id"), F.when(F.col("doc_id") % 5 == 0, "HIGH").otherwise(severity).alias("severity"))
    return docs.select("case_id").distinct(), expected, emitted


SEV = "CASE WHEN n_chars > 2000 THEN 'HIGH' WHEN n_chars > 1000 THEN 'BLOCK' ELSE 'LOW' END"
QUALITY = f"WITH d AS (SELECT doc_id, source, {SEV} AS sev, toxic, quality FROM documents JOIN labels USING (doc_id)), e AS (SELECT source AS c, doc_id AS f, sev AS want FROM d WHERE toxic = 1), m AS (SELECT source AS c, doc_id AS f, CASE WHEN doc_id % 5 = 0 THEN 'HIGH' ELSE sev END AS got FROM d WHERE quality = 0 OR doc_id % 7 = 0), p AS (SELECT * FROM e FULL JOIN m USING (c, f)), t AS (SELECT count(*) FILTER (want IS NOT NULL AND got IS NOT NULL) AS tp, count(*) FILTER (got IS NULL) AS fn, count(*) FILTER (want IS NULL) AS fp, count(*) FILTER (want IS NOT NULL AND got IN ('HIGH', 'BLOCK')) AS htp, count(*) FILTER (got IN ('HIGH', 'BLOCK')) AS h, count(*) FILTER (want IS NOT NULL AND got IS NOT NULL AND want <> got) AS mis FROM p), q AS (SELECT count(*) AS clean, count(*) FILTER (c IN (SELECT c FROM m)) AS wrong FROM (SELECT DISTINCT source AS c FROM d) WHERE c NOT IN (SELECT c FROM e)), r AS (SELECT 'true_positives' AS metric, tp AS num, 1 AS den FROM t UNION ALL SELECT 'false_negatives', fn, 1 FROM t UNION ALL SELECT 'false_positives', fp, 1 FROM t UNION ALL SELECT 'recall', tp, tp + fn FROM t UNION ALL SELECT 'miss_rate', fn, tp + fn FROM t UNION ALL SELECT 'high_precision', htp, h FROM t UNION ALL SELECT 'severity_mismatches', mis, 1 FROM t UNION ALL SELECT 'clean_false_positive_rate', wrong, clean FROM q) SELECT metric, num, den, CASE WHEN den > 0 THEN 'MEASURED' ELSE 'NOT_APPLICABLE' END AS status FROM r"


@query("a9_finding_quality", QUALITY)
def a9(s, d):
    return metrics.finding_quality(*quality(s, d))


@query("a10_coverage_metrics", "SELECT user_id AS case_id, count(*) FILTER (e) AS expected, count(*) FILTER (e AND st = 'COVERED') AS completed, count(*) FILTER (e AND st = 'PARTIAL') AS gap, count(*) FILTER (e AND st IS NULL) AS missing, count(*) FILTER (NOT e AND st IS NOT NULL) AS unexpected FROM (SELECT user_id, event_type, bool_or(event_id % 3 <> 0) AS e, CASE WHEN bool_or(event_id % 4 <> 0) THEN CASE WHEN max(event_id) % 2 = 0 THEN 'COVERED' ELSE 'PARTIAL' END END AS st FROM events GROUP BY 1, 2) GROUP BY 1 HAVING count(*) FILTER (e) + count(*) FILTER (st IS NOT NULL) > 0")
def a10(s, d):
    e = ev(s, d).select(F.col("user_id").alias("case_id"), F.col("event_type").alias("dimension"), "event_id")
    state = e.groupBy("case_id", "dimension").agg(F.bool_or(F.col("event_id") % 4 != 0).alias("seen"), F.when(F.max("event_id") % 2 == 0, "COVERED").otherwise("PARTIAL").alias("state")).where("seen").drop("seen")
    return metrics.coverage_metrics(e.where("event_id % 3 <> 0").select("case_id", "dimension").distinct(), state)


@query("a11_provenance_metrics", "WITH l AS (SELECT l_orderkey % 50 AS c, l_orderkey AS f, 'e' || l_linenumber AS e, l_linenumber AS n FROM lineitem), r AS (SELECT c, f, bool_and(n <> 3) AS whole FROM l GROUP BY 1, 2), g AS (SELECT DISTINCT c, e FROM l WHERE n NOT IN (3, 5)), x AS (SELECT c, count(DISTINCT e) AS d FROM l WHERE n = 2 GROUP BY 1) SELECT c AS case_id, count(*) AS required, count(*) FILTER (whole) AS complete, count(*) FILTER (NOT whole) AS incomplete, coalesce(max(d), 0) AS dangling FROM r LEFT JOIN x USING (c) GROUP BY 1")
def a11(s, d):
    rows = table(s, d, "lineitem").select((F.col("l_orderkey") % 50).alias("case_id"), F.col("l_orderkey").alias("finding_id"), F.concat(F.lit("e"), F.col("l_linenumber").cast("string")).alias("e"), F.col("l_linenumber").alias("n"))
    lists = lambda df: df.groupBy("case_id", "finding_id").agg(F.collect_set("e").alias("evidence_ids"))
    return metrics.provenance_metrics(lists(rows), lists(rows.where("n <> 3")), rows.where("n <> 2").select("case_id", F.col("e").alias("evidence_id")).distinct())


@query("a12_assertions", "SELECT event_type AS suite, count(*) AS assertions, count(*) FILTER (event_id % 6 = 0) AS failed FROM events GROUP BY 1")
def a12(s, d):
    return metrics.failed_assertions(ev(s, d).select(F.col("event_type").alias("suite"), (F.col("event_id") % 6 != 0).alias("holds")))


@query("a13_replay", "SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN '*missing*' WHEN o_orderkey % 5 = 0 AND o_orderkey % 4 = 0 THEN 'o_orderpriority,o_orderstatus' WHEN o_orderkey % 5 = 0 THEN 'o_orderstatus' ELSE 'o_orderpriority' END AS fields FROM orders WHERE o_orderkey % 9 = 0 OR o_orderkey % 5 = 0 OR o_orderkey % 4 = 0")
def a13(s, d):
    k = F.col("o_orderkey")
    o = table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    two = o.where("o_orderkey % 9 <> 0").withColumns({"o_orderstatus": F.when(k % 5 == 0, "Z").otherwise(F.col("o_orderstatus")), "o_orderpriority": F.when(k % 4 == 0, None).otherwise(F.col("o_orderpriority"))})
    return metrics.replay_differences(o, two, "o_orderkey").withColumn("fields", F.array_join("fields", ","))


@query("a14_latency", "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, n, value AS p95, CASE WHEN value < 150 THEN 'PASS' ELSE 'FAIL' END AS result FROM r WHERE k = (n * 95 + 99) // 100")
def a14(s, d):
    return metrics.latency_summary(ev(s, d).select("event_type", F.col("value").alias("sample")), 150, "event_type")


GUARD = "SELECT CASE event_id % 4 WHEN 0 THEN 'DENY' WHEN 1 THEN 'MALFORMED' ELSE 'ALLOW' END AS w, CASE WHEN event_id % 4 = 1 AND event_id % 3 <> 0 THEN NULL WHEN event_id % 5 = 0 THEN 'DENY' WHEN event_id % 5 = 1 THEN 'ASK' ELSE 'ALLOW' END AS g FROM events"


@query("a17_guard_quality", f"SELECT 'allowed' AS metric, count(*) FILTER (w = 'ALLOW' AND g = 'ALLOW') AS n FROM ({GUARD}) UNION ALL SELECT 'false_blocks', count(*) FILTER (w = 'ALLOW' AND g IN ('DENY', 'ASK')) FROM ({GUARD}) UNION ALL SELECT 'denied', count(*) FILTER (w = 'DENY' AND g = 'DENY') FROM ({GUARD}) UNION ALL SELECT 'incorrect_allows', count(*) FILTER (w = 'DENY' AND g = 'ALLOW') FROM ({GUARD}) UNION ALL SELECT 'malformed_rejected', count(*) FILTER (w = 'MALFORMED' AND g IS NULL) FROM ({GUARD})")
def a17(s, d):
    i = F.col("event_id")
    e = ev(s, d).select(i.alias("case_id"), i)
    want = e.select("case_id", F.when(i % 4 == 0, "DENY").when(i % 4 == 1, "MALFORMED").otherwise("ALLOW").alias("verdict"))
    got = e.where("not (event_id % 4 = 1 and event_id % 3 <> 0)").select("case_id", F.when(i % 5 == 0, "DENY").when(i % 5 == 1, "ASK").otherwise("ALLOW").alias("verdict"))
    return metrics.guard_quality(want, got)


@query("a18_release_gates", "SELECT n_name AS suite, 'fp' AS metric, CASE WHEN n_nationkey % 6 = 0 THEN 'NOT_MEASURED' WHEN n_regionkey * 5 <= n_nationkey % 6 THEN 'PASS' ELSE 'FAIL' END AS gate FROM nation")
def a18(s, d):
    n = table(s, d, "nation").select(F.col("n_name").alias("suite"), F.lit("fp").alias("metric"), F.col("n_regionkey").alias("num"), (F.col("n_nationkey") % 6).alias("den"))
    policy = table(s, d, "region").where("r_regionkey = 0").select(F.lit("fp").alias("metric"), F.lit(1).alias("max_num"), F.lit(5).alias("max_den"))
    return metrics.release_gates(n, policy)


@query("a19_metric_changes", "SELECT p_partkey AS metric, CASE WHEN p_partkey % 5 = 0 THEN 'NEWLY_MEASURED' WHEN p_partkey % 7 = 0 THEN 'NO_LONGER_MEASURED' WHEN p_partkey % 3 = 0 THEN 'UNCHANGED' WHEN (p_partkey % 2 = 0) = (p_partkey % 3 = 1) THEN 'IMPROVED' ELSE 'REGRESSED' END AS change FROM part WHERE NOT (p_partkey % 5 = 0 AND p_partkey % 7 = 0)")
def a19(s, d):
    k = F.col("metric")
    rows = table(s, d, "part").select(F.col("p_partkey").alias("metric"), F.lit(10).alias("num"), F.lit(20).alias("den"), (F.col("p_partkey") % 2 == 0).alias("higher_is_better"))
    return metrics.metric_changes(rows.where("metric % 5 <> 0"), rows.where("metric % 7 <> 0").withColumn("num", F.when(k % 3 == 0, 10).when(k % 3 == 1, 11).otherwise(9)))


# --- sinks and streams -----------------------------------------------------------------------------------------------


def versions(s, d):
    k = F.col("o_orderkey")
    o = table(s, d, "orders").select(k, F.col("o_orderstatus").alias("digest"))
    return o.where("o_orderkey % 3 <> 0").withColumn("digest", F.when(k % 4 == 0, F.concat("digest", F.lit("!"))).otherwise(F.col("digest"))), o.where("o_orderkey % 2 = 0")


@query("k1_append_immutable", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 1 THEN 'INSERTED' WHEN o_orderkey % 4 = 0 THEN 'CONFLICT' ELSE 'UNCHANGED' END AS outcome FROM orders WHERE o_orderkey % 3 <> 0")
def k1(s, d):
    a, b, c = sinks.append_immutable(*versions(s, d), "o_orderkey", "digest")
    mark = lambda df, name: df.select("o_orderkey", F.lit(name).alias("outcome"))
    return mark(a, "INSERTED").unionByName(mark(b, "UNCHANGED")).unionByName(mark(c, "CONFLICT"))


@query("k2_upsert_versioned", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 4 = 0 THEN 2 ELSE 1 END AS revision, CASE WHEN o_orderkey % 3 = 0 THEN 'KEPT' WHEN o_orderkey % 2 = 1 THEN 'INSERTED' WHEN o_orderkey % 4 = 0 THEN 'REVISED' ELSE 'UNCHANGED' END AS outcome FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0")
def k2(s, d):
    new, held = versions(s, d)
    return sinks.upsert_versioned(new, held.withColumn("revision", F.lit(1)), "o_orderkey", "digest")[0].select("o_orderkey", "revision", "outcome")


@query("k4_upsert_edges", "SELECT c_custkey::VARCHAR AS edge_id FROM customer WHERE c_nationkey % 6 = 0")
def k4(s, d):
    nodes, edges = tree_graph(s, d)
    new = edges.select(F.substring_index("source", "c", -1).alias("edge_id"), "source", "target", F.lit("d").alias("digest"))
    return sinks.upsert_edges(new, new.limit(0).withColumn("revision", F.lit(1)), nodes.distinct())[2].select("edge_id")


@query("k3_node_history", "SELECT count(*) AS n FROM orders WHERE o_orderkey % 3 <> 0 AND (o_orderkey % 2 = 1 OR o_orderkey % 4 = 0)")
def k3(s, d):
    new, held = versions(s, d)
    return sinks.upsert_versioned(new, held.withColumn("revision", F.lit(1)), "o_orderkey", "digest")[1].agg(F.count("*").alias("n"))


@query("k5_latest_profile", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1")
def k5(s, d):
    return sinks.latest_only(ev(s, d), "user_id", "event_id").select("user_id", "event_id")


@query("k7_history_check", "SELECT l_orderkey, count(*) AS revisions, l_orderkey % 5 <> 0 AND max(l_linenumber) = count(*) AS consistent FROM lineitem GROUP BY 1")
def k7(s, d):
    h = table(s, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("revision"), F.concat(F.lit("d"), F.col("l_linenumber").cast("string")).alias("digest"))
    current = h.groupBy("l_orderkey").agg(F.max("revision").alias("revision")).withColumn("digest", F.when(F.col("l_orderkey") % 5 == 0, "x").otherwise(F.concat(F.lit("d"), F.col("revision").cast("string"))))
    return sinks.history_check(current, h, "l_orderkey", "digest")


@query("k8_assert_safe", "SELECT doc_id, 'SECRET_PRESENT' AS reject_reason FROM documents WHERE contains(text, 'token = ') OR contains(text, 'idiot')")
def k8(s, d):
    return sinks.assert_safe(table(s, d, "documents").select("doc_id", "text"), "text", ["token = ", "idiot"])[1]


def drained(s, stream, name):
    """What a stream has written once it has read all there is."""
    root = f"{graph.shared_folder(s)}/stream-{name}-{uuid.uuid4().hex}"
    run = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return s.read.schema(stream.schema).parquet(f"{root}/out")


def event_stream(s, d):
    schema = table(s, d, "events").schema
    rows = s.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    return rows.withColumn("k", F.get_json_object("props", "$.k").cast("long")).withColumn("ts", F.col("ts").cast("timestamp"))


@query("st1_chain_stream", "SELECT user_id AS session_id, q AS sequence, 'APPENDED' AS outcome FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS q FROM events)")
def st1(s, d):
    from evidlake.plans.carriers import chain

    root = f"{graph.shared_folder(s)}/chain-{uuid.uuid4().hex}"
    chain(s, d, False).select(F.col("session_id").cast("string"), "sequence", "event_hash", "previous_event_hash").write.parquet(root)
    rows = s.readStream.schema("session_id string, sequence long, event_hash string, previous_event_hash string").parquet(root)
    return drained(s, jobs.chain_stream(rows), "chain").select(F.col("session_id").cast("long").alias("session_id"), "sequence", "outcome")


@query(
    "st2_approval_stream",
    """
WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY ms, kind, id) AS rn FROM
       (SELECT user_id || '-' || event_type AS digest, CASE WHEN event_id % 3 = 0 THEN 'APPROVAL' ELSE 'ASK' END AS kind, event_id::VARCHAR AS id, epoch_ms(ts) AS ms FROM events)
     WHERE ms <= (SELECT max(epoch_ms(ts)) FROM events) - 600000),
   step AS (SELECT digest, 0::BIGINT AS rn, []::STRUCT(ms BIGINT, id VARCHAR)[] AS have, NULL::VARCHAR AS id, NULL::VARCHAR AS approval_id, NULL::VARCHAR AS outcome FROM (SELECT DISTINCT digest FROM r)
     UNION ALL
     SELECT r.digest, r.rn, CASE WHEN r.kind = 'APPROVAL' THEN list_append(live, {'ms': r.ms, 'id': r.id}) ELSE live[2:] END, r.id,
            CASE WHEN r.kind = 'ASK' THEN live[1].id END, CASE WHEN r.kind = 'APPROVAL' THEN 'HELD' WHEN len(live) > 0 THEN 'APPROVED' ELSE 'WAITING' END
     FROM (SELECT s.digest, q.rn, q.kind, q.id, q.ms, list_filter(s.have, lambda h: h.ms + 86400000 > q.ms) AS live FROM step s JOIN r q ON q.digest = s.digest AND q.rn = s.rn + 1) r)
SELECT digest, id AS invocation_id, approval_id, outcome FROM step WHERE outcome IN ('APPROVED', 'WAITING')
""",
)
def st2(s, d):
    i = F.col("event_id")
    digest = F.concat_ws("-", F.col("user_id").cast("string"), "event_type")
    rows = event_stream(s, d).select(digest.alias("digest"), F.when(i % 3 == 0, "APPROVAL").otherwise("ASK").alias("kind"), i.cast("string").alias("id"), F.col("ts").alias("event_time"))
    return drained(s, jobs.approval_stream(rows, ttl_ms=86_400_000), "approvals")


@query("st3_evidence_stream", "SELECT 'e' || (event_id - event_id % 2) AS evidence_id FROM events GROUP BY 1 HAVING count(DISTINCT event_id % 2 * (event_id % 10 // 9)) = 1")
def st3(s, d):
    root = f"{graph.shared_folder(s)}/evidence-{uuid.uuid4().hex}"
    i = F.col("event_id")
    rows = event_stream(s, d).select(F.concat(F.lit("e"), (i - i % 2).cast("string")).alias("evidence_id"), F.when(i % 10 == 9, "other").otherwise("same").alias("digest"))
    run = rows.writeStream.foreachBatch(jobs.evidence_sink(f"{root}/table")).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return RecordStore(s, f"{root}/table").current().select("evidence_id")


@query("st4_text_stream", "SELECT 'sha256:' || sha256(replace(event_type, 'error', '[redacted]')) AS content_hash, CASE WHEN event_type = 'purchase' THEN 'buy' ELSE '' END AS rule_ids FROM events")
def st4(s, d):
    rows = event_stream(s, d).select(F.col("event_type").alias("text"))
    return drained(s, jobs.text_telemetry(rows, ["error"], (("buy", ("purchase",)),)), "texts").select("content_hash", F.array_join("rule_ids", ",").alias("rule_ids"))


@query(
    "st5_activity_windows",
    """
SELECT w AS window_start, user_id AS actor, event_type AS kind, count(*) AS n
FROM (SELECT *, floor(epoch(ts))::BIGINT // 300 * 300 AS w FROM events)
WHERE w + 300 <= (SELECT epoch(max(ts)) - 600 FROM events) GROUP BY 1, 2, 3
""",
)
def st5(s, d):
    found = drained(s, jobs.activity_windows(event_stream(s, d).select("ts", F.col("user_id").alias("actor"), F.col("event_type").alias("kind"))), "activity")
    return found.withColumn("window_start", F.unix_timestamp("window_start"))
