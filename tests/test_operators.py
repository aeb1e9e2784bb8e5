"""Operators on hand-written rows: reject and gap rows, orders of rules, and independence of input order."""

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from evidlake.functions import identity, predicates
from evidlake.operators import coverage, deltas, detect, events, graph, metrics, paths, posture, reconcile, regression
from evidlake.sources import ddl, packages, reports, sinks


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_identity(spark):
    df = spark.createDataFrame([({"b": "1", "a": 'x"y'}, None)], "m map<string,string>, n string")
    assert df.select(identity.canonical({"z": F.col("n"), "m": identity.sorted_map(F.col("m"))})).first()[0] == '{"m":{"a":"x\\"y","b":"1"},"z":null}'
    other = spark.createDataFrame([({"a": 'x"y', "b": "1"}, None)], "m map<string,string>, n string")
    one, two = (d.select(identity.action_digest(F.lit("k"), F.col("m"), F.col("n"))).first()[0] for d in (df, other))
    assert one == two and one.startswith("sha256:")
    assert identity.float_fields(spark.createDataFrame([], "a long, s struct<x:double,y:array<float>>, d decimal(3,1)")) == ["s.x", "s.y[]", "d"]


def test_paths(spark):
    given = {"src/a.py": None, "": "BLANK", " a": "PADDED", "/a": "ABSOLUTE", "C:x": "DRIVE", "a\\b": "BACKSLASH", "a\tb": "CONTROL", "a∕b": "CONFUSABLE", "a/../b": "DOT_OR_EMPTY_PART", None: "BLANK", "x" * 5000: "TOO_LONG"}
    df = spark.createDataFrame([(p,) for p in given], "p string")
    assert {r.p: r.x for r in df.withColumn("x", predicates.path_reason(F.col("p"))).collect()} == given
    tool = {"a%20b/../c": "c", "../x": None, "file:///x": None, "%zz": None, "./a//b": "a/b", "a+b": "a+b"}
    df = spark.createDataFrame([(p,) for p in tool], "p string")
    assert {r.p: r.x for r in df.withColumn("x", predicates.normalised_tool_path(F.col("p"))).collect()} == tool


def test_verdict_sequences(spark):
    """Every sequence of up to three verdicts against the algebra."""
    kinds = ("ALLOW", "ASK", "DENY", "UNDECIDABLE")
    cases = [c for n in range(4) for c in itertools.product(kinds, repeat=n)]
    actions = spark.createDataFrame([(i,) for i in range(len(cases))], "k int")
    verdicts = spark.createDataFrame([(i, v) for i, c in enumerate(cases) for v in c], "k int, verdict string")
    got = {r.k: r.verdict for r in events.compose_verdicts(actions, verdicts, "k").collect()}
    for i, c in enumerate(cases):
        assert got[i] == ("DENY" if "DENY" in c else "UNDECIDABLE" if not c or "UNDECIDABLE" in c else "ASK" if "ASK" in c else "ALLOW")


def test_reconcile_order_independent(spark):
    where = [("src/a.js", None)]
    data = [(f"e{i}", "cat", "CONTRADICTION" if i == 3 else "FACT", (f"p{i % 2}", "1", "S"), [("user", str(i // 4))], where, {"rule": "r"}) for i in range(12)] + [("e99", "cat", "CONTRADICTION", ("p", "1", "S"), [("user", "z")], where, {})]
    schema = "evidence_id string, category string, epistemic_class string, producer struct<id:string,version:string,kind:string>, subjects array<struct<kind:string,id:string>>, locations array<struct<path:string,symbol:string>>, attributes map<string,string>"
    rules = spark.createDataFrame([("r1", "cat")], "rule_id string, category string")
    a, bad = reconcile.reconcile(spark.createDataFrame(data, schema), rules, collect_ids=True)
    b, _ = reconcile.reconcile(spark.createDataFrame(data[::-1], schema).repartition(3), rules, collect_ids=True)
    columns = ("finding_id", "support_state", "evidence_ids", "contradiction_ids", "n_producers")
    assert rows(a, *columns) == rows(b, *columns)
    assert sorted(r.support_state for r in a.collect()) == ["CONTESTED", "CORROBORATED", "CORROBORATED"] and bad.first().reject_reason == "CONTRADICTION_ONLY"


def test_coverage_null_safe(spark):
    e = spark.createDataFrame([("a", "c", None), ("b", "c", "p")], "subject string, capability string, producer string")
    o = spark.createDataFrame([(" a", "c", None, "COVERED"), ("x", "c", None, "COVERED"), ("x", "c", None, "FAILED")], "subject string, capability string, producer string, state string")
    matrix, repeated = coverage.coverage_matrix(e, o)
    assert {(r.subject, r.entry, r.reason) for r in matrix.collect()} == {("a", "OBSERVED_EXPECTED", None), ("x", "OBSERVED_UNEXPECTED", None), ("b", "MISSING_EXPECTED", "PRODUCER_NOT_REPORTED")}
    assert repeated.count() == 1


def test_renames_pair_in_order(spark):
    s = "repo_id string, path string, oid string, mode string"
    before = spark.createDataFrame([("r", "a", "1", "m"), ("r", "b", "1", "m"), ("r", "c", "2", "m"), ("r", "k", "3", "m")], s)
    after = spark.createDataFrame([("r", "x", "1", "m"), ("r", "c", "9", "m"), ("r", "k", "3", "n")], s)
    assert rows(deltas.file_changes(before, after), "kind", "path") == [("DELETED", "b"), ("MODIFIED", "c"), ("RENAMED", "x"), ("TYPE_CHANGED", "k")]


SQL = """-- a note; it's fine
CREATE POLICY "Own rows" ON public.accounts FOR SELECT TO authenticated, anon USING (owner = 'a;b');
/* CREATE TABLE no.no (x int); */
create or replace function public.f() returns void language sql security definer set search_path = '' as $body$ select 1; drop table x; $body$;
GRANT ALL PRIVILEGES ON TABLE public.accounts TO anon;
DO $$ begin execute 'x'; end $$;
select 1;
alter table accounts enable row level security"""


def test_ddl(spark):
    files = spark.createDataFrame([("r", "supabase/migrations/20240101000000_a.sql", SQL), ("r", "supabase/migrations/20240102000000.sql", "select 'open; grant all on x to y"), ("r", "supabase/migrations/x.sql", ""), ("q", "supabase/migrations/20240101000000_a.sql", ""), ("q", "supabase/migrations/20240101000000_b.sql", "")], "repo_id string, path string, content string")
    ok, bad = ddl.discover_migrations(files)
    assert rows(bad, "repo_id") == [("q",)] and ok.count() == 2
    got = {(r.migration_order, r.statement_index): r for r in ddl.extract_ddl(ok).collect()}
    first = got[0, 0]
    assert (first.kind, first.object_schema, first.object_name, first.policy_name, first.command, first.roles, first.has_using) == ("CREATE_POLICY", "public", "accounts", "Own rows", "SELECT", ["authenticated", "anon"], True)
    assert [got[0, i].outcome for i in range(6)] == ["SUPPORTED", "SUPPORTED", "SUPPORTED", "UNSUPPORTED", "IGNORED_SAFE", "SUPPORTED"]
    assert got[0, 1].security_mode == "DEFINER" and got[0, 2].privileges == ["ALL"] and got[0, 5].object_schema is None
    assert all(r.outcome == "MALFORMED" and r.kind is None for k, r in got.items() if k[0] == 1)


def test_places_of_statements(spark):
    """Bytes of each statement in its file, whatever hides in comments and literals; files over a limit are one row."""
    text = "\n-- nöte; x\n CREATE TABLE app.\"t;é\" (a int) /* ö; */ ;;\n'é;' ;\n\tgrant select on app.t to anon"
    files = spark.createDataFrame([("r", "supabase/migrations/20240101000000_a.sql", text), ("r", "supabase/migrations/20240102000000_b.sql", "select 1; select 2; select 3"), ("r", "supabase/migrations/20240103000000_c.sql", "")], "repo_id string, path string, content string")
    found = ddl.extract_ddl(ddl.discover_migrations(files)[0], max_statements=2)
    got = sorted((r for r in found.collect() if r.migration_order == 0), key=lambda r: r.statement_index)
    data = text.encode()
    assert [data[r.start_byte : r.end_byte].decode() for r in got] == ['CREATE TABLE app."t;é" (a int)', "grant select on app.t to anon"]
    assert {r.content_digest for r in got} == {"sha256:" + hashlib.sha256(data).hexdigest()} and [r.object_name for r in got] == ["t;é", "t"]
    assert [(r.outcome, r.statement_index, r.start_byte) for r in found.collect() if r.migration_order == 1] == [("SCAN_REJECTED", None, None)]
    assert {r.outcome for r in ddl.extract_ddl(ddl.discover_migrations(files)[0], max_bytes=30).where("migration_order = 0").collect()} == {"SCAN_REJECTED"}
    reduced = posture.reduce_posture(files.withColumn("content", F.when(F.col("path").contains("_b"), F.repeat(F.lit("x;"), 5000)).otherwise(F.col("content"))))
    assert rows(reduced["gaps"], "gap", "path") == [("SCAN_REJECTED", "supabase/migrations/20240102000000_b.sql")] and rows(reduced["repositories"], "state") == [("PARTIAL",)]
    placed = posture.located(reduced["grants"], reduced["statements"], "granted_at").first()
    assert data[placed.start_byte : placed.end_byte] == b"grant select on app.t to anon" and placed.path.endswith("_a.sql")


def test_migrations_are_read_once(spark):
    """Files over a limit, files with too many statements, empty files and others go one way; repositories with a doubled key are known without their texts."""
    texts = [("r", 1, "create table app.t (a int); grant select on app.t to anon"), ("r", 2, "select 1;" * 5000), ("r", 3, ""), ("e", 1, ""), ("q", 1, "x"), ("q", 1, "y")]
    worked = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda text: worked.add(1) or text)
    files = spark.createDataFrame([(r, f"supabase/migrations/{k:014d}_{i}.sql", t) for i, (r, k, t) in enumerate(texts)], "repo_id string, path string, content string").withColumn("content", seen("content"))
    found = posture.reduce_posture(files)
    assert rows(found["repositories"], "repo_id", "state") == [("e", "COVERED"), ("q", "REJECTED"), ("r", "PARTIAL")]
    assert rows(found["grants"], "object_name", "role") == [("t", "anon")] and rows(found["gaps"], "gap", "statement_index") == [("SCAN_REJECTED", None)]
    assert worked.value <= len(texts)


def test_policy_epochs(spark):
    data = [("p", i, k, c, ["a"], None, None) for i, (k, c) in enumerate([("CREATE", "ALL"), ("ALTER", "SELECT"), ("DROP", None), ("ALTER", "ALL")])] + [("q", 0, "DROP", None, None, None, None), ("q", 1, "CREATE", "ALL", ["a"], True, None), ("q", 2, "ALTER", None, ["b"], None, None), ("z", 0, "CREATE", "ALL", None, None, None), ("z", 1, "DROP", None, None, None, None)]
    df = spark.createDataFrame(data, "policy string, at int, kind string, command string, roles array<string>, has_using boolean, has_with_check boolean").withColumn("pos", posture.position(F.lit(0), F.col("at")))
    got = {r.policy: r for r in posture.policies(df, ["policy"]).collect()}
    assert (got["p"].status, got["p"].command) == ("ALTERED_AFTER_DROP", "UNKNOWN") and got["z"].status == "DROPPED"
    assert (got["q"].status, got["q"].command, got["q"].roles, got["q"].has_using) == ("LIVE", "ALL", ["b"], True)


def test_grants(spark):
    data = [(1, "GRANT", "a", "ALL"), (2, "REVOKE", "a", "SELECT"), (3, "GRANT", "b", "SELECT"), (4, "REVOKE", "b", "ALL"), (5, "GRANT", "b", "INSERT"), (6, "GRANT", "c", "SELECT"), (7, "REVOKE", "c", "SELECT")]
    df = spark.createDataFrame([("t", *d) for d in data], "obj string, at int, action string, role string, privilege string").withColumn("pos", posture.position(F.lit(0), F.col("at")))
    assert rows(posture.grants(df, ["obj"]), "role", "privilege") == [("a", "ALL"), ("b", "INSERT")]


def test_lockfiles(spark):
    cargo = '[[package]]\nname = "a"\nversion = "1.0"\n\n[[package]]\nname = "b"\nversion = "2.0"\n'
    files = spark.createDataFrame([("r", "Cargo.lock", cargo), ("s", "Cargo.lock", '[[package]]\nname = "a\\n"\nversion = "1"\n'), ("t", "Cargo.lock", "x")], "repo_id string, path string, content string")
    ok, bad = packages.cargo_packages(files)
    assert rows(ok, "name", "version") == [("a", "1.0"), ("b", "2.0")] and rows(bad, "repo_id", "reject_reason") == [("s", "BAD_RECORD"), ("t", "NO_RECORD")]
    npm = '{"lockfileVersion":3,"packages":{"":{"name":"root","version":"0"},"node_modules/@x/y":{"version":"1.2.3"},"node_modules/l":{"link":true,"version":"1"}}}'
    ok, bad = packages.npm_packages(spark.createDataFrame([("r", "p", npm), ("s", "p", '{"lockfileVersion":1,"packages":{}}'), ("t", "p", "{")], "repo_id string, path string, content string"))
    assert rows(ok, "name", "version") == [("@x/y", "1.2.3")] and rows(bad, "repo_id", "reject_reason") == [("s", "UNSUPPORTED_VERSION"), ("t", "MALFORMED")]


def test_reports(spark):
    raw = spark.createDataFrame([(1, '{"schema_version":"1","evidence":[{"observation":"x","category":"c","locations":[{"repo_relative_path":"../up"}]}]}'), (2, '{"schema_ver'), (3, '{"schema_version":"1","evidence":[{"observation":"x","category":"c"}]}')], "run_id int, body string")
    ok, bad = reports.ingest_tool_json(raw)
    assert rows(ok, "run_id") == [(3,)] and rows(bad, "run_id", "reject_reason") == [(1, "PATH_OUTSIDE_ROOT"), (2, "MALFORMED")]


def test_repo_files_of_folders(spark, tmp_path):
    """Paths are relative to the root, whatever characters it has; Spark's listing leaves out empty and hidden files."""
    root = tmp_path / "a+b (c).d"
    (root / "src" / "deep").mkdir(parents=True)
    for name, text in (("EMPTY", ""), (".hidden", "x"), ("src/a.py", "x\n"), ("src/deep/é.sql", "select 1")):
        (root / name).write_text(text, encoding="utf-8")
    got = reports.read_repo_files(spark, str(root), "r", "s")
    assert {(r.path, r.length, bytes(r.content).decode()) for r in got.collect()} == {("src/a.py", 2, "x\n"), ("src/deep/é.sql", 8, "select 1")}
    assert {(r.repo_id, r.snapshot_id) for r in got.collect()} == {("r", "s")}


def test_secrets_hide_values(spark):
    line = "x ghp_" + "a" * 36 + " y ghp_" + "a" * 36
    df = spark.createDataFrame([("r", "a.py", "ok\n" + line)], "repo_id string, path string, content string")
    got = detect.scan_secrets(df).orderBy("start_col").collect()
    assert [(g.line_no, g.start_col, g.end_col) for g in got] == [(2, 3, 43), (2, 46, 86)] and all("ghp_" not in str(g) for g in got)
    text = spark.createDataFrame([("a b[redacted]c",), (None,), ("bb",)], "t string").select(detect.redact(F.col("t"), ["b", "bb"]).alias("t"))
    assert [r.t for r in text.collect()] == ["a [redacted][redacted]c", None, "[redacted]"]


def test_reach_and_witness(spark):
    e = spark.createDataFrame([(1, 2, "e12"), (2, 3, "e23"), (1, 3, "e13"), (3, 1, "e31"), (5, 1, "e51")], "source int, target int, edge_id string")
    seeds = spark.createDataFrame([(3,)], "seed int")
    reached = graph.reverse_reach(e, seeds, 5)
    assert rows(reached, "node", "depth") == [(1, 1), (2, 1), (3, 0), (5, 2)]
    assert {r.node: r.witness_edges for r in graph.witnesses(reached, e, 3).collect()}[5] == ["e51", "e13"]
    with pytest.raises(ValueError, match="max_depth"):
        graph.reverse_reach(e, seeds, 65)


@pytest.mark.parametrize("hub", [100_000, 3])
def test_reach_of_many_seeds(spark, monkeypatch, hub):
    """Over 64 seeds, cycles, a node in which most edges end; no round has more rows than nodes times blocks."""
    monkeypatch.setattr(graph, "HUB", hub)
    r = random.Random(3)
    edges = sorted({(r.randrange(60), r.choice([0, 0, r.randrange(60)])) for _ in range(160)} | {(i, i) for i in range(5)})
    named = [(a, b, f"e{a}-{b}") for a, b in edges] + [(7, 0, "a7-0"), (7, 0, "z7-0")]
    seeds = [*range(50), *range(100, 130), 5]
    want = {}
    for seed in set(seeds):
        level, seen, depth = {seed}, {seed: (0, None)}, 0
        while level and depth < 6:
            depth += 1
            found = {}
            for a, b, e in named:
                if b in level and a not in seen:
                    found[a] = min(found.get(a, ("~", 0)), (e, b))
            seen |= {a: (depth, e) for a, (e, _) in found.items()}
            level = set(found)
        want |= {(seed, n): v for n, v in seen.items()}
    e = spark.createDataFrame(named, "source int, target int, edge_id string").repartition(3)
    s = spark.createDataFrame([(x,) for x in seeds], "seed int").repartition(3)
    got = graph.reverse_reach(e, s, 6).collect()
    assert len(got) == len(want) and {(x.seed, x.node): (x.depth, x.via_edge) for x in got} == want
    assert rows(graph.reverse_reach(e, s, 6, via=False)) == sorted((a, b, d) for (a, b), (d, _) in want.items())
    numbers = graph.numbered_seeds(s)
    levels = graph.reach_levels(e.select(F.col("source").alias("step_from"), F.col("target").alias("step_to")), numbers, 6)
    blocks, nodes = numbers.select("block").distinct().count(), len({n for x in named for n in x[:2]} | set(seeds))
    assert max(x["count"] for x in levels.groupBy("depth").count().collect()) <= nodes * blocks and levels.groupBy("node", "block", "depth").count().where("count > 1").isEmpty()


def test_path_caps_are_reported(spark):
    links = spark.createDataFrame([(1, f"n{i}", f"n{j}", "EXTRACTED") for i in range(6) for j in range(6) if i != j], "repo_id int, source string, target string, basis string")
    routes = spark.createDataFrame([(1, "n0", "COVERED")], "repo_id int, route_id string, coverage_state string")
    ops = spark.createDataFrame([(1, "n5", "COVERED")], "repo_id int, operation_id string, coverage_state string")
    found, bad = paths.correlate_paths(routes, ops, links)
    assert found.count() == sum(1 for n in range(5) for _ in itertools.permutations(range(4), n)) and bad.count() == 0
    found, bad = paths.correlate_paths(routes, ops, links, most=3)
    assert found.count() == 0 and rows(bad) == [(1, "TOO_MANY_PATHS")]


def test_crowded_repositories_are_counted_not_expanded(spark, monkeypatch):
    """Repository 1 has 10^12 paths in layers, 2 is the same in small, 3 has few paths but cycles of many walks, 4 is a long chain."""
    layers = lambda repo, width, depth: [(repo, f"{d}.{i}", f"{d + 1}.{j}", "EXTRACTED") for d in range(depth) for i in range(width if d else 1) for j in range(width)]
    data = layers(1, 10, 12) + layers(2, 2, 3) + [(3, "0.0", "c", "EXTRACTED"), ("3", "c", "0.0", "EXTRACTED"), (3, "c", "d", "EXTRACTED"), (3, "d", "c", "EXTRACTED"), (3, "d", "end", "EXTRACTED")] + [(4, f"{i}.0", f"{i + 1}.0", "EXTRACTED") for i in range(40)]
    links = spark.createDataFrame([(int(r), *x) for r, *x in data], "repo_id int, source string, target string, basis string")
    routes = spark.createDataFrame([(r, "0.0", "COVERED") for r in (1, 2, 3, 4, 5)], "repo_id int, route_id string, coverage_state string")
    ops = spark.createDataFrame([(1, "12.0", "COVERED"), (2, "3.1", "COVERED"), (3, "end", "COVERED"), (4, "31.0", "COVERED")], "repo_id int, operation_id string, coverage_state string")
    starts, ends = routes.select("repo_id", F.col("route_id").alias("at")), ops.select(F.col("repo_id").alias("end_repo"), F.col("operation_id").alias("end"))
    hops = links.select("repo_id", F.col("source").alias("at"), F.col("target").alias("to"))
    assert rows(paths.crowded(starts, hops, ends, 32, 8)) == [(1,)] and rows(paths.crowded(starts, hops, ends, 32, 3)) == [(1,), (2,)]
    found, bad = paths.correlate_paths(routes, ops, links, most=8)
    assert rows(bad) == [(1, "TOO_MANY_PATHS")]
    assert rows(found, "repo_id", F.size("nodes").alias("n")) == [(2, 4)] * 4 + [(3, 4), (4, 32)]


def test_only_repositories_that_could_go_over_are_counted(spark, monkeypatch):
    """Repository 1 is over its cap in the third round, 2 stays under it; the links are read from what is kept, not worked out in every round."""
    data = [(1, "0", f"1.{i}") for i in range(3)] + [(1, f"1.{i}", f"2.{j}") for i in range(3) for j in range(3)] + [(1, f"2.{j}", "end") for j in range(3)] + [(2, "0", "a"), (2, "a", "b"), (2, "b", "end"), (2, "b", "a")]
    worked = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda basis: worked.add(1) or basis)
    links = spark.createDataFrame([(*x, "INFERRED" if x[1] == "a" else "EXTRACTED") for x in data], "repo_id int, source string, target string, basis string").withColumn("basis", seen("basis"))
    routes = spark.createDataFrame([(r, "0", "COVERED") for r in (1, 2)], "repo_id int, route_id string, coverage_state string")
    ops = spark.createDataFrame([(r, "end", "COVERED") for r in (1, 2)], "repo_id int, operation_id string, coverage_state string")
    counted, crowded = [], paths.crowded
    monkeypatch.setattr(paths, "crowded", lambda starts, hops, ends, *limits: counted.append({r.repo_id for r in hops.collect()}) or crowded(starts, hops, ends, *limits))
    found, bad = paths.correlate_paths(routes, ops, links, most=8)
    assert rows(bad) == [(1, "TOO_MANY_PATHS")] and counted == [{1}]
    assert rows(found, "repo_id", F.concat_ws(" ", "nodes").alias("n"), "state") == [(2, "0 a b end", "PARTIAL")]
    assert worked.value <= 2 * len(data)


def test_explained_paths_go_before_their_evaluations(spark):
    """A path of which an evaluation is named isn't expanded and dropped again."""
    contexts = spark.createDataFrame([("p", "p-1", "i"), ("p", "p-2", "i"), ("p", "p-2", "i"), ("q", "q-1", "j")], "path_id string, evaluation_id string, invariant_id string")
    named = [("a", ["cross_layer_path:p"]), ("b", ["cross_layer_path:p", "invariant_evaluation:p-1"]), ("c", ["cross_layer_path:q", "invariant_evaluation:p-2"]), ("d", ["invariant:i", "cross_layer_path:p", "invariant_evaluation:p-1"]), ("e", ["invariant:x"])]
    found = paths.explanation_chains(spark.createDataFrame(named, "finding_id string, affected_subjects array<string>"), contexts)
    assert rows(found) == [("a", "p", "p-1"), ("a", "p", "p-2"), ("b", "p", "p-1"), ("c", "p", "p-2"), ("c", "q", "q-1"), ("d", "p", "p-1"), ("d", "p", "p-2")]
    assert "LeftOuter" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_workflow_facts_within_a_row(spark):
    """Run blocks of random files against a plain loop over their lines; no line is dealt or sorted."""
    r = random.Random(3)
    pool = ["on: pull_request_target", "  - run: |", "    run: echo ${{ github.head_ref }}", "      echo ${{ github.event.x }}", "  echo ${{github.event.x}}", "", "   ", "  - name: ${{ github.event.x }}", "\trun: x", "contents: write", "  id-token: write", "  - uses: a/b@v1", "  - uses: ./a@v1", "permissions: write-all", "run: x # ${{ github.sha }}"]
    texts = ["\n".join(r.choice(pool) for _ in range(r.randrange(12))) for _ in range(300)]

    def untrusted(text):
        at, found = None, False
        for line in re.split("\r?\n", text):
            indent = len(line) - len(line.lstrip(" "))
            if re.search(r"^\s*(- )?run:", line):
                at = indent
            elif at is not None and line.strip(" ") and indent <= at:
                at = None
            found |= at is not None and bool(re.search(r"\$\{\{\s*github\.(event\.|head_ref)", line))
        return found

    files = spark.createDataFrame([(1, str(i), x) for i, x in enumerate(texts)] + [(1, "none", None)], "repo_id int, path string, content string")
    found = detect.scan_workflows(files.limit(0), files)
    got = {k: {x.path for x in found.where(F.col("rule") == k).collect()} for k in detect.WORKFLOW_RULES}
    of = lambda rule: {str(i) for i, x in enumerate(texts) if rule(x)}
    assert got["untrusted-expression"] == of(untrusted) and 0 < len(got["untrusted-expression"]) < 300
    assert got["permission-widening"] == of(lambda x: ": write\n" in x + "\n") and got["oidc-token"] == of(lambda x: "id-token" in x)
    assert got["mutable-action"] == of(lambda x: "a/b@v1" in x) and got["write-all"] == of(lambda x: "write-all" in x)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "posexplode" not in plan


def test_occurrence_nodes_by_kind(spark):
    """Keys that meet after they are joined are one node; no row carries all kinds."""
    data = [("r", "a", "s", "1", True, "EXACT"), ("r", "a", "s", "2", False, "EXACT"), ("r", "a", "s", "2", False, "EXACT"), ("r:a", "b", "s", "3", None, "EXACT"), ("r", "a:b", "s", "1", True, "EXACT"), ("q", "a", "s", "2", False, "EXACT")]
    found = reports.ingest_occurrences(spark.createDataFrame(data, "repo_id string, path string, symbol string, line string, is_definition boolean, quality string"))[0]
    assert rows(found, "repo_id", "kind", "key") == sorted([("r", "FILE", "r:a"), ("r", "FILE", "r:a:b"), ("r:a", "FILE", "r:a:b"), ("q", "FILE", "q:a"), ("r", "SYMBOL", "r:s"), ("r:a", "SYMBOL", "r:a:s"), ("q", "SYMBOL", "q:s"), ("r", "REFERENCE", "r:a:2:s"), ("q", "REFERENCE", "q:a:2:s")])
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_versions_and_conflicts(spark):
    s = "k int, digest string"
    new = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "x"), (4, "y"), (1, "a")], s)
    a, b, c = sinks.append_immutable(new, spark.createDataFrame([(2, "b"), (3, "z")], s), "k", "digest")
    assert (rows(a, "k"), rows(b, "k"), rows(c, "k")) == ([(1,)], [(2,)], [(3,), (4,), (4,)])


def test_p95_is_nearest_rank(spark):
    for n, want in ((1, 1), (20, 19), (21, 20), (100, 95), (101, 96)):
        df = spark.range(1, n + 1).select(F.lit("x").alias("k"), F.col("id").alias("sample"))
        assert metrics.latency_summary(df, 1000, "k").first().p95 == want


def test_dispositions(spark):
    base = ("SATISFIED", "VIOLATED", "COVERED", "COVERED", "MATCHED", "COMPATIBLE", False, False)
    cases = [(base, "REGRESSION"), (("VIOLATED", "SATISFIED", *base[2:]), "IMPROVEMENT"), ((*base[:2], "COVERED", "PARTIAL", *base[4:]), "COVERAGE_LOST"), ((*base[:5], "CONFLICT", False, False), "UNKNOWN"), ((*base[:4], "BASE_ONLY", "UNPAIRED", False, True), "REGRESSION"), (("UNKNOWN", "SATISFIED", *base[2:]), "UNKNOWN")]
    df = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(cases)], "i int, base_state string, candidate_state string, base_coverage string, candidate_coverage string, presence string, continuity string, capped boolean, removal_proven boolean")
    assert {r.i: r.disposition for r in regression.disposition(df).collect()} == {i: d for i, (_, d) in enumerate(cases)}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_profile_counts_pairs_once(spark):
    """Repeated pairs don't meet: both sides are distinct before the join."""
    found = spark.createDataFrame([("r", "k1"), ("r", "k1"), ("r", "k2"), ("q", None)], "repo_id string, subject string")
    packs = spark.createDataFrame([("p2", "k1"), ("p1", "k1"), ("p1", "k1"), ("p3", None)], "pack_id string, subject string")
    got = coverage.project_profile(found, packs)
    assert rows(got.select("repo_id", F.coalesce("subject", F.lit("")).alias("subject"), "pack_ids", "availability")) == [("q", "", [], "NOT_INSTALLED"), ("r", "k1", ["p1", "p2"], "AVAILABLE"), ("r", "k2", [], "NOT_INSTALLED")]
    plan = got._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)
    assert plan[1].count("Aggregate") == 2


def test_roll_up_is_hashed(spark):
    """Sums of texts are sorted in each task; the roll-up has none, and keeps states that have no rank."""
    areas = [(k, a, s) for k, s in (("good", "COVERED"), ("odd", "WEIRD"), ("none", None), (None, "PARTIAL")) for a in coverage.AREAS]
    areas += [("less", "ROUTES", "COVERED"), *[("more", a, "COVERED") for a in (*coverage.AREAS, "ROUTES")]]
    areas = [("good", "ROUTES", "SKIPPED") if x[:2] == ("good", "ROUTES") else x for x in areas]
    ok, bad = coverage.roll_up(spark.createDataFrame(areas, "k string, area string, state string"), "k")
    assert sorted(map(tuple, ok.collect()), key=str) == sorted([("good", "SKIPPED"), ("odd", "WEIRD"), ("none", None), (None, "PARTIAL")], key=str)
    assert rows(bad) == [("less", "MISSING_AREA"), ("more", "DUPLICATE_AREA")]
    assert "SortAggregate" not in plan_of(bad)
    many = tuple(f"a{i}" for i in range(130))
    wide = spark.range(130).selectExpr("1 AS k", "concat('a', id) AS area", "'COVERED' AS state")
    assert rows(coverage.roll_up(wide, "k", many)[0]) == [(1, "COVERED")] and coverage.roll_up(wide.where("area <> 'a64'"), "k", many)[0].isEmpty()


def test_bodies_and_paths_once(spark):
    """A row's body is parsed once, and its paths are normalised once, however many rules use them."""
    raw = spark.createDataFrame([(1, '{"schema_version":"1","evidence":[{"observation":"o","category":"c","locations":[{"repo_relative_path":"./a//b/../c%20d"}]}]}'), (2, "x")], "run_id long, body string")
    ok, bad = reports.ingest_tool_json(raw)
    assert rows(ok, "run_id", "paths") == [(1, ["a/c d"])] and rows(bad, "run_id", "reject_reason") == [(2, "MALFORMED")]
    plan = ok._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1 and plan.count("url_decode") + plan.count("UrlDecode") <= 2
