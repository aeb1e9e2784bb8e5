"""Privilege posture from ordered schema-change statements: folds as windows and grouped sums, then observers.

A statement's position is struct<migration_order, statement_index>, written ``pos``; every fold is per (repo_id, object).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidlake.operators.graph import cut_lineage
from evidlake.sources.ddl import discover_migrations, extract_ddl, migration_repositories

API_ROLES = ("anon", "authenticated", "public")


def last_value(statements: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The value that the last statement naming it set, and where."""
    named = statements.where(F.col(value).isNotNull())
    return named.groupBy(*keys).agg(F.max_by(value, "pos").alias(value), F.max("pos").alias("provenance"))


def policies(statements: DataFrame, keys: list[str]) -> DataFrame:
    """State of every policy (W3): CREATE resets, ALTER changes what it names, DROP clears.

    statements: keys, pos, kind (CREATE, ALTER, DROP), command, roles, has_using, has_with_check. Each CREATE or DROP starts an
    epoch; only the last counts. status: LIVE, DROPPED, ALTERED_AFTER_DROP (command unknown) or ALTERED_ONLY.

    What is named last is kept with its position; it holds if it isn't before the last CREATE or DROP. So the fold is a grouped sum that Spark combines before
    the shuffle, for an object of any number of statements.
    """
    last = lambda c, where: F.max_by(F.struct(F.col("pos").alias("at"), F.col(c).alias("value")), F.when(where, F.col("pos")))
    opens = F.col("kind").isin("CREATE", "DROP")
    named = ("command", "roles", "has_using", "has_with_check")
    sums = [last("kind", opens).alias("opened"), F.max(F.when(F.col("kind") == "ALTER", F.col("pos"))).alias("altered_at"), *[last(c, F.col(c).isNotNull()).alias(f"last_{c}") for c in named], F.max("pos").alias("provenance")]
    state = statements.groupBy(*keys).agg(*sums)
    holds = lambda at: F.coalesce(at >= F.col("opened.at"), F.lit(True))
    state = state.select("*", F.coalesce("opened.value", F.lit("ALTER")).alias("opened_by"), *[F.when(holds(F.col(f"last_{c}.at")), F.col(f"last_{c}.value")).alias(c) for c in named])
    altered = F.col("altered_at").isNotNull() & holds(F.col("altered_at"))
    status = F.when(F.col("opened_by") == "CREATE", "LIVE").when((F.col("opened_by") == "DROP") & ~altered, "DROPPED").when(F.col("opened_by") == "DROP", "ALTERED_AFTER_DROP").otherwise("ALTERED_ONLY")
    state = state.select(*keys, "opened_by", *named, "provenance", status.alias("status"))
    return state.withColumn("command", F.when(F.col("status") == "LIVE", F.col("command")).when(F.col("status") == "DROPPED", F.lit(None)).otherwise(F.lit("UNKNOWN")))


def removals(statements: DataFrame, keys: list[str]) -> DataFrame:
    """The last DROP of every policy that has one."""
    return statements.where("kind = 'DROP'").groupBy(*keys).agg(F.max("pos").alias("removed_at"))


def grants(statements: DataFrame, keys: list[str]) -> DataFrame:
    """Grants in force (W4): (keys, role, privilege, granted_at, revoked_at).

    statements: keys, pos, action (GRANT, REVOKE), role, privilege; one row per role and privilege. Revoking ALL clears the role. A grant
    of ALL is its own key, which revoking one privilege leaves.
    """
    given = statements.where("action = 'GRANT'").groupBy(*keys, "role", "privilege").agg(F.max("pos").alias("granted_at"))
    taken = statements.where("action = 'REVOKE'")
    one = taken.groupBy(*keys, "role", "privilege").agg(F.max("pos").alias("one_at"))
    every = taken.where("privilege = 'ALL'").groupBy(*keys, "role").agg(F.max("pos").alias("all_at"))
    role = taken.groupBy(*keys, "role").agg(F.max("pos").alias("revoked_at"))
    rows = given.join(one, [*keys, "role", "privilege"], "left").join(every, [*keys, "role"], "left").join(role, [*keys, "role"], "left")
    later = lambda c: F.coalesce(F.col("granted_at") > F.col(c), F.lit(True))
    return rows.where(later("one_at") & later("all_at")).drop("one_at", "all_at")


def functions(statements: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Function attributes and execute grants since the last DROP.

    statements: keys, pos, kind (CREATE, ALTER, DROP, GRANT, REVOKE), security_mode, search_path, role. CREATE sets both attributes (a
    null is their default), ALTER the ones it names.
    """
    dropped = statements.where("kind = 'DROP'").groupBy(*keys).agg(F.max("pos").alias("dropped_at"))
    rows = statements.join(dropped, keys, "left").where("dropped_at is null or pos > dropped_at").where("kind <> 'DROP'")
    made = rows.where("kind = 'CREATE'").groupBy(*keys).agg(F.max("pos").alias("made_at"))
    own = rows.where("kind in ('CREATE', 'ALTER')").join(made, keys, "left").where("made_at is null or pos >= made_at")
    full = own.withColumn("security_mode", F.when(F.col("kind") == "CREATE", F.coalesce("security_mode", F.lit("INVOKER"))).otherwise(F.col("security_mode"))).withColumn("search_path", F.when(F.col("kind") == "CREATE", F.coalesce("search_path", F.lit("DEFAULT"))).otherwise(F.col("search_path")))
    pick = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("pos"))).alias(c)
    state = full.groupBy(*keys).agg(pick("security_mode"), pick("search_path"), F.max("pos").alias("provenance"))
    moves = rows.where("kind in ('GRANT', 'REVOKE')").select(*keys, "pos", F.col("kind").alias("action"), "role", F.lit("EXECUTE").alias("privilege"))
    return state, grants(moves, keys)


def gaps(statements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Statements that leave the posture uncertain, and each repository's parse state (W6); duplicate positions reject the repository."""
    schemaless = F.lit(False)
    if {"kind", "object_kind"} <= set(statements.columns):  # schemas and sequences are named without one
        schemaless = F.coalesce(F.col("kind") == "CREATE_SCHEMA", F.lit(False)) | F.coalesce(F.col("object_kind").isin("SCHEMA", "SEQUENCE"), F.lit(False))
    unnamed = F.col("object_schema").isNull() & F.col("outcome").eqNullSafe("SUPPORTED") & ~schemaless
    reason = F.when(F.col("outcome").isin("UNSUPPORTED", "MALFORMED", "SCAN_REJECTED"), F.col("outcome")).when(unnamed, F.lit("UNQUALIFIED_NAME"))
    rows = statements.withColumn("gap", reason)
    states = rows.groupBy("repo_id").agg(F.count("gap").alias("gaps"), (F.countDistinct("pos") < F.count("*")).alias("ambiguous"))
    state = F.when(F.col("ambiguous"), "REJECTED").when(F.col("gaps") > 0, "PARTIAL").otherwise("COVERED")
    return rows.where("gap is not null"), states.select("repo_id", "gaps", state.alias("state"))


def ambiguous_orders(migrations: DataFrame) -> DataFrame:
    """Repositories that use an order key twice."""
    return migrations.groupBy("repo_id", "order_key").count().where("count > 1").select("repo_id").distinct()


def _moves(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Grants and revokes as one row per role and privilege; revoking ALL among others is revoking ALL."""
    listed = F.when((F.col("kind") == "REVOKE") & F.array_contains("privileges", "ALL"), F.array(F.lit("ALL"))).otherwise(F.col("privileges"))
    rows = rows.where("kind in ('GRANT', 'REVOKE')").select(*keys, "pos", F.col("kind").alias("action"), "roles", listed.alias("listed"))
    return rows.withColumn("role", F.explode("roles")).withColumn("privilege", F.explode("listed")).drop("roles", "listed")


def reduce_posture(migrations: DataFrame) -> dict[str, DataFrame]:
    """The posture that migration files (repo_id, path, content) leave: W2 to W6 composed over S9 and S10.

    repositories (state COVERED, PARTIAL where any gap is left, or REJECTED for an order key used twice, which has no other rows), gaps,
    schemas, relations, policies, policy_removals, functions, function_grants, grants, generic_grants (schemas and sequences); and statements, from which
    ``located`` gives a fact's place.
    """
    # Read and parsed once: each of the folds reads what is kept.
    known = cut_lineage(migration_repositories(migrations))
    statements = cut_lineage(extract_ddl(discover_migrations(migrations)[0])).withColumn("pos", position(F.col("migration_order"), F.col("statement_index")))
    gap_rows, states = gaps(statements)
    rejects = known.where("ambiguous").select("repo_id", F.lit(0).cast("long").alias("gaps"), F.lit("REJECTED").alias("state"))
    empty = known.where("not ambiguous").join(states.select("repo_id"), "repo_id", "left_anti").select("repo_id", F.lit(0).cast("long").alias("gaps"), F.lit("COVERED").alias("state"))
    keys = ["repo_id", "object_schema", "object_name"]
    good = statements.where("outcome = 'SUPPORTED'")
    schemas = good.where("kind = 'CREATE_SCHEMA'").groupBy("repo_id", F.col("object_name").alias("schema_name")).agg(F.max("pos").alias("provenance"))
    generic = _moves(good.where("object_kind in ('SCHEMA', 'SEQUENCE')"), ["repo_id", "object_kind", "object_schema", "object_name"])
    named = good.where("object_schema is not null")

    changes = named.where(F.col("kind").isin("CREATE_POLICY", "ALTER_POLICY", "DROP_POLICY")).withColumn("kind", F.substring_index("kind", "_", 1))
    made = F.col("kind") == "CREATE"  # what ALTER doesn't name stays
    changes = changes.withColumns({"roles": F.when(made | (F.size("roles") > 0), F.col("roles")), **{c: F.when(made | F.col(c), F.col(c)) for c in ("has_using", "has_with_check")}})
    policy_keys = [*keys, "policy_name"]
    all_policies = policies(changes, policy_keys)
    removed = all_policies.where("status in ('DROPPED', 'ALTERED_AFTER_DROP')").select(*policy_keys).join(removals(changes, policy_keys), policy_keys)
    live = all_policies.where("status <> 'DROPPED'")

    relation = F.when(F.col("kind") == "CREATE_VIEW", "VIEW").when(F.col("kind").isin("CREATE_TABLE", "ENABLE_RLS", "DISABLE_RLS") | F.col("kind").contains("POLICY") | (F.col("object_kind") == "TABLE"), "TABLE")
    touched = named.withColumn("relation_kind", relation).where("relation_kind is not null")
    rls = F.when(F.col("kind") == "ENABLE_RLS", "ENABLED").when(F.col("kind") == "DISABLE_RLS", "DISABLED")
    view = F.when(F.col("kind") == "CREATE_VIEW", F.coalesce(F.when(F.col("security_invoker"), "ENABLED").when(~F.col("security_invoker"), "DISABLED"), F.lit("UNKNOWN")))
    last = lambda c: F.coalesce(F.max_by(c, F.when(c.isNotNull(), F.col("pos"))), F.lit("UNKNOWN"))
    relations = touched.groupBy(*keys, "relation_kind").agg(F.bool_or(F.col("kind").isin("CREATE_TABLE", "CREATE_VIEW")).alias("created"), last(rls).alias("rls_state"), last(view).alias("view_security_invoker"), F.max("pos").alias("last_security_change"))
    n = live.groupBy(*keys).agg(F.count("*").alias("n_policies")).withColumn("relation_kind", F.lit("TABLE"))
    relations = relations.join(n, [*keys, "relation_kind"], "left").withColumn("n_policies", F.coalesce("n_policies", F.lit(0)))

    own = named.where(F.col("kind").isin("CREATE_FUNCTION", "ALTER_FUNCTION", "DROP_FUNCTION") | (F.col("object_kind") == "FUNCTION")).withColumn("kind", F.substring_index("kind", "_", 1))
    executes = F.col("kind").isin("CREATE", "ALTER", "DROP") | F.arrays_overlap("privileges", F.array(F.lit("EXECUTE"), F.lit("ALL")))
    attributes, execute = functions(own.where(executes).withColumn("role", F.explode_outer("roles")), keys)
    dropped = own.where("kind = 'DROP'").groupBy(*keys).agg(F.max("pos").alias("dropped_at"))
    known = own.join(dropped, keys, "left").where("dropped_at is null or pos > dropped_at").groupBy(*keys).agg(F.bool_or(F.col("kind") == "CREATE").alias("created"), F.max("pos").alias("last_change"))
    return {
        "repositories": states.unionByName(rejects).unionByName(empty), "gaps": gap_rows, "schemas": schemas, "relations": relations, "policies": live, "policy_removals": removed,
        "functions": known.join(attributes.drop("provenance"), keys, "left"), "function_grants": execute.drop("privilege"),
        "statements": statements,
        "grants": grants(_moves(named.where("object_kind = 'TABLE'"), keys), keys), "generic_grants": grants(generic.withColumn("object_schema", F.coalesce("object_schema", F.lit(""))), ["repo_id", "object_kind", "object_schema", "object_name"]),
    }


def located(facts: DataFrame, statements: DataFrame, at: str = "provenance") -> DataFrame:
    """Facts with where they come from: path, statement_index, start_byte, end_byte and content_digest of the statement at position ``at``."""
    place = statements.select(F.col("repo_id").alias("repo_of"), F.col("pos").alias("pos_of"), "path", "statement_index", "start_byte", "end_byte", "content_digest")
    return facts.join(place, (F.col("repo_id") == F.col("repo_of")) & (F.col(at) == F.col("pos_of")), "left").drop("repo_of", "pos_of")


# --- observers -------------------------------------------------------------------------------------------------------


def exposed(objects: DataFrame, config: DataFrame) -> DataFrame:
    """Objects with exposure EXPOSED, HIDDEN or UNKNOWN by their repository's API schemas (api_enabled, schemas, parse_coverage)."""
    rows = objects.join(config, "repo_id", "left")
    unknown = F.col("api_enabled").isNull() | (F.col("parse_coverage") != "COVERED")
    exposure = F.when(unknown, "UNKNOWN").when(F.col("api_enabled") & F.array_contains("schemas", F.col("object_schema")), "EXPOSED").otherwise("HIDDEN")
    return rows.withColumn("exposure", exposure).drop("api_enabled", "schemas", "parse_coverage")


def row_security(relations: DataFrame, config: DataFrame) -> DataFrame:
    """Tables that the API shows or may show, with their row-level security state (J8). relations: repo_id, object_schema, object_name, rls_enabled."""
    state = F.when(F.col("rls_enabled").isNull(), "UNKNOWN").when(F.col("rls_enabled"), "ENABLED").otherwise("DISABLED")
    return exposed(relations, config).where("exposure <> 'HIDDEN'").withColumn("row_security", state)


def api_grants(in_force: DataFrame, config: DataFrame) -> DataFrame:
    """Grants to API roles on exposed tables (J9); an ALL that a later partial revoke touches becomes a coverage gap."""
    rows = exposed(in_force.where(F.col("role").isin(*API_ROLES)), config).where("exposure = 'EXPOSED'")
    gap = (F.col("privilege") == "ALL") & F.coalesce(F.col("revoked_at") > F.col("granted_at"), F.lit(False))
    return rows.withColumn("output", F.when(gap, "COVERAGE_GAP").otherwise("EVIDENCE"))


def api_schemas(config: DataFrame, most: int = 128) -> DataFrame:
    """One row for the API and one per schema it shows (J10); too many schemas is a diagnostic."""
    over = F.size("schemas") > most
    api = config.select("repo_id", F.lit("API").alias("kind"), F.when(F.col("api_enabled"), "ENABLED").otherwise("DISABLED").alias("name"))
    rows = config.where(F.col("api_enabled") & ~over).select("repo_id", F.lit("SCHEMA").alias("kind"), F.explode("schemas").alias("name"))
    return api.unionByName(rows).unionByName(config.where(F.col("api_enabled") & over).select("repo_id", F.lit("DIAGNOSTIC").alias("kind"), F.lit("TOO_MANY_SCHEMAS").alias("name")))


def function_authority(state: DataFrame, execute: DataFrame, config: DataFrame) -> DataFrame:
    """Facts of functions, each only where its own statement is known."""
    keys = ["repo_id", "object_schema", "object_name"]
    fact = lambda df, name, value: df.select(*keys, F.lit(name).alias("fact"), value.cast("string").alias("value"))
    shown = exposed(state, config)
    return (
        fact(state.where("security_mode is not null"), "SECURITY_MODE", F.col("security_mode")).unionByName(fact(state.where("search_path is not null"), "SEARCH_PATH", F.col("search_path")))
        .unionByName(fact(shown.where("exposure <> 'UNKNOWN'"), "EXPOSURE", F.col("exposure"))).unionByName(fact(execute, "EXECUTE_GRANT", F.col("role")))
    )


def policy_posture(live: DataFrame) -> DataFrame:
    """One row per policy whose state is certain."""
    return live.where("status = 'LIVE'").select("repo_id", "object_schema", "object_name", "policy_name", "command", F.array_join(F.array_sort("roles"), ",").alias("roles"), "has_using", "has_with_check")


def storage_posture(relations: DataFrame, live: DataFrame) -> DataFrame:
    """Relations and policies of the storage schema."""
    r = relations.where("object_schema = 'storage'").select("repo_id", "object_name", F.lit("RELATION").alias("kind"), F.lit(None).cast("string").alias("policy_name"))
    return r.unionByName(live.where("object_schema = 'storage' and status = 'LIVE'").select("repo_id", "object_name", F.lit("POLICY").alias("kind"), "policy_name"))


def edge_auth_matrix(config: DataFrame, sources: DataFrame) -> DataFrame:
    """(repo_id, function, token_check, source_check) of every edge function that configuration or source has.

    config: repo_id, function, verify_jwt; sources: repo_id, function, line. A source proves its check by a call that verifies a token.
    """
    proof = F.bool_or(F.col("line").rlike(r"\b(jwtVerify|verifyToken|auth\.getUser|getClaims)\s*\("))
    dynamic = F.bool_or(F.col("line").rlike(r"\bimport\s*\("))
    seen = sources.groupBy("repo_id", "function").agg(F.when(proof, "PROVEN").when(dynamic, "UNKNOWN").otherwise("NOT_PROVEN").alias("source_check"))
    rows = config.join(seen, ["repo_id", "function"], "full_outer")
    flag = F.when(F.col("verify_jwt").isNull(), "UNKNOWN").when(F.col("verify_jwt"), "ENABLED").otherwise("DISABLED")
    return rows.select("repo_id", "function", flag.alias("token_check"), F.coalesce("source_check", F.lit("UNKNOWN")).alias("source_check"))


def edge_auth(config: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edge functions whose token check is off and whose source doesn't prove one (J15), and coverage."""
    rows = edge_auth_matrix(config, sources)
    coverage = rows.select("repo_id", "function", F.when((F.col("token_check") == "UNKNOWN") | (F.col("source_check") == "UNKNOWN"), "PARTIAL").otherwise("COVERED").alias("state"))
    return rows.where("token_check = 'DISABLED' and source_check = 'NOT_PROVEN'"), coverage


def config_coverage(repos: DataFrame, config: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Coverage of API and auth configuration."""
    n = diagnostics.groupBy("repo_id").agg(F.count("*").alias("n"))
    rows = repos.join(config.select("repo_id", F.lit(True).alias("has")), "repo_id", "left").join(n, "repo_id", "left")
    return rows.select("repo_id", F.when(F.col("has").isNull(), "UNAVAILABLE").when(F.col("n") > 0, "PARTIAL").otherwise("COVERED").alias("state"), F.coalesce("n", F.lit(0)).alias("diagnostics"))


def admit_outputs(outputs: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Provider outputs by producer prefix, capability and unique id (V17). mapping: producer_prefix, capability, dimension."""
    w = Window.partitionBy("evidence_id")
    rows = outputs.withColumn("k", F.count("*").over(w)).join(mapping, "capability", "left")
    bad = F.when(F.col("dimension").isNull(), "UNKNOWN_CAPABILITY").when(F.col("producer_kind") != "STATIC_RULE", "PRODUCER_KIND").when(~F.col("producer_id").startswith(F.col("producer_prefix")), "PRODUCER_PREFIX").when(F.col("k") > 1, "DUPLICATE_ID")
    rows = rows.withColumn("reject_reason", bad).drop("k", "producer_prefix")
    return rows.where("reject_reason is null").drop("reject_reason"), rows.where("reject_reason is not null")


def position(order: Column, index: Column) -> Column:
    return F.struct(order.alias("migration_order"), index.alias("statement_index"))
