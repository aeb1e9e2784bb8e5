"""Invariants evaluated on paths: SATISFIED, VIOLATED, UNKNOWN or NOT_APPLICABLE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TIGHT = ("VIOLATED", "UNKNOWN", "SATISFIED", "NOT_APPLICABLE")


def in_scope(invariants: DataFrame, paths: DataFrame) -> DataFrame:
    """Invariants joined with the paths of their repository; ``applies`` by scope, where an empty list means any.

    Scope arrays: routes, methods, resources, kinds, target_paths. Paths: path_id, route_pattern, method, resource, kind.
    """
    rows = invariants.join(paths, "repo_id")
    fits = lambda scope, c: (F.size(scope) == 0) | F.array_contains(scope, F.col(c).cast("string"))
    return rows.withColumn("applies", F.coalesce(fits("routes", "route_pattern") & fits("methods", "method") & fits("resources", "resource") & fits("kinds", "kind") & fits("target_paths", "path_id"), F.lit(False)))


def _state(applies: Column, *cases: tuple[Column, str], default: str) -> Column:
    out = F.when(~applies, "NOT_APPLICABLE")
    for condition, name in cases:
        out = out.when(F.coalesce(condition, F.lit(False)), name)
    return out.otherwise(default)


def tenant_binding(scoped: DataFrame, filters: DataFrame, values: DataFrame, actors: DataFrame) -> DataFrame:
    """(invariant_id, path_id, state): the operation filters on the tenant field by a value of a trusted actor.

    scoped: also identity, field, operation_id; filters: operation_id, field, operator, value_origin; values: value_id, source_actor; actors: actor_id,
    identity_kind, source_kind, trust_basis. UNKNOWN beats VIOLATED beats SATISFIED over several filters.
    """
    trusted = actors.where(F.col("source_kind").isin("VERIFIED_ADAPTER", "TOKEN_CLAIM", "DERIVED") & (F.col("trust_basis") != "UNKNOWN")).select("actor_id", "identity_kind")
    bound = values.join(trusted, values["source_actor"] == trusted["actor_id"], "left").select("value_id", F.col("identity_kind").alias("bound_to"))
    used = filters.join(bound, filters["value_origin"] == bound["value_id"], "left").select(F.col("operation_id").alias("op"), F.col("field").alias("f"), "operator", "bound_to", F.lit(True).alias("has"))
    rows = scoped.join(used, (scoped["operation_id"] == used["op"]) & (scoped["field"] == used["f"]), "left")
    one = F.when(F.col("has").isNull(), "VIOLATED").when(~F.col("operator").isin("EQ", "IN") | F.col("bound_to").isNull(), "UNKNOWN").when(F.col("bound_to") == F.col("identity"), "SATISFIED").otherwise("VIOLATED")
    sums = rows.withColumn("one", one).groupBy("invariant_id", "path_id", "applies", "identity").agg(F.bool_or(F.col("one") == "UNKNOWN").alias("u"), F.bool_or(F.col("one") == "VIOLATED").alias("v"))
    state = _state(F.col("applies"), (~F.col("identity").isin("USER", "TENANT"), "UNKNOWN"), (F.col("u"), "UNKNOWN"), (F.col("v"), "VIOLATED"), default="SATISFIED")
    return sums.select("invariant_id", "path_id", state.alias("state"))


def _guards_covered(rows: DataFrame) -> Column:
    """Whether guards of the path were looked for throughout; rows without ``guard_coverage`` are taken as covered."""
    return F.col("guard_coverage").eqNullSafe("COVERED") if "guard_coverage" in rows.columns else F.lit(True)


def required_role(scoped: DataFrame, guards: DataFrame) -> DataFrame:
    """A role guard on the path allows only required roles on its resource (I2). scoped: also roles, resource and, if known, guard_coverage; guards: path_id, guard_id,
    guard_kind, guard_resource, values, resolved. Where guards weren't looked for throughout, the state is UNKNOWN."""
    rows = scoped.withColumn("covered", _guards_covered(scoped)).join(guards.where("guard_kind = 'ROLE'"), "path_id", "left")
    here = F.col("guard_id").isNotNull() & (F.col("guard_resource").isNull() | (F.col("guard_resource") == F.col("resource")))
    good = here & F.col("resolved") & F.arrays_overlap("roles", "values")
    sums = rows.groupBy("invariant_id", "path_id", "applies", "covered").agg(F.bool_or(F.coalesce(good, F.lit(False))).alias("good"), F.bool_or(F.coalesce(here & ~F.col("resolved"), F.lit(False))).alias("open"), F.min(F.when(good, F.col("guard_id"))).alias("supporting_guard"))
    state = _state(F.col("applies"), (~F.col("covered"), "UNKNOWN"), (F.col("good"), "SATISFIED"), (F.col("open"), "UNKNOWN"), default="VIOLATED")
    return sums.select("invariant_id", "path_id", state.alias("state"), F.when(F.col("covered"), F.col("supporting_guard")).alias("supporting_guard"))


def protected_properties(scoped: DataFrame) -> DataFrame:
    """No write sets a protected property (I3). scoped: also protected, mutation_mode, mutation_fields."""
    mode = F.col("mutation_mode")
    state = _state(F.col("applies"), (mode == "REQUEST_OBJECT", "VIOLATED"), ((mode == "EXPLICIT") & F.arrays_overlap("protected", "mutation_fields"), "VIOLATED"), ((mode == "EXPLICIT") & F.col("mutation_fields").isNotNull(), "SATISFIED"), default="UNKNOWN")
    return scoped.select("invariant_id", "path_id", state.alias("state"))


def _support(supported: DataFrame) -> DataFrame:
    """(client_id, exact) of each client whose static support was worked out; exact unless a row says that its boundary isn't the client's."""
    exact = F.bool_or(F.col("exact")) if "exact" in supported.columns else F.lit(True)
    return supported.groupBy("client_id").agg(F.coalesce(exact, F.lit(False)).alias("exact"))


def elevated_client(scoped: DataFrame, supported: DataFrame) -> DataFrame:
    """An elevated client runs on a server with exact static support and the required guard (I4). scoped: also client_id, authority, context, has_guard and, if known,
    guard_coverage; supported: client_id and, if known, exact."""
    rows = scoped.withColumn("covered", _guards_covered(scoped)).join(_support(supported), "client_id", "left")
    known = F.coalesce("exact", F.lit(False))
    state = _state(F.col("applies"), (F.col("authority") == "STANDARD", "NOT_APPLICABLE"), (F.col("authority") != "ELEVATED", "UNKNOWN"), (~F.col("covered") | ~known, "UNKNOWN"), (~F.col("context").isin("SERVER", "EDGE"), "VIOLATED"), (~F.col("has_guard"), "VIOLATED"), default="SATISFIED")
    return rows.select("invariant_id", "path_id", state.alias("state"))


def project_states(declared: DataFrame, paths: DataFrame, filters: DataFrame, values: DataFrame, actors: DataFrame, guards: DataFrame, supported: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Project-declared invariants on paths: (invariant_id, path_id, state) by the evaluation of each one's kind, and rejects with a reason.

    declared: repo_id, invariant_id, source, invariant_kind and the scope arrays; paths as for I0 to I4. Only declarations are
    evaluated here; where a client is needed, a path without one is a reject, and so is one whose client's static support was never worked out. The states
    tighten built-in ones by ``tightened``.
    """
    kinds = ("TENANT_BINDING", "REQUIRED_ROLE", "PROTECTED_PROPERTIES", "ELEVATED_CLIENT_CONTEXT")
    reason = F.when(F.col("source") != "PROJECT_DECLARATION", "NOT_PROJECT_DECLARATION").when(~F.col("invariant_kind").isin(*kinds), "UNKNOWN_KIND")
    admitted = in_scope(declared.where(F.coalesce(reason.isNull(), F.lit(False))), paths)
    worked_out = supported.select(F.col("client_id").alias("client_of"), F.lit(True).alias("worked_out")).distinct()
    admitted = admitted.join(worked_out, F.col("client_id") == F.col("client_of"), "left").drop("client_of")
    lacks = F.when(F.col("invariant_kind") == "ELEVATED_CLIENT_CONTEXT", F.when(F.col("client_id").isNull(), "MISSING_PROVIDER_CLIENT").when(F.col("worked_out").isNull(), "MISSING_STATIC_SUPPORT"))
    admitted = admitted.withColumn("lacks", lacks).drop("worked_out")
    of = lambda kind: admitted.where((F.col("invariant_kind") == kind) & F.col("lacks").isNull())
    found = [tenant_binding(of(kinds[0]), filters, values, actors), required_role(of(kinds[1]), guards).drop("supporting_guard"), protected_properties(of(kinds[2])), elevated_client(of(kinds[3]), supported)]
    states = found[0]
    for f in found[1:]:
        states = states.unionByName(f)
    rejects = declared.withColumn("reject_reason", reason).where("reject_reason is not null").select("invariant_id", F.lit(None).cast(paths.schema["path_id"].dataType).alias("path_id"), "reject_reason")
    return states, rejects.unionByName(admitted.where("lacks is not null").select("invariant_id", "path_id", F.col("lacks").alias("reject_reason")))


def tightened(*evaluations: DataFrame) -> DataFrame:
    """The tightest of built-in and project states per invariant and path."""
    rows = evaluations[0].select("invariant_id", "path_id", "state")
    for e in evaluations[1:]:
        rows = rows.unionByName(e.select("invariant_id", "path_id", "state"))
    return rows.groupBy("invariant_id", "path_id").agg(F.min_by("state", F.array_position(F.array(*map(F.lit, TIGHT)), F.col("state"))).alias("state"))
