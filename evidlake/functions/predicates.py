"""Contract checks as columns: each ``*_reason`` is null for an admissible row, else the first rule that it breaks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vocabularies of the data model.
CLASSES = ("FACT", "INFERENCE", "HYPOTHESIS", "OBSERVATION", "CONTRADICTION")
COVERAGE_STATES = ("COVERED", "PARTIAL", "SKIPPED", "UNSUPPORTED", "UNAVAILABLE", "TIMED_OUT", "FAILED")
DIMENSIONS = ("DETECTION", "STATIC_POSTURE", "LIVE_POSTURE", "DYNAMIC_VERIFICATION", "REMEDIATION")
WORKFLOW = ("NEW", "TRIAGED", "IN_PROGRESS", "ACCEPTED_RISK", "FIX_PROPOSED", "FIX_VERIFIED", "CLOSED")
TRANSITIONS = (("NEW", "TRIAGED"), ("NEW", "ACCEPTED_RISK"), ("NEW", "CLOSED"), ("TRIAGED", "IN_PROGRESS"), ("TRIAGED", "ACCEPTED_RISK"), ("TRIAGED", "CLOSED"), ("TRIAGED", "NEW"), ("IN_PROGRESS", "FIX_PROPOSED"), ("IN_PROGRESS", "ACCEPTED_RISK"), ("IN_PROGRESS", "TRIAGED"), ("FIX_PROPOSED", "IN_PROGRESS"), ("FIX_PROPOSED", "CLOSED"), ("ACCEPTED_RISK", "TRIAGED"), ("ACCEPTED_RISK", "NEW"), ("CLOSED", "NEW"))
PATH_BYTES = 4096


def first_reason(*rules: tuple[Column, str]) -> Column:
    """The name of the first rule whose condition holds; an undecided condition counts as broken."""
    return F.coalesce(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for bad, name in rules])


def split(df: DataFrame, reason: Column, name: str = "reject_reason") -> tuple[DataFrame, DataFrame]:
    """Admitted rows, and rejected rows with their reason."""
    marked = df.withColumn(name, reason)
    return marked.where(F.col(name).isNull()).drop(name), marked.where(F.col(name).isNotNull())


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def path_reason(path: Column) -> Column:
    parts = F.split(path, "/")
    return first_reason(
        (blank(path), "BLANK"), (path != F.trim(path), "PADDED"), (F.octet_length(path) > PATH_BYTES, "TOO_LONG"), (path.startswith("/"), "ABSOLUTE"),
        (path.rlike(r"^[A-Za-z]:"), "DRIVE"), (path.contains("\\"), "BACKSLASH"), (path.rlike(r"[\x00-\x1F\x7F]"), "CONTROL"),
        (path.rlike("[⁄∕⧵／＼․．]"), "CONFUSABLE"), (F.exists(parts, lambda p: p.isin("", ".", "..")), "DOT_OR_EMPTY_PART"),
    )


def normalised_tool_path(uri: Column) -> Column:
    """A tool's path relative to the root, percent-decoded; null if it has a scheme or drive, is malformed or leaves the root."""
    step = lambda acc, p: F.when(p.isin("", "."), acc).when((p == "..") & (F.size(acc) == 0), F.array(F.lit("\0"))).when(p == "..", F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(F.concat(acc, F.array(p)))
    plain = lambda c: F.when(~c.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") & ~c.startswith("/") & ~c.contains("\\"), c)
    parts = bound(F.try_url_decode(F.replace(uri, F.lit("+"), F.lit("%2B"))), lambda c: F.aggregate(F.split(plain(c), "/"), F.array().cast("array<string>"), step))
    good = lambda p: bound(F.array_join(p, "/"), lambda path: F.when(path_reason(path).isNull(), path))
    return bound(parts, lambda p: F.when((F.size(p) > 0) & ~F.array_contains(p, "\0"), good(p)))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that Spark works out once a row: each use of a plain column repeats its expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def is_utc_timestamp(text: Column) -> Column:
    shape = text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,9})?Z$")
    return F.coalesce(shape & F.try_to_timestamp(F.substring(text, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")).isNotNull(), F.lit(False))


def is_digest(text: Column) -> Column:
    return F.coalesce(text.rlike("^sha256:[0-9a-f]{64}$"), F.lit(False))


def claim_reason(c: dict[str, Column]) -> Column:
    """Rules of an evidence claim. c: schema_version, observation, interpretation, epistemic_class, producer_kind, verified,
    runtime_test, reproduction_digest, input_digests."""
    return first_reason(
        (c["schema_version"] != "1", "SCHEMA_VERSION"), (blank(c["observation"]), "BLANK_OBSERVATION"), (~c["epistemic_class"].isin(*CLASSES), "UNKNOWN_CLASS"),
        ((c["epistemic_class"] == "FACT") & c["interpretation"].isNotNull(), "FACT_WITH_INTERPRETATION"),
        ((c["producer_kind"] == "LLM") & ~c["epistemic_class"].isin("INFERENCE", "HYPOTHESIS"), "MODEL_CLAIMS_TOO_MUCH"),
        (F.coalesce(c["verified"], F.lit(False)), "VERIFIED_CLAIM"), ((c["epistemic_class"] == "OBSERVATION") != F.coalesce(c["runtime_test"], F.lit(False)), "OBSERVATION_WITHOUT_TEST"),
        (c["reproduction_digest"].isNotNull() & ~F.array_contains(F.coalesce(c["input_digests"], F.array().cast("array<string>")), c["reproduction_digest"]), "DIGEST_NOT_AN_INPUT"),
    )


def attribute_reason(attributes: Column, most: int = 64, key_bytes: int = 128, value_bytes: int = 4096, all_bytes: int = 65536, depth: int = 8) -> Column:
    """Bounds of map<string, JSON fragment>."""
    values, keys = F.map_values(attributes), F.map_keys(attributes)
    total = F.aggregate(F.concat(keys, values), F.lit(0), lambda a, v: a + F.coalesce(F.octet_length(v), F.lit(0)))
    deep = lambda v: F.aggregate(F.regexp_extract_all(F.regexp_replace(v, r'"(?:[^"\\]|\\.)*"', ""), F.lit(r"[\[{\]}]"), F.lit(0)), F.struct(F.lit(0).alias("at"), F.lit(0).alias("most")), lambda s, ch: F.struct((s["at"] + F.when(ch.isin("[", "{"), 1).otherwise(-1)).alias("at"), F.greatest(s["most"], s["at"] + F.when(ch.isin("[", "{"), 1).otherwise(-1)).alias("most")))["most"]
    return F.when(attributes.isNotNull(), first_reason(
        (F.size(attributes) > most, "TOO_MANY"), (F.exists(keys, lambda k: F.octet_length(k) > key_bytes), "KEY_TOO_LONG"), (F.exists(values, lambda v: F.coalesce(F.octet_length(v), F.lit(0)) > value_bytes), "VALUE_TOO_LONG"),
        (total > all_bytes, "TOO_LARGE"), (F.exists(values, lambda v: F.coalesce(deep(v), F.lit(0)) > depth), "TOO_DEEP"),
    ))


def repeats(a: Column) -> Column:
    return F.size(F.array_distinct(a)) != F.size(a)


def pack_reason(pack_id: Column, version: Column, capabilities: Column, dimensions: Column) -> Column:
    return first_reason((blank(pack_id), "BLANK_ID"), (blank(version), "BLANK_VERSION"), (F.size(capabilities) == 0, "NO_CAPABILITY"), (repeats(capabilities), "REPEATED_CAPABILITY"), (F.exists(capabilities, blank), "BLANK_CAPABILITY"), (repeats(dimensions), "REPEATED_DIMENSION"), (F.size(F.array_except(dimensions, F.array(*map(F.lit, DIMENSIONS)))) > 0, "UNKNOWN_DIMENSION"))


def risk_reason(reason: Column, author: Column, created: Column, expires: Column, authorization: Column, wanted: Column, now: Column) -> Column:
    """Accepted risk over epoch seconds."""
    return first_reason((blank(reason), "BLANK_REASON"), (blank(author), "BLANK_AUTHOR"), (created > now, "CREATED_LATER"), (expires < created, "EXPIRES_FIRST"), (expires <= now, "EXPIRED"), (~authorization.eqNullSafe(wanted), "OTHER_AUTHORIZATION"))


def invariant_reason(invariant: Column, keys: Column, allowed: tuple[str, ...], forbidden: tuple[str, ...], id_bytes: int = 64, most: int = 32) -> Column:
    """Project-declared invariants: their id and the keys they set."""
    return first_reason((~invariant.rlike("^[a-z0-9][a-z0-9_-]*$"), "BAD_ID"), (F.octet_length(invariant) > id_bytes, "ID_TOO_LONG"), (F.size(keys) > most, "TOO_MANY_KEYS"), (repeats(keys), "REPEATED_KEY"), (F.arrays_overlap(keys, F.array(*map(F.lit, forbidden))), "AUTHORITY_KEY"), (F.size(F.array_except(keys, F.array(*map(F.lit, allowed)))) > 0, "UNKNOWN_KEY"))


def coverage_flags(state: Column, dimension: Column) -> dict[str, Column]:
    return {"complete": F.coalesce(state == "COVERED", F.lit(False)), "gap": F.coalesce(state != "COVERED", F.lit(True)), "supports_posture": F.coalesce((dimension != "DETECTION") & (state == "COVERED"), F.lit(False))}
