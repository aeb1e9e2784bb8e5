"""Canonical text and content-derived ids.

An id is ``sha256:`` and the digest of domain, namespace and canonical JSON, parted by NUL. Canonical JSON has its keys in
alphabetical order, explicit nulls, no white space, and array order as given; maps are sorted by key first. Floating point values
have no place in it, as their text isn't stable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOMAIN = "evidlake.v1"


def sorted_map(m: Column) -> Column:
    return F.map_from_entries(F.array_sort(F.map_entries(m)))


def canonical(fields: dict[str, Column]) -> Column:
    """Canonical JSON of named columns."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def digest_of(namespace: str, text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(F.lit(f"{DOMAIN}\0{namespace}\0"), text), 256))


def content_id(namespace: str, fields: dict[str, Column]) -> Column:
    return digest_of(namespace, canonical(fields))


def semantic_id(namespace: str, *parts: Column, longest: int = 4096) -> Column:
    """Id of ordered parts; null if a part is null, blank or too long."""
    every = F.array(*parts)
    bad = F.exists(every, lambda p: p.isNull() | (F.trim(p) == "") | (F.octet_length(p) > longest))
    return F.when(~bad, digest_of(namespace, F.to_json(every)))


def node_id(kind: Column, key: Column) -> Column:
    return content_id("graph.node", {"kind": kind, "key": key})


def edge_id(source: Column, relation: Column, target: Column) -> Column:
    return content_id("graph.edge", {"source": source, "relation": relation, "target": target})


def finding_id(fingerprint: Column, category: Column) -> Column:
    return content_id("finding", {"fingerprint": fingerprint, "category": category})


def action_digest(kind: Column, target: Column, params: Column) -> Column:
    """target: map<string, string>; its order doesn't matter."""
    return content_id("action", {"kind": kind, "target": sorted_map(target), "params": params})


def float_fields(df: DataFrame) -> list[str]:
    """Paths of floating point or decimal fields, which identity payloads must not have."""

    def walk(kind: T.DataType, at: str) -> list[str]:
        if isinstance(kind, T.FloatType | T.DoubleType | T.DecimalType):
            return [at]
        if isinstance(kind, T.StructType):
            return [p for f in kind.fields for p in walk(f.dataType, f"{at}.{f.name}" if at else f.name)]
        if isinstance(kind, T.ArrayType):
            return walk(kind.elementType, f"{at}[]")
        if isinstance(kind, T.MapType):
            return walk(kind.keyType, f"{at}.key") + walk(kind.valueType, f"{at}.value")
        return []

    return walk(df.schema, "")


def has_float(fragment: Column) -> Column:
    """Whether a JSON fragment holds a number with a fraction or an exponent outside its strings."""
    bare = F.regexp_replace(fragment, r'"(?:[^"\\]|\\.)*"', '""')
    return F.coalesce(bare.rlike(r"[0-9][.eE]"), F.lit(False))


def recheck(df: DataFrame, id_column: str, recomputed: Column) -> DataFrame:
    """Rows whose stored id isn't the one their content gives."""
    return df.where(~F.col(id_column).eqNullSafe(recomputed))
