"""Secret scans, in DataFrame functions only.

Base kinds are patterns: ``assign`` (a named value of 8 or more characters), ``access`` (key ids), ``hex`` (32 or more digits).
Matches are leftmost and non-overlapping per kind; those too short are dropped after matching. Positions come from the
lengths of the pieces between matches, in code points.

``entropy`` spans: candidate strings are runs of key characters of at least WINDOW. A window slides over each; its Shannon
entropy follows from the sum of c*log2(c) over symbol counts, which entering and leaving symbols change by one each. The
span reaches from the first to the last window at or over the threshold of the string's character class. Candidates
without both a letter and a digit, or that match the allow-list, give none.

Defined cases: null and empty texts have no spans; texts of any length are scanned whole; spans of one start are listed in the order of KINDS, so ties
have one order; equal rows give equal results; an empty table gives an empty result; other columns, of any name, aren't read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The patterns of the base kinds (with the digits counted in for access and hex) and least lengths.
ASSIGN = r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN_LEAST = 8

WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{%d,}" % WINDOW
#: Bits per symbol a window must reach, by class of the candidate's characters.
THRESHOLDS = (("hex", r"^(?:[0-9a-f]+|[0-9A-F]+)$", 3.0), ("alphanumeric", r"^[A-Za-z0-9]+$", 3.7), ("encoded", r"^[A-Za-z0-9+/_=-]+$", 3.8))
#: Strings that look random but are known not to be secret.
ALLOWED = r"(?i)(example|sample|placeholder|changeme|dummy|redacted|xxxx|0123456789|123456789|abcdefgh|deadbeef|lorem)"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"


def _at(found: Column, pieces: Column) -> Column:
    """array<struct<start, end>> of the matches, from the pieces around them."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["piece"])
        end = start + F.length(pair["match"])
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(F.struct(start.alias("start"), end.alias("end")))).alias("spans"))

    pairs = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, lambda p, m: F.struct(p.alias("piece"), m.alias("match")))
    return F.aggregate(pairs, zero, step, lambda acc: acc["spans"])


def _spans(text: Column, found: Column, pattern: str) -> Column:
    none = F.array().cast("array<struct<start:int,end:int>>")
    return F.when(F.size(found) > 0, _at(found, F.split(text, pattern, -1))).otherwise(none)


def entropy_extent(string: Column, threshold: Column) -> Column:
    """struct<start, end> of the windows of ``string`` at or over ``threshold``; start is null if there is none."""
    weight = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 1)])
    f = lambda c: F.get(weight, c)
    codes = F.transform(F.split(string, "", -1), lambda ch: F.instr(F.lit(ALPHABET), ch))
    start = F.struct(
        F.array_repeat(F.lit(0), len(ALPHABET) + 1).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("held"),
        F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"),
    )

    def step(acc: Column, code: Column) -> Column:
        full = acc["i"] >= WINDOW
        gone = F.when(full, F.get(acc["held"], F.lit(0))).otherwise(F.lit(-1))
        had, lost = F.get(acc["counts"], code), F.get(acc["counts"], gone)
        change = F.when(code == gone, 0.0).otherwise(f(had + 1) - f(had) + F.when(full, f(lost - 1) - f(lost)).otherwise(0.0))
        total = acc["sum"] + change
        counts = F.transform(acc["counts"], lambda c, k: c + (k == code).cast("int") - (k == gone).cast("int"))
        held = F.concat(F.when(full, F.slice(acc["held"], 2, WINDOW)).otherwise(acc["held"]), F.array(code))
        high = (acc["i"] >= WINDOW - 1) & (math.log2(WINDOW) - total / WINDOW >= threshold)
        return F.struct(
            counts.alias("counts"), total.alias("sum"), (acc["i"] + 1).alias("i"), held.alias("held"),
            F.when(acc["first"].isNull() & high, acc["i"] - (WINDOW - 1)).otherwise(acc["first"]).alias("first"),
            F.when(high, acc["i"] + 1).otherwise(acc["last"]).alias("last"),
        )

    return F.aggregate(F.filter(codes, lambda c: c > 0), start, step, lambda acc: F.struct(acc["first"].alias("start"), acc["last"].alias("end")))


def _threshold(string: Column) -> Column:
    pick = F.lit(THRESHOLDS[-1][2])
    for _, pattern, bits in reversed(THRESHOLDS[:-1]):
        pick = F.when(string.rlike(pattern), F.lit(bits)).otherwise(pick)
    return pick


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and ``found``: array<struct<start, rank, end>> of all spans by start, then kind (rank in KINDS)."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    every = lambda p, group=0: F.regexp_extract_all("text", F.lit(p), F.lit(group))
    # Texts without a candidate run hold no hex or access match either, as both are runs of 16 or more of its characters.
    run = r"[A-Za-z0-9+/_=-]{16,}"
    none = F.array().cast("array<string>")
    rows = rows.withColumn("runs", F.col("text").rlike(run)).select(
        "doc_id", "text", every(ASSIGN).alias("assign"), F.when(F.col("runs"), every(ACCESS)).otherwise(none).alias("access"),
        F.when(F.col("runs"), every(HEX)).otherwise(none).alias("hex"), F.when(F.col("runs"), every(CANDIDATE)).otherwise(none).alias("candidate"),
    )
    rows = rows.select(
        "doc_id", "candidate", _spans(F.col("text"), F.col("access"), ACCESS).alias("access"), _spans(F.col("text"), F.col("hex"), HEX).alias("hex"),
        F.zip_with(_spans(F.col("text"), F.col("assign"), ASSIGN), F.when(F.size("assign") > 0, every(ASSIGN, 2)).otherwise(none), lambda s, v: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.length(v).alias("n"))).alias("assign"),
        F.when(F.size(F.filter("candidate", _worth)) > 0, _spans(F.col("text"), F.col("candidate"), CANDIDATE)).alias("places"),
    )
    kept = F.filter(F.zip_with("places", "candidate", lambda p, c: F.struct(p["start"].alias("start"), c.alias("string"))), lambda x: _worth(x["string"]))
    extents = F.transform(kept, lambda x: F.struct(x["start"].alias("start"), entropy_extent(x["string"], _threshold(x["string"])).alias("e")))
    high = F.transform(F.filter(extents, lambda x: x["e"]["start"].isNotNull()), lambda x: F.struct((x["start"] + x["e"]["start"]).alias("start"), (x["start"] + x["e"]["end"]).alias("end")))
    ranked = lambda spans, k: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("rank"), s["end"].alias("end")))
    empty = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    entropy = F.when(F.col("places").isNotNull(), ranked(high, 3)).otherwise(empty)
    assign = ranked(F.filter("assign", lambda s: s["n"] >= ASSIGN_LEAST), 0)
    return rows.select("doc_id", F.array_sort(F.concat(assign, ranked(F.col("access"), 1), ranked(F.col("hex"), 2), entropy)).alias("found"))


def _worth(string: Column) -> Column:
    return string.rlike("[0-9]") & string.rlike("[A-Za-z]") & ~string.rlike(ALLOWED)


def spans_text(found: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets_digest(docs: DataFrame) -> DataFrame:
    """Counts and digests of ``scan_secrets`` per document."""
    found = scan_secrets(docs)
    n = lambda k: F.size(F.filter("found", lambda s: s["rank"] == k)).cast("long")
    base = spans_text(F.filter("found", lambda s: s["rank"] < 3))
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(base, 256).alias("base_sha256"), spans_text(F.col("found")).alias("spans"))
