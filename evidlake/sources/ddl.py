"""Schema-change files and API configuration, read as text: literals and comments are masked before statements are parted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIGRATION = r"^(.*/)?supabase/migrations/(\d{14})(_[^/]+)?\.sql$"
NAME = r'((?:"[^"]+"|[a-z_][a-z0-9_$]*)(?:\.(?:"[^"]+"|[a-z_][a-z0-9_$]*))?)'
#: What a pattern's \s takes.
SPACE = " \t\n\x0b\f\r"
#: Limits of one file.
SCAN_BYTES, SCAN_STATEMENTS = 4 * 1024 * 1024, 4096
#: Supported forms by kind, tried in this order; group 1 is the object, or group 1 the policy and group 2 its relation.
FORMS = (
    ("CREATE_POLICY", rf"(?i)^create\s+policy\s+(\"[^\"]+\"|[a-z_][a-z0-9_$]*)\s+on\s+{NAME}"), ("ALTER_POLICY", rf"(?i)^alter\s+policy\s+(\"[^\"]+\"|[a-z_][a-z0-9_$]*)\s+on\s+{NAME}"),
    ("DROP_POLICY", rf"(?i)^drop\s+policy\s+(?:if\s+exists\s+)?(\"[^\"]+\"|[a-z_][a-z0-9_$]*)\s+on\s+{NAME}"), ("CREATE_TABLE", rf"(?i)^create\s+table\s+(?:if\s+not\s+exists\s+)?{NAME}"),
    ("ENABLE_RLS", rf"(?i)^alter\s+table\s+(?:if\s+exists\s+)?(?:only\s+)?{NAME}\s+(?:enable|force)\s+row\s+level\s+security"), ("DISABLE_RLS", rf"(?i)^alter\s+table\s+(?:if\s+exists\s+)?(?:only\s+)?{NAME}\s+disable\s+row\s+level\s+security"),
    ("CREATE_VIEW", rf"(?i)^create\s+(?:or\s+replace\s+)?view\s+{NAME}"), ("CREATE_FUNCTION", rf"(?i)^create\s+(?:or\s+replace\s+)?function\s+{NAME}"), ("ALTER_FUNCTION", rf"(?i)^alter\s+function\s+{NAME}"),
    ("DROP_FUNCTION", rf"(?i)^drop\s+function\s+(?:if\s+exists\s+)?{NAME}"), ("CREATE_SCHEMA", rf"(?i)^create\s+schema\s+(?:if\s+not\s+exists\s+)?{NAME}"),
    ("GRANT", rf"(?i)^grant\s+.+?\s+on\s+(?:table\s+|function\s+|schema\s+|sequence\s+)?(?!all\s){NAME}"), ("REVOKE", rf"(?i)^revoke\s+.+?\s+on\s+(?:table\s+|function\s+|schema\s+|sequence\s+)?(?!all\s){NAME}"),
)
UNSUPPORTED = r"(?i)^(do|call|execute|prepare|set|reset|alter\s+default\s+privileges|create\s+role|alter\s+role|alter\s+policy|create\s+policy|drop\s+policy|grant|revoke|security\s+label)\b"


def _migrations(files: DataFrame) -> DataFrame:
    return files.where(F.col("path").rlike(MIGRATION)).withColumn("order_key", F.regexp_extract("path", MIGRATION, 2))


def migration_repositories(files: DataFrame) -> DataFrame:
    """(repo_id, ambiguous): repositories with migrations, and whether one uses an order key twice."""
    keys = _migrations(files).groupBy("repo_id", "order_key").agg((F.count("*") > 1).alias("twice"))
    return keys.groupBy("repo_id").agg(F.bool_or("twice").alias("ambiguous"))


def discover_migrations(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Migrations in order (repo_id, path, order_key, migration_order), and repositories rejected for using an order key twice."""
    repo = Window.partitionBy("repo_id")
    order = repo.orderBy("order_key")
    again = F.coalesce(F.lag("order_key").over(order) == F.col("order_key"), F.lit(False))
    rows = _migrations(files).withColumns({"migration_order": F.row_number().over(order) - 1, "again": again}).withColumn("ambiguous", F.bool_or("again").over(repo))
    rejects = migration_repositories(files).where("ambiguous").select("repo_id", F.lit("AMBIGUOUS_ORDER").alias("reject_reason"))
    return rows.where(~F.col("ambiguous")).drop("again", "ambiguous"), rejects


#: Comments, dollar-quoted bodies and string literals.
HIDDEN = r"--[^\n]*|/\*.*?\*/|\$([A-Za-z_]*)\$.*?\$\1\$|'(?:[^']++|'')*+'"


def masked(sql: Column) -> Column:
    """SQL with comments and with string and dollar-quoted bodies blanked, byte for byte, so places are those of the file: what is left of ``;`` parts statements."""
    # One pass from the left, so a quote within a comment opens nothing, nor a comment within a literal.
    tokens = F.regexp_extract_all(sql, F.lit(rf"(?s){HIDDEN}|[^-/$']++|."), F.lit(0))
    return F.array_join(F.transform(tokens, lambda t: F.when(t.rlike(rf"(?s)^(?:{HIDDEN})$"), F.repeat(F.lit(" "), F.octet_length(t))).otherwise(t)), "")


def _plain(name: Column) -> Column:
    return F.when(name.startswith('"'), F.regexp_replace(name, '"', "")).otherwise(F.lower(name))


def extract_ddl(migrations: DataFrame, max_bytes: int = SCAN_BYTES, max_statements: int = SCAN_STATEMENTS) -> DataFrame:
    """One row a statement: repo_id, path, migration_order, statement_index, outcome, kind, object_schema, object_name, policy_name, command,
    roles, privileges, has_using, has_with_check, security_mode, search_path, object_kind (of grants), security_invoker (of views),
    start_byte, end_byte (exclusive) and content_digest of its place in the file.

    outcome: SUPPORTED, IGNORED_SAFE, UNSUPPORTED (it can change privileges) or MALFORMED, which takes all statements of its file. A file over
    a limit gives one row, SCAN_REJECTED, without index or place: it isn't read in part.
    """
    # A file over the limit is one piece, so all files take one way.
    big = F.coalesce(F.octet_length("content"), F.lit(0)) > max_bytes
    rows = migrations.withColumns({"content_digest": F.concat(F.lit("sha256:"), F.sha2(F.coalesce("content", F.lit("")), 256)), "big": big}).withColumn("bare", F.when(~F.col("big"), masked(F.col("content"))))
    broken = F.col("bare").rlike(r"\$[A-Za-z_]*\$") | (F.size(F.split(F.col("bare"), "'")) % 2 == 0) | F.col("bare").contains("/*")
    pieces = F.when(F.col("big"), F.array(F.lit("?"))).otherwise(F.regexp_extract_all("bare", F.lit(r'(?:[^;"]++|"[^"]*+")++|[;"]'), F.lit(0)))
    rows = rows.withColumn("broken", broken).select("repo_id", "path", "migration_order", "content_digest", "big", "broken", F.posexplode(pieces).alias("nth", "piece"))
    of_file = Window.partitionBy("repo_id", "path", "big")
    along = of_file.orderBy("nth")
    begin = F.coalesce(F.sum(F.octet_length("piece")).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest, inner = F.ltrim("piece", F.lit(SPACE)), F.btrim("piece", F.lit(SPACE))
    start = begin + F.octet_length("piece") - F.octet_length(rest)
    rows = rows.withColumns({"start_byte": start, "end_byte": start + F.octet_length(inner)}).where(~F.col("piece").isin(";", '"') & (inner != ""))
    rows = rows.withColumns({"s": F.regexp_replace(inner, r"\s+", " "), "statement_index": F.row_number().over(along) - 1, "statements": F.count("*").over(of_file)})
    # A file with too many statements is not read in part.
    rows = rows.withColumn("rejected", F.col("big") | (F.col("statements") > max_statements)).where("not rejected or statement_index = 0")
    kind = F.coalesce(*[F.when(F.col("s").rlike(p), F.lit(k)) for k, p in FORMS])
    # Named before the last projection, which would repeat them in every use.
    rows = rows.withColumn("kind", kind)
    target = F.coalesce(*[F.when(F.col("kind") == k, F.regexp_extract("s", p, 2 if "POLICY" in k else 1)) for k, p in FORMS])
    policy = F.coalesce(*[F.when(F.col("kind") == k, F.regexp_extract("s", p, 1)) for k, p in FORMS if "POLICY" in k])
    parts = F.regexp_extract_all(target, F.lit(r'"[^"]+"|[A-Za-z_][A-Za-z0-9_$]*'), F.lit(0))
    rows, parts, policy = rows.withColumns({"parts": parts, "policy": policy}), F.col("parts"), F.col("policy")
    granted = F.split(F.upper(F.regexp_replace(F.regexp_extract("s", r"(?i)^(?:grant|revoke(?:\s+grant\s+option\s+for)?)\s+(.+?)\s+on\s", 1), r"(?i)\s*privileges", "")), r"\s*,\s*")
    who = F.split(F.lower(F.regexp_replace(F.regexp_extract("s", r"(?i)\s(?:to|from)\s+([a-z0-9_,\s\"]+?)(?:\s+with\s+grant|\s+using|\s+with\s+check|\s+cascade|\s+restrict|$)", 1), '"', "")), r"\s*,\s*")
    is_policy, is_grant = F.col("kind").contains("POLICY"), F.col("kind").isin("GRANT", "REVOKE")
    outcome = F.when(F.col("rejected"), "SCAN_REJECTED").when(F.col("broken"), "MALFORMED").when(F.col("kind").isNotNull(), "SUPPORTED").when(F.col("s").rlike(UNSUPPORTED), "UNSUPPORTED").otherwise("IGNORED_SAFE")
    mode = F.when(F.col("s").rlike(r"(?i)\bsecurity\s+definer\b"), "DEFINER").when(F.col("s").rlike(r"(?i)\bsecurity\s+invoker\b"), "INVOKER")
    setting = F.lower(F.regexp_extract("s", r"(?i)\bwith\s*\([^)]*\bsecurity_invoker\b\s*=?\s*([a-z]*)", 1))
    invoker = F.when(F.col("s").rlike(r"(?i)\bwith\s*\([^)]*\bsecurity_invoker\b"), ~setting.isin("false", "off", "no"))
    supported = lambda c: F.when(~F.col("broken") & ~F.col("rejected"), c)
    placed = lambda c: F.when(~F.col("rejected"), F.col(c)).alias(c)
    return rows.select(
        "repo_id", "path", "migration_order", placed("statement_index"), outcome.alias("outcome"), supported(F.col("kind")).alias("kind"), supported(F.when(F.size(parts) > 1, _plain(parts[0]))).alias("object_schema"),
        supported(F.when(F.size(parts) > 0, _plain(F.element_at(parts, -1)))).alias("object_name"), supported(_plain(policy)).alias("policy_name"),
        supported(F.when(is_policy, F.upper(F.nullif(F.regexp_extract("s", r"(?i)\sfor\s+(all|select|insert|update|delete)\b", 1), F.lit(""))))).alias("command"),
        supported(F.when(is_policy | is_grant, F.filter(who, lambda w: w != ""))).alias("roles"), supported(F.when(is_grant, granted)).alias("privileges"),
        supported(F.when(is_policy, F.col("s").rlike(r"(?i)\susing\s*\("))).alias("has_using"), supported(F.when(is_policy, F.col("s").rlike(r"(?i)\swith\s+check\s*\("))).alias("has_with_check"),
        supported(F.when(F.col("kind").contains("FUNCTION"), mode)).alias("security_mode"), supported(F.when(F.col("kind").contains("FUNCTION"), F.nullif(F.trim(F.regexp_extract("s", r"(?i)\bset\s+search_path\s*(?:=|to)\s*([^;]*?)(?:\s+as\s|\s+language\s|$)", 1)), F.lit("")))).alias("search_path"),
        supported(F.when(is_grant, F.coalesce(F.nullif(F.upper(F.regexp_extract("s", r"(?i)\son\s+(table|function|schema|sequence)\s", 1)), F.lit("")), F.lit("TABLE")))).alias("object_kind"),
        supported(F.when(F.col("kind") == "CREATE_VIEW", invoker)).alias("security_invoker"),
        placed("start_byte"), placed("end_byte"), "content_digest",
    )


def extract_api_config(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(repo_id, api_enabled, schemas, functions, parse_coverage) of configuration files (repo_id, content), and diagnostics (repo_id, line_no, code).

    A key set twice in a section, or an unknown key of a security section, makes the configuration PARTIAL.
    """
    rows = files.select("repo_id", F.posexplode(F.split("content", "\r?\n")).alias("at", "line")).withColumn("line", F.trim(F.regexp_replace("line", r"\s#.*$|^#.*$", "")))
    order = Window.partitionBy("repo_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    header = F.regexp_extract("line", r"^\[([A-Za-z0-9_.-]+)\]$", 1)
    rows = rows.withColumn("section", F.last(F.nullif(header, F.lit("")), ignorenulls=True).over(order)).where(F.col("line").rlike(r"^[A-Za-z_][A-Za-z0-9_]*\s*="))
    rows = rows.withColumn("key", F.regexp_extract("line", r"^([A-Za-z_][A-Za-z0-9_]*)", 1)).withColumn("value", F.trim(F.regexp_extract("line", r"=\s*(.*)$", 1)))
    rows = rows.where(F.col("section").isin("api", "auth") | F.col("section").startswith("functions."))
    rows = rows.withColumn("k", F.count("*").over(Window.partitionBy("repo_id", "section", "key")))
    unknown = ((F.col("section") == "api") & ~F.col("key").isin("enabled", "port", "schemas", "extra_search_path", "max_rows")) | (F.col("section").startswith("functions.") & ~F.col("key").isin("verify_jwt", "enabled", "import_map", "entrypoint", "static_files"))
    diagnostics = rows.withColumn("code", F.when(F.col("k") > 1, "DUPLICATE_KEY").when(unknown, "UNKNOWN_KEY").when(F.col("key").isin("enabled", "verify_jwt") & ~F.col("value").isin("true", "false"), "NOT_BOOLEAN")).where("code is not null").select("repo_id", (F.col("at") + 1).alias("line_no"), "code")
    once = rows.where("k = 1")
    pick = lambda section, key: F.max(F.when((F.col("section") == section) & (F.col("key") == key), F.col("value")))
    jwt = F.collect_list(F.when(F.col("section").startswith("functions.") & (F.col("key") == "verify_jwt") & F.col("value").isin("true", "false"), F.struct(F.substring_index("section", ".", -1).alias("name"), (F.col("value") == "true").alias("on"))))
    found = once.groupBy("repo_id").agg(pick("api", "enabled").alias("enabled"), pick("api", "schemas").alias("listed"), jwt.alias("jwt"))
    n = diagnostics.groupBy("repo_id").agg(F.count("*").alias("n"))
    config = files.select("repo_id").join(found, "repo_id", "left").join(n, "repo_id", "left")
    schemas = F.coalesce(F.regexp_extract_all(F.col("listed"), F.lit('"([^"]+)"'), F.lit(1)), F.array().cast("array<string>"))
    return config.select("repo_id", (F.coalesce("enabled", F.lit("true")) == "true").alias("api_enabled"), schemas.alias("schemas"), F.map_from_entries(F.array_distinct(F.coalesce("jwt", F.array().cast("array<struct<name:string,on:boolean>>")))).alias("functions"), F.when(F.col("n") > 0, "PARTIAL").otherwise("COVERED").alias("parse_coverage")), diagnostics
