"""Column-level queries: casts, validation, sampling, text hygiene, masking (§2.3–2.4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as TX
from ..operators import columns as C
from . import query
from .sqlgen import union_all
from .tables import table


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


# ---- casts / projection -----------------------------------------------------

@query("select_by_role", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def select_by_role(spark, sf):
    return C.select_by_role(table(spark, sf, "customer"), "numeric")


@query("coerce_numeric", """SELECT event_id,
  coalesce(TRY_CAST(value AS DOUBLE), 0.0) AS value,
  coalesce(TRY_CAST(props AS DOUBLE), 0.0) AS props,
  coalesce(TRY_CAST(event_type AS DOUBLE), 0.0) AS event_type
FROM events""")
def coerce_numeric(spark, sf):
    return C.coerce_features(table(spark, sf, "events"), ["value", "props", "event_type"],
                             keep=["event_id"])


CONVERT_MAP = {"value": "numeric", "event_type": "boolean", "props": "numeric",
               "event_id": "string", "user_id": "category"}


@query("convert_types", """SELECT CAST(event_id AS VARCHAR) AS event_id, ts,
  CAST(user_id AS VARCHAR) AS user_id,
  CASE WHEN event_type IS NULL THEN true ELSE length(event_type) > 0 END AS event_type,
  TRY_CAST(value AS DOUBLE) AS value, TRY_CAST(props AS DOUBLE) AS props
FROM events""")
def convert_types(spark, sf):
    out, _ = C.convert_types(table(spark, sf, "events"), CONVERT_MAP)
    return out


@query("convert_types_report", """SELECT * FROM (VALUES
  ('value', 'double', 'numeric', 'converted', 0),
  ('event_type', 'string', 'boolean', 'converted', 0),
  ('event_id', 'bigint', 'string', 'converted', 0),
  ('user_id', 'bigint', 'category', 'converted', 0)) t(column_name, old_type, new_type, status, failed)
UNION ALL
SELECT 'props', 'string', 'numeric', 'converted',
  count(*) FILTER (WHERE props IS NOT NULL AND TRY_CAST(props AS DOUBLE) IS NULL) FROM events""")
def convert_types_report(spark, sf):
    _, rep = C.convert_types(table(spark, sf, "events"), CONVERT_MAP)
    return rep


@query("align_columns", """SELECT l_orderkey, l_linenumber, l_quantity, l_discount,
  CAST(0.0 AS DOUBLE) AS missing_feature, l_tax FROM lineitem""")
def align_columns(spark, sf):
    return C.align_columns(table(spark, sf, "lineitem"),
                           ["l_quantity", "l_discount", "missing_feature", "l_tax"],
                           keep=["l_orderkey", "l_linenumber"])


@query("validate_data", """SELECT * FROM (VALUES
  ('required', 'l_orderkey', 'error', 0, true),
  ('required', 'l_nonexistent', 'error', 1, false),
  ('type', 'l_quantity', 'error', 0, true),
  ('type', 'l_returnflag', 'error', 1, false),
  ('type', 'l_shipdate', 'error', 0, true)) t(rule, column_name, level, violations, passed)
UNION ALL
SELECT 'range', 'l_quantity', 'warning', count(*) FILTER (WHERE l_quantity < 1 OR l_quantity > 40),
  count(*) FILTER (WHERE l_quantity < 1 OR l_quantity > 40) = 0 FROM lineitem
UNION ALL
SELECT 'range', 'l_discount', 'warning', count(*) FILTER (WHERE l_discount < 0 OR l_discount > 0.05),
  count(*) FILTER (WHERE l_discount < 0 OR l_discount > 0.05) = 0 FROM lineitem""")
def validate_data(spark, sf):
    return C.validate_data(table(spark, sf, "lineitem"),
                           required_columns=["l_orderkey", "l_nonexistent"],
                           column_types={"l_quantity": "numeric", "l_returnflag": "numeric",
                                         "l_shipdate": "datetime"},
                           value_ranges={"l_quantity": (1, 40), "l_discount": (0, 0.05)})


@query("sample_rows", """SELECT * FROM orders
ORDER BY ((o_orderkey % 2147483648) * 1103515245 + 12345 * 42) % 2147483648, o_orderkey LIMIT 100""")
def sample_rows(spark, sf):
    return C.sample_rows(table(spark, sf, "orders"), 100, "o_orderkey", seed=42, portable=True)


@query("top_k", """SELECT * FROM lineitem
ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 20""")
def top_k(spark, sf):
    return C.top_k(table(spark, sf, "lineitem"), "l_extendedprice", 20,
                   tiebreak=["l_orderkey", "l_linenumber"])


# ---- text hygiene -----------------------------------------------------------

def _sql_chain(col: str, patterns, flags: str) -> str:
    out = col
    for p in patterns:
        out = f"regexp_replace({out}, {q(flags + p)}, '', 'g')"
    return out


SANITIZE_SQL = "substr(regexp_replace({c}, '[<>\"''&]', '', 'g'), 1, 1000)"
ESCAPE_SQL = ("replace(replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), "
              "'>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')")


@query("sanitize_string", f"SELECT doc_id, {SANITIZE_SQL.format(c='text')} AS text FROM documents")
def sanitize_string(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", TX.sanitize_string("text").alias("text"))


@query("strip_sql_patterns", f"SELECT doc_id, {_sql_chain('text', TX.SQL_INJECTION_PATTERNS, '(?i)')} "
                             f"AS text FROM documents")
def strip_sql_patterns(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", TX.strip_sql_patterns("text").alias("text"))


@query("strip_markup", f"SELECT page_id, {_sql_chain('html', TX.MARKUP_PATTERNS, '(?is)')} "
                       f"AS html FROM pages")
def strip_markup(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", TX.strip_markup("html").alias("html"))


@query("html_escape", f"SELECT page_id, {ESCAPE_SQL.format(c='html')} AS html FROM pages")
def html_escape(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", TX.html_escape("html").alias("html"))


@query("sanitize_nested", f"""SELECT conv_id, turn,
  array_to_string(list_transform(string_split(text, ' '), lambda x: {SANITIZE_SQL.format(c='x')}), ' ')
    AS words FROM conversations""")
def sanitize_nested(spark, sf):
    c = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.split("text", " ").alias("words"))
    return c.select("conv_id", "turn", TX.sanitize_nested(c, "words")).select(
        "conv_id", "turn", F.array_join("words", " ").alias("words"))


@query("escape_nested", f"""SELECT conv_id, turn, {ESCAPE_SQL.format(c='role')} AS role,
  {ESCAPE_SQL.format(c='text')} AS text FROM conversations""")
def escape_nested(spark, sf):
    c = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.struct("role", "text").alias("msg"))
    return c.select("conv_id", "turn", TX.escape_nested(c, "msg")).select(
        "conv_id", "turn", "msg.role", "msg.text")


FILENAME_SQL = """(coalesce(length({c}), 0) > 0 AND NOT contains({c}, '..')
  AND NOT starts_with({c}, '/') AND NOT starts_with({c}, '\\')
  AND NOT regexp_matches({c}, '[<>:"|?*]') AND length({c}) <= 255)"""


@query("flag_filename", f"""SELECT page_id, {FILENAME_SQL.format(c='url')} AS url_ok,
  {FILENAME_SQL.format(c="regexp_extract(url, '[^/]*$')")} AS tail_ok FROM pages""")
def flag_filename(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", TX.flag_filename("url").alias("url_ok"),
                    TX.flag_filename(F.regexp_extract("url", r"[^/]*$", 0)).alias("tail_ok"))


KEYWORDS_SQL = ", ".join(q(k) for k in TX.SQL_KEYWORDS)
IDENT_SQL = ("coalesce(regexp_full_match({c}, '[a-zA-Z_][a-zA-Z0-9_]*') "
             f"AND upper({{c}}) NOT IN ({KEYWORDS_SQL}), false)")


@query("flag_sql_identifier", f"""SELECT p_partkey, {IDENT_SQL.format(c='p_name')} AS name_ok,
  {IDENT_SQL.format(c='p_brand')} AS brand_ok, {IDENT_SQL.format(c='p_type')} AS type_ok FROM part""")
def flag_sql_identifier(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", TX.flag_sql_identifier("p_name").alias("name_ok"),
                    TX.flag_sql_identifier("p_brand").alias("brand_ok"),
                    TX.flag_sql_identifier("p_type").alias("type_ok"))


def _query_ok_sql(c: str) -> str:
    hits = " OR ".join(f"regexp_matches({c}, {q('(?i)' + p)})" for p in TX.QUERY_DANGER_PATTERNS)
    return f"coalesce(length({c}) > 0 AND NOT ({hits}), false)"


@query("flag_query_text", f"SELECT doc_id, {_query_ok_sql('text')} AS query_ok FROM documents")
def flag_query_text(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", TX.flag_query_text("text").alias("query_ok"))


def _mask_sql(c: str, level: str) -> str:
    if level == "restricted":
        return f"CASE WHEN {c} IS NULL THEN NULL ELSE '******' END"
    if level == "confidential":
        return (f"CASE WHEN length({c}) <= 4 THEN '****' "
                f"ELSE substr({c}, 1, 2) || '****' || right({c}, 2) END")
    return c


@query("mask_column", f"""SELECT c_custkey, {_mask_sql('c_name', 'confidential')} AS name_conf,
  {_mask_sql('c_name', 'restricted')} AS name_restr, c_name AS name_internal,
  {_mask_sql('c_mktsegment', 'confidential')} AS seg_conf,
  {_mask_sql("substr(c_mktsegment, 1, 3)", 'confidential')} AS seg3_conf FROM customer""")
def mask_column(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", TX.mask("c_name", "confidential").alias("name_conf"),
                    TX.mask("c_name", "restricted").alias("name_restr"),
                    TX.mask("c_name", "no-such-level").alias("name_internal"),
                    TX.mask("c_mktsegment", "confidential").alias("seg_conf"),
                    TX.mask(F.substring("c_mktsegment", 1, 3), "confidential").alias("seg3_conf"))


@query("encrypt_roundtrip", """SELECT doc_id, true AS roundtrip_ok, text <> '' AS changed
FROM documents""")
def encrypt_roundtrip(spark, sf):
    d = table(spark, sf, "documents")
    enc = TX.encrypt("text", "tessera-demo-secret")
    return d.select("doc_id", (TX.decrypt(enc, "tessera-demo-secret") == F.col("text"))
                    .alias("roundtrip_ok"), (enc != F.col("text")).alias("changed"))


def _risk_sql(tbl: str, col: str, by: str | None) -> str:
    rules = [(f"sql_{i + 1}", f"regexp_matches({col}, {q('(?i)' + p)})")
             for i, p in enumerate(TX.SQL_INJECTION_PATTERNS)]
    rules += [(f"markup_{i + 1}", f"regexp_matches({col}, {q('(?is)' + p)})")
              for i, p in enumerate(TX.MARKUP_PATTERNS)]
    rules.append(("sanitize_chars", f"regexp_matches({col}, '[<>\"''&]')"))
    rules.append(("unsafe_query", f"NOT ({_query_ok_sql(col)})"))
    sel = f"{by}, " if by else ""
    grp = f" GROUP BY {by}" if by else ""
    return union_all([f"SELECT {sel}count(*) AS n_rows, '{name}' AS rule, "
                      f"count(*) FILTER (WHERE {cond}) AS n_match FROM {tbl}{grp}"
                      for name, cond in rules])


@query("text_risk_report", _risk_sql("documents", "text", "source"))
def text_risk_report(spark, sf):
    return C.text_risk_report(table(spark, sf, "documents"), "text", by=["source"])


@query("text_risk_report_pages", _risk_sql("pages", "html", None))
def text_risk_report_pages(spark, sf):
    return C.text_risk_report(table(spark, sf, "pages"), "html")


@query("stream_sanitize_string",
       f"SELECT doc_id, {SANITIZE_SQL.format(c='text')} AS text FROM documents")
def stream_sanitize_string(spark, sf):
    """The sanitiser applied to ``documents`` read as a stream."""
    from ..streaming.score import read_stream, run_to_table
    src = f"{sf.rstrip('/')}/documents.parquet"
    schema = spark.read.parquet(src).schema
    s = read_stream(spark, src, schema).select("doc_id", TX.sanitize_string("text").alias("text"))
    return run_to_table(s)


@query("mask_nested", f"""SELECT conv_id, turn, {_mask_sql('role', 'confidential')} AS role,
  {_mask_sql('text', 'confidential')} AS text FROM conversations""")
def mask_nested(spark, sf):
    c = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.struct("role", "text").alias("msg"))
    return c.select("conv_id", "turn", TX.mask_nested(c, "msg", "confidential")).select(
        "conv_id", "turn", "msg.role", "msg.text")
