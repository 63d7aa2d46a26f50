"""Text hygiene, privacy and validation as Spark column expressions.

All functions map ``Column -> Column`` and stay inside whole-stage codegen
(``regexp_replace`` / ``rlike`` / ``translate``), so they run on whole tables
without Python.  ``*_nested`` variants walk array / map / struct types with
``transform`` / ``transform_values``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# These must equal the reference's lists for equal results.
# Injection patterns, removed in this order, case-insensitive.
SQL_INJECTION_PATTERNS = [
    r"""['"]?(\s)*(OR|AND)\s+.*=""",
    r"""['"]?;\s*(DROP|DELETE|INSERT|UPDATE|EXEC|ALTER|TRUNCATE|SELECT)\b.*""",
    r"\b(DROP|DELETE|TRUNCATE)\s+(TABLE|DATABASE)\b",
    r"\bUNION\s+(ALL\s+)?SELECT\b",
    r"--.*",
    r"/\*.*?\*/",
    r"xp_cmdshell",
    r"exec\s*\(",
]
# Script / markup patterns, removed in this order, case-insensitive, dot matches newline.
MARKUP_PATTERNS = [
    r"<script[^>]*>.*?</script>",
    r"javascript:",
    r"on\w+\s*=",
    r"<iframe",
    r"<object",
    r"<embed",
]
# Characters deleted by sanitize_string.
SANITIZE_CHARS = "<>\"'&"
# Characters that make a file name unsafe.
FILENAME_BAD_CHARS = "<>:\"|?*"
# Reserved words refused as identifiers.
SQL_KEYWORDS = ["SELECT", "INSERT", "UPDATE", "DELETE", "DROP", "ALTER",
                "CREATE", "TRUNCATE", "UNION", "WHERE", "JOIN", "EXEC"]
# Patterns that make a query text unsafe (searched case-insensitively).
QUERY_DANGER_PATTERNS = [
    r";\s*(DROP|DELETE|TRUNCATE|ALTER)\s+",
    r"--",
    r"/\*.*\*/",
    r"xp_cmdshell",
    r"exec\s*\(",
    r"UNION\s+ALL\s+SELECT",
]
# Masking levels and their output.
MASK_LEVELS = ["public", "internal", "confidential", "restricted"]
MASK_RESTRICTED = "******"
MASK_SHORT = "****"
# ---------------------------------------------------------------------------


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def sanitize_string(col, max_length: int = 1000) -> Column:
    """Delete ``< > " ' &`` then keep the first ``max_length`` characters."""
    return F.substring(F.translate(_c(col), SANITIZE_CHARS, ""), 1, max_length)


def strip_sql_patterns(col) -> Column:
    out = _c(col)
    for p in SQL_INJECTION_PATTERNS:
        out = F.regexp_replace(out, F.lit("(?i)" + p), F.lit(""))
    return out


def strip_markup(col) -> Column:
    out = _c(col)
    for p in MARKUP_PATTERNS:
        out = F.regexp_replace(out, F.lit("(?is)" + p), F.lit(""))
    return out


def html_escape(col) -> Column:
    """Escape ``& < > " '`` (ampersand first), as ``html.escape(quote=True)``."""
    out = F.replace(_c(col), F.lit("&"), F.lit("&amp;"))
    out = F.replace(out, F.lit("<"), F.lit("&lt;"))
    out = F.replace(out, F.lit(">"), F.lit("&gt;"))
    out = F.replace(out, F.lit('"'), F.lit("&quot;"))
    return F.replace(out, F.lit("'"), F.lit("&#x27;"))


def flag_filename(col) -> Column:
    """True when a file name is non-empty, has no ``..``, no leading slash or
    backslash, none of ``<>:"|?*`` and at most 255 characters."""
    c = _c(col)
    bad = F.lit(False)
    for ch in FILENAME_BAD_CHARS:
        bad = bad | F.contains(c, F.lit(ch))
    return (F.coalesce(F.length(c), F.lit(0)) > 0) & ~F.contains(c, F.lit("..")) \
        & ~F.startswith(c, F.lit("/")) & ~F.startswith(c, F.lit("\\")) & ~bad \
        & (F.length(c) <= 255)


def flag_sql_identifier(col) -> Column:
    c = _c(col)
    return F.coalesce(c.rlike(r"^[a-zA-Z_][a-zA-Z0-9_]*$") & ~F.upper(c).isin(SQL_KEYWORDS),
                      F.lit(False))


def flag_query_text(col) -> Column:
    """True when the text is non-empty and matches none of the dangerous patterns."""
    c = _c(col)
    hit = F.lit(False)
    for p in QUERY_DANGER_PATTERNS:
        hit = hit | c.rlike("(?i)" + p)
    return F.coalesce((F.length(c) > 0) & ~hit, F.lit(False))


def mask(col, level: str) -> Column:
    """public/internal → unchanged; confidential → first 2 + ``****`` + last 2
    (``****`` when ≤ 4 characters); restricted → ``******``; unknown → internal."""
    c = _c(col)
    level = (level or "").lower()
    if level == "restricted":
        return F.when(c.isNull(), c).otherwise(F.lit(MASK_RESTRICTED))
    if level == "confidential":
        return F.when(F.length(c) <= 4, F.lit(MASK_SHORT)).otherwise(
            F.concat(F.substring(c, 1, 2), F.lit(MASK_SHORT), F.substring(c, -2, 2)))
    return c


def _nested(col: Column, dtype: T.DataType, leaf) -> Column:
    if isinstance(dtype, T.StringType):
        return leaf(col)
    if isinstance(dtype, T.ArrayType):
        return F.transform(col, lambda x: _nested(x, dtype.elementType, leaf))
    if isinstance(dtype, T.MapType):
        return F.transform_values(col, lambda k, v: _nested(v, dtype.valueType, leaf))
    if isinstance(dtype, T.StructType):
        inner = F.struct(*[_nested(col.getField(f.name), f.dataType, leaf).alias(f.name)
                           for f in dtype.fields])
        return F.when(col.isNotNull(), inner)
    return col


def apply_nested(df, column: str, leaf) -> Column:
    """Apply a string→string expression to every string inside a (nested) column."""
    return _nested(F.col(column), df.schema[column].dataType, leaf).alias(column)


def sanitize_nested(df, column: str, max_length: int = 1000) -> Column:
    return apply_nested(df, column, lambda c: sanitize_string(c, max_length))


def escape_nested(df, column: str) -> Column:
    return apply_nested(df, column, html_escape)


def mask_nested(df, column: str, level: str) -> Column:
    return apply_nested(df, column, lambda c: mask(c, level))


def _key(secret: str) -> Column:
    return F.unhex(F.sha2(F.lit(secret), 256))


def encrypt(col, secret: str) -> Column:
    """AES-GCM with a SHA-256 derived key, base64 text; empty stays empty."""
    c = _c(col)
    return F.when((c.isNull()) | (c == ""), c).otherwise(
        F.base64(F.aes_encrypt(c.cast("binary"), _key(secret), F.lit("GCM"))))


def decrypt(col, secret: str) -> Column:
    c = _c(col)
    return F.when((c.isNull()) | (c == ""), c).otherwise(
        F.aes_decrypt(F.unbase64(c), _key(secret), F.lit("GCM")).cast("string"))


# Named predicates for the risk report: (name, kind, pattern-or-callable)
def risk_predicates() -> list[tuple[str, Column]]:
    """Every hygiene rule as a boolean predicate on a column named ``_t``."""
    t = F.col("_t")
    preds = [(f"sql_{i + 1}", t.rlike("(?i)" + p)) for i, p in enumerate(SQL_INJECTION_PATTERNS)]
    preds += [(f"markup_{i + 1}", t.rlike("(?is)" + p)) for i, p in enumerate(MARKUP_PATTERNS)]
    preds.append(("sanitize_chars", t.rlike("[<>\"'&]")))
    preds.append(("unsafe_query", ~flag_query_text(t)))
    return preds
