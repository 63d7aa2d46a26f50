"""Text hygiene and masking (cases in the spirit of the reference's security tests)."""

from pyspark.sql import functions as F

from tessera.functions import text as TX


def _one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("o")) \
        .first()["o"]


def test_sanitize_and_escape(spark):
    assert _one(spark, "<script>alert('x')</script>", TX.sanitize_string) == "scriptalert(x)/script"
    assert _one(spark, "a" * 1500, TX.sanitize_string) == "a" * 1000
    assert _one(spark, "<b>&\"'", TX.html_escape) == "&lt;b&gt;&amp;&quot;&#x27;"


def test_strip_patterns(spark):
    assert _one(spark, "name; DROP TABLE users", TX.strip_sql_patterns) == "name"
    assert _one(spark, "hi <script>x</script> there", TX.strip_markup) == "hi  there"
    assert _one(spark, "x UNION SELECT y", TX.strip_sql_patterns) == "x  y"


def test_flags(spark):
    assert _one(spark, "report.csv", TX.flag_filename) is True
    assert _one(spark, "../etc/passwd", TX.flag_filename) is False
    assert _one(spark, "user_name", TX.flag_sql_identifier) is True
    assert _one(spark, "select", TX.flag_sql_identifier) is False
    assert _one(spark, "SELECT * FROM t; DROP TABLE t", TX.flag_query_text) is False


def test_mask_levels(spark):
    assert _one(spark, "4111222233334444", lambda c: TX.mask(c, "confidential")) == "41****44"
    assert _one(spark, "abc", lambda c: TX.mask(c, "confidential")) == "****"
    assert _one(spark, "secret", lambda c: TX.mask(c, "restricted")) == "******"
    assert _one(spark, "plain", lambda c: TX.mask(c, "bogus")) == "plain"


def test_encrypt_roundtrip(spark):
    df = spark.createDataFrame([("hello",), ("",)], "t string")
    out = df.select(TX.decrypt(TX.encrypt("t", "k"), "k").alias("o")).collect()
    assert [r["o"] for r in out] == ["hello", ""]
