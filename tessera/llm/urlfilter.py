"""URL filters: rules first, a logistic regression on character n-grams for all others.

A url's host and path are cut into character n-grams, each hashed to one of 4096 buckets
of a kind (host or path); a url's features are its distinct buckets, at unit length.  The
regression is trained on a small labelled table of urls by rounds of full gradients, each
one aggregate: what a round adds to a weight is a sum of whole millionths, so neither
partitions nor retries change a model.  The driver holds the weights, whose number is fixed.

A rule ``host/path`` fits its host and all subdomains, if the url's path starts with the
rule's; of the rules that fit, the longest wins (of equal length, a block).  Rules that
are few (their size is checked) are looked up in a literal; beyond that, every host meets
its rules once in a join, and the rows meet the hosts.

Everything is DataFrame functions.  Inputs and results: a null url, or one without
``://``, has an empty host and path and is judged like any other; urls of any length are
read whole; repeated rows and ids are rows of their own; columns of other names play no
part; an empty table gives an empty one; after training on no rows every score is 0.5.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.joins import join_small
from .common import store, table

#: Characters in an n-gram, hex digits of its hash that name a bucket, rounds and step of training.
GRAMS, DIGITS, ROUNDS, RATE = (3, 4), 3, 40, 8
BUCKETS, ONE = 16 ** DIGITS, 1_000_000
#: Bytes of rules that are looked up in a literal.
LITERAL_BYTES = 1 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The rules of the query: (host, path) and verdict.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

#: Labelled urls to learn from: what a filter list and a list of plain sites would hold.
BLOCKED = (
    "http://online-casino.test/win/jackpot", "http://www.casino-royal.test/slots/free-spins",
    "https://win-big-casino.test/bonus", "http://poker-bets.test/play/now", "https://best-betting-odds.test/bets/football",
    "http://free-bet-bonus.test/register", "https://www.sports-bets.test/odds", "http://lottery-winner.test/claim-prize",
    "http://cheap-viagra.test/order", "https://pills-online.test/buy/cheap-pills", "http://discount-pills.test/no-prescription",
    "https://cheap-meds.test/pharmacy/order-now", "http://weight-loss-pills.test/miracle", "http://adult-videos.test/xxx",
    "https://xxx-adult-dating.test/girls", "http://adult-chat.test/cams/live", "https://www.hot-adult.test/video/18",
    "http://sexy-singles.test/adult/dating", "http://spam-mailer.test/bulk", "https://spam-links.test/seo/backlinks",
    "http://link-farm.test/links", "http://content-farm.test/clickbait", "http://www.spam-offers.test/offer",
    "https://ads-server.test/banner", "http://ad-track.test/pixel.gif", "https://click-tracker.test/click",
    "http://tracking-ads.test/track", "https://popup-ads.test/pop", "http://track-clicks.test/redirect",
    "http://free-iphone-winner.test/claim", "https://payday-loans.test/fast-cash", "http://quick-cash-loan.test/apply",
    "http://replica-watches.test/cheap", "http://cheap-handbags.test/replica", "https://download-crack.test/keygen",
    "http://warez-torrent.test/full-crack", "http://verify-account-login.test/phish", "https://secure-bank-verify.test/login.php",
    "http://malware-scan-alert.test/download.exe", "http://virus-alert.test/fix-now.exe", "https://earn-money-fast.test/rich",
    "http://get-rich-quick.test/money", "https://crypto-doubler.test/win", "http://miracle-cure.test/buy-now",
)
ALLOWED = (
    "https://www.citylibrary.test/en/catalogue/12", "http://weather.test/de/berlin", "https://blog.gardening.test/en/2021/roses",
    "http://news.test/en/politics/481.html", "https://museum.test/fr/expositions/14", "https://university.test/en/courses/220",
    "http://www.theatre.test/en/tickets", "https://recipes.test/es/sopa/35", "http://docs.python-guide.test/en/tutorial",
    "https://m.trainlines.test/en/timetable", "http://physics.test/en/lectures/7", "https://www.hospital.test/de/kontakt",
    "http://history.test/en/middle-ages", "https://school.test/fr/cours/91", "http://blog.travelnotes.test/es/viajes/3",
    "https://science.test/en/articles/822", "http://music.test/en/albums/44", "https://forum.woodwork.test/en/thread/6312",
    "http://www.bakery.test/de/brot", "https://research.test/en/papers/2019/5", "http://cityhall.test/fr/mairie",
    "https://www.football.test/en/results", "http://chess.test/en/openings", "https://maps.test/en/region/9",
    "http://poetry.test/es/poemas/17", "https://www.wikipedia-reader.test/en/article", "http://radio.test/de/sendung/3",
    "https://astronomy.test/en/stars/55", "http://blog.knitting.test/en/patterns", "https://www.furniture.test/en/chairs/8",
    "http://there.test/en/900", "https://other.test/fr/102", "http://m.nature.test/es/aves", "https://www.parents.test/en/advice",
    "http://street.test/de/karte", "https://thinking.test/en/essays/71.html", "http://writer.test/fr/livres/6/",
    "https://blog.teacher.test/en/lessons/303", "http://northern.test/en/towns", "https://www.painter.test/de/bilder/12",
    "http://station.test/en/trains", "https://reading.test/en/books/77", "http://ferry.test/es/horarios", "https://orchestra.test/en/concerts",
)


def labelled_urls(spark: SparkSession, blocked: Sequence[str] = BLOCKED, allowed: Sequence[str] = ALLOWED) -> DataFrame:
    """The labelled table ``(url, label)``; label 1: to be blocked."""
    rows = [{"url": u, "label": label} for label, urls in ((1, blocked), (0, allowed)) for u in urls]
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), "array<struct<url:string,label:int>>")))


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """``(host, path, verdict)`` of some rules."""
    rows = [dict(zip(("host", "path", "verdict"), r)) for r in rules]
    return spark.range(1).select(F.inline(F.from_json(
        F.lit(json.dumps(rows)), "array<struct<host:string,path:string,verdict:string>>")))


def _parts(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    place = F.regexp_extract(rest, r"(?s)^([^/?#]*)([^?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^([^/?#]*)([^?#]*)", 2)
    return F.translate(place, UPPER, LOWER), path


def _buckets(text: Column, kind: str) -> Column:
    """Buckets of the n-grams of a text between its marks ``^`` and ``$``."""
    chars = F.split(F.concat(F.lit("^"), text, F.lit("$")), "")

    def gram(n):
        # the characters beside their followers; each array is made once, not once a place
        rows = F.arrays_zip(*[F.slice(chars, j + 1, F.size(chars)) for j in range(n)])
        text = lambda r: F.concat(F.lit(kind), *[r[str(j)] for j in range(n)])
        hashed = lambda r: F.conv(F.substring(F.md5(text(r)), 1, DIGITS), 16, 10).cast("int")
        return F.array_compact(F.transform(rows, hashed))   # null where the text ends before the n-gram
    return F.concat(*[gram(n) for n in GRAMS])


def featured(rows: DataFrame, url: str) -> DataFrame:
    """Adds ``host``, ``path`` and the distinct buckets ``x`` (the last is of all urls)."""
    host, path = _parts(F.col(url))
    kept = rows.withColumns({"host": host, "path": path})
    return kept.withColumn("x", F.array_append(F.array_distinct(F.concat(
        _buckets(F.col("host"), "h"), _buckets(F.col("path"), "p"))), F.lit(BUCKETS)))


def probability(weights: Sequence[int]) -> Column:
    """Of label 1, by features ``x``; in steps of a millionth."""
    w = F.from_json(F.lit(json.dumps(list(weights))), "array<long>")
    total = F.aggregate("x", F.lit(0).cast("long"), lambda s, i: s + F.get(w, i))
    z = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), total.cast("double") / F.lit(float(ONE)) / F.sqrt(F.size("x").cast("double"))))
    return F.floor(F.lit(float(ONE)) / (F.lit(1.0) + F.exp(-z)) + F.lit(0.5)) / F.lit(float(ONE))


def train(labelled: DataFrame, url: str = "url", label: str = "label", rounds: int = ROUNDS, rate: int = RATE) -> list[int]:
    """Weights in millionths, one for each bucket."""
    rows = store(featured(labelled.select(F.col(url).alias("u"), F.col(label).alias("y")).where("y is not null"), "u")
                 .select("x", "y"))
    weights = [0] * (BUCKETS + 1)
    for _ in range(rounds):
        # residual over the length of the features, in millionths
        gap = F.floor((F.col("y").cast("double") - probability(weights)) / F.sqrt(F.size("x").cast("double")) * F.lit(float(ONE))
                      + F.lit(0.5)).cast("long")
        step = rows.select(F.explode("x").alias("i"), gap.alias("e")).groupBy("i").agg(F.sum("e").alias("e")).collect()
        for r in step:  # at most one row for each bucket
            weights[r["i"]] += rate * r["e"]
    return weights


def _suffixes(host: Column, most: int) -> Column:
    """A host and its parent domains of at most ``most`` labels."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(most))),
                       lambda k: F.array_join(F.slice(labels, -k, k), "."))


def with_rules(rows: DataFrame, rules: DataFrame, literal_bytes: int = LITERAL_BYTES) -> DataFrame:
    """Rows with ``host`` and ``path`` and the winning rule as ``rule`` and ``ruled``."""
    rules = store(rules.where("host is not null and path is not null and verdict is not null").distinct()
                  .groupBy("host").agg(F.collect_list(F.struct("path", "verdict")).alias("r")))
    facts = rules.agg(F.max(F.size(F.split("host", r"\."))).alias("most"),
                      F.sum(F.length(F.to_json(F.struct("host", "r")))).alias("bytes")).first()
    most = facts["most"] or 1
    if (facts["bytes"] or 0) <= literal_bytes:
        known = {r["host"]: [x.asDict() for x in r["r"]] for r in rules.collect()}
        literal = F.from_json(F.lit(json.dumps(known)), "map<string,array<struct<path:string,verdict:string>>>")
        found = F.flatten(F.transform(_suffixes(F.col("host"), most), lambda s: F.transform(
            F.coalesce(literal[s], F.array().cast("array<struct<path:string,verdict:string>>")),
            lambda x: F.struct(F.concat(s, x["path"]).alias("rule"), x["path"].alias("path"), x["verdict"].alias("verdict")))))
        rows = rows.withColumn("rules", found)
    else:
        # every host once; only hosts with a rule come back
        asked = rows.select(F.col("host").alias("own")).distinct() \
            .select("own", F.explode(_suffixes(F.col("own"), most)).alias("host"))
        of_host = asked.join(rules, "host").select("own", "host", F.inline("r")) \
            .select(F.col("own").alias("host"), F.concat("host", "path").alias("rule"), "path", "verdict")
        of_host = store(of_host.groupBy("host").agg(F.collect_list(F.struct("rule", "path", "verdict")).alias("rules")))
        rows = join_small(rows, of_host, "host", "left")
    fits = F.filter("rules", lambda x: F.col("path").startswith(x["path"]))
    best = F.array_max(F.transform(fits, lambda x: F.struct(
        F.length(x["rule"]).alias("n"), x["verdict"].alias("verdict"), x["rule"].alias("rule"))))
    return rows.withColumn("best", best).withColumns({"rule": F.col("best.rule"), "ruled": F.col("best.verdict")}) \
        .drop("best", "rules")


def judge(pages: DataFrame, weights: Sequence[int], rules: DataFrame, id_col: str = "page_id", url: str = "url",
          threshold: float = 0.5, literal_bytes: int = LITERAL_BYTES) -> DataFrame:
    """``id_col, host, path, rule, verdict, score`` for every row; score: the probability that
    the url is to be blocked by the ``weights`` of ``train``, which decides where no rule fits."""
    rows = featured(pages.select(F.col(id_col).alias("id"), F.col(url).alias("u")), "u") \
        .withColumn("score", probability(weights)).drop("x", "u")
    return with_rules(rows, rules, literal_bytes).select(
        F.col("id").alias(id_col), "host", "path", "rule",
        F.coalesce("ruled", F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score")


def op12_urls(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages"), train(labelled_urls(spark)), rule_table(spark))


def _sql() -> str:
    urls = ",\n  ".join(f"('{u}', {y})" for y, us in ((1, BLOCKED), (0, ALLOWED)) for u in us)
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    return rf"""
WITH RECURSIVE rules(host, path, verdict) AS (VALUES {rules}),
labelled(url, y) AS (VALUES
  {urls}),
u AS (
  SELECT DISTINCT url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM (SELECT url FROM labelled UNION ALL SELECT coalesce(url, '') FROM pages)),
h AS (
  SELECT url, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
k AS (SELECT url, 'h' AS kind, '^' || host || '$' AS t FROM h UNION ALL SELECT url, 'p', '^' || path || '$' FROM h),
b AS (
  SELECT DISTINCT url, ('0x' || substr(md5(kind || substr(t, i, n)), 1, {DIGITS}))::INT AS i
  FROM (SELECT url, kind, t, n, unnest(range(1, length(t) - n + 2)) AS i
        FROM k, (VALUES {', '.join(f'({n})' for n in GRAMS)}) s(n) WHERE length(t) >= n)
  UNION ALL SELECT url, {BUCKETS} FROM u),
x AS (SELECT url, i, count(*) OVER (PARTITION BY url) AS m FROM b),
lx AS (SELECT x.url, x.i, x.m, l.y FROM x JOIN labelled l USING (url)),
w(step, ws) AS (
  SELECT 0, list_transform(range({BUCKETS + 1}), lambda i: 0::BIGINT)
  UNION ALL
  SELECT step + 1, list(v ORDER BY i) FROM (
    SELECT w.step, g.i, w.ws[g.i + 1] + {RATE} * g.e AS v FROM w, (
      SELECT a.i, coalesce(sum(e), 0)::BIGINT AS e FROM (SELECT unnest(range({BUCKETS + 1})) AS i) a LEFT JOIN (
        SELECT lx.i, floor((lx.y - p.p) / sqrt(lx.m::DOUBLE) * 1e6 + 0.5)::BIGINT AS e FROM lx JOIN (
          SELECT url, floor(1e6 / (1 + exp(-greatest(-30, least(30, sum(w.ws[i + 1])::DOUBLE / 1e6 / sqrt(any_value(m)::DOUBLE))))) + 0.5) / 1e6 AS p
          FROM lx, w GROUP BY url) p USING (url)) d ON d.i = a.i GROUP BY a.i) g)
  WHERE step < {ROUNDS} GROUP BY step),
s AS (
  SELECT x.url, floor(1e6 / (1 + exp(-greatest(-30, least(30, sum(w.ws[x.i + 1])::DOUBLE / 1e6 / sqrt(any_value(x.m)::DOUBLE))))) + 0.5) / 1e6 AS score
  FROM x, w WHERE w.step = {ROUNDS} GROUP BY x.url),
f AS (
  SELECT h.url, r.host || r.path AS rule, r.verdict FROM h JOIN rules r
    ON (h.host = r.host OR ends_with(h.host, '.' || r.host)) AND starts_with(h.path, r.path)
  QUALIFY row_number() OVER (PARTITION BY h.url ORDER BY length(r.host || r.path) DESC, r.verdict DESC, r.host || r.path DESC) = 1)
SELECT p.page_id, h.host, h.path, f.rule,
       coalesce(f.verdict, CASE WHEN s.score >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict, s.score
FROM pages p JOIN h ON h.url = coalesce(p.url, '') JOIN s ON s.url = h.url LEFT JOIN f ON f.url = h.url
"""


OP12_SQL = _sql()
