"""URL filters: pattern rules indexed by their rarest literal token.

Each rule lists tokens that any matching URL must have; an entry of several, as "ad|ads", asks for one of them. Token frequencies over all
URLs pick the rarest entry of each, under all of whose tokens the rule is filed; the tokens of a URL fetch candidate rules, and only their regular expressions run on it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxtrail.llm.common import LOWER, UPPER, Scratch, maybe_broadcast, table

#: Fixed values: (host, path, verdict) of the rules that hold for a host and all its subdomains; the longest wins.
SITE_RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
#: Fixed values: (pattern over host and path, tokens that it needs, verdict) for all other URLs; "a|b" needs either token. An allowing pattern
#: outweighs blocking ones.
PATTERN_RULES = (
    (r"^(?:[^/]*[.-])?casino(?:[.-]|/|\z)", ("casino",), "block"),
    (r"^(?:[^/]*[.-])?free-bets(?:[.-]|/|\z)", ("free", "bets"), "block"),
    (r"^(?:[^/]*[.-])?poker(?:[.-]|/|\z)", ("poker",), "block"),
    (r"^(?:[^/]*[.-])?(?:cheap-)?pills(?:[.-]|/|\z)", ("pills",), "block"),
    (r"^(?:[^/]*[.-])?xxx(?:[.-]|/|\z)", ("xxx",), "block"),
    (r"^(?:[^/]*[.-])?porn(?:[.-]|/|\z)", ("porn",), "block"),
    (r"^(?:[^/]*\.)?ads?\.", ("ad|ads",), "block"),
    (r"/cgi-bin/", ("cgi", "bin"), "block"),
    (r"/wp-admin/", ("wp", "admin"), "block"),
    (r"^[^/]*/robots\.txt\z", ("robots", "txt"), "allow"),
)
TARGET = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def rule_rows(site_rules=SITE_RULES, pattern_rules=PATTERN_RULES) -> list[tuple]:
    """(id, site, pattern, tokens, verdict); site is null for pattern rules."""
    rows = []
    for host, path, verdict in site_rules:
        whole = [p for p in path.split("/")[:-1] if p]  # the last part may go on in the URL
        tokens = [t for t in re.split("[^a-z0-9]+", " ".join([host, *whole]).lower()) if t]
        rows.append((len(rows), host + path, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", tokens, verdict))
    return rows + [(len(rows) + i, None, pattern, list(tokens), verdict) for i, (pattern, tokens, verdict) in enumerate(pattern_rules)]


def judge_urls(pages: DataFrame, rules: list[tuple] | None = None) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict.

    pages needs page_id and url; other columns are ignored. host is what follows the first `://` up to `/`, `?`, `#` or
    the end, A-Z in lower case, path the rest up to `?` or `#`; a null url or one without `://` has empty ones and is allowed.
    rule is the longest site rule that fits (of equally long ones the first in order), else null; verdict is that rule's, else block if a blocking
    pattern matches and no allowing one does, else allow. Every rule needs a token. Repeated rows get the same result; an empty table gives
    no rows.

    Rules are joined to URL tokens by a broadcast while they are few, else by a shuffle; two aggregations follow, over the rules' tokens and over rows.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark)
    rows = rule_rows() if rules is None else rules
    known = spark.createDataFrame(rows, "id int, site string, pattern string, tokens array<string>, action string")
    urls = pages.select(
        F.monotonically_increasing_id().alias("row"),
        "page_id",
        F.translate(F.coalesce(F.regexp_extract("url", TARGET, 1), F.lit("")), UPPER, LOWER).alias("host"),
        F.coalesce(F.regexp_extract("url", TARGET, 2), F.lit("")).alias("path"),
    )
    words = F.array_distinct(F.filter(F.split(F.translate(F.concat("host", "path"), UPPER, LOWER), "[^a-z0-9]+"), lambda t: t != ""))
    literal = known.select("id", F.explode("tokens").alias("entry")).select("id", "entry", F.explode(F.split("entry", "[|]")).alias("token"))
    needed = maybe_broadcast(literal.select("token").distinct(), len(rows))
    seen = urls.select(F.explode(words).alias("token")).join(needed, "token").groupBy("token").agg(F.count("*").alias("n"))
    entries = literal.join(seen, "token", "left").groupBy("id", "entry").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"), F.collect_set("token").alias("any"))
    rarest = entries.groupBy("id").agg(F.min_by("any", F.struct("n", "entry")).alias("any")).select("id", F.explode("any").alias("token"))
    index = scratch.save(known.drop("tokens").join(rarest, "id"), "index")

    # the empty token keeps every URL, with or without candidates
    fetched = urls.withColumn("token", F.explode(F.concat(F.array(F.lit("")), words))).join(maybe_broadcast(index, index.count()), "token", "left")
    hits = fetched.where((F.col("token") == "") | F.expr("concat(host, path) rlike pattern"))
    best = F.max_by(F.struct("site", "action"), F.struct(F.length("site"), -F.col("id")))
    tests = [F.coalesce(F.bool_or(F.col("site").isNull() & (F.col("action") == a)), F.lit(False)).alias(a) for a in ("block", "allow")]
    found = hits.groupBy("row", "page_id", "host", "path").agg(best.alias("best"), *tests)
    verdict = F.coalesce(F.when(F.col("best.site").isNotNull(), F.col("best.action")), F.when(F.col("block") & ~F.col("allow"), "block").otherwise("allow"))
    return found.select("page_id", "host", "path", F.col("best.site").alias("rule"), verdict.alias("verdict"))


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


#: The same rows with every rule run on every URL, the rules written out once more.
OP9_SQL = r"""
WITH u AS (
  SELECT row_number() OVER () AS r, page_id, instr(url, '://') AS spot, url FROM pages),
v AS (
  SELECT r, page_id, CASE WHEN spot > 0 THEN regexp_extract(substr(url, spot + 3), '^[^/?#]*') ELSE '' END AS raw, CASE WHEN spot > 0 THEN regexp_extract(substr(url, spot + 3), '^[^?#]*') ELSE '' END AS target FROM u),
h AS (SELECT r, page_id, translate(coalesce(raw, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(substr(target, length(raw) + 1), '') AS path FROM v),
site(host, path, verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
fits AS (
  SELECT r, s.host || s.path AS rule, verdict, length(s.host || s.path) AS size FROM h JOIN site s
  ON (h.host = s.host OR suffix(h.host, '.' || s.host)) AND starts_with(h.path, s.path)),
best AS (SELECT r, arg_max(rule, size) AS rule, arg_max(verdict, size) AS verdict FROM fits GROUP BY r),
other AS (
  SELECT r,
    regexp_matches(host, '(^|[.-])(casino|free-bets|poker|cheap-pills|pills|xxx|porn)([.-]|$)') OR regexp_matches(host, '(^|\.)ads?\.')
      OR contains(host || path, '/cgi-bin/') OR contains(host || path, '/wp-admin/') AS blocked,
    path = '/robots.txt' AS allowed
  FROM h)
SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN verdict WHEN blocked AND NOT allowed THEN 'block' ELSE 'allow' END AS verdict
FROM h LEFT JOIN best USING (r) LEFT JOIN other USING (r)
"""
