"""URL rules by host-suffix and path-prefix expressions, short hash prefixes and full digests."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh

#: The rules of the registered query: (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Hexadecimal digits of a digest that the equi-join uses (32 bits).
PREFIX_DIGITS = 8

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPLIT = r"://([^/?#]*)([^?#]*)"


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """(rule, rule_host, rule_path, rule_verdict, prefix, digest) of (verdict, host, path) rules."""
    rows = [(h.translate(str.maketrans(_UPPER, _LOWER)), p, v) for v, h, p in rules]
    if any(v not in ("allow", "block") for _, _, v in rows):
        raise ValueError("a rule's verdict is allow or block")
    table = spark.createDataFrame(rows, "rule_host string, rule_path string, rule_verdict string")
    return table.select(
        F.concat("rule_host", "rule_path").alias("rule"), "rule_host", "rule_path", "rule_verdict"
    ).select(
        "*",
        F.sha2("rule", 256).alias("digest"),
        F.substring(F.sha2("rule", 256), 1, PREFIX_DIGITS).alias("prefix"),
    )


def judge_urls(
    pages: DataFrame,
    rules: Iterable[tuple[str, str, str]],
    url_col: str = "url",
    default: str = "allow",
) -> DataFrame:
    """``pages`` (its columns, without those of the result's names) with host, path, rule, verdict.

    Each distinct (host, path) becomes expressions: a suffix of the host at a label border and a
    prefix of the path, at the label counts and path lengths that rules have, since no other
    expression can equal a rule. The expressions meet the rules on 32 bits of their SHA-256; pairs
    are confirmed by the whole digest and by host and path. Of the rules that fit, the longest
    wins; among equals the longer host, then block. Without one the verdict
    is ``default``. Expressions are made per distinct (host, path), so a host that holds a third of
    all pages is not expanded again and again; rules are joined as the planner sees fit from their
    size, verdicts come back by an equi-join on host and path.

    Defined cases: a null url or one without ``://`` has empty host and path and fits no rule;
    repeated rows are all returned; an empty table gives an empty result.
    """
    rules = list(rules)
    spark = pages.sparkSession
    split = [F.coalesce(F.regexp_extract(url_col, _SPLIT, i), F.lit("")) for i in (1, 2)]
    added = {"host", "path", "rule", "verdict"}
    kept = [c for c in pages.columns if c.lower() not in added]
    parsed = pages.select(*kept, F.translate(split[0], _UPPER, _LOWER).alias("host"), split[1].alias("path"))
    labels = sorted({h.count(".") + 1 for _, h, _ in rules}) or [1]
    lengths = sorted({len(p) for _, _, p in rules}) or [0]
    parts = F.split("host", r"\.", -1)
    suffix = F.transform(
        F.filter(F.array(*map(F.lit, labels)), lambda n: n <= F.size(parts)),
        lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."),
    )
    prefix = F.transform(
        F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("path")),
        lambda n: F.col("path").substr(F.lit(1), n),
    )
    pairs = F.flatten(
        F.transform(suffix, lambda h: F.transform(prefix, lambda p: F.struct(h.alias("h"), p.alias("p"))))
    )
    expressions = (
        parsed.select("host", "path")
        .distinct()
        .select("host", "path", F.explode(pairs).alias("e"))
        .select("host", "path", "e.h", "e.p", F.sha2(F.concat("e.h", "e.p"), 256).alias("full"))
        .withColumn("prefix", F.substring("full", 1, PREFIX_DIGITS))
    )
    met = expressions.join(rule_table(spark, rules), "prefix").where(
        "full = digest and h = rule_host and p = rule_path"
    )
    order = F.struct(
        F.length("rule").alias("a"),
        F.length("rule_host").alias("b"),
        (F.col("rule_verdict") == "block").alias("c"),
    )
    best = fresh("best", kept)
    found = met.groupBy("host", "path").agg(
        F.max(F.struct(order.alias("o"), F.struct("rule", "rule_verdict").alias("r"))).alias(best)
    )
    return parsed.join(found, ["host", "path"], "left").select(
        *kept,
        "host",
        "path",
        F.col(f"{best}.r.rule").alias("rule"),
        F.coalesce(f"{best}.r.rule_verdict", F.lit(default)).alias("verdict"),
    )


SQL = r"""
with rules(v, h, p) as (
  values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
         ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), parsed as (
  select page_id,
         coalesce(translate(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
         coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') as path
  from pages
)
select page_id, host, path, max_by(h || p, length(h || p)) as rule,
       coalesce(max_by(v, length(h || p)), 'allow') as verdict
from (select row_number() over () as n, * from parsed) t
left join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p)
group by n, page_id, host, path
"""


def op7_url_filters(spark, sf_dir):
    """Verdicts for every url of the whole pages table."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, RULES).select("page_id", "host", "path", "rule", "verdict")
