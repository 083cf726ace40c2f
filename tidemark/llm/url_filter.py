"""URL filters: host-suffix x path-prefix expressions joined to a rule list by hash prefix.

A rule is ``host + path`` (``example.org/en/1``). It fits its host and all subdomains when the
url's path starts with the rule's path; the longest fitting rule decides, then the longer host,
then ``block`` before ``allow``. A url that no rule fits gets the default verdict.

Every url is expanded into its host suffixes and path prefixes - only those of the label counts
and path lengths that the rule list has, which are few however long it is - and the expressions are
equi-joined with the rules on the first 32 bits of a SHA-256 digest; the full digest then confirms.
All of it is JVM-side. The rules are a table of any size; it is broadcast only if it is counted to
have at most ``BROADCAST_RULES`` rows.

Defined cases: a null url, or one without ``://``, has empty host and path and no rule; an empty
rule list gives every url the default; rules without a verdict, without a slash or null are left
out; repeated rows stay repeated; of rules that repeat the greater verdict counts; columns of the
input named like a result column are replaced by the result, and names of inner columns do not meet
those of the input. A url's verdict is found once however often it stands; null urls are spread.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.staging import staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: hex digits of the digest that the join uses
HASH_PREFIX = 8
#: rule lists up to this many rules (about 200 bytes each) are broadcast; larger ones are shuffled
BROADCAST_RULES = 50_000
RESULT = ("host", "path", "rule", "verdict")


def url_host(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed(spark: SparkSession, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """A short list of ``(verdict, rule)`` as a JVM-side table."""
    rows = [F.struct(F.lit(v).alias("verdict"), F.lit(r).alias("rule")) for v, r in rules]
    empty = F.expr("cast(array() as array<struct<verdict:string,rule:string>>)")
    return spark.range(1).select(F.inline(F.array(*rows) if rows else empty))


def rule_table(rules: DataFrame) -> DataFrame:
    """Distinct rules with ``labels`` of the host, ``length`` of the path, digest and its prefix."""
    usable = rules.where("rule is not null and verdict is not null and instr(rule, '/') > 0")
    table = usable.groupBy("rule").agg(F.max("verdict").alias("verdict"))
    digest, slash = F.sha2(F.col("rule"), 256), F.instr("rule", "/")
    return table.select("rule", "verdict", slash.alias("host_len"), F.size(F.split(F.substring_index("rule", "/", 1), r"\.")).alias("labels"), (F.length("rule") - slash + 1).alias("length"), digest.alias("digest"), F.substring(digest, 1, HASH_PREFIX).alias("prefix"))


def _joined(suffix: Column, prefixes: Column) -> Column:
    return F.transform(prefixes, lambda p: F.concat(suffix, p))


def expressions(host: Column, path: Column, shapes: Sequence[tuple[int, Sequence[int]]]) -> Column:
    """Host suffixes of so many labels, each with path prefixes of so many characters."""
    n = F.size(F.split(host, r"\."))
    out = F.expr("cast(array() as array<string>)")
    for labels, lengths in shapes:
        fitting = F.filter(F.array(*map(F.lit, lengths)), lambda m: m <= F.length(path))
        prefixes = F.transform(fitting, lambda m: F.substring(path, F.lit(1), m))
        made = _joined(F.substring_index(host, ".", -labels), prefixes)
        out = F.concat(out, F.when((n >= labels) & (host != ""), made).otherwise(F.expr("cast(array() as array<string>)")))
    return out


def filter_urls(df: DataFrame, rules: DataFrame | Sequence[tuple[str, str]], url: str = "url", default: str = "allow") -> DataFrame:
    """``df`` with ``host``, ``path``, ``rule`` and ``verdict`` of its ``url`` column. ``rules`` has
    columns ``verdict`` and ``rule``, or is a short list of such pairs."""
    table = staged(rule_table(rules if isinstance(rules, DataFrame) else listed(df.sparkSession, rules)), "rules", narrow=True)
    # as many rows as label counts, with the path lengths that go with them: bounded by a rule's length
    shapes = [(r.labels, sorted(r.lengths)) for r in table.groupBy("labels").agg(F.collect_set("length").alias("lengths")).orderBy("labels").collect()]
    short = table.count() <= BROADCAST_RULES
    table = table.select("rule", "verdict", "host_len", "digest", "prefix")
    keep = [c for c in df.columns if c not in RESULT or c == url]
    rows = df.select(F.struct(*keep).alias("kept"), F.col(url).alias("url"))
    # a url's verdict depends on the url alone: hot urls are judged once
    urls = rows.select("url").where("url is not null").distinct()
    found = (
        urls.select("url", F.explode(expressions(url_host(F.col("url")), url_path(F.col("url")), shapes)).alias("expr"))
        .select("url", F.sha2("expr", 256).alias("full"))
        .select("url", "full", F.substring("full", 1, HASH_PREFIX).alias("prefix"))
        .join(F.broadcast(table) if short else table, "prefix")
        .where(F.col("full") == F.col("digest"))
    )
    best = found.groupBy("url").agg(F.max(F.struct(F.length("rule").alias("n"), "host_len", "verdict", "rule")).alias("best"))
    # a key that no url with a rule has, as it holds no '://'
    spread = F.concat(F.lit("null "), F.xxhash64("kept").cast("string"))
    judged = rows.withColumn("key", F.coalesce("url", spread)).join(best.withColumnRenamed("url", "key"), "key", "left")
    return judged.select(
        *[F.col("kept").getField(c).alias(c) for c in keep],
        url_host(F.col("url")).alias("host"),
        url_path(F.col("url")).alias("path"),
        F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"),
    )
