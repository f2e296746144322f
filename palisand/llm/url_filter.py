"""URL filters: host-suffix and path-prefix expressions, short hash prefixes, full digests, rule precedence.

A rule is a host and a path prefix.  It fits a URL whose host is the rule's or
ends in "." and the rule's, and whose path starts with the rule's path.  Each distinct
(host, path) is expanded into the expressions that some rule could be: host
suffixes of as many labels, path prefixes of as many characters, as rules have.
Expressions and rules meet by an equi-join on the first 32 bits of their SHA-256
digests; full digests confirm.  Of the rules that fit, the longest (host and
path together) wins, then the longer host, then block over allow.

Cases: a null URL and one without "://" have an empty host and an empty path, which
no rule fits; repeated pages each keep their row; URLs that no rule fits get the default verdict; a
rule with a null or empty host fits nothing, a null path is an empty prefix; two rules of the same
host and path: block wins; an empty table of pages or rules is fine.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisand.llm.shared import ascii_lower, looked_up, staged

#: Characters of the hexadecimal digest by which expressions and rules are joined.
SHORT = 8


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(action, host, path) triples as a table."""
    return spark.createDataFrame(list(rules), "action string, host string, path string")


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\x00"), path), 256)


def expressions(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """host, path, digest: every expression of each distinct (host, path) that has the shape
    (labels of the host, characters of the path) of a rule.  Shapes are few, whatever the
    number of rules; they stay a table and are joined by the number of labels."""
    labels = F.split("host", r"\.")
    shapes = rules.groupBy(F.size(F.split("rule_host", r"\.")).alias("take")).agg(F.collect_set(F.length("rule_path")).alias("lengths"))
    n = F.size(labels)
    cut = urls.select("host", "path").filter("host <> ''").distinct().withColumn("take", F.explode(F.sequence(F.lit(1), n)))
    return (
        looked_up(cut, staged(shapes, "rule-shapes"), "take", "inner", F.col("path"))
        .withColumn("suffix", F.array_join(F.slice(labels, n - F.col("take") + 1, F.col("take")), "."))
        .withColumn("length", F.explode(F.filter("lengths", lambda x: x <= F.length("path"))))
        .select("host", "path", digest(F.col("suffix"), F.expr("substring(path, 1, length)")).alias("digest"))
    )


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    keyed = rules.select("action", F.col("host").alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path")).filter("rule_host <> ''")
    keyed = keyed.groupBy("rule_host", "rule_path").agg(F.max("action").alias("action"))  # block comes after allow
    keyed = keyed.withColumn("rule_digest", digest(F.col("rule_host"), F.col("rule_path"))).withColumn("short", F.substring("rule_digest", 1, SHORT))
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    asked = expressions(urls, keyed).withColumn("short", F.substring("digest", 1, SHORT))
    found = (
        looked_up(asked, staged(keyed, "rules"), "short", "inner", F.struct("host", "path"))
        .filter(F.col("digest") == F.col("rule_digest"))
        .groupBy("host", "path")
        .agg(
            F.max_by(
                F.struct(F.concat("rule_host", "rule_path").alias("rule"), "action"),
                F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_host"), "action"),
            ).alias("best")
        )
    )
    # many pages may share a (host, path), and those without a host share the empty one
    return looked_up(urls, staged(found, "fitting-rules"), ["host", "path"], "left", F.col("page_id")).select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict")
    )
