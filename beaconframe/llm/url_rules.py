"""URL filters as a sort-merge range join, with DataFrame functions only.

A host is reversed label by label (``www.example.com`` -> ``com.example.www.``), which
turns "this host and all its subdomains" into the key interval ``[key, successor(key))``.
Such intervals nest or are disjoint.  The rules' interval bounds are swept in order with a
stack of the rules that are open there; each bound becomes a *segment* that carries its
stack.  Urls and segments are then merged in key order, and each url takes the stack of the
last segment at or before it.  Of that stack, the longest rule whose path starts the url's
path wins.

Scale: urls are dealt over shards by row, not by key, so that one hot host or suffix is
spread evenly, and each shard sweeps its own sorted run in one streaming window.  The
segments (at most two for each rule) are repeated in each shard; beyond
``segments_per_range`` of them the key space is cut into ranges, and a shard gets only the
segments of its range (with the one that is open at its start).
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class UrlRule(NamedTuple):
    verdict: str
    host: str
    path: str = "/"


#: The rules that the query states.
RULES = (
    UrlRule("allow", "com", "/"),
    UrlRule("block", "example.com", "/en/"),
    UrlRule("allow", "www.example.com", "/en/"),
    UrlRule("block", "net", "/es/"),
    UrlRule("block", "net", "/fr/"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; empty if there is none."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    """Labels in reverse order, each followed by a dot, so that subdomains share a prefix."""
    return F.when(host == "", F.lit("")).otherwise(
        F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))
    )


def _rule_frame(spark: SparkSession, rules: Sequence[UrlRule]) -> DataFrame:
    """A short list of rules as rows of literals."""
    rows = [F.struct(F.lit(i).alias("no"), F.lit(r.verdict).alias("verdict"), F.lit(r.host).alias("host"), F.lit(r.path).alias("path"), F.lit(r.host + r.path).alias("rule")) for i, r in enumerate(rules)]
    none = F.array(F.struct(*(F.lit(None).cast(k).alias(n) for n, k in (("no", "int"), ("verdict", "string"), ("host", "string"), ("path", "string"), ("rule", "string")))))
    return spark.range(1).select(F.inline(F.array(*rows) if rows else none)).where("no IS NOT NULL")


#: A rule on the stack, and a segment of the swept key space.
_RULE = "struct<k:string,e:string,no:int,verdict:string,rhost:string,rpath:string,rule:string>"
_SEGMENT = f"struct<seg_key:string,stack:array<{_RULE}>>"


def _segments(rules: DataFrame, n_ranges: int) -> DataFrame:
    """(range, seg_key, stack): the sorted bounds of the rules, each with its open rules.

    The sweep runs in each range over the rules that touch it: those that begin there, and
    those that began before and are open at its start.
    """
    k = reversed_host(F.translate(F.col("host"), _UPPER, _LOWER))
    # A key ends with '.', and '/' follows it in byte order.
    rules = rules.withColumn("k", k).withColumn("e", F.concat(F.expr("left(k, length(k) - 1)"), F.lit("/")))
    bounds = rules.select(F.explode(F.array("k", "e")).alias("seg_key")).distinct()
    rule = F.struct("k", "e", "no", "verdict", F.col("host").alias("rhost"), F.col("path").alias("rpath"), "rule").cast(_RULE)
    rules = rules.select("k", "e", rule.alias("r"))
    if n_ranges == 1:
        bounds, rules = bounds.withColumn("range", F.lit(0)), rules.withColumn("range", F.lit(0))
    else:
        bounds = bounds.withColumn("range", F.ntile(n_ranges).over(Window.orderBy("seg_key")) - 1)
        ends = bounds.groupBy("range").agg(F.min("seg_key").alias("lo"), F.max("seg_key").alias("hi"))
        rules = rules.join(ends, (F.col("k") <= F.col("hi")) & (F.col("e") > F.col("lo")))
    events = (
        bounds.groupBy("range").agg(F.array_sort(F.collect_list("seg_key")).alias("keys"))
        .join(rules.groupBy("range").agg(F.array_sort(F.collect_list("r")).alias("rs")), "range")
    )
    # One pass over a range's sorted bounds: pop what ended, push what begins.
    swept = F.expr(f"""
        aggregate(keys, CAST(array() AS array<{_SEGMENT}>), (out, at) -> concat(out, array(named_struct(
          'seg_key', at,
          'stack', concat(
            filter(coalesce(try_element_at(out, -1).stack, CAST(array() AS array<{_RULE}>)), x -> x.e > at),
            filter(rs, x -> x.e > at AND (x.k = at OR (x.k < at AND size(out) = 0))))))))""")
    return events.select("range", F.explode(swept).alias("s")).select("range", "s.seg_key", "s.stack")


def judge_urls(
    pages: DataFrame,
    rules: Sequence[UrlRule] | DataFrame = RULES,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    rows_per_shard: int = 50_000,
    segments_per_range: int = 2_000,
) -> DataFrame:
    """(id, host, path, rule, verdict) of each row of ``pages``.

    A rule fits its host and all subdomains if the url's path starts with the rule's path.
    The longest host wins, then the longest path, then the first rule in the list.  As a
    DataFrame, ``rules`` has the columns (no int, verdict, host, path, rule).

    Null urls and urls without ``://`` have an empty host and path, fit no rule and get
    ``default``.  Null ids and repeated rows pass through, one result row for each input
    row.  An empty table gives no rows; without rules all rows get ``default``.  Columns of
    ``pages`` other than these two are not read.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = _rule_frame(spark, rules)
    n_ranges = max(1, -(-2 * rules.count() // segments_per_range))
    n_shards = max(16 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-pages.count() // rows_per_shard))
    segments = _segments(rules, n_ranges)
    urls = pages.select(F.col(id_col).alias("id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    where = F.lit(0)
    if n_ranges > 1:
        # One bound for each range; a range holds ``segments_per_range`` segments.
        starts = segments.groupBy("range").agg(F.min("seg_key").alias("lo")).where("range > 0").collect()
        where = sum((F.when(F.col("key") >= F.lit(r["lo"]), 1).otherwise(0) for r in starts), where)
    dealt = (
        urls.withColumn("key", reversed_host(F.col("host")))
        .withColumn("range", where)
        .withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_shards)))
        .withColumn("is_url", F.lit(True))
    )
    copies = segments.select(
        "range", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1)).cast("array<long>")).alias("shard"),
        F.col("seg_key").alias("key"), F.lit(False).alias("is_url"), "stack",
    )
    sweep = Window.partitionBy("range", "shard").orderBy("key", "is_url").rowsBetween(Window.unboundedPreceding, 0)
    met = (
        dealt.unionByName(copies, allowMissingColumns=True)
        .withColumn("open", F.last("stack", ignorenulls=True).over(sweep))
        .where("is_url")
        .withColumn("open", F.filter("open", lambda r: F.startswith(F.col("path"), r["rpath"])))
    )
    in_order = F.transform(
        "open", lambda r: F.struct((-F.length(r["rhost"])).alias("a"), (-F.length(r["rpath"])).alias("b"), r["no"].alias("no"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))
    )
    return met.withColumn("best", F.array_min(in_order)).select(
        F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"),
    )
