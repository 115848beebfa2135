"""URL rules as a sort-merge range join, with DataFrame functions alone.

A host's labels in reverse, each with a full stop behind it, make a key under which a host and
all its subdomains share a prefix. So the hosts of a rule are the interval from its key to that
key with the last full stop replaced by the next character, a slash. Intervals of two rules lie
within each other or apart. URLs and interval bounds are sorted by key into buckets of even size,
and a sweep carries the stack of rules that are open at each bound to the URLs behind it. The
longest rule of the stack whose path begins the URL's decides.

The sort key ends with a hash of the row, so a host with any share of all URLs spreads over
many buckets. Each bucket begins with the stack that is open there.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, UPPER, pick

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
SAMPLED = 64
"""Keys per bucket that are sampled to place the buckets' bounds."""
BUCKETS_PER_PARTITION = 2


def host_and_path(url: Column) -> tuple[Column, Column]:
    host, path = (F.coalesce(F.regexp_extract(url, _URL, i), F.lit("")) for i in (1, 2))
    return F.translate(host, UPPER, LOWER), path


def _labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def _key(labels: Column) -> Column:
    return F.concat(F.array_join(labels, "."), F.lit("."))


def _stacks(points: DataFrame, rules: DataFrame) -> DataFrame:
    """``at, stack`` for ``points(at, labels)``: the rules of the labels' host and hosts above it."""
    above = F.transform(F.sequence(F.lit(1), F.size("labels")), lambda n: _key(F.slice("labels", 1, n)))
    keys = points.select("at", F.explode_outer(F.when(F.size("labels") > 0, above)).alias("key"))
    rule = F.struct(F.length("rule").alias("n"), F.length("host").alias("host_n"), "rule", "path", "verdict")
    own = rules.select(_key(_labels(F.col("host"))).alias("key"), rule.alias("open"))
    return keys.join(own, "key", "left").groupBy("at").agg(F.collect_list("open").alias("stack"))


def _bucket(at: Column, bounds: list[str]) -> Column:
    """How many of the sorted bounds are at or before the key, looked up in two steps."""
    if not bounds:
        return F.lit(0)
    width = math.isqrt(len(bounds)) + 1
    every = F.array(*map(F.lit, bounds))
    coarse = F.array(*map(F.lit, bounds[width - 1 :: width] or [bounds[-1] + "￿"]))
    before = F.size(F.filter(coarse, lambda x: x <= at)) * width
    return before + F.size(F.filter(F.slice(every, before + 1, width), lambda x: x <= at))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict`` for each row of ``pages(page_id, url)``.

    ``rules(host, path, verdict)`` are a rule list: it is joined by key, and what one host and
    the hosts above it have is carried as one array. Rules without a host are ignored, a null
    path is empty, and repeated rules count once. The longest fitting rule wins (host and path
    together, then the longer host, then the later by text); ``rule`` is null and the verdict the
    default where none fits. A null URL or one without ``://`` has an empty host and path, which
    no rule fits. Repeated rows are judged each. Without pages there are no rows.
    """
    spark = pages.sparkSession
    lists = pick(rules, "host", "path", "verdict").filter("host is not null and host <> ''")
    lists = lists.select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").distinct()
    lists = lists.withColumn("rule", F.concat("host", "path"))

    host, path = host_and_path(F.col("url"))
    urls = pick(pages, "page_id", "url").select("page_id", host.alias("host"), path.alias("path"), F.hex(F.xxhash64("page_id", "url")).alias("salt"))
    urls = urls.select("page_id", "host", "path", F.concat(_key(_labels(F.col("host"))), F.lit("\0"), "salt").alias("at"))

    buckets = BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    sample = sorted(r.at for r in urls.select("at").orderBy(F.xxhash64("at"), "at").limit(SAMPLED * buckets).collect())
    bounds = sorted({sample[len(sample) * i // buckets] for i in range(1, buckets)}) if sample else []

    hosts = lists.select("host").distinct().select(_labels(F.col("host")).alias("labels"))
    begin = hosts.select(_key(F.col("labels")).alias("at"), "labels")
    end = hosts.select(F.concat(F.array_join("labels", "."), F.lit("/")).alias("at"), F.slice("labels", 1, F.size("labels") - 1).alias("labels"))
    points = begin.union(end)
    if bounds:
        starts = spark.createDataFrame([(x,) for x in bounds], "at string")
        of_key = F.split(F.regexp_replace(F.substring_index("at", "\0", 1), r"\.$", ""), r"\.")
        points = points.union(starts.select("at", of_key.alias("labels")))
    opened = _stacks(points, lists)

    events = urls.withColumn("stack", F.lit(None).cast(opened.schema["stack"].dataType)).withColumn("is_url", F.lit(True))
    events = events.unionByName(opened.withColumn("is_url", F.lit(False)), allowMissingColumns=True)
    order = Window.partitionBy("bucket").orderBy("at", "is_url").rowsBetween(Window.unboundedPreceding, 0)
    swept = events.withColumn("bucket", _bucket(F.col("at"), bounds)).withColumn("open", F.last("stack", ignorenulls=True).over(order))
    best = F.array_max(F.filter("open", lambda x: F.col("path").startswith(x.path)))
    found = swept.filter("is_url").select("page_id", "host", "path", best.alias("best"))
    return found.select("page_id", "host", "path", "best.rule", F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
