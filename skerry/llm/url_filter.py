"""URL filters by a sort-merge range join.

A url's key is its host with the labels reversed, closed by a dot, then its path:
`http://www.example.com/de/x` becomes `com.example.www./de/x`. A rule on a host covers
the keys that begin with its reversed host, an interval [low, high); the intervals of a
rule set nest or are disjoint. Keys are cut into ranges of even size, every rule is sent
to the ranges its interval meets, and each range is swept in sorted order with a stack
of the rules whose interval is open. Only the rules on the stack, all of them on a host
above the url's, are then tried against the path; the longest (host and path together)
wins, between equals the longer host, and between equal hosts a block.

Defined results: a null url or one without `://` has empty host and path and fits no
rule; so does a path that is empty, as rules' paths begin with `/`. Ties and repeated
rows each get their own row; the hash that spreads equal keys over ranges takes the id
in, so that one hot url may lie in many ranges. Rules with a null host, path or verdict
are refused with a ValueError. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

#: (host, path, verdict) of the registered query.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
DEFAULT = "allow"
#: Keys of a range, and sampled keys a range from which the driver finds its bounds.
RANGE_ROWS = 100_000
SAMPLE_PER_RANGE = 32


def host(url: Column) -> Column:
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def reversed_host(name: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(name, r"\.")), "."), F.lit("."))


def key_of(name: str) -> str:
    return ".".join(reversed(name.split("."))) + "."


def rule_frame(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame([(h, p, v) for h, p, v in rules], "host string, path string, verdict string")


def bounds_of(keys: DataFrame, rows: int) -> list[tuple[str, int]]:
    """Ascending (key, salt) bounds that cut the keys into ranges of about RANGE_ROWS rows."""
    ranges = max(1, -(-rows // RANGE_ROWS))
    if ranges == 1:
        return []
    share = min(1.0, SAMPLE_PER_RANGE * ranges / rows)
    picked = sorted((r.key, r.salt) for r in keys.select("key", "salt").sample(share, seed=7).collect())
    return sorted({picked[i * len(picked) // ranges] for i in range(1, ranges)}) if picked else []


def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Judge rows sorted by (part, key, rules before urls, wider before narrower)."""
    part, stack = None, []
    for batch in batches:
        names, verdicts, keep = [], [], []
        for i, (p, key, kind, own_path, name, verdict) in enumerate(
            zip(batch["part"], batch["key"], batch["kind"], batch["path"], batch["rule"], batch["verdict"], strict=True)
        ):
            if p != part:
                part, stack = p, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                stack.append((key, own_path, name, verdict))
                continue
            best = None
            for low, rule_path, rule_name, rule_verdict in stack:
                if own_path.startswith(rule_path):
                    rank = (len(rule_name), len(low), rule_verdict)
                    if best is None or rank > best[0]:
                        best = (rank, rule_name, rule_verdict)
            keep.append(i)
            names.append(best[1] if best else None)
            verdicts.append(best[2] if best else DEFAULT)
        out = batch.iloc[keep][["id", "host", "path"]].copy()
        out["rule"], out["verdict"] = pd.Series(names, out.index, dtype=object), pd.Series(verdicts, out.index, dtype=object)
        yield out


def judge(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """id, host, path, rule, verdict of every row of `urls` (id, url) under `rules` (host, path, verdict)."""
    if not rules.where("host is null or path is null or verdict is null").isEmpty():
        raise ValueError("a rule without host, path or verdict")
    found = urls.select("id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    found = found.withColumn("salt", F.xxhash64("id")).withColumn("key", F.concat(reversed_host(F.col("host")), F.col("path")))
    found = materialise(found, "url-keys")
    bounds = bounds_of(found, found.count())
    # A range is a partition of its own. A url's range is found by bisection, and so are a rule's first and last.
    place = F.pandas_udf(lambda key, salt: pd.Series([bisect_right(bounds, x) for x in zip(key, salt, strict=True)], dtype="int32"), "int")
    low, high = F.lit(-(2**63)).cast("long"), F.lit(2**63 - 1).cast("long")
    # Sorted by (key, kind): a rule's low end is a prefix of all it covers, so it comes first.
    sides = rules.select(
        F.lit(None).cast(found.schema["id"].dataType).alias("id"), "host", "path", F.lit(0).alias("kind"),
        reversed_host(F.lower("host")).alias("key"), F.concat("host", "path").alias("rule"), "verdict",
    )
    first, last = place(F.col("key"), low), place(F.concat("key", F.lit("\U0010ffff")), high)
    sides = sides.withColumn("first", first).withColumn("last", last).withColumn("part", F.explode(F.sequence("first", "last"))).drop("first", "last")
    own = found.select("id", "host", "path", F.lit(1).alias("kind"), "key", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"), place(F.col("key"), F.col("salt")).alias("part"))
    both = own.unionByName(sides).repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", "key", "kind", F.length("path"))
    kind = found.schema["id"].dataType.simpleString()
    return both.mapInPandas(sweep, f"id {kind}, host string, path string, rule string, verdict string")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url")
    return judge(pages, rule_frame(spark, RULES)).withColumnRenamed("id", "page_id")


OP9_SQL = r"""
WITH u AS (SELECT page_id,
  translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(rh, rp, rv) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
j AS (SELECT page_id, host, path, rh || rp AS rule, rv, length(rh || rp) AS n, length(rh) AS h FROM u
  LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, arg_max(rule, (n, h, rv)) AS rule, coalesce(arg_max(rv, (n, h, rv)), 'allow') AS verdict
FROM j GROUP BY page_id, host, path
"""
