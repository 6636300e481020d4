"""URL filters: a sort-merge range join of urls with nested host and path rules.

A host turns into a canonical key of its labels in reverse order, each ended by
a dot (``blog.example.net`` -> ``net.example.blog.``). All hosts under a rule's
host then share the rule's key as a prefix, so a rule covers one interval of the
sorted keys, and the intervals of two rules are either nested or disjoint.

The sweep sorts urls and rules together by key and walks down the order with a
stack of rules: slot *d* of the stack holds the last rule host of *d* labels that
was passed. A slot is active for a url as long as the url's key still starts
with the slot's key. Since active rules are nested, a slot for each number of
labels is the whole stack. The stack is a set of running window columns, so the
sweep is plain DataFrame code.

Work is dealt out by the last two labels of the host (the *zone*). Zones of many
urls are dealt to several salts, each of which gets the zone's rules. The sorted
run of one task thus stays under ``rows_per_run`` urls, save for chance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.llm.common import cut

RULES_SCHEMA = "host string, path string, action string"


def url_host(url: Column) -> Column:
    """Text after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(host, upper, lower), F.lit(""))


def url_path(url: Column) -> Column:
    """Text after the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(/[^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _zone(key: Column, labels: int) -> Column:
    return F.substring_index(key, ".", labels)


def judge(
    urls: DataFrame,
    rules: DataFrame,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    rows_per_run: int = 4096,
) -> DataFrame:
    """Return ``id_col, host, path, rule, verdict`` for each row of ``urls``.

    ``rules`` has ``host, path, action``. A rule fits its host and all subdomains
    if the url's path starts with the rule's path; of the fitting rules the
    longest (host and path together) wins, and between equal lengths the one of
    the longer host. No fitting rule: rule null, verdict ``default``.

    Defined cases: a null url or one without ``://`` has empty host and path and
    fits no rule. Repeated ids or urls are judged row by row. Rules with a null
    field are ignored; of rules with the same host and path the alphabetically
    first action counts. An empty table of urls or rules works. Extra columns of
    either table are ignored.

    The path rules of one host travel together in one row.
    """
    pages = (
        urls.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
        .select("id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
        .withColumn("key", host_key(F.col("host")))
        .withColumn("zone", _zone(F.col("key"), 2))
    )
    hosts = (
        rules.select("host", "path", "action")
        .dropna()
        .groupBy("host", "path")
        .agg(F.min("action").alias("action"))
        .groupBy(host_key(F.col("host")).alias("key"))
        .agg(F.sort_array(F.collect_list(F.struct(F.length("path").alias("len"), "path", "host", "action")), asc=False).alias("paths"))
        .withColumn("labels", F.size(F.split("key", r"\.")) - 1)
    )
    depths = [r["labels"] for r in hosts.select("labels").distinct().collect()]  # at most 127 by the limits of host names
    if not depths:
        return pages.select(F.col("id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))

    zones = cut(pages.groupBy("zone").count().withColumn("salts", F.ceil(F.col("count") / rows_per_run).cast("int")))
    # A zone of more than one salt has over rows_per_run urls, so there are few of them.
    crowded = zones.filter("salts > 1").select("zone", "salts")
    row_hash = F.xxhash64("id", "host", "path")
    points = (
        pages.join(crowded, "zone", "left")
        .withColumn("salt", F.pmod(row_hash, F.coalesce("salts", F.lit(1))).cast("int"))
        .select("zone", "salt", "key", F.lit(1).alias("kind"), "id", "host", "path")
    )
    deep = hosts.filter("labels >= 2").withColumn("zone", _zone(F.col("key"), 2)).join(zones.select("zone", "salts"), "zone")
    # A rule on one label, such as a top-level domain, goes to each zone under it.
    shallow = (
        hosts.filter("labels < 2")
        .withColumn("top", _zone(F.col("key"), 1))
        .join(zones.select("zone", "salts", _zone(F.col("zone"), 1).alias("top")), "top")
        .select("zone", "key", "paths", "labels", "salts")
    )
    starts = (
        deep.select("zone", "key", "paths", "labels", "salts")
        .unionByName(shallow)
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        .select("zone", "salt", "key", F.lit(0).alias("kind"), "labels", "paths")
    )
    swept = points.unionByName(starts, allowMissingColumns=True)
    down = W.partitionBy("zone", "salt").orderBy("key", "kind").rowsBetween(W.unboundedPreceding, 0)
    for d in depths:
        here = F.when((F.col("kind") == 0) & (F.col("labels") == d), F.struct("key", "paths"))
        swept = swept.withColumn(f"slot{d}", F.last(here, ignorenulls=True).over(down))

    def fitting(d: int) -> Column:
        slot = F.col(f"slot{d}")
        fits = F.filter(slot["paths"], lambda p: F.col("path").startswith(p["path"]))
        best = F.element_at(F.when(F.size(fits) > 0, fits), 1)  # the longest path comes first
        return F.when(
            slot.isNotNull() & F.col("key").startswith(slot["key"]) & best.isNotNull(),
            F.struct((F.length(best["host"]) + best["len"]).alias("len"), F.lit(d).alias("labels"), best["host"].alias("host"), best["path"].alias("path"), best["action"].alias("action")),
        )

    won = F.array_max(F.array_compact(F.array(*[fitting(d) for d in sorted(depths)])))
    return (
        swept.filter("kind = 1")
        .withColumn("won", won)
        .select(
            F.col("id").alias(id_col),
            "host",
            "path",
            F.concat(F.col("won.host"), F.col("won.path")).alias("rule"),
            F.coalesce(F.col("won.action"), F.lit(default)).alias("verdict"),
        )
    )


#: The rules of query op2, as its contract gives them.
CONTRACT_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
