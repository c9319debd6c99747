"""Temporal list join: every capture is judged by the list entries that were active when it was fetched.

Dated entries (pattern, action, entry_date) become validity intervals per pattern: an entry holds until the
pattern's next entry. A capture asks for each suffix of its host and for its host with each leading path
segment; the longest pattern that is active on the fetch date decides. The as-of join is a merge: probes and
intervals of a pattern are ordered by date and each probe takes the last interval begun. Probes are first
reduced to distinct (pattern, date), so a host with a third of all captures costs one row a day there, and
only the final lookup sees its captures, in a plain equi-join whose large partitions can be split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and a final dot; null where the url has none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.nullif(F.regexp_replace(host, r"\.$", ""), F.lit(""))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def patterns_of(url: Column) -> Column:
    """Host suffixes of two labels or more, and the host with each leading path segment, one up to all."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(labels) - 1)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    segments = F.filter(F.split(path_of(url), "/"), lambda s: s != "")
    paths = F.transform(segments, lambda _, i: F.concat(host, F.lit("/"), F.array_join(F.slice(segments, F.lit(1), i + 1), "/")))
    return F.when(host.isNull(), F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(suffixes, paths)))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(pattern, verdict, valid_from, valid_to) from dated entries; of several on one date the highest entry_id holds.

    ``remove`` ends the pattern. Entries with a null pattern or date are void. The last interval is open (null).
    """
    daily = (
        entries.where(F.col("pattern").isNotNull() & F.col("entry_date").isNotNull())
        .groupBy("pattern", "entry_date")
        .agg(F.max_by("action", F.struct(F.coalesce("entry_id", F.lit(-1)), "action")).alias("verdict"))
    )
    after = F.lead("entry_date").over(Window.partitionBy("pattern").orderBy("entry_date"))
    return daily.select("pattern", "verdict", F.col("entry_date").alias("valid_from"), after.alias("valid_to"))


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Judge ``captures`` (page_id, url, fetch_date) by ``entries`` (entry_id, pattern, action, entry_date).

    Returns page_id, url, fetch_date, verdict (block, allow or none), pattern, valid_from, valid_to: one row for
    each capture, repeated rows included. A null or hostless url and a null fetch date match nothing. Equally
    long patterns of one url are the same string, so there are no ties. No entries: every verdict is ``none``.
    """
    rows = captures.groupBy("page_id", "url", "fetch_date").agg(F.count(F.lit(1)).alias("copies"))
    asked = rows.withColumn("pattern", F.explode_outer(patterns_of(F.col("url"))))
    probes = (
        captures.select(F.explode(patterns_of(F.col("url"))).alias("pattern"), F.col("fetch_date").alias("at"))
        .where(F.col("at").isNotNull())
        .distinct()
        .select("pattern", "at", F.lit(1).alias("kind"), F.lit(None).cast("struct<verdict:string,valid_from:date,valid_to:date>").alias("held"))
    )
    begun = validity_intervals(entries).select(
        "pattern", F.col("valid_from").alias("at"), F.lit(0).alias("kind"), F.struct("verdict", "valid_from", "valid_to").alias("held")
    )
    order = Window.partitionBy("pattern").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    active = (
        begun.unionByName(probes)
        .withColumn("held", F.last("held", ignorenulls=True).over(order))
        .where((F.col("kind") == 1) & F.col("held").isNotNull() & (F.col("held.verdict") != "remove"))
        .select("pattern", F.col("at").alias("fetch_date"), "held")
    )
    judged = (
        asked.join(active, ["pattern", "fetch_date"], "left")
        .groupBy("page_id", "url", "fetch_date", "copies")
        .agg(F.max(F.when(F.col("held").isNotNull(), F.struct(F.length("pattern").alias("len"), "pattern", "held"))).alias("best"))
    )
    return judged.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(
        "page_id", "url", "fetch_date",
        F.coalesce("best.held.verdict", F.lit("none")).alias("verdict"),
        F.col("best.pattern").alias("pattern"),
        F.col("best.held.valid_from").alias("valid_from"),
        F.col("best.held.valid_to").alias("valid_to"),
    )


def listed_history(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts and paths that occur, drawn by digests of the patterns (no list ships with the data)."""
    known = pages.select(F.explode(patterns_of(F.col("url"))).alias("pattern")).distinct()
    digest = known.withColumn("h", F.conv(F.substring(F.md5("pattern"), 1, 6), 16, 10).cast("long")).where(F.col("h") % 3 == 0)
    h = F.col("h")
    first = F.date_add(F.lit("2024-01-01").cast("date"), (h % 200).cast("int"))
    gone = F.date_add(first, (F.lit(30) + F.floor(h / 11) % 120).cast("int"))
    action = F.when(F.floor(h / 7) % 4 == 0, "allow").otherwise("block")
    events = F.array(
        F.struct(F.lit(1).alias("entry_id"), action.alias("action"), first.alias("entry_date")),
        F.when(F.floor(h / 3) % 2 == 0, F.struct(F.lit(2).alias("entry_id"), F.lit("remove").alias("action"), gone.alias("entry_date"))),
        F.when(F.floor(h / 5) % 2 == 0, F.struct(F.lit(3).alias("entry_id"), F.lit("block").alias("action"), F.date_add(gone, 40).alias("entry_date"))),
    )
    return digest.select("pattern", F.explode(F.filter(events, lambda e: e.isNotNull())).alias("e")).select("pattern", "e.*")


def captures_of(pages: DataFrame) -> DataFrame:
    """pages with the fetch date that the tables lack, drawn from the page id."""
    day = F.pmod(F.col("page_id") * 37, F.lit(366)).cast("int")
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), day).alias("fetch_date"))


ORACLE = r"""
WITH u AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST((page_id * 37) % 366 AS INT) AS fetch_date,
         nullif(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '\.$', ''), '') AS host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) AS path
  FROM pages),
s AS (SELECT *, string_split(host, '.') AS labels, list_filter(string_split(path, '/'), lambda x: x <> '') AS segs FROM u),
k AS (
  SELECT page_id, url, fetch_date, list_distinct(list_concat(
    list_transform(range(1, greatest(1, len(labels) - 1) + 1), lambda i: array_to_string(labels[i:], '.')),
    list_transform(range(1, len(segs) + 1), lambda i: host || '/' || array_to_string(segs[1:i], '/')))) AS keys
  FROM s WHERE host IS NOT NULL),
a AS (SELECT page_id, url, fetch_date, unnest(keys) AS pattern FROM k),
d AS (SELECT pattern, CAST(concat('0x', substr(md5(pattern), 1, 6)) AS BIGINT) AS h FROM (SELECT DISTINCT pattern FROM a)),
f AS (SELECT pattern, h, DATE '2024-01-01' + CAST(h % 200 AS INT) AS d1,
             DATE '2024-01-01' + CAST(h % 200 + 30 + (h // 11) % 120 AS INT) AS d2 FROM d WHERE h % 3 = 0),
e AS (
  SELECT pattern, CASE WHEN (h // 7) % 4 = 0 THEN 'allow' ELSE 'block' END AS verdict, d1 AS valid_from FROM f
  UNION ALL SELECT pattern, 'remove', d2 FROM f WHERE (h // 3) % 2 = 0
  UNION ALL SELECT pattern, 'block', d2 + 40 FROM f WHERE (h // 5) % 2 = 0),
v AS (SELECT *, lead(valid_from) OVER (PARTITION BY pattern ORDER BY valid_from) AS valid_to FROM e),
m AS (
  SELECT a.page_id, v.*, row_number() OVER (PARTITION BY a.page_id ORDER BY length(v.pattern) DESC) AS rn
  FROM a JOIN v ON a.pattern = v.pattern AND a.fetch_date >= v.valid_from AND (v.valid_to IS NULL OR a.fetch_date < v.valid_to)
  WHERE v.verdict <> 'remove')
SELECT u.page_id, u.fetch_date, coalesce(m.verdict, 'none') AS verdict, m.pattern, m.valid_from, m.valid_to
FROM u LEFT JOIN m ON u.page_id = m.page_id AND m.rn = 1
"""
