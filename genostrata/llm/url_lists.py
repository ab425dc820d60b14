"""URL filtering by dated lists: a temporal list join, in DataFrame functions only.

Dated add and remove entries become validity intervals of each listed domain. Every capture
is judged against the entries in force on the day it was fetched: its host and the parents
of the host are looked up as of that day, and the most specific domain in force is named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genostrata.llm.common import read


#: Hosts that are addresses and no names.
ADDRESS = r"^(\[.*\]|[0-9]{1,3}(\.[0-9]{1,3}){3})$"


def host_of(url: Column) -> Column:
    """Lower-cased host without user, port, final dot and ``www.``; null without one.

    An address of version 6 keeps its brackets.
    """
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#]*@)?(\[[0-9a-f:.]+\]|[^/?#:@\[\]]+)", 1)
    return F.nullif(F.regexp_replace(host, r"^www\.|\.$", ""), F.lit(""))


def validity_intervals(entries: DataFrame, domain: str, action: str, day: str) -> DataFrame:
    """(domain, valid_from, valid_to) from entries of action add or remove; valid_to is open.

    Entries of a domain and day count as one, add winning over remove; an add while listed
    and a remove while not listed change nothing. Entries with a null or unknown part are
    left out.
    """
    rows = entries.select(F.regexp_replace(F.lower(F.trim(domain)), r"^www\.|\.$", "").alias("domain"), F.lower(action).alias("action"), F.col(day).cast("date").alias("day"))
    rows = rows.where("domain <> '' AND action IN ('add', 'remove') AND day IS NOT NULL")
    # One row for each domain and day before anything is brought together.
    states = rows.groupBy("domain", "day").agg(F.max(F.col("action") == "add").alias("listed"))
    order = Window.partitionBy("domain").orderBy("day")
    turns = states.withColumn("was", F.coalesce(F.lag("listed").over(order), F.lit(False))).where("listed <> was")
    return turns.withColumn("valid_to", F.lead("day").over(order)).where("listed").select("domain", F.col("day").alias("valid_from"), "valid_to")


def judge(captures: DataFrame, entries: DataFrame, capture_id: str, url: str, fetched: str, *, domain: str = "domain", action: str = "action", day: str = "day") -> DataFrame:
    """capture_id, host, fetched_on, blocked, listed_domain, listed_since for every capture.

    A capture is blocked if its host or a parent domain of two labels or more is in force
    on its fetch day; addresses have no parents. Without a host or a fetch day nothing can be in force: blocked is
    false. Repeated captures are each answered. Hosts with very many captures are looked up
    once for each day. Other columns of ``captures`` are not read.
    """
    rows = captures.select(F.col(capture_id).alias("capture_id"), host_of(F.col(url)).alias("host"), F.col(fetched).cast("date").alias("fetched_on"))
    asked = rows.where("host IS NOT NULL AND fetched_on IS NOT NULL").select("host", "fetched_on").distinct()
    labels = F.split("host", r"\.")
    count = F.size(labels)
    names = F.transform(F.sequence(F.lit(1), F.greatest(count - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, count), "."))
    parents = F.when(F.col("host").rlike(ADDRESS), F.array("host")).otherwise(names)
    spans = validity_intervals(entries, domain, action, day)
    keys = asked.select("host", "fetched_on", F.explode(parents).alias("domain"))
    met = keys.join(spans, "domain").where("valid_from <= fetched_on AND (valid_to IS NULL OR fetched_on < valid_to)")
    best = met.groupBy("host", "fetched_on").agg(F.max(F.struct(F.length("domain").alias("l"), "domain", "valid_from")).alias("m"))
    best = best.select("host", "fetched_on", F.col("m.domain").alias("listed_domain"), F.col("m.valid_from").alias("listed_since"))
    out = rows.join(best, ["host", "fetched_on"], "left")
    return out.select("capture_id", "host", "fetched_on", F.col("listed_domain").isNotNull().alias("blocked"), "listed_domain", "listed_since")


def op7_temporal_url_lists(spark, sf_dir: str) -> DataFrame:
    """The pages' captures against a dated list.

    The tables have no fetch times and no lists, so both follow from the data by a rule,
    the same one in the SQL: a page's fetch day from its id, and for each host, and each
    last two labels, entries on days that follow from the name.
    """
    pages = read(spark, sf_dir, "pages")
    captures = pages.select("page_id", "url", F.expr("date_add(date'2024-01-01', cast(page_id * 37 % 365 as int))").alias("fetched"))
    names = pages.select(host_of(F.col("url")).alias("domain")).where("domain IS NOT NULL").distinct()
    names = names.withColumn("v", F.expr("37 * length(domain) + 11 * ascii(domain) + 5 * ascii(substring(domain, 3))"))
    entry = lambda rows, action, after: rows.select("domain", F.lit(action).alias("action"), F.expr(f"date_add(date'2024-01-01', {after})").alias("day"))
    entries = entry(names, "add", "v % 120").unionByName(entry(names.where("v % 2 = 0"), "remove", "v % 120 + 60")).unionByName(entry(names.where("v % 4 = 0"), "add", "v % 120 + 150"))
    tops = names.select(F.substring_index("domain", ".", -2).alias("domain")).distinct().where("domain LIKE '%.org'")
    entries = entries.unionByName(entry(tops, "add", "300"))
    out = judge(captures, entries, "page_id", "url", "fetched")
    return out.withColumnRenamed("capture_id", "page_id").withColumns({c: F.col(c).cast("string") for c in ("fetched_on", "listed_since")})


OP7_SQL = r"""
WITH p AS (
  SELECT page_id, CAST(DATE '2024-01-01' + CAST(page_id * 37 % 365 AS INTEGER) AS DATE) AS fetched_on,
         nullif(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.\-]*://(?:[^/?#]*@)?(\[[0-9a-f:.]+\]|[^/?#:@\[\]]+)', 1), '^www\.|\.$', ''), '') AS host
  FROM pages
),
names AS (SELECT DISTINCT host AS domain FROM p WHERE host IS NOT NULL),
v AS (SELECT domain, 37 * length(domain) + 11 * ascii(domain) + 5 * ascii(substring(domain, 3)) AS v FROM names),
e AS (
  SELECT domain, 'add' AS action, DATE '2024-01-01' + CAST(v % 120 AS INTEGER) AS day FROM v
  UNION ALL SELECT domain, 'remove', DATE '2024-01-01' + CAST(v % 120 + 60 AS INTEGER) FROM v WHERE v % 2 = 0
  UNION ALL SELECT domain, 'add', DATE '2024-01-01' + CAST(v % 120 + 150 AS INTEGER) FROM v WHERE v % 4 = 0
  UNION ALL SELECT DISTINCT regexp_extract(domain, '[^.]+\.[^.]+$'), 'add', DATE '2024-01-01' + 300 FROM names WHERE domain LIKE '%.org'
),
hits AS (
  SELECT p.page_id, d.domain, d.day, d.rank_ FROM p JOIN (
    SELECT domain, day, action, row_number() OVER (PARTITION BY domain ORDER BY day) AS rank_,
           lead(day) OVER (PARTITION BY domain ORDER BY day) AS until
    FROM e
  ) d ON (p.host = d.domain OR (ends_with(p.host, '.' || d.domain) AND NOT regexp_matches(p.host, '^(\[.*\]|[0-9]{1,3}(\.[0-9]{1,3}){3})$')))
     AND d.action = 'add' AND d.day <= p.fetched_on AND (d.until IS NULL OR p.fetched_on < d.until)
),
best AS (
  SELECT page_id, max_by(domain, length(domain)) AS listed_domain, max_by(CAST(day AS DATE), length(domain)) AS listed_since
  FROM hits GROUP BY page_id
)
SELECT p.page_id, p.host, CAST(p.fetched_on AS VARCHAR) AS fetched_on, b.listed_domain IS NOT NULL AS blocked,
       b.listed_domain, CAST(b.listed_since AS VARCHAR) AS listed_since
FROM p LEFT JOIN best b USING (page_id)
"""
