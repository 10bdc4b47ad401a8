"""Paged scans, offsets by source, change logs and runs of misses as queries over the test tables, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import misses, upsert
from quire.queries import register, table
from quire.schema import TEXT, record
from quire.schema import T as types
from quire.sources import landed, paged
from quire.storage import shared_folder
from quire.streaming.changelog import ChangeLog


def landed_orders(spark, sf_dir) -> str:
    """Orders as items that connectors landed: the priority is the source, the status the journal. Returns the root of the pages."""
    root = f"{shared_folder(spark)}/landed-{uuid.uuid4().hex}"
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("source"), F.col("o_orderstatus").alias("journal"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("indexed"), F.col("o_orderkey").alias("k"), F.to_json(F.struct("o_orderkey", "o_totalprice")).alias("item"))
    paged.land(upsert.place_in_group(o, ["source", "journal"], ["indexed", "k"]).withColumn("place", F.col("place") - 1), root)
    return root


PAGES = """WITH n AS (
  SELECT o_orderkey, o_orderpriority AS source, o_orderstatus AS journal, strftime(o_orderdate, '%Y-%m-%d') AS indexed, row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY strftime(o_orderdate, '%Y-%m-%d'), o_orderkey) - 1 AS place FROM orders
), j AS (
  SELECT source, journal, sum(k) OVER (PARTITION BY source ORDER BY journal) - k AS before FROM (SELECT source, journal, max(place // 100) + 1 AS k FROM n GROUP BY ALL)
), p AS (SELECT n.*, (before + place // 100)::BIGINT AS page FROM n JOIN j USING (source, journal)) """


@register("paged_scan", PAGES + "SELECT source, journal, page, indexed, o_orderkey AS orderkey FROM p WHERE source IN ('1-URGENT', '5-LOW') AND journal = 'F' AND indexed >= '1997-01-01'")
def paged_scan(spark, sf_dir):
    """SC1, SC5, SC7-SC9, SC20: landed pages of two sources and one journal since a day, chosen by their names"""
    pages = paged.read_pages(spark, landed_orders(spark, sf_dir))
    some = pages.where(F.col("source").isin("1-URGENT", "5-LOW") & (F.col("journal") == "F") & (F.col("indexed") >= "1997-01-01"))
    return some.select("source", "journal", "page", "indexed", F.get_json_object("item", "$.o_orderkey").cast("long").alias("orderkey"))


@register("budgeted_runs", PAGES + "SELECT source, page, count(*) AS n, page AS batch FROM p WHERE page < 2 GROUP BY source, page")
def budgeted_runs(spark, sf_dir):
    """Survey 2.13: two runs of a call budget over all sources, in turns, each going on where the last one ended"""
    root, at = landed_orders(spark, sf_dir), f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}"
    sources = len(paged.without_gaps(paged.listed(root)))

    def one(df: DataFrame, n: int) -> None:
        df.withColumn("batch", F.lit(n).cast("long")).write.mode("overwrite").parquet(f"{at}/rows/run={n}")

    for _ in range(2):
        paged.stream_pages(spark, root, calls=sources).writeStream.foreachBatch(one).option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/rows").groupBy("source", "page", "batch").agg(F.count("*").alias("n"))


STATE = record(user_id=types.LongType(), event_type=TEXT, event_id=types.LongType())


@register("change_log_state", """WITH e AS (SELECT *, (event_id // 100) % 5 AS b FROM events),
    l AS (SELECT user_id, b, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM e GROUP BY ALL),
    s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY b DESC) AS r FROM l)
    SELECT user_id, event_type, event_id, CASE WHEN b >= 3 THEN b END AS seen FROM s WHERE r = 1 AND event_type <> 'error'""")
def change_log_state(spark, sf_dir):
    """SK6, SK13: the state of users after five batches of changes with drops, an added column and a compaction between them"""
    e = table(spark, sf_dir, "events").withColumn("b", F.expr("event_id DIV 100") % 5)
    log = ChangeLog(spark, f"{shared_folder(spark)}/log-{uuid.uuid4().hex}", "user_id", STATE)
    for n in range(5):
        last = e.where(F.col("b") == n).groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("event_type"), F.max("event_id").alias("event_id"))
        puts = last.where("event_type <> 'error'")
        log.append(n, puts if n < 3 else puts.withColumn("seen", F.lit(n).cast("long")), last.where("event_type = 'error'"))
        if n == 2:
            log.compact()
            log.clear()
    return log.read().select("user_id", "event_type", "event_id", "seen")


MISSES = """WITH e AS (SELECT event_id, least(user_id % 9, 2) AS grp, event_type <> 'purchase' AS miss FROM events),
    i AS (SELECT *, count(*) FILTER (NOT miss) OVER (PARTITION BY grp ORDER BY event_id) AS island FROM e),
    r AS (SELECT *, count(*) FILTER (miss) OVER (PARTITION BY grp, island ORDER BY event_id) AS length FROM i)"""


@register("abort_after_misses", MISSES + ", f AS (SELECT grp, min(event_id) AS stop FROM r WHERE length = 14 GROUP BY grp) SELECT event_id, r.grp, miss, stop IS NULL OR event_id <= stop AS attempted FROM r LEFT JOIN f USING (grp)")
def abort_after_misses(spark, sf_dir):
    """Rows that are looked up before 14 misses in a row; one group has most of the rows"""
    e = table(spark, sf_dir, "events").select("event_id", F.least(F.col("user_id") % 9, F.lit(2)).alias("grp"), (F.col("event_type") != "purchase").alias("miss"))
    return misses.attempted(e, F.col("miss"), 14, ["event_id"], ["grp"])


@register("longest_misses", MISSES + " SELECT '{\"grp\":' || grp || '}' AS grp, max(length) AS longest FROM r GROUP BY grp")
def longest_misses(spark, sf_dir):
    """The most misses in a row of each group, merged from summaries of ranges"""
    e = table(spark, sf_dir, "events").select("event_id", F.least(F.col("user_id") % 9, F.lit(2)).alias("grp"), (F.col("event_type") != "purchase").alias("miss"))
    return misses.longest_runs(e, F.col("miss"), ["event_id"], ["grp"])


@register("marked_issues", """WITH o AS (SELECT o_orderkey AS orderkey, o_orderstatus AS journal, year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS volume, o_orderpriority AS issue, o_totalprice FROM orders)
    SELECT orderkey, journal, year, volume, issue FROM o SEMI JOIN (SELECT DISTINCT journal, year, volume, issue FROM o WHERE o_totalprice > 495000 AND year IN (1996, 1997)) m USING (journal, year, volume, issue)""")
def marked_issues(spark, sf_dir):
    """SC21, SC22: markers of one scan choose the journals, years and issues that a second one reads"""
    path = f"{shared_folder(spark)}/issues-{uuid.uuid4().hex}"
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("orderkey"), F.col("o_orderstatus").alias("journal"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("volume"), F.col("o_orderpriority").alias("issue"), "o_totalprice")
    landed.write_issues(o, path)
    markers = o.where((F.col("o_totalprice") > 495000) & F.col("year").isin(1996, 1997))
    return landed.issue_articles(spark, path, markers).select("orderkey", "journal", "year", "volume", "issue")
