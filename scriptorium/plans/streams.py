"""Queries that run a stream to its end: late rows, dedupe by two keys, merged changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch
from ..streaming import events as X
from ..streaming import replay as R
from .base import PAPERS, papers, shaped, slug_sql, table

QUERIES, SQL = {}, {}
#: Events arrive in steps of so many days; every seventh comes up to nine days late.
STEP_DAYS, LATE_EVERY, LATE_DAYS = 6, 7, 9


def _arrivals(spark, d):
    """Events with the step in which they arrive."""
    late = F.when(F.col("event_id") % LATE_EVERY == 0, F.col("event_id") % (LATE_DAYS + 1)).otherwise(0)
    day = F.unix_date(F.to_date("ts")) + late
    return table(spark, d, "events").withColumns({"step": F.floor(day / STEP_DAYS).cast("int"), "ts": F.col("ts").cast("timestamp")})


_ARRIVALS = f"""a AS MATERIALIZED (SELECT *, (date_diff('day', DATE '1970-01-01', ts::DATE) + CASE WHEN event_id % {LATE_EVERY} = 0 THEN event_id % {LATE_DAYS + 1} ELSE 0 END) // {STEP_DAYS} AS step FROM events)"""


def events_late_windows(spark, d):
    """Daily counts of a stream whose late rows are dropped: a day closes a day after it ended."""
    found = R.closed_windows(lambda e: X.daily_counts(e, "1 day"), _arrivals(spark, d), "step")
    return shaped(found.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", "n", "total"), "day:string", "event_type:string", "n:bigint", "total:double")


SQL["events_late_windows"] = f"""WITH {_ARRIVALS}, s AS (SELECT step, max(ts) AS m FROM a GROUP BY step),
w AS (SELECT step, lag(m) OVER (ORDER BY step) AS seen FROM (SELECT step, max(m) OVER (ORDER BY step) AS m FROM s)),
r AS (SELECT ts::DATE AS day, event_type, value FROM a JOIN w USING (step) WHERE seen IS NULL OR ts::DATE + INTERVAL 1 DAY > seen - INTERVAL 1 DAY)
SELECT strftime(day, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 6) AS total FROM r
WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY ALL"""


def events_late_sliding(spark, d):
    """Sliding windows of two days, a day apart, of the same stream; a row may be late for one window and not for the other."""
    found = R.closed_windows(lambda e: X.sliding_counts(e, "2 days", "1 day", "12 hours"), _arrivals(spark, d), "step")
    return shaped(found.select(F.date_format("start", "yyyy-MM-dd").alias("start"), "event_type", "n", "total"), "start:string", "event_type:string", "n:bigint", "total:double")


SQL["events_late_sliding"] = f"""WITH {_ARRIVALS}, s AS (SELECT step, max(ts) AS m FROM a GROUP BY step),
w AS (SELECT step, lag(m) OVER (ORDER BY step) AS seen FROM (SELECT step, max(m) OVER (ORDER BY step) AS m FROM s)),
r AS (SELECT ts::DATE - k::INT AS start, event_type, value, seen FROM a JOIN w USING (step), range(2) k(k))
SELECT strftime(start, '%Y-%m-%d') AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM r
WHERE (seen IS NULL OR start + INTERVAL 2 DAY > seen - INTERVAL 12 HOUR) AND start + INTERVAL 2 DAY <= (SELECT max(ts) FROM events) - INTERVAL 12 HOUR GROUP BY ALL"""


def stream_dedupe(spark, d):
    """Documents that arrive in three steps, the first of them twice: those whose text or title none kept before has."""
    rows = papers(spark, d).select("pos", F.md5("abstract").alias("id"), "title").withColumn("step", (F.col("pos") % 3).cast("int"))
    return shaped(R.deduped(rows, "step", R.KeptRecords(spark, scratch(spark, "kept")), again=0), "pos:bigint")


SQL["stream_dedupe"] = f"""WITH RECURSIVE {PAPERS}, r AS MATERIALIZED (SELECT row_number() OVER (ORDER BY pos % 3, pos) AS i, pos, md5(abstract) AS id, {slug_sql('title')} AS slug FROM papers),
f(i, pos, ok, ids, slugs) AS (
  SELECT 0::BIGINT, NULL::BIGINT, false, []::VARCHAR[], []::VARCHAR[]
  UNION ALL
  SELECT r.i, r.pos, n.ok, CASE WHEN n.ok THEN list_append(f.ids, r.id) ELSE f.ids END, CASE WHEN n.ok AND r.slug <> '' THEN list_append(f.slugs, r.slug) ELSE f.slugs END
  FROM f JOIN r ON r.i = f.i + 1, LATERAL (SELECT NOT list_contains(f.ids, r.id) AND (r.slug = '' OR NOT list_contains(f.slugs, r.slug)) AS ok) n)
SELECT pos FROM f WHERE ok"""


def stream_merge(spark, d):
    """Edges from users to event types, their weight the last value to arrive; folded into a base when all is there."""
    edges = _arrivals(spark, d).select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("src"), F.col("event_type").alias("dst"), "value", "event_id", "step")
    held = R.MergedTable(spark, scratch(spark, "merged"), ["src", "dst"], ["event_id"])
    R.merged(edges, "step", held)
    held.compact()
    return shaped(held.rows(), "src:string", "dst:string", "value:double", "event_id:bigint")


SQL["stream_merge"] = f"""WITH {_ARRIVALS} SELECT src, dst, round(value, 6) AS value, event_id FROM (SELECT 'u' || user_id AS src, event_type AS dst, value, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY step DESC, event_id DESC) AS r FROM a) WHERE r = 1"""

for _f in (events_late_windows, events_late_sliding, stream_dedupe, stream_merge):
    QUERIES[_f.__name__] = _f
