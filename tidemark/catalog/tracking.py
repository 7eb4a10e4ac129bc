"""Tracking-log queries: a journey is a user, steps are days, hits are events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.cte import add, sql
from tidemark.catalog.registry import query
from tidemark.plans import tracking as T
from tidemark.sources import driver_tables as D

PLATFORMS = ("google_ads", "meta")


def hits(s, d):
    k = F.col("k")
    return D.ev(s, d).select(
        F.col("user_id").alias("journey_id"), D.pick(k % 2, PLATFORMS).alias("platform"), F.when(F.col("event_type") == "error", "beacon").when(F.col("event_type") == "view", "page_view").otherwise("event").alias("kind"), F.dayofmonth("ts").alias("step"),
        F.concat(F.lit("c"), (k % 9).cast("string")).alias("click_id"), F.concat(F.lit("c"), (k % 4).cast("string")).alias("url_click_id"), F.concat(F.lit("d"), (k % 10).cast("string")).alias("dedupe_key"), F.when(k % 6 == 0, "AW-1").alias("stream"))


def journeys(s, d):
    j = F.col("journey_id")
    return D.ev(s, d).select(F.col("user_id").alias("journey_id")).distinct().select(
        "*", F.explode(F.array(*[F.lit(p) for p in PLATFORMS])).alias("platform"), F.when(j % 5 != 0, F.concat(F.lit("c"), (j % 9).cast("string"))).alias("click_id"), (j % 28 + 1).cast("int").alias("final_step"), (j % 3 == 0).alias("stored"))


add("jh", """SELECT user_id AS j, (['google_ads', 'meta'])[k % 2 + 1] AS platform, CASE event_type WHEN 'error' THEN 'beacon' WHEN 'view' THEN 'page_view' ELSE 'event' END AS kind, day(ts) AS step, k % 9 AS c, k % 4 AS u, k % 10 AS dk, CASE WHEN k % 6 = 0 THEN 'AW-1' END AS stream FROM ev""")
add("pres", """SELECT x.j AS journey_id, p.platform, x.j % 5 <> 0 AS relevant, count(*) FILTER (WHERE h.step = x.j % 28 + 1) AS hits_on_final, coalesce(bool_or(x.j % 5 <> 0 AND h.c = x.j % 9 AND h.step = x.j % 28 + 1), false) AS sent_on_final_page, coalesce(bool_or(x.j % 5 <> 0 AND h.c = x.j % 9), false) AS sent_anywhere,
    coalesce(bool_or(x.j % 5 <> 0 AND h.u = x.j % 9 AND h.step = x.j % 28 + 1), false) AND NOT coalesce(bool_or(x.j % 5 <> 0 AND h.c = x.j % 9 AND h.step = x.j % 28 + 1), false) AS url_only, x.j % 3 = 0 AND x.j % 5 <> 0 AS stored
    FROM (SELECT DISTINCT user_id AS j FROM ev) x CROSS JOIN (VALUES ('google_ads'), ('meta')) p(platform) LEFT JOIN jh h ON h.j = x.j AND h.platform = p.platform AND h.kind <> 'beacon' GROUP BY x.j, p.platform""")


@query("trk_2_presence", sql("SELECT * FROM pres"))
def _(s, d):
    return T.presence(journeys(s, d), hits(s, d))


@query("trk_1_coverage", sql("""SELECT platform, cohort, count(*) FILTER (WHERE ok AND sent_on_final_page) AS covered, count(*) FILTER (WHERE ok) AS total, count(*) FILTER (WHERE ok AND stored) AS stored, count(*) FILTER (WHERE NOT ok) AS excluded, floor(1000.0::DOUBLE * count(*) FILTER (WHERE ok AND sent_on_final_page) / nullif(count(*) FILTER (WHERE ok), 0) + 0.5) / 10 AS pct
    FROM (SELECT *, journey_id % 11 <> 0 AS ok, unnest(['all', CASE WHEN journey_id % 4 = 0 THEN 'blocker' ELSE 'standard' END]) AS cohort FROM pres WHERE relevant) GROUP BY 1, 2"""))
def _(s, d):
    j = journeys(s, d).select("journey_id").distinct().select("journey_id", (F.col("journey_id") % 4 == 0).alias("blocker"), (F.col("journey_id") % 11 != 0).alias("valid"))
    return T.coverage(T.presence(journeys(s, d), hits(s, d)), j)


add("pv", "SELECT j AS journey_id, step, platform, CASE WHEN platform = 'google_ads' THEN coalesce(min(stream), 'google-tag') ELSE 'default' END AS stream, dk FROM jh WHERE kind = 'page_view' GROUP BY j, step, platform, dk")


@query("trk_3_page_views", sql("SELECT journey_id, step, platform, count(*) AS views FROM pv GROUP BY 1, 2, 3"))
def _(s, d):
    return T.page_views(hits(s, d)).groupBy("journey_id", "step", "platform").agg(F.sum("views").alias("views"))


add("routes", "SELECT DISTINCT user_id AS journey_id, day(ts) AS step, day(ts) = 1 AS hard, (user_id + day(ts)) % 4 <> 0 OR day(ts) = 1 AS clean FROM ev")


@query("trk_4_exactly_one", sql("""SELECT journey_id, platform, CASE WHEN ref = 0 OR cl = 0 THEN 'ERROR' WHEN wrong > 0 THEN 'FAIL' WHEN un > 0 THEN 'ERROR' ELSE 'PASS' END AS status FROM (SELECT r.journey_id, p.platform, coalesce(sum(v) FILTER (WHERE hard), 0) AS ref, count(*) FILTER (WHERE NOT hard AND clean) AS cl, count(*) FILTER (WHERE NOT hard AND NOT clean) AS un,
    count(*) FILTER (WHERE NOT hard AND clean AND coalesce(v, 0) <> 1) AS wrong FROM routes r CROSS JOIN (VALUES ('google_ads'), ('meta')) p(platform) LEFT JOIN (SELECT journey_id, step, platform, count(*) AS v FROM pv GROUP BY 1, 2, 3) c ON c.journey_id = r.journey_id AND c.step = r.step AND c.platform = p.platform GROUP BY 1, 2)"""))
def _(s, d):
    step = F.dayofmonth("ts")
    r = D.ev(s, d).select(F.col("user_id").alias("journey_id"), step.alias("step")).distinct()
    r = r.select("*", (F.col("step") == 1).alias("is_hard_load"), (((F.col("journey_id") + F.col("step")) % 4 != 0) | (F.col("step") == 1)).alias("clean"))
    return T.exactly_one(T.page_views(hits(s, d)), r, PLATFORMS).select("journey_id", "platform", "status")


@query("trk_5_run_summary", sql("SELECT CAST(ts AS DATE) AS run_id, " + ", ".join(f"count(*) FILTER (WHERE k % 4 = {i}) AS {st}" for i, st in enumerate(T.STATUSES)) + " FROM ev GROUP BY 1"))
def _(s, d):
    return T.run_summary(D.ev(s, d).select(F.to_date("ts").alias("run_id"), D.pick(F.col("k") % 4, T.STATUSES).alias("status")))
