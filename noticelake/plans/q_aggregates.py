"""Registered breakdowns and series over the notice view."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from noticelake.operators import aggregates as A
from noticelake.operators import timeseries as T
from noticelake.plans import q_filters
from noticelake.plans.notices import SQL, table, view

QUERIES, ORACLE = {}, {}


def register(name: str, build, sql: str | None) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(view(spark, sf_dir))
    if sql is not None:
        ORACLE[name] = SQL + sql


_MONTH = "strftime(report_date, '%Y-%m')"
_BY = {
    "category": (A.by_category, "category", "notices"), "month": (A.by_month, _MONTH, "notices"), "classification": (A.by_classification, "classification", "notices"),
    "state": (A.by_state, "x", "(SELECT unnest(states) AS x FROM notices)"), "source": (A.by_source, "source", "notices"),
    "affected_country": (A.by_affected_country, "x", "(SELECT unnest(list_distinct(list_concat([notifying_country], distribution_countries))) AS x FROM notices)"),
}
register("agg_total", A.total, 'SELECT count(*) AS "count" FROM notices')
for _name, (_f, _label, _from) in _BY.items():
    register(f"agg_by_{_name}", _f, f'SELECT {_label} AS label, count(*) AS "count" FROM {_from} WHERE {_label} IS NOT NULL GROUP BY 1')
register("agg_by_severity", A.by_severity, "SELECT severity_label AS label, count(*) AS \"count\", list_position(['critical', 'severe', 'high', 'moderate', 'low'], severity_label)::INT AS rank FROM notices GROUP BY 1, 3")
register("agg_by_company", A.by_company, 'SELECT company_name AS label, count(*) AS "count" FROM notices WHERE company_name IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15')
register("agg_by_entity", A.by_entity, 'SELECT x.type AS type, x.value AS label, count(*) AS "count" FROM (SELECT unnest(entities) AS x FROM notices) GROUP BY 1, 2')
_STAT = [("total", "NULL", "['total']"), ("category", "NULL", "[category]"), ("month", "NULL", f"[{_MONTH}]"), ("classification", "NULL", "[classification]"), ("severity", "NULL", "[severity_label]"), ("company", "NULL", "[company_name]"), ("source", "NULL", "[source]"), ("state", "NULL", "states"), ("affected_country", "NULL", "list_distinct(list_concat([notifying_country], distribution_countries))")]
_LONG = " UNION ALL ".join(f"SELECT country, '{b}' AS breakdown, {t}::VARCHAR AS type, unnest({x}) AS label FROM notices" for b, t, x in _STAT) + " UNION ALL SELECT country, 'entity', e.type, e.value FROM (SELECT country, unnest(entities) AS e FROM notices)"
_STATS = f', l AS ({_LONG}), c AS (SELECT *, count(*) AS "count" FROM l WHERE label IS NOT NULL GROUP BY ALL) SELECT * FROM c UNION ALL SELECT NULL, breakdown, type, label, sum("count")::BIGINT FROM c GROUP BY ALL'
register("agg_stats", A.stats, _STATS)
register("snk_stats_payload", lambda df: A.stats_payload(A.stats(df)), None)
register("agg_companies", lambda df: A.companies(df, "customer#", 30, country="us", company="x"), "SELECT company_name AS label, count(*) AS \"count\" FROM notices WHERE country = 'us' AND company_name ILIKE '%customer#%' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30")
for _group, _expr in {"total": "'total'", "category": "category", "source": "source", "severity": "severity_label", "classification": "coalesce(classification, 'Unclassified')"}.items():
    register(f"agg_trend_{_group}", lambda df, g=_group: A.trend(df, g, since=dt.date(1995, 6, 1)), f"SELECT {_MONTH} AS month, {_expr} AS label, count(*) AS \"count\" FROM notices WHERE report_date >= DATE '1995-06-01' GROUP BY 1, 2")
_ENTITY = f", er AS (SELECT month, x AS label, count(*) AS \"count\" FROM (SELECT {_MONTH} AS month, unnest(list_distinct(list_transform(entities, lambda e: e.value))) AS x FROM notices WHERE report_date IS NOT NULL) GROUP BY 1, 2), top AS (SELECT label FROM er GROUP BY 1 ORDER BY sum(\"count\") DESC, label LIMIT 20), es AS (SELECT er.* FROM er SEMI JOIN top USING (label))"
register("agg_category_series", A.category_series, f'SELECT {_MONTH} AS month, category AS label, count(*) AS "count" FROM notices WHERE report_date IS NOT NULL GROUP BY 1, 2')
register("agg_entity_series", A.entity_series, _ENTITY + " SELECT * FROM es")
register("agg_pivot", lambda df: A.pivot_counts(df, "country", ["us", "uk", "za", "ca", "eu", "nz"]), "SELECT " + ", ".join(f"count(*) FILTER (country = '{c}') AS {c}" for c in ("us", "uk", "za", "ca", "eu", "nz")) + " FROM notices")
register("agg_groups", lambda df: A.groups(df, "event_id"), "SELECT event_id, count(*) AS size FROM notices WHERE event_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 2")
register("agg_high_water", lambda df: A.high_water(df, "source", "severity_score"), "SELECT source, max(severity_score) AS high_water FROM notices GROUP BY 1")
_TOPICS = "SELECT topic_id AS id, country, count(*) AS size, 'topic-' || topic_id::VARCHAR AS slug FROM notices WHERE topic_id IS NOT NULL GROUP BY 1, 2"
register("srt_topics", lambda df: A.list_topics(q_filters._dim(df), "uk"), f"SELECT * FROM ({_TOPICS}) WHERE country = 'uk'")
_EVENTS = "SELECT event_cluster_id AS id, count(*) AS recall_count, count(*) % 2 = 0 AS is_outbreak FROM notices WHERE event_cluster_id IS NOT NULL GROUP BY 1"
_events = lambda df: q_filters._events(df).drop("n").withColumn("is_outbreak", F.col("recall_count") % 2 == 0)
register("srt_events", lambda df: A.list_events(_events(df)), _EVENTS)
register("srt_events_outbreaks", lambda df: A.list_events(_events(df), outbreaks_only=True), f"SELECT * FROM ({_EVENTS}) WHERE is_outbreak")
register("win_unique_slugs", lambda df: A.unique_slugs(df.select("id", "country", F.concat(F.lit("notice-"), (F.col("id") % 9).cast("string")).alias("base")), "base", "country", "id"), "SELECT id, country, 'notice-' || (id % 9)::VARCHAR AS base, 'notice-' || (id % 9)::VARCHAR || CASE WHEN row_number() OVER w > 1 THEN '-' || (row_number() OVER w)::VARCHAR ELSE '' END AS slug FROM notices WINDOW w AS (PARTITION BY country, id % 9 ORDER BY id)")

# ---- series
_CAL = f", cal AS (SELECT strftime(unnest(generate_series(date_trunc('month', min(report_date)), date_trunc('month', max(report_date)), INTERVAL 1 MONTH)), '%Y-%m') AS month FROM notices)"
_RAW = f"""{_ENTITY}{_CAL}, raw AS (
  SELECT 'overall' AS scope, 'total' AS label, {_MONTH} AS month, count(*) AS "count" FROM notices WHERE report_date IS NOT NULL GROUP BY 3
  UNION ALL SELECT 'category', category, {_MONTH}, count(*) FROM notices WHERE report_date IS NOT NULL GROUP BY 2, 3
  UNION ALL SELECT 'entity', label, month, "count" FROM es),
series AS (SELECT scope, label, cal.month, coalesce(raw."count", 0)::BIGINT AS "count" FROM (SELECT DISTINCT scope, label FROM raw) CROSS JOIN cal LEFT JOIN raw USING (scope, label, month)),
pts AS (SELECT * FROM series QUALIFY month < max(month) OVER (PARTITION BY scope, label))"""
_FLAGS = f"""{_RAW}, w AS (SELECT *, row_number() OVER o AS n, quantile_cont("count", 0.5) OVER t AS baseline, list("count") OVER t AS h, stddev_pop("count") OVER t AS sd, quantile_cont("count", 0.9) OVER b AS high FROM pts
  WINDOW o AS (PARTITION BY scope, label ORDER BY month), t AS (PARTITION BY scope, label ORDER BY month ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING), b AS (PARTITION BY scope, label ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
z AS (SELECT *, list_aggregate(list_transform(h, lambda x: abs(x - baseline)), 'median') AS mad FROM w WHERE n > 6),
f AS (SELECT *, ("count" - baseline) / greatest(CASE WHEN mad > 0 THEN mad / 0.6745 ELSE sd END, 1.0) AS zz FROM z),
flags AS (SELECT scope, label, month, "count" AS observed, baseline, round(zz, 1) AS z FROM f WHERE (zz >= 3 OR (n > 12 AND "count" >= high)) AND "count" - baseline >= 3)"""
register("win_calendar", lambda df: T.month_calendar(df), _CAL + " SELECT month FROM cal")
register("win_scan_series", lambda df: T.scan_series(df), _RAW + " SELECT * FROM series")
register("win_anomalies", lambda df: T.anomalies(T.scan_series(df)), _FLAGS + " SELECT * FROM flags")
register("win_near_record", lambda df: T.near_record(T.scan_series(df)), f'{_FLAGS} SELECT scope, label, month, "count", high FROM w WHERE n > 12 AND "count" >= high')
register(
    "win_surface", lambda df: (lambda s: T.surface(T.anomalies(s), T.calendar_of(s)))(T.scan_series(df)),
    _FLAGS + ", k AS (SELECT flags.* FROM flags SEMI JOIN (SELECT month FROM cal ORDER BY month DESC LIMIT 24) USING (month)), best AS (SELECT scope, label, max(abs(z)) AS peak, max(month) AS newest FROM k GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 8) SELECT k.*, peak, newest FROM k JOIN best USING (scope, label)",
)


def _fit(points: str, prefix: str = "") -> str:
    """Common table expressions of the forecast from points (scope, label, month, count)."""
    p = prefix
    return f""", {p}a AS (SELECT scope, label, month, "count"::DOUBLE AS y, (row_number() OVER (PARTITION BY scope, label ORDER BY month) - 1)::DOUBLE AS t, substr(month, 6, 2)::INT AS cal,
    count(*) OVER (PARTITION BY scope, label) AS n, avg("count") OVER (PARTITION BY scope, label) AS mean FROM {points}),
  {p}b AS (SELECT *, ln(1 + y) AS ly FROM {p}a WHERE n >= 24 AND mean >= 3),
  {p}c AS (SELECT *, ly - (regr_intercept(ly, t) OVER q + regr_slope(ly, t) OVER q * t) AS d FROM {p}b WINDOW q AS (PARTITION BY scope, label)),
  {p}d AS (SELECT scope, label, cal, CASE WHEN n >= 24 THEN avg(d) ELSE 0 END AS s FROM {p}c GROUP BY scope, label, cal, n),
  {p}s AS (SELECT scope, label, cal, s - sum(s) OVER (PARTITION BY scope, label) / 12 AS s FROM {p}d),
  {p}e AS (SELECT {p}b.*, s, ly - s AS e FROM {p}b JOIN {p}s USING (scope, label, cal)),
  {p}f AS (SELECT *, regr_slope(e, t) OVER q AS b, regr_intercept(e, t) OVER q AS a FROM {p}e WINDOW q AS (PARTITION BY scope, label)),
  {p}m AS (SELECT scope, label, any_value(n) AS n, any_value(a) AS a, any_value(b) AS b, stddev_samp(y - (exp(a + b * t + s) - 1)) AS sd, max(month) AS last FROM {p}f GROUP BY 1, 2),
  {p}g AS (SELECT {p}m.*, step, strftime((last || '-01')::DATE + to_months(step::INT), '%Y-%m') AS month FROM {p}m, range(1, 4) r(step)),
  {p}h AS (SELECT {p}g.scope, {p}g.label, month, greatest(0, exp(a + b * (n - 1 + step) + coalesce(s, 0)) - 1) AS v, sd * sqrt(step) AS w FROM {p}g LEFT JOIN {p}s ON {p}s.scope = {p}g.scope AND {p}s.label = {p}g.label AND {p}s.cal = substr(month, 6, 2)::INT),
  {p}fc AS (SELECT scope, label, month, round(v, 1) AS predicted, round(greatest(0, v - w), 1) AS lower, round(v + w, 1) AS upper FROM {p}h)"""


register("win_forecast", lambda df: T.forecast(T.scan_series(df)), _RAW + _fit("pts") + " SELECT * FROM fc")
register(
    "win_backtest", lambda df: T.backtest(T.scan_series(df)),
    _RAW + ', r AS (SELECT *, row_number() OVER (PARTITION BY scope, label ORDER BY month DESC) AS back, lag("count", 12) OVER (PARTITION BY scope, label ORDER BY month) AS naive FROM pts)' + _fit("(SELECT * FROM r WHERE back > 3)")
    + ', j AS (SELECT scope, label, avg(abs(predicted - "count")) AS mae, avg(abs(naive - "count")) AS naive_mae FROM r JOIN fc USING (scope, label, month) WHERE back <= 3 GROUP BY 1, 2) SELECT *, CASE WHEN mae < naive_mae * 0.95 THEN \'better\' WHEN mae > naive_mae * 1.05 THEN \'worse\' ELSE \'tie\' END AS verdict FROM j',
)
register("win_holt_winters", lambda df: T.holt_winters(T.scan_series(df)), None)
register("win_stl_flags", lambda df: T.stl_flags(T.scan_series(df)), None)
register("set_agreement_stl", lambda df: (lambda s: T.agreement(T.anomalies(s), T.stl_flags(s), ["scope", "label", "month"]))(T.scan_series(df)), None)
register("set_agreement", lambda df: (lambda s: T.agreement(T.anomalies(s), T.near_record(s), ["scope", "label", "month"]))(T.scan_series(df)), _FLAGS + ', nr AS (SELECT scope, label, month FROM w WHERE n > 12 AND "count" >= high), u AS (SELECT scope, label, month FROM flags UNION SELECT * FROM nr), i AS (SELECT scope, label, month FROM flags INTERSECT SELECT * FROM nr) SELECT (SELECT count(*) FROM i) AS shared, (SELECT count(*) FROM u) AS either, (SELECT count(*) FROM i) / (SELECT count(*) FROM u) AS jaccard')
register("win_add_months", lambda df: df.where("report_date is not null").select("recall_number", T.add_months(A.month_label(F.col("report_date")), -5).alias("month")), "SELECT recall_number, strftime(date_trunc('month', report_date) - INTERVAL 5 MONTH, '%Y-%m') AS month FROM notices WHERE report_date IS NOT NULL")


# ---- small tables, read from the events and parts
def _runs(spark, sf_dir):
    """Ingest runs: every event is a run of a source."""
    e = table(spark, sf_dir, "events")
    src = F.element_at(F.array(*map(F.lit, ("fda", "usda", "uk", "ncc", "cfia", "rasff"))), (F.col("event_id") % 6 + 1).cast("int"))
    return e.select(F.col("event_id").alias("id"), src.alias("source"), F.col("ts").alias("started_at"), (F.col("ts") + F.expr("interval 5 minutes")).alias("finished_at"), F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"), F.col("user_id").alias("fetched_count"))


_RUNS = "WITH runs AS (SELECT event_id AS id, ['fda','usda','uk','ncc','cfia','rasff'][event_id % 6 + 1] AS source, ts AS started_at, ts + INTERVAL 5 MINUTE AS finished_at, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status, user_id AS fetched_count FROM events) "
QUERIES["agg_last_ingest"] = lambda s, d: A.last_ingest(_runs(s, d), "us")
ORACLE["agg_last_ingest"] = _RUNS + "SELECT max(finished_at) AS last_ingest FROM runs WHERE status = 'ok' AND source IN ('fda', 'usda')"
QUERIES["agg_latest"] = lambda s, d: A.latest(_runs(s, d))
ORACLE["agg_latest"] = _RUNS + "SELECT * FROM runs ORDER BY started_at DESC, id DESC LIMIT 1"
_flags = lambda e: A.flag_counts(e, real=F.col("event_type") != "error", bot=F.col("event_type") == "error", unseen=F.col("value") > 10)
QUERIES["agg_flag_counts"] = lambda s, d: _flags(table(s, d, "events"))
ORACLE["agg_flag_counts"] = "SELECT count(*) AS total, count(*) FILTER (event_type <> 'error') AS real, count(*) FILTER (event_type = 'error') AS bot, count(*) FILTER (value > 10) AS unseen FROM events"
QUERIES["agg_overview"] = lambda s, d: A.overview(_flags(table(s, d, "events")), A.latest(_runs(s, d)).select(F.col("source").alias("last_source")), A.pivot_counts(view(s, d), "country", ["us", "eu"]))
ORACLE["agg_overview"] = SQL + ", runs AS (SELECT event_id AS id, ['fda','usda','uk','ncc','cfia','rasff'][event_id % 6 + 1] AS source, ts AS started_at FROM events) SELECT * FROM (SELECT count(*) AS total, count(*) FILTER (event_type <> 'error') AS real, count(*) FILTER (event_type = 'error') AS bot, count(*) FILTER (value > 10) AS unseen FROM events), (SELECT source AS last_source FROM runs ORDER BY started_at DESC, id DESC LIMIT 1), (SELECT count(*) FILTER (country = 'us') AS us, count(*) FILTER (country = 'eu') AS eu FROM notices)"
