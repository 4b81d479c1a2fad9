"""Registered filters, lists and searches over the notice view."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from noticelake.operators import filters as X
from noticelake.plans.notices import SQL, view

QUERIES, ORACLE = {}, {}


def register(name: str, build, sql: str | None, over=view) -> None:
    """Adds a query ``build(view)`` and, over the view's tables, the SQL of its rows."""
    QUERIES[name] = lambda spark, sf_dir: build(over(spark, sf_dir))
    if sql is not None:
        ORACLE[name] = SQL + sql


_ROWS = ("recall_number", "source", "severity_score")
_COLUMNS = ", ".join(_ROWS)
_DAY = dt.date(1996, 3, 1)
_AFFECTED = "(coalesce(notifying_country = 'FR', false) OR coalesce(list_contains(distribution_countries, 'FR'), false))"
_FILTERS = {
    "country": ({"country": "eu"}, "country = 'eu'"),
    "source": ({"source": "fda"}, "source = 'fda'"),
    "category": ({"category": "pathogen"}, "category = 'pathogen'"),
    "classification": ({"classification": "Class I"}, "classification = 'Class I'"),
    "state": ({"state": "TX"}, "list_contains(states, 'TX')"),
    "affected_country": ({"affected_country": " fr "}, _AFFECTED),
    "company": ({"company": "customer#%1_"}, "company_name ILIKE '%customer#%1_%'"),
    "entity": ({"entity": "Listeria"}, "list_contains(list_transform(entities, lambda e: e.value), 'Listeria')"),
    "min_severity": ({"min_severity": 60.0}, "severity_score >= 60"),
    "severity": ({"severity": "severe"}, "severity_label = 'severe'"),
    "dates": ({"since": _DAY, "until": dt.date(1997, 6, 30)}, "report_date BETWEEN DATE '1996-03-01' AND DATE '1997-06-30'"),
    "novelty": ({"sort": "novelty"}, "novelty_score IS NOT NULL"),
    "all": (
        {"country": "eu", "affected_country": "FR", "category": "pathogen", "min_severity": 50.0, "since": _DAY},
        f"country = 'eu' AND {_AFFECTED} AND category = 'pathogen' AND severity_score >= 50 AND report_date >= DATE '1996-03-01'",
    ),
}
for _name, (_kwargs, _where) in _FILTERS.items():
    register(f"flt_{_name}", lambda df, kw=_kwargs: X.recall_filter(df, **kw).select(*_ROWS), f"SELECT {_COLUMNS} FROM notices WHERE {_where}")

register("flt_substring", lambda df: df.where(X.substring_match(F.col("search_text"), "50%")).select(*_ROWS), f"SELECT {_COLUMNS} FROM notices WHERE contains(search_text, '50%')")
register("flt_tri_state", lambda df: X.tri_state(X.tri_state(df.withColumn("seen", F.col("id") % 3 == 0), "seen", False), "id", None).select("recall_number"), "SELECT recall_number FROM notices WHERE id % 3 <> 0")
register("flt_has_date", lambda df: X.has_date(df).select("recall_number"), "SELECT recall_number FROM notices WHERE report_date IS NOT NULL OR recall_initiation_date IS NOT NULL")


def _dim(df):
    """Topics and events of the view: their ids with slugs, per country."""
    return df.groupBy(F.col("topic_id").alias("id"), "country").agg(F.count("*").cast("long").alias("size")).where("id is not null").withColumn("slug", F.concat(F.lit("topic-"), F.col("id").cast("string")))


def _events(df):
    return df.groupBy(F.col("event_cluster_id").alias("id")).agg(F.count("*").alias("recall_count"), F.countDistinct("country").alias("n")).where("id is not null")


register("jn_by_slug", lambda df: X.by_slug(df.where("country = 'us'"), _dim(df), "topic_id", "topic-4", "us").select(*_ROWS), f"SELECT {_COLUMNS} FROM notices WHERE country = 'us' AND topic_id = 4")
register("flt_topic_event", lambda df: X.recall_filter(df, topic=[1, 4], event=[0, 4, 8]).select(*_ROWS), f"SELECT {_COLUMNS} FROM notices WHERE topic_id IN (1, 4) AND event_cluster_id IN (0, 4, 8)")
_HIT = lambda term: F.array_contains(F.split("search_text", "[^a-z0-9]+"), term)
for _label, _term, _least in (("few", "splinters", 10**9), ("many", "listeria", 5)):
    register(
        f"flt_search_{_label}",
        lambda df, t=_term, n=_least: X.search(df, _HIT(t), t[:6], n, country="us").select(*_ROWS),
        f", hits AS (SELECT *, list_contains(string_split_regex(search_text, '[^a-z0-9]+'), '{_term}') AS hit FROM notices WHERE country = 'us') "
        f"SELECT {_COLUMNS} FROM hits WHERE hit OR ((SELECT count(*) FROM hits WHERE hit) < {_least} AND contains(search_text, '{_term[:6]}'))",
    )

# ---- facets
_LABELS = {
    "source": "[source]", "category": "[category]", "classification": "[classification]", "state": "list_distinct(states)",
    "affected_country": "list_distinct(list_concat([notifying_country], distribution_countries))", "company": "[company_name]",
    "entity": "list_distinct(list_transform(entities, lambda e: e.value))", "severity": "[severity_label]", "topic": "[topic_id::VARCHAR]", "event": "[event_cluster_id::VARCHAR]",
}


def _facets_sql(filters: dict[str, str]) -> str:
    parts = []
    for facet, labels in _LABELS.items():
        others = " AND ".join(f"coalesce({w}, false)" for k, w in filters.items() if k != facet) or "true"
        parts.append(f"SELECT '{facet}' AS facet, label, count(*) AS \"count\" FROM (SELECT unnest({labels}) AS label FROM notices WHERE {others}) WHERE label IS NOT NULL GROUP BY label")
    return " UNION ALL ".join(parts)


_FACET_FILTERS = {"category": "category = 'pathogen'", "state": "list_contains(states, 'TX')", "severity": "severity_label = 'severe'"}
register("agg_facets_plain", lambda df: X.facets(df), _facets_sql({}))
register("agg_facets", lambda df: X.facets(df, category="pathogen", state="TX", severity="severe"), _facets_sql(_FACET_FILTERS))
register("agg_facets_eu", lambda df: X.facets(df, country="eu", affected_country="FR", source="rasff", topic=[1, 2, 4]), _facets_sql({"country": "country = 'eu'", "affected_country": _AFFECTED, "source": "source = 'rasff'", "topic": "topic_id IN (1, 2, 4)"}))
register(
    "agg_facets_top", lambda df: X.top_facets(df, country="us"),
    f", f AS ({_facets_sql({'country': chr(34) + 'country' + chr(34) + ' = ' + chr(39) + 'us' + chr(39)})}) SELECT facet, label, \"count\" FROM f QUALIFY facet <> 'company' OR row_number() OVER (PARTITION BY facet ORDER BY \"count\" DESC, label) <= 15",
)

# ---- lists
_PAGE = "ORDER BY {} report_date DESC NULLS LAST, source, recall_number LIMIT 40 OFFSET 20"
register("srt_recency", lambda df: X.list_notices(df, 40, 20, country="us").select(*_ROWS), f"SELECT {_COLUMNS} FROM notices WHERE country = 'us' " + _PAGE.format(""))
register("srt_novelty", lambda df: X.list_notices(df, 40, 20, sort="novelty").select(*_ROWS), f"SELECT {_COLUMNS} FROM notices WHERE novelty_score IS NOT NULL " + _PAGE.format("novelty_score DESC,"))
register(
    "srt_severity", lambda df: X.list_notices(df, 40, 20, sort="severity", events=_events(df), category="pathogen").select(*_ROWS),
    f", ev AS (SELECT event_cluster_id AS eid, count(*) AS recall_count FROM notices WHERE event_cluster_id IS NOT NULL GROUP BY 1) SELECT {_COLUMNS} FROM notices LEFT JOIN ev ON eid = event_cluster_id WHERE category = 'pathogen' "
    + _PAGE.format("severity_score DESC NULLS LAST, recall_count DESC NULLS LAST,"),
)
register(
    "jn_outbreak_size", lambda df: df.join(_events(df).select(F.col("id").alias("event_cluster_id"), "recall_count"), "event_cluster_id", "left").select("recall_number", "recall_count"),
    "SELECT recall_number, recall_count FROM notices LEFT JOIN (SELECT event_cluster_id AS eid, count(*) AS recall_count FROM notices WHERE event_cluster_id IS NOT NULL GROUP BY 1) ON eid = event_cluster_id",
)
