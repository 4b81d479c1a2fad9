"""The shared set of notice filters. An argument left out adds no constraint; all given ones hold."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Filters that are facets of their own, by the name of their argument.
FACETS = ("source", "category", "classification", "state", "affected_country", "company", "entity", "severity", "topic", "event")


def affected_countries() -> Column:
    """Codes of the notifying country and the distribution, each once; an empty array for none."""
    every = F.array_union(F.array("notifying_country"), F.coalesce("distribution_countries", F.array().cast("array<string>")))
    return F.filter(every, lambda c: c.isNotNull())


def substring_match(text: Column, term: str) -> Column:
    """True where lower-case text has the term; no character of the term is a wildcard."""
    return text.contains(term.lower())


def conditions(
    *, country: str | None = None, source: str | None = None, category: str | None = None, classification: str | None = None,
    state: str | None = None, affected_country: str | None = None, company: str | None = None, entity: str | None = None,
    min_severity: float | None = None, severity: str | None = None, topic: Iterable[int] | None = None, event: Iterable[int] | None = None,
    since: dt.date | None = None, until: dt.date | None = None, search: Column | None = None, sort: str | None = None,
) -> dict[str, Column]:
    """One null-free condition per given filter, by argument name.

    ``company`` is a case-insensitive pattern between wildcards in which % and _ stay wildcards. A
    blank ``affected_country`` is ignored. ``topic`` and ``event`` take ids; ``by_slug`` resolves
    slugs by a join. Rows without a date fail ``since`` and ``until``.
    """
    if since and until and since > until:
        raise ValueError("since is after until")
    out: dict[str, Column] = {}
    for name, value, column in (("country", country, "country"), ("source", source, "source"), ("category", category, "category"), ("classification", classification, "classification"), ("severity", severity, "severity_label")):
        if value is not None:
            out[name] = F.col(column) == value
    if state is not None:
        out["state"] = F.array_contains("states", state)
    if affected_country is not None and affected_country.strip():
        code = affected_country.strip().upper()
        out["affected_country"] = F.coalesce(F.col("notifying_country") == code, F.lit(False)) | F.coalesce(F.array_contains("distribution_countries", code), F.lit(False))
    if company is not None:
        out["company"] = F.col("company_name").ilike(f"%{company}%")
    if entity is not None:
        out["entity"] = F.exists("entities", lambda e: e["value"] == entity)
    if min_severity is not None:
        out["min_severity"] = F.col("severity_score") >= min_severity
    if topic is not None:
        out["topic"] = F.col("topic_id").isin(*topic)
    if event is not None:
        out["event"] = F.col("event_cluster_id").isin(*event)
    if since is not None:
        out["since"] = F.col("report_date") >= F.lit(since)
    if until is not None:
        out["until"] = F.col("report_date") <= F.lit(until)
    if search is not None:
        out["search"] = search
    if sort == "novelty":
        out["sort"] = F.col("novelty_score").isNotNull()
    return {k: F.coalesce(c, F.lit(False)) for k, c in out.items()}


def recall_filter(df: DataFrame, **filters) -> DataFrame:
    # plain comparisons, without the null guard, are what reaches the scan
    for name, column in (("country", "country"), ("source", "source"), ("category", "category"), ("classification", "classification")):
        if filters.get(name) is not None:
            df = df.where(F.col(column) == filters.pop(name))
    met = conditions(**filters)
    return df.where(reduce(lambda a, b: a & b, met.values())) if met else df


def by_slug(df: DataFrame, dim: DataFrame, column: str, slug: str, country: str | None = None) -> DataFrame:
    """Rows whose ``column`` is the id of a topic or event with the slug, of the country if given."""
    ids = dim.where(F.col("slug") == slug)
    if country is not None:
        ids = ids.where(F.col("country") == country)
    return df.join(ids.select(F.col("id").alias(column)), column, "left_semi")


def tri_state(df: DataFrame, column: str, value: bool | None) -> DataFrame:
    return df if value is None else df.where(F.col(column) == value)


def has_date(df: DataFrame) -> DataFrame:
    return df.where(F.col("recall_initiation_date").isNotNull() | F.col("report_date").isNotNull())


def facets(df: DataFrame, **filters) -> DataFrame:
    """``facet``, ``label``, ``count``: every facet under all filters but its own, in one scan.

    A row counts for a facet if it fails no filter, or only that facet's. Labels of array columns
    count once per row and value.
    """
    met = conditions(**filters)
    failed = {k: F.when(c, 0).otherwise(1) for k, c in met.items()}
    total = reduce(lambda a, b: a + b, failed.values(), F.lit(0))
    labels = {
        "source": F.array("source"), "category": F.array("category"), "classification": F.array("classification"), "state": F.array_distinct("states"),
        "affected_country": affected_countries(), "company": F.array("company_name"), "entity": F.array_distinct(F.transform("entities", lambda e: e["value"])),
        "severity": F.array("severity_label"), "topic": F.array(F.col("topic_id").cast("string")), "event": F.array(F.col("event_cluster_id").cast("string")),
    }
    needed = df.select(
        total.alias("__fails"), *[failed[k].alias(f"__f_{k}") for k in FACETS if k in failed],
        *[F.coalesce(c, F.array().cast("array<string>")).alias(k) for k, c in labels.items()],
    )
    open_ = lambda k: (F.col("__fails") == F.col(f"__f_{k}")) if k in failed else (F.col("__fails") == 0)
    each = F.flatten(F.array(*[F.when(open_(k), _named(k)).otherwise(F.array().cast("array<struct<facet:string,label:string>>")) for k in FACETS]))
    rows = needed.where("__fails <= 1").select(F.explode(each).alias("x")).select("x.facet", "x.label").where("label is not null")
    return rows.groupBy("facet", "label").agg(F.count("*").alias("count"))


def _named(facet: str) -> Column:
    return F.transform(facet, lambda x: F.struct(F.lit(facet).alias("facet"), x.alias("label")))


def top_facets(df: DataFrame, companies: int = 15, **filters) -> DataFrame:
    """The facets, with companies cut to the most frequent."""
    from pyspark.sql import Window as W

    order = W.partitionBy("facet").orderBy(F.desc("count"), "label")
    return facets(df, **filters).withColumn("n", F.row_number().over(order)).where((F.col("facet") != "company") | (F.col("n") <= companies)).drop("n")


def search(df: DataFrame, hit: Column, term: str, min_hits: int = 5, **filters) -> DataFrame:
    """Rows that a full-text condition meets; substrings count too if it meets too few.

    The number of hits under all filters is one aggregate, and meets the rows as a single value.
    """
    kept = recall_filter(df, **filters).withColumn("__hit", F.coalesce(hit, F.lit(False)))
    few = kept.agg((F.count_if("__hit") < min_hits).alias("__few"))
    return kept.crossJoin(F.broadcast(few)).where(F.col("__hit") | (F.col("__few") & substring_match(F.col("search_text"), term))).drop("__hit", "__few")


def list_notices(df: DataFrame, limit: int = 50, offset: int = 0, sort: str = "recency", events: DataFrame | None = None, relevance: Column | None = None, **filters) -> DataFrame:
    """A page of notices. Nulls come last in every order; the key breaks ties.

    ``severity`` puts larger outbreaks first among equal scores, by the ``recall_count`` of ``events``;
    ``relevance``, given with a search, goes before all.
    """
    kept = recall_filter(df, sort=sort, **filters)
    order = [relevance.desc_nulls_last()] if relevance is not None else []
    if sort == "severity":
        if events is None:
            raise ValueError("sorting by severity needs the events")
        sizes = events.select(F.col("id").alias("event_cluster_id"), F.col("recall_count").alias("__size"))
        kept = kept.join(sizes, "event_cluster_id", "left")
        order += [F.col("severity_score").desc_nulls_last(), F.col("__size").desc_nulls_last()]
    elif sort == "novelty":
        order += [F.col("novelty_score").desc_nulls_last()]
    order += [F.col("report_date").desc_nulls_last(), F.col("source"), F.col("recall_number")]
    return kept.orderBy(*order).offset(offset).limit(limit).drop("__size")
