"""Breakdowns, trends and summaries of the notice table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from noticelake.operators.filters import affected_countries, recall_filter
from noticelake.schema import COUNTRY_SOURCES, SEVERITIES


def month_label(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("count"))


def breakdown(df: DataFrame, label: Column) -> DataFrame:
    """``label`` and ``count`` of the rows with a label."""
    return df.select(label.alias("label")).where("label is not null").groupBy("label").agg(F.count("*").alias("count"))


def most_first(counts: DataFrame, n: int | None = None) -> DataFrame:
    ordered = counts.orderBy(F.desc("count"), "label")
    return ordered if n is None else ordered.limit(n)


def by_category(df: DataFrame) -> DataFrame:
    return most_first(breakdown(df, F.col("category")))


def by_month(df: DataFrame) -> DataFrame:
    return breakdown(df, month_label(F.col("report_date"))).orderBy("label")


def by_classification(df: DataFrame) -> DataFrame:
    return breakdown(df, F.col("classification")).orderBy("label")


def by_severity(df: DataFrame) -> DataFrame:
    """Worst first; labels outside the bands last."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("label"))
    return breakdown(df, F.col("severity_label")).withColumn("rank", F.when(rank > 0, rank).otherwise(len(SEVERITIES) + 1)).orderBy("rank", "label")


def by_state(df: DataFrame) -> DataFrame:
    return most_first(breakdown(df.select(F.explode("states").alias("s")), F.col("s")))


def by_affected_country(df: DataFrame) -> DataFrame:
    return most_first(breakdown(df.select(F.explode(affected_countries()).alias("c")), F.col("c")))


def by_company(df: DataFrame, n: int = 15) -> DataFrame:
    return most_first(breakdown(df, F.col("company_name")), n)


def by_source(df: DataFrame) -> DataFrame:
    return most_first(breakdown(df, F.col("source")))


def by_entity(df: DataFrame) -> DataFrame:
    rows = df.select(F.explode("entities").alias("e")).groupBy(F.col("e.type").alias("type"), F.col("e.value").alias("label"))
    return rows.agg(F.count("*").alias("count")).orderBy(F.desc("count"), "type", "label")


def last_ingest(runs: DataFrame, country: str | None = None) -> DataFrame:
    """When a country's sources, or any, last ingested successfully."""
    ok = runs.where("status = 'ok'")
    if country is not None:
        ok = ok.where(F.col("source").isin(*COUNTRY_SOURCES[country]))
    return ok.agg(F.max("finished_at").alias("last_ingest"))


def stats(df: DataFrame) -> DataFrame:
    """All breakdowns at once: ``country`` (null for all), ``breakdown``, ``type``, ``label``, ``count``.

    One scan: every row names its labels, one aggregation counts them, and a second over the counts
    adds the countries up.
    """
    none = F.lit(None).cast("string")
    single = {"total": F.lit("total"), "category": F.col("category"), "month": month_label(F.col("report_date")), "classification": F.col("classification"), "severity": F.col("severity_label"), "company": F.col("company_name"), "source": F.col("source")}
    item = lambda b, t, x: F.struct(F.lit(b).alias("breakdown"), t.alias("type"), x.alias("label"))
    empty = F.array().cast("array<struct<breakdown:string,type:string,label:string>>")
    lists = [
        F.array(*[item(b, none, c) for b, c in single.items()]),
        F.transform("states", lambda x: item("state", none, x)),
        F.transform(affected_countries(), lambda x: item("affected_country", none, x)),
        F.transform("entities", lambda e: item("entity", e["type"], e["value"])),
    ]
    rows = df.select("country", F.explode(F.concat(*[F.coalesce(x, empty) for x in lists])).alias("x")).select("country", "x.*").where("label is not null")
    counts = rows.groupBy("country", "breakdown", "type", "label").agg(F.count("*").alias("count"))
    every = counts.groupBy("breakdown", "type", "label").agg(F.sum("count").alias("count")).select(none.alias("country"), "breakdown", "type", "label", "count")
    return counts.unionByName(every)


def stats_payload(stat: DataFrame, most: int = 15) -> DataFrame:
    """One JSON document per country from ``stats``: breakdowns in order, labels most frequent first.

    Of companies, whose number grows with the data, the document has the ``most`` frequent.
    """
    order = W.partitionBy("country", "breakdown").orderBy(F.desc("count"), "label")
    top = stat.where("breakdown = 'company'").withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= most).drop("__n")
    kept = stat.where("breakdown <> 'company'").unionByName(top)
    inner = kept.groupBy("country", "breakdown").agg(F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("o"), "label", "type", "count"))).alias("rows"))
    shaped = inner.withColumn("rows", F.transform("rows", lambda r: F.struct(r["label"].alias("label"), r["type"].alias("type"), r["count"].alias("count"))))
    return shaped.groupBy("country").agg(F.to_json(F.sort_array(F.collect_list(F.struct("breakdown", "rows")))).alias("payload"))


def companies(df: DataFrame, q: str, limit: int = 30, **filters) -> DataFrame:
    """Companies matching what was typed, under all filters but the company's own."""
    filters.pop("company", None)
    return most_first(breakdown(recall_filter(df, company=q, **filters), F.col("company_name")), limit)


_TREND = {"total": F.lit, "category": "category", "source": "source", "severity": "severity_label", "classification": "classification"}


def trend(df: DataFrame, group: str = "total", **filters) -> DataFrame:
    """``month``, ``label``, ``count``; notices without a class are Unclassified."""
    if group not in _TREND:
        raise ValueError(f"unknown group {group}")
    label = F.lit("total") if group == "total" else F.coalesce(F.col(_TREND[group]), F.lit("Unclassified")) if group == "classification" else F.col(_TREND[group])
    rows = recall_filter(df, **filters).where("report_date is not null").select(month_label(F.col("report_date")).alias("month"), label.alias("label")).where("label is not null")
    return rows.groupBy("month", "label").agg(F.count("*").alias("count"))


def category_series(df: DataFrame) -> DataFrame:
    return trend(df, "category")


def entity_series(df: DataFrame, top: int = 20) -> DataFrame:
    """Monthly counts of the entities with most dated notices, by value alone."""
    rows = df.where("report_date is not null").select(month_label(F.col("report_date")).alias("month"), F.explode(F.array_distinct(F.transform("entities", lambda e: e["value"]))).alias("label"))
    counts = rows.groupBy("month", "label").agg(F.count("*").alias("count"))
    best = counts.groupBy("label").agg(F.sum("count").alias("n")).orderBy(F.desc("n"), "label").limit(top)
    return counts.join(best.select("label"), "label", "left_semi")


def pivot_counts(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """One row with a count per given value, zero where there is none."""
    return df.agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])


def flag_counts(df: DataFrame, **predicates: Column) -> DataFrame:
    return df.agg(F.count("*").alias("total"), *[F.count_if(p).alias(n) for n, p in predicates.items()])


def latest(runs: DataFrame, ts: str = "started_at", key: str = "id") -> DataFrame:
    """The row that started last, by id among equals."""
    return runs.agg(F.max_by(F.struct("*"), F.struct(ts, key)).alias("r")).select("r.*")


def overview(*one_row_frames: DataFrame) -> DataFrame:
    """One row of all summaries; each frame has exactly one."""
    out, *rest = one_row_frames
    for frame in rest:
        out = out.crossJoin(frame)
    return out


def high_water(df: DataFrame, key: str, column: str) -> DataFrame:
    return df.groupBy(key).agg(F.max(column).alias("high_water"))


def groups(df: DataFrame, key: str, least: int = 2) -> DataFrame:
    """Keys, other than null and blank, that several rows share."""
    return df.where(F.length(F.trim(F.col(key).cast("string"))) > 0).groupBy(key).agg(F.count("*").alias("size")).where(F.col("size") >= least)


def list_topics(topics: DataFrame, country: str | None = None) -> DataFrame:
    kept = topics.where("size > 0")
    return (kept if country is None else kept.where(F.col("country") == country)).orderBy(F.desc("size"), "id")


def list_events(events: DataFrame, country: str | None = None, outbreaks_only: bool = False) -> DataFrame:
    kept = events.where("is_outbreak") if outbreaks_only else events
    return (kept if country is None else kept.where(F.col("country") == country)).orderBy(F.desc("is_outbreak"), F.desc("recall_count"), "id")


def unique_slugs(df: DataFrame, base: str, part: str, order: str) -> DataFrame:
    """Adds ``slug``: the base, with -2, -3 and so on for later rows of the same part and base."""
    n = F.row_number().over(W.partitionBy(part, base).orderBy(order))
    return df.withColumn("slug", F.when(n == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("-"), n.cast("string"))))
