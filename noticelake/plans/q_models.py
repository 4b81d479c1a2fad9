"""Registered validity rules, migrations, saved models, predictions and the rebuild of all derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from noticelake.functions import gazetteer as G
from noticelake.operators import alerts as L
from noticelake.operators import models as M
from noticelake.operators import tables as T
from noticelake.operators import vectors as V
from noticelake.plans.notices import SQL, source_rows, table, view
from noticelake.plans.q_feeds import _watch
from noticelake.storage import cut, fresh_path

QUERIES, ORACLE = {}, {}


def register(name: str, build, sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(view(spark, sf_dir))
    if sql is not None:
        ORACLE[name] = SQL + sql


def on(name: str, tables: str, build, sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(*[table(spark, sf_dir, t) for t in tables.split()])
    if sql is not None:
        ORACLE[name] = sql


# ---- validity
_scores = lambda p: p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 4 > 0, F.rpad(F.concat(F.lit(" "), F.col("p_brand")), (F.col("p_partkey") % 7 + 26).cast("int"), F.lit("x"))).otherwise(" \t").alias("name"), (F.floor("p_retailprice") - 950).cast("long").alias("score"), F.element_at(F.array(*map(F.lit, ("fighter", "interceptor", "dreadnought", "tug"))), (F.col("p_partkey") % 4 + 1).cast("int")).alias("ship_kind"), F.when(F.col("p_partkey") % 5 > 1, F.col("p_brand")).when(F.col("p_partkey") % 5 > 0, "  ").otherwise("").alias("version"), (F.col("p_size") * 2_500_000).alias("duration_ms"))
on(
    "fn_validate_scores", "part", lambda p: T.validate_scores(_scores(p)).select("id", "name", F.array_sort("violations").alias("violations")),
    "SELECT p_partkey AS id, CASE WHEN p_partkey % 4 > 0 THEN rpad(p_brand, (p_partkey % 7 + 25)::INT, 'x') ELSE 'Anonymous' END AS name, list_sort(list_filter([CASE WHEN p_partkey % 4 > 0 AND p_partkey % 7 > 4 THEN 'name' END, CASE WHEN p_partkey % 4 = 3 THEN 'ship_kind' END, CASE WHEN p_partkey % 5 < 2 THEN 'version' END, CASE WHEN floor(p_retailprice) < 950 THEN 'score' END, CASE WHEN p_size * 2500000 > 86400000 THEN 'duration_ms' END], lambda x: x IS NOT NULL)) AS violations FROM part",
)
on("fn_quarantine", "part", lambda p: (lambda ok, bad: ok.select("id", F.lit(True).alias("valid")).unionByName(bad.select("id", F.lit(False).alias("valid"))))(*T.quarantine(T.validate_scores(_scores(p)))), "SELECT p_partkey AS id, NOT (p_partkey % 4 = 3 OR (p_partkey % 4 > 0 AND p_partkey % 7 > 4) OR p_partkey % 5 < 2 OR floor(p_retailprice) < 950 OR p_size * 2500000 > 86400000) AS valid FROM part")
_key = lambda: F.col("c_custkey")
_criteria = lambda c: c.select(_key().alias("id"), F.when(_key() % 3 > 0, F.array(F.lit("us"), F.when(_key() % 7 == 0, "nz").otherwise("eu"))).alias("countries"), F.when(_key() % 4 > 0, F.element_at(F.array(*map(F.lit, ("high", "odd", "low"))), (_key() % 3 + 1).cast("int"))).alias("min_severity"), F.when(_key() % 5 > 0, F.array(F.lit("pathogen"), F.when(_key() % 11 == 0, "x").otherwise("other"))).alias("categories"), F.when(_key() % 2 == 0, F.array(F.lit("de"), F.when(_key() % 8 == 0, "DEU").otherwise("FR"))).alias("affected_countries"), F.transform(F.sequence(F.lit(1), (_key() % 60).cast("int") + 1), lambda i: F.lit("e")).alias("entities"), F.array(F.repeat("c_name", (_key() % 20).cast("int"))).alias("companies"))
on(
    "fn_validate_criteria", "customer", lambda c: T.validate_criteria(_criteria(c)).select("id", F.array_sort("violations").alias("violations")),
    "SELECT c_custkey AS id, list_sort(list_filter([CASE WHEN c_custkey % 3 = 0 OR c_custkey % 7 = 0 THEN 'countries' END, CASE WHEN c_custkey % 4 > 0 AND c_custkey % 3 = 1 THEN 'min_severity' END, CASE WHEN c_custkey % 5 > 0 AND c_custkey % 11 = 0 THEN 'categories' END, CASE WHEN c_custkey % 8 = 0 THEN 'affected_countries' END, CASE WHEN c_custkey % 60 >= 50 THEN 'entities' END, CASE WHEN length(c_name) * (c_custkey % 20) > 200 THEN 'companies' END], lambda x: x IS NOT NULL)) AS violations FROM customer",
)
_messages = lambda c: c.select(_key().alias("id"), F.when(_key() % 5 > 0, F.concat(F.lit("  "), F.col("c_name"))).otherwise("  ").alias("message"), F.element_at(F.array(F.lit("a@b.example"), F.lit("a@example"), F.lit(""), F.lit(None).cast("string")), (_key() % 4 + 1).cast("int")).alias("email"), F.col("c_name").alias("name"), (_key() % 9 - 1).alias("elapsed_ms"))
on(
    "fn_validate_messages", "customer", lambda c: T.validate_messages(_messages(c)).select("id", "message", F.array_sort("violations").alias("violations")),
    "SELECT c_custkey AS id, CASE WHEN c_custkey % 5 > 0 THEN c_name ELSE '' END AS message, list_sort(list_filter([CASE WHEN c_custkey % 5 = 0 THEN 'message' END, CASE WHEN c_custkey % 4 = 1 THEN 'email' END, CASE WHEN c_custkey % 9 = 0 THEN 'elapsed_ms' END], lambda x: x IS NOT NULL)) AS violations FROM customer",
)
on("str_new_messages", "events", lambda e: L.new_messages(e.select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), (F.col("event_type") == "error").alias("is_bot")), F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")).select("id"), "SELECT event_id AS id FROM events WHERE ts > TIMESTAMP '2024-01-10' AND event_type <> 'error'")
QUERIES["srt_watch"] = lambda s, d: L.sort_watch(_watch(s, d)).select("source", "item_key", "release_date")
ORACLE["srt_watch"] = "SELECT CASE WHEN event_id % 2 = 0 THEN 'news' ELSE 'media' END AS source, event_id::VARCHAR AS item_key, ts::DATE AS release_date FROM events WHERE event_id % 10 > 0"

# ---- migrations and passes over stored rows
register(
    "fn_migrate", lambda d: d.select("recall_number", T.to_array("company_name").alias("companies"), T.known_only("country", ("us", "ca")).alias("north"), T.renamed("severity_label", "moderate", "medium").alias("label"), T.first_of("states").alias("state")),
    "SELECT recall_number, CASE WHEN company_name IS NOT NULL THEN [company_name] END AS companies, CASE WHEN country IN ('us', 'ca') THEN country END AS north, CASE WHEN severity_label = 'moderate' THEN 'medium' ELSE severity_label END AS label, states[1] AS state FROM notices",
)
register(
    "txt_decode", lambda d: M.decode_text(d.select("recall_number", F.when(F.col("id") % 2 == 0, F.concat("reason_text", F.lit(" &amp;lt;b&amp;gt; <i>x</i>"))).otherwise(F.col("reason_text")).alias("reason_text")), ["reason_text"]).select("recall_number", "reason_text"),
    "SELECT recall_number, CASE WHEN id % 2 = 0 THEN reason_text || ' &lt;b&gt; x' ELSE reason_text END AS reason_text FROM notices",
)


def _rederived(spark, sf_dir):
    """Stored rows whose derived columns are stale, derived again and attached."""
    stored = source_rows(spark, sf_dir).withColumn("category", F.lit("other")).withColumn("severity_score", F.lit(0.0))
    again = M.rederive(stored).select("source", "recall_number", "category", "severity_score", "severity_label", "entities")
    return T.attach(stored.select("source", "recall_number", "category", "severity_score"), again)


QUERIES["txt_rederive"] = _rederived
ORACLE["txt_rederive"] = SQL + "SELECT source, recall_number, category, severity_score, severity_label, entities FROM notices"
register("dq_never_built", lambda d: T.never_built(d.where("event_cluster_id is not null and id < 0"), d), "SELECT count(*) AS notices, 0::BIGINT AS events, count(*) > 0 AS never_built FROM notices")

# ---- models
register("ml_class_counts", M.class_counts, "SELECT country, classification, count(*) AS \"count\" FROM notices WHERE country IN ('us', 'ca') AND classification IN ('Class I', 'Class II', 'Class III') GROUP BY 1, 2")


def _vectors(spark, sf_dir):
    """Token vectors of the notices' words: every word borrows one of the stored embeddings by its hash."""
    texts = source_rows(spark, sf_dir).select(F.concat_ws(" ", "reason_text", "product_description").alias("text")).distinct()
    words = texts.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,}"), F.lit(0)))).alias("token")).distinct()
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    n = e.agg(F.max("vec_id").alias("n"))
    return cut(words.crossJoin(n).select("token", F.pmod(F.xxhash64("token"), F.col("n") + 1).alias("vec_id")).join(e, "vec_id").select("token", "vector"), "token-vectors")


def _embedded(spark, sf_dir, rows):
    """Stored rows with the vectors of their reasons, which join them when they are read: a vector is many times a row."""
    return V.with_embedding(cut(rows, "unembedded"), "reason_text", _vectors(spark, sf_dir))


QUERIES["ml_embed"] = lambda s, d: V.embed(source_rows(s, d).select("id", "reason_text"), "id", "reason_text", _vectors(s, d)).select("id", F.round(V.dot(F.col("vector"), F.col("vector")), 6).alias("size"))
ORACLE["ml_embed"] = SQL + "SELECT id, 1.0::DOUBLE AS size FROM notices"
QUERIES["ml_cross_country"] = lambda s, d: M.eval_cross(_embedded(s, d, source_rows(s, d).select("id", "country", "classification", "reason_text")), "vector", "us", "ca")


def _predicted(spark, sf_dir):
    rows = _embedded(spark, sf_dir, view(spark, sf_dir).select("recall_number", "country", "classification", "category", "entities", "states", "distribution_pattern", "reason_text"))
    known = M.with_class_index(rows.where("country in ('us', 'ca') and vector is not null"))
    return M.predict_class(rows, "vector", M.train_vectors(known, "vector", "y")).select("recall_number", "country", "predicted_class", "confidence", "severity_score", "severity_label")


QUERIES["ml_predict_class"] = _predicted
QUERIES["ml_predict_without_model"] = lambda s, d: M.predict_class(view(s, d).withColumn("vector", F.lit(None).cast("array<double>")), "vector", None).select("recall_number", "predicted_class", "confidence", "severity_score")
ORACLE["ml_predict_without_model"] = SQL + "SELECT recall_number, NULL::VARCHAR AS predicted_class, NULL::DOUBLE AS confidence, severity_score FROM notices WHERE country IN ('uk', 'za', 'eu')"


def _saved(spark, sf_dir):
    """How many rows a stored model predicts as it did before it was stored."""
    from pyspark.ml.classification import LogisticRegressionModel

    rows = cut(table(spark, sf_dir, "embeddings").withColumn("y", (F.col("label") % 2).cast("double")), "labelled")
    path = fresh_path(spark, "model")
    model = M.train_vectors(rows, "embedding", "y")
    missing = M.load_model(spark, LogisticRegressionModel, path) is None
    M.save_model(model, path)
    before = M.apply_vectors(rows, "embedding", model).select("vec_id", F.col("prediction").alias("a"))
    after = M.apply_vectors(rows, "embedding", M.load_model(spark, LogisticRegressionModel, path)).select("vec_id", F.col("prediction").alias("b"))
    return before.join(after, "vec_id").agg(F.count("*").alias("rows"), F.count_if(F.col("a") == F.col("b")).alias("same")).withColumn("missing_before", F.lit(missing))


QUERIES["snk_model"] = _saved
ORACLE["snk_model"] = "SELECT count(*) AS rows, count(*) AS same, true AS missing_before FROM embeddings"


def _classified(spark, sf_dir):
    """Notices classified by a model of the weak labels, with hazards the rules name as a rescue."""
    rows = cut(view(spark, sf_dir).select("id", "recall_number", "reason_text", "entities", "category"), "weak-labels")
    names = [r["category"] for r in rows.select("category").distinct().orderBy("category").limit(16).collect()]
    at = F.array_position(F.array(*map(F.lit, names)), F.col("category"))
    model = M.train_text(rows.withColumn("y", (at - 1).cast("double")), "reason_text", "y")
    rule = G.label_category(F.col("reason_text"), F.col("entities"))
    return rows, M.classify(rows.withColumnRenamed("category", "weak"), "reason_text", rule, model, names)


QUERIES["txt_classify_model"] = lambda s, d: M.evaluate(_classified(s, d)[1], "weak", "category")
QUERIES["txt_rescued"] = lambda s, d: M.rescued(_classified(s, d)[1], "weak", "category", "category_confidence")
QUERIES["ml_rebuild"] = lambda s, d: M.rebuild(view(s, d), _vectors(s, d))[2].select("country", "id", "theme", "size", "label", "slug")
QUERIES["ml_rebuild_novelty"] = lambda s, d: M.rebuild(view(s, d), _vectors(s, d), floor=2**62)[1]
