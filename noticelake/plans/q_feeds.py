"""Registered feeds: notices landed as JSON in the shared folder, read by schema and normalized.

Every notice of a feed's country is written the way the feed writes it, pages of a hundred where the
feed has pages, and comes back through reader and normalizer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticelake.functions import parsing as P
from noticelake.plans.notices import SQL, source_rows, table
from noticelake.sources import feeds as S
from noticelake.storage import fresh_path

QUERIES, ORACLE = {}, {}
_day = lambda: F.date_format("report_date", "yyyy-MM-dd")


def _land(df: DataFrame, name: str) -> str:
    path = fresh_path(df.sparkSession, f"feed-{name}")
    df.write.json(path)
    return path


def _pages(df: DataFrame, key: str, item) -> DataFrame:
    """A hundred items a page, in a list under ``key``."""
    return df.groupBy(F.floor(F.col("id") / 100).alias("page")).agg(F.collect_list(item).alias(key)).drop("page")


def _register(name: str, build, sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(source_rows(spark, sf_dir))
    ORACLE[name] = SQL + sql


def _enforcement(d: DataFrame) -> DataFrame:
    item = F.struct(
        "recall_number", "event_id", F.lit("Ongoing").alias("status"), "classification", F.concat("product_description", F.lit(" &amp; <b>more</b>")).alias("product_description"),
        F.col("reason_text").alias("reason_for_recall"), F.col("company_name").alias("recalling_firm"), F.lower(F.get("states", F.lit(0))).alias("state"), "distribution_pattern",
        F.date_format("report_date", "yyyyMMdd").alias("report_date"), F.lit("n/a").alias("recall_initiation_date"),
    )
    return S.normalize_enforcement(S.read_enforcement(d.sparkSession, _land(_pages(d.where("source = 'fda'"), "results", item), "enforcement"), lines=True))


_COMMON = ["recall_number", "source", "country", "status", "classification", "product_description", "reason_text", "company_name", "state", "states", "report_date", "category"]
_register(
    "src_enforcement", lambda d: _enforcement(d).select(*_COMMON, "event_id", "recall_initiation_date"),
    "SELECT recall_number, source, country, 'Ongoing' AS status, CASE WHEN classification LIKE 'Class%' OR classification = 'Product Recall' THEN classification END AS classification, product_description || ' & more' AS product_description, reason_text, company_name, states[1] AS state, CASE WHEN len(states) > 0 THEN [states[1]] END AS states, report_date, category, event_id, NULL::DATE AS recall_initiation_date FROM notices WHERE source = 'fda'",
)


def _fsis(d: DataFrame) -> DataFrame:
    names = {code: name for name, code in P.US_STATES.items()}
    lookup = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    rows = d.where("source = 'usda'").select(
        F.col("recall_number").alias("field_recall_number"), F.lit("https://x.example/1").alias("field_recall_url"), F.concat(F.lit("<p>"), F.col("product_description"), F.lit("</p>")).alias("field_title"),
        F.col("classification").alias("field_recall_classification"), F.array("reason_text").alias("field_recall_reason"), F.array(F.lit("")).alias("field_product_items"), F.array("company_name").alias("field_establishment"),
        F.concat(F.transform("states", lambda x: F.element_at(lookup, x)), F.array(F.lit("Ontario"))).alias("field_states"), _day().alias("field_recall_date"),
        F.when(F.col("id") % 4 < 2, "True").otherwise("False").alias("field_active_notice"), F.when(F.col("id") % 3 > 0, "English").otherwise("Spanish").alias("langcode"),
    )
    return S.normalize_fsis(S.read_fsis(d.sparkSession, _land(rows, "fsis"), lines=True))


_register(
    "src_fsis", lambda d: _fsis(d).select(*_COMMON),
    "SELECT recall_number, source, country, CASE WHEN id % 4 < 2 THEN 'Active' ELSE 'Closed' END AS status, classification, product_description, reason_text, company_name, CASE WHEN len(states) = 1 THEN states[1] END AS state, states, report_date, category FROM notices WHERE source = 'usda' AND id % 3 > 0",
)


def _fsa(d: DataFrame) -> DataFrame:
    kinds = F.element_at(F.array(F.array(F.lit("http://x.example/Alert"), F.lit("http://x.example/AA")), F.array(F.lit("http://x.example/PRIN")), F.array(F.lit("http://x.example/Other"))), (F.col("id") % 3 + 1).cast("int"))
    item = F.struct(
        F.col("recall_number").alias("notation"), F.col("product_description").alias("title"), _day().alias("created"), kinds.alias("type"), F.struct(F.lit("Published").alias("label")).alias("status"),
        F.lit("https://x.example/2").alias("alertURL"), F.struct(F.col("company_name").alias("commonName")).alias("reportingBusiness"), F.array(F.struct(F.col("reason_text").alias("riskStatement"))).alias("problem"),
        F.array(F.struct(F.col("product_description").alias("productName")), F.struct(F.lit(" B ").alias("productName"))).alias("productDetails"),
    )
    return S.normalize_fsa(S.read_fsa(d.sparkSession, _land(_pages(d.where("source = 'uk'"), "items", item), "fsa"), lines=True))


_register(
    "src_fsa", lambda d: _fsa(d).select(*_COMMON),
    "SELECT recall_number, source, country, 'Published' AS status, ['Allergy Alert', 'Product Recall', NULL][id % 3 + 1] AS classification, product_description || ' / B' AS product_description, reason_text, company_name, NULL::VARCHAR AS state, NULL::VARCHAR[] AS states, report_date, category FROM notices WHERE source = 'uk'",
)


def _cfia(d: DataFrame) -> DataFrame:
    rows = d.where("source = 'cfia'").select(
        F.when(F.col("id") % 10 > 0, F.col("recall_number")).otherwise(" ").alias("NID"), F.concat(F.lit("Certain ACME brand "), F.col("product_description"), F.lit(" recalled")).alias("Title"), F.lit("https://x.example/3").alias("URL"),
        F.when(F.col("id") % 4 > 0, "CFIA").otherwise("Health Canada").alias("Organization"), F.col("product_description").alias("Product"), F.col("reason_text").alias("Issue"),
        F.concat(F.lit("Class "), (F.col("id") % 3 + 1).cast("string")).alias("Recall class"), _day().alias("Last updated"), (F.col("id") % 2).cast("string").alias("Archived"),
    )
    return S.normalize_cfia(S.read_cfia(d.sparkSession, _land(rows, "cfia"), lines=True))


_register(
    "src_cfia", lambda d: _cfia(d).select(*_COMMON),
    "SELECT recall_number, source, country, CASE WHEN id % 2 = 1 THEN 'Archived' ELSE 'Active' END AS status, ['Class I', 'Class II', 'Class III'][id % 3 + 1] AS classification, 'ACME ' || product_description AS product_description, reason_text, NULL::VARCHAR AS company_name, NULL::VARCHAR AS state, NULL::VARCHAR[] AS states, report_date, category FROM notices WHERE source = 'cfia' AND id % 4 > 0 AND id % 10 > 0",
)


def _posts(d: DataFrame) -> DataFrame:
    """Posts of one feed: some recalls have a twin under another kind of post, some are of other goods, some are closed."""
    base = d.where("source = 'ncc'")
    twin = lambda prefix, add: base.where("id % 8 = 0" if add else "true").select(
        (F.col("id") * 2 + add).cast("int").alias("id"), F.concat(F.lit(prefix), F.lit("notice-"), F.col("recall_number")).alias("slug"), F.lit("https://x.example/4").alias("link"), _day().alias("date"), _day().alias("modified"),
        F.struct(F.concat(F.when(F.col("id") % 9 == 0, "Product recall – dog food, ").otherwise("Product recall – "), F.col("product_description")).alias("rendered")).alias("title"),
        F.struct(F.concat(F.lit("<p>"), F.col("reason_text"), F.lit("</p><p>It was reported by "), F.coalesce("company_name", F.lit("Nobody")), F.lit(".</p>")).alias("rendered")).alias("content"), F.struct(F.lit("").alias("rendered")).alias("excerpt"),
    )
    return twin("product-recall-", 1).unionByName(twin("media-statement-recall-of-", 0)).unionByName(twin("product-recall-closed-", 1))


#: The view's words for food, as they stand in its texts.
_NCC = "source = 'ncc' AND id % 9 <> 0 AND regexp_matches(product_description || ' ' || reason_text, '(?i)\\b(milk|cheese|chocolate|formula|bread|tuna|fish|rice|egg|dried fruit|best before|listeria|salmonella|norovirus|hepatitis|cereulide)\\b')"

_register(
    "src_ncc", lambda d: S.normalize_ncc(S.canonical_dedupe(S.read_ncc(d.sparkSession, _land(_posts(d), "ncc"), lines=True))).select(*_COMMON),
    "SELECT CASE WHEN id % 8 = 0 THEN 'product-recall-' ELSE 'media-statement-recall-of-' END || 'notice-' || recall_number AS recall_number, source, country, NULL::VARCHAR AS status, NULL::VARCHAR AS classification, product_description, reason_text || ' It was reported by ' || coalesce(company_name, 'Nobody') || '.' AS reason_text, coalesce(company_name, 'Nobody') AS company_name, NULL::VARCHAR AS state, NULL::VARCHAR[] AS states, report_date, category FROM notices WHERE " + _NCC,
)


def _rasff(d: DataFrame, since=None) -> DataFrame:
    names = F.create_map(*[F.lit(x) for pair in (("DE", "Germany"), ("FR", "France"), ("BE", "Belgium"), ("NL", "Netherlands"), ("ES", "Spain")) for x in pair])
    kinds = F.element_at(F.array(*map(F.lit, ("Alert notification", "Information notification for attention", "Border rejection"))), (F.col("id") % 3 + 1).cast("int"))
    item = F.struct(
        F.col("id").alias("NOTIF_ID"), F.col("recall_number").alias("NOTIFICATION_REFERENCE"), _day().alias("NOTIF_DATE"), F.col("product_description").alias("PRODUCT_NAME"), F.col("reason_text").alias("NOTIF_SUBJECT"),
        F.element_at(names, F.col("notifying_country")).alias("NOTIFYNG_COUNTRY_DESC"), kinds.alias("NOTIFICATION_CLASSIFICAT_DESC"), F.lit("other - {x}").alias("HAZARD_CATEGORY_NAME"), F.lit("Atlantis *** Germany").alias("ORIGIN_COUNTRY_DESC"),
        F.array_join(F.transform("distribution_countries", lambda c: F.element_at(names, c)), "***").alias("DISTRIBUTION_COUNTRY_DESC"), F.when(F.col("id") % 7 > 0, "RASFF").otherwise("iRASFF").alias("NETWORK_DESC"),
    )
    return S.normalize_rasff(S.read_rasff(d.sparkSession, _land(_pages(d.where("source = 'rasff'"), "value", item), "rasff"), since, lines=True))


_register(
    "src_rasff", lambda d: _rasff(d, F.lit("1993-01-01").cast("date")).select("recall_number", "source", "notifying_country", "origin_countries", "distribution_countries", "product_description", "reason_text", "report_date", "category"),
    "SELECT recall_number, source, notifying_country, ['DE'] AS origin_countries, distribution_countries, product_description, reason_text, report_date, category FROM notices WHERE source = 'rasff' AND id % 3 < 2 AND id % 7 > 0 AND report_date >= DATE '1993-01-01'",
)


def _enriched(d: DataFrame) -> DataFrame:
    rows = d.where("source = 'rasff'")
    measure = lambda url, act: F.struct(url.alias("url"), F.struct(act.alias("description")).alias("actionTaken"))
    own = F.array(measure(F.concat(F.lit("a.example/"), F.col("recall_number")), F.lit("Destruction")))
    other = F.array(F.struct(F.array(measure(F.concat(F.lit("https://b.example/"), F.col("recall_number")), F.when(F.col("id") % 2 == 0, "Recall from consumer").otherwise("Release"))).alias("measures")))
    landed = _land(rows.where("id % 5 > 0").select(F.col("id").alias("notification_id"), F.struct(own.alias("measures"), other.alias("relatedProducts")).alias("product")), "measures")
    notices = rows.select("id", "recall_number", F.when(F.col("id") % 3 == 0, "https://kept.example/").otherwise("https://fallback.example/page").alias("source_url"), F.lit("Open").alias("status"))
    return S.apply_enrichment(notices, S.best_measure(S.read_measures(d.sparkSession, landed, lines=True)), "id", "fallback.example")


_register(
    "src_measures", _enriched,
    "SELECT id, recall_number, CASE WHEN id % 3 = 0 THEN 'https://kept.example/' WHEN id % 5 = 0 THEN 'https://fallback.example/page' WHEN id % 2 = 0 THEN 'https://b.example/' || recall_number ELSE 'https://a.example/' || recall_number END AS source_url, CASE WHEN id % 5 = 0 THEN 'Open' WHEN id % 2 = 0 THEN 'Recall from consumer' ELSE 'Destruction; Release' END AS status FROM notices WHERE source = 'rasff'",
)


def _seed(d: DataFrame) -> DataFrame:
    rows = d.where("country = 'za' and source <> 'ncc'").select("source", "recall_number", F.lit("https://x.example/5").alias("source_url"), "product_description", "reason_text", "company_name", _day().alias("report_date"))
    return S.normalize_seed(S.read_seed(d.sparkSession, _land(rows, "seed"), lines=True))


_register("src_seed", lambda d: _seed(d).select("recall_number", "source", "country", "product_description", "reason_text", "company_name", "report_date", "category"), "SELECT recall_number, source, country, product_description, reason_text, company_name, report_date, category FROM notices WHERE country = 'za' AND source <> 'ncc'")
_register(
    "nrm_all", lambda d: S.normalize_all(_enforcement(d), _fsis(d), _fsa(d), _cfia(d), S.normalize_ncc(S.canonical_dedupe(S.read_ncc(d.sparkSession, _land(_posts(d), "ncc"), lines=True))), _rasff(d), _seed(d)).groupBy("source", "category").agg(F.count("*").alias("count"), F.max("report_date").alias("newest")),
    'SELECT source, category, count(*) AS "count", max(report_date) AS newest FROM notices WHERE source IN (\'fda\', \'uk\') OR (source = \'usda\' AND id % 3 > 0) OR (source = \'cfia\' AND id % 4 > 0 AND id % 10 > 0) OR (source = \'rasff\' AND id % 3 < 2 AND id % 7 > 0) OR (country = \'za\' AND source <> \'ncc\') OR (' + _NCC + ") GROUP BY 1, 2",
)


def _watch(spark, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    day = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    news = e.where("event_id % 2 = 0").select(F.when(F.col("event_id") % 10 > 0, F.col("event_id")).cast("int").alias("Id"), F.concat(F.lit(" "), F.col("event_type")).alias("Title"), day.alias("Created"))
    media = e.where("event_id % 2 = 1").select(F.concat("event_type", F.lit(".pdf")).alias("Name"), F.lit("/x").alias("ServerRelativeUrl"), F.struct(F.col("event_id").cast("int").alias("Id"), F.when(F.col("event_id") % 3 > 0, F.col("event_type")).otherwise(" ").alias("Title"), day.alias("ReleaseDate")).alias("ListItemAllFields"))
    return S.read_watch(spark, _land(news, "news"), "news", lines=True).unionByName(S.read_watch(spark, _land(media, "media"), "media", lines=True))


QUERIES["src_watch"] = _watch
ORACLE["src_watch"] = "SELECT CASE WHEN event_id % 2 = 0 THEN 'news' ELSE 'media' END AS source, event_id::VARCHAR AS item_key, CASE WHEN event_id % 2 = 0 OR event_id % 3 > 0 THEN event_type ELSE event_type || '.pdf' END AS title, ts::DATE AS release_date, CASE WHEN event_id % 2 = 1 THEN '/x' END AS url FROM events WHERE event_id % 10 > 0"
