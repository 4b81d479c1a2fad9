"""Feeds landed as JSON files, read with explicit schemas and brought into the normalized form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticelake.functions import gazetteer as G
from noticelake.functions import parsing as P
from noticelake.functions import severity as S
from noticelake.functions.once import once
from noticelake.operators.tables import first_by
from noticelake.schema import NOTICE

ENFORCEMENT = "results array<struct<recall_number:string,event_id:string,status:string,classification:string,product_description:string,reason_for_recall:string,recalling_firm:string,state:string,distribution_pattern:string,recall_initiation_date:string,report_date:string>>"
FSIS = "field_recall_number string, field_recall_url string, field_title string, field_recall_classification string, field_recall_reason array<string>, field_summary string, field_product_items array<string>, field_establishment array<string>, field_states array<string>, field_recall_date string, field_active_notice string, langcode string"
FSA = "items array<struct<notation:string,title:string,created:string,type:array<string>,status:struct<label:string>,alertURL:string,reportingBusiness:struct<commonName:string>,problem:array<struct<riskStatement:string>>,productDetails:array<struct<productName:string>>>>"
CFIA = "`NID` string, `Title` string, `URL` string, `Organization` string, `Product` string, `Issue` string, `Recall class` string, `Last updated` string, `Archived` string"
NCC = "id int, slug string, link string, `date` string, modified string, title struct<rendered:string>, content struct<rendered:string>, excerpt struct<rendered:string>"
RASFF = "value array<struct<NOTIF_ID:bigint,NOTIFICATION_REFERENCE:string,NOTIF_DATE:string,PRODUCT_NAME:string,NOTIF_SUBJECT:string,NOTIFYNG_COUNTRY_DESC:string,NOTIFICATION_CLASSIFICAT_DESC:string,HAZARD_CATEGORY_NAME:string,ORIGIN_COUNTRY_DESC:string,DISTRIBUTION_COUNTRY_DESC:string,NETWORK_DESC:string>>"
MEASURE = "array<struct<url:string,actionTaken:struct<description:string>>>"
MEASURES = f"notification_id long, product struct<measures:{MEASURE},relatedProducts:array<struct<measures:{MEASURE}>>>"
SEED = "source string, recall_number string, source_url string, product_description string, reason_text string, company_name string, report_date string"
NEWS = "Id int, Title string, Created string"
MEDIA = "Name string, ServerRelativeUrl string, ListItemAllFields struct<Id:int,Title:string,ReleaseDate:string>"


def _json(spark: SparkSession, path: str, schema: str, lines: bool) -> DataFrame:
    """A landed feed: one document per file or, with ``lines``, one per line, which splits large files."""
    return spark.read.schema(schema).json(path, multiLine=not lines)


def read_enforcement(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    return _json(spark, path, ENFORCEMENT, lines).select(F.explode("results").alias("r")).select("r.*")


def read_fsis(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    return _json(spark, path, FSIS, lines).where("langcode = 'English'")


def read_fsa(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    return _json(spark, path, FSA, lines).select(F.explode("items").alias("r")).select("r.*")


def read_cfia(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    rows = _json(spark, path, CFIA, lines).withColumnsRenamed({"Recall class": "recall_class", "Last updated": "last_updated"})
    return rows.where("Organization = 'CFIA' and length(trim(NID)) > 0")


def read_ncc(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    return _json(spark, path, NCC, lines)


def read_rasff(spark: SparkSession, path: str, since: Column | None = None, lines: bool = False) -> DataFrame:
    rows = _json(spark, path, RASFF, lines).select(F.explode("value").alias("r")).select("r.*")
    kept = rows.where((F.col("NETWORK_DESC") == "RASFF") & P.is_eu_recall(F.col("NOTIFICATION_CLASSIFICAT_DESC")) & (F.length(F.trim("NOTIFICATION_REFERENCE")) > 0))
    return kept if since is None else kept.where(P.parse_iso_date(F.col("NOTIF_DATE")) >= since)


def read_measures(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    return _json(spark, path, MEASURES, lines)


def read_seed(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    return _json(spark, path, SEED, lines)


def read_watch(spark: SparkSession, path: str, kind: str, lines: bool = False) -> DataFrame:
    """Items of a watched list: source, key, title, date, address. Items without a key are dropped."""
    if kind == "news":
        rows = _json(spark, path, NEWS, lines).select(F.lit("news").alias("source"), F.col("Id").cast("string").alias("item_key"), F.trim("Title").alias("title"), P.parse_iso_date(F.col("Created")).alias("release_date"), F.lit(None).cast("string").alias("url"))
    else:
        item = F.col("ListItemAllFields")
        title = F.coalesce(F.nullif(F.trim(item["Title"]), F.lit("")), F.col("Name"))
        rows = _json(spark, path, MEDIA, lines).select(F.lit("media").alias("source"), item["Id"].cast("string").alias("item_key"), title.alias("title"), P.parse_iso_date(item["ReleaseDate"]).alias("release_date"), F.col("ServerRelativeUrl").alias("url"))
    return rows.where("item_key is not null")


def _normalized(df: DataFrame, entity_text: Column | None = None, **columns: Column) -> DataFrame:
    """The normalized row of given columns: the rest is null, hazards and severity are derived."""
    text = {f.name: columns.get(f.name, F.lit(None)).cast(f.dataType) for f in NOTICE if f.name not in ("category", "category_confidence", "severity_score", "severity_label", "entities")}
    rows = once(df, **text, __entity_text=entity_text if entity_text is not None else columns["reason_text"])
    rows = once(rows, entities=G.extract_entities(F.col("__entity_text")))
    rows = once(rows, category=G.label_category(F.col("reason_text"), F.col("entities")))
    rows = rows.withColumn("category_confidence", F.when(F.col("category") == "other", 0.0).otherwise(1.0))
    score = S.severity_score(F.col("classification"), F.col("category"), F.col("entities"), F.col("states"), F.col("distribution_pattern"), F.col("reason_text"))
    rows = once(rows, severity_score=score).withColumn("severity_label", S.severity_label(F.col("severity_score")))
    return rows.select(*NOTICE.names)


def _one(state: Column) -> Column:
    return F.when(state.isNotNull(), F.array(state))


def normalize_enforcement(df: DataFrame) -> DataFrame:
    state = P.parse_us_state(F.col("state"))
    return _normalized(
        df, source=F.lit("fda"), country=F.lit("us"), recall_number=F.col("recall_number"), event_id=F.col("event_id"), status=F.col("status"),
        classification=P.parse_class(F.col("classification")), product_description=P.strip_html(F.col("product_description")), reason_text=P.strip_html(F.col("reason_for_recall")),
        company_name=F.nullif(P.strip_html(F.col("recalling_firm")), F.lit("")), state=state, states=_one(state), distribution_pattern=F.col("distribution_pattern"),
        recall_initiation_date=P.parse_compact_date(F.col("recall_initiation_date")), report_date=P.parse_compact_date(F.col("report_date")), raw=F.to_json(F.struct("*")),
    )


def normalize_fsis(df: DataFrame) -> DataFrame:
    states = P.map_states(F.col("field_states"))
    reasons = F.concat_ws(", ", F.col("field_recall_reason"))
    date = P.parse_iso_date(F.col("field_recall_date"))
    return _normalized(
        df, source=F.lit("usda"), country=F.lit("us"), recall_number=F.col("field_recall_number"), source_url=F.col("field_recall_url"), status=P.notice_status(F.col("field_active_notice")),
        classification=P.parse_class(F.col("field_recall_classification")), product_description=F.coalesce(F.nullif(P.strip_html(F.concat_ws("; ", "field_product_items")), F.lit("")), P.strip_html(F.col("field_title"))),
        reason_text=F.when(reasons != "", reasons).otherwise(P.strip_html(F.col("field_summary"))), company_name=F.nullif(P.strip_html(F.get("field_establishment", F.lit(0))), F.lit("")),
        state=F.when(F.size(states) == 1, F.get(states, F.lit(0))), states=states, recall_initiation_date=date, report_date=date, raw=F.to_json(F.struct("*")),
    )


def normalize_fsa(df: DataFrame) -> DataFrame:
    risk = F.array_join(F.filter(F.transform("problem", lambda p: F.trim(p["riskStatement"])), lambda x: x != ""), " ")
    products = F.array_join(F.filter(F.transform("productDetails", lambda p: F.trim(p["productName"])), lambda x: x != ""), " / ")
    date = P.parse_iso_date(F.col("created"))
    title = P.strip_html(F.col("title"))
    return _normalized(
        df, source=F.lit("uk"), country=F.lit("uk"), recall_number=F.col("notation"), source_url=F.col("alertURL"), status=F.col("status.label"), classification=P.alert_class(F.col("type")),
        product_description=F.coalesce(F.nullif(P.strip_html(products), F.lit("")), title), reason_text=F.coalesce(F.nullif(P.strip_html(risk), F.lit("")), title),
        company_name=F.nullif(P.strip_html(F.col("reportingBusiness.commonName")), F.lit("")), recall_initiation_date=date, report_date=date, raw=F.to_json(F.struct("*")),
    )


def normalize_cfia(df: DataFrame) -> DataFrame:
    title, product = P.strip_html(F.col("Title")), P.strip_html(F.col("Product"))
    date = P.parse_iso_date(F.col("last_updated"))
    return _normalized(
        df, source=F.lit("cfia"), country=F.lit("ca"), recall_number=F.col("NID"), source_url=F.col("URL"), status=F.when(F.col("Archived") == "1", "Archived").otherwise("Active"),
        classification=P.ladder_class(F.col("recall_class")), product_description=P.product_line(title, product), reason_text=F.coalesce(F.nullif(P.strip_html(F.col("Issue")), F.lit("")), title),
        recall_initiation_date=date, report_date=date, raw=F.to_json(F.struct("*")),
    )


def canonical_dedupe(posts: DataFrame, slug: str = "slug", ordinal: str = "id") -> DataFrame:
    """One post per recall: of those with one canonical slug a dedicated post before others, then the first."""
    return first_by(posts, [P.canonical_slug(F.col(slug))], (~P.is_dedicated_post(F.col(slug))).cast("int"), F.col(ordinal))


def normalize_ncc(df: DataFrame) -> DataFrame:
    """Posts about one recall of food; other goods, closures and digests are left out."""
    # both texts are decoded at once and held: every place where they were decoded again had Python workers of its own
    rows = once(df.where(P.is_recall_post(F.col("slug"))), __title=P.strip_html(F.col("title.rendered")), __plain=P.strip_html(F.col("content.rendered")))
    title, plain, body = F.col("__title"), F.col("__plain"), F.col("content.rendered")
    product = P.product_from_title(title)
    date = P.parse_iso_date(F.col("date"))
    return _normalized(
        rows.where(P.is_food(title, plain)), source=F.lit("ncc"), country=F.lit("za"), recall_number=F.col("slug"), source_url=F.col("link"), product_description=product,
        reason_text=P.strip_html(P.lede(body, product)), company_name=P.company_from_body(plain), recall_initiation_date=date, report_date=date, raw=F.to_json(F.struct(*df.columns)),
    )


def normalize_rasff(df: DataFrame) -> DataFrame:
    subject, hazard, product = P.strip_html(F.col("NOTIF_SUBJECT")), P.hazard_text(F.col("HAZARD_CATEGORY_NAME")), P.strip_html(F.col("PRODUCT_NAME"))
    reason = F.when(subject != "", subject).otherwise(F.concat_ws(" in ", hazard, product))
    date = P.parse_iso_date(F.col("NOTIF_DATE"))
    return _normalized(
        df, F.concat_ws(" ", reason, hazard), source=F.lit("rasff"), country=F.lit("eu"), recall_number=F.col("NOTIFICATION_REFERENCE"),
        source_url=F.concat(F.lit("https://webgate.ec.europa.eu/rasff-window/screen/notification/"), F.col("NOTIF_ID").cast("string")), product_description=product, reason_text=reason,
        notifying_country=P.iso(F.col("NOTIFYNG_COUNTRY_DESC")), origin_countries=P.iso_list(F.col("ORIGIN_COUNTRY_DESC")), distribution_countries=P.iso_list(F.col("DISTRIBUTION_COUNTRY_DESC")),
        recall_initiation_date=date, report_date=date, raw=F.to_json(F.struct("*")),
    )


def normalize_seed(df: DataFrame) -> DataFrame:
    date = P.parse_iso_date(F.col("report_date"))
    return _normalized(
        df, source=F.col("source"), country=F.lit("za"), recall_number=F.col("recall_number"), source_url=F.col("source_url"), product_description=F.col("product_description"),
        reason_text=F.col("reason_text"), company_name=F.col("company_name"), recall_initiation_date=date, report_date=date, raw=F.to_json(F.struct("*")),
    )


def normalize_all(*feeds: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, feeds)


def best_measure(df: DataFrame) -> DataFrame:
    """Per notification its address and actions: the first recall's or withdrawal's, else the first."""
    none = F.array().cast(MEASURE)
    own = F.concat(F.coalesce("product.measures", none), F.coalesce(F.flatten(F.transform("product.relatedProducts", lambda p: F.coalesce(p["measures"], none))), none))
    rows = df.select("notification_id", own.alias("m"))
    named = F.filter("m", lambda x: F.length(x["url"]) > 0)
    strong = F.filter(named, lambda x: F.lower(x["actionTaken"]["description"]).rlike("recall|withdraw"))
    url = F.coalesce(F.get(strong, F.lit(0))["url"], F.get(named, F.lit(0))["url"])
    actions = F.filter(F.transform("m", lambda x: x["actionTaken"]["description"]), lambda a: F.length(a) > 0)
    return rows.select("notification_id", F.when(url.rlike("^https?://"), url).otherwise(F.concat(F.lit("https://"), url)).alias("enriched_url"), actions.alias("actions"))


def apply_enrichment(df: DataFrame, measures: DataFrame, key: str, page: str) -> DataFrame:
    """Upgrades addresses that are missing or still point at the fallback page; sets status from actions."""
    joined = df.join(measures.withColumnRenamed("notification_id", key), key, "left")
    weak = F.col("source_url").isNull() | F.col("source_url").contains(page)
    url = F.when(weak, F.coalesce("enriched_url", "source_url")).otherwise(F.col("source_url"))
    return joined.withColumn("source_url", url).withColumn("status", F.coalesce(P.action_status(F.col("actions")), F.col("status"))).select(*df.columns)
