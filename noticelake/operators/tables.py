"""Upserts, deduplication, write-backs, retention and data-quality probes on keyed tables."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from noticelake.schema import CATEGORIES, COUNTRIES, KEY, SEVERITIES


def first_by(df: DataFrame, keys: list[str | Column], *order: Column) -> DataFrame:
    """One row per key: the first in order."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def keep_last(df: DataFrame, ordinal: str, keys: list[str] = KEY) -> DataFrame:
    """The row of every key that arrived last."""
    return first_by(df, keys, F.col(ordinal).desc())


def dedupe_subscriptions(subs: DataFrame, statuses: tuple[str, ...] = ("active", "paused", "pending_confirmation", "unsubscribed")) -> DataFrame:
    """One row per address in any case: best status, then newest update, newest creation, largest id."""
    rank = F.array_position(F.array(*map(F.lit, statuses)), F.col("status"))
    best = F.when(rank > 0, rank).otherwise(len(statuses) + 1)
    return first_by(subs, [F.lower("email")], best, F.col("updated_at").desc_nulls_last(), F.col("created_at").desc_nulls_last(), F.col("id").desc())


def new_rows(batch: DataFrame, target: DataFrame, keys: list[str] = KEY) -> DataFrame:
    return batch.join(target.select(*keys), keys, "left_anti")


def upsert(target: DataFrame, batch: DataFrame, stamp: Column, keys: list[str] = KEY) -> DataFrame:
    """The target with the batch's rows put in: all columns but the keys change, and ``updated_at``.

    The batch has one row per key. Rows the batch does not name stay as they are. Rows keep their
    ``created_at``; new ones get the stamp. One outer join on the keys does it all.
    """
    fresh = batch.select(*keys, *[F.col(c).alias(f"__b_{c}") for c in batch.columns if c not in keys], F.lit(True).alias("__hit"))
    joined = target.join(fresh, keys, "full")
    out = []
    for c in target.columns:
        if c in keys:
            out.append(F.col(c))
        elif c == "created_at":
            out.append(F.coalesce(c, stamp).alias(c))
        else:
            out.append(F.when(F.col("__hit"), stamp if c == "updated_at" else F.col(f"__b_{c}")).otherwise(F.col(c)).alias(c))
    return joined.select(*out)


def ingest(target: DataFrame, batch: DataFrame, ordinal: str, stamp: Column) -> tuple[DataFrame, DataFrame]:
    """The upserted table, and one row of counts: fetched, distinct, new."""
    values = [c for c in batch.columns if c not in (*KEY, ordinal)]
    last = batch.groupBy(*KEY).agg(F.max_by(F.struct(*values), ordinal).alias("__v"), F.count("*").alias("__n"))
    known = target.select(*KEY, F.lit(True).alias("__known"))
    counts = last.join(known, KEY, "left").agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("fetched"), F.count("*").alias("upserted"), F.count_if(F.col("__known").isNull()).alias("new"))
    return upsert(target, last.select(*KEY, "__v.*"), stamp), counts


def attach(df: DataFrame, derived: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """``df`` with the derived columns in place of its own, null where none was derived."""
    columns = [c for c in derived.columns if c not in keys]
    joined = df.drop(*columns).join(derived, keys, "left")
    return joined.select(*df.columns, *[c for c in columns if c not in df.columns])


_POINTER = "number long, version string"


def publish(df: DataFrame, path: str) -> str:
    """Replaces a derived table as a whole: a new version is written, then its name is.

    Readers of the old version are not disturbed; ``published`` reads the highest number. Writers
    that meet take the same number, and the name decides between them for every reader alike.
    """
    spark = df.sparkSession
    number = (_current(spark, path)["number"] or 0) + 1
    version = f"v-{number:010d}-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{version}")
    spark.createDataFrame([(number, version)], _POINTER).coalesce(1).write.mode("append").json(f"{path}/current")
    return version


def _current(spark, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/current")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return {"number": None, "version": None}
    return spark.read.schema(_POINTER).json(f"{path}/current").agg(F.max(F.struct("number", "version")).alias("c")).select("c.*").first()


def published(spark, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{_current(spark, path)['version']}")


def audit(spark, path: str, source: str, started, counts: dict[str, int] | None = None, error: str | None = None) -> None:
    """Appends a row about an ingest run; the error's text is cut at 2000 characters."""
    counts = counts or {}
    row = [(source, started, counts.get("fetched"), counts.get("upserted"), "error" if error else "ok", error[:2000] if error else None)]
    frame = spark.createDataFrame(row, "source string, started_at timestamp, fetched_count long, upserted_count long, status string, error string")
    frame.withColumn("finished_at", F.current_timestamp()).write.mode("append").parquet(path)


def audited(batch: DataFrame, source: str, runs: str, ordinal: str, put) -> dict[str, int]:
    """Writes the last row of every key by ``put`` and appends a row about it to ``runs``, also where it fails; returns the counts.

    What came and what was kept is observed on the way: nothing is read twice.
    """
    spark, came, kept = batch.sparkSession, Observation("came"), Observation("kept")
    began = datetime.datetime.now()
    last = keep_last(batch.observe(came, F.count(F.lit(1)).alias("n")), ordinal).observe(kept, F.count(F.lit(1)).alias("n"))
    try:
        put(last)
        counts = {"fetched": came.get["n"], "upserted": kept.get["n"]}
    except Exception as error:
        audit(spark, runs, source, began, error=str(error))
        raise
    audit(spark, runs, source, began, counts)
    return counts


def lookup(df: DataFrame, requests: DataFrame, keys: list[str] = KEY, most: int = 100_000) -> DataFrame:
    """Every request with the row of its composite key, null where there is none.

    Few requests, as of one page, go to the rows: then the table is neither moved nor sorted.
    """
    asked = requests.select(*keys).distinct()
    hits = df.join(F.broadcast(asked) if asked.limit(most + 1).count() <= most else asked, keys, "left_semi")
    return requests.join(hits, keys, "left")


# ---- retention


def retain_first(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows in order."""
    return df.orderBy(*order).limit(n)


def retain_newest(df: DataFrame, among: Column, n: int, *newest: Column) -> DataFrame:
    """All rows outside ``among``, and the newest ``n`` inside."""
    return df.where(~among).unionByName(df.where(among).orderBy(*newest).limit(n))


def keep_top(df: DataFrame, n: int, keys: list[str], *order: Column) -> DataFrame:
    """The rows to delete: all but the first ``n``."""
    return df.join(df.orderBy(*order).limit(n).select(*keys), keys, "left_anti")


def page(df: DataFrame, limit: int, offset: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def head_with_overflow(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows, each with the number of rows that did not fit."""
    over = df.agg(F.greatest(F.count("*") - n, F.lit(0)).alias("overflow"))
    return df.orderBy(*order).limit(n).crossJoin(F.broadcast(over))


def leaderboard(scores: DataFrame, version: str | None = None, limit: int = 50) -> DataFrame:
    """Unflagged scores, best first, earlier before later; 200 at most."""
    kept = scores.where("not flagged") if version is None else scores.where((~F.col("flagged")) & (F.col("version") == version))
    return kept.orderBy(F.desc("score"), F.asc("created_at"), F.asc("id")).limit(min(limit, 200))


# What a believable run of the game may show, and how fast a person fills a form.
POINTS_BASE, POINTS_A_KILL, KILLS_A_WAVE, MS_A_WAVE, FASTEST_FORM_MS = 1_000, 1_000, 80, 10_000, 2_000


def plausibility(df: DataFrame) -> DataFrame:
    """Adds ``flag_reason``, the first check a score fails, and ``flagged``."""
    reason = (
        F.when(F.col("score") > POINTS_BASE + F.col("kills") * POINTS_A_KILL, "score-exceeds-kills")
        .when(F.col("kills") > KILLS_A_WAVE * (F.col("wave") + 1), "kills-exceed-wave")
        .when((F.col("wave") > 1) & (F.col("duration_ms") < F.col("wave") * MS_A_WAVE), "too-fast-for-wave")
    )
    return df.withColumn("flag_reason", reason).withColumn("flagged", F.col("flag_reason").isNotNull())


def bot_flags(df: DataFrame, fastest_ms: int = FASTEST_FORM_MS) -> DataFrame:
    """Adds ``bot_reason``, the first sign of a bot, and ``is_bot``."""
    reason = F.when(F.length(F.trim("honeypot")) > 0, "honeypot").when(F.col("elapsed_ms") < fastest_ms, "too-fast")
    return df.withColumn("bot_reason", reason).withColumn("is_bot", F.col("bot_reason").isNotNull())


def split_valid(df: DataFrame, **checks: Column) -> DataFrame:
    """Adds ``violations``: the names of the checks a row fails. Empty means valid."""
    failed = [F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]
    return df.withColumn("violations", F.array_compact(F.array(*failed)))


_LENGTH = lambda c, most: F.coalesce(F.length(c) <= most, F.lit(True))

# The bounds of what may be submitted.
SCORE_BOUNDS = {"score": 100_000_000, "kills": 10_000_000, "wave": 1_000_000, "level": 1_000_000, "duration_ms": 86_400_000, "currency": 1_000_000_000, "space_metal": 10_000_000, "upgrades_purchased": 100_000, "ultimates_owned": 1_000}
SHIP_KINDS = ("fighter", "interceptor", "dreadnought")
NAME_LENGTH, VERSION_LENGTH = 30, 20
MOST_CRITERIA, ENTITY_LENGTH, COMPANY_LENGTH = 50, 100, 200


def quarantine(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The valid rows, without ``violations``, and the others with them."""
    return checked.where(F.size("violations") == 0).drop("violations"), checked.where(F.size("violations") > 0)


def validate_scores(df: DataFrame, name_length: int = NAME_LENGTH) -> DataFrame:
    """Submissions with ``violations``; names and versions are trimmed, a blank name becomes Anonymous. Lengths are those before."""
    bare = lambda c: F.btrim(F.col(c), F.lit(" \t\n\r\f\x0b"))
    ranges = {c: F.col(c).between(0, most) for c, most in SCORE_BOUNDS.items() if c in df.columns}
    version = F.length("version").between(1, VERSION_LENGTH) & (bare("version") != "")
    checked = split_valid(df, name=_LENGTH(F.col("name"), name_length), ship_kind=F.col("ship_kind").isin(*SHIP_KINDS), version=version, **ranges)
    return checked.withColumns({"name": F.coalesce(F.nullif(bare("name"), F.lit("")), F.lit("Anonymous")), "version": bare("version")})


def validate_criteria(df: DataFrame) -> DataFrame:
    """Subscriptions with ``violations``: known countries, one at least; known bands, categories; bounded lists."""
    some = lambda c, kind="array<string>": F.coalesce(F.col(c), F.array().cast(kind))
    short = lambda c, most: (F.size(some(c)) <= MOST_CRITERIA) & F.forall(some(c), lambda x: F.length(x) <= most)
    return split_valid(
        df, countries=(F.size(some("countries")) > 0) & F.forall(some("countries"), lambda x: x.isin(*COUNTRIES)), min_severity=F.col("min_severity").isNull() | F.col("min_severity").isin(*SEVERITIES),
        categories=F.forall(some("categories"), lambda x: x.isin(*CATEGORIES)), affected_countries=(F.size(some("affected_countries")) <= MOST_CRITERIA) & F.forall(some("affected_countries"), lambda x: x.rlike("^[A-Za-z]{2}$")),
        entities=short("entities", ENTITY_LENGTH), companies=short("companies", COMPANY_LENGTH),
    )


def validate_messages(df: DataFrame, longest: int = 5000, field: int = 200) -> DataFrame:
    """Messages, trimmed, with ``violations``: not blank, bounded fields, an address with a dotted domain."""
    trimmed = df.withColumn("message", F.trim("message"))
    mail = F.coalesce(F.length("email"), F.lit(0)) == 0
    return split_valid(trimmed, message=(F.length("message") > 0) & _LENGTH(F.col("message"), longest), email=(mail | (F.col("email").contains("@") & F.substring_index("email", "@", -1).contains("."))) & _LENGTH(F.col("email"), field), name=_LENGTH(F.col("name"), field), elapsed_ms=F.col("elapsed_ms").isNull() | (F.col("elapsed_ms") >= 0))


# ---- migrations


def to_array(column: str) -> Column:
    """A scalar as an array of one; null and blank become null."""
    return F.when(F.length(F.trim(column)) > 0, F.array(column))


def known_only(column: str, codes: tuple[str, ...]) -> Column:
    return F.when(F.col(column).isin(*codes), F.col(column))


def renamed(column: str, old: str, new: str) -> Column:
    return F.when(F.col(column) == old, new).otherwise(F.col(column))


def first_of(column: str) -> Column:
    return F.get(column, F.lit(0))


def never_built(events: DataFrame, df: DataFrame) -> DataFrame:
    """One row: how many notices and events there are, and whether events were never built for them."""
    both = df.agg(F.count("*").alias("notices")).crossJoin(events.agg(F.count("*").alias("events")))
    return both.withColumn("never_built", (F.col("notices") > 0) & (F.col("events") == 0))


# ---- probes


def is_stale(df: DataFrame, built_at: Column, column: str = "updated_at") -> DataFrame:
    newest = F.max(column)
    return df.agg(F.when(newest.isNull(), False).otherwise(built_at.isNull() | (newest > built_at)).alias("stale"))


def probe_sample(df: DataFrame, n: int = 500, column: str = "report_date") -> DataFrame:
    """The newest rows, rows without a date first, as the store sorts them."""
    return df.orderBy(F.col(column).desc_nulls_first(), *KEY).limit(n)


def probe_rederive(df: DataFrame, stored: str, again: Column, tolerance: float = 0.05, n: int = 500) -> DataFrame:
    """How many of the newest rows would change if a score were derived again."""
    sample = probe_sample(df, n)
    differs = ~F.coalesce(F.abs(F.col(stored) - again) <= tolerance, F.col(stored).isNull() & again.isNull())
    return sample.agg(F.count("*").alias("sampled"), F.count_if(differs).alias("changed"))


def probe_empty(df: DataFrame, stored: str, again: Column) -> DataFrame:
    """How many rows with an empty array would gain something."""
    return df.where(F.size(stored) == 0).agg(F.count("*").alias("empty"), F.count_if(F.size(again) > 0).alias("would_gain"))


def missing_derived(df: DataFrame, column: str, eligible: Column) -> DataFrame:
    return df.where(eligible).agg(F.count("*").alias("eligible"), F.count_if(F.col(column).isNull()).alias("missing"))


def is_seeded(runs: DataFrame, source: str, floor: int) -> DataFrame:
    return runs.where(F.col("source") == source).agg(F.coalesce(F.max("fetched_count") >= floor, F.lit(False)).alias("seeded"))


def upgrade_ratio(df: DataFrame, upgraded: Column) -> DataFrame:
    return df.agg(F.count("*").alias("rows"), F.count_if(upgraded).alias("upgraded")).withColumn("ratio", F.when(F.col("rows") > 0, F.col("upgraded") / F.col("rows")))


def contract(df: DataFrame, us_states: tuple[str, ...]) -> DataFrame:
    """Violations of the normalized form, per rule: markup in texts, foreign state codes, no identity."""
    texts = [F.coalesce(F.col(c), F.lit("")).rlike(r"<[a-zA-Z/][^>]*>|&[a-z]+;|&#[0-9]+;") for c in ("product_description", "reason_text", "company_name")]
    codes = F.exists(F.coalesce("states", F.array().cast("array<string>")), lambda s: ~s.isin(*us_states))
    blank = lambda c: F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) == 0
    rules = {"markup": texts[0] | texts[1] | texts[2], "states": codes, "identity": blank("recall_number") | blank("source")}
    counts = df.agg(*[F.count_if(c).alias(n) for n, c in rules.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])).alias("x")).select("x.*")


def set_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """What is missing from and what is extra in ``actual``."""
    missing = expected.exceptAll(actual).withColumn("side", F.lit("missing"))
    return missing.unionByName(actual.exceptAll(expected).withColumn("side", F.lit("extra")))
