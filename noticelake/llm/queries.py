"""One query per operator, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticelake.functions.once import once
from noticelake.llm import decontaminate, html_text, langid, media, periodic, pieces, pii, preferences, prefix_trie, sharding, simhash, substrings, token_counts

SHARDS = 16


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(_documents(spark, sf_dir).select("doc_id", "text", "lang"))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), F.col("language.lang").alias("lang_pred"), "language.score", "language.cross_entropy", "language.rejected")


def op2_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    found = preferences.format_pairs(turns, preferences.adjacent_pairs(turns))
    return found.select(
        "pair_id", "n_common", "prompt", F.col("chosen.text").alias("chosen"), preferences.masks(F.col("chosen.mask")).alias("chosen_mask"),
        F.col("rejected.text").alias("rejected"), preferences.masks(F.col("rejected.mask")).alias("rejected_mask"),
    )


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.spans(_documents(spark, sf_dir).select("doc_id", "text"))
    base = pii.listed(F.col("base"))
    return found.select(
        F.col("key").alias("doc_id"),
        *[pii.count_of(F.col("base"), kind).alias(f"n_{kind}") for kind in pii.KINDS],
        F.sha2(base, 256).alias("base_sha256"),
        pii.listed(F.concat("base", "terms")).alias("spans"),
    )


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return html_text.with_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    sampled = pieces.with_samples(_documents(spark, sf_dir).select("doc_id", "text"))
    # all samples of a text decoded at once: each begins with the space that encoding puts there
    held = sampled.select("doc_id", "text", "samples", pieces.decoder()(F.flatten("samples.ids")).alias("decoded"))
    return held.select(
        "doc_id",
        F.transform("samples.ids", F.size).alias("n_pieces"),
        F.transform("samples.ids", lambda x: F.xxhash64(x)).alias("ids_xxh64"),
        F.col("samples.log_prob").alias("log_prob"),
        F.col("samples.log_inclusion").alias("log_inclusion"),
        (F.col("decoded") == F.array_join(F.array_repeat(pieces.spaced(F.col("text")), F.size("samples")), " ")).alias("round_trip"),
    )


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(_documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = _documents(spark, sf_dir).select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = sharding.slots(sharding.assign(rows, "doc_id", [1.0] * SHARDS), "shard", "doc_id")
    grown = sharding.assign(placed, "doc_id", [1.0] * (SHARDS + 1), "grown_shard")
    return grown.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.with_matches(_documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", (F.size("matches") > 0).alias("contaminated"), F.col("matches.item_id").alias("item_ids"), F.coalesce(F.array_max("matches.overlap"), F.lit(0.0)).alias("overlap"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.read_back(media.headers(media.pack(_documents(spark, sf_dir))))
    return stored.select(F.col("key").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "depth")


def _replayed(docs: DataFrame) -> DataFrame:
    """Every tenth document's words from word a on become repetitions of p words; the others' texts stay."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    split = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0))
    told = once(docs.withColumn("g", F.floor(h / 10)), words=split).withColumn("n", F.greatest(F.coalesce(F.size("words"), F.lit(0)), F.lit(0)))
    least = F.greatest("n", F.lit(1))
    placed = told.withColumn("a", (F.col("g") % least).cast("int"))
    placed = once(placed, a=F.col("a"), p=(1 + F.floor((least - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    at = lambda i: F.element_at("words", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")) + 1)
    again = F.array_join(F.transform(F.sequence(F.lit(0), least - 1), at), " ")
    return placed.select("doc_id", F.when(F.col("n") > 0, again).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.with_runs(_replayed(_documents(spark, sf_dir).select("doc_id", "text")), out="found")
    runs = F.col("found.runs")
    # the greatest length over period; the first of equal ones, since runs are ordered
    best = F.reduce(runs, F.get(runs, F.lit(0)), lambda b, x: F.when(x["length"] * b["period"] > b["length"] * x["period"], x).otherwise(b))
    line = F.array_join(F.transform(runs, lambda x: F.concat(x["start"].cast("string"), F.lit(","), x["length"].cast("string"), F.lit(","), x["period"].cast("string"), F.lit("\n"))), "")
    told = found.select("doc_id", F.size(runs).cast("long").alias("n_runs"), best.alias("b"), F.sha2(line, 256).alias("runs_sha256"), F.sha2("found.text", 256).alias("collapsed_sha256"))
    exponent = F.expr("1000 * b.length div b.period")
    return told.select("doc_id", "n_runs", "b.start", "b.length", "b.period", exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = prefix_trie.sequences(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    head = (F.crc32(F.col("c").cast("string").cast("binary")) % 6).cast("int")
    return prefix_trie.trie(prefix_trie.rebased(found, F.col("c") - F.col("c") % 100, head, most=5))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.with_counts(_documents(spark, sf_dir).select("doc_id", "text"))
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return counted.select("doc_id", size.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_preferences, op3_pii, op4_html_text, op5_simhash_dedup, op6_pieces, op7_substring_dedup, op8_sharding, op9_decontamination, op10_media, op11_periodic_runs, op12_prefix_trie, op13_token_counts)}

ORACLE_SQL = {"op2_preferences": preferences.SQL}
