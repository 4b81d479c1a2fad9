"""The notice view: the star schema's orders read as safety notices, in Spark and in DuckDB SQL.

Every order is one notice. The view exists so that the library's operators run over the given tables,
with all columns derived from them by fixed rules; ``SQL`` states the same rules for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticelake.functions import gazetteer as G
from noticelake.functions import severity as S
from noticelake.operators.models import rederive

#: Reasons of notices, one for every remainder of the order key.
REASONS = (
    "Product contains undeclared milk.", "May contain Listeria monocytogenes. No illnesses have been reported to date.",
    "Possible contamination with Salmonella. Several confirmed illnesses are linked to the product.", "Pieces of metal were found in the product.",
    "The label lists the wrong product.", "Undeclared peanuts and tree nuts.", "Elevated histamine in tuna.", "Glass fragments; no injuries or adverse reactions known.",
    "E. coli O157 found by the laboratory. An outbreak sickened many. No deaths reported.", "Quality does not meet the standard.",
    "Undeclared sulphites in dried fruit.", "Aflatoxins above the limit in pistachios.", "Undeclared soy and wheat.", "Plastic pieces in bread.",
    "Use-by date missing on the label.", "Clostridium botulinum may grow; two people were hospitalized.", "Undeclared sesame (tahini).",
    "Unauthorised colour Sudan I in chili.", "Pesticide chlorpyrifos in apples.", "Norovirus in oysters.", "Contains lead above the limit.",
    "Hepatitis A in frozen berries; cases of infection are confirmed.", "Undeclared egg.", "Rubber from a seal.", "Misbranded without inspection.",
    "Undeclared crustaceans and fish.", "Cronobacter in infant formula.", "3-MCPD in refined oil.", "Insects found in rice.", "Undeclared drug sildenafil in a supplement.",
    "Migration of primary aromatic amines from spoons.", "Vibrio in shellfish.", "Mustard not declared on the label.", "Cereulide may be present.",
    "Ethylene oxide in sesame seeds.", "Best before date is wrong.", "Wooden splinters in dates.", "Celery and lupin are not declared.", "Benzo(a)pyrene in smoked fish.", "Stones in lentils.",
)
PRODUCTS = ("Soft cheese 200 g", "Frozen berries", "Milk chocolate bar", "Chili powder 50%", "Infant formula", "Smoked salmon", "Wheat bread UPC 882479852232", "Dried apricots", "Rice_flour mix", "Tuna in oil")
STATES = ("CA", "NY", "TX", "FL", "WA", "OR", "NJ", "MA")
CODES = ("DE", "FR", "BE", "NL", "ES")
#: Today, for operators that need one: after the newest notice.
NOW = "2002-01-01 00:00:00"

_LIST = {"spark": ("array(", ")", "element_at"), "duckdb": ("[", "]", "list_extract")}


def _base(dialect: str) -> str:
    left, right, pick = _LIST[dialect]
    quoted = lambda names: left + ", ".join(f"'{n}'" for n in names) + right
    state = lambda n: f"{pick}({quoted(STATES)}, CAST((o_orderkey + {n}) % 8 AS INT) + 1)"
    code = lambda n: f"{pick}({quoted(CODES)}, CAST((o_orderkey + {n}) % 5 AS INT) + 1)"
    return f"""
    SELECT o_orderkey AS id, CAST(o_orderkey AS STRING) AS recall_number,
      CASE n_regionkey WHEN 0 THEN 'za' WHEN 1 THEN 'us' WHEN 2 THEN 'ca' WHEN 3 THEN 'eu' ELSE 'uk' END AS country,
      CASE n_regionkey WHEN 0 THEN {pick}({quoted(("ncc", "woolworths", "shoprite", "nrcs"))}, CAST(o_orderkey % 4 AS INT) + 1)
        WHEN 1 THEN {pick}({quoted(("fda", "usda"))}, CAST(o_orderkey % 2 AS INT) + 1) WHEN 2 THEN 'cfia' WHEN 3 THEN 'rasff' ELSE 'uk' END AS source,
      CASE WHEN o_orderkey % 11 <> 0 THEN c_name END AS company_name,
      CASE WHEN o_orderkey % 53 <> 0 THEN CAST(o_orderdate AS DATE) END AS report_date,
      CASE WHEN o_orderkey % 59 <> 0 THEN CAST(o_orderdate AS DATE) END AS recall_initiation_date,
      o_orderdate AS created_at,
      CASE o_orderpriority WHEN '1-URGENT' THEN 'Class I' WHEN '2-HIGH' THEN 'Class II' WHEN '3-MEDIUM' THEN 'Class III'
        WHEN '4-NOT SPECIFIED' THEN 'Product Recall' END AS classification,
      {pick}({quoted(REASONS)}, CAST(o_orderkey % {len(REASONS)} AS INT) + 1) AS reason_text,
      {pick}({quoted(PRODUCTS)}, CAST(o_orderkey % {len(PRODUCTS)} AS INT) + 1) AS product_description,
      CASE WHEN n_regionkey = 1 AND o_orderkey % 13 = 0 THEN 'Distributed nationwide' END AS distribution_pattern,
      CASE WHEN n_regionkey = 1 THEN CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN {left}{state(0)}{right}
        WHEN 2 THEN {left}{state(0)}, {state(1)}{right} ELSE {left}{", ".join(state(n) for n in range(7))}{right} END END AS states,
      CASE WHEN n_regionkey = 3 AND o_orderkey % 9 <> 0 THEN {code(0)} END AS notifying_country,
      CASE WHEN n_regionkey = 3 AND o_orderkey % 4 <> 0 THEN {left}{code(1)}, {code(3)}{right} END AS distribution_countries,
      CASE WHEN o_orderkey % 7 = 0 THEN CAST(o_custkey AS STRING) || '-' || CAST(year(o_orderdate) AS STRING) END AS event_id,
      CASE WHEN o_orderkey % 6 <> 0 THEN round((o_orderkey * 37 % 1000) / 1000.0D, 3) END AS novelty_score,
      CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey % 12 AS INT) END AS topic_id,
      CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_custkey % 20 AS INT) END AS event_cluster_id
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    """.replace("1000.0D", "1000.0D" if dialect == "spark" else "1000.0::DOUBLE")


def derive(df: DataFrame) -> DataFrame:
    """Adds entities, category, severity and the search text to rows with the source fields."""
    return rederive(df).withColumn("search_text", F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("product_description", "reason_text", "company_name")])))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of stored orders that a task derives notices from: a file holds some 18 an order.
TASK_BYTES = 1 << 20


def _tasks(spark: SparkSession, sf_dir: str) -> int:
    """So many tasks that each has about the same work, however many orders there are and in whatever files and row groups they lie."""
    size = 0
    for file in table(spark, sf_dir, "orders").inputFiles():
        at = spark._jvm.org.apache.hadoop.fs.Path(file)
        size += at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).getLen()
    return max(spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES))


def source_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view's source fields. The joined orders are dealt while they are narrow, by their key, before anything is derived from them."""
    orders, customers, nations = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    joined = joined.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "c_name", "n_regionkey").repartition(_tasks(spark, sf_dir), "o_orderkey")
    fields, _ = _base("spark").split("FROM orders")
    return spark.sql(fields + "FROM {joined}", joined=joined)


def view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The notices."""
    return derive(source_rows(spark, sf_dir))


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def entities_sql(text: str) -> str:
    named = ", ".join(f"CASE WHEN regexp_matches(lower({text}), {_sql_text(p)}) THEN {{'type': {_sql_text(k)}, 'value': {_sql_text(v)}}} END" for k, v, p in G.GAZETTEER)
    return f"list_filter([{named}], lambda e: e IS NOT NULL)"


def category_sql(text: str, entities: str = "entities") -> str:
    kinds = " ".join(f"WHEN list_contains(list_transform({entities}, lambda e: e.type), '{k}') THEN '{c}'" for k, c in G.DECIDES.items())
    rules = " ".join("WHEN " + " OR ".join(f"contains(lower({text}), {_sql_text(w)})" for w in words) + f" THEN '{c}'" for c, words in G.KEYWORDS.items())
    return f"CASE {kinds} {rules} ELSE 'other' END"


def _case(column: str, table: dict[str, float], default: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in table.items()) + f" ELSE {default} END"


def _names(names: tuple[str, ...]) -> str:
    return "[" + ", ".join(map(_sql_text, names)) + "]"


def severity_sql(classification: str = "classification", category: str = "category", states: str = "states", pattern: str = "distribution_pattern", reason: str = "reason_text", lift: str = "0.0") -> str:
    values, allergens = "list_transform(entities, lambda e: e.value)", "list_transform(list_filter(entities, lambda e: e.type = 'allergen'), lambda e: e.value)"
    # the rule in full, stated apart from the code's own
    told = r"(?i)\b(?:deaths?|died|fatality|fatalities|outbreaks?|sickened|hospitali[sz](?:ed|ations?)|(?:became|fallen|fell|made|taken)\s+(?:seriously\s+)?ill|(?:illnesses|reactions|infections|people|consumers)\s+ha(?:ve|s)\s+been\s+reported|(?:several|multiple|received|confirmed|reported|reports?\s+of|cases?\s+of|number\s+of|linked\s+to|associated\s+with)\s+(?:\w+\s+){0,4}(?:illness(?:es)?|sick|reactions?|infections?))\b"
    denied = r"(?i)\bno\b\s+(?:\w+\s+){0,4}(?:illness|report|reaction|infection|hospitali[sz]|death|adverse|known|confirmed)"
    harm = f"len(list_filter(string_split_regex({reason}, '[.!?]+\\s+|\\n+'), lambda s: regexp_matches(s, '{told}') AND NOT regexp_matches(s, '{denied}'))) > 0"
    nationwide = f"regexp_matches({pattern}, '(?i)\\bnation(al|wide|[\\s-]wide)\\b')"
    extra = f"""({_case(category, S.CATEGORY_NUDGE, "0.0")}
      + CASE WHEN list_has_any({values}, {_names(S.LETHAL)}) THEN {S.LETHAL_POINTS} WHEN list_has_any({values}, {_names(S.DEADLY)}) THEN {S.DEADLY_POINTS} ELSE 0 END
      + CASE WHEN list_has_any({allergens}, {_names(S.GRAVE_ALLERGENS)}) THEN {S.GRAVE_POINTS}
          WHEN len({allergens}) > 0 AND list_has_all({_names(S.MILD_ALLERGENS)}, {allergens}) THEN {S.MILD_POINTS} ELSE 0 END
      + CASE WHEN {harm} THEN {S.HARM_POINTS} ELSE 0 END
      + CASE WHEN {nationwide} THEN {S.NATIONWIDE_POINTS} WHEN len({states}) >= {S.WIDE_STATES} THEN {S.WIDE_POINTS}
          WHEN len({states}) >= 2 THEN {S.MULTI_POINTS} ELSE 0 END + {lift})"""
    anchor = _case(classification, S.CLASS_BASE, "NULL")
    base = f"coalesce({anchor}, {_case(category, S.CATEGORY_BASE, '25.0')})"
    raw = f"CASE WHEN {extra} >= 0 THEN {base} + (100.0 - {base}) * ({extra} / ({extra} + {S.LIFT})) ELSE {base} + {extra} END"
    floor = f"CASE WHEN {anchor} >= {S.BANDS['severe']} THEN greatest({raw}, {S.BANDS['severe']}) ELSE {raw} END"
    return f"round_even(greatest(0.0, least(100.0, {floor}))::DOUBLE, 1)"


def label_sql(score: str = "severity_score") -> str:
    return "CASE " + " ".join(f"WHEN {score} >= {floor} THEN '{band}'" for band, floor in S.BANDS.items()) + " ELSE 'low' END"


#: Common table expressions for DuckDB; the last, ``notices``, is the view.
SQL = f"""WITH src AS ({_base("duckdb")}),
ent AS MATERIALIZED (SELECT *, {entities_sql("reason_text")} AS entities FROM src),
cat AS MATERIALIZED (SELECT *, {category_sql("reason_text")} AS category FROM ent),
sev AS MATERIALIZED (SELECT *, {severity_sql()} AS severity_score FROM cat),
notices AS (SELECT *, {label_sql()} AS severity_label,
  lower(coalesce(product_description, '') || ' ' || coalesce(reason_text, '') || ' ' || coalesce(company_name, '')) AS search_text FROM sev)
"""
