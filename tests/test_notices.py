"""Feeds, severity orderings, clusters, tables and streams on small fixtures."""

import datetime
import json
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from noticelake.functions import gazetteer as G
from noticelake.functions import parsing as P
from noticelake.functions import severity as S
from noticelake.functions import text as X
from noticelake.operators import alerts as L
from noticelake.operators import clusters
from noticelake.operators import filters as Q
from noticelake.operators import models as M
from noticelake.operators import tables as T
from noticelake.operators import vectors as V
from noticelake.operators.components import components
from noticelake.sources import feeds
from noticelake.streaming import streams, timers


def land(tmp_path, payload):
    path = tmp_path / f"feed-{len(list(tmp_path.iterdir()))}.json"
    path.write_text(json.dumps(payload))
    return str(path)


def test_enforcement(spark, tmp_path):
    rows = [
        {"recall_number": "F-1", "classification": "Class II", "reason_for_recall": "The spread holds milk that no label names.", "recalling_firm": "Quarrel Foods Ltd", "state": "FL", "report_date": "20161102"},
        {"recall_number": "H-1", "reason_for_recall": "Milk &amp; soy are not on the label.", "recalling_firm": "Marlow&#039;s Deli", "state": "Ontario"},
    ]
    got = {r["recall_number"]: r for r in feeds.normalize_enforcement(feeds.read_enforcement(spark, land(tmp_path, {"results": rows}))).collect()}
    assert got["F-1"]["states"] == ["FL"] and got["F-1"]["report_date"] == datetime.date(2016, 11, 2) and got["F-1"]["category"] == "allergen"
    assert got["H-1"]["company_name"] == "Marlow's Deli" and got["H-1"]["state"] is None and got["H-1"]["states"] is None
    assert [e["value"] for e in got["H-1"]["entities"]] == ["milk", "soybeans"]


def test_fsis_fsa_cfia(spark, tmp_path):
    fsis = [{"field_recall_number": "007", "field_recall_classification": "Class I", "field_recall_reason": ["Misbranding", "Unreported Allergens"], "field_states": ["California", "New Jersey"], "field_active_notice": "True", "langcode": "English", "field_recall_date": "2026-01-02"}, {"field_recall_number": "8", "langcode": "Spanish"}]
    got = feeds.normalize_fsis(feeds.read_fsis(spark, land(tmp_path, fsis))).collect()
    assert len(got) == 1 and got[0]["states"] == ["CA", "NJ"] and got[0]["state"] is None and got[0]["status"] == "Active"
    fsa = {"items": [{"notation": "FSA-1", "title": "t", "created": "2018-01-01", "type": ["http://x/Alert", "http://x/PRIN"], "problem": [{"riskStatement": "Salmonella found"}], "productDetails": [{"productName": "A"}, {"productName": "B"}]}]}
    row = feeds.normalize_fsa(feeds.read_fsa(spark, land(tmp_path, fsa))).first()
    assert row["classification"] == "Product Recall" and row["product_description"] == "A / B" and row["entities"][0]["value"] == "Salmonella"
    cfia = [{"NID": "98765", "Title": "Harbour Lane brand Soft Cheese recalled due to Listeria", "Product": "Soft Cheese 200g", "Organization": "CFIA", "Recall class": "Class 1", "Issue": "Listeria"}, {"NID": "1", "Organization": "Consumer"}]
    row = feeds.normalize_cfia(feeds.read_cfia(spark, land(tmp_path, cfia))).collect()
    assert len(row) == 1 and row[0]["product_description"] == "Harbour Lane Soft Cheese 200g" and row[0]["classification"] == "Class I"


def test_rasff_and_measures(spark, tmp_path):
    value = [{"NOTIF_ID": 1, "NOTIFICATION_REFERENCE": "2026.1", "NOTIF_DATE": "2026-07-01", "NOTIF_SUBJECT": "Salmonella in eggs", "NOTIFYNG_COUNTRY_DESC": "France", "NOTIFICATION_CLASSIFICAT_DESC": "Alert notification", "DISTRIBUTION_COUNTRY_DESC": "Belgium *** Cayman Islands *** Germany", "NETWORK_DESC": "RASFF"}, {"NOTIF_ID": 2, "NOTIFICATION_REFERENCE": "2026.2", "NOTIFICATION_CLASSIFICAT_DESC": "Border rejection", "NETWORK_DESC": "RASFF"}]
    df = feeds.normalize_rasff(feeds.read_rasff(spark, land(tmp_path, {"value": value})))
    row = df.first()
    assert df.count() == 1 and row["distribution_countries"] == ["BE", "DE"] and row["notifying_country"] == "FR"
    measures = [{"notification_id": 1, "product": {"measures": [{"url": "a.example/x", "actionTaken": {"description": "Destruction"}}], "relatedProducts": [{"measures": [{"url": "b.example/y", "actionTaken": {"description": "Recall from consumer"}}]}]}}]
    best = feeds.best_measure(feeds.read_measures(spark, land(tmp_path, measures)))
    assert best.first()["enriched_url"] == "https://b.example/y"
    done = feeds.apply_enrichment(df.withColumn("id", F.lit(1).cast("long")), best, "id", "webgate").first()
    assert done["source_url"] == "https://b.example/y" and done["status"] == "Recall from consumer"


def score(spark, cls, reason, states=None, pattern=None):
    df = spark.createDataFrame([(cls, reason, states, pattern)], "c string, r string, s array<string>, p string")
    df = df.withColumn("e", G.extract_entities(F.col("r"))).withColumn("g", G.label_category(F.col("r"), F.col("e")))
    return df.select(S.severity_score(F.col("c"), F.col("g"), F.col("e"), F.col("s"), F.col("p"), F.col("r"))).first()[0]


def test_severity_orderings(spark):
    assert score(spark, "Class I", "Undeclared sulphites") >= 75
    peanuts, milk, mild = (score(spark, "Allergy Alert", f"Undeclared {x}") for x in ("peanuts", "milk", "sulphites"))
    assert peanuts > milk > mild
    assert score(spark, "Class II", "Listeria. An outbreak sickened many. No deaths reported.") > score(spark, "Class II", "Listeria. No illnesses have been reported.")
    assert score(spark, "Class I", "Listeria; two people died", None, "Nationwide") >= 89


def test_entities_of_words_that_overlap(spark):
    literal = {
        "sudan i and SUDAN II": ["illegal dye"], "paralytic shellfish": ["crustaceans", "marine biotoxin"], "chlorpyrifos-methyl": ["pesticide"], "milks": [], "_milk": [], "milk-egg": ["milk", "egg"],
        "undeclared veterinary drug": ["undeclared drug"], "undeclared drug residue": ["undeclared drug"], "contains lead contamination": ["lead"], "e.coli, e. coli": ["E. coli"], "benzo(a)pyrene": ["process contaminant"],
        "glass, then milk": ["milk", "glass"], "": [],
    }
    words = [w for _, _, of in G.VOCABULARY for w in of]
    pick = random.Random(3)
    made = ["".join(w[: pick.choice([len(w), len(w), len(w) - 1])] + pick.choice([" ", "-", ", ", "", "s "]) for w in pick.choices(words, k=4)) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in [None, *literal, *made]], "t string")
    got = {r["t"]: [e["value"] for e in r["e"]] for r in df.select("t", G.extract_entities(F.col("t")).alias("e")).collect()}
    assert got.pop(None) == [] and {t: got[t] for t in literal} == literal
    # all patterns, one after the other
    assert got == {t: [v for _, v, p in G.GAZETTEER if re.search(p, t.lower(), re.ASCII)] for t in got}


def test_search(spark):
    df = X.with_terms(spark.createDataFrame([("a", "listeria listeria cheese"), ("b", "undeclared soy"), ("c", "listeria in milk chocolate boxes here")], "id string, search_text string"))
    pick = lambda q: {r["id"] for r in df.where(X.parse_query(q, F.col("terms"))[0]).collect()}
    assert pick("listeria") == {"a", "c"} and pick('"undeclared soy"') == {"b"} and pick("soy or milk") == {"b", "c"} and pick("listeria -milk") == {"a"} and pick('"" - or') == set()
    met, wanted = X.parse_query("listeria", F.col("terms"))
    assert [r["id"] for r in df.where(met).orderBy(X.relevance(F.col("terms"), wanted).desc()).collect()] == ["a", "c"]
    with pytest.raises(ValueError):
        Q.conditions(since=datetime.date(2024, 2, 1), until=datetime.date(2024, 1, 1))


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (102, 101), (5, 5), (200, 201), (200, 201)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert {got[i] for i in range(61)} == {0} and got[102] == got[101] == 100 and got[201] == 200
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_event_clusters(spark):
    day = datetime.date(2024, 1, 1)
    row = lambda i, p, d, e=None: (i, "us", [p] if p else [], [p or "milk"], d, f"c{i % 2}", ["CA"], 80.0, e)
    nodes = spark.createDataFrame([row(0, "Listeria", day), row(1, "Listeria", day), row(2, "Listeria", day + datetime.timedelta(30)), row(3, "Salmonella", day), row(4, None, day, "E"), row(5, None, day + datetime.timedelta(400), "E")], "id long, country string, pathogens array<string>, entities array<string>, report_date date, company_name string, states array<string>, severity_score double, event_id string")
    edges = spark.createDataFrame([(0, 1, 0.9), (1, 2, 0.9), (2, 3, 0.95), (0, 3, 0.5)], "src long, dst long, score double")
    clusters = V.cluster_events(nodes, edges)
    assert {r["id"]: r["cluster"] for r in clusters.collect()} == {0: 0, 1: 0, 2: 0, 4: 4, 5: 4}
    facts = {r["cluster"]: r for r in V.cluster_facts(clusters.join(nodes, "id")).collect()}
    assert facts[0]["is_outbreak"] and facts[0]["base_slug"] == "listeria-2024-01" and not facts[4]["is_outbreak"]


def test_publish(spark, tmp_path):
    T.publish(spark.range(3).toDF("x"), str(tmp_path / "t"))
    T.publish(spark.range(5).toDF("x"), str(tmp_path / "t"))
    assert T.published(spark, str(tmp_path / "t")).count() == 5


def test_lookup_by_composite_key(spark):
    rows = spark.createDataFrame([("fda", "1", 5), ("uk", "1", 6)], "source string, recall_number string, v int")
    asked = spark.createDataFrame([(1, "uk", "1"), (2, "uk", "2"), (3, "uk", "1"), (4, None, "1")], "id int, source string, recall_number string")
    for most in (100, 1):
        assert sorted((r["id"], r["v"]) for r in T.lookup(rows, asked, most=most).collect()) == [(1, 6), (2, None), (3, 6), (4, None)]


def test_audit_tells_of_runs(spark, tmp_path):
    batch = spark.createDataFrame([("fda", "1", 1), ("fda", "1", 2), ("fda", "2", 1)], "source string, recall_number string, ordinal int")
    runs, out = str(tmp_path / "runs"), str(tmp_path / "out")
    assert T.audited(batch, "fda", runs, "ordinal", lambda df: df.write.parquet(out)) == {"fetched": 3, "upserted": 2}
    assert sorted((r["recall_number"], r["ordinal"]) for r in spark.read.parquet(out).collect()) == [("1", 2), ("2", 1)]

    def fail(_):
        raise OSError("x" * 3000)

    with pytest.raises(OSError):
        T.audited(batch, "fda", runs, "ordinal", fail)
    told = {r["status"]: r for r in spark.read.parquet(runs).collect()}
    assert told["ok"]["fetched_count"] == 3 and told["error"]["fetched_count"] is None and told["error"]["error"] == "x" * 2000


def test_bounds_of_terms_follow_the_corpus():
    assert M.corpus_bounds(199) == {"min_df": 2, "max_df": None} and M.corpus_bounds(200)["max_df"] == 0.3 and M.corpus_bounds(500)["min_df"] == 5


def test_stream_upserts_and_restarts(spark, tmp_path):
    """Later batches win, a restart reads nothing twice, and a batch that runs again after it was written adds nothing."""
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    schema = "source string, recall_number string, v int, ordinal int"

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        streams.ingest_into(spark.readStream.schema(schema).parquet(source), out, "ordinal", state).awaitTermination()
        return sorted((r["recall_number"], r["v"]) for r in streams.ingested(spark, out, schema).collect())

    assert streams.ingested(spark, out, schema).count() == 0
    assert run([("fda", "1", 1, 1), ("fda", "2", 2, 1), ("fda", "1", 3, 2)]) == [("1", 3), ("2", 2)]
    assert run([("fda", "1", 99, 1), ("fda", "3", 9, 1)]) == [("1", 99), ("2", 2), ("3", 9)]
    (tmp_path / "state" / "commits" / "1").unlink()  # lost after its rows were written: batch 1 runs again
    for crc in (tmp_path / "state" / "commits").glob(".1.crc"):
        crc.unlink()
    assert run([("fda", "2", 7, 1)]) == [("1", 99), ("2", 7), ("3", 9)]
    assert len(streams.Batches(spark, out).folders()) == 3
    streams.compact(spark, out, schema)
    assert len(streams.Batches(spark, out).folders()) == 1
    assert run([("fda", "3", 5, 1)]) == [("1", 99), ("2", 7), ("3", 5)]
    (tmp_path / "out" / streams.Batches(spark, out).folders()[-1] / "_SUCCESS").unlink()  # a folder left half written does not count
    assert [x for x in streams.ingested(spark, out, schema).collect() if x["recall_number"] == "3"][0]["v"] == 9


def test_stream_matches_like_the_batch(spark, tmp_path):
    schema = "source string, recall_number string, country string, company_name string, category string, severity_label string, entities array<struct<type:string,value:string>>, notifying_country string, distribution_countries array<string>"
    n = spark.createDataFrame([("s", str(i), "us" if i % 2 else "eu", f"Company {i % 3}", "pathogen", "high", [("pathogen", "Listeria")] if i % 5 else [], None, ["DE"]) for i in range(40)], schema)
    s = spark.createDataFrame([(1, ["listeria"], None, ["us"], None, None, None), (2, None, ["y 1"], None, ["de"], None, None), (3, None, [""], ["eu"], None, ["pathogen"], "severe"), (4, None, [""], ["eu"], None, None, "low"), (5, None, None, None, None, None, "unknown")], "id int, entities array<string>, companies array<string>, countries array<string>, affected_countries array<string>, categories array<string>, min_severity string")
    for part in (0, 1):
        n.where(f"cast(recall_number as int) % 2 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streams.match_into(arriving, s, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = streams.Batches(spark, str(tmp_path / "out")).rows("sub_id int, source string, recall_number string")
    rows = lambda df: sorted((r["sub_id"], r["recall_number"]) for r in df.collect())
    assert rows(got) == rows(L.match(n, s)) and {x for x, _ in rows(got)} == {1, 2, 4}


def arrivals(spark, path, waves, schema):
    """Waves of rows as files, each a micro-batch of its own."""
    for rows in waves:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def told(spark, stream, name):
    with timers.timer_store(spark):
        return streams.run_to_table(stream, name).collect()


def test_timers_tell_of_quiet_keys(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    beats = {"a": [0, 10, 300, 305, 900], "b": [5, 5, 50], None: [7, 400]}
    rows = [(k, at(s)) for k, seconds in beats.items() for s in seconds]
    # in three waves, later times first: each is late for the wave before, within the delay
    waves = [rows[2::3], rows[::3], [*rows[1::3], ("c", None)], [("end", at(10_000))]]
    stream = arrivals(spark, str(tmp_path / "in"), waves, "key string, ts timestamp")
    batch = L.heartbeat_gaps(spark.createDataFrame(rows, "key string, ts timestamp"), "key", "ts", 100).collect()
    gaps = told(spark, timers.heartbeat_gaps(stream, "key", "ts", 100, "1000 seconds"), "gaps")
    key = lambda r: (str(r["key"]), r["quiet_from"], r["quiet_to"])
    assert sorted(map(key, gaps)) == sorted(map(key, batch)) and len(gaps) == 3
    idle = told(spark, timers.expirations(stream, "key", "ts", 100, "1000 seconds"), "idle")
    want = [(k, at(s)) for k, v in beats.items() for s, n in zip(v, [*v[1:], 10**6], strict=True) if n - s > 100]
    assert sorted((str(r["key"]), r["quiet_from"]) for r in idle) == sorted((str(k), t) for k, t in want)


def test_timers_go_on_after_a_restart(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))

    def run(wave):
        stream = timers.expirations(arrivals(spark, source, [wave], "key string, ts timestamp"), "key", "ts", 100, "50 seconds")
        with timers.timer_store(spark):
            stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        return sorted((r["key"], int((r["quiet_from"] - at(0)).total_seconds())) for r in spark.read.schema(stream.schema).parquet(out).collect())

    assert run([("a", at(0)), ("b", at(80))]) == []
    assert run([("a", at(60)), ("b", at(120))]) == []  # a's row is late, and counts
    assert run([("b", at(215))]) == [("a", 60)]
    assert run([("a", at(230)), ("c", at(1000))]) == [("a", 60), ("a", 230), ("b", 215)]


def test_timers_tell_of_missed_deadlines(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    starts = [(1, at(0), 10.0), (2, at(0), 10.0), (3, at(5), 10.0), (4, at(5), 10.0)]
    ends = [(1, at(10), None), (2, at(11), None), (3, at(6), None), (9, at(3), None)]
    for n, waves in enumerate(([starts, ends], [ends, starts], [starts[::2], ends, starts[1::2]])):
        stream = arrivals(spark, str(tmp_path / f"in{n}"), [*waves, [(100, at(5000), None)]], "id long, ts timestamp, limit_s double")
        got = told(spark, timers.missed_deadlines(stream, "id", "ts", "limit_s", "1000 seconds"), "deadlines")
        assert sorted((r["id"], r["deadline"]) for r in got) == [(2, at(10)), (4, at(15))]


def test_flood_guard_is_strict(spark):
    df = spark.range(101).select(F.when(F.col("id") < 51, "us").otherwise("uk").alias("country"))
    assert {r["country"] for r in L.flood_guard(df).collect()} == {"uk"}


def test_harm_is_told_and_not_denied(spark):
    texts = {
        "Several people became ill after eating it.": True, "It may cause serious illness in infants.": False, "There are no reports of illness.": False,
        "Several illnesses have been reported and two people were hospitalized.": True, "Listeria can cause serious illness; symptoms include fever.": False, "No illnesses have been reported to date.": False,
        "An outbreak has sickened many people. No deaths have been reported.": True, "No outbreak of illness has been reported.": False, "It was linked to two or three infections": True,
        "linked to one two three four five infections": False, "People have been reported": True, "nobody reported illness": True, "no.illness reported": False, "He was made seriously ill": True, "No, it killed nobody; hospitalised": True,
        "Dead\nNo known death": False, "Reports  of\treactions": True, "DEATHS": True, "deathsome": False, "Case of sickness": False,
        "An outbreak is under way. No deaths are known.": True, "Two cases of infection were confirmed.": True, "None of the infections was confirmed.": False, None: False,
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r["t"]: r["h"] for r in df.withColumn("h", S.reported_harm(F.col("t"))).collect()} == texts
    wide = spark.createDataFrame([("Sold nationwide",), ("National chain",), ("nation-wide",), ("nation wide",), ("nation  wide",), ("international",), (None,)], "t string")
    assert [r["n"] for r in wide.withColumn("n", S.nationwide(F.col("t"))).collect()] == [True, True, True, True, False, False, False]


def test_ties_of_severity_go_to_the_even_digit(spark):
    entities = "array<struct<type:string,value:string>>"
    df = spark.createDataFrame([("pathogen", [], "Product Recall"), ("allergen", [("allergen", "sesame")], None), ("allergen", [("allergen", "sulphites")], None)], f"c string, e {entities}, k string")
    scores = [r["s"] for r in df.withColumn("s", S.severity_score(F.col("k"), F.col("c"), F.col("e"))).collect()]
    assert scores == [round(45 + 55 * (10 / 35), 1), round(46 + 54 * (20 / 45), 1), 40.0]
    df = spark.createDataFrame([("other", [], "Deaths."), ("mislabeling", [], "1")], "c string, e array<struct<type:string,value:string>>, r string")
    assert round(62 + 38 * (15 / 40), 1) == 76.2 and spark.range(1).select(F.bround(F.lit(76.25), 1)).first()[0] == 76.2


def test_company_is_the_first_that_a_text_names(spark):
    texts = {
        "The manufacturer, Acme Ltd, was notified by Bolt Inc, then.": "Bolt Inc", "Reported by Else Co. It was notified by Bolt.": "Else Co", "informed  by the  supplier, Fresh Farms; and": "Fresh Farms",
        "communicated by X.Y and manufacturer Zed and Sons": "Zed and Sons", "nothing here": None, "notified by " + "N" * 90: "N" * 71, None: None, "a manufacturer of food": "of food",
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r["t"]: r["c"] for r in df.withColumn("c", P.company_from_body(F.col("t"))).collect()} == texts


def test_hints_are_beginnings_of_words_anywhere(spark):
    titles = {"Listeriosis outbreak": True, "SALMONELLOSIS": True, "Withdrawn tins": True, "unsafely": True, "Food safety week": True, "botulism": True, "aflatoxins": True, "decontaminated": True, "Annual report": False, "food  safety": False, None: False}
    df = spark.createDataFrame([(t,) for t in titles], "t string")
    assert {r["t"]: r["h"] for r in df.withColumn("h", P.recall_hint(F.col("t"))).collect()} == titles


def test_names_of_scores_are_bounded(spark):
    names = [("x" * 30, []), ("x" * 31, ["name"]), (" " + "x" * 30, ["name"]), ("   ", []), (None, [])]
    df = spark.createDataFrame([(n, "fighter", " 1 ") for n, _ in names] + [("a", "tug", "  "), ("b", None, "v" * 21)], "name string, ship_kind string, version string")
    got = [(r["name"], r["version"], r["violations"]) for r in T.validate_scores(df).collect()]
    assert [x[2] for x in got] == [v for _, v in names] + [["ship_kind", "version"]] * 2
    assert [x[0] for x in got[:5]] == ["x" * 30, "x" * 31, "x" * 30, "Anonymous", "Anonymous"] and got[0][1] == "1"


def test_food_posts(spark):
    rows = [("Dog food recall", "beef", False), ("Polony", "", True), ("Kettles", "for rice", True), ("A kettle", "for rice", False), ("Eggs", "", False), (None, "Use by", True), (None, None, False)]
    df = spark.createDataFrame(rows, "t string, b string, want boolean")
    assert [r["f"] for r in df.withColumn("f", P.is_food(F.col("t"), F.col("b"))).collect()] == [x[2] for x in rows]


def test_stems():
    known = {"caresses": "caress", "ponies": "poni", "agreed": "agre", "motoring": "motor", "hopping": "hop", "filing": "file", "happy": "happi", "relational": "relat", "electrical": "electr", "revival": "reviv", "adjustment": "adjust", "adoption": "adopt", "rate": "rate", "controlling": "control", "generalizations": "gener"}
    assert {w: X.stem(w) for w in known} == known


def test_canonical_posts(spark):
    posts = [(1, "media-statement-recall-of-the-honey-jar"), (2, "product-recall-honey-jar"), (3, "consumers-are-urged-to-return-certain-rusks"), (4, "product-safety-recall-rusks"), (5, "the-jam"), (6, "product-recall-product-recall-the-ncc-urges-consumers-to-return-tea")]
    got = feeds.canonical_dedupe(spark.createDataFrame(posts, "id int, slug string"))
    assert sorted(r["id"] for r in got.collect()) == [2, 4, 5, 6]
    slugs = [r["s"] for r in spark.createDataFrame(posts, "id int, slug string").orderBy("id").select(P.canonical_slug(F.col("slug")).alias("s")).collect()]
    assert slugs == ["honey-jar", "honey-jar", "rusks", "rusks", "the-jam", "tea"]


def test_titles_and_companies(spark):
    titles = {"Media Statement: Product Safety Recall - Plum Jam": "Plum Jam", "Recall of the Oat Bar": "Oat Bar", "Plum Jam – Product Recall": "Plum Jam", "Product recall procedure": "Product recall procedure", "Product recall:": "Product recall:"}
    df = spark.createDataFrame([(t,) for t in titles], "t string")
    assert {r["t"]: r["p"] for r in df.withColumn("p", P.product_from_title(F.col("t"))).collect()} == titles


def test_tfidf_equals_brute_force(spark):
    import math

    texts = ["red milk red jar", "milk jar lid", "the red lid", "", "über milk"]
    got = {(r["id"], r["term"]): r["weight"] for r in M.tfidf(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text").collect()}
    counts = []
    for t in texts:
        w = [x for x in t.split() if x.isascii() and x not in X.ENGLISH]
        bag = {}
        for x in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))]:
            bag[x] = bag.get(x, 0) + 1
        counts.append(bag)
    df = {x: sum(x in b for b in counts) for b in counts for x in b}
    want = {}
    for i, b in enumerate(counts):
        raw = {x: n * (math.log((1 + len(texts)) / (1 + df[x])) + 1) for x, n in b.items() if df[x] >= 2}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        want |= {(i, x): v / norm for x, v in raw.items()}
    assert {k: round(v, 9) for k, v in got.items()} == {k: round(v, 9) for k, v in want.items()}


def test_neighbours_in_blocks_and_by_projection(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").selectExpr("vec_id AS id", "vec_id % 3 AS part", "embedding")
    pairs = lambda df: {(r["src"], r["dst"], r["rank"]) for r in df.collect()}
    exact = pairs(V.knn(rows, "id", "embedding", "part"))
    assert pairs(V.knn(rows, "id", "embedding", "part", block_rows=40)) == exact
    near = {(a, b) for a, b, _ in pairs(V.knn_lsh(rows, "id", "embedding", "part"))}
    assert len({(a, b) for a, b, _ in exact} & near) / len(exact) >= 0.9


def test_pruned_neighbours_are_exact(spark):
    import numpy as np

    draw = np.random.default_rng(5)
    centres = draw.normal(size=(12, 8))
    points = np.concatenate([c + 0.05 * draw.normal(size=(60, 8)) for c in centres])
    points[3] = 0.0  # no direction, no neighbour
    points[700:710] = points[10]  # ties
    rows = spark.createDataFrame([(i, "one" if i % 9 else "few", [float(x) for x in p]) for i, p in enumerate(points)] + [(10_000, "one", None)], "id long, part string, embedding array<double>")
    size = np.linalg.norm(points, axis=1, keepdims=True)
    unit = np.divide(points, size, out=np.zeros_like(points), where=size > 0)
    cosines = unit @ unit.T
    want = set()
    for i in range(len(points)):
        mates = sorted((-round(cosines[i, j], 12), j) for j in range(len(points)) if j != i and (j % 9 == 0) == (i % 9 == 0) and cosines[i, j] > 1e-12)
        want |= {(i, j, n) for n, (_, j) in enumerate(mates[:6], 1)}
    for most in (4096, 3, 1):
        got = V.knn(rows, "id", "embedding", "part", block_rows=50, max_pivots=most).collect()
        assert {(r["src"], r["dst"], r["rank"]) for r in got} == want
    # of the pairs of rows and blocks most are never formed
    clean = rows.where("id <> 3 and id < 10000").select("id", "part", F.col("embedding").alias("v"))
    placed, cells, pivots = V._cells(clean, 50, 4096)
    first = spark.createDataFrame([(i, j, float(cosines[i, j])) for i, j, _ in want], "src long, dst long, score double")
    asked = V._reached(placed, first, cells, pivots, 6).count()
    every = clean.groupBy("part").count().join(cells.groupBy("part").agg(F.sum("blocks").alias("b")), "part").agg(F.sum(F.col("count") * (F.col("b") - 1))).first()[0]
    assert asked < every / 2, (asked, every)


def test_themes_of_all_parts_at_once(spark):
    import numpy as np
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    draw = np.random.default_rng(2)
    parts = {"us": 260, "uk": 220, "za": 30}
    rows, at = [], 0
    for p, n in parts.items():
        c = draw.normal(size=(6, 5))
        x = c[draw.integers(6, size=n)] + 0.2 * draw.normal(size=(n, 5))
        rows += [(at + i, p, [float(y) for y in v / np.linalg.norm(v)]) for i, v in enumerate(x)]
        at += n
    df = spark.createDataFrame([*rows, (9999, "us", [0.0] * 5)], "id long, part string, v array<double>")
    sizes = {"us": 260, "uk": 220}
    unit = df.where("id < 9999").select("id", "part", V.normalized(F.col("v")).alias("v"))
    fitted = clusters.fit(unit, "part", "v", sizes, 6, (1, 2, 3))
    for p in sizes:
        mine = np.array([v for _, q, v in rows if q == p])
        away = ((mine[:, None] - fitted[p][0][None]) ** 2).sum(2)
        assert abs(away.min(1).sum() - fitted[p][1]) < 1e-6
        x = df.where(F.col("part") == p).where("id < 9999").withColumn("x", array_to_vector("v"))
        assert fitted[p][1] <= 1.02 * min(KMeans(k=6, seed=s, featuresCol="x").fit(x).summary.trainingCost for s in (1, 2, 3))
    placed = {r["id"]: r for r in M.part_themes(df, "id", "v", "part", 6, 200, -1.0, (1, 2, 3)).collect()}
    assert set(placed) == {i for i, p, _ in rows if p != "za"}
    for i, p, v in rows:
        if p != "za":
            c = fitted[p][0]
            near = int(((c - np.array(v)) ** 2).sum(1).argmin())
            assert placed[i]["theme"] == near and abs(placed[i]["similarity"] - np.dot(c[near], v) / np.linalg.norm(c[near])) < 1e-9
    assert M.themes(df.where("part = 'za'"), "id", "v") is None


def test_weights_by_part_are_those_of_each_alone(spark):
    texts = [(i, "ab"[i % 2], f"red {'milk' if i % 3 else 'jar'} lid{i % 5}") for i in range(40)]
    df = spark.createDataFrame(texts, "id long, part string, text string")
    weights = lambda f, **k: {(r["id"], r["term"]): round(r["weight"], 9) for r in M.tfidf(f, "id", "text", max_features=7, **k).collect()}
    alone = {}
    for p in "ab":
        alone |= weights(df.where(F.col("part") == p))
    assert weights(df, part="part", **M.part_bounds()) == alone


def test_match_equals_brute_force(spark):
    notice = lambda i, c, co, ents: ("s", str(i), c, co, "pathogen", "high", [("pathogen", e) for e in ents], None, None)
    notices = [notice(0, "us", "Acme Foods", ["Listeria"]), notice(1, "us", None, ["milk", "Listeria"]), notice(2, "eu", "Bolt", []), notice(3, "uk", "ACME", ["glass"]), notice(4, "us", "", [])]
    subs = [(1, ["listeria", "MILK"], None, ["us"]), (2, None, ["acme"], None), (3, None, ["o"], ["us", "us"]), (4, None, None, ["eu"]), (5, None, None, None), (6, [], ["zzz"], ["us"]), (7, ["glass"], ["cme"], ["uk", "us"])]
    n = spark.createDataFrame(notices, "source string, recall_number string, country string, company_name string, category string, severity_label string, entities array<struct<type:string,value:string>>, notifying_country string, distribution_countries array<string>")
    s = spark.createDataFrame([(*x, None, None, None) for x in subs], "id int, entities array<string>, companies array<string>, countries array<string>, affected_countries array<string>, categories array<string>, min_severity string")
    want = []
    for i, ents, comps, countries in subs:
        for _, number, c, co, _, _, e, _, _ in notices:
            ok = (not ents or {x.lower() for x in ents} & {v.lower() for _, v in e}) and (not comps or not co or any(x.lower() in co.lower() for x in comps)) and (not countries or c in countries)
            want += [(i, number)] if ok else []
    assert sorted((r["sub_id"], r["recall_number"]) for r in L.match(n, s).collect()) == sorted(want)
    counts = {r["sub_id"]: r["match_count"] for r in L.match_counts(n, s).collect()}
    assert counts == dict(Counter(i for i, _ in want))
    folded = s.withColumn("countries", F.transform("countries", F.upper))
    assert sorted((r["sub_id"], r["recall_number"]) for r in L.match(n, folded, fold_case=True).collect()) == sorted(want)


def test_one_scan_of_the_notices(spark):
    from noticelake.plans import notices
    from noticelake.operators import aggregates as A
    from noticelake.operators import timeseries as TS

    view = notices.view(spark, "/root/testdata/sf0.001")
    final = lambda df: df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    count = lambda df: final(df).count("orders.parquet")
    assert count(TS.anomalies(TS.scan_series(view))) == 0  # the stored series stands for the one scan before
    for df in (Q.facets(view, category="pathogen"), A.stats(view)):
        df.collect()
        assert count(df) == 1 or "ReusedExchange" in final(df)


def test_shared_folder_is_needed_on_a_cluster():
    from noticelake.storage import shared_dir

    class Context:
        master = "spark://host:7077"

    class Session:
        conf = {}
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        shared_dir(Session())
