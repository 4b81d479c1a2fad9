"""Faults that a review found, each on a small case that failed before."""

import datetime
import random
from collections import Counter

from pyspark.sql import Observation
from pyspark.sql import functions as F

from noticelake.operators import alerts as L
from noticelake.operators import models as M
from noticelake.operators import vectors as V


def test_trained_models_go_to_tasks_of_a_session_that_observed(spark):
    seen = Observation()
    spark.range(3).observe(seen, F.count("*").alias("n")).collect()
    assert seen.get["n"] == 3
    rows = spark.range(40).select("id", F.array((F.col("id") % 2).cast("double"), F.lit(1.0)).alias("v"), (F.col("id") % 2).cast("double").alias("y"), F.when(F.col("id") % 2 > 0, "ripe pear").otherwise("raw leek").alias("text"))
    # a shuffle sends the model with the tasks that come before it
    told = M.apply_vectors(rows, "v", M.train_vectors(rows, "v", "y")).groupBy("y", "prediction").count().collect()
    assert {(r["y"], r["prediction"]) for r in told} == {(0.0, 0.0), (1.0, 1.0)}
    told = M.train_text(rows, "text", "y").transform(rows).groupBy("y", "prediction").count().collect()
    assert {(r["y"], r["prediction"]) for r in told} == {(0.0, 0.0), (1.0, 1.0)}


NOTICE = "source string, recall_number string, country string, company_name string, category string, severity_label string, entities array<struct<type:string,value:string>>, notifying_country string, distribution_countries array<string>, report_date date, reason_text string"


def test_matches_are_counted_by_class(spark):
    day = datetime.date(2020, 1, 1)
    names = [None, "Alpha Beta Foods", "alpha farms", "Beta Dairy", "beta", "Gamma"]
    notices = spark.createDataFrame([("fda", str(i), "us" if i % 3 else "ca", names[i % 6], "allergen", "high" if i % 5 else "low", [("allergen", "Milk" if i % 2 else "Soy")], None, None, day + datetime.timedelta(i % 7), "text " * 50) for i in range(60)], NOTICE)
    asks = [([], ["BETA", "alpha"]), (["milk"], ["beta", "Alpha"]), (["soy"], []), ([], ["beta", "gamma", "alpha beta foods"]), ([], ["none such"]), ([], ["", "x"])]
    subs = spark.createDataFrame([(i, e, c, ["us"] if i % 2 else [], None, None, "bogus" if i == 11 else None) for i, (e, c) in enumerate(asks * 2)], "id int, entities array<string>, companies array<string>, countries array<string>, affected_countries array<string>, categories array<string>, min_severity string")
    pairs = [(r["sub_id"], r["recall_number"]) for r in L.match(notices, subs).collect()]
    assert len(set(pairs)) == len(pairs) > 0
    told = L.match_classes(notices, subs).collect()
    assert len(told) == 72
    of_subs, of_notices = Counter(i for i, _ in pairs), Counter(n for _, n in pairs)
    assert all(r["links"] == (of_subs[r["sub_id"]] if r["sub_id"] is not None else of_notices[r["recall_number"]]) for r in told)
    met = {}  # members of a class have the same matches
    for r in told:
        mine = {n for i, n in pairs if i == r["sub_id"]} if r["sub_id"] is not None else {i for i, n in pairs if n == r["recall_number"]}
        assert met.setdefault(r["class"], mine) == mine
    assert len(met) < 40
    want = {r["sub_id"]: (r["match_count"], r["items"]) for r in L.digest(L.match(notices, subs), notices, most=5).collect()}
    assert {r["sub_id"]: (r["match_count"], r["items"]) for r in L.digests(notices, subs, most=5).collect()} == want


def test_whole_names_meet_few_names(spark):
    names = spark.range(300).select(F.format_string("Customer#%09d", "id").alias("company_name"))
    asked = names.select(F.array("company_name", F.lit("0012")).alias("sub_companies"))
    found = L.companies_named(names, asked)
    # the stretch that is looked up is long enough to tell names apart: three letters of digits were in 3 to 300 of them
    size = L.STRETCHES[-3]
    assert size == 12 and names.select(F.lower(F.substring("company_name", 7, size)).alias("gram")).distinct().count() == 300
    assert found.where("criterion <> '0012'").count() == 300 and found.where("criterion = '0012'").count() == 11


def test_neighbours_of_copies(spark):
    draw = random.Random(5)
    unlike = [[draw.gauss(0, 1) for _ in range(5)] for _ in range(12)] + [[0.0] * 5]
    rows = [(i, i % 2, unlike[draw.randrange(13)] if i % 4 else [draw.gauss(0, 1) for _ in range(5)]) for i in range(160)]
    unit = {i: [x / max(1e-300, sum(y * y for y in v) ** 0.5) for x in v] for i, _, v in rows}
    want = []
    for i, p, v in rows:
        score = {j: round(sum(a * b for a, b in zip(unit[i], unit[j], strict=True)), 12) for j, q, _ in rows if q == p and j != i}
        best = sorted((-s, j) for j, s in score.items() if s > 1e-12)[:6]
        want += [(i, at + 1, j, round(-s, 6)) for at, (s, j) in enumerate(best)]
    df = spark.createDataFrame(rows, "id long, part int, v array<double>")
    for block in (16_384, 7):
        assert sorted((r["src"], r["rank"], r["dst"], round(r["score"], 6)) for r in V.knn(df, "id", "v", "part", block_rows=block).collect()) == want


def test_same_tokens_are_embedded_once(spark):
    vectors = spark.createDataFrame([("milk", [1.0, 0.0]), ("soy", [0.0, 1.0])], "token string, vector array<float>")
    texts = spark.createDataFrame([(1, "Milk, soy 1"), (2, "soy milk"), (3, "milk milk"), (4, "unknown"), (5, None), (6, "")], "id int, text string")
    got = {r["id"]: [round(x, 6) for x in r["vector"]] for r in V.embed(texts, "id", "text", vectors).collect()}
    assert got == {1: [0.707107, 0.707107], 2: [0.707107, 0.707107], 3: [1.0, 0.0]}
    plan = V.embed(texts, "id", "text", vectors)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan  # no row per place of a vector
    kept = V.with_embedding(texts, "text", vectors)
    assert kept.columns == ["id", "text", "vector"] and kept.count() == 6


def test_searches_of_some_rows_among_all(spark):
    draw = random.Random(9)
    df = spark.createDataFrame([(i, i % 2, [draw.gauss(0, 1) for _ in range(6)], i % 5) for i in range(120)], "id long, part int, v array<double>, label int")
    asked = F.expr("id % 10 = 0")
    lines = lambda x: sorted((r["src"], r["dst"], r["rank"]) for r in x.collect())
    some, every = lines(V.knn_lsh(df, "id", "v", "part", asked=asked)), lines(V.knn_lsh(df, "id", "v", "part"))
    assert some == [x for x in every if x[0] % 10 == 0] and {x[0] for x in some} == set(range(0, 120, 10))
    assert V.eval_neighbors(V.knn(df, "id", "v", "part"), df, "id", "label", asked=asked).first()["queries"] == 12


def test_orders_are_dealt_before_notices_are_derived(spark, monkeypatch):
    from noticelake.plans import notices, registry

    monkeypatch.setattr(notices, "TASK_BYTES", 1024)
    rows = notices.source_rows(spark, "/root/testdata/sf0.001")
    assert rows.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism  # by the bytes stored, whatever the files
    assert notices._tasks(spark, "/root/testdata/sf0.01") > 3 * notices._tasks(spark, "/root/testdata/sf0.001")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("RepartitionByExpression", 1)
    assert "Product contains undeclared milk." in above and "undeclared" not in below
    for name in ("fn_lede", "fn_companies", "fn_parse_codes"):  # nothing is derived that is not read
        assert "Generate" not in registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_a_score_tells_of_harm_once(spark):
    from noticelake.functions import severity as S

    rows = spark.createDataFrame([("Class II", "Two people were hospitalized."), (None, "x")], "c string, t string")
    score = S.severity_score(F.col("c"), F.lit("other"), F.array().cast("array<struct<type:string,value:string>>"), reason=F.col("t")).alias("s")
    plan = rows.select(score)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("hospitalized|") <= 2  # in the whole text, and in its sentences
    assert [float(r[0]) for r in rows.select(score).collect()] == [66.7, 25.0]


def test_equal_vectors_are_trained_on_once(spark, monkeypatch):
    import numpy as np
    from pyspark.ml.classification import LogisticRegression

    draw = random.Random(2)
    kinds = [[draw.gauss(0, 1), draw.gauss(0, 1)] for _ in range(12)]
    rows = spark.createDataFrame([(kinds[draw.randrange(12)], float(draw.random() < 0.3)) for _ in range(400)], "v array<double>, y double")
    sizes = []
    fit = LogisticRegression.fit
    monkeypatch.setattr(LogisticRegression, "fit", lambda self, df: sizes.append(df.count()) or fit(self, df))
    model = M.train_vectors(rows, "v", "y")
    from pyspark.ml.functions import array_to_vector

    every = M.class_weights(rows.withColumn("x", array_to_vector("v")), "y")
    plain = fit(LogisticRegression(featuresCol="x", labelCol="y", weightCol="weight", maxIter=25, regParam=0.01), every)
    assert sizes[0] <= 24 and np.allclose(model.coefficientMatrix.toArray(), plain.coefficientMatrix.toArray(), atol=1e-4)


def test_terms_do_not_move_to_be_counted(spark):
    docs = spark.createDataFrame([(i, f"ripe pear {'raw leek ' * (i % 3)}", i) for i in range(9)], "doc_id long, text string, other int")
    weights = M.tfidf(docs, "doc_id", "text")
    got = weights.collect()
    plan = weights._jdf.queryExecution().executedPlan().toString()
    # texts by key, counts by term, one row of totals: no exchange by key and term, none of weights
    moved = {line.split("hashpartitioning(")[1].split("#")[0] for line in plan.splitlines() if "hashpartitioning(" in line}
    assert moved == {"doc_id", "term"} and "hashpartitioning(doc_id" in plan
    assert not any("hashpartitioning(doc_id" in line and "term" in line for line in plan.splitlines())
    assert len({(r["doc_id"], r["term"]) for r in got}) == len(got) and {r["doc_id"] for r in got} == set(range(9))
    for i in range(9):
        assert abs(sum(r["weight"] ** 2 for r in got if r["doc_id"] == i) - 1) < 1e-9


def test_neighbour_tasks_hold_few_scores(monkeypatch):
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from noticelake.operators import vectors as V

    draw = np.random.default_rng(1)
    m = draw.integers(-3, 4, (6000, 8)).astype(float)
    m[3000:] = m[:3000]  # ties
    unit = V._matrix(pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, 8), pa.int32()), pa.array(m.ravel())))
    ids = draw.permutation(6000)
    tracemalloc.start()
    got = V._best(ids, unit, ids, unit, 6)
    assert tracemalloc.get_traced_memory()[1] < 40 << 20  # 256 rows against all names were 50 MB more
    tracemalloc.reset_peak()
    pivots = {0: unit[:2000]}
    sizes = [b.num_rows for b in V._stretches(iter([pa.RecordBatch.from_arrays([pa.array(ids)], ["id"])]), pivots)]
    tracemalloc.stop()
    assert sum(sizes) == 6000 and max(sizes) * 2000 <= V._STRIP * V._WIDE
    score = unit @ unit.T
    score[np.arange(6000), np.arange(6000)] = -1
    rows = np.split(np.stack((got["dst"].to_numpy(), got["score"].to_numpy()), 1), 6000)
    for at in range(0, 6000, 500):
        order = np.lexsort((ids, -score[at].round(12)))[:6]
        assert rows[at][:, 0].astype(int).tolist() == ids[order].tolist()


def test_batches_of_a_stream_have_many_files(spark, monkeypatch):
    from noticelake.plans import q_tables as Q

    monkeypatch.setattr(Q, "_FILE_ROWS", 50)
    rows = spark.range(1000).select("id", F.when(F.col("id") == 0, 2).otherwise(F.col("id") % 2).alias("wave"))
    stream, seen = Q._restream(rows, "batches", 3, F.col("wave")), []
    put = lambda batch, _: seen.append([(r["wave"], r["count"]) for r in batch.groupBy("wave").count().collect()] + [batch.select(F.input_file_name()).distinct().count()])
    stream.writeStream.foreachBatch(put).trigger(availableNow=True).start().awaitTermination()
    assert [s[:-1] for s in seen] == [[(0, 499)], [(1, 500)], [(2, 1)]], seen
    assert seen[0][-1] > 1  # one file a batch was one task


def test_a_key_asks_its_state_once(monkeypatch):
    from noticelake.streaming.timers import _Deadline

    calls = []

    class Value:
        kept = None

        def get(self):
            calls.append("get")
            return self.kept

        def update(self, v):
            calls.append("update")
            self.kept = v

        def clear(self):
            self.kept = None

    class Handle:
        timers = set()
        getValueState = lambda self, name, schema: Value()
        registerTimer = lambda self, ms: calls.append("register") or self.timers.add(ms)
        deleteTimer = lambda self, ms: calls.append("delete") or self.timers.remove(ms)
        listTimers = lambda self: calls.append("list") or iter(sorted(self.timers))

    told = _Deadline()
    told.init(Handle())
    list(told.handleInputRows(("a",), iter([{"us": 5000, "limit_us": 2000}, {"us": 9000, "limit_us": None}]), None))
    list(told.handleInputRows(("a",), iter([{"us": 9500, "limit_us": None}]), None))
    assert calls == ["get", "update", "register", "get"] or calls == ["get", "register", "update", "get"]
    list(told.handleInputRows(("a",), iter([{"us": 4000, "limit_us": 1000}]), None))
    assert Handle.timers == {6}
    assert [r["deadline_us"] for r in told.handleExpiredTimer(("a",), None, None)] == [5000]


def test_a_post_is_decoded_in_two_passes_at_most(spark):
    from noticelake.plans import q_feeds

    posts = q_feeds.QUERIES["src_ncc"](spark, "/root/testdata/sf0.001")
    assert posts._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") <= 2


def test_themes_of_rows_that_share_few_vectors(spark):
    import numpy as np

    from noticelake.operators import clusters

    unlike = [[1.0, 0.0], [0.9, 0.1], [0.0, 1.0], [0.1, 0.9]]
    # 40,000 rows: a share of 1 in 10 of the hashes held none of these vectors, and nothing to draw from
    for shift in range(400):  # vectors whose hashes are all beyond the share that rows had
        low = [[x + shift * 1e-3, y] for x, y in unlike]
        asked = spark.createDataFrame([(v,) for v in low], "v array<double>").select((F.pmod(F.xxhash64("v"), F.lit(1 << 31)) / (1 << 31)).alias("h")).agg(F.min("h")).first()[0]
        if asked > 4 * 1024 / 40_000:
            break
    rows = spark.range(40_000).select("id", F.lit("us").alias("part"), F.get(F.array(*[F.array(*map(F.lit, v)) for v in low]), (F.col("id") % 4).cast("int")).alias("v"))
    centres, loss = clusters.fit(rows, "part", "v", {"us": 40_000}, 2, (42, 43))["us"]
    want = sorted([(np.array(low[0]) + low[1]) / 2, (np.array(low[2]) + low[3]) / 2], key=tuple)
    assert np.allclose(sorted(centres.tolist()), want) and abs(loss - 40_000 * 0.005) < 1e-3
    # equal rows count as often as they come
    centres, _ = clusters.fit(rows.where("id % 4 < 2 and (id % 4 = 0 or id < 4000)"), "part", "v", {"us": 11_000}, 1, (42,))["us"]
    assert np.allclose(centres[0], (10 * np.array(low[0]) + low[1]) / 11)


def test_projections_list_no_pairs(spark, monkeypatch):
    import numpy as np

    from noticelake.storage import cut

    draw = np.random.default_rng(4)
    points = draw.normal(size=(240, 5)).round(1)
    points[7] = 0.0
    rows = [(i, i % 2, [float(x) for x in p], i % 4) for i, p in enumerate(points)]
    df = spark.createDataFrame([*rows, rows[3], (None, 0, rows[4][2], 1)], "id long, part int, v array<double>, label int")
    asked = F.expr("id % 10 = 0")
    lines = lambda x: sorted((r["src"], r["rank"], r["dst"], round(r["score"], 9)) for r in x.collect())
    for width in (2.0, 0.25):  # all rows share a bucket, or few do
        from pyspark.ml.feature import BucketedRandomProjectionLSH
        from pyspark.ml.functions import array_to_vector

        unit = df.where("id is not null").dropDuplicates().select("id", "part", array_to_vector(V.normalized(F.col("v"))).alias("x"))
        model = BucketedRandomProjectionLSH(inputCol="x", outputCol="h", bucketLength=width, numHashTables=6, seed=42).fit(unit)
        near = model.approxSimilarityJoin(unit, unit, 1.4142, "d").where("datasetA.part = datasetB.part and datasetA.id <> datasetB.id")
        listed = V.rank_neighbors(near.select(F.col("datasetA.id").alias("src"), F.col("datasetB.id").alias("dst"), (1 - F.col("d") * F.col("d") / 2).alias("score")), 6)
        want = lines(listed)
        for block in (16_384, 50):
            assert lines(V.knn_lsh(df, "id", "v", "part", bucket=width, block_rows=block)) == want
        assert lines(V.knn_lsh(df, "id", "v", "part", bucket=width, asked=asked)) == [x for x in want if x[0] % 10 == 0]
    # what is stored are a row's best, however many rows share its buckets
    stored = []
    monkeypatch.setattr(V, "cut", lambda df, name: stored.append((name, df.count())) or cut(df, name))
    V.knn_lsh(df, "id", "v", "part")
    assert dict(stored)["hashed-vectors"] == 240 and max(n for _, n in stored) <= 6 * 240


def test_methods_are_compared_on_all_rows(spark):
    from noticelake.plans import q_tables

    told = q_tables.QUERIES["ml_compare_methods"](spark, "/root/testdata/sf0.001").collect()
    assert {(r["method"], r["queries"]) for r in told} == {("exact", 500), ("lsh", 500)}


def test_deadlines_of_many_keys_are_one_state(spark, tmp_path, monkeypatch):
    from noticelake.streaming import streams, timers

    draw = random.Random(6)
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    big = 1 << 60  # not a number that fits a float
    keys = [None, 0, *[big + i for i in range(60)]]
    waves, upto = [], 0
    for _ in range(5):
        upto += 60
        # a third of the rows end their key; some rows are too late, and some deadlines are those of earlier waves
        waves.append([(draw.choice(keys), at(upto - draw.choice((1, 20, 70, 400))), draw.choice((None, 5.0, 45.5))) for _ in range(120)])
    waves.append([(1, at(5000), None)])
    schema = "id long, ts timestamp, limit_s double"
    for rows in waves:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    monkeypatch.setattr(timers, "_PIECES", 2)
    told = {}
    for groups in (0, 1, 8):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        with timers.timer_store(spark):
            found = streams.run_to_table(timers.missed_deadlines(stream, "id", "ts", "limit_s", "100 seconds", groups), f"deadlines-{groups}")
        told[groups] = sorted((str(r["id"]), r["deadline"]) for r in found.collect())
    assert told[0] == told[1] == told[8] and len(told[0]) > 60 and any(k == "None" for k, _ in told[0])
    names = spark.createDataFrame([("a", at(0), 5.0), ("b", at(0), 5.0), ("b", at(3), None), (None, at(1), 5.0), ("z", at(900), None)], "id string, ts timestamp, limit_s double")
    names.coalesce(1).write.parquet(str(tmp_path / "names"))
    with timers.timer_store(spark):
        stream = spark.readStream.schema(names.schema).parquet(str(tmp_path / "names"))
        found = streams.run_to_table(timers.missed_deadlines(stream, "id", "ts", "limit_s", "10 seconds"), "deadlines-of-names").collect()
    assert sorted((str(r["id"]), r["deadline"]) for r in found) == [("None", at(6)), ("a", at(5))]


def test_a_group_of_keys_asks_its_state_once():
    import pandas as pd

    from noticelake.streaming.timers import _NONE, _Deadlines

    calls = []

    class State:
        def __init__(self):
            self.kept = None

        def get(self):
            calls.append("get")
            return self.kept

        def update(self, v):
            calls.append("update")
            self.kept = v

        put = update

        def appendList(self, v):
            calls.append("append")
            self.kept = [*(self.kept or []), *v]

        def clear(self):
            self.kept = None

    class Handle:
        timers = set()
        getValueState = lambda self, name, schema: State()
        getListState = getValueState
        registerTimer = lambda self, ms: calls.append("register") or self.timers.add(ms)
        deleteTimer = lambda self, ms: calls.append("delete") or self.timers.remove(ms)

    class Now:
        getCurrentWatermarkInMs = lambda self: 7

    group = _Deadlines()
    group.init(Handle())
    frame = lambda rows: iter([pd.DataFrame(rows, columns=["key", "limit", "ended"])])
    list(group.handleInputRows((3,), frame([(k, 6000 + 1000 * k, _NONE) for k in range(500)]), Now()))
    assert calls == ["get", "append", "register", "update"]  # of 500 keys
    list(group.handleInputRows((3,), frame([(1, _NONE, 6999), (0, _NONE, 6001)]), Now()))
    assert Handle.timers == {7}
    Handle.timers.clear()
    told = pd.concat(group.handleExpiredTimer((3,), Now(), None))
    assert told.values.tolist() == [[0, 6000]] and Handle.timers == {8}
    assert list(group.handleExpiredTimer((3,), type("", (), {"getCurrentWatermarkInMs": lambda self: 8})(), None)) == []  # 1 ended in time


def test_every_matching_pair_is_listed(spark, monkeypatch):
    from noticelake.plans import q_tables, registry
    from tests.compare import connect, rows_of, sql_rows

    monkeypatch.setattr(L, "_PAIRS", 50)  # many groups of a class
    for name in ("str_match", "str_stream_match"):
        pairs, columns = sql_rows(connect("/root/testdata/sf0.001"), registry.oracle_sql()[name])
        found = q_tables.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert found.columns == ["sub_id", "source", "recall_number"] and columns == sorted(found.columns)
        assert rows_of(found) == pairs and len(pairs) > 1500  # more than subscriptions and notices
