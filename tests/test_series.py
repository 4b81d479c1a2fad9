"""Unit series whose flags and forecasts are known."""

from noticelake.operators import timeseries as T


def frame(spark, counts, start=(2020, 1)):
    rows = []
    for i, c in enumerate(counts):
        m = start[1] - 1 + i
        rows.append(("s", "x", f"{start[0] + m // 12:04d}-{m % 12 + 1:02d}", c))
    return spark.createDataFrame(rows, "scope string, label string, month string, count long")


def flagged(spark, counts):
    return [r["observed"] for r in T.anomalies(frame(spark, counts)).orderBy("month").collect()]


def test_one_spike(spark):
    assert flagged(spark, [10, 11, 9, 10, 12, 8, 10, 11, 9, 10, 100, 10]) == [100]


def test_last_month_is_dropped(spark):
    assert flagged(spark, [10, 11, 9, 10, 12, 8, 10, 11, 9, 10, 999]) == []


def test_short_and_flat(spark):
    assert flagged(spark, [5, 90, 5, 90, 5]) == []
    assert flagged(spark, [20] * 20) == []


def test_sparse_needs_a_rise(spark):
    assert flagged(spark, [0] * 12 + [2, 0]) == []
    assert flagged(spark, [0] * 12 + [3, 0]) == [3]


def test_near_record(spark):
    got = T.anomalies(frame(spark, [5, 15] * 6 + [22, 10])).collect()
    assert [r["observed"] for r in got] == [22] and got[0]["z"] < 3
    assert flagged(spark, list(range(1, 21)))[0] == 13


def test_forecast_length_and_season(spark):
    assert T.forecast(frame(spark, [5] * 24)).count() == 0
    assert T.forecast(frame(spark, [5] * 25)).count() == 3
    assert T.forecast(frame(spark, [1, 0, 0, 0, 0] * 8)).count() == 0
    counts = [20 + (30 if i % 12 == 11 else 0) for i in range(49)]
    ahead = {r["month"][5:]: r["predicted"] for r in T.forecast(frame(spark, counts), horizon=12).collect()}
    assert ahead["12"] > ahead["06"] + 15


def test_grouped_maps_run(spark):
    df = frame(spark, [10 + i % 12 for i in range(40)] + [90, 10])
    assert T.holt_winters(df).count() == 3
    assert T.stl_flags(df).count() >= 1
