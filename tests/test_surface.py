import json

import pytest
from pyspark.sql import functions as F

from fairground.functions import geo, surface, text, times

POINTS = "occurrence_id long, event_id long, title string, starts_at timestamp_ntz, venue_id long, city_id int, country_id int, status string, latitude double, longitude double"


@pytest.fixture(scope="module")
def session(spark):
    rows = [
        (1, 1, "Łódź Fest", "1997-01-01", 7, 3, 1, "published", 51.76, 19.46),
        (2, 1, "Łódź Fest", "1997-02-01", 7, 3, 1, "published", 51.76, 19.46),
        (3, 2, "Été", "1997-01-02", None, 4, 1, "draft", 46.2, 6.1),
        (4, 3, None, "1997-01-03", 8, 4, 2, "sold_out", 46.2, 6.1),
        (5, 4, "nowhere", "1997-01-03", None, None, None, "published", None, None),
    ]
    texts = spark.createDataFrame(rows, POINTS.replace("timestamp_ntz", "string"))
    surface.register(spark, texts.withColumn("starts_at", F.col("starts_at").cast("timestamp_ntz")))
    return spark


def ids(df):
    return sorted(r.occurrence_id for r in df.collect())


def test_scalars_are_those_of_columns(session):
    rows = [("Łódź, Été & Straße", 46.2, 6.1, 3), ("", 0.0, 0.0, 0), ("ŉ Œuvre  ", -46.2, 179.9, 40), (None, None, 6.1, None)]
    df = session.createDataFrame(rows, "x string, lat double, lon double, n int")
    df.createOrReplaceTempView("given")
    got = session.sql("select folded(x), slug(x), slug(x, 4), round(distance_km(lat, lon, 40.0D, -3.0D), 6), retry_seconds(n) from given").collect()
    x, n = F.col("x"), F.col("n")
    want = df.select(text.fold(x), text.slugify(x), text.slugify(x, 4), F.when(F.col("lat").isNotNull(), F.round(geo.haversine_km(F.col("lat"), F.col("lon"), F.lit(40.0), F.lit(-3.0)), 6)), F.when(n.isNotNull(), times.backoff_seconds(n))).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]
    assert got[0][0] == "lodz, ete & strasse" and tuple(got[3]) == (None,) * 5


def test_lists(session):
    between = lambda more="": ids(session.sql(f"select * from events_between(timestamp_ntz'1997-01-01', timestamp_ntz'1997-01-31'{more})"))
    assert between() == [1, 4, 5] and between(", 3") == [1] and between(", country => 2") == [4] and between(", 3, 2") == []
    assert ids(session.sql("select * from events_between(null, timestamp_ntz'1997-01-31')")) == []
    assert ids(session.sql("select * from schedule_of(7)")) == [1, 2] and ids(session.sql("select * from schedule_of(null)")) == []
    near = session.sql("select * from events_near(51.7D, 19.4D, 20, timestamp_ntz'1997-01-01', timestamp_ntz'1998-01-01')")
    assert ids(near) == [1, 2] and all(0 < r.km_away < 20 for r in near.collect())


def test_list_beside_a_table_is_a_join(session):
    session.createDataFrame([(3,), (4,), (3,), (None,)], "c int").createOrReplaceTempView("asked")
    got = session.sql("select c, e.occurrence_id from asked, lateral events_between(timestamp_ntz'1997-01-01', timestamp_ntz'1997-01-31', c) e where c is not null")
    assert sorted(map(tuple, got.collect())) == [(3, 1), (3, 1), (4, 4)]
    assert "Cartesian" not in (plan := got._jdf.queryExecution().optimizedPlan().toString()) and "Join Inner" in plan


def test_json_leaves(session):
    deep = json.dumps({"a": [1, {"b": None, "c": "x"}], "d": True, "e": {}}), "[[[2.5]]]", "no json", "", None, '"text"', "[" * 5000
    session.createDataFrame([(i, t) for i, t in enumerate(deep)], "i int, t string").createOrReplaceTempView("texts")
    got = [tuple(r) for r in session.sql("select i, j.path, j.value from texts, lateral json_leaves(t) j").collect()]
    assert sorted(got, key=str) == sorted([(0, "$.a[0]", "1"), (0, "$.a[1].b", None), (0, "$.a[1].c", "x"), (0, "$.d", "true"), (1, "$[0][0][0]", "2.5"), (5, "$", "text")], key=str)
