import datetime as dt

from pyspark.sql import functions as F

from churnlens.params import Grain
from churnlens.plans.sizing import broadcast_if_small, estimated_bytes


def test_grains_trunc_shift_and_differences(spark):
    df = spark.createDataFrame([(dt.date(2022, 5, 18), dt.date(2023, 2, 2))], "a date, b date")
    out = {}
    for unit in ("month", "quarter", "year", "week"):
        g = Grain(unit)
        r = df.select(g.trunc(F.col("a")).alias("t"), g.shift(g.trunc(F.col("a")), 1).alias("s"),
                      g.periods_between(F.col("a"), F.col("b")).alias("n"),
                      F.size(g.periods_covering(F.col("a"), F.col("b"))).alias("k")).first()
        out[unit] = (r.t, r.s, r.n, r.k)
    assert out["month"] == (dt.date(2022, 5, 1), dt.date(2022, 6, 1), 9, 10)
    assert out["quarter"] == (dt.date(2022, 4, 1), dt.date(2022, 7, 1), 3, 4)
    assert out["year"] == (dt.date(2022, 1, 1), dt.date(2023, 1, 1), 1, 2)
    assert out["week"][0] == dt.date(2022, 5, 16) and out["week"][1] == dt.date(2022, 5, 23)
    assert out["week"][2] == out["week"][3] - 1 == 37


def test_broadcast_only_with_a_proven_bound(spark):
    nation = spark.read.parquet("/root/testdata/sf0.001/nation.parquet")    # file size is the bound
    assert estimated_bytes(nation) < 1 << 20
    plan = broadcast_if_small(nation, bound=1 << 20)._jdf.queryExecution().analyzed().toString().lower()
    assert "broadcast" in plan
    # an in-memory frame has no size statistics: no proof, no broadcast
    local = spark.createDataFrame([("TIENDA", "Retail")], "channel string, grp string")
    assert estimated_bytes(local) >= 1 << 62
    plan = broadcast_if_small(local, bound=1 << 20)._jdf.queryExecution().analyzed().toString().lower()
    assert "broadcast" not in plan
