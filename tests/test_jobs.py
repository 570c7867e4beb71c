import os
import tempfile

import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_run_jobs_writes_every_stage(spark):
    import __spark_entry__ as E
    from churnlens.plans.jobs import Inputs, run_jobs
    from churnlens.sources import testdata as T
    ev = T.load(spark, SF, "events")
    inputs = Inputs(T.fixed_snapshot(ev), T.mobile_register(ev), T.mobile_moves(ev), T.interactions(ev),
                    T.service_orders(ev))
    out = tempfile.mkdtemp(prefix="churnlens-jobs-", dir="/tmp")
    paths = run_jobs(spark, inputs, out, T.TEST_PARAMS)
    q = E.queries()
    assert spark.read.parquet(paths["fixed_table"]).count() == q["fixed_table"](spark, SF).count()
    assert spark.read.parquet(paths["fmc_table"]).count() == q["fmc_table"](spark, SF).count()
    got = {r.month: r.activebase for r in spark.read.parquet(paths["driver_summary"]).collect()}
    want = {r.month: r.activebase for r in q["driver_summary"](spark, SF).collect()}
    assert got == want
