"""Properties of the fixed base on the sf0.01 test data."""
import os

import pytest
from pyspark.sql import functions as F

from churnlens.plans.fixed import fixed_stages
from churnlens.sources import testdata as T

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def stages(spark):
    p = T.TEST_PARAMS.with_(bom_max_overdue=None, eom_max_overdue=None)
    return fixed_stages(T.fixed_snapshot(T.load(spark, SF, "events")), p), p


def test_opening_of_next_period_is_closing_of_this_one(stages):
    st, p = stages
    b = st.base.where("active_bom = 1").groupBy("fixed_month").count().withColumnRenamed("count", "bom")
    e = (st.base.where("active_eom = 1").withColumn("fixed_month", F.date_add("fixed_month", 7))
           .groupBy("fixed_month").count().withColumnRenamed("count", "eom"))
    j = b.join(e, "fixed_month", "inner").collect()
    assert j and all(r.bom == r.eom for r in j)


def test_active_flags_never_both_zero_and_keys_unique(stages):
    st, _ = stages
    assert st.base.where("active_bom = 0 AND active_eom = 0").count() == 0
    assert st.table.groupBy("fixed_month", "fixed_account").count().where("count > 1").count() == 0


def test_churners_are_not_active_at_closing_unless_involuntary(stages):
    st, _ = stages
    vol = st.table.where("fixed_churner_type = '1. Fixed Voluntary Churner'")
    assert vol.where("active_eom = 1").count() == 0
