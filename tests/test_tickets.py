"""Hand-made rows of the two ticket systems."""
import datetime as dt

from pyspark.sql import functions as F

from churnlens.operators.tickets import clean_tickets, early_tickets_two_systems, swapped_date

COLS = "ticket_number string, account_id string, cust_type string, found_name string, status string, received_time string"


def ticket(number, account="A0000-0012", when="05/02/2022 10:00", kind="Residential", place="STREET", status="CLOSED"):
    return number, account, kind, place, status, when


def test_swapped_date(spark):
    texts = ["05/02/2022 10:00", "02/15/2022 10:00", "31/01/2022", "25/12/2022 1:00", "12/25/2022 1:00", "31/02/2022", "13/14/2022",
             "/02/2022 1:00", "05/02", "x5/0-2/2022 9:00", "", None]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.d for r in frame.select("i", swapped_date("t").alias("d")).orderBy("i").collect()]
    d = dt.date
    assert got == [d(2022, 2, 5), d(2022, 2, 15), d(2022, 1, 31), None, d(2022, 12, 25), None, None, None, None, d(2022, 2, 5), None, None]
    assert frame.where("i = 3").select(swapped_date("t", parity=False)).first()[0] == d(2022, 12, 25)


def test_clean_tickets(spark):
    rows = [ticket("t1"), ticket("t2", "00-0000-000123"), ticket("t3", "1234567890"), ticket("t4", kind="Business"),
            ticket("t5", kind="NON-RESIDENTIAL TOO"), ticket("t6", place="NETWORK MIGRATION"), ticket("t7", status="OPEN"),
            ticket("t8", place=None), ticket("t9", None), ticket("t10", "1234 567"), ticket("t11", when="//2022")]
    got = {(r.ticket_number, r.account, r.crm, r.received) for r in clean_tickets(spark.createDataFrame(rows, COLS)).collect()}
    d = dt.date(2022, 2, 5)
    # a blank stays in the id and makes its width 8, but it is no number then
    assert got == {("t1", "12", "CERILLION", d), ("t2", "123", "LIBERATE", d), ("t5", "12", "CERILLION", d),
                   ("t10", None, "CERILLION", d), ("t11", "12", "CERILLION", None)}
    assert clean_tickets(spark.createDataFrame([], COLS)).count() == 0


def test_early_tickets_two_systems(spark):
    served = [("12", "W", "Residence", "2022-01-01"), ("12", "W", "Residence", "2022-02-01"), ("13", "W", "Residence", "2021-06-01"),
              ("14", "X", "Residence", "2022-01-01"), ("15", "W", "Office", "2022-01-20"), (None, "W", "Residence", "2022-01-01")]
    accounts = spark.createDataFrame(served, "act_acct_cd string, act_acct_stat string, act_cust_typ string, s string").select(
        "act_acct_cd", "act_acct_stat", "act_cust_typ", F.to_date("s").alias("act_cust_strt_dt"))
    register = [ticket("t1"), ticket("t1", when="20/06/2022 10:00"), ticket("t2", "A0000-0013"), ticket("t3", "A0000-0014"),
                ticket("t4", "A0000-0015"), ticket("t5", "1234 567"), ticket("t6", "A0000-0012", "05/01/2020 1:00")]
    calls = [("i1", "J-15", "JAMAICA", "2022-03-12"), ("i1", "J-15", "JAMAICA", "2022-03-13"), ("i2", "13", "Jamaica", "2022-03-12"),
             ("i3", "12", "Barbados", "2022-01-02"), ("i4", "77", "Jamaica", "2022-01-02"), ("i5", None, "Jamaica", "2022-01-02")]
    calls = spark.createDataFrame(calls, "interaction_id string, account_id string, org_cntry string, t string").withColumn(
        "interaction_start_time", F.to_timestamp("t"))
    out = early_tickets_two_systems(spark.createDataFrame(register, COLS), calls, accounts, since="2021-01-01")
    got = sorted(((r.account, r.early_tickets, r.sales_month) for r in out.collect()), key=str)
    d = dt.date
    # 51 days are 7 whole weeks; an office account counts by its calls alone
    assert got == sorted([("12", 1, d(2022, 1, 1)), ("13", 0, d(2021, 6, 1)), ("14", 0, None), ("15", 0, None),
                          ("15", 1, d(2022, 1, 1)), ("77", 0, None)], key=str)
