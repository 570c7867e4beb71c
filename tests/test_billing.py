"""Oldest unpaid bill: one hand-made account per rule."""
import datetime as dt

from churnlens.operators.billing import bill_payments, oldest_unpaid


def day(text):
    return dt.date.fromisoformat(text) if text else None


# account -> [(bill date, payment)], [(snapshot day, oldest unpaid bill)]
CASES = {
    "first paid while open": ([("2022-01-10", "2022-03-01")], [("2022-01-05", "2022-01-01"), ("2022-02-20", "2022-01-01")]),
    "paid bill": ([("2022-01-10", "2022-01-20")], [("2022-01-20", None), ("2022-01-31", None), ("2021-12-31", None)]),
    "no previous bill": ([("2021-06-10", "2021-06-11"), ("2022-01-10", "2022-01-25")], [("2022-01-12", "2022-01-10"), ("2022-01-09", "2022-01-01")]),
    "both open": ([("2021-06-10", "2021-06-11"), ("2021-12-10", "2022-01-20"), ("2022-01-10", "2022-01-25")], [("2022-01-12", "2021-12-10")]),
    "previous paid": ([("2021-06-10", "2021-06-11"), ("2021-12-10", "2022-01-11"), ("2022-01-10", "2022-01-25")], [("2022-01-12", "2022-01-10")]),
    "previous open, bill unpaid": ([("2021-06-10", "2021-06-11"), ("2021-12-10", "2022-01-20"), ("2022-01-10", None)], [("2022-01-12", "2021-12-10")]),
    "never paid": ([("2021-06-10", None), ("2022-01-10", None)], [("2022-01-12", "2021-06-10"), ("2022-02-12", None), ("2021-06-09", None)]),
    "last paid while open": ([("2021-06-10", "2021-06-11"), ("2021-12-10", "2022-02-20")], [("2022-02-01", "2021-12-01"), ("2022-02-20", None)]),
    # the last bill is not dated a period after the one before it
    "other day of the month": ([("2021-06-10", "2021-06-11"), ("2021-12-09", "2022-01-20"), ("2022-01-10", "2022-01-25")], [("2022-01-12", "2022-01-10")]),
    "no bill": ([], [("2022-01-12", None)]),
}


def test_rules(spark):
    bills, moves, days, want = [], [], [], {}
    for account, (own, seen) in CASES.items():
        for k, (issued, paid) in enumerate(own):
            bills.append((account, f"{len(bills)}", day(issued)))
            if paid:
                moves += [(bills[-1][1].rjust(10, "0"), day(paid)), (bills[-1][1].rjust(10, "0"), day(paid) + dt.timedelta(9))]
        for at, oldest in seen:
            days += [(account, day(at))] * 2
            want[account, day(at)] = (day(oldest), (day(at) - day(oldest)).days if oldest else None)
    first = bill_payments(spark.createDataFrame(bills, "contrato string, factura string, fecha_fact date"),
                          spark.createDataFrame(moves, "fact_aplica string, fecha_mov date"))
    got = oldest_unpaid(spark.createDataFrame(days, "act_acct_cd string, dt date"), first).collect()
    assert len(got) == len(want)
    assert {(r.contrato, r.day): (r.oldest_unpaid_bill, r.overdue_days) for r in got} == want
