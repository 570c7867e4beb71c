"""Early technical tickets from two ticket systems (D84 with its second
source; D04, D09, R94, R95, R97 on the way).

The older system exports a register of text columns: account ids with marks
between the digits, receipt times whose first two date parts may be swapped,
tickets reported several times. The newer one is the interaction log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.functions.cache import col
from churnlens.functions.keys import billing_system, digits_only, weeks_full
from churnlens.params import Params

# Account statuses and customer types of a served household, and the widths of the systems' account ids.
SERVED_STATUSES = ("B", "D", "P", "SN", "SR", "T", "W")
SERVED_TYPES = ("Browse & Talk HFONE", "Residence", "Standard")
ACCOUNT_WIDTHS = (8, 12)


def swapped_date(c, parity: bool = True) -> Column:
    """Date of a ``day/month/year time`` text whose first two parts may stand
    in the other order (D04): a month above 12 with a day up to 12 is a day.
    Other marks within a part are dropped; a missing or blank part gives NULL.

    ``parity`` keeps the source's ``month < 12``, which loses December; False
    reads it."""
    c = col(c) if isinstance(c, str) else c
    part = lambda n: F.split_part(c, F.lit("/"), F.lit(n))
    number = lambda s: digits_only(s).try_cast("int")
    first, second = number(part(1)), number(part(2))
    year = number(F.split_part(part(3), F.lit(" "), F.lit(1)))
    swapped = (second > 12) & (first <= 12)
    usual = (second < 12 if parity else second <= 12)
    month = F.when(swapped, first).when(usual, second)
    day = F.when(swapped, second).when(usual & (first <= 31), first)
    text = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
    return F.when(year.isNotNull() & month.isNotNull() & day.isNotNull(), F.try_to_date(text, "yyyy-MM-dd"))


def clean_tickets(register: DataFrame, residential: str = "%residential%", excluded_place: str = "NETWORK MIGRATION",
                  widths=ACCOUNT_WIDTHS, status: str = "CLOSED", parity: bool = True) -> DataFrame:
    """(ticket_number, account, crm, received) of the closed residential
    tickets of a text register, one row per row kept: the account's digits
    name the system by their number (D09) and lose leading zeros."""
    digits = digits_only("account_id")
    kept = register.where(F.lower("cust_type").like(residential) & (col("found_name") != excluded_place)
                          & (col("status") == status) & F.length(digits).isin(list(widths)))
    return kept.select("ticket_number", digits.try_cast("long").cast("string").alias("account"),
                       billing_system(digits).alias("crm"), swapped_date("received_time", parity).alias("received"))


def account_starts_by_status(accounts: DataFrame, country: str | None = None, statuses=SERVED_STATUSES, types=None,
                             key: str = "act_acct_cd", start: str = "act_cust_strt_dt") -> DataFrame:
    """(account, start): first start of each account among the rows of the given statuses (and types, country)."""
    keep = col("act_acct_stat").isin(list(statuses))
    if types is not None:
        keep &= col("act_cust_typ").isin(list(types))
    if country is not None:
        keep &= col("org_cntry") == country
    return accounts.where(keep & col(key).isNotNull()).groupBy(col(key).alias("account")).agg(F.min(col(start).cast("date")).alias("start"))


def _early(tickets: DataFrame, starts: DataFrame, day: str, sold: Column, weeks: int) -> DataFrame:
    """(account, early_tickets, sales_month): whether a ticket came at most
    ``weeks`` whole weeks after the start. Tickets before it count too, as in
    the source; accounts without a start have 0 and a NULL month."""
    hit = F.when(weeks_full("start", day) <= weeks, 1).otherwise(0)
    j = tickets.join(starts, "account", "left")
    return j.groupBy("account", sold.alias("sales_month")).agg(F.max(hit).alias("early_tickets")).select(
        "account", "early_tickets", "sales_month")


def early_tickets_two_systems(register: DataFrame, calls: DataFrame, accounts: DataFrame, params: Params = Params(),
                              weeks: int = 7, since: str | None = None, call_country: str = "%jam%", country: str | None = None,
                              statuses=SERVED_STATUSES, types=SERVED_TYPES, parity: bool = True) -> DataFrame:
    """Accounts with an early technical ticket in either system (D84):
    distinct (account, early_tickets, sales_month) rows of both.

    A ticket of the register counts at its first receipt after ``since``, an
    interaction at its first day of each period. As in the source, register
    accounts need a start row of the given customer types and are keyed by the
    start day, call accounts need none and are keyed by the start's period.

    Both sides are reduced to one row per (account, day) before they meet the
    starts (one row per account), so a hot account costs its days."""
    g = params.grain
    t = clean_tickets(register, parity=parity).where(col("account").isNotNull() & col("received").isNotNull())
    if since is not None:
        t = t.where(col("received") > F.lit(since).cast("date"))
    t = t.groupBy("ticket_number", "account").agg(F.min("received").alias("day")).select("account", "day").distinct()
    day = F.to_date("interaction_start_time")
    c = calls.where(F.lower("org_cntry").like(call_country)).select(digits_only("account_id").alias("account"), "interaction_id", day.alias("day"))
    c = c.where(col("account").isNotNull()).groupBy("account", "interaction_id", g.trunc(col("day"))).agg(F.min("day").alias("day"))
    c = c.select("account", "day").distinct()
    older = _early(t, account_starts_by_status(accounts, country, statuses, types), "day", col("start"), weeks)
    newer = _early(c, account_starts_by_status(accounts, country, statuses), "day", g.trunc(col("start")), weeks)
    return older.unionByName(newer).distinct()
