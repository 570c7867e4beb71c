"""Scans, stage materialisation and history ingest.

Between pipeline stages a result is written as a table (or Parquet folder)
and read back: this is the job boundary of the reference, and it also cuts
lineage so a lost executor recomputes one stage, not the whole chain.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from churnlens import labels as L


def read_table(spark: SparkSession, name: str, fmt: str = "parquet") -> DataFrame:
    """Catalogue name (``db.table``) or a path to a Parquet folder/file."""
    if "/" in name or name.endswith(".parquet"):
        return spark.read.format(fmt).load(name)
    return spark.table(name)


def write_stage(df: DataFrame, name: str, mode: str = "overwrite",
                partition_by: Sequence[str] | None = None,
                bucket_by: tuple[int, Sequence[str]] | None = None) -> None:
    """``CREATE OR REPLACE TABLE AS`` (mode ``overwrite``) or ``CREATE TABLE
    IF NOT EXISTS AS`` (mode ``ignore``). A path writes Parquet; a bare name
    saves a catalogue table, optionally bucketed by the account key so the
    next stage joins without a shuffle."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if "/" in name:
        w.parquet(name)
        return
    if bucket_by:
        n, cols = bucket_by
        w = w.bucketBy(n, *cols).sortBy(*cols)
    w.saveAsTable(name)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Final grouped result for a spreadsheet."""
    df.write.mode(mode).option("header", True).csv(path)


def current_partition(df: DataFrame, period_col: str, partition_col: str = "dt") -> DataFrame:
    """Keep rows whose business period equals the load partition."""
    return df.where(F.col(period_col) == F.to_date(F.col(partition_col)))


def union_history(parts: Iterable[tuple[DataFrame, Mapping[str, str], Column | None]]) -> DataFrame:
    """Rename each monthly file to one schema, filter it, append.

    ``parts`` holds ``(df, {source_name: target_name}, predicate)``; columns
    missing from a part become NULL (``allowMissingColumns``).
    """
    out = None
    for df, rename, pred in parts:
        d = df.select([F.col(s).alias(t) for s, t in rename.items()])
        if pred is not None:
            d = d.where(pred)
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    if out is None:
        raise ValueError("no parts")
    return out


def population(df: DataFrame, type_col: str = "act_cust_typ", state_col: str | None = "act_acct_stat",
               types: Sequence[str] = L.RESIDENTIAL_TYPES,
               states: Sequence[str] = L.ACTIVE_STATES) -> DataFrame:
    """Residential customers in an active or suspended state."""
    pred = F.col(type_col).isin(list(types))
    if state_col:
        pred = pred & F.col(state_col).isin(list(states))
    return df.where(pred)


def dedupe_latest(df: DataFrame, keys: Sequence[str | Column], order: Column,
                  tie_break: Sequence[str] = ()) -> DataFrame:
    """Keep the last row per key (``row_number() = 1``), with an explicit
    tie-break so the choice is deterministic (D06)."""
    w = Window.partitionBy(*keys).orderBy(order.desc(), *[F.col(c).desc() for c in tie_break])
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def backfill_product(df: DataFrame, product_col: str, ref_period: str, from_date: str,
                     key: str = "act_acct_cd", day: str = "dt", grain=None) -> DataFrame:
    """Carry a product seen in a reference period forward to snapshots on or
    after ``from_date`` where it is missing (D08).

    The reference period is reduced to one row per account first (the last
    non-null product of that period), so the join back is one-to-one.
    """
    from churnlens.params import Grain
    grain = grain or Grain()
    ref = (df.where((grain.trunc(F.col(day)) == F.lit(ref_period).cast("date")) & F.col(product_col).isNotNull())
             .groupBy(key).agg(F.max_by(F.col(product_col), F.col(day)).alias("_ref_prod")))
    j = df.join(ref, key, "left")
    fill = F.when(F.col(day) >= F.lit(from_date).cast("date"), F.coalesce(F.col(product_col), F.col("_ref_prod"))) \
            .otherwise(F.col(product_col))
    return j.withColumn(product_col, fill).drop("_ref_prod")


def with_checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut lineage with a reliable checkpoint in ``spark.checkpoint.dir``
    (a shared folder on a cluster). Never a local checkpoint."""
    from churnlens.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


Transform = Callable[[DataFrame], DataFrame]
