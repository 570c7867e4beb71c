"""Exact dedup: a persistent digest index, bucketed and sorted by hash.

New documents are reduced to one row per digest (map-side combined, texts are
never shuffled), sort-merge anti-joined with the index, and the digests the
index lacks are appended to it. The index is a table of its own: a later batch
passes the same index and is deduplicated against everything before it. Its
files outlive the session: an index opened on a path that holds one registers
those files and adds to them. Each digest carries the id of its batch, so a
batch that failed and is repeated under its id gets its first answer.

Each batch adds a file per bucket. Spark trusts the sort order of a bucket of
one file only, so after the second batch the join sorts each bucket again;
``compacted`` writes an index of one file per bucket.

Defined results: a null text counts as empty, so all empty and null texts form
one group; null ids sort last among ties; of repeated rows (same id, equal
text) one is ``kept``. Other columns are ignored and kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.llm.common import SPACE, fresh, stage, work_path

COLUMNS = ("digest", "keep_id", "n_points", "batch")


class DigestIndex:
    """Table (digest, keep_id, n_points, batch) bucketed and sorted by digest.

    ``path`` names the folder of its files; where it holds an index, that index
    is opened with its own number of buckets, and nothing is written."""

    def __init__(self, spark: SparkSession, name: str | None = None, path: str | None = None,
                 buckets: int | None = None):
        self.spark = spark
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        self.path = path or work_path(spark, "index")
        self.buckets = self._stored_buckets() or buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if not spark.catalog.tableExists(self.name):
            # registers the folder; files in it are kept
            spark.sql(f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT, n_points BIGINT, batch STRING) USING parquet "
                      f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")
        self._store_buckets()

    def _marker(self):
        """The file that holds the number of buckets (readers skip names that begin with an underscore)."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path, "_buckets")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _stored_buckets(self) -> int | None:
        path, files = self._marker()
        if not files.exists(path):
            return None
        stream = files.open(path)
        try:
            return stream.readInt()
        finally:
            stream.close()

    def _store_buckets(self) -> None:
        path, files = self._marker()
        if not files.exists(path):
            stream = files.create(path, False)
            stream.writeInt(self.buckets)
            stream.close()

    def _write(self, rows: DataFrame) -> None:
        (rows.write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest")
             .option("path", self.path).saveAsTable(self.name))

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def missing(self, groups: DataFrame) -> DataFrame:
        """Rows of ``groups`` (one per digest) whose digest the index lacks."""
        return groups.hint("merge").join(self.read().select("digest"), "digest", "left_anti")

    def append(self, rows: DataFrame) -> None:
        """Add digests the index lacks; one file per bucket and batch."""
        self._write(rows.select(*COLUMNS).repartition(self.buckets, "digest"))

    def compacted(self, path: str, name: str | None = None) -> DigestIndex:
        """A copy with one file per bucket in another folder."""
        out = DigestIndex(self.spark, name, path, self.buckets)
        out.append(self.read())
        return out

    def drop(self) -> None:
        """Forget the table; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, n_points): SHA-256 of the text without white space, code points of the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.unhex(F.sha2(F.regexp_replace(text, SPACE + "+", ""), 256)).alias("digest"),
                       F.char_length(text).cast("long").alias("n_points"))


def exact_dedup(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text",
                batch: str | None = None) -> DataFrame:
    """Deduplicate a batch against itself and the index, and append it to the index.

    One row per input row: doc_id, keep_id, group_size (in this batch), kept,
    text_sha256, known (another batch brought the digest before). A batch that
    may be repeated needs a ``batch`` id; without one each call is a new batch.
    """
    batch = batch or uuid.uuid4().hex
    # numbered rows: of repeated ones the first number stays
    rows = stage(digests(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "digests")
    best = F.min(F.struct((-F.col("n_points")).alias("a"), F.col("doc_id").isNull().alias("b"),
                          F.col("doc_id").alias("c"), F.col("row").alias("d")))
    groups = rows.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
    groups = groups.select("digest", F.col("best.c").alias("keep_id"), (-F.col("best.a")).alias("n_points"),
                           F.col("best.d").alias("keep_row"), "group_size")
    had = index.read().where(F.col("batch") != batch).select("digest", F.col("keep_id").alias("old_id"), F.lit(True).alias("old"))
    groups = stage(groups.join(had.hint("merge"), "digest", "left")
                   .select("digest", F.when(F.col("old"), F.col("old_id")).otherwise(F.col("keep_id")).alias("keep_id"),
                           "n_points", "keep_row", "group_size", F.coalesce("old", F.lit(False)).alias("known")), "groups")
    index.append(index.missing(groups).withColumn("batch", F.lit(batch)))
    # a digest may belong to a third of all rows: both sides are plain scans, so
    # adaptive execution can split the hot partition of the document side
    out = rows.hint("merge").join(groups.drop("n_points"), "digest")
    return out.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"),
                      ((F.col("row") == F.col("keep_row")) & ~F.col("known")).alias("kept"),
                      F.lower(F.hex("digest")).alias("text_sha256"), "known")


def kept_documents(docs: DataFrame, decisions: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents whose ``kept`` is true; of repeated rows (same id, equal text) the longest.

    Texts meet the decisions once, by (id, digest). Repeated rows are rare, so
    only theirs are grouped.
    """
    sha, columns = fresh(docs, "_sha"), docs.columns
    keep = decisions.groupBy(F.col("doc_id").alias("_keep_id"), F.col("text_sha256").alias("_keep_sha")).agg(
        F.max("kept").alias("_kept"), F.count(F.lit(1)).alias("_keep_n")).where("_kept")
    keep = stage(keep, "keep")
    plain = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.withColumn(sha, F.sha2(F.regexp_replace(plain, SPACE + "+", ""), 256))
    cond = docs[id_col].cast("long").eqNullSafe(F.col("_keep_id")) & (docs[sha] == F.col("_keep_sha"))
    once = docs.join(keep.where("_keep_n = 1"), cond, "left_semi").select(*columns)
    if not keep.where("_keep_n > 1").isEmpty():
        again = docs.join(keep.where("_keep_n > 1"), cond, "left_semi")
        longest = F.max_by(F.struct(*[F.col(c) for c in columns]), F.char_length(plain)).alias("_row")
        once = once.unionByName(again.groupBy(F.col(id_col).alias("_g"), sha).agg(longest).select("_row.*"))
    return once


ORACLE = """
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                  sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS s FROM documents),
g AS (SELECT s, count(*) AS group_size, first(doc_id ORDER BY n DESC, doc_id) AS keep_id FROM d GROUP BY s)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.s AS text_sha256, false AS known
FROM d JOIN g USING (s)
"""
