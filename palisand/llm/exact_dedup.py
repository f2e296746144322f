"""Exact dedup: one row of each group of equal texts stays, across deliveries.

A persistent index, a table bucketed and sorted by digest, has one row for each text that was ever taken in.  A delivery's
digests (SHA-256) are summed to one row for each text, meet the index in a sort-merge anti-join, in which the index is not
shuffled, and those it lacks are appended.  Of a text's rows in one delivery the one with the largest doc_id stays; rows of
later deliveries never replace it.  Texts themselves are never shuffled to find that out, only digests.

Groups of very many copies: digests are summed map-side, and when rows meet their groups, those of more than a thousandth of all
rows (so at most a thousand groups) are broadcast, and only rows of smaller groups are dealt by digest.

Only DataFrame functions are used.

Cases: null text is the empty text; null doc_id is smaller than any other; repeated rows (equal in doc_id too) count each, and one of
them stays; equal texts of different length don't exist, so very long texts cost their digest only; further columns are carried by
fresh() whatever their names; an empty delivery changes nothing.  A delivery handed in again under its name adds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisand.llm.shared import removed, staged

#: Groups of more than one in so many rows are broadcast: there are no more than this.
SHARE = 1000


def digest(text: Column) -> Column:
    """SHA-256 of the text in UTF-8, 32 bytes."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def ledger(docs: DataFrame, batch: str) -> DataFrame:
    """batch, row, doc_id, digest of every row, staged: all that is needed of a delivery."""
    return staged(docs.select(F.lit(batch).alias("batch"), F.monotonically_increasing_id().alias("row"), "doc_id", digest(F.col("text")).alias("digest")), "digests")


class DigestIndex:
    """digest, keep_id, row, batch of the row that stays of each text; a catalog table whose files lie in a folder of the caller's."""

    def __init__(self, spark: SparkSession, table: str, folder: str, id_type: str = "long", buckets: int | None = None) -> None:
        """Opens the table, or creates it with this many buckets (default: the session's number of shuffle partitions)."""
        self.spark, self.table, self.folder = spark, table, folder
        if not spark.catalog.tableExists(table):
            self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            self._append(spark.createDataFrame([], f"digest binary, keep_id {id_type}, row long, batch string"))
        else:
            self.buckets = int(spark.sql(f"describe extended {table}").filter("col_name = 'Num Buckets'").first()["data_type"])

    def _append(self, rows: DataFrame) -> None:
        rows.write.mode("append").bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.folder).saveAsTable(self.table)

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def add(self, rows: DataFrame) -> None:
        """Take in a ledger: the texts that the index lacks are appended."""
        last = F.max(F.struct("doc_id", "row", "batch")).alias("last")
        found = rows.groupBy("digest").agg(last).select("digest", F.col("last.doc_id").alias("keep_id"), "last.row", "last.batch")
        self._append(found.join(self.rows().select("digest").hint("merge"), "digest", "left_anti"))

    def groups(self, rows: DataFrame) -> DataFrame:
        """digest, keep_id, row, batch, group_size of the texts of ledgers that were taken in, staged."""
        sizes = rows.groupBy("digest").agg(F.count("*").alias("group_size"))
        return staged(sizes.join(self.rows().hint("merge"), "digest"), "groups")

    def drop(self) -> None:
        self.spark.sql(f"drop table if exists {self.table}")
        removed(self.spark, self.folder)


def with_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows (with a column digest) and what groups (staged) says of their digests, as a struct group."""
    total = groups.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    named = groups.select("digest", F.struct(*[c for c in groups.columns if c != "digest"]).alias("group"))
    large = F.broadcast(named.filter(F.col("group.group_size") > total / SHARE))  # fewer than SHARE rows, since their sizes sum up to total
    return rows.join(large, "digest").unionByName(rows.join(large, "digest", "left_anti").join(named.filter(F.col("group.group_size") <= total / SHARE).hint("merge"), "digest"))


def decisions(rows: DataFrame, index: DigestIndex) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of ledgers that the index has taken in."""
    g = F.col("group")
    kept = (g["row"] == F.col("row")) & (g["batch"] == F.col("batch"))
    return with_groups(rows, index.groups(rows)).select("doc_id", g["keep_id"].alias("keep_id"), g["group_size"].alias("group_size"), kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def fresh(docs: DataFrame, index: DigestIndex, batch: str) -> DataFrame:
    """The rows of a delivery that stay, all columns: one for each text that no delivery before it had."""
    rows = ledger(docs, batch)
    index.add(rows)
    keyed = docs.select(F.struct("*").alias("doc"), digest(F.col("text")).alias("digest"))
    met = with_groups(keyed, index.groups(rows)).filter(F.col("group.keep_id").eqNullSafe(F.col("doc.doc_id")) & (F.col("group.batch") == batch))
    return met.dropDuplicates(["digest"]).select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])
