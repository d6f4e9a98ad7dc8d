"""Exact deduplication against a persistent digest index.

The index is a table of the SHA-256 of every text seen so far, bucketed and sorted by that
digest, in a folder that any later application can open. A new batch is grouped by digest with
map-side partial aggregation, reduced to its unknown digests by a sort-merge anti-join with the index
(an empty one at first) and appended; then the decisions of the whole batch are read from the
stored index. No join shuffles the index. All of it is DataFrame code.

Rows whose digest makes up more than ``1 / HOT_SHARE`` of a batch cannot number more than
``HOT_SHARE``; their decisions are broadcast, all others are joined by digest. A text that
a third of all rows share therefore never meets in one task.

Defined results: a null text counts as empty, and empty texts equal one another. Of equal
texts the largest ``doc_id`` stays; null ids lose against any other. Repeated rows with the
same id and text all report the decision of that id and all count in ``group_size``. Other
columns of the input are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadloom.llm.rows import only, text_tag, without
from broadloom.session import materialize, path_exists, scratch_path

HOT_SHARE = 1024
BUCKET_ROWS = 2_000_000


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, the SHA-256 of the whole text in UTF-8, and the tag that names the row."""
    text = F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary")
    return docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        text_tag(docs).alias("tag"),
    )


class DigestIndex:
    """A digest table with columns digest, keep_id, group_size, batch.

    ``path`` is the folder of the index, a new one in the shared folder by default; an index that is
    there already is opened. ``name`` opens one that this session has registered.
    """

    def __init__(
        self, spark: SparkSession, name: str | None = None, buckets: int | None = None, path: str | None = None
    ):
        self.spark = spark
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        self.buckets = buckets
        self.path = path.rstrip("/") if path else scratch_path(spark, "digests")
        if self.exists():
            described = spark.sql(f"DESCRIBE EXTENDED {self.name}").filter("col_name IN ('Location', 'Num Buckets')")
            of = {r["col_name"]: r["data_type"] for r in described.collect()}
            self.buckets, self.path = int(of["Num Buckets"]), of["Location"].rsplit("/", 1)[0]
        elif path_exists(spark, f"{self.path}/info"):
            self.buckets = spark.read.schema("buckets int").json(f"{self.path}/info").first()["buckets"]
            self._register()

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def table(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def _register(self) -> None:
        self.spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT, group_size BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/digests'"
        )

    def _create(self, rows: int) -> None:
        if self.buckets is None:
            least = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            self.buckets = max(1, min(least, 1 + rows // 20_000), rows // BUCKET_ROWS)
        self._register()
        info = self.spark.range(1).select(F.lit(self.buckets).cast("int").alias("buckets"))
        info.write.json(f"{self.path}/info")

    def unknown(self, groups: DataFrame) -> DataFrame:
        """The groups whose digest the index does not hold; of both sides only the groups move."""
        dealt = groups.repartition(self.buckets, "digest")
        return dealt.join(self.table().select("digest").hint("merge"), "digest", "left_anti")

    def ingest(self, docs: DataFrame) -> DataFrame:
        """Add a batch; one row per document of the batch with its decision.

        A text that an earlier batch holds is dropped with ``keep_id`` of that batch;
        ``group_size`` counts the rows of the batch that brought the text first.
        """
        batch, number = materialize(digests(docs), "digests"), uuid.uuid4().hex
        rows = batch.count()
        if not self.exists():
            self._create(rows)
        groups = batch.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        groups = materialize(groups, "groups")
        new = materialize(self.unknown(groups), "new-digests").withColumn("batch", F.lit(number))
        writer = new.repartition(self.buckets, "digest").write.mode("append")
        writer.bucketBy(self.buckets, "digest").sortBy("digest").format("parquet").saveAsTable(self.name)
        wanted = groups.select("digest").repartition(self.buckets, "digest")
        stored = self.table().join(wanted.hint("merge"), "digest", "left_semi")
        decided = stored.select("digest", "keep_id", "group_size", (F.col("batch") == number).alias("new"))
        return _decide(batch, materialize(decided, "decided"), rows)


def _decide(batch: DataFrame, decided: DataFrame, rows: int) -> DataFrame:
    # More than rows / HOT_SHARE rows each: fewer than HOT_SHARE digests of the batch. Known
    # digests count by their first batch, so the list is cut by its own size as well.
    frequent = F.col("group_size") * HOT_SHARE > rows
    hot = decided.filter(frequent & F.col("new"))
    cold = decided.filter(~(frequent & F.col("new")))
    of_hot = batch.join(F.broadcast(hot), "digest")
    of_cold = batch.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(cold, "digest")
    return of_hot.unionByName(of_cold).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("new") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "tag",
    )


def mark_copies(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """Decisions for one batch, by default against an index of its own."""
    return (index or DigestIndex(docs.sparkSession)).ingest(docs)


def drop_copies(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The documents that stay, with all their columns; of repeated rows one stays.

    Only rows that are repeated with id and text are compared as rows, all others are
    kept or dropped by their decision alone.
    """
    marked = materialize(mark_copies(docs, index), "decisions")
    repeated = marked.filter("kept").groupBy("doc_id", "tag").count().filter("count > 1")
    repeated = materialize(repeated.select("doc_id", "tag"), "repeated")
    dropped = marked.filter(~F.col("kept")).select("doc_id", "tag")
    if repeated.isEmpty():
        return without(docs, dropped)
    once = without(docs, dropped.unionByName(repeated))
    # Null counts as empty here as well; the name is longer than any other one.
    whole = "_" * (1 + max(map(len, docs.columns)))
    rows = only(docs, repeated).withColumn(whole, F.coalesce(F.col("text").cast("string"), F.lit("")))
    return once.unionByName(rows.dropDuplicates(["doc_id", whole]).drop(whole))
