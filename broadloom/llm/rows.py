"""Taking rows out of a table of documents by decisions that were made without their texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from broadloom.session import materialize, ship_package, small_side

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession) -> None:
    """Ship the package, and replace Spark's default of 10,000 rows per Arrow batch.

    Whole texts are large rows: the default would take tens of megabytes per task on both sides.
    A setting other than the default is left as it is.
    """
    ship_package(spark)
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, "1000")


def text_tag(docs: DataFrame) -> Column:
    """A 64-bit tag of the text; with doc_id it names a row up to exact repetitions."""
    return F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``dropped`` lists by doc_id and tag; ids may be null.

    The list is counted: up to a bounded size it is broadcast and the texts stay where they are.
    """
    return _by_row(docs, dropped, "left_anti")


def only(docs: DataFrame, listed: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``listed`` names by doc_id and tag."""
    return _by_row(docs, listed, "left_semi")


def _by_row(docs: DataFrame, listed: DataFrame, how: str) -> DataFrame:
    listed = materialize(listed.select("doc_id", "tag").distinct(), "listed")
    side = small_side(listed, listed.count())
    same = docs["doc_id"].cast("long").eqNullSafe(side["doc_id"]) & (text_tag(docs) == side["tag"])
    return docs.join(side, same, how)


#: A key with more than this share of all rows counts as hot; there are fewer such keys.
HOT_SHARE = 1024


def join_counted(rows: DataFrame, of_key: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with one row per key that holds the number of its rows.

    Keys with more than ``total / HOT_SHARE`` rows are fewer than ``HOT_SHARE`` and are broadcast, so
    the rows of a hot key stay where they are; all others are joined by key.
    """
    frequent = F.col(count) * HOT_SHARE > total
    hot, cold = of_key.filter(frequent), of_key.filter(~frequent)
    of_hot = rows.join(F.broadcast(hot), key)
    of_cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return of_hot.unionByName(of_cold)
