"""Contiguous shards of nearly equal bytes [native].

Rows are put in ``doc_id`` order by a range exchange of narrow rows (id, size
and checksum; texts never move). Each partition gives its total of bytes and
rows; prefix sums over these few totals place every row on one global byte
axis, which is cut at equal targets. No task sees more than one partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.llm.common import cut, text_of


def shard_by_bytes(docs: DataFrame, shards: int = 8, partitions: int | None = None) -> DataFrame:
    """Return doc_id, size, text_crc32, shard and slot of every row of ``docs``.

    ``size`` is the UTF-8 length plus 1, so that empty texts (null counts as
    one) still have a place. A row goes to the shard in whose range the middle
    of its bytes lies: shards differ from the equal share by one row's size at
    most. ``slot`` counts from 0 within a shard. Null ids come first; rows with
    one id are ordered by checksum and size, and repeated rows each keep a slot.
    A text longer than a shard's share has a shard of its own, and shards next to
    it may be empty. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    text = text_of(docs)
    narrow = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    order = ["doc_id", "text_crc32", "size"]
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = cut(narrow.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "shard-parts")
    totals = parts.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    # One row for each range partition: a window over them is small by construction.
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    placed = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(W.partitionBy()).alias("total"),
    )
    inside = W.partitionBy("part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    rows = parts.select(
        "*",
        F.coalesce(F.sum("size").over(inside), F.lit(0)).alias("local_bytes"),
        (F.row_number().over(W.partitionBy("part").orderBy(*order)) - 1).alias("local_row"),
    ).join(F.broadcast(placed), "part")
    middle = (2 * (F.col("bytes_before") + F.col("local_bytes")) + F.col("size")).cast("decimal(38,0)")
    shard = F.least(F.lit(shards - 1), F.floor(middle * shards / (2 * F.col("total"))).cast("int"))
    rows = cut(rows.select(*order, shard.alias("shard"), (F.col("rows_before") + F.col("local_row")).alias("row")), "shard-rows")
    first = rows.groupBy("shard").agg(F.min("row").alias("first"))  # at most `shards` rows
    return rows.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first")).alias("slot"))
