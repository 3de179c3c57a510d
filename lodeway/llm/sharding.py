"""Contiguous shards of near equal bytes, by global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .keys import cut

LOCAL_BITS = 33  # monotonically_increasing_id keeps the row within its partition in these


def shard_by_bytes(docs: DataFrame, n_shards: int = 16, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Put every row into one of n_shards contiguous shards of near equal bytes.

    Rows are put in the order of id (nulls first), checksum, size and text hash
    and written once to the checkpoint folder.  Partition totals give each
    partition its offset; a row goes to the shard in whose equal part of all
    bytes its middle byte falls.  So a shard differs from the mean by less than
    its two border rows.  Returns doc_id, the carried columns as a struct `row`,
    size (UTF-8 bytes plus 1), text_crc32, shard and slot.

    Corner cases: null texts have no bytes (size 1); rows that are alike in all
    of the above stand next to each other; with fewer rows than shards some
    shards are empty; an empty table gives an empty result.
    """
    body = F.coalesce(docs[text].cast("string"), F.lit(""))
    row = [F.struct(*(docs[c] for c in carry)).alias("row")] if carry else []
    rows = docs.select(docs[doc_id].alias("doc_id"), *row, (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.xxhash64(body).alias("h"))
    order = [F.col("doc_id").asc_nulls_first(), "text_crc32", "size", "h"]
    placed = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()).drop("h"))
    part, local = F.shiftright("at", LOCAL_BITS).alias("part"), F.col("at").bitwiseAND(F.lit((1 << LOCAL_BITS) - 1)).alias("local")

    # one row for each partition
    totals = placed.groupBy(part).agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    totals = cut(totals.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"), F.sum("bytes").over(every).alias("all_bytes")))

    # the first row of each shard: n_shards rows
    own = Window.partitionBy("part").orderBy("local").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    narrow = placed.select(part, local, "size").withColumn("sum", F.sum("size").over(own)).join(F.broadcast(totals), "part")
    narrow = narrow.withColumn("twice", (2 * (F.col("bytes_before") + F.col("sum")) - F.col("size")) * n_shards)
    shard = F.expr(f"least(twice div (2 * all_bytes), {n_shards - 1})")
    firsts = narrow.groupBy(shard.alias("shard")).agg(F.min(F.col("rows_before") + F.col("local")).alias("first")).collect()

    cuts = sorted((r["first"], r["shard"]) for r in firsts)
    number = F.col("rows_before") + F.col("local")
    which, start = F.lit(0), F.lit(0).cast("long")
    for first, s in cuts:
        which = F.when(number >= first, F.lit(s)).otherwise(which)
        start = F.when(number >= first, F.lit(first)).otherwise(start)
    out = placed.withColumn("part", part).withColumn("local", local).join(F.broadcast(totals), "part")
    return out.select("doc_id", *(["row"] if carry else []), "size", "text_crc32", which.cast("int").alias("shard"), (number - start).cast("long").alias("slot"))


def write_shards(docs: DataFrame, folder: str, n_shards: int = 16) -> None:
    """Write all columns of docs to folder/shard=<n>, in slot order."""
    out = shard_by_bytes(docs, n_shards, carry=tuple(docs.columns)).select("row.*", "shard", "slot")
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)
