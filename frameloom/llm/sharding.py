"""Sharding: a two-pass external shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_of, new_path, text_of

MAX_PARTITIONS = 20_000


def rendezvous(key: Column, shards: int, seed: int) -> Column:
    """The shard whose seeded hash of the key is largest: one more shard takes keys only into itself."""
    best = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(F.xxhash64(F.lit(seed), s, key).alias("h"), s.alias("s"))))
    return best["s"]


def external_shuffle(docs: DataFrame, shards: int = 16, seed: int = 17, bucket_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deal rows to shards by key and shuffle them within each shard.

    Law ``key``: the seeded hashes of id and shard decide (rendezvous). Pass one
    scatters a shard's rows by another seeded hash into buckets of about
    ``bucket_bytes``; their number follows the shard's own bytes, so a shard
    that an often repeated id swells has more of them. Pass two puts a bucket
    into a canonical order, shuffles it (Spark's seeded ``shuffle`` is a
    Fisher-Yates shuffle) and numbers the rows behind those of the shard's
    earlier buckets. The same input, seed and sizes give the same slots: the
    generator is seeded by the partition, which the bucket's number decides.

    Returns all columns of the input with shard int, slot long (gapless from 0
    in its shard) and grown_shard int (the shard if there were one more). A
    column of the input with one of these names, in capitals or not, is
    replaced; columns of any type are kept, maps too. A null id is a key like
    any other; equal rows each get a slot (rows that are equal as a whole share
    a bucket); an empty table gives none.
    """
    own = [c for c in docs.columns if c.lower() not in ("shard", "slot", "grown_shard")]
    rest = [c for c in own if c not in (id_col, text_col)]
    text, key = text_of(text_col), id_of(id_col)
    other = F.xxhash64(F.to_json(F.struct(*rest))) if rest else F.lit(0).cast("long")  # maps can't be hashed or sorted, their text can
    dealt = (
        docs.select(F.struct(*[F.col(c) for c in own]).alias("_row"), key.alias("_key"), F.xxhash64(F.lit(seed + 1), key, text).alias("_h"), other.alias("_o"), (F.octet_length(text) + 1).cast("long").alias("_size"))
        .withColumn("_shard", rendezvous(F.col("_key"), shards, seed))
    )
    held = {r["_shard"]: r["_bytes"] for r in dealt.groupBy("_shard").agg(F.sum("_size").alias("_bytes")).collect()}  # a row a shard
    most = max(1, MAX_PARTITIONS // shards)
    buckets_of = [min(most, max(1, -(-held.get(s, 0) // bucket_bytes))) for s in range(shards)]
    first = [sum(buckets_of[:s]) for s in range(shards)]
    pick = lambda numbers: F.element_at(F.array(*[F.lit(n) for n in numbers]), F.col("_shard") + 1)
    dealt = dealt.withColumn("_b", pick(first) + F.pmod(F.xxhash64(F.lit(seed + 2), "_h", "_o"), pick(buckets_of).cast("long")).cast("int"))
    order = "array_sort(transform(_keys, (k, i) -> struct(k.h AS h, k.k AS k, k.o AS o, i AS i)))"
    buckets = (
        dealt.repartition(sum(buckets_of), "_b").groupBy("_b", "_shard")
        .agg(F.collect_list("_row").alias("_rows"), F.collect_list(F.struct(F.col("_h").alias("h"), F.col("_key").alias("k"), F.col("_o").alias("o"))).alias("_keys"))  # bucket_bytes bounds both
        .sortWithinPartitions("_b")
        .select("_b", "_shard", "_rows", F.shuffle(F.expr(order), seed).alias("_order"))
        .select("_b", "_shard", F.expr("transform(_order, k -> struct(_rows[k.i] AS row, k.k AS key))").alias("_dealt"))  # an exploded row takes its own row along, not the bucket
    )
    behind = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_b", F.col("_shard").alias("_s")).count().select("_b", F.coalesce(F.sum("count").over(behind), F.lit(0)).alias("_start"))
    placed = buckets.join(starts, "_b").select("_shard", "_start", F.posexplode("_dealt").alias("_pos", "_d"))
    return placed.select(
        "_d.row.*", F.col("_shard").alias("shard"), (F.col("_start") + F.col("_pos")).alias("slot"), rendezvous(F.col("_d.key"), shards + 1, seed).cast("int").alias("grown_shard"))


def write_shards(dealt: DataFrame, path: str) -> None:
    """One folder a shard, a file or more for each: the tasks that shuffled a shard's buckets write them, in slot order, without moving a row.

    ``dealt`` is what ``external_shuffle`` returns; a file holds whole buckets.
    """
    dealt.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str, schema) -> DataFrame:
    """Written shards; an empty table writes none, so the schema is told."""
    return spark.read.schema(schema).parquet(path)


def digest(docs: DataFrame, **kw) -> DataFrame:
    """The contract's columns, of the whole rows in the shards that are written."""
    spark, text = docs.sparkSession, text_of("text")
    dealt, path = external_shuffle(docs, **kw), new_path(docs.sparkSession, "shards")
    write_shards(dealt, path)
    size = (F.octet_length(text) + 1).cast("long").alias("size")
    return read_shards(spark, path, dealt.schema).select("doc_id", size, F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", "grown_shard")
