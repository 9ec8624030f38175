"""Line dedup: levelled sorted runs of line hashes, merged batch by batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANK, delete, id_of, lower_ascii, new_path, save, text_key, text_of

KEY = ["_h1", "_h2"]


class LineIndex:
    """Sorted runs of (line hash, owner): the smallest id that holds the line.

    A run is a table bucketed and sorted by hash, so a later batch joins it by
    merging without moving it. Runs are disjoint: a batch adds only what no
    run has. Level k holds at most ``fan_in - 1`` runs; one more and they are
    compacted into a single run of level k + 1.
    """

    def __init__(self, spark, buckets: int, fan_in: int = 3):
        self.spark, self.buckets, self.fan_in = spark, buckets, fan_in
        self.levels: list[list[tuple[str, str]]] = [[]]

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name, _ in level]

    def _write(self, df: DataFrame, level: int) -> None:
        name, path = f"line_run_{uuid.uuid4().hex}", new_path(self.spark, "line-run")
        (
            df.repartition(self.buckets, "_h1")
            .write.bucketBy(self.buckets, "_h1").sortBy(*KEY)
            .option("path", path).format("parquet").saveAsTable(name)
        )
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append((name, path))

    def add(self, df: DataFrame) -> None:
        """Add a run of new keys and compact the levels that are full."""
        self._write(df, 0)
        level = 0
        while len(self.levels[level]) >= self.fan_in:
            old = self.levels[level]
            merged = self.spark.table(old[0][0])
            for name, _ in old[1:]:
                merged = merged.unionByName(self.spark.table(name))
            self._write(merged, level + 1)
            self.levels[level] = []
            self._drop(old)
            level += 1

    def _drop(self, runs: list[tuple[str, str]]) -> None:
        for name, path in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            delete(self.spark, path)

    def clear(self) -> None:
        for level in self.levels:
            self._drop(level)
        self.levels = [[]]


#: A key that holds more than this share of a batch's lines is told apart, so that its lines needn't meet in one task; at most as many keys can.
HEAVY = 1 / 1000


def dropped_lines(mine: DataFrame, shared: DataFrame, lines: int) -> DataFrame:
    """Lines of ``mine`` whose key ``shared`` (key, keeper, n) gives to another document.

    At most 1 / HEAVY keys have more than that share of the lines, which bounds
    what is broadcast; lines of all other keys meet their keeper by a shuffle.
    """
    least = max(1, int(lines * HEAVY))
    heavy = F.broadcast(shared.where(F.col("_n") > least).select(*KEY, "_keeper"))
    told = mine.join(heavy.withColumnRenamed("_keeper", "_heavy"), KEY, "left")
    rest = told.where("_heavy IS NULL").drop("_heavy").join(shared.where(F.col("_n") <= least).select(*KEY, "_keeper"), KEY)
    both = told.where("_heavy IS NOT NULL").withColumnRenamed("_heavy", "_keeper").unionByName(rest)
    return both.where(F.col("_id") != F.col("_keeper")).select("_id", "_t1", "_t2", "_pos")


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, batches: int | None = None, fan_in: int = 3, buckets: int | None = None,
    batch_bytes: int = 96 << 20,
) -> DataFrame:
    """Drop every line that a document of smaller id holds as well.

    A line's key is the line without ASCII white space at its ends and with
    A-Z lower-cased; only keys of ``min_chars`` code points or more count. The
    documents arrive in batches of rising id: as many as there are
    ``batch_bytes`` of text for each core of the cluster, or ``batches``. Each
    batch reduces its lines to one row a key, looks the keys up in the runs of
    earlier batches by merge joins, drops what is owned by another document and
    adds the rest as a run, if a batch is still to come.

    Returns id, kept_text, n_lines, n_dropped, one row for each input row. A
    null or empty text is one empty line. A null id counts as one document
    behind all others. Equal rows are treated alike; an empty table gives an
    empty result. Other columns are not read, so their names don't matter.
    """
    spark = docs.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    body = docs.select(id_of(id_col).alias("_id"), text_of(text_col).alias("_t"))
    if batches is None:
        held = body.agg(F.sum(F.octet_length("_t").cast("long"))).first()[0] or 0
        batches = max(1, -(-held // (batch_bytes * spark.sparkContext.defaultParallelism)))
    cuts = sorted(set(body.agg(F.percentile_approx("_id", [i / batches for i in range(1, batches)], 10_000)).first()[0] or [])) if batches > 1 else []
    batch = sum((F.when(F.col("_id") > F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0))
    lines, lines_at = save(
        body.select("_id", *text_key(F.col("_t")), F.posexplode(F.split(lower_ascii(F.col("_t")), "\n", -1)).alias("_pos", "_line"))
        .withColumn("_line", F.btrim("_line", F.lit(BLANK)))
        .where(F.char_length("_line") >= min_chars)
        .select("_id", "_t1", "_t2", "_pos", F.xxhash64("_line").alias("_h1"), F.xxhash64(F.lit(1), "_line").alias("_h2"), batch.alias("_batch")),
        "lines", "_batch",
    )
    index = LineIndex(spark, buckets, fan_in)
    drops = []
    last = len(cuts)
    for b in range(last + 1):
        mine = lines.where(F.col("_batch") == b)
        keys = mine.groupBy(*KEY).agg(F.min("_id").alias("_owner"), F.max("_id").alias("_max"), F.count("*").alias("_n"))
        for k, run in enumerate(index.runs()):
            keys = keys.join(run.withColumnRenamed("_owner", f"_o{k}"), KEY, "left")
        earlier = F.coalesce(*[F.col(f"_o{k}") for k in range(len(index.runs()))], F.lit(None).cast("long"))
        verdict, verdict_at = save(keys.select(*KEY, "_owner", "_max", "_n", earlier.alias("_earlier")), "line-verdict")
        shared = verdict.where(F.col("_earlier").isNotNull() | (F.col("_owner") < F.col("_max"))).select(*KEY, F.coalesce("_earlier", "_owner").alias("_keeper"), "_n")
        drops.append(save(dropped_lines(mine, shared, mine.count()), "line-drops")[0])
        if b < last:  # what the last batch would add is never looked up
            index.add(verdict.where("_earlier IS NULL").select(*KEY, "_owner"))
        delete(spark, verdict_at)
    index.clear()
    delete(spark, lines_at)
    dropped = drops[0]
    for d in drops[1:]:
        dropped = dropped.unionByName(d)
    # a document's own lines bound the set
    dropped = dropped.groupBy("_id", "_t1", "_t2").agg(F.collect_set("_pos").alias("_drop"))
    whole = docs.select(F.col(id_col).alias("_out"), id_of(id_col).alias("_id"), text_of(text_col).alias("_t")).select("*", *text_key(F.col("_t")))
    lines_of = F.split("_t", "\n", -1)
    kept = F.expr("array_join(transform(array_except(sequence(0, size(_lines) - 1), _drop), i -> _lines[i]), '\n')")
    return (
        whole.join(dropped, ["_id", "_t1", "_t2"], "left")
        .select("_out", "_t", "_drop", lines_of.alias("_lines"))
        .select(
            F.col("_out").alias(id_col),
            F.when(F.col("_drop").isNull(), F.col("_t")).otherwise(kept).alias("kept_text"),
            F.size("_lines").cast("long").alias("n_lines"),
            F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("n_dropped"),
        )
    )


ORACLE = r"""
WITH l AS (
  SELECT doc_id, i, s[i] AS line,
         translate(trim(s[i], chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents) d, unnest(range(1, len(s) + 1)) AS u(i)),
o AS (SELECT k, min(doc_id) AS owner FROM l WHERE length(k) >= 10 GROUP BY k),
m AS (SELECT l.doc_id, i, line, (owner IS NULL OR owner = l.doc_id) AS kept FROM l LEFT JOIN o ON length(l.k) >= 10 AND o.k = l.k)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE NOT kept) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE kept), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
