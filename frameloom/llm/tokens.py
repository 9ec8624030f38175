"""Token ids in training order: a keyed permutation gives each sequence its slot in fixed-stride shards."""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LAST_ID, id_of, new_path, save

#: Bytes of text that a worker gets and tokenises at a time (one longer text is taken alone); its memory grows with them.
SLICE_BYTES = 4 << 20
#: A blank behind a space, or a space at the end: there, words can't be tokenised apart.
_RUNS = r"\x20(?:[\s\x0b\x1c-\x1f\x{85}\p{Z}]|$)"
HEADER = 16
#: Folder beside the shards that tells how many records there are and how they are dealt.
INDEX = "_index"


class Tokenizer:
    """Byte-level BPE ids. Each distinct word of a slice of texts is encoded once.

    The byte-level pattern never joins what stands before " x" to it, x not
    being a blank, so a text's ids are those of its first word and of " " + each
    further word. Texts with a blank behind a space are encoded as a whole.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import numpy as np
        import tiktoken

        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.bytes_of[i] = len(token)

    def encode(self, text: str):
        import numpy as np

        return self.encoding.encode_to_numpy(text, disallowed_special=()).astype(np.uint16)  # a buffer: a list takes ten times as much

    def slice(self, texts):
        """The ids of an Arrow array of texts: one array of 16-bit numbers each."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        whole = pc.match_substring_regex(texts, _RUNS).to_numpy(zero_copy_only=False)
        out = [None] * len(texts)
        for i in np.flatnonzero(whole):
            out[i] = self.encode(texts[i].as_py())
        rest = np.flatnonzero(~whole)
        if len(rest) == 0:
            return out
        parts = pc.split_pattern(texts.take(rest), " ")
        first = np.asarray(parts.offsets)[:-1]
        words = parts.flatten().dictionary_encode()
        at = words.indices.to_numpy().astype(np.int64)
        lengths = pc.binary_length(words.dictionary).to_numpy().astype(np.int64)
        listed = pa.ListArray.from_arrays(pa.array([0, len(lengths)], pa.int32()), words.dictionary)
        ids = self.encode(" " + pc.binary_join(listed, " ")[0].as_py())
        stops = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum(lengths + 1)) + 1
        heads = [self.encode(words.dictionary[int(at[k])].as_py()) for k in first]
        counts = np.concatenate([np.diff(stops, prepend=0), [len(h) for h in heads]])
        ids = np.concatenate([ids, *heads])
        begin = np.cumsum(counts) - counts
        at[first] = len(lengths) + np.arange(len(first))
        n = counts[at]
        ends = np.cumsum(n)
        place = np.arange(ends[-1], dtype=np.int32)
        place += np.repeat((begin[at] - (ends - n)).astype(np.int32), n)
        flat = ids[place]
        for i, piece in zip(rest, np.split(flat, ends[first[1:] - 1])):
            out[i] = piece
        return out

    def texts(self, column):
        """All texts of an Arrow array, slice by slice."""
        import numpy as np
        import pyarrow.compute as pc

        column = pc.fill_null(column, "")
        upto = np.cumsum(pc.binary_length(column).to_numpy().astype(np.int64))
        start = 0
        while start < len(column):
            stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + SLICE_BYTES, "right")))
            yield from self.slice(column.slice(start, stop - start).combine_chunks() if hasattr(column, "combine_chunks") else column.slice(start, stop - start))
            start = stop


def feistel(index: Column, half_bits: int, key: int, rounds: int = 4) -> Column:
    """One pass of a balanced Feistel network over numbers of 2 * half_bits bits."""
    mask = F.lit((1 << half_bits) - 1)
    left, right = F.shiftright(index, half_bits), index.bitwiseAND(mask)
    for r in range(rounds):
        left, right = right, left.bitwiseXOR(F.xxhash64(F.lit(key), F.lit(r), right).bitwiseAND(mask))
    return F.shiftleft(left, half_bits).bitwiseOR(right)


def permute(df: DataFrame, index: str, n: int, key: int, out: str) -> DataFrame:
    """Adds ``out``: the index under a keyed permutation of 0 to n - 1.

    The network permutes the least even power of two that holds n; a value out
    of range walks its cycle until it is in range again, which keeps the map one
    to one. Under four values stand for each one in range, so 96 steps leave a
    row unfinished with a chance of 10^-12; the check that follows fails the
    job rather than write such a row.
    """
    half = 1
    while 1 << (2 * half) < n:
        half += 1
    walk = F.aggregate(
        F.sequence(F.lit(1), F.lit(96)), feistel(F.col(index), half, key),
        lambda at, _: F.when(at < n, at).otherwise(feistel(at, half, key)))
    return df.withColumn(out, walk).withColumn(out, F.when(F.col(out) < n, F.col(out)).otherwise(F.raise_error(F.lit("cycle not closed")).cast("long")))


def ranks_of(spark: SparkSession, path: str) -> dict[bytes, int]:
    """A vocabulary's tokens and their ids, from any file system that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    data = spark._jvm.org.apache.commons.io.IOUtils.toByteArray(at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, bytes(data).splitlines())}
    if max(ranks.values()) >= 1 << 16:
        raise ValueError("ids of 16 bits are written")
    return ranks


@contextmanager
def small_batches(spark: SparkSession):
    """Jobs run in here hand their workers batches of about SLICE_BYTES: Spark's own of 64 MB are held by the executor and by the worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, given = spark.conf.get(key), spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    spark.conf.set(key, str(given if 0 < given < SLICE_BYTES else SLICE_BYTES))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _body(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(id_of(id_col).alias("_id"), F.col(text_col).cast("string").alias("_t"))


def counts(docs: DataFrame, shared, pattern: str, length: int, id_col: str, text_col: str) -> DataFrame:
    """(part, first, n): how many sequences each input partition has, and the first id in it."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        tokenizer, first, n = Tokenizer(shared.value, pattern), None, 0
        for batch in batches:
            if first is None and len(batch):
                first = batch.column(0)[0].as_py()
            n += sum(-(-len(ids) // length) for ids in tokenizer.texts(batch.column(1)))
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([first], pa.int64()), pa.array([n], pa.int64())], names=["part", "first", "n"])

    return _body(docs, id_col, text_col).mapInArrow(run, "part int, first bigint, n bigint")


def records(docs: DataFrame, shared, starts, pattern: str, length: int, pad: int, id_col: str, text_col: str) -> DataFrame:
    """(index, value): each text's tokens cut into records of ``length`` 16-bit ids, the last one padded.

    A record starts with its row's id, the sequence's number in its text and how
    many ids aren't padding (8, 4 and 4 bytes, little-endian). The index counts
    all records from 0, without a gap; ``starts`` has that of each partition's
    first one and how many it has.
    """
    width = 2 * length
    fill = pad.to_bytes(2, "little") * length

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        tokenizer = Tokenizer(shared.value, pattern)
        at, n = starts.value.get(TaskContext.get().partitionId(), (0, 0))
        end = at + n
        for batch in batches:
            value = []
            for row, ids in zip(batch.column(0).to_pylist(), tokenizer.texts(batch.column(1))):
                data = ids.tobytes()
                for k in range(0, len(data), width):
                    piece = data[k : k + width]
                    value.append(struct.pack("<qii", row, k // width, len(piece) // 2) + piece + fill[len(piece) :])
                if len(value) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(range(at, at + len(value)), pa.int64()), pa.array(value, pa.binary())], names=["index", "value"])
                    at, value = at + len(value), []
            yield pa.RecordBatch.from_arrays([pa.array(range(at, at + len(value)), pa.int64()), pa.array(value, pa.binary())], names=["index", "value"])
            at += len(value)
        if at != end:
            raise ValueError("the partition differs from the one whose sequences were counted")

    return _body(docs, id_col, text_col).mapInArrow(run, "index bigint, value binary")


def write_training_order(
    docs: DataFrame, ranks_path: str, pattern: str, path: str | None = None, length: int = 128, pad: int = 50256, key: int = 97, shard_bytes: int = 24 << 20,
    id_col: str = "doc_id", text_col: str = "text",
) -> str:
    """Writes every sequence to its place in the training order and returns the folder.

    Texts are tokenised whole and cut into sequences of ``length`` ids, the last
    one padded with ``pad``. A first pass counts them, so that all N have an
    index from 0 to N - 1: input partitions in order of their first id, rows in
    order of their place there, so in a table that is stored by id the order is
    that of (id, part) however its files are split. A keyed Feistel permutation
    of 0 to N - 1 with cycle-walking gives each its global slot. Ranges of slots
    are the shards, one file each in the folder ``shard=s``, written in slot
    order by one task: records of ``16 + 2 * length`` bytes and one line feed.
    So slot g is record ``g % per_shard`` of shard ``g // per_shard``, a reader
    resumes anywhere by seeking to that many strides, and a record tells its
    row. ``_index`` holds N, per_shard, the stride and the key.

    Sequences are moved once, straight to their shard's task. Texts are
    tokenised twice: to keep the ids between the passes would take as much disk
    as the texts. Only one number for each input partition reaches the driver.

    ``docs`` is a table read from files, whose partitions a lost task reads
    again alike. A null or empty text has no sequence; repeated rows have
    sequences of their own; a null id is written as the largest long; an empty
    table writes no shard. Other columns are not read.
    """
    if pad >= 1 << 16:
        raise ValueError("ids of 16 bits are written")
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    shared = spark.sparkContext.broadcast(ranks_of(spark, ranks_path))  # a vocabulary of some 50,000 entries
    with small_batches(spark):
        told, _ = save(counts(docs, shared, pattern, length, id_col, text_col), "token-counts")
    starts, n = {}, 0
    for r in told.orderBy("first", "part").collect():  # a row for each input partition, which the driver schedules anyway
        starts[r["part"]], n = (n, r["n"]), n + r["n"]
    stride = HEADER + 2 * length + 1
    per_shard = max(1, shard_bytes // stride)
    shards = max(1, -(-n // per_shard))
    with small_batches(spark):
        made = records(docs, shared, spark.sparkContext.broadcast(starts), pattern, length, pad, id_col, text_col)
        placed = permute(made, "index", max(n, 1), key, "slot").withColumn("shard", F.expr(f"slot div {per_shard}"))
        # the cast keeps the bytes as they are; the text sink writes them and a line feed
        (
            placed.select("shard", "slot", F.col("value").cast("string").alias("value"))
            .repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "slot")
            .select("value", "shard").write.partitionBy("shard").text(path)
        )
    index = spark.createDataFrame([(n, per_shard, shards if n else 0, stride, length, key)], "records long, per_shard long, shards long, stride int, length int, key long")
    index.coalesce(1).write.json(f"{path}/{INDEX}")
    return path


def index_of(spark: SparkSession, path: str):
    """How a written order is laid out: records, per_shard, shards, stride, length and key."""
    return spark.read.schema("records long, per_shard long, shards long, stride int, length int, key long").json(f"{path}/{INDEX}").first()


def read_shards(spark: SparkSession, path: str, length: int = 128) -> DataFrame:
    """(shard, record, id, part, n_tokens, ids) of written shards; ids are 16-bit little-endian numbers.

    A shard is cut into its records by their stride, without a copy of the whole
    for each; a shard that ends within a record is an error.
    """
    stride = HEADER + 2 * length + 1

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        kind = np.dtype([("id", "<i8"), ("part", "<i4"), ("n", "<i4"), ("ids", f"V{2 * length}"), ("end", "u1")])
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = content.as_buffer()
                if len(data) % stride:
                    raise ValueError(f"shard {shard} ends within a record")
                rows = np.frombuffer(data, kind)
                for at in range(0, len(rows), 8192):
                    part = rows[at : at + 8192]
                    ids = np.ascontiguousarray(part["ids"]).tobytes()
                    yield pa.RecordBatch.from_arrays([
                        pa.array([shard] * len(part), pa.int64()), pa.array(np.arange(at, at + len(part))), pa.array(np.ascontiguousarray(part["id"])), pa.array(np.ascontiguousarray(part["part"])),
                        pa.array(np.ascontiguousarray(part["n"])), pa.array([ids[k : k + 2 * length] for k in range(0, len(ids), 2 * length)], pa.binary())],
                        names=["shard", "record", "id", "part", "n_tokens", "ids"])

    files = spark.read.format("binaryFile").load(path).select(F.col("shard").cast("long").alias("shard"), "content")
    return files.mapInArrow(run, "shard long, record long, id long, part int, n_tokens int, ids binary")


def digest(docs: DataFrame, ranks_path: str, pattern: str, length: int = 128) -> DataFrame:
    """What the written shards hold, a row for each record with its global slot."""
    spark = docs.sparkSession
    path = write_training_order(docs, ranks_path, pattern, length=length)
    index = index_of(spark, path)
    schema = "shard long, record long, id long, part int, n_tokens int, ids binary"
    rows = read_shards(spark, path, length) if index["records"] else spark.createDataFrame([], schema)
    return rows.select(
        F.when(F.col("id") != LAST_ID, F.col("id")).alias("doc_id"), "part", "n_tokens", (F.col("shard") * index["per_shard"] + F.col("record")).alias("slot"), "shard", "record",
        (F.col("record") * index["stride"]).alias("start_byte"), F.crc32("ids").alias("ids_crc32"))
