"""SimHash near-duplicates with pigeonring filtering."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import delete, drop_bucketed, save, save_bucketed, text_key, text_of, tidy
from .graph import connected_components

#: Words at a time, so that a very long text needs no more memory than this many shingles.
BLOCK = 1 << 16
SEED = 42
SEGMENTS, SEGMENT_BITS = 4, 16
#: Nodes in 16 whose shingles are counted to tell common ones, in so many of them at least, and how many are told; these only order shingles and lose nothing.
SAMPLE_IN, COMMON_IN, COMMON_MOST = 16, 3, 200_000
#: Orders of the hashes (odd multipliers) in each of which a set's least one is kept; a set at first meets the next few in the order of these that agree in so many.
MIXERS = tuple(pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1, 9))
NEXT, AGREE = 2, 5
#: Parts of the hashes' range whose counts bound what two sets can share.
SKETCH = 64
#: Parts that a common shingle's block is dealt to, and how many others a copy of a text is compared with.
PARTS, COMPARED = 4096, 64
#: Pairs a node that blocks give at first, how many times as many they give next, and the share from which on they give all the rest.
AT_FIRST, GROW, ALL_FROM = 4, 16, 0.25
#: A pair's place among these tells when it is compared.
TURNS = 1 << 40


def shingle_hashes(text: bytes | None, words: int) -> Iterator:
    """XXH64 of the text's word shingles, repeats included, a block at a time; a shorter text is one shingle, an empty one has none."""
    import numpy as np
    import xxhash

    tokens = (text or b"").lower().split()  # of bytes: ASCII letters and the six ASCII blanks alone
    if not tokens:
        return
    if len(tokens) < words:
        tokens, words = [b" ".join(tokens)], 1
    for at in range(0, len(tokens) - words + 1, BLOCK):
        part = tokens[at : at + BLOCK + words - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(words))))
        yield np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)


def fingerprint_of(blocks: Iterable) -> int:
    """64 bits as a signed long, each 1 if set in over half the hashes; 0 of none."""
    import numpy as np

    total, n = np.zeros(64, np.int64), 0
    for h in blocks:
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.int64)[0]) if n else 0


def fingerprint(text: bytes | None, words: int = 3) -> int:
    return fingerprint_of(shingle_hashes(text, words))


def distinct(blocks: Iterable):
    import numpy as np

    return np.unique(np.concatenate([np.zeros(0, np.uint64), *blocks]))


def profile(text: bytes | None, words: int) -> tuple[int, int, int, list[int], list[int]]:
    """The fingerprint, a hash of the set of shingles, that set's size, its least shingles in each of a few orders, and how many lie in each part of the range."""
    import numpy as np
    import xxhash

    blocks = list(shingle_hashes(text, words))
    own = distinct(blocks)
    least = [int((own * np.uint64(m)).min().view(np.int64)) for m in MIXERS] if len(own) else []
    sketch = np.bincount((own & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH).tolist()
    return fingerprint_of(blocks), int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), SEED)).view(np.int64)), len(own), least, sketch


def prefix(text: bytes | None, words: int, similarity: float, common: tuple) -> tuple:
    """The first shingles of a set in an order that all texts share, rare ones first, and which of them are known as common.

    Similar sets of n and m shingles share ``similarity`` * n at least, so not
    all shared ones are behind the first n - ceil(similarity * n) + 1: sets of
    this similarity have one of these in common. ``common`` is sorted hashes of
    common shingles and how often they were seen.
    """
    import numpy as np

    own, (known, seen) = distinct(shingle_hashes(text, words)), common
    if not len(own):
        return own.view(np.int64), np.zeros(0, bool)
    at = np.minimum(np.searchsorted(known, own), max(len(known) - 1, 0))
    often = np.where(known[at] == own, seen[at], 0) if len(known) else np.zeros(len(own), np.int64)
    most = len(own) - int(np.ceil(similarity * len(own) - 1e-6)) + 1
    first = np.lexsort((own, often))[:most]
    return own[first].view(np.int64), often[first] > 0


def gathered(parts: Iterable, columns: int) -> Iterator:
    """Lists of column arrays joined to fewer of some ``BLOCK`` rows."""
    import numpy as np
    import pyarrow as pa

    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= BLOCK:
            yield [pa.array(np.concatenate([h[c] for h in held])) for c in range(columns)]
            held, n = [], 0
    if held:
        yield [pa.array(np.concatenate([h[c] for h in held])) for c in range(columns)]


def similarity_of(x, y) -> float:
    """Jaccard similarity of two sorted sets; empty sets are alike."""
    import numpy as np

    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp) for each row; a null text counts as empty, whose fingerprint is 0."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = [fingerprint(x.as_py(), words) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["_out", "fp"])

    return docs.select(F.col(id_col).alias("_out"), F.col(text_col).cast("string").cast("binary").alias("_t")).mapInArrow(run, f"_out {kind}, fp bigint")


def profiles(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, text key, fp, node, n, least, sketch) for each row; see ``profile``."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = [profile(x.as_py(), words) for x in batch.column(3)]
            made = [pa.array([f[k] for f in found], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made, pa.array([f[3] for f in found], pa.list_(pa.int64())), pa.array([f[4] for f in found], pa.list_(pa.int32()))], names=["_out", "_t1", "_t2", "fp", "node", "n", "least", "sketch"])

    text = text_of(text_col)
    told = docs.select(F.col(id_col).alias("_out"), *text_key(text), text.cast("binary").alias("_t"))
    return told.mapInArrow(run, f"_out {kind}, _t1 bigint, _t2 bigint, fp bigint, node bigint, n bigint, least array<bigint>, sketch array<int>")


def segment(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, SEGMENT_BITS * (i % SEGMENTS)).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))


def _filed(fps: DataFrame) -> DataFrame:
    """Each fingerprint under each start of a chain: its segment there and the next one make a key of 32 bits.

    Spark takes such rows to be as small as the file they come from, so joins
    with them ask to be merged: a broadcast would hold all of them in the driver.
    """
    keys = [F.struct(F.lit(i).alias("i"), F.shiftleft(segment(F.col("fp"), i), SEGMENT_BITS).bitwiseOR(segment(F.col("fp"), i + 1)).alias("k")) for i in range(SEGMENTS)]
    return fps.select("*", F.inline(F.array(*keys)))


def near_first(fps: DataFrame, within: int = 3) -> DataFrame:
    """Links (a, b) of fingerprints to the first of those with the same key: at most four each, which join dense groups."""
    filed = _filed(fps.select("fp"))
    first = filed.groupBy("i", "k").agg(F.min("fp").alias("a"))
    return filed.join(first.hint("merge"), ["i", "k"]).where(F.col("a") != F.col("fp")).where(F.bit_count(F.col("a").bitwiseXOR(F.col("fp"))) <= within).select("a", F.col("fp").alias("b")).distinct()


def links(fps: DataFrame, within: int = 3) -> DataFrame:
    """Pairs (a, b), a < b, of fingerprints of different roots that differ in at most ``within`` = 3 bits. ``fps`` is (fp, root).

    Pigeonring: lay the four 16-bit segments in a ring. If all four differ in 3
    bits at most, some segment starts a chain whose first l segments differ in
    at most l * 3/4 bits for each l: 0, 1, 2 and 3. So each fingerprint is filed
    under each start with its next segment as it is (length 1 and 2 of the
    chain), and looked up with that segment and its 16 one-bit changes; length
    3 of the chain is then tested before the whole distance. The keys have 32
    bits, so the candidates stay few however many fingerprints there are; a key
    that only the asking root holds is not entered.
    """
    if within != 3:
        raise ValueError("the chain budgets are those of 3 bits")
    filed = _filed(fps.select("fp", "root"))
    changes = F.array(F.lit(0).cast("long"), *[F.lit(1 << k).cast("long") for k in range(SEGMENT_BITS)])
    asked = filed.select(F.col("fp").alias("b"), F.col("root").alias("root_b"), "i", F.explode(F.transform(changes, lambda m: F.col("k").bitwiseXOR(m))).alias("k"))
    held = filed.groupBy("i", "k").agg(F.min("root").alias("_least"), F.max("root").alias("_most"))
    asked = asked.join(held.hint("merge"), ["i", "k"]).where("_least <> root_b OR _most <> root_b").drop("_least", "_most")
    a, b = F.col("a"), F.col("b")
    diff = a.bitwiseXOR(b)
    turn = F.expr("((i + 2) % 4) * 16")
    third = F.bit_count(F.call_function("shiftrightunsigned", diff, turn).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1)))
    second = F.bit_count(F.call_function("shiftrightunsigned", diff, F.expr("((i + 1) % 4) * 16")).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1)))
    met = asked.join(filed.withColumnRenamed("fp", "a").hint("merge"), ["i", "k"]).where("a < b AND root <> root_b").where(second + third <= 2).where(F.bit_count(diff) <= within)
    return met.select("a", "b").distinct()


def rooted(nodes: DataFrame, roots: DataFrame, node: str) -> DataFrame:
    """``nodes`` with ``root``, the node itself where no link has joined it."""
    return nodes.join(roots.withColumnRenamed("node", node), node, "left").withColumn("root", F.coalesce("root", node))


def stars(roots: DataFrame) -> DataFrame:
    """(node, root) as links, which are contracted in fewer rounds than those they came from."""
    return roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))


def common_shingles(texts: DataFrame, words: int) -> tuple:
    """Sorted hashes of shingles that many of a sample of ``texts`` (node, t) hold, and how many."""
    import numpy as np

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for held in gathered(([distinct(shingle_hashes(x.as_py(), words)).view(np.int64)] for x in batch.column(1)), 1):
                yield pa.RecordBatch.from_arrays(held, names=["h"])

    some = texts.where(F.pmod(F.xxhash64(F.lit(SEED), "node"), F.lit(SAMPLE_IN)) == 0).select("node", "_t").mapInArrow(run, "h bigint")
    most = some.groupBy("h").count().where(F.col("count") >= COMMON_IN).orderBy(F.desc("count"), "h").limit(COMMON_MOST).toArrow()
    known, seen = (most.column(k).to_numpy() for k in (0, 1))
    order = np.argsort(known.view(np.uint64))
    return known.view(np.uint64)[order], seen[order]


def blocks(texts: DataFrame, words: int, similarity: float) -> tuple[DataFrame, str]:
    """(k, node, root, n, i) and where it is written: nodes filed by the shingles of their prefix, i being a shingle's place; see ``prefix``.

    Blocks whose members have one root are left out. Those of rare shingles are
    told by a window over their members; a common shingle's block may hold a
    large part of all nodes, so its members are dealt to parts and its roots are
    summed up before they are shuffled. ``texts`` is (node, root, n, t).
    """
    shared = texts.sparkSession.sparkContext.broadcast(common_shingles(texts, words))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def file(batch):
            nodes, roots, sizes = (np.asarray(batch.column(c)) for c in range(3))
            for r, x in enumerate(batch.column(3)):
                keys, common = prefix(x.as_py(), words, similarity, shared.value)
                m = len(keys)
                # the size and the place are packed, for every shingle of a prefix is moved
                yield [keys, np.full(m, nodes[r]), np.full(m, roots[r]), (int(sizes[r]) << 32) + np.arange(m), common]

        for batch in batches:
            for held in gathered(file(batch), 5):
                yield pa.RecordBatch.from_arrays(held, names=["k", "node", "root", "place", "common"])

    filed = texts.select("node", "root", "n", "_t").mapInArrow(run, "k bigint, node bigint, root bigint, place bigint, common boolean")
    of = Window.partitionBy("k", "_part")
    dealt = filed.withColumn("_part", F.when(F.col("common"), F.pmod("node", F.lit(PARTS)).cast("int")))
    ends = dealt.select("*", F.min("root").over(of).alias("_least"), F.max("root").over(of).alias("_most"))
    met, met_at = save(ends.where("common OR _least <> _most").drop("_least", "_most", "_part"), "met")
    tidy(texts.sparkSession)
    mixed = met.groupBy("k").agg(F.min("root").alias("_least"), F.max("root").alias("_most")).where("_least <> _most").select("k")
    out = save(met.join(mixed, "k").select("k", "node", "root", F.shiftright("place", 32).alias("n"), F.col("place").bitwiseAND(F.lit((1 << 32) - 1)).alias("i")), "blocks")
    delete(texts.sparkSession, met_at)
    return out


def may_be_alike(similarity: float) -> Column:
    """Whether two nodes that meet in a block may have this similarity.

    If the block's shingle is the first that they share, they share no more
    than what either has from there on; a similar pair passes in that block.
    """
    return F.least(F.col("n") - F.col("i"), F.col("n_b") - F.col("i_b")) * (1 + similarity) >= (F.col("n") + F.col("n_b")) * F.lit(similarity) - 1e-6


def shares(filed: DataFrame) -> list[float]:
    """Growing shares of the pairs in blocks, up to all of them: a few for each node at first."""
    met, nodes = filed.groupBy("k").agg(F.count("*").cast("double").alias("m")).agg(F.sum(F.col("m") * (F.col("m") - 1) / 2)).first()[0], filed.agg(F.approx_count_distinct("node")).first()[0]
    share, out = AT_FIRST * nodes / max(met or 0, 1), []
    while share < ALL_FROM:
        out.append(share)
        share *= GROW
    return [*out, 1.0]


def block_pairs(filed: DataFrame, similarity: float, after: float = 0.0, upto: float = 1.0) -> DataFrame:
    """Pairs (a, b) of nodes that meet in a block, may be alike and have different roots: those with a place in this part of all. ``filed`` is (k, node, root, n, i)."""
    of = Window.partitionBy("k")
    mixed = filed.select("*", F.min("root").over(of).alias("_least"), F.max("root").over(of).alias("_most")).where("_least <> _most").drop("_least", "_most")
    other = mixed.select("k", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("i").alias("i_b"), F.col("root").alias("root_b"))
    met = mixed.join(other, "k").where("root < root_b").where(may_be_alike(similarity))
    if (after, upto) != (0.0, 1.0):
        place = F.pmod(F.xxhash64(F.least("node", "b"), F.greatest("node", "b")), F.lit(TURNS))
        met = met.where((place >= int(after * TURNS)) & (place < int(upto * TURNS)))
    return met.select(F.col("node").alias("a"), "b").distinct()


def alike(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts have this similarity, compared shingle by shingle. ``texts`` is (node, t).

    A text that many others are compared with is read in a place for each
    ``COMPARED`` of these, and once there: its row stands before those of the
    others.
    """
    spark = texts.sparkSession
    places = F.ceil(F.count("*").over(Window.partitionBy("a")) / COMPARED)
    met, met_at = save(pairs.withColumn("_part", F.pmod(F.xxhash64("b"), places)), "asked")
    held = texts.select("node", "_t")
    heads = met.select("a", "_part").distinct().join(held.withColumnRenamed("node", "a"), "a").select("a", "_part", F.lit(None).cast("bigint").alias("b"), "_t")
    others = met.join(held.withColumnRenamed("node", "b"), "b").select("a", "_part", "b", "_t")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        head, own = None, None
        for batch in batches:
            out = [], []
            for a, b, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                found = distinct(shingle_hashes(text.as_py(), words))
                if b is None:
                    head, own = a, found
                elif head != a:
                    raise ValueError("a text has no row of its own")
                elif similarity_of(own, found) >= similarity:
                    out[0].append(a), out[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["a", "b"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    together = heads.unionByName(others).repartition(parts, "a", "_part").sortWithinPartitions("a", "_part", F.col("b").asc_nulls_first())
    out, _ = save(together.select("a", "b", "_t").mapInArrow(run, "a bigint, b bigint"), "alike")
    delete(spark, met_at)
    return out


def bounded(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that may have this similarity: in no part of the hashes' range can two sets share more than the smaller count there."""
    held = nodes.select("node", "n", "sketch")
    one, two = (held.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("sketch").alias(f"s_{k}")) for k in "ab")
    most = F.aggregate(F.zip_with("s_a", "s_b", lambda x, y: F.least(x, y)), F.lit(0), lambda total, x: total + x)
    return pairs.join(one, "a").join(two, "b").where(most * (1 + similarity) >= (F.col("n_a") + F.col("n_b")) * F.lit(similarity) - 1e-6).select("a", "b")


def first_pairs(nodes: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of nodes with the first one of those of the same fingerprint keys, and with neighbours; a few a node.

    For each order, nodes with the same two least shingles are sorted by all of
    theirs, so that neighbours agree in most; a node meets the ``NEXT`` ones
    before it that agree in ``AGREE`` or more.
    """
    turned = F.transform(F.sequence(F.lit(0), F.lit(len(MIXERS) - 1)), lambda i: F.concat(F.slice("least", i + 1, len(MIXERS)), F.slice("least", F.lit(1), i)))
    filed = nodes.select("node", "n", F.posexplode(turned).alias("i", "v"))
    order = Window.partitionBy("i", F.col("v")[0], F.col("v")[1]).orderBy("v", "node")
    here = filed.select("node", "n", "v", *[F.lag(F.struct("node", "n", "v"), j).over(order).alias(f"_p{j}") for j in range(1, NEXT + 1)])
    met = here.select("node", "n", "v", F.explode(F.array(*[f"_p{j}" for j in range(1, NEXT + 1)])).alias("_f")).where("_f IS NOT NULL")
    agree = F.size(F.filter(F.zip_with("v", "_f.v", lambda x, y: x == y), lambda same: same)) >= AGREE
    size = F.least("n", "_f.n") >= F.lit(similarity) * F.greatest("n", "_f.n")
    met = met.where(size).where(agree).select(F.least("_f.node", "node").alias("a"), F.greatest("_f.node", "node").alias("b"))
    by_fp = nodes.groupBy("fp").agg(F.min("node").alias("node"))
    near = near_first(by_fp).join(by_fp.withColumnRenamed("fp", "a").withColumnRenamed("node", "_a"), "a").join(by_fp.withColumnRenamed("fp", "b").withColumnRenamed("node", "_b"), "b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
    return met.unionByName(near).distinct()


def similar_roots(nodes: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """(node, root) of the nodes that links of this similarity join. ``nodes`` is (node, n, fp, least, sketch), ``texts`` (node, n, t).

    At first each node meets a few: the first one of those with its fingerprint's
    segments (by the pigeonring's keys), and neighbours in the orders of least
    shingles, which joins large groups of near copies. Then nodes of different
    roots that share a shingle of their prefixes meet, in growing shares of such
    pairs until all have had their turn: links found in a share join most
    members of a dense group, and pairs that these have joined need not meet any
    more. So no link between different roots is left out. Pairs that the sketches rule out are dropped before texts are
    moved; every other pair is compared exactly.
    """
    spark = texts.sparkSession
    roots, _ = save(connected_components(alike(first_pairs(nodes, similarity), texts, words, similarity)), "roots")
    tidy(spark)
    filed, filed_at = blocks(rooted(texts, roots, "node"), words, similarity)
    after = 0.0
    for upto in shares(filed):
        pairs, pairs_at = save(bounded(block_pairs(filed, similarity, after, upto), nodes, similarity), "pairs")
        tidy(spark)
        more = alike(pairs, texts, words, similarity)
        delete(spark, pairs_at)
        if not more.isEmpty():
            roots, _ = save(connected_components(stars(roots).unionByName(more)), "roots")
            if upto < 1:
                now = roots.select(F.col("node").alias("root"), F.col("root").alias("_now"))
                again, again_at = save(filed.join(now, "root", "left").select("k", "node", F.coalesce("_now", "root").alias("root"), "n", "i"), "blocks")
                delete(spark, filed_at)
                filed, filed_at = again, again_at
        tidy(spark)
        after = upto
    delete(spark, filed_at)
    return roots


def similar_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """Each row's fingerprint and component: what is reachable by links of texts of this similarity or more.

    Similarity is that of Jaccard over the sets of shingles of ``words`` words,
    taken as in ``near_duplicates``; texts without words are alike. Equal sets
    are one node before any link is sought (told by 64-bit hashes, as shingles
    are), so groups of copies cost one row. Candidates are all pairs that share
    a shingle of their prefixes and that no links join yet; each is compared
    exactly, so all links hold and none is missed. Returns id, fp long and
    component_id, the smallest id reachable (null if no row of the component
    has an id), one row for each input row; a null text counts as empty, equal
    rows are treated alike, an empty table gives no rows. Other columns are not
    read.
    """
    spark = docs.sparkSession
    each, each_at = save(profiles(docs, id_col, text_col, words).withColumnRenamed("node", "set"), "profiles")
    # a node goes by the key of the text that stands for it, so texts meet their nodes, and later roots, where they are
    first = F.min(F.struct("_t1", "_t2", "n", "fp", "least", "sketch")).alias("_f")
    nodes, nodes_at = save(each.groupBy("set").agg(F.min("_out").alias("_least"), first).select("set", "_least", F.col("_f._t1").alias("node"), "_f.n", "_f.fp", "_f.least", "_f.sketch"), "nodes")
    some = nodes.where("n > 0")
    text = text_of(text_col)
    key, _ = text_key(text)
    # copies are dropped before texts are shuffled, which they are once
    texts = docs.select(key.alias("node"), text.cast("binary").alias("_t")).groupBy("node").agg(F.first("_t").alias("_t")).join(some.select("node", "n"), "node")
    held, held_name, held_at = save_bucketed(texts, "node-texts", "node", int(spark.conf.get("spark.sql.shuffle.partitions")))
    tidy(spark)
    roots = similar_roots(some.select("node", "n", "fp", "least", "sketch"), held, words, similarity)
    drop_bucketed(spark, held_name, held_at)
    joined, _ = save(rooted(nodes.select("set", "node", "_least"), roots, "node"), "named")
    delete(spark, nodes_at)
    least = joined.groupBy("root").agg(F.min("_least").alias("component_id"))
    named = joined.join(least, "root").select("set", "component_id")
    out, _ = save(each.select("_out", "fp", "set").join(named, "set").select(F.col("_out").alias(id_col), "fp", "component_id"), "similar")
    delete(spark, each_at)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """Each row's fingerprint and component: what is reachable by links of at most 3 differing bits.

    A-Z are lower-cased, words are split at ASCII blanks and their shingles of
    ``words`` words, repeats included, are hashed; a shorter text is one
    shingle, a null or empty one has fingerprint 0 and links like any other.
    Equal fingerprints are one class before any link is sought, so groups of
    copies cost one row. Fingerprints first link to representatives of theirs;
    then all pairs of those still apart that lie within 3 bits are sought, so a
    dense group has about as many links as members and none is missed. Returns
    id, fp long and component_id, the smallest id reachable (null if no row of
    the component has an id), one row for each input row; equal rows are treated
    alike and an empty table gives no rows. Other columns are not read.
    """
    each, _ = save(fingerprints(docs, id_col, text_col, words), "fingerprints")
    classes, classes_at = save(each.groupBy("fp").agg(F.min("_out").alias("_least")), "classes")
    roots, _ = save(connected_components(near_first(classes)), "roots")
    apart, apart_at = save(rooted(classes, roots, "fp"), "rooted")
    pairs, pairs_at = save(links(apart), "pairs")
    if not pairs.isEmpty():
        roots, _ = save(connected_components(stars(roots).unionByName(pairs)), "roots")
        apart = rooted(classes, roots, "fp")
    named, _ = save(apart.join(apart.groupBy("root").agg(F.min("_least").alias("component_id")), "root").select("fp", "component_id"), "components")
    for at in (classes_at, apart_at, pairs_at):
        delete(docs.sparkSession, at)
    return each.join(named, "fp").select(F.col("_out").alias(id_col), "fp", "component_id")
