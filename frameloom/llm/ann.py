"""Approximate nearest neighbours: a hierarchical k-means tree with best-bin-first search."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save

#: Bound of the sample that the tree is fitted on, in vectors, and of the queries that the visits are calibrated on.
SAMPLE_VECTORS, CALIBRATION_QUERIES = 20_000, 64
#: Rows of one block, and queries that a task scores on it.
BLOCK_ROWS, BLOCK_QUERIES = 8_192, 4_096


@dataclass
class Node:
    """A node's children with their centres; a leaf has a number."""

    centres: np.ndarray | None = None
    children: list["Node"] = field(default_factory=list)
    leaf: int = -1


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, steps: int = 8) -> np.ndarray:
    """Lloyd's steps from k distinct rows; a centre without rows stays."""
    distinct = np.unique(x, axis=0)
    c = distinct[rng.permutation(len(distinct))[: min(k, len(distinct))]].copy()
    for _ in range(steps):
        near = np.argmin((c * c).sum(1) - 2 * x @ c.T, axis=1)
        for j in range(len(c)):
            if (near == j).any():
                c[j] = x[near == j].mean(axis=0)
    return c


class Tree:
    """A k-means tree over augmented vectors.

    The largest inner product becomes the least distance when each vector gets
    one more component that lifts it to the largest norm; queries get 0 there.
    """

    def __init__(self, sample: np.ndarray, leaves: int, branch: int, seed: int, norm: float):
        self.norm, self.leaves = norm, 0
        rng = np.random.default_rng(seed)
        self.root = self._grow(self.lift(sample), max(1, leaves), branch, rng)

    def lift(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.norm**2 - (x * x).sum(axis=1), 0))
        return np.c_[x, rest]

    def _grow(self, x: np.ndarray, leaves: int, branch: int, rng: np.random.Generator) -> Node:
        c = kmeans(x, min(branch, leaves), rng) if leaves > 1 and len(x) > 1 else None
        if c is None or len(c) < 2:
            self.leaves += 1
            return Node(leaf=self.leaves - 1)
        near = np.argmin((c * c).sum(1) - 2 * x @ c.T, axis=1)
        node = Node(c)
        for j in range(len(c)):
            node.children.append(self._grow(x[near == j], -(-leaves // len(c)), branch, rng))
        return node

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        out, x = np.zeros(len(x), np.int64), self.lift(x)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node.centres is None:
                out[rows] = node.leaf
                continue
            near = np.argmin((node.centres**2).sum(1) - 2 * x[rows] @ node.centres.T, axis=1)
            todo += [(child, rows[near == j]) for j, child in enumerate(node.children) if (near == j).any()]
        return out

    def visits(self, q: np.ndarray, most: int) -> list[int]:
        """The first ``most`` leaves for a query, best bin first: a queue holds all branches not taken, nearest first."""
        q = np.append(q, 0.0)
        queue, tie, out = [(0.0, 0, self.root)], 1, []
        while queue and len(out) < most:
            _, _, node = heapq.heappop(queue)
            if node.centres is None:
                out.append(node.leaf)
                continue
            for d, child in zip(((node.centres - q) ** 2).sum(axis=1), node.children):
                heapq.heappush(queue, (float(d), tie, child))
                tie += 1
        return out


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the vectors that take part: not null, of finite components, not zero; -0.0 counts as 0.0."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double") + F.lit(0.0))
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.coalesce(ok, F.lit(False)))


def dot(a: Column, b: Column) -> Column:
    """The inner product in double precision, summed in the order of the components."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def search(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = 20, recall: float = 0.95,
    leaf_rows: int = 64, branch: int = 16, max_leaves: int = 1 << 14, seed: int = 11,
) -> DataFrame:
    """The k nearest rows by inner product to each row whose id is divisible by ``every``.

    Equal vectors are one class with its k + 1 smallest ids, which is all that
    any answer can need, so a common vector is a single candidate. A tree
    fitted on a bounded sample deals every class to a leaf. A query walks the
    tree best bin first; how many leaves it visits is widened, on a bounded set
    of queries compared with all classes, until the mean recall of that set is
    at least ``recall``. Leaves are laid into blocks of bounded rows, a block
    meets the queries that visit one of its leaves, in parts of bounded queries,
    scores them on those leaves alone and gives each its best; a query keeps its
    best candidates of all blocks, whose products are summed anew in a fixed order.

    Returns query_id, rank from 1, vec_id, score (the inner product of the
    original vectors in double precision), nearest first, ties to the smaller
    id; all candidates if there are fewer than k. Rows with a null id, or a
    vector that is null, zero, or holds a null or non-finite component take no
    part, nor do those of another length than most. Ids are taken as distinct;
    rows repeated whole are one. No usable rows give an empty result.
    """
    rows, _ = save(usable(vectors, id_col, vector_col), "vectors")
    widths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    schema = "query_id long, rank int, vec_id long, score double"
    spark = vectors.sparkSession
    if widths is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("v") == widths["n"])
    first = Window.partitionBy("v").orderBy("id")
    # the limit of ranks is applied before the shuffle too, so a common vector sends few rows
    few = rows.withColumn("_r", F.dense_rank().over(first)).where(F.col("_r") <= k + 1)
    classes, _ = save(few.groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids")).withColumn("c", F.col("ids")[0]), "vector-classes")
    facts = classes.agg(F.count("*").alias("n"), F.max(F.sqrt(dot(F.col("v"), F.col("v")))).alias("norm")).first()
    n, width = facts["n"], widths["n"]
    keep = F.pmod(F.xxhash64(F.lit(seed), "c"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 0.95 * SAMPLE_VECTORS / n))
    sample = np.array([r["v"] for r in classes.where(keep).orderBy("c").limit(SAMPLE_VECTORS).select("v").collect()], float).reshape(-1, width)
    tree = Tree(sample if len(sample) else np.zeros((1, width)), min(max_leaves, -(-n // leaf_rows), max(1, len(sample) // 8)), branch, seed, facts["norm"] + 1e-9)
    shared = spark.sparkContext.broadcast(cloudpickle.dumps(tree))  # at most max_leaves centres and as many above them

    def assign(batches: Iterator) -> Iterator:
        import pyarrow as pa

        tree = cloudpickle.loads(shared.value)
        for b in batches:
            x = np.asarray(b.column(1).flatten()).reshape(-1, width)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(tree.assign(x), pa.int64())], names=["c", "v", "leaf"])

    leaves, _ = save(classes.select("c", "v").mapInArrow(assign, "c long, v array<double>, leaf long"), "leaves")
    asked = rows.where(F.col("id") % every == 0).join(classes.select("v", "c"), "v").select(F.col("id").alias("query_id"), "c")
    asked, _ = save(asked.distinct(), "queries")
    wanted, _ = save(classes.select("c", "v").join(asked.select("c").distinct(), "c", "left_semi"), "query-classes")
    most = calibrate(leaves, wanted, tree, k, recall, seed)

    # neighbouring leaves share a block of bounded rows and a large leaf has several, so a query meets a block once
    place = blocks_of([r["n"] for r in leaves.groupBy("leaf").agg(F.count("*").alias("n")).join(spark.range(tree.leaves).withColumnRenamed("id", "leaf"), "leaf", "right").select("leaf", F.coalesce("n", F.lit(0)).alias("n")).orderBy("leaf").collect()])
    table = spark.createDataFrame([(leaf, *x) for leaf, x in enumerate(place)], "leaf long, _first long, _n long")  # at most max_leaves rows

    def visit(batches: Iterator) -> Iterator:
        import pyarrow as pa

        tree = cloudpickle.loads(shared.value)
        for batch in batches:
            x = np.asarray(batch.column(1).flatten()).reshape(-1, width)
            for i in range(len(x)):
                met: dict[int, list[int]] = {}
                for leaf in tree.visits(x[i], most):
                    for block in range(place[leaf][0], sum(place[leaf])):
                        met.setdefault(block, []).append(leaf)
                m = len(met)
                yield pa.RecordBatch.from_arrays([
                    pa.array([batch.column(0)[i].as_py()] * m, pa.int64()), pa.array([x[i]] * m, pa.list_(pa.float64())), pa.array(list(met), pa.int64()), pa.array(list(met.values()), pa.list_(pa.int64()))],
                    names=["c", "v", "b", "go"])

    sent, _ = save(wanted.mapInArrow(visit, "c long, v array<double>, b long, go array<long>"), "visits")
    # a row for each block that is visited; its rows go to as many tasks as its queries need
    parts = sent.groupBy("b").agg(F.ceil(F.count("*") / F.lit(BLOCK_QUERIES)).cast("long").alias("_parts"))
    dealt = leaves.join(F.broadcast(table), "leaf").select((F.col("_first") + F.pmod(F.xxhash64(F.lit(seed), "c"), F.col("_n"))).alias("b"), "leaf", "c", "v")
    dealt = dealt.join(parts, "b").select("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("part"), "leaf", "c", "v")
    asking = sent.join(parts, "b").select("b", F.pmod(F.xxhash64(F.lit(seed), "c"), F.col("_parts")).alias("part"), "c", "v", "go")
    top = k + 1

    def score(key, left, right):
        import pandas as pd

        out = [pd.DataFrame({"q": np.zeros(0, np.int64), "c": np.zeros(0, np.int64), "s": np.zeros(0)})]
        if len(left) and len(right):
            x, ids = np.stack(left["v"].to_numpy()), left["c"].to_numpy()
            known, at = np.unique(left["leaf"].to_numpy(), return_inverse=True)
            m = min(top, len(ids))
            for start in range(0, len(right), 512):
                part = right.iloc[start : start + 512]
                s = np.stack(part["v"].to_numpy()) @ x.T
                s[~np.stack([np.isin(known, go) for go in part["go"]])[:, at]] = -np.inf
                # products of matrices may differ from those summed in order in the last bits, so what is near the cut is summed anew
                y = np.stack(part["v"].to_numpy())
                near = 4 * np.finfo(float).eps * width * np.sqrt((y * y).sum(axis=1) * (x * x).sum(axis=1).max())
                row, at_row = np.nonzero((s >= (np.partition(s, -m, axis=1)[:, -m] - near)[:, None]) & np.isfinite(s))
                exact = np.zeros(len(row))
                for j in range(width):
                    exact += y[row, j] * x[at_row, j]
                order = np.lexsort((ids[at_row], -exact, row))
                row, at_row, exact = row[order], at_row[order], exact[order]
                first = np.arange(len(row)) - np.searchsorted(row, row) < m
                out.append(pd.DataFrame({"q": part["c"].to_numpy()[row], "c": ids[at_row], "s": exact})[first])
        return pd.concat(out)

    scored = dealt.groupBy("b", "part").cogroup(asking.groupBy("b", "part")).applyInPandas(score, "q long, c long, s double")
    by_query = Window.partitionBy("q").orderBy(F.desc("s"), "c")
    best = scored.withColumn("_r", F.row_number().over(by_query)).where(F.col("_r") <= top).select("q", "c")
    exact = (
        best.join(wanted.select(F.col("c").alias("q"), F.col("v").alias("_qv")), "q").join(classes.select("c", "v", "ids"), "c")
        .select("q", "ids", dot(F.col("_qv"), F.col("v")).alias("score"))
    )
    exact, _ = save(exact, "neighbours")
    # a class gives its members in order of id; the query itself takes no part
    per_query = asked.withColumnRenamed("c", "q").join(exact, "q").select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return per_query.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def blocks_of(rows: list[int]) -> list[tuple[int, int]]:
    """Each leaf's first block and how many it has, from the leaves' rows."""
    out, block, held = [], 0, 0
    for n in rows:
        parts = max(1, -(-n // BLOCK_ROWS))
        if held and (parts > 1 or held + n > BLOCK_ROWS):
            block, held = block + 1, 0
        out.append((block, parts))
        held += n
        if parts > 1:
            block, held = block + parts, 0
    return out


def calibrate(leaves: DataFrame, wanted: DataFrame, tree: Tree, k: int, recall: float, seed: int) -> int:
    """The least number of leaves at which the mean recall of a bounded set of queries is reached, against all classes."""
    chosen = wanted.orderBy(F.xxhash64(F.lit(seed), "c"), "c").limit(CALIBRATION_QUERIES).collect()
    if not chosen:
        return tree.leaves
    ids, q = [r["c"] for r in chosen], np.array([r["v"] for r in chosen], float)
    width = q.shape[1]

    def nearest(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            if len(b) == 0:
                continue
            x = np.asarray(b.column(1).flatten()).reshape(-1, width)
            s = q @ x.T
            m = min(k + 1, len(x))
            best = np.argpartition(-s, m - 1, axis=1)[:, :m]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(np.arange(len(q)), m), pa.int64()), b.column(0).take(pa.array(best.ravel())), b.column(2).take(pa.array(best.ravel())),
                pa.array(np.take_along_axis(s, best, 1).ravel())], names=["q", "c", "leaf", "s"])

    by_query = Window.partitionBy("q").orderBy(F.desc("s"), "c")
    found = leaves.select("c", "v", "leaf").mapInArrow(nearest, "q long, c long, leaf long, s double").withColumn("_r", F.row_number().over(by_query)).where(F.col("_r") <= k + 1)
    truth: list[list[int]] = [[] for _ in ids]
    for r in found.select("q", "c", "leaf").collect():  # k + 1 rows for each of the bounded queries
        if r["c"] != ids[r["q"]]:
            truth[r["q"]].append(r["leaf"])
    order = [{leaf: i for i, leaf in enumerate(tree.visits(x, tree.leaves))} for x in q]
    places = [np.array([o[leaf] for leaf in t]) for o, t in zip(order, truth) if t]
    most = 1
    while most < tree.leaves and np.mean([(p < most).mean() for p in places]) < recall:
        most += 1
    return most
