"""Quality classifier: a sparse ensemble of rules over text statistics."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, lower_ascii, text_of

#: Rows with this remainder of crc32(id as text) by 4 are held out from learning.
HELD_OUT = 2
#: Bound of the labelled sample that the rules are fitted on, in rows of a few numbers each.
SAMPLE_ROWS = 12_000
REJECT_BELOW = 0.7


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of the whole text; each is defined for the empty text too."""
    n = F.greatest(F.char_length(text), F.lit(1))
    words = F.regexp_count(text, F.lit(WORD))
    some = F.greatest(words, F.lit(1))
    tokens = F.split(lower_ascii(text), r"[\x20\x09-\x0D]+")
    count = lambda c: F.char_length(text) - F.char_length(F.replace(text, F.lit(c), F.lit("")))
    return {
        "log_chars": F.log1p(F.char_length(text).cast("double")),
        "log_words": F.log1p(words.cast("double")),
        "word_length": F.char_length(text) / some,
        "distinct_words": F.size(F.array_distinct(tokens)) / F.size(tokens),
        "upper": F.regexp_count(text, F.lit(r"\p{Lu}")) / n,
        "digit": F.regexp_count(text, F.lit(r"[0-9]")) / n,
        "marks": F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\s.,]")) / n,
        "mark_runs": F.regexp_count(text, F.lit(r"[!#$%&*|?@~^=<>+]{2,}")) / some,
        "bars": count("|") / some,
        "stops": (count(".") + count(",")) / some,
        "lines": count("\n") / some,
    }


@dataclass
class Rule:
    """A path of a tree: (statistic, above?, threshold) all of which hold."""

    tests: tuple[tuple[int, bool, float], ...]

    def matches(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for j, above, t in self.tests:
            out &= (x[:, j] > t) if above else (x[:, j] <= t)
        return out

    def column(self, names: list[str]) -> Column:
        out = F.lit(True)
        for j, above, t in self.tests:
            out = out & ((F.col(names[j]) > t) if above else (F.col(names[j]) <= t))
        return out


def grow(x: np.ndarray, residual: np.ndarray, weight: np.ndarray, depth: int, least: int, tests: tuple = ()) -> list[tuple[Rule, float]]:
    """A regression tree's nodes as rules with their values; splits are sought at quantiles."""
    found = [(Rule(tests), float((residual * weight).sum() / max(weight.sum(), 1e-9)))] if tests else []
    if depth == 0 or len(x) < 2 * least:
        return found
    best = (1e-9, -1, 0.0)
    base = residual.sum() ** 2 / len(x)
    for j in range(x.shape[1]):
        for t in np.unique(np.quantile(x[:, j], np.linspace(0.02, 0.98, 33))):
            left = x[:, j] <= t
            n = int(left.sum())
            if least <= n <= len(x) - least:
                s = residual[left].sum()
                gain = s * s / n + (residual.sum() - s) ** 2 / (len(x) - n) - base
                if gain > best[0]:
                    best = (gain, j, float(t))
    _, j, t = best
    if j < 0:
        return found
    left = x[:, j] <= t
    for side, above in ((left, False), (~left, True)):
        found += grow(x[side], residual[side], weight[side], depth - 1, least, (*tests, (j, above, t)))
    return found


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int, depth: int, seed: int) -> list[Rule]:
    """Paths of gradient-boosted trees, each grown on a random half of the rows."""
    rng, f, rules = np.random.default_rng(seed), np.zeros(len(y)), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        pick = rng.random(len(y)) < 0.5
        for rule, value in (nodes := grow(x[pick], (y - p)[pick], np.ones(int(pick.sum())), depth, max(5, len(y) // 400))):
            rules.setdefault(rule.tests, rule)
        for rule, value in nodes:
            if len(rule.tests) == depth or not any(r.tests[: len(rule.tests)] == rule.tests and len(r.tests) > len(rule.tests) for r, _ in nodes):
                f += 1.0 * value * rule.matches(x)
    return list(rules.values())


def fit_lasso(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 600) -> tuple[float, np.ndarray]:
    """Logistic weights with an L1 penalty, by accelerated proximal gradient steps."""
    n, k = z.shape
    one = np.c_[np.ones(n), z]
    step = 4 * n / np.linalg.norm(one.T @ one, 2)  # the Gram matrix, of a row for each rule, has the squared singular values
    w, b, v, c, t = np.zeros(k), 0.0, np.zeros(k), 0.0, 1.0
    for _ in range(steps):
        g = 1 / (1 + np.exp(-(z @ v + c))) - y
        nw = v - step * (z.T @ g) / n
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)
        nb = c - step * g.mean()
        nt = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, c, w, b, t = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b), nw, nb, nt
    return b, w


@dataclass
class RuleModel:
    """Rules with their weights, in the order of ``names``."""

    names: list[str]
    bias: float
    rules: list[Rule]
    weights: list[float]

    def to_json(self) -> str:
        return json.dumps([self.names, self.bias, [[[int(j), bool(above), t] for j, above, t in r.tests] for r in self.rules], self.weights])

    @staticmethod
    def from_json(told: str) -> RuleModel:
        names, bias, rules, weights = json.loads(told)
        return RuleModel(names, bias, [Rule(tuple((j, above, t) for j, above, t in tests)) for tests in rules], weights)

    def score(self) -> Column:
        """The model as a column expression over the statistics' columns."""
        terms = [F.lit(self.bias), *(F.when(rule.column(self.names), F.lit(w)).otherwise(F.lit(0.0)) for rule, w in zip(self.rules, self.weights))]
        while len(terms) > 1:  # added up in pairs, so that the expression is flat
            terms = [a + b for a, b in zip(terms[::2], terms[1::2])] + terms[len(terms) // 2 * 2 :]
        return 1 / (1 + F.exp(-terms[0]))


def fit(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 24, depth: int = 3, penalty: float = 0.0015, seed: int = 5) -> RuleModel:
    """Without both labels in the sample, the score is their share, drawn to one half."""
    if len(y) == 0 or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2)
        return RuleModel(names, math.log(p / (1 - p)), [], [])
    rules = fit_rules(x, y, trees, depth, seed)
    if not rules:
        p = (y.sum() + 1) / (len(y) + 2)
        return RuleModel(names, math.log(p / (1 - p)), [], [])
    z = np.stack([r.matches(x) for r in rules], axis=1).astype(float)
    bias, w = fit_lasso(z, y, penalty)
    kept = [i for i in range(len(rules)) if w[i] != 0]
    # the penalty draws weights to 0; those that are left are fitted again almost freely
    if kept:
        bias, again = fit_lasso(z[:, kept], y, penalty / 50)
        return RuleModel(names, float(bias), [rules[i] for i in kept], [float(v) for v in again])
    return RuleModel(names, float(bias), [], [])


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == HELD_OUT


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, **kw) -> RuleModel:
    """Fits the rules on at most ``sample_rows`` labelled rows that aren't held out, chosen by a hash of the id.

    One task fits them on the sample's statistics and labels, twelve numbers a
    row; only the rules reach the driver. Rows without a label, an id or a text
    in ``docs`` are left out of the sample; with both tables empty the score is
    one half.
    """
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(id_col)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
    n = usable.count()
    share = F.pmod(F.xxhash64(F.lit(3), "_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 0.95 * sample_rows / max(n, 1)))
    chosen = usable.where(share).limit(sample_rows)
    names = list(statistics(F.col("_t")))
    sample = (
        docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_t")).join(F.broadcast(chosen), "_id")
        .select("_id", F.col("_y").cast("double"), *[c.cast("double").alias(k) for k, c in statistics(F.col("_t")).items()])
        .limit(2 * sample_rows)
    )

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held = pa.Table.from_batches(list(batches), None) if (batches := [b for b in batches if len(b)]) else None
        x = np.stack([held.column(k).to_numpy() for k in held.column_names], axis=1) if held else np.zeros((0, len(names) + 2))
        x = x[np.lexsort(x.T[::-1])]  # the order in which tasks end doesn't matter
        yield pa.RecordBatch.from_arrays([pa.array([fit(x[:, 2:], x[:, 1], names, **kw).to_json()])], names=["model"])

    told = sample.coalesce(1).mapInArrow(run, "model string").collect()
    return RuleModel.from_json(told[0]["model"]) if told else fit(np.zeros((0, len(names))), np.zeros(0), names, **kw)


def quality(docs: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows with ``_score``, the model's probability of label 1.

    Only the text is an input. A null text scores as an empty one, repeated rows
    score alike, an empty table gives no rows. Columns of the input are kept
    whatever their names, but for one named ``_score``, in capitals or not.
    """
    own = [c for c in docs.columns if c.lower() != "_score"]
    packed = docs.select(F.struct(*own).alias("_row"), text_of(text_col).alias("_t"))
    stats = packed.select("_row", *[c.cast("double").alias(k) for k, c in statistics(F.col("_t")).items()])
    return stats.select("_row.*", model.score().alias("_score"))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = quality(docs.select("doc_id", "text"), train(docs, labels)).drop("text")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= REJECT_BELOW).cast("int").alias("predicted"))
