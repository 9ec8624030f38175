"""Benchmark decontamination: pigeonhole pieces, then Myers' bit-parallel distance over words."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save

#: What a word keeps of a token: letters and digits, lower-cased.
_WORDS = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """The words of a text: runs of letters and digits, lower-cased."""
    return _WORDS.findall((text or "").lower())


def budget(n_words: int, error_rate: float) -> int:
    """Words that may be inserted, left out or replaced."""
    return int(n_words * error_rate)


def pieces(words: list[str], k: int) -> list[tuple[int, tuple[str, ...]]]:
    """k + 1 pieces, as (offset, words): with k errors at most, one of them is whole."""
    n, parts = len(words), k + 1
    cuts = [n * p // parts for p in range(parts + 1)]
    return [(cuts[p], tuple(words[cuts[p] : cuts[p + 1]])) for p in range(parts)]


def best_match(pattern: dict[str, int], m: int, text: list[str]) -> tuple[int, int]:
    """Least edits that turn some stretch of the text into the pattern, and where it ends (Myers 1999).

    ``pattern`` has each word's positions as bits; a column of the edit table is
    held in two bit vectors, and a text word costs a few operations on them.
    """
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best, end = full, 0, m, m, 0
    for j, word in enumerate(text, 1):
        eq = pattern.get(word, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        rise, fall = down | ~(xh | up) & full, up & xh
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
        rise, fall = rise << 1 & full, fall << 1 & full  # a match may start anywhere, so 0 is shifted in
        up, down = fall | ~(xv | rise) & full, rise & xv
        if score < best:
            best, end = score, j
    return best, end


def begin_of(pattern: dict[str, int], m: int, text: list[str], edits: int) -> int:
    """How many words at the text's end turn into the pattern by ``edits`` edits; the fewest.

    The same columns run from the end to the front: the pattern's last bit is
    its first word, and a match must start where the text ends, so a column
    enters with one more edit.
    """
    turned = {w: int(f"{bits:0{m}b}"[::-1], 2) for w, bits in pattern.items()}
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    if score == edits:
        return 0
    for j, word in enumerate(reversed(text), 1):
        eq = turned.get(word, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        rise, fall = down | ~(xh | up) & full, up & xh
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
        if score == edits:
            return j
        rise, fall = (rise << 1 | 1) & full, fall << 1 & full
        up, down = fall | ~(xv | rise) & full, rise & xv
    return len(text)


class Matcher:
    """Test items with their pieces; ``scan`` finds the items that a text holds.

    Items are told apart by their place, so rows of equal or null ids are each sought.
    """

    def __init__(self, items: list[tuple[int | None, str]], error_rate: float, min_words: int):
        self.items, self.ids = {}, [item for item, _ in items]
        self.start: dict[str, dict[tuple[str, ...], list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for item, (_, text) in enumerate(items):
            words = words_of(text)
            if len(words) < min_words:
                continue
            masks: dict[str, int] = defaultdict(int)
            for at, w in enumerate(words):
                masks[w] |= 1 << at
            k = budget(len(words), error_rate)
            self.items[item] = (len(words), k, dict(masks))
            for offset, piece in pieces(words, k):
                self.start[piece[0]][piece].append((item, offset))
        # by first word, then by length: only whole pieces are looked up
        self.by_length = {w: (sorted({len(p) for p in found}), dict(found)) for w, found in self.start.items()}

    def scan(self, words: list[str]) -> list[tuple[int, int, int, int]]:
        """(item, edits, first word, end) of each item's best match; the earliest of equals, and the shortest that ends there."""
        found: dict[int, tuple[int, int, int]] = {}
        done: set[tuple[int, int]] = set()
        heads = self.by_length
        for i, w in enumerate(words):
            head = heads.get(w)
            if head is None:
                continue
            for n in head[0]:
                for item, offset in head[1].get(tuple(words[i : i + n]), ()):
                    m, k, masks = self.items[item]
                    a, b = max(0, i - offset - k), i - offset + m + k
                    if (item, i - offset) in done:
                        continue  # another piece of the same place led here
                    done.add((item, i - offset))
                    edits, end = best_match(masks, m, words[a:b])
                    if edits <= k and (item not in found or edits < found[item][0]):
                        found[item] = (edits, a + end - begin_of(masks, m, words[a : a + end], edits), a + end)
        return [(self.ids[item], *x) for item, x in found.items()]


_built: list = []


def _matcher(shared, error_rate: float, min_words: int) -> Matcher:
    """A block's index; a worker keeps that of the block it met last, with the items that tell it."""
    items = shared.value
    if not _built or _built[0] is not items or _built[1:3] != [error_rate, min_words]:
        _built[:] = [items, error_rate, min_words, Matcher(items, error_rate, min_words)]
    return _built[3]


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    error_rate: float = 0.2, min_words: int = 1, block_items: int = 20_000,
) -> DataFrame:
    """Which documents hold which test items, up to an edit budget.

    Words are runs of letters and digits, lower-cased. An item of m words has a
    budget of ``floor(error_rate * m)`` words inserted, left out or replaced; it
    is cut into one piece more than its budget, so a match holds a piece whole.
    Exact hits of pieces are found by looking words up, and each hit's stretch
    is verified by Myers' bit-parallel distance. Items of under 1 / error_rate
    words have no budget and are found as they are. The benchmark goes to the
    executors in blocks of ``block_items`` items, each block in its own pass
    that is written before the next begins, so what the driver and an executor
    hold has a bound however large the benchmark grows; a worker builds a
    block's index once.

    Returns id, item_id, edits, start_word, end_word: one row for each row and
    distinct row of the benchmark found. Items without words, or of under ``min_words``, are in no
    document, and null or empty texts hold none; a null item id stays null.
    Repeated rows are reported each; empty tables give no rows.
    """
    items, _ = save(
        benchmark.select(F.col(item_col).cast("long").alias("_item"), F.col(item_text).cast("string").alias("_text"))
        .where(F.length("_text") > 0).distinct(), "items")
    n = items.count()
    blocks = max(1, -(-n // block_items))
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    body = docs.select(F.col(id_col).alias("_out"), F.col(text_col).cast("string").alias("_t"))
    results = []
    for b in range(blocks):
        mine = [tuple(x) for x in items.where(F.pmod(F.xxhash64("_item", "_text"), F.lit(blocks)) == b).select("_item", "_text").collect()]
        shared = spark.sparkContext.broadcast(mine)

        def run(batches: Iterator, shared=shared) -> Iterator:
            import pyarrow as pa

            matcher = _matcher(shared, error_rate, min_words)
            for batch in batches:
                rows = [(i, *x) for i, text in enumerate(batch.column(1)) for x in matcher.scan(words_of(text.as_py()))]
                at, found = [r[0] for r in rows], list(zip(*rows)) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at, pa.int64())), pa.array(found[1], pa.int64()), *(pa.array(found[c], pa.int32()) for c in (2, 3, 4))],
                    names=["_out", "item_id", "edits", "start_word", "end_word"])

        found = body.mapInArrow(run, f"_out {kind}, item_id bigint, edits int, start_word int, end_word int")
        results.append(save(found, "contamination")[0] if blocks > 1 else found)
        if blocks > 1:
            shared.unpersist()
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out.withColumnRenamed("_out", id_col)
