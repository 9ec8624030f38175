"""Secret scans: fixed patterns, and sliding-window entropy over candidate strings."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .spans import joined, with_matches

# The base kinds' patterns.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)"""
# Shorter runs fail, and no shorter run holds a longer one, so the least lengths stand in the patterns.
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}+"
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"
#: Candidates that are no secrets: words of letters alone (with hyphens or slashes), UUIDs, digits alone, rulers, and values that say they are placeholders.
ALLOWED = r"^(?:[A-Za-z]?[a-z]*+(?:[-/_=+]++[A-Za-z]?[a-z]*+)*+|[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}|[0-9+/_=-]*+)$|(?i:example|placeholder|changeme|dummy)"
#: Character class, the smallest first: its pattern and the bits a character that its windows reach in a secret. Each bound is
#: just under what 99% of random 20-character strings of the class reach (60,000 simulated for each of 16, 22, 26, 36, 52 and 62 symbols).
CLASSES = {
    "hex": (r"^(?:[0-9a-f]++|[0-9A-F]++)$", 2.9), "mixed hex": (r"^[0-9a-fA-F]++$", 3.1), "capitals": (r"^[A-Z+/_=-]++$", 3.2),
    "one case": (r"^(?:[0-9a-z+/_=-]++|[0-9A-Z+/_=-]++)$", 3.4), "letters": (r"^[A-Za-z+/_=-]++$", 3.55), "base64": (r"^[A-Za-z0-9+/_=-]++$", 3.6),
}


def entropy_columns(window: int) -> str:
    """SQL over a candidate's array of character numbers ``_ids``: the largest Shannon entropy of its windows.

    The counts of a window's characters and their sum of n * log2(n) follow the
    window by the character that enters and the one that leaves; nothing is
    counted anew.
    """
    table = "array(" + ", ".join(f"{n * math.log2(n) if n else 0.0!r}D" for n in range(window + 2)) + ")"
    zeros = f"array_repeat(0, {len(ALPHABET)})"
    gone = f"IF(i >= {window}, ids[i - {window}], -1)"
    step = (
        f"named_struct('c', IF({gone} = ids[i], a.c, transform(a.c, (n, k) -> n + IF(k = ids[i], 1, 0) - IF(k = {gone}, 1, 0))), "
        f"'sum', IF({gone} = ids[i], a.sum, a.sum + {table}[a.c[ids[i]] + 1] - {table}[a.c[ids[i]]]"
        f" + IF({gone} >= 0, {table}[greatest(a.c[greatest({gone}, 0)] - 1, 0)] - {table}[a.c[greatest({gone}, 0)]], 0D)), 'best', a.best)"
    )
    scored = f"named_struct('c', b.c, 'sum', b.sum, 'best', IF(i >= {window - 1}, greatest(b.best, {math.log2(window)!r}D - b.sum / {window}), b.best))"
    # the inner transform of a one-element array names the stepped state, so that it is computed once
    return f"aggregate(sequence(0, size(ids) - 1), named_struct('c', {zeros}, 'sum', 0D, 'best', 0D), (a, i) -> transform(array({step}), b -> {scored})[0]).best"


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20) -> DataFrame:
    """Spans of likely secrets in each text.

    Base kinds are ``assign``, ``access`` and ``hex``, matched leftmost without
    overlap within a kind. Other runs of 20 or more characters that may stand in
    a key are candidates: an allow-list suppresses words, UUIDs, numbers and
    placeholders, and the largest entropy among a candidate's windows must reach
    its character class's bound. What passes and touches no base span is kind
    ``entropy``. Places are code points, ends exclusive.

    Returns id, spans: an array of (s, kind, e) in order of start, then of the
    kinds as listed here; one row for each input row, with an empty array for a
    null or empty text. Repeated rows are alike, other columns are not read.
    """
    df = docs.select(F.col(id_col).alias("_out"), text_of(text_col).alias("_t"))
    value = f"regexp_extract(f.m, r'{ASSIGN}', 1)"
    df = with_matches(df, "_t", ASSIGN, "_assign", f"length({value}) >= 6", "rlike(_t, '[:=]')")
    df = with_matches(df, "_t", ACCESS, "_access", "true", "contains(_t, 'AKIA')")
    df = with_matches(df, "_t", HEX, "_hex", "true")
    df = with_matches(df, "_t", CANDIDATE, "_cand", f"NOT rlike(f.m, r'{ALLOWED}')")
    base = " , ".join(f"transform(_{k}, f -> named_struct('s', f.s, 'k', {i}, 'e', f.e, 'kind', '{k}'))" for i, k in enumerate(("assign", "access", "hex")))
    df = df.withColumn("_base", F.expr(f"array_sort(concat({base}))")).drop("_t")
    free = df.withColumn("_cand", F.expr("filter(_cand, f -> NOT exists(_base, b -> b.s < f.e AND f.s < b.e))"))
    numbered = free.withColumn("_cand", F.expr(f"transform(_cand, f -> named_struct('s', f.s, 'e', f.e, 'm', f.m, 'ids', transform(split(f.m, ''), ch -> instr('{ALPHABET}', ch) - 1)))"))
    best = entropy_columns(window).replace("ids", "f.ids")
    bound = "CASE " + " ".join(f"WHEN rlike(f.m, r'{pattern}') THEN {least}D" for pattern, least in CLASSES.values()) + " END"
    passed = numbered.withColumn("_cand", F.expr(f"filter(_cand, f -> {best} >= {bound})"))
    return passed.select(
        F.col("_out").alias(id_col),
        F.expr("transform(_base, b -> struct(b.s, b.kind, b.e))").alias("base"),
        F.expr("transform(array_sort(concat(_base, transform(_cand, f -> named_struct('s', f.s, 'k', 3, 'e', f.e, 'kind', 'entropy')))), b -> struct(b.s, b.kind, b.e))").alias("spans"),
    )


def digest(docs: DataFrame) -> DataFrame:
    out = secrets(docs)
    counts = [F.expr(f"bigint(size(filter(base, x -> x.kind = '{k}')))").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return out.select("doc_id", *counts, F.expr(f"sha2({joined('base')}, 256)").alias("base_sha256"), F.expr(joined("spans")).alias("spans"))
