"""Places of a pattern's matches in a text, with built-in functions alone."""

from __future__ import annotations

#: Lengths are summed in blocks and blocks of blocks, so that a match costs the same however many stand before it.
BLOCK = 32


def match_columns(text: str, regex: str) -> list[tuple[str, str]]:
    """Steps (column, SQL) that end in ``_found``: an array of (s, e, m), a match's start, end and text in code points.

    ``split`` gives what lies between the matches and ``regexp_extract_all`` the
    matches, by the same leftmost non-overlapping search; a match starts behind
    all earlier pieces and matches.
    """
    lit = "r'" + regex + "'" if "'" not in regex else 'r"' + regex + '"'
    return [
        ("_m", f"regexp_extract_all({text}, {lit}, 0)"),
        ("_gap", f"CASE WHEN size(_m) > 0 THEN split({text}, {lit}, -1) END"),
        ("_len", "transform(_m, (m, i) -> length(_gap[i]) + length(m))"),
        ("_sums", f"transform(sequence(0, size(_len) div {BLOCK}), b -> aggregate(slice(_len, b * {BLOCK} + 1, {BLOCK}), 0, (a, x) -> a + x))"),
        ("_upper", f"transform(sequence(0, size(_sums) div {BLOCK}), b -> aggregate(slice(_sums, b * {BLOCK} + 1, {BLOCK}), 0, (a, x) -> a + x))"),
        ("_upto", "transform(_upper, (u, b) -> aggregate(slice(_upper, 1, b), 0, (a, x) -> a + x))"),
        # a column that a lambda alone refers to, and once, would be worked out anew for each element; a second reference keeps it
        ("_before", f"transform(_sums, (s, b) -> IF(size(_upto) < 0, 0, _upto[b div {BLOCK}]) + aggregate(slice(_sums, (b div {BLOCK}) * {BLOCK} + 1, b % {BLOCK}), 0, (a, x) -> a + x))"),
        (
            "_found",
            "transform(_m, (m, i) -> named_struct("
            f"'s', IF(size(_before) < 0, 0, _before[i div {BLOCK}]) + aggregate(slice(_len, (i div {BLOCK}) * {BLOCK} + 1, i % {BLOCK}), 0, (a, x) -> a + x) + length(_gap[i]), "
            "'m', m))",
        ),
        ("_found", "transform(_found, f -> named_struct('s', f.s, 'e', f.s + length(f.m), 'm', f.m))"),
    ]


def with_matches(df, text: str, regex: str, name: str, keep: str, guard: str = "true", gaps: str | None = None):
    """Adds ``name``: the (s, e, m) of the matches for which ``keep`` (SQL over f.m) holds. Where ``guard`` fails, none are sought.

    ``gaps`` names a column for what lies before, between and behind the matches.
    """
    from pyspark.sql import functions as F

    out = df
    for column, sql in match_columns(text, regex):
        out = out.withColumn(column, F.expr(f"CASE WHEN {guard} THEN {sql} ELSE array() END" if column == "_m" else sql))
    if gaps:
        out = out.withColumn(gaps, F.col("_gap"))
    return out.withColumn(name, F.expr(f"filter(_found, f -> {keep})")).drop("_m", "_gap", "_len", "_sums", "_upper", "_upto", "_before", "_found")


def joined(spans: str) -> str:
    """SQL: kind:start:end of an array of (kind, s, e), comma-joined."""
    return f"array_join(transform({spans}, x -> concat(x.kind, ':', x.s, ':', x.e)), ',')"
