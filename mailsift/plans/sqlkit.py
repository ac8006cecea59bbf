"""Helpers that write DuckDB oracle SQL (used only for correctness checks)."""

from __future__ import annotations


def q(s: str) -> str:
    """SQL string literal (standard SQL: backslashes are literal)."""
    return "'" + s.replace("'", "''") + "'"


def spans(src: str, id_col: str, text_expr: str, pattern: str) -> str:
    """Subquery ``(id, i, name, start, end)`` of all regex matches with code-point offsets."""
    p = q(pattern)
    return f"""(SELECT {id_col}, CAST(i AS INTEGER) AS i, name,
        CAST(csum - length(name) AS INTEGER) AS "start", CAST(csum AS INTEGER) AS "end"
      FROM (SELECT {id_col}, i, name,
              sum(length(ps[i]) + length(name)) OVER (PARTITION BY {id_col} ORDER BY i) AS csum
            FROM (SELECT {id_col}, unnest(ms) AS name, generate_subscripts(ms, 1) AS i, ps
                  FROM (SELECT {id_col}, regexp_extract_all({text_expr}, {p}) AS ms,
                               string_split_regex({text_expr}, {p}) AS ps FROM {src}) z0) z1) z2)"""


def replace_chain(expr: str, needles: list[str], repl: str = "") -> str:
    for n in needles:
        expr = f"replace({expr}, {q(n)}, {q(repl)})"
    return expr


def in_list(expr: str, values: list[str]) -> str:
    return f"{expr} IN ({', '.join(q(v) for v in values)})"


def str_list(values: list[str]) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"
