"""Where the plan modules register their queries."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a query under its own name, with DuckDB SQL that gives the same rows."""

    def put(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


# White space as RE2 reads it, for the SQL side
B = r"[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LINES = f"""lines as (select doc_id, unnest(range(len(l)))::bigint as line_no, unnest(l) as raw from (select doc_id, string_split(text, chr(10)) as l from documents where text is not null)),
norm as (select doc_id, line_no, trim(regexp_replace(raw, '{B}+', ' ', 'g'), ' ') as line from lines)"""
