"""Queries and their DuckDB counterparts, kept side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from formloom.plans.fixtures import SQL, Tables, sql_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Registers ``fn(tables)``. In the oracle ``<<fixture>>`` stands for a fixture's SQL in brackets."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if oracle:
            text = oracle
            for fixture in SQL:
                if f"<<{fixture}>>" in text:
                    text = text.replace(f"<<{fixture}>>", f"({sql_of(fixture)})")
            assert "<<" not in text, f"unknown fixture in {name}"
            ORACLES[name] = text
        return fn

    return wrap


# Expression builders for oracle texts.
def q_letters(n: str) -> str:
    return (
        f"(CASE WHEN {n} <= 26 THEN chr(CAST(64 + {n} AS INT)) WHEN {n} <= 702 THEN chr(CAST(64 + ({n} - 1) // 26 AS INT)) ||"
        f" chr(CAST(65 + ({n} - 1) % 26 AS INT)) ELSE chr(CAST(64 + (({n} - 1) // 26 - 1) // 26 AS INT)) ||"
        f" chr(CAST(65 + (({n} - 1) // 26 - 1) % 26 AS INT)) || chr(CAST(65 + ({n} - 1) % 26 AS INT)) END)"
    )


def q_cell(r: str, c: str) -> str:
    return f"({q_letters(c)} || CAST({r} AS VARCHAR))"


def q_range(r0: str, c0: str, r1: str, c1: str) -> str:
    return f"({q_cell(r0, c0)} || ':' || {q_cell(r1, c1)})"


def q_key(s: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({s}, '')), '[^a-z0-9]+', ' ', 'g'))"


def q_col(letters: str) -> str:
    p = f"lpad({letters}, 3, '@')"
    return f"((ascii({p}[1]) - 64) * 676 + (ascii({p}[2]) - 64) * 26 + ascii({p}[3]) - 64)"


def q_hit(a: str, b: str, grow: int = 0) -> str:
    """Overlap condition of two table aliases with r0, c0, r1, c1."""
    g = f" + {grow}" if grow else ""
    return f"({a}.r0 <= {b}.r1{g} AND {b}.r0 <= {a}.r1{g} AND {a}.c0 <= {b}.c1{g} AND {b}.c0 <= {a}.c1{g})"


def q_lines(text: str) -> str:
    """Array of lines without the empty one a final break leaves."""
    a = f"string_split({text}, chr(10))"
    return f"(CASE WHEN {text} LIKE '%' || chr(10) THEN {a}[:-2] ELSE {a} END)"
