"""Registry of named queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.functions.text import STRIPPED_PUNCTUATION
from quarrylens.sources.tables import read_table, spread

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return read_table(spark, root, name)


def documents(spark: SparkSession, root: str) -> DataFrame:
    return spread(read_table(spark, root, "documents"))


def rows_of(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table whose rows are costly to process, dealt out over the cores."""
    return spread(read_table(spark, root, name))


def r6(column: Column | str) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, 6)


def long(column: Column | str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("long")


# SQL spellings of the text functions ---------------------------------------
WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_PUNCT = STRIPPED_PUNCTUATION.replace("'", "''")


def sql_tokens(text: str) -> str:
    return f"list_filter(regexp_split_to_array(translate(lower({text}), '{_PUNCT}', ''), '{WS}+'), lambda t: t <> '')"


def sql_strip(text: str) -> str:
    return f"regexp_replace({text}, '^{WS}+|{WS}+$', '', 'g')"


def sql_normalize(text: str) -> str:
    return f"lower(trim(regexp_replace({text}, '{WS}+', ' ', 'g')))"


def sql_token_count(text: str) -> str:
    return f"(length({text}) // 4 + 1)"


def sql_share(left: str, right: str) -> str:
    """Share of the distinct items of one list found in another."""
    return f"(CASE WHEN len(list_distinct({left})) > 0 THEN len(list_intersect(list_distinct({left}), {right}))::DOUBLE / len(list_distinct({left})) END)"
