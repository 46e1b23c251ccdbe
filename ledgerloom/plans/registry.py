"""Queries register themselves by name, with the SQL they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: The current row of each session, for oracle SQL: ``cur``, with labels s and p as they are compared.
CUR = """
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY updated_at DESC NULLS LAST, words DESC NULLS LAST) AS rn
  FROM sessions WHERE session_id IS NOT NULL
), cur AS (
  SELECT * EXCLUDE (rn), lower(trim(source)) AS s, lower(trim(provenance)) AS p,
    coalesce(
      CASE WHEN regexp_matches(started_at, '^[0-9]{4}-[0-9]{2}') THEN epoch_us(try_cast(started_at AS TIMESTAMPTZ)) END,
      CASE WHEN regexp_full_match(started_at, '[0-9]{9,11}(\\.[0-9]+)?') THEN (try_cast(started_at AS DOUBLE) * 1000000)::BIGINT END) AS start_us,
    coalesce(
      CASE WHEN regexp_matches(ended_at, '^[0-9]{4}-[0-9]{2}') THEN epoch_us(try_cast(ended_at AS TIMESTAMPTZ)) END,
      CASE WHEN regexp_full_match(ended_at, '[0-9]{9,11}(\\.[0-9]+)?') THEN (try_cast(ended_at AS DOUBLE) * 1000000)::BIGINT END) AS end_us,
    string_split(coalesce(cwd, ''), '/')[-1] AS repo
  FROM ranked WHERE rn = 1
)"""

#: White space between words, for oracle SQL.
WS = r"[\x{09}-\x{0d}\x{1c}-\x{1f}\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name; without SQL its results are tested against brute force instead."""

    def add(made: Query) -> Query:
        QUERIES[made.__name__] = made
        if sql is not None:
            ORACLE[made.__name__] = sql
        return made

    return add
