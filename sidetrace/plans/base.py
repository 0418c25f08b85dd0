"""Registration of queries: each is a function of (spark, sf_dir) beside the SQL that DuckDB runs for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        def put(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Schedule texts by a row number modulo 8, the same in both dialects; some are broken or missing.
RAW_SQL = "CASE {k} % 8 WHEN 0 THEN 'Mon, Thu' WHEN 1 THEN 'Thursday / Monday' WHEN 2 THEN 'tue;FRI; tues' WHEN 3 THEN 'Mon, Funday' WHEN 4 THEN 'Mon,' WHEN 5 THEN '  ' WHEN 6 THEN NULL ELSE 'Saturday' END"


def raw(k: str) -> str:
    return RAW_SQL.format(k=k)


def days_sql(raw_text: str) -> str:
    """DuckDB text list of the weekdays of a schedule text, NULL if it is none."""
    names = "map {'MON':'MON','MONDAY':'MON','TUE':'TUE','TUES':'TUE','TUESDAY':'TUE','WED':'WED','WEDNESDAY':'WED','THU':'THU','THUR':'THU','THURS':'THU','THURSDAY':'THU','FRI':'FRI','FRIDAY':'FRI','SAT':'SAT','SATURDAY':'SAT'}"
    found = f"list_transform(regexp_split_to_array({raw_text}, '[,/;]'), lambda t: {names}[upper(trim(t))])"
    return f"CASE WHEN trim({raw_text}) = '' OR {raw_text} IS NULL OR len(list_filter({found}, lambda d: d IS NULL)) > 0 THEN NULL ELSE list_filter(['MON','TUE','WED','THU','FRI','SAT'], lambda d: list_contains({found}, d)) END"
