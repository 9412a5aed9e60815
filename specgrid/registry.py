"""Every query of the trial-analysis operators, with its SQL where SQL can express it.

A query is a function of a view (trials or results) and a list of its columns with their kinds; both the DataFrame and the
SQL are brought to those kinds: s text, i whole number, d number (rounded to 6 places), f number (to 4 places, moved off the halves that means of prices
often are), b true or false.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specgrid.sources.views import plain, view

Query = Callable[[SparkSession, str], DataFrame]

FLAGSHIP = "grid_rmanova"
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
KINDS = {"s": ("string", "varchar"), "i": ("bigint", "bigint"), "b": ("boolean", "boolean")}
#: Places, and what is added before rounding.
NUMBERS = {"d": (6, 0.0), "f": (4, 0.0000017)}


def columns_of(spec: str) -> list[tuple[str, str]]:
    """("name", "kind") of each word of a specification such as "study:s n_rows:i"; the kind is i if none is given."""
    return [(c.split(":")[0], (c.split(":") + ["i"])[1]) for c in spec.split()]


def shown(df: DataFrame, spec: str) -> DataFrame:
    # adding 0 turns -0 into 0
    number = lambda c, k: F.round(F.col(c).cast("double") + F.lit(NUMBERS[k][1]), NUMBERS[k][0]) + F.lit(0.0)
    return df.select(*((number(c, k) if k in NUMBERS else F.col(c).cast(KINDS[k][0])).alias(c) for c, k in columns_of(spec)))


def wrapped(sql: str, spec: str) -> str:
    number = lambda c, k: f'round(cast("{c}" as double) + {NUMBERS[k][1]:.7f}, {NUMBERS[k][0]}) + 0.0'
    parts = [f'{number(c, k) if k in NUMBERS else f"""cast("{c}" as {KINDS[k][1]})"""} as "{c}"' for c, k in columns_of(spec)]
    return f"select {', '.join(parts)} from ({sql}) shown_rows"


def query(of: str, spec: str, sql: str | None = None, name: str | None = None, dealt: bool = False) -> Callable:
    """Registers a function of a view's DataFrame; sql reads the view as `trials` or `results`; dealt as in view()."""

    def add(f: Callable[[DataFrame], DataFrame]) -> Callable:
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: shown(f(view(spark, sf_dir, of, dealt)), spec)
        if sql is not None:
            alias = "results" if of.startswith("results") else "trials"
            ORACLE_SQL[key] = f"with {alias} as ({plain(of)}) {wrapped(sql, spec)}"
        return f

    return add


def load() -> None:
    """Fills QUERIES and ORACLE_SQL."""
    from specgrid.queries import result_queries, trial_queries  # noqa: F401


load()
