"""Queries by name, each with the DuckDB SQL that gives the same rows (or none)."""

QUERIES = {}
SQL = {}


def query(sql=None):
    """Registers a function (spark, sf_dir) -> DataFrame under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal(text):
    """A SQL string."""
    return "'" + text.replace("'", "''") + "'"


def values(rows, *columns):
    """A SQL relation of constant rows."""
    def one(x):
        return "NULL" if x is None else literal(x) if isinstance(x, str) else str(x)

    return "(VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + f") AS t({', '.join(columns)})"
