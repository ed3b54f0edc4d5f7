"""Small literal tables built on the JVM side (no Python worker, no RDD)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _sql_value(v, t: str) -> str:
    if v is None:
        return f"CAST(NULL AS {t})"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, float)):
        return f"CAST({v!r} AS {t})"
    s = str(v).replace("\\", "\\\\").replace("'", "\\'")
    return f"CAST('{s}' AS {t})"


def literal_table(spark: SparkSession, rows, schema: str) -> DataFrame:
    """``rows`` (tuples) as a DataFrame of the DDL ``schema`` ("a string, b double").

    Written as one ``VALUES`` statement: a single call into the JVM that plans to a local
    relation, so lookup lists broadcast without Python workers or per-cell round trips.
    """
    fields = [f.strip().split() for f in schema.split(",")]
    names = [f[0] for f in fields]
    types = [f[1] for f in fields]
    if not rows:
        cols = ", ".join(f"CAST(NULL AS {t}) AS {n}" for n, t in zip(names, types))
        return spark.sql(f"SELECT {cols} WHERE FALSE")
    values = ", ".join("(" + ", ".join(_sql_value(v, t) for v, t in zip(row, types)) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(names)})")
