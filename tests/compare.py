"""Hold registered queries against their SQL in DuckDB: python tests/compare.py SF_DIR [NAME...]"""

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9) + 0.0
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return x
    return round(float(x), 9) + 0.0 if isinstance(x, int) else str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(normal(r[i]) for i in order) for r in rows), key=str)


def connect(sf_dir):
    db = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return db


def differences(spark, db, query, sql, sf_dir):
    """What differs, or an empty string."""
    df = query(spark, sf_dir)
    mine = rows_of(df.columns, df.collect())
    rel = db.sql(sql)
    theirs = rows_of(rel.columns, rel.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} and {theirs[0]}"
    if len(mine[1]) != len(theirs[1]):
        return f"{len(mine[1])} rows and {len(theirs[1])}: {next(((a, b) for a, b in zip(*(m[1] for m in (mine, theirs))) if a != b), '')}"
    wrong = [(a, b) for a, b in zip(mine[1], theirs[1]) if a != b]
    return f"{len(wrong)} of {len(mine[1])} rows, such as {wrong[:2]}" if wrong else ""


if __name__ == "__main__":
    import __spark_entry__ as entry

    from quern.session import local_session

    spark = local_session("compare", 4)
    db = connect(sys.argv[1])
    queries, sql = entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or queries:
        began = time.time()
        try:
            said = differences(spark, db, queries[name], sql[name], sys.argv[1]) if name in sql else f"no SQL; {len(queries[name](spark, sys.argv[1]).collect())} rows"
        except Exception as e:  # noqa: BLE001
            said = f"{type(e).__name__}: {str(e)[:600]}"
        print(f"{name}: {said[:900] or 'equal'} ({time.time() - began:.1f} s)", flush=True)
