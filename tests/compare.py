"""Compare registered queries with their SQL: ``python tests/compare.py [folder] [name ...]``."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
TYPES = {
    "string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN",
}


def connect(folder):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        tuple("null" if r[i] is None else repr(float(r[i])) if isinstance(r[i], float) else str(r[i]) for i in order)
        for r in rows
    )


def compare(spark, con, folder, name, query, sql):
    """Difference of the two results, as text; empty if they agree."""
    start = time.time()
    df = query(spark, folder)
    ours = canonical(df.collect(), df.columns)
    spark_seconds = time.time() - start
    start = time.time()
    cursor = con.execute(sql)
    columns = [c[0] for c in cursor.description]
    theirs = canonical(cursor.fetchall(), columns)
    sql_seconds = time.time() - start
    timing = f"{name}: {len(ours)} rows, spark {spark_seconds:.1f}s, sql {sql_seconds:.1f}s"
    if sorted(df.columns) != sorted(columns):
        return timing, f"columns {sorted(df.columns)} vs {sorted(columns)}"
    types = {c[0]: str(c[1]) for c in cursor.description}
    for column, kind in df.dtypes:
        if TYPES.get(kind) != types[column]:
            return timing, f"type of {column}: {kind} vs {types[column]}"
    if ours != theirs:
        only_ours, only_theirs = set(ours) - set(theirs), set(theirs) - set(ours)
        return timing, (
            f"{len(ours)} vs {len(theirs)} rows, {len(only_ours)} / {len(only_theirs)} differ, "
            f"{sorted(only_ours)[:2]} vs {sorted(only_theirs)[:2]}"
        )
    return timing, ""


def main(folder, names):
    import __spark_entry__ as entry
    from chronorank import get_session

    spark = get_session("compare", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                        spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        if name not in sqls:
            print(name, "has no SQL")
            continue
        try:
            timing, difference = compare(spark, con, folder, name, queries[name], sqls[name])
            print(timing, "OK" if not difference else "DIFFERS " + difference[:1500], flush=True)
            bad += bool(difference)
        except Exception as err:  # report and go on with the next
            print(name, "FAILED", str(err)[:1500], flush=True)
            bad += 1
    print("bad:", bad, "of", len(names or queries))


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001", sys.argv[2:])
