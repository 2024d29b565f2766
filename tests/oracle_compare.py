"""Compare registered queries with their DuckDB twins.

    python tests/oracle_compare.py SCALE_DIR [name-prefix ...]
"""

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from noticeflow.workload.domain import BASE_TABLES  # noqa: E402


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in BASE_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v:.9g}"
        return None if v is None else str(v)

    return sorted([tuple(cell(r[i]) for i in order) for r in rows], key=lambda r: [(c is not None, c or "") for c in r])


def differences(df, con, sql):
    """None when equal, else a short description."""
    relation = con.sql(sql)
    want_columns = list(relation.columns)
    if sorted(df.columns) != sorted(want_columns):
        return f"columns {sorted(df.columns)} != {sorted(want_columns)}"
    got = canonical(df.collect(), df.columns)
    want = canonical(relation.fetchall(), want_columns)
    if got == want:
        return None
    extra = [r for r in got if r not in set(want)][:2]
    missing = [r for r in want if r not in set(got)][:2]
    return f"rows {len(got)} vs {len(want)}; only spark {str(extra)[:600]}; only duckdb {str(missing)[:600]}"


if __name__ == "__main__":
    from noticeflow.session import get_spark
    from noticeflow.workload import all_queries

    sf_dir, prefixes = sys.argv[1], tuple(sys.argv[2:]) or ("",)
    spark, con = get_spark("compare", "local[8]", 8), duck(sf_dir)
    queries, oracles = all_queries()
    bad = 0
    for name in sorted(queries):
        if not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracles:
                problem = differences(df, con, oracles[name])
                rows = con.sql(f"SELECT count(*) FROM ({oracles[name]})").fetchall()[0][0]
            else:
                rows, problem = len(df.collect()), None
        except Exception as error:  # noqa: BLE001
            rows, problem = -1, f"{type(error).__name__}: {str(error)[:700]}"
        bad += problem is not None
        kind = "oracle" if name in oracles else "rows-only"
        print(f"{'ok ' if problem is None else 'BAD'} {name} {kind} rows={rows} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print("bad:", bad)
