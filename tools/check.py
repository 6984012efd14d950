"""Run registered queries and their SQL side by side: ``python tools/check.py SF [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from segflux.catalog import ORACLES, QUERIES  # noqa: E402
from segflux.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    key = lambda v: (v is None, str(type(v)), v if not isinstance(v, float) or not math.isnan(v) else "nan")
    out = [tuple(r[i] for i in order) for r in rows]
    return sorted(out, key=lambda r: [key(v) for v in r])


KINDS = {"INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


def compare(spark, con, name: str, sf_dir: str) -> str:
    """Empty when equal, else a description of the first difference."""
    df = QUERIES[name](spark, sf_dir)
    got = _norm([tuple(r) for r in df.collect()], df.columns)
    if name not in ORACLES:
        return "" if got else "no rows"
    cur = con.execute(ORACLES[name])
    columns = [d[0] for d in cur.description]
    want = _norm(cur.fetchall(), columns)
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(columns)} / {sorted(df.columns)}"
    kinds = {d[0]: KINDS.get(str(d[1]), str(d[1])) for d in cur.description}
    if kinds != dict(df.dtypes):
        return f"types sql {sorted(set(kinds.items()) - set(df.dtypes))} spark {sorted(set(df.dtypes) - set(kinds.items()))}"
    if len(got) != len(want):
        return f"rows sql {len(want)} spark {len(got)}"
    bad = [(w, g) for w, g in zip(want, got) if w != g]
    if bad:
        return f"{len(bad)} of {len(want)} rows differ {sorted(columns)}: sql {bad[0][0]} spark {bad[0][1]}"
    return "" if got else "no rows"


def main() -> None:
    sf_dir = f"/root/testdata/{sys.argv[1]}"
    names = sys.argv[2:] or list(QUERIES)
    spark, con = local_session(8), connect(sf_dir)
    failed = []
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, con, name, sf_dir)
        except Exception as error:  # report and go on
            traceback.print_exc(limit=3)
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        mark = "ok " if not problem else "BAD"
        kind = "sql" if name in ORACLES else "rows"
        print(f"{mark} {name} [{kind}] {time.time() - start:.1f}s {problem}", flush=True)
        if problem:
            failed.append(name)
    print(f"{len(names) - len(failed)} ok, failed: {failed}")
    sys.exit(bool(failed))


if __name__ == "__main__":
    main()
