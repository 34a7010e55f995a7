"""Run queries and their checking SQL side by side and compare the rows as multisets.

``python -m fleetlens.plans.check <sf_dir> [key prefix ...]``
"""

from __future__ import annotations

import decimal
import os
import sys
import time
from collections import Counter

from fleetlens.plans import fleet_tables

SPARK_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE", "date": "DATE",
}


def database(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in fleet_tables._SOURCES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    return float(value) if isinstance(value, decimal.Decimal) else value


def compare(spark_df, con, sql: str) -> list[str]:
    """Differences in schema and rows; empty when the results agree."""
    order = sorted(spark_df.columns)
    cursor = con.execute(sql)
    theirs = {d[0]: str(d[1]) for d in cursor.description}
    if sorted(theirs) != order:
        return [f"columns {order} against {sorted(theirs)}"]
    ours = {f.name: SPARK_TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in spark_df.schema.fields}
    problems = [f"{c}: {ours[c]} against {theirs[c]}" for c in order if ours[c] != theirs[c]]
    left = Counter(tuple(_plain(v) for v in r) for r in spark_df.select(*order).collect())
    position = [list(theirs).index(c) for c in order]
    right = Counter(tuple(_plain(r[i]) for i in position) for r in cursor.fetchall())
    if left != right:
        problems.append(f"{sum(left.values())} rows against {sum(right.values())}, order {order}")
        problems += [f"  only here:  {r} x{n}" for r, n in list((left - right).items())[:3]]
        problems += [f"  only there: {r} x{n}" for r, n in list((right - left).items())[:3]]
    return problems


def main(sf_dir: str, prefixes: list[str]) -> int:
    from fleetlens.plans import catalog, oracles
    from fleetlens.session import build_session

    spark = build_session(os.environ.get("BENCH_CPUS", "8"))
    con = database(sf_dir)
    failed = 0
    for key, query in catalog.QUERIES.items():
        if prefixes and not any(key.startswith(p) for p in prefixes):
            continue
        start = time.time()
        if key not in oracles.ORACLES:
            print(f"{key:32s} {query(spark, sf_dir).count()} rows, no SQL")
            continue
        try:
            problems = compare(query(spark, sf_dir), con, oracles.ORACLES[key])
        except Exception as error:  # reported per key, the rest still runs
            problems = [str(error)[:1500]]
        failed += bool(problems)
        print(f"{key:32s} {'ok' if not problems else 'DIFFERS'} {time.time() - start:.2f}s", flush=True)
        for line in problems:
            print("   ", line[:1500])
    print(f"{failed} differ")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]) > 0)
