"""Run registered queries beside their oracles and compare the rows.

    python tests/compare.py [--sf DIR] [name-prefix ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def cell(value):
    if value is None:
        return None
    if isinstance(value, decimal.Decimal):
        return ("dec", str(value))
    if isinstance(value, float):
        return None if math.isnan(value) else ("flt", repr(value))
    if isinstance(value, dt.datetime):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(cell(v) for v in value)
    return value


def duck_connection(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for file in sorted(os.listdir(sf_dir)):
        con.execute(f"create view {file[:-8]} as select * from '{sf_dir}/{file}'")
    return con


def compare(spark_df, con, sql) -> list[str]:
    problems = []
    relation = con.execute(sql)
    names = [d[0] for d in relation.description]
    order = sorted(names)
    if sorted(spark_df.columns) != order:
        return [f"columns differ: spark {sorted(spark_df.columns)} oracle {order}"]
    types = {d[0]: str(d[1]).lower() for d in relation.description}
    pick = [names.index(n) for n in order]
    theirs = Counter(tuple(cell(r[i]) for i in pick) for r in relation.fetchall())
    ours = Counter(tuple(cell(r[n]) for n in order) for r in spark_df.collect())
    for field in spark_df.schema.fields:
        kind, other = field.dataType.simpleString(), types[field.name]
        if kind.startswith("decimal") and not other.startswith("decimal"):
            problems.append(f"type of {field.name}: {kind} against {other}")
    if sum(ours.values()) != sum(theirs.values()):
        problems.append(f"rows: spark {sum(ours.values())} oracle {sum(theirs.values())}")
    if ours != theirs:
        problems.append(f"columns {order}")
        for row in list((ours - theirs).elements())[:3]:
            problems.append(f"  only spark  {row}")
        for row in list((theirs - ours).elements())[:3]:
            problems.append(f"  only oracle {row}")
    if not ours:
        problems.append("no rows at all")
    return problems


def main(argv: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from tallystone.session import local_session

    sf_dir = "/root/testdata/sf0.01"
    if argv[:1] == ["--sf"]:
        sf_dir, argv = argv[1], argv[2:]
    spark = local_session()
    con = duck_connection(sf_dir)
    oracles, failed = oracle_sql(), 0
    for name, function in queries().items():
        if argv and not any(name.startswith(p) for p in argv):
            continue
        began = time.time()
        try:
            frame = function(spark, sf_dir)
            if name in oracles:
                problems = compare(frame, con, oracles[name])
            else:
                problems = [] if frame.limit(1).collect() else ["no rows at all"]
        except Exception as error:  # report every query, not only the first
            problems = [f"{type(error).__name__}: {str(error)[:900]}"]
        soft = problems == ["no rows at all"]
        failed += bool(problems) and not soft
        state = "EMPTY" if soft else "FAIL" if problems else "ok"
        print(f"{state:5} {name} {time.time() - began:.1f}s", flush=True)
        for problem in problems:
            print("      ", problem)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
