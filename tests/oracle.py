"""Run registered queries beside their SQL in DuckDB and compare rows.

    python -m tests.oracle [--sf sf0.01] [name prefix ...]
"""

import argparse
import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()
DATA = "/root/testdata"


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _kind(value):
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int"
    return type(value).__name__


def _plain(value):
    if isinstance(value, float):
        return 0.0 if value == 0 else ("nan" if math.isnan(value) else value)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _key(row):
    return tuple((v is None, "" if v is None else f"{v:.5f}" if isinstance(v, float) else str(v)) for v in row)


def compare(spark_df, con, sql):
    """Problems found, as text; empty when names, kinds and values agree."""
    names = sorted(spark_df.columns)
    ours = [tuple(_plain(r[n]) for n in names) for r in spark_df.collect()]
    result = con.execute(sql)
    fields = [d[0] for d in result.description]
    if sorted(fields) != names:
        return [f"columns {names} against {sorted(fields)}"]
    order = [fields.index(n) for n in names]
    theirs = [tuple(_plain(r[i]) for i in order) for r in result.fetchall()]
    if len(ours) != len(theirs):
        return [f"{len(ours)} rows against {len(theirs)}"]
    problems = []
    for i, n in enumerate(names):
        kinds = ({_kind(r[i]) for r in ours} - {"null"}, {_kind(r[i]) for r in theirs} - {"null"})
        if kinds[0] != kinds[1]:
            problems.append(f"{n} is {kinds[0]} against {kinds[1]}")
    wrong = [(a, b) for a, b in zip(sorted(ours, key=_key), sorted(theirs, key=_key)) if a != b]
    if wrong:
        problems.append(f"{len(wrong)} of {len(ours)} rows differ, e.g. {wrong[0]}")
    return problems


def main():
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    import __spark_entry__ as entry
    from tablejury.session import build_session

    spark = build_session("oracle", cores=8, shuffle_partitions=8)
    sf_dir = f"{DATA}/{args.sf}"
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if args.names and not any(name.startswith(p) for p in args.names):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracles:
                problems = compare(df, con, oracles[name])
                note = "ok" if not problems else "WRONG " + "; ".join(problems)[:700]
                bad += bool(problems)
            else:
                note = f"rows only: {df.count()}"
        except Exception as exc:
            bad += 1
            note = "FAILED " + str(exc)[:700]
        print(f"{time.time() - start:6.1f}s {name}: {note}", flush=True)
    print("problems:", bad)
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(bool(main()))
