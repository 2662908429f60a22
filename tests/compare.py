"""Runs registered queries beside their SQL in DuckDB."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle_rows(sql: str, sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    return names, got.fetchall()


def difference(df, sql: str, sf_dir: str) -> str:
    names, rows = oracle_rows(sql, sf_dir)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    mine, theirs = sorted(_flat(df.columns, [tuple(r) for r in df.collect()])), sorted(_flat(names, rows))
    if mine != theirs:
        odd = [(a, b) for a, b in zip(mine, theirs) if a != b][:2]
        return f"{len(mine)} vs {len(theirs)} rows, {odd}"
    return ""


def _flat(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    for r in rows:
        out = []
        for i in order:
            x = r[i]
            out.append(f"{float(x) + 0.0:.4f}" if isinstance(x, (int, float)) and not isinstance(x, bool) and abs(x) < 1 << 53 else str(x))
        yield tuple(out)
