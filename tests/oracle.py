"""Compare a Spark query with its SQL text on the same tables."""

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if isinstance(v, bool) or v is None:
            return repr(v)
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(v + 0.0)
        return str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows), [names[i] for i in order]


def compare(df, sql, con):
    got, got_names = canonical([tuple(r) for r in df.collect()], df.columns)
    cur = con.execute(sql)
    want_names = [d[0] for d in cur.description]
    wide = [(d[0], str(d[1])) for d in cur.description if "HUGEINT" in str(d[1]) or "DECIMAL" in str(d[1])]
    assert not wide, f"cast these columns in the SQL: {wide}"
    want, want_names = canonical(cur.fetchall(), want_names)
    assert got_names == want_names, (got_names, want_names)
    if got != want:
        a, b = set(got), set(want)
        raise AssertionError(
            f"{len(got)} rows vs {len(want)}; only spark {sorted(a - b)[:4]}; only sql {sorted(b - a)[:4]}"
        )
    return len(got)
