"""Running a query beside its oracle SQL."""

import math
from pathlib import Path

import duckdb


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return value


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in found), key=repr)


def compare(spark, sf_dir, query, sql):
    """Assert that both give the same columns and the same rows, in any order."""
    db = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    asked = db.execute(sql)
    names = [d[0] for d in asked.description]
    df = query(spark, sf_dir)
    assert sorted(df.columns) == sorted(names)
    ours, theirs = rows(df.columns, map(tuple, df.collect())), rows(names, asked.fetchall())
    assert len(ours) == len(theirs)
    different = [(a, b) for a, b in zip(ours, theirs) if a != b]
    assert not different, different[:3]
