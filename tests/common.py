"""Helpers of the tests."""

DATA = "/root/testdata"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf: str):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{sf}/{t}.parquet'")
    return c


def rows_of(frame) -> list[tuple]:
    """Rows as sorted tuples of text, columns in order of their names, floats to six digits."""
    frame = frame[sorted(frame.columns)]
    clean = lambda v: "" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(clean(v) for v in r) for r in frame.itertuples(index=False, name=None))
