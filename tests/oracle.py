"""Comparison with DuckDB."""

SF = "/root/testdata/sf0.001"


def same_rows(spark_rows, columns, oracle, oracle_columns):
    """Whether two results hold the same rows, columns by name, floats to six places."""

    def plain(v):
        if isinstance(v, bool) or v is None:
            return v
        if isinstance(v, float) or type(v).__name__ == "Decimal":
            return round(float(v), 6)
        return int(v) if type(v).__name__.startswith("int") else v

    order = sorted(columns)
    assert order == sorted(oracle_columns)
    a = sorted((tuple(plain(r[c]) for c in order) for r in spark_rows), key=str)
    b = sorted((tuple(plain(dict(zip(oracle_columns, r, strict=True))[c]) for c in order) for r in oracle), key=str)
    return a == b


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con
