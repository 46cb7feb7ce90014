"""Every query against its DuckDB oracle on the smallest tables."""

import os

import pytest
from oracle import SF, duck, same_rows

from tessera.plans.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name in ORACLE_SQL:
        rel = con.sql(ORACLE_SQL[name])
        assert same_rows(rows, df.columns, rel.fetchall(), list(rel.columns))
    else:
        assert rows


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_training_data_operators():
    """The library and the entry import without the subpackage and the pipeline."""
    import subprocess
    import sys

    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("tessera.llm") or name == "corpus_pipeline":
            raise ImportError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert e.llm is None and e.corpus_pipeline is None and len(e.queries()) > 30 and e.oracle_sql()
"""
    assert subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), timeout=120).returncode == 0


@pytest.mark.parametrize("name", ["q09_chunks", "q10_chunks_with_boundaries", "q11_chunk_stats_by_lang"])
def test_chunked_documents(spark, tmp_path, name):
    """A document is chunked by its own length, whatever ends its lines."""
    import duckdb

    words = "Thin word " * 9
    texts = ["a" * 98 + "\n\n\n" + "b" * 98, "a" * 99 + "\n" + "b" * 99, "a" * 99 + "\n" + "b" * 100, " \n" + "a" * 99 + "\n" + "b" * 98 + "\n\n", "", None]
    texts += [end.join([words + str(i) for i in range(60)]) for end in ("\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x85", "\u2028", "\u2029", "\n\r\n")]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    df, rel = QUERIES[name](spark, str(tmp_path)), con.sql(ORACLE_SQL[name])
    assert same_rows(df.collect(), df.columns, rel.fetchall(), list(rel.columns))
