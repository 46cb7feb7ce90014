"""Sources, sinks and manifests."""

import pytest

from tessera.sources import readers, writers
from tessera.sources.manifest import Manifest, completed
from tessera.streaming.incremental import run_incremental


def test_json_forms(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1, "b": "x"}\n\n{"a": 2, "b": null}\n')
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n{nope\n{"a": 3}\n')
    (tmp_path / "c.json").write_text('\n [{"a": 1},\n {"a": 2}]')
    schema = "a int, b string"
    assert readers.read_jsonl(spark, str(tmp_path / "a.jsonl"), schema).count() == 2
    with pytest.raises(Exception):
        readers.read_jsonl(spark, str(tmp_path / "bad.jsonl"), schema).collect()
    assert sorted(r.a for r in readers.read_jsonl_tolerant(spark, str(tmp_path / "bad.jsonl"), schema).collect()) == [1, 3]
    assert readers.read_records(spark, str(tmp_path / "c.json"), schema).count() == 2
    assert readers.read_records(spark, str(tmp_path / "a.jsonl"), schema).count() == 2
    (tmp_path / "d.json").write_text('[{"a": 9}]')
    rows = readers.read_union(spark, str(tmp_path / "[cd].json"), schema).orderBy("seq").collect()
    assert [r.a for r in rows] == [1, 2, 9]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "vi")], "a int, legal_domain string")
    writers.write_jsonl(df, str(tmp_path / "o"))
    assert '"legal_domain":null' in "".join(p.read_text() for p in (tmp_path / "o").glob("part-*"))
    writers.write_records(df, str(tmp_path / "o.json"))
    assert readers.read_records(spark, str(tmp_path / "o.json"), "a int").count() == 2
    with pytest.raises(ValueError):
        writers.write_records(df, str(tmp_path / "p.json"), most=1)
    writers.write_by_domain(df, str(tmp_path / "d"))
    assert {r.legal_domain for r in spark.read.parquet(str(tmp_path / "d")).collect()} == {"general", "vi"}
    writers.append_parquet(df, str(tmp_path / "q"))
    writers.append_parquet(df, str(tmp_path / "q"))
    assert spark.read.parquet(str(tmp_path / "q")).count() == 4
    writers.copy_table(df, str(tmp_path / "r"))
    assert readers.read_results(spark, str(tmp_path / "r")).count() == 2


def test_files(spark, tmp_path):
    for folder, names in (("x", ["b.pdf", "a.pdf", "c.txt"]), ("y", ["a.pdf"])):
        (tmp_path / folder).mkdir()
        for n in names:
            (tmp_path / folder / n).write_bytes(b"%PDF " + n.encode() * 40)
    folders = [str(tmp_path / f) for f in ("x", "missing", "y")]
    found = readers.discover_files(spark, folders)
    assert [(r.folder, r.name) for r in found.collect()] == [(0, "a.pdf"), (0, "b.pdf"), (1, "a.pdf")]
    assert readers.discover_files(spark, [str(tmp_path / "missing")]).count() == 0

    def parser(path, content):
        if path.endswith("b.pdf"):
            raise ValueError(path)
        return content.decode()

    parsed = readers.parse_files(spark, folders, parser)
    assert sorted(r.markdown is None for r in parsed.collect()) == [False, False, True]
    calls = []

    def parse(missing):
        calls.append(missing.count())
        return readers.parse_files(spark, folders, parser).join(missing.select("path"), "path", "left_semi")

    cache = str(tmp_path / "cache")
    assert readers.with_cache(spark, found, cache, parse).count() == 2
    assert readers.with_cache(spark, found, cache, parse).count() == 2 and calls == [3, 1]  # what fails is asked again


def test_manifest(spark, tmp_path):
    m = Manifest(spark, str(tmp_path / "m"), "chunk_id string, level string")
    jobs = spark.createDataFrame([("a_b", "c"), ("a", "b_c")], "chunk_id string, level string")
    assert m.pending(jobs).count() == 2
    m.mark(jobs.limit(1))
    assert [tuple(r) for r in m.pending(jobs).collect()] == [("a", "b_c")]  # pairs, not their concatenation
    m.mark(jobs)
    assert m.pending(jobs).count() == 0 and m.done().count() == 2
    assert completed(jobs, jobs, column="chunk_id").count() == 2


def test_incremental(spark, tmp_path):
    source, out, manifest = (str(tmp_path / n) for n in ("in", "out", "done"))
    spark.createDataFrame([("a", "x"), ("b", "y")], "source_doc string, text string").write.parquet(source)
    seen = []

    def process(df):
        seen.append(df.count())
        return df

    run = lambda: run_incremental(spark, spark.read.parquet(source), "source_doc", process, out, manifest)
    run()
    spark.createDataFrame([("c", "z")], "source_doc string, text string").write.mode("append").parquet(source)
    run()
    run()
    assert spark.read.parquet(out).count() == 3 and seen == [2, 1]
