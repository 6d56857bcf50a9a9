"""The stages of the pipeline, each on what its predecessor kept."""

import hashlib

import pytest

import corpus_pipeline
from quarry.llm import decontaminate, queries, secret_scan, verified, weak_quality


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    model = weak_quality.train(docs)
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    want = [{r.doc_id for r in weak_quality.classify(docs, model).collect() if r.keep}]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf).cache()
        ids = sorted(r.doc_id for r in out.select("doc_id").collect())
        if k == 0:
            assert set(ids) == want[0]
        elif k == 1:
            found = verified.verified_duplicates(docs).collect()
            assert ids == sorted({r.component_id for r in found})
        elif k == 2:
            bad = {r.doc_id for r in decontaminate.find_overlap(docs, bench).collect() if r.contaminated}
            assert bad and set(ids) == {r.doc_id for r in docs.collect()} - bad
        else:
            assert ids == sorted(r.doc_id for r in docs.select("doc_id").collect())
        if k == 3:
            assert not any(r.base for r in secret_scan.find_secrets(out).select("base").collect())
        if k < 4:
            assert out.dtypes == docs.dtypes
        else:
            texts = {r.doc_id: r.text for r in docs.collect()}
            assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() and len(r.ids) == r.n_tokens for r in out.collect())
        docs = out


def test_run_is_the_stages_in_order(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "simhash_near_dedup", "benchmark_decontamination", "secret_scan", "bpe_encoding"]
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 50 and "ids_sha256" in out.columns


def test_a_run_goes_on_after_its_last_stage(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "shared_folder", lambda _: str(tmp_path))
    ran = []

    def stage(name, fails=()):
        def work(spark, docs, sf_dir):
            ran.append(name)
            if name in fails:
                raise RuntimeError(name)
            return docs.where(f"doc_id <> {ord(name)}")

        return name, work

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    monkeypatch.setattr(corpus_pipeline, "STAGES", [stage("a"), stage("b"), stage("c", "c"), stage("d")])
    with pytest.raises(RuntimeError):
        corpus_pipeline.run(spark, sf, "one")
    monkeypatch.setattr(corpus_pipeline, "STAGES", [stage(n) for n in "abcd"])
    out = corpus_pipeline.run(spark, sf, "one")
    assert ran == ["a", "b", "c", "c", "d"]
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()} - set(map(ord, "abcd"))
    assert sorted(p.name for p in (tmp_path / "corpus_pipeline-one").iterdir()) == ["2_c"]
    corpus_pipeline.remove(spark, "one")
    assert not (tmp_path / "corpus_pipeline-one").exists()


def test_stages_on_empty_and_odd_tables(spark, sf):
    """No stage fails on an empty table, or on null and repeated rows and columns with the names that it uses itself."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None, "x", 1), (1, "", "en", "s", 0, "y", 2), (1, "", "en", "s", 0, "y", 2), (2, "a b", None, "s", 3, "z", 3)], docs.schema.simpleString()[7:-1].replace(":", " ") + ", keep string, digest int")
    for table in (odd.limit(0), odd):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, table, sf)
            n = out.count()
            assert n <= table.count()
            if k < 4:
                assert out.columns == table.columns
            if k == 1 and n:
                assert sorted(map(str, (r.doc_id for r in out.collect()))) == ["1", "2", "None"]


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_run(spark, sf, name):
    out = queries.queries()[name](spark, sf)
    assert out.count() > 0


def test_queries_equal_their_sql(spark, sf):
    import duckdb

    db = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        db.sql(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    for name, sql in queries.oracle_sql().items():
        out = queries.queries()[name](spark, sf)
        names = sorted(out.columns)
        want = db.sql(sql)
        assert sorted(want.columns) == names
        assert sorted(map(repr, (tuple(r[c] for c in names) for r in out.collect()))) == sorted(map(repr, want.project(", ".join(names)).fetchall()))
