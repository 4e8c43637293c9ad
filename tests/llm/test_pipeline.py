import types
import weakref

import duckdb

import corpus_pipeline
from lamina.llm import common, decontam, langid, pfor
from lamina.llm import queries as q
from lamina.llm.common import staged


def test_stages(spark, small):
    docs = q.table(spark, small, "documents")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = staged(stage(spark, docs, small), "test-stage")
        rows, before = out.collect(), docs.collect()
        if k < 4:
            assert out.columns == columns
        if k == 0:
            assert {r["doc_id"] for r in before} - {r["doc_id"] for r in rows} == {r["doc_id"] for r in before if not langid.has_letter(r["text"])}
        if k == 1:
            texts = [r["text"].lower().split() for r in rows]
            assert len({tuple(t) for t in texts}) == len(texts)
            gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in rows}
            kept = {tuple(t) for t in texts}
            assert all(tuple(r["text"].lower().split()) in kept for r in before if r["doc_id"] not in gone)
        if k == 2:
            leaked = {r["doc_id"] for r in decontam.leaks(docs, q.table(spark, small, "benchmark")).collect()}
            assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in before} - leaked
        if k == 3:
            assert {tuple(r) for r in rows} <= {tuple(r) for r in before}
            words = sum(len(r["text"].split()) for r in before)
            assert abs(sum(len(r["text"].split()) for r in rows) - 1.5 * words) < 0.1 * words
        if k == 4:
            assert len(rows) == len(before) and sorted(r["start"] for r in rows)[0] == 0
        docs = out


def test_oracles(spark, small):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    for name, sql in q.ORACLES.items():
        got = q.QUERIES[name](spark, small)
        found = con.execute(sql)
        columns = [d[0] for d in found.description]
        assert sorted(columns) == sorted(got.columns)
        assert sorted(map(str, ([*r] for r in got.select(*columns).collect()))) == sorted(map(str, ([*r] for r in found.fetchall())))


def test_language_stage_rejects_what_no_language_explains(spark, small, docs_of):
    rows = [r["text"] for r in q.table(spark, small, "documents").where("lang = 'en'").collect()]
    odd = ["Привет мир, это русский язык и текст", "これは日本語の文章です", "qzxv wkjq xxzq vvkj qqqz", "## 123 ::", None]
    docs = docs_of([(i, t) for i, t in enumerate(rows)] + [(-1 - i, t, None) for i, t in enumerate(odd)])
    assert {r["doc_id"] for r in corpus_pipeline.known_language(spark, docs, small).collect()} == {i for i, t in enumerate(rows) if langid.has_letter(t)}


def test_language_stage_without_labels(spark, small, docs_of):
    docs = docs_of([(0, "The cat sleeps", None), (1, "Le chat dort", None), (2, "123", None)])
    assert {r["doc_id"] for r in corpus_pipeline.known_language(spark, docs, small).collect()} == {0, 1}


def test_worker_keeps_one_operator_at_a_time():
    kept = weakref.ref(pfor.encoder(q.tokenizer_path()))
    assert pfor.encoder(q.tokenizer_path()) is kept()
    decontam.parse("some words here")
    assert kept() is None
    words = weakref.ref(common.kept_by_worker("decontam", decontam.Words))
    assert words().known
    list(langid.n_grams(["text"]))
    assert words() is None


def test_language_stage_passes_texts_in_small_batches(spark, docs_of, monkeypatch):
    class Few:
        def knows_all(self, texts):
            assert len(texts) <= 1024
            return [t != "odd" for t in texts]

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda _, x: types.SimpleNamespace(value=x))  # plain pickle bears no local class
    docs = docs_of([(i, "odd" if i % 7 == 0 else f"text {i}") for i in range(3072)] + [(-1, None)]).coalesce(1)
    rows = langid.known(docs, Few()).collect()
    assert sorted(r["doc_id"] for r in rows) == [i for i in range(3072) if i % 7]
