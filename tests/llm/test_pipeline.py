"""The corpus pipeline against its operators, and on odd tables."""

import corpus_pipeline
from tests.conftest import SF

from .conftest import EDGES
from .test_dedup import brute_components, brute_passages
from .test_texts import check_packing


def test_pipeline_matches_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, [(r["doc_id"], r["text"]) for r in docs.collect()]
    frames = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        frames.append(docs)
        if i < 4:
            assert docs.columns == columns, name
    rows = [{r["doc_id"]: r["text"] for r in f.select("doc_id", "text").collect()} for f in frames[:4]]
    assert all(any(c.isalpha() for c in t or "") for t in rows[0].values()) and len(rows[0]) > 0.97 * len(kept)
    largest = {}
    for i, t in rows[0].items():
        largest[t] = max(i, largest.get(t, i))
    assert rows[1] == {i: t for t, i in largest.items()}
    assert set(rows[2]) == {c for _, c in brute_components(rows[1].items()).values()}
    cut = brute_passages(rows[2].items())
    assert set(rows[3]) == set(rows[2]) and all(cut[i][1] > 0 or rows[3][i] == t for i, t in rows[2].items())
    assert all(len(rows[3][i].encode()) <= cut[i][0] - cut[i][1] for i in rows[3])
    check_packing(frames[4].collect(), rows[3].items())


def test_pipeline_odd_tables(spark, edges, none):
    """Columns that clash but for case can't be written as Parquet, so each stage's rows are kept under plain names."""
    for docs in (edges, none):
        columns, empty = docs.columns, docs.isEmpty()
        for _, stage in corpus_pipeline.STAGES[:4]:
            plain = stage(spark, docs, SF).toDF(*[f"c{k}" for k in range(len(columns))])
            docs = spark.createDataFrame(plain.collect(), plain.schema).toDF(*columns)
            assert docs.count() <= len(EDGES)
        texts = [r[1] for r in docs.toDF(*[f"c{k}" for k in range(len(columns))]).collect()]
        assert len(texts) == len(set(texts)) == (0 if empty else 5)
        assert corpus_pipeline.STAGES[4][1](spark, docs, SF).isEmpty() == empty


def test_language_stage_rejects_strange_texts(spark):
    """However few languages are learned, from two on."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) > 200")
    strange = spark.createDataFrame([(-1, "中文文本测试这是一个句子 " * 9), (-2, "η γρήγορη καφέ αλεπού πηδάει πάνω από το σκυλί " * 5)], "doc_id long, text string")
    for langs in (["en", "de"], ["en", "de", "fr"], ["en", "de", "fr", "es"]):
        rows = docs.filter(docs["lang"].isin(langs))
        kept = {r[0] for r in corpus_pipeline.language(spark, rows.unionByName(strange, allowMissingColumns=True), SF).select("doc_id").collect()}
        assert not kept & {-1, -2} and len(kept) > 0.97 * rows.count()


def test_run_is_registered(spark):
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is corpus_pipeline.run and len(corpus_pipeline.STAGES) == 5
