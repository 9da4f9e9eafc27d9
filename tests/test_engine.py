"""The engine end to end: compile, load, search, vote, delta, compaction, streaming."""

import uuid

import numpy as np
import pyarrow as pa
import pytest

from stratavec.functions.spec import FLOAT, ONE_BIT, TWO_BIT, IndexSpec, UnsupportedLayout
from stratavec.functions.transform import back_project, oriented
from stratavec.operators import knn, prepare, voting
from stratavec.operators.delta import Delta
from stratavec.plans.engine import Engine, IndexNotFound, InvalidOperation, NotInitialized
from stratavec.sources import interop
from stratavec.sources.index import Index, build, concatenated
from stratavec.streaming import oplog


def frame(spark, x, ids=None):
    ids = np.arange(len(x)) if ids is None else np.asarray(ids)
    return spark.createDataFrame(pa.table({"id": pa.array(ids.astype(np.int64)), "vector": pa.array(list(np.asarray(x, np.float32)), pa.list_(pa.float32()))}))


def vectors(n, dim, seed=0):
    x = np.random.default_rng(seed).standard_normal((n, dim))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def ids(rows, qid=0):
    return [r["id"] for r in sorted(rows.collect(), key=lambda r: (r["qid"], r["rank"])) if r["qid"] == qid]


def test_folders(spark, monkeypatch, tmp_path):
    from stratavec import session

    class Far:
        def __init__(self, master, folder=None):
            self.sparkContext, self.conf, self.master, self.folder = self, self, master, folder

        def get(self, key, default=None):
            return self.folder or default

        def getConf(self):
            return self

    assert session.shared_folder(Far("local[8]")) == session.LOCAL_CHECKPOINTS and session.shared_folder(Far("spark://a:7077", "s3://x/y")) == "s3://x/y"
    with pytest.raises(ValueError):
        session.shared_folder(Far("spark://a:7077"))
    table = session.stored(spark.range(5), "five")
    session.discard(table, spark.range(3))
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FILE_NOT_EXIST|does not exist"):
        spark.read.parquet(table._stored_path).count()


def test_three_known_vectors(spark, tmp_path):
    spec = IndexSpec(128, (64, 128), planet_id=1, radius=1737400)
    z = np.stack([np.full(128, -1.0), np.ones(128), np.full(128, -0.2)])
    z[:, 63] = 1
    engine = Engine(spark)
    engine.compile_index(frame(spark, back_project(z, spec)), str(tmp_path / "i"), spec)
    engine.load_index("i", str(tmp_path / "i"))
    info = engine.info("i")
    assert (info["size"], info["dim"], info["tiers"], info["radius"]) == (3, 128, [64, 128], 1737400)
    assert ids(engine.batch_search("i", back_project(np.full((1, 128), 0.9), spec), 2)) == [1, 2]
    padded = engine.batch_search("i", back_project(np.full((1, 128), 0.9), spec), 5, pad=True)
    assert sorted(r["id"] for r in padded.collect()) == [-1, -1, 0, 1, 2]
    engine.close()
    with pytest.raises(NotInitialized):
        engine.info("i")


@pytest.mark.parametrize("mode", [ONE_BIT, TWO_BIT, FLOAT])
@pytest.mark.parametrize("half", [True, False])
def test_self_comes_first(spark, mode, half):
    x = vectors(300, 128)
    index = Index(build(frame(spark, x), IndexSpec(128, (64, 128), mode, half)), IndexSpec(128, (64, 128), mode, half))
    found = knn.batch_search(index, x[:5], 3)
    assert [ids(found, q)[0] for q in range(5)] == [0, 1, 2, 3, 4]
    assert knn.batch_search(index, x[:0], 3).isEmpty() and knn.batch_search(index, x[:1], 0).isEmpty()


def test_narrow_dimensions_and_partition_invariance(spark):
    x = vectors(200, 32, 1)
    spec = IndexSpec(32, (16, 32))
    rows = build(frame(spark, x), spec)
    found = [sorted(map(tuple, knn.batch_search(Index(rows.repartition(n), spec), x[:4], 5).select("qid", "rank", "id").collect())) for n in (1, 7)]
    assert found[0] == found[1]


def test_last_tier_is_no_pruning(spark):
    x, spec = vectors(150, 128, 2), IndexSpec(128, (64, 128))
    rows = build(frame(spark, x), spec)
    whole = knn.batch_search(Index(rows, spec, budget=1.0), x[:3], 4)
    one = knn.batch_search(Index(rows, spec, budget=0.5), x[:3], 4, candidates=150)
    assert sorted(map(tuple, whole.select("qid", "rank", "id").collect())) == sorted(map(tuple, one.select("qid", "rank", "id").collect()))


def test_large_batches_are_asked_in_blocks(spark, monkeypatch):
    x, spec = vectors(200, 64, 12), IndexSpec(64, (64,))
    index = Index(build(frame(spark, x), spec), spec)
    asked = frame(spark, x[:24]).selectExpr("id AS qid", "vector AS qvec")
    votes = prepare.vote_batch(asked, 8, 28)

    def results():
        base = frame(spark, x)
        frames = knn.batch_search(index, asked, 4), knn.exact_knn(base, asked, 4, 64), knn.hamming_pairs(index, asked), knn.row_profile(index, asked, 5), knn.row_profile(index, asked, 99), voting.query_grid(index, votes), voting.radius_vote(base, votes, 64)
        return [sorted(map(tuple, f.collect()), key=str) for f in frames]

    whole = results()
    monkeypatch.setattr(knn, "QUERY_BYTES", 4 * 64 * 10)
    assert len(knn.blocks(asked, 64)) == 5
    assert results() == whole
    with pytest.raises(ValueError):
        knn.collect_queries(asked, 64)


def test_candidates_are_pushed_down_to_the_payload(spark, tmp_path):
    spec = IndexSpec(64, (64,))
    engine = Engine(spark)
    engine.compile_index(frame(spark, vectors(3000, 64)), str(tmp_path / "p"), spec)
    index = engine.load_index("p", str(tmp_path / "p"))
    assert "vec_h" not in index.rows.columns and index.has_half
    found = knn.Candidates(np.array([5, 6, 7, 2000, 2001]), np.zeros(5, np.int64), np.zeros(5))
    rows = knn.candidate_rows(index, found, "vec_h")
    plan = rows._jdf.queryExecution().toString().split("PushedFilters: ")[-1]
    assert plan.startswith("[Or(And(GreaterThanOrEqual(row_idx,5),LessThanOrEqual(row_idx,7)),And(GreaterThanOrEqual(row_idx")  # the plan's text is cut off there
    assert sorted(r["row_idx"] for r in rows.collect()) == [5, 6, 7, 2000, 2001]
    dense = knn.candidate_rows(index, knn.Candidates(np.arange(100, 200, 2), np.zeros(50, np.int64), np.zeros(50)), "vec_h")
    assert set(range(100, 200, 2)) <= {r["row_idx"] for r in dense.collect()} <= set(range(100, 200))


def test_ranges_hold_all_values(spark):
    rng = np.random.default_rng(3)
    for most in (1, 2, 5, 64):
        values = np.unique(rng.integers(0, 500, 60))
        kept = spark.range(500).filter(knn.between("id", values, most)).toPandas()["id"].to_numpy()
        assert set(values.tolist()) <= set(kept.tolist()) and (most < 60 or set(kept.tolist()) == set(values.tolist()))
    assert spark.range(5).filter(knn.between("id", np.zeros(0, np.int64))).count() == 0


@pytest.mark.parametrize("mode", [ONE_BIT, TWO_BIT, FLOAT])
@pytest.mark.parametrize("half", [True, False])
def test_many_candidates_are_joined_by_a_shuffle(spark, monkeypatch, mode, half):
    x, spec = vectors(400, 128, 11), IndexSpec(128, (64, 128), mode, half)
    index = Index(build(frame(spark, x), spec), spec)
    found = [sorted(map(tuple, knn.batch_search(index, x[:6], 7).collect()))]
    monkeypatch.setattr(knn, "CANDIDATE_BYTES", 0)
    found.append(sorted(map(tuple, knn.batch_search(index, x[:6], 7).collect())))
    assert len(found[0]) == 42 and [r[:4] for r in found[0]] == [r[:4] for r in found[1]]


def test_plan_prunes_and_pushes(spark, tmp_path):
    spec = IndexSpec(128, (64, 128))
    engine = Engine(spark)
    engine.compile_index(frame(spark, vectors(50, 128)), str(tmp_path / "p"), spec)
    index = engine.load_index("p", str(tmp_path / "p"))
    index.budget = 0.5
    plan = knn.scan(index, knn.collect_queries(vectors(2, 128), 128), 10)._jdf.queryExecution().toString()
    assert "w0" in plan and "w1" not in plan.split("ReadSchema")[-1] and "vec_h" not in plan.split("ReadSchema")[-1]


@pytest.mark.parametrize("mode", [ONE_BIT, TWO_BIT])
def test_canary_and_both_vote_paths(spark, monkeypatch, mode):
    spec = IndexSpec(384, (64, 128, 256, 384), mode)
    x = vectors(400, 384, 3)
    canary = oriented(vectors(1, 384, 4), spec)
    x[[10, 200, 399]] = canary
    index = Index(build(frame(spark, x), spec), spec)
    queries = spark.createDataFrame([(i, canary[0].tolist(), i, 0) for i in range(8)] + [(8, canary[0].tolist(), 9, 400)], "qid long, qvec array<float>, family int, threshold int")
    a = sorted(map(tuple, voting.query_grid(index, queries).collect()))
    monkeypatch.setattr(voting, "LITERAL_TERMS", 0)
    b = sorted(map(tuple, voting.query_grid(index, queries).collect()))
    assert a == b
    if mode == ONE_BIT:
        assert [r[1] for r in a if r[2] == 255] == [10, 200, 399] and sum(r[3] >= 5 for r in a) == 3
    with pytest.raises(UnsupportedLayout):
        voting.query_grid(Index(index.rows, IndexSpec(384, (384,), FLOAT)), queries)


def test_delta_life(spark, tmp_path):
    engine, spec = Engine(spark), IndexSpec(64, (64,))
    x = vectors(10, 64)
    engine.compile_index(frame(spark, x), str(tmp_path / "b"), spec)
    engine.load_index("b", str(tmp_path / "b"))
    with pytest.raises(IndexNotFound):
        engine.insert("b", frame(spark, x))
    path = str(tmp_path / "log")
    delta = engine.create_delta("b", 2, path)
    new = vectors(3, 64, 9)
    engine.insert("b", frame(spark, new, [1000, 2000, 3000]))
    assert engine.delete("b", [2000, 777]) == [2000] and engine.delete("b", [2000]) == []
    assert (engine.delta_size("b"), delta.total(), engine.needs_flush("b")) == (2, 3, True)
    assert Delta(spark, path, 64, 2).size() == 2
    assert ids(engine.search_merged("b", new[:1], 3))[0] == 1000
    assert 2000 not in ids(engine.search_merged("b", new[1:2], 10))
    with pytest.raises(ValueError):
        engine.insert("b", frame(spark, vectors(1, 32)))
    engine.backup_delta("b", str(tmp_path / "dump"))
    assert engine.restore_delta("b", str(tmp_path / "dump")).size() == 2
    engine.flush("b")
    assert engine.size("b") == 12 and engine.delta_size("b") == 0
    assert ids(engine.batch_search("b", new[2:], 1)) == [3000]
    with pytest.raises(InvalidOperation):
        engine.set_energy_budget("b", 0)
    engine.drop("b")
    with pytest.raises(IndexNotFound):
        engine.size("b")


def test_compaction(spark, tmp_path):
    spec, x = IndexSpec(64, (64,)), vectors(100, 64, 5)
    engine = Engine(spark)
    for name, a, b in (("a", 0, 50), ("b", 50, 100)):
        engine.compile_index(frame(spark, x[a:b], np.arange(a, b)), str(tmp_path / name), spec)
    engine.compact([str(tmp_path / "a"), str(tmp_path / "b")], str(tmp_path / "c"))
    whole = engine.load_index("c", str(tmp_path / "c"))
    assert engine.size("c") == 100 and sorted(r[0] for r in whole.rows.select("row_idx").collect()) == list(range(100))
    direct = Index(build(frame(spark, x), spec), spec)
    assert sorted(map(tuple, knn.batch_search(whole, x[:3], 5).drop("dist").collect())) == sorted(map(tuple, knn.batch_search(direct, x[:3], 5).drop("dist").collect()))
    plain = IndexSpec(64, (64,), half=False)
    mixed = concatenated([direct, Index(build(frame(spark, x), plain), plain)])
    assert not mixed.has_half and mixed.size() == 200
    with pytest.raises(UnsupportedLayout):
        concatenated([direct, Index(direct.rows, IndexSpec(64, (32, 64)))])
    with pytest.raises(ValueError):
        engine.compile_index(frame(spark, x[:0]), str(tmp_path / "d"), spec)


def test_half_vector_does_not_change_votes(spark):
    x = vectors(100, 64, 6)
    queries = prepare.vote_batch(frame(spark, x[:16]).selectExpr("id AS qid", "vector AS qvec"), 8, 28)
    masks = [sorted(map(tuple, voting.query_grid(Index(build(frame(spark, x), s), s), queries).collect())) for s in (IndexSpec(64, (64,), half=h) for h in (True, False))]
    assert masks[0] == masks[1]


def test_column_files(spark, tmp_path):
    spec, x = IndexSpec(128, (64, 128), TWO_BIT), vectors(20, 128, 7)
    rows = build(frame(spark, x), spec).orderBy("row_idx").toPandas()
    paths = {}
    for name, raw in {"ids": rows["id"].to_numpy("<i8").tobytes(), "meta": rows["meta"].to_numpy("<i8").tobytes(), "half": interop.half_bytes(x), "t0": interop.tier_bytes([rows["s0"].to_numpy(), rows["m0"].to_numpy()], TWO_BIT), "t1": interop.tier_bytes([rows["s1"].to_numpy(), rows["m1"].to_numpy()], TWO_BIT)}.items():
        (tmp_path / name).write_bytes(raw)
        paths[name] = str(tmp_path / name)
    back = interop.read_columns(spark, paths["ids"], paths["meta"], [paths["t0"], paths["t1"]], spec, paths["half"])
    assert sorted(map(tuple, back.select("row_idx", "id", "s0", "m0", "s1", "m1", "is_live").collect())) == sorted(rows[["row_idx", "id", "s0", "m0", "s1", "m1", "is_live"]].itertuples(index=False, name=None))
    (tmp_path / "v.fvecs").write_bytes(interop.vecs_bytes(x))
    (tmp_path / "wal.bin").write_bytes(interop.log_bytes([(1, 5, x[0]), (2, 5, None)]))
    (tmp_path / "v.npy").write_bytes(interop.npy_bytes(x))
    assert np.allclose([r["vector"] for r in interop.read_vecs(spark, str(tmp_path / "v.fvecs")).orderBy("row").collect()], x)
    assert [r["op"] for r in interop.read_log(spark, str(tmp_path / "wal.bin"), 128).orderBy("seq").collect()] == [1, 2]
    assert interop.read_npy(spark, str(tmp_path / "v.npy")).count() == 20


def test_streamed_log(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "log")
    ddl = "seq long, op int, id long, vector array<float>, ts timestamp"
    v = vectors(2, 8)
    import datetime as dt

    rows = [(1, 1, 10, v[0].tolist(), dt.datetime(2024, 1, 1, 0, 1)), (2, 1, 11, v[1].tolist(), dt.datetime(2024, 1, 1, 0, 2)), (3, 2, 10, None, dt.datetime(2024, 1, 1, 0, 7)), (4, 1, 12, [1.0], dt.datetime(2024, 1, 1, 0, 8)), (5, 9, 12, None, None)]
    spark.createDataFrame(rows, ddl).write.parquet(source)
    for _ in range(2):
        oplog.ingest(spark.readStream.schema(ddl).parquet(source), target, str(tmp_path / "cp"), 8).awaitTermination()
    assert [r["id"] for r in oplog.current(spark, target).collect()] == [11]
    name = f"activity_{uuid.uuid4().hex}"
    q = oplog.activity(spark.readStream.schema(ddl).parquet(source).filter("ts IS NOT NULL")).writeStream.format("memory").queryName(name).outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["inserts"], r["deletes"]) for r in spark.table(name).collect()) == [(1, 1), (2, 0)]
