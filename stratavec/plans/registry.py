"""The registered queries over the vector tables.

All work on `embeddings` (vec_id, embedding of 64 values, label). Its rows are records, vec_id is
both id and position. Searches and votes ask for every vec_id divisible by 100, class queries for
every row of the target label.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratavec.functions import energy, transform
from stratavec.functions.spec import FLOAT, ONE_BIT, TWO_BIT, IndexSpec, default_tiers
from stratavec.operators import delta, evaluation, knn, prepare, voting
from stratavec.plans.engine import Engine
from stratavec.plans.oracles import ORACLE_SQL  # noqa: F401
from stratavec.session import shared_folder
from stratavec.sources import interop
from stratavec.sources.index import Index, build, concatenated, tombstoned

DIM = 64
QUERIES = {}
EVERY = 100
THRESHOLD = 26
TARGET = 5


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str = "embeddings") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def asked(spark: SparkSession, sf_dir: str, rows: str = f"vec_id % {EVERY} = 0") -> DataFrame:
    return table(spark, sf_dir).filter(rows).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))


def index(spark: SparkSession, sf_dir: str, q_mode: int = ONE_BIT, tiers: tuple[int, ...] = (DIM,), half: bool = True, budget: float = 0.90) -> Index:
    spec = IndexSpec(DIM, tiers, q_mode, half)
    return Index(build(records(spark, sf_dir).withColumn("row_idx", F.col("id")), spec, row_idx_col="row_idx"), spec, budget=budget)


def votes(spark: SparkSession, sf_dir: str, threshold: int = THRESHOLD) -> DataFrame:
    """Families go in turn by the place in the batch."""
    place = (F.col("qid") / EVERY).cast("long")
    return prepare.vote_batch(asked(spark, sf_dir).withColumn("qid", place), 8, threshold)


def found(rows: DataFrame) -> DataFrame:
    return rows.select("qid", "rank", "id", F.round("dist", 6).alias("dist"))


@query
def encode_popcount(spark, sf_dir):
    """Codes as two halves and their number of ones."""
    rows = index(spark, sf_dir).rows
    return rows.select("id", F.bit_count("w0").alias("ones"), F.shiftrightunsigned("w0", 32).alias("high"), F.col("w0").bitwiseAND(F.lit(0xFFFFFFFF)).alias("low"))


@query
def encode_two_bit(spark, sf_dir):
    """Two-bit codes: ones of sign and mask, and their low halves."""
    rows = index(spark, sf_dir, TWO_BIT).rows
    low = lambda c: F.col(c).bitwiseAND(F.lit(0xFFFFFFFF))
    return rows.select("id", F.bit_count("s0").alias("signs"), F.bit_count("m0").alias("active"), low("s0").alias("s_low"), low("m0").alias("m_low"))


@query
def rotate_round6(spark, sf_dir):
    rows = transform.rotated(records(spark, sf_dir), IndexSpec(DIM))
    return rows.select("id", F.posexplode("vector").alias("i", "z")).select("id", "i", (F.round("z", 6) + 0.0).alias("z"))


@query
def rotate_sql_twin(spark, sf_dir):
    """The rotation as array expressions only; the same rows."""
    spec = IndexSpec(DIM)
    rows = records(spark, sf_dir).select("id", transform.signed(F.col("vector").cast("array<double>"), spec).alias("x"))
    return rows.select("id", F.posexplode(transform.walsh(F.col("x"), DIM)).alias("i", "z")).select("id", "i", (F.round("z", 6) + 0.0).alias("z"))


@query
def l2_norm_check(spark, sf_dir):
    rows = records(spark, sf_dir).select("id", "vector", transform.normalised(F.col("vector").cast("array<double>")).alias("unit"))
    norm = lambda c: F.round(F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, v: a + v.cast("double") * v)), 6)
    return rows.select("id", norm("vector").alias("norm"), norm("unit").alias("unit_norm"))


@query
def back_project_error(spark, sf_dir):
    """Rotated there and back: the input again."""
    spec = IndexSpec(DIM)
    back = transform.rotated(transform.rotated(records(spark, sf_dir), spec), spec, inverse=True)
    return back.select("id", F.posexplode("vector").alias("i", "x")).select("id", "i", (F.round("x", 6) + 0.0).alias("x"))


@query
def half_round(spark, sf_dir):
    rows = records(spark, sf_dir).select("id", F.posexplode("vector").alias("i", "x"))
    return rows.select("id", "i", F.round(transform.half(F.col("x")).cast("double"), 9).alias("h"))


@query
def unpack_bits(spark, sf_dir):
    """Codes unpacked to +1 and -1."""
    rows = index(spark, sf_dir).rows.select("id", F.posexplode(transform.unpacked(F.col("w0"))).alias("i", "b"))
    return rows.select("id", "i", F.col("b").cast("int").alias("b"))


@query
def hamming_knn10(spark, sf_dir):
    pairs = knn.hamming_pairs(index(spark, sf_dir), asked(spark, sf_dir))
    order = Window.partitionBy("qid").orderBy("dist", "row_idx")
    return pairs.withColumn("rank", F.row_number().over(order)).filter("rank <= 10").select("qid", "rank", "id", "dist")


@query
def hamming_matrix_stats(spark, sf_dir):
    pairs = knn.hamming_pairs(index(spark, sf_dir), asked(spark, sf_dir))
    stats = pairs.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.avg("dist").alias("mean"), F.stddev_pop("dist").alias("deviation"), F.min("dist").alias("least"), F.max("dist").alias("most"))
    return stats.select("qid", "n", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"), "least", "most")


@query
def knn_1bit_fp16_k10(spark, sf_dir):
    return found(knn.batch_search(index(spark, sf_dir), asked(spark, sf_dir), 10))


@query
def knn_1bit_asym_k10(spark, sf_dir):
    return found(knn.batch_search(index(spark, sf_dir, half=False), asked(spark, sf_dir), 10))


@query
def knn_2bit_fp16_k10(spark, sf_dir):
    return found(knn.batch_search(index(spark, sf_dir, TWO_BIT), asked(spark, sf_dir), 10))


@query
def knn_2bit_asym_k10(spark, sf_dir):
    return found(knn.batch_search(index(spark, sf_dir, TWO_BIT, half=False), asked(spark, sf_dir), 10))


@query
def knn_fp32_k10(spark, sf_dir):
    return knn.batch_search(index(spark, sf_dir, FLOAT, half=False), asked(spark, sf_dir), 10).select("qid", "rank", "id", "score")


@query
def knn_scores_padded(spark, sf_dir):
    """Whole-number scores, padded: ranks up to 5 for each query."""
    rows = knn.batch_search(index(spark, sf_dir), asked(spark, sf_dir), 5, pad=True)
    return rows.select("qid", "rank", "id", F.round(F.col("score") / 1000).cast("long").alias("score_k"))


@query
def exact_knn10(spark, sf_dir):
    return found(knn.exact_knn(records(spark, sf_dir), asked(spark, sf_dir), 10, DIM))


@query
def recall_at_k(spark, sf_dir):
    """Recall of both code kinds, reranked or not, against exact neighbours."""
    truth = knn.exact_knn(records(spark, sf_dir), asked(spark, sf_dir), 10, DIM)
    out = None
    for name, mode, half in (("1bit_half", ONE_BIT, True), ("1bit_asym", ONE_BIT, False), ("2bit_half", TWO_BIT, True), ("2bit_asym", TWO_BIT, False)):
        got = knn.batch_search(index(spark, sf_dir, mode, half=half), asked(spark, sf_dir), 10)
        for k in (1, 5, 10):
            row = evaluation.recall(truth, got, k).select(F.lit(name).alias("mode"), "k", F.round("recall", 6).alias("recall"))
            out = row if out is None else out.unionByName(row)
    return out


@query
def vote_mask_1bit(spark, sf_dir):
    return voting.query_grid(index(spark, sf_dir), votes(spark, sf_dir))


@query
def vote_mask_2bit(spark, sf_dir):
    return voting.query_grid(index(spark, sf_dir, TWO_BIT), votes(spark, sf_dir, 60))


@query
def vote_ungated(spark, sf_dir):
    return voting.query_grid(index(spark, sf_dir), votes(spark, sf_dir), gates=False)


@query
def resonant_count(spark, sf_dir):
    return voting.resonant(voting.query_grid(index(spark, sf_dir), votes(spark, sf_dir)))


@query
def radius_vote(spark, sf_dir):
    return voting.radius_vote(records(spark, sf_dir), votes(spark, sf_dir), DIM)


def _deleted(index: Index) -> Index:
    return tombstoned(index, F.col("id") % 10 == 0)


@query
def tombstoned_knn(spark, sf_dir):
    return found(knn.batch_search(_deleted(index(spark, sf_dir)), asked(spark, sf_dir), 10))


@query
def tombstoned_vote(spark, sf_dir):
    return voting.query_grid(_deleted(index(spark, sf_dir)), votes(spark, sf_dir))


@query
def tier_budget_knn(spark, sf_dir):
    """Four tiers of 16, of which half the energy needs two; all tiers count in the reranking."""
    rows = knn.batch_search(index(spark, sf_dir, tiers=(16, 32, 48, 64), budget=0.5), asked(spark, sf_dir), 10)
    return found(rows)


def op_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations derived from the last tenth of embeddings: inserts, deletes of every seventh, and some inserted again."""
    rows = table(spark, sf_dir)
    first = rows.count() * 9 // 10
    rows = rows.filter(F.col("vec_id") >= first).select((F.col("vec_id") - first).alias("s"), F.when(F.col("vec_id") % 2 == 1, F.col("vec_id")).otherwise(F.col("vec_id") + 10000).alias("id"), F.col("embedding").alias("vector"))
    insert = rows.select(F.col("s").alias("seq"), F.lit(1).cast("tinyint").alias("op"), "id", "vector")
    delete = rows.filter("s % 7 = 0").select((F.col("s") + 1000000).alias("seq"), F.lit(2).cast("tinyint").alias("op"), "id", F.lit(None).cast("array<float>").alias("vector"))
    again = rows.filter("s % 21 = 0").select((F.col("s") + 2000000).alias("seq"), F.lit(1).cast("tinyint").alias("op"), "id", "vector")
    return insert.unionByName(delete).unionByName(again)


@query
def delta_live(spark, sf_dir):
    return delta.live(op_log(spark, sf_dir)).select("seq", "id", F.size("vector").alias("dim"))


@query
def needs_flush(spark, sf_dir):
    return delta.sizes(op_log(spark, sf_dir), 40)


@query
def delta_knn(spark, sf_dir):
    return found(delta.delta_knn(op_log(spark, sf_dir), asked(spark, sf_dir), 10, DIM))


@query
def search_merged(spark, sf_dir):
    return delta.search_merged(index(spark, sf_dir), op_log(spark, sf_dir), asked(spark, sf_dir), 10).select("qid", "rank", "id", "src")


def _halves(spark, sf_dir) -> list[Index]:
    whole = index(spark, sf_dir)
    half = whole.size() // 2
    low = Index(whole.rows.filter(F.col("id") < half), whole.spec)
    return [low, Index(whole.rows.filter(F.col("id") >= half).withColumn("row_idx", F.col("row_idx") - half), whole.spec)]


@query
def compact_knn(spark, sf_dir):
    """Two halves joined and searched: the whole index's results."""
    rows = knn.batch_search(concatenated(_halves(spark, sf_dir)), asked(spark, sf_dir), 10)
    return rows.select("qid", "rank", "id", "row_idx", F.round("dist", 6).alias("dist"))


def _labelled(spark, sf_dir) -> tuple[Index, DataFrame]:
    """The index, its rows with whether they have the target label; and the rows that have it as queries."""
    whole = index(spark, sf_dir)
    labels = table(spark, sf_dir).select(F.col("vec_id").alias("id"), (F.col("label") == TARGET).alias("target"))
    return Index(whole.rows.join(labels, "id"), whole.spec), asked(spark, sf_dir, f"label = {TARGET}")


def _labelled_pairs(spark, sf_dir) -> DataFrame:
    """Labels stand beside the rows before these meet the queries, so pairs are summed up where they are made."""
    return knn.hamming_pairs(*_labelled(spark, sf_dir), beside=("target",))


@query
def class_distance_stats(spark, sf_dir):
    stats = evaluation.distance_stats(_labelled_pairs(spark, sf_dir), "target")
    return stats.select("target", "n", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"), "least", "most")


@query
def threshold_sweep_f1(spark, sf_dir):
    whole, targets = _labelled(spark, sf_dir)
    rows = knn.row_profile(whole, targets, voting.VOTES).join(whole.rows.select("row_idx", "target"), "row_idx")
    return evaluation.threshold_sweep(rows).select("threshold", "tp", "fp", F.round("f1", 6).alias("f1"))


@query
def confusion(spark, sf_dir):
    """Rows with at least five target queries within 26 bits, against the label."""
    near = _labelled_pairs(spark, sf_dir).groupBy("row_idx").agg(F.max("target").alias("target"), F.count_if(F.col("dist") <= THRESHOLD).alias("n"))
    counts = evaluation.confusion(near, F.col("n") >= 5, F.col("target"))
    return counts.select("tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("precision", "recall_rate", "f1")])


@query
def normal_curve(spark, sf_dir):
    """The normal curves of both classes' distances at 100 points."""
    stats = evaluation.distance_stats(_labelled_pairs(spark, sf_dir), "target").select("target", "mean", "deviation")
    return evaluation.density(stats, "mean", "deviation", 100, 64.0).select("target", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query
def candidate_tradeoff(spark, sf_dir):
    truth = knn.exact_knn(records(spark, sf_dir), asked(spark, sf_dir), 10, DIM)
    rows = evaluation.tradeoff(index(spark, sf_dir), truth, asked(spark, sf_dir), [10, 50, 100])
    return rows.select("k", F.round("reduction", 6).alias("reduction"), F.round("recall", 6).alias("recall"))


@query
def spectral_energy(spark, sf_dir):
    """Cumulative energy of the first two dimensions of all embeddings as weights: a matrix of products with values off its diagonal."""
    x, y = F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double")
    a, b, c = table(spark, sf_dir).agg(F.sum(x * x), F.sum(x * y), F.sum(y * y)).first()
    phi = energy.shares(np.array([[a, b], [b, c]]))
    return spark.createDataFrame([(i + 1, round(float(p), 6)) for i, p in enumerate(phi)], "k int, phi double")


@query
def kron_rotate_w12(spark, sf_dir):
    """A tier of 12: Hadamard of 4 times cosine of 3, on the first 12 values."""
    rows = records(spark, sf_dir).select("id", prepare.sliced(F.col("vector"), 12).alias("vector"))
    rows = transform.rotated(rows, IndexSpec(12, (12,)))
    return rows.select("id", F.posexplode("vector").alias("i", "z")).select("id", "i", (F.round("z", 6) + 0.0).alias("z"))


@query
def replicate_modulo(spark, sf_dir):
    rows = prepare.replicated(table(spark, sf_dir).select(F.col("vec_id").alias("id"), "label"), 1234)
    return rows.select("id", "label")


@query
def replicate_noise(spark, sf_dir):
    rows = prepare.tiled(records(spark, sf_dir), 3, 1e-5)
    return rows.select("id", F.posexplode("vector").alias("i", "v")).select("id", "i", F.round(F.col("v").cast("double"), 6).alias("v"))


@query
def class_shift(spark, sf_dir):
    rows = table(spark, sf_dir).select(F.col("vec_id").alias("id"), prepare.shifted(F.col("embedding"), F.col("label") == 1, dims=8).alias("v"))
    return rows.select("id", F.posexplode("v").alias("i", "v")).select("id", "i", F.round(F.col("v").cast("double"), 5).alias("v"))


@query
def pad_slice(spark, sf_dir):
    """The first 33 dimensions, padded with zeros to 64."""
    rows = records(spark, sf_dir).select("id", transform.padded(prepare.sliced(F.col("vector"), 33)).alias("v"))
    return rows.select("id", F.size("v").alias("dim"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("total"))


@query
def canary_vote(spark, sf_dir):
    """Three rows overwritten by one vector, which eight families ask for at distance 0."""
    first = np.array(table(spark, sf_dir).filter("vec_id = 7").first()["embedding"], np.float32).reshape(1, -1)
    n = table(spark, sf_dir).count()
    spec = IndexSpec(DIM, (DIM,))
    canary = [float(v) for v in transform.oriented(first, spec)[0]]
    rows = prepare.injected(records(spark, sf_dir), [n // 50, n * 2 // 5, n - 1], canary).withColumn("row_idx", F.col("id"))
    asked_ = spark.createDataFrame([(i, canary, i, 0) for i in range(8)], "qid long, qvec array<float>, family int, threshold int")
    return voting.query_grid(Index(build(rows, spec, row_idx_col="row_idx"), spec), asked_).filter("mask <> 0")


def _round_trip(rows: DataFrame, schema: str, there_and_back) -> DataFrame:
    def task(batches):
        for b in batches:
            yield there_and_back(b)

    return rows.mapInArrow(task, schema)


@query
def wal_roundtrip(spark, sf_dir):
    """Each operation's binary record in hexadecimal, and what is read back from it."""

    def coded(b):
        rows = list(zip(*(c.to_pylist() for c in b.columns), strict=True))
        raw = [interop.log_bytes([(op, i, v)]) for _, op, i, v in rows]
        back = list(interop.parse_log(b"".join(raw), DIM))
        columns = [pa.array([r[1] for r in back], pa.int32()), pa.array([r[2] for r in back], pa.int64()), pa.array([r.hex().upper() for r in raw]), pa.array([float(np.sum(r[3], dtype=np.float64)) if r[3] else 0.0 for r in back])]
        return pa.RecordBatch.from_arrays([b.column(0), *columns], names=["seq", "op", "id", "record", "total"])

    rows = _round_trip(op_log(spark, sf_dir).select("seq", "op", "id", "vector"), "seq long, op int, id long, record string, total double", coded)
    return rows.withColumn("total", F.round("total", 6))


@query
def fvecs_roundtrip(spark, sf_dir):
    """Each vector's row of a file in hexadecimal, and the sum of what is read back."""

    def coded(b):
        raw = interop.vecs_bytes(transform.matrix(b.column(1), DIM))
        back, size = interop.parse_vecs(raw), 4 + 4 * DIM
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([raw[i : i + size].hex().upper() for i in range(0, len(raw), size)]), pa.array(back.astype(np.float64).sum(1))], names=["id", "record", "total"])

    return _round_trip(records(spark, sf_dir), "id long, record string, total double", coded).select("id", "record", F.round("total", 6).alias("total"))


@query
def header_roundtrip(spark, sf_dir):
    """A header's 64 bytes in hexadecimal, and what is read back from them."""
    spec = IndexSpec(DIM, (16, 64), TWO_BIT, False, 1, 1737400)
    raw = interop.header_bytes(spec, records(spark, sf_dir).count())
    back, n = interop.parse_header(raw)
    return spark.createDataFrame([(raw.hex().upper(), back.dim, n, json.dumps(list(back.tiers)), back.q_mode, back.planet_id, back.radius)], "raw string, dim int, n long, tiers string, q_mode int, planet_id int, radius long")


@query
def column_bytes(spark, sf_dir):
    """Each row's bytes in the files of ids, meta, the tier and half vectors, in hexadecimal."""

    def coded(b):
        words, half = b.column(2).to_numpy(), transform.matrix(b.column(3), DIM)
        tier, sides = interop.tier_bytes([words], ONE_BIT), interop.half_bytes(half)
        longs = [b.column(i).to_numpy().astype("<i8").tobytes() for i in (0, 1)]
        cut = lambda raw, size: pa.array([raw[i : i + size].hex().upper() for i in range(0, len(raw), size)], pa.string())
        return pa.RecordBatch.from_arrays([b.column(0), *(cut(x, 8) for x in (*longs, tier)), cut(sides, 2 * DIM)], names=["id", "id_bytes", "meta_bytes", "tier_bytes", "half_bytes"])

    return _round_trip(index(spark, sf_dir).rows.select("id", "meta", "w0", "vec_h"), "id long, id_bytes string, meta_bytes string, tier_bytes string, half_bytes string", coded)


# the engine and its mutable side


def folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/registry-{uuid.uuid4().hex}"


def engine(spark: SparkSession, sf_dir: str, q_mode: int = ONE_BIT, tiers: tuple[int, ...] = (DIM,), half: bool = True) -> Engine:
    """An engine with one index, "v", compiled to a folder and loaded from it."""
    out, path = Engine(spark), folder(spark)
    out.compile_index(records(spark, sf_dir), path, IndexSpec(DIM, tiers, q_mode, half, 3, 1737400))
    out.load_index("v", path)
    return out


@query
def compiled_knn(spark, sf_dir):
    """A search of an index that was written and loaded."""
    return found(engine(spark, sf_dir).batch_search("v", asked(spark, sf_dir), 10))


@query
def compiled_knn_2bit_asym(spark, sf_dir):
    return found(engine(spark, sf_dir, TWO_BIT, half=False).batch_search("v", asked(spark, sf_dir), 10))


@query
def index_info(spark, sf_dir):
    """What a loaded index says of itself, and its size."""
    e = engine(spark, sf_dir, tiers=(16, 64))
    info = e.info("v")
    return spark.createDataFrame([(info["dim"], info["size"], e.size("v"), info["planet_id"], info["radius"], json.dumps(info["tiers"]), info["q_mode"], info["half"])], "dim int, n long, rows long, planet_id int, radius long, tiers string, q_mode int, half boolean")


@query
def single_search(spark, sf_dir):
    """One vector's neighbours."""
    first = np.array(table(spark, sf_dir).filter("vec_id = 0").first()["embedding"], np.float32)
    return engine(spark, sf_dir).search("v", first, 10).select("rank", "id", F.round("dist", 6).alias("dist"))


@query
def knobs_knn(spark, sf_dir):
    """An energy budget and a number of partitions set at run time."""
    e = engine(spark, sf_dir, tiers=(16, 32, 48, 64))
    e.set_energy_budget("v", 0.5)
    e.set_partitions("v", 3)
    return found(e.batch_search("v", asked(spark, sf_dir), 10))


@query
def cuda_alias_knn(spark, sf_dir):
    return found(engine(spark, sf_dir).cuda_batch_search("v", asked(spark, sf_dir), 10))


@query
def cuda_alias_vote(spark, sf_dir):
    masks, n = engine(spark, sf_dir).cuda_query_grid("v", votes(spark, sf_dir))
    return masks.select("row_idx", "id", "mask", "votes", F.lit(n).cast("long").alias("resonant"))


@query
def tier_words(spark, sf_dir):
    """The code column of one tier of four, and the ids and metadata beside it."""
    e = engine(spark, sf_dir, tiers=(16, 32, 48, 64))
    return e.tier_column("v", 1).join(e.ids("v"), "row_idx").join(e.metadata("v"), "row_idx").select("row_idx", "id", "meta", F.col("w1").alias("word"))


@query
def compacted_tombstoned_knn(spark, sf_dir):
    """Two compiled halves, one without half vectors, joined in a file, loaded, and every tenth id deleted."""
    rows, e, paths = records(spark, sf_dir), Engine(spark), [folder(spark) for _ in range(3)]
    half = rows.count() // 2
    for path, part, kept in ((paths[0], F.col("id") < half, True), (paths[1], F.col("id") >= half, False)):
        e.compile_index(rows.filter(part), path, IndexSpec(DIM, (DIM,), ONE_BIT, kept))
    e.compact(paths[:2], paths[2])
    e.load_index("v", paths[2])
    e.tombstone_base("v", F.col("id") % 10 == 0)
    return found(e.batch_search("v", asked(spark, sf_dir), 10))


def mutable(spark: SparkSession, sf_dir: str) -> Engine:
    """Every vector is inserted under a new id, every third once more, every seventh id and one unknown are deleted, and every 21st is inserted again."""
    e, rows = engine(spark, sf_dir), records(spark, sf_dir).withColumn("id", F.col("id") + NEW_IDS)
    place = F.col("id") - NEW_IDS
    e.create_delta("v", 10)
    e.insert("v", rows)
    e.insert("v", rows.filter(place % 3 == 0))
    e.delete_rows("v", rows.filter(place % 7 == 0).select("id").unionByName(spark.createDataFrame([(-1,)], "id long")))
    e.insert("v", rows.filter(place % 21 == 0))
    return e


NEW_IDS = 1_000_000


def _entries(rows: DataFrame) -> DataFrame:
    return rows.select("seq", "id", F.size("vector").alias("dim"), F.round(F.aggregate("vector", F.lit(0.0), lambda a, v: a + v.cast("double")), 6).alias("total"))


@query
def delta_entries(spark, sf_dir):
    return _entries(delta.live(mutable(spark, sf_dir)._delta("v").log()))


@query
def delta_deleted(spark, sf_dir):
    """Which of the ids that were asked to go had any entry."""
    e = mutable(spark, sf_dir)
    every = spark.range(-1, table(spark, sf_dir).count()).select(F.when(F.col("id") < 0, F.lit(-1)).otherwise(F.col("id") + NEW_IDS).alias("id"))
    return every.filter((F.col("id") < 0) | (F.col("id") % 5 == 0)).join(e.delete_rows("v", every.filter((F.col("id") < 0) | (F.col("id") % 5 == 0))).withColumn("found", F.lit(True)), "id", "left").select("id", F.coalesce("found", F.lit(False)).alias("found"))


@query
def delta_counts(spark, sf_dir):
    e = mutable(spark, sf_dir)
    return spark.createDataFrame([(e.delta_size("v"), e._delta("v").total(), e.needs_flush("v"), e.size("v"))], "live long, total long, needs_flush boolean, base long")


@query
def engine_merged(spark, sf_dir):
    return mutable(spark, sf_dir).search_merged("v", asked(spark, sf_dir), 10).select("qid", "rank", "id", "src")


@query
def delta_restored(spark, sf_dir):
    """The entries of a buffer that was restored from a backup."""
    e, path = mutable(spark, sf_dir), folder(spark)
    e.backup_delta("v", path)
    return _entries(delta.live(e.restore_delta("v", path).log()))


@query
def delta_reopened(spark, sf_dir):
    """A log that another buffer opens goes on with its numbers."""
    e = mutable(spark, sf_dir)
    again = e.create_delta("v", 10, e._delta("v").path)
    again.insert(records(spark, sf_dir).filter(F.col("id") % 50 == 0))
    return _entries(delta.live(again.log()).filter(F.col("id") < NEW_IDS))


@query
def delta_drained(spark, sf_dir):
    """The drained entries, and what is left in the buffer."""
    e = mutable(spark, sf_dir)
    rows = e._delta("v").drain()
    return _entries(rows).withColumn("left", F.lit(e.delta_size("v")).cast("long"))


@query
def flushed_rows(spark, sf_dir):
    """All rows of an index after a flush: the base's, then the entries in their order."""
    e = mutable(spark, sf_dir)
    e.flush("v")
    return e.indexes["v"].rows.select("row_idx", "id", F.bit_count("w0").alias("ones"), F.lit(e.delta_size("v")).cast("long").alias("left"))


@query
def engine_lifecycle(spark, sf_dir):
    """What an engine says when names are missing, knobs are wrong, and after it is closed."""
    e, rows = engine(spark, sf_dir), []

    def said(step, f):
        try:
            f()
            rows.append((step, "ok"))
        except Exception as x:  # noqa: BLE001 - the kind of error is the result
            rows.append((step, type(x).__name__))

    said("size", lambda: e.size("v"))
    said("unknown", lambda: e.size("w"))
    said("no delta", lambda: e.insert("v", records(spark, sf_dir)))
    said("budget", lambda: e.set_energy_budget("v", 0.0))
    said("partitions", lambda: e.set_partitions("v", 0))
    said("empty index", lambda: e.compile_index(records(spark, sf_dir).limit(0), folder(spark), IndexSpec(DIM)))
    said("wrong length", lambda: e.create_delta("v").insert(records(spark, sf_dir).withColumn("vector", F.slice("vector", 1, 3))))
    said("float votes", lambda: engine(spark, sf_dir, FLOAT, half=False).query_grid("v", votes(spark, sf_dir)))
    said("drop", lambda: e.drop("v"))
    said("dropped", lambda: e.size("v"))
    e.close()
    said("closed", lambda: e.size("v"))
    return spark.createDataFrame(rows, "step string, result string")


# preparation


@query
def custom_signs_encode(spark, sf_dir):
    """Codes with signs of one's own, all positive."""
    spec = IndexSpec(DIM, (DIM,), signs=(1.0,) * DIM)
    rows = build(records(spark, sf_dir).withColumn("row_idx", F.col("id")), spec, row_idx_col="row_idx")
    return rows.select("id", F.shiftrightunsigned("w0", 32).alias("high"), F.col("w0").bitwiseAND(F.lit(0xFFFFFFFF)).alias("low"))


@query
def msb_first_bytes(spark, sf_dir):
    """Codes as bytes with the first dimension highest."""
    spec = IndexSpec(DIM)

    def coded(b):
        bits = transform.rotate(transform.matrix(b.column(1), DIM), spec) >= 0
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes().hex().upper() for r in transform.msb_bytes(bits)])], names=["id", "code"])

    return _round_trip(records(spark, sf_dir), "id long, code string", coded)


@query
def repeat_rows(spark, sf_dir):
    rows = prepare.repeated(table(spark, sf_dir).select(F.col("vec_id").alias("id"), "label"), 3)
    return rows.select("id", "label")


@query
def fixed_count_queries(spark, sf_dir):
    """278 queries, from however many there are."""
    rows = asked(spark, sf_dir).withColumn("qid", (F.col("qid") / EVERY).cast("long"))
    return prepare.fixed_count(rows, 278).select("qid", F.round(F.col("qvec")[0].cast("double"), 6).alias("first"))


@query
def synthetic_rows(spark, sf_dir):
    """As many normal vectors of length 1 as there are embeddings."""
    rows = prepare.synthetic(spark, table(spark, sf_dir).count(), 32)
    return rows.select("id", F.posexplode("vector").alias("i", "v")).select("id", "i", F.round(F.col("v").cast("double"), 5).alias("v"))


@query
def orthogonal_weights(spark, sf_dir):
    """The products of the columns of orthogonal weights."""
    w = prepare.orthogonal_weights(DIM, 8)
    product = w.T @ w
    return spark.createDataFrame([(i, j, abs(round(float(product[i, j]), 6))) for i in range(8) for j in range(8)], "i int, j int, product double")


@query
def tier_layouts(spark, sf_dir):
    """The tiers of the dimensions of the published sweep."""
    return spark.createDataFrame([(d, ",".join(map(str, default_tiers(d)))) for d in (16, 32, 64, 128, 256, 384, 512, 768, 1024)], "dim int, tiers string")


@query
def metrics_json(spark, sf_dir):
    """Recall written as JSON, and read again."""
    path = folder(spark)
    truth = knn.exact_knn(records(spark, sf_dir), asked(spark, sf_dir), 10, DIM)
    got = knn.batch_search(index(spark, sf_dir), asked(spark, sf_dir), 10)
    evaluation.write_metrics(spark, {"mode": "1bit_half", "recall": round(evaluation.recall(truth, got, 10).first()["recall"], 6)}, path)
    return spark.read.schema("mode string, recall double").json(path)
