"""DuckDB SQL for the registered queries, from the raw vectors on: nothing of the engine is used but the fixed signs."""

from __future__ import annotations

import numpy as np

from stratavec.functions.spec import rademacher

_SIGNS = "[" + ",".join(str(int(s)) for s in rademacher(64)) + "]"

CORE = f"""
s AS (SELECT {_SIGNS} AS g),
z AS (SELECT vec_id, i, list_sum(list_transform(range(64), lambda j:
        embedding[j+1]::DOUBLE * g[j+1] * (1 - 2*(bit_count((i & j)::INTEGER)::INTEGER % 2)))) / 8.0 AS z
      FROM embeddings, s, range(64) t(i)),
zl AS (SELECT vec_id, list(z ORDER BY i) AS zz FROM z GROUP BY vec_id),
th AS (SELECT vec_id, list_sort(list(abs(z)))[13] AS t FROM z GROUP BY vec_id),
code AS (SELECT vec_id, bit_or(CASE WHEN z >= 0 THEN 1::UBIGINT << i::UBIGINT ELSE 0::UBIGINT END) AS c FROM z GROUP BY vec_id),
two AS (SELECT z.vec_id, bit_or(CASE WHEN abs(z) >= t THEN 1::UBIGINT << i::UBIGINT ELSE 0::UBIGINT END) AS m,
               bit_or(CASE WHEN abs(z) >= t AND z >= 0 THEN 1::UBIGINT << i::UBIGINT ELSE 0::UBIGINT END) AS sg
        FROM z JOIN th USING (vec_id) GROUP BY z.vec_id),
half AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x = 0 THEN 0::FLOAT ELSE
           (round_even(x::DOUBLE / pow(2.0, greatest(floor(log2(abs(x::DOUBLE))), -14) - 10), 0) * pow(2.0, greatest(floor(log2(abs(x::DOUBLE))), -14) - 10))::FLOAT END) AS h
         FROM embeddings)
"""
PAIRS = """
pairs AS (SELECT q.vec_id AS qid, r.vec_id AS id, bit_count(xor(q.c, r.c))::BIGINT AS dist FROM code q, code r WHERE q.vec_id % 100 = 0)
"""
_HALF_DIST = "list_sum(list_transform(range(64), lambda j: pow((e.embedding[j+1] - h.h[j+1])::DOUBLE, 2)))"
_TERNARY = "(4 * bit_count(q.m & r.m & xor(q.sg, r.sg))::INTEGER + bit_count(xor(q.m, r.m))::INTEGER)"
_BIT = "(((r.c >> j::UBIGINT) & 1::UBIGINT)::DOUBLE * 2 - 1)"
_TRIT = "(((r.m >> j::UBIGINT) & 1::UBIGINT)::DOUBLE * (((r.sg >> j::UBIGINT) & 1::UBIGINT)::DOUBLE * 2 - 1))"


def _with(*parts: str) -> str:
    return "WITH " + ",".join([CORE, *parts])


def _search(stage1: str, rerank: str, keep: int = 100, k: int = 10, live: str = "TRUE") -> str:
    """CTEs cand (qid, id, s1) and hits (qid, rank, id, dist) from a code distance and a rerank distance."""
    return f"""
cand AS (SELECT * FROM (SELECT q.vec_id AS qid, r.vec_id AS id, {stage1} AS s1 FROM {{codes}} q, {{codes}} r WHERE q.vec_id % 100 = 0 AND {live})
         QUALIFY row_number() OVER (PARTITION BY qid ORDER BY s1, id) <= {keep}),
ranked AS (SELECT c.qid, c.id, c.s1, {rerank} AS dist FROM cand c JOIN embeddings e ON e.vec_id = c.qid JOIN half h ON h.vec_id = c.id
           JOIN zl ON zl.vec_id = c.qid JOIN {{codes}} r ON r.vec_id = c.id),
hits AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY dist, s1, id) AS rank, id, dist FROM ranked
         QUALIFY row_number() OVER (PARTITION BY qid ORDER BY dist, s1, id) <= {k})
"""


_H1 = "bit_count(xor(q.c, r.c))::INTEGER"
_ASYM1 = f"list_sum(list_transform(range(64), lambda j: pow(zl.zz[j+1] - {_BIT}, 2)))"
_ASYM2 = f"list_sum(list_transform(range(64), lambda j: pow(zl.zz[j+1] - {_TRIT}, 2)))"
_ONE_HALF = _search(_H1, _HALF_DIST).format(codes="code")
_ONE_ASYM = _search(_H1, _ASYM1).format(codes="code")
_TWO_HALF = _search(_TERNARY, _HALF_DIST).format(codes="two")
_TWO_ASYM = _search(_TERNARY, _ASYM2).format(codes="two")
_HITS = " SELECT qid, rank, id, round(dist, 6) AS dist FROM hits"
_EXACT = """
exact AS (SELECT q.vec_id AS qid, r.vec_id AS id, list_sum(list_transform(range(64), lambda j: pow(q.embedding[j+1]::DOUBLE - r.embedding[j+1]::DOUBLE, 2))) AS dist
          FROM embeddings q, embeddings r WHERE q.vec_id % 100 = 0),
truth AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank, id, dist FROM exact
          QUALIFY row_number() OVER (PARTITION BY qid ORDER BY dist, id) <= 10)
"""


def _mask(near: str, gate: str, codes: str = "code") -> str:
    return f"""
m AS (SELECT r.vec_id, bit_or(CASE WHEN {gate} AND {near} THEN 1 << (q.vec_id // 100 % 8)::INTEGER ELSE 0 END)::INTEGER AS mask
      FROM {codes} r, {codes} q WHERE q.vec_id % 100 = 0 GROUP BY r.vec_id),
masks AS (SELECT vec_id AS row_idx, vec_id AS id, mask, bit_count(mask)::INTEGER AS votes FROM m)
"""


_GATE1 = "(r.c >> 63::UBIGINT) & 1::UBIGINT = 1"
_GATE2 = "(r.m & r.sg) >> 63::UBIGINT = 1"
_LOG = """
src AS (SELECT vec_id - first AS s, CASE WHEN vec_id % 2 = 1 THEN vec_id ELSE vec_id + 10000 END AS id, embedding AS v FROM embeddings, (SELECT count(*) * 9 // 10 AS first FROM embeddings) WHERE vec_id >= first),
log AS (SELECT s AS seq, 1 AS op, id, v FROM src UNION ALL SELECT s + 1000000, 2, id, NULL FROM src WHERE s % 7 = 0
        UNION ALL SELECT s + 2000000, 1, id, v FROM src WHERE s % 21 = 0),
live AS (SELECT l.seq, l.id, l.v FROM log l WHERE op = 1 AND NOT EXISTS (SELECT 1 FROM log d WHERE d.op = 2 AND d.id = l.id AND d.seq > l.seq))
"""
_DELTA = """
dd AS (SELECT q.vec_id AS qid, l.seq, l.id, list_sum(list_transform(range(64), lambda j: pow(q.embedding[j+1]::DOUBLE - l.v[j+1]::DOUBLE, 2))) AS dist
       FROM embeddings q, live l WHERE q.vec_id % 100 = 0),
dhits AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY dist, seq) AS rank, id, dist FROM dd
          QUALIFY row_number() OVER (PARTITION BY qid ORDER BY dist, seq) <= 10)
"""
_SCORE = "trunc(least(dist * 1e6, 2147483647))::BIGINT"
_LABELLED = """
lab AS (SELECT q.vec_id AS qid, r.vec_id AS id, bit_count(xor(q.c, r.c))::BIGINT AS dist, e.label = 5 AS target
        FROM code q JOIN embeddings w ON w.vec_id = q.vec_id AND w.label = 5, code r JOIN embeddings e ON e.vec_id = r.vec_id)
"""


def _recalls() -> str:
    out = []
    for name, part in (("1bit_half", _ONE_HALF), ("1bit_asym", _ONE_ASYM), ("2bit_half", _TWO_HALF), ("2bit_asym", _TWO_ASYM)):
        for k in (1, 5, 10):
            inner = _with(_EXACT, part) + f" SELECT t.qid, count(h.id) / {k}.0 AS share FROM truth t LEFT JOIN hits h ON h.qid = t.qid AND h.id = t.id AND h.rank <= {k} WHERE t.rank <= {k} GROUP BY t.qid"
            out.append(f"SELECT '{name}' AS mode, {k} AS k, round(avg(share), 6) AS recall FROM ({inner})")
    return " UNION ALL ".join(out)


def _tradeoffs() -> str:
    out = []
    for k in (10, 50, 100):
        part = _search(_H1, _HALF_DIST, k, k).format(codes="code")
        inner = _with(_EXACT, part) + " SELECT t.qid, count(h.id) / 10.0 AS share FROM truth t LEFT JOIN hits h ON h.qid = t.qid AND h.id = t.id GROUP BY t.qid"
        out.append(f"SELECT {k} AS k, round(1 - {k} / (SELECT count(*) FROM embeddings), 6) AS reduction, round(avg(share), 6) AS recall FROM ({inner})")
    return " UNION ALL ".join(out)


def _kron12() -> str:
    """Hadamard(4) times cosine(3), written out."""
    h = [[(-1) ** bin(a & b).count("1") / 2 for b in range(4)] for a in range(4)]
    c = [[(np.sqrt(1 / 3) if k == 0 else np.sqrt(2 / 3)) * np.cos(np.pi * (2 * j + 1) * k / 6) for j in range(3)] for k in range(3)]
    rows = [[h[a][b] * c[k][j] for b in range(4) for j in range(3)] for a in range(4) for k in range(3)]
    literal = "[" + ",".join("[" + ",".join(repr(float(x)) for x in r) + "]" for r in rows) + "]"
    return f"""WITH s AS (SELECT {_SIGNS} AS g, {literal} AS r)
        SELECT vec_id AS id, i::INTEGER AS i, round(list_sum(list_transform(range(12), lambda j: r[i+1][j+1]::DOUBLE * g[j+1] * embedding[j+1]::DOUBLE)), 6) + 0.0 AS z
        FROM embeddings, s, range(12) t(i)"""


#: The operations of registry.mutable(): all rows, every third, deletes of every seventh, every 21st again.
_OPS = """
sizes AS (SELECT count(*) AS n, count_if(vec_id % 3 = 0)::BIGINT AS n3, count_if(vec_id % 7 = 0)::BIGINT AS n7, count_if(vec_id % 21 = 0)::BIGINT AS n21 FROM embeddings),
live AS (SELECT seq, vec_id + 1000000 AS id, embedding AS v FROM (
    SELECT row_number() OVER (ORDER BY vec_id) AS seq, vec_id, embedding, FALSE AS late FROM embeddings
    UNION ALL SELECT n + row_number() OVER (ORDER BY vec_id), vec_id, embedding, FALSE FROM embeddings, sizes WHERE vec_id % 3 = 0
    UNION ALL SELECT n + n3 + n7 + row_number() OVER (ORDER BY vec_id), vec_id, embedding, TRUE FROM embeddings, sizes WHERE vec_id % 21 = 0) WHERE late OR vec_id % 7 <> 0)
"""
_ENTRIES = " SELECT seq, id, 64 AS dim, round(list_sum(list_transform(v, lambda x: x::DOUBLE)), 6) AS total FROM live"


def _float_bits(x: str) -> str:
    """The bits of a normal float or zero."""
    e = f"floor(log2(abs({x}::DOUBLE)))"
    return f"(CASE WHEN {x} = 0 THEN 0 ELSE (CASE WHEN {x} < 0 THEN 2147483648 ELSE 0 END) + ({e}::BIGINT + 127) * 8388608 + ((abs({x}::DOUBLE) / pow(2.0, {e}) - 1) * 8388608)::BIGINT END)::BIGINT"


def _half_bits(x: str) -> str:
    """The bits of a value that half precision holds exactly."""
    e = f"floor(log2(abs({x}::DOUBLE)))"
    size = f"CASE WHEN abs({x}) < pow(2.0, -14) THEN (abs({x}::DOUBLE) * 16777216)::BIGINT ELSE ({e}::BIGINT + 15) * 1024 + ((abs({x}::DOUBLE) / pow(2.0, {e}) - 1) * 1024)::BIGINT END"
    return f"(CASE WHEN {x} = 0 THEN 0 ELSE (CASE WHEN {x} < 0 THEN 32768 ELSE 0 END) + {size} END)::BIGINT"


def _hex(values: str, bits, digits: int, little: bool = False) -> str:
    """The bytes of a list of values in hexadecimal."""
    h = f"printf('%0{digits}X', {bits('x')})"
    one = " || ".join(f"substr({h}, {i}, 2)" for i in range(digits - 1, 0, -2)) if little else h
    return f"list_aggregate(list_transform({values}, lambda x: {one}), 'string_agg', '')"


def _little(value: str, size: int, kind: str = "") -> str:
    """A whole number's bytes, the lowest first."""
    return "(" + " || ".join(f"printf('%02X', (({value} >> {8 * k}{kind}) & 255{kind})::BIGINT)" for k in range(size)) + ")"


def _normals(values: str) -> str:
    """CTE normal: the rows of values (id, i, x) with a normal value z of seed 42 for each id and i."""
    steps, last = [f"v AS ({values})", "start AS (SELECT *, (id * 1000003 + i * 7919 + 42 * 104729)::BIGINT % 2147483647 AS s FROM v)"], "start"
    mixed = lambda c: [f"(xor({c}, {c} >> {shift}) * {factor}) % 2147483647" for shift, factor in ((15, 48271), (12, 69621), (14, 16807))]
    for c, begin in (("a", "s"), ("b", "(a + 3 * s + 12345) % 2147483647")):
        for step in [begin, *mixed(c)]:
            name = f"t{len(steps)}"
            steps.append(f"{name} AS (SELECT * {f'EXCLUDE ({c})' if step != begin else ''}, {step} AS {c} FROM {last})")
            last = name
    return "WITH " + ", ".join(steps) + f", normal AS (SELECT *, sqrt(-2 * ln((a + 1) / 2147483648.0::DOUBLE)) * cos(2 * pi() * (b / 2147483647.0::DOUBLE)) AS z FROM {last})"


_TIER = "bit_count(xor(q.c, r.c) & 4294967295::UBIGINT)::INTEGER"
# tiers of 16 are rotated each on their own: blocks of 16 instead of one of 64
_TIER_CORE = f"""
s AS (SELECT {_SIGNS} AS g),
z AS (SELECT vec_id, i, list_sum(list_transform(range(16), lambda j:
        embedding[(i // 16) * 16 + j + 1]::DOUBLE * g[(i // 16) * 16 + j + 1] * (1 - 2*(bit_count(((i % 16) & j)::INTEGER)::INTEGER % 2)))) / 4.0 AS z
      FROM embeddings, s, range(64) t(i)),
zl AS (SELECT vec_id, list(z ORDER BY i) AS zz FROM z GROUP BY vec_id),
code AS (SELECT vec_id, bit_or(CASE WHEN z >= 0 THEN 1::UBIGINT << i::UBIGINT ELSE 0::UBIGINT END) AS c FROM z GROUP BY vec_id),
""" + CORE[CORE.index("half AS"):]

ORACLE_SQL = {
    "encode_popcount": _with() + " SELECT vec_id AS id, bit_count(c)::INTEGER AS ones, (c >> 32::UBIGINT)::BIGINT AS high, (c & 4294967295::UBIGINT)::BIGINT AS low FROM code",
    "encode_two_bit": _with() + " SELECT vec_id AS id, bit_count(sg)::INTEGER AS signs, bit_count(m)::INTEGER AS active, (sg & 4294967295::UBIGINT)::BIGINT AS s_low, (m & 4294967295::UBIGINT)::BIGINT AS m_low FROM two",
    "rotate_round6": _with() + " SELECT vec_id AS id, i::INTEGER AS i, round(z, 6) + 0.0 AS z FROM z",
    "rotate_sql_twin": _with() + " SELECT vec_id AS id, i::INTEGER AS i, round(z, 6) + 0.0 AS z FROM z",
    "l2_norm_check": "SELECT vec_id AS id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm, 1.0::DOUBLE AS unit_norm FROM embeddings",
    "back_project_error": "SELECT vec_id AS id, i::INTEGER AS i, round(embedding[i+1]::DOUBLE, 6) + 0.0 AS x FROM embeddings, range(64) t(i)",
    "half_round": _with() + " SELECT vec_id AS id, i::INTEGER AS i, round(h[i+1]::DOUBLE, 9) AS h FROM half, range(64) t(i)",
    "unpack_bits": _with() + " SELECT vec_id AS id, i::INTEGER AS i, (CASE WHEN z >= 0 THEN 1 ELSE -1 END)::INTEGER AS b FROM z",
    "hamming_knn10": _with(PAIRS) + " SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank, id, dist FROM pairs QUALIFY row_number() OVER (PARTITION BY qid ORDER BY dist, id) <= 10",
    "hamming_matrix_stats": _with(PAIRS) + " SELECT qid, count(*) AS n, round(avg(dist), 6) AS mean, round(stddev_pop(dist), 6) AS deviation, min(dist) AS least, max(dist) AS most FROM pairs GROUP BY qid",
    "knn_1bit_fp16_k10": _with(_ONE_HALF) + _HITS,
    "knn_1bit_asym_k10": _with(_ONE_ASYM) + _HITS,
    "knn_2bit_fp16_k10": _with(_TWO_HALF) + _HITS,
    "knn_2bit_asym_k10": _with(_TWO_ASYM) + _HITS,
    "knn_fp32_k10": _with() + """, d AS (SELECT q.vec_id AS qid, r.vec_id AS id, trunc(list_sum(list_transform(range(64), lambda j: pow(q.zz[j+1] - r.zz[j+1]::FLOAT::DOUBLE, 2))) * 1000) AS s1
        FROM zl q, zl r WHERE q.vec_id % 100 = 0)
        SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY s1, id) AS rank, id, 0 AS score FROM d QUALIFY row_number() OVER (PARTITION BY qid ORDER BY s1, id) <= 10""",
    "knn_scores_padded": _with(_search(_H1, _HALF_DIST, 100, 5).format(codes="code")) + " SELECT qid, rank, id, round(trunc(dist * 1e6) / 1000)::BIGINT AS score_k FROM hits",
    "exact_knn10": "WITH " + _EXACT + " SELECT qid, rank, id, round(dist, 6) AS dist FROM truth",
    "recall_at_k": _recalls(),
    "vote_mask_1bit": _with(_mask(f"{_H1} <= 26", _GATE1)) + " SELECT row_idx, id, mask, votes FROM masks",
    "vote_mask_2bit": _with(_mask(f"{_TERNARY} <= 60", _GATE2, "two")) + " SELECT row_idx, id, mask, votes FROM masks",
    "vote_ungated": _with(_mask(f"{_H1} <= 26", "TRUE")) + " SELECT row_idx, id, mask, votes FROM masks",
    "resonant_count": _with(_mask(f"{_H1} <= 26", _GATE1)) + " SELECT count_if(votes >= 5)::BIGINT AS resonant, count_if(mask <> 0)::BIGINT AS nonzero FROM masks",
    "radius_vote": """WITH d AS (SELECT q.vec_id AS qid, r.vec_id AS id, list_sum(list_transform(range(64), lambda j: pow(q.embedding[j+1]::DOUBLE - r.embedding[j+1]::DOUBLE, 2))) AS dist
        FROM embeddings q, embeddings r WHERE q.vec_id % 100 = 0), m AS (SELECT id, bit_or(CASE WHEN dist <= 4.0 * 26 / 64 THEN 1 << (qid // 100 % 8)::INTEGER ELSE 0 END)::INTEGER AS mask FROM d GROUP BY id)
        SELECT id, mask, bit_count(mask)::INTEGER AS votes FROM m""",
    "tombstoned_knn": _with(_search(_H1, _HALF_DIST, live="r.vec_id % 10 <> 0").format(codes="code")) + _HITS,
    "tombstoned_vote": _with(_mask(f"{_H1} <= 26", f"r.vec_id % 10 <> 0 AND {_GATE1}")) + " SELECT row_idx, id, mask, votes FROM masks",
    "tier_budget_knn": "WITH " + ",".join([_TIER_CORE, _search(_TIER, _HALF_DIST).format(codes="code")]) + _HITS,
    "delta_live": "WITH " + _LOG + " SELECT seq, id, len(v)::INTEGER AS dim FROM live",
    "needs_flush": "WITH " + _LOG + " SELECT (SELECT count(*) FROM live) AS live, (SELECT count(*) FROM log WHERE op = 1) AS total, (SELECT count(*) FROM live) >= 40 AS needs_flush",
    "delta_knn": "WITH " + _LOG + "," + _DELTA + " SELECT qid, rank, id, round(dist, 6) AS dist FROM dhits",
    "search_merged": _with(_ONE_HALF, _LOG, _DELTA) + f""", both_ AS (SELECT qid, id, {_SCORE} AS score, 0 AS src, rank AS place FROM hits UNION ALL SELECT qid, id, {_SCORE}, 1, rank FROM dhits),
        one AS (SELECT * FROM both_ QUALIFY row_number() OVER (PARTITION BY qid, id ORDER BY src, place) = 1)
        SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score, src, place) AS rank, id, src FROM one QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score, src, place) <= 10""",
    "compact_knn": _with(_ONE_HALF) + " SELECT qid, rank, id, id AS row_idx, round(dist, 6) AS dist FROM hits",
    "class_distance_stats": _with(_LABELLED) + " SELECT target, count(*) AS n, round(avg(dist), 6) AS mean, round(stddev_pop(dist), 6) AS deviation, min(dist) AS least, max(dist) AS most FROM lab GROUP BY target",
    "threshold_sweep_f1": _with(_LABELLED) + """, turn AS (SELECT id, target, dist AS turned FROM lab QUALIFY row_number() OVER (PARTITION BY id ORDER BY dist) = 5),
        t AS (SELECT unnest(range((SELECT min(dist) FROM lab WHERE target), (SELECT max(dist) FROM lab WHERE NOT target))) AS threshold),
        c AS (SELECT threshold, count_if(target AND turned <= threshold)::BIGINT AS tp, count_if(NOT target AND turned <= threshold)::BIGINT AS fp FROM t, turn GROUP BY threshold),
        f AS (SELECT threshold, tp, fp, CASE WHEN tp = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * tp / (tp + fp + (SELECT count(DISTINCT id) FROM lab WHERE target)) END AS f1 FROM c)
        SELECT threshold, tp, fp, round(f1, 6) AS f1 FROM f ORDER BY f.f1 DESC, threshold LIMIT 1""",
    "confusion": _with(_LABELLED) + """, n AS (SELECT id, bool_or(target) AS target, count_if(dist <= 26) >= 5 AS p FROM lab GROUP BY id),
        c AS (SELECT count_if(p AND target)::BIGINT AS tp, count_if(p AND NOT target)::BIGINT AS fp, count_if(NOT p AND target)::BIGINT AS fn, count_if(NOT p AND NOT target)::BIGINT AS tn FROM n)
        SELECT tp, fp, fn, tn, round(CASE WHEN tp + fp = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / (tp + fp) END, 6) AS precision,
               round(CASE WHEN tp + fn = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / (tp + fn) END, 6) AS recall_rate,
               round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END, 6) AS f1 FROM c""",
    "normal_curve": _with(_LABELLED) + """, st AS (SELECT target, avg(dist) AS mu, stddev_pop(dist) AS sd FROM lab GROUP BY target), x AS (SELECT i * (64.0::DOUBLE / 99) AS x FROM range(100) t(i))
        SELECT target, round(x, 6) AS x, round(exp(-0.5 * pow((x - mu) / sd, 2)) / (sd * sqrt(2 * pi())), 6) AS y FROM st, x""",
    "candidate_tradeoff": _tradeoffs(),
    "spectral_energy": """WITH m AS (SELECT sum(x * x) AS a, sum(x * y) AS b, sum(y * y) AS c FROM (SELECT embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings))
        SELECT 1 AS k, round(((a + c) / 2 + sqrt(pow((a - c) / 2, 2) + b * b)) / (a + c), 6) AS phi FROM m UNION ALL SELECT 2, 1.0::DOUBLE""",
    "kron_rotate_w12": _kron12(),
    "replicate_modulo": "SELECT i AS id, label FROM range(1234) t(i) JOIN embeddings ON vec_id = i % (SELECT count(*) FROM embeddings)",
    "class_shift": "SELECT vec_id AS id, i::INTEGER AS i, round((CASE WHEN label = 1 AND i < 8 THEN embedding[i+1] + 0.85::FLOAT ELSE embedding[i+1] END)::DOUBLE, 5) AS v FROM embeddings, range(64) t(i)",
    "pad_slice": "SELECT vec_id AS id, 64 AS dim, round(list_sum(list_transform(embedding[1:33], lambda x: x::DOUBLE)), 6) AS total FROM embeddings",
    "canary_vote": _with() + """, k AS (SELECT c FROM code WHERE vec_id = 7), o AS (SELECT CASE WHEN c >> 63::UBIGINT = 1 THEN c ELSE xor(c, 18446744073709551615::UBIGINT) END AS c FROM k),
        r AS (SELECT vec_id, CASE WHEN vec_id IN ((SELECT count(*) // 50 FROM embeddings), (SELECT count(*) * 2 // 5 FROM embeddings), (SELECT count(*) - 1 FROM embeddings)) THEN (SELECT c FROM o) ELSE c END AS c FROM code)
        SELECT vec_id AS row_idx, vec_id AS id, 255 AS mask, 8 AS votes FROM r WHERE r.c = (SELECT c FROM o)""",
    "wal_roundtrip": "WITH " + _LOG + f""" SELECT seq, op, id, printf('%02X', op) || printf('%016X', id) || CASE WHEN op = 1 THEN {_hex('v', _float_bits, 8)} ELSE '' END AS record,
        CASE WHEN op = 1 THEN round(list_sum(list_transform(v, lambda x: x::DOUBLE)), 6) ELSE 0.0 END AS total FROM log""",
    "fvecs_roundtrip": f"SELECT vec_id AS id, '40000000' || {_hex('embedding', _float_bits, 8, True)} AS record, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total FROM embeddings",
    "header_roundtrip": f"""SELECT '504C414E' || '01' || {_little('n', 8)} || {_little('1737400', 8)} || '40000000' || '02000000' || '1000000040000000' || repeat('00', 24) || '01' || '0000' AS raw,
        64 AS dim, n, '[16, 64]' AS tiers, 1 AS q_mode, 1 AS planet_id, 1737400::BIGINT AS radius FROM (SELECT count(*) AS n FROM embeddings)""",
    "replicate_noise": _normals("SELECT c * n + vec_id AS id, i::INTEGER AS i, embedding[i+1]::DOUBLE AS x FROM embeddings, range(3) u(c), range(64) t(i), (SELECT count(*) AS n FROM embeddings)")
    + " SELECT id, i, round((x + 1e-5 * z)::FLOAT::DOUBLE, 6) AS v FROM normal",
    "synthetic_rows": _normals("SELECT id, i::INTEGER AS i, 0 AS x FROM (SELECT unnest(range(count(*))) AS id FROM embeddings), range(32) t(i)")
    + " SELECT id, i, round((z / sqrt(sum(z * z) OVER (PARTITION BY id)))::FLOAT::DOUBLE, 5) AS v FROM normal",
    "column_bytes": _with() + f""" SELECT vec_id AS id, {_little('vec_id', 8)} AS id_bytes, '0200000000000000' AS meta_bytes, {_little('c', 8, '::UBIGINT')} AS tier_bytes, {_hex('h', _half_bits, 4, True)} AS half_bytes
        FROM code JOIN half USING (vec_id)""",
    "index_info": "SELECT 64::BIGINT AS dim, n, n AS rows, 3 AS planet_id, 1737400::BIGINT AS radius, '[16, 64]' AS tiers, 0 AS q_mode, true AS half FROM (SELECT count(*) AS n FROM embeddings)",
    "single_search": _with(_ONE_HALF) + " SELECT rank, id, round(dist, 6) AS dist FROM hits WHERE qid = 0",
    "cuda_alias_vote": _with(_mask(f"{_H1} <= 26", _GATE1)) + " SELECT row_idx, id, mask, votes, (SELECT count_if(votes >= 5)::BIGINT FROM masks) AS resonant FROM masks",
    "tier_words": "WITH " + _TIER_CORE + " SELECT vec_id AS row_idx, vec_id AS id, 2::BIGINT AS meta, ((c >> 16::UBIGINT) & 65535::UBIGINT)::BIGINT AS word FROM code",
    "compacted_tombstoned_knn": _with(_search(_H1, _ASYM1, live="r.vec_id % 10 <> 0").format(codes="code")) + _HITS,
    "delta_entries": "WITH " + _OPS + _ENTRIES,
    "delta_restored": "WITH " + _OPS + _ENTRIES,
    "delta_drained": "WITH " + _OPS + _ENTRIES.replace(" FROM live", ", 0::BIGINT AS left FROM live"),
    "delta_reopened": "WITH " + _OPS + _ENTRIES.replace(" FROM live", " FROM (SELECT n + n3 + n7 + n21 + row_number() OVER (ORDER BY vec_id) AS seq, vec_id AS id, embedding AS v FROM embeddings, sizes WHERE vec_id % 50 = 0)"),
    "delta_deleted": "SELECT CASE WHEN i < 0 THEN -1 ELSE i + 1000000 END AS id, i >= 0 AND (i % 7 <> 0 OR i % 21 = 0) AS found FROM (SELECT unnest(range(-1, count(*))) AS i FROM embeddings) WHERE i < 0 OR i % 5 = 0",
    "delta_counts": "WITH " + _OPS + " SELECT (SELECT count(*) FROM live) AS live, n + n3 + n21 AS total, (SELECT count(*) FROM live) >= 10 AS needs_flush, n AS base FROM sizes",
    "flushed_rows": _with(_OPS) + """ SELECT vec_id AS row_idx, vec_id AS id, bit_count(c)::INTEGER AS ones, 0::BIGINT AS left FROM code
        UNION ALL SELECT n + row_number() OVER (ORDER BY seq) - 1, live.id, bit_count(c)::INTEGER, 0 FROM live, sizes, code WHERE code.vec_id = live.id - 1000000""",
    "engine_lifecycle": """SELECT * FROM (VALUES ('size', 'ok'), ('unknown', 'IndexNotFound'), ('no delta', 'IndexNotFound'), ('budget', 'InvalidOperation'), ('partitions', 'InvalidOperation'), ('empty index', 'ValueError'),
        ('wrong length', 'ValueError'), ('float votes', 'UnsupportedLayout'), ('drop', 'ok'), ('dropped', 'IndexNotFound'), ('closed', 'NotInitialized')) t(step, result)""",
    "custom_signs_encode": _with().replace(_SIGNS, str([1] * 64)) + " SELECT vec_id AS id, (c >> 32::UBIGINT)::BIGINT AS high, (c & 4294967295::UBIGINT)::BIGINT AS low FROM code",
    "msb_first_bytes": _with() + """ SELECT vec_id AS id, list_aggregate(list_transform(range(8), lambda k: printf('%02X', list_sum(list_transform(range(8), lambda b: ((c >> (8 * k + b)::UBIGINT) & 1::UBIGINT)::BIGINT << (7 - b)))::BIGINT)), 'string_agg', '') AS code FROM code""",
    "repeat_rows": "SELECT vec_id * 3 + c AS id, label FROM embeddings, range(3) t(c)",
    "fixed_count_queries": "SELECT i AS qid, round(embedding[1]::DOUBLE, 6) AS first FROM range(278) t(i), (SELECT count(*) AS n FROM embeddings WHERE vec_id % 100 = 0) JOIN embeddings ON vec_id = 100 * (i % n)",
    "orthogonal_weights": "SELECT i::INTEGER AS i, j::INTEGER AS j, CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS product FROM range(8) a(i), range(8) b(j)",
    "tier_layouts": """SELECT * FROM (VALUES (16, '16'), (32, '32'), (64, '64'), (128, '64,128'), (256, '64,128,256'), (384, '64,128,256,384'), (512, '64,128,256,512'), (768, '64,128,256,512,768'), (1024, '64,128,256,512,1024')) t(dim, tiers)""",
    "metrics_json": "SELECT mode, recall FROM (" + _recalls() + ") WHERE mode = '1bit_half' AND k = 10",
}
ORACLE_SQL |= {
    "compiled_knn": ORACLE_SQL["knn_1bit_fp16_k10"],
    "compiled_knn_2bit_asym": ORACLE_SQL["knn_2bit_asym_k10"],
    "cuda_alias_knn": ORACLE_SQL["knn_1bit_fp16_k10"],
    "knobs_knn": ORACLE_SQL["tier_budget_knn"],
    "engine_merged": ORACLE_SQL["search_merged"].replace(_LOG, _OPS),
}
