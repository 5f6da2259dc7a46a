"""Registration helpers and the SQL form of the fixture views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(
        *[
            F.round(F.col(n), digits).alias(n) if t in ("double", "float") else F.col(n)
            for n, t in df.dtypes
        ]
    )


def query(name: str, sql: str | None = None):
    """Register a query; its double columns are rounded to six decimals."""

    def wrap(fn):
        def run(spark, sf_dir):
            return rounded(fn(spark, sf_dir))

        run.__name__ = name
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


# ------------------------------------------------------------------ SQL pieces


def r6(expr: str, name: str | None = None) -> str:
    """Rounded double without a negative zero."""
    out = f"round(({expr})::DOUBLE, 6) + 0.0"
    return f"{out} AS {name}" if name else out


def with_(*ctes: str) -> str:
    flat = []
    for c in ctes:
        if c not in flat:
            flat.append(c)
    return "WITH " + ",\n".join(flat) + "\n"


def unit(vec: str, norm: str) -> str:
    return f"list_transform({vec}, lambda z: z / {norm})"


def norm_of(vec: str) -> str:
    return f"greatest(sqrt(list_dot_product({vec}, {vec})), 1e-12::DOUBLE)"


def combine(x: str, y: str, sx: float, sy: float) -> str:
    return (
        f"list_transform(list_zip({x}, {y}), "
        f"lambda z: z[1] * {sx}::DOUBLE + z[2] * {sy}::DOUBLE)"
    )


def chk(vec: str) -> str:
    return f"list_sum(list_transform({vec}, lambda x, i: x * i))"


HALVES = """h AS (
  SELECT id, category, e, e[1:32] AS a, e[33:64] AS b FROM (
    SELECT vec_id AS id, label AS category,
           list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings))"""

GALLERY = f"""g0 AS (SELECT id, category, a AS v0, {combine('a', 'b', 1, 0.5)} AS t0, b AS a0 FROM h),
g1 AS (SELECT *, {norm_of('v0')} AS nv, {norm_of('t0')} AS nt, {norm_of('a0')} AS na FROM g0),
gal AS (SELECT id, category, {unit('v0', 'nv')} AS visual, {unit('t0', 'nt')} AS caption,
  {unit('a0', 'na')} AS audio, list_dot_product(a0, a0) AS energy FROM g1)"""

QUERIES_SQL = f"""q0 AS (SELECT id, category, {combine('a', 'list_reverse(b)', 1, 1)} AS c0,
  {combine('b', 'list_reverse(a)', 1, 2)} AS p0 FROM h),
q1 AS (SELECT *, {norm_of('c0')} AS nc, {norm_of('p0')} AS np FROM q0),
qry AS (SELECT id AS qid, id AS truth, category, {unit('c0', 'nc')} AS q_clip,
  {unit('p0', 'np')} AS q_clap,
  CASE WHEN category <= 1 THEN 'text' WHEN category <= 3 THEN 'image' WHEN category <= 5 THEN 'audio'
       WHEN category <= 7 THEN 'video' ELSE 'mixed' END AS kind FROM q1)"""

SCORES = """sc AS (SELECT q.qid, q.truth, q.category, q.kind, g.id, g.category AS g_category,
  list_dot_product(q.q_clip, g.visual) AS sim_v, list_dot_product(q.q_clip, g.caption) AS sim_t,
  list_dot_product(q.q_clap, g.audio) AS sim_a FROM qry q CROSS JOIN gal g)"""

BASE = (HALVES, GALLERY, QUERIES_SQL, SCORES)


def ang(sim: str, tau: float = 1.0) -> str:
    return f"((1.0 - acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, {sim}))) / pi()) / {tau}::DOUBLE)"


THIRD = "(1.0::DOUBLE / 3.0::DOUBLE)"
EQUAL_SQL = f"{THIRD} * sim_v + {THIRD} * sim_t + {THIRD} * sim_a"
SINGLE_SQL = {"visual": "sim_v", "text": "sim_t", "audio": "sim_a"}
PAIR_SQL = {
    "visual+text": "0.5::DOUBLE * sim_v + 0.5::DOUBLE * sim_t",
    "visual+audio": "0.5::DOUBLE * sim_v + 0.5::DOUBLE * sim_a",
    "text+audio": "0.5::DOUBLE * sim_t + 0.5::DOUBLE * sim_a",
}


def fused(systems: dict[str, str], source: str = "sc", name: str = "f", extra: str = "") -> str:
    """CTE of (system, qid, truth, category, id, s): one branch per system."""
    parts = [
        f"SELECT '{n}' AS system, qid, truth, category, id, g_category{extra}, "
        f"round({e}, 12) AS s FROM {source}"
        for n, e in systems.items()
    ]
    return f"{name} AS (" + "\nUNION ALL ".join(parts) + ")"


def ranks(source: str = "f", name: str = "ranks") -> str:
    """CTE of truth ranks: one plus the rows that come before the truth."""
    return f"""{name} AS (SELECT s.system, s.qid, s.truth, s.category, t.s AS s_truth,
  1 + count(*) FILTER (s.id <> s.truth AND (s.s > t.s OR (s.s = t.s AND s.id < s.truth))) AS rk,
  count(*) AS n
  FROM {source} s JOIN {source} t ON t.system = s.system AND t.qid = s.qid AND t.id = t.truth
  GROUP BY s.system, s.qid, s.truth, s.category, t.s)"""


def ranked(source: str = "f", name: str = "ranked", where: str = "true") -> str:
    """CTE with rk = place of each row per (system, qid)."""
    return f"""{name} AS (SELECT *, row_number() OVER (PARTITION BY system, qid
  ORDER BY s DESC, id) AS rk FROM {source} WHERE {where})"""


def softmax3(a: str, b: str, c: str) -> list[str]:
    top = f"greatest({a}, {b}, {c})"
    total = f"(exp({a} - {top}) + exp({b} - {top}) + exp({c} - {top}))"
    return [f"exp({x} - {top}) / {total}" for x in (a, b, c)]


# A toy gate: weights are the softmax of three query components, times three.
_GATE = softmax3("3.0 * q_clip[1]", "3.0 * q_clip[2]", "3.0 * q_clip[3]")
GATE_SQL = f"gw AS (SELECT qid, {_GATE[0]} AS w_v, {_GATE[1]} AS w_t, {_GATE[2]} AS w_a FROM qry)"
GATED_SCORES = """scw AS (SELECT sc.*, w_v, w_t, w_a, w_v / (w_v + w_t + 1e-8::DOUBLE) AS n_v,
  w_t / (w_v + w_t + 1e-8::DOUBLE) AS n_t FROM sc JOIN gw USING (qid))"""
GATED_SQL = "w_v * sim_v + w_t * sim_t + w_a * sim_a"
NO_AUDIO_SQL = "n_v * sim_v + n_t * sim_t"
STANDARD_SQL = {**SINGLE_SQL, **PAIR_SQL, "equal": EQUAL_SQL, "gated": GATED_SQL, "gated_no_audio": NO_AUDIO_SQL}
GATED_BASE = (*BASE, GATE_SQL, GATED_SCORES)
STANDARD_RANKS = (*GATED_BASE, fused(STANDARD_SQL, "scw"), ranks())


def toy_gate(queries: DataFrame) -> DataFrame:
    from ..operators.fusion import with_softmax_weights

    return with_softmax_weights(queries, [F.col("q_clip")[i] * 3.0 for i in range(3)])


# Manifest views over documents and labels.
MANIFEST = r"""raw AS (SELECT d.doc_id, d.doc_id::VARCHAR AS video_id, d.source AS category, d.lang, d.n_chars,
  d.text, string_split(d.text, chr(10))[1] AS description,
  list_filter(string_split(d.text, chr(10))[2:], lambda x: x <> '') AS questions,
  string_split(d.text, chr(10))[-1] AS title,
  CASE WHEN coalesce(l.quality, 1) = 0 THEN 'missing MP4'
       WHEN coalesce(l.toxic, 0) = 1 THEN 'JSON parse error'
       WHEN NOT regexp_matches(string_split(d.text, chr(10))[1], '\S') THEN 'empty description'
       WHEN len(list_filter(string_split(d.text, chr(10))[2:], lambda x: x <> '')) = 0
       THEN 'no Q&A questions' END AS reason
  FROM documents d LEFT JOIN labels l USING (doc_id)),
man AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY category ORDER BY md5('42:' || video_id), video_id) - 1
    < greatest(1, floor(count(*) OVER (PARTITION BY category) * 0.85::DOUBLE)) THEN 'train' ELSE 'test' END AS split
  FROM raw WHERE reason IS NULL)"""
