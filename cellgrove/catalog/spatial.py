"""Range-join queries (section H): ends of the mask's own thin parts as points."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellgrove.catalog import query
from cellgrove.catalog.fixtures import LABELS, MASKED, masked_cells, rounded
from cellgrove.operators import bridging as B
from cellgrove.operators import components as P
from cellgrove.operators import skeleton as K
from cellgrove.operators import spatial as H
from cellgrove.session import cut

ENDS = f"""WITH {MASKED}, {LABELS}, pc AS (SELECT m.image_id, m.y, m.x, l.comp FROM masked m JOIN labels8 l ON l.image_id = m.image_id AND l.pos = m.y * 8 + m.x),
ends AS (SELECT a.image_id, a.y, a.x, a.comp FROM pc a JOIN pc b ON b.image_id = a.image_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1
  GROUP BY a.image_id, a.y, a.x, a.comp HAVING count(*) = 2),
nb AS (SELECT e.image_id, e.y, e.x, e.comp, p.y AS py, p.x AS px, row_number() OVER (PARTITION BY e.image_id, e.y, e.x
  ORDER BY sqrt(pow(p.y - e.y, 2) + pow(p.x - e.x, 2)), p.y, p.x) AS r FROM ends e JOIN pc p ON p.image_id = e.image_id
  AND abs(p.y - e.y) <= 3 AND abs(p.x - e.x) <= 3 AND (p.y <> e.y OR p.x <> e.x)),
mv AS (SELECT image_id, y, x, comp, y - avg(py) AS vy, x - avg(px) AS vx FROM nb WHERE r <= 6 GROUP BY image_id, y, x, comp),
dirs AS (SELECT image_id, y, x, comp, CASE WHEN sqrt(vy * vy + vx * vx) > 1e-6 THEN vy / sqrt(vy * vy + vx * vx) END AS dy,
  CASE WHEN sqrt(vy * vy + vx * vx) > 1e-6 THEN vx / sqrt(vy * vy + vx * vx) END AS dx FROM mv)"""


def endpoints(read):
    lab = cut(K.line_points(P.label(masked_cells(read), "pred"), "pred"))
    lines = lab.filter("pred").select("image_id", "y", "x")
    ends = lab.filter("endpoint").select("image_id", "y", "x", "comp")
    return H.outward_direction(ends, lines, radius=3)


@query("H1_outward_direction", f"{ENDS} SELECT image_id, y, x, CAST(comp AS BIGINT) AS comp, round(dy, 6) + 0.0 AS dy, round(dx, 6) + 0.0 AS dx FROM dirs")
def _(read):
    return rounded(endpoints(read))


@query(
    "H2_pair_candidates",
    f"""{ENDS}, pr AS (SELECT a.image_id, a.y AS y0, a.x AS x0, b.y AS y1, b.x AS x1, sqrt(pow(b.y - a.y, 2) + pow(b.x - a.x, 2)) AS gap, a.dy AS ady, a.dx AS adx, b.dy AS bdy, b.dx AS bdx
  FROM dirs a JOIN dirs b ON a.image_id = b.image_id AND (a.y < b.y OR (a.y = b.y AND a.x < b.x)) AND a.comp <> b.comp WHERE a.dy IS NOT NULL AND b.dy IS NOT NULL),
al AS (SELECT *, ady * (y1 - y0) / gap + adx * (x1 - x0) / gap AS f1, -(bdy * (y1 - y0) / gap + bdx * (x1 - x0) / gap) AS f2 FROM pr WHERE gap >= 2 AND gap <= 5)
SELECT image_id, y0, x0, y1, x1, round(gap, 6) AS gap, round(f1, 6) AS align_first, round(f2, 6) AS align_second, round(gap - 8.0 * least(f1, f2), 6) + 0.0 AS score
FROM al WHERE f1 >= 0.2001 AND f2 >= 0.2001""",
)
def _(read):
    return rounded(H.pair_candidates(endpoints(read), 2.0, 5, 0.2001, 0.2001))


@query(
    "H2_pair_candidates_top",
    f"""{ENDS}, pr AS (SELECT a.image_id, a.y AS y0, a.x AS x0, b.y AS y1, b.x AS x1, sqrt(pow(b.y - a.y, 2) + pow(b.x - a.x, 2)) AS gap, a.dy AS ady, a.dx AS adx, b.dy AS bdy, b.dx AS bdx
  FROM dirs a JOIN dirs b ON a.image_id = b.image_id AND (a.y < b.y OR (a.y = b.y AND a.x < b.x)) AND a.comp <> b.comp WHERE a.dy IS NOT NULL AND b.dy IS NOT NULL),
al AS (SELECT *, ady * (y1 - y0) / gap + adx * (x1 - x0) / gap AS f1, -(bdy * (y1 - y0) / gap + bdx * (x1 - x0) / gap) AS f2 FROM pr WHERE gap >= 2 AND gap <= 6),
rk AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY gap - 8.0 * least(f1, f2), y0, x0, y1, x1) AS rank FROM al WHERE f1 >= 0.2001 AND f2 >= 0.2001)
SELECT image_id, y0, x0, y1, x1, round(gap, 6) AS gap, round(f1, 6) AS align_first, round(f2, 6) AS align_second, round(gap - 8.0 * least(f1, f2), 6) + 0.0 AS score, CAST(rank AS INTEGER) AS rank
FROM rk WHERE rank <= 3""",
)
def _(read):
    return rounded(H.pair_candidates(endpoints(read), 2.0, 6, 0.2001, 0.2001, n=3))


def _rounds(n):
    """Greedy pairs in SQL: n rounds that take what is first at both its points."""
    out, touches = [], "({b}.y0 = {a}.y0 AND {b}.x0 = {a}.x0 OR {b}.y0 = {a}.y1 AND {b}.x0 = {a}.x1 OR {b}.y1 = {a}.y0 AND {b}.x1 = {a}.x0 OR {b}.y1 = {a}.y1 AND {b}.x1 = {a}.x1)"
    meet = f"b.image_id = a.image_id AND {touches.format(a='a', b='b')}"
    for i in range(n):
        out.append(f"t{i} AS (SELECT * FROM l{i} a WHERE NOT EXISTS (SELECT 1 FROM l{i} b WHERE {meet} AND (b.score, b.y0, b.x0, b.y1, b.x1) < (a.score, a.y0, a.x0, a.y1, a.x1)))")
        out.append(f"l{i + 1} AS (SELECT * FROM l{i} a WHERE NOT EXISTS (SELECT 1 FROM t{i} b WHERE {meet}))")
    return ", ".join(out), " UNION ALL ".join(f"SELECT * FROM t{i}" for i in range(n))


_STEPS, _TAKEN = _rounds(8)


@query(
    "H2_greedy_pairs",
    f"""{ENDS}, pr AS (SELECT a.image_id, a.y AS y0, a.x AS x0, b.y AS y1, b.x AS x1, sqrt(pow(b.y - a.y, 2) + pow(b.x - a.x, 2)) AS gap, a.dy AS ady, a.dx AS adx, b.dy AS bdy, b.dx AS bdx
  FROM dirs a JOIN dirs b ON a.image_id = b.image_id AND (a.y < b.y OR (a.y = b.y AND a.x < b.x)) AND a.comp <> b.comp WHERE a.dy IS NOT NULL AND b.dy IS NOT NULL),
al AS (SELECT *, ady * (y1 - y0) / gap + adx * (x1 - x0) / gap AS f1, -(bdy * (y1 - y0) / gap + bdx * (x1 - x0) / gap) AS f2 FROM pr WHERE gap >= 2 AND gap <= 6),
l0 AS (SELECT image_id, y0, x0, y1, x1, round(gap - 8.0 * least(f1, f2), 6) + 0.0 AS score FROM al WHERE f1 >= 0.2001 AND f2 >= 0.2001),
{_STEPS} {_TAKEN}""",
)
def _(read):
    pairs = H.pair_candidates(endpoints(read), 2.0, 6, 0.2001, 0.2001).select("image_id", "y0", "x0", "y1", "x1", (F.round("score", 6) + 0.0).alias("score"))
    return B.greedy_pairs(pairs)


@query(
    "H3_aligned_fragments",
    f"""{ENDS}, nr AS (SELECT e.image_id, e.y, e.x, e.dy, e.dx, p.comp AS fc, p.y AS py, p.x AS px, sqrt(pow(p.y - e.y, 2) + pow(p.x - e.x, 2)) AS d,
  row_number() OVER (PARTITION BY e.image_id, e.y, e.x, p.comp ORDER BY pow(p.y - e.y, 2) + pow(p.x - e.x, 2), p.y, p.x) AS r
  FROM dirs e JOIN pc p ON p.image_id = e.image_id AND p.comp <> e.comp AND e.dy IS NOT NULL)
SELECT DISTINCT image_id, CAST(fc AS BIGINT) AS comp FROM nr WHERE r = 1 AND d <= 3 AND round(dy * (py - y) / d + dx * (px - x) / d, 9) >= 0.35""",
)
def _(read):
    cells = P.label(masked_cells(read), "pred").filter("pred").select("image_id", "y", "x", "comp")
    return H.aligned_fragments(cells, endpoints(read), 3)
