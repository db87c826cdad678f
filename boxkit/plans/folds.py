"""SQL of the queries that rest on greedy choices: recursive steps over the lists of one frame, for DuckDB.

A step takes the head of each list and leaves what the choice doesn't rule out, so a
recursion is as deep as a frame has choices. Tracks of the views never leave their
block of 25 frames, so track lists are taken block by block.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import ORACLES, QUERIES
from .fusion import _SQL_M, W
from .joins import AREA, INTER, IOU
from .streams import before_mark
from .views import with_views

BOX = ("x1", "y1", "x2", "y2")


def _iou(a: str, b: str) -> str:
    """IoU of two values that hold x1..y2 (rows or structs)."""
    return IOU.replace("c.", f"{a}.").replace("t.", f"{b}.")


def _pairs(name: str, least: float, also: str = "", extra: str = "", c: str = "computed", t: str = "truth") -> str:
    return f"{name} AS MATERIALIZED (SELECT c.seq_id, c.frame_id, c.det_id AS c_id, t.det_id AS t_id, {IOU} AS iou{extra} FROM {c} c JOIN {t} t ON c.seq_id = t.seq_id AND c.frame_id = t.frame_id{also} WHERE {IOU} >= {least!r}::DOUBLE AND {IOU} > 0)"


def _greedy(out: str, source: str, keys: str = "seq_id, frame_id", order: str = "-iou, c_id, t_id") -> str:
    """keys, c_id, t_id and iou of the pairs of a source taken in an order as long as both sides are free."""
    rest = "list_filter(rest, lambda x: x.c <> rest[1].c AND x.t <> rest[1].t)"
    return f"""{out}_c AS (SELECT {keys}, list({{'c': c_id, 't': t_id, 'i': iou}} ORDER BY {order}) AS rest FROM {source} GROUP BY {keys}),
{out}_s AS (SELECT {keys}, rest[1] AS m, {rest} AS rest FROM {out}_c UNION ALL SELECT {keys}, rest[1], {rest} FROM {out}_s WHERE len(rest) > 0),
{out} AS MATERIALIZED (SELECT {keys}, m.c AS c_id, m.t AS t_id, m.i AS iou FROM {out}_s)"""


_CLS = " AND c.cls = t.cls"
_MATCH = f"{_pairs('pairs', 0.5)},\n{_greedy('mm', 'pairs')}"
_BY_CLASS = f"{_pairs('pairs', 0.5, _CLS, ', c.cls AS cls')},\n{_greedy('mm', 'pairs', 'seq_id, frame_id, cls')}"
_MB = f"""{_MATCH},
mb AS MATERIALIZED (SELECT mm.*, c.track_id AS c_track, t.track_id AS t_track, c.cls AS c_cls, t.cls AS t_cls, c.conf AS c_conf, {", ".join(f"{p}.{k} AS {p}_{k}" for p in "ct" for k in BOX)}
FROM mm JOIN computed c ON c.det_id = c_id JOIN truth t ON t.det_id = t_id)"""


def _register(name: str, sql: str) -> None:
    ORACLES[name] = with_views(sql)


def _r(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes} {select}"


def _rates(source: str) -> str:
    """Rates of a source with tp, fp, fn, all columns kept."""
    ratio = lambda a, b: f"CASE WHEN ({b}) <> 0 THEN ({a}) / ({b})::DOUBLE ELSE 0 END"
    return f"""SELECT *, {ratio('2 * precision * recall', 'precision + recall')} AS f1, {ratio('fp', 'tp + fp')} AS fdr, {ratio('fn', 'tp + fn')} AS miss_rate, sqrt(precision * recall) - sqrt((1 - precision) * (1 - recall)) AS mcc
FROM (SELECT *, {ratio('tp', 'tp + fp')} AS precision, {ratio('tp', 'tp + fn')} AS recall FROM ({source}))"""


def _counts(keys: str, matches: str = "mm", c: str = "computed", t: str = "truth") -> str:
    return f"""SELECT {keys}, coalesce(n_computed, 0) AS n_computed, coalesce(n_truth, 0) AS n_truth, coalesce(tp, 0) AS tp, coalesce(n_computed, 0) - coalesce(tp, 0) AS fp, coalesce(n_truth, 0) - coalesce(tp, 0) AS fn
FROM (SELECT {keys}, count(*) AS n_computed FROM {c} GROUP BY {keys}) FULL JOIN (SELECT {keys}, count(*) AS n_truth FROM {t} GROUP BY {keys}) USING ({keys}) LEFT JOIN (SELECT {keys}, count(*) AS tp FROM {matches} GROUP BY {keys}) USING ({keys})"""


_register("match_greedy", _r(_MATCH, "SELECT * FROM mm"))
_register("match_conf_order", _r(f"{_pairs('pairs', 0.5, '', ', c.conf AS conf')},\n{_greedy('mm', 'pairs', order='-conf, c_id, -iou, t_id')}", "SELECT * FROM mm"))
_register("unmatched", _r(_MATCH, "SELECT seq_id, frame_id, det_id, 'fp' AS kind FROM computed WHERE det_id NOT IN (SELECT c_id FROM mm) UNION ALL SELECT seq_id, frame_id, det_id, 'fn' FROM truth WHERE det_id NOT IN (SELECT t_id FROM mm)"))
_register("stereo_match_iou", _r(f"{_pairs('pairs', 0.3, _CLS, ', c.cls AS cls')},\n{_greedy('mm', 'pairs', 'seq_id, frame_id, cls')}", "SELECT * FROM mm"))
_D = "(sqrt((c.x1 - t.x1) * (c.x1 - t.x1) + (c.y1 - t.y1) * (c.y1 - t.y1)) + sqrt((c.x2 - t.x2) * (c.x2 - t.x2) + (c.y2 - t.y2) * (c.y2 - t.y2))) / 2"
_register("stereo_match_keypoint", _r(f"pairs AS (SELECT c.seq_id, c.frame_id, c.det_id AS c_id, t.det_id AS t_id, -({_D}) AS iou FROM computed c JOIN truth t ON c.seq_id = t.seq_id AND c.frame_id = t.frame_id WHERE {_D} <= 12),\n{_greedy('mm', 'pairs')}", "SELECT seq_id, frame_id, c_id, t_id, -iou AS cost FROM mm"))
_register("multicam_chain_match", _r(f"""third AS (SELECT * REPLACE (x1 + 3 AS x1, x2 + 3 AS x2) FROM truth), {_MATCH},
{_pairs('pairs2', 0.5, c='truth', t='third')}, {_greedy('m2', 'pairs2')},
o AS (SELECT a.c_id AS c, coalesce(a.t_id, b.c_id) AS t, b.t_id AS u FROM mm a FULL JOIN m2 b ON a.t_id = b.c_id),
n AS (SELECT *, least(c * 4, t * 4 + 1, u * 4 + 2) AS root FROM o)""",
    "SELECT root AS object_id, c AS det_id, 0::BIGINT AS camera FROM n WHERE c IS NOT NULL UNION ALL SELECT root, t, 1 FROM n UNION ALL SELECT root, u, 2 FROM n WHERE u IS NOT NULL"))
_IN = "(greatest(0.0, least({0}.x2, 260) - greatest({0}.x1, 60)) * greatest(0.0, least({0}.y2, 400) - greatest({0}.y1, 0)) >= 0.5 * {1})"
_register("tile_boundary_merge", _r(f"""{_pairs('pairs', 0.0, f" AND c.det_id % 2 = 0 AND t.det_id % 2 = 1 AND c.cls = t.cls AND {_IN.format('c', AREA.format('c'))} AND {_IN.format('t', AREA.format('t'))}", t='computed')}, {_greedy('mm', 'pairs')}""",
    """SELECT seq_id, frame_id, det_id, x1, y1, x2, y2, conf, cls FROM computed WHERE det_id NOT IN (SELECT c_id FROM mm UNION ALL SELECT t_id FROM mm)
UNION ALL SELECT c.seq_id, c.frame_id, c.det_id, least(c.x1, t.x1), least(c.y1, t.y1), greatest(c.x2, t.x2), greatest(c.y2, t.y2), greatest(c.conf, t.conf), c.cls FROM mm JOIN computed c ON c.det_id = c_id JOIN computed t ON t.det_id = t_id"""))
_register("region_groups", _r(f"""b AS MATERIALIZED (SELECT * FROM truth SEMI JOIN (SELECT seq_id, frame_id FROM truth GROUP BY ALL HAVING count(*) > 4) USING (seq_id, frame_id)),
e AS MATERIALIZED (SELECT c.det_id AS a, t.det_id AS b FROM b c JOIN b t ON c.seq_id = t.seq_id AND c.frame_id = t.frame_id AND c.det_id <> t.det_id WHERE {INTER} > 0),
reach AS (SELECT det_id AS a, det_id AS b FROM b UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b),
g AS (SELECT a, min(b) AS grp FROM reach GROUP BY a)""",
    "SELECT seq_id, frame_id, grp, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, count(*) AS n FROM b JOIN g ON g.a = det_id GROUP BY ALL"))
_register("pair_count_join", _r(_MB, "SELECT seq_id, t_track, c_track, count(*) AS n FROM mb GROUP BY ALL"))

# suppression: the head stays and rules others out
_SMALL = f"({INTER} / least({AREA.format('c')}, {AREA.format('t')}))".replace("c.", "h.").replace("t.", "x.")
_RATIO = f"(greatest({AREA.format('h')}, {AREA.format('x')}) / least({AREA.format('h')}, {AREA.format('x')}))"


def _suppress(source: str, keys: str, hit: str) -> str:
    rest = f"list_filter(rest[2:], lambda x: NOT list_contains(list_transform([rest[1]], lambda h: {hit}), true))"
    item = "{'id': det_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'conf': conf, 'cls': cls}"
    return f"""l AS (SELECT {keys}, list({item} ORDER BY -conf, det_id) AS rest FROM {source} GROUP BY {keys}),
s AS (SELECT {keys}, rest[1] AS m, {rest} AS rest FROM l UNION ALL SELECT {keys}, rest[1], {rest} FROM s WHERE len(rest) > 0),
kept AS (SELECT seq_id, frame_id, m.id AS det_id, m.x1 AS x1, m.y1 AS y1, m.x2 AS x2, m.y2 AS y2, m.conf AS conf, m.cls AS cls FROM s)"""


_register("nms", _r(_suppress("computed", "seq_id, frame_id", f"{_SMALL} > 0.5 AND {_RATIO} <= 4"), "SELECT * FROM kept"))
_WEIGHED = f"(SELECT * REPLACE (conf * (CASE model {' '.join(f'WHEN {k!r} THEN {v!r}::DOUBLE' for k, v in W.items())} END) AS conf) FROM {_SQL_M})"
_register("fuse_nms", _r(_suppress(f"(SELECT * FROM {_WEIGHED} WHERE conf >= 0.2)", "seq_id, frame_id, cls", f"{_iou('h', 'x')} > 0.5"), "SELECT * FROM kept"))
_ITEM = "{'k': -conf, 'id': det_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}"
_DECAY = f"list_sort(list_transform(rest[2:], lambda x: {{'k': x.k * exp(-power(list_transform([rest[1]], lambda h: {_iou('x', 'h')})[1], 2) / 0.5), 'id': x.id, 'x1': x.x1, 'y1': x.y1, 'x2': x.x2, 'y2': x.y2}}))"
_register("fuse_soft_nms", _r(f"""l AS (SELECT seq_id, frame_id, cls, list({_ITEM} ORDER BY -conf, det_id) AS rest FROM {_WEIGHED} GROUP BY ALL),
s AS (SELECT seq_id, frame_id, cls, rest[1] AS m, {_DECAY} AS rest FROM l UNION ALL SELECT seq_id, frame_id, cls, rest[1], {_DECAY} FROM s WHERE len(rest) > 0)""",
    "SELECT seq_id, frame_id, cls, -m.k AS conf, m.id AS det_id, m.x1 AS x1, m.y1 AS y1, m.x2 AS x2, m.y2 AS y2 FROM s WHERE -m.k >= 0.05"))


def _clusters(source: str, keys: str) -> str:
    """Boxes by falling confidence join the cluster whose first box they overlap most, above half."""
    item = "{'id': det_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'conf': conf, 'cls': cls, 'model': model}"
    return f"""l AS (SELECT {keys}, list({item} ORDER BY -conf, det_id) AS b FROM {source} GROUP BY {keys}),
s AS (SELECT {keys}, b, 1 AS i, [b[1]] AS firsts, 0 AS cluster FROM l
UNION ALL SELECT {keys}, b, i + 1, CASE WHEN list_max(o) > LEAST THEN firsts ELSE list_append(firsts, b[i + 1]) END, CASE WHEN list_max(o) > LEAST THEN list_position(o, list_max(o)) - 1 ELSE len(firsts) END::INT
  FROM (SELECT *, list_transform(firsts, lambda h: list_transform([b[i + 1]], lambda x: {_iou('h', 'x')})[1]) AS o FROM s WHERE i < len(b))),
m AS MATERIALIZED (SELECT {keys.replace(', cls', '')}, cluster, b[i].id AS id, b[i].x1 AS x1, b[i].y1 AS y1, b[i].x2 AS x2, b[i].y2 AS y2, b[i].conf AS conf, b[i].cls AS cls, b[i].model AS model, firsts[cluster + 1] AS f FROM s)"""


_KEYS = "seq_id, frame_id, cls"
_MEAN = ", ".join(f"sum({k} * conf) / sum(conf) AS {k}" for k in BOX)
_register("fuse_wbf", _r(_clusters(_WEIGHED, _KEYS).replace("LEAST", "0.5"), f"SELECT seq_id, frame_id, cls, min(id) AS det_id, {_MEAN}, count(DISTINCT model) AS agree, avg(conf) * least(count(*), 3) / 3 AS conf FROM m GROUP BY seq_id, frame_id, cls, cluster"))
_register("fuse_nmw", _r(_clusters(_SQL_M, _KEYS).replace("LEAST", "0.5"), f"SELECT seq_id, frame_id, cls, arg_min(id, (-conf, id)) AS det_id, {', '.join(f'sum({k} * w) / sum(w) AS {k}' for k in BOX)}, max(conf) AS conf FROM (SELECT *, conf * {_iou('m', 'f')} AS w FROM m) GROUP BY seq_id, frame_id, cls, cluster"))
_register("cross_class_merge", _r(_clusters(_SQL_M, "seq_id, frame_id").replace("list_max(o) > LEAST", "len(list_filter(o, lambda v: v > 0.6)) > 0").replace("list_position(o, list_max(o))", "list_position(list_transform(o, lambda v: v > 0.6), true)") + ", p AS (SELECT seq_id, frame_id, cluster, cls, max(conf) AS s FROM m GROUP BY ALL), d AS (SELECT seq_id, frame_id, cluster, arg_max(cls, (s, cls)) AS cls, count(*) = 1 AS agree FROM p GROUP BY ALL)",
    f"SELECT seq_id, frame_id, det_id, x1, y1, x2, y2, conf, cls, agree FROM (SELECT seq_id, frame_id, cluster, min(id) AS det_id, {_MEAN}, max(conf) AS conf FROM m GROUP BY ALL) JOIN d USING (seq_id, frame_id, cluster)"))
_CLASSES = ["A", "N", "R", "X", "background"]
_POWER = f"(CASE model {' '.join(f'WHEN {k!r} THEN {v!r}::DOUBLE' for k, v in W.items())} END)"
_NEW = "{'x1': b[AT].x1, 'y1': b[AT].y1, 'x2': b[AT].x2, 'y2': b[AT].y2, 'w': b[AT].w, 'ids': [b[AT].id]}"
_GROWN = "{" + ", ".join(f"'{k}': (k.{k} * k.w + b[i + 1].{k} * b[i + 1].w) / (k.w + b[i + 1].w)" for k in BOX) + ", 'w': k.w + b[i + 1].w, 'ids': list_append(k.ids, b[i + 1].id)}"


def _log(x: str) -> str:
    p = "1 - m.conf" if x == "background" else f"CASE WHEN m.cls = '{x}' THEN m.conf ELSE 0 END"
    return f"sum({_POWER} * ln(least(1, greatest(1e-8, {p}))))"


_register("fuse_proben", _r(f"""src AS MATERIALIZED (SELECT *, conf * {_POWER} AS w FROM {_SQL_M} WHERE conf >= 0.2),
l AS (SELECT seq_id, frame_id, cls, list({{'id': det_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'w': w}} ORDER BY -conf, det_id) AS b FROM src GROUP BY ALL),
s AS (SELECT seq_id, frame_id, cls, b, 1 AS i, [{_NEW.replace('AT', '1')}] AS c FROM l
UNION ALL SELECT seq_id, frame_id, cls, b, i + 1, CASE WHEN list_max(o) > 0.5 THEN list_transform(c, lambda k, j: CASE WHEN j = list_position(o, list_max(o)) THEN {_GROWN} ELSE k END) ELSE list_append(c, {_NEW.replace('AT', 'i + 1')}) END
  FROM (SELECT *, list_transform(c, lambda h: list_transform([b[i + 1]], lambda x: {_iou('h', 'x')})[1]) AS o FROM s WHERE i < len(b))),
k AS (SELECT seq_id, frame_id, unnest(c) AS c FROM s WHERE i = len(b)), d AS (SELECT seq_id, frame_id, list_min(c.ids) AS det_id, c.x1 AS x1, c.y1 AS y1, c.x2 AS x2, c.y2 AS y2, len(c.ids) AS n, unnest(c.ids) AS id FROM k),
g AS (SELECT d.* EXCLUDE (id), [{', '.join(_log(x) for x in _CLASSES)}] AS l FROM d JOIN src m ON m.det_id = d.id GROUP BY ALL), e AS (SELECT *, list_transform(l, lambda v: exp(v - list_max(l))) AS e FROM g), q AS (SELECT *, list_transform(e, lambda v: v / list_sum(e)) AS q FROM e)""",
    "SELECT seq_id, frame_id, det_id, x1, y1, x2, y2, n, list_max(q[1:4]) AS conf, ['A', 'N', 'R', 'X'][list_position(q[1:4], list_max(q[1:4]))] AS cls FROM q"))

# scores
_register("score_detection", _r(_BY_CLASS, _rates(_counts("seq_id, cls"))))
ORACLES["io_metrics_write"] = ORACLES["score_detection"]
_register("score_localization", _r(_MB, f"""SELECT seq_id, avg(iou) AS mean_iou, median(iou) AS median_iou, avg(sqrt(dx * dx + dy * dy)) AS centre_distance, avg(abs(ca - ta) / ta) AS area_error
FROM (SELECT *, (c_x1 + c_x2) / 2 - (t_x1 + t_x2) / 2 AS dx, (c_y1 + c_y2) / 2 - (t_y1 + t_y2) / 2 AS dy, (c_x2 - c_x1) * (c_y2 - c_y1) AS ca, (t_x2 - t_x1) * (t_y2 - t_y1) AS ta FROM mb) GROUP BY seq_id"""))


def _events(seq: str, mb: str, truth: str) -> str:
    return f"""ev AS (SELECT *, lag(c_track) OVER (PARTITION BY {seq}, t_track ORDER BY frame_id, iou DESC, c_id, t_id) AS last_c, lag(t_track) OVER (PARTITION BY {seq}, c_track ORDER BY frame_id, iou DESC, c_id, t_id) AS last_t FROM {mb}),
en AS (SELECT {seq}, count(*) FILTER (last_c <> c_track) AS id_switches, count(*) FILTER (last_c <> c_track AND last_t IS NOT NULL) AS ascends, count(*) FILTER (last_t <> t_track) AS transfers FROM ev GROUP BY {seq}),
fs AS (SELECT {', '.join('t.' + k.strip() for k in seq.split(','))}, t.track_id, t.frame_id, t.det_id, CASE WHEN m.t_id IS NULL THEN 0 ELSE 1 END AS hit FROM {truth} t LEFT JOIN {mb} m ON m.t_id = t.det_id{' AND m.step = t.step' if 'step' in seq else ''}),
fw AS (SELECT *, lag(hit) OVER w AS before, sum(hit) OVER (PARTITION BY {seq}, track_id ORDER BY frame_id, det_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS had FROM fs WINDOW w AS (PARTITION BY {seq}, track_id ORDER BY frame_id, det_id)),
fr AS (SELECT {seq}, count(*) FILTER (hit = 1 AND before = 0 AND had > 0) AS fragmentations FROM fw GROUP BY {seq}),
events AS MATERIALIZED (SELECT {seq}, fragmentations, coalesce(id_switches, 0) AS id_switches, coalesce(ascends, 0) AS ascends, coalesce(transfers, 0) AS transfers FROM fr LEFT JOIN en USING ({seq}))"""


_register("id_switch", _r(f"{_MB},\n{_events('seq_id', 'mb', 'truth')}", "SELECT * FROM events"))
_MOT = "CASE WHEN n_truth > 0 THEN 1 - (fn + fp + id_switches) / n_truth::DOUBLE ELSE 0 END AS mota"
_register("score_mot", _r(f"{_MB},\n{_events('seq_id', 'mb', 'truth')}, n AS ({_counts('seq_id')})", f"SELECT n.*, fragmentations, id_switches, ascends, transfers, motp, {_MOT} FROM n JOIN events USING (seq_id) LEFT JOIN (SELECT seq_id, avg(iou) AS motp FROM mm GROUP BY seq_id) USING (seq_id)"))


def _idf1(seq: str, mb: str) -> str:
    return f"""tp AS (SELECT {seq}, t_track // 10 AS block, c_track AS c_id, t_track AS t_id, count(*)::DOUBLE AS iou FROM {mb} GROUP BY ALL),
{_greedy('tm', 'tp', f'{seq}, block')}, it AS (SELECT {seq}, sum(iou) AS idtp FROM tm GROUP BY {seq})"""


_IDS = "idtp / n_computed AS idp, idtp / n_truth AS idr, 2 * idtp / (n_computed + n_truth) AS idf1"
_register("score_idf1", _r(f"{_MB},\n{_idf1('seq_id', 'mb')}, n AS ({_counts('seq_id')})", f"SELECT seq_id, idtp, {_IDS} FROM (SELECT seq_id, coalesce(idtp, 0)::DOUBLE AS idtp, n_computed, n_truth FROM n LEFT JOIN it USING (seq_id))"))
_register("track_coverage", _r(f"""{_MB}, n AS ({_counts('seq_id')}),
sh AS (SELECT seq_id, track_id, coalesce(h, 0) / n AS share FROM (SELECT seq_id, track_id, count(*) AS n FROM truth GROUP BY ALL) LEFT JOIN (SELECT seq_id, t_track AS track_id, count(*) AS h FROM mb GROUP BY ALL) USING (seq_id, track_id)),
t AS (SELECT seq_id, count(*) FILTER (share >= 0.8) AS mt, count(*) FILTER (share >= 0.2 AND share < 0.8) AS pt, count(*) FILTER (share < 0.2) AS ml, count(*) AS tracks FROM sh GROUP BY seq_id),
f AS (SELECT seq_id, count(*) AS frames FROM (SELECT seq_id, frame_id FROM computed UNION SELECT seq_id, frame_id FROM truth) GROUP BY seq_id)""",
    "SELECT seq_id, mt, pt, ml, tracks, frames, fp, mt / tracks AS mt_ratio, ml / tracks AS ml_ratio, fp / frames AS faf FROM t JOIN f USING (seq_id) JOIN n USING (seq_id)"))
_register("score_hota", _r(f"""{_pairs('pairs', 0.05)}, al AS (SELECT a, 0.05::DOUBLE + 0.05::DOUBLE * a AS alpha FROM range(19) r(a)),
lv AS (SELECT * FROM pairs JOIN al ON iou >= alpha), {_greedy('mm', 'lv', 'a, seq_id, frame_id')},
p AS (SELECT a, mm.seq_id, c.track_id AS c_track, t.track_id AS t_track, count(*) AS tpa, sum(iou) AS iou FROM mm JOIN computed c ON c.det_id = c_id JOIN truth t ON t.det_id = t_id GROUP BY ALL),
q AS (SELECT p.*, tpa * tpa / (cn + tn - tpa) AS ass FROM p JOIN (SELECT seq_id, track_id AS c_track, count(*) AS cn FROM computed GROUP BY ALL) USING (seq_id, c_track) JOIN (SELECT seq_id, track_id AS t_track, count(*) AS tn FROM truth GROUP BY ALL) USING (seq_id, t_track)),
s AS (SELECT a, seq_id, sum(tpa) AS tp, sum(ass) AS ass, sum(iou) AS iou FROM q GROUP BY ALL),
n AS (SELECT seq_id, nc, nt FROM (SELECT seq_id, count(*) AS nc FROM computed GROUP BY 1) FULL JOIN (SELECT seq_id, count(*) AS nt FROM truth GROUP BY 1) USING (seq_id)),
f AS (SELECT seq_id, coalesce(tp, 0)::DOUBLE / (nc + nt - coalesce(tp, 0)) AS det_a, coalesce(ass / tp, 0) AS ass_a, coalesce(iou / tp, 0) AS loc_a FROM n CROSS JOIN al LEFT JOIN s USING (a, seq_id))""",
    "SELECT seq_id, avg(det_a) AS det_a, avg(ass_a) AS ass_a, avg(loc_a) AS loc_a, avg(sqrt(det_a * ass_a)) AS hota FROM f GROUP BY seq_id"))


def _runs(side: str, boxes: str, other: str, p: str) -> str:
    """{p}r: runs of equal match status; {p}k: per track segments, length, hits, purity, continuity."""
    return f"""{p}s AS MATERIALIZED (SELECT b.seq_id, b.track_id, b.frame_id, b.det_id, m.{other}_track AS partner, CASE WHEN m.{other}_track IS NULL THEN 0 ELSE 1 END AS matched FROM {boxes} b LEFT JOIN mb m ON m.{side}_id = b.det_id),
{p}n AS (SELECT *, CASE WHEN lag(matched) OVER w = matched THEN 0 ELSE 1 END AS new FROM {p}s WINDOW w AS (PARTITION BY seq_id, track_id ORDER BY frame_id, det_id)),
{p}u AS (SELECT *, sum(new) OVER (PARTITION BY seq_id, track_id ORDER BY frame_id, det_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM {p}n),
{p}r AS MATERIALIZED (SELECT seq_id, track_id, run, matched, min(frame_id) AS first, max(frame_id) AS last, count(*) AS states FROM {p}u GROUP BY ALL),
{p}k AS (SELECT seq_id, track_id, hits, purity, 1 / greatest(1, segments) AS continuity FROM (SELECT seq_id, track_id, sum(matched) AS segments, sum(states * matched) AS hits FROM {p}r GROUP BY ALL)
  LEFT JOIN (SELECT seq_id, track_id, max(n) / sum(n) AS purity FROM (SELECT seq_id, track_id, partner, count(*) AS n FROM {p}s WHERE matched = 1 GROUP BY ALL) GROUP BY ALL) USING (seq_id, track_id))"""


_CR, _TR = _runs("c", "computed", "t", "c"), _runs("t", "truth", "c", "t")
_SIDE = "SELECT seq_id, avg(continuity) AS continuity, avg(purity) AS purity, avg(CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END) AS hit_share, '{0}' AS side FROM {0}k GROUP BY seq_id"
_register("score_kwant", _r(f"{_MB}, {_CR}, {_TR}", f"{_SIDE.format('c')} UNION ALL {_SIDE.format('t')}"))
_register("matched_runs", _r(f"{_MB}, {_TR}", "SELECT * FROM tr"))
_register("score_track_quality", _r(f"""{_MB}, {_TR}, w AS (SELECT *, min(CASE WHEN matched = 1 THEN run END) OVER p AS lo, max(CASE WHEN matched = 1 THEN run END) OVER p AS hi FROM tr WINDOW p AS (PARTITION BY seq_id, track_id)),
g AS (SELECT seq_id, avg(states) AS gap_length FROM w WHERE matched = 0 AND run > lo AND run < hi GROUP BY seq_id),
q AS (SELECT seq_id, avg(n) AS length, avg(h / n) AS completeness FROM (SELECT seq_id, track_id, sum(states) AS n, sum(states * matched) AS h FROM tr GROUP BY ALL) GROUP BY seq_id)""",
    "SELECT seq_id, length, completeness, coalesce(gap_length, 0) AS gap_length FROM q LEFT JOIN g USING (seq_id)"))
_register("track_buffer_fit", _r(f"{_MB}, {_TR}", "SELECT seq_id, greatest(10, least(100, trunc(quantile_cont(states, 0.9) * 1.5 + 5)::INT))::INT AS buffer FROM tr WHERE matched = 0 GROUP BY seq_id"))
_register("detector_quality", _r(f"{_MB}, {_TR}", """SELECT e.*, unmatched_conf, miss_run FROM (SELECT seq_id, avg(c_conf) AS matched_conf, avg(sqrt(dx * dx + dy * dy) / (t_y2 - t_y1)) AS centre_error, avg(abs((c_x2 - c_x1) / (t_x2 - t_x1) - 1)) AS scale_error
FROM (SELECT *, (c_x1 + c_x2 - t_x1 - t_x2) / 2 AS dx, (c_y1 + c_y2 - t_y1 - t_y2) / 2 AS dy FROM mb) GROUP BY seq_id) e
LEFT JOIN (SELECT seq_id, avg(conf) AS unmatched_conf FROM computed WHERE det_id NOT IN (SELECT c_id FROM mm) GROUP BY seq_id) USING (seq_id) LEFT JOIN (SELECT seq_id, avg(states) AS miss_run FROM tr WHERE matched = 0 GROUP BY seq_id) USING (seq_id)"""))
_register("score_cls_accuracy", _r(_MB, "SELECT seq_id, avg(CASE WHEN c_cls = t_cls THEN 1.0 ELSE 0.0 END) AS accuracy FROM mb GROUP BY seq_id"))
_BY_CONF = f"{_pairs('pairs', 0.5, '', ', c.conf AS conf')},\n{_greedy('mm', 'pairs', order='-conf, c_id, -iou, t_id')}"
_CURVE = f"""{_BY_CONF}, h AS (SELECT c.seq_id, c.conf, count(m.c_id) AS t, count(*) AS c FROM computed c LEFT JOIN mm m ON m.c_id = c.det_id GROUP BY ALL),
k AS (SELECT seq_id, conf, (sum(t) OVER w)::BIGINT AS tp, (sum(c) OVER w - sum(t) OVER w)::BIGINT AS fp FROM h WINDOW w AS (PARTITION BY seq_id ORDER BY conf DESC ROWS UNBOUNDED PRECEDING)),
curve AS MATERIALIZED (SELECT seq_id, conf, tp, fp, fn, precision, recall, f1 FROM ({_rates('SELECT k.*, n - tp AS fn FROM k JOIN (SELECT seq_id, count(*) AS n FROM truth GROUP BY 1) USING (seq_id)')}))"""
_register("pr_curve", _r(_CURVE, "SELECT * FROM curve"))
_register("pr_best_f1", _r(_CURVE, "SELECT seq_id, max(f1) AS f1, arg_max(conf, (f1, conf)) AS threshold FROM curve GROUP BY seq_id"))
_register("roc_curve", _r(f"""{_CURVE}, f AS (SELECT seq_id, count(*) AS frames FROM (SELECT seq_id, frame_id FROM computed UNION SELECT seq_id, frame_id FROM truth) GROUP BY 1),
r AS (SELECT seq_id, conf, recall AS pd, fp / frames AS fa FROM curve JOIN f USING (seq_id)), a AS (SELECT *, (fa - coalesce(lag(fa) OVER w, 0)) * (pd + coalesce(lag(pd) OVER w, 0)) / 2 AS area FROM r WINDOW w AS (PARTITION BY seq_id ORDER BY conf DESC))""",
    "SELECT seq_id, count(*) AS points, max(fa) AS max_fa, CASE WHEN max(fa) <> 0 THEN sum(area) / max(fa) ELSE 0 END AS mean_pd FROM a GROUP BY seq_id"))
_register("confusion", _r(f"""{_MATCH}, j AS (SELECT t.cls AS t_cls, c.cls AS c_cls FROM (SELECT c.det_id, c.cls, m.t_id FROM computed c LEFT JOIN mm m ON m.c_id = c.det_id) c FULL JOIN truth t ON t.det_id = c.t_id),
n AS (SELECT coalesce(t_cls, 'background') AS truth, coalesce(c_cls, 'background') AS computed, count(*) AS n FROM j GROUP BY ALL)""", "SELECT *, n / sum(n) OVER (PARTITION BY truth) AS share FROM n"))
_HIST = lambda src, col, bins: f"SELECT least(floor({col} * {bins}), {bins - 1})::INT AS bin, count(*) AS n, '{col}' AS what FROM {src} WHERE {col} IS NOT NULL GROUP BY 1"
_register("score_histograms", _r(f"{_MB}, {_CR}", f"{_HIST('mm', 'iou', 20)} UNION ALL {_HIST('ck', 'purity', 10)} UNION ALL {_HIST('ck', 'continuity', 10)}"))


_TH = [(i, 0.5 + 0.05 * i) for i in range(10)]
_AP = """r AS (SELECT *, sum(tp) OVER w / count(*) OVER w AS p FROM d WINDOW w AS (PARTITION BY {0} ORDER BY conf DESC, det_id ROWS UNBOUNDED PRECEDING)),
v AS (SELECT *, max(p) OVER (PARTITION BY {0} ORDER BY conf, det_id DESC ROWS UNBOUNDED PRECEDING) AS env FROM r),
ap AS (SELECT {0}, coalesce(sum(env) FILTER (tp = 1), 0) / {1} AS ap FROM v GROUP BY {0})"""
_register("score_ap", _r(f"""th AS (SELECT * FROM (VALUES {', '.join(f'({i}, {x!r}::DOUBLE)' for i, x in _TH)}) v(i, least)), {_pairs('base', 0.5, '', ', c.conf AS conf')},
pairs AS (SELECT * FROM base JOIN th ON iou >= least), {_greedy('mm', 'pairs', 'i, seq_id, frame_id', '-conf, c_id, -iou, t_id')},
d AS (SELECT th.i, c.conf, c.det_id, CASE WHEN m.c_id IS NULL THEN 0 ELSE 1 END AS tp FROM computed c CROSS JOIN th LEFT JOIN mm m ON m.c_id = c.det_id AND m.i = th.i), {_AP.format('i', '(SELECT count(*) FROM truth)')}""",
    "SELECT max(ap) FILTER (i = 0) AS ap50, max(ap) FILTER (i = 5) AS ap75, avg(ap) AS ap50_95 FROM ap"))
_register("score_per_class", _r(f"""{_BY_CLASS}, {_pairs('pairs2', 0.5, _CLS, ', c.cls AS cls, c.conf AS conf')}, {_greedy('m2', 'pairs2', 'seq_id, frame_id, cls', '-conf, c_id, -iou, t_id')},
d AS (SELECT c.cls, c.conf, c.det_id, CASE WHEN m.c_id IS NULL THEN 0 ELSE 1 END AS tp FROM computed c LEFT JOIN m2 m ON m.c_id = c.det_id), tn AS (SELECT cls, count(*) AS tn FROM truth GROUP BY cls), {_AP.format('cls', '1')},
n AS ({_rates(_counts('cls'))}), o AS (SELECT n.*, CASE WHEN tn IS NOT NULL THEN coalesce(ap, 0) / tn END AS ap FROM n LEFT JOIN ap USING (cls) LEFT JOIN tn USING (cls))""",
    "SELECT *, avg(coalesce(ap, 0)) FILTER (n_truth > 0) OVER () AS map FROM o"))
_SW = f"""st AS (SELECT s AS step, s / 10.0::DOUBLE AS threshold FROM range(10) r(s)), cs AS MATERIALIZED (SELECT c.*, step FROM computed c JOIN st ON conf >= threshold), ts AS MATERIALIZED (SELECT truth.*, step FROM truth, st),
{_pairs('base', 0.5)}, pairs AS (SELECT base.*, cs.step FROM base JOIN cs ON cs.det_id = c_id), {_greedy('mm', 'pairs', 'step, seq_id, frame_id')},
mb AS MATERIALIZED (SELECT mm.*, c.track_id AS c_track, t.track_id AS t_track FROM mm JOIN computed c ON c.det_id = c_id JOIN truth t ON t.det_id = t_id),
{_events('step, seq_id', 'mb', 'ts')}, {_idf1('step, seq_id', 'mb')}, n AS ({_counts('step, seq_id', 'mm', 'cs', 'ts')}),
sw AS MATERIALIZED (SELECT seq_id, step / 10.0::DOUBLE AS threshold, {_MOT}, CASE WHEN n_computed + n_truth > 0 THEN 2 * coalesce(idtp, 0) / (n_computed + n_truth) ELSE 0 END AS idf1 FROM n LEFT JOIN events USING (step, seq_id) LEFT JOIN it USING (step, seq_id)),
best AS MATERIALIZED (SELECT seq_id, max(mota) AS mota, arg_max(threshold, (mota, -threshold)) AS mota_at, max(idf1) AS idf1, arg_max(threshold, (idf1, -threshold)) AS idf1_at FROM sw GROUP BY seq_id)"""
_register("threshold_sweep", _r(_SW, "SELECT * FROM best"))
_register("filter_from_sweep", _r(f"{_SW}, r AS (SELECT seq_id::VARCHAR AS k, least(mota_at, idf1_at) AS min, (mota_at + idf1_at) / 2 AS mean, idf1_at AS idf1, mota_at AS mota FROM best)", "SELECT * FROM r UNION ALL SELECT 'default', min(min), min(mean), min(idf1), min(mota) FROM r"))

# sequences and tracks
_FR = "SELECT seq_id, frame_id, max(conf) > 0.75 AS has_truth FROM computed GROUP BY ALL"
_register("burst_split", f"""WITH f AS ({_FR}), d AS (SELECT *, (row_number() OVER (PARTITION BY seq_id ORDER BY frame_id) - 1) % 25 < 5 AS v FROM f),
t AS (SELECT seq_id, count(*) FILTER (v) AS nv, count(*) FILTER (NOT v) AS nt, min(frame_id) AS first, max(frame_id) AS last FROM d WHERE has_truth GROUP BY seq_id)
SELECT seq_id, frame_id, has_truth, CASE WHEN nv = 0 AND frame_id = first THEN true WHEN nt = 0 AND frame_id = last THEN false ELSE v END AS validation FROM d LEFT JOIN t USING (seq_id)""")
_register("bg_downsample", f"""WITH f AS ({_FR}), r AS (SELECT *, sum(has_truth::INT) OVER (PARTITION BY seq_id ORDER BY frame_id) AS run FROM f), i AS (SELECT *, sum((NOT has_truth)::INT) OVER (PARTITION BY seq_id, run ORDER BY frame_id) - 1 AS i FROM r)
SELECT seq_id, frame_id, has_truth FROM i WHERE has_truth OR (i >= 1 AND (i - 1) % 3 = 0)""")
_HASH = "('0x' || substr(md5('{0}:' || {1}), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
_register("neg_ratio", f"""WITH f AS ({_FR}), n AS (SELECT count(*) FILTER (has_truth) AS pos, count(*) FILTER (NOT has_truth) AS neg FROM f)
SELECT seq_id, frame_id, has_truth FROM f, n WHERE has_truth OR NOT (neg > pos * 0.25 AND neg > 10) OR {_HASH.format('0', "seq_id || ':' || frame_id")} < pos * 0.25::DOUBLE / neg""")
_register("knn_sampled", f"""WITH n AS (SELECT count(*) AS n FROM descriptors), v AS (SELECT uid, vec FROM descriptors, n WHERE n <= 400 OR {_HASH.format('7', 'uid')} < greatest(0.5::DOUBLE, 10.0::DOUBLE / n)), q AS (SELECT uid AS query_id, vec AS qvec FROM descriptors WHERE uid::BIGINT % 100 = 0),
d AS (SELECT query_id, uid, list_distance(vec::DOUBLE[], qvec::DOUBLE[]) AS distance FROM v, q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, uid) AS rank FROM d) WHERE rank <= 5""")
_register("link_iou_greedy", _r(f"""prev AS (SELECT * REPLACE (frame_id + 1 AS frame_id) FROM computed), {_pairs('pairs', 0.2, t='prev')}, {_greedy('mm', 'pairs')},
ch AS (SELECT det_id AS head, det_id AS node FROM computed WHERE det_id NOT IN (SELECT c_id FROM mm) UNION ALL SELECT head, c_id FROM ch JOIN mm ON t_id = node), top AS (SELECT head, min(node) AS root FROM ch GROUP BY head)""",
    "SELECT seq_id, frame_id, det_id, root AS linked_track FROM ch JOIN top USING (head) JOIN computed ON det_id = node"))
_register("link_iou_homography", _r(f"""prev AS (SELECT * REPLACE (frame_id + 1 AS frame_id, x1 + dx AS x1, x2 + dx AS x2, y1 + dy AS y1, y2 + dy AS y2) FROM (SELECT *, CASE WHEN (frame_id + 1) % 7 <> 0 THEN (frame_id + 1) % 3 ELSE 0 END AS dx, CASE WHEN (frame_id + 1) % 7 <> 0 THEN (frame_id + 1) % 2 ELSE 0 END AS dy FROM computed)), {_pairs('pairs', 0.2, ' AND c.frame_id // 100 = (t.frame_id - 1) // 100', t='prev')}, {_greedy('mm', 'pairs')},
ch AS (SELECT det_id AS head, det_id AS node FROM computed WHERE det_id NOT IN (SELECT c_id FROM mm) UNION ALL SELECT head, c_id FROM ch JOIN mm ON t_id = node), top AS (SELECT head, min(node) AS root FROM ch GROUP BY head)""",
    "SELECT seq_id, frame_id, det_id, root AS linked_track FROM ch JOIN top USING (head) JOIN computed ON det_id = node"))
_LR = f"{_MB}, lr AS MATERIALIZED (SELECT seq_id, frame_id, t_track * 8 + seq_id AS left_id, c_track * 8 + seq_id AS right_id FROM mb)"
_register("stereo_link_components", _r(f"""{_LR}, e AS MATERIALIZED (SELECT DISTINCT left_id * 2 AS a, right_id * 2 + 1 AS b FROM lr), e2 AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT DISTINCT a, a AS b FROM e2 UNION SELECT reach.a, e2.b FROM reach JOIN e2 ON e2.a = reach.b), g AS (SELECT a, min(b) AS root FROM reach GROUP BY a)""",
    "SELECT CASE WHEN a % 2 = 0 THEN 'left' ELSE 'right' END AS side, a // 2 AS track_id, root AS object_id FROM g"))
_register("stereo_pair_most_likely", _r(f"""{_LR}, g AS (SELECT left_id, right_id, count(*) AS n, list(DISTINCT frame_id) AS f FROM lr GROUP BY ALL),
b AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY right_id ORDER BY n DESC, left_id) = 1), l AS (SELECT left_id, list({{'r': right_id, 'f': f}} ORDER BY -n, right_id) AS a FROM b GROUP BY left_id),
s AS (SELECT left_id, a, 1 AS i, [a[1].r] AS ids, a[1].f AS seen FROM l
UNION ALL SELECT left_id, a, i + 1, CASE WHEN list_has_any(seen, a[i + 1].f) THEN ids ELSE list_append(ids, a[i + 1].r) END, CASE WHEN list_has_any(seen, a[i + 1].f) THEN seen ELSE list_concat(seen, a[i + 1].f) END FROM s WHERE i < len(a))""",
    "SELECT left_id, unnest(range(len(ids)))::INT AS place, unnest(ids) AS right_id FROM s WHERE i = len(a)"))
_register("stereo_pair_split", _r(f"""{_LR}, c AS (SELECT *, CASE WHEN lag(right_id) OVER w = right_id THEN 0 ELSE 1 END AS new FROM lr WINDOW w AS (PARTITION BY left_id ORDER BY frame_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY left_id ORDER BY frame_id) AS run FROM c), u AS (SELECT seq_id, left_id, run, any_value(right_id) AS right_id, count(*) AS n FROM r GROUP BY ALL),
k AS (SELECT *, CASE WHEN lag(right_id) OVER (PARTITION BY left_id ORDER BY run) <> right_id THEN 1 ELSE 0 END AS turn FROM u WHERE n >= 3 OR run = 1),
p AS (SELECT u.left_id, u.run, sum(coalesce(turn, 0)) OVER (PARTITION BY u.left_id ORDER BY u.run)::INT AS part FROM u LEFT JOIN k ON k.left_id = u.left_id AND k.run = u.run)""",
    "SELECT seq_id, left_id, frame_id, part FROM r JOIN p USING (left_id, run)"))
_SHOTS = """WITH RECURSIVE f AS MATERIALIZED (SELECT stream_id, frame_id, row_number() OVER (PARTITION BY stream_id ORDER BY frame_id) AS i, change_score FROM frames),
h AS (SELECT *, min(CASE WHEN change_score > 90 THEN i END) OVER (PARTITION BY stream_id ORDER BY i ROWS BETWEEN 5 FOLLOWING AND UNBOUNDED FOLLOWING) AS hit FROM f), n AS MATERIALIZED (SELECT stream_id, i, least(coalesce(hit, i + 60), i + 60) AS nxt FROM h),
s AS (SELECT stream_id, 0 AS segment, i, nxt FROM n WHERE i = 1 UNION ALL SELECT n.stream_id, segment + 1, n.i, n.nxt FROM s JOIN n ON n.stream_id = s.stream_id AND n.i = s.nxt)
SELECT f.stream_id, f.frame_id, s.segment FROM f ASOF JOIN s ON f.stream_id = s.stream_id AND f.i >= s.i"""
_register("shot_segments", _SHOTS)
_register("stream_shots", before_mark(_SHOTS.replace("FROM frames", "FROM due")))
_register("stream_gsd", before_mark("""WITH f AS (SELECT stream_id, frame_id, change_score AS value, change_score > 20 AS ok FROM due), g AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY stream_id ORDER BY frame_id) AS k FROM f), o AS (SELECT stream_id, k, value FROM g WHERE ok),
e AS (SELECT a.stream_id, a.k, sum(b.value * power(0.5::DOUBLE, a.k - b.k + CASE WHEN b.k = 1 THEN 0 ELSE 1 END)) AS v FROM o a JOIN o b ON a.stream_id = b.stream_id AND b.k BETWEEN a.k - 80 AND a.k GROUP BY ALL)
SELECT g.stream_id, frame_id, e.v AS value FROM g LEFT JOIN e ON e.stream_id = g.stream_id AND e.k = g.k"""))
_register("stream_rolling_desc", before_mark("""WITH d AS (SELECT label::BIGINT AS track, uid::BIGINT AS frame_id, vec FROM due), e AS (SELECT track, frame_id, unnest(range(len(vec))) AS pos, unnest(vec)::DOUBLE AS v FROM d),
m AS (SELECT track, frame_id, pos, avg(v) OVER (PARTITION BY track, pos ORDER BY frame_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS v FROM e)
SELECT track, frame_id, round(max(v) FILTER (pos = 0), 6) AS first, round(max(v) FILTER (pos = 63), 6) AS last, round(sum(v), 6) AS total, round(sum(v * v), 6) AS square FROM m GROUP BY ALL""", "descriptors", "uid::BIGINT", 60, 1))

# frames, centres, negatives
_register("kmedians", """WITH v AS MATERIALIZED (SELECT uid, vec::DOUBLE[] AS vec FROM descriptors), k0 AS (SELECT row_number() OVER (ORDER BY md5('0' || uid)) - 1 AS c, vec AS centre FROM v QUALIFY c < 4),
""" + ",\n".join(f"""n{i} AS (SELECT uid, arg_min(c, (list_sum(list_transform(list_zip(vec, centre), lambda z: abs(z[1] - z[2]))), c)) AS c FROM v, k{i} GROUP BY uid),
e{i} AS (SELECT c, unnest(range(64)) AS pos, unnest(vec) AS x FROM v JOIN n{i} USING (uid)), m{i} AS (SELECT c, list(x ORDER BY pos) AS centre FROM (SELECT c, pos, median(x) AS x FROM e{i} GROUP BY ALL) GROUP BY c),
k{i + 1} AS MATERIALIZED (SELECT c, coalesce(m{i}.centre, k{i}.centre) AS centre FROM k{i} LEFT JOIN m{i} USING (c))""" for i in range(3)) + " SELECT c::INT AS cluster, unnest(range(64))::INT AS dim, unnest(centre) AS value FROM k3")
_register("auto_negatives", """WITH RECURSIVE h AS MATERIALIZED (SELECT uid, list_transform(vec, lambda x: abs(x::DOUBLE) / list_sum(list_transform(vec, lambda y: abs(y::DOUBLE)))) AS vec FROM descriptors),
p AS (SELECT uid AS pos, vec, row_number() OVER (ORDER BY uid) AS i FROM h WHERE uid::BIGINT % 100 = 0),
c AS MATERIALIZED (SELECT i, any_value(pos) AS pos, list(uid ORDER BY round(1 - list_sum(list_transform(list_zip(p.vec, h.vec), lambda z: least(z[1], z[2]))), 12) DESC, uid) AS uids FROM p, (SELECT h.uid, h.vec FROM h WHERE uid::BIGINT % 100 <> 0) h GROUP BY i),
s AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS taken, []::VARCHAR[] AS mine, '' AS pos UNION ALL
SELECT c.i, list_concat(taken, list_filter(c.uids, lambda u: NOT list_contains(taken, u))[1:3]), list_filter(c.uids, lambda u: NOT list_contains(taken, u))[1:3], c.pos FROM s JOIN c ON c.i = s.i + 1)
SELECT pos, unnest(mine) AS uid FROM s WHERE i > 0""")
_register("filter_frame_index", """WITH RECURSIVE f AS MATERIALIZED (SELECT DISTINCT seq_id, frame_id FROM computed WHERE frame_id BETWEEN 10 AND 5000), n AS MATERIALIZED (SELECT a.seq_id, a.frame_id, b.frame_id AS nxt FROM f a ASOF JOIN f b ON a.seq_id = b.seq_id AND a.frame_id + 7 <= b.frame_id),
s AS (SELECT seq_id, min(frame_id) AS frame_id FROM f GROUP BY seq_id UNION ALL SELECT n.seq_id, nxt FROM s JOIN n USING (seq_id, frame_id)) SELECT * FROM s""")

_register("link_imagelog", """WITH RECURSIVE img AS MATERIALIZED (SELECT site, frame, CASE WHEN frame % 11 <> 0 THEN lat END AS lat, lon, row_number() OVER (PARTITION BY site ORDER BY frame) AS i FROM images WHERE pass_no = 1),
lg AS MATERIALIZED (SELECT site, frame, lat, lon, row_number() OVER (PARTITION BY site ORDER BY frame) AS k FROM images WHERE pass_no = 2),
s AS (SELECT site, 0::BIGINT AS i, 0::BIGINT AS k, NULL::BIGINT AS frame, NULL::DOUBLE AS d FROM (SELECT DISTINCT site FROM img)
UNION ALL SELECT site, i, CASE WHEN d <= 25 THEN k ELSE before + 1 END, frame, CASE WHEN d <= 25 THEN d END
  FROM (SELECT s.site, img.i, img.frame, s.k AS before, arg_min(lg.k, (#FAR, lg.k)) AS k, min(#FAR) AS d FROM s JOIN img ON img.site = s.site AND img.i = s.i + 1 JOIN lg ON lg.site = s.site AND lg.k BETWEEN s.k + 1 AND s.k + 60 GROUP BY s.site, img.i, img.frame, s.k))
SELECT s.site, s.frame, lg.frame AS log_frame, d AS distance, CASE WHEN d IS NULL THEN 'order' ELSE 'position' END AS "by" FROM s JOIN lg ON lg.site = s.site AND lg.k = s.k WHERE s.i > 0""".replace("#FAR", "CASE WHEN img.lat IS NOT NULL THEN sqrt(((img.lat - lg.lat) * 111320) ^ 2 + ((img.lon - lg.lon) * 111320 * cos(radians(img.lat))) ^ 2) END"))
_register("calibrate_fit", f"""WITH hit AS (SELECT DISTINCT c.det_id FROM {_SQL_M} c JOIN truth t ON c.seq_id = t.seq_id AND c.frame_id = t.frame_id AND c.cls = t.cls WHERE {IOU} >= 0.5),
b AS (SELECT model, cls, floor(conf * 1000 + 0.5) / 1000 AS x, CASE WHEN h.det_id IS NULL THEN 0 ELSE 1 END AS hit FROM {_SQL_M} m LEFT JOIN hit h USING (det_id)),
s AS (SELECT model, cls, x, sum(hit) AS h, count(*) AS w FROM b GROUP BY ALL UNION ALL SELECT model, '*', x, sum(hit), count(*) FROM b GROUP BY ALL),
p AS MATERIALIZED (SELECT model, cls, x, h, w, row_number() OVER k AS i, sum(h) OVER k AS ch, sum(w) OVER k AS cw FROM s WINDOW k AS (PARTITION BY model, cls ORDER BY x)),
m AS (SELECT a.model, a.cls, a.i AS a, b.i, min((b.ch - a.ch + a.h)::DOUBLE / (b.cw - a.cw + a.w)::DOUBLE) OVER (PARTITION BY a.model, a.cls, a.i ORDER BY b.i DESC) AS low FROM p a JOIN p b ON a.model = b.model AND a.cls = b.cls AND b.i >= a.i),
y AS (SELECT model, cls, i, max(low) AS y FROM m GROUP BY ALL), z AS (SELECT model, cls, y, min(x) AS lo, max(x) AS hi, sum(sum(w)) OVER (PARTITION BY model, cls) AS total FROM y JOIN p USING (model, cls, i) GROUP BY model, cls, y),
q AS (SELECT DISTINCT model, cls, y, unnest([lo, hi]) AS x FROM z WHERE total >= 20), r AS (SELECT *, row_number() OVER (PARTITION BY model, cls ORDER BY x) - 1 AS k, count(*) OVER (PARTITION BY model, cls) AS n FROM q)
SELECT model, cls, x, y FROM r WHERE k % greatest(1, ceil(n / 32)::INT) = 0 OR k = n - 1""")

#: Sums and means whose last bits depend on the order of rows, given to nine places by both.
ROUNDED = {
    "fuse_soft_nms": ["conf"], "fuse_wbf": [*BOX, "conf"], "fuse_nmw": [*BOX, "conf"], "fuse_proben": [*BOX, "conf"], "cross_class_merge": [*BOX, "conf"],
    "score_detection": ["precision", "recall", "f1", "fdr", "miss_rate", "mcc"], "io_metrics_write": ["precision", "recall", "f1", "fdr", "miss_rate", "mcc"], "score_per_class": ["precision", "recall", "f1", "fdr", "miss_rate", "mcc", "ap", "map"],
    "score_localization": ["mean_iou", "median_iou", "centre_distance", "area_error"], "score_mot": ["motp", "mota"], "score_idf1": ["idp", "idr", "idf1"], "track_coverage": ["mt_ratio", "ml_ratio", "faf"], "score_hota": ["det_a", "ass_a", "loc_a", "hota"],
    "score_kwant": ["continuity", "purity", "hit_share"], "score_track_quality": ["length", "completeness", "gap_length"], "score_ap": ["ap50", "ap75", "ap50_95"], "score_cls_accuracy": ["accuracy"],
    "pr_curve": ["precision", "recall", "f1"], "pr_best_f1": ["f1"], "roc_curve": ["max_fa", "mean_pd"], "confusion": ["share"], "threshold_sweep": ["mota", "idf1"], "detector_quality": ["matched_conf", "centre_error", "scale_error", "unmatched_conf", "miss_run"],
    "stream_gsd": ["value"], "kmedians": ["value"], "knn_sampled": ["distance"], "match_greedy": ["iou"], "match_conf_order": ["iou"], "stereo_match_iou": ["iou"], "stereo_match_keypoint": ["cost"],
}


def _rounded(f, columns):
    return lambda spark, sf: f(spark, sf).withColumns({c: F.round(c, 9) for c in columns})


for _name, _columns in ROUNDED.items():
    QUERIES[_name] = _rounded(QUERIES[_name], _columns)
    ORACLES[_name] = f"SELECT * REPLACE ({', '.join(f'round({c}, 9) AS {c}' for c in _columns)}) FROM ({ORACLES[_name]})"
