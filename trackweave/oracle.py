"""DuckDB SQL for the registered queries of the engine's own operators, one text for each."""

from __future__ import annotations

SAMPLES = """f AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_index FROM events),
g AS (SELECT *, (frame_index * 7 + user_id * 13) % 200 AS phase FROM f WHERE event_type <> 'error'),
h AS (SELECT *, CASE WHEN phase < 100 THEN phase ELSE 200 - phase END AS swing FROM g),
q AS (SELECT 's' || CAST(user_id % 8 AS VARCHAR) AS session_id, CAST(user_id AS INT) AS track_id, frame_index,
 CAST(200 + (user_id * 37) % 240 AS DOUBLE) AS anchor_x, swing * CAST(4.8 AS DOUBLE) AS anchor_y, 24 + swing * CAST(0.5 AS DOUBLE) AS head_size,
 CAST(0.06 AS DOUBLE) + (user_id % 10) * CAST(0.03 AS DOUBLE) AS body_ratio FROM h),
s AS (SELECT *, CASE WHEN anchor_y > 264 THEN 'INSIDE' WHEN anchor_y < 216 THEN 'OUTSIDE' ELSE 'BUFFER' END AS zone,
 anchor_x < 400 AND anchor_y >= 150 AND anchor_y <= 300 AS in_door, anchor_y > 420 AS in_spawn FROM q)"""

STAGGERED = SAMPLES.replace("s AS (SELECT *, CASE", "s AS (SELECT * REPLACE (frame_index + (track_id // 8) % 16 * 37 AS frame_index), CASE")

VISITS = """r AS (SELECT *, row_number() OVER (PARTITION BY session_id, track_id ORDER BY frame_index) AS pos,
 row_number() OVER (PARTITION BY session_id, track_id, zone ORDER BY frame_index) AS own FROM s WHERE zone <> 'BUFFER'),
v AS (SELECT session_id, track_id, row_number() OVER (PARTITION BY session_id, track_id ORDER BY min(pos)) AS visit_no, zone, count(*) AS samples,
 median(head_size) AS median_head, avg(anchor_x) AS mean_x, avg(anchor_y) AS mean_y FROM r GROUP BY session_id, track_id, zone, pos - own HAVING count(*) >= 3),
w AS (SELECT *, lag(zone) OVER o AS from_zone, lag(median_head) OVER o AS from_head, lag(mean_x) OVER o AS fx, lag(mean_y) OVER o AS fy FROM v WINDOW o AS (PARTITION BY session_id, track_id ORDER BY visit_no)),
t AS (SELECT session_id, track_id, visit_no, from_zone, zone AS to_zone, sqrt((mean_x - fx) * (mean_x - fx) + (mean_y - fy) * (mean_y - fy)) AS shift,
 CASE WHEN from_head <= 1e-6 THEN 1.0 ELSE median_head / from_head END AS head_ratio FROM w WHERE from_zone IS NOT NULL)"""

FACTS = """b AS (SELECT *, row_number() OVER (PARTITION BY session_id, track_id ORDER BY frame_index DESC) AS back FROM s),
fa AS (SELECT session_id, track_id, count(*) AS n, max(body_ratio) AS body_ratio, bool_or(in_door) AS ever_in_door,
 arg_min(zone, frame_index) AS first_zone, arg_min(in_spawn, frame_index) AS first_spawn, min(frame_index) AS born, max(frame_index) AS ended,
 arg_min(anchor_x, frame_index) AS bx, arg_min(anchor_y, frame_index) AS by_, arg_max(anchor_x, frame_index) AS ex, arg_max(anchor_y, frame_index) AS ey,
 bool_or(back <= 3 AND (in_door OR zone = 'OUTSIDE')) AS ends_at_exit,
 max(CASE WHEN back = 2 THEN anchor_x END) AS px, max(CASE WHEN back = 2 THEN anchor_y END) AS py FROM b GROUP BY session_id, track_id),
ta AS (SELECT session_id, track_id, anchor_x AS tx, anchor_y AS ty, head_size AS th, zone AS tz FROM b WHERE back <= 3
 QUALIFY row_number() OVER (PARTITION BY session_id, track_id ORDER BY CASE WHEN zone = 'OUTSIDE' THEN 2 WHEN in_door THEN 1 ELSE 0 END DESC, back) = 1)"""

EARLY = """ea AS (SELECT session_id, track_id, max(sqrt((anchor_x - x0) * (anchor_x - x0) + (anchor_y - y0) * (anchor_y - y0))) AS early_shift FROM
 (SELECT *, row_number() OVER o AS k, first_value(anchor_x) OVER o AS x0, first_value(anchor_y) OVER o AS y0 FROM s WINDOW o AS (PARTITION BY session_id, track_id ORDER BY frame_index)) WHERE k <= 3 GROUP BY session_id, track_id)"""

SUCCESSORS = """su AS (SELECT DISTINCT a.session_id, a.track_id FROM fa a JOIN fa c ON a.session_id = c.session_id AND a.track_id <> c.track_id AND c.born > a.ended AND c.born - a.ended <= 50
 AND sqrt((c.bx - a.ex) * (c.bx - a.ex) + (c.by_ - a.ey) * (c.by_ - a.ey)) <= 400 JOIN ea ON ea.session_id = c.session_id AND ea.track_id = c.track_id AND ea.early_shift < 100)"""

FATES = f"""{STAGGERED}, {VISITS}, {FACTS}, {EARLY}, {SUCCESSORS},
vs AS (SELECT session_id, track_id, count(*) AS visits, count(*) FILTER (zone = 'INSIDE') AS inside, count(*) FILTER (zone = 'OUTSIDE') AS outside, arg_min(zone, visit_no) AS fz, arg_max(zone, visit_no) AS lz,
 arg_max(median_head, visit_no) FILTER (zone = 'INSIDE') AS ih, arg_max(mean_x, visit_no) FILTER (zone = 'INSIDE') AS ix, arg_max(mean_y, visit_no) FILTER (zone = 'INSIDE') AS iy FROM v GROUP BY ALL),
cr AS (SELECT session_id, track_id, count(*) AS moved_out, count(*) FILTER (head_ratio <= 0.92) AS shrank_out FROM t WHERE from_zone = 'INSIDE' AND to_zone = 'OUTSIDE' AND shift >= 100 GROUP BY ALL),
ce AS (SELECT session_id, max(frame_index) AS final_frame FROM s GROUP BY ALL),
al AS (SELECT fa.*, ta.*  EXCLUDE (session_id, track_id), visits, inside, outside, fz, lz, ih, ix, iy, coalesce(moved_out, 0) AS moved_out, coalesce(shrank_out, 0) AS shrank_out, su.track_id IS NOT NULL AS followed,
 final_frame - ended <= 3 AS visible,
 CASE fa.track_id % 5 WHEN 0 THEN 'STARTUP_DOOR' WHEN 1 THEN 'STARTUP_OUTSIDE' WHEN 2 THEN 'STARTUP_INSIDE' WHEN 3 THEN (CASE WHEN first_zone = 'INSIDE' AND first_spawn THEN 'SPAWN_INSIDE' ELSE 'INVALID' END) ELSE 'INVALID' END AS origin
 FROM fa JOIN ta USING (session_id, track_id) LEFT JOIN vs USING (session_id, track_id) LEFT JOIN cr USING (session_id, track_id) LEFT JOIN su USING (session_id, track_id) JOIN ce USING (session_id)),
fo AS (SELECT *, origin IN ('STARTUP_DOOR', 'STARTUP_OUTSIDE') AS at_exit FROM al),
st AS (SELECT *, CASE WHEN at_exit AND ((inside = 0 AND NOT visible) OR (origin = 'STARTUP_DOOR' AND fz = 'OUTSIDE')) THEN 1 ELSE 0 END AS startup, CASE WHEN ever_in_door THEN moved_out ELSE shrank_out END AS crossings,
 NOT followed AND lz = 'INSIDE' AND ends_at_exit AND sqrt((tx - ix) * (tx - ix) + (ty - iy) * (ty - iy)) >= 100 AND sqrt((px - ix) * (px - ix) + (py - iy) * (py - iy)) >= 60 AND ((CASE WHEN ih <= 1e-6 THEN 1.0 ELSE th / ih END) <= 0.92 OR tz = 'OUTSIDE') AS lost FROM fo),
ex AS (SELECT *, n < 3 AS few, NOT at_exit AND body_ratio < 0.1 AS far FROM st),
fi AS (SELECT *, CASE WHEN few OR far THEN 0 WHEN coalesce(visits, 0) = 0 THEN (CASE WHEN at_exit AND NOT visible THEN 1 ELSE 0 END) WHEN startup > 0 THEN startup WHEN crossings > 0 THEN crossings WHEN lost THEN 1 ELSE 0 END AS exits FROM ex),
fate AS (SELECT session_id, track_id, CAST(exits AS BIGINT) AS exits, CASE WHEN few THEN 'UNDECIDED' WHEN far THEN 'PASSERBY' WHEN exits > 0 THEN 'EXITED' WHEN coalesce(visits, 0) = 0 THEN 'UNDECIDED' WHEN inside = visits THEN 'ONBOARD_STATIONARY' WHEN outside = visits AND NOT ever_in_door THEN 'PASSERBY' ELSE 'UNDECIDED' END AS fate FROM fi)"""

DETECTIONS = """e1 AS (SELECT *, 's' || CAST(event_id % 8 AS VARCHAR) AS session_id FROM events),
e2 AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) - 1 AS n FROM e1),
d AS (SELECT session_id, CAST(n // 5 AS INT) AS frame_index, CAST(n % 5 AS INT) AS det_seq, CAST((event_id * 37) % 600 AS DOUBLE) AS x1, CAST((event_id * 53) % 420 AS DOUBLE) AS y1,
 CAST((event_id * 37) % 600 + 24 + event_id % 40 AS DOUBLE) AS x2, CAST((event_id * 53) % 420 + 30 + (event_id * 3) % 60 AS DOUBLE) AS y2, ((event_id * 17) % 100) / CAST(100 AS DOUBLE) AS confidence FROM e2)"""

# Zones are axis-parallel here: the even-odd rule holds points on the left and lower-numbered edges.
LABELLED = f"""{DETECTIONS}, c AS (SELECT *, (x1 + x2) / 2 AS ax, (y1 + y2) / 2 AS ay FROM d),
l AS (SELECT *, CASE WHEN ay >= 264 AND ay < 480 AND ax >= 0 AND ax < 640 THEN 'INSIDE' WHEN ay >= 0 AND ay < 216 AND ax >= 0 AND ax < 640 THEN 'OUTSIDE' ELSE 'BUFFER' END AS zone,
 ax >= 200 AND ax < 440 AND ay >= 150 AND ay < 300 AS in_door FROM c)"""

COUNTED = f"""{LABELLED}, k AS (SELECT session_id, frame_index, count(*) FILTER (zone = 'INSIDE') AS inside, count(*) FILTER (zone = 'OUTSIDE') AS outside, count(*) FILTER (zone = 'BUFFER') AS buffer, count(*) FILTER (in_door) AS doorway FROM l GROUP BY ALL)"""

INITIAL = """i AS (SELECT session_id, max(inside) AS initial FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY frame_index) AS p FROM k WHERE inside + outside + buffer > 0) WHERE p <= 25 GROUP BY ALL)"""

HEAD = "greatest(least(least(greatest((y2 - y1) * 0.28, 12), y2 - y1) + y1, 480), 0)"
HEAD_W = "least(greatest((x2 - x1) * CAST(0.65 AS DOUBLE), 12), x2 - x1)"


def _hold(value: str, most: int) -> str:
    return f"round(least(greatest({value}, 0), {most}), 6)"


MIDDLE = "((x1 + x2) / 2)"
HEAD_COLUMNS = f"{_hold(f'{MIDDLE} - {HEAD_W} / 2', 640)} AS head_x1, {_hold('y1', 480)} AS head_y1, {_hold(f'{MIDDLE} + {HEAD_W} / 2', 640)} AS head_x2, round({HEAD}, 6) AS head_y2"
BODY_COLUMNS = f"{_hold(f'{MIDDLE} - (x2 - x1) * 1.4', 640)} AS body_x1, {_hold('y1', 480)} AS body_y1, {_hold(f'{MIDDLE} + (x2 - x1) * 1.4', 640)} AS body_x2, {_hold('y1 + (y2 - y1) * 5.5', 480)} AS body_y2"
NATIVE = f"""SELECT session_id, frame_index, det_seq, {HEAD_COLUMNS}, {BODY_COLUMNS}, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2,
 (x2 - x1) / 640 > 0.24 OR (y2 - y1) / 480 > 0.38 OR (x2 - x1) / 640 * ((y2 - y1) / 480) > 0.08 AS large,
 ({MIDDLE} <= 192 AND (y1 + y2) / 2 <= CAST(172.8 AS DOUBLE)) OR greatest(least(x2, 192) - greatest(x1, 0), 0) * greatest(least(y2, CAST(172.8 AS DOUBLE)) - greatest(y1, 0), 0) / greatest((x2 - x1) * (y2 - y1), 1) >= 0.35 AS masked FROM d"""

PAIRS = f"""{DETECTIONS}, pr AS (SELECT a.session_id, a.frame_index, b.det_seq AS track_id, a.det_seq, a.x1, a.y1, a.x2, a.y2, b.x1 AS p1, b.y1 AS q1, b.x2 AS p2, b.y2 AS q2,
 least(a.x2, b.x2) - greatest(a.x1, b.x1) AS w, least(a.y2, b.y2) - greatest(a.y1, b.y1) AS h FROM d a JOIN d b ON a.session_id = b.session_id AND a.frame_index = b.frame_index + 1),
io AS (SELECT *, CASE WHEN w > 0 AND h > 0 THEN w * h / ((x2 - x1) * (y2 - y1) + (p2 - p1) * (q2 - q1) - w * h) ELSE 0.0 END AS iou,
 sqrt((x1 + x2 - p1 - p2) / 2 * ((x1 + x2 - p1 - p2) / 2) + (y1 + y2 - q1 - q2) / 2 * ((y1 + y2 - q1 - q2) / 2)) AS center_px FROM pr)"""

FILES = """fl AS (SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN '/data/processed/failed/' WHEN 1 THEN '/data/processed/' WHEN 2 THEN '/data/incoming/' WHEN 3 THEN '/data/videos/' ELSE '/srv/other/' END AS folder,
 CASE WHEN o_orderkey % 11 = 0 THEN 'x' ELSE CAST(1000 + o_custkey % 50 AS VARCHAR) END AS device, strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(epoch(date_trunc('day', o_orderdate)) AS BIGINT) AS start FROM orders),
fn AS (SELECT *, concat_ws('_', k % 6, 'E' || k % 9, k % 3, start, start + 60, '0', k) || CASE WHEN k % 13 = 0 THEN '.txt' ELSE '.MP4' END AS name FROM fl),
fp AS (SELECT *, folder || device || '/' || day || '/' || name AS path, start * 1000 + k AS modified_ms FROM fn)"""

BINDINGS = """bi AS (SELECT c_custkey AS id, 'rec' || c_custkey % 30 AS recorder_id, CAST(c_custkey % 7 AS VARCHAR) AS camera_code, CASE c_custkey % 4 WHEN 0 THEN 'FRONT' WHEN 1 THEN 'REAR' WHEN 2 THEN 'CUSTOM' ELSE 'NEEDS_CLASSIFICATION' END AS logical_door,
 CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_nationkey AS BIGINT) END AS profile_id, c_custkey % 3 <> 0 AS active, c_custkey * 1000 AS updated_ms FROM customer)"""
LATEST = "QUALIFY row_number() OVER (PARTITION BY recorder_id, camera_code ORDER BY updated_ms DESC) = 1"
CAMERAS = "ca AS (SELECT s_suppkey, 'rec' || s_suppkey % 40 AS recorder_id, CAST(s_suppkey % 9 AS VARCHAR) AS camera_code FROM supplier)"

RESULTS = """re AS (SELECT 'r' || o_orderkey AS session_id, CASE o_orderstatus WHEN 'F' THEN 'FINISHED' WHEN 'O' THEN 'STOPPED' ELSE 'FAILED' END AS status, 'd' || o_custkey % 50 AS video_device_id,
 CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderkey % 6 AS INT) END AS channel, 'E' || o_orderkey % 9 AS event_code, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(epoch(date_trunc('day', o_orderdate)) AS BIGINT) * 1000 END AS clip_started_ms,
 CAST(epoch(date_trunc('day', o_orderdate)) AS BIGINT) * 1000 + o_orderkey % 1000 AS finished_ms, CAST(o_orderkey % 5 AS INT) AS alightings, CAST(o_orderkey % 7 AS INT) AS exited, CAST(o_orderkey % 40 AS INT) AS onboard FROM orders)"""

DOOR = """e1 AS (SELECT *, 's' || CAST(event_id % 8 AS VARCHAR) AS session_id FROM events),
e2 AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) - 1 AS k FROM e1),
dw AS (SELECT session_id, k, CAST(k * 5 AS INT) AS frame_index, k * 5 / CAST(10 AS DOUBLE) AS video_s, k % 90 = 2 AS active,
 list_transform([0, 1, 2, 3], lambda i: CASE WHEN k % 90 >= 50 THEN CAST(0.9 AS DOUBLE) - CAST(0.2 AS DOUBLE) * i ELSE CAST(0.1 AS DOUBLE) + CAST(0.2 AS DOUBLE) * i END) AS door,
 list_transform([0, 1, 2, 3], lambda i: CASE WHEN k % 60 > 30 THEN ((k * (i + 1) + event_id % 7) % 5) * CAST(0.2 AS DOUBLE) ELSE CAST(0.25 AS DOUBLE) * i END) AS street FROM e2),
dm AS (SELECT *, list_sum(door) / 4 AS md, list_sum(street) / 4 AS ms FROM dw),
dn AS (SELECT *, greatest(sqrt(list_sum(list_transform(door, lambda x: (x - md) * (x - md))) / 4) + CAST(0.08 AS DOUBLE), CAST(0.08 AS DOUBLE)) AS nd, greatest(sqrt(list_sum(list_transform(street, lambda x: (x - ms) * (x - ms))) / 4) + CAST(0.08 AS DOUBLE), CAST(0.08 AS DOUBLE)) AS ns FROM dm),
df AS (SELECT session_id, k, frame_index, video_s, active, list_transform(door, lambda x: (x - md) / nd) AS door, list_transform(street, lambda x: (x - ms) / ns) AS street FROM dn)"""

IDLE = """ac AS (SELECT *, last_value(CASE WHEN active THEN video_s END IGNORE NULLS) OVER so AS seen_at FROM df WINDOW so AS (PARTITION BY session_id ORDER BY frame_index ROWS UNBOUNDED PRECEDING)),
id AS (SELECT *, seen_at IS NOT NULL AS activity_seen, coalesce(greatest(video_s - seen_at, 0.0), 0.0) AS idle_s FROM ac)"""


def _gap(a: str, b: str) -> str:
    return f"least(greatest(list_sum(list_transform(list_zip({a}, {b}), lambda p: abs(p[1] - p[2]))) / 4 / 2, 0.0), 1.0)"


STATES = f"""{DOOR}, {IDLE},
mo AS (SELECT *, CASE WHEN lag(door) OVER o IS NULL THEN 0.0 ELSE {_gap("door", "(lag(door) OVER o)")} END AS door_motion, CASE WHEN lag(street) OVER o IS NULL THEN 0.0 ELSE {_gap("street", "(lag(street) OVER o)")} END AS scene_motion,
 CASE WHEN k = 0 THEN 0.0 ELSE 0.5 END AS delta_s FROM id WINDOW o AS (PARTITION BY session_id ORDER BY frame_index)),
qu AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY frame_index) AS p FROM mo WHERE NOT active AND door_motion <= 0.30 AND activity_seen) WHERE p <= 6),
rf AS (SELECT session_id, [avg(door[1]), avg(door[2]), avg(door[3]), avg(door[4])] AS reference, max(frame_index) AS ready FROM qu GROUP BY ALL HAVING count(*) >= 6),
ga AS (SELECT mo.*, coalesce(frame_index >= ready, false) AS known, CASE WHEN coalesce(frame_index >= ready, false) THEN {_gap("door", "reference")} ELSE 0.0 END AS gap FROM mo LEFT JOIN rf USING (session_id)),
ds AS (SELECT *, CASE WHEN NOT known THEN 'CALIBRATING' WHEN active OR door_motion > 0.30 THEN 'UNKNOWN' WHEN gap <= 0.10 THEN 'OPEN' WHEN gap >= 0.22 THEN 'CLOSED' ELSE 'UNKNOWN' END AS door_state FROM ga),
gr AS (SELECT *, sum(CASE WHEN door_state = 'CLOSED' THEN 0 ELSE 1 END) OVER so AS cg, sum(CASE WHEN scene_motion >= 0.14 THEN 0 ELSE 1 END) OVER so AS mg FROM ds WINDOW so AS (PARTITION BY session_id ORDER BY frame_index ROWS UNBOUNDED PRECEDING)),
se AS (SELECT *, CASE WHEN door_state = 'CLOSED' THEN sum(CASE WHEN door_state = 'CLOSED' THEN delta_s ELSE 0.0 END) OVER (PARTITION BY session_id, cg ORDER BY frame_index ROWS UNBOUNDED PRECEDING) ELSE 0.0 END AS closed_s,
 CASE WHEN scene_motion >= 0.14 THEN sum(CASE WHEN scene_motion >= 0.14 THEN delta_s ELSE 0.0 END) OVER (PARTITION BY session_id, mg ORDER BY frame_index ROWS UNBOUNDED PRECEDING) ELSE 0.0 END AS moving_s FROM gr)"""

# A row of detector output in one of four forms; boxes are read by corners and by centre where the form doesn't tell.
READ = """v AS (SELECT *, CASE det_seq WHEN 0 THEN [(x1 + x2) / 2, (y1 + y2) / 2 + 80, x2 - x1, y2 - y1, confidence, 0] WHEN 1 THEN [(x1 + x2) / 1280, ((y1 + y2) / 2 + 80) / 640, (x2 - x1) / 640, (y2 - y1) / 640, confidence, 0]
 WHEN 2 THEN [0, 1, x1, y1 + 80, x2, y2 + 80] WHEN 3 THEN [] ELSE [x1 + 0.5, y1 + 80.5, x2 + 0.5, y2 + 80.5, confidence, 0] END AS r FROM d),
g0 AS (SELECT *, abs(r[1] - round(r[1])) < 1e-3 AND abs(r[2] - round(r[2])) < 1e-3 AND r[5] > r[3] AND r[6] > r[4] AS batch,
 CASE WHEN r[1] BETWEEN -0.05 AND 1.5 AND r[2] BETWEEN -0.05 AND 1.5 AND r[3] BETWEEN -0.05 AND 1.5 AND r[4] BETWEEN -0.05 AND 1.5 THEN 640 ELSE 1 END AS k FROM v WHERE len(r) >= 5),
g1 AS (SELECT *, [r[1] * k, r[2] * k, r[3] * k, r[4] * k] AS c, [(r[1] - r[3] / 2) * k, (r[2] - r[4] / 2) * k, (r[1] + r[3] / 2) * k, (r[2] + r[4] / 2) * k] AS m FROM g0),
g2 AS (SELECT *, c[3] > c[1] AND c[4] > c[2] AS okc, m[3] > m[1] AND m[4] > m[2] AS okm, list_transform([1, 2, 3, 4], lambda i: least(greatest(c[i] - CASE WHEN i % 2 = 0 THEN 80 ELSE 0 END, 0), CASE WHEN i % 2 = 0 THEN 480 ELSE 640 END)) AS fc,
 list_transform([1, 2, 3, 4], lambda i: least(greatest(m[i] - CASE WHEN i % 2 = 0 THEN 80 ELSE 0 END, 0), CASE WHEN i % 2 = 0 THEN 480 ELSE 640 END)) AS fm FROM g1),
g3 AS (SELECT *, (fc[3] - fc[1]) * (fc[4] - fc[2]) / 307200 AS ac, (fm[3] - fm[1]) * (fm[4] - fm[2]) / 307200 AS am, (fc[3] - fc[1]) / greatest(fc[4] - fc[2], 1) BETWEEN 0.45 AND 1.8 AS sc, (fm[3] - fm[1]) / greatest(fm[4] - fm[2], 1) BETWEEN 0.45 AND 1.8 AS sm FROM g2),
g4 AS (SELECT *, CASE WHEN batch THEN 'b' WHEN NOT okc AND okm THEN 'm' WHEN NOT okm AND okc THEN 'c' WHEN NOT okm THEN 'n' WHEN ac > 0.18 AND am < ac THEN 'm' WHEN am > 0.18 AND ac < am THEN 'c' WHEN sm AND NOT sc THEN 'm' ELSE 'c' END AS how FROM g3),
g5 AS (SELECT session_id, frame_index, det_seq, CASE how WHEN 'b' THEN 1.0 ELSE r[5] END AS score, CASE how WHEN 'b' THEN [x1, y1, least(x2, 640), least(y2, 480)] WHEN 'm' THEN fm ELSE fc END AS f FROM g4 WHERE how <> 'n'),
rr AS (SELECT *, f[1] AS a1, f[2] AS b1, f[3] AS a2, f[4] AS b2 FROM g5)"""

# The machine of a line: one more sample of every track in each round.
LINE = """ps AS (SELECT session_id, track_id, anchor_y AS y, row_number() OVER o AS pos, first_value(anchor_y) OVER o AS y0, CASE WHEN anchor_y < 216 THEN 'OUTSIDE' WHEN anchor_y > 264 THEN 'INSIDE' ELSE 'DOORWAY' END AS zone FROM s WINDOW o AS (PARTITION BY session_id, track_id ORDER BY frame_index)),
pg AS (SELECT *, pos - row_number() OVER (PARTITION BY session_id, track_id, zone ORDER BY pos) AS island, max(pos) OVER (PARTITION BY session_id, track_id) AS most FROM ps),
pr AS (SELECT *, row_number() OVER (PARTITION BY session_id, track_id, zone, island ORDER BY pos) AS run, y - y0 >= 40 AS mi, y0 - y >= 40 AS mo FROM pg),
lr AS (SELECT session_id, track_id, CAST(0 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS most, 'UNKNOWN' AS state, false AS boarded, false AS alighted, 0 AS b, 0 AS a FROM (SELECT DISTINCT session_id, track_id FROM s)
 UNION ALL SELECT session_id, track_id, pos, most, CASE w WHEN 'BOARD' THEN 'BOARDED' WHEN 'EXIT' THEN 'ALIGHTED' WHEN 'UNDO_EXIT' THEN 'INSIDE' WHEN 'UNDO_BOARD' THEN 'OUTSIDE' WHEN 'NONE' THEN state ELSE w END,
 CASE WHEN w = 'BOARD' THEN true WHEN w IN ('UNDO_BOARD', 'EXIT') THEN false ELSE boarded END, CASE WHEN w = 'EXIT' THEN true WHEN w IN ('UNDO_EXIT', 'BOARD') THEN false ELSE alighted END,
 b + CASE w WHEN 'BOARD' THEN 1 WHEN 'UNDO_BOARD' THEN -1 ELSE 0 END, a + CASE w WHEN 'EXIT' THEN 1 WHEN 'UNDO_EXIT' THEN -1 ELSE 0 END
 FROM (SELECT *, CASE WHEN what = 'BOARD' AND boarded OR what = 'EXIT' AND alighted THEN 'NONE' ELSE what END AS w FROM (SELECT l.session_id, l.track_id, r.pos, r.most, l.state, l.boarded, l.alighted, l.b, l.a,
 CASE WHEN r.run < 3 THEN 'NONE' WHEN l.alighted AND r.zone = 'INSIDE' THEN 'UNDO_EXIT' WHEN l.boarded AND r.zone = 'OUTSIDE' THEN 'UNDO_BOARD'
 WHEN l.state = 'UNKNOWN' THEN CASE WHEN r.zone = 'OUTSIDE' THEN 'OUTSIDE' WHEN r.zone = 'INSIDE' AND r.mi THEN 'BOARD' WHEN r.zone = 'INSIDE' THEN 'INSIDE' ELSE 'NONE' END
 WHEN l.state = 'OUTSIDE' THEN CASE r.zone WHEN 'DOORWAY' THEN 'FROM_OUTSIDE' WHEN 'INSIDE' THEN 'BOARD' ELSE 'NONE' END
 WHEN l.state = 'INSIDE' THEN CASE WHEN r.zone = 'DOORWAY' THEN 'FROM_INSIDE' WHEN r.zone = 'OUTSIDE' AND r.mo THEN 'EXIT' ELSE 'NONE' END
 WHEN l.state = 'FROM_OUTSIDE' THEN CASE r.zone WHEN 'INSIDE' THEN 'BOARD' WHEN 'OUTSIDE' THEN 'OUTSIDE' ELSE 'NONE' END
 WHEN l.state = 'FROM_INSIDE' THEN CASE WHEN r.zone = 'OUTSIDE' AND r.mo THEN 'EXIT' WHEN r.zone = 'OUTSIDE' THEN 'OUTSIDE' WHEN r.zone = 'INSIDE' THEN 'INSIDE' ELSE 'NONE' END
 WHEN l.state = 'BOARDED' AND r.zone = 'DOORWAY' THEN 'FROM_INSIDE' WHEN l.state = 'ALIGHTED' AND r.zone = 'DOORWAY' THEN 'FROM_OUTSIDE' ELSE 'NONE' END AS what
 FROM lr l JOIN pr r ON r.session_id = l.session_id AND r.track_id = l.track_id AND r.pos = l.pos + 1)))"""

STOPS = """sq AS (SELECT *, scene_motion >= 0.14 AND moving_s >= 5 AS driving, row_number() OVER (PARTITION BY session_id ORDER BY frame_index) AS n FROM se),
sp AS (SELECT session_id, CAST(0 AS BIGINT) AS n, CAST(0 AS INT) AS frame_index, '' AS door_state, CAST(NULL AS VARCHAR) AS reason, CAST(0 AS DOUBLE) AS since, false AS stopped FROM (SELECT DISTINCT session_id FROM se)
 UNION ALL SELECT session_id, n, frame_index, door_state, CASE WHEN stopped THEN reason WHEN reason IS NOT NULL THEN CASE WHEN broken THEN NULL ELSE reason END ELSE fresh END,
 CASE WHEN NOT stopped AND reason IS NULL AND fresh IS NOT NULL THEN video_s ELSE since END, stopped OR (reason IS NOT NULL AND NOT broken AND video_s - since >= 3)
 FROM (SELECT p.session_id, q.n, q.frame_index, q.door_state, p.reason, p.since, p.stopped, q.video_s, CASE p.reason WHEN 'DOOR_CLOSED' THEN q.active OR q.door_state <> 'CLOSED' WHEN 'INACTIVITY_AND_MOVEMENT' THEN q.active OR NOT q.driving ELSE false END AS broken,
 CASE WHEN q.video_s < 8 THEN NULL WHEN q.door_state = 'CLOSED' AND q.closed_s >= 4 AND q.idle_s >= 2 THEN 'DOOR_CLOSED' WHEN q.activity_seen AND q.idle_s >= 30 AND q.driving THEN 'INACTIVITY_AND_MOVEMENT' END AS fresh
 FROM sp p JOIN sq q ON q.session_id = p.session_id AND q.n = p.n + 1))"""

GREEDY = """rk AS (SELECT *, row_number() OVER (PARTITION BY session_id, frame_index ORDER BY iou DESC, center_px, track_id, det_seq) AS n FROM io WHERE iou >= 0.05),
gm AS (SELECT session_id, frame_index, CAST(0 AS BIGINT) AS n, CAST([] AS INT[]) AS ts, CAST([] AS INT[]) AS ds, CAST(0 AS INT) AS track_id, CAST(0 AS INT) AS det_seq, CAST(0 AS DOUBLE) AS iou, CAST(0 AS DOUBLE) AS center_px, false AS kept FROM (SELECT DISTINCT session_id, frame_index FROM rk)
 UNION ALL SELECT session_id, frame_index, n, CASE WHEN free THEN list_append(ts, track_id) ELSE ts END, CASE WHEN free THEN list_append(ds, det_seq) ELSE ds END, track_id, det_seq, iou, center_px, free
 FROM (SELECT g.session_id, g.frame_index, r.n, g.ts, g.ds, r.track_id, r.det_seq, r.iou, r.center_px, NOT list_contains(g.ts, r.track_id) AND NOT list_contains(g.ds, r.det_seq) AS free FROM gm g JOIN rk r ON r.session_id = g.session_id AND r.frame_index = g.frame_index AND r.n = g.n + 1))"""

SUPPRESSED = """rk AS (SELECT *, row_number() OVER (PARTITION BY session_id, frame_index ORDER BY confidence DESC, det_seq) AS n FROM d),
nm AS (SELECT session_id, frame_index, CAST(0 AS BIGINT) AS n, CAST([] AS DOUBLE[][]) AS b, CAST(0 AS INT) AS det_seq, CAST(0 AS DOUBLE) AS x1, CAST(0 AS DOUBLE) AS y1, CAST(0 AS DOUBLE) AS x2, CAST(0 AS DOUBLE) AS y2, CAST(0 AS DOUBLE) AS confidence, false AS kept FROM (SELECT DISTINCT session_id, frame_index FROM d)
 UNION ALL SELECT session_id, frame_index, n, CASE WHEN free THEN list_append(b, [x1, y1, x2, y2]) ELSE b END, det_seq, x1, y1, x2, y2, confidence, free
 FROM (SELECT k.session_id, k.frame_index, r.n, k.b, r.det_seq, r.x1, r.y1, r.x2, r.y2, r.confidence, len(list_filter(list_transform(k.b, lambda o: [greatest(least(o[3], r.x2) - greatest(o[1], r.x1), 0) * greatest(least(o[4], r.y2) - greatest(o[2], r.y1), 0), (o[3] - o[1]) * (o[4] - o[2]) + (r.x2 - r.x1) * (r.y2 - r.y1)]), lambda z: z[1] / (z[2] - z[1]) > 0.2)) = 0 AS free
 FROM nm k JOIN rk r ON r.session_id = k.session_id AND r.frame_index = k.frame_index AND r.n = k.n + 1))"""

CLOCK = """cl AS (SELECT session_id, frame_index, count(*) AS visible, CAST(frame_index * 40 + frame_index % 8 * 5 AS BIGINT) AS at_ms, frame_index % 50 = 49 AS stopped FROM d GROUP BY ALL),
cn AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY frame_index) AS n FROM cl),
em AS (SELECT session_id, CAST(0 AS BIGINT) AS n, CAST(0 AS INT) AS frame_index, CAST(0 AS BIGINT) AS visible, CAST(NULL AS BIGINT) AS last_ms, false AS sent FROM (SELECT DISTINCT session_id FROM cl)
 UNION ALL SELECT e.session_id, c.n, c.frame_index, c.visible, CASE WHEN e.last_ms IS NULL OR c.at_ms - e.last_ms >= 120 OR c.stopped THEN c.at_ms ELSE e.last_ms END, e.last_ms IS NULL OR c.at_ms - e.last_ms >= 120 OR c.stopped FROM em e JOIN cn c ON c.session_id = e.session_id AND c.n = e.n + 1)"""

UNIT = "un AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / greatest(sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE)))), 1e-12)) AS u FROM embeddings)"

POLYGON = [(100, 50), (600, 120), (430, 460), (300, 200), (60, 400)]


def _crossings() -> str:
    parts = []
    for (ax, ay), (bx, by) in zip(POLYGON, POLYGON[-1:] + POLYGON[:-1], strict=True):
        parts.append(f"(CASE WHEN ({ay} > py) <> ({by} > py) AND px < CAST({bx - ax} AS DOUBLE) * (py - {ay}) / {by - ay} + {ax} THEN 1 ELSE 0 END)")
    return " + ".join(parts)


SQL = {
    "trajectory_samples": f"WITH {SAMPLES} SELECT * REPLACE (round(anchor_y, 6) AS anchor_y, round(head_size, 6) AS head_size, round(body_ratio, 6) AS body_ratio) FROM s",
    "stable_visits": f"WITH {SAMPLES}, {VISITS} SELECT session_id, track_id, visit_no, zone, samples, round(median_head, 6) AS median_head, round(mean_x, 6) AS mean_x, round(mean_y, 6) AS mean_y FROM v",
    "visit_transitions": f"WITH {SAMPLES}, {VISITS} SELECT session_id, track_id, visit_no, from_zone, to_zone, round(shift, 6) AS shift, round(head_ratio, 6) AS head_ratio FROM t",
    "exits_by_visits": f"WITH {SAMPLES}, {VISITS} SELECT session_id, track_id, count(*) AS exits FROM t WHERE from_zone = 'INSIDE' AND to_zone = 'OUTSIDE' AND shift >= 40 GROUP BY ALL",
    "track_facts": f"WITH {SAMPLES}, {FACTS} SELECT session_id, track_id, n, round(body_ratio, 6) AS body_ratio, ever_in_door, ends_at_exit, tz AS tail_zone, round(ty, 6) AS tail_y, round(py, 6) AS before_last_y FROM fa JOIN ta USING (session_id, track_id)",
    "early_shift": f"WITH {SAMPLES}, {EARLY} SELECT session_id, track_id, round(early_shift, 6) AS early_shift FROM ea",
    "stationary_successors": f"WITH {STAGGERED}, {FACTS}, {EARLY}, {SUCCESSORS} SELECT session_id, track_id FROM su",
    "track_fates": f"WITH {FATES} SELECT session_id, track_id, exits, fate FROM fate",
    "fate_counts": f"WITH {FATES} SELECT session_id, fate, count(*) AS tracks FROM fate GROUP BY ALL",
    "session_exits": f"WITH {FATES} SELECT session_id, CAST(sum(exits) AS BIGINT) AS exits FROM fate GROUP BY ALL",
    "final_exits": f"WITH {FATES}, li AS (SELECT session_id, count(*) FILTER (in_spawn) // 10 AS live FROM s GROUP BY ALL) SELECT session_id, greatest(CAST(sum(exits) AS BIGINT), any_value(live)) AS exits FROM fate JOIN li USING (session_id) GROUP BY ALL",
    "head_average": f"WITH {SAMPLES} SELECT session_id, track_id, frame_index, round(avg(head_size) OVER (PARTITION BY session_id, track_id ORDER BY frame_index ROWS 4 PRECEDING), 6) AS smooth_head FROM s",
    "lifetime_shift": f"WITH {SAMPLES} SELECT session_id, track_id, round(sqrt((max(anchor_x) - min(anchor_x)) * (max(anchor_x) - min(anchor_x)) + (max(anchor_y) - min(anchor_y)) * (max(anchor_y) - min(anchor_y))), 6) AS lifetime_shift FROM s GROUP BY ALL",
    "line_counts": f"WITH RECURSIVE {SAMPLES}, {LINE} SELECT session_id, CAST(sum(b) AS BIGINT) AS boardings, CAST(sum(a) AS BIGINT) AS alightings FROM lr WHERE pos = most GROUP BY ALL",
    "zone_labels": f"WITH {LABELLED} SELECT session_id, frame_index, det_seq, zone, in_door FROM l",
    "zone_counts": f"WITH {COUNTED} SELECT * FROM k",
    "slanted_polygon": f"WITH {DETECTIONS}, pt AS (SELECT session_id, x1 + (x2 - x1) * CAST(0.5 AS DOUBLE) AS px, y1 + (y2 - y1) * CAST(0.95 AS DOUBLE) AS py FROM d) SELECT session_id, count(*) AS held FROM pt WHERE ({_crossings()}) % 2 = 1 GROUP BY ALL",
    "initial_occupancy": f"WITH {COUNTED}, {INITIAL} SELECT * FROM i",
    "session_occupancy": f"WITH {COUNTED}, {INITIAL}, {FATES}, so AS (SELECT session_id, sum(exits) AS exits FROM fate GROUP BY ALL) SELECT i.session_id, CAST(least(greatest(initial - coalesce(exits, 0), 0), 120) AS BIGINT) AS onboard FROM i LEFT JOIN so ON i.session_id = so.session_id",
    "sampled_frames": f"WITH {DETECTIONS} SELECT session_id, count(DISTINCT frame_index) AS frames FROM d WHERE frame_index % 3 = 0 GROUP BY ALL",
    "frame_point_read": f"WITH {DETECTIONS} SELECT frame_index, x1, y1 FROM d WHERE session_id = 's1' AND det_seq = 0 AND frame_index >= 10 ORDER BY frame_index LIMIT 1",
    "stream_headers": f"WITH {DETECTIONS} SELECT session_id, CASE WHEN session_id = 's3' THEN 25.0 ELSE 30.0 END::DOUBLE AS fps, CAST(max(frame_index) + 1 AS INT) AS est_frames, round((max(frame_index) + 1) / any_value(CASE WHEN session_id = 's3' THEN CAST(25 AS DOUBLE) ELSE 30 END), 6) AS duration_s FROM d GROUP BY ALL",
    "head_regions": f"WITH {DETECTIONS} SELECT session_id, frame_index, det_seq, {HEAD_COLUMNS} FROM d",
    "synthetic_bodies": f"WITH {DETECTIONS} SELECT session_id, frame_index, det_seq, {BODY_COLUMNS} FROM d",
    "native_heads": f"WITH {DETECTIONS}, na AS ({NATIVE}) SELECT session_id, frame_index, det_seq, "
    + ", ".join(f"CASE WHEN large THEN head_{c} ELSE {c} END AS head_{c}, CASE WHEN large THEN {c} ELSE body_{c} END AS body_{c}" for c in ("x1", "y1", "x2", "y2"))
    + " FROM na WHERE NOT masked",
    "letterbox_boxes": f"WITH {DETECTIONS} SELECT session_id, frame_index, det_seq, {_hold('(x1 - 16) / CAST(0.8 AS DOUBLE)', 640)} AS frame_x1, {_hold('(y1 - 40) / CAST(0.8 AS DOUBLE)', 480)} AS frame_y1, {_hold('(x2 - 16) / CAST(0.8 AS DOUBLE)', 640)} AS frame_x2, {_hold('(y2 - 40) / CAST(0.8 AS DOUBLE)', 480)} AS frame_y2 FROM d",
    "detector_rows": f"WITH {DETECTIONS}, {READ} SELECT session_id, frame_index, det_seq, round(score, 6) AS score, round(a1, 6) AS x1, round(b1, 6) AS y1, round(a2, 6) AS x2, round(b2, 6) AS y2 FROM rr WHERE score >= 0.25 AND a2 - a1 >= 2 AND b2 - b1 >= 2",
    "detector_outputs": f"WITH {DETECTIONS}, o AS (SELECT *, row_number() OVER (PARTITION BY session_id, frame_index // 12 ORDER BY frame_index, det_seq) - 1 AS place FROM d) SELECT session_id, CAST(frame_index // 12 AS INT) AS frame_index, CAST(place AS INT) AS det_seq, round(confidence, 6) AS score, {_hold('x1', 640)} AS x1, {_hold('y1', 480)} AS y1, {_hold('x2', 640)} AS x2, {_hold('y2', 480)} AS y2 FROM o WHERE confidence >= 0.25 AND (CAST(substr(session_id, 2, 1) AS INT) % 2 = 1 OR (least(x2, 640) - x1 >= 2 AND least(y2, 480) - y1 >= 2))",
    "line_doors": "WITH l AS (SELECT s_suppkey, (s_suppkey * 7 % 101) / CAST(100 AS DOUBLE) AS ax, (s_suppkey * 11 % 103) / CAST(100 AS DOUBLE) AS ay, (s_suppkey * 13 % 97) / CAST(100 AS DOUBLE) AS dx, (s_suppkey * 17 % 89) / CAST(100 AS DOUBLE) AS dy, CASE s_suppkey % 3 WHEN 0 THEN 640 WHEN 1 THEN 1280 ELSE 352 END AS w, CASE s_suppkey % 3 WHEN 0 THEN 480 WHEN 1 THEN 720 ELSE 288 END AS h FROM supplier),"
    " p AS (SELECT s_suppkey, w, h, least(ax, 1) * w AS ax, least(ay, 1) * h AS ay, least(dx, 1) * w AS dx, least(dy, 1) * h AS dy FROM l), q AS (SELECT s_suppkey, w, h, (ax + dx) / 2 AS mx, (ay + dy) / 2 AS my, least(greatest(sqrt((dx - ax) * (dx - ax) + (dy - ay) * (dy - ay)) * CAST(0.35 AS DOUBLE), w * CAST(0.08 AS DOUBLE)), w * CAST(0.28 AS DOUBLE)) / 2 AS dw, least(greatest(h * CAST(0.22 AS DOUBLE), 90), h * CAST(0.45 AS DOUBLE)) / 2 AS dh FROM p)"
    " SELECT s_suppkey AS line_id, round(least(greatest(mx - dw, 0), w) / w, 6) AS x1, round(least(greatest(my - dh, 0), h) / h, 6) AS y1, round(least(greatest(mx + dw, 0), w) / w, 6) AS x2, round(least(greatest(my + dh, 0), h) / h, 6) AS y2 FROM q",
    "plane_scores": f"WITH {DETECTIONS} SELECT session_id, frame_index, det_seq AS anchor, round(greatest(confidence, 1 - confidence), 6) AS score, CAST(CASE WHEN confidence >= 1 - confidence THEN 0 ELSE 1 END AS INT) AS kind, round((x1 + x2) / 2 - (x2 - x1) / 2, 6) AS box_x1 FROM d",
    "overlap_candidates": f"WITH {PAIRS} SELECT session_id, frame_index, track_id, det_seq, round(iou, 6) AS iou, round(center_px, 6) AS center_px FROM io WHERE iou >= 0.05",
    "center_candidates": f"WITH {PAIRS.replace('io AS (', 'io AS MATERIALIZED (')}, ov AS MATERIALIZED (SELECT session_id, frame_index, track_id, det_seq FROM io WHERE iou >= 0.3), tk AS (SELECT DISTINCT session_id, frame_index, track_id, 1 AS t FROM ov), dk AS (SELECT DISTINCT session_id, frame_index, det_seq, 1 AS b FROM ov)"
    " SELECT session_id, frame_index, track_id, det_seq, round(center_px, 6) AS center_px FROM io LEFT JOIN tk USING (session_id, frame_index, track_id) LEFT JOIN dk USING (session_id, frame_index, det_seq)"
    " WHERE t IS NULL AND b IS NULL AND center_px <= least(90, greatest(x2 - x1, y2 - y1, p2 - p1, q2 - q1) * 2.6)",
    "reid_best_match": f"WITH {UNIT}, si AS (SELECT a.vec_id // 10 AS frame_index, a.vec_id AS probe_id, b.vec_id AS pool_id, list_sum(list_transform(list_zip(a.u, b.u), lambda p: p[1] * p[2])) AS similarity FROM un a JOIN un b ON a.vec_id // 10 = b.vec_id // 10 + 1)"
    " SELECT frame_index, probe_id, pool_id, round(similarity, 6) AS similarity FROM si WHERE similarity > 0.1 QUALIFY row_number() OVER (PARTITION BY probe_id ORDER BY similarity DESC, pool_id) = 1",
    "reid_archive_match": f"WITH {UNIT}, si AS (SELECT a.label, a.vec_id AS probe_id, b.vec_id AS pool_id, list_sum(list_transform(list_zip(a.u, b.u), lambda p: p[1] * p[2])) AS similarity FROM un a JOIN un b ON a.label = b.label AND a.vec_id <> b.vec_id)"
    " SELECT label, probe_id, pool_id, round(similarity, 6) AS similarity FROM si WHERE similarity > 0.1 QUALIFY row_number() OVER (PARTITION BY label, probe_id ORDER BY similarity DESC, pool_id) = 1",
    "blended_embeddings": "WITH b AS (SELECT a.vec_id, list_transform(list_zip(a.embedding, c.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(0.8 AS DOUBLE) + CAST(p[2] AS DOUBLE) * CAST(0.2 AS DOUBLE)) AS m FROM embeddings a JOIN embeddings c ON a.vec_id = c.vec_id + 1),"
    " n AS (SELECT *, greatest(sqrt(list_sum(list_transform(m, lambda x: x * x))), 1e-12) AS len FROM b) SELECT vec_id, round(m[1] / len, 6) AS m0, round(m[64] / len, 6) AS m63 FROM n",
    "position_fallback": f"WITH {DETECTIONS}, c AS (SELECT *, x1 + (x2 - x1) * CAST(0.5 AS DOUBLE) AS ax, y1 + (y2 - y1) * CAST(0.5 AS DOUBLE) AS ay FROM d), j AS (SELECT a.session_id, a.frame_index, a.det_seq, b.det_seq AS track_id, sqrt((b.ax - a.ax) * (b.ax - a.ax) + (b.ay - a.ay) * (b.ay - a.ay)) AS px,"
    " least(250, 2 * least(90, 2.6 * greatest(a.x2 - a.x1, a.y2 - a.y1, b.x2 - b.x1, b.y2 - b.y1))) AS lim FROM c a JOIN c b ON a.session_id = b.session_id AND a.frame_index = b.frame_index + 1 WHERE a.ay < 300 AND b.det_seq <> 1 AND b.frame_index % 30 <= 15 AND b.frame_index % 7 <> 0)"
    " SELECT session_id, frame_index, det_seq, track_id, round(px, 6) AS px FROM j WHERE px <= lim QUALIFY row_number() OVER (PARTITION BY session_id, frame_index, det_seq ORDER BY px, track_id) = 1",
    "path_metadata": f"WITH {FILES} SELECT path, CASE WHEN device <> 'x' THEN device END AS video_device_id, CASE WHEN device <> 'x' THEN day END AS record_date, CASE WHEN device <> 'x' THEN device || '/' || day || '/' || name END AS relative_path, CAST(k % 6 AS INT) AS channel, CAST(k % 6 AS VARCHAR) AS camera_code, 'E' || k % 9 AS event_code,"
    " CAST(k % 3 AS INT) AS record_type, start AS clip_started_s, start + 60 AS clip_finished_s, CAST(0 AS INT) AS file_flag, k AS file_uid FROM fp",
    "file_catalog": f"WITH {FILES}, pl AS (SELECT *, CASE WHEN k * 10 % 70 = 0 THEN 0 ELSE k * 10 END AS size, CASE k % 5 WHEN 0 THEN 'FTP_FAILED' WHEN 1 THEN 'FTP_PROCESSED' WHEN 2 THEN 'FTP_INCOMING' ELSE 'MANUAL' END AS location FROM fp WHERE k % 13 <> 0)"
    " SELECT path, location, CASE location WHEN 'FTP_FAILED' THEN 'FTP / ошибка' WHEN 'FTP_PROCESSED' THEN 'FTP / processed' WHEN 'FTP_INCOMING' THEN 'FTP / входящие' ELSE 'Видео' END AS folder,"
    " CASE k % 5 WHEN 0 THEN 'failed/' WHEN 4 THEN 'other/' ELSE '' END || device || '/' || day || '/' || name AS below_root, strftime(make_timestamp(modified_ms * 1000), '%d.%m.%y %H:%M') AS modified, size > 0 AND location <> 'FTP_INCOMING' AS can_preview, size > 0 AND location <> 'FTP_INCOMING' AS can_analyse,"
    " CASE WHEN size <= 0 THEN 'Пустой файл' WHEN location = 'FTP_INCOMING' THEN 'Загрузка ещё не завершена' END AS issue FROM pl",
    "preview_answers": f"WITH {FILES} SELECT path, CASE WHEN k % 13 = 0 THEN 400 WHEN k * 10 % 70 = 0 THEN 422 WHEN k % 5 = 2 THEN 409 ELSE 200 END AS status FROM fp"
    " UNION ALL SELECT CASE WHEN o_orderkey % 2 = 0 THEN '/nowhere/' ELSE '/data/videos/' END || o_orderkey || '.mp4', CASE WHEN o_orderkey % 2 = 0 THEN 400 ELSE 404 END FROM orders",
    "recorder_samples": f"WITH {FILES} SELECT path, modified_ms FROM fp WHERE k % 13 <> 0 AND device = '1007' AND k % 6 = 3 AND k % 5 IN (1, 3)",
    "page_extensions": "WITH p AS (SELECT page_id, regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1) AS last FROM pages) SELECT page_id, lower(regexp_extract(last, '\\.([^./\\\\]*)$', 1)) AS extension, substr(regexp_replace(coalesce(nullif(trim(last), ''), 'index'), '[^A-Za-z0-9._-]', '_', 'g'), 1, 80) AS safe_name FROM p",
    "clock_texts": f"WITH {DETECTIONS} SELECT DISTINCT session_id, frame_index, lpad(CAST(CAST(floor(frame_index * 9 / CAST(25 AS DOUBLE)) AS BIGINT) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(floor(frame_index * 9 / CAST(25 AS DOUBLE)) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS clock FROM d",
    "deepest_root": "SELECT CASE o_orderkey % 5 WHEN 0 THEN '/data/processed/failed' WHEN 1 THEN '/data/processed' WHEN 4 THEN '/srv' ELSE '/data' END AS root, CASE o_orderkey % 5 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'ARCHIVE' WHEN 4 THEN 'OTHER' ELSE 'ANY' END AS kind, count(*) AS files FROM orders GROUP BY ALL",
    "first_by_root": "SELECT '/r' || n_regionkey AS root, n_name AS kind, n_nationkey % 3 AS priority FROM nation QUALIFY row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey % 3, n_name) = 1",
    "camera_keys": f"WITH {BINDINGS}, {CAMERAS} SELECT recorder_id, camera_code FROM bi UNION SELECT recorder_id, camera_code FROM ca",
    "recorder_bindings": f"WITH {BINDINGS} SELECT id, camera_code, logical_door, updated_ms FROM bi WHERE recorder_id = 'rec7' AND active",
    "lost_pool": f"WITH {SAMPLES} SELECT session_id, track_id, max(frame_index) AS last_frame, CASE WHEN max(frame_index) < 60 THEN 'lost' ELSE 'coasting' END AS pool FROM s GROUP BY ALL",
    "unprocessed_content": "WITH h AS (SELECT sha256(text) AS sha256, 'p' || lpad(CAST(doc_id AS VARCHAR), 10, '0') AS path FROM documents) SELECT sha256, min(path) AS path FROM h WHERE substr(sha256, 1, 1) NOT IN ('0', '1', '2', '3') GROUP BY ALL",
    "unanalysed_clips": f"WITH {FILES} SELECT path FROM fp WHERE NOT (k % 8 = 0 OR (k % 12 = 0 AND device <> 'x') OR (k % 20 = 0 AND device <> 'x'))",
    "latest_preview": f"WITH {BINDINGS} SELECT * FROM bi {LATEST}",
    "resolved_doors": f"""WITH {BINDINGS}, {CAMERAS}, ab AS (SELECT * FROM bi WHERE active {LATEST}), pf AS (SELECT CAST(n_nationkey AS BIGINT) AS pid, n_name, CASE WHEN n_nationkey % 3 = 0 THEN '[]' WHEN n_nationkey % 3 <> 1 THEN '[{{"x":0.' || n_nationkey || ',"y":0.5}}]' END AS pdoor,
 CASE WHEN n_nationkey % 4 = 0 THEN '[]' WHEN n_nationkey % 4 <> 1 THEN '[{{"x":0.' || n_nationkey || ',"y":0.5}}]' END AS psalon FROM nation)
 SELECT s_suppkey AS clip_id, ca.recorder_id, ca.camera_code, logical_door, false AS ignored, coalesce(logical_door = 'NEEDS_CLASSIFICATION', false) AS classification_needed, pid AS profile_id, coalesce(n_name, 'application-default') AS profile_name,
 CASE WHEN pid IS NOT NULL THEN 'DATABASE' WHEN logical_door IS NOT NULL THEN 'BINDING_DEFAULT' ELSE 'APPLICATION_DEFAULT' END AS source, coalesce(nullif(pdoor, '[]'), '[{{"x":0.4,"y":0.4}}]') AS door, coalesce(nullif(psalon, '[]'), '[{{"x":0.0,"y":0.6}}]') AS salon
 FROM ca LEFT JOIN ab ON ca.recorder_id = ab.recorder_id AND ca.camera_code = ab.camera_code LEFT JOIN pf ON pid = profile_id AND logical_door <> 'NEEDS_CLASSIFICATION'""",
    "known_channels": f"WITH {BINDINGS}, {CAMERAS}, ab AS (SELECT * FROM bi WHERE active {LATEST}), fc AS (SELECT recorder_id, camera_code, count(*) AS samples, max(s_suppkey * 7) AS newest_ms FROM ca GROUP BY ALL) SELECT coalesce(ab.recorder_id, fc.recorder_id) AS recorder_id, coalesce(ab.camera_code, fc.camera_code) AS camera_code,"
    " coalesce(logical_door, 'NEEDS_CLASSIFICATION') AS logical_door, coalesce(samples, 0) AS samples, newest_ms FROM ab FULL JOIN fc ON ab.recorder_id = fc.recorder_id AND ab.camera_code = fc.camera_code",
    "listed_bindings": f"WITH {BINDINGS} SELECT id, recorder_id, camera_code, logical_door, n_name AS profile_name, updated_ms FROM bi LEFT JOIN nation ON n_nationkey = profile_id ORDER BY logical_door = 'NEEDS_CLASSIFICATION' DESC, recorder_id, camera_code, updated_ms DESC, id",
    "named_profiles": "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation ORDER BY lower(n_name), n_nationkey",
    "rebound_cameras": f"WITH {BINDINGS}, rq AS (SELECT * FROM (SELECT 'rec' || n_nationkey % 10 AS recorder_id, CAST(n_nationkey % 7 AS VARCHAR) AS camera_code, CAST(n_nationkey AS BIGINT) AS profile_id, n_nationkey + 9000000 AS updated_ms FROM nation) {LATEST})"
    " SELECT bi.id, bi.recorder_id, bi.camera_code, bi.logical_door, bi.profile_id, bi.active AND rq.recorder_id IS NULL AS active, CASE WHEN bi.active AND rq.recorder_id IS NOT NULL THEN rq.updated_ms ELSE bi.updated_ms END AS updated_ms FROM bi LEFT JOIN rq ON bi.recorder_id = rq.recorder_id AND bi.camera_code = rq.camera_code"
    " UNION ALL SELECT CAST('0x' || substr(md5(concat_ws('|', recorder_id, camera_code, CAST(updated_ms AS VARCHAR))), 1, 15) AS BIGINT), recorder_id, camera_code, 'FRONT', profile_id, true, updated_ms FROM rq",
    "upserted_results": f"WITH {RESULTS} SELECT session_id, CASE WHEN finished_ms % 3 = 0 THEN 'STOPPED' ELSE status END AS status, CASE WHEN finished_ms % 3 = 0 THEN finished_ms + 5 ELSE finished_ms END AS finished_ms FROM re",
    "logged_results": f"WITH {RESULTS} SELECT session_id, CASE WHEN finished_ms % 3 = 0 THEN 'STOPPED' ELSE status END AS status, CASE WHEN finished_ms % 3 = 0 THEN finished_ms + 5 ELSE finished_ms END AS finished_ms FROM re",
    "result_search": f"WITH {RESULTS} SELECT session_id, status, video_device_id, coalesce(CAST(channel AS VARCHAR), event_code) AS camera_code, greatest(exited, alightings) AS exited, 0 AS boardings, onboard, coalesce(clip_started_ms, finished_ms) AS at_ms FROM re WHERE status = 'FINISHED' AND coalesce(clip_started_ms, finished_ms) BETWEEN 700000000000 AND 850000000000",
    "result_page": f"WITH {RESULTS} SELECT session_id, finished_ms FROM re ORDER BY finished_ms DESC, session_id LIMIT 20 OFFSET 40",
    "result_pages": "SELECT count(*) AS total, CAST(ceil(count(*) / CAST(20 AS DOUBLE)) AS BIGINT) AS pages FROM orders",
    "results_by_device": f"WITH {RESULTS} SELECT session_id, coalesce(clip_started_ms, finished_ms) AS at_ms FROM re WHERE video_device_id = 'd7' ORDER BY at_ms DESC, session_id",
    "result_lookup": f"WITH {RESULTS} SELECT session_id, status FROM re WHERE session_id = 'r1'",
    "result_text_filter": f"WITH {RESULTS} SELECT session_id FROM re WHERE event_code = 'E8'",
    "json_points": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 3 ELSE 0 END AS points, CASE WHEN event_id % 3 = 0 THEN CAST(1 AS DOUBLE) END AS second_x, CASE WHEN event_id % 3 = 0 THEN CAST(0 AS DOUBLE) END AS third_y FROM events",
    "idle_seconds": f"WITH {DOOR}, {IDLE} SELECT session_id, frame_index, round(video_s, 6) AS video_s, activity_seen, round(idle_s, 6) AS idle_s FROM id",
    "door_states": f"WITH {STATES} SELECT session_id, frame_index, door_state, round(CASE door_state WHEN 'OPEN' THEN least(greatest(1 - gap / CAST(0.1 AS DOUBLE), 0), 1) WHEN 'CLOSED' THEN least(greatest(0.5 + (gap - CAST(0.22 AS DOUBLE)) / CAST(0.22 AS DOUBLE), 0.5), 1) ELSE 0 END, 6) AS door_confidence,"
    " round(gap, 6) AS gap, round(door_motion, 6) AS door_motion, round(scene_motion, 6) AS scene_motion, round(closed_s, 6) AS closed_s, round(moving_s, 6) AS moving_s, scene_motion >= 0.14 AND moving_s >= 5 AS vehicle_moving FROM se",
    "signature_statistics": f"WITH {DOOR} SELECT session_id, frame_index, round(street[1], 6) AS first, round(street[4], 6) AS last FROM df",
    "stop_points": f"WITH RECURSIVE {STATES}, {STOPS} SELECT session_id, frame_index, door_state, CASE WHEN stopped THEN 'FINISHED' WHEN reason IS NOT NULL THEN 'POST_ROLL' WHEN door_state = 'CALIBRATING' THEN 'CALIBRATING' WHEN door_state = 'CLOSED' THEN 'CLOSING' ELSE 'MONITORING' END AS phase, reason, stopped FROM sp WHERE n > 0",
    "analysed_frames": f"WITH RECURSIVE {STATES}, {STOPS}, en AS (SELECT session_id, min(frame_index) AS last FROM sp WHERE stopped GROUP BY ALL) SELECT sp.session_id, count(*) AS frames, max(frame_index) AS last_frame FROM sp LEFT JOIN en ON en.session_id = sp.session_id WHERE n > 0 AND (last IS NULL OR frame_index <= last) GROUP BY ALL",
    "greedy_matches": f"WITH RECURSIVE {PAIRS}, {GREEDY} SELECT session_id, frame_index, track_id, det_seq, round(iou, 6) AS iou, round(center_px, 6) AS center_px FROM gm WHERE kept",
    "suppressed_boxes": f"WITH RECURSIVE {DETECTIONS}, {SUPPRESSED} SELECT session_id, frame_index, det_seq, x1, y1, x2, y2, confidence FROM nm WHERE kept",
    "frame_diagnostics": f"WITH {COUNTED} SELECT session_id, frame_index, inside, outside, doorway, inside + outside + buffer AS detections FROM k WHERE frame_index % 30 = 0",
    "emitted_frames": f"WITH RECURSIVE {DETECTIONS}, {CLOCK} SELECT session_id, frame_index, sent FROM em WHERE n > 0",
    "frame_messages": f"WITH RECURSIVE {DETECTIONS}, {CLOCK}, tg AS (SELECT session_id, frame_index, visible, sent, min(CASE WHEN sent THEN frame_index END) OVER (PARTITION BY session_id ORDER BY frame_index ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS target FROM em WHERE n > 0),"
    " ev AS (SELECT tg.session_id, target, count(*) AS n_events FROM tg JOIN d ON d.session_id = tg.session_id AND d.frame_index = tg.frame_index AND d.det_seq = 2 GROUP BY ALL)"
    " SELECT tg.session_id, tg.frame_index, CAST(coalesce(n_events, 0) AS INT) AS n_events, CAST(visible AS INT) AS boxes, CAST(visible AS INT) AS visible FROM tg LEFT JOIN ev ON ev.session_id = tg.session_id AND ev.target = tg.frame_index WHERE sent",
    "finished_sessions": f"WITH {RESULTS}, sn AS (SELECT *, finished_ms % 4 = 0 AS running FROM re) SELECT session_id, CASE WHEN NOT running THEN status WHEN finished_ms % 8 = 0 THEN 'STOPPED' WHEN finished_ms % 3 = 2 THEN 'FAILED' ELSE 'FINISHED' END AS status, finished_ms, CASE WHEN running THEN 'r' END AS finish_reason FROM sn",
    "final_messages": f"WITH {RESULTS} SELECT session_id, status, CAST(alightings AS BIGINT) AS total_exited, CAST(greatest(3 - alightings, 0) AS BIGINT) AS final_onboard, CAST(5000 AS BIGINT) AS duration_ms FROM re WHERE finished_ms % 4 <> 0",
    "session_state": f"WITH {RESULTS} SELECT session_id, CASE WHEN finished_ms % 4 = 0 THEN 'RUNNING' ELSE status END AS status, CAST(alightings AS BIGINT) AS total_exited, CAST(greatest(3 - alightings, 0) AS BIGINT) AS current_onboard FROM re WHERE session_id = 'r1'",
    "pending_doors": f"WITH {BINDINGS}, sm AS (SELECT 'rec' || s_suppkey % 30 AS recorder_id, CAST(s_suppkey % 7 AS VARCHAR) AS camera_code, arg_max(s_suppkey, (s_suppkey % 50) * 1000000 + s_suppkey) AS k FROM supplier GROUP BY ALL)"
    " SELECT id, bi.recorder_id, bi.camera_code, 'f' || lpad(CAST(k AS VARCHAR), 6, '0') AS sample_path, k IS NOT NULL AS preview_available, updated_ms FROM bi LEFT JOIN sm ON sm.recorder_id = bi.recorder_id AND sm.camera_code = bi.camera_code WHERE active AND logical_door = 'NEEDS_CLASSIFICATION'",
    "completed_uploads": "SELECT CASE o_orderkey % 6 WHEN 0 THEN '/data/incoming/1001/' WHEN 1 THEN '/data/incoming/a/' ELSE '/data/incoming/cam/../b/' END || o_orderkey AS path FROM orders WHERE o_orderkey % 6 IN (0, 1, 4)",
}

#: The long clip's chain of frames by pointer doubling in SQL: each frame's successor by an as-of join, doubled, then marked from the first frame on.
_ROUNDS = 22
SQL["emitted_long_clip"] = (
    "WITH f AS (SELECT (l_orderkey * 8 + l_linenumber) * 30 + k AS frame_index, k = 29 AND l_linenumber = 1 AND l_orderkey % 100 = 0 AS stopped FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), (SELECT unnest(range(30)) AS k)),"
    " o AS MATERIALIZED (SELECT frame_index, stopped, frame_index * 40 + frame_index % 8 * 5 AS at_ms, row_number() OVER (ORDER BY frame_index) AS n FROM f),"
    " st AS (SELECT n FROM o WHERE stopped),"
    " j0 AS MATERIALIZED (SELECT o.n, least(coalesce(b.n, 1000000000), coalesce(st.n, 1000000000)) AS nx FROM o ASOF LEFT JOIN o b ON b.at_ms >= o.at_ms + 120 ASOF LEFT JOIN st ON st.n > o.n), "
    + ", ".join(f"j{i + 1} AS MATERIALIZED (SELECT a.n, b.nx FROM j{i} a JOIN j{i} b ON b.n = a.nx)" for i in range(_ROUNDS - 1))
    + ", m0 AS (SELECT CAST(1 AS BIGINT) AS n), "
    + ", ".join(f"m{i + 1} AS MATERIALIZED (SELECT n FROM m{i} UNION ALL SELECT nx FROM m{i} JOIN j{_ROUNDS - 1 - i} USING (n) WHERE nx < 1000000000)" for i in range(_ROUNDS))
    + f" SELECT frame_index, m.n IS NOT NULL AS sent FROM o LEFT JOIN m{_ROUNDS} m USING (n)"
)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
