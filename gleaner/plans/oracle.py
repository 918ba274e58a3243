"""The same queries in SQL, for DuckDB."""

from __future__ import annotations

from gleaner.functions.scalar import WHITE_SPACE
from gleaner.operators.boxes import ZONES
from gleaner.operators.catalog import ART_TYPES, NOT_ART

#: What is trimmed from both ends of a title, as SQL: white space of any kind.
_BLANKS = " || ".join(f"chr({ord(c)})" for c in WHITE_SPACE)

_PROTO = """
cells AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings),
means AS (SELECT label, dim, avg(x) AS m FROM cells GROUP BY label, dim),
norms AS (SELECT label, sqrt(sum(m * m)) AS norm FROM means GROUP BY label),
proto AS (SELECT label, dim, m / norm AS p FROM means JOIN norms USING (label) WHERE norm >= 1e-9)"""
_NAMED = f"""{_PROTO},
vcells AS (SELECT vec_id, label AS own, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings),
cosines AS (SELECT vec_id, own, label, label::VARCHAR AS k, sum(x * p) AS c FROM vcells JOIN proto USING (dim) GROUP BY vec_id, own, label),
ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, label) AS r FROM cosines),
named AS (SELECT vec_id, any_value(own) AS own, max(k) FILTER (WHERE r = 1) AS best, max(c) FILTER (WHERE r = 1) - max(c) FILTER (WHERE r = 2) AS margin FROM ranked WHERE r <= 2 GROUP BY vec_id),
found AS (SELECT *, CASE WHEN margin >= 0.12 THEN best ELSE 'unknown' END AS identity, round(least(greatest(margin, 0), 1), 4) AS confidence FROM named)"""
_HASH = "hashes AS (SELECT vec_id, label, list_sum(list_transform(range(56), lambda i: CASE WHEN embedding[(i // 7) * 8 + i % 7 + 2] > embedding[(i // 7) * 8 + i % 7 + 1] THEN 1::BIGINT << (55 - i) ELSE 0::BIGINT END))::BIGINT AS dhash FROM embeddings)"
_FOLD = f"""{_HASH},
n AS (SELECT label, vec_id, dhash, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM hashes),
w AS (SELECT label, vec_id, k, dhash AS last, TRUE AS kept FROM n WHERE k = 1
      UNION ALL SELECT n.label, n.vec_id, n.k, CASE WHEN bit_count(xor(n.dhash, w.last)) > 28 THEN n.dhash ELSE w.last END, bit_count(xor(n.dhash, w.last)) > 28 FROM w JOIN n ON n.label = w.label AND n.k = w.k + 1)"""
_CAPTURES = "captures AS (SELECT event_id, user_id, event_type, value, props, epoch_us(ts) / 1e6 AS seconds FROM events)"
_RUNS = f"""{_CAPTURES},
edged AS (SELECT *, min(seconds) OVER (PARTITION BY user_id) AS e, lead(seconds) OVER (PARTITION BY user_id ORDER BY seconds, event_id) AS nxt FROM captures),
runs AS (SELECT *, ceil((seconds - e) * (1 / 21600.0) - 1e-9)::BIGINT AS a, (CASE WHEN nxt IS NULL THEN floor((seconds - e) * (1 / 21600.0) + 1e-9) ELSE ceil((nxt - e) * (1 / 21600.0) - 1e-9) - 1 END)::BIGINT AS b FROM edged)"""
_TICKS = f"{_RUNS}, ticks AS (SELECT user_id, event_id, a, unnest(range(a, b + 1)) AS tick FROM runs WHERE a <= b)"
_BOXES = """boxes AS (SELECT l_orderkey AS frame, l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey AS box_id, (l_partkey % 80) / 100.0::DOUBLE AS x, (l_suppkey % 75) / 100.0::DOUBLE AS y,
  0.04::DOUBLE + (l_quantity % 10) / 100.0::DOUBLE AS w, 0.06::DOUBLE + l_linenumber / 50.0::DOUBLE AS h, l_quantity FROM lineitem)"""
_COVERED = " OR ".join(
    f"coalesce(greatest(least(x + w, {zx + zw!r}::DOUBLE) - greatest(x, {zx!r}::DOUBLE), 0) * greatest(least(y + h, {zy + zh!r}::DOUBLE) - greatest(y, {zy!r}::DOUBLE), 0) / nullif(w * h, 0), 0) > 0.4" for zx, zy, zw, zh in ZONES
)
_IOU = "coalesce(greatest(least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x), 0) * greatest(least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y), 0) / nullif({a}.w * {a}.h + {b}.w * {b}.h - greatest(least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x), 0) * greatest(least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y), 0), 0), 0)"


def _nms(source: str) -> str:
    """Greedy suppression by recursion over each frame's boxes in order of area."""
    return f"""
ordered AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY -w * h, box_id, x, y, w, h) AS k FROM {source}),
walk AS (SELECT frame, k, [{{'x': x, 'y': y, 'w': w, 'h': h, 'box_id': box_id}}] AS kept FROM ordered WHERE k = 1
  UNION ALL SELECT o.frame, o.k, CASE WHEN len(list_filter(walk.kept, lambda q: {_IOU.format(a='q', b='o')} > 0.3)) > 0 THEN walk.kept ELSE list_append(walk.kept, {{'x': o.x, 'y': o.y, 'w': o.w, 'h': o.h, 'box_id': o.box_id}}) END
  FROM walk JOIN ordered o ON o.frame = walk.frame AND o.k = walk.k + 1),
last AS (SELECT frame, kept FROM walk QUALIFY row_number() OVER (PARTITION BY frame ORDER BY k DESC) = 1),
nms AS (SELECT frame, (generate_subscripts(kept, 1) - 1)::INT AS slot, unnest(kept) AS b FROM last)"""


_PIXELS = """pixels AS (SELECT l_suppkey AS frame, l_linenumber AS shot, l_partkey % 64 AS x, l_orderkey % 64 AS y, l_quantity * (l_suppkey % 9 + 1) AS v, l_quantity * 5 AS r, l_discount * 2550 AS g, l_tax * 2550 AS b,
  l_partkey % 180 AS hue, l_suppkey * 7 % 256 AS s, l_orderkey % 256 AS val FROM lineitem)"""


def _hist(name: str, key: str, where: str = "TRUE") -> str:
    return f"""{name}c AS (SELECT {key} AS k, (hue * 32 // 180 * 16 + s * 16 // 256)::INT AS bin, count(*) AS n FROM pixels WHERE s > 25 AND val > 30 AND val < 250 AND {where} GROUP BY ALL),
{name} AS (SELECT k, bin, n / sum(n) OVER (PARTITION BY k) AS share FROM {name}c)"""


_VERDICTS = """classical AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'unknown' ELSE lang END AS ci, (n_chars % 100) / 100.0::DOUBLE AS cc, source, (['villager', 'minion'])[doc_id % 2 + 1] AS cr FROM documents),
embedding AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'unknown' WHEN quality = 0 OR doc_id % 5 = 0 THEN 'en' ELSE 'fr' END AS ei, (doc_id % 90) / 100.0::DOUBLE AS ec, (['demon', 'outcast', NULL])[doc_id % 3 + 1] AS er FROM labels)"""
_PAIRED = f"{_VERDICTS}, paired AS (SELECT doc_id, source, ci, ei FROM classical JOIN embedding USING (doc_id))"
_GALLERY = "gallery AS (SELECT r_name AS role, n_name AS identity, s_name AS file, n_nationkey FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
_SNAPSHOTS = f"""{_BOXES}, {_nms("boxes")},
cards AS (SELECT frame, slot, 'id' || (b.box_id % 9) AS identity, CASE WHEN slot % 2 = 0 THEN 'demon' ELSE 'unknown' END AS role, (b.box_id % 100) / 100.0::DOUBLE AS confidence FROM nms),
nested AS (SELECT frame, count(*) AS n, string_agg(role || ':' || identity, ',' ORDER BY slot) AS cards, string_agg(identity || '@' || printf('%.2f', confidence), '  ' ORDER BY slot) AS named FROM cards GROUP BY frame),
f AS (SELECT o_orderkey AS frame, CASE o_orderstatus WHEN 'O' THEN 'board' WHEN 'F' THEN 'modal' ELSE 'menu' END AS state FROM orders),
snap AS (SELECT f.frame, state, CASE WHEN state = 'board' THEN coalesce(n, 0) ELSE 0 END::INT AS n, CASE WHEN state = 'board' THEN coalesce(cards, '') ELSE '' END AS cards, CASE WHEN state = 'board' THEN coalesce(named, '') ELSE '' END AS named FROM f LEFT JOIN nested USING (frame))"""

_BLOBS = "blobs AS (SELECT s_suppkey AS frame, 48 + s_suppkey % 7 * 4 AS x, 36 + s_suppkey % 5 * 2 AS y, 18 + s_suppkey % 4 AS w, 24 + s_suppkey % 3 * 2 AS h FROM supplier)"

#: Weights at each read by a self-join, then the latch read by read.
_FUSION = """
e AS (SELECT user_id, event_id AS frame, epoch_us(ts) / 1e6 AS seconds, CASE event_type WHEN 'error' THEN 'modal' WHEN 'signup' THEN 'menu' ELSE 'board' END AS state, (props ->> '$.k')::INT AS k FROM events),
g AS (SELECT *, floor(seconds / 864000.0)::BIGINT AS "window" FROM e),
spans AS (SELECT user_id, "window", count(*) FILTER (state = 'board') AS fused_from, min(frame) AS first_frame, max(frame) AS last_frame FROM g GROUP BY ALL),
r AS (SELECT user_id, "window", k % 3 AS slot, frame, seconds, CASE WHEN k % 11 = 0 OR k % 13 = 0 THEN NULL ELSE 'id' || (user_id + k % 3 + (k % 5 = 0)::INT) % 7 END AS id, (frame * 37 % 100) / 100.0::DOUBLE AS m,
        row_number() OVER (PARTITION BY user_id, "window", k % 3 ORDER BY seconds, frame) AS i FROM g WHERE state = 'board'),
wt AS (SELECT a.user_id, a."window", a.slot, a.i, b.id, sum(b.m * exp(-1e-6 * (a.seconds - b.seconds))) AS w FROM r a JOIN r b ON a.user_id = b.user_id AND a."window" = b."window" AND a.slot = b.slot AND b.i <= a.i WHERE b.id IS NOT NULL AND b.m > 0 GROUP BY ALL),
tops AS (SELECT user_id, "window", slot, i, id AS top, w AS top_w FROM wt QUALIFY row_number() OVER (PARTITION BY user_id, "window", slot, i ORDER BY w DESC, id) = 1),
x AS (SELECT r.*, top, top_w, r.id IS NOT NULL AND r.m >= 0.3 AS sure FROM r LEFT JOIN tops USING (user_id, "window", slot, i)),
latch AS (SELECT user_id, "window", slot, i, CASE WHEN top_w >= 0.9 THEN top END AS held, NULL::VARCHAR AS contrary, 0 AS run FROM x WHERE i = 1
  UNION ALL SELECT x.user_id, x."window", x.slot, x.i,
    CASE WHEN held IS NULL THEN CASE WHEN top_w >= 0.9 THEN top END WHEN sure AND id <> held AND id = contrary AND run + 1 >= 2 THEN id ELSE held END,
    CASE WHEN held IS NULL OR NOT sure THEN contrary WHEN id = held OR (id = contrary AND run + 1 >= 2) THEN NULL ELSE id END,
    CASE WHEN held IS NULL OR NOT sure THEN run WHEN id = held OR (id = contrary AND run + 1 >= 2) THEN 0 WHEN id = contrary THEN run + 1 ELSE 1 END
  FROM latch l JOIN x ON x.user_id = l.user_id AND x."window" = l."window" AND x.slot = l.slot AND x.i = l.i + 1),
ends AS (SELECT x.*, held FROM x JOIN latch USING (user_id, "window", slot, i) QUALIFY row_number() OVER (PARTITION BY user_id, "window", slot ORDER BY i DESC) = 1),
cards AS (SELECT n.user_id, n."window", n.slot, coalesce(n.held, n.top, 'unknown') AS identity, n.held IS NOT NULL AS revealed, n.frame AS last_seen_frame,
  coalesce(max(wt.w) FILTER (wt.id = coalesce(n.held, n.top)), 0) AS own, coalesce(max(wt.w) FILTER (wt.id <> coalesce(n.held, n.top)), 0) AS other
  FROM ends n LEFT JOIN wt USING (user_id, "window", slot, i) GROUP BY ALL)"""

ORACLES = {
    "proto_mean": f"WITH {_PROTO} SELECT label, dim::INT AS dim, round(p, 6) AS x FROM proto",
    "margin_nn": f"WITH {_NAMED} SELECT vec_id, identity, confidence FROM found",
    "margin_abstain_stats": f"WITH {_NAMED} SELECT identity, count(*) AS n, round(avg(margin), 6) AS mean_margin FROM found GROUP BY identity",
    "interproto_stats": f"""WITH {_PROTO}, c AS (SELECT a.label AS i, b.label AS j, sum(a.p * b.p) AS c FROM proto a JOIN proto b ON a.dim = b.dim AND a.label <> b.label GROUP BY ALL)
      SELECT round(avg(c), 6) AS mean, round(median(c), 6) AS median, round(quantile_cont(c, 0.95), 6) AS p95, round(max(c), 6) AS max, round(min(c), 6) AS min FROM c""",
    "top1_accuracy": f"WITH {_NAMED} SELECT round(avg((best = own::VARCHAR)::INT::DOUBLE), 6) AS accuracy, round(avg(margin), 6) AS mean_margin FROM found",
    "parity_max_abs_diff": """WITH c AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings), u AS (SELECT x, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS y FROM c)
      SELECT round(max(abs(x - y)), 9) AS max_diff, max(abs(x - y)) < 1e-4 AS same, count(*) AS n FROM u""",
    "dhash_grid": f"WITH {_HASH} SELECT vec_id, label, dhash FROM hashes",
    "strided_files": "SELECT 'n' || s_nationkey AS video, s_suppkey AS frame_index, round(s_suppkey / 24.0::DOUBLE, 6) AS timestamp_s, s_name AS content FROM supplier WHERE s_suppkey % 3 = 0 AND s_suppkey >= 10",
    "picture_dhash": """WITH p AS (SELECT l_suppkey AS frame, l_partkey % 70 AS x, l_orderkey % 61 AS y, l_quantity::BIGINT AS v FROM lineitem),
      c AS (SELECT frame, i, j, sum((least(9 * (x + 1), 70 * (i + 1)) - greatest(9 * x, 70 * i)) * (least(8 * (y + 1), 61 * (j + 1)) - greatest(8 * y, 61 * j)) * v)::DOUBLE
              / sum((least(9 * (x + 1), 70 * (i + 1)) - greatest(9 * x, 70 * i)) * (least(8 * (y + 1), 61 * (j + 1)) - greatest(8 * y, 61 * j))) AS m
            FROM p, range(9) a(i), range(8) b(j) WHERE 9 * x < 70 * (i + 1) AND 70 * i < 9 * (x + 1) AND 8 * y < 61 * (j + 1) AND 61 * j < 8 * (y + 1) GROUP BY ALL),
      g AS (SELECT frame, i, j, coalesce(m, 0) AS m FROM (SELECT DISTINCT frame FROM p) CROSS JOIN range(9) a(i) CROSS JOIN range(8) b(j) LEFT JOIN c USING (frame, i, j))
      SELECT l.frame, CASE WHEN bool_or(l.i = 0 AND l.j = 0 AND r.m > l.m) THEN (-9223372036854775808)::BIGINT ELSE 0::BIGINT END + sum(CASE WHEN r.m > l.m AND (l.i > 0 OR l.j > 0) THEN 1::BIGINT << (63 - (l.j * 8 + l.i)) ELSE 0 END)::BIGINT AS dhash
      FROM g l JOIN g r ON r.frame = l.frame AND r.j = l.j AND r.i = l.i + 1 GROUP BY l.frame""",
    "hamming_neighbours": f"WITH {_HASH}, p AS (SELECT vec_id, dhash, lag(dhash) OVER (PARTITION BY label ORDER BY vec_id) AS was FROM hashes) SELECT vec_id, bit_count(xor(dhash, was))::INT AS bits FROM p WHERE was IS NOT NULL",
    "dedup_last_kept": f"WITH RECURSIVE {_FOLD} SELECT label, vec_id, kept FROM w",
    "select_board_frames": f"WITH RECURSIVE {_FOLD} SELECT label, vec_id FROM w WHERE kept AND vec_id % 3 <> 0",
    "orb_ratio_count": f"""WITH {_PROTO}, {_HASH}, pg AS (SELECT label, list(p ORDER BY dim) AS e FROM proto GROUP BY label),
      refs AS (SELECT list_sum(list_transform(range(56), lambda i: CASE WHEN e[(i // 7) * 8 + i % 7 + 2] > e[(i // 7) * 8 + i % 7 + 1] THEN 1::BIGINT << (55 - i) ELSE 0::BIGINT END))::BIGINT AS rh FROM pg),
      ds AS (SELECT vec_id, list(bit_count(xor(dhash, rh)) ORDER BY bit_count(xor(dhash, rh))) AS d FROM hashes CROSS JOIN refs GROUP BY vec_id)
      SELECT d[1]::INT AS d1, count(*) AS n, count(*) FILTER (WHERE d[1] < 0.95 * d[2]) AS good FROM ds GROUP BY 1""",
    "stride_sample": """WITH s AS (SELECT event_id, CASE user_id % 3 WHEN 0 THEN 30.0 WHEN 1 THEN 60.0 ELSE 25.0 END::DOUBLE AS fps, CASE user_id % 3 WHEN 0 THEN 20 WHEN 1 THEN 40 ELSE 17 END AS stride FROM events)
      SELECT event_id, stride::INT AS stride, round(event_id / fps, 6) AS timestamp_s FROM s WHERE event_id % stride = 0""",
    "media_fps": """WITH s AS (SELECT event_id, value * 5 - 100 AS c, CASE WHEN event_id % 3 > 0 AND event_id % 61 > 0 THEN (event_id % 61)::DOUBLE / (event_id % 3) END AS p FROM events)
      SELECT event_id, round(CASE WHEN c > 0 AND c < 1000 THEN c ELSE coalesce(p, 30.0) END, 6) AS fps, CASE WHEN c > 0 AND c < 1000 THEN 'container' WHEN p IS NOT NULL THEN 'probe' ELSE 'fallback' END AS fps_source FROM s""",
    "asof_resample": f"WITH {_TICKS} SELECT user_id, tick, event_id FROM ticks",
    "cfr_dup_flags": f"WITH {_TICKS} SELECT user_id, tick > a AS dup, count(*) AS n FROM ticks GROUP BY ALL",
    "cfr_dropped": f"WITH {_RUNS} SELECT user_id, event_id FROM runs WHERE a > b",
    "session_counters": f"""WITH {_RUNS} SELECT user_id, count(*) AS submitted, sum(greatest(b - a + 1, 0))::BIGINT AS encoded, sum(greatest(b - a, 0))::BIGINT AS duplicated, count(*) FILTER (WHERE a > b) AS cfr_dropped,
      string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS sizes FROM runs GROUP BY user_id""",
    "thin_max_fps": f"""WITH RECURSIVE {_CAPTURES}, n AS (SELECT user_id, event_id, seconds, row_number() OVER (PARTITION BY user_id ORDER BY seconds, event_id) AS k FROM captures),
      w AS (SELECT user_id, event_id, k, seconds AS last, TRUE AS kept FROM n WHERE k = 1
        UNION ALL SELECT n.user_id, n.event_id, n.k, CASE WHEN n.seconds - w.last >= 1.0::DOUBLE / (1 / 21600.0::DOUBLE) THEN n.seconds ELSE w.last END, n.seconds - w.last >= 1.0::DOUBLE / (1 / 21600.0::DOUBLE) FROM w JOIN n ON n.user_id = w.user_id AND n.k = w.k + 1)
      SELECT user_id, event_id FROM w WHERE kept""",
    "segment_islands": f"""WITH {_CAPTURES}, c AS (SELECT *, coalesce(lag(event_type) OVER o <> event_type, FALSE)::INT AS ch FROM captures WINDOW o AS (PARTITION BY user_id ORDER BY seconds, event_id)),
      s AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY seconds, event_id) AS segment FROM c)
      SELECT event_id, segment::BIGINT AS segment, (row_number() OVER (PARTITION BY user_id, segment ORDER BY seconds, event_id) - 1)::INT AS segment_frame FROM s""",
    "capture_fps": f"WITH {_CAPTURES} SELECT user_id, count(*) AS n, round(CASE WHEN count(*) > 1 AND max(seconds) > min(seconds) THEN (count(*) - 1) / (max(seconds) - min(seconds)) END * 86400, 6) AS frames_per_day FROM captures GROUP BY user_id",
    "wall_align": f"WITH {_CAPTURES} SELECT event_id, round_even((seconds - 1704067200.0) * 0.5, 0)::BIGINT AS frame_index, (event_id % 1001 - (event_id % 1001) % 2)::INT AS even_w FROM captures",
    "json_readings": "SELECT event_type, sum((props ->> '$.k')::INT)::BIGINT AS k_sum, count(props ->> '$.k') AS k_n FROM events GROUP BY event_type",
    "temporal_fusion": f"""WITH {_CAPTURES}, m AS (SELECT *, max(seconds) OVER (PARTITION BY user_id) AS now FROM captures), g AS (SELECT user_id, event_type, sum(value * exp(-1e-6 * (now - seconds))) AS weight FROM m GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY weight DESC, event_type DESC) AS k FROM g)
      SELECT user_id, max(event_type) FILTER (WHERE k = 1) AS event_type, round(max(weight) FILTER (WHERE k = 1), 4) AS weight, round(max(weight) FILTER (WHERE k = 1) - coalesce(max(weight) FILTER (WHERE k = 2), 0), 4) AS lead FROM r GROUP BY user_id""",
    "fused_windows": f"""WITH RECURSIVE {_FUSION} SELECT c.user_id, c."window", c.slot, c.identity, round(greatest(c.own - c.other, 0), 4) AS confidence, round(c.own, 4) AS support, c.revealed, c.last_seen_frame,
      (SELECT count(*) FROM g WHERE g.user_id = c.user_id AND g."window" = c."window" AND g.frame > c.last_seen_frame) AS staleness_frames, fused_from, first_frame, last_frame FROM cards c JOIN spans USING (user_id, "window")""",
    "box_area_aspect": f"""WITH {_BOXES}, p AS (SELECT frame, w * 1280 AS pw, h * 720 AS ph FROM boxes) SELECT frame, count(*) AS n FROM p
      WHERE pw * ph BETWEEN 0.0015::DOUBLE * 1280 * 720 AND 0.09::DOUBLE * 1280 * 720 AND coalesce(pw / nullif(ph, 0), 0) BETWEEN 0.38::DOUBLE AND 1.4::DOUBLE GROUP BY frame""",
    "hud_antijoin": f"WITH {_BOXES} SELECT frame, count(*) AS n, min(box_id) AS first_box FROM boxes WHERE NOT ({_COVERED}) GROUP BY frame",
    "iou_nms": f"WITH RECURSIVE {_BOXES}, outside AS (SELECT * FROM boxes WHERE NOT ({_COVERED})), {_nms('outside')} SELECT frame, slot, b.box_id AS box_id FROM nms",
    "iou_semijoin": f"WITH {_BOXES} SELECT frame, count(*) AS n FROM boxes a WHERE EXISTS (SELECT 1 FROM boxes t WHERE t.frame = a.frame AND t.l_quantity > 45 AND {_IOU.format(a='a', b='t')} >= 0.15) GROUP BY frame",
    "crop_pixels": f"""WITH {_BOXES}, e AS (SELECT frame, least(greatest(round_even(x * 1280, 0), 0), 1280)::INT AS x0, least(greatest(round_even(y * 720, 0), 0), 720)::INT AS y0, least(greatest(round_even((x + w) * 1280, 0), 0), 1280)::INT AS x1, least(greatest(round_even((y + h) * 720, 0), 0), 720)::INT AS y1 FROM boxes),
      b AS (SELECT *, floor((y1 - y0) * 0.12::DOUBLE) AS r0, floor((y1 - y0) * 0.62::DOUBLE) AS r1, floor((x1 - x0) * 0.08::DOUBLE) AS c0, floor((x1 - x0) * 0.92::DOUBLE) AS c1 FROM e)
      SELECT frame, sum(x0)::BIGINT AS x0, sum(y0)::BIGINT AS y0, sum(x1)::BIGINT AS x1, sum(y1)::BIGINT AS y1, sum(CASE WHEN r1 <= r0 OR c1 <= c0 THEN (y1 - y0) * (x1 - x0) ELSE (r1 - r0) * (c1 - c0) END)::BIGINT AS band, count(*) FILTER (WHERE x1 <= x0 OR y1 <= y0) AS n_empty FROM b GROUP BY frame""",
    "overlay_pixels": f"""WITH {_BOXES} SELECT frame, max(least(greatest(round_even(x * 640, 0), 0), 639))::INT AS x0, max(least(greatest(round_even(y * 360, 0), 0), 359))::INT AS y0, max(least(greatest(round_even((x + w) * 640, 0), 0), 640))::INT AS x1,
      max(least(greatest(round_even((y + h) * 360, 0), 0), 360))::INT AS y1 FROM boxes GROUP BY frame""",
    "gate_case": f"""WITH {_PIXELS}, s AS (SELECT frame, avg(v) AS mean, avg(v) FILTER (WHERE x >= 19 AND x < 44 AND y >= 19 AND y < 44) AS center,
        greatest(avg(v) FILTER (WHERE x >= 6 AND x < 57 AND y >= 6 AND y < 57 AND NOT (x >= 19 AND x < 44 AND y >= 19 AND y < 44)), 1.0) AS ring FROM pixels GROUP BY frame)
      SELECT frame, round(mean, 6) AS mean, round(center, 6) AS center, round(ring, 6) AS ring, CASE WHEN mean >= 160 THEN 'menu' WHEN coalesce(center / ring >= 2, FALSE) THEN 'modal' ELSE 'board' END AS state FROM s""",
    "red_shift": f"WITH {_PIXELS} SELECT frame, round(avg(r - greatest(g, b)), 6) AS red_shift, avg(r - greatest(g, b)) >= 10 AS tinted FROM pixels GROUP BY frame",
    "hs_histogram": f"WITH {_PIXELS}, {_hist('hist', 'frame')} SELECT k AS frame, bin, round(share, 6) AS share FROM hist",
    "hist_corr_top2": f"""WITH {_PIXELS}, {_hist('ch', 'frame')}, {_hist('gh', 'shot')},
      a AS (SELECT k, sum(share) AS s, sum(share * share) AS q FROM ch GROUP BY k), b AS (SELECT k, sum(share) AS s, sum(share * share) AS q FROM gh GROUP BY k),
      xy AS (SELECT ch.k AS frame, gh.k AS shot, sum(ch.share * gh.share) AS xy FROM ch JOIN gh USING (bin) GROUP BY ALL),
      sc AS (SELECT a.k AS frame, b.k AS shot, round(coalesce((coalesce(xy, 0) - a.s * b.s / 512) / nullif(sqrt((a.q - a.s * a.s / 512) * (b.q - b.s * b.s / 512)), 0), 0), 9) AS score FROM a CROSS JOIN b LEFT JOIN xy ON a.k = xy.frame AND b.k = xy.shot),
      r AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY score DESC, shot) AS n FROM sc),
      m AS (SELECT frame, shot, count(*) AS n FROM pixels GROUP BY ALL),
      p AS (SELECT frame, max(least(greatest(score, 0), 1)) FILTER (WHERE n = 1) AS s1, max(least(greatest(score, 0), 1)) FILTER (WHERE n = 2) AS s2, max(shot) FILTER (WHERE n = 1) AS i1, max(shot) FILTER (WHERE n = 2) AS i2 FROM r WHERE n <= 2 GROUP BY frame),
      t AS (SELECT p.*, coalesce(s1 - s2 < 0.05 AND coalesce(m2.n, 0) > coalesce(m1.n, 0) AND coalesce(m2.n, 0) >= 4, FALSE) AS take FROM p LEFT JOIN m m1 ON m1.frame = p.frame AND m1.shot = i1 LEFT JOIN m m2 ON m2.frame = p.frame AND m2.shot = i2),
      f AS (SELECT DISTINCT frame FROM pixels)
      SELECT f.frame, CASE WHEN coalesce(s1, 0) < 0.4 THEN 'unknown' WHEN take THEN i2::VARCHAR ELSE i1::VARCHAR END AS identity, round(CASE WHEN coalesce(s1, 0) >= 0.4 AND take THEN s2 ELSE coalesce(s1, 0) END, 4) AS score FROM f LEFT JOIN t USING (frame)""",
    "ensemble_combine": f"""WITH {_VERDICTS}, j AS (SELECT coalesce(c.doc_id, e.doc_id) AS doc_id, coalesce(ci, 'unknown') AS ci, coalesce(cc, 0) AS cc, coalesce(ei, 'unknown') AS ei, coalesce(ec, 0) AS ec, cr, er FROM classical c FULL JOIN embedding e ON c.doc_id = e.doc_id),
      s AS (SELECT *, CASE WHEN ci = 'unknown' AND ei = 'unknown' THEN 'both_unknown' WHEN ci = ei THEN 'agree' WHEN ci = 'unknown' THEN 'embedding_only' WHEN ei = 'unknown' THEN 'classical_only' ELSE 'disagree_abstain' END AS source FROM j)
      SELECT doc_id, CASE WHEN source IN ('agree', 'classical_only') THEN ci WHEN source = 'embedding_only' THEN ei ELSE 'unknown' END AS identity,
        round(CASE source WHEN 'agree' THEN least(1.0, greatest(cc, ec) + 0.15::DOUBLE) WHEN 'classical_only' THEN cc WHEN 'embedding_only' THEN ec ELSE 0 END, 4) AS confidence,
        coalesce(CASE WHEN source IN ('agree', 'classical_only') THEN cr WHEN source = 'embedding_only' THEN er END, 'unknown') AS role, source FROM s""",
    "tint_discount": f"""WITH {_VERDICTS}, d AS (SELECT doc_id, ci, (['villager', 'outcast', 'minion', 'demon', 'unknown', 'unknown'])[doc_id % 6 + 1] AS role, doc_id % 2 = 0 AS t, cc, round(cc * 0.7::DOUBLE, 4) AS low FROM classical)
      SELECT doc_id, CASE WHEN t AND low < 0.5 THEN 'unknown' ELSE ci END AS identity, CASE WHEN t AND low < 0.5 THEN 'unknown' ELSE role END AS role, CASE WHEN t THEN low ELSE cc END AS confidence FROM d""",
    "mining_rollup": f"""WITH {_PAIRED} SELECT source, grouping(source) = 1 AS "grand", count(DISTINCT doc_id) AS frames, count(*) AS crops, count(*) FILTER (WHERE ci = ei) AS agreements, count(*) FILTER (WHERE ci = ei AND ci = 'unknown') AS both_unknown,
      round(100.0::DOUBLE * count(*) FILTER (WHERE ci = ei) / count(*), 4) AS agree_pct FROM paired GROUP BY ROLLUP (source)""",
    "head_to_head": f"""WITH {_PAIRED} SELECT count(*) AS n, count(*) FILTER (WHERE ci <> 'unknown') AS classical_identified, count(*) FILTER (WHERE ci = 'unknown') AS classical_unknown, count(*) FILTER (WHERE ei <> 'unknown') AS embedding_identified,
      count(*) FILTER (WHERE ei = 'unknown') AS embedding_unknown, count(*) FILTER (WHERE ci = ei) AS agree, count(*) FILTER (WHERE ci <> ei) AS disagree FROM paired""",
    "gallery_counts": f"WITH {_GALLERY} SELECT role, count(*) AS n_references, count(DISTINCT identity) AS n_identities, string_agg(DISTINCT identity, ',' ORDER BY identity) AS names FROM gallery GROUP BY role",
    "alias_resolve": f"WITH {_GALLERY} SELECT CASE WHEN n_nationkey % 5 = 4 THEN 'NATION_' || (n_nationkey - 1) ELSE identity END AS identity, count(*) AS n FROM gallery GROUP BY 1",
    "slugify_urls": f"SELECT page_id, regexp_replace(replace(trim(url, {_BLANKS}), ' ', '_'), '[^A-Za-z0-9._-]', '_', 'g') AS slug FROM pages",
    "art_filter": "WITH f AS (SELECT p_partkey, lower(replace(p_name, ' ', '_') || '_' || (['logo.PNG', 'card.webp', 'icon.png', 'cc-by.jpg', 'portrait.JPEG', 'notes.txt'])[p_partkey % 6 + 1]) AS n FROM part) SELECT p_partkey, ("
    + " OR ".join(f"ends_with(n, '{t}')" for t in ART_TYPES) + ") AND NOT (" + " OR ".join(f"contains(n, '{h}')" for h in NOT_ART) + ") AS is_art FROM f",
    "uncached_pages": "SELECT page_id AS title FROM pages WHERE page_id % 3 <> 0",
    "title_batches": "WITH n AS (SELECT p_brand, p_partkey, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) // 40 AS batch FROM part) SELECT p_brand, batch::BIGINT AS batch, count(*) AS n, min(p_partkey) AS first, max(p_partkey) AS last FROM n GROUP BY p_brand, batch",
    "manifest_summary": f"WITH {_GALLERY} SELECT role, count(DISTINCT identity) AS n_identities, count(*) AS n_files FROM gallery GROUP BY role",
    "filename_parse": """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'v' || user_id WHEN 1 THEN 'clip' || event_id ELSE 'v' END AS video, (CASE event_id % 4 WHEN 0 THEN event_id WHEN 3 THEN event_id ELSE 0 END)::INT AS frame_index,
      (CASE event_id % 4 WHEN 0 THEN floor(value) WHEN 2 THEN 1.5 ELSE 0 END)::DOUBLE AS timestamp_s FROM events""",
    "snapshot_nest": f"WITH RECURSIVE {_SNAPSHOTS} SELECT frame, state AS frame_state, n AS n_cards, cards, '0.2.0' AS schema_version FROM snap",
    "summary_lines": f"WITH RECURSIVE {_SNAPSHOTS} SELECT frame, printf('%-35s  state=%-7s  cards=%d', 'frame' || frame, state, n) || CASE WHEN n > 0 THEN '  ' || named ELSE '' END AS line FROM snap",
    "crop_names": "SELECT event_id, printf('u%d_%06d_t%07.1fs_s%02d.png', user_id, event_id, floor(value), event_id % 12) AS name FROM events",
    "iso_time": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS at FROM events",
    "zip_identities": """WITH b AS (SELECT l_orderkey, l_linenumber, max(0.04::DOUBLE + (l_quantity % 10) / 100.0::DOUBLE) AS w, max(l_returnflag) AS identity FROM lineitem GROUP BY ALL)
      SELECT identity, count(*) AS n, round(sum(w), 4) AS w FROM b GROUP BY identity""",
    "frame_limit": f"WITH {_CAPTURES} SELECT user_id, event_id FROM captures QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seconds, event_id) <= 20",
    "skipped_union": "SELECT p_brand AS name FROM part UNION SELECT p_type FROM part",
    "stem_lookup": """WITH f AS (SELECT lower(c_mktsegment) || '_' || c_nationkey || '_' AS prefix, 'dir/' || lower(c_mktsegment) || '_' || c_nationkey || '_' || c_custkey || '.png' AS path FROM customer)
      SELECT prefix, min(path) AS path FROM f GROUP BY prefix""",
    "localize_blobs": f"WITH {_BLOBS} SELECT frame, 0 AS slot, round(x / 160.0::DOUBLE, 6) AS x, round(y / 90.0::DOUBLE, 6) AS y, round(w / 160.0::DOUBLE, 6) AS w, round(h / 90.0::DOUBLE, 6) AS h FROM blobs",
    "pipeline_records": f"WITH {_BLOBS} SELECT frame, 'board' AS frame_state, 1 AS n_cards, CASE frame % 3 WHEN 0 THEN 'Moss' WHEN 1 THEN 'Iris' ELSE 'Ember' END AS identity, CASE frame % 3 WHEN 0 THEN 'villager' WHEN 1 THEN 'minion' ELSE 'demon' END AS role, 1.0::DOUBLE AS confidence FROM blobs",
}
