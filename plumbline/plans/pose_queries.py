"""The pose chain as queries, from drawn keypoints to scores, and the recursive SQL that checks every stage.

Every supplier stands for a clip: its key picks the story and the size, its nation the seed. The SQL draws the same
clips and walks them frame by frame: the folds and automata are recursive queries over each series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import geometry as geo
from plumbline.operators import diagram, matching, scoring, stats
from plumbline.plans import pose
from plumbline.plans.queries import ORACLE_SQL, QUERIES, rounded, table
from plumbline.session import settled
from plumbline.sources import clips
from plumbline.sources.clips import CASES, CYCLE_MS, FIELDS, JITTER_PX, JOINTS, NAMES

PARTS, SIDES = pose.PARTS, ("left", "right")


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clip for each supplier."""
    key = F.col("s_suppkey").cast("long")
    case = F.element_at(F.array(*map(F.lit, NAMES)), (key % len(NAMES) + 1).cast("int"))
    return table(spark, sf_dir, "supplier").select(key.alias("clip_id"), case.alias("case"), F.col("s_nationkey").alias("seed"), (0.8 + (key % 40) / 100.0).alias("size"))


def keypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clips.clips(seeds(spark, sf_dir))


def classified(spark: SparkSession, sf_dir: str, only: Column | None = None) -> DataFrame:
    """Frames with phase and hold; of the clips that ``only`` chooses, where it is given."""
    # suppliers of one key are one clip with several samples at a time; by clip alone the window would take the place of the dealing, which keeps every core busy
    told = seeds(spark, sf_dir).withColumn("copy", F.row_number().over(Window.partitionBy("clip_id", "seed").orderBy("size")))
    told = told if only is None else told.where(only)
    return pose.classify(pose.motion(pose.clean_frames(clips.clips(told, ("seed", "copy")), ("seed", "copy"))))


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``classified`` with body features."""
    return pose.body_features(classified(spark, sf_dir))


# --- SQL: the clips -----------------------------------------------------------------------------------


def _values(rows: list[tuple]) -> str:
    say = lambda v: f"'{v}'" if isinstance(v, str) else f"{v!r}::DOUBLE" if isinstance(v, float) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(map(say, r)) + ")" for r in rows) + ")"


def _moves() -> list[tuple]:
    return [(name, float(a[0]), float(b[0]), *(float(getattr(k[1], f)) for f in FIELDS for k in (a, b))) for name, s in CASES.items() for a, b in zip(s.keys, s.keys[1:], strict=False)]


def _away(x: str, y: str, degrees: str, length: float) -> tuple[str, str]:
    return f"{x} + cos(radians({degrees})) * {length}", f"{y} + sin(radians({degrees})) * {length}"


def _body() -> str:
    """The list of joints of a frame whose chain is known, from shoulder (sx, sy), wrist (wx, wy), knee and ankle."""
    at = {"shoulder": ("sx", "sy"), "elbow": ("sx + 0.45 * (wx - sx)", "sy + 0.45 * (wy - sy)"), "wrist": ("wx", "wy"), "hip": ("hip_x", "hip_y"), "knee": ("kx", "ky"), "ankle": ("ax", "ay")}
    at["foot_index"] = _away("ax", "ay", "foot", clips.TOE)
    nose = _away("sx", "sy", "trunk", clips.HEAD)
    rows = [("nose", f"{nose[0]} + {clips.NOSE}", nose[1])]
    for part, off in clips.OFFSETS.items():
        x, y = at[part]
        rows += [(f"left_{part}", f"{x} - {off}" + (" + step" if part == "wrist" else ""), y), (f"right_{part}", f"{x} + {off}", y)]
    return "[" + ", ".join(f"{{'joint': '{j}', 'x': {x}, 'y': {y}}}" for j, x, y in rows) + "]"


_RAMP = "(least(1.0, greatest(0.0, {0})) ** 2 * (3 - 2 * least(1.0, greatest(0.0, {0}))))"
_DIGEST = "('0x' || substr(md5(seed || ':' || clip || ':' || frame || ':' || joint), {0}, 8))::BIGINT + 0.5::DOUBLE"
CLIPS = f"""sup AS (SELECT s_suppkey::BIGINT AS clip, {list(NAMES)}[s_suppkey % {len(NAMES)} + 1] AS cs, s_nationkey AS seed, 0.8::DOUBLE + (s_suppkey % 40)::DOUBLE / 100 AS size FROM supplier),
mv(cs, t0, t1, {', '.join(f'{f}_{k}' for f in FIELDS for k in 'ab')}) AS {_values(_moves())},
sw(cs, a, b) AS {_values([(n, float(a), float(b)) for n, s in CASES.items() for a, b in s.sways])},
fl(cs, kind, at_ms, many, which, delta) AS {_values([(n, m.kind, round(m.at_s * 1000), 1 if m.kind == 'outlier' else m.count, m.joint, m.delta) for n, s in CASES.items() for m in s.mutations])},
st0(cs, jitter, ends, cycle) AS {_values([(n, s.jitter, round(s.keys[-1][0] * 1000), i) for i, (n, s) in enumerate(CASES.items())])},
tm AS (SELECT cs, jitter, n AS frame, n // 8 * {sum(CYCLE_MS)} + coalesce(list_sum(list_slice(list_concat({list(CYCLE_MS)}, {list(CYCLE_MS)}), cycle + 1, cycle + n % 8)), 0)::BIGINT AS t_ms, ends FROM st0, range(400) r(n)),
fm AS (SELECT cs, jitter, frame, t_ms, t_ms / 1000 AS t FROM tm WHERE t_ms < ends),
fe AS (SELECT fm.*, mv.* EXCLUDE (cs), {_RAMP.format('(t - t0) / (t1 - t0)')} AS e, coalesce((SELECT max({_RAMP.format(f'(t - a) / {clips.SWAY_RAMP_S}')} * {_RAMP.format(f'(b - t) / {clips.SWAY_RAMP_S}')}) FROM sw WHERE sw.cs = fm.cs AND t BETWEEN a AND b), 0) AS share
  FROM fm JOIN mv ON mv.cs = fm.cs AND t >= t0 AND t < t1),
fp AS (SELECT cs, jitter, frame, t_ms, {', '.join(f'{f}_a + ({f}_b - {f}_a) * e AS {f}' for f in FIELDS)}, radians({clips.SWAY_DEG} * sin(2 * pi() * t / {clips.SWAY_PERIOD_S}) * share) AS sway FROM fe),
fs0 AS (SELECT *, {' , '.join(f'{e} AS {n}' for n, e in zip(('sx', 'sy'), _away('hip_x', 'hip_y', 'trunk', clips.TORSO), strict=True))}, {' , '.join(f'{e} AS {n}' for n, e in zip(('kx', 'ky'), _away('hip_x', 'hip_y', 'leg', clips.THIGH), strict=True))},
  {' , '.join(f'{e} AS {n}' for n, e in zip(('ax', 'ay'), _away('hip_x', 'hip_y', 'leg', clips.THIGH + clips.SHIN), strict=True))} FROM fp),
fw AS (SELECT *, {' , '.join(f'{e} AS {n}' for n, e in zip(('wx', 'wy'), _away('sx', 'sy', 'arm', clips.ARM), strict=True))} FROM fs0),
fb AS MATERIALIZED (SELECT cs, jitter, frame, t_ms, sway, wx + step / 2 AS ox, wy AS oy, unnest({_body()}, recursive := true) FROM fw),
fr AS (SELECT cs, jitter, frame, t_ms, joint, ox + cos(sway) * (x - ox) - sin(sway) * (y - oy) AS x, oy + sin(sway) * (x - ox) + cos(sway) * (y - oy) AS y FROM fb),
ff AS (SELECT fl.*, (SELECT least(count(*) FILTER (t_ms < at_ms), count(*) - 1) FROM fm WHERE fm.cs = fl.cs) AS f0 FROM fl),
nz AS (SELECT fr.*, clip, size, ({_DIGEST.format(1)}) / 4294967296 AS u1, ({_DIGEST.format(9)}) / 4294967296 AS u2 FROM fr JOIN sup USING (cs)),
hit AS (SELECT nz.*, coalesce((SELECT any_value(delta) FROM ff WHERE ff.cs = nz.cs AND kind = 'outlier' AND frame = f0 AND which = joint), 0) AS spike,
  EXISTS (SELECT 1 FROM ff WHERE ff.cs = nz.cs AND kind = 'undetected' AND frame >= f0 AND frame < f0 + many) AS gone, EXISTS (SELECT 1 FROM ff WHERE ff.cs = nz.cs AND kind = 'low_visibility' AND frame >= f0 AND frame < f0 + many) AS dim,
  EXISTS (SELECT 1 FROM ff WHERE ff.cs = nz.cs AND kind = 'contact' AND frame >= f0 AND frame < f0 + many) AS contact FROM nz),
kp AS MATERIALIZED (SELECT clip, cs, frame, t_ms, t_ms / 1000 AS t, joint, CASE WHEN NOT gone THEN round(size * (x + jitter * (sqrt(-2 * ln(u1)) * cos(2 * pi() * u2))) + spike * size, 6) END AS x,
  CASE WHEN NOT gone THEN round(size * (y + jitter * (sqrt(-2 * ln(u1)) * sin(2 * pi() * u2))), 6) END AS y,
  CASE WHEN gone THEN NULL WHEN dim THEN 0.1 WHEN joint = 'nose' THEN 0.9 WHEN joint LIKE 'left%' THEN 0.95 ELSE 0.72 END::DOUBLE AS vis, contact FROM hit)"""

# --- SQL: cleaning ------------------------------------------------------------------------------------


def _wide(source: str, ok: str, keep: str) -> str:
    return f"SELECT clip, frame, t_ms, t, {keep}, " + ", ".join(f"max({c}) FILTER (joint = '{j}' AND {ok}) AS {j}_{c}" for j in JOINTS for c in "xy") + f" FROM {source} GROUP BY clip, frame, t_ms, t"


def _gap(a: str, b: str) -> str:
    return f"sqrt(({a}_x - {b}_x) ** 2 + ({a}_y - {b}_y) ** 2)"


def _span(a: str, b: str) -> str:
    return f"list_max([{_gap(f'left_{a}', f'left_{b}')}, {_gap(f'right_{a}', f'right_{b}')}])"


_MID = lambda p, c: f"(left_{p}_{c} + right_{p}_{c}) / 2"
_ALPHA = "1 / (1 + 1 / (2 * pi() * {0} * dt))"
CLEAN = f"""g AS MATERIALIZED (SELECT *, coalesce(NOT contact AND x IS NOT NULL AND y IS NOT NULL AND vis >= 0.5, false) AS ok FROM kp),
gw AS ({_wide('g', 'ok', 'bool_or(contact) AS contact')}),
ln AS (SELECT clip, CASE WHEN least(count(torso), count(thigh), count(shin)) >= 10 THEN quantile_cont(torso, 0.9) + quantile_cont(thigh, 0.9) + quantile_cont(shin, 0.9) END AS len FROM (
  SELECT clip, sqrt(({_MID('shoulder', 'x')} - {_MID('hip', 'x')}) ** 2 + ({_MID('shoulder', 'y')} - {_MID('hip', 'y')}) ** 2) AS torso, {_span('hip', 'knee')} AS thigh, {_span('knee', 'ankle')} AS shin FROM gw) GROUP BY clip),
o AS MATERIALIZED (SELECT g.*, len, row_number() OVER (PARTITION BY clip, joint ORDER BY t, frame) AS n FROM g JOIN ln USING (clip)),
k AS (SELECT clip, joint, n, ok AS kept, CASE WHEN ok THEN t END AS rt, CASE WHEN ok THEN x END AS rx, CASE WHEN ok THEN y END AS ry FROM o WHERE n = 1
  UNION ALL SELECT clip, joint, n, k, CASE WHEN k THEN t ELSE rt END, CASE WHEN k THEN x ELSE rx END, CASE WHEN k THEN y ELSE ry END FROM (
    SELECT o.*, k.rt, k.rx, k.ry, o.ok AND coalesce(NOT (o.t > k.rt AND sqrt((o.x - k.rx) ** 2 + (o.y - k.ry) ** 2) / (o.len * (o.t - k.rt)) > 8.0), true) AS k FROM k JOIN o ON o.clip = k.clip AND o.joint = k.joint AND o.n = k.n + 1)),
nb AS (SELECT o.*, kept, last_value(CASE WHEN kept THEN {{'t': t, 'x': x, 'y': y}} END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p,
  first_value(CASE WHEN kept THEN {{'t': t, 'x': x, 'y': y}} END IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q FROM o JOIN k USING (clip, joint, n) WINDOW w AS (PARTITION BY clip, joint ORDER BY n)),
nf AS (SELECT *, coalesce(NOT kept AND q.t - p.t > 0 AND q.t - p.t <= 0.2, false) AS filled FROM nb),
fi AS MATERIALIZED (SELECT clip, frame, t_ms, t, joint, contact, len, n, ok, kept, filled, kept OR filled AS valid, x AS raw_x, y AS raw_y, CASE WHEN filled THEN p.x + (q.x - p.x) * ((t - p.t) / (q.t - p.t)) ELSE x END AS x, CASE WHEN filled THEN p.y + (q.y - p.y) * ((t - p.t) / (q.t - p.t)) ELSE y END AS y FROM nf),
eu AS (SELECT clip, joint, n, t, valid, x / len AS fx, y / len AS fy, 0.0::DOUBLE AS vx, 0.0::DOUBLE AS vy FROM fi WHERE n = 1
  UNION ALL SELECT clip, joint, n, t, valid, CASE WHEN on_ THEN ax * zx + (1 - ax) * fx ELSE zx END, CASE WHEN on_ THEN ay * zy + (1 - ay) * fy ELSE zy END, CASE WHEN on_ THEN sx ELSE 0.0 END, CASE WHEN on_ THEN sy ELSE 0.0 END FROM (
    SELECT *, {_ALPHA.format('(1.0 + 0.3 * abs(sx))')} AS ax, {_ALPHA.format('(1.0 + 0.3 * abs(sy))')} AS ay FROM (
      SELECT *, ad * (zx - fx) / dt + (1 - ad) * vx AS sx, ad * (zy - fy) / dt + (1 - ad) * vy AS sy FROM (SELECT *, {_ALPHA.format('1.0')} AS ad FROM (
        SELECT fi.clip, fi.joint, fi.n, fi.t, fi.valid, fi.x / fi.len AS zx, fi.y / fi.len AS zy, eu.fx, eu.fy, eu.vx, eu.vy, greatest(fi.t - eu.t, 0.001) AS dt, fi.valid AND eu.valid AS on_ FROM eu JOIN fi ON fi.clip = eu.clip AND fi.joint = eu.joint AND fi.n = eu.n + 1))))),
cl AS MATERIALIZED (SELECT fi.clip, frame, t_ms, fi.t, fi.joint, contact, len, ok, kept, filled, fi.valid, raw_x, raw_y, CASE WHEN fi.valid THEN fx * len ELSE x END AS x, CASE WHEN fi.valid THEN fy * len ELSE y END AS y FROM fi JOIN eu USING (clip, joint, n))"""

# --- SQL: phases --------------------------------------------------------------------------------------

_SEEN = lambda p, c: f"coalesce((left_{p}_{c} + right_{p}_{c}) / 2, left_{p}_{c}, right_{p}_{c})"
_THEN = lambda s: f"last_value({{'t': t, 'x': {s}_wrist_x, 'y': {s}_wrist_y}}) OVER (PARTITION BY clip ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 0.2::DOUBLE PRECEDING)"
_STEP = lambda s: f"CASE WHEN t > {s}_then.t THEN sqrt(({s}_wrist_x - {s}_then.x) ** 2 + ({s}_wrist_y - {s}_then.y) ** 2) / len END"
_HALF = pose.LEG_WINDOW_S / 2 - 1e-9
PHASES = f"""cw AS MATERIALIZED ({_wide('cl', 'valid', 'bool_or(contact) AS contact, any_value(len) AS len')}),
mid AS (SELECT *, {', '.join(f'{_SEEN(p, c)} AS {p}_{c}' for p in PARTS for c in 'xy')}, row_number() OVER (PARTITION BY clip ORDER BY t, frame) AS n, {', '.join(f'{_THEN(s)} AS {s}_then' for s in SIDES)} FROM cw),
sg AS (SELECT *, NOT contact AND wrist_x IS NOT NULL AND ankle_x IS NOT NULL AND hip_x IS NOT NULL AND len IS NOT NULL AS known, (ankle_x - wrist_x) / len AS u_ankle, (wrist_y - ankle_y) / len AS v_ankle, (wrist_y - hip_y) / len AS v_hip,
  list_max([{', '.join(_STEP(s) for s in SIDES)}]) AS step_l, list_max([{', '.join(f'{_STEP(s)} / (t - {s}_then.t)' for s in SIDES)}]) AS speed_l FROM mid),
vl AS (SELECT *, coalesce(last_value({{'t': t, 'v': v_ankle, 'k': known}}) OVER (PARTITION BY clip ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND {_HALF}::DOUBLE PRECEDING), first_value({{'t': t, 'v': v_ankle, 'k': known}}) OVER (PARTITION BY clip ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS a,
  coalesce(first_value({{'t': t, 'v': v_ankle, 'k': known}}) OVER (PARTITION BY clip ORDER BY t RANGE BETWEEN {_HALF}::DOUBLE FOLLOWING AND UNBOUNDED FOLLOWING), last_value({{'t': t, 'v': v_ankle, 'k': known}}) OVER (PARTITION BY clip ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS b FROM sg),
fg AS (SELECT *, CASE WHEN known AND a.k AND b.k AND b.t > a.t THEN (b.v - a.v) / (b.t - a.t) END AS legs, coalesce(known AND v_hip > 0.1, false) AS low, coalesce(known AND step_l > 0.1, false) AS hand_step,
  CASE WHEN contact THEN 'trainer' WHEN wrist_x IS NULL THEN 'no wrists' WHEN ankle_x IS NULL THEN 'no ankles' WHEN hip_x IS NULL THEN 'no hips' ELSE '' END AS why FROM vl),
fh AS MATERIALIZED (SELECT *, low AND coalesce(speed_l < 0.3, true) AS down, coalesce(known AND legs > 0.1, false) AS rising, coalesce(known AND v_ankle > 0.6 AND abs(degrees(atan2(u_ankle, v_ankle))) <= 35, false) AND low AND coalesce(speed_l < 0.3, true) AND NOT hand_step AS h FROM fg),
hr AS (SELECT clip, n, t, CASE WHEN h THEN n END AS a, NULL::BIGINT AS b, NULL::DOUBLE AS bt, NULL::BIGINT AS e0, NULL::BIGINT AS e1 FROM fh WHERE n = 1
  UNION ALL SELECT fh.clip, fh.n, fh.t, CASE WHEN fh.h THEN coalesce(hr.a, fh.n) WHEN hr.a IS NULL OR fh.hand_step OR fh.t - hr.bt > 0.3 THEN NULL ELSE hr.a END,
    CASE WHEN fh.h OR hr.a IS NULL OR fh.hand_step OR fh.t - hr.bt > 0.3 THEN NULL ELSE coalesce(hr.b, fh.n) END, CASE WHEN fh.h OR hr.a IS NULL OR fh.hand_step OR fh.t - hr.bt > 0.3 THEN NULL ELSE coalesce(hr.bt, fh.t) END,
    CASE WHEN NOT fh.h AND (fh.hand_step OR fh.t - hr.bt > 0.3) THEN hr.a END, CASE WHEN NOT fh.h AND hr.a IS NOT NULL THEN CASE WHEN fh.hand_step THEN fh.n - 1 WHEN fh.t - hr.bt > 0.3 THEN hr.b - 1 END END FROM hr JOIN fh ON fh.clip = hr.clip AND fh.n = hr.n + 1),
rn AS (SELECT clip, e0 AS n0, e1 AS n1 FROM hr WHERE e0 IS NOT NULL UNION ALL SELECT clip, a, coalesce(b - 1, n) FROM hr JOIN (SELECT clip, max(n) AS n FROM hr GROUP BY clip) USING (clip, n) WHERE a IS NOT NULL),
hd AS (SELECT rn.clip, n0, n1, row_number() OVER (PARTITION BY rn.clip ORDER BY n0) - 1 AS hold_id FROM rn JOIN fh x ON x.clip = rn.clip AND x.n = n0 JOIN fh y ON y.clip = rn.clip AND y.n = n1 WHERE y.t - x.t >= 0.3),
hh AS MATERIALIZED (SELECT fh.*, coalesce(hold_id, -1)::BIGINT AS hold_id FROM fh LEFT JOIN hd ON hd.clip = fh.clip AND n BETWEEN n0 AND n1),
pa AS (SELECT clip, n, CASE WHEN NOT known THEN 'pre' WHEN hold_id >= 0 THEN 'hold' WHEN down AND rising THEN 'kickup' ELSE 'pre' END AS state FROM hh WHERE n = 1
  UNION ALL SELECT hh.clip, hh.n, CASE WHEN NOT hh.known THEN state WHEN hh.hold_id >= 0 THEN 'hold' WHEN state = 'hold' THEN 'exit' WHEN hh.down AND hh.rising THEN 'kickup' WHEN NOT hh.low THEN CASE WHEN state = 'pre' THEN 'pre' ELSE 'post' END ELSE state END
  FROM pa JOIN hh ON hh.clip = pa.clip AND hh.n = pa.n + 1),
ph AS MATERIALIZED (SELECT hh.*, CASE WHEN hold_id >= 0 THEN 'hold' WHEN NOT known THEN 'unknown' ELSE state END AS phase FROM hh JOIN pa USING (clip, n))"""

# --- SQL: features, holds and scores --------------------------------------------------------------------


def _turn(a: tuple[str, str], b: tuple[str, str]) -> str:
    """Unsigned degrees between two vectors."""
    (ax, ay), (bx, by) = a, b
    return f"CASE WHEN sqrt(({ax}) ** 2 + ({ay}) ** 2) > 1e-9 AND sqrt(({bx}) ** 2 + ({by}) ** 2) > 1e-9 THEN degrees(atan2(abs(({ax}) * ({by}) - ({ay}) * ({bx})), ({ax}) * ({bx}) + ({ay}) * ({by}))) END"


def _vector(a: str, b: str) -> tuple[str, str]:
    """From b to a."""
    return f"{a}_u - {b}_u", f"{a}_v - {b}_v"


def _joint_angle(a: str, b: str, c: str) -> str:
    left, right = (_turn(_vector(f"{s}_{a}", f"{s}_{b}"), _vector(f"{s}_{c}", f"{s}_{b}")) for s in SIDES)
    return f"coalesce((({left}) + ({right})) / 2, {left}, {right})"


def _mass() -> list[tuple[str, str, str]]:
    """(u, v, mass) of the segments' centres."""
    head = [f"coalesce(nose_{c}, hip_{c} + (shoulder_{c} - hip_{c}) * 1.5)" for c in "uv"]
    parts = [(*head, "0.081"), (*(f"shoulder_{c} + (hip_{c} - shoulder_{c}) * 0.5" for c in "uv"), "0.497")]
    for _, near, far, mass, place in geo.LIMBS:
        side = {s: [f"{s}_{near}_{c} + ({s}_{far}_{c} - {s}_{near}_{c}) * {place}" for c in "uv"] for s in SIDES}
        parts += [(*(f"coalesce({a}, {b})" for a, b in zip(side[s], side[t], strict=True)), str(mass)) for s, t in (SIDES, SIDES[::-1])]
    return parts


_LINE = "((ankle_u - shoulder_u) * ({p}_v - shoulder_v) - (ankle_v - shoulder_v) * ({p}_u - shoulder_u)) / nullif(greatest(sqrt((ankle_u - shoulder_u) ** 2 + (ankle_v - shoulder_v) ** 2) - 0, 0), 0)"
_ACROSS = "(nose_u - shoulder_u) * (hip_v - shoulder_v) - (nose_v - shoulder_v) * (hip_u - shoulder_u)"
NAMED = ["off_shoulder", "off_hip", "off_knee", "off_ankle", "line_deviation", "body_angle", "shoulder_angle", "hip_angle", "knee_angle", "elbow_angle", "banana", "head", "leg_separation", "hand_width"]
FEATURES = f"""bf AS (SELECT clip, frame, t_ms, t, n, hold_id, phase, {', '.join(f'({j}_x - wrist_x) / len AS {j}_u, (wrist_y - {j}_y) / len AS {j}_v' for j in (*JOINTS, *PARTS))} FROM ph),
ft0 AS (SELECT clip, frame, t_ms, t, hold_id, phase, {', '.join(f'{q}_u AS off_{q}' for q in ('shoulder', 'hip', 'knee', 'ankle'))}, list_max([abs(shoulder_u), abs(hip_u), abs(knee_u), abs(ankle_u)]) AS line_deviation, degrees(atan2(ankle_u, ankle_v)) AS body_angle,
  {_joint_angle('hip', 'shoulder', 'wrist')} AS shoulder_angle, {_joint_angle('shoulder', 'hip', 'knee')} AS hip_angle, {_joint_angle('hip', 'knee', 'ankle')} AS knee_angle, {_joint_angle('shoulder', 'elbow', 'wrist')} AS elbow_angle,
  ({_LINE.format(p='hip')}) * sign({_LINE.format(p='nose')}) AS banana, {_turn(_vector('shoulder', 'hip'), _vector('nose', 'shoulder'))} AS head, {_turn(_vector('left_ankle', 'left_hip'), _vector('right_ankle', 'right_hip'))} AS leg_separation,
  sqrt((left_wrist_u - right_wrist_u) ** 2 + (left_wrist_v - right_wrist_v) ** 2) / nullif(sqrt((left_shoulder_u - right_shoulder_u) ** 2 + (left_shoulder_v - right_shoulder_v) ** 2), 0) AS hand_width,
  nullif(sign(CASE WHEN hip_v - shoulder_v < 0 THEN -({_ACROSS}) ELSE {_ACROSS} END), 0) AS own_facing, {' AND '.join(f'{q}_u IS NOT NULL' for q in PARTS)} AS valid,
  ({' + '.join(f'coalesce(({u}) * {m}, 0)' for u, v, m in _mass())}) / nullif({' + '.join(f'CASE WHEN ({u}) IS NULL THEN 0 ELSE {m}::DOUBLE END' for u, v, m in _mass())}, 0) AS com_u FROM bf),
fc AS (SELECT *, CASE WHEN hold_id >= 0 THEN CASE WHEN count(*) FILTER (own_facing > 0) OVER w > count(*) FILTER (own_facing < 0) OVER w THEN 1 WHEN count(*) FILTER (own_facing < 0) OVER w > count(*) FILTER (own_facing > 0) OVER w THEN -1 ELSE own_facing END ELSE own_facing END AS facing
  FROM ft0 WINDOW w AS (PARTITION BY clip, hold_id)),
ft AS MATERIALIZED (SELECT *, com_u * facing AS com_forward, CASE WHEN com_u * facing < -0.03 THEN 'under' WHEN com_u * facing > 0.06 THEN 'over' WHEN com_u * facing IS NOT NULL THEN 'ok' END AS zone FROM fc)"""

HOLDS = f"""hx AS (SELECT clip, hold_id, min(t_ms) AS start_ms, max(t_ms) AS end_ms, count(*) AS frames, count(*) FILTER (valid) AS valid_frames, {', '.join(f'median({f}) FILTER (valid) AS {f}_median, quantile_cont({f}, 0.75) FILTER (valid) - quantile_cont({f}, 0.25) FILTER (valid) AS {f}_iqr' for f in NAMED)},
  CASE WHEN count(hip_angle) FILTER (valid) > 1 THEN stddev_pop(hip_angle) FILTER (valid) END AS hip_angle_sd, CASE WHEN count(shoulder_angle) FILTER (valid) > 1 THEN stddev_pop(shoulder_angle) FILTER (valid) END AS shoulder_angle_sd FROM ft WHERE hold_id >= 0 GROUP BY clip, hold_id),
hb AS (SELECT clip, hold_id, median(com_forward) AS forward_median, CASE WHEN count(*) > 1 THEN stddev_pop(com_forward) END AS sway_sd, CASE WHEN count(*) > 1 THEN quantile_cont(com_forward, 0.95) - quantile_cont(com_forward, 0.05) END AS sway_range,
  sqrt(avg(CASE WHEN dt > 0 THEN (dx / dt) ** 2 END)) AS speed_rms, 100.0 * count(*) FILTER (com_forward > 0.06) / count(*) AS pct_over, 100.0 * count(*) FILTER (com_forward < -0.03) / count(*) AS pct_under FROM (
  SELECT *, com_forward - lag(com_forward) OVER w AS dx, t - lag(t) OVER w AS dt FROM ft WHERE hold_id >= 0 AND valid AND com_forward IS NOT NULL WINDOW w AS (PARTITION BY clip, hold_id ORDER BY t)) GROUP BY clip, hold_id),
hs AS MATERIALIZED (SELECT hx.*, hb.* EXCLUDE (clip, hold_id), CASE WHEN knee_angle_median IS NULL OR hip_angle_median IS NULL OR leg_separation_median IS NULL THEN 'unmeasured' WHEN knee_angle_median < 120 THEN 'tuck' WHEN leg_separation_median > 45 THEN 'straddle' WHEN hip_angle_median < 140 THEN 'pike' ELSE 'line' END AS shape
  FROM hx LEFT JOIN hb USING (clip, hold_id))"""

RULES = scoring.Rules()
_SIGNED = lambda f: f"{f} * facing" if f in RULES.signed else f
_SPREAD = lambda c: f"CASE WHEN count({c}) FILTER (valid) > 1 THEN stddev_pop({c}) FILTER (valid) END"
_PLACES = [(f, float(RULES.floor(f)), int(f in RULES.one_sided), i, next((g for g, _, m in RULES.groups if f in m), ""), next((float(w) for _, w, m in RULES.groups if f in m), 0.0), next((len(m) for _, _, m in RULES.groups if f in m), 1)) for i, f in enumerate(RULES.features)]
SCORES = f"""hv AS (SELECT clip, hold_id, count(*) FILTER (valid) AS valid_frames, {', '.join(f'{_SPREAD(RULES.spreads[f])} AS {f}' if f in RULES.spreads else f'median({_SIGNED(f)}) FILTER (valid) AS {f}' for f in RULES.features)} FROM ft WHERE hold_id >= 0 GROUP BY clip, hold_id),
lv AS (UNPIVOT (SELECT clip, hold_id, valid_frames, {', '.join(RULES.features)} FROM hv) ON {', '.join(RULES.features)} INTO NAME feature VALUE v),
rf AS (SELECT feature, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd FROM lv WHERE clip % {len(NAMES)} = 0 AND valid_frames >= 5 GROUP BY feature),
pl(feature, floor_, one, ord, grp, w, size) AS {_values(_PLACES)},
zz AS (SELECT lv.*, pl.* EXCLUDE (feature), mean, greatest(sd, floor_) AS width, greatest(-4.0, least(4.0, CASE WHEN one = 1 THEN least((v - mean) / greatest(sd, floor_), 0) ELSE (v - mean) / greatest(sd, floor_) END)) AS z FROM lv JOIN rf USING (feature) JOIN pl USING (feature) WHERE valid_frames >= 5),
gg AS (SELECT clip, hold_id, grp, any_value(w) AS w, avg(abs(z)) AS d FROM zz WHERE grp <> '' GROUP BY ALL),
dd AS (SELECT clip, hold_id, sum(w * d) / sum(w) AS deviation FROM gg GROUP BY ALL),
pn AS (SELECT clip, hold_id, 0.1 * greatest(0, max(z)) AS penalty FROM zz WHERE feature = 'hip_angle_sd' GROUP BY ALL),
sc AS (SELECT hv.clip, hv.hold_id, valid_frames, deviation, coalesce(penalty, 0) AS penalty, CASE WHEN valid_frames >= 5 THEN round(100 * greatest(0, 1 - (deviation + coalesce(penalty, 0)) / 4), 1) END AS score,
  CASE WHEN valid_frames < 5 THEN 'too few valid frames' WHEN deviation IS NULL THEN 'nothing to compare' ELSE '' END AS reason FROM hv LEFT JOIN dd USING (clip, hold_id) LEFT JOIN pn USING (clip, hold_id))"""

STAGES = [CLIPS, CLEAN, PHASES, FEATURES, HOLDS, SCORES]


def checked(stages: int, sql: str):
    """Registers a query of the chain with SQL that follows the first stages; ``+ 0`` there makes a rounded -0 the 0 that it is here."""

    def register(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = "WITH RECURSIVE " + ",\n".join(STAGES[:stages]) + "\n" + sql
        return f

    return register


@checked(1, "SELECT clip AS clip_id, cs AS case_name, frame AS frame_idx, t_ms, joint, x, y, vis AS visibility, contact FROM kp")
def pose_clips(spark, sf_dir):
    """ORC6."""
    rows = keypoints(spark, sf_dir)
    return rows.select("clip_id", F.col("case").alias("case_name"), "frame_idx", "t_ms", "joint", "x", "y", "visibility", F.col("trainer_contact").alias("contact"))


@checked(2, "SELECT clip AS clip_id, frame AS frame_idx, joint, round(x, 3) AS x, round(y, 3) AS y, valid, filled, round(len, 3) AS body_length FROM cl")
def pose_clean(spark, sf_dir):
    """PP1-10."""
    return rounded(pose.clean(keypoints(spark, sf_dir)), "x", "y", "body_length", digits=3).select("clip_id", "frame_idx", "joint", "x", "y", "valid", "filled", "body_length")


@checked(
    2,
    """, hl AS (SELECT clip, frame, coalesce(avg(raw_y) FILTER (ok AND joint LIKE '%wrist') > avg(raw_y) FILTER (ok AND joint LIKE '%ankle'), false) AS up FROM cl GROUP BY clip, frame)
SELECT clip AS clip_id, count(*) AS samples, count(*) FILTER (kept) AS measured, count(*) FILTER (filled) AS filled, count(*) FILTER (NOT ok AND NOT filled) AS gated_out, count(*) FILTER (ok AND NOT kept AND NOT filled) AS outliers, 0::BIGINT AS unusable,
  count(DISTINCT frame) FILTER (up) AS hold_like_frames, count(*) FILTER (up) AS hold_like_samples, count(*) FILTER (up AND kept) AS hold_like_measured FROM cl JOIN hl USING (clip, frame) GROUP BY clip""",
)
def pose_losses(spark, sf_dir):
    """PP11, PP13."""
    return pose.clean_counts(pose.clean(keypoints(spark, sf_dir)))


@checked(3, "SELECT clip AS clip_id, frame AS frame_idx, phase, hold_id, known, why AS unknown_reason, round(v_ankle, 4) + 0 AS v_ankle, round(legs, 3) + 0 AS velocity, down AS hands_down, hand_step FROM ph")
def pose_phases(spark, sf_dir):
    """SIG1-6, SEG1-3."""
    frames = classified(spark, sf_dir)
    out = frames.select("clip_id", "frame_idx", "phase", F.col("hold_id").cast("long").alias("hold_id"), "known", "unknown_reason", F.round("v_ankle", 4).alias("v_ankle"), F.round("velocity", 3).alias("velocity"), "hands_down", "hand_step")
    return out


@checked(3, "SELECT clip AS clip_id, " + ", ".join(f"count(*) FILTER (phase = '{p}') AS {p}" for p in ("pre", "kickup", "hold", "exit", "post", "unknown")) + " FROM ph GROUP BY clip")
def pose_phase_counts(spark, sf_dir):
    """AGG9."""
    return pose.phase_counts(classified(spark, sf_dir))


@checked(4, "SELECT clip AS clip_id, frame AS frame_idx, hold_id, valid, " + ", ".join(f"round({f}, 3) + 0 AS {f}" for f in NAMED) + ", facing::INT AS facing_sign, round(com_forward, 4) + 0 AS com_forward, zone AS balance_zone FROM ft")
def pose_features(spark, sf_dir):
    """GEO1-21."""
    rows = rounded(measured(spark, sf_dir), *NAMED, digits=3)
    return rows.select("clip_id", "frame_idx", F.col("hold_id").cast("long").alias("hold_id"), "valid", *NAMED, F.col("facing_sign").cast("int").alias("facing_sign"), F.round("com_forward", 4).alias("com_forward"), "balance_zone")


BALANCE = ["forward_median", "sway_sd", "sway_range", "speed_rms"]
SUMMED = [*(f"{f}_{k}" for f in NAMED for k in ("median", "iqr")), "hip_angle_sd", "shoulder_angle_sd", "pct_over", "pct_under"]


@checked(5, "SELECT clip AS clip_id, hold_id, start_ms, end_ms, frames, valid_frames, shape, " + ", ".join(f"round({c}, 4) + 0 AS {c}" for c in (*SUMMED, *BALANCE)) + " FROM hs")
def pose_holds(spark, sf_dir):
    """AGG1-4, SHP1."""
    out = pose.hold_summary(measured(spark, sf_dir))
    return rounded(out, *SUMMED, *BALANCE).select("clip_id", F.col("hold_id").cast("long").alias("hold_id"), "start_ms", "end_ms", "frames", "valid_frames", "shape", *SUMMED, *BALANCE)


@checked(5, "SELECT clip AS clip_id, hold_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY end_ms - start_ms DESC, hold_id) AS rank FROM hs WHERE shape = 'line' AND end_ms - start_ms >= 2000)")
def pose_line_windows(spark, sf_dir):
    """SEG14, SHP2."""
    out = pose.line_windows(pose.hold_summary(measured(spark, sf_dir)))
    return out.select("clip_id", F.col("hold_id").cast("long").alias("hold_id"), F.col("rank").cast("long").alias("rank"))


def straight() -> Column:
    """Whether a clip tells the story that the reference is made of."""
    return F.col("clip_id") % len(NAMES) == 0


def own_reference(values: DataFrame) -> dict[str, tuple[float, float]]:
    """ORC7: mean and population SD of every feature over the scored holds of the straight story."""
    good = values.where(straight() & (F.col("valid_frames") >= RULES.least_frames))
    return scoring.reference_columns(stats.reference_stats(good, RULES.features, least=1, population=True), RULES)


@checked(
    6,
    """, tf AS (SELECT clip, hold_id, feature, row_number() OVER (PARTITION BY clip, hold_id ORDER BY w * abs(z) / size DESC, ord) AS r FROM zz WHERE grp <> '')
SELECT sc.clip AS clip_id, sc.hold_id, valid_frames, score, reason, round(deviation, 4) AS deviation, round(penalty, 4) AS penalty, feature AS worst FROM sc LEFT JOIN tf ON tf.clip = sc.clip AND tf.hold_id = sc.hold_id AND r = 1""",
)
def pose_scores(spark, sf_dir):
    """ORC7-9, SCO1-6."""
    values = settled(scoring.hold_values(measured(spark, sf_dir).where("hold_id >= 0"), ["clip_id", "hold_id"], "t_ms", RULES))
    out = scoring.score_holds(values, own_reference(values), RULES)
    return out.select("clip_id", F.col("hold_id").cast("long").alias("hold_id"), "valid_frames", "score", "reason", F.round("deviation", 4).alias("deviation"), F.round("penalty", 4).alias("penalty"), F.get("top_faults", F.lit(0))["feature"].alias("worst"))


_MEASURED = list(scoring.JUDGED)


@checked(
    6,
    f""", fv AS (UNPIVOT (SELECT clip, frame, hold_id, {', '.join(f'{_SIGNED(f)} AS {f}' for f in _MEASURED)} FROM ft WHERE hold_id >= 0 AND valid) ON {', '.join(_MEASURED)} INTO NAME feature VALUE v),
sv AS (SELECT clip, frame, max(least(1.0, abs(v - mean) / greatest(sd, floor_) / 4)) AS s FROM fv JOIN rf USING (feature) JOIN pl USING (feature) GROUP BY ALL)
SELECT clip AS clip_id, CASE WHEN s < 0.25 THEN 'ok' WHEN s < 0.5 THEN 'warn' ELSE 'bad' END AS band, count(*) AS frames, round(max(s), 4) AS worst FROM sv GROUP BY ALL""",
)
def pose_severity(spark, sf_dir):
    """SCO13-16."""
    frames = settled(measured(spark, sf_dir))
    values = scoring.hold_values(frames.where("hold_id >= 0"), ["clip_id", "hold_id"], "t_ms", RULES)
    marked = scoring.frame_severities(frames, own_reference(values), RULES).where("severity is not null")
    return marked.groupBy("clip_id", "band").agg(F.count(F.lit(1)).alias("frames"), F.round(F.max("severity"), 4).alias("worst"))


@checked(
    1,
    f""", oc AS (SELECT name AS cs, n AS frame, CASE WHEN name = 'vfr_timestamps' THEN coalesce(sum(60 + 37 * n % 101) OVER (PARTITION BY name ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ELSE 100 * n END::BIGINT AS t_ms,
  CASE name WHEN 'steady_inverted' THEN 0.6 WHEN 'nan_gaps' THEN CASE WHEN n BETWEEN 20 AND 23 OR n BETWEEN 40 AND 49 THEN NULL WHEN n < 50 THEN 0.6 ELSE 0.99 END ELSE 0.9 END::DOUBLE AS u,
  CASE name WHEN 'steady_inverted' THEN 0.9 WHEN 'one_frame_misread' THEN CASE n WHEN 12 THEN 0.99 ELSE 0.6 END WHEN 'sustained_switch' THEN CASE WHEN n < 10 THEN 0.6 ELSE 0.99 END WHEN 'vfr_timestamps' THEN CASE WHEN n < 15 THEN 0.6 ELSE 0.99 END
    WHEN 'nan_gaps' THEN CASE WHEN n BETWEEN 20 AND 23 OR n BETWEEN 40 AND 49 THEN NULL WHEN n < 50 THEN 0.9 ELSE 0.6 END ELSE 0.6 END::DOUBLE AS r FROM unnest({list(clips.ORIENTATION_STORIES)}) q(name), range(70) p(n) WHERE n < CASE name WHEN 'nan_gaps' THEN 70 ELSE 40 END),
os AS (SELECT s_suppkey::BIGINT AS clip, {list(clips.ORIENTATION_STORIES)}[s_suppkey % 6 + 1] AS cs, s_nationkey AS seed FROM supplier),
od AS (SELECT clip, cs, frame, t_ms, u, r, sqrt(-2 * ln((('0x' || substr(h, 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)) AS size, 2 * pi() * ((('0x' || substr(h, 9, 8))::BIGINT + 0.5::DOUBLE) / 4294967296) AS turn FROM (SELECT *, md5(seed || ':' || clip || ':' || frame || ':score') AS h FROM os JOIN oc USING (cs))),
om AS (SELECT clip, cs, frame, t_ms, round(u + 0.004 * (size * cos(turn)), 6) AS u, round(r + 0.004 * (size * sin(turn)), 6) AS r FROM od),
sm AS (SELECT *, avg(r - u) OVER (PARTITION BY clip ORDER BY t_ms RANGE BETWEEN 250 PRECEDING AND 250 FOLLOWING) AS m, row_number() OVER (PARTITION BY clip ORDER BY t_ms, frame) AS n FROM om),
op AS (SELECT clip, coalesce(avg(m) FILTER (t_ms <= 500) > 0, false) AS opens FROM sm GROUP BY clip),
sw2 AS (SELECT clip, 0::BIGINT AS n, NULL::VARCHAR AS cs, NULL::BIGINT AS frame, NULL::DOUBLE AS m, opens AS rotated, NULL::BIGINT AS since FROM op
  UNION ALL SELECT clip, n, cs, frame, m, CASE WHEN a AND t_ms - since >= 300 THEN NOT rotated ELSE rotated END, CASE WHEN NOT a THEN NULL WHEN since IS NULL THEN t_ms WHEN t_ms - since >= 300 THEN NULL ELSE since END FROM (
    SELECT sm.*, sw2.rotated, sw2.since, coalesce(abs(sm.m) > 0.05 AND (sm.m > 0) <> sw2.rotated, false) AS a FROM sw2 JOIN sm ON sm.clip = sw2.clip AND sm.n = sw2.n + 1))
SELECT clip AS clip_id, cs AS case_name, frame AS frame_idx, round(m, 9) + 0 AS smoothed, rotated FROM sw2 WHERE n > 0""",
)
def orientation_cases(spark, sf_dir):
    """ORC9, ORI5-8: the six stories of an orientation chooser, one for each supplier."""
    key = F.col("s_suppkey").cast("long")
    case = F.element_at(F.array(*map(F.lit, clips.ORIENTATION_STORIES)), (key % len(clips.ORIENTATION_STORIES) + 1).cast("int"))
    drawn = clips.orientation_clips(table(spark, sf_dir, "supplier").select(key.alias("clip_id"), case.alias("case"), F.col("s_nationkey").alias("seed")))
    chosen = matching.choose_orientations(drawn, ["clip_id"], "t_ms", "frame_idx", "score_upright", "score_rotated")
    return chosen.select("clip_id", F.col("case").alias("case_name"), "frame_idx", F.round("smoothed", 9).alias("smoothed"), "rotated")


def pictured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``measured`` with the places in the picture."""
    return pose.pictured(pose.body_features(classified(spark, sf_dir), keep=("body", "body_length")))


_PART = lambda f: "max(s) FILTER (feature IN (" + ", ".join(f"'{x}'" for x in f) + "))" if f else "NULL::DOUBLE"
_COLOUR = lambda s: f"CASE WHEN NOT measured THEN 'neutral' WHEN ({s}) IS NULL THEN 'ok' WHEN ({s}) < 0.25 THEN 'ok' WHEN ({s}) < 0.5 THEN 'warn' ELSE 'bad' END"
_BONE = lambda a, b, also="true": f"CASE WHEN {a}_x IS NOT NULL AND {b}_x IS NOT NULL AND {also} THEN '{a}-{b}:' || {_COLOUR('list_max([s_' + a.split('_', 1)[-1] + ', s_' + b.split('_', 1)[-1] + '])')} END"
_NEAR = "coalesce(sqrt((nose_x - left_shoulder_x) ** 2 + (nose_y - left_shoulder_y) ** 2) <= sqrt((nose_x - right_shoulder_x) ** 2 + (nose_y - right_shoulder_y) ** 2), left_shoulder_x IS NOT NULL)"


@checked(
    6,
    f""", fv AS (UNPIVOT (SELECT clip, frame, {', '.join(f'{_SIGNED(f)} AS {f}' for f in _MEASURED)} FROM ft WHERE hold_id >= 0 AND valid) ON {', '.join(_MEASURED)} INTO NAME feature VALUE v),
fz AS (SELECT clip, frame, feature, least(1.0, abs(v - mean) / greatest(sd, floor_) / 4) AS s FROM fv JOIN rf USING (feature) JOIN pl USING (feature)),
pv AS (SELECT clip, frame, {', '.join(f'{_PART(f)} AS s_{p}' for p, f in scoring.JOINT_FEATURES.items())}, {_PART(scoring.STACK_FEATURES)} AS s_stack FROM fz GROUP BY clip, frame),
cv AS (SELECT clip, frame, ({' + '.join(f'coalesce(({v}) * {m}, 0)' for u, v, m in _mass())}) / nullif({' + '.join(f'CASE WHEN ({v}) IS NULL THEN 0 ELSE {m}::DOUBLE END' for u, v, m in _mass())}, 0) AS com_v FROM bf),
dg AS (SELECT ph.*, ft.hold_id >= 0 AND coalesce(ft.valid, false) AS measured, com_u, com_v, zone, pv.* EXCLUDE (clip, frame) FROM ph JOIN ft USING (clip, frame) JOIN cv USING (clip, frame) LEFT JOIN pv USING (clip, frame))
SELECT clip AS clip_id, frame AS frame_idx, t_ms, hold_id >= 0 AS in_hold, {' + '.join(f'({j}_x IS NOT NULL)::INT' for j in JOINTS)} AS n_joints,
  concat_ws(' ', {', '.join(_BONE(a, b) for a, b in diagram.BONES)}, {_BONE('nose', 'left_shoulder', _NEAR)}, {_BONE('nose', 'right_shoulder', f'NOT {_NEAR}')}) AS bones,
  round(wrist_x, 3) + 0 AS stack_x, {_COLOUR('s_stack')} AS stack_band, round(wrist_x + com_u * len, 3) + 0 AS com_x, round(wrist_y - com_v * len, 3) + 0 AS com_y, zone AS balance_zone FROM dg""",
)
def pose_diagram(spark, sf_dir):
    """SCO14, SCO17."""
    # the reference needs a fifth of the clips: to make these twice takes less than to store all frames and read them again
    good = scoring.hold_values(pose.body_features(classified(spark, sf_dir, straight())).where("hold_id >= 0"), ["clip_id", "hold_id"], "t_ms", RULES)
    sizes = scoring.severities(own_reference(good), RULES)
    frames = pose.body_features(classified(spark, sf_dir), keep=("body", "body_length"))
    return rounded(diagram.diagram_words(frames, sizes), "stack_x", "com_x", "com_y", digits=3)


_ACROSS_T = lambda p: f"abs((left_{p}_x - right_{p}_x) * ty - (left_{p}_y - right_{p}_y) * tx)"


@checked(
    6,
    f""", vt AS (SELECT ph.*, ft.valid AS seen, {', '.join(f'(left_hip_{c} + right_hip_{c}) / 2 - (left_shoulder_{c} + right_shoulder_{c}) / 2 AS t{c}' for c in 'xy')} FROM ph JOIN ft USING (clip, frame) WHERE ph.hold_id >= 0),
vw AS (SELECT clip, hold_id, min(t_ms) AS a, max(t_ms) AS b, count(w) FILTER (seen) AS many, median(w) FILTER (seen) AS w FROM (SELECT *, ({_ACROSS_T('shoulder')} + {_ACROSS_T('hip')}) / sqrt(tx ** 2 + ty ** 2) / 2 / len AS w FROM vt) GROUP BY ALL),
an AS (SELECT vw.*, score, b - a AS span, many >= 15 AND w >= 0.036 AS other FROM vw JOIN sc USING (clip, hold_id))
SELECT sup.clip AS clip_id, count(an.clip) AS holds, count(score) AS scored, arg_min(hold_id, (-span, hold_id)) FILTER (score IS NOT NULL) AS clip_hold, arg_min(score, (-span, hold_id)) FILTER (score IS NOT NULL) AS clip_score,
  arg_min(score, (-span, hold_id)) FILTER (score IS NOT NULL AND NOT other) AS side_score, coalesce(bool_and(other) FILTER (score IS NOT NULL), false) AS not_side_only FROM sup LEFT JOIN an ON an.clip = sup.clip GROUP BY sup.clip""",
)
def pose_analysis(spark, sf_dir):
    """SCO5, SCO21-23, SHP4-6."""
    measures = settled(pose.hold_measures(pictured(spark, sf_dir), RULES))
    holds = pose.analysed_holds(measures, own_reference(measures), RULES)
    out = pose.analysed_clips(seeds(spark, sf_dir).select("clip_id"), holds)
    return out.withColumn("clip_hold", F.col("clip_hold").cast("long"))
