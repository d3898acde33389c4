"""DuckDB SQL of the registered queries, built from common table expressions."""

from __future__ import annotations

from tracewheel.functions.names import CATEGORIES, CONFIG_PATTERNS, CONFIG_SUFFIXES, OTHER
from tracewheel.plans.queries import BASELINE, CHANGED, EDGE_NAMES
from tracewheel.plans.traces import FILE_EVENTS
from tracewheel.sources.cycle_csv import HEADER, LABELS
from tracewheel.sources.reports import COLUMNS


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _signature(source: str, out: str, hashed: bool = True) -> str:
    """CTEs that turn ``source`` (name) into ``out`` (name, sig), a step at a time."""
    steps = ["CASE WHEN instr(s, '<') > 1 THEN substr(s, 1, instr(s, '<') - 1) ELSE s END"]
    steps += [f"CASE WHEN instr(s, '{p}') > 1 THEN substr(s, 1, instr(s, '{p}') - 1) ELSE s END" for p in CONFIG_PATTERNS]
    steps += ["regexp_replace(s, '_[0-9]+x[0-9]+$', '')"]
    steps += [f"regexp_replace(s, '^(.+){p}.*$', '\\1', 's')" for p in CONFIG_SUFFIXES]
    steps += ["CASE WHEN length(s) > 2 THEN regexp_replace(s, '^(.+?)(?:_[0-9])+$', '\\1', 's') ELSE s END", "regexp_replace(s, '_+$', '')"]
    ctes = [f"{out}0 AS (SELECT name, name AS s FROM (SELECT DISTINCT name FROM {source}))"]
    ctes += [f"{out}{k} AS (SELECT name, {step} AS s FROM {out}{k - 1})" for k, step in enumerate(steps, 1)]
    other = f"'other_' || CAST({_FNV} AS VARCHAR)" if hashed else "'other'"
    ctes.append(f"{out} AS (SELECT name, CASE WHEN strlen(s) < 3 THEN {other} ELSE s END AS sig FROM {out}{len(steps)})")
    return ",\n".join(ctes)


_FNV = "CAST(list_reduce(list_transform(range(1, length(name) + 1), lambda i: CAST(unicode(substr(name, i, 1)) AS UHUGEINT)), lambda a, b: (CAST(xor(CAST(a AS UBIGINT), CAST(b AS UBIGINT)) AS UHUGEINT) * 1099511628211) % 18446744073709551616::UHUGEINT, 14695981039346656037::UHUGEINT) % 1000 AS BIGINT)"

TRACE = """
l AS (SELECT l_extendedprice AS p, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) - 1 AS seq, count(*) OVER () AS n FROM lineitem),
b AS (SELECT seq, p, CAST(floor(n * 2 / 5) AS BIGINT) AS split FROM l),
m AS (SELECT seq, p, CASE WHEN seq < 7 THEN 'w' WHEN seq < split THEN 'p' ELSE 'd' END AS ph, CASE WHEN seq < 7 THEN 150 + seq WHEN seq < split THEN (seq - 7) % 24 ELSE 100 + (seq - split) % 17 END AS k FROM b),
e AS MATERIALIZED (SELECT seq, CASE WHEN ph = 'p' THEN concat('layer_', CAST(k % 6 AS VARCHAR), 'op<', p_brand, ',', CAST(p_partkey AS VARCHAR), '>')
             ELSE concat(replace(p_name, ' ', '_'), '_op', CAST(p_partkey AS VARCHAR), 'x<', p_brand, '>') END AS name,
             round((p_size + 1) * (1 + (p / 1000 - floor(p / 1000)) * 0.02), 6) AS dur FROM m JOIN part ON p_partkey = k),
n AS (SELECT count(*) AS n FROM e)"""

NAMES = "a AS (SELECT name FROM e UNION SELECT * FROM (VALUES " + ", ".join(f"({_quoted(x)})" for x in EDGE_NAMES) + ") AS v(name))"

ANCHORS = """
c AS (SELECT name, count(*) AS cnt FROM e GROUP BY name),
k AS (SELECT name, cnt FROM c, n WHERE cnt >= 5 AND cnt <= n // 5),
g AS (SELECT name, seq, seq - lag(seq) OVER (PARTITION BY name ORDER BY seq) AS gap FROM e WHERE name IN (SELECT name FROM k)),
f AS (SELECT name, min(seq) AS start, arg_min(gap, seq) AS cycle_len, min(gap) AS low, max(gap) AS high FROM g GROUP BY name),
s AS MATERIALIZED (SELECT f.name, cnt, start, cycle_len FROM f JOIN k USING (name) WHERE cycle_len >= 10
      AND low >= cycle_len - greatest(1, cycle_len // 5) AND high <= cycle_len + greatest(1, cycle_len // 5))"""

REPS = """
r AS (SELECT s.name AS anchor, s.start, s.cycle_len, s.cnt, (e.seq - s.start) // s.cycle_len AS rep, (e.seq - s.start) % s.cycle_len AS off, e.name FROM s JOIN e ON e.seq >= s.start),
t AS (SELECT anchor, off, name AS first FROM r WHERE rep = 0),
q AS MATERIALIZED (SELECT anchor, start, cycle_len, cnt, rep, count(*) AS present, count(*) FILTER (WHERE name = first) AS matched FROM r JOIN t USING (anchor, off) GROUP BY ALL),
y AS MATERIALIZED (SELECT anchor, start, cycle_len, rep, start + rep * cycle_len AS inst, cnt FROM q WHERE present = cycle_len AND rep < cnt AND matched >= 0.95 * cycle_len),
v AS MATERIALIZED (SELECT anchor, start, cycle_len, any_value(cnt) AS cnt, count(*) AS reps FROM y GROUP BY anchor, start, cycle_len HAVING count(*) >= 5)"""

OUTER = """
o AS MATERIALIZED (SELECT * FROM v WHERE cnt >= 6 ORDER BY reps DESC, cnt DESC, anchor LIMIT 1),
i AS MATERIALIZED (SELECT inst FROM y WHERE anchor = (SELECT anchor FROM o)),
p AS (SELECT e.seq - i.inst AS index, e.name, e.dur, i.inst FROM (SELECT inst, unnest(range(0, (SELECT cycle_len FROM o))) AS off FROM i) AS i JOIN e ON e.seq = i.inst + i.off),
z AS MATERIALIZED (SELECT CAST(index AS BIGINT) AS index, arg_min(name, inst) AS name, avg(dur) AS avg_dur, min(dur) AS min_dur, max(dur) AS max_dur, stddev_pop(dur) AS stddev, count(*) AS cnt, sum(dur) AS total_dur FROM p GROUP BY index),
h AS (SELECT cycle_len, reps, (SELECT sum(total_dur) FROM z) / reps AS avg_cycle_time, (SELECT sum(total_dur) FROM z) AS total_time FROM o)"""

SAMPLE = """
i2 AS (SELECT start + r * cycle_len AS inst, cycle_len FROM (SELECT start, cycle_len, unnest(range(0, reps)) AS r FROM o)),
p2 AS (SELECT off AS index, e.name, e.dur, inst FROM (SELECT inst, unnest(range(0, cycle_len)) AS off FROM i2) AS x JOIN e ON e.seq = inst + off),
z2 AS (SELECT CAST(index AS BIGINT) AS index, arg_min(name, inst) AS name, avg(dur) AS avg_dur, min(dur) AS min_dur, max(dur) AS max_dur, coalesce(stddev_samp(dur), 0) AS stddev, count(*) AS cnt FROM p2 GROUP BY index)"""

SUBS = (
    _signature("e", "sg")
    + """,
tm AS MATERIALIZED (SELECT anchor, start, cycle_len, off, sig FROM (SELECT anchor, start, cycle_len, unnest(range(0, cycle_len)) AS off FROM v) JOIN e ON e.seq = start + off JOIN sg USING (name)),
tg AS (SELECT *, off - lag(off) OVER (PARTITION BY anchor, sig ORDER BY off) AS gap FROM tm WHERE cycle_len > 20),
tf AS MATERIALIZED (SELECT anchor, cycle_len, sig, count(*) AS n, min(off) AS p0, arg_min(gap, off) AS l2, list(off ORDER BY off) AS offsets FROM tg GROUP BY anchor, cycle_len, sig
       HAVING count(*) >= 3 AND arg_min(gap, off) >= 5 AND arg_min(gap, off) < cycle_len // 2
          AND min(gap) >= arg_min(gap, off) - greatest(1, arg_min(gap, off) // 10) AND max(gap) <= arg_min(gap, off) + greatest(1, arg_min(gap, off) // 10)),
ts AS (SELECT tf.anchor, tf.sig, l2, (x.off - p0) // l2 AS step, count(*) FILTER (WHERE x.sig = w.sig) AS same
       FROM tf JOIN tm x ON x.anchor = tf.anchor AND x.off >= p0 JOIN tm w ON w.anchor = tf.anchor AND w.off = x.off + l2
       WHERE p0 + ((x.off - p0) // l2) * l2 + l2 < tf.cycle_len GROUP BY ALL),
tk AS (SELECT anchor, sig FROM ts WHERE same >= 0.8 * l2 GROUP BY anchor, sig HAVING count(*) >= 3),
sb AS MATERIALIZED (SELECT anchor, p0 AS sub_start, l2 AS sub_len, offsets FROM (SELECT tf.*, row_number() OVER (PARTITION BY anchor ORDER BY l2, p0) AS rn FROM tf JOIN tk USING (anchor, sig)) WHERE rn = 1)"""
)

GROUPS = """
pt AS (SELECT v.anchor, v.cnt, v.start + coalesce(sub_start, 0) AS start, coalesce(sub_len, v.cycle_len) AS cycle_len, v.reps * coalesce(len(offsets), 1) AS reps,
              (SELECT max(inst) FROM y WHERE y.anchor = v.anchor) + coalesce(offsets[-1], 0) AS last FROM v LEFT JOIN sb USING (anchor)),
pg AS (SELECT anchor, string_agg(sig, '|' ORDER BY off) AS signature FROM (SELECT anchor, start, unnest(range(0, least(cycle_len, 10))) AS off FROM pt) JOIN e ON e.seq = start + off JOIN sg USING (name) GROUP BY anchor),
pa AS (SELECT pt.*, CASE WHEN start + cycle_len <= n THEN signature ELSE '' END AS signature, last + cycle_len AS end_pos, (start + last + cycle_len) / 2.0 AS center FROM pt JOIN pg USING (anchor), n),
gr AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY reps DESC, cnt DESC, anchor) AS rn FROM pa) WHERE rn = 1),
od AS MATERIALIZED (SELECT row_number() OVER (ORDER BY center, start, cycle_len, signature) AS k, anchor, start, cycle_len, CAST(reps AS BIGINT) AS reps, signature, end_pos, center FROM gr),
wt AS (SELECT k, sig, sum(dur) AS d FROM (SELECT k, start, unnest(range(0, cycle_len)) AS off FROM od) JOIN e ON e.seq = start + off JOIN sg USING (name) GROUP BY k, sig),
ww AS MATERIALIZED (SELECT k, sig, d / sum(d) OVER (PARTITION BY k) * 100 AS w FROM wt),
lo AS (SELECT a.k AS l, b.k AS r, sum(least(a.w, b.w)) AS low FROM ww a JOIN ww b ON a.sig = b.sig AND a.k <> b.k GROUP BY a.k, b.k),
tt AS (SELECT k, sum(w) AS t FROM ww GROUP BY k),
sm AS MATERIALIZED (SELECT l, r, low / (a.t + b.t - low) AS sim FROM lo JOIN tt a ON a.k = l JOIN tt b ON b.k = r),
nr AS MATERIALIZED (SELECT l AS k, list(r) AS near FROM sm JOIN od a ON a.k = l JOIN od b ON b.k = r WHERE sim >= 0.8 AND abs(a.cycle_len - b.cycle_len) <= greatest(a.cycle_len, b.cycle_len) // 5 GROUP BY l),
ld AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS leaders, CAST(0 AS BIGINT) AS leader
       UNION ALL SELECT od.k, CASE WHEN len(list_filter(leaders, lambda x: list_contains(coalesce(near, []), x))) > 0 THEN leaders ELSE list_append(leaders, od.k) END,
                        coalesce(list_filter(leaders, lambda x: list_contains(coalesce(near, []), x))[1], od.k)
       FROM ld JOIN od ON od.k = ld.k + 1 LEFT JOIN nr ON nr.k = od.k),
pp AS MATERIALIZED (SELECT * EXCLUDE (rn) FROM (SELECT od.*, row_number() OVER (PARTITION BY leader ORDER BY reps DESC, od.k) AS rn FROM od JOIN ld ON ld.k = od.k) WHERE rn = 1)"""

COMPARED = (
    "sh AS (SELECT CAST(1 AS BIGINT) AS pair_id, side, CAST(pos AS BIGINT) AS pos, name, CAST(pos + 1 AS DOUBLE) AS avg_dur FROM (VALUES "
    + ", ".join(f"('{s}', {k}, {_quoted(n)})" for s, names in (("baseline", BASELINE), ("new", CHANGED)) for k, n in enumerate(names))
    + """) AS x(side, pos, name)),
kb AS (SELECT CAST(2 AS BIGINT) AS pair_id, 'baseline' AS side, index AS pos, name, avg_dur FROM z),
kn AS (SELECT CAST(2 AS BIGINT) AS pair_id, 'new' AS side, row_number() OVER (ORDER BY (index + 5) % (SELECT count(*) FROM z)) - 1 AS pos, CASE WHEN index % 4 = 0 THEN name || '<v2>' ELSE name END AS name, avg_dur * (0.9 + index * 0.02) AS avg_dur FROM z WHERE index % 6 <> 5),
ck AS MATERIALIZED (SELECT * FROM sh UNION ALL SELECT * FROM kb UNION ALL SELECT * FROM kn),
"""
    + _signature("ck", "cs")
    + """,
kk AS MATERIALIZED (SELECT ck.*, sig FROM ck JOIN cs USING (name)),
kw AS (SELECT pair_id, side, sig, sum(w) AS w FROM (SELECT *, avg_dur / sum(avg_dur) OVER (PARTITION BY pair_id, side) * 100 AS w FROM kk) GROUP BY ALL),
kl AS (SELECT a.pair_id AS l, b.pair_id AS r, sum(least(a.w, b.w)) AS low FROM kw a JOIN kw b ON a.sig = b.sig AND a.side = 'baseline' AND b.side = 'new' GROUP BY a.pair_id, b.pair_id),
ks AS (SELECT l, r, low / (200 - low) AS sim FROM kl)"""
)

# Greedy matching by signature: one step a kernel of the new side, over the list of baseline positions already used.
GREEDY = """
bl AS (SELECT pair_id, list({'pos': pos, 'name': name, 'sig': sig} ORDER BY pos) AS base FROM kk WHERE side = 'baseline' GROUP BY pair_id),
nl AS MATERIALIZED (SELECT pair_id, pos, name, sig FROM kk WHERE side = 'new'),
gs AS (SELECT pair_id, CAST(-1 AS BIGINT) AS pos, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS hit FROM bl
       UNION ALL SELECT pair_id, pos, CASE WHEN hit IS NULL THEN used ELSE list_append(used, hit) END, hit FROM (
         SELECT gs.pair_id, nl.pos, used, coalesce(list_filter(base, lambda x: x.name = nl.name AND NOT list_contains(used, x.pos))[1].pos, list_filter(base, lambda x: x.sig = nl.sig AND NOT list_contains(used, x.pos))[1].pos) AS hit
         FROM gs JOIN nl ON nl.pair_id = gs.pair_id AND nl.pos = gs.pos + 1 JOIN bl ON bl.pair_id = gs.pair_id)),
mm AS (SELECT nl.pair_id, 0 AS part, nl.pos AS place, coalesce(bk.name, '') AS baseline, nl.name AS new, CASE WHEN hit IS NULL THEN 'new_only' WHEN bk.name = nl.name THEN 'exact' ELSE 'similar' END AS match_type, nl.sig,
              coalesce(bk.avg_dur, 0) AS base_avg, nk.avg_dur AS new_avg, bk.pos AS base_pos, nl.pos AS new_pos
       FROM gs JOIN nl ON nl.pair_id = gs.pair_id AND nl.pos = gs.pos JOIN kk nk ON nk.pair_id = nl.pair_id AND nk.side = 'new' AND nk.pos = nl.pos LEFT JOIN kk bk ON bk.pair_id = gs.pair_id AND bk.side = 'baseline' AND bk.pos = hit
       UNION ALL SELECT kk.pair_id, 1, pos, name, '.', 'removed', sig, avg_dur, 0, pos, NULL FROM kk WHERE side = 'baseline' AND NOT EXISTS (SELECT 1 FROM gs WHERE gs.pair_id = kk.pair_id AND gs.hit = kk.pos)),
mo AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY part, place) - 1 AS ord, CASE WHEN base_avg > 0 AND new_avg > 0 THEN (new_avg - base_avg) / base_avg * 100 END AS change_pct FROM mm)"""

ROTATIONS = """
sq AS (SELECT pair_id, list(sig ORDER BY pos) FILTER (WHERE side = 'baseline') AS a, list(sig ORDER BY pos) FILTER (WHERE side = 'new') AS b FROM kk GROUP BY pair_id),
rt AS MATERIALIZED (SELECT pair_id, r, list_concat(a[r + 1:], a[:r]) AS a, b FROM (SELECT pair_id, a, b, unnest(range(0, len(a))) AS r FROM sq)),
lc AS (SELECT pair_id, r, CAST(0 AS BIGINT) AS i, list_transform(range(0, len(b) + 1), lambda j: CAST(0 AS BIGINT)) AS row FROM rt
       UNION ALL SELECT pair_id, r, i, list_transform(range(1, len(cand) + 1), lambda j: list_max(cand[1:j])) FROM (
         SELECT lc.pair_id, lc.r, lc.i + 1 AS i, list_concat([CAST(0 AS BIGINT)], list_transform(range(1, len(b) + 1), lambda j: greatest(row[j + 1], CASE WHEN b[j] = a[lc.i + 1] THEN row[j] + 1 ELSE 0 END))) AS cand
         FROM lc JOIN rt ON rt.pair_id = lc.pair_id AND rt.r = lc.r WHERE lc.i < len(a))),
le AS (SELECT pair_id, r, row[-1] AS lcs, row_number() OVER (PARTITION BY pair_id ORDER BY row[-1] DESC, r) AS rn FROM (SELECT pair_id, r, arg_max(row, i) AS row FROM lc GROUP BY pair_id, r))"""

KMERS = """
k3 AS (SELECT a.seq, a.name || '|' || b.name || '|' || c.name AS kmer FROM e a JOIN e b ON b.seq = a.seq + 1 JOIN e c ON c.seq = a.seq + 2),
kg AS (SELECT kmer, seq, seq - lag(seq) OVER (PARTITION BY kmer ORDER BY seq) AS gap FROM k3),
kf AS (SELECT kmer, arg_min(gap, seq) AS cycle_len, min(seq) AS start, count(*) AS p FROM kg GROUP BY kmer HAVING count(*) >= 5),
ka AS MATERIALIZED (SELECT kf.kmer, start, cycle_len, count(*) FILTER (WHERE abs(gap - cycle_len) <= greatest(1, cycle_len // 10)) - 1 AS score, any_value(p) AS p FROM kf JOIN kg USING (kmer) WHERE cycle_len >= 10 GROUP BY kf.kmer, start, cycle_len
       HAVING count(*) FILTER (WHERE abs(gap - cycle_len) <= greatest(1, cycle_len // 10)) - 1 >= 0.8 * (any_value(p) - 1))"""

# Candidates (cid, start, len) of the CTE ``source``: the first repetition that does not match, or one past the last.
def _consecutive(source: str, out: str, ratio: str) -> str:
    return f"""
{out}_t AS (SELECT cid, off, e.name AS first FROM (SELECT cid, start, unnest(range(0, len)) AS off FROM {source}) JOIN e ON e.seq = start + off),
{out}_q AS (SELECT cid, len, rep, count(*) AS present, count(*) FILTER (WHERE name = first) AS matched
        FROM (SELECT cid, len, (e.seq - start) // len AS rep, (e.seq - start) % len AS off, e.name FROM {source} JOIN e ON e.seq >= start) JOIN {out}_t USING (cid, off) GROUP BY cid, len, rep),
{out} AS MATERIALIZED (SELECT cid, coalesce(min(rep) FILTER (WHERE matched < {ratio} * len), max(rep) + 1) AS reps FROM {out}_q WHERE present = len GROUP BY cid)"""


# Candidates claim thousands of events in order of score; then each joins the first leader like it.
KMER_FOLD = (
    KMERS
    + """,
kv AS (SELECT kmer AS cid, start, cycle_len AS len FROM ka),"""
    + _consecutive("kv", "kr", "0.9")
    + """,
kc AS MATERIALIZED (SELECT ka.start, ka.cycle_len, reps, score, e.name, row_number() OVER (ORDER BY score DESC, ka.start) AS k FROM ka JOIN kr ON cid = kmer JOIN e ON e.seq = ka.start WHERE reps >= 5),
cl AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS used, false AS kept
       UNION ALL SELECT kc.k, CASE WHEN list_contains(used, start // 1000) THEN used ELSE list_concat(used, list_transform(range(0, (cycle_len * reps + 999) // 1000), lambda j: (start + j * 1000) // 1000)) END, NOT list_contains(used, start // 1000)
       FROM cl JOIN kc ON kc.k = cl.k + 1),
ko AS MATERIALIZED (SELECT kc.* EXCLUDE (k), row_number() OVER (ORDER BY start) AS k FROM kc JOIN cl ON cl.k = kc.k WHERE kept),
kp AS MATERIALIZED (SELECT k, list(left(e.name, 30)) AS parts FROM (SELECT k, unnest(range(start, start + least(cycle_len, 10))) AS seq FROM ko) JOIN e USING (seq) GROUP BY k),
kn AS MATERIALIZED (SELECT b.k, list(a.k) AS near FROM ko a JOIN kp x ON x.k = a.k JOIN ko b ON a.k < b.k JOIN kp y ON y.k = b.k
       WHERE abs(b.cycle_len - a.cycle_len) <= greatest(a.cycle_len // 5, 2) AND len(list_filter(x.parts, lambda p: list_contains(y.parts, p))) >= greatest(1, len(x.parts) * 8 // 10) GROUP BY b.k),
kd AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS leaders, CAST(0 AS BIGINT) AS leader
       UNION ALL SELECT ko.k, CASE WHEN len(list_filter(leaders, lambda x: list_contains(coalesce(near, []), x))) > 0 THEN leaders ELSE list_append(leaders, ko.k) END,
                        coalesce(list_filter(leaders, lambda x: list_contains(coalesce(near, []), x))[1], ko.k)
       FROM kd JOIN ko ON ko.k = kd.k + 1 LEFT JOIN kn ON kn.k = ko.k),
kb1 AS (SELECT ko.*, row_number() OVER (PARTITION BY leader ORDER BY reps DESC, ko.k) AS rn FROM ko JOIN kd ON kd.k = ko.k)"""
)

# The first four repetitions tell which candidates can count; the scan then takes the next of them and skips its cycle.
SIMPLE = """
ix AS MATERIALIZED (SELECT seq, dense_rank() OVER (ORDER BY name) AS c FROM e),
nl AS MATERIALIZED (SELECT list(c ORDER BY seq) AS c FROM ix),
sp AS (SELECT prev AS start, seq AS i, seq - prev AS len FROM (SELECT seq, lag(seq) OVER (PARTITION BY c ORDER BY seq) AS prev FROM ix) WHERE seq - prev >= 10),
sx AS (SELECT start, i, len, unnest(range(0, len)) AS off FROM sp WHERE start + 5 * len <= (SELECT n FROM n)),
sm AS (SELECT start, i, len, count(*) FILTER (WHERE a.c = b.c) AS m1, count(*) FILTER (WHERE a.c = d.c) AS m2, count(*) FILTER (WHERE a.c = f.c) AS m3, count(*) FILTER (WHERE a.c = g.c) AS m4
       FROM sx JOIN ix a ON a.seq = start + off JOIN ix b ON b.seq = start + off + len JOIN ix d ON d.seq = start + off + 2 * len JOIN ix f ON f.seq = start + off + 3 * len JOIN ix g ON g.seq = start + off + 4 * len GROUP BY start, i, len),
sv AS MATERIALIZED (SELECT start, i, len FROM sm WHERE least(m1, m2, m3, m4) >= 0.9 * len),
sr AS (SELECT CAST(0 AS BIGINT) AS at, CAST(NULL AS BIGINT) AS start, CAST(NULL AS BIGINT) AS len, CAST(NULL AS BIGINT) AS reps
       UNION ALL SELECT f.start + f.len * r, f.start, f.len, r FROM (
         SELECT f, coalesce(list_position(list_transform(range(1, (len(c) - f.start) // f.len), lambda k: list_sum(list_transform(range(1, f.len + 1), lambda j: CASE WHEN c[f.start + j] = c[f.start + k * f.len + j] THEN 1 ELSE 0 END)) >= 0.9 * f.len), false), (len(c) - f.start) // f.len) AS r
         FROM (SELECT arg_min({'start': sv.start, 'len': sv.len}, sv.i) AS f FROM sr JOIN sv ON sv.start >= sr.at, n WHERE sr.at < n.n - 20 GROUP BY sr.at), nl))"""

# Lengths around the first repeated name; a place where a name differs from the one a length later breaks a run.
EXHAUSTIVE = (
    """
fr AS (SELECT min(seq) AS f FROM (SELECT seq, row_number() OVER (PARTITION BY name ORDER BY seq) AS r FROM e) WHERE r = 2),
el AS (SELECT unnest(range(greatest(10, f - 100), least(n // 2, f + 1000) + 1)) AS len, n FROM fr, n WHERE n >= 20),
ew AS (SELECT len, el.n, x FROM (SELECT len, n, unnest(range(0, 2 * len)) AS x FROM el) AS el LEFT JOIN e a ON a.seq = x LEFT JOIN e b ON b.seq = x + len WHERE b.name IS NULL OR a.name <> b.name
       UNION ALL SELECT len, n, 2 * len FROM el),
ef AS (SELECT len, n, x, coalesce(lag(x) OVER (PARTITION BY len ORDER BY x) + 1, 0) AS start FROM ew),
eb AS (SELECT 'x' AS cid, start, len FROM ef WHERE x - start >= len AND start < least(len, n // 4) ORDER BY len, start LIMIT 1),"""
    + _consecutive("eb", "er", "1.0")
)

PROBE = (
    """
pn AS (SELECT name, count(*) AS c, min(seq) AS start FROM e, n WHERE n.n >= 30 GROUP BY name HAVING count(*) >= 5),
pg0 AS (SELECT name, gap FROM (SELECT name, seq - lag(seq) OVER (PARTITION BY name ORDER BY seq) AS gap FROM e) JOIN pn USING (name) WHERE gap BETWEEN 10 AND 5000 GROUP BY name, gap HAVING count(*) >= 4),
pc AS MATERIALIZED (SELECT pg0.name || '|' || gap AS cid, pg0.name, start, gap AS len FROM pg0 JOIN pn USING (name), n WHERE start + 3 * gap <= n.n),"""
    + _consecutive("pc", "pr", "0.9")
)

# The table of the best rotation, then the way back from its last cell.
ALIGN = """
bs AS MATERIALIZED (SELECT rt.pair_id, r, rt.a, rt.b FROM rt JOIN le USING (pair_id, r) WHERE rn = 1),
an AS MATERIALIZED (SELECT pair_id, list_concat(an[r + 1:], an[:r]) AS an, bn FROM (SELECT pair_id, list(name ORDER BY pos) FILTER (WHERE side = 'baseline') AS an, list(name ORDER BY pos) FILTER (WHERE side = 'new') AS bn FROM kk GROUP BY pair_id) JOIN bs USING (pair_id)),
lt AS MATERIALIZED (SELECT lc.pair_id, i, row FROM lc JOIN bs ON bs.pair_id = lc.pair_id AND bs.r = lc.r),
bt AS (SELECT pair_id, CAST(len(a) AS BIGINT) AS i, CAST(len(b) AS BIGINT) AS j, CAST(0 AS BIGINT) AS step, 0 AS di, 0 AS dj FROM bs
       UNION ALL SELECT pair_id, i - di, j - dj, step + 1, di, dj FROM (
         SELECT bt.pair_id, bt.i, bt.j, step, CASE WHEN bt.i > 0 AND bt.j > 0 AND a[bt.i] = b[bt.j] THEN 1 WHEN bt.j > 0 AND (bt.i = 0 OR own.row[bt.j] >= up.row[bt.j + 1]) THEN 0 ELSE 1 END AS di,
                CASE WHEN bt.j > 0 AND (bt.i = 0 OR a[bt.i] = b[bt.j] OR own.row[bt.j] >= up.row[bt.j + 1]) THEN 1 ELSE 0 END AS dj
         FROM bt JOIN bs ON bs.pair_id = bt.pair_id JOIN lt own ON own.pair_id = bt.pair_id AND own.i = bt.i LEFT JOIN lt up ON up.pair_id = bt.pair_id AND up.i = bt.i - 1 WHERE bt.i > 0 OR bt.j > 0)),
al AS (SELECT bt.pair_id, row_number() OVER (PARTITION BY bt.pair_id ORDER BY step DESC) - 1 AS ord, CASE WHEN di = 1 THEN an[i + 1] ELSE '' END AS baseline, CASE WHEN dj = 1 THEN bn[j + 1] ELSE '.' END AS new,
              CASE WHEN di = 0 THEN 'new_only' WHEN dj = 0 THEN 'removed' WHEN an[i + 1] = bn[j + 1] THEN 'exact' ELSE 'similar' END AS match_type, CASE WHEN dj = 1 THEN b[j + 1] ELSE a[i + 1] END AS sig,
              CASE WHEN di = 1 THEN (i + r) % len(a) END AS base_at, CASE WHEN dj = 1 THEN j END AS new_at
       FROM bt JOIN an ON an.pair_id = bt.pair_id JOIN bs ON bs.pair_id = bt.pair_id WHERE step > 0)"""

PAIRS = """
so AS (SELECT l, r, sim, row_number() OVER (ORDER BY sim DESC, l, r) AS k FROM ks WHERE sim >= 0.2),
sg2 AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS ls, CAST([] AS BIGINT[]) AS rs, false AS kept
       UNION ALL SELECT so.k, CASE WHEN free THEN list_append(ls, l) ELSE ls END, CASE WHEN free THEN list_append(rs, r) ELSE rs END, free FROM (
         SELECT so.k, so.l, so.r, ls, rs, NOT list_contains(ls, so.l) AND NOT list_contains(rs, so.r) AS free FROM sg2 JOIN so ON so.k = sg2.k + 1) AS so)"""

PATTERN_STATS = """
pi AS (SELECT k, cycle_len, reps, inst + unnest(offs) AS inst FROM (SELECT pp.k, pp.cycle_len, pp.reps, y.inst, coalesce(offsets, [CAST(0 AS BIGINT)]) AS offs FROM pp JOIN y ON y.anchor = pp.anchor LEFT JOIN sb ON sb.anchor = pp.anchor)),
ps AS (SELECT k, any_value(reps) AS reps, CAST(off AS BIGINT) AS index, arg_min(name, inst) AS name, avg(dur) AS avg_dur, min(dur) AS min_dur, max(dur) AS max_dur, stddev_pop(dur) AS stddev, count(*) AS cnt, sum(dur) AS total_dur
       FROM (SELECT k, reps, inst, unnest(range(0, cycle_len)) AS off FROM pi) JOIN e ON e.seq = inst + off GROUP BY k, off),
pt2 AS (SELECT k, any_value(reps) AS reps, sum(total_dur) / any_value(reps) AS mean FROM ps GROUP BY k),
pk AS (SELECT k, CAST(row_number() OVER (ORDER BY center, start, cycle_len, signature) AS INT) AS cycle_no FROM pp)"""

_FIELD = "CASE WHEN contains({0}, ',') OR contains({0}, '\"') THEN '\"' || replace({0}, '\"', '\"\"') || '\"' ELSE {0} END"
_SHARE = "avg_dur / avg_cycle_time * 100"
CSV_LINES = f"""
ln AS (SELECT CAST(1 AS BIGINT) AS line_no, '{LABELS[0]}' AS line UNION ALL SELECT 2, '{LABELS[1]},' || reps FROM h UNION ALL SELECT 3, '{LABELS[2]},' || cycle_len FROM h
       UNION ALL SELECT 4, '{LABELS[3]},' || printf('%.3f', avg_cycle_time) FROM h UNION ALL SELECT 5, '{LABELS[4]},' || printf('%.3f', total_time) FROM h UNION ALL SELECT 6, '' UNION ALL SELECT 7, '{",".join(HEADER)}'
       UNION ALL SELECT 8 + index, concat_ws(',', index, {_FIELD.format("name")}, printf('%.3f', avg_dur), printf('%.3f', min_dur), printf('%.3f', max_dur), printf('%.3f', stddev), cnt, printf('%.4f', {_SHARE})) FROM z, h)"""

COMPARE_LINES = f"""
m2 AS (SELECT * FROM mo WHERE pair_id = 2),
ln AS (SELECT CAST(1 AS BIGINT) AS line_no, 'eager_kernel,compiled_kernel,duration_us,match_type' AS line
       UNION ALL SELECT 2, concat('Total (', count(base_pos), ' eager kernels),(', count(new_pos), ' compiled kernels),', printf('%.3f', sum(new_avg)), ',') FROM m2
       UNION ALL SELECT 3 + ord, concat_ws(',', {_FIELD.format("baseline")}, {_FIELD.format("new")}, CASE WHEN new = '.' THEN '' ELSE printf('%.3f', new_avg) END, match_type) FROM m2)"""

# The short cycles: minimum, maximum and deviation of every kernel are 0.5, 9 and 0.1.
CELLS = f"""
m1 AS (SELECT ord + 3 AS row, *, base_avg > 0 AS hb, new <> '.' AND new_avg > 0 AS hn,
              CASE WHEN match_type = 'new_only' THEN 'neutral' WHEN match_type = 'removed' THEN 'improved' WHEN change_pct < -5 THEN 'improved' WHEN change_pct > 5 THEN 'regressed' ELSE 'neutral' END AS cls FROM mo WHERE pair_id = 1),
cc AS (SELECT CAST(1 AS BIGINT) AS row, col, value, 'header' AS style FROM (VALUES {", ".join(f"('{chr(65 + k)}', {_quoted(h)})" for k, (h, _) in enumerate(COLUMNS))}) AS v(col, value)
       UNION ALL SELECT 2, 'A', concat('Baseline: ', count(base_pos), ' kernels × 3 iters, 21.0 µs/cycle'), '' FROM m1
       UNION ALL SELECT 2, 'F', concat('New: ', count(new_pos), ' kernels × 4 iters, 20.0 µs/cycle'), '' FROM m1
       UNION ALL SELECT 2, 'G', printf('%.3f', sum(new_avg)), '' FROM m1 UNION ALL SELECT 2, 'K', '-4.800', 'neutral'
       UNION ALL SELECT row, u.col, u.value, CASE WHEN u.col = 'K' THEN cls ELSE match_type END FROM (SELECT row, match_type, cls, unnest([
         {{'col': 'A', 'value': baseline}}, {{'col': 'B', 'value': CASE WHEN hb THEN printf('%.3f', base_avg) END}}, {{'col': 'C', 'value': CASE WHEN hb THEN '0.500' END}}, {{'col': 'D', 'value': CASE WHEN hb THEN '9.000' END}}, {{'col': 'E', 'value': CASE WHEN hb THEN '0.100' END}},
         {{'col': 'F', 'value': new}}, {{'col': 'G', 'value': CASE WHEN hn THEN printf('%.3f', new_avg) END}}, {{'col': 'H', 'value': CASE WHEN hn THEN '0.500' END}}, {{'col': 'I', 'value': CASE WHEN hn THEN '9.000' END}}, {{'col': 'J', 'value': CASE WHEN hn THEN '0.100' END}},
         {{'col': 'K', 'value': CASE WHEN change_pct IS NOT NULL THEN printf('%.3f', round(change_pct, 1)) WHEN match_type = 'new_only' THEN 'NEW' ELSE 'REMOVED' END}}, {{'col': 'L', 'value': match_type}}]) AS u FROM m1))"""

CASES = " ".join(f"WHEN contains(lower(name), '{part}') THEN '{kind}'" for part, kind in CATEGORIES)
CATEGORY = f"CASE {CASES} ELSE '{OTHER}' END"
PATTERN = "start, cycle_len, reps, signature, end_pos, center"


# The positions of the standard cycle of the trace ``source``, which must not be named e.
def _standard(source: str) -> str:
    return f"""(WITH e AS (SELECT * FROM {source}), n AS (SELECT count(*) AS n FROM e),{ANCHORS},{REPS},{OUTER},{SUBS},
st AS (SELECT y.inst + unnest(coalesce(offsets, [CAST(0 AS BIGINT)])) AS inst, coalesce(sub_len, o.cycle_len) AS len FROM o JOIN y ON y.anchor = o.anchor LEFT JOIN sb ON sb.anchor = o.anchor)
SELECT CAST(off AS BIGINT) AS pos, arg_min(name, inst) AS name, avg(dur) AS avg_dur FROM (SELECT inst, unnest(range(0, len)) AS off FROM st) JOIN e ON e.seq = inst + off GROUP BY off)"""


TRACES_COMPARED = (
    f"""
whole AS MATERIALIZED (SELECT * FROM e), later AS MATERIALIZED (SELECT seq - 50 AS seq, name, dur FROM e WHERE seq >= 50),
ck AS MATERIALIZED (SELECT CAST(0 AS BIGINT) AS pair_id, 'baseline' AS side, * FROM {_standard("whole")} UNION ALL SELECT CAST(0 AS BIGINT), 'new', * FROM {_standard("later")}),
"""
    + _signature("ck", "cs")
    + """,
kk AS MATERIALIZED (SELECT ck.*, sig FROM ck JOIN cs USING (name)),"""
    + ROTATIONS
    + ","
    + ALIGN
)


def _with(ctes: list[str], select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{','.join(ctes)}\n{select}"


_REPS = [TRACE, ANCHORS, REPS]
_ROWS = "round(avg_dur, 3) AS avg_dur, round(min_dur, 3) AS min_dur, round(max_dur, 3) AS max_dur, round(stddev, 3) AS stddev, cnt"
_GROUPS = [*_REPS, SUBS, GROUPS]
_GREEDY = [*_REPS, OUTER, COMPARED, GREEDY]

ORACLES: dict[str, str] = {
    "derived_trace": _with([TRACE], "SELECT seq, name, dur FROM e"),
    "kernel_counts": _with([TRACE, ANCHORS], "SELECT name, cnt FROM c"),
    "anchor_candidates": _with([TRACE, ANCHORS], "SELECT name, cnt FROM k"),
    "anchor_gaps": _with([TRACE, ANCHORS], "SELECT name, seq, gap FROM g"),
    "consistent_anchors": _with([TRACE, ANCHORS], "SELECT name, cnt, start, cycle_len FROM s"),
    "verified_cycles": _with(_REPS, "SELECT anchor, start, cycle_len, reps FROM v"),
    "outer_cycle": _with([*_REPS, OUTER], "SELECT anchor, start, cycle_len, reps FROM o"),
    "cycle_stats": _with([*_REPS, OUTER], f"SELECT index, name, {_ROWS}, round(avg_dur / avg_cycle_time * 100, 4) AS pct_of_cycle FROM z, h"),
    "cycle_stats_sample": _with([*_REPS, OUTER, SAMPLE], f"SELECT index, name, {_ROWS}, round(avg_dur / (SELECT sum(avg_dur) FROM z2) * 100, 4) AS pct_of_cycle FROM z2"),
    "cycle_header": _with([*_REPS, OUTER], "SELECT cycle_len, reps, round(avg_cycle_time, 3) AS avg_cycle_time, round(total_time, 3) AS total_time FROM h"),
    "top_kernels": _with([*_REPS, OUTER], 'SELECT * FROM (SELECT CAST(row_number() OVER (ORDER BY avg_dur DESC, index) AS INT) AS "rank", index, name, round(avg_dur, 3) AS avg_dur FROM z) WHERE "rank" <= 10'),
    "category_distribution": _with([*_REPS, OUTER], f"SELECT {CATEGORY} AS category, count(*) AS kernels, round(sum(avg_dur), 3) AS dur, round(sum(avg_dur) / (SELECT sum(avg_dur) FROM z) * 100, 4) AS pct FROM z GROUP BY category"),
    "kernel_signature": _with([TRACE, NAMES, _signature("a", "sg")], "SELECT name, sig FROM sg"),
    "kernel_category": _with([TRACE, NAMES], f"SELECT name, {CATEGORY} AS category FROM a"),
    "normalized_name": _with(
        [TRACE, NAMES],
        "SELECT name, CASE WHEN strlen(name) > 7 THEN regexp_replace(name, '^(triton(?:_.*)?)_[0-9]+$', '\\1', 's') ELSE name END AS normalized, CASE WHEN strlen(name) > 30 THEN substr(name, 1, 27) || '...' ELSE name END AS short, regexp_full_match(list_last(string_split(name, '_')), '[0-9]+x[0-9]+') AS has_dimensions FROM a",
    ),
    "name_hash": _with([TRACE, NAMES], f"SELECT name, {_FNV} AS hash_mod FROM a"),
    "sub_cycles": _with([*_REPS, SUBS], "SELECT anchor, v.start, sub_start, sub_len, CAST(len(offsets) AS BIGINT) AS positions FROM sb JOIN v USING (anchor)"),
    "pattern_signature": _with(_GROUPS, f"SELECT {PATTERN} FROM od", True),
    "pattern_similarity": _with(_GROUPS, "SELECT a.signature AS left_signature, b.signature AS right_signature, round(sim, 4) AS sim FROM sm JOIN od a ON a.k = l JOIN od b ON b.k = r", True),
    "cycle_patterns": _with(_GROUPS, f"SELECT {PATTERN} FROM pp", True),
    "phase_ends": _with(_GROUPS, f"(SELECT 'prefill' AS phase, {PATTERN} FROM pp ORDER BY center, start, cycle_len, signature LIMIT 1) UNION ALL (SELECT 'decode', {PATTERN} FROM pp ORDER BY center DESC, start, cycle_len, signature DESC LIMIT 1)", True),
    "phase_classification": _with(
        [*_GROUPS, "big AS (SELECT * FROM pp, n WHERE reps * cycle_len >= n // 100 OR NOT EXISTS (SELECT 1 FROM pp, n WHERE reps * cycle_len >= n // 100)), pf AS (SELECT * FROM big ORDER BY center, start, cycle_len, signature LIMIT 1), dc AS (SELECT * FROM big WHERE signature <> (SELECT signature FROM pf) ORDER BY center DESC, start, cycle_len, signature LIMIT 1)"],
        f"SELECT 'prefill' AS phase, {PATTERN} FROM pf UNION ALL SELECT 'decode', {PATTERN} FROM dc UNION ALL SELECT 'decode', {PATTERN} FROM pf WHERE NOT EXISTS (SELECT 1 FROM dc)",
        True,
    ),
    "no_patterns": _with(["e AS (SELECT event_id AS seq, event_type AS name, value AS dur FROM events), n AS (SELECT count(*) AS n FROM e)", ANCHORS], "SELECT name, cnt, start, cycle_len FROM s"),
    "distinct_kmers": _with([TRACE, KMERS], "SELECT count(DISTINCT kmer) AS kmers FROM k3"),
    "kmer_anchors": _with([TRACE, KMERS], "SELECT kmer, start, cycle_len, score FROM ka"),
    "first_repeat": _with([TRACE], "SELECT min(seq) AS first_repeat FROM (SELECT seq, row_number() OVER (PARTITION BY name ORDER BY seq) AS r FROM e) WHERE r = 2"),
    "quick_verify": _with(_REPS, "SELECT anchor AS name, start, cycle_len, coalesce(min(rep) FILTER (WHERE matched < 0.9 * cycle_len), max(rep) + 1) AS reps FROM q WHERE present = cycle_len GROUP BY anchor, start, cycle_len"),
    "match_compare": _with(_GREEDY, "SELECT pair_id, ord, baseline, new, match_type, sig FROM mo", True),
    "match_type_counts": _with(_GREEDY, "SELECT pair_id, match_type, count(*) AS cnt FROM mo GROUP BY pair_id, match_type", True),
    "change_heatmap": _with(
        _GREEDY,
        "SELECT pair_id, ord, round(base_avg, 3) AS base_avg, round(new_avg, 3) AS new_avg, round(change_pct, 4) AS change_pct, CASE WHEN match_type = 'new_only' THEN 'neutral' WHEN match_type = 'removed' THEN 'improved' WHEN change_pct < -5 THEN 'improved' WHEN change_pct > 5 THEN 'regressed' WHEN change_pct IS NOT NULL THEN 'neutral' END AS change_class FROM mo",
        True,
    ),
    "compare_totals": _with(_GREEDY, "SELECT pair_id, count(base_pos) AS base_kernels, count(new_pos) AS new_kernels, round(sum(base_avg), 3) AS base_time, round(sum(new_avg), 3) AS new_time FROM mo GROUP BY pair_id", True),
    "top_matches": _with(_GREEDY, 'SELECT * FROM (SELECT pair_id, CAST(row_number() OVER (PARTITION BY pair_id ORDER BY new_avg DESC, ord) AS INT) AS "rank", new, round(new_avg, 3) AS new_avg FROM mo WHERE new_avg > 0) WHERE "rank" <= 10', True),
    "kmer_cycles": _with([TRACE, KMER_FOLD], "SELECT left(name, 50) AS anchor, start, cycle_len, reps FROM kb1 WHERE rn = 1", True),
    "simple_cycles": _with([TRACE, SIMPLE], "SELECT start, len AS cycle_len, reps FROM sr WHERE start IS NOT NULL", True),
    "bruteforce_cycle": _with([TRACE, EXHAUSTIVE], "SELECT start, len AS cycle_len, reps FROM eb JOIN er USING (cid)"),
    "quick_probe": _with([TRACE, PROBE], "SELECT name, start, len AS cycle_len, reps FROM pc JOIN pr USING (cid) WHERE reps >= 5 ORDER BY name, len LIMIT 1"),
    "standard_cycle": _with(
        [*_REPS, OUTER, SUBS, EXHAUSTIVE],
        "SELECT o.start + coalesce(sub_start, 0) AS start, coalesce(sub_len, o.cycle_len) AS cycle_len, CAST(o.reps * coalesce(len(offsets), 1) AS BIGINT) AS reps, CASE WHEN sub_len IS NULL THEN 'outer' ELSE 'sub' END AS kind FROM o LEFT JOIN sb USING (anchor) UNION ALL SELECT start, len, reps, 'exhaustive' FROM eb JOIN er USING (cid) WHERE NOT EXISTS (SELECT 1 FROM o)",
    ),
    "pattern_stats": _with([*_GROUPS, PATTERN_STATS], f"SELECT index, name, {_ROWS}, round(avg_dur / mean * 100, 4) AS pct_of_cycle, cycle_no FROM ps JOIN pt2 USING (k) JOIN pk USING (k)", True),
    "align_compare": _with([*_REPS, OUTER, COMPARED, ROTATIONS, ALIGN], "SELECT pair_id, ord, baseline, new, match_type, sig FROM al", True),
    "trace_comparison": _with(
        [TRACE, TRACES_COMPARED],
        "SELECT ord, baseline, new, match_type, round(coalesce(x.avg_dur, 0), 3) AS base_avg, round(coalesce(w.avg_dur, 0), 3) AS new_avg FROM al LEFT JOIN kk x ON x.side = 'baseline' AND x.pos = base_at LEFT JOIN kk w ON w.side = 'new' AND w.pos = new_at",
        True,
    ),
    "smart_pairs": _with([*_REPS, OUTER, COMPARED, PAIRS], "SELECT l, r, round(sim, 4) AS sim FROM sg2 JOIN so USING (k) WHERE kept", True),
    "lcs_rotation": _with([*_REPS, OUTER, COMPARED, ROTATIONS], "SELECT pair_id, r AS rotation, lcs FROM le WHERE rn = 1", True),
    "numbered_pairs": _with([*_REPS, OUTER, COMPARED], "SELECT pair_id, side, count(*) AS kernels, round(sum(avg_dur), 3) AS dur FROM kk WHERE pair_id = 2 GROUP BY pair_id, side"),
    "cycle_similarity": _with([*_REPS, OUTER, COMPARED], "SELECT l, r, round(sim, 4) AS sim FROM ks"),
    "trace_scan": _with([TRACE], f"SELECT seq // {FILE_EVENTS} AS pid, seq % {FILE_EVENTS} AS seq, name, CAST(seq AS DOUBLE) AS ts, dur, CAST(7 AS BIGINT) AS tid FROM e"),
    "cycle_csv_lines": _with([*_REPS, OUTER, CSV_LINES], "SELECT line_no, line FROM ln"),
    "cycle_csv_rows": _with([*_REPS, OUTER], f"SELECT index AS pos, name, round(avg_dur, 3) AS avg_dur, round(min_dur, 3) AS min_dur, round(max_dur, 3) AS max_dur, round(stddev, 3) AS stddev, round({_SHARE}, 4) AS pct FROM z, h"),
    "cycle_csv_shares": _with([*_REPS, OUTER, _signature("z", "zs")], f"SELECT sig, round(sum(round({_SHARE}, 4)), 3) AS weight FROM z JOIN zs USING (name), h WHERE index > 0 GROUP BY sig"),
    "compare_csv_lines": _with([*_GREEDY, COMPARE_LINES], "SELECT line_no, line FROM ln", True),
    "sheet_cells": _with([*_GREEDY, CELLS], "SELECT row, col, value, style FROM cc", True),
}
