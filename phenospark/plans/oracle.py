"""The named queries as plain SQL over the same tables, written independently of the operators."""

from __future__ import annotations

from phenospark.functions.rand import halves, uniform_sql, uniform_sql_of
# Fixed values, stated here again so that the checks don't share them with the code they check: day
# origin, name pattern, concentration, prior mass per axis, starting components, slots, machine
# epsilon, start vectors per component, smallest denominator and rank of a factorisation.
DAY_ORIGIN = "2500-06-22"
TABLE_NAME_PATTERN = r"(\w+)(\.csv)?$"
ALPHA, GAMMA_BASE, K0, K_MAX = 0.5, 50.0, 10, 64
EPSILON, SAMPLES_PER_COMPONENT = 2.220446049250313e-16, 5
FLOOR, RANK = 1e-9, 30
# the rules of the cohort query
TARGET_CODES, EXCLUDED_CODES, RELATED_CODES = ("1-URGENT", "2-HIGH"), ("5-LOW",), ("1-URGENT",)
TARGET_DRUGS, EXCLUDED_DRUGS = ("Brand#11", "Brand#12", "Brand#13"), ("Brand#21", "Brand#22")
SCREENING_TESTS, ABNORMAL_ABOVE = ("view", "click"), {"purchase": 200.0, "error": 250.0}


def _in(items: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{i}'" for i in items) + ")"


# attempts of the rejection method written out; a draw fails them all with a chance below 1e-20
_ATTEMPTS = 16


def _gammas(cells: str, *stream: int) -> str:
    """Logs of Gamma(shape, 1) draws of a table (cell, shape): one row (cell, lg) per cell.

    A shape is raised by one and paid back by U^(1/shape). The first accepted attempt counts.
    """
    keys = ", ".join(
        f"({t}, " + ", ".join(f"{key}::BIGINT" for which in (1, 2, 3) for key in halves(*stream, t, which)) + ")" for t in range(_ATTEMPTS))
    u = [uniform_sql_of("cell", f"a{w}", f"b{w}") for w in (1, 2, 3)]
    return f"""
        SELECT cell, arg_min(ln(d) + ln(v), t) + ln({uniform_sql('cell', *stream, 0, 4)}) / any_value(shape) AS lg
        FROM (SELECT cell, t, shape, d, z, u, pow(1 + z / sqrt(9 * d), 3) AS v
              FROM (SELECT cell, t, shape, shape + 1.0::DOUBLE - 1.0::DOUBLE / 3 AS d, {u[2]} AS u,
                           sqrt(-2.0 * ln({u[0]})) * cos(2.0 * pi() * {u[1]}) AS z
                    FROM ({cells}) CROSS JOIN (VALUES {keys}) AS tries(t, a1, b1, a2, b2, a3, b3)))
        WHERE CASE WHEN v > 0 THEN ln(u) < 0.5 * z * z + d - d * v + d * ln(v) ELSE false END
        GROUP BY cell"""


_SLOTS = K_MAX


def _slot_draws(axis: str, letter: str, counts: str, code: int) -> str:
    """(idx, k, lg): draws of every value of an axis in every slot, for the first sweep."""
    cells = f"""
        SELECT a.idx * {_SLOTS} + slot.k AS cell, coalesce(c.cnt, 0) + g{letter} AS shape
        FROM axis_{axis} a CROSS JOIN slot CROSS JOIN gam LEFT JOIN {counts} c ON c.k = slot.k AND c.{axis} = a.idx"""
    return f"SELECT cell // {_SLOTS} AS idx, cell % {_SLOTS} AS k, lg FROM ({_gammas(cells, 1, 1, code)})"


def _log_sum(draws: str) -> str:
    return f"SELECT k, max(lg) + ln(sum(exp(lg - top))) AS s FROM (SELECT *, max(lg) OVER (PARTITION BY k) AS top FROM {draws}) GROUP BY k"


_ALL_CELLS = f"""
    SELECT slot.k AS cell, coalesce(t.cnt, 0) + {ALPHA / _SLOTS!r}::DOUBLE AS shape FROM slot LEFT JOIN tot t ON t.k = slot.k"""
_PROFILE_CELLS = """
    SELECT t.k * nm + a.idx AS cell, coalesce(c.cnt, 0) + gm AS shape
    FROM tot t CROSS JOIN axis_med a CROSS JOIN gam LEFT JOIN cm c ON c.k = t.k AND c.med = a.idx"""


# one common table expression per intermediate result; each may use those before it
_STEPS: dict[str, str] = {
    "med": """
        SELECT o_custkey AS subject_id, CAST(l_shipdate AS DATE) AS date, p_brand AS med_name
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "diag": "SELECT o_custkey AS subject_id, CAST(o_orderdate AS DATE) AS date, o_orderpriority AS code FROM orders",
    "lab": "SELECT user_id AS subject_id, CAST(ts AS DATE) AS date, event_type AS test_name, value FROM events",
    "codes": f"""
        SELECT DISTINCT subject_id, CAST(date_diff('day', DATE '{DAY_ORIGIN}', date) AS INTEGER) AS day, code FROM diag""",
    "given": f"""
        SELECT DISTINCT subject_id, CAST(date_diff('day', DATE '{DAY_ORIGIN}', date) AS INTEGER) AS day, med_name FROM med""",
    "nearest_day": """
        SELECT g.subject_id, g.day, g.med_name, max(v.day) AS assigned
        FROM given g LEFT JOIN (SELECT DISTINCT subject_id, day FROM codes) v
          ON v.subject_id = g.subject_id AND v.day <= g.day AND g.day - v.day < 7
        GROUP BY ALL""",
    "meds": "SELECT DISTINCT subject_id, assigned AS day, med_name FROM nearest_day WHERE assigned IS NOT NULL",
    "pairs": "SELECT subject_id, day, code, med_name FROM codes JOIN meds USING (subject_id, day)",
    "axis_patient": "SELECT key, row_number() OVER (ORDER BY key) - 1 AS idx FROM (SELECT DISTINCT subject_id AS key FROM pairs)",
    "axis_diag": "SELECT key, row_number() OVER (ORDER BY key) - 1 AS idx FROM (SELECT DISTINCT code AS key FROM pairs)",
    "axis_med": "SELECT key, row_number() OVER (ORDER BY key) - 1 AS idx FROM (SELECT DISTINCT med_name AS key FROM pairs)",
    "bag": """
        SELECT p.idx AS patient, d.idx AS diag, m.idx AS med, day, subject_id, code, med_name
        FROM pairs JOIN axis_patient p ON p.key = subject_id JOIN axis_diag d ON d.key = code JOIN axis_med m ON m.key = med_name""",
    "rec": "SELECT row_number() OVER (ORDER BY patient, diag, med, day) - 1 AS rec_id, patient, diag, med FROM bag",
    "dims": "SELECT count(DISTINCT patient) AS np, count(DISTINCT diag) AS nd, count(DISTINCT med) AS nm, count(*) AS n FROM rec",
    "z": f"SELECT rec_id, patient, diag, med, CAST(floor({uniform_sql('rec_id', 1, 0)} * {K0}) AS BIGINT) AS k FROM rec",
    "tot": "SELECT k, count(*) AS cnt FROM z GROUP BY k",
    "cp": "SELECT k, patient, count(*) AS cnt FROM z GROUP BY ALL",
    "cd": "SELECT k, diag, count(*) AS cnt FROM z GROUP BY ALL",
    "cm": "SELECT k, med, count(*) AS cnt FROM z GROUP BY ALL",
    "gam": f"""
        SELECT np, nd, nm, n, {GAMMA_BASE}::DOUBLE / np AS gp, {GAMMA_BASE}::DOUBLE / nd AS gd, {GAMMA_BASE}::DOUBLE / nm AS gm FROM dims""",
    "cells": """
        SELECT z.rec_id, t.k, t.cnt, coalesce(cp.cnt, 0) AS p, coalesce(cm.cnt, 0) AS m, coalesce(cd.cnt, 0) AS d,
               CASE WHEN z.k = t.k THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS own, gam.*
        FROM z CROSS JOIN tot t CROSS JOIN gam
          LEFT JOIN cp ON cp.k = t.k AND cp.patient = z.patient
          LEFT JOIN cd ON cd.k = t.k AND cd.diag = z.diag
          LEFT JOIN cm ON cm.k = t.k AND cm.med = z.med""",
    "w": f"""
        SELECT rec_id, k, (cnt - own) * ((p - own + gp) / (cnt - own + np * gp)) * ((m - own + gm) / (cnt - own + nm * gm))
               * ((d - own + gd) / (cnt - own + nd * gd)) AS weight FROM cells
        UNION ALL SELECT rec_id, -1, {ALPHA}::DOUBLE / (np * nd * nm) FROM rec CROSS JOIN gam""",
    "running": """
        SELECT rec_id, k, sum(weight) OVER (PARTITION BY rec_id ORDER BY CASE WHEN k = -1 THEN 1 ELSE 0 END, k
               ROWS UNBOUNDED PRECEDING) AS run, CASE WHEN k = -1 THEN 9223372036854775807 ELSE k END AS ord FROM w""",
    "drawn": f"""
        SELECT r.rec_id, min(ord) AS ord
        FROM running r JOIN (SELECT rec_id, max(run) AS total FROM running GROUP BY rec_id) t USING (rec_id)
        WHERE run >= {uniform_sql('r.rec_id', 1, 1)} * total GROUP BY r.rec_id""",
    "born": "SELECT rec_id, row_number() OVER (ORDER BY rec_id) AS j FROM drawn WHERE ord = 9223372036854775807",
    "free": """
        SELECT id, row_number() OVER (ORDER BY id) AS j
        FROM (SELECT unnest(range(0, (SELECT max(k) + 1 + (SELECT count(*) FROM born) FROM tot))) AS id)
        WHERE id NOT IN (SELECT k FROM tot)""",
    "frozen": """
        SELECT d.rec_id, CAST(coalesce(f.id, d.ord) AS BIGINT) AS k
        FROM drawn d LEFT JOIN born b USING (rec_id) LEFT JOIN free f ON f.j = b.j""",
    "moved": "SELECT r.rec_id, patient, diag, med, k FROM rec r JOIN frozen f USING (rec_id)",
    "slot": f"SELECT unnest(range(0, {_SLOTS})) AS k",
    "gamma_patient": _slot_draws("patient", "p", "cp", 1),
    "gamma_diag": _slot_draws("diag", "d", "cd", 2),
    "gamma_med": _slot_draws("med", "m", "cm", 3),
    "gamma_all": f"SELECT cell AS k, lg FROM ({_gammas(_ALL_CELLS, 1, 1, 0)})",
    "log_weight": f"""
        SELECT k, w.lg - p.s - d.s - m.s AS lw FROM gamma_all w
          JOIN ({_log_sum('gamma_patient')}) p USING (k) JOIN ({_log_sum('gamma_diag')}) d USING (k) JOIN ({_log_sum('gamma_med')}) m USING (k)""",
    "slot_mass": """
        SELECT rec_id, k, exp(lp - max(lp) OVER (PARTITION BY rec_id)) AS mass
        FROM (SELECT rec_id, lw.k, lw + p.lg + d.lg + m.lg AS lp
              FROM rec CROSS JOIN log_weight lw JOIN gamma_patient p ON p.idx = patient AND p.k = lw.k
                JOIN gamma_diag d ON d.idx = diag AND d.k = lw.k JOIN gamma_med m ON m.idx = med AND m.k = lw.k)""",
    "blocked": f"""
        SELECT rec_id, count(*) FILTER (WHERE run < {uniform_sql('rec_id', 1, 1)} * total) AS k
        FROM (SELECT rec_id, sum(mass) OVER (PARTITION BY rec_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS run,
                     sum(mass) OVER (PARTITION BY rec_id) AS total FROM slot_mass) GROUP BY rec_id""",
    "profile_gammas": f"SELECT cell, lg FROM ({_gammas(_PROFILE_CELLS, 1, 0, 3)})",
    "emb": """
        SELECT vec_id, label, label % 3 AS g, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS dim,
               CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings""",
    "par": "SELECT g, dim, count(*) AS n, avg(x) AS mean, var_pop(x) AS var FROM emb GROUP BY g, dim",
    "wt": "SELECT g, count(*)::DOUBLE / (SELECT count(*) FROM embeddings) AS weight FROM (SELECT label % 3 AS g FROM embeddings) GROUP BY g",
    "near": """
        SELECT vec_id, CAST(arg_min(g, (dist, g)) AS INTEGER) AS cluster
        FROM (SELECT vec_id, p.g, sum((x - mean) * (x - mean)) AS dist FROM emb JOIN par p USING (dim) GROUP BY vec_id, p.g)
        GROUP BY vec_id""",
    "logpdf": """
        SELECT vec_id, p.g AS k, -0.5 * (count(*) * ln(2 * pi()) + sum(ln(var)) + sum((x - mean) * (x - mean) / var)) AS logpdf
        FROM emb JOIN par p USING (dim) GROUP BY vec_id, p.g""",
    "dens": f"SELECT vec_id, k, {EPSILON!r}::DOUBLE + weight * exp(logpdf) AS p FROM logpdf JOIN wt ON wt.g = k",
    "resp": "SELECT vec_id, k, p / sum(p) OVER (PARTITION BY vec_id) AS resp, sum(p) OVER (PARTITION BY vec_id) AS total FROM dens",
    "line": """
        SELECT row_number() OVER () AS rid, l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS g,
               l_quantity / 10 AS x0, l_extendedprice / 10000 AS x1, l_discount * 10 AS x2 FROM lineitem""",
    "line_par": """
        SELECT g, count(*)::DOUBLE / (SELECT count(*) FROM line) AS weight, avg(x0) AS m0, avg(x1) AS m1, avg(x2) AS m2,
               covar_pop(x0, x0) AS a, covar_pop(x0, x1) AS b, covar_pop(x0, x2) AS c,
               covar_pop(x1, x1) AS d, covar_pop(x1, x2) AS e, covar_pop(x2, x2) AS f FROM line GROUP BY g""",
    "line_det": "SELECT *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS det FROM line_par",
    "line_dist": """
        SELECT rid, l_orderkey, l_linenumber, p.g AS k, weight, det, ((d * f - e * e) * y0 * y0 + (a * f - c * c) * y1 * y1 + (a * d - b * b) * y2 * y2
               + 2 * ((c * e - b * f) * y0 * y1 + (b * e - c * d) * y0 * y2 + (b * c - a * e) * y1 * y2)) / det AS dist
        FROM (SELECT rid, l.l_orderkey, l.l_linenumber, p.*, x0 - m0 AS y0, x1 - m1 AS y1, x2 - m2 AS y2 FROM line l CROSS JOIN line_det p) p""",
    "line_log": "SELECT rid, l_orderkey, l_linenumber, k, weight, -0.5 * (3 * ln(2 * pi()) + ln(det) + dist) AS logpdf FROM line_dist",
    # x = B y with the columns of B (1,0,0,1), (0,1,0,0), (0,0,1,1): the pseudo-determinant is det times
    # det(B^T B) = 3, and the distance is that of y
    "line_log4": "SELECT rid, l_orderkey, l_linenumber, k, weight, -0.5 * (4 * ln(2 * pi()) + ln(3 * det) + dist) AS logpdf FROM line_dist",
    "above_med": """
        SELECT lower(p_brand) AS item FROM part GROUP BY p_brand HAVING avg(p_retailprice) > (SELECT avg(p_retailprice) FROM part)""",
    "above_code": """
        SELECT lower(o_orderpriority) AS item FROM orders GROUP BY o_orderpriority
        HAVING avg(o_totalprice) > (SELECT avg(o_totalprice) FROM orders)""",
    "above_test": """
        SELECT lower(event_type) AS item FROM events GROUP BY event_type HAVING avg(value) > (SELECT avg(value) FROM events)""",
    "f_diag": "SELECT subject_id, 'diagnostic' AS source, code AS feature, count(*)::DOUBLE AS value FROM diag GROUP BY subject_id, code",
    "f_lab": "SELECT subject_id, 'lab' AS source, test_name AS feature, avg(value) AS value FROM lab GROUP BY subject_id, test_name",
    "f_med": "SELECT subject_id, 'medication' AS source, med_name AS feature, count(*)::DOUBLE AS value FROM med GROUP BY subject_id, med_name",
    "f_all": "SELECT * FROM f_diag UNION ALL SELECT * FROM f_lab UNION ALL SELECT * FROM f_med",
    "f_axis": """
        SELECT source, feature, row_number() OVER (ORDER BY source, feature) - 1 AS idx
        FROM (SELECT DISTINCT source, feature FROM f_all)""",
    "f_matrix": "SELECT subject_id, idx, value FROM f_all JOIN f_axis USING (source, feature)",
    "f_grid": """
        SELECT s.subject_id, a.idx, coalesce(m.value, 0) AS value
        FROM (SELECT DISTINCT subject_id FROM f_matrix) s CROSS JOIN f_axis a
          LEFT JOIN f_matrix m ON m.subject_id = s.subject_id AND m.idx = a.idx""",
    "f_sd": "SELECT idx, stddev_samp(value) AS sd FROM f_grid GROUP BY idx",
    "facts": f"""
        SELECT subject_id,
          coalesce(bool_or(code IN {_in(TARGET_CODES)}), false) AS target_code,
          coalesce(bool_or(code IN {_in(EXCLUDED_CODES)}), false) AS excluded_code,
          coalesce(bool_or(code IN {_in(RELATED_CODES)}), false) AS related_code,
          min(CASE WHEN med_name IN {_in(TARGET_DRUGS)} THEN date END) AS first_target,
          min(CASE WHEN med_name IN {_in(EXCLUDED_DRUGS)} THEN date END) AS first_excluded,
          coalesce(bool_or(test_name IN {_in(SCREENING_TESTS)}), false) AS screened,
          coalesce(bool_or({' OR '.join(f"(test_name = '{t}' AND value > {v})" for t, v in ABNORMAL_ABOVE.items())}), false) AS abnormal
        FROM (SELECT subject_id, date, med_name, NULL AS code, NULL AS test_name, NULL::DOUBLE AS value FROM med
              UNION ALL SELECT subject_id, date, NULL, code, NULL, NULL FROM diag
              UNION ALL SELECT subject_id, date, NULL, NULL, test_name, value FROM lab)
        GROUP BY subject_id""",
    "cohort": """
        SELECT subject_id, CASE
          WHEN target_code AND NOT excluded_code
               AND (first_excluded IS NULL OR first_target IS NULL OR first_target < first_excluded) THEN 1
          WHEN screened AND NOT abnormal AND NOT related_code THEN 2 ELSE 3 END AS label
        FROM facts""",
    "x": "SELECT patient, diag, med, count(*)::DOUBLE AS value FROM bag GROUP BY patient, diag, med",
    "rank": f"SELECT unnest(range(0, {RANK})) AS r",
    "fa": f"SELECT idx, r, {uniform_sql(f'idx * {RANK} + r', 1, 1)} AS v FROM axis_patient CROSS JOIN rank",
    "fb": f"SELECT idx, r, {uniform_sql(f'idx * {RANK} + r', 1, 2)} AS v FROM axis_diag CROSS JOIN rank",
    "fc0": f"SELECT idx, r, {uniform_sql(f'idx * {RANK} + r', 1, 3)} AS v FROM axis_med CROSS JOIN rank",
    "ga": "SELECT a.r AS r, b.r AS s, sum(a.v * b.v) AS v FROM fa a JOIN fa b ON a.idx = b.idx GROUP BY a.r, b.r",
    "gb": "SELECT a.r AS r, b.r AS s, sum(a.v * b.v) AS v FROM fb a JOIN fb b ON a.idx = b.idx GROUP BY a.r, b.r",
    "num": """
        SELECT med AS idx, fa.r AS r, sum(value * fa.v * fb.v) AS v
        FROM x JOIN fa ON fa.idx = patient JOIN fb ON fb.idx = diag AND fb.r = fa.r GROUP BY med, fa.r""",
    "den": """
        SELECT c.idx, ga.r AS r, sum(c.v * ga.v * gb.v) AS v
        FROM fc0 c JOIN ga ON ga.s = c.r JOIN gb ON gb.r = ga.r AND gb.s = ga.s GROUP BY c.idx, ga.r""",
    "fc": f"""
        SELECT c.idx, c.r, c.v * coalesce(num.v, 0) / (den.v + {FLOOR!r}::DOUBLE) AS v
        FROM fc0 c JOIN den ON den.idx = c.idx AND den.r = c.r LEFT JOIN num ON num.idx = c.idx AND num.r = c.r""",
    "model": """
        SELECT patient, diag, med, value, sum(fa.v * fb.v * fc.v) AS model
        FROM x JOIN fa ON fa.idx = patient JOIN fb ON fb.idx = diag AND fb.r = fa.r JOIN fc ON fc.idx = med AND fc.r = fa.r
        GROUP BY ALL""",
}


def _with(body: str) -> str:
    """Prefix the steps that ``body`` uses, directly or through other steps, in order."""
    import re

    def used(text: str) -> set[str]:
        return set(re.findall(r"[a-z_0-9]+", text.lower())) & set(_STEPS)

    need, todo = set(), used(body)
    while todo:
        step = todo.pop()
        if step not in need:
            need.add(step)
            todo |= used(_STEPS[step])
    steps = [f"{name} AS ({_STEPS[name]})" for name in _STEPS if name in need]
    return (f"WITH {', '.join(steps)} " if steps else "") + body


def _profile(axis: str, letter: str, steps: str) -> str:
    return f"""
        SELECT '{axis}' AS axis, t.k, a.idx, round((coalesce(c.cnt, 0) + g{letter}) / (t.cnt + n{letter} * g{letter}), 9) AS prob
        FROM tot t CROSS JOIN axis_{axis} a CROSS JOIN gam LEFT JOIN {steps} c ON c.k = t.k AND c.{axis} = a.idx"""


def _counts_of(table: str) -> str:
    return f"""
        SELECT 'all' AS axis, k, NULL::BIGINT AS idx, count(*) AS cnt FROM {table} GROUP BY k
        UNION ALL SELECT 'patient', k, patient, count(*) FROM {table} GROUP BY k, patient
        UNION ALL SELECT 'diag', k, diag, count(*) FROM {table} GROUP BY k, diag
        UNION ALL SELECT 'med', k, med, count(*) FROM {table} GROUP BY k, med"""


def _binarized(value: str, threshold: float) -> str:
    return f"CASE WHEN {value} < {threshold}::DOUBLE THEN 0.0::DOUBLE WHEN {value} > {threshold}::DOUBLE THEN 1.0::DOUBLE ELSE {value} END"


def _features(step: str, above: str | None = None) -> str:
    where = f" WHERE lower(feature) IN (SELECT item FROM {above})" if above else ""
    return f"SELECT subject_id, source, feature, round(value, 6) AS value FROM {step}{where}"


_LOG_JOINT = f"""
    SELECT CAST(sum(cnt) AS BIGINT) AS n_records, count(*) AS n_components,
      round(lgamma({ALPHA}::DOUBLE) - lgamma(sum(cnt) + {ALPHA}::DOUBLE)
        + sum(lgamma(cnt + {ALPHA / K_MAX!r}::DOUBLE) - lgamma({ALPHA / K_MAX!r}::DOUBLE)
              + lgamma(np * gp) - lgamma(cnt + np * gp) + lgamma(nd * gd) - lgamma(cnt + nd * gd)
              + lgamma(nm * gm) - lgamma(cnt + nm * gm))
        + (SELECT sum(lgamma(cnt + gp) - lgamma(gp)) FROM cp CROSS JOIN gam)
        + (SELECT sum(lgamma(cnt + gd) - lgamma(gd)) FROM cd CROSS JOIN gam)
        + (SELECT sum(lgamma(cnt + gm) - lgamma(gm)) FROM cm CROSS JOIN gam), 4) AS log_joint
    FROM tot CROSS JOIN gam"""



def _full_step(logs: str, dims: tuple[str, ...]) -> str:
    """An EM step of order lines under the densities of a step, one row per pair of dimensions."""
    resp = f"""
        SELECT rid, k, p / sum(p) OVER (PARTITION BY rid) AS r, sum(p) OVER (PARTITION BY rid) AS total
        FROM (SELECT rid, k, {EPSILON!r}::DOUBLE + weight * exp(logpdf) AS p FROM {logs})"""
    cells = " UNION ALL ".join(
        f"""SELECT CAST(k AS INTEGER) AS k, {i} AS dim, {j} AS other, round(sum(r) / count(*), 6) AS weight, round(sum(r * {x}) / sum(r), 6) AS mean,
              round(sum(r * ({x} - ax) * ({y} - ay)) / sum(r) - sum(r * ({x} - ax)) / sum(r) * (sum(r * ({y} - ay)) / sum(r)), 6) AS cov,
              round(sum(ln(total)), 3) AS log_likelihood
            FROM (SELECT *, avg({x}) OVER () AS ax, avg({y}) OVER () AS ay FROM weighed) GROUP BY k"""
        for i, x in enumerate(dims) for j, y in enumerate(dims) if i <= j)
    return f"SELECT * FROM (WITH weighed AS (SELECT * FROM ({resp}) JOIN line USING (rid)) {cells})"


# Loops as recursive queries: every round is made from the rows of the round before.

_LLOYD = """
    SELECT vec_id, CAST(arg_min(g, (dist, g)) AS INTEGER) AS cluster
    FROM (
      WITH RECURSIVE fit AS (
        SELECT 0 AS step, 1.0::DOUBLE AS moved, g, dim, mean FROM par
        UNION ALL
        SELECT step, max(sqrt(square)) OVER () AS moved, g, dim, mean
        FROM (
          SELECT o.step + 1 AS step, o.g, o.dim, coalesce(n.mean, o.mean) AS mean,
                 sum((coalesce(n.mean, o.mean) - o.mean) * (coalesce(n.mean, o.mean) - o.mean)) OVER (PARTITION BY o.g) AS square
          FROM fit o LEFT JOIN (
            SELECT cluster AS g, dim, avg(x) AS mean
            FROM emb JOIN (
              SELECT vec_id, arg_min(g, (dist, g)) AS cluster
              FROM (SELECT vec_id, f.g, sum((x - mean) * (x - mean)) AS dist FROM emb JOIN fit f USING (dim) GROUP BY vec_id, f.g) GROUP BY vec_id
            ) USING (vec_id) GROUP BY cluster, dim
          ) n ON n.g = o.g AND n.dim = o.dim
          WHERE o.step < 20 AND o.moved > 1e-4)
      )
      SELECT vec_id, f.g, sum((x - mean) * (x - mean)) AS dist
      FROM emb JOIN (SELECT * FROM fit WHERE step = (SELECT max(step) FROM fit)) f USING (dim) GROUP BY vec_id, f.g
    ) GROUP BY vec_id"""

_EM_DIAGONAL = f"""
    SELECT vec_id, CAST(arg_min(g, (-p, g)) AS INTEGER) AS cluster
    FROM (
      WITH RECURSIVE fit AS (
        SELECT 0 AS step, NULL::DOUBLE AS ll, par.g, weight, dim, mean, var FROM par JOIN wt ON wt.g = par.g
        UNION ALL
        SELECT * FROM (
          SELECT any_value(step) + 1 AS step, sum(ln(total)) AS ll, q.g, sum(r) / count(*) AS weight, dim, sum(r * x) / sum(r) AS mean,
                 greatest(sum(r * x * x) / sum(r) - (sum(r * x) / sum(r)) * (sum(r * x) / sum(r)), {EPSILON!r}::DOUBLE) AS var
          FROM emb JOIN (
            SELECT vec_id, g, step, p / sum(p) OVER (PARTITION BY vec_id) AS r, sum(p) OVER (PARTITION BY vec_id) AS total
            FROM (
              SELECT vec_id, f.g, any_value(step) AS step, {EPSILON!r}::DOUBLE + any_value(weight)
                * exp(-0.5 * (count(*) * ln(2 * pi()) + sum(ln(var)) + sum((x - mean) * (x - mean) / var))) AS p
              FROM emb JOIN fit f USING (dim) WHERE step < 100 GROUP BY vec_id, f.g)
          ) q USING (vec_id) GROUP BY q.g, dim)
        WHERE (SELECT any_value(ll) FROM fit) IS NULL OR abs(ll - (SELECT any_value(ll) FROM fit)) >= 0.01
      )
      SELECT vec_id, f.g, {EPSILON!r}::DOUBLE + any_value(weight)
        * exp(-0.5 * (count(*) * ln(2 * pi()) + sum(ln(var)) + sum((x - mean) * (x - mean) / var))) AS p
      FROM emb JOIN (SELECT * FROM fit WHERE step = (SELECT max(step) FROM fit)) f USING (dim) GROUP BY vec_id, f.g
    ) GROUP BY vec_id"""


def _full_density(rows: str) -> str:
    """The guarded density of each order line under rows with weight, m0..m2 and covariances a..f."""
    return f"""
        SELECT *, {EPSILON!r}::DOUBLE + weight * exp(-0.5 * (3 * ln(2 * pi()) + ln(det)
            + ((d * f - e * e) * y0 * y0 + (a * f - c * c) * y1 * y1 + (a * d - b * b) * y2 * y2
               + 2 * ((c * e - b * f) * y0 * y1 + (b * e - c * d) * y0 * y2 + (b * c - a * e) * y1 * y2)) / det)) AS p
        FROM (SELECT line.rid, l_orderkey, l_linenumber, x0, x1, x2, m.*, x0 - m0 AS y0, x1 - m1 AS y1, x2 - m2 AS y2,
                     a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS det
              FROM line CROSS JOIN ({rows}) m)"""


def _about(x: str, y: str) -> str:
    """Weighted covariance from moments about the old means, which keeps it from cancelling."""
    return f"sum(r * y{x} * y{y}) / sum(r) - (sum(r * y{x}) / sum(r)) * (sum(r * y{y}) / sum(r))"


_EM_FULL = f"""
    SELECT l_orderkey, l_linenumber, cluster
    FROM (
      SELECT rid, any_value(l_orderkey) AS l_orderkey, any_value(l_linenumber) AS l_linenumber, CAST(arg_min(g, (-p, g)) AS INTEGER) AS cluster
      FROM (
        WITH RECURSIVE fit AS (
          SELECT 0 AS step, NULL::DOUBLE AS ll, g, weight, m0, m1, m2, a, b, c, d, e, f FROM line_par
          UNION ALL
          SELECT * FROM (
            SELECT any_value(step) + 1 AS step, sum(ln(total)) AS ll, g, sum(r) / count(*) AS weight,
                   any_value(m0) + sum(r * y0) / sum(r) AS m0, any_value(m1) + sum(r * y1) / sum(r) AS m1, any_value(m2) + sum(r * y2) / sum(r) AS m2,
                   {_about('0', '0')} AS a, {_about('0', '1')} AS b, {_about('0', '2')} AS c,
                   {_about('1', '1')} AS d, {_about('1', '2')} AS e, {_about('2', '2')} AS f
            FROM (SELECT *, p / sum(p) OVER (PARTITION BY rid) AS r, sum(p) OVER (PARTITION BY rid) AS total
                  FROM ({_full_density('SELECT * FROM fit WHERE step < 100')}))
            GROUP BY g)
          WHERE (SELECT any_value(ll) FROM fit) IS NULL OR abs(ll - (SELECT any_value(ll) FROM fit)) >= 0.01
        )
        {_full_density('SELECT * FROM fit WHERE step = (SELECT max(step) FROM fit)')}
      ) GROUP BY rid)"""


# One mode is updated per round, in turn; after the third the error decides whether to go on. Every
# row carries the round, the last error, and whether the fit has ended.
_NCP_FIT = f"""
    SELECT mode, idx, CAST(r AS INTEGER) AS r, round(v, 6) AS value
    FROM (
      WITH RECURSIVE square AS (SELECT sum(value * value) AS s FROM x),
      cell AS (
        SELECT 0 AS m, patient AS i, 1 AS ma, diag AS ia, 2 AS mb, med AS ib, value FROM x
        UNION ALL SELECT 1, diag, 0, patient, 2, med, value FROM x
        UNION ALL SELECT 2, med, 0, patient, 1, diag, value FROM x),
      fit AS (
        SELECT 0 AS step, NULL::DOUBLE AS err, false AS ended, 0 AS m, idx, r, v FROM fa
        UNION ALL SELECT 0, NULL, false, 1, idx, r, v FROM fb
        UNION ALL SELECT 0, NULL, false, 2, idx, r, v FROM fc0
        UNION ALL
        SELECT * FROM (
          WITH now AS (SELECT * FROM fit WHERE NOT ended AND step < 600),
          turn AS (SELECT any_value(step) % 3 AS m, any_value(step) AS step, any_value(err) AS err FROM now),
          g AS (SELECT a.m, a.r, b.r AS s, sum(a.v * b.v) AS v FROM now a JOIN now b ON a.m = b.m AND a.idx = b.idx GROUP BY ALL),
          other AS (SELECT r, s, product(v) AS v FROM g WHERE m <> (SELECT m FROM turn) GROUP BY r, s),
          num AS (
            SELECT c.i AS idx, a.r, sum(c.value * a.v * b.v) AS v
            FROM cell c JOIN turn ON turn.m = c.m JOIN now a ON a.m = c.ma AND a.idx = c.ia JOIN now b ON b.m = c.mb AND b.idx = c.ib AND b.r = a.r
            GROUP BY c.i, a.r),
          den AS (
            SELECT f.idx, o.r, sum(f.v * o.v) AS v FROM now f JOIN turn ON turn.m = f.m JOIN other o ON o.s = f.r GROUP BY f.idx, o.r),
          new AS (
            SELECT f.m, f.idx, f.r, f.v * coalesce(num.v, 0) / (den.v + {FLOOR!r}::DOUBLE) AS v, coalesce(num.v, 0) AS num
            FROM now f JOIN turn ON turn.m = f.m JOIN den ON den.idx = f.idx AND den.r = f.r LEFT JOIN num ON num.idx = f.idx AND num.r = f.r),
          size AS (
            SELECT sum(n.v * o.v) AS v FROM (SELECT a.r, b.r AS s, sum(a.v * b.v) AS v FROM new a JOIN new b ON a.idx = b.idx GROUP BY a.r, b.r) n
              JOIN other o ON o.r = n.r AND o.s = n.s),
          after AS (
            SELECT CASE WHEN step % 3 = 2 THEN (SELECT s FROM square) - 2 * (SELECT sum(v * num) FROM new) + (SELECT v FROM size) ELSE err END AS err FROM turn)
          SELECT turn.step + 1, after.err, coalesce(turn.step % 3 = 2 AND turn.err - after.err < 1e-4 * turn.err, false), rows.m, rows.idx, rows.r, rows.v
          FROM (SELECT m, idx, r, v FROM new UNION ALL SELECT now.m, idx, r, v FROM now JOIN turn ON turn.m <> now.m) rows, turn, after)
      )
      SELECT ['patient', 'diag', 'med'][m + 1] AS mode, idx, r, v FROM fit WHERE step = (SELECT max(step) FROM fit)
    )"""

_BODIES: dict[str, str] = {
    "relative_day": f"SELECT subject_id, med_name, CAST(date_diff('day', DATE '{DAY_ORIGIN}', date) AS INTEGER) AS day FROM med",
    "asof_visit": "SELECT * FROM nearest_day",
    "asof_visit_bucket": "SELECT * FROM nearest_day",
    "asof_visit_expand": "SELECT * FROM nearest_day",
    "visits": """
        SELECT subject_id, day, codes, meds
        FROM (SELECT subject_id, day, string_agg(code, ',' ORDER BY code) AS codes FROM codes GROUP BY ALL)
        JOIN (SELECT subject_id, day, string_agg(med_name, ',' ORDER BY med_name) AS meds FROM meds GROUP BY ALL)
        USING (subject_id, day)""",
    "visit_pairs": "SELECT * FROM pairs",
    "axis_patient": "SELECT key, idx FROM axis_patient",
    "axis_code": "SELECT key, idx FROM axis_diag",
    "axis_item": "SELECT key, idx FROM axis_med",
    "tensor_bag": "SELECT patient, diag, med, 1.0::DOUBLE AS value FROM bag",
    "tensor_binary": "SELECT DISTINCT patient, diag, med, 1.0::DOUBLE AS value FROM bag",
    "tensor_dims": "SELECT np AS n_patient, nd AS n_diag, nm AS n_med, n AS n_entries FROM dims",
    "decode_triplets": "SELECT subject_id, day, code, med_name FROM bag",
    "triplet_columns": "SELECT patient AS A, diag AS B, med AS C FROM bag",
    "table_names": f"""
        SELECT page_id, CASE WHEN regexp_extract(url, '{TABLE_NAME_PATTERN}', 1) = '' THEN url
               ELSE regexp_extract(url, '{TABLE_NAME_PATTERN}', 1) END AS name FROM pages""",
    "binarize": f"""
        SELECT event_id, value, round(s, 9) AS scaled, round({_binarized('s', 0.5)}, 9) AS bit
        FROM (SELECT event_id, value, value / (SELECT max(value) FROM events) AS s FROM events)""",
    "diag_features": _features("f_diag"),
    "med_features": _features("f_med"),
    "lab_features": _features("f_lab"),
    "diag_features_filtered": _features("f_diag", "above_code"),
    "med_features_filtered": _features("f_med", "above_med"),
    "lab_features_filtered": _features("f_lab", "above_test"),
    "features_union": _features("f_all"),
    "feature_matrix": "SELECT subject_id, idx, round(value, 6) AS value FROM f_matrix",
    "feature_vectors": "SELECT subject_id, idx, round(value, 6) AS value FROM f_matrix WHERE value <> 0",
    "scaled_features": """
        SELECT subject_id, idx, round(CASE WHEN sd > 0 THEN value / sd ELSE 0 END, 6) AS value FROM f_matrix JOIN f_sd USING (idx)""",
    "scaled_vectors": """
        SELECT subject_id, idx, round(value / sd, 6) AS value FROM f_matrix JOIN f_sd USING (idx) WHERE sd > 0 AND value <> 0""",
    "cohort_labels": "SELECT subject_id, label FROM cohort",
    "kmeans_assign": "SELECT vec_id, cluster FROM near",
    "kmeans_step": """
        SELECT cluster, dim, count(*) AS n, round(avg(x), 6) AS center FROM emb JOIN near USING (vec_id) GROUP BY cluster, dim""",
    "kmeans_lloyd": _LLOYD,
    "gmm_fit_diagonal": _EM_DIAGONAL,
    "gmm_fit_full": _EM_FULL,
    "purity": """
        SELECT round(sum(best)::DOUBLE / sum(total), 9) AS purity, CAST(sum(total) AS BIGINT) AS n
        FROM (SELECT cluster, max(c) AS best, sum(c) AS total
              FROM (SELECT cluster, label, count(*) AS c FROM near JOIN embeddings USING (vec_id) GROUP BY ALL) GROUP BY cluster)""",
    "vector_mean": "SELECT dim, round(avg(x), 9) AS mean FROM emb GROUP BY dim",
    "diag_cov": "SELECT dim, round(var_pop(x), 9) AS var FROM emb GROUP BY dim",
    "gaussian_logpdf": "SELECT vec_id, CAST(k AS INTEGER) AS k, round(logpdf, 6) AS logpdf FROM logpdf",
    "gmm_resp": "SELECT vec_id, CAST(k AS INTEGER) AS k, round(resp, 6) AS resp FROM resp",
    "argmax_component": "SELECT vec_id, CAST(arg_min(k, (-resp, k)) AS INTEGER) AS cluster FROM resp GROUP BY vec_id",
    "gmm_step": """
        SELECT CAST(k AS INTEGER) AS k, dim, round(sum(resp) / count(*), 6) AS weight,
          round(sum(resp * x) / sum(resp), 6) AS mean,
          round(sum(resp * x * x) / sum(resp) - (sum(resp * x) / sum(resp)) * (sum(resp * x) / sum(resp)), 6) AS var,
          round(sum(ln(total)), 6) AS log_likelihood
        FROM emb JOIN resp USING (vec_id) GROUP BY k, dim""",
    "gaussian_logpdf_full": "SELECT l_orderkey, l_linenumber, CAST(k AS INTEGER) AS k, round(logpdf, 6) AS logpdf FROM line_log",
    "gaussian_logpdf_singular": "SELECT l_orderkey, l_linenumber, CAST(k AS INTEGER) AS k, round(logpdf, 6) AS logpdf FROM line_log4",
    "gmm_step_full": _full_step("line_log", ("x0", "x1", "x2")),
    "gmm_step_singular": _full_step("line_log4", ("x0", "x1", "x2", "(x0 + x2)")),
    "gmm_init": f"""
        SELECT CAST(i // {SAMPLES_PER_COMPONENT} AS INTEGER) AS k, dim, round(1.0::DOUBLE / 3, 9) AS weight,
          round(avg(x), 9) AS mean, round(var_pop(x), 9) AS var
        FROM (SELECT i, CAST(floor({uniform_sql('i', 1)} * (SELECT count(*) FROM embeddings)) AS BIGINT) AS pos
              FROM (SELECT unnest(range(0, {3 * SAMPLES_PER_COMPONENT})) AS i))
        JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS pos FROM embeddings) USING (pos)
        JOIN emb USING (vec_id) GROUP BY ALL""",
    "init_assignments": "SELECT rec_id, patient, diag, med, k FROM z",
    "component_counts": _counts_of("z"),
    "component_weights": "SELECT rec_id, k, round(weight, 12) AS weight FROM w",
    "component_posterior": "SELECT rec_id, k, round(weight / sum(weight) OVER (PARTITION BY rec_id), 9) AS prob FROM w",
    "draw_category": """
        SELECT rec_id, CAST(count(tot.k) AS INTEGER) AS at FROM drawn LEFT JOIN tot ON tot.k < ord GROUP BY rec_id""",
    "frozen_sweep": "SELECT rec_id, k FROM frozen",
    "blocked_sweep": "SELECT rec_id, k FROM blocked",
    "dirichlet_draws": """
        SELECT 'med' AS axis, k, idx, round(e / sum(e) OVER (PARTITION BY k), 9) AS prob
        FROM (SELECT cell // nm AS k, cell % nm AS idx, exp(lg - max(lg) OVER (PARTITION BY cell // nm)) AS e
              FROM profile_gammas CROSS JOIN dims)""",
    "compact_components": """
        SELECT rec_id, k, k_compact FROM frozen
        JOIN (SELECT k, row_number() OVER (ORDER BY k) - 1 AS k_compact FROM (SELECT DISTINCT k FROM frozen)) USING (k)""",
    "apply_deltas": _counts_of("moved"),
    "profiles_med": _profile("med", "m", "cm"),
    "profiles_diag": _profile("diag", "d", "cd"),
    "profiles_patient": _profile("patient", "p", "cp"),
    "profiles_patient_sparse": """
        SELECT 'patient' AS axis, k, idx, round(prob, 9) AS prob
        FROM (SELECT cp.k, patient AS idx, (cp.cnt + gp) / (t.cnt + np * gp) AS prob FROM cp JOIN tot t ON t.k = cp.k CROSS JOIN gam
              UNION ALL SELECT k, NULL::BIGINT, gp / (cnt + np * gp) FROM tot CROSS JOIN gam)""",
    "component_shares": "SELECT k, cnt, round(cnt::DOUBLE / n, 9) AS share FROM tot CROSS JOIN dims",
    "top_items": f"""
        SELECT axis, k, idx, round(prob, 9) AS prob, CAST(rank AS INTEGER) AS rank, key AS med_name
        FROM (SELECT 'med' AS axis, t.k, a.idx, a.key, (coalesce(c.cnt, 0) + gm) / (t.cnt + nm * gm) AS prob,
                     row_number() OVER (PARTITION BY t.k ORDER BY coalesce(c.cnt, 0) DESC, a.idx DESC) AS rank
              FROM tot t CROSS JOIN axis_med a CROSS JOIN gam LEFT JOIN cm c ON c.k = t.k AND c.med = a.idx)
        WHERE rank <= 10""",
    "score_triplets": """
        SELECT rec_id, round(sum(cnt::DOUBLE / n * ((p + gp) / (cnt + np * gp)) * ((d + gd) / (cnt + nd * gd))
               * ((m + gm) / (cnt + nm * gm))), 12) AS score FROM cells GROUP BY rec_id""",
    "log_joint": _LOG_JOINT,
    "ncp_step": "SELECT idx, CAST(r AS INTEGER) AS r, round(v, 9) AS value FROM fc",
    "ncp_reconstruct": "SELECT patient, diag, med, value, round(model, 9) AS model FROM model",
    "ncp_mask": f"""
        SELECT patient, diag, med, value, round(model, 6) AS model, round(s, 6) AS scaled,
          round({_binarized('model', 0.5)}, 6) AS mask, round({_binarized('s', 0.5)}, 6) AS scaled_mask
        FROM (SELECT *, model / (SELECT max(model) FROM model) AS s FROM model)""",
    "ncp_fit": _NCP_FIT,
    "top_factor_items": """
        SELECT idx, CAST(r AS INTEGER) AS r, round(v, 9) AS value, CAST(rank AS INTEGER) AS rank, key AS med_name
        FROM (SELECT idx, r, v, row_number() OVER (PARTITION BY r ORDER BY v DESC, idx DESC) AS rank FROM fc)
        JOIN axis_med USING (idx) WHERE rank <= 10""",
    "store_triplets_text": "SELECT patient, med, diag FROM bag",
    "store_tensor": "SELECT patient, diag, med, day, 1.0::DOUBLE AS value FROM bag",
    "store_dictionary": "SELECT key, idx FROM axis_med",
    "store_events_csv": "SELECT * FROM pairs",
    "store_clinical_events": "SELECT subject_id, label FROM cohort",
    "debug_diagnoses": f"SELECT subject_id, code, CAST(date_diff('day', DATE '{DAY_ORIGIN}', date) AS INTEGER) AS date FROM diag",
    "debug_medications": f"""
        SELECT m.subject_id, m.med_name, CAST(date_diff('day', DATE '{DAY_ORIGIN}', m.date) AS INTEGER) AS date, n.assigned AS assignment
        FROM med m LEFT JOIN nearest_day n ON n.subject_id = m.subject_id AND n.med_name = m.med_name
          AND n.day = date_diff('day', DATE '{DAY_ORIGIN}', m.date)""",
    "one_based_triplets": "SELECT patient + 1 AS patient, diag + 1 AS diag, med + 1 AS med, 1.0::DOUBLE AS value FROM bag",
    "store_csv_table": "SELECT p_brand, count(*) AS n, max(p_size) AS max_size FROM part GROUP BY p_brand",
    "store_candidates": _features("f_med", "above_med"),
    "store_profiles": _profile("diag", "d", "cd"),
    "store_factors": "SELECT 'med' AS mode, idx, CAST(r AS INTEGER) AS r, round(v, 9) AS value FROM fc",
}

ORACLE_SQL: dict[str, str] = {name: _with(body) for name, body in _BODIES.items()}
