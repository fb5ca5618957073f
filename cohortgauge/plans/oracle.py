"""Independent SQL for the registered queries, in DuckDB's dialect.

Each statement starts from the raw tables. Ranks are plain window functions here, fits
are chained Newton steps, and bins are CASE ladders: a different route to each result.
"""

from __future__ import annotations

import statistics

from cohortgauge.operators.metrics import bin_edges
from cohortgauge.plans import population as pop
from cohortgauge.plans import registry

LABELS = list(pop.PREVALENCE)
ANALYSIS = pop.study().analysis_labels
QUOTED = [f'"{n}"' for n in LABELS]
Z95 = 1.959963984540054


def quantile(p: float) -> float:
    """Of the standard normal distribution."""
    return statistics.NormalDist().inv_cdf(p)


def unit(*parts: str) -> str:
    joined = ", ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"(('0x' || substr(md5(concat_ws(':', {joined})), 1, 8))::UBIGINT / 4294967296::DOUBLE)"


def r6(expression: str, digits: int = 6) -> str:
    """Rounded as the registry rounds: moved off exact halves first, and never -0."""
    nudged = f"{expression} + {registry.NUDGE}::DOUBLE" if digits == 6 else expression
    return f"(round({nudged}, {digits}) + 0.0::DOUBLE)"


def _label(name: str) -> str:
    u = unit(f"'{name}'", "o_orderkey")
    cut = (
        f"({pop.PREVALENCE[name]}::DOUBLE + CASE WHEN o_orderstatus = 'F' THEN 0.06::DOUBLE ELSE 0 END"
        " + CASE WHEN age >= 65 THEN 0.04::DOUBLE ELSE 0 END)"
    )
    return f"""CASE WHEN {u} < {cut} THEN 1.0 WHEN {u} < {cut} + 0.05 THEN -1.0
        WHEN {u} < {cut} + {pop.UNCERTAIN + pop.UNMENTIONED}::DOUBLE THEN NULL ELSE 0.0 END::DOUBLE AS "{name}" """


POSITIVE = " OR ".join(f'coalesce("{n}" = 1, false)' for n in LABELS if n != "Support Devices")
OUTCOME = """CASE WHEN NOT coalesce(is_frontal, true) THEN 'lateral' WHEN view_raw IS NULL THEN 'view_missing'
    WHEN view_raw NOT IN ('AP', 'PA') THEN 'view_nonstandard'
    WHEN NOT coalesce(sex IN ('Male', 'Female') AND age BETWEEN 18 AND 120, false) THEN 'demographics_missing'
    ELSE 'retained' END"""
BIN = """CASE WHEN age >= 18 AND age < 40 THEN '18-39' WHEN age >= 40 AND age < 60 THEN '40-59'
    WHEN age >= 60 AND age < 80 THEN '60-79' WHEN age >= 80 AND age < 121 THEN '80+' END"""

IMAGES = f"""
base AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, r_name, c_mktsegment, (10 + o_orderkey % 100)::DOUBLE AS age,
         strftime(o_orderdate, '%Y%m%d') AS day
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey),
images AS (
  SELECT o_orderkey::VARCHAR AS patient_id, o_custkey || '/' || o_orderkey AS study_id,
         'train/patient' || o_orderkey || '/study' || (o_orderkey % 3 + 1) || '/view1_frontal.jpg' AS image_id,
         r_name AS site,
         CASE o_orderstatus WHEN 'F' THEN 'AP' WHEN 'O' THEN 'PA' ELSE
           CASE o_orderkey % 3 WHEN 0 THEN 'LATERAL' WHEN 2 THEN 'AP AXIAL' END END AS view_raw,
         NOT (o_orderstatus NOT IN ('F', 'O') AND o_orderkey % 3 = 0) AS is_frontal,
         CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING') THEN 'Male'
              WHEN c_mktsegment IN ('FURNITURE', 'HOUSEHOLD') THEN 'Female' END AS sex,
         age, o_orderkey, o_custkey, day, {", ".join(_label(n) for n in LABELS)}
  FROM base)"""

RESOLVED = ", ".join(f'nullif("{n}", -1) AS "{n}"' for n in LABELS)
COHORT = f"""{IMAGES},
classified AS (
  SELECT * EXCLUDE ({", ".join(QUOTED)}), {RESOLVED},
         CASE WHEN {POSITIVE} THEN 0.0 ELSE 1.0 END::DOUBLE AS "No Finding", {OUTCOME} AS outcome
  FROM images),
cohort AS (
  SELECT patient_id, study_id, image_id, site, view_raw AS view, sex, age, {BIN} AS age_bin, {", ".join(QUOTED)},
         "No Finding", '{pop.study().cohort_hash}' AS config_hash
  FROM classified WHERE outcome = 'retained')"""

GROUPED = f"""{COHORT},
grouped AS (SELECT *, CASE WHEN age < 65 THEN '<65' ELSE '>=65' END AS age_group FROM cohort)"""


def missing(column: str) -> str:
    return f"coalesce(CAST({column} AS VARCHAR), '∅')"


def stratum(*columns: str) -> str:
    return f"concat_ws('|', {', '.join(missing(c) for c in columns)})"


FOLDED = f"""{GROUPED},
strat AS (SELECT *, site || '|' || {stratum("view", "sex", '"Cardiomegaly"')} AS stratum FROM grouped),
folded AS (
  SELECT * EXCLUDE (stratum), CASE WHEN site IN ('AMERICA', 'EUROPE') THEN CAST((
           row_number() OVER (PARTITION BY stratum ORDER BY md5('42:' || patient_id), patient_id) - 1
           + (('0x' || substr(md5('42:' || stratum), 1, 8))::UBIGINT)::BIGINT) % 5 AS INTEGER) ELSE -1 END AS fold
  FROM strat)"""


def plan(columns: tuple[str, ...], minimum: int) -> str:
    """Validation allocation with the top-up dealt one patient at a time."""
    group = "PARTITION BY site, outer_fold"
    return f"""
spread AS (
  SELECT site, patient_id, fold, outer_fold::INTEGER AS outer_fold, {stratum(*columns)} AS stratum
  FROM folded, unnest(range(5)) AS t(outer_fold) WHERE fold >= 0),
strata AS (
  SELECT site, outer_fold, stratum, count(*) AS n_patients FROM spread WHERE fold <> outer_fold GROUP BY ALL),
p0 AS (
  SELECT *, n_patients * 0.15::DOUBLE AS exact, n_patients >= {minimum} AS eligible,
         round_even(sum(n_patients) OVER ({group})::DOUBLE * 0.15::DOUBLE, 0)::BIGINT AS target FROM strata),
p1 AS (
  SELECT *, CASE WHEN eligible THEN floor(exact) ELSE 0 END::BIGINT AS whole,
         row_number() OVER ({group} ORDER BY CASE WHEN eligible THEN exact - floor(exact) ELSE -1 END DESC, stratum) AS rn
  FROM p0),
p2 AS (
  SELECT *, whole + CASE WHEN eligible AND rn <= target - sum(whole) OVER ({group}) THEN 1 ELSE 0 END AS n1 FROM p1),
p3 AS (SELECT *, target - sum(n1) OVER ({group}) AS short FROM p2),
turns AS (
  SELECT site, outer_fold, stratum, short,
         row_number() OVER ({group} ORDER BY k, n_patients DESC, stratum) AS turn
  FROM (SELECT *, unnest(range(1, n_patients - n1 + 1)) AS k FROM p3 WHERE eligible)),
extra AS (SELECT site, outer_fold, stratum, count(*) AS more FROM turns WHERE turn <= short GROUP BY ALL),
plan AS (
  SELECT site, outer_fold, stratum, n_patients, exact, eligible, (n1 + coalesce(more, 0))::BIGINT AS n_val,
         NOT eligible AS skipped, target
  FROM p3 LEFT JOIN extra USING (site, outer_fold, stratum))"""


ROLES = f"""{FOLDED}, {plan(("view", "sex"), 7)},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY site, outer_fold, stratum
           ORDER BY md5((42 + outer_fold) || ':' || patient_id), patient_id) AS rk
  FROM spread WHERE fold <> outer_fold),
roles AS (
  SELECT site, patient_id, fold, outer_fold, CASE WHEN rk <= n_val THEN 'val' ELSE 'train' END AS role
  FROM ranked JOIN plan USING (site, outer_fold, stratum)
  UNION ALL SELECT site, patient_id, fold, outer_fold, 'test' FROM spread WHERE fold = outer_fold)"""


def scored(source: str, model: str) -> str:
    u = unit("'score'", "label", "patient_id", model)
    return f"""SELECT *, round(1 / (1 + exp(-((CASE WHEN truth = 1 THEN 1.6::DOUBLE ELSE -1.4::DOUBLE END
        + ln(({u} + 0.001::DOUBLE) / (1.001::DOUBLE - {u}))
        - CASE WHEN truth = 1 AND view = 'AP' THEN 0.5::DOUBLE ELSE 0 END
        - CASE WHEN truth = 1 AND age >= 65 THEN 0.4::DOUBLE ELSE 0 END)
        * CASE WHEN view = 'AP' THEN 1.8::DOUBLE ELSE 1.2::DOUBLE END))), 6) AS score FROM {source}"""


UNPIVOT = "UNPIVOT INCLUDE NULLS (truth FOR label IN (" + ", ".join(f'"{n}"' for n in ANALYSIS) + "))"
SCORES = f"""{GROUPED},
long AS (SELECT site, patient_id, image_id, view, sex, age, age_group, label, truth FROM grouped {UNPIVOT}),
scores AS ({scored("long", "'0'")}),
seen AS (SELECT * FROM scores WHERE truth IS NOT NULL AND score IS NOT NULL)"""

FOLD_SCORES = f"""{ROLES},
people AS (
  SELECT g.site, g.patient_id, g.view, g.sex, g.age, g.age_group, r.outer_fold AS fold, r.role,
         {", ".join(f'g."{n}"' for n in ANALYSIS)}
  FROM grouped g JOIN roles r ON g.site = r.site AND g.patient_id = r.patient_id WHERE r.role <> 'train'),
plong AS (SELECT site, patient_id, view, sex, age, age_group, fold, role, label, truth FROM people {UNPIVOT}),
fscores AS ({scored("plong", "fold")}),
val AS (SELECT * FROM fscores WHERE role = 'val'),
test AS (SELECT * FROM fscores WHERE role = 'test')"""


def logit(score: str) -> str:
    p = f"least(greatest({score}, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE)"
    return f"ln({p} / (1 - {p}))"


def scaled(score: str, temperature: str) -> str:
    return f"(1 / (1 + exp(-({logit(score)} / {temperature}))))"


def newton(name: str, source: str, keys: str, steps: int = 14) -> str:
    """Inverse temperature by Newton steps over the rows themselves."""
    parts = [
        f"{name}_rows AS MATERIALIZED (SELECT {keys}, {logit('score')} AS z, truth AS y FROM {source} "
        "WHERE truth IS NOT NULL AND score IS NOT NULL)",
        f"{name}_0 AS (SELECT DISTINCT {keys}, 0.5::DOUBLE AS b FROM {name}_rows)",
    ]
    for k in range(1, steps + 1):
        p = "(1 / (1 + exp(-b * z)))"
        parts.append(
            f"{name}_{k} AS MATERIALIZED (SELECT {keys}, any_value(b) - sum(z * ({p} - y)) / sum(z * z * {p} * (1 - {p})) AS b "
            f"FROM {name}_rows JOIN {name}_{k - 1} USING ({keys}) GROUP BY {keys})"
        )
    parts.append(f"{name} AS (SELECT {keys}, 1 / b AS temperature FROM {name}_{steps})")
    return ",\n".join(parts)


def curve(name: str, source: str, keys: str, score: str = "score") -> str:
    return f"""{name}_d AS (
  SELECT {keys}, {score} AS score, count(*) FILTER (truth = 1) AS n_pos, count(*) FILTER (truth = 0) AS n_neg
  FROM {source} WHERE truth IS NOT NULL AND {score} IS NOT NULL GROUP BY ALL),
{name} AS (
  SELECT *, sum(n_pos) OVER w AS cum_pos, sum(n_neg) OVER w AS cum_neg, sum(n_pos) OVER g AS all_pos,
         sum(n_neg) OVER g AS all_neg
  FROM {name}_d WINDOW w AS (PARTITION BY {keys} ORDER BY score DESC), g AS (PARTITION BY {keys}))"""


def ladder(score: str) -> str:
    edges = bin_edges(10)
    cases = " ".join(f"WHEN {score} <= {high!r}::DOUBLE THEN {i}" for i, high in enumerate(edges[1:]))
    return f"CASE WHEN {score} < 0 THEN NULL {cases} END"


DECIDED = f"""{SCORES},
decided AS (SELECT *, CASE WHEN score >= 0.35 THEN 1.0 ELSE 0.0 END AS predicted FROM scores),
sided AS (
  SELECT *, 'sex' AS stratum, 'Female' AS level_a, 'Male' AS level_b, sex AS level FROM decided
  UNION ALL SELECT *, 'age_group', '<65', '>=65', age_group FROM decided),
sick AS (SELECT *, (predicted = 0)::INTEGER AS missed FROM sided WHERE truth = 1),
keyset AS (SELECT DISTINCT site, label, stratum, level_a, level_b FROM sided)"""
KEYS = "site, label, stratum, level_a, level_b"


def gaps(extra: str = "") -> str:
    more = f", {extra}" if extra else ""
    return f"""SELECT {KEYS}{more}, {r6("ra")} AS rate_a, {r6("rb")} AS rate_b, na AS n_a, nb AS n_b, {r6("rb - ra")} AS gap
FROM (SELECT {KEYS}{more}, avg(missed) FILTER (level = level_a) AS ra, avg(missed) FILTER (level = level_b) AS rb,
             count(*) FILTER (level = level_a) AS na, count(*) FILTER (level = level_b) AS nb
      FROM sick GROUP BY ALL)"""


def mixed(weights: dict[str, float]) -> str:
    """Standardised rate of both sides; a view without positives leaves NULL."""
    def side(level):
        return " + ".join(
            f"{w}::DOUBLE * avg(missed) FILTER (level = {level} AND view = '{v}')" for v, w in weights.items()
        )

    return f"""mixed AS (SELECT {KEYS}, {side("level_a")} AS sa, {side("level_b")} AS sb FROM sick GROUP BY ALL)"""


def normal_cdf(z: str) -> str:
    """Series with gamma terms; accurate to far more digits than are compared."""
    x = f"(abs({z}) / sqrt(2.0::DOUBLE))"
    terms = (
        f"list_sum([exp(n * ln(2.0::DOUBLE) + (2 * n + 1) * ln(greatest({x}, 1e-300)) - "
        f"(lgamma(2 * n + 2) - n * ln(2.0::DOUBLE) - lgamma(n + 1))) for n in range(0, 120)])"
    )
    erf = f"least(1.0, 2 / sqrt(pi()) * exp(-{x} * {x}) * {terms})"
    return f"CASE WHEN {z} >= 0 THEN 0.5 + 0.5 * {erf} ELSE 0.5 - 0.5 * {erf} END"


def two_sided(z: str) -> str:
    return f"2 * (1 - ({normal_cdf(f'abs({z})')}))"


COUNTS = f"""{GROUPED},
clong AS (SELECT site, view, sex, age_group, label, truth FROM grouped {UNPIVOT}),
sides AS (
  SELECT site, label, view, truth, 'sex' AS stratum, 'Female' AS level_a, 'Male' AS level_b, sex AS level FROM clong
  UNION ALL SELECT site, label, view, truth, 'age_group', '<65', '>=65', age_group FROM clong),
counts AS (
  SELECT site, label, view, stratum, level_a, level_b, count(*) FILTER (truth = 1 AND level = level_a) AS n_a,
         count(*) FILTER (truth = 1 AND level = level_b) AS n_b
  FROM sides WHERE view IS NOT NULL GROUP BY ALL)"""


def evaluated(name: str, baseline: float, meaningful: float = registry.MEANINGFUL) -> str:
    """Detectable effects by the other form of the quadratic's root: constant term over the conjugate."""
    reach = (quantile(0.975) + quantile(0.80)) ** 2
    half = f"({reach * abs(1 - 2 * baseline) / 2!r}::DOUBLE / n_b)"
    rest = f"({reach * baseline * (1 - baseline)!r}::DOUBLE * (1.0::DOUBLE / n_a + 1.0::DOUBLE / n_b))"
    root = f"{rest} / (sqrt({half} * {half} + (1.0::DOUBLE + {reach!r}::DOUBLE / n_b) * {rest}) - {half})"
    return f"""{name} AS (
  SELECT *, coalesce(mde <= {meaningful}::DOUBLE, false) AS powered FROM (
    SELECT * EXCLUDE (root), CASE WHEN root < {max(baseline, 1 - baseline)}::DOUBLE THEN root END AS mde FROM (
      SELECT *, CASE WHEN least(n_a, n_b) >= 2 THEN {root} END AS root FROM counts)))"""


def tiers(name: str, source: str, lane: tuple[str, ...] = ("No Finding", "Pleural Effusion")) -> str:
    barred = "label IN (" + ", ".join(f"'{n}'" for n in lane) + ") AND tier = 'primary'"
    return f"""{name} AS (
  SELECT label, n_cells, n_gating_cells, n_powered, sites_powered, worst_mde, median_mde,
    CASE WHEN {barred} THEN 'exploratory' ELSE tier END AS tier,
    CASE WHEN {barred}
         THEN 'secondary lane: inverted error semantics' ELSE reason END AS reason
  FROM (
    SELECT *, CASE WHEN n_powered = n_gating_cells THEN 'primary' WHEN n_powered = 0 THEN 'descriptive'
                   ELSE 'exploratory' END AS tier,
           CASE WHEN n_powered = n_gating_cells THEN 'all cells powered' WHEN n_powered = 0 THEN 'no powered cells'
                ELSE 'powered at ' || sites_powered || '/2 sites' END AS reason
    FROM (
      SELECT label, (SELECT count(*) FROM {source} s WHERE s.label = g.label) AS n_cells, count(*) AS n_gating_cells,
             count(*) FILTER (powered) AS n_powered,
             (SELECT count(*) FROM (SELECT site FROM {source} s WHERE s.label = g.label
                AND s.site IN ('AMERICA', 'EUROPE') GROUP BY site HAVING bool_and(powered))) AS sites_powered,
             max(mde) AS worst_mde, median(mde) AS median_mde
      FROM {source} g WHERE site IN ('AMERICA', 'EUROPE') GROUP BY label)))"""


UNTIDY = f"""
untidy AS (
  SELECT CASE WHEN l_quantity = 50 THEN NULL WHEN l_orderkey % 100 = 7 THEN '  ' ELSE l_orderkey::VARCHAR END AS patient_id,
    CASE WHEN l_linenumber = 1 THEN 'S' || l_suppkey ELSE l_orderkey || '/' || l_linenumber END AS study_id,
    l_orderkey || '-' || l_linenumber || '-' || l_partkey AS image_id,
    CASE WHEN l_returnflag = 'R' THEN 'EUROPE' ELSE 'AMERICA' END AS site,
    CASE WHEN l_returnflag = 'N' AND l_linenumber = 3 THEN 'LATERAL' WHEN l_linestatus = 'F' THEN 'AP' ELSE 'PA' END AS view,
    CASE l_suppkey % 3 WHEN 0 THEN 'Male' WHEN 1 THEN 'Female'
      ELSE CASE WHEN l_linenumber = 5 THEN 'Unknown' ELSE 'Male' END END AS sex,
    l_quantity + 10 AS age, CASE WHEN l_quantity < 30 THEN '18-39' ELSE '40-59' END AS age_bin,
    CASE WHEN l_tax = 0 THEN 'NOT-A-HASH' ELSE '{pop.study().cohort_hash}' END AS config_hash,
    CASE WHEN (l_orderkey * 31 + l_partkey * 17) % 1000 < 20 THEN 1.0 WHEN (l_orderkey * 31 + l_partkey * 17) % 1000 < 50
         THEN -1.0 ELSE 0.0 END::DOUBLE AS "Cardiomegaly",
    CASE (l_orderkey * 13 + l_suppkey * 7) % 10 WHEN 0 THEN 1.0 WHEN 1 THEN 1.0 WHEN 2 THEN 1.0 WHEN 3 THEN NULL
         ELSE 0.0 END::DOUBLE AS "Edema",
    CASE WHEN (l_partkey + l_linenumber) % 5 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS "No Finding"
  FROM lineitem)"""


def broken(check: str, subject: str, where: str, shown: str, source: str = "untidy") -> str:
    """Count of offending rows and the three smallest distinct values."""
    return f"""SELECT '{check}' AS "check", '{subject}' AS subject, count(*) AS n_affected,
  (SELECT string_agg(v, ', ' ORDER BY v) FROM (
     SELECT DISTINCT coalesce(CAST({shown} AS VARCHAR), 'NULL') AS v FROM {source} WHERE {where} ORDER BY v LIMIT 3)) AS examples
FROM {source} WHERE {where} HAVING count(*) > 0"""


def repeated(column: str) -> str:
    inner = f"(SELECT {column} AS v FROM untidy WHERE {column} IS NOT NULL GROUP BY 1 HAVING count(*) > 1)"
    return broken(f"identifiers.duplicate_{column}", column, "true", "v", inner)


MANIFEST = f"""{IMAGES},
lines AS (
  SELECT r_name AS site, ' held\\patient' || o_orderkey || '\\study' || (o_orderkey % 3 + 1) || '\\view1_frontal.PNG' AS value
  FROM lineitem JOIN base ON l_orderkey = o_orderkey
  UNION ALL SELECT r_name, 'held/patient' || o_orderkey || '/study9/view1_frontal.png ' FROM base WHERE o_orderkey % 60 = 3
  UNION ALL SELECT r_name, '   ' FROM base WHERE o_orderkey % 1000 = 0),
names AS (SELECT DISTINCT site, trim(value) AS name FROM lines WHERE trim(value) <> '')"""


def path_key(column: str, depth: int) -> str:
    """Split and slice; a path with fewer parts than ``depth`` stays whole."""
    parts = f"string_split(replace({column}, '\\', '/'), '/')"
    tail = f"array_to_string(list_slice({parts}, greatest(len({parts}) - {depth} + 1, 1), len({parts})), '/')"
    return f"lower(regexp_replace({tail}, '\\.[A-Za-z0-9]+$', ''))"


HELD = f"""{MANIFEST},
held AS (SELECT DISTINCT site, {path_key("name", 3)} AS image_key FROM names),
keyed AS (SELECT *, {path_key("image_id", 3)} AS image_key FROM images),
kept AS (SELECT * FROM keyed SEMI JOIN held USING (site, image_key))"""

LABELLED = f"{unit(chr(39) + 'labelled' + chr(39), 'patient_id')} >= 0.1"
ANCHORED = f"""{IMAGES},
anchored AS (
  SELECT i.*, {LABELLED} AS has_labels, o_custkey % 20 <> 0 AS has_demographics,
         20 + o_custkey % 60 + (year(try_strptime(CASE WHEN o_orderkey % 89 = 0 THEN 'unknown' ELSE day END, '%Y%m%d')) - 1995)
           AS study_age
  FROM images i)"""
LABEL_OR_NULL = ", ".join(QUOTED)

LAYOUT = f"""{COHORT},
layout AS (
  SELECT image_id, {path_key("image_id", 3)} AS image_key, row_number() OVER (ORDER BY {path_key("image_id", 3)}, image_id) - 1 AS pos
  FROM cohort),
index AS (SELECT image_id, image_key, (pos // {registry.QUERY_SHARD})::INTEGER AS shard,
          (pos % {registry.QUERY_SHARD})::INTEGER AS row FROM layout)"""

PREDICTIONS = f"""{FOLDED},
keepers AS (
  SELECT site, patient_id, CASE WHEN patient_id::BIGINT % 60 = 1 THEN (fold + 1) % 5 ELSE fold END AS fold
  FROM folded WHERE fold >= 0 AND patient_id::BIGINT % 50 <> 0),
preds AS (SELECT * FROM keepers UNION ALL SELECT * FROM keepers WHERE patient_id::BIGINT % 70 = 3)"""

REPLICATES = 2000


def _uniform(number: int) -> str:
    return f"((('0x' || substr(h, {8 * number + 1}, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)"


def _binomial(n: str, p: str, number: int) -> str:
    """Quantile of a binomial: terms added up in a list where the variance is small."""
    u = _uniform(number)
    z = f"(sqrt(-2::DOUBLE * ln({u})) * cos(2::DOUBLE * pi() * {_uniform(number + 1)}))"

    def summed(q: str) -> str:
        terms = f"list_transform(range(0, least({n}, 90)), lambda j: {{'f': 0::DOUBLE, 'b': 0::DOUBLE, 'k': 0::BIGINT, 'j': j}})"
        step = f"{{'f': s.f * ({n} - x.j) / (x.j + 1) * ({q} / (1 - {q})), 'b': s.b + s.f, 'k': s.k + (s.b + s.f <= {u})::BIGINT, 'j': 0::BIGINT}}"
        start = f"{{'f': pow(1 - {q}, {n}), 'b': 0::DOUBLE, 'k': 0::BIGINT, 'j': 0::BIGINT}}"
        return f"list_reduce({terms}, lambda s, x: {step}, {start}).k"

    var = f"({n} * {p} * (1 - {p}))"
    far = f"floor({n} * {p} + sqrt({var}) * {z} + (1 - 2 * {p}) * ({z} * {z} - 1) / 6 + 0.5)"
    return f"""CASE WHEN {n} = 0 OR {p} <= 0 THEN 0 WHEN {p} >= 1 THEN {n} WHEN {var} >= 9 THEN least({n}, greatest(0, {far}::BIGINT))
      WHEN {p} <= 0.5 THEN {summed(p)} ELSE {n} - {summed(f"(1 - {p})")} END"""


def resampled(mix: dict[str, float]) -> str:
    """Gaps of every replicate, the cells drawn one after the other by recursion, and their intervals."""
    side = "CASE level WHEN level_a THEN 'a' WHEN level_b THEN 'b' ELSE 'other' END"
    key = "concat_ws(':', '42', site, label, stratum, level_a, level_b, scope, rep::VARCHAR, i::VARCHAR)"

    def rate(where: str) -> str:
        return f"(sum(m) FILTER ({where}))::DOUBLE / nullif(sum(k) FILTER ({where}), 0)"

    std = " - ".join("(" + " + ".join(f"{w}::DOUBLE * ({rate(f"side = '{s}' AND view = '{v}'")})" for v, w in mix.items()) + ")" for s in "ba")
    ends = [f"quantile_cont({v}, {q}) AS {n}_{e}" for n, v in (("g", "raw"), ("r", "praw"), ("s", "pstd"), ("d", "praw - pstd")) for e, q in (("l", 0.025), ("h", 0.975))]
    return f"""
bcells AS (SELECT {KEYS}, {side} AS side, coalesce(view, '') AS view, count(*) AS n, sum(missed)::BIGINT AS m FROM sick GROUP BY ALL),
bscoped AS (SELECT *, 'both' AS scope FROM bcells UNION ALL SELECT *, view FROM bcells WHERE view <> ''),
bnumbered AS (
  SELECT *, (row_number() OVER w - 1)::INTEGER AS i, (sum(n) OVER (PARTITION BY {KEYS}, scope))::BIGINT AS total,
         n / (sum(n) OVER (PARTITION BY {KEYS}, scope) - (sum(n) OVER w - n))::DOUBLE AS share, m / n::DOUBLE AS rate
  FROM bscoped WINDOW w AS (PARTITION BY {KEYS}, scope ORDER BY side, view)),
bkeyed AS (SELECT *, md5({key}) AS h FROM bnumbered, (SELECT unnest(range(1, {REPLICATES} + 1)) AS rep)),
bchain AS (
  SELECT {KEYS}, scope, rep, i, total AS rest, ({_binomial("total", "share", 0)})::BIGINT AS k FROM bkeyed WHERE i = 0
  UNION ALL
  SELECT {KEYS}, scope, rep, i, rest, ({_binomial("rest", "share", 0)})::BIGINT
  FROM (SELECT n.*, c.rest - c.k AS rest FROM bchain c JOIN bkeyed n USING ({KEYS}, scope, rep) WHERE n.i = c.i + 1)),
bdrawn AS (
  SELECT {KEYS}, scope, rep, side, view, k, ({_binomial("k", "rate", 2)})::BIGINT AS m FROM bchain JOIN bkeyed USING ({KEYS}, scope, rep, i)),
bgaps AS (
  SELECT {KEYS}, scope, rep, {rate("side = 'b'")} - {rate("side = 'a'")} AS raw, {std} AS std FROM bdrawn GROUP BY ALL),
bfolded AS (
  SELECT {KEYS}, scope, count(raw) AS usable, count(praw) AS paired, {", ".join(ends)}
  FROM (SELECT *, CASE WHEN scope = 'both' AND std IS NOT NULL THEN raw END AS praw, CASE WHEN scope = 'both' AND raw IS NOT NULL THEN std END AS pstd FROM bgaps)
  GROUP BY ALL)"""


def _deltas(mix: dict[str, float]) -> str:
    """The difference of both gaps with its interval, NULL below 100 usable replicates."""
    return f"""{DECIDED}, {mixed(mix)}, {resampled(mix)},
gap0 AS (
  SELECT {KEYS}, avg(missed) FILTER (level = level_b) - avg(missed) FILTER (level = level_a) AS gap,
         count(*) FILTER (level = level_a) AS n_a, count(*) FILTER (level = level_b) AS n_b
  FROM sick GROUP BY ALL),
intervals AS (
  SELECT {KEYS}, n_a, n_b, gap, sb - sa AS std, gap - (sb - sa) AS delta, coalesce(paired, 0) AS paired,
         {", ".join(f"CASE WHEN paired >= 100 THEN {n}_{e} END AS {n}_{e}" for n in "rsd" for e in "lh")},
         CASE WHEN paired >= 100 THEN d_l END AS low, CASE WHEN paired >= 100 THEN d_h END AS high
  FROM gap0 JOIN mixed USING ({KEYS}) LEFT JOIN (SELECT * FROM bfolded WHERE scope = 'both') USING ({KEYS}))"""


INTERVALS = _deltas(pop.study().reference_mix)


def positivity_of(mix: dict[str, float], fewest: int, far: float) -> str:
    """Every side's share of every referenced view, counted one by one, and the problems of each analysis."""
    values = ", ".join(f"('{v}', {w}::DOUBLE, {i})" for i, (v, w) in enumerate(mix.items()))
    return f"""
slots AS (
  SELECT {KEYS}, level_a AS level, 0 AS k FROM keyset UNION ALL SELECT {KEYS}, level_b, {len(mix)} FROM keyset),
mix AS (SELECT * FROM (VALUES {values}) AS v(view, w, i)),
counted AS (
  SELECT site, label, stratum, level_a, level_b, s.level, m.view, w, k + i AS pos,
    (SELECT count(*) FROM sick x WHERE x.site = s.site AND x.label = s.label AND x.stratum = s.stratum AND x.level = s.level
       AND x.view = m.view) AS n,
    (SELECT count(*) FROM sick x WHERE x.site = s.site AND x.label = s.label AND x.stratum = s.stratum AND x.level = s.level) AS total
  FROM slots s CROSS JOIN mix m),
detail AS (
  SELECT {KEYS}, pos, level, view, n AS n_positive, {r6("n / nullif(total, 0)", 4)} AS observed_share, w AS reference_weight,
    {r6("abs(n / nullif(total, 0) - w)", 4)} AS reweight_distance,
    CASE WHEN n < {fewest} THEN level || '/' || view || ': ' || n || ' positives'
         WHEN abs(n / nullif(total, 0) - w) > {far} THEN level || '/' || view || ': observed '
           || printf('%.2f', round(n / total, 2)) || ' reweighted to ' || printf('%.2f', w) END AS problem
  FROM counted),
positive AS (
  SELECT {KEYS}, count(problem) = 0 AS positivity_ok, coalesce(string_agg(problem, '; ' ORDER BY pos), '') AS positivity_note
  FROM detail GROUP BY ALL)"""


def verdict(margin: float) -> str:
    return f"""CASE WHEN low IS NULL THEN 'not estimated' WHEN low > 0 THEN 'attenuation' WHEN high < 0 THEN 'masking'
    WHEN low >= -{margin}::DOUBLE AND high <= {margin}::DOUBLE THEN 'independence' ELSE 'inconclusive' END"""


INTERACTION = f"""{DECIDED},
icells AS (
  SELECT site, label, stratum, level, view, count(*) AS size, sum(missed)::BIGINT AS events,
         (count(*) - sum(missed))::BIGINT AS non_events
  FROM sick WHERE level IS NOT NULL AND view IS NOT NULL GROUP BY ALL),
closed AS (
  SELECT site, label, stratum, sum(sgn * ln(events / non_events)) AS b, sqrt(sum(1.0::DOUBLE / events + 1.0::DOUBLE / non_events)) AS se
  FROM (SELECT *, CASE WHEN level IN ('Female', '<65') THEN -1 ELSE 1 END * CASE WHEN view = 'AP' THEN -1 ELSE 1 END AS sgn
        FROM icells)
  GROUP BY ALL HAVING min(least(events, non_events)) >= 10 AND count(*) = 4 AND sum(size) >= 30),
tests AS (SELECT *, {two_sided("(b / se)")} AS p FROM closed)"""


def with_(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes}\n{select}" if "bchain" in ctes else f"WITH {ctes}\n{select}"


def percent(value: str) -> str:
    return f"printf('%.1f%%', round(100 * coalesce({value}, 0), 1))"


def slope_chain(steps: int = 14) -> str:
    """Intercept and slope by two-parameter Newton steps."""
    p = "(1 / (1 + exp(-(a + b * z))))"
    parts = [
        f"srows AS MATERIALIZED (SELECT site, label, {logit('score')} AS z, truth AS y FROM seen)",
        "s_0 AS (SELECT DISTINCT site, label, 0.0::DOUBLE AS a, 0.5::DOUBLE AS b FROM srows)",
    ]
    for k in range(1, steps + 1):
        parts.append(
            f"""s_{k} AS MATERIALIZED (
  SELECT site, label, a + (g0 * h11 - g1 * h01) / (h00 * h11 - h01 * h01) AS a,
         b + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS b
  FROM (SELECT site, label, any_value(a) AS a, any_value(b) AS b, sum(y - {p}) AS g0, sum(z * (y - {p})) AS g1,
               sum({p} * (1 - {p})) AS h00, sum(z * {p} * (1 - {p})) AS h01, sum(z * z * {p} * (1 - {p})) AS h11
        FROM srows JOIN s_{k - 1} USING (site, label) GROUP BY site, label))"""
        )
    return ",\n".join([*parts, f"slopes AS (SELECT * FROM s_{steps})"])


def coupling_chain(steps: int = 12) -> str:
    """Intercept, age and sex by three-parameter Newton steps with Cramer's rule."""
    p = "(1 / (1 + exp(-(b0 + b1 * x + b2 * m))))"
    terms = ["1", "x", "m"]
    sums = [f"sum({t} * (y - {p})) AS g{i}" for i, t in enumerate(terms)]
    sums += [
        f"sum({terms[i]} * {terms[j]} * {p} * (1 - {p})) AS h{i}{j}" for i in range(3) for j in range(i, 3)
    ]
    # Cofactors of the symmetric information matrix.
    cofactors = """h11 * h22 - h12 * h12 AS c00, h02 * h12 - h01 * h22 AS c01, h01 * h12 - h02 * h11 AS c02,
  h00 * h22 - h02 * h02 AS c11, h01 * h02 - h00 * h12 AS c12, h00 * h11 - h01 * h01 AS c22"""
    det = "(h00 * c00 + h01 * c01 + h02 * c02)"
    parts = [
        """crows AS MATERIALIZED (SELECT site, age / 10 AS x, (sex = 'Male')::INT AS m, (view = 'AP')::INT AS y FROM cohort)""",
        "c_0 AS (SELECT DISTINCT site, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2 FROM crows)",
    ]
    for k in range(1, steps + 1):
        parts.append(
            f"""c_{k} AS MATERIALIZED (
  SELECT site, b0 + (c00 * g0 + c01 * g1 + c02 * g2) / {det} AS b0, b1 + (c01 * g0 + c11 * g1 + c12 * g2) / {det} AS b1,
         b2 + (c02 * g0 + c12 * g1 + c22 * g2) / {det} AS b2, sqrt(c11 / {det}) AS s1, sqrt(c22 / {det}) AS s2
  FROM (SELECT *, {cofactors} FROM (
    SELECT site, any_value(b0) AS b0, any_value(b1) AS b1, any_value(b2) AS b2, {", ".join(sums)}
    FROM crows JOIN c_{k - 1} USING (site) GROUP BY site)))"""
        )
    return ",\n".join(parts)


def eliminated(source: str, name: str, size: int, carried: str) -> tuple[str, list[str]]:
    """Gauss-Jordan on ``h`` beside ``g`` and the identity: one table per pivot, solutions as expressions.

    ``h{i}_{j}`` is the matrix, ``r{i}_0`` the right side and ``r{i}_1`` and on the identity.
    """
    parts = []
    for k in range(size):
        columns = []
        for i in range(size):
            factor = f"h{i}_{k} / h{k}_{k}"
            for j in range(k + 1, size):
                columns.append(f"h{k}_{j} / h{k}_{k} AS h{k}_{j}" if i == k else f"h{i}_{j} - {factor} * h{k}_{j} AS h{i}_{j}")
            for j in range(size + 1):
                columns.append(f"r{k}_{j} / h{k}_{k} AS r{k}_{j}" if i == k else f"r{i}_{j} - {factor} * r{k}_{j} AS r{i}_{j}")
        parts.append(f"{name}_{k} AS (SELECT {carried}, {', '.join(columns)} FROM {source if k == 0 else f'{name}_{k - 1}'})")
    return ",\n".join(parts), [f"r{i}_0" for i in range(size)]


def interaction_chain(steps: int = 12) -> str:
    """Five-parameter Newton steps for both strata at once, over the patients' cells."""
    size = 5
    x = ["1", "m", "p", "o", "m * p"]
    p = "(1 / (1 + exp(-(" + " + ".join(f"b{i} * {t}" for i, t in enumerate(x)) + "))))"
    keys = "site, label, stratum"
    parts = [f"""gok AS (
  SELECT site, label, stratum FROM (SELECT site, label, stratum, count(*) AS np, sum(missed) AS nm FROM sick GROUP BY ALL)
  JOIN (SELECT site, label, stratum, min(least(events, non_events)) AS fewest FROM icells GROUP BY ALL) USING ({keys})
  WHERE np >= 30 AND nm > 0 AND nm < np AND fewest >= 10),
gcells AS MATERIALIZED (
  SELECT {keys}, (CASE stratum WHEN 'sex' THEN sex = 'Male' ELSE age_group = '>=65' END)::INT AS m, (view = 'PA')::INT AS p,
         (CASE stratum WHEN 'sex' THEN age_group = '>=65' ELSE sex = 'Male' END)::INT AS o, count(*) AS n, sum(missed) AS y
  FROM sick JOIN gok USING ({keys}) WHERE sex IS NOT NULL AND age_group IS NOT NULL AND view IS NOT NULL GROUP BY ALL),
g_0 AS (SELECT DISTINCT {keys}, {", ".join(f"0::DOUBLE AS b{i}" for i in range(size))} FROM gcells)"""]
    betas = ", ".join(f"b{i}" for i in range(size))
    for k in range(1, steps + 1):
        sums = [f"sum({x[i]} * {x[j]} * n * {p} * (1 - {p})) AS h{i}_{j}" for i in range(size) for j in range(size)]
        sums += [f"sum({x[i]} * (y - n * {p})) AS r{i}_0" for i in range(size)]
        unit_matrix = [f"{int(i == j)}::DOUBLE AS r{i}_{j + 1}" for i in range(size) for j in range(size)]
        steps_text, solved = eliminated(f"gs{k}", f"ge{k}", size, f"{keys}, {betas}")
        moved = ", ".join(f"b{i} + {r} AS b{i}" for i, r in enumerate(solved))
        errors = ", ".join(f"sqrt(r{i}_{i + 1}) AS s{i}" for i in range(size))
        parts.append(f"""gs{k} AS MATERIALIZED (SELECT {keys}, {betas}, {", ".join(sums)}, {", ".join(unit_matrix)}
  FROM gcells JOIN g_{k - 1} USING ({keys}) GROUP BY ALL),
{steps_text},
g_{k} AS MATERIALIZED (SELECT {keys}, {moved}, {errors} FROM ge{k}_{size - 1})""")
    return ",\n".join(parts)


def ece_of(score: str, keys: str, name: str, source: str = "seen") -> str:
    return f"""{name} AS (
  SELECT {keys}, sum(n * abs(t - s)) / sum(n) AS ece FROM (
    SELECT {keys}, {ladder(score)} AS bin, count(*) AS n, avg({score}) AS s, avg(truth) AS t FROM {source} GROUP BY ALL)
  GROUP BY {keys})"""


def statements() -> dict[str, str]:
    sql: dict[str, str] = {}
    # ---- scans and loaders
    sql["scan_union"] = """SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS o_totalprice
FROM orders"""
    sql["manifest_lines"] = with_(MANIFEST, "SELECT site, name FROM names")
    sql["canonical_key"] = with_(
        MANIFEST,
        f"""SELECT DISTINCT name, {path_key("name", 1)} AS file_key, {path_key("name", 3)} AS path_key,
  CASE WHEN regexp_matches(replace(name, '\\', '/'), 'patient[0-9]+[/_]study[0-9]+[/_]view[0-9]+_[a-zA-Z]+') THEN lower(
    regexp_extract(name, 'patient([0-9]+)', 1) || '_' || regexp_extract(name, 'study([0-9]+)', 1) || '_'
    || regexp_extract(name, '(view[0-9]+_[a-zA-Z]+)', 1)) END AS pattern_key FROM names""",
    )
    positives = ", ".join(f'CASE WHEN "{n}" = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS "{n}"' for n in LABELS)
    sql["load_site_tokens"] = with_(
        IMAGES,
        f"""SELECT patient_id, image_id AS study_id, image_id, site, view_raw, true AS is_frontal, sex,
  CASE WHEN o_orderkey % 97 <> 0 THEN age END AS age, {positives} FROM images""",
    )
    sql["load_site_paths"] = with_(
        IMAGES,
        f"""SELECT 'patient' || o_orderkey AS patient_id, 'patient' || o_orderkey || '/study' || (o_orderkey % 3 + 1) AS study_id,
  image_id, site, view_raw, is_frontal, sex, age, 'train' AS source_partition, {LABEL_OR_NULL} FROM images WHERE {LABELLED}""",
    )
    sql["load_site_anchor"] = with_(
        ANCHORED,
        f"""SELECT o_custkey::VARCHAR AS patient_id, o_custkey || '/' || o_orderkey AS study_id, 'd' || o_orderkey AS image_id,
  site, view_raw, coalesce(view_raw NOT IN ('LATERAL', 'LL', 'RL'), true) AS is_frontal, sex, study_age::DOUBLE AS age,
  {LABEL_OR_NULL} FROM anchored WHERE has_labels AND has_demographics""",
    )
    sql["join_labels_attrition"] = with_(
        ANCHORED,
        """SELECT site, count(*) AS n_images, count(*) FILTER (has_labels) AS n_labelled,
  count(*) FILTER (has_labels AND has_demographics) AS n_known, count(*) FILTER (NOT has_labels) AS n_unlabelled
FROM anchored GROUP BY site""",
    )
    sql["join_attrition_by_view"] = with_(
        ANCHORED, "SELECT site, view_raw, count(*) AS n_images FROM anchored WHERE NOT has_labels GROUP BY ALL"
    )
    unlisted = " UNION ALL ".join(
        f"""SELECT site, '{n}' AS token FROM images WHERE "{n}" = 1""" for n in LABELS if n not in registry.DRIFT_SCHEMA
    )
    sql["token_drift"] = with_(IMAGES, f"SELECT site, token, count(*) AS n_rows FROM ({unlisted}) GROUP BY ALL")

    # ---- predicates and cohort
    sql["manifest_semi"] = with_(HELD, "SELECT site, patient_id, image_id, view_raw FROM kept")
    sql["verify_manifest"] = with_(
        f"""{HELD},
m AS (
  SELECT h.site, (SELECT count(*) FROM names n WHERE n.site = h.site) AS n_names, count(*) AS n_held,
         count(*) FILTER (EXISTS (SELECT 1 FROM keyed k WHERE k.site = h.site AND k.image_key = h.image_key)) AS n_match,
         (SELECT count(*) FROM images i WHERE i.site = h.site) AS n_meta,
         (SELECT count(DISTINCT image_key) FROM keyed k WHERE k.site = h.site) AS n_keys
  FROM held h GROUP BY h.site),
lost AS (
  SELECT site, string_agg(image_key, ', ' ORDER BY image_key) AS ex FROM (
    SELECT site, image_key, row_number() OVER (PARTITION BY site ORDER BY image_key) AS rn
    FROM held ANTI JOIN keyed USING (site, image_key)) WHERE rn <= 3 GROUP BY site),
j AS (SELECT m.*, ex FROM m LEFT JOIN lost USING (site))""",
        f"""SELECT site, 'held_images' AS "check", n_names::VARCHAR AS value, true AS ok, '' AS note FROM j
UNION ALL SELECT site, 'manifest_parsed', '100.0%', true, '' FROM j
UNION ALL SELECT site, 'keys_unique', n_held::VARCHAR, n_held = n_names,
  CASE WHEN n_held = n_names THEN '' ELSE 'distinct images collapse onto one key' END FROM j
UNION ALL SELECT site, 'metadata_rows', n_meta::VARCHAR, n_meta > 0, '' FROM j
UNION ALL SELECT site, 'held_matched', {percent("n_match / n_held")}, n_match / n_held >= 0.95,
  coalesce('unmatched e.g. ' || ex, '') FROM j
UNION ALL SELECT site, 'metadata_covered', {percent("n_match / n_keys")}, true,
  'metadata rows with a held image; a selection of images keeps it low' FROM j""",
    )
    sql["uncertain_nan"] = with_(IMAGES, f"SELECT patient_id, {RESOLVED} FROM images")
    zeroed = ", ".join(f'CASE WHEN "{n}" = -1 THEN 0.0 ELSE "{n}" END AS "{n}"' for n in LABELS)
    sql["uncertain_uzeros"] = with_(IMAGES, f"SELECT patient_id, {zeroed} FROM images")
    sql["no_finding"] = with_(COHORT, 'SELECT patient_id, "No Finding" FROM classified')
    sql["classify_outcome"] = with_(COHORT, "SELECT patient_id, site, outcome FROM classified")
    sql["age_bin"] = with_(IMAGES, f"SELECT patient_id, age, {BIN} AS age_bin FROM images")
    sql["age_group"] = with_(
        IMAGES,
        """SELECT patient_id, a AS age, CASE WHEN a < 65 THEN '<65' ELSE '>=65' END AS age_group
FROM (SELECT patient_id, CASE WHEN o_orderkey % 97 <> 0 THEN age END AS a FROM images)""",
    )
    sql["build_cohort"] = with_(
        f"{COHORT}, {HELD.removeprefix(IMAGES + ',')}",
        "SELECT c.* FROM cohort c SEMI JOIN kept k ON c.site = k.site AND c.image_id = k.image_id",
    )
    sql["cohort_flow"] = with_(
        f"""{COHORT},
flags AS (
  SELECT c.*, {LABELLED} AS l, o_custkey % 20 <> 0 AS d,
         EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) AS h FROM classified c),
steps AS (
  SELECT site, 0 AS step_idx, 'metadata_rows' AS step, 'population' AS kind, patient_id FROM flags
  UNION ALL SELECT site, 1, 'labels_joined', 'population', patient_id FROM flags WHERE l
  UNION ALL SELECT site, 2, 'demographics_joined', 'population', patient_id FROM flags WHERE l AND d
  UNION ALL SELECT site, 3, 'manifest_matched', 'population', patient_id FROM flags WHERE l AND d AND h
  UNION ALL SELECT site, CASE outcome WHEN 'lateral' THEN 4 WHEN 'view_missing' THEN 5 WHEN 'view_nonstandard' THEN 6 ELSE 7 END,
    'excluded_' || outcome, 'exclusion', patient_id FROM flags WHERE l AND d AND h AND outcome <> 'retained'
  UNION ALL SELECT site, 8, 'retained', 'population', patient_id FROM flags WHERE l AND d AND h AND outcome = 'retained'),
counted AS (
  SELECT site, step_idx, step, kind, count(*) AS n_images,
         count(DISTINCT patient_id) FILTER (kind = 'population') AS n_patients
  FROM steps GROUP BY site, step_idx, step, kind)""",
        """SELECT *, CASE WHEN kind = 'population' THEN coalesce(
  lag(n_images) OVER (PARTITION BY site, kind ORDER BY step_idx) - n_images, 0) END AS n_dropped FROM counted""",
    )
    sql["exclusion_summary"] = with_(COHORT, "SELECT site, outcome, count(*) AS n_images FROM classified GROUP BY ALL")
    per_site = ", ".join(f"""count(*) FILTER (site = '{s}') AS "{s}" """ for s in pop.SITES)
    sql["exclusion_pivot"] = with_(
        COHORT,
        f"""SELECT outcome, {per_site} FROM classified GROUP BY outcome
UNION ALL SELECT 'TOTAL', {per_site} FROM classified""",
    )

    # ---- cell tables
    sql["cohort_summary"] = with_(
        COHORT,
        f"""SELECT site, count(*) AS patients, {r6("avg((view = 'AP')::INT)")} AS share_ap,
  {r6("avg((sex = 'Female')::INT)")} AS share_female, median(age) AS age_median,
  {r6('avg(("No Finding" = 1)::INT)')} AS share_no_finding FROM cohort GROUP BY site""",
    )
    for key, by, levels in (
        ("view_share_age", "age_bin", pop.study().age_bin_labels), ("view_share_sex", "sex", ["Female", "Male"])
    ):
        columns = ", ".join(f"""{r6(f"avg((view = 'AP')::INT) FILTER ({by} = '{v}')")} AS "{v}" """ for v in levels)
        sql[key] = with_(COHORT, f"SELECT site, {columns} FROM cohort GROUP BY site")
    sql["positives_by_view"] = with_(
        COUNTS,
        """SELECT site, label, count(*) FILTER (view = 'AP' AND truth = 1) AS "AP",
  count(*) FILTER (view = 'PA' AND truth = 1) AS "PA" FROM clong GROUP BY ALL""",
    )
    measures = """count(*) AS n_rows, count(*) FILTER (truth = 1) AS n_positive, count(*) FILTER (truth = 0) AS n_negative,
  count(*) FILTER (truth IS NULL) AS n_missing"""
    sql["integrity_stats"] = with_(COUNTS, f"SELECT site, label, view, {measures} FROM clong GROUP BY ALL")
    sql["inferential_cells"] = with_(
        f"""{COHORT},
ilong AS (SELECT site, view, sex, age_bin, label, truth FROM cohort {UNPIVOT})""",
        f"""SELECT site, label, view, 'sex' AS stratum, sex AS level, {measures} FROM ilong GROUP BY ALL
UNION ALL SELECT site, label, view, 'age_bin', age_bin, {measures} FROM ilong GROUP BY ALL""",
    )
    sql["cell_positive_counts"] = with_(COUNTS, "SELECT * FROM counts")
    sql["thinnest_cells"] = with_(
        COUNTS,
        """SELECT site, label, view, stratum, level_a, n_a, level_b, n_b, least(n_a, n_b) AS smaller FROM counts
ORDER BY smaller, site, label, view, stratum LIMIT 10""",
    )
    sql["positive_weights"] = with_(
        COUNTS,
        f"""SELECT site, label, np AS n_positive, nn AS n_negative,
  {r6("CASE WHEN np > 0 THEN least(greatest(nn / np, 1.0), 20.0) ELSE 1.0 END")} AS weight
FROM (SELECT site, label, count(*) FILTER (truth = 1) AS np, count(*) FILTER (truth = 0) AS nn FROM clong GROUP BY ALL)""",
    )

    # ---- contracts
    columns = ["patient_id", "study_id", "image_id", "site", "view", "sex", "age", "config_hash"]
    nulls = [broken("columns.null", c, f"{c} IS NULL", "'NULL'") for c in columns]
    blanks = [
        broken("identifiers.blank", c, f"length(trim({c})) = 0", c)
        for c in ("patient_id", "study_id", "image_id", "site", "config_hash")
    ]
    views = [broken("view.invalid", "view", "view NOT IN ('AP', 'PA')", "view")]
    people = [
        broken("demographics.sex", "sex", "sex NOT IN ('Male', 'Female')", "sex"),
        broken("demographics.age_range", "age", "age < 18 OR age > 120", "age"),
    ]
    values = [
        broken("labels.values", n, f'"{n}" NOT IN (0, 1)', f'"{n}"') for n in ("Cardiomegaly", "Edema", "No Finding")
    ]
    sick = '(coalesce("Cardiomegaly" = 1, false) OR coalesce("Edema" = 1, false))'
    clash = broken("labels.no_finding_contradiction", "No Finding", f'"No Finding" = 1 AND {sick}', "image_id")
    derived = broken(
        "labels.no_finding_derivation", "No Finding", f'"No Finding" <> CASE WHEN {sick} THEN 0 ELSE 1 END', "image_id"
    )
    repeats = [repeated(c) for c in ("patient_id", "study_id", "image_id")]
    spans = broken(
        "identifiers.study_spans_patients", "study_id", "true", "v",
        "(SELECT study_id AS v FROM untidy GROUP BY 1 HAVING count(DISTINCT patient_id) > 1)",
    )
    several = {
        c: broken(f"provenance.{c}_not_constant", c, "true", "v", f"(SELECT DISTINCT {c} AS v FROM untidy)")
        for c in ("site", "config_hash")
    }

    def union(parts):
        return with_(UNTIDY, "\nUNION ALL ".join(f"({p})" for p in parts))

    sql["contract_nulls"], sql["contract_blank"], sql["contract_view"] = union(nulls), union(blanks), union(views)
    sql["contract_demo"], sql["contract_labels"] = union(people), union(values)
    sql["contract_nf"], sql["contract_nf_derive"] = union([clash]), union([derived])
    sql["contract_dup_ids"], sql["contract_study_span"] = union(repeats), union([spans])
    sql["contract_provenance"] = union(list(several.values()))

    def thin(labels, minimum, site):
        cells = [
            f"""SELECT site, '{n}' AS label, view, '{s}' AS stratum, {s} AS level, count(*) FILTER ("{n}" = 1) AS n_pos
FROM untidy GROUP BY ALL HAVING {s} IS NOT NULL AND view IS NOT NULL"""
            for n in labels for s in ("sex", "age_bin")
        ]
        shown = "site, " if site else ""
        return f"""SELECT {shown}'power.thin_cell' AS "check", label || ' x view=' || view || ' x ' || stratum || '=' || level AS subject,
  n_pos AS n_affected, '' AS examples FROM ({" UNION ALL ".join(cells)}) WHERE n_pos < {minimum}"""

    sql["contract_thin"] = union([thin(["Cardiomegaly", "Edema"], 120, True)])
    schema = """SELECT 'labels.observation_schema_not_supplied' AS "check", 'No Finding' AS subject, 2::BIGINT AS n_affected,
  '' AS examples"""
    sql["contract_all"] = union(
        [schema, *nulls, *blanks, *views, *people, *values, clash, derived, *repeats, spans, *several.values(),
         thin(["Cardiomegaly", "Edema", "No Finding"], 25, False)]
    )

    # ---- splits
    sql["assign_folds"] = with_(FOLDED, "SELECT site, patient_id, fold FROM folded")
    sql["fold_roles"] = with_(ROLES, "SELECT * FROM roles")
    sql["val_allocation"] = with_(
        f"""{FOLDED}, {plan(("view", "sex", "age_bin", '"Cardiomegaly"'), 40)}""",
        f"SELECT * REPLACE ({r6('exact')} AS exact) FROM plan",
    )
    balance = {
        "AP*": "view = 'AP'", "female*": "sex = 'Female'",
        **{f"age {b}": f"age_bin = '{b}'" for b in pop.study().age_bin_labels},
        **{n + ("*" if n == "Cardiomegaly" else ""): f'"{n}" = 1' for n in ANALYSIS},
    }
    shares = ", ".join(f"""{r6(f"avg(coalesce({t}, false)::INT)", 4)} AS "{n}" """ for n, t in balance.items())
    sql["fold_balance"] = with_(FOLDED, f"SELECT site, fold, count(*) AS n_patients, {shares} FROM folded GROUP BY ALL")
    folds = ", ".join(f"""count(*) FILTER (fold = {k}) AS "{k}" """ for k in range(5))
    each = ", ".join(f'"{k}"' for k in range(5))
    sql["cell_balance"] = with_(
        f"""{FOLDED},
blong AS (SELECT site, fold, view, sex, age_bin, label, truth FROM folded {UNPIVOT}),
pos AS (
  SELECT site, label, view, 'sex' AS stratum, sex AS level, fold FROM blong WHERE truth = 1 AND fold >= 0
  UNION ALL SELECT site, label, view, 'age_bin', age_bin, fold FROM blong WHERE truth = 1 AND fold >= 0),
wide AS (SELECT site, label, view, stratum, level, {folds} FROM pos GROUP BY ALL)""",
        f"""SELECT *, least({each}) AS "min", greatest({each}) AS "max",
  {r6('(greatest(' + each + ') - least(' + each + ')) / (("0" + "1" + "2" + "3" + "4") / 5.0::DOUBLE)', 3)} AS spread FROM wide""",
    )
    sql["validate_folds"] = with_(
        f"""{FOLDED},
sz AS (SELECT site, fold, count(*) AS n FROM folded GROUP BY ALL),
sp AS (
  SELECT site, (max(n) - min(n)) / avg(n) AS spread, '[' || string_agg(fold::VARCHAR, ', ' ORDER BY fold) || ']' AS present,
         sum(n)::BIGINT AS n FROM sz GROUP BY site),
ok AS (SELECT *, present = CASE WHEN site IN ('AMERICA', 'EUROPE') THEN '[0, 1, 2, 3, 4]' ELSE '[-1]' END AS good FROM sp)""",
        """SELECT site, 'fold_sizes_even' AS "check", printf('%.1f%%', round(spread * 100, 1)) || ' spread' AS value,
  spread < 0.05 AS ok, CASE WHEN spread < 0.05 THEN '' ELSE 'folds differ in size by >5%' END AS note
FROM sp WHERE site IN ('AMERICA', 'EUROPE')
UNION ALL SELECT site, 'fold_membership', present, good, CASE WHEN good THEN '' WHEN site IN ('AMERICA', 'EUROPE')
  THEN 'folds expected from 0 to the last' ELSE 'non-training site must be wholly external' END FROM ok
UNION ALL SELECT site, 'one_fold_per_patient', n || ' patients', true, '' FROM sp""",
    )
    sql["join_folds"] = with_(FOLDED, "SELECT site, count(*) AS n_patients, 0::BIGINT AS n_without_fold FROM folded GROUP BY site")
    sql["leakage_check"] = with_(
        ROLES,
        """SELECT site, outer_fold, count(*) AS n_patients, count(*) FILTER (n > 1) AS n_leaking
FROM (SELECT site, outer_fold, patient_id, count(*) AS n FROM roles GROUP BY ALL) GROUP BY ALL""",
    )
    sql["oof_union"] = with_(FOLDED, "SELECT site, patient_id, fold FROM folded WHERE fold >= 0")
    sql["oof_missing"] = with_(
        PREDICTIONS, "SELECT site, patient_id FROM folded ANTI JOIN preds USING (site, patient_id) WHERE fold >= 0"
    )
    sql["oof_wrong_fold"] = with_(
        PREDICTIONS,
        """SELECT p.site, p.patient_id, p.fold, f.fold AS assigned_fold FROM preds p
JOIN folded f ON p.site = f.site AND p.patient_id = f.patient_id WHERE p.fold <> f.fold""",
    )
    sql["oof_checks"] = with_(
        f"""{PREDICTIONS},
c AS (
  SELECT 'predicted_twice' AS "check", site, patient_id FROM preds GROUP BY site, patient_id HAVING count(*) > 1
  UNION ALL SELECT 'no_prediction', site, patient_id FROM folded ANTI JOIN preds USING (site, patient_id) WHERE fold >= 0
  UNION ALL SELECT DISTINCT 'wrong_fold', p.site, p.patient_id FROM preds p
    JOIN folded f ON p.site = f.site AND p.patient_id = f.patient_id WHERE p.fold <> f.fold)""",
        """SELECT s.site, k."check", count(c.patient_id) AS n_affected, count(c.patient_id) = 0 AS ok
FROM (SELECT DISTINCT site FROM preds) s
CROSS JOIN (SELECT unnest(['missing_folds', 'predicted_twice', 'no_prediction', 'wrong_fold']) AS "check") k
LEFT JOIN c ON c.site = s.site AND c."check" = k."check" GROUP BY ALL""",
    )

    # ---- metrics
    ranked = f"""{SCORES},
ranks AS (
  SELECT site, label, truth, rank() OVER (PARTITION BY site, label ORDER BY score)
         + (count(*) OVER (PARTITION BY site, label, score) - 1) / 2.0::DOUBLE AS r FROM seen),
auc AS (
  SELECT site, label, count(*) FILTER (truth = 1) AS np, count(*) FILTER (truth = 0) AS nn,
         (sum(r) FILTER (truth = 1) - count(*) FILTER (truth = 1) * (count(*) FILTER (truth = 1) + 1) / 2.0::DOUBLE)
         / nullif(count(*) FILTER (truth = 1) * count(*) FILTER (truth = 0), 0) AS auc FROM ranks GROUP BY ALL)"""
    sql["auroc_by_label"] = with_(ranked, f"SELECT site, label, np AS n_positive, nn AS n_negative, {r6('auc')} AS auroc FROM auc")
    sql["auroc_macro"] = with_(
        ranked, f"SELECT site, {r6('avg(auc)')} AS macro_auroc, count(auc) AS n_labels FROM auc GROUP BY site"
    )
    sql["brier"] = with_(
        SCORES, f"SELECT site, label, count(*) AS n, {r6('avg((score - truth) ** 2)')} AS brier FROM seen GROUP BY ALL"
    )
    clipped = "least(greatest(score, 1e-9::DOUBLE), 1 - 1e-9::DOUBLE)"
    loss = f"-avg(CASE WHEN truth = 1 THEN ln({clipped}) ELSE ln(1 - {clipped}) END)"
    sql["nll"] = with_(SCORES, f"SELECT site, label, count(*) AS n, {r6(loss)} AS nll FROM seen GROUP BY ALL")
    sql["ece"] = with_(
        f"{SCORES}, {ece_of('score', 'site, label', 'e')}", f"SELECT site, label, {r6('ece')} AS ece FROM e"
    )
    edges = bin_edges(10)
    spine = ", ".join(f"({i}, {lo!r}::DOUBLE, {hi!r}::DOUBLE)" for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)))
    sql["reliability_table"] = with_(
        f"""{SCORES},
b AS (SELECT site, label, {ladder("score")} AS bin, count(*) AS n, avg(score) AS s, avg(truth) AS t FROM seen GROUP BY ALL),
e AS (SELECT * FROM (VALUES {spine}) AS v(bin, lo, hi))""",
        f"""SELECT k.site, k.label, {r6("lo", 3)} AS bin_low, {r6("hi", 3)} AS bin_high, coalesce(n, 0) AS n,
  {r6("s")} AS mean_predicted, {r6("t")} AS observed_rate
FROM (SELECT DISTINCT site, label FROM seen) k CROSS JOIN e LEFT JOIN b ON b.site = k.site AND b.label = k.label AND b.bin = e.bin""",
    )
    sql["masked_bce"] = with_(
        SCORES,
        f"""SELECT site, label, {r6(f"avg(CASE WHEN truth = 1 THEN ln(1 + exp(-{logit('score')})) ELSE ln(1 + exp({logit('score')})) END)")}
  AS loss, count(*) AS n_observed FROM seen GROUP BY ALL""",
    )
    sql["threshold_fixed_sens"] = with_(
        f"{SCORES}, {curve('c', 'seen', 'site, label')}",
        f"""SELECT site, label, max(score) AS threshold, {r6("min(cum_pos / all_pos)")} AS achieved_sensitivity,
  any_value(all_pos)::BIGINT AS n_positive FROM c WHERE cum_pos / all_pos >= 0.9::DOUBLE GROUP BY ALL""",
    )
    sql["threshold_youden"] = with_(
        f"""{SCORES}, {curve("c", "seen", "site, label")},
j AS (SELECT *, row_number() OVER (PARTITION BY site, label ORDER BY cum_pos * all_neg - cum_neg * all_pos DESC, score DESC) AS rn FROM c)""",
        f"""SELECT site, label, score AS threshold, {r6("cum_pos / all_pos")} AS achieved_sensitivity, all_pos::BIGINT AS n_positive
FROM j WHERE rn = 1""",
    )

    # ---- calibration
    grid = ", ".join(f"({t}::DOUBLE)" for t in registry.GRID)
    sql["temperature_grid"] = with_(
        f"""{SCORES},
g AS (SELECT * FROM (VALUES {grid}) AS v(t)),
l AS (
  SELECT site, label, t, round(avg(greatest(z / t, 0) + ln(1 + exp(-abs(z / t))) - truth * z / t), 9) AS loss
  FROM (SELECT site, label, truth, {logit("score")} AS z FROM seen) CROSS JOIN g GROUP BY ALL)""",
        f"""SELECT site, label, t AS temperature, {r6("loss")} AS nll FROM (
  SELECT *, row_number() OVER (PARTITION BY site, label ORDER BY loss, t) AS rn FROM l) WHERE rn = 1""",
    )
    sql["apply_temperature"] = with_(
        SCORES, f"SELECT site, label, patient_id, {r6(scaled('score', '1.7::DOUBLE'))} AS calibrated FROM scores"
    )
    sql["apply_temperature_view"] = with_(
        SCORES,
        f"""SELECT site, label, patient_id, view,
  {r6(scaled("score", "CASE WHEN view = 'AP' THEN 1.8::DOUBLE ELSE 1.5::DOUBLE END"))} AS calibrated FROM scores""",
    )
    classes = "count(*) FILTER (truth = 1) AS np, count(*) FILTER (truth = 0) AS nn"
    pooled = f"""{newton("tp", "seen", "site, label")},
cp AS (SELECT site, label, {classes} FROM seen GROUP BY ALL)"""
    sql["fit_temperature"] = with_(
        f"{SCORES}, {pooled}",
        f"""SELECT site, label, {r6("temperature")} AS temperature, 'fitted' AS status, np AS n_positive, nn AS n_negative
FROM tp JOIN cp USING (site, label)""",
    )
    sql["view_temperatures"] = with_(
        f"""{SCORES}, {pooled}, {newton("tv", "seen", "site, label, view")},
cv AS (SELECT site, label, view, {classes} FROM seen GROUP BY ALL)""",
        f"""SELECT site, label, '__pooled__' AS view, {r6("temperature")} AS temperature, false AS pooled_fallback, np AS n_positive
FROM tp JOIN cp USING (site, label)
UNION ALL SELECT cv.site, cv.label, cv.view,
  {r6("CASE WHEN np < 60 OR nn < 25 THEN tp.temperature ELSE tv.temperature END")}, np < 60 OR nn < 25, np
FROM cv JOIN tv USING (site, label, view) JOIN tp USING (site, label)""",
    )
    fit_view = f"""{FOLD_SCORES}, {newton("fp", "val", "site, fold, label")}, {newton("fv", "val", "site, fold, label, view")},
cv AS (SELECT site, fold, label, view, {classes} FROM val GROUP BY ALL),
temps AS (
  SELECT cv.site, cv.fold, cv.label, cv.view, CASE WHEN np < 25 OR nn < 25 THEN fp.temperature ELSE fv.temperature END AS t
  FROM cv JOIN fv USING (site, fold, label, view) JOIN fp USING (site, fold, label)),
vcal AS (SELECT v.*, {scaled("score", "t")} AS calibrated FROM val v JOIN temps USING (site, fold, label, view)),
{curve("vc", "vcal", "site, fold, label", "calibrated")},
lim AS (
  SELECT site, fold, label, max(score) AS threshold, min(cum_pos / all_pos) AS reached
  FROM vc WHERE cum_pos / all_pos >= 0.9::DOUBLE GROUP BY ALL),
params AS (
  SELECT site, fold, 'view' AS arm, label, threshold, reached, max(t) FILTER (view = 'AP') AS ta, max(t) FILTER (view = 'PA') AS tp
  FROM lim JOIN temps USING (site, fold, label) GROUP BY ALL)"""
    sql["calibrate"] = with_(
        fit_view,
        f"""SELECT site, fold, arm, label, {r6("threshold")} AS threshold, {r6("reached")} AS achieved_sensitivity,
  {r6("ta")} AS "T_AP", {r6("tp")} AS "T_PA" FROM params""",
    )
    sql["temperature_summary"] = with_(
        fit_view,
        f"""SELECT site, count(*) AS n, {r6("avg(ta - tp)")} AS mean_gap, {r6("stddev_samp(ta - tp)")} AS sd_gap,
  {r6("min(ta - tp)")} AS min_gap, {r6("max(ta - tp)")} AS max_gap FROM params GROUP BY site""",
    )
    sql["decisions"] = with_(
        f"""{FOLD_SCORES}, {newton("fp", "val", "site, fold, label")},
vcal AS (SELECT v.*, {scaled("score", "temperature")} AS calibrated FROM val v JOIN fp USING (site, fold, label)),
{curve("vc", "vcal", "site, fold, label", "calibrated")},
lim AS (SELECT site, fold, label, max(score) AS threshold FROM vc WHERE cum_pos / all_pos >= 0.9::DOUBLE GROUP BY ALL),
tcal AS (SELECT t.*, {scaled("score", "temperature")} AS calibrated FROM test t JOIN fp USING (site, fold, label))""",
        f"""SELECT site, fold, label, patient_id, {r6("calibrated")} AS calibrated,
  CASE WHEN calibrated >= threshold THEN 1.0 ELSE 0.0 END::DOUBLE AS predicted FROM tcal JOIN lim USING (site, fold, label)""",
    )
    sources = ", ".join(f"('{s}')" for s in pop.study().training_sites)
    rates = f"""sum(np)::BIGINT AS n_positive, sum(nn)::BIGINT AS n_negative, {r6("sum(missed) / nullif(sum(np), 0)")} AS fnr,
  {r6("sum(wrong) / nullif(sum(nn), 0)")} AS fpr, {r6("min(missed / nullif(np, 0))")} AS fnr_low, {r6("max(missed / nullif(np, 0))")} AS fnr_high"""
    sql["transport_rates"] = with_(
        f"""{FOLD_SCORES}, {newton("fp", "val", "site, fold, label")},
vcal AS (SELECT v.*, {scaled("score", "temperature")} AS calibrated FROM val v JOIN fp USING (site, fold, label)),
{curve("vc", "vcal", "site, fold, label", "calibrated")},
lim AS (SELECT site, fold, label, max(score) AS threshold FROM vc WHERE cum_pos / all_pos >= 0.9::DOUBLE GROUP BY ALL),
strangers AS (
  SELECT src AS source_site, f::INT AS fold, g.site AS target_site, patient_id, view, age, {", ".join(f'g."{n}"' for n in ANALYSIS)}
  FROM grouped g, (VALUES {sources}) AS a(src), range({pop.study().n_folds}) AS b(f) WHERE src <> g.site),
slong AS (SELECT source_site, fold, target_site, patient_id, view, age, label, truth FROM strangers {UNPIVOT}),
sscored AS ({scored("slong", "source_site || fold")}),
judged AS (
  SELECT s.*, {scaled("score", "temperature")} >= threshold AS hit FROM sscored s
  JOIN fp ON fp.site = s.source_site AND fp.fold = s.fold AND fp.label = s.label
  JOIN lim ON lim.site = s.source_site AND lim.fold = s.fold AND lim.label = s.label),
per_fold AS (
  SELECT source_site, target_site, label, fold, coalesce(view, 'all') AS view, count(*) FILTER (truth = 1) AS np,
    count(*) FILTER (truth = 1 AND NOT hit) AS missed, count(*) FILTER (truth = 0) AS nn, count(*) FILTER (truth = 0 AND hit) AS wrong
  FROM judged GROUP BY GROUPING SETS ((source_site, target_site, label, fold, view), (source_site, target_site, label, fold)))""",
        f"SELECT source_site, target_site, label, view, {rates} FROM per_fold GROUP BY ALL",
    )
    sql["assemble_decisions"] = with_(
        SCORES,
        """SELECT site, patient_id, label, score, view, sex, age, truth FROM scores WHERE site IN ('AMERICA', 'EUROPE')""",
    )
    sql["calibration_slope"] = with_(
        f"{SCORES}, {slope_chain()}", f"SELECT site, label, {r6('b')} AS slope, {r6('a')} AS intercept FROM slopes"
    )
    cal = scaled("score", "1.7::DOUBLE")
    cal_loss = "-avg(CASE WHEN truth = 1 THEN ln(calibrated) ELSE ln(1 - calibrated) END)"
    sql["calibration_report"] = with_(
        f"""{SCORES},
paired AS (SELECT *, {cal} AS calibrated FROM seen),
{ece_of("score", "site, label", "er", "paired")}, {ece_of("calibrated", "site, label", "ec", "paired")},
{ece_of("calibrated", "site, label, view", "ev", "paired")}, {slope_chain()},
basic AS (
  SELECT site, label, avg((score - truth) ** 2) AS br, {loss} AS nr, avg((calibrated - truth) ** 2) AS bc, {cal_loss} AS nc
  FROM paired GROUP BY ALL)""",
        f"""SELECT site, label, {r6("br")} AS brier_raw, {r6("nr")} AS nll_raw, {r6("bc")} AS brier_calibrated,
  {r6("nc")} AS nll_calibrated, {r6("er.ece")} AS ece_raw, {r6("ec.ece")} AS ece_calibrated,
  {r6("va.ece")} AS "ece_AP", {r6("vp.ece")} AS "ece_PA", {r6("s.b")} AS slope_raw, {r6("s.a")} AS intercept_raw,
  {r6("s.b * 1.7")} AS slope_calibrated, {r6("s.a")} AS intercept_calibrated
FROM basic JOIN er USING (site, label) JOIN ec USING (site, label) JOIN slopes s USING (site, label)
LEFT JOIN (SELECT * FROM ev WHERE view = 'AP') va USING (site, label)
LEFT JOIN (SELECT * FROM ev WHERE view = 'PA') vp USING (site, label)""",
    )

    # ---- fairness
    sql["fnr_overall"] = with_(
        DECIDED,
        f"""SELECT site, label, count(*) FILTER (truth = 1) AS positives,
  {r6("avg((predicted = 0)::INT) FILTER (truth = 1)")} AS fnr FROM decided GROUP BY ALL""",
    )
    sql["flagged_rate"] = with_(
        DECIDED, f"SELECT site, label, {r6('avg((predicted = 1)::INT)')} AS flagged FROM decided GROUP BY ALL"
    )
    sql["group_gap"] = with_(DECIDED, gaps())
    sql["within_view_gaps"] = with_(DECIDED, gaps("view"))
    sql["standardised_rate"] = with_(
        f"{DECIDED}, {mixed({'AP': 0.4, 'PA': 0.6})}",
        f"SELECT {KEYS}, {r6('sa')} AS std_rate_a, {r6('sb')} AS std_rate_b FROM mixed",
    )
    sql["standardised_gap"] = with_(
        f"{DECIDED}, {mixed({'AP': 0.5, 'PA': 0.5})}", f"SELECT {KEYS}, {r6('sb - sa')} AS gap_standardised FROM mixed"
    )
    positivity = f"{DECIDED}, {positivity_of({'AP': 0.8, 'PA': 0.2}, 45, 0.3)}"
    sql["positivity_report"] = with_(positivity, "SELECT * EXCLUDE (pos) FROM detail")
    sql["positivity_verdict"] = with_(
        positivity, "SELECT * FROM positive",
    )
    positivity_ok = positivity_of(pop.study().reference_mix, 10, 0.3)
    sql["bootstrap_gap"] = with_(
        f"{DECIDED}, {resampled({'AP': 0.5, 'PA': 0.5})}",
        f"""SELECT {KEYS}, g.view, rate_a, rate_b, n_a, n_b, gap, {r6("CASE WHEN usable >= 100 THEN g_l END")} AS ci_low,
  {r6("CASE WHEN usable >= 100 THEN g_h END")} AS ci_high, coalesce(usable >= 100 AND (g_l > 0 OR g_h < 0), false) AS significant
FROM (SELECT *, 'both' AS view FROM ({gaps()}) UNION ALL BY NAME FROM ({gaps("view")}) WHERE view IS NOT NULL) g
LEFT JOIN bfolded b USING ({KEYS}) WHERE g.view = b.scope OR b.scope IS NULL""",
    )
    delta = f"""SELECT {KEYS}, n_a, n_b, {r6("gap")} AS gap_raw, {r6("std")} AS gap_standardised,
  {", ".join(f"{r6(f'{n}_{e}')} AS {long}_ci_{end}" for n, long in (("r", "raw"), ("s", "std"), ("d", "delta")) for e, end in (("l", "low"), ("h", "high")))},
  paired AS usable_replicates, positivity_ok, positivity_note, {r6("delta")} AS delta, {verdict(0.02)} AS verdict,
  0.02::DOUBLE AS equivalence_margin, 2000 AS attempted_replicates FROM intervals JOIN positive USING ({KEYS})"""
    sql["delta_gap"] = sql["analyse_label"] = with_(f"{INTERVALS}, {positivity_ok}", delta)
    sql["verdict"] = with_(INTERVALS, f"SELECT site, label, stratum, {r6('delta')} AS delta, {verdict(0.02)} AS verdict FROM intervals")
    named = ", ".join(f'{verdict(m)} AS "margin={m}"' for m in registry.MARGINS)
    first, second, third = (verdict(m) for m in registry.MARGINS)
    sql["verdict_sensitivity"] = with_(
        INTERVALS,
        f"SELECT site, label, stratum, {named}, ({first}) = ({second}) AND ({second}) = ({third}) AS stable FROM intervals",
    )
    sql["replication"] = with_(
        INTERVALS,
        f"""SELECT label, stratum, count(DISTINCT v) = 1 AS same_verdict, count(DISTINCT sign(delta)) = 1 AS same_direction,
  string_agg(DISTINCT v, ', ' ORDER BY v) AS verdicts
FROM (SELECT *, {verdict(0.02)} AS v FROM intervals WHERE site IN ('AMERICA', 'EUROPE')) GROUP BY ALL""",
    )

    split = f"""{SCORES},
levels AS (
  SELECT site, label, 'sex' AS stratum, 'Female' AS level_a, 'Male' AS level_b, sex AS level, patient_id, score, truth FROM seen
  UNION ALL SELECT site, label, 'age_group', '<65', '>=65', age_group, patient_id, score, truth FROM seen),
sides AS (SELECT *, CASE level WHEN level_a THEN 'a' WHEN level_b THEN 'b' END AS side FROM levels WHERE level IN (level_a, level_b)),
sizes AS (SELECT DISTINCT {KEYS} FROM sides)"""
    pairs = f"""{split},
placed AS (
  SELECT p.site, p.label, p.stratum, p.side, p.patient_id AS pos, n.patient_id AS neg, (n.score < p.score)::INT + 0.5 * (n.score = p.score)::INT AS won
  FROM sides p JOIN sides n USING (site, label, stratum, side) WHERE p.truth = 1 AND n.truth = 0),
v10 AS (SELECT site, label, stratum, side, pos, avg(won) AS v FROM placed GROUP BY ALL),
v01 AS (SELECT site, label, stratum, side, neg, avg(won) AS v FROM placed GROUP BY ALL),
areas AS (
  SELECT site, label, stratum, side, auc, vp + vn AS variance
  FROM (SELECT site, label, stratum, side, avg(v) AS auc, var_samp(v) / count(*) AS vp FROM v10 GROUP BY ALL)
  JOIN (SELECT site, label, stratum, side, var_samp(v) / count(*) AS vn FROM v01 GROUP BY ALL) USING (site, label, stratum, side)),
numbers AS (SELECT {KEYS}, {", ".join(f"count(*) FILTER (side = '{x}' AND truth = {t}) AS n_{w}_{x}" for w, t in (("positive", 1), ("negative", 0)) for x in "ab")}
  FROM sides GROUP BY ALL),
ab AS (
  SELECT n.*, a.auc AS aa, b.auc AS ab, b.auc - a.auc AS gap, sqrt(a.variance + b.variance) AS se FROM numbers n
  LEFT JOIN (SELECT * FROM areas WHERE side = 'a') a USING (site, label, stratum)
  LEFT JOIN (SELECT * FROM areas WHERE side = 'b') b USING (site, label, stratum))"""
    sql["auroc_gap"] = with_(
        pairs,
        f"""SELECT {KEYS}, n_positive_a, n_positive_b, n_negative_a, n_negative_b, {r6("aa")} AS auroc_a, {r6("ab")} AS auroc_b, {r6("gap")} AS gap,
  {r6("se")} AS std_error, {r6(f"gap - {Z95} * se")} AS ci_low, {r6(f"gap + {Z95} * se")} AS ci_high, {r6(two_sided("(gap / se)"))} AS p_value FROM ab""",
    )
    sql["auprc_gap"] = with_(
        f"""{split},
ranked AS (
  SELECT {KEYS}, side, truth, sum(truth) OVER w AS tp, count(*) OVER w AS n, sum(truth) OVER (PARTITION BY {KEYS}, side) AS m
  FROM sides WINDOW w AS (PARTITION BY {KEYS}, side ORDER BY score DESC RANGE UNBOUNDED PRECEDING)),
ap AS (SELECT {KEYS}, side, CASE WHEN any_value(m) > 0 AND any_value(m) < count(*) THEN sum(tp / n) FILTER (truth = 1) / any_value(m) END AS ap, any_value(m) / count(*) AS share
  FROM ranked GROUP BY ALL)""",
        f"""SELECT {KEYS}, {r6("a.ap")} AS auprc_a, {r6("b.ap")} AS auprc_b, {r6("b.ap - a.ap")} AS gap, {r6("a.share")} AS prevalence_a,
  {r6("b.share")} AS prevalence_b FROM sizes LEFT JOIN (SELECT * FROM ap WHERE side = 'a') a USING ({KEYS})
LEFT JOIN (SELECT * FROM ap WHERE side = 'b') b USING ({KEYS})""",
    )

    # ---- models and families
    sql["interaction_cells"] = with_(
        INTERACTION,
        """SELECT *, CASE WHEN least(events, non_events) = 0 THEN 'separated' WHEN least(events, non_events) < 10 THEN 'thin'
  ELSE 'usable' END AS state FROM icells""",
    )
    sql["interaction_closed"] = with_(
        INTERACTION,
        f"""SELECT site, label, stratum, {r6("b")} AS coefficient, {r6("exp(b)")} AS odds_ratio,
  {r6(f"exp(b - {Z95} * se)")} AS ci_low, {r6(f"exp(b + {Z95} * se)")} AS ci_high, {r6("p")} AS p_value FROM tests""",
    )
    main = {"sex": ("C(sex)[T.Male]", "C(age_group)[T.>=65]"), "age_group": ("C(age_group)[T.>=65]", "C(sex)[T.Male]")}
    named = [(s, i, t) for s, (m, o) in main.items() for i, t in enumerate(("Intercept", m, "C(view)[T.PA]", o, f"{m}:C(view)[T.PA]"))]
    fitted = [
        f"""SELECT label, site, stratum, '{t}' AS term, {r6(f"b{i}")} AS coefficient, {r6(f"exp(b{i})")} AS odds_ratio,
  {r6(f"exp(b{i} - {Z95} * s{i})")} AS ci_low, {r6(f"exp(b{i} + {Z95} * s{i})")} AS ci_high, {r6(two_sided(f"(b{i} / s{i})"))} AS p_value,
  {":" in t} AS is_interaction FROM g_12 WHERE stratum = '{s}'"""
        for s, i, t in named
    ]
    sql["interaction_glm"] = with_(f"{INTERACTION}, {interaction_chain()}", " UNION ALL ".join(fitted))
    noted = f"""{INTERACTION},
tot AS (SELECT site, label, stratum, count(*) AS np, sum(missed) AS nm FROM sick GROUP BY ALL),
st AS (
  SELECT site, label, stratum, count(*) AS nc, count(*) FILTER (least(events, non_events) = 0) AS ns,
         count(*) FILTER (least(events, non_events) BETWEEN 1 AND 9) AS nt FROM icells GROUP BY ALL),
noted AS (SELECT site, label, stratum, CASE WHEN np < 30 THEN np || ' positives are too few'
  WHEN nm = 0 OR nm = np THEN 'the model made no errors, or only errors'
  WHEN ns > 0 THEN 'separation in ' || ns || ' of ' || nc || ' cells'
  WHEN nt > 0 THEN 'fewer than 10 events or non-events in ' || nt || ' of ' || nc || ' cells' END AS note
FROM tot LEFT JOIN st USING (site, label, stratum))"""
    sql["interaction_notes"] = with_(noted, "SELECT * FROM noted")
    sql["analysis_notes"] = with_(
        f"{noted}, {positivity_ok}",
        """SELECT site, label, stratum, 'interaction model not fitted: ' || note AS note FROM noted WHERE note IS NOT NULL
UNION ALL SELECT site, label, stratum, 'positivity: ' || positivity_note FROM positive WHERE NOT positivity_ok""",
    )
    order = "PARTITION BY site ORDER BY p, label, stratum"
    ranks = f"""{INTERACTION},
ord AS (SELECT *, row_number() OVER ({order}) AS rn, count(*) OVER (PARTITION BY site) AS m FROM tests)"""
    sql["holm"] = with_(
        f"""{ranks},
adj AS (SELECT *, least(1.0, max((m - rn + 1) * p) OVER (PARTITION BY site ORDER BY rn)) AS a FROM ord)""",
        f"SELECT site, label, stratum, {r6('p')} AS p_value, {r6('a')} AS p_adjusted, a < 0.05 AS reject FROM adj",
    )
    sql["benjamini_hochberg"] = with_(
        f"""{ranks},
adj AS (SELECT *, least(1.0, min(m / rn * p) OVER (PARTITION BY site ORDER BY rn DESC)) AS a FROM ord)""",
        f"SELECT site, label, stratum, {r6('p')} AS p_value, {r6('a')} AS p_adjusted, a < 0.05 AS reject FROM adj",
    )

    terms = [
        f"""SELECT site, '{name}' AS term, {r6(f"exp({b})")} AS odds_ratio, {r6(f"exp({b} - {Z95} * {se})")} AS ci_low,
  {r6(f"exp({b} + {Z95} * {se})")} AS ci_high, {r6(two_sided(f"({b} / {se})"))} AS p_value FROM c_12"""
        for name, b, se in (("age_decade", "b1", "s1"), ("C(sex)[T.Male]", "b2", "s2"))
    ]
    sql["coupling_logit"] = with_(f"{COHORT}, {coupling_chain()}", " UNION ALL ".join(terms))

    # ---- power
    critical = quantile(0.975)
    z = "(0.12::DOUBLE / sqrt(0.21::DOUBLE / n_a + 0.2436::DOUBLE / n_b))"
    sql["closed_form_power"] = with_(
        COUNTS,
        f"""SELECT *, {r6(f'''CASE WHEN least(n_a, n_b) < 1 THEN 0.0 ELSE ({normal_cdf(f"({z} - {critical!r}::DOUBLE)")})
  + ({normal_cdf(f"(-{z} - {critical!r}::DOUBLE)")}) END''')} AS power FROM counts""",
    )
    cells = f"{COUNTS}, {evaluated('cells', 0.30)}"
    sql["powered_summary"] = with_(
        cells,
        """SELECT site, stratum, count(*) FILTER (powered) AS n_powered, count(*) AS n_cells, bool_and(powered) AS all_powered
FROM cells GROUP BY ALL""",
    )
    sql["coarsening_ladder"] = with_(
        cells,
        """SELECT label, CASE WHEN bool_and(powered) THEN 'none' ELSE 'demote_label_to_exploratory' END AS rung
FROM cells WHERE site IN ('AMERICA', 'EUROPE') GROUP BY label""",
    )
    sql["assign_tiers"] = with_(
        f"{cells}, {tiers('t', 'cells')}",
        f"SELECT * REPLACE ({r6('worst_mde')} AS worst_mde, {r6('median_mde')} AS median_mde) FROM t",
    )
    grids = ", ".join(
        f"{evaluated(f'c{i}', b)}, {tiers(f't{i}', f'c{i}')}" for i, b in enumerate(registry.BASELINES)
    )
    columns = ", ".join(f't{i}.tier AS "FNR={b:.0%}"' for i, b in enumerate(registry.BASELINES))
    same = " AND ".join(f"t0.tier = t{i}.tier" for i in range(1, len(registry.BASELINES)))
    joins = " ".join(f"JOIN t{i} USING (label)" for i in range(1, len(registry.BASELINES)))
    sql["tier_sensitivity"] = with_(f"{COUNTS}, {grids}", f"SELECT label, {columns}, {same} AS stable FROM t0 {joins}")

    sql["evaluate_cells"] = with_(
        f"{COUNTS}, {evaluated('cells', 0.30, 0.12)}", f"SELECT * REPLACE ({r6('mde')} AS mde) FROM cells"
    )
    gate = pop.study().analysis["power"]
    sql["study_tiers"] = with_(
        f"""{COUNTS}, {evaluated('cells', gate['assumed_baseline_fnr'], gate['meaningful_effect'])},
{tiers('t', 'cells', tuple(pop.study().secondary_lane))}""",
        f"SELECT * REPLACE ({r6('worst_mde')} AS worst_mde, {r6('median_mde')} AS median_mde) FROM t",
    )

    # ---- image index
    words = ", ".join(
        f"sum(('0x' || substr(sha256(image_id), {8 * i + 1}, 8))::UBIGINT) AS w{i}" for i in range(4)
    )
    sql["cohort_fingerprint"] = with_(
        COHORT,
        f"""SELECT site, n, substr(sha256(n || ':' || w0 || ':' || w1 || ':' || w2 || ':' || w3), 1, 16) AS fingerprint
FROM (SELECT site, count(*) AS n, {words} FROM cohort GROUP BY site)""",
    )
    sql["cache_layout"] = with_(LAYOUT, "SELECT * FROM index")
    sql["cache_lookup"] = with_(
        LAYOUT,
        "SELECT i.o_orderkey AS pos, i.image_id, x.shard, x.row FROM images i LEFT JOIN index x ON i.image_id = x.image_id",
    )
    lines = """WITH lines AS (SELECT event_type, CASE WHEN event_id % 50 = 7 THEN left(props, length(props) - 1) WHEN event_id % 70 = 3 THEN '  '
  WHEN event_id % 9 = 1 THEN '{"id": ' || event_id || ', ' || substr(props, 2) ELSE props END AS value FROM events),
marked AS (SELECT *, coalesce(trim(value) = '', true) AS blank,
  CASE WHEN NOT coalesce(trim(value) = '', true) AND NOT json_valid(value) THEN value END AS bad FROM lines)"""
    sql["broken_records"] = f"""{lines},
report AS (SELECT event_type, count(*) AS n_lines, count(*) FILTER (blank) AS n_blank, count(bad) AS n_broken,
  [min(bad), max(bad), min_by(bad, md5(bad))] AS picked FROM marked GROUP BY ALL)
SELECT event_type, n_lines, n_blank, n_broken,
  coalesce(array_to_string(list_sort(list_distinct(list_filter(picked, lambda x: x IS NOT NULL))), ' | '), '') AS examples FROM report"""
    sql["record_fields"] = f"""{lines}
SELECT event_type, field, count(*) AS n_lines FROM (
  SELECT event_type, unnest(json_keys(value)) AS field FROM marked WHERE NOT blank AND bad IS NULL) GROUP BY ALL"""
    sql["random_read"] = "SELECT page_id AS pos, 'page' || page_id AS image_id, md5(html) AS digest FROM pages WHERE page_id % 100 = 0"
    sql["cache_verify"] = with_(
        f"{LAYOUT}, {HELD.removeprefix(IMAGES + ',')}",
        """SELECT "check", n_affected, n_affected = 0 AS ok FROM (
  SELECT 'identifiers_unique' AS "check", count(*) - count(DISTINCT image_id) AS n_affected FROM index
  UNION ALL SELECT 'positions_unique', count(*) - count(DISTINCT (shard, row)) FROM index
  UNION ALL SELECT 'covers_cohort', count(*) FROM kept k ANTI JOIN index USING (image_id)
  UNION ALL SELECT 'no_extra_images', count(*) FROM index ANTI JOIN kept USING (image_id))""",
    )
    collisions = [
        f"""SELECT {path_key("image_id", d)} AS image_key, count(*) AS n_names, min(image_id) AS example, {d} AS depth
FROM images GROUP BY 1 HAVING count(*) > 1"""
        for d in (1, 2, 3)
    ]
    sql["key_collisions"] = with_(IMAGES, " UNION ALL ".join(f"({c})" for c in collisions))
    return sql
