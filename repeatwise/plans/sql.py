"""Shared DuckDB CTE texts used by several oracles."""

from __future__ import annotations


def tract_ctes(view: str, keys: str, prefix: str = "", seq: str = "seq", min_length: int = 8, min_units: int = 3) -> list[str]:
    """Tract detection as window islands: CTE ``tracts`` with keys, start, stop, length, unit."""
    p = prefix
    lags = ", ".join(f"lag(b, {i}) OVER w AS l{i}" for i in range(1, 7))
    pick = " ".join(f"WHEN {i} THEN l{i}" for i in range(1, 7))
    return [
        f"{p}bases AS MATERIALIZED (SELECT {keys}, unnest(string_split({seq}, '')) AS b, unnest(range(1, length({seq}) + 1)) AS i FROM {view})",
        f"{p}lagged AS MATERIALIZED (SELECT {keys}, i, b, {lags} FROM {p}bases WINDOW w AS (PARTITION BY {keys} ORDER BY i))",
        f"{p}same AS (SELECT {keys}, i, p FROM {p}lagged, (VALUES (1), (2), (3), (4), (5), (6)) t(p) WHERE b IN ('A', 'C', 'G', 'T') AND b = CASE p {pick} END)",
        f"{p}runs AS (SELECT {keys}, p, MIN(i) - p AS start, MAX(i) AS stop FROM (SELECT *, i - row_number() OVER (PARTITION BY {keys}, p ORDER BY i) AS g FROM {p}same) GROUP BY {keys}, p, g HAVING COUNT(*) >= 6)",
        f"{p}least AS (SELECT {keys}, start, stop, MIN(p) AS p FROM {p}runs GROUP BY {keys}, start, stop)",
        f"{p}tracts AS MATERIALIZED (SELECT {keys}, start, stop, stop - start + 1 AS length, substring({seq}, CAST(start AS BIGINT), CAST(p AS BIGINT)) AS unit FROM {p}least JOIN {view} USING ({keys}) "
        f"WHERE stop - start + 1 >= {min_length} AND (stop - start + 1) // p >= {min_units})",
    ]


ISLANDS = """spread AS (SELECT {k}, start, stop, MAX(stop) OVER (PARTITION BY {k} ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {t}),
  islands AS (SELECT {k}, MIN(start) AS start, MAX(stop) AS stop FROM (SELECT *, SUM(CASE WHEN reach IS NULL OR start > reach + 1 THEN 1 ELSE 0 END)
    OVER (PARTITION BY {k} ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS g FROM spread) GROUP BY {k}, g)"""


def island_ctes(keys: str, tracts: str = "tracts") -> list[str]:
    return [ISLANDS.format(k=keys, t=tracts)]


def index_ctes(key: str) -> list[str]:
    return [
        f"offset_index AS MATERIALIZED (SELECT {key}, stop - removed + 1 AS position, removed AS \"offset\" FROM (SELECT {key}, stop, "
        f"SUM(stop - start + 1) OVER (PARTITION BY {key} ORDER BY start ROWS UNBOUNDED PRECEDING) AS removed FROM islands))"
    ]


def genotype_ctes() -> list[str]:
    """Packed genotype input in long form: allele ranks, people, pairs and ``st`` (one row per person and pair)."""
    return [
        "tot AS (SELECT locus_id, allele_len, SUM(n) AS t FROM allele_cov GROUP BY locus_id, allele_len)",
        "rk AS MATERIALIZED (SELECT locus_id, allele_len, t, row_number() OVER (PARTITION BY locus_id ORDER BY t DESC, allele_len) AS r FROM tot)",
        "kk AS (SELECT locus_id, MAX(r) AS k, SUM(t) AS locus_total FROM rk GROUP BY locus_id)",
        "pt AS (SELECT locus_id, person_id, SUM(n) AS total FROM allele_cov GROUP BY locus_id, person_id)",
        "pe AS MATERIALIZED (SELECT e.locus_id, e.person_id, CAST(e.exp_cov AS DOUBLE) AS exp_raw, greatest(CAST(e.exp_cov AS DOUBLE), 1.0) AS exp_cov, CAST(COALESCE(total, 0) AS DOUBLE) AS total FROM expected e LEFT JOIN pt USING (locus_id, person_id))",
        "cn AS MATERIALIZED (SELECT p.locus_id, p.person_id, rk.r, CAST(COALESCE(a.n, 0) AS DOUBLE) AS n FROM pe p JOIN rk USING (locus_id) LEFT JOIN allele_cov a ON a.locus_id = p.locus_id AND a.person_id = p.person_id AND a.allele_len = rk.allele_len)",
        "prs AS (SELECT locus_id, k, a.r AS r1, b.r AS r2, row_number() OVER (PARTITION BY locus_id ORDER BY b.r, a.r) - 1 AS pair_no FROM kk, (SELECT unnest(range(1, 200)) AS r) a, (SELECT unnest(range(1, 200)) AS r) b WHERE a.r <= b.r AND b.r <= k + 1)",
        """st AS MATERIALIZED (SELECT *, total - a1 - a2 AS err FROM (SELECT p.locus_id, p.person_id, k, pair_no, r1, r2, total, exp_cov, COALESCE(x.n, 0) AS a1,
          CASE WHEN r1 < r2 THEN COALESCE(y.n, 0) ELSE 0 END AS a2, CASE WHEN r1 > k THEN 0 WHEN r1 = r2 THEN 2 ELSE 1 END AS c1, CASE WHEN r1 < r2 AND r2 <= k THEN 1 ELSE 0 END AS c2
          FROM pe p JOIN prs USING (locus_id) LEFT JOIN cn x ON x.locus_id = p.locus_id AND x.person_id = p.person_id AND x.r = r1 LEFT JOIN cn y ON y.locus_id = p.locus_id AND y.person_id = p.person_id AND y.r = r2))""",
    ]


def log_likelihood(b1: str, b2: str, eps: str) -> str:
    return (
        f"(CASE WHEN c1 = 0 THEN 0 ELSE a1 * ln(c1 * exp_cov * {b1}) - c1 * exp_cov * {b1} - lgamma(a1 + 1) END + CASE WHEN c2 = 0 THEN 0 ELSE a2 * ln(exp_cov * {b2}) - exp_cov * {b2} - lgamma(a2 + 1) END"
        f" + lgamma(total + 1) - lgamma(err + 1) - lgamma(total - err + 1) + CASE WHEN err > 0 THEN err * ln({eps}) ELSE 0 END + CASE WHEN total - err > 0 THEN (total - err) * ln(greatest(1 - {eps}, 1e-300)) ELSE 0 END)"
    )


def posterior_ctes(eps: float) -> list[str]:
    """Memberships at weight 1, bias 1 and a given error rate: CTE ``post``."""
    return genotype_ctes() + [
        f"lk AS MATERIALIZED (SELECT *, {log_likelihood('1.0', '1.0', repr(eps))} AS ll FROM st)",
        "post AS MATERIALIZED (SELECT *, CASE WHEN z > 0 THEN exp(ll) / z WHEN r1 = k + 1 THEN 1.0 ELSE 0.0 END AS p FROM (SELECT *, SUM(exp(ll)) OVER (PARTITION BY locus_id, person_id) AS z FROM lk))",
    ]


def em_ctes(rounds: int = 25, delta: float = 10.0) -> list[str]:
    """The whole fit, unrolled: CTEs ``m_end`` (locus), ``w_end`` (pairs), ``b_end`` (alleles)."""
    ctes = genotype_ctes() + [
        "m0 AS MATERIALIZED (SELECT locus_id, k, locus_total, 0.001::DOUBLE AS eps, 0.001::DOUBLE AS eps_used, NULL::DOUBLE AS old, 0 AS n_iter, TRUE AS active FROM kk)",
        "w0 AS MATERIALIZED (SELECT locus_id, pair_no, r1, r2, 1.0::DOUBLE AS w, 1.0::DOUBLE AS w_used FROM prs)",
        "b0 AS MATERIALIZED (SELECT locus_id, r, 1.0::DOUBLE AS b, 1.0::DOUBLE AS b_used FROM rk)",
    ]
    for t in range(rounds + 1):
        go = "TRUE" if t == 0 else f"(abs(score - old) > {delta} AND n_iter < {rounds} AND eps < 0.4)"
        old = f"score + {2 * delta}" if t == 0 else "score"
        ctes += [
            f"l{t} AS MATERIALIZED (SELECT *, SUM(w * exp(ll)) OVER (PARTITION BY locus_id, person_id) AS z FROM (SELECT st.*, w, {log_likelihood('COALESCE(x.b, 1)', 'COALESCE(y.b, 1)', 'eps')} AS ll "
            f"FROM st JOIN m{t} m USING (locus_id) JOIN w{t} ww USING (locus_id, pair_no) LEFT JOIN b{t} x ON x.locus_id = st.locus_id AND x.r = st.r1 LEFT JOIN b{t} y ON y.locus_id = st.locus_id AND y.r = st.r2 WHERE m.active))",
            f"s{t} AS MATERIALIZED (SELECT locus_id, pair_no, r1, r2, SUM(p) / COUNT(*) AS nw, SUM(p * err) AS e, SUM(p * total) AS tt, SUM(p * a1) AS n1, SUM(p * c1 * exp_cov) AS d1, SUM(p * a2) AS n2, SUM(p * c2 * exp_cov) AS d2, "
            f"SUM(CASE WHEN w > 0 THEN w * ll ELSE 0 END) AS score FROM (SELECT *, CASE WHEN z > 0 THEN w * exp(ll) / z WHEN r1 = k + 1 THEN 1.0 ELSE 0.0 END AS p FROM l{t}) GROUP BY ALL)",
            f"g{t} AS MATERIALIZED (SELECT m.*, score, CASE WHEN v > 0 THEN v ELSE 1.0 / locus_total END AS ne, {go} AS go FROM m{t} m JOIN (SELECT locus_id, SUM(score) AS score, SUM(nw * e) / SUM(nw * tt) AS v FROM s{t} GROUP BY locus_id) USING (locus_id) WHERE active)",
            f"nb{t} AS MATERIALIZED (SELECT locus_id, r, greatest(COALESCE(CASE WHEN SUM(d) > 0 THEN SUM(n) / SUM(d) END, 0), 1e-7) AS nb FROM (SELECT locus_id, r1 AS r, nw * n1 AS n, nw * d1 AS d FROM s{t} UNION ALL SELECT locus_id, r2, nw * n2, nw * d2 FROM s{t} WHERE r1 < r2) GROUP BY locus_id, r)",
            f"m{t + 1} AS MATERIALIZED (SELECT locus_id, k, locus_total, CASE WHEN go THEN ne ELSE eps END AS eps, CASE WHEN go THEN eps ELSE eps_used END AS eps_used, CASE WHEN go THEN {old} ELSE score END AS old, CASE WHEN go THEN n_iter + 1 ELSE n_iter END AS n_iter, go AS active FROM g{t} "
            f"UNION ALL SELECT locus_id, k, locus_total, eps, eps_used, old, n_iter, active FROM m{t} WHERE NOT active)",
            f"w{t + 1} AS MATERIALIZED (SELECT w.locus_id, w.pair_no, w.r1, w.r2, CASE WHEN go THEN nw ELSE w END AS w, CASE WHEN go THEN w ELSE w_used END AS w_used FROM w{t} w LEFT JOIN g{t} USING (locus_id) LEFT JOIN s{t} USING (locus_id, pair_no))",
            f"b{t + 1} AS MATERIALIZED (SELECT b.locus_id, b.r, CASE WHEN go THEN nb ELSE b END AS b, CASE WHEN go THEN b ELSE b_used END AS b_used FROM b{t} b LEFT JOIN g{t} USING (locus_id) LEFT JOIN nb{t} USING (locus_id, r))",
        ]
    n = rounds + 1
    return ctes + [f"m_end AS (SELECT * FROM m{n})", f"w_end AS (SELECT * FROM w{n})", f"b_end AS (SELECT * FROM b{n})"]


POISSON = (
    "CASE WHEN {rate} = 0 THEN CASE WHEN {x} = 0 THEN 1.0 ELSE 0.0 END ELSE list_sum(list_transform(range(0, 400), lambda i: CASE WHEN i * ln({rate}) - {rate} - lgamma(i + 1) "
    "<= {x} * ln({rate}) - {rate} - lgamma({x} + 1) + ln(1 + 1e-7) THEN exp(i * ln({rate}) - {rate} - lgamma(i + 1)) ELSE 0 END)) END"
)
BINOMIAL = (
    "CASE WHEN total = 0 THEN 0.0 WHEN err = 0 THEN 1.0 ELSE list_sum(list_transform(range(CAST(err AS BIGINT), CAST(total AS BIGINT) + 1), lambda i: "
    "exp(lgamma(total + 1) - lgamma(i + 1) - lgamma(total - i + 1) + i * ln(eps) + (total - i) * ln(1 - eps)))) END"
)


def call_ctes(post: str, source: str) -> list[str]:
    """Genotype records ``geno`` from memberships ``post``; ``source`` gives ``eps, n_iter`` per locus and biases per rank."""
    return [
        f"called AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY locus_id, person_id ORDER BY round(p, 9) DESC, pair_no) AS pick, MAX(p) OVER g AS confidence, "
        f"SUM(CASE WHEN r2 = k + 1 THEN p ELSE 0 END) OVER g AS p_null FROM {post} WINDOW g AS (PARTITION BY locus_id, person_id)) WHERE pick = 1)",
        f"rated AS MATERIALIZED (SELECT c.*, m.eps, m.n_iter, pe.exp_raw, c.c1 * c.exp_cov * COALESCE(x.b, 1) AS rate1, c.c2 * c.exp_cov * COALESCE(y.b, 1) AS rate2, COALESCE(l1.allele_len, -1) AS allele_1, COALESCE(l2.allele_len, -1) AS allele_2 "
        f"FROM called c JOIN {source}_m m USING (locus_id) JOIN pe USING (locus_id, person_id) LEFT JOIN {source}_b x ON x.locus_id = c.locus_id AND x.r = c.r1 LEFT JOIN {source}_b y ON y.locus_id = c.locus_id AND y.r = c.r2 "
        f"LEFT JOIN rk l1 ON l1.locus_id = c.locus_id AND l1.r = c.r1 LEFT JOIN rk l2 ON l2.locus_id = c.locus_id AND l2.r = c.r2)",
        f"geno AS MATERIALIZED (SELECT locus_id, person_id, CAST(allele_1 AS INT) AS allele_1, CAST(allele_2 AS INT) AS allele_2, confidence, CAST(a1 AS BIGINT) AS allele_1_cov, CAST(a2 AS BIGINT) AS allele_2_cov, CAST(err AS BIGINT) AS rest_cov, "
        f"exp_raw AS exp_allele_cov, eps * total AS exp_err, p_null, ({POISSON.format(rate='rate1', x='a1')}) * ({POISSON.format(rate='rate2', x='a2')}) AS allele_fit, {BINOMIAL} AS noise_fit, "
        f"CAST(total AS BIGINT) AS total, eps, CAST(n_iter AS INT) AS n_iter FROM rated)",
    ]


START_EPS = 0.01


def start_calls() -> list[str]:
    """Genotype records of the unfitted model at error rate 0.01."""
    return posterior_ctes(START_EPS) + [
        f"start_m AS (SELECT locus_id, {START_EPS}::DOUBLE AS eps, 0 AS n_iter FROM kk)", "start_b AS (SELECT locus_id, r, 1.0::DOUBLE AS b FROM rk)",
    ] + call_ctes("post", "start")


def family_ctes(most: int | None = None) -> list[str]:
    """Family scores ``fam`` from ``post`` by listing all Mendelian triples."""
    cap = f"WHERE pos <= {most}" if most else ""
    return [
        "roled AS MATERIALIZED (SELECT person_id, family_id, sex, CASE relation WHEN 'mother' THEN 'mother' WHEN 'father' THEN 'father' WHEN 'self' THEN 'proband' ELSE 'sibling' END AS role FROM person)",
        "mem AS MATERIALIZED (SELECT locus_id, family_id, role, r1, r2, k, pair_no, p FROM post JOIN roled USING (person_id))",
        "quad AS (SELECT family_id, bool_or(role = 'mother') AND bool_or(role = 'father') AND bool_or(role = 'proband') AS pro, bool_or(role = 'mother') AND bool_or(role = 'father') AND bool_or(role = 'sibling') AS sib FROM roled GROUP BY family_id)",
        "trio AS MATERIALIZED (SELECT 'proband' AS child, m.* FROM mem m JOIN quad USING (family_id) WHERE pro AND role <> 'sibling' UNION ALL SELECT 'sibling', m.* FROM mem m JOIN quad USING (family_id) WHERE sib AND role <> 'proband')",
        "shares AS (SELECT child, locus_id, family_id, r, SUM(p) / 2 / 3 AS s FROM (SELECT child, locus_id, family_id, r1 AS r, p FROM trio UNION ALL SELECT child, locus_id, family_id, r2, p FROM trio) GROUP BY ALL)",
        f"top AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY child, locus_id, family_id ORDER BY round(s, 9) DESC, r) AS pos FROM shares) {cap})",
        "res AS MATERIALIZED (SELECT t.* FROM trio t JOIN top a ON a.child = t.child AND a.locus_id = t.locus_id AND a.family_id = t.family_id AND a.r = t.r1 JOIN top b ON b.child = t.child AND b.locus_id = t.locus_id AND b.family_id = t.family_id AND b.r = t.r2)",
        """tri AS MATERIALIZED (SELECT m.child, locus_id, family_id,
          SUM(CASE WHEN (c.r1 IN (m.r1, m.r2) AND c.r2 IN (f.r1, f.r2)) OR (c.r2 IN (m.r1, m.r2) AND c.r1 IN (f.r1, f.r2)) THEN m.p * f.p * c.p ELSE 0 END) AS obedience,
          SUM(CASE WHEN (m.r1 IN (c.r1, c.r2) AND m.r2 IN (f.r1, f.r2)) OR (m.r2 IN (c.r1, c.r2) AND m.r1 IN (f.r1, f.r2)) THEN m.p * f.p * c.p ELSE 0 END) AS swap_m,
          SUM(CASE WHEN (f.r1 IN (m.r1, m.r2) AND f.r2 IN (c.r1, c.r2)) OR (f.r2 IN (m.r1, m.r2) AND f.r1 IN (c.r1, c.r2)) THEN m.p * f.p * c.p ELSE 0 END) AS swap_f
          FROM (SELECT * FROM res WHERE role = 'mother') m JOIN (SELECT * FROM res WHERE role = 'father') f USING (child, locus_id, family_id) JOIN (SELECT * FROM res WHERE role = child) c USING (child, locus_id, family_id) GROUP BY ALL)""",
        """bestp AS MATERIALIZED (SELECT b.locus_id, family_id, role, b.p, COALESCE(x.allele_len, -1) AS a1, COALESCE(y.allele_len, -1) AS a2 FROM
          (SELECT *, row_number() OVER (PARTITION BY locus_id, family_id, role ORDER BY round(p, 9) DESC, pair_no) AS pick FROM mem) b
          LEFT JOIN rk x ON x.locus_id = b.locus_id AND x.r = b.r1 LEFT JOIN rk y ON y.locus_id = b.locus_id AND y.r = b.r2 WHERE pick = 1)""",
        "fam AS MATERIALIZED (SELECT * FROM (SELECT locus_id, family_id, " + ", ".join(
            f"CAST(COALESCE(MAX(CASE WHEN role = '{r}' THEN a{i} END), -2) AS INT) AS {r}_{i}" for r in ("mother", "father", "proband", "sibling") for i in (1, 2)
        ) + ", " + ", ".join(
            f"MAX(CASE WHEN role = 'mother' THEN p END) * MAX(CASE WHEN role = 'father' THEN p END) * MAX(CASE WHEN role = '{c}' THEN p END) AS {c}_trio" for c in ("proband", "sibling")
        ) + " FROM bestp GROUP BY locus_id, family_id) LEFT JOIN (SELECT locus_id, family_id, obedience AS proband_obedience, greatest(swap_m, swap_f) AS proband_kinship FROM tri WHERE child = 'proband') USING (locus_id, family_id)"
        " LEFT JOIN (SELECT locus_id, family_id, obedience AS sibling_obedience, greatest(swap_m, swap_f) AS sibling_kinship FROM tri WHERE child = 'sibling') USING (locus_id, family_id))",
    ]
