"""The same results in DuckDB SQL, written out for the four-sensor models."""

from __future__ import annotations

from .tables import DIRTY, EVENTS, FAILURE_FRAME, PATHS, RUNS, S4, S7, duck

J = range(1, 5)


def r(expr: str, digits: int) -> str:
    """Rounded, with no negative zero."""
    return f"(round({expr}, {digits}) + 0e0)"


def runs_cte(body: str = RUNS) -> str:
    return f"runs AS ({duck(body)})"


def fit_cte(cov: str, calib: float = 0.3, alpha: float = 0.01, rule: str = "empirical",
            chi2: float = 13.276704135987622, sensors: list[str] = S4) -> str:
    """CTEs ``models`` and ``scored(run_id, op, side, class, intensity, dl1.., y1.., d2, score,
    thr, flagged)``: split, scale, covariance, Cholesky factor, forward substitution."""
    p = len(sensors)
    idx = range(1, p + 1)
    s = {i: sensors[i - 1] for i in idx}
    low = [(i, j) for i in idx for j in range(1, i + 1)]
    cells = ", ".join(
        f"avg(z{i}*z{j}) - avg(z{i})*avg(z{j}) AS v{i}{j}" for i, j in low)
    tr = " + ".join(f"v{i}{i}" for i in idx)
    sq = " + ".join(f"{'' if i == j else '2e0*'}v{i}{j}*v{i}{j}" for i, j in low)
    pf = f"{p}e0"
    if cov == "ledoit_wolf":
        weight = (f"(q4/n - ({sq}))/({pf}*n) AS beta0, ({sq})/{pf} - mu*mu AS delta, "
                  "least(beta0, delta) AS beta, "
                  "CASE WHEN beta <= 0e0 THEN 0e0 ELSE beta/delta END AS s")
    elif cov == "oas":
        weight = (f"({sq})/({pf}*{pf}) AS ms, (n + 1e0)*(ms - mu*mu/{pf}) AS den, "
                  "CASE WHEN den = 0e0 THEN 1e0 ELSE least((ms + mu*mu)/den, 1e0) END AS s")
    else:
        weight = "0e0 AS s"
    if cov == "diagonal":
        shrunk = ", ".join(
            f"v{i}{j}*n/(n-1e0) AS a{i}{j}" if i == j else f"0e0 AS a{i}{j}" for i, j in low)
    else:
        shrunk = ", ".join(
            f"(1e0-s)*v{i}{j}" + (" + s*mu" if i == j else "") + f" AS a{i}{j}" for i, j in low)
    trace_a = " + ".join(f"a{i}{i}" for i in idx)
    factor = []
    for j in idx:
        inner = "".join(f" - l{j}{k}*l{j}{k}" for k in range(1, j))
        factor.append(f"sqrt(a{j}{j} + lam{inner}) AS l{j}{j}")
        for i in range(j + 1, p + 1):
            inner = "".join(f" - l{i}{k}*l{j}{k}" for k in range(1, j))
            factor.append(f"(a{i}{j}{inner})/l{j}{j} AS l{i}{j}")
    # columns must be defined before use: order by rows of L
    factor.sort(key=lambda f: f.split(" AS l")[1][::-1])
    factor = _row_order(factor)
    forward = ", ".join(
        f"(dl{i}" + "".join(f" - l{i}{k}*y{k}" for k in range(1, i)) + f")/l{i}{i} AS y{i}"
        for i in idx)
    deltas = ", ".join(f"({s[i]} - c{i})/t{i} - loc{i} AS dl{i}" for i in idx)
    d2 = " + ".join(f"y{i}*y{i}" for i in idx)
    held = f"rk <= round_even({calib}*n_op, 0)" if calib > 0 else "FALSE"
    return f"""
ranked AS (SELECT *, row_number() OVER (PARTITION BY op ORDER BY md5(run_id || '#0'), run_id) AS rk,
  count(*) OVER (PARTITION BY op) AS n_op FROM runs WHERE side = 'nominal'),
tagged AS (SELECT *, {held} AS held FROM ranked),
sc AS (SELECT op, {", ".join(f"avg({s[i]}) AS c{i}, stddev_pop({s[i]}) AS t{i}" for i in idx)}
  FROM tagged WHERE NOT held GROUP BY op),
z AS (SELECT op, {", ".join(f"({s[i]} - c{i})/t{i} AS z{i}" for i in idx)}
  FROM tagged JOIN sc USING (op) WHERE NOT held),
g AS (SELECT op, CAST(count(*) AS DOUBLE) AS n, {cells},
  {", ".join(f"avg(z{i}) AS loc{i}" for i in idx)},
  sum(pow({" + ".join(f"z{i}*z{i}" for i in idx)}, 2)) AS q4 FROM z GROUP BY op),
w AS (SELECT *, ({tr})/{pf} AS mu, {weight} FROM g),
a AS (SELECT *, {shrunk} FROM w),
lam AS (SELECT *, 1e-8*({trace_a})/{pf} AS lam FROM a),
fac AS (SELECT *, {", ".join(factor)} FROM lam),
models AS (SELECT * FROM fac JOIN sc USING (op)),
gaps AS (SELECT *, {deltas} FROM runs JOIN models USING (op)),
solved AS (SELECT *, {forward}, {d2} AS d2, sqrt({d2}) AS score FROM gaps),
limits AS ({_limit(calib, alpha, rule, chi2)}),
scored AS (SELECT *, score > thr AS flagged FROM solved JOIN limits USING (op))"""


def _row_order(factor: list[str]) -> list[str]:
    """l11, l21, l22, l31, ... : every entry after the ones it reads."""
    name = lambda f: f.rsplit(" AS l", 1)[1]
    return sorted(factor, key=lambda f: (int(name(f)[0]), int(name(f)[1])))


def _limit(calib: float, alpha: float, rule: str, chi2: float) -> str:
    if rule == "chi2":
        return f"SELECT op, sqrt({chi2!r}) AS thr FROM models"
    which = ("JOIN (SELECT run_id, op FROM tagged WHERE held) USING (run_id, op)"
             if calib > 0 else "")
    return (f"SELECT op, quantile_cont(score, {1.0 - alpha!r}) AS thr FROM solved {which} "
            "WHERE side = 'nominal' GROUP BY op")


def scored(cov: str = "ledoit_wolf", **kw) -> str:
    return f"WITH {runs_cte()}, {fit_cte(cov, **kw)} "


FRAME = """, frame AS (SELECT op, class, abs(intensity) AS x, flagged AS hit, score, thr
  FROM scored WHERE side = 'failure')"""


def edges_cte(source: str, keys: str, x: str, n_bins: int, min_count: int) -> str:
    """``edges(keys, edges)`` and ``placed`` with ``bin, lo, hi``, as in the library."""
    cases = " ".join(
        f"WHEN {nb} THEN quantile_cont({x}, {[*(i * (1.0 / nb) for i in range(nb)), 1.0]!r})"
        for nb in range(1, n_bins + 1))
    nb = f"greatest(1, least({n_bins}, count(*) // {min_count}))"
    distinct = "list_sort(list_distinct(q))"
    using = f"USING ({keys})"
    return f""", base AS (SELECT * FROM {source} WHERE {x} IS NOT NULL),
quants AS (SELECT {keys}, CASE {nb} {cases} END AS q FROM base GROUP BY {keys}),
edges AS (SELECT {keys}, CASE WHEN len({distinct}) < 2 THEN [q[1], q[1] + 1e-12] ELSE {distinct} END AS e
  FROM quants),
placed AS (SELECT base.*, e, len(list_filter(e[2:len(e)-1], lambda v: v <= {x})) AS bin
  FROM base JOIN edges {using})"""


def _wilson(k: str, n: str) -> tuple[str, str]:
    z = 1.959963984540054
    p = f"({k}/CAST({n} AS DOUBLE))"
    wide = f"(1e0 + {z * z!r}/{n})"
    mid = f"(({p} + {z * z / 2.0!r}/{n})/{wide})"
    half = f"({z!r}*sqrt({p}*(1e0-{p})/{n} + {z * z / 4.0!r}/(CAST({n} AS DOUBLE)*{n}))/{wide})"
    lo = f"CASE WHEN {k} = 0 THEN 0e0 ELSE least(greatest({mid} - {half}, 0e0), {p}) END"
    hi = f"CASE WHEN {k} = {n} THEN 1e0 ELSE greatest(least({mid} + {half}, 1e0), {p}) END"
    return lo, hi


_LO, _HI = _wilson("k", "n")
BINS = edges_cte("(SELECT * FROM frame WHERE x > 0e0)", "op, class", "x", 10, 15) + f"""
, bins0 AS (SELECT op, class, bin, e[bin+1] AS lo, e[bin+2] AS hi, count(*) AS n,
  count(*) FILTER (WHERE hit) AS k, median(x) AS center FROM placed GROUP BY op, class, bin, e),
bins AS (SELECT *, k/CAST(n AS DOUBLE) AS rate, {_LO} AS ci_lo, {_HI} AS ci_hi FROM bins0),
floors AS (SELECT *, min(rate) OVER (PARTITION BY op, class ORDER BY center DESC
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS low FROM bins),
cross0 AS (SELECT op, class, min(center) FILTER (WHERE low >= 0.5e0) AS i50_emp,
  min(center) FILTER (WHERE low >= 0.9e0) AS i90_emp FROM floors GROUP BY op, class)"""


def irls_cte(keys: str = "op, class", source: str = "frame") -> str:
    """Thirty reweighted least-squares steps as a recursion over the groups."""
    eta = "greatest(-35e0, least(35e0, b0 + b1*x))"
    return f""", cells AS (SELECT {keys}, ln(x) AS x, CAST(count(*) AS DOUBLE) AS n,
  CAST(count(*) FILTER (WHERE hit) AS DOUBLE) AS k FROM {source} WHERE x > 0e0 GROUP BY {keys}, x),
steps AS (SELECT {keys}, 0 AS i, 0e0 AS b0, 0e0 AS b1 FROM cells GROUP BY {keys} HAVING sum(k) > 0
  UNION ALL
  SELECT {keys}, i, (d*wz - wx*wxz)/(a*d - wx*wx), (a*wxz - wx*wz)/(a*d - wx*wx) FROM (
    SELECT {keys}, i + 1 AS i, sum(n*w) + 1e-8 AS a, sum(n*w*x) AS wx, sum(n*w*x*x) + 1e-8 AS d,
      sum(n*w*eta + k - n*p) AS wz, sum((n*w*eta + k - n*p)*x) AS wxz
    FROM (SELECT *, greatest(p*(1e0-p), 1e-10) AS w FROM (
      SELECT *, 1e0/(1e0 + exp(-eta)) AS p FROM (
        SELECT cells.*, i, b0, b1, {eta} AS eta FROM steps JOIN cells USING ({keys})
        WHERE i < 30)))
    GROUP BY {keys}, i)),
fits AS (SELECT {keys}, b0, b1 FROM steps WHERE i = 30)"""


def invert(t: float) -> str:
    return (f"CASE WHEN b1 > 0e0 THEN exp((ln({t!r}/(1e0-{t!r})) - b0)/b1) END")


def pod_cte(keys: str = "op, class", source: str = "frame") -> str:
    return irls_cte(keys, source) + f""", totals AS (SELECT {keys}, count(*) AS n,
  count(*) FILTER (WHERE hit) AS detected, min(x) AS i_min, max(x) AS i_max
  FROM {source} WHERE x > 0e0 GROUP BY {keys}),
pod AS (SELECT totals.*, b0, b1, detected = n AS separated, b0 IS NOT NULL AS fitted,
  CASE WHEN detected < n THEN {invert(0.5)} END AS i50,
  CASE WHEN detected < n THEN {invert(0.9)} END AS i90
  FROM totals LEFT JOIN fits USING ({keys}))"""


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def pair_corr(a: str, b: str) -> str:
    return (f"covar_pop({a}, {b})/nullif(stddev_pop({a})*stddev_pop({b}), 0e0)")


def greedy_cte() -> str:
    """Which sensors survive, from pairwise |r|, first of each group kept."""
    live = [s for s in S7]
    rs = ", ".join(
        f"abs({pair_corr(a, b)}) AS r_{a}_{b}" for i, a in enumerate(live) for b in live[i + 1:])
    flat = ", ".join(f"min({s}) = max({s}) AS c_{s}" for s in live)
    rows = []
    kept: list[str] = []
    chain = []
    for s in live:
        twin = " ".join(f"WHEN k_{t} AND r_{t}_{s} >= 0.999e0 THEN '{t}'" for t in kept)
        twin = f"CASE WHEN c_{s} THEN '(constant)' {twin} END"
        chain.append(f"{twin} AS d_{s}, d_{s} IS NULL AS k_{s}")
        rows.append(f"SELECT op, '{s}' AS sensor, k_{s} AS kept, d_{s} AS duplicate_of FROM greedy")
        kept.append(s)
    return (f"corr AS (SELECT op, {rs}, {flat} FROM runs WHERE side = 'nominal' GROUP BY op), "
            f"greedy AS (SELECT op, r_s1_s2, {', '.join(chain)} FROM corr)"), " UNION ALL ".join(rows)
