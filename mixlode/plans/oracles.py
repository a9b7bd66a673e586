"""SQL that DuckDB runs for the same results, in closed form rather than by eigenvalues."""

from __future__ import annotations

from mixlode.functions.optimizers import Adam, Adamax, GradientAscent, Momentum, Nesterov, Optimizer
from mixlode.functions.regularizers import ConjugatePrior, LogBarrier
from mixlode.functions.transforms import RatioTransform
from mixlode.operators.sampling import UNIFORM_BITS
from mixlode.plans import queries as Q

PI = "pi()"
POINTS = "SELECT l_orderkey, l_linenumber, l_quantity AS x1, l_extendedprice / 1000 AS x2 FROM lineitem"


def _logpdf(mean, cov, x1="x1", x2="x2") -> str:
    (a, b), (_, c) = cov
    det = f"({a} * {c} - {b} * {b})"
    u, v = f"({x1} - {mean[0]})", f"({x2} - {mean[1]})"
    return f"(-ln(2 * {PI}) - 0.5 * ln({det}) - 0.5 * ({c} * {u} * {u} - 2 * {b} * {u} * {v} + {a} * {v} * {v}) / {det})"


def _clamp(q: str) -> str:
    return f"greatest(least({q}, 1.7976931348623157e308 / 2), 4.9e-324)"


def _soft(points: str) -> str:
    q = [_clamp(f"{w}::DOUBLE * exp({_logpdf(m, c)})") for w, m, c in zip(Q.WEIGHTS, Q.MEANS, Q.COVS, strict=True)]
    return f"SELECT l_orderkey, l_linenumber, q1 / (q1 + q2) AS p1, q2 / (q1 + q2) AS p2 FROM (SELECT *, {q[0]} AS q1, {q[1]} AS q2 FROM ({points}))"


_HARD = "CAST(CASE WHEN p1 >= p2 THEN 0 ELSE 1 END AS INTEGER)"


def _concave(j: int) -> str:
    s = Q.SCALES[j]
    return f"exp({_logpdf(Q.MEANS[j], Q.COVS[j])}) * exp(0.5 * (1 - 1 / {s}::DOUBLE)) / sqrt({s}::DOUBLE)"


def _suffstats() -> str:
    q = [_clamp(f"{w}::DOUBLE * {_concave(j)}") for j, w in enumerate(Q.WEIGHTS)]
    y = ["x1", "x2", "1.0::DOUBLE"]
    cols = ["n", "round(loss / n, 6) AS loss"]
    sums = ["count(*) AS n", "sum(ln(q1 + q2)) AS loss"]
    for j in (1, 2):
        sums += [f"sum(r{j}) AS resp_{j}", f"sum(r{j} - {Q.WEIGHTS[j - 1]}::DOUBLE) AS wgrad_{j}"]
        sums += [f"sum(r{j} * {y[a]} * {y[b]}) AS outer_{j}_{a + 1}{b + 1}" for a in range(3) for b in range(a, 3)]
    cols += [f"round({s.split(' AS ')[1]} / n, 6) AS {s.split(' AS ')[1]}" for s in sums[2:]]
    return f"SELECT {', '.join(cols)} FROM (SELECT {', '.join(sums)} FROM (SELECT *, q1 / (q1 + q2) AS r1, q2 / (q1 + q2) AS r2 FROM (SELECT *, {q[0]} AS q1, {q[1]} AS q2 FROM ({POINTS}))))"


def _upper(d: int) -> list[tuple[int, int]]:
    return [(a, b) for a in range(d + 1) for b in range(a, d + 1)]


class _Ascent:
    """Chained CTEs: state t (one row) -> statistics -> state t + 1.

    Columns: w{j}, P{j}_{a}{b} (upper block), M/V slots of blocks and weights.
    """

    def __init__(self, d: int, optimizer: Optimizer, regularizer=None) -> None:
        self.d, self.opt, self.reg, self.cells = d, optimizer, regularizer, _upper(d)
        self.clock, self.rate, self.ctes = 0, optimizer.learning_rate, []

    def start(self, weights, means, covs, scales) -> None:
        cols = []
        for j, (w, m, c, s) in enumerate(zip(weights, means, covs, scales, strict=True)):
            cols.append(f"{w}::DOUBLE AS w{j}")
            mu = [*m, 1.0]
            for a, b in self.cells:
                p = s * mu[a] * mu[b] + (c[a][b] if b < self.d else 0.0)
                cols.append(f"{p!r}::DOUBLE AS P{j}_{a}{b}")
        self.ctes.append(f"s0 AS MATERIALIZED (SELECT {', '.join(cols)})")

    def start_from(self, ctes: list[str], table: str) -> None:
        """Starts from a one-row table of w{j}, m{j}_{a} and c{j}_{a}{b}."""
        cols = []
        for j in range(2):
            mu = [*[f"m{j}_{a}" for a in range(self.d)], "1.0::DOUBLE"]
            cols += [f"w{j}", *[f"{mu[a]} * {mu[b]}" + (f" + c{j}_{a}{b}" if b < self.d else "") + f" AS P{j}_{a}{b}" for a, b in self.cells]]
        self.ctes += [*ctes, f"s0 AS MATERIALIZED (SELECT {', '.join(cols)} FROM {table})"]

    def _density(self, j: int) -> str:
        d = self.d
        s = f"P{j}_{d}{d}"
        mu = [f"(P{j}_{a}{d} / {s})" for a in range(d)]
        cov = lambda a, b: f"(P{j}_{a}{b} - {s} * {mu[a]} * {mu[b]})"
        if d == 1:
            logpdf = f"(-0.5 * ln(2 * {PI} * {cov(0, 0)}) - 0.5 * (x1 - {mu[0]}) * (x1 - {mu[0]}) / {cov(0, 0)})"
        else:
            logpdf = _logpdf(mu, ((cov(0, 0), cov(0, 1)), (cov(0, 1), cov(1, 1))))
        return _clamp(f"w{j} * exp({logpdf} + 0.5 * (1 - 1 / {s}) - 0.5 * ln({s}))")

    def _slots(self, name: str, g: str, x: str, first: bool) -> tuple[str, list[str]]:
        """The next value of one coordinate and the slot columns to keep."""
        o, eta = self.opt, f"{self.rate!r}::DOUBLE"
        m0, v0 = ("0.0::DOUBLE", "0.0::DOUBLE") if first else (f"M{name}", f"V{name}")
        if isinstance(o, Momentum):
            m = f"({o.beta} * {m0} + {g})"
            return f"{x} + {eta} * {m}", [f"{m} AS M{name}", f"0 AS V{name}"]
        if isinstance(o, Nesterov):
            v, old = f"({x} + {eta} * {g})", x if first else m0
            return f"(1 + {o.gamma}::DOUBLE) * {v} - {o.gamma}::DOUBLE * {old}", [f"{v} AS M{name}", f"0 AS V{name}"]
        t = self.clock + 2
        if isinstance(o, Adam):
            m, v = f"({o.beta1}::DOUBLE * {m0} + (1 - {o.beta1}::DOUBLE) * {g})", f"({o.beta2}::DOUBLE * {v0} + (1 - {o.beta2}::DOUBLE) * {g} * {g})"
            root = f"sqrt(1 - power({o.beta2}::DOUBLE, {t}))"
            return f"{x} + {eta} * {root} / (1 - power({o.beta1}::DOUBLE, {t})) * {m} / (sqrt({v}) + {o.eps}::DOUBLE * {root})", [f"{m} AS M{name}", f"{v} AS V{name}"]
        if isinstance(o, Adamax):
            m, v = f"({o.beta1}::DOUBLE * {m0} + {g})", f"greatest({o.beta2}::DOUBLE * {v0}, abs({g}))"
            return f"{x} + {eta} * {m} / ({v} + {o.eps}::DOUBLE) / (1 - power({o.beta1}::DOUBLE, {t}))", [f"{m} AS M{name}", f"{v} AS V{name}"]
        return f"{x} + {eta} * {g}", [f"0 AS M{name}", f"0 AS V{name}"]

    def iterate(self, t: int, points: str) -> None:
        d, k = self.d, 2
        y = [*["x1", "x2"][:d], "1.0::DOUBLE"]
        q = ", ".join(f"{self._density(j)} AS q{j}" for j in range(k))
        sums = ["count(*) AS n"] + [f"sum(r{j} * {y[a]} * {y[b]}) AS Y{j}_{a}{b}" for j in range(k) for a, b in self.cells]
        self.ctes.append(f"e{t} AS MATERIALIZED (SELECT {', '.join(sums)} FROM (SELECT *, q0 / (q0 + q1) AS r0, q1 / (q0 + q1) AS r1 FROM (SELECT x1{', x2' * (d > 1)}, {q} FROM ({points}), s{t})))")
        cols, first = [], t == 0
        for j in range(k):
            for a, b in self.cells:
                reg = ""
                if isinstance(self.reg, LogBarrier):
                    reg = f" + {self.reg.scale} * (P{j}_{a}{b} - P{j}_{a}{d} * P{j}_{b}{d})"
                elif isinstance(self.reg, ConjugatePrior):
                    reg = f" + 0.5 * ({float(self.reg.block[a, b])!r} - {self.reg.kappa} * P{j}_{a}{b})"
                g = f"((0.5 * (Y{j}_{a}{b} - Y{j}_{d}{d} * P{j}_{a}{b}){reg}) / n)"
                value, slots = self._slots(f"{j}_{a}{b}", g, f"P{j}_{a}{b}", first)
                cols += [f"{value} AS P{j}_{a}{b}", *slots]
            self.clock += 1
        prior = f" + {self.reg.dirichlet} * (1 - {k} * w0)" if isinstance(self.reg, ConjugatePrior) else ""
        ratio = isinstance(self.opt.transform, RatioTransform)
        free = "(w0 / w1)" if ratio else "ln(w0 / w1)"
        value, slots = self._slots("w0", f"((Y0_{d}{d} - n * w0{prior}) / n)", free, first)
        self.clock += 1
        cols += [f"{value} AS f0", *slots]
        share = "f0 / (f0 + 1)" if ratio else "1 / (1 + exp(-f0))"
        self.ctes.append(f"s{t + 1} AS MATERIALIZED (SELECT * EXCLUDE (f0), {share} AS w0, 1 - {share} AS w1 FROM (SELECT {', '.join(cols)} FROM s{t}, e{t}))")
        self.rate = self.opt.shrunk(self.rate)

    def sql(self, t: int) -> str:
        d, parts = self.d, []
        for j in range(2):
            s = f"P{j}_{d}{d}"
            cols = [f"CAST({j} AS INTEGER) AS component", f"round(w{j}, 6) + 0.0 AS weight", f"round({s}, 6) AS s"]
            cols += [f"round(P{j}_{a}{d} / {s}, 6) AS mu_{a + 1}" for a in range(d)]
            cols += [f"round(P{j}_{a}{b} - P{j}_{a}{d} * P{j}_{b}{d} / {s}, 6) AS sigma_{a + 1}{b + 1}" for a, b in self.cells if b < d]
            parts.append(f"SELECT {', '.join(cols)} FROM s{t}")
        return f"WITH {', '.join(self.ctes)} {' UNION ALL '.join(parts)}"


def _step(optimizer: Optimizer, iterations: int, regularizer, scales) -> str:
    a = _Ascent(2, optimizer, regularizer)
    a.start(Q.WEIGHTS, Q.MEANS, Q.COVS, scales)
    for t in range(iterations):
        a.iterate(t, POINTS)
    return a.sql(iterations)


def _stream_train() -> str:
    optimizer = Q.event_model().optimizer
    a = _Ascent(1, optimizer)
    a.start(Q.EVENT_WEIGHTS, [[m] for m in Q.EVENT_MEANS], [[[v]] for v in Q.EVENT_VARS], (1.0, 1.0))
    for t in range(3):
        a.rate = optimizer.learning_rate  # each micro-batch starts at the full rate
        a.iterate(t, f"SELECT value AS x1 FROM events WHERE event_id % 3 = {t}")
    return a.sql(3)


def _reg_values() -> str:
    prior, parts = Q.STEPS["step_conjprior_1"][2], []
    for j, (m, c, s) in enumerate(zip(Q.MEANS, Q.COVS, Q.SCALES, strict=True)):
        (a, b), (_, e) = c
        det = f"({a}::DOUBLE * {e} - {b} * {b})"
        i11, i12, i22 = f"({e} / {det})", f"(-{b} / {det})", f"({a} / {det})"
        q1, q2 = f"({i11} * {m[0]} + {i12} * {m[1]})", f"({i12} * {m[0]} + {i22} * {m[1]})"
        z = [[float(v) for v in row] for row in prior.block]
        corner = f"(1 / {s}::DOUBLE + {m[0]} * {q1} + {m[1]} * {q2})"
        trace = f"({z[0][0]} * {i11} + 2 * {z[0][1]} * {i12} + {z[1][1]} * {i22} - 2 * {z[0][2]} * {q1} - 2 * {z[1][2]} * {q2} + {z[2][2]} * {corner})"
        parts.append(f"SELECT CAST({j} AS INTEGER) AS component, round(2 * (ln({det}) + ln({s}::DOUBLE) - {s}), 6) AS barrier, round(-0.5 * ({prior.kappa} * (ln({det}) + ln({s}::DOUBLE)) + {trace}), 6) AS prior, round({prior.dirichlet} * (ln({Q.WEIGHTS[0]}::DOUBLE) + ln({Q.WEIGHTS[1]}::DOUBLE)), 6) AS prior_weights")
    return " UNION ALL ".join(parts)


def _init_stats() -> str:
    (a0, b0), (a1, b1) = Q.CENTERS
    return f"""WITH p AS (SELECT x1, x2, CAST(CASE WHEN (x1 - {a0}) * (x1 - {a0}) + (x2 - {b0}) * (x2 - {b0}) <= (x1 - {a1}) * (x1 - {a1}) + (x2 - {b1}) * (x2 - {b1}) THEN 0 ELSE 1 END AS INTEGER) AS component FROM ({POINTS})),
    c AS (SELECT *, x1 - CASE component WHEN 0 THEN {a0} ELSE {a1} END AS u, x2 - CASE component WHEN 0 THEN {b0} ELSE {b1} END AS v FROM p),
    g AS (SELECT component, count(*) AS n, sum(u * u) / count(*) AS c11, sum(u * v) / count(*) AS c12, sum(v * v) / count(*) AS c22 FROM c GROUP BY component)
    SELECT component, round(n / (SELECT sum(n)::DOUBLE FROM g), 6) AS weight, round(c11 + greatest(1e-4, c11 + c22) / 2, 6) AS sigma_11, round(c12, 6) AS sigma_12, round(c22 + greatest(1e-4, c11 + c22) / 2, 6) AS sigma_22 FROM g"""


def _embeddings() -> str:
    terms = "-0.5 * ln(2 * pi() * (1.0 + (i + j) % 3) / 64) - 0.5 * (x - 0.05 * sin((i + j)::DOUBLE)) * (x - 0.05 * sin((i + j)::DOUBLE)) * 64 / (1.0 + (i + j) % 3)"
    return f"""WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, (generate_subscripts(embedding, 1) - 1)::BIGINT AS i FROM embeddings),
    l AS (SELECT vec_id, j, exp(sum({terms})) / 3 AS q FROM e, (SELECT unnest([0, 1, 2])::BIGINT AS j) GROUP BY vec_id, j),
    p AS (SELECT vec_id, max(q) FILTER (j = 0) AS q0, max(q) FILTER (j = 1) AS q1, max(q) FILTER (j = 2) AS q2 FROM l GROUP BY vec_id)
    SELECT vec_id, round(q0 / (q0 + q1 + q2), 6) AS p1, round(q1 / (q0 + q1 + q2), 6) AS p2, round(q2 / (q0 + q1 + q2), 6) AS p3,
    CAST(CASE WHEN q0 >= q1 AND q0 >= q2 THEN 0 WHEN q1 >= q2 THEN 1 ELSE 2 END AS INTEGER) AS prediction FROM p"""


def _events() -> str:
    q = [_clamp(f"{w}::DOUBLE * exp(-0.5 * ln(2 * {PI} * {v}) - 0.5 * (value - {m}) * (value - {m}) / {v})") for w, m, v in zip(Q.EVENT_WEIGHTS, Q.EVENT_MEANS, Q.EVENT_VARS, strict=True)]
    return f"SELECT event_id, round(p1, 6) AS p1, round(p2, 6) AS p2, {_HARD} AS prediction FROM (SELECT event_id, q1 / (q1 + q2) AS p1, q2 / (q1 + q2) AS p2 FROM (SELECT event_id, {q[0]} AS q1, {q[1]} AS q2 FROM events))"


def _uniform(text: str, first: int) -> str:
    return f"((CAST('0x' || substr(md5({text}), 1, {UNIFORM_BITS // 4}) AS BIGINT) + {first}) / {float(1 << UNIFORM_BITS)!r})"


def _keyed(seed: str) -> str:
    keys = ["CAST(round(l_extendedprice * 100) AS BIGINT)" if k == "cents" else k for k in Q.KEYS]
    return f"{seed} || '|' || {' || chr(124) || '.join(keys)}"


def _kmeans(k: int, n: int, iterations: int = 20, seed: int = 0) -> list[str]:
    """CTEs that end with seeded (one row): w{j}, m{j}_{a}, c{j}_{a}{b} of k clusters of n sampled rows."""
    near = lambda centers: "least(" + ", ".join(f"(x1 - {a}) * (x1 - {a}) + (x2 - {b}) * (x2 - {b})" for a, b in centers) + ")"
    order = _keyed(f"'{seed}'")
    ctes = [f"x AS MATERIALIZED (SELECT x1, x2, row_number() OVER (ORDER BY h) - 1 AS i FROM (SELECT l_quantity AS x1, l_extendedprice / 1000 AS x2, md5({order}) AS h FROM lineitem) ORDER BY h LIMIT {n})"]
    for j in range(k):
        race = f"-ln({_uniform(f"'{seed}|{j}|' || i", 1)})"
        if j:
            d = near([(f"a{i}", f"b{i}") for i in range(j)])
            ctes.append(f"d{j} AS MATERIALIZED (SELECT d{j - 1}.*, x1 AS a{j}, x2 AS b{j} FROM x, d{j - 1} WHERE {d} > 0 ORDER BY {race} / {d}, i LIMIT 1)")
        else:
            ctes.append(f"d0 AS MATERIALIZED (SELECT x1 AS a0, x2 AS b0 FROM x ORDER BY {race}, i LIMIT 1)")
    dist = [f"((x1 - a{j}) * (x1 - a{j}) + (x2 - b{j}) * (x2 - b{j}))" for j in range(k)]
    label = "CASE " + " ".join(f"WHEN {dist[j]} <= least({', '.join(dist)}) THEN {j}" for j in range(k)) + " END"
    last = f"d{k - 1}"
    for t in range(iterations):
        cols = ", ".join(f"coalesce(avg(x1) FILTER (l = {j}), any_value(a{j})) AS a{j}, coalesce(avg(x2) FILTER (l = {j}), any_value(b{j})) AS b{j}" for j in range(k))
        ctes.append(f"l{t} AS MATERIALIZED (SELECT {cols} FROM (SELECT *, {label} AS l FROM x, {last}))")
        last = f"l{t}"
    seen = " UNION ALL ".join(["SELECT x1, x2 FROM x", *[f"SELECT a{j}, b{j} FROM {last}" for j in range(k)]])
    ctes.append(f"g AS MATERIALIZED (SELECT *, {label} AS l FROM (SELECT e.x1, e.x2, {last}.* FROM ({seen}) e(x1, x2), {last}))")
    cols = []
    for j in range(k):
        cell = lambda u, v, j=j: f"sum({u} * {v}) FILTER (l = {j}) / count(*) FILTER (l = {j})"
        u, v = f"(x1 - a{j})", f"(x2 - b{j})"
        ridge = f"greatest(1e-4, {cell(u, u)} + {cell(v, v)}) / 2"
        cols += [f"count(*) FILTER (l = {j}) / count(*)::DOUBLE AS w{j}", f"any_value(a{j}) AS m{j}_0", f"any_value(b{j}) AS m{j}_1"]
        cols += [f"{cell(u, u)} + {ridge} AS c{j}_00", f"{cell(u, v)} AS c{j}_01", f"{cell(v, v)} + {ridge} AS c{j}_11"]
    return [*ctes, f"seeded AS MATERIALIZED (SELECT {', '.join(cols)} FROM g)"]


def _kmeans_init() -> str:
    cols = ("w{j}", "1.0::DOUBLE", "m{j}_0", "m{j}_1", "c{j}_00", "c{j}_01", "c{j}_11")
    names = ("weight", "s", "mu_1", "mu_2", "sigma_11", "sigma_12", "sigma_22")
    parts = [f"SELECT CAST({j} AS INTEGER) AS component, {', '.join(f'round({c.format(j=j)}, 6) AS {n}' for c, n in zip(cols, names, strict=True))} FROM seeded" for j in range(3)]
    return f"WITH {', '.join(_kmeans(3, 300))} {' UNION ALL '.join(parts)}"


def _fit_lineitem() -> str:
    a = _Ascent(2, GradientAscent())
    a.start_from(_kmeans(2, 200), "seeded")
    for t in range(3):
        a.iterate(t, POINTS)
    return a.sql(3)


def _minibatch() -> str:
    a = _Ascent(2, Momentum())
    a.start(Q.WEIGHTS, Q.MEANS, Q.COVS, (1.0, 1.0))
    fraction = f"(SELECT least(1.0, greatest({Q.BATCH}, count(*) * (1 - exp(ln(1e-3) / count(*)))) / count(*)) FROM lineitem)"
    for t in range(5):
        batch = _keyed(f"'{t}'")
        a.iterate(t, f"SELECT l_quantity AS x1, l_extendedprice / 1000 AS x2 FROM lineitem WHERE {_uniform(batch, 0)} < {fraction}")
    return a.sql(5)


def _step_local() -> str:
    a = _Ascent(1, GradientAscent(shrinkage=1.0))  # the local ascent keeps its rate
    a.start(Q.BALANCE_WEIGHTS, [[m] for m in Q.BALANCE_MEANS], [[[v]] for v in Q.BALANCE_VARS], (1.0, 1.0))
    for t in range(8):
        a.iterate(t, "SELECT c_acctbal / 1000 AS x1 FROM customer")
    return a.sql(8)


def _step_local_batches() -> str:
    a = _Ascent(1, GradientAscent(shrinkage=1.0))
    a.start(Q.BALANCE_WEIGHTS, [[m] for m in Q.BALANCE_MEANS], [[[v]] for v in Q.BALANCE_VARS], (1.0, 1.0))
    for t in range(3):
        a.iterate(t, f"SELECT x1 FROM (SELECT c_acctbal / 1000 AS x1, (row_number() OVER (ORDER BY c_custkey) - 1) // ((count(*) OVER () + 2) // 3) AS batch FROM customer) WHERE batch = {t}")
    return a.sql(3)


def _trajectory() -> str:
    a = _Ascent(2, GradientAscent())
    a.start(Q.WEIGHTS, Q.MEANS, Q.COVS, (1.0, 1.0))
    for t in range(3):
        a.iterate(t, POINTS)
    parts = [f"SELECT CAST({t} AS INTEGER) AS iter, CAST({j} AS INTEGER) AS component, round(w{j}, 6) AS weight, round(P{j}_22, 6) AS s, round(P{j}_02 / P{j}_22, 6) AS mu_1, round(P{j}_12 / P{j}_22, 6) AS mu_2, round(P{j}_01 - P{j}_02 * P{j}_12 / P{j}_22, 6) AS sigma_12 FROM s{t}" for t in range(3) for j in range(2)]
    return f"WITH {', '.join(a.ctes)} {' UNION ALL '.join(parts)}"


def _singles() -> str:
    points = f"SELECT 0 AS l_orderkey, 0 AS l_linenumber, x1, x2 FROM (VALUES {', '.join(f'({a}::DOUBLE, {b}::DOUBLE)' for a, b in Q.SINGLES)}) v(x1, x2)"
    q = [_clamp(f"{w}::DOUBLE * exp({_logpdf(m, c)})") for w, m, c in zip(Q.WEIGHTS, Q.MEANS, Q.COVS, strict=True)]
    soft = f"SELECT x1, x2, q1 / (q1 + q2) AS p1, q2 / (q1 + q2) AS p2 FROM (SELECT *, {q[0]} AS q1, {q[1]} AS q2 FROM ({points}))"
    return f"SELECT x1, x2, round(p1, 6) AS p1, round(p2, 6) AS p2, {_HARD} AS prediction, {_HARD} AS in_table FROM ({soft})"


def _scalars() -> str:
    rows = []
    for j, (((a, b), (_, c)), m) in enumerate(zip(Q.COVS, Q.HALVE, strict=True)):
        rows.append(f"SELECT CAST({j} AS INTEGER) AS component, round(({a} * {c} - {b} * {b})::DOUBLE, 6) AS det, round(ln(({a} * {c} - {b} * {b})::DOUBLE), 6) AS log_det, round(power(0.5::DOUBLE, 1.0::DOUBLE / {m}), 6) AS shrinkage, round(0.5::DOUBLE * power(0.5::DOUBLE, 1.0::DOUBLE / {m}), 6) AS next_rate")
    return " UNION ALL ".join(rows)


def _rule_settings() -> str:
    common = (("learning_rate", "0.9"), ("min_learning_rate", "0.01"), ("shrinkage", "round(power(0.5::DOUBLE, 0.05::DOUBLE), 9)"))
    own = {"GradientAscent": (), "Momentum": (("beta", "0.55"),), "Nesterov": (("gamma", "0.6"),), "Adam": (("beta1", "0.5"), ("beta2", "0.1"), ("eps", "1e-8")), "Adamax": (("beta1", "0.9"), ("beta2", "0.999"), ("eps", "1e-8"))}
    rows = [(rule, *x) for rule, more in own.items() for x in (*common, *more)]
    rows += [("model", "max_iter", "100"), ("model", "tol", "1e-6"), ("model", "sampling_seed", "0"), ("model, set", "max_iter", "7"), ("model, set", "tol", "0.25"), ("model, set", "sampling_seed", "3")]
    return "SELECT * FROM (VALUES " + ", ".join(f"('{r}', '{n}', CAST({v} AS DOUBLE))" for r, n, v in rows) + ") v(rule, setting, value)"


def oracle_sql() -> dict[str, str]:
    soft = _soft(POINTS)
    far = "SELECT l_orderkey, l_linenumber, l_quantity + 1e6 AS x1, l_extendedprice - 1e9 AS x2 FROM lineitem"
    return {
        "predict_soft_lineitem": f"SELECT l_orderkey, l_linenumber, round(p1, 6) AS p1, round(p2, 6) AS p2 FROM ({soft})",
        "predict_hard_lineitem": f"SELECT l_orderkey, l_linenumber, {_HARD} AS prediction FROM ({soft})",
        "label_histogram": f"SELECT {_HARD} AS prediction, count(*) AS n FROM ({soft}) GROUP BY 1",
        "logpdf_points": f"SELECT l_orderkey, l_linenumber, round({_logpdf(Q.MEANS[0], Q.COVS[0])}, 6) AS logpdf_1, round({_logpdf(Q.MEANS[1], Q.COVS[1])}, 6) AS logpdf_2 FROM ({POINTS})",
        "gconcave_pdf_points": f"SELECT l_orderkey, l_linenumber, round({_concave(0)} * 1000, 6) AS pdf_1, round({_concave(1)} * 1000, 6) AS pdf_2 FROM ({POINTS})",
        "suffstats_2d": _suffstats(),
        "outlier_uniform": f"SELECT l_orderkey, l_linenumber, round(p1, 6) AS p1, round(p2, 6) AS p2, {_HARD} AS prediction FROM ({_soft(far)})",
        "reg_values": _reg_values(),
        "init_stats_fixed_centers": _init_stats(),
        "predict_embeddings_diag": _embeddings(),
        "stream_train_events": _stream_train(),
        "stream_predict_events": _events(),
        "export_spark_gmm": f"SELECT l_orderkey, l_linenumber, round(p1, 6) AS p1, {_HARD} AS prediction, true AS agrees FROM ({soft})",
        "predict_odd_points": f"SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber BETWEEN 2 AND 7 THEN NULL ELSE round(p1, 6) END AS p1, CASE WHEN l_linenumber BETWEEN 2 AND 7 THEN NULL ELSE round(p2, 6) END AS p2, CASE WHEN l_linenumber BETWEEN 2 AND 7 THEN NULL ELSE {_HARD} END AS prediction FROM ({soft})",
        "text_points": "SELECT l_quantity AS x1, count(*) AS n, round(sum(l_extendedprice), 2) AS x2 FROM lineitem GROUP BY 1",
        "kmeans_init": _kmeans_init(), "fit_lineitem": _fit_lineitem(), "step_minibatch": _minibatch(), "step_local": _step_local(), "step_local_batches": _step_local_batches(), "stream_label_events": f"SELECT event_id, prediction FROM ({_events()})", "trajectory_ga_3": _trajectory(), "predict_singles": _singles(), "component_scalars": _scalars(), "rule_settings": _rule_settings(),
    } | {name: _step(*how) for name, how in Q.STEPS.items()}
