from pyspark.sql import functions as F

from ..operators import regimes as op
from ..operators.indicators import FEATURES
from ..plans.settle import settle
from ..sources.views import Views
from .indicators import features
from .registry import query
from .views import VIEWS

W = "WINDOW w AS (PARTITION BY sym ORDER BY ts)"
DAY = 86400
KEY = ["sym"]


@query("tercile_states", "sym ts:t ret:f9 state:i", "SELECT * FROM states")
def _(spark, d):
    return Views(spark, d).states()


VIEWS["nx"] = f"SELECT *, lead(state) OVER w AS nxt, lead(ts) OVER w AS nxt_ts, row_number() OVER w AS rn, count(*) OVER (PARTITION BY sym) AS nn FROM states {W}"
VIEWS["tc"] = """
  SELECT sym, i, j, coalesce(n, 0) AS n FROM (SELECT * FROM (SELECT DISTINCT sym FROM states), range(0, 3) AS a(i), range(0, 3) AS b(j)) LEFT JOIN (SELECT sym, state AS i, nxt AS j, count(*) AS n FROM nx WHERE nxt IS NOT NULL GROUP BY ALL) USING (sym, i, j)"""
VIEWS["tp"] = "SELECT *, (n + 1.0e0) / (sum(n) OVER (PARTITION BY sym, i) + 3) AS p FROM tc"


def probs(v: Views):
    return op.transition_probs(op.transition_counts(v.states(), KEY, 3), KEY, 3)


def matrices(v: Views):
    return op.as_matrix(probs(v), KEY)


@query("transition_counts", "sym i:i j:i n:i", "SELECT * FROM tc")
def _(spark, d):
    return op.transition_counts(Views(spark, d).states(), KEY, 3)


@query("transition_probs", "sym i:i j:i n:i p:f9", "SELECT * FROM tp")
def _(spark, d):
    return probs(Views(spark, d))


@query(
    "homogeneity_g2",
    "sym g2:f6 dof:i p:f6",
    """SELECT *, exp(-x) * (1 + x + x ** 2 / 2 + x ** 3 / 6 + x ** 4 / 24 + x ** 5 / 120) AS p FROM (
         SELECT sym, sum(2 * n * ln(n / e)) AS g2, 12 AS dof, sum(2 * n * ln(n / e)) / 2 AS x FROM (
           SELECT *, sum(n) OVER (PARTITION BY sym, per, i) * (sum(n) OVER (PARTITION BY sym, i, j) / sum(n) OVER (PARTITION BY sym, i)) AS e FROM (
             SELECT sym, per, state AS i, nxt AS j, count(*) AS n FROM (
               SELECT *, CASE WHEN rn - 1 >= 2 * nn // 3 THEN 2 WHEN rn - 1 >= nn // 3 THEN 1 ELSE 0 END AS per FROM nx
               WHERE nxt IS NOT NULL AND rn <> nn // 3 AND rn <> 2 * nn // 3) GROUP BY ALL))
         GROUP BY sym)""",
)
def _(spark, d):
    return op.homogeneity_g2(Views(spark, d).states(), KEY, 3)


def _mul(a, b):
    return f"SELECT a.sym, a.i, b.j, sum(a.p * b.p) AS p FROM {a} a JOIN {b} b ON a.sym = b.sym AND a.j = b.i GROUP BY a.sym, a.i, b.j"


VIEWS["mp_1"] = "SELECT sym, i, j, p FROM tp"
for _n, _a, _b in [(2, 1, 1), (4, 2, 2), (6, 4, 2), (8, 4, 4), (16, 8, 8), (24, 16, 8), (48, 24, 24)]:
    VIEWS[f"mp_{_n}"] = _mul(f"mp_{_a}", f"mp_{_b}")
for _n in range(5, 14):
    VIEWS[f"sq_{_n}"] = _mul("mp_16" if _n == 5 else f"sq_{_n - 1}", "mp_16" if _n == 5 else f"sq_{_n - 1}")


def _powers(hs):
    return " UNION ALL ".join(f"SELECT sym, {h} AS h, i, j, p FROM mp_{h}" for h in hs)


@query("multi_step", "sym h:i i:i j:i p:f9", _powers([1, 6, 24, 48]))
def _(spark, d):
    return op.multi_step(matrices(Views(spark, d)), KEY, [1, 6, 24, 48], 3)


@query(
    "stationary",
    "sym state:i share:f9 dwell:f6",
    "SELECT s.sym, s.state, s.share, 1 / (1 - t.p) AS dwell FROM (SELECT sym, j AS state, sum(p) / 3 AS share FROM sq_13 GROUP BY sym, j) s JOIN tp t ON t.sym = s.sym AND t.i = s.state AND t.j = s.state",
)
def _(spark, d):
    return op.stationary(matrices(Views(spark, d)), KEY, 3)


VIEWS["pm_pow"] = _powers([1, 4, 8, 24])
VIEWS["pm_guess"] = "SELECT sym, h, i, first(j ORDER BY p DESC, j) AS guess FROM pm_pow GROUP BY sym, h, i"


@query(
    "persistence_vs_markov",
    "sym h:i n:i persistence_acc:f9 markov_acc:f9 same_guess:f9",
    "SELECT sym, h, count(*) AS n, avg((i = actual)::INT) AS persistence_acc, avg((guess = actual)::INT) AS markov_acc, avg((guess = i)::INT) AS same_guess FROM ("
    + " UNION ALL ".join(f"SELECT sym, {h} AS h, state AS i, lead(state, {h}) OVER w AS actual FROM states {W}" for h in (1, 4, 8, 24))
    + ") JOIN pm_guess USING (sym, h, i) WHERE actual IS NOT NULL GROUP BY sym, h",
)
def _(spark, d):
    v = Views(spark, d)
    return op.persistence_vs_markov(v.states(), matrices(v), KEY, [1, 4, 8, 24], 3)


@query(
    "run_lengths",
    "sym state:i start:t end_ts:t length:i mean_ret:f9",
    """SELECT *, row_number() OVER (PARTITION BY sym, state ORDER BY length DESC, start) AS rk FROM (
         SELECT sym, state, min(ts) AS start, max(ts) AS end_ts, count(*) AS length, avg(ret) AS mean_ret FROM (
           SELECT *, row_number() OVER (PARTITION BY sym ORDER BY ts) - row_number() OVER (PARTITION BY sym, state ORDER BY ts) AS g FROM states)
         GROUP BY sym, state, g) QUALIFY rk <= 5""",
)
def _(spark, d):
    return op.run_lengths(Views(spark, d).states(), KEY, ["ret"]).withColumnRenamed("end", "end_ts")


FIRST, LENGTH, STEP = "2024-01-01", 10 * DAY, 5 * DAY
VIEWS["wins"] = """
  SELECT *, TIMESTAMP '2024-01-01' + to_days(CAST(5 * win AS INTEGER)) AS w0, TIMESTAMP '2024-01-01' + to_days(CAST(5 * win + 10 AS INTEGER)) AS w1 FROM range(0, 20) AS r(win)"""


@query(
    "transition_drift",
    "sym i:i j:i mean:f9 std:f9 min:f9 max:f9 windows:i steady",
    """SELECT sym, i, j, avg(p) AS mean, stddev_pop(p) AS std, min(p) AS min, max(p) AS max, count(*) AS windows,
              stddev_pop(p) < CASE WHEN i = j THEN 0.03 ELSE 0.08 END AS steady
       FROM (SELECT *, (n + 1.0e0) / (sum(n) OVER (PARTITION BY sym, win, i) + 3) AS p FROM (
         SELECT sym, win, i, j, coalesce(n, 0) AS n
         FROM (SELECT * FROM (SELECT DISTINCT sym, win FROM states JOIN wins ON ts >= w0 AND ts < w1 JOIN (SELECT sym, max(ts) AS last FROM states GROUP BY sym) USING (sym) WHERE last >= w1),
              range(0, 3) AS a(i), range(0, 3) AS b(j))
         LEFT JOIN (SELECT sym, win, state AS i, nxt AS j, count(*) AS n FROM nx JOIN wins ON ts >= w0 AND nxt_ts < w1 WHERE nxt IS NOT NULL GROUP BY ALL) USING (sym, win, i, j)))
       GROUP BY sym, i, j""",
)
def _(spark, d):
    return op.transition_drift(Views(spark, d).states(), KEY, 3, FIRST, LENGTH, STEP)


BLOCK, DRAWS, BOOT_SEED = 20, 200, 42


def _draw_sql(m: str) -> str:
    """``counter_draw`` + 1 for the block of number ``m`` of a resample."""
    x = f"CAST('0x' || substr(md5('{BOOT_SEED}:' || sym), 1, 7) AS BIGINT)"
    steps, at = [], "x0"
    for part in ("draw", m):
        steps.append((f"({at} + {part})", f"y{len(steps)}"))
        at = steps[-1][1]
        for mix in op.MIXERS:
            steps.append((f"((xor({at}, {at} >> 13) * {mix} + 12345) % {op.PRIME})", f"y{len(steps)}"))
            at = steps[-1][1]
    inner = f"SELECT {x} AS x0"
    for expr, name in steps:
        inner = f"SELECT *, {expr} AS {name} FROM ({inner})"
    return f"(SELECT {at} % (n - {BLOCK}) + 1 FROM ({inner}))"


@query(
    "block_bootstrap",
    "sym i:i j:i lo:f6 mid:f6 hi:f6 draws:i",
    f"""WITH nums AS (SELECT sym, state, row_number() OVER (PARTITION BY sym ORDER BY ts) AS rn, count(*) OVER (PARTITION BY sym) AS n FROM states),
       sizes AS (SELECT sym, any_value(n) AS n FROM nums GROUP BY sym HAVING any_value(n) > {BLOCK}),
       slots AS (SELECT sym, n, d.draw, b.m FROM sizes, range(1, {DRAWS + 1}) AS d(draw), range(1, 100000) AS b(m) WHERE b.m <= n // {BLOCK}),
       plan AS (SELECT *, {_draw_sql("m")} AS start, {_draw_sql("m + 1")} AS following FROM slots),
       steps AS (
         SELECT p.sym, p.draw, a.state AS i, b.state AS j FROM plan p JOIN nums a ON a.sym = p.sym AND a.rn BETWEEN p.start AND p.start + {BLOCK - 2}
           JOIN nums b ON b.sym = p.sym AND b.rn = a.rn + 1
         UNION ALL SELECT p.sym, p.draw, a.state, b.state FROM plan p JOIN nums a ON a.sym = p.sym AND a.rn = p.start + {BLOCK - 1}
           JOIN nums b ON b.sym = p.sym AND b.rn = p.following WHERE p.m < p.n // {BLOCK}),
       c AS (SELECT sym, draw, i, j, count(*) AS n FROM steps GROUP BY ALL),
       g AS (SELECT s.sym, d.draw, a.i, b.j, coalesce(c.n, 0) AS n FROM sizes s CROSS JOIN range(1, {DRAWS + 1}) AS d(draw) CROSS JOIN range(0, 3) AS a(i)
         CROSS JOIN range(0, 3) AS b(j) LEFT JOIN c ON c.sym = s.sym AND c.draw = d.draw AND c.i = a.i AND c.j = b.j),
       p AS (SELECT *, (n + 1.0e0) / (sum(n) OVER (PARTITION BY sym, draw, i) + 3) AS p FROM g)
       SELECT sym, i, j, quantile_cont(p, 0.025) AS lo, quantile_cont(p, 0.5) AS mid, quantile_cont(p, 0.975) AS hi, count(*) AS draws FROM p GROUP BY sym, i, j""",
)
def _(spark, d):
    return op.block_bootstrap(settle(Views(spark, d).states()), KEY, 3, DRAWS, BLOCK, seed=BOOT_SEED)


# the quarter (or fifth) of the day stands in for a state
def _sig(k):
    return (
        "SELECT *, n / sum(n) OVER (PARTITION BY sym) AS share FROM (SELECT sym, "
        + ("hour(ts) // 6" if k == 4 else "least(hour(ts) // 5, 4)")
        + " AS state, count(*) AS n, "
        + ", ".join(f"avg({f}) AS {f}" for f in FEATURES)
        + " FROM features GROUP BY 1, 2)"
    )


VIEWS["sig4"], VIEWS["sig5"] = _sig(4), _sig(5)
SIG = "sym state:i n:i share:f9 " + " ".join(f"{f}:f6" for f in FEATURES)


def signatures(v: Views, k: int):
    h = F.hour("ts")
    state = F.floor(h / 6) if k == 4 else F.least(F.floor(h / 5), F.lit(4))
    return op.state_signatures(features(v).withColumn("state", state), KEY, FEATURES)


@query("state_signatures", SIG, "SELECT * FROM sig4")
def _(spark, d):
    return signatures(Views(spark, d), 4)


@query(
    "canonical_labels",
    "sym state:i label",
    """SELECT *, CASE WHEN hot THEN CASE WHEN p = 1 THEN 'STRESS' ELSE 'CRASH' END ELSE CASE WHEN p = 1 THEN 'UP' ELSE 'CHOP' END END AS label FROM (
         SELECT *, row_number() OVER (PARTITION BY sym, hot ORDER BY log_return DESC, state) AS p FROM (
           SELECT *, row_number() OVER (PARTITION BY sym ORDER BY realized_vol DESC, state) <= 2 AS hot FROM sig4))""",
)
def _(spark, d):
    return op.canonical_labels(signatures(Views(spark, d), 4), KEY)


@query(
    "k5_labels",
    "sym state:i share:f9 label max_mean:f6 weakest artefact",
    """SELECT *, row_number() OVER (PARTITION BY sym ORDER BY max_mean, state) = 1 AS weakest, max_mean < 0.25 OR share < 0.05 OR dwell < 8 AS artefact,
         CASE WHEN realized_vol > 1 THEN CASE WHEN log_return > 0 THEN 'STRESS' ELSE 'CRASH' END
              WHEN realized_vol > 0 THEN CASE WHEN log_return < -0.005 THEN 'MID_BEAR' WHEN log_return <= 0.005 THEN 'MID_NEUTRAL' ELSE 'MID_BULL' END
              WHEN abs(log_return) < 0.005 THEN 'CHOP' WHEN log_return > 0 THEN 'UP' ELSE 'DOWN' END AS label
       FROM (SELECT *, n / 10.0e0 AS dwell, greatest(""" + ", ".join(f"abs({f})" for f in FEATURES) + ") AS max_mean FROM sig5)",
)
def _(spark, d):
    s = signatures(Views(spark, d), 5).withColumn("dwell", F.col("n") / 10)
    return op.k5_labels(s, KEY, FEATURES)


def _cand(k):
    return f"""SELECT sym, {k} AS k, sum(m) AS n_obs, -0.5e0 * sum(m) * ln(sum(ss) / sum(m)) AS loglik, min(abs(mu)) AS weakest_mean
      FROM (SELECT sym, hour(ts) * {k} // 24 AS g, count(*) AS m, var_pop(ret) * count(*) AS ss, avg(ret) AS mu FROM rets WHERE ret IS NOT NULL GROUP BY 1, 2) GROUP BY sym"""


VIEWS["cands"] = " UNION ALL ".join(_cand(k) for k in (2, 3, 4, 5))


@query(
    "model_selection",
    "sym k:i n_obs:i loglik:f6 n_params:i bic:f6 aic:f6 best_k:i noise_state passes",
    """SELECT c.*, best_k, noise_state, best_k = 4 AND noise_state AS passes FROM (
         SELECT *, k - 1 + k * (k - 1) + 16 * k AS n_params, -2 * loglik + (k - 1 + k * (k - 1) + 16 * k) * ln(n_obs) AS bic,
                -2 * loglik + 2 * (k - 1 + k * (k - 1) + 16 * k) AS aic FROM cands) c
       JOIN (SELECT sym, first(k ORDER BY -2 * loglik + (k - 1 + k * (k - 1) + 16 * k) * ln(n_obs), k) AS best_k, bool_or(k = 5 AND weakest_mean < 0.30) AS noise_state
             FROM cands GROUP BY sym) USING (sym)""",
)
def _(spark, d):
    r = Views(spark, d).rets().filter("ret IS NOT NULL").withColumn("k", F.explode(F.array(*[F.lit(k) for k in (2, 3, 4, 5)])))
    g = r.groupBy("sym", "k", F.floor(F.hour("ts") * F.col("k") / 24).alias("g")).agg(
        F.count("ret").alias("m"), (F.var_pop("ret") * F.count("ret")).alias("ss"), F.avg("ret").alias("mu")
    )
    models = g.groupBy("sym", "k").agg(
        F.sum("m").alias("n_obs"), (-0.5 * F.sum("m") * F.log(F.sum("ss") / F.sum("m"))).alias("loglik"),
        F.min(F.abs("mu")).alias("weakest_mean"),
    )
    return op.model_selection(models, KEY, len(FEATURES))


# -- hidden Markov models ------------------------------------------------------------------------------------------

SEEDS = [1, 8, 15, 22]
MIN_ROWS = 300
FIT_MONTHS = 18  # a model is fitted on its key's newest months; decoding covers all bars
MODEL = "sym k:i seed:i n_obs:i loglik:f3 iterations:i"


def fitted(v: Views, ks=(4,), seeds=SEEDS):
    f = settle(features(v))
    return f, settle(op.hmm_fit_grid(f, KEY, FEATURES, list(ks), seeds, n_iter=100, tol=1e-3, min_rows=MIN_ROWS, months=FIT_MONTHS))


@query("hmm_fit_grid", MODEL)
def _(spark, d):
    return fitted(Views(spark, d), (2, 3, 4, 5))[1]


@query("hmm_rolling", "sym window:i " + MODEL[4:])
def _(spark, d):
    f = settle(features(Views(spark, d)))
    return op.hmm_rolling(f, KEY, FEATURES, 4, SEEDS[:2], FIRST, 15 * DAY, STEP, min_rows=200)


@query("hmm_decode", "sym ts:t state:i label smoothed:i confidence:f4 entropy:f4")
def _(spark, d):
    f, m = fitted(Views(spark, d))
    return op.hmm_decode(f, op.best_models(m, KEY), KEY, FEATURES)


HORIZONS = [1, 6, 24, 48]


@query("current_regime", "sym ts:t smoothed:i confidence:f4 entropy:f4 dwell:f4 n_obs:i " + " ".join(f"p{h}_{s}:f4" for h in HORIZONS for s in range(4)))
def _(spark, d):
    f, m = fitted(Views(spark, d))
    best = settle(op.best_models(m, KEY))
    now = op.current_regime(op.hmm_decode(f, best, KEY, FEATURES), best, KEY, 4, HORIZONS)
    return now.withColumns({f"p{h}_{s}": F.get(f"forecast_{h}", F.lit(s)) for h in HORIZONS for s in range(4)})


@query("seed_stability", "sym seeds:i best:f3 worst:f3 near_best:f4 max_std:f4 labels:i passes")
def _(spark, d):
    return op.seed_stability(fitted(Views(spark, d))[1], KEY, FEATURES)
