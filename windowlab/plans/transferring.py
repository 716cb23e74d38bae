"""Queries: threshold regimes, gap decomposition, few-shot curves, sweeps, grids and search bookkeeping."""

from __future__ import annotations

from pyspark.sql import functions as F

from windowlab.fixtures import importances, scores, seed_results, sql_with, table
from windowlab.functions.hashing import sql_key_code, sql_order_key, sql_poisson, sql_poly_hash, sql_replicates
from windowlab.operators import joins, metrics, resample, selection, splits, stats, transfer
from windowlab.plans.inference import SUMMARY_SQL, T19, rounded
from windowlab.plans.registry import query
from windowlab.plans.scoring import threshold_sql
from windowlab.plans.splitting import SEED_KEY, run_rank_sql

SEEDS = [42, 43, 44]
K = "direction, seed, model"
_S = "CASE WHEN domain='static' THEN 'S_to_M' ELSE 'M_to_S' END AS direction"
_T = "CASE WHEN domain='mobile' THEN 'S_to_M' ELSE 'M_to_S' END AS direction"

PARTS_SQL = dict(
    rk=run_rank_sql(SEEDS),
    pt="""SELECT s.*, seed, CASE WHEN rn <= ceil(n*0.2::DOUBLE - 1e-9) THEN 'test'
        WHEN rn <= ceil(n*0.2::DOUBLE - 1e-9) + ceil((n-ceil(n*0.2::DOUBLE - 1e-9))*0.25::DOUBLE - 1e-9) THEN 'val' ELSE 'train' END AS src_part,
        CASE WHEN rn <= ceil(n*0.4::DOUBLE - 1e-9) THEN 'test' ELSE 'calib' END AS tgt_part FROM scores s JOIN rk USING (domain, run_id)""",
)
REG_SQL = dict(
    PARTS_SQL,
    sv=f"SELECT {_S}, seed, model, score, y FROM pt WHERE src_part='val'",
    tc=f"SELECT {_T}, seed, model, score, y FROM pt WHERE tgt_part='calib'",
    tt=f"SELECT {_T}, seed, model, run_id, score, y FROM pt WHERE tgt_part='test'",
    tf=f"SELECT {_T}, seed, model, score, y FROM pt",
    th=f"""SELECT a.direction, a.seed, a.model, a.t AS t_src, b.t AS t_orc, c.t AS t_int FROM ({threshold_sql('sv', K)}) a
       JOIN ({threshold_sql('tc', K)}) b USING ({K}) JOIN ({threshold_sql('tt', K)}) c USING ({K})""",
    ra=f"""SELECT {K}, t_src, t_orc, t_int, avg(CASE WHEN (score>=t_src/100.0::DOUBLE)=(y=1) THEN 1.0::DOUBLE ELSE 0 END) AS acc_src,
       avg(CASE WHEN (score>=t_orc/100.0::DOUBLE)=(y=1) THEN 1.0::DOUBLE ELSE 0 END) AS acc_orc,
       avg(CASE WHEN (score>=t_int/100.0::DOUBLE)=(y=1) THEN 1.0::DOUBLE ELSE 0 END) AS acc_int FROM tt JOIN th USING ({K}) GROUP BY ALL""",
    rf=f"SELECT {K}, avg(CASE WHEN (score>=t_src/100.0::DOUBLE)=(y=1) THEN 1.0::DOUBLE ELSE 0 END) AS acc_src_full FROM tf JOIN th USING ({K}) GROUP BY ALL",
    reg=f"SELECT * FROM ra JOIN rf USING ({K})",
)
_at = lambda m, c: f"max({c}) FILTER (model='{m}')"
DEC_SQL = dict(
    REG_SQL,
    dec=f"""SELECT direction, seed, {_at('by_qty', 'acc_src')} - {_at('by_disc', 'acc_src')} AS delta_total,
       {_at('by_qty', 'acc_orc')} - {_at('by_disc', 'acc_orc')} AS delta_ranking,
       ({_at('by_qty', 'acc_src')} - {_at('by_disc', 'acc_src')}) - ({_at('by_qty', 'acc_orc')} - {_at('by_disc', 'acc_orc')}) AS delta_threshold,
       {_at('by_disc', 'acc_src')} AS acc_src_large, {_at('by_qty', 'acc_src')} AS acc_src_small, {_at('by_disc', 't_src')} AS t_src_large, {_at('by_qty', 't_orc')} AS t_orc_small
       FROM reg GROUP BY 1, 2""",
    dl="""SELECT direction, seed, 'delta_total' AS component, delta_total AS v FROM dec UNION ALL SELECT direction, seed, 'delta_ranking', delta_ranking FROM dec
       UNION ALL SELECT direction, seed, 'delta_threshold', delta_threshold FROM dec""",
)
T2 = 4.302652729911275  # t quantile at .975 with 2 degrees of freedom (3 seeds), a table value


def parts(spark, sf):
    return transfer.with_parts(scores(spark, sf), "run_id", SEEDS)


def regimes(spark, sf):
    return transfer.regimes(transfer.part_histogram(parts(spark, sf)))


ACCS = ["acc_src", "acc_orc", "acc_int", "acc_src_full"]


@query("threshold_regimes", "C11 C1", sql_with("scores", **REG_SQL) + f"SELECT {K}, t_src, t_orc, t_int, round(acc_src,6) AS acc_src, round(acc_orc,6) AS acc_orc, round(acc_int,6) AS acc_int, round(acc_src_full,6) AS acc_src_full FROM reg")
def threshold_regimes(spark, sf):
    return rounded(regimes(spark, sf), ACCS)


@query(
    "gap_decomposition", "C11",
    sql_with("scores", **DEC_SQL) + """SELECT direction, seed, round(delta_total,6) AS delta_total, round(delta_ranking,6) AS delta_ranking,
      round(delta_threshold,6) AS delta_threshold, round(acc_src_large,6) AS acc_src_large, round(acc_src_small,6) AS acc_src_small, t_src_large, t_orc_small FROM dec""",
)
def gap_decomposition(spark, sf):
    d = transfer.decompose(regimes(spark, sf), "by_disc", "by_qty")
    names = ["delta_total", "delta_ranking", "delta_threshold", "acc_src_large", "acc_src_small"]
    return rounded(d, names).select("direction", "seed", *names, "t_src_large", "t_orc_small")


@query(
    "regime_summary", "C12 X11",
    sql_with("scores", **REG_SQL, l="""SELECT direction, model, 'acc_src' AS regime, acc_src AS v FROM reg UNION ALL SELECT direction, model, 'acc_orc', acc_orc FROM reg
      UNION ALL SELECT direction, model, 'acc_int', acc_int FROM reg""")
    + f"""SELECT direction, model, regime, count(*) AS n, round(avg(v),6) AS mean, round(stddev_samp(v),6) AS std,
      round(avg(v)-{T2}::DOUBLE*stddev_samp(v)/sqrt(3),6) AS ci_lo, round(avg(v)+{T2}::DOUBLE*stddev_samp(v)/sqrt(3),6) AS ci_hi FROM l GROUP BY 1,2,3""",
)
def regime_summary(spark, sf):
    s = transfer.regime_summary(regimes(spark, sf))
    return rounded(s.select("direction", "model", "regime", "n", "mean", "std", "ci_lo", "ci_hi"), ["mean", "std", "ci_lo", "ci_hi"])


@query(
    "component_summary", "C12 X12",
    sql_with("scores", **DEC_SQL) + f"""SELECT direction, component, count(*) AS n, round(avg(v),6) AS mean, round(avg(v)-{T2}::DOUBLE*stddev_samp(v)/sqrt(3),6) AS ci_lo,
      round(avg(v)+{T2}::DOUBLE*stddev_samp(v)/sqrt(3),6) AS ci_hi, round(avg(v)/(stddev_samp(v)/sqrt(3)),3) AS t_stat FROM dl GROUP BY 1, 2""",
)
def component_summary(spark, sf):
    c = transfer.component_summary(transfer.decompose(regimes(spark, sf), "by_disc", "by_qty"))
    return rounded(rounded(c, ["mean", "ci_lo", "ci_hi"]), ["t_stat"], 3).select("direction", "component", "n", "mean", "ci_lo", "ci_hi", "t_stat")


@query(
    "threshold_share", "C16",
    sql_with("scores", **DEC_SQL, m="SELECT direction, avg(delta_total) AS total, avg(delta_threshold) AS thr FROM dec GROUP BY 1")
    + """SELECT direction, round(total,6) AS total, round(thr,6) AS threshold, round(thr/total,5) AS share,
      CASE WHEN thr/total >= 0.5 THEN 'due to the cut' ELSE 'due to the features' END AS verdict FROM m""",
)
def threshold_share(spark, sf):
    c = transfer.component_summary(transfer.decompose(regimes(spark, sf), "by_disc", "by_qty"))
    return rounded(rounded(transfer.threshold_share(c), ["total", "threshold"]), ["share"], 5)


@query(
    "ordering_flags", "C15",
    sql_with("scores", **REG_SQL) + f"""SELECT {K}, concat_ws(',', CASE WHEN acc_int+0.005::DOUBLE<acc_orc THEN 'in-test cut below calibrated cut' END,
      CASE WHEN acc_orc+0.005::DOUBLE<acc_src THEN 'calibrated cut below source cut' END) AS flags FROM reg""",
)
def ordering_flags(spark, sf):
    f = transfer.ordering_flags(regimes(spark, sf))
    return f.select("direction", "seed", "model", F.array_join("flags", ",").alias("flags"))


@query(
    "score_drift_mechanism", "C14 X16",
    sql_with("scores", **REG_SQL,
             sd=f"""SELECT {_S}, seed, model, 1 AS s, score FROM pt WHERE src_part='test' UNION ALL SELECT {_T}, seed, model, 0, score FROM pt WHERE tgt_part='test'""",
             zc=f"SELECT {K}, ln(q/(1-q)) AS x, sum(s) AS a, sum(1-s) AS b FROM (SELECT *, greatest(1e-6::DOUBLE, least(1-1e-6::DOUBLE, score)) AS q FROM sd) GROUP BY {K}, x",
             zf=f"""SELECT {K}, x, sum(a) OVER w/sum(a) OVER (PARTITION BY {K}) AS fa, sum(b) OVER w/sum(b) OVER (PARTITION BY {K}) AS fb,
               lead(x) OVER (PARTITION BY {K} ORDER BY x) AS nx FROM zc WINDOW w AS (PARTITION BY {K} ORDER BY x)""",
             w1=f"SELECT {K}, sum(abs(fa-fb)*(nx-x)) AS w1 FROM zf GROUP BY {K}",
             me=f"SELECT {K}, avg(score) FILTER (s=1) AS p_src, avg(score) FILTER (s=0) AS p_tgt FROM sd GROUP BY {K}")
    + f"""SELECT direction, model, round(avg(t_src)/100,6) AS t_source, round(avg(t_int)/100,6) AS t_target, round(avg(abs(t_src-t_int))/100,6) AS abs_t_shift,
      round(avg(w1)::DOUBLE,4) AS w1_logit, round(stddev_samp(w1)::DOUBLE,4) AS w1_logit_std, round(avg(p_src),6) AS mean_p_source, round(avg(p_tgt),6) AS mean_p_target
      FROM reg JOIN w1 USING ({K}) JOIN me USING ({K}) GROUP BY 1, 2""",
)
def score_drift_mechanism(spark, sf):
    m = transfer.mechanism(parts(spark, sf), regimes(spark, sf))
    return rounded(rounded(m, ["t_source", "t_target", "abs_t_shift", "mean_p_source", "mean_p_target"]), ["w1_logit", "w1_logit_std"], 4)


FEW_SEEDS, FEW_R, FEW_N = SEEDS, 5, [25, 50, 100, 250, 500]
FEW_SQL = dict(
    REG_SQL,
    pool="SELECT domain, seed, run_id FROM rk WHERE rn > ceil(n*0.4::DOUBLE - 1e-9)",
    fr=f"""SELECT domain, seed, run_id, r, count(*) OVER (PARTITION BY domain, seed, r) AS m,
       row_number() OVER (PARTITION BY domain, seed, r ORDER BY {sql_order_key("@concat_ws('|', domain, seed, r)", 'run_id')}, run_id) AS k
       FROM pool, (SELECT CAST(range AS INTEGER) AS r FROM range({FEW_R}))""",
    fs="SELECT domain, seed, run_id, r, CAST(n_runs AS INTEGER) AS n_runs FROM fr, (VALUES (25),(50),(100),(250),(500)) v(n_runs) WHERE k <= n_runs AND n_runs <= m",
    fp=f"SELECT {_T}, seed, model, n_runs, r, score, y FROM pt JOIN fs USING (domain, seed, run_id)",
    fw=f"SELECT {K}, n_runs, r, count(*) AS nw FROM fp GROUP BY ALL",
    ft=threshold_sql("fp", f"{K}, n_runs, r"),
    ts=f"SELECT {K}, score, sum(y) AS p, sum(1-y) AS q FROM tt GROUP BY ALL",
    fa=f"SELECT {K}, n_runs, r, sum(CASE WHEN score>=t/100.0::DOUBLE THEN p ELSE q END)::DOUBLE/sum(p+q) AS acc FROM ft JOIN ts USING ({K}) GROUP BY ALL",
    fm=f"SELECT {K}, n_runs, avg(acc) AS acc, avg(nw) AS nw FROM fa JOIN fw USING ({K}, n_runs, r) GROUP BY ALL",
    fo="SELECT direction, model, n_runs, avg(nw) AS nw, avg(acc) AS m, stddev_samp(acc) AS s FROM fm GROUP BY 1,2,3",
    fx="SELECT direction, model, avg(acc_src) AS sr, avg(acc_orc) AS orc FROM reg GROUP BY 1, 2",
)


def fewshot_sample(spark, sf):
    runs = scores(spark, sf).select("domain", "run_id").distinct()
    pool = splits.target_windows(runs, ["domain"], "run_id", FEW_SEEDS).where("part = 'calib'").select("domain", "seed", "run_id")
    return splits.fewshot_runs(pool, ["domain", "seed"], "run_id", FEW_N, FEW_R)


@query(
    "fewshot_curve", "C13 P11",
    sql_with("scores", **FEW_SQL) + """SELECT direction, model, n_runs, round(nw,4) AS n_windows, round(m,6) AS acc_mean, round(coalesce(s,0),6) AS acc_std,
      round(sr,6) AS source_ref, round(orc,6) AS oracle_ref FROM fo JOIN fx USING (direction, model)""",
)
def fewshot_curve(spark, sf):
    p = parts(spark, sf)
    hist = transfer.part_histogram(p)
    c = transfer.fewshot_curve(p, fewshot_sample(spark, sf), transfer.regimes(hist), "run_id", hist=hist)
    return rounded(rounded(c, ["acc_mean", "acc_std", "source_ref", "oracle_ref"]), ["n_windows"], 4)


ISO_KEY = f"{K}, n_runs, r"
ISO_SQL = dict(
    FEW_SQL,
    ic=f"SELECT {ISO_KEY}, score AS s, sum(y)::DOUBLE AS p, count(*)::DOUBLE AS w FROM fp WHERE n_runs >= 250 GROUP BY ALL",
    ir=f"""SELECT *, row_number() OVER (PARTITION BY {ISO_KEY} ORDER BY s) AS i, sum(p) OVER (PARTITION BY {ISO_KEY} ORDER BY s) AS cp,
        sum(w) OVER (PARTITION BY {ISO_KEY} ORDER BY s) AS cw FROM ic""",
    ij=f"SELECT {ISO_KEY}, a.i AS j, b.i AS k, (b.cp-a.cp+a.p)/(b.cw-a.cw+a.w) AS v FROM ir a JOIN ir b USING ({ISO_KEY}) WHERE a.i <= b.i",
    im=f"SELECT {ISO_KEY}, q.i, j, min(v) AS v FROM ir q JOIN ij USING ({ISO_KEY}) WHERE j <= q.i AND k >= q.i GROUP BY {ISO_KEY}, q.i, j",
    ix=f"SELECT {ISO_KEY}, i, s, max(v) AS f FROM im JOIN ir USING ({ISO_KEY}, i) GROUP BY ALL",
    il=f"SELECT *, lag(f) OVER (PARTITION BY {ISO_KEY} ORDER BY i) AS pf, lag(s) OVER (PARTITION BY {ISO_KEY} ORDER BY i) AS ps FROM ix",
    iq=f"""SELECT {ISO_KEY}, min(CASE WHEN f >= 0.5 THEN CASE WHEN pf IS NULL THEN -1.0::DOUBLE WHEN pf >= 0.5 THEN NULL
         ELSE ps + (0.5::DOUBLE-pf)/(f-pf)*(s-ps) END END) AS cut FROM il GROUP BY ALL""",
)


@query(
    "fewshot_isotonic", "T10 C13",
    sql_with("scores", **ISO_SQL) + f"SELECT {ISO_KEY}, round(sum(CASE WHEN score >= coalesce(cut, 9) THEN p ELSE q END)::DOUBLE/sum(p+q),6) AS acc FROM ts JOIN iq USING ({K}) GROUP BY ALL",
)
def fewshot_isotonic(spark, sf):
    return rounded(transfer.isotonic_fewshot(parts(spark, sf), fewshot_sample(spark, sf), "run_id"), ["acc"])


N_AVG = 2000
_c = lambda m, t: f"count(*) FILTER (model='{m}' AND (score>={t}/100.0::DOUBLE)=(y=1))"


@query(
    "averaged_cluster_bootstrap", "P9 C12",
    sql_with("scores", **REG_SQL,
             ru=f"""SELECT direction, seed, run_id, count(*) FILTER (model='by_qty') AS n, {_c('by_qty', 't_src')} AS a4, {_c('by_disc', 't_src')} AS a33,
               {_c('by_qty', 't_orc')} AS o4, {_c('by_disc', 't_orc')} AS o33 FROM tt JOIN th USING ({K}) GROUP BY 1,2,3""",
             rp=sql_replicates(12345, N_AVG),
             bx=f"SELECT *, {sql_key_code('seed', 'run_id')} FROM ru",
             bw=f"SELECT bx.*, rep, {sql_poisson(sql_poly_hash())} AS w FROM bx, rp",
             g="SELECT direction, seed, rep, sum(w*n)::DOUBLE AS n, sum(w*(a4-a33))::DOUBLE AS t, sum(w*(o4-o33))::DOUBLE AS r FROM bw GROUP BY 1,2,3",
             l="""SELECT direction, rep, 'delta_total' AS component, avg(t/n) AS value FROM g GROUP BY 1,2 UNION ALL SELECT direction, rep, 'delta_ranking', avg(r/n) FROM g GROUP BY 1,2
               UNION ALL SELECT direction, rep, 'delta_threshold', avg((t-r)/n) FROM g GROUP BY 1,2""")
    + f"SELECT direction, component, {SUMMARY_SQL} FROM l GROUP BY 1, 2",
)
def averaged_cluster_bootstrap(spark, sf):
    reg = regimes(spark, sf).select("direction", "seed", "model", "t_src", "t_orc")
    test = parts(spark, sf).where("tgt_part = 'test'").withColumn("direction", transfer.as_target())
    j = test.join(F.broadcast(reg), ["direction", "seed", "model"])  # directions x seeds x models rows
    right = lambda m, t: ((F.col("model") == m) & ((F.col("score") >= F.col(t) / 100.0) == (F.col("y") == 1))).cast("int")
    runs = resample.run_sums(
        j, ["direction", "seed"], "run_id", n=(F.col("model") == "by_qty").cast("int"),
        a4=right("by_qty", "t_src"), a33=right("by_disc", "t_src"), o4=right("by_qty", "t_orc"), o33=right("by_disc", "t_orc"))

    def components(n, a4, a33, o4, o33):
        total, ranking = (a4 - a33) / n, (o4 - o33) / n
        return F.array(total, ranking, (a4 - a33 - o4 + o33) / n)

    reps = resample.cluster_bootstrap(runs, ["direction", "seed"], "run_id", ["n", "a4", "a33", "o4", "o33"], components, N_AVG, 12345, ["seed", "run_id"])
    names = F.array(F.lit("delta_total"), F.lit("delta_ranking"), F.lit("delta_threshold"))
    long = reps.select("direction", "seed", "rep", F.explode(F.arrays_zip(names.alias("component"), F.col("value"))).alias("z"))
    long = long.select("direction", "seed", "rep", F.col("z.component").alias("component"), F.col("z.value").alias("value"))
    return rounded(resample.averaged_bootstrap(long, ["direction", "component"]), ["mean", "std", "ci_lo", "ci_hi"])


@query(
    "confusion_panels", "C10 M13 M14",
    sql_with("scores", **REG_SQL,
             al=f"SELECT {_S}, 'source' AS side, seed, model, score, y FROM pt UNION ALL SELECT {_T}, 'target', seed, model, score, y FROM pt",
             k=f"""SELECT direction, side, model, seed, CASE WHEN y=0 AND score<t_src/100.0::DOUBLE THEN 'tn' WHEN y=0 THEN 'fp' WHEN score<t_src/100.0::DOUBLE THEN 'fn' ELSE 'tp' END AS cell
               FROM al JOIN th USING ({K})""",
             g="SELECT direction, side, model, seed, cell, count(*) AS c FROM k GROUP BY ALL",
             m="SELECT direction, side, model, cell, avg(c) AS mean FROM g GROUP BY ALL",
             sc="SELECT *, mean*40000/sum(mean) OVER (PARTITION BY direction, side, model) AS s FROM m",
             f="SELECT *, floor(s) AS fl, round(s-floor(s),9) AS rem FROM sc",
             o="SELECT *, row_number() OVER (PARTITION BY direction, side, model ORDER BY rem DESC, cell) AS rn, 40000 - sum(fl) OVER (PARTITION BY direction, side, model) AS deficit FROM f")
    + "SELECT direction, side, model, cell, CAST(fl + CASE WHEN rn<=deficit THEN 1 ELSE 0 END AS BIGINT) AS n, round(100*(fl + CASE WHEN rn<=deficit THEN 1 ELSE 0 END)/40000,6) AS pct FROM o",
)
def confusion_panels(spark, sf):
    """Source-tuned threshold on whole source and whole target, from the histogram alone."""
    h = transfer.part_histogram(parts(spark, sf))
    both = h.withColumns({"direction": transfer.as_source(), "side": F.lit("source")}).unionByName(
        h.withColumns({"direction": transfer.as_target(), "side": F.lit("target")}))
    reg = transfer.regimes(h).select("direction", "seed", "model", "t_src")
    up = F.col("_b") >= F.col("t_src")
    j = both.join(F.broadcast(reg), ["direction", "seed", "model"]).select("direction", "side", "model", "seed", F.inline(F.array(
        F.struct(F.when(up, "tp").otherwise("fn").alias("cell"), F.col("_p").alias("c")),
        F.struct(F.when(up, "fp").otherwise("tn").alias("cell"), F.col("_q").alias("c")))))
    cells = j.groupBy("direction", "side", "model", "seed", "cell").agg(F.sum("c").alias("c"))
    return rounded(metrics.rescaled_confusion(cells, ["direction", "side", "model"], "cell", "c", 40000), ["pct"])


# ---- sweeps and result grids ------------------------------------------------------------------

def grid_results(spark, sf):
    """Per-seed results of a (method, K, classifier) grid, both transfer directions."""
    l, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    j = l.join(p.select("p_partkey", "p_size"), l.l_partkey == p.p_partkey)
    return j.groupBy(
        F.col("l_returnflag").alias("method"), F.col("l_linenumber").alias("K"),
        F.concat(F.lit("clf"), F.pmod(F.col("p_size"), F.lit(3)).cast("string")).alias("classifier"),
        F.pmod("l_orderkey", F.lit(5)).cast("int").alias("seed"),
    ).agg(
        F.avg(F.when(F.col("l_linestatus") == "F", F.col("l_discount"))).alias("acc_SM"),
        F.avg(F.when(F.col("l_linestatus") == "O", F.col("l_discount") + F.col("l_tax") / 10)).alias("acc_MS"),
    )


GRID_SQL = dict(gr="""SELECT l_returnflag AS method, l_linenumber AS "K", 'clf' || CAST(p_size % 3 AS VARCHAR) AS classifier, CAST(l_orderkey % 5 AS INTEGER) AS seed,
    avg(l_discount) FILTER (l_linestatus='F') AS acc_SM, avg(l_discount + l_tax/10) FILTER (l_linestatus='O') AS acc_MS
    FROM lineitem JOIN part ON l_partkey=p_partkey GROUP BY 1,2,3,4""",
    g1='SELECT method, "K", classifier, avg(acc_SM) AS sm, avg(acc_MS) AS ms FROM gr GROUP BY 1,2,3',
    g2='SELECT method, "K", avg(sm) AS sm, avg(ms) AS ms FROM g1 GROUP BY 1,2')


def _with(d):
    return "WITH " + ", ".join(f"{k} AS ({v})" for k, v in d.items()) + "\n"


@query("classifier_aggregates", "C5 J3", _with(GRID_SQL) + """SELECT method, "K", classifier, round(avg(acc_SM),8) AS acc_SM_mean, round(stddev_samp(acc_SM),8) AS acc_SM_std,
    round(avg(acc_MS),8) AS acc_MS_mean, count(*) AS n_seeds FROM gr GROUP BY 1,2,3""")
def classifier_aggregates(spark, sf):
    """Two aggregate sets on the same keys in one group-by."""
    g = grid_results(spark, sf).groupBy("method", "K", "classifier").agg(
        F.avg("acc_SM").alias("acc_SM_mean"), F.stddev_samp("acc_SM").alias("acc_SM_std"), F.avg("acc_MS").alias("acc_MS_mean"), F.count(F.lit(1)).alias("n_seeds"))
    return rounded(g, ["acc_SM_mean", "acc_SM_std", "acc_MS_mean"], 8)


@query("two_level_means", "C5", _with(GRID_SQL) + 'SELECT method, "K", round(sm,8) AS "acc_SM_mean", round(ms,8) AS "acc_MS_mean" FROM g2')
def two_level_means(spark, sf):
    return rounded(transfer.two_level_mean(grid_results(spark, sf), ["method", "K"], "classifier", ["acc_SM", "acc_MS"]), ["acc_SM_mean", "acc_MS_mean"], 8)


@query(
    "recommended_k", "C6",
    _with(dict(GRID_SQL, a='SELECT *, (sm+ms)/2 AS av, max((sm+ms)/2) OVER (PARTITION BY method) AS mx FROM g2'))
    + """SELECT method, min("K") AS "recommended_K", round(max(mx),8) AS max_acc_avg, round(arg_min(sm,"K"),8) AS "rec_acc_SM_mean", round(arg_min(ms,"K"),8) AS "rec_acc_MS_mean"
    FROM a WHERE av >= 0.99::DOUBLE*mx GROUP BY method""",
)
def recommended_k(spark, sf):
    t = transfer.two_level_mean(grid_results(spark, sf), ["method", "K"], "classifier", ["acc_SM", "acc_MS"])
    return rounded(transfer.recommend_k(t, ["method"], "K", "acc_SM_mean", "acc_MS_mean"), ["max_acc_avg", "rec_acc_SM_mean", "rec_acc_MS_mean"], 8)


@query(
    "k_sweep_summary", "C2 C3",
    _with(dict(lo="""SELECT l_linenumber AS k, CAST(l_orderkey % 20 AS INTEGER) AS seed, CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'S' WHEN 'AO' THEN 'M' WHEN 'NF' THEN 'SM' WHEN 'NO' THEN 'MS' END AS direction,
      avg(l_discount) AS acc FROM lineitem WHERE l_returnflag IN ('A','N') GROUP BY 1,2,3""", g="SELECT k, direction, avg(acc) AS m, stddev_samp(acc) AS s FROM lo GROUP BY 1,2"))
    + """SELECT k AS "K", """ + ", ".join(f"round(max(m) FILTER (direction='{d}'),8) AS \"acc_{d}\", round(max(s) FILTER (direction='{d}'),8) AS \"std_{d}\"" for d in ("S", "M", "SM", "MS"))
    + """, round(abs(max(m) FILTER (direction='SM') - max(m) FILTER (direction='MS')),8) AS asymmetry FROM g GROUP BY k""",
)
def k_sweep_summary(spark, sf):
    l = table(spark, sf, "lineitem").where(F.col("l_returnflag").isin("A", "N"))
    source = F.col("l_linestatus") == "F"
    d = F.when(F.col("l_returnflag") == "A", F.when(source, "S").otherwise("M")).otherwise(F.when(source, "SM").otherwise("MS"))
    r = l.groupBy(F.col("l_linenumber").alias("K"), F.pmod("l_orderkey", F.lit(20)).cast("int").alias("seed"), d.alias("direction")).agg(F.avg("l_discount").alias("acc"))
    out = transfer.sweep_summary(r, ["K"])
    return rounded(out, [c for c in out.columns if c != "K"], 8)


@query(
    "baseline_drift", "C17",
    sql_with("seed_results") + """SELECT direction, round(avg(acc),8) AS mean, CASE direction WHEN 'SM' THEN 0.05::DOUBLE ELSE 0.03::DOUBLE END AS reference,
      abs(avg(acc) - CASE direction WHEN 'SM' THEN 0.05::DOUBLE ELSE 0.03::DOUBLE END) <= 0.01 AS ok FROM seed_results WHERE config='A' GROUP BY direction""",
)
def baseline_drift(spark, sf):
    d = transfer.baseline_drift(seed_results(spark, sf).where("config = 'A'"), {"SM": 0.05, "MS": 0.03})
    return rounded(d, ["mean"], 8).select("direction", "mean", "reference", "ok")


KGRID = [3, 5, 8, 10]


@query(
    "resumable_grid", "C4 J6 J7",
    sql_with(
        "importances",
        rk="SELECT *, row_number() OVER (PARTITION BY method, domain, seed ORDER BY importance DESC, feature) AS rk FROM importances",
        bo="SELECT method, seed, feature, count(*) AS c, max(rk) AS worst, avg(importance) AS a FROM rk GROUP BY 1,2,3",
        ns="SELECT method, count(DISTINCT seed) AS n_seeds FROM importances GROUP BY 1",
        ct="""SELECT b.method, CAST(k AS INTEGER) AS K, feature, n_seeds, sum(a)/n_seeds AS avg_importance, count(*) FILTER (c=2 AND worst<=k) AS n_hits
            FROM bo b JOIN ns USING (method), (VALUES (3),(5),(8),(10)) v(k) GROUP BY b.method, k, feature, n_seeds""",
        so="SELECT *, row_number() OVER (PARTITION BY method, K ORDER BY (n_hits/n_seeds::DOUBLE >= 0.4) DESC, avg_importance DESC, feature) AS p FROM ct",
        st="SELECT method, K, 'soft' AS variant, feature FROM so WHERE p <= K UNION ALL SELECT method, K, 'strict', feature FROM ct WHERE n_hits/n_seeds::DOUBLE >= 0.4",
        fk="SELECT method, K, variant, string_agg(feature, ';' ORDER BY feature) AS feature_key FROM st GROUP BY 1,2,3",
        cells="SELECT fk.*, classifier, seed FROM fk, (VALUES ('gbt'),('lr')) c(classifier), (VALUES (0),(1)) s(seed) WHERE NOT (method='A' AND K=3 AND seed=0)",
        ev="SELECT DISTINCT feature_key, classifier, seed FROM cells",
        fi="SELECT feature, avg(importance) AS m FROM importances GROUP BY 1",
        sc="SELECT feature_key, classifier, seed, sum(m) + seed AS metric FROM (SELECT *, unnest(string_split(feature_key, ';')) AS feature FROM ev) JOIN fi USING (feature) GROUP BY 1,2,3")
    + """SELECT method, K AS "K", variant, classifier, CAST(seed AS INTEGER) AS seed, feature_key, round(metric,4) AS metric FROM cells JOIN sc USING (feature_key, classifier, seed)""",
)
def resumable_grid(spark, sf):
    """Experiment grid: finished cells are skipped, cells with one feature set share one evaluation."""
    imp = importances(spark, sf)
    counts = selection.stable_counts(imp, KGRID)
    sets = selection.universal_set(counts, 0.4, "soft").withColumn("variant", F.lit("soft")).unionByName(
        selection.universal_set(counts, 0.4, "strict").withColumn("variant", F.lit("strict")))
    lists = sets.groupBy("method", "K", "variant").agg(F.collect_list("feature").alias("features"))
    axes = F.explode(F.array(*[F.struct(F.lit(c).alias("classifier"), F.lit(s).alias("seed")) for c in ("gbt", "lr") for s in (0, 1)]))
    cells = lists.select("*", axes.alias("x")).select("method", "K", "variant", "features", "x.*")
    done = cells.where("method = 'A' AND K = 3 AND seed = 0").select("method", "K", "seed")
    todo = joins.pending(cells, done, ["method", "K", "seed"])
    keyed, evals = transfer.share_evaluations(todo, "features")
    value = imp.groupBy("feature").agg(F.avg("importance").alias("m"))
    result = evals.select("*", F.explode(F.split("feature_key", ";")).alias("feature")).join(value, "feature")
    result = result.groupBy("feature_key", "classifier", "seed").agg((F.sum("m") + F.max("seed")).alias("metric"))
    out = keyed.join(result, ["feature_key", "classifier", "seed"])
    return rounded(out.select("method", "K", "variant", "classifier", "seed", "feature_key", "metric"), ["metric"], 4)


# ---- search bookkeeping -----------------------------------------------------------------------

def candidates(spark, sf):
    """Cross-validated candidates of a search: depth and rate per (domain, model)."""
    l, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    j = l.join(p.select("p_partkey", "p_size"), l.l_partkey == p.p_partkey)
    return j.groupBy(
        F.when(F.col("l_linestatus") == "F", "static").otherwise("mobile").alias("domain"), F.col("l_returnflag").alias("model"),
        (F.pmod("p_size", F.lit(6)) + 1).cast("double").alias("depth"), F.col("l_linenumber").cast("double").alias("rate"),
    ).agg(F.round(F.avg("l_discount"), 9).alias("mean_cv"))


CAND_SQL = dict(
    ca="""SELECT CASE WHEN l_linestatus='F' THEN 'static' ELSE 'mobile' END AS domain, l_returnflag AS model, (p_size % 6 + 1)::DOUBLE AS depth, l_linenumber::DOUBLE AS rate,
      round(avg(l_discount),9) AS mean_cv FROM lineitem JOIN part ON l_partkey=p_partkey GROUP BY 1,2,3,4""",
    be="SELECT domain, model, depth, rate, mean_cv FROM (SELECT *, row_number() OVER (PARTITION BY domain, model ORDER BY mean_cv DESC, depth, rate) AS rn FROM ca) WHERE rn=1",
)


@query("best_candidates", "T13 S7", _with(CAND_SQL) + "SELECT * FROM be")
def best_candidates(spark, sf):
    return transfer.best_candidates(candidates(spark, sf), ["domain", "model"], "mean_cv", ["depth", "rate"])


@query(
    "edge_parameters", "T15 D11",
    _with(dict(CAND_SQL, lg="SELECT domain, model, 'depth' AS param, depth AS value FROM be UNION ALL SELECT domain, model, 'rate', rate FROM be"))
    + """SELECT domain, model, param, value, CASE WHEN param='depth' THEN CASE WHEN model='A' THEN value=1 ELSE value IN (1,6) END ELSE value IN (1,7) END AS is_edge FROM lg""",
)
def edge_parameters(spark, sf):
    """Best values at the ends of their range; the depth of model A has an open upper end."""
    c = candidates(spark, sf)
    best = transfer.best_candidates(c, ["domain", "model"], "mean_cv", ["depth", "rate"]).unpivot(["domain", "model"], ["depth", "rate"], "param", "value")
    grid = c.unpivot(["model"], ["depth", "rate"], "param", "v").groupBy("model", "param").agg(F.array_sort(F.collect_set("v")).alias("values"))
    grid = grid.withColumn("values", F.when((F.col("model") == "A") & (F.col("param") == "depth"), F.concat("values", F.array(F.lit(-1.0)))).otherwise(F.col("values")))
    return transfer.edge_params(best, grid, ["domain", "model"])


RUN_SQL = dict(
    nw="SELECT l_returnflag AS model, CASE WHEN l_linestatus='F' THEN 'static' ELSE 'mobile' END AS domain, avg(l_discount) AS acc FROM lineitem WHERE l_linenumber<=3 GROUP BY 1,2",
    od="SELECT l_returnflag AS model, CASE WHEN l_linestatus='F' THEN 'static' ELSE 'mobile' END AS domain, avg(l_discount) AS acc FROM lineitem WHERE l_linenumber>3 AND l_returnflag<>'R' GROUP BY 1,2",
)


def runs_by_line(spark, sf, cond):
    return table(spark, sf, "lineitem").where(cond).groupBy(
        F.col("l_returnflag").alias("model"), F.when(F.col("l_linestatus") == "F", "static").otherwise("mobile").alias("domain")
    ).agg(F.avg("l_discount").alias("acc"))


@query(
    "edge_search_comparison", "T16",
    _with(RUN_SQL) + """SELECT model, domain, round(nw.acc,8) AS acc, round(od.acc,8) AS previous, round(nw.acc-od.acc,8) AS delta,
      CASE WHEN od.acc IS NULL THEN 'no previous' WHEN abs(nw.acc-od.acc) < 0.0003 THEN 'noise' WHEN nw.acc-od.acc >= 0.0003 THEN 'improvement' ELSE 'regression' END AS note
      FROM nw LEFT JOIN od USING (model, domain)""",
)
def edge_search_comparison(spark, sf):
    c = transfer.compare_runs(runs_by_line(spark, sf, "l_linenumber <= 3"), runs_by_line(spark, sf, "l_linenumber > 3 AND l_returnflag <> 'R'"), ["model", "domain"], "acc", band=0.0003)
    return rounded(c, ["acc", "previous", "delta"], 8)


@query(
    "merged_searches", "T17",
    """WITH e AS (SELECT p_brand AS model, avg(p_retailprice) AS acc FROM part WHERE p_size<=30 GROUP BY 1), f AS (SELECT p_brand AS model, avg(p_retailprice) AS acc FROM part WHERE p_size>30 GROUP BY 1)
    SELECT model, round(CASE WHEN model='Brand#7' AND f.acc IS NOT NULL THEN f.acc ELSE e.acc END,5) AS acc, CASE WHEN model='Brand#7' AND f.acc IS NOT NULL THEN 'focused' ELSE 'extended' END AS origin
    FROM e LEFT JOIN f USING (model) WHERE model <> 'Brand#9'""",
)
def merged_searches(spark, sf):
    p = table(spark, sf, "part")
    make = lambda cond: p.where(cond).groupBy(F.col("p_brand").alias("model")).agg(F.avg("p_retailprice").alias("acc"))
    return rounded(transfer.merge_searches(make("p_size <= 30"), make("p_size > 30"), "model", ["Brand#7"], drop=["Brand#9"]), ["acc"], 5)


@query(
    "unfinished_models", "T18 J6",
    """WITH g AS (SELECT DISTINCT p_brand AS model FROM part), r AS (SELECT p_brand AS model, CASE WHEN avg(p_size)>25 THEN avg(p_size) END AS acc,
      CASE WHEN count(*)%3=0 THEN 'failed' ELSE '' END AS error FROM part GROUP BY 1), f AS (SELECT DISTINCT p_brand AS model FROM part WHERE p_type='ECONOMY')
    SELECT model FROM g WHERE model NOT IN (SELECT model FROM r WHERE acc IS NOT NULL AND error='' AND model IN (SELECT model FROM f))""",
)
def unfinished_models(spark, sf):
    p = table(spark, sf, "part").withColumnRenamed("p_brand", "model")
    r = p.groupBy("model").agg(
        F.when(F.avg("p_size") > 25, F.avg("p_size")).alias("test_accuracy"), F.when(F.count(F.lit(1)) % 3 == 0, "failed").otherwise("").alias("error"))
    return transfer.still_to_do(p.select("model").distinct(), r, p.where("p_type = 'ECONOMY'").select("model"), ["model"])


@query(
    "resolved_search_spaces", "T14",
    """WITH s AS (SELECT p_brand AS model, CASE WHEN p_type='ECONOMY' THEN 'extended' ELSE 'narrow' END AS mode, list_sort(list(DISTINCT p_size)) AS vals FROM part GROUP BY 1,2),
    w AS (SELECT DISTINCT p_brand AS model FROM part), h AS (SELECT model, CASE WHEN EXISTS (SELECT 1 FROM s WHERE s.model=w.model AND s.mode='extended') THEN 'extended' ELSE 'narrow' END AS mode FROM w)
    SELECT model, 'extended' AS asked, mode, 'size' AS param, array_to_string(vals, ',') AS vals FROM h JOIN s USING (model, mode)""",
)
def resolved_search_spaces(spark, sf):
    p = table(spark, sf, "part")
    mode = F.when(F.col("p_type") == "ECONOMY", "extended").otherwise("narrow")
    spaces = p.groupBy(F.col("p_brand").alias("model"), mode.alias("mode")).agg(F.array_sort(F.collect_set("p_size")).alias("values")).withColumn("param", F.lit("size"))
    wanted = p.select(F.col("p_brand").alias("model"), F.lit("extended").alias("mode")).distinct()
    out = transfer.resolve_space(spaces, wanted)
    return out.select("model", "asked", "mode", "param", F.array_join(F.transform("values", lambda v: v.cast("string")), ",").alias("vals"))
