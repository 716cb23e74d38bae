"""Queries: splits, folds, scaling, filters and selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from windowlab.fixtures import MANY, WIDE_FEATURES, importances, many, sql_with, table, wide
from windowlab.functions.hashing import sql_order_key
from windowlab.operators import joins, reshape, scaling, selection, splits
from windowlab.plans.registry import query
from windowlab.session import fresh_path, stored
from windowlab.sources import sinks

SEEDS = [42, 43, 44]
SEED_KEY = "@CAST(seed AS VARCHAR)"


def run_rank_sql(seeds=SEEDS, source="wide"):
    vals = ", ".join(f"({s})" for s in seeds)
    return (f"SELECT domain, run_id, CAST(seed AS INTEGER) AS seed, count(*) OVER (PARTITION BY domain, seed) AS n, "
            f"row_number() OVER (PARTITION BY domain, seed ORDER BY {sql_order_key(SEED_KEY, 'run_id')}, run_id) AS rn "
            f"FROM (SELECT DISTINCT domain, run_id FROM {source}), (VALUES {vals}) s(seed)")


SPLIT_SQL = """SELECT domain, run_id, seed, CASE WHEN rn <= ceil(n*0.2::DOUBLE - 1e-9) THEN 'test'
    WHEN rn <= ceil(n*0.2::DOUBLE - 1e-9) + ceil((n-ceil(n*0.2::DOUBLE - 1e-9))*0.25::DOUBLE - 1e-9) THEN 'val' ELSE 'train' END AS part FROM rk"""


def split(spark, sf, seeds=SEEDS):
    return splits.grouped_split(wide(spark, sf), ["domain"], "run_id", seeds)


@query("grouped_split", "P1 D7 D4", sql_with("wide", rk=run_rank_sql(), sp=SPLIT_SQL) + "SELECT domain, run_id, seed, part FROM sp")
def grouped_split(spark, sf):
    return split(spark, sf)


@query(
    "grouped_split_windows", "P1 U6",
    sql_with("wide", rk=run_rank_sql(), sp=SPLIT_SQL)
    + """SELECT domain, seed, part, count(*) AS n_windows, count(DISTINCT run_id) AS n_runs, 0::BIGINT AS n_shared
    FROM wide JOIN sp USING (domain, run_id) GROUP BY 1, 2, 3""",
)
def grouped_split_windows(spark, sf):
    w = splits.split_windows(wide(spark, sf).select("domain", "run_id"), ["domain"], "run_id", SEEDS)
    # one row per run before the shuffle, not one per run, seed and part; all that follows stays where the run is
    cells = [(s, p) for s in SEEDS for p in ("train", "val", "test")]
    wide_runs = w.groupBy("domain", "run_id").agg(*[F.count_if((F.col("seed") == s) & (F.col("part") == p)).alias(f"c{k}") for k, (s, p) in enumerate(cells)])
    each = F.array(*[F.struct(F.lit(s).alias("seed"), F.lit(p).alias("part"), F.col(f"c{k}").alias("c")) for k, (s, p) in enumerate(cells)])
    runs = wide_runs.select("domain", "run_id", F.inline(each)).where("c > 0")
    counts = runs.groupBy("domain", "seed", "part").agg(F.sum("c").alias("n_windows"), F.count(F.lit(1)).alias("n_runs"))
    return counts.join(F.broadcast(reshape.overlap_count(runs, ["domain", "seed", "run_id"], "part")))  # one row


@query(
    "train_test_split", "P2",
    sql_with("wide", rk=run_rank_sql([7]))
    + "SELECT domain, run_id, seed, CASE WHEN rn <= ceil(n*0.2::DOUBLE - 1e-9) THEN 'test' ELSE 'train' END AS part FROM rk",
)
def train_test_split(spark, sf):
    return splits.grouped_split(wide(spark, sf), ["domain"], "run_id", [7], val=0)


_STRAT = f"row_number() OVER (PARTITION BY domain, label ORDER BY {sql_order_key(42, 'row_key')}, row_key)"


@query(
    "stratified_split", "P3",
    sql_with("wide", rk=f"SELECT *, {_STRAT} AS rn, count(*) OVER (PARTITION BY domain, label) AS n FROM wide", sp=SPLIT_SQL.replace("run_id, seed", "label, row_key"))
    + "SELECT row_key, domain, label, part FROM sp",
)
def stratified_split(spark, sf):
    w = wide(spark, sf).select("row_key", "domain", "label")
    return splits.stratified_split(w, ["domain", "label"], "row_key", 42).select("row_key", "domain", "label", "part")


@query(
    "target_split", "P4 U6",
    sql_with("wide", rk=run_rank_sql())
    + "SELECT domain, run_id, seed, CASE WHEN rn <= ceil(n*0.4::DOUBLE - 1e-9) THEN 'test' ELSE 'calib' END AS part FROM rk",
)
def target_split(spark, sf):
    return splits.target_split(wide(spark, sf), ["domain"], "run_id", SEEDS)


@query(
    "stratified_folds", "P5",
    sql_with("wide") + f"SELECT row_key, CAST(({_STRAT} - 1) % 3 AS INTEGER) AS fold FROM wide",
)
def stratified_folds(spark, sf):
    w = wide(spark, sf).select("row_key", "domain", "label")
    return splits.stratified_folds(w, ["domain", "label"], "row_key", 42).select("row_key", "fold")


@query(
    "grouped_folds", "P6",
    sql_with("wide", r="SELECT domain, run_id, count(*) AS n_windows FROM wide GROUP BY 1, 2")
    + f"""SELECT domain, run_id, n_windows, CAST((row_number() OVER (PARTITION BY domain ORDER BY n_windows DESC,
      {sql_order_key(0, 'run_id')}, run_id) - 1) % 3 AS INTEGER) AS fold FROM r""",
)
def grouped_folds(spark, sf):
    return splits.grouped_folds(wide(spark, sf), ["domain"], "run_id")


FEWSHOT_REPEATS = 5
FEWSHOT_POOL_SQL = dict(
    rk=run_rank_sql([42]),
    pool="SELECT domain, seed, run_id FROM rk WHERE rn > ceil(n*0.4::DOUBLE - 1e-9)",
    fr=f"""SELECT domain, seed, run_id, r, count(*) OVER (PARTITION BY domain, seed, r) AS m,
        row_number() OVER (PARTITION BY domain, seed, r ORDER BY {sql_order_key("@concat_ws('|', domain, seed, r)", 'run_id')}, run_id) AS k
        FROM pool, (SELECT CAST(range AS INTEGER) AS r FROM range({FEWSHOT_REPEATS}))""",
    fs="SELECT domain, seed, run_id, r, n_runs FROM fr, (VALUES (25),(50),(100),(250),(500)) v(n_runs) WHERE k <= n_runs AND n_runs <= m",
)


def fewshot(spark, sf):
    pool = splits.target_split(wide(spark, sf), ["domain"], "run_id", [42]).where("part = 'calib'").select("domain", "seed", "run_id")
    return splits.fewshot_runs(pool, ["domain", "seed"], "run_id", [25, 50, 100, 250, 500], FEWSHOT_REPEATS)


@query("fewshot_runs", "P11", sql_with("wide", **FEWSHOT_POOL_SQL) + "SELECT domain, seed, run_id, r, CAST(n_runs AS INTEGER) AS n_runs FROM fs")
def fewshot_runs(spark, sf):
    return fewshot(spark, sf)


_BRANDS = "SELECT DISTINCT p_brand AS feature FROM part WHERE p_brand NOT IN ('Brand#1','Brand#2','Brand#3','Brand#4')"


@query(
    "random_feature_controls", "P12 J6",
    f"WITH b AS ({_BRANDS}) " + " UNION ALL ".join(
        f"SELECT 'Random_minus6_seed{s}' AS config, feature FROM (SELECT feature, row_number() OVER (ORDER BY {sql_order_key(s, 'feature')}, feature) AS rn FROM b) WHERE rn <= 6"
        for s in (1001, 2002, 3003, 4004)),
)
def random_feature_controls(spark, sf):
    pool = table(spark, sf, "part").select(F.col("p_brand").alias("feature")).distinct()
    protected = pool.where(F.col("feature").isin("Brand#1", "Brand#2", "Brand#3", "Brand#4"))
    pool = pool.join(protected, "feature", "left_anti")
    out = None
    for s in (1001, 2002, 3003, 4004):
        one = reshape.pick_features(pool, s, 6).select(F.lit(f"Random_minus6_seed{s}").alias("config"), "feature")
        out = one if out is None else out.unionByName(one)
    return out


# ---- scaling ------------------------------------------------------------------

def _unpivot(cols, source="wide", ids="domain"):
    return " UNION ALL ".join(f"SELECT {ids}, '{c}' AS feature, {c} AS x FROM {source}" for c in cols)


TRAIN = dict(rk=run_rank_sql([42]), sp=SPLIT_SQL, tr="SELECT w.* FROM wide w JOIN sp USING (domain, run_id) WHERE part='train'",
             tu=_unpivot(WIDE_FEATURES, "tr"))


def train_part(spark, sf):
    return splits.split_windows(wide(spark, sf), ["domain"], "run_id", [42])


@query(
    "standard_scaler", "N1",
    sql_with("wide", **TRAIN) + """SELECT domain, feature, round(avg(x),5) AS centre,
      round(CASE WHEN stddev_pop(x)>0 THEN stddev_pop(x) ELSE 1 END,5) AS scale FROM tu GROUP BY 1, 2""",
)
def standard_scaler(spark, sf):
    p = scaling.fit_standard(train_part(spark, sf).where("part = 'train'"), ["domain"], WIDE_FEATURES)
    return p.select("domain", "feature", F.round("centre", 5).alias("centre"), F.round("scale", 5).alias("scale"))


@query(
    "standard_scaled_windows", "N1",
    sql_with("wide", rk=run_rank_sql([42]), sp=SPLIT_SQL, p="""SELECT domain, avg(qty) AS mq, stddev_pop(qty) AS sq, avg(price) AS mp, stddev_pop(price) AS s_p
      FROM wide JOIN sp USING (domain, run_id) WHERE part='train' GROUP BY domain""")
    + "SELECT row_key, round((qty-mq)/sq,5) AS qty, round((price-mp)/s_p,5) AS price FROM wide JOIN p USING (domain)",
)
def standard_scaled_windows(spark, sf):
    p = scaling.fit_standard(train_part(spark, sf).where("part = 'train'"), ["domain"], ["qty", "price"])
    out = scaling.apply_scaler(wide(spark, sf), p, ["domain"], ["qty", "price"])
    return out.select("row_key", F.round("qty", 5).alias("qty"), F.round("price", 5).alias("price"))


ROBUST_SQL = """SELECT domain, feature, quantile_cont(x, 0.5) AS centre, CASE WHEN quantile_cont(x, 0.75) > quantile_cont(x, 0.25)
    THEN quantile_cont(x, 0.75) - quantile_cont(x, 0.25) ELSE 1 END AS scale FROM tu GROUP BY 1, 2"""


@query("robust_scaler", "N2", sql_with("wide", **TRAIN, ro=ROBUST_SQL) + "SELECT domain, feature, round(centre,5) AS centre, round(scale,5) AS scale FROM ro")
def robust_scaler(spark, sf):
    p = scaling.fit_robust(train_part(spark, sf).where("part = 'train'"), ["domain"], WIDE_FEATURES)
    return p.select("domain", "feature", F.round("centre", 5).alias("centre"), F.round("scale", 5).alias("scale"))


@query(
    "scaled_family_maximum", "N4",
    sql_with("wide", tu=_unpivot(["qty", "tax", "price"], "(SELECT * FROM wide WHERE domain='static')"),
             p="SELECT feature, avg(x) AS m, stddev_pop(x) AS s FROM tu GROUP BY 1",
             mu=_unpivot(["qty", "tax", "price"], "(SELECT * FROM wide WHERE domain='mobile')"))
    + "SELECT domain, round(max(abs((x-m)/s)),5) AS max_abs FROM mu JOIN p USING (feature) GROUP BY domain",
)
def scaled_family_maximum(spark, sf):
    w, fam = wide(spark, sf), ["qty", "tax", "price"]
    p = scaling.fit_standard(w.where("domain = 'static'"), [], fam)
    z = scaling.apply_scaler(w.where("domain = 'mobile'"), p, [], fam)
    return scaling.max_abs(z, ["domain"], fam).withColumn("max_abs", F.round("max_abs", 5))


@query(
    "scaler_comparison", "N3",
    sql_with("wide", tu=_unpivot(["qty", "tax", "price"]), ro=ROBUST_SQL.replace("GROUP BY 1, 2", "WHERE domain='static' GROUP BY 1, 2"),
             st="SELECT domain, feature, avg(x) AS centre, stddev_pop(x) AS scale FROM tu WHERE domain='static' GROUP BY 1, 2",
             a="SELECT 'robust' AS scaler, feature, centre, scale FROM ro UNION ALL SELECT 'standard', feature, centre, scale FROM st",
             z="SELECT scaler, t.domain, t.feature, avg((x-centre)/scale) AS m FROM tu t JOIN a USING (feature) GROUP BY 1,2,3")
    + """SELECT scaler, feature, round(max(m) FILTER (domain='mobile') - max(m) FILTER (domain='static'),5) AS gap FROM z GROUP BY 1, 2""",
)
def scaler_comparison(spark, sf):
    """Mean scaled gap between the domains under both scalers fitted on the static domain."""
    w, cols = wide(spark, sf), ["qty", "tax", "price"]
    src = w.where("domain = 'static'")
    out = None
    for name, fit in (("standard", scaling.fit_standard), ("robust", scaling.fit_robust)):
        z = scaling.apply_scaler(w, fit(src, [], cols), [], cols)
        m = z.groupBy("domain").agg(*[F.avg(c).alias(c) for c in cols]).unpivot(["domain"], cols, "feature", "m")
        gap = m.groupBy("feature").agg(
            F.round(F.max(F.when(F.col("domain") == "mobile", F.col("m"))) - F.max(F.when(F.col("domain") == "static", F.col("m"))), 5).alias("gap")
        ).withColumn("scaler", F.lit(name))
        out = gap if out is None else out.unionByName(gap)
    return out.select("scaler", "feature", "gap")


# ---- filters and scores -------------------------------------------------------

@query(
    "variance_filter", "N5",
    sql_with("wide", u=_unpivot(WIDE_FEATURES)) + "SELECT domain, feature, round(var_pop(x),3) AS variance, var_pop(x) > 0.01 AS kept FROM u GROUP BY 1, 2",
)
def variance_filter(spark, sf):
    v = selection.variances(wide(spark, sf), ["domain"], WIDE_FEATURES)
    return v.select("domain", "feature", F.round("variance", 3).alias("variance"), "kept")


def _pairs_sql(cols=WIDE_FEATURES):
    return " UNION ALL ".join(
        f"SELECT domain, '{a}' AS feature_i, '{b}' AS feature_j, corr({a},{b}) AS r FROM wide GROUP BY domain"
        for i, a in enumerate(cols) for b in cols[i + 1:])


@query("correlation_pairs", "N6 M12", sql_with("wide", c=_pairs_sql()) + "SELECT domain, feature_i, feature_j, round(r,6) AS r FROM c")
def correlation_pairs(spark, sf):
    p = selection.correlation_pairs(wide(spark, sf), ["domain"], WIDE_FEATURES)
    return p.select("domain", "feature_i", "feature_j", F.round("r", 6).alias("r"))


@query("correlation_pruning", "N6", sql_with("wide", c=_pairs_sql()) + "SELECT DISTINCT domain, feature_j AS feature FROM c WHERE abs(r) > 0.95")
def correlation_pruning(spark, sf):
    return selection.correlated_to_drop(selection.correlation_pairs(wide(spark, sf), ["domain"], WIDE_FEATURES), ["domain"])


@query(
    "correlation_report", "N7",
    sql_with("wide", c=_pairs_sql()) + """SELECT domain, count(*) AS n_pairs, sum(CASE WHEN abs(r)>0.95 THEN 1 ELSE 0 END)::BIGINT AS n_above,
      round((100.0::DOUBLE*sum(CASE WHEN abs(r)>0.95 THEN 1 ELSE 0 END)/count(*))::DOUBLE,5) AS pct_above,
      count(DISTINCT CASE WHEN abs(r)>0.95 THEN feature_j END) AS n_dropped FROM c GROUP BY domain""",
)
def correlation_report(spark, sf):
    p = selection.correlation_pairs(wide(spark, sf), ["domain"], WIDE_FEATURES)
    return selection.correlation_report(p, ["domain"]).withColumn("pct_above", F.round("pct_above", 5))


@query(
    "removed_feature_sides", "N8 U4",
    sql_with("wide", u=_unpivot(WIDE_FEATURES), v="SELECT domain, feature FROM u GROUP BY 1, 2 HAVING var_pop(x) < CASE WHEN domain='static' THEN 208 ELSE 1 END")
    + """SELECT feature, CASE WHEN count(*)=2 THEN 'both' WHEN min(domain)='static' THEN 'only_static' ELSE 'only_mobile' END AS side,
      'other' AS category FROM v GROUP BY feature""",
)
def removed_feature_sides(spark, sf):
    v = selection.variances(wide(spark, sf), ["domain"], WIDE_FEATURES)
    removed = v.where(F.col("variance") < F.when(F.col("domain") == "static", 208).otherwise(1))
    m = reshape.membership(removed.where("domain='static'").select("feature"), removed.where("domain='mobile'").select("feature"),
                           "feature", "only_static", "only_mobile")
    return selection.categorise(m)


CATEGORY_CASE = """CASE WHEN regexp_matches(lower(f), 'delay|jitter') THEN 'delay/jitter related' WHEN regexp_matches(lower(f), 'loss') THEN 'loss-rate related'
  WHEN regexp_matches(lower(f), 'flowcount|duration|flowdur') THEN 'flow-count/duration related'
  WHEN regexp_matches(lower(f), 'energy|mac|drop') THEN 'energy/MAC related' WHEN regexp_matches(lower(f), '^row_') THEN 'row_*/aggregate stats' ELSE 'other' END"""


@query(
    "feature_categories", "N8",
    f"""WITH w AS (SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS f FROM documents)
    SELECT {CATEGORY_CASE} AS category, count(*) AS n FROM w GROUP BY 1""",
)
def feature_categories(spark, sf):
    words = table(spark, sf, "documents").select(F.explode(F.split(F.lower("text"), " ")).alias("feature")).distinct()
    return selection.categorise(words).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


F_SQL = """SELECT domain, feature, (sum(n*(m-mu)*(m-mu)))/(sum(n*v)/(sum(n)-2)) AS f_score FROM
    (SELECT *, sum(n*m) OVER (PARTITION BY domain, feature)/sum(n) OVER (PARTITION BY domain, feature) AS mu FROM
      (SELECT domain, feature, label, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM ul GROUP BY 1,2,3)) GROUP BY 1, 2"""


@query("anova_f_scores", "N9", sql_with("wide", ul=_unpivot(WIDE_FEATURES, ids="domain, label"), f=F_SQL) + "SELECT domain, feature, round(f_score,3) AS f_score FROM f")
def anova_f_scores(spark, sf):
    f = selection.anova_f(wide(spark, sf), ["domain"], WIDE_FEATURES, "label")
    return f.withColumn("f_score", F.round("f_score", 3))


MI_SQL = dict(
    ul=_unpivot(WIDE_FEATURES, ids="domain, label"),
    bn="SELECT domain, feature, label, CAST(floor(32*(rank() OVER (PARTITION BY domain, feature ORDER BY x)-1)/count(*) OVER (PARTITION BY domain, feature)) AS INTEGER) AS b FROM ul",
    ct="SELECT domain, feature, b, label, count(*)::DOUBLE AS c FROM bn GROUP BY 1,2,3,4",
    mi="""SELECT domain, feature, sum(c/n*ln(c*n/(nb*ny))) AS mi FROM (SELECT *, sum(c) OVER (PARTITION BY domain, feature) AS n,
      sum(c) OVER (PARTITION BY domain, feature, b) AS nb, sum(c) OVER (PARTITION BY domain, feature, label) AS ny FROM ct) GROUP BY 1, 2""",
)


@query("mutual_information", "N10", sql_with("wide", **MI_SQL) + "SELECT domain, feature, round(mi,6) AS mi FROM mi")
def mutual_information(spark, sf):
    return selection.mutual_information(wide(spark, sf), ["domain"], WIDE_FEATURES, "label").withColumn("mi", F.round("mi", 6))


@query(
    "rank_aggregation", "N12",
    sql_with("wide", **MI_SQL, f=F_SQL, c=" UNION ALL ".join(f"SELECT domain, '{c}' AS feature, abs(corr({c},label)) AS r FROM wide GROUP BY domain" for c in WIDE_FEATURES),
             s="""SELECT domain, 'mi' AS method, feature, round(mi,6) AS score FROM mi UNION ALL SELECT domain, 'f', feature, round(f_score,3) FROM f
               UNION ALL SELECT domain, 'corr', feature, round(r,6) FROM c""",
             rk2="SELECT *, rank() OVER (PARTITION BY domain, method ORDER BY score DESC) + (count(*) OVER (PARTITION BY domain, method, score)-1)/2.0 AS rr FROM s",
             ag="SELECT domain, feature, avg(rr)::DOUBLE AS mean_rank FROM rk2 GROUP BY 1, 2",
             ps="SELECT *, row_number() OVER (PARTITION BY domain ORDER BY mean_rank, feature) AS position FROM ag")
    + "SELECT domain, feature, round(mean_rank,6) AS mean_rank, position FROM ps WHERE position <= 150",
)
def rank_aggregation(spark, sf):
    w = wide(spark, sf)
    mi = selection.mutual_information(w, ["domain"], WIDE_FEATURES, "label").select("domain", F.lit("mi").alias("method"), "feature", F.round("mi", 6).alias("score"))
    f = selection.anova_f(w, ["domain"], WIDE_FEATURES, "label").select("domain", F.lit("f").alias("method"), "feature", F.round("f_score", 3).alias("score"))
    r = w.groupBy("domain").agg(*[F.abs(F.corr(c, "label")).alias(c) for c in WIDE_FEATURES]).unpivot(["domain"], WIDE_FEATURES, "feature", "s")
    r = r.select("domain", F.lit("corr").alias("method"), "feature", F.round("s", 6).alias("score"))
    out = selection.aggregate_ranks(mi.unionByName(f).unionByName(r), ["domain"], 150)
    return out.withColumn("mean_rank", F.round("mean_rank", 6))


@query(
    "correlation_pairs_wide", "N6 M12",
    sql_with("many", l="SELECT domain, unnest([" + ", ".join(f"{{'a': '{a}', 'b': '{b}', 'r': corr({a},{b})}}" for i, a in enumerate(MANY) for b in MANY[i + 1:]) + "]) AS s FROM many GROUP BY domain")
    + "SELECT domain, s.a AS feature_i, s.b AS feature_j, round(s.r,6) AS r FROM l",
)
def correlation_pairs_wide(spark, sf):
    """All pairs of 32 features with nulls: each pair over the rows where both have a value."""
    p = selection.correlation_pairs(many(spark, sf), ["domain"], MANY)
    return p.select("domain", "feature_i", "feature_j", F.round("r", 6).alias("r"))


@query(
    "feature_target_correlation", "M12",
    sql_with("wide", c=" UNION ALL ".join(f"SELECT '{c}' AS feature, corr({c},label) AS r FROM wide" for c in WIDE_FEATURES))
    + "SELECT feature, round(r,6) AS r FROM c ORDER BY abs(r) DESC, feature LIMIT 20",
)
def feature_target_correlation(spark, sf):
    w = wide(spark, sf).agg(*[F.corr(c, "label").alias(c) for c in WIDE_FEATURES]).unpivot([], WIDE_FEATURES, "feature", "r")
    return w.orderBy(F.desc(F.abs("r")), "feature").limit(20).withColumn("r", F.round("r", 6))


# ---- stability selection --------------------------------------------------------

STAB_SQL = dict(
    rk="SELECT *, row_number() OVER (PARTITION BY method, domain, seed ORDER BY importance DESC, feature) AS rk FROM importances",
    bo="SELECT method, seed, feature, count(*) AS c, max(rk) AS worst, avg(importance) AS a FROM rk GROUP BY 1,2,3",
    ns="SELECT method, count(DISTINCT seed) AS n_seeds FROM importances GROUP BY 1",
    ct="""SELECT b.method, CAST(k AS INTEGER) AS K, feature, n_seeds, sum(a)/n_seeds AS avg_importance, count(*) FILTER (c=2 AND worst<=k) AS n_hits
        FROM bo b JOIN ns USING (method), (VALUES (3),(5),(10),(15)) v(k) GROUP BY b.method, k, feature, n_seeds""",
)
KS = [3, 5, 10, 15]


@query("stability_counts", "N16 U3 D10", sql_with("importances", **STAB_SQL) + 'SELECT method, K AS "K", feature, n_hits, round(avg_importance,4) AS avg_importance FROM ct')
def stability_counts(spark, sf):
    return selection.stable_counts(importances(spark, sf), KS).select("method", "K", "feature", "n_hits", F.round("avg_importance", 4).alias("avg_importance"))


@query("universal_set_strict", "N16 U3", sql_with("importances", **STAB_SQL) + 'SELECT method, K AS "K", feature FROM ct WHERE n_hits/n_seeds::DOUBLE >= 0.4')
def universal_set_strict(spark, sf):
    return selection.universal_set(selection.stable_counts(importances(spark, sf), KS), 0.4, "strict").select("method", "K", "feature")


@query(
    "universal_set_soft", "N16",
    sql_with("importances", **STAB_SQL, p="SELECT *, row_number() OVER (PARTITION BY method, K ORDER BY (n_hits/n_seeds::DOUBLE >= 0.4) DESC, avg_importance DESC, feature) AS p FROM ct")
    + 'SELECT method, K AS "K", feature, n_hits/n_seeds::DOUBLE >= 0.4 AS is_stable FROM p WHERE p <= K',
)
def universal_set_soft(spark, sf):
    return selection.universal_set(selection.stable_counts(importances(spark, sf), KS), 0.4, "soft")


@query(
    "stability_sensitivity", "N17",
    sql_with("importances", **STAB_SQL) + """SELECT method, K AS "K", t::DOUBLE AS threshold, count(*) FILTER (n_hits/n_seeds::DOUBLE >= t::DOUBLE) AS n_passing
    FROM ct, (VALUES (0.6),(0.7),(0.8),(0.9)) v(t) GROUP BY method, K, t""",
)
def stability_sensitivity(spark, sf):
    return selection.stability_sensitivity(selection.stable_counts(importances(spark, sf), KS), [0.6, 0.7, 0.8, 0.9])


RANKING_SQL = dict(
    im="SELECT domain, feature, avg(importance) AS m FROM importances GROUP BY 1, 2",
    ir="SELECT domain, feature, m, row_number() OVER (PARTITION BY domain ORDER BY m DESC, feature) - 1 AS rk FROM im",
)


@query("importance_ranking", "N15", sql_with("importances", **RANKING_SQL) + "SELECT domain, feature, round(m,4) AS mean_importance, rk AS rank FROM ir")
def importance_ranking(spark, sf):
    return selection.importance_ranking(importances(spark, sf), ["domain"]).withColumn("mean_importance", F.round("mean_importance", 4))


ANCHOR = ["Brand#1", "Brand#2", "Brand#3", "Brand#4"]


@query(
    "anchored_top_k", "N18",
    sql_with("importances", **RANKING_SQL, n="SELECT max(c) AS n FROM (SELECT count(*) AS c FROM ir GROUP BY domain)",
             b="""SELECT feature, feature IN ('Brand#1','Brand#2','Brand#3','Brand#4') AS is_anchor,
               (coalesce(max(rk) FILTER (domain='static'), max(n)) + coalesce(max(rk) FILTER (domain='mobile'), max(n)))/2.0::DOUBLE AS mean_rank FROM ir, n GROUP BY feature""",
             p="SELECT *, row_number() OVER (ORDER BY is_anchor DESC, mean_rank, feature) AS p FROM b")
    + 'SELECT CAST(k AS INTEGER) AS "K", feature, is_anchor, mean_rank FROM p, (VALUES (2),(4),(8),(20)) v(k) WHERE p <= k',
)
def anchored_top_k(spark, sf):
    return selection.anchored_top_k(selection.importance_ranking(importances(spark, sf), ["domain"]).select("domain", "feature", "rank"), ANCHOR, [2, 4, 8, 20])


@query(
    "importance_shares", "N13",
    sql_with("importances") + """SELECT method, domain, seed, feature, round(importance/sum(importance) OVER (PARTITION BY method, domain, seed),6) AS importance FROM importances""",
)
def importance_shares(spark, sf):
    return selection.normalise_importance(importances(spark, sf), ["method", "domain", "seed"]).withColumn("importance", F.round("importance", 6))


@query(
    "split_artifacts", "K5",
    sql_with("wide", **TRAIN) + """SELECT 'splits' AS artifact, part AS item, count(*)::DOUBLE AS value FROM sp GROUP BY part
    UNION ALL SELECT 'scaler', domain || '/' || feature, round(avg(x),5) FROM tu GROUP BY domain, feature
    UNION ALL SELECT 'selected', feature, 1.0 FROM (VALUES ('qty'),('size'),('price')) v(feature)""",
)
def split_artifacts(spark, sf):
    """Splits, scaler parameters and selected features written and read back.

    Windows and training rows are written once; else each of the passes over them would join ``part`` again, by way of the driver.
    """
    root = fresh_path(spark, "artifacts")
    w = stored(wide(spark, sf, shuffled=True).select("domain", "run_id", *WIDE_FEATURES), "windows")
    sp = splits.grouped_split(w, ["domain"], "run_id", [42])
    tr = stored(splits.split_windows(w, ["domain"], "run_id", [42]).where("part = 'train'").select("domain", *WIDE_FEATURES), "train")
    scaler = stored(scaling.fit_standard(tr, ["domain"], WIDE_FEATURES), "scaler")
    chosen = selection.filter_features(tr, WIDE_FEATURES)
    names = scaler.select("feature").distinct().where(F.col("feature").isin(*chosen))
    sinks.write_split_artifacts(sp, scaler, names, root)
    read = lambda x: spark.read.parquet(f"{root}/{x}")
    a = read("splits").groupBy("part").agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("splits").alias("artifact"), F.col("part").alias("item"), "value")
    b = read("scaler_params").select(F.lit("scaler").alias("artifact"), F.concat_ws("/", "domain", "feature").alias("item"), F.round("centre", 5).alias("value"))
    c = read("selected_features").select(F.lit("selected").alias("artifact"), F.col("feature").alias("item"), F.lit(1.0).alias("value"))
    return a.unionByName(b).unionByName(c)
