"""Queries: engineered features."""

from __future__ import annotations

from pyspark.sql import functions as F

from windowlab.fixtures import NETWORK_METRICS, network, scores, sql_with, tall
from windowlab.functions.expressions import logit
from windowlab.operators import features, reshape
from windowlab.plans.registry import query

EPS = "1e-10::DOUBLE"


def pick(spark, sf, named, digits=6):
    n = network(spark, sf)
    return n.select("row_key", *[F.round(c, digits).alias(k) for k, c in named.items()])


def subset(names):
    d = features.domain_features([*NETWORK_METRICS, "_measurement_duration"])
    return {n: F.coalesce(d[n], F.lit(0.0)) for n in names}


@query(
    "quality_features", "F1 F2",
    sql_with("network") + f"""SELECT row_key,
      round("PacketDeliveryRatio"*0.4::DOUBLE + (1-"PacketLossRatio")*0.3::DOUBLE + 1/("AverageEndToEndDelay"+{EPS})*0.15::DOUBLE
        + 1/("AverageJitter"+{EPS})*0.15::DOUBLE, 6) AS "QoS_Score",
      round("Throughput"/("RoutingOverheadRatio"+{EPS}), 6) AS "Network_Efficiency",
      round("PacketDeliveryRatio"/("NormalizedRoutingLoad"+{EPS}), 6) AS "Delivery_Efficiency" FROM network""",
)
def quality_features(spark, sf):
    return pick(spark, sf, subset(["QoS_Score", "Network_Efficiency", "Delivery_Efficiency"]))


@query(
    "control_rate_features", "F3 F4",
    sql_with("network") + f"""SELECT row_key,
      CASE WHEN "_measurement_duration"=0 THEN 0.0::DOUBLE ELSE
        CASE WHEN "FlowCount"=0 THEN "TcMessageRate"/{EPS} ELSE
          round("TcMessageRate"/("AvgTxPacketsPerFlow"*"FlowCount"/"_measurement_duration"+{EPS}), 6) END END AS "CDR",
      round("TcMessageRate"*"AverageAdvertisedLinksPerTCMessage", 6) AS "TDR" FROM network""",
)
def control_rate_features(spark, sf):
    n = subset(["CDR", "TDR"])
    df = network(spark, sf)
    return df.select("row_key", F.when(n["CDR"] > 1e6, n["CDR"]).otherwise(F.round(n["CDR"], 6)).alias("CDR"), F.round(n["TDR"], 6).alias("TDR"))


@query(
    "ratio_features", "F5 F6 F7",
    sql_with("network", t='SELECT *, "TcMessageRate"+"MidMessageRate"+"HnaMessageRate"+"DataPacketRate" AS tt FROM network')
    + f"""SELECT row_key, round("RoutingOverheadRatio"/("AverageHopCount"+{EPS}), 6) AS "Overhead_Per_Hop",
      round("AverageEndToEndDelay"/("AverageHopCount"+{EPS}), 6) AS "Delay_Per_Hop",
      round("AverageJitter"/("AverageEndToEndDelay"+{EPS}), 6) AS "Jitter_Delay_Ratio",
      round(tt, 6) AS "Total_Traffic", round("NormalizedRoutingLoad"*"RoutingOverheadRatio", 5) AS "Routing_Anomaly",
      round(tt*(1-"PacketDeliveryRatio"), 5) AS "Traffic_Anomaly",
      round("AverageEndToEndDelay"*"PacketLossRatio", 8) AS "Performance_Degradation" FROM t""",
)
def ratio_features(spark, sf):
    d = subset(["Overhead_Per_Hop", "Delay_Per_Hop", "Jitter_Delay_Ratio", "Total_Traffic", "Routing_Anomaly", "Traffic_Anomaly", "Performance_Degradation"])
    digits = {"Routing_Anomaly": 5, "Traffic_Anomaly": 5, "Performance_Degradation": 8}
    return network(spark, sf).select("row_key", *[F.round(c, digits.get(k, 6)).alias(k) for k, c in d.items()])


@query(
    "log_root_features", "F8",
    sql_with("network") + f"""SELECT row_key, round(ln(1+"Throughput"), 6) AS "log1p_Throughput", round(sqrt("Throughput"+{EPS}), 6) AS "sqrt_Throughput",
      round(ln(1+"FlowCount"), 6) AS "log1p_FlowCount", round(sqrt("FlowCount"+{EPS}), 6) AS "sqrt_FlowCount" FROM network""",
)
def log_root_features(spark, sf):
    n = network(spark, sf)
    cols = features.non_negative(n, ["Throughput", "AverageMprCount", "FlowCount"])  # the mpr count goes below 0 and drops out
    return pick(spark, sf, features.root_features(cols))


@query(
    "power_features", "F9",
    sql_with("network") + """SELECT row_key, round("Throughput"*"Throughput", 4) AS "Throughput_squared",
      round("Throughput"*"Throughput"*"Throughput", 3) AS "Throughput_cubed", round("AverageJitter"*"AverageJitter", 8) AS "AverageJitter_squared",
      round("AverageJitter"*"AverageJitter"*"AverageJitter", 8) AS "AverageJitter_cubed" FROM network""",
)
def power_features(spark, sf):
    d = features.power_features(NETWORK_METRICS, ["Throughput", "AverageJitter"])
    digits = {"Throughput_squared": 4, "Throughput_cubed": 3}
    return network(spark, sf).select("row_key", *[F.round(c, digits.get(k, 8)).alias(k) for k, c in d.items()])


ROW_COLS = ["TcMessageRate", "DataPacketRate", "AverageHopCount", "AverageMprCount", "NormalizedRoutingLoad", "FlowCount"]
_LIST = ", ".join(f'"{c}"' for c in ROW_COLS)


@query(
    "row_statistics", "F10 F11 F12",
    sql_with(
        "network",
        a=f"SELECT row_key, list_sort([{_LIST}]) AS s FROM network",
        m="SELECT row_key, s, list_sum(s)/6 AS mu FROM a",
        p="""SELECT row_key, s, mu, list_sum(list_transform(s, lambda x: (x-mu)*(x-mu)))/6 AS m2,
             list_sum(list_transform(s, lambda x: (x-mu)*(x-mu)*(x-mu)))/6 AS m3,
             list_sum(list_transform(s, lambda x: (x-mu)*(x-mu)*(x-mu)*(x-mu)))/6 AS m4 FROM m""",
    ) + f"""SELECT row_key, round(mu,5) AS row_mean, round(sqrt(m2*6/5),5) AS row_std, round((s[3]+s[4])/2,5) AS row_median,
      round(s[6],5) AS row_max, round(s[1],5) AS row_min, round(s[6]-s[1],5) AS row_range, round(sqrt(m2*6/5)/(mu+{EPS}),5) AS row_cv,
      round(m3/(m2*sqrt(m2)),5) AS row_skew, round(m4/(m2*m2)-3,5) AS row_kurtosis,
      round(s[2]+(s[3]-s[2])*0.25::DOUBLE,5) AS row_q25, round(s[4]+(s[5]-s[4])*0.75::DOUBLE,5) AS row_q75,
      round(s[4]+(s[5]-s[4])*0.75::DOUBLE-(s[2]+(s[3]-s[2])*0.25::DOUBLE),5) AS row_iqr FROM p""",
)
def row_statistics(spark, sf):
    out = features.row_statistics(network(spark, sf).select("row_key", *ROW_COLS), ROW_COLS)
    return out.select("row_key", *[F.round(c, 5).alias(c) for c in features.ROW_STATISTICS])


@query(
    "pair_features", "F13",
    sql_with("network") + f"""SELECT row_key, round("Throughput"*"AverageEndToEndDelay",8) AS "interact_Throughput_AverageEndToEndDelay",
      round("Throughput"/("AverageEndToEndDelay"+{EPS}),5) AS "ratio_Throughput_AverageEndToEndDelay",
      round("PacketDeliveryRatio"*"PacketLossRatio",7) AS "interact_PacketDeliveryRatio_PacketLossRatio",
      round("PacketDeliveryRatio"/("PacketLossRatio"+{EPS}),5) AS "ratio_PacketDeliveryRatio_PacketLossRatio" FROM network""",
)
def pair_features(spark, sf):
    d = features.pair_features(NETWORK_METRICS, [("Throughput", "AverageEndToEndDelay"), ("PacketDeliveryRatio", "PacketLossRatio")])
    return network(spark, sf).select("row_key", *[F.round(c, 7 if k.startswith("interact_P") else 8 if k.startswith("interact_T") else 5).alias(k) for k, c in d.items()])


@query(
    "temporal_features", "F14",
    sql_with("tall", w="""SELECT domain, scenario, file_source, coalesce(avg("Duration"),0) AS dm, coalesce(stddev_samp("Duration"),0) AS ds,
        coalesce(max("Duration"),0) AS dx, coalesce(min("Duration"),0) AS dn,
        coalesce(avg("Value") FILTER ("Metric"='view'),0.0::DOUBLE) AS v FROM tall GROUP BY 1,2,3""")
    + f"""SELECT domain, scenario, file_source, round(ds/(dm+{EPS}),6) AS "Duration_CV", round(dx-dn,6) AS "Duration_Range",
      CASE WHEN dm=0 THEN v/{EPS} ELSE round(v/(dm+{EPS}),6) END AS "Time_Efficiency" FROM w""",
)
def temporal_features(spark, sf):
    t = tall(spark, sf).withColumn("Metric", F.when(F.col("Metric") == "view", "Throughput").otherwise(F.col("Metric")))
    w = reshape.widen(t, ["domain", "scenario", "file_source"], ["Throughput"], temporal=True)
    d = features.temporal_features(w.columns)
    te = d["Time_Efficiency"]
    return w.select("domain", "scenario", "file_source", F.round(d["Duration_CV"], 6).alias("Duration_CV"),
                    F.round(d["Duration_Range"], 6).alias("Duration_Range"),
                    F.when(F.col("Duration_mean") == 0, te).otherwise(F.round(te, 6)).alias("Time_Efficiency"))


@query(
    "single_precision_rates", "F15 D6",
    sql_with("network") + """SELECT row_key,
      round(CASE WHEN "_measurement_duration"=0 THEN 0.0::DOUBLE ELSE
        ("TcMessageRate"::FLOAT/(("AvgTxPacketsPerFlow"::FLOAT*"FlowCount"::FLOAT)/"_measurement_duration"::FLOAT+1e-10::FLOAT))::DOUBLE END, 4) AS "CDR",
      round(("TcMessageRate"::FLOAT*"AverageAdvertisedLinksPerTCMessage"::FLOAT)::DOUBLE, 4) AS "TDR" FROM network""",
)
def single_precision_rates(spark, sf):
    d = features.cdr_tdr_float()
    return network(spark, sf).select(
        "row_key", F.round(d["CDR"], 4).alias("CDR"), F.round(d["TDR"], 4).alias("TDR"))


@query(
    "polynomial_features", "F16",
    sql_with("network") + """SELECT row_key, round("TcMessageRate",6) AS a, round("FlowCount",6) AS b, round("Throughput",6) AS c,
      round("TcMessageRate"*"TcMessageRate",6) AS aa, round("TcMessageRate"*"FlowCount",6) AS ab, round("TcMessageRate"*"Throughput",7) AS ac,
      round("FlowCount"*"FlowCount",6) AS bb, round("FlowCount"*"Throughput",7) AS bc, round("Throughput"*"Throughput",8) AS cc FROM network""",
)
def polynomial_features(spark, sf):
    terms = features.poly2_terms(["TcMessageRate", "FlowCount", "Throughput"])
    short = dict(zip(terms, ["a", "b", "c", "aa", "ab", "ac", "bb", "bc", "cc"]))
    digits = {"ac": 7, "bc": 7, "cc": 8}
    return network(spark, sf).select("row_key", *[F.round(c, digits.get(short[k], 6)).alias(short[k]) for k, c in terms.items()])


def _skew_sql(c):
    return (f'(avg("{c}"*"{c}"*"{c}")-3*avg("{c}")*avg("{c}"*"{c}")+2*avg("{c}")*avg("{c}")*avg("{c}"))'
            f'/power(avg("{c}"*"{c}")-avg("{c}")*avg("{c}"),1.5)')


SKEW_COLS = ["Throughput", "NormalizedRoutingLoad", "AverageJitter", "AverageMprCount", "TcMessageRate"]


@query(
    "skewed_log_columns", "F17",
    sql_with("network", s=" UNION ALL ".join(
        f"SELECT '{c}' AS feature, domain, {_skew_sql(c)} AS sk, min(\"{c}\") AS lo FROM network GROUP BY domain" for c in SKEW_COLS))
    + "SELECT feature FROM s GROUP BY feature HAVING max(sk) > 0.4 AND min(lo) >= 0",
)
def skewed_log_columns(spark, sf):
    # The stand-in is less skewed than network data, so the cut is .4 here; the default of the operator is 1.
    keep = features.skewed_columns(network(spark, sf), SKEW_COLS, cut=0.4)
    cells = F.array(*[F.lit(c) for c in keep]) if keep else F.array().cast("array<string>")
    return network(spark, sf).agg(F.count(F.lit(1)).alias("n")).select(F.explode(cells).alias("feature"))


@query(
    "feature_config_widths", "F18 F19",
    sql_with("network", n="SELECT count(*) AS n FROM network", p="SELECT 6 AS p")
    + """SELECT config, k AS n_features, n AS n_rows FROM n, (VALUES ('Standard_33', 6), ('Plus_Engineered', 8), ('Plus_Log', 8),
      ('Plus_Poly2', 27), ('Plus_All', 31), ('Ablation_DJ_27', 4)) v(config, k)""",
)
def feature_config_widths(spark, sf):
    """Every feature configuration built over six base columns and read completely."""
    base = ["TcMessageRate", "FlowCount", "Throughput", "AverageEndToEndDelay", "AverageJitter", "NormalizedRoutingLoad"]
    n, parts = network(spark, sf), []
    for config in features.FEATURE_CONFIGS:
        built = features.build_features(config, base, ["Throughput", "NormalizedRoutingLoad"])
        wide = features.select_features(n, ["row_key"], built)
        cells = F.array(*[F.col(f"`{c}`") for c in wide.columns if c != "row_key"])
        parts.append(wide.select(F.size(cells).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n_rows"))
                     .select(F.lit(config).alias("config"), F.col("k").alias("n_features"), "n_rows"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(
    "engineered_table", "F1 F8 F10 F13 R11 C18",
    sql_with("network", r="""SELECT domain, count(*) AS n, avg("TcMessageRate"*"AverageAdvertisedLinksPerTCMessage") AS tdr,
        avg(ln(1+"Throughput")) AS lt, avg("AverageEndToEndDelay"*"PacketLossRatio") AS pd FROM network GROUP BY domain""")
    + "SELECT domain, n, 16+12+2*15+8+12+10 AS n_columns, round(tdr,5) AS tdr, round(lt,5) AS log_throughput, round(pd,6) AS degradation FROM r",
)
def engineered_table(spark, sf):
    e = features.engineer(network(spark, sf), NETWORK_METRICS)
    width = len(e.columns) - 2  # without row_key and domain
    return e.groupBy("domain").agg(
        F.count(F.lit(1)).alias("n"), F.lit(width).alias("n_columns"), F.round(F.avg("TDR"), 5).alias("tdr"),
        F.round(F.avg("log1p_Throughput"), 5).alias("log_throughput"), F.round(F.avg("Performance_Degradation"), 6).alias("degradation"))


@query(
    "logit_scores", "F20",
    sql_with("scores") + """SELECT model, domain, row_key, round(ln(q/(1-q)), 6) AS z FROM
      (SELECT model, domain, row_key, greatest(1e-6::DOUBLE, least(1-1e-6::DOUBLE, score)) AS q FROM scores)""",
)
def logit_scores(spark, sf):
    return scores(spark, sf).select("model", "domain", "row_key", F.round(logit(F.col("score")), 6).alias("z"))
