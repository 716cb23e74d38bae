"""Adapters: the given tables seen as windows, scores, results and logs.

Each adapter is a lazy projection of whole tables.  ``SQL`` holds the same
adapters as DuckDB text for the oracle queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from windowlab.constants import METRICS
from windowlab.session import compiled_code

EVENT_METRICS = ["click", "error", "purchase", "signup", "view"]
WIDE_FEATURES = ["qty", "disc", "tax", "size", "price", "qty_dup"]
SEED_COUNT = 20


FACTS = {"lineitem", "events", "documents"}
#: Set by bench and tests: the given fact tables are files of one row group, which one task would read.
SPREAD = "spark.windowlab.fixtures.spread"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    compiled_code(spark)
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    parts = spark.conf.get(SPREAD, None)
    return df.repartition(int(parts)) if parts and name in FACTS else df


def tall(spark, sf) -> DataFrame:
    """Events as tall window rows (one metric value per row)."""
    e = table(spark, sf, "events")
    code = F.pmod(F.col("event_id"), F.lit(4))
    domain = F.when(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"), "static").otherwise("mobile")
    label = F.when(code >= 2, 1).otherwise(0)
    planted = (label == 1) & F.col("event_type").isin("purchase", "view")
    start = (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts").cast("int")).cast("double")
    return e.select(
        "event_id",
        domain.alias("domain"),
        F.when(code == 0, "baseline").when(code == 1, "attack_only").when(code == 2, "defense_only")
        .otherwise("defense_vs_attack").alias("scenario"),
        F.col("user_id").alias("file_source"),
        label.alias("defense_active"),
        F.col("event_type").alias("Metric"),
        (F.col("value") + F.when(planted, F.when(domain == "static", 60.0).otherwise(20.0)).otherwise(0.0)).alias("Value"),
        start.alias("StartTime"),
        (start + 40.0).alias("EndTime"),
        F.when(F.pmod(F.col("event_id"), F.lit(3)) != 0, 40.0).alias("Duration"),
    )


def wide(spark, sf, shuffled: bool = False) -> DataFrame:
    """Line items as windows with a learnable label and a domain shift.

    ``shuffled`` keeps ``part`` off the driver: Spark judges by the bytes of the file's columns whether to gather and broadcast it, and
    few compressed bytes may be millions of rows.
    """
    l, p = table(spark, sf, "lineitem"), table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    j = l.join(p.hint("shuffle_hash") if shuffled else p, l.l_partkey == p.p_partkey)
    domain = F.when(F.col("l_linestatus") == "F", "static").otherwise("mobile")
    s = F.when(domain == "static", F.col("l_quantity") / 50).otherwise(F.col("l_quantity") / 100 + F.lit(5) * F.col("l_tax"))
    score = s + F.lit(2) * F.col("l_discount") + F.col("l_extendedprice") / 200000
    return j.select(
        F.col("l_orderkey").alias("run_id"),
        F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row_key"),
        domain.alias("domain"),
        F.when(score > F.lit(0.85).cast("double"), 1).otherwise(0).alias("label"),
        F.col("l_quantity").alias("qty"),
        F.col("l_discount").alias("disc"),
        F.col("l_tax").alias("tax"),
        F.col("p_size").cast("double").alias("size"),
        F.col("p_retailprice").alias("price"),
        (F.lit(2) * F.col("l_quantity") + F.col("l_tax")).alias("qty_dup"),
    )


def network(spark, sf) -> DataFrame:
    """Line items as rows of named network metrics, for the engineered features."""
    l, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    j = l.join(p.select("p_partkey", "p_size"), l.l_partkey == p.p_partkey)
    q, d, t = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    ln = F.col("l_linenumber")
    c = lambda x: F.lit(float(x))
    return j.select(
        F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row_key"),
        F.when(F.col("l_linestatus") == "F", "static").otherwise("mobile").alias("domain"),
        (q / c(10)).alias("TcMessageRate"),
        t.alias("MidMessageRate"),
        d.alias("HnaMessageRate"),
        (F.col("p_size") / c(10)).alias("AverageAdvertisedLinksPerTCMessage"),
        (t * q + c(0.5)).alias("NormalizedRoutingLoad"),
        (d + c(0.01)).alias("RoutingOverheadRatio"),
        (c(1) - d).alias("PacketDeliveryRatio"),
        (d + c(0.001)).alias("PacketLossRatio"),
        (t + c(0.05)).alias("AverageEndToEndDelay"),
        (d / c(2) + c(0.01)).alias("AverageJitter"),
        (F.col("l_extendedprice") / c(1000)).alias("Throughput"),
        ln.cast("double").alias("AverageHopCount"),
        q.alias("DataPacketRate"),
        (ln - 1).cast("double").alias("FlowCount"),
        F.col("p_size").cast("double").alias("AvgTxPacketsPerFlow"),
        (F.pmod(F.col("l_suppkey"), F.lit(7)) - 3).cast("double").alias("AverageMprCount"),
        F.when(ln == 7, c(0)).otherwise(c(40)).alias("_measurement_duration"),
    )


NETWORK_METRICS = [
    "TcMessageRate", "MidMessageRate", "HnaMessageRate", "AverageAdvertisedLinksPerTCMessage",
    "NormalizedRoutingLoad", "RoutingOverheadRatio", "PacketDeliveryRatio", "PacketLossRatio",
    "AverageEndToEndDelay", "AverageJitter", "Throughput", "AverageHopCount", "DataPacketRate",
    "FlowCount", "AvgTxPacketsPerFlow", "AverageMprCount",
]


def scores(spark, sf) -> DataFrame:
    """Two deterministic score columns as a long score table."""
    w = wide(spark, sf)
    return w.select(
        "domain", "run_id", "row_key", F.col("label").alias("y"),
        F.inline(F.array(
            F.struct(F.lit("by_qty").alias("model"), F.round(F.col("qty") / 50, 4).alias("score")),
            F.struct(F.lit("by_disc").alias("model"), F.round(F.lit(10) * F.col("disc"), 4).alias("score")),
        )),
    )


def seed_results(spark, sf) -> DataFrame:
    """Per-seed results of configurations (A is the baseline)."""
    l = table(spark, sf, "lineitem")
    return l.groupBy(
        F.col("l_returnflag").alias("config"),
        F.pmod(F.col("l_orderkey"), F.lit(SEED_COUNT)).cast("int").alias("seed"),
        F.when(F.col("l_linestatus") == "F", "SM").otherwise("MS").alias("direction"),
    ).agg(F.avg("l_discount").alias("acc"), F.avg("l_tax").alias("auc"))


def importances(spark, sf) -> DataFrame:
    """Feature importances per (method, domain, seed)."""
    l, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    return (
        l.join(p.select("p_partkey", "p_brand"), l.l_partkey == p.p_partkey)
        .groupBy(
            F.col("l_returnflag").alias("method"),
            F.when(F.col("l_linestatus") == "F", "static").otherwise("mobile").alias("domain"),
            F.pmod(F.col("l_orderkey"), F.lit(SEED_COUNT)).cast("int").alias("seed"),
            F.col("p_brand").alias("feature"),
        )
        .agg(F.sum("l_quantity").alias("importance"))
    )


def probes(spark, sf) -> DataFrame:
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("seed"),
        F.col("c_acctbal").alias("balance"),
        F.col("c_nationkey").cast("double").alias("nation"),
    )


def statuses(spark, sf) -> DataFrame:
    """Status rows in order of ``pos``; a seed may occur more than once."""
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("seed"),
        F.col("o_orderkey").alias("pos"),
        F.when(F.col("o_orderstatus") == "F", "ACCEPT").otherwise("REJECT").alias("result"),
    )


def logs(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "source", "text")


# Ordered classes for the text stand-in.
TEXT_RULES = [
    ("license", r"(?i)copyright|licen[sc]e"),
    ("mail", r"[A-Za-z0-9._]+@[A-Za-z0-9.]+"),
    ("secret", r"(?i)api[_-]?key|secret|password|token"),
]

SQL = {
    "tall": """
      SELECT event_id,
        CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'static' ELSE 'mobile' END AS domain,
        CASE event_id % 4 WHEN 0 THEN 'baseline' WHEN 1 THEN 'attack_only' WHEN 2 THEN 'defense_only'
             ELSE 'defense_vs_attack' END AS scenario,
        user_id AS file_source,
        CASE WHEN event_id % 4 >= 2 THEN 1 ELSE 0 END AS defense_active,
        event_type AS "Metric",
        value + CASE WHEN event_id % 4 >= 2 AND event_type IN ('purchase','view')
                     THEN CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 60.0::DOUBLE ELSE 20.0::DOUBLE END
                     ELSE 0.0::DOUBLE END AS "Value",
        CAST(hour(ts)*3600 + minute(ts)*60 + second(ts) AS DOUBLE) AS "StartTime",
        CAST(hour(ts)*3600 + minute(ts)*60 + second(ts) AS DOUBLE) + 40.0::DOUBLE AS "EndTime",
        CASE WHEN event_id % 3 <> 0 THEN 40.0::DOUBLE END AS "Duration"
      FROM events""",
    "wide_a": """
      SELECT domain, scenario, file_source, min(defense_active) AS defense_active,
        coalesce(avg("Value") FILTER ("Metric"='click'), 0.0::DOUBLE) AS click,
        coalesce(avg("Value") FILTER ("Metric"='error'), 0.0::DOUBLE) AS error,
        coalesce(avg("Value") FILTER ("Metric"='purchase'), 0.0::DOUBLE) AS purchase,
        coalesce(avg("Value") FILTER ("Metric"='signup'), 0.0::DOUBLE) AS signup,
        coalesce(avg("Value") FILTER ("Metric"='view'), 0.0::DOUBLE) AS view
      FROM tall GROUP BY domain, scenario, file_source""",
    "wide": """
      SELECT l_orderkey AS run_id, concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS row_key,
        CASE WHEN l_linestatus='F' THEN 'static' ELSE 'mobile' END AS domain,
        CASE WHEN (CASE WHEN l_linestatus='F' THEN l_quantity/50 ELSE l_quantity/100 + 5*l_tax END)
                  + 2*l_discount + l_extendedprice/200000 > 0.85::DOUBLE THEN 1 ELSE 0 END AS label,
        l_quantity AS qty, l_discount AS disc, l_tax AS tax, CAST(p_size AS DOUBLE) AS size,
        p_retailprice AS price, 2*l_quantity + l_tax AS qty_dup
      FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "network": """
      SELECT concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS row_key,
        CASE WHEN l_linestatus='F' THEN 'static' ELSE 'mobile' END AS domain,
        l_quantity/10.0::DOUBLE AS "TcMessageRate", l_tax AS "MidMessageRate", l_discount AS "HnaMessageRate",
        p_size/10.0::DOUBLE AS "AverageAdvertisedLinksPerTCMessage",
        l_tax*l_quantity + 0.5::DOUBLE AS "NormalizedRoutingLoad", l_discount + 0.01::DOUBLE AS "RoutingOverheadRatio",
        1.0::DOUBLE - l_discount AS "PacketDeliveryRatio", l_discount + 0.001::DOUBLE AS "PacketLossRatio",
        l_tax + 0.05::DOUBLE AS "AverageEndToEndDelay", l_discount/2.0::DOUBLE + 0.01::DOUBLE AS "AverageJitter",
        l_extendedprice/1000.0::DOUBLE AS "Throughput", l_linenumber::DOUBLE AS "AverageHopCount",
        l_quantity AS "DataPacketRate", (l_linenumber-1)::DOUBLE AS "FlowCount", p_size::DOUBLE AS "AvgTxPacketsPerFlow",
        (l_suppkey % 7 - 3)::DOUBLE AS "AverageMprCount",
        CASE WHEN l_linenumber=7 THEN 0.0::DOUBLE ELSE 40.0::DOUBLE END AS "_measurement_duration"
      FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "scores": """
      SELECT domain, run_id, row_key, label AS y, 'by_qty' AS model, round(qty/50, 4) AS score FROM wide
      UNION ALL
      SELECT domain, run_id, row_key, label AS y, 'by_disc' AS model, round(10*disc, 4) AS score FROM wide""",
    "seed_results": """
      SELECT l_returnflag AS config, CAST(l_orderkey % 20 AS INTEGER) AS seed,
        CASE WHEN l_linestatus='F' THEN 'SM' ELSE 'MS' END AS direction,
        avg(l_discount) AS acc, avg(l_tax) AS auc
      FROM lineitem GROUP BY 1, 2, 3""",
    "importances": """
      SELECT l_returnflag AS method, CASE WHEN l_linestatus='F' THEN 'static' ELSE 'mobile' END AS domain,
        CAST(l_orderkey % 20 AS INTEGER) AS seed, p_brand AS feature, sum(l_quantity) AS importance
      FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3, 4""",
    "probes": "SELECT c_custkey AS seed, c_acctbal AS balance, CAST(c_nationkey AS DOUBLE) AS nation FROM customer",
    "statuses": """
      SELECT o_custkey AS seed, o_orderkey AS pos, CASE WHEN o_orderstatus='F' THEN 'ACCEPT' ELSE 'REJECT' END AS result
      FROM orders""",
}
NEEDS = {"wide_a": ["tall"], "scores": ["wide"]}


def sql_with(*names: str, **extra: str) -> str:
    """``WITH`` clause of the named adapters (and what they need), followed by ``extra`` steps in order."""
    order: list[str] = []

    def add(n: str) -> None:
        for d in NEEDS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    steps = [f"{n} AS ({SQL[n]})" for n in order] + [f"{n} AS ({q})" for n, q in extra.items()]
    return "WITH " + ",\n".join(steps) + "\n"


# ---- many columns with nulls ----------------------------------------------------

MANY = [f"m{i:02d}" for i in range(32)]


def _many_text(i: int) -> str:
    """Column i: integer-valued, related to its neighbours, null in one row of ``i + 23``; the same text in both engines."""
    value = f"(l_quantity * {i % 5 + 1} + ((l_partkey * {i + 3} + l_suppkey * {i % 7}) % {41 + i}))"
    return f"CASE WHEN (l_orderkey * {i + 1} + l_linenumber) % {i + 23} = 0 THEN NULL ELSE CAST({value} AS DOUBLE) END AS {MANY[i]}"


MANY_COLUMNS = ["CASE WHEN l_linestatus = 'F' THEN 'static' ELSE 'mobile' END AS domain", "CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END AS label", *[_many_text(i) for i in range(32)]]


def many(spark, sf) -> DataFrame:
    """Line items with 32 features that miss values."""
    return table(spark, sf, "lineitem").selectExpr(*MANY_COLUMNS)


SQL["many"] = f"SELECT {', '.join(MANY_COLUMNS)} FROM lineitem"


# ---- the named metrics -------------------------------------------------------------

LABEL_TEXT = """CASE WHEN (CASE WHEN l_linestatus = 'F' THEN l_quantity / 50 ELSE l_quantity / 100 + 5 * l_tax END)
  + 2 * l_discount + l_extendedprice / 200000 > CAST(0.85 AS DOUBLE) THEN 1 ELSE 0 END"""


def _metric_text(i: int, name: str) -> str:
    """Metric i: what drives the label in varying shares, noise from keys, and a shift between the domains; the same text in both engines."""
    drive = f"l_quantity * {i % 5} + 100 * l_discount * {i % 3} + 200 * l_tax * {(i + 1) % 4}"
    noise = f"(l_partkey * {i + 3} + l_suppkey * {i % 7} + l_linenumber * {i}) % {41 + i}"
    return f"CAST({drive} + {noise} + CASE WHEN l_linestatus = 'F' THEN 0 ELSE {i % 6} END AS DOUBLE) AS {name}"


METERED_COLUMNS = [
    "l_orderkey AS run_id", "CASE WHEN l_linestatus = 'F' THEN 'static' ELSE 'mobile' END AS domain", f"{LABEL_TEXT} AS label",
    *[_metric_text(i, m) for i, m in enumerate(METRICS)], "CAST(CASE WHEN l_linenumber = 7 THEN 0 ELSE 40 END AS DOUBLE) AS _measurement_duration",
]


def metered(spark, sf) -> DataFrame:
    """Line items as windows with all named metrics and the label of ``wide``."""
    return table(spark, sf, "lineitem").selectExpr(*METERED_COLUMNS)


SQL["metered"] = f"SELECT {', '.join(METERED_COLUMNS)} FROM lineitem"
