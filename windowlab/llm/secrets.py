"""Secret scans over a ledger of blobs.

Every version of every path is content-addressed (SHA-256 of its text).  A ledger folder remembers which pairs of blob and
rule version have been scanned and what was found, so a run reads only texts whose blob is new under this rule version;
findings are joined back to all paths that hold the blob.  Built-in functions only.

Where a match stands: the lengths of the gaps that ``split`` leaves and of the matches are summed in order.

Results: a null or empty text is the empty blob and has no spans; repeated rows have equal results; overlapping kinds are
all kept; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from windowlab.llm.store import join_sizes

#: Kinds in order of report: pattern, least length, group whose length counts.  The first three are the base set.
KINDS = {
    "assign": (r"""(?:(?i)(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    "access": (r"AKIA[A-Z0-9]+", 20, 0),
    "hex": (r"[0-9a-f]{24,}", 24, 0),
    "pem": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 1, 0),
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 1, 0),
}
BASE = ("assign", "access", "hex")
#: Changes whenever KINDS changes; a new version scans everything again.
RULE_VERSION = "1"


def matches(text: Column, kind: str) -> Column:
    """All matches of a kind as structs (kind, nth, gap before it, length, whether it is long enough)."""
    pattern, least, group = KINDS[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def one(g: Column) -> Column:
        def entry(x: Column, i: Column) -> Column:
            value = F.regexp_extract(x, pattern, group) if group else x
            return F.struct(F.lit(list(KINDS).index(kind)).alias("kind"), i.alias("nth"), F.length(F.get(g, i)).alias("gap"), F.length(x).alias("size"), (F.length(value) >= least).alias("good"))

        return F.transform(found, entry)

    # gaps are split once per text, not once per match
    return F.when(text.rlike(pattern), F.get(F.transform(F.array(gaps), one), F.lit(0)))


def blobs(versions: DataFrame, path_col: str, text_col: str) -> DataFrame:
    """(path, place, blob, text): the content address of every row; ``place`` is a hash of the path."""
    text = F.coalesce(text_col, F.lit(""))
    return versions.select(F.col(path_col).alias("path"), F.xxhash64(path_col).alias("place"), F.sha2(text, 256).alias("blob"), text.alias("text"))


def read_ledger(spark, ledger: str, what: str, ddl: str) -> DataFrame:
    """A table of the ledger; empty before the first run."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{ledger}/{what}")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], ddl)
    return spark.read.schema(ddl).parquet(f"{ledger}/{what}")


SCANNED = "blob string, rules string"
FINDINGS = "blob string, rules string, kind int, start bigint, stop bigint"


def spans(texts: DataFrame) -> DataFrame:
    """(blob, kind, start, stop) of the texts (blob, text), one row per blob; offsets in code points."""
    none = F.expr("cast(array() as array<struct<kind:int,nth:int,gap:int,size:int,good:boolean>>)")
    found = texts.select("blob", F.concat(*[F.coalesce(matches(F.col("text"), k), none) for k in KINDS]).alias("all"))
    found = found.filter(F.size("all") > 0).dropDuplicates(["blob"]).select("blob", F.explode("all").alias("m")).select("blob", "m.*")
    before = Window.partitionBy("blob", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stop = F.sum(F.col("gap").cast("bigint") + F.col("size")).over(before)
    return found.withColumn("stop", stop).filter("good").select("blob", "kind", (F.col("stop") - F.col("size")).alias("start"), "stop")


def scan(versions: DataFrame, ledger: str, path_col: str = "path", text_col: str = "text", rules: str = RULE_VERSION) -> DataFrame:
    """Bring the ledger up to date with ``versions`` and return (path, blob, spans) for every row.

    ``spans`` is an array of (start, kind, stop) in order, empty where nothing was found.
    """
    spark = versions.sparkSession
    rows = blobs(versions, path_col, text_col)
    held = rows.groupBy("blob").agg(F.min("place").alias("place"), F.count("*").alias("copies"))
    seen = read_ledger(spark, ledger, "scanned", SCANNED).filter(F.col("rules") == rules).select("blob")
    fresh = held.join(seen, "blob", "left_anti").select("blob", "place")
    texts = rows.select("blob", "place", "text").join(fresh, ["blob", "place"], "left_semi")
    spans(texts).select("blob", F.lit(rules).alias("rules"), "kind", "start", "stop").write.mode("append").parquet(f"{ledger}/findings")
    fresh.select("blob", F.lit(rules).alias("rules")).write.mode("append").parquet(f"{ledger}/scanned")
    # a run that was cut off between the two writes leaves findings twice: they are made distinct
    known = read_ledger(spark, ledger, "findings", FINDINGS).filter(F.col("rules") == rules).select("blob", "start", "kind", "stop").distinct()
    known = known.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "stop"))).alias("spans"))
    known = held.select("blob", "copies").join(known, "blob", "left")
    out = join_sizes(rows.select("path", "blob"), known, "blob", "copies", "left")
    return out.select("path", "blob", F.coalesce("spans", F.expr("cast(array() as array<struct<start:bigint,kind:int,stop:bigint>>)")).alias("spans"))


def label(spans_col: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """Spans as ``kind:start:stop`` joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    own = spans_col if kinds is None else F.filter(spans_col, lambda x: x["kind"].isin([list(KINDS).index(k) for k in kinds]))
    return F.array_join(F.transform(own, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["stop"])), ",")


def number(spans_col: Column, kind: str) -> Column:
    return F.size(F.filter(spans_col, lambda x: x["kind"] == list(KINDS).index(kind))).cast("bigint")


def masked(text: Column, spans_col: Column) -> Column:
    """The text with every run that spans cover replaced by the kind of the first span that touches it, in angle brackets."""
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    # overlapping spans become one run: (start, stop, kind), in order
    start = F.struct(F.expr("cast(array() as array<struct<start:bigint,stop:bigint,kind:int>>)").alias("runs"))

    def add(a: Column, x: Column) -> Column:
        last = F.get(a["runs"], F.size(a["runs"]) - 1)
        own = F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["kind"].alias("kind"))
        longer = F.struct(last["start"].alias("start"), F.greatest(last["stop"], x["stop"]).alias("stop"), last["kind"].alias("kind"))
        inside = F.coalesce(x["start"] < last["stop"], F.lit(False))
        return F.struct(F.when(inside, F.concat(F.slice(a["runs"], 1, F.greatest(F.size(a["runs"]) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(a["runs"], F.array(own))).alias("runs"))

    runs = F.aggregate(spans_col, start, add)["runs"]

    def pieces(r: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            before = F.coalesce(F.get(r, i - 1)["stop"], F.lit(0))
            return F.concat(F.substring(text, (before + 1).cast("int"), (x["start"] - before).cast("int")), F.get(names, x["kind"]))

        tail = F.substring(text, (F.coalesce(F.get(r, F.size(r) - 1)["stop"], F.lit(0)) + 1).cast("int"), F.length(text))
        return F.concat(F.array_join(F.transform(r, one), ""), tail)

    return F.get(F.transform(F.array(runs), pieces), F.lit(0))
