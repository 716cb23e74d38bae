"""Quality rules: an ordered decision list learned from labelled statistics, applied as one Spark conditional expression.

Statistics are built-in expressions over the whole text.  Sequential covering: a rule grows by the condition
(feature above or below a threshold) with the largest information gain among rows that no earlier rule covers, is pruned
back to the prefix that does best on rows kept aside, and is accepted only if it is precise on both; then its rows leave
and the next rule is sought.  Every step is one small aggregation of per-bin counts.

Results: a null or empty text has zero words and fails the base rules; unlabelled rows and null labels teach nothing;
without labels, or where no rule is precise enough, the list is empty and only the base rules decide; repeated rows get
repeated results; other columns pass through under any name (own columns carry the prefix given).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Labelled rows that a list is learned from, at most: the first in order of a hash of their id.
SAMPLE = 20_000
BINS = 32
MAX_RULES, MAX_CONDITIONS = 8, 3
PRECISION, SUPPORT = 0.95, 10


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more, first occurrences included."""

    def covered(p: Column) -> Column:
        last = F.size(p) - 1
        own = F.transform(p, lambda x, j: F.when(j == last, F.lit(3)).otherwise(F.least(F.lit(3), F.get(p, j + 1) - x)))
        return F.aggregate(own, F.lit(0), lambda a, x: a + x)

    def places(s: Column) -> Column:
        same = F.filter(s, lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)))
        return let(F.array_sort(F.transform(same, lambda x: x["i"])), covered)

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(F.array_sort(windows(words)), places))


def duplicate_lines(text: Column) -> Column:
    """Lines that hold a word and equal an earlier line."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def statistics(text: Column) -> Column:
    """A struct of the statistics of one text."""
    t = F.coalesce(text, F.lit(""))

    def of(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("bigint").alias("word_chars"),
            (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
            duplicate_lines(t).cast("bigint").alias("n_dup_lines"),
            repeated_words(w).cast("bigint").alias("n_repeat_words"),
            F.size(F.array_distinct(w)).cast("bigint").alias("n_distinct"),
        )

    return let(F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), of)


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def features(s: Column) -> dict[str, Column]:
    """What conditions are about: shares per word, comparable between short and long texts."""
    n = F.greatest(s["n_words"], F.lit(1)).cast("double")
    return {
        "n_words": s["n_words"].cast("double"), "mean_word": s["word_chars"] / n, "symbols_per_word": s["n_symbols"] / n,
        "dup_lines_per_word": s["n_dup_lines"] / n, "repeated_share": s["n_repeat_words"] / n, "distinct_share": s["n_distinct"] / n,
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self, f: dict[str, Column]) -> Column:
        return f[self.feature] > self.threshold if self.above else f[self.feature] <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


Rule = tuple[Condition, ...]


def both(rule: Rule, f: dict[str, Column]) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column(f)
    return out


def gain(p: float, n: float, p0: float, n0: float) -> float:
    """Information gained about the p positives that stay covered."""
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p and p0 else 0.0


def learn(stats: DataFrame, label: str, precision: float = PRECISION, support: int = SUPPORT, max_rules: int = MAX_RULES, max_conditions: int = MAX_CONDITIONS) -> list[Rule]:
    """Rules for the rows whose ``label`` is true, from (features..., ``label``, ``aside``); see ``labelled``."""
    names = [c for c in stats.columns if c not in (label, "aside")]
    cuts = stats.agg(*[F.percentile_approx(c, [i / BINS for i in range(1, BINS)], 2000).alias(c) for c in names]).first()
    cuts = {c: sorted(set(cuts[c] or ())) for c in names}
    names = [c for c in names if cuts[c]]
    if not names:
        return []
    f = {c: F.col(c) for c in names}

    def bin_of(c: str) -> Column:
        return F.size(F.filter(F.array(*[F.lit(float(t)) for t in cuts[c]]), lambda t: F.col(c) > t))

    bins = F.array(*[F.struct(F.lit(c).alias("feature"), bin_of(c).alias("bin")) for c in names])
    rules: list[Rule] = []

    def counts(rule: Rule, rows: DataFrame) -> tuple[int, int]:
        r = rows.filter(both(rule, f)).agg(F.coalesce(F.sum(F.col(label).cast("int")), F.lit(0)), F.count("*")).first()
        return r[0], r[1] - r[0]

    for _ in range(max_rules):
        left = stats
        for r in rules:
            left = left.filter(~both(r, f))
        grow, aside = left.filter(~F.col("aside")), left.filter("aside")
        rule: Rule = ()
        while len(rule) < max_conditions:
            table = grow.filter(both(rule, f)).select(label, F.explode(bins).alias("b")).groupBy("b.feature", "b.bin").agg(F.sum(F.col(label).cast("int")).alias("p"), F.count("*").alias("m")).collect()
            at = {(r["feature"], r["bin"]): (r["p"], r["m"] - r["p"]) for r in table}
            best = None
            for c in names:
                p0 = sum(at.get((c, b), (0, 0))[0] for b in range(len(cuts[c]) + 1))
                n0 = sum(at.get((c, b), (0, 0))[1] for b in range(len(cuts[c]) + 1))
                p = n = 0
                for b, t in enumerate(cuts[c]):
                    p, n = p + at.get((c, b), (0, 0))[0], n + at.get((c, b), (0, 0))[1]
                    for above, pp, nn in ((False, p, n), (True, p0 - p, n0 - n)):
                        g = gain(pp, nn, p0, n0)
                        if pp >= support and (best is None or g > best[0] + 1e-9):
                            best = (g, Condition(c, above, float(t)), nn)
            if best is None or best[0] <= 1e-9:
                break
            rule = (*rule, best[1])
            if best[2] == 0:
                break
        if not rule:
            break
        # prune: the prefix that does best on the rows kept aside
        worth = {k: counts(rule[:k], aside) for k in range(1, len(rule) + 1)}
        k = max(worth, key=lambda k: ((worth[k][0] - worth[k][1]) / max(1, sum(worth[k])), -k))
        rule, (p, n) = rule[:k], worth[k]
        gp, gn = counts(rule, grow)
        if p == 0 or p < precision * (p + n) or gp + p < precision * (gp + gn + p + n) or gp + p < support:
            break
        rules.append(rule)
    return rules


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int = SAMPLE) -> DataFrame:
    """Features of at most ``sample`` labelled documents that pass the base rules, with ``bad`` and ``aside`` (a third, by hash).

    The sample's texts are stored before anything is computed from them, and their statistics before the base rules filter them:
    otherwise the optimiser would move the filter, and the statistics with it, below the join to all documents.  Of several
    texts of one id the smallest counts.
    """
    from windowlab.llm.store import partitions, stored

    taught = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_label"))
    taught = taught.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    d = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(taught), "_id")
    texts = stored(d.groupBy("_id", "_label").agg(F.min(F.coalesce("_text", F.lit(""))).alias("_text")), "taught")
    texts = texts.repartition(partitions(docs.sparkSession), "_id")
    d = stored(texts.select("_id", "_label", statistics(F.col("_text")).alias("_s")), "statistics").filter(~base_failed(F.col("_s")))
    f = features(F.col("_s"))
    return d.select(*[v.alias(k) for k, v in f.items()], (F.col("_label") == 0).alias("bad"), (F.pmod(F.xxhash64("_id", F.lit("aside")), F.lit(3)) == 0).alias("aside"))


def decision(rules: list[Rule], s: Column) -> Column:
    """The ordered list as one conditional expression: the number of the first rule that fires, 0 for none."""
    f, out = features(s), None
    for k, r in enumerate(rules, 1):
        out = F.when(both(r, f), F.lit(k)) if out is None else out.when(both(r, f), F.lit(k))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def kept(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the base rules and the list keep, columns unchanged under any name.

    The verdict is generated, not projected: a filter on a projected column would be merged with it and compute the statistics
    once for every place where they are used.
    """
    verdict = let(statistics(F.col(text_col)), lambda s: ~base_failed(s) & (decision(rules, s) == 0))
    name = "kept" + "_" * (1 + max((len(c) for c in docs.columns), default=0))
    return docs.select("*", F.explode(F.array(verdict)).alias(name)).filter(F.col(name)).drop(name)


def judge(docs: DataFrame, rules: list[Rule], text_col: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with a struct column ``<prefix>quality``: statistics, base_failed, rule (0: none) and kept."""
    s = let(statistics(F.col(text_col)), lambda s: F.struct(s.alias("stats"), base_failed(s).alias("base_failed"), decision(rules, s).alias("rule")))
    return docs.withColumn(f"{prefix}quality", s).withColumn(f"{prefix}quality", F.col(f"{prefix}quality").withField("kept", ~F.col(f"{prefix}quality.base_failed") & (F.col(f"{prefix}quality.rule") == 0)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> list[Rule]:
    """The decision list for bad texts, from the labelled rows; the statistics of the sample are stored once."""
    from windowlab.llm.store import stored

    return learn(stored(labelled(docs, labels, id_col, text_col, label_col, sample), "labelled"), "bad")
