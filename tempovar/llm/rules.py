"""Quality rules: a decision list learned by sequential covering (operator 4), in column expressions only.

Whole-text statistics feed integer features (per mille, or counts). Labelled rows are split
by a hash of doc_id into growing and pruning rows. A rule grows by the threshold condition
of the largest FOIL gain until it covers no good growing row, is pruned to the prefix of
the best (bad - good) / (bad + good) on pruning rows, and is accepted if that share of bad
is high enough; the rows it covers leave, and the next rule grows. If it is not, the feature
and side it starts with are set aside until a rule is accepted, and the next best start is
tried. A grown rule's earlier thresholds are chosen anew beside its later conditions where
that covers more bad and no more good rows. The thresholds of a step are percentiles of each feature over the growing rows the rule
still covers and the bad ones of them, and the middles between neighbours. Each step is two aggregates over the
labelled statistics: feature x threshold counts go to the driver, never rows. The list is
emitted as ordered ``when(...)`` expressions.

Defined cases: a null text has no words and fails the base rule; labels without a doc_id, a
document or a quality are not learned from; a doc_id labelled twice counts twice; without
labels the list is empty and only the base rule rejects; repeated rows each get their row;
very long texts are measured whole; an empty table gives no rows; extra columns are not carried.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

SYMBOLS, SPACE = "#*$%&|<>", " \t\n\x0b\f\r"
#: Percentiles of a feature that are offered as thresholds: of the rows, and of the bad rows.
CUTS = 256
Condition = tuple[str, bool, int]  # feature, whether above (else at most), threshold


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def repeat_words(words: Column) -> Column:
    """Words inside a 3-word window that occurs twice or more in the text."""
    def covered(z: Column) -> Column:
        again = F.filter(z, lambda e, i: F.coalesce(F.get(z, i - 1)["h"] == e["h"], F.lit(False))
                         | F.coalesce(F.get(z, i + 1)["h"] == e["h"], F.lit(False)))
        return F.size(F.array_distinct(F.flatten(F.transform(again, lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2)))))

    def of(w: Column) -> Column:
        hashes = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        return let(hashes, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), 0).otherwise(
            let(F.array_sort(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), covered)))

    return let(words, of)


def statistics(docs: DataFrame) -> DataFrame:
    """Per document: the base columns of the contract and the features."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    t = F.col("t")
    words = F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = let(words, lambda w: F.struct(F.size(w).alias("n"), repeat_words(w).alias("again"), F.size(F.array_distinct(w)).alias("kinds")))
    line = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    upper = F.length(t) - F.length(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    marks = F.length(t) - F.length(F.translate(t, "!?", ""))
    digits = F.length(t) - F.length(F.translate(t, "0123456789", ""))
    raw = d.select("doc_id", counted.alias("w"), line.alias("l"), without(t, SPACE).alias("chars"),
                   (F.length(t) - without(t, SYMBOLS)).alias("symbols"), upper.alias("upper"), marks.alias("marks"), digits.alias("digits"))

    def share(a: Column, b: Column) -> Column:
        return F.floor(1000 * a / F.greatest(b, F.lit(1))).cast("long")

    n, chars = F.col("w.n"), F.col("chars")
    base = raw.select(
        "doc_id", n.cast("long").alias("n_words"), chars.cast("long").alias("word_chars"), F.col("symbols").cast("long").alias("n_symbols"),
        F.col("l.dup").cast("long").alias("n_dup_lines"), F.col("w.again").cast("long").alias("n_repeat_words"),
        n.cast("long").alias("f_words"), share(chars, n).alias("f_word_length"), share(F.col("symbols"), n).alias("f_symbols"),
        share(F.col("l.dup"), F.col("l.n")).alias("f_dup_lines"), share(F.col("w.again"), n).alias("f_repeat_words"),
        share(F.col("w.kinds"), n).alias("f_distinct_words"), share(F.col("upper"), chars).alias("f_upper"),
        share(F.col("marks"), n).alias("f_marks"), share(F.col("digits"), chars).alias("f_digits"), share(n, F.col("l.n")).alias("f_line_words"))
    return base.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def holds(rule: list[Condition]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f) > v if above else F.col(f) <= v for f, above, v in rule], F.lit(True))


def decision_list(rules: list[list[Condition]], default: bool = True) -> Column:
    """The rules in order, each rejecting what it covers; then the default."""
    out: Column | None = None
    for rule in rules:
        out = F.when(holds(rule), not default) if out is None else out.when(holds(rule), not default)
    return F.lit(default) if out is None else out.otherwise(default)


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def thresholds(rows: DataFrame, features: list[str]) -> dict[str, list[int]]:
    """Per feature the values at the percentiles of ``rows`` and of the bad ones, and the middles between neighbours."""
    shares = [i / CUTS for i in range(CUTS + 1)]
    bad = F.col("bad") == 1
    got = rows.agg(*[F.percentile_approx(x, shares, 10_000).alias(f"{f}_{k}") for f in features for k, x in enumerate((F.col(f), F.when(bad, F.col(f))))]).first()
    values = {f: sorted({v for k in (0, 1) for v in got[f"{f}_{k}"] or ()}) for f in features}
    return {f: sorted({c for a, b in zip(v, v[1:]) for c in (a, (a + b) // 2)}) for f, v in values.items()}


def best_condition(rows: DataFrame, features: list[str], aside: set[tuple[str, bool]] = frozenset()) -> tuple[Condition | None, int, int]:
    """The condition of the largest gain on ``rows`` (``bad``), with the bad and good it covers; none of a feature and side ``aside``."""
    grid = thresholds(rows, features)
    values = (rows.select("bad", F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("v")) for f in features])).alias("x"))
              .groupBy("x.f", "x.v").agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")))
    cuts = F.create_map(*[c for f in features for c in (F.lit(f), F.array(*map(F.lit, grid[f])).cast("array<long>"))])
    below = F.size(F.filter(cuts[F.col("f")], lambda c: c < F.col("v")))
    cells = values.groupBy("f", below.alias("b")).agg(F.sum("p").alias("p"), F.sum("n").alias("n")).collect()  # at most features x thresholds
    count = {(r["f"], r["b"]): (r["p"], r["n"]) for r in cells}
    best: tuple[float, Condition | None, int, int] = (0.0, None, 0, 0)
    for f in features:
        of = [count.get((f, b), (0, 0)) for b in range(len(grid[f]) + 1)]
        p0, n0 = sum(c[0] for c in of), sum(c[1] for c in of)
        p = n = 0
        for v, cell in zip(grid[f], of):  # at most v: cells up to this one
            p, n = p + cell[0], n + cell[1]
            for above, q, m in ((False, p, n), (True, p0 - p, n0 - n)):
                if p0 and (f, above) not in aside and (gain := _gain(q, m, p0, n0)) > best[0] + 1e-9:
                    best = (gain, (f, above, v), q, m)
    return best[1:]


def learn(labelled: DataFrame, features: list[str], min_bad: float = 0.9, least: int = 5) -> list[list[Condition]]:
    """Rules for bad rows (``bad`` 1, else 0; ``prune`` marks pruning rows), in order.

    A rule grows while a condition gains and good rows are covered; the list grows while a rule passes the pruning
    test and ``least`` bad pruning rows are left to cover. Nothing else ends either.
    """
    rules: list[list[Condition]] = []
    aside: set[tuple[str, bool]] = set()
    while True:
        left = labelled.where(~reduce(lambda a, b: a | b, [holds(r) for r in rules], F.lit(False)))
        if not aside and left.where(F.col("prune") & (F.col("bad") == 1)).count() < least:
            break  # no rule can be accepted
        rule: list[Condition] = []
        while True:
            condition, p, n = best_condition(left.where(~F.col("prune") & holds(rule)), features, frozenset() if rule else aside)
            if condition is None:
                break
            rule.append(condition)
            covered = p, n
            if n == 0:
                break
        if not rule:
            break
        for i, (f, above, _) in enumerate(rule[:-1]):  # a threshold chosen before the later conditions may be too tight beside them
            beside = left.where(~F.col("prune") & holds(rule[:i] + rule[i + 1:]))
            condition, p, n = best_condition(beside, [f], {(f, not above)})
            if condition is not None and p > covered[0] and n <= covered[1]:
                rule[i], covered = condition, (p, n)
        prefixes = [rule[:i] for i in range(1, len(rule) + 1)]
        got = left.where("prune").agg(*[F.sum(F.when(holds(r), x).otherwise(0)) for r in prefixes for x in (F.col("bad"), 1 - F.col("bad"))]).first()
        worth = [((got[2 * i] or 0), (got[2 * i + 1] or 0)) for i in range(len(prefixes))]
        value = [(p - n) / (p + n) if p + n else -1.0 for p, n in worth]
        i = max(range(len(value)), key=lambda k: (value[k], -k))
        p, n = worth[i]
        if p < least or p / (p + n) < min_bad:
            aside.add(rule[0][:2])
            continue
        rules.append(prefixes[i])
        aside = set()
    return rules


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Base columns, ``base_failed`` and ``kept`` of every document, by rules learned from ``labels`` (doc_id, quality)."""
    stats = stored(statistics(docs), "statistics")
    features = [c for c in stats.columns if c.startswith("f_")]
    marked = labels.where("quality is not null").select(F.col("doc_id").cast("long").alias("l_id"), (F.col("quality") == 0).cast("int").alias("bad"))
    labelled = stored(stats.where("not base_failed").join(marked, F.col("doc_id") == F.col("l_id"))
                      .select(*features, "bad", (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("prune")), "labelled")
    rules = learn(labelled, features)
    kept = F.when(F.col("base_failed"), False).otherwise(decision_list(rules))
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))
