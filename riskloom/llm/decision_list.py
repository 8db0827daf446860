"""Learned decision list over text statistics, by sequential covering.

Training rows are the labelled documents' statistics.  They are binned on a
fixed grid of cuts and counted per cell, label and fold once; each step of the
learner is a grouped count over that small table.  A rule for class 0 grows by
the threshold condition with the highest FOIL gain on the growing fold, then
loses trailing conditions while that does not lower its worth on the pruning
fold; a rule that holds up there is kept, what it covers is removed, and the
next rule is learned on the rest.  The list is emitted as one ordered
``CASE WHEN`` expression.

DataFrame operations only.  The driver sees counts per feature and cut, whose
number does not depend on the data.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.tables import written
from riskloom.llm.textstats import GRID, bins, doc_stats, flat, ratios


@dataclass(frozen=True)
class Condition:
    """``feature >= GRID[feature][cut]``, or ``<`` it when ``below``."""

    feature: str
    cut: int
    below: bool

    def on_bin(self) -> Column:
        b = F.col(self.feature)
        return b <= F.lit(self.cut) if self.below else b > F.lit(self.cut)

    def on_ratio(self) -> Column:
        value, cut = ratios()[self.feature], F.lit(GRID[self.feature][self.cut])
        return value < cut if self.below else value >= cut

    def __str__(self) -> str:
        return f"{self.feature} {'<' if self.below else '>='} {GRID[self.feature][self.cut]}"


Rule = tuple[Condition, ...]


def all_of(rule: Rule, test) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & test(c)
    return out


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of every whole text, written once (no text)."""
    return written(docs.select(F.col("doc_id").cast("long"), doc_stats(F.col("text")).alias("_s"))
                   .select("doc_id", *flat(F.col("_s"))), "text-statistics")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def label_cells(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled rows that pass the base rules, counted per cell of the grid.

    A document labelled both ways counts as 0; rows without a label or doc_id
    do not train.  Every third id, by hash, is in the pruning fold.
    """
    own = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("quality").cast("int")).alias("y")).where("y IN (0, 1)")
    fold = (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("pruning")
    b = bins()
    rows = stats.where(~base_failed()).join(own, "doc_id").select(fold, "y", *(v.alias(f) for f, v in b.items()))
    return written(rows.groupBy("pruning", "y", *b).agg(F.count(F.lit(1)).alias("n")), "rule-cells")


def _by_bin(cells: DataFrame) -> dict[str, dict[tuple[int, int], int]]:
    """{feature: {(bin, y): rows}}: at most features x cuts x 2 counts."""
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.col(f).alias("b")) for f in GRID)))
    out: dict = {f: {} for f in GRID}
    for r in cells.select(pairs.alias("p"), "y", "n").groupBy("p.f", "p.b", "y").agg(F.sum("n").alias("n")).collect():
        out[r["f"]][r["b"], r["y"]] = r["n"]
    return out


def _foil(p1: int, n1: int, p0: int, n0: int) -> float:
    return p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0))) if p1 else 0.0


def _best(counts: dict, rule: Rule) -> tuple[float, Condition | None]:
    best: tuple[float, Condition | None] = (0.0, None)
    for f, own in counts.items():
        p0, n0 = (sum(v for (_, y), v in own.items() if y == k) for k in (0, 1))
        if not p0 or not n0:
            return 0.0, None
        for cut in range(len(GRID[f])):
            for below in (False, True):
                inside = [(y, v) for (b, y), v in own.items() if (b <= cut) == below]
                p1, n1 = (sum(v for y, v in inside if y == k) for k in (0, 1))
                gain = _foil(p1, n1, p0, n0)
                if gain > best[0] + 1e-9:
                    best = gain, Condition(f, cut, below)
    return best


def _prefix_counts(cells: DataFrame, rule: Rule) -> list[tuple[int, int]]:
    """(class 0, class 1) rows of the pruning fold under each prefix of the rule."""
    aggs = []
    for k in range(1, len(rule) + 1):
        for y in (0, 1):
            aggs.append(F.sum(F.when(all_of(rule[:k], Condition.on_bin) & (F.col("y") == y), F.col("n"))).alias(f"c{k}_{y}"))
    row = cells.where("pruning").agg(*aggs).first()
    return [(row[f"c{k}_0"] or 0, row[f"c{k}_1"] or 0) for k in range(1, len(rule) + 1)]


def learn(cells: DataFrame, min_cover: int = 3, min_precision: float = 0.8) -> list[Rule]:
    """Ordered rules for class 0.  Without labels of both classes: none.

    A rule grows until no condition gains, and rules are added until the next
    one does not hold up on the pruning fold.  Both end: a condition that gains
    leaves rows out, and a rule that holds up takes rows of class 0 away."""
    rules: list[Rule] = []
    left = cells
    while True:
        rule: Rule = ()
        grow = left.where(~F.col("pruning"))
        while True:
            _, condition = _best(_by_bin(grow.where(all_of(rule, Condition.on_bin))), rule)
            if condition is None:
                break
            rule += (condition,)
        if not rule:
            break
        worth = [((p - n) / (p + n) if p + n else -1.0, p, n) for p, n in _prefix_counts(left, rule)]
        keep = max(range(len(rule)), key=lambda k: (worth[k][0], -k))
        value, p, n = worth[keep]
        if p < min_cover or p / (p + n) < min_precision:
            break
        rules.append(rule[:keep + 1])
        left = left.where(~all_of(rules[-1], Condition.on_bin))
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as one ordered conditional: the text of the first rule that
    fires, null where none does (the document is kept)."""
    out = None
    for rule in rules:
        test, text = all_of(rule, Condition.on_ratio), F.lit(" and ".join(map(str, rule)))
        out = F.when(test, text) if out is None else out.when(test, text)
    return F.lit(None).cast("string") if out is None else out


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, the rule that rejects, and kept.

    A null or empty text has no words and fails the base; null ids stay null
    and do not train; repeated rows are judged each; an empty table gives no
    rows; extra columns are ignored.
    """
    stats = statistics(docs)
    rules = learn(label_cells(stats, labels))
    return (stats.withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
            .withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()))
