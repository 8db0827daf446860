"""Document quality by hierarchical empirical Bayes over sites.

A document's own evidence is a naive Bayes log-likelihood ratio of its binned
text statistics.  Its site adds a prior: counts of good and bad documents are
gathered per path and per host (labels count whole, the classifier's opinion
of an unlabelled document counts ``soft_weight``), and rates are shrunk level
by level, path towards host, host towards all documents.  How strongly is
estimated from the data: the spread of the rates beyond what sampling explains
gives the prior's pseudo-counts, so sparse sites lean on their parent.

Only counts are grouped, with partial aggregates, so a host that holds a third
of all documents costs one row a task.  The site table is written, so the
planner knows its size when it joins it back, and broadcasts or sorts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.tables import written
from riskloom.llm.textstats import GRID, bins, doc_stats, flat

OWN = "_site_quality"  # our columns beside the document's travel in one struct


def prepared(docs: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """``docs`` with one struct more (statistics' bins, host, path), written once.

    A null host or path is the empty name; a path belongs to its host."""
    s = F.col("_s")
    b = [v.alias(f) for f, v in bins().items()]
    h, p = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (host, path))
    inner = docs.drop(OWN).select(F.struct("*").alias("d"), h.alias("h"), p.alias("p"), doc_stats(F.col("text")).alias("_s"))
    return written(inner.select("d", "h", "p", *flat(s)).select("d.*", F.struct(F.col("h").alias("host"), F.col("p").alias("path"), *b).alias(OWN)), "site-quality")


def evidence_table(labelled: DataFrame) -> dict[str, list[float]]:
    """Log-likelihood ratio (good over bad) per feature and bin, add-one
    smoothed, from grouped counts: at most features x bins x 2 rows."""
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.col(f"{OWN}.{f}").alias("b")) for f in GRID)))
    counts: dict = {}
    for r in labelled.select(pairs.alias("x"), "_y").groupBy("x.f", "x.b", "_y").count().collect():
        counts[r["f"], r["b"], r["_y"]] = r["count"]
    out = {}
    for f, cuts in GRID.items():
        k = len(cuts) + 1
        total = [sum(counts.get((f, b, y), 0) for b in range(k)) for y in (0, 1)]
        out[f] = [math.log((counts.get((f, b, 1), 0) + 1) / (total[1] + k)) - math.log((counts.get((f, b, 0), 0) + 1) / (total[0] + k))
                  for b in range(k)]
    return out


def evidence(table: dict[str, list[float]]) -> Column:
    return sum((F.get(F.array(*map(F.lit, table[f])), F.col(f"{OWN}.{f}")) for f in GRID), F.lit(0.0))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _strength(rates: DataFrame, least: float = 2.0, most: float = 1e4) -> float:
    """Pseudo-counts of a level's prior by the method of moments: ``rates`` has
    good, n and the parent's rate m of each of the level's sites."""
    dev = F.col("n") * (F.try_divide(F.col("good"), F.col("n")) - F.col("m")) ** 2
    row = rates.where("n > 0").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(dev).alias("dev"),
                                   F.sum(F.col("n") * F.col("m") * (1 - F.col("m"))).alias("mm")).first()
    if not row["k"] or not row["n"] or not row["mm"]:
        return most
    spread = row["mm"] / row["n"]
    between = (row["dev"] - row["k"] * spread) / row["n"]
    return most if between <= 0 else min(most, max(least, spread / between - 1))


def site_rates(own: DataFrame, prior: float, soft_weight: float) -> DataFrame:
    """host, path and the shrunk rate of good documents, one row a site;
    ``own`` has host, path, _y (null: unlabelled) and _p (classifier)."""
    w = F.when(F.col("_y").isNull(), F.lit(soft_weight)).otherwise(F.lit(1.0))
    good = F.when(F.col("_y").isNull(), F.lit(soft_weight) * F.col("_p")).otherwise(F.col("_y").cast("double"))
    # decimals: the sums do not depend on the order of partitions
    total = lambda c: F.sum(c.cast("decimal(20,6)")).cast("double")
    paths = written(own.groupBy("host", "path").agg(total(good).alias("good"), total(w).alias("n")), "site-paths")
    hosts = paths.groupBy("host").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    k_host = _strength(hosts.withColumn("m", F.lit(prior)))
    hosts = written(hosts.select("host", ((F.col("good") + k_host * prior) / (F.col("n") + k_host)).alias("m")), "site-hosts")
    joined = paths.join(hosts, "host")
    k_path = _strength(joined)
    return written(joined.select("host", "path", ((F.col("good") + k_path * F.col("m")) / (F.col("n") + k_path)).alias("rate")), "site-rates")


def score(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", soft_weight: float = 0.1) -> DataFrame:
    """``docs`` with the struct column ``_site_quality``: evidence, site_rate
    and quality, the posterior probability that the document is good.  All other
    columns stay as they are, whatever their names; one of that name is replaced.

    Without labels of both classes the evidence is 0 and the prior 0.5 or the
    one class's share with add-one smoothing.  A null or empty text is binned
    like any other; labels are matched by doc_id, a document labelled both ways
    counts as bad; repeated rows are scored each.
    """
    ready = prepared(docs, host, path)
    key = F.col("doc_id").cast("long")
    own = (labels.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min(F.col("quality").cast("int")).alias("_y"))
           .where("_y IN (0, 1)"))
    narrow = written(ready.select(key.alias("_id"), OWN).join(own, "_id", "left"), "site-labelled")
    labelled = narrow.where(F.col("_y").isNotNull())
    counts = {r["_y"]: r["count"] for r in labelled.groupBy("_y").count().collect()}
    prior = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    table = evidence_table(labelled) if len(counts) == 2 else {f: [0.0] * (len(c) + 1) for f, c in GRID.items()}
    prior_logit = math.log(prior / (1 - prior))
    p = F.round(_sigmoid(evidence(table) + prior_logit), 6)
    rates = site_rates(narrow.select(f"{OWN}.host", f"{OWN}.path", "_y", p.alias("_p")), prior, soft_weight)
    site = "_site"
    while site in ready.columns:  # no column of the documents may clash
        site += "_"
    rates = rates.select(F.struct("host", "path", "rate").alias(site))
    out = ready.join(rates, (F.col(f"{OWN}.host") == F.col(f"{site}.host")) & (F.col(f"{OWN}.path") == F.col(f"{site}.path")), "left")
    rate = F.least(F.greatest(F.col(f"{site}.rate"), F.lit(1e-6)), F.lit(1 - 1e-6))
    e = evidence(table)
    return out.withColumn(OWN, F.struct(F.col(f"{OWN}.host"), F.col(f"{OWN}.path"), e.alias("evidence"), F.col(f"{site}.rate").alias("site_rate"),
                                        _sigmoid(e + _logit(rate)).alias("quality"))).drop(site)
