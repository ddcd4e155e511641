"""Quality rules as a learned decision list, DataFrame functions only (operator 7).

Statistics of every whole text are SQL expressions. The labelled rows are reduced to counts by cell
of a grid of quantile bins (at most bins ** features cells, whatever the input), and the list is
learnt from those counts: sequential covering grows a conjunction of thresholds by information gain
on two thirds of the labelled rows, prunes it on the other third, removes what it covers and goes on
while a rule still rejects `precision` or more low-quality rows of all it covers. The list comes out as one ordered CASE
expression over the statistics.

Results: one row per row of docs; a null text has no words and fails the base rules; without
labels of both kinds the list is empty and everything that passes the base rules is kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from sparkloom.util import Scratch

SPACE = "[\\x20\\x09-\\x0D]"
QUANTILES = [0.01, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 0.95, 0.98, 0.99]


def let(value: Column, body) -> Column:
    """Evaluate value once and use it in body."""
    return F.transform(F.array(value), body)[0]


def _repeated(hashes: Column) -> Column:
    """Words in 5-word windows that occur twice or more, from the word hashes."""
    windows = F.transform(F.sequence(F.lit(0), F.size(hashes) - 5), lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(5))))

    def places(s):
        return F.transform(F.filter(s, lambda e, j: (F.get(s, j - 1)["h"] == e["h"]) | (F.get(s, j + 1)["h"] == e["h"])), lambda e: e["i"])

    def covered(p):
        steps = F.transform(p, lambda x, j: F.least(F.lit(5), F.coalesce(F.get(p, j + 1), x + 5) - x))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def count(w):
        pairs = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(let(pairs, lambda s: let(F.sort_array(places(s)), covered)))

    return F.when(F.size(hashes) < 5, F.lit(0)).otherwise(let(windows, count))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), all long."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    words = F.filter(F.split("text", SPACE + "+"), lambda w: w != "")
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    w = base.select("doc_id", words.alias("words"), (F.size(F.split("text", "[#*$%&|<>]", -1)) - 1).alias("n_symbols"), let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"))
    return w.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long"),
        F.col("n_dup_lines").cast("long"),
        let(F.transform("words", lambda x: F.xxhash64(x)), _repeated).cast("long").alias("n_repeat_words"),
    )


def features() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return {"n_words": F.col("n_words").cast("double"), "word_length": F.col("word_chars") / n, "symbols_per_word": F.col("n_symbols") / n, "dup_lines": F.col("n_dup_lines").cast("double"), "repeated_share": F.col("n_repeat_words") / n}


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


class Literal:
    """feature >= threshold (up) or feature < threshold."""

    def __init__(self, feature: int, edge: int, up: bool):
        self.feature, self.edge, self.up = feature, edge, up

    def holds(self, cell: tuple) -> bool:
        return (cell[self.feature] > self.edge) == self.up  # bin b: b edges are at or below the value


def _totals(cells, rule):
    p = n = 0
    for cell, a, b in cells:
        if all(x.holds(cell) for x in rule):
            p, n = p + a, n + b
    return p, n


def learn(grow: list, prune: list, edges: list[list[float]], precision: float = 0.8, most_rules: int = 12, most_literals: int = 4, least: int = 5) -> list[list[Literal]]:
    """cells: (bins, low-quality rows, other rows). Rules reject."""
    rules = []
    literals = [Literal(f, e, up) for f, es in enumerate(edges) for e in range(len(es)) for up in (True, False)]
    while len(rules) < most_rules:
        rule, inside = [], grow
        while len(rule) < most_literals:
            p, n = sum(c[1] for c in inside), sum(c[2] for c in inside)
            if not p or not n:
                break
            before, best = math.log2(p / (p + n)), (0.0, None)
            for lit in literals:
                a = sum(c[1] for c in inside if lit.holds(c[0]))
                b = sum(c[2] for c in inside if lit.holds(c[0]))
                if a >= least and (gain := a * (math.log2(a / (a + b)) - before)) > best[0] + 1e-12:
                    best = (gain, lit)
            if best[1] is None:
                break
            rule.append(best[1])
            inside = [c for c in inside if best[1].holds(c[0])]
        if not rule:
            break

        def value(r):
            p, n = _totals(prune, r)
            return (p - n) / (p + n) if p + n else -1.0

        rule = max((rule[:i] for i in range(len(rule), 0, -1)), key=value)
        p, n = _totals(prune, rule)
        q, m = _totals(grow, rule)
        if p + q < least or p + q < precision * (p + q + n + m):
            break
        rules.append(rule)
        grow, prune = ([c for c in cells if not all(x.holds(c[0]) for x in rule)] for cells in (grow, prune))
    return rules


def to_column(rules: list[list[Literal]], edges: list[list[float]]) -> Column:
    """The ordered conditional expression: false at the first rule that holds, else true."""
    columns = list(features().values())
    out = F
    for rule in rules:
        cond = F.lit(True)
        for x in rule:
            t = F.lit(float(edges[x.feature][x.edge]))
            cond = cond & (columns[x.feature] >= t if x.up else columns[x.feature] < t)
        out = out.when(cond, F.lit(False))
    return out.otherwise(F.lit(True)) if rules else F.lit(True)


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", precision: float = 0.8) -> Column:
    y = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.min("y").alias("y"))
    # what the base rules reject anyway teaches nothing
    rows = stats.join(y, "doc_id").filter(~base_failed()).select("doc_id", "y", *(c.alias(n) for n, c in features().items()))
    names = list(features())
    q = rows.agg(*(F.percentile_approx(F.when(F.col("y") == k, F.col(n)), QUANTILES, 2000).alias(f"{n}_{k}") for n in names for k in (0, 1))).first()
    edges = []
    for n in names:  # quantiles of either class, thinned
        both = sorted({round(x, 9) for k in (0, 1) for x in (q[f"{n}_{k}"] or [])})
        edges.append(both[:: max(1, len(both) // 12)])
    if not all(edges):
        return F.lit(True)
    bin_of = lambda n, es: F.size(F.filter(F.array(*map(F.lit, es)), lambda e: e <= F.col(n))).alias(n)
    bins = [bin_of(n, es) for n, es in zip(names, edges, strict=True)]
    counts = rows.select(*bins, "y", (F.crc32(F.col("doc_id").cast("string")) % 3).alias("fold")).groupBy(*names).agg(*(F.count_if((F.col("y") == k) & (F.col("fold") == 0 if part else F.col("fold") != 0)).alias(f"c{k}{part}") for k in (0, 1) for part in (0, 1)))
    cells = [(tuple(r[n] for n in names), r.c00, r.c10, r.c01, r.c11) for r in counts.collect()]
    cells.sort()
    return to_column(learn([(c, a, b) for c, a, b, _, _ in cells if a + b], [(c, a, b) for c, _, _, a, b in cells if a + b], edges, precision), edges)


def quality(docs: DataFrame, labels: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", precision: float = 0.8) -> DataFrame:
    """Statistics, base_failed and kept for every row of docs."""
    stats = scratch.keep(statistics(docs, id_col, text_col))
    verdict = fit(stats, labels, id_col, precision=precision)
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~base_failed() & verdict)
