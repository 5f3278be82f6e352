"""Learned decision lists over text statistics, in DataFrame operations throughout.

Statistics of every whole text are columns. On labelled rows each is cut into buckets at its quantiles; one grouped
count per step gives the gain of every threshold, so a rule grows by the best one until it covers no good row, is cut
back to the conditions that hold up on rows kept aside, and its rows are taken away before the next rule grows. The
list becomes one conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import agreed_labels, learnable, part_of
from ebbtide.session import stage

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
REPEAT_PERCENT = 30

CUTS = 40
MAX_RULES, MAX_CONDITIONS = 12, 3
FEATURES = ["symbol_rate", "mean_word", "dup_line_rate", "repeat_rate", "upper_rate", "bang_rate", "distinct_rate", "n_words"]


def _without(text: str, characters: str) -> Column:
    """How many of the characters the text has."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_bang, n_distinct).

    Words are what ASCII white space leaves; NULL, empty and blank texts have zeros. A word counts as repeated if any
    window of eight words that holds it is found twice in the text; equal windows have equal 64-bit hashes.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("t"))
    rows = rows.withColumn("w", F.array_remove(F.split("t", SPACE), ""))
    lines = F.filter(F.split("t", "\n"), lambda line: line.rlike(WORD))
    rows = rows.select("id", "t", F.transform("w", lambda w: F.xxhash64(w)).alias("w"), lines.alias("lines"))
    windows = F.transform(F.sequence(F.lit(1), F.size("w") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("w", i, WINDOW)))
    rows = rows.select(
        "id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("t", SPACE, "")).cast("long").alias("word_chars"),
        _without("t", SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.length(F.regexp_replace("t", r"\P{Lu}+", "")).cast("long").alias("n_upper"),
        _without("t", "!").cast("long").alias("n_bang"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
        F.when(F.size("w") >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")).alias("h"),
    )
    placed = F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeats = F.size(F.array_distinct("h")) < F.size("h")
    rows = rows.withColumn("s", F.when(repeats, placed)).drop("h")

    def twin(item, k):
        before, after = F.get("s", k - 1)["h"], F.get("s", k + 1)["h"]
        return F.when((F.coalesce(before == item["h"], F.lit(False))) | F.coalesce(after == item["h"], F.lit(False)), item["i"])

    starts = F.sort_array(F.array_compact(F.transform("s", twin)))
    covered = F.aggregate(
        starts, F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    return rows.withColumn("n_repeat_words", F.coalesce(F.when(F.col("s").isNotNull(), covered), F.lit(0).cast("long"))).drop("s")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def rates(stats: DataFrame) -> DataFrame:
    """Adds the features; a rate of nothing is 0."""
    def rate(a, b):
        return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))

    return stats.withColumns({
        "symbol_rate": rate("n_symbols", "n_words"), "mean_word": rate("word_chars", "n_words"),
        "dup_line_rate": rate("n_dup_lines", "n_lines"), "repeat_rate": rate("n_repeat_words", "n_words"),
        "upper_rate": rate("n_upper", "word_chars"), "bang_rate": rate("n_bang", "n_words"),
        "distinct_rate": rate("n_distinct", "n_words"),
    })


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def column(self) -> Column:
        return F.col(self.feature) >= self.cut if self.above else F.col(self.feature) < self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.cut:.6g}"


def _all(conditions) -> Column:
    found = F.lit(True)
    for c in conditions:
        found = found & c.column()
    return found


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules; the first one that holds rejects, and a row that none covers is kept."""

    rules: tuple[tuple[Condition, ...], ...]

    def kept(self) -> Column:
        found = None
        for rule in self.rules:
            found = F.when(_all(rule), False) if found is None else found.when(_all(rule), False)
        return F.lit(True) if found is None else found.otherwise(True)

    def __str__(self) -> str:
        return "\n".join(["reject if " + " and ".join(map(str, r)) for r in self.rules] + ["else keep"])


def learn_rules(labelled: DataFrame, features: list[str], label: str = "label", grow: Column | None = None,
                prune: Column | None = None, max_rules: int = MAX_RULES) -> DecisionList:
    """Sequential covering of the rows with label 0 on a stage table of (label, features...).

    Rules grow on the rows of ``grow`` and are cut back and judged on those of ``prune``. Only numbers per feature,
    bucket and class reach the driver. Without rows of label 0 the list is empty.
    """
    grow = F.lit(True) if grow is None else grow
    prune = F.lit(True) if prune is None else prune
    steps = [i / CUTS for i in range(CUTS + 1)]
    marks = labelled.groupBy(label).agg(*[F.percentile_approx(f, steps, 10_000).alias(f) for f in features]).collect()
    cuts = {f: sorted({float(v) for row in marks for v in (row[f] or [])}) for f in features}
    # a value just above each mark, so that a cut can fall right behind it
    cuts = {f: sorted({*c, *((a + b) / 2 for a, b in zip(c, c[1:]))}) for f, c in cuts.items()}
    rules: list[tuple[Condition, ...]] = []
    while len(rules) < max_rules:
        left = DecisionList(tuple(rules)).kept()
        rule = _grown(labelled.where(grow & left), features, label, cuts)
        rule = _pruned(labelled.where(prune & left), rule, label) if rule else ()
        if not rule:
            break
        rules.append(rule)
    return DecisionList(tuple(rules))


def _bucket(feature: str, cuts: list[float]) -> Column:
    """How many of the cuts a value reaches."""
    return F.size(F.filter(F.lit(cuts), lambda cut: cut <= F.col(feature)))


def _grown(rows: DataFrame, features: list[str], label: str, cuts: dict[str, list[float]]) -> tuple[Condition, ...]:
    rule: tuple[Condition, ...] = ()
    while len(rule) < MAX_CONDITIONS:
        cells = F.array(*[
            F.struct(F.lit(f).alias("f"), _bucket(f, cuts[f]).alias("b")) for f in features
        ])
        counted = rows.where(_all(rule)).select(label, F.inline(cells)).groupBy("f", "b").agg(
            F.count_if(F.col(label) == 0).alias("bad"), F.count_if(F.col(label) == 1).alias("good"))
        found = counted.collect()  # features x cuts rows
        bad, good = (sum(r[c] for r in found if r["f"] == features[0]) for c in ("bad", "good"))
        if not bad or not good:
            return rule if bad else ()
        best = max(_gains(found, features, cuts, bad, good), key=lambda g: (g[0], str(g[1])), default=(0.0, None))
        if best[0] <= 1e-9:
            return rule
        rule += (best[1],)
    return rule


def _gains(found, features, cuts, bad, good):
    """(gain, condition) of every threshold: bad rows covered times the bits by which their share rises."""
    before = math.log2(bad / (bad + good))
    for f in features:
        cells = {r["b"]: (r["bad"], r["good"]) for r in found if r["f"] == f}
        b, g = bad, good
        for k, cut in enumerate(cuts[f]):
            lost = cells.get(k, (0, 0))
            b, g = b - lost[0], g - lost[1]
            for above, p, n in ((True, b, g), (False, bad - b, good - g)):
                if p and (p, n) != (bad, good):
                    yield p * (math.log2(p / (p + n)) - before), Condition(f, above, cut)


def _pruned(rows: DataFrame, rule: tuple[Condition, ...], label: str) -> tuple[Condition, ...]:
    """The leading conditions that tell the classes apart best; nothing if they are wrong more often than right."""
    sums = []
    for i in range(1, len(rule) + 1):
        sums += [F.count_if(_all(rule[:i]) & (F.col(label) == y)).alias(f"n{y}_{i}") for y in (0, 1)]
    n = rows.agg(*sums).first()
    worth = []
    for i in range(1, len(rule) + 1):
        p, q = n[f"n0_{i}"], n[f"n1_{i}"]
        if p > q:
            worth.append(((p - q) / (p + q), -i))
    return rule[: -max(worth)[1]] if worth else ()


def judge(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of every row.

    Rules are learnt from labelled rows that are not held out: rows of part 0 grow them, the others prune them. NULL
    and empty texts fail the base. A NULL id is judged but never learnt from; repeated rows are judged each; several
    labels of a document are put to the vote; without labels only the base rejects. Other columns are not read.
    """
    stats = stage(rates(text_statistics(docs, id_col, text_col)), "statistics")
    rules = learn_from_labels(stats, labels, label)
    verdict = ~base_failed() & rules.kept()
    return stats.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), verdict.alias("kept"),
    )


def learn_from_labels(stats: DataFrame, labels: DataFrame, label: str = "quality") -> DecisionList:
    known = agreed_labels(labels, label)
    rows = stats.where(~base_failed()).join(known, stats["id"] == known["doc_id"]).where(learnable("doc_id"))
    rows = stage(rows.select("label", part_of("doc_id").alias("part"), *FEATURES), "labelled")
    return learn_rules(rows, FEATURES, grow=F.col("part") == 0, prune=F.col("part") == 2)
