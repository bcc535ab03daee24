"""Quality rules: learned decision lists over text statistics.

Statistics come from Spark expressions, one row per document.  Rules are learned from labelled
documents by sequential covering: a conjunction of thresholds is grown on two thirds of the rows that no earlier
rule covers (each step takes the threshold with the best FOIL gain), pruned on the other third (conditions
are dropped from the end while that raises (p - n) / (p + n)), and kept if it is precise enough there.  What
it covers is taken out and the next rule is grown, until none is precise.  All counting is done
by Spark over binned statistics; the driver sees only counts per statistic and bin.  The list becomes one ordered
CASE expression.

The rows for learning are at most about ``FIT_ROWS`` labelled documents, chosen by a hash of their id.

Edge cases: null text has no words, all counts 0; labels that are null are ignored, an id labelled twice is low
quality if any label says so; without labelled rows of both kinds the list is empty and nothing is rejected by it;
repeated rows are separate rows with equal results.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codedelta.llm.common import SPACE_CLASS, let, non_empty, read_table, write_table

FIT_ROWS = 30000
BINS = 32
LEAST_PRECISION = 0.97
#: Of the low-quality rows for pruning, a rule must find at least this part and number.
LEAST_PART = 0.005
LEAST_FOUND = 3
MOST_DUPLICATES = 32
MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"
GRAM = 3

#: Learned statistics: name, expression over the counts.
RATIOS = {
    "symbols_per_word": "n_symbols / n_words",
    "marks_per_word": "n_marks / n_words",
    "capital_pairs_per_word": "n_capital_pairs / n_words",
    "duplicate_line_part": "n_dup_lines / n_lines",
    "repeat_word_part": "n_repeat_words / n_words",
    "distinct_word_part": "n_distinct / n_words",
    "mean_word_chars": "word_chars / n_words",
    "n_words": "n_words",
}


def _range(first: Column, last: Column) -> Column:
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def repeated_words(hashes: Column, gram: int = GRAM) -> Column:
    """Number of words inside windows of ``gram`` words that occur twice or more in the text.

    Windows that occur again are found by sorting their hashes.  Where there are few kinds of them, their
    places are found by looking each window up among these; where there are many, by sorting windows with
    their places, so that the work stays n log n for any text."""
    def grams(h: Column) -> Column:
        n = F.size(h)
        out = h
        for step in range(1, gram):
            out = F.zip_with(out, F.slice(h, step + 1, F.greatest(n, F.lit(1))), lambda x, y: F.xxhash64(x, y))
        return F.slice(out, 1, F.greatest(n - (gram - 1), F.lit(0)))

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
        return F.aggregate(places, start, lambda acc, i: F.struct(
            (acc["n"] + i + gram - F.greatest(acc["to"], i)).alias("n"), (i + gram).alias("to")))["n"]

    def by_lookup(g: Column, again: Column) -> Column:
        marked = F.transform(g, lambda x, i: F.when(F.array_contains(again, x), i).otherwise(F.lit(-1)))
        return F.filter(marked, lambda i: i >= 0)

    def by_sorting(g: Column) -> Column:
        pairs = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        return let(pairs, lambda p: F.sort_array(F.transform(F.filter(
            F.transform(p, lambda v, k: F.struct(v["i"].alias("i"), (
                ((k > 0) & (F.get(p, k - 1)["x"] == v["x"])) | F.coalesce(F.get(p, k + 1)["x"] == v["x"], F.lit(False))).alias("twin"))),
            lambda v: v["twin"]), lambda v: v["i"])))

    def count(g: Column) -> Column:
        def inner(s: Column) -> Column:
            again = F.array_distinct(F.filter(s, lambda x, k: F.coalesce(F.get(s, k + 1) == x, F.lit(False))))
            return let(again, lambda a: F.when(F.size(a) == 0, F.lit(0)).when(
                F.size(a) <= MOST_DUPLICATES, covered(by_lookup(g, a))).otherwise(covered(by_sorting(g))))
        return let(F.sort_array(g), inner)

    return let(hashes, lambda h: let(grams(h), count))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of each document row."""
    text = F.coalesce("text", F.lit(""))
    lost = lambda chars: (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")
    d = docs.select("doc_id", text.alias("text"), F.transform(
        non_empty(F.split(text, SPACE_CLASS + "+")), lambda w: F.xxhash64(w)).alias("h"))
    # A line has a word if anything but white space is in it.
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0)
    text = F.col("text")
    d = d.select("doc_id", F.size("h").cast("long").alias("n_words"), F.size(F.array_distinct("h")).cast("long").alias("n_distinct"),
                 F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
                 lost(SYMBOLS).alias("n_symbols"), lost("!").alias("n_marks"),
                 F.regexp_count(text, F.lit("[A-Z]{2}")).cast("long").alias("n_capital_pairs"),
                 let(lines, lambda x: F.struct(F.size(x).alias("all"), F.size(F.array_distinct(x)).alias("kinds"))).alias("lines"),
                 repeated_words(F.col("h")).cast("long").alias("n_repeat_words"))
    return d.select("doc_id", "n_words", "n_distinct", "word_chars", "n_symbols", "n_marks", "n_capital_pairs",
                    F.col("lines.all").cast("long").alias("n_lines"), (F.col("lines.all") - F.col("lines.kinds")).cast("long").alias("n_dup_lines"),
                    "n_repeat_words")


def ratio(name: str) -> Column:
    """A learned statistic; 0 where its divisor is."""
    top, _, under = RATIOS[name].partition(" / ")
    return F.col(top).cast("double") if not under else F.when(F.col(under) > 0, F.col(top) / F.col(under)).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool          # statistic > threshold, or else <=
    threshold: float

    def column(self) -> Column:
        return ratio(self.name) > self.threshold if self.above else ratio(self.name) <= self.threshold


@dataclass
class DecisionList:
    """Ordered rules; a document that a rule covers is rejected, the others are kept."""

    rules: list[tuple[Condition, ...]] = field(default_factory=list)

    def rule(self) -> Column:
        """Number of the first rule that covers a document, 0 for none."""
        out = None
        for number, conditions in enumerate(self.rules, 1):
            test = F.lit(True)
            for c in conditions:
                test = test & c.column()
            out = F.when(test, number) if out is None else out.when(test, number)
        return F.lit(0) if out is None else out.otherwise(0)


def _histogram(rows: DataFrame, names: list[str], part: Column) -> dict:
    """{(name, bin): (low, good)} of the rows of a part, counted by Spark."""
    bins = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"b_{n}").alias("bin")) for n in names])).alias("v")
    counted = rows.filter(part).select("low", bins).groupBy("v.name", "v.bin").agg(
        F.count_if("low").alias("p"), F.count_if(~F.col("low")).alias("n"))
    return {(r["name"], r["bin"]): (r["p"], r["n"]) for r in counted.collect()}   # at most statistics x bins


def _best_condition(hist: dict, cuts: dict) -> tuple[float, Condition] | None:
    import math
    best = None
    for name, thresholds in cuts.items():
        total_p = sum(p for (k, _), (p, _) in hist.items() if k == name)
        total_n = sum(n for (k, _), (_, n) in hist.items() if k == name)
        if not total_p:
            return None
        now = math.log2(total_p / (total_p + total_n))
        p = n = 0
        for b, threshold in enumerate(thresholds):
            more = hist.get((name, b), (0, 0))
            p, n = p + more[0], n + more[1]
            for above, q, m in ((False, p, n), (True, total_p - p, total_n - n)):
                if q:
                    gain = q * (math.log2(q / (q + m)) - now)
                    if gain > 1e-9 and (best is None or gain > best[0]):
                        best = gain, Condition(name, above, threshold)
    return best


def learn(stats: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DecisionList:
    """Learn the list from statistics and labels (doc_id, quality)."""
    marks = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("_id")).agg((F.min("quality") == 0).alias("low"))
    marks = write_table(marks, "marks")
    share = min(1.0, fit_rows / max(1, marks.count()))
    chosen = F.pmod(F.xxhash64("_id", F.lit("fit")), F.lit(1 << 20)) < int(share * (1 << 20))
    rows = stats.join(marks.filter(chosen), F.col("doc_id") == F.col("_id"))
    names = list(RATIOS)
    rows = write_table(rows.select("doc_id", "low", *[ratio(n).alias(n) for n in names]), "labelled")
    steps = [i / BINS for i in range(1, BINS)]
    # The low rows get cuts of their own, since they are few.
    cut = rows.agg(*[F.percentile_approx(n, steps, 10000).alias(f"a_{n}") for n in names],
                   *[F.percentile_approx(F.when(F.col("low"), F.col(n)), steps, 10000).alias(f"l_{n}") for n in names]).first()
    cuts = {n: sorted({*(cut[f"a_{n}"] or []), *(cut[f"l_{n}"] or [])}) for n in names}
    cuts = {n: c for n, c in cuts.items() if c}
    found = DecisionList()
    if not cuts:
        return found
    def bin_of(name: str) -> Column:
        """Number of cuts below the value: bin b ends at cut b."""
        return F.size(F.filter(F.array(*[F.lit(x) for x in cuts[name]]), lambda x: x < F.col(name)))

    grow = (F.pmod(F.xxhash64("doc_id", F.lit("prune")), F.lit(3)) > 0).alias("grow")
    rows = write_table(rows.select("low", grow, *cuts, *[bin_of(n).alias(f"b_{n}") for n in cuts]), "binned")
    test = lambda c: F.col(c.name) > c.threshold if c.above else F.col(c.name) <= c.threshold
    low_prune = rows.agg(F.count_if(F.col("low") & ~F.col("grow"))).first()[0] or 0
    left = F.lit(True)
    # Every rule finds LEAST_FOUND low rows that no earlier one did, and every condition a gain: both loops end.
    while True:
        grown: list[Condition] = []
        inside = left & F.col("grow")
        while True:
            hist = _histogram(rows, list(cuts), inside)
            if grown and not any(n for _, n in hist.values()):
                break
            best = _best_condition(hist, cuts)
            if best is None:
                break
            grown.append(best[1])
            inside = inside & test(best[1])
        if not grown:
            break
        counts, inside = [], left & ~F.col("grow")
        for c in grown:
            inside = inside & test(c)
            counts += [F.count_if(inside & F.col("low")), F.count_if(inside & ~F.col("low"))]
        got = list(rows.agg(*counts).first())
        pairs = list(zip(got[::2], got[1::2]))
        worth = [(p - n) / (p + n) if p + n else -1.0 for p, n in pairs]
        keep = max(range(len(worth)), key=lambda i: (worth[i], -i))
        p, n = pairs[keep]
        if p < max(LEAST_FOUND, LEAST_PART * low_prune) or p < LEAST_PRECISION * (p + n):
            break
        found.rules.append(tuple(grown[:keep + 1]))
        covered = F.lit(True)
        for c in grown[:keep + 1]:
            covered = covered & test(c)
        left = left & ~covered
    return found


def judge(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The statistics of every document row with base_failed, rule (0: none) and kept."""
    stats = write_table(statistics(docs), "statistics")
    rules = learn(stats, labels, fit_rows)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = stats.withColumn("base_failed", failed).withColumn("rule", rules.rule())
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def query(spark, sf_dir: str) -> DataFrame:
    j = judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return j.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
