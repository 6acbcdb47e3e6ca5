"""Quality rules: text statistics and a learned decision list, all in Spark expressions.

Sequential covering in the manner of IREP and RIPPER (Cohen, "Fast effective rule
induction", 1995): a rule is a conjunction of thresholds on statistics, grown by
information gain on two thirds of the labelled rows and pruned on the rest; rows it
covers leave, and the next rule is learnt. The list becomes one ordered
``CASE WHEN`` over columns. The data side is DataFrame aggregation to a histogram
of a fixed number of bins; the driver only picks the best cut of that histogram.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evoframe.llm.common import SPACES, id_text
from evoframe.session import cut

#: Documented bound of the labelled sample the list is learnt from (met in expectation).
SAMPLE_ROWS = 20_000
#: Partitions of the sample; the statistics are joined where they lie and only its rows move.
SAMPLE_PARTS = 8
CUTS = 32
MAX_RULES = 8
MAX_TERMS = 3
MIN_PRECISION = 0.9
MIN_COVERED = 3
MIN_WORDS = 50
_SYMBOLS = "#*$%&|<>"
_SPACE_CLASS = "[ \\t-\\r]+"


def bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once a row, however often the body uses it."""
    return F.transform(F.array(value), body).getItem(0)


def repeated_words(words: Column, window: int = 3) -> Column:
    """How many words of an array lie in a window of ``window`` words that occurs twice or more in it.

    Windows are compared by 64-bit hashes. Texts without a repeat only build a hash set;
    others sort (hash, position), take the positions whose neighbour has the same hash,
    and add up the widths the windows cover from each to the next.
    """

    def covered(positions: Column) -> Column:
        gaps = F.transform(positions, lambda p, k: F.least(F.lit(window), F.coalesce(F.get(positions, k + 1) - p, F.lit(window))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

    def repeats(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        found = bind(pairs, lambda s: F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"])))
        return bind(F.sort_array(F.transform(found, lambda x: x["i"])), covered)

    def hashed(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - window)
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(window)]))

    counted = bind(hashed(words), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(repeats(h)))
    return F.when(F.size(words) >= window, counted).otherwise(F.lit(0).cast("long"))


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts rules are made of, one row per document, from whole texts."""
    t = F.col("text")
    without = lambda chars: F.length(F.translate(t, chars, ""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.trim(x, F.lit(SPACES)) != "")
    dup = bind(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    rows = id_text(docs).withColumn("_core", F.trim(t, F.lit(SPACES)))
    words = F.when(F.col("_core") == "", F.array().cast("array<string>")).otherwise(F.split("_core", _SPACE_CLASS, -1))
    counted = bind(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("repeat")))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    rows = rows.select(
        "doc_id",
        counted.alias("_w"),
        without(SPACES).cast("long").alias("word_chars"),
        (F.length(t) - without(_SYMBOLS)).cast("long").alias("n_symbols"),
        dup.alias("_l"),
        (F.length(t) - without(upper)).cast("long").alias("n_upper"),
        (F.length(t) - without("!?")).cast("long").alias("n_marks"),
        (F.length(t) - without("0123456789")).cast("long").alias("n_digits"),
    )
    return rows.select("doc_id", F.col("_w.n").alias("n_words"), "word_chars", "n_symbols", F.col("_l.dup").alias("n_dup_lines"), F.col("_w.repeat").alias("n_repeat_words"), F.col("_l.n").alias("n_lines"), "n_upper", "n_marks", "n_digits")


def features() -> dict[str, Column]:
    """What rules may test: sizes and ratios of the statistics, 0 where a ratio has no base."""
    per = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)).cast("double")
    return {
        "n_words": F.col("n_words").cast("double"),
        "chars_per_word": per("word_chars", "n_words"),
        "symbols_per_word": per("n_symbols", "n_words"),
        "dup_line_share": per("n_dup_lines", "n_lines"),
        "repeat_share": per("n_repeat_words", "n_words"),
        "words_per_line": per("n_words", "n_lines"),
        "upper_share": per("n_upper", "word_chars"),
        "marks_per_word": per("n_marks", "n_words"),
        "digit_share": per("n_digits", "word_chars"),
    }


@dataclass(frozen=True)
class Term:
    feature: str
    above: bool
    cut: float

    def column(self) -> Column:
        value = features()[self.feature]
        return value > F.lit(self.cut) if self.above else value <= F.lit(self.cut)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:g}"


@dataclass(frozen=True)
class Rule:
    """Documents that meet every term are rejected."""

    terms: tuple[Term, ...]

    def column(self) -> Column:
        out = F.lit(True)
        for term in self.terms:
            out = out & term.column()
        return out

    def __str__(self) -> str:
        return " AND ".join(map(str, self.terms))


def verdict(rules: list[Rule]) -> Column:
    """The decision list as one ordered conditional: the first rule met rejects, none keeps."""
    out = None
    for rule in rules:
        out = F.when(rule.column(), F.lit(False)) if out is None else out.when(rule.column(), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def _histogram(rows: DataFrame, cuts: dict[str, list[float]]) -> dict[str, list[list[float]]]:
    """Good rows, bad rows, least and largest value by feature and bin; bin k holds values above k of the cuts."""

    def bin_of(at: list[float], value: Column) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, at)), lambda c: c < value))

    value = features()
    binned = [F.struct(F.lit(name).alias("feature"), bin_of(at, value[name]).alias("bin"), value[name].alias("value")) for name, at in cuts.items() if at]
    if not binned:
        return {}
    counts = rows.select("bad", F.explode(F.array(*binned)).alias("b")).groupBy("b.feature", "b.bin").agg(F.sum("bad").alias("bad"), F.count("*").alias("n"), F.min("b.value").alias("low"), F.max("b.value").alias("high"))
    out = {name: [[0, 0, math.inf, -math.inf] for _ in range(len(at) + 1)] for name, at in cuts.items()}
    for r in counts.collect():  # features times cuts, whatever the data
        out[r.feature][r.bin] = [r.n - r.bad, r.bad, r.low, r.high]
    return out


def _best_term(hist: dict[str, list[list[float]]]) -> tuple[Term, int, int] | None:
    """The term of the largest FOIL gain over the rows of a histogram, with the good and bad rows it keeps.

    Its threshold lies halfway between the values on either side of the cut.
    """
    best, found = 1e-9, None
    for name, bins in hist.items():
        good, bad = sum(b[0] for b in bins), sum(b[1] for b in bins)
        if not bad or not good:
            continue
        base = math.log2(bad / (good + bad))
        g = b = 0
        for k in range(len(bins) - 1):
            g, b = g + bins[k][0], b + bins[k][1]
            low, high = max(x[3] for x in bins[: k + 1]), min(x[2] for x in bins[k + 1 :])
            if not math.isfinite(low) or not math.isfinite(high):
                continue
            for above, p, n in ((False, b, g), (True, bad - b, good - g)):
                gain = p * (math.log2(p / (p + n)) - base) if p else 0
                if gain > best:
                    best, found = gain, (Term(name, above, (low + high) / 2), n, p)
    return found


def learn(statistics: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, max_rules: int = MAX_RULES, max_terms: int = MAX_TERMS) -> list[Rule]:
    """An ordered list of rejection rules from ``labels(doc_id, quality)``; quality 0 is bad.

    The sample is a hash range of labelled ids expected to hold ``sample_rows`` at most.
    A document labelled twice has its lowest quality; null labels count as none. Without
    bad or good rows the list is empty. A rule is kept if on the pruning rows it is right
    in MIN_PRECISION of what it covers; the first that isn't ends the list.
    """
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") == 0).cast("int").alias("bad"))
    n = known.count()
    if not n:
        return []
    spread = F.pmod(F.xxhash64(F.lit(77), "doc_id"), F.lit(1 << 30))
    known = known.where(spread < int(min(1.0, sample_rows / n) * (1 << 30)))
    rows = cut(statistics.join(F.broadcast(known), "doc_id").withColumn("prune", F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(3)) == 0).repartition(SAMPLE_PARTS))
    rules: list[Rule] = []
    left = rows
    while len(rules) < max_rules:
        grow, prune = left.where("NOT prune"), left.where("prune")
        quantiles = grow.select(*[F.percentile_approx(v, [k / CUTS for k in range(1, CUTS)], 1000).alias(name) for name, v in features().items()]).first()
        if quantiles[0] is None:
            break
        high = grow.where("bad = 1").select(*[F.percentile_approx(v, [0.05, 0.25, 0.5, 0.75, 0.95], 1000).alias(name) for name, v in features().items()]).first()
        if high[0] is None:
            break
        cuts = {name: sorted({*quantiles[name], *high[name]}) for name in quantiles.asDict()}
        terms: list[Term] = []
        covered = grow
        while len(terms) < max_terms:
            found = _best_term(_histogram(covered, cuts))
            if found is None:
                break
            terms.append(found[0])
            covered = covered.where(found[0].column())
            if not found[1]:
                break
        if not terms:
            break
        prefixes = [Rule(tuple(terms[: k + 1])) for k in range(len(terms))]
        counts = prune.select(*[F.sum(F.when(p.column(), 1).otherwise(0)).alias(f"n{k}") for k, p in enumerate(prefixes)], *[F.sum(F.when(p.column(), F.col("bad")).otherwise(0)).alias(f"b{k}") for k, p in enumerate(prefixes)]).first()
        worth = []
        for k, rule in enumerate(prefixes):
            covers, bad = counts[f"n{k}"] or 0, counts[f"b{k}"] or 0
            if covers >= MIN_COVERED and bad >= MIN_PRECISION * covers:
                worth.append((2 * bad - covers, -k, rule))
        if not worth:
            break
        rules.append(max(worth, key=lambda x: x[:2])[2])
        left = left.where(~rules[-1].column())
    return rules


def base_failed(min_words: int = MIN_WORDS) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def apply_rules(statistics: DataFrame, rules: list[Rule], min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, the statistics, base_failed and kept, one row per document.

    Base: fewer than ``min_words`` words, or over half of the words in repeated 3-word
    windows. Null and empty texts have no words and fail. Repeated rows are judged each.
    """
    failed = base_failed(min_words)
    judged = statistics.withColumn("base_failed", failed).withColumn("kept", F.when(failed, F.lit(False)).otherwise(verdict(rules)))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics, a list learnt from the labels of rows that pass the base, and its verdict for every document.

    One row per document, as apply_rules() gives it. Null and empty texts have no words and
    fail the base. Repeated rows are judged each; learning counts each of them under its
    id's label. Other columns are ignored; no rows give no rows; no labels, no rules.
    """
    statistics = cut(text_statistics(docs))
    return apply_rules(statistics, learn(statistics.where(~base_failed()), labels))
