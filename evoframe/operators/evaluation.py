"""Task evaluators as Columns, and metrics over their results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evoframe.functions.text import bind, first_number, jaccard, last_line, strip, word_set

#: Answers that mean no where neither 'true' nor 'false' stands (fixed values).
NEGATIVE = ("no", "none", "0")


#: Ways an answer is announced, in order (fixed values).
ANSWER_MARKED = r"(?s)\[ANSWER_START\](.*?)\[ANSWER_END\]"
ANSWER_FORMS = (r"(?i)(?:Final )?answer:\s*(.*?)(?:\n|$)", r"(?i)answer\s+(?:is\s+)?:\s*(.*?)(?:\n|$)")


def task_answer(text: Column) -> Column:
    """The answer in a reply: between answer markers, after 'answer:', after 'answer is:', else the last line with text.

    'Answer' counts with a capital as well.
    """

    def parts(t: Column) -> Column:
        ways = [F.when(t.contains("[ANSWER_START]") & t.rlike(ANSWER_MARKED), strip(F.regexp_extract(t, ANSWER_MARKED, 1)))]
        ways += [F.when(t.rlike(form), strip(F.regexp_extract(t, form, 1))) for form in ANSWER_FORMS]
        return F.coalesce(*ways, strip(last_line(t)), F.lit(""))

    return bind(text, parts)


def _result(exact: Column, accuracy: Column) -> Column:
    return F.struct(exact.cast("boolean").alias("exact_match"), accuracy.cast("double").alias("accuracy"))


def error_recognition(prediction: Column, truth: Column) -> Column:
    """struct<exact_match,accuracy> of a yes-or-no reply against a boolean."""

    def judged(answer: Column) -> Column:
        said = F.when(answer.contains("true"), True).when(answer.contains("false"), False).otherwise((answer != "") & ~answer.isin(*NEGATIVE))
        return _result(said == truth, F.when(said == truth, 1.0).otherwise(0.0))

    return bind(F.lower(task_answer(prediction)), judged)


def question_answer(prediction: Column, truth: Column) -> Column:
    """struct<exact_match,accuracy>: equal 1, contained 0.9, else word overlap, which is exact above 0.8."""

    def judged(x: Column) -> Column:
        said, true = x["said"], x["true"]
        return bind(_overlap(word_set(true), word_set(said)), lambda o: _result((said == true) | said.contains(true) | (o > 0.8), F.when(said == true, 1.0).when(said.contains(true), 0.9).otherwise(o)))

    return bind(F.struct(F.lower(task_answer(prediction)).alias("said"), F.lower(strip(truth)).alias("true")), judged)


def _overlap(a: Column, b: Column) -> Column:
    """The Jaccard index of two word sets, 0 if one is empty."""
    return bind(F.struct(a.alias("a"), b.alias("b")), lambda x: F.when((F.size(x["a"]) > 0) & (F.size(x["b"]) > 0), jaccard(x["a"], x["b"])).otherwise(0.0))


def confidence(answer: Column) -> Column:
    """struct<answer,confidence>: 'text & 80' and 'text 80' give 0.8; other answers none."""
    forms = [r"(?s)^(.*?)&\s*(\d+)", r"(?s)^(.*\s)(\d+)$"]  # white space before either is stripped from the answer

    def parts(t: Column) -> Column:
        form = lambda p: F.when(t.rlike(p), F.struct(strip(F.regexp_extract(t, p, 1)).alias("answer"), (F.regexp_extract(t, p, 2).try_cast("double") / 100).alias("confidence")))
        return F.coalesce(*map(form, forms), F.struct(t.alias("answer"), F.lit(None).cast("double").alias("confidence")))

    return bind(strip(answer), parts)


def ordering(prediction: Column, correct: Column, wrong: Column | None = None) -> Column:
    """struct<exact_match,accuracy,error> of a list of indices; brackets, parentheses or a single number.

    With ``wrong`` a permutation of the positions is mapped through it first. Accuracy is the
    share of right positions. Anything else than whole numbers is an error with accuracy 0.
    """
    answer = strip(task_answer(prediction))
    body = F.regexp_replace(F.regexp_replace(answer, r"^[\[(]\s*|\s*,?\s*[\])]$", ""), r"\s+", "")
    parses = answer.rlike(r"^(\[\s*(-?\d+\s*(,\s*-?\d+\s*)*,?)?\s*\]|\(\s*(-?\d+\s*,\s*(-?\d+\s*(,\s*-?\d+\s*)*,?)?)?\s*\)|\(?\s*-?\d+\s*\)?)$")
    said = F.when(parses, F.transform(F.filter(F.split(body, ","), lambda x: x != ""), lambda x: x.cast("int")))
    if wrong is not None:
        positions = F.when(F.size(correct) > 0, F.sequence(F.lit(0), F.size(correct) - 1)).otherwise(F.array().cast("array<int>"))
        same = (F.size(wrong) > 0) & (F.array_sort(F.array_distinct(said)) == positions)
        said = F.when(same, F.transform(said, lambda i: F.get(wrong, i))).otherwise(said)
    hits = F.size(F.filter(F.arrays_zip(said.alias("s"), F.slice(correct, 1, F.greatest(F.size(said), F.lit(1))).alias("c")), lambda z: z["s"] == z["c"]))
    equal = said == correct
    share = F.when(equal, 1.0).otherwise(F.coalesce(F.try_divide(hits.cast("double"), F.size(correct)), F.lit(0.0)))
    ok = said.isNotNull()
    return F.struct(F.coalesce(equal, F.lit(False)).alias("exact_match"), F.when(ok, share).otherwise(0.0).alias("accuracy"), F.when(~ok, F.lit("not an ordering")).alias("error"))


def generation_overlap(prediction: Column, truth: Column) -> Column:
    """Overlap score of generated text: 1 for equal texts, else the Jaccard index of their words."""
    both = F.struct(F.lower(strip(prediction)).alias("a"), F.lower(strip(truth)).alias("b"))
    return bind(both, lambda x: F.when(x["a"] == x["b"], 1.0).otherwise(_overlap(_words(x["a"]), _words(x["b"]))))


def _words(lowered: Column) -> Column:
    return F.array_distinct(F.filter(F.split(lowered, r"(?U)\s+"), lambda w: w != ""))


def _tokens(text: Column) -> Column:
    """Lower-case words and single marks of punctuation, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\w+|[^\w\s])"), F.lit(1))


def _numbered(words: Column) -> Column:
    """Words, from the second occurrence on with its number behind them, so that sets of them meet as often as the words do."""

    def runs(s: Column) -> Column:
        begins = F.filter(F.transform(s, lambda w, i: F.when((i == 0) | (w != F.get(s, i - 1)), i)), lambda i: i.isNotNull())
        return bind(F.struct(s.alias("sorted"), begins.alias("begins")), counted)

    def counted(x: Column) -> Column:
        run = lambda b, k: F.slice(x["sorted"], b + 1, F.coalesce(F.get(x["begins"], k + 1), F.size(x["sorted"])) - b)
        return F.flatten(F.transform(x["begins"], lambda b, k: F.transform(run(b, k), lambda w, j: F.when(j == 0, w).otherwise(F.concat(w, F.lit("\n"), j.cast("string"))))))

    return bind(F.sort_array(words), runs)


def sentence_bleu(prediction: Column, truth: Column) -> Column:
    """BLEU of one reply against one truth over words and word pairs, equally weighted, with a brevity penalty.

    Clipped precisions; a precision without a hit counts as 0.1 hits, and 0 hits among
    single words give 0, as in the first smoothing of Chen and Cherry (2014). Tokens are
    words and marks of punctuation. Texts without tokens score 0, null gives null.
    """

    def followed(t: Column) -> Column:
        rest = F.greatest(F.size(t) - 1, F.lit(0))
        return F.zip_with(F.slice(t, F.lit(1), rest), F.slice(t, F.lit(2), rest), lambda a, b: F.concat(a, F.lit(" "), b))

    def counted(x: Column, grams) -> Column:
        clipped = lambda g: F.size(F.array_intersect(_numbered(g["p"]), _numbered(g["g"])))
        return bind(F.struct(grams(x["p"]).alias("p"), grams(x["g"]).alias("g")), lambda g: F.struct(clipped(g).alias("hits"), F.greatest(F.size(g["p"]), F.lit(1)).alias("of")))

    def scored(x: Column) -> Column:
        precision = lambda c: F.when(c["hits"] > 0, c["hits"]).otherwise(0.1) / c["of"]
        brevity = F.when(F.size(x["p"]) > F.size(x["g"]), 1.0).otherwise(F.exp(1 - F.size(x["g"]) / F.size(x["p"])))
        both = F.struct(counted(x, lambda t: t).alias("one"), counted(x, followed).alias("two"))
        return F.when(F.size(x["p"]) == 0, 0.0).otherwise(bind(both, lambda c: F.when(c["one"]["hits"] == 0, 0.0).otherwise(brevity * F.sqrt(precision(c["one"]) * precision(c["two"])))))

    return F.when(prediction.isNotNull() & truth.isNotNull(), bind(F.struct(_tokens(prediction).alias("p"), _tokens(truth).alias("g")), scored))


def generation(prediction: Column, truth: Column) -> Column:
    """struct<exact_match,accuracy> of generated text: equal once stripped, and its BLEU."""
    return _result(strip(prediction) == strip(truth), sentence_bleu(prediction, truth))


def _numbers(prediction: Column, truth: Column, body) -> Column:
    return bind(F.struct(first_number(prediction).alias("p"), truth.alias("g")), lambda x: body(x["p"], x["g"]))


def molecular_weight(prediction: Column, truth: Column, tolerance: float = 0.01) -> Column:
    """struct<exact_match,accuracy,error>: relative error within the tolerance, bound included."""

    def judged(p: Column, g: Column) -> Column:
        error = F.when(p.isNull(), "no number in the prediction").when(g.isNull(), "no number in the truth")
        off = F.when(g == 0, F.lit(float("inf"))).otherwise(F.try_divide(F.abs(p - g), g))
        return F.struct(F.when(error.isNull(), off <= tolerance).otherwise(False).alias("exact_match"), F.when(error.isNull(), F.greatest(F.lit(0.0), 1 - off)).otherwise(0.0).alias("accuracy"), error.alias("error"))

    return _numbers(prediction, F.coalesce(first_number(truth), truth.try_cast("double")), judged)


def property_value(prediction: Column, truth: Column) -> Column:
    """struct<exact_match,accuracy,error>: relative error below 5 percent; a truth of 0 asks for equality."""

    def judged(p: Column, g: Column) -> Column:
        error = F.when(p.isNull(), "no number in the prediction").when(g.isNull(), "no number in the truth")
        off = F.try_divide(F.abs(p - g), g)
        exact = F.when(g == 0, p == 0).otherwise(off < 0.05)
        share = F.when(g == 0, F.when(p == 0, 1.0).otherwise(0.0)).otherwise(F.greatest(F.lit(0.0), 1 - off))
        return F.struct(F.when(error.isNull(), exact).otherwise(False).alias("exact_match"), F.when(error.isNull(), share).otherwise(0.0).alias("accuracy"), error.alias("error"))

    return _numbers(prediction, first_number(truth), judged)


def general_chemistry(prediction: Column, truth: Column) -> Column:
    """struct<exact_match,accuracy>: by number where both have one, else equal 1, one within the other 0.8."""

    def judged(p: Column, g: Column) -> Column:
        a, b = F.lower(strip(prediction)), F.lower(strip(truth))
        off = F.try_divide(F.abs(p - g), F.abs(g))
        within = a.contains(b) | b.contains(a)
        by_number = _result(F.when(g == 0, p == g).otherwise(off < 0.05), F.when(g == 0, F.when(p == g, 1.0).otherwise(0.0)).otherwise(F.greatest(F.lit(0.0), 1 - off)))
        by_text = _result((a == b) | within, F.when(a == b, 1.0).when(within, 0.8).otherwise(0.0))
        return F.when(p.isNotNull() & g.isNotNull(), by_number).otherwise(by_text)

    return _numbers(prediction, first_number(truth), judged)


def molecule_edit(prediction: Column, truth: Column, strict: bool = False) -> Column:
    """struct<valid,exact_match,accuracy,similarity>: the defined text forms of the checks without a molecule library.

    A structure is valid if it isn't empty; it is right if it equals the truth, in strict
    mode as written and else after trimming; similarity cannot be known and is 0.
    """
    said, true = strip(prediction), strip(truth)
    equal = (prediction == truth) if strict else (said == true)
    valid = F.coalesce(said != "", F.lit(False))
    exact = valid & F.coalesce(equal, F.lit(False))
    return F.struct(valid.alias("valid"), exact.alias("exact_match"), F.when(exact, 1.0).otherwise(0.0).alias("accuracy"), F.lit(0.0).alias("similarity"))


#: Symbols of atoms in line notation by the name of their group; rings and hydrogens cannot be counted in text (fixed values).
ATOMS = {"carbon": "C|c", "nitrogen": "N|n", "oxygen": "O|o", "fluorine": "F", "phosphorus": "P|p", "sulfur": "S|s", "chlorine": "Cl", "bromine": "Br", "iodine": "I", "boron": "B|b", "silicon": "Si", "selenium": "Se|se"}
#: One atom: two letters before one, as 'Cl' is no carbon (fixed pattern).
ATOM = "(Cl|Br|Si|Se|se|[BCNOPSFIbcnops])"


def group_count(structure: Column, group: str) -> Column:
    """Atoms of a named group in a line-notation structure; null for other groups and for null or empty structures."""
    if group not in ATOMS:
        return F.lit(None).cast("int")
    own = ATOMS[group].split("|")
    atoms = F.regexp_extract_all(structure, F.lit(ATOM), F.lit(1))
    return F.when(strip(structure) != "", F.size(F.filter(atoms, lambda a: a.isin(*own))))


def edit_check(source: Column, target: Column, added: str | None = None, removed: str | None = None) -> Column:
    """Whether an edit has one atom more of ``added`` and one less of ``removed``, as far as they are named.

    False where a group cannot be counted, and without a named group.
    """
    checks = [group_count(target, g) == group_count(source, g) + d for g, d in ((added, 1), (removed, -1)) if g is not None]
    met = F.lit(bool(checks))
    for check in checks:
        met = met & F.coalesce(check, F.lit(False))
    return met


def evaluated(task: Column, prediction: Column, truth: Column) -> Column:
    """struct<exact_match,accuracy,error> by task: ERR, PQA, ORD or GEN in any case; others are an error.

    ``truth`` is text: true or false for ERR, an object with correct_steps and wrong_steps
    for ORD.
    """
    kind = F.upper(task)
    steps = F.from_json(truth, "correct_steps array<int>, wrong_steps array<int>")
    both = lambda m: F.struct(m["exact_match"].alias("exact_match"), m["accuracy"].alias("accuracy"), F.lit(None).cast("string").alias("error"))
    correct = F.coalesce(steps["correct_steps"], F.array().cast("array<int>"))
    return (
        F.when(kind == "ERR", bind(error_recognition(prediction, truth.try_cast("boolean")), both))
        .when(kind == "PQA", bind(question_answer(prediction, truth), both))
        .when(kind == "ORD", F.when(F.size(steps["wrong_steps"]) > 0, ordering(prediction, correct, steps["wrong_steps"])).otherwise(ordering(prediction, correct)))
        .when(kind == "GEN", bind(generation(prediction, truth), both))
        .otherwise(F.struct(F.lit(False).alias("exact_match"), F.lit(0.0).alias("accuracy"), F.concat(F.lit("unknown task type: "), F.coalesce(kind, F.lit(""))).alias("error")))
    )


def evaluated_batch(predictions: DataFrame, truths: DataFrame, key: str = "id") -> DataFrame:
    """key, task, exact_match, accuracy, error of every prediction met with its truth by key; one without the other is an error row."""
    rows = predictions.select(key, "prediction").join(truths.select(key, "task", "truth"), key, "full")
    alone = F.when(F.col("task").isNull(), "no truth").when(F.col("prediction").isNull(), "no prediction")
    judged = rows.select(key, "task", alone.alias("_alone"), evaluated(F.col("task"), F.col("prediction"), F.col("truth")).alias("m"))
    return judged.select(key, "task", F.when(F.col("_alone").isNull(), F.col("m.exact_match")).otherwise(False).alias("exact_match"), F.when(F.col("_alone").isNull(), F.col("m.accuracy")).otherwise(0.0).alias("accuracy"), F.coalesce("_alone", "m.error").alias("error"))


def longest_structure(text: Column) -> Column:
    """The longest line-notation structure in a text, the first of equals; null without any."""
    # Fixed patterns: what counts as a structure in running text.
    forms = [r"([CNOcnoFfPSpsBbBr?Ii][A-Za-z0-9@+\-\[\]\(\)\\=#$]+)", r"([CNOcno].{0,100})"]

    def longest(form: str) -> Column:
        found = F.regexp_extract_all(text, F.lit(form), F.lit(1))
        pick = F.aggregate(found, F.lit(""), lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best))
        return F.nullif(pick, F.lit(""))

    return F.coalesce(*map(longest, forms))


def classification(results: DataFrame, predicted: str = "predicted", truth: str = "truth") -> DataFrame:
    """One row: n, accuracy, precision, recall, f1; the last three only for exactly two truth labels, of which true is positive."""
    p, g = F.col(predicted), F.col(truth)
    tp, fp, fn = F.count_if(p & g), F.count_if(p & ~g), F.count_if(~p & g)
    two = F.count_distinct(g) == 2
    rate = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    precision, recall = rate(tp, tp + fp), rate(tp, tp + fn)
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    only = lambda x, name: F.round(F.when(two, x).otherwise(0.0), 6).alias(name)
    return results.agg(F.count("*").alias("n"), F.round(rate(F.count_if(p == g), F.count("*")), 6).alias("accuracy"), only(precision, "precision"), only(recall, "recall"), only(f1, "f1"))


def kendall_tau_b(pairs: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """key, tau: Kendall's tau-b of the (x, y) rows of each key; null where one side has no spread.

    Rows with a null x or y don't count; keys with fewer than two others give no row.
    Discordant pairs are inversions of y in the order of x. Two ranks differ first in some
    bit, so each bit adds, for every rank without it, the earlier ranks that have it and
    share the higher bits: n log n rows and a running sum, which spills, instead of all pairs.
    """
    rows = pairs.select(F.col(key).alias("k"), F.col(x).alias("x"), F.col(y).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    tied = lambda *by: rows.groupBy("k", *by).agg(F.count("*").alias("t")).groupBy("k").agg(F.sum(F.col("t") * (F.col("t") - 1) / 2).alias("_".join(("ties", *by))))
    ranked = rows.select("k", "x", (F.dense_rank().over(Window.partitionBy("k").orderBy("y")) - 1).alias("rank"))
    ranked = ranked.withColumn("bits", F.length(F.bin(F.max("rank").over(Window.partitionBy("k")).cast("long"))))
    bits = ranked.withColumn("bit", F.explode(F.sequence(F.lit(0), F.col("bits") - 1)))
    set_, above = F.expr("shiftright(rank, bit) & 1"), F.expr("shiftright(rank, bit + 1)")
    bits = bits.select("k", "x", "rank", "bit", set_.alias("one"), above.alias("above"))
    earlier = Window.partitionBy("k", "bit", "above").orderBy("x", "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bits = bits.withColumn("before", F.sum("one").over(earlier))
    inverted = bits.groupBy("k").agg(F.sum(F.when(F.col("one") == 0, F.col("before")).otherwise(0)).alias("discordant"))
    sums = tied().join(tied("x"), "k").join(tied("y"), "k").join(tied("x", "y"), "k").join(inverted, "k").where("ties > 0")
    nx, ny = F.col("ties") - F.col("ties_x"), F.col("ties") - F.col("ties_y")
    concordant = nx - F.col("ties_y") + F.col("ties_x_y") - F.col("discordant")
    return sums.select(F.col("k").alias(key), F.round(F.try_divide(concordant - F.col("discordant"), F.sqrt(nx * ny)), 6).alias("tau"))


def mean_kendall_tau(pairs: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """One row: tau, the mean over keys with one; 0 without any."""
    return kendall_tau_b(pairs, key, x, y).agg(F.round(F.coalesce(F.avg("tau"), F.lit(0.0)), 6).alias("tau"))
