"""Scalar functions against expectations written by hand."""

import pytest
from pyspark.sql import functions as F

from evoframe.functions import text as T
from evoframe.operators import evaluation as E


def values(spark, inputs, expression):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r.v for r in rows.select("i", expression(F.col("x")).alias("v")).orderBy("i").collect()]


@pytest.mark.parametrize("given, wanted", [
    ('{"Major Product": "CCO "}', "CCO"), ('{"Major Product": 5}', '{"Major Product": 5}'), ('{"x":1}', '{"x":1}'), ("42", "42"),
    ("answers 3", "s 3"), (None, ""), ("", ""), ("<|answer|> Answer:  4   2 ", "4 2"), ('{"Major Product": 1, "result": "b"}', "b"),
])
def test_clean_answer(spark, given, wanted):
    assert values(spark, [given], T.clean_answer) == [wanted]


@pytest.mark.parametrize("given, wanted", [
    ("<|think|> a <|answer|> b ", ("a", "b")), ("x\n\nThe answer is: 7 ", ("x", "7")), ("one\ntwo\n \n", ("one", "two")), ("only", ("only", "")), (None, ("", "")),
    ('so {"result": "R"} end', ("so", '{"result":"R"}')), ("p\n\nFINAL RESULT: q\nr", ("p", "q\nr")), ("<|answer|> b <|think|> a", ("", "b <|think|> a")),
])
def test_reasoning_and_answer(spark, given, wanted):
    assert tuple(values(spark, [given], T.reasoning_and_answer)[0]) == wanted


def test_marker_errors(spark):
    found = values(spark, ["a", "<|think|>a", "<|answer|>a<|think|>", "<|think|>a<|answer|>b"], lambda x: T.marker_parts(x)["error"])
    assert [f is not None for f in found] == [True, True, True, False]


def test_numbers_and_scores(spark):
    assert values(spark, ["10 and -3.50", "-2.5", "none", None, "7"], T.first_number) == [3.5, 2.5, None, None, 7.0]
    assert values(spark, ["4", "The score is 5", "3/5", "No score here", "0", "10", "99999999999", "-2"], T.judge_score) == [4, 5, 3, 3, 1, 5, 5, 2]
    assert values(spark, ["2/3", "1/0", "x", "3", None], T.ratio) == pytest.approx([2 / 3, 0, 0, 3, 0])


def test_length_score_bounds_are_inside(spark):
    texts = [" ".join(["w"] * n) for n in (9, 10, 100, 150)]
    assert values(spark, texts, lambda x: T.length_score(x, 10, 100)) == [0.0, 1.0, 1.0, 0.5]
    assert values(spark, [None, "", "a b c"], T.word_count) == [0, 0, 3]


def test_fitness(spark):
    assert values(spark, ["x"], lambda x: T.fitness(F.lit(True), F.lit(1.0), F.lit(5))) == pytest.approx([1.8])
    assert values(spark, ["x"], lambda x: T.fitness(F.lit(None).cast("boolean"), F.lit(1.0), F.lit(None).cast("int"))) == pytest.approx([0.3])


def test_exact_match(spark):
    assert values(spark, ["Answer: 42", "4 2", "43"], lambda x: T.exact_match(x, F.lit("42"))) == [True, False, False]
    assert values(spark, ["Answer: 42", "4 2", "43"], lambda x: T.exact_match(x, F.lit("42"), strict=False)) == [True, True, False]


def test_small_parsers(spark):
    assert values(spark, ["* a\n* b ", "none"], T.bullets) == ["a\nb", "none"]
    assert values(spark, ["none"], lambda x: T.bullets(x, fallback=False)) == [None]
    assert values(spark, ["abcdefghij"], lambda x: T.binding_point(x, F.lit("cd"))) == [2]
    assert values(spark, ["abcdefghij"], lambda x: T.binding_point(x, F.lit("zz"))) == [8]
    assert values(spark, ["r [RESULT_START] a [RESULT_END]", " b "], lambda x: T.marked_or_all(x, "RESULT")) == ["a", "b"]
    assert values(spark, ["Result: answer: 3", "The answer is 4"], T.without_prefix) == ["answer: 3", "4"]


@pytest.mark.parametrize("given, wanted", [("[0,1,2]", (True, 1.0)), ("(0,1)", (False, 2 / 3)), ("3", (False, 0.0)), ("(0)", (False, 1 / 3)), ("garbage", (False, 0.0)), ("[]", (False, 0.0)), ("[0, 1, 2,]", (True, 1.0))])
def test_ordering(spark, given, wanted):
    found = values(spark, [given], lambda x: E.ordering(x, F.array(F.lit(0), F.lit(1), F.lit(2))))[0]
    assert (found.exact_match, pytest.approx(found.accuracy)) == wanted
    assert (found.error is not None) == (given == "garbage")


def test_question_answer(spark):
    found = values(spark, ["Answer: a b", "x\na b c", "Answer: ", "a z"], lambda x: E.question_answer(x, F.lit("a b")))
    assert [f.exact_match for f in found] == [True, True, False, False]
    assert [f.accuracy for f in found] == pytest.approx([1.0, 0.9, 0.0, 1 / 3])
    assert tuple(values(spark, ["yes & 80"], E.confidence)[0]) == ("yes", 0.8)


def test_error_recognition(spark):
    found = values(spark, ["True", "it is false", "no", "none", "", "maybe"], lambda x: E.error_recognition(x, F.lit(True)))
    assert [f.exact_match for f in found] == [True, False, False, False, False, True]


def test_chemistry(spark):
    found = values(spark, ["100", "101", "102", "none"], lambda x: E.molecular_weight(x, F.lit("100")))
    assert [f.exact_match for f in found] == [True, True, False, False]
    found = values(spark, ["0", "1"], lambda x: E.property_value(x, F.lit("0")))
    assert [(f.exact_match, f.accuracy) for f in found] == [(True, 1.0), (False, 0.0)]
    assert values(spark, ["the product CCO and CC(=O)OC", "xyz zyx"], E.longest_structure)[0] == "CC(=O)OC"


def test_task_answer_reads_both_cases(spark):
    """'Answer:' counts as 'answer:' does, also where a further line follows."""
    from evoframe.operators.evaluation import task_answer

    frame = spark.createDataFrame([("Answer: x\nend",), ("answer: x\nend",), ("no form\nend",), ("[ANSWER_START] a [ANSWER_END] z",)], "t string")
    assert [r.a for r in frame.select(task_answer(F.col("t")).alias("a")).collect()] == ["x", "x", "end", "a"]


def test_seed_pairs_and_final_results(spark):
    from evoframe.functions import text as T

    frame = spark.createDataFrame([("<|think|> r <|answer|> a", "m"), ("<|think|><|answer|> a", None), ("why\n7", None)], "t string, m string")
    assert [tuple(r.p) for r in frame.select(T.seed_pair("t", "m").alias("p")).collect()] == [("r", "a", "m"), (None, None, None), ("why", "7", "unknown")]
    out = [r.f for r in spark.createDataFrame([('{"a":  1}',), ("7",), ("x",)], "t string").select(T.final_result("t").alias("f")).collect()]
    assert [x.split("\n")[-1] for x in out] == ['{"a":1}', "7", "x"]


def test_bleu_by_hand(spark):
    import math

    from evoframe.operators.evaluation import sentence_bleu

    frame = spark.createDataFrame([("the cat sat", "the cat sat"), ("the the the cat", "the cat is here now"), ("dog", "cat"), ("", "cat"), (None, "cat")], "p string, g string")
    got = [r.b for r in frame.select(sentence_bleu(F.col("p"), F.col("g")).alias("b")).collect()]
    assert got[0] == pytest.approx(1.0) and got[1] == pytest.approx(math.exp(1 - 5 / 4) * math.sqrt(2 / 4 * 1 / 3)) and got[2:] == [0.0, 0.0, None]


def test_time_is_linear_in_a_row(spark):
    """A hundred thousand blanks, and two texts of twenty thousand words, in seconds."""
    import time

    from evoframe.functions.text import reasoning_and_answer
    from evoframe.operators.evaluation import confidence, sentence_bleu

    blanks = " " * 100_000
    words = " ".join(f"w{i % 7000}" for i in range(20_000))
    frame = spark.createDataFrame([(f"So.\n\nAnswer: x{blanks}y", f"yes{blanks}& 80", f"yes{blanks}80", words, words[5:])], "a string, b string, c string, p string, g string")
    began = time.perf_counter()
    parsed, first, second, bleu = frame.select(reasoning_and_answer("a"), confidence(F.col("b")), confidence(F.col("c")), sentence_bleu(F.col("p"), F.col("g"))).first()
    assert time.perf_counter() - began < 30
    assert tuple(parsed) == ("So.", f"x{blanks}y") and tuple(first) == tuple(second) == ("yes", 0.8) and 0.99 < bleu <= 1
    odd = spark.createDataFrame([("r\n\nAnswer:   ",), ("r\n\nAnswer:",), ("r\n\nAnswer: a\n\n b \n",)], "t string")
    assert [tuple(r.p) for r in odd.select(reasoning_and_answer("t").alias("p")).collect()] == [("r", ""), ("r", ":"), ("r", "a\n\n b")]
