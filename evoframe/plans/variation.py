"""Knowledge, crossover and mutation as chains of prompts over whole tables.

Each step is one batch call over the rows that are still in it; a row whose step fails
is marked and sent no further. Prompts are Columns, so a step is a projection and one
Arrow stage, without a shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evoframe.functions.text import binding_point, bullets, marked_or_all, reasoning_and_answer
from evoframe.operators.retrieval import RELIABLE
from evoframe.sources.models import Generate, Registry, generated

#: Characters of a diagnosis that a row remembers (fixed value).
DIAGNOSIS_CHARS = 200
_FORMAT = "\nReply with your reasoning after <|think|> and the answer after <|answer|>."


def prompt(task: str, **parts: Column | str) -> Column:
    """A task followed by named sections, one after another; null sections are left out."""
    sections = [F.concat(F.lit(f"\n\n[{name.replace('_', ' ').capitalize()}]\n"), F.col(p) if isinstance(p, str) else p) for name, p in parts.items()]
    return F.concat(F.lit(task), *[F.coalesce(s, F.lit("")) for s in sections])


def judge_prompt(query: Column, reasoning: Column, knowledge: Column) -> Column:
    """Asks for one number from 1 to 5: how far the reasoning uses the knowledge; null without knowledge."""
    asked = prompt("Rate from 1 (not at all) to 5 (fully) how well the reasoning agrees with the reference knowledge. Reply with the number only.", problem=query, reference_knowledge=knowledge, reasoning=reasoning)
    return F.when(knowledge.isNotNull(), asked)


def asked(rows: DataFrame, ask: Column, into: str, generate: Generate | Registry) -> DataFrame:
    """rows with the replies to ``ask`` as ``into``; ``failed`` rows are sent nothing, rows without a reply fail."""
    sent = rows.withColumn("_ask", F.when(~F.col("failed"), ask))
    out = generated(sent, "_ask", generate, out=into, model="operator").drop("_ask")
    return out.withColumn("failed", F.col("failed") | F.col(into).isNull()).drop("error")


def _finished(rows: DataFrame, reply: str) -> DataFrame:
    """new_reasoning and new_answer from a reply; an empty reasoning is a failure."""
    out = rows.withColumn("_p", reasoning_and_answer(reply))
    out = out.withColumn("failed", F.col("failed") | (F.col("_p.reasoning") == ""))
    return out.withColumn("new_reasoning", F.col("_p.reasoning")).withColumn("new_answer", F.col("_p.answer")).drop("_p")


def crossover(rows: DataFrame, generate: Generate | Registry) -> DataFrame:
    """Four steps: the sentence to bind at in provider and target, what only the provider knows, the recombined reasoning.

    The target's reasoning is kept up to its binding point. A binding point at the very
    beginning fails. Adds new_reasoning, new_answer, target_bp, provider_bp, diagnosis.
    """
    locate = "Quote the sentence where the reasoning takes its decisive turn, between [SENTENCE_START] and [SENTENCE_END]."
    for side, text in (("provider", "other"), ("target", "reasoning")):
        rows = asked(rows, prompt(locate, problem="query", reasoning=text), "_reply", generate)
        rows = rows.withColumn(f"{side}_bp", binding_point(text, marked_or_all("_reply", "SENTENCE"))).drop("_reply")
        rows = rows.withColumn("failed", F.col("failed") | F.coalesce(F.col(f"{side}_bp") <= 0, F.lit(True)))
    rows = asked(rows, prompt("List as '* ' items what the second reasoning knows and the first does not.", problem="query", first="reasoning", second="other"), "_reply", generate)
    rows = rows.withColumn("_info", bullets("_reply")).drop("_reply")
    rows = rows.withColumn("failed", F.col("failed") | F.coalesce(F.col("_info") == "", F.lit(True)))
    prefix = F.expr("substring(reasoning, 1, target_bp)")
    rows = asked(rows, prompt("Continue the reasoning with the further information." + _FORMAT, problem="query", reasoning=prefix, information="_info"), "_reply", generate)
    return _finished(rows, "_reply").withColumn("diagnosis", F.lit(None).cast("string")).drop("_reply", "_info")


_DELETE = "Shorten the reasoning to the steps the answer needs." + _FORMAT


def _blank(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"target_bp": F.lit(None).cast("int"), "provider_bp": F.lit(None).cast("int"), "diagnosis": F.lit(None).cast("string")})


def add(rows: DataFrame, generate: Generate | Registry) -> DataFrame:
    """One step: the reasoning with more detail."""
    rows = asked(rows, prompt("Enrich the reasoning with details and domain knowledge." + _FORMAT, problem="query", reasoning="reasoning"), "_reply", generate)
    return _blank(_finished(rows, "_reply").drop("_reply"))


def delete(rows: DataFrame, generate: Generate | Registry) -> DataFrame:
    """One step: the reasoning without what is redundant."""
    rows = asked(rows, prompt(_DELETE, problem="query", reasoning="reasoning"), "_reply", generate)
    return _blank(_finished(rows, "_reply").drop("_reply"))


def innovate(rows: DataFrame, generate: Generate | Registry) -> DataFrame:
    """Three steps: a diagnosis against the truth, a reasoning that follows it, and its shortened form.

    The longer answer of the last two stays. A row that fails is shortened as it is instead.
    """
    rows = asked(rows, prompt("Name as '* ' items what is wrong with the reasoning and how to do better.", problem="query", reasoning="reasoning", answer="answer", correct_answer="truth"), "_reply", generate)
    rows = rows.withColumn("diagnosis", F.substring(bullets("_reply"), 1, DIAGNOSIS_CHARS)).withColumn("_advice", bullets("_reply")).drop("_reply")
    rows = asked(rows, prompt("Solve the problem anew, following the advice." + _FORMAT, problem="query", correct_answer="truth", reasoning="reasoning", advice="_advice"), "_reply", generate)
    rows = _finished(rows, "_reply").withColumnsRenamed({"new_reasoning": "_reasoning", "new_answer": "_answer"}).drop("_reply", "_advice")
    rows = asked(rows, prompt(_DELETE, problem="query", reasoning="_reasoning"), "_reply", generate)
    rows = _finished(rows, "_reply").drop("_reply")
    longer = F.length("_answer") > F.length("new_answer")
    rows = rows.withColumn("new_answer", F.when(longer, F.col("_answer")).otherwise(F.col("new_answer"))).drop("_reasoning", "_answer")
    # The other way for those that failed; the others are sent nothing.
    again = rows.withColumn("_done", ~F.col("failed")).withColumn("failed", F.col("_done"))
    again = asked(again, prompt(_DELETE, problem="query", reasoning="reasoning"), "_reply", generate)
    again = again.withColumn("_p", reasoning_and_answer("_reply")).withColumn("failed", ~F.col("_done") & (F.col("_reply").isNull() | (F.col("_p.reasoning") == "")))
    pick = lambda name, part: F.when(F.col("_done"), F.col(name)).otherwise(F.col(f"_p.{part}"))
    out = again.withColumn("new_reasoning", pick("new_reasoning", "reasoning")).withColumn("new_answer", pick("new_answer", "answer")).drop("_p", "_reply", "_done")
    return out.withColumns({"target_bp": F.lit(None).cast("int"), "provider_bp": F.lit(None).cast("int")})


STEPS = {"crossover": crossover, "mutation_add": add, "mutation_delete": delete, "mutation_innovate": innovate}


def varied(rows: DataFrame, generate: Generate | Registry) -> DataFrame:
    """rows, by ``generation_method``, with new_reasoning, new_answer, target_bp, provider_bp, diagnosis and failed.

    ``rows`` has query, truth, reasoning, answer, other (the provider's reasoning) and
    operator (the model's name).
    """
    started = rows.withColumn("failed", F.lit(False))
    parts = [steps(started.where(F.col("generation_method") == name), generate) for name, steps in STEPS.items()]
    return reduce(DataFrame.unionByName, parts)


def with_knowledge(samples: DataFrame, generate: Generate | Registry | None = None, found: DataFrame | None = None, threshold: float = RELIABLE) -> DataFrame:
    """samples whose null ``knowledge`` is filled once a sample: retrieved where reliable, else generated.

    ``found`` has id, rank, text and score of retrieved snippets. Retrieval is reliable if
    its first result reaches the threshold. A failed call leaves null. Without a source
    and with something to fill, it is an error.
    """
    if generate is None and found is None:
        raise ValueError("knowledge needs a retrieval result or a generator")
    rows = samples
    if found is not None:
        held = found.where("rank <= 3").groupBy(F.col("id").alias("_id")).agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("x"), F.min_by("score", "rank").alias("_score"))
        held = held.where(F.col("_score") >= threshold).select("_id", F.array_join(F.transform("x", lambda x: F.concat(x["rank"].cast("string"), F.lit(". "), x["text"])), "\n\n").alias("_held"))
        rows = rows.join(held, rows["id"] == held["_id"], "left").withColumn("knowledge", F.coalesce("knowledge", "_held")).drop("_id", "_held")
    if generate is None:
        return rows
    names = generate.names() if isinstance(generate, Registry) else []
    todo = rows.withColumn("failed", F.col("knowledge").isNotNull()).withColumn("operator", F.lit(names[0] if names else None).cast("string"))
    out = asked(todo, prompt("List as '* ' items the knowledge that leads to the answer, without stating it.", problem="query", answer="answer"), "_reply", generate)
    return out.withColumn("knowledge", F.coalesce("knowledge", bullets("_reply"))).select(*samples.columns)
