"""Prompts and answer parsers by dataset: a small table that rows meet by their dataset.

Named places in braces are filled in one pass, so braces inside a value are text and
nothing is filled twice. Filling and parsing are Columns, without a shuffle while the
table is small enough to broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evoframe.functions.text import answer_json, answer_line, answer_marked, bind, reasoning_and_answer, strip
from evoframe.session import small_side

#: Parsers of an answer by name; ``split`` leaves it as splitting found it.
PARSERS = {"split": strip, "line": answer_line, "json": answer_json, "marked": answer_marked}
_PARTS = r"\{\w+\}|[^{]+|\{"
_FORMAT = "\nReply with your reasoning after <|think|> and the answer after <|answer|>."


@dataclass(frozen=True)
class Template:
    """A prompt, one for rows with knowledge, and the name of the answer's parser; places are {query} and {knowledge}."""

    plain: str = "Solve the problem step by step." + _FORMAT + "\n\n{query}"
    informed: str = "Solve the problem step by step with the help of the knowledge." + _FORMAT + "\n\n[Knowledge]\n{knowledge}\n\n[Problem]\n{query}"
    parser: str = "split"

    def __post_init__(self):
        if self.parser not in PARSERS:
            raise ValueError(f"unknown parser {self.parser!r}; known: {', '.join(sorted(PARSERS))}")
        for text, known in ((self.plain, {"query"}), (self.informed, {"query", "knowledge"})):
            unknown = set(re.findall(r"\{(\w+)\}", text)) - known
            if unknown or "{query}" not in text:
                raise ValueError(f"a prompt has the place {{query}} and no unknown ones; found: {', '.join(sorted(unknown)) or 'no query'}")


def templates_from(held: Mapping[str, Mapping]) -> dict[str | None, Template]:
    """From {dataset: {plain, informed, parser}}; the entry 'default' is for all other datasets."""
    return {None if name == "default" else name: Template(**entry) for name, entry in held.items()}


def described(templates: Mapping[str | None, Template]) -> dict:
    """What a run's identity holds of them."""
    return {name or "default": asdict(t) for name, t in templates.items()}


def filled(template: Column, values: Mapping[str, Column]) -> Column:
    """A template with its places filled by columns, null ones by nothing; null for a null template."""

    def part(p: Column) -> Column:
        out = p
        for name, value in values.items():
            out = F.when(p == f"{{{name}}}", F.coalesce(value, F.lit(""))).otherwise(out)
        return out

    return F.array_join(F.transform(F.regexp_extract_all(template, F.lit(_PARTS), F.lit(0)), part), "")


def with_templates(rows: DataFrame, templates: Mapping[str | None, Template], dataset: str = "dataset") -> DataFrame:
    """rows with ``template``, a struct of plain, informed and parser; null and unlisted datasets take the default one."""
    default = templates.get(None, Template())
    listed = [(name, t.plain, t.informed, t.parser) for name, t in templates.items() if name is not None]
    struct = "struct<plain: string, informed: string, parser: string>"
    own = F.struct(*[F.lit(x).alias(n) for n, x in asdict(default).items()])
    if not listed:
        return rows.withColumn("template", own)
    side = rows.sparkSession.createDataFrame(listed, "name string, plain string, informed string, parser string")
    side = side.select(F.col("name").alias("_name"), F.struct("plain", "informed", "parser").cast(struct).alias("template"))
    out = rows.drop("template").join(small_side(side, len(listed)), F.col(dataset) == F.col("_name"), "left")
    return out.withColumn("template", F.coalesce("template", own)).drop("_name")


def template_prompt(query: Column, knowledge: Column, informed: Column) -> Column:
    """The prompt of a row that has ``template``: the informed one where ``informed`` holds."""
    values = {"query": query, "knowledge": knowledge}
    return bind(F.when(informed, F.col("template.informed")).otherwise(F.col("template.plain")), lambda t: filled(t, values))


def template_answer(text: Column, parser: Column) -> Column:
    """The answer in a text by the parser that the row names; null for an unknown one."""

    def chosen(x: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, parse in PARSERS.items():
            out = F.when(parser == name, parse(x)).otherwise(out)
        return out

    return bind(text, chosen)


def template_reply(reply: Column, parser: Column) -> Column:
    """struct<reasoning,answer> of a reply: split as model output, the answer then read by the row's parser.

    Where splitting finds no answer, a parser but ``split`` reads the whole reply.
    """

    def parts(p: Column) -> Column:
        whole = (p["answer"] == "") & (parser != "split")
        return F.struct(p["reasoning"].alias("reasoning"), template_answer(F.when(whole, p["reasoning"]).otherwise(p["answer"]), parser).alias("answer"))

    return bind(reasoning_and_answer(reply), parts)
