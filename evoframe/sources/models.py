"""Text generation, embedding and judging behind batch functions.

A provider maps a list of prompts to a list of texts; it runs in Arrow batches on the
executors and a failing prompt becomes a null with an error, never a failed job. The
offline providers are deterministic functions of the prompt, for tests and dry runs.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import time
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Generate = Callable[[list[str]], list[str]]
Embed = Callable[[list[str]], list[list[float]]]


def offline_generate(prompts: list[str]) -> list[str]:
    """A reply in the marker format, made of the prompt's own words and a number from its digest."""
    out = []
    for prompt in prompts:
        digest = hashlib.md5(prompt.encode()).hexdigest()
        words = prompt.split()
        start = int(digest[:4], 16) % max(1, len(words))
        out.append(f"<|think|>\n{' '.join(words[start : start + 40])} {digest[:6]}\n<|answer|>\n{int(digest[6:8], 16) % 10}")
    return out


def offline_embed(texts: list[str], size: int = 16) -> list[list[float]]:
    """Counts of hashed words, scaled to unit length."""
    out = []
    for text in texts:
        vector = [0.0] * size
        for word in text.split():
            vector[int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % size] += 1.0
        norm = sum(x * x for x in vector) ** 0.5 or 1.0
        out.append([x / norm for x in vector])
    return out


def generated(rows: DataFrame, prompt: str, generate: Generate | Registry, out: str = "output", model: str | None = None) -> DataFrame:
    """rows with the reply and an ``error``: each prompt is sent once, in batches; errors are data.

    Null prompts are not sent and give nulls. A registry sends each row to the generator
    that its ``model`` column names.
    """

    def replies_to(send: Generate, prompts: list[str]) -> tuple[list, list]:
        try:
            return list(send(prompts)), [None] * len(prompts)
        except Exception:  # one bad prompt must not cost the batch
            replies, errors = [], []
            for text in prompts:
                try:
                    replies.append(send([text])[0])
                    errors.append(None)
                except Exception as error:
                    replies.append(None)
                    errors.append(f"{type(error).__name__}: {error}")
            return replies, errors

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            replies, errors = (pd.Series([None] * len(frame), index=frame.index, dtype=object) for _ in range(2))
            sent = frame[frame[prompt].notna()]
            groups = sent.groupby(sent[model], dropna=False) if isinstance(generate, Registry) else [(None, sent)]
            for name, group in groups:
                if len(group):
                    send = (lambda texts, name=name: generate.get(name)(texts)) if isinstance(generate, Registry) else generate
                    found, failed = replies_to(send, group[prompt].tolist())
                    replies[group.index], errors[group.index] = pd.Series(found, index=group.index, dtype=object), pd.Series(failed, index=group.index, dtype=object)
            yield frame.assign(**{out: replies, "error": errors})

    from pyspark.sql.types import StringType, StructType

    schema = StructType([f for f in rows.schema.fields if f.name not in (out, "error")]).add(out, StringType()).add("error", StringType())
    return rows.drop(out, "error").mapInPandas(run, schema)


def embedded(rows: DataFrame, text: str, embed: Embed) -> DataFrame:
    """rows with ``embedding`` (array<float>) of a text column; a text whose call fails has a null one.

    Rows that have an embedding already keep it and are not sent.
    """
    from pyspark.sql.types import ArrayType, FloatType, StructType

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame[text].fillna("").tolist()
            try:
                found = list(embed(texts))
            except Exception:  # one bad text must not cost the batch
                found = []
                for t in texts:
                    try:
                        found.append(embed([t])[0])
                    except Exception:
                        found.append(None)
            yield frame.assign(embedding=pd.Series(found, index=frame.index, dtype=object))

    schema = StructType([f for f in rows.schema.fields if f.name != "embedding"]).add("embedding", ArrayType(FloatType()))
    if "embedding" not in rows.columns:
        return rows.mapInPandas(run, schema)
    missing = rows.where("embedding IS NULL").drop("embedding").mapInPandas(run, schema)
    return rows.where("embedding IS NOT NULL").unionByName(missing)


@dataclass
class Registry:
    """Named generators: thinkers, and an optional one that performs all variation."""

    thinkers: dict[str, Generate] = field(default_factory=dict)
    operator: str | None = None

    def register(self, name: str, generate: Generate) -> None:
        self.thinkers[name] = generate

    def get(self, name: str | None) -> Generate:
        if name not in self.thinkers:
            raise ValueError(f"unknown model {name!r}; known: {', '.join(self.names())}")
        return self.thinkers[name]

    def names(self) -> list[str]:
        return sorted(self.thinkers)

    def set_operator(self, name: str | None) -> None:
        """One generator for all variation; None leaves it to each row's own model."""
        if name is not None:
            self.get(name)
        self.operator = name

    def thinker_for(self, draw):
        """Column with a thinker drawn by a number in [0, 1)."""
        return F.element_at(F.array(*map(F.lit, self.names())), F.floor(draw * len(self.thinkers)).cast("int") + 1)

    def operator_for(self, source_model):
        """Column with the generator of a row: the global one, else its source model if known, else one by its hash."""
        names = self.names()
        if self.operator is not None:
            return F.lit(self.operator)
        spread = F.element_at(F.array(*map(F.lit, names)), F.pmod(F.xxhash64(source_model), F.lit(len(names))).cast("int") + 1)
        return F.when(source_model.isin(*names), source_model).otherwise(spread)

    @classmethod
    def from_mapping(cls, held: dict) -> Registry:
        """From {'thinkers': [{name, model, base_url, api_key, ...}], 'operator': name}; ``${X}`` is taken from the environment."""
        out = cls()
        for entry in held.get("thinkers", []):
            entry = {k: with_environment(v) for k, v in entry.items()}
            name = entry.pop("name")
            out.register(name, HttpGenerator(**({"model": name} | entry)))
        out.set_operator(held.get("operator"))
        return out


def with_environment(value):
    """A string with each ``${X}`` replaced by the environment's X, or by nothing; other values as they are."""
    return re.sub(r"\$\{(\w+)\}", lambda m: os.environ.get(m[1], ""), value) if isinstance(value, str) else value


@dataclass(frozen=True)
class _Http:
    model: str
    base_url: str
    api_key: str = ""
    timeout: float = 120.0
    retries: int = 3
    backoff: float = 1.0

    def _post(self, path: str, body: dict) -> dict:
        """One call, tried again after a pause that doubles; the last error is raised."""
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.api_key}"} if self.api_key else {})
        request = urllib.request.Request(self.base_url.rstrip("/") + path, json.dumps(body).encode(), headers)
        for turn in range(self.retries + 1):
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as reply:
                    return json.loads(reply.read())
            except (OSError, ValueError):
                if turn == self.retries:
                    raise
                time.sleep(self.backoff * 2**turn)
        raise AssertionError


@dataclass(frozen=True)
class HttpGenerator(_Http):
    """A generator behind a chat-completions interface; a batch is sent by a few threads, replies keep its order."""

    temperature: float = 0.7
    max_tokens: int = 2048
    threads: int = 4

    def __call__(self, prompts: list[str]) -> list[str]:
        def one(text: str) -> str:
            body = {"model": self.model, "messages": [{"role": "user", "content": text}], "temperature": self.temperature, "max_tokens": self.max_tokens}
            return self._post("/chat/completions", body)["choices"][0]["message"]["content"]

        with ThreadPoolExecutor(self.threads) as pool:
            return list(pool.map(one, prompts))


@dataclass(frozen=True)
class HttpEmbedder(_Http):
    """An embedder behind an embeddings interface; results are put in the order of their index."""

    timeout: float = 60.0

    def __call__(self, texts: list[str]) -> list[list[float]]:
        found = self._post("/embeddings", {"model": self.model, "input": texts})["data"]
        return [x["embedding"] for x in sorted(found, key=lambda x: x["index"])]
