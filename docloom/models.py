"""What the engine needs from models and parsers, and deterministic stand-ins.

The stand-ins make pipelines runnable and testable where no model is at hand. They are no
match in quality for an encoder, a cross-encoder or a language model, and do not claim to be.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Encoder(Protocol):
    width: int

    def encode(self, texts: Sequence[str]) -> np.ndarray: ...


@dataclass(frozen=True)
class Request:
    """One call of a language model."""

    task: str
    prompt: str
    system: str = ""
    schema: str | None = None


class LanguageModel(Protocol):
    def answers(self, requests: Sequence[Request]) -> list[str | Exception]:
        """Answers in order; a call that failed gives its exception and does not stop the others."""


class Reranker(Protocol):
    def score(self, pairs: Sequence[tuple[str, str]]) -> Sequence[float]: ...


class Parser(Protocol):
    def pages(self, content: bytes, content_type: str) -> tuple[list[str], list[dict]]: ...


class HashedEncoder:
    """Signed hashing of words into a unit vector."""

    def __init__(self, width: int = 64):
        self.width = width

    def encode(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.width), dtype=np.float32)
        for i, text in enumerate(texts):
            for word in (text or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                out[i, h % self.width] += 1.0 if h >> 63 else -1.0
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


class RecordedModel:
    """Answers from a fixed table by task, else the first characters of the prompt."""

    def __init__(self, answers: dict[str, str] | None = None, echo: int = 200):
        self.fixed, self.echo = answers or {}, echo

    def answers(self, requests: Sequence[Request]) -> list[str | Exception]:
        return [self.fixed.get(r.task, r.prompt[: self.echo]) for r in requests]


class FirstChoice:
    """Takes the first choice a schema offers, says no and lists nothing; without a schema it echoes the prompt's beginning."""

    def __init__(self, echo: int = 200):
        self.echo = echo

    def answers(self, requests: Sequence[Request]) -> list[str | Exception]:
        return [json.dumps(self._first(json.loads(r.schema)), ensure_ascii=False) if r.schema else r.prompt[: self.echo] for r in requests]

    def _first(self, schema: dict):
        if "anyOf" in schema:
            return self._first(schema["anyOf"][0])
        if "const" in schema:
            return schema["const"]
        if "enum" in schema:
            return schema["enum"][0]
        kind = schema.get("type")
        if kind == "object":
            return {k: self._first(v) for k, v in schema.get("properties", {}).items()}
        return {"boolean": False, "array": [], "string": ""}.get(kind)


class PlainParser:
    """Text and XML uploads as one page of UTF-8; other kinds need a real parser."""

    def pages(self, content: bytes, content_type: str) -> tuple[list[str], list[dict]]:
        if content_type not in ("text/plain", "application/txt", "text/xml", "application/xml"):
            raise ValueError(f"no parser for {content_type}")
        return [content.decode("utf-8", "replace")], []


def encoded(c: Column, encoder: Encoder, prefix: str = "") -> Column:
    """Vectors of texts, batched across rows; the encoder is sent once to each worker."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(encoder.encode([prefix + (t or "") for t in texts])))

    return run(c)


ANSWER = "struct<text:string,error:string>"


def asked(task: Column, prompt: Column, model: LanguageModel, system: Column | None = None, schema: Column | None = None) -> Column:
    """``struct<text, error>``: a model's answers, whole batches at a time; a null prompt gives null."""

    @F.pandas_udf(ANSWER)
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for tasks, prompts, systems, schemas in batches:
            requests = [None if p is None else Request(t, p, s or "", j) for t, p, s, j in zip(tasks, prompts, systems, schemas)]
            try:
                answers = iter(model.answers([r for r in requests if r is not None]))
                got = [None if r is None else next(answers) for r in requests]
            except Exception as e:  # the client as a whole failed: every call of the batch did
                got = [None if r is None else e for r in requests]
            yield pd.DataFrame({"text": [None if isinstance(g, Exception) else g for g in got], "error": [(str(g) or type(g).__name__) if isinstance(g, Exception) else None for g in got]}, dtype=object)

    nothing = F.lit(None).cast("string")
    return run(task, prompt, nothing if system is None else system, nothing if schema is None else schema)
