"""Model transforms: a prompt per event to a completion, or a field to a vector, by a provider that batches.

A provider has complete(list of prompts) -> list of texts, and embed(list of texts) -> list of vectors. It is made once per
task by a factory, so connections are never shipped. Failing batches are tried row by row; a row that fails keeps its
event and carries the error, or fails the query, as skip_on_error says.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame

BATCH = 64


class Provider(Protocol):
    def complete(self, prompts: list[str]) -> list[str]: ...

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class FakeProvider:
    """Answers that depend on the text alone; for tests."""

    def __init__(self, dim: int = 8):
        self.dim = dim

    def complete(self, prompts: list[str]) -> list[str]:
        if any("fail" in p for p in prompts):
            raise ValueError("no answer")
        return [f"echo {hashlib.sha256(p.encode()).hexdigest()[:8]}" for p in prompts]

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [[b / 255 for b in hashlib.sha256(t.encode()).digest()[: self.dim]] for t in texts]


def _run(df: DataFrame, source: Column, target: str, kind: str, make: Callable[[], Provider], call: str, skip_on_error: bool) -> DataFrame:
    rows = df.withColumn("_in", source)
    names = df.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{target}` {kind}", "model_error string"])

    def apply(batches):
        import pyarrow as pa

        ask = getattr(make(), call)
        out_type = pa.string() if kind == "string" else pa.list_(pa.float64())
        for batch in batches:
            texts = batch.column("_in").to_pylist()
            got, errors = [None] * len(texts), [None] * len(texts)
            at = [i for i, t in enumerate(texts) if t is not None]
            for k in range(0, len(at), BATCH):
                part = at[k : k + BATCH]
                try:
                    for i, v in zip(part, ask([texts[i] for i in part])):
                        got[i] = v
                except Exception:
                    for i in part:
                        try:
                            got[i] = ask([texts[i]])[0]
                        except Exception as e:
                            if not skip_on_error:
                                raise
                            errors[i] = str(e)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(got, out_type), pa.array(errors, pa.string())], [*names, target, "model_error"])

    return rows.mapInArrow(apply, schema)


def chat(df: DataFrame, prompt: Column, target: str, make: Callable[[], Provider], skip_on_error: bool = True) -> DataFrame:
    """df with the completion and model_error; a null prompt has neither."""
    return _run(df, prompt, target, "string", make, "complete", skip_on_error)


def embedding(df: DataFrame, text: Column, target: str, make: Callable[[], Provider], skip_on_error: bool = True) -> DataFrame:
    return _run(df, text, target, "array<double>", make, "embed", skip_on_error)
