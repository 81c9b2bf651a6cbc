"""Model calls behind small protocols, made batch by batch on executors, with deterministic stand-ins for tests."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


class EmbeddingProvider(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class ChatProvider(Protocol):
    def complete(self, prompts: list[str]) -> list[str]: ...


class HashEmbedding:
    """Unit vectors from the md5 of a text."""

    def __init__(self, size: int = 64):
        self.size = size

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            seed = int.from_bytes(hashlib.md5(text.encode()).digest()[:8], "little")
            v = np.random.default_rng(seed).normal(size=self.size)
            out.append((v / np.linalg.norm(v)).tolist())
        return out


class EchoChat:
    """Answers with the last words of a prompt; for tests."""

    def complete(self, prompts: list[str]) -> list[str]:
        return [f"<answer>{' '.join(p.split()[-2:])}</answer>" for p in prompts]


class ScriptedDecision:
    """The action that a script names for each phase."""

    def __init__(self, script: dict[str, str]):
        self.script = script

    def complete(self, prompts: list[str]) -> list[str]:
        return [self.script.get(p, "submit_report") for p in prompts]


class DiceAgent:
    """Replies by the md5 of a key and a step: calls of tools, one that nobody has, a thought alone, an answer, a failure."""

    def reply(self, key: object, name: str, step: int, messages: list[str]) -> str:
        drawn = int(hashlib.md5(f"{key}|{step}".encode()).hexdigest()[:8], 16) % 10
        if drawn == 9:
            raise RuntimeError("the model did not answer")
        if drawn == 8:
            return f"Thought: enough\nFinal Answer: {name}"
        call = f'search(query="{name}")' if drawn < 4 else 'visit(entity_id="Q1")' if drawn < 6 else 'fly(to="moon")'
        return "Thought: what now" if drawn == 7 else f"Thought: look\nAction: {call}"

    def force(self, messages: list[str]) -> str:
        return f"forced {(len(messages) - 1) // 2}"


def small_tools() -> dict[str, Callable[[dict], str]]:
    """Two tools that answer at once."""
    return {"search": lambda a: f"results for {a.get('query', '')}", "visit": lambda a: f"page of {a.get('entity_id', '')}"}


def embed_column(df: DataFrame, column: str, out: str, make: Callable[[], EmbeddingProvider]) -> DataFrame:
    """df with vectors of a text column; one client for each partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make()
        for batch in batches:
            yield batch.assign(**{out: client.embed(batch[column].fillna("").tolist())})

    return df.mapInPandas(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, `{out}` array<double>")


def complete_column(df: DataFrame, column: str, out: str, make: Callable[[], ChatProvider]) -> DataFrame:
    """df with completions of a prompt column."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make()
        for batch in batches:
            yield batch.assign(**{out: client.complete(batch[column].fillna("").tolist())})

    return df.mapInPandas(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, `{out}` string")
