"""Text generators as pluggable callables: loaded once for each partition, fed in batches.

A factory makes a ``Generator``; only the factory is shipped. Results are written before they are branched on, so a
nondeterministic generator is asked once for each row.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Generator(Protocol):
    def generate_batch(self, prompts: list[str]) -> list[str]: ...

    def unload(self) -> None: ...


class Stub:
    """A deterministic generator: the answer is a function of the prompt."""

    def __init__(self, answer: Callable[[str], str] | None = None):
        self.answer = answer or (lambda p: "ABCD"[zlib.crc32(p.encode()) % 4])

    def generate_batch(self, prompts: list[str]) -> list[str]:
        return [self.answer(p) for p in prompts]

    def unload(self) -> None:
        pass


def generate(df: DataFrame, prompt: str, factory: Callable[[], Generator], output: str = "output", batch: int = 64, on_error: str | None = None) -> DataFrame:
    """``df`` with the generator's text for each prompt; a failed batch is asked prompt by prompt, ``on_error`` standing in."""
    at = df.columns.index(prompt)

    def ask(engine: Generator, prompts: list[str]) -> list[str | None]:
        try:
            return list(engine.generate_batch(prompts))
        except Exception:
            if on_error is None:
                raise
        out = []
        for p in prompts:
            try:
                out += engine.generate_batch([p])
            except Exception:
                out.append(on_error)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = factory()
        try:
            for b in batches:
                prompts = b.column(at).to_pylist()
                made = [x for i in range(0, len(prompts), batch) for x in ask(engine, prompts[i : i + batch])]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.string())], names=[*b.schema.names, output])
        finally:
            engine.unload()

    return df.mapInArrow(run, df.withColumn(output, F.lit("")).schema)
