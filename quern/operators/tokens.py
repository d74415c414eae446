"""Tokenizers behind one protocol, and a byte-level one made of column expressions.

A tokenizer gives ``encode`` and ``decode`` as columns, the same in Python for
tests, and the ids of its marks. `Bytes` needs no model file: every UTF-8 byte is
an id after the marks. `Called` wraps a Python encoder of a real tokenizer as an
Arrow-batched function, built once a worker process.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MARKS = {"pad": 0, "bos": 1, "eos": 2, "user": 3, "assistant": 4, "end": 5, "system": 6}


class Tokenizer(Protocol):
    """What packers and templates need."""

    marks: dict[str, int]
    vocab_size: int

    def encode(self, text: Column) -> Column: ...

    def decode(self, ids: Column) -> Column: ...


@dataclass(frozen=True)
class Bytes:
    """UTF-8 bytes, shifted by the number of marks. Encoding and decoding stay in the JVM."""

    marks: dict[str, int] = field(default_factory=lambda: dict(MARKS))
    shift: int = 8

    @property
    def vocab_size(self) -> int:
        return 256 + self.shift

    def encode(self, text: Column) -> Column:
        """Ids of a text; null has none."""
        pairs = F.regexp_extract_all(F.hex(F.encode(F.coalesce(text, F.lit("")), "utf-8")), F.lit("(..)"), 1)
        return F.transform(pairs, lambda x: F.conv(x, 16, 10).cast("int") + self.shift)

    def decode(self, ids: Column) -> Column:
        """The text of the ids that aren't marks."""
        kept = F.filter(ids, lambda x: x >= self.shift)
        return F.decode(F.unhex(F.array_join(F.transform(kept, lambda x: F.lpad(F.hex(x - self.shift), 2, "0")), "")), "utf-8")

    def encode_text(self, text: str) -> list[int]:
        return [b + self.shift for b in text.encode()]


@dataclass(frozen=True)
class Called:
    """A Python tokenizer: ``make`` gives its encode function and runs once a worker."""

    make: Callable[[], Callable[[str], list[int]]]
    undo: Callable[[], Callable[[list[int]], str]]
    vocab_size: int
    marks: dict[str, int] = field(default_factory=lambda: dict(MARKS))

    def encode(self, text: Column) -> Column:
        make = self.make

        @F.pandas_udf("array<int>")
        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            code = make()
            for s in parts:
                yield s.fillna("").map(code)

        return run(text)

    def decode(self, ids: Column) -> Column:
        undo, known = self.undo, set(self.marks.values())

        @F.pandas_udf("string")
        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            text = undo()
            for s in parts:
                yield s.map(lambda x: text([i for i in x if i not in known]))

        return run(ids)


def template(turns: Column, tok: Tokenizer, prompt: bool = False) -> Column:
    """The ids that inference sees: a BOS, a leading system text and its mark, then user and
    assistant turns with their marks, answers closed by the end mark; with ``prompt`` an open answer."""
    m = tok.marks
    first = F.get(turns, F.lit(0))
    system = first["role"].eqNullSafe("system")
    head = F.when(system, F.concat(F.array(F.lit(m["bos"])), tok.encode(first["text"]), F.array(F.lit(m["system"])))).otherwise(F.array(F.lit(m["bos"])))

    def one(x: Column) -> Column:
        ids = tok.encode(x["text"])
        user = F.concat(F.array(F.lit(m["user"])), ids)
        answer = F.concat(F.array(F.lit(m["assistant"])), ids, F.array(F.lit(m["end"])))
        return F.when(x["role"] == "user", user).when(x["role"] == "assistant", answer).otherwise(F.array().cast("array<int>"))

    body = F.flatten(F.transform(turns, one))
    return F.concat(head, body, F.array(F.lit(m["assistant"]))) if prompt else F.concat(head, body)


def piece_text(piece: Column, special: list[str]) -> Column:
    """The text of a vocabulary piece: its mark for a blank becomes one, nothing but blanks is one blank, a special piece is null."""
    plain = F.replace(piece, F.lit("▁"), F.lit(" "))
    return F.when(~piece.isin(*special), F.when(F.trim(plain) == "", F.lit(" ")).otherwise(plain))
