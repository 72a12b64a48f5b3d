"""Grammars over words, in the JVM: a letter for the kind of each word, and one expression over the letters.

A text becomes an array of words and a string with as many letters, one for each word. What a
grammar reads is a regular expression over that string; where it matches, places in the string are places
in the array. No Python worker is needed, and a row costs one pass for each expression.
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

DATA = Path(__file__).resolve().parent.parent / "data"


def words_by_value(name: str) -> dict[str, int]:
    """A table of words: each line has a number and its spellings."""
    lines = (DATA / name).read_text(encoding="utf-8").splitlines()
    return {w: int(n) for n, *ws in map(str.split, filter(None, lines)) for w in ws}


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x computed once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def lookup(table: dict[str, object], k: Column) -> Column:
    """The table's value for k, or null."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), k)


def matches(letters: Column, pattern: str) -> Column:
    """array<struct<start, letters>>: where the pattern matches, from 0, and what."""
    parts = F.split(F.regexp_replace(letters, pattern, F.lit("#$0#")), "#", -1)  # every second part is a match
    none = F.array().cast("array<struct<start:int,letters:string>>")

    def step(acc: Column, part: Column) -> Column:
        found = F.when(acc["odd"], F.array_append(acc["found"], F.struct(acc["at"].alias("start"), part.alias("letters")))).otherwise(acc["found"])
        return F.struct((acc["at"] + F.length(part)).alias("at"), (~acc["odd"]).alias("odd"), found.alias("found"))

    return F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.lit(False).alias("odd"), none.alias("found")), step, lambda acc: acc["found"])
