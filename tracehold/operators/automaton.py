"""Many literals in one pass over a text.

An Aho-Corasick automaton reads a text once, whatever the number of literals.  Tasks build
it from a broadcast list, once per Python worker, and give back the literals they met, so
the literals themselves are the keys of the join that follows.  The list is broadcast
only below a stated number of characters; beyond it :func:`shards` cuts it into several.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of the literals of one automaton: 81 MB in a worker, measured on random literals of 20 characters.
SHARD_CHARS = 2_000_000
#: The list a worker saw last and its automaton.
_built: list = [None, None]


def _automaton(words: list[str]) -> ahocorasick.Automaton:
    if _built[0] is not words:
        machine = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for word in words:
            machine.add_word(word)
        machine.make_automaton()
        _built[:] = words, machine
    return _built[1]


def characters(literals: DataFrame, column: str) -> int:
    """Characters of all literals, at least one for each."""
    return literals.agg(F.sum(F.greatest(F.length(column), F.lit(1)))).first()[0] or 0


def literals_in(text: Column, literals: DataFrame, column: str) -> Column:
    """The distinct literals a text contains, as an array; a null text contains none.

    ``literals`` is collected, so its :func:`characters` must be at most ``SHARD_CHARS``.
    Empty and null literals are not looked for.
    """
    rows = literals.select(column).distinct().toArrow()[column].to_pylist()
    shared = literals.sparkSession.sparkContext.broadcast(sorted(w for w in rows if w))
    if not shared.value:
        return F.array().cast("array<string>")

    @F.pandas_udf("array<string>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = _automaton(shared.value)
        for texts in batches:
            yield texts.map(lambda t: sorted({t[end - size + 1 : end + 1] for end, size in machine.iter(t)}) if t else [])

    return found(text)


def shards(literals: DataFrame, column: str, total: int, limit: int = SHARD_CHARS) -> Iterator[DataFrame]:
    """Literals of ``total`` characters cut by hash into parts of about half of ``limit``, so that no part passes it."""
    parts = 1 if total <= limit else -(-2 * total // limit)
    return (literals.where(F.pmod(F.xxhash64(column), F.lit(parts)) == k) for k in range(parts))
