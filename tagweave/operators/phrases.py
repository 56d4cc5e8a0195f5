"""Searching every text for the entries of a phrase table, without copying or shuffling a text.

A task builds an Aho-Corasick automaton of the phrases and runs it over its texts once, so the cost is the length of
the texts plus the places found, whatever the number and the length of the phrases. An automaton is sent to the
executors, therefore its size is bounded: phrases are divided by hash into stripes of about ``STRIPE`` characters
(some 100 bytes a character in a task), and the texts are scanned once for each stripe. One stripe at a time passes
through the driver, never the table.
"""

from __future__ import annotations

from typing import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRIPE = 1_000_000


def stripes(phrases: DataFrame, stripe: int = STRIPE) -> Iterator[list[tuple[int, str]]]:
    """Lists of ``(id, phrase)`` that together hold the distinct rows of ``phrases(id, phrase)``.

    The table must give the same rows when read again (a stored one). A phrase longer than ``stripe`` is a
    stripe of its own length.
    """
    total = phrases.agg(F.sum(F.length("phrase").cast("long") + 1)).first()[0] or 0
    n = max(1, -(-total // stripe))
    part = F.pmod(F.xxhash64("phrase", "id"), F.lit(n))
    for i in range(n if total else 0):
        rows = phrases.where(part == i).select("id", "phrase").distinct().collect()
        if rows:
            yield [(r.id, r.phrase) for r in rows]


def automaton(entries: list[tuple[int, str]]):
    """Automaton whose values are the tuples of ids of equal phrases."""
    import ahocorasick
    ids: dict[str, list[int]] = {}
    for i, phrase in entries:
        ids.setdefault(phrase, []).append(i)
    found = ahocorasick.Automaton()
    for phrase, owners in ids.items():
        found.add_word(phrase, (len(phrase), tuple(owners)))
    found.make_automaton()
    return found


_BUILT: dict[tuple, object] = {}


def shared_automaton(key: str, entries: Callable[[], list[tuple[int, str]]]):
    """The automaton of a broadcast list, built once in each Python worker (the last one is kept)."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = automaton(entries())
    return _BUILT[key]
