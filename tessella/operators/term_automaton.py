"""Occurrences of any number of terms in texts, by one automaton and one pass over each text."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of the terms that one automaton is made of; a longer list is taken in parts, with a pass each.
MOST_CHARS = 8_000_000


def _is_word(text: str, at: int) -> bool:
    """Whether the character is one of a word: a letter, decimal digit or underscore, or a mark upon a letter or digit."""
    marked = False
    while 0 <= at < len(text):
        kind = unicodedata.category(text[at])
        if kind != "Mn":
            return kind[0] == "L" or kind == "Nd" or (text[at] == "_" and not marked)
        at, marked = at - 1, True
    return False


class TermAutomaton:
    """A trie of terms with failure links, whose matches must begin and end at word boundaries."""

    def __init__(self, terms: list[str]):
        import ahocorasick

        self.terms, self.machine = terms, ahocorasick.Automaton()
        for i, t in enumerate(terms):
            self.machine.add_word(t, (i, len(t), _is_word(t, 0), _is_word(t, len(t) - 1)))
        self.machine.make_automaton()

    def found(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(term, begin, end) of each occurrence, as a search for that term alone finds them: from left to right without overlap."""
        ended: dict[int, int] = {}
        for last, (i, size, word_first, word_last) in self.machine.iter(text):
            begin = last + 1 - size
            if begin >= ended.get(i, 0) and _is_word(text, begin - 1) != word_first and _is_word(text, last + 1) != word_last:
                ended[i] = last + 1
                yield i, begin, last + 1


def _parts(terms: Iterator[str]) -> Iterator[list[str]]:
    part, room = [], MOST_CHARS
    for t in terms:
        if len(t) > room and part:
            yield part
            part, room = [], MOST_CHARS
        part.append(t)
        room -= len(t)
    if part:
        yield part


_COUNTS = pa.schema([("low", pa.string()), ("n_docs", pa.int64()), ("n_occurrences", pa.int64())])


def term_frequency(docs: DataFrame, text: str, terms: list[str] | DataFrame) -> DataFrame:
    """term, n_docs and n_occurrences of each distinct term, case ignored, between word boundaries; 0 where there is none.

    ``terms``: a list, or a table with the column ``term``. Equal to a search for the quoted, lower-cased term with a
    boundary on either side in each lower-cased text. The driver holds one part of the terms at a time, and tasks sum
    before they send: at most a row for each term of the part. An empty term occurs nowhere.
    """
    spark, low = docs.sparkSession, docs.where(F.col(text).isNotNull()).select(F.lower(text).alias("t"))
    if isinstance(terms, DataFrame):
        names = terms.select("term", F.lower("term").alias("low")).where(F.col("term").isNotNull()).distinct()
        every = (r["low"] for r in names.where("low <> ''").select("low").distinct().toLocalIterator())
    else:
        own = sorted(set(terms))
        names = spark.createDataFrame(pa.table({"term": pa.array(own, pa.string()), "low": pa.array([t.lower() for t in own], pa.string())}))
        every = iter(sorted({t.lower() for t in own} - {""}))
    counts = spark.createDataFrame([], "low string, n_docs long, n_occurrences long")
    for part in _parts(every):
        sent = spark.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            automaton = TermAutomaton(sent.value)
            n_docs, n_all = [0] * len(sent.value), [0] * len(sent.value)
            for b in batches:
                for value in b.column("t").to_pylist():
                    seen = set()
                    for i, _, _ in automaton.found(value):
                        n_all[i] += 1
                        seen.add(i)
                    for i in seen:
                        n_docs[i] += 1
            some = [i for i, n in enumerate(n_all) if n]
            yield pa.RecordBatch.from_pydict({"low": [sent.value[i] for i in some], "n_docs": [n_docs[i] for i in some], "n_occurrences": [n_all[i] for i in some]}, _COUNTS)

        counts = counts.unionByName(low.mapInArrow(run, "low string, n_docs long, n_occurrences long"))
    counts = counts.groupBy("low").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_occurrences").alias("n_occurrences"))
    return names.join(counts, "low", "left").select("term", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_docs", "n_occurrences")])
