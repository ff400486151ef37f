"""Many phrases at once: one automaton that reads a text once, however many phrases there are (JN5, FLT2-FLT4, STR3)."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases of one automaton; more go into further automata, each read in turn.
MAX_PHRASES = 500_000


def automaton(phrases: DataFrame, phrase: str, number: str) -> list:
    """Broadcast automata of (phrase, number) rows, MAX_PHRASES to each; the driver holds one at a time."""
    spark, out, part = phrases.sparkSession, [], None
    for text, n in phrases.select(phrase, F.col(number).cast("long")).toLocalIterator():
        if part is None:
            part = ahocorasick.Automaton()
        part.add_word(text, n)
        if len(part) >= MAX_PHRASES:
            out.append(_shared(spark, part))
            part = None
    if part is not None:
        out.append(_shared(spark, part))
    return out


def _shared(spark, part):
    part.make_automaton()
    return spark.sparkContext.broadcast(pickle.dumps(part))


def _found(rows: DataFrame, text: Column, automata: list, name: str, kind: str, of) -> DataFrame:
    source = rows.drop(name).withColumn("_quill_text", text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = [pickle.loads(a.value) for a in automata]
        for b in batches:
            values = [None if t is None else of(n for a in loaded for _, n in a.iter(t)) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.record_batch([*b.columns[:-1], pa.array(values, pa.int64() if kind == "long" else pa.list_(pa.int64()))], names=[*b.schema.names[:-1], name])

    return source.mapInArrow(run, source.drop("_quill_text").withColumn(name, F.lit(None).cast(kind)).schema)


def first_of(rows: DataFrame, text: Column, automata: list, name: str) -> DataFrame:
    """`rows` with the smallest number among the phrases that are substrings of a text; null where there is none."""
    return _found(rows, text, automata, name, "long", lambda numbers: min(numbers, default=None))


def all_of(rows: DataFrame, text: Column, automata: list, name: str) -> DataFrame:
    """`rows` with the numbers of all phrases that are substrings of a text, distinct and sorted; null for a null text."""
    return _found(rows, text, automata, name, "array<bigint>", lambda numbers: sorted(set(numbers)))
