"""Table functions: one row for each part of a text, callable from SQL with a lateral join (SRC10, SRC14, STR32).

A text's parts leave as rows while it is read, so none of them waits for the others in an array.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .parsing import items_of, monographs_of


@F.udtf(returnType="kind string, number int, content string", useArrow=True)
class Fragments:
    """SRC10: paragraphs (p) and list items (li) of an HTML text, numbered from 1 by kind; no row for a null text."""

    def eval(self, page: str) -> Iterator[tuple]:
        for kind, texts in items_of(page).items():
            for i, text in enumerate(texts, 1):
                yield kind, i, text


@F.udtf(returnType="number int, title string, body string", useArrow=True)
class Monographs:
    """SRC14: monographs of a long text, numbered from 1; no row for a text without one."""

    def eval(self, text: str) -> Iterator[tuple]:
        for i, (title, body) in enumerate(monographs_of(text), 1):
            yield i, title, body


@F.udtf(returnType="heading string, number int, line string", useArrow=True)
class Sections:
    """STR32: non-empty lines below each of the headings (joined by `|`), numbered from 1 in their section; those before the first one are `intro`.

    A line is a heading if, in lower case and without a colon or full stop at its end, it equals one, or starts or ends with one and is little longer.
    """

    def eval(self, text: str, headings: str) -> Iterator[tuple]:
        known, heading, numbers = (headings or "").split("|"), "intro", {}
        for line in (text or "").split("\n"):
            line = " ".join(line.split())
            if not line:
                continue
            low = line.rstrip(":. ").lower()
            own = next((h for h in known if h and low == h), None) or next((h for h in known if h and (low.startswith(h) or low.endswith(h)) and len(low) <= len(h) + 20), None)
            if own:
                heading = own
                continue
            numbers[heading] = numbers.get(heading, 0) + 1
            yield heading, numbers[heading], line


def register(spark: SparkSession) -> None:
    """Makes fragments(), monographs() and sections() known to SQL."""
    for name, function in (("fragments", Fragments), ("monographs", Monographs), ("sections", Sections)):
        spark.udtf.register(name, function)


def parts(rows: DataFrame, function: str, *arguments: str) -> DataFrame:
    """`rows` joined with what a registered table function gives for each; arguments are SQL expressions over a row."""
    register(rows.sparkSession)
    return rows.sparkSession.sql(f"SELECT * FROM {{rows}} r, LATERAL {function}({', '.join(arguments)}) p", rows=rows)
