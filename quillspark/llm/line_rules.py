"""Quality rules, line first.

Every line with a word is judged by itself: punctuation (it holds no end of a sentence, or over a third of its
words carry symbols), navigation (separators between short entries), boilerplate (a stock phrase, a line that
stands earlier in the text, or few words over and over). Lines that fail are removed, and a document is rejected
if it fails a rule on its whole text or loses more than half of its words to the line rules. Nothing is looked
up outside the row, so there is no shuffle.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, shingle_hashes, word_hashes

MIN_WORDS = 20
REPEAT_WINDOW = 8
MAX_REPEATED_PERCENT = 30
MAX_LOST_PERCENT = 50
#: A stock phrase marks a line of at most this many words; longer lines are prose that mentions it.
NOTICE_WORDS = 30
#: From this many words on, a line must not repeat each of its words three times and more.
MONOTONE_WORDS = 10

#: Patterns of the line rules, on a line as it stands; the SQL below uses the same ones.
_TERMINAL = r"(?:[.!?]|…|。|！|？|؟|।)(?:[\"')\]]|”|’|»)*"
ENDS = rf"(?:{_TERMINAL}|[:;])[\x20\x09-\x0D]*$"
SENTENCE = rf"{_TERMINAL}[\x20\x09-\x0D]"
SYMBOL_WORD = r"[^\x20\x09-\x0D]*(?:[#*$%&|<>]|!!|\?\?)[^\x20\x09-\x0D]*"
SEPARATOR = r"(?:[|>/]|»|›|•|·|→)"
SEPARATORS = rf"(?:^|[\x20\x09-\x0D]){SEPARATOR}[\x20\x09-\x0D]+(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]+)+?{SEPARATOR}(?:[\x20\x09-\x0D]|$)"
STOCK = (
    "all rights reserved", "click here", "cookie policy", "enable cookies", "enable javascript", "follow us on", "javascript is disabled",
    "lorem ipsum", "privacy policy", "read more", "share this", "sign in", "sign up", "skip to content", "skip to main content",
    "subscribe to", "terms of service", "terms of use", "use of cookies", "we use cookies",
)

#: The same patterns for a line's bytes, without scans of the whole line where its end or a rare byte decides.
_TERMINALS = tuple(x.encode() for x in (".", "!", "?", "…", "。", "！", "？", "؟", "।"))
_CLOSERS = tuple(x.encode() for x in ("\"", "'", ")", "]", "”", "’", "»"))
_SEPARATOR_WORDS = frozenset(x.encode() for x in ("|", ">", "/", "»", "›", "•", "·", "→"))
_sentence, _symbol, _symbol_mark, _separator = (re.compile(x.encode()) for x in (SENTENCE, SYMBOL_WORD, r"[#*$%&|<>]|!!|\?\?", SEPARATOR))
_stock = re.compile("|".join(STOCK).encode())
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True


def _ends(line: bytes) -> bool:
    """Whether the line matches ENDS."""
    line = line.rstrip(b" \t\n\r\v\f")
    if line.endswith((b":", b";")):
        return True
    while not line.endswith(_TERMINALS):
        if not line.endswith(_CLOSERS):
            return False
        line = line[: -next(len(x) for x in _CLOSERS if line.endswith(x))]
    return True


def _navigates(line: bytes, words: list[bytes]) -> bool:
    """Whether the line matches SEPARATORS: two separators as words of their own, with others between."""
    if not _separator.search(line):
        return False
    at = [i for i, w in enumerate(words) if w in _SEPARATOR_WORDS]
    return len(at) > 1 and at[-1] - at[0] > 1


def line_fails(line: bytes, words: list[bytes]) -> bool:
    """Whether a line with words fails the punctuation, navigation or boilerplate rule; repeats are the caller's."""
    n = len(words)
    if not _ends(line) and not _sentence.search(line):
        return True
    if _symbol_mark.search(line) and 3 * len(_symbol.findall(line)) > n:
        return True
    if _navigates(line, words):
        return True
    if n <= NOTICE_WORDS and _stock.search(line.translate(LOWER)):
        return True
    return n >= MONOTONE_WORDS and 3 * len(set(words)) < n


def judge(raw: bytes) -> tuple[int, int, int, int, int, int, bytes]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_words, and the lines that stay."""
    b = np.frombuffer(raw, np.uint8)
    h, s, e = word_hashes(raw)
    points = np.r_[0, np.cumsum((b & 0xC0) != 0x80)]
    chars = int((points[e] - points[s]).sum())
    repeated = 0
    if len(h) > REPEAT_WINDOW:
        _, which, counts = np.unique(shingle_hashes(h, REPEAT_WINDOW), return_inverse=True, return_counts=True)
        twice = (counts >= 2)[which].astype(np.int64)
        cover = np.zeros(len(h) + 1, np.int64)
        cover[: len(twice)] += twice
        cover[REPEAT_WINDOW : REPEAT_WINDOW + len(twice)] -= twice
        repeated = int((np.cumsum(cover)[:-1] > 0).sum())
    seen, kept, duplicates, lost = set(), [], 0, 0
    for line in raw.split(b"\n"):
        words = line.split()
        if not words:
            kept.append(line)
            continue
        key = line if len(line) <= 16 else xxhash.xxh3_128_digest(line)
        earlier = key in seen
        seen.add(key)
        duplicates += earlier
        if earlier or line_fails(line, words):
            lost += len(words)
        else:
            kept.append(line)
    return len(h), chars, int(_SYMBOLS[b].sum()), duplicates, repeated, lost, b"\n".join(kept)


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_words")


def assess(docs: DataFrame, text: str = "text", cleaned: str | None = None) -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_words (long), base_failed and kept.

    `cleaned` names a further column for the text without the lines that failed; blank lines stay in it. Columns of
    these names are replaced, all others stay. A null or empty text has no words: its counts are 0, it fails the base
    rule, and it is cleaned to null or the empty text. Repeated rows are judged alike, an empty table stays empty. A
    text of any length is judged whole, in memory of some 30 bytes a word.
    """
    names = [*MEASURES, *([cleaned] if cleaned else [])]
    source = docs.drop(*[n for n in (*names, "base_failed", "kept") if n != text])
    at = source.columns.index(text)

    def run(batches):
        for b in batches:
            rows = [judge(t.as_py().encode() if t.is_valid else b"") for t in b.column(at).cast(pa.string())]
            cols = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(MEASURES))]
            if cleaned:
                cols.append(pa.array([r[6].decode() if t.is_valid else None for r, t in zip(rows, b.column(at))], pa.string()))
            yield pa.record_batch([*b.columns, *cols], names=[*(f"c{i}" for i in range(b.num_columns)), *(f"m{i}" for i in range(len(cols)))])

    given = source.toDF(*[f"c{i}" for i in range(len(source.columns))])
    made = given.withColumns({f"m{i}": F.lit(None).cast("long" if n in MEASURES else "string") for i, n in enumerate(names)})
    judged = given.mapInArrow(run, made.schema)
    out = judged.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(source.columns) if n != cleaned], *[F.col(f"m{i}").alias(n) for i, n in enumerate(names)])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (100 * F.col("lost_words") <= MAX_LOST_PERCENT * F.col("n_words")))


def clean(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that are kept, with the lines that fail taken out of their text; the columns stay as they were."""
    given = docs.toDF(*[f"d{i}" for i in range(len(docs.columns))])
    at = f"d{docs.columns.index(text)}"
    judged = assess(given, at, "cleaned").where("kept").withColumn(at, F.col("cleaned"))
    return judged.select(*[F.col(f"d{i}").alias(n) for i, n in enumerate(docs.columns)])


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


def op11_sql() -> str:
    word = r"[^\x20\x09-\x0D]+"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '{word}') AS w FROM d),
windows AS (SELECT r, i, array_to_string(w[i:i + {REPEAT_WINDOW - 1}], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - {REPEAT_WINDOW - 2})) AS i FROM w)),
twice AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
repeated AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + {REPEAT_WINDOW})) AS p FROM twice) GROUP BY r),
line AS (SELECT r, unnest(range(1, len(s) + 1)) AS i, unnest(s) AS line FROM (SELECT r, string_split(text, chr(10)) AS s FROM d)),
worded AS (SELECT r, i, line, regexp_extract_all(line, '{word}') AS w, row_number() OVER (PARTITION BY r, line ORDER BY i) > 1 AS earlier FROM line WHERE regexp_matches(line, '{word}')),
judged AS (SELECT r, earlier, len(w) AS n, earlier
    OR (NOT regexp_matches(line, '{_quoted(ENDS)}') AND NOT regexp_matches(line, '{_quoted(SENTENCE)}'))
    OR 3 * len(regexp_extract_all(line, '{SYMBOL_WORD}')) > len(w)
    OR regexp_matches(line, '{SEPARATORS}')
    OR (len(w) <= {NOTICE_WORDS} AND regexp_matches(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{"|".join(STOCK)}'))
    OR (len(w) >= {MONOTONE_WORDS} AND 3 * len(list_distinct(w)) < len(w)) AS fails FROM worded),
lines AS (SELECT r, count(*) FILTER (WHERE earlier) AS dup, coalesce(sum(n) FILTER (WHERE fails), 0) AS lost FROM judged GROUP BY r),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lost, 0) AS BIGINT) AS lost_words
    FROM w LEFT JOIN lines USING (r) LEFT JOIN repeated USING (r))
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words AS base_failed,
    NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words) AND 100 * lost_words <= {MAX_LOST_PERCENT} * n_words AS kept FROM m
"""
