"""Text functions: columns in, columns out. Null texts count as empty unless a docstring says otherwise (STR1-STR39)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lexicon import DEFAULT, Lexicon


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once for each row; written out, it would be computed at every use, and inside a lambda for every element."""
    return F.get(F.transform(F.array(value), body), 0)


def strip_ends(text: Column) -> Column:
    """Without white space of any kind at the ends; trim() would leave tabs and line breaks."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility composition; Spark has no expression for it."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(T.StringType())
def _ascii(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode())


#: What normalisation drops. The kept characters are listed one by one: such a class is one table look-up for a character, ranges are tested in turn.
_DROPPED = r"[^abcdefghijklmnopqrstuvwxyz0123456789\-]+"


def normalize(text, compatible: bool = False) -> Column:
    """STR1: lower case, all but a-z, 0-9, white space and hyphens to spaces, white space squeezed and trimmed.

    compatible=True first applies NFKC, in an Arrow UDF; without it the expression stays in the JVM and agrees on
    every text that NFKC leaves alone.
    """
    c = F.coalesce(_c(text), F.lit(""))
    c = nfkc(c) if compatible else c
    # one pass: a run of dropped characters and white space, in whatever order, is one space either way
    return F.trim(F.regexp_replace(F.lower(c), _DROPPED, " "))


def words(text) -> Column:
    """The words of the normalised text, split without building it; the first and the last may be empty."""
    return F.split(F.lower(F.coalesce(_c(text), F.lit(""))), _DROPPED)


def tokens_of_normalized(norm, lexicon: Lexicon = DEFAULT) -> Column:
    """STR2 on an already normalised text."""
    return _tokens(F.split(_c(norm), " "), lexicon)


def _tokens(parts: Column, lexicon: Lexicon) -> Column:
    stop = list(lexicon.stopwords)
    kept = F.filter(parts, lambda t: (F.length(t) > 2) & ~t.isin(stop))
    return F.transform(kept, lambda t: synonym(t, lexicon))


def tokenize(text, lexicon: Lexicon = DEFAULT) -> Column:
    """STR2: normalised words longer than two characters that are no stopwords, then synonyms; order and repeats stay."""
    return _tokens(words(text), lexicon)


def synonym(token: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """A token's synonym, or the token."""
    if not lexicon.synonyms:
        return token
    pairs = [F.lit(x) for kv in lexicon.synonyms.items() for x in kv]
    known = token.isin(list(lexicon.synonyms))  # a hash test; few tokens reach the map
    return F.when(known, F.try_element_at(F.create_map(*pairs), token)).otherwise(token)


def contains_phrase(norm, phrase: str) -> Column:
    """STR3: substring test between normalised texts, without word boundaries; the empty phrase is in every text."""
    return F.contains(_c(norm), F.lit(phrase))


def any_phrase(norm, phrases) -> Column:
    """Whether any of the phrases is a substring: one pass of one alternation in place of a test for each."""
    return _c(norm).rlike("|".join(re.escape(p) for p in phrases)) if phrases else F.lit(False)


def bigrams(tokens) -> Column:
    """STR4: the tokens, then `a__b` of each neighbouring pair."""
    t = _c(tokens)
    n = F.size(t)
    pairs = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.concat(F.get(t, i - 1), F.lit("__"), F.get(t, i)))).otherwise(F.array().cast("array<string>"))
    return F.concat(t, pairs)


def hint(text, lexicon: Lexicon = DEFAULT) -> Column:
    """STR5: the tokens, joined by spaces."""
    return F.array_join(tokenize(text, lexicon), " ")


def _split(text, pattern: str) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(_c(text), F.lit("")), pattern), strip_ends), lambda x: x != "")


def split_semicolon(text) -> Column:
    """STR6: parts between semicolons, trimmed, without empty ones."""
    return _split(text, ";")


def split_list(text) -> Column:
    """STR7: parts between semicolons or bars."""
    return _split(text, r"[;\|]")


def split_reply_list(text) -> Column:
    """STR8: parts between semicolons, commas or line breaks."""
    return _split(text, r"[;\n,]+")


def clean_list(items) -> Column:
    """STR9: trimmed items without nulls and empty ones."""
    return F.filter(F.transform(_c(items), strip_ends), lambda x: x.isNotNull() & (x != ""))


def squeeze(text) -> Column:
    """STR10, STR17: runs of white space to one space, trimmed."""
    return F.trim(F.regexp_replace(_c(text), r"\s+", " "))


def excerpt(text, n: int = 1200, hard: bool = False) -> Column:
    """STR11: at most n characters with dots at the end, cut at a word unless hard."""
    c = squeeze(text)
    head = F.substring(c, 1, n - 3)
    head = F.rtrim(head) if hard else F.regexp_replace(head, r" [^ ]*$", "")
    return F.when(F.length(c) <= n, c).otherwise(F.concat(head, F.lit("...")))


def limit_text(text, n: int) -> Column:
    """STR12: at most n characters, cut at a word."""
    c = squeeze(text)
    return F.when(F.length(c) <= n, c).otherwise(F.regexp_replace(F.substring(c, 1, n), r" [^ ]*$", ""))


def normalize_key(text) -> Column:
    """STR13: accents stripped, lower case, all but a-z and 0-9 to single underscores, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(_ascii(F.coalesce(_c(text), F.lit("")))), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def slugify(text) -> Column:
    """STR14: all but letters, digits, `_`, `:` and `-` to underscores, none at the ends, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(_c(text), r"[^a-zA-Z0-9_:-]+", "_"), r"^_+|_+$", ""))


def dedupe_form(text) -> Column:
    """STR16: lower case, white space squeezed."""
    return F.lower(squeeze(text))


def stable_hash(text) -> Column:
    """STR15: the first 16 hexadecimal digits of the SHA-256 of the squeezed, lower-cased text."""
    return F.substring(F.sha2(dedupe_form(F.coalesce(_c(text), F.lit(""))), 256), 1, 16)


#: Instructions that leak into replies, in the order of their removal.
LEAKED_PREFIXES = ("Jawab dalam Bahasa Indonesia yang natural dan interaktif:", "Instruksi jawaban:")
DISCLAIMER_SNIPPET = "bukan diagnosis medis final"
DISCLAIMER = "Informasi ini bersifat rekomendasi awal dan edukasi, bukan diagnosis medis final dan bukan pengganti konsultasi tenaga kesehatan."


def clean_reply(text) -> Column:
    """STR18: unified line breaks, no leaked instructions, no trailing blanks, at most one empty line in a row."""
    c = strip_ends(F.replace(F.coalesce(_c(text), F.lit("")), F.lit("\r\n"), F.lit("\n")))
    for prefix in LEAKED_PREFIXES:
        c = F.when(F.startswith(c, F.lit(prefix)), strip_ends(F.substring(c, len(prefix) + 1, 2**31 - 1))).otherwise(c)
    return strip_ends(F.regexp_replace(F.regexp_replace(c, r"[ \t]+(?=\n|$)", ""), r"\n{3,}", "\n\n"))


def ensure_disclaimer(reply) -> Column:
    """STR19: the disclaimer is appended unless the reply has its snippet."""
    r = _c(reply)
    return F.when(F.contains(dedupe_form(r), F.lit(DISCLAIMER_SNIPPET)), r).otherwise(F.concat(F.regexp_replace(r, r"\s+$", ""), F.lit("\n\n" + DISCLAIMER)))


def translate_label(text, phrases: dict[str, str], words: dict[str, str]) -> Column:
    """STR20: longest phrases first on the padded lower-case text, then single words by dictionary."""
    c = F.concat(F.lit(" "), F.lower(squeeze(text)), F.lit(" "))
    for phrase in sorted(phrases, key=lambda p: (-len(p), p)):
        c = F.replace(c, F.lit(f" {phrase} "), F.lit(f" {phrases[phrase]} "))
    parts = F.split(F.trim(c), " ")
    if words:
        table = F.create_map(*[F.lit(x) for kv in words.items() for x in kv])
        parts = F.transform(parts, lambda w: F.coalesce(F.try_element_at(table, w), w))
    return F.trim(F.array_join(parts, " "))


#: English function words that a translated sentence drops.
FUNCTION_WORDS = ("have", "has", "had", "the", "a", "an", "is", "are", "was", "were", "of", "to")


def translate_sentence(text, phrases: dict[str, str], words: dict[str, str]) -> Column:
    """STR21: a translated label without function words, trimmed of ` ,.-`, its first letter upper case."""
    c = F.regexp_replace(translate_label(text, phrases, words), r"\b(" + "|".join(FUNCTION_WORDS) + r")\b", " ")
    c = F.regexp_replace(squeeze(c), r"^[ ,.\-]+|[ ,.\-]+$", "")
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 2**31 - 1))


def sentences(text) -> Column:
    return F.split(squeeze(text), r"(?<=[.!?])\s+")


def summarize(text, max_sentences: int = 2, max_chars: int = 360) -> Column:
    """STR22: the first sentences, cut hard."""
    return F.rtrim(F.substring(F.array_join(F.slice(sentences(text), 1, max_sentences), " "), 1, max_chars))


def preparation_steps(text, most: int = 8, default: str = "") -> Column:
    """STR23: steps between full stops or semicolons; by commas if there are fewer than two; the text itself, or a default, if none."""
    whole = F.trim(F.replace(F.coalesce(_c(text), F.lit("")), F.lit(";"), F.lit(".")))

    def parts(mark: str):
        trimmed = F.transform(F.split(whole, f"[{mark}]"), lambda x: F.regexp_replace(x, rf"^[ {mark}]+|[ {mark}]+$", ""))
        return F.filter(trimmed, lambda x: x != "")

    by_stop, by_comma = parts("."), parts(",")
    chosen = F.when(F.size(by_stop) >= 2, by_stop).otherwise(by_comma)
    return F.when(F.size(chosen) == 0, F.array(F.coalesce(F.nullif(_c(text), F.lit("")), F.lit(default)))).otherwise(F.slice(chosen, 1, most))


def export_text(text) -> Column:
    """STR29: without carriage returns, at most one empty line in a row, trimmed; a dash where nothing is left."""
    c = strip_ends(F.regexp_replace(F.replace(F.coalesce(_c(text), F.lit("")), F.lit("\r"), F.lit("")), r"\n{3,}", "\n\n"))
    return F.when(c == "", F.lit("-")).otherwise(c)


# References of the characters that markup reserves; the ampersand comes first.
XML_REFERENCES = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&apos;", "\n": "&#10;"}
HTML_REFERENCES = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&#039;"}


def escaped(text, references: dict[str, str] = XML_REFERENCES) -> Column:
    """STR29: with references in place of reserved characters."""
    c = F.coalesce(_c(text), F.lit(""))
    for a, b in references.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def file_name(text, default: str = "percakapan-herbal") -> Column:
    """STR29: a lower-case file name of letters, digits and hyphens, accents stripped; a default where nothing is left."""
    c = F.regexp_replace(_ascii(F.coalesce(_c(text), F.lit(""))), r"[^a-zA-Z0-9\s-]+", "")
    c = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\s+", "-"), r"-+", "-"), r"^-|-$", ""))
    return F.when(c == "", F.lit(default)).otherwise(c)


def as_sentence(text) -> Column:
    """STR24: with a full stop unless it ends in one of .!?"""
    c = strip_ends(_c(text))
    return F.when((c == "") | c.rlike(r"[.!?]$"), c).otherwise(F.concat(c, F.lit(".")))


def split_names(text) -> Column:
    """STR25: parts between semicolons, commas or the word and."""
    return _split(text, r"(?i);|,|\band\b")


def patient_friendly(text, rewrites: dict[str, str], most: int = 260) -> Column:
    """STR26: plain-language replacements in order, cut to `most` characters."""
    c = squeeze(text)
    for a, b in rewrites.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.substring(c, 1, most)


def split_questions(text, most: int = 3) -> Column:
    """STR27: questions of a reply, one from each line or list number, up to its first question mark."""
    broken = F.regexp_replace(F.regexp_replace(F.coalesce(_c(text), F.lit("")), r"\s+(?=\d+[.)]\s)", "\n"), r"\?\s*", "?\n")
    parts = F.transform(F.split(broken, r"\n+"), lambda x: F.regexp_extract(F.trim(F.regexp_replace(x, r"^\s*(?:\d+[.)]|[-*•])\s*", "")), r"^[^?]*\??", 0))
    return F.slice(F.filter(parts, lambda x: F.length(x) > 6), 1, most)


def distinct_ci(items) -> Column:
    """ARR1, STR28: squeezed items, without empty ones, the first spelling of each in whatever case."""
    c = F.filter(F.transform(_c(items), lambda x: squeeze(x)), lambda x: x.isNotNull() & (x != ""))
    both = F.transform(c, lambda x: F.struct(x.alias("x"), F.lower(x).alias("low")))
    return bound(both, lambda b: F.transform(F.filter(b, lambda p, i: F.array_position(b["low"], p["low"]) == i + 1), lambda p: p["x"]))


def reference_urls(text, fallback=None, rules: dict[str, str] | None = None) -> Column:
    """STR30: the fallback, article addresses from `PMID n`, and addresses by keyword; distinct, in order, joined by `; `."""
    ids = F.transform(F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(r"PMID\s*(\d+)"), 1), lambda n: F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), n, F.lit("/")))
    keyed = F.array_compact(F.array(*[F.when(F.contains(F.lower(_c(text)), F.lit(k)), F.lit(u)) for k, u in (rules or {}).items()])) if rules else F.array().cast("array<string>")
    first = F.array_compact(F.array(_c(fallback))) if fallback is not None else F.array().cast("array<string>")
    return F.array_join(F.array_distinct(F.concat(first, ids, keyed)), "; ")


def section(text, heading: str, headings) -> Column:
    """STR31: what stands between a heading's line and the nearest line that is another heading."""
    c = F.concat(F.lit("\n"), F.coalesce(_c(text), F.lit("")), F.lit("\n"))
    start = F.instr(c, f"\n{heading}\n")
    rest = F.substring(c, start + len(heading) + 1, F.length(c))
    ends = F.array_compact(F.array(*[F.when(F.instr(rest, f"\n{h}\n") > 0, F.instr(rest, f"\n{h}\n")) for h in headings if h != heading] or [F.lit(None).cast("int")]))
    return F.when(start == 0, F.lit("")).otherwise(F.trim(squeeze(F.substring(rest, F.lit(1), F.coalesce(F.array_min(ends) - 1, F.length(rest))))))


def is_heading(text, prefixes) -> Column:
    """STR33: whether the lower-case text starts with a heading's words."""
    c = F.lower(strip_ends(_c(text)))
    return F.exists(F.array(*[F.lit(p) for p in prefixes]), lambda p: F.startswith(c, p))


def to_points(lines, limit: int, metadata: str = r"(?i)^(sumber|penulis|editor|tanggal)\b") -> Column:
    """STR34: bullets stripped, lines of metadata and repeats dropped, at most `limit`; sentences if nothing is left."""
    c = F.transform(_c(lines), lambda x: strip_ends(F.regexp_replace(x, r"^\s*(?:[-*•·]|\d+[.)])\s*", "")))
    points = F.slice(F.array_distinct(F.filter(c, lambda x: (x != "") & ~x.rlike(metadata))), 1, limit)
    return F.when(F.size(points) > 0, points).otherwise(F.slice(sentences(F.array_join(_c(lines), " ")), 1, limit))


def json_blob(text) -> Column:
    """STR36: from the first opening to the last closing brace; null if there is none."""
    return F.nullif(F.regexp_extract(_c(text), r"(?s)\{.*\}", 0), F.lit(""))


def strip_thinking(text) -> Column:
    """STR37: without thinking blocks of either spelling."""
    c = F.regexp_replace(F.coalesce(_c(text), F.lit("")), r"(?is)<think>.*?</think>", "")
    return strip_ends(F.regexp_replace(c, r"(?is)<\|channel>thought.*?<channel\|>", ""))


def strip_fence(text) -> Column:
    """STR38: without a code fence around the text."""
    return F.regexp_replace(F.regexp_replace(_c(text), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")


def template(pattern: str, **columns) -> Column:
    """STR39: `{name}` places filled by columns; null counts as empty, arrays are joined by line breaks with dashes."""
    out = []
    for literal, name in re.findall(r"([^{]*)(?:\{(\w+)\})?", pattern):
        if literal:
            out.append(F.lit(literal))
        if name:
            out.append(F.coalesce(_c(columns[name]), F.lit("")))
    return F.concat(*out)


def blocks(texts: dict[str, str], wanted: dict[str, Column], **columns) -> Column:
    """The templates of a dictionary with empty lines between them, but those that aren't wanted."""
    parts = [F.when(F.coalesce(wanted[k], F.lit(False)), template(t, **columns)) if k in wanted else template(t, **columns) for k, t in texts.items()]
    return F.array_join(F.array_compact(F.array(*parts)), "\n\n")


def bullet_list(items) -> Column:
    return F.array_join(F.transform(_c(items), lambda x: F.concat(F.lit("- "), x)), "\n")


def null_if_blank(text) -> Column:
    """Trimmed, null where nothing is left."""
    return F.nullif(strip_ends(_c(text)), F.lit(""))
