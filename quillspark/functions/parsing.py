"""Structured output of models and providers, pages, feeds and documents (JSN1-JSN4, SRC9-SRC15, RPT4)."""

from __future__ import annotations

import html
import io
import re
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import json_blob, null_if_blank, split_reply_list, strip_ends, strip_fence, strip_thinking

def _rows(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_TEXT, _TEXTS = T.StringType(), T.ArrayType(T.StringType())

#: Scope labels and what they mean.
SCOPES = {"supported": "supported", "non-critical": "supported", "non_critical": "supported", "internal": "internal_medicine", "internal_medicine": "internal_medicine", "critical": "critical", "unsupported": "unsupported"}
#: Long field names and their short spellings.
ALIASES = {"scope_reason": "why", "suspected_conditions": "suspected", "reasoning": "why", "enough_information": "enough", "follow_up_question": "question", "follow_up_rationale": "question_why", "need_medical_referral": "refer", "final_answer": "final", "recommended_herbal_name": "herbal", "preparation": "prep", "dosage": "dose", "warning_notes": "warn", "source_hint": "source"}
DURATIONS = ("total_duration", "load_duration", "prompt_eval_duration", "eval_duration")
COUNTS = ("prompt_eval_count", "eval_count")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def scope_of(raw) -> Column:
    """JSN1: the first known label among parts between bars, commas and slashes; unsupported if there is none."""
    parts = F.filter(F.transform(F.split(F.lower(_c(raw)), r"[|,/]+"), strip_ends), lambda t: t != "")
    table = F.create_map(*[F.lit(x) for kv in SCOPES.items() for x in kv])
    return F.coalesce(F.get(F.array_compact(F.transform(parts, lambda t: F.try_element_at(table, t))), 0), F.lit("unsupported"))


def _truthy(v: Column) -> Column:
    """As a Python truth value: non-empty texts, lists and objects, numbers other than 0."""
    text = v.cast("string")
    return F.coalesce(~F.lower(text).isin("", "false", "0", "0.0", "[]", "{}", "null"), F.lit(False))


def assessment(reply) -> Column:
    """JSN1: the assessment in a model's reply, with long or short field names; null where there is no JSON object.

    Thinking blocks and code fences go first. Lists may be arrays or texts.
    """
    data = F.try_parse_json(json_blob(strip_fence(strip_thinking(reply))))

    def raw(name: str) -> Column:
        return F.try_variant_get(data, f"$.{name}", "string")

    def text(name: str) -> Column:
        names = [name] + ([ALIASES[name]] if name in ALIASES else [])
        return strip_ends(F.coalesce(*[F.nullif(raw(n), F.lit("")) for n in names], F.lit("")))

    def items(name: str) -> Column:
        def one(n: str) -> Column:
            array = F.try_variant_get(data, f"$.{n}", "array<string>")
            trimmed = F.filter(F.transform(array, strip_ends), lambda x: x.isNotNull() & (x != ""))
            whole = raw(n)
            return F.when(array.isNotNull(), F.when(F.size(array) > 0, trimmed)).when(F.coalesce(whole, F.lit("")) != "", split_reply_list(whole))

        names = [name] + ([ALIASES[name]] if name in ALIASES else [])
        return F.coalesce(*[one(n) for n in names], F.array().cast("array<string>"))

    def flag(name: str) -> Column:
        return F.when(raw(name).isNotNull(), _truthy(raw(name))).otherwise(_truthy(raw(ALIASES[name])))

    struct = F.struct(
        scope_of(F.coalesce(F.nullif(raw("scope"), F.lit("")), F.lit("unsupported"))).alias("scope"),
        text("scope_reason").alias("scope_reason"),
        items("suspected_conditions").alias("suspected_conditions"),
        text("reasoning").alias("reasoning"),
        flag("enough_information").alias("enough_information"),
        null_if_blank(text("follow_up_question")).alias("follow_up_question"),
        text("follow_up_rationale").alias("follow_up_rationale"),
        items("red_flags").alias("red_flags"),
        flag("need_medical_referral").alias("need_medical_referral"),
        *[text(k).alias(k) for k in ("final_answer", "recommended_herbal_name")],
        items("ingredients").alias("ingredients"),
        *[text(k).alias(k) for k in ("preparation", "dosage", "warning_notes", "source_hint")],
    )
    return F.when(data.isNotNull(), struct)


def token_rate(count, nanoseconds) -> Column:
    """AGG15: tokens a second to two places; null without count or with no positive duration."""
    n, ns = _c(count), _c(nanoseconds)
    return F.when(n.isNotNull() & (ns > 0), F.round(n / (ns / 1_000_000_000), 2))


def local_metrics(payload) -> Column:
    """JSN2: durations, counts and rates of a local provider's JSON answer."""
    data = F.try_parse_json(payload)
    def number(k: str) -> Column:
        return F.try_variant_get(data, f"$.{k}", "bigint")

    named = [null_if_blank(F.try_variant_get(data, f"$.{k}", "string")).alias(a) for k, a in (("model", "response_model"), ("created_at", "created_at"), ("done_reason", "done_reason"))]
    rates = [token_rate(number(f"{k}_count"), number(f"{k}_duration")).alias(f"{k}_rate_tps") for k in ("prompt_eval", "eval")]
    return F.struct(*[number(k).alias(k) for k in DURATIONS + COUNTS], *named, *rates)


def hosted_metrics(payload) -> Column:
    """JSN2: token usage of a hosted provider's JSON answer."""
    data = F.try_parse_json(payload)
    def number(path: str, name: str) -> Column:
        return F.try_variant_get(data, f"$.usage.{path}", "bigint").alias(name)

    return F.struct(
        *[number(k, k) for k in ("prompt_tokens", "completion_tokens", "total_tokens")],
        number("prompt_tokens_details.cached_tokens", "cached_prompt_tokens"),
        number("completion_tokens_details.reasoning_tokens", "reasoning_tokens"),
        null_if_blank(F.try_variant_get(data, "$.model", "string")).alias("response_model"),
        null_if_blank(F.try_variant_get(data, "$.choices[0].finish_reason", "string")).alias("finish_reason"),
    )


def content_text(content) -> Column:
    """JSN4: chat content that is JSON text, or a JSON array of parts, as plain text."""
    data = F.try_parse_json(content)
    parts = F.try_variant_get(data, "$", "array<variant>")
    texts = F.transform(parts, lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.when(F.substring(F.to_json(p), 1, 1) == "{", F.lit("")).otherwise(F.try_variant_get(p, "$", "string")), F.lit("")))
    return F.when(parts.isNotNull(), F.array_join(texts, "")).otherwise(F.coalesce(F.try_variant_get(data, "$", "string"), _c(content), F.lit("")))


def format_latency(ms) -> Column:
    """RPT4: milliseconds below a second, else seconds to two places; a dash for null."""
    m = _c(ms).cast("bigint")
    cents = F.floor((m + 5) / 10)
    seconds = F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"), F.lit(" s"))
    return F.when(m.isNull(), F.lit("-")).when(m < 1000, F.concat(m.cast("string"), F.lit(" ms"))).otherwise(seconds)


def format_metrics(metrics) -> Column:
    """RPT3: a map as `k=v; k=v`, sorted by key."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(_c(metrics))), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), "; ")


class _Texts(HTMLParser):
    SKIP = ("script", "style", "noscript", "svg")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.in_title, self.title, self.parts = 0, False, [], []

    def handle_starttag(self, tag, attrs):
        self.depth += tag in self.SKIP
        self.in_title |= tag == "title"

    def handle_endtag(self, tag):
        self.depth = max(0, self.depth - (tag in self.SKIP))
        self.in_title &= tag != "title"

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif not self.depth:
            text = " ".join(data.split())
            if len(text) > 24:
                self.parts.append(text)


@F.pandas_udf(_rows(title=_TEXT, text=_TEXT))
def page_texts(pages: pd.Series) -> pd.DataFrame:
    """SRC9: the title, and text nodes longer than 24 characters, of a page."""
    out = []
    for page in pages:
        p = _Texts()
        p.feed(page or "")
        p.close()
        out.append((" ".join("".join(p.title).split()), " ".join(p.parts)))
    return pd.DataFrame(out, columns=["title", "text"])


class _Items(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.buffer, self.found = None, [], {"p": [], "li": []}

    def close_item(self):
        text = " ".join("".join(self.buffer).split())
        if self.open and text:
            self.found[self.open].append(text)
        self.open, self.buffer = None, []

    def handle_starttag(self, tag, attrs):
        if tag in self.found:
            self.close_item()
            self.open = tag

    def handle_endtag(self, tag):
        if tag == self.open:
            self.close_item()

    def handle_data(self, data):
        if self.open:
            self.buffer.append(data)


def items_of(page: str | None) -> dict[str, list[str]]:
    """Texts of the paragraphs (p) and list items (li) of an HTML text."""
    p = _Items()
    p.feed(page or "")
    p.close()
    p.close_item()
    return p.found


@F.pandas_udf(_rows(paragraphs=_TEXTS, list_items=_TEXTS))
def summary_parts(pages: pd.Series) -> pd.DataFrame:
    """SRC10: paragraphs and list items of an HTML summary."""
    found = map(items_of, pages)
    return pd.DataFrame([(x["p"], x["li"]) for x in found], columns=["paragraphs", "list_items"])


@F.pandas_udf(_TEXT)
def unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else html.unescape(x))


def html_to_text(value) -> Column:
    """SRC11: a fragment as text: list items end in `; `, tags go, references are decoded, white space is squeezed."""
    c = F.regexp_replace(F.coalesce(_c(value), F.lit("")), r"(?i)</li>", "; ")
    return F.trim(F.regexp_replace(unescape(F.regexp_replace(c, r"<[^>]+>", " ")), r"\s+", " "))


_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


@F.pandas_udf(_TEXTS)
def docx_paragraphs(files: pd.Series) -> pd.Series:
    """SRC13: non-empty paragraphs of word-processor files, white space squeezed; null for other files."""
    def one(raw):
        try:
            with zipfile.ZipFile(io.BytesIO(raw)) as z:
                root = ElementTree.fromstring(z.read("word/document.xml"))
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, TypeError):
            return None
        texts = ("".join(t.text or "" for t in p.iter(_WORD + "t")) for p in root.iter(_WORD + "p"))
        return [x for t in texts if (x := " ".join(t.split()))]

    return files.map(one)


_MONOGRAPH = re.compile(r"\n[ \t]*([^\n]+?)[ \t]*\n\s*\n(?=[ \t]*Definition)")


def monographs_of(text: str | None) -> list[tuple[str, str]]:
    """Titles and bodies of the monographs of a text."""
    found = [*_MONOGRAPH.finditer("\n" + (text or ""))]
    ends = [m.start() for m in found[1:]] + [len(text or "") + 1]
    return [(m[1].strip(), ("\n" + text)[m.start() : e].strip()) for m, e in zip(found, ends)]


@F.pandas_udf(T.ArrayType(_rows(title=_TEXT, body=_TEXT)))
def monographs(texts: pd.Series) -> pd.Series:
    """SRC14, WIN11: monographs of a long text; one starts at a line that is followed by an empty line and Definition, and ends where the next starts."""
    return texts.map(lambda text: [{"title": t, "body": b} for t, b in monographs_of(text)])


def field_blocks(payload, headings: dict[str, str]) -> Column:
    """SRC15: heading and description blocks of a JSON page, by heading."""
    data = F.from_json(_c(payload), "name string, common_names string, latin_names string, blocks array<struct<heading: string, description: string>>")
    def of(heading: str) -> Column:
        return F.get(F.filter(data["blocks"], lambda b: F.contains(F.lower(b["heading"]), F.lit(heading))), 0)["description"]

    return F.struct(data["name"].alias("name"), data["common_names"].alias("common_names"), data["latin_names"].alias("latin_names"), *[of(h).alias(k) for k, h in headings.items()])
