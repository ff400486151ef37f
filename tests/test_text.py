import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.functions.lexicon import STOPWORDS, SYNONYMS


def plain_normalize(t):
    t = re.sub(r"[^a-z0-9\s\-]+", " ", unicodedata.normalize("NFKC", t or "").lower())
    return re.sub(r"\s+", " ", t).strip()


def plain_tokens(t):
    return [SYNONYMS.get(w, w) for w in plain_normalize(t).split() if len(w) > 2 and w not in STOPWORDS]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="abzAZ09 -.,éß\tsakit gatal yang", max_size=40), min_size=1, max_size=40))
def test_normalize_and_tokenize_agree_with_plain_python(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    for r in df.select("t", X.normalize("t", True).alias("n"), X.tokenize("t").alias("k"), X.bigrams(X.tokenize("t")).alias("b")).collect():
        assert r.n == plain_normalize(r.t) and r.k == plain_tokens(r.t)
        assert r.b == r.k + [f"{a}__{b}" for a, b in zip(r.k, r.k[1:])]


@pytest.mark.parametrize(
    "make,value,want",
    [
        (lambda c: X.hint(c), "Saya sakit gatal", "nyeri iritasi"),
        (lambda c: X.split_semicolon(c), "a; b;;c ", ["a", "b", "c"]),
        (lambda c: X.split_list(c), "a|b;c", ["a", "b", "c"]),
        (lambda c: X.split_reply_list(c), "a, b\nc;", ["a", "b", "c"]),
        (lambda c: X.excerpt(c, 12), "one two three four", "one two..."),
        (lambda c: X.excerpt(c, 12, True), "one two three four", "one two t..."),
        (lambda c: X.limit_text(c, 9), "one two three", "one two"),
        (lambda c: X.normalize_key(c), " Réseau  Zingiber (L.) ", "reseau_zingiber_l"),
        (lambda c: X.slugify(c), "  A b/C:1 ", "a_b_c:1"),
        (lambda c: X.clean_reply(c), "Instruksi jawaban: a  \r\n\r\n\r\n\r\nb \n", "a\n\nb"),
        (lambda c: X.ensure_disclaimer(c), "x bukan DIAGNOSIS  medis final", "x bukan DIAGNOSIS  medis final"),
        (lambda c: X.translate_label(c, {"common cold": "pilek", "cold": "dingin"}, {"fever": "demam"}), "Common cold  fever x", "pilek demam x"),
        (lambda c: X.translate_sentence(c, {}, {"fever": "demam"}), "the fever is high,", "Demam high"),
        (lambda c: X.summarize(c, 2), "A b. C d! E f?", "A b. C d!"),
        (lambda c: X.preparation_steps(c), "cuci; rebus. saring.", ["cuci", "rebus", "saring"]),
        (lambda c: X.preparation_steps(c), "cuci, rebus", ["cuci", "rebus"]),
        (lambda c: X.as_sentence(c), " a b ", "a b."),
        (lambda c: X.as_sentence(c), "a?", "a?"),
        (lambda c: X.split_names(c), "a, b and c; d", ["a", "b", "c", "d"]),
        (lambda c: X.split_questions(c), "1. Sejak kapan demam? ya 2) Apakah ada sesak? - x", ["Sejak kapan demam?", "Apakah ada sesak?"]),
        (lambda c: X.reference_urls(c, None, {"who": "https://who.example"}), "PMID 12, PMID12 who", "https://pubmed.ncbi.nlm.nih.gov/12/; https://who.example"),
        (lambda c: X.section(c, "Uses", ["Uses", "Dose"]), "Intro\nUses\nfor  cough\nDose\n3 g", "for cough"),
        (lambda c: X.section(c, "None", ["Uses"]), "Uses\nx", ""),
        (lambda c: X.is_heading(c, ["gejala", "pencegahan"]), "Gejala klinis", True),
        (lambda c: X.json_blob(c), "x {a {b} } y", "{a {b} }"),
        (lambda c: X.json_blob(c), "none", None),
        (lambda c: X.strip_thinking(c), "<think>rahasia</think>Jawaban final", "Jawaban final"),
        (lambda c: X.strip_thinking(c), "<|channel>thought\nrahasia<channel|>Jawaban final", "Jawaban final"),
        (lambda c: X.strip_fence(c), "```json\n{}\n```", "{}"),
        (lambda c: X.null_if_blank(c), "  ", None),
        (lambda c: X.template("a {x}-{y}!", x=c, y=F.lit(None).cast("string")), "q", "a q-!"),
        (lambda c: X.patient_friendly(c, {"dispepsia": "maag"}), "dispepsia  ringan", "maag ringan"),
    ],
)
def test_scalar(one, make, value, want):
    assert one(make(F.col("v")), v=value) == want


def test_lists(one):
    assert one(X.distinct_ci("v"), v=["A ", "a", "", "B  c", "b c", "A"]) == ["A", "B c"]
    assert one(X.clean_list("v"), v=[" a", "", "b"]) == ["a", "b"]
    assert one(X.to_points("v", 2), v=["- satu", "2) dua", "satu", "Sumber: x", "tiga"]) == ["satu", "dua"]
    assert one(X.to_points("v", 3), v=["Sumber: a. B."]) == ["Sumber: a.", "B."]
    assert one(X.bullet_list("v"), v=["a", "b"]) == "- a\n- b"


def test_stable_hash_matches_hashlib(one):
    import hashlib

    assert one(X.stable_hash("v"), v="  A  b\nC ") == hashlib.sha256(b"a b c").hexdigest()[:16]


def test_contains_phrase_has_no_word_boundaries_and_the_empty_phrase_is_everywhere(one):
    assert one(X.contains_phrase("v", "ga sesak"), v="juga sesak") and one(X.contains_phrase("v", ""), v="x")
