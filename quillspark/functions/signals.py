"""Rule-based signals of a message (FLT1-FLT29): expressions over a normalised text and literal phrase lists."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lexicon import DEFAULT, Lexicon
from .text import any_phrase, contains_phrase, normalize, strip_ends, tokenize


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def negated(norm, phrase: str, lexicon: Lexicon = DEFAULT) -> Column:
    """FLT1: a negation, a space and the phrase are a substring anywhere."""
    return any_phrase(norm, [f"{p} {phrase}" for p in lexicon.negations])


def asserted(norm, phrase: str, lexicon: Lexicon = DEFAULT) -> Column:
    return contains_phrase(norm, phrase) & ~negated(norm, phrase, lexicon)


def red_flags(norm, lexicon: Lexicon = DEFAULT) -> Column:
    """FLT2: labels of asserted phrases, distinct, in the lexicon's order."""
    return F.array_distinct(F.array_compact(F.array(*[F.when(asserted(norm, p, lexicon), F.lit(label)) for p, label in lexicon.red_flags.items()])))


def hinted_cases(norm, lexicon: Lexicon = DEFAULT) -> Column:
    """FLT3: cases with an asserted hint, in the lexicon's order."""
    def any_hint(hints):
        out = F.lit(False)
        for h in hints:
            out = out | asserted(norm, h, lexicon)
        return out

    return F.array_compact(F.array(*[F.when(any_hint(hints), F.lit(case)) for case, hints in lexicon.hints.items()]))


def detected_hints(norm, lexicon: Lexicon = DEFAULT) -> Column:
    """FLT3: asserted hints, distinct and sorted."""
    phrases = sorted({h for hints in lexicon.hints.values() for h in hints})
    return F.array_compact(F.array(*[F.when(asserted(norm, h, lexicon), F.lit(h)) for h in phrases]))


def symptom_slots(norm, lexicon: Lexicon = DEFAULT) -> tuple[Column, Column]:
    """FLT4: concepts mentioned and never negated, and concepts with a negated alias; both sorted."""
    present, absent = [], []
    for concept in sorted(lexicon.symptoms):
        aliases = lexicon.symptoms[concept]
        mentioned = any_phrase(norm, aliases)
        denied = F.lit(False)
        for a in aliases:
            denied = denied | negated(norm, a, lexicon)  # a negated alias is mentioned too
        present.append(F.when(mentioned & ~denied, F.lit(concept)))
        absent.append(F.when(mentioned & denied, F.lit(concept)))
    return F.array_compact(F.array(*present)), F.array_compact(F.array(*absent))


def duration_text(norm, lexicon: Lexicon = DEFAULT) -> Column:
    """FLT5: the match of the first pattern that has one; null if none has."""
    return F.coalesce(*[F.nullif(F.trim(F.regexp_extract(_c(norm), p, 0)), F.lit("")) for p in lexicon.durations])


def has_intensity(norm, lexicon: Lexicon = DEFAULT) -> Column:
    """FLT6: a phrase of intensity."""
    return any_phrase(norm, lexicon.intensity)


def has_progression(norm, lexicon: Lexicon = DEFAULT) -> Column:
    """FLT6: a phrase of progression."""
    return any_phrase(norm, lexicon.progression)


def has_duration(norm, lexicon: Lexicon = DEFAULT) -> Column:
    """FLT7: a match of a duration pattern, or one of the duration words."""
    return duration_text(norm, lexicon).isNotNull() | any_phrase(norm, lexicon.duration_words)


def asks_recommendation(norm, lexicon: Lexicon = DEFAULT) -> Column:
    """FLT7: a request for a recommendation."""
    return any_phrase(norm, lexicon.recommendation)


def safety_clearance(norm, lexicon: Lexicon = DEFAULT) -> Column:
    """FLT8: a clearance prefix before any red-flag phrase, as one alternation."""
    one, two = ("|".join(re.escape(x) for x in xs) for xs in (lexicon.clearances, lexicon.red_flags))
    return _c(norm).rlike(f"(?:{one}) (?:{two})")


def answered_slots(present, absent, duration, flags, clearance) -> Column:
    """FLT9: what the messages have answered, as lines."""
    def prefixed(items, text):
        return F.transform(_c(items), lambda x: F.concat(F.lit(text), x))

    return F.concat(
        prefixed(present, "gejala disebut ada: "),
        prefixed(absent, "gejala disebut tidak ada: "),
        F.array_compact(F.array(F.concat(F.lit("durasi sudah disebut: "), _c(duration)))),
        prefixed(flags, "tanda bahaya terdeteksi: "),
        F.when(_c(clearance), F.array(F.lit("sebagian tanda bahaya sudah disangkal user"))).otherwise(F.array().cast("array<string>")),
    )


def analyze(df: DataFrame, text: str = "text", lexicon: Lexicon = DEFAULT) -> DataFrame:
    """`df` with all signals of a text column; the text is normalised once."""
    df = df.withColumn("normalized", normalize(text))
    present, absent = symptom_slots("normalized", lexicon)
    duration = duration_text("normalized", lexicon)
    df = df.withColumns(
        {
            "red_flags": red_flags("normalized", lexicon),
            "hinted_case_ids": hinted_cases("normalized", lexicon),
            "detected_symptoms": detected_hints("normalized", lexicon),
            "present_symptoms": present,
            "absent_symptoms": absent,
            "duration_text": duration,
            "has_intensity_signal": has_intensity("normalized", lexicon),
            "has_progression_signal": has_progression("normalized", lexicon),
            "has_safety_clearance_signal": safety_clearance("normalized", lexicon),
            "asks_for_recommendation": asks_recommendation("normalized", lexicon),
        }
    )
    return df.withColumns(
        {
            "has_duration_signal": F.col("duration_text").isNotNull() | any_phrase("normalized", lexicon.duration_words),
            "answered_slots": answered_slots("present_symptoms", "absent_symptoms", "duration_text", "red_flags", "has_safety_clearance_signal"),
        }
    )


# Phrases of the dialogue's guards, in natural order.
CONFUSION = ("maksud anda", "maksudnya", "gimana", "bagaimana maksud", "tidak mengerti", "nggak mengerti", "ga mengerti", "gak paham", "tidak paham", "bingung", "kurang paham", "jelaskan", "apa maksud")
NEGATIVE_ANSWERS = ("tidak ada", "tidak ada tanda berat", "tidak ada tanda bahaya", "tidak ada semuanya", "tidak ada semua", "ga ada", "gak ada", "nggak ada", "ngga ada", "enggak ada", "tidak", "ga", "gak", "nggak")
SAFETY_TERMS = ("sesak", "nyeri hebat", "perdarahan", "muntah terus", "lemas", "pingsan", "memburuk")
SAFETY_NOTE = "tidak ada sesak. tidak ada nyeri hebat. tidak ada perdarahan. tidak ada darah. tidak ada muntah terus. tidak ada lemas sekali. tidak ada pingsan. tidak ada perburukan cepat"
FEVER_TERMS = ("nyeri belakang mata", "ruam", "bintik merah", "kaku leher", "sangat lemas")
FEVER_NOTE = "tidak ada nyeri belakang mata. tidak ada ruam. tidak ada muntah. tidak ada kaku leher. tidak ada lemas sekali"
TEMPERATURES = (r"\bsuhu(?:\s+\w+){0,3}\s+(\d{2,3}(?:\.\d)?)\b", r"\b(\d{2,3}(?:\.\d)?)\s*(?:derajat|derajad|celcius|celsius|c)\b")
FEEDBACK = {
    "unclear_preparation": ("pengolahan kurang jelas", "cara kurang jelas", "kurang detail", "tidak jelas"),
    "not_helpful": ("belum membantu", "tidak membantu", "kurang membantu", "kurang cocok", "tidak cocok", "gak cocok", "nggak cocok", "belum membaik", "tidak membaik", "bahan sulit", "sulit didapat"),
    "helpful": ("membantu", "cocok", "lebih baik", "bermanfaat", "terbantu"),
}
DETAIL_TERMS = ("detail", "jelaskan", "rinci", "langkah", "step", "cara")
PREPARATION_TERMS = ("pengolahan", "membuat", "buat", "rebus", "seduh", "olah", "ramuan")


def confused(norm) -> Column:
    """FLT10: a message that asks what was meant."""
    return any_phrase(norm, CONFUSION)


def invalid_temperature(norm) -> Column:
    """FLT11: the first impossible body temperature (45 or more, below 30), by pattern, then position; null if none."""
    found = F.concat(*[F.regexp_extract_all(_c(norm), F.lit(p), 1) for p in TEMPERATURES])
    return F.get(F.filter(F.transform(found, lambda x: x.cast("double")), lambda v: (v >= 45) | (v < 30)), 0)


def contextual_note(message, last_question) -> Column:
    """FLT12: the note that a bare negative answer stands for, by the question it answers; null for other messages."""
    bare = normalize(message).isin(list(NEGATIVE_ANSWERS))
    asked = normalize(last_question)
    return F.when(bare & any_phrase(asked, SAFETY_TERMS), F.lit(SAFETY_NOTE)).when(bare & any_phrase(asked, FEVER_TERMS), F.lit(FEVER_NOTE))


def asks_preparation_detail(message) -> Column:
    """FLT13: words of detail and of preparation in one message."""
    low = F.lower(_c(message))
    return any_phrase(low, DETAIL_TERMS) & any_phrase(low, PREPARATION_TERMS)


def feedback_label(message) -> Column:
    """FLT14: unclear before not helpful before helpful, on the lower-case message; null if none."""
    norm = F.lower(_c(message))
    out = F.lit(None).cast("string")
    for label in reversed(FEEDBACK):
        out = F.when(any_phrase(norm, FEEDBACK[label]), F.lit(label)).otherwise(out)
    return out


def after_recommendation(completed, stage) -> Column:
    """FLT15: a turn after the session's recommendation."""
    return F.coalesce(_c(completed), F.lit(False)) & (F.coalesce(_c(stage), F.lit("")) == "final_recommendation")


SUPPORT = 0.28
DUPLICATE = 0.72


def supports_flow(n_hits, present, hinted, best_score) -> Column:
    """FLT16: no hits, no; symptoms or hints, yes; else by the best score."""
    return F.when(_c(n_hits) == 0, False).when((F.size(_c(present)) > 0) | (F.size(_c(hinted)) > 0), True).otherwise(F.coalesce(_c(best_score), F.lit(0.0)) >= SUPPORT)


def needs_referral(scope, refer) -> Column:
    """FLT17: referral by scope or by the model's own word; a missing assessment needs none."""
    return F.coalesce(_c(scope).isin("critical", "internal_medicine") | _c(refer), F.lit(False))


def unsupported(scope) -> Column:
    return F.coalesce(_c(scope) == "unsupported", F.lit(False))


def asks_follow_up(scope, enough, question, asked, most: int = 3) -> Column:
    """FLT17: supported, not yet enough information, a question, and budget left; without assessment only the budget counts."""
    budget = _c(asked) < most
    return F.when(_c(scope).isNull(), budget).otherwise((_c(scope) == "supported") & ~_c(enough) & (F.coalesce(_c(question), F.lit("")) != "") & budget)


def force_final(scope, asked, complaint, duration, safety, detail) -> Column:
    """FLT18: complaint, duration and safety are known, and detail too or two questions asked."""
    return (_c(scope) == "supported") & (_c(asked) > 0) & _c(complaint) & _c(duration) & _c(safety) & (_c(detail) | (_c(asked) >= 2))


# Terms of questions, in natural order.
CLINICAL_TERMS = ("sejak", "berapa lama", "demam", "sesak", "nyeri", "mual", "muntah", "darah", "bengkak", "memburuk", "durasi", "lemas", "lepuh", "menyebar", "perdarahan")
DETAIL_QUESTION = ("berapa", "suhu", "derajat", "tinggi", "pola", "naik turun", "menetap", "mendadak", "seberapa", "skala", "parah", "berat", "lokasi", "bagian", "warna", "luas", "menyebar", "melepuh", "memburuk", "terus")
DURATION_QUESTION = ("sejak kapan", "berapa lama", "sudah berapa", "kapan mulai", "mulai kapan", "durasi")
INTENSITY_QUESTION = ("suhu", "derajat", "derajad", "skala", "seberapa berat", "seberapa mengganggu")
GENERIC_QUESTION = ("gejala lain", "gejala selain", "keluhan lain", "keluhan selain")
EXISTENCE = ("apakah ada", "apa ada", "ada ", "terdapat", "disertai", "mengalami")
IMMEDIATE = ("demam", "sakit kepala", "batuk", "sesak napas", "nyeri perut", "muntah", "diare", "ruam", "gatal", "nyeri otot/sendi")


def low_quality_question(question) -> Column:
    """FLT19: without question mark at the end, or without a clinical word."""
    q = strip_ends(F.lower(F.coalesce(_c(question), F.lit(""))))
    return ~F.endswith(q, F.lit("?")) | ~any_phrase(q, CLINICAL_TERMS)


def needs_immediate_safety(present) -> Column:
    """A present symptom that calls for the safety question first."""
    return F.arrays_overlap(_c(present), F.array(*[F.lit(x) for x in IMMEDIATE]))


def mentioned_symptoms(norm, lexicon: Lexicon = DEFAULT) -> Column:
    """Concepts whose name or alias is in a question, sorted."""
    return F.array_compact(F.array(*[F.when(any_phrase(norm, (normalize_literal(s), *lexicon.symptoms[s])), F.lit(s)) for s in sorted(lexicon.symptoms)]))


def normalize_literal(text: str) -> str:
    """normalize() for a literal, on the driver."""
    return " ".join(re.sub(r"[^a-z0-9\s\-]+", " ", text.lower()).split())


def repetitive_question(question, answered, has_duration, has_intensity, lexicon: Lexicon = DEFAULT) -> Column:
    """FLT20: asks again for duration, intensity, or only for symptoms that are already answered."""
    q = normalize(question)
    said = mentioned_symptoms(q, lexicon)
    new, again = F.size(F.array_except(said, _c(answered))) > 0, F.size(F.array_intersect(said, _c(answered))) > 0
    return (
        (q == "")
        | (_c(has_duration) & any_phrase(q, DURATION_QUESTION))
        | (_c(has_intensity) & any_phrase(q, INTENSITY_QUESTION))
        | (any_phrase(q, GENERIC_QUESTION) & ~new)
        | (any_phrase(q, EXISTENCE) & again & ~new & ~any_phrase(q, DETAIL_QUESTION))
    )


def overlap(a, b) -> Column:
    """Distinct common tokens over the smaller distinct set; 0 where a set is empty."""
    x, y = F.array_distinct(_c(a)), F.array_distinct(_c(b))
    return F.size(F.array_intersect(x, y)) / F.greatest(F.lit(1), F.least(F.size(x), F.size(y)))


def duplicate_question(question, history, lexicon: Lexicon = DEFAULT) -> Column:
    """FLT21: equal to, part of, containing, or sharing most tokens with a question of the history."""
    q = normalize(question)
    tokens = tokenize(question, lexicon)

    def same(h):
        a = normalize(h)
        return (a != "") & ((a == q) | F.contains(a, q) | F.contains(q, a) | (overlap(tokens, tokenize(h, lexicon)) >= DUPLICATE))

    return F.exists(F.coalesce(_c(history), F.array().cast("array<string>")), same)


def names_match(a, b) -> Column:
    """FLT22: common tokens of more than two characters reach half of the smaller set, one at least."""
    x, y = F.array_distinct(F.filter(F.split(normalize(a), " "), lambda t: F.length(t) > 2)), F.array_distinct(F.filter(F.split(normalize(b), " "), lambda t: F.length(t) > 2))
    return F.size(F.array_intersect(x, y)) >= F.greatest(F.lit(1), F.floor(F.least(F.size(x), F.size(y)) / 2))


def is_ascii(text) -> Column:
    """FLT23: only ASCII characters."""
    return _c(text).rlike(r"^[\x00-\x7F]*$")


def excluded_title(title, terms) -> Column:
    """FLT23: a term is in the lower-case title."""
    return any_phrase(F.lower(_c(title)), terms)


def recommendation_allowed(names, denied) -> Column:
    """FLT25: no name or alias has a denied term."""
    return ~any_phrase(F.lower(F.array_join(_c(names), " ")), denied)


def valid_chat(messages) -> Column:
    """FLT26: two messages at least, of a user and of an assistant; a null array is not valid."""
    roles = F.transform(_c(messages), lambda m: m["role"])
    return F.coalesce((F.size(_c(messages)) >= 2) & F.array_contains(roles, "user") & F.array_contains(roles, "assistant"), F.lit(False))


def missing_model(error) -> Column:
    """FLT28: an error that says that a model isn't there."""
    low = F.lower(_c(error))
    return F.contains(low, F.lit("http 404")) & F.contains(low, F.lit("not found"))


def cited_evidence(text) -> Column:
    """FLT29: names of evidence registers, in whatever case."""
    return _c(text).rlike(r"(?i)PubMed|NCCIH|WHO|Cochrane|systematic review|clinical trial")
