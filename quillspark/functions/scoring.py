"""Candidate scores (SCO1-SCO13) as columns.

An assessment is a struct column with the fields of ASSESSMENT; titles, symptoms and the like are array columns.
Weights and caps are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import DEFAULT, Lexicon
from .signals import DETAIL_QUESTION, DURATION_QUESTION, EXISTENCE, GENERIC_QUESTION, duplicate_question, mentioned_symptoms
from .text import any_phrase, bound, normalize, strip_ends, tokenize

ASSESSMENT = "scope string, scope_reason string, suspected_conditions array<string>, reasoning string, enough_information boolean, follow_up_question string, follow_up_rationale string, red_flags array<string>, need_medical_referral boolean, final_answer string, recommended_herbal_name string, ingredients array<string>, preparation string, dosage string, warning_notes string, source_hint string"
FOLLOW_UP_WEIGHTS = {"safety": 0.25, "grounding": 0.2, "completeness": 0.16, "relevance": 0.16, "language": 0.08, "question_quality": 0.05, "non_repetition": 0.1}
FINAL_WEIGHTS = {"safety": 0.28, "grounding": 0.22, "completeness": 0.2, "relevance": 0.14, "language": 0.08, "herbal_fit": 0.08}
LEGACY_WEIGHTS = {"safety": 0.34, "grounding": 0.3, "completeness": 0.24, "language": 0.12}
NO_REPLY = "Model belum menghasilkan jawaban yang dapat dipakai."
RISKY = ("pasti sembuh", "menyembuhkan", "obat utama", "tidak perlu dokter", "abaikan dokter", "diagnosis anda", "instruksi jawaban", "konteks retrieval")
FOLLOW_UP_SIGNALS = ("sejak kapan", "demam", "sesak", "tanda bahaya", "ruam", "nyeri", "muntah")
RED_FLAG_SIGNALS = ("segera", "tenaga kesehatan", "fasilitas kesehatan", "tanda bahaya")
RECOMMENDATION_SIGNALS = ("ramuan", "bahan", "cara", "dosis", "kewaspadaan", "sumber")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def four_places(score: Column) -> Column:
    """Rounded to four places as a binary number: F.round(score, 4) rounds the number's shortest decimal text, and so 0.60425, which is less than that in binary, up."""
    return F.round(score * 10000) / 10000


def _has(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) != ""


def _any(items: Column) -> Column:
    return F.coalesce(F.size(items), F.lit(0)) > 0


def _points(*parts: tuple[float, Column], start: Column | float = 0.0) -> Column:
    """`start` and the values whose condition holds, added one after the other: sums of doubles depend on their order."""
    total = F.lit(start) if isinstance(start, float) else start
    for value, condition in parts:
        total = total + F.when(condition, F.lit(value)).otherwise(F.lit(0.0))
    return total


def _capped(score: Column) -> Column:
    return F.least(F.lit(1.0), score)


def _terms(texts: Column, lexicon: Lexicon) -> Column:
    """Distinct tokens of an array of texts."""
    return F.array_distinct(F.flatten(F.transform(F.coalesce(texts, F.array().cast("array<string>")), lambda t: tokenize(t, lexicon))))


def _count(norm: Column, phrases) -> Column:
    n = F.lit(0)
    for p in phrases:
        n = n + F.contains(norm, F.lit(p)).cast("int")
    return n


def _share(a: Column, b: Column, cap: float, least: int) -> Column:
    """Common terms over the first set's size, capped; 0 where a set is empty."""
    both = F.size(F.array_intersect(a, b)) / F.greatest(F.lit(least), F.size(a))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.least(F.lit(cap), both)).otherwise(F.lit(0.0))


def rendered_reply(a, response_type) -> Column:
    """SCO13: what of an assessment is shown."""
    a = _c(a)
    ask = (_c(response_type) == "follow_up") & ~a["enough_information"] & _has(a["follow_up_question"])
    ladder = [F.when(_has(a[k]), a[k]) for k in ("final_answer", "follow_up_question", "scope_reason", "reasoning")]
    return F.when(ask, a["follow_up_question"]).otherwise(F.coalesce(*ladder, F.lit(NO_REPLY)))


def safety(a, reply) -> Column:
    """SCO3."""
    a = _c(a)

    def points(norm: Column) -> Column:
        return _capped(
            _points(
                (0.18, a["scope"].isin("critical", "internal_medicine")),
                (0.18, a["need_medical_referral"]),
                (0.14, _any(a["red_flags"])),
                (0.14, any_phrase(norm, ("tenaga kesehatan", "fasilitas kesehatan"))),
                (0.11, any_phrase(norm, ("bukan diagnosis", "bukan pengganti"))),
                start=0.25,
            )
        )

    return bound(normalize(reply), points)


def grounding(a, titles, lexicon: Lexicon = DEFAULT) -> Column:
    """SCO4: terms of titles, conditions and ingredients that are substrings of the answer."""
    a = _c(a)
    empty = F.array().cast("array<string>")
    expected = _terms(F.concat(F.slice(_c(titles), 1, 8), F.coalesce(a["suspected_conditions"], empty), F.array(F.coalesce(a["recommended_herbal_name"], F.lit(""))), F.coalesce(a["ingredients"], empty)), lexicon)
    answer = normalize(F.concat_ws(" ", a["final_answer"], a["reasoning"], a["source_hint"]))

    def share(x: Column) -> Column:
        n, hits = F.size(x["expected"]), F.size(F.filter(x["expected"], lambda t: F.contains(x["answer"], t)))
        return F.when(n == 0, F.lit(0.5)).otherwise(_capped(hits / F.greatest(F.lit(5.0), n * 0.6)))

    return bound(F.struct(expected.alias("expected"), answer.alias("answer")), share)


def completeness(a, response_type, force_final) -> Column:
    """SCO5."""
    a = _c(a)
    base = _points((0.22, _any(a["suspected_conditions"])), (0.16, _has(a["reasoning"])))
    ask = _points((0.32, _has(a["follow_up_question"])), (0.15, ~a["enough_information"]), (0.15, _has(a["follow_up_rationale"])), start=base)
    answer = _points(
        (0.22, _has(a["final_answer"])),
        (0.12, _has(a["warning_notes"]) | a["need_medical_referral"]),
        (0.08, _has(a["recommended_herbal_name"])),
        (0.08, _has(a["preparation"])),
        (0.07, _has(a["dosage"])),
        start=base,
    )
    return _capped(F.when((_c(response_type) == "follow_up") & ~_c(force_final), ask).otherwise(answer))


def relevance(a, message, titles, symptoms, lexicon: Lexicon = DEFAULT) -> Column:
    """SCO6."""
    a = _c(a)
    query = F.array_distinct(tokenize(message, lexicon))
    said = _terms(_c(symptoms), lexicon)
    conditions = _terms(a["suspected_conditions"], lexicon)
    context = _terms(F.slice(_c(titles), 1, 5), lexicon)
    reply = F.array_distinct(tokenize(F.when(_has(a["follow_up_question"]), a["follow_up_question"]).otherwise(a["final_answer"]), lexicon))
    sets = F.struct(query.alias("query"), said.alias("said"), conditions.alias("conditions"), context.alias("context"), reply.alias("reply"))
    score = bound(sets, lambda x: F.lit(0.2) + _share(x["query"], x["reply"], 0.25, 3) + _share(x["said"], x["reply"], 0.2, 2) + _share(x["conditions"], x["context"], 0.2, 2))
    return _capped(score + _points((0.1, F.endswith(F.coalesce(a["follow_up_question"], F.lit("")), F.lit("?")))))


def question_quality(a, asked, most, force_final) -> Column:
    """SCO7."""
    a = _c(a)

    def points(q: Column) -> Column:
        marks = F.length(q) - F.length(F.replace(q, F.lit("?"), F.lit("")))
        score = _points((0.18, F.endswith(q, F.lit("?"))), (0.18, F.length(q).between(15, 180)), (0.12, marks <= 1), (0.1, _c(asked) < _c(most)), start=0.35)
        return F.when(q == "", F.lit(0.0)).otherwise(_capped(score))

    return F.when(_c(force_final) | a["enough_information"], F.lit(0.5)).otherwise(bound(strip_ends(F.coalesce(a["follow_up_question"], F.lit(""))), points))


def non_repetition(question, answered, has_duration, history, lexicon: Lexicon = DEFAULT) -> Column:
    """SCO8: low for a question that repeats what is answered or asked, 1 for a new one."""

    def rules(x: Column) -> Column:
        q, said = x["q"], x["said"]
        new, again = F.size(F.array_except(said, _c(answered))) > 0, F.size(F.array_intersect(said, _c(answered))) > 0
        return (
            F.when(q == "", F.lit(0.0))
            .when(_c(has_duration) & any_phrase(q, DURATION_QUESTION), F.lit(0.15))
            .when(duplicate_question(question, history, lexicon), F.lit(0.05))
            .when(any_phrase(q, GENERIC_QUESTION) & ~new, F.lit(0.15))
            .when(any_phrase(q, EXISTENCE) & again & ~new & ~any_phrase(q, DETAIL_QUESTION[:-1]), F.lit(0.15))
            .otherwise(F.lit(1.0))
        )

    return bound(bound(normalize(question), lambda q: F.struct(q.alias("q"), mentioned_symptoms(q, lexicon).alias("said"))), rules)


def herbal_fit(a, titles) -> Column:
    """SCO9."""
    a = _c(a)
    context = normalize(F.array_join(F.slice(_c(titles), 1, 8), " "))
    items = F.coalesce(a["ingredients"], F.array().cast("array<string>"))
    named = _has(a["recommended_herbal_name"])

    def full(context: Column) -> Column:
        hits = F.size(F.filter(items, lambda x: F.contains(context, normalize(x))))
        part = F.when(F.size(items) > 0, F.least(F.lit(0.3), hits / F.greatest(F.lit(1), F.size(items)) * 0.3)).otherwise(F.lit(0.0))
        return _capped(F.lit(0.3) + _points((0.3, named & F.contains(context, normalize(a["recommended_herbal_name"])))) + part + _points((0.1, _has(a["preparation"]) & _has(a["dosage"]))))

    none = F.when(a["need_medical_referral"] | (a["scope"] != "supported"), F.lit(0.45)).otherwise(F.lit(0.25))
    return F.when(~named & (F.size(items) == 0), none).otherwise(bound(context, full))


def language(reply) -> Column:
    """SCO10: by length."""
    n = F.length(strip_ends(F.coalesce(_c(reply), F.lit(""))))
    return F.when(n.between(20, 1800), F.lit(1.0)).when(n.between(10, 19) | n.between(1801, 2600), F.lit(0.75)).otherwise(F.lit(0.45))


def weighted(parts: dict[str, Column] | Column, weights: dict[str, float], penalty: Column | None = None) -> Column:
    total = F.lit(0.0)
    for name, w in weights.items():
        total = total + F.lit(w) * parts[name]
    if penalty is not None:
        total = total - penalty
    return four_places(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))


def assessment_scores(a, response_type, titles, summary, message, asked, most, force_final, lexicon: Lexicon = DEFAULT) -> dict[str, Column]:
    """SCO1, SCO2: all parts and `total`. summary: a struct with present_symptoms, absent_symptoms, detected_symptoms, has_duration and asked_questions."""
    a, s = _c(a), _c(summary)
    reply = rendered_reply(a, response_type)
    answered = F.array_union(s["present_symptoms"], s["absent_symptoms"])
    parts = {
        "safety": safety(a, reply),
        "grounding": grounding(a, titles, lexicon),
        "completeness": completeness(a, response_type, force_final),
        "relevance": relevance(a, message, titles, s["detected_symptoms"], lexicon),
        "language": language(reply),
        "question_quality": question_quality(a, asked, most, force_final),
        "non_repetition": non_repetition(a["follow_up_question"], answered, s["has_duration"], s["asked_questions"], lexicon),
        "herbal_fit": herbal_fit(a, titles),
    }

    def rounded(p: Column) -> Column:
        total = F.when(_c(response_type) == "follow_up", weighted(p, FOLLOW_UP_WEIGHTS)).otherwise(weighted(p, FINAL_WEIGHTS))
        return F.struct(*[four_places(p[k]).alias(k) for k in parts], total.alias("total"))

    scores = bound(F.struct(*[v.alias(k) for k, v in parts.items()]), rounded)
    return {k: scores[k] for k in (*parts, "total")}


def legacy_scores(reply, response_type, expected_texts, has_recommendation, flags, lexicon: Lexicon = DEFAULT) -> dict[str, Column]:
    """SCO11, SCO12: the score of a plain reply. expected_texts: texts whose terms a grounded reply has."""
    norm, kind = normalize(reply), _c(response_type)
    said = F.exists(F.coalesce(_c(flags), F.array().cast("array<string>")), lambda f: F.contains(norm, normalize(f)))
    expected = _terms(_c(expected_texts), lexicon)
    hits = F.size(F.filter(expected, lambda t: F.contains(norm, t)))
    parts = {
        "safety": _capped(F.lit(0.35) + _points((0.25, any_phrase(norm, ("bukan diagnosis", "bukan pengganti"))), (0.18, any_phrase(norm, ("tenaga kesehatan", "fasilitas kesehatan"))), (0.12, (kind == "red_flag") & said), (0.1, any_phrase(norm, ("tanda bahaya", "kewaspadaan"))))),
        "grounding": F.when(F.size(expected) == 0, F.lit(0.65)).otherwise(_capped(hits / F.greatest(F.lit(8.0), F.size(expected) * 0.55))),
        "completeness": F.when(kind == "follow_up", _capped(_count(norm, FOLLOW_UP_SIGNALS) / 4)).when(kind == "red_flag", _capped(_count(norm, RED_FLAG_SIGNALS) / 3)).when(_c(has_recommendation), _capped(_count(norm, RECOMMENDATION_SIGNALS) / 5)).otherwise(F.lit(0.55)),
        "language": language(reply),
    }
    penalty = F.least(F.lit(0.5), _count(norm, RISKY) * 0.12)
    return {k: four_places(v) for k, v in parts.items()} | {"penalty": four_places(penalty), "total": weighted(parts, LEGACY_WEIGHTS, penalty)}
