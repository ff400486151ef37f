"""Follow-up questions, replies and responses of a dialogue as columns (TOP7, ST8, X2, X3, X7, X9-X11, UD3)."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from functools import reduce
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import wording
from ..functions.lexicon import DEFAULT, Lexicon
from ..functions.signals import duplicate_question, low_quality_question, needs_immediate_safety, repetitive_question
from ..functions.text import any_phrase, blocks, bullet_list, normalize, null_if_blank, preparation_steps, template


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# Follow-up questions by priority, and when each is a candidate: symptoms that must all be present,
# symptoms of which one must be present, one that must not be denied, and what must still be unanswered.
QUESTIONS = (
    dict(ask="Saat ini apakah ada sesak, nyeri hebat, perdarahan, muntah terus, lemas sekali, pingsan, atau keluhan terasa cepat memburuk?", unanswered=("safety",), immediate=True),
    dict(ask="Sejak kapan keluhan ini mulai terasa, dan sejak muncul apakah makin berat, naik-turun, atau cenderung menetap?", unanswered=("duration",)),
    dict(ask="Suhu tertinggi berapa, dan apakah disertai nyeri belakang mata, ruam/bintik merah, muntah, kaku leher, atau sangat lemas?", all=("demam", "sakit kepala")),
    dict(ask="Ruamnya berupa bintik merah biasa atau seperti perdarahan, dan apakah ada mimisan, gusi berdarah, muntah, atau lemas berat?", all=("demam", "ruam")),
    dict(ask="Apakah menelan terasa sangat sakit, ada bercak putih di amandel, atau suara serak yang makin berat?", all=("demam", "sakit tenggorokan")),
    dict(ask="Apakah ada sesak, sulit menelan ludah, bengkak leher, atau demam tinggi yang masih menetap?", all=("demam", "sakit tenggorokan")),
    dict(ask="Apakah ada batuk, pilek, nyeri badan, atau pembesaran amandel yang terasa jelas?", all=("demam", "sakit tenggorokan")),
    dict(ask="Apakah sakit tenggorokan terasa lebih berat saat menelan, dan adakah bercak putih, batuk, atau pilek?", all=("sakit tenggorokan",), not_denied="demam"),
    dict(ask="Apakah ada sesak, suara bindeng berat, sulit menelan, atau air liur terasa sulit ditelan?", all=("sakit tenggorokan",), not_denied="demam"),
    dict(ask="Suhu tertinggi berapa, demamnya naik-turun atau menetap, dan apakah ada menggigil, ruam, muntah, atau sangat lemas?", all=("demam",)),
    dict(ask="Sakit kepala terasa di bagian mana, seberapa berat, dan apakah ada penglihatan kabur, muntah, kaku leher, atau lemah satu sisi?", all=("sakit kepala",)),
    dict(ask="Sejak kapan ruam muncul, apakah menyebar, melepuh, nyeri, atau ada bengkak wajah/bibir?", any=("gatal", "ruam"), unanswered=("duration",)),
    dict(ask="Apakah ruam melebar, terasa nyeri/melepuh, atau ada bengkak wajah, bibir, lidah, atau sesak?", any=("gatal", "ruam")),
    dict(ask="Batuknya kering atau berdahak, dan apakah ada sesak, nyeri dada, darah, atau demam tinggi?", all=("batuk",)),
    dict(ask="Dari skala 1 sampai 10, seberapa mengganggu keluhan ini, dan apa yang membuatnya membaik atau memburuk?", unanswered=("detail",)),
    dict(ask="Apakah ada tanda bahaya seperti sesak, nyeri hebat, perdarahan, dehidrasi, pingsan, atau keluhan cepat memburuk?", unanswered=("safety",)),
)
LAST_QUESTION = "Gejala apa yang paling mengganggu sekarang, dan apakah ada tanda bahaya yang belum kamu sebutkan?"
CASE_QUESTION = "Apakah keluhan makin berat, menyebar, atau muncul tanda bahaya yang belum kamu sebutkan?"


def candidate_questions(present, absent, answered: dict[str, Column], case_question=None, questions=QUESTIONS) -> Column:
    """TOP7: the questions that a conversation calls for, by priority. answered: duration, safety and detail as conditions."""
    p, a = _c(present), _c(absent)
    out = []
    for q in questions:
        when = F.lit(True)
        for s in q.get("all", ()):
            when = when & F.array_contains(p, s)
        if q.get("any"):
            when = when & F.arrays_overlap(p, F.array(*[F.lit(s) for s in q["any"]]))
        if q.get("not_denied"):
            when = when & ~F.array_contains(a, q["not_denied"])
        for s in q.get("unanswered", ()):
            when = when & ~answered[s]
        if q.get("immediate"):
            when = when & needs_immediate_safety(p)
        out.append(F.when(when, F.lit(q["ask"])))
    return F.array_compact(F.array(*out, *([_c(case_question)] if case_question is not None else []), F.lit(LAST_QUESTION)))


def pick_question(candidates, answered_symptoms, has_duration, has_intensity, history, lexicon: Lexicon = DEFAULT) -> Column:
    """TOP7: the first candidate that repeats neither an answer nor a question of the history; the last candidate if none does."""
    c = _c(candidates)
    good = F.filter(c, lambda q: ~repetitive_question(q, answered_symptoms, has_duration, has_intensity, lexicon) & ~duplicate_question(q, history, lexicon))
    return F.coalesce(F.get(good, 0), F.get(c, F.size(c) - 1))


def case_question(questions, answered_symptoms, has_duration, has_intensity, lexicon: Lexicon = DEFAULT) -> Column:
    """The case's first question that repeats no answer."""
    return F.coalesce(F.get(F.filter(_c(questions), lambda q: ~repetitive_question(q, answered_symptoms, has_duration, has_intensity, lexicon)), 0), F.lit(CASE_QUESTION))


def answered_context(present, absent, duration, slots) -> Column:
    """What is answered, in one line; a dash if nothing is."""
    def part(label: str, items) -> Column:
        return F.when(F.size(_c(items)) > 0, F.concat(F.lit(label), F.array_join(_c(items), ", ")))

    parts = F.array_compact(F.array(part("gejala ada: ", present), part("gejala tidak ada: ", absent), F.concat(F.lit("durasi: "), null_if_blank(duration)), part("slot terjawab: ", F.slice(_c(slots), 1, 8))))
    return F.when(F.size(parts) > 0, F.array_join(parts, "; ")).otherwise(F.lit("-"))


def _filled(text) -> Column:
    """A text, null if it is empty."""
    return F.nullif(_c(text), F.lit(""))


def _listed(items, most: int | None = None) -> Column:
    """Items joined by commas, null if there are none."""
    c = _c(items)
    return F.when(F.size(c) > 0, F.array_join(F.slice(c, 1, most) if most else c, ", "))


def _either(first, second) -> Column:
    """An array, or another one where it is null or empty."""
    return F.when(F.size(_c(first)) > 0, _c(first)).otherwise(_c(second))


def _numbered(items) -> Column:
    return F.array_join(F.transform(_c(items), lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s)), "\n")


def context_sources(contexts, most: int = 5) -> Column:
    """The first contexts (type, title, score, evidence_level) as a list."""
    def line(x) -> Column:
        level = F.coalesce(F.concat(F.lit(", evidence="), _filled(x["evidence_level"])), F.lit(""))
        return F.concat(F.lit("- "), x["type"], F.lit(":"), x["title"], F.lit(" (score="), x["score"].cast("string"), level, F.lit(")"))

    c = _c(contexts)
    return F.when(F.size(c) > 0, F.array_join(F.transform(F.slice(c, 1, most), line), "\n")).otherwise(F.lit(wording.NO_CONTEXTS))


def summary_text(s) -> Column:
    """A summary (keluhan_ringan, present_symptoms, detected_symptoms, absent_symptoms, duration_text and the has_... signals) as a list."""
    s = _c(s)

    def by(flag: Column, texts: tuple[str, str]) -> Column:
        return F.when(F.coalesce(flag, F.lit(False)), texts[0]).otherwise(texts[1])

    text = template(
        wording.SUMMARY,
        complaint=F.coalesce(_filled(s["keluhan_ringan"]), F.lit("-")),
        present=F.coalesce(_listed(_either(s["present_symptoms"], s["detected_symptoms"])), F.lit("-")),
        absent=F.coalesce(_listed(s["absent_symptoms"]), F.lit("-")),
        duration=F.coalesce(_filled(s["duration_text"]), by(s["has_duration_signal"], wording.SUMMARY_DURATION)),
        detail=by(F.coalesce(s["has_intensity_signal"], F.lit(False)) | F.coalesce(s["has_progression_signal"], F.lit(False)), wording.SUMMARY_DETAIL),
        safety=by(s["has_safety_clearance_signal"], wording.SUMMARY_SAFETY),
    )
    return F.when(s.isNull(), wording.NO_SUMMARY).otherwise(text)


def patient_summary(s, suspected) -> Column:
    """What a patient has said, in sentences."""
    s = _c(s)
    duration = F.coalesce(_filled(s["duration_text"]), F.when(s["has_duration_signal"], wording.PATIENT_DURATION))
    symptoms = F.coalesce(_listed(_either(s["present_symptoms"], s["detected_symptoms"]), 4), _c(suspected))
    parts = [template(wording.PATIENT["symptoms"], symptoms=symptoms), F.when(duration.isNotNull(), template(wording.PATIENT["duration"], duration=duration))]
    parts.append(F.when(F.size(s["absent_symptoms"]) > 0, template(wording.PATIENT["absent"], absent=_listed(s["absent_symptoms"], 4))))
    parts.append(F.when(F.coalesce(s["has_safety_clearance_signal"], F.lit(False)), wording.PATIENT_SAFETY[0]).otherwise(wording.PATIENT_SAFETY[1]))
    return F.array_join(F.array_compact(F.array(*parts)), " ")


def _card(r: Column) -> dict[str, Column]:
    return dict(name=r["ramuan"], items=F.array_join(r["bahan"], ", "), preparation=r["cara_pengolahan"], dose=r["dosis_penggunaan"], care=r["catatan_kewaspadaan"], source=r["sumber_ringkas"])


def preparation_detail_reply(r) -> Column:
    """ST8: how to prepare a recommendation (ramuan, bahan, cara_pengolahan, dosis_penggunaan, catatan_kewaspadaan, sumber_ringkas); a hint where there is none."""
    r = _c(r)
    steps = _numbered(preparation_steps(r["cara_pengolahan"], default=wording.NO_STEPS))
    return F.when(r.isNull(), wording.NO_CARD).otherwise(template(wording.PREPARATION_DETAIL, **(_card(r) | {"items": F.coalesce(_listed(r["bahan"]), F.lit(wording.NO_ITEMS)), "steps": steps})))


def feedback_reply(label, r) -> Column:
    """ST8: thanks for feedback on a recommendation, which may be null."""
    name = F.coalesce(_c(r)["ramuan"], F.lit(wording.FEEDBACK_NAME))
    out = template(wording.FEEDBACK[""])
    for k, text in wording.FEEDBACK.items():
        out = F.when(_c(label) == k, template(text, name=name)).otherwise(out) if k else out
    return out


def recommendation_reply(r, contexts, summary) -> Column:
    """ST8: a recommendation with its complaint (keluhan_ringan), contexts and a summary."""
    r = _c(r)
    return template(wording.RECOMMENDATION, summary=summary_text(summary), complaint=r["keluhan_ringan"], contexts=context_sources(contexts), **_card(r))


def follow_up_reply(a, summary, number, most: int = 3) -> Column:
    """ST8: the question of an assessment (suspected_conditions, follow_up_question, follow_up_rationale, red_flags)."""
    a, s = _c(a), _c(summary)
    suspected = F.coalesce(_filled(s["keluhan_ringan"]), _listed(a["suspected_conditions"], 3), F.lit(wording.FOLLOW_UP_SUSPECTED))
    flags = F.when(F.size(a["red_flags"]) > 0, template(wording.FOLLOW_UP_FLAGS, flags=_listed(a["red_flags"], 4))).otherwise(wording.FOLLOW_UP_NO_FLAGS)
    question, why = F.coalesce(_filled(a["follow_up_question"]), F.lit(wording.FOLLOW_UP_ASK)), F.coalesce(_filled(a["follow_up_rationale"]), F.lit(wording.FOLLOW_UP_WHY))
    return template(wording.FOLLOW_UP, patient=patient_summary(s, suspected), question=question, why=why, flags=flags, number=_c(number).cast("string"), most=F.lit(str(most)))


def case_follow_up_reply(complaint, questions, source=None) -> Column:
    """ST8: up to six questions of a case, with the title of their source."""
    cited = F.coalesce(template(wording.CASE_SOURCE, source=_c(source)), F.lit("")) if source is not None else F.lit("")
    cited = F.when(_filled(source).isNotNull(), cited).otherwise("") if source is not None else cited
    return template(wording.CASE_FOLLOW_UP, complaint=_c(complaint), questions=_numbered(F.slice(_c(questions), 1, 6)), source=cited)


def assessed_reply(a, r, contexts, summary) -> Column:
    """ST8: the final answer of an assessment, with its recommendation or the word that there is none."""
    a, r = _c(a), _c(r)
    suspected = F.coalesce(_listed(a["suspected_conditions"], 3), F.lit(wording.ASSESSED_SUSPECTED))
    card = F.when(r.isNull(), wording.ASSESSED_NO_RECOMMENDATION).otherwise(template(wording.ASSESSED["recommendation"], **_card(r)))
    return blocks(
        wording.ASSESSED | {"recommendation": "{card}"},
        {},
        summary=summary_text(summary),
        suspected=suspected,
        reasoning=F.coalesce(_filled(a["reasoning"]), F.lit(wording.ASSESSED_REASONING)),
        final=F.coalesce(_filled(a["final_answer"]), template(wording.ASSESSED_FINAL, suspected=suspected)),
        card=card,
        contexts=context_sources(contexts),
        warning=F.coalesce(_filled(a["warning_notes"]), F.lit(wording.ASSESSED_WARNING)),
    )


def red_flag_reply(flags) -> Column:
    """ST8: names the danger signs."""
    return template(wording.RED_FLAG, flags=F.array_join(_c(flags), ", "))


def out_of_scope_reply() -> Column:
    return F.lit(wording.OUT_OF_SCOPE)


def _has_all(text: Column, words) -> Column:
    return reduce(Column.__and__, [F.contains(text, F.lit(w)) for w in words])


def referral_reply(a, summary) -> Column:
    """X9, ST8: why and how to see a doctor, in a patient's words; a missing assessment is a critical one."""
    a, s = _c(a), _c(summary)
    symptoms = _either(s["present_symptoms"], s["detected_symptoms"])
    named = F.array_join(F.filter(F.slice(a["suspected_conditions"], 1, 3), lambda x: x != ""), ", ")
    fever = F.coalesce(F.exists(symptoms, lambda x: F.lower(x) == "demam"), F.lit(False))
    low = F.lower(F.coalesce(named, F.lit("")))
    suspected = (
        F.when(F.contains(low, F.lit("internal_medicine")) | F.contains(low, F.lit("scope model")), wording.SUSPECTED_MODEL)
        .when(low != "", named).when(fever, wording.SUSPECTED_FEVER).otherwise(wording.SUSPECTED_UNKNOWN)
    )
    reason = F.when(a.isNull(), F.lit(wording.REFERRAL_DEFAULT_REASON)).otherwise(F.trim(F.coalesce(_filled(a["scope_reason"]), _filled(a["reasoning"]), F.lit(""))))
    plain = template(wording.REFERRAL_REASON, symptoms=F.coalesce(_listed(symptoms, 3), F.lit(wording.REFERRAL_SYMPTOMS)))
    cleaned = reason
    for x, y in wording.REFERRAL_REWRITES.items():
        cleaned = F.replace(cleaned, F.lit(x), F.lit(y))
    reason = F.when((reason == "") | any_phrase(F.lower(reason), wording.REFERRAL_MODEL_WORDS), plain).otherwise(F.substring(cleaned, 1, 260))
    warning = F.when(a.isNull(), F.lit(wording.REFERRAL_DEFAULT_WARNING)).otherwise(F.trim(F.coalesce(_filled(a["warning_notes"]), F.lit(wording.REFERRAL_WARNING))))
    warning = F.when((warning == "") | _has_all(F.lower(warning), wording.WATCH_WORDS), wording.WATCH).otherwise(warning)
    return template(wording.REFERRAL, suspected=suspected, reason=reason, warning=warning)


def guidance_reply(disease, anamnesis, summary) -> Column:
    """ST8: guidance from a disease record (formula_name, symptoms, screening_questions, warning_signs, prevention_steps, care_recommendation, diagnosis_summary, overview) and an anamnesis record (suspected_condition, required_questions, red_flag_questions, triage_action); either may be null."""
    d, n = _c(disease), _c(anamnesis)
    questions = F.when(F.size(d["screening_questions"]) > 0, F.slice(d["screening_questions"], 1, 4)).otherwise(F.slice(n["required_questions"], 1, 4))
    warnings = F.when(F.size(d["warning_signs"]) > 0, F.slice(d["warning_signs"], 1, 4)).otherwise(F.slice(n["red_flag_questions"], 1, 3))
    prevention = F.slice(d["prevention_steps"], 1, 4)
    return blocks(
        wording.GUIDANCE,
        {"symptoms": F.size(d["symptoms"]) > 0, "overview": _filled(d["overview"]).isNotNull(), "questions": F.size(questions) > 0, "warnings": F.size(warnings) > 0, "diagnosis": _filled(d["diagnosis_summary"]).isNotNull(), "prevention": F.size(prevention) > 0},
        summary=summary_text(summary),
        title=F.coalesce(_filled(d["formula_name"]), _filled(n["suspected_condition"]), F.lit(wording.GUIDANCE_TITLE)),
        symptoms=_listed(d["symptoms"], 5),
        overview=d["overview"],
        questions=bullet_list(questions),
        warnings=bullet_list(warnings),
        diagnosis=d["diagnosis_summary"],
        prevention=bullet_list(prevention),
        care=F.coalesce(_filled(d["care_recommendation"]), _filled(n["triage_action"]), F.lit(wording.GUIDANCE_CARE)),
    )


def explained(question) -> Column:
    """A question in plain words, by the first list of terms of which it has one."""
    q = normalize(question)
    out = F.lit(wording.EXPLAINED[-1][1])
    for terms, text in reversed(wording.EXPLAINED[:-1]):
        out = F.when(any_phrase(q, terms), F.lit(text)).otherwise(out)
    return out


def clarification(asked) -> tuple[Column, Column]:
    """The reply to a message that asks what was meant, and the question that stays open: the last of those asked."""
    last = _filled(F.get(_c(asked), F.size(_c(asked)) - 1))
    return F.when(last.isNull(), wording.CLARIFY_NOTHING).otherwise(template(wording.CLARIFY, explained=explained(last), question=last)), F.coalesce(last, F.lit(wording.CLARIFY_ASK))


def temperature_reply(value) -> Column:
    """Asks for an impossible temperature again."""
    v = _c(value)
    text = F.when(v == F.floor(v), v.cast("bigint").cast("string")).otherwise(v.cast("string"))
    return template(wording.TEMPERATURE, value=text, question=F.lit(wording.TEMPERATURE_ASK))


def better_follow_up(a, case_complaint, summary, history, better) -> Column:
    """An assessment whose question is of low quality, repeats an answer or a question asked, with a better one (the column `better`), its reason, and the case's complaint first among three conditions."""
    a, s = _c(a), _c(summary)
    q = F.coalesce(a["follow_up_question"], F.lit(""))
    answered = F.array_union(s["present_symptoms"], s["absent_symptoms"])
    duration = F.coalesce(s["has_duration_signal"], F.lit(False)) | _filled(s["duration_text"]).isNotNull()
    replace = low_quality_question(q) | repetitive_question(q, answered, duration, F.coalesce(s["has_intensity_signal"], F.lit(False))) | duplicate_question(q, history)
    suspected = F.slice(F.array_distinct(F.array_compact(F.concat(F.array(_c(case_complaint)), F.slice(a["suspected_conditions"], 1, 3)))), 1, 3)
    new = a.withField("follow_up_question", _c(better)).withField("follow_up_rationale", F.lit(wording.REPLACED_WHY)).withField("suspected_conditions", suspected)
    return F.when(replace, new).otherwise(a)


def follow_up_response(a, case_complaint, summary, history, better, number, most: int = 3) -> tuple[Column, Column]:
    """(reply, question) of a follow-up: the assessment's question made better, else the case's, else a last clarification."""
    asked = _filled(_c(a)["follow_up_question"]).isNotNull()
    good = better_follow_up(a, case_complaint, summary, history, better)
    case = _c(case_complaint).isNotNull()
    reply = F.when(asked, follow_up_reply(good, summary, number, most)).when(case, case_follow_up_reply(case_complaint, F.array(_c(better)))).otherwise(wording.LAST_CLARIFICATION)
    return reply, F.when(asked, good["follow_up_question"]).when(case, _c(better)).otherwise(wording.LAST_CLARIFICATION_ASK)


def with_question(candidates, selected, question) -> Column:
    """Candidates (model, reply, ...) with the selected one's reply replaced."""
    return F.transform(_c(candidates), lambda c: F.when(c["model"] == _c(selected), c.withField("reply", _c(question))).otherwise(c))


def quick_replies(kind, table: dict[str, list[str]] = wording.QUICK_REPLIES) -> Column:
    """X11: short answers offered for a response type; none for others."""
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.array(*[F.lit(i) for i in v]))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), _c(kind)), F.array().cast("array<string>"))


#: Tokens of the offline backend: words with the white space after them.
_TOKEN = re.compile(r"\s*\S+\s*")


class Backend(Protocol):
    """UD3: answers prompts with up to `most` tokens; raises for a model that isn't there."""

    def answer(self, model: str, prompt: str, most: int) -> str: ...


class Replay:
    """An offline backend that answers from recorded (model, prompt) pairs."""

    def __init__(self, recorded: dict[tuple[str, str], str]):
        self.recorded = recorded

    def answer(self, model: str, prompt: str, most: int) -> str:
        if (model, prompt) not in self.recorded:
            raise LookupError(f"HTTP 404: model {model} not found")
        return "".join(itertools.islice(_TOKEN.findall(self.recorded[model, prompt]), most)).rstrip()


def token_budget(kind: str, overrides: dict[str, int] | None = None) -> int:
    """UD4: the most tokens of an answer by response type, one at least; other types have the default."""
    known = {k: max(int((overrides or {}).get(k, v)), 1) for k, v in wording.TOKENS.items()}
    return known.get(kind, known["default"])


def generate(prompts: DataFrame, backend: Backend, models: list[str], fallback: str | None = None, budgets: dict[str, int] | None = None) -> DataFrame:
    """UD3: (request, model, provider, status, reply, error): one row for each prompt (request, response_type, prompt) and model.

    The fallback model is asked only if a model isn't there; other errors become rows with status error.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for request, kind, prompt in zip(f["request"], f["response_type"], f["prompt"]):
                for m in models:
                    most = token_budget(kind, budgets)
                    try:
                        rows.append((request, m, m, "ok", backend.answer(m, prompt, most), None))
                    except Exception as error:
                        text = str(error)
                        if fallback and "http 404" in text.lower() and "not found" in text.lower():
                            try:
                                rows.append((request, m, fallback, "ok", backend.answer(fallback, prompt, most), None))
                                continue
                            except Exception as again:
                                text = str(again)
                        rows.append((request, m, m, "error", None, text))
            yield pd.DataFrame(rows, columns=["request", "model", "provider", "status", "reply", "error"])

    return prompts.select("request", "response_type", "prompt").mapInPandas(run, "request string, model string, provider string, status string, reply string, error string")
