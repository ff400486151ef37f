"""Generated training data: health topics, diseases, anamneses, preparations and catalogue records as chat rows.

Every generator crosses records with small literal tables of variants and fills the texts of their kind. Ids follow
from record and variant, so rows can be generated anew in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dataset_wording as wording
from ..functions.text import blocks, bullet_list, limit_text, template, translate_label
from .curate import expand, pick, rotate


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _filled(text) -> Column:
    return F.nullif(_c(text), F.lit(""))


def _first(items, n: int) -> Column:
    return F.slice(F.coalesce(_c(items), F.array().cast("array<string>")), 1, n)


def _numbered(items) -> Column:
    return F.array_join(F.transform(_c(items), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def by_kind(kind, texts: dict[str, str], **columns) -> Column:
    """The template of a kind, that of the empty kind for others."""
    out = template(texts[""], **columns) if "" in texts else F.lit(None).cast("string")
    for k, text in texts.items():
        out = F.when(_c(kind) == k, template(text, **columns)).otherwise(out) if k else out
    return out


def chat(system: Column, user: Column, assistant: Column) -> Column:
    """A chat of three messages."""
    return F.array(*[F.struct(F.lit(r).alias("role"), t.alias("content")) for r, t in (("system", system), ("user", user), ("assistant", assistant))])


def _literal(spark, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def topic_records(topics: DataFrame, groups: dict[str, str], phrases: dict[str, str], words: dict[str, str]) -> DataFrame:
    """Five records of each health topic, one for each variant.

    topics: id, title, url, groups, related, institute, summary (text), symptoms, warning_signs, prevention_steps,
    screening_questions. groups, phrases and words translate labels; groups without a translation in lower case.
    """
    t = expand(topics, _literal(topics.sparkSession, [(v,) for v in wording.VARIANTS], "variant string"))
    table = F.create_map(*[F.lit(x) for kv in groups.items() for x in kv]) if groups else None
    translated = translate_label("title", phrases, words)
    named = F.transform(_first("groups", 3), lambda g: F.coalesce(F.try_element_at(table, g), F.lower(g)) if table is not None else F.lower(g))
    title = F.when((translated == "") | (F.lower(translated) == F.lower("title")), F.col("title")).otherwise(F.concat(translated, F.lit(" / "), F.col("title")))
    parts = dict(title=title, group=F.array_join(named, ", "), excerpt=limit_text("summary", 560), related=F.coalesce(_filled(F.array_join(F.transform(_first("related", 4), lambda r: translate_label(r, phrases, words)), ", ")), F.lit(wording.NO_RELATED)))
    warnings = F.coalesce(_filled(F.array_join(_first("warning_signs", 3), ", ")), F.lit(wording.NO_WARNINGS))
    return t.select(
        F.concat_ws("_", F.lit("medlineplus"), F.col("id"), "variant").alias("id"),
        "variant",
        F.concat(F.coalesce(_filled(translated), F.col("title")), F.lit(" - "), by_kind("variant", wording.TOPIC_LABEL)).alias("topic"),
        title.alias("formula_name"),
        "symptoms",
        F.lit(wording.TOPIC_SAFETY).alias("safety_notes"),
        F.lit("clinical_guideline_reference").alias("evidence_level"),
        F.concat(F.lit("MedlinePlus - "), "title").alias("source_title"),
        F.col("url").alias("source_url"),
        F.lit("disease_guidance").alias("content_type"),
        by_kind("variant", wording.OVERVIEW, **parts).alias("overview"),
        template(wording.TOPIC_DIAGNOSIS, group=parts["group"], institute=F.coalesce(_filled("institute"), F.lit(wording.INSTITUTE))).alias("diagnosis_summary"),
        "prevention_steps",
        "warning_signs",
        "screening_questions",
        by_kind("variant", wording.CARE, title=title, warnings=warnings).alias("care_recommendation"),
    )


def topic_answer() -> Column:
    """Overview, questions, warning signs, prevention and care of a record, those that it has."""
    lists = {"questions": "screening_questions", "warnings": "warning_signs", "prevention": "prevention_steps"}
    wanted = {k: F.size(_first(c, 1)) > 0 for k, c in lists.items()} | {k: _filled(F.trim(c)).isNotNull() for k, c in (("overview", "overview"), ("care", "care_recommendation"))}
    return blocks(wording.TOPIC_ANSWER, wanted, overview=F.trim("overview"), care=F.trim("care_recommendation"), questions=_numbered(_first("screening_questions", 5)), warnings=bullet_list(_first("warning_signs", 5)), prevention=bullet_list(_first("prevention_steps", 5)))


def topic_chats(records: DataFrame) -> DataFrame:
    """A chat row of each topic record."""
    title = F.coalesce(_filled("formula_name"), _filled("topic"), F.lit("topik kesehatan"))
    # the variant's last word decides, so `follow_up` and `self_care` have the general texts, as the ids end in `up` and `care`
    kind = F.substring_index("id", "_", -1)
    return records.select("id", F.lit("medlineplus_guidance_dataset").alias("source"), chat(by_kind(kind, wording.SYSTEM), by_kind(kind, wording.QUESTION, title=title), topic_answer()).alias("messages"))


def disease_answer(focus, audience) -> Column:
    """An answer about the disease record of a row, by focus: prevention, or triage with the focus's own opening."""
    name = F.coalesce(_filled("formula_name"), _filled("topic"), F.lit(wording.DISEASE))
    care = F.coalesce(_filled("care_recommendation"), _filled("safety_notes"), F.lit(""))
    some = lambda c: F.size(_first(c, 1)) > 0
    steps = F.when(some("prevention_steps"), bullet_list(_first("prevention_steps", 5))).otherwise(wording.NO_PREVENTION)
    prevention = blocks(wording.PREVENTION_ANSWER, {"warnings": some("warning_signs")}, audience=_c(audience), disease=name, steps=steps, warnings=bullet_list(_first("warning_signs", 3)), care=care)
    wanted = {"overview": _filled("overview").isNotNull(), "symptoms": some("symptoms"), "questions": some("screening_questions"), "warnings": some("warning_signs"), "diagnosis": _filled("diagnosis_summary").isNotNull()}
    triage = blocks(
        wording.TRIAGE_ANSWER,
        wanted,
        focus=by_kind(focus, wording.FOCUS),
        audience=_c(audience),
        disease=F.lower(name),
        overview=F.col("overview"),
        symptoms=F.array_join(_first("symptoms", 5), ", "),
        questions=bullet_list(_first("screening_questions", 4)),
        warnings=bullet_list(_first("warning_signs", 4)),
        diagnosis=F.col("diagnosis_summary"),
        care=care,
    )
    return F.when(_c(focus) == "prevention", prevention).otherwise(triage)


def variant_chats(records: DataFrame, audiences: dict[str, str], tasks: dict[str, tuple[str, str]], system: dict[str, str], answer, name: str = "formula_name", keep: list[str] = ()) -> DataFrame:
    """X21, X23, JN16: a chat row of each record, audience and task.

    audiences: id -> wording. tasks: id -> (focus, question with places {name} and {audience}). system: prompts by
    focus, the empty key for others. answer(focus, audience) gives the answer of a row as a column.
    """
    spark = records.sparkSession
    rows = expand(records, _literal(spark, list(audiences.items()), "audience_id string, audience string"), _literal(spark, [(k, f) for k, (f, _) in tasks.items()], "task_id string, focus string"))
    asked = by_kind("task_id", {k: q for k, (_, q) in tasks.items()}, name=F.col(name), audience=F.col("audience"))
    messages = chat(by_kind("focus", system), asked, answer("focus", "audience"))
    return rows.select(F.concat_ws("_", F.lit("sft"), "id", "audience_id", "task_id").alias("id"), F.col("id").alias("source_record_id"), F.concat_ws("_", "audience_id", "task_id").alias("variant"), "focus", *keep, messages.alias("messages"))


def complaint(profile, duration, severity, intent, number) -> Column:
    """An anamnesis record's complaint in a user's words: two of its symptoms by number, or its condition."""
    symptoms, n = F.coalesce(F.col("primary_symptoms"), F.array().cast("array<string>")), _c(number)
    one, two = F.coalesce(pick(symptoms, n), F.col("suspected_condition")), pick(symptoms, n + 1)
    said = F.when((F.size(symptoms) > 1) & (two != "") & (two != one), F.concat(one, F.lit(" dan "), two)).otherwise(one)
    return template(wording.COMPLAINT, profile=_c(profile), symptoms=said, duration=_c(duration), severity=_c(severity), intent=_c(intent))


def anamnesis_answer(number, openings: list[str], closings: list[str]) -> Column:
    """Questions and danger signs of an anamnesis record, rotated by number, six and three at most."""
    texts = lambda items: F.array(*[F.lit(x) for x in items])
    return template(
        wording.ANAMNESIS,
        opening=pick(texts(openings), number),
        condition=F.col("suspected_condition"),
        questions=bullet_list(F.slice(rotate("required_questions", number), 1, 6)),
        flags=bullet_list(F.slice(rotate("red_flag_questions", number), 1, 3)),
        action=F.col("triage_action"),
        closing=pick(texts(closings), number),
        sources=F.array_join(_first("source_titles", 3), "; "),
    )


def catalog_chats(records: DataFrame, system: str, answer) -> DataFrame:
    """Two chat rows of each catalogue record: its complaint, and how it is made. answer(focus) gives the answer of a row as a column."""
    kinds = _literal(records.sparkSession, [("", "sft"), ("dosis", "sft_dosis")], "focus string, prefix string")
    rows = expand(records, kinds)
    symptoms = F.coalesce(_filled(F.array_join(F.coalesce("symptoms", F.array().cast("array<string>")), ", ")), _filled("topic"), F.lit(wording.CATALOG_COMPLAINT))
    asked = by_kind("focus", wording.CATALOG, symptoms=symptoms, formula=F.coalesce(_filled("formula_name"), F.lit(wording.CATALOG_FORMULA)))
    return rows.select(F.concat_ws("_", "prefix", "id").alias("id"), F.col("id").alias("source_record_id"), chat(F.lit(system), asked, answer("focus")).alias("messages"))
