import pytest
from pyspark.sql import functions as F

from quillspark.functions import signals as S
from quillspark.functions.text import normalize


@pytest.fixture
def analyzed(spark):
    def run(text):
        return S.analyze(spark.createDataFrame([(text,)], "text string")).first()

    return run


def test_red_flags(analyzed):
    assert analyzed("tidak ada demam tinggi dan tidak sesak").red_flags == []
    assert {"demam tinggi", "sesak napas"} <= set(analyzed("saya demam tinggi dan sesak").red_flags)
    assert "demam tinggi" in analyzed("ruam merah disertai demam tinggi").red_flags
    assert analyzed("saya gatal gatal dan timbul ruam merah").red_flags == []
    assert analyzed("juga sesak").red_flags == [] and analyzed("tekanan darah").red_flags != []
    assert analyzed(None).red_flags == [] and analyzed("").detected_symptoms == []


def test_slots_and_duration(analyzed):
    r = analyzed("saya sedang sakit kepala dan disertai demam sudah 3 hari")
    assert {"demam", "sakit kepala"} <= set(r.present_symptoms) and r.duration_text == "sudah 3 hari" and not r.has_intensity_signal
    assert "durasi sudah disebut: sudah 3 hari" in r.answered_slots and "gejala disebut ada: demam" in r.answered_slots
    assert not analyzed("saya sedang mengalami demam dan sakit kepala sudah 2 hari").has_intensity_signal
    assert analyzed("tidak batuk tapi batuk").absent_symptoms == ["batuk"]
    assert analyzed("hari ke 3 demam").duration_text == "hari ke 3"
    assert "case_009" in analyzed("gatal dan bentol").hinted_case_ids


@pytest.mark.parametrize(
    "make,text,want",
    [
        (lambda c: S.invalid_temperature(normalize(c)), "suhu tertinggi 89 derajad", 89.0),
        (lambda c: S.invalid_temperature(normalize(c)), "suhu tertinggi 39 derajat", None),
        (lambda c: S.invalid_temperature(normalize(c)), "37.55 derajat", 55.0),
        (lambda c: S.confused(normalize(c)), "maksud anda gimana saya tidak mengerti", True),
        (lambda c: S.feedback_label(c), "Pengolahan kurang jelas tapi membantu", "unclear_preparation"),
        (lambda c: S.feedback_label(c), "kurang membantu", "not_helpful"),
        (lambda c: S.feedback_label(c), "sangat bermanfaat", "helpful"),
        (lambda c: S.feedback_label(c), "halo", None),
        (lambda c: S.asks_preparation_detail(c), "jelaskan cara membuat", True),
        (lambda c: S.low_quality_question(c), "Sejak kapan demam?", False),
        (lambda c: S.low_quality_question(c), "Apa warna favorit?", True),
        (lambda c: S.is_ascii(c), "abc é", False),
        (lambda c: S.excluded_title(c, ["vaccine"]), "Vaccines", True),
        (lambda c: S.missing_model(c), "HTTP 404: model not found", True),
        (lambda c: S.cited_evidence(c), "see pubmed", True),
        (lambda c: S.mentioned_symptoms(normalize(c)), "Apakah ada batuk atau pusing?", ["batuk", "sakit kepala"]),
        (lambda c: S.contextual_note(F.lit("tidak ada"), c), "Apakah ada sesak atau pingsan?", S.SAFETY_NOTE),
        (lambda c: S.contextual_note(F.lit("tidak ada"), c), "Apakah ada ruam?", S.FEVER_NOTE),
        (lambda c: S.contextual_note(F.lit("ada"), c), "Apakah ada sesak?", None),
    ],
)
def test_guards(one, make, text, want):
    assert one(make(F.col("v")), v=text) == want


def test_contextual_note_clears_safety(analyzed):
    r = analyzed("demam\n" + S.SAFETY_NOTE)
    assert r.has_safety_clearance_signal and r.red_flags == []


def test_duplicate_questions(one):
    q = "Seberapa berat rasa nyeri perut yang muncul sekarang?"
    assert one(S.duplicate_question("v", "h"), v=q, h=[q.upper()]) and one(S.duplicate_question("v", "h"), v="Seberapa berat nyeri perut muncul sekarang?", h=[q])
    assert not one(S.duplicate_question("v", "h"), v="Apakah ada batuk?", h=[q]) and not one(S.duplicate_question("v", "h"), v="x", h=[])


def test_repetitive_questions(one):
    def f(q, answered, duration=False, intensity=False):
        return one(S.repetitive_question("v", "a", F.lit(duration), F.lit(intensity)), v=q, a=answered)

    assert f("Sejak kapan demam?", [], duration=True) and not f("Sejak kapan demam?", [])
    assert f("Apakah ada demam?", ["demam"]) and not f("Apakah ada demam tinggi?", ["demam"]) and not f("Apakah ada batuk?", ["demam"])
    assert f("Ada keluhan lain?", []) and f("Suhu berapa?", [], intensity=True) and f("", [])


def test_flow_predicates(one):
    assert one(S.names_match("a", "b"), a="Jahe madu hangat", b="madu jahe") and not one(S.names_match("a", "b"), a="jahe", b="kunyit")
    assert one(S.supports_flow(F.lit(1), F.array().cast("array<string>"), F.array().cast("array<string>"), F.lit(0.28)))
    assert not one(S.supports_flow(F.lit(0), F.array(F.lit("x")), F.array().cast("array<string>"), F.lit(0.9)))
    assert one(S.force_final(F.lit("supported"), F.lit(2), F.lit(True), F.lit(True), F.lit(True), F.lit(False)))
    assert not one(S.force_final(F.lit("supported"), F.lit(1), F.lit(True), F.lit(True), F.lit(True), F.lit(False)))
    assert one(S.needs_referral(F.lit("critical"), F.lit(False))) and not one(S.needs_referral(F.lit(None).cast("string"), F.lit(None).cast("boolean")))
    assert one(S.asks_follow_up(F.lit(None).cast("string"), F.lit(None).cast("boolean"), F.lit(None).cast("string"), F.lit(2)))
    message = F.struct(F.lit("user").alias("role"), F.lit("x").alias("content"))
    reply = F.struct(F.lit("assistant").alias("role"), F.lit("y").alias("content"))
    assert one(S.valid_chat(F.array(message, reply))) and not one(S.valid_chat(F.array(message, message))) and one(S.valid_chat(F.lit(None).cast("array<struct<role:string,content:string>>"))) is False
    assert one(S.recommendation_allowed("v", ["aconite"]), v=["Jahe", "Aconite root"]) is False
