import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quillspark.functions import parsing as P
from quillspark.functions import scoring as C


def parse(spark, raw):
    return spark.createDataFrame([(raw,)], "r string").select(P.assessment("r").alias("a")).first().a


def test_assessment_with_aliases_and_texts(spark):
    a = parse(spark, '<think>{"scope": 1}</think>```json\n{"scope": "Non-Critical, critical", "why": "w", "suspected": "flu; batuk", "enough": true, "question": "", "herbal": "Jahe", "ingredients": [" jahe ", ""], "refer": 0, "final": "ok"}\n```')
    assert (a.scope, a.scope_reason, a.reasoning, a.suspected_conditions, a.enough_information, a.follow_up_question) == ("supported", "w", "w", ["flu", "batuk"], True, None)
    assert (a.recommended_herbal_name, a.ingredients, a.need_medical_referral, a.final_answer, a.red_flags) == ("Jahe", ["jahe"], False, "ok", [])
    assert parse(spark, "no json") is None and parse(spark, None) is None and parse(spark, "{broken") is None
    assert parse(spark, '{"scope": "odd"}').scope == "unsupported"


def test_metrics(spark):
    local = json.dumps({"prompt_eval_count": 2589, "prompt_eval_duration": 61369769851, "eval_count": "598", "eval_duration": 55898318824, "model": "m", "total_duration": "x"})
    hosted = json.dumps({"model": "g", "usage": {"prompt_tokens": 110, "completion_tokens": 84, "total_tokens": 194, "prompt_tokens_details": {"cached_tokens": 12}, "completion_tokens_details": {"reasoning_tokens": 9}}, "choices": [{"finish_reason": "stop"}]})
    r = spark.createDataFrame([(local, hosted)], "l string, h string").select(P.local_metrics("l").alias("l"), P.hosted_metrics("h").alias("h")).first()
    assert (r.l.prompt_eval_rate_tps, r.l.eval_rate_tps, r.l.response_model, r.l.total_duration) == (42.19, 10.70, "m", None)
    assert (r.h.prompt_tokens, r.h.completion_tokens, r.h.total_tokens, r.h.cached_prompt_tokens, r.h.reasoning_tokens, r.h.finish_reason) == (110, 84, 194, 12, 9, "stop")


def test_content_and_formats(one):
    assert one(P.content_text("v"), v='[{"text": "a"}, "b", {"x": 1}]') == "ab" and one(P.content_text("v"), v='"plain"') == "plain" and one(P.content_text("v"), v="raw text") == "raw text"
    assert one(P.token_rate(F.lit(5), F.lit(0))) is None
    assert [one(P.format_latency(F.lit(x))) for x in (999, 1005, 41340)] == ["999 ms", "1.01 s", "41.34 s"]
    assert one(P.format_metrics(F.create_map(F.lit("b"), F.lit(2), F.lit("a"), F.lit(1)))) == "a=1; b=2"
    assert one(P.html_to_text("v"), v="<ul><li>a &amp; b</li><li>c</li></ul>") == "a & b; c;"


def test_pages_documents_and_monographs(spark):
    page = "<title> T  x</title><p>" + "long enough to be kept here" + "<p>short<script>var long = 'long enough to be kept here'</script>"
    r = spark.createDataFrame([(page,), (None,)], "h string").select(P.page_texts("h").alias("p"), P.summary_parts("h").alias("s")).collect()
    assert (r[0].p.title, r[0].p.text, r[0].s.paragraphs) == ("T x", "long enough to be kept here", ["long enough to be kept here", "short" + "var long = 'long enough to be kept here'"]) and r[1].p.text == ""
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Satu </w:t><w:t> dua</w:t></w:r></w:p><w:p/></w:body></w:document>')
    r = spark.createDataFrame([(bytearray(buffer.getvalue()),), (bytearray(b"x"),)], "f binary").select(P.docx_paragraphs("f").alias("d")).collect()
    assert [x.d for x in r] == [["Satu dua"], None]
    text = "Preface\n Herba Alpha \n\nDefinition\nfirst\n\nHerba Beta\n\nDefinition\nsecond"
    m = spark.createDataFrame([(text,)], "t string").select(P.monographs("t").alias("m")).first().m
    assert [x.title for x in m] == ["Herba Alpha", "Herba Beta"] and "first" in m[0].body and "second" not in m[0].body
    b = json.dumps({"name": "N", "blocks": [{"heading": "How safe", "description": "d"}]})
    assert spark.createDataFrame([(b,)], "t string").select(P.field_blocks("t", {"safety": "safe"}).alias("x")).first().x.safety == "d"


ASSESSMENT = dict(scope="supported", scope_reason="", suspected_conditions=["batuk"], reasoning="r", enough_information=False, follow_up_question="Apakah ada demam?", follow_up_rationale="x", red_flags=[], need_medical_referral=False, final_answer="", recommended_herbal_name="", ingredients=[], preparation="", dosage="", warning_notes="", source_hint="")


def scores(spark, kind="follow_up", summary=None, force=False, titles=("Batuk pilek",), **changes):
    a = ASSESSMENT | changes
    s = {"present_symptoms": [], "absent_symptoms": [], "detected_symptoms": [], "has_duration": False, "asked_questions": []} | (summary or {})
    schema = f"a struct<{C.ASSESSMENT.replace(' ', ':').replace(',:', ',')}>, s struct<present_symptoms:array<string>,absent_symptoms:array<string>,detected_symptoms:array<string>,has_duration:boolean,asked_questions:array<string>>, t array<string>, m string"
    df = spark.createDataFrame([(a, s, list(titles), "saya batuk")], schema)
    parts = C.assessment_scores("a", F.lit(kind), "t", "s", "m", F.lit(0), F.lit(3), F.lit(force))
    return df.select(*[v.alias(k) for k, v in parts.items()]).first().asDict()


def test_follow_up_scores(spark):
    x = scores(spark)
    assert (x["safety"], x["completeness"], x["question_quality"], x["non_repetition"], x["language"]) == (0.25, 1.0, 0.93, 1.0, 0.75)
    assert x["grounding"] == 0.0 and x["total"] == pytest.approx(sum(w * x[k] for k, w in C.FOLLOW_UP_WEIGHTS.items()), abs=1e-4)
    assert scores(spark, summary={"has_duration": True}, follow_up_question="Sejak kapan demam muncul?")["non_repetition"] == 0.15
    assert scores(spark, summary={"asked_questions": ["apakah ada demam"]})["non_repetition"] == 0.05
    assert scores(spark, summary={"present_symptoms": ["demam"]})["non_repetition"] == 0.15
    assert scores(spark, follow_up_question=None)["non_repetition"] == 0.0


def test_final_scores(spark):
    x = scores(spark, "recommendation", final_answer="Jahe batuk pilek, bukan diagnosis; ke tenaga kesehatan", recommended_herbal_name="Jahe", ingredients=["jahe"], preparation="p", dosage="d", enough_information=True, titles=["Jahe", "Batuk pilek"])
    assert x["safety"] == 0.5 and x["herbal_fit"] == 1.0 and x["total"] == pytest.approx(sum(w * x[k] for k, w in C.FINAL_WEIGHTS.items()), abs=1e-4)
    assert scores(spark, "recommendation", need_medical_referral=True)["herbal_fit"] == 0.45


def plan_of(spark, part):
    d = spark.createDataFrame([], f"a struct<{C.ASSESSMENT.replace(' ', ':').replace(',:', ',')}>, t array<string>")
    return d.select(part.alias("x"))._jdf.queryExecution().optimizedPlan().toString().lower()


def test_a_reply_is_normalised_once_and_not_for_each_term(spark):
    plan = plan_of(spark, C.grounding("a", "t"))
    assert "lambdafunction(contains(" in plan and "lambdafunction(contains(trim(" not in plan


def test_titles_are_normalised_once_and_not_for_each_ingredient(spark):
    plan = plan_of(spark, C.herbal_fit("a", "t"))
    assert "lambdafunction(contains(" in plan and "lambdafunction(contains(trim(" not in plan


def test_scores_are_added_and_rounded_as_binary_numbers(spark):
    parts = {"safety": 0.25, "grounding": 5 / 11, "completeness": 0.95, "relevance": 0.6875, "language": 1.0, "herbal_fit": 0.85}
    row = spark.createDataFrame([tuple(parts.values())], list(parts))
    assert row.select(C.weighted({k: F.col(k) for k in parts}, C.FINAL_WEIGHTS)).first()[0] == round(sum(w * parts[k] for k, w in C.FINAL_WEIGHTS.items()), 4) == 0.6042
    points = C._points(*[(v, F.lit(True)) for v in (0.22, 0.12, 0.08, 0.08, 0.07)], start=C._points((0.22, F.lit(True)), (0.16, F.lit(True))))
    assert row.select(points).first()[0] == 0.22 + 0.16 + 0.22 + 0.12 + 0.08 + 0.08 + 0.07 == 0.95


def test_legacy_score_of_a_safe_reply(spark):
    reply = "Ramuan jahe dengan bahan jahe dan madu, cara rebus, dosis dua kali, kewaspadaan alergi, sumber buku. Ini bukan diagnosis; hubungi tenaga kesehatan bila ada tanda bahaya. mual perut hangat"
    s = C.legacy_scores("r", F.lit("recommendation"), F.array(F.lit("jahe madu"), F.lit("mual perut")), F.lit(True), F.array().cast("array<string>"))
    r = spark.createDataFrame([(reply,)], "r string").select(*[v.alias(k) for k, v in s.items()]).first()
    assert r.total > 0.7 and r.safety > 0.6 and r.penalty == 0
