import pytest
from pyspark.sql import functions as F

from quillspark.functions import wording
from quillspark.functions.text import DISCLAIMER
from quillspark.operators import replies as R


def ask(one, present, absent=(), history=(), duration=False, safety=False, detail=False):
    answered = {"duration": F.lit(duration), "safety": F.lit(safety), "detail": F.lit(detail)}
    c = R.candidate_questions("p", "a", answered)
    return one(R.pick_question(c, F.array_union("p", "a"), F.lit(duration), F.lit(detail), "h"), p=list(present), a=list(absent), h=list(history))


def test_follow_up_order(one):
    first = ask(one, ["demam", "sakit kepala"])
    assert first == R.QUESTIONS[0]["ask"]
    second = ask(one, ["demam", "sakit kepala"], history=[first])
    assert second == R.QUESTIONS[1]["ask"]
    assert ask(one, ["demam", "sakit kepala"], history=[first], duration=True, safety=True).startswith("Suhu tertinggi berapa")
    assert ask(one, [], duration=True, safety=True, detail=True) == R.LAST_QUESTION
    assert ask(one, ["mual"]) == R.QUESTIONS[1]["ask"]


def test_case_question(one):
    assert one(R.case_question("q", "s", F.lit(True), F.lit(False)), q=["Sejak kapan mual?", "Apakah ada batuk?"], s=[]) == "Apakah ada batuk?"
    assert one(R.case_question("q", "s", F.lit(True), F.lit(False)), q=["Sejak kapan mual?"], s=[]) == R.CASE_QUESTION


def test_texts(one, spark):
    assert one(R.answered_context("p", "a", "d", "s"), p=["demam"], a=[], d="2 hari", s=["x"]) == "gejala ada: demam; durasi: 2 hari; slot terjawab: x"
    assert one(R.answered_context("p", "a", "d", "s"), p=[], a=[], d="", s=[]) == "-"
    assert one(R.temperature_reply(F.lit(89.0))) == wording.TEMPERATURE.replace("{value}", "89").replace("{question}", wording.TEMPERATURE_ASK)
    assert one(R.red_flag_reply("f"), f=["darah", "sesak"]).startswith("Saya mendeteksi tanda yang perlu diwaspadai: darah, sesak. Untuk") and one(R.out_of_scope_reply()).endswith(DISCLAIMER)
    assert one(R.quick_replies("k", {"a": ["x"]}), k="b") == [] and one(R.quick_replies("k"), k="red_flag")[2] == "Mulai sesi baru"
    df = spark.createDataFrame([([("m", "r"), ("n", "s")],)], "c array<struct<model:string,reply:string>>")
    assert [x.reply for x in df.select(R.with_question("c", F.lit("n"), F.lit("?")).alias("c")).first().c] == ["r", "?"]


SUMMARY = "keluhan_ringan string, present_symptoms array<string>, detected_symptoms array<string>, absent_symptoms array<string>, duration_text string, has_duration_signal boolean, has_intensity_signal boolean, has_progression_signal boolean, has_safety_clearance_signal boolean"
CARD = "keluhan_ringan string, ramuan string, bahan array<string>, cara_pengolahan string, dosis_penggunaan string, catatan_kewaspadaan string, sumber_ringkas string"
ASSESSMENT = "suspected_conditions array<string>, follow_up_question string, follow_up_rationale string, red_flags array<string>, reasoning string, final_answer string, warning_notes string, scope_reason string"
CONTEXTS = "array<struct<type:string,title:string,score:double,evidence_level:string>>"


@pytest.fixture
def row(spark):
    """row(**parts): a table of one row of structs."""
    def build(s=None, r=None, a=None, c=None):
        kinds = {"s": SUMMARY, "r": CARD, "a": ASSESSMENT}
        schema = ", ".join(f"{k} struct<{', '.join(x.strip().replace(' ', ':', 1) for x in v.split(','))}>" for k, v in kinds.items()) + f", c {CONTEXTS}"
        return spark.createDataFrame([(s, r, a, c)], schema)

    return build


FULL = ("mual", ["demam", "mual", "batuk", "pusing", "lemas"], ["x"], ["sesak"], "2 hari", True, False, True, True)
BARE = (None, [], [], [], None, False, False, False, False)
TEA = ("mual ringan", "teh jahe", ["jahe", "madu"], "cuci; rebus", "2x", "alergi", "buku")


def test_summaries_and_contexts(row):
    got = row(FULL, c=[("case", f"t{i}", 0.5 + i / 10, "high" if i else None) for i in range(6)]).select(R.summary_text("s"), R.patient_summary("s", F.lit("?")), R.context_sources("c")).first()
    assert got[0] == "- Keluhan: mual\n- Gejala terdeteksi: demam, mual, batuk, pusing, lemas\n- Gejala yang sudah disangkal: sesak\n- Durasi: 2 hari\n- Detail intensitas/perburukan: sudah ada\n- Safety check: ada klarifikasi tanda bahaya"
    assert got[1] == "Keluhan yang sudah saya catat: demam, mual, batuk, pusing. Durasi: 2 hari. Gejala yang sudah kamu sangkal: sesak. Sebagian tanda bahaya sudah kamu jawab tidak ada."
    assert got[2] == "\n".join(["- case:t0 (score=0.5)"] + [f"- case:t{i} (score={0.5 + i / 10}, evidence=high)" for i in range(1, 5)])
    bare = row(BARE).select(R.summary_text("s"), R.patient_summary("s", F.lit("dugaan")), R.context_sources("c")).first()
    assert bare[0] == "- Keluhan: -\n- Gejala terdeteksi: -\n- Gejala yang sudah disangkal: -\n- Durasi: belum jelas\n- Detail intensitas/perburukan: belum jelas\n- Safety check: belum ada klarifikasi tanda bahaya eksplisit"
    assert bare[1] == "Keluhan yang sudah saya catat: dugaan. Tanda bahaya belum lengkap tersaring." and bare[2] == "- Tidak ada konteks tambahan."
    assert row().select(R.summary_text("s")).first()[0] == wording.NO_SUMMARY


def test_recommendation_replies(row):
    df = row(FULL, TEA, (["dbd", "tifus"], "Q?", None, [], "sebab", None, None, None), [("herb", "jahe", 0.9, None)])
    detail, thanks, card, final = df.select(R.preparation_detail_reply("r"), R.feedback_reply(F.lit("not_helpful"), "r"), R.recommendation_reply("r", "c", "s"), R.assessed_reply("a", "r", "c", "s")).first()
    assert detail.startswith("Detail cara pengolahan teh jahe:\nBahan yang dipakai: jahe, madu.\n\nLangkah pengolahan:\n1. cuci\n2. rebus\n\nDosis/kisaran penggunaan: 2x\nCatatan kewaspadaan: alergi\n\nGunakan") and detail.endswith("tidak cocok.\n\n" + DISCLAIMER)
    assert thanks.startswith("Terima kasih, saya catat bahwa rekomendasi teh jahe belum membantu")
    assert "sebagai 'mual ringan' selama" in card and "Ramuan: teh jahe\nBahan: jahe, madu\nCara pengolahan: cuci; rebus\n" in card and "Konteks RAG yang dipakai:\n- herb:jahe (score=0.9)\n\n" in card
    blocks = final.split("\n\n")
    assert blocks[1] == "Dugaan kondisi yang paling mungkin saat ini: dbd, tifus." and blocks[2] == "Pertimbangan utama: sebab" and blocks[3].startswith("Untuk saat ini keluhan lebih mengarah ke dbd, tifus,")
    assert blocks[4].startswith("Rekomendasi ramuan herbal awal:\nRamuan: teh jahe") and blocks[6] == f"Catatan keselamatan: {wording.ASSESSED_WARNING}" and blocks[7] == DISCLAIMER
    none = row(BARE).select(R.preparation_detail_reply("r"), R.feedback_reply(F.lit("helpful"), "r"), R.feedback_reply(F.lit(None).cast("string"), "r"), R.assessed_reply("a", "r", "c", "s")).first()
    assert none[0] == wording.NO_CARD and "rekomendasi rekomendasi tadi membantu" in none[1] and none[2] == wording.FEEDBACK[""] and wording.ASSESSED_NO_RECOMMENDATION in none[3]


def test_follow_up_and_clarification(row, one):
    df = row(BARE, a=(["dbd"], "Bisa cerita?", None, ["darah"], None, None, None, None))
    reply, question = R.follow_up_response("a", F.lit("demam ringan"), "s", F.array().cast("array<string>"), F.lit("Sejak kapan demam?"), F.lit(2))
    got = df.select(reply, question, R.better_follow_up("a", F.lit("demam ringan"), "s", F.array().cast("array<string>"), F.lit("Sejak kapan demam?")).alias("b")).first()
    assert got[1] == "Sejak kapan demam?" and got.b.suspected_conditions == ["demam ringan", "dbd"] and got.b.follow_up_rationale == wording.REPLACED_WHY
    assert got[0].startswith("Baik, saya tangkap dulu ya. Keluhan yang sudah saya catat: demam ringan, dbd.") and "Tanda yang tetap perlu diwaspadai: darah." in got[0] and "Tahap anamnesis: 2/3. " in got[0]
    kept = row(BARE, a=(["dbd"], "Sejak kapan demam muncul?", "r", [], None, None, None, None)).select(question).first()[0]
    assert kept == "Sejak kapan demam muncul?"
    none = row(BARE).select(reply, question).first()
    assert none[0].startswith("Baik, saya tangkap keluhan kamu sementara mengarah ke 'demam ringan'.") and "1. Sejak kapan demam?\n\nJawab" in none[0] and none[1] == "Sejak kapan demam?"
    last = R.follow_up_response("a", F.lit(None).cast("string"), "s", F.array().cast("array<string>"), F.lit("x"), F.lit(1))
    assert tuple(row(BARE).select(*last).first()) == (wording.LAST_CLARIFICATION, wording.LAST_CLARIFICATION_ASK)
    assert "rujukan anamnesis: WHO." in one(R.case_follow_up_reply(F.lit("mual"), "q", F.lit("WHO")), q=["a?"]) and "rujukan" not in one(R.case_follow_up_reply(F.lit("mual"), "q", F.lit("")), q=["a?"])
    text, ask = R.clarification("h")
    assert one(text, h=[]) == wording.CLARIFY_NOTHING and one(ask, h=[]) == wording.CLARIFY_ASK
    assert wording.EXPLAINED[1][1] in one(text, h=["a?", "Berapa suhu?"]) and one(ask, h=["a?", "Berapa suhu?"]) == "Berapa suhu?"
    assert [one(R.explained(F.lit(q))) for q in ("Ada sesak?", "skala?", "sejak?", "apa?")] == [wording.EXPLAINED[i][1] for i in (0, 2, 3, 4)]


def test_referral_and_guidance(row, spark):
    a = lambda *conditions, why=None, warn=None: (list(conditions), None, None, [], None, None, warn, why)
    got = row(FULL, a=a("scope model: x")).select(R.referral_reply("a", "s")).first()[0]
    assert got.startswith(f"Baik, dari cerita kamu sejauh ini, keluhan lebih aman diposisikan sebagai {wording.SUSPECTED_MODEL}.\n\nAlasannya: gejala seperti demam, mual, batuk perlu") and wording.REFERRAL_WARNING in got
    got = row(BARE, a=a("dbd", why="scope model: critical", warn="Herbal tidak diposisikan; tanda bahaya")).select(R.referral_reply("a", "s")).first()[0]
    assert "sebagai dbd." in got and "gejala seperti keluhan yang kamu sebutkan perlu" in got and wording.WATCH in got
    got = row(FULL).select(R.referral_reply("a", "s")).first()[0]
    assert wording.SUSPECTED_FEVER in got and f"Alasannya: {wording.REFERRAL_DEFAULT_REASON}\n" in got and wording.REFERRAL_DEFAULT_WARNING in got
    kinds = "d struct<formula_name:string,symptoms:array<string>,screening_questions:array<string>,warning_signs:array<string>,prevention_steps:array<string>,care_recommendation:string,diagnosis_summary:string,overview:string>, n struct<suspected_condition:string,required_questions:array<string>,red_flag_questions:array<string>,triage_action:string>"
    df = spark.createDataFrame([(("DBD", ["a", "b", "c", "d", "e", "f"], [], ["w"], ["p"], "", "lab", "o"), ("x", ["q1", "q2", "q3", "q4", "q5"], [], "ke dokter")), (None, None)], kinds)
    full, none = (r[0] for r in df.select(R.guidance_reply("d", "n", F.lit(None).cast("struct<" + ",".join(x.strip().replace(" ", ":", 1) for x in SUMMARY.split(",")) + ">"))).collect())
    assert full.split("\n\n")[1].endswith("mengarah ke 'DBD'.") and "terkait: a, b, c, d, e.\n\nRingkasan singkat: o\n\nHal yang perlu dipastikan lebih lanjut:\n- q1\n- q2\n- q3\n- q4\n\nTanda bahaya" in full and "Arahan awal: ke dokter\n\n" in full
    assert none.split("\n\n")[:2] == ["Ringkasan anamnesis:\n" + wording.NO_SUMMARY, wording.GUIDANCE["title"].replace("{title}", wording.GUIDANCE_TITLE)] and f"Arahan awal: {wording.GUIDANCE_CARE}" in none and none.endswith(DISCLAIMER)


def test_token_budgets():
    assert [R.token_budget(k) for k in ("follow_up", "recommendation", "red_flag", "feedback")] == [240, 640, 120, 220]
    assert R.token_budget("follow_up", {"follow_up": 0}) == 1 and R.token_budget("x", {"default": 9}) == 9


def test_generate_with_fallback(spark):
    backend = R.Replay({("a", "p"): "x " * 3000, ("z", "p"): "spare"})
    df = spark.createDataFrame([("1", "follow_up", "p")], "request string, response_type string, prompt string")
    got = {r.model: r for r in R.generate(df, backend, ["a", "b"], "z").collect()}
    assert len(got["a"].reply.split()) == 240 and (got["b"].provider, got["b"].reply) == ("z", "spare")
    assert R.generate(df, backend, ["b"]).first().status == "error"
