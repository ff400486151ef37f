import json
import random
import time

import pandas as pd
import pytest

from quillspark.functions import signals
from quillspark.streaming import chat

NAMES = [x.split()[0] for x in chat.TURN.split(", ")]
ASK = "Apakah ada sesak, nyeri hebat, atau perdarahan?"


def turn(session, number, message, **more):
    base = dict.fromkeys(NAMES) | {"session_id": session, "turn": number, "message": message, "n_hits": 3, "best_score": 0.5, "scope": "supported", "enough": False, "question": f"{ASK} {number}"}
    return {**base, **more}


CASES = {
    "plain": [turn("plain", 1, "saya mual", question=ASK, suspected=["maag", "a", "b", "c"]), turn("plain", 2, "tidak ada", question="Sejak kapan mual muncul?"), turn("plain", 3, "sejak kemarin, makin berat", final_suspected=["gastritis"], recommendation="teh jahe"), turn("plain", 4, "jelaskan cara membuat ramuan"), turn("plain", 5, "kurang cocok"), turn("plain", 6, "saya sesak")],
    "flag": [turn("flag", 1, "demam tinggi dan sesak"), turn("flag", 2, "bukan sesak")],
    "scope": [turn("scope", 1, "halo", n_hits=0), turn("scope", 2, "halo", best_score=0.2), turn("scope", 3, "halo saja", best_score=0.3, scope="unsupported")],
    "confused": [turn("confused", 1, "maksudnya bagaimana"), turn("confused", 2, "batuk", question=ASK), turn("confused", 3, "bingung"), turn("confused", 4, "suhu 89 derajat")],
    "refer": [turn("refer", 1, "batuk", scope="critical", suspected=["tb"]), turn("refer", 2, "batuk lagi", scope=None, question=None), turn("refer", 3, "batuk", refer=True)],
    "budget": [turn("budget", i, f"pegal {i}", question=f"Pertanyaan nomor {w}?", suspected=[]) for i, w in enumerate(("satu", "dua", "tiga", "empat"), 1)],
    "referred at the end": [turn("referred at the end", 1, "batuk", enough=True, final_scope="internal_medicine", final_suspected=["x"]), turn("referred at the end", 2, None)],
}


def test_routes():
    facts, got = chat.Facts(), {}
    for name, rows in CASES.items():
        session = chat.Session()
        got[name] = []
        for r in rows:
            known = r | {"normalized": signals.normalize_literal(r["message"] or ""), "wants_detail": "cara membuat" in (r["message"] or ""), "feedback": "not_helpful" if "kurang cocok" in (r["message"] or "") else None, "confused": any(p in (r["message"] or "") for p in signals.CONFUSION), "bad_temperature": "89" in (r["message"] or "")}
            out = chat.step(session, pd.Series(known), facts)
            got[name].append((out["response_type"], out["stage"], out["question_count"], out["completed"]))
    assert got["plain"] == [
        ("follow_up", "anamnesis_follow_up_1", 1, False),
        ("follow_up", "anamnesis_follow_up_2", 2, False),
        ("recommendation", "final_recommendation", 2, True),
        ("preparation_detail", "preparation_detail_after_recommendation", 2, True),
        ("feedback", "recommendation_feedback", 2, True),
        ("recommendation", "final_recommendation", 2, True),
    ]
    assert [g[0] for g in got["flag"]] == ["red_flag", "red_flag"] and got["flag"][0][1:] == ("red_flag_guardrail", 0, True)
    assert [g[0] for g in got["scope"]] == ["out_of_scope"] * 3
    assert [g[0] for g in got["confused"]] == ["clarification", "follow_up", "clarification", "clarification"] and [g[2] for g in got["confused"]] == [0, 1, 1, 1]
    assert [g[0] for g in got["refer"]] == ["medical_referral", "follow_up", "medical_referral"]
    assert [g[0] for g in got["budget"]] == ["follow_up"] * 3 + ["recommendation"]
    assert got["referred at the end"][0][:2] == ("medical_referral", "medical_referral")


@pytest.mark.parametrize("files", [1, 100])
def test_stream_gives_the_same_in_any_batches(spark, tmp_path, files):
    rows = [r for turns in CASES.values() for r in turns]
    for k in range(1, 7):
        part = [tuple(r[n] for n in NAMES) for r in rows if r["turn"] == k]
        spark.createDataFrame(part, chat.TURN).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(chat.TURN).option("maxFilesPerTrigger", files).parquet(str(tmp_path / "in"))
    chat.run_chat(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out" / "responses"))
    by = {}
    for r in got.orderBy("session_id", "turn").collect():
        by.setdefault(r.session_id, []).append(r)
    assert [r.response_type for r in by["plain"]] == ["follow_up", "follow_up", "recommendation", "preparation_detail", "feedback", "recommendation"]
    assert by["plain"][0].suspected == ["maag", "a", "b"] and by["plain"][2].suspected == ["gastritis"] and by["plain"][3].recommendation == "teh jahe" and by["plain"][4].feedback == "not_helpful"
    assert by["flag"][0].red_flags[:2] == ["demam tinggi", "sesak napas"] and by["confused"][2].question == ASK
    assert got.count() == len(rows) and spark.read.parquet(str(tmp_path / "out" / "feedback")).count() == 1
    asked = chat.feedback_rows(spark.read.parquet(str(tmp_path / "in")), got).collect()
    assert [(r.session_id, r.feedback_label, r.user_message, r.recommendation, r.status) for r in asked] == [("plain", "not_helpful", "kurang cocok", "teh jahe", "pending_review")]


def test_remembered_phrases_are_those_of_the_whole_text():
    """Phrases across messages, denials and patterns count as if all that was said stood in one text."""
    rng, facts = random.Random(4), chat.Facts()
    words = ["tidak ada", "demam", "tinggi", "sesak", "sejak", "3", "hari", "ke", "mual", "nyeri", "hebat", "bukan", "dada", "selama", "kurang lebih dua puluh", "minggu", "tidak", "makin berat", "batuk", "darah"]
    for _ in range(200):
        session, said = chat.Session(), []
        for _ in range(rng.randrange(1, 12)):
            message = " ".join(rng.choices(words, k=rng.randrange(4)))
            session.say(message, facts)
            if message and (not said or said[-1] != message):
                said.append(message)
            session.notes = [chat._plain(chat.SAFETY_NOTE)] if rng.random() < 0.3 else []
            assert session.everything(facts) == facts.known(" ".join((*said, *session.notes)))


def test_state_is_as_large_as_the_lexicon():
    facts, session = chat.Facts(), chat.Session()
    for i in range(300):
        session.say(f"saya demam tinggi hari ke {i}", facts)
    assert len(session.tail.split()) <= facts.reach and len(session.known.seen) < 20


def test_batch_gives_what_the_stream_gives(spark, tmp_path):
    rows = [tuple(r.get(n) for n in NAMES) for turns in CASES.values() for r in turns] + [tuple(turn("plain", 7, None, event="clear")[n] for n in NAMES), tuple(turn("plain", 8, "saya mual")[n] for n in NAMES)]
    spark.createDataFrame(rows, chat.TURN).coalesce(1).write.parquet(str(tmp_path / "in"))
    table = spark.read.parquet(str(tmp_path / "in"))
    chat.run_chat(spark.readStream.schema(chat.TURN).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out" / "responses")).drop("batch")
    key = lambda r: (r.session_id, r.turn)
    assert sorted(got.collect(), key=key) == sorted(chat.chat_batch(table).collect(), key=key)
    assert [(r.response_type, r.question_count) for r in sorted(got.where("session_id = 'plain' and turn > 6").collect(), key=key)] == [("cleared", 0), ("follow_up", 1)]


def test_idle_sessions_close_and_leave_no_state(spark, tmp_path):
    spark.createDataFrame([tuple(r[n] for n in NAMES) for r in (turn("a", 1, "saya mual"), turn("b", 1, "batuk"), turn("c", 1, None, event="clear"))], chat.TURN).coalesce(1).write.parquet(str(tmp_path / "in"))
    client = json.dumps({"turns": [{"role": "user", "content": "saya mual sejak kemarin"}], "question_count": 2, "suspected_conditions": ["x"] * 5})
    query = chat.run_chat(spark.readStream.schema(chat.TURN).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"), idle_ms=1500, once=False)
    try:
        deadline, closed, most = time.time() + 90, set(), 0
        while time.time() < deadline and (closed != {"a", "b"} or rows):
            time.sleep(1)
            progress = query.lastProgress
            rows = progress["stateOperators"][0]["numRowsTotal"] if progress and progress["stateOperators"] else 1
            most = max(most, rows)
            if (tmp_path / "out" / "responses").exists():
                closed = {r.session_id for r in spark.read.schema(chat.OUT).parquet(str(tmp_path / "out" / "responses")).where("response_type = 'closed'").collect()}
    finally:
        query.stop()
    assert closed == {"a", "b"} and rows == 0
    again = chat.restored(json.loads(client), chat.Facts())
    assert (again.question_count, again.suspected, again.stage) == (2, ["x"] * 3, "initial") and "mual" in again.known.seen
    late = chat.chat_batch(spark.createDataFrame([tuple(turn("d", 1, "tidak ada", client=client)[n] for n in NAMES)], chat.TURN)).first()
    assert late.question_count == 3 and late.stage == "anamnesis_follow_up_3"
