"""The routed chat as a stateful stream (ST1-ST3, ST6, ST7, X8): each user turn moves its session on.

What a single message tells is a column expression and computed before the fold. What the whole conversation tells
depends on the state: a session keeps which phrases of the lexicon were said or denied, not the texts, and of the
texts only the last words, where a phrase can still begin. So a turn costs the same however long its session is.
Models are outside: a turn brings the assessments that one has made of it, or nulls.

The state is a value and three lists of each session in RocksDB. It ends by a clear event, by a timer when the session has been
idle, and by its time to live. A client's copy of a session comes back as initial state or with a turn.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions import signals
from ..functions.lexicon import DEFAULT, Lexicon
from ..functions.signals import DUPLICATE, FEVER_NOTE, FEVER_TERMS, NEGATIVE_ANSWERS, SAFETY_NOTE, SAFETY_TERMS, SUPPORT, normalize_literal
from ..functions.text import normalize
from ..plans.session import ENDS, settings

MAX_QUESTIONS = 3
REMEMBERED = 8

#: Milliseconds after which an idle session is closed, and after which what was not written again goes in any case.
IDLE_MS = 6 * 3600 * 1000
TTL_MS = 7 * 24 * 3600 * 1000

#: What a turn brings: the message, the retrieval's results, and the assessments of a first and of a final call. An event `clear` removes the session; `client` is the client's copy of it as JSON.
TURN = "session_id string, turn bigint, message string, n_hits int, best_score double, complaint string, scope string, refer boolean, enough boolean, question string, suspected array<string>, final_scope string, final_refer boolean, final_suspected array<string>, recommendation string, event string, client string"
OUT = "session_id string, turn bigint, response_type string, stage string, question_count int, completed boolean, suspected array<string>, red_flags array<string>, question string, feedback string, recommendation string"


@dataclass
class Known:
    """What a text tells: phrases that it has, those of them that it denies somewhere, and whether it has a duration, a detail, a clearance."""

    seen: set[str] = field(default_factory=set)
    denied: set[str] = field(default_factory=set)
    told: set[str] = field(default_factory=set)

    def __or__(self, other: Known) -> Known:
        return Known(self.seen | other.seen, self.denied | other.denied, self.told | other.told)


class Facts:
    """Phrases of a lexicon in the text of a conversation."""

    def __init__(self, lexicon: Lexicon = DEFAULT):
        self.lexicon = lexicon
        hints = {h for hints in lexicon.hints.values() for h in hints}
        self.phrases = {*lexicon.red_flags, *hints, *(a for aliases in lexicon.symptoms.values() for a in aliases)}
        clearance = "(?:" + "|".join(map(re.escape, lexicon.clearances)) + ") (?:" + "|".join(map(re.escape, lexicon.red_flags)) + ")"
        words = (*lexicon.duration_words, *lexicon.intensity, *lexicon.progression)
        self.told = {
            "duration": re.compile("|".join((*lexicon.durations, *map(re.escape, lexicon.duration_words)))),
            "detail": re.compile("|".join(map(re.escape, (*lexicon.intensity, *lexicon.progression)))),
            "clearance": re.compile(clearance),
        }
        #: Words at the end of a text in which a phrase with its negation can begin; the duration patterns have six at most.
        self.reach = max(7, *(len(p.split()) for p in (*self.phrases, *words))) + max(len(n.split()) for n in (*lexicon.negations, *lexicon.clearances))

    def known(self, text: str) -> Known:
        seen = {p for p in self.phrases if p in text}
        denied = {p for p in seen if any(f"{n} {p}" in text for n in self.lexicon.negations)}
        return Known(seen, denied, {name for name, pattern in self.told.items() if pattern.search(text)})

    def red_flags(self, known: Known) -> list[str]:
        return list(dict.fromkeys(label for p, label in self.lexicon.red_flags.items() if p in known.seen - known.denied))

    def complaint(self, known: Known) -> bool:
        """A symptom that is present, or an asserted hint of a case."""
        present = (any(a in known.seen for a in aliases) and not any(a in known.denied for a in aliases) for aliases in self.lexicon.symptoms.values())
        return any(present) or any(h in known.seen - known.denied for hints in self.lexicon.hints.values() for h in hints)

    def tokens(self, text: str) -> set[str]:
        return {self.lexicon.synonyms.get(w, w) for w in text.split(" ") if len(w) > 2 and w not in self.lexicon.stopwords}


@dataclass
class Session:
    """The state of a session between turns."""

    known: Known = field(default_factory=Known)
    last: str = ""
    tail: str = ""
    notes: list[str] = field(default_factory=list)
    asked: list[str] = field(default_factory=list)
    suspected: list[str] = field(default_factory=list)
    question_count: int = 0
    stage: str = "initial"
    completed: bool = False
    recommendation: str | None = None

    def say(self, message: str, facts: Facts) -> None:
        """Adds a normalised message to what was said, unless it repeats the one before."""
        if message and message != self.last:
            text = f"{self.tail} {message}" if self.tail else message
            self.known |= facts.known(text)
            self.last, self.tail = message, " ".join(text.split(" ")[-facts.reach :])

    def everything(self, facts: Facts) -> Known:
        """What was said, and after it the notes."""
        return self.known | facts.known(" ".join(x for x in (self.tail, *self.notes) if x)) if self.notes else self.known

    def ask(self, question: str | None, facts: Facts) -> None:
        """Remembers a question, unless it repeats one of the last."""
        q = _plain(question)
        if not q:
            return
        words = facts.tokens(q)
        for before in map(_plain, self.asked):
            old = facts.tokens(before)
            common = len(words & old) / max(1, min(len(words), len(old)))
            if before and (before in q or q in before or (words and old and common >= DUPLICATE)):
                return
        self.asked = [*self.asked, question.strip()][-REMEMBERED:]


def restored(client: dict, facts: Facts) -> Session:
    """ST2: a session from the client's copy: turns (role, content), question_count, stage, completed, suspected_conditions, asked, recommendation."""
    session = Session(question_count=max(int(client.get("question_count") or 0), 0), stage=str(client.get("stage") or "initial"), completed=bool(client.get("completed")), recommendation=client.get("recommendation") or None)
    for turn in _items(client.get("turns")):
        if turn["role"] == "user":
            session.say(_plain(turn["content"]), facts)
    session.suspected = [str(x) for x in _items(client.get("suspected_conditions"))][:3]
    session.asked = [q for q in _items(client.get("asked")) if q and q.strip()][-REMEMBERED:]
    return session


def _items(values) -> list:
    return list(values) if values is not None else []


def _plain(text: str | None) -> str:
    return normalize_literal(text or "")


def _note(message: str, question: str) -> str | None:
    """FLT12: what a bare denial stands for."""
    if message not in NEGATIVE_ANSWERS:
        return None
    for terms, note in ((SAFETY_TERMS, SAFETY_NOTE), (FEVER_TERMS, FEVER_NOTE)):
        if any(t in question for t in terms):
            return _plain(note)
    return None


@dataclass
class Turn:
    """A turn with what is known of it; the guards below read it in order."""

    row: object
    session: Session
    facts: Facts
    known: Known = field(default_factory=Known)
    flags: list[str] = field(default_factory=list)

    def after_recommendation(self) -> bool:
        return self.session.completed and self.session.stage == "final_recommendation"

    def supported(self) -> bool:
        """FLT16."""
        return (self.row.n_hits or 0) > 0 and (self.facts.complaint(self.known) or (self.row.best_score or 0.0) >= SUPPORT)

    def refer(self) -> bool:
        return self.row.scope in ("critical", "internal_medicine") or self.row.refer is True

    def enough_known(self) -> bool:
        """FLT18."""
        s, told = self.session, self.known.told
        complete = (bool(self.row.complaint) or self.facts.complaint(self.known)) and {"duration", "clearance"} <= told
        return self.row.scope == "supported" and s.question_count > 0 and complete and ("detail" in told or s.question_count >= 2)

    def may_ask(self) -> bool:
        """FLT17."""
        r, left = self.row, self.session.question_count < MAX_QUESTIONS
        return left and (r.scope is None or (r.scope == "supported" and r.enough is not True and bool(r.question)))


def _closed(stage: str) -> Callable[[Turn], tuple]:
    def effect(t: Turn) -> tuple:
        t.session.stage, t.session.completed = stage, True
        return ()

    return effect


def _referred(t: Turn) -> tuple:
    t.session.stage, t.session.completed = "medical_referral", True
    return (("suspected", list(t.row.suspected if t.row.suspected is not None else [])),)


def _clarified(t: Turn) -> tuple:
    t.session.stage = "anamnesis_clarification"
    return (("question", t.session.asked[-1] if t.session.asked else None),)


def _asked(t: Turn) -> tuple:
    s = t.session
    s.question_count += 1
    s.suspected = list(t.row.suspected if t.row.suspected is not None else [])[:3]
    s.stage = f"anamnesis_follow_up_{s.question_count}"
    s.ask(t.row.question, t.facts)
    return (("question", t.row.question),)


def _final(t: Turn) -> tuple:
    s, r = t.session, t.row
    s.completed = True
    if r.final_scope in ("critical", "internal_medicine") or r.final_refer is True:
        s.stage = "medical_referral"
        return (("response_type", "medical_referral"), ("suspected", list(r.final_suspected if r.final_suspected is not None else [])))
    if r.final_suspected is not None and len(r.final_suspected):
        s.suspected = list(r.final_suspected)[:3]
    s.stage, s.recommendation = "final_recommendation", r.recommendation
    return (("recommendation", r.recommendation),)


#: ST1: the guards in their order: response type, condition, and effect on the session. Those before None see the message alone.
GUARDS: tuple = (
    ("preparation_detail", lambda t: t.after_recommendation() and t.row.wants_detail, lambda t: (("stage", "preparation_detail_after_recommendation"), ("recommendation", t.session.recommendation))),
    ("feedback", lambda t: t.after_recommendation() and t.row.feedback is not None, lambda t: (("stage", "recommendation_feedback"), ("feedback", t.row.feedback), ("recommendation", t.session.recommendation))),
    ("clarification", lambda t: t.row.confused, _clarified),
    ("clarification", lambda t: t.row.bad_temperature, lambda t: _clarified(t)[:0]),
    None,
    ("red_flag", lambda t: t.flags, lambda t: _closed("red_flag_guardrail")(t) + (("red_flags", t.flags),)),
    ("out_of_scope", lambda t: not t.supported(), _closed("out_of_scope")),
    ("recommendation", lambda t: t.session.question_count >= MAX_QUESTIONS, _final),
    ("medical_referral", Turn.refer, _referred),
    ("out_of_scope", lambda t: t.row.scope == "unsupported", _closed("out_of_scope")),
    ("recommendation", Turn.enough_known, _final),
    ("follow_up", Turn.may_ask, _asked),
    ("recommendation", lambda t: True, _final),
)


def step(session: Session, row, facts: Facts) -> dict:
    """One turn: changes the session and gives the row that answers it."""
    session.say(row.normalized or "", facts)
    turn = Turn(row, session, facts)
    out: dict = {"response_type": None}
    for guard in GUARDS:
        if guard is None:  # the message counts with all that was said, and a bare denial with what it denies
            note = _note(row.normalized or "", _plain(session.asked[-1]) if session.asked else "")
            if note and note not in session.notes:
                session.notes.append(note)
            turn.known = session.everything(facts)
            turn.flags = facts.red_flags(turn.known)
        elif guard[1](turn):
            out["response_type"] = guard[0]
            effect = dict(guard[2](turn))
            break
    return _answer(row.session_id, row.turn, session) | out | effect


def _answer(session_id: str, turn: int | None, session: Session) -> dict:
    return {"session_id": session_id, "turn": turn, "stage": session.stage, "question_count": session.question_count, "completed": session.completed, "suspected": session.suspected, "red_flags": [], "question": None, "feedback": None, "recommendation": None}


def _clean(f: pd.DataFrame) -> pd.DataFrame:
    """Nulls as None, whatever pandas made of them."""
    return f.astype(object).where(f.notna(), None)


def _fold(session: Session | None, frames: Iterator[pd.DataFrame], facts: Facts) -> tuple[Session | None, list[dict]]:
    """The turns of a session in their order; None: no session before, or none left."""
    out = []
    for r in _clean(pd.concat(list(frames)).sort_values("turn", kind="stable")).itertuples(index=False):
        if r.event == "clear":
            session = None
            out.append(_answer(r.session_id, r.turn, Session()) | {"response_type": "cleared"})
            continue
        session = session or Session()
        if r.client and not session.last:  # ST2: only where there is no turn yet
            session = restored(json.loads(r.client), facts)
        out.append(step(session, r, facts))
    return session, out


def _rows(out: list[dict]) -> pd.DataFrame:
    names = [x.split()[0] for x in OUT.split(", ")]
    return pd.DataFrame([[o[k] for k in names] for o in out], columns=names)


class Chat(StatefulProcessor):
    """ST1: the fold with its state: a value and lists with a time to live, and a timer that closes an idle session."""

    def __init__(self, lexicon: Lexicon, idle_ms: int, ttl_ms: int):
        self.lexicon, self.idle_ms, self.ttl_ms = lexicon, idle_ms, ttl_ms

    def init(self, handle) -> None:
        self.handle, self.facts = handle, Facts(self.lexicon)
        self.value = handle.getValueState("session", "session string", self.ttl_ms)
        self.phrases = handle.getListState("phrases", "phrase string, denied boolean", self.ttl_ms)
        self.asked = handle.getListState("asked", "question string", self.ttl_ms)
        self.notes = handle.getListState("notes", "note string", self.ttl_ms)

    def _load(self) -> Session | None:
        if not self.value.exists():
            return None
        told = json.loads(self.value.get()[0])
        phrases = list(self.phrases.get())
        known = Known({p for p, _ in phrases}, {p for p, denied in phrases if denied}, set(told.pop("told")))
        return Session(known=known, notes=[n for (n,) in self.notes.get()], asked=[q for (q,) in self.asked.get()], **told)

    def _store(self, session: Session | None) -> None:
        """Writes the whole session, so that all of it lives equally long."""
        for state in (self.value, self.phrases, self.asked, self.notes):
            state.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if session is None:
            return
        told = {k: v for k, v in asdict(session).items() if k not in ("known", "notes", "asked")} | {"told": sorted(session.known.told)}
        self.value.update((json.dumps(told),))
        for state, rows in ((self.phrases, [(p, p in session.known.denied) for p in sorted(session.known.seen)]), (self.asked, [(q,) for q in session.asked]), (self.notes, [(n,) for n in session.notes])):
            if rows:
                state.put(rows)

    def _wake(self, timerValues) -> None:
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        row = initialState.iloc[0].to_dict()
        self._store(restored({k: v for k, v in row.items() if isinstance(v, (list, tuple)) or hasattr(v, "__len__") or not pd.isna(v)}, self.facts))
        self._wake(timerValues)

    def handleInputRows(self, key, rows, timerValues):
        session, out = _fold(self._load(), rows, self.facts)
        self._store(session)
        if session is not None:
            self._wake(timerValues)
        yield _rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        session = self._load()
        self._store(None)
        yield _rows([_answer(key[0], None, session) | {"response_type": "closed"}] if session else [])

    def close(self) -> None:
        pass


def _with_facts(turns: DataFrame) -> DataFrame:
    """What the messages tell one by one; an event or a client that the turns lack is null."""
    n = normalize("message")
    lacking = {c: F.lit(None).cast("string") for c in ("event", "client") if c not in turns.columns}
    return turns.withColumns(lacking).withColumns({"normalized": n, "wants_detail": F.coalesce(signals.asks_preparation_detail("message"), F.lit(False)), "feedback": signals.feedback_label("message"), "confused": signals.confused(n), "bad_temperature": signals.invalid_temperature(n).isNotNull()})


#: ST2: what a table of the clients' sessions has.
CLIENT = "session_id string, turns array<struct<role:string,content:string>>, question_count bigint, stage string, completed boolean, suspected_conditions array<string>, asked array<string>, recommendation string"


def chat(turns: DataFrame, lexicon: Lexicon = DEFAULT, clients: DataFrame | None = None, idle_ms: int = IDLE_MS, ttl_ms: int = TTL_MS) -> DataFrame:
    """ST1-ST3: `turns` (columns of TURN), as a stream, to responses (columns of OUT).

    A session's turns are taken in their order within a batch. A null message says nothing. `clients` (columns of
    CLIENT, one row a session) are the sessions that are there before the first turn. A clear event is answered by
    `cleared` and leaves no state; a session that has been idle is answered by `closed`, without a turn. The
    state needs the RocksDB provider, which run_chat() sets.
    """
    restored_ = clients.groupBy("session_id") if clients is not None else None
    return _with_facts(turns).groupBy("session_id").transformWithStateInPandas(Chat(lexicon, idle_ms, ttl_ms), OUT, "append", "processingTime", restored_)


def chat_batch(turns: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """The same over a whole table of turns, for replays: a session's turns are folded in one task."""
    def whole(frame: pd.DataFrame) -> pd.DataFrame:
        return _rows(_fold(None, iter([frame]), Facts(lexicon))[1])

    return _with_facts(turns).groupBy("session_id").applyInPandas(whole, OUT)


def feedback_rows(turns: DataFrame, responses: DataFrame) -> DataFrame:
    """ST6: a row for review of each turn that gives feedback: its message, label, recommendation and a snapshot of the session."""
    told = responses.where("response_type = 'feedback'")
    snapshot = F.to_json(F.struct("stage", "question_count", "completed", "suspected"))
    rows = told.join(turns.select("session_id", "turn", "message"), ["session_id", "turn"])
    return rows.select(
        F.sha2(F.concat_ws("|", "session_id", F.col("turn").cast("string")), 256).alias("id"),
        "session_id",
        "turn",
        F.col("feedback").alias("feedback_label"),
        F.col("message").alias("user_message"),
        "recommendation",
        snapshot.alias("session_snapshot"),
        F.lit("pending_review").alias("status"),
        F.lit("model_evaluation_and_kb_curation").alias("usage"),
    )


_ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def run_chat(turns: DataFrame, out: str, checkpoint: str, lexicon: Lexicon = DEFAULT, clients: DataFrame | None = None, idle_ms: int = IDLE_MS, ttl_ms: int = TTL_MS, once: bool = True):
    """ST1, ST6: a query that writes responses, and rows for review of feedback, by batch; a batch that runs again replaces its own folders.

    once: it ends when all that is there has been read; else it goes on and closes idle sessions.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        batch.write.mode("overwrite").parquet(f"{out}/responses/batch={number}")
        told = batch.where("response_type = 'feedback'").select("session_id", "turn", "feedback", "recommendation", "stage", "question_count", "completed", "suspected")
        told.write.mode("overwrite").parquet(f"{out}/feedback/batch={number}")
        batch.unpersist()

    with settings(turns.sparkSession, _ROCKSDB | (ENDS if once else {})):
        made = chat(turns, lexicon, clients, idle_ms, ttl_ms).writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint)
        return made.trigger(availableNow=True).start() if once else made.trigger(processingTime="1 second").start()
