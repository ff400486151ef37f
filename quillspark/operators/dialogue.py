"""Ordered computations over conversations (WIN5-WIN9, ST1-ST9, RPT1-RPT5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.parsing import format_latency, format_metrics
from ..functions.signals import asks_preparation_detail, confused, duplicate_question, feedback_label, invalid_temperature
from ..functions.text import normalize, null_if_blank

MAX_QUESTIONS = 3


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def turns(conv: str = "conv_id", order: str = "turn"):
    return W.partitionBy(conv).orderBy(order)


def without_repeats(df: DataFrame, conv: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """WIN5: without turns that repeat the role and normalised text of the turn before."""
    df = df.withColumn("_n", normalize(text))
    w = turns(conv, order)
    same = (F.lag(role).over(w) == F.col(role)) & (F.lag("_n").over(w) == F.col("_n"))
    return df.withColumn("_same", F.coalesce(same, F.lit(False))).where("not _same").drop("_same", "_n")


def last_turns(df: DataFrame, n: int = 10, conv: str = "conv_id", order: str = "turn") -> DataFrame:
    """WIN6: the last n turns of each conversation."""
    back = F.row_number().over(W.partitionBy(conv).orderBy(F.desc(order)))
    return df.withColumn("_b", back).where(F.col("_b") <= n).drop("_b")


def remember(questions, new, most: int = 8) -> Column:
    """WIN6, X8: the last questions, with a new one that repeats none of them."""
    q = F.coalesce(_c(questions), F.array().cast("array<string>"))
    n = null_if_blank(new)
    longer = F.when(n.isNull() | (normalize(n) == "") | duplicate_question(n, q), q).otherwise(F.array_append(q, n))
    return F.slice(longer, F.greatest(F.size(longer) - most + 1, F.lit(1)), most)


def running_text(df: DataFrame, conv: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """WIN7: `df` with running_text: all user turns so far, joined by line breaks."""
    said = F.when((F.col(role) == "user") & (F.trim(text) != ""), F.trim(text))
    rows = F.collect_list(said).over(turns(conv, order).rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn("running_text", F.array_join(rows, "\n"))


def question_counts(df: DataFrame, conv: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text", most: int = MAX_QUESTIONS) -> DataFrame:
    """WIN9: `df` with asked: the assistant's questions before a turn, at most `most`."""
    ask = ((F.col(role) == "assistant") & F.endswith(F.trim(text), F.lit("?"))).cast("int")
    before = F.coalesce(F.sum(ask).over(turns(conv, order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("asked", F.least(before, F.lit(most)))


def route(df: DataFrame, flags: str, supported: str, asked: str = "asked", text: str = "text", most: int = MAX_QUESTIONS) -> DataFrame:
    """ST1, the part before any model: df with route, by the guards in their order."""
    norm = normalize(text)
    return df.withColumn(
        "route",
        F.when(F.coalesce(F.col("completed"), F.lit(False)) & asks_preparation_detail(text), "preparation_detail")
        .when(F.coalesce(F.col("completed"), F.lit(False)) & feedback_label(text).isNotNull(), "feedback")
        .when(confused(norm), "clarification")
        .when(invalid_temperature(norm).isNotNull(), "temperature_clarification")
        .when(F.size(flags) > 0, "red_flag")
        .when(~F.col(supported), "out_of_scope")
        .when(F.col(asked) >= most, "final_recommendation")
        .otherwise("follow_up"),
    )


def synced(server: DataFrame, client: DataFrame, key: str = "session_id") -> DataFrame:
    """ST2: the sessions of server and client; where the server has none or one without turns, the client's, with unknown roles as assistant, counts of 0 at least, three conditions at most."""
    empty = F.coalesce(F.size("turns"), F.lit(0)) <= 0
    c = client.select(
        key,
        F.filter(F.transform("turns", lambda t: F.struct(F.when(t["role"].isin("user", "assistant"), t["role"]).otherwise("assistant").alias("role"), t["content"].alias("content"))), lambda t: F.trim(t["content"]) != "").alias("_turns"),
        F.greatest("question_count", F.lit(0)).alias("_count"),
        F.slice("suspected_conditions", 1, 3).alias("_suspected"),
    )

    def either(mine: str, theirs: str) -> Column:
        return F.when(empty & F.col(theirs).isNotNull(), F.col(theirs)).otherwise(F.col(mine)).alias(mine)

    return server.join(c, key, "full").select(key, either("turns", "_turns"), either("question_count", "_count"), either("suspected_conditions", "_suspected"))


def cleared(sessions: DataFrame, ids: DataFrame, key: str = "session_id") -> DataFrame:
    """ST3: sessions without the given ones."""
    return sessions.join(ids, key, "left_anti")


def recommendation(assessment, case, defaults: dict[str, str]) -> Column:
    """ST7: field by field the assessment's, the case's or the default text; null without a name."""
    a, c = _c(assessment), _c(case)
    fields = {"keluhan_ringan": None, "ramuan": "recommended_herbal_name", "cara_pengolahan": "preparation", "dosis_penggunaan": "dosage", "catatan_kewaspadaan": "warning_notes", "sumber_ringkas": "source_hint"}
    parts = [F.coalesce(*([null_if_blank(a[s])] if s else []), null_if_blank(c[n]), F.lit(defaults.get(n, ""))).alias(n) for n, s in fields.items()]
    return F.when(F.coalesce(null_if_blank(a["recommended_herbal_name"]), null_if_blank(c["ramuan"])).isNotNull(), F.struct(*parts))


def first_of_kind(items: DataFrame, query: str, kind: Column, order: str = "rank") -> DataFrame:
    """ST9: the first item of a kind for each query."""
    return items.where(kind).withColumn("_n", F.row_number().over(W.partitionBy(query).orderBy(order))).where("_n = 1").drop("_n")


def best_candidate(candidates: DataFrame, request: list[str], score: str = "score", order: str = "model_ord") -> DataFrame:
    """AGG11: the best ok candidate of each request, the first on ties."""
    best = F.row_number().over(W.partitionBy(*request).orderBy(F.desc(score), order))
    return candidates.where("status = 'ok'").withColumn("_n", best).where("_n = 1").drop("_n")


def model_rollup(candidates: DataFrame, model: str = "model") -> DataFrame:
    """AGG16: candidates, wins, share of ok, mean score and latency by model."""
    return candidates.groupBy(model).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("won").alias("wins"), F.avg(F.when(F.col("status") == "ok", 1.0).otherwise(0.0)).alias("ok_rate"), F.avg("score").alias("mean_score"), F.avg("latency_ms").alias("mean_latency_ms")
    )


def conversation_summary(df: DataFrame, conv: str = "conv_id", role: str = "role", text: str = "text") -> DataFrame:
    """RPT1, RPT5: counts of turns by role, questions, characters, and the last user text."""
    return df.groupBy(conv).agg(
        F.count(F.lit(1)).alias("turns"),
        F.count_if(F.col(role) == "user").alias("user_turns"),
        F.count_if(F.col(role) == "assistant").alias("assistant_turns"),
        F.count_if((F.col(role) == "assistant") & F.endswith(F.trim(text), F.lit("?"))).alias("questions"),
        F.sum(F.length(text)).alias("characters"),
        F.max_by(text, F.when(F.col(role) == "user", F.col("turn"))).alias("last_user_text"),
    )


def turn_export(logs: DataFrame) -> DataFrame:
    """RPT2: one flat row for each logged turn."""
    return logs.select("session_id", "created_at", "user_message", "response_type", F.array_join(F.array_distinct("suspected_conditions"), "; ").alias("suspected_conditions"), F.array_join(F.array_distinct("red_flags"), "; ").alias("red_flags"), "follow_up_question", "assistant_reply", "questions_asked", "max_questions")


def candidate_export(logs: DataFrame) -> DataFrame:
    """RPT3: one flat row for each candidate of a logged comparison."""
    rows = logs.select("id", "session_id", "selected_model", F.posexplode("candidates").alias("pos", "c"))
    return rows.select("id", "session_id", F.col("c.model").alias("model"), F.col("c.status").alias("status"), F.col("c.score").alias("score"), (F.col("c.model") == F.col("selected_model")).alias("selected"), format_latency("c.latency_ms").alias("latency"), format_metrics("c.scoring_breakdown").alias("breakdown"))
