"""Leakage-safe training splits (TRN1-TRN4, WIN8, AGG12, FLT26-27, ARR5-6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.signals import valid_chat
from ..functions.text import clean_reply, dedupe_form, ensure_disclaimer, null_if_blank, squeeze, stable_hash
from ..plans.session import stored
from .components import connected


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def first_content(messages, role: str) -> Column:
    """ARR5: the content of the first message of a role; an empty text if there is none."""
    return F.coalesce(F.get(F.filter(_c(messages), lambda m: m["role"] == role), 0)["content"], F.lit(""))


def normalized_messages(messages) -> Column:
    """ARR6: messages of the three roles with trimmed, non-empty content."""
    trimmed = F.transform(_c(messages), lambda m: F.struct(F.trim(m["role"]).alias("role"), F.trim(m["content"]).alias("content")))
    return F.filter(trimmed, lambda m: m["role"].isin("system", "user", "assistant") & (m["content"] != ""))


def group_key(row_id, source_record_id, messages, index) -> Column:
    """TRN1: what a row is grouped by: its source record, topic, case, user message or id."""
    rid = F.coalesce(F.trim(_c(row_id)), F.lit(""))
    topic, case = F.regexp_extract(rid, r"^medlineplus_(\d+)_", 1), F.regexp_extract(rid, r"^sft_anam_(\d+)", 1)
    record = null_if_blank(source_record_id)
    return (
        F.when(record.isNotNull(), F.concat(F.lit("source_record:"), record))
        .when(topic != "", F.concat(F.lit("medlineplus_topic:"), topic))
        .when(case != "", F.concat(F.lit("anamnesis_case:"), case))
        .when(F.startswith(rid, F.lit("rag_")), F.concat(F.lit("rag_user:"), stable_hash(first_content(messages, "user"))))
        .otherwise(F.concat(F.lit("row_id:"), F.when(rid != "", rid).otherwise(_c(index).cast("string"))))
    )


def leakage_keys(row_id, source_record_id, messages, index) -> Column:
    """TRN1: the group key, and hashes of the first assistant and user messages where there are any."""
    def hashed(role: str) -> Column:
        text = first_content(messages, role)
        return F.when(text != "", F.concat(F.lit(f"{role}:"), stable_hash(text)))

    return F.array_compact(F.array(group_key(row_id, source_record_id, messages, index), hashed("assistant"), hashed("user")))


def key_components(pairs: DataFrame, row: str = "row_id", key: str = "key") -> DataFrame:
    """TRN2: (row, component): rows that share keys, directly or through others; component is the smallest row.

    A row whose keys are all null is a component of its own; rows without id are left out. Every row of a key is
    linked with the key's smallest row, so a key that many rows share costs one link for each of them, never pairs.
    """
    pairs = stored(pairs.select(row, key).where(F.col(row).isNotNull()).distinct(), "pairs")
    low = pairs.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(row).alias("a"))
    links = pairs.join(low, key).select("a", F.col(row).alias("b"))
    found = connected(links)
    rows = pairs.select(row).distinct()
    return rows.join(found.withColumnRenamed("id", row), row, "left").select(row, F.coalesce("component", row).alias("component"))


def group_split(rows: DataFrame, group: str, seed: int = 42, valid: float = 0.08, test: float = 0.08) -> DataFrame:
    """TRN3, WIN8: `rows` with split: whole groups fill valid, then test, then train.

    Groups come in the order of a hash of seed and group, which is deterministic but not any generator's
    shuffle. A group goes whole to the first split that is still below its target, so targets may be overshot.
    Rows without a group are one group, as two of them may belong together.
    The running sum over groups is computed in two levels, so that no task sorts all groups.
    """
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.withColumn("_o", F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(group).cast("string"), F.lit(""))), 256)).withColumn("_b", F.substring("_o", 1, 3))
    parts = sizes.groupBy("_b").agg(F.sum("_n").alias("_s"))  # 4,096 rows at most
    offsets = parts.withColumn("_before", F.coalesce(F.sum("_s").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("_total", F.sum("_s").over(W.partitionBy()))
    inside = F.coalesce(F.sum("_n").over(W.partitionBy("_b").orderBy("_o", group).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    run = sizes.withColumn("_in", inside).join(F.broadcast(offsets.drop("_s")), "_b").withColumn("_p", F.col("_in") + F.col("_before"))
    want_v, want_t = F.greatest(F.lit(1), F.floor(F.col("_total") * valid)), F.greatest(F.lit(1), F.floor(F.col("_total") * test))
    run = run.withColumn("_v", F.col("_p") < want_v)
    filled = run.where("_v").agg(F.sum("_n").alias("_filled"))
    run = run.crossJoin(F.broadcast(filled))
    split = F.when(F.col("_v"), "valid").when(F.col("_p") - F.col("_filled") < want_t, "test").otherwise("train")
    named = run.select(F.col(group).alias("_group"), split.alias("split"))
    return rows.join(named, rows[group].eqNullSafe(named["_group"])).drop("_group")


def random_split(rows: DataFrame, key: str, seed: int = 42, valid: float = 0.08, test: float = 0.08) -> DataFrame:
    """TRN3: `rows` with split by a hash of seed and key."""
    u = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256), 1, 13), 16, 10).cast("double") / float(2**52)
    return rows.withColumn("split", F.when(u < valid, "valid").when(u < valid + test, "test").otherwise("train"))


def split_audit(rows: DataFrame, group: str, contents: dict[str, str]) -> DataFrame:
    """AGG12: one row: groups in all and in each split, groups in several splits, contents in several splits."""
    groups = rows.groupBy(group).agg(F.count_if(F.col("split") == "train").alias("a"), F.count_if(F.col("split") == "valid").alias("b"), F.count_if(F.col("split") == "test").alias("c"))
    several = (F.col("a") > 0).cast("int") + (F.col("b") > 0).cast("int") + (F.col("c") > 0).cast("int") > 1
    out = groups.agg(F.count(F.lit(1)).alias("total_groups"), *[F.count_if(F.col(x) > 0).alias(f"{n}_groups") for x, n in zip("abc", ("train", "valid", "test"))], F.count_if(several).alias("group_leakage_count"))
    for name, column in contents.items():
        leaks = rows.where(F.coalesce(F.col(column), F.lit("")) != "").groupBy(stable_hash(column).alias("h")).agg(F.min("split").alias("x"), F.max("split").alias("y"))
        out = out.crossJoin(leaks.agg(F.count_if(F.col("x") != F.col("y")).alias(f"{name}_cross_split_duplicate_groups")))
    return out


def log_to_chat(log: DataFrame, types: list[str], system: str, order: str = "ord") -> DataFrame:
    """TRN4: chat rows (id, source, response_type, messages) of a learning log, the first of each pair of messages.

    log: id, response_type, user_message, baseline_reply, selected_reply and an order column.
    """
    reply = F.coalesce(null_if_blank(clean_reply("baseline_reply")), null_if_blank(clean_reply("selected_reply")))
    df = log.where(F.trim("response_type").isin(types)).withColumns({"_u": squeeze(F.coalesce("user_message", F.lit(""))), "_a": ensure_disclaimer(reply)})
    df = df.where((F.col("_u") != "") & F.col("_a").isNotNull())
    first = F.row_number().over(W.partitionBy(dedupe_form("_u"), dedupe_form("_a")).orderBy(order))
    df = df.withColumn("_n", first).where("_n = 1")
    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return df.select(
        F.concat(F.lit("rag_"), F.coalesce(null_if_blank(F.col("id").cast("string")), F.col(order).cast("string"))).alias("id"),
        F.lit("learning_log_rag_grounded").alias("source"),
        F.trim("response_type").alias("response_type"),
        F.array(message("system", F.lit(system)), message("user", F.col("_u")), message("assistant", F.col("_a"))).alias("messages"),
    )


def prepare(rows: DataFrame, index: str = "index", seed: int = 42, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Training rows (id, source_record_id, messages, index) as (messages, split), and their audit.

    Rows without a user and an assistant message go first; `limit` (TOP10) is taken before the split; the audit
    sees the rows before their messages are normalised.
    """
    valid = rows.where(valid_chat("messages"))
    if limit is not None:
        valid = valid.orderBy(index).limit(limit)
    keys = leakage_keys("id", "source_record_id", "messages", index)
    found = key_components(valid.select(F.col(index).alias("row_id"), F.explode(keys).alias("key")))
    tagged = valid.join(found, valid[index] == found["row_id"]).drop("row_id")
    tagged = tagged.withColumns({"group": group_key("id", "source_record_id", "messages", index), "_user": first_content("messages", "user"), "_assistant": first_content("messages", "assistant")})
    done = group_split(tagged, "component", seed)
    return done.select(normalized_messages("messages").alias("messages"), "split"), split_audit(done, "group", {"assistant": "_assistant", "user": "_user"})
