"""The queries, by name: each takes a session and a folder of Parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import parsing, scoring, signals
from ..functions.text import as_sentence, clean_reply, excerpt, limit_text, normalize, slugify, stable_hash, tokenize
from ..operators import curate, dialogue, replies, retrieval, split
from ..streaming import capture

#: Phrases that seed the test conversations, which are in other languages than the lexicon.
SEEDS = (
    "saya demam tinggi dan sesak sudah 3 hari",
    "tidak ada demam tinggi dan tidak sesak",
    "gatal gatal dan ruam merah sejak kemarin, makin berat",
    "suhu tertinggi 89 derajat, pusing dan mual",
    "boleh minta rekomendasi ramuan untuk batuk pilek?",
    "maksudnya bagaimana, saya bingung",
    "tanpa darah, bukan nyeri dada, hanya pegal selama dua minggu",
    "bukan diagnosis, segera ke tenaga kesehatan bila ada tanda bahaya",
    "juga sesak ketika bangun tidur, tekanan darah naik turun",
    "sejak kapan demam, apakah ada muntah?",
    "",
)
#: Literal dimension tables.
PROFILES = {"article": ["the ", " of ", " and "], "romance": [" de ", " la ", " que "], "german": [" der ", " und ", " sich "], "legal": ["license", "rights", "copyright"], "digits": ["1", "2", "3"], "marks": ["!!", "###", "|"]}
VARIANTS = ("overview", "prevention", "warning", "follow_up", "self_care")
AUDIENCES = ("patient", "family", "nurse")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def seeded(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations with a phrase of the lexicon's language at the end of each text."""
    c = table(spark, sf, "conversations")
    phrases = F.array(*[F.lit(s) for s in SEEDS])
    return c.withColumn("text", F.concat("text", F.lit(" "), F.try_element_at(phrases, (F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.lit(len(SEEDS))) + 1).cast("int"))))


def normalize_documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", normalize("text").alias("normalized"))


def token_stats(spark, sf):
    rows = retrieval.token_rows(table(spark, sf, "documents").select("lang", "text"), "lang", "text")
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n_tokens"), F.countDistinct("token").alias("n_distinct"))


def _index(spark, sf):
    return retrieval.TfidfIndex(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text")


def doc_freq_idf(spark, sf):
    counts = retrieval.term_counts(table(spark, sf, "documents"), "doc_id", "text")
    n = table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("n_docs"))
    df = retrieval.document_frequency(counts).crossJoin(F.broadcast(n))
    return df.select("token", "df", F.round(retrieval.idf(F.col("df"), F.col("n_docs")), 6).alias("idf"))


def tfidf_weights_norms(spark, sf):
    p = _index(spark, sf).postings
    return p.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_terms"), F.round(F.max("w"), 6).alias("max_weight"), F.round(F.sqrt(F.sum(F.col("w") * F.col("w"))), 6).alias("norm"))


def _hits(spark, sf, k):
    return _index(spark, sf).search(table(spark, sf, "benchmark").select(F.col("item_id").alias("query"), "text"), k)


def tfidf_search_topk(spark, sf):
    return _hits(spark, sf, 10).select(F.col("query").alias("item_id"), "doc_id", "score", "rank", "matched_terms")


def tfidf_rerank_filtered(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", stable_hash("text").alias("text_hash"))
    labels = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    hits = _hits(spark, sf, 20).join(docs, "doc_id").join(labels, "doc_id", "left")
    boosts = [retrieval.Boost(F.col("quality") == 1, 0.08), retrieval.Boost(F.col("source").isin("src0", "src1"), 0.25), retrieval.Boost(F.col("toxic") == 0, 0.02)]
    best = retrieval.rerank(hits, boosts, keep=F.col("lang") == "en", dedupe=F.col("text_hash"), k=5, key="doc_id")
    return best.select(F.col("query").alias("item_id"), "doc_id", "score", "rank")


def retrieval_bundle_union(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars")
    good = table(spark, sf, "labels").where("quality = 1").select("doc_id").distinct()
    by_source = [F.desc("score"), F.col("doc_id")]
    cases = curate.top_per_key(d.withColumn("score", F.round(F.col("n_chars") / 1000, 4)), "source", by_source, 2)
    context = curate.top_per_key(d.join(good, "doc_id", "left_semi").withColumn("score", F.round(F.col("n_chars") / 900, 4)), "source", by_source, 6)
    guidance = curate.top_per_key(d.where("lang <> 'en'").withColumn("score", F.round(F.col("n_chars") / 1000, 4)), "source", by_source, 4)
    items = cases.withColumn("ord", F.lit(1)).unionByName(context.withColumn("ord", F.lit(2))).unionByName(guidance.withColumn("ord", F.lit(3)))
    return retrieval.dedupe_best(items, ["source", "doc_id"]).select("source", "doc_id", "score", "ord")


def hint_antijoin_union(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    labels = table(spark, sf, "labels")
    found = d.join(labels.where("quality = 1").select("doc_id").distinct(), "doc_id", "left_semi").where("n_chars >= 500").select("doc_id", F.round(F.col("n_chars") / 10000, 4).alias("score"))
    hinted = d.join(labels.where("toxic = 1").select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id")
    return retrieval.append_missing(found, hinted, ["doc_id"]).select("doc_id", "score")


def embedding_topk_cosine(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id", "embedding")
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), "embedding")
    return retrieval.vector_topk(v, q, 10, "vec_id").select(F.col("query").alias("query_id"), F.col("key").alias("vec_id"), "score", "rank")


def hash_embedding_search(spark, sf):
    index = retrieval.HashEmbeddingIndex(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text")
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query"), "text")
    return index.search(q, 10).select(F.col("query").alias("item_id"), "doc_id", "score", "rank")


def phrase_negation_flags(spark, sf):
    c = seeded(spark, sf).withColumn("n", normalize("text"))
    return c.select("conv_id", "turn", F.array_join(signals.red_flags("n"), "|").alias("red_flags"), signals.safety_clearance("n").alias("cleared"), F.array_join(signals.hinted_cases("n"), "|").alias("hinted"))


def symptom_slots(spark, sf):
    c = seeded(spark, sf).withColumn("n", normalize("text"))
    present, absent = signals.symptom_slots("n")
    return c.select("conv_id", "turn", F.array_join(present, "|").alias("present"), F.array_join(absent, "|").alias("absent"), F.array_join(signals.detected_hints("n"), "|").alias("detected"))


def duration_extract(spark, sf):
    return seeded(spark, sf).select("conv_id", "turn", signals.duration_text(normalize("text")).alias("duration_text"))


def signal_flags(spark, sf):
    c = seeded(spark, sf).withColumn("n", normalize("text"))
    return c.select(
        "conv_id",
        "turn",
        signals.has_intensity("n").alias("intensity"),
        signals.has_progression("n").alias("progression"),
        signals.asks_recommendation("n").alias("recommendation"),
        signals.confused("n").alias("confused"),
        signals.invalid_temperature("n").alias("invalid_temperature"),
        signals.feedback_label("text").alias("feedback"),
        signals.asks_preparation_detail("text").alias("preparation_detail"),
    )


def running_conversation_text(spark, sf):
    return dialogue.running_text(table(spark, sf, "conversations")).select("conv_id", "turn", "running_text")


def turn_dedupe_last_n(spark, sf):
    c = dialogue.without_repeats(table(spark, sf, "conversations"))
    return dialogue.last_turns(c, 4).select("conv_id", "turn", "role", "text")


def question_budget_route(spark, sf):
    c = dialogue.question_counts(seeded(spark, sf)).where("role = 'user'")
    c = c.withColumn("n", normalize("text"))
    present, _ = signals.symptom_slots("n")
    c = c.withColumns({"red_flags": signals.red_flags("n"), "supported": (F.size(present) > 0) | (F.length("n") >= 60), "completed": F.pmod("conv_id", F.lit(5)) == 0})
    return dialogue.route(c, "red_flags", "supported").select("conv_id", "turn", "asked", "route")


def duplicate_question_history(spark, sf):
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(-8, -1)
    c = seeded(spark, sf).withColumn("history", F.collect_list("text").over(w))
    return c.select("conv_id", "turn", signals.duplicate_question("text", "history").alias("duplicate"))


def score_candidates_argmax(spark, sf):
    c = seeded(spark, sf)
    c = c.withColumn("before", F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))).where("role = 'assistant'")
    c = c.withColumn("kind", F.when(F.pmod("conv_id", F.lit(3)) == 0, "follow_up").when(F.pmod("conv_id", F.lit(3)) == 1, "red_flag").otherwise("recommendation"))
    s = scoring.legacy_scores("text", "kind", F.array_compact(F.array("before")), F.lit(True), F.array(F.lit("tanda bahaya")))
    scored = c.select("conv_id", "turn", F.lit("ok").alias("status"), *[v.alias(k) for k, v in s.items()])
    return dialogue.best_candidate(scored, ["conv_id"], "total", "turn").select("conv_id", "turn", "safety", "grounding", "completeness", "language", "penalty", "total")


def assessment_parse(spark, sf):
    """Assistant turns wrapped as model replies with thinking, fences and aliases, and parsed again."""
    c = table(spark, sf, "conversations").where("role = 'assistant'")
    body = F.to_json(
        F.struct(
            F.when(F.pmod("turn", F.lit(2)) == 0, "supported|critical").otherwise("Internal, supported").alias("scope"),
            F.col("text").alias("final"),
            F.lit("teh jahe; madu").alias("ingredients"),
            (F.pmod("conv_id", F.lit(2)) == 0).alias("enough"),
            F.array(F.lit(" batuk "), F.lit("")).alias("suspected"),
        )
    )
    raw = F.concat(F.lit("<think>{no} hm</think>\n```json\n"), body, F.lit("\n```"))
    a = c.select("conv_id", "turn", parsing.assessment(raw).alias("a"))
    return a.select("conv_id", "turn", "a.scope", F.col("a.final_answer").alias("final_answer"), F.array_join("a.ingredients", "|").alias("ingredients"), F.col("a.enough_information").alias("enough"), F.array_join("a.suspected_conditions", "|").alias("suspected"))


def parse_json_payload(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.from_json("props", "k bigint")["k"].alias("k"), "value")
    return e.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.min("k").alias("least"), F.max("k").alias("most"))


def _candidates(spark, sf) -> DataFrame:
    """Events as candidates of requests: users and days are requests, event types models."""
    e = table(spark, sf, "events")
    e = e.select(
        F.concat(F.col("user_id").cast("string"), F.lit(":"), F.date_format("ts", "yyyy-MM-dd")).alias("request"),
        F.col("event_type").alias("model"),
        F.when(F.pmod("event_id", F.lit(10)) == 0, "error").otherwise("ok").alias("status"),
        F.round("value", 2).alias("score"),
        F.pmod(F.col("event_id") * 37, F.lit(5000)).alias("latency_ms"),
        F.when(F.pmod("user_id", F.lit(2)) == 0, "follow_up").otherwise("recommendation").alias("stage"),
        "event_id",
    )
    best = W.partitionBy("request", "status").orderBy(F.desc("score"), "event_id")
    return e.withColumn("won", (F.col("status") == "ok") & (F.row_number().over(best) == 1))


def model_benchmark_rollup(spark, sf):
    r = dialogue.model_rollup(_candidates(spark, sf))
    return r.select("model", "n", "wins", F.round("ok_rate", 6).alias("ok_rate"), F.round("mean_score", 6).alias("mean_score"), F.round("mean_latency_ms", 4).alias("mean_latency_ms"))


def stage_win_pivot(spark, sf):
    wins = _candidates(spark, sf).where("won")
    return wins.groupBy("model").pivot("stage", ["follow_up", "recommendation"]).count().na.fill(0)


def page_text_extract(spark, sf):
    p = table(spark, sf, "pages")
    c = F.regexp_replace("html", r"(?is)<(script|style|noscript|svg)[^>]*>.*?</(script|style|noscript|svg)>", " ")
    body = F.regexp_replace(F.regexp_replace(c, r"(?is)<title>.*?</title>", " "), r"(?s)<[^>]*>", " ")
    return p.select("page_id", F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1).alias("title"), F.trim(F.regexp_replace(body, r"\s+", " ")).alias("text"))


def page_title_link_stats(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host"), F.length(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)).alias("title_chars"), F.regexp_count("html", F.lit(r"<a href=")).alias("links"))
    return p.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.sum("links").cast("bigint").alias("links"), F.max("title_chars").alias("longest_title"))


def page_node_text(spark, sf):
    """Titles and text nodes by the HTML parser."""
    return table(spark, sf, "pages").select("page_id", parsing.page_texts("html").alias("p")).select("page_id", "p.title", "p.text")


def dedupe_first_by_hash(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", stable_hash("text").alias("text_hash"))
    return curate.first_by_key(d, ["text_hash"], "doc_id").select("doc_id", "source", "text_hash")


def entity_merge(spark, sf):
    p = table(spark, sf, "part").withColumns({"level": F.when(F.col("p_size") > 45, "high").when(F.col("p_size") > 25, "medium").otherwise("low"), "sizes": F.array(F.concat(F.lit("S"), F.col("p_size").cast("string")), F.concat(F.lit("s"), F.col("p_size").cast("string")))})
    m = curate.merge_entities(p, curate.normalize_key(F.concat("p_brand", F.lit(" - "), "p_type")), "p_partkey", first=["p_name"], joined=["p_type"], lists=["sizes"], sets=["p_brand"], evidence="level")
    return m.select("merge_key", "p_name", "p_type", F.array_join("sizes", ",").alias("sizes"), F.array_join("p_brand", ",").alias("brands"), "level", "p_partkey")


def keyword_profile_match_top4(spark, sf):
    d = table(spark, sf, "documents")
    return curate.match_profiles(d, F.col("text"), PROFILES, 4, "doc_id").select("doc_id", "profile", "hits", "evidence", "rank")


def template_expansion(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", "quality").distinct()
    variants = spark.createDataFrame([(i, v) for i, v in enumerate(VARIANTS)], "variant_ord int, variant string")
    audiences = spark.createDataFrame([(i, a) for i, a in enumerate(AUDIENCES)], "audience_ord int, audience string")
    rows = curate.numbered(curate.expand(labels, variants, audiences), ["doc_id", "variant_ord", "audience_ord"], "row_id", "sft_%06d", 32)
    return rows.select("row_id", "doc_id", F.concat(F.col("variant"), F.lit(" for "), F.col("audience"), F.lit(" of "), F.col("doc_id").cast("string")).alias("prompt"))


def sft_from_log(spark, sf):
    c = table(spark, sf, "conversations")
    w = W.partitionBy("conv_id").orderBy("turn")
    pairs = c.withColumns({"next_role": F.lead("role").over(w), "next_text": F.lead("text").over(w)}).where("role = 'user' and next_role = 'assistant'")
    log = pairs.select(
        F.concat(F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string")).alias("id"),
        F.when(F.pmod("conv_id", F.lit(4)) == 0, "red_flag").otherwise("follow_up").alias("response_type"),
        F.col("text").alias("user_message"),
        F.lit("").alias("baseline_reply"),
        F.col("next_text").alias("selected_reply"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"),
    )
    chat = split.log_to_chat(log, ["follow_up"], "system")
    return chat.select("id", F.get("messages", 1)["content"].alias("user_text"), F.get("messages", 2)["content"].alias("assistant_text"))


def _keys(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents")
    keys = F.array(F.concat(F.lit("text:"), stable_hash("text")), F.concat(F.lit("line:"), F.col("source"), F.lit(":"), stable_hash(F.substring_index("text", "\n", 1))))
    return d.select(F.col("doc_id").alias("row_id"), F.explode(keys).alias("key"))


def leakage_components(spark, sf):
    return split.key_components(_keys(spark, sf)).select(F.col("row_id").alias("doc_id"), "component")


def group_split_audit(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "text", stable_hash("text").alias("group"))
    done = split.group_split(d, "group")
    return split.split_audit(done, "group", {"text": "text"})


def group_split_rows(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", stable_hash("text").alias("group"))
    return split.group_split(d, "group").select("doc_id", "split")


def sequential_ids(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_type")
    return curate.numbered(p, [F.lower("p_name"), F.col("p_type"), F.col("p_partkey")], "id", "herb_%04d", 16).select("id", "p_partkey")


def evidence_rank(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    d = d.withColumn("level", F.when((F.col("quality") == 1) & (F.col("toxic") == 1), "high").when(F.col("quality") == 1, "medium").otherwise("low_to_medium"))
    return d.groupBy("source", "lang").agg(curate.strongest_evidence("level", "doc_id").alias("evidence"), F.count(F.lit(1)).alias("n"))


def conversation_summary_export(spark, sf):
    return dialogue.conversation_summary(table(spark, sf, "conversations"))


def candidate_explode_export(spark, sf):
    c = table(spark, sf, "conversations").where("role = 'assistant'")
    one = F.struct("turn", F.length("text").alias("length"))
    logs = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("replies"))
    def name(turn: Column) -> Column:
        return F.concat(F.lit("model_"), turn.cast("string"))

    candidate = lambda r: F.struct(name(r["turn"]).alias("model"), F.lit("ok").alias("status"), F.round(r["length"] / 1000, 4).alias("score"), (r["length"] * 7).alias("latency_ms"), F.create_map(F.lit("length"), r["length"].cast("bigint"), F.lit("depth"), r["turn"].cast("bigint")).alias("scoring_breakdown"))
    logs = logs.select(F.col("conv_id").alias("id"), F.col("conv_id").alias("session_id"), name(F.get("replies", 0)["turn"]).alias("selected_model"), F.transform("replies", candidate).alias("candidates"))
    return dialogue.candidate_export(logs).select(F.col("id").alias("conv_id"), "model", "score", "selected", "latency", "breakdown")


def benchmark_contamination(spark, sf):
    """Items that are substrings of a document: found by hashes of up to six inner words, then verified on the texts; items of one or two words are tested directly."""
    b = table(spark, sf, "benchmark").where("text <> ''").withColumn("words", F.split("text", " "))
    d = table(spark, sf, "documents").select("doc_id", "text")
    inner = F.least(F.size("words") - 2, F.lit(6))
    anchored = b.where(F.size("words") >= 3).select("item_id", inner.alias("n"), F.xxhash64(F.array_join(F.slice(F.col("words"), F.lit(2), inner), " ")).alias("anchor"))
    lengths = sorted(r["n"] for r in anchored.select("n").distinct().collect())  # six at most
    words = d.select("doc_id", F.split("text", " ").alias("w"))

    def windows(n: int) -> Column:
        hashed = F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.xxhash64(F.array_join(F.slice("w", i, n), " ")))
        return F.when(F.size("w") >= n, F.array_distinct(hashed)).otherwise(F.array().cast("array<bigint>"))

    items = b.select("item_id", F.col("text").alias("item"))
    direct = d.join(retrieval._small(b.where(F.size("words") < 3).select("item_id", F.col("text").alias("item"))), F.contains(F.col("text"), F.col("item"))).select("doc_id", "item_id")
    if not lengths:
        return direct.distinct()
    hashes = words.select("doc_id", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), windows(n).alias("of")) for n in lengths])).alias("x")).select("doc_id", "x.n", F.explode("x.of").alias("anchor"))
    pairs = hashes.join(retrieval._small(anchored), ["n", "anchor"]).select("doc_id", "item_id").distinct()
    return pairs.join(d, "doc_id").join(retrieval._small(items), "item_id").where(F.contains("text", "item")).select("doc_id", "item_id").unionByName(direct).distinct()


def conversation_features(spark, sf):
    """All signals of each conversation's user turns so far."""
    c = dialogue.running_text(seeded(spark, sf)).where("role = 'user'").select("conv_id", "turn", F.col("running_text").alias("text"))
    a = signals.analyze(c)
    return a.select("conv_id", "turn", F.array_join("red_flags", "|").alias("red_flags"), F.array_join("present_symptoms", "|").alias("present"), F.array_join("absent_symptoms", "|").alias("absent"), "duration_text", "has_duration_signal", "has_safety_clearance_signal", F.array_join("answered_slots", "|").alias("answered"))


def rolled_up_tokens(spark, sf):
    """Token counts of benchmark texts by the array form of the tokenizer."""
    b = table(spark, sf, "benchmark").withColumn("t", tokenize("text"))
    return b.select("item_id", F.size("t").alias("n"), F.size(F.array_distinct("t")).alias("n_distinct"), F.array_join(F.array_sort(F.array_distinct("t")), " ").alias("terms"))


def reply_cleanup(spark, sf):
    """Replies with leaked instructions, trailing blanks and blank runs, cleaned."""
    c = table(spark, sf, "conversations").where("role = 'assistant'")
    dirty = F.concat(F.lit("Instruksi jawaban:  "), F.col("text"), F.lit("  \r\n\r\n\r\nx  "))
    return c.select("conv_id", "turn", clean_reply(dirty).alias("reply"))


def text_excerpts(spark, sf):
    """Excerpts, word-bounded limits and sentence summaries."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", excerpt("text", 120).alias("excerpt"), excerpt("text", 90, True).alias("hard"), limit_text("text", 50).alias("limited"), slugify("text").alias("slug"), as_sentence("text").alias("sentence"))


def legacy_merge(spark, sf):
    """Suppliers filled up from customers of the same key, then the customers that no supplier has."""
    rows = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.pmod("s_suppkey", F.lit(3)) > 0, F.col("s_name")).alias("name"), F.lit(None).cast("string").alias("segment"))
    legacy = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return curate.with_legacy(rows, legacy, "id", ["name", "segment"])


def override_join(spark, sf):
    """Parts with an override by name or type, the name first; of repeated overrides the last counts."""
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_type", "p_size")
    over = p.where("p_size <= 10").select(F.col("p_name").alias("key"), F.concat(F.lit("n"), F.col("p_partkey").cast("string")).alias("steps"), F.col("p_partkey").alias("ord")).unionByName(
        p.where("p_size = 20 and p_type = 'SMALL'").select(F.col("p_type").alias("key"), F.concat(F.lit("t"), F.col("p_partkey").cast("string")).alias("steps"), F.col("p_partkey").alias("ord"))
    )
    return curate.with_overrides(p, over, ["p_name", "p_type"], "steps", F.lit("standard"), "ord").select("p_partkey", "steps")


def source_collect_order(spark, sf):
    """Customers of each nation with their regions' names in the order of a key list."""
    keys = F.array(F.pmod(F.col("n_regionkey") + 2, F.lit(5)), F.col("n_regionkey"), F.pmod(F.col("n_regionkey") + 1, F.lit(5)))
    records = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), keys.alias("source_keys"))
    regions = table(spark, sf, "region").select(F.col("r_regionkey").alias("source_key"), F.col("r_name").alias("title"), F.concat(F.lit("u"), F.col("r_regionkey").cast("string")).alias("url"))
    out = curate.collect_sources(records, regions)
    return out.select("id", F.array_join("source_titles", "|").alias("titles"), F.array_join("source_urls", "|").alias("urls"))


def candidate_best_per_request(spark, sf):
    return dialogue.best_candidate(_candidates(spark, sf), ["request"], "score", "event_id").select("request", "model", "score", "event_id")


def value_counts_manifest(spark, sf):
    """Value counts and table counts in one relation."""
    counts = curate.value_counts(table(spark, sf, "documents"), "lang").select(F.concat(F.lit("lang:"), F.col("lang")).alias("name"), "n")
    return counts.unionByName(curate.manifest({t: table(spark, sf, t) for t in ("documents", "labels", "benchmark", "pages")}))


def keyword_evidence(spark, sf):
    """Keyword, ASCII and citation predicates."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", curate.has_any("text", ["license", "rights"]).alias("notice"), signals.is_ascii("text").alias("ascii"), signals.cited_evidence("text").alias("cited"), signals.excluded_title("text", ["the ", "der "]).alias("excluded"))


def template_rotation(spark, sf):
    """Rotated lists and items by number."""
    labels = table(spark, sf, "labels").select("doc_id").distinct()
    items = F.array(*[F.lit(v) for v in VARIANTS])
    return labels.select("doc_id", F.array_join(curate.rotate(items, F.col("doc_id")), ",").alias("rotated"), curate.pick(items, F.col("doc_id")).alias("picked"))


def follow_up_choice(spark, sf):
    """The next question of each conversation after its last user turn."""
    c = dialogue.running_text(seeded(spark, sf)).where("role = 'user'")
    last = c.groupBy("conv_id").agg(F.max_by("running_text", "turn").alias("text"))
    a = signals.analyze(last)
    answered = {"duration": F.col("has_duration_signal"), "safety": F.col("has_safety_clearance_signal"), "detail": F.col("has_intensity_signal") | F.col("has_progression_signal")}
    a = a.withColumn("candidates", replies.candidate_questions("present_symptoms", "absent_symptoms", answered))
    chosen = replies.pick_question("candidates", F.array_union("present_symptoms", "absent_symptoms"), F.col("has_duration_signal"), F.col("has_intensity_signal"), F.array().cast("array<string>"))
    return a.select("conv_id", F.size("candidates").alias("n_candidates"), chosen.alias("question"))


def turn_capture_stream(spark, sf):
    return capture.captured(spark, f"{sf}/conversations.parquet")


def session_state_stream(spark, sf):
    return capture.session_counts(spark, f"{sf}/conversations.parquet")


QUERIES = {
    f.__name__: f
    for f in (
        tfidf_search_topk, normalize_documents, token_stats, doc_freq_idf, tfidf_weights_norms, tfidf_rerank_filtered, retrieval_bundle_union, hint_antijoin_union,
        embedding_topk_cosine, hash_embedding_search, phrase_negation_flags, symptom_slots, duration_extract, signal_flags, running_conversation_text, turn_dedupe_last_n,
        question_budget_route, duplicate_question_history, score_candidates_argmax, assessment_parse, parse_json_payload, model_benchmark_rollup, stage_win_pivot,
        page_text_extract, page_title_link_stats, page_node_text, dedupe_first_by_hash, entity_merge, keyword_profile_match_top4, template_expansion, sft_from_log,
        leakage_components, group_split_audit, group_split_rows, sequential_ids, evidence_rank, conversation_summary_export, candidate_explode_export, benchmark_contamination,
        conversation_features, rolled_up_tokens, reply_cleanup, text_excerpts, legacy_merge, override_join, source_collect_order, candidate_best_per_request,
        value_counts_manifest, keyword_evidence, template_rotation, follow_up_choice, turn_capture_stream, session_state_stream,
    )
}
