"""Retrieval for a conversation: cases, context of the best case, guidance, and their bundle (TOP3-TOP6, JN2-JN4, JN15).

queries: query, text, hinted_case_ids, detected_symptoms. chunks: the union of sources.knowledge. cases: case_id,
keluhan_ringan, ramuan_rekomendasi, items (array), text. An index offers search(queries, k) over the chunks' ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.lexicon import DEFAULT, Lexicon
from ..functions.text import hint, split_semicolon, tokenize
from ..plans.session import stored
from .retrieval import Boost, Index, dedupe_best, rerank

# How many hits are searched before any filter, results, boosts.
SEARCHED = {"cases": 20, "context": 30, "guidance": 30}
RESULTS = {"cases": 3, "context": 6, "guidance": 5}
BUNDLE = {"cases": 2, "context": 6, "guidance": 4}
HINTED, HINT_SCORE, MILD = 0.8, 0.85, 0.08
WITH_INGREDIENTS = ("formula", "herb", "training", "anamnesis")
GUIDELINES = ("clinical_guideline_reference", "medical_review_reference")
TROPICAL = "penyakit_tropis"


def case_table(cases: DataFrame) -> DataFrame:
    """Cases of the reader in the form that retrieval takes."""
    texts = [F.coalesce(c, F.lit("")) for c in ("keluhan_ringan", "pertanyaan_anamnesis", "ramuan_rekomendasi")]
    items = split_semicolon("bahan")
    return cases.select(F.col("id").alias("case_id"), "keluhan_ringan", "ramuan_rekomendasi", items.alias("items"), F.concat_ws(" ", *texts, F.array_join(items, " ")).alias("text"))


def _symptom(matched: Column, detected: Column) -> Column:
    return F.arrays_overlap(F.split(matched, " "), detected)


def _cut(df: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query").orderBy(F.desc("score"), "ord")
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def retrieve_cases(index: Index, chunks: DataFrame, cases: DataFrame, queries: DataFrame, k: int = RESULTS["cases"], lexicon: Lexicon = DEFAULT, found: DataFrame | None = None) -> DataFrame:
    """TOP3: (query, id, type, title, score, evidence_level, matched_terms, ord, rank) of the best cases.

    The search's limit comes before the filter by type. Hinted cases gain; those that weren't found are appended
    with a fixed score. found: hits of a search of the queries that went at least as far.
    """
    q = queries.select("query", F.col("text").alias("asked"), "hinted_case_ids")
    of = chunks.where("type = 'case' and case_id is not null").select(F.col("id").alias("chunk"), "case_id")
    hits = _hits(index, queries.select("query", "text"), SEARCHED["cases"], found).withColumnRenamed("id", "chunk")
    hits = hits.join(of, "chunk").join(cases.select("case_id", "keluhan_ringan"), "case_id").join(q, "query")
    score = F.col("score") + F.when(F.array_contains("hinted_case_ids", F.col("case_id")), HINTED).otherwise(0.0)
    score = score + F.when(F.contains(F.lower("asked"), F.lit("ringan")) & F.contains("keluhan_ringan", F.lit("ringan")), MILD).otherwise(0.0)
    found = hits.select("query", F.col("case_id").alias("id"), F.col("keluhan_ringan").alias("title"), F.round(score, 4).alias("score"), F.lit("curated_case").alias("evidence_level"), "matched_terms", F.col("rank").cast("int").alias("ord"))
    named = q.select("query", "asked", F.posexplode("hinted_case_ids").alias("pos", "id")).join(found.select("query", "id"), ["query", "id"], "left_anti")
    named = named.join(cases.withColumnRenamed("case_id", "id"), "id")
    terms = F.array_join(F.array_sort(F.array_intersect(tokenize("asked", lexicon), tokenize("text", lexicon))), " ")
    hinted = named.select("query", "id", F.col("keluhan_ringan").alias("title"), F.lit(HINT_SCORE).alias("score"), F.lit("curated_case_hint").alias("evidence_level"), terms.alias("matched_terms"), (F.lit(1000) + F.col("pos")).cast("int").alias("ord"))
    return _cut(found.unionByName(hinted), k).withColumn("type", F.lit("case"))


def _hits(index: Index, queries: DataFrame, searched: int, found: DataFrame | None) -> DataFrame:
    return index.search(queries, searched) if found is None else found.where(F.col("rank") <= searched)


def _candidates(index: Index, chunks: DataFrame, queries: DataFrame, searched: int, lexicon: Lexicon, found: DataFrame | None = None) -> DataFrame:
    hits = _hits(index, queries, searched, found)
    return hits.join(chunks.drop("text", "ord"), "id").withColumn("title_hint", hint("title", lexicon))


def _dedupe_key() -> Column:
    return F.when(F.col("type") == "training", F.concat(F.lit("training:"), F.col("title_hint"))).otherwise(F.col("id"))


def retrieve_context(index: Index, chunks: DataFrame, cases: DataFrame, queries: DataFrame, k: int = RESULTS["context"], lexicon: Lexicon = DEFAULT) -> DataFrame:
    """TOP4: the best chunks for a query (with its case_id) and its case: formulas, herbs, training, anamnesis.

    An all-stopword title or ingredient is the empty text, which every text contains.
    """
    q = queries.join(cases.select("case_id", "keluhan_ringan", "ramuan_rekomendasi", "items"), "case_id")
    long = q.select("query", F.concat_ws(" ", "text", "keluhan_ringan", "ramuan_rekomendasi", F.array_join("items", " ")).alias("text"))
    facts = q.select("query", "case_id", "detected_symptoms", hint("ramuan_rekomendasi", lexicon).alias("formula_hint"), F.transform("items", lambda x: hint(x, lexicon)).alias("ingredient_hints"))
    hits = _candidates(index, chunks.withColumnRenamed("case_id", "chunk_case"), long, SEARCHED["context"], lexicon).join(facts, "query")
    t = F.col("title_hint")
    same = F.contains(F.col("formula_hint"), t) | F.contains(t, F.col("formula_hint"))
    kind, wide = F.col("type"), F.col("type").isin(*WITH_INGREDIENTS)
    boosts = [
        Boost((kind == "formula") & same, 0.9),
        Boost(wide & F.array_contains("ingredient_hints", t), 0.5),
        Boost(wide & F.exists("ingredient_hints", lambda x: F.contains(t, x)), 0.25),
        Boost((kind == "training") & same, 0.45),
        Boost((kind == "anamnesis") & F.array_contains("metadata.applicable_case_ids", F.col("case_id")), 0.55),
        Boost(F.col("evidence_level").isin("high", "medium"), 0.08),
        Boost(_symptom(F.col("matched_terms"), F.col("detected_symptoms")), 0.08),
    ]
    return rerank(hits, boosts, kind != "case", _dedupe_key(), k).select("query", "id", "type", "title", "score", "evidence_level", "matched_terms", "rank")


def retrieve_guidance(index: Index, chunks: DataFrame, queries: DataFrame, k: int = RESULTS["guidance"], lexicon: Lexicon = DEFAULT, found: DataFrame | None = None) -> DataFrame:
    """TOP5: the best disease guidance and anamnesis chunks for a query. found: as for retrieve_cases()."""
    hits = _candidates(index, chunks, queries.select("query", "text"), SEARCHED["guidance"], lexicon, found)
    hits = hits.join(queries.select("query", "detected_symptoms", hint("text", lexicon).alias("asked")), "query")
    kind = F.col("type")
    keep = ((kind == "training") & (F.col("metadata.content_type") == "disease_guidance")) | (kind == "anamnesis")
    boosts = [
        Boost((kind == "training") & F.col("evidence_level").isin(*GUIDELINES), 0.15),
        Boost((kind == "anamnesis") & (F.col("metadata.condition_group") == TROPICAL), 0.12),
        Boost(_symptom(F.col("matched_terms"), F.col("detected_symptoms")), 0.12),
        Boost((F.col("title_hint") != "") & F.contains(F.col("asked"), F.col("title_hint")), 0.2),
    ]
    return rerank(hits, boosts, keep, _dedupe_key(), k).select("query", "id", "type", "title", "score", "evidence_level", "matched_terms", "rank")


def retrieve_bundle(index: Index, chunks: DataFrame, cases: DataFrame, queries: DataFrame, previous: DataFrame | None = None, lexicon: Lexicon = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """TOP6: (items, best cases). previous: (query, case_id) of the session, for queries without a case of their own.

    Cases and guidance take their hits from one search of the queries; the best cases, which are read twice, are stored.
    """
    found = stored(index.search(queries.select("query", "text"), max(SEARCHED["cases"], SEARCHED["guidance"])), "found")
    top = stored(retrieve_cases(index, chunks, cases, queries, RESULTS["cases"], lexicon, found), "cases")
    best = top.where("rank = 1").select("query", F.col("id").alias("case_id"))
    if previous is not None:
        best = best.unionByName(previous.select("query", "case_id").join(best, "query", "left_anti"))
    context = retrieve_context(index, chunks, cases, queries.join(best, "query"), RESULTS["context"], lexicon)
    guidance = retrieve_guidance(index, chunks, queries, BUNDLE["guidance"], lexicon, found)
    columns = ["query", "id", "type", "title", "score", "evidence_level", "matched_terms"]
    parts = [(top.where(F.col("rank") <= BUNDLE["cases"]), 0), (context.where(F.col("rank") <= BUNDLE["context"]), 100), (guidance, 200)]
    items = None
    for df, at in parts:
        one = df.select(*columns, (F.lit(at) + F.col("rank")).alias("ord"))
        items = one if items is None else items.unionByName(one)
    items = dedupe_best(items, ["query", "id"])
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "ord"))
    return items.withColumn("rank", rank), best
