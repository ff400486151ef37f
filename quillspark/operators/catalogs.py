"""Catalogues from curated sources: herbs, formulas, cases, training records and chat rows (CUR1, CUR4, X12-X14, X18, X22-X23, JN10, JN13-JN14, SET2, STR35, TOP8-TOP9, ARR4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import as_sentence, limit_text, nfkc, normalize_key, null_if_blank, squeeze
from .curate import expand, first_by_key, match_profiles, merge_entities, numbered, with_legacy, with_overrides


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean_source_text(text) -> Column:
    """Compatibility composition, without carriage returns and soft hyphens."""
    return F.translate(nfkc(_c(text)), "\r­", "")


def scientific_name(text) -> Column:
    """STR35: a two-part Latin name after its label; null if there is none."""
    return F.nullif(F.regexp_extract(_c(text), r"(?i)(?:scientific|latin|botanical) names?\s*[:\-]?\s*((?-i:[A-Z][a-z]+ [a-z]+))", 1), F.lit(""))


def part_used(text) -> Column:
    """STR35: the plant part that a text names first in this order."""
    low = F.lower(_c(text))
    out = F.lit("tidak disebutkan")
    for word, part in reversed((("rhizome", "rimpang"), ("root", "akar"), ("leaf", "daun"), ("leaves", "daun"), ("flower", "bunga"), ("fruit", "buah"), ("seed", "biji"), ("bark", "kulit batang"))):
        out = F.when(F.contains(low, F.lit(word)), F.lit(part)).otherwise(out)
    return out


def merged_sources(sources: DataFrame, order: str = "ord") -> DataFrame:
    """AGG8 for herb sources: display, scientific, aliases (array), text, url, level; one row for each scientific or display name."""
    key = normalize_key(F.coalesce(null_if_blank("scientific"), null_if_blank("display")))
    return merge_entities(sources, key, order, first=["display", "scientific"], joined=["text", "url"], lists=["aliases"], evidence="level").where("merge_key <> ''")


def herb_rows(merged: DataFrame, legacy: DataFrame) -> DataFrame:
    """X13, TOP8: herbs by name in whatever case, then scientific name, numbered; legacy herbs fill gaps, then follow."""
    rows = merged.select(F.col("merge_key").alias("key"), F.coalesce(null_if_blank("display"), F.col("scientific")).alias("nama_lokal"), F.col("scientific").alias("nama_latin"), limit_text("text", 400).alias("ringkasan_manfaat"), F.col("level").alias("evidence_level"), F.col("url").alias("sumber_utama"))
    both = with_legacy(rows, legacy, "key", ["ringkasan_manfaat", "sumber_utama"])
    return numbered(both, [F.lower("nama_lokal"), F.coalesce("nama_latin", F.lit("")), "key"], "id", "herb_%04d", 8)


def formula_rows(merged: DataFrame, profiles: dict[str, dict], legacy: DataFrame, k: int = 4) -> DataFrame:
    """X12, X13, JN9, JN10: legacy formulas, then each source with each profile whose keyword it has, the k best; one row for each key, numbered.

    profiles: label -> {keywords, context}. legacy: nama_formula, komposisi, gejala_target, evidence_level.
    """
    spark = merged.sparkSession
    hits = match_profiles(merged, F.col("text"), {p: v["keywords"] for p, v in profiles.items()}, k, "merge_key")
    contexts = spark.createDataFrame([(p, v.get("context", "")) for p, v in profiles.items()], "profile string, konteks_penggunaan string")
    made = hits.join(merged, "merge_key").join(F.broadcast(contexts), "profile")
    made = made.select(F.concat(F.coalesce(null_if_blank("display"), F.col("scientific")), F.lit(" untuk "), F.col("profile")).alias("nama_formula"), F.coalesce(null_if_blank("display"), F.col("scientific")).alias("komposisi"), F.col("profile").alias("gejala_target"), "konteks_penggunaan", F.col("evidence").alias("evidence_level"), (F.lit(1_000_000) + F.col("ord") * 10 + F.col("rank")).cast("long").alias("ord"))
    old = legacy.select("nama_formula", "komposisi", "gejala_target", F.lit("").alias("konteks_penggunaan"), "evidence_level", F.col("ord").cast("long").alias("ord"))
    rows = first_by_key(old.unionByName(made).withColumn("key", normalize_key(F.concat_ws("|", "nama_formula", "gejala_target"))), ["key"], "ord")
    return numbered(rows, ["ord", "key"], "id", "formula_%04d", 8)


def case_rows(formulas: DataFrame, complaints: dict[str, list[str]], legacy: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Legacy cases, then each formula with each wording of its complaint; one row for each key, numbered."""
    spark = formulas.sparkSession
    wordings = spark.createDataFrame([(p, i, w) for p, ws in complaints.items() for i, w in enumerate(ws)], "gejala_target string, variant int, keluhan_ringan string")
    made = formulas.join(F.broadcast(wordings), "gejala_target").select("keluhan_ringan", F.col("nama_formula").alias("ramuan_rekomendasi"), F.col("komposisi").alias("bahan"), (F.lit(1_000_000) + F.col("ord") * 10 + F.col("variant")).cast("long").alias("ord"))
    old = legacy.select("keluhan_ringan", "ramuan_rekomendasi", "bahan", F.col("ord").cast("long").alias("ord"))
    rows = first_by_key(old.unionByName(made).withColumn("key", normalize_key(F.concat_ws("|", "keluhan_ringan", "ramuan_rekomendasi"))), ["key"], "ord")
    if overrides is not None:
        rows = with_overrides(rows, overrides, ["ramuan_rekomendasi", "bahan"], "cara_pengolahan", F.lit("Cuci bersih bahan, lalu seduh atau rebus secukupnya."), "ord")
    return numbered(rows, ["ord", "key"], "id", "case_%04d", 8)


def training_rows(herbs: DataFrame, formulas: DataFrame, cases: DataFrame) -> DataFrame:
    """CUR4: herbs, formulas and cases as training records (id, topic, title, ingredients, symptoms, overview, evidence_level)."""
    def record(df: DataFrame, kind: str, title: str, items: str, symptom: Column, overview: Column, level: Column) -> DataFrame:
        return df.select(F.concat(F.lit(f"train_{kind}_"), F.col("id")).alias("id"), F.lit(kind).alias("topic"), F.col(title).alias("title"), F.split(F.col(items), r"\s*;\s*").alias("ingredients"), F.array(symptom).alias("symptoms"), overview.alias("overview"), level.alias("evidence_level"))

    null = F.lit(None).cast("string")
    return (
        record(herbs, "herb", "nama_lokal", "nama_lokal", null, F.col("ringkasan_manfaat"), F.col("evidence_level"))
        .unionByName(record(formulas, "formula", "nama_formula", "komposisi", F.col("gejala_target"), F.col("konteks_penggunaan"), F.col("evidence_level")))
        .unionByName(record(cases, "case", "ramuan_rekomendasi", "bahan", F.col("keluhan_ringan"), F.col("keluhan_ringan"), null))
    )


def chat_rows(records: DataFrame, variants: dict[str, str], system: str) -> DataFrame:
    """X14, X21-X23, JN16: chat rows of each record with each variant's question; `{title}` stands for the record's title."""
    spark = records.sparkSession
    asked = spark.createDataFrame(list(variants.items()), "variant string, question string")
    rows = expand(records, asked)
    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    answer = F.concat_ws(" ", as_sentence("title"), as_sentence(squeeze(F.coalesce("overview", F.lit("")))), F.when(F.size("ingredients") > 0, F.concat(F.lit("Bahan: "), F.array_join("ingredients", ", "), F.lit("."))))
    return rows.select(F.concat_ws("_", F.lit("sft"), F.col("id"), F.col("variant")).alias("id"), F.col("id").alias("source_record_id"), "variant", F.array(message("system", F.lit(system)), message("user", F.replace("question", F.lit("{title}"), F.col("title"))), message("assistant", F.trim(answer))).alias("messages"))


def build_catalog(sources: DataFrame, profiles: dict[str, dict], legacy: dict[str, DataFrame], variants: dict[str, str], system: str, overrides: DataFrame | None = None) -> dict[str, DataFrame]:
    """CUR1: merge -> match -> herbs, formulas, cases -> training records -> chat rows."""
    merged = merged_sources(sources)
    herbs = herb_rows(merged, legacy["herbs"])
    formulas = formula_rows(merged, profiles, legacy["formulas"])
    cases = case_rows(formulas, {p: v.get("complaints", [p]) for p, v in profiles.items()}, legacy["cases"], overrides)
    records = training_rows(herbs, formulas, cases)
    return {"herbs": herbs, "formulas": formulas, "cases": cases, "records": records, "chat": chat_rows(records, variants, system)}


def with_source(records: DataFrame, sources: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """JN13, JN14: records with columns of their sources, by id; records without one are dropped."""
    return records.join(sources.select(key, *columns), key)


def combined(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """SET2, SET3: all rows of several JSON-lines files."""
    return spark.read.schema(schema).json(paths)


def newest(rows: DataFrame, time: str, k: int = 40, ties: list[str] | None = None) -> DataFrame:
    """TOP9: the newest rows; of equally new ones the first by `ties`, by all columns where none are named."""
    return rows.orderBy(F.desc(time), *(ties if ties is not None else rows.columns)).limit(k)


def flat_metadata(metadata: Column, fields: list[str], lists: list[str]) -> Column:
    """ARR4: a struct as a map of texts: lists joined by `; `, nulls left out."""
    pairs = [F.struct(F.lit(f).alias("k"), (F.array_join(metadata[f], "; ") if f in lists else metadata[f].cast("string")).alias("v")) for f in fields]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["v"].isNotNull()))
