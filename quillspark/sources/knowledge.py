"""Knowledge-base sources: typed readers, and the union of their records as chunks (SRC1-SRC7, SET1-SET3, X1)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import split_list, split_semicolon, template
from ..plans.session import row_numbers


def _schema(texts: str, lists: str = "") -> T.StructType:
    return T.StructType([T.StructField(x, T.StringType()) for x in texts.split()] + [T.StructField(x, T.ArrayType(T.StringType())) for x in lists.split()])


#: Columns of the sources.
CASES = "id keluhan_ringan pertanyaan_anamnesis ramuan_rekomendasi bahan cara_pengolahan dosis_penggunaan catatan_kewaspadaan sumber_ringkas"
FORMULAS = "id nama_formula komposisi gejala_target ringkasan_manfaat evidence_level catatan_keamanan sumber_utama"
HERBS = "id nama_lokal nama_latin bagian_digunakan gejala_target ringkasan_manfaat evidence_level catatan_keamanan sumber_utama"
TRAINING = "id topic formula_name title preparation dosage safety_notes evidence_level source_title source_url curation_method content_type overview diagnosis_summary care_recommendation"
TRAINING_LISTS = "ingredients symptoms prevention_steps warning_signs screening_questions"
ANAMNESIS = "id condition_group suspected_condition sample_user_message triage_action curation_method disclaimer"
ANAMNESIS_LISTS = "primary_symptoms applicable_case_ids required_questions red_flag_questions source_titles source_urls"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether any file matches a path, in whatever file system it is."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return bool(found)


def read_csv(spark: SparkSession, path: str, columns: str, optional: bool = True) -> DataFrame:
    """SRC1-SRC3, SRC7: named columns of a CSV file with header and quotes, as texts; null for columns it hasn't.

    A missing file gives no rows if optional, else an error.
    """
    wanted = columns.split()
    if optional and not exists(spark, path):
        return spark.createDataFrame([], _schema(columns))
    raw = spark.read.options(header=True, quote='"', escape='"', multiLine=True).csv(path)
    return raw.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) if c in raw.columns else F.lit("").alias(c) for c in wanted])


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, optional: bool = True) -> DataFrame:
    """SRC6: rows of a JSON-lines file; blank lines are skipped, other keys ignored."""
    if optional and not exists(spark, path):
        return spark.createDataFrame([], schema)
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def _listed(data: Column, name: str) -> Column:
    """STR7: an array, or a text split at semicolons and bars."""
    array = F.try_variant_get(data, f"$.{name}", "array<string>")
    text = F.try_variant_get(data, f"$.{name}", "string")
    trimmed = F.filter(F.transform(array, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    return F.coalesce(trimmed, F.when(text.isNotNull(), split_list(text)), F.array().cast("array<string>"))


def numbered_lines(lines: DataFrame, valid: Column) -> DataFrame:
    """(file, line, ord, value): lines of text files with their numbers, from 0, in their file, and the valid ones alone with theirs, from 1, over all files.

    lines: value, file and block, where a block is a split of a file, so a large file is read by many tasks. Rows are
    numbered inside their block as they are read and moved up by the lines of the blocks before; of each block
    only two counts meet in one task.
    """
    marked = lines.withColumn("valid", F.coalesce(valid, F.lit(False)))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict = {}
        for b in batches:
            file, block, ok = (b.column(c).to_pylist() for c in ("file", "block", "valid"))
            line, place = [], []
            for f, k, v in zip(file, block, ok):
                n, m = counts.get((f, k), (0, 0))
                line.append(n)
                place.append(m + 1)
                counts[f, k] = n + 1, m + v
            yield pa.record_batch([b.column("file"), b.column("block"), b.column("value"), b.column("valid"), pa.array(line, pa.int64()), pa.array(place, pa.int64())], names=["file", "block", "value", "valid", "line", "ord"])

    inside = marked.select("file", "block", "value", "valid").mapInArrow(number, "file string, block long, value string, valid boolean, line long, ord long").where("valid")
    counts = marked.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.count_if("valid").alias("m"))
    above = W.orderBy("file", "block").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select("file", "block", F.coalesce(F.sum("n").over(above.partitionBy("file")), F.lit(0)).alias("lines"), F.coalesce(F.sum("m").over(above), F.lit(0)).alias("rows"))
    return inside.join(before, ["file", "block"]).select("file", (F.col("line") + F.col("lines")).alias("line"), (F.col("ord") + F.col("rows")).alias("ord"), "value")


def read_records(spark: SparkSession, path: str, texts: str, lists: str, prefix: str | None = None, defaults: dict[str, str] | None = None) -> DataFrame:
    """SRC4, SRC5: records of JSON-lines files with defaults; lists may be texts. ord is the order by file and line.

    A record without id gets `{prefix}_{line:04d}`, or the file's name in place of the prefix. Blank lines and lines
    that are no JSON count as lines but give no record.
    """
    columns = ["id"] + [c for c in texts.split() if c != "id"]
    if not exists(spark, path):
        return spark.createDataFrame([], _schema(" ".join(columns), lists).add("ord", T.LongType()))
    lines = spark.read.option("lineSep", "\n").text(path).select(F.regexp_replace("value", "\r$", "").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    raw = numbered_lines(lines, (F.trim("value") != "") & F.try_parse_json("value").isNotNull()).withColumn("data", F.try_parse_json("value"))
    # a path has its special characters coded
    name = F.url_decode(F.replace(F.regexp_replace("file", r"^.*/", ""), F.lit("+"), F.lit("%2B")))
    stem = F.regexp_replace(name, r"\.jsonl?$", "") if prefix is None else F.lit(prefix)
    def text(name: str) -> Column:
        default = F.format_string("%s_%04d", stem, F.col("line") + 1) if name == "id" else F.lit((defaults or {}).get(name, ""))
        return F.coalesce(F.nullif(F.try_variant_get("data", f"$.{name}", "string"), F.lit("")), default)

    return raw.select(*[text(c).alias(c) for c in columns], *[_listed(F.col("data"), c).alias(c) for c in lists.split()], "ord")


def training_records(spark: SparkSession, path: str) -> DataFrame:
    return read_records(spark, path, TRAINING, TRAINING_LISTS, None, {"content_type": "herbal_guidance"})


def anamnesis_records(spark: SparkSession, path: str) -> DataFrame:
    return read_records(spark, path, ANAMNESIS, ANAMNESIS_LISTS, "anamnesis")


def _joined(names: str) -> Column:
    return F.array_join(F.array(*[F.coalesce(F.array_join(c, " ") if t else F.col(c), F.lit("")) for c, t in ((n.rstrip("*"), n.endswith("*")) for n in names.split())]), " ")


def chunks(cases: DataFrame, formulas: DataFrame, herbs: DataFrame, training: DataFrame, anamnesis: DataFrame) -> DataFrame:
    """SET1, X1: one relation (id, type, title, text, source, evidence_level, case_id, formula_id, herb_id, metadata, ord) of all records, in the order of the arguments."""
    def chunk(df: DataFrame, kind: str, number: int, title: Column, text: Column, source, level, **more) -> DataFrame:
        null = F.lit(None).cast("string")
        meta = {"content_type": null, "condition_group": null, "applicable_case_ids": F.lit(None).cast("array<string>")} | {k: v for k, v in more.items() if not k.endswith("_id")}
        ids = {k: more.get(k, null).alias(k) for k in ("case_id", "formula_id", "herb_id")}
        local = F.col("ord")
        if "ord" not in df.columns:
            df = row_numbers(df, [F.col("id")], "ord", 16)
        return df.select("id", F.lit(kind).alias("type"), title.alias("title"), text.alias("text"), (F.col(source) if source else null).alias("source"), (F.col(level) if level else null).alias("evidence_level"), *ids.values(), F.struct(*[v.alias(k) for k, v in meta.items()]).alias("metadata"), (F.lit(number * 10_000_000) + local).cast("long").alias("ord"))

    guidance = F.col("content_type") == "disease_guidance"
    training_text = F.when(guidance, _joined("title topic overview diagnosis_summary symptoms* prevention_steps* warning_signs* screening_questions* care_recommendation")).otherwise(_joined("title topic formula_name ingredients* symptoms* preparation dosage safety_notes"))
    return (
        chunk(cases.withColumn("items", split_semicolon("bahan")), "case", 1, F.col("keluhan_ringan"), _joined("keluhan_ringan pertanyaan_anamnesis ramuan_rekomendasi items* cara_pengolahan dosis_penggunaan catatan_kewaspadaan"), "sumber_ringkas", None, case_id=F.col("id"))
        .unionByName(chunk(formulas.withColumn("items", split_semicolon("komposisi")), "formula", 2, F.col("nama_formula"), _joined("nama_formula items* gejala_target ringkasan_manfaat catatan_keamanan"), "sumber_utama", "evidence_level", formula_id=F.col("id")))
        .unionByName(chunk(herbs, "herb", 3, F.col("nama_lokal"), _joined("nama_lokal nama_latin bagian_digunakan gejala_target ringkasan_manfaat catatan_keamanan"), "sumber_utama", "evidence_level", herb_id=F.col("id")))
        .unionByName(chunk(training, "training", 4, F.col("title"), training_text, "source_title", "evidence_level", content_type=F.col("content_type")))
        .unionByName(chunk(anamnesis, "anamnesis", 5, F.col("suspected_condition"), _joined("suspected_condition sample_user_message primary_symptoms* required_questions* red_flag_questions* triage_action"), None, None, condition_group=F.col("condition_group"), applicable_case_ids=F.col("applicable_case_ids")))
    )


def health(all_chunks: DataFrame) -> DataFrame:
    """AGG6: chunks by type."""
    return all_chunks.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def topics(spark: SparkSession, path: str, groups: list[str], excluded: list[str], most: int = 8) -> DataFrame:
    """SRC12, FLT23: English health topics of an XML feed in the allowed groups, without excluded titles, with their first related topics."""
    schema = "_id string, _title string, _language string, _url string, `full-summary` string, group array<string>, `related-topic` array<string>"
    t = spark.read.format("xml").option("rowTag", "health-topic").schema(schema).load(path)
    low = F.lower("_title")
    for x in excluded:
        t = t.where(~F.contains(low, F.lit(x.lower())))
    kept = t.where((F.col("_language") == "English") & F.arrays_overlap("group", F.array(*[F.lit(g) for g in groups])))
    return kept.select(F.col("_id").alias("id"), F.col("_title").alias("title"), F.col("_url").alias("url"), F.col("full-summary").alias("summary"), F.filter("group", lambda g: g.rlike(r"^[\x00-\x7F]*$")).alias("groups"), F.slice(F.coalesce("related-topic", F.array().cast("array<string>")), 1, most).alias("related"))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """SRC13: word-processor files as (path, paragraphs); null paragraphs for files of other kinds."""
    from ..functions.parsing import docx_paragraphs

    return spark.read.format("binaryFile").load(path).select("path", docx_paragraphs("content").alias("paragraphs"))


def doc_sections(paragraphs: DataFrame, headings: list[str], key: str = "path") -> DataFrame:
    """STR32: (key, heading, body) of documents: ordered paragraphs below each heading; those before the first one are `intro`.

    paragraphs: key, paragraphs array. A paragraph is a heading if it equals one, or starts or ends with one.
    """
    rows = paragraphs.select(key, F.posexplode("paragraphs").alias("pos", "p"))
    low = F.lower(F.regexp_replace("p", r"[:.]\s*$", ""))
    strict = F.get(F.filter(F.array(*[F.lit(h) for h in headings]), lambda h: low == h), 0)
    loose = F.get(F.filter(F.array(*[F.lit(h) for h in headings]), lambda h: (F.startswith(low, h) | F.endswith(low, h)) & (F.length(low) <= F.length(h) + 20)), 0)
    rows = rows.withColumn("own", F.coalesce(strict, loose))
    rows = rows.withColumn("heading", F.coalesce(F.last("own", ignorenulls=True).over(W.partitionBy(key).orderBy("pos")), F.lit("intro"))).where("own is null")
    pairs = F.array_sort(F.collect_list(F.struct("pos", "p")))
    return rows.groupBy(key, "heading").agg(F.transform(pairs, lambda x: x["p"]).alias("body"))


def fetched(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """SRC8: pages as source rows with a status in place of an error."""
    from ..functions.parsing import page_texts

    p = pages.withColumn("_p", page_texts(html))
    return p.select(F.col(url).alias("source_url"), F.when(F.coalesce(F.col(html), F.lit("")) == "", "fetch_failed").otherwise("fetched").alias("status"), F.col("_p.title").alias("title"), F.substring("_p.text", 1, 1200).alias("excerpt"))


def prompt(pattern: str, **columns) -> Column:
    """STR39 for chunks and prompts."""
    return template(pattern, **columns)
