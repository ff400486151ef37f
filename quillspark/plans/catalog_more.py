"""Further queries, each with the same as SQL: sources and sinks through written files, dialogue rules, curation, replies, scores."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dataset_wording as generated
from ..functions import parsing, scoring, signals, tables, text, wording
from ..functions.lexicon import DEFAULT
from ..operators import bundle, catalogs, curate, datasets, dialogue, replies, split
from ..operators.components import connected, grown
from ..operators.retrieval import TfidfIndex, cosine
from ..operators.vector_index import VectorIndex
from ..sources import knowledge, sinks
from ..streaming import chat
from . import oracle
from .catalog import _keys, seeded, table
from .oracle import _CLEARED, _DETAIL, _FEEDBACK, _MARKS, _RUNNING, _SEEDED, _TEMPERATURE, _duration, _marked, any_of, norm, q, squeeze, stable_hash, tokens
from .session import stored, work_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    """Registers a query with its SQL."""

    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _array(items) -> str:
    return "[" + ", ".join(q(x) for x in items) + "]::VARCHAR[]"


def _joined(c) -> F.Column:
    return F.array_join(c, "|")


def _sql_template(pattern: str, **parts: str) -> str:
    """A template as SQL; null counts as empty."""
    out = []
    for literal, name in re.findall(r"([^{]*)(?:\{(\w+)\})?", pattern):
        out += [q(literal)] if literal else []
        out += [f"coalesce({parts[name]}, '')"] if name else []
    return " || ".join(out)


# Sources and sinks


@query(f"SELECT CAST(doc_id AS VARCHAR) AS id, coalesce(text, '') AS keluhan_ringan, '' AS pertanyaan_anamnesis, coalesce(lang, '') AS ramuan_rekomendasi, 'a \"q\", b' AS bahan, {', '.join(f'{q(str())} AS {c}' for c in knowledge.CASES.split()[5:])} FROM documents")
def csv_round_trip(spark, sf):
    """Whole texts with quotes and line breaks through a CSV file; columns that it lacks are empty."""
    path = work_folder(spark, "csv")
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("keluhan_ringan"), F.col("lang").alias("ramuan_rekomendasi"), F.lit('a "q", b').alias("bahan"), F.lit(1).alias("other"))
    sinks.write_csv(d, path)
    return knowledge.read_csv(spark, path, knowledge.CASES, optional=False)


@query("SELECT doc_id, text, n_chars FROM documents")
def jsonl_round_trip(spark, sf):
    path = work_folder(spark, "jsonl")
    sinks.write_jsonl(table(spark, sf, "documents").select("doc_id", "text", "n_chars", F.lit("x").alias("other")), path)
    return knowledge.read_jsonl(spark, path, "doc_id bigint, text string, n_chars bigint", optional=False)


@query("SELECT conv_id, turn, role, text FROM conversations")
def jsonl_append(spark, sf):
    """Two appends to one log."""
    path, c = work_folder(spark, "log"), table(spark, sf, "conversations")
    for role in ("role = 'user'", "role <> 'user'"):
        sinks.append_jsonl(c.where(role), path)
    return knowledge.read_jsonl(spark, path, "conv_id bigint, turn bigint, role string, text string")


@query("""SELECT 'r' || doc_id AS id, source AS title, lang || '|' || source || '|x' AS symptoms, lang || '|' || source AS ingredients, CASE WHEN doc_id % 3 = 0 THEN 'disease_guidance' ELSE 'herbal_guidance' END AS content_type, text AS overview, '' AS dosage FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL""")
def record_readers(spark, sf):
    """Records with lists that are texts or arrays, defaults and unknown keys."""
    path, d = work_folder(spark, "records"), table(spark, sf, "documents").where("lang is not null and source is not null")
    rows = d.select(F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("id"), F.col("source").alias("title"), F.concat(F.col("lang"), F.lit("; "), F.col("source"), F.lit(" | ;x")).alias("symptoms"), F.array("lang", F.lit(" "), "source").alias("ingredients"), F.when(F.col("doc_id") % 3 == 0, "disease_guidance").alias("content_type"), F.col("text").alias("overview"), F.lit(1).alias("unknown"))
    sinks.write_jsonl(rows, path)
    r = knowledge.training_records(spark, f"{path}/*.json")
    return r.select("id", "title", _joined("symptoms").alias("symptoms"), _joined("ingredients").alias("ingredients"), "content_type", "overview", "dosage")


@query("SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN label + 100 ELSE label END AS label FROM embeddings WHERE vec_id % 3 <> 0 OR vec_id % 2 = 0")
def vector_upsert(spark, sf):
    """New vectors replace those of the same key."""
    path, v = work_folder(spark, "vectors"), table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("bigint").alias("label"))
    sinks.upsert_vectors(v.where("vec_id % 3 <> 0"), path, "vec_id")
    sinks.upsert_vectors(v.where("vec_id % 2 = 0").withColumn("label", F.col("label") + 100), path, "vec_id")
    return sinks.read_vectors(spark, path)


@query("""WITH v AS (SELECT 'vec-' || vec_id AS key, CASE WHEN vec_id % 5 = 0 THEN list_reverse(CAST(embedding AS DOUBLE[])) ELSE CAST(embedding AS DOUBLE[]) END AS e FROM embeddings),
    s AS (SELECT 'q-' || a.vec_id AS query, b.key, round(greatest(0, least(1, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), b.e))), 4) AS score FROM embeddings a, v b WHERE a.vec_id % 100 = 0)
    SELECT query, key, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS INTEGER) AS rank FROM s QUALIFY rank <= 10""")
def stored_vector_search(spark, sf):
    """A stored index with text keys, filled in two batches of which the second replaces a fifth of the vectors; queries look into all lists, so it is exact at any size."""
    path, e = work_folder(spark, "index"), table(spark, sf, "embeddings")
    v = e.select(F.concat(F.lit("vec-"), F.col("vec_id").cast("string")).alias("id"), F.col("embedding").cast("array<double>").alias("embedding"), "vec_id")
    index = VectorIndex.create(v.drop("vec_id"), path)
    index.insert(v.where("vec_id % 5 = 0").select("id", F.reverse("embedding").alias("embedding")))
    asked = v.where("vec_id % 100 = 0").select(F.regexp_replace("id", "^vec", "q").alias("query"), "embedding")
    opened = VectorIndex(spark, path)
    return opened.search_vectors(asked, 10, probes=len(opened.centers)).drop("tokens")


@query("""SELECT printf('doc_%04d', row_number() OVER (ORDER BY doc_id)) AS id, row_number() OVER (ORDER BY doc_id) AS ord, coalesce(text, '') AS overview FROM documents""")
def line_ids(spark, sf):
    """Records without ids get their line's number, and all of them an order, from one file that is read in blocks."""
    path = work_folder(spark, "lines")
    table(spark, sf, "documents").coalesce(1).sortWithinPartitions("doc_id").select(F.col("text").alias("overview")).write.option("ignoreNullFields", "false").json(path)
    return knowledge.read_records(spark, f"{path}/*.json", "id overview", "", "doc").select("id", "ord", "overview")


@query(oracle.SQL["leakage_components"])
def grown_components(spark, sf):
    """Components of half of the links, to which the other half is added."""
    pairs = _keys(spark, sf)
    low = pairs.groupBy("key").agg(F.min("row_id").alias("a"))
    links = pairs.join(low, "key").select("a", F.col("row_id").alias("b"))
    labels = stored(connected(links.where("b % 2 = 0")), "labels")
    found = grown(labels, links.where("b % 2 = 1"))
    return pairs.select("row_id").distinct().join(found, F.col("row_id") == F.col("id"), "left").select(F.col("row_id").alias("doc_id"), F.coalesce("component", "row_id").alias("component"))


@query("SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM pages) AS pages, 'x' AS note")
def manifest_round_trip(spark, sf):
    path = work_folder(spark, "manifest")
    counts = [table(spark, sf, t).agg(F.count(F.lit(1)).alias(t)) for t in ("documents", "pages")]
    sinks.manifest(counts[0].crossJoin(counts[1]).withColumn("note", F.lit("x")), path)
    return spark.read.json(path)


@query("SELECT conv_id, string_agg(role, ' | ' ORDER BY turn) AS roles, count(*) AS n FROM conversations GROUP BY conv_id")
def flat_list_export(spark, sf):
    path = work_folder(spark, "lists")
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(curate.ordered("turn", "role").alias("roles"), F.count(F.lit(1)).alias("n"))
    sinks.write_csv(sinks.flat_lists(c), path)
    return spark.read.options(header=True, quote='"', escape='"').schema("conv_id bigint, roles string, n bigint").csv(path)


@query("SELECT url AS source_url, CASE WHEN coalesce(html, '') = '' THEN 'fetch_failed' ELSE 'fetched' END AS status FROM pages")
def fetched_pages(spark, sf):
    return knowledge.fetched(table(spark, sf, "pages")).select("source_url", "status")


def _chunk_sources(spark, sf) -> tuple[DataFrame, ...]:
    """Cases, formulas, herbs, training and anamnesis records made of the test tables."""

    def full(df: DataFrame, columns: str, lists: str = "", **made) -> DataFrame:
        given = [made.get(c, F.lit("")).alias(c) for c in columns.split()]
        return df.select(*given, *[made.get(c, F.array().cast("array<string>")).alias(c) for c in lists.split()], *([made["ord"].alias("ord")] if "ord" in made else []))

    def name(prefix: str, c: str) -> F.Column:
        return F.concat(F.lit(prefix), F.col(c).cast("string"))

    cases = full(table(spark, sf, "region"), knowledge.CASES, id=name("case_", "r_regionkey"), keluhan_ringan=F.col("r_name"), bahan=F.concat(F.lit("a; "), F.col("r_name")), sumber_ringkas=F.lit("book"))
    formulas = full(table(spark, sf, "nation"), knowledge.FORMULAS, id=name("formula_", "n_nationkey"), nama_formula=F.col("n_name"), komposisi=F.lit("x;y"), gejala_target=F.lit("z"), evidence_level=F.lit("high"))
    herbs = full(table(spark, sf, "part"), knowledge.HERBS, id=name("herb_", "p_partkey"), nama_lokal=F.col("p_name"), nama_latin=F.col("p_type"), sumber_utama=F.col("p_brand"))
    kind = F.when(F.col("doc_id") % 2 == 0, "disease_guidance").otherwise("herbal_guidance")
    training = full(table(spark, sf, "documents"), knowledge.TRAINING, knowledge.TRAINING_LISTS, id=name("t_", "doc_id"), title=F.col("source"), topic=F.col("lang"), overview=F.col("text"), content_type=kind, symptoms=F.array("lang", "source"), evidence_level=F.lit("medium"), source_title=F.lit("s"), ord=F.col("doc_id"))
    asked = table(spark, sf, "conversations").where("turn = 0")
    anamnesis = full(asked, knowledge.ANAMNESIS, knowledge.ANAMNESIS_LISTS, id=name("a_", "conv_id"), suspected_condition=F.col("role"), sample_user_message=F.col("text"), required_questions=F.array(F.lit("q?"), F.lit("r?")), ord=F.col("conv_id"))
    return cases, formulas, herbs, training, anamnesis


_CHUNKS = """chunks AS (
    SELECT 'case_' || r_regionkey AS id, 'case' AS type, r_name AS title, array_to_string([r_name, '', '', 'a ' || r_name, '', '', ''], ' ') AS text, 'book' AS source, NULL AS evidence_level, r_regionkey AS o FROM region
    UNION ALL SELECT 'formula_' || n_nationkey, 'formula', n_name, array_to_string([n_name, 'x y', 'z', '', ''], ' '), '', 'high', n_nationkey FROM nation
    UNION ALL SELECT 'herb_' || p_partkey, 'herb', p_name, array_to_string([p_name, p_type, '', '', '', ''], ' '), p_brand, '', p_partkey FROM part
    UNION ALL SELECT 't_' || doc_id, 'training', source, CASE WHEN doc_id % 2 = 0 THEN array_to_string([coalesce(source, ''), coalesce(lang, ''), coalesce(text, ''), '', concat_ws(' ', lang, source), '', '', '', ''], ' ') ELSE array_to_string([coalesce(source, ''), coalesce(lang, ''), '', '', concat_ws(' ', lang, source), '', '', ''], ' ') END, 's', 'medium', doc_id FROM documents
    UNION ALL SELECT 'a_' || conv_id, 'anamnesis', role, array_to_string([coalesce(role, ''), coalesce(text, ''), '', 'q? r?', '', ''], ' '), NULL, NULL, conv_id FROM conversations WHERE turn = 0)"""


@query(f"WITH {_CHUNKS} SELECT id, type, title, text, source, evidence_level FROM chunks")
def knowledge_chunks(spark, sf):
    """One relation of all records, with whole texts."""
    return knowledge.chunks(*_chunk_sources(spark, sf)).select("id", "type", "title", "text", "source", "evidence_level")


@query(f"WITH {_CHUNKS} SELECT type, count(*) AS n FROM chunks GROUP BY type")
def knowledge_health(spark, sf):
    return knowledge.health(knowledge.chunks(*_chunk_sources(spark, sf)))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_partkey % 4 = 0 THEN 'Vaccine shots' ELSE p_name END AS title, p_type || '|' || p_brand AS groups, array_to_string(string_split(p_name, ' ')[1:2], '|') AS related
    FROM part WHERE p_partkey % 3 = 0 AND p_type IN ('ECONOMY', 'SMALL') AND p_partkey % 4 <> 0""")
def xml_topics(spark, sf):
    """English topics of an XML feed in an allowed group, without excluded titles; the feed is written row by row."""
    path, p = work_folder(spark, "xml"), table(spark, sf, "part")
    lang, title = F.when(F.col("p_partkey") % 3 == 0, "English").otherwise("Spanish"), F.when(F.col("p_partkey") % 4 == 0, "Vaccine shots").otherwise(F.col("p_name"))
    related = F.array_join(F.transform(F.concat(F.split("p_name", " "), F.array(F.lit("z"))), lambda x: F.concat(F.lit("<related-topic>"), x, F.lit("</related-topic>"))), "")
    topic = F.concat(F.lit('<health-topic id="'), F.col("p_partkey").cast("string"), F.lit('" title="'), title, F.lit('" language="'), lang, F.lit('" url="u"><full-summary>s</full-summary><group>'), "p_type", F.lit("</group><group>"), "p_brand", F.lit("</group><group>日</group>"), related, F.lit("</health-topic>"))
    ends = spark.createDataFrame([(-1, "<health-topics>"), (1 << 40, "</health-topics>")], "o long, value string")
    rows = p.select(F.col("p_partkey").alias("o"), topic.alias("value")).unionByName(ends)
    rows.coalesce(1).sortWithinPartitions("o").select("value").write.text(path)
    t = knowledge.topics(spark, path, ["ECONOMY", "SMALL"], ["shots"], 2)
    return t.select("id", "title", _joined("groups").alias("groups"), _joined("related").alias("related"))


# Texts


@query(f"""WITH t AS (SELECT item_id, text, {tokens('text')} AS t, {squeeze('text')} AS s FROM benchmark)
    SELECT item_id, array_to_string(list_concat(t, list_transform(range(1, greatest(len(t), 1)), lambda i: t[i] || '__' || t[i + 1])), '|') AS bigrams, array_to_string(t, ' ') AS hint,
        array_to_string(list_filter(list_transform(string_split(replace(text, ' ', ' ; '), ';'), lambda x: trim(x)), lambda x: x <> ''), '|') AS by_semicolon,
        array_to_string(list_filter(list_transform(regexp_split_to_array(replace(text, 'a', '|'), '[;|]'), lambda x: trim(x)), lambda x: x <> ''), '|') AS by_bar,
        array_to_string(list_filter(list_transform(regexp_split_to_array(text || ' and x', '(?i);|,|\\band\\b'), lambda x: trim(x)), lambda x: x <> ''), '|') AS names,
        substr(replace({squeeze('text')}, 'the', 'THE'), 1, 260) AS friendly,
        trim(array_to_string(list_transform(string_split(trim(replace(' ' || lower(s) || ' ', ' of the ', ' dari itu ')), ' '), lambda w: CASE w WHEN 'and' THEN 'dan' WHEN 'with' THEN 'dengan' ELSE w END), ' ')) AS label
    FROM t""")
def text_lists(spark, sf):
    """Tokens with pairs, lists by several separators, plain-language and label replacements."""
    b = table(spark, sf, "benchmark")
    return b.select(
        "item_id",
        _joined(text.bigrams(text.tokenize("text"))).alias("bigrams"),
        text.hint("text").alias("hint"),
        _joined(text.split_semicolon(F.replace(F.col("text"), F.lit(" "), F.lit(" ; ")))).alias("by_semicolon"),
        _joined(text.split_list(F.replace(F.col("text"), F.lit("a"), F.lit("|")))).alias("by_bar"),
        _joined(text.split_names(F.concat("text", F.lit(" and x")))).alias("names"),
        text.patient_friendly("text", {"the": "THE"}).alias("friendly"),
        text.translate_label("text", {"of the": "dari itu"}, {"and": "dan", "with": "dengan"}).alias("label"),
    )


@query("""WITH c AS (SELECT conv_id, turn, text, trim(replace(text, ';', '.')) AS w FROM conversations WHERE role = 'user'),
    s AS (SELECT *, list_filter(list_transform(string_split(w, '.'), lambda x: trim(x, ' .')), lambda x: x <> '') AS a, list_filter(list_transform(string_split(w, ','), lambda x: trim(x, ' ,')), lambda x: x <> '') AS b FROM c),
    p AS (SELECT *, CASE WHEN len(a) >= 2 THEN a ELSE b END AS x FROM s)
    SELECT conv_id, turn, CASE WHEN len(x) = 0 THEN CASE WHEN text = '' THEN 'none' ELSE text END ELSE array_to_string(x[1:8], '|') END AS steps, array_to_string(list_concat(['u'], list_transform(regexp_extract_all('PMID 12 and PMID 7', 'PMID (\\d+)', 1), lambda n: 'https://pubmed.ncbi.nlm.nih.gov/' || n || '/')), '; ') || CASE WHEN contains(lower(text), 'est') THEN '; https://k' ELSE '' END AS urls,
        starts_with(lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')), 'la ') OR starts_with(lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')), 'the ') AS heading FROM p""")
def preparation_and_references(spark, sf):
    """Steps of whole texts, addresses of references, heading tests."""
    c = table(spark, sf, "conversations").where("role = 'user'")
    urls = text.reference_urls(F.concat(F.lit("PMID 12 and PMID 7 "), F.col("text")), F.lit("u"), {"est": "https://k"})
    return c.select("conv_id", "turn", _joined(text.preparation_steps("text", default="none")).alias("steps"), urls.alias("urls"), text.is_heading("text", ["la ", "the "]).alias("heading"))


@query(r"""WITH d AS (SELECT doc_id, regexp_replace(replace(text, chr(13), ''), '\n{3,}', chr(10) || chr(10), 'g') AS t, text, 'Say: ' || coalesce(source, '') || '  -- ' || coalesce(lang, '') || '!' AS f FROM documents)
    SELECT doc_id, coalesce(nullif(regexp_replace(t, '^\s+|\s+$', '', 'g'), ''), '-') AS exported, replace(replace(replace(replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&apos;'), chr(10), '&#10;') AS xml,
        lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(f, '[^a-zA-Z0-9\s-]+', '', 'g'), '\s+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g')) AS name FROM d""")
def export_texts(spark, sf):
    """Whole texts for export, with references, and file names."""
    d = table(spark, sf, "documents")
    name = F.concat(F.lit("Say: "), F.coalesce("source", F.lit("")), F.lit("  -- "), F.coalesce("lang", F.lit("")), F.lit("!"))
    return d.select("doc_id", text.export_text("text").alias("exported"), text.escaped("text").alias("xml"), text.file_name(name).alias("name"))


# Rules of the dialogue

@query(f"""WITH {_MARKS}, f AS (SELECT sn.conv_id, sn.turn, conv_id % 4 AS n_hits, (turn * 7 % 10) / 20.0::DOUBLE AS best, coalesce(present, '') <> '' AS has_present, hinted IS NOT NULL AS has_hint, turn % 4 AS asked, {_duration()} IS NOT NULL AS duration, {any_of('n', DEFAULT.intensity)} AS detail,
        CASE conv_id % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'unsupported' WHEN 2 THEN NULL ELSE 'supported' END AS scope, turn % 3 = 0 AS refer, turn % 5 = 0 AS enough, CASE WHEN turn % 2 = 0 THEN 'q?' ELSE '' END AS question
        FROM sn LEFT JOIN ss USING (conv_id, turn) LEFT JOIN hc USING (conv_id, turn))
    SELECT conv_id, turn, CASE WHEN n_hits = 0 THEN false WHEN has_present OR has_hint THEN true ELSE best >= 0.28 END AS supported, coalesce(scope IN ('critical', 'internal_medicine') OR refer, false) AS referral, coalesce(scope = 'unsupported', false) AS unsupported,
        CASE WHEN scope IS NULL THEN asked < 3 ELSE scope = 'supported' AND NOT enough AND question <> '' AND asked < 3 END AS asks,
        coalesce(scope, '') = 'supported' AND asked > 0 AND has_present AND duration AND detail AND (detail OR asked >= 2) AS final_now FROM f""")
def flow_rules(spark, sf):
    """Support, referral, follow-up and early end of a conversation."""
    c = signals.analyze(seeded(spark, sf))
    scope = F.when(F.col("conv_id") % 5 == 0, "critical").when(F.col("conv_id") % 5 == 1, "unsupported").when(F.col("conv_id") % 5 == 2, F.lit(None).cast("string")).otherwise("supported")
    c = c.withColumns({"scope": scope, "asked": F.col("turn") % 4, "duration": F.col("duration_text").isNotNull(), "question": F.when(F.col("turn") % 2 == 0, "q?").otherwise("")})
    detail = F.col("has_intensity_signal")
    return c.select(
        "conv_id",
        "turn",
        signals.supports_flow(F.col("conv_id") % 4, "present_symptoms", "hinted_case_ids", F.col("turn") * 7 % 10 / 20.0).alias("supported"),
        signals.needs_referral("scope", F.col("turn") % 3 == 0).alias("referral"),
        signals.unsupported("scope").alias("unsupported"),
        signals.asks_follow_up("scope", F.col("turn") % 5 == 0, "question", "asked").alias("asks"),
        F.coalesce(signals.force_final("scope", "asked", F.size("present_symptoms") > 0, "duration", detail, detail), F.lit(False)).alias("final_now"),
    )


_NOTE = f"CASE WHEN m IN ({', '.join(map(q, signals.NEGATIVE_ANSWERS))}) AND {any_of('h', signals.SAFETY_TERMS)} THEN {q(signals.SAFETY_NOTE)} WHEN m IN ({', '.join(map(q, signals.NEGATIVE_ANSWERS))}) AND {any_of('h', signals.FEVER_TERMS)} THEN {q(signals.FEVER_NOTE)} END"


@query(f"""WITH c AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'Tidak ada!' WHEN 1 THEN 'gak' ELSE text END AS message, CASE conv_id % 3 WHEN 0 THEN 'Apakah ada sesak?' WHEN 1 THEN 'Ada ruam?' ELSE text END AS asked, text FROM conversations),
    n AS (SELECT *, {norm('message')} AS m, {norm('asked')} AS h, list_distinct(list_filter(string_split({norm('text')}, ' '), lambda w: length(w) > 2)) AS x, ['the', 'que', 'der', 'est'] AS y FROM c)
    SELECT conv_id, turn, {_NOTE} AS note, turn % 2 = 0 AND conv_id % 2 = 0 AS after, len(list_intersect(x, y)) >= greatest(1, least(len(x), 4) // 2) AS same_name, NOT {any_of('lower(text)', ('forbidden', 'est'))} AS allowed, turn % 2 = 0 AS missing FROM n""")
def turn_rules(spark, sf):
    """Notes of bare denials, turns after a recommendation, matching names, denied terms, missing models."""
    c = table(spark, sf, "conversations")
    c = c.withColumns({"message": F.when(F.col("turn") % 3 == 0, "Tidak ada!").when(F.col("turn") % 3 == 1, "gak").otherwise(F.col("text")), "asked": F.when(F.col("conv_id") % 3 == 0, "Apakah ada sesak?").when(F.col("conv_id") % 3 == 1, "Ada ruam?").otherwise(F.col("text"))})
    return c.select(
        "conv_id",
        "turn",
        signals.contextual_note("message", "asked").alias("note"),
        signals.after_recommendation(F.col("turn") % 2 == 0, F.when(F.col("conv_id") % 2 == 0, "final_recommendation")).alias("after"),
        signals.names_match("text", F.lit("the que der est")).alias("same_name"),
        signals.recommendation_allowed(F.array("text"), ["forbidden", "est"]).alias("allowed"),
        signals.missing_model(F.when(F.col("turn") % 2 == 0, "HTTP 404: Not Found").otherwise("HTTP 500: not found")).alias("missing"),
    )


@query("""WITH s AS (SELECT conv_id AS session_id, conv_id % 3 AS kind, count(*) AS n FROM conversations GROUP BY conv_id)
    SELECT session_id, CAST(CASE WHEN kind = 1 THEN 1 ELSE n END AS BIGINT) AS turns, CASE WHEN kind = 1 THEN 7 ELSE greatest(session_id - 5, 0) END AS question_count, CASE WHEN kind = 1 THEN 's' ELSE 'a|b|c' END AS suspected,
        CASE WHEN kind = 1 THEN 'user' ELSE 'assistant' END AS last_role FROM s""")
def session_sync(spark, sf):
    """Sessions that the server has with turns, without turns, or not at all, completed from the client."""
    c = table(spark, sf, "conversations")
    kind = "session_id bigint, turns array<struct<role:string,content:string>>, question_count bigint, suspected_conditions array<string>"
    sessions = c.groupBy(F.col("conv_id").alias("session_id")).agg(F.count(F.lit(1)).cast("int").alias("n"))

    def of(df: DataFrame, turns, count, suspected) -> DataFrame:
        return df.select("session_id", turns.alias("turns"), F.lit(count).cast("bigint").alias("question_count") if isinstance(count, int) else count.alias("question_count"), F.array(*[F.lit(x) for x in suspected]).cast("array<string>").alias("suspected_conditions")).to(spark.createDataFrame([], kind).schema)

    one = F.array(F.struct(F.lit("user").alias("role"), F.lit("x").alias("content")))
    server = of(sessions.where("session_id % 3 = 1"), one, 7, ["s"]).unionByName(of(sessions.where("session_id % 3 = 2"), F.slice(one, 1, 0), 3, ["t"]))
    client = of(sessions, F.array_repeat(F.struct(F.lit("bot").alias("role"), F.lit("y").alias("content")), F.col("n")), F.col("session_id") - 5, ["a", "b", "c", "d"])
    r = dialogue.synced(server, client)
    return r.select("session_id", F.size("turns").cast("bigint").alias("turns"), "question_count", _joined("suspected_conditions").alias("suspected"), F.element_at("turns", -1)["role"].alias("last_role"))


@query("""WITH f AS (SELECT conv_id, turn, role, text FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE conv_id % 4 = 0))
    SELECT conv_id, turn, role FROM f WHERE role = 'assistant' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1""")
def cleared_and_first(spark, sf):
    """Sessions without the cleared ones, and the first reply of each."""
    c = table(spark, sf, "conversations")
    left = dialogue.cleared(c, c.where("conv_id % 4 = 0").select("conv_id").distinct(), "conv_id")
    return dialogue.first_of_kind(left, "conv_id", F.col("role") == "assistant", "turn").select("conv_id", "turn", "role")


@query("""WITH n AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 > 0 THEN s_name ELSE '  ' END AS a, CASE WHEN s_suppkey % 3 > 0 THEN 'r' || s_suppkey END AS c FROM supplier)
    SELECT id, coalesce(nullif(trim(a), ''), c) AS ramuan, coalesce(nullif(trim(a), ''), c) IS NOT NULL AS given, CASE WHEN coalesce(nullif(trim(a), ''), c) IS NOT NULL THEN 'dose' END AS dose FROM n""")
def recommendation_fields(spark, sf):
    """Field by field the assessment's, the case's or the default text; nothing without a name."""
    s = table(spark, sf, "supplier")
    a = F.struct(F.when(F.col("s_suppkey") % 4 > 0, F.col("s_name")).otherwise("  ").alias("recommended_herbal_name"), *[F.lit("").alias(c) for c in ("preparation", "dosage", "warning_notes", "source_hint")])
    c = F.struct(F.lit("k").alias("keluhan_ringan"), F.when(F.col("s_suppkey") % 3 > 0, F.concat(F.lit("r"), F.col("s_suppkey").cast("string"))).alias("ramuan"), *[F.lit(None).cast("string").alias(x) for x in ("cara_pengolahan", "dosis_penggunaan", "catatan_kewaspadaan", "sumber_ringkas")])
    r = s.select(F.col("s_suppkey").alias("id"), a.alias("a"), c.alias("c")).withColumn("r", dialogue.recommendation("a", "c", {"dosis_penggunaan": "dose"}))
    return r.select("id", "r.ramuan", F.col("r").isNotNull().alias("given"), F.col("r.dosis_penggunaan").alias("dose"))


@query("""SELECT conv_id AS session_id, turn AS created_at, text AS user_message, role AS response_type, 'a; b' AS suspected_conditions, role AS red_flags, 'q?' AS follow_up_question, text AS assistant_reply, turn AS questions_asked, 3 AS max_questions FROM conversations""")
def turn_export(spark, sf):
    c = table(spark, sf, "conversations")
    logs = c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("created_at"), F.col("text").alias("user_message"), F.col("role").alias("response_type"), F.array(F.lit("a"), F.lit("b"), F.lit("a")).alias("suspected_conditions"), F.array("role", "role").alias("red_flags"), F.lit("q?").alias("follow_up_question"), F.col("text").alias("assistant_reply"), F.col("turn").alias("questions_asked"), F.lit(3).alias("max_questions"))
    return dialogue.turn_export(logs)


# Structured output


@query("""WITH e AS (SELECT event_id, event_type, event_id % 500 AS pn, event_id % 7 * 100000000 AS pd, event_id % 90 AS en, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 11 * 1000000000 END AS ed FROM events)
    SELECT event_id, event_type AS model, pn AS prompt_count, round(CASE WHEN pd > 0 THEN pn / (pd / 1000000000) END, 2) AS prompt_rate, round(CASE WHEN ed > 0 THEN en / (ed / 1000000000) END, 2) AS eval_rate, pn + en AS total_tokens, en AS cached, CASE WHEN event_id % 2 = 0 THEN 'stop' END AS finish FROM e""")
def inference_metrics(spark, sf):
    """Durations, counts, rates and token usage out of providers' answers."""
    e = table(spark, sf, "events")
    pn, en = F.col("event_id") % 500, F.col("event_id") % 90
    local = F.to_json(F.struct(F.col("event_type").alias("model"), pn.alias("prompt_eval_count"), (F.col("event_id") % 7 * 100_000_000).alias("prompt_eval_duration"), en.alias("eval_count"), F.when(F.col("event_id") % 5 > 0, F.col("event_id") % 11 * 1_000_000_000).alias("eval_duration")))
    usage = F.struct(pn.alias("prompt_tokens"), (pn + en).alias("total_tokens"), F.struct(en.alias("cached_tokens")).alias("prompt_tokens_details"))
    hosted = F.to_json(F.struct(usage.alias("usage"), F.array(F.struct(F.when(F.col("event_id") % 2 == 0, "stop").otherwise(" ").alias("finish_reason"))).alias("choices")))
    r = e.select("event_id", parsing.local_metrics(local).alias("l"), parsing.hosted_metrics(hosted).alias("h"))
    return r.select("event_id", F.col("l.response_model").alias("model"), F.col("l.prompt_eval_count").alias("prompt_count"), F.col("l.prompt_eval_rate_tps").alias("prompt_rate"), F.col("l.eval_rate_tps").alias("eval_rate"), "h.total_tokens", F.col("h.cached_prompt_tokens").alias("cached"), F.col("h.finish_reason").alias("finish"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text ELSE role || text END AS content FROM conversations")
def chat_content(spark, sf):
    """Content that is a JSON text, or a list of parts."""
    c = table(spark, sf, "conversations")
    parts = F.to_json(F.array(F.struct(F.col("role").alias("text")), F.struct(F.col("text").alias("text")), F.struct(F.lit("").alias("text"))))
    whole = F.to_json(F.struct(F.col("text").alias("x")))
    one = F.substring(whole, F.lit(6), F.length(whole) - 6)  # the JSON text alone
    return c.select("conv_id", "turn", parsing.content_text(F.when(F.col("turn") % 2 == 0, one).otherwise(parts)).alias("content"))


# Training splits

_CHAT = f"""p AS (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS reply FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    c AS (SELECT conv_id * 1000 + turn AS index, text AS u, reply AS a, CASE conv_id % 5 WHEN 0 THEN 'medlineplus_' || conv_id % 7 || '_x' WHEN 1 THEN 'sft_anam_' || conv_id % 6 WHEN 2 THEN 'rag_' || conv_id WHEN 3 THEN ' ' ELSE 'id' || turn END AS id, CASE WHEN conv_id % 9 = 8 THEN 'rec' || conv_id % 4 ELSE ' ' END AS record FROM p WHERE role = 'user' AND next_role = 'assistant'),
    g AS (SELECT *, CASE WHEN trim(record) <> '' THEN 'source_record:' || record WHEN regexp_extract(id, '^medlineplus_(\\d+)_', 1) <> '' THEN 'medlineplus_topic:' || regexp_extract(id, '^medlineplus_(\\d+)_', 1) WHEN regexp_extract(id, '^sft_anam_(\\d+)', 1) <> '' THEN 'anamnesis_case:' || regexp_extract(id, '^sft_anam_(\\d+)', 1)
        WHEN starts_with(id, 'rag_') THEN 'rag_user:' || {stable_hash('u')} ELSE 'row_id:' || CASE WHEN trim(id) <> '' THEN id ELSE CAST(index AS VARCHAR) END END AS grp FROM c)"""


def _chat_rows(spark, sf) -> DataFrame:
    c = table(spark, sf, "conversations")
    w = W.partitionBy("conv_id").orderBy("turn")
    p = c.withColumns({"next_role": F.lead("role").over(w), "reply": F.lead("text").over(w)}).where("role = 'user' and next_role = 'assistant'")
    conv, name = F.col("conv_id"), lambda a, x: F.concat(F.lit(a), x.cast("string"))
    rid = F.when(conv % 5 == 0, F.concat(name("medlineplus_", conv % 7), F.lit("_x"))).when(conv % 5 == 1, name("sft_anam_", conv % 6)).when(conv % 5 == 2, name("rag_", conv)).when(conv % 5 == 3, " ").otherwise(name("id", F.col("turn")))
    message = lambda r, t: F.struct(F.lit(r).alias("role"), F.col(t).alias("content"))
    return p.select((conv * 1000 + F.col("turn")).alias("index"), rid.alias("id"), F.when(conv % 9 == 8, name("rec", conv % 4)).otherwise(" ").alias("source_record_id"), F.array(message("user", "text"), message("assistant", "reply")).alias("messages"))


@query(f"""WITH RECURSIVE {_CHAT}, k AS (SELECT index, grp AS key FROM g UNION SELECT index, 'assistant:' || {stable_hash('a')} FROM g WHERE a <> '' UNION SELECT index, 'user:' || {stable_hash('u')} FROM g WHERE u <> ''),
    e AS MATERIALIZED (SELECT DISTINCT x.index AS a, y.index AS b FROM k x JOIN k y USING (key)), r AS (SELECT index, index AS id FROM g UNION SELECT r.index, e.b FROM r JOIN e ON r.id = e.a)
    SELECT g.index, any_value(grp) AS group_key, min(r.id) AS component FROM g JOIN r USING (index) GROUP BY g.index""")
def leakage_keys(spark, sf):
    """Groups of chat rows and the components that their leakage keys tie."""
    rows = _chat_rows(spark, sf)
    keys = rows.select(F.col("index").alias("row_id"), F.explode(split.leakage_keys("id", "source_record_id", "messages", "index")).alias("key"))
    found = split.key_components(keys)
    return rows.select("index", split.group_key("id", "source_record_id", "messages", "index").alias("group_key")).join(found, F.col("index") == found["row_id"]).select("index", "group_key", "component")


@query(f"""WITH {_CHAT} SELECT index, u AS user_text, a AS assistant_text, CASE WHEN trim(u) <> '' THEN 1 ELSE 0 END + CASE WHEN trim(a) <> '' THEN 1 ELSE 0 END AS n_messages, true AS valid FROM g""")
def chat_messages(spark, sf):
    """First messages by role, messages that have content, and the validity of a chat row."""
    rows = _chat_rows(spark, sf)
    return rows.select("index", split.first_content("messages", "user").alias("user_text"), split.first_content("messages", "assistant").alias("assistant_text"), F.size(split.normalized_messages("messages")).alias("n_messages"), signals.valid_chat("messages").alias("valid"))


# Curation

_RULES, _GROUPS = {"the|der": "function", "est": "ending", "[0-9]": "digits"}, {"src0": ["zero"], "src1": ["one", "function"]}
_REFS = {"license": ("License", "https://l"), "rights": ("Rights", "https://r")}


@query(f"""WITH d AS (SELECT doc_id, source, lang, text, list_filter([{', '.join(f"CASE WHEN regexp_matches(text, {q('(?i)' + p)}) THEN {q(l)} END" for p, l in _RULES.items())}], lambda x: x IS NOT NULL) AS f FROM documents),
    g AS (SELECT *, list_concat(f, CASE source WHEN 'src0' THEN ['zero'] WHEN 'src1' THEN ['one', 'function'] ELSE [] END) AS a FROM d)
    SELECT doc_id, array_to_string(list_filter(a, lambda x, i: list_position(a, x) = i)[1:3], '|') AS facts, concat_ws('|', CASE WHEN contains(lower(text), 'license') THEN 'License=https://l' END, CASE WHEN contains(lower(text), 'rights') THEN 'Rights=https://r' END) AS refs,
        CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' ELSE lang END AS label, CASE lower(trim(coalesce(source, ''))) WHEN 'src0' THEN 'nol' ELSE CASE lang WHEN 'en' THEN 'inggris' ELSE 'lain' END END AS localized, ['x', 'y', 'z'][CAST(doc_id % 3 AS INTEGER) + 1] AS picked FROM g""")
def curation_rules(spark, sf):
    """Facts by pattern and group, references by keyword, labels, localized names, picks."""
    d = table(spark, sf, "documents")
    refs = F.transform(curate.supplemental_references("text", _REFS), lambda r: F.concat(r["title"], F.lit("="), r["url"]))
    return d.select(
        "doc_id",
        _joined(curate.topic_facts("text", _RULES, "source", _GROUPS, 3)).alias("facts"),
        _joined(refs).alias("refs"),
        curate.label_of("lang", {"en": "English", "fr": "French"}).alias("label"),
        curate.localized(["source", "lang"], {"src0": "nol", "en": "inggris"}, F.lit("lain")).alias("localized"),
        curate.pick(F.array(F.lit("x"), F.lit("y"), F.lit("z")), "doc_id").alias("picked"),
    )


@query("""WITH n AS (SELECT * FROM (VALUES (1, 'license'), (2, 'rights'), (3, 'the ')) v(o, name)) SELECT doc_id AS id, name FROM documents, n WHERE contains(lower(text), name) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY o) = 1""")
def first_names(spark, sf):
    """The first name of a small table that a text has."""
    names = spark.createDataFrame([(1, "license"), (2, "rights"), (3, "the ")], "o int, name string")
    return curate.first_name_in(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), names, "text", "name", "o").select("id", "name")


def _match_sql(a: str, b: str) -> str:
    x, y = (f"list_distinct(list_filter(string_split({norm(v)}, ' '), lambda t: length(t) > 2))" for v in (a, b))
    return f"(len(list_intersect({x}, {y})) >= greatest(1, least(len({x}), len({y})) // 2))"


def _better_sql(best: str, name: str, preparation: str) -> str:
    return f"CASE WHEN {_match_sql('p_name', name)} AND length(trim({preparation})) > length({best}) + 35 THEN trim({preparation}) ELSE {best} END"


@query(f"""WITH a AS (SELECT p_partkey, p_name, p_brand, p_type, {_better_sql("coalesce(p_type, '')", "p_name || ' tea'", "repeat(' ' || p_type || ' step', CAST(p_partkey % 9 AS INTEGER))")} AS best FROM part),
    b AS (SELECT *, {_better_sql('best', 'p_brand', "repeat('never ', 60)")} AS second FROM a)
    SELECT p_partkey AS id, {_better_sql('second', "'the ' || split_part(p_name, ' ', 2)", "repeat(p_brand || ' ', CAST(p_partkey % 13 AS INTEGER))")} AS best FROM b""")
def better_preparations(spark, sf):
    """The longest preparation among three contexts of which some have a matching name and some are longer by enough."""
    times = lambda c, m: F.expr(f"repeat({c}, cast(p_partkey % {m} as int))")
    given = [(F.concat("p_name", F.lit(" tea")), times("concat(' ', p_type, ' step')", 9)), (F.col("p_brand"), F.expr("repeat('never ', 60)")), (F.concat(F.lit("the "), F.element_at(F.split("p_name", " "), 2)), times("concat(p_brand, ' ')", 13))]
    context = F.array(*[F.struct(n.alias("name"), p.alias("preparation")) for n, p in given])
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), curate.better_preparation("p_type", "p_name", context).alias("best"))


@query("SELECT n_nationkey AS id FROM nation WHERE n_regionkey % 2 = 0 OR n_nationkey % 5 = 0")
def applicable_rows(spark, sf):
    """Rows with a wanted case in their list."""
    rows = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.array(F.concat(F.lit("c"), F.col("n_regionkey").cast("string")), F.when(F.col("n_nationkey") % 5 == 0, "c0").otherwise("x")).alias("applicable_case_ids"))
    cases = table(spark, sf, "region").where("r_regionkey % 2 = 0").select(F.concat(F.lit("c"), F.col("r_regionkey").cast("string")).alias("case_id"))
    return curate.applicable(rows, cases).select("id")


@query("SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id)")
def records_with_source(spark, sf):
    return catalogs.with_source(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels"), "doc_id", ["quality", "toxic"])


_PARTS = {"rhizome": "rimpang", "root": "akar", "leaf": "daun", "leaves": "daun", "flower": "bunga", "fruit": "buah", "seed": "biji", "bark": "kulit batang"}


@query(f"""WITH d AS (SELECT doc_id, source, lang, lower(coalesce(text, '') || CASE doc_id % 11 {' '.join(f"WHEN {i} THEN ' The {w.title()}s'" for i, w in enumerate(_PARTS))} ELSE '' END) AS low FROM documents)
    SELECT doc_id, concat_ws(';', 'a=' || source, 'b=' || concat_ws('; ', lang, 'x')) AS metadata, CASE {' '.join(f"WHEN contains(low, '{w}') THEN '{p}'" for w, p in _PARTS.items())} ELSE 'tidak disebutkan' END AS part,
        CASE WHEN lang IS NOT NULL THEN upper(lang[1:1]) || 'aba rosea' END AS latin FROM d""")
def source_metadata(spark, sf):
    """Metadata as a map of texts, plant parts of whole texts that name each of them, and Latin names."""
    words = F.element_at(F.create_map(*[x for i, w in enumerate(_PARTS) for x in (F.lit(i), F.lit(f" The {w.title()}s"))]), (F.col("doc_id") % 11).cast("int"))
    d = table(spark, sf, "documents").withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.coalesce(words, F.lit(""))))
    m = catalogs.flat_metadata(F.struct(F.col("source").alias("a"), F.array("lang", F.lit("x")).alias("b"), F.lit(None).cast("string").alias("c")), ["a", "b", "c"], ["b"])
    latin = catalogs.scientific_name(F.concat(F.lit("Latin name: "), F.upper(F.substring("lang", 1, 1)), F.lit("aba rosea of")))
    return d.select("doc_id", F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("metadata"), catalogs.part_used("text").alias("part"), latin.alias("latin"))


# Replies


@query(f"""WITH {_MARKS}, f AS (SELECT sn.conv_id, sn.turn, text, n, red_flags, present, absent, {_duration()} AS duration, {_duration()} IS NOT NULL OR {any_of('n', DEFAULT.duration_words)} AS has_duration, {any_of('n', DEFAULT.intensity)} OR {any_of('n', DEFAULT.progression)} AS detail FROM sn LEFT JOIN rf USING (conv_id, turn) LEFT JOIN ss USING (conv_id, turn))
    SELECT conv_id, turn, {_sql_template(wording.RED_FLAG, flags="replace(red_flags, '|', ', ')")} AS red_flag, CASE conv_id % 3 WHEN 0 THEN {_sql_template(wording.FEEDBACK['helpful'], name=q(wording.FEEDBACK_NAME))} WHEN 1 THEN {_sql_template(wording.FEEDBACK['not_helpful'], name=q(wording.FEEDBACK_NAME))} ELSE {_sql_template(wording.FEEDBACK[''])} END AS feedback,
        CASE {' '.join(f'WHEN {any_of("n", terms)} THEN {q(t)}' for terms, t in wording.EXPLAINED[:-1])} ELSE {q(wording.EXPLAINED[-1][1])} END AS explained,
        {_sql_template(wording.SUMMARY, complaint="'-'", present="coalesce(replace(present, '|', ', '), '-')", absent="coalesce(replace(absent, '|', ', '), '-')", duration=f"coalesce(duration, CASE WHEN has_duration THEN {q(wording.SUMMARY_DURATION[0])} ELSE {q(wording.SUMMARY_DURATION[1])} END)", detail=f"CASE WHEN detail THEN {q(wording.SUMMARY_DETAIL[0])} ELSE {q(wording.SUMMARY_DETAIL[1])} END", safety=q(wording.SUMMARY_SAFETY[1]))} AS summary FROM f""")
def reply_texts(spark, sf):
    """Replies to danger signs and feedback, plain words for questions, and summaries."""
    a = signals.analyze(seeded(spark, sf))
    s = F.struct(F.lit(None).cast("string").alias("keluhan_ringan"), "present_symptoms", F.array().cast("array<string>").alias("detected_symptoms"), "absent_symptoms", "duration_text", "has_duration_signal", "has_intensity_signal", "has_progression_signal", F.lit(False).alias("has_safety_clearance_signal"))
    a = a.withColumn("s", s)
    label = F.when(F.col("conv_id") % 3 == 0, "helpful").when(F.col("conv_id") % 3 == 1, "not_helpful")
    none = F.lit(None).cast("struct<ramuan:string>")
    return a.select("conv_id", "turn", replies.red_flag_reply("red_flags").alias("red_flag"), replies.feedback_reply(label, none).alias("feedback"), replies.explained("text").alias("explained"), replies.summary_text("s").alias("summary"))


def _mentioned(question: str) -> list[str]:
    n = signals.normalize_literal(question)
    return [s for s in sorted(DEFAULT.symptoms) if any(p in n for p in (signals.normalize_literal(s), *DEFAULT.symptoms[s]))]


def _has_one(question: str, terms) -> bool:
    return any(t in signals.normalize_literal(question) for t in terms)


def _repeats(question: str) -> str:
    """When a literal question repeats what is answered, as SQL over `said`, has_duration and detail."""
    said = _array(_mentioned(question))
    new, again = f"len(list_filter({said}, lambda x: NOT list_contains(said, x))) > 0", f"len(list_intersect({said}, said)) > 0"
    parts = ["has_duration"] if _has_one(question, signals.DURATION_QUESTION) else []
    parts += ["has_intensity"] if _has_one(question, signals.INTENSITY_QUESTION) else []
    parts += [f"NOT ({new})"] if _has_one(question, signals.GENERIC_QUESTION) else []
    if _has_one(question, signals.EXISTENCE) and not _has_one(question, signals.DETAIL_QUESTION):
        parts.append(f"({again} AND NOT ({new}))")
    return "(" + " OR ".join(parts or ["false"]) + ")"


def _called(question: dict) -> str:
    """When a question is a candidate, as SQL."""
    parts = [f"list_contains(present, {q(s)})" for s in question.get("all", ())]
    if question.get("any"):
        parts.append(f"len(list_intersect(present, {_array(question['any'])})) > 0")
    if question.get("not_denied"):
        parts.append(f"NOT list_contains(absent, {q(question['not_denied'])})")
    parts += [f"NOT {({'duration': 'has_duration', 'safety': 'cleared', 'detail': '(has_intensity OR has_progression)'})[s]}" for s in question.get("unanswered", ())]
    if question.get("immediate"):
        parts.append(f"len(list_intersect(present, {_array(signals.IMMEDIATE)})) > 0")
    return "(" + " AND ".join(parts or ["true"]) + ")"


_CLEARED_SQL = "regexp_matches(n, " + q("(?:" + "|".join(DEFAULT.clearances) + ") (?:" + "|".join(DEFAULT.red_flags) + ")") + ")"
_LAST = _marked(_RUNNING.replace("FROM rt WHERE role = 'user')", "FROM rt WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1)"))
_ANALYSED = f"""an AS (SELECT sn.conv_id, CASE WHEN present IS NULL THEN []::VARCHAR[] ELSE string_split(present, '|') END AS present, CASE WHEN absent IS NULL THEN []::VARCHAR[] ELSE string_split(absent, '|') END AS absent, {_duration()} IS NOT NULL OR {any_of('n', DEFAULT.duration_words)} AS has_duration,
    {any_of('n', DEFAULT.intensity)} AS has_intensity, {any_of('n', DEFAULT.progression)} AS has_progression, {_CLEARED_SQL} AS cleared FROM sn LEFT JOIN ss USING (conv_id, turn)), ad AS (SELECT *, list_concat(present, absent) AS said FROM an)"""

SQL["follow_up_choice"] = f"""WITH {_LAST}, {_ANALYSED}
    SELECT conv_id, CAST(1 + {' + '.join(f'CAST({_called(x)} AS INTEGER)' for x in replies.QUESTIONS)} AS INTEGER) AS n_candidates,
        CASE {' '.join(f'WHEN {_called(x)} AND NOT {_repeats(x["ask"])} THEN {q(x["ask"])}' for x in replies.QUESTIONS)} ELSE {q(replies.LAST_QUESTION)} END AS question FROM ad"""


# Scores


def _scored(spark, sf, kind: str, card: dict) -> DataFrame:
    """All score parts of assistant turns taken as assessments of a kind."""
    c = seeded(spark, sf)
    c = c.withColumn("before", F.coalesce(F.lag("text").over(W.partitionBy("conv_id").orderBy("turn")), F.lit(""))).where("role = 'assistant'")
    c = signals.analyze(c.withColumns({"reply": F.col("text"), "text": F.col("before")}))
    fields = {"scope": F.lit("supported"), "scope_reason": F.lit(""), "suspected_conditions": F.col("present_symptoms"), "reasoning": F.col("reply"), "enough_information": F.lit(False), "follow_up_question": F.concat("reply", F.lit("?")), "follow_up_rationale": F.lit("x"), "red_flags": F.col("red_flags"), "need_medical_referral": F.size("red_flags") > 0, "final_answer": F.col("reply")}
    fields |= {"recommended_herbal_name": F.lit(card["name"]), "ingredients": F.array(*[F.lit(x) for x in card["items"]]).cast("array<string>"), "preparation": F.lit(card["preparation"]), "dosage": F.lit(card["dosage"]), "warning_notes": F.lit(card["warning"]), "source_hint": F.lit("")}
    a = F.struct(*[v.alias(k) for k, v in fields.items()])
    summary = F.struct("present_symptoms", "absent_symptoms", "detected_symptoms", F.col("has_duration_signal").alias("has_duration"), F.array().cast("array<string>").alias("asked_questions"))
    c = c.withColumns({"a": a, "s": summary, "titles": F.array("before", F.lit("teh jahe hangat"))})
    parts = scoring.assessment_scores("a", F.lit(kind), "titles", "s", "before", F.lit(0), F.lit(3), F.lit(kind != "follow_up"))
    return c.select("conv_id", "turn", *[v.alias(k) for k, v in parts.items()])


def _scored_sql(kind: str, card: dict) -> str:
    ask = kind == "follow_up"
    has = lambda x: 1 if x else 0
    named, items = bool(card["name"]), card["items"]
    rendered = "question" if ask else "reply"
    mentioned = "list_filter([" + ", ".join(f"CASE WHEN {any_of('nq', (signals.normalize_literal(x), *DEFAULT.symptoms[x]))} THEN {q(x)} END" for x in sorted(DEFAULT.symptoms)) + "], lambda x: x IS NOT NULL)"
    share = lambda a, b, cap, least: f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN least({cap}::DOUBLE, len(list_intersect({a}, {b})) / greatest({least}, len({a}))) ELSE 0 END"
    terms = lambda x: f"list_distinct(flatten(list_transform({x}, lambda s: {tokens('s')})))"
    new, again = "len(list_filter(mentioned, lambda x: NOT list_contains(said, x))) > 0", "len(list_intersect(mentioned, said)) > 0"
    base = "CASE WHEN len(present) > 0 THEN 0.22::DOUBLE ELSE 0 END + CASE WHEN reply <> '' THEN 0.16::DOUBLE ELSE 0 END"
    complete = f"{base} + 0.62::DOUBLE" if ask else f"{base} + CASE WHEN reply <> '' THEN 0.22::DOUBLE ELSE 0 END + CASE WHEN {str(bool(card['warning'])).lower()} OR refer THEN 0.12::DOUBLE ELSE 0 END + {0.08 * has(named) + 0.08 * has(card['preparation']) + 0.07 * has(card['dosage'])}::DOUBLE"
    quality = "CASE WHEN sq = '' THEN 0 ELSE least(1.0::DOUBLE, 0.35::DOUBLE + CASE WHEN sq LIKE '%?' THEN 0.18 ELSE 0 END + CASE WHEN length(sq) BETWEEN 15 AND 180 THEN 0.18 ELSE 0 END + CASE WHEN length(sq) - length(replace(sq, '?', '')) <= 1 THEN 0.12 ELSE 0 END + 0.1::DOUBLE) END" if ask else "0.5::DOUBLE"
    fit = "CASE WHEN refer THEN 0.45::DOUBLE ELSE 0.25 END"
    if named or items:
        context = norm("before || ' teh jahe hangat'")
        found = " + ".join(f"CAST(contains({context}, {q(signals.normalize_literal(x))}) AS INTEGER)" for x in items) or "0"
        fit = f"least(1.0::DOUBLE, 0.3::DOUBLE + CASE WHEN {str(named).lower()} AND contains({context}, {q(signals.normalize_literal(card['name']))}) THEN 0.3 ELSE 0 END + " + (f"least(0.3::DOUBLE, ({found}) / {len(items)} * 0.3::DOUBLE)" if items else "0") + f" + {0.1 if card['preparation'] and card['dosage'] else 0}::DOUBLE)"
    weights = scoring.FOLLOW_UP_WEIGHTS if ask else scoring.FINAL_WEIGHTS
    seeded_ = _SEEDED.split(", sn AS")[0]
    return f"""WITH {_marked(f"{seeded_}, bf AS (SELECT conv_id, turn, role, text AS reply, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS before FROM seeded), sn AS (SELECT *, {norm('before')} AS n FROM bf WHERE role = 'assistant')")},
        f AS (SELECT sn.conv_id, sn.turn, reply, before, reply || '?' AS question, CASE WHEN present IS NULL THEN []::VARCHAR[] ELSE string_split(present, '|') END AS present, CASE WHEN absent IS NULL THEN []::VARCHAR[] ELSE string_split(absent, '|') END AS absent, CASE WHEN detected IS NULL THEN []::VARCHAR[] ELSE string_split(detected, '|') END AS detected,
            red_flags IS NOT NULL AS refer, {_duration()} IS NOT NULL OR {any_of('n', DEFAULT.duration_words)} AS has_duration FROM sn LEFT JOIN rf USING (conv_id, turn) LEFT JOIN ss USING (conv_id, turn) LEFT JOIN hd USING (conv_id, turn)),
        g AS (SELECT *, list_distinct(list_concat(present, absent)) AS said, {norm('question')} AS nq, {norm(rendered)} AS nr, regexp_replace(question, '^\\s+|\\s+$', '', 'g') AS sq, length(regexp_replace({rendered}, '^\\s+|\\s+$', '', 'g')) AS size, {norm("concat_ws(' ', reply, reply, '')")} AS answer,
            {terms(f"list_concat([before, 'teh jahe hangat'], present, {_array([card['name'], *items])})")} AS expected, list_distinct({tokens('before')}) AS qt, {terms('detected')} AS st, {terms('present')} AS ct, {terms("[before, 'teh jahe hangat']")} AS xt, list_distinct({tokens('question')}) AS rt FROM f),
        m AS (SELECT *, {mentioned} AS mentioned FROM g),
        p AS (SELECT conv_id, turn,
            least(1.0::DOUBLE, 0.25::DOUBLE + CASE WHEN refer THEN 0.32 ELSE 0 END + CASE WHEN {any_of('nr', ('tenaga kesehatan', 'fasilitas kesehatan'))} THEN 0.14 ELSE 0 END + CASE WHEN {any_of('nr', ('bukan diagnosis', 'bukan pengganti'))} THEN 0.11 ELSE 0 END) AS safety,
            CASE WHEN len(expected) = 0 THEN 0.5::DOUBLE ELSE least(1.0::DOUBLE, len(list_filter(expected, lambda t: contains(answer, t))) / greatest(5.0::DOUBLE, len(expected) * 0.6::DOUBLE)) END AS grounding,
            least(1.0::DOUBLE, {complete}) AS completeness,
            least(1.0::DOUBLE, 0.2::DOUBLE + {share('qt', 'rt', 0.25, 3)} + {share('st', 'rt', 0.2, 2)} + {share('ct', 'xt', 0.2, 2)} + 0.1::DOUBLE) AS relevance,
            CASE WHEN size BETWEEN 20 AND 1800 THEN 1.0::DOUBLE WHEN size BETWEEN 10 AND 19 OR size BETWEEN 1801 AND 2600 THEN 0.75 ELSE 0.45 END AS language,
            {quality} AS question_quality,
            CASE WHEN nq = '' THEN 0::DOUBLE WHEN has_duration AND {any_of('nq', signals.DURATION_QUESTION)} THEN 0.15 WHEN {any_of('nq', signals.GENERIC_QUESTION)} AND NOT {new} THEN 0.15 WHEN {any_of('nq', signals.EXISTENCE)} AND {again} AND NOT {new} AND NOT {any_of('nq', signals.DETAIL_QUESTION[:-1])} THEN 0.15 ELSE 1.0 END AS non_repetition,
            {fit} AS herbal_fit FROM m)
        SELECT conv_id, turn, {', '.join(f'round({k}, 4) AS {k}' for k in ('safety', 'grounding', 'completeness', 'relevance', 'language', 'question_quality', 'non_repetition', 'herbal_fit'))}, round(greatest(0, least(1, {' + '.join(f'{w}::DOUBLE * {k}' for k, w in weights.items())})), 4) AS total FROM p"""


_NO_CARD = {"name": "", "items": [], "preparation": "", "dosage": "", "warning": ""}
_CARD = {"name": "teh jahe", "items": ["jahe", "madu murni"], "preparation": "seduh", "dosage": "2x", "warning": "alergi"}


@query(_scored_sql("follow_up", _NO_CARD))
def assessment_scores(spark, sf):
    """All score parts of follow-up assessments."""
    return _scored(spark, sf, "follow_up", _NO_CARD)


@query(_scored_sql("recommendation", _CARD))
def recommendation_scores(spark, sf):
    """All score parts of final assessments with a recommendation."""
    return _scored(spark, sf, "recommendation", _CARD)


# Retrieval for a conversation


def _bundle_tables(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks made of documents, cases and queries made of benchmark items."""
    b = table(spark, sf, "benchmark").where("text <> ''").withColumn("w", F.split("text", " "))
    word = lambda i: F.coalesce(F.get("w", i - 1), F.lit(""))
    name = F.concat(F.lit("case_"), F.col("item_id").cast("string"))
    complaint = F.concat_ws(" ", F.when(F.col("item_id") % 4 == 0, "ringan").otherwise("x"), word(1), word(2), word(3))
    cases = b.where("item_id % 2 = 0").select(name.alias("case_id"), complaint.alias("keluhan_ringan"), F.concat_ws(" ", word(4), word(5)).alias("ramuan_rekomendasi"), F.array(word(6), word(7)).alias("items"))
    cases = cases.withColumn("text", F.concat_ws(" ", "keluhan_ringan", "ramuan_rekomendasi", F.array_join("items", " ")))
    asked = F.concat_ws(" ", "text", F.when(F.col("item_id") % 4 == 1, "ringan"))
    queries = b.where("item_id % 2 = 1").select(F.col("item_id").alias("query"), asked.alias("text"), F.array(F.concat(F.lit("case_"), (F.col("item_id") - F.col("item_id") % 4).cast("string")), F.lit("none")).alias("hinted_case_ids"), F.slice(text.tokenize("text"), 1, 3).alias("detected_symptoms"))
    d = table(spark, sf, "documents").withColumn("w", F.split("text", "[ \\n]", 3))  # the first two words; the rest stays in one piece
    kind = F.element_at(F.array(*[F.lit(k) for k in ("case", "formula", "herb", "training", "anamnesis")]), (F.col("doc_id") % 5 + 1).cast("int"))
    level = F.when(F.col("doc_id") % 3 == 0, "high").when(F.col("doc_id") % 7 == 0, "clinical_guideline_reference")
    case = F.concat(F.lit("case_"), (F.col("doc_id") % 40).cast("string"))
    meta = F.struct(F.when(F.col("doc_id") % 2 == 0, "disease_guidance").alias("content_type"), F.when(F.col("doc_id") % 4 == 0, "penyakit_tropis").alias("condition_group"), F.array(case).alias("applicable_case_ids"))
    chunks = d.select(F.concat(F.lit("d"), F.format_string("%09d", "doc_id")).alias("id"), kind.alias("type"), F.concat_ws(" ", F.get("w", 0), F.get("w", 1)).alias("title"), "text", level.alias("evidence_level"), F.when(kind == "case", case).alias("case_id"), meta.alias("metadata"), F.col("doc_id").alias("ord"))
    return chunks, cases, queries


def _search_sql(name: str, queries: str, k: int) -> str:
    """CTEs of a search of (query, text) rows over the chunks' index; the last has query, id, score, matched_terms, rank."""
    return f"""{name}k AS (SELECT query, unnest({tokens('text')}) AS token FROM {queries}), {name}c AS (SELECT query, token, count(*) AS n FROM {name}k GROUP BY ALL), {name}t AS (SELECT query, max(n) AS top FROM {name}c GROUP BY query),
    {name}w AS (SELECT query, token, (0.5::DOUBLE + 0.5::DOUBLE * (n / top)) * coalesce(idf, 1.0::DOUBLE) AS qw FROM {name}c JOIN {name}t USING (query) LEFT JOIN idfs USING (token)), {name}n AS (SELECT query, sqrt(sum(qw * qw)) AS qnorm FROM {name}w GROUP BY query),
    {name}d AS (SELECT query, id, sum(qw * w) AS dot, string_agg(token, ' ' ORDER BY token) AS matched_terms FROM {name}w JOIN post USING (token) GROUP BY ALL),
    {name}s AS (SELECT query, id, round(dot / (qnorm * norm), 4) AS score, matched_terms FROM {name}d JOIN {name}n USING (query) JOIN norms USING (id) WHERE dot > 0),
    {name} AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM {name}s QUALIFY rank <= {k})"""


def _hint_sql(x: str) -> str:
    return f"array_to_string({tokens(x)}, ' ')"


_BUNDLE = f"""b AS (SELECT item_id, text, string_split(text, ' ') AS w FROM benchmark WHERE text <> ''),
cs0 AS (SELECT 'case_' || item_id AS case_id, concat_ws(' ', CASE WHEN item_id % 4 = 0 THEN 'ringan' ELSE 'x' END, coalesce(w[1], ''), coalesce(w[2], ''), coalesce(w[3], '')) AS keluhan_ringan, coalesce(w[4], '') || ' ' || coalesce(w[5], '') AS ramuan, [coalesce(w[6], ''), coalesce(w[7], '')] AS items FROM b WHERE item_id % 2 = 0),
cs AS (SELECT *, keluhan_ringan || ' ' || ramuan || ' ' || array_to_string(items, ' ') AS text FROM cs0),
qs AS (SELECT item_id AS query, concat_ws(' ', text, CASE WHEN item_id % 4 = 1 THEN 'ringan' END) AS text, ['case_' || (item_id - item_id % 4), 'none'] AS hinted, ({tokens('text')})[1:3] AS symptoms FROM b WHERE item_id % 2 = 1),
ch0 AS (SELECT *, regexp_split_to_array(text, '[ \\n]') AS w FROM documents),
ch AS (SELECT 'd' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS id, ['case', 'formula', 'herb', 'training', 'anamnesis'][CAST(doc_id % 5 AS INTEGER) + 1] AS type, concat_ws(' ', w[1], w[2]) AS title, text, CASE WHEN doc_id % 3 = 0 THEN 'high' WHEN doc_id % 7 = 0 THEN 'clinical_guideline_reference' END AS evidence_level,
    CASE WHEN doc_id % 5 = 0 THEN 'case_' || doc_id % 40 END AS case_id, CASE WHEN doc_id % 2 = 0 THEN 'disease_guidance' END AS content_type, CASE WHEN doc_id % 4 = 0 THEN 'penyakit_tropis' END AS condition_group, ['case_' || doc_id % 40] AS cases FROM ch0),
th AS (SELECT *, {_hint_sql('title')} AS title_hint FROM ch),
tk AS (SELECT id, unnest({tokens('text')}) AS token FROM ch), cnt AS (SELECT id, token, count(*) AS n FROM tk GROUP BY ALL), tops AS (SELECT id, max(n) AS top FROM cnt GROUP BY id),
idfs AS (SELECT token, ln((1 + (SELECT count(*) FROM ch)) / (1 + count(*))) + 1 AS idf FROM cnt GROUP BY token),
post AS MATERIALIZED (SELECT id, token, (0.5::DOUBLE + 0.5::DOUBLE * (n / top)) * idf AS w FROM cnt JOIN tops USING (id) JOIN idfs USING (token)), norms AS (SELECT id, sqrt(sum(w * w)) AS norm FROM post GROUP BY id),
{_search_sql('sa', 'qs', 30)},
found AS (SELECT query, case_id AS id, keluhan_ringan AS title, round(sa.score + CASE WHEN list_contains(hinted, case_id) THEN 0.8 ELSE 0 END + CASE WHEN contains(lower(qs.text), 'ringan') AND contains(keluhan_ringan, 'ringan') THEN 0.08 ELSE 0 END, 4) AS score, 'curated_case' AS evidence_level, matched_terms, rank AS ord
    FROM sa JOIN (SELECT id, case_id FROM ch WHERE type = 'case' AND case_id IS NOT NULL) c USING (id) JOIN cs USING (case_id) JOIN qs USING (query) WHERE rank <= 20),
named AS (SELECT query, unnest(hinted) AS id, unnest(range(len(hinted))) AS pos, text AS asked FROM qs),
hinted AS (SELECT n.query, n.id, keluhan_ringan AS title, 0.85::DOUBLE AS score, 'curated_case_hint' AS evidence_level, array_to_string(list_sort(list_distinct(list_intersect({tokens('asked')}, {tokens('cs.text')}))), ' ') AS matched_terms, 1000 + pos AS ord FROM named n JOIN cs ON n.id = cs.case_id WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.query = n.query AND f.id = n.id)),
top AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, ord) AS rank FROM (SELECT * FROM found UNION ALL SELECT * FROM hinted) QUALIFY rank <= 3),
best AS (SELECT query, id AS case_id FROM top WHERE rank = 1),
qc AS (SELECT query, concat_ws(' ', qs.text, keluhan_ringan, ramuan, array_to_string(items, ' ')) AS text, case_id, symptoms, {_hint_sql('ramuan')} AS fh, list_transform(items, lambda s: {_hint_sql('s')}) AS ih FROM qs JOIN best USING (query) JOIN cs USING (case_id)),
{_search_sql('sb', 'qc', 30)},
cx AS (SELECT query, id, type, title, evidence_level, matched_terms, rank, CASE WHEN type = 'training' THEN 'training:' || title_hint ELSE id END AS dd, contains(fh, title_hint) OR contains(title_hint, fh) AS same,
    len(list_filter(ih, lambda x: contains(title_hint, x))) > 0 AS part, list_contains(ih, title_hint) AS whole, len(list_intersect(string_split(matched_terms, ' '), symptoms)) > 0 AS sym, cases, case_id, score FROM (SELECT sb.query, sb.score, sb.rank, sb.matched_terms, th.* EXCLUDE (case_id, text) FROM sb JOIN th USING (id)) JOIN qc USING (query) WHERE type <> 'case'),
cy AS (SELECT *, round(score + CASE WHEN type = 'formula' AND same THEN 0.9 ELSE 0 END + CASE WHEN whole THEN 0.5 ELSE 0 END + CASE WHEN part THEN 0.25 ELSE 0 END + CASE WHEN type = 'training' AND same THEN 0.45 ELSE 0 END + CASE WHEN type = 'anamnesis' AND list_contains(cases, case_id) THEN 0.55 ELSE 0 END
    + CASE WHEN evidence_level IN ('high', 'medium') THEN 0.08 ELSE 0 END + CASE WHEN sym THEN 0.08 ELSE 0 END, 4) AS s FROM cx),
context AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, rank, id) AS k FROM (SELECT * FROM cy QUALIFY row_number() OVER (PARTITION BY query, dd ORDER BY s DESC, rank) = 1) QUALIFY k <= 6),
gx AS (SELECT sa.query, id, type, title, evidence_level, matched_terms, rank, CASE WHEN type = 'training' THEN 'training:' || title_hint ELSE id END AS dd, round(score + CASE WHEN type = 'training' AND evidence_level IN ('clinical_guideline_reference', 'medical_review_reference') THEN 0.15 ELSE 0 END + CASE WHEN type = 'anamnesis' AND condition_group = 'penyakit_tropis' THEN 0.12 ELSE 0 END
    + CASE WHEN len(list_intersect(string_split(matched_terms, ' '), symptoms)) > 0 THEN 0.12 ELSE 0 END + CASE WHEN title_hint <> '' AND contains({_hint_sql('qs.text')}, title_hint) THEN 0.2 ELSE 0 END, 4) AS s FROM sa JOIN (SELECT * EXCLUDE (text) FROM th) t USING (id) JOIN qs ON sa.query = qs.query WHERE (type = 'training' AND content_type = 'disease_guidance') OR type = 'anamnesis'),
guidance AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, rank, id) AS k FROM (SELECT * FROM gx QUALIFY row_number() OVER (PARTITION BY query, dd ORDER BY s DESC, rank) = 1) QUALIFY k <= 5)"""

_ITEM = "query", "id", "type", "title", "score", "evidence_level", "matched_terms", "rank"


def _bundle_index(spark, sf):
    chunks, cases, queries = _bundle_tables(spark, sf)
    return TfidfIndex(chunks), chunks, cases, queries


@query(f"WITH {_BUNDLE} SELECT query, id, 'case' AS type, title, score, evidence_level, matched_terms, CAST(rank AS INTEGER) AS rank FROM top")
def retrieve_cases(spark, sf):
    """The best cases of each query, hinted ones appended."""
    return bundle.retrieve_cases(*_bundle_index(spark, sf)).select(*_ITEM)


@query(f"WITH {_BUNDLE} SELECT query, id, type, title, s AS score, evidence_level, matched_terms, CAST(k AS INTEGER) AS rank FROM context")
def retrieve_context(spark, sf):
    """Formulas, herbs, training and anamnesis chunks for each query and its best case."""
    index, chunks, cases, queries = _bundle_index(spark, sf)
    best = bundle.retrieve_cases(index, chunks, cases, queries).where("rank = 1").select("query", F.col("id").alias("case_id"))
    return bundle.retrieve_context(index, chunks, cases, queries.join(best, "query")).select(*_ITEM)


@query(f"WITH {_BUNDLE} SELECT query, id, type, title, s AS score, evidence_level, matched_terms, CAST(k AS INTEGER) AS rank FROM guidance")
def retrieve_guidance(spark, sf):
    """Disease guidance and anamnesis chunks of each query."""
    index, chunks, _, queries = _bundle_index(spark, sf)
    return bundle.retrieve_guidance(index, chunks, queries).select(*_ITEM)


@query(f"""WITH {_BUNDLE}, u AS (SELECT query, id, 'case' AS type, title, score, evidence_level, matched_terms, rank AS ord FROM top WHERE rank <= 2 UNION ALL SELECT query, id, type, title, s, evidence_level, matched_terms, 100 + k FROM context UNION ALL SELECT query, id, type, title, s, evidence_level, matched_terms, 200 + k FROM guidance WHERE k <= 4),
    v AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY query, id ORDER BY score DESC, ord) = 1)
    SELECT query, id, type, title, score, evidence_level, matched_terms, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, ord) AS INTEGER) AS rank FROM v""")
def retrieve_bundle(spark, sf):
    """Cases, context and guidance of each query in one ranking."""
    return bundle.retrieve_bundle(*_bundle_index(spark, sf))[0].select(*_ITEM)


# Generated training data

_TASKS = {"cegah": ("prevention", "Cara mencegah {name} untuk {audience}?"), "tanda": ("red_flag", "Apa tanda bahaya {name}?"), "lain": ("other", "Apa itu {name}?")}
_PEOPLE = {"umum": "pengguna umum", "ortu": "orang tua"}
_SYSTEM = {"prevention": "Anda membantu pencegahan.", "": "Anda membantu triase."}


def _records(spark, sf) -> DataFrame:
    """Records made of suppliers, with lists of different lengths."""
    n = F.col("s_suppkey")
    items = lambda name, k: F.slice(F.array(*[F.concat(F.lit(f"{name}{i} "), F.col("s_name")) for i in range(7)]), F.lit(1), (n % k).cast("int"))
    return table(spark, sf, "supplier").select(F.concat(F.lit("s"), n.cast("string")).alias("id"), F.when(n % 4 > 0, F.col("s_name")).otherwise("").alias("formula_name"), F.concat(F.lit("Topic "), n.cast("string")).alias("topic"), items("g", 7).alias("symptoms"), items("w", 6).alias("warning_signs"), items("p", 3).alias("prevention_steps"), items("q", 5).alias("screening_questions"), F.when(n % 2 == 0, "Periksa.").otherwise("").alias("care_recommendation"), F.lit("Aman.").alias("safety_notes"), F.when(n % 3 == 0, "Isi.").otherwise("").alias("overview"), F.when(n % 5 == 0, "Lab.").alias("diagnosis_summary"))


def _list_sql(name: str, k: int) -> str:
    return "[" + ", ".join(f"'{name}{i} ' || s_name" for i in range(7)) + f"][1:CAST(s_suppkey % {k} AS INTEGER)]"


_RECORDS = f"""rs AS (SELECT 's' || s_suppkey AS id, CASE WHEN s_suppkey % 4 > 0 THEN s_name ELSE 'Topic ' || s_suppkey END AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'Periksa.' ELSE 'Aman.' END AS care, CASE WHEN s_suppkey % 2 = 0 THEN 'Periksa.' ELSE '' END AS own_care, CASE WHEN s_suppkey % 3 = 0 THEN 'Isi.' ELSE '' END AS overview, CASE WHEN s_suppkey % 5 = 0 THEN 'Lab.' END AS diagnosis,
    {_list_sql('g', 7)} AS symptoms, {_list_sql('w', 6)} AS warnings, {_list_sql('p', 3)} AS prevention, {_list_sql('q', 5)} AS questions, s_suppkey AS n, s_name FROM supplier)"""


def _bullets_sql(items: str) -> str:
    return f"array_to_string(list_transform({items}, lambda x: '- ' || x), chr(10))"


def _numbers_sql(items: str) -> str:
    return f"array_to_string(list_transform({items}, lambda x, i: i || '. ' || x), chr(10))"


def _blocks_sql(texts: dict[str, str], wanted: dict[str, str], **parts: str) -> str:
    return f"concat_ws({q(chr(10) * 2)}, " + ", ".join(f"CASE WHEN {wanted[k]} THEN {_sql_template(t, **parts)} END" if k in wanted else _sql_template(t, **parts) for k, t in texts.items()) + ")"


def _by_kind_sql(kind: str, texts: dict[str, str], **parts: str) -> str:
    return f"CASE {kind} " + " ".join(f"WHEN {q(k)} THEN {_sql_template(t, **parts)}" for k, t in texts.items() if k) + f" ELSE {_sql_template(texts.get('', ''), **parts) or 'NULL'} END"


_TRIAGE = _blocks_sql(generated.TRIAGE_ANSWER, {"overview": "overview <> ''", "symptoms": "len(symptoms) > 0", "questions": "len(questions) > 0", "warnings": "len(warnings) > 0", "diagnosis": "diagnosis IS NOT NULL"}, focus=_by_kind_sql("focus", generated.FOCUS), audience="audience", disease="lower(name)", overview="overview", symptoms="array_to_string(symptoms[1:5], ', ')", questions=_bullets_sql("questions[1:4]"), warnings=_bullets_sql("warnings[1:4]"), diagnosis="diagnosis", care="care")
_PREVENT = _blocks_sql(generated.PREVENTION_ANSWER, {"warnings": "len(warnings) > 0"}, audience="audience", disease="name", steps=f"CASE WHEN len(prevention) > 0 THEN {_bullets_sql('prevention[1:5]')} ELSE {q(generated.NO_PREVENTION)} END", warnings=_bullets_sql("warnings[1:3]"), care="care")


@query(f"""WITH {_RECORDS}, p(audience_id, audience) AS (VALUES {', '.join(f'({q(k)}, {q(v)})' for k, v in _PEOPLE.items())}), t(task_id, focus) AS (VALUES {', '.join(f'({q(k)}, {q(f)})' for k, (f, _) in _TASKS.items())})
    SELECT concat_ws('_', 'sft', id, audience_id, task_id) AS id, id AS source_record_id, audience_id || '_' || task_id AS variant, focus, {_by_kind_sql('focus', _SYSTEM)} AS system, {_by_kind_sql('task_id', {k: x for k, (_, x) in _TASKS.items()}, name="CASE WHEN n % 4 > 0 THEN s_name ELSE '' END", audience='audience')} AS asked, CASE WHEN focus = 'prevention' THEN {_PREVENT} ELSE {_TRIAGE} END AS answer FROM rs, p, t""")
def disease_dataset(spark, sf):
    """Chat rows of each record, audience and task, answered by focus."""
    rows = datasets.variant_chats(_records(spark, sf), _PEOPLE, _TASKS, _SYSTEM, datasets.disease_answer)
    return rows.select("id", "source_record_id", "variant", "focus", *[F.get("messages", i)["content"].alias(c) for i, c in enumerate(("system", "asked", "answer"))])


_VARIANT_NAMES = ", ".join(f"({q(v)})" for v in generated.VARIANTS)
_KIND = "string_split(v, '_')[-1]"


@query(f"""WITH {_RECORDS}, vs(v) AS (VALUES {_VARIANT_NAMES}), t0 AS (SELECT *, 'The ' || s_name AS title, trim(replace(' ' || lower('The ' || s_name) || ' ', ' the ', ' si ')) AS translated FROM rs, vs),
    t AS (SELECT *, translated || ' / ' || title AS shown, 'satu, b' AS grp, coalesce(nullif(array_to_string(warnings[1:3], ', '), ''), {q(generated.NO_WARNINGS)}) AS wp FROM t0),
    r AS (SELECT *, 'medlineplus_' || id || '_' || v AS rid, {_by_kind_sql('v', generated.OVERVIEW, title='shown', group='grp', excerpt="'Ringkas ' || s_name", related="'x, y'")} AS ov, {_by_kind_sql('v', generated.CARE, title='shown', warnings='wp')} AS cr FROM t)
    SELECT rid AS id, translated || ' - ' || {_by_kind_sql('v', generated.TOPIC_LABEL)} AS topic, shown AS formula_name, {_sql_template(generated.TOPIC_DIAGNOSIS, group='grp', institute=q(generated.INSTITUTE))} AS diagnosis_summary, {_by_kind_sql(_KIND, generated.SYSTEM)} AS system, {_by_kind_sql(_KIND, generated.QUESTION, title='shown')} AS asked,
        {_blocks_sql(generated.TOPIC_ANSWER, {'questions': 'len(questions) > 0', 'warnings': 'len(warnings) > 0', 'prevention': 'len(prevention) > 0'}, overview='ov', care='cr', questions=_numbers_sql('questions[1:5]'), warnings=_bullets_sql('warnings[1:5]'), prevention=_bullets_sql('prevention[1:5]'))} AS answer FROM r""")
def topic_dataset(spark, sf):
    """Five records of each topic and their chat rows."""
    r = _records(spark, sf)
    name = F.element_at(F.split("id", "s"), -1)
    t = r.join(table(spark, sf, "supplier").select("s_suppkey", "s_name"), name == F.col("s_suppkey").cast("string"))
    t = t.select("id", F.concat(F.lit("The "), "s_name").alias("title"), F.lit("u").alias("url"), F.array(F.lit("A"), F.lit("B")).alias("groups"), F.array(F.lit("X"), F.lit("y")).alias("related"), F.lit("").alias("institute"), F.concat(F.lit("Ringkas  "), "s_name").alias("summary"), "symptoms", "warning_signs", "prevention_steps", "screening_questions")
    records = datasets.topic_records(t, {"A": "satu"}, {"the": "si"}, {})
    chats = datasets.topic_chats(records).select(F.col("id").alias("cid"), *[F.get("messages", i)["content"].alias(c) for i, c in enumerate(("system", "asked", "answer"))])
    return records.join(chats, F.col("id") == F.col("cid")).select("id", "topic", "formula_name", "diagnosis_summary", "system", "asked", "answer")


_OPEN, _CLOSE = ["Baik.", "Tentu.", "Oke."], ["Salam.", "Terima kasih."]


@query(f"""WITH {_RECORDS}, a AS (SELECT *, CAST(n % 7 AS INTEGER) AS k FROM rs), b AS (SELECT *, CASE WHEN len(symptoms) > 0 THEN symptoms[k % len(symptoms) + 1] ELSE name END AS one, CASE WHEN len(symptoms) > 1 THEN symptoms[(k + 1) % len(symptoms) + 1] END AS two,
        CASE WHEN len(questions) > 0 THEN list_concat(questions[k % len(questions) + 1:], questions[1:k % len(questions)]) ELSE [] END AS rq, CASE WHEN len(warnings) > 0 THEN list_concat(warnings[k % len(warnings) + 1:], warnings[1:k % len(warnings)]) ELSE [] END AS rw FROM a)
    SELECT id, {_sql_template(generated.COMPLAINT, profile="'Saya'", symptoms="CASE WHEN two IS NOT NULL AND two <> one THEN one || ' dan ' || two ELSE one END", duration="'dua hari'", severity="'ringan'", intent="'khawatir'")} AS asked,
        {_sql_template(generated.ANAMNESIS, opening=f"({_array(_OPEN)})[k % 3 + 1]", condition='name', questions=_bullets_sql('rq[1:6]'), flags=_bullets_sql('rw[1:3]'), action='own_care', closing=f"({_array(_CLOSE)})[k % 2 + 1]", sources="array_to_string(prevention[1:3], '; ')")} AS answer FROM b""")
def anamnesis_dataset(spark, sf):
    """Complaints with two symptoms by number, and answers with rotated questions."""
    r = _records(spark, sf).withColumns({"primary_symptoms": F.col("symptoms"), "suspected_condition": F.coalesce(F.nullif("formula_name", F.lit("")), F.col("topic")), "required_questions": F.col("screening_questions"), "red_flag_questions": F.col("warning_signs"), "triage_action": F.col("care_recommendation"), "source_titles": F.col("prevention_steps")})
    k = (F.element_at(F.split("id", "s"), -1).cast("bigint") % 7).cast("int")
    return r.select("id", datasets.complaint(F.lit("Saya"), F.lit("dua hari"), F.lit("ringan"), F.lit("khawatir"), k).alias("asked"), datasets.anamnesis_answer(k, _OPEN, _CLOSE).alias("answer"))


@query(f"""WITH {_RECORDS}, f(focus, prefix) AS (VALUES ('', 'sft'), ('dosis', 'sft_dosis'))
    SELECT prefix || '_' || id AS id, {_by_kind_sql('focus', generated.CATALOG, symptoms="coalesce(nullif(array_to_string(symptoms, ', '), ''), 'Topic ' || n)", formula=f"CASE WHEN n % 4 > 0 THEN s_name ELSE {q(generated.CATALOG_FORMULA)} END")} AS asked, CASE focus WHEN 'dosis' THEN 'Dosis.' ELSE care END AS answer FROM rs, f""")
def catalog_dataset(spark, sf):
    """Two chat rows of each catalogue record."""
    answer = lambda focus: F.when(F.col(focus) == "dosis", "Dosis.").otherwise(F.coalesce(F.nullif("care_recommendation", F.lit("")), F.col("safety_notes")))
    rows = datasets.catalog_chats(_records(spark, sf), "system", answer)
    return rows.select("id", F.get("messages", 1)["content"].alias("asked"), F.get("messages", 2)["content"].alias("answer"))


# Pages, documents and long texts

#: Character references of the test pages; the ampersand comes last.
_REFERENCES = {"&copy;": "©", "&middot;": "·", "&quot;": '"', "&lt;": "<", "&gt;": ">", "&#x27;": "'", "&#39;": "'", "&amp;": "&"}


def _decode_sql(x: str) -> str:
    for a, b in _REFERENCES.items():
        x = f"replace({x}, {q(a)}, {q(b)})"
    return x


SQL["page_node_text"] = f"""WITH p AS (SELECT page_id, {squeeze(_decode_sql("regexp_extract(html, '(?is)<title>(.*?)</title>', 1)"))} AS title,
    list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(html, '(?is)<(script|style|noscript|svg|title)[^>]*>.*?</(script|style|noscript|svg|title)>', '<x>', 'g'), '(?s)<!--.*?-->', '<x>', 'g'), '(?s)<[^>]*>'), lambda t: {squeeze(_decode_sql('t'))}), lambda t: length(t) > 24) AS t FROM pages)
    SELECT page_id, title, array_to_string(t, ' ') AS text FROM p"""


_LINES = "list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(regexp_replace(x, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))), lambda x: x <> '')"


@query(f"""WITH d AS (SELECT doc_id, {_LINES} AS l FROM documents), p AS (SELECT doc_id, list_filter(l, lambda x, i: i % 3 > 0) AS a, list_filter(l, lambda x, i: i % 3 = 0) AS b FROM d)
    SELECT doc_id, array_to_string(a, '|') AS paragraphs, array_to_string(b, '|') AS items, trim(regexp_replace(array_to_string(a, ' ') || ' ' || CASE WHEN len(b) > 0 THEN array_to_string(b, ' ; ') || ' ;' ELSE '' END, '\\s+', ' ', 'g')) AS flat FROM p""")
def summary_fragments(spark, sf):
    """Paragraphs, list items and plain text of HTML made of whole texts: every third line is a list item."""
    escaped = F.replace(F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    lines = F.filter(F.transform(F.split(escaped, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    p = F.array_join(F.transform(F.filter(lines, lambda x, i: (i + 1) % 3 > 0), lambda x: F.concat(F.lit("<p> "), x, F.lit("</p>\n"))), "")
    li = F.array_join(F.transform(F.filter(lines, lambda x, i: (i + 1) % 3 == 0), lambda x: F.concat(F.lit("<li>"), x, F.lit(" </LI>"))), "")
    html = F.concat(p, F.lit("<ul>"), li, F.lit("</ul>"))
    r = table(spark, sf, "documents").select("doc_id", parsing.summary_parts(html).alias("s"), parsing.html_to_text(html).alias("flat"))
    return r.select("doc_id", _joined("s.paragraphs").alias("paragraphs"), _joined("s.list_items").alias("items"), "flat")


@query(rf"""WITH d AS (SELECT doc_id, {_LINES}[1:CAST(doc_id % 5 AS INTEGER)] AS l FROM documents)
    SELECT doc_id, array_to_string(list_transform(l, lambda x, i: 'Herb ' || i || ' of ' || doc_id), '|') AS titles, array_to_string(list_transform(l, lambda x, i: 'Definition ' || x), '|') AS bodies FROM d""")
def monograph_split(spark, sf):
    """Monographs of the first lines of a text, as many as its number says."""
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    some = F.slice(lines, F.lit(1), (F.col("doc_id") % 5).cast("int"))
    long = F.concat(F.lit("Preface\n"), F.array_join(F.transform(some, lambda x, i: F.concat(F.lit("  Herb "), (i + 1).cast("string"), F.lit(" of "), F.col("doc_id").cast("string"), F.lit(" \n\nDefinition "), x, F.lit("\n"))), ""))
    m = table(spark, sf, "documents").select("doc_id", parsing.monographs(long).alias("m"))
    return m.select("doc_id", _joined(F.transform("m", lambda x: x["title"])).alias("titles"), _joined(F.transform("m", lambda x: F.regexp_replace(x["body"], r"^[^\n]*\n\s*", ""))).alias("bodies"))


@query("""SELECT doc_id, 'Herb ' || lang AS name, CASE WHEN doc_id % 4 IN (0, 2) THEN text WHEN doc_id % 4 = 1 THEN source END AS uses, CASE doc_id % 4 WHEN 2 THEN text WHEN 3 THEN source END AS dose FROM documents""")
def page_fields(spark, sf):
    """Descriptions by heading of a JSON page, with whole texts: headings in any order, repeated or missing."""
    kind = F.col("doc_id") % 4
    first = F.when(kind == 0, "Common Uses").when(kind == 1, "Other").when(kind == 2, "USES, dose")
    second = F.when(kind == 0, "uses again").when(kind == 1, "How it uses").otherwise("Dose")
    third = F.struct(F.lit("dose" "d").alias("heading"), F.lit("never").alias("description"))
    blocks = F.array(F.struct(F.coalesce(first, F.lit("")).alias("heading"), F.col("text").alias("description")), F.struct(second.alias("heading"), F.col("source").alias("description")), third)
    payload = F.to_json(F.struct(F.concat(F.lit("Herb "), "lang").alias("name"), F.when(kind < 2, F.slice(blocks, 1, 2)).otherwise(blocks).alias("blocks")))
    r = table(spark, sf, "documents").select("doc_id", parsing.field_blocks(payload, {"uses": "uses", "dose": "dose"}).alias("r"))
    return r.select("doc_id", "r.name", "r.uses", "r.dose")


@F.pandas_udf(T.BinaryType())
def _docx(texts):
    """Word-processor files with a paragraph for each line of a text."""
    import io
    import zipfile
    from xml.sax.saxutils import escape

    def one(t):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main">' + "".join(f"<w:p><w:t>{escape(x)}</w:t></w:p>" for x in t.split("\n")) + "</w:document>")
        return out.getvalue()

    return texts.map(one)


@query("""WITH d AS (SELECT doc_id AS path, regexp_replace(coalesce(source, 'none'), '\\s+', ' ', 'g') AS s FROM documents)
    SELECT path, 'intro' AS heading, 'Start ' || s AS body FROM d UNION ALL SELECT path, 'gejala', 'demam ' || s || '|batuk' FROM d UNION ALL SELECT path, 'pencegahan', 'cuci' FROM d""")
def document_sections(spark, sf):
    """Sections of word-processor files below their headings."""
    s = F.regexp_replace(F.coalesce("source", F.lit("none")), r"\s+", " ")
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.concat(F.lit("Start "), s, F.lit("\n\nGejala:\n demam "), s, F.lit("\nbatuk\nPencegahan umum\ncuci")).alias("t"))
    paragraphs = d.select("path", parsing.docx_paragraphs(_docx("t")).alias("paragraphs"))
    return knowledge.doc_sections(paragraphs, ["gejala", "pencegahan"]).select("path", "heading", _joined("body").alias("body"))


@query(f"""WITH d AS (SELECT doc_id, {_LINES}[1:CAST(doc_id % 5 AS INTEGER)] AS l FROM documents), r AS (SELECT doc_id, unnest(l) AS x, unnest(range(1, len(l) + 1)) AS number FROM d)
    SELECT doc_id, CAST(number AS INTEGER) AS number, 'Herb ' || number || ' of ' || doc_id AS title, 'Definition ' || x AS body FROM r""")
def monograph_rows(spark, sf):
    """One row for each monograph of a text, by a table function in a lateral join."""
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    some = F.slice(lines, F.lit(1), (F.col("doc_id") % 5).cast("int"))
    long = F.concat(F.lit("Preface\n"), F.array_join(F.transform(some, lambda x, i: F.concat(F.lit("  Herb "), (i + 1).cast("string"), F.lit(" of "), F.col("doc_id").cast("string"), F.lit(" \n\nDefinition "), x, F.lit("\n"))), ""))
    found = tables.parts(table(spark, sf, "documents").select("doc_id", long.alias("t")), "monographs", "r.t")
    return found.select("doc_id", "number", "title", F.regexp_replace("body", r"^[^\n]*\n\s*", "").alias("body"))


@query(f"""WITH d AS (SELECT doc_id, {_LINES} AS l FROM documents), r AS (SELECT doc_id, unnest(l) AS x, unnest(range(1, len(l) + 1)) AS i FROM d), k AS (SELECT doc_id, CASE WHEN i % 3 = 0 THEN 'li' ELSE 'p' END AS kind, i, x FROM r)
    SELECT doc_id, kind, CAST(row_number() OVER (PARTITION BY doc_id, kind ORDER BY i) AS INTEGER) AS number, x AS content FROM k""")
def fragment_rows(spark, sf):
    """One row for each paragraph and list item of HTML made of whole texts."""
    escaped = F.replace(F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    lines = F.filter(F.transform(F.split(escaped, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    html = F.array_join(F.transform(lines, lambda x, i: F.when((i + 1) % 3 == 0, F.concat(F.lit("<li> "), x, F.lit("</li>"))).otherwise(F.concat(F.lit("<p>"), x, F.lit("</p>")))), "\n")
    return tables.parts(table(spark, sf, "documents").select("doc_id", html.alias("t")), "fragments", "r.t").select("doc_id", "kind", "number", "content")


@query(f"""WITH d AS (SELECT doc_id, {_LINES} AS l FROM documents), r AS (SELECT doc_id, unnest(l) AS x, unnest(range(1, len(l) + 1)) AS i FROM d)
    SELECT doc_id, CASE i WHEN 1 THEN 'intro' WHEN 2 THEN 'gejala' ELSE 'pencegahan' END AS heading, count(*) AS n, sum(length(x) + 2)::BIGINT AS chars FROM r WHERE i <= 4 GROUP BY ALL""")
def section_rows(spark, sf):
    """Lines of the first four below headings that stand between them."""
    lines = F.slice(F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != ""), 1, 4)
    marked = F.transform(lines, lambda x, i: F.concat(F.when(i == 1, "Gejala:\n").when(i == 2, "\nPencegahan umum.\n").when(i == 3, "PENCEGAHAN\n").otherwise(""), F.lit("z "), x))
    found = tables.parts(table(spark, sf, "documents").select("doc_id", F.array_join(marked, "\n").alias("t")), "sections", "r.t", "'gejala|pencegahan'")
    return found.groupBy("doc_id", "heading").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("line")).alias("chars"))


_SENTENCES = lambda x: rf"string_split(regexp_replace({squeeze(x)}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"


@query(rf"""WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
    p AS (SELECT *, list_filter(list_transform(l, lambda x: regexp_replace(regexp_replace(x, '^\s*(?:[-*•·]|[0-9]+[.)])\s*', ''), '^\s+|\s+$', '', 'g')), lambda x: x <> '' AND NOT regexp_matches(x, '(?i)^(sumber|penulis|editor|tanggal)\b')) AS c FROM d),
    u AS (SELECT *, list_filter(c, lambda x, i: list_position(c, x) = i)[1:5] AS pts FROM p)
    SELECT doc_id, rtrim(substr(array_to_string(({_SENTENCES('text')})[1:2], ' '), 1, 360)) AS summary, array_to_string(CASE WHEN len(pts) > 0 THEN pts ELSE ({_SENTENCES("array_to_string(l, ' ')")})[1:5] END, '|') AS points FROM u""")
def sentence_texts(spark, sf):
    """Summaries and points of whole texts."""
    d = table(spark, sf, "documents").where("text is not null")
    return d.select("doc_id", text.summarize("text").alias("summary"), _joined(text.to_points(F.split("text", "\n"), 5)).alias("points"))


@query(r"""WITH c AS (SELECT conv_id, turn, regexp_replace(text, '[0-9?]', '', 'g') AS t FROM conversations), s AS (SELECT conv_id, turn, 'Apa ' || trim(regexp_replace(t, '\s+', ' ', 'g')) AS a FROM c)
    SELECT conv_id, turn, CASE WHEN length(a) + 1 > 6 THEN a || '?|Sejak kapan?' ELSE 'Sejak kapan?' END AS questions FROM s""")
def question_lists(spark, sf):
    """Questions of a reply, without numbers."""
    c = table(spark, sf, "conversations")
    t = F.trim(F.regexp_replace(F.regexp_replace("text", "[0-9?]", ""), r"\s+", " "))
    return c.select("conv_id", "turn", _joined(text.split_questions(F.concat(F.lit("1. Apa "), t, F.lit("? 2) Sejak kapan? ya")), 2)).alias("questions"))


@query("SELECT doc_id, CASE WHEN ('0x' || substr(sha256('42:' || doc_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < 0.08::DOUBLE THEN 'valid' WHEN ('0x' || substr(sha256('42:' || doc_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < 0.16::DOUBLE THEN 'test' ELSE 'train' END AS split FROM documents")
def random_split_rows(spark, sf):
    return split.random_split(table(spark, sf, "documents").select("doc_id"), "doc_id")


@query("SELECT event_id, event_type FROM events ORDER BY date_trunc('day', ts) DESC, event_id LIMIT 40")
def newest_events(spark, sf):
    """The newest by day; many events share one, and the smaller id counts."""
    e = table(spark, sf, "events").select("event_id", "event_type", F.date_trunc("day", "ts").alias("day"))
    return catalogs.newest(e, "day", ties=["event_id"]).select("event_id", "event_type")


@query("SELECT doc_id, text FROM documents")
def combined_files(spark, sf):
    """All rows of several files."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    paths = [work_folder(spark, "part") for _ in range(2)]
    for i, p in enumerate(paths):
        sinks.write_jsonl(d.where(F.col("doc_id") % 2 == i), p)
    return catalogs.combined(spark, paths, "doc_id bigint, text string")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, CAST(sum(ceil(value)) AS DOUBLE) AS total FROM events GROUP BY 1")
def daily_events(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.ceil("value")).cast("double").alias("total"))


# The chat as a stream


@query(f"""WITH {_MARKS}, f AS (SELECT sn.conv_id || '_' || sn.turn AS session_id, conv_id % 4 AS n_hits, (turn * 7 % 10) / 20.0::DOUBLE AS best, n, text, red_flags, present IS NOT NULL AND present <> '' OR hinted IS NOT NULL AS told, CASE conv_id % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'unsupported' WHEN 2 THEN NULL ELSE 'supported' END AS scope, turn % 3 = 0 AS refer, turn % 5 = 0 AS enough
        FROM sn LEFT JOIN rf USING (conv_id, turn) LEFT JOIN ss USING (conv_id, turn) LEFT JOIN hc USING (conv_id, turn)),
    r AS (SELECT *, CASE WHEN {any_of('n', signals.CONFUSION)} THEN 'clarification' WHEN {_TEMPERATURE} IS NOT NULL THEN 'clarification' WHEN red_flags IS NOT NULL THEN 'red_flag' WHEN n_hits = 0 OR NOT (told OR best >= 0.28) THEN 'out_of_scope' WHEN coalesce(scope = 'critical', false) OR refer THEN 'medical_referral'
        WHEN coalesce(scope = 'unsupported', false) THEN 'out_of_scope' WHEN scope IS NULL OR NOT enough THEN 'follow_up' ELSE 'recommendation' END AS response_type FROM f)
    SELECT session_id, response_type, CASE response_type WHEN 'clarification' THEN 'anamnesis_clarification' WHEN 'red_flag' THEN 'red_flag_guardrail' WHEN 'follow_up' THEN 'anamnesis_follow_up_1' WHEN 'recommendation' THEN 'final_recommendation' ELSE response_type END AS stage, CASE WHEN response_type = 'follow_up' THEN 1 ELSE 0 END AS question_count,
        response_type NOT IN ('clarification', 'follow_up') AS completed, CASE WHEN response_type = 'red_flag' THEN red_flags ELSE '' END AS red_flags FROM r""")
def chat_first_turns(spark, sf):
    """The routed chat as a stateful stream, over sessions of a single turn."""
    work = work_folder(spark, "chat")
    c = seeded(spark, sf)
    scope = F.when(F.col("conv_id") % 5 == 0, "critical").when(F.col("conv_id") % 5 == 1, "unsupported").when(F.col("conv_id") % 5 == 2, F.lit(None).cast("string")).otherwise("supported")
    given = {"session_id": F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")), "message": F.col("text"), "n_hits": (F.col("conv_id") % 4).cast("int"), "best_score": F.col("turn") * 7 % 10 / 20.0, "scope": scope, "refer": F.col("turn") % 3 == 0, "enough": F.col("turn") % 5 == 0, "question": F.lit("Sejak kapan?"), "turn": F.col("turn").cast("bigint")}
    columns = [x.split(" ", 1) for x in chat.TURN.split(", ")]
    c.select(*[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in columns]).write.parquet(f"{work}/in")
    chat.run_chat(spark.readStream.schema(chat.TURN).parquet(f"{work}/in"), f"{work}/out", f"{work}/check").awaitTermination()
    r = spark.read.parquet(f"{work}/out/responses")
    return r.select("session_id", "response_type", "stage", "question_count", "completed", _joined("red_flags").alias("red_flags"))


#: Questions of which no two share most of their words.
_ASKS = ("Apakah ada sesak atau nyeri hebat?", "Ada ruam atau kaku leher?", "Sejak kapan keluhan muncul?")
_SAID = {3: "jelaskan cara membuat ramuan", 4: "kurang cocok", 5: "tidak ada"}
_CLIENT = {"message": "saya batuk sejak kemarin", "suspected": ("c1", "c2", "c3", "c4")}
_SAFE, _FEVER = (signals.normalize_literal(n) for n in (signals.SAFETY_NOTE, signals.FEVER_NOTE))
_CHAT_NOTES = ["", f" {_SAFE}", f" {_FEVER}", f" {_SAFE} {_FEVER}", f" {_FEVER} {_SAFE}"]


def _chat_input(spark, sf) -> DataFrame:
    """Whole conversations as turns: assessments by their numbers, bare denials, requests and feedback between seeded texts; a sixth of them is cleared at turn 2."""
    c, mark = seeded(spark, sf), (F.col("conv_id") + F.col("turn")) % 6
    message = F.col("text")
    for k, said in _SAID.items():
        message = F.when(mark == k, F.lit(said)).otherwise(message)
    kind = (F.col("conv_id") + 3 * F.col("turn")) % 8
    given = {
        "session_id": F.col("conv_id").cast("string"), "turn": F.col("turn"), "message": message, "n_hits": (F.col("conv_id") % 9).cast("int"), "best_score": F.col("turn") * 7 % 10 / 20.0,
        "scope": F.when(kind == 0, "critical").when(kind == 1, "unsupported").when(kind > 2, "supported"), "enough": F.col("turn") % 5 == 4, "question": F.element_at(F.array(*map(F.lit, _ASKS)), (F.col("turn") % 3 + 1).cast("int")),
        "suspected": F.array(F.concat(F.lit("s"), F.col("turn").cast("string")), F.lit("a"), F.lit("b"), F.lit("c")), "recommendation": F.concat(F.lit("r"), F.col("turn").cast("string")), "event": F.when((F.col("conv_id") % 6 == 3) & (F.col("turn") == 2), "clear"),
    }
    return c.select(*[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in (x.split(" ", 1) for x in chat.TURN.split(", "))])


def _chat_clients(spark, sf) -> DataFrame:
    """The clients' copies of a sixth of the sessions; half of these ended with a recommendation."""
    ids = table(spark, sf, "conversations").where("conv_id % 6 = 4").select("conv_id").distinct()
    done = F.col("conv_id") % 12 == 10
    turns = F.array(F.struct(F.lit("user").alias("role"), F.lit(_CLIENT["message"]).alias("content")), F.struct(F.lit("assistant").alias("role"), F.lit(_ASKS[0]).alias("content")))
    return ids.select(
        F.col("conv_id").cast("string").alias("session_id"), turns.alias("turns"), F.lit(2).cast("bigint").alias("question_count"), F.when(done, "final_recommendation").otherwise("anamnesis_follow_up_2").alias("stage"),
        done.alias("completed"), F.array(*map(F.lit, _CLIENT["suspected"])).alias("suspected_conditions"), F.array(F.lit(_ASKS[0]), F.lit(" ")).alias("asked"), F.when(done, "old").alias("recommendation"),
    )


def _chat_sql(restore: bool) -> str:
    known = f"conv_id % 6 = 4 AND {str(restore).lower()}"
    said = " ".join(f"WHEN {k} THEN {q(v)}" for k, v in _SAID.items())
    notes = ", ".join(q(n) for n in _CHAT_NOTES)
    texts = f"""{_SEEDED.split(', sn AS')[0]},
msg AS (SELECT conv_id, turn, CASE (conv_id + turn) % 6 {said} ELSE text END AS text, conv_id % 6 = 3 AND turn = 2 AS clears, count(*) FILTER (WHERE conv_id % 6 = 3 AND turn = 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seg FROM seeded),
m AS MATERIALIZED (SELECT *, {norm('text')} AS n, row_number() OVER (PARTITION BY conv_id, seg ORDER BY turn) AS i FROM msg),
lines AS (SELECT conv_id, seg, i, turn, n FROM m WHERE NOT clears UNION ALL SELECT DISTINCT conv_id, 0, 0, -1, {q(_CLIENT['message'])} FROM m WHERE {known}),
fresh AS (SELECT *, n <> '' AND n IS DISTINCT FROM lag(n) OVER (PARTITION BY conv_id, seg, n <> '' ORDER BY i) AS adds FROM lines),
so_far AS (SELECT conv_id, turn, coalesce(string_agg(CASE WHEN adds THEN n END, ' ') OVER (PARTITION BY conv_id, seg ORDER BY i), '') AS n FROM fresh),
sn AS (SELECT conv_id, turn * 8 + c AS turn, trim(n || [{notes}][c + 1]) AS n FROM so_far, (SELECT unnest(range(5)) AS c) WHERE turn >= 0)"""
    return f"""WITH RECURSIVE {_marked(texts)},
facts AS MATERIALIZED (SELECT sn.conv_id, sn.turn // 8 AS turn, sn.turn % 8 AS combo, coalesce(red_flags, '') AS red_flags, coalesce(present, '') <> '' OR hinted IS NOT NULL AS complaint, {_duration()} IS NOT NULL OR {any_of('n', DEFAULT.duration_words)} AS duration, {_CLEARED} AS clearance, {any_of('n', (*DEFAULT.intensity, *DEFAULT.progression))} AS detail
    FROM sn LEFT JOIN rf USING (conv_id, turn) LEFT JOIN ss USING (conv_id, turn) LEFT JOIN hc USING (conv_id, turn)),
t AS MATERIALIZED (SELECT conv_id, seg, i, turn, clears, n, conv_id % 9 AS hits, (turn * 7 % 10) / 20.0::DOUBLE AS best, CASE (conv_id + 3 * turn) % 8 WHEN 0 THEN 'critical' WHEN 1 THEN 'unsupported' WHEN 2 THEN NULL ELSE 'supported' END AS scope, turn % 5 = 4 AS enough, [{', '.join(q(a) for a in _ASKS)}][turn % 3 + 1] AS question,
    {_FEEDBACK} AS feedback, {_DETAIL} AS detail_asked, {any_of('n', signals.CONFUSION)} AS confused, {_TEMPERATURE} IS NOT NULL AS hot, n IN ({', '.join(q(a) for a in signals.NEGATIVE_ANSWERS)}) AS bare FROM m),
r AS (SELECT DISTINCT conv_id, seg, 0::BIGINT AS i, NULL::BIGINT AS turn, 0 AS combo, CASE WHEN {known} AND seg = 0 THEN [{q(_ASKS[0])}] ELSE []::VARCHAR[] END AS asked, CASE WHEN {known} AND seg = 0 THEN 2 ELSE 0 END AS qc,
        CASE WHEN {known} AND seg = 0 THEN CASE WHEN conv_id % 12 = 10 THEN 'final_recommendation' ELSE 'anamnesis_follow_up_2' END ELSE 'initial' END AS stage, {known} AND seg = 0 AND conv_id % 12 = 10 AS completed, CASE WHEN {known} AND seg = 0 AND conv_id % 12 = 10 THEN 'old' END AS rec,
        CASE WHEN {known} AND seg = 0 THEN 'c1|c2|c3' ELSE '' END AS suspected, NULL::VARCHAR AS kind, ''::VARCHAR AS flags, NULL::VARCHAR AS feedback, NULL::VARCHAR AS before FROM t
    UNION ALL
    SELECT conv_id, seg, i, turn, combo, CASE WHEN kind = 'follow_up' AND NOT list_contains(asked, question) THEN list_append(asked, question) ELSE asked END, CASE kind WHEN 'cleared' THEN 0 WHEN 'follow_up' THEN qc + 1 ELSE qc END,
        CASE kind WHEN 'cleared' THEN 'initial' WHEN 'confused' THEN 'anamnesis_clarification' WHEN 'hot' THEN 'anamnesis_clarification' WHEN 'red_flag' THEN 'red_flag_guardrail' WHEN 'out_of_scope' THEN 'out_of_scope' WHEN 'medical_referral' THEN 'medical_referral' WHEN 'follow_up' THEN 'anamnesis_follow_up_' || (qc + 1) WHEN 'recommendation' THEN 'final_recommendation' ELSE stage END,
        CASE WHEN kind IN ('red_flag', 'out_of_scope', 'medical_referral', 'recommendation') THEN true WHEN kind = 'cleared' THEN false ELSE completed END, CASE WHEN kind = 'recommendation' THEN 'r' || turn ELSE rec END, CASE kind WHEN 'follow_up' THEN 's' || turn || '|a|b' WHEN 'cleared' THEN '' ELSE suspected END, kind, red_flags, feedback, CASE WHEN len(asked) > 0 THEN asked[len(asked)] END
    FROM (SELECT x.*, f.red_flags, CASE WHEN clears THEN 'cleared' WHEN early IS NOT NULL THEN early WHEN f.red_flags <> '' THEN 'red_flag' WHEN hits = 0 OR NOT (f.complaint OR best >= 0.28) THEN 'out_of_scope' WHEN qc >= 3 THEN 'recommendation' WHEN scope = 'critical' THEN 'medical_referral' WHEN scope = 'unsupported' THEN 'out_of_scope'
            WHEN coalesce(scope = 'supported', false) AND qc > 0 AND f.complaint AND f.duration AND f.clearance AND (f.detail OR qc >= 2) THEN 'recommendation' WHEN scope IS NULL OR NOT enough THEN 'follow_up' ELSE 'recommendation' END AS kind
        FROM (SELECT y.* EXCLUDE (combo), CASE WHEN clears OR early IS NOT NULL OR note = 0 OR combo IN (3, 4) OR combo = note THEN combo WHEN combo = 0 THEN note ELSE combo + 2 END AS combo
            FROM (SELECT r.combo, r.asked, r.qc, r.stage, r.completed, r.rec, r.suspected, t.*, CASE WHEN r.completed AND r.stage = 'final_recommendation' AND t.detail_asked THEN 'preparation_detail' WHEN r.completed AND r.stage = 'final_recommendation' AND t.feedback IS NOT NULL THEN 'feedback' WHEN t.confused THEN 'confused' WHEN t.hot THEN 'hot' END AS early,
                CASE WHEN NOT t.bare OR len(r.asked) = 0 THEN 0 WHEN {any_of('lower(r.asked[len(r.asked)])', signals.SAFETY_TERMS)} THEN 1 WHEN {any_of('lower(r.asked[len(r.asked)])', signals.FEVER_TERMS)} THEN 2 ELSE 0 END AS note
                FROM r JOIN t ON t.conv_id = r.conv_id AND t.seg = r.seg AND t.i = r.i + 1) y) x LEFT JOIN facts f ON f.conv_id = x.conv_id AND f.turn = x.turn AND f.combo = x.combo))
SELECT CAST(conv_id AS VARCHAR) AS session_id, turn, CASE WHEN kind IN ('confused', 'hot') THEN 'clarification' ELSE kind END AS response_type, CASE kind WHEN 'preparation_detail' THEN 'preparation_detail_after_recommendation' WHEN 'feedback' THEN 'recommendation_feedback' ELSE stage END AS stage, CAST(qc AS INTEGER) AS question_count, completed,
    CASE WHEN kind = 'medical_referral' THEN 's' || turn || '|a|b|c' ELSE suspected END AS suspected, CASE WHEN kind = 'red_flag' THEN flags ELSE '' END AS red_flags, CASE kind WHEN 'follow_up' THEN [{', '.join(q(a) for a in _ASKS)}][turn % 3 + 1] WHEN 'confused' THEN before END AS question,
    CASE WHEN kind = 'feedback' THEN feedback END AS feedback, CASE WHEN kind IN ('preparation_detail', 'feedback', 'recommendation') THEN rec END AS recommendation FROM r WHERE kind IS NOT NULL"""


def _chat_run(spark, sf, restore: bool) -> tuple[DataFrame, DataFrame]:
    """The turns, in two files that the stream reads one after the other, and the responses."""
    work, turns = work_folder(spark, "chat"), _chat_input(spark, sf)
    for part in ("turn < 3", "turn >= 3"):
        turns.where(part).coalesce(1).write.mode("append").parquet(f"{work}/in")
    stream = spark.readStream.schema(chat.TURN).option("maxFilesPerTrigger", 1).parquet(f"{work}/in")
    chat.run_chat(stream, f"{work}/out", f"{work}/check", clients=_chat_clients(spark, sf) if restore else None).awaitTermination()
    return spark.read.parquet(f"{work}/in"), spark.read.parquet(f"{work}/out/responses").drop("batch")


@query(_chat_sql(False))
def chat_sessions(spark, sf):
    """Whole conversations through the stateful stream, over two batches: budget, repeated questions, notes on bare denials, feedback, clear events."""
    return _chat_run(spark, sf, False)[1].withColumns({c: _joined(c) for c in ("suspected", "red_flags")})


@query(_chat_sql(True))
def chat_restored(spark, sf):
    """The same with a sixth of the sessions restored from their clients' copies before the first turn."""
    return _chat_run(spark, sf, True)[1].withColumns({c: _joined(c) for c in ("suspected", "red_flags")})


@query(f"""SELECT sha256(session_id || '|' || turn) AS id, session_id, turn, feedback AS feedback_label, 'kurang cocok' AS user_message, recommendation, 'pending_review' AS status FROM ({_chat_sql(True)}) WHERE response_type = 'feedback'""")
def chat_feedback(spark, sf):
    """Rows for review of the turns that gave feedback on a recommendation."""
    return chat.feedback_rows(*_chat_run(spark, sf, True)).select("id", "session_id", "turn", "feedback_label", "user_message", "recommendation", "status")


# Rules of single texts, answers of models, vectors


@query(f"""WITH {_SEEDED.split(', sn AS')[0]}, l AS (SELECT *, {squeeze("coalesce(text, '')")} AS s FROM seeded)
    SELECT conv_id, turn, NOT (ends_with(lower(s), '?') AND {any_of('lower(text)', signals.CLINICAL_TERMS)}) AS low_quality, array_to_string(list_filter([role, nullif(trim(s[1:9]), ''), CASE WHEN turn % 2 = 0 THEN 'x' END], lambda x: coalesce(trim(x), '') <> ''), '|') AS cleaned,
        concat_ws(' ', nullif(trim(role), ''), CASE WHEN trim(s[1:260]) <> trim(role) THEN nullif(trim(s[1:260]), '') END, 'tetap') AS note, CASE WHEN turn % 3 = 0 THEN '' ELSE trim(s || ' ' || role) END AS section FROM l""")
def text_rules(spark, sf):
    """Weak questions, cleaned lists, safety notes, and sections between headings."""
    c = seeded(spark, sf).withColumn("s", text.squeeze(F.coalesce("text", F.lit(""))))
    article = F.concat(F.lit("Intro\n"), F.when(F.col("turn") % 3 == 0, "Use").otherwise("Uses"), F.lit("\n"), "s", F.lit("\n"), "role", F.lit("\nDose\nnever\nUses of it\n"))
    return c.select(
        "conv_id",
        "turn",
        signals.low_quality_question("text").alias("low_quality"),
        _joined(text.clean_list(F.array("role", F.concat(F.substring("s", 1, 9), F.lit("")), F.when(F.col("turn") % 2 == 0, " x "), F.lit("  ")))).alias("cleaned"),
        curate.safety_note("role", "s", "tetap").alias("note"),
        text.section(article, "Uses", ["Intro", "Uses", "Dose"]).alias("section"),
    )


_BUDGETS = {"follow_up": 3, "recommendation": 5}


def _answer_sql(model: str, provider: str) -> str:
    budget = "CASE kind " + " ".join(f"WHEN {q(k)} THEN {n}" for k, n in _BUDGETS.items()) + f" ELSE {replies.token_budget('other')} END"
    return f"SELECT request, {q(model)} AS model, {q(provider)} AS provider, 'ok' AS status, array_to_string(regexp_extract_all('one two  three four five six seven ' || kind, '[^ ]+ *')[1:{budget}], '') AS reply, NULL::VARCHAR AS error FROM p"


@query(f"""WITH p AS (SELECT event_id AS request, CASE event_id % 3 WHEN 0 THEN 'follow_up' WHEN 1 THEN 'recommendation' ELSE 'other' END AS kind FROM events),
    a AS ({_answer_sql('m1', 'm1')} UNION ALL {_answer_sql('gone', 'm1')} UNION ALL SELECT request, 'broken', 'broken', 'error', NULL, 'out of order' FROM p) SELECT request, model, provider, status, rtrim(reply) AS reply, error FROM a""")
def model_answers(spark, sf):
    """Answers of a recorded model within the budget of each kind, of one that isn't there by the fallback, and errors as rows."""
    e = table(spark, sf, "events").select(F.col("event_id").cast("string").alias("request"), F.when(F.col("event_id") % 3 == 0, "follow_up").when(F.col("event_id") % 3 == 1, "recommendation").otherwise("other").alias("response_type"))
    found = replies.generate(e.withColumn("prompt", F.col("response_type")), _Recorded(), ["m1", "gone", "broken"], "m1", _BUDGETS)
    return found.withColumn("request", F.col("request").cast("long"))


class _Recorded(replies.Replay):
    """Recorded answers, and a model that fails."""

    def __init__(self):
        super().__init__({("m1", kind): f"one two  three four five six seven {kind}" for kind in ("follow_up", "recommendation", "other")})

    def answer(self, model: str, prompt: str, most: int) -> str:
        if model == "broken":
            raise RuntimeError("out of order")
        return super().answer(model, prompt, most)


@query("""SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def neighbour_cosines(spark, sf):
    """The cosine of each vector with the next one's."""
    e = table(spark, sf, "embeddings")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(after, "vec_id").select("vec_id", F.round(cosine("embedding", "other"), 6).alias("cosine"))


# Catalogues

_PROFILES = {"fever": {"keywords": ["est", "the"], "context": "hot", "complaints": ["demam", "panas"]}, "cough": {"keywords": ["der", "une", "and"], "context": "", "complaints": ["batuk"]}}


def _catalog(spark, sf) -> dict[str, DataFrame]:
    d = table(spark, sf, "documents").where("text is not null")
    key = F.concat(F.lit("Herba "), (F.col("doc_id") % 150).cast("string"))
    sources = d.select(F.when(F.col("doc_id") % 3 > 0, key).otherwise("").alias("display"), key.alias("scientific"), F.array(F.concat(F.lit("n"), F.col("doc_id").cast("string"))).alias("aliases"), F.col("text").alias("text"), F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("url"), F.when(F.col("doc_id") % 7 == 0, "high").when(F.col("doc_id") % 2 == 0, "medium").otherwise("low").alias("level"), F.col("doc_id").alias("ord"))
    legacy = {
        "herbs": spark.createDataFrame([("herba_1", "kept", "old"), ("zz_old", "lama", "buku")], "key string, ringkasan_manfaat string, sumber_utama string"),
        "formulas": spark.createDataFrame([("Ramuan tua", "akar", "fever", "low", 1)], "nama_formula string, komposisi string, gejala_target string, evidence_level string, ord int"),
        "cases": spark.createDataFrame([("mual lama", "Ramuan tua", "akar", 1)], "keluhan_ringan string, ramuan_rekomendasi string, bahan string, ord int"),
    }
    return catalogs.build_catalog(sources, _PROFILES, legacy, {"tanya": "Apa itu {title}?"}, "sys")


def _key_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"


_HITS = " UNION ALL ".join(f"SELECT mk, {q(p)} AS profile, {' + '.join(f'CAST(contains(lower(txt), {q(k)}) AS INTEGER)' for k in v['keywords'])} AS hits FROM m" for p, v in _PROFILES.items())
_CATALOG_SQL = f"""s AS (SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN 'Herba ' || doc_id % 150 ELSE '' END AS display, 'Herba ' || doc_id % 150 AS scientific, nullif(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '') AS text, 'u' || doc_id AS url, CASE WHEN doc_id % 7 = 0 THEN 'high' WHEN doc_id % 2 = 0 THEN 'medium' ELSE 'low' END AS level FROM documents WHERE text IS NOT NULL),
k AS (SELECT *, {_key_sql('scientific')} AS mk FROM s),
tx AS (SELECT mk, string_agg(text, ' ' ORDER BY o) AS txt FROM (SELECT mk, text, min(doc_id) AS o FROM k WHERE text IS NOT NULL GROUP BY ALL) GROUP BY mk),
m AS (SELECT k.mk, arg_min(display, doc_id) FILTER (display <> '') AS display, arg_min(scientific, doc_id) AS scientific, any_value(coalesce(txt, '')) AS txt, string_agg(url, ' ' ORDER BY doc_id) AS url, arg_min(level, (CASE level WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END) * 1000000000 + doc_id) AS level, min(doc_id) AS ord FROM k LEFT JOIN tx USING (mk) GROUP BY k.mk),
h AS (SELECT mk, profile, hits, CASE WHEN hits >= 3 THEN 'high' WHEN hits = 2 THEN 'medium' ELSE 'low_to_medium' END AS evidence, row_number() OVER (PARTITION BY mk ORDER BY hits DESC, profile) AS rank FROM ({_HITS}) WHERE hits > 0 QUALIFY rank <= 4)"""


@query(f"""WITH {_CATALOG_SQL}, lim AS (SELECT *, {squeeze('txt')} AS c FROM m), r AS (SELECT mk AS key, coalesce(display, scientific) AS nama_lokal, scientific AS nama_latin, CASE WHEN length(c) <= 400 THEN c ELSE regexp_replace(substr(c, 1, 400), ' [^ ]*$', '') END AS ringkasan_manfaat, level AS evidence_level, url AS sumber_utama FROM lim),
    b AS (SELECT r.key, nama_lokal, nama_latin, coalesce(nullif(r.ringkasan_manfaat, ''), l.a) AS ringkasan_manfaat, evidence_level, r.sumber_utama FROM r LEFT JOIN (VALUES ('herba_1', 'kept', 'old')) l(key, a, b) ON r.key = l.key UNION ALL SELECT 'zz_old', NULL, NULL, 'lama', NULL, 'buku')
    SELECT 'herb_' || lpad(CAST(row_number() OVER (ORDER BY lower(nama_lokal) NULLS FIRST, coalesce(nama_latin, ''), key) AS VARCHAR), 4, '0') AS id, key, nama_lokal, nama_latin, ringkasan_manfaat, evidence_level, sumber_utama FROM b""")
def catalog_herbs(spark, sf):
    """Herbs merged from sources, with legacy rows, numbered by name."""
    return _catalog(spark, sf)["herbs"].select("id", "key", "nama_lokal", "nama_latin", "ringkasan_manfaat", "evidence_level", "sumber_utama")


@query(f"""WITH {_CATALOG_SQL} SELECT coalesce(display, scientific) || ' untuk ' || profile AS nama_formula, coalesce(display, scientific) AS komposisi, profile AS gejala_target, CASE profile WHEN 'fever' THEN 'hot' ELSE '' END AS konteks_penggunaan, evidence AS evidence_level FROM h JOIN m USING (mk) UNION ALL SELECT 'Ramuan tua', 'akar', 'fever', '', 'low'""")
def catalog_formulas(spark, sf):
    """Formulas of each source and profile that match, after the legacy ones."""
    return _catalog(spark, sf)["formulas"].select("nama_formula", "komposisi", "gejala_target", "konteks_penggunaan", "evidence_level")


@query(f"""WITH {_CATALOG_SQL}, f AS (SELECT coalesce(display, scientific) || ' untuk ' || profile AS nama, coalesce(display, scientific) AS bahan, profile FROM h JOIN m USING (mk) UNION ALL SELECT 'Ramuan tua', 'akar', 'fever')
    SELECT w AS keluhan_ringan, nama AS ramuan_rekomendasi, bahan FROM f JOIN (VALUES ('fever', 'demam'), ('fever', 'panas'), ('cough', 'batuk')) v(profile, w) USING (profile) UNION ALL SELECT 'mual lama', 'Ramuan tua', 'akar'""")
def catalog_cases(spark, sf):
    """Cases of each formula and wording of its complaint, after the legacy ones."""
    return _catalog(spark, sf)["cases"].select("keluhan_ringan", "ramuan_rekomendasi", "bahan")


@query(f"""WITH {_CATALOG_SQL}, f AS (SELECT coalesce(display, scientific) || ' untuk ' || profile AS nama, profile FROM h JOIN m USING (mk) UNION ALL SELECT 'Ramuan tua', 'fever')
    SELECT 'herb' AS topic, count(*) + 1 AS n FROM m UNION ALL SELECT 'formula', count(*) FROM f UNION ALL SELECT 'case', sum(CASE profile WHEN 'fever' THEN 2 ELSE 1 END)::BIGINT + 1 FROM f""")
def catalog_records(spark, sf):
    """Training records by topic, each with a chat row."""
    c = _catalog(spark, sf)
    chats = c["chat"].select(F.col("source_record_id").alias("id")).join(c["records"].select("id", "topic"), "id")
    return chats.groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
