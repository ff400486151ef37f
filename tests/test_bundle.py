import pytest

from quillspark.functions.signals import analyze
from quillspark.operators.bundle import case_table, retrieve_bundle, retrieve_cases, retrieve_context, retrieve_guidance
from quillspark.operators.retrieval import TfidfIndex
from quillspark.sources import knowledge as K


@pytest.fixture(scope="module")
def base(spark):
    def rows(columns, lists, data):
        names = columns.split() + lists.split()
        return spark.createDataFrame([tuple(d.get(n, [] if n in lists.split() else "") for n in names) for d in data], K._schema(columns, lists))

    cases = rows(K.CASES, "", [
        {"id": "case_001", "keluhan_ringan": "mual ringan", "ramuan_rekomendasi": "Teh jahe", "bahan": "jahe;madu"},
        {"id": "case_002", "keluhan_ringan": "sakit tenggorokan", "ramuan_rekomendasi": "Air garam hangat", "bahan": "garam"},
        {"id": "case_007", "keluhan_ringan": "batuk karena polusi", "ramuan_rekomendasi": "Kencur madu", "bahan": "kencur;madu"},
        {"id": "case_009", "keluhan_ringan": "gatal dan ruam ringan", "ramuan_rekomendasi": "Lidah buaya", "bahan": "lidah buaya"},
    ])
    formulas = rows(K.FORMULAS, "", [{"id": "f1", "nama_formula": "Teh jahe", "komposisi": "jahe", "gejala_target": "mual", "evidence_level": "high"}, {"id": "f2", "nama_formula": "Kunyit asam", "gejala_target": "pegal"}])
    herbs = rows(K.HERBS, "", [{"id": "h1", "nama_lokal": "jahe", "gejala_target": "mual", "evidence_level": "medium"}])
    training = rows(K.TRAINING, K.TRAINING_LISTS, [
        {"id": "t1", "title": "Demam berdarah", "content_type": "disease_guidance", "evidence_level": "clinical_guideline_reference", "overview": "demam mual", "symptoms": ["demam"]},
        {"id": "t2", "title": "Teh jahe", "content_type": "herbal_guidance", "preparation": "rebus jahe"},
    ])
    anamnesis = rows(K.ANAMNESIS, K.ANAMNESIS_LISTS, [{"id": "a1", "condition_group": "penyakit_tropis", "suspected_condition": "Malaria", "sample_user_message": "demam menggigil mual", "applicable_case_ids": ["case_001"]}])
    chunks = K.chunks(cases, formulas, herbs, training, anamnesis).cache()
    return chunks, case_table(cases), TfidfIndex(chunks)


def asked(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "query int, text string")
    return analyze(df).select("query", "text", "hinted_case_ids", "detected_symptoms")


def test_top_cases(spark, base):
    chunks, cases, index = base
    q = asked(spark, "saya mual dan enek", "tenggorokan terasa sakit", "batuk ringan kena polusi", "gatal gatal muncul ruam merah", "halo apa kabar")
    got = {}
    for r in retrieve_cases(index, chunks, cases, q).orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append(r)
    assert {k: v[0].id for k, v in got.items()} == {0: "case_001", 1: "case_002", 2: "case_007", 3: "case_009"}
    assert got[0][0].score > 0.8 and all(len(v) <= 3 for v in got.values())


def test_hinted_case_without_hit_is_appended(spark, base):
    chunks, cases, index = base
    got = retrieve_cases(index, chunks, cases, asked(spark, "serak")).collect()
    assert [(r.id, r.score, r.evidence_level, r.matched_terms) for r in got] == [("case_007", 0.85, "curated_case_hint", "")]


def test_context_and_guidance(spark, base):
    from pyspark.sql import functions as F

    chunks, cases, index = base
    q = asked(spark, "saya mual demam").withColumn("case_id", F.lit("case_001"))
    got = {r.id: r for r in retrieve_context(index, chunks, cases, q).collect()}
    assert got["f1"].rank == 1 and got["f1"].score > 0.9 + 0.25 + 0.08 and "h1" in got and "t2" in got and not any(r.type == "case" for r in got.values())
    assert got["h1"].score > 0.5 + 0.25 + 0.08 and got["a1"].score > 0.55
    g = [r.id for r in retrieve_guidance(index, chunks, q).orderBy("rank").collect()]
    assert set(g) == {"t1", "a1"} and g[0] in ("t1", "a1")


def test_bundle(spark, base):
    chunks, cases, index = base
    q = asked(spark, "saya mual demam", "qqq")
    previous = spark.createDataFrame([(1, "case_002"), (0, "case_009")], "query int, case_id string")
    items, best = retrieve_bundle(index, chunks, cases, q, previous)
    assert {r.query: r.case_id for r in best.collect()} == {0: "case_001", 1: "case_002"}
    rows = [r for r in items.collect() if r.query == 0]
    assert len({r.id for r in rows}) == len(rows) and [r.score for r in sorted(rows, key=lambda r: r.rank)] == sorted((r.score for r in rows), reverse=True)
    assert {"case_001", "f1", "t1"} <= {r.id for r in rows}


def test_a_bundle_searches_once_for_cases_and_guidance(spark, base):
    chunks, cases, index = base

    class Counting:
        searches = 0

        def search(self, queries, k):
            self.searches += 1
            return index.search(queries, k)

    counting = Counting()
    retrieve_bundle(counting, chunks, cases, asked(spark, "saya mual demam"))
    assert counting.searches == 2
