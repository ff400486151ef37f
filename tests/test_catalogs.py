from pyspark.sql import functions as F

from quillspark.operators import catalogs as C


def test_build_catalog(spark):
    sources = spark.createDataFrame(
        [
            (2, "Ginger", "Zingiber officinale", ["Halia"], "Used for nausea and vomiting, nausea.", "u2", "medium"),
            (1, "jahe", "Zingiber  officinale", ["ginger", "halia"], "Motion sickness; cough too.", "u1", "high"),
            (3, "Madu", "", [], "Soothes cough.", "u3", "low"),
            (4, "", "", [], "nothing", "u4", ""),
        ],
        "ord int, display string, scientific string, aliases array<string>, text string, url string, level string",
    )
    profiles = {"mual": {"keywords": ["nausea", "vomiting", "sickness"], "context": "perut", "complaints": ["mual ringan", "perut mual"]}, "batuk": {"keywords": ["cough"], "context": "napas", "complaints": ["batuk ringan"]}}
    legacy = {
        "herbs": spark.createDataFrame([("zingiber_officinale", "old", "x", "note", "low", "src"), ("temulawak", "Temulawak", "C. x", "n", "low", "s")], "key string, nama_lokal string, nama_latin string, ringkasan_manfaat string, evidence_level string, sumber_utama string"),
        "formulas": spark.createDataFrame([("jahe untuk mual", "jahe", "mual", "high", 1)], "nama_formula string, komposisi string, gejala_target string, evidence_level string, ord int"),
        "cases": spark.createDataFrame([("mual ringan", "jahe untuk mual", "jahe", 1)], "keluhan_ringan string, ramuan_rekomendasi string, bahan string, ord int"),
    }
    overrides = spark.createDataFrame([("Madu", "minum langsung", 1)], "key string, cara_pengolahan string, ord int")
    out = C.build_catalog(sources, profiles, legacy, {"apa": "Apa itu {title}?", "cara": "Bagaimana {title}?"}, "S", overrides)
    herbs = {r.id: r for r in out["herbs"].collect()}
    assert [herbs[f"herb_{i:04d}"].nama_lokal for i in (1, 2, 3)] == ["jahe", "Madu", "Temulawak"] and herbs["herb_0001"].evidence_level == "high" and "u1 u2" == herbs["herb_0001"].sumber_utama
    formulas = out["formulas"].orderBy("id").collect()
    assert [(r.nama_formula, r.evidence_level) for r in formulas] == [("jahe untuk mual", "high"), ("jahe untuk batuk", "low_to_medium"), ("Madu untuk batuk", "low_to_medium")]
    cases = out["cases"].orderBy("id").collect()
    assert [r.keluhan_ringan for r in cases] == ["mual ringan", "perut mual", "batuk ringan", "batuk ringan"] and cases[3].cara_pengolahan == "minum langsung" and cases[0].id == "case_0001"
    chat = out["chat"].collect()
    assert len(chat) == 2 * (3 + 3 + 4) and all(len(r.messages) == 3 for r in chat)
    assert any(r.messages[1].content == "Apa itu Madu?" and r.source_record_id == "train_herb_herb_0002" for r in chat)


def test_names_and_parts(one):
    assert one(C.scientific_name("v"), v="Latin name: Curcuma longa L. rhizome") == "Curcuma longa" and one(C.scientific_name("v"), v="none") is None
    assert one(C.part_used("v"), v="dried leaf and root") == "akar" and one(C.part_used("v"), v="x") == "tidak disebutkan"
    assert one(C.clean_source_text("v"), v="a­b\rﬁ") == "abfi"
    m = F.struct(F.lit("a").alias("x"), F.array(F.lit("p"), F.lit("q")).alias("y"), F.lit(None).cast("string").alias("z"))
    assert one(C.flat_metadata(m, ["x", "y", "z"], ["y"])) == {"x": "a", "y": "p; q"}


def test_small_joins(spark, tmp_path):
    rec, src = spark.createDataFrame([("1", "a"), ("2", "b")], "id string, t string"), spark.createDataFrame([("1", "u")], "id string, url string")
    assert [tuple(r) for r in C.with_source(rec, src, "id", ["url"]).collect()] == [("1", "a", "u")]
    rec.write.json(str(tmp_path / "x"))
    assert C.combined(spark, [str(tmp_path / "x"), str(tmp_path / "x")], "id string, t string").count() == 4
    assert [r.id for r in C.newest(rec, "id", 1).collect()] == ["2"]
