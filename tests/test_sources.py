import json

from pyspark.sql import functions as F

from quillspark.operators.retrieval import TfidfIndex
from quillspark.sources import knowledge as K
from quillspark.sources import sinks


def test_readers_defaults_and_chunks(spark, tmp_path):
    (tmp_path / "cases.csv").write_text('id,keluhan_ringan,bahan,extra\ncase_001,"mual, ""ringan""",jahe;madu,x\ncase_002,batuk,,y\n')
    (tmp_path / "b_training_records.jsonl").write_text('{"title": "Panduan demam", "content_type": "disease_guidance", "symptoms": "demam;lemas", "unknown": 1}\n\n{"id": "t2", "title": "Teh jahe", "ingredients": ["jahe", ""]}\n')
    (tmp_path / "a_training_records.jsonl").write_text('{"id": "t0", "title": "Awal"}\n')
    (tmp_path / "anamnesis.jsonl").write_text('{"suspected_condition": "DBD", "applicable_case_ids": ["case_001"]}\nnot json\n')
    p = str(tmp_path)
    cases = K.read_csv(spark, f"{p}/cases.csv", K.CASES, optional=False)
    assert {r.id: (r.keluhan_ringan, r.bahan, r.sumber_ringkas) for r in cases.collect()} == {"case_001": ('mual, "ringan"', "jahe;madu", ""), "case_002": ("batuk", "", "")}
    training = K.training_records(spark, f"{p}/*_training_records.jsonl")
    got = training.orderBy("ord").collect()
    assert [r.id for r in got] == ["t0", "b_training_records_0001", "t2"] and [r.content_type for r in got] == ["herbal_guidance", "disease_guidance", "herbal_guidance"]
    assert got[1].symptoms == ["demam", "lemas"] and got[2].ingredients == ["jahe"] and got[0].symptoms == []
    an = K.anamnesis_records(spark, f"{p}/anamnesis.jsonl")
    assert [(r.id, r.applicable_case_ids) for r in an.collect()] == [("anamnesis_0001", ["case_001"])]
    none = K.read_csv(spark, f"{p}/none.csv", K.FORMULAS), K.read_csv(spark, f"{p}/none.csv", K.HERBS)
    all_ = K.chunks(cases, *none, training, an)
    rows = all_.orderBy("ord").collect()
    assert [r.type for r in rows] == ["case", "case", "training", "training", "training", "anamnesis"] and rows[0].case_id == "case_001" and rows[5].metadata.applicable_case_ids == ["case_001"]
    assert {r.type: r.n for r in K.health(all_).collect()} == {"case": 2, "training": 3, "anamnesis": 1}
    hits = TfidfIndex(all_).search(spark.createDataFrame([(1, "jahe untuk mual")], "query long, text string"), 2).orderBy("rank").collect()
    assert hits[0].id == "case_001"
    assert K.read_jsonl(spark, f"{p}/none.jsonl", "a string").count() == 0 and K.training_records(spark, f"{p}/zz*.jsonl").count() == 0
    assert [r.title for r in K.read_jsonl(spark, f"{p}/b_training_records.jsonl", "title string").collect()] == ["Panduan demam", "Teh jahe"]


def test_topics_and_sections(spark, tmp_path):
    (tmp_path / "t.xml").write_text('<health-topics><health-topic id="1" title="Fever" language="English" url="u"><full-summary>x</full-summary><group>Symptoms</group><group>日本</group><related-topic>a</related-topic></health-topic><health-topic id="2" title="Fever shots" language="English"><group>Symptoms</group></health-topic><health-topic id="3" title="Fiebre" language="Spanish"><group>Symptoms</group></health-topic></health-topics>')
    got = K.topics(spark, str(tmp_path / "t.xml"), ["Symptoms"], ["shots"]).collect()
    assert [(r.id, r.groups, r.related) for r in got] == [("1", ["Symptoms"], ["a"])]
    d = spark.createDataFrame([("d", ["Hello", "Gejala:", "demam", "batuk", "Pencegahan umum", "cuci"])], "path string, paragraphs array<string>")
    assert {r.heading: r.body for r in K.doc_sections(d, ["gejala", "pencegahan"]).collect()} == {"intro": ["Hello"], "gejala": ["demam", "batuk"], "pencegahan": ["cuci"]}
    f = K.fetched(spark.createDataFrame([("u", "<title>T</title><p>" + "word " * 20), ("v", None)], "url string, html string")).collect()
    assert [(r.status, r.title) for r in f] == [("fetched", "T"), ("fetch_failed", "")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", ["x", "y"], None)], "id string, l array<string>, n int")
    sinks.append_jsonl(df, str(tmp_path / "log"))
    sinks.append_jsonl(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2 and '"n":null' in "".join(f.read_text() for f in (tmp_path / "log").glob("part*"))
    sinks.write_jsonl(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 1
    assert sinks.write_csv(sinks.flat_lists(df), str(tmp_path / "csv")) and not sinks.write_csv(df.limit(0), str(tmp_path / "none"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).first().l == "x | y"
    sinks.manifest(df.agg(F.count("*").alias("rows")), str(tmp_path / "m"))
    v = spark.createDataFrame([("a", 1), ("b", 1)], "id string, v int")
    sinks.upsert_vectors(v, str(tmp_path / "vec"))
    sinks.upsert_vectors(spark.createDataFrame([("b", 2), ("c", 2)], "id string, v int"), str(tmp_path / "vec"))
    got = lambda: {(r.id, r.v) for r in sinks.read_vectors(spark, str(tmp_path / "vec")).collect()}
    assert got() == {("a", 1), ("b", 2), ("c", 2)} and sinks.read_vectors(spark, str(tmp_path / "none2")) is None


def _table(spark, path):
    return {(r.id, r.v) for r in sinks.read_vectors(spark, path).collect()}


def test_upserts_rewrite_touched_buckets_alone(spark, tmp_path):
    path = f"file://{tmp_path}/vec"
    frame = lambda rows: spark.createDataFrame(rows, "id string, v int")
    assert sinks.read_vectors(spark, path) is None
    sinks.upsert_vectors(frame([(f"k{i}", i) for i in range(200)]), path, buckets=16)
    files = lambda: {p.name for p in (tmp_path / "vec").rglob("part-*.parquet")}
    named = lambda: set(sinks._manifest(spark, path)[1]["folders"].values())
    before, first = named(), files()
    # repeated keys: the greatest row counts; rows without key are left out
    sinks.upsert_vectors(frame([("k3", -5), ("k3", 900), ("k3", None), (None, 1), (None, 2)]), path)
    want = {(f"k{i}", i) for i in range(200)} - {("k3", 3)} | {("k3", 900)}
    assert _table(spark, path) == want and len(before & named()) == 15 and first <= files()
    sinks.upsert_vectors(frame([]), path)
    sinks.upsert_vectors(frame([("new", 1)]), path)
    assert _table(spark, path) == want | {("new", 1)}
    # what only older manifests named is gone, and a crash before the manifest leaves nothing to be seen
    assert sorted(p.name for p in (tmp_path / "vec").glob("manifest-*")) == ["manifest-3.json", "manifest-4.json"]
    (tmp_path / "vec" / "data-broken").mkdir()
    assert _table(spark, path) == want | {("new", 1)}


def test_two_writers_lose_no_rows(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/vec"
    frame = lambda rows: spark.createDataFrame(rows, "id string, v int")
    sinks.upsert_vectors(frame([("a", 1), ("b", 1)]), path, buckets=1)
    commit, other = sinks._commit, []

    def late(*given):
        if not other:  # another writer is done between this one's reading and its commit
            other.append(1)
            sinks.upsert_vectors(frame([("b", 2), ("c", 2)]), path)
        return commit(*given)

    monkeypatch.setattr(sinks, "_commit", late)
    sinks.upsert_vectors(frame([("a", 3), ("d", 3)]), path)
    assert _table(spark, path) == {("a", 3), ("b", 2), ("c", 2), ("d", 3)}


def test_lines_of_a_file_that_many_tasks_read(spark, tmp_path):
    lines = [json.dumps({"title": f"t{i}"}) if i % 7 else ["", "  ", "no json", '{"id": "given", "title": "t"}'][i % 4] for i in range(900)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a b+c.jsonl").write_text("\r\n".join(lines))
    (tmp_path / "in" / "b.jsonl").write_text("\n".join(lines[:50]) + "\n")
    was = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in was:
            spark.conf.set(k, "600b")
        got = K.training_records(spark, f"file://{tmp_path}/in/*.jsonl")
        tasks = spark.read.text(f"file://{tmp_path}/in").rdd.getNumPartitions()
        rows = got.orderBy("ord").select("ord", "id", "title").collect()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    want = []
    for name, some in (("a b+c", lines), ("b", lines[:50])):
        for i, line in enumerate(some):
            if line.strip() and line != "no json":
                want.append((len(want) + 1, json.loads(line).get("id", f"{name}_{i + 1:04d}"), json.loads(line)["title"]))
    assert tasks > 20 and [tuple(r) for r in rows] == want


def test_workbook(spark, tmp_path, monkeypatch):
    import xml.etree.ElementTree as ET
    import zipfile

    monkeypatch.setattr(sinks, "_ROWS", 3)
    monkeypatch.setattr(sinks, "_CELL", 10)
    a = spark.createDataFrame([(i, f"<{i}> & \x01 text that is long", i / 4, i % 2 == 0, ["x", "y"]) for i in range(5)], "n int, t string, d double, b boolean, l array<string>").coalesce(1)
    sinks.workbook({"turns": a, "empty": a.limit(0).select("n")}, str(tmp_path / "w.xlsx"))
    with zipfile.ZipFile(tmp_path / "w.xlsx") as z:
        names = [s.get("name") for s in ET.fromstring(z.read("xl/workbook.xml")).iter() if s.tag.endswith("}sheet")]
        assert names == ["turns", "turns_2", "empty"]
        rows = [[["".join(c.itertext()) for c in r] for r in ET.fromstring(z.read(f"xl/worksheets/sheet{i}.xml")).iter() if r.tag.endswith("}row")] for i in (1, 2, 3)]
    assert rows[2] == [["n"]] and [len(r) for r in rows] == [4, 3, 1]
    head = rows[0][0]
    assert head == rows[1][0] == ["n", "t", "t_2", "t_3", "d", "b", "l"]
    got = [dict(zip(head, r)) for r in rows[0][1:] + rows[1][1:]]
    assert [g["t"] + g["t_2"] + g["t_3"] for g in got] == [f"<{i}> &  text that is long" for i in range(5)]
    assert [(g["n"], g["d"], g["b"], g["l"]) for g in got] == [(str(i), repr(i / 4), str(int(i % 2 == 0)), '["x","y"]') for i in range(5)]


class Remote:
    """A session on a cluster, without spark.checkpoint.dir."""

    class conf:
        get = staticmethod(lambda name, default=None: default)

    class sparkContext:
        master, applicationId = "spark://somewhere:7077", "remote"


def test_a_cluster_needs_a_shared_folder():
    import pytest

    from quillspark.plans.session import shared_root

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_root(Remote)
