"""Table functions in lateral joins."""

from quillspark.functions import tables


def test_parts_of_texts(spark):
    rows = spark.createDataFrame([(1, "<p>One &amp; two<ul><li>x <b>y</b><li>z</ul>"), (2, None), (3, ""), (4, "plain")], "id int, t string")
    got = tables.parts(rows, "fragments", "r.t").orderBy("id", "kind", "number").collect()
    assert [tuple(r)[0:1] + tuple(r)[2:] for r in got] == [(1, "li", 1, "x y"), (1, "li", 2, "z"), (1, "p", 1, "One & two")]
    long = spark.createDataFrame([(1, "Intro\nAloe\n\nDefinition of aloe\nmore\nBasil \n \nDefinition\nb"), (2, "none"), (3, None)], "id int, t string")
    got = tables.parts(long, "monographs", "r.t").select("id", "number", "title", "body").orderBy("number").collect()
    assert [(r.id, r.number, r.title) for r in got] == [(1, 1, "Aloe"), (1, 2, "Basil")] and got[0].body.endswith("more")
    text = spark.createDataFrame([(1, "start\nGejala:\n a  b\n\nc\nPencegahan umum\nd\ngejala\ne"), (2, None)], "id int, t string")
    got = tables.parts(text, "sections", "r.t", "'gejala|pencegahan'").select("heading", "number", "line").collect()
    assert sorted(map(tuple, got)) == [("gejala", 1, "a b"), ("gejala", 2, "c"), ("gejala", 3, "e"), ("intro", 1, "start"), ("pencegahan", 1, "d")]


def test_tables_are_known_to_sql(spark):
    tables.register(spark)
    assert [r.title for r in spark.sql("SELECT title FROM monographs('A\n\nDefinition x')").collect()] == ["A"]
