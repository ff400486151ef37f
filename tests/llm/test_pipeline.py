import corpus_pipeline
from pyspark.sql import functions as F

from quillspark.llm import sharding
from quillspark.llm.common import LOWER, Forest

SF = "/root/testdata/sf0.001"


def sets(text):
    w = (text or "").encode().translate(LOWER).split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "neardup", "decontamination", "mixing", "sharding"]
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in kept.collect()}
        kept = stage(spark, kept, SF).cache()
        after = {r.doc_id: r for r in kept.collect()}
        assert set(after) <= set(before) and len(after) == kept.count()
        assert all(after[d][:5] == before[d][:5] for d in after)
        if name != "sharding":
            assert kept.columns == docs.columns
        if name == "quality":
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            good = [d for d, q in labels.items() if q == 1]
            bad = [d for d, q in labels.items() if q == 0]
            assert sum(d in after for d in good) / len(good) > 0.97 and sum(d in after for d in bad) / len(bad) < 0.2
        if name == "neardup":
            f, all_ = Forest(), [(d, sets(r.text)) for d, r in before.items()]
            for i, (a, x) in enumerate(all_):
                for b, y in all_[:i]:
                    if x and y and 100 * len(x & y) >= 80 * len(x | y):
                        f.join(a, b)
            assert set(after) == {d for d in before if f.root(d) == d}
        if name == "decontamination":
            items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert not any(t in r.text for r in after.values() for t in items)
        if name == "sharding":
            table = sharding.lookup_table(sharding.SHARDS, sharding.SLOTS)
            assert set(after) == set(before) and all(r.shard == table[r.slot] for r in after.values())


def test_run_is_the_stages_together(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "slot", "shard"] and out.count() > 0
    assert out.groupBy("doc_id").count().where(F.col("count") > 1).count() == 0


def test_stages_take_nulls_empty_tables_and_clashing_columns(spark):
    """Null ids, texts, sources and languages, rows that occur twice, no rows at all, and columns that the stages' own names clash with."""
    names = ["score", "kept", "n_words", "hit_runs", "topic", "weight", "sampled", "quality", "component_id"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(None, "a text without id " * 9, "en", "src0", 1), (900_001, None, "en", "src0", 0), (900_002, "", None, None, None), (900_003, "x", None, "src1", 1)], docs.schema)
    docs = docs.unionByName(odd).unionByName(docs.limit(5)).select("*", *[F.concat(F.lit(n), F.coalesce("n_chars", F.lit(0)).cast("string")).alias(n) for n in names])
    for rows in (docs, docs.limit(0)):
        kept = rows
        for name, stage in corpus_pipeline.STAGES:
            kept = stage(spark, kept, SF)
            assert kept.columns == docs.columns + (["slot", "shard"] if name == "sharding" else [])
        out = kept.collect()
        assert all(r[n] == f"{n}{r.n_chars or 0}" for r in out for n in names) and (len(out) > 5) == (rows is docs)


def test_a_cluster_needs_a_shared_folder():
    import pytest

    from quillspark.llm import common
    from tests.test_sources import Remote

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.scratch_dir(Remote)
