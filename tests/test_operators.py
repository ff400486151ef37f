import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspark.functions import phrases
from quillspark.operators import curate, dialogue, retrieval, split
from quillspark.operators.components import connected, grown
from quillspark.plans.session import stored


def brute_tfidf(docs, queries, k):
    counts = {d: Counter(t.split()) for d, t in docs}
    df = Counter(w for c in counts.values() for w in c)
    idf = {w: math.log((1 + len(docs)) / (1 + n)) + 1 for w, n in df.items()}
    vec = lambda c: {w: (0.5 + 0.5 * n / max(c.values())) * idf.get(w, 1.0) for w, n in c.items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    out = {}
    for q, t in queries:
        a, hits = vec(Counter(t.split())), []
        for d, c in counts.items():
            b = vec(c)
            s = sum(x * b.get(w, 0) for w, x in a.items())
            if s > 0:
                hits.append((-round(s / norm(a) / norm(b), 4), d))
        out[q] = [(d, -s) for s, d in sorted(hits)[:k]]
    return out


def test_tfidf_search(spark):
    docs = [(1, "alpha beta beta"), (2, "alpha gamma"), (3, "delta delta"), (4, ""), (5, "beta gamma alpha")]
    queries = [(10, "alpha beta unknown"), (11, "delta"), (12, "nothing"), (13, "")]
    index = retrieval.TfidfIndex(spark.createDataFrame(docs, "id long, text string"))
    got = {}
    for r in index.search(spark.createDataFrame(queries, "query long, text string"), 2).orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append((r.id, pytest.approx(r.score, abs=1e-4)))
    want = {q: h for q, h in brute_tfidf([(d, t) for d, t in docs if t], queries[:3], 2).items() if h}
    # document 4 has no terms but counts among the documents
    assert set(got) == {10, 11} and [x[0] for x in got[10]] == [x[0] for x in want[10]] and got[11][0][0] == 3


def test_hash_embedding_is_a_unit_vector(spark):
    df = spark.createDataFrame([(["ab", "cd"],), ([],), (["ab"],)], "t array<string>")
    v = [r.v for r in df.select(retrieval.hash_embedding("t").alias("v")).collect()]
    assert sum(x * x for x in v[0]) == pytest.approx(1) and not any(v[1]) and len(v[2]) == 384 and sum(x != 0 for x in v[0]) == 3


def test_vector_topk_clamps_and_keeps_zeros(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0])], "id long, embedding array<double>")
    q = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 0.0])], "query long, embedding array<double>")
    got = retrieval.vector_topk(v, q, 3).orderBy("query", "rank").collect()
    assert [(r.query, r.key, r.score) for r in got] == [(7, 1, 1.0), (7, 2, 0.0), (7, 3, 0.0)]
    assert retrieval.vector_topk(v, q.limit(0), 3).count() == 0


def test_rerank_filters_after_the_limit(spark):
    hits = spark.createDataFrame([(1, "a", 0.5, 1, "x", "case"), (1, "b", 0.4, 2, "x", "herb"), (1, "c", 0.3, 3, "x", "herb"), (1, "d", 0.1, 4, "y", "herb")], "query int, id string, score double, rank int, dup string, type string")
    got = retrieval.rerank(hits, [retrieval.Boost(F.col("id") == "c", 0.2), retrieval.Boost(F.lit(None).cast("boolean"), 9.0)], keep=F.col("type") == "herb", dedupe=F.col("dup"), k=5).orderBy("rank").collect()
    assert [(r.id, r.score, r.rank) for r in got] == [("c", 0.5, 1), ("d", 0.1, 2)]


def test_append_missing(spark):
    found = spark.createDataFrame([("a", 0.5)], "id string, score double")
    got = retrieval.append_missing(found, spark.createDataFrame([("a",), ("b",)], "id string"), ["id"]).collect()
    assert sorted((r.id, r.score) for r in got) == [("a", 0.5), ("b", 0.85)]


def chat(*pairs):
    return [{"role": r, "content": c} for r, c in pairs]


SFT = "id string, source_record_id string, messages array<struct<role:string,content:string>>, index long"


def test_leakage_keys(spark):
    rows = [("medlineplus_12_a", None, chat(("user", "U"), ("assistant", "A")), 0), ("sft_anam_7", " ", chat(("user", "u ")), 1), ("rag_1", None, chat(("user", "U")), 2), ("x", "rec", [], 3), (None, None, [], 4)]
    got = [r.k for r in spark.createDataFrame(rows, SFT).orderBy("index").select(split.leakage_keys("id", "source_record_id", "messages", "index").alias("k")).collect()]
    assert [k[0] for k in got][:2] == ["medlineplus_topic:12", "anamnesis_case:7"] and got[2][0] == "rag_user:" + got[0][2].split(":")[1] and got[1][1] == got[0][2]
    assert got[3] == ["source_record:rec"] and got[4] == ["row_id:4"]


def test_components_with_a_hub(spark):
    pairs = [(i, f"a{i // 3}") for i in range(60)] + [(i, "hub") for i in range(0, 60, 10)] + [(100 + i, f"c{i}") for i in range(40)] + [(101 + i, f"c{i}") for i in range(40)] + [(500, None)]
    parent = {}
    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    seen = {}
    for row, key in pairs:
        if key is not None:
            a, b = root(seen.setdefault(key, row)), root(row)
            parent[max(a, b)] = min(a, b)
    got = split.key_components(spark.createDataFrame(pairs, "row_id long, key string")).collect()
    # the row whose key is null is a component of its own
    assert {r.row_id: r.component for r in got} == {x: root(x) for x in parent} | {500: 500}


def test_components_grow_by_batches(spark):
    rng = random.Random(2)
    links = [(f"n{rng.randrange(400)}", f"n{rng.randrange(400)}") for _ in range(260)] + [("x", "x"), (None, "y"), ("z", None)]
    frame = lambda rows: spark.createDataFrame(rows, "a string, b string")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    labels = connected(frame(links[:150]))
    for i in (150, 200, 240):
        labels = grown(stored(labels), frame(links[i : i + (50 if i == 150 else 40)]))
    assert rows(labels) == rows(connected(frame(links)))
    assert connected(frame([])).count() == 0 and rows(grown(connected(frame([])), frame(links[:20]))) == rows(connected(frame(links[:20])))


def test_group_split_fills_whole_groups(spark):
    rows = spark.createDataFrame([(i, i // (1 + i % 7)) for i in range(700)], "i long, g long")
    got = split.group_split(rows, "g").collect()
    by = {}
    for r in got:
        by.setdefault(r.g, set()).add(r.split)
    sizes = Counter(r.split for r in got)
    assert len(got) == 700 and all(len(s) == 1 for s in by.values()) and sizes["valid"] >= 56 and sizes["test"] >= 56 and sizes["train"] > 500


def test_prepare_has_no_leakage(spark):
    rows = [(f"r{i}", None, chat(("user", f"u{i % 90}"), ("assistant", f" a{i // 2} ")), i) for i in range(180)] + [("bad", None, chat(("user", "x")), 999)]
    data, audit = split.prepare(spark.createDataFrame(rows, SFT), "index")
    assert data.count() == 180 and data.where(F.get("messages", 1)["content"].rlike(r"^\s|\s$")).count() == 0
    r = audit.first()
    assert r.assistant_cross_split_duplicate_groups == r.user_cross_split_duplicate_groups == r.group_leakage_count == 0 and r.total_groups == 180
    leaky = split.split_audit(spark.createDataFrame([("g", "train", "T"), ("g", "test", "t ")], "group string, split string, text string"), "group", {"text": "text"}).first()
    assert (leaky.group_leakage_count, leaky.text_cross_split_duplicate_groups) == (1, 1)


def test_log_to_chat(spark):
    log = [("1", "follow_up", " a  b ", "", "r", 1), ("2", "follow_up", "A b", "R", "", 2), ("3", "other", "x", "y", "", 3), ("4", "follow_up", "", "y", "", 4), (None, "follow_up", "q", "base", "sel", 5)]
    got = split.log_to_chat(spark.createDataFrame(log, "id string, response_type string, user_message string, baseline_reply string, selected_reply string, ord long"), ["follow_up"], "S").orderBy("id").collect()
    assert [r.id for r in got] == ["rag_1", "rag_5"] and got[1].messages[2].content.startswith("base\n\nInformasi") and got[0].messages[1].content == "a b"


def test_entity_merge_and_evidence(spark):
    rows = [(2, "Z o", "", "t2", ["A"], "x", "low"), (1, "z-O", "n1", "t1", ["a", "b"], "y", ""), (3, "other", "n3", "t1", [], "y", "high")]
    df = spark.createDataFrame(rows, "ord int, name string, latin string, txt string, parts array<string>, alias string, level string")
    got = {r.merge_key: r for r in curate.merge_entities(df, curate.normalize_key("name"), "ord", ["latin"], ["txt"], ["parts"], ["alias"], "level").collect()}
    r = got["z_o"]
    assert (r.latin, r.txt, r.parts, r.alias, r.level) == ("n1", "t1 t2", ["a", "b"], ["x", "y"], "low") and got["other"].level == "high"


def test_entity_merge_of_a_large_group(spark):
    import time

    n = F.col("id")
    rows = spark.range(20_000).select(n.alias("ord"), F.lit("k").alias("name"), F.concat(F.lit("t"), ((n + 1) % 3).cast("string")).alias("txt"), F.array(F.concat(F.lit(" P"), (n % 5).cast("string")), F.concat(F.lit("p"), (n % 7).cast("string"))).alias("parts"))
    at = time.time()
    r = curate.merge_entities(rows, F.col("name"), "ord", joined=["txt"], lists=["parts"]).first()
    assert (r.txt, r.parts) == ("t1 t2 t0", ["P0", "P1", "P2", "P3", "P4", "p5", "p6"]) and time.time() - at < 60


def test_entity_merge_keeps_null_keys_and_empty_groups(spark):
    rows = spark.createDataFrame([(1, None, " a ", ["x"]), (2, None, "b", None), (3, "k", " ", [" ", None])], "ord int, name string, txt string, parts array<string>")
    got = {r.merge_key: (r.txt, r.parts, r.ord) for r in curate.merge_entities(rows, F.col("name"), "ord", joined=["txt"], lists=["parts"]).collect()}
    assert got == {None: ("a b", ["x"], 1), "k": ("", [], 3)}


def test_joins_and_orders(spark):
    rows = spark.createDataFrame([("1", "Jahe", ""), ("2", "Kunyit", "k")], "id string, name string, note string")
    legacy = spark.createDataFrame([("1", "old", "o"), ("9", "nine", "n")], "id string, name string, note string")
    assert sorted(tuple(r) for r in curate.with_legacy(rows, legacy, "id", ["note"]).collect()) == [("1", "Jahe", "o"), ("2", "Kunyit", "k"), ("9", "nine", "n")]
    over = spark.createDataFrame([("jahe", "first", 1), ("JAHE", "last", 2)], "key string, steps string, ord int")
    assert {r.id: r.steps for r in curate.with_overrides(rows, over, ["name", "note"], "steps", F.lit("std"), "ord").collect()} == {"1": "last", "2": "std"}
    src = spark.createDataFrame([("a", "A", "u1"), ("b", "B", "u2")], "source_key string, title string, url string")
    rec = spark.createDataFrame([("r", ["b", "a"])], "id string, source_keys array<string>")
    assert curate.collect_sources(rec, src).first().source_titles == ["B", "A"]
    assert [r.id for r in curate.numbered(spark.range(30).select((30 - F.col("id")).alias("n")), ["n"], "id", "x_%03d", 5).orderBy("n").collect()] == [f"x_{i:03d}" for i in range(1, 31)]
    assert [r.id for r in curate.first_name_in(spark.createDataFrame([(1, "teh jahe madu")], "id int, text string"), spark.createDataFrame([("madu", 2), ("jahe", 1)], "name string, ord int"), "text", "name", "ord").collect()] == [1]
    assert curate.expand(rows, spark.createDataFrame([(1,), (2,)], "v int")).count() == 4
    cases = spark.createDataFrame([("c1",)], "case_id string")
    an = spark.createDataFrame([("x", ["c1", "c2"]), ("y", []), ("z", None)], "id string, applicable_case_ids array<string>")
    assert [r.id for r in curate.applicable(an, cases).collect()] == ["x"]


def test_small_curation_functions(one, spark):
    assert one(curate.rotate("v", F.lit(1)), v=["a", "b", "c"]) == ["b", "c", "a"] and one(curate.rotate("v", F.lit(5)), v=[]) == []
    assert one(curate.pick("v", F.lit(4)), v=["a", "b", "c"]) == "b"
    assert one(curate.safety_note("a", "b", "c"), a="x", b="x") == "x c"
    assert one(curate.topic_facts("v", {"fever|hot": "demam"}, F.lit("g"), {"g": ["demam", "z"]}), v="Hot day") == ["demam", "z"]
    assert [r.title for r in one(curate.supplemental_references("v", {"tea": ("T", "u")}), v="Green TEA")] == ["T"]
    assert one(curate.localized(["v"], {"ginger": "jahe"}, F.lit("x")), v=" Ginger ") == "jahe" and one(curate.label_of("v", {"a": "A"}), v="q") == "q"
    long = "cuci jahe lalu rebus selama sepuluh menit dengan air bersih secukupnya"
    ctx = spark.createDataFrame([("pendek", "Jahe madu", [("madu jahe", long), ("kunyit", long * 3), ("jahe madu", long + " saja")])], "p string, n string, c array<struct<name:string,preparation:string>>")
    assert ctx.select(curate.better_preparation("p", "n", "c")).first()[0] == long


def test_dialogue(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "A!"), (1, 2, "assistant", "why?"), (1, 3, "user", "b"), (1, 4, "assistant", "ok?"), (2, 0, "user", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert dialogue.without_repeats(df).count() == 5 and {(r.conv_id, r.turn) for r in dialogue.last_turns(df, 2).collect()} == {(1, 3), (1, 4), (2, 0)}
    assert {r.turn: r.running_text for r in dialogue.running_text(df.where("conv_id = 1")).collect()}[3] == "a\nA!\nb"
    assert [r.asked for r in dialogue.question_counts(df.where("conv_id = 1")).orderBy("turn").collect()] == [0, 0, 0, 1, 1]
    s = {r.conv_id: r for r in dialogue.conversation_summary(df).collect()}
    assert (s[1].turns, s[1].questions, s[1].last_user_text) == (5, 2, "b")


def test_sessions(spark, one):
    schema = "session_id string, turns array<struct<role:string,content:string>>, question_count int, suspected_conditions array<string>"
    server = spark.createDataFrame([("a", [], 0, []), ("b", chat(("user", "x")), 2, ["q"]), ("c", None, 1, [])], schema)
    client = spark.createDataFrame([("a", chat(("bot", "hi"), ("user", " ")), -3, list("wxyz")), ("b", chat(("user", "other")), 9, [])], schema)
    got = {r.session_id: r for r in dialogue.synced(server, client).collect()}
    assert [(t.role, t.content) for t in got["a"].turns] == [("assistant", "hi")] and got["a"].question_count == 0 and got["a"].suspected_conditions == list("wxy")
    assert got["b"].question_count == 2 and got["c"].question_count == 1
    assert dialogue.cleared(server, client.select("session_id")).count() == 1
    assert one(dialogue.remember("v", F.lit("n"), 3), v=["a", "b", "c"]) == ["b", "c", "n"] and one(dialogue.remember("v", F.lit("a")), v=["a"]) == ["a"]


def test_recommendation_and_exports(spark):
    a = "struct<recommended_herbal_name:string,preparation:string,dosage:string,warning_notes:string,source_hint:string>"
    c = "struct<keluhan_ringan:string,ramuan:string,cara_pengolahan:string,dosis_penggunaan:string,catatan_kewaspadaan:string,sumber_ringkas:string>"
    df = spark.createDataFrame([(("", "p", "", "", ""), ("k", "teh", "x", "y", "", "s")), (("", "", "", "", ""), None)], f"a {a}, c {c}")
    r = [x.r for x in df.select(dialogue.recommendation("a", "c", {"catatan_kewaspadaan": "hati-hati"}).alias("r")).collect()]
    assert (r[0].ramuan, r[0].cara_pengolahan, r[0].dosis_penggunaan, r[0].catatan_kewaspadaan) == ("teh", "p", "y", "hati-hati") and r[1] is None
    cand = spark.createDataFrame([("q", "ok", 0.5, 1), ("q", "ok", 0.5, 0), ("q", "error", 0.9, 2)], "request string, status string, score double, model_ord int")
    assert [x.model_ord for x in dialogue.best_candidate(cand, ["request"]).collect()] == [0]


def test_synced_keeps_sessions_of_the_client_alone(spark):
    kind = "session_id string, turns array<struct<role:string,content:string>>, question_count int, suspected_conditions array<string>"
    server = spark.createDataFrame([("s", [("user", "hi")], 2, ["a"]), ("e", [], 0, [])], kind)
    client = spark.createDataFrame([("c", [("bot", "yo"), ("user", " ")], -3, ["p", "q", "r", "t"]), ("e", [("user", "x")], 1, ["b"])], kind)
    got = {r.session_id: ([tuple(t) for t in r.turns], r.question_count, r.suspected_conditions) for r in dialogue.synced(server, client).collect()}
    assert got == {"s": ([("user", "hi")], 2, ["a"]), "e": ([("user", "x")], 1, ["b"]), "c": ([("assistant", "yo")], 0, ["p", "q", "r"])}
    assert dialogue.synced(server.limit(0), client).count() == 2 and dialogue.synced(server, client.limit(0)).count() == 2


def test_group_split_keeps_rows_without_group(spark):
    rows = spark.createDataFrame([(i, None if i % 20 == 3 else f"g{i % 7}") for i in range(80)], "i int, g string")
    got = split.group_split(rows, "g").collect()
    assert sorted(r.i for r in got) == list(range(80)) and len({r.split for r in got if r.g is None}) == 1


def test_vector_topk_leaves_out_unusable_vectors(spark, monkeypatch):
    inf, nan = float("inf"), float("nan")
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [1.0, None]), (6, [inf, 1.0]), (7, [1.0, 1.0, 1.0]), (8, []), (None, [1.0, 0.0]), (9, [1e200, 1e200])], "id long, embedding array<double>")
    q = spark.createDataFrame([(10, [1.0, 0.0]), (11, None), (12, [nan, 1.0]), (13, [2.0, 2.0, 2.0]), (14, [0.0, 1e-200])], "query long, embedding array<double>")
    want = {(10, 1, 1.0), (10, 9, 0.7071), (13, 7, 1.0), (14, 1, 0.0), (14, 9, 0.7071)}
    assert {(r.query, r.id if "id" in r else r.key, r.score) for r in retrieval.vector_topk(v, q, 5).collect()} == want
    monkeypatch.setattr(retrieval, "MAX_QUERY_NUMBERS", 2)
    assert {(r.query, r.key, r.score) for r in retrieval.vector_topk(v, q, 5).collect()} == want


def test_first_name_in_any_number_of_names(spark, monkeypatch):
    rows = [(1, "teh JAHE dan madu"), (1, "teh JAHE dan madu"), (None, "kunyit"), (3, None), (4, "kunyit"), (5, "ab"), (6, "nothing")]
    names = [(1, "kunyit"), (2, "madu"), (3, "jahe"), (4, "ab"), (5, "madu"), (6, ""), (7, None), (0, "zz")] + [(100 + i, f"name{i}") for i in range(3000)]
    want = [(None, "kunyit", 1), (1, "madu", 2), (1, "madu", 2), (4, "kunyit", 1), (5, "ab", 4)]
    for most in (500_000, 7):
        monkeypatch.setattr(phrases, "MAX_PHRASES", most)
        some = names if most > 7 else names[:20]
        got = curate.first_name_in(spark.createDataFrame(rows, "id int, text string"), spark.createDataFrame(some, "o int, name string"), "text", "name", "o")
        assert sorted(((r.id, r.name, r.o) for r in got.collect()), key=lambda r: (r[0] is not None, r)) == want


def test_all_phrases_by_one_automaton(spark):
    known = [(i, p) for i, p in enumerate(("he", "she", "hers", "his", "ers", "x"))]
    automata = phrases.automaton(spark.createDataFrame(known, "n int, p string"), "p", "n")
    got = phrases.all_of(spark.createDataFrame([("ushers",), ("",), (None,), ("this he",)], "t string"), F.col("t"), automata, "found").collect()
    assert [r.found for r in got] == [[0, 1, 2, 4], [], None, [0, 3]]


