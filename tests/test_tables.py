"""Dictionaries, entities, exports, segments, vectors and metrics."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tsumugi.operators import entities as en
from tsumugi.operators import exports as ex
from tsumugi.operators import metrics as me
from tsumugi.operators import segments as se
from tsumugi.operators import vectors as ve
from tsumugi.operators import words as wo
from tsumugi.runtime import numbered


def test_user_lines(spark):
    lines = ["東京,トウキョウ,トウキョウ,100", "　x , a ,b, 50 ,名詞,固有名詞,組織", "incomplete,data", "x,a,b,99999", "# no", "", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "n int, line string")
    rows = {r.n: r for r in wo.parse_lines(df).collect()}
    assert rows[0].cost == 100 and rows[0].pos == wo.DEFAULT_POS and rows[1].surface == "x" and rows[1].pos == "名詞,固有名詞,組織"
    assert rows[2].error == "too few fields" and rows[3].error == "invalid cost" and set(rows) == {0, 1, 2, 3}
    assert tuple(wo.validation_counts(wo.parse_lines(df)).first()) == (2, 2)


def test_user_lines_with_line_breaks_are_invalid(spark, tmp_path):
    from tsumugi.plans import words as plans

    rows = [(1, "user", '"東\n京",ア,ア,5'), (2, "user", "東,ア,ア,5"), (3, "source", "x\ny"), (4, "user", "京,ア,ア,6\n")]
    spark.createDataFrame(rows, "row_id long, kind string, line string").write.parquet(f"{tmp_path}/dict_lines.parquet")
    assert {r.row_id: r.error for r in plans.userdict_parse(spark, str(tmp_path)).collect()} == {1: "line break", 2: None, 4: None}
    assert tuple(plans.userdict_validation(spark, str(tmp_path)).first()) == (2, 1)


def test_user_dictionary(spark):
    schema = "ord int, surface string, reading string, pronunciation string, cost int, pos string"
    a = spark.createDataFrame([(1, "東", "ア", "ア", 5, "名詞"), (2, "東", None, None, 9, "名詞")], schema)
    b = spark.createDataFrame([(3, "東", "x", "x", 1, "名詞"), (4, "京", "y", "y", 2, "名詞"), (5, "京", "z", "z", 3, "名詞")], schema)
    assert sorted(r.ord for r in wo.merge(a, b, "ord").collect()) == [1, 2, 4]
    s = wo.statistics(a).first()
    assert (s.n_entries, s.n_surfaces, s.avg_cost, s.total_chars, s.avg_surface_len) == (2, 1, 7.0, 2, 1.0)
    assert wo.statistics(a.limit(0)).first().avg_surface_len == 0.0
    assert wo.find(a, "東").count() == 2 and wo.find_by_prefix(b, "京").count() == 2 and wo.remove(b, "京").count() == 1
    formats = a.where("ord = 1").select(wo.as_csv().alias("c"), wo.as_dictionary_line().alias("d"), wo.as_json().alias("j")).first()
    assert formats.c == "東,ア,ア,5,名詞" and formats.d == "東,0,0,5,名詞,ア" and json.loads(formats.j)["cost"] == 5
    assert wo.to_overlay(a).where("layer = 0").count() == 2


def test_user_entries_without_some_members_keep_their_columns(spark, tmp_path):
    from tsumugi.plans import words as plans

    schema = "entry_id long, surface string, reading string, pronunciation string, cost int, pos string, dict_name string"
    rows = [(1, "東", "ア", "イ", 5, "名詞", "d"), (2, "京", None, None, None, None, "d"), (3, "都", "ト", None, 7, "名詞", "d"), (4, "府", "フ", "フ", 8, None, "d")]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/user_entries.parquet")
    got = {r.entry_id: r for r in plans.userdict_formats(spark, str(tmp_path)).collect()}
    pos = wo.DEFAULT_POS
    assert {i: r.csv for i, r in got.items()} == {1: "東,ア,イ,5,名詞", 2: f"京,,,0,{pos}", 3: "都,ト,,7,名詞", 4: f"府,フ,フ,8,{pos}"}
    assert {i: r.line for i, r in got.items()} == {1: "東,0,0,5,名詞,ア", 2: f"京,0,0,0,{pos},", 3: "都,0,0,7,名詞,ト", 4: f"府,0,0,8,{pos},フ"}
    assert json.loads(got[2].json) == {"surface": "京", "reading": "", "pronunciation": "", "cost": 0, "pos": pos}
    overlay = {r.surface: (r.n, r.least_cost, r.feature) for r in plans.overlay_entries(spark, str(tmp_path)).collect()}
    assert overlay == {"東": (1, 5, "名詞,ア,イ"), "京": (1, 0, f"{pos},*,*"), "都": (1, 7, "名詞,ト,*"), "府": (1, 8, f"{pos},フ,フ")}


def test_entities(spark):
    n = spark.createDataFrame([(0,), (50,), (150,)], "n int")
    assert [round(r.p, 3) for r in n.select(en.popularity(F.col("n")).alias("p")).collect()] == [0.1, 0.6, 1.0]
    flat = spark.createDataFrame([("Q1490", "label", "ja", 0, "東京"), ("Q1490", "alias", "ja", 0, "東京都"), ("Q1490", "alias", "ja", 1, "東京"), ("Q1490", "sitelink", "jawiki", 0, "t"), ("Q2", "label", "en", 0, "x")], "entity_id string, kind string, map_key string, ord_no int, leaf_value string")
    kb = en.knowledge_base(flat)
    assert {(r.surface, round(r.confidence, 2)) for r in kb.collect()} == {("東京", 0.11), ("東京都", 0.11)}
    wd, dbr = "http://www.wikidata.org/entity/", "http://dbpedia.org/resource/"
    c = spark.createDataFrame([(1, "t", wd + "a", 0.7), (2, "t", "c:b", 0.8), (3, "t", dbr + "c", 0.5), (4, "t", wd + "a", 0.9)], "ord int, surface string, uri string, confidence float")
    first = en.dedupe_candidates(c, ["ord"])
    assert first.count() == 3 and tuple(en.index_size(first).first()) == (1, 3)
    win = lambda s, **o: en.disambiguate(first, ["surface"], s, "ord", **o).orderBy("rank_no").first().uri
    assert win("highest") == "c:b" and win("prior") == wd + "a" and win("context", resolved=[dbr + "c"]) == "c:b" and win("context", resolved=[wd + "a"]) == wd + "a"
    assert en.disambiguate(first, ["surface"], "none", "ord").count() == 3
    merged = {r.surface: (r.n_candidates, r.uris) for r in en.merge_candidates(spark.createDataFrame([(1, "t"), (2, "u")], "entry_id int, surface string"), first, 2).collect()}
    assert merged == {"t": (2, f"c:b|{wd}a"), "u": (0, "")}
    q = spark.createDataFrame([(0.75,), (2.0,), (-1.0,)], "c float").select(en.quantise(F.col("c")).alias("q")).collect()
    assert [r.q for r in q] == [191, 255, 0]
    pool = en.semantic_pool(first, ["uri"]).orderBy("pool_id").collect()
    assert [r.pool_id for r in pool] == [1, 2, 3] and pool[0].uri == "c:b"
    s = en.pool_statistics(c).first()
    assert (s.n_entries, s.n_uris, s.n_wikidata, s.n_custom) == (4, 3, 2, 1) and s.string_bytes == sum(len(x) + 1 for x in (wd + "a", dbr + "c", "c:b"))


def test_candidates_out_of_range_are_clamped(spark, tmp_path):
    from tsumugi.plans import entities as plans

    rows = [(1, 1, "t", "c:a", 0.9), (2, 1, "t", "c:b", 1.3), (3, 1, "u", "c:c", -0.5), (4, 1, "t", "c:d", float("nan")), (5, 1, "t", "c:e", None), (6, 1, "t", "c:f", float("inf"))]
    spark.createDataFrame(rows, "entry_id long, build_id int, surface string, uri string, confidence float").write.parquet(f"{tmp_path}/semantic_entries.parquet")
    base = str(tmp_path)
    assert {r.uri: round(r.confidence, 3) for r in plans.candidates(spark, base).collect()} == {"c:a": 0.9, "c:b": 1.0, "c:c": 0.0, "c:f": 1.0}
    assert {(r.surface, r.uri) for r in plans.disambiguate_highest(spark, base).collect()} == {("t", "c:b"), ("u", "c:c")}
    assert {r.uri: r.confidence for r in plans.pool_entries(spark, base).collect()} == {"c:a": 229 / 255, "c:b": 1.0, "c:c": 0.0, "c:f": 1.0}


def test_exports(spark):
    e = "array<struct<uri:string,confidence:double>>"
    rows = [(1, 0, '東"京', "名詞,固有名詞,*,*,*,*,東京,トウキョウ,トーキョー", 7, 3, 100, [("http://www.wikidata.org/entity/Q1490", 0.95)]), (1, 1, "は", "助詞,係助詞", None, 4, 50, [])]
    t = spark.createDataFrame(rows, f"text_id long, token_ix int, surface string, feature string, word_id long, pos_id int, wcost int, entities {e}")
    assert ex.plain(t).first().plain == '東"京\t名詞,固有名詞,*,*,*,*,東京,トウキョウ,トーキョー\nは\t助詞,係助詞\nEOS\n'
    vector = t.withColumn("ipa", F.lit("x")).withColumn("embedding", F.array_repeat(F.lit(0.5), 9))
    assert "\n  IPA: /x/\n  Vector: [0.500, 0.500, 0.500, 0.500, 0.500, 0.500, 0.500, 0.500, ...] (dim=9)" in ex.plain(vector).first().plain
    assert ex.dump(t).first().dump.startswith('[0] 東"京 (pos_id=3, wcost=100)\t名詞')
    assert json.loads(ex.json(t).first().json)[0]["surface"] == '東"京'
    assert ex.wakati(t).first().wakati == '東"京 は' and ex.word_ids(t).first().word_ids == "7 4294967295"
    doc = json.loads(ex.jsonld(vector).first().jsonld)
    assert doc["tokens"][0]["entities"] == [{"@id": "wd:Q1490", "confidence": 0.95}] and doc["tokens"][0]["reading"] == "トウキョウ" and "entities" not in doc["tokens"][1] and len(doc["tokens"][0]["embedding"]) == 9
    triples = ex.triples(t)
    assert triples.count() == 8  # type, surface and pos twice, one reading, one entity
    assert '"東\\"京"' in {r.object for r in triples.collect()}
    assert all(r.line.endswith(" .") for r in ex.ntriples(triples).collect()) and all(f"<{ex.GRAPH}> ." in r.line for r in ex.nquads(triples).collect())
    turtle = ex.turtle(t).first().turtle
    assert turtle.startswith("@base <") and "tok:entity <http://www.wikidata.org/entity/Q1490> ." in turtle
    assert ex.mentions(triples, "http://www.wikidata.org/entity/Q1490").first().surface == '"東\\"京"'
    paths = t.withColumn("path_no", F.lit(1)).withColumn("path_cost", F.lit(9))
    assert ex.n_best(paths).first().n_best.startswith("# 1 (cost=9)\n")
    text = ex.Sparql().select("s").where("?s ?p ?o").filter("?o > 1").limit(5).offset(2).build()
    assert "SELECT ?s\nWHERE {\n  ?s ?p ?o .\n  FILTER(?o > 1)\n}\nLIMIT 5\nOFFSET 2" in text and "tok:entity <u>" in ex.entity_mentions("u")
    assert ex.plain(t.limit(0)).count() == 0


def test_dump_keeps_tokens_without_costs(spark, tmp_path):
    from tsumugi.plans import entities as plans

    schema = "morph_id long, request_id long, token_ix int, surface string, feature string, word_id long, pos_id int, wcost int"
    rows = [(1, 1, 0, "東", "名詞", 7, 3, 100), (2, 1, 1, "京", "名詞", 8, 3, None), (3, 1, 2, "は", "助詞", 9, None, 50)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/morphemes.parquet")
    assert plans.export_dump(spark, str(tmp_path)).first().dump == "[0] 東 (pos_id=3, wcost=100)\t名詞\n[1] 京 (pos_id=3, wcost=0)\t名詞\n[2] は (pos_id=0, wcost=50)\t助詞\nEOS\n"


def test_segments(spark):
    df = spark.createDataFrame([(1, "これはテストです。もう一つの文。"), (2, "行1\n行2\n"), (3, "a|b|"), (4, None), (5, "  。x")], "text_id long, text string")
    of = lambda b: {k: [r.sentence for r in v] for k, v in group(se.sentences(df, b).orderBy("ord").collect()).items()}
    assert of(se.JAPANESE)[1] == ["これはテストです。", "もう一つの文。"] and of("\n")[2] == ["行1\n", "行2\n"] and of("|")[3] == ["a|", "b|"]
    ctx = se.context_window(spark.createDataFrame([(1, i, f"文{i}。") for i in (1, 2, 3, 4)], "text_id long, ord int, sentence string"), 2)
    assert [r.context for r in ctx.orderBy("ord").collect()] == ["", "文1。", "文1。文2。", "文2。文3。"]
    c = spark.createDataFrame([("あいうえおかきくけこ",), ("短い",)], "x string").select(se.chunks(F.col("x"), 5, 2).alias("c"), se.chunks(F.col("x"), 100, 10).alias("d")).collect()
    assert c[0].c == ["あいうえお", "えおかきく", "きくけこ"] and c[1].d == ["短い"]
    b = spark.createDataFrame([("aa。bb。cc",), ("",)], "x string").select(se.boundary_chunks(F.col("x"), 8).alias("b")).collect()
    assert b[0].b == ["aa。", "bb。", "cc"] and b[1].b == []
    p = spark.createDataFrame([("x" * 100, 10, False), ("y" * 50, 5, False), ("z", 1, True)], "sentence string, n_tokens int, failed boolean")
    assert tuple(se.progress(p).first()) == (150, 2, 15, 1, 75.0, 7.5) and se.progress(p.limit(0)).first().bytes_per_sentence == 0.0


def group(rows):
    out = {}
    for r in rows:
        out.setdefault(r.text_id, []).append(r)
    return out


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0, 0.0], [1.0, 0.0, 0.0]), ([1.0, 0.0, 0.0], [-1.0, 0.0, 0.0]), ([1.0], [1.0, 2.0]), ([0.0], [0.0])], "a array<float>, b array<float>")
    assert [r.c for r in df.select(ve.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [1.0, -1.0, None, None]
    pooled = ve.mean_pooling(spark.createDataFrame([(1, [1.0, 3.0]), (1, [3.0, 5.0]), (2, None)], "k int, embedding array<float>"), "k").collect()
    assert [(r.k, r.embedding) for r in pooled] == [(1, [2.0, 4.0])]
    lists = spark.createDataFrame([([1, 2, 1],), ([1, 3, None],), ([],), (None,)], "word_ids array<bigint>")
    vocab = ve.vocabulary(lists, 1, 0.01).orderBy("remapped_id").collect()
    assert [(r.word_id, r.n, r.remapped_id) for r in vocab] == [(1, 3, 0), (2, 1, 1), (3, 1, 2)] and vocab[0].sample_prob == pytest.approx((0.01 / 0.6) ** 0.5 + 0.01 / 0.6)
    pairs = sorted(tuple(r) for r in ve.context_pairs(spark.createDataFrame([([7, 8, 9],)], "word_ids array<bigint>"), 1).collect())
    assert pairs == [(7, 8), (8, 7), (8, 9), (9, 8)]
    tokens = spark.createDataFrame([(1, 5), (2, ve.UNKNOWN_WORD), (3, None)], "i int, word_id long")
    found = ve.lookup(tokens, spark.createDataFrame([(5, [1.0]), (ve.UNKNOWN_WORD, [2.0])], "word_id long, embedding array<float>"))
    assert {r.i: r.embedding for r in found.collect()} == {1: [1.0], 2: None, 3: None}
    dense = ve.dense(spark.createDataFrame([(1, [1.0, 1.0])], "word_id long, embedding array<float>"), 2, 2).orderBy("word_id").collect()
    assert [r.embedding for r in dense] == [[0.0, 0.0], [1.0, 1.0], [0.0, 0.0]]


def test_word2vec_brings_neighbours_together(spark):
    rng = np.random.default_rng(0)
    sentences = [([int(x) for x in rng.integers(0, 5, 8)],) for _ in range(150)] + [([int(x) for x in rng.integers(5, 10, 8)],) for _ in range(150)]
    vectors = ve.train_word2vec(spark.createDataFrame(sentences, "word_ids array<bigint>"), size=8, window=3, min_count=1, sample=0, alpha=0.1, epochs=2, partitions=2)
    v = {r.word_id: np.array(r.embedding) for r in vectors.collect()}
    cos = lambda a, b: v[a] @ v[b] / np.linalg.norm(v[a]) / np.linalg.norm(v[b])
    near = np.mean([cos(a, b) for a in range(5) for b in range(a)])
    far = np.mean([cos(a, b) for a in range(5) for b in range(5, 10)])
    assert len(v) == 10 and near > far + 0.2
    with pytest.raises(ValueError):
        ve.train_word2vec(spark.createDataFrame([], "word_ids array<bigint>"))


def test_metrics(spark):
    df = spark.createDataFrame([(0.5,), (9.99,), (10.0,), (-3.0,), (None,)], "v double")
    buckets = me.histogram(df, "v", me.linear_bounds(0, 10, 2))
    assert [r.n for r in buckets.orderBy("bucket_no").collect()] == [1, 3]
    assert {r.p: r.value for r in me.percentiles(buckets, [0, 50, 99]).collect()} == {0.0: 2.5, 50.0: 7.5, 99.0: 7.5}
    assert me.log_bounds(1, 100, 2)[1] == pytest.approx(10)
    s = me.parse_stats(spark.createDataFrame([(10, 2, 1.0), (20, 3, 3.0)], "n_chars long, n_tokens long, seconds double")).first()
    assert (s.min_seconds, s.max_seconds, s.avg_seconds, s.chars_per_second, s.tokens_per_text) == (1.0, 3.0, 2.0, 7.5, 2.5)
    laps = me.laps(spark.createDataFrame([(1, "a", 1.0), (1, "b", 4.0)], "timer int, name string, at double")).orderBy("at").collect()
    assert [r.duration for r in laps] == [1.0, 3.0]
    r = me.suite_summary(spark.createDataFrame([("x", 2.0, 4), ("y", 3.0, 2)], "name string, seconds double, iterations int")).first()
    assert (r.fastest, r.slowest) == ("x", "y")
    assert tuple(me.memory(spark.createDataFrame([(1, 5), (2, 7), (3, -4)], "ord int, change long")).first()) == (8, 12)
    t = spark.createDataFrame([(10, 1048576, 2.0)], "i long, b long, s double").select(me.throughput(F.col("i"), F.col("b"), F.col("s")).alias("t")).first().t
    assert (t.items_per_second, t.mb_per_second) == (5.0, 0.5)


def test_numbers_are_consecutive(spark):
    df = spark.range(0, 500).withColumn("k", F.col("id") % 7)
    rows = numbered(df, [F.desc("k"), F.col("id")], "n").orderBy("n").collect()
    assert [r.n for r in rows] == list(range(500)) and [(-r.k, r.id) for r in rows] == sorted((-r.k, r.id) for r in rows)


def test_memory_never_falls_below_zero(spark):
    rng = random.Random(11)
    changes = [rng.randrange(-50, 50) for _ in range(500)]
    current = peak = 0
    for c in changes:
        current = max(0, current + c)
        peak = max(peak, current)
    df = spark.createDataFrame(list(enumerate(changes)), "ord long, change long").repartition(4)
    assert tuple(me.memory(df).first()) == (current, peak) and tuple(me.memory(df.limit(0)).first()) == (0, 0)


def test_rests_of_buffers(spark):
    df = spark.createDataFrame([(1, "これは。残り\nも"), (2, "全部。"), (3, ""), (4, None)], "text_id long, text string")
    assert {r.text_id: (r.pending, r.has_pending, r.pending_len) for r in se.pending(df).collect()} == {1: ("残り\nも", True, 10), 2: ("", False, 0), 3: ("", False, 0)}


def test_nearest_vectors(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(60)] + [(90, [0.0] * 6), (91, [1.0]), (92, None)]
    df = spark.createDataFrame(rows, "word_id long, embedding array<float>").repartition(3)
    monkeypatch.setattr(ve, "QUERIES", 4)
    got = {(r.word_id, r.rank_no): r.neighbour for r in ve.most_similar(df, df.where("word_id < 10"), 3).collect()}
    m = np.array([v for i, v in rows[:60]])
    m /= np.linalg.norm(m, axis=1)[:, None]
    for i in range(10):
        order = [j for j in np.argsort(-(m @ m[i]), kind="stable") if j != i][:3]
        assert [got[i, n] for n in (1, 2, 3)] == order
    assert ve.most_similar(df, df.limit(0)).count() == 0


def test_a_vocabulary_too_large_is_refused(spark, monkeypatch):
    monkeypatch.setattr(ve, "MOST_BYTES", 100)
    with pytest.raises(ValueError):
        ve.train_word2vec(spark.createDataFrame([([1, 2, 3, 1, 2, 3],)], "word_ids array<bigint>"), size=8, min_count=1)


def test_entities_once_per_uri_and_ordered_words(spark):
    df = spark.createDataFrame([([("u", 0.5), ("v", 0.1), ("u", 0.9)],), ([],), (None,)], "e array<struct<uri:string,confidence:double>>")
    got = [r[0] and [tuple(x) for x in r[0]] for r in df.select(en.distinct_entities(F.col("e"))).collect()]
    assert got == [[("u", 0.5), ("v", 0.1)], [], None]
    words = spark.createDataFrame([("b", 2), ("a", 3), ("c", 2)], "surface string, cost int")
    assert [r.surface for r in wo.sorted_by_cost(words).collect()] == ["b", "c", "a"] and [r.surface for r in wo.sorted_by_surface(words).collect()] == ["a", "b", "c"]
    errors = wo.validation_errors(spark.createDataFrame([(3, " bad,line ")], "line_no int, line string")).first()
    assert (errors.line_no, errors.message, errors.content) == (3, "too few fields", "bad,line")
