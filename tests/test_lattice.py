"""Lattices and paths against brute force over all segmentations."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tsumugi.operators import exports as ex
from tsumugi.operators import lattice as la
from tsumugi.operators import paths as pa
from tsumugi.operators import solver as so
from tsumugi.operators import viterbi as vi
from tsumugi.operators.lexicon import NO_CONNECTION, UNKNOWN, UNKNOWN_COST, Lexicon, category, category_sql, example_lexicon


def lexicon(spark, seed=1):
    rng = random.Random(seed)
    words = [(w, rng.randrange(3), rng.randrange(3), rng.randrange(-50, 300)) for w in ("a", "b", "ab", "ba", "aba", "東", "東京", "京都", "都", "ab")]
    return words, example_lexicon(spark, words, cells := [(r, c, rng.randrange(-40, 90)) for r in range(3) for c in range(3)]), {(r, c): x for r, c, x in cells}


def brute(text, words, cells):
    """(cost, surfaces) of every path, cheapest first."""
    out = []

    def unknowns(i):
        if any(text.startswith(w, i) for w, *_ in words):
            return []
        run = 1
        while i + run < len(text) and category(text[i + run]) == category(text[i]):
            run += 1
        return [text[i : i + n] for n in (range(1, run + 1) if category(text[i]) != "KANJI" else [1])]

    def walk(i, right, cost, path):
        if i == len(text):
            out.append((cost + cells.get((right, 0), NO_CONNECTION), path))
            return
        for w, left, r, c in words:
            if text.startswith(w, i):
                walk(i + len(w), r, cost + cells.get((right, left), NO_CONNECTION) + c, [*path, w])
        for w in unknowns(i):
            walk(i + len(w), 0, cost + cells.get((right, 0), NO_CONNECTION) + UNKNOWN_COST, [*path, w])

    walk(0, 0, 0, [])
    return sorted(out, key=lambda x: x[0])


TEXTS = ["abab", "aba東京都x", "zz9", "東京", "", None, "b", "京a京都", "xyz東", " a b"]


def test_best_and_k_best_paths(spark):
    words, lex, cells = lexicon(spark)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "text_id long, text string")
    for joined in (2_000_000, 1):
        tokens = vi.tokenize(df, lex, k=4, most_entries=joined).collect()
        got = {}
        for t in sorted(tokens, key=lambda t: t.token_ix):
            got.setdefault(t.text_id, {}).setdefault(t.path_no, [t.path_cost, []])[1].append(t.surface)
        for i, text in enumerate(TEXTS):
            if not text:
                assert i not in got
                continue
            want = brute(text, words, cells)[:4]
            assert [got[i][n + 1][0] for n in range(len(want))] == [c for c, _ in want]
            for cost, path in got[i].values():
                assert "".join(path) == text and (cost, path) in brute(text, words, cells)


def test_the_two_solvers_agree_on_ties_and_templates(spark):
    rng = random.Random(9)
    words = [(w, rng.randrange(3), rng.randrange(3), rng.randrange(3)) for w in ("a", "ab", "b", "ba", "bab", "東", "東京", "ab", "あい")]
    lex = example_lexicon(spark, words, [(r, c, rng.randrange(2)) for r in range(3) for c in range(3)])
    unknown = spark.createDataFrame([("ALPHA", 0, 1, 2, 7, 2, "x"), ("ALPHA", 1, 0, 1, 8, 1, "y"), ("HIRAGANA", 0, 2, 2, 9, 3, "z"), ("KANJI", 0, 1, 1, 6, 4, "k")], UNKNOWN)
    characters = spark.createDataFrame([(ord(c), k, g) for c, k, g in [("z", "ALPHA", True), ("A", "ALPHA", True), ("あ", "HIRAGANA", True), ("い", "HIRAGANA", True), ("ー", "HIRAGANA", True), ("漢", "KANJI", False), ("京", "KANJI", False), ("q", "GREEK", True), (" ", "SPACE", False)]], "codepoint int, category string, `group` boolean")
    lex = replace(lex, unknown=unknown, characters=characters)
    texts = ["".join(rng.choice("abzqあいー東京漢 é😀") for _ in range(rng.randrange(1, 14))) for _ in range(120)] + ["z" * 300, "あ" * 50 + "ー" * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "text_id long, text string")
    for k, compat in ((1, False), (1, True), (3, False)):
        rows = [sorted(map(tuple, vi.tokenize(df, lex, k, compat, most).collect()), key=repr) for most in (2_000_000, 1)]
        if k == 1:
            assert rows[0] == rows[1]
        else:  # of equally dear paths either may come first
            assert [sorted({(r[0], r[1], r[2]) for r in x}) for x in rows][0] == sorted({(r[0], r[1], r[2]) for r in rows[1]})
    spans = {(r.text_id, r.start_pos, r.end_pos, r.category) for r in la.lattice_nodes(df, lex).join(la.positions(df, lex), ["text_id", "start_pos"]).where("is_unknown").collect()}
    assert sorted(map(tuple, la.joined_nodes(df, lex).select(*la.NODE, "node_ix").collect()), key=repr) == sorted(map(tuple, la.lattice_nodes(df, lex).select(*la.NODE, "node_ix").collect()), key=repr)
    assert any(b - a > 1 and c == "HIRAGANA" for _, a, b, c in spans) and not any(b - a > 1 and c in ("KANJI", "DEFAULT", "GREEK") for _, a, b, c in spans)


def test_a_matrix_too_large_is_refused(spark, monkeypatch):
    _, lex, cells = lexicon(spark)
    m = vi.Matrix.of(lex.connections)
    assert all(m.cost(r, c) == x for (r, c), x in cells.items()) and m.cost(9, 0) == m.cost(0, 9) == NO_CONNECTION
    monkeypatch.setattr(so, "MOST_CELLS", 3)
    with pytest.raises(ValueError):
        vi.Matrix.of(lex.connections)


def test_long_runs_are_linear(spark):
    _, lex, _ = lexicon(spark)
    df = spark.createDataFrame([(1, "x" * 30_000), (2, "x" * 30_000 + "ab")], "text_id long, text string")
    assert [r.surface for r in vi.tokenize(df, lex).where("text_id = 1").collect()] == ["x" * 30_000]
    assert vi.tokenize(df, lex, k=3).where("text_id = 2 and token_ix = 0").count() == 3


def test_textbook_and_compatible_ends(spark):
    lex = example_lexicon(spark, [("ab", 1, 1, 10), ("c", 1, 1, 10)], [(0, 1, 0), (1, 1, 0), (1, 0, 5)])
    df = spark.createDataFrame([(1, "abc")], "text_id long, text string")
    surfaces = lambda t: [r.surface for r in t.orderBy("token_ix").collect()]
    assert surfaces(vi.tokenize(df, lex)) == ["ab", "c"]
    assert surfaces(vi.tokenize(df, lex, compat_eos=True)) == ["ab"]


def test_runtime_words_come_first_and_go(spark):
    _, lex, _ = lexicon(spark)
    more = lex.add_words([("aba", "アバ", "アバ", -90000)])
    assert more.overlay_size() == 1 and lex.overlay_size() == 0
    assert [r.layer for r in more.lookup("abab").collect()][0] == 0
    assert more.remove_words(["aba"]).overlay_size() == 0
    df = spark.createDataFrame([(1, "aba")], "text_id long, text string")
    token = vi.tokenize(df, more).first()
    assert token.surface == "aba" and token.word_id is None and "固有名詞" in token.feature


def test_categories_agree(spark):
    sample = "aＡ1１あア漢一Ωд 　!。é😀"
    df = spark.createDataFrame([(c,) for c in sample], "c string").select("c", F.expr(category_sql("c")).alias("k"))
    assert {r.c: r.k for r in df.collect()} == {c: category(c) for c in sample}


def test_nodes_edges_and_stats(spark):
    words, lex, cells = lexicon(spark)
    df = spark.createDataFrame([(1, "abaz東")], "text_id long, text string")
    nodes = la.lattice_nodes(df, lex)
    edges = la.lattice_edges(nodes, df, lex)
    assert {(r.start_pos, r.surface) for r in nodes.collect()} >= {(0, "aba"), (3, "z"), (4, "東")}
    tokens = vi.tokenize(df, lex)
    on = pa.best_path_edges(edges, tokens, nodes).where("on_best_path")
    assert on.agg(F.sum(F.col("ccost") + F.col("wcost"))).first()[0] == tokens.first().path_cost
    assert pa.what_if(tokens, 99, 99, 0).first().path_cost == tokens.first().path_cost
    graph = ex.dot(nodes, edges).first().dot
    assert graph.startswith("digraph lattice {") and "fillcolor=yellow" in graph and "shape=diamond" in graph
    counts = spark.createDataFrame([(1, p, i) for p, n in enumerate([2, 3, 1, 4, 2]) for i in range(n)], "text_id long, end_pos int, node_ix int")
    stats = la.lattice_stats(counts).first()
    assert (stats.n_nodes, stats.n_positions, stats.most_nodes, int(stats.estimated_paths)) == (12, 5, 4, 48)
    matrix = spark.createDataFrame([(0, i, c) for i, c in enumerate([0, 10, -5, 20, 0, 15])], "right_id int, left_id int, cost int")
    assert la.connection_stats(matrix).first()[:2] == (-5, 20)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _names(spark, path, rows=300):
    """A folder with part names of one to three words; estimated sizes are far below a broadcast's limit."""
    from tsumugi.plans import lattice as plans

    rng = random.Random(5)
    names = [(i, " ".join(rng.choices(plans.NAMES, k=rng.randrange(1, 4)))) for i in range(rows)]
    spark.createDataFrame([*names, (rows, ""), (rows + 1, None), (rows + 2, "qx red"), (None, "red")], "p_partkey long, p_name string").write.parquet(f"{path}/part.parquet")
    return str(path)


def test_edges_on_the_best_path_by_search_and_by_joins(spark):
    words, lex, cells = lexicon(spark)
    df = spark.createDataFrame([*enumerate(TEXTS), (None, "ab")], "text_id long, text string")
    by_search, by_joins = (sorted(map(tuple, pa.flagged_edges(df, lex, n).select("text_id", "from_end", "from_ix", "to_end", "to_ix", "ccost", "wcost", "on_best_path").collect())) for n in (2_000_000, 1))
    assert by_search == by_joins
    costs = {i: sum(e[5] + e[6] for e in by_search if e[0] == i and e[7]) for i, t in enumerate(TEXTS) if t is not None}
    assert costs == {i: brute(t, words, cells)[0][0] for i, t in enumerate(TEXTS) if t is not None}


def test_best_path_edges_of_many_texts_are_not_broadcast(spark, tmp_path, monkeypatch):
    from tsumugi.plans import lattice as plans

    base = _names(spark, tmp_path)
    monkeypatch.setattr(la, "MOST_ROWS", 50, raising=False)
    found = plans.best_path_edges_part(spark, base)
    assert "Broadcast" not in _plan(found)
    got = {r.text_id: (r.n_on, r.cost) for r in found.collect()}
    want = {r.text_id: (r.n_tokens + 1, r.cost) for r in plans.viterbi_part_costs(spark, base).where("text_id is not null").collect()}
    assert got.pop(300) == (1, dict(((r, c), x) for r, c, x in plans.CELLS)[0, 0]) and got == want and 302 in got
    texts, lex = plans.part_texts(spark, base), plans.part_lexicon(spark)
    nodes = la.lattice_nodes(texts, lex)
    joined = pa.best_path_edges(la.lattice_edges(nodes, texts, lex), vi.tokenize(texts, lex), nodes)
    assert "BroadcastExchange" not in _plan(joined)


def test_lattice_edges_of_many_texts_are_not_broadcast(spark, tmp_path):
    from tsumugi.plans import lattice as plans

    base = _names(spark, tmp_path)
    found = plans.lattice_edges_part(spark, base)
    assert "Join" not in _plan(found)
    texts, lex = plans.part_texts(spark, base), plans.part_lexicon(spark)
    joined = la.all_edges(texts, lex, 1)
    assert found.columns == joined.columns and [f.dataType for f in found.schema] == [f.dataType for f in joined.schema]
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, joined.collect()))


def test_lookup_of_many_texts_is_not_broadcast(spark, tmp_path):
    from tsumugi.plans import words as plans
    from tsumugi.plans.lattice import WORDS, part_texts

    base = _names(spark, tmp_path)
    found = plans.overlay_lookup(spark, base)
    assert "Join" not in _plan(found)
    texts = [r.text or "" for r in part_texts(spark, base).collect()]
    over = [(w, 1, c) for w, _, _, c in WORDS] + [("bluebolt", 0, 500), ("red", 0, 900)]
    n = {(w, layer, cost): sum(t.startswith(w, i) for t in texts for i in range(len(t))) for w, layer, cost in over}
    assert {(r.surface, r.layer, r.wcost): r.n for r in found.collect()} == {k: x for k, x in n.items() if x}


def test_entries_found_by_search_and_by_joins(spark):
    _, lex, _ = lexicon(spark)
    lex = lex.add_words([("東京", "ト", "ト", 5), ("ab", "a", "a", 7)])
    df = spark.createDataFrame([*enumerate(TEXTS), (None, "ab")], "text_id long, text string")
    by_search, by_joins = (sorted(map(tuple, la.entries_found(df, lex, n).groupBy("surface", "layer", "wcost").agg(F.sum("n")).collect())) for n in (2_000_000, 1))
    assert by_search == by_joins and ("東京", 0, 5, 2) in by_search
    assert "BroadcastExchange" not in _plan(la.joined_nodes(df, lex))


def test_k_shortest_paths_and_diversity(spark):
    nodes = spark.createDataFrame([(1, n, c) for n, c in enumerate([0, 1, 2, 0])], "graph_id int, node int, cost long")
    edges = spark.createDataFrame([(1, a, b, 1) for a, b in ((0, 1), (0, 2), (1, 3), (2, 3))], "graph_id int, src int, dst int, cost long")
    paths = pa.k_shortest(nodes, edges, 0, 3, 2)
    assert [(r.path, r.cost) for r in paths.orderBy("rank_no").collect()] == [([0, 1, 3], 3), ([0, 2, 3], 4)]
    assert [r.path for r in pa.k_shortest(nodes, edges, 0, 3, 2, backward=True).orderBy("rank_no").collect()][0][0] == 0
    assert pa.k_shortest(nodes, edges, 0, 3, 5, threshold=0).count() == 1
    d = pa.path_diversity(paths).first()
    assert (d.n_nodes, d.n_edges, d.mean_distance) == (4, 4, 0.5)


def test_path_diversity_of_many_texts_is_not_broadcast(spark, tmp_path):
    from tsumugi.plans import lattice as plans

    found = plans.path_diversity_part(spark, _names(spark, tmp_path))
    assert "Join" not in _plan(found)
    schema = "graph_id long, rank_no int, path array<string>"
    rng = random.Random(8)
    rows = [(g, n, [rng.choice("abcd") for _ in range(rng.randrange(1, 6))]) for g in range(40) for n in range(rng.randrange(1, 5))]
    rows += [(40, 1, []), (40, 2, ["a"]), (41, 1, ["a", None, "a", None]), (42, 1, None), (42, 2, ["a", "b"])]
    got = {r[0]: r[1:] for r in pa.path_diversity(spark.createDataFrame([*rows, (43, 1, []), (43, 2, [])], schema)).collect()}
    for g in range(43):
        mine = [p for i, _, p in rows if i == g and p is not None]
        pairs = [1 - len({*p} & {*q}) / len({*p} | {*q}) for i, p in enumerate(mine) for q in mine[:i]]
        want = (len({x for p in mine for x in p} - {None}), len({e for p in mine for e in zip(p, p[1:])}), sum(pairs) / max(1, len(pairs)))
        assert tuple(got[g]) == pytest.approx(want), g
    assert set(got) == set(range(43))


def test_k_shortest_paths_by_search_and_by_joins(spark, monkeypatch):
    rng = random.Random(13)
    nodes, edges = [], []
    for g in range(12):
        n = rng.randrange(3, 9)
        nodes += [(g, i, rng.randrange(4)) for i in range(n)]
        edges += [(g, a, b, rng.randrange(4)) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.6]
    nodes, edges = spark.createDataFrame(nodes, "graph_id int, node int, cost int"), spark.createDataFrame(edges, "graph_id int, src int, dst int, cost int")
    rows = []
    for most in (10**6, 1):
        monkeypatch.setattr(pa, "MOST_EDGES", most)
        rows.append(sorted((r.graph_id, r.rank_no, r.cost, r.path) for r in pa.k_shortest(nodes, edges, 0, 2, 4).collect()))
    assert rows[0] == rows[1] and rows[0]
    assert pa.k_shortest(nodes.limit(0), edges.limit(0), 0, 2).count() == 0
    with pytest.raises(ValueError):
        pa.cheapest_paths({0: 0, 1: 0}, [(0, 1, 1), (1, 0, 1)], 0, 5, 2)


def test_cost_arrays(spark):
    df = spark.createDataFrame([([10, 20, 5, 15], [2, 1, 3, 1]), ([], [])], "p array<int>, c array<int>")
    rows = df.select(pa.best_predecessor(F.col("p"), F.col("c")).alias("b"), pa.add_costs(F.col("p"), 2147483640).alias("s")).collect()
    assert tuple(rows[0].b) == (2, 8) and rows[1].b is None and rows[0].s[0] == 2147483647


def test_path_analysis(spark):
    tokens = spark.createDataFrame([(1, 1, 0, "東", 100, 50), (1, 1, 1, "京", 80, 30)], "text_id long, path_no int, token_ix int, surface string, wcost int, ccost int")
    r = pa.path_analysis(tokens).first()
    assert (r.total_cost, r.word_cost, r.connection_cost, r.dearest, r.cheapest) == (260, 180, 80, "東", "京")
    report = spark.createDataFrame([(1, 10, 5, 100), (2, 20, 8, 200)], "text_id long, n_chars long, n_tokens long, cost long")
    s = pa.segmentation_report(report).first()
    assert (s.n_tokens, s.n_chars, s.tokens_per_text) == (13, 30, 6.5)
    assert {r.n_tokens: r.n_texts for r in pa.token_distribution(report).collect()}[6] == 0
    assert pa.segmentation_report(report.limit(0)).first().tokens_per_text == 0.0


def test_entries_of_the_search(spark):
    words, lex, cells = lexicon(spark)
    df = spark.createDataFrame([(1, "abaz東"), (2, "b"), (3, None)], "text_id long, text string")
    rows = la.search_entries(df, lex).collect()
    best = vi.tokenize(df, lex).where("text_id = 1").collect()
    on = sorted((r.end_pos, r.surface) for r in rows if r.text_id == 1 and r.on_best_path)
    assert on == sorted((t.end_pos, t.surface) for t in best)
    last = max((r for r in rows if r.text_id == 1 and r.on_best_path), key=lambda r: r.end_pos)
    assert last.cumulative_cost + cells.get((dict((t.end_pos, t.right_id) for t in best)[5], 0), NO_CONNECTION) == best[0].path_cost
    for r in rows:
        others = [x.cumulative_cost for x in rows if x.text_id == r.text_id and x.end_pos == r.end_pos and not x.on_best_path]
        assert r.cost_delta == (min(others) - r.cumulative_cost if r.on_best_path and others else None)


def test_nulls_in_any_column_of_a_lexicon(spark):
    entries = spark.createDataFrame([("a", 1, None, None, None, None, None), (None, 2, 0, 0, 0, 5, "x"), ("", 3, 0, 0, 0, 5, "x"), ("b", None, 0, 0, 0, 7, "y")], "surface string, word_id long, left_id int, right_id int, pos_id int, wcost int, feature string")
    connections = spark.createDataFrame([(0, 0, 3), (None, 0, 1), (0, None, 1)], "right_id int, left_id int, cost int")
    unknown = spark.createDataFrame([("ALPHA", 0, None, 0, 0, None, None)], UNKNOWN)
    df = spark.createDataFrame([(1, "bab"), (2, "bz"), (None, "b"), (4, None)], "text_id long, text string")
    lex = Lexicon.of(entries, connections, unknown)
    for most in (2_000_000, 1):
        rows = {(r.text_id, r.token_ix): (r.surface, r.wcost, r.ccost) for r in vi.tokenize(df.where("text_id is not null"), lex, most_entries=most).collect()}
        assert rows == {(1, 0): ("b", 7, 3), (1, 1): ("a", 0, NO_CONNECTION), (1, 2): ("b", 7, NO_CONNECTION), (2, 0): ("b", 7, 3), (2, 1): ("z", UNKNOWN_COST, NO_CONNECTION)}
    assert vi.tokenize(df, lex).where("text_id is null").count() == 1
