"""Hierarchies, graphs, joins, ranks, checks on literal rows."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import aggregates, filters, graph, hierarchy, joins, ranking, reshape, validate


def test_hierarchy_faults_and_editions(spark):
    rows = [("v1", "D34", ""), ("v1", "D34.0", "D34"), ("v2", "D34", ""), ("x", "a", "b"), ("x", "b", "a"), ("x", "c", "gone"), ("x", "self", "self")]
    codes = spark.createDataFrame(rows, "edition string, code string, parent string")
    up = {tuple(r) for r in hierarchy.ancestors(codes).collect()}
    assert up == {("v1", "D34.0", "D34", 1, ""), ("x", "a", "b", 1, ""), ("x", "a", "a", 2, "cycle"), ("x", "b", "a", 1, ""), ("x", "b", "b", 2, "cycle"), ("x", "c", "gone", 1, "dangling"), ("x", "self", "self", 1, "cycle")}
    roots = spark.createDataFrame([("v1", "D34"), ("v2", "D34"), ("x", "a"), ("x", "none")], "edition string, root string")
    down = {tuple(r) for r in hierarchy.descendants(codes, roots).collect()}
    assert down == {("v1", "D34", "D34", 0), ("v1", "D34", "D34.0", 1), ("v2", "D34", "D34", 0), ("x", "a", "a", 0), ("x", "a", "b", 1)}


def test_deep_hierarchy(spark, monkeypatch):
    """A chain takes as many rounds as its length has binary digits."""
    codes = spark.createDataFrame([("v", str(i), "" if i == 0 else str(i - 1)) for i in range(200)], "edition string, code string, parent string")
    written = []
    monkeypatch.setattr(graph, "SMALL", 0)
    monkeypatch.setattr(hierarchy, "cut", lambda df, cut=hierarchy.cut: written.append(1) or cut(df))
    up = hierarchy.ancestors(codes)
    assert up.count() == 199 * 100 and len(written) <= 3 * 9 + 1
    assert up.filter("CAST(code AS INT) - depth <> CAST(ancestor AS INT) OR issue <> ''").count() == 0


def walked(parents):
    """Ancestors by walking up from each code."""
    out = set()
    for edition, code in parents:
        seen, at, depth = {code}, code, 0
        while parents.get((edition, at), "") != "":
            at, depth = parents[edition, at], depth + 1
            issue = "cycle" if at in seen else "" if (edition, at) in parents else "dangling"
            out.add((edition, code, at, depth, issue))
            if issue:
                break
            seen.add(at)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_hierarchies_of_any_shape(spark, seed):
    """Random parents: chains into cycles of any length, loops, codes that aren't there, tops."""
    rng = random.Random(seed)
    parents = {(e, f"c{i}"): rng.choice(["", f"c{i}", "gone"]) if rng.random() < (0.3, 0.05, 0.02, 0.0)[seed] else f"c{rng.randrange(60) if seed % 2 else (i + 1) % 40}" for e in ("v", "w") for i in range(40)}
    codes = spark.createDataFrame([(e, c, p) for (e, c), p in parents.items()], "edition string, code string, parent string")
    assert {tuple(r) for r in hierarchy.ancestors(codes).collect()} == walked(parents)
    assert hierarchy.ancestors(codes.filter("false")).count() == 0


def _planted(rng, size, groups, inside, outside):
    """Edges among ``groups`` groups of ``size`` nodes each, n00 and on."""
    n = size * groups
    return [(f"n{a:03}", f"n{b:03}", 1) for a, b in itertools.combinations(range(n), 2) if rng.random() < (inside if a // size == b // size else outside)]


def test_louvain_finds_planted_groups(spark):
    """Each node is in one community, named by its least id, and modularity is that of the planted groups."""
    pairs = spark.createDataFrame(_planted(random.Random(0), 12, 5, 0.6, 0.02), "a string, b string, weight long")
    found = graph.louvain(pairs.withColumn("of", F.lit("")))
    members = spark.createDataFrame([(f"n{i:03}", str(i // 12)) for i in range(60)], "id string, community string")
    rows = found.collect()
    assert len(rows) == len({r["id"] for r in rows}) == 60
    assert all(r["community"] == min(x["id"] for x in rows if x["community"] == r["community"]) for r in rows)
    assert graph.modularity(pairs, found) >= 0.9 * graph.modularity(pairs, members)


def test_communities_have_two_levels(spark):
    """A community over 40 nodes is split along its own groups; small ones aren't; pairs and loops alone are in none; numbers go by size."""
    rng = random.Random(1)
    groups = [range(i * 12, i * 12 + 12) for i in range(4)]  # one community of 48: four groups, tied together
    edges = [(a, b, 4) for g in groups for a, b in itertools.combinations(g, 2) if rng.random() < 0.7]
    edges += [(a, b, 1) for a, b in itertools.combinations(range(48), 2) if a // 12 != b // 12 and rng.random() < 0.25]
    edges += [(a, b, 9) for a, b in itertools.combinations(range(100, 130), 2)]
    edges += [(200, 201, 1), (300, 300, 5)]
    # many others far away, so that the four groups weigh too little to stand alone at the first level
    edges += [(a, b, 40) for start in range(1000, 1600, 30) for a, b in itertools.combinations(range(start, start + 30), 2)]
    rows = graph.communities(spark.createDataFrame(edges, "a long, b long, weight long")).collect()
    top = {r["id"]: r["community"] for r in rows if r["level"] == 0}
    sub = {r["id"]: (r["community"], r["parent"]) for r in rows if r["level"] == 1}
    assert top.keys() == {*range(48), *range(100, 130), *range(1000, 1600)}
    assert {top[i] for i in range(48)} == {"c0-0000"} and len({top[i] for i in range(100, 130)}) == 1
    assert sub.keys() == set(range(48)) and {p for _, p in sub.values()} == {"c0-0000"}
    assert [len({sub[i] for i in g}) for g in groups] == [1] * 4 and {c for c, _ in sub.values()} == {f"c0-0000-00{j}" for j in range(4)}


def test_louvain_looks_at_nodes_awake(spark, monkeypatch):
    """A ring of 80 groups: the last rounds look at few nodes, and each group is whole in the end."""
    edges = [(f"n{6 * g + a:03}", f"n{6 * g + b:03}", 3) for g in range(80) for a, b in itertools.combinations(range(6), 2)]
    edges += [(f"n{6 * g:03}", f"n{6 * ((g + 1) % 80) + 5:03}", 1) for g in range(80)]
    written = []
    monkeypatch.setattr(graph, "SMALL", 0)
    monkeypatch.setattr(graph, "cut", lambda df, real=graph.cut: (written.append(df.columns), real(df))[1])
    pairs = spark.createDataFrame(edges, "a string, b string, weight long")
    found = graph.louvain(pairs.withColumn("of", F.lit("")))
    of = {r["id"]: r["community"] for r in found.collect()}
    assert ["id"] in written
    assert all(len({of[f"n{6 * g + i:03}"] for i in range(6)}) == 1 for g in range(80))
    planted = spark.createDataFrame([(f"n{i:03}", str(i // 6)) for i in range(480)], "id string, community string")
    assert graph.modularity(pairs, found) >= graph.modularity(pairs, planted)


def test_links_of_nodes_are_a_table(spark):
    """Without lists a node has the numbers of its chunks and documents; null ones aren't counted, and repeated mentions count once."""
    rows = [("A", "x", "c1", "d1", "", "s", 1), ("A", "x", "c1", "d1", "", "s", 2), ("a", "x", "c2", "d1", "t", "s", 3), ("a", "x", None, None, "", "s", 4), ("b", "y", None, None, "", "s", 5)]
    mentions = spark.createDataFrame(rows, "name string, type string, chunk string, document string, description string, stage string, ord long")
    nodes = {r["key"]: r for r in graph.merge_nodes(mentions, F.lower("name"), lists=False).collect()}
    assert [(nodes[k]["n_chunks"], nodes[k]["n_documents"], nodes[k]["mentions"]) for k in "ab"] == [(2, 1, 4), (0, 0, 1)]
    links = {tuple(r) for r in graph.node_links(mentions, F.lower("name")).collect()}
    assert links == {("a", "x", "d1", "c1", 2, 1), ("a", "x", "d1", "c2", 1, 3), ("a", "x", None, None, 1, 4), ("b", "y", None, None, 1, 5)}


def test_communities_of_nothing(spark):
    assert graph.communities(spark.createDataFrame([], "a long, b long, weight long")).count() == 0
    assert graph.communities(spark.createDataFrame([(1, 1, 3)], "a long, b long, weight long")).count() == 0


def test_titles_in_korean_collation(spark):
    """Hangul by syllable and Hanja by its reading before Latin letters, lower case first; not the order of code points."""
    titles = ["zebra", "Apple", "apple", "한자", "漢字", "나무", "각도", "가방", "가 방", "9", "10", None, ""]
    ordered = spark.createDataFrame([(x,) for x in titles], "title string").orderBy(ranking.by_title(F.col("title")))
    assert [r["title"] for r in ordered.collect()] == [None, "", "10", "9", "가 방", "가방", "각도", "나무", "한자", "漢字", "apple", "Apple", "zebra"]


def test_merge_and_fold(spark):
    mentions = spark.createDataFrame([("Ａ", "t", "c1", "d1", "x", "s1", 1), ("a", "t", "c2", "d1", "x", "s2", 2), ("a", "t", "c2", "d2", "", "s2", 3), ("b", "t", "c1", "d1", "y", "s1", 4)], "name string, type string, chunk string, document string, description string, stage string, ord long")
    from lodestone.functions.text import name_key

    row = {r["key"]: r for r in graph.merge_nodes(mentions, name_key(F.col("name"))).collect()}
    assert row["a"]["name"] == "Ａ" and row["a"]["aliases"] == ["a"] and row["a"]["descriptions"] == ["x"] and row["a"]["mentions"] == 3 and row["a"]["documents"] == ["d1", "d2"]
    relations = spark.createDataFrame([("a", "b", "r", "l2", "e1", "s1", 1), ("a", "b", "r", "l1", "e1", "s1", 2), ("a", "b", "r", "l1", "", "s2", 3), ("a", "b", "r", "l2", "e0", "s1", 4), ("a", "a", "r", "l", "e", "s1", 5)], "source string, target string, type string, label string, evidence string, stage string, ord long")
    edge = graph.merge_edges(relations).collect()
    assert len(edge) == 1 and (edge[0]["weight"], edge[0]["label"], edge[0]["evidence"], edge[0]["stages"]) == (4, "l2", ["e1", "e0"], ["s1", "s2"])


def test_nearest_value_is_brute_force(spark):
    rng = random.Random(1)
    a = [(rng.randrange(3), i, float(rng.randrange(50))) for i in range(60)]
    b = [(rng.randrange(2), i, float(rng.randrange(50))) for i in range(20)]
    df = joins.nearest_value(spark.createDataFrame(a, "g int, i long, v double"), spark.createDataFrame(b, "g int, j long, w double"), "g", "i", "v", "j", "w")
    expected = {i: min(((abs(v - w), j) for h, j, w in b if h == g), default=(None, None)) for g, i, v in a}
    assert {r["i"]: (r["distance"], r["j"]) for r in df.collect()} == expected


def test_spatial_joins(spark):
    boxes = spark.createDataFrame([("p", 0, [0.0, 0.0, 10.0, 10.0]), ("p", 1, [2.0, 2.0, 6.0, 6.0]), ("p", 2, [50.0, 50.0, 60.0, 60.0])], "image string, box_id int, box array<double>")
    points = spark.createDataFrame([("p", 0, [3.0, 3.0]), ("p", 1, [9.0, 9.0]), ("p", 2, [30.0, 30.0])], "image string, point_id int, point array<double>")
    assert {r["point_id"]: r["box_id"] for r in joins.smallest_box(points, boxes, "image").collect()} == {0: 1, 1: 0, 2: None}
    assert {r["point_id"]: r["box_id"] for r in joins.attachment_box(points, boxes, "image").collect()} == {0: 1, 1: 0}
    lines = spark.createDataFrame([("p", 0, [[0.0, 0.0], [10.0, 0.0]]), ("p", 1, [[0.0, 0.0], [1.0, 0.0]])], "image string, line_id int, line array<array<double>>")
    others = spark.createDataFrame([("p", 5, [[0.0, 0.0], [12.0, 0.0]]), ("p", 6, [[10.0, 1.0], [0.0, 1.0]])], "image string, other_id int, other array<array<double>>")
    assert {r["line_id"]: r["other_id"] for r in joins.nearest_end(lines, others, "image").collect()} == {0: 5}
    assert {r["line_id"]: (r["other_id"], r["distance"]) for r in joins.best_match(lines, others, "image").collect()} == {0: (5, 1.0)}


def test_suppress_overlaps_is_a_plain_loop(spark):
    rng = random.Random(2)
    rows = [(f"i{i // 30}", i % 30, [x := rng.random() * 50, y := rng.random() * 50, x + 20, y + 20], rng.randrange(10) / 10) for i in range(90)]

    def iou(p, q):
        w, h = min(p[2], q[2]) - max(p[0], q[0]), min(p[3], q[3]) - max(p[1], q[1])
        both = max(0, w) * max(0, h)
        return both / (800 - both)

    expected = set()
    for image in {r[0] for r in rows}:
        kept = []
        for r in sorted((r for r in rows if r[0] == image), key=lambda r: (-r[3], r[1])):
            if all(iou(r[2], k[2]) < 0.5 for k in kept):
                kept.append(r)
        expected |= {(r[0], r[1]) for r in kept}
    df = spark.createDataFrame(rows, "image string, idx int, box array<double>, conf double")
    assert {(r["image"], r["idx"]) for r in ranking.suppress_overlaps(df).collect()} == expected


def test_containing_is_brute_force(spark):
    texts = [(i, t) for i, t in enumerate(["The quick  brown Fox jumps", "a b c d", "b c d", "x quick brown fox jumps y", "", None])]
    phrases = [(0, "quick BROWN fox"), (1, "b c d"), (2, "brown fox jumps y")]
    df = joins.containing(spark.createDataFrame(texts, "i int, t string"), spark.createDataFrame(phrases, "j int, p string"), "t", "p")
    flat = lambda s: " ".join((s or "").lower().split())
    assert {(r["i"], r["j"]) for r in df.collect()} == {(i, j) for i, t in texts for j, p in phrases if flat(p) in flat(t)}


def test_filters(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "", "y"), (3, "b", "x")], "id int, f string, g string")
    ids = lambda d: [r["id"] for r in d.orderBy("id").collect()]
    assert ids(filters.any_of(df, {"f": "", "g": []})) == [1, 2, 3]
    assert ids(filters.any_of(df, {"f": [""]})) == [2]
    assert ids(filters.any_of(df, {"f": ["a", "b"], "g": ["x"]})) == [1, 3]
    with pytest.raises(ValueError, match="too many"):
        filters.any_of(df, {"f": ["x"] * 51})
    with pytest.raises(ValueError, match="page"):
        filters.page(df, [F.col("id")], 0)
    with pytest.raises(ValueError, match="digits"):
        filters.year_is(F.col("f"), "20x4")
    assert ids(filters.page(df, [F.col("id")], 2, 2)) == [3]
    table = spark.createDataFrame([("C25",), ("F",), ("construction",), ("other",)], "industry string")
    assert {r[0] for r in filters.threshold_rows(table, "F41").collect()} == {"construction"}
    assert filters.threshold_rows(table, "").count() == 4


def test_validation(spark):
    relations = spark.createDataFrame([(1, "a", "k", "b", True, 1), (1, "a", "k", "b", True, 2), (1, "a", "z", "b", True, 3), (1, "a", "k", "q", True, 4), (1, "a", "k", "a", True, 5), (1, "b", "k", "a", False, 6)], "chunk int, source string, kind string, target string, quote_found boolean, ord int")
    entities = spark.createDataFrame([(1, "a"), (1, "b")], "chunk int, name string")
    reasons = {r["ord"]: r["reason"] for r in validate.valid_relations(relations, entities, ["k"]).collect()}
    assert reasons == {1: None, 2: "duplicate", 3: "kind", 4: "endpoint", 5: "loop", 6: "evidence"}
    assert validate.exactly_one({"a": ["x", "y"], "b": ["y"]}, ["x", "y", "z"]) == ["y", "z"]


def test_ledger_and_summaries(spark):
    charges = spark.createDataFrame([("1", "p", "2026-01-01", "2026-01-01", 5, 9), ("2", "p", "2025-12-31", None, 7, 9), ("3", "q", "2025-12-30", "2025-12-31", 100, 9)], "id string, provider string, started string, finished string, amount long, reserved long")
    assert {r["provider"]: r["spent"] for r in aggregates.spend(charges, "2026-01-01").collect()} == {"all": 12, "p": 12, "q": 0}
    log = spark.createDataFrame([("a", "reserve", 10, 0), ("a", "settle", 12, 1), ("a", "settle", 3, 2), ("b", "reserve", 4, 0)], "id string, kind string, amount long, ord int")
    assert {tuple(r) for r in aggregates.settled(log).collect()} == {("a", 10, 12, True), ("b", 4, 4, False)}


def test_html_tables(spark):
    source = '<table><tr><th rowspan="2">A</th><th colspan="2">2024년</th></tr><tr><td>&lt;b&gt;</td><td> x <br> y </td></tr></table><p></p><TABLE></TABLE>'
    cells = {tuple(r)[1:] for r in reshape.table_cells(spark.createDataFrame([(1, source), (2, None), (3, "")], "id int, html string"), "id", "html").collect()}
    assert cells == {(0, 0, 0, "A"), (0, 0, 1, "2024년"), (0, 0, 2, "2024년"), (0, 1, 0, "A"), (0, 1, 1, "<b>"), (0, 1, 2, "x y")}


def test_html_tables_that_overlap(spark):
    """A later cell before an earlier one, gaps filled, spans cut at the table's end, tables in tables, marks in cells."""
    page = "<table><tr><td>a<td>b<td rowspan='900000000'>C</tr><tr><td>d</td><td colspan=2 rowspan=2>E</td></tr><tr><td>f</td></tr><tr></tr></table>"
    nested = "<table><tr><td>x<b>y</b><table><tr><th>in</th></tr></table></td><td colspan=0></td></tr></table>"
    rows = reshape.table_cells(spark.createDataFrame([("k", page + nested)], "id string, html string"), "id", "html").collect()
    lines = {}
    for r in sorted(rows, key=lambda r: (r["table_no"], r["row_no"], r["col_no"])):
        lines.setdefault((r["table_no"], r["row_no"]), []).append(r["cell"])
    assert lines == {(0, 0): ["a", "b", "C"], (0, 1): ["d", "E", "E"], (0, 2): ["f", "E", "E"], (0, 3): ["", "", "C"], (1, 0): ["x y", ""], (2, 0): ["in"]}


def test_periods(spark):
    heads = ["구분", "2024년", "2024년 1/4분기", "2024년 비고", "3월", "계"]
    cells = spark.createDataFrame([(1, 0, r, c, t if r == 0 else f"v{c}") for r in range(2) for c, t in enumerate(heads)], "id int, table_no int, row_no int, col_no int, cell string")
    assert {(r["label"], r["period"], r["value"]) for r in reshape.long_facts(cells, "id").collect()} == {("v0", heads[c], f"v{c}") for c in (1, 2, 4, 5)}


def test_short_phrases(spark):
    """Phrases of any number of words and characters, inside words too."""
    texts = spark.createDataFrame([(1, "The red Widget  rolls"), (2, "a b"), (3, ""), (4, None), (1, "The red Widget  rolls")], "id int, text string")
    phrases = spark.createDataFrame([(10, "d wid"), (11, "rolls"), (12, "b"), (13, ""), (14, None), (15, "red widget ro"), (16, "e red widget rolls"), (17, "zz"), (18, "oll")], "p int, phrase string")
    found = sorted((r["id"], r["p"]) for r in joins.containing(texts, phrases, "text", "phrase").collect())
    assert found == sorted([(1, p) for p in (10, 11, 15, 16, 18)] * 2 + [(2, 12)])


def test_nearest_vectors(spark):
    """Blocks of both sides give the ranks of all products, ties by row."""
    from lodestone.plans import retrieval

    rng = np.random.default_rng(4)
    values = rng.integers(-3, 4, (300, 5)).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(values)], "id int, v array<double>")
    got = {(r["query"], r["rank"]): r["row"] for r in retrieval.nearest(df.filter("id % 20 = 0"), df, "id", "v", 7, block=40).collect()}
    scores = values @ values.T
    assert got == {(q, k + 1): int(row) for q in range(0, 300, 20) for k, row in enumerate(np.lexsort((np.arange(300), -scores[q]))[:7])}


def test_numbered(spark):
    rows = [(int(v),) for v in np.random.default_rng(3).permutation(500)]
    ids = {r["v"]: r["id"] for r in ranking.numbered(spark.createDataFrame(rows, "v int"), [F.col("v")], "n%06d", "id").collect()}
    assert ids == {v: f"n{v:06d}" for v in range(500)}


def test_phrases_in_shares(spark, monkeypatch):
    """Several automata find what one does, which is what comparing all pairs finds."""
    rng = random.Random(11)
    texts = [(i, "".join(rng.choice("ab 가") for _ in range(rng.randrange(30)))) for i in range(60)] + [(99, None)]
    phrases = [(i, "".join(rng.choice("ab 가") for _ in range(rng.randrange(1, 5)))) for i in range(80)] + [(500, "a"), (501, "A")]
    flat = lambda s: " ".join((s or "").lower().split())
    pairs = sorted((i, j) for i, t in texts for j, p in phrases if flat(p) and flat(p) in flat(t))
    t, p = spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(phrases, "p int, phrase string")
    for share in (10_000, 60):
        monkeypatch.setattr(joins, "SHARE", share)
        assert sorted((r["id"], r["p"]) for r in joins.containing(t, p, "text", "phrase").collect()) == pairs
    assert joins.containing(t, p.filter("p < 0"), "text", "phrase").count() == 0


def test_points_and_boxes_meet_on_grids(spark):
    """Boxes of all sizes, borders, points, negative places and nulls, against all pairs."""
    rng = random.Random(12)
    boxes, points = [("n", 0, None), ("n", 1, [5.0, 5.0, 1.0, 1.0])], [("n", 0, None), ("m", 1, [0.0, 0.0])]
    for image in ("a", "b"):
        for k in range(120):
            x, y, w, h = rng.randrange(-40, 40), rng.randrange(-40, 40), rng.choice((0, 0.5, 1, 3, 64, 200)), rng.choice((0, 1, 8, 100))
            boxes.append((image, k, [float(x), float(y), float(x + w), float(y + h)]))
            points.append((image, k, [float(rng.randrange(-45, 60)), float(rng.randrange(-45, 60))]))
    b, p = spark.createDataFrame(boxes, "image string, box_id int, box array<double>"), spark.createDataFrame(points, "image string, point_id int, point array<double>")
    pairs = sorted((i, q, k) for i, q, (x, y) in [r for r in points if r[2]] for j, k, z in boxes if i == j and z and z[0] <= x <= z[2] and z[1] <= y <= z[3])
    assert sorted((r["image"], r["point_id"], r["box_id"]) for r in joins.meeting(p, F.col("point"), b, F.col("box"), "image").collect()) == pairs and len(pairs) > 500


def test_a_large_image_is_not_quadratic(spark):
    side = 150
    boxes = spark.range(side * side).select(F.lit("i").alias("image"), F.col("id").alias("box_id"), F.array(*[(v * 10 + e).cast("double") for e in (0, 8) for v in (F.col("id") % side, F.floor(F.col("id") / side))]).alias("box"))
    points = boxes.select("image", F.col("box_id").alias("point_id"), F.array(F.col("box")[0] + 4, F.col("box")[1] + 4).alias("point"))
    held = joins.smallest_box(points, boxes, "image")
    assert held.filter("box_id <> point_id OR box_id IS NULL").count() == 0 and held.count() == side * side


def test_lines_that_match_are_found_by_their_means(spark):
    from lodestone.functions.vectors import polyline_length, symmetric_distance

    rng = random.Random(13)
    line = lambda: [[rng.uniform(0, 60), rng.uniform(0, 60)] for _ in range(4)]
    lines = spark.createDataFrame([(i % 2, i, line()) for i in range(40)], "image int, line_id int, line array<array<double>>")
    others = spark.createDataFrame([(i % 2, i, line()) for i in range(60)], "image int, other_id int, other array<array<double>>")
    pairs = lines.join(others, "image").select("*", symmetric_distance(F.col("line"), F.col("other")).alias("d"), polyline_length(F.col("line")).alias("n"))
    end = lambda c: F.element_at(c, -1)
    best = {r["line_id"]: r["o"] for r in pairs.filter("d <= 0.5 * n").groupBy("line_id").agg(F.min_by("other_id", F.struct("d", "other_id")).alias("o")).collect()}
    assert {r["line_id"]: r["other_id"] for r in joins.best_match(lines, others, "image").collect()} == best and best
    away = F.hypot(end("line")[0] - end("other")[0], end("line")[1] - end("other")[1])
    near = {r["line_id"]: r["o"] for r in pairs.withColumn("e", away).filter("e <= 0.4 * n").groupBy("line_id").agg(F.min_by("other_id", F.struct("e", "other_id")).alias("o")).collect()}
    assert {r["line_id"]: r["other_id"] for r in joins.nearest_end(lines, others, "image").collect()} == near and near
