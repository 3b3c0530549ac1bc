"""Plans whose memory and time in one task must not grow with a table that is small as a file."""

import numpy as np
from pyspark.sql import functions as F

from lodestone.operators import graph, joins, reshape, validate
from lodestone.operators.scan import running
from lodestone.plans import retrieval as R
from lodestone.plans import vectors


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_boxes_and_lines_are_not_broadcast(spark):
    """Their entries outgrow their files, so Spark's guess by size of file would hold them in the driver."""
    points = spark.createDataFrame([("i", 1, [1.0, 1.0])], "image string, point_id long, point array<double>")
    boxes = spark.createDataFrame([("i", 1, [0.0, 0.0, 2.0, 2.0])], "image string, box_id long, box array<double>")
    lines = spark.createDataFrame([("i", 1, [[0.0, 0.0], [1.0, 1.0]])], "image string, line_id long, line array<array<double>>")
    others = lines.select("image", F.col("line_id").alias("other_id"), F.col("line").alias("other"))
    points, boxes, lines, others = (df.limit(5) for df in (points, boxes, lines, others))  # bounded, so that Spark would broadcast them
    for found in (joins.smallest_box(points, boxes, "image"), joins.attachment_box(points, boxes, "image"), joins.nearest_end(lines, others, "image"), joins.best_match(lines, others, "image")):
        assert found.count() == 1 and "Broadcast" not in plan(found)


def test_next_values_take_no_frame_with_an_open_end(spark):
    """Spark goes over such a frame anew for each row."""
    df = spark.createDataFrame([("g", i, i % 3 or None) for i in range(50)], "g string, i long, v long")
    found = running(df, ["g"], ["i"], nexts={"_next": F.col("v")})
    assert "unboundedfollowing" not in plan(found).lower()
    assert {r["i"]: r["_next"] for r in found.collect()} == {i: next((k % 3 for k in range(i + 1, 50) if k % 3), None) for i in range(50)}


def test_pages_are_dealt_out_and_parsed_once(spark):
    pages = spark.createDataFrame([(i, "<table><tr><th>a</th><th>2024년</th></tr><tr><td>b</td><td>1</td></tr></table>") for i in range(20)], "id long, html string").coalesce(1)
    cells = reshape.table_cells(pages, "id", "html")
    assert cells.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    facts = reshape.long_facts(cells, "id")
    assert facts.count() == 20 and "MapInArrow" not in plan(facts)


def test_keys_of_a_question_are_broadcast(spark):
    names = spark.createDataFrame([(i, "redbolt") for i in range(9)] + [(9, "red"), (10, "redboltnut")], "id long, key string")
    found = R.node_scores(names, spark.createDataFrame([("redbolt",), ("boltnut",)], "key string"))
    assert "SortMergeJoin" not in plan(found)
    assert {r["id"]: r["score"] for r in found.collect()} == {**{i: 3 for i in range(9)}, 10: 2}


def test_degrees_read_edges_once(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "b")], "source string, target string")
    assert "Union" not in plan(graph.degrees(edges))
    assert {r["id"]: r["degree"] for r in graph.degrees(edges).collect()} == {"a": 2, "b": 3, "c": 1}


def test_small_graphs_take_no_rounds_over_tables(spark, monkeypatch):
    """Only graphs of more than SMALL links do, and their communities are finished in a task once few links are left."""
    cliques = lambda of, n: [(of, f"{of}{6 * g + a:03}", f"{of}{6 * g + b:03}", 3) for g in range(n) for a in range(6) for b in range(a)] + [(of, f"{of}{6 * g:03}", f"{of}{6 * ((g + 1) % n) + 5:03}", 1) for g in range(n)]
    seen, moved = [], graph._moved
    monkeypatch.setattr(graph, "_moved", lambda nodes, *rest: (seen.append({r["of"] for r in nodes.select("of").distinct().collect()}), moved(nodes, *rest))[1])
    pairs = spark.createDataFrame(cliques("s", 4) + cliques("t", 12), "of string, a string, b string, weight long")
    for small, expected in ((1_000_000, []), (200, [{"t"}])):
        monkeypatch.setattr(graph, "SMALL", small)
        seen.clear()
        found = {r["id"]: r["community"] for r in graph.louvain(pairs).collect()}
        assert seen == expected and len(found) == 16 * 6
        assert all(len({found[f"{of}{6 * g + i:03}"] for i in range(6)}) == 1 for of, n in (("s", 4), ("t", 12)) for g in range(n))
        assert all(c == min(x for x in found if found[x] == c) for c in found.values())


def test_connected_parts_take_no_rounds_over_tables(spark, monkeypatch):
    """A large graph of small parts goes through tasks part by part, small ones some together, and its communities are those of the whole graph in one task."""
    ring = lambda of, n: [("x", f"{of}{6 * g + a:03}", f"{of}{6 * g + b:03}", 3) for g in range(n) for a in range(6) for b in range(a)] + [("x", f"{of}{6 * g:03}", f"{of}{6 * ((g + 1) % n) + 5:03}", 1) for g in range(n)]
    pairs = spark.createDataFrame(ring("s", 4) + ring("t", 12) + [("x", f"u{i:03}", f"v{i:03}", 1) for i in range(40)], "of string, a string, b string, weight long")
    seen, moved = [], graph._moved
    monkeypatch.setattr(graph, "_moved", lambda *a: (seen.append(a), moved(*a))[1])
    found = []
    for small in (1_000_000, 400):  # the graph has 592 links, its largest part 384
        monkeypatch.setattr(graph, "SMALL", small)
        monkeypatch.setattr(graph, "PARTED", small)
        found.append(sorted(map(tuple, graph.louvain(pairs).collect())))
    assert found[0] == found[1] and len(found[0]) == 16 * 6 + 80 and not seen


def test_components_are_found_from_forests(spark, monkeypatch):
    """A path, a star and pairs, whatever a task keeps at once; tasks leave no more links than nodes that they met."""
    links = [(f"p{i:03}", f"p{i + 1:03}") for i in range(60)] + [(f"s{i:03}", "s100") for i in range(30)] + [(f"v{i}", f"u{i}") for i in range(5)]
    links += [(b, a) for a, b in links[::2]] + links[::3]
    df = spark.createDataFrame(links, "a string, b string").repartition(3)
    expected = {**{f"p{i:03}": "p000" for i in range(61)}, **{f"s{i:03}": "s000" for i in [*range(30), 100]}, **{f"{x}{i}": f"u{i}" for i in range(5) for x in "uv"}}
    for kept in (500_000, 3):
        monkeypatch.setattr(graph, "KEPT", kept)
        assert {r["id"]: r["root"] for r in graph.components(df).collect()} == expected
    monkeypatch.setattr(graph, "KEPT", 500_000)
    assert graph._forest(df.coalesce(1)).count() == len(expected) - 7
    assert graph.components(df.limit(0)).count() == 0


def test_nodes_move_alike_by_arrays_and_by_dictionaries(monkeypatch):
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 60, (2, 600))
    a, b, w = a[a != b], b[a != b], rng.integers(1, 9, 600)[a != b].astype(float)
    starts, targets, weights = graph._linked(np.append(a, b), np.append(b, a), np.append(w, w), 60)
    strength = np.add.reduceat(weights, starts[:-1])
    found = []
    for dense in (0, 60):
        monkeypatch.setattr(graph, "DENSE", dense)
        found.append(graph._settled(starts, targets, weights, strength, np.full(60, 1 / weights.sum())).tolist())
    assert found[0] == found[1] and len(set(found[0])) < 60


def test_vectors_are_not_repeated_in_python(spark, monkeypatch):
    """A question that meets many cells leaves a task once, with their list."""
    monkeypatch.setattr(vectors, "CELLS", 8)
    seen, products = [], vectors._products
    monkeypatch.setattr(vectors, "_products", lambda asked, *rest: (seen.append("Generate explode(cells" in plan(asked)), products(asked, *rest))[1])
    df = spark.createDataFrame([(i, [float((i * k) % 17 - 8) for k in range(1, 6)]) for i in range(1, 200)], "id long, v array<double>")
    asked = df.filter("id % 20 = 0")
    found = vectors.nearest_pruned(asked, df, "id", "v", 5)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, R.nearest(asked, df, "id", "v", 5).collect()))
    assert seen == [True, True]


def test_relations_are_dealt_by_their_number(spark, monkeypatch):
    """Spark puts parts together by their packed bytes, which took 16 tasks for 36 million rows."""
    monkeypatch.setattr(validate, "PART", 3, raising=False)
    rows = [(i, f"n{i % 2}", "A", f"n{i % 3}", i % 5 > 0, i) for i in range(30)]
    relations = spark.createDataFrame([*rows, *[(*r[:5], r[5] + 100) for r in rows]], "chunk long, source string, kind string, target string, quote_found boolean, ord long")
    entities = spark.createDataFrame([(i, f"n{k}") for i in range(30) for k in range(2)], "chunk long, name string")
    found = validate.valid_relations(relations, entities, ["A"])
    assert found.rdd.getNumPartitions() == 20
    expected = lambda i: "endpoint" if i % 3 == 2 else "loop" if i % 2 == i % 3 else "evidence" if i % 5 == 0 else None
    assert {r["ord"]: r["reason"] for r in found.collect()} == {i + 100 * again: expected(i) or ("duplicate" if again else None) for i in range(30) for again in (0, 1)}
