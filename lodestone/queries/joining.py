"""Joins and set operations."""

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import decisions, filters, joins, validate
from ..schemas import table
from .registry import query


@query("""SELECT 'left' AS side, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL
          SELECT 'right', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def j1_key_sets(spark, d):
    diff = joins.key_difference(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")
    sides = spark.createDataFrame([("left",), ("right",)], "side string")
    return sides.join(diff.groupBy("side").agg(F.count(F.lit(1)).alias("n")), "side", "left").na.fill(0, ["n"])


@query("""SELECT o_orderkey, count(l_orderkey) AS n_items, round(coalesce(sum(l_quantity), 0), 2) AS quantity, coalesce(string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber), '') AS lines
          FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def j2_nested_children(spark, d):
    items = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    nested = joins.with_children(table(spark, d, "orders").select("o_orderkey"), items, "o_orderkey", ["l_linenumber", "l_quantity"], "items")
    quantity = F.aggregate("items.l_quantity", F.lit(0.0), lambda s, q: s + q)
    return nested.select("o_orderkey", F.size("items").cast("bigint").alias("n_items"), F.round(quantity, 2).alias("quantity"), F.array_join(F.col("items.l_linenumber").cast("array<string>"), ",").alias("lines"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j3_orphans_anti(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left_anti")


@query("""SELECT label, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM embeddings JOIN documents ON doc_id = vec_id GROUP BY label""")
def j4_vectors_by_key(spark, d):
    joined = table(spark, d, "embeddings").join(table(spark, d, "documents"), F.col("vec_id") == F.col("doc_id"))
    return joined.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query(r"""WITH c AS (SELECT p_brand AS article, '[' || p_type || '] ' || p_name || '_part' || CAST(p_size AS VARCHAR) AS cited FROM part),
          k AS (SELECT DISTINCT article, regexp_replace(regexp_replace(cited, '^\[[^\]]*\] ', ''), '_part\d+$', '') AS title FROM c)
          SELECT article, count(*) AS guides FROM k JOIN (SELECT DISTINCT p_name FROM part) g ON g.p_name = k.title GROUP BY article""")
def j7_citations(spark, d):
    """Article and guide, matched by the guide's title without its domain in front and its part number behind."""
    parts = table(spark, d, "part")
    cited = parts.select(F.col("p_brand").alias("article"), F.concat(F.lit("["), "p_type", F.lit("] "), "p_name", F.lit("_part"), F.col("p_size").cast("string")).alias("cited"))
    titled = cited.select("article", T.strip_part(F.regexp_replace("cited", r"^\[[^\]]*\] ", "")).alias("title")).distinct()
    return titled.join(parts.select(F.col("p_name").alias("title")).distinct(), "title").groupBy("article").agg(F.count(F.lit(1)).alias("guides"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def j8_semi_join(spark, d):
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi")


@query("""SELECT s_name, p_name, count(*) AS weight FROM (SELECT l_suppkey, l_partkey FROM lineitem) JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey GROUP BY s_name, p_name""")
def j9_edge_labels(spark, d):
    edges = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).alias("weight"))
    named = edges.join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return named.groupBy("s_name", "p_name").agg(F.sum("weight").alias("weight"))


@query("""WITH v AS (SELECT DISTINCT lower(string_split(p_type, ' ')[1]) AS spelling, p_brand AS label FROM part)
          SELECT spelling, label FROM (SELECT *, row_number() OVER (PARTITION BY spelling ORDER BY label) AS n FROM v) WHERE n <= 8""")
def j11_vocabulary_lookup(spark, d):
    vocabulary = table(spark, d, "part").select(F.lower(F.split_part("p_type", F.lit(" "), F.lit(1))).alias("spelling"), F.col("p_brand").alias("label")).distinct()
    return filters.ranked(vocabulary, [F.col("label")], 8, ["spelling"]).select("spelling", "label")


@query(r"""SELECT doc_id, item_id FROM (SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS t FROM documents)
          JOIN (SELECT item_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS q FROM benchmark) ON contains(t, q)""")
def j12_containment_join(spark, d):
    texts = table(spark, d, "documents").select("doc_id", "text")
    return joins.containing(texts, table(spark, d, "benchmark").select("item_id", F.col("text").alias("phrase")), "text", "phrase").select("doc_id", "item_id")


@query("""WITH a AS (SELECT DISTINCT p_brand AS a FROM part), b AS (SELECT DISTINCT substring(p_brand, 1, 7) AS b FROM part)
          SELECT a, b FROM a JOIN b ON starts_with(a, b) OR starts_with(b, a)""")
def j15_prefix_overlap(spark, d):
    brands = table(spark, d, "part").select(F.col("p_brand").alias("a")).distinct()
    return joins.prefix_overlap(brands, brands.select(F.substring("a", 1, 7).alias("b")).distinct(), "a", "b")


@query("""WITH x AS (SELECT c_custkey, s_suppkey, abs(c_acctbal - s_acctbal) AS d, row_number() OVER (PARTITION BY c_custkey ORDER BY abs(c_acctbal - s_acctbal), s_suppkey) AS n
          FROM customer JOIN supplier ON c_nationkey = s_nationkey) SELECT c_custkey, s_suppkey, round(d, 2) AS distance FROM x WHERE n = 1""")
def j20_nearest_centre(spark, d):
    a = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey", F.col("c_acctbal").alias("v"))
    b = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey", F.col("s_acctbal").alias("v"))
    return joins.nearest_value(a, b, "nation", "c_custkey", "v", "s_suppkey", "v").filter("s_suppkey IS NOT NULL").select("c_custkey", "s_suppkey", F.round("distance", 2).alias("distance"))


@query("""SELECT label, count(*) FILTER (WHERE abs(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1) > 1e-4 OR len(embedding) <> 64) AS bad, count(*) AS n FROM embeddings GROUP BY label""")
def q7_vector_checks(spark, d):
    return table(spark, d, "embeddings").groupBy("label").agg(F.count_if(~V.valid_unit_vector(F.col("embedding"), 64)).alias("bad"), F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def j25_not_done(spark, d):
    done = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.not_done(table(spark, d, "orders").select("o_orderkey"), done, "o_orderkey")


@query("""WITH a AS (SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus IN ('F', 'O')), b AS (SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus IN ('P', 'O'))
          SELECT side, count(*) AS n FROM (SELECT 'left' AS side, * FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'right', * FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) GROUP BY side""")
def j29_reconcile_except_all(spark, d):
    orders = table(spark, d, "orders")
    rows = lambda *s: orders.filter(F.col("o_orderstatus").isin(*s)).select("o_custkey", "o_orderpriority")
    return joins.reconcile(rows("F", "O"), rows("P", "O")).groupBy("side").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT n_name, coalesce(r_name, '') AS region FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) ON r_regionkey = n_regionkey""")
def j28_dimension_default(spark, d):
    regions = table(spark, d, "region").filter("r_regionkey < 3").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("region"))
    return joins.with_default(table(spark, d, "nation"), regions, "n_regionkey").select("n_name", "region")


@query("""SELECT p_partkey, min(priority) AS priority FROM (SELECT p_partkey, 0 AS priority FROM part WHERE p_size = 1 UNION ALL SELECT p_partkey, 3 FROM part WHERE p_brand = 'Brand#11') GROUP BY p_partkey""")
def u1_union_priority(spark, d):
    parts = table(spark, d, "part")
    either = parts.filter("p_size = 1").select("p_partkey", F.lit(0).alias("priority")).unionAll(parts.filter("p_brand = 'Brand#11'").select("p_partkey", F.lit(3)))
    return either.groupBy("p_partkey").agg(F.min("priority").alias("priority"))


@query("""SELECT l_partkey AS id FROM lineitem WHERE l_quantity > 49 UNION SELECT p_partkey FROM part WHERE p_size = 50""")
def u2_set_union(spark, d):
    return table(spark, d, "lineitem").filter("l_quantity > 49").select(F.col("l_partkey").alias("id")).union(table(spark, d, "part").filter("p_size = 50").select("p_partkey")).distinct()


@query("""WITH e AS (SELECT l_suppkey AS source, l_partkey AS target, min(l_orderkey) AS first FROM lineitem GROUP BY 1, 2)
          SELECT source, target, first, coalesce(o_orderpriority, '') AS title FROM e LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') o ON o_orderkey = first""")
def j10_first_evidence(spark, d):
    """Edges with the title of their first piece of evidence, empty where it isn't known."""
    edges = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target")).agg(F.min("l_orderkey").alias("first"))
    known = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("first"), F.col("o_orderpriority").alias("title"))
    return joins.with_default(edges, known, "first").select("source", "target", "first", "title")


@query("""SELECT label, n, rank FROM (SELECT p_name AS label, count(*) AS n, row_number() OVER (ORDER BY length(p_name) DESC, p_name) AS rank FROM part WHERE contains('a red widget and a blue bolt, small ring', p_name) AND length(p_name) >= 4 GROUP BY p_name) WHERE rank <= 6""")
def j13_labels_in_question(spark, d):
    """Labels that a question holds, the longest ones first."""
    held = table(spark, d, "part").filter(F.contains(F.lit("a red widget and a blue bolt, small ring"), F.col("p_name")) & (F.length("p_name") >= 4))
    counted = held.groupBy(F.col("p_name").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return filters.ranked(counted, [F.desc(F.length("label")), F.col("label")], 6)


@query("""SELECT o_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ' ' ORDER BY l_linenumber, l_partkey) AS items FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY o_orderkey""")
def j17_item_text(spark, d):
    """The items of a programme as one text, in order."""
    orders = table(spark, d, "orders").filter("o_orderstatus = 'F'").select("o_orderkey")
    nested = joins.with_children(orders, table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", ["l_linenumber", "l_partkey"])
    return nested.filter(F.size("children") > 0).select("o_orderkey", F.array_join(F.col("children.l_partkey").cast("array<string>"), " ").alias("items"))


@query("""SELECT c_custkey, answer, points FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderpriority) AS answer FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a ON a.o_custkey = c_custkey
          LEFT JOIN (SELECT o_custkey, count(*) AS points FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) p ON p.o_custkey = c_custkey WHERE answer IS NOT NULL OR points IS NOT NULL""")
def j19_any_answer(spark, d):
    """Tasks with what two reviewers say, if any of them says anything."""
    orders = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    answers = orders.filter("o_orderstatus = 'F'").groupBy("c_custkey").agg(F.min("o_orderpriority").alias("answer"))
    points = orders.filter("o_orderstatus = 'O'").groupBy("c_custkey").agg(F.count(F.lit(1)).alias("points"))
    joined = table(spark, d, "customer").select("c_custkey").join(answers, "c_custkey", "left").join(points, "c_custkey", "left")
    return joined.filter("answer IS NOT NULL OR points IS NOT NULL")


BOXES = """b AS (SELECT p_partkey // 20 AS image, p_partkey % 20 AS box_id, CAST(p_partkey * 37 % 100 AS DOUBLE) AS x, CAST(p_partkey * 53 % 100 AS DOUBLE) AS y, CAST(p_size AS DOUBLE) AS s FROM part),
           q AS (SELECT p_partkey // 20 AS image, p_partkey % 20 AS point_id, CAST(p_partkey * 11 % 120 AS DOUBLE) AS px, CAST(p_partkey * 29 % 120 AS DOUBLE) AS py FROM part)"""


def _boxes(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size").cast("double")
    x, y = (k * 37 % 100).cast("double"), (k * 53 % 100).cast("double")
    parts = table(spark, d, "part").withColumn("image", F.expr("p_partkey div 20"))
    boxes = parts.select("image", (k % 20).alias("box_id"), F.array(x, y, x + s, y + s).alias("box"))
    return boxes, parts.select("image", (k % 20).alias("point_id"), F.array((k * 11 % 120).cast("double"), (k * 29 % 120).cast("double")).alias("point"))


@query(f"""WITH {BOXES}, h AS (SELECT q.image, point_id, box_id, row_number() OVER (PARTITION BY q.image, point_id ORDER BY s * s, box_id) AS n FROM q JOIN b ON b.image = q.image AND px BETWEEN x AND x + s AND py BETWEEN y AND y + s)
          SELECT q.image, q.point_id, h.box_id FROM q LEFT JOIN h ON h.image = q.image AND h.point_id = q.point_id AND n = 1""")
def j21_smallest_box(spark, d):
    """The smallest box of an image that holds a point."""
    boxes, points = _boxes(spark, d)
    return joins.smallest_box(points, boxes, "image")


@query(f"""WITH {BOXES}, c AS (SELECT q.image, point_id, box_id, s, sqrt((px - x - s / 2) * (px - x - s / 2) + (py - y - s / 2) * (py - y - s / 2)) AS away, px BETWEEN x - 0.2 * s AND x + 1.2 * s AND py BETWEEN y - 0.2 * s AND y + 1.2 * s AS inside FROM q JOIN b ON b.image = q.image)
          SELECT image, point_id, box_id FROM (SELECT *, row_number() OVER (PARTITION BY image, point_id ORDER BY away, box_id) AS n FROM c WHERE inside OR away <= 1.5 * sqrt(2 * s * s)) WHERE n = 1""")
def j20_attachment_box(spark, d):
    """The box with the nearest centre among those that hold a point or are near it."""
    boxes, points = _boxes(spark, d)
    return joins.attachment_box(points, boxes, "image")


@query(f"""WITH {BOXES} SELECT image, box_id FROM b WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.image = b.image AND px BETWEEN x AND x + s AND py BETWEEN y AND y + s)""")
def j23_unmatched(spark, d):
    """Boxes that hold no point."""
    from pyspark.sql.functions import col

    boxes, points = _boxes(spark, d)
    held = boxes.join(points, "image").filter(V.in_box(col("point"), col("box"))).select("image", "box_id").distinct()
    return joins.not_done(boxes, held, ["image", "box_id"]).select("image", "box_id")


@query("""WITH r AS (SELECT p_partkey AS report, unnest([p_brand, p_type]) AS node FROM part) SELECT report, count(*) AS nodes FROM r WHERE node IN ('Brand#12', 'LARGE') GROUP BY report""")
def j26_reports_of_nodes(spark, d):
    """Reports by the chosen nodes that they are about."""
    nodes = table(spark, d, "part").select(F.col("p_partkey").alias("report"), F.explode(F.array("p_brand", "p_type")).alias("node"))
    chosen = spark.createDataFrame([("Brand#12",), ("LARGE",)], "node string")
    return nodes.join(chosen, "node", "left_semi").groupBy("report").agg(F.count(F.lit(1)).alias("nodes"))


@query("""SELECT count(*) AS n, count(mentions) AS with_mentions, count(stage) AS with_stage FROM (SELECT p_name AS name, 1 AS mentions, NULL AS stage FROM part UNION ALL BY NAME SELECT s_name AS name, 'stage2' AS stage FROM supplier)""")
def u5_concatenated_sources(spark, d):
    """Sources of different columns one after the other."""
    parts = table(spark, d, "part").select(F.col("p_name").alias("name"), F.lit(1).alias("mentions"))
    both = parts.unionByName(table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.lit("stage2").alias("stage")), allowMissingColumns=True)
    return both.agg(F.count(F.lit(1)).alias("n"), F.count("mentions").alias("with_mentions"), F.count("stage").alias("with_stage"))


@query("""SELECT p_brand, string_agg(DISTINCT w, ' ' ORDER BY w) AS words FROM (SELECT p_brand, unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY p_brand""")
def u6_merged_sets(spark, d):
    words = table(spark, d, "part").select("p_brand", F.explode(F.split("p_name", " ")).alias("w"))
    return words.groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("w")), " ").alias("words"))


@query("""SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON c_custkey = o_custkey""")
def j16_must_match(spark, d):
    """Every order has a customer, or the join fails."""
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return joins.must_match(table(spark, d, "orders").select("o_orderkey", "o_custkey"), customers, "o_custkey").select("o_orderkey", "c_mktsegment")


GEOMETRY = """g AS (SELECT p_partkey AS k, (p_partkey % 97)::DOUBLE AS x1, (p_partkey % 89)::DOUBLE AS y1, (p_partkey * 3 % 97)::DOUBLE AS x2, (p_partkey * 5 % 89)::DOUBLE AS y2, (p_partkey * 7 % 97)::DOUBLE AS x3, (p_partkey * 11 % 89)::DOUBLE AS y3, p_size::DOUBLE AS s FROM part)"""


def _lines(spark, d):
    """k, image, s and a line of three points for each part."""
    k = F.col("p_partkey")
    at = lambda a, b: F.array((k * a % 97).cast("double"), (k * b % 89).cast("double"))
    return table(spark, d, "part").select(k.alias("k"), F.expr("p_partkey div 20").alias("image"), F.col("p_size").cast("double").alias("s"), F.array(at(1, 1), at(3, 5), at(7, 11)).alias("line"))


@query(f"""WITH {GEOMETRY}, b AS (SELECT *, least(x1, x2, x3) AS bx, least(y1, y2, y3) AS ex, greatest(x1, x2, x3) AS cx, greatest(y1, y2, y3) AS fx FROM g),
          o AS (SELECT *, greatest(0, least(cx, bx + s) - greatest(bx, bx)) * greatest(0, least(fx, ex + s) - ex) AS common, (cx - bx) * (fx - ex) + s * s AS sizes FROM b)
          SELECT k, round(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) + sqrt((x3 - x2) * (x3 - x2) + (y3 - y2) * (y3 - y2)), 6) AS length, bx AS west, ex AS south, cx AS east, fx AS north,
                 round(CASE WHEN sizes - common > 0 THEN common / (sizes - common) ELSE 0 END, 6) AS iou,
                 round(least(3 * sqrt(2 * s * s), sqrt((x3 + s - x1) * (x3 + s - x1) + (y3 + s - y1) * (y3 + s - y1)) + sqrt(2 * s * s) + sqrt((x1 + s - x3) * (x1 + s - x3) + (y1 + s - y3) * (y1 + s - y3))) / 3, 6) AS apart,
                 round(x1 * 640 / 1000, 6) AS px, round(y1 * 480 / 1000, 6) AS py FROM o""")
def m8_geometry(spark, d):
    """Length and box of a line, overlap of its box with a square, mean distance to the line moved by s both ways, and pixels."""
    moved = F.transform("line", lambda p: F.array(p[0] + F.col("s"), p[1] + F.col("s")))
    box, line = V.bounding_box(F.col("line")), F.col("line")
    square = F.array(box[0], box[1], box[0] + F.col("s"), box[1] + F.col("s"))
    pixels = V.scaled(line, F.lit(640.0), F.lit(480.0))[0]
    return _lines(spark, d).select(
        "k", F.round(V.polyline_length(line), 6).alias("length"), box[0].alias("west"), box[1].alias("south"), box[2].alias("east"), box[3].alias("north"), F.round(V.iou(box, square), 6).alias("iou"),
        F.round(V.symmetric_distance(line, moved), 6).alias("apart"), F.round(pixels[0], 6).alias("px"), F.round(pixels[1], 6).alias("py"),
    )


PAIRS = f"""{GEOMETRY}, n AS (SELECT *, k // 20 AS image, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) + sqrt((x3 - x2) * (x3 - x2) + (y3 - y2) * (y3 - y2)) AS len FROM g),
           h AS (SELECT a.image, a.k AS line_id, b.k AS other_id, a.len, sqrt((a.x3 - b.x3) * (a.x3 - b.x3) + (a.y3 - b.y3) * (a.y3 - b.y3)) AS ends, sqrt((a.x2 - b.x2) * (a.x2 - b.x2) + (a.y2 - b.y2) * (a.y2 - b.y2)) AS mid,
                 sqrt((a.x1 - b.x1) * (a.x1 - b.x1) + (a.y1 - b.y1) * (a.y1 - b.y1)) AS starts, sqrt((a.x1 - b.x3) * (a.x1 - b.x3) + (a.y1 - b.y3) * (a.y1 - b.y3)) AS back, sqrt((a.x3 - b.x1) * (a.x3 - b.x1) + (a.y3 - b.y1) * (a.y3 - b.y1)) AS forth
                 FROM n a JOIN n b ON a.image = b.image AND a.k <> b.k AND a.k % 2 = 0 AND b.k % 2 = 1)"""


def _line_pairs(spark, d):
    lines = _lines(spark, d)
    return lines.filter("k % 2 = 0").select("image", F.col("k").alias("line_id"), "line"), lines.filter("k % 2 = 1").select("image", F.col("k").alias("other_id"), F.col("line").alias("other"))


@query(f"""WITH {PAIRS} SELECT image, line_id, other_id FROM (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY ends, other_id) AS n FROM h WHERE ends <= 0.4 * len) WHERE n = 1""")
def j22_nearest_end(spark, d):
    """For lines of even numbers the line of an odd one that ends nearest."""
    return joins.nearest_end(*_line_pairs(spark, d), "image")


@query(f"""WITH {PAIRS} SELECT image, line_id, other_id, round(away, 6) AS distance FROM (SELECT *, least(starts + mid + ends, back + mid + forth) / 3 AS away, row_number() OVER (PARTITION BY line_id ORDER BY least(starts + mid + ends, back + mid + forth) / 3, other_id) AS n FROM h) WHERE n = 1 AND away <= 0.5 * len""")
def j24_best_match(spark, d):
    """For lines of even numbers the most alike of the odd ones."""
    return joins.best_match(*_line_pairs(spark, d), "image").withColumn("distance", F.round("distance", 6))


@query(f"""WITH {BOXES}, {PAIRS}, w AS (SELECT image, box_id AS worker, x, y, s, CASE box_id % 3 WHEN 0 THEN 'clipped' WHEN 1 THEN 'unclipped' ELSE 'unknown' END AS label FROM b),
          e AS (SELECT n.image, n.k AS line_id, n.*, w.worker, w.label AS state, row_number() OVER (PARTITION BY n.k ORDER BY w.s * w.s, w.worker) AS i FROM n LEFT JOIN w ON w.image = n.image AND n.x1 BETWEEN w.x AND w.x + w.s AND n.y1 BETWEEN w.y AND w.y + w.s WHERE n.k % 2 = 0),
          l AS (SELECT image, (k * 3 % 20) AS worker, k AS number, x1, y1, x2, y2, x3, y3, CASE k % 4 WHEN 1 THEN 'structure' WHEN 3 THEN 'body' ELSE 'not_visible' END AS hook FROM n WHERE k % 2 = 1),
          a AS (SELECT e.line_id, l.hook, row_number() OVER (PARTITION BY e.line_id ORDER BY sqrt((e.x3 - l.x3) * (e.x3 - l.x3) + (e.y3 - l.y3) * (e.y3 - l.y3)), l.number) AS j FROM e JOIN l ON l.image = e.image AND l.worker = e.worker
                WHERE e.i = 1 AND sqrt((e.x3 - l.x3) * (e.x3 - l.x3) + (e.y3 - l.y3) * (e.y3 - l.y3)) <= 0.4 * e.len),
          f AS (SELECT e.image, 'detected' AS origin, e.worker, e.line_id AS line, a.hook, CASE WHEN e.k % 3 = 0 THEN 'unknown' ELSE 'clear' END AS shape,
                CASE WHEN a.line_id IS NOT NULL THEN CASE a.hook WHEN 'structure' THEN 'structure' WHEN 'body' THEN 'not_structure' END ELSE CASE e.state WHEN 'clipped' THEN 'structure' WHEN 'unclipped' THEN 'not_structure' END END AS given, least(e.x1, e.x2, e.x3) AS west
                FROM e LEFT JOIN a ON a.line_id = e.line_id AND a.j = 1 WHERE e.i = 1
                UNION ALL SELECT l.image, 'answered', l.worker, l.number, l.hook, CASE WHEN l.number % 3 = 0 THEN 'unknown' ELSE 'clear' END, CASE l.hook WHEN 'structure' THEN 'structure' WHEN 'body' THEN 'not_structure' END, least(l.x1, l.x2, l.x3)
                FROM l WHERE (image, worker) IN (SELECT (image, worker) FROM w) AND (image, worker) NOT IN (SELECT (image, worker) FROM e WHERE i = 1 AND worker IS NOT NULL))
          SELECT image, origin, worker, line, hook, CASE WHEN shape <> 'unknown' THEN shape ELSE coalesce(given, 'unknown') END AS label, CASE WHEN shape <> 'unknown' THEN 'shape' WHEN given IS NOT NULL THEN 'answer' ELSE 'none' END AS source, west FROM f""")
def e12_decision_chain(spark, d):
    """Lines of even numbers as detected, those of odd ones as answers; boxes as workers."""
    boxes, _ = _boxes(spark, d)
    state = F.when(F.col("box_id") % 3 == 0, "clipped").when(F.col("box_id") % 3 == 1, "unclipped").otherwise("unknown")
    workers = boxes.select("image", F.col("box_id").alias("worker"), "box", state.alias("label"))
    lines = _lines(spark, d).withColumn("shape", F.when(F.col("k") % 3 == 0, "unknown").otherwise("clear"))
    detections = lines.filter("k % 2 = 0").select("image", F.col("k").alias("line_id"), "line", "shape")
    hook = F.when(F.col("k") % 4 == 1, "structure").when(F.col("k") % 4 == 3, "body").otherwise("not_visible")
    answers = lines.filter("k % 2 = 1").select("image", (F.col("k") * 3 % 20).alias("worker"), F.col("k").alias("number"), F.col("line").alias("points"), hook.alias("hook"), "shape")
    found = decisions.combine(detections, workers, answers)
    return found.select("image", "origin", "worker", "line", "hook", "label", "source", F.col("box")[0].alias("west"))


@query("""WITH r AS (SELECT l_orderkey AS chunk, 'n' || l_linenumber AS source, l_returnflag AS kind, 'n' || (l_partkey % 5) AS target, l_quantity > 5 AS quoted, l_orderkey * 10 + l_linenumber AS ord FROM lineitem),
          e AS (SELECT DISTINCT l_orderkey AS chunk, 'n' || l_linenumber AS name FROM lineitem),
          c AS (SELECT r.*, CASE WHEN kind NOT IN ('A', 'N') THEN 'kind' WHEN t.name IS NULL THEN 'endpoint' WHEN source = target THEN 'loop' WHEN NOT quoted THEN 'evidence' END AS reason
                FROM r LEFT JOIN e t ON t.chunk = r.chunk AND t.name = r.target)
          SELECT chunk, ord, CASE WHEN reason IS NULL AND row_number() OVER (PARTITION BY chunk, source, kind, target, reason IS NULL ORDER BY ord) > 1 THEN 'duplicate' ELSE reason END AS reason FROM c""")
def g11_relation_check(spark, d):
    """Why an extracted relation would be dropped: kind, ends, loops, evidence, copies."""
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("chunk"), F.concat(F.lit("n"), F.col("l_linenumber")).alias("source"), F.col("l_returnflag").alias("kind"), F.concat(F.lit("n"), F.col("l_partkey") % 5).alias("target"), (F.col("l_quantity") > 5).alias("quote_found"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord")
    )
    return validate.valid_relations(rows, rows.select("chunk", F.col("source").alias("name")), ["A", "N"]).select("chunk", "ord", "reason")


@query(r"""WITH t AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_quantity::INT END AS q, l_linenumber % 5 = 4 AS broken FROM lineitem)
          SELECT l_orderkey, l_linenumber, CASE WHEN broken OR q IS NULL THEN NULL ELSE q::BIGINT END AS quantity, q IS NOT NULL AND NOT broken AS whole FROM t""")
def m19_first_object(spark, d):
    """An object read out of free text around it; text without one, or with a broken one, gives null."""
    q, n = F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber")
    body = F.concat(F.lit('Answer: {"n": {"q": '), q, F.when(n % 5 == 4, "}").otherwise("}}"), F.lit(" as asked\n"))
    text = F.when(n % 3 == 0, "no object").otherwise(body)
    parsed = F.from_json(decisions.first_object(text), "n struct<q: bigint>")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", parsed.alias("p"))
    return rows.select("l_orderkey", "l_linenumber", F.col("p.n.q").alias("quantity"), F.col("p.n.q").isNotNull().alias("whole"))
