"""Aggregations."""

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..schemas import table
from .registry import query


@query("""SELECT count(*) AS n_rows, sum(k) AS n_children, count(*) FILTER (WHERE k > 0) AS with_children, count(*) FILTER (WHERE c_acctbal > 0) AS filled,
                 count(*) FILTER (WHERE (c_custkey % 12) <> k) AS mismatched, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS segments
          FROM (SELECT c.*, coalesce(k, 0) AS k FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS k FROM orders GROUP BY 1) ON o_custkey = c_custkey)""")
def a2_profile(spark, d):
    counts = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("k"))
    rows = table(spark, d, "customer").join(counts, "c_custkey", "left").na.fill(0, ["k"])
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("k").cast("decimal(38,0)").alias("n_children"), F.count_if(F.col("k") > 0).alias("with_children"), F.count_if(F.col("c_acctbal") > 0).alias("filled"),
        F.count_if(F.col("c_custkey") % 12 != F.col("k")).alias("mismatched"), F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ",").alias("segments"),
    ).withColumn("n_children", F.col("n_children").cast("bigint"))


@query("SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY p_brand, p_type")
def a3_scope_counts(spark, d):
    return table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH m AS (SELECT p_brand AS key, string_split(p_type, ' ')[1] AS type, p_name, p_partkey FROM part)
          SELECT key, type, arg_min(p_name, p_partkey) AS name, count(*) AS mentions, count(DISTINCT p_name) AS n_names FROM m GROUP BY key, type""")
def a9_entity_merge(spark, d):
    from ..operators.graph import merge_nodes

    first = F.split_part("p_type", F.lit(" "), F.lit(1))
    mentions = table(spark, d, "part").select(F.col("p_name").alias("name"), first.alias("type"), F.col("p_partkey").cast("string").alias("chunk"), F.col("p_brand").alias("document"), F.col("p_type").alias("description"), F.lit("stage1").alias("stage"), F.col("p_partkey").alias("ord"))
    return merge_nodes(mentions, F.col("document")).select("key", "type", "name", "mentions", (F.size("aliases") + 1).cast("bigint").alias("n_names"))


def _item_mentions(spark, d):
    """Suppliers as lines of orders mention them."""
    line = F.concat_ws("-", "l_orderkey", "l_linenumber")
    return table(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("name"), F.col("l_returnflag").alias("type"), line.alias("chunk"), F.col("l_orderkey").alias("document"), F.lit("").alias("description"), F.lit("stage1").alias("stage"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))


@query("""SELECT CAST(l_suppkey AS VARCHAR) AS key, l_returnflag AS type, l_orderkey AS document, concat_ws('-', l_orderkey, l_linenumber) AS chunk, count(*) AS mentions, min(l_orderkey * 10 + l_linenumber) AS ord
          FROM lineitem GROUP BY 1, 2, 3, 4""")
def a9_entity_links(spark, d):
    from ..operators.graph import node_links

    return node_links(_item_mentions(spark, d), F.col("name"))


@query("""SELECT CAST(l_suppkey AS VARCHAR) AS key, l_returnflag AS type, count(*) AS mentions, count(DISTINCT concat_ws('-', l_orderkey, l_linenumber)) AS n_chunks, count(DISTINCT l_orderkey) AS n_documents
          FROM lineitem GROUP BY 1, 2""")
def a9_entity_counts(spark, d):
    from ..operators.graph import merge_nodes

    return merge_nodes(_item_mentions(spark, d), F.col("name"), lists=False).select("key", "type", "mentions", "n_chunks", "n_documents")


@query("""WITH r AS (SELECT l_suppkey AS source, l_partkey AS target, l_returnflag AS label, l_orderkey * 10 + l_linenumber AS ord FROM lineitem),
          c AS (SELECT source, target, label, count(*) AS n, min(ord) AS o FROM r GROUP BY ALL)
          SELECT source, target, CAST(sum(n) AS BIGINT) AS weight, arg_max(label, (n, -o)) AS label FROM c WHERE source <> target GROUP BY source, target""")
def a10_edge_merge(spark, d):
    from ..operators.graph import merge_edges

    relations = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"), F.lit("supplies").alias("type"), F.col("l_returnflag").alias("label"), F.lit("").alias("evidence"), F.lit("stage1").alias("stage"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return merge_edges(relations).select("source", "target", "weight", "label")


@query("""WITH n AS (SELECT n_regionkey AS region, c_mktsegment AS value, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2)
          SELECT region, value, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY n DESC, value) AS rank FROM n) WHERE rank <= 3""")
def a13_top_k_per_group(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("region"), F.col("c_mktsegment").alias("value"))
    return A.top_per_group(rows, "region", "value", 3)


@query("""SELECT ord, s.status, coalesce(n, 0) AS n FROM (VALUES (0, 'F'), (1, 'O'), (2, 'P'), (3, 'X')) s(ord, status)
          LEFT JOIN (SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1) c ON c.status = s.status""")
def a16_zero_filled_status(spark, d):
    return A.zero_filled(table(spark, d, "orders").select(F.col("o_orderstatus").alias("status")), "status", ["F", "O", "P", "X"]).withColumn("ord", F.col("ord").cast("int"))


@query("""WITH s AS (SELECT n_chars % 1000 / 1000.0 AS conf, quality FROM documents LEFT JOIN labels USING (doc_id)),
          b AS (SELECT CASE WHEN conf >= 0.25 AND conf < 0.4 THEN '0.25-0.4' WHEN conf >= 0.4 AND conf < 0.6 THEN '0.4-0.6' WHEN conf >= 0.6 AND conf < 0.8 THEN '0.6-0.8' WHEN conf >= 0.8 THEN '0.8-1.01' END AS band, quality FROM s)
          SELECT band, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS agreed, round(count(*) FILTER (WHERE quality = 1) / nullif(count(quality), 0), 3) AS ratio FROM b WHERE band IS NOT NULL GROUP BY band""")
def a18_calibration_bands(spark, d):
    scored = table(spark, d, "documents").select("doc_id", (F.col("n_chars") % 1000 / 1000.0).alias("conf")).join(table(spark, d, "labels"), "doc_id", "left")
    return A.calibration(scored, F.col("conf"), F.col("quality") == 1)


@query("""WITH c AS (SELECT o_orderpriority AS provider, CASE WHEN CAST(o_orderdate AS DATE) = DATE '1995-03-15' OR o_orderstatus = 'P' THEN CAST(round(o_totalprice * 100) AS BIGINT) ELSE 0 END AS x FROM orders)
          SELECT provider, CAST(sum(x) AS BIGINT) AS spent FROM c GROUP BY provider UNION ALL SELECT 'all', CAST(sum(x) AS BIGINT) FROM c""")
def a22_conditional_spend(spark, d):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    charges = table(spark, d, "orders").select(F.col("o_orderpriority").alias("provider"), day.alias("started"), F.when(F.col("o_orderstatus") != "P", day).alias("finished"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("amount"))
    return A.spend(charges, "1995-03-15")


@query("""SELECT strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1""")
def a23_daily_counter(spark, d):
    from ..streaming.events import local_day

    return table(spark, d, "events").groupBy(local_day(F.col("ts")).cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS shown, count(*) FILTER (WHERE event_type IN ('click', 'purchase')) AS clicked,
                 round(count(*) FILTER (WHERE event_type IN ('click', 'purchase')) / nullif(count(*) FILTER (WHERE event_type = 'view'), 0), 4) AS rate FROM events GROUP BY user_id""")
def a24_ctr(spark, d):
    kind = F.col("event_type")
    return A.click_rate(table(spark, d, "events"), "user_id", kind == "view", kind.isin("click", "purchase"))


@query("""SELECT DISTINCT split_part(source, '(', 1) AS source, lang FROM documents""")
def a25_distinct_values(spark, d):
    return table(spark, d, "documents").select(F.split_part("source", F.lit("("), F.lit(1)).alias("source"), "lang").distinct()


@query("""WITH h AS (SELECT substring(p_brand, 1, 7) AS section, p_brand AS division, bool_or(p_size > 48) AS hit FROM part GROUP BY 1, 2),
          a AS (SELECT section, bool_and(hit) AS every FROM h GROUP BY section)
          SELECT DISTINCT a.section, CASE WHEN every THEN a.section ELSE division END AS value FROM a JOIN h ON h.section = a.section WHERE hit""")
def a26_section_roll_up(spark, d):
    divisions = table(spark, d, "part").groupBy(F.substring("p_brand", 1, 7).alias("section"), F.col("p_brand").alias("division")).agg(F.bool_or(F.col("p_size") > 48).alias("hit"))
    return A.roll_up_sections(divisions, "section", "division", F.col("hit"))


@query("""SELECT p_brand, arg_min(p_name, p_partkey) AS name, count(*) AS n FROM part WHERE contains(p_name, 'red') OR contains(p_name, 'gear') GROUP BY p_brand""")
def a28_keyword_dedup(spark, d):
    parts = table(spark, d, "part")
    found = parts.filter("contains(p_name, 'red')").withColumn("word", F.lit("red")).unionByName(parts.filter("contains(p_name, 'gear')").withColumn("word", F.lit("gear")))
    one = A.keyword_hits(found, "p_brand", "word", "p_partkey", ["p_name"])
    sizes = found.select("p_brand", "p_partkey").distinct().groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    return one.join(sizes, "p_brand").select("p_brand", F.col("p_name").alias("name"), "n")


@query("""WITH f AS (SELECT doc_id, toxic FROM labels), g AS (SELECT coalesce(CAST(toxic AS VARCHAR), 'all') AS set_name, count(*) AS n FROM f GROUP BY ROLLUP (toxic)) SELECT set_name, n FROM g""")
def a19_label_statistics(spark, d):
    return table(spark, d, "labels").rollup("toxic").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce(F.col("toxic").cast("string"), F.lit("all")).alias("set_name"), "n")


@query("""WITH o AS (SELECT doc_id, unnest(CASE WHEN quality IS NULL AND toxic IS NULL THEN ['quality', 'toxic'] WHEN quality IS NULL THEN ['quality'] WHEN toxic IS NULL THEN ['toxic'] ELSE [] END) AS field, n_chars
          FROM documents LEFT JOIN labels USING (doc_id)) SELECT field, count(*) AS open_items, min(n_chars) AS first_rank FROM o GROUP BY field""")
def a17_next_questions(spark, d):
    """Fields that are missing for most items, with the least rank of those items."""
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in ("quality", "toxic")]))
    return rows.select("n_chars", F.explode(missing).alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("open_items"), F.min("n_chars").alias("first_rank"))


@query("""SELECT stage, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS stage FROM part) GROUP BY stage""")
def a12_set_histogram(spark, d):
    """Nodes by each member of a set-valued column."""
    return table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("stage")).groupBy("stage").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT lang, count(*) AS n, count(*) FILTER (WHERE n_chars > 200) AS substantive, CAST(sum(n_chars) AS BIGINT) AS chars, round(avg(n_chars) FILTER (WHERE n_chars > 200), 3) AS mean FROM documents GROUP BY lang""")
def a21_extraction_statistics(spark, d):
    docs = table(spark, d, "documents")
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_chars") > 200).alias("substantive"), F.sum("n_chars").alias("chars"), F.round(F.avg(F.when(F.col("n_chars") > 200, F.col("n_chars"))), 3).alias("mean"))


@query("""SELECT n_name, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name""")
def a27_category_counts(spark, d):
    counts = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"))
    return table(spark, d, "nation").join(counts, "n_nationkey", "left").select("n_name", F.coalesce("n", F.lit(0)).alias("n"))


@query("""SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'parts', count(*) FROM part UNION ALL SELECT 'pages', count(*) FROM pages""")
def a29_row_counts(spark, d):
    counts = [table(spark, d, t).agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n")) for n, t in (("orders", "orders"), ("parts", "part"), ("pages", "pages"))]
    return counts[0].unionAll(counts[1]).unionAll(counts[2])
