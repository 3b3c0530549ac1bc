"""Orders, ranks and window-like queries."""

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import filters, ranking
from ..schemas import table
from .registry import query


@query("""WITH h AS (SELECT doc_id, CAST((length(lower(text)) - length(replace(lower(text), 'license', ''))) // 7 AS BIGINT) AS hits FROM documents WHERE contains(lower(text), 'license'))
          SELECT doc_id, hits, rank FROM (SELECT *, row_number() OVER (ORDER BY hits DESC, doc_id) AS rank FROM h) WHERE rank <= 20""")
def w1_keyword_ranking(spark, d):
    docs = table(spark, d, "documents").filter(T.contains_all(F.col("text"), ["license"]))
    hits = docs.select("doc_id", T.occurrences(F.col("text"), "license").alias("hits"))
    return filters.ranked(hits, [F.desc("hits"), F.col("doc_id")], 20)


@query("""WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS a, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS b FROM orders),
          u AS (SELECT o_orderkey, 1.0 / (60 + a) AS s, 0 AS o, 'price' AS c FROM r WHERE a <= 200 UNION ALL SELECT o_orderkey, 1.0 / (60 + b), 1, 'date' FROM r WHERE b <= 200),
          f AS (SELECT o_orderkey, sum(s) AS score, string_agg(c, '+' ORDER BY o) AS channels FROM u GROUP BY o_orderkey)
          SELECT o_orderkey, round(score, 6) AS score, channels, rank FROM (SELECT *, row_number() OVER (ORDER BY round(score, 12) DESC, o_orderkey) AS rank FROM f) WHERE rank <= 200""")
def w4_rrf_fusion(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    rankings = {"price": filters.ranked(orders, [F.desc("o_totalprice"), F.col("o_orderkey")], 200), "date": filters.ranked(orders, [F.desc("o_orderdate"), F.col("o_orderkey")], 200)}
    return ranking.fuse(rankings, "o_orderkey").withColumn("score", F.round("score", 6))


@query("""WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS a, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS b FROM orders),
          u AS (SELECT o_orderkey, 1.0 / (60 + a) AS s FROM r WHERE a <= 200 UNION ALL SELECT o_orderkey, 1.0 / (60 + b) FROM r WHERE b <= 200)
          SELECT o_orderkey, round(sum(s), 6) AS score FROM u GROUP BY o_orderkey""")
def w7_uncapped_fusion(spark, d):
    """The fused list isn't cut: up to twice as many rows as a ranking has."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    rankings = {"price": filters.ranked(orders, [F.desc("o_totalprice"), F.col("o_orderkey")], 200), "date": filters.ranked(orders, [F.desc("o_orderdate"), F.col("o_orderkey")], 200)}
    fused = ranking.fused_scores(rankings, "o_orderkey")
    return fused.select("o_orderkey", F.round("score", 6).alias("score"))


@query("""WITH c AS (SELECT l_partkey, count(*) AS cited FROM lineitem GROUP BY 1)
          SELECT p_partkey, cited, rank FROM (SELECT p_partkey, cited, row_number() OVER (ORDER BY cited DESC, starts_with(p_name, 'red') DESC, p_partkey) AS rank FROM c JOIN part ON p_partkey = l_partkey) WHERE rank <= 6""")
def w8_law_ranking(spark, d):
    """Most cited first, of equals those whose title is matched, then by key."""
    cited = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("cited"))
    titled = cited.join(table(spark, d, "part"), "p_partkey").withColumn("titled", F.startswith("p_name", F.lit("red")))
    return filters.ranked(titled, [F.desc("cited"), F.desc("titled"), F.col("p_partkey")], 6).select("p_partkey", "cited", "rank")


@query("""WITH c AS (SELECT p_name AS surface, count(*) AS df, min(p_partkey) AS ord FROM part GROUP BY 1)
          SELECT surface, df, rank FROM (SELECT *, row_number() OVER (ORDER BY df, length(surface) DESC, ord) AS rank FROM c) WHERE rank <= 8""")
def w9_concept_ranking(spark, d):
    concepts = table(spark, d, "part").groupBy(F.col("p_name").alias("surface")).agg(F.count(F.lit(1)).alias("df"), F.min("p_partkey").alias("ord"))
    return filters.ranked(concepts, [F.col("df"), F.desc(F.length("surface")), F.col("ord")], 8).select("surface", "df", "rank")


@query("""WITH t AS (SELECT p_partkey, CAST(contains(p_name, 'red') AS INTEGER) + CAST(contains(p_name, 'widget') AS INTEGER) AS hits,
                  list_position(['SMALL', 'ECONOMY', 'STANDARD', 'LARGE', 'PROMO'], p_type) AS tier, p_retailprice FROM part)
          SELECT p_partkey, CAST(hits AS BIGINT) AS hits, rank FROM (SELECT *, row_number() OVER (ORDER BY hits DESC, coalesce(tier, 0), p_retailprice, p_partkey) AS rank FROM t) WHERE rank <= 50""")
def w16_tiered_order_topn(spark, d):
    """Matches first, then by tier in a given order, then by value and key."""
    tiers = F.array(*map(F.lit, ("SMALL", "ECONOMY", "STANDARD", "LARGE", "PROMO")))
    hits = (F.contains("p_name", F.lit("red")).cast("bigint") + F.contains("p_name", F.lit("widget")).cast("bigint")).alias("hits")
    rows = table(spark, d, "part").select("p_partkey", "p_retailprice", hits, F.array_position(tiers, F.col("p_type")).alias("tier"))
    return filters.ranked(rows, [F.desc("hits"), F.col("tier"), F.col("p_retailprice"), F.col("p_partkey")], 50).select("p_partkey", "hits", "rank")


@query("""WITH t AS (SELECT p_partkey, p_retailprice, CASE p_size % 3 WHEN 0 THEN translate(p_name, 'aeioubcdst', '가거고구기나너노漢한') WHEN 1 THEN upper(p_name) ELSE p_name END AS title FROM part)
          SELECT p_partkey, title, rank FROM (SELECT p_partkey, title, row_number() OVER (ORDER BY title COLLATE ko, p_partkey) AS rank FROM t)""")
def w17_collated_titles(spark, d):
    """All titles in Korean collation: Hangul and Hanja before Latin letters, lower case before upper case of the same word."""
    size = F.col("p_size") % 3
    title = F.when(size == 0, F.translate("p_name", "aeioubcdst", "가거고구기나너노漢한")).when(size == 1, F.upper("p_name")).otherwise(F.col("p_name"))
    titles = table(spark, d, "part").select("p_partkey", title.alias("title"))
    return ranking.numbered(titles, [ranking.by_title(F.col("title")), F.col("p_partkey")], "%d", "rank").withColumn("rank", F.col("rank").cast("bigint") + 1)


@query("""WITH m AS (SELECT p_name AS key, count(*) AS mentions FROM part GROUP BY 1)
          SELECT key, mentions, printf('n%06d', row_number() OVER (ORDER BY mentions DESC, key) - 1) AS id FROM m""")
def w18_numbered_ids(spark, d):
    mentions = table(spark, d, "part").groupBy(F.col("p_name").alias("key")).agg(F.count(F.lit(1)).alias("mentions"))
    return ranking.numbered(mentions, [F.desc("mentions"), F.col("key")], "n%06d", "id").select("key", "mentions", "id")


@query("""SELECT conv_id, turn, row_number() OVER w AS position, count(*) OVER (PARTITION BY conv_id) AS siblings, lag(turn) OVER w AS previous, lead(turn) OVER w AS following
          FROM (SELECT DISTINCT conv_id, turn FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def w20_sibling_position(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", "turn").distinct()
    return ranking.siblings(turns, "conv_id", ["turn"], "turn")


@query("""SELECT doc_id, CAST(total AS BIGINT) AS total FROM (SELECT doc_id, sum(n_chars) OVER (PARTITION BY source, lang ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS total FROM documents) WHERE total <= 20000""")
def w22_greedy_budget(spark, d):
    docs = table(spark, d, "documents").select("source", "lang", "doc_id", "n_chars")
    return ranking.within_budget(docs, ["source", "lang"], ["doc_id"], "n_chars", 20_000).select("doc_id", "total")


@query("""SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1""")
def w23_first_wins(spark, d):
    orders = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus")
    return ranking.first_wins(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders GROUP BY o_custkey")
def w24_last_wins(spark, d):
    return ranking.last_wins(table(spark, d, "orders"), ["o_custkey"], "o_orderpriority", "o_orderkey")


@query()
def w26_suppress_overlaps(spark, d):
    """Boxes made of rows of part; which ones stay depends on those before, so tests hold this against a plain loop."""
    k = F.col("p_partkey")
    x, y = (k * 37 % 200).cast("double"), (k * 53 % 200).cast("double")
    boxes = table(spark, d, "part").select(F.concat(F.lit("image"), (k / F.lit(40)).cast("int").cast("string")).alias("image"), (k % 40).cast("int").alias("idx"), F.array(x, y, x + 60.0, y + 60.0).alias("box"), (k * 7 % 101 / 101.0).alias("conf"))
    return ranking.suppress_overlaps(boxes)


@query("""WITH c AS (SELECT s_suppkey, substring('CRGL', CAST(s_suppkey % 4 + 1 AS INTEGER), 1) || CAST(s_suppkey * 7 % 90 AS VARCHAR) AS code FROM supplier)
          SELECT s_suppkey, code, rank FROM (SELECT *, row_number() OVER (ORDER BY strpos('CRGL', code[1]), CAST(code[2:] AS INTEGER), s_suppkey) AS rank FROM c) WHERE rank <= 100""")
def w27_natural_order(spark, d):
    """C2 before C10 before R1."""
    letter = F.element_at(F.array(*map(F.lit, "CRGL")), (F.col("s_suppkey") % 4 + 1).cast("int"))
    codes = table(spark, d, "supplier").select("s_suppkey", F.concat(letter, (F.col("s_suppkey") * 7 % 90).cast("string")).alias("code"))
    return filters.ranked(codes, [*ranking.natural_order(F.col("code"), "CRGL"), F.col("s_suppkey")], 100)


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS number FROM events WHERE event_type = 'error'")
def w28_run_numbering(spark, d):
    errors = table(spark, d, "events").filter("event_type = 'error'")
    return filters.ranked(errors, [F.col("ts"), F.col("event_id")], by=["user_id"], name="number").select("event_id", "number")


@query("""WITH a AS (SELECT p_brand, min(p_partkey) AS seen FROM part GROUP BY 1)
          SELECT p_partkey, rank FROM (SELECT p_partkey, row_number() OVER (ORDER BY seen, list_position(['LARGE', 'SMALL'], p_type) IS NULL, list_position(['LARGE', 'SMALL'], p_type), p_partkey) AS rank FROM part JOIN a USING (p_brand)) WHERE rank <= 60""")
def w25_grouped_by_first_seen(spark, d):
    """Groups in order of their first row, in a group by status in a given order."""
    parts = table(spark, d, "part").select("p_partkey", "p_brand", "p_type")
    seen = parts.groupBy("p_brand").agg(F.min("p_partkey").alias("seen"))
    place = F.array_position(F.array(F.lit("LARGE"), F.lit("SMALL")), F.col("p_type"))
    status = F.when(place == 0, 3).otherwise(place)
    return filters.ranked(parts.join(seen, "p_brand"), [F.col("seen"), status, F.col("p_partkey")], 60).select("p_partkey", "rank")


@query("""SELECT p_brand AS community, size, printf('c%04d', row_number() OVER (ORDER BY size DESC, p_brand) - 1) AS id FROM (SELECT p_brand, count(*) AS size FROM part GROUP BY 1)""")
def w19_numbered_communities(spark, d):
    members = table(spark, d, "part").select(F.col("p_brand").alias("community"))
    return ranking.numbered_by_size(members, "community", "c%04d", "id").select("community", "size", "id")
