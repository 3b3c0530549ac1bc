"""Reshaping: HTML tables, long and wide, nested and flat, links."""

from pyspark.sql import functions as F

from ..operators import reshape
from ..schemas import table
from .registry import query


def _pages(spark, d):
    """A page with one table for each part: a head that spans two columns, and a body cell that spans two rows."""
    c = lambda name: F.col(name).cast("string")
    head = F.concat(F.lit('<tr><th colspan="2">'), c("p_name"), F.lit("</th><th>2024년</th><th>계</th></tr>"))
    first = F.concat(F.lit('<tr><td rowspan="2">'), c("p_brand"), F.lit("</td><td>size</td><td>"), c("p_size"), F.lit("</td><td> <b>x</b> </td></tr>"))
    second = F.concat(F.lit("<tr><td>type</td><td>"), c("p_type"), F.lit("</td><td>y</td></tr>"))
    return table(spark, d, "part").select("p_partkey", F.concat(F.lit("<p>1</p><table>"), head, first, second, F.lit("</table>")).alias("html"))


GRID = """g AS (SELECT p_partkey, unnest([(0, 0, p_name), (0, 1, p_name), (0, 2, '2024년'), (0, 3, '계'), (1, 0, p_brand), (1, 1, 'size'), (1, 2, CAST(p_size AS VARCHAR)), (1, 3, 'x'),
                (2, 0, p_brand), (2, 1, 'type'), (2, 2, p_type), (2, 3, 'y')]) AS c FROM part)"""


@query(f"WITH {GRID} SELECT p_partkey, 0 AS table_no, c[1] AS row_no, c[2] AS col_no, c[3] AS cell FROM g")
def x1_html_table_grid(spark, d):
    return reshape.table_cells(_pages(spark, d), "p_partkey", "html")


@query("""WITH g AS (SELECT p_partkey, unnest([(0, 0, 'a'), (0, 1, 'b'), (0, 2, p_brand), (1, 0, 'c'), (1, 1, p_type), (1, 2, p_type), (2, 0, 'e'), (2, 1, ''), (2, 2, p_brand)]) AS c FROM part)
          SELECT p_partkey, 0 AS table_no, c[1] AS row_no, c[2] AS col_no, c[3] AS cell FROM g""")
def x1_html_table_spans(spark, d):
    """Spans that overlap, a span longer than its table, and a gap; tables without cells don't count."""
    c = F.col
    first = F.concat(F.lit("<table></table><table><tr><td>a</td><td>b</td><td rowspan=100000000>"), c("p_brand"), F.lit("</td></tr>"))
    rest = F.concat(F.lit("<tr><td>c</td><td colspan='2'>"), c("p_type"), F.lit("</td></tr><tr><td>e</td></tr></table>"))
    return reshape.table_cells(table(spark, d, "part").select("p_partkey", F.concat(first, rest).alias("html")), "p_partkey", "html")


@query("""SELECT p_partkey, 0 AS table_no, unnest([1, 1, 2, 2]) AS row_no, p_brand || ' > ' || unnest(['size', 'size', 'type', 'type']) AS label, unnest(['2024년', '계', '2024년', '계']) AS period,
          unnest([CAST(p_size AS VARCHAR), 'x', p_type, 'y']) AS value FROM part""")
def x2_long_facts(spark, d):
    return reshape.long_facts(reshape.table_cells(_pages(spark, d), "p_partkey", "html"), "p_partkey")


YEARS = [str(y) for y in range(1993, 1998)]


@query(f"""SELECT o_custkey, {", ".join(f'arg_max(o_orderstatus, o_orderkey) FILTER (WHERE year(o_orderdate) = {y}) AS "{y}"' for y in YEARS)} FROM orders GROUP BY o_custkey""")
def x3_long_to_wide(spark, d):
    """One row per customer, a column per year: the status of the last order."""
    facts = table(spark, d, "orders").select("o_custkey", F.year("o_orderdate").cast("string").alias("year"), "o_orderstatus", "o_orderkey")
    return reshape.wide(facts, "o_custkey", "year", "o_orderstatus", "o_orderkey", YEARS)


@query("""SELECT user_id AS session, CAST(day(ts) AS INTEGER) AS seq, event_type AS action, CAST(count(*) AS BIGINT) AS n, CAST(max(place) AS INTEGER) AS last_place FROM
          (SELECT *, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id) - 1 AS place FROM events) GROUP BY ALL""")
def x4_flat_events(spark, d):
    """Batches of a user's events of a day, opened again."""
    events = table(spark, d, "events").select(F.col("user_id").alias("session"), F.dayofmonth("ts").alias("seq"), F.to_date("ts").alias("received"), F.struct("event_id", F.col("event_type").alias("action")).alias("e"))
    batches = events.groupBy("session", "seq", "received").agg(F.array_sort(F.collect_list("e")).alias("events"))
    return reshape.flat_events(batches).groupBy("session", "seq", "action").agg(F.count(F.lit(1)).alias("n"), F.max("place").alias("last_place"))


@query("""SELECT p_partkey, name, trim(value) AS value FROM (SELECT p_partkey, 'p_name' AS name, unnest(string_split(p_name, ' ')) AS value FROM part UNION ALL SELECT p_partkey, 'p_size', CAST(p_size AS VARCHAR) FROM part) WHERE trim(value) <> ''""")
def x6_labels_to_long(spark, d):
    return reshape.melted(table(spark, d, "part"), "p_partkey", ["p_name", "p_size"], " ")


@query("""SELECT p_partkey, '{"name":"' || p_name || '","spec":{"size":' || p_size || ',"tags":["' || p_type || '","' || p_brand || '"],"note":null}}' AS document FROM part""")
def x8_nested_json(spark, d):
    """A typed document with its keys in a fixed order."""
    spec = F.struct(F.col("p_size").alias("size"), F.array("p_type", "p_brand").alias("tags"), F.lit(None).cast("string").alias("note"))
    return table(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"), spec.alias("spec")).select("p_partkey", reshape.fixed_json("name", "spec").alias("document"))


@query("""SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"[^>]*>([^<]*)</a>', 1)) AS href, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"[^>]*>([^<]*)</a>', 2)) AS label FROM pages""")
def t16_links(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(reshape.links(F.col("html"))).alias("link")).select("page_id", "link.href", "link.label")


@query("""SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '/([a-z]{2})/([0-9]+)', 2) AS number FROM pages""")
def t15_extracted_ids(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"), F.regexp_extract("url", "/([a-z]{2})/([0-9]+)", 2).alias("number"))


@query("""SELECT p_partkey, unnest([p_size, p_size + 1]) AS number, unnest([p_brand, p_type]) AS label FROM part""")
def t17_sub_records(spark, d):
    """Records "number@label|number@label" opened."""
    text = F.concat(F.col("p_size").cast("string"), F.lit("@"), "p_brand", F.lit("|"), (F.col("p_size") + 1).cast("string"), F.lit("@"), "p_type", F.lit("|"))
    rows = table(spark, d, "part").select("p_partkey", F.explode(reshape.sub_records(text, r"\|", "@")).alias("r"))
    return rows.select("p_partkey", F.col("r.first").cast("int").alias("number"), F.col("r.second").alias("label"))


@query("""SELECT event_id, CASE WHEN v = '' THEN 'empty' WHEN v IN ('True', 'False') THEN 'boolean' WHEN contains(v, '.') AND TRY_CAST(v AS DOUBLE) IS NOT NULL THEN 'float' WHEN TRY_CAST(v AS BIGINT) IS NOT NULL THEN 'integer' ELSE 'text' END AS kind
          FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'True' WHEN 2 THEN CAST(event_id AS VARCHAR) || '.5' WHEN 3 THEN CAST(event_id AS VARCHAR) ELSE event_type END AS v FROM events)""")
def m21_cell_types(spark, d):
    from ..schemas import typed_cell

    i = F.col("event_id")
    v = F.when(i % 5 == 0, "").when(i % 5 == 1, "True").when(i % 5 == 2, F.concat(i.cast("string"), F.lit(".5"))).when(i % 5 == 3, i.cast("string")).otherwise(F.col("event_type"))
    return table(spark, d, "events").select("event_id", v.alias("v")).select("event_id", typed_cell(F.col("v"))["kind"].alias("kind"))


@query("""SELECT user_id, string_agg(DISTINCT event_type, ';' ORDER BY event_type) AS kinds, count(*) FILTER (WHERE event_type = 'click') AS clicks FROM events GROUP BY user_id""")
def x5_nested_to_wide(spark, d):
    """Lists of a nested batch as columns, joined by semicolons."""
    events = table(spark, d, "events").groupBy("user_id").agg(F.collect_list("event_type").alias("e"))
    return events.select("user_id", F.array_join(F.array_sort(F.array_distinct("e")), ";").alias("kinds"), F.size(F.filter("e", lambda x: x == "click")).cast("bigint").alias("clicks"))


@query(r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"[^>]*>([^<]*)</a>', 1)) AS href FROM pages)
          SELECT href, count(*) AS editions, min(page_id) AS first_page, max(page_id) AS latest_page FROM l GROUP BY href""")
def x10_link_index(spark, d):
    """One row per linked file: how many pages have it, the first and the latest one."""
    rows = table(spark, d, "pages").select("page_id", F.explode(reshape.links(F.col("html"))).alias("link")).select("page_id", "link.href")
    return rows.groupBy("href").agg(F.count(F.lit(1)).alias("editions"), F.min("page_id").alias("first_page"), F.max("page_id").alias("latest_page"))


@query(r"""SELECT page_id, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, hex(encode(substring(html, 1, 4))) AS magic, CAST(regexp_extract(html, 'track\(([0-9]+)\)', 1) AS BIGINT) AS number FROM pages""")
def x12_page_parse(spark, d):
    """Language, first bytes and number of a page."""
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"), F.hex(F.encode(F.substring("html", 1, 4), "UTF-8")).alias("magic"), F.regexp_extract("html", r"track\(([0-9]+)\)", 1).cast("bigint").alias("number"))
