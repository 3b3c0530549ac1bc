"""Filters, facets, text predicates, integrity checks."""

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import filters, validate
from ..schemas import table
from .registry import query


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
def f1_equality_filter(spark, d):
    return filters.equals(table(spark, d, "customer"), {"c_mktsegment": "BUILDING", "c_name": ""}).select("c_custkey", "c_name")


@query("""SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority IN ('1-URGENT', '2-HIGH')
          ORDER BY o_orderkey LIMIT 20 OFFSET 40""")
def f2_multiselect_filter_page(spark, d):
    found = filters.any_of(table(spark, d, "orders"), {"o_orderstatus": ["F", "O"], "o_orderpriority": ["1-URGENT", "2-HIGH"], "o_custkey": []})
    return filters.page(found, [F.col("o_orderkey")], 3, 20).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("""SELECT CASE WHEN l.quality = 0 THEN 'mismatch' WHEN l.quality = 1 THEN 'matched' ELSE 'unverified' END AS status, count(*) AS n
          FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1""")
def f3_quality_status_counts(spark, d):
    joined = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    flag = F.when(F.col("quality") == 0, "true").when(F.col("quality") == 1, "false").otherwise("")
    return joined.groupBy(filters.quality_status(flag).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT doc_id, CAST((length(lower(text)) - length(replace(lower(text), 'the', ''))) // 3 AS BIGINT) AS hits
          FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'license')""")
def f5_keyword_and_search(spark, d):
    docs = table(spark, d, "documents")
    return docs.filter(T.contains_all(F.col("text"), ["the", "license"])).select("doc_id", T.occurrences(F.col("text"), "the").alias("hits"))


@query("""SELECT p_partkey, p_name FROM part WHERE contains(regexp_replace(lower(concat_ws(' ', p_name, p_type)), '\\s+', '', 'g'), 'gearstandard')""")
def f6_whitespace_insensitive_search(spark, d):
    return table(spark, d, "part").filter(filters.squeezed_contains([F.col("p_name"), F.col("p_type")], "Gear  STAN dard")).select("p_partkey", "p_name")


@query("SELECT count(*) AS n, CAST(year(min(o_orderdate)) AS BIGINT) AS y FROM orders WHERE CAST(year(o_orderdate) AS VARCHAR) = '1995'")
def f7_year_filter(spark, d):
    return table(spark, d, "orders").filter(filters.year_is(F.year("o_orderdate"), "1995")).agg(F.count(F.lit(1)).alias("n"), F.year(F.min("o_orderdate")).cast("bigint").alias("y"))


@query("""SELECT CASE WHEN regexp_matches(lower(text), 'licen[sc]e') THEN 'licence' WHEN regexp_matches(text, '[A-Za-z0-9._]+@[A-Za-z0-9]+') THEN 'contact'
          WHEN regexp_matches(text, '[0-9]{4}') THEN 'figures' ELSE 'other' END AS kind, count(*) AS n FROM documents WHERE NOT regexp_matches(text, '^THE') GROUP BY 1""")
def f13_case_classify(spark, d):
    rules = [("(?i)licen[sc]e", "licence"), ("[A-Za-z0-9._]+@[A-Za-z0-9]+", "contact"), ("[0-9]{4}", "figures")]
    docs = table(spark, d, "documents").filter(~F.col("text").rlike("^THE"))
    return docs.groupBy(T.classify(F.col("text"), rules, "other").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O'
          AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')) GROUP BY l_orderkey""")
def f19_visible_files(spark, d):
    customers = table(spark, d, "customer").withColumnRenamed("c_custkey", "o_custkey")
    orders = filters.visible(table(spark, d, "orders"), customers, "o_custkey", F.col("c_mktsegment") == "BUILDING").withColumnRenamed("o_orderkey", "l_orderkey")
    return filters.visible(table(spark, d, "lineitem"), orders, "l_orderkey", F.col("o_orderstatus") == "O").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey FROM part WHERE list_has_any(string_split(p_type, ' '), ['PROMO', 'SMALL'])")
def f21_array_overlap(spark, d):
    return table(spark, d, "part").filter(filters.overlap(F.split("p_type", " "), ["PROMO", "SMALL"])).select("p_partkey")


@query("""SELECT 'p_brand' AS facet, p_brand AS value, count(*) FILTER (WHERE p_size IN (1, 2, 3)) AS n FROM part GROUP BY p_brand UNION ALL
          SELECT 'size', CAST(p_size AS VARCHAR), count(*) FILTER (WHERE p_brand IN ('Brand#11', 'Brand#12')) FROM part GROUP BY p_size""")
def a14_facet_counts(spark, d):
    parts = table(spark, d, "part").select("p_brand", F.col("p_size").cast("string").alias("size"))
    return filters.facet_counts(parts, {"p_brand": ["Brand#11", "Brand#12"], "size": ["1", "2", "3"]})


@query("""SELECT 'custkey' AS name, count(*) FILTER (WHERE NOT coalesce(o_custkey > 0, false)) AS n FROM orders UNION ALL
          SELECT 'status', count(*) FILTER (WHERE NOT coalesce(o_orderstatus IN ('F', 'O'), false)) FROM orders UNION ALL
          SELECT 'price', count(*) FILTER (WHERE NOT coalesce(o_totalprice BETWEEN 1000 AND 400000, false)) FROM orders UNION ALL
          SELECT 'priority', count(*) FILTER (WHERE NOT coalesce(regexp_matches(o_orderpriority, '^[1-5]-'), false)) FROM orders""")
def q11_constraints(spark, d):
    checks = {"custkey": F.col("o_custkey") > 0, "status": F.col("o_orderstatus").isin("F", "O"), "price": F.col("o_totalprice").between(1000, 400_000), "priority": F.col("o_orderpriority").rlike("^[1-5]-")}
    return validate.violations(table(spark, d, "orders"), checks)


@query("SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def q1_duplicate_keys(spark, d):
    return validate.duplicate_keys(table(spark, d, "documents"), "text")


@query("""SELECT sha256(string_agg(concat(CAST(doc_id AS VARCHAR), chr(9), sha256(text)), chr(10) ORDER BY concat(CAST(doc_id AS VARCHAR), chr(9), sha256(text)))) AS digest, count(*) AS n
          FROM documents WHERE source = 'src7' GROUP BY source""")
def t24_digest(spark, d):
    """The pinned digest of one release (a source), from its listing."""
    docs = table(spark, d, "documents").filter("source = 'src7'")
    return docs.groupBy("source").agg(T.digest_of_listing(F.col("doc_id").cast("string"), F.sha2("text", 256)).alias("digest"), F.count(F.lit(1)).alias("n")).select("digest", "n")


@query(r"""WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: true) AS w FROM documents)
          SELECT doc_id, CAST(len(w) AS BIGINT) AS n, CAST(len(list_distinct(w)) AS BIGINT) AS n_distinct FROM t""")
def t1_tokens(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.size(T.tokens(F.col("text"))).cast("bigint").alias("n"), F.size(T.distinct_tokens(F.col("text"))).cast("bigint").alias("n_distinct"))


@query(r"""WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}]+(?:[./-][\p{L}\p{N}]+)*'), lambda x: length(x) >= 2 OR regexp_matches(x, '^[0-9]$')) AS w FROM documents)
          SELECT doc_id, (len(w) + greatest(len(w) - 1, 0))::BIGINT AS n_terms, sha256(array_to_string(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), chr(10))) AS terms_sha256 FROM t""")
def t3_analyzer_terms(spark, d):
    """Terms of the analyzer. In SQL, folding is lower case and ß as ss, which is the same for texts of Latin letters and Hangul."""
    folded = table(spark, d, "documents").select("doc_id", T.nfkc_casefold(F.col("text")).alias("folded"))
    terms = folded.select("doc_id", T.analyzed(F.col("folded")).alias("terms"))
    return terms.select("doc_id", F.size("terms").cast("bigint").alias("n_terms"), F.sha2(F.array_join("terms", "\n"), 256).alias("terms_sha256"))


@query("""SELECT doc_id, CASE WHEN strpos(lower(text), 'licensed') > 81 THEN '…' ELSE '' END
                 || replace(substring(text, greatest(1, strpos(lower(text), 'licensed') - 80), 260), chr(10), ' ')
                 || CASE WHEN length(text) >= greatest(1, strpos(lower(text), 'licensed') - 80) + 260 THEN '…' ELSE '' END AS snippet
          FROM documents WHERE contains(lower(text), 'licensed')""")
def t11_snippet(spark, d):
    docs = table(spark, d, "documents").filter(T.contains_all(F.col("text"), ["licensed"]))
    return docs.select("doc_id", T.snippet(F.col("text"), ["licensed"]).alias("snippet"))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS plain FROM pages""")
def t13_html_text(spark, d):
    return table(spark, d, "pages").select("page_id", T.strip_tags(F.col("html")).alias("plain"))


@query()
def t13_html_text_unescaped(spark, d):
    return table(spark, d, "pages").select("page_id", T.html_text(F.col("html")).alias("plain"))


@query()
def t14_mask_pii(spark, d):
    """Look-arounds keep digits next to a number from being taken for it, which the SQL side has no form of."""
    masked = T.mask_personal(F.col("text"))
    return table(spark, d, "documents").select("doc_id", masked.alias("masked")).filter(F.col("masked").rlike(r"\[(이메일|사업자번호|전화번호)\]"))


@query(r"""SELECT doc_id, length(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '[a-zA-Z0-9_.+-]+@[a-zA-Z0-9_-]+(\.[a-zA-Z0-9_-]+)+', '[mail]', 'g')) AS n
          FROM documents WHERE contains(text, '@')""")
def t14_mask_mail(spark, d):
    masked = F.regexp_replace(F.trim(F.regexp_replace("text", r"\s+", " ")), r"[\w.+-]+@[\w-]+(\.[\w-]+)+", "[mail]")
    return table(spark, d, "documents").filter("contains(text, '@')").select("doc_id", F.length(masked).cast("bigint").alias("n"))


@query("""SELECT p_partkey, CAST(contains(k, 'steel') OR contains(k, 'tin') AS BIGINT) + CAST(contains(k, 'large') AS BIGINT) + CAST(contains(k, 'steellarge') AS BIGINT) AS score
          FROM (SELECT p_partkey, regexp_replace(lower(concat_ws(' ', p_name, p_type, p_brand)), '[\\s·,.()/_-]+', '', 'g') AS k FROM part)""")
def t28_synonym_score(spark, d):
    key = T.search_key(F.concat_ws(" ", "p_name", "p_type", "p_brand"))
    return table(spark, d, "part").select("p_partkey", T.synonym_score(key, "steel large", [["steel", "tin"], ["copper", "brass"]]).cast("bigint").alias("score"))


@query("""SELECT c_custkey, CASE WHEN v >= 100000000 THEN regexp_replace(CAST(floor(v / 10000000 + 0.5) / 10 AS VARCHAR), '\\.0$', '') || '억원'
                 WHEN v >= 10000 THEN 'man' ELSE 'won' END AS amount
          FROM (SELECT c_custkey, CAST(round(abs(c_acctbal) * 100000) AS BIGINT) AS v FROM customer) WHERE v >= 100000000""")
def t23_amounts(spark, d):
    v = F.round(F.abs("c_acctbal") * 100_000).cast("bigint")
    return table(spark, d, "customer").filter(v >= 100_000_000).select("c_custkey", T.won(v).alias("amount"))


@query(r"""SELECT event_id, CASE WHEN regexp_matches(replace(v, ',', ''), '^-?\d+(\.\d+)?$') THEN v ELSE '' END AS kept
          FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '1,' || CAST(event_id % 900 + 100 AS VARCHAR) WHEN event_id % 3 = 1 THEN '-' ELSE CAST(event_id AS VARCHAR) END AS v FROM events)""")
def m16_numeric_text(spark, d):
    i = F.col("event_id")
    v = F.when(i % 3 == 0, F.concat(F.lit("1,"), (i % 900 + 100).cast("string"))).when(i % 3 == 1, "-").otherwise(i.cast("string"))
    return table(spark, d, "events").select("event_id", T.numeric_text(v).alias("kept"))


@query("""SELECT p_partkey FROM part WHERE CASE WHEN p_size % 4 = 0 THEN 'F41' WHEN p_size % 4 = 1 THEN 'construction' WHEN p_size % 4 = 2 THEN 'C25' ELSE 'other' END IN ('F41', 'construction')""")
def f17_threshold_rows(spark, d):
    """Rows of a threshold table that an industry of construction sees."""
    kind = F.when(F.col("p_size") % 4 == 0, "F41").when(F.col("p_size") % 4 == 1, "construction").when(F.col("p_size") % 4 == 2, "C25").otherwise("other")
    return filters.threshold_rows(table(spark, d, "part").select("p_partkey", kind.alias("industry")), "F41").select("p_partkey")


@query("""SELECT doc_id FROM documents WHERE contains(text, 'sk-') OR contains(text, 'AKIA') OR contains(text, 'token = ')""")
def f22_secret_scan(spark, d):
    return table(spark, d, "documents").filter(filters.holds_secret(F.col("text"), ["sk-", "AKIA", "token = "])).select("doc_id")


@query(r"""SELECT doc_id, sha256(regexp_replace(text, '(?i)(license|reserved)', '<mark>\1</mark>', 'g')) AS digest FROM documents WHERE contains(lower(text), 'license')""")
def t12_highlight(spark, d):
    docs = table(spark, d, "documents").filter(T.contains_all(F.col("text"), ["license"]))
    return docs.select("doc_id", F.sha2(T.highlight(F.col("text"), ["license", "reserved"]), 256).alias("digest"))


@query(r"""SELECT page_id, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '[^A-Za-z0-9._-]+', '_', 'g') AS file, split_part(url, '?', 1) AS base FROM pages""")
def t20_file_names(spark, d):
    """File names that any file system takes, and addresses without their query."""
    return table(spark, d, "pages").select("page_id", F.regexp_replace(F.regexp_extract("url", "([^/]*)$", 1), "[^A-Za-z0-9._-]+", "_").alias("file"), F.split_part("url", F.lit("?"), F.lit(1)).alias("base"))


@query("""SELECT p_partkey, 'https://example.org/search?q=' || url_encode(p_name) AS address FROM part""")
def t21_addresses(spark, d):
    encoded = F.replace(F.url_encode("p_name"), F.lit("+"), F.lit("%20"))
    return table(spark, d, "part").select("p_partkey", F.concat(F.lit("https://example.org/search?q="), encoded).alias("address"))


@query("""SELECT c_custkey, substring(sha256('salt' || c_name), 1, 16) AS key FROM customer""")
def t25_client_key(spark, d):
    return table(spark, d, "customer").select("c_custkey", T.client_key("salt", F.col("c_name")).alias("key"))


@query(r"""SELECT page_id, CAST(len(regexp_extract_all(html, 'href="/([^"]+)"')) AS BIGINT) AS n, sha256(regexp_replace(html, 'href="/([^"]+)"', 'href="https://example.org/\1"', 'g')) AS digest FROM pages""")
def t31_absolute_links(spark, d):
    """Relative links made absolute, and how many they were."""
    changed = F.regexp_replace("html", 'href="/([^"]+)"', 'href="https://example.org/$1"')
    return table(spark, d, "pages").select("page_id", F.regexp_count("html", F.lit('href="/([^"]+)"')).cast("bigint").alias("n"), F.sha2(changed, 256).alias("digest"))


@query("""SELECT l_orderkey, l_linenumber, round_even(l_extendedprice / 8, 1) AS even, floor(l_extendedprice / 8 * 10 + 0.5) / 10 AS up, CAST(greatest(1, ceil(l_quantity / 7)) AS BIGINT) AS units FROM lineitem""")
def m5_roundings(spark, d):
    """Halves to even, halves up, and whole units of cost."""
    from ..functions.vectors import half_up

    eighth = F.col("l_extendedprice") / 8
    rows = table(spark, d, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", F.bround(eighth, 1).alias("even"), half_up(eighth).alias("up"), F.greatest(F.lit(1), F.ceil(F.col("l_quantity") / 7)).alias("units"))


@query("""SELECT doc_id, CASE WHEN length(text) < 1 THEN 'empty' WHEN NOT regexp_matches(source, '^src[0-9]+$') THEN 'source' WHEN lang NOT IN ('en', 'de') THEN 'lang' END AS reason FROM documents""")
def l2_first_reason(spark, d):
    """Why intake would refuse a row: the first check that it fails."""
    checks = {"empty": F.length("text") >= 1, "source": F.col("source").rlike("^src[0-9]+$"), "lang": F.col("lang").isin("en", "de")}
    return table(spark, d, "documents").select("doc_id", validate.first_reason(checks).alias("reason"))


@query("""SELECT p_brand AS category, count(*) AS n, count(*) FILTER (WHERE k <> 1) AS unclear FROM (SELECT p_brand, p_name, count(DISTINCT p_type) AS k FROM part GROUP BY 1, 2) GROUP BY 1""")
def q6_exactly_one(spark, d):
    """Names of a brand, and those that don't have exactly one type."""
    kinds = table(spark, d, "part").groupBy(F.col("p_brand").alias("category"), "p_name").agg(F.countDistinct("p_type").alias("k"))
    return kinds.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("k") != 1).alias("unclear"))


@query("""SELECT p_partkey, p_name FROM part WHERE NOT regexp_matches(p_name, 'widget|^blue')""")
def f14_skipped_titles(spark, d):
    return filters.skipping(table(spark, d, "part"), "p_name", "widget|^blue").select("p_partkey", "p_name")


@query("""SELECT p_partkey, 'The ' || p_name || ' of ' || p_brand || ' has size ' || p_size || '.' AS sentence FROM part""")
def t22_sentences(spark, d):
    text = T.sentence("The %s of %s has size %s.", F.col("p_name"), F.col("p_brand"), F.col("p_size"))
    return table(spark, d, "part").select("p_partkey", text.alias("sentence"))


@query(r"""SELECT page_id, replace(regexp_replace(html, 'href="/([^"]+)"', 'href="https://example.org/\1"', 'g'), 'href="https://example.org/a', 'href="/a') AS html,
          CAST(len(regexp_extract_all(html, 'href="/([^"]+)"')) - len(regexp_extract_all(html, 'href="/a([^"]*)"')) AS BIGINT) AS n FROM pages""")
def t30_counted_rewrite(spark, d):
    """Links are made absolute, but for those to pages with an a in front, and counted."""
    html, n = T.rewritten(F.col("html"), 'href="/(?!a)([^"]+)"', 'href="https://example.org/$1"')
    return table(spark, d, "pages").select("page_id", html.alias("html"), n.alias("n"))


@query("""SELECT l_orderkey, l_linenumber, CAST(ceil(CAST(l_quantity AS DOUBLE) * 3 / 1000) + ceil(CAST(l_quantity AS DOUBLE) * 15 / 1000) AS BIGINT) AS cost FROM lineitem""")
def m7_whole_costs(spark, d):
    """Units in and out at prices per thousand, each rounded up to whole units of money."""
    units = F.col("l_quantity").cast("double")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.ceil(units * 3 / 1000) + F.ceil(units * 15 / 1000)).cast("bigint").alias("cost"))


@query("""SELECT unnest(['doc_id', 'text', 'title', 'lang', 'year']) AS name EXCEPT SELECT column_name FROM (DESCRIBE documents)""")
def q3_missing_columns(spark, d):
    docs = validate.required(table(spark, d, "documents"), ["doc_id", "text"])
    missing = validate.missing_columns(docs, ["doc_id", "text", "title", "lang", "year"])
    return spark.createDataFrame([(c,) for c in missing], "name string")


@query("""SELECT p_partkey AS rule, p_brand AS field FROM part WHERE p_brand NOT IN ('Brand#11', 'Brand#12', 'Brand#13')""")
def q9_unknown_fields(spark, d):
    rules = table(spark, d, "part").select(F.col("p_partkey").alias("rule"), F.col("p_brand").alias("field"))
    return validate.unknown_fields(rules, "field", ["Brand#11", "Brand#12", "Brand#13"])


@query(r"""SELECT doc_id, CAST(len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS BIGINT) AS n FROM documents""")
def t2_distinct_tokens(spark, d):
    """Different words of a text, stop words included."""
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.size(T.distinct_tokens(F.col("text"))).cast("bigint").alias("n"))


@query("""SELECT DISTINCT regexp_replace(lower(p_brand || ' (' || p_name || ')'), '[^a-z0-9]', '', 'g') AS name, regexp_replace(lower(p_brand || ' ' || p_type), '[\\s·ㆍ]', '', 'g') AS term FROM part""")
def t5_name_keys(spark, d):
    """Keys under which names (letters and numbers only) and terms (no blanks, no dots) are compared."""
    name, term = F.concat("p_brand", F.lit(" ("), "p_name", F.lit(")")), F.concat_ws(" ", "p_brand", "p_type")
    return table(spark, d, "part").select(T.name_key(name).alias("name"), T.term_key(term).alias("term")).distinct()
