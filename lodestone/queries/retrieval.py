"""Retrieval: keywords, BM25, vectors, fusion, graph-based scores, code search."""

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import filters, ranking, validate
from ..plans import index as I
from ..plans import retrieval as R
from ..plans import vectors as V
from ..schemas import table
from ..sources.files import shared_root
from .registry import query

#: A question in words that the invented texts have.
WORDS = ("license", "the", "under", "reserved")
LISTED = ", ".join(f"'{w}'" for w in WORDS)
#: Terms of whole documents and their statistics; candidates are filtered later.
BM25 = """t AS (SELECT doc_id, lang, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
          totals AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM t),
          p AS (SELECT doc_id, lang, dl, term, count(*) AS tf FROM (SELECT doc_id, lang, len(w) AS dl, unnest(w) AS term FROM t) GROUP BY ALL),
          f AS (SELECT term, count(*) AS df FROM p GROUP BY term)"""
SHARE = "ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))"


def _index(spark, d, recipe="tokens"):
    """The index of the documents, in the shared folder; it is built by the first query that asks."""
    return I.ensure_index(spark, f"{d}/documents.parquet", f"{shared_root(spark)}/index", I.Spec("1", "doc_id", "text", ("lang", "source"), recipe, places=recipe == "trigrams", runs=True))


def _question(spark, d):
    """The query's vector: one row of fixed size."""
    return list(table(spark, d, "embeddings").filter("vec_id = 0").first()["embedding"])


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
          s AS (SELECT q.vec_id AS query, v.vec_id AS row, round(list_dot_product(q.e, v.e), 6) AS score FROM v AS q, v WHERE q.vec_id % 20 = 0)
          SELECT query, row, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, row) AS rank FROM s) WHERE rank <= 20""")
def m3_cosine_topk(spark, d):
    """The 20 vectors most alike to each of the query set: all rows whose id is divisible by 20."""
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    return R.nearest(vectors.filter("vec_id % 20 = 0"), vectors, "vec_id", "embedding", 20)


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
          s AS (SELECT q.vec_id AS query, v.vec_id AS row, round(list_dot_product(q.e, v.e), 6) AS score FROM v AS q, v WHERE q.vec_id % 20 = 0)
          SELECT query, row, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, row) AS rank FROM s) WHERE rank <= 10""")
def w2_pruned_topk(spark, d):
    """The ten vectors most alike to each of the query set (ids divisible by 20), by cells and bounds."""
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    return V.nearest_pruned(vectors.filter("vec_id % 20 = 0"), vectors, "vec_id", "embedding", 10)


@query(f"""WITH {BM25}, q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0),
          a AS (SELECT doc_id AS row, round(sum({SHARE}), 6) AS score FROM p JOIN f ON f.term = p.term, totals WHERE p.term IN ({LISTED}) AND lang IN ('en', 'de') GROUP BY 1),
          b AS (SELECT vec_id AS row, round(list_dot_product(embedding::DOUBLE[], q.v), 6) AS score FROM q, embeddings JOIN documents ON doc_id = vec_id WHERE lang IN ('en', 'de')),
          r AS (SELECT row, 0 AS o, 'keyword' AS c, row_number() OVER (ORDER BY score DESC, row) AS rank FROM a UNION ALL SELECT row, 1, 'vector', row_number() OVER (ORDER BY score DESC, row) FROM b),
          u AS (SELECT row, sum(1.0 / (60 + rank)) AS score, string_agg(c, '+' ORDER BY o) AS channels FROM r WHERE rank <= 200 GROUP BY row)
          SELECT row, round(score, 6) AS score, channels, rank FROM (SELECT *, row_number() OVER (ORDER BY round(score, 12) DESC, row) AS rank FROM u) WHERE rank <= 200""")
def r3_hybrid_search(spark, d):
    """Candidates by filter, BM25 over statistics of all documents and vectors, both rankings fused."""
    index = _index(spark, d)
    candidates = filters.any_of(index.table("documents"), {"lang": ["en", "de"], "source": ""}).select("row")
    dense = R.similarities(table(spark, d, "embeddings"), "vec_id", "embedding", _question(spark, d))
    lexical = index.bm25(index.weighted_terms([(w, 1.0) for w in sorted(set(WORDS))]))
    return R.hybrid(lexical, dense, candidates).withColumn("score", F.round("score", 6))


@query("""WITH k AS (SELECT doc_id AS row, CAST((length(lower(text)) - length(replace(lower(text), 'license', ''))) // 7 AS DOUBLE) AS score FROM documents WHERE contains(lower(text), 'license') AND lang = 'en'),
          q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0),
          b AS (SELECT vec_id AS row, round(list_dot_product(embedding::DOUBLE[], q.v), 6) AS score FROM q, embeddings JOIN documents ON doc_id = vec_id WHERE lang = 'en'),
          r AS (SELECT row, row_number() OVER (ORDER BY score DESC, row) AS rank FROM k UNION ALL SELECT row, row_number() OVER (ORDER BY score DESC, row) FROM b)
          SELECT row, round(sum(1.0 / (60 + rank)), 6) AS score FROM r WHERE rank <= 200 GROUP BY row""")
def r4_substring_hybrid(spark, d):
    """Occurrences of the words instead of BM25; the fused list isn't cut."""
    index = _index(spark, d, "trigrams")
    docs = index.table("documents").filter("lang = 'en'").select("row")
    hits = index.occurrences(["license"]).join(docs, "row", "left_semi").select("row", F.col("hits").cast("double").alias("score"))
    dense = R.similarities(table(spark, d, "embeddings"), "vec_id", "embedding", _question(spark, d)).join(docs, "row", "left_semi")
    return ranking.fused_scores({"keyword": R.top(hits), "vector": R.top(dense)}, "row").select("row", F.round("score", 6).alias("score"))


@query(f"""WITH {BM25}, q AS (SELECT * FROM (VALUES ('license', 2.0), ('und', 0.6)) x(q, weight)),
          u AS (SELECT term, df, sum(CASE WHEN term = q THEN weight ELSE weight * 0.5 END) AS weight FROM q JOIN f ON term = q OR (starts_with(term, q) AND length(term) - length(q) BETWEEN 1 AND 2) GROUP BY term, df)
          SELECT row, score, rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, row) AS rank FROM (SELECT doc_id AS row, round(sum(weight * {SHARE}), 6) AS score FROM p JOIN u ON u.term = p.term, totals GROUP BY 1)) WHERE rank <= 100""")
def r5_bm25_expansion(spark, d):
    """Weighted terms (repeated ones count again) and all index terms that are up to two characters longer, which count half."""
    index = _index(spark, d)
    return R.top(index.bm25_of_all([("license", 1.0), ("license", 1.0), ("und", 0.6)]), 100)


#: Terms of the analyzer and their statistics, as BM25 has them of tokens.
ANALYZED = r"""w AS (SELECT doc_id, lang, list_filter(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}]+(?:[./-][\p{L}\p{N}]+)*'), lambda x: length(x) >= 2 OR regexp_matches(x, '^[0-9]$')) AS w FROM documents),
          t AS (SELECT doc_id, lang, list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS w FROM w),
          totals AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM t),
          p AS (SELECT doc_id, lang, dl, term, count(*) AS tf FROM (SELECT doc_id, lang, len(w) AS dl, unnest(w) AS term FROM t) GROUP BY ALL),
          f AS (SELECT term, count(*) AS df FROM p GROUP BY term)"""


@query(f"""WITH {ANALYZED}, v AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0),
          q AS (SELECT unnest(['released', 'under', 'the', 'mit', 'license', 'released under', 'under the', 'the mit', 'mit license']) AS q, 1.0 AS weight
                UNION ALL SELECT unnest(['all', 'rights', 'reserved', 'all rights', 'rights reserved']), 0.6),
          l AS (SELECT term, df, weight * 0.5 AS weight, row_number() OVER (PARTITION BY q ORDER BY term) AS i FROM q JOIN f ON starts_with(term, q) AND length(term) - length(q) BETWEEN 1 AND 2 AND NOT contains(term, ' ')),
          u AS (SELECT term, df, sum(weight) AS weight FROM (SELECT term, df, weight FROM q JOIN f ON term = q UNION ALL SELECT term, df, weight FROM l WHERE i <= 24) GROUP BY term, df),
          a AS (SELECT doc_id AS row, sum(weight * {SHARE}) AS score FROM p JOIN u ON u.term = p.term, totals WHERE lang = 'en' GROUP BY 1),
          s AS (SELECT vec_id AS row, list_dot_product(embedding::DOUBLE[], v.v) AS sim FROM v, embeddings JOIN documents ON doc_id = vec_id WHERE lang = 'en'),
          m AS (SELECT row, CASE WHEN sim >= 0.35 THEN sim ELSE 0 END AS sim FROM s),
          r AS (SELECT row, 0 AS o, 'words' AS c, row_number() OVER (ORDER BY round(score, 6) DESC, row) AS rank FROM a UNION ALL SELECT row, 1, 'meaning', row_number() OVER (ORDER BY round(sim, 6) DESC, row) FROM m WHERE sim > 0),
          x AS (SELECT row, sum(1.0 / (60 + rank)) AS fused, string_agg(c, '+' ORDER BY o) AS via FROM r WHERE rank <= 100 GROUP BY row),
          k AS (SELECT (SELECT count(*) FROM a) + (SELECT count(*) FROM x WHERE via = 'meaning') AS total),
          o AS (SELECT *, row_number() OVER (ORDER BY round(fused, 12) DESC, row) AS rank FROM x)
          SELECT row, rank, round(coalesce(score, 0), 2) AS score, round(sim, 3) AS similarity, via, total, CAST(least(5, ceil(least(total, 50) / 10)) AS BIGINT) AS pages
          FROM o LEFT JOIN a USING (row) LEFT JOIN m USING (row), k WHERE rank BETWEEN 11 AND 20""")
def r5_search_page(spark, d):
    """The whole search: analyzer, expansion by a label at 0.6, longer terms, a domain, vectors with a floor, fusion, total; its second page."""
    index = _index(spark, d, "analyzer")
    weighted = [(t, 1.0) for t in index.analyzed("Released under the MIT License")] + [(t, R.EXPANSION_WEIGHT) for t in index.analyzed("All rights reserved")]
    domain = index.table("documents").filter("lang = 'en'").select("row")
    scores = index.bm25(index.weighted_terms(weighted, particles=True)).join(domain, "row", "left_semi")
    dense = R.similarities(table(spark, d, "embeddings"), "vec_id", "embedding", _question(spark, d)).join(domain, "row", "left_semi")
    return R.search_page(scores, dense, 2)


@query(f"""WITH {BM25} SELECT (SELECT count(*) FROM documents) AS n, round((SELECT avgdl FROM totals), 6) AS average, (SELECT count(*) FROM f) AS terms, (SELECT count(*) FROM p) AS postings, (SELECT CAST(sum(tf) AS BIGINT) FROM p) AS tokens,
          (SELECT CAST(max(df) AS BIGINT) FROM f) AS widest""")
def r18_index_build(spark, d):
    """What the built index holds: rows, mean length, terms, postings and their tokens."""
    index = _index(spark, d)
    held = index.table("postings").agg(F.count(F.lit(1)).alias("postings"), F.sum("tf").alias("tokens"))
    terms = index.table("terms").agg(F.count(F.lit(1)).alias("terms"), F.max("df").alias("widest"))
    return held.withColumn("k", F.lit(0)).join(terms.withColumn("k", F.lit(0)), "k").select(F.lit(index.n).cast("bigint").alias("n"), F.round(F.lit(index.average), 6).alias("average"), "terms", "postings", "tokens", "widest")


@query("""SELECT doc_id, hits FROM (SELECT doc_id, CAST((length(lower(text)) - length(replace(lower(text), 'the', ''))) // 3 AS BIGINT) AS hits FROM documents
          WHERE contains(lower(text), 'the') AND lang IN ('en', 'fr')) ORDER BY hits DESC, doc_id LIMIT 20 OFFSET 20""")
def r2_keyword_search(spark, d):
    """Filter, all words in the text, most occurrences first, second page."""
    index = _index(spark, d, "trigrams")
    docs = filters.any_of(index.table("documents"), {"lang": ["en", "fr"]}).select("row")
    hits = index.occurrences(["the"]).join(docs, "row", "left_semi").select(F.col("row").alias("doc_id"), "hits")
    return filters.page(hits, [F.desc("hits"), F.col("doc_id")], 2, 20)


@query("""WITH k AS (SELECT * FROM (VALUES ('redwidget'), ('bolt'), ('bluebo')) x(key)), n AS (SELECT p_partkey AS id, replace(p_name, ' ', '') AS key FROM part)
          SELECT id, CAST(sum(s) AS BIGINT) AS score FROM (SELECT id, 2 AS s FROM n JOIN k ON k.key = n.key
                UNION ALL SELECT id, 1 FROM n JOIN k ON (contains(n.key, k.key) OR contains(k.key, n.key)) AND length(n.key) >= 4 AND length(k.key) >= 4) GROUP BY id""")
def r11_node_matching(spark, d):
    """Two for an equal name, one for each name that contains a key or lies in it."""
    names = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.replace("p_name", F.lit(" "), F.lit("")).alias("key"))
    keys = spark.createDataFrame([("redwidget",), ("bolt",), ("bluebo",)], "key string")
    return R.node_scores(names, keys)


@query("""WITH t AS (SELECT doc_id AS report, regexp_extract_all(lower(text), '[a-z0-9]+') AS w, source, lang FROM documents),
          w AS (SELECT report, least(count(*), 3) AS tf FROM (SELECT report, unnest(w) AS term FROM t) WHERE term IN ('license', 'under', 'reserved') GROUP BY report, term),
          s AS (SELECT report, sum(tf) AS s FROM w GROUP BY report UNION ALL SELECT report, 3 * ((source = 'src7')::INT + (lang = 'fr')::INT) FROM t WHERE source = 'src7' OR lang = 'fr')
          SELECT report, CAST(sum(s) AS BIGINT) AS score FROM s GROUP BY report""")
def r13_report_score(spark, d):
    """Three for each chosen node of a report, and the question's words, each up to three times."""
    reports = table(spark, d, "documents").select(F.col("doc_id").alias("report"), "text", F.array("source", "lang").alias("node_ids"))
    chosen = spark.createDataFrame([("src7",), ("fr",)], "id string")
    return R.report_scores(reports, T.tokens(F.col("text")), chosen, ["license", "under", "reserved"])


@query("""WITH h AS (SELECT p_partkey, CASE WHEN lower(p_brand) = 'brand#12' THEN 0 WHEN replace(p_name, ' ', '') = 'brand#12' THEN 1 ELSE 3 END AS priority FROM part
                WHERE lower(p_brand) = 'brand#12' OR list_has_any(string_split(p_name, ' '), ['red', 'gear']))
          SELECT p_partkey, CAST(priority AS BIGINT) AS priority, rank FROM (SELECT p_partkey, priority, row_number() OVER (ORDER BY priority, p_size, p_brand, p_partkey) AS rank FROM h JOIN part USING (p_partkey)) WHERE rank BETWEEN 11 AND 30""")
def r16_code_search(spark, d):
    """The best of code, exact, alias and related hits; by priority, level and code; rows 11 to 30."""
    parts = table(spark, d, "part")
    codes = parts.select(F.col("p_partkey").alias("record_id"), F.col("p_size").alias("level"), F.col("p_brand").alias("code"))
    direct = parts.select(F.col("p_partkey").alias("record_id"), T.term_key(F.col("p_brand")).alias("norm"), F.lit("code").alias("kind")).unionAll(parts.select("p_partkey", T.term_key(F.col("p_name")), F.lit("exact")))
    words = parts.select(F.col("p_partkey").alias("record_id"), T.distinct_tokens(F.col("p_name")).alias("tokens"))
    found = R.code_search(direct, words, codes, "brand#12", ["red", "gear"])
    order = [F.col("priority"), F.col("level"), F.col("code"), F.col("record_id")]
    return filters.ranked(found, order, 30).filter("rank > 10").select(F.col("record_id").alias("p_partkey"), "priority", "rank")


@query("""SELECT p_name AS surface, count(*) AS df FROM part WHERE p_name IN ('red widget', 'blue bolt', 'red') GROUP BY p_name""")
def r6_concept_hits(spark, d):
    """Concepts whose whole name is among the question's keys."""
    keys = spark.createDataFrame([("redwidget",), ("bluebolt",), ("red",)], "key string")
    concepts = table(spark, d, "part").groupBy(F.col("p_name").alias("surface")).agg(F.count(F.lit(1)).alias("df"))
    return concepts.withColumn("key", T.squash(F.col("surface"))).join(F.broadcast(keys), "key").select("surface", "df")  # keys: words of one question


@query("""WITH p AS (SELECT s_suppkey, p_partkey, p_name FROM (SELECT DISTINCT l_suppkey AS s_suppkey, l_partkey FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 3)) JOIN part ON p_partkey = l_partkey),
          c AS (SELECT p_partkey AS law, count(*) AS cited FROM p GROUP BY 1), u AS (SELECT law, cited, false AS titled FROM c UNION ALL SELECT p_partkey, 0, true FROM part WHERE contains(p_name, 'gear')),
          g AS (SELECT law, CAST(sum(cited) AS BIGINT) AS cited, bool_or(titled) AS titled FROM u GROUP BY law)
          SELECT law, cited, rank FROM (SELECT *, row_number() OVER (ORDER BY cited DESC, titled DESC, law) AS rank FROM g) WHERE rank <= 6""")
def r8_law_suggestion(spark, d):
    """Articles that the shown guides cite, and those with a word of the question in their title."""
    three = filters.ranked(table(spark, d, "supplier"), [F.desc("s_acctbal"), F.col("s_suppkey")], 3).select(F.col("s_suppkey").alias("l_suppkey"))  # a search's first three
    shown = table(spark, d, "lineitem").join(three, "l_suppkey", "left_semi").select("l_suppkey", "l_partkey").distinct()
    cited = shown.groupBy(F.col("l_partkey").alias("law")).agg(F.count(F.lit(1)).alias("cited")).withColumn("titled", F.lit(False))
    titled = table(spark, d, "part").filter("contains(p_name, 'gear')").select(F.col("p_partkey").alias("law"), F.lit(0).cast("bigint").alias("cited"), F.lit(True).alias("titled"))
    both = cited.unionByName(titled).groupBy("law").agg(F.sum("cited").alias("cited"), F.bool_or("titled").alias("titled"))
    return filters.ranked(both, [F.desc("cited"), F.desc("titled"), F.col("law")], 6).select("law", "cited", "rank")


@query("""SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS position, substring(text, 1, 80) AS preview FROM conversations""")
def r10_document_outline(spark, d):
    turns = table(spark, d, "conversations")
    placed = filters.ranked(turns, [F.col("turn"), F.col("role"), F.col("text")], by=["conv_id"], name="position")
    return placed.select("conv_id", "turn", "position", F.substring("text", 1, 80).alias("preview"))


@query("""WITH u AS (SELECT doc_id, 0 AS source, doc_id AS ord FROM documents WHERE source = 'src7' UNION ALL SELECT doc_id, 1, doc_id FROM documents WHERE lang = 'fr'),
          o AS (SELECT doc_id, min((source, ord)) AS place FROM u GROUP BY doc_id), k AS (SELECT doc_id, row_number() OVER (ORDER BY place) AS n FROM o)
          SELECT doc_id, CAST(total AS BIGINT) AS total FROM (SELECT doc_id, sum(n_chars) OVER (ORDER BY n ROWS UNBOUNDED PRECEDING) AS total FROM k JOIN documents USING (doc_id) WHERE n <= 8) WHERE total <= 12000""")
def r14_context_assembly(spark, d):
    """Evidence first, then what the search found, each once, eight at most, within a budget of characters."""
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars")
    evidence, found = docs.filter("source = 'src7'").withColumn("first", F.lit(0)), docs.filter("lang = 'fr'").withColumn("first", F.lit(1))
    once = ranking.first_wins(evidence.unionByName(found), ["doc_id"], ["first"])
    eight = filters.ranked(once, [F.col("first"), F.col("doc_id")], 8).withColumn("all", F.lit(0))
    return ranking.within_budget(eight, ["all"], ["rank"], "n_chars", 12_000).select("doc_id", "total")


@query("""SELECT doc_id AS ord, len(list_filter(['src' || doc_id % 20, lang], lambda x: x IN ('src7', 'fr'))) AS cites FROM documents
          WHERE len(list_filter(['src' || doc_id % 20, lang], lambda x: x IN ('src7', 'fr'))) > 0 AND length(text) BETWEEN 1 AND 600 ORDER BY doc_id LIMIT 8""")
def r15_citation_check(spark, d):
    statements = table(spark, d, "documents").select(F.col("doc_id").alias("ord"), "text", F.array(F.concat(F.lit("src"), (F.col("doc_id") % 20).cast("string")), F.col("lang")).alias("cites"))
    return validate.cited(statements, ["src7", "fr"]).select("ord", F.size("cites").cast("bigint").alias("cites"))


@query(r"""SELECT item_id FROM benchmark b WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = b.item_id * 7 AND contains(regexp_replace(lower(d.text), '\s+', '', 'g'), regexp_replace(lower(b.text), '\s+', '', 'g')))""")
def j14_ungrounded_quotes(spark, d):
    """Quotes that the document they name doesn't hold, white space and forms aside."""
    quotes = table(spark, d, "benchmark").select((F.col("item_id") * 7).alias("doc_id"), "item_id", F.col("text").alias("quote"))
    return validate.ungrounded(quotes, table(spark, d, "documents").select("doc_id", "text"), "doc_id", "quote", "text").select("item_id")


@query("""WITH n AS (SELECT p_partkey AS id, p_name, p_brand FROM part WHERE p_name IN ('red widget', 'blue bolt')), e AS (SELECT DISTINCT p_name AS s, p_type AS rel, p_brand AS t FROM part WHERE p_name IN ('red widget', 'blue bolt'))
          SELECT s, rel, t, rank FROM (SELECT *, row_number() OVER (ORDER BY s, rel, t) AS rank FROM e) WHERE rank <= 12""")
def r7_related_concepts(spark, d):
    """The first distinct relations of the concepts that a question names."""
    named = table(spark, d, "part").filter(F.col("p_name").isin("red widget", "blue bolt"))
    relations = named.select(F.col("p_name").alias("s"), F.col("p_type").alias("rel"), F.col("p_brand").alias("t")).distinct()
    return filters.ranked(relations, [F.col("s"), F.col("rel"), F.col("t")], 12)


@query("""WITH w AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS position, count(*) OVER (PARTITION BY conv_id) AS siblings FROM conversations)
          SELECT w.conv_id, w.turn, position, siblings, coalesce(relations, 0) AS relations FROM w LEFT JOIN (SELECT doc_id, count(*) AS relations FROM labels GROUP BY 1) r ON r.doc_id = conv_id WHERE role = 'assistant'""")
def r9_chunk_detail(spark, d):
    """Chunks with their place among their siblings and the relations that cite their document."""
    turns = table(spark, d, "conversations")
    placed = ranking.siblings(turns, "conv_id", ["turn", "role", "text"], "turn").filter("role = 'assistant'")
    citing = table(spark, d, "labels").groupBy(F.col("doc_id").alias("conv_id")).agg(F.count(F.lit(1)).alias("relations"))
    return placed.join(citing, "conv_id", "left").select("conv_id", "turn", "position", "siblings", F.coalesce("relations", F.lit(0)).alias("relations"))


@query("""SELECT o_orderkey, n, first_item FROM (SELECT o_orderkey, count(l_orderkey) AS n, min(l_linenumber) AS first_item FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey = 7 GROUP BY 1)""")
def r19_case_detail(spark, d):
    """One case with its child rows: the key reaches the scans of both tables."""
    items = table(spark, d, "lineitem").filter("l_orderkey = 7").agg(F.count(F.lit(1)).alias("n"), F.min("l_linenumber").alias("first_item"), F.lit(7).cast("bigint").alias("o_orderkey"))
    return table(spark, d, "orders").filter("o_orderkey = 7").select("o_orderkey").join(items, "o_orderkey")


@query("""WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id AS row, round(list_dot_product(embedding::DOUBLE[], q.v), 6) AS score FROM embeddings, q)
          SELECT row, CASE WHEN score >= 0.1 THEN score ELSE 0 END AS score FROM s""")
def f16_score_floor(spark, d):
    scores = R.similarities(table(spark, d, "embeddings"), "vec_id", "embedding", _question(spark, d)).withColumn("score", F.round("score", 6))
    return R.floored(scores, 0.1)
