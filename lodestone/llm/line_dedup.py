"""Line dedup with a log-template tree, in DataFrame functions only.

A line goes down a tree of fixed depth: first by its number of tokens, then by its first LEAD tokens, in which a token with a
digit counts as a variable field. What comes after those tokens is variable too. Each leaf is a template. A template that
occurs in at least ``min_docs`` different texts is recurring, and its lines are dropped from all documents, their first
places included.

Near copies of one document make all its lines recurring. With ``spare_copies`` a document stays as it is if recurring lines
make up most of it and some other such document has nearly the same templates: it is a copy as a whole, which near-duplicate
stages are for. A page that only shares its boilerplate with others is cleaned, whatever its share.

Defined results: null text counts as empty; blank lines are never templates and stay; a template repeated in one text, or in
equal texts, counts once; a document may lose its last line and have an empty text; an empty table gives no rows; other
columns stay, whatever their names (n_lines and n_dropped get a longer name where the table has such columns). Templates and
texts are told apart by two hashes (of 64 bits each; texts by a hash and their size).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, cut, drop, fresh

LEAD = 8
#: Blanks within a line.
GAP = "[ \\t\\x0B\\f\\r]+"
FIELD = "<*>"
#: Copies have so much of their templates in common with the first text of one of PROBES groups; recurring lines are more than MOST of their characters.
ALIKE, PROBES, MOST = 0.6, 4, 0.5


def parsed(docs: DataFrame) -> DataFrame:
    """key, size (of the text), line_no, chars, n_tokens, lead, template and other (two hashes) of every line that isn't blank, from a text column."""
    text = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select(F.xxhash64(text).alias("key"), F.octet_length(text).alias("size"), F.split(text, "\n").alias("lines"))
    lines = texts.select("key", "size", F.posexplode("lines").alias("line_no", "line"))  # hashed once for a text, not for each of its lines
    tokens = F.split(F.regexp_replace("line", f"^{GAP}|{GAP}$", ""), GAP)
    lead = F.array_join(F.transform(F.slice("tokens", 1, LEAD), lambda x: F.when(x.rlike("[0-9]"), FIELD).otherwise(x)), " ")
    split = lines.select("key", "size", "line_no", F.length("line").alias("chars"), tokens.alias("tokens")).filter("tokens[0] <> ''")
    rows = split.select("key", "size", "line_no", "chars", F.size("tokens").alias("n_tokens"), lead.alias("lead"))
    return rows.withColumns({"template": F.xxhash64("n_tokens", "lead"), "other": F.xxhash64(F.lit("second"), "lead", "n_tokens")})


def recurring_templates(lines: DataFrame, min_docs: int) -> DataFrame:
    """template, other and n_docs, of those in at least ``min_docs`` different texts."""
    counted = lines.select("template", "other", "key", "size").distinct().groupBy("template", "other").agg(F.count(F.lit(1)).alias("n_docs"))
    return counted.filter(F.col("n_docs") >= min_docs)


def copies(lines: DataFrame, marked: DataFrame) -> DataFrame:
    """key and size of texts that are copies as a whole, from all lines and those that recur (key, size, line_no, chars)."""
    of = ["key", "size"]
    share = lines.select(*of, "line_no", "chars").distinct().groupBy(*of).agg(F.sum("chars").alias("all"))
    most = marked.groupBy(*of).agg(F.sum("chars").alias("recur")).join(share, of).filter(F.col("recur") > MOST * F.col("all")).select(*of)
    sets = cut(lines.join(most, of).groupBy(*of).agg(F.collect_set("template").alias("templates")))
    probes = F.array(*[F.array_min(F.transform("templates", lambda x: F.xxhash64(x, F.lit(i)))) for i in range(PROBES)])  # noqa: B023
    probed = sets.select(*of, "templates", F.posexplode(probes).alias("probe", "least"))
    first = F.min(F.struct(F.col("key").alias("k"), F.col("size").alias("s"), F.col("templates").alias("those"))).alias("first")
    heads = probed.groupBy("probe", "least").agg(first, F.count(F.lit(1)).alias("n")).filter("n > 1").select("probe", "least", "first.*")
    both = F.size(F.array_intersect("templates", "those"))
    near = (both >= ALIKE * (F.size("templates") + F.size("those") - both)) & ~((F.col("key") == F.col("k")) & (F.col("size") == F.col("s")))
    found = cut(probed.join(heads, ["probe", "least"]).filter(near).select("key", "size", "k", "s"))
    drop(sets)
    return cut(found.select(*of).union(found.select("k", "s")).distinct())


def line_dedup(docs: DataFrame, min_docs: int = 10, spare_copies: bool = False) -> DataFrame:
    """``docs`` with recurring lines dropped from text, and n_lines and n_dropped (long)."""
    lines = cut(parsed(docs).drop("n_tokens", "lead"))
    recurring = cut(recurring_templates(lines, min_docs).select("template", "other"))  # as a table, so that AQE can split the lines of a hot template
    marked = cut(lines.join(recurring, ["template", "other"], "left_semi").select("key", "size", "line_no", "chars").distinct())
    going = marked.join(copies(lines, marked), ["key", "size"], "left_anti") if spare_copies else marked
    key, size, numbers = fresh(docs, "key"), fresh(docs, "size"), fresh(docs, "numbers")
    drops = cut(going.groupBy(F.col("key").alias(key), F.col("size").alias(size)).agg(F.collect_list("line_no").alias(numbers)))
    drop(lines, recurring, marked)
    text = F.coalesce(F.col("text"), F.lit(""))
    held = docs.withColumns({key: F.xxhash64(text), size: F.octet_length(text)})
    joined = held.join(drops.hint("merge"), [key, size], "left")  # grows with the corpus: never broadcast
    all_lines = F.split(text, "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col(numbers))  # by hash: linear in the lines
    both = F.array(F.struct(all_lines.alias("lines"), stay.alias("stay")))  # bound once for all lines
    left = F.element_at(F.transform(both, lambda b: F.array_join(F.transform(b["stay"], lambda i: F.get(b["lines"], i)), "\n")), 1)
    return joined.select(
        *[F.when(F.col(numbers).isNull(), text).otherwise(left).alias(c) if c == "text" else col(c) for c in docs.columns],
        F.size(all_lines).cast("long").alias(fresh(docs, "n_lines")),
        F.coalesce(F.size(numbers), F.lit(0)).cast("long").alias(fresh(docs, "n_dropped")),
    )


SQL = r"""
    WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    l AS (SELECT text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM (SELECT DISTINCT text FROM t)),
    k AS (SELECT *, string_split_regex(regexp_replace(line, '^[ \t\x0B\f\r]+|[ \t\x0B\f\r]+$', '', 'g'), '[ \t\x0B\f\r]+') AS tokens FROM l),
    p AS (SELECT *, len(tokens) AS n, array_to_string(list_transform(tokens[1:8], lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END), ' ') AS lead FROM k),
    r AS (SELECT n, lead FROM p WHERE tokens[1] <> '' GROUP BY n, lead HAVING count(DISTINCT text) >= 10),
    m AS (SELECT p.*, r.n IS NOT NULL AS recurs FROM p LEFT JOIN r ON p.n = r.n AND p.lead = r.lead AND p.tokens[1] <> ''),
    d AS (SELECT text, count(*) AS n_lines, count(*) FILTER (WHERE recurs) AS n_dropped,
                 coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT recurs), '') AS kept FROM m GROUP BY text)
    SELECT doc_id, kept AS text, n_lines, n_dropped
    FROM t JOIN d ON t.text = d.text"""
