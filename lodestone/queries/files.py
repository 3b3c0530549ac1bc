"""Tables through files and back: CSV in both dialects, JSON lines, releases with dictionary and inventory."""

from pyspark.sql import functions as F

from ..schemas import table
from ..sources import files, release
from ..sources.files import shared_folder
from .registry import query


@query("""SELECT doc_id, sha256(coalesce(text, '')) AS digest, coalesce(lang, '') AS lang FROM documents""")
def s1_csv_round_trip(spark, d):
    """Texts with line ends and quotes, in CSV that quotes where it must."""
    docs, path = table(spark, d, "documents").select("doc_id", "text", "lang"), shared_folder(spark, "csv")
    files.write_csv(docs, path, ["doc_id", "text", "lang"])
    return files.read_csv(spark, path, docs.schema).select("doc_id", F.sha2("text", 256).alias("digest"), "lang")


@query("""SELECT page_id, url, sha256(coalesce(html, '')) AS digest FROM pages""")
def s18_csv_quoted(spark, d):
    """Pages in CSV with every cell quoted."""
    pages, path = table(spark, d, "pages").select("page_id", "url", "html"), shared_folder(spark, "csv")
    files.write_csv(pages, path, ["page_id", "url", "html"], quote_all=True)
    return files.read_csv(spark, path, pages.schema).select("page_id", "url", F.sha2("html", 256).alias("digest"))


@query("""SELECT conv_id, turn, role, sha256(text) AS digest FROM conversations""")
def s3_json_lines_round_trip(spark, d):
    """Turns as JSON lines, one object each."""
    turns, path = table(spark, d, "conversations").select("conv_id", "turn", "role", "text"), shared_folder(spark, "json")
    files.write_json_lines(turns, path)
    return files.read_json_lines(spark, path, turns.schema).select("conv_id", "turn", "role", F.sha2("text", 256).alias("digest"))


LINES = """p AS (SELECT 'part' AS name, '"' || p_partkey || '","' || p_name || '","' || p_brand || '"' AS line FROM part),
           u AS (SELECT 'customer' AS name, '"' || c_custkey || '","' || replace(c_name, '"', '""') || '"' AS line FROM customer), l AS (SELECT * FROM p UNION ALL SELECT * FROM u)"""


@query(f"""WITH {LINES} SELECT name AS "table", count(*) AS rows, CAST(sum(octet_length(encode(line)) + 2) AS BIGINT) AS bytes, CASE name WHEN 'part' THEN 3 ELSE 2 END::BIGINT AS columns FROM l GROUP BY name""")
def s23_release(spark, d):
    """Two tables published twice, the second version read back: rows and bytes (without headers) from the inventory, columns from the dictionary."""
    path = shared_folder(spark, "release")
    parts, customers = table(spark, d, "part").select("p_partkey", "p_name", "p_brand"), table(spark, d, "customer").select("c_custkey", "c_name")
    release.publish({"part": parts.limit(0)}, path, "0")
    release.publish({"part": parts, "customer": customers}, path, "1")
    header = F.when(F.col("table") == "part", len('\ufeff"p_partkey","p_name","p_brand"\r\n'.encode())).otherwise(len('\ufeff"c_custkey","c_name"\r\n'.encode()))
    listed = release.read_release(spark, path, "inventory").withColumn("table", F.split_part("path", F.lit("/"), F.lit(1))).filter("table <> 'data_dictionary'")
    sizes = listed.groupBy("table").agg(F.sum(F.col("rows").cast("bigint")).alias("rows"), F.sum(F.col("bytes").cast("bigint") - header).alias("bytes"))
    columns = release.read_release(spark, path, "data_dictionary").groupBy("table").agg(F.count(F.lit(1)).alias("columns"))
    return sizes.join(columns, "table")


@query("""WITH f AS (SELECT p_brand, string_agg(p_name, chr(10) ORDER BY p_partkey) || chr(10) AS content FROM part GROUP BY p_brand) SELECT CAST(octet_length(encode(content)) AS BIGINT) AS bytes, sha256(content) AS sha256 FROM f""")
def s9_inventory(spark, d):
    """Size and digest of every file below a folder: one for each brand, with the names of its parts."""
    path = shared_folder(spark, "brands")
    parts = table(spark, d, "part").select("p_brand", "p_partkey", "p_name").repartition("p_brand").sortWithinPartitions("p_brand", "p_partkey")
    parts.select("p_brand", "p_name").write.partitionBy("p_brand").text(path)
    return files.inventory(spark, path).select("bytes", "sha256")
