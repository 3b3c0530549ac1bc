"""Fill-in-middle transformation by escaped markers, in DataFrame functions.

A delimiter is escaped in the text, ``regexp_replace`` puts one after every unit, their number is counted, and
``substring_index`` takes the first, the last or the middle ones by rank; what it gives is freed of delimiters and unescaped.
Where to cut, whether to transform at all and in which order follow from a digest of the doc_id, so that a retried task gives
the same rows. Nothing is shuffled; a task holds one text and its marked form at a time.

Defined results: null text counts as empty, an empty text stays plain and has no units; a text that has one of the three
sentinels stays plain, so that outputs can always be taken apart again; a null doc_id counts as an empty string in the
digest, ids of other types as their text; equal ids are cut at the same places; repeated rows stay repeated; an empty table gives
no rows; other columns stay, and where they have one of our names ours gets a longer one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, fresh

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: The delimiter, and what it and the escape sign itself become in the text.
MARK, ESCAPE = "\u0001", "\u0002"
ESCAPED_MARK, ESCAPED_ESCAPE = f"{ESCAPE}d", f"{ESCAPE}e"
#: Units as patterns over escaped text: an escaped sign is one code point, and no blank.
UNITS = {"points": f"(?s){ESCAPE}[de]|.", "words": r"\S+\s*|\s+", "lines": r"[^\n]*\n|[^\n]+"}


def marked(text: Column, unit: str) -> Column:
    """The escaped text with a delimiter after each unit."""
    escaped = F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPED_ESCAPE)), F.lit(MARK), F.lit(ESCAPED_MARK))
    return F.regexp_replace(escaped, UNITS[unit], f"$0{MARK}")


def first_units(text: Column, k: Column) -> Column:
    """The first k units of a marked text; below zero, those after the k-th delimiter from its end."""
    return F.call_function("substring_index", text, F.lit(MARK), k.cast("int"))


def unmarked(text: Column) -> Column:
    whole = F.replace(text, F.lit(MARK), F.lit(""))
    return F.replace(F.replace(whole, F.lit(ESCAPED_MARK), F.lit(MARK)), F.lit(ESCAPED_ESCAPE), F.lit(ESCAPE))


def restored(form: Column, output: Column) -> Column:
    """The text that an output of a form was made of."""
    after = lambda sign: F.substring_index(output, sign, -1)
    before = lambda c, sign: F.substring_index(c, sign, 1)
    psm = F.concat(before(after(PREFIX), SUFFIX), after(MIDDLE), before(after(SUFFIX), MIDDLE))
    spm = F.concat(before(after(PREFIX), MIDDLE), after(MIDDLE), before(after(SUFFIX), PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(docs: DataFrame, unit: str = "points", seed: int = 1, plain: int = 10, spm: int = 20) -> DataFrame:
    """``docs`` with n (units), form, prefix_chars, middle_chars (null if plain) and output.

    ``plain`` documents of 100 stay as they are, ``spm`` of 100 of the others have their suffix first.
    """
    ours = {n: fresh(docs, n) for n in ("whole", "units", "digest", "low", "high", "before", "between", "after", "n", "form", "prefix_chars", "middle_chars", "output")}
    c = {n: F.col(name) for n, name in ours.items()}
    number = lambda k: F.conv(F.substring(c["digest"], 8 * k + 1, 8), 16, 10).cast("long")
    text = F.coalesce(F.col("text"), F.lit(""))
    seeded = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    cells = docs.withColumns({ours["whole"]: text, ours["units"]: marked(text, unit), ours["digest"]: seeded})
    counted = cells.withColumn(ours["n"], (F.length(c["units"]) - F.length(F.replace(c["units"], F.lit(MARK), F.lit("")))).cast("long"))
    signs = F.lit(False)
    for sign in (PREFIX, SUFFIX, MIDDLE):
        signs |= F.contains(c["whole"], F.lit(sign))
    form = F.when((c["whole"] == "") | signs | (number(2) % 100 >= 100 - plain), "plain").when(number(3) % 100 < spm, "spm").otherwise("psm")
    cuts = [number(k) % (c["n"] + 1) for k in (0, 1)]
    placed = counted.withColumns({ours["form"]: form, ours["low"]: F.least(*cuts), ours["high"]: F.greatest(*cuts)})
    parts = {"before": first_units(c["units"], c["low"]), "between": first_units(first_units(c["units"], c["high"]), c["low"] - c["high"]), "after": first_units(c["units"], c["high"] - c["n"] - 1)}
    moved = c["form"] != "plain"
    cut = placed.withColumns({ours[n]: F.when(moved, unmarked(part)) for n, part in parts.items()})
    psm = F.concat(F.lit(PREFIX), c["before"], F.lit(SUFFIX), c["after"], F.lit(MIDDLE), c["between"])
    spm_ = F.concat(F.lit(SUFFIX), c["after"], F.lit(PREFIX), c["before"], F.lit(MIDDLE), c["between"])
    return cut.select(
        *[col(name) for name in docs.columns],
        ours["n"],
        ours["form"],
        F.length(c["before"]).cast("long").alias(ours["prefix_chars"]),
        F.length(c["between"]).cast("long").alias(ours["middle_chars"]),
        F.when(c["form"] == "psm", psm).when(c["form"] == "spm", spm_).otherwise(c["whole"]).alias(ours["output"]),
    )


def digest(formed: DataFrame) -> DataFrame:
    """doc_id, n, form, the two lengths, and digests of the output and of the text rebuilt from it and its form."""
    return formed.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("form"), F.col("output")), 256).alias("restored_sha256"))


SQL = r"""
    WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
    d AS (SELECT doc_id, text, length(text)::BIGINT AS n, list_transform([1, 9, 17, 25], lambda k: list_sum(list_transform(range(8), lambda i: (instr('0123456789abcdef', substr(h, (k + i)::BIGINT, 1)) - 1)::BIGINT * (16 ** (7 - i))::BIGINT))::BIGINT) AS h FROM t),
    p AS (SELECT doc_id, text, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
                 CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
    c AS (SELECT *, substring(text, 1, a) AS pre, substring(text, a + 1, b - a) AS mid, substring(text, b + 1, n - b) AS suf FROM p)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
           sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE text END) AS output_sha256,
           sha256(text) AS restored_sha256
    FROM c"""
