import math
import random
import re

import pytest
from cases import awkward, documents, words
from pyspark.sql import functions as F

from lodestone.llm import license_scan as L
from lodestone.llm import queries

TEMPLATES = (("one", "alpha beta gamma"), ("two", "alpha beta gamma delta epsilon zeta eta theta iota kappa"), ("two", "solo"), ("three", "the of and in to license rare a b c d e f g h i j k l m"))


def tokens(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, templates, threshold):
    """Every block against every template."""
    found, seq = set(), tokens(text)
    for k, (label, notice) in enumerate(templates):
        those = tokens(notice)
        width = 1 << (len(those) - 1).bit_length()
        for start in range(0, max(1, len(seq)), width):
            common = len(set(those) & set(seq[start : start + 2 * width]))
            if common >= math.ceil(threshold * len(set(those)) - 1e-9):
                found.add((k, label, start, start + 2 * width, common / len(set(those))))
    places = [(i, label) for phrase, label in L.PHRASES for i in range(len(seq)) if seq[i : i + len(phrase.split())] == phrase.split()]
    labels = sorted({f[1] for f in found} | {p[1] for p in places})
    return len(seq), sorted(places), sorted(found), labels, 1.0 if places else max([f[4] for f in found], default=0.0)


def texts():
    rng = random.Random(5)
    pool = tokens(" ".join(t for _, t in TEMPLATES)) + ["mit", "license", "general", "public", "apache", "x", "y"]
    rows = [(1000 + i, " ".join(rng.choice(pool) for _ in range(rng.randrange(60)))) for i in range(200)]
    rows += [(10, "The MIT License, mit license MIT-license"), (11, "GNU General\nPublic\tLicense general public License"), (12, "Apache licenſe mİt license"), (13, "Kappa alpha beta"), (14, "mit" * 3), (15, "license mit"), (16, "general general public license")]
    return awkward() + rows + [(2000, words(3000, 1) + " Released under the MIT License. " + words(3000, 2)), (2001, "released under an mit license"), (2002, "permission is hereby\n# granted free of charge to any person obtaining\n# a copy of this software and associated documentation files")]


@pytest.mark.parametrize(("templates", "threshold"), [(TEMPLATES, 0.8), (TEMPLATES, 0.3), (TEMPLATES, 1.0), (L.TEMPLATES, 0.8), ((), 0.8)])
def test_brute_force(spark, templates, threshold):
    rows = texts()
    out = L.license_scan(documents(spark, rows, key="clash", other="clash", size="clash", words="clash", rank="clash"), templates, threshold=threshold).collect()
    found = sorted([(r["doc_id"], r["n_words"], sorted(map(tuple, r["places"])), sorted(map(tuple, r["blocks"])), r["labels"], r["score"]) for r in out], key=str)
    assert found == sorted([(i, *brute(t, templates, threshold)) for i, t in rows], key=str)


def test_columns_of_any_name_stay(spark):
    df = documents(spark, texts()[:40]).withColumns({n: F.lit(n) for n in ("labels", "blocks", "SCORE", "a.b")})
    out = L.license_scan(df)
    assert out.columns == [*df.columns, "n_words", "places", "blocks_", "labels_", "score_"]
    assert all(r["labels"] == "labels" and r["a.b"] == "a.b" for r in out.collect())
    assert L.license_scan(documents(spark, [])).count() == 0


def test_templates_are_checked():
    with pytest.raises(ValueError, match="no words"):
        L.parsed([("x", "--")], 0.8)
    with pytest.raises(ValueError, match="share"):
        L.parsed(L.TEMPLATES, 0)
    with pytest.raises(ValueError, match="different words"):
        L.parsed([("x", " ".join(f"w{i}" for i in range(L.MOST_WORDS + 1)))], 0.8)


def test_no_python_in_the_plan(spark):
    plan = L.license_scan(documents(spark, texts()).filter("doc_id > 0"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_very_long_text(spark):
    text = "Licensed under CC BY-NC 4.0.\n" + words(200_000, 7) + "\nGeneral Public License"
    row = L.digest(L.license_scan(documents(spark, [(1, text)]))).first()
    assert (row["n_words"], row["n_base"], row["first_word"], row["labels"], row["score"]) == (200_010, 1, 200_007, "cc-by-nc,gpl", 1.0) or row["labels"].startswith("cc-by")


def test_sql(spark, small):
    from compare import difference

    assert difference(spark, queries.QUERIES["op12_license_scan"], queries.SQL["op12_license_scan"], small) == ""
