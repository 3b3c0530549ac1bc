import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from cases import awkward, documents, words

from lodestone.llm import queries
from lodestone.llm.common import filter_log2, mix, repeated_filter
from lodestone.llm.exact_dedup import exact_dedup


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[hashlib.sha256(re.sub("[\x20\x09-\x0d]", "", t or "").encode()).hexdigest()].append((-len(t or ""), i is None, i))
    out = []
    for key, members in groups.items():
        keep = min(members, key=lambda m: (m[0], m[1], m[2] if m[2] is not None else 0))[2]
        out += [(i, keep, len(members), i == keep, key) for _, _, i in members]
    return sorted(out, key=str)


def found(df):
    return sorted([(r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup(df).collect()], key=str)


@pytest.mark.parametrize("rows", [awkward(), [(i, words(5, i % 30)) for i in range(200)], []])
def test_brute_force(spark, rows):
    assert found(documents(spark, rows, digest="clash", h="clash")) == brute(rows)


def test_sql(spark, small):
    from compare import difference

    assert difference(spark, queries.QUERIES["op4_exact_dedup"], queries.SQL["op4_exact_dedup"], small) == ""


def test_filter_has_all_repeated(spark):
    keys = mix(np.arange(20_000, dtype=np.uint64))
    h = spark.createDataFrame([(int(k),) for k in keys[np.arange(1000) % 700].view(np.int64)], "h long").repartition(5)
    twice = repeated_filter(h, filter_log2(1000))
    assert twice.has(keys[:300]).all()
    assert twice.has(keys[300:700]).mean() < 0.05
    once = repeated_filter(h, filter_log2(1000), least=1)
    assert once.has(keys[:700]).all() and once.has(keys[10_000:]).mean() < 0.05
