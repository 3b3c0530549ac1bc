import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from cases import awkward, documents, words
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import suffix_dedup as S
from lodestone.llm.suffix_array import repeated_starts, suffix_arrays


def brute(rows, width=200):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for (doc, _), t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - width + 1):
            if seen[t[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(bool(g) and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted([(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in S.digest(S.suffix_dedup(df)).collect()], key=str)


def passages():
    """Documents with shared passages at many lengths and places, runs of one byte and periodic texts."""
    rng = random.Random(3)
    shared = [words(rng.randrange(30, 120), 100 + i) for i in range(6)]
    rows = []
    for i in range(60):
        parts = [words(rng.randrange(5, 80), i)]
        for _ in range(rng.randrange(3)):
            p = rng.choice(shared)
            a = rng.randrange(len(p) // 3)
            parts += [p[a : a + rng.randrange(150, 700)], words(rng.randrange(1, 20), 1000 * i + len(parts))]
        rows.append((i, " ".join(parts)))
    return rows + [(100, "ab" * 400), (101, "x" * 700), (102, "é" * 300), (103, shared[0] + shared[0]), (104, "q" * 199), (105, "y" * 200), (106, "z" * 201)]


@pytest.mark.parametrize("rows", [passages(), [(1, None), (2, ""), (3, "short"), (4, "short")], []])
def test_brute_force(spark, rows):
    assert found(documents(spark, rows, rid="clash", spans="clash", h="clash").repartition(3)) == brute(rows)


def test_awkward_rows(spark):
    assert found(documents(spark, awkward())) == brute(awkward())


def test_frequent_anchors_go_by_pieces(spark, monkeypatch):
    """A line that very many documents share, with different text around it."""
    monkeypatch.setattr(S, "MOST_BYTES", 3_000)
    line = words(40, 77)
    rows = [(i, f"{words(30, i)} {line} {words(30, 5000 + i % 20)}") for i in range(80)]
    assert found(documents(spark, rows)) == brute(rows)


def test_without_repeats_keeps_columns_and_characters(spark):
    passage = "é" * 150
    rows = [(1, "one " + passage + " a"), (2, "two " + passage + " b"), (3, None)]
    df = documents(spark, rows, kept="clash")
    left = {r["doc_id"]: r for r in S.without_repeats(df).collect()}
    assert left[1].asDict().keys() == set(df.columns) and left[1]["kept"] == "clash"
    assert left[3]["text"] == "" and "é" not in left[1]["text"] and left[1]["text"].startswith("one")


def test_columns_of_any_name_stay(spark):
    names = ["_", "none", "NONE_", "row", "rid", "spans", "kept", "n_bytes", "h", "a.b", "start"]
    df = documents(spark, passages()).withColumns({n: F.concat(F.lit(n), F.col("doc_id")) for n in names})
    out = S.without_repeats(df)
    assert out.columns == df.columns
    rows = out.collect()
    assert len(rows) == len(passages()) and all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in names)


def test_texts_longer_than_a_block(spark):
    """Repeats within, across and at the edges of the blocks that a long text is gone through in; and runs of one short period."""
    passage = words(60, 5, 5000)
    long = list(words(60_000, 8, 90_000))
    for at in (10, S.BLOCK - 300, S.BLOCK - 100, 2 * S.BLOCK - 450, len(long) - len(passage)):
        long[at : at + len(passage)] = passage
    rows = [(1, "".join(long)), (2, passage[5:305]), (3, words(400, 6, 5000))]
    assert len(rows[0][1]) > 300_000
    assert found(documents(spark, rows)) == brute(rows)
    period = "abc" * 700_000
    (got,) = found(documents(spark, [(1, period)]))
    assert got == (1, len(period), len(period), 1, hashlib.sha256(b"").hexdigest())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=0, max_size=60).map(lambda b: bytes(x % 3 + 97 for x in b)), min_size=1, max_size=6))
def test_suffix_arrays(texts):
    """Linear grouping gives the order of plain sorting, for many texts at once."""
    symbols = np.concatenate([np.r_[np.frombuffer(t, np.uint8).astype(np.int64), 0] for t in texts])
    base = np.r_[0, np.cumsum([len(t) + 1 for t in texts])]
    order = suffix_arrays(symbols, base)
    for i in range(len(texts)):
        own = symbols[base[i] : base[i + 1]].tolist()
        assert (order[base[i] : base[i + 1]] - base[i]).tolist() == sorted(range(len(own)), key=lambda k: own[k:])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.binary(min_size=0, max_size=40).map(lambda b: bytes(x % 2 + 97 for x in b)), min_size=1, max_size=4), min_size=1, max_size=3))
def test_repeated_starts(buckets):
    for bucket, starts in zip(buckets, repeated_starts(buckets, 4), strict=True):
        seen = Counter(t[i : i + 4] for t in bucket for i in range(len(t) - 3))
        assert [s.tolist() for s in starts] == [[i for i in range(len(t) - 3) if seen[t[i : i + 4]] > 1] for t in bucket]
