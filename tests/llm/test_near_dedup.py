import random

import numpy as np
import pytest
from cases import awkward, documents, words
from pyspark.sql import functions as F

from lodestone.llm import near_dedup as N


def sets_of(t, k=5):
    tokens = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()
    return {tuple(tokens[i : i + k]) for i in range(max(1, len(tokens) - k + 1))}


def jaccard(a, b):
    x, y = sets_of(a), sets_of(b)
    return len(x & y) / len(x | y)


def brute(rows, similarity=0.8):
    """The doc_ids that stay: the least of each component of all pairs of ``similarity`` or more."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    sets, parent = [sets_of(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return sorted((rows[i][0] for i in range(len(rows)) if root(i) == i), key=str)


def kept(spark, rows, **extra):
    return sorted((r["doc_id"] for r in N.near_dedup(documents(spark, rows, **extra)).collect()), key=str)


def families():
    """Copies with one word changed, exact copies, and texts of few words."""
    rows = []
    for i in range(40):
        base = words(150, 500 + i // 4).split()
        if i % 4:
            base[(i * 13) % 150] = f"other{i}"
        rows.append((i, " ".join(base)))
    return rows + [(100, None), (101, ""), (102, "alone here"), (103, words(150, 999)), (103, words(150, 999)), (104, words(150, 999).upper())]


def block_pairs():
    """Pairs of one contiguous difference (appended, cut off or replaced words) of similarity 0.8 to 0.9; none is alike to another's texts."""
    rows = []
    for i in range(60):
        base = words(180, 7000 + i, 5000).split()
        n = (10, 14, 18, 22, 26, 30, 34)[i % 7]
        other = words(n, 9000 + i, 5000).split()
        changed = (base + other, base[:-n], base[:60] + other[: n // 2] + base[60 + n // 2 :])[i % 3]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(changed))]
    return rows


def chains():
    """A and C are alike to B only."""
    rows = []
    for i in range(12):
        a, other = words(180, 3000 + i, 5000).split(), words(20, 4000 + i, 5000).split()
        b = other[:10] + a[10:]
        texts = [" ".join(x) for x in (a, b, b[:-10] + other[10:])]
        assert min(jaccard(texts[0], texts[1]), jaccard(texts[1], texts[2])) >= 0.8 > jaccard(texts[0], texts[2])
        rows += [(3 * i + k, x) for k, x in enumerate(texts)]
    return rows


def two_families_in_a_group():
    """A common half, and two families of many texts beside it; within a family texts are alike to some of the others only."""
    rng, rows = random.Random(4), []
    common = words(60, 1, 5000).split()
    for family in range(2):
        base = common + words(120, 50 + family, 5000).split()
        for i in range(40):
            text = list(base)
            for k in rng.sample(range(60, 180), rng.randrange(1, 6)):
                text[k] = f"x{family}{i}{k}"
            rows.append((100 * family + i, " ".join(text)))
    return rows


def everything():
    parts = [families(), block_pairs(), chains(), two_families_in_a_group()]
    return awkward() + [(1000 * (k + 1) + i, t) for k, part in enumerate(parts) for i, t in part]


@pytest.mark.parametrize(("rounds", "often", "seeds"), [(2, 8, 4), (0, 1, 1)])
def test_brute_force(spark, monkeypatch, rounds, often, seeds):
    """Every pair of the similarity counts, and nothing depends on rounds, order or fingerprints."""
    monkeypatch.setattr(N, "ROUNDS", rounds)
    monkeypatch.setattr(N, "OFTEN", often)
    rows = everything()
    assert sum(0.8 <= jaccard(rows[i][1], rows[i + 1][1]) <= 0.9 for i in range(len(rows) - 1)) >= 30
    assert sorted((r["doc_id"] for r in N.near_dedup(documents(spark, rows), seeds=seeds).collect()), key=str) == brute(rows)


def test_nothing(spark):
    assert kept(spark, []) == []


def test_columns_of_any_name_stay(spark):
    names = ["rid", "rid2", "RID_", "maybe", "key", "size", "codes", "code", "label", "order", "group", "a.b", "h"]
    df = documents(spark, families()).withColumns({n: F.concat(F.lit(n), F.col("doc_id")) for n in names})
    out = N.near_dedup(df)
    assert out.columns == df.columns
    rows = out.collect()
    assert rows and all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in names)


def test_all_rows_alike(spark):
    """One group of copies with a third of all rows, each row twice."""
    rows = [(i, words(60, 3) + f" tail{i % 50}") for i in range(200)] * 2 + [(1000 + i, words(60, 100 + i)) for i in range(100)]
    assert kept(spark, rows) == [0, *range(1000, 1100)] == sorted(brute(rows), key=str)


def test_shingles_are_told_apart():
    known = N.Words()
    rng = random.Random(2)
    texts = [[bytes([97 + rng.randrange(3)]) for _ in range(rng.randrange(1, 40))] for _ in range(300)]
    for k in (2, 5):
        windows = {tuple(t[i : i + k]) for t in texts for i in range(max(1, len(t) - k + 1))}
        hashes = np.concatenate([N.shingles(known.of(t), k) for t in texts])
        assert len(np.unique(hashes)) == len(windows)
