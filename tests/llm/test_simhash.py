import random
import re

import numpy as np
import pytest
import xxhash
from cases import awkward, documents, words

from lodestone.llm import simhash as S


def fingerprint(text, k=3):
    tokens = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not tokens:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(tokens[i : i + k]).encode(), 42) for i in range(max(1, len(tokens) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(codes, budget):
    parent = {c: c for c in codes}

    def root(c):
        while parent[c] != c:
            c = parent[c]
        return c

    some = sorted(parent)
    for i, a in enumerate(some):
        for b in some[:i]:
            if (a ^ b).bit_count() <= budget:
                parent[root(a)] = root(b)
    return {c: root(c) for c in parent}


def brute(rows, budget=2):
    coded = [(i, fingerprint(t)) for i, t in rows]
    of = components([c for _, c in coded], budget)
    least = {}
    for i, c in coded:
        if i is not None:
            least[of[c]] = min(least.get(of[c], i), i)
    return sorted([(i, f"{c:016x}", least.get(of[c])) for i, c in coded], key=str)


def found(df):
    return sorted([(r["doc_id"], r["fingerprint"], r["component_id"]) for r in S.simhash_dedup(df).collect()], key=str)


def near_copies():
    rows = []
    for i in range(60):
        base = words(80, i // 4)
        tokens = base.split()
        if i % 4:
            tokens[i % 80] = f"changed{i}"
        rows.append((i, " ".join(tokens).upper() if i % 7 == 0 else " ".join(tokens)))
    return rows


@pytest.mark.parametrize("rows", [awkward(), near_copies(), []])
def test_brute_force(spark, rows):
    assert found(documents(spark, rows, code="clash", label="clash")) == brute(rows)


def test_links_of_chains_and_hot_buckets(spark, monkeypatch):
    """Chains of fingerprints that are two bits apart, and buckets that have to be split."""
    monkeypatch.setattr(S, "MOST", 40)
    rng = random.Random(5)
    codes, at = set(), rng.getrandbits(64)
    for _ in range(300):
        at ^= 1 << rng.randrange(12)
        codes.add(at)
    codes |= {rng.getrandbits(64) for _ in range(200)} | {0, (1 << 64) - 1, 3, 1 << 63}
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    edges = S.links(spark.createDataFrame([(0, c) for c in signed], "seed int, code long"), 2)
    got = {r["code"] % (1 << 64): r["label"] % (1 << 64) for r in S.components(edges.select("a", "b")).collect()}
    expected = components(list(codes), 2)
    groups = lambda of: {frozenset(c for c in codes if of.get(c, c) == r) for r in {of.get(c, c) for c in codes}}
    assert groups(got) == groups(expected)


def test_trie_pairs():
    rng = np.random.default_rng(1)
    codes = np.unique(rng.integers(0, 1 << 20, 600).astype(np.uint64) << np.uint64(20))
    i, j = S.trie_pairs(codes, np.array([0]), np.array([len(codes)]), 2)
    pairs = {(a, b) for a in range(len(codes)) for b in range(a + 1, len(codes)) if bin(int(codes[a] ^ codes[b])).count("1") <= 2}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == pairs
