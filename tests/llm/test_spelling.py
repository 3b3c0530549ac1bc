import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from cases import awkward, documents, words

from lodestone.llm import spelling as S


def counted(rows, least_points=6, least_n=5, one_in=199):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            k = h % len(run)
            n[run[:k] + run[k + 1 :] if h % one_in == 0 else run] += 1
    return {w: c for w, c in n.items() if len(w) >= least_points and c >= least_n}


def near(u, v):
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v, strict=True)) == 1
    u, v = sorted((u, v), key=len)
    return len(v) == len(u) + 1 and any(v[:k] + v[k + 1 :] == u for k in range(len(v)))


def grouped(n, times=5, pairs=None):
    """word -> (form, root, n, n_near, form_n), from all pairs unless some are given."""
    if pairs is None:
        some = sorted(n)
        pairs = [(a, b) for i, a in enumerate(some) for b in some[:i] if near(a, b)]
    links = defaultdict(list)
    for a, b in pairs:
        links[a].append(b)
        links[b].append(a)
    best = {w: min(x, key=lambda v: (-n[v], v)) for w, x in links.items()}
    form = {w: b for w, b in best.items() if n[b] >= times * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), n[w], len(links[w]), n[form[w]] if w in form else None) for w in n}


def pairs_by_deletion(n):
    """Candidates that share a word with one character gone, then checked."""
    at = defaultdict(set)
    for w in n:
        for k in {w, *(w[:k] + w[k + 1 :] for k in range(len(w)))}:
            at[k].add(w)
    return [(a, b) for a, b in {(max(x, y), min(x, y)) for g in at.values() for x in g for y in g if x != y} if near(a, b)]


def found(df, **kw):
    out = S.spelling_variants(df, **kw).collect()
    assert len({r["word"] for r in out}) == len(out)
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in out}


def typos(seed, alphabet="abcàÿ", n=40):
    rng = random.Random(seed)
    stems = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(5, 9))) for _ in range(n)]
    rows = []
    for i in range(600):
        w = list(rng.choice(stems))
        for _ in range(rng.choice((0, 0, 0, 1, 1, 2))):
            k, what = rng.randrange(len(w)), rng.randrange(3)
            w[k : k + (what > 0)] = [] if what == 2 else [rng.choice(alphabet)]
        rows.append((i, " ".join(["".join(w)] * rng.choice((1, 5, 30)))))
    return rows


def runs():
    """Repeated characters, where one edit can be told at several places, a chain of forms, and ties."""
    chain = [("aaaaaa", 5), ("aaaaaaa", 25), ("aaaaaaaa", 125), ("aaaaaaaab", 700), ("bbbbbb", 6), ("bbbbbbb", 6), ("abbbbb", 6), ("zzzzzzz", 9), ("zzzzzzzz", 50), ("zzzzzz", 50), ("ZZZzzzz", 0)]
    return [(k, " ".join([w] * n)) for k, (w, n) in enumerate(chain)]


@pytest.mark.parametrize("rows", [typos(1), typos(2, "ab", 12), typos(3, "abcdefghijklmnop", 80), runs(), awkward(), [(1, None), (2, "")], []], ids=range(7))
@pytest.mark.parametrize("hot", [1, 20_000])
def test_all_pairs(spark, rows, hot, monkeypatch):
    monkeypatch.setattr(S, "HOT", hot)
    assert found(documents(spark, rows, word="clash", n="clash", id="clash")) == grouped(counted(rows))


def test_random_words_under_every_hash(spark):
    """Short words of few letters: nearly everything is near, and every kind of merge happens."""
    rng = random.Random(8)
    rows = [(i, " ".join("".join(rng.choice("ab") for _ in range(rng.randrange(1, 6))) for _ in range(40))) for i in range(60)]
    kw = {"least_points": 2, "least_n": 1, "one_in": 3}
    n = counted(rows, **kw)
    assert len(n) > 50 and found(documents(spark, rows), **kw) == grouped(n)


def test_deleted_single_letters(spark):
    rows = [(i, "a b c d e") for i in range(200)]
    kw = {"least_points": 1, "least_n": 1, "one_in": 2}
    assert found(documents(spark, rows), **kw) == grouped(counted(rows, **kw))


def test_hub_and_siblings(spark):
    """A word with near words for each letter at each place: light siblings meet each other."""
    hub = "stream"
    rows = [(0, " ".join([hub] * 100))] + [(1 + k, " ".join([hub[:p] + chr(97 + c) + hub[p + 1 :]] * 5)) for k, (p, c) in enumerate((p, c) for p in range(6) for c in range(26))]
    assert found(documents(spark, rows)) == grouped(counted(rows))


def test_very_long_words(spark):
    long = "acgt" * 50_000
    rows = [(k, w) for k in range(8) for w in (long, long[:70_000] + "t" + long[70_001:], long + "a")]
    out = found(documents(spark, rows))
    n = counted(rows)
    assert out == grouped(n, pairs=[(a, b) for a in n for b in n if a > b and near(a, b)])
    assert sorted(v[3] for v in out.values())[-1] >= 2


def test_whole_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    n = counted([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    out = found(docs)
    assert len(n) > 500 and out == grouped(n, pairs=pairs_by_deletion(n))
    assert any(v[0] for v in out.values())


def test_chains_are_followed_to_their_ends(spark):
    forms = [(f"w{i:03}", f"w{i + 1:03}") for i in range(100)] + [("x", "y")]
    out = {r["word"]: r["root"] for r in S.roots(spark.createDataFrame(forms, "word string, form string")).collect()}
    assert out == {w: "y" if w == "x" else "w100" for w, _ in forms}


def test_hashes_are_rolling():
    words_ = ["abc", "ab", "", "abcd", words(50, 1)]
    h = S.Hashes(words_)
    whole = dict(zip(words_, h.whole.tolist(), strict=True))
    assert len(set(whole.values())) == 5
    assert int(h.prefix[h.start[3] + 2]) == whole["ab"] and int(h.prefix[h.start[3] + 3]) == whole["abc"]
