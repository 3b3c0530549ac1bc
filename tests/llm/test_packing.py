import re

import numpy as np
import pytest
from cases import awkward, documents, words
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm.packing import RoomTree, best_fit_packing, pack, pack_variable, position_ids, split_long, word_lengths
from lodestone.llm.token_ids import PAD, token_rows

LENGTHS = st.lists(st.integers(0, 300), max_size=60)


@given(st.lists(st.tuples(st.integers(0, 100), st.booleans()), max_size=80))
def test_room_tree(steps):
    """Least room that is enough, as a plain list gives it."""
    tree, rooms = RoomTree(100), []
    for i, (room, put) in enumerate(steps):
        if put:
            tree.add(room, i)
            rooms.append((room, i))
        else:
            fits = [r for r in rooms if r[0] >= room]
            best = min(fits, key=lambda r: (r[0], -r[1]), default=None)
            assert tree.take(room) == best
            if best:
                rooms.remove(best)


def plain_best_fit(lengths, capacity):
    rooms = []
    for n in sorted((p[2] for p in split_long(lengths, capacity)), reverse=True):
        fits = [k for k, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits, key=lambda k: rooms[k])] -= n
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


@given(LENGTHS)
def test_pack_is_best_fit_decreasing(lengths):
    bins = pack(lengths, 100)
    assert sorted(100 - sum(p[2] for p in b) for b in bins) == plain_best_fit(lengths, 100)
    assert sorted(p for b in bins for p in b) == sorted(split_long(lengths, 100))


@settings(deadline=None)
@given(LENGTHS)
def test_variable_capacities(lengths):
    """Nothing is lost, bins are as small as their contents allow, and cost no more than with the largest size alone."""
    sizes, cost = (32, 64, 128), lambda s: s + 4
    bins = pack_variable(lengths, sizes, cost)
    assert sorted(p for _, b in bins for p in b) == sorted(split_long(lengths, 128))
    for size, b in bins:
        used = sum(p[2] for p in b)
        assert used <= size and (size == 32 or used > size // 2)
    one = [next(s for s in sizes if s >= sum(p[2] for p in b)) for b in pack(lengths, 128)]
    assert sum(cost(s) for s, _ in bins) <= 1.35 * sum(map(cost, one)) + 40


def test_positions():
    assert position_ids([0, 3, 5], 8).tolist() == [0, 1, 2, 0, 1, 0, 1, 2]
    assert position_ids([0, 8], 8).tolist() == list(range(8))


@pytest.mark.parametrize("rows", [awkward(), [(i, words(i * 7 % 900, i)) for i in range(150)], []])
def test_best_fit_packing_loses_nothing(spark, rows):
    df = documents(spark, rows, length="clash").repartition(3)
    bins = best_fit_packing(word_lengths(df), block=40).collect()
    pieces = {}
    for b in bins:
        assert b["used"] == sum(b["lengths"]) <= b["capacity"] and b["capacity"] in (256, 512, 1024, 2048, 4096)
        assert b["capacity"] == 256 or b["used"] > b["capacity"] // 2
        for i, at, n in zip(b["doc_ids"], b["starts"], b["lengths"], strict=True):
            pieces.setdefault(i, []).append((at, n))
    assert len({b["bin_id"] for b in bins}) == len(bins)
    expected = {}
    for i, t in rows:
        expected.setdefault(i, []).append(len(re.findall("[^\x20\x09-\x0d]+", t or "")))
    for i, sizes in expected.items():
        assert sum(n for _, n in pieces.get(i, [])) == sum(sizes)
        if len(sizes) == 1:
            at = 0
            for start, n in sorted(pieces.get(i, [])):
                assert start == at
                at += n


@pytest.mark.parametrize("rows", [[*awkward(), (20, "ends <|endoftext|> here")], []])
def test_token_rows_round_trip(spark, rows):
    import base64

    import tiktoken

    from lodestone.llm.token_ids import PATTERN, VOCABULARY

    width = 512
    found = token_rows(documents(spark, rows, ids="clash").coalesce(1), width=width).collect()
    parts = {}
    for r in found:
        ids = np.frombuffer(r["ids"], "<u2")
        edges = r["cu_seqlens"]
        assert len(ids) == width and edges[0] == 0 and edges[-1] == r["n_tokens"] and r["position_resets"] == edges[:-1]
        assert (ids[r["n_tokens"] :] == PAD).all()
        for doc, start, a, b in zip(r["doc_ids"], r["starts"], edges[:-1], edges[1:], strict=True):
            parts.setdefault(doc, []).append((start, ids[a:b]))
    with open(VOCABULARY, "rb") as lines:
        ranks = {base64.b64decode(t): int(k) for t, k in (x.split() for x in lines)}
    codec = tiktoken.Encoding("test", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    unique = {i: t or "" for i, t in rows if [x for x, _ in rows].count(i) == 1}
    for i, text in unique.items():
        ids = np.concatenate([p for _, p in sorted(parts.get(i, [(0, np.zeros(0, "<u2"))]), key=lambda p: p[0])]).tolist()
        assert codec.decode(ids) == text and ids == codec.encode(text, disallowed_special=())
