from collections import defaultdict

import pytest

from lodestone.llm import chat_format as C
from lodestone.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string, place long, part string"


def brute(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in convs.items()}
    out = []
    for c, own in turns.items():
        longer = any(len(o) > len(own) and o[: len(own)] == own for o in turns.values())
        equal = [k for k, o in turns.items() if o == own]
        first = None if None in equal else min(equal)
        if not longer and c == first:
            out.append((c, len(own), "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in own)))
    return sorted(out, key=str)


def found(df):
    pieces = defaultdict(list)
    for r in C.chat_format(df).collect():
        pieces[r["conv_id"], r["n_turns"]].append((r["piece"], r["text"]))
    return sorted([(c, n, "".join(t for _, t in sorted(p))) for (c, n), p in pieces.items()], key=str)


def logged():
    rows = []
    for c in range(12):
        base = [("user" if k % 2 == 0 else "assistant", f"{c // 4} says {k}") for k in range(2 + c % 4 * 2)]
        rows += [(c, k, r, t) for k, (r, t) in enumerate(base)]
    rows += [(50, 0, "user", "0 says 0"), (50, 1, "assistant", "another answer"), (51, 0, "user", "tie"), (52, 0, "user", "tie"), (53, None, None, None), (53, 1, "user", "x"), (54, 3, "user", "a"), (54, 3, "user", "b")]
    return rows + [(None, 0, "user", "tie"), (None, 1, "user", "more"), (60, 0, "", "")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "clash") for r in rows], SCHEMA)


@pytest.mark.parametrize("rows", [logged(), []])
def test_brute_force(spark, rows):
    assert found(frame(spark, rows)) == brute(rows)


def test_long_conversations_go_in_parts(spark, monkeypatch):
    monkeypatch.setattr(C, "PART", 3)
    monkeypatch.setattr(C, "MOST_TURNS", 4)
    rows = [(c, k, "user", f"turn {k}") for c in range(4) for k in range(10 + c * 3)] + [(9, k, "user", f"turn {k}" if k != 7 else "other") for k in range(12)]
    assert found(frame(spark, rows)) == brute(rows)


def test_sql(spark, small):
    from compare import difference

    assert difference(spark, queries.QUERIES["op2_chat_format"], queries.SQL["op2_chat_format"], small) == ""
