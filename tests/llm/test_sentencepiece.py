import random

import numpy as np
import pytest
import sentencepiece
from cases import awkward, documents, words

from lodestone.llm import sentencepiece_codec as P

TEXTS = ["", " ", "a", "Hello, world!  Two  blanks\nand lines\t", "Ünïcödé 日本語 テスト 🙂🙂", "  leading and trailing  ", "x" * 3_000, "word " * 300, "123 4567 8.90 (a-b) [c]_d", words(400, 1), "▁odd"]


@pytest.fixture(scope="module")
def codec():
    return P.Codec(*P.load_pieces(P.MODEL))


def stream(codec, text):
    return [i for part in codec.stream(P.BLANK + text.replace(" ", P.BLANK)) for i in part] if text else []


def test_ids_of_a_merge_vocabulary_are_the_models(codec):
    """Where the model's own normaliser leaves the text alone, its ids are ours, from words and from the stream."""
    model = sentencepiece.SentencePieceProcessor(model_file=P.MODEL)
    rng = random.Random(2)
    for text in [*TEXTS, *("".join(rng.choice("ab cdé,. 1\n") for _ in range(200)) for _ in range(30))]:
        ids = np.frombuffer(codec.encode(text), "<i4").tolist()
        assert stream(codec, text) == ids
        assert codec.decode(np.array(ids, np.int64)) == text.replace(P.BLANK, " ")
        if text.strip(" ") == text and "  " not in text and P.BLANK not in text:
            assert ids == model.encode(text), text[:50]


def best_path(pieces, text, worst):
    """Plain Viterbi over the whole text: the best sum of scores."""
    scores = {p: s for p, s, kind in pieces if kind == "normal"}
    best = [0.0] + [-np.inf] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - 8), end):
            if text[start:end] in scores:
                best[end] = max(best[end], best[start] + scores[text[start:end]])
        if text[end - 1] not in scores:
            best[end] = max(best[end], best[end - 1] + worst)
    return best[-1]


def test_streaming_viterbi_of_a_unigram_vocabulary():
    rng = random.Random(4)
    some = {"".join(rng.choice("abc▁") for _ in range(rng.randrange(2, 6))) for _ in range(60)}
    pieces = [("<unk>", 0.0, "unknown"), *((c, -6.0, "normal") for c in "abc▁"), *((p, -rng.uniform(3, 12), "normal") for p in sorted(some))]
    codec = P.Codec(pieces, merges=False)
    score = {p: s for p, s, _ in pieces}
    for n in (1, 5, 40, 400):
        for _ in range(20):
            text = "".join(rng.choice("aabbc d") for _ in range(n))
            marked = P.BLANK + text.replace(" ", P.BLANK)
            for ids in (np.frombuffer(codec.encode(text), "<i4").tolist(), stream(codec, text)):
                total = sum(score[pieces[i][0]] if i else codec.worst for i in ids)
                assert abs(total - best_path(pieces, marked, codec.worst)) < 1e-6
                if 0 not in ids:
                    assert "".join(pieces[i][0] for i in ids) == marked


def test_window_is_bounded(codec):
    """The stream commits as it goes: no part is longer than a few windows, however long the text."""
    parts = list(codec.stream(P.BLANK + "The quick brown fox. " * 500))
    assert len(parts) > 100 and max(map(len, parts)) < 5 * codec.longest


@pytest.mark.parametrize("rows", [awkward(), []])
def test_round_trip(spark, rows):
    df = P.decode(P.encode(documents(spark, rows, ids="clash")))
    back = sorted([(r["doc_id"], r["text"]) for r in df.collect()], key=str)
    assert back == sorted([(i, (t or "").replace(P.BLANK, " ")) for i, t in rows], key=str)


def test_words_kept_at_hand_change_nothing(monkeypatch):
    """Ids are the same with few words and pairs kept, whichever generation they come from."""
    texts = [words(200, i, 300) + " mixed Ünï 日本 words" for i in range(12)]
    whole = P.Codec(*P.load_pieces(P.MODEL))
    want = [whole.encode(t) for t in texts]
    monkeypatch.setattr(P, "KEPT", 40)
    few = P.Codec(*P.load_pieces(P.MODEL))
    assert [few.encode(t) for t in texts] == want and few.older and len(few.known) <= 40
