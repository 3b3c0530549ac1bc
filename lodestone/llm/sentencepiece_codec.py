"""Encoding into and decoding from the pieces of a SentencePiece vocabulary, by streaming Viterbi.

For a unigram vocabulary the best path maximises the sum of piece scores. For a merge (BPE) vocabulary the scores only rank
merges, and a sum of them would not give the ids that such a model gives; there a step is allowed or not: a piece may follow
another if merging their joined text gives back just these two, and each place then has one path, that of the text before it.
Going through a text, only the last places are needed, as many as the longest piece has characters. Whenever the backpointer paths of all of them meet
in one place, what lies before it can't change any more: its ids are given out and forgotten. A text is first cut where no
piece can reach across (before blanks, for ordinary vocabularies), which changes nothing and lets the ids of repeated words be looked
up; words not seen before, of whatever length, go through the same routine.

A character that no piece covers becomes its UTF-8 bytes where the vocabulary has byte pieces, or else the unknown piece.

Defined results: null text counts as empty; an empty text has no ids; equal texts have equal ids; blanks are written as U+2581
and one is put in front, so that a text which itself holds U+2581 decodes to blanks there; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from .common import slices, text_rows

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Fixed values of the format: the blank's sign, what an unknown character costs beside the worst piece, and byte pieces.
BLANK, PENALTY, BYTE = "▁", 10.0, re.compile(r"<0x([0-9A-F]{2})>")
#: Words whose ids a task keeps at hand.
KEPT = 300_000


def load_pieces(path: str) -> tuple[list[tuple[str, float, str]], bool]:
    """(piece, score, kind) by id; kind is "normal", "byte", "unknown" or "" (control and unused pieces). And if scores rank merges."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kind = lambda i: "unknown" if model.is_unknown(i) else "byte" if model.is_byte(i) else "" if model.is_control(i) or model.is_unused(i) else "normal"
    with open(path, "rb") as file:
        proto = sentencepiece_model_pb2.ModelProto.FromString(file.read())
    return [(model.id_to_piece(i), model.get_score(i), kind(i)) for i in range(model.get_piece_size())], proto.trainer_spec.model_type == 2


def pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}i", *ids)


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, pieces: list[tuple[str, float, str]], merges: bool):
        self.merges = merges
        self.tree: dict = {}
        usable = [(p, s, i) for i, (p, s, kind) in enumerate(pieces) if kind == "normal"]
        for piece, score, i in usable:
            node = self.tree
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = (score, i)
        self.rank = {p: s for p, s, _ in usable}
        self.pieces = [p for p, _, _ in pieces]
        self.allowed: dict[tuple[int, int], bool] = {}
        self.longest = max((len(p) for p, _, _ in usable), default=1)
        self.unknown = next((i for i, p in enumerate(pieces) if p[2] == "unknown"), 0)
        self.bytes = {int(m[1], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == "byte" and (m := BYTE.fullmatch(p))}
        self.worst = min((s for _, s, _ in usable), default=0.0) - PENALTY
        self.words = self._cutter([p for p, _, _ in usable])
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.text_of = np.array([BYTE.fullmatch(p) and "" or ("" if kind == "" else p) for p, _, kind in pieces], object)
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.is_byte = np.zeros(len(pieces), bool)
        self.is_byte[list(self.byte_of)] = True

    @staticmethod
    def _cutter(pieces: list[str]):
        """A function that cuts a text before blanks and before marks, where no piece reaches from another character to one."""
        if any(re.search(f"[^{BLANK}]{BLANK}", p) for p in pieces):
            return lambda text: [text]
        marks = {chr(i) for i in range(128) if not chr(i).isalnum()}
        pairs = {pair for p in pieces for pair in zip(p, p[1:], strict=False)}
        while bad := {b for a, b in pairs if b in marks and a not in marks and a != BLANK}:
            marks -= bad
        of = "".join(map(re.escape, sorted(marks)))
        return re.compile(f"{BLANK}*[{of}]*[^{BLANK}{of}]+|{BLANK}*[{of}]+|{BLANK}+" if of else f"{BLANK}*[^{BLANK}]+|{BLANK}+").findall

    def follows(self, before: int, after: int) -> bool:
        """If merging the text of two pieces gives back these two."""
        if before < 0 or after < 0 or (found := self.allowed.get((before, after))):
            return True
        if found is None:
            left, get = self.pieces[before], self.rank.get
            parts, edge = [*left, *self.pieces[after]], len(left)  # so many parts are of the first piece
            while True:
                best, at, one = -np.inf, 0, parts[0]
                for k in range(1, len(parts)):
                    other = parts[k]
                    rank = get(one + other)
                    if rank is not None and rank > best:
                        best, at = rank, k
                    one = other
                if not at or at == edge:  # no merge, or one of both pieces, which never comes apart again
                    break
                edge -= at < edge
                parts[at - 1 : at + 1] = [parts[at - 1] + parts[at]]
            found = not at and edge == 1 and len(parts) == 2
            if len(self.allowed) >= KEPT:
                self.allowed.clear()
            self.allowed[before, after] = found
        return found

    def stream(self, text: str) -> Iterator[list[int]]:
        """Ids of a text, some at a time: what the surviving paths agree on."""
        n, done, longest, tree, worst, merges = len(text), 0, self.longest, self.tree, self.worst, self.merges
        best: dict[int, float] = {0: 0.0}  # scores of places that can still be left
        back: dict[int, tuple[int, int]] = {}  # place: (place before, id or -1), after the last commitment
        last = -1  # what was committed last
        allowed = self.allowed.get
        for i in range(n):
            here = best.pop(i, None)
            if here is None:
                continue
            node, single, end = tree, False, i
            before = back[i][1] if i > done else last
            while end < n and (node := node.get(text[end])) is not None:
                end += 1
                if (piece := node.get("")) is None:
                    continue
                if end == i + 1:
                    single = True
                if merges:
                    if end not in best:
                        which = piece[1]
                        if (found := allowed((before, which))) or found is None and self.follows(before, which):
                            best[end], back[end] = 0.0, (i, which)
                elif (total := here + piece[0]) > best.get(end, -np.inf):
                    best[end], back[end] = total, (i, piece[1])
            if not single and (total := here + worst) > best.get(i + 1, -np.inf):
                best[i + 1], back[i + 1] = total, (i, -1)
            if i - done >= longest:
                meet = self._meet(best, back, done)
                if meet > done:
                    yield self._ids(text, back, done, meet)
                    last = back[meet][1]
                    for place in [p for p in back if p <= meet]:
                        del back[place]
                    done = meet
        if done < n:
            yield self._ids(text, back, done, n)

    @staticmethod
    def _meet(best: dict[int, float], back: dict[int, tuple[int, int]], done: int) -> int:
        """The last place that the paths to all live places go through."""
        live = set(best)
        while len(live) > 1:
            last = max(live)
            live.remove(last)
            live.add(back[last][0] if last > done else done)
        return live.pop()

    def _ids(self, text: str, back: dict[int, tuple[int, int]], start: int, stop: int) -> list[int]:
        out: list[int] = []
        while stop > start:
            before, which = back[stop][:2]
            if which >= 0:
                out.append(which)
            elif self.bytes:
                out += [self.bytes[b] for b in reversed(text[before:stop].encode())]
            else:
                out.append(self.unknown)
            stop = before
        return out[::-1]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        if not text:
            return b""
        known, older, out = self.known, self.older, []
        for word in self.words(BLANK + text.replace(" ", BLANK)):
            ids = known.get(word)
            if ids is None:
                if (ids := older.get(word)) is None:
                    ids = pack([i for part in self.stream(word) for i in part])
                if len(word) <= self.longest:
                    if len(known) >= KEPT:  # frequent words come over from the ones before, the others go with the next change
                        known, older = {}, known
                        self.known, self.older = known, older
                    known[word] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        if not self.is_byte[ids].any():
            text = "".join(self.text_of[ids])
        else:
            text = b"".join(bytes([self.byte_of[i]]) if i in self.byte_of else self.text_of[i].encode() for i in ids.tolist()).decode(errors="replace")
        return text.replace(BLANK, " ")[1:]


_held: dict[str, Codec] = {}


def held_codec(name: str, pieces) -> Codec:
    """The codec of a vocabulary, built once for all tasks of a Python worker, with the words that it has looked up."""
    if name not in _held:
        _held.clear()
        _held[name] = Codec(*pieces.value)
    return _held[name]


def load(docs: DataFrame, model: str):
    """The vocabulary's digest, and the vocabulary (as large as it is, whatever the corpus) as a broadcast variable."""
    with open(model, "rb") as file:
        name = hashlib.sha256(file.read()).hexdigest()
    return name, docs.sparkSession.sparkContext.broadcast(load_pieces(model))


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and ids (array of int)."""
    name, pieces = load(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = held_codec(name, pieces)
        for batch in slices(batches):
            coded = [codec.encode(t) for t in batch.column(1).to_pylist()]
            flat = np.frombuffer(b"".join(coded), "<i4")
            ends = np.cumsum([0, *(len(c) // 4 for c in coded)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))], ["doc_id", "ids"])

    return text_rows(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(coded: DataFrame, model: str = MODEL) -> DataFrame:
    """``coded`` (doc_id, ids; null: none) with the text that the ids stand for."""
    name, pieces = load(coded, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = held_codec(name, pieces)
        for batch in slices(batches):
            texts = [codec.decode(np.asarray(row.values.to_numpy()) if row.is_valid else np.zeros(0, np.int32)) for row in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return coded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, ids array<int>, text string")

