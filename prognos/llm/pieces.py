"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

At each position the automaton's output links give all pieces that end there; each relaxes the best score of a segmentation up
to that position. Where no piece of one character ends, the character's UTF-8 byte pieces step in at a lower score than any
piece has. Text is cut first between any two bytes that no piece holds side by side, so that equal parts are segmented once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prognos.llm.common import prepare, slices, utf8
from prognos.llm.tokens import PartCache, distinct, gathered

MARK = "▁"  # stands for a space


class PieceModel:
    """Pieces and scores of a SentencePiece model file, with the automaton over them.

    A model of the merging kind scores its pieces with minus their rank, which sums to nothing sensible: splitting a word into
    frequent letters would always win. With `scores` "zipf", where the scores are ranks, the score is the log of Zipf's
    probability of the rank, 1 / (rank + 2) over the sum of all; with "model" the scores are the model's own. Runs of marks get
    the score of a frequent piece, so that a run of spaces is one piece.
    """

    def __init__(self, path: str, scores: str = "zipf") -> None:
        import ahocorasick
        import sentencepiece

        if scores not in ("zipf", "model"):
            raise ValueError("scores must be zipf or model")
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.bytes_of: list[bytes] = [b""] * n
        self.byte_id = [model.unk_id()] * 256
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        ranked = scores == "zipf" and all(model.get_score(i) == int(model.get_score(i)) for i in plain)
        total = sum(1 / (k + 2) for k in range(len(plain)))
        score_of = {i: -math.log((2 - model.get_score(i)) * total) if ranked else model.get_score(i) for i in plain}
        best = max(score_of.values())
        self.automaton = ahocorasick.Automaton()
        least = 0.0
        #: Whether a piece, or a single character, holds the second byte behind the first.
        self.inside = np.zeros((256, 256), bool)
        self.inside[:, 0x80:0xC0] = True
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif i in score_of:
                score = best if len(piece) > 1 and not piece.strip(MARK) else score_of[i]
                least = min(least, score)
                self.automaton.add_word(piece, (len(piece), i, score))
                raw = self.bytes_of[i] = piece.replace(MARK, " ").encode()
                self.inside[list(raw[:-1]), list(raw[1:])] = True
        self.automaton.make_automaton()
        self.fallback = least - 10.0
        self.wide: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def segment(self, part: str) -> list[int]:
        """Ids of the best segmentation of a part, in which spaces have become marks; of equal scores the longer last piece wins."""
        n, fallback = len(part), self.fallback
        score = [0.0] + [float("-inf")] * n
        size_of, id_of, single = [1] * (n + 1), [-1] * (n + 1), [False] * (n + 1)
        done = 0  # positions up to here have their best score
        for end, (size, i, s) in self.automaton.iter(part):
            while done < end:  # of a character that is no piece, its bytes
                done += 1
                if not single[done] and (total := score[done - 1] + fallback) > score[done]:
                    score[done], size_of[done], id_of[done] = total, 1, -1
            end += 1
            if size == 1:
                single[end] = True
            if (total := score[end - size] + s) > score[end]:
                score[end], size_of[end], id_of[end] = total, size, i
        while done < n:
            done += 1
            if not single[done] and (total := score[done - 1] + fallback) > score[done]:
                score[done], size_of[done], id_of[done] = total, 1, -1
        out, e = [], n
        while e:
            if id_of[e] < 0:
                out += [self.byte_id[x] for x in reversed(part[e - 1].encode())]
            else:
                out.append(id_of[e])
            e -= size_of[e]
        return out[::-1]

    def cut(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, where a part begins in them, place of each text in them); a space is put before each text as the model does."""
        full = at[:-1][at[1:] > at[:-1]]
        data = np.insert(data, full, np.uint8(32))
        at = at + np.concatenate([[0], np.cumsum(at[1:] > at[:-1])])
        begin = np.ones(len(data), bool)
        begin[1:] = ~self.inside[data[:-1], data[1:]]
        begin[at[:-1][at[1:] > at[:-1]]] = True
        return data, begin, at

    def encode_parts(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = [self.segment(p.decode().replace(" ", MARK)) for p in parts]
        return np.array([i for x in ids for i in x], np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))

    def decodes_to(self, flat: np.ndarray, ends: np.ndarray, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether the ids of each text decode to its bytes, the space before it included."""
        if self.wide is None:
            size = np.fromiter(map(len, self.bytes_of), np.int64, len(self.bytes_of))
            self.wide = np.frombuffer(b"".join(self.bytes_of), np.uint8), np.cumsum(size) - size, size
        raw, begin, size = self.wide
        back = gathered(raw, begin[flat], size[flat])
        place = np.concatenate([[0], np.cumsum(size[flat])])[ends]
        same = np.diff(place) == np.diff(at)
        if same.all():
            wrong = np.flatnonzero(back != data)
            same[np.searchsorted(at, wrong, side="right") - 1] = False
            return same
        for i in np.flatnonzero(same):
            same[i] = (back[place[i] : place[i + 1]] == data[at[i] : at[i + 1]]).all()
        return same

    def decode(self, ids: list[int]) -> str:
        """The text of ids, without the space that encoding puts before it; bytes that are no UTF-8 become U+FFFD."""
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        return raw[raw[:1] == b" " :].decode(errors="replace")


@lru_cache(maxsize=1)
def loaded(path: str, scores: str) -> tuple[PieceModel, PartCache]:
    """One model and cache for all tasks of a Python worker."""
    model = PieceModel(path, scores)
    return model, PartCache(model.encode_parts, most=150_000)


def encode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", scores: str = "zipf") -> DataFrame:
    """(key, ids, same) of every row: the ids of the whole text, and whether they decode to it.

    Null and empty texts have no ids and decode to an empty text; repeated rows are each answered. A text comes back as it was
    unless it holds the mark character U+2581 itself, which comes back as a space.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(key).alias(key), F.coalesce(F.col(text), F.lit("")).alias("t"))
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, cache = loaded(model, scores)
        for batch in batches:
            for part in slices(batch, "t"):
                data, begin, at = pieces.cut(*utf8(part.column("t")))
                flat, size = cache(*distinct(data, begin))
                ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(begin)])[at]]
                same = pieces.decodes_to(flat, ends, data, at)
                yield pa.RecordBatch.from_arrays([part.column(key), pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(flat.view(np.int32))), pa.array(same)], [key, "ids", "same"])

    return rows.mapInArrow(run, f"`{key}` {kind}, ids array<int>, same boolean")


def decode(rows: DataFrame, model: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) of rows of ids; null or empty ids give an empty text, and ids outside the model are passed over."""
    prepare(rows.sparkSession)
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, _ = loaded(model, "zipf")
        n = len(pieces.bytes_of)
        for batch in batches:
            texts = [pieces.decode([i for i in x or [] if i is not None and 0 <= i < n]) for x in batch.column("i").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(texts, pa.string())], [key, "text"])

    return rows.select(F.col(key).alias(key), F.col(ids).cast("array<int>").alias("i")).mapInArrow(run, f"`{key}` {kind}, text string")
