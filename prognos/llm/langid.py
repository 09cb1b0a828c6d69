"""Language identification by cross-parsing entropy.

A suffix automaton of each language's labelled text yields the longest prefix of the rest of a document that occurs in
that text. Cutting a document into such longest phrases, the language whose text needs the fewest phrases, each counted
with log2 of the training length and divided by the document's length, wins.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prognos.llm.common import hash01, prepare, slices, utf8

#: Bound of the labelled sample: documents drawn for each language, bytes of normalised text that their whole texts fill, and
#: bytes of the longest one taken.
TRAIN_DOCS, TRAIN_BYTES, LONGEST = 160, 49_152, 6_144
#: Bytes after which a second parse begins, so that long texts are parsed in parallel; where the first one comes to the same
#: state, the rest of both is one, and where it does not, it goes on. The phrases are those of one parse of the whole text.
BLOCK = 1024
UND = "und"


def normalised(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of lower-cased texts -> ASCII other than letters becomes one space (32), none at the start of a text."""
    letter = np.zeros(256, bool)
    letter[97:123] = letter[128:] = True
    out = np.where(letter[data], data, 32).astype(np.uint8)
    first = np.zeros(len(out) + 1, bool)
    first[at[:-1]] = True
    blank = out == 32
    before = np.empty(len(out), bool)
    if len(out):
        before[0], before[1:] = True, blank[:-1]
    keep = ~(blank & (before | first[:-1]))
    return out[keep], np.concatenate([[0], np.cumsum(keep)])[at]


def suffix_automaton(text: np.ndarray, width: int) -> np.ndarray:
    """Transitions (state, symbol) -> state of the automaton of all substrings, -1 where there is none; state 0 is the start."""
    blank = array("i", [-1]) * width
    nxt, link, length, last = blank[:], array("i", [-1]), array("i", [0]), 0
    for c in text.tolist():
        cur = len(link)
        nxt += blank
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and nxt[p * width + c] < 0:
            nxt[p * width + c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p * width + c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(link)
                nxt += nxt[q * width : (q + 1) * width]
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and nxt[p * width + c] == q:
                    nxt[p * width + c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return np.frombuffer(nxt, np.int32).reshape(-1, width)


def placed(state: np.ndarray, symbol: np.ndarray, n: int, width: int) -> tuple[np.ndarray, int]:
    """(base of each of n states, slots): bases by which no two transitions (state, symbol) have one slot base + symbol, all bases differ.

    States with many transitions go first. All waiting states try a place at once; those whose slots are free and claimed by no other
    stay, the others try again. There are 1.5 slots for a transition, so a try succeeds often enough at any size.
    """
    order = np.argsort(state, kind="stable")
    state, symbol = state[order], symbol[order]
    degree = np.bincount(state, minlength=n)
    room = max(16, 3 * max(len(state), n) // 2)
    free, unused, base = np.ones(room + width, bool), np.ones(room, bool), np.full(n, -1, np.int64)
    claim, claimed = np.empty(room + width, np.int64), np.empty(room, np.int64)
    random = np.random.RandomState(7)
    for least in (16, 4, 2, 0):
        waiting = np.flatnonzero((degree >= least) & (base < 0))
        while len(waiting):
            trial = np.full(n, -1, np.int64)
            trial[waiting] = random.randint(0, room, len(waiting))
            mine = trial[state] >= 0
            who, slot = state[mine], trial[state[mine]] + symbol[mine]
            claim[slot], claimed[trial[waiting]] = who, waiting
            bad = np.zeros(n, bool)
            bad[who[~free[slot] | (claim[slot] != who)]] = True
            bad[waiting[~unused[trial[waiting]] | (claimed[trial[waiting]] != waiting)]] = True
            good = waiting[~bad[waiting]]
            base[good] = trial[good]
            free[slot[~bad[who]]], unused[base[good]] = False, False
            waiting = waiting[bad[waiting]]
    return base, room + width


class CrossParser:
    """All languages' automata as one sparse table, a state being the base of its slots.

    Slot state + symbol holds the state that it belongs to in its upper half, and 4 * (next state) + phrases ended by this step in its
    lower half. Where it belongs to another state there is no such transition: `back` tells what the language's first state does, and
    that one phrase ended, or two where the symbol isn't in the language. An automaton has at most three transitions for a byte of its
    text, so a language takes at most 36 bytes for a byte of text (about 27 in use), whatever alphabets it and the others have.
    """

    def __init__(self, langs: list[str], texts: list[bytes]) -> None:
        self.langs, self.sizes = langs, np.array([max(2, len(t)) for t in texts], float)
        used = sorted({32, *(c for t in texts for c in set(t))})
        self.width = width = len(used) + 1
        self.cls = np.full(256, len(used), np.int64)
        self.cls[used] = np.arange(len(used))
        parts, backs, roots, begin = [], [], [], 0
        for t in texts:
            own = np.unique(np.frombuffer(t, np.uint8))
            narrow = np.zeros(256, np.int64)
            narrow[own] = np.arange(len(own))
            to = suffix_automaton(narrow[np.frombuffer(t, np.uint8)], max(1, len(own)))
            state, symbol = np.nonzero(to >= 0)
            target, symbol = to[state, symbol].astype(np.int64), self.cls[own][symbol]
            # the first state has a slot for every symbol, so that what it hasn't got ends one phrase there
            first = np.zeros(width, np.int64)
            known = np.zeros(width, bool)
            first[symbol[state == 0]], known[symbol[state == 0]] = target[state == 0], True
            lost = np.flatnonzero(~known)
            state, symbol = np.concatenate([state, np.zeros(len(lost), np.int64)]), np.concatenate([symbol, lost])
            target, ended = np.concatenate([target, np.zeros(len(lost), np.int64)]), np.repeat([0, 1], [len(target), len(lost)])
            base, room = placed(state, symbol, len(to), width)
            base += begin
            slots = np.full(room, -1, np.int64)
            slots[base[state] + symbol - begin] = base[state] << 32 | base[target] << 2 | ended
            parts.append(slots)
            backs.append(base[first] << 2 | np.where(known, 1, 2))
            roots.append(base[0])
            begin += room
        self.slots, self.back, self.roots = np.concatenate(parts), np.concatenate(backs), np.array(roots, np.int64)

    def _step(self, state: np.ndarray, symbol: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next states, phrases ended); `back` is the entry of each where the state has no such transition."""
        v = self.slots.take(state + symbol)
        v = np.where(v >> 32 == state, v & 0xFFFFFFFF, back)
        return v >> 2, v & 3

    def _parse(self, cls: np.ndarray, begin: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrases ended, state at the end) of a parse of each block from its first byte (languages x blocks)."""
        order = np.argsort(-long, kind="stable")
        state = np.repeat(self.roots[:, None], len(long), axis=1)
        count = np.zeros(state.shape, np.int32)
        first, most = begin[order], int(long.max()) if len(long) else 0
        back = self.back.reshape(len(self.langs), -1)
        active = np.searchsorted(-long[order], -np.arange(1, most + 1), side="right")
        for t, k in enumerate(active.tolist()):
            c = cls[first[:k] + t]
            state[:, :k], ended = self._step(state[:, :k], c, back.take(c, axis=1))
            count[:, :k] += ended
        order = np.argsort(order)
        return count[:, order], state[:, order]

    def _go_on(self, cls: np.ndarray, at: np.ndarray, end: np.ndarray, lang: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Parses that come into a block in the state `entry`, beside those that begin there, until both are in one state or at its end.

        Returns (phrases that the first ends more than the second, its state then, whether both are one).
        """
        more, state, same = np.zeros(len(at), np.int32), entry.copy(), np.zeros(len(at), bool)
        live, mine, other, at = np.arange(len(at)), entry, self.roots[lang], at.copy()
        while len(live):
            c = cls[at[live]]
            back = self.back.take(lang[live] * self.width + c)
            (mine, a), (other, b) = self._step(mine, c, back), self._step(other, c, back)
            more[live] += (a - b).astype(np.int32)
            at[live] += 1
            one = mine == other
            going = ~one & (at[live] < end[live])
            state[live], same[live] = mine, one
            live, mine, other = live[going], mine[going], other[going]
        return more, state, same

    def phrases(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Phrases of each whole text in each language (languages x texts)."""
        n_docs, n_langs = len(at) - 1, len(self.langs)
        size = np.diff(at)
        blocks = -(-size // BLOCK)
        doc = np.repeat(np.arange(n_docs), blocks)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin = at[:-1][doc] + nth * BLOCK
        end = np.minimum(begin + BLOCK, at[1:][doc])
        cls = self.cls[data]
        count, alone = self._parse(cls, begin, end - begin)
        state, more = alone.copy(), np.zeros(count.shape, np.int32)
        # what comes into a block from the one before it, until no block's last state changes any more
        lang, block = (x.ravel() for x in np.meshgrid(np.arange(n_langs), np.flatnonzero(nth > 0), indexing="ij"))
        while len(block):
            more[lang, block], got, same = self._go_on(cls, begin[block], end[block], lang, state[lang, block - 1])
            got = np.where(same, alone[lang, block], got)
            changed = got != state[lang, block]
            state[lang, block] = got
            lang, block = lang[changed], block[changed] + 1
            inside = block < len(doc)
            lang, block = lang[inside], block[inside]
            lang, block = lang[nth[block] > 0], block[nth[block] > 0]
        last = np.concatenate([doc[1:] != doc[:-1], [True]])[: len(doc)]
        count = count + more + (last & (state != self.roots[:, None]))
        return np.stack([np.bincount(doc, weights=c, minlength=n_docs) for c in count])

    def predict(self, data: np.ndarray, at: np.ndarray, lettered: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The language with the fewest normalised phrases (the first by name at a tie), and second / (best + second)."""
        data, at = normalised(data, at)
        cost = self.phrases(data, at) * np.log2(self.sizes)[:, None] / np.maximum(1, np.diff(at))[None, :]
        best = cost.argmin(axis=0)
        ranked = np.sort(cost, axis=0)
        second = ranked[min(1, len(ranked) - 1)]
        score = np.where(lettered, second / np.maximum(1e-12, ranked[0] + second), 0.0) if len(ranked) > 1 else lettered * 1.0
        return [self.langs[b] if ok else UND for b, ok in zip(best, lettered, strict=True)], score


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", train_docs: int = TRAIN_DOCS, train_bytes: int = TRAIN_BYTES, longest: int = LONGEST) -> list[tuple[str, bytes]]:
    """(language, training text) from a bounded sample of labelled rows, drawn by a hash of the key.

    About 3 * train_docs rows of each language, none longer than `longest` bytes, are read in the order of the hash; those
    whose whole text still fits into train_bytes make up its training text. A language all of whose texts are longer learns
    from the shortest ones, as they are. The driver gets no more than that for each language. Rows without text or label,
    and empty texts, don't count.
    """
    rows = prepare(labelled.sparkSession) and labelled.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).where("t <> '' and l is not null")
    rows = rows.withColumn("b", F.octet_length("t"))
    short = {r.l: (r.n, r.least) for r in rows.groupBy("l").agg(F.count_if(F.col("b") <= longest).alias("n"), F.min("b").alias("least")).collect()}
    if not short:
        return []
    # of a language without a short text, those of its least length
    of = lambda i: F.create_map(*[F.lit(x) for k, v in short.items() for x in (k, (max(longest, v[1]), min(1.0, 3 * train_docs / v[0]) if v[0] else 1.0)[i])])[F.col("l")]
    sample = rows.where((F.col("b") <= of(0)) & (hash01("k") < of(1)))

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(h=pd.util.hash_array(pdf.k.astype(str).to_numpy(object))).sort_values(["h", "k", "t"])
        data, at = normalised(*utf8(pc.utf8_lower(pa.array(pdf.t.tolist(), pa.large_string()))))
        chosen, left = [], train_bytes
        for n, a, b in zip(np.diff(at).tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
            if n <= left or not chosen:
                chosen.append(data[a:b].tobytes())
                left -= n
        return pd.DataFrame({"l": [pdf.l.iloc[0]], "training": [b"".join(chosen)]})

    got = sample.select("k", "t", "l").groupBy("l").applyInPandas(join, "l string, training binary").collect()
    return sorted((r.l, bytes(r.training)) for r in got)


Predict = Callable[[pa.Array], tuple[list[str], np.ndarray]]


def predictor(docs: DataFrame, model: list[tuple[str, bytes]]) -> Predict:
    """The function, for tasks, from a batch of texts to their (languages, scores).

    The automata are built once, on the driver, and broadcast: at most 36 * train_bytes bytes for each language (CrossParser).
    """
    parser = CrossParser([k for k, _ in model], [v for _, v in model]) if model else None
    shared = prepare(docs.sparkSession).sparkContext.broadcast(parser)

    def predict(texts: pa.Array) -> tuple[list[str], np.ndarray]:
        if shared.value is None:
            return [UND] * len(texts), np.zeros(len(texts))
        lettered = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        return shared.value.predict(*utf8(pc.utf8_lower(texts)), lettered)

    return predict


def identify(docs: DataFrame, model: list[tuple[str, bytes]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) of every row; only the text is looked at, the whole of it.

    Null or empty texts and texts without a letter get `und` and score 0; so does every text if nothing was learned. At a tie
    the first language by name is taken. Repeated rows are each answered.
    """
    rows = docs.select(F.col(key).alias(key), F.col(text).alias("t"))
    kind, predict = docs.schema[key].dataType.simpleString(), predictor(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                lang, score = predict(part.column("t"))
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(lang, pa.string()), pa.array(score, pa.float64())], [key, "lang_pred", "score"])

    return rows.mapInArrow(run, f"`{key}` {kind}, lang_pred string, score double")


def identified(docs: DataFrame, model: list[tuple[str, bytes]], text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows whose text's language is found, as they were but that `lang` is the language found.

    Rows that `identify` answers with `und` go; if nothing was learned, all rows stay as they are.
    """
    if not model:
        return docs
    predict = predictor(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(lang)
            for part in slices(batch, text):
                found, _ = predict(part.column(text))
                part = part.set_column(at, part.schema.field(at), pa.array(found, part.schema.field(at).type))
                yield part.filter(pa.array([x != UND for x in found]))

    return docs.mapInArrow(run, docs.schema)


def held_out(key: str = "doc_id") -> Column:
    """Whether a row is kept from learning: crc32 of the key as text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
