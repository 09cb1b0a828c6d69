"""Personal data: exact patterns as the base, and a skip-chain conditional random field that adds what they miss.

The field's variables are the tokens with a digit or an `@`. Neighbouring ones are linked (chain), and so are the occurrences of the
same core (letters and digits, in lower case), and of cores that differ in one place, wherever they are in the document (skip).
Unary, chain and skip potentials are learned together from the base's labels, with the beliefs of loopy message passing as the
expectations. The base's patterns run over neighbouring tokens and don't try again, so a number that stands behind another one is
lost to them; the field labels each token by its own shape, its neighbours and its repetitions. In every document the base's
spans are observed and all other variables are free.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prognos.llm.common import hash01, prepare, slices

KINDS = ["email", "ip", "card", "phone"]
LABELS = ["none", *KINDS]
#: Bound of the labelled sample that the field's weights are fitted on: documents, and characters of the longest one.
TRAIN_DOCS, LONGEST = 1500, 20_000
#: Message passing rounds, and the belief from which on a token outside the base is added.
ROUNDS, SURE = 8, 0.9
#: Kinds of links: neighbours, the same core, and cores of at least ALIKE characters that differ in one of them.
CHAIN, SAME, SIMILAR = range(3)
ALIKE = 8

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
# a match never begins inside a run of digits: what fails from the run's first digit fails from the others too
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")
_HINT = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"\S+")
_CORE = re.compile(r"[^0-9a-z]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As the leftmost non-overlapping matches of the pattern, but found from each @, in linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and _LOCAL.match(text[begin - 1]):
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            yield begin, m.end()
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind and start, in code points."""
    out = [(0, a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = _DIGITS.sub("", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.sub("", m[0])) <= 15]
    return out


def overrun(text: str) -> list[tuple[int, int]]:
    """Where a pattern ran over so many digits that it says nothing of what is in them."""
    return [m.span() for m in _CARD.finditer(text) if len(_DIGITS.sub("", m[0])) > 19] + [m.span() for m in _PHONE.finditer(text) if len(_DIGITS.sub("", m[0])) > 15]


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


_NUMBER = re.compile(r"[0-9]+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_GROUP = re.compile(r"\([0-9]+\)")
_DASHED = re.compile(r"[0-9]+(?:-[0-9]+)+")
_EDGE = re.compile(r"^[^0-9A-Za-z+(]+|[^0-9A-Za-z)]+$")
N_FEATURES = 19


def _octets(dotted: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in dotted.split("."))


def shape(token: str) -> list[float]:
    """What a token looks like by itself (the first 15 features)."""
    word = _EDGE.sub("", token)
    digits = _DIGITS.sub("", word)
    n, plain, dotted = len(digits), bool(_NUMBER.fullmatch(word)), _DOTTED.fullmatch(word)
    mail, letters = "@" in token, any(c.isalpha() for c in word)
    long = plain and 13 <= n <= 19
    return [1.0, bool(mail and _EMAIL.search(token)), bool(mail and not _EMAIL.search(token)), bool(dotted and _octets(word)), bool(dotted and not _octets(word)), long and luhn(digits), long and not luhn(digits), plain and 9 <= n <= 12, plain and 4 <= n <= 8, plain and n < 4, n > 19, word[:1] == "+", bool(_GROUP.fullmatch(word)), bool(_DASHED.fullmatch(word)), letters and not mail]


class Graph:
    """The variables and links of many documents: one batch is one graph whose documents aren't connected."""

    def __init__(self) -> None:
        self.doc: list[int] = []
        self.span: list[tuple[int, int]] = []
        self.x: list[list[float]] = []
        self.seen: list[int] = []
        self.edges: list[tuple[int, int, int]] = []

    def add(self, doc: int, text: str, base: list[tuple[int, int, int]]) -> None:
        labelled = sorted((a, b, k + 1) for k, a, b in base)
        last: dict[object, int] = {}
        before, i, shapes = -2, 0, []
        begin = len(self.doc)
        for pos, m in enumerate(_TOKEN.finditer(text)):
            a, b = m.span()
            if not _HINT.search(text, a, b):
                continue
            node = len(self.doc)
            while i < len(labelled) and labelled[i][1] <= a:
                i += 1
            hit = i < len(labelled) and labelled[i][0] < b
            self.doc.append(doc)
            self.span.append((a, b))
            shapes.append(shape(m[0]))
            self.seen.append(labelled[i][2] if hit else -1)
            if before == pos - 1:
                self.edges.append((node - 1, node, CHAIN))
            before = pos
            core = _CORE.sub("", m[0].lower())
            if len(core) >= 4:  # every occurrence with the one before it: as many links as occurrences
                if (core,) in last:
                    self.edges.append((last[core,], node, SAME))
                elif len(core) >= ALIKE:  # one different place leaves a half as it is
                    for key in ((core[: len(core) // 2], len(core), 0), (core[len(core) // 2 :], len(core), 1)):
                        if key in last and sum(x != y for x, y in zip(core, self._core(text, last[key]), strict=True)) == 1:
                            self.edges.append((last[key], node, SIMILAR))
                            break
                last[core,] = node
                if len(core) >= ALIKE:
                    last[core[: len(core) // 2], len(core), 0] = last[core[len(core) // 2 :], len(core), 1] = node
        # shapes of the neighbours, where there are any
        beside = {b: a for a, b, kind in self.edges if kind == CHAIN and a >= begin}
        after = {a: b for b, a in beside.items()}
        for node in range(begin, len(self.doc)):
            p = shapes[beside[node] - begin] if node in beside else [0.0] * 15
            q = shapes[after[node] - begin] if node in after else [0.0] * 15
            self.x.append([float(v) for v in (*shapes[node - begin], p[11], p[12], q[12], q[13])])

    def _core(self, text: str, node: int) -> str:
        a, b = self.span[node]
        return _CORE.sub("", text[a:b].lower())

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array(self.x, float).reshape(-1, N_FEATURES), np.array(self.seen, int), np.array(self.edges, int).reshape(-1, 3)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def marginals(theta: np.ndarray, edges: np.ndarray, pair: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Loopy sum-product: the beliefs in every label of every variable, and in every pair of labels of every link.

    theta: (variables, labels) log potentials; edges: (from, to, kind); pair: (kinds, labels, labels) log potentials.
    """
    labels = theta.shape[1]
    total = theta
    if not len(edges):
        return np.exp(total - _lse(total, 1)[:, None]), np.zeros((0, labels, labels))
    src, dst = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    psi = np.concatenate([pair[edges[:, 2]], pair[edges[:, 2]].transpose(0, 2, 1)])
    back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
    m = np.zeros((len(src), labels))
    order = np.argsort(dst, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], dst[order][1:] != dst[order][:-1]]))

    def summed() -> np.ndarray:
        out = theta.copy()
        out[dst[order][cuts]] += np.add.reduceat(m[order], cuts, axis=0)
        return out

    for _ in range(rounds):
        new = _lse((summed()[src] - m[back])[:, :, None] + psi, 1)
        m = 0.5 * m + 0.5 * (new - _lse(new, 1)[:, None])
    total = summed()
    n = len(edges)
    both = (total[src[:n]] - m[n:])[:, :, None] + psi[:n] + (total[dst[:n]] - m[:n])[:, None, :]
    both -= _lse(both.reshape(n, -1), 1)[:, None, None]
    return np.exp(total - _lse(total, 1)[:, None]), np.exp(both)


def fit_weights(texts: list[str], steps: int = 120) -> tuple[np.ndarray, np.ndarray]:
    """(unary, pair) weights of all potentials, by gradient steps on the likelihood of the base's labels.

    What the potentials expect comes from the loopy marginals. Tokens that look alike but fail the base's checks are its negatives;
    those in a match that ran on over too many digits are neither, so they teach nothing.
    """
    g, unsure = Graph(), []
    for i, t in enumerate(texts):
        if t and _HINT.search(t):
            g.add(i, t, base_spans(t))
            far = overrun(t)
            unsure += [any(a < y and b > x for x, y in far) for a, b in g.span[len(unsure) :]]
    x, seen, edges = g.arrays()
    unsure = np.array(unsure, bool) & (seen < 0)
    w, pair = np.zeros((N_FEATURES, len(LABELS))), np.zeros((3, len(LABELS), len(LABELS)))
    if not len(x):
        return w, pair
    y = np.maximum(seen, 0)
    goal = np.eye(len(LABELS))[y]
    held = np.zeros((len(edges), len(LABELS), len(LABELS)))
    held[np.arange(len(edges)), y[edges[:, 0]], y[edges[:, 1]]] = 1.0
    of = [(edges[:, 2] == kind) & ~unsure[edges[:, 0]] & ~unsure[edges[:, 1]] for kind in range(3)]
    sw, sp = np.full_like(w, 1e-8), np.full_like(pair, 1e-8)
    for _ in range(steps):
        node, link = marginals(x @ w, edges, pair, rounds=4)
        node[unsure] = goal[unsure]
        gw = x.T @ (node - goal) / len(x) + 1e-4 * w
        gp = np.stack([(link[k] - held[k]).sum(0) / max(1, int(k.sum())) if k.any() else np.zeros(pair.shape[1:]) for k in of]) + 1e-3 * pair
        gp[SAME:] = (gp[SAME:] + gp[SAME:].transpose(0, 2, 1)) / 2  # of two occurrences, neither is the first
        sw, sp = sw + gw**2, sp + gp**2
        w, pair = w - 0.6 * gw / np.sqrt(sw), pair - 0.3 * gp / np.sqrt(sp)
    return w, pair


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", rows: int = TRAIN_DOCS, longest: int = LONGEST) -> str:
    """The weights as JSON, from about `rows` documents of at most `longest` characters with a digit or `@`, drawn by a hash of the key."""
    some = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t").rlike("[0-9@]") & F.col("k").isNotNull() & (F.length("t") <= longest))
    share = rows / max(1, some.count())

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        w, pair = fit_weights(pdf.sort_values(["k", "t"]).t.tolist())
        return pd.DataFrame({"w": [json.dumps([w.tolist(), pair.tolist()])]})

    got = some.where(hash01("k") < share).groupBy().applyInPandas(train, "w string").collect()
    return got[0].w if got else json.dumps([np.zeros((N_FEATURES, len(LABELS))).tolist(), np.zeros((3, len(LABELS), len(LABELS))).tolist()])


def _passes(kind: int, word: str) -> bool:
    """The base's own check of a kind, on a whole span."""
    digits = _DIGITS.sub("", word)
    if kind == 0:
        return bool(_EMAIL.search(word))
    if kind == 1:
        return bool(_DOTTED.fullmatch(word)) and _octets(word)
    return 13 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 9 <= len(digits) <= 15


def added_spans(texts: list[str | None], base: list[list[tuple[int, int, int]]], unary: np.ndarray, pair: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Spans that the field adds to each text's base: runs of neighbouring tokens outside it whose belief in one kind is SURE.

    A run must pass its kind's check as a whole, unless one of its tokens repeats an observed entity of the kind.
    """
    g = Graph()
    for i, (t, b) in enumerate(zip(texts, base, strict=True)):
        if t and _HINT.search(t):
            g.add(i, t, b)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not g.doc:
        return out
    x, seen, edges = g.arrays()
    theta = x @ unary
    known = np.flatnonzero(seen >= 0)
    theta[known] = -1e3
    theta[known, seen[known]] = 0.0
    belief, _ = marginals(theta, edges, pair)
    kind = np.where((seen < 0) & (belief.max(1) >= SURE), belief.argmax(1), 0)
    chain = {int(b): int(a) for a, b, k in edges if k == CHAIN}
    tied = {int(n) for a, b, k in edges if k != CHAIN for n, o in ((a, b), (b, a)) if seen[o] == kind[n]}
    runs: list[list[int]] = []
    for n in np.flatnonzero(kind).tolist():
        # a card or phone number in several tokens
        if runs and runs[-1][-1] == chain.get(n) and kind[n] in (3, 4) and kind[runs[-1][-1]] == kind[n] and len(_DIGITS.sub("", texts[g.doc[n]][g.span[runs[-1][0]][0] : g.span[n][1]])) <= (19 if kind[n] == 3 else 15):
            runs[-1].append(n)
        else:
            runs.append([n])
    for run in runs:
        doc, k = g.doc[run[0]], int(kind[run[0]]) - 1
        a, b = g.span[run[0]][0], g.span[run[-1]][1]
        word = texts[doc][a:b]
        if k == 0 and (m := _EMAIL.search(word)):
            a, b = a + m.start(), a + m.end()
        else:
            edge = re.search(r"[+(]*[0-9A-Za-z](?:.*[0-9A-Za-z])?", word, re.S)
            a, b = a + edge.start(), a + edge.end()
        if _passes(k, texts[doc][a:b]) or any(n in tied for n in run):
            out[doc].append((k, a, b))
    return out


def _spans(texts: list[str | None], unary: np.ndarray, pair: np.ndarray) -> tuple[list[list[tuple[int, int, int]]], list[list[tuple[int, int, int]]]]:
    """(base, all) spans of each text, each by kind and start."""
    base = [base_spans(t) if t and _HINT.search(t) else [] for t in texts]
    more = added_spans(texts, base, unary, pair)
    return base, [sorted({*b, *m}) for b, m in zip(base, more, strict=True)]


def find(docs: DataFrame, weights: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, base, spans, n_added) of every row: counts and spans of the base, and all spans.

    `base` and `spans` are kind:start:end by kind and start, comma-joined, in code points, the end exclusive; n_added counts what only
    the field found. Null and empty texts have none; repeated rows are each answered, keys of any type as they are. No row leaves
    its task.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    rows = docs.select(F.col(key).alias(key), F.col(text).alias("t"))
    kind = rows.schema[key].dataType.simpleString()
    names = [key, *[f"n_{k}" for k in KINDS], "base", "spans", "n_added"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unary, pair = (np.array(v) for v in json.loads(shared.value))
        for batch in batches:
            for part in slices(batch, "t"):
                base, spans = _spans(part.column("t").to_pylist(), unary, pair)
                counts = [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in range(len(KINDS))]
                added = pa.array([len(s) - len(b) for b, s in zip(base, spans, strict=True)], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(key), *counts, *[pa.array([written(x) for x in y], pa.string()) for y in (base, spans)], added], names)

    return rows.mapInArrow(run, f"`{key}` {kind}, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base string, spans string, n_added bigint")


def masked(docs: DataFrame, weights: str, text: str = "text") -> DataFrame:
    """The rows with every span of personal data replaced by its kind in brackets, as in [EMAIL]; other columns stay.

    Overlapping spans become one, of the kind of the first. Null texts stay null.
    """
    shared = prepare(docs.sparkSession).sparkContext.broadcast(weights)

    def hide(t: str, spans: list[tuple[int, int, int]]) -> str:
        out, done = [], 0
        for a, b, k in sorted((a, b, k) for k, a, b in spans):
            if a >= done:
                out += (t[done:a], f"[{KINDS[k].upper()}]")
            done = max(done, b)
        return "".join(out) + t[done:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unary, pair = (np.array(v) for v in json.loads(shared.value))
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for part in slices(batch, text):
                given = part.column(at).to_pylist()
                _, spans = _spans(given, unary, pair)
                new = [hide(t, s) if s else t for t, s in zip(given, spans, strict=True)]
                yield part.set_column(at, part.schema.field(at), pa.array(new, part.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
