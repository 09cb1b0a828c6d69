"""Token counts of the sections of documents by offset-mapped attribution.

A whole document is encoded once. The tokens' spans are joined with the sections' spans as intervals, and a token that crosses
a boundary is allocated by an explicit rule, so the sections' counts always add up to the document's.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from public_tokenizers import PATTERN
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prognos.llm.common import prepare, slices, utf8

RULES = ("first", "last", "largest")


def encoding(path: str, pattern: str = PATTERN):  # noqa: ANN201
    """(encode a text to ids, bytes of every id) of a file of base64 pieces and ranks."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    size[list(ranks.values())] = [len(x) for x in ranks]
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, size


def allocate(begin: np.ndarray, end: np.ndarray, sections: np.ndarray, rule: str = "first") -> tuple[np.ndarray, np.ndarray]:
    """(section of each token, whether it crosses a boundary).

    sections: where each section begins, ascending, the first at 0. "first" and "last" take the section of a token's first or
    last place; "largest" the one that holds most of it, the earlier one at a tie.
    """
    a = np.searchsorted(sections, begin, side="right") - 1
    b = np.searchsorted(sections, np.maximum(end - 1, begin), side="right") - 1
    crossing = a != b
    if rule == "first":
        return a, crossing
    if rule == "last":
        return b, crossing
    got = a.copy()
    for i in np.flatnonzero(crossing):
        cuts = np.concatenate([[begin[i]], sections[a[i] + 1 : b[i] + 1], [end[i]]])
        got[i] = a[i] + int(np.diff(cuts).argmax())
    return got, crossing


def count_sections(docs: DataFrame, ranks: str, key: str = "doc_id", text: str = "text", rule: str = "first", pattern: str = PATTERN) -> DataFrame:
    """(key, section, start, end, n_tokens, n_crossing) of every line of every document.

    A section is a line with the line feed that ends it, its span in code points, the end exclusive. Null and empty texts
    have one empty section without tokens; repeated rows are each answered. n_crossing counts the section's tokens that reach
    into another one. A token that begins within a character's bytes counts as beginning with that character.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    prepare(docs.sparkSession)
    rows = docs.select(F.col(key).alias(key), F.coalesce(F.col(text), F.lit("")).alias("t"))
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, size = encoding(ranks, pattern)
        for batch in batches:
            for part in slices(batch, "t"):
                data, at = utf8(part.column("t"))
                place, section, start, end, tokens, crossed = [], [], [], [], [], []
                for i, text_ in enumerate(part.column("t").to_pylist()):
                    own = data[at[i] : at[i + 1]]
                    chars = np.cumsum((own & 0xC0) != 0x80)  # the code point, from 1, that each byte belongs to
                    n = int(chars[-1]) if len(own) else 0
                    heads = np.concatenate([[0], chars[np.flatnonzero(own == 10)]])
                    if len(heads) > 1 and heads[-1] == n:
                        heads = heads[:-1]
                    ends = np.cumsum(size[encode(text_)])
                    first = chars[np.concatenate([[0], ends[:-1]])] - 1 if len(ends) else ends
                    last = chars[ends - 1] if len(ends) else ends
                    got, crossing = allocate(first, last, heads, rule)
                    place.append(np.full(len(heads), i))
                    section.append(np.arange(len(heads)))
                    start.append(heads)
                    end.append(np.concatenate([heads[1:], [n]]))
                    tokens.append(np.bincount(got, minlength=len(heads)))
                    crossed.append(np.bincount(got, weights=crossing, minlength=len(heads)).astype(np.int64))
                keys = part.column(key).take(pa.array(np.concatenate(place)))
                yield pa.RecordBatch.from_arrays([keys, *[pa.array(np.concatenate(x), pa.int64()) for x in (section, start, end, tokens, crossed)]], [key, "section", "start", "end", "n_tokens", "n_crossing"])

    return rows.mapInArrow(run, f"`{key}` {kind}, section bigint, start bigint, end bigint, n_tokens bigint, n_crossing bigint")
