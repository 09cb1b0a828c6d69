"""Token ids in bit-plane files.

Documents in ascending key order are encoded into one stream of ids, cut into shards by ranges of the key. A shard is a run
of chunks of BLOCK ids (the last one shorter). A chunk's ids are transposed into planes, one of each bit (or byte) of the
ids, and every plane is compressed with zstandard. A table row is a chunk: its planes, and the chunk index, which says how
many ids it holds and which documents begin in it, where, and with how many ids. The index can be read without the planes.
Spark writes and reads the files, so any store will do, and a lost executor leaves no half-written shard.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prognos.llm.common import prepare, slices, stored, utf8
from prognos.llm.tokens import PartCache, distinct
from prognos.storage import scratch

#: Ids of a chunk.
BLOCK = 65_536
CHUNKS = "shard int, chunk int, n_ids int, mode string, bits int, planes array<binary>, carried {key}, first int, keys array<{key}>, sizes array<bigint>"


def to_planes(ids: np.ndarray, mode: str = "bit") -> tuple[int, list[bytes]]:
    """(bits of the largest id, compressed planes from the lowest bit or byte)."""
    bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    ids = ids.astype("<u4")
    if mode == "bit":
        planes = [np.packbits((ids >> np.uint32(b)).astype(np.uint8) & np.uint8(1), bitorder="little") for b in range(bits)]
    else:
        planes = ids.view(np.uint8).reshape(-1, 4)[:, : -(-bits // 8)].T
    pack = zstandard.ZstdCompressor(level=1)
    return bits, [pack.compress(np.ascontiguousarray(p).tobytes()) for p in planes]


def from_planes(n: int, bits: int, planes: list[bytes], mode: str = "bit") -> np.ndarray:
    """The ids of a chunk."""
    unpack = zstandard.ZstdDecompressor()
    rows = [np.frombuffer(unpack.decompress(bytes(p), max_output_size=n + 8), np.uint8) for p in planes]
    if mode == "bit":
        ids = np.zeros(n, np.uint32)
        for b, row in enumerate(rows):
            ids |= np.unpackbits(row, count=n, bitorder="little").astype(np.uint32) << np.uint32(b)
        return ids
    wide = np.zeros((n, 4), np.uint8)
    wide[:, : len(rows)] = np.stack(rows).T
    return wide.view("<u4").ravel()


#: Kinds of bytes. Letters are those of ASCII and of the two-byte characters from U+00C0 to U+027F but for the two signs
#: among them and U+0130, which becomes two characters in lower case; whatever else is outside ASCII, apostrophes and the signs that special tokens are made of may belong with what is beside them.
LETTER, DIGIT, SIGN, GLUE, BLANK = range(5)


def _kinds() -> np.ndarray:
    kind = np.full(256, GLUE, np.uint8)
    kind[[c for c in range(128) if chr(c).isprintable()]] = SIGN
    kind[[c for c in range(128) if chr(c).isalpha()]] = LETTER
    kind[48:58] = DIGIT
    kind[[32, *range(9, 14)]] = BLANK
    kind[[ord(c) for c in "'<|>"]] = GLUE
    return kind


_KIND = _kinds()


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes without ASCII white space, where a part begins in them, place of each text in them).

    Parts are runs of letters, single digits and runs of signs, which the vocabulary's own splitting keeps apart; anything it might
    merge with its neighbours keeps a whole run between white space together. ASCII letters of runs of letters are in lower case.
    """
    kind = _KIND[data]
    lead = np.flatnonzero((data[:-1] >= 0xC3) & (data[:-1] <= 0xC9))
    char = data[lead].astype(np.int64) << 8 | data[lead + 1]
    lead = lead[(char != 0xC397) & (char != 0xC3B7) & (char != 0xC4B0)]
    kind[lead] = kind[lead + 1] = LETTER
    inner = kind != BLANK
    first = np.zeros(len(data) + 1, bool)
    first[at] = True
    first[1:-1] |= ~inner[:-1]
    first = first[:-1] & inner
    # runs between white space that hold what may stick to its neighbours stay whole
    run = np.cumsum(first) - 1
    whole = np.zeros(int(run[-1]) + 1 if len(run) else 0, bool)
    whole[run[inner & (kind == GLUE)]] = True
    begin = first.copy()
    begin[1:] |= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    begin &= inner & (first | ~whole[np.maximum(run, 0)]) if len(whole) else inner
    low = np.where((data >= 65) & (data <= 90) & ~(whole[np.maximum(run, 0)] if len(whole) else False), data + 32, data).astype(np.uint8)
    return low[inner], begin[inner], np.concatenate([[0], np.cumsum(inner)])[at]


#: A part that the vocabulary's normaliser and splitting leave as it is: small letters, among them those of U+00DF to U+00FF, signs, a digit.
_AS_IT_IS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+|[^\x00- 0-9A-Za-z'<>|\x7f-\xff]+|[0-9]")


def _byte_letters() -> dict[int, str]:
    """Latin-1 code point -> the character that stands for this byte in a byte-level vocabulary (the published mapping)."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


def word_encoder(path: str):  # noqa: ANN201
    """Encodes parts without white space with the tokenizers library; the vocabulary drops white space, so texts are their parts' ids.

    Parts that no normalising or splitting can change go to the library's merges at once. The others are one text for the library,
    with a special token between them that tells where each ends; parts that might hold a special token are encoded by themselves.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    between = min(i for i, t in tokenizer.get_added_tokens_decoder().items() if t.special)
    mark, merges, letters = tokenizer.id_to_token(between), tokenizer.model, _byte_letters()

    def ids_of(text: str) -> list[int]:
        return tokenizer.encode(text, add_special_tokens=False).ids

    def encode(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        out: list[list[int]] = [[]] * len(parts)
        rest = []
        for i, p in enumerate(parts):
            if _AS_IT_IS.fullmatch(p):
                out[i] = [t.id for t in merges.tokenize(p.decode("latin-1").translate(letters))]
            elif b"<|" in p:
                out[i] = ids_of(p.decode())
            else:
                rest.append(i)
        if rest:
            ids = np.array(ids_of(mark.join(parts[i].decode() for i in rest)), np.int64)
            cut = np.flatnonzero(ids == between)
            for i, own in zip(rest, np.split(ids, cut), strict=True):
                out[i] = own[own != between].tolist()
        return np.array([t for ids in out for t in ids], np.uint32), np.fromiter(map(len, out), np.int64, len(out))

    return encode


@lru_cache(maxsize=1)
def word_cache(path: str) -> PartCache:
    """One cache for all tasks of a Python worker: parts met in one task needn't be encoded in the next."""
    return PartCache(word_encoder(path), most=200_000)


def encode_texts(cache: PartCache, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(flat ids, ids of each text)."""
    data, begin, at = words(data, at)
    flat, size = cache(*distinct(data, begin))
    ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(begin)])[at]]
    return flat, np.diff(ends)


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, key: str = "doc_id", text: str = "text", mode: str = "bit", block: int = BLOCK) -> None:
    """Encodes every whole text (null: empty), appends end_id to each, and writes the shards to `path`, which must not exist.

    Rows of one key follow one another in the order of their texts; null keys come first.
    """
    spark = prepare(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).repartitionByRange(n, "k").sortWithinPartitions("k", "t")
    schema = CHUNKS.format(key=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, chunk = TaskContext.get().partitionId(), 0
        cache = word_cache(vocabulary)
        waiting, held, starts, carried = [], 0, [], None  # ids not yet in a chunk; (key, position, size) of documents that begin in them
        names = [f.split()[0] for f in schema.split(", ")]

        def row(ids: np.ndarray, begun: list) -> pa.RecordBatch:
            bits, planes = to_planes(ids, mode)
            first = begun[0][1] if begun else len(ids)
            values = [shard, chunk, len(ids), mode, bits, planes, carried if first else None, first, [k for k, _, _ in begun], [s for _, _, s in begun]]
            return pa.RecordBatch.from_arrays([pa.array([v], type=t) for v, t in zip(values, types, strict=True)], names)

        types = None
        for batch in batches:
            if types is None:
                of = batch.column("k").type
                types = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.list_(pa.binary()), of, pa.int32(), pa.list_(of), pa.list_(pa.int64())]
            for part in slices(batch, "t"):
                flat, size = encode_texts(cache, *utf8(part.column("t")))
                ends = np.cumsum(size)
                ids = np.insert(flat, ends, np.uint32(end_id))
                size = size + 1
                begin = np.cumsum(size) - size + held
                starts += zip(part.column("k").to_pylist(), begin.tolist(), size.tolist(), strict=True)
                waiting.append(ids)
                held += len(ids)
                if held >= block:
                    ids, done = np.concatenate(waiting), 0
                    while held - done >= block:
                        begun = [(k, p - done, s) for k, p, s in starts if p < done + block]
                        yield row(ids[done : done + block], begun)
                        starts = starts[len(begun) :]
                        carried = begun[-1][0] if begun else carried
                        chunk, done = chunk + 1, done + block
                    starts = [(k, p - done, s) for k, p, s in starts]
                    waiting, held = [ids[done:]], held - done
        if held:
            yield row(np.concatenate(waiting), starts)

    rows.mapInArrow(run, schema).write.option("compression", "none").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(k, shard, offset, n_tokens, ids_crc32) of every document in the files, the ids decoded from their planes.

    A document that crosses chunks is put together from its parts; only such documents are shuffled.
    """
    chunks = prepare(spark).read.parquet(path)
    kind = chunks.schema["carried"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                ids = from_planes(r.n_ids, r.bits, list(r.planes), r.mode).astype("<u4")
                raw, at = ids.tobytes(), int(r.first)
                if at:
                    out.append((r.carried, r.shard, r.chunk, None, None, None, raw[: 4 * at]))
                for k, s in zip(r.keys, r.sizes, strict=True):
                    part = raw[4 * at : 4 * (at + s)]
                    whole = len(part) == 4 * s
                    out.append((k, r.shard, r.chunk, at, s, zlib.crc32(part) if whole else None, None if whole else part))
                    at += s
            cols = ["k", "shard", "chunk", "at", "n_tokens", "ids_crc32", "part"]
            yield pd.DataFrame(out, columns=cols).astype({"k": object if kind == "string" else "Int64", "at": "Int64", "n_tokens": "Int64", "ids_crc32": "Int64"})

    # written once: both the whole documents and the parts of the others come from it
    found = stored(chunks.mapInPandas(run, f"k {kind}, shard int, chunk int, at bigint, n_tokens bigint, ids_crc32 bigint, part binary"), "decoded")
    size = chunks.groupBy("shard").agg(F.max("n_ids").alias("block"))

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        """The parts of the documents of one key; a part with a size begins a document."""
        out, part, head = [], [], None
        for r in pdf.sort_values(["chunk", "at"], na_position="first").itertuples():
            if pd.notna(r.n_tokens):
                head, part = r, []
            part.append(r.part)
            if sum(map(len, part)) == 4 * head.n_tokens:
                out.append((head.k, head.shard, head.chunk, head.at, head.n_tokens, zlib.crc32(b"".join(part))))
        return pd.DataFrame(out, columns=["k", "shard", "chunk", "at", "n_tokens", "ids_crc32"])

    crossing = found.where("part is not null").groupBy("shard", "k").applyInPandas(join, f"k {kind}, shard int, chunk int, at bigint, n_tokens bigint, ids_crc32 bigint")
    docs = found.where("part is null").select(crossing.columns).unionByName(crossing)
    # one row for each shard
    return docs.join(F.broadcast(size), "shard").select("k", "shard", (F.col("chunk") * F.col("block") + F.col("at")).alias("offset"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, vocabulary: str, end_id: int = 2, key: str = "doc_id", text: str = "text", mode: str = "bit", path: str | None = None) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every row, from files written to `path` (a new place in the shared folder) and read back.

    start is the number of ids of all documents before it. An empty table gives no rows.
    """
    spark = docs.sparkSession
    path = path or scratch(spark, "ids")
    write(docs, path, vocabulary, end_id, key, text, mode)
    shards = spark.read.parquet(path).groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    # the running sum is over one row for each shard
    before = shards.select("shard", (F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).alias("before"))
    return read(spark, path).join(F.broadcast(before), "shard").select(F.col("k").alias(key), (F.col("before") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
