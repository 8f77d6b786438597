"""Operator 6: byte-level BPE encoding and decoding.

A text is split by the tokenizer's pattern; each match is merged by a rank queue. The queue holds, for each merge rank, a bucket of
positions in a linked list of parts. A bitmap in two levels marks the buckets that aren't empty, so that the next rank is found by a
find-first-set on each level, whatever the number of ranks. A merge leaves the entries of its neighbours in place; an entry whose pair has
changed since is recognised by its rank and skipped. A match of n bytes takes O(n) queue operations, so matches without any break, of
megabytes, don't take quadratic time. Matches of up to MEMO_CHARS characters are merged once and kept in a bounded memo of the worker.

Defined results: a null text counts as empty; an empty text has no ids and decodes to no bytes; repeated rows give equal rows; ids that
aren't in the vocabulary raise an error in decoding; columns besides those named are dropped.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable
from heapq import heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import each_slice, pick, small_batches, table, worker_state

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Matches up to this many characters are kept in a worker's memo. When it has so many of them, they become the old ones, from which those that come again are taken over.
MEMO_CHARS, MEMO_ENTRIES = 48, 200_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


#: Bits of a rank that a word of the lower bitmap stands for.
WORD = 8
_BIT = [1 << i for i in range(1 << WORD)]


class Encoder:
    """Encodes texts by ranks; one per worker.

    The rank queue: buckets holds positions by rank, each bucket a heap, so that the leftmost goes first; low has a bit for each rank with a
    bucket, in words of 256 bits, and top a bit for each word of low that isn't 0.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.longest = max(map(len, ranks), default=1)
        self.low = [0] * ((max(ranks.values(), default=0) >> WORD) + 1)
        self.buckets: dict[int, list[int]] = {}
        self.memo = _Memo(self)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one match."""
        ranks, n, longest = self.ranks, len(piece), self.longest
        rank_of = ranks.get
        if (whole := rank_of(piece)) is not None:
            return [whole]
        low, buckets, top = self.low, self.buckets, 0
        following, before, pair = list(range(1, n + 1)), list(range(-1, n - 1)), [-1] * n
        for i in range(n - 1):
            rank = rank_of(piece[i : i + 2])
            if rank is not None:
                pair[i] = rank
                if rank in buckets:
                    buckets[rank].append(i)  # positions rise, so this keeps the heap
                else:
                    buckets[rank] = [i]
                    word = rank >> WORD
                    low[word] |= _BIT[rank & 255]
                    top |= 1 << word
        while top:
            word = (top & -top).bit_length() - 1
            bits = low[word]
            rank = (word << WORD) + (bits & -bits).bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                del buckets[rank]
                low[word] = bits = bits & (bits - 1)
                if not bits:
                    top &= top - 1
            if pair[i] != rank:
                continue
            gone = following[i]
            after = following[i] = following[gone]
            pair[gone] = pair[i] = -1
            changed = ()
            if after < n:
                before[after] = i
                changed = ((i, following[after]),)
            left = before[i]
            if left >= 0:
                pair[left] = -1
                changed += ((left, after),)
            for at, end in changed:
                if end - at <= longest and (rank := rank_of(piece[at:end])) is not None:
                    pair[at] = rank
                    if rank in buckets:
                        heappush(buckets[rank], at)
                    else:
                        buckets[rank] = [at]
                        word = rank >> WORD
                        low[word] |= _BIT[rank & 255]
                        top |= 1 << word
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : following[i]]])
            i = following[i]
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of a text, as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.memo.__getitem__, self.find(text)))


_LITTLE = struct.Struct("<I").pack


class _Memo(dict):
    """Ids by match. Long matches aren't kept."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder, self.old = encoder, {}

    def __missing__(self, match: str) -> bytes:
        ids = self.old.get(match) or self._merged(match)
        if len(match) <= MEMO_CHARS:
            if len(self) >= MEMO_ENTRIES:
                self.old = dict(self)
                self.clear()
            self[match] = ids
        return ids

    def _merged(self, match: str) -> bytes:
        return np.asarray(self.encoder.merge(match.encode()), "<u4").tobytes() if len(match) > MEMO_CHARS else b"".join(map(_LITTLE, self.encoder.merge(match.encode())))


class Decoder:
    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = {rank: token for token, rank in ranks.items()}

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _shared(spark: SparkSession, vocabulary: str):
    """A name for the vocabulary's content, and its broadcast ranks."""
    with open(vocabulary, "rb") as file:
        tag = hashlib.sha1(file.read()).hexdigest()
    return tag, spark.sparkContext.broadcast(load_ranks(vocabulary))


def _others(part: pa.RecordBatch, keep: Iterable[str]) -> list[pa.Array]:
    return [part.column(k) for k in keep]


def encode(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, and the ids of each whole text as little-endian unsigned 32-bit integers. vocabulary: the path of a rank file, read on the
    driver; its tokens, of a fixed number, are broadcast."""
    spark = df.sparkSession
    tag, held = _shared(spark, vocabulary)
    df = pick(df, *keep, text)
    schema = f"{', '.join(f'`{k}` {df.schema[k].dataType.simpleString()}' for k in keep)}, `{ids}` binary"

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        encoder = worker_state(("encode", tag, pattern), lambda: Encoder(held.value, pattern))
        out = pa.array([encoder.encode(t or "") for t in part.column(text).to_pylist()], pa.binary())
        return pa.RecordBatch.from_arrays([*_others(part, keep), out], [*keep, ids])

    return small_batches(df).mapInArrow(each_slice(work, text), schema)


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", decoded: str = "decoded", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, the ids, and the bytes that they stand for."""
    tag, held = _shared(df.sparkSession, vocabulary)
    df = pick(df, *keep, ids)
    schema = f"{', '.join(f'`{k}` {df.schema[k].dataType.simpleString()}' for k in keep)}, `{ids}` binary, `{decoded}` binary"

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        decoder = worker_state(("decode", tag), lambda: Decoder(held.value))
        out = pa.array([decoder.decode(x or b"") for x in part.column(ids).to_pylist()], pa.binary())
        return pa.RecordBatch.from_arrays([*_others(part, keep), part.column(ids), out], [*keep, ids, decoded])

    return small_batches(df).mapInArrow(each_slice(work, ids), schema)


def round_trip(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """encode and decode in one pass: keep, the ids, and the bytes decoded from the ids."""
    tag, held = _shared(df.sparkSession, vocabulary)
    df = pick(df, *keep, text)
    schema = f"{', '.join(f'`{k}` {df.schema[k].dataType.simpleString()}' for k in keep)}, `{ids}` binary, `{decoded}` binary"

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        encoder, decoder = worker_state(("both", tag, pattern), lambda: (Encoder(held.value, pattern), Decoder(held.value)))
        found = [encoder.encode(t or "") for t in part.column(text).to_pylist()]
        out = [pa.array(found, pa.binary()), pa.array(map(decoder.decode, found), pa.binary())]
        return pa.RecordBatch.from_arrays([*_others(part, keep), *out], [*keep, ids, decoded])

    return small_batches(df).mapInArrow(each_slice(work, text), schema)


def digests(df: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Per document the number of ids and the digests of ids and decoded bytes."""
    both = round_trip(df, vocabulary, pattern)
    return both.select("doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the ids of each whole text, and their number."""
    ids = encode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, keep=("doc_id", "lang", "source"))
    return ids.withColumn("n_tokens", F.expr("octet_length(ids) div 4").cast("long"))
