"""Packing documents into training sequences along a space-filling curve.

Each document's hashed token vector is projected to a few dimensions; documents
are range-sorted by the Hilbert key of that point, so that neighbours on the
curve share sequences.  Within a range, token runs are laid end to end and cut
at the sequence length; what is left at a range's end is cut into powers of
two, so there is no padding at all.
"""

from __future__ import annotations

import base64
import re
import zlib
from functools import lru_cache
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.common import quantile_splits, range_bucket, table, trimmed, unit_hash

LENGTH = 1024
DIMS, BITS = 4, 7
#: Keys that place the border of a range, about, as a range sort's own sampling does; every document is packed.
#: A document is drawn as often as its share of all characters says, so ranges are even in text, not in rows.
BORDER_SAMPLE = 20
#: Characters of one range, about; tasks stream a range, so a larger one costs time and no memory.
RANGE_CHARS = 4_000_000
MOST_RANGES = 65_536

#: The faster encoder's matcher has no stack for blanks in such a run; the tokenizers library reads texts with one.
_LONG_RUN = 100_000
_RUN = re.compile(rf"\s{{{_LONG_RUN}}}")


@lru_cache(2)
def _encoder(path: str):
    """A byte-level BPE with the vocabulary at ``path`` (a tokenizers JSON file) and its added tokens.

    The ranks come from the same file; ``tests/llm`` holds the ids against the
    tokenizers library's own.  As there by default, an added token's string in a
    text is that token's id, and the text is cut before and after it.
    """
    import json

    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, added = file["model"], {t["content"]: t for t in file["added_tokens"]}
    if any(t[k] for t in added.values() for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("an added token with conditions on its surroundings")
    known = {c: np.array([t["id"]], "<u4").tobytes() for c, t in added.items()}
    pattern = re.compile("(" + "|".join(map(re.escape, sorted(known, key=len, reverse=True))) + ")") if known else None
    ranks = {bytes(_byte_of(c) for c in piece): i for piece, i in model["vocab"].items() if all(c in _BYTES for c in piece) and i < len(model["merges"]) + 256}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), known, pattern


def _byte_map() -> dict[str, int]:
    """Characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the rest from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


_BYTES = _byte_map()


def _byte_of(c: str) -> int:
    return _BYTES[c]


@lru_cache(2)
def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def encode(text: str, path: str) -> np.ndarray:
    """Ids of a whole text as unsigned 32-bit numbers; no token is added at its ends."""
    if len(text) > _LONG_RUN and _RUN.search(text):
        return np.array(_library(path).encode(text, add_special_tokens=False).ids, "<u4")
    encoder, known, pattern = _encoder(path)
    if any(c in text for c in known):
        parts = pattern.split(text)
        return np.frombuffer(b"".join(known[p] if k % 2 else np.array(encoder.encode_ordinary(p), "<u4").tobytes() for k, p in enumerate(parts)), "<u4")
    return np.array(encoder.encode_ordinary(text), "<u4")


@lru_cache(1)
def _projection() -> np.ndarray:
    return np.random.default_rng(17).standard_normal((256, DIMS))


def point(ids: np.ndarray) -> np.ndarray:
    """Cell of the document's hashed token vector: DIMS coordinates of BITS bits."""
    counts = np.bincount((ids * np.uint32(2654435761)) >> np.uint32(24), minlength=256).astype(float)
    norm = np.sqrt((counts * counts).sum())
    at = counts @ _projection() / norm if norm else np.zeros(DIMS)
    return np.clip(((np.tanh(at / 2) + 1) / 2 * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Distance along the Hilbert curve of each row of coordinates (Skilling's transform, vectorised)."""
    x = points.astype(np.int64).copy()
    n = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            up = (x[:, i] & q) > 0
            swap = np.where(up, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] ^= np.where(up, p, swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[:, n - 1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


def _tokens(path: str, with_ids: bool):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = [encode(t.as_py() or "", path) for t in part.column("text")]
                keys = hilbert(np.array([point(i) for i in ids]).reshape(-1, DIMS))
                spread = np.array(part.column("spread").to_pylist(), np.int64)
                keys = (keys << np.int64(63 - DIMS * BITS)) | (spread & np.int64((1 << (63 - DIMS * BITS)) - 1))
                if with_ids:
                    # Ids of this vocabulary fit 16 bits; wider ones stay as they are.
                    narrow = [i.astype("<u2").tobytes() if not len(i) or i.max() < 65536 else b"\0" + i.tobytes() for i in ids]
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(keys), pa.array(narrow, pa.binary())], ["doc_id", "key", "ids"])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(keys), part.column("drawn")], ["key", "drawn"])

    return run


def _widen(data: bytes) -> np.ndarray:
    return np.frombuffer(data[1:], "<u4") if len(data) % 2 else np.frombuffer(data, "<u2").astype("<u4")


def _packer(length: int):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def pieces(batches):
        """Rows of one task come sorted by range and key; a range's sequences number from range * 2**32."""
        out, current, sequence, open_ = [], None, 0, []  # open_: (doc, start, ids, doc tokens) of the sequence being filled
        used = 0

        def put(doc, start, ids, total, offset):
            out.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, sequence, offset))

        def flush():
            nonlocal sequence, open_, used
            offset = 0
            for doc, start, ids, total in open_:
                put(doc, start, ids, total, offset)
                offset += len(ids)
            sequence, open_, used = sequence + 1, [], 0

        def finish():
            """Cut what is left into sequences whose lengths are powers of two."""
            nonlocal open_, used
            left, rest = used, open_
            while left:
                size = 1 << (left.bit_length() - 1)
                open_, used, later = [], 0, []
                for doc, start, ids, total in rest:
                    take = min(len(ids), size - used)
                    if take:
                        open_.append((doc, start, ids[:take], total))
                        used += take
                    if take < len(ids):
                        later.append((doc, start + take, ids[take:], total))
                rest, left = later, left - size
                flush()

        def rows():
            nonlocal out
            columns = list(zip(*out, strict=True)) if out else [[]] * 7
            out = []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        for batch in batches:
            for bucket, doc, data in zip(batch.column("range").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                if bucket != current:
                    if current is not None:
                        finish()
                    current, sequence = bucket, bucket << 32
                ids = np.append(_widen(data.as_py()), np.uint32(0)).astype("<u4")
                start, total = 0, len(ids)
                while start < total:
                    take = min(total - start, length - used)
                    open_.append((doc, start, ids[start : start + take], total))
                    start, used = start + take, used + take
                    if used == length:
                        flush()
                if len(out) >= 8192:
                    yield rows()
        if current is not None:
            finish()
        yield rows()

    return pieces


def pack(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """Pieces ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` (columns ``doc_id, text``).

    Every document is its ids and then id 0, so an empty or null text is one
    token; every id lies in exactly one piece.  Sequences hold ``length``
    tokens, or a smaller power of two at a range's end.  Copies have equal keys
    up to a hash of their doc_id, which spreads a hot group over ranges.
    Repeated rows are packed one by one, texts of any length whole; a null doc_id
    stays null; other columns are not read; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("spread", F.xxhash64("doc_id", F.lit("spread")))
    total = rows.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    ranges = min(MOST_RANGES, ceil(total / RANGE_CHARS))
    drawn = F.floor((F.length("text") + 1) * (BORDER_SAMPLE * ranges / max(1, total)) + unit_hash("doc_id", F.lit("borders"))).cast("int")
    sample = rows.withColumn("drawn", drawn).where("drawn > 0")
    keys = sample.mapInArrow(trimmed(_tokens(path, False)), "key bigint, drawn int").select("key", F.explode(F.sequence(F.lit(1), "drawn")))
    splits = quantile_splits(keys, "key", ranges)
    keyed = rows.mapInArrow(trimmed(_tokens(path, True)), "doc_id bigint, key bigint, ids binary").withColumn("range", range_bucket(F.col("key"), splits).cast("bigint"))
    ordered = keyed.repartition(max(1, ranges), "range").sortWithinPartitions("range", "key", "doc_id")
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    return ordered.select("range", "doc_id", "ids").mapInArrow(trimmed(_packer(length)), schema)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    return pack(table(spark, sf_dir, "documents"), vocabulary())
