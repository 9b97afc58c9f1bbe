"""Byte-level BPE over a global shuffle of distinct words.

Documents are dealt into buckets by a hash, compressed.  Each bucket lists its distinct pre-tokens, packed into slots by a
hash of the word; the slots are shuffled, so that every distinct word of the corpus is encoded in one place and once, and
its ids go back to the buckets that hold it.  There, pre-tokens are found again in reading order and their
ids put in place.  A very frequent word travels once per bucket, not once per use.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrywork.llm.frames import SLICE_BYTES, give_back, released, rows_of, slices, small_batches
from ferrywork.llm.textcodes import distinct_pretokens, gathered

BUCKET_BYTES, MOST_SLOTS = 8 << 20, 1 << 16


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


_codecs: dict[str, object] = {}


def codec(path: str):
    """The library's encoder for a rank file, once per worker process."""
    if path not in _codecs:
        import public_tokenizers
        import tiktoken

        _codecs[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})
    return _codecs[path]


def _texts(packed: pa.Table):
    """Texts of a bucket in slices: positions and strings."""
    unpack = zstandard.ZstdDecompressor()
    at, size, found = 0, 0, []
    for k, blob in enumerate(packed.column("packed")):
        text = unpack.decompress(blob.as_py()).decode() if blob.is_valid else ""
        found.append(text)
        size += len(text)
        if size >= SLICE_BYTES:
            yield at, found
            at, size, found = k + 1, 0, []
    if found:
        yield at, found


def _packed(parts: list[bytes]) -> bytes:
    """Byte strings in one compressed blob: their number, their lengths, themselves."""
    lengths = np.array([len(parts), *map(len, parts)], dtype="<u4").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(lengths + b"".join(parts))


def _unpacked(blob: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    count = int.from_bytes(raw[:4], "little")
    ends = (4 + 4 * count + np.cumsum(np.frombuffer(raw[4 : 4 + 4 * count], dtype="<u4"), dtype=np.int64)).tolist()
    return [raw[a:b] for a, b in zip([4 + 4 * count, *ends], ends)]


def encode(docs: DataFrame, ranks_path: str, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``doc_id, ids`` (little-endian unsigned 32-bit) for each row of ``docs``.

    A null or empty text has no ids.  Repeated rows are kept; a null ``doc_id`` stays null.  An empty table gives an
    empty result.  Other columns are not read.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // bucket_bytes))
    packed_schema = pa.schema([("bucket", pa.int64()), ("doc_id", pa.int64()), ("packed", pa.binary())])
    slots = min(buckets, MOST_SLOTS)
    word_schema = pa.schema([("bucket", pa.int64()), ("slot", pa.int32()), ("words", pa.binary())])
    ids_schema = pa.schema([*word_schema, ("ids", pa.binary())])
    result_schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def compress(batches):
        pack = zstandard.ZstdCompressor(level=3).compress
        for part in slices(batches):
            blobs = [pack(t.as_buffer()) if t.is_valid else None for t in part.column(2).cast(pa.binary())]
            yield rows_of(packed_schema, [part.column(0), part.column(1), blobs])

    def words(group: pa.Table) -> pa.Table:
        found: set[str] = set()
        for _, texts in _texts(group):
            found.update(distinct_pretokens(texts)[0])
        by_slot: dict[int, list[bytes]] = {}
        for word in sorted(w.encode() for w in found):
            by_slot.setdefault(zlib.crc32(word) % slots, []).append(word)
        blobs = [_packed(part) for part in by_slot.values()]
        del found
        give_back()
        return pa.Table.from_arrays([pa.repeat(group.column("bucket")[0], len(blobs)), pa.array(list(by_slot), pa.int32()), pa.array(blobs, pa.binary())], schema=word_schema)

    def encoded(batches):
        ids_of, slot, known = codec(ranks_path).encode_ordinary, None, {}
        for batch in batches:
            for row in range(batch.num_rows):
                now, blob = batch.column("slot")[row].as_py(), batch.column("words")[row].as_py()
                if now != slot:
                    slot, known = now, {}
                ids = []
                for word in _unpacked(blob):
                    if word not in known:
                        known[word] = np.array(ids_of(word.decode()), dtype="<u4").tobytes()
                    ids.append(known[word])
                yield rows_of(ids_schema, [batch.column("bucket").slice(row, 1), [slot], [blob], [_packed(ids)]])

    def reassemble(texts_of: pa.Table, words_of: pa.Table) -> pa.Table:
        place: dict[str, int] = {}
        blobs: list[bytes] = []
        for own, ids in zip(words_of.column("words"), words_of.column("ids")):
            for word in _unpacked(own.as_py()):
                place[word.decode()] = len(place)
            blobs += _unpacked(ids.as_py())
        lengths = np.fromiter(map(len, blobs), dtype=np.int64, count=len(blobs)) // 4
        flat = np.frombuffer(b"".join(blobs), dtype="<u4")
        del blobs
        starts = np.cumsum(lengths) - lengths
        found = []
        for _, texts in _texts(texts_of):
            own, number, first = distinct_pretokens(texts)
            rows = np.array([place[w] for w in own], dtype=np.int64)[number] if own else np.zeros(0, np.int64)
            count = lengths[rows]
            ids = gathered(flat, starts[rows], count)
            ends = np.concatenate(([0], np.cumsum(count)))[first]
            found += [ids[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]
        del place, flat
        give_back()
        return pa.Table.from_arrays([texts_of.column("doc_id").combine_chunks(), pa.array(found, pa.binary())], schema=result_schema)

    bucket = F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).alias("bucket")
    packed = docs.select(bucket, "doc_id", "text").mapInArrow(released(compress), "bucket long, doc_id long, packed binary")
    listed = packed.groupBy("bucket").applyInArrow(words, "bucket long, slot int, words binary")
    coded = listed.repartition("slot").sortWithinPartitions("slot").mapInArrow(released(encoded), "bucket long, slot int, words binary, ids binary")
    return packed.groupBy("bucket").cogroup(coded.groupBy("bucket")).applyInArrow(reassemble, "doc_id long, ids binary")


def decode(encoded: DataFrame, ranks_path: str, column: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded`` (binary): the bytes of its ids, by the token-byte table, which every task holds."""
    schema_ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema] + ["decoded binary"])

    def run(batches):
        ranks = read_ranks(ranks_path)
        size = max(ranks.values()) + 1
        lengths = np.zeros(size, dtype=np.int64)
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank], lengths[rank] = token, len(token)
        flat, starts = np.frombuffer(b"".join(tokens), dtype=np.uint8), np.cumsum(lengths) - lengths
        for part in slices(batches, column):
            found = []
            for blob in part.column(column):
                ids = np.frombuffer(blob.as_py() or b"", dtype="<u4")
                found.append(gathered(flat, starts[ids], lengths[ids]).tobytes())
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.binary())], names=[*part.schema.names, "decoded"])

    return encoded.mapInArrow(released(run), schema_ddl)
