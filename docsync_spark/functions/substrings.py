"""Which of very many strings occur in texts, as rows to join.

Each string's first 8 bytes, these with its length, and its checksum each set one bit of a table of fixed size. A text's places
whose bits are all set are given out: the strings that occur there, and few others, which the join drops.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsync_spark.sources.scratch import text_parts

#: The table has 2 ** BITS bits, 16 MB, whatever the number of strings; more strings only set more of them.
BITS = 27
MIX, BY_LENGTH, BY_CHECKSUM = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
#: What names a string: its first 8 bytes as a number, its CRC-32 and its bytes.
NAMES = ("__begin", "__crc", "__bytes")


def _bits(keys: np.ndarray) -> np.ndarray:
    return (keys * MIX) >> np.uint64(64 - BITS)


def _bits_of(begin: np.ndarray, length: np.ndarray, checksum: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bits of strings by first bytes, by these and the length, and by length and checksum."""
    return _bits(begin), _bits(begin ^ (length * BY_LENGTH)), _bits((checksum | length << np.uint64(32)) * BY_CHECKSUM ^ begin)


def names(s: Column) -> list[Column]:
    """NAMES of strings of 8 bytes or more, native."""
    begin = F.conv(F.hex(F.substring(s.cast("binary"), 1, 8)), 16, -10).cast("long")
    return [x.alias(name) for x, name in zip((begin, F.crc32(s.cast("binary")), F.octet_length(s)), NAMES, strict=True)]


def table_of(strings: DataFrame) -> tuple[bytes, list[int]]:
    """The table of bits of a table (s) of strings of 8 bytes or more, and the lengths in bytes that occur."""

    def run(batches):
        for batch in batches:
            for part in text_parts(batch, "s"):
                found = part.column("s").cast(pa.binary()).to_pylist()
                begin = np.array([int.from_bytes(x[:8], "big") for x in found], np.uint64)
                length = np.array([len(x) for x in found], np.uint64)
                set_ = _bits_of(begin, length, np.array([zlib.crc32(x) for x in found], np.uint64))
                # lengths as bits beyond the table's
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate([*set_, length + np.uint64(1 << BITS)])).astype(np.int64) + 1)], names=["bit"])

    bits = strings.select("s").mapInArrow(run, "bit long")
    held = bits.groupBy(F.bitmap_bucket_number("bit").alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()
    size, table, lengths = 1 << BITS - 3, bytearray(1 << BITS - 3), []
    for r in held:
        at = (r["at"] - 1) * len(r["bits"])
        if at < size:
            table[at : at + len(r["bits"])] = r["bits"]
        else:
            lengths += (np.flatnonzero(np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little")) + 8 * (at - size)).tolist()
    return bytes(table), sorted(lengths)


def _windows(data: bytes) -> np.ndarray:
    """The 8 bytes from each place on as a big-endian number; beyond the end are zeros."""
    n, padded, out = len(data), data + bytes(8), np.empty(len(data), np.uint64)
    for k in range(min(8, n)):
        out[k::8] = np.frombuffer(padded, ">u8", -(-(n - k) // 8), k)
    return out


def _seen(texts: list[bytes], table: np.ndarray, lengths: list[int]) -> pd.DataFrame:
    """(text, begin, crc, bytes): the text's number and the name of each string that seems to occur in it, once."""
    data, ends = b"".join(texts), np.cumsum([len(x) for x in texts])
    is_set = lambda bits: (table[bits >> np.uint64(3)] >> (bits & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    windows = _windows(data)
    at = np.flatnonzero(is_set(_bits(windows)))
    begin, owner = windows[at], np.searchsorted(ends, at, "right")
    room, view, out = ends[owner] - at, memoryview(data), []
    for n in lengths:
        likely = np.flatnonzero(room >= n)
        likely = likely[is_set(_bits(begin[likely] ^ (np.full(len(likely), n, np.uint64) * BY_LENGTH)))]
        crc = np.array([zlib.crc32(view[p : p + n]) for p in at[likely].tolist()], np.uint64)
        good = is_set(_bits_of(begin[likely], np.full(len(likely), n, np.uint64), crc)[2])
        likely = likely[good]
        out.append(pd.DataFrame({"text": owner[likely], "begin": begin[likely].view(np.int64), "crc": crc[good].astype(np.int64), "bytes": np.full(len(likely), n, np.int32)}))
    return pd.concat(out).drop_duplicates()


def occurring(texts: DataFrame, strings: DataFrame) -> DataFrame:
    """(__key, *NAMES) of the strings (s), of 8 bytes or more, that occur in texts (__key string, text), and of few that only seem to."""
    table, lengths = table_of(strings)
    sent = texts.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        bits = np.frombuffer(sent.value, np.uint8)
        for batch in batches:
            for part in text_parts(batch, "text"):
                found = _seen([x or b"" for x in part.column("text").cast(pa.binary()).to_pylist()], bits, lengths)
                own = part.column("__key").take(pa.array(found["text"].to_numpy(np.int64)))
                yield pa.RecordBatch.from_arrays([own, *(pa.array(found[c].to_numpy()) for c in ("begin", "crc", "bytes"))], names=["__key", *NAMES])

    schema = f"__key string, {NAMES[0]} long, {NAMES[1]} long, {NAMES[2]} int"
    return texts.mapInArrow(run, schema) if lengths else texts.sparkSession.createDataFrame([], schema)
