"""What the operators of this package share: shared storage, hold-out rule, numpy word hashing."""

from __future__ import annotations

import ctypes
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..storage import shared_base, shared_folder

# White space as the contracts define it, one byte each in UTF-8.
SPACES = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under the cluster's shared checkpoint folder."""
    return shared_folder(spark, "llm")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """checkpoint() works afterwards: the cluster's folder, or on a local master one of our own."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_base(spark))


def stored(df: DataFrame) -> DataFrame:
    """Written as Parquet in the shared folder and read again: lineage is cut, every executor sees it."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id's decimal digits, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit values; every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


#: Bytes whose running sums are held at a time.
HASH_BYTES = 1 << 18

#: Places within a word that have a table of their own; bytes further on are mixed one by one.
PLACES = 64

#: For each lane, place and byte a random value. A word's hash is the sum of its bytes' values, so two words of equal
#: length differ by a sum of independent random numbers, whatever pattern they follow.
_BYTE_VALUES = np.random.default_rng(20240607).integers(0, 2**64, (2, PLACES * 256), np.uint64)
_FAR = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def separators(extra: bytes = b"") -> np.ndarray:
    """True for bytes that belong to words when words are cut at white space (and the bytes of extra)."""
    inside = np.ones(256, bool)
    inside[list(SPACES + extra)] = False
    return inside


_WORD = separators()


def _joined(a: np.ndarray, b: np.ndarray, gap: int) -> np.ndarray:
    """From each place on, the hash of what a says there and b says `gap` places later."""
    out = a * np.uint64(0x9E3779B97F4A7C15)
    out[: len(a) - gap] += b[gap:] ^ np.uint64(0xA0761D6478BD642F)
    return mix(out)


class Words:
    """The words of several texts in one byte buffer, found and hashed by whole-array operations.

    starts, ends: byte offsets of the words; hashes: 64 bits a word, in two independent lanes; first: word offset of
    each text (one more entry than texts).
    """

    def __init__(self, texts: list, inside: np.ndarray = _WORD) -> None:
        parts = [b"" if t is None else t.encode("utf-8", "surrogatepass") if isinstance(t, str) else t for t in texts]
        self.data = b"\n" + b"\n".join(parts) + b"\n"
        self.buf = np.frombuffer(self.data, np.uint8)
        is_word = inside[self.buf]
        self.starts = np.flatnonzero(is_word[1:] & ~is_word[:-1]) + 1
        self.ends = np.flatnonzero(is_word[:-1] & ~is_word[1:]) + 1
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        self.text_at = 1 + np.concatenate([[0], np.cumsum(sizes + 1)])
        self.first = np.searchsorted(self.starts, self.text_at)
        self._lanes: dict[int, np.ndarray] = {}

    @property
    def hashes(self) -> np.ndarray:
        return self.hashed(0)

    def hashed(self, lane: int) -> np.ndarray:
        """The words' hashes in one lane, made when first asked for."""
        if lane not in self._lanes:
            self._lanes[lane] = self._hash_words(lane)
        return self._lanes[lane]

    def forget(self) -> None:
        """Gives the hashes' memory back once all rows of words that are wanted have theirs."""
        self._lanes.clear()

    def _hash_words(self, lane: int) -> np.ndarray:
        """Sums of the values of the words' bytes from running sums, a few hundred kilobytes at a time."""
        out = np.zeros(len(self.starts), np.uint64)
        values, far = _BYTE_VALUES[lane], _FAR[lane]
        i = 0
        while i < len(out):
            base = int(self.starts[i])
            j = max(i + 1, int(np.searchsorted(self.ends, base + HASH_BYTES, side="right")))
            part = self.buf[base : int(self.ends[j - 1])]
            a, b = self.starts[i:j] - base, self.ends[i:j] - base
            place = np.arange(len(part)) - np.repeat(a, np.diff(np.append(a, len(part))))
            sums = np.zeros(len(part) + 1, np.uint64)
            each = values[(np.minimum(place, PLACES - 1) << 8) | part]
            if (b - a).max() > PLACES:
                late = np.flatnonzero(place >= PLACES)
                each[late] = mix(((place[late] << 8) | part[late]).astype(np.uint64) * far + values[0])
            np.cumsum(each, out=sums[1:])
            out[i:j] = mix((sums[b] - sums[a]) + (b - a).astype(np.uint64) * far)
            i = j
        return out

    def __len__(self) -> int:
        return len(self.starts)

    def grams(self, n: int, lane: int = 0) -> np.ndarray:
        """The hash of the n words from each word on; meaningless where valid(n) is False.

        Hashes of 1, 2, 4, ... words are mixed two by two, those that n is the sum of one after another.
        """
        size = len(self.starts)
        if size < n:
            return np.zeros(size, np.uint64)
        out, done = None, 0
        part, width = self.hashed(lane), 1
        while width <= n:
            if n & width:
                out, done = (part, width) if out is None else (_joined(out, part, done), done + width)
            width *= 2
            if width <= n:
                part = _joined(part, part, width // 2)
        return out

    def valid(self, n: int) -> np.ndarray:
        """True for the words from which n words lie in the same text."""
        ok = np.zeros(len(self.starts) + 1, np.int8)
        a, b = self.first[:-1], self.first[1:] - n + 1
        long = b > a
        np.add.at(ok, a[long], 1)
        np.add.at(ok, b[long], -1)
        return np.cumsum(ok[:-1]) > 0


@functools.cache
def _malloc_trim():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):
        return None


def trim() -> None:
    """Gives freed memory back to the system: Python workers are kept between tasks, and so is what they hold."""
    pa.default_memory_pool().release_unused()
    if _malloc_trim():
        _malloc_trim()(0)


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Start offsets of the runs of equal values."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
