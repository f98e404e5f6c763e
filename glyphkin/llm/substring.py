"""Operator 1: exact substring deduplication with fixed-block anchors.

A repeat of `window` words always holds a whole aligned block of `(window + 1) // 2` words of either occurrence,
wherever it starts. So the non-overlapping blocks of every document are the index, every rolling window of a
block's length is a probe, and a probe that meets a block elsewhere is a hit. Hits are extended to maximal exact
repeats: every window of `window` words around a hit is compared by two independent hashes (128 bits in a chunk, 96
and those that chose the bucket between chunks), and the runs of windows that start elsewhere too are the repeats;
their words go.

Layout: rows are dealt by their place in the input into chunks of bounded size, compressed, over one exchange that all
three passes read. So no id, null or other, fills a chunk, however often it occurs; but the input must give the same
rows in the same order when a lost part of it is read again, as files and stored tables do. Keys travel as packed arrays between chunks and hash buckets. A chunk sends a key once,
however often it holds it, so a passage that a third of all documents share costs a bucket one entry a chunk.

Words are `[^\\x20\\x09-\\x0D]+`, unchanged. Null and empty texts have no words and give empty kept text. Documents
shorter than the window lose nothing. Rows with the same id or the same text are separate documents that repeat
each other. Other columns pass through; ones named like an output are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import Words, mix, runs, table, trim

#: Least and largest chunk. A task holds a few times its chunk's size in arrays of numbers.
CHUNK_BYTES, MOST_CHUNK_BYTES = 4 << 20, 64 << 20
PACKED = "chunk long, payload binary"
TO_BUCKET = "bucket long, chunk long, payload binary"


def chunks_for(df: DataFrame, text_col: str, chunk_bytes: int | None = None) -> int:
    """How many chunks hold the table: one cheap aggregation.

    What a chunk sends to a bucket should be some hundred entries, or their packing costs more than they do. A chunk
    of c bytes has about c / 5 words for T / (2 c) buckets, so c grows as the root of the text's size T, within bounds.
    """
    total = df.select(F.sum(F.octet_length(text_col))).first()[0] or 0
    size = chunk_bytes or min(MOST_CHUNK_BYTES, max(CHUNK_BYTES, int((700 * total) ** 0.5)))
    return max(1, -(-total // size))


def buckets_for(n_chunks: int) -> int:
    """Hash buckets for so many chunks: a bucket gets entries of 6 bytes a word, a chunk whole texts."""
    return max(1, -(-n_chunks // 2))


def packed_rows(rows: pa.RecordBatch, keys: np.ndarray) -> pa.RecordBatch:
    """(chunk, payload): the rows of each key as one compressed Arrow stream."""
    press = zstandard.ZstdCompressor(level=3)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = runs(keys)
    out = []
    for i, j in zip(at, [*at[1:], len(keys)]):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema) as w:
            w.write_batch(rows.take(pa.array(order[i:j])))
        out.append(press.compress(sink.getvalue()))
    return pa.RecordBatch.from_arrays([pa.array(keys[at], pa.int64()), pa.array(out, pa.binary())], ["chunk", "payload"])


def deal(df: DataFrame, n_chunks: int) -> DataFrame:
    """(chunk, payload): whole rows, by a hash of their place in the input, as compressed Arrow streams."""

    def run(batches):
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 40
        for b in batches:
            keys = (mix(np.arange(at, at + len(b), dtype=np.uint64)) % np.uint64(n_chunks)).astype(np.int64)
            at += len(b)
            yield packed_rows(b, keys)
            del b
            trim()

    return df.mapInArrow(run, PACKED)


def unpacked(blobs) -> list[pa.Table]:
    press = zstandard.ZstdDecompressor()
    return [pa.ipc.open_stream(press.decompress(x.as_py())).read_all() for x in blobs]


def undeal(blobs, id_col: str, text_col: str) -> pa.Table:
    """The rows of one chunk, those that differ in id or text in an order that depends on these alone."""
    return pa.concat_tables(unpacked(blobs)).combine_chunks().sort_by([(id_col, "ascending"), (text_col, "ascending")])


#: Packs of fewer entries are stored as they are; compressing them costs more than it saves.
SMALL = 192


def pack(at: np.ndarray, *columns: tuple[np.ndarray, int]) -> bytes:
    """Ascending positions as byte planes of their gaps, columns as their low bytes; width 0 is for flags."""
    gaps = np.diff(at, prepend=0).astype("<u4")
    small = len(at) < SMALL
    press = None if small else zstandard.ZstdCompressor(level=1)
    planes = np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 4).T).tobytes()
    head = planes if small else press.compress(planes)
    parts = [len(at).to_bytes(4, "little"), len(head).to_bytes(4, "little"), head]
    for values, width in columns:
        if width == 0:
            bits = np.packbits(values).tobytes()
            bits = bits if small else press.compress(bits)
            parts += [len(bits).to_bytes(4, "little"), bits]
        else:
            parts.append(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes())
    return b"".join(parts)


def unpack(data: bytes, *widths: int) -> list[np.ndarray]:
    n, size = int.from_bytes(data[:4], "little"), int.from_bytes(data[4:8], "little")
    plain = (lambda x: x) if n < SMALL else zstandard.ZstdDecompressor().decompress
    planes = np.frombuffer(plain(data[8 : 8 + size]), np.uint8).reshape(4, n)
    out = [np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64))]
    i = 8 + size
    for width in widths:
        if width == 0:
            size = int.from_bytes(data[i : i + 4], "little")
            bits = np.frombuffer(plain(data[i + 4 : i + 4 + size]), np.uint8)
            out.append(np.unpackbits(bits, count=n).astype(bool))
            i += 4 + size
        else:
            wide = np.zeros((n, 8), np.uint8)
            wide[:, :width] = np.frombuffer(data, np.uint8, n * width, i).reshape(n, width)
            out.append(wide.view("<u8").ravel())
            i += n * width
    return out


def trimmed(run):
    """The function of one table, with freed memory given back after each call."""

    def then_trim(t: pa.Table) -> pa.Table:
        try:
            return run(t)
        finally:
            trim()

    return then_trim


def trimmed_pair(run):
    """The same for a function of two tables."""

    def then_trim(t: pa.Table, other: pa.Table) -> pa.Table:
        try:
            return run(t, other)
        finally:
            trim()

    return then_trim


def by_bucket(chunk: int, hashes: np.ndarray, at: np.ndarray, n_buckets: int, *columns: tuple[np.ndarray, int]) -> pa.Table:
    """One row a bucket: the entries whose hash falls to it, in ascending position."""
    bucket = (hashes >> np.uint64(40)).astype(np.int64) % n_buckets
    order = np.argsort(bucket.astype(np.uint16) if n_buckets <= 1 << 16 else bucket, kind="stable")
    bucket = bucket[order]
    first = runs(bucket)
    rows = []
    for i, j in zip(first, [*first[1:], len(bucket)]):
        pick = order[i:j]
        rows.append(pack(at[pick], *((c[pick], w) for c, w in columns)))
    return pa.table({"bucket": pa.array(bucket[first], pa.int64()), "chunk": pa.array(np.full(len(first), chunk), pa.int64()), "payload": pa.array(rows, pa.binary())})


class Groups:
    """Equal keys among positions: members in order, and the earliest position of each group."""

    def __init__(self, keys: np.ndarray, at: np.ndarray, second: np.ndarray | None = None) -> None:
        """second: another key that members of a group have in common too."""
        order = np.argsort(keys, kind="stable")
        if second is not None:
            k, s = keys[order], second[order]
            if ((k[1:] == k[:-1]) & (s[1:] != s[:-1])).any():
                order = np.lexsort((second, keys))
        self.at = at[order]
        k = keys[order]
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        if second is not None:
            s = second[order]
            new[1:] |= s[1:] != s[:-1]
        self.start = np.flatnonzero(new)
        self.size = np.diff(np.append(self.start, len(order)))
        self.rep = self.at[self.start] if len(order) else np.zeros(0, np.int64)

    def spread(self, flags: np.ndarray) -> np.ndarray:
        """The positions in the groups that are flagged."""
        return self.at[np.repeat(flags, self.size)]

    def any(self, mask: np.ndarray) -> np.ndarray:
        return np.add.reduceat(mask[self.at].astype(np.int64), self.start) > 0 if len(self.start) else np.zeros(0, bool)


def _blocks(words: Words, block: int) -> tuple[Groups, np.ndarray, np.ndarray]:
    """Rolling windows grouped by key; every word's key; which groups hold an aligned block of a document."""
    keys = words.grams(block)
    at = np.flatnonzero(words.valid(block))
    aligned = np.zeros(len(words), bool)
    size = np.diff(words.first)
    within = np.arange(len(words)) - np.repeat(words.first[:-1], size)
    aligned[at] = within[at] % block == 0
    groups = Groups(keys[at], at)
    return groups, keys, groups.any(aligned)


def find_shared(packed: DataFrame, widths: tuple[int, ...], flagged: bool) -> DataFrame:
    """Per bucket, the keys that two chunks or more hold (one of them as an aligned block, if flagged)."""

    def run(t: pa.Table) -> pa.Table:
        chunks = t.column("chunk").to_numpy()
        parts = [unpack(x.as_py(), *widths) for x in t.column("payload")]
        at = np.concatenate([p[0] for p in parts])
        columns = [np.concatenate([p[i] for p in parts]) for i in range(1, len(widths) + 1)]
        keys = columns[:-1] if flagged else columns
        order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
        new = np.zeros(len(order), bool)
        new[:1] = True
        for k in keys:
            s = k[order]
            new[1:] |= s[1:] != s[:-1]
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(order)))
        good = size >= 2
        if flagged:
            good &= np.add.reduceat(columns[-1][order].astype(np.int64), start) > 0
        hit = np.zeros(len(order), bool)
        hit[order] = np.repeat(good, size)
        out_chunk, out = [], []
        edges = np.concatenate([[0], np.cumsum([len(p[0]) for p in parts])])
        for i, c in enumerate(chunks):
            mine = at[edges[i] : edges[i + 1]][hit[edges[i] : edges[i + 1]]]
            if len(mine):
                out_chunk.append(c)
                out.append(pack(mine))
        return pa.table({"chunk": pa.array(out_chunk, pa.int64()), "payload": pa.array(out, pa.binary())})

    return packed.groupBy("bucket").applyInArrow(trimmed(run), PACKED)


def _reps(payloads) -> np.ndarray:
    found = [unpack(x.as_py())[0] for x in payloads]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, chunk_bytes: int | None = None) -> DataFrame:
    """All columns and n_words, n_removed, kept_text (the kept words joined by one space)."""
    outputs = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())]
    kept = [f for f in docs.schema if f.name not in {o.name for o in outputs}]
    docs = docs.select([f.name for f in kept])
    block = (window + 1) // 2
    n = chunks_for(docs, text_col, chunk_bytes)
    dealt = deal(docs, n)
    buckets = buckets_for(n)

    def probe(t: pa.Table) -> pa.Table:
        words = Words(undeal(t.column("payload"), id_col, text_col).column(text_col).to_pylist())
        groups, keys, aligned = _blocks(words, block)
        order = np.argsort(groups.rep, kind="stable")
        at = groups.rep[order]
        return by_bucket(t.column("chunk")[0].as_py(), keys[at], at, buckets, (keys[at], 5), (aligned[order], 0))

    hits = find_shared(dealt.groupBy("chunk").applyInArrow(trimmed(probe), TO_BUCKET), (5, 0), flagged=True)

    def extend(t: pa.Table, found: pa.Table) -> pa.Table:
        words = Words(undeal(t.column("payload"), id_col, text_col).column(text_col).to_pylist())
        groups, _, aligned = _blocks(words, block)
        hit = (aligned & (groups.size >= 2)) | np.isin(groups.rep, _reps(found.column("payload")))
        del _
        near = np.zeros(len(words) + 1, np.int64)
        near[1 + groups.spread(hit)] = 1
        del groups, hit, aligned
        near = np.cumsum(near)
        at = np.flatnonzero(words.valid(window))
        at = at[near[at + window - block + 1] > near[at]]
        first, second = words.grams(window), words.grams(window, lane=1)
        del near
        words.forget()
        at = np.sort(Groups(first[at], at, second[at]).rep)
        return by_bucket(t.column("chunk")[0].as_py(), first[at], at, buckets, (first[at], 5), (second[at], 7))

    longer = dealt.groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInArrow(trimmed_pair(extend), TO_BUCKET)
    repeats = find_shared(longer, (5, 7), flagged=False)
    schema = T.StructType([*kept, *outputs])

    def remove(t: pa.Table, found: pa.Table) -> pa.Table:
        rows = undeal(t.column("payload"), id_col, text_col)
        words = Words(rows.column(text_col).to_pylist())
        at = np.flatnonzero(words.valid(window))
        groups = Groups(words.grams(window)[at], at, words.grams(window, lane=1)[at])
        words.forget()
        again = groups.spread((groups.size >= 2) | np.isin(groups.rep, _reps(found.column("payload"))))
        del groups, at
        cover = np.zeros(len(words) + window + 1, np.int64)
        np.add.at(cover, again, 1)
        np.add.at(cover, again + window, -1)
        gone = np.cumsum(cover)[: len(words)] > 0
        texts = kept_texts(words, ~gone)
        counts = np.diff(words.first)
        removed = np.concatenate([[0], np.cumsum(gone)])
        for f, x in zip(outputs, (pa.array(counts, pa.int64()), pa.array(removed[words.first[1:]] - removed[words.first[:-1]], pa.int64()), pa.array(texts, pa.string()))):
            rows = rows.append_column(f.name, x)
        return rows

    return dealt.groupBy("chunk").cogroup(repeats.groupBy("chunk")).applyInArrow(trimmed_pair(remove), schema)


def kept_texts(words: Words, keep: np.ndarray) -> list[str]:
    """Each text's kept words joined by one space."""
    starts, ends = words.starts[keep], words.ends[keep]
    buf = words.buf.copy()
    buf[ends] = 32
    mark = np.zeros(len(buf) + 1, np.int8)
    mark[starts] += 1
    mark[ends + 1] -= 1
    out = buf[np.cumsum(mark[:-1], dtype=np.int8) > 0].tobytes()
    size = np.concatenate([[0], np.cumsum(ends - starts + 1)])
    kept_before = np.concatenate([[0], np.cumsum(keep)])
    edges = size[kept_before[words.first]]
    return [out[i : max(i, j - 1)].decode("utf-8", "surrogatepass") for i, j in zip(edges[:-1], edges[1:])]


def op1_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document once passages of 35 words or more that repeat anywhere are gone."""
    done = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))
