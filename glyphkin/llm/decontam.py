"""Operator 9: benchmark decontamination by pigeonhole edit matching.

An item that occurs in a document with at most k edits, cut into k + 1 pieces, has a piece there without any. So
all pieces of all items go into one Aho-Corasick automaton, every document runs through it once, and the place
around each piece hit is verified with Myers' bit-parallel edit distance. k is `max_edit_rate` of the item's
length, less where pieces would become shorter than `min_piece` characters. Items shorter than `min_item`
characters count only as exact whole words.

Items and documents are compared in lower case with white space runs as one space; offsets are those of that form.
Null and empty items match nothing, null and empty documents hold nothing. Equal items are reported one by one, as
are equal documents. Of several places of an item in a document the one of least distance counts, then the first.

The size of the items is asked first. Up to `block_chars` characters they are broadcast as one automaton, and one pass
over the documents does it. Beyond, the pieces are an index that is joined: documents are read once, every place of a
text is looked up in a filter of fixed size over the hashes of the pieces' first characters, what passes is joined
with the pieces by hash, and texts that share a piece with items meet these, and no others, in one task each. So what
a process holds does not grow with the number of items, and neither does the number of passes.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import mix, table

MAX_EDIT_RATE = 0.06
MIN_PIECE = 16
MIN_ITEM = 32
BLOCK_CHARS = 1 << 20


def normalise(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def myers(pattern: str, text: str, limit: int) -> tuple[int, int] | None:
    """(distance, end) of the best place of the pattern in the text: least distance, then earliest end; None above limit."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best = (m, 0)
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        diagonal = ((((eq & up) + up) & full) ^ up) | eq | down
        plus = down | (full & ~(diagonal | up))
        minus = up & diagonal
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = (plus << 1) & full, (minus << 1) & full
        up = minus | (full & ~(diagonal | plus))
        down = plus & diagonal
        if score < best[0]:
            best = (score, j + 1)
    return best if best[0] <= limit else None


def cuts_of(item: str, max_edit_rate: float = MAX_EDIT_RATE, min_piece: int = MIN_PIECE, min_item: int = MIN_ITEM) -> list[int]:
    """Where an item is cut into pieces, one more than the edits that it may have."""
    k = max(0, min(int(max_edit_rate * len(item)), len(item) // min_piece - 1)) if len(item) >= min_item else 0
    return [len(item) * i // (k + 1) for i in range(k + 2)]


class Matcher:
    """Finds items with few edits in normalised texts."""

    def __init__(self, items: list[tuple[int | None, str]], max_edit_rate: float = MAX_EDIT_RATE, min_piece: int = MIN_PIECE, min_item: int = MIN_ITEM) -> None:
        self.items, self.limits = items, []
        pieces: dict[str, list[tuple[int, int]]] = {}
        for n, (_, item) in enumerate(items):
            cuts = cuts_of(item, max_edit_rate, min_piece, min_item)
            self.limits.append(len(cuts) - 2)
            for a, b in zip(cuts, cuts[1:]):
                pieces.setdefault(item[a:b], []).append((n, a))
        self.min_item = min_item
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        if pieces:
            self.automaton.make_automaton()
        self.empty = not pieces

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item number, distance, start, end) for each item that the normalised text holds, by item number."""
        if self.empty or not text:
            return []
        places: dict[int, list[tuple[int, int]]] = {}
        for last, (size, owners) in self.automaton.iter(text):
            at = last + 1 - size
            for n, offset in owners:
                k, spans = self.limits[n], places.setdefault(n, [])
                low, high = at - offset - k, at - offset + len(self.items[n][1]) + k
                if spans and spans[-1][1] >= low >= spans[-1][0]:
                    spans[-1] = (spans[-1][0], max(high, spans[-1][1]))
                else:
                    spans.append((low, high))
        out = []
        for n in sorted(places):
            if (best := self._verify(n, text, places[n])) is not None:
                out.append((n, *best))
        return out

    def _verify(self, n: int, text: str, spans: list[tuple[int, int]]) -> tuple[int, int, int] | None:
        item, k = self.items[n][1], self.limits[n]
        best: tuple[int, int, int] | None = None
        for low, high in sorted(spans):
            low = max(0, low)
            at = text.find(item, low, high)
            while at >= 0 and len(item) < self.min_item and not self._whole(text, at, at + len(item)):
                at = text.find(item, at + 1, high)
            if at >= 0:
                return 0, at, at + len(item)
            if k and (found := myers(item, text[low:high], k)) and (best is None or found[0] < best[0]):
                distance, end = found
                back = myers(item[::-1], text[low : low + end][::-1][: len(item) + k], distance)
                best = (distance, low + end - (back[1] if back else len(item)), low + end)
        return best

    @staticmethod
    def _whole(text: str, start: int, end: int) -> bool:
        return not (start and text[start - 1].isalnum()) and not (end < len(text) and text[end].isalnum())


_MATCHERS: dict[tuple, Matcher] = {}


def _matcher(shared, rate: float) -> Matcher:
    """One automaton a process."""
    key = (shared.value[0], rate)
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = Matcher(shared.value[1], rate)
    return _MATCHERS[key]


def _shared_items(items: DataFrame, block_chars: int):
    """The normalised items as a broadcast, or None where they have more characters than that."""
    import uuid

    size = items.select(F.sum(F.length("text"))).first()[0] or 0
    if size > block_chars:
        return None
    rows = [(r[0], text) for r in items.select("item_id", "text").collect() if (text := normalise(r[1]))]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    return items.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, rows))


FOUND = pa.schema([("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
_FOUND = "item_id long, distance int, start long, end long"

#: Bits of the filter over pieces, eight to a byte: a fixed size.
FILTER_BITS = 1 << 26


def _windows(text: str, size: int) -> np.ndarray:
    """A hash of the `size` characters from each place on; none for shorter texts."""
    if len(text) < size:
        return np.zeros(0, np.uint64)
    codes = mix(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(size << 32))
    out = codes[: len(text) - size + 1].copy()
    for k in range(1, size):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        out += codes[k : k + len(out)]
    return mix(out)


def _normal_items(items: DataFrame, rate: float) -> tuple[DataFrame, DataFrame]:
    """(item, item_id, text, n): each different item once, with how often it occurs; (item, size, hash): its pieces."""

    def run(batches):
        for b in batches:
            texts = [normalise(t) for t in b.column("text").to_pylist()]
            some = [i for i, t in enumerate(texts) if t]
            heads = [[texts[i][p : p + MIN_PIECE] if q - p > MIN_PIECE else texts[i][p:q] for p, q in zip(c, c[1:])] for i in some for c in (cuts_of(texts[i], rate),)]
            hashes = [[int(_windows(h, len(h))[0].view(np.int64)) for h in x] for x in heads]
            yield pa.RecordBatch.from_arrays([b.column("item_id").take(pa.array(some, pa.int64())), pa.array([texts[i] for i in some], pa.string()), pa.array([[len(h) for h in x] for x in heads], pa.list_(pa.int32())), pa.array(hashes, pa.list_(pa.int64()))], ["item_id", "text", "sizes", "hashes"])

    rows = items.mapInArrow(run, "item_id long, text string, sizes array<int>, hashes array<long>")
    rows = rows.groupBy("item_id", "text").agg(F.count("*").alias("n"), F.first("sizes").alias("sizes"), F.first("hashes").alias("hashes"))
    rows = rows.withColumn("item", F.sha2(F.concat_ws(" ", F.coalesce(F.col("item_id").cast("string"), F.lit("-")), "text"), 256))
    pieces = rows.select("item", F.explode(F.arrays_zip("sizes", "hashes")).alias("p")).select("item", F.col("p.sizes").alias("size"), F.col("p.hashes").alias("hash")).distinct()
    return rows.select("item", "item_id", "text", "n"), pieces


def _joined(texts: DataFrame, items: DataFrame, rate: float) -> DataFrame:
    """(key, item_id, distance, start, end) for the items in each text. texts: (key, text)."""
    items, pieces = _normal_items(items, rate)
    place = F.pmod("hash", F.lit(FILTER_BITS))
    words = pieces.select((place / 64).cast("int").alias("w"), F.expr("shiftleft(1L, cast(pmod(hash, 64) as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    sizes = sorted(r[0] for r in pieces.select("size").distinct().collect())
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[words.column("w").to_numpy()] = words.column("b").to_numpy()
    shared = texts.sparkSession.sparkContext.broadcast((bits.view(np.uint64), sizes))

    def look(batches):
        filter_, sizes = shared.value
        for b in batches:
            who, found = [], []
            for i, t in enumerate(b.column("text").to_pylist()):
                t = normalise(t)
                # a long text in stretches that overlap by a window
                for size, a in ((size, a) for size in sizes for a in range(0, len(t), BLOCK_CHARS)):
                    h = np.unique(_windows(t[a : a + BLOCK_CHARS + size - 1], size))
                    at = h.view(np.int64) % FILTER_BITS
                    h = h[(filter_[at // 64] >> (at % 64).astype(np.uint64) & np.uint64(1)).astype(bool)]
                    who.append(np.full(len(h), i))
                    found.append(h.view(np.int64))
            if who:
                yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(np.concatenate(who))), pa.array(np.concatenate(found))], ["key", "hash"])

    hits = texts.mapInArrow(look, "key string, hash long").join(pieces.select("hash", "item").distinct(), "hash").select("key", "item").distinct()
    asked = hits.join(items, "item").select("key", "item_id", F.col("text").alias("item"), "n")
    once = texts.join(hits.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])

    def verify(t: pa.Table, wanted: pa.Table) -> pa.Table:
        rows = []
        if len(t) and len(wanted):
            own = sorted(zip(*(wanted.column(c).to_pylist() for c in ("item_id", "item", "n"))), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
            matcher = Matcher([r[:2] for r in own], rate)
            for n, *place in matcher.find(normalise(t.column("text")[0].as_py())):
                rows += [(t.column("key")[0].as_py(), own[n][0], *place)] * own[n][2]
        columns = list(zip(*rows)) or [()] * 5
        return pa.table([pa.array(columns[0], pa.string()), *(pa.array(c, f.type) for c, f in zip(columns[1:], FOUND))], names=["key", *FOUND.names])

    return once.groupBy("key").cogroup(asked.groupBy("key")).applyInArrow(verify, f"key string, {_FOUND}")


def _keyed(docs: DataFrame, text_col: str) -> DataFrame:
    """(key, text) of the texts: equal ones have one key."""
    return docs.select(F.sha2(F.col(text_col).cast("binary"), 256).alias("key"), F.col(text_col).alias("text")).filter("key IS NOT NULL")


def find_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_edit_rate: float = MAX_EDIT_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(id, item_id, distance, start, end) for each item that a document holds. items: (item_id, text)."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    shared = _shared_items(items, block_chars)
    if shared is None:
        found = _joined(_keyed(docs, text_col), items, max_edit_rate)
        rows = docs.select(F.col(id_col).alias("id"), F.sha2(F.col(text_col).cast("binary"), 256).alias("key"))
        return rows.join(found, "key").select(F.col("id").alias(id_col), *FOUND.names)

    def run(batches):
        matcher = _matcher(shared, max_edit_rate)
        for b in batches:
            rows, who = [], []
            for i, t in enumerate(b.column("text").to_pylist()):
                for n, distance, start, end in matcher.find(normalise(t)):
                    who.append(i)
                    rows.append((matcher.items[n][0], distance, start, end))
            if rows:
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), FOUND)]
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(who)), *columns], ["id", *FOUND.names])

    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return plain.mapInArrow(run, f"id {kind}, {_FOUND}").withColumnRenamed("id", id_col)


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", max_edit_rate: float = MAX_EDIT_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents that hold no item, with all their columns. items: (item_id, text)."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    shared = _shared_items(items, block_chars)
    if shared is None:
        found = _joined(_keyed(docs, text_col), items, max_edit_rate).select("key").distinct()
        return docs.alias("d").join(found.alias("f"), F.sha2(F.col(f"d.`{text_col}`").cast("binary"), 256) == F.col("f.key"), "left_anti")

    def run(batches):
        matcher = _matcher(shared, max_edit_rate)
        for b in batches:
            clean = [not matcher.find(normalise(t)) for t in b.column(text_col).to_pylist()]
            yield b.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, T.StructType(docs.schema.fields))


def op9_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that it holds."""
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
