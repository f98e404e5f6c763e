"""Operator 6: language identification by multinomial naive Bayes over hashed character n-grams.

Characters are lower-cased code points; everything that is no letter counts as a space. Every 1-, 2- and 3-gram
of a text is hashed to one of `buckets` rows of a log-probability matrix (buckets x languages, float32, so its
size does not depend on the data), which is broadcast; a batch of texts is scored by adding the rows that its
n-grams name, which is the product of its sparse count matrix with the dense one.

Training reads at most `per_lang` texts a language, chosen by a hash of the id, whole, and those over 128 KB not. A text that is null or has
no letter is `und` with score 0; with no training rows every text is. Equal scores: the first language in
alphabetical order. Rows are scored alone, so repeated rows need no rule. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import held_out, table, trim

BUCKETS = 1 << 16
PER_LANG = 1000
ORDERS = 3
BATCH_CHARS = 1 << 18

_LETTER: np.ndarray | None = None


def letters() -> np.ndarray:
    """True for the code points that are letters."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTER


class Grams:
    """The hashed n-grams of several lower-case texts; index 0 stands for no letter at all and weighs nothing."""

    def __init__(self, lower: list[str], buckets: int = BUCKETS) -> None:
        sizes = np.fromiter(map(len, lower), np.int64, len(lower))
        chars = np.frombuffer(("   ".join(lower) + "   ").encode("utf-32-le", "surrogatepass"), np.uint32)
        chars = np.where(letters()[chars], chars, 0).astype(np.uint32)
        self.at = np.concatenate([[0], np.cumsum(sizes + 3)])
        self.has_letter = np.add.reduceat(chars != 0, self.at[:-1]) > 0 if lower else np.zeros(0, bool)
        self.hashed = []
        h = np.zeros(len(chars), np.uint32)
        some = np.zeros(len(chars), bool)
        for n in range(ORDERS):
            shifted = np.zeros(len(chars), np.uint32)
            shifted[: len(chars) - n] = chars[n:]
            h = (h ^ shifted) * np.uint32(0x9E3779B1) + np.uint32(n)
            h ^= h >> np.uint32(15)
            some |= shifted != 0
            self.hashed.append(np.where(some, 1 + h % np.uint32(buckets - 1), 0).astype(np.int32))


class NaiveBayes:
    def __init__(self, langs: list[str], weights: np.ndarray, prior: np.ndarray) -> None:
        self.langs, self.weights, self.prior = langs, weights, prior

    @classmethod
    def fit(cls, samples: list[tuple[str, list[str]]], buckets: int = BUCKETS, smoothing: float = 0.5) -> NaiveBayes:
        """samples: (language, texts)."""
        samples = sorted(samples)
        counts = np.full((len(samples), ORDERS, buckets), smoothing)
        for i, (_, texts) in enumerate(samples):
            for part in split_by_size(texts):
                for n, h in enumerate(Grams([t.lower() for t in part], buckets).hashed):
                    counts[i, n] += np.bincount(h, minlength=buckets)
        counts[:, :, 0] = 0
        logs = np.log(np.maximum(counts, 1e-300) / counts.sum(2, keepdims=True))
        logs[:, :, 0] = 0
        sizes = np.array([len(t) for _, t in samples], float)
        return cls([x for x, _ in samples], logs.astype(np.float32), np.log(sizes / sizes.sum()))

    def score(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """The likeliest language of each text and its probability among the learned ones."""
        if not texts or not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        total = np.tile(self.prior, (len(texts), 1))
        lettered = np.zeros(len(texts), bool)
        lower = [t.lower() for t in texts]
        short = [i for i, t in enumerate(lower) if len(t) <= BATCH_CHARS]
        self._add(total, lettered, short, Grams([lower[i] for i in short], self.weights.shape[2]), None)
        for i, t in enumerate(lower):
            # a long text in pieces; each n-gram counts in the piece where it begins
            for a in range(0, len(t) if len(t) > BATCH_CHARS else 0, BATCH_CHARS):
                piece = Grams([t[a : a + BATCH_CHARS + ORDERS - 1]], self.weights.shape[2])
                self._add(total, lettered, [i], piece, BATCH_CHARS)
        best = total.argmax(1)
        chance = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        return [self.langs[b] if ok else "und" for b, ok in zip(best, lettered)], np.where(lettered, np.minimum(chance, 1.0), 0.0).tolist()


    def _add(self, total: np.ndarray, lettered: np.ndarray, rows: list[int], grams: Grams, first: int | None) -> None:
        """Adds the log chances of each text's n-grams to its row; of the first so many positions only, if given."""
        if not rows:
            return
        for i in range(len(self.langs)):
            sums = self.weights[i, 0][grams.hashed[0][:first]]
            for n in range(1, ORDERS):
                sums += self.weights[i, n][grams.hashed[n][:first]]
            total[rows, i] += np.add.reduceat(sums, grams.at[:-1], dtype=np.float64)
        lettered[rows] |= grams.has_letter


def split_by_size(texts: list[str], limit: int = BATCH_CHARS):
    """Consecutive parts of at most `limit` characters, or one text."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > limit:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def part_bounds(texts: pa.Array, limit: int = 1 << 21) -> list[tuple[int, int]]:
    """Consecutive parts (first, last) of a column of texts of about `limit` bytes, or one text."""
    size = np.cumsum(pa.compute.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    cut = np.flatnonzero(np.diff(size // limit)) + 1
    return list(zip([0, *cut.tolist()], [*cut.tolist(), len(size)])) if len(size) else []


def map_texts(df: DataFrame, id_col: str, text_col: str, extra: list[str], schema: str, score: Callable[[list[str]], tuple[list, ...]]) -> DataFrame:
    """(id, extra..., what score returns) for each row; null texts are empty. The text may be among extra."""
    source = [id_col, *extra]
    names = [f"i{k}" for k in range(len(source))]
    # the text travels once, also where it is among the rows' other columns
    text, unread = (names[source.index(text_col)], []) if text_col in source else ("t", [F.col(f"`{text_col}`").alias("t")])
    fields = [f.strip().rsplit(" ", 1) for f in schema.split(",")]
    arrow = {"string": pa.string(), "double": pa.float64(), "int": pa.int32(), "long": pa.int64()}
    kinds = [arrow[kind] for _, kind in fields]

    def run(batches):
        for batch in batches:
            # in parts by size, so that a batch of long texts is not held in every form at once
            for first, last in part_bounds(batch.column(text)):
                b = batch.slice(first, last - first)
                out: list[list] | None = None
                for part in split_by_size([t or "" for t in b.column(text).to_pylist()]):
                    got = score(part)
                    out = [[] for _ in got] if out is None else out
                    for o, g in zip(out, got):
                        o.extend(g)
                if out:
                    yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *(pa.array(o, kinds[i]) for i, o in enumerate(out))], [*names, *(f"c{i}" for i in range(len(out)))])
                del b, out
                trim()
            del batch

    # columns are matched by name, so all have names of the map's own while they are in it
    inner = ", ".join([*(f"{n} {df.schema[c].dataType.simpleString()}" for n, c in zip(names, source)), *(f"c{i} {kind}" for i, (_, kind) in enumerate(fields))])
    mapped = df.select(*(F.col(f"`{c}`").alias(n) for n, c in zip(names, source)), *unread).mapInArrow(run, inner)
    return mapped.select(*(F.col(n).alias(c) for n, c in zip(names, source)), *(F.col(f"c{i}").alias(name) for i, (name, _) in enumerate(fields)))


#: Texts of more bytes are not learned from, and all texts of a sample have about as many bytes at most.
MOST_TEXT_BYTES, SAMPLE_BYTES = 1 << 17, 1 << 27
#: Hash values among which the rows with the smallest ones are taken.
SPACE = 1 << 31


def place_of(id_col: str) -> Column:
    return F.pmod(F.xxhash64(F.col(id_col)), F.lit(SPACE))


def bound_for(limit: int, rows: int) -> int:
    """The hash bound below which about a fifth more than `limit` of so many rows lie."""
    return min(SPACE, -(-limit * 6 * SPACE // (5 * max(rows, 1))))


def sample_by(df: DataFrame, id_col: str, text_col: str, by: str, limit: int, most_values: int = 1000, most_bytes: int = SAMPLE_BYTES) -> list[tuple[object, list[str]]]:
    """(value, texts) for at most `limit` rows of each value of `by`, those with the smallest hash of the id.

    Values are counted first; the rows below a hash bound that lets a fifth more than `limit` through come in one job.
    No group of rows is sorted or gathered on an executor. Texts over MOST_TEXT_BYTES are passed over, and where
    `limit` texts of average length of each value would be more than `most_bytes`, fewer are taken of each. More
    than `most_values` values raise an error.
    """
    size = F.octet_length(text_col)
    df = df.filter(F.col(by).isNotNull() & F.col(id_col).isNotNull() & (size <= MOST_TEXT_BYTES))
    counts = df.groupBy(by).agg(F.count("*").alias("n"), F.avg(size).alias("mean")).limit(most_values + 1).collect()
    if not counts:
        return []
    if len(counts) > most_values:
        raise ValueError(f"more than {most_values} values of {by}")
    limit = max(1, min(limit, int(most_bytes / max(1.0, sum(r["mean"] for r in counts)))))
    bounds = df.sparkSession.createDataFrame([(r[0], bound_for(limit, r["n"])) for r in counts], df.select(F.col(by).alias("__value")).schema.add("__bound", "long"))
    # one row a value, at most `most_values`
    rows = df.join(F.broadcast(bounds), (F.col(by) == F.col("__value")) & (place_of(id_col) < F.col("__bound")))
    out: dict[object, list[tuple]] = {}
    # an id that many rows have counts once, with its smallest text
    for r in rows.groupBy(by, id_col).agg(F.min(text_col).alias("__text")).select(by, place_of(id_col), id_col, "__text").collect():
        out.setdefault(r[0], []).append(tuple(r)[1:])
    return sorted((k, [t for *_, t in sorted(v)[:limit]]) for k, v in out.items())


def train_language_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG, most_langs: int = 1000) -> NaiveBayes:
    """Learned from at most `per_lang` texts of each language; more than `most_langs` languages raise an error."""
    return NaiveBayes.fit(sample_by(docs, id_col, text_col, lang_col, per_lang, most_langs))


def identify_languages(df: DataFrame, model: NaiveBayes, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """(id, extra..., lang_pred, score) for each row."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    return map_texts(df, id_col, text_col, list(extra), "lang_pred string, score double", lambda texts: shared.value.score(texts))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out())
    model = train_language_model(docs.filter(~F.col("held_out")))
    return identify_languages(docs.select("doc_id", "text", "held_out"), model, extra=("held_out",))
