"""Operator 8: toxicity by a convolutional text classifier trained in numpy.

A text's lower-cased words (letters, digits and every non-ASCII byte) are looked up in hashed embedding tables, one
for whole words, one each for their first four and seven bytes, and added; filters of widths 1, 2 and 3 run over the
sequence, each keeps its largest answer over the whole text, and a logistic unit weighs these. Training (Adam,
dropout on filters) reads at most `per_class` labelled texts of each class, chosen by a hash of the id, whole.

A fifth of the sample calibrates one threshold a language, about that of the best F1; scores are then bent so that it
lies at `operating_point` for every language. The language is that of a naive Bayes model (langid) on the text itself,
never that of a column; languages with few labelled texts, and texts without any, take the threshold of all texts.
Texts of which the whole sample could exceed SAMPLE_BYTES are not learned from (22 KB at 2500 a class). Null and empty texts score what a text without words scores. With labels of one class or none, every
score is that class's share (0 without labels). Rows are scored alone; repeated rows need no rule, and if one id
has several labels the largest counts. Other columns are not read.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Words, held_out, table
from .langid import PER_LANG, NaiveBayes, bound_for, map_texts, place_of, split_by_size, train_language_model

PER_CLASS = 2500
WIDTHS = (1, 2, 3)
OPERATING_POINT = 0.3
BLOCK_WORDS = 1 << 16
#: What is looked up of a word; the embeddings are added.
PARTS = ("word", "prefix", "stem")
#: Share of words that training shows by their first bytes only, so that unseen words of a kind are recognised.
HIDDEN_WORDS = 0.6
#: The same of their first four bytes only.
HIDDEN_STEMS = 0.3
#: Bytes of a word's beginnings that have embeddings of their own.
PREFIX, STEM = 4, 7

_INSIDE = np.zeros(256, bool)
_INSIDE[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = True
_INSIDE[128:] = True

#: Bytes that the sample of texts may have.
SAMPLE_BYTES = 1 << 27


class Tokens:
    """Row numbers in the two embedding tables for every word of several texts."""

    def __init__(self, texts: list[str], rows: int, prefix_rows: int) -> None:
        words = Words([t.lower() for t in texts], _INSIDE)
        self.first = words.first
        self.word = 1 + (words.hashes % np.uint64(rows - 1)).astype(np.int32)
        self.prefix, self.stem = self._heads(words, PREFIX) % prefix_rows, 1 + self._heads(words, STEM) % (prefix_rows - 1)

    @staticmethod
    def _heads(words: Words, n: int) -> np.ndarray:
        """A hash of the first n bytes of each word."""
        head = np.zeros(len(words), np.uint32)
        size = words.ends - words.starts
        for k in range(n):
            at = np.minimum(words.starts + k, len(words.buf) - 1)
            head = head * np.uint32(0x01000193) + np.where(size > k, words.buf[at], 0).astype(np.uint32)
        head ^= head >> np.uint32(15)
        return (head * np.uint32(0x9E3779B1) >> np.uint32(8)).astype(np.int32)


class ToxicityModel:
    """languages: tells the language of a text for its threshold; without it all texts have one."""

    def __init__(self, rows: int = 1 << 15, prefix_rows: int = 1 << 13, dims: int = 8, filters: int = 16, seed: int = 7, languages: NaiveBayes | None = None) -> None:
        rng = np.random.default_rng(seed)
        self.rows, self.prefix_rows, self.filters = rows, prefix_rows, filters
        self.p = {
            # words and stems that training never met say nothing
            "word": np.zeros((rows, dims), np.float32),
            "prefix": rng.normal(0, 0.3, (prefix_rows, dims)).astype(np.float32),
            "stem": np.zeros((prefix_rows, dims), np.float32),
            "bias": np.zeros(len(WIDTHS) * filters, np.float32),
            "out": rng.normal(0, 0.3, len(WIDTHS) * filters).astype(np.float32),
            "out_bias": np.full(1, -1, np.float32),
        }
        for w in WIDTHS:
            self.p[f"conv{w}"] = rng.normal(0, 0.5 / np.sqrt(w), (w, dims, filters)).astype(np.float32)
        # row 0 of both is that of what training hides
        self.languages, self.overall = languages, OPERATING_POINT
        self.thresholds: dict[str, float] = {}
        self.constant: float | None = None

    def tokens(self, texts: list[str]) -> Tokens:
        return Tokens(texts, self.rows, self.prefix_rows)

    def pooled(self, t: Tokens, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """The largest answer of each filter over each text (0 for none), and the word where it begins.

        Answers are made BLOCK_WORDS words at a time, so long texts need no more memory than short ones.
        """
        n = len(t.first) - 1
        out = np.full((n, len(WIDTHS) * self.filters), -np.inf, np.float32)
        at = np.full(out.shape, -1, np.int64) if where else None
        self._tables()
        for i, w in enumerate(WIDTHS):
            columns = slice(i * self.filters, (i + 1) * self.filters)
            # a window that goes on into the next text is left out
            starts, ends = t.first[:-1], np.maximum(t.first[1:] - w + 1, t.first[:-1])
            for a in range(0, len(t.word) - w + 1, BLOCK_WORDS):
                b = min(len(t.word) - w + 1, a + BLOCK_WORDS)
                low, high = np.clip(starts, a, b) - a, np.clip(ends, a, b) - a
                some = np.flatnonzero(high > low)
                if not len(some):
                    continue
                answer = np.zeros((b - a, self.filters), np.float32)
                for k in range(w):
                    for name in PARTS:
                        answer += self.answers[name, w, k][getattr(t, name)[a + k : b + k]]
                edges = np.stack([low[some], high[some]], 1).ravel()
                cut = edges[:-1] if edges[-1] >= len(answer) else edges
                best = np.maximum.reduceat(answer, cut, axis=0)[::2]
                if at is not None:
                    for d, top, (x, y) in zip(some, best, edges.reshape(-1, 2)):
                        first = a + x + answer[x:y].argmax(0)
                        at[d, columns] = np.where(top > out[d, columns], first, at[d, columns])
                out[some, columns] = np.maximum(out[some, columns], best)
        return np.maximum(np.where(np.isneginf(out), 0, out + self.p["bias"]), 0), at

    def _tables(self) -> None:
        """Every row's answer to every filter, so that a word costs look-ups only."""
        if getattr(self, "fresh", False):
            return
        self.answers = {(name, w, k): self.p[name] @ self.p[f"conv{w}"][k] for name in PARTS for w in WIDTHS for k in range(w)}
        self.fresh = True

    def raw(self, t: Tokens) -> np.ndarray:
        hidden, _ = self.pooled(t)
        return 1 / (1 + np.exp(-(hidden @ self.p["out"] + self.p["out_bias"]).astype(np.float64)))

    def score(self, texts: list[str]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        t = self.tokens(texts)
        raw, cut = self.raw(t), np.full(len(texts), self.overall)
        if self.thresholds:
            cut = np.array([self.thresholds.get(x, self.overall) for x in self.languages.score(texts)[0]])
        bent = np.where(raw < cut, raw / cut * OPERATING_POINT, OPERATING_POINT + (raw - cut) / (1 - cut) * (1 - OPERATING_POINT))
        return np.clip(bent, 0, 1)

    def train(self, texts: list[str], labels: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.01, decay: float = 1e-3, seed: int = 11) -> ToxicityModel:
        """Adam on cross entropy; only the word windows that won a pooling get a gradient."""
        if len(set(labels.tolist())) < 2:
            self.constant = float(labels.mean()) if len(labels) else 0.0
            return self
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(texts))
        held, order = order[: len(order) // 5], order[len(order) // 5 :]
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(order)
            for i in range(0, len(order), batch):
                part = order[i : i + batch]
                tokens = self.tokens([texts[j] for j in part])
                hide = rng.random(len(tokens.word))
                tokens.word[hide < HIDDEN_WORDS] = 0
                tokens.stem[hide < HIDDEN_STEMS] = 0
                grads = self._gradients(tokens, labels[part], rng)
                grads["word"][0] = grads["stem"][0] = 0
                step += 1
                lr = rate * (1 - 0.7 * epoch / epochs)
                for k, g in grads.items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    self.p[k] -= lr * (first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8) + decay * self.p[k])
                self.fresh = False
        self._calibrate([texts[j] for j in held], labels[held])
        return self

    def _gradients(self, t: Tokens, labels: np.ndarray, rng: np.random.Generator) -> dict[str, np.ndarray]:
        hidden, at = self.pooled(t, where=True)
        keep = (rng.random(hidden.shape) < 0.8) / np.float32(0.8)
        used = hidden * keep
        error = (1 / (1 + np.exp(-(used @ self.p["out"] + self.p["out_bias"]))) - labels) / len(labels)
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        grads["out"] += (used.T @ error).astype(np.float32)
        grads["out_bias"] += np.float32(error.sum())
        back = (error[:, None] * self.p["out"] * keep * (hidden > 0)).astype(np.float32)
        grads["bias"] += back.sum(0)
        for i, w in enumerate(WIDTHS):
            for f in range(self.filters):
                c = i * self.filters + f
                d = np.flatnonzero((back[:, c] != 0) & (at[:, c] >= 0))
                for k in range(w):
                    rows = {name: getattr(t, name)[at[d, c] + k] for name in PARTS}
                    filt = self.p[f"conv{w}"][k, :, f]
                    pull = back[d, c][:, None]
                    grads[f"conv{w}"][k, :, f] += (pull * sum(self.p[name][r] for name, r in rows.items())).sum(0)
                    for name, r in rows.items():
                        np.add.at(grads[name], r, pull * filt)
        return grads

    def _calibrate(self, texts: list[str], labels: np.ndarray) -> None:
        """For each language a threshold between that of the best F1 and the lowest whose F1 is within a hundredth of
        it, halfway in log odds; that of all texts where a language has few."""
        parts = [self.raw(self.tokens(p)) for p in split_by_size(texts)]
        if not parts:
            return
        raw = np.concatenate(parts)
        lang = np.array(self.languages.score(texts)[0] if self.languages else ["und"] * len(texts))

        def best(mask):
            order = np.argsort(-raw[mask], kind="stable")
            s, y = raw[mask][order], labels[mask][order]
            hits = np.cumsum(y)
            f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
            last = np.append(s[:-1] != s[1:], True)
            good = np.flatnonzero(last & (f1 >= 0.99 * f1[last].max()))
            cuts = [np.clip((s[k] + (s[k + 1] if k + 1 < len(s) else 0)) / 2, 0.02, 0.98) for k in (int(np.argmax(np.where(last, f1, -1))), int(good[-1]))]
            odds = np.prod([c / (1 - c) for c in cuts]) ** 0.5
            return float(odds / (1 + odds))

        self.overall = best(np.ones(len(raw), bool)) if labels.any() else OPERATING_POINT
        for x in sorted(set(lang.tolist()) - {"und"}):
            mask = lang == x
            if labels[mask].sum() >= 30 and (1 - labels[mask]).sum() >= 30:
                self.thresholds[x] = best(mask)

    def __getstate__(self) -> dict:
        # every process makes the answers from the embeddings, a fifth of their size
        return {k: v for k, v in self.__dict__.items() if k not in ("answers", "fresh")}


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_class: int, most_bytes: int = SAMPLE_BYTES) -> list[tuple[int, list[str]]]:
    """(label, texts): at most per_class texts of each class, by the smallest hashes of their ids.

    Ids are drawn from the labels alone; some thousand of them are broadcast, and the texts of these come in one pass
    over the documents that moves no others. An id with several texts counts with the smallest.
    """
    labels = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("__label")).select(F.col(id_col).alias("__id"), "__label")
    sizes = {r[0]: r[1] for r in labels.groupBy("__label").count().collect()}
    some = [(F.col("__label") == k) & (place_of("__id") < bound_for(per_class, n)) for k, n in sizes.items()]
    if not some:
        return []
    # at most two classes and about a fifth more than per_class rows of each
    wanted = labels.filter(functools.reduce(lambda a, b: a | b, some))
    least = most_bytes // (2 * per_class * 6 // 5)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).filter(F.octet_length("__text") <= least)
    rows = rows.join(F.broadcast(wanted), "__id").groupBy("__id").agg(F.min("__text").alias("__text"), F.first("__label").alias("__label"))
    out: dict[int, list[tuple]] = {}
    for r in rows.select("__label", place_of("__id"), "__id", "__text").collect():
        out.setdefault(r[0], []).append(tuple(r)[1:])
    return sorted((k, [t for *_, t in sorted(v)[:per_class]]) for k, v in out.items())


def train_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS, lang_col: str | None = None) -> ToxicityModel:
    """Learns from the labelled rows of docs, at most per_class of each class.

    lang_col: the languages of docs, from which a language model for the thresholds is learned; None: one threshold.
    """
    samples = labelled_sample(docs, labels, id_col, text_col, label_col, per_class)
    languages = train_language_model(docs, id_col, text_col, lang_col, PER_LANG // 4) if lang_col and samples else None
    texts = [t for _, part in samples for t in part]
    return ToxicityModel(languages=languages).train(texts, np.array([k for k, part in samples for _ in part], np.float32))


def score_toxicity(df: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """(id, extra..., score, predicted) for each row."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def score(texts):
        s = shared.value.score(texts)
        return s.tolist(), (s >= OPERATING_POINT).astype(np.int32).tolist()

    return map_texts(df, id_col, text_col, list(extra), "score double, predicted int", score)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned from labelled rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out())
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~held_out())
    model = train_toxicity(docs.filter(~F.col("held_out")), labels, lang_col="lang")
    return score_toxicity(docs.select("doc_id", "text", "held_out"), model, extra=("held_out",))
