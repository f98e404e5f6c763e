"""The whole analysis of a corpus, step by step, each step a table below one folder.

Steps: 2 pages to word directions and glyphs, 3 italics, 4 clusters, 5 distances, 6 scores. A step whose table is
there is not repeated if skip_existing; a step that needs a table that is not there raises.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import Config
from ..operators import clusters as stats, distances as dist, glyphs, italic, scoring
from ..operators.distances import registered_to_mean
from ..sources.sinks import exists, write_table


class Corpus:
    """Tables below a folder: `pages` is the input (see glyphs.process_pages), the others are made."""

    def __init__(self, spark: SparkSession, root: str, config: Config = Config(), shape: tuple[int, int] = (40, 32), **options) -> None:
        self.spark, self.root, self.config, self.shape, self.options = spark, root.rstrip("/"), config, shape, options

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def glyphs(self) -> DataFrame:
        return glyphs.process_pages(self.table("pages"), **self.options.get("pages", {}))

    def italics(self) -> DataFrame:
        """Characters with their flag, numbered within a document."""
        rows = self.table("glyphs")
        words = self.table("pages").select("doc", "page", F.explode("words").alias("w"))
        text = words.select("doc", "page", "w.word_idx", F.array_join("w.chars.label", "").alias("text"))
        measured = rows.filter("kind = 'word'").select("doc", "page", "word_idx", "t", "b", "l", "r", "stroke").join(text, ["doc", "page", "word_idx"], "left")
        flags = italic.italic_words(italic.effective_strokes(measured, italic.thresholds(measured)))
        chars = rows.filter("kind = 'char'").select("doc", "page", "word_idx", "char_idx", "label", "img")
        key = F.xxhash64("page", "word_idx", "char_idx")
        return italic.italic_chars(chars, flags).withColumn("char_id", key)

    def clusters(self) -> DataFrame:
        chars = self.table("italics").filter(stats.informative(F.col("img")))
        first = glyphs.initial_clusters(chars, **self.options.get("initial", {}))
        refined = glyphs.refined_clusters(first.join(chars.select("doc", "char_id", "img"), ["doc", "char_id"]), self.shape, **self.options.get("refined", {}))
        made = stats.cluster_table(chars.join(refined, ["doc", "char_id"]))
        return made.select("doc", F.col("cluster").cast("long").alias("cluster_id"), F.col("label").alias("letter"), "share", "n", "italic", F.col("mean").alias("v"))

    def distances(self) -> DataFrame:
        move = lambda c: registered_to_mean(c, self.config.transform, self.shape)
        return dist.compute_distances(self.table("clusters"), self.config, move)

    def scores(self) -> DataFrame:
        rows = self.table("distances")
        n = self.table("clusters").select("doc").distinct().count()
        reference = self.spark.read.parquet(f"{self.config.reference_corpus}/distances") if self.config.reference_corpus else None
        return scoring.score_documents(rows, n, self.config.alphas, self.config.epsilon, reference)

    STEPS = {2: "glyphs", 3: "italics", 4: "clusters", 5: "distances", 6: "scores"}
    BY = {"distances": ("style",), "scores": ("style",)}

    def run(self, steps: tuple[int, ...] = (2, 3, 4, 5, 6), skip_existing: bool = False) -> dict[str, str]:
        """Status of each step: done, or skipped."""
        out = {}
        for k in sorted(steps):
            name = self.STEPS[k]
            step: Callable[[], DataFrame] = getattr(self, name)
            if skip_existing and exists(self.spark.range(0), self.path(name)):
                out[name] = "skipped"
                continue
            write_table(step(), self.path(name), self.BY.get(name, ("doc",)))
            out[name] = "done"
        return out
