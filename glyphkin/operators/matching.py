"""Joins on names and words: catalogue against files, documents against metadata, words against a lexicon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import signature_pattern


#: Length of the pieces by which strings that hold one another are joined.
GRAM = 6


def _grams(text: Column, size: Column) -> Column:
    """The distinct pieces of that length of a text, none if it is shorter."""
    starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, size)))


def candidates_by_gram(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """(needle, text) for every text that holds the rarest gram of all pieces of a needle; the caller verifies.

    needles: (needle, pieces), pieces literal strings that a text must hold; texts: (text). Both distinct. A gram has
    GRAM characters, or is a whole shorter piece. Empty pieces say nothing; a needle without others meets every text.
    """
    sizes = F.transform(F.sequence(F.lit(1), F.lit(GRAM)), lambda k: _grams(F.col("text"), k))
    held = texts.select("text", F.explode(F.concat(F.flatten(sizes), F.array(F.lit("")))).alias("gram"))
    count = held.groupBy("gram").agg(F.count("*").alias("n"))
    own = F.flatten(F.transform("pieces", lambda p: _grams(p, F.least(F.length(p), F.lit(GRAM)))))
    some = F.filter("pieces", lambda p: p != "")
    asked = needles.select("needle", "pieces").withColumn("pieces", some)
    asked = asked.select("needle", F.explode(F.when(F.size("pieces") > 0, own).otherwise(F.array(F.lit("")))).alias("gram"))
    rare = asked.join(count, "gram").groupBy("needle").agg(F.min(F.struct("n", "gram")).alias("m")).select("needle", F.col("m.gram").alias("gram"))
    return rare.join(held, "gram").select("needle", "text")


def files_of_signatures(catalogue: DataFrame, files: DataFrame) -> DataFrame:
    """(Signature, file): files whose name ends as the signature says, null where there is none.

    Signatures without wildcards are joined on the ends of file names, of every length; those with wildcards on the
    rarest piece of what they say literally, and the pattern is verified.
    """
    plain = ~F.col("Signature").rlike(r"[*?\[]")
    suffix = F.concat(F.replace("Signature", F.lit("/"), F.lit("-")), F.lit(".pdf"))
    rows = catalogue.select("Signature", suffix.alias("suffix"), plain.alias("plain")).distinct()
    names = files.select("file").filter(F.length("file") > 0).distinct()
    ends = names.select("file", F.explode(F.transform(F.sequence(F.lit(1), F.length("file")), lambda i: F.substring("file", i, F.length("file")))).alias("suffix"))
    exact = rows.filter("plain").join(ends, "suffix").select("Signature", "file")
    wild = rows.filter("not plain").select("Signature", F.col("suffix").alias("needle"), F.split("suffix", "[*?]").alias("pieces"))
    near = candidates_by_gram(wild.select("needle", "pieces"), names.withColumnRenamed("file", "text"))
    near = wild.join(near, "needle").withColumn("pattern", signature_pattern(F.col("Signature"))).filter(F.expr("text like pattern"))
    found = exact.unionByName(near.select("Signature", F.col("text").alias("file")).distinct())
    return catalogue.select("Signature").distinct().join(found, "Signature", "left")


def with_metadata(documents: DataFrame, metadata: DataFrame) -> DataFrame:
    """(doc, printer, remark, index): by file name, else the first row whose name holds the document's or is held by it.

    metadata: (row, FileName, Printer, Remarks, Index), `row` its order in the file. Unmatched: unknown, nan, -1.
    Documents without an exact match are joined with names on the rarest piece of the shorter of both.
    """
    pick = F.min(F.struct("row", F.col("Printer").alias("printer"), F.col("Remarks").alias("remark"), F.col("Index").alias("index"))).alias("m")
    names = metadata.groupBy("FileName").agg(pick).filter(F.col("FileName").isNotNull())
    docs = documents.select("doc").distinct()
    exact = docs.join(names, F.col("doc") == F.col("FileName")).select("doc", "m")
    rest = docs.join(exact.select("doc"), "doc", "left_anti").filter(F.col("doc").isNotNull())
    # (name, holding): pairs of strings of which the second may hold the first
    as_needle = lambda df, c: df.select(F.col(c).alias("needle"), F.array(c).alias("pieces"))
    inner = candidates_by_gram(as_needle(rest, "doc"), names.select(F.col("FileName").alias("text"))).filter(F.contains("text", "needle"))
    outer = candidates_by_gram(as_needle(names, "FileName"), rest.select(F.col("doc").alias("text"))).filter(F.contains("text", "needle"))
    pairs = inner.select(F.col("needle").alias("doc"), F.col("text").alias("FileName")).unionByName(outer.select(F.col("text").alias("doc"), F.col("needle").alias("FileName")))
    part = pairs.join(names, "FileName").groupBy("doc").agg(F.min("m").alias("m"))
    found = exact.unionByName(part).select("doc", "m.*")
    out = docs.join(found, "doc", "left")
    return out.select("doc", F.coalesce("printer", F.lit("unknown")).alias("printer"), F.coalesce("remark", F.lit("nan")).alias("remark"), F.coalesce("index", F.lit(-1)).alias("index"))


def lexicon_matches(words: DataFrame, lexicon: DataFrame, most: int = 1) -> DataFrame:
    """(word, entry, distance): the nearest lexicon entry within `most` edits, the first in order on ties.

    Two strings within k edits, one of them cut into k + 1 pieces, share a piece at a place that moved by at most k.
    So both sides are joined on the pieces of the word, never on length alone.
    """
    upper = words.select("word").distinct().withColumn("u", F.upper("word"))
    size = F.length("u")
    cuts = F.transform(F.sequence(F.lit(0), F.lit(most)), lambda i: F.struct(i.alias("i"), F.floor(size * i / (most + 1)).cast("int").alias("at"), F.floor(size * (i + 1) / (most + 1)).cast("int").alias("to")))
    pieces = upper.withColumn("c", F.explode(cuts)).select("word", "u", F.col("c.at").alias("at"), F.expr("substring(u, c.at + 1, c.to - c.at)").alias("piece"), size.alias("n"))
    entries = lexicon.select(F.upper("entry").alias("e")).distinct()
    # an entry offers, at each place, the pieces that words within reach would cut there
    lengths = F.sequence(F.greatest(F.length("e") - most, F.lit(0)), F.length("e") + most)
    offers = entries.withColumn("n", F.explode(lengths)).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(most)))).withColumn("move", F.explode(F.sequence(F.lit(-most), F.lit(most))))
    at, to = F.floor(F.col("n") * F.col("i") / (most + 1)).cast("int"), F.floor(F.col("n") * (F.col("i") + 1) / (most + 1)).cast("int")
    offers = offers.select("e", "n", at.alias("at"), "move", (to - at).alias("size")).filter((F.col("at") + F.col("move") >= 0) & (F.col("at") + F.col("move") + F.col("size") <= F.length("e")))
    offers = offers.select("e", "n", "at", F.expr("substring(e, at + move + 1, size)").alias("piece")).distinct()
    rows = pieces.join(offers, ["n", "at", "piece"]).withColumn("distance", F.levenshtein("u", "e", most)).filter("distance >= 0")
    return rows.groupBy("word").agg(F.min(F.struct("distance", "e")).alias("m")).select("word", F.col("m.e").alias("entry"), F.col("m.distance").alias("distance"))


def filter_words(words: DataFrame, matches: DataFrame, least: int = 3, sure: float = 0.98, likely: float = 0.80, other: float = 0.90) -> DataFrame:
    """(…, text, edits): short words go; alphabetic ones stay when sure, take a lexicon entry when likely, else go;
    others stay from `other` on. words: (text, text_score); matches: of lexicon_matches on text."""
    rows = words.filter(F.length("text") >= least).join(matches.withColumnRenamed("word", "text"), "text", "left")
    alpha = F.col("text").rlike(r"^\p{L}+$")
    keep = F.when(alpha, (F.col("text_score") >= sure) | ((F.col("text_score") >= likely) & F.col("entry").isNotNull())).otherwise(F.col("text_score") >= other)
    fixed = alpha & (F.col("text_score") < sure)
    rows = rows.filter(keep).withColumn("edits", F.when(fixed, F.col("distance")).otherwise(F.lit(0)))
    return rows.withColumn("text", F.when(fixed, F.col("entry")).otherwise(F.col("text"))).drop("entry", "distance")


def word_score(box_score: Column, text_score: Column, length: Column, edits: Column) -> Column:
    """The score by which words compete: detection plus text, less for each corrected letter."""
    return box_score + text_score - text_score / length * edits


def common_documents(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("doc").distinct().join(b.select("doc").distinct(), "doc")
