"""Writers. Tables are Parquet partitioned by what later steps read them by; steps may be repeated at will."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.images import png_bytes
from ..schemas import DPI_COLUMNS


def write_table(rows: DataFrame, path: str, by: tuple[str, ...] = ("doc",), mode: str = "overwrite") -> None:
    """Only the partitions that rows hold are replaced."""
    rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def exists(rows: DataFrame, path: str) -> bool:
    jvm = rows.sparkSession._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(rows.sparkSession._jsc.hadoopConfiguration()).exists(p)


def pending(rows: DataFrame, path: str, key: list[str]) -> DataFrame:
    """The rows whose key is not in the table at path yet."""
    if not exists(rows, path):
        return rows
    done = rows.sparkSession.read.parquet(path).select(*key).distinct()
    return rows.join(done, key, "left_anti")


def write_pending(rows: DataFrame, path: str, key: list[str], by: tuple[str, ...] = ()) -> None:
    """Appends the rows whose key is not there; a second call with the same rows appends nothing."""
    todo = pending(rows, path, key)
    writer = todo.write.mode("append")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def _named(c: str) -> Column:
    """A value as part of a path, from which `_value` gives it back; empty as null, as in Spark's own partitions."""
    return F.concat(F.lit(f"{c}="), F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", F.lit(NOTHING)).otherwise(F.url_encode(F.col(c).cast("string"))))


def _value(c: str, pattern: str) -> Column:
    part = F.regexp_extract("path", pattern, 1)
    return F.when(part != NOTHING, F.url_decode(part)).alias(c)


#: Stands for null in a path, and tasks that files are dealt to for each core: a small file takes long for its bytes.
NOTHING, DEALT = "__HIVE_DEFAULT_PARTITION__", 4


def write_words_json(words: DataFrame, path: str) -> None:
    """A JSON array of words for each page, a file a page below a folder a doc; what was at path before is removed."""
    spark = words.sparkSession
    fields = [c for c in words.columns if c not in ("doc", "page", "word_idx")]
    one = words.groupBy("doc", "page").agg(F.array_sort(F.collect_list(F.struct("word_idx", *fields))).alias("w"))
    cells = F.transform("w", lambda x: F.struct(*(x[c].alias(c) for c in fields)))
    value = F.to_json(cells).cast("binary").alias("value")
    named = one.select(F.concat(_named("doc"), F.lit("/"), _named("page"), F.lit(".json")).alias("name"), value)
    if exists(words, path):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    # by tasks that write files of their own: Spark's writer commits a folder a page one after the other on the driver
    write_files(named.repartition(DEALT * spark.sparkContext.defaultParallelism), path, "name", "value").count()


def read_words_json(spark, path: str, fields: str) -> DataFrame:
    """What write_words_json wrote: (doc, page, word_idx, fields). Tasks list the folders of docs and read the files."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(path)
    n = DEALT * spark.sparkContext.defaultParallelism
    folders = [(f.path,) for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.type == fs.FileType.Directory]

    def listed(batches):
        system, _ = fs.FileSystem.from_uri(path)
        for pdf in batches:
            for folder in pdf["path"]:
                found = [f.path for f in system.get_file_info(fs.FileSelector(folder)) if f.path.endswith(".json")]
                for i in range(0, len(found), 10_000):
                    yield pd.DataFrame({"path": found[i : i + 10_000]})

    def read(batches):
        system, _ = fs.FileSystem.from_uri(path)
        for pdf in batches:
            # a bounded number of whole pages at a time
            for i in range(0, len(pdf), 256):
                some = pdf["path"].iloc[i : i + 256]
                values = []
                for p in some:
                    with system.open_input_stream(p, compression=None) as f:
                        values.append(f.read())
                yield pd.DataFrame({"path": some.to_numpy(), "value": values})

    files = spark.createDataFrame(folders, "path string").repartition(max(1, min(len(folders), n))).mapInPandas(listed, "path string")
    rows = files.repartition(n).mapInPandas(read, "path string, value binary")
    rows = rows.select(_value("doc", "/doc=([^/]*)/page=[^/]*[.]json$"), _value("page", "/page=([^/]*)[.]json$"), F.from_json(F.col("value").cast("string"), f"array<struct<{fields}>>").alias("w"))
    return rows.select("doc", "page", F.posexplode("w").alias("word_idx", "x")).select("doc", "page", "word_idx", "x.*")


def write_dpi(rows: DataFrame, path: str, per_source: bool = False) -> None:
    """The resolution table with its columns in order; in one folder, or one below it for each source."""
    out = rows.select(*(F.col(f"`{c}`") for c in DPI_COLUMNS))
    if per_source:
        out.withColumn("source", F.col("suelta")).write.mode("overwrite").option("header", "true").partitionBy("source").csv(path)
    else:
        out.write.mode("overwrite").option("header", "true").csv(path)


def write_word_lines(words: DataFrame, path: str) -> None:
    """Coordinates and text of each word, separated by commas."""
    line = F.concat_ws(",", F.array_join(F.col("polygon").cast("array<string>"), ","), "text")
    words.select("doc", "page", line.alias("value")).write.mode("overwrite").partitionBy("doc", "page").text(path)


def png_column(rows: DataFrame, dpi: float | None = None) -> DataFrame:
    """With `png`, the bytes of an 8-bit grey PNG file of (height, width, pixels)."""

    @F.pandas_udf("binary")
    def encode(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for h, w, data in batches:
            yield pd.Series([png_bytes(np.frombuffer(d, np.uint8).reshape(a, b), dpi) for a, b, d in zip(h, w, data)])

    return rows.withColumn("png", encode("height", "width", "pixels"))


def npz_column(rows: DataFrame) -> DataFrame:
    """(doc, page, name, npz): one compressed array file a page from (doc, page, word_idx, char_idx, label, img)."""

    def run(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        import io

        pdf = pdf.sort_values("char_idx")
        out = io.BytesIO()
        np.savez_compressed(out, char_imgs=np.stack(pdf["img"].to_numpy()).astype(np.float32), char_labels=pdf["label"].to_numpy().astype(str), char_word_idx=pdf["word_idx"].to_numpy().astype(np.int32))
        return pd.DataFrame({"doc": [keys[0]], "page": [keys[1]], "name": [f"{keys[0]}/{keys[1]}_data.npz"], "npz": [out.getvalue()]})

    return rows.groupBy("doc", "page").applyInPandas(run, "doc string, page string, name string, npz binary")


FILES = "path string, bytes long"


def write_files(rows: DataFrame, folder: str, name: str = "name", data: str = "png") -> DataFrame:
    """Writes one file a row below a folder that all machines share, and returns (path, bytes); lazily, once consumed.

    A file is written under a name of its own and renamed, so a repeated task leaves one whole file.
    """

    def run(batches):
        import uuid

        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        made = set()
        for pdf in batches:
            done = []
            for n, d in zip(pdf[name], pdf[data]):
                path = f"{root}/{n}"
                if (above := path.rsplit("/", 1)[0]) not in made:
                    system.create_dir(above, recursive=True)
                    made.add(above)
                part = f"{path}.{uuid.uuid4().hex}.part"
                with system.open_output_stream(part, compression=None) as f:
                    f.write(d)
                system.move(part, path)
                done.append((f"{folder}/{n}", len(d)))
            yield pd.DataFrame(done, columns=["path", "bytes"])

    return rows.select(name, data).mapInPandas(run, FILES)


def copy_files(files: DataFrame, folder: str, skip_existing: bool = False) -> DataFrame:
    """Copies files (column `file`, URIs) into a folder on executors; (path, bytes) of those copied."""

    def run(batches):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        for pdf in batches:
            done = []
            for uri in pdf["file"]:
                source, path = fs.FileSystem.from_uri(uri)
                target = f"{root}/{path.rsplit('/', 1)[-1]}"
                if skip_existing and system.get_file_info(target).type != fs.FileType.NotFound:
                    continue
                fs.copy_files(path, target, source_filesystem=source, destination_filesystem=system)
                done.append((f"{folder}/{target.rsplit('/', 1)[-1]}", system.get_file_info(target).size))
            yield pd.DataFrame(done, columns=["path", "bytes"])

    return files.select("file").distinct().mapInPandas(run, FILES)
