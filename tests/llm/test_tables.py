"""Embeddings, archives, components, and the pipeline."""

import collections
import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from glyphkin.llm import embeddings, warc
from glyphkin.llm.common import shared_dir
from glyphkin.llm.components import components
from glyphkin.llm.queries import QUERIES, SQL


def roots(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(parent)}


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 50)], [(random.Random(i).randrange(60), random.Random(i + 99).randrange(60)) for i in range(50)]])
def test_components(spark, edges):
    got = {r.vertex: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in roots(edges).items() if any(a != b and k in (a, b) for a, b in edges)}


# 2: embeddings


def brute_links(rows, threshold=0.93):
    good = collections.defaultdict(list)
    for i, v, label in rows:
        if v is not None and label is not None and all(c is not None and np.isfinite(c) for c in v) and any(v):
            good[label, len(v)].append((i, np.array(np.array(v, np.float32), float)))
    links, edges = collections.Counter(), [(i, i) for i, *_ in rows]
    for g in good.values():
        for k, (i, x) in enumerate(g):
            for j, y in g[k + 1 :]:
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    edges.append((i, j))
    root = roots(edges)
    return sorted((i, links[i], root[i], root[i] == i) for i, *_ in rows)


@pytest.mark.parametrize("block", [8, 4096])
def test_links_against_all_pairs(spark, block):
    rng = np.random.default_rng(block)
    rows = [(i, rng.normal(size=5).tolist(), int(i % 3)) for i in range(120)]
    rows += [(1000 + i, rows[i % 4][1], rows[i % 4][2]) for i in range(30)]
    rows += [(2000 + i, (np.array(rows[i][1]) + rng.normal(size=5) * 0.1).tolist(), rows[i][2]) for i in range(60)]
    rows += [(3000, None, 1), (3001, [0.0] * 5, 1), (3002, [1.0, None, 0.0, 0.0, 0.0], 1), (3003, [float("nan")] * 5, 1), (3004, rows[0][1], None), (3005, [float("inf")] + [0.0] * 4, 1), (3006, [1.0, 2.0], 0), (3007, [2.0, 4.0], 0), (3008, [], 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, vertex string")
    got = embeddings.near_duplicates(df, block=block)
    assert sorted(tuple(r) for r in got.collect()) == brute_links(rows)


def test_links_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embeddings.near_duplicates(df).count() == 0
    lone = spark.createDataFrame([(None, [1.0], 1), (4, [1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert sorted(map(repr, (tuple(r) for r in embeddings.near_duplicates(lone).collect()))) == sorted(map(repr, [(None, 1, None, False), (4, 1, 4, True)]))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**9))
def test_bound_holds(seed):
    """No pair is lost to rounding, and few are computed in vain."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(40, 16)) * 10.0 ** rng.integers(-3, 4, (40, 1))
    y = x[rng.integers(0, 40, 50)] + rng.normal(size=(50, 16)) * 0.3 * np.abs(x).mean()
    cos = (x @ y.T) / np.outer(np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1)))
    tried: list[int] = []
    got = {(int(a), int(b)) for i, j in embeddings.linked_pairs(x, y, 0.93, tried) for a, b in zip(i, j)}
    sure = {tuple(map(int, p)) for p in np.argwhere(cos >= 0.93 + 1e-12)}
    maybe = {tuple(map(int, p)) for p in np.argwhere(cos >= 0.93 - 1e-12)}
    assert sure <= got <= maybe
    assert sum(tried) <= (cos >= 0.93 - 0.08).sum()


# 10: archives


def page_rows():
    big, other = "<p>" + "xé " * 500, "y" * 1000
    rows = [(1, "http://a/1", big), (5, "http://a/5", big), (3, "http://a/\n3", big), (7, None, "short"), (8, "u", "short"), (9, "u", None), (10, "u", ""), (11, "u", other), (12, "u", other[:-1])]
    return rows + [(5, "http://a/5", big), (None, "u", big), (20, "u", "a\r\n\r\nb" * 300)]


def test_archive_round_trip(spark):
    df = spark.createDataFrame([(*r, "z") for r in page_rows()], "page_id long, url string, html string, digest string")
    index = warc.write_archive(warc.with_roles(df, "page_id", "url", "html"), shared_dir(spark), frame_bytes=2000, bundle_bytes=6000)
    assert index.select("bundle").distinct().count() > 1 and index.agg(F.max("frame")).first()[0] >= 1
    back = warc.read_archive(index).collect()
    want = []
    for i, url, text in page_rows():
        data = (text or "").encode()
        same = [j for j, _, t in page_rows() if (t or "") == (text or "") and j is not None]
        refers = max(same) if len(data) >= 1000 and len([1 for _, _, t in page_rows() if t == text]) > 1 and i != max(same) else None
        want.append((i, None if url is None else url.replace("\n", "%0A"), "revisit" if refers is not None else "response", refers, None if refers is not None else data, len(data), hashlib.sha1(data).hexdigest()))
    assert sorted(map(repr, ((r.record_id, r.url, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload), r.payload_bytes, r.payload_digest) for r in back))) == sorted(map(repr, want))


def test_one_record_needs_one_frame(spark):
    df = spark.createDataFrame([(i, "u", f"page {i} " * 50) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    index = warc.write_archive(warc.with_roles(df, "page_id", "url", "html").coalesce(1), shared_dir(spark), frame_bytes=3000)
    r = index.filter("record_id = 23").first()
    reader = warc.BundleReader(r.bundle)
    assert reader.record(r.frame, r["at"], r.length)["payload"].decode() == "page 23 " * 50
    assert len(reader.frames) > 5
    import zstandard
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(r.bundle)
    whole = system.open_input_file(path).read()
    plain = zstandard.ZstdDecompressor().stream_reader(whole, read_across_frames=True).read()
    assert plain.count(b"WARC/1.1\r\n") == 40


def test_archive_of_nothing(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    index = warc.write_archive(warc.with_roles(df, "page_id", "url", "html"), shared_dir(spark))
    assert warc.read_archive(index).count() == 0


# all queries, and the pipeline


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings", "labels", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = QUERIES[name](spark, sf)
    want = c.sql(SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(x) for x in cols]
    assert sorted((tuple(r[x] for x in cols) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, tmp_path):
    """Each stage alone on documents with nulls, copies, near copies, shared passages and a benchmark item."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9)))
    passage, item = " ".join(word() for _ in range(40)), " ".join(word() for _ in range(20))
    body = [" ".join(word() for _ in range(80)) for _ in range(8)]
    texts = [*body, body[0], body[1].replace(body[1].split()[40], "changed"), f"{body[2][:200]} {passage}", f"{passage} {body[3][:200]}", f"{body[4][:90]} {item.upper()} {body[5][:90]}", None, "", body[0]]
    docs = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    sf = f"file://{tmp_path}"
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{sf}/labels.parquet")
    start = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5

    kept = stages["toxicity"](spark, start, sf)
    assert kept.columns == corpus_pipeline.COLUMNS and kept.count() == len(docs)
    one = stages["ngram_join"](spark, kept, sf)
    assert one.columns == corpus_pipeline.COLUMNS
    assert sorted(r.doc_id for r in one.collect()) == [0, 1, 2, 3, 4, 5, 6, 7, 10, 11, 12, 13, 14]
    cut = {r.doc_id: r for r in stages["substring_dedup"](spark, one, sf).collect()}
    assert passage not in cut[10].text and passage not in cut[11].text and cut[13].text is None and cut[14].text == ""
    assert cut[6].text == texts[6] and all(r.text is None or r.n_chars == len(r.text) for r in cut.values())
    clean = stages["decontaminate"](spark, one, sf)
    assert sorted(r.doc_id for r in clean.collect()) == [0, 1, 2, 3, 4, 5, 6, 7, 10, 11, 13, 14]
    last = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(last) == {0, 1, 2, 3, 4, 5, 6, 7, 10, 11, 13, 14} and last[13].n_tokens == 0 and all(r.n_tokens == len(r["ids"]) for r in last.values())


def test_repeated_rows_keep_their_text(spark):
    """Of rows that repeat, with one id or none, one stays, and the next stage leaves its text whole."""
    rng = random.Random(8)
    a, b, c, d, e = (" ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(60)) for _ in range(5))
    near = lambda t: f"{t} more"
    rows = [(1, a), (1, a), (2, b), (2, c), (2, c), (3, near(b)), (None, a), (None, near(a)), (None, d), (None, d), (None, near(d)), (4, e), (None, None), (None, None), (None, ""), (None, ""), (5, ""), (6, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], COLUMNS)
    stages = dict(corpus_pipeline.STAGES)
    one = stages["ngram_join"](spark, docs, "")
    got = [(r.doc_id, r.text) for r in one.collect()]
    unnamed = [t for i, t in got if i is None and t]
    assert unnamed in ([d], [near(d)])
    want = sorted([(1, a), (2, b), (2, c), (4, e), (None, None), (None, None), (None, ""), (None, ""), (5, ""), (6, None), (None, unnamed[0])], key=repr)
    assert sorted(got, key=repr) == want
    cut = stages["substring_dedup"](spark, one, "")
    assert sorted(((r.doc_id, r.text) for r in cut.collect()), key=repr) == want


def test_last_stage_gives_the_text_back(spark):
    rows = [(1, "Ünïcode, 12 words\nand  spaces", "en", "s", 29), (2, None, "en", "s", None), (3, "", "en", "s", 0)]
    out = dict(corpus_pipeline.STAGES)["bpe"](spark, spark.createDataFrame(rows, COLUMNS), "")
    assert {r.doc_id: r.decoded for r in out.collect()} == {1: rows[0][1], 2: "", 3: ""}


def test_pipeline_of_nothing(spark, tmp_path):
    sf = f"file://{tmp_path}"
    for name, schema in (("documents", COLUMNS), ("benchmark", "item_id long, text string"), ("labels", "doc_id long, toxic int")):
        spark.createDataFrame([], schema).write.parquet(f"{sf}/{name}.parquet")
    assert corpus_pipeline.run(spark, sf).count() == 0
