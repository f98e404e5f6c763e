"""Operator 7: n-gram Jaccard join through a prefix tree.

A document's set holds the hashes of its distinct word n-grams (A-Z in lower case). Equal texts are one class.
Three steps find every linked pair of classes up to connection:

1. How many classes hold each n-gram, counted over packed keys in hash buckets, gives the global order: rarest
   first. Two sets that link share an n-gram among the first n - ceil(t n) + 1 of either; n-grams of one class only
   are in no other prefix and never leave their chunk. A class whose prefix holds none that is shared is done.
2. Ordered sets that link also have many neighbours in common: with c n-grams in common, each of the others parts
   at most one of the c + 1 pairs of neighbours (both ends count as n-grams), so 3 c + 1 less both sizes are left.
   Pairs of neighbours are ordered as the sets are, and only classes that share one in the prefix that this bound
   gives may link: single n-grams recur in any large corpus, neighbours in order hardly do. Among the classes that
   share a pair only those stay together whose sizes, less the n-grams of one class only, allow a link. What is left
   is joined into candidate groups (connected components).
3. In a group, sets are stored in a path-compressed trie, most frequent n-gram first. A set walks the trie once:
   what it has in common with a path is counted once for all sets below, and a subtree is left as soon as the rest
   of the path and of the set can't reach the overlap that the lengths ask for, or all sets in it are in the
   walker's component already. Large groups are cut into blocks, and each pair of blocks is a task.

Only spanning edges leave a task, never all pairs. Null, empty and wordless texts have no set and link with
nothing. Fewer words than n: the whole sequence is the one n-gram. Documents that share an id have the set of
their own text each, but are one vertex. Null ids are linked with nothing (null component).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import Words, ensure_checkpoint_dir, runs, separators, stored, table, trim
from .components import components
from .substring import PACKED, TO_BUCKET, buckets_for, by_bucket, chunks_for, pack, packed_rows, trimmed, trimmed_pair, unpack, unpacked

N, PERCENT = 5, 75
#: n-grams in one task of the join, and in a block of a large group.
BLOCK_TOKENS = 1 << 20

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


class Sets:
    """The distinct n-grams of several texts: keys sorted, texts ascending within a key."""

    def __init__(self, texts: list, n: int = N) -> None:
        words = Words([None if t is None else t.encode().translate(_LOWER) for t in texts], separators())
        size = np.diff(words.first)
        grams = words.grams(n)
        at = np.flatnonzero(words.valid(n))
        text = np.repeat(np.arange(len(texts)), size)[at]
        keys = grams[at]
        for k in range(1, n):
            short = np.flatnonzero(size == k)
            if len(short):
                keys = np.concatenate([keys, words.grams(k)[words.first[short]]])
                text = np.concatenate([text, short])
        order = np.lexsort((text, keys)) if len(at) < len(keys) else np.argsort(keys, kind="stable")
        keys, text = keys[order], text[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])
        self.keys, self.text = keys[new], text[new]
        self.start = runs(self.keys)
        self.count = np.diff(np.append(self.start, len(self.keys)))
        self.size = np.bincount(self.text, minlength=len(texts))


def rarity(count: np.ndarray) -> np.ndarray:
    """Order class of an n-gram that so many classes hold: 0 for one, else 8 steps a doubling, at most 255."""
    return np.where(count <= 1, 0, np.minimum(255, 1 + np.floor(8 * np.log2(np.maximum(count, 2)))).astype(np.int64))


def count_shared(packed: DataFrame) -> DataFrame:
    """Per bucket, the order class of the keys that two chunks or more hold, sent back to these."""

    def run(t: pa.Table) -> pa.Table:
        chunks = t.column("chunk").to_numpy()
        parts = [unpack(x.as_py(), 5, 2) for x in t.column("payload")]
        keys, counts = (np.concatenate([p[i] for p in parts]) for i in (1, 2))
        order = np.argsort(keys, kind="stable")
        start = runs(keys[order])
        size = np.diff(np.append(start, len(order)))
        total = np.repeat(rarity(np.add.reduceat(counts[order].astype(np.int64), start)), size)
        result = np.zeros(len(order), np.int64)
        result[order] = np.where(np.repeat(size >= 2, size), total, 0)
        out_chunk, out, at = [], [], 0
        for chunk, p in zip(chunks, parts):
            mine = result[at : at + len(p[0])]
            at += len(p[0])
            some = np.flatnonzero(mine)
            if len(some):
                out_chunk.append(chunk)
                out.append(pack(p[0][some], (mine[some], 1)))
        return pa.table({"chunk": pa.array(out_chunk, pa.int64()), "payload": pa.array(out, pa.binary())})

    return packed.groupBy("bucket").applyInArrow(trimmed(run), PACKED)


#: Rows whose ids and texts a task remembers, so that it deals each of them once.
SEEN = 1 << 20


def deal_once(rows: DataFrame, chunk: Column) -> DataFrame:
    """(chunk, payload): (id, key, text) by the chunk, each at most once a task: copies are no use here."""

    def run(batches):
        seen: set[tuple] = set()
        for b in batches:
            new = []
            for i, pair in enumerate(zip(b.column("id").to_pylist(), b.column("key").to_pylist())):
                if pair not in seen:
                    seen.add(pair)
                    new.append(i)
            if len(seen) > SEEN:
                seen.clear()
            if new:
                b = b.take(pa.array(new))
                yield packed_rows(b.select(["id", "key", "text"]), b.column("chunk").to_numpy(zero_copy_only=False))
            del b
            trim()

    return rows.select("id", "key", "text", chunk.alias("chunk")).mapInArrow(run, PACKED)


def _class_rows(t: pa.Table, reps: pa.Table) -> tuple[list, list, list]:
    """Ids, keys and texts of the chunk's class representatives, each text once; an id may stand for several texts."""
    wanted = set(zip(reps.column("id").to_pylist(), reps.column("key").to_pylist()))
    found = []
    for blob in t.column("payload"):
        (rows,) = unpacked([blob])
        for i, key, text in zip(*(rows.column(c) for c in ("id", "key", "text"))):
            pair = (i.as_py(), key.as_py())
            if pair in wanted:
                wanted.remove(pair)
                found.append((*pair, text.as_py()))
    found.sort(key=lambda x: x[:2])
    return tuple(list(x) for x in zip(*found)) if found else ([], [], [])


class Trie:
    """A path-compressed prefix tree over ordered sets of small integers, with bounds for each subtree."""

    def __init__(self, percent: int = PERCENT) -> None:
        self.percent = percent
        # node: [tokens, children by first token, members, least size, most tokens below, component of all or -1]
        self.root = [np.zeros(0, np.int64), {}, [], 1 << 60, 0, -1]
        self.parent: list[int] = []
        self.size: list[int] = []

    def find(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.parent[max(i, j)] = min(i, j)

    def new(self, size: int) -> int:
        self.parent.append(len(self.parent))
        self.size.append(size)
        return len(self.parent) - 1

    def needed(self, a: int, b: int) -> int:
        """The overlap at which sets of these sizes link: 100 i >= percent (a + b - i)."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def insert(self, i: int, tokens: np.ndarray) -> None:
        """Along the path each node's bounds are widened; a node splits where the set leaves it."""
        node, at, size = self.root, 0, self.size[i]
        while True:
            node[3] = min(node[3], size)
            node[4] = max(node[4], len(tokens) - at)
            node[5] = i if node is not self.root and not node[1] and not node[2] else node[5] if node[5] >= 0 and self.find(node[5]) == self.find(i) else -1
            if at == len(tokens):
                node[2].append(i)
                return
            first = int(tokens[at])
            child = node[1].get(first)
            if child is None:
                node[1][first] = [tokens[at:], {}, [i], size, 0, i]
                return
            own, rest = child[0], tokens[at:]
            n = min(len(own), len(rest))
            differ = np.flatnonzero(own[:n] != rest[:n])
            same = int(differ[0]) if len(differ) else n
            if same < len(own):
                lower = [own[same:], child[1], child[2], child[3], child[4], child[5]]
                child[0], child[1], child[2] = own[:same], {int(own[same]): lower}, []
                child[4] = lower[4] + len(own) - same
            node, at = child, at + same

    def walk(self, i: int, tokens: np.ndarray, mark: np.ndarray) -> None:
        """Joins i with every stored set that it links with; mark is True at its tokens."""
        size, total = self.size[i], len(tokens)
        stack = [(self.root, 0)]
        while stack:
            node, common = stack.pop()
            if node[5] >= 0 and self.find(node[5]) == self.find(i):
                continue
            own = node[0]
            if len(own):
                common += int(mark[own].sum())
                left = total - int(np.searchsorted(tokens, own[-1], side="right"))
            else:
                left = total
            if common + min(left, node[4]) < self.needed(size, node[3]):
                continue
            for j in node[2]:
                if common >= self.needed(size, self.size[j]):
                    self.join(i, j)
            uniform = node[1] or node[2]
            for child in node[1].values():
                stack.append((child, common))
            if uniform:
                tops = {self.find(j) for j in node[2]} | {self.find(c[5]) if c[5] >= 0 else -1 for c in node[1].values()}
                node[5] = tops.pop() if len(tops) == 1 else -1


def join_block(groups: np.ndarray, second: np.ndarray, sizes: np.ndarray, order: np.ndarray, tokens: np.ndarray, at: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """For each set the index of the least set of its component within its group.

    order, tokens: order class and hash of each n-gram; at: offsets of the sets. second: sets that are only held
    against the others (a task for a pair of blocks), or all False.
    """
    root = np.arange(len(sizes))
    by_group = np.lexsort((np.arange(len(sizes)), groups))
    for members in np.split(by_group, runs(groups[by_group])[1:]):
        if len(members) < 2:
            continue
        pieces = [np.arange(at[m], at[m + 1]) for m in members]
        flat = np.concatenate(pieces)
        if not len(flat):
            continue
        values, local = np.unique(tokens[flat], return_inverse=True)
        rank_of = np.empty(len(values), np.int64)
        level = np.empty(len(values), np.int64)
        level[local] = order[flat]
        rank_of[np.lexsort((values, -level))] = np.arange(len(values))
        local = rank_of[local]
        edges = np.cumsum([0, *map(len, pieces)])
        mark = np.zeros(len(values), bool)
        trie = Trie(percent)
        pair = bool(second[members].any())
        sets = [np.sort(local[edges[k] : edges[k + 1]]) for k in range(len(members))]
        for k, m in enumerate(members):
            trie.new(int(sizes[m]))
            if pair and not second[m]:
                trie.insert(k, sets[k])
        for k in sorted(range(len(members)), key=lambda k: int(sizes[members[k]])):
            if pair and not second[members[k]]:
                continue
            mark[sets[k]] = True
            trie.walk(k, sets[k], mark)
            mark[sets[k]] = False
            if not pair:
                trie.insert(k, sets[k])
        for k, m in enumerate(members):
            root[m] = members[trie.find(k)]
    return root


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, percent: int = PERCENT, chunk_bytes: int | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(id, n_shingles, component_id) for each row. percent: from 50 to 100."""
    if not 50 <= percent <= 100:
        raise ValueError("percent must lie between 50 and 100")
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("key", F.sha2(F.col("text").cast("binary"), 256))
    reps = rows.filter(F.col("key").isNotNull()).groupBy("key").agg(F.min("id").alias("id")).filter(F.col("id").isNotNull())
    chunks = chunks_for(rows, "text", chunk_bytes)
    buckets = buckets_for(chunks)
    chunk = F.pmod(F.xxhash64("id", "key"), F.lit(chunks))
    reps = stored(reps.withColumn("chunk", chunk))
    dealt = deal_once(rows.filter(F.col("id").isNotNull() & F.col("text").isNotNull()), chunk)

    def first(t: pa.Table, mine: pa.Table) -> pa.Table:
        _, _, texts = _class_rows(t, mine)
        s = Sets(texts, n)
        keys, at = s.keys[s.start], s.start
        return by_bucket(t.column("chunk")[0].as_py(), keys, at, buckets, (keys, 5), (np.minimum(s.count, 65535), 2))

    held = dealt.groupBy("chunk").cogroup(reps.groupBy("chunk"))
    shared = count_shared(held.applyInArrow(trimmed_pair(first), TO_BUCKET))
    both = shared.withColumn("id", F.lit(None).cast("long")).withColumn("key", F.lit(None).cast("string"))
    both = both.unionByName(reps.select("chunk", F.lit(None).cast("binary").alias("payload"), "id", "key"))

    def second(t: pa.Table, more: pa.Table) -> pa.Table:
        kinds = more.column("payload").is_valid()
        ids, own, texts = _class_rows(t, more.filter(pa.compute.invert(kinds)))
        s = Sets(texts, n)
        level = rarity(s.count)
        for x in more.filter(kinds).column("payload"):
            at, value = unpack(x.as_py(), 1)
            level[np.searchsorted(s.start, at)] = value.astype(np.int64)
        level = np.repeat(level, s.count)
        alone = np.bincount(s.text[level == 0], minlength=len(ids))
        prefix = s.size - (-(-percent * s.size // 100)) + 1
        stays = (s.size > 0) & (alone < prefix)
        use = np.flatnonzero((level > 0) & stays[s.text])
        use = use[np.lexsort((s.keys[use], level[use], s.text[use]))]
        edges = np.searchsorted(s.text[use], np.arange(len(ids) + 1))
        keys, levels = s.keys[use].view(np.int64), level[use].astype(np.int16)
        arrays = (pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(x)) for x in (keys, levels))
        return pa.table([pa.array(ids, pa.int64()), pa.array(own, pa.string()), pa.array(s.size, pa.int64()), pa.array(alone, pa.int64()), *arrays], names=["id", "key", "size", "alone", "tokens", "levels"])

    sets = stored(dealt.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(trimmed_pair(second), "id long, key string, size long, alone long, tokens array<long>, levels array<short>"))
    sizes = sets.select("key", "id", "size")
    found = components(_linked(sets, percent, block_tokens).unionByName(_same_id(rows, sizes)))
    return _attach(rows, sizes, found, id_col)


def _same_id(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """(a, b): ids of several texts and the vertices of these texts' classes."""
    name = F.xxhash64("key")
    several = rows.filter(F.col("id").isNotNull() & F.col("key").isNotNull()).groupBy("id").agg(F.min(name).alias("least"), F.max(name).alias("most")).filter("least <> most").select("id")
    texts = rows.join(several, "id", "left_semi").select(F.col("id").alias("a"), "key").distinct()
    return texts.join(sizes.filter("size > 0").select("key", F.col("id").alias("b")), "key").filter("a <> b").select("a", "b")


def _neighbours(sets: DataFrame, percent: int) -> DataFrame:
    """(id, size, reach, pair) for the pairs of neighbours in the prefix of each class that may link.

    reach: the largest set that the class may link with, as its n-grams that others hold too must be enough.
    """
    size, alone = F.col("size"), F.col("alone")
    least = size + F.ceil(size * percent / 100)
    shared = F.ceil(least * (2 * percent - 100) / (100 + percent)) + 1
    # of the size + 1 pairs those with an n-gram of this class only are no one else's
    own = F.when(alone > 0, alone + 1).otherwise(0)
    prefix = (size + 2 - shared - own).cast("int")
    reach = F.floor((size - alone) * (100 + percent) / percent).cast("long") - size
    line = F.concat(F.when(alone > 0, F.array().cast("array<long>")).otherwise(F.array(F.lit(0).cast("long"))), F.col("tokens"), F.array(F.lit(1).cast("long")))
    rows = sets.filter(F.size("tokens") > 0).select("id", "size", reach.alias("reach"), prefix.alias("prefix"), line.alias("line")).filter("prefix > 0")
    pairs = F.transform(F.sequence(F.lit(0), F.least(F.col("prefix"), F.size("line") - 1) - 1), lambda i: F.xxhash64(F.get("line", i), F.get("line", i + 1)))
    return rows.select("id", "size", "reach", F.explode(pairs).alias("pair"))


def candidate_edges(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): classes that share a pair of neighbours and may link by their sizes, as stars.

    Of the classes with a pair in common, a smaller and a larger one may link if each reaches the other's size. In
    order of size, a class stays with those before it while one of them reaches it; the windows are over sizes,
    pre-aggregated, so a pair that very many classes hold is a short list.
    """
    held = _neighbours(sets, percent)
    sizes = held.groupBy("pair", "size").agg(F.max("reach").alias("reach"), F.count_if(F.col("reach") >= F.col("size")).alias("even"), F.count("*").alias("n"))
    by = Window.partitionBy("pair")
    before = by.orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    after = by.orderBy("size")
    sizes = sizes.withColumn("all", F.sum("n").over(by)).filter("all > 1")
    sizes = sizes.withColumn("reached", F.coalesce(F.max("reach").over(before), F.lit(-1))).withColumn("next", F.lead("size").over(after))
    # a part begins with a size that none before it reaches
    sizes = sizes.withColumn("part", F.sum((F.col("reached") < F.col("size")).cast("int")).over(after))
    up = F.col("reach") >= F.col("next")
    rows = held.join(sizes.select("pair", "size", "reached", "next", "part", "even"), ["pair", "size"])
    down = F.col("reached") >= F.col("size")
    level = (F.col("reach") >= F.col("size")) & (F.col("even") > 1)
    rows = rows.filter(down | level | F.coalesce(up, F.lit(False))).select("pair", "part", "id")
    low = rows.groupBy("pair", "part").agg(F.min("id").alias("b"), F.count("*").alias("n")).filter("n > 1")
    return rows.join(low, ["pair", "part"]).filter(F.col("id") != F.col("b")).select(F.col("id").alias("a"), "b").distinct()


def _linked(sets: DataFrame, percent: int, block_tokens: int) -> DataFrame:
    """(a, b): a spanning forest of the classes that link."""
    probing = sets.filter(F.size("tokens") > 0)
    edges = candidate_edges(sets, percent)
    group = components(edges).select(F.col("vertex").alias("id"), F.col("component").alias("grp")).checkpoint()
    many = probing.join(group, "id")
    sizes = many.groupBy("grp").agg(F.sum(F.size("tokens")).alias("total"))
    blocks = F.ceil(F.col("total") / block_tokens).cast("int")
    total = sizes.agg(F.sum("total")).first()[0] or 0
    bins = max(1, -(-int(total) * 2 // block_tokens))
    sizes = sizes.withColumn("blocks", F.greatest(F.lit(1), blocks))
    # small groups share a task; a large one has its own, one for each pair of blocks
    sizes = sizes.withColumn("bin", F.when(F.col("blocks") > 1, F.col("grp")).otherwise(-1 - F.pmod(F.xxhash64("grp"), F.lit(bins)))).drop("total")
    cast = many.join(sizes, "grp").withColumn("mine", F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")).cast("int"))
    cast = cast.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cast = cast.select("bin", F.least("mine", "other").alias("row"), F.greatest("mine", "other").alias("col"), "mine", "grp", "id", "key", "size", "tokens", "levels")

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("id", "ascending"), ("key", "ascending")])
        ids = t.column("id").to_numpy()
        tokens, levels = t.column("tokens").combine_chunks(), t.column("levels").combine_chunks()
        at = np.concatenate([[0], np.cumsum(tokens.value_lengths().to_numpy(zero_copy_only=False))])
        second = (t.column("mine").to_numpy() == t.column("col")[0].as_py()) & (t.column("row")[0].as_py() != t.column("col")[0].as_py())
        root = join_block(t.column("grp").to_numpy(), second, t.column("size").to_numpy(), levels.flatten().to_numpy(zero_copy_only=False).astype(np.int64), tokens.flatten().to_numpy(zero_copy_only=False), at, percent)
        some = np.flatnonzero(ids[root] != ids)
        return pa.table({"a": pa.array(ids[some], pa.int64()), "b": pa.array(ids[root[some]], pa.int64())})

    return cast.groupBy("bin", "row", "col").applyInArrow(trimmed(run), "a long, b long")


def _attach(rows: DataFrame, sizes: DataFrame, found: DataFrame, id_col: str, salts: int = 16) -> DataFrame:
    """Every row with what its class has; classes are salted, as one may hold a third of all rows."""
    classes = sizes.join(found, F.col("vertex") == F.col("id"), "left").select("key", "size", F.coalesce("component", "id").alias("component"))
    classes = classes.withColumn("salt", F.explode(F.array([F.lit(i).cast("long") for i in range(salts)])))
    out = rows.select("id", "key").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts))).join(classes, ["key", "salt"], "left")
    size = F.coalesce("size", F.lit(0)).cast("long")
    component = F.when(F.col("id").isNotNull(), F.when(size > 0, F.col("component")).otherwise(F.col("id")))
    return out.select(F.col("id").alias(id_col), size.alias("n_shingles"), component.alias("component_id"))


def op7_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document among those with like 5-word n-grams."""
    return ngram_components(table(spark, sf_dir, "documents"))
