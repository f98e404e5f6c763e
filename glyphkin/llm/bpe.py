"""Operator 4: byte-level BPE encoding and decoding by tree concatenation.

Text is cut where the tokenizer's own pre-tokenizer always cuts (a white-space character after another
character). A stretch without such a place that is still one pre-token is halved again and again, the halves
are encoded in parallel threads, and each join is mended by encoding a window of tokens around it afresh. The
window doubles until its first and last tokens are those that were there before. Two neighbouring tokens of a
byte-pair encoding depend on each other alone, so what lies beyond an unchanged token is unchanged as well and
the result is exactly that of the whole text.

Nulls are empty texts. Empty texts have no ids. Rows are handled alone, so ties and repeated rows need no rule;
other columns pass through `bpe_encode` unless they have the name of an output, which then wins.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T

from .common import table, trim


def _byte_alphabet() -> dict[str, int]:
    """Characters of a byte-level vocabulary: printable Latin-1 stands for itself, others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class TreeBpe:
    """Encoder and decoder for a tokenizers JSON file of the byte-level BPE kind.

    leaf_bytes: pre-tokens up to this size are encoded at once; longer ones by halves.
    """

    def __init__(self, path: str, leaf_bytes: int = 4096, threads: int = 2) -> None:
        import tiktoken
        import tokenizers.pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer"):
            raise ValueError("only byte-level BPE without normaliser or prefix space")
        letters = _byte_alphabet()
        as_bytes = {t: bytes(letters[c] for c in t) for t in model["vocab"]}
        order = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if order != sorted(order):
            raise ValueError("ids must follow the order of merges")
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.table = [b""] * (1 + max([*model["vocab"].values(), *self.specials.values()]))
        for t, i in model["vocab"].items():
            self.table[i] = as_bytes[t]
        for t, i in self.specials.items():
            self.table[i] = t.encode()
        import public_tokenizers

        ranks = {b: model["vocab"][t] for t, b in as_bytes.items() if t not in self.specials}
        self.engine = tiktoken.Encoding("tree", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self.specials)
        self.ranks = ranks
        self.pretokens = tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        self.leaf, self.pool = leaf_bytes, ThreadPoolExecutor(threads)
        self.allowed = set(self.specials)

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if len(text) <= self.leaf:
            return self.engine.encode_to_numpy(text, allowed_special=self.allowed)
        parts, at = [], 0
        while at < len(text):
            to = self._safe_cut(text, at)
            piece = text[at:to]
            if len(piece) <= 2 * self.leaf:
                parts.append(self.engine.encode_to_numpy(piece, allowed_special=self.allowed))
            else:
                parts.append(self._unsplit(piece))
            at = to
        return np.concatenate(parts)

    def _safe_cut(self, text: str, at: int) -> int:
        """The first place at or after at + leaf where white space follows another character.

        No pre-token goes on over such a place and none looks back over it; special tokens hold no space.
        """
        for i in range(at + self.leaf, len(text)):
            if text[i] in " \n\t\r" and not text[i - 1].isspace():
                return i
        return len(text)

    def _unsplit(self, text: str) -> np.ndarray:
        out: list[int] = []
        for ordinary, special in self._around_specials(text):
            for piece, _ in self.pretokens.pre_tokenize_str(ordinary) if ordinary else ():
                out += self.encode_piece(bytes(_LETTERS[c] for c in piece))
            if special is not None:
                out.append(special)
        return np.array(out, np.uint32)

    def _around_specials(self, text: str) -> Iterator[tuple[str, int | None]]:
        import re

        at = 0
        if self.specials:
            for m in re.finditer("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))), text):
                yield text[at : m.start()], self.specials[m[0]]
                at = m.end()
        yield text[at:], None

    @functools.cached_property
    def whole(self):
        """Takes a text as one pre-token, and lets go of the interpreter while it works; few texts need it."""
        import tiktoken

        return tiktoken.Encoding("whole", pat_str=r"(?s:.+)", mergeable_ranks=self.ranks, special_tokens={})

    def encode_piece(self, data: bytes) -> list[int]:
        """One pre-token, UTF-8: halved until halves are leaves, these encoded in parallel, then joined pair by pair."""
        if len(data) <= self.leaf:
            return self.engine._encode_single_piece(data)
        level = list(self.pool.map(self.whole.encode_ordinary, [x.decode() for x in self._leaves(data)]))
        while len(level) > 1:
            pairs = [(level[i], level[i + 1]) for i in range(0, len(level) - 1, 2)]
            level = list(self.pool.map(lambda p: self.join(*p), pairs)) + level[2 * len(pairs) :]
        return level[0]

    def _leaves(self, data: bytes) -> list[bytes]:
        """The halves of halves, cut between characters; all are of one depth."""
        parts = [data]
        while max(map(len, parts)) > self.leaf:
            halves = []
            for p in parts:
                cut = len(p) // 2
                while cut < len(p) and p[cut] & 0xC0 == 0x80:
                    cut += 1
                halves += [p[:cut], p[cut:]]
            if len(halves) == 2 * len(parts) and all(halves):
                parts = halves
            else:
                break
        return parts

    def join(self, left: list[int], right: list[int], window: int = 8) -> list[int]:
        while True:
            i, j = max(0, len(left) - window), min(len(right), window)
            new = self.engine._encode_single_piece(self.bytes_of(left[i:] + right[:j]))
            if (i == 0 or new[0] == left[i]) and (j == len(right) or new[-1] == right[j - 1]):
                return left[:i] + new + right[j:]
            window *= 2

    def bytes_of(self, ids) -> bytes:
        get = self.table
        return b"".join([get[i] for i in ids])

    def decode(self, ids) -> str:
        """As decode(ids, skip_special_tokens=False)."""
        return self.bytes_of(ids.tolist() if isinstance(ids, np.ndarray) else ids).decode("utf-8", "replace")


_LETTERS = _byte_alphabet()
_BUILT: dict[tuple, TreeBpe] = {}


def encoder(path: str, leaf_bytes: int = 4096) -> TreeBpe:
    """One encoder a process."""
    if (path, leaf_bytes) not in _BUILT:
        _BUILT[path, leaf_bytes] = TreeBpe(path, leaf_bytes)
    return _BUILT[path, leaf_bytes]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def bpe_encode(df: DataFrame, text_col: str = "text", path: str | None = None, ids_col: str = "ids", leaf_bytes: int = 4096, decoded_col: str | None = None) -> DataFrame:
    """All columns and `ids`, the token ids of each whole text. The vocabulary's path must hold on every executor.

    decoded_col: a further column with the text that the ids decode to, made in the same process.
    """
    path = path or default_path()
    out = [T.StructField(ids_col, T.ArrayType(T.IntegerType())), *([T.StructField(decoded_col, T.StringType())] if decoded_col else [])]
    kept = [f for f in df.schema if f.name not in {o.name for o in out}]
    names = [f.name for f in kept]

    def run(batches):
        tree = encoder(path, leaf_bytes)
        for b in batches:
            # in parts, so that not all of a batch is held in every form at once
            for part in (b.slice(i, ROWS) for i in range(0, len(b), ROWS)):
                ids = [tree.encode(t.as_py()).astype(np.int32) for t in part.column(text_col)]
                columns = [pa.array(ids, pa.list_(pa.int32())), *([pa.array([tree.decode(x) for x in ids], pa.string())] if decoded_col else [])]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *columns], [*names, *(o.name for o in out)])
                del part, ids, columns
                trim()
            del b

    # the text itself is read even where an output replaces it
    return df.mapInArrow(run, T.StructType([*kept, *out]))


#: Rows that are encoded or decoded at a time.
ROWS = 1000


def bpe_decode(df: DataFrame, ids_col: str = "ids", path: str | None = None, decoded_col: str = "decoded") -> DataFrame:
    """All columns and `decoded`, the text of the token ids (null ids: empty)."""
    path = path or default_path()
    kept = [f for f in df.schema if f.name != decoded_col]
    schema = T.StructType([*kept, T.StructField(decoded_col, T.StringType())])
    names = [f.name for f in kept]

    def run(batches):
        tree = encoder(path)
        for b in batches:
            texts = [tree.decode(x.as_py() or []) for x in b.column(ids_col)]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(texts, pa.string())], [*names, decoded_col])

    return df.mapInArrow(run, schema)


def bpe_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, leaf_bytes: int = 4096) -> DataFrame:
    """Per row: number of ids, SHA-256 of the ids and of the text decoded from them, without moving ids about."""
    path = path or default_path()
    schema = T.StructType([df.schema[id_col], *(T.StructField(n, t) for n, t in (("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())))])

    def run(batches):
        tree = encoder(path, leaf_bytes)
        for b in batches:
            n, ids_hex, text_hex = [], [], []
            for t in b.column(text_col):
                ids = tree.encode(t.as_py())
                n.append(len(ids))
                ids_hex.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                text_hex.append(hashlib.sha256(tree.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())], schema.names)

    return df.select(id_col, text_col).mapInArrow(run, schema)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids and decoded text of every document, as digests."""
    return bpe_digests(table(spark, sf_dir, "documents"))
