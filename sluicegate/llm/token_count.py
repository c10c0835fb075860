"""Token counts of a byte-level BPE, merged in step over ragged numpy arrays.

All pre-tokens of a batch that have not been met yet lie one after another in one array. Each
round finds the lowest rank among each sequence's adjacent pairs and merges that pair
everywhere in the sequence, for all sequences at once; the symbols that survive are counted.
A pair made by a merge always ranks after it, so this order gives the merges as defined.

Edge cases: a null or empty text has no tokens and no bytes; a very long text is counted whole, in memory
of some forty bytes a byte of its new pre-tokens; special strings inside a text count as one token each (the
library's default); ties cannot occur between ranks; an empty table gives an empty result; repeated rows are each
counted; a null id stays null; only id and text are read, so extra columns don't matter whatever their names.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PLAIN, byte_chars
from .common import chunks, map_arrow, starts_of

CACHE_PIECES = 250_000
CHUNK_CHARS = 1_000_000
#: Fixed value: the public split pattern of byte-level vocabularies.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_NONE = np.int64(1) << 40


class ByteBPECounter:
    def __init__(self, spec: str):
        parsed = json.loads(spec)
        vocab, merges = parsed["model"]["vocab"], parsed["model"]["merges"]
        self._byte = np.array([vocab[c] for c in byte_chars()], np.int64)
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self._keys, self._rank = keys[order], order.astype(np.int64)
        self._made = np.array([vocab[a + b] for a, b in merges], np.int64)
        from tokenizers import pre_tokenizers

        self._split = regex.compile(SPLIT)
        self._library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        self._byte_of = {c: b for b, c in enumerate(byte_chars())}
        self._names = sorted((t["content"] for t in parsed["added_tokens"]), key=len, reverse=True)
        self._special = regex.compile("|".join(map(regex.escape, self._names))) if self._names else None
        self._known: dict[str, int] = {}

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._rank[at], _NONE)

    def merge_counts(self, pieces: list[bytes]) -> np.ndarray:
        """Symbols that survive in each piece; pieces are not empty."""
        sizes = np.array([len(p) for p in pieces], np.int64)
        left = np.zeros(len(pieces), np.int64)
        symbol = self._byte[np.frombuffer(b"".join(pieces), np.uint8)]
        row = np.repeat(np.arange(len(pieces)), sizes)
        rank = np.full(len(symbol), _NONE)
        if len(symbol) > 1:
            rank[:-1] = np.where(row[1:] == row[:-1], self._ranks(symbol[:-1], symbol[1:]), _NONE)
        while len(symbol):
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            low = np.minimum.reduceat(rank, first)
            count = np.diff(np.r_[first, len(symbol)])
            done = low == _NONE
            if done.any():
                left[row[first[done]]] = count[done]
                keep = np.repeat(~done, count)
                symbol, row, rank = symbol[keep], row[keep], rank[keep]
                low, count = low[~done], count[~done]
                if not len(symbol):
                    break
            hit = rank == np.repeat(low, count)
            at = np.flatnonzero(hit)
            # Of a run of overlapping hits (a pair of equal symbols) every other one merges.
            begins = np.r_[True, np.diff(at) != 1]
            run = np.flatnonzero(begins)
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))) % 2 == 0]
            symbol[at] = self._made[rank[at]]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            symbol, row, rank = symbol[keep], row[keep], rank[keep]
            now = at - np.arange(len(at))  # where the merged symbols stand now
            again = np.unique(np.r_[now, now[now > 0] - 1])
            last = again + 1 >= len(symbol)
            rank[again[last]] = _NONE
            again = again[~last]
            rank[again] = np.where(row[again] == row[again + 1], self._ranks(symbol[again], symbol[again + 1]), _NONE)
        return left

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens of a text; beyond the characters on whose classes all Unicode versions agree the library splits."""
        if text.isascii() or not PLAIN.search(text):
            return self._split.findall(text)
        return [bytes(map(self._byte_of.__getitem__, p)).decode("utf-8", "surrogatepass") for p, _ in self._library.pre_tokenize_str(text)]

    def count_batch(self, texts: list[str]) -> np.ndarray:
        if len(self._known) > CACHE_PIECES:
            self._known = {}
        flat: list[str] = []
        sizes = np.zeros(len(texts), np.int64)
        extra = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            parts = [text]
            if any(x in text for x in self._names):
                parts = self._special.split(text)
                extra[k] = len(parts) - 1
            found = [p for part in parts for p in self.pieces(part)]
            sizes[k] = len(found)
            flat += found
        new = list(set(flat).difference(self._known))
        if new:
            coded = [p.encode("utf-8", "surrogatepass") for p in new]
            for a, b in chunks(np.array([len(p) for p in coded], np.int64), CHUNK_CHARS):
                self._known.update(zip(new[a:b], self.merge_counts(coded[a:b]).tolist(), strict=True))
        each = np.fromiter(map(self._known.__getitem__, flat), np.int64, len(flat))
        return np.diff(starts_of(each)[starts_of(sizes)]) + extra


_LOADED: dict[str, ByteBPECounter] = {}


def forget() -> None:
    _LOADED.clear()


def loaded(spec: str) -> ByteBPECounter:
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = ByteBPECounter(spec)
    return _LOADED[key]


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """Bytes and tokens of every whole text: id column, n_bytes, n_tokens, over_limit (n_tokens > limit)."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    kept = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    key = kept.schema.fields[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = loaded(spec.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in chunks(np.array([len(t) for t in texts], np.int64), CHUNK_CHARS):
                n = counter.count_batch(texts[a:b])
                size = pa.array([len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass")) for t in texts[a:b]], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), size, pa.array(n, pa.int64()), pa.array(n > limit, pa.bool_())], [key.name, "n_bytes", "n_tokens", "over_limit"])

    return map_arrow(kept, run, f"`{key.name}` {key.dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
