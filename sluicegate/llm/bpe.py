"""BPE encoding and decoding for a tokenizer whose words end in a suffix.

Encoding is exact and linear in the text. An Aho-Corasick automaton over the vocabulary
finds every token that starts at each place of a word; a backtracking walk takes the longest
that is compatible with the token before it and steps back where none is. Two tokens are
compatible when the merges of their joined text end in exactly these two; a sequence whose
neighbours are all compatible is the one the merges give. Decoding reads one buffer of
token texts through a table of offsets.

Edge cases: a null text counts as empty; an empty text has no tokens and decodes to the empty string; a very
long text is encoded whole, in memory in proportion to it; special strings in a text become their special ids (the
library's default); there is one encoding, so no ties; repeated rows are each encoded; null ids pass through; an empty table
gives an empty result; other extra columns are not read.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, gather, map_arrow, starts_of

#: Most words kept with their tokens in one worker; beyond it only words met more than once stay.
CACHE_WORDS = 160_000
#: Characters of text worked on at a time in one worker.
CHUNK_CHARS = 500_000
#: Up to here lower-casing and letter classes of all Unicode versions agree, and NFC changes nothing.
PLAIN = regex.compile(r"[^\x00-ɏ‐-‧€]")


def byte_chars() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


@dataclass(frozen=True)
class Tables:
    """What the workers need of a tokenizer file, made once on the driver: flat arrays, a few megabytes."""

    texts: bytes  # symbols of all tokens one after another, UTF-16: one for each byte, 256 more at the end of a word
    sizes: np.ndarray  # symbols of each token
    left: np.ndarray  # of each merge, in order of rank
    right: np.ndarray
    whole: np.ndarray
    usable: np.ndarray  # whether the merges ever give the token for its own text
    written: tuple[np.ndarray, np.ndarray]  # what decoding writes for each token
    special: dict[str, int]
    pattern: str
    normalizer: str  # the file's normalizer alone, as a tokenizer without a vocabulary

    @property
    def key(self) -> str:
        return hashlib.sha256(b"".join([self.texts, self.sizes.tobytes(), self.left.tobytes(), self.right.tobytes(), self.normalizer.encode(), json.dumps([self.special, self.pattern]).encode()])).hexdigest()


def tables_of(spec: str) -> Tables:
    """Read the JSON text of a tokenizer file."""
    parsed = json.loads(spec)
    model = parsed["model"]
    suffix, vocab = model["end_of_word_suffix"], model["vocab"]
    special = {t["content"]: t["id"] for t in parsed["added_tokens"]}
    symbol: dict[str, str] = {}
    for b, c in enumerate(byte_chars()):
        symbol[c], symbol[c + suffix] = chr(b), chr(b + 256)
    pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    for a, b in pairs:
        symbol[a + b] = symbol[a] + symbol[b]
    size = max([*vocab.values(), *special.values()]) + 1
    text, written = [""] * size, [""] * size
    for token, i in vocab.items():
        text[i] = symbol.get(token, "")
    for token, i in [*vocab.items(), *special.items()]:
        written[i] = token
    merges = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], np.int32).reshape(-1, 3)
    bare = {"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": parsed["normalizer"], "pre_tokenizer": None, "post_processor": None, "decoder": None, "model": {"type": "BPE", "vocab": {}, "merges": []}}
    merge = Merger(text, *merges.T)
    usable = np.array([bool(t) and merge(t) == [i] for i, t in enumerate(text)])
    return Tables("".join(text).encode("utf-16-le"), np.array([len(t) for t in text], np.int32), *(np.ascontiguousarray(c) for c in merges.T), usable, _rows([(t + " ").encode() for t in written]), special, parsed["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"], json.dumps(bare))


def _rows(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(rows), np.uint8), starts_of(np.array([len(r) for r in rows]))


class Merger:
    """Merges as defined, lowest rank first: used on short texts to fill tables."""

    def __init__(self, text: list[str], left: np.ndarray, right: np.ndarray, whole: np.ndarray):
        self._base = {t: i for i, t in enumerate(text) if len(t) == 1}
        # Rank and result in one number: the least is the lowest rank.
        self._join = dict(zip((left.astype(np.int64) << 20 | right)[::-1].tolist(), (np.arange(len(whole), dtype=np.int64) << 20 | whole)[::-1].tolist(), strict=True))

    def __call__(self, text: str) -> list[int]:
        ids = [self._base[c] for c in text]
        while len(ids) > 1:
            best, at = None, -1
            for k in range(len(ids) - 1):
                found = self._join.get(ids[k] << 20 | ids[k + 1])
                if found is not None and (best is None or found < best):
                    best, at = found, k
            if best is None:
                break
            ids[at : at + 2] = [best & 0xFFFFF]
        return ids


class WordBPE:
    """Encoder and decoder over the tables of a tokenizer file."""

    def __init__(self, tables: Tables):
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        self._words = regex.compile(tables.pattern)
        self._library = Tokenizer.from_str(tables.normalizer).normalizer
        self._library_split = pre_tokenizers.Split(Regex(tables.pattern), "removed", invert=True)
        self.special = tables.special
        self._special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        symbols, at = tables.texts.decode("utf-16-le"), starts_of(tables.sizes).tolist()
        self._text = [symbols[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        self._length = tables.sizes.tolist()
        self._merge = Merger(self._text, tables.left, tables.right, tables.whole)
        # A token that the merges never give for its own text occurs in no encoding.
        self._automaton = ahocorasick.Automaton()
        for i in np.flatnonzero(tables.usable).tolist():
            self._automaton.add_word(self._text[i], i)
        self._automaton.make_automaton()
        self._fits: dict[int, bool] = {}
        self._texts = tables.written
        self._decimals = _rows([f"{i} ".encode() for i in range(len(self._text))])
        self._forget()

    def _forget(self) -> None:
        self._slot: dict[str, int] = {}
        self._ids, self._sizes = array("i"), array("i")  # tokens of all known words, and each word's number of them
        self._uses = np.zeros(0, np.int64)

    def _shrink(self) -> None:
        """Keep the words used most, half a cache of them at most."""
        least = 2
        while np.count_nonzero(self._uses >= least) > CACHE_WORDS // 2:
            least *= 2
        keep = np.flatnonzero(self._uses >= least)
        ids, sizes = self._tokens(keep)
        words = list(self._slot)
        self._slot = {words[k]: i for i, k in enumerate(keep.tolist())}
        self._ids, self._sizes, self._uses = array("i", ids.tobytes()), array("i", sizes.astype(np.int32).tobytes()), self._uses[keep] // 2

    def _tokens(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of the words in these slots one after another, and the number of each word's."""
        return gather(np.frombuffer(self._ids, np.int32), starts_of(np.frombuffer(self._sizes, np.int32)), slots)

    def _compatible(self, left: int, right: int) -> bool:
        key = left << 20 | right
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) > CACHE_WORDS:
                self._fits.clear()
            known = self._fits[key] = self._merge(self._text[left] + self._text[right]) == [left, right]
        return known

    def encode_word(self, word: str) -> list[int]:
        """The tokens of one word after normalisation and splitting."""
        raw = word.encode("utf-8", "surrogatepass").decode("latin-1")
        text = raw[:-1] + chr(ord(raw[-1]) + 256)
        n, length = len(text), self._length
        starting: list[list[int]] = [[] for _ in range(n + 1)]
        for end, token in self._automaton.iter(text):
            starting[end + 1 - length[token]].append(token)  # shorter ones come first
        open_at = [True] * (n + 1)  # false: no way on from the one encoding that ends here
        taken: list[int] = []
        choices: list[int] = []
        at, choice = 0, len(starting[0]) - 1
        while at < n:
            here = starting[at]
            while choice >= 0:
                token = here[choice]
                if open_at[at + length[token]] and (not taken or self._compatible(taken[-1], token)):
                    break
                choice -= 1
            if choice >= 0:
                taken.append(token)
                choices.append(choice)
                at += length[token]
                choice = len(starting[at]) - 1
            else:
                open_at[at] = False
                at -= length[taken.pop()]
                choice = choices.pop() - 1
        return taken

    def words(self, text: str) -> list[str]:
        """The words of a text; special strings stay whole."""
        if any(x in text for x in self.special):
            return [w for part in self._special.split(text) for w in ([part] if part in self.special else self.words_of(part))]
        return self.words_of(text)

    def words_of(self, text: str) -> list[str]:
        if text.isascii() or not PLAIN.search(text):
            return self._words.findall(text.lower())
        normal = self._library.normalize_str(text)
        return [w for w, _ in self._library_split.pre_tokenize_str(normal)]

    def _slot_of(self, word: str) -> int:
        ids = [self.special[word]] if word in self.special else self.encode_word(word)
        self._ids.extend(ids)
        self._sizes.append(len(ids))
        self._slot[word] = slot = len(self._sizes) - 1
        return slot

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the number of each text's."""
        if len(self._slot) > CACHE_WORDS:
            self._shrink()
        flat: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            found = self.words(text)
            counts[k] = len(found)
            flat += found
        for word in set(flat).difference(self._slot):
            self._slot_of(word)
        slots = np.fromiter(map(self._slot.__getitem__, flat), np.int64, len(flat))
        uses = np.bincount(slots, minlength=len(self._sizes))
        uses[: len(self._uses)] += self._uses
        self._uses = uses
        ids, sizes = self._tokens(slots)
        ends = starts_of(sizes)[starts_of(counts)]
        return ids, np.diff(ends)

    def decode_batch(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """UTF-8 of each text, as the tokens' texts joined by one space."""
        return self._joined(self._texts, ids, counts)

    def decimal_batch(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        return self._joined(self._decimals, ids, counts)

    @staticmethod
    def _joined(rows: tuple[np.ndarray, np.ndarray], ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        data, sizes = gather(*rows, ids.astype(np.int64))
        ends = starts_of(sizes)[starts_of(counts)]
        buffer = data.tobytes()
        return [buffer[a : max(a, b - 1)] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


_LOADED: dict[str, WordBPE] = {}


def forget() -> None:
    _LOADED.clear()


def loaded(tables: Tables) -> WordBPE:
    """One encoder for each tokenizer in a worker."""
    key = tables.key
    if key not in _LOADED:
        _LOADED[key] = WordBPE(tables)
    return _LOADED[key]


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", *, with_ids: bool = True, with_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Encode and decode every whole text.

    Returns the id column, the columns in `carry` (but those named as a result), n_tokens, ids (array of int, if with_ids),
    decoded (if with_text), ids_sha256 and decoded_sha256. The tokenizer file is read on the
    driver, made into tables and sent to the workers; their size is that of the vocabulary, whatever the data's.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        tables = spark.sparkContext.broadcast(tables_of(f.read()))
    added = {"n_tokens": "long"} | ({"ids": "array<int>"} if with_ids else {}) | ({"decoded": "string"} if with_text else {}) | {"ids_sha256": "string", "decoded_sha256": "string"}
    names = [id_col, *(c for c in carry if c not in added and c != id_col)]
    kept = docs.select(*(F.col(f"`{c}`").alias(f"__c{k}") for k, c in enumerate(names)), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__text"))
    fields = [f"{x.name} {x.dataType.simpleString()}" for x in kept.schema.fields[:-1]] + [f"{name} {kind}" for name, kind in added.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(tables.value)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for a, b in chunks(np.array([len(t) for t in texts], np.int64), CHUNK_CHARS):
                ids, counts = bpe.encode_batch(texts[a:b])
                decoded = bpe.decode_batch(ids, counts)
                columns = [c.slice(a, b - a) for c in batch.columns[:-1]] + [pa.array(counts, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(starts_of(counts), pa.int32()), pa.array(ids, pa.int32())))
                if with_text:
                    columns.append(pa.array([d.decode("utf-8", "replace") for d in decoded], pa.string()))
                columns += [pa.array([hashlib.sha256(x).hexdigest() for x in side], pa.string()) for side in (bpe.decimal_batch(ids, counts), decoded)]
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], *added])

    return map_arrow(kept, run, ", ".join(fields)).toDF(*names, *added)
