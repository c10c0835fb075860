"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are brought to one form (lower case, runs of anything but letters and
digits as one space). An item of m bytes, with the spaces around it, may differ by e = floor(rate * m) edits;
cut into e + 1 pieces, any passage within e edits holds one piece exactly. One rule holds for all lengths: an item
too short for an edit is met exactly, as whole words. One Aho-Corasick
automaton finds all pieces of all items in a text; around each hit Myers' bit-parallel
algorithm gives the edit distance of the item to its best place in the window.

Items go to the workers in blocks of bounded size (`block_bytes`), each with a pass over the
documents of its own, so any number of items can be searched.

Edge cases: null or empty texts and items match nothing; very long texts are searched whole, in memory of a few
copies of the text; repeated rows each give their pairs, equal items all match; of places with equal distance the first
counts; a null id gives its pairs under null; an empty table of texts or items gives no pairs; extra columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, sized, staged


def plain_forms(texts: list[str]) -> list[str]:
    """The common form of each text, as one character for each byte, with a space at either end."""
    kind = np.zeros(256, bool)
    kind[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
    out = []
    for t in texts:
        data = np.frombuffer(b"".join((b" ", t.lower().encode("utf-8", "surrogatepass"), b" ")), np.uint8)
        word = kind[data]
        keep = word.copy()
        keep[0] = True
        keep[1:] |= word[:-1]
        out.append(np.where(word, data, np.uint8(32))[keep].tobytes().decode("latin-1"))
    return out


def best_distance(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """Least edit distance of the pattern to any part of the text, and where the part ends; None beyond `most`.

    Myers' algorithm with the whole column in one integer.
    """
    m = len(pattern)
    masks: dict[str, int] = defaultdict(int)
    for k, c in enumerate(pattern):
        masks[c] |= 1 << k
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, where = m + 1, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        x = eq | minus
        d0 = ((((x & plus) + plus) ^ plus) | x) & full
        hp = (minus | ~(d0 | plus)) & full
        hn = d0 & plus
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp = (hp << 1) & full
        plus = ((hn << 1) | ~(d0 | hp)) & full
        minus = hp & d0
        if score < best:
            best, where = score, j + 1
    return (best, where) if best <= most else None


class Matcher:
    """Search for a block of items. items: (number, common form).

    Every item is looked for with the spaces around it, whatever its length, so it stands as whole words;
    equal items are searched once.
    """

    def __init__(self, items: list[tuple[int, str]], rate: float):
        numbers: dict[str, list[int]] = defaultdict(list)
        for number, form in items:
            if bare := form.strip(" "):
                numbers[bare].append(number)
        self.items: list[tuple[str, int, list[int]]] = []
        pieces: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for bare, own in numbers.items():
            pattern, budget = f" {bare} ", int(rate * len(bare))
            cuts = [round(k * len(pattern) / (budget + 1)) for k in range(budget + 2)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                pieces[pattern[a:b]].append((len(self.items), a))
            self.items.append((pattern, budget, own))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        if pieces:
            self.automaton.make_automaton()

    def search(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """(item number, least distance, item length, end of the passage in the text's common form)."""
        found: dict[int, tuple[int, int]] = {}
        if not self.items:
            return
        tried: set[tuple[int, int]] = set()
        for end, (size, places) in self.automaton.iter(text):
            for k, offset in places:
                known = found.get(k)
                begin = end + 1 - size - offset
                if (known and known[0] == 0) or (k, begin) in tried:
                    continue
                tried.add((k, begin))
                item, budget, _ = self.items[k]
                if begin >= 0 and text.startswith(item, begin):
                    found[k] = (0, begin + len(item) - 1)
                elif budget:
                    low = max(0, begin - budget)
                    best = best_distance(item, text[low : begin + len(item) + budget], budget)
                    if best and (not known or best[0] < known[0]):
                        found[k] = (best[0], low + best[1] - 1)
        for k, (distance, stop) in found.items():
            item, _, numbers = self.items[k]
            for number in numbers:
                yield number, distance, len(item) - 2, stop


def _read_blocks(benchmark: DataFrame, item_col: str, item_text: str, most: int) -> Iterator[list[tuple[object, str]]]:
    """Items in blocks, fetched a partition at a time."""
    rows = benchmark.select(item_col, item_text).where(F.col(item_text).isNotNull()).toLocalIterator()
    block, size = [], 0
    for key, text in rows:
        if block and size + len(text) > most:
            yield block
            block, size = [], 0
        block.append((key, text))
        size += len(text)
    if block:
        yield block


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = 0.08, block_bytes: int = 8_000_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document and item within the budget: id, item, distance, item_length, passage_end.

    passage_end counts in the document's common form.
    """
    spark = docs.sparkSession
    kept = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).where(F.length("__text") > 0)
    item_type = benchmark.schema[item_col].dataType.simpleString()
    schema = f"`__id` {docs.schema[id_col].dataType.simpleString()}, __item int, distance int, item_length int, passage_end long"

    parts = []
    for block in _read_blocks(benchmark, item_col, item_text, block_bytes):
        forms = plain_forms([t for _, t in block])
        shared = spark.sparkContext.broadcast((list(enumerate(forms)), rate))
        names = spark.createDataFrame([(k, key) for k, (key, _) in enumerate(block)], f"__item int, `{item_col}` {item_type}")

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(*shared.value)
            for batch in batches:
                hits = [(k, *hit) for k, text in enumerate(batch.column(1).to_pylist()) for hit in matcher.search(plain_forms([text])[0])]
                rows, items, distances, lengths, ends = zip(*hits, strict=True) if hits else ((),) * 5
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(items, pa.int32()), pa.array(distances, pa.int32()), pa.array(lengths, pa.int32()), pa.array(ends, pa.int64())], ["__id", "__item", "distance", "item_length", "passage_end"])

        parts.append(map_arrow(kept, run, schema).join(F.broadcast(names), "__item").select(F.col("__id").alias(id_col), item_col, "distance", "item_length", "passage_end"))
    if not parts:
        return spark.createDataFrame([], f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, `{item_col}` {item_type}, distance int, item_length int, passage_end long")
    return reduce(DataFrame.unionAll, parts)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns; a null id never matches by id and stays."""
    hit = staged(matches(docs, benchmark, id_col=id_col, **options).select(F.col(id_col).alias("__hit")).where("__hit IS NOT NULL").distinct(), "leak-hits")
    return docs.join(sized(hit), docs[id_col] == hit["__hit"], "left_anti")
