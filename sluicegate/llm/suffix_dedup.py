"""Repeated passages by sparse suffix arrays.

Of each text's word suffixes only those at minimiser positions are kept: in every run of
`gap` places the word n-gram with the least hash, so the choice depends on content alone and
equal passages choose equal places. A passage of `least` words or more holds such a place within its
first `gap` places. Suffixes are sorted by what stands at their head, least - gap + 1 words, and
neighbours are compared; those equal to a neighbour of another text are extended to the left, as far
back as the place before them, and to the right to `least` words; these extended windows are sorted and compared
in their turn. A window that two different texts hold is a repeated passage, and overlapping
ones unite to the longest. The text with the least id is a passage's first holder.

Equal texts are one class with one representative; its copies are repeats as a whole. Words
are runs of non-white space, case of A-Z apart. Order and equality of heads, windows and texts go by two independent
64-bit hashes of their words together, 128 bits: only which suffixes are neighbours matters, not the alphabet, and
among 10^13 of them a false match is expected 10^-13 times.

Edge cases: null, empty and short texts hold no passage; very long texts are read whole; a passage repeated only inside
one text is left alone; ids are whole numbers, and a null id is no holder and is left as it is; repeated rows (same id) count
as one text; ties go to the least id; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .common import chunks, dropped, map_arrow, sized, staged, starts_of

CHUNK_BYTES = 400_000
#: A key with fewer rows than this is never treated as hot.
HOT_ROWS = 10_000
#: Words of the n-grams whose least hash selects a place.
GRAM = 3
_SECOND = np.uint64(0x2545F4914F6CDD1D)
_ROWS = "key long, also long, id long, at int, size int"


class Runs:
    """Two independent 64-bit hashes of any run of words, from prefix sums and falling powers."""

    def __init__(self, hashes: np.ndarray):
        up, self._down = wordhash._powers(len(hashes) + 1)
        self._sums = []
        for own in (hashes, wordhash.mix(hashes ^ _SECOND)):
            sums = np.zeros(len(hashes) + 1, np.uint64)
            np.cumsum(own * up[: len(hashes)], out=sums[1:])
            self._sums.append(sums)

    def of(self, begin: np.ndarray, size: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        """Both hashes, as signed numbers, of the `size` words from each place; equal runs have equal hashes."""
        fall, length = self._down[begin], np.asarray(size, np.uint64)
        one, two = (wordhash.mix((s[begin + size] - s[begin]) * fall + length) for s in self._sums)
        return one.view(np.int64), two.view(np.int64)


def places(w: wordhash.Words, least: int, gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word index of every selected place, of the first window start that it stands for, and how many it stands for.

    A window start is a place with `least` words of its text from there on; it belongs to the
    place selected in the run of `gap` places that begins with it.
    """
    gram = _gram_hashes(w)
    n = len(gram)
    count = w.counts()
    end = starts_of(count)[1:][w.owner]
    starts = np.flatnonzero(np.arange(len(w.hash)) + least <= end)
    if not len(starts) or n < gap:
        return (np.zeros(0, np.int64),) * 3
    # The rightmost least of each run, by folding doubled runs: value and place in one comparison.
    value, at = gram.copy(), np.arange(n)
    covered = 1
    while covered < gap:
        step = min(covered, gap - covered)
        m = len(value) - step
        other = value[step:] <= value[:m]
        value, at = np.where(other, value[step:], value[:m]), np.where(other, at[step:], at[:m])
        covered += step
    chosen = at[starts]
    new = np.r_[True, chosen[1:] != chosen[:-1]]
    first = np.flatnonzero(new)
    return chosen[new], starts[first], np.diff(np.r_[first, len(starts)])


def _gram_hashes(w: wordhash.Words) -> np.ndarray:
    m = max(len(w.hash) - GRAM + 1, 0)
    h = np.zeros(m, np.uint64)
    for j in range(GRAM):
        h += w.hash[j : j + m] * wordhash.PLACES[j]
    return wordhash.mix(h)


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int, wordhash.Words]]:
    coded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    for a, b in chunks(np.array([len(t) for t in coded], np.int64), CHUNK_BYTES):
        yield a, b, wordhash.words(coded[a:b])


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (key, also, id): those whose (key, also) has two ids at least, with the first of them.

    Columns key, also, id, at, size in; id, at, size, first out. Only the rows of a key's first id wait in
    memory until a second id comes, and they are of one text.
    """
    held_key, held_id, told = None, None, False
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key, also, who, at, size = (batch.column(k).to_numpy() for k in range(5))
        new = (key[1:] != key[:-1]) | (also[1:] != also[:-1])
        edges = np.flatnonzero(np.r_[True, new])
        group = np.cumsum(np.r_[0, new.astype(np.int64)])
        goes_on = (key[0], also[0]) == held_key
        first = who[edges][group]
        if goes_on:
            first[group == 0] = held_id
        last_of = np.r_[edges[1:], len(key)] - 1
        several = who[last_of] != first[last_of]
        out_id, out_at, out_size, out_first = [], [], [], []
        if goes_on and (several[0] or told):
            for a, s in waiting:
                out_id.append(np.full(len(a), held_id))
                out_at.append(a)
                out_size.append(s)
                out_first.append(np.full(len(a), held_id))
            waiting, told = [], True
            several[0] = True
        keep = several[group]
        out_id.append(who[keep])
        out_at.append(at[keep])
        out_size.append(size[keep])
        out_first.append(first[keep])
        if not goes_on or len(edges) > 1:
            held_key, held_id, told, waiting = (key[-1], also[-1]), first[-1], bool(several[-1]), []
        if not told:
            tail = group == group[-1]
            waiting.append((at[tail].copy(), size[tail].copy()))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), t) for x, t in zip((out_id, out_at, out_size, out_first), (pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["id", "at", "size", "first"])


def _sorted_repeats(rows: DataFrame, name: str) -> DataFrame:
    """Neighbours compared in sorted order: key, also, id, at, size in; the repeated rows and their first id out.

    A key with over a thousandth of all rows (there are a thousand such at most, so they go to the driver)
    would be one task's work: its least and greatest id come from partial aggregation instead, and its rows
    stay where they are and are told the first.
    """
    rows = staged(rows, name)
    most = max(HOT_ROWS, rows.count() // 1000)
    hot = [r["key"] for r in rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("key").collect()]
    cold = rows.where(~F.col("key").isin(hot)) if hot else rows
    out = map_arrow(cold.repartition("key").sortWithinPartitions("key", "also", "id", "at"), _repeated, "id long, at int, size int, first long")
    if hot:
        warm = rows.where(F.col("key").isin(hot))
        ends = warm.groupBy("key", "also").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").collect()
        shared = rows.sparkSession.sparkContext.broadcast({(r["key"], r["also"]): r["first"] for r in ends})

        def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                first = [shared.value.get(k) for k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
                given = pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(first, pa.int64())], ["id", "at", "size", "first"])
                yield given.filter(given.column(3).is_valid())

        out = out.unionAll(map_arrow(warm, told, "id long, at int, size int, first long"))
    return out


def _spans(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Windows of one text (at, first) united to spans: (begin, end, first) of passages held first by another, and of own ones."""
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("first", pa.int64())]))
    for batch in batches:
        out = []
        for who, windows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            spans: list[list[int]] = []
            for x in sorted((v["at"], v["first"]) for v in windows):
                own = x[1] == who
                last = spans[-1] if spans else None
                if last and x[0] <= last[1] and own == (last[2] == who):
                    last[1] = x[0] + least
                    last[2] = min(last[2], x[1])
                else:
                    spans.append([x[0], x[0] + least, x[1]])
            out.append([{"begin": a, "end": b, "first": f} for a, b, f in spans])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["id", "spans"])


def repeats(docs: DataFrame, least: int = 50, gap: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document that holds a repeated passage of `least` words or more.

    id; n_words; n_repeated (words in repeated passages); n_later (those of them whose first holder is another
    document); copy_of (the least id with the same words throughout, if another); spans, an array of (begin, end, first):
    places in words and the passage's first holder.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("__text")).where("id IS NOT NULL")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w in _chunks(batch.column(1).to_pylist()):
                at = starts_of(w.counts())
                whole, also = Runs(w.hash).of(at[:-1], np.diff(at))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(at).astype(np.int32)), pa.array(whole), pa.array(also)], ["id", "n_words", "whole", "also"])

    rows = staged(map_arrow(source, keyed, "id long, n_words int, whole long, also long").where(F.col("n_words") >= least), "suffix-rows")
    copied = staged(rows.groupBy("whole", "also").agg(F.min("id").alias("rep"), F.max("id").alias("__most")).where("rep < __most").select("whole", "also", "rep"), "suffix-copied")
    copies = staged(rows.join(sized(copied), ["whole", "also"]).where("id > rep").select("id", "n_words", "rep"), "suffix-copies")
    singles = source.join(sized(copies.select("id")), "id", "left_anti")

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            who = batch.column(0).to_numpy()
            for a, b, w in _chunks(batch.column(1).to_pylist()):
                place, first, size = places(w, least, gap)
                key, also = Runs(w.hash).of(place, least - gap + 1)
                owner = w.owner[place]
                at = first - starts_of(w.counts())[owner]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(also), pa.array(who[a:b][owner]), pa.array(at.astype(np.int32)), pa.array(size.astype(np.int32))], ["key", "also", "id", "at", "size"])

    met = staged(_sorted_repeats(map_arrow(singles, heads, _ROWS), "suffix-head-rows"), "suffix-heads")
    per_text = met.groupBy("id").agg(F.collect_list(F.struct("at", "size")).alias("places"))
    extended = singles.join(per_text.hint("shuffle_hash"), "id").select("id", "__text", "places")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            who = batch.column(0).to_numpy()
            held = batch.column(2)
            for a, b, w in _chunks(batch.column(1).to_pylist()):
                base = starts_of(w.counts())
                part = held.slice(a, b - a)
                flat = part.flatten()
                own = np.repeat(np.arange(b - a), np.asarray(pc.list_value_length(part)))
                at, size = flat.field(0).to_numpy().astype(np.int64), flat.field(1).to_numpy().astype(np.int64)
                begin = np.repeat(at, size)
                begin += np.arange(len(begin)) - np.repeat(starts_of(size)[:-1], size)
                own = np.repeat(own, size)
                key, also = Runs(w.hash).of(base[own] + begin, least)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(also), pa.array(who[a:b][own]), pa.array(begin.astype(np.int32)), pa.array(np.full(len(own), 1, np.int32))], ["key", "also", "id", "at", "size"])

    found = _sorted_repeats(map_arrow(extended, windows, _ROWS), "suffix-window-rows")
    spans = found.groupBy("id").agg(F.collect_list(F.struct("at", "first")).alias("windows"))
    spans = staged(map_arrow(spans, lambda it: _spans(it, least), "id long, spans array<struct<begin:int,end:int,first:long>>"), "suffix-spans")
    dropped(met)

    whole = copies.select("id", "n_words", F.col("rep").alias("copy_of"), F.array(F.struct(F.lit(0).alias("begin"), F.col("n_words").alias("end"), F.col("rep").alias("first"))).alias("spans"))
    sources = copied.select(F.col("rep").alias("id")).distinct().withColumn("__copied", F.lit(True))
    parts = spans.join(sources, "id", "full").join(rows.groupBy("id").agg(F.max("n_words").alias("n_words")), "id")
    own = F.array(F.struct(F.lit(0).alias("begin"), F.col("n_words").alias("end"), F.col("id").alias("first")))
    # A representative of copies is a repeated passage as a whole, whose own share is all that no one holds before it.
    parts = parts.select("id", "n_words", F.lit(None).cast("long").alias("copy_of"), F.when(F.col("__copied"), F.concat(F.coalesce(F.filter("spans", lambda s: s["first"] != F.col("id")), F.array().cast("array<struct<begin:int,end:int,first:bigint>>")), own)).otherwise(F.col("spans")).alias("spans"))
    out = whole.unionAll(parts)
    covered = lambda s: F.aggregate(F.array_sort(s), F.struct(F.lit(0).alias("n"), F.lit(0).alias("e")), lambda acc, x: F.struct((acc["n"] + F.greatest(x["end"] - F.greatest(x["begin"], acc["e"]), F.lit(0))).alias("n"), F.greatest(acc["e"], x["end"]).alias("e")), lambda acc: acc["n"])
    later = F.filter("spans", lambda s: s["first"] != F.col("id"))
    return out.select(F.col("id").alias(id_col), "n_words", covered(F.col("spans")).alias("n_repeated"), covered(later).alias("n_later"), "copy_of", "spans")


def deduplicate(docs: DataFrame, least: int = 50, gap: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with each repeated passage left only in its first holder, all columns kept.

    A text that loses passages keeps its other words as they stood, lines and spaces around a cut
    shrunk to one line feed; a document of which nothing is left goes.
    """
    found = repeats(docs, least, gap, id_col, text_col)
    cuts = staged(found.where("n_later > 0").select(F.col(id_col).alias("__id"), F.filter("spans", lambda s: s["first"] != F.col(id_col)).alias("__spans")), "suffix-cuts")
    names = docs.columns
    joined = docs.join(sized(cuts), docs[id_col] == cuts["__id"], "left").select(*(docs[c] for c in names), F.col("__spans").alias("__spans"))
    touched = joined.where("__spans IS NOT NULL")
    schema = docs.schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = names.index(text_col)
        for batch in batches:
            texts = [cut_text(t, [(s["begin"], s["end"]) for s in spans]) for t, spans in zip(batch.column(place).to_pylist(), batch.column(len(names)).to_pylist(), strict=True)]
            keep = [k for k, t in enumerate(texts) if t]
            columns = list(batch.columns[:-1])
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([c.take(pa.array(keep, pa.int64())) for c in columns], names)

    return joined.where("__spans IS NULL").drop("__spans").unionByName(map_arrow(touched, cut, schema))


def cut_text(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans."""
    w = wordhash.words([text.encode("utf-8", "surrogatepass")])
    gone = np.zeros(len(w.hash) + 1, bool)
    for a, b in spans:
        gone[a:b] = True
    edges = np.flatnonzero(np.diff(np.r_[True, gone[:-1], True].astype(np.int8)))
    data = w.data.tobytes()
    return "\n".join(data[w.start[a] : w.end[b - 1]].decode("utf-8", "surrogatepass") for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))
