"""N-gram Jaccard join by PartEnum signatures, and the groups that its links form.

Each text becomes the set of hashes of its distinct word n-grams. Two sets of sizes a and b
with similarity s or more differ in at most (a + b) (1 - s) / (1 + s) elements. Sizes fall into bands
[l, l / s]; a pair lies in one band or two neighbouring ones, so each set is signed for its
own band and the next, with k the greatest difference there. The element domain is parted by
hash into h + 1 + 2 m parts (h = k // 2, m = h // 8): two such sets agree but for one difference at
most in 2 m + 1 of them. Each set leaves out the m parts whose signatures hold fewest elements, which
say least, so one agreeing part is left in both. Each part has three cells: leaving out each cell in turn gives
three signatures a part, one of which a similar pair shares. Sets that share one are compared exactly.

Texts with one set are one class, so copies cost nothing beyond their first pass. Within a bucket of
classes that share a signature not all pairs are compared: a few pivots are compared with the rest,
the links join groups, and only members of different groups go on to the next round with
more pivots, until no bucket holds two groups with a pair not compared. No link between two
groups is lost, and a large group of near copies costs as many comparisons as it has members.

A large bucket is split over tasks, each of which has its pivots. Classes and n-grams are known by 64-bit hashes.

Edge cases: null and empty texts have no n-grams and link with nothing; a text with fewer than n words is
one n-gram; very long texts are read whole; repeated rows share a class (with the least id); ties don't matter, as every
link counts; a null id links like any other but gives no component id; one id on several texts stands for each of them; an
empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import wordhash
from .common import chunks, components, dropped, map_arrow, sized, staged, starts_of

CHUNK_BYTES = 400_000
CELLS = 3
#: Rows of one bucket that a task reads at most; larger buckets are split.
BUCKET_ROWS = 1000
_PART, _CELL, _SUM, _SET = (np.uint64(x) for x in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179, 0x9B05688C2B3E6C1F, 0x510E527FADE682D1))


def gram_sets(texts: list[str | None], n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For chunks a:b of the texts: all sets one after another (sorted hashes) and their sizes."""
    coded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    for a, b in chunks(np.array([len(t) for t in coded], np.int64), CHUNK_BYTES):
        w = wordhash.words(coded[a:b])
        count = w.counts()
        grams, first = wordhash.ngrams(w, n)
        owner = w.owner[first]
        begin = starts_of(count)
        for m in range(1, n):  # a text of m words, fewer than n, is one n-gram
            few = np.flatnonzero(count == m)
            if len(few):
                h = np.full(len(few), m, np.uint64)
                for j in range(m):
                    h += w.hash[begin[few] + j] * wordhash.PLACES[j]
                grams, owner = np.r_[grams, wordhash.mix(h)], np.r_[owner, few]
        order = np.lexsort((grams, owner))
        grams, owner = grams[order], owner[order]
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
        yield a, b, grams[new], np.bincount(owner[new], minlength=b - a)


def set_keys(grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One hash for each set, whatever its order; of no meaning for empty sets."""
    sums = np.zeros(len(grams) + 1, np.uint64)
    np.cumsum(wordhash.mix(grams ^ _SET), out=sums[1:])
    at = starts_of(sizes)
    return wordhash.mix(sums[at[1:]] - sums[at[:-1]] + sizes.astype(np.uint64) * _PART)


class Bands:
    """Size bands of a threshold given in hundredths, and each band's greatest difference."""

    def __init__(self, percent: int):
        self.percent = percent
        self.low = [1]
        self.most: list[int] = []

    def of(self, sizes: np.ndarray) -> np.ndarray:
        """Band of each size, from 0; sizes are at least 1."""
        top = int(sizes.max(initial=1))
        while len(self.low) < 3 or self.low[-3] <= top:
            self.low.append(self.low[-1] * 100 // self.percent + 1)
        self.most = [2 * (x - 1) * (100 - self.percent) // (100 + self.percent) for x in self.low[1:]]
        return np.searchsorted(np.array(self.low), sizes, side="right") - 1


def signatures(grams: np.ndarray, sizes: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Signature and set index of every signature of the sets that aren't empty."""
    if not len(grams):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    band = bands.of(np.maximum(sizes, 1))
    part, cell = wordhash.mix(grams ^ _PART), (wordhash.mix(grams ^ _CELL) % np.uint64(CELLS)).astype(np.int64)
    value = wordhash.mix(grams ^ _SUM)
    most = np.array(bands.most, np.int64)
    out, whose = [], []
    for instance in (band, band + 1):
        k = most[instance]
        half = k // 2
        spare = half // 8
        parts = np.where(sizes > 0, half + 1 + 2 * spare, 0)
        at = starts_of(parts)
        row = at[owner] + (part % parts[owner].astype(np.uint64)).astype(np.int64)
        sums = np.zeros(at[-1] * CELLS, np.uint64)
        np.add.at(sums, row * CELLS + cell, value)
        sums = sums.reshape(-1, CELLS)
        mine = np.repeat(np.arange(len(sizes)), parts)
        number = np.arange(at[-1]) - at[mine]
        held = np.bincount(row * CELLS + cell, minlength=at[-1] * CELLS).reshape(-1, CELLS)
        held = held.sum(axis=1) - held.max(axis=1)  # elements in the least of the part's signatures
        order = np.argsort(mine * (int(held.max(initial=0)) + 1) + held, kind="stable")
        left = np.sort(order[number >= spare[mine]])  # in that order too, `number` counts within a set
        sums, mine, number = sums[left], mine[left], number[left]
        total = sums.sum(axis=1, dtype=np.uint64)
        salt = (instance[mine].astype(np.uint64) * wordhash.PLACES[0]) + (number.astype(np.uint64) * wordhash.PLACES[1])
        exact = k[mine] == 0
        out.append(wordhash.mix(total[exact] * wordhash.PLACES[2] + salt[exact]))
        whose.append(mine[exact])
        for j in range(CELLS):
            out.append(wordhash.mix((total - sums[:, j])[~exact] * wordhash.PLACES[2] + salt[~exact] + np.uint64(j + 1) * wordhash.PLACES[3:4]))
            whose.append(mine[~exact])
    return np.concatenate(out), np.concatenate(whose)


def _signed(batches: Iterator[pa.RecordBatch], n: int, percent: int) -> Iterator[pa.RecordBatch]:
    bands = Bands(percent)
    for batch in batches:
        for _, _, grams, sizes in gram_sets(batch.column(0).to_pylist(), n):
            sig, whose = signatures(grams, sizes, bands)
            key = set_keys(grams, sizes)
            yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(key[whose].view(np.int64))], ["sig", "node"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (sig, node): the distinct ones whose sig has two nodes at least."""
    last_sig, last_node, told = None, None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        sig, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if last_sig is not None:
            sig, node = np.r_[last_sig, sig], np.r_[last_node, node]
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
        sig, node = sig[new], node[new]
        same = np.zeros(len(sig) + 1, bool)
        same[1:-1] = sig[1:] == sig[:-1]
        keep = same[:-1] | same[1:]
        carried = told
        if last_sig is not None and carried:
            keep[0] = False  # given with the batch before
        last_sig, last_node = sig[-1], node[-1]
        told = bool(keep[-1]) or (len(sig) == 1 and carried)
        yield pa.RecordBatch.from_arrays([pa.array(sig[keep]), pa.array(node[keep])], ["sig", "node"])


def sketches(grams: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """For each set, the parities of its elements in as many cells as the next power of two from four times its size.

    An element that only one of two sets has changes one parity, so sets differ in as many elements at
    least as their sketches in bits. A longer sketch folds onto a shorter one by exclusive or of its halves.
    """
    out, at = [], starts_of(sizes).tolist()
    place = wordhash.mix(grams ^ _CELL)
    for a, b in zip(at[:-1], at[1:], strict=True):
        bits = max(64, 1 << max(0, 4 * (b - a) - 1).bit_length())
        odd = np.bincount((place[a:b] & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
        out.append(np.packbits(odd.astype(np.uint8), bitorder="little").tobytes())
    return out


def may_link(n: int, x: bytes, m: int, y: bytes, percent: int) -> bool:
    """False only where sets of sizes n and m with these sketches are surely less similar than percent / 100."""
    if 100 * min(n, m) < percent * max(n, m):
        return False
    long, short = (x, y) if len(x) >= len(y) else (y, x)
    value, size = int.from_bytes(long, "little"), len(long)
    while size > len(short):
        size //= 2
        value = (value & ((1 << 8 * size) - 1)) ^ (value >> 8 * size)
    return (value ^ int.from_bytes(short, "little")).bit_count() * (100 + percent) <= (n + m) * (100 - percent)


def _paired(batches: Iterator[pa.RecordBatch], pivots: int, percent: int, sketched: bool) -> Iterator[pa.RecordBatch]:
    """Of rows (sig, part, pivot, comp, node, n, sketch) sorted by these: pairs of a bucket's pivots with all other rows
    that are of another group and may be similar (sig is null), and the rows that were no pivots (b is null).

    The pivots are the first `pivots` rows of a bucket; where it is split into parts they stand, marked, in each.
    """
    bucket, held, split = None, [], False
    for batch in batches:
        a, b, rest_sig, rest_node = [], [], [], []
        columns = [batch.column(k).to_pylist() for k in range(7 if sketched else 6)]
        if not sketched:
            columns.append([b""] * batch.num_rows)
        for sig, part, marked, comp, node, n, sketch in zip(*columns, strict=True):
            if (sig, part) != bucket:
                bucket, held, split = (sig, part), [], marked
            if not (marked and part):  # pivots meet each other in the first part only
                for own, pivot, m, other in held:
                    if own != comp and (not sketched or may_link(n, sketch, m, other, percent)):
                        a.append(min(pivot, node))
                        b.append(max(pivot, node))
            if marked if split else len(held) < pivots:
                held.append((comp, node, n, sketch))
            else:
                rest_sig.append(sig)
                rest_node.append(node)
            if len(a) > 100_000:
                yield _pair_rows(a, b, [], [])
                a, b = [], []
        yield _pair_rows(a, b, rest_sig, rest_node)


def _dealt(rows: DataFrame, buckets: DataFrame, pivots: int, columns: list[str]) -> DataFrame:
    """Rows of the buckets (sig, node) in the order that _paired wants; a bucket over BUCKET_ROWS is split into parts of about that
    size, each with all its pivots, so that no task reads a large bucket alone."""
    large = staged(buckets.groupBy("sig").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > BUCKET_ROWS), "join-large")
    if large.isEmpty():
        rows = rows.withColumn("part", F.lit(0)).withColumn("pivot", F.lit(False))
    else:
        sized_large = sized(large)
        plain = rows.join(sized_large, "sig", "left_anti").withColumn("part", F.lit(0)).withColumn("pivot", F.lit(False))
        parts = F.ceil(F.col("__n") / BUCKET_ROWS).cast("int")
        split = rows.join(sized_large, "sig").withColumn("__parts", parts).drop("__n")
        order = Window.partitionBy("sig").orderBy(F.desc("degree"), "node")
        chosen = split.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= pivots).drop("__r")
        chosen = staged(chosen, "join-pivots")
        others = split.join(sized(chosen.select("sig", "node")), ["sig", "node"], "left_anti")
        others = others.withColumn("part", F.pmod(F.xxhash64("node"), F.col("__parts")).cast("int")).withColumn("pivot", F.lit(False))
        everywhere = chosen.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).withColumn("pivot", F.lit(True))
        rows = plain.unionByName(others.drop("__parts")).unionByName(everywhere.drop("__parts"))
    return rows.repartition("sig", "part").sortWithinPartitions("sig", "part", F.desc("pivot"), F.desc("degree"), "node").select("sig", "part", "pivot", *columns)


def _likely(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of pairs (a, b, n, x, m, y): those that their sketches don't rule out."""
    for batch in batches:
        n, x, m, y = (batch.column(k).to_pylist() for k in range(2, 6))
        keep = pa.array([may_link(*v, percent) for v in zip(n, x, m, y, strict=True)], pa.bool_())
        yield batch.select(["a", "b"]).filter(keep)


def _pair_rows(a: list[int], b: list[int], sig: list[int], node: list[int]) -> pa.RecordBatch:
    none = lambda n: pa.nulls(n, pa.int64())
    both = lambda x, y: pa.concat_arrays([x, y])
    return pa.RecordBatch.from_arrays([both(none(len(a)), pa.array(sig, pa.int64())), both(pa.array(a, pa.int64()), pa.array(node, pa.int64())), both(pa.array(b, pa.int64()), none(len(sig)))], ["sig", "a", "b"])


def _open(rows: DataFrame) -> DataFrame:
    """The rows of buckets (sig) that hold more than one group (comp)."""
    live = rows.groupBy("sig").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("sig")
    return rows.join(live, "sig", "left_semi")


def join_groups(docs: DataFrame, n: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id of every document, for links at a similarity of percent / 100."""
    source = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    id_type = docs.schema[id_col].dataType.simpleString()

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, grams, sizes in gram_sets(batch.column(1).to_pylist(), n):
                key = pa.array(set_keys(grams, sizes).view(np.int64), pa.int64(), mask=sizes == 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sizes, pa.int64()), key], ["__id", "n_shingles", "node"])

    rows = staged(map_arrow(source, keyed, f"__id {id_type}, n_shingles long, node long"), "join-rows")
    classes = staged(rows.where("node IS NOT NULL").groupBy("node").agg(F.min("__id").alias("least"), F.count(F.lit(1)).alias("c")), "join-classes")
    several = classes.where("c > 1").select("node", "least")
    several = sized(several)
    copies = staged(rows.join(several, "node").where("__id > least").groupBy("__id").agg(F.count(F.lit(1)).alias("k")), "join-copies")
    # An id may stand on other texts too, which are to be signed: only ids of nothing but copies are left out.
    total = rows.join(sized(copies.select("__id")), "__id", "left_semi").groupBy("__id").agg(F.count(F.lit(1)).alias("all"))
    spare = copies.join(total, "__id").where("k = all").select("__id")
    singles = source.join(sized(staged(spare, "join-spare")), "__id", "left_anti")

    signed = map_arrow(singles.select("__text"), lambda it: _signed(it, n, percent), "sig long, node long")
    buckets = staged(map_arrow(signed.repartition("sig").sortWithinPartitions("sig", "node"), _shared, "sig long, node long"), "join-buckets")

    def texts_of(nodes: DataFrame, name: str) -> DataFrame:
        """One text of each class."""
        ids = staged(nodes.join(classes, "node").select(F.col("least").alias("__id")), name)
        found = source.join(sized(ids.where("__id IS NOT NULL")), "__id", "left_semi").select("__text")
        # Classes whose ids are all null are few or none: their texts are found among those without an id.
        return found if ids.where("__id IS NULL").isEmpty() else found.unionAll(source.where("__id IS NULL").select("__text"))

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, grams, sizes in gram_sets(batch.column(0).to_pylist(), n):
                yield pa.RecordBatch.from_arrays([pa.array(set_keys(grams, sizes).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(sketches(grams, sizes), pa.binary())], ["node", "n", "sketch"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, grams, sizes in gram_sets(batch.column(0).to_pylist(), n):
                values = pa.ListArray.from_arrays(pa.array(starts_of(sizes), pa.int32()), pa.array(grams.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(set_keys(grams, sizes).view(np.int64)), values], ["node", "grams"])

    # The more signatures a class shares, the nearer it stands to the middle of its group: those are pivots first.
    degrees = staged(buckets.groupBy("node").agg(F.count(F.lit(1)).alias("degree")), "join-degrees")
    facts = map_arrow(texts_of(degrees.select("node"), "join-met"), sketched, "node long, n long, sketch binary")
    facts = staged(facts.dropDuplicates(["node"]).join(degrees, "node"), "join-facts")
    ranks = sized(facts.select("node", "degree", "n"))

    comps, links, pivots = None, None, 1
    while True:
        later = pivots > 1
        if not later:
            rows_now = buckets.join(ranks, "node").select("sig", F.col("node").alias("comp"), "node", "n", "degree")
        else:
            labelled = buckets.join(sized(comps), "node", "left").select("sig", F.coalesce("component", "node").alias("comp"), "node")
            rows_now = _open(staged(labelled, "join-open")).join(facts, "node")
        ordered = _dealt(rows_now, buckets, pivots, ["comp", "node", "n", *(["sketch"] if later else [])])
        step = staged(map_arrow(ordered, lambda it, p=pivots, later=later: _paired(it, p, percent, later), "sig long, a long, b long"), "join-step")
        pairs = step.where("b IS NOT NULL").select("a", "b").distinct()
        if not later:  # otherwise the sketches were seen already
            x, y = facts.select(F.col("node").alias("a"), F.col("n").alias("n"), F.col("sketch").alias("x")), facts.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("y"))
            pairs = map_arrow(pairs.join(x, "a").join(y, "b").select("a", "b", "n", "x", "m", "y"), lambda it: _likely(it, percent), "a long, b long")
        pairs = staged(pairs, "join-pairs")
        needed = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct()
        held = staged(map_arrow(texts_of(needed, "join-wanted"), sets, "node long, grams array<long>").dropDuplicates(["node"]), "join-sets")
        left, right = (held.select(F.col("node").alias(x), F.col("grams").alias(f"g{x}")) for x in "ab")
        alike = F.size(F.array_intersect("ga", "gb")) * (100 + percent) >= (F.size("ga") + F.size("gb")) * percent
        found = staged(pairs.join(left, "a").join(right, "b").where(alike).select(F.col("a").alias("u"), F.col("b").alias("v")), "join-links")
        dropped(held, pairs)
        links = found if links is None else links.unionAll(found)
        if not found.isEmpty():
            comps = components(links, "join-components")
        buckets = step.where("b IS NULL").select("sig", F.col("a").alias("node"))
        if buckets.isEmpty():
            break
        if comps is None:
            comps = buckets.sparkSession.createDataFrame([], "node long, component long")
        pivots *= 30

    dropped(facts, step)
    ids = classes.select("node", "least")
    if comps is not None and not comps.isEmpty():
        ids = ids.join(sized(comps), "node", "left").withColumn("__comp", F.coalesce("component", "node"))
        top = ids.groupBy("__comp").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("k")).where("k > 1").select("__comp", "component_id")
        ids = ids.join(sized(staged(top, "join-top")), "__comp", "left").select("node", F.coalesce("component_id", "least").alias("component_id"))
    else:
        ids = ids.withColumnRenamed("least", "component_id")
    # Most classes have one document, which is its own group: only the others need a join.
    ids = staged(ids.join(classes.select("node", "least", "c"), "node").where("c > 1 OR component_id <> least").select("node", "component_id"), "join-ids")
    out = rows.join(sized(ids), "node", "left")
    return out.select(F.col("__id").alias(id_col), "n_shingles", F.coalesce("component_id", "__id").alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents of each group with its least id, with all their columns; null ids stay, and so do repeated rows of that id."""
    extra = join_groups(docs, n, percent, id_col, text_col).where(f"component_id < `{id_col}`").select(F.col(id_col).alias("__gone"))
    gone = staged(extra, "join-gone")
    return docs.join(sized(gone), docs[id_col] == gone["__gone"], "left_anti")
