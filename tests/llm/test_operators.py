"""Each operator against a library, a brute-force version or planted cases, and on odd tables."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict
from math import log1p

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sluicegate.llm import bpe, common, decontaminate, html_extract, langid, ngram_join, quality, queries, suffix_dedup, token_count, topk_search, url_filter

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, at int, node long, key long, hash string, n_tokens long"
ODD = [None, "", " \t\n", "a", "Shti " * 80, "the same words again " * 30, "the same words again " * 30, "é", "<|endoftext|> x", "12 34", "x" * 3000]


def odd_docs(spark):
    """Nulls everywhere, empty and long texts, repeated rows, and columns whose names clash with inner ones."""
    rows = [(k if k != 3 else None, t, [None, "en", "de"][k % 3], None, None, 1, 2, 3, 4, "h", 5) for k, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[5], (0, None, None, None, None, None, None, None, None, None, None)], DOCS)


def documents(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def words(rng, n, size=400):
    return [f"w{int(x)}" for x in rng.zipf(1.3, n) % size]


def corpus(seed, groups=12, single=60):
    """Texts of made-up words: copies, near copies of several strengths, shared passages and singles."""
    rng = np.random.default_rng(seed)
    passages = [words(rng, 70, 4000) for _ in range(4)]
    out = [" ".join(words(rng, int(rng.integers(1, 200)))) for _ in range(single)]
    for g in range(groups):
        base = words(rng, int(rng.integers(30, 300)), 3000)
        for _ in range(int(rng.integers(2, 7))):
            copy = list(base)
            for _ in range(int(rng.integers(0, 1 + len(base) // 15))):
                copy[int(rng.integers(len(copy)))] = f"n{int(rng.integers(1 << 30))}"
            out.append(" ".join(copy))
        if g % 3 == 0:
            p = passages[int(rng.integers(4))]
            out += [" ".join(words(rng, 20, 3000) + p + words(rng, 30, 3000)), " ".join(p[:55] + words(rng, 40, 3000)), " ".join(words(rng, 15, 3000) + p[10:])]
    order = rng.permutation(len(out))
    return [out[k] for k in order]


# Tokenizers


def fuzz(n=600):
    r = random.Random(5)
    near = ["".join(r.choice("ab '’<|endoftext|>éßΣİ  \n\t\x1c̀汉字🙂１²ǅ") for _ in range(r.randrange(60))) for _ in range(n)]
    wide = ["".join(chr(r.choice([r.randrange(32, 0x2000), r.randrange(0x2000, 0xD7FF), r.randrange(0xE000, 0x1FFFF)])) for _ in range(30)) for _ in range(n)]
    return [*near, *wide, "", "a" * 4000, "ab" * 3000, " " * 3000 + "x", "<|endoftext|><|startoftext|>x", "DON'T don't 1234"]


def test_bpe_matches_library():
    own, library = bpe.WordBPE(bpe.tables_of(open(WORD).read())), Tokenizer.from_file(WORD)
    texts = fuzz()
    ids, counts = own.encode_batch(texts)
    decoded, decimals = own.decode_batch(ids, counts), own.decimal_batch(ids, counts)
    for k, e in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        assert decimals[k].decode() == " ".join(map(str, e.ids))
        assert decoded[k].decode() == library.decode(e.ids, skip_special_tokens=False)


def test_token_counts_match_library():
    own, library = token_count.ByteBPECounter(open(BYTE).read()), Tokenizer.from_file(BYTE)
    texts = fuzz()
    assert own.count_batch(texts).tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_bpe_query_columns(spark):
    library = Tokenizer.from_file(WORD)
    got = bpe.encode(odd_docs(spark), WORD, with_text=True, carry=("hash",)).collect()
    assert len(got) == len(ODD) + 2
    for r in got:
        if r.doc_id == 4:
            ids = library.encode(ODD[4], add_special_tokens=False).ids
            assert r.ids == ids and r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
            assert r.decoded == library.decode(ids, skip_special_tokens=False)
    empty = next(r for r in got if r.doc_id == 1)
    assert empty.n_tokens == 0 and empty.decoded == "" and empty.ids_sha256 == hashlib.sha256(b"").hexdigest()


def test_very_long_texts(spark):
    """One text of a megabyte among short ones: tokens, languages, sets, repeats and matches of the whole of it."""
    rng = np.random.default_rng(11)
    long = " ".join(words(rng, 160_000, 50_000))
    tail = " ".join(f"t{k}" for k in range(60))
    docs = documents(spark, [long + " " + tail, "short " + tail, long + " " + tail])
    for file, run in ((WORD, lambda: bpe.encode(docs, WORD)), (BYTE, lambda: token_count.count_tokens(docs, BYTE))):
        library = Tokenizer.from_file(file)
        for r in run().collect():
            assert r.n_tokens == len(library.encode("short " + tail if r.doc_id == 1 else long + " " + tail, add_special_tokens=False).ids)
    assert {r.doc_id: r.component_id for r in ngram_join.join_groups(docs).collect()} == {0: 0, 1: 1, 2: 0}
    found = {r.doc_id: (r.copy_of, r.n_later) for r in suffix_dedup.repeats(docs).collect()}
    assert found == {0: (None, 0), 1: (None, 60), 2: (0, 160_060)}
    bench = spark.createDataFrame([(1, " ".join(f"T{k}" for k in range(20, 40)))], "item_id int, text string")
    assert {r.doc_id for r in decontaminate.matches(docs, bench).collect()} == {0, 1, 2}
    assert {r.doc_id for r in topk_search.search(docs, F.col("doc_id") == 1, k=3).collect()} == {0, 1, 2}


def test_carried_columns_give_way(spark):
    docs = spark.createDataFrame([(1, "a b", "old", 3)], "doc_id long, text string, ids_sha256 string, n_tokens long")
    assert bpe.encode(docs, WORD, carry=("n_tokens", "text", "ids_sha256")).columns == ["doc_id", "text", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]


def test_token_count_query(spark):
    got = {r.doc_id: r for r in token_count.count_tokens(odd_docs(spark), BYTE, limit=50).collect()}
    assert got[0].n_tokens == 0 and got[0].n_bytes == 0 and got[7].n_bytes == 2 and got[8].n_tokens == 2
    assert got[4].over_limit and not got[8].over_limit


# N-gram join


def joined(texts, n, percent):
    """Component of each text by comparing all pairs that share an n-gram."""
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            c = len(sets[a] & sets[b])
            if c and 100 * c >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(s), find(k)) for k, s in enumerate(sets)}


@pytest.mark.parametrize("n, percent, seed", [(3, 90, 1), (5, 80, 2)])
def test_join_matches_all_pairs(spark, n, percent, seed):
    texts = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join_groups(documents(spark, texts), n, percent).collect()}
    assert got == joined(texts, n, percent)


def test_join_large_group(spark, monkeypatch):
    """A group of near copies with outliers, its buckets split: exact, and far fewer comparisons than pairs."""
    monkeypatch.setattr(ngram_join, "BUCKET_ROWS", 20)
    rng = np.random.default_rng(9)
    base = words(rng, 120, 10_000)
    texts = []
    for _ in range(250):
        copy = list(base)
        for _ in range(int(rng.integers(0, 5))):
            copy[int(rng.integers(len(copy)))] = f"n{int(rng.integers(1 << 40))}"
        texts.append(" ".join(copy))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join_groups(documents(spark, texts), 3, 90).collect()}
    assert got == joined(texts, 3, 90)


def test_sketches_never_rule_out_links():
    rng = np.random.default_rng(0)
    for _ in range(300):
        a = set(rng.integers(0, 1 << 60, int(rng.integers(1, 300))).tolist())
        b = set(list(a)[: int(len(a) * rng.uniform(0.7, 1))]) | set(rng.integers(0, 1 << 60, int(rng.integers(0, 30))).tolist())
        both = [np.array(sorted(s), np.uint64) for s in (a, b)]
        x, y = ngram_join.sketches(np.concatenate(both), np.array([len(a), len(b)]))
        if 100 * len(a & b) >= 80 * len(a | b):
            assert ngram_join.may_link(len(a), x, len(b), y, 80)


def test_join_odd_rows(spark):
    got = defaultdict(list)
    for r in ngram_join.join_groups(odd_docs(spark)).collect():
        got[r.doc_id].append((r.n_shingles, r.component_id))
    assert got[0] == [(0, 0)] * 2 and got[1] == [(0, 1)] and got[5] == got[5][:1] * 2 and got[6][0][1] == 5 and got[None][0][1] is None
    assert ngram_join.join_groups(documents(spark, []).limit(0)).count() == 0
    kept = ngram_join.keep_one(odd_docs(spark))
    assert kept.columns == odd_docs(spark).columns and kept.where("doc_id = 6").count() == 0


def test_join_null_and_reused_ids(spark):
    text = lambda a, b: " ".join(f"w{k}" for k in range(a, b))
    chain = [(1, text(0, 100)), (None, text(10, 110)), (3, text(20, 120))]  # 1 and 3 are linked by the null id only
    reused = [(4, text(500, 600)), (5, text(500, 600)), (5, text(700, 800)), (7, text(705, 800))]
    docs = spark.createDataFrame([*chain, *reused], "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles): r.component_id for r in ngram_join.join_groups(docs, 1, 80).collect() if r.doc_id in (1, 3, 7)}
    assert got == {(1, 100): 1, (3, 100): 1, (7, 95): 5}


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501)], "u long, v long")
    got = {r.node: r.component for r in common.components(edges).collect()}
    assert set(got.values()) == {0, 500} and len(got) == 203


# Language


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = queries.op3_language_id(spark, "/root/testdata/sf0.001").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(got) > 20 and (got.lang_pred == got.lang).mean() > 0.97 and got.score.between(0, 1).all()


def test_language_bound_spares_rare_languages(spark):
    rows = [(k, f"the common words of text {k}", "en") for k in range(600)] + [(1000 + k, f"wenige seltene zeilen {k}", "de") for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    whole, bounded = langid.fit(docs), langid.fit(docs, max_docs=60)
    assert bounded.languages == ["de", "en"]
    assert np.array_equal(bounded.log_prob[0], whole.log_prob[0]) and not np.array_equal(bounded.log_prob[1], whole.log_prob[1])
    assert langid.even_bound([600, 4], 60) == 56 and langid.even_bound([3, 5], 100) == 5


def test_language_odd_rows(spark):
    docs = odd_docs(spark)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, langid.fit(docs)).collect()}
    assert got[0] == got[1] == got[2] == got[9] == ("und", 0.0) and got[4][0] in ("en", "de")
    nothing = langid.fit(docs.where("false"))
    assert {r.lang_pred for r in langid.predict(docs, nothing).collect()} == {"und"}


def test_language_matches_brute_force(spark):
    """Naive Bayes written out over a dictionary of the same buckets, on held-out rows; accuracy on 0.01 of scale."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", langid.held_out().alias("held")).collect()
    counts, rows = defaultdict(Counter), Counter()
    for r in docs:
        if not r.held and r.lang is not None and r.text is not None:
            rows[r.lang] += 1
            counts[r.lang].update(langid.ngram_buckets([r.text])[0].tolist())
    size = {k: sum(c.values()) + 0.5 * langid.BUCKETS for k, c in counts.items()}
    got = {r.doc_id: (r.lang_pred, r.score) for r in queries.op3_language_id(spark, "/root/testdata/sf0.001").collect()}
    for r in docs:
        grams = langid.ngram_buckets([r.text or ""])[0].tolist()
        if not grams:
            assert got[r.doc_id] == ("und", 0.0)
            continue
        total = {k: np.log(rows[k] / sum(rows.values())) + sum(np.log((counts[k][g] + 0.5) / size[k]) for g in grams) for k in counts}
        best = max(sorted(total), key=total.get)
        assert got[r.doc_id][0] == best
        assert got[r.doc_id][1] == pytest.approx(1 / sum(np.exp(v - total[best]) for v in total.values()), abs=1e-6)


def test_language_blocks_and_clashing_names(spark, monkeypatch):
    """Languages beyond one block of the matrix give the same result; a carried column gives way to a result's name."""
    rng = np.random.default_rng(3)
    rows = [(k, " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26 % 20)}{w}" for w in words(rng, 12)), f"l{k % 500:03d}", "x") for k in range(1000)]
    docs = spark.createDataFrame([*rows, (9000, "12 34", "l001", "x"), (9001, None, None, "x")], "doc_id long, text string, lang string, score string")
    model = langid.fit(docs)
    assert len(model.languages) == 500
    got = langid.predict(docs, model, carry=("doc_id", "score", "text"))
    assert got.columns == ["doc_id", "text", "lang_pred", "score"]
    monkeypatch.setattr(langid, "BLOCK_LANGUAGES", 1000)
    one = {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in langid.predict(docs, model, carry=("doc_id", "score", "text")).collect()}
    assert {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in got.collect()} == one and one[9000] == one[9001] == ("und", 0.0)


def test_language_never_learns_from_held_out(spark):
    docs = spark.createDataFrame([(k, "aaa bbb" if k % 2 else "ccc ddd", "x" if k % 2 else "y") for k in range(60)], "doc_id long, text string, lang string")
    held = {r.doc_id for r in docs.where(langid.held_out()).collect()}
    import zlib

    assert held == {k for k in range(60) if zlib.crc32(str(k).encode()) % 4 == 2}


def test_ngrams_stay_in_their_text():
    both, owner = langid.ngram_buckets(["ab c", "de"])
    for k, text in enumerate(["ab c", "de"]):
        alone, _ = langid.ngram_buckets([text])
        assert sorted(both[owner == k].tolist()) == sorted(alone.tolist())


# Search


def test_search_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "SHARD_CHARS", 3000)
    monkeypatch.setattr(topk_search, "BLOCK_TERMS", 150)
    texts = corpus(4)
    got = defaultdict(list)
    for r in topk_search.search(documents(spark, texts), F.col("doc_id") % 10 == 0, k=7).collect():
        got[r.query_id].append((r["rank"], r.doc_id, r.score))
    bags = [Counter(re.findall(r"[0-9a-z]+", t.lower())) for t in texts]
    df = Counter(w for b in bags for w in b)
    size = [sum(b.values()) for b in bags]
    mean, n = sum(size) / len(size), len(bags)
    for q in range(0, len(texts), 10):
        score = {d: round(sum(log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * b[w] * 2.2 / (b[w] + 1.2 * (0.25 + 0.75 * size[d] / mean)) for w in bags[q] if w in b), 6) for d, b in enumerate(bags)}
        want = sorted(((-s, d) for d, s in score.items() if s > 0))[:7]
        assert [(d, pytest.approx(s, abs=2e-6)) for _, d, s in sorted(got[q])] == [(d, -s) for s, d in want]


def test_search_counts_very_frequent_words(spark):
    """Frequencies beyond 16 bits count in full."""
    texts = ["often", "often " * 200_000 + "other " * 50_000, "other few words"]
    size, tf, df = [1, 250_000, 3], [1, 200_000, 0], 2
    mean = sum(size) / 3
    want = {d: round(log1p((3 - df + 0.5) / (df + 0.5)) * tf[d] * 2.2 / (tf[d] + 1.2 * (0.25 + 0.75 * size[d] / mean)), 6) for d in (0, 1)}
    got = {r.doc_id: r.score for r in topk_search.search(documents(spark, texts), F.col("doc_id") == 0).collect()}
    assert got == pytest.approx(want, abs=1.5e-6)


def test_search_reads_rare_postings_once(monkeypatch):
    """Rare terms are added up in one pass over their postings, whatever the threshold; results are those of all scores."""
    rng = np.random.default_rng(6)
    docs, terms = 500, 900
    held = rng.random((terms, docs)) < np.where(np.arange(terms) < 40, 0.4, 0.01)[:, None]
    held[:, 0] = True
    term, doc = np.nonzero(held)
    tf = rng.integers(1, 5, len(term))
    length = np.bincount(doc, tf, docs).astype(np.int64)
    cells = {"ids": np.arange(docs) * 3, "lengths": length, "terms": np.arange(terms), "counts": held.sum(axis=1).astype(np.int32), "posting_docs": doc.astype(np.int32), "posting_tf": tf.astype(np.uint32)}
    shard = topk_search.Shard({k: v.tobytes() for k, v in cells.items()}, length.mean(), 1.2, 0.75)
    idf, calls, count = rng.uniform(0.1, 3, terms), [], np.bincount
    score = np.zeros((terms, docs))
    score[term, doc] = idf[term] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length[doc] / length.mean()))
    asked = [np.sort(rng.choice(terms, 120, replace=False)) for _ in range(20)]
    want = []
    for q, t in enumerate(asked):
        whole = np.round(score[t].sum(axis=0), 6)
        want += [(q, d * 3, whole[d]) for d in np.lexsort((np.arange(docs), -whole))[:10].tolist()]
    monkeypatch.setattr(topk_search.np, "bincount", lambda *a: calls.append(1) or count(*a))
    at = np.arange(0, 20 * 120 + 1, 120)
    got = shard.search_all(at, np.concatenate(asked), np.concatenate([idf[t] for t in asked]), 10, np.zeros(20))
    assert [(q, d) for q, d, _ in zip(*got, strict=True)] == [(q, d) for q, d, _ in want]
    assert got[2] == pytest.approx([s for _, _, s in want], abs=2e-6) and len(calls) == 1


@pytest.mark.parametrize("pad, cached", [(8, 32_768), (4, 4), (3, 50)])
def test_search_of_padded_postings(monkeypatch, pad, cached):
    """Postings in padded rows, terms given once and a code of each query's terms: the results are those of all scores."""
    monkeypatch.setattr(topk_search, "PAD", pad)
    monkeypatch.setattr(topk_search, "CACHED", cached)
    rng = np.random.default_rng(7)
    docs, terms = 300, 500
    held = rng.random((terms, docs)) < rng.choice([0.002, 0.02, 0.3], terms)[:, None]
    term, doc = np.nonzero(held)
    tf = rng.integers(1, 5, len(term))
    length = np.bincount(doc, tf, docs).astype(np.int64)
    known = np.flatnonzero(held.any(axis=1))
    cells = {"ids": np.arange(docs), "lengths": length, "terms": known, "counts": held.sum(axis=1)[known].astype(np.int32), "posting_docs": doc.astype(np.int32), "posting_tf": tf.astype(np.uint32)}
    shard = topk_search.Shard({k: v.tobytes() for k, v in cells.items()}, length.mean(), 1.2, 0.75)
    idf = rng.uniform(0.1, 3, terms)
    score = np.zeros((terms, docs))
    score[term, doc] = idf[term] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length[doc] / length.mean()))
    asked = [np.sort(rng.choice(terms, n, replace=False)) for n in (1, 3, 200, 40, 90)]
    want = []
    for q, t in enumerate(asked):
        whole = np.round(score[t].sum(axis=0), 6)
        want += [(q, d, pytest.approx(whole[d], abs=2e-6)) for d in np.lexsort((np.arange(docs), -whole))[:10].tolist() if whole[d] > 0]
    at = np.cumsum([0] + [len(t) for t in asked])
    got = shard.search_all(at, np.arange(terms), idf, 10, np.zeros(len(asked)), np.concatenate(asked))
    assert list(zip(*got, strict=True)) == want


def test_search_odd_rows(spark):
    got = topk_search.search(odd_docs(spark), F.lit(True), k=3).collect()
    assert {r.query_id for r in got} == {4, 5, 6, 7, 8, 9, 10}
    assert topk_search.search(documents(spark, []).limit(0), F.lit(True)).count() == 0


# Decontamination


def distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_myers_is_exact():
    r = random.Random(3)
    for _ in range(200):
        p, t = ("".join(r.choice("abc ") for _ in range(r.randrange(1, n))) for n in (40, 90))
        got = decontaminate.best_distance(p, t, len(p))
        assert got[0] == distance(p, t)


def test_matches_brute_force(spark):
    rng, r = np.random.default_rng(1), random.Random(1)
    items = [" ".join(words(rng, int(rng.integers(6, 40)), 900)) for _ in range(12)]
    texts = []
    for k in range(60):
        t = words(rng, 60, 900)
        if k % 2:
            item = list(items[k % 12].upper() if k % 4 == 1 else items[k % 12])
            for _ in range(r.randrange(0, 9)):
                item[r.randrange(len(item))] = r.choice(["", "q", "zz"])
            t = [*t[:20], "".join(item), *t[20:]]
        texts.append(" ".join(t))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.distance for x in decontaminate.matches(documents(spark, texts), bench, block_bytes=500).collect()}
    want = {}
    forms, patterns = decontaminate.plain_forms(texts), [p.strip() for p in decontaminate.plain_forms(items)]
    for d, t in enumerate(forms):
        for i, p in enumerate(patterns):
            found = distance(p, t)
            if found <= int(0.08 * len(p)):
                want[d, i] = found
    assert got == want and len(want) > 10


def test_short_items_follow_the_same_rule(spark):
    texts = ["before quick brown foxas after", "the quick brown foxes", "a quickbrown fox", "xa b", "so a b c", "a b"]
    bench = spark.createDataFrame([(1, "quick brown foxes"), (2, "a b"), (3, "quick brown foxes")], "item_id int, text string")
    got = {(r.doc_id, r.item_id): (r.distance, r.item_length) for r in decontaminate.matches(documents(spark, texts), bench).collect()}
    assert got == {(0, 1): (1, 17), (0, 3): (1, 17), (1, 1): (0, 17), (1, 3): (0, 17), (4, 2): (0, 3), (5, 2): (0, 3)}


def test_decontamination_odd_rows(spark):
    docs = odd_docs(spark)
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "x y"), (4, "the same words again " * 3)], "item_id int, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.matches(docs, bench).collect()) == [(5, 4), (5, 4), (6, 4)]
    clean = decontaminate.decontaminate(docs, bench)
    assert clean.columns == docs.columns and clean.count() == docs.count() - 3
    assert decontaminate.matches(docs, bench.limit(0)).count() == 0


# Repeated passages


def repeated(texts, least):
    split = [re.findall(r"\S+", (t or "").lower()) for t in texts]
    where = defaultdict(set)
    for k, w in enumerate(split):
        for a in range(len(w) - least + 1):
            where[tuple(w[a : a + least])].add(k)
    out = {}
    for k, w in enumerate(split):
        every, later = set(), set()
        for a in range(len(w) - least + 1):
            holders = where[tuple(w[a : a + least])]
            if len(holders) > 1:
                every |= set(range(a, a + least))
                if min(holders) != k:
                    later |= set(range(a, a + least))
        if every:
            out[k] = (len(w), len(every), len(later))
    return out


def test_repeats_match_brute_force(spark):
    texts = corpus(6)
    got = {r.doc_id: (r.n_words, r.n_repeated, r.n_later) for r in suffix_dedup.repeats(documents(spark, texts)).collect()}
    assert got == repeated(texts, 50) and len(got) > 10
    left = suffix_dedup.deduplicate(documents(spark, texts)).orderBy("doc_id").collect()
    assert not repeated([r.text for r in left], 50)


def test_repeats_of_a_very_common_passage(spark, monkeypatch):
    """A passage that most texts hold goes another way than the sort: the result is the same."""
    monkeypatch.setattr(suffix_dedup, "HOT_ROWS", 50)
    rng = np.random.default_rng(3)
    common_words = words(rng, 90, 5000)
    texts = [" ".join(words(rng, 25, 5000) + common_words[: int(rng.integers(50, 91))] + words(rng, 10, 5000)) for _ in range(300)] + corpus(8)
    docs = documents(spark, texts).coalesce(2)
    got = {r.doc_id: (r.n_words, r.n_repeated, r.n_later) for r in suffix_dedup.repeats(docs).collect()}
    assert got == repeated(texts, 50)


def test_repeats_odd_rows(spark):
    docs = odd_docs(spark)
    got = {r.doc_id: r for r in suffix_dedup.repeats(docs).collect()}
    assert set(got) == {5, 6} and got[6].copy_of == 5 and got[5].n_later == 0  # a repeat inside one text is left alone
    kept = suffix_dedup.deduplicate(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {None, *range(11)} - {3, 6}
    assert suffix_dedup.repeats(documents(spark, []).limit(0)).count() == 0


def test_cut_keeps_the_rest():
    assert suffix_dedup.cut_text("a b  c\nd e", [(1, 3)]) == "a\nd e"
    assert suffix_dedup.cut_text("a b", [(0, 2)]) == ""


# Quality


def test_resampling_prefers_the_target(spark):
    rng = np.random.default_rng(2)
    rows = [(k, " ".join(words(rng, 60)) if k % 3 else " ".join(f"junk{int(x)}" for x in rng.integers(0, 50, 60))) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    target = docs.where("doc_id % 3 = 1 AND doc_id < 150").select("doc_id")
    got = quality.resample(docs, target, 0.5).toPandas()
    assert got.selected.sum() == 150
    assert got[got.doc_id % 3 == 0].selected.mean() < 0.05
    top = got.sort_values("sample_key", ascending=False).head(150)
    assert set(top.doc_id) == set(got[got.selected].doc_id)


def test_resampling_matches_numpy(spark):
    """Weights and selection against plain counts of words and word pairs, which a few words never bring into one bucket."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{int(x)}" for x in rng.integers(0, 12, int(rng.integers(1, 40)))) for _ in range(120)]
    target = set(range(0, 40, 2))
    docs = documents(spark, texts)
    grams = [[(x,) for x in t.split()] + list(zip(t.split(), t.split()[1:], strict=False)) for t in texts]
    raw, good = Counter(g for x in grams for g in x), Counter(g for k in target for g in grams[k])
    n_raw, n_good = (sum(c.values()) + quality.BUCKETS for c in (raw, good))
    want = [sum(np.log((good[g] + 1) / n_good) - np.log((raw[g] + 1) / n_raw) for g in x) for x in grams]
    got = quality.resample(docs, docs.where(F.col("doc_id").isin(list(target))), 0.3).toPandas().set_index("doc_id").sort_index()
    buckets = {b for t in texts for _, _, bucket, _ in quality._features([t]) for b in bucket.tolist()}
    assert len(buckets) == len(raw)
    assert np.allclose(got.log_weight, want) and (got.n_features == [len(x) for x in grams]).all()
    u = docs.select("doc_id", ((F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 52)) + 0.5) / float(1 << 52)).alias("u")).toPandas().set_index("doc_id").sort_index().u
    keys = np.array(want) - np.log(-np.log(u))
    assert np.allclose(got.sample_key, keys) and set(np.flatnonzero(got.selected)) == set(np.argsort(-keys)[:36])


def test_kth_largest(spark):
    x = np.random.default_rng(0).normal(size=3000).round(2)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    for k in (1, 2, 777, 3000):
        assert quality.kth_largest(df, "x", k, 16) == np.sort(x)[::-1][k - 1]
    assert quality.kth_largest(df, "x", 3001) is None


def test_resampling_odd_rows(spark):
    docs = odd_docs(spark)
    got = quality.resample(docs, docs.where("false"), 0.5).collect()
    assert len(got) == docs.count() and all(r.log_weight == 0 for r in got)
    assert quality.resample(documents(spark, []).limit(0), docs).count() == 0


# URLs

PAGES = "page_id long, url string, html string"


def test_rules(spark):
    urls = ["http://EXAMPLE.com/en/7x", "https://a.example.com/en/1", "x://b.net/de/1?q", "http://example.net/de/88#t", "http://notexample.net/de/8", "http://org/es/", "nothing", None, "http://com", "a://b://c.com/en/2"]
    pages = spark.createDataFrame([(k, u, None) for k, u in enumerate(urls)], PAGES)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, queries.URL_RULES).collect()}
    assert got[0] == ("example.com", "/en/7x", "example.com/en/7", "allow")
    assert got[1] == ("a.example.com", "/en/1", "com/en/", "block")
    assert got[2] == ("b.net", "/de/1", "net/de/", "block")
    assert got[3][2:] == ("example.net/de/8", "allow") and got[4][2:] == ("net/de/", "block") and got[5][2:] == ("org/es/", "block")
    assert got[6] == got[7] == ("", "", None, "allow") and got[8] == ("com", "", None, "allow") and got[9] == ("b:", "//c.com/en/2", None, "allow")


def test_rules_of_the_contract(spark):
    """Each rule's word is the contract's, under its host, a subdomain and a longer rule of the other word."""
    want = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]
    urls = ["http://www.com/en/1", "http://example.com/en/7", "http://other.net/de/8", "http://a.example.net/de/88", "http://b.org/es/2"]
    pages = spark.createDataFrame([(k, u, None) for k, u in enumerate(urls)], PAGES)
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(pages, queries.URL_RULES).collect()}
    assert [got[k] for k in range(len(urls))] == want


def test_many_rules(spark, monkeypatch):
    """A long list is joined by host suffix, with the result of the expression."""
    r = random.Random(2)
    part = lambda: r.choice(["a", "b", "c", "www", "x"])
    rules = list({(r.choice(["allow", "block"]), ".".join(part() for _ in range(r.randrange(1, 4))) + "/" + r.choice(["", "en/", "en/7", "d"])) for _ in range(300)})
    rules += [("block", f"h{k}.com/p") for k in range(5000)]
    urls = ["http://" + ".".join(part() for _ in range(r.randrange(1, 5))) + r.choice(["", "/en/71", "/dx", "/"]) for _ in range(300)] + [None, "no", "s://t.h4321.com/p/q", "s://h4321.com/q"]
    pages = spark.createDataFrame([(k, u, None) for k, u in enumerate(urls)], PAGES)
    got = {x.page_id: x for x in url_filter.judge(pages, rules).collect()}
    assert got[302].rule == "h4321.com/p" and got[303].rule is None and len(got) == 304
    few = [x for x in rules if not x[1].startswith("h")]
    want = {x.page_id: x for x in url_filter.judge(pages, few).collect()}
    assert len(few) <= url_filter.LITERAL_RULES and all(got[k] == want[k] for k in got if k != 302)


def test_propagation_matches_numpy(spark):
    r = random.Random(8)
    hosts = [f"h{k}.example.{'com' if k % 2 else 'net'}" for k in range(25)]
    pages = []
    for k in range(150):
        own, kind = r.choice(hosts), r.choice(["/en/1", "/en/7", "/de/1", "/de/8", "/x"])
        links = "".join(f'<a class=x href="http://{r.choice(hosts)}/y">l</a>' for _ in range(r.randrange(3))) if r.random() < 0.5 else ""
        pages.append((k, f"http://{own}{kind}", links))
    df = spark.createDataFrame(pages, PAGES)
    judged = {x.page_id: x for x in url_filter.judge(df, queries.URL_RULES).collect()}
    at = {h: k for k, h in enumerate(hosts)}
    w, good, bad = np.zeros((25, 25)), np.zeros(25), np.zeros(25)
    for k, u, html in pages:
        h = at[u.split("/")[2]]
        for x in re.findall(r"http://([^/]+)/", html):
            if at[x] != h:
                w[h, at[x]] += 1
        rule = judged[k].rule
        good[h] += rule in ("example.com/en/7", "example.net/de/8")
        bad[h] += rule in ("com/en/", "net/de/")
    good, bad = good / good.sum(), bad / bad.sum()
    forth, back = w / np.maximum(w.sum(1, keepdims=True), 1), w / np.maximum(w.sum(0, keepdims=True), 1)
    g, b = 0.15 * good, 0.15 * bad
    for _ in range(10):
        tg, tb = 0.85 * forth.T @ g, 0.85 * back @ b
        g, b = 0.15 * good + tg, 0.15 * bad + tb
    for k, u, _ in pages:
        if judged[k].rule is None:
            assert judged[k].verdict == ("block" if tb[at[u.split("/")[2]]] > tg[at[u.split("/")[2]]] else "allow")
    assert {x.verdict for x in judged.values() if x.rule is None} == {"allow", "block"}


def test_pages_with_odd_rows(spark):
    rows = [(1, None, None, "h", "p", "r", "v", "t", 3), (None, "", "", "h", "p", "r", "v", "t", 3), (1, None, None, "h", "p", "r", "v", "t", 3), (2, "http://a.com/en/1", '<a href="//b.com/">x</a>' * 2, None, None, None, None, None, None)]
    pages = spark.createDataFrame(rows, f"{PAGES}, host string, path string, rule string, verdict string, text string, n_chars long")
    judged = url_filter.judge(pages, queries.URL_RULES)
    assert judged.columns == ["page_id", "host", "path", "rule", "verdict"] and judged.count() == 4
    assert judged.where("page_id = 1 AND host = '' AND verdict = 'allow'").count() == 2
    text = html_extract.extract(pages)
    assert text.columns == ["page_id", "url", "text", "n_chars"] and text.where("text = '' AND n_chars = 0").count() == 3
    for empty in (url_filter.judge(pages.where("false"), queries.URL_RULES), html_extract.extract(pages.where("false"))):
        assert empty.count() == 0


# HTML


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""),
        ("", ""),
        ("just text &amp; more", "just text & more"),
        ("<nav><a href=x>menu</a></nav><article><h1>T</h1><p>One, two.<p>Three  four.\n</article><footer>f</footer>", "T\nOne, two.\nThree four."),
        ("<article><p><b>Bold.<br><p>Next&nbsp;one.</p><script>var t='</p>';</script><style>p{}</style></article>", "Bold.\nNext one."),
        ("<article><p>Kept.</p><div class='comments'><p>A reader, a long and winding comment, with marks.</p></div><aside>side</aside></article>", "Kept."),
        ("<body><div class=cookie-notice>Cookies, please.</div><div class=main><p>Real text, of some length, with marks.</p><ul><li>item</li></ul></div></body>", "Real text, of some length, with marks.\nitem"),
        ("<article><p>cut off &am", "cut off &am"),
        ("<article><p>cut off</p><p", "cut off"),
        ("<article><p>a < b and 3<4</p></article>", "a < b and 3<4"),
        ("<!-- x --><article><!-- <p>no</p> --><p title='a>b'>yes</p></article>", "yes"),
    ],
)
def test_main_text(page, want):
    assert html_extract.main_text(page) == want


def test_articles_of_the_table(spark):
    """On the generated pages an article's element holds the main text: a plain cut of it is the brute-force version."""
    import html

    def plain(page):
        a = page.find("<article>")
        s = page[a + 9 :].split("</article>")[0]
        blocks = re.split(r"</?(?:p|h1|footer|div)>", re.sub(r"<[^>]*$", "", s))
        return "\n".join(x for x in (" ".join(html.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in blocks) if x) if a >= 0 else ""

    folder = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    for r in queries.op10_html_extract(spark, folder).collect():
        assert r.text == plain(pages[r.page_id]) and r.n_chars == len(r.text)


@pytest.mark.parametrize(
    "page, want",
    [
        ("<article><p>x</p><table><tr><td>cell</td></tr></table><p>long prose, with marks.</p></article>", "x\ncell\nlong prose, with marks."),
        ("<body><form action=x><div><h1>T</h1><p>Prose, with marks.</p></div><input></form></body>", "T\nProse, with marks."),
        ("<body><form><p>Only prose.</p></form></body>", "Only prose."),
        ("<article><p class='legal'>Legal prose.</p><div class=legal>gone</div><p class=ad>ad</p></article>", "Legal prose."),
        ("<article><header><h1>Own header</h1></header><p>Text.</p></article>", "Text."),
        ("<body><div class=top><a>x</a><a>y</a></div><h1>Title</h1><div class=c><p>Long text, of some length. And more, with marks; yes. Longer still.</p><p>s</p></div><div class=z>Tail</div></body>", "Title\nLong text, of some length. And more, with marks; yes. Longer still.\ns"),
    ],
)
def test_ratios_choose_the_content(page, want):
    assert html_extract.main_text(page) == want


def test_paths_match_plain_sums():
    """The content element against sums written out path by path, on random trees of containers."""
    r = random.Random(6)
    for _ in range(200):
        page, at, held = [], [], Counter()
        for _ in range(r.randrange(1, 30)):
            if at and r.random() < 0.4:
                page.append(f"</{at.pop()}>")
            elif r.random() < 0.5:
                at.append(f"d{len(at)}x{r.randrange(2)}")
                page.append(f"<div class={at[-1]}>")
                at[-1] = "div"
            else:
                page.append("w" * r.randrange(1, 40))
        text = "".join(page)
        read = html_extract.Page(text)
        for p, _, _, t in read.nodes:
            while True:
                held[p] += len(t)
                if p == 0:
                    break
                p = read.parent[p]
        chosen = html_extract.content_paths(read, read.nodes)
        if held:
            deepest = max(p for p in held if held[p] >= 0.75 * held[0])
            below = lambda p: p == deepest or (p and below(read.parent[p]))  # noqa: B023, E731
            assert all(p in chosen for p, _, _, _ in read.nodes if below(p))


def test_deep_and_long_pages():
    page = "<b>x " * 30_000 + "</i>" * 30_000
    read = html_extract.Page(page)
    assert len(read.parent) == 30_001 and html_extract.main_text(page) == " ".join(["x"] * 30_000)
    assert html_extract.main_text("<p>" + "word " * 200_000) == " ".join(["word"] * 200_000)


def test_blanks_between_inline_elements():
    assert html_extract.main_text("<article><p><b>One</b> <i>two</i></p></article>") == "One two"
    assert html_extract.main_text("<article><p><b>One</b><br><i>two</i></p> <p><b>three</b></p></article>") == "One two\nthree"


def test_fuzzed_pages_never_fail():
    r = random.Random(4)
    parts = ["<p>", "</p>", "<article>", "</div>", "<div class='ad x'>", "text, ", "&amp;", "<", ">", "<!--", "-->", "<script>", "</script>", '"', "'", "<li>", "<table><tr><td>", "<br/>", "</", "é"]
    for _ in range(2000):
        assert isinstance(html_extract.main_text("".join(r.choice(parts) for _ in range(r.randrange(30)))), str)


# All


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, oracle, same_rows, name):
    got = queries.queries()[name](spark, "/root/testdata/sf0.001").toPandas()
    assert same_rows(got, oracle("sf0.001").sql(queries.oracle_sql()[name]).df())

