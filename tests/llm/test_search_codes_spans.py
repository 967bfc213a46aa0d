"""Substring dedup, ranked search and vector codes against brute force, and on odd rows."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewise.llm import queries, ranked_search, substring_dedup, vector_codes

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, x string, start string, `meta.url` string, score string"


def brute_kept(rows, window):
    """(doc_id, n_words, n_removed, kept) of (doc_id, text) rows."""
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in split:
        for k in range(len(w) - window + 1):
            if i is not None:
                g = tuple(w[k : k + window])
                first[g] = min(first.get(g, i), i)
    out = []
    for i, w in split:
        gone = {k + o for k in range(len(w) - window + 1) if i is not None and first[tuple(w[k : k + window])] < i for o in range(window)}
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return Counter(out)


def kept(df, window):
    return Counter(map(tuple, substring_dedup.remove_repeats(df, window).select("doc_id", "n_words", "n_removed", "kept").collect()))


def shared_rows(n=60, words=6, seed=5):
    """Few different words, so that windows repeat by chance, and one passage that a third of all rows holds with a change here and there."""
    rng = np.random.default_rng(seed)
    passage = [f"p{k}" for k in range(40)]
    rows = []
    for i in range(n):
        w = [f"w{k}" for k in rng.integers(0, words, rng.integers(0, 60))]
        if i % 3 == 0:
            mine = list(passage)
            for k in rng.integers(0, 40, i % 4):
                mine[k] = f"x{i}"
            w[len(w) // 2 : len(w) // 2] = mine
        rows.append((int(rng.integers(0, 50)), " \n".join(w)))
    return rows


@pytest.mark.parametrize("shard", [200_000, 300, 40])
def test_substrings(spark, monkeypatch, shard):
    """Small shards make the passage's document, then its anchors, then its windows a key of their own."""
    monkeypatch.setattr(substring_dedup, "SHARD", shard)
    monkeypatch.setattr(substring_dedup, "FLUSH", 100)
    rows = shared_rows()
    df = spark.createDataFrame([(*r, "c", "d", "e", "f") for r in rows], DOCS).repartition(3)
    for window in (5,) if shard == 300 else (1, 2, 5):
        assert kept(df, window) == brute_kept(rows, window)


def test_substrings_odd(spark):
    long = " ".join(f"word{k % 997}" for k in range(60_000))
    rows = [(1, None), (2, ""), (3, " \t\n\x0b"), (None, "a b c d e f"), (4, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (6, "b c d é e f g"), (7, "é"), (8, long), (9, long), (10, "z " + long)]
    df = spark.createDataFrame([(*r, None, None, None, None) for r in rows], DOCS)
    assert kept(df, 5) == brute_kept(rows, 5)
    assert kept(df.where("false"), 5) == Counter()


def test_a_piece_has_one_list_of_spans(spark, monkeypatch):
    """However many of its windows repeat, on all levels: joins of pieces and spans don't multiply rows."""
    monkeypatch.setattr(substring_dedup, "SHARD", 40)
    passage = [f"p{i}" for i in range(40)]
    rows = [(i, " ".join([f"a{i}", *passage, f"b{i}", f"c{i}", *passage])) for i in range(12)]
    judged, seen = substring_dedup._judged, []

    def counted(pieces, *args):
        found = judged(pieces, *args)
        seen.append((pieces.count(), found.count(), found.agg(F.max(F.size("spans"))).first()[0]))
        return found

    monkeypatch.setattr(substring_dedup, "_judged", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    # Neighbours are put together, so the passage is one span, and a piece has two at most.
    assert substring_dedup.repeats(df, 3).groupBy("doc_id").count().agg(F.max("count")).first()[0] == 2
    assert len(seen) > 1 and all(n <= pieces and spans <= 2 for pieces, n, spans in seen)


def test_runs_of_one_word_in_more_lengths_than_a_shard_holds(spark, monkeypatch):
    """All windows within such a run are one, so no key parts the runs."""
    monkeypatch.setattr(substring_dedup, "SHARD", 100)
    rows = [(i, " ".join([f"a{i}", *["the"] * (5 + i % 20), f"b{i}", *["no", "yes"] * (3 + i % 10), *["the"] * (8 + i % 7)])) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert kept(df, 5) == brute_kept(rows, 5)


def test_suffix_automaton():
    rng = np.random.default_rng(2)
    for _ in range(60):
        texts = [[b"abc"[k : k + 1] for k in rng.integers(0, 3, rng.integers(0, 12))] for _ in range(4)]
        automaton = substring_dedup.SuffixAutomaton()
        for t in texts[:3]:
            automaton.add(t)
        known = {tuple(t[a:b]) for t in texts[:3] for a in range(len(t)) for b in range(a, len(t) + 1)} | {()}
        t = texts[3]
        assert automaton.matching(t) == [max(k for k in range(e + 2) if tuple(t[e + 1 - k : e + 1]) in known) for e in range(len(t))]
        assert len(automaton.next) <= 2 * sum(map(len, texts[:3])) + 1


def test_anchor_filter_holds_every_shared_anchor(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(i % 7, i % 7 + 30))) for i in range(40)]
    shared = substring_dedup.shared_anchors(substring_dedup._bytes_of(spark.createDataFrame(rows, "doc_id long, text string")), 13)
    got = dict(map(tuple, shared.collect()))
    want = {}
    for i, t in rows:
        for a in set(substring_dedup.anchors([t.encode().split()], 13, substring_dedup._Hashes())[0].view(np.int64).tolist()):
            want.setdefault(a, set()).add(i)
    assert got == {a: min(ids) for a, ids in want.items() if len(ids) > 1}
    bitmap = substring_dedup._filter(shared)
    at = np.array(list(got), np.int64).view(np.uint64) & np.uint64(8 * len(bitmap) - 1)
    assert (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).all()


def brute_ranks(docs, items, k):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    split = [(i, Counter(w), len(w)) for i, w in ((i, find(t)) for i, t in docs)]
    n_docs, total = sum(n > 0 for *_, n in split), sum(n for *_, n in split)
    df = Counter(t for _, c, _ in split for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        q = Counter(find(text))
        scored = []
        for i, c, n in split:
            m = 75 + (25 * n * n_docs) // max(1, total)
            s = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, k in q.items() if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, place + 1, x[3], -x[0]) for place, x in enumerate(sorted(scored)[:k])]
    return Counter(out)


@pytest.mark.parametrize("case", ["plain", "small tiles", "exact sums"])
def test_ranks(spark, monkeypatch, case):
    if case == "small tiles":
        monkeypatch.setattr(ranked_search, "TILE_ROWS", 7)
        monkeypatch.setattr(ranked_search, "ITEM_BYTES", 150)
    rng = np.random.default_rng(4)
    word = lambda n: " ".join(rng.choice(["Ab", "ab", "c1", "É", "é", "d", "e", "f-g", "h"], n))
    docs = [(i, word(rng.integers(0, 30))) for i in range(80)] + [(3, "ab ab"), (None, "ab c1"), (None, "ab c1"), (200, None), (201, ""), (202, "!?"), (203, "ab " * 40_000)]
    items = [(1, "ab ab c1"), (1, "ab ab c1"), (1, "d"), (2, None), (3, ""), (4, "nothing here"), (None, "É e"), (5, word(50)), (6, "g h")]
    if case == "exact sums":  # weights beyond what one tile can hold
        monkeypatch.setattr(ranked_search, "EXACT", 10**9 * 40)
        items += [(7, "d " * 90 + "ab " * 200)]
    d = spark.createDataFrame([(*r, None, None, None, None) for r in docs], DOCS).repartition(3)
    got = ranked_search.search(d, spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit("clash")), 20)
    assert Counter(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect())) == brute_ranks(docs, items, 20)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]


def test_ranks_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert ranked_search.search(docs, none).collect() == []
    assert ranked_search.search(docs.where("false"), spark.createDataFrame([(1, "a")], none.schema)).collect() == []


def test_weight_tiles_are_exact(monkeypatch):
    monkeypatch.setattr(ranked_search, "EXACT", 50 * ranked_search.IMPACT)
    rng = np.random.default_rng(0)
    counts, weights = rng.integers(0, 5, (6, 30)), rng.integers(0, 60, 30)
    whole = np.zeros((6, 30), np.int64)
    for at, part in ranked_search.weight_tiles(counts, weights):
        assert part.sum(axis=1).max() * ranked_search.IMPACT < ranked_search.EXACT
        whole[:, at] += part.astype(np.int64)
    assert (whole == counts * weights).all()


def brute_codes(rows, parts, entries, rounds):
    keep = sorted(((i, [math.floor(4096 * float(x)) for x in e], k) for i, e, k in rows if e and all(x is not None and math.isfinite(x) for x in e)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    keep = [r for r in keep if len(r[1]) == len(keep[0][1])]
    d = len(keep[0][1]) // parts
    cut = lambda v: [v[p * d : (p + 1) * d] for p in range(parts)]
    books = [[cut(r[1])[p] for r in keep[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            by = {}
            for r in keep:
                x = cut(r[1])[p]
                by.setdefault(near(x, books[p])[1], []).append(x)
            new.append([[sum(c) // len(by[e]) for c in zip(*by[e], strict=True)] if e in by else c for e, c in enumerate(books[p])])
        books = new
    made = [(r[0], r[2], [near(x, books[p]) for p, x in enumerate(cut(r[1]))]) for r in keep]
    error = {k: sum(d for _, label, at in made if label == k for d, _ in at) for k in {m[1] for m in made}}
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return Counter((i, "".join(f"{e:02x}" for _, e in at), sum(d for d, _ in at), error[k], sha) for i, k, at in made)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_codes(spark, kind):
    rng = np.random.default_rng(6)
    rows = [(int(i), (rng.standard_normal(24) * rng.choice([0.1, 1, 3])).astype(np.float32).tolist(), None if i % 7 == 0 else int(i % 3)) for i in rng.permutation(150)]
    rows += [(151, rows[3][1], 1), (151, rows[3][1], 1), (152, [0.0] * 24, 1), (153, None, 1), (154, [float("nan")] * 24, 1), (155, [None, *rows[0][1][1:]], 1), (156, [float("-inf"), *rows[0][1][1:]], 2), (157, [1.0] * 16, 2), (158, [], 2), (None, rows[9][1], 2)]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").withColumn("code", F.lit("clash")).withColumn("meta.url", F.lit(1)).repartition(3)
    got = vector_codes.compress(df, 8, 16, 6).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
    assert Counter(map(tuple, got.collect())) == brute_codes(rows, 8, 16, 6)


def test_codes_few_and_none(spark):
    rows = [(2, [0.5, -0.25, 0.0, 1.0] * 4, 1), (1, [0.5, -0.25, 0.0, 1.0] * 4, 1), (3, [0.125] * 16, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert Counter(map(tuple, vector_codes.compress(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())) == brute_codes(rows, 8, 16, 6)
    assert vector_codes.compress(df.where("false")).collect() == []
    with pytest.raises(Exception, match="do not fit a long"):
        vector_codes.compress(spark.createDataFrame([(1, [1e6] * 16, 1)], df.schema)).collect()


def test_nearest_prunes_and_is_exact():
    rng = np.random.default_rng(1)
    for k in (1, 2, 16):
        x, book = rng.integers(-9, 9, (500, 4)), rng.integers(-9, 9, (k, 4))
        d = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        at, best = vector_codes.nearest(x, book)
        assert (at == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()


@pytest.mark.parametrize("name", ["op11_substring_dedup", "op12_ranked_search", "op13_vector_codes"])
def test_columns(spark, name):
    want = {"op11_substring_dedup": "doc_id n_words n_removed kept_sha256", "op12_ranked_search": "item_id rank doc_id score", "op13_vector_codes": "vec_id code error label_error codebooks_sha256"}
    assert queries.queries()[name](spark, SF).columns == want[name].split()
