"""Operators for training data, against brute force on small inputs and on odd rows."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from framewise.llm import chat_tools, embedding_dedup, graph, mixing, near_copies, packing, quality_classifier, quality_rules, queries, sharding, simhash_dedup, token_counts, tokenizing, url_filter

SF = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, score string"
ODD = [
    (1, "a b c d", "en", "s1", 7, "x", "y"), (1, "a b c d", "en", "s1", 7, "x", "y"), (2, "", "en", None, 0, "x", "y"), (3, None, None, "s2", None, None, None),
    (None, "é ü 你好 <|endoftext|> I'll", "fr", "s2", 3, "", ""), (5, " \t\n", "en", "s1", 3, "x", "y"), (6, "word " * 30_000, "de", "s3", 150_000, "x", "y"), (7, "a b c d", "en", "s3", 7, "x", "y"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def components(nodes, links):
    parent = {n: n for n in nodes}
    for a, b in links:
        a, b = find(parent, a), find(parent, b)
        parent[max(a, b)] = min(a, b)
    return {n: find(parent, n) for n in nodes}


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (7, 7), (None, 3)]
    got = dict(map(tuple, graph.connected_components(spark.createDataFrame(links, "src long, dst long")).collect()))
    assert got == {n: 0 for n in range(41)} | {100: 100, 150: 100, 200: 100}


def vectors():
    rng = np.random.default_rng(0)
    base = rng.standard_normal((40, 16))
    rows = []
    for i in range(400):
        v = base[i % 40] + rng.standard_normal(16) * rng.choice([0, 0.05, 0.2])
        rows.append((i, [float(x) for x in v.astype(np.float32)], int(i % 40 % 3)))
    return rows


def test_embeddings(spark):
    rows = vectors()
    odd = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None] * 16, 1), (904, rows[0][1], None), (905, rows[0][1], 0), (905, rows[0][1], 0), (906, [1.0], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").withColumn("n_links", F.lit("clash"))
    got = {r["vec_id"]: tuple(r)[1:4] for r in embedding_dedup.near_duplicates(df).select("vec_id", "n_links", "component_id", "kept").collect()}
    valid = {r[0]: r for r in rows + [odd[5]]}
    x = {i: np.array(r[1]) for i, r in valid.items()}
    links = [(a, b) for a in x for b in x if a < b and valid[a][2] == valid[b][2] and x[a] @ x[b] / math.sqrt((x[a] @ x[a]) * (x[b] @ x[b])) >= 0.98]
    n = Counter(i for p in links for i in p)
    comp = components([*x, 900, 901, 902, 903, 904, 906], links)
    assert got == {i: (n[i], c, i == c) for i, c in comp.items()}


def brute_links(rows, threshold=0.98):
    """{(vec_id, embedding): (n_links, component_id)} of (vec_id, embedding, label); an id may have several vectors."""
    nodes = list(dict.fromkeys((i, tuple(e), label) for i, e, label in rows))
    x = [np.array(e) / np.linalg.norm(e) for _, e, _ in nodes]
    links = [(a, b) for b in range(len(nodes)) for a in range(b) if nodes[a][2] == nodes[b][2] and len(x[a]) == len(x[b]) and x[a] @ x[b] >= threshold]
    n, comp = Counter(i for p in links for i in p), components(range(len(nodes)), links)
    least = {}
    for k, root in comp.items():
        least[root] = min(least.get(root, nodes[k][0]), nodes[k][0])
    return Counter((nodes[k][0], n[k], least[comp[k]]) for k in range(len(nodes)))


def test_embeddings_ids_with_several_vectors(spark):
    rows = [(1, [1.0, 0.0, 0.0], 0), (1, [0.0, 1.0, 0.0], 0), (2, [1.0, 0.01, 0.0], 0), (3, [0.0, 1.0, 0.0], 0), (4, [0.0, 1.0, 0.0], 1), (5, [0.0, 0.0, 1.0], 0), (5, [0.0, 0.01, 1.0], 0)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert Counter(tuple(r)[:3] for r in got.collect()) == brute_links(rows)
    names = spark.createDataFrame([(i, e, "ab"[k]) for i, e, k in rows], "vec_id long, embedding array<float>, label string")
    assert Counter(tuple(r)[:3] for r in embedding_dedup.near_duplicates(names).collect()) == brute_links(rows)


def test_embeddings_recall_at_real_plans():
    """Pairs just above the threshold share a bucket, with the bits and tables of small and of very large labels."""
    rng = np.random.default_rng(8)
    a = rng.standard_normal((20_000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    off = rng.standard_normal(a.shape)
    off -= (off * a).sum(axis=1, keepdims=True) * a
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    b = 0.98 * a + math.sqrt(1 - 0.98**2) * off
    for n in (10**3, 10**6, 10**9):
        bits, tables = embedding_dedup.table_plan(n, 0.98)
        assert (embedding_dedup._keys(a, bits, tables) == embedding_dedup._keys(b, bits, tables)).any(axis=1).sum() >= 19_995  # 0.2 misses expected


def test_embeddings_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 8)  # the driver's plan then cuts every bucket
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in 1 + 0.01 * rng.standard_normal(8)], 0) for i in range(60)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {tuple(r)[1:3] for r in got} == {(59, 0)} and len(got) == 60


def test_embeddings_empty(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        ("HTTP://A.Example.COM/en/x?y#z", "a.example.com", "/en/x", "example.com/en/", "block"), ("http://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("http://x.www.example.com/en/1", "x.www.example.com", "/en/1", "www.example.com/en/", "allow"), ("http://example.com/fr/", "example.com", "/fr/", "com/", "allow"),
        ("http://a.net/es/1", "a.net", "/es/1", "net/es/", "block"), ("http://a.net/en/1", "a.net", "/en/1", None, None), ("http://com?x/", "com", "", None, None), ("nothing", "", "", None, None),
        (None, "", "", None, None), ("", "", "", None, None), ("a://b://c/d", "b:", "//c/d", None, None), ("x://notcom/a", "notcom", "/a", None, None), ("x://É.COM/\n", "É.com", "/\n", "com/", "allow"),
    ],
)
def test_url_rules(spark, url, host, path, rule, verdict):
    df = spark.createDataFrame([(url,)], "url string")
    h, p = url_filter.url_parts(F.col("url"))
    df = df.select(h.alias("host"), p.alias("path"))
    assert tuple(df.select("host", "path", *url_filter.matching_rule(F.col("host"), F.col("path"))).first()) == (host, path, rule, verdict)


def test_url_filter(spark):
    rows = [(i, f"http://h{i % 9}.example.{'net' if i % 2 else 'com'}/{('es', 'en', 'de')[i % 3]}/{i}") for i in range(120)] + [(None, None), (7, "x"), (7, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(1))
    got = url_filter.filter_urls(df).collect()
    assert len(got) == 123 and {r["verdict"] for r in got} == {"allow", "block"}
    assert all(r["verdict"] == ("block" if r["rule"] in ("example.com/en/", "net/es/", "net/fr/") else "allow") for r in got if r["rule"])
    for few in (df.limit(0), df.where("page_id = 1")):
        assert url_filter.filter_urls(few).count() == few.count()


def brute_features(url):
    head, sep, rest = (url or "").partition("://")
    host = re.match(r"[^/?#]*", rest)[0] if sep else ""
    path = re.match(r"[^?#]*", rest[len(host) :])[0] if sep else ""
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    query = re.search(r"\?([^#]*)", url or "")
    query = query[1] if query else ""
    entropy = lambda t: -sum(n / len(t) * math.log2(n / len(t)) for n in Counter(t).values())
    return {
        "url_len": len(url or ""), "host_len": len(host), "path_len": len(path), "query_len": len(query), "depth": len(re.findall("/[^/]", path)), "labels": host.count("."),
        "digit_ratio": sum(c in "0123456789" for c in url or "") / max(1, len(url or "")), "host_entropy": entropy(host), "path_entropy": entropy(path), "params": len(re.findall("[^=&]+=", query)),
        "hyphens": host.count("-"), "fragment": "#" in (url or ""), "secure": (url or "")[:6].lower() == "https:",
    }


def test_url_features(spark):
    urls = [r["url"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    urls += [None, "", "x", "https://a-b.co.uk/x/y1?q=1&r=2=3#top", "HTTPS://h.org//a//?#", "http://é.fr/ü/你好?k", "http://h.com/" + "abcdé/1" * 20_000 + "?" + "k=v&" * 5000]
    host, path = url_filter.url_parts(F.col("url"))
    rows = url_filter._lexical(spark.createDataFrame([(u,) for u in urls], "url string").select("url", host.alias("host"), path.alias("path"))).collect()
    for r in rows:
        want = brute_features(r["url"])
        assert [float(r[k]) for k in want] == pytest.approx([float(v) for v in want.values()]), (r["url"] or "")[:80]


def test_url_trees_held_out(spark):
    """Trees that have not seen a URL judge it as the rules do."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    host, path = url_filter.url_parts(F.col("url"))
    parts = pages.select("url", host.alias("host"), path.alias("path"))
    rule, verdict = url_filter.matching_rule(F.col("host"), F.col("path"))
    parts = parts.withColumn("verdict", verdict).where("verdict IS NOT NULL").withColumn("held", F.pmod(F.xxhash64(F.lit(99), "url"), F.lit(4)) == 0)
    model = url_filter.fit(parts.where("NOT held"))
    out = url_filter.score(parts.where("held"), *model).select("verdict", (F.col("score") >= 0.5).alias("block")).toPandas()
    assert len(out) > 250 and ((out["verdict"] == "block") == out["block"]).mean() > 0.95


def test_url_rates_leave_their_fold_out(spark):
    rows = [(f"http://h{i}.{'net' if i % 2 else 'com'}/a/{i}", "block" if i % 2 else "allow") for i in range(80)] + [("http://solo.org/a", "block")]
    host, path = url_filter.url_parts(F.col("url"))
    parts = spark.createDataFrame(rows, "url string, verdict string").select("url", host.alias("host"), path.alias("path"), "verdict")
    _, sums, overall = url_filter.fit(parts)
    fold = F.pmod(F.xxhash64("url"), F.lit(url_filter.FOLDS)).cast("int")
    got = {r["url"]: r for r in url_filter._with_rates(parts.withColumn("fold", fold), sums, overall, fold).collect()}
    fold_of = {u: r["fold"] for u, r in got.items()}
    for u, r in got.items():
        other = [v == "block" for w, v in rows if w.split("/")[2].rsplit(".")[-1] == u.split("/")[2].rsplit(".")[-1] and fold_of[w] != fold_of[u]]
        assert r["suffix_rate"] == pytest.approx((sum(other) + 20 * overall) / (len(other) + 20))


def test_dual_descent_and_log_ratios():
    """The solver closes the gap between primal and dual; ratios by counting."""
    rng = np.random.default_rng(14)
    rows = [np.unique(rng.integers(0, 300, int(rng.integers(0, 60)))).astype(np.int32) for _ in range(120)]
    y = np.where(rng.random(120) < 0.4, 1, -1)
    rows = [np.unique(np.append(g, [7, 9] if s > 0 else [8])).astype(np.int32) for g, s in zip(rows, y, strict=True)]
    packed = [quality_classifier._packed(g) for g in rows]
    big = np.arange(0, 1 << 18, 3, dtype=np.int32)
    assert (quality_classifier._unpacked(quality_classifier._packed(big)) == big).all() and len(quality_classifier._packed(big)) == 1 << 15
    ratio = quality_classifier._log_ratio(packed, y)
    for k in (7, 8, 9, 20, 299, 5000):
        p, q = (sum(k in g for g, t in zip(rows, y, strict=True) if t == s) / (y == s).sum() for s in (1, -1))
        assert ratio[k] == pytest.approx(math.log((p + 1 / 120) / (q + 1 / 120)))
    cost = np.ones(120)
    w, bias = quality_classifier._dual_descent(packed, y, ratio, cost)
    x = np.zeros((120, 5001))
    for i, g in enumerate(rows):
        x[i, g] = ratio[g] / np.sqrt(len(g))
    v = np.divide(w[:5001], ratio[:5001], out=np.zeros(5001), where=ratio[:5001] != 0)
    primal = lambda v, b: (v @ v + b * b) / 2 + np.maximum(0, 1 - y * (x @ v + b)).sum()
    best = primal(v, bias)
    for _ in range(300):  # no step from there lowers the objective by much
        step = rng.standard_normal(5001) * (np.abs(x).sum(axis=0) > 0)
        assert primal(v + 1e-2 * step / np.linalg.norm(step), bias) > best * 0.999
    a, b, mu = np.zeros(5001), 0.0, 0
    for k in range(1, 20_001):  # subgradient descent, averaged: another way to the same optimum
        wrong = y * (x @ a + b) < 1
        a, b = a - (a - (y * wrong) @ x) / k, b - (b - (y * wrong).sum()) / k
        if k > 10_000:
            mu = mu + np.append(a, b) / 10_000
    assert best <= primal(mu[:-1], mu[-1]) * 1.02  # a dozen epochs


def test_classifier_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = quality_classifier.fit(docs, labels)
    out = quality_classifier.score(docs, model, ["doc_id"]).select("doc_id", quality_classifier.held_out().alias("held_out"), "score", "predicted").join(labels, "doc_id").toPandas()
    assert (out["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in out["doc_id"]]).all()
    test = out[out["held_out"]]
    assert len(test) > 900 and (test["predicted"] == test["quality"]).mean() > 0.98


def test_classifier_odd(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (1, 0), (6, 0), (7, 1), (2, None), (None, 1), (3, 0)], "doc_id long, quality int")
    for lab in (labels, labels.limit(0), labels.where("quality = 1")):
        model = quality_classifier.fit(odd, lab)
        got = quality_classifier.score(odd, model, ["doc_id"]).collect()
        assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
        assert quality_classifier.keep_good(odd, model).columns == odd.columns
    assert quality_classifier.score(none, quality_classifier.fit(none, labels), ["doc_id"]).count() == 0


def brute_stats(text):
    w = [x for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i : i + 3])].append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 3)}
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)


def test_rules(spark, docs, odd, none):
    for df in (docs, odd):
        got = Counter(tuple(r)[:6] + (r["base_failed"],) for r in quality_rules.quality_rules(df).collect())
        want = Counter()
        for r in df.collect():
            s = brute_stats(r["text"])
            want[(r["doc_id"], *s, s[0] < 50 or 100 * s[4] > 50 * s[0])] += 1
        assert got == want
    assert quality_rules.quality_rules(none).count() == 0
    kept = quality_rules.quality_rules(docs).where("kept").select("doc_id")
    assert sorted(map(tuple, quality_rules.keep_passing(docs).select("doc_id").collect())) == sorted(map(tuple, kept.collect()))
    assert quality_rules.keep_passing(odd).columns == odd.columns


def brute_kept(rows):
    """``kept`` of (lang, source, text) by the sketches' definition, merged by weight, without Spark."""
    rule = quality_rules
    place = {"symbols": lambda x: math.log(1 + x / 0.02), "dup_lines": lambda x: math.log(1 + x / 0.2), "repeats": lambda x: math.log(1 + x / 0.05), "mean_word": lambda x: 10 * math.log(x)}
    bucket = lambda x: math.ceil(math.log(x) / math.log(rule.GAMMA)) if x else -(10**6)
    stats, base = [], []
    for _, _, text in rows:
        n, chars, symbols, dup, rep = brute_stats(text)
        lines = sum(bool(x.split()) for x in (text or "").split("\n"))
        base.append(n < 50 or 100 * rep > 50 * n)
        stats.append({"symbols": symbols / n, "dup_lines": dup / lines, "repeats": rep / n, "mean_word": chars / n} if n else {})
    good = [i for i, b in enumerate(base) if not b]

    def limits(key, m):
        count = lambda fits: Counter(bucket(stats[i][m]) for i in good if fits(rows[i]))
        lend = lambda c: {b: rule.PRIOR * n / sum(c.values()) for b, n in c.items()}
        add = lambda a, b: {k: a.get(k, 0) + b.get(k, 0) for k in {*a, *b}}
        whole = add(count(lambda r: r[:2] == key), lend(add(count(lambda r: r[0] == key[0]), lend(count(lambda r: True)))))
        at = sorted((b, n, place[m](0 if b == -(10**6) else rule.GAMMA ** (b - 0.5))) for b, n in whole.items())
        best = None
        for k in range(1, len(at)):
            sides = [[(n, y) for _, n, y in part] for part in (at[:k], at[k:])]
            w = [sum(n for n, _ in p) for p in sides]
            mean = [sum(n * y for n, y in p) / v for p, v in zip(sides, w, strict=True)]
            var = [max(sum(n * (y - c) ** 2 for n, y in p) / v, rule.SPREAD**2) for p, v, c in zip(sides, w, mean, strict=True)]
            between = w[0] * w[1] * (mean[1] - mean[0]) ** 2
            if best is None or between > best[0] * (1 + 1e-12):
                best = between, at[k - 1][0], mean[1] - mean[0] >= rule.APART * math.sqrt(sum(var) / 2), m not in rule.TWO_SIDED or w[1] <= w[0]
        if best is None or not best[2]:
            return -math.inf, math.inf
        return (-math.inf, best[1]) if best[3] else (best[1] + 1, math.inf)

    known = {r[:2]: {m: limits(r[:2], m) for m in place} for r in {rows[i][:2]: rows[i] for i in good}.values()}
    return [not base[i] and all(low <= bucket(stats[i][m]) <= high for m, (low, high) in known[r[:2]].items()) for i, r in enumerate(rows)]


def ruled_rows():
    """Groups of several sizes, a small language, nulls; each with outliers of its own."""
    rng = np.random.default_rng(6)
    word = lambda n: "".join(rng.choice(list("abcdefghij"), max(1, int(n))))
    rows = []
    for lang, source, n, wide in (("en", "a", 150, 1), ("en", "b", 150, 3), ("en", "c", 20, 1), ("fr", None, 20, 2), (None, "a", 60, 1)):
        for k in range(n):
            w = [word(rng.normal(5, wide * 0.5) + (6 if k % 25 == 9 else 0)) for _ in range(80)]
            w += ["#"] * (40 if k % 20 == 3 else 0) + ["%"] * int(rng.integers(0, wide))
            lines = [" ".join(w[i : i + 8]) for i in range(0, len(w), 8)]
            rows.append((lang, source, "\n".join(lines + lines[:1] * int(rng.integers(0, wide + 1)) + lines[:2] * (4 if k % 50 == 11 else 0))))
    return rows + [("en", "a", None), ("en", "a", "few words"), ("de", "z", "")]


def test_rules_kept(spark):
    rows = ruled_rows()
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string")
    got = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(df).collect()}
    want = brute_kept(rows)
    assert [got[i] for i in range(len(rows))] == want
    assert all(0 < sum(want[i] for i in own) < len(own) for s in "ab" if (own := [i for i, r in enumerate(rows) if r[:2] == ("en", s)]))


def _limits(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string")
    stats = quality_rules.map_texts(df, ["doc_id", "lang", "source"], [quality_rules.T.StructField(s, quality_rules.T.LongType()) for s in quality_rules.STATS], quality_rules._stats_of)
    return {(r["lang"], r["source"]): r.asDict() for r in quality_rules.thresholds(quality_rules.sketches(stats)).collect()}


def test_rules_fences_follow_the_group(spark):
    """Sources whose words are as long as another's junk keep them; a small source of junk only is judged as its language."""
    rng = np.random.default_rng(9)
    text = lambda n, extra="": " ".join("".join(rng.choice(list("abcdef"), n)) for _ in range(70)) + extra
    rows = [("en", "short", text(5 if k % 10 else 11)) for k in range(300)] + [("en", "long", text(11)) for _ in range(300)] + [("fr", "junk", text(5, " #" * 30)) for _ in range(10)] + [("fr", "fine", text(5)) for _ in range(300)]
    lim = _limits(spark, rows)
    assert lim["en", "short"]["high_mean_word"] is not None and lim["en", "long"]["high_mean_word"] is None
    assert lim["fr", "junk"]["high_symbols"] == quality_rules.ZERO
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string")
    kept = Counter((rows[r["doc_id"]][1], len(rows[r["doc_id"]][2].split()[0])) for r in quality_rules.quality_rules(df).where("kept").collect())
    assert kept == {("short", 5): 270, ("long", 11): 300, ("fine", 5): 300}


@pytest.mark.parametrize("bad", [0.0, 0.05, 0.2, 0.5])
def test_rules_follow_the_share_of_bad(spark, bad):
    """Whatever share of the labelled documents of sf0.1 is bad: 0.9 of the bad go and 0.97 of the good stay."""
    folder = SF.replace("sf0.001", "sf0.1")
    rows = spark.read.parquet(f"{folder}/documents.parquet").join(spark.read.parquet(f"{folder}/labels.parquet").where("quality IS NOT NULL"), "doc_id").orderBy("doc_id").collect()
    ruled = {"good": [], "bad": []}
    for r in rows:
        n, *_, rep = brute_stats(r["text"])
        if n >= 50 and 100 * rep <= 50 * n:
            ruled["good" if r["quality"] else "bad"].append((r["lang"], r["source"], r["text"], r["quality"]))
    n_bad = min(len(ruled["bad"]), round(len(ruled["good"]) * bad / (1 - bad)))
    n_good = len(ruled["good"]) if not bad else round(n_bad * (1 - bad) / bad)
    some = ruled["good"][:n_good] + ruled["bad"][:n_bad]
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(some)], "doc_id long, lang string, source string, text string").repartition(4)
    kept = Counter(some[r["doc_id"]][3] for r in quality_rules.quality_rules(df).where("kept").collect())
    assert kept[1] >= 0.97 * n_good and kept[0] <= 0.1 * n_bad


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    import duckdb

    duck = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "benchmark"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.queries()[name](spark, SF)
    assert Counter(map(tuple, got.collect())) == Counter(duck.sql(f"SELECT {', '.join(got.columns)} FROM ({queries.oracle_sql()[name]})").fetchall())


def brute_targets(sizes):
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, full, out = 1.5 * sum(sizes.values()), set(), {}
    while True:
        rest = [s for s in names if s not in full]
        level = (total - sum(2 * sizes[s] for s in full)) / (sum(w[s] for s in rest) or 1)
        over = {s for s in rest if w[s] * level > 2 * sizes[s]}
        if not over:
            return {s: 2 * sizes[s] if s in full else w[s] * level for s in names}
        full |= over


def test_mixing(spark, docs, odd, none):
    for df in (docs, odd):
        got = mixing.mix(df).collect()
        assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix(df).collect()))
        src = {r["doc_id"]: r["source"] for r in df.collect()}
        sizes, taken = Counter(), Counter()
        for r in df.collect():
            sizes[r["source"]] += brute_stats(r["text"])[0]
        want = brute_targets(sizes)
        assert len(got) == df.count()
        for r in got:
            assert r["target"] == pytest.approx(want[src[r["doc_id"]]]) and 0 <= r["taken"] <= 2 * r["size"]
            taken[src[r["doc_id"]]] += r["taken"]
        assert all(abs(taken[s] - want[s]) <= max(2, 0.01 * want[s]) for s in sizes)
        mixed = mixing.mixed_documents(df)
        assert mixed.columns == df.columns
        words = Counter()
        for r in mixed.collect():
            words[r["source"]] += brute_stats(r["text"])[0]
        assert all(abs(words[s] - taken[s]) <= 2 for s in sizes)
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0


def test_mixing_repeated_rows(spark, monkeypatch):
    """A row that is there many times is one entry until the end; its copies are written out by several tasks."""
    monkeypatch.setattr(mixing, "COPIES", 64)
    rows = [(1, "a b c", "s")] * 900 + [(i, "x " * i, "s") for i in range(2, 40)] + [(i, "y " * 9, "t") for i in range(50, 90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, len(t.split())) for i, t, _ in rows)
    taken = Counter()
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken["t" if r["doc_id"] >= 50 else "s"] += r["taken"]
    want = brute_targets({"s": 2700 + sum(range(2, 40)), "t": 360})
    assert all(abs(taken[s] - want[s]) <= max(2, 0.01 * want[s]) for s in want)
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix(df).collect()))
    assert abs(sum(len(r["text"].split()) for r in mixing.mixed_documents(df).collect()) - sum(want.values())) <= 910


def test_sainte_lague(spark):
    votes = [340.0, 280.0, 160.0, 60.0, 60.0, 0.0]
    seats = Counter()
    for _ in range(37):
        best = max(range(6), key=lambda i: (votes[i] / (2 * seats[i] + 1), -i))
        seats[best] += 1
    cells = spark.createDataFrame(list(enumerate(votes)), "cell long, votes double")
    assert {r["cell"]: r["quota"] for r in mixing.apportion(cells, 37).collect()} == {i: seats[i] for i in range(6)}


def test_tool_calls(spark):
    calls = spark.createDataFrame(
        [(1, 0, "a", None, "reply", '{"turn": 0, "text": "x"}'), (1, 2, "b", ["a", "a"], "reply", '{"text": "y",  "turn": 2}'), (1, 4, "c", ["b"], "reply", '{"text": 5}'), (1, 6, "d", ["e"], "reply", "[]"), (1, 8, "e", ["d"], "reply", "{}"),
         (2, 0, "f", ["zz"], "other", "{}"), (2, 0, "n", ["f", None], None, "{}"), (2, 0, "g", None, "reply", '{"text":"1","turn":1}'), (2, 1, "g", None, "reply", '{"text":"2","turn":1}'), (2, 3, None, None, "reply", None), (1, 0, "a", None, "reply", '{"turn": 0, "text": "x"}')],
        "conv_id long, turn long, call_id string, after array<string>, tool string, arguments string",
    )
    results = spark.createDataFrame([("a", 1, "r2"), ("a", 0, "r1"), ("q", 3, None), (None, 1, "z")], "call_id string, at long, content string")
    got = {r["call_id"]: r for r in chat_tools.link_calls(calls, results).collect()}
    assert {k: (r["depth"], r["status"], r["n_results"]) for k, r in got.items()} == {
        "a": (0, "ok", 2), "b": (1, "no_result", 0), "c": (2, "invalid", 0), "d": (None, "cycle", 0), "e": (None, "cycle", 0), "f": (0, "invalid", 0), "n": (1, "invalid", 0), "g": (0, "repeated_id", 0), None: (0, "no_id", 0), "q": (None, "orphan", 1)
    }
    assert got["a"]["json"] == '{"arguments":{"text":"x","turn":0},"id":"a","name":"reply","result":"r1"}'
    assert got["c"]["errors"] == ["text: not STRING", "turn: missing"]
    conv = spark.createDataFrame([(1, i, "user" if i % 2 == 0 else "assistant", str(i)) for i in range(200)] + [(None, 1, "user", None), (2, None, None, "x")], "conv_id long, turn long, role string, text string")
    out = chat_tools.link_calls(*chat_tools.events_of(conv)).where("conv_id = 1").collect()
    assert {r["turn"]: r["depth"] for r in out} == {i: i // 2 for i in range(0, 200, 2)} and all(r["status"] == "ok" for r in out)
    assert chat_tools.link_calls(*chat_tools.events_of(conv.limit(0))).count() == 0


def brute_depths(after):
    """Longest line before each call; None on or after a cycle."""
    known = {}

    def depth(i, path=()):
        if i in path:
            return None
        if i not in known:
            up = [depth(p, (*path, i)) for p in set(after[i] or []) if p in after]
            known[i] = None if None in up else max((d + 1 for d in up), default=0)
        return known[i]

    return {i: depth(i) for i in after}


def test_tool_call_order(spark, monkeypatch):
    rng = np.random.default_rng(13)
    after = {f"c{i}": None if i == 0 else sorted({f"c{j}" for j in rng.integers(max(0, i - 6), i, int(rng.integers(1, 4)))}) for i in range(60)}
    after |= {f"l{i}": [f"l{i - 1}"] if i else ["c59", "c3", "gone"] for i in range(90)} | {"m": ["l89", "c7"], "n": ["m"]}
    after |= {"x": ["y"], "y": ["z"], "z": ["x"], "w": ["x", "c1"], "v": ["w"], "s": ["s"], "q": ["r", "c1"], "r": ["q", "c2"], "t": ["q", "c5"]}
    # Names sort otherwise than the calls follow one another, and pieces are far smaller than a conversation, so links go back and forth between pieces.
    monkeypatch.setattr(chat_tools, "PIECE", 32)
    nodes = spark.createDataFrame(list(after.items()), "call_id string, after array<string>")
    assert {r["call_id"]: r["depth"] for r in chat_tools.depths(nodes).collect()} == brute_depths(after)


def test_tool_call_rounds(spark, monkeypatch):
    """A session of 10,000 calls after the two before each is ordered in 5 rounds, not one a layer, and each round writes what is new only."""
    folders = []
    made = chat_tools.scratch_path
    monkeypatch.setattr(chat_tools, "scratch_path", lambda spark, name: folders.append(made(spark, name)) or folders[-1])
    rows = [(1, i, f"k{i}", [f"k{i - 1}", f"k{i - 2}"]) for i in range(10_000)] + [(c, i, f"s{c}:{i}", [f"s{c}:{j}" for j in (i - 1, i - 3)]) for c in range(2, 40) for i in range(40)]
    calls = chat_tools.materialize(spark.createDataFrame(rows, "conv_id long, turn long, call_id string, after array<string>"))
    got = chat_tools.depths(calls, "conv_id", ("conv_id", "turn")).join(calls, "call_id")
    assert got.where("depth = turn").count() == len(rows)
    arrivals, depths = (spark.read.parquet(f) for f in folders)
    merges = calls.where("turn > 2 OR conv_id = 1 AND turn = 2").count()
    assert depths.count() == merges and depths.agg(F.max("round")).first()[0] < 6
    assert arrivals.count() < 40


def test_tool_calls_odd(spark):
    conv = spark.createDataFrame([(1, 0, "user", "é\n" * 200_000, "z"), (1, 1, "assistant", None, "z"), (1, 2, "user", "", "z"), (1, 2, "user", "", "z"), (1, None, "user", "x", "z"), (None, None, None, None, None)], "conv_id long, turn long, role string, text string, call_id string")
    conv = conv.withColumn("status", F.lit("clash")).withColumn("depth", F.lit("clash"))
    out = {r["turn"]: r for r in chat_tools.link_calls(*chat_tools.events_of(conv)).collect()}
    assert {t: (r["status"], r["depth"]) for t, r in out.items()} == {0: ("ok", 0), 2: ("no_result", 1), None: ("no_id", 0)}
    assert len(out[0]["json"]) > 600_000


@pytest.fixture(scope="module")
def tokens():
    t = Tokenizer.from_file(TOKENIZER)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_packing(spark, docs, odd, none, tokens):
    for df in (docs, odd):
        got = packing.pack(df, TOKENIZER).collect()
        seqs, texts = defaultdict(list), defaultdict(list)
        for r in df.collect():
            texts[r["doc_id"]].append([*tokens(r["text"]), 2])
        pieces = defaultdict(list)
        for r in got:
            seqs[r["sequence_id"]].append((r["offset"], r["length"]))
            pieces[r["doc_id"]].append(r)
        for s in seqs.values():
            at = 0
            for offset, length in sorted(s):
                assert offset == at and length > 0
                at += length
            assert at <= 4096
        for i, parts in pieces.items():
            ids = texts[i][0]
            assert all(p["doc_tokens"] == len(ids) for p in parts)
            assert all(p["ids_crc32"] == zlib.crc32(np.array(ids[p["start"] : p["start"] + p["length"]], "<u4").tobytes()) for p in parts)
            assert sorted(p["start"] for p in parts) == sorted(s for _ in texts[i] for s in {p["start"] for p in parts})
            assert sum(p["length"] for p in parts) == len(ids) * len(texts[i])
        total = sum(len(t) for v in texts.values() for t in v)
        assert len(seqs) <= math.ceil(total / 4096) * 1.02 + 2
    assert packing.pack(none, TOKENIZER).count() == 0
    packed = packing.pack(docs, TOKENIZER)
    one = packing.ids_of(packed, docs, TOKENIZER).where("start = 0").first()
    assert zlib.crc32(np.array(one["ids"], "<u4").tobytes()) == one["ids_crc32"]


def encoded(texts):
    raw = [t.encode() for t in texts]
    ids, at = tokenizing.WordEncoder(TOKENIZER).encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    return [ids[a:z].tolist() for a, z in zip(at, at[1:], strict=False)]


def thue_morse(n, pair):
    return "".join(pair[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("case", ["plain", "slices", "same 64 bits"])
def test_word_encoder(docs, tokens, monkeypatch, case):
    if case == "slices":
        monkeypatch.setattr(tokenizing, "SLICE", 64)
    if case == "same 64 bits":
        monkeypatch.setattr(tokenizing, "_mixed", lambda exact: exact[:, 0] % np.uint64(7))
    texts = [r["text"] for r in docs.limit(40).collect()] if case != "slices" else []
    texts += ["", " ", "\n a\tb ", "x" * 23 + " " + "x" * 24 + " " + "x" * 25, "ab\0 ab ab\0\0", "é ü 你好 <|endoftext|> I'll", "word " * 50 + "y" * 300, *(thue_morse(n, p) for n in (1024, 2048, 4096) for p in ("xy", "yx"))]
    assert encoded(texts) == [tokens(t) for t in texts]


def test_word_encoder_holds_little(tokens):
    """A text of 64 MB is worked on in slices."""
    import tracemalloc

    text = ("some words, and 7 numbers " * 41 + "\n") * 62_000
    raw = np.frombuffer(text.encode(), np.uint8)
    enc = tokenizing.WordEncoder(TOKENIZER)
    tracemalloc.start()
    ids, at = enc.encode(raw, np.array([0, len(raw)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    line = tokens(text[: text.index("\n")])
    assert len(raw) > 64e6 and at.tolist() == [0, len(line) * 62_000] and (ids.reshape(-1, len(line)) == line).all()
    assert peak < 400e6  # the ids themselves are 2 * 4 bytes a word of six; the rest is a slice's


@pytest.mark.parametrize("k", [1, 2, 5, 40])
def test_differencing(k):
    sizes = np.random.default_rng(k).integers(1, 500, 200).tolist()
    sums = np.bincount(packing.differencing(sizes, k), weights=sizes, minlength=k)
    assert len(sums) == k and sums.sum() == sum(sizes) and sums.max() - sums.min() <= (500 if k == 40 else 20)


def test_token_counts(spark, docs, odd, none, tokens):
    for df in (docs, odd):
        hist = token_counts.histogram(df, TOKENIZER)
        want = defaultdict(list)
        for r in df.collect():
            want[r["lang"]].append(len(tokens(r["text"])))
        for r in hist.collect():
            n, each = r["n_tokens"], want[r["lang"]]
            assert (r["n_docs"], r["docs_from"], r["tokens_from"], r["tokens_within"]) == (each.count(n), sum(x >= n for x in each), sum(x for x in each if x >= n), sum(min(x, n) for x in each))
        got = {(r["lang"], r["context"]): (r["tokens"], r["kept"]) for r in token_counts.totals(hist, [5, 1000]).collect()}
        assert got == {(g, c): (sum(v), sum(min(x, c) for x in v)) for g, v in want.items() for c in (5, 1000)}
        for r in token_counts.quantiles(hist, [0.5, 1.0]).collect():
            each = sorted(want[r["lang"]])
            assert r["n_tokens"] == each[math.ceil(r["share"] * len(each)) - 1]
    assert token_counts.histogram(none, TOKENIZER).count() == 0


def brute_fingerprint(text, n):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    sh = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash(spark, docs, odd, none):
    for df in (docs, odd):
        got = simhash_dedup.near_duplicates(df.withColumn("fp", F.lit(1))).collect()
        fp = {r["doc_id"]: brute_fingerprint(r["text"], 3) for r in df.collect()}
        ids = [i for i in fp if i is not None]
        comp = components(ids, [(a, b) for a in ids for b in ids if a < b and (fp[a] ^ fp[b]).bit_count() <= 2])
        assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{f:016x}", comp.get(i)) for i, f in fp.items()}
        assert len(got) == df.count()
    assert simhash_dedup.near_duplicates(none).count() == 0


@pytest.mark.parametrize("kind", ["spread", "dense", "same"])
def test_vantage_point_tree(kind):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    if kind != "spread":
        flips = 3 if kind == "dense" else 1
        x = x[0] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (3000, flips)).astype(np.uint64), axis=1)
    else:
        x[1500:] = x[:1500] ^ (np.uint64(1) << rng.integers(0, 64, 1500).astype(np.uint64))
    d = np.bitwise_count(x[:, None] ^ x[None, :]) <= 2
    want = graph.local_components(len(x), *np.nonzero(d))
    assert (simhash_dedup.tree_links(x) == want).all()
    tree = simhash_dedup.layout(x[:500], 16)
    home = defaultdict(set)
    for shard, rows in simhash_dedup.shards_of(x, tree, np.arange(len(x))):
        for r in rows.tolist():
            home[r].add(shard)
    assert all(home[a] & home[b] for a, b in zip(*np.nonzero(d), strict=True))


def test_simhash_blocks(spark, docs, monkeypatch):
    """Shards cut into blocks that meet pairwise give the same groups."""
    want = {tuple(r) for r in simhash_dedup.near_duplicates(docs).collect()}
    monkeypatch.setattr(simhash_dedup, "BLOCK", 16)  # the driver's plan then cuts every shard
    assert {tuple(r) for r in simhash_dedup.near_duplicates(docs).collect()} == want
    few = simhash_dedup.near_duplicates(docs.withColumn("text", F.concat_ws(" ", F.lit("same " * 60), F.col("doc_id")))).collect()
    fp = {r["doc_id"]: int(r["fingerprint"], 16) for r in few}
    assert {r["doc_id"]: r["component_id"] for r in few} == components(list(fp), [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 2])


def test_parted_shards(spark, monkeypatch):
    """Shards over ``BLOCK`` rows are parted by vantage points of their own; only what none parts is cut into blocks."""
    monkeypatch.setattr(simhash_dedup, "BLOCK", 200)
    monkeypatch.setattr(simhash_dedup, "SHARD", 10**6)  # one shard above
    rng = np.random.default_rng(9)
    far = rng.integers(0, 2**63, 1500, dtype=np.uint64)
    far = np.concatenate([far, far[:700] ^ (np.uint64(1) << rng.integers(0, 64, 700).astype(np.uint64))])
    dense = np.unique(far[0] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (400, 3)).astype(np.uint64), axis=1))
    x = np.unique(np.concatenate([far, dense]))
    df = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    parts = simhash_dedup._parted(simhash_dedup._deal(df, 2), 2).toPandas()
    sizes = parts.groupby("shard").agg({"fp": "size", "blocks": "max"})
    assert len(sizes) > 8 and (sizes["blocks"] == np.where(sizes["fp"] > 200, np.ceil(sizes["fp"] / 200), 1)).all()
    d = np.bitwise_count(x[:, None] ^ x[None, :]) <= 2
    want = graph.local_components(len(x), *np.nonzero(d))
    at = {int(v): i for i, v in enumerate(x.view(np.int64))}
    pairs = [(at[r["src"]], at[r["dst"]]) for r in simhash_dedup._search(df, 2).collect()]
    assert list(components(range(len(x)), pairs).values()) == want.tolist()


def test_keep_one_ids_with_several_texts(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "b"), (1, text, "a"), (1, text, "a"), (1, "another text", "c"), (2, text + " more", "d"), (2, "a third one", "e"), (None, text, "f"), (3, "", "g"), (4, None, "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, tag string")
    want = [(1, "another text", "c"), (1, text, "a"), (2, "a third one", "e"), (3, "", "g"), (None, text, "f")]
    for part in (df, df.repartition(5, "tag")):
        assert sorted(map(tuple, near_copies.keep_one(part).collect()), key=str) == sorted(want, key=str)


def test_keep_one_recall(spark):
    """Pairs of 0.84 similarity, by exact sets of five-word shingles."""
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 5))
    rows = []
    for i in range(150):
        w = [word() for _ in range(400)]
        v = list(w)
        for k in range(7):  # spread, so each breaks five shingles of 396: 361 of 431 are shared
            v[30 + 50 * k] = word()
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
    left = {r["doc_id"] for r in near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(range(0, 300, 2)) <= left and len(left) <= 150 + 9


def test_keep_one(spark, odd, none):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    rows = []
    for i in range(40):
        w = [word() for _ in range(300)]
        v = list(w)
        v[int(rng.integers(300))] = word()
        rows += [(3 * i, " ".join(w)), (3 * i + 1, " ".join(v)), (3 * i + 2, " ".join(word() for _ in range(300)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rep", F.lit(1))
    left = {r["doc_id"] for r in near_copies.keep_one(df).collect()}
    assert {r[0] for r in rows if r[0] % 3 != 1} <= left and len([i for i in left if i % 3 == 1]) <= 2
    out = near_copies.keep_one(odd)
    assert out.columns == odd.columns and sorted([r["doc_id"] for r in out.collect()], key=str) == sorted([1, 2, None, 6], key=str)
    assert near_copies.keep_one(none).count() == 0


def _edited(rng, base, other, kind, n):
    """``n`` words of ``other`` inserted in, cut from, put for or appended to those of ``base``."""
    at = int(rng.integers(len(base) - n))
    return {"insert": base[:at] + other[:n] + base[at:], "cut": base[:at] + base[at + n :], "replace": base[:at] + other[:n] + base[at + n :], "append": base + other[:n]}[kind]


def _shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_keep_one_passages(spark, monkeypatch):
    rng = np.random.default_rng(11)
    words = lambda n: ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(n)]
    rows, kinds = [], ["insert", "cut", "replace", "append"]
    for i in range(160):
        base, other = words(300), words(100)
        rows += [(3 * i, " ".join(base)), (3 * i + 1, " ".join(_edited(rng, base, other, kinds[i % 4], 10 + i // 3)))]
    sets = {i: _shingles(t) for i, t in rows}
    near = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8
    want = {i for i, _ in rows if i % 3 == 0 or not near(i - 1, i)}
    assert all(10 < sum(near(3 * i, 3 * i + 1) for i in range(k, 160, 4)) <= 40 for k in range(4)) and len(want) < len(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in near_copies.keep_one(df).collect()} == want
    monkeypatch.setattr(near_copies, "BLOCK_SHINGLES", 200)  # the driver's plan then cuts every group
    assert {r["doc_id"] for r in near_copies.keep_one(df).collect()} == want


@pytest.mark.parametrize("kind", ["tight", "loose", "two clusters"])
def test_set_links_of_large_groups(spark, monkeypatch, kind):
    rng = np.random.default_rng(13)
    base = np.arange(1, 61, dtype=np.int64)
    if kind == "loose":
        sets = [np.unique(rng.integers(0, 60, int(rng.integers(1, 40)))) for _ in range(200)]
        sets += [s[1:] for s in sets[:100] if len(s) > 1]
    else:
        sets = [np.delete(base, rng.choice(60, 3, replace=False)) for _ in range(300)]
        if kind == "two clusters":
            sets = [s + (1000 * (i % 3 == 0)) for i, s in enumerate(sets)] + [np.concatenate([base[:50], [2000 + i]]) for i in range(20)]
    sets = [s + (0 if i % 10 else 10_000 * (1 + i // 50)) for i, s in enumerate(sets)]  # nine tenths in one group, others of five
    rows = [(0 if i % 10 else 1 + i // 50, i, s.tolist()) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "grp long, nid long, shingles array<long>")
    group = {i: g for g, i, _ in rows}
    near = [(i, j) for j, b in enumerate(sets) for i, a in enumerate(sets[:j]) if group[i] == group[j] and 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b))]
    monkeypatch.setattr(near_copies, "BLOCK_SHINGLES", 1000)
    links = [(r["src"], r["dst"]) for r in near_copies._set_links(df).collect()]
    assert components(range(len(sets)), links) == components(range(len(sets)), near)
    # Each row goes to its own block, pivots to every block; near copies need no pairs of blocks.
    taken = []
    monkeypatch.setattr(near_copies, "_searched", lambda pieces: taken.append(pieces.count()) or spark.createDataFrame(near, "src long, dst long"))
    near_copies._set_links(df)
    blocks = -(-sum(len(s) for g, _, s in rows if not g) // 1000)
    assert taken[0] <= len(rows) + near_copies.PIVOTS * blocks
    assert kind != "tight" or taken[1] == 0


def test_keep_one_is_exact_at_the_threshold(spark):
    rng = np.random.default_rng(12)
    words = lambda n: ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(n)]
    rows, want = [], set()
    for i in range(60):
        base = words(104)  # 100 shingles; n words more make 100 / (100 + n)
        rows += [(4 * i, " ".join(base))] + [(4 * i + k, " ".join(words(n) + base)) for k, n in ((1, 25), (2, 26), (3, 40))][i % 3 : i % 3 + 1]
        want |= {4 * i} | ({rows[-1][0]} if i % 3 else set())
        base, edited = words(104), words(3)  # three single words, far apart: 85 / 115
        rows += [(1000 + 2 * i, " ".join(base)), (1001 + 2 * i, " ".join(base[:20] + edited[:1] + base[21:50] + edited[1:2] + base[51:80] + edited[2:] + base[81:]))]
        want |= {1000 + 2 * i, 1001 + 2 * i}
    got = {r["doc_id"] for r in near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want
    sets = [np.unique(rng.integers(0, 60, int(rng.integers(0, 40)), np.uint64)) for _ in range(300)]
    sets += [s[1:] for s in sets[:150]] + sets[:20]
    near = [(i, j) for j, b in enumerate(sets) for i, a in enumerate(sets[:j]) if len(a) and len(b) and 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b))]
    assert dict(enumerate(near_copies.similar_links(sets).tolist())) == components(range(len(sets)), near)


def test_sharding(spark, docs, odd, none):
    for df in (docs, odd):
        got = sharding.shard(df).collect()
        want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in df.collect())
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
        slots = defaultdict(list)
        for r in got:
            slots[r["shard"]].append(r["slot"])
            assert r["grown_shard"] in (r["shard"], 40)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(40))
    assert sharding.shard(none).count() == 0
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    n = Counter(r["shard"] for r in sharding.shard(many, [1.0, 3.0], 1.0).collect())
    assert n[1] / n[0] == pytest.approx(3, rel=0.1)


def run_stages(spark, docs, folder):
    """What each stage makes of ``docs``, written and read as the driver does."""
    import corpus_pipeline

    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], SF).write.parquet(f"{folder}/{k}")
        out.append(spark.read.parquet(f"{folder}/{k}"))
        assert k == 4 or out[-1].columns == docs.columns
    return out


def test_pipeline_against_brute_force(spark, tmp_path, tokens):
    """Each stage's rows against its definition, on near copies with inserted, cut and replaced passages among all of the table."""
    rng = np.random.default_rng(15)
    table = spark.read.parquet(f"{SF}/documents.parquet")
    rows, more = [tuple(r) for r in table.collect()], []
    good = [r for r in rows if 300 < len(r[1].split()) < 900]
    for k, (i, text, lang, source, _) in enumerate(good[:24]):
        w, other = text.split(" "), good[-1 - k][1].split(" ")
        t = " ".join(_edited(rng, w, other, ["insert", "cut", "replace", "append"][k % 4], 8 + 4 * k))
        more.append((10_000 + k, t, lang, source, len(t)))
    docs = spark.createDataFrame(rows + more, table.schema)
    start, classified, ruled, single, mixed, packed = run_stages(spark, docs, tmp_path)
    model = quality_classifier.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    collected = [tuple(r) for r in start.collect()]
    scores = model.score([(r[1] or "").encode() for r in collected])
    want = [r for r, s in zip(collected, scores, strict=True) if s >= 0.7]
    assert Counter(map(tuple, classified.collect())) == Counter(want)
    kept = brute_kept([(r[2], r[3], r[1]) for r in want])
    want = [r for r, k in zip(want, kept, strict=True) if k]
    assert Counter(map(tuple, ruled.collect())) == Counter(want)
    sets = {r[0]: _shingles(re.sub("[A-Z]", lambda m: m[0].lower(), r[1])) for r in want}
    near = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    comp = components(sets, near)
    want = [r for r in want if comp[r[0]] == r[0]]
    assert sum(i >= 10_000 for i, c in comp.items() if i != c) >= 8 and Counter(map(tuple, single.collect())) == Counter(want)
    sizes, got, whole = Counter(), Counter(), {r[0]: r for r in want}
    for r in want:
        sizes[r[3]] += len(r[1].split())
    for r in mixed.collect():
        got[r["source"]] += len(r["text"].split())
        assert whole[r["doc_id"]][1].startswith(r["text"]) and r["n_chars"] == len(r["text"])
    target = brute_targets(sizes)
    assert all(abs(got[s] - target[s]) <= max(2, 0.01 * target[s]) for s in sizes)
    pieces = packed.collect()
    assert sum(p["length"] for p in pieces) == sum(len(tokens(r["text"])) + 1 for r in mixed.collect())
    fill = Counter()
    for p in pieces:
        fill[p["sequence_id"]] += p["length"]
    assert max(fill.values()) <= 4096 and len(fill) <= sum(fill.values()) / 4096 * 1.02 + 1


def test_pipeline_odd_and_empty(spark, odd, none, tmp_path):
    for k, df in enumerate((odd, none)):
        out = run_stages(spark, df, tmp_path / str(k))
        assert out[-1].columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert out[-1].count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality classifier", "quality rules", "simhash near-dedup", "source mixing", "packing"]
    assert corpus_pipeline.run(spark, SF).count() > 0
