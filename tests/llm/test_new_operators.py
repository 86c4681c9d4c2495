"""Periodic runs, centroid clusters and the URL filter against brute force."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewarden.llm import centroid_clusters, periodic_runs, queries, url_filter

DATA = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_runs(words, least=periodic_runs.LEAST):
    """All stretches by comparing every word with the one each period later."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def odd_sequence():
    """Words of a small alphabet with planted, nested and Fibonacci-like repeats."""
    n = random.randrange(random.choice([3, 30, 90, 220]))
    words = [str(random.randrange(random.choice([1, 2, 3, 40]))) for _ in range(n)]
    if n > 4 and random.random() < 0.6:
        for _ in range(random.randrange(1, 4)):
            a = random.randrange(n)
            p = 1 + random.randrange(max(1, (n - a) // 2))
            for i in range(a, min(n, a + p * random.randrange(1, 6) + random.randrange(p + 1))):
                words[i] = words[a + (i - a) % p]
    elif random.random() < 0.2:
        a, b = ["a"], ["a", "b"]
        while len(b) < n:
            a, b = b, b + a
        words = b[:n]
    return words


def brute_digests(doc_id, text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    n, h = len(words), -1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    return (
        doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
        sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def keyed(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is not None, str(x)) for x in r))


def test_runs_of_odd_sequences():
    random.seed(3)
    for _ in range(60):
        texts = [[w.encode() for w in odd_sequence()] for _ in range(10)]
        for words, got in zip(texts, periodic_runs.runs_of_texts(texts), strict=True):
            assert list(map(tuple, got.tolist())) == brute_runs(words)


def test_range_successor():
    rng = np.random.default_rng(1)
    values = rng.permutation(200)
    tree = periodic_runs.WaveletMatrix(values, 200)
    lo = rng.integers(0, 200, 300)
    hi = lo + rng.integers(0, 201 - lo)
    x = rng.integers(0, 201, 300)
    below = tree.below(lo, hi, x)
    assert below.tolist() == [(values[a:b] < v).sum() for a, b, v in zip(lo, hi, x, strict=True)]
    some = below < hi - lo
    got = tree.kth(lo[some], hi[some], below[some])
    assert got.tolist() == [min(v for v in values[a:b] if v >= y) for a, b, y in zip(lo[some], hi[some], x[some], strict=True)]


def test_run_query_is_brute_force(spark):
    random.seed(4)
    rows = [(i, " \t".join(odd_sequence())) for i in range(400)]
    rows += [(None, "a b " * 9), (None, None), (700, None), (701, ""), (702, " \n"), (703, "x"), (703, "x"), (704, "y " * 3000), (705, "é " * 12)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("runs", F.lit(1)).repartition(3)
    want = keyed(brute_digests(*r) for r in rows)
    assert sum(r[1] for r in want) > 100
    assert keyed(periodic_runs.run_digests(df).collect()) == want
    assert periodic_runs.run_digests(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        periodic_runs.find_runs(df)


def test_runs_on_the_documents(spark):
    docs = queries.documents(spark, DATA)
    got = keyed(queries.op11_periodic_runs(spark, DATA).collect())
    short = {r["doc_id"]: r["text"] for r in docs.collect() if len(r["text"] or "") < 6000}
    assert len(short) > 100 and {r[0] for r in got} == {r["doc_id"] for r in docs.collect()}
    assert [r for r in got if r[0] in short] == keyed(brute_digests(i, t) for i, t in short.items())


def test_runs_of_one_very_long_text():
    words = [str(i % 70_000).encode() for i in range(150_000)] + [b"z"] * 50_000
    assert [tuple(r) for r in periodic_runs.runs_of_texts([words])[0].tolist()] == [(0, 150_000, 70_000), (150_000, 50_000, 1)]


def clusters_of(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("cluster", F.lit("x"))
    return keyed(centroid_clusters.clustered(df.repartition(3)).collect())


def brute_clusters(rows):
    kept = [(i, v) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    x = np.array([[int(np.floor(1024 * float(np.float32(c)))) for c in v] for _, v in kept], object)
    order = sorted(range(len(kept)), key=lambda i: (sha(f"3:{'' if kept[i][0] is None else kept[i][0]}"), x[i].tolist()))[:8]
    centroids = [x[i].tolist() for i in order]

    def assign():
        found = []
        for v in x:
            found.append(min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids)))
        return found

    for _ in range(10):
        found = assign()
        for n in range(len(centroids)):
            own = [v for v, f in zip(x, found, strict=True) if f[1] == n]
            if own:
                centroids[n] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = assign()
    inertia = [sum(d for d, c in found if c == n) for n in range(8)]
    return keyed((i, c, d, inertia[c], sum(inertia), sha(",".join(map(str, centroids[c])))) for (i, _), (d, c) in zip(kept, found, strict=True))


def test_clusters_are_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=64).tolist()) for i in range(60)]
    rows += [(100 + i, (rows[i % 3][1] if i % 2 else [float(i % 4)] * 64)) for i in range(30)]
    rows += [(5, rows[5][1]), (None, rows[7][1]), (None, [-0.5] * 64)]
    odd = [(200, None), (201, []), (202, [1.0] * 63), (203, [None] + [1.0] * 63), (204, [float("nan")] * 64), (205, [float("inf")] * 64)]
    assert clusters_of(spark, rows + odd) == brute_clusters(rows)
    assert clusters_of(spark, rows[:3] + odd) == brute_clusters(rows[:3])
    assert clusters_of(spark, odd) == [] and clusters_of(spark, []) == []
    with pytest.raises(Exception, match="component"):
        clusters_of(spark, [(1, [2.0e6] * 64)])


def test_bounds_hold_and_drop_far_centroids(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 64)) * 4
    x = np.floor((centres[rng.integers(0, 8, 500)] + rng.normal(size=(500, 64)) / 4) * 1024).astype(np.int64)
    pivots = np.floor((centres + 0.1) * 1024).astype(np.int64)
    centroids = np.floor(centres * 1024).astype(np.int64)
    exact = np.stack([centroid_clusters.square(x, c) for c in centroids], axis=1)
    to_pivots = np.stack([centroid_clusters.square(x, p) for p in pivots], axis=1)
    floors = centroid_clusters.Pivots.measure(pivots, centroids).lower_squares(to_pivots)
    assert (floors <= exact).all()
    cluster, best, measured = centroid_clusters.nearest(x, centroids, floors)
    assert (cluster == exact.argmin(axis=1)).all() and (best == exact.min(axis=1)).all() and measured < 2 * len(x)
    # A vector that is a pivot, and one between two equal centroids, keep their ties.
    twice = np.concatenate([centroids, centroids])
    both = centroid_clusters.Pivots.measure(pivots, twice).lower_squares(np.stack([centroid_clusters.square(pivots, p) for p in pivots], axis=1))
    assert centroid_clusters.nearest(pivots, twice, both)[0].max() < 8


def test_clusters_are_the_sqls(spark):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{DATA}/embeddings.parquet'")
    got = queries.op12_centroid_clusters(spark, DATA)
    want = con.sql(queries.ORACLE["op12_centroid_clusters"])
    assert got.columns == want.columns
    assert keyed(got.collect()) == keyed(want.fetchall())


URLS = [
    None, "", "x", "://", "a.net/x", "HTTP://A.Net", "a://b.NET/x?y=://z", "http://www.example.com/de/\n#a", "http://NET/", "http://net#/",
    "a\nb://example.net/en/q?a&b&&c", "http://notnet/", "http://x.org/fr", "http://x.org/fr/", "http://org/fr/é①", "http://example.net/EN/",
    "http://a.example.net/en/", "http://badexample.net/en/", "http://x.com/de/", "http://exämple.ORG/FR/?#", "h://ÀB.C/" + "a/" * 20000,
]


def brute_url(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = []
    for rule, _ in url_filter.RULES:
        own, start = rule.split("/", 1)
        if (host == own or host.endswith("." + own)) and path.startswith("/" + start):
            fits.append(rule)
    return host, path, max(fits, key=len, default=None)


def test_rules_are_brute_force(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(3, URLS[6]), (None, URLS[6])]
    df = spark.createDataFrame(rows, "page_id bigint, url string").withColumn("host", F.lit(1)).withColumn("label", F.lit(2))
    got = url_filter.judged(df).drop("p_block").collect()
    decides = dict(url_filter.RULES)
    want = [(i, *brute_url(u), decides.get(brute_url(u)[2], "allow")) for i, u in rows]
    assert keyed(got) == keyed(want)
    assert url_filter.judged(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        url_filter.fitting_rule([("a/", "allow")] * 300, F.lit(""), F.lit(""))


def test_features_of_a_url(spark):
    df = spark.createDataFrame([(1, "http://a-b.cc.org/x1/y?p=1&q=2#z")], "page_id bigint, url string")
    row = url_filter.lexical(df).first()
    assert (row["suffix"], row["depth"], row["n_params"], row["host_labels"], row["longest_label"]) == ("org", 2, 2, 3, 3)
    assert row["digit_ratio"] == pytest.approx(3 / 32) and row["symbol_ratio"] == pytest.approx(1 / 10)
    shares = np.array([1, 1, 1, 2, 2, 1, 1, 1]) / 10  # the characters of a-b.cc.org
    assert row["host_entropy"] == pytest.approx(-(shares * np.log2(shares)).sum())


def test_trees_find_hosts_of_words_they_never_saw(spark):
    pages = queries._table(spark, "/root/testdata/sf0.1", "pages")
    held_out = F.col("url").rlike("bets|pills")
    unseen = tuple(w for w in url_filter.BAD_WORDS if w not in ("bets", "pills"))
    label = F.when(~held_out, url_filter.labelled_by_words(unseen))
    got = url_filter.judged(pages, rules=(), label=label)
    truth = pages.select("page_id", url_filter.labelled_by_words().alias("bad"), held_out.alias("held_out"))
    rows = got.join(truth, "page_id").groupBy("held_out", "bad", "verdict").agg(F.count(F.lit(1)).alias("n")).collect()
    counts = {(r["held_out"], r["bad"], r["verdict"]): r["n"] for r in rows}
    assert counts.get((True, 1.0, "block"), 0) > 9 * counts.get((True, 1.0, "allow"), 0) and (True, 1.0, "block") in counts
    clean = counts[False, 0.0, "allow"]
    assert clean > 99 * counts.get((False, 0.0, "block"), 0)
