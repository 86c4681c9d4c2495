"""The training-data operators against brute force on small tables with nulls, ties and repeated rows."""

import functools
import hashlib
import os
import pickle
import random
import re
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tidewarden.llm import (
    components,
    decontamination,
    html_text,
    language_id,
    quality_rules,
    queries,
    sentence_pieces,
    sharding,
    simhash_dedup,
    substring_dedup,
    token_counts,
    toxicity,
)

DATA = "/root/testdata/sf0.001"
DDL = "doc_id bigint, text string"
ODD = [
    (900, None), (901, ""), (902, " \n\t "), (903, "a"), (904, "x " * 3000), (905, "é ① b\nb\nb"), (906, "a"), (906, "a"),
    (907, "y" * 20000), (908, "a  b   c ▁d "),
]


@pytest.fixture(scope="module")
def model():
    return queries.piece_model()


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DDL)


@pytest.fixture(scope="module")
def texts():
    random.seed(5)
    make = lambda v: [random.choice("abcdefghijklmnopqrstuvwxyz"[:v]) for _ in range(random.randrange(90))]
    base = [make(random.choice((1, 2, 3, 26))) for _ in range(30)]
    rows = []
    for i in range(300):
        words = list(random.choice(base))
        for _ in range(random.randrange(3)):
            if words and random.random() < 0.7:
                words[random.randrange(len(words))] = random.choice("xyz")
            else:
                words = words[random.randrange(30) :] + list(random.choice(base))[: random.randrange(60)]
        rows.append((i, " ".join(words)))
    return rows


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_pieces_are_the_librarys(spark, odd, texts, model):
    pieces = sentence_pieces.sentencepiece.SentencePieceProcessor(model_proto=model)
    assert sentence_pieces.words_are_separate(model)
    df = odd.union(spark.createDataFrame(texts, DDL))
    got = sorted(tuple(r) for r in sentence_pieces.round_trip(df, model).collect())
    want = []
    for doc_id, text in ODD + texts:
        ids = [*pieces.encode(text or ""), pieces.eos_id()]
        want.append((doc_id, len(ids), digest(" ".join(map(str, ids))), digest(pieces.decode(ids))))
    assert got == sorted(want)


def test_word_table_on_random_marks(model):
    random.seed(1)
    pieces = sentence_pieces.sentencepiece.SentencePieceProcessor(model_proto=model)
    table = sentence_pieces.WordTable(model, limit=50)
    for _ in range(3000):
        text = "".join(random.choice(" ▁\nab　é①<s></s>x\t0") for _ in range(random.randrange(30)))
        assert table.encode(text) == pieces.encode(text)


def test_taken_output_name_is_an_error(odd, model):
    with pytest.raises(ValueError):
        sentence_pieces.encode(odd.withColumn("ids", F.lit(1)), model)


def test_code_lengths_are_exact():
    counts = Counter()
    stream = language_id.LEAD + b"abracadabra abracadabra"
    for i in range(3, len(stream)):
        for size in range(4):
            counts[stream[i - size : i + 1]] += 1
    nodes = {}
    for gram, n in counts.items():
        nodes.setdefault(gram[:-1], []).append((gram[-1], n))
    trees = language_id.grow_trees([("x", c, [b for b, _ in f], [n for _, n in f]) for c, f in nodes.items()])

    @functools.cache
    def probability(context, byte):
        """The distribution by recursion, exclusion included."""
        if context is None:
            return np.full(256, 1 / 256)[byte]
        follow = dict(nodes.get(context, []))
        shorter = context[1:] if context else None
        if not follow:
            return probability(shorter, byte)
        n, d = sum(follow.values()), len(follow)
        if byte in follow:
            return follow[byte] / (n + d)
        rest = sum(probability(shorter, b) for b in range(256) if b not in follow)
        return d / (n + d) * probability(shorter, byte) / rest

    text = b"cab"
    padded = language_id.LEAD + text
    want = -sum(np.log2(probability(padded[i - 3 : i], padded[i])) for i in range(3, len(padded)))
    got = language_id.code_lengths(trees, trees.node_of(), [b"", text])
    assert got[0, 0] == 0 and got[1, 0] == pytest.approx(want, rel=2e-3)
    assert np.exp2(-trees.bits.astype(float)).reshape(-1, 256).sum(axis=1) == pytest.approx(1, abs=0.01)


def test_languages_on_held_out_rows(spark, odd):
    docs = queries.documents(spark, DATA)
    found = language_id.held_out_predictions(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in found]) > 0.95
    trees = language_id.learn(docs, F.lit(True))
    rows = [(r["text"], r["lang_pred"], r["score"]) for r in language_id.predict(odd, trees).collect()]
    assert all((lang == "und") == (not text or not text.strip()) and 0 <= score <= 1 for text, lang, score in rows)
    none = language_id.learn(docs.limit(0), F.lit(True))
    assert {r["lang_pred"] for r in language_id.predict(odd, none).collect()} == {"und"}


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""), ("", ""), ("<p>just", "just"), ("<script>var a='<p>x</p>'", ""), ("plain &amp; text", "plain & text"),
        ("<nav>a long menu with many words</nav><article><h1>T</h1><p>a<b>b</b>\n c<p>d.</article><footer>f</footer>", "T ab c d."),
        (
            '<div id="menu"><a href=/>Home</a></div><div><div class="content"><h2>T</h2><p>Hello wor<i>ld</i><p>A second paragraph.</div>'
            '<div class="comments"><p>a very long reader comment that is not part of it</div></div>',
            "T Hello world A second paragraph.",
        ),
    ],
)
def test_html(html, text):
    assert html_text.main_text(html or "") == text


def _words(mark: str, size: int) -> str:
    return " ".join([mark * 4] * (size // 5))


A, B, C = _words("a", 500), _words("b", 300), _words("c", 250)
LINKS = "<div><a href=/1>One</a> <a href=/2>Two</a> <a href=/3>Three</a></div>"


@pytest.mark.parametrize(
    "html",
    [
        f"<div id=post><div><p>{A}</p><p>{B}</p></div><div><p>{C}</p></div></div>",
        f"<div><div><p>{A}</p></div><div><p>{B[:60]}</p></div><div><p>{C[:40]}</p></div></div>",
        f"<article><p>{A}</p></article><article><p>{C}</p></article>",
        f"<article><p>{A}</p></article><div><p>{B}</p></div><article><p>{C[:40]}</p></article>",
    ],
    ids=["sections", "wrapped", "articles", "between"],
)
def test_html_keeps_all_regions(html):
    whole = " ".join(re.sub("<[^>]*>", " ", html).split())
    assert html_text.main_text(html) == whole
    assert html_text.main_text(f"<body>{LINKS}{html}{LINKS}</body>") == whole


@pytest.mark.parametrize(
    "html",
    [
        "<body class=has-sidebar>{}</body>", '<div class="layout-with-sidebar">{}</div>', "<article class=comments-open>{}</article>",
        "<main class=search-result>{}</main>", "<html class=menu><body id=search>{}</body></html>", "<article class=promo>{}</article>",
        "<body><form action=/page>{}</form></body>", "<div id=search>{}</div>", "<form><div class=related>{}</div></form>",
    ],
)
def test_html_names_do_not_empty_pages(html):
    page = html.format(f"<h1>Title</h1><p>{A}</p><div class=comments><p>{C}</p></div><div class=ad_banner>Buy now</div><p>{B}</p>")
    assert html_text.main_text(page) == f"Title {A} {B}"


def test_html_small_form_and_comments_stay_out():
    page = f"<main><p>{C[:60]}</p><div class=comments><p>{A * 9}</p></div></main><form><p>{B}</p></form>"
    assert html_text.main_text(page) == C[:60].strip()
    assert html_text.main_text(f"<div><p>{A}</p></div><form><p>{C[:40]}</p></form>") == A


def test_pages_and_extra_columns(spark):
    df = spark.createDataFrame([(1, "u", "<article>x y</article>", 7), (2, None, None, None)], "page_id int, url string, html string, n int")
    assert sorted(map(tuple, html_text.extract(df).collect())) == [(1, "u", 7, "x y"), (2, None, None, "")]


def brute_leaks(docs, items):
    grams = lambda w, k: [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
    out = {}
    for doc_id, text in docs:
        words = (text or "").lower().split()
        for item_id, item in items:
            v = (item or "").lower().split()
            k = min(5, len(v))
            if not v or len(words) < k:
                continue
            b = Counter(grams(v, k))
            for start in range(max(1, len(words) - len(v) + 1)):
                a = Counter(grams(words[start : start + len(v)], k))
                both = sum((a & b).values())
                score = both / (sum(a.values()) + sum(b.values()) - both)
                if score >= 0.8 and score > out.get((doc_id, item_id), (0, 0))[0]:
                    out[doc_id, item_id] = (score, start)
    return out


def test_leaks(spark):
    random.seed(3)
    vocabulary = [f"w{i}" for i in range(200)]
    items = [(i, " ".join(random.choice(vocabulary) for _ in range(random.choice((1, 4, 6, 12, 30))))) for i in range(15)]
    docs = []
    for d in range(80):
        words = [random.choice(vocabulary) for _ in range(random.randrange(40))]
        copied = random.choice(items)[1].upper().split()
        for _ in range(random.randrange(3)):
            p = random.randrange(len(copied))
            copied[p : p + 1] = random.choice((["zz"], [], ["q", copied[p]]))
            copied = copied or ["a"]
        p = random.randrange(len(words) + 1)
        words[p:p] = copied
        docs.append((d, " ".join(words)))
    docs += [(900, None), (901, ""), (903, "a " * 30), (3, docs[3][1])]
    items += [(90, None), (91, ""), (92, "a " * 12)]
    got = decontamination.contaminated(spark.createDataFrame(docs, DDL), spark.createDataFrame(items, "item_id int, text string"))
    got = {(r["doc_id"], r["item_id"]): (pytest.approx(r["similarity"]), r["start"]) for r in got.collect()}
    want = brute_leaks(docs, items)
    assert got == want and len(want) > 20


def test_leaks_with_repeated_shingles(spark):
    """Items of which one shingle repeats, and windows that lost part of the repeats: all pairs by brute force are found."""
    random.seed(8)
    items, docs = [], []
    for i, (size, repeats) in enumerate([(40, 5), (50, 6), (89, 11), (30, 4)] * 10):
        phrase = [f"p{i}"] * (repeats + 4)
        items.append((i, " ".join([f"w{random.randrange(10**6)}" for _ in range(size)] + phrase)))
        words = items[-1][1].split()
        words[-random.randrange(3, repeats) :] = [f"z{k}" for k in range(random.randrange(1, 4))]
        docs.append((i, " ".join(words)))
    want = brute_leaks(docs, items)
    got = decontamination.contaminated(spark.createDataFrame(docs, DDL), spark.createDataFrame(items, "item_id int, text string"))
    got = {(r["doc_id"], r["item_id"]): (pytest.approx(r["similarity"]), r["start"]) for r in got.collect()}
    assert len(want) > 15 and got == want


def test_other_columns_may_have_any_name(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, None), (None, "a b c d e f g"), (3, "q r s")], DDL)
    odd = docs.select("*", *(F.lit(f"own {c}").alias(c) for c in ("digest", "found", "_null", "body", "words", "kept", "bits", "n_chars")))
    items = spark.createDataFrame([(0, "a b c d e f g")], "item_id int, text string").withColumn("found", F.lit(1))
    for df, ids in (
        (simhash_dedup.keep_one(odd), {1, 2, 3, None}),
        (decontamination.clean(odd, items), {2, 3}),  # the null id leaks too
        (substring_dedup.without_repeats(odd, n_chars="none"), {1, 2, 3, None}),
    ):
        rows = df.collect()
        assert df.columns == odd.columns and {r["doc_id"] for r in rows} == ids
        assert all(r["digest"] == "own digest" and r["found"] == "own found" and r["_null"] == "own _null" for r in rows)


def test_broadcasts_need_no_package():
    """A worker without the package must be able to read what is broadcast."""
    trees = language_id.grow_trees([("x", b"", [1], [9])])
    code = "import pickle, sys; sys.path = [p for p in sys.path if 'repo' not in p]; pickle.loads(sys.stdin.buffer.read())"
    for value in ((trees.languages, trees.contexts, trees.bits), (0.5, {"a": 1.0})):
        subprocess.run([sys.executable, "-c", code], input=pickle.dumps(value), check=True, cwd="/")


@pytest.mark.parametrize("query", ["op2_language_id", "op10_toxicity"])
def test_queries_run_where_executors_have_no_package(query, tmp_path):
    """The driver finds the package by a path of its own, the Python workers do not."""
    code = f"""
import os, sys
from pyspark.sql import SparkSession
os.environ.pop("PYTHONPATH", None)
spark = (SparkSession.builder.master("local-cluster[1,2,1500]").config("spark.ui.enabled", "false").config("spark.executor.memory", "1500m")
    .config("spark.checkpoint.dir", {str(tmp_path)!r}).config("spark.sql.shuffle.partitions", "2").config("spark.executorEnv.PYTHONPATH", "").getOrCreate())
sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))!r})
from tidewarden.llm import queries
print("rows", queries.QUERIES[{query!r}](spark, {DATA!r}).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    found = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=str(tmp_path), env=env, timeout=300)
    assert "rows " in found.stdout, found.stderr[-3000:]


def test_each_language_has_its_own_contexts():
    many = [(f"l{j}", bytes([j, k]), [1, 2], [5, 5]) for j in range(6) for k in range(200)] + [(f"l{j}", b"", [1], [9]) for j in range(6)]
    budget = language_id.context_budget(6)
    assert 6 * budget <= language_id.MAX_NODES and language_id.context_budget(1) == language_id.context_budget(4)
    trees = language_id.grow_trees(many)
    assert sum(len(c) == 2 for c in trees.contexts) == 1200
    with pytest.raises(ValueError):
        language_id.grow_trees([(f"l{j}", b"", [1], [9]) for j in range(language_id.MOST_LANGUAGES + 1)])


def test_shards(spark, odd, tmp_path):
    rows = sharding.sharded(odd, 3, str(tmp_path / "map")).collect()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == sorted(
        (d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in ODD
    )
    for shard in range(3):
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))
    assert sharding.SlotMap.load(spark, str(tmp_path / "map")).version == 1


def test_rebalancing_moves_little(spark, tmp_path):
    random.seed(2)
    sizes = [random.randrange(1000) for _ in range(sharding.SLOTS)]
    first = sharding.place(sizes, 8)
    grown = sharding.rebalance(first, sizes, 9)
    total = lambda m: [sum(s for s, x in zip(sizes, m.shard_of, strict=True) if x == k) for k in range(m.shards)]
    assert max(total(first)) - min(total(first)) < 1000 and max(total(grown)) < sum(sizes) / 9 * 1.002
    assert {b for a, b in zip(first.shard_of, grown.shard_of, strict=True) if a != b} == {8}
    assert max(total(sharding.rebalance(grown, sizes, 5))) < sum(sizes) / 5 * 1.01
    for m in (first, grown, grown):
        m.save(spark, str(tmp_path / "map"))
    with pytest.raises(ValueError):
        sharding.SlotMap.load(spark, str(tmp_path / "map"), 9)
    assert sharding.SlotMap.load(spark, str(tmp_path / "map")) == grown and sharding.SlotMap.load(spark, str(tmp_path / "map"), 1) == first


def test_token_files(spark, odd, model):
    pieces = sentence_pieces.sentencepiece.SentencePieceProcessor(model_proto=model)
    got = sorted((r["doc_id"], r["n_tokens"]) for r in token_counts.document_counts(odd, model).collect())
    assert got == sorted((d, len(pieces.encode(t or ""))) for d, t in ODD)


def test_separator_scan_over_any_cut(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "GROUP", 3)
    random.seed(4)
    rows, want = [], []
    for file in range(4):
        tokens = [random.choice((0, 1, 1, 1, 9)) for _ in range(200)]
        lengths = "".join("|" if t == 0 else "x" for t in tokens).split("|")
        want += [(file, i, len(x), i < len(lengths) - 1) for i, x in enumerate(lengths) if i < len(lengths) - 1 or x]
        cuts = sorted(random.sample(range(200), 20))
        for block, (a, b) in enumerate(zip([0, *cuts], [*cuts, 200], strict=True)):
            rows.append((file, block, np.array(tokens[a:b], "<u2").tobytes()))
    rows.append((9, 0, None))
    blocks = spark.createDataFrame(rows, "file int, block int, payload binary")
    assert sorted(tuple(r) for r in token_counts.count_tokens(blocks, 0, "<u2").collect()) == sorted(want)


def brute_simhash(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_near_duplicates(spark, texts):
    rows = texts + ODD
    prints = [brute_simhash(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = root[i], root[j]
                root = [a if x == b else x for x in root]
    least = {r: min(rows[i][0] for i in range(len(rows)) if root[i] == r) for r in set(root)}
    got = simhash_dedup.near_duplicates(spark.createDataFrame(rows, DDL)).collect()
    want = sorted((d, f"{p:016x}", least[r]) for (d, _), p, r in zip(rows, prints, root, strict=True))
    assert sorted(tuple(r) for r in got) == want


def test_one_row_of_each_component_stays_whatever_its_id(spark):
    word = lambda n: " ".join(hashlib.md5(f"{n} {i}".encode()).hexdigest()[:6] for i in range(40))
    a, b, c, d = (word(n) for n in "abcd")
    rows = [(1, a), (1, b), (2, b), (3, a), (1, a), (4, c), (5, c.upper()), (None, d), (None, a), (6, d)]
    df = spark.createDataFrame(rows, DDL)
    assert len({brute_simhash(t) for t in (a, b, c, d)}) == 4
    want = Counter([(1, a), (1, b), (4, c), (6, d), (None, d), (None, a)])
    for order in ([F.asc("text")], [F.desc("text")]):
        kept = simhash_dedup.keep_one(df.coalesce(1).sortWithinPartitions(*order))
        assert Counter(map(tuple, kept.collect())) == want
    same = [(1, c), (1, c.upper()), (2, c)]
    kept = simhash_dedup.keep_one(spark.createDataFrame(same, DDL)).collect()
    assert [tuple(r) for r in kept] == [min(same[:2], key=lambda r: hashlib.sha256(r[1].encode()).hexdigest())]


def test_index_finds_all_links(spark):
    random.seed(7)
    prints = set()
    for _ in range(40):
        centre = random.getrandbits(64)
        for _ in range(random.choice((1, 2, 100))):
            x = centre
            for _ in range(random.randrange(6)):
                x ^= 1 << random.randrange(64)
            prints.add(x)
    prints = sorted(prints)
    array = np.array(prints, np.uint64)
    root = np.arange(len(prints))
    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(array ^ array[i]) <= 3):
            root[root == root[j]] = root[i]
    signed = array.view(np.int64).tolist()
    edges = simhash_dedup.links(spark.createDataFrame([(x,) for x in signed], "bits bigint"))
    found = {r["node"]: r["root"] for r in components.components(edges).collect()}
    ours = [found.get(x, x) for x in signed]
    pairs = {(int(a), b) for a, b in zip(root, ours, strict=True)}
    assert len(pairs) == len(set(root.tolist())) == len(set(ours))


def test_quality_counts(spark, odd, texts):
    def count(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        windows = list(zip(words, words[1:], words[2:], strict=False))
        seen, lines, dup = Counter(windows), set(), 0
        covered = {k for i, w in enumerate(windows) if seen[w] > 1 for k in (i, i + 1, i + 2)}
        for line in (text or "").split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in lines
                lines.add(line)
        n = len(words)
        failed = n < 50 or 100 * len(covered) > 50 * n
        return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), failed

    got = quality_rules.verdicts(odd.union(spark.createDataFrame(texts, DDL))).collect()
    assert sorted(tuple(r)[:7] for r in got) == sorted((d, *count(t)) for d, t in ODD + texts)
    assert not any(r["base_failed"] and r["kept"] for r in got)


def test_weak_supervision_separates_without_labels(spark):
    docs = queries.documents(spark, DATA)
    labels = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    rows = quality_rules.verdicts(docs).where("not base_failed").join(labels, "doc_id").collect()
    assert np.mean([r["kept"] == bool(r["label"]) for r in rows]) > 0.95


def test_repeated_passages(spark, texts):
    rows = texts + ODD
    seen, want = set(), []
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        words = (text or "").split()
        cover = [False] * len(words)
        for i in range(len(words) - 19):
            window = tuple(words[i : i + 20])
            if window in seen:
                cover[i : i + 20] = [True] * 20
            seen.add(window)
        want.append((doc_id, len(words), sum(cover), digest(" ".join(w for w, c in zip(words, cover, strict=True) if not c))))
    got = substring_dedup.removal(spark.createDataFrame(rows, DDL).repartition(5)).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_repeats_cut_from_rows(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, f"a  b {passage}", 3), (2, f"c {passage} d", 3), (2, f"c {passage} d", 3), (None, None, 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars int")
    got = sorted(map(tuple, substring_dedup.without_repeats(df).collect()), key=str)
    assert got == sorted([(1, f"a  b {passage}", 3), (2, "c d", 3), (2, "c d", 3), (None, None, 0)], key=str)


def test_toxic_sentences(spark, odd):
    docs = queries.documents(spark, DATA)
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = toxicity.held_out_scores(docs, labels).join(labels, "doc_id").collect()
    toxic, clean = ([r["score"] for r in rows if r["toxic"] == x] for x in (1, 0))
    assert np.mean([a > b for a in toxic for b in clean]) > 0.75
    train = [(f"the day is fine. you are {w}. good bye.", 1, 1.0) for w in ("trash", "scum") for _ in range(20)]
    model = toxicity.fit(train + [("the day is fine. you are nice. good bye.", 0, 1.0)] * 60)
    text = "Good bye. You are scum! The day is fine."
    (row,) = toxicity.score(spark.createDataFrame([(1, text)], DDL), model).collect()
    assert [text[s["start"] : s["end"]].strip() for s in row["offending"]] == ["You are scum!"] and row["score"] > 0.5
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(odd, model).collect()}
    assert scores[900] == scores[901] == 0 and all(0 <= s <= 1 for s in scores.values())


def test_empty_tables(spark, model):
    none = queries.documents(spark, DATA).limit(0)
    for df in (
        sentence_pieces.round_trip(none, model), language_id.held_out_predictions(none), sharding.sharded(none),
        token_counts.document_counts(none, model), simhash_dedup.near_duplicates(none), quality_rules.verdicts(none),
        substring_dedup.removal(none), html_text.page_texts(spark.read.parquet(f"{DATA}/pages.parquet").limit(0)),
        decontamination.contaminated(none, spark.read.parquet(f"{DATA}/benchmark.parquet").limit(0)),
        toxicity.held_out_scores(none, spark.read.parquet(f"{DATA}/labels.parquet")),
    ):
        assert df.count() == 0


def test_pipeline(spark, tmp_path):
    passage = " ".join(f"word{i} und" for i in range(40))
    draw = random.Random(9)
    body = [" ".join(draw.choice("the of and er tion ing".split()) + str(draw.randrange(99)) for _ in range(80)) for _ in range(6)]
    leak = " ".join(f"item{i}" for i in range(30))
    rows = [
        (1, body[0], "en"), (2, body[0], "en"), (3, f"{body[1]} {passage}", "en"), (4, f"{body[2]} {passage}", "en"),
        (5, f"{body[3]} {leak} {body[4]}", "en"), (6, None, "en"), (7, "123 456", "en"), (8, body[5], None),
    ]
    folder = str(tmp_path)
    docs = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.withColumn("lang_pred", F.lit("clash")).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, leak)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert sorted(got) == [1, 3, 4, 8]
    pieces = sentence_pieces.sentencepiece.SentencePieceProcessor(model_proto=queries.piece_model())
    assert pieces.decode(got[4]["ids"]) == body[2] and pieces.decode(got[3]["ids"]) == f"{body[1]} {passage}"
