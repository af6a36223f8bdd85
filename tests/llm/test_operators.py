"""Every operator against a plain version, on a fixture of hard cases, and on empty tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import decontamination, html_text, media, near_dup, packing, quality, sharding, suffix_dedup, tokens, url_filter
from tidelog.llm.components import components

from . import brute


def got(df, *cols):
    return Counter(tuple(r) for r in df.select(*cols).collect())


# 1


def test_main_text_of_articles():
    page = """<!DOCTYPE html><html><head><title>Site - T</title><style>p{color:red}</style></head><body class="home"><header><a href=/>Site</a> slogan</header>
    <nav><ul><li><a href=a>Home</a><li><a href=b>About us</a></ul></nav><div class="cookie-notice">We use cookies, accept.</div>
    <article><h1>The  title</h1><p>First &amp; <b>bo</b>ld,\n text. It has marks, and words.<p>Second&nbsp;para &#233;&lt;x&gt; unclosed <i>it<div class=ad>Buy now!</div>
    <ul><li>one<li>two</ul><aside>By the way</aside><form><input><p>Sign up</p></form><script>var x = "<p>no</p>";</script><section id=comments><p>Nice post, thanks.</section></article>
    <div class="sidebar"><p>Other stories, many of them. Read more, now.</p></div><footer>&copy; Site</footer>"""
    assert html_text.main_text(page) == "The title First & bold, text. It has marks, and words. Second para é<x> unclosed it one two"


def test_main_text_without_article_elements():
    text = " ".join(["A sentence of the story, with marks and a good length."] * 6)
    page = f"<body><div id=menu><a href=1>Home</a><a href=2>News</a><a href=3>Sport</a></div><div class=content><h2>Head</h2><p>{text}</p><p>Short.</p><p>{text}</p></div><div class=related><a href=x>{text}</a></div><div id=footer>imprint</div></body>"
    assert html_text.main_text(page) == f"Head {text} Short. {text}"


@pytest.mark.parametrize(("page", "text"), [(None, ""), ("", ""), ("<p>", ""), ("just text", "just text"), ("<p>a<br>b</p>", "a b"), ("<div><script>x", ""), ("<!-- <p>no</p> --><p>yes &bogus; &#x41;", "yes &bogus; A"), ("<p>cut <b", "cut")])
def test_main_text_of_broken_pages(page, text):
    assert html_text.main_text(page) == text


def test_extract(spark):
    df = spark.createDataFrame([(1, "u", "<p>ab é</p>", "x"), (2, None, None, "x"), (2, None, None, "x")], "page_id long, url string, html string, text string")
    assert got(html_text.extract(df), "page_id", "url", "text", "n_chars") == Counter({(1, "u", "ab é", 4): 1, (2, None, "", 0): 2})
    assert html_text.extract(df.limit(0)).count() == 0


# 2 and 8


@pytest.fixture(scope="module")
def ids(rows):
    """By the tokenizers library, the plain way."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary())
    t.encode_special_tokens = True
    return [(d, t.encode(x or "", add_special_tokens=False).ids) for d, x in rows]


def test_token_histogram(spark, docs, ids, none):
    hist = tokens.histogram(tokens.counts(docs)).cache()
    sizes = [len(i) for _, i in ids]
    for r in hist.collect():
        n = r["n_tokens"]
        assert r["docs"] == sizes.count(n) and r["docs_ge"] == sum(s >= n for s in sizes) and r["docs_le"] == sum(s <= n for s in sizes)
        assert r["tokens_ge"] == sum(s for s in sizes if s >= n) and r["truncated"] == sum(min(s, n) for s in sizes) and r["total"] == sum(sizes)
    assert {r["n_tokens"] for r in hist.collect()} == set(sizes)
    limits = [0, 1, 7, 100, 2048, 10**6]
    assert {r["context"]: r["kept_tokens"] for r in tokens.truncated_totals(hist, limits).collect()} == {c: sum(min(s, c) for s in sizes) for c in limits}
    rank = lambda q: sorted(sizes)[-(-q * len(sizes) // 1000) - 1]
    assert {r["q"]: r["n_tokens"] for r in tokens.quantiles(hist, [1, 500, 900, 1000]).collect()} == {q: rank(q) for q in (1, 500, 900, 1000)}
    assert tokens.histogram(tokens.counts(none)).count() == 0


def test_fast_ids_are_the_tokenizers_ids():
    from tokenizers import Tokenizer

    slow, fast = Tokenizer.from_file(tokens.vocabulary()), tokens.encoder(tokens.vocabulary())
    slow.encode_special_tokens = True
    rng = random.Random(3)
    letters = "aB 1\n\t's.,é日\u00a0\u2003🙂\r\x00ß-_|<>"
    for _ in range(300):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(60)))
        assert fast(text) == slow.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("capacity", [16, 2048])
def test_packing(docs, ids, capacity):
    rows = packing.pack_documents(docs, capacity).collect()
    want = Counter()
    for d, i in ids:
        i = np.array([*i, 0], "<u4")
        first = len(i) % capacity or capacity
        for k, a in enumerate([0, *range(first, len(i), capacity)]):
            part = i[a : a + capacity] if k else i[:first]
            want[d, k, a, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= capacity
    best, rooms = 0, []  # best-fit decreasing
    for n in sorted((r["length"] for r in rows), reverse=True):
        fit = min((x for x in rooms if x >= n), default=None)
        if fit is None:
            best, fit = best + 1, capacity
        else:
            rooms.remove(fit)
        rooms.append(fit - n)
    assert len(bins) <= 1.02 * best + 1


def test_packing_plans_are_near_the_bound():
    for seed in range(25):
        rng = random.Random(seed)
        counts = Counter(rng.choice([rng.randint(1, 64), rng.randint(1, 6)]) for _ in range(rng.choice([0, 1, 5, 300])))
        slots = packing.plan(dict(counts), 64)
        done, room = Counter(), Counter()
        for length, a, b, first, each, _ in slots:
            done[length] += b - a
            for k in range(b - a):
                room[first + k // each] += length
        assert done == counts and all(x <= 64 for x in room.values())
        rooms, n = [], 0  # best-fit decreasing
        for x in sorted(counts.elements(), reverse=True):
            fit = min((r for r in rooms if r >= x), default=None)
            if fit is None:
                n, fit = n + 1, 64
            else:
                rooms.remove(fit)
            rooms.append(fit - x)
        assert len(room) <= n + 1 + n // 50


def test_packing_of_nothing(none):
    assert packing.pack_documents(none).count() == 0


# 3


def test_tiers():
    run = lambda i, size: sharding.Run(i, "", size, 1)
    assert [sharding.tier_of(x << 20) for x in (0, 1, 2, 4, 5, 16, 64)] == [0, 0, 1, 2, 2, 3, 4]
    assert sharding.due([run(i, 1) for i in range(3)]) == []
    small, large = [run(i, 1) for i in range(5)], [run(10 + i, 64 << 20) for i in range(4)]
    assert sharding.due(large + small) == small and sharding.due(large) == large


def test_store(spark, docs, none, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", target=1 << 16)
    with pytest.raises(FileNotFoundError):
        store.read()
    assert store.append(none) == [] and store.version() == 0
    for i in range(3):
        store.append(docs)
    assert store.version() == 3 and store.compact() == 0
    # one version an arrival
    assert len(store.append(docs.withColumn("a", F.pmod("n_chars", F.lit(2))), "a")) == 2
    assert store.version() == 5 and len(store.runs()) == 5
    before = store.read().count()
    assert before == 4 * docs.count()
    assert store.compact() == 1 and [r.merged for r in store.runs()] == [5]
    assert store.read().count() == before == store.read(version=5).count()
    assert got(store.read(), *docs.columns) == Counter({k: 4 * n for k, n in got(docs, *docs.columns).items()})
    with pytest.raises(sharding.CommitConflict):
        store.commit(5, [], None, 1)
    assert store.version() == 6


def test_readers_keep_their_version_until_vacuum(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s")
    for i in range(4):
        store.append(spark.range(i * 10, i * 10 + 10))
    reader = store.read()
    assert store.compact() == 1 and reader.count() == 40
    assert store.vacuum(versions=2) == 0 and reader.count() == 40
    assert store.vacuum() == 4 and store.read().count() == 40 and store.version() == 5
    assert store.vacuum() == 0 and store.compact() == 0
    store.append(spark.range(40, 50))
    assert store.read().count() == 50


def test_arrivals_with_other_columns(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s")
    store.append(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    store.append(spark.createDataFrame([(2, "b", 0.5)], "doc_id long, text string, _run double"))
    store.append(spark.createDataFrame([("c",), (None,)], "text string"))
    store.append(spark.createDataFrame([(4, "d", True)], "doc_id long, text string, flag boolean"))
    want = Counter({(1, "a", None, None): 1, (2, "b", 0.5, None): 1, (None, "c", None, None): 1, (None, None, None, None): 1, (4, "d", None, True): 1})
    assert got(store.read(), "doc_id", "text", "_run", "flag") == want
    assert store.compact() == 1 and got(store.read(), "doc_id", "text", "_run", "flag") == want
    store.vacuum()
    assert got(store.read(), "doc_id", "text", "_run", "flag") == want
    with pytest.raises(ValueError, match="doc_id"):
        store.append(spark.createDataFrame([("x",)], "doc_id string"))
    assert store.version() == 5 and got(store.read(), "doc_id", "text", "_run", "flag") == want


def test_compaction_against_a_plain_simulation(spark, tmp_path):
    """Which arrivals lie in which run after every compaction, told by the ids in it."""
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", fanout=3)
    rng = random.Random(4)
    plain: dict[frozenset, int] = {}  # arrivals of a run, bytes
    for i in range(8):
        wide = rng.random() < 0.5
        store.append(spark.range(0, 400 if wide else 5, 1, 1).selectExpr(f"{i} as i", "concat_ws(' ', transform(sequence(1, 600), x -> hex(xxhash64(id, x)))) as text"))
        now = {r.number: r for r in store.runs()}
        plain[frozenset([i])] = now[max(now)].bytes
        store.compact()
        inside = store.read(numbered=True).groupBy("_run").agg(F.collect_set("i").alias("i")).collect()
        size = {frozenset(r["i"]): next(x.bytes for x in store.runs() if x.number == r["_run"]) for r in inside}
        while True:
            tiers = defaultdict(list)
            for k, v in plain.items():
                tiers[0 if v <= 1 << 20 else 1 + int(np.floor(np.log(v / (1 << 20)) / np.log(4)))].append(k)
            full = [t for t in sorted(tiers) if len(tiers[t]) >= 3]
            if not full:
                break
            whole = frozenset().union(*tiers[full[0]])
            merged_size = sum(plain.pop(k) for k in tiers[full[0]])
            plain[whole] = size.get(whole, merged_size)
        assert set(plain) == set(size)


def test_stored_documents(docs, rows, none):
    out = sharding.stored(docs).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["text_crc32"]) for r in out) == Counter((d, len((t or "").encode()), zlib.crc32((t or "").encode())) for d, t in rows)
    assert all(r["tier"] == 0 and r["merged"] >= 1 for r in out)
    assert sharding.stored(none).count() == 0


def test_stored_documents_keep_all_columns(docs, monkeypatch):
    seen, compact = [], sharding.ShardStore.compact

    def compacted(store):
        merges = compact(store)
        seen.append(got(store.read(), *docs.columns))
        return merges

    monkeypatch.setattr(sharding.ShardStore, "compact", compacted)
    sharding.stored(docs)
    assert seen == [got(docs, *docs.columns)]


# 4

URLS = ["http://a.net/", "http://net/x", "http://net", "https://m.EXAMPLE.net/en/1?q#f", "https://example.net/EN/", "x://example.com/de/", "x://notexample.com/de/", "ftp://a.example.org/fr/#", "//nohost", "", None, "a://b://c.net/d", "http://xexample.net/en/", "http://example.net?x/en/", "http://h.com/p\nq?x", "http://big.casino.com/", "http://casinotown.com/", "http://ex.org/fr", "http://ÀB.net/", "http://user@net/"]
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@pytest.mark.parametrize("inline", [256, 0])
def test_url_rules(spark, inline):
    df = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(URLS)] + [(0, URLS[0], "x", 1)], "page_id long, url string, verdict string, rank int")
    out = url_filter.judge(df.select("page_id", "url"), [*url_filter.CONTRACT_RULES, *url_filter.OWN_RULES], inline=inline).collect()
    assert len(out) == len(URLS) + 1
    want = {r[0]: r for r in brute.urls(list(enumerate(URLS)), RULES)}
    for r in out:
        i, host, path, rule, verdict = want[r["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), URLS[i]
        assert r["verdict"] == (verdict or ("block" if host == "big.casino.com" else "allow"))
    assert url_filter.judge(df.limit(0).select("page_id", "url"), url_filter.CONTRACT_RULES, inline=inline).count() == 0


@pytest.mark.parametrize("inline", [256, 0])
def test_url_rules_beside_columns_of_the_same_names(spark, inline):
    df = spark.createDataFrame([(1, "x://a.net/", "v", "h", 3)], "page_id long, url string, verdict string, host string, _token int")
    out = url_filter.judge(df, url_filter.CONTRACT_RULES, inline=inline)
    assert out.columns == ["page_id", "url", "_token", "host", "path", "rule", "verdict"] and [tuple(r) for r in out.collect()] == [(1, "x://a.net/", 3, "a.net", "/", "net/", "block")]
    named = df.select(F.col("url").alias("host"), "page_id")
    assert [tuple(r) for r in url_filter.judge(named, url_filter.CONTRACT_RULES, url="host", inline=inline).collect()] == [(1, "a.net", "/", "net/", "block")]


def test_rules_from_a_table(spark):
    rows = [(h, p, v) for h, p, v in RULES] + [(f"h{i}.com", None, "block") for i in range(300)] + [("h1.com", None, "block"), (None, "/", "block"), ("h2.com", "/ok", "allow"), ("x.com", "/", None)]
    rules = url_filter.table_rules(spark.createDataFrame(rows, "host string, path string, verdict string"))
    assert len(rules) == 305
    df = spark.createDataFrame([(i, u) for i, u in enumerate([*URLS, "a://H2.com/ok/1", "a://www.h7.com", "a://h2.com/no"])], "page_id long, url string")
    plain = {r[0]: r for r in brute.urls([tuple(r) for r in df.collect()], [(h, p or "", v) for h, p, v in rows if h and v])}
    for r in url_filter.judge(df, rules).collect():
        assert (r["rule"], r["verdict"]) == (plain[r["page_id"]][3], plain[r["page_id"]][4] or "allow"), r
    with pytest.raises(ValueError, match="rules"):
        url_filter.table_rules(spark.createDataFrame(rows, "host string, path string, verdict string"), most=10)


def test_rules_without_tokens(spark):
    df = spark.createDataFrame([("http://a/",), ("http://b/",)], "url string")
    for inline in (0, 10):
        out = url_filter.judge(df, [url_filter.Rule("^a/", "block", ())], inline=inline)
        assert got(out, "url", "verdict") == Counter({("http://a/", "block"): 1, ("http://b/", "allow"): 1})


# 5


@pytest.mark.parametrize("most", [None, 2])
def test_near_duplicates(docs, rows, monkeypatch, most):
    if most:  # nearly all lists are long then, and blocks small
        monkeypatch.setattr(near_dup, "LIST", most)
        monkeypatch.setattr(near_dup, "BLOCK", 8)
    out = near_dup.near_duplicates(docs)
    # a repeated doc_id holds one text here, so rows stand for themselves
    assert got(out, "doc_id", "n_shingles", "component_id", "kept") == Counter(brute.near(rows))


def test_no_near_duplicates(none):
    assert near_dup.near_duplicates(none).count() == 0


def test_nested_sets_around_the_sketch_size(spark):
    rng = random.Random(11)
    rows = []
    for i in range(40):
        words = [f"n{i}x{rng.randrange(10**9)}" for _ in range(43)]
        rows += [(2 * i, " ".join(words[:35])), (2 * i + 1, " ".join(words[: 42 + i % 2]))]  # 32 shingles within 39 or 40
    out = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got(out, "doc_id", "n_shingles", "component_id", "kept") == Counter(brute.near(rows))


def grown(rng, words, n, low):
    """words and n more, chosen so that each new shingle's hash is low or not."""
    words = list(words)
    while n:
        w = f"g{rng.randrange(10**9)}"
        flat = np.frombuffer(" ".join([*words[-3:], w]).encode(), np.uint8)
        (h,) = next(near_dup.shingle_sets(flat, np.array([0, len(flat)]), 4))
        if (int(h) < 1 << 60) == low:
            words.append(w)
            n -= 1
    return words


def test_frequent_values_beyond_the_least(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "LIST", 1)
    rng = random.Random(12)
    small = grown(rng, grown(rng, ["a", "b", "c"], 1, False), 31, False)
    large = grown(rng, small, 8, True)  # its 8 least values are not in small
    texts = [small, large] + [large[i : i + 4] for i in range(32, 40)] + [small[i : i + 4] for i in range(32)]
    other = [f"o{i}" for i in range(60)]  # a pair of its own, found at once
    rows = list(enumerate(" ".join(t) for t in [*texts, other, [*other, "end"]]))
    out = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got(out, "doc_id", "n_shingles", "component_id", "kept") == Counter(brute.near(rows))


def test_blocks_without_any_candidate(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "LIST", 2)

    def digest(words):
        flat = np.frombuffer(" ".join(words).encode(), np.uint8)
        return near_dup._digest(next(near_dup.shingle_sets(flat, np.array([0, len(flat)]), 4)))[0]

    common = [f"c{i}" for i in range(21)]
    pair = [[*common, "p", "q"], [*common, "r", "s"]]  # 18 of 22 shingles in both
    # leads every list of the pair, by its values and as the least, and is too large for either
    tail = next(t for k in range(1000) if digest([*common, *(t := [f"t{k}x{i}" for i in range(14)])]) < min(map(digest, pair)))
    lead = [*common, *tail]
    rows = list(enumerate(" ".join(t) for t in [*pair, lead, *(lead[i : i + 4] for i in range(18, 32))]))
    out = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got(out, "doc_id", "n_shingles", "component_id", "kept") == Counter(brute.near(rows))
    assert dict(got(out.where("doc_id < 3"), "component_id")) == {(0,): 2, (2,): 1}


def test_close_pairs_find_what_is_close(monkeypatch):
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 1 << 60, 3000, dtype=np.uint64)
    sets = []
    for _ in range(40):
        base = rng.choice(pool, 120, replace=False)
        sets += [np.unique(np.r_[base[: 120 - k], rng.integers(0, 1 << 60, k, dtype=np.uint64)]) for k in (0, 5, 12, 40)]
    n, comp = np.array([len(s) for s in sets]), np.arange(len(sets))
    want = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))]

    def groups(pairs):
        root = list(range(len(sets)))

        def find(x):
            return x if root[x] == x else find(root[x])

        for a, b in pairs:
            root[max(find(a), find(b))] = min(find(a), find(b))
        return [find(x) for x in range(len(sets))]

    i, j = near_dup.close_pairs(n, comp, sets, 80)
    found = list(zip(i.tolist(), j.tolist(), strict=True))
    assert {(max(p), min(p)) for p in found} <= set(want) and len(found) < len(sets) and groups(found) == groups(want)
    monkeypatch.setattr(near_dup, "WIDE", 60)  # sets are cut then, and every pair that may be close comes back
    i, j = near_dup.close_pairs(n, comp, [s[:60] for s in sets], 80)
    assert {(max(p), min(p)) for p in zip(i.tolist(), j.tolist(), strict=True)} >= set(want)


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(400 + i, 401 + i) for i in range(40)] + [(7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    out = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert out == {x: find(x) for x in list(root)}


# 6


@pytest.mark.parametrize("bound", [200_000, 0])
def test_decontamination(spark, bound):
    rng = random.Random(9)
    w = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(w) for _ in range(n))) for i, n in enumerate([0, 1, 3, 9, 10, 11, 30, 200])] + [(8, None), (9, "É é,É É-é"), (None, "only in null item " * 3), (4, "same id other text of ten words in a row yes"), (10, "")]
    items += [items[6]]
    body = lambda n: " ".join(rng.choice(w) for _ in range(n))
    texts = [None, "", "...", body(300), body(5)] + [f"{body(4)} {t} {body(6)}" if t else body(9) for _, t in items]
    texts += [" ".join((items[6][1] or "").split()[5:16]).upper() + "!", "É é É É é", "é É É É é", items[7][1] + ", " + items[7][1], items[5][1].replace(" ", " | "), "w1" * 4000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[9])]
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, pos long, w string")
    bench = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, n int")
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got(decontamination.decontaminate(docs, bench, broadcast_windows=bound), *cols) == Counter(brute.leaks(rows, items))
    assert got(decontamination.decontaminate(docs, bench.limit(0), broadcast_windows=bound), *cols) == Counter(brute.leaks(rows, []))
    assert decontamination.decontaminate(docs.limit(0), bench, broadcast_windows=bound).count() == 0
    # ids of another type, and a shuffle in front, give the same
    named = bench.withColumn("item_id", F.col("item_id").cast("string"))
    assert got(decontamination.decontaminate(docs.repartition(5), named, broadcast_windows=bound), *cols) == Counter(brute.leaks(rows, items))


# 7


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    assert len(out) == docs.count() and all(r["held_out"] == brute.held_out(i) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for i, r in out.items())
    known = [(out[r["doc_id"]], r["quality"]) for r in labels.collect()]
    test = [(r["score"], q) for r, q in known if r["held_out"]]
    good, bad = [s for s, q in test if q == 1], [s for s, q in test if q == 0]
    auc = sum((a > b) + (a == b) / 2 for a in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.95 and np.mean([s >= 0.3 for s in good]) > 0.97 and np.mean([s < 0.3 for s in bad]) > 0.8
    hidden = labels.where(quality.held_out(F.col("doc_id"))).withColumn("quality", 1 - F.col("quality"))
    rest = labels.where(~quality.held_out(F.col("doc_id")))
    again = {r["doc_id"]: r["score"] for r in quality.classify(docs, rest.unionByName(hidden)).collect()}
    assert all(abs(again[i] - out[i]["score"]) < 1e-9 for i in out)


def test_classifier_without_labels(docs, rows, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert got(quality.classify(docs, labels), "doc_id", "score", "predicted") == Counter((d, 0.5, 1) for d, _ in rows)
    assert quality.filtered(docs, labels).count() == len(rows)
    odd = spark.createDataFrame([(rows[0][0], 1, 0), (rows[1][0], None, 0), (None, 1, 0), (rows[2][0], 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.classify(docs, odd).count() == len(rows) and quality.classify(docs.limit(0), odd).count() == 0


def test_prior_from_positives_and_unlabelled():
    rng = np.random.default_rng(2)
    for share in (0.2, 0.5, 0.85):
        n = int(4000 * share)
        mixed = np.r_[rng.normal(1.5, 1, (n, 4)), rng.normal(-1.5, 1, (4000 - n, 4))][rng.permutation(4000)]
        assert abs(quality.estimated_prior(rng.normal(1.5, 1, (2000, 4)), mixed) - share) < 0.06
    assert quality.estimated_prior(np.zeros((1, 3)), np.zeros((9, 3))) == 0.5


def test_non_negative_risk_separates():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(1, 1, (400, 3)), rng.normal(-2, 1, (400, 3))
    m = quality.fit(good[:200], np.r_[good[200:], bad], 1 / 3)
    assert (m.score(good) >= 0.5).mean() > 0.9 and (m.score(bad) < 0.5).mean() > 0.95


# 9


@pytest.mark.parametrize("sizes", [{}, {"range_bytes": 4096, "range_entries": 40, "hot": 3}, {"fan": 3, "range_bytes": 4096, "range_entries": 25}])
def test_repeats(docs, rows, monkeypatch, sizes):
    """Also with many ranges of hashes and suffixes, and with both dealt in two steps."""
    if sizes:
        monkeypatch.setattr(suffix_dedup, "BROADCAST_IDS", 0 if "fan" in sizes else 1_000_000)
        monkeypatch.setattr(suffix_dedup, "RUN_ENTRIES", 150)
        monkeypatch.setattr(suffix_dedup, "RUN_ANCHORS", 300)
        monkeypatch.setattr(suffix_dedup, "BUCKET", 16)
    out = suffix_dedup.deduplicate(docs, **sizes).cache()
    plain = brute.repeats(rows)
    shown = out.select("doc_id", "n_bytes", "n_removed", (F.size("spans") / 2).cast("int").alias("s"), "kept_sha256")
    assert got(shown, *shown.columns) == Counter(r[:5] for r in plain)
    left = suffix_dedup.without_repeats(docs, out)
    assert left.columns == docs.columns
    assert got(left, "doc_id", "text") == Counter((d, r[5].decode("utf-8", "ignore") if r[2] else t) for (d, t), r in zip(rows, plain, strict=True))
    assert left.where("n_chars <> length(text)").count() == 0


@pytest.mark.parametrize("fan", [4096, 4])
def test_repeats_of_one_line_in_most_documents(spark, monkeypatch, fan):
    """A suffix that fills many ranges, whose windows differ on the left, on the right or not at all, with zero bytes too."""
    monkeypatch.setattr(suffix_dedup, "RUN_ENTRIES", 60)
    rng = random.Random(9)
    line = "The same line stands in nearly every document of this table, word by word."
    tails = ["\x00\x00\x00", "\x00", "", " end", " and so on"]
    rows = []
    for i in range(240):
        words = [f"{rng.randrange(40)}" for _ in range(rng.randrange(0, 12))]
        more = line[: rng.randrange(45, len(line) + 1)] + rng.choice(tails)
        rows.append((rng.randrange(200), " ".join(words) + line[rng.randrange(0, 20) :] + rng.choice(tails) + " ".join(words) + more * rng.randrange(0, 3)))
    table = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    out = suffix_dedup.deduplicate(table, fan=fan, range_entries=20)
    shown = out.select("doc_id", "n_bytes", "n_removed", (F.size("spans") / 2).cast("int").alias("s"), "kept_sha256")
    assert got(shown, *shown.columns) == Counter(r[:5] for r in brute.repeats(rows))


def test_repeats_send_a_row_a_bucket(docs, rows, monkeypatch):
    """The merge of many ranges makes a row for each bucket of documents, not for each document that loses something."""
    made, gathered = [], suffix_dedup._gathered

    def counted(merged, buckets):
        bundles = merged.where("bucket is not null")
        made.append((buckets, bundles.groupBy("bucket").count().count(), bundles.count(), bundles.selectExpr("sum(length(docs)) / 8").first()[0]))
        return gathered(merged, buckets)

    monkeypatch.setattr(suffix_dedup, "_gathered", counted)
    monkeypatch.setattr(suffix_dedup, "SPAN_DOCS", -(-len(rows) // 3))
    out = suffix_dedup.deduplicate(docs, range_bytes=4096, range_entries=200)
    shown = out.select("doc_id", "n_bytes", "n_removed", (F.size("spans") / 2).cast("int").alias("s"), "kept_sha256")
    assert got(shown, *shown.columns) == Counter(r[:5] for r in brute.repeats(rows))
    (buckets, used, bundles, pairs), *_ = made
    assert buckets == used == 3 and bundles < pairs / 3


def test_repeats_of_nothing(none):
    assert suffix_dedup.deduplicate(none).count() == 0


def test_anchors_depend_on_content_only():
    rng = np.random.default_rng(0)
    a = rng.integers(97, 101, 5000).astype(np.uint8)
    at, h = suffix_dedup.anchors(a)
    shifted, h2 = suffix_dedup.anchors(np.r_[rng.integers(97, 101, 777).astype(np.uint8), a])
    assert (shifted[777:] - 777 == at).all() and (h2[777:] == h).all() and ((at >= np.arange(len(at))) & (at + suffix_dedup.GRAM <= np.arange(len(at)) + suffix_dedup.WINDOW)).all()


def test_anchors_of_long_texts_by_segments(monkeypatch):
    a = np.random.default_rng(1).integers(97, 100, 9000).astype(np.uint8)
    whole = suffix_dedup.anchors(a)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 1000)
    parts = suffix_dedup.anchors(a)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_loser_tree():
    pad = lambda s: s.ljust(suffix_dedup.WINDOW, b"\0")
    for seed in range(150):
        rng = random.Random(seed)
        runs = [sorted((bytes(rng.choice(b"\0ab") for _ in range(rng.randrange(8))) for _ in range(rng.randrange(1, 20))), key=lambda s: (pad(s), len(s))) for _ in range(rng.choice([1, 2, 3, 5, 8, 13]))]
        coded = []
        for run in runs:
            lcp, rest, last = [], b"", None
            for s in run:
                n = next((i for i in range(suffix_dedup.WINDOW) if pad(s)[i] != pad(last)[i]), suffix_dedup.WINDOW) if last is not None else 0
                lcp.append(n)
                rest += s[n:]
                last = s
            coded.append((np.array(lcp, np.uint8), np.array([len(s) for s in run], np.uint8), rest))
        order, common = suffix_dedup.merge_runs(coded)
        flat = [s for run in runs for s in run]
        merged = [flat[i] for i in order]
        assert merged == sorted(flat, key=lambda s: (pad(s), len(s)))
        for x, y, n in zip(merged, merged[1:], common[1:].tolist(), strict=False):
            assert n == next((i for i in range(suffix_dedup.WINDOW) if pad(x)[i] != pad(y)[i]), suffix_dedup.WINDOW)


# 10


@pytest.mark.parametrize("form", ["pgm", "bmp"])
def test_media_round_trip(docs, rows, none, form):
    stored = media.media_columns(docs, form).cache()
    out = media.media_digests(stored).collect()
    assert len(out) == len(rows)
    want = Counter()
    for d, t in rows:
        raw = (t or "").encode()
        p = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        want[d, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in out) == want
    for r in stored.limit(5).collect():
        assert np.load(__import__("io").BytesIO(bytes(r["tile"]))).shape == (32, 32) and len(r["feature"]) == 16
    assert media.media_digests(media.media_columns(none)).count() == 0


def test_area_resize(monkeypatch):
    monkeypatch.setattr(media, "BAND", 5)
    rng = np.random.default_rng(4)
    for h, w, rows, cols in [(1, 1, 8, 9), (7, 64, 8, 9), (64, 64, 32, 32), (33, 50, 10, 7)]:
        x = rng.integers(0, 256, (h, w))
        fine = np.kron(x, np.ones((rows, cols)))  # every cell is whole blocks of this
        want = fine.reshape(rows, h, cols, w).mean((1, 3))
        assert np.allclose(media.area_resize(x, rows, cols), want)


def test_decoders():
    grey = np.arange(70, dtype=np.uint8).reshape(7, 10)
    assert (media.decode(media.encode_pgm(grey)) == grey).all() and (media.decode(media.encode_bmp(grey)) == grey).all()
    colour = np.arange(2 * 3 * 3, dtype=np.uint8).reshape(2, 3, 3)
    assert (media.decode(b"P6 # note\n3 2\n255\n" + colour.tobytes()) == colour).all()
    for bad in (b"", b"P5 2 2 255\nabc", b"P5\n1 1\n65535\n\0\0", b"GIF89a"):
        with pytest.raises(ValueError):
            media.decode(bad)
