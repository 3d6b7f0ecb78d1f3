"""Sharding, mixing, URL rules, search, licenses and the pipeline: laws and plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tensorloom.llm import hamming, jaccard, licenses, mixing, queries, sharding, urlfilter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, shard string, copies double"


def table(spark, n=600, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9)))
    rows = []
    for i in range(n):
        text = rng.choice([None, "", "x", "same text for a third of all rows " * 6, *[" ".join(word() for _ in range(rng.choice([3, 60, 120, 900]))) for _ in range(3)]])
        rows.append((i, text, rng.choice(["en", "de", None]), rng.choice(["a", "a", "a", "b", "é", "z", None]), len(text or ""), 1, "s", 2.0))
    rows += rows[:7]
    return rows, spark.createDataFrame(rows, DOCS).repartition(4)


def test_sharding(spark):
    rows, df = table(spark)
    out = sharding.shard(df).collect()
    assert len(out) == len(rows)
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want
    load, slots, homes = Counter(), defaultdict(list), defaultdict(set)
    for r in out:
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        homes[r["text_crc32"]].add(r["shard"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    mean = sum(load.values()) / 8
    assert set(load) == set(range(8)) and max(load.values()) - min(load.values()) < 0.12 * mean
    whole = defaultdict(int)
    for r in out:
        whole[r["text_crc32"]] += r["size"]
    assert all(len(h) == 1 for c, h in homes.items() if whole[c] <= mean / 2)
    again = sharding.shard(df.repartition(7)).collect()
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in again} == {(r["doc_id"], r["shard"], r["slot"]) for r in out}


def plain_tree(points, room, first=0, ranges=None):
    """The tree by sorting: (id, source, lang, size, tie, weight) of each point, to (id, shard)."""
    if len(room) == 1 or not points:
        return {p[0]: first for p in points}
    ranges = ranges or [max(p[d] for p in points) - min(p[d] for p in points) for d in (1, 2, 3)]
    low = [min(p[d] for p in points) for d in (1, 2, 3)]
    wide = [max(p[d] for p in points) - low[d - 1] for d in (1, 2, 3)]
    names = ["by_source", "by_lang", "by_size"]
    d = max(range(3), key=lambda i: (wide[i] / ranges[i] if ranges[i] else 0.0, names[i]))
    bin_ = lambda p: min(max(math.floor((p[d + 1] - low[d]) / (wide[d] or 1.0) * sharding.BINS), 0), sharding.BINS - 1)
    keys = defaultdict(list)
    for p in points:
        keys[bin_(p), math.floor(p[4] * sharding.BINS)].append(p)
    half = len(room) // 2
    goal = sum(p[5] for p in points) * sum(room[:half]) / sum(room)
    left, right, total = [], [], 0.0
    for k in sorted(keys):
        w = sum(p[5] for p in keys[k])
        (right if right or total + w / 2 > goal else left).extend(keys[k])
        total += w
    return {**plain_tree(left, room[:half], first, ranges), **plain_tree(right, room[half:], first + half, ranges)}


@pytest.mark.parametrize("shards", [8, 5])
def test_sharding_tree_against_sorting(spark, shards):
    rng = random.Random(shards)
    points = [(i, float(rng.choice([0, 0, 0, 5, 9, 12])), float(rng.choice([1, 1, 2])), rng.choice([0.0, rng.uniform(0, 14)]), rng.random(), float(rng.randrange(1, 5000))) for i in range(1500)]
    room = [rng.uniform(0.5, 1.0) for _ in range(shards)]
    df = spark.createDataFrame(points, "id long, by_source double, by_lang double, by_size double, tie double, weight double").repartition(3)
    got = sharding.tree(df, room, {"by_source": 12.0, "by_lang": 1.0, "by_size": max(p[3] for p in points) - min(p[3] for p in points)})
    want = plain_tree(points, room)
    assert {r["id"]: r["shard"] for r in got.collect()} == want and set(want.values()) == set(range(shards))
    # All three kinds of metadata split nodes, so no shard holds a plain mixture of everything.
    homes = lambda d: {(p[d], want[p[0]]) for p in points if p[d] in (0.0, 1.0, 2.0, 5.0, 9.0, 12.0)}
    assert len(homes(1)) < 4 * shards


def test_sharding_edges(spark):
    _, df = table(spark, 5)
    assert sharding.shard(df.where("false")).count() == 0
    same = spark.range(900).select(F.col("id").alias("doc_id"), F.lit("one text").alias("text"), F.lit(None).cast("string").alias("lang"), F.lit("s").alias("source"))
    load = Counter(r["shard"] for r in sharding.shard(same).collect())
    assert len(load) == 8 and max(load.values()) <= 1.02 * min(load.values()) + 1
    one_key = spark.createDataFrame([(7, "text of one key " * 3, "en", "s", i) for i in range(400)], "doc_id long, text string, lang string, source string, shard int").repartition(3)
    out = sharding.shard(one_key).collect()
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert len(out) == 400 and len(slots) == 8 and all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert Counter(r["shard"] for r in sharding.shard(df, shards=3).collect()).keys() <= {0, 1, 2}


def test_sharding_with_a_hot_text(spark):
    """Half of all rows share a text; the others have their own."""
    rng = random.Random(4)
    rows = [(i, "hot " * 40 if i % 2 else " ".join(str(rng.random()) for _ in range(rng.randrange(1, 20))), rng.choice(["en", "de"]), f"s{i % 7}") for i in range(3000)]
    load = Counter()
    for r in sharding.shard(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect():
        load[r["shard"]] += r["size"]
    mean = sum(load.values()) / 8
    assert len(load) == 8 and max(abs(x - mean) for x in load.values()) < 0.02 * mean


def shared(sizes, weights=(5, 2, 1), cap=3):
    """Targets by sharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, goal, left = set(), dict.fromkeys(order, 0.0), float(sum(sizes.values()))
    while left > 1e-9:
        rest = [s for s in order if s not in full]
        if not rest:
            break
        total, over = sum(weight[s] for s in rest), 0.0
        for s in rest:
            goal[s] += left * weight[s] / total
            if goal[s] >= cap * sizes[s]:
                over += goal[s] - cap * sizes[s]
                goal[s] = cap * sizes[s]
                full.add(s)
        left = over
    return goal


@pytest.mark.parametrize("seed", range(1, 11))
def test_mixing(spark, seed):
    rows, df = table(spark, seed=seed)
    out = mixing.mix(df).collect()
    words = lambda t: len(re.findall(r"[^ \t-\r]+", t or ""))
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in out) == Counter((r[0], r[3], words(r[1])) for r in rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += words(r[1])
    want, taken = shared(sizes), Counter()
    for r in out:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]] and 0 <= r["copies"] <= 3
        taken[r["source"]] += r["size"] * r["copies"]
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    assert all(abs(taken[s] - want[s]) <= max(100, 0.02 * want[s]) for s in want)
    if seed > 2:
        return
    kept = mixing.repeat(df)
    assert kept.columns == df.columns
    assert sorted(map(tuple, mixing.mix(df.repartition(3)).select("doc_id", "copies").collect())) == sorted((r["doc_id"], r["copies"]) for r in out)


def test_mixing_capped_sources(spark):
    """Small sources of high weight are capped and their excess goes on, in several rounds."""
    sizes = {"a": 10, "b": 3000, "c": 400, "d": 50, "e": 20, None: 9000}
    df = spark.createDataFrame([(i, "w " * 5, s) for s, n in sizes.items() for i in range(n // 5)], "doc_id long, text string, source string")
    got = {r["source"]: r["target"] for r in mixing.mix(df).select("source", "target").distinct().collect()}
    assert got == {k: pytest.approx(v) for k, v in shared(sizes).items()}
    assert mixing.mix(df.where("false")).count() == 0 and mixing.mix(df.withColumn("text", F.lit(None).cast("string"))).where("copies > 3").count() == 0


def test_mixing_is_an_unequal_pareto_draw(spark):
    """One source of two sizes among others: the draw follows p, and its order is Pareto's."""
    rows = [(i, "w " * (40 if i % 2 else 10), "a") for i in range(4000)] + [(10_000 + i, "w " * 25, "b") for i in range(8000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = [r for r in mixing.mix(df, weights=(1, 4)).collect() if r["source"] == "a"]
    target, mean = out[0]["target"], 25.0
    steps = {n: math.floor(math.sqrt(n / mean) * 16 + 0.5) for n in (10, 40)}
    c = target / (2000 * (10 * steps[10] + 40 * steps[40]))
    p = {n: c * steps[n] for n in steps}
    assert all(0.1 < x < 0.9 for x in p.values()) and not any(r["exchanged"] for r in out)
    for n in steps:
        assert abs(sum(r["drawn"] for r in out if r["size"] == n) / 2000 - p[n]) < 0.04
    u = lambda i: (int(hashlib.md5(f"mix-1:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    order = sorted(out, key=lambda r: u(r["doc_id"]) / (1 - u(r["doc_id"])) * (1 - p[r["size"]]) / p[r["size"]])
    drawn = [r["drawn"] for r in order]
    assert drawn == sorted(drawn, reverse=True) and abs(sum(r["size"] * r["copies"] for r in out) - target) <= 20
    even = [r for r in mixing.mix(df, weights=(1, 4), utility=F.lit(1.0)).collect() if r["source"] == "a"]
    assert abs(sum(r["drawn"] for r in even if r["size"] == 10) - sum(r["drawn"] for r in even if r["size"] == 40)) < 150


def test_exchange_closes_the_gap_with_few_changes():
    rng = np.random.default_rng(5)
    for _ in range(30):
        taken, passed = rng.integers(1, 60, rng.integers(0, 7)), rng.integers(1, 60, rng.integers(0, 7))
        gap, tolerance = float(rng.integers(-80, 80)) + 0.5, 2.0
        runs = lambda x: [(0, 0), *[(i, j) for i in range(len(x)) for j in range(i + 1, len(x) + 1)]]
        ways = [(gap + taken[a:b].sum() - passed[c:d].sum(), b - a + d - c) for a, b in runs(taken) for c, d in runs(passed)]
        best = min((0.0 if abs(g) <= tolerance else abs(g), n, abs(g)) for g, n in ways)
        out, in_ = mixing.exchange(taken, passed, gap, tolerance)
        left = abs(gap + taken[out].sum() - passed[in_].sum())
        assert (0.0 if left <= tolerance else left, out.stop - out.start + in_.stop - in_.start, left) == best


def test_mixing_ties_on_the_cut(spark):
    """Rows of one key and size tie in rank: exactly as many as the target needs are drawn."""
    rows = [(7, "w " * 10, "a")] * 50 + [(i, "w " * 10, "b") for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    out = mixing.mix(df, weights=(3, 8)).collect()
    for s in "ab":
        mine = [r for r in out if r["source"] == s]
        assert abs(sum(r["size"] * r["copies"] for r in mine) - mine[0]["target"]) <= 5


def test_repeat_with_clashing_names(spark):
    names = ["doc_id", "text", "source", "copies", "__copies", "__key", "__row", "row", "doc", "key", "size", "u", "rank", "at", "target"]
    df = spark.createDataFrame([(i, f"w{i} x", "s", *range(12)) for i in range(30)], "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names[3:]))
    kept = mixing.repeat(df)
    assert kept.columns == names and sorted(map(tuple, kept.collect())) == sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("key", [None, 7])
def test_repeat_decides_row_by_row(spark, key):
    """Rows that share a null or repeated id have copies of their own, so every source meets its target."""
    rows = [(key, f"{s}{i if i % 2 else 0} " * 10, s) for s, n in (("a", 60), ("b", 90), ("c", 150)) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    want, taken, times = shared({"a": 600, "b": 900, "c": 1500}), Counter(), Counter()
    kept = mixing.repeat(df)
    for r in kept.collect():
        taken[r["source"]] += 10
        times[r["text"]] += 1
    assert kept.columns == df.columns and all(abs(taken[s] - want[s]) <= 10 for s in want)
    assert all(times[t] <= 3 * n for t, n in Counter(r[1] for r in rows).items())
    mixed = mixing.mix(df).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("n"))
    assert all(abs(r["n"] - want[r["source"]]) <= 10 for r in mixed.collect())


URLS = [
    None, "", "no scheme", "://", "http://", "HTTP://A.COM/en/x?y://z", "http://com/en/", "http://xcom/en/1", "http://sub.example.com/en/7?x", "http://example.com/en/8", "https://EXAMPLE.net/de/81#a",
    "https://a.net/de/9", "https://a.net/DE/9", "https://a.org?es/", "https://b.a.org/es/", "ftp://h#/com/en/", "x\ny://h.com/en/1\nz", "http://casino-win.example.com/fr/1",
]


def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(r), v, r) for v, r in urlfilter.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fits)[1:] if fits else None


def test_urls(spark):
    rng = random.Random(2)
    good = [f"http://{rng.choice(['news', 'blog', 'www'])}.site{rng.randrange(9)}.example/{rng.randrange(999)}" for _ in range(300)]
    bad = [f"http://casino-{rng.choice(['win', 'max'])}.example/{rng.randrange(999)}" for _ in range(60)]
    df = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(URLS + good + bad)], "page_id long, url string, host string, path string")
    out = {r["page_id"]: r for r in urlfilter.judge(df).collect()}
    for i, u in enumerate(URLS + good + bad):
        host, path, rule = plain_rule(u)
        assert (out[i]["host"], out[i]["path"]) == (host, path), u
        assert out[i]["rule"] == (rule and rule[1]) and (rule is None or out[i]["verdict"] == rule[0])
    n = len(URLS) + len(good)
    assert sum(out[i]["verdict"] == "block" for i in range(len(URLS), n)) <= 3
    assert all(out[i]["verdict"] == "block" for i in range(n, n + len(bad)))
    assert urlfilter.judge(df.where("false")).count() == 0


def test_url_rules_of_the_contract(spark):
    """The contract's list word for word, not the library's own."""
    want = [
        ("http://a.com/en/1", "com/en/", "block"), ("http://example.com/en/71", "example.com/en/7", "allow"), ("http://m.example.com/en/8", "com/en/", "block"),
        ("http://a.net/de/8", "net/de/", "allow"), ("http://net/de/", "net/de/", "allow"), ("http://example.net/de/9", "net/de/", "allow"),
        ("http://example.net/de/8", "example.net/de/8", "block"), ("http://www.Example.NET/de/81?x", "example.net/de/8", "block"), ("http://b.a.org/es/3#t", "org/es/", "block"),
    ]
    df = spark.createDataFrame([(i, u) for i, (u, _, _) in enumerate(want)], "page_id long, url string")
    out = {r["page_id"]: (r["rule"], r["verdict"]) for r in urlfilter.judge(df).collect()}
    assert [(u, *out[i]) for i, (u, _, _) in enumerate(want)] == want


def plain_score(url, good, bad, order=urlfilter.ORDER):
    """Witten-Bell from its definition: counts by direct search in the training texts."""

    def log_likelihood(texts):
        joined, out = [t + "\n" for t in texts], 0.0
        whole = url + "\n"
        for i, c in enumerate(whole):
            p = 1.0 / 65536
            for n in range(min(i, order) + 1):
                context = whole[i - n : i]
                after = [t[j + n] for t in joined for j in range(len(t) - n) if t.startswith(context, j)]
                if not after:
                    break
                kinds = len(set(after))
                p = (after.count(c) + kinds * p) / (len(after) + kinds)
            out += math.log(p)
        return out

    return (log_likelihood(bad) - log_likelihood(good)) / len(url)


def test_url_scores_against_plain_counts(spark):
    rng = random.Random(7)
    good = [f"site{rng.randrange(5)}.example/{rng.choice('abc')}{rng.randrange(30)}" for _ in range(25)]
    bad = [f"casino{rng.randrange(5)}.example/win{rng.randrange(9)}" for _ in range(12)]
    model = urlfilter.Ratio(good, bad)
    fitted = [x for i, x in enumerate(good) if i % urlfilter.HELD_OUT], [x for i, x in enumerate(bad) if i % urlfilter.HELD_OUT]
    urls = [good[0], bad[0], "x", "é/日本", "casino1.example/win3" + "/y" * 40, ""]
    df = spark.createDataFrame([(i, "HTTP://" + u.upper() if i == 1 else "http://" + u) for i, u in enumerate(urls)] * 2, "page_id long, url string")
    out = urlfilter.judge(df, model=model, rules=()).collect()
    assert len(out) == 2 * len(urls)
    for r in out:
        u = urls[r["page_id"]]
        if not u:
            assert r["score"] is None and r["verdict"] == "allow"
            continue
        assert r["score"] == pytest.approx(plain_score(u, *fitted), abs=1e-9)
        assert r["verdict"] == ("block" if r["score"] > model.threshold else "allow")


def test_url_models_find_held_out_rejected_urls(spark):
    rng = random.Random(11)
    good = [f"http://{rng.choice(['news', 'blog', 'www'])}.site{rng.randrange(40)}.example/{rng.randrange(9999)}" for _ in range(800)]
    bad = [f"http://{rng.choice(['poker', 'spam'])}-{rng.choice(['win', 'max', 'top'])}{rng.randrange(40)}.example/offer?id={rng.randrange(9999)}" for _ in range(400)]
    long_ = ["http://site1.example/" + "a1/" * 3000, "http://spam-max.example/offer?id=" + "7" * 9000]
    df = spark.createDataFrame([(i, u, i >= 800) for i, u in enumerate(good + bad)] + [(9000 + i, u, None) for i, u in enumerate(long_)], "page_id long, url string, bad boolean")
    for label in (None, F.col("bad")):
        assert urlfilter.fit(df, label).recall > 0.95
    out = {r["page_id"]: r["verdict"] for r in urlfilter.judge(df.unionByName(df.limit(3))).collect()}
    assert out[9001] == "block" and len(out) == 1202


def test_url_models_count_every_url(spark, monkeypatch):
    """Counts, threshold and recall from all distinct URLs and their whole lengths, by plain models of them all."""
    monkeypatch.setattr(urlfilter, "HELD_KEYS", 500)
    monkeypatch.setattr(urlfilter, "FEW", 10)
    rng = random.Random(5)
    good = [f"site{rng.randrange(40)}.example/{i}" for i in range(4600)] + ["site1.example/" + "".join(rng.choice("abc") for _ in range(3000))]
    bad = [f"casino-{rng.randrange(9)}.example/win{i}" for i in range(90)] + ["poker.example/" + "xy" * 1500]
    df = spark.createDataFrame([(i, "http://" + u) for i, u in enumerate(good + bad + good[:50])], "page_id long, url string")
    fold = {r["u"]: r["f"] for r in df.select(F.substring("url", 8, 9999).alias("u")).select("u", F.pmod(F.xxhash64("u"), F.lit(urlfilter.HELD_OUT)).alias("f")).collect()}
    score = lambda u, g, b: (b.log_likelihood(u) - g.log_likelihood(u)) / len(u)
    model = lambda urls: urlfilter.Markov().fit(urls)
    crossed = {}
    for f in range(urlfilter.HELD_OUT):
        g, b = (model([u for u in urls if fold[u] != f]) for urls in (good, bad))
        crossed |= {u: score(u, g, b) for u in good + bad if fold[u] == f}
    held = sorted(crossed[u] for u in good)
    threshold = max(0.0, held[min(len(held) - 1, math.ceil(len(held) * (1 - urlfilter.MOST_WRONG)))])
    g, b = model(good), model(bad)
    out = {r["page_id"]: r for r in urlfilter.judge(df, rules=()).collect()}
    assert len(out) == len(good + bad) + 50
    for i, u in enumerate(good + bad):
        assert out[i]["score"] == pytest.approx(score(u, g, b), abs=1e-9)
        assert out[i]["verdict"] == ("block" if score(u, g, b) > threshold else "allow")
    fitted = urlfilter.fit(df)
    assert fitted.threshold == pytest.approx(threshold, abs=1e-9)
    assert fitted.recall == sum(crossed[u] > threshold for u in bad) / len(bad)


@pytest.mark.parametrize("block", [16, 64, 10**6])
def test_search(spark, monkeypatch, block):
    monkeypatch.setattr(hamming, "BLOCK_ROWS", block)
    monkeypatch.setattr(hamming, "BATCH_QUERIES", 2)
    monkeypatch.setattr(hamming, "QUERY_ROWS", 3)
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 2**63, 300, np.int64)
    codes[100:180] = codes[0]  # a hot vector
    codes[180:220] = codes[1] ^ (np.int64(1) << rng.integers(0, 62, 40))
    rows = [(i, int(c)) for i, c in enumerate(codes)] + [(1000, None)]
    df = spark.createDataFrame(rows, "id long, code long")
    got = defaultdict(list)
    for r in hamming.top_k(df, df.where("id % 50 = 0"), 10).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["distance"], r["id"]))
    for q in range(0, 300, 50):
        assert got[q] == sorted((int(codes[q] ^ c).bit_count() if codes[q] ^ c >= 0 else (int(codes[q] ^ c) & (2**64 - 1)).bit_count(), i) for i, c in enumerate(codes))[:10]
    assert hamming.top_k(df.where("false"), df.where("false")).count() == 0
    # A third of all rows share one id; fewer rows than k; extra columns.
    same = spark.createDataFrame([(7, int(c), "x", 1) for c in codes[:40]], "id long, code long, at string, most int")
    found = [(r["distance"], r["id"]) for r in hamming.top_k(same, same.limit(1), 100).orderBy("rank").collect()]
    first = same.limit(1).first()["code"]
    assert found == sorted((int((int(c) ^ first) & (2**64 - 1)).bit_count(), 7) for c in codes[:40])


def test_sign_codes(spark):
    df = spark.createDataFrame([([1.0, -1.0] * 32,), ([0.5] * 63 + [None],), ([1.0] * 3,), (None,)], "v array<float>")
    assert [r[0] for r in df.select(hamming.sign_code(F.col("v"))).collect()] == [int("10" * 32, 2) - 2**64, -2, None, None]


def test_licenses(spark):
    rows = [
        ("a/LICENSE", "Released under the MIT License."), ("a/x.py", "code"), ("a/b/y.py", None), ("a/b/c/COPYING", "intro\nThis work is licensed under the GNU General Public License, version 3."),
        ("a/b/c/z.py", ""), ("a/b/c/d/w.py", "# Licensed under the Apache License, Version 2.0.\nrest " + "word " * 500), ("q/v.py", "the a of"), (None, "x"), ("top.py", "this license word alone"),
        ("a/x.py", "code"),
    ]
    out = Counter((r["path"], r["license"], r["origin"], r["from_dir"]) for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect())
    assert out == Counter(
        {
            ("a/LICENSE", "MIT", "own", None): 1, ("a/x.py", "MIT", "inherited", "a"): 2, ("a/b/y.py", "MIT", "inherited", "a"): 1, ("a/b/c/COPYING", "GPL-3.0", "own", None): 1,
            ("a/b/c/z.py", "GPL-3.0", "inherited", "a/b/c"): 1, ("a/b/c/d/w.py", "Apache-2.0", "own", None): 1, ("q/v.py", None, None, None): 1, ("", None, None, None): 1, ("top.py", None, None, None): 1,
        }
    )
    assert licenses.scan(spark.createDataFrame([], "path string, text string")).count() == 0


# Opening sections of public license texts, wrapped as their files are.
OPENINGS = {
    "GPL-3.0": """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>
 Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.

  The GNU General Public License is a free, copyleft license for
software and other kinds of works.
  13. Use with the GNU Affero General Public License.""",
    "GPL-2.0": """                    GNU GENERAL PUBLIC LICENSE
                       Version 2, June 1991

 Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.
  0. This License applies to any program or other work which contains
a notice placed by the copyright holder saying it may be distributed
under the terms of this General Public License.""",
    "LGPL-3.0": """                   GNU LESSER GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

  This version of the GNU Lesser General Public License incorporates
the terms and conditions of version 3 of the GNU General Public
License, supplemented by the additional permissions listed below.""",
    "LGPL-2.1": """                  GNU LESSER GENERAL PUBLIC LICENSE
                       Version 2.1, February 1999

  This license, the Lesser General Public License, applies to some
specially designated software packages--typically libraries--of the
Free Software Foundation and other authors who decide to use it.""",
    "AGPL-3.0": """                    GNU AFFERO GENERAL PUBLIC LICENSE
                       Version 3, 19 November 2007

  The GNU Affero General Public License is a free, copyleft license for
software and other kinds of works, specifically designed to ensure
cooperation with the community in the case of network server software.""",
    "Apache-2.0": """                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION
   1. Definitions.
      "License" shall mean the terms and conditions for use, reproduction,
      and distribution as defined by Sections 1 through 9 of this document.""",
    "MPL-2.0": """Mozilla Public License Version 2.0
==================================

1.1. "Contributor"
    means each individual or legal entity that creates, contributes to
    the creation of, or owns Covered Software.""",
    "MIT": """Copyright (c) 2020 Some Holder

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal in the Software without restriction
The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.""",
    "ISC": """Copyright 2021 Some Holder

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE""",
    "BSD-2-Clause": """Copyright (c) 2019, Some Holder

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.""",
}
OPENINGS["BSD-3-Clause"] = OPENINGS["BSD-2-Clause"] + """

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""


@pytest.mark.parametrize("most", [licenses.BROADCAST_BYTES, -1])
def test_license_texts(spark, monkeypatch, most):
    """Whole files are recognised whatever their name, and give their license to their directory."""
    monkeypatch.setattr(licenses, "BROADCAST_BYTES", most)
    rng = random.Random(8)
    prose = lambda n: " ".join(rng.choice(["some", "other", "prose", "number", "7", "house", "free", "software", "version", "work"]) for _ in range(n))
    rows = []
    for name, text in OPENINGS.items():
        rows += [(f"{name}/legal.txt", text + "\n" + prose(3000)), (f"{name}/src/a.py", "x"), (f"{name}/src/b.py", None)]
    rows += [(f"hot/{i}.py", "code") for i in range(300)] + [("hot/LICENSE", "# " + OPENINGS["MIT"].replace("\n", "\n# "))]
    df = spark.createDataFrame([(p, t, p, 1.0, "x") for p, t in rows], "path string, text string, license string, score double, dir string")
    out = {r["path"]: r for r in licenses.scan(df, keys=("license", "score", "dir")).collect()}
    for name in OPENINGS:
        assert out[f"{name}/legal.txt"]["license"] == name and out[f"{name}/legal.txt"]["origin"] == "own", name
        assert [(out[f"{name}/src/{f}.py"]["license"], out[f"{name}/src/{f}.py"]["from_dir"]) for f in "ab"] == [(name, name)] * 2, name
    assert all(out[f"hot/{i}.py"]["license"] == "MIT" for i in range(300)) and all(r["license_key"] == p and r["score_key"] == 1.0 and r["dir"] == "x" for p, r in out.items())


def test_notices_inside_paragraphs(spark):
    """What stands around a notice does not count, however common its words and however large the corpus."""
    rng = random.Random(3)
    filler = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    rows = [(f"p/{i}", filler(80)) for i in range(500)]
    rows += [("q/1", f"{filler(30)} Released under the MIT License. {filler(30)}"), ("q/2", f"Released under the MIT License by Ada Holder {filler(4)}"), ("z/3", f"{filler(9)} the license of works {filler(9)}")]
    # Two licenses in one file tie: the first place counts.
    rows += [("q/4", "Released under the MIT License. Licensed under the Apache License, Version 2.0."), ("q/5", "Licensed under the Apache License, Version 2.0. Released under the MIT License.")]
    out = {r["path"]: r["license"] for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert [out[f"q/{i}"] for i in (1, 2, 4, 5)] == ["MIT", "MIT", "MIT", "Apache-2.0"] and out["z/3"] is None
    assert not any(v for p, v in out.items() if p.startswith("p/"))


def test_queries_name_every_operator():
    assert sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0])) == [
        "op1_pii", "op2_sharding", "op3_licenses", "op4_urls", "op5_top_k", "op6_secrets", "op7_jaccard", "op8_bpe", "op9_quality", "op10_mixing",
    ]


def test_pipeline(spark, sf_dir):
    """Every stage against its operator's plain result: the rows that stay, their texts and their copies."""
    from tokenizers import Tokenizer

    from tensorloom.llm import bpe, pii, quality

    docs = spark.read.parquet(sf_dir.replace("sf0.01", "sf0.001") + "/documents.parquet")
    long_ = " ".join(f"word{i % 7919}x{i}" for i in range(40_000)) + " mail a.b@c.org"
    extra = [(9001, None, "en", "src1", 0), (9002, long_, None, None, len(long_)), (9003, "", "en", None, 0), (None, long_.replace("word5x", "other5x"), "en", "src1", None)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    docs = docs.unionByName(docs.where("doc_id < 5")).unionByName(docs.where("doc_id = 9002"))
    held, want = docs, docs
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        held = stage(spark, held, sf_dir)
        assert held.columns == docs.columns, name
        rows = held.collect()
        before = want.collect()
        if n == 0:
            good = {r["doc_id"] for r in quality.ledger(want).where(quality.passes()).collect()}
            expected = [r for r in before if r["doc_id"] in good]
            assert good and len(expected) < len(before)
        elif n == 1:
            numbered = spark.createDataFrame([(i, r["text"]) for i, r in enumerate(before)], "doc_id long, text string")
            of = {r["doc_id"]: r["component_id"] for r in jaccard.join(numbered, k=5, threshold=80).collect()}
            groups = defaultdict(list)
            for i, r in enumerate(before):
                groups[of[i]].append(r)
            expected = [min(g, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, hashlib.md5(r["text"].encode()).hexdigest())) for g in groups.values()]
            assert len(expected) < len(before)
        elif n == 2:
            masked = {r["doc_id"]: r["text"] for r in pii.redact(want).collect()}
            expected = [docs.sparkSession.createDataFrame([(*[r[c] for c in ("doc_id",)], masked[r["doc_id"]], r["lang"], r["source"], r["n_chars"] if masked[r["doc_id"]] == r["text"] else len(masked[r["doc_id"]]))], docs.schema).first() for r in before[:5]]
            assert {r["doc_id"]: r["text"] for r in rows} == masked and all(r in rows for r in expected)
            expected = rows
        else:
            times = {r["key"]: r["copies"] for r in mixing.mix(want.select(F.col("doc_id").alias("key"), "text", "source"), key="key").collect()}
            expected = [r for r in before for _ in range(times[r["doc_id"]])]
            assert max(times.values()) <= mixing.CAP and any(c > 1 for c in times.values())
        assert Counter(map(tuple, rows)) == Counter(map(tuple, expected)), name
        held = want = spark.createDataFrame(rows, docs.schema)
    library = Tokenizer.from_file(bpe.public_vocabulary())
    texts = Counter((r["doc_id"], r["text"]) for r in held.collect())
    out = corpus_pipeline.STAGES[-1][1](spark, held, sf_dir).collect()
    ids = {k: b"".join(i.to_bytes(4, "little") for i in library.encode(k[1], add_special_tokens=False).ids) for k in texts}
    assert Counter((r["doc_id"], bytes(r["ids"]), r["n_tokens"]) for r in out) == Counter({(k[0], ids[k], len(ids[k]) // 4): n for k, n in texts.items()})
    assert all(r["intact"] for r in out)


def test_stages_on_an_empty_table(spark, sf_dir):
    none = spark.read.parquet(f"{sf_dir}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf_dir).count() == 0, name
