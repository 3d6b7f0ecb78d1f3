import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorloom.llm import jaccard, scratch


def brute(rows, k, threshold):
    """Components by comparing every pair of sets that share a shingle."""
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(words[j : j + k]) for j in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids, having = sorted(sets), {}
    for i in ids:
        for s in sets[i]:
            having.setdefault(s, []).append(i)
    seen = set()
    for same in having.values():
        for x in range(len(same)):
            for y in range(x):
                seen.add((same[y], same[x]))
    for a, b in seen:
        both = len(sets[a] & sets[b])
        if 100 * both >= threshold * len(sets[a] | sets[b]):
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def got(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def near_copies(seed, n=400):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    passage = [word() for _ in range(55)]
    texts = []
    for _ in range(n // 8):
        base = [word() for _ in range(rng.choice([3, 5, 8, 30, 120, 300]))]
        if rng.random() < 0.5:
            base[1:1] = passage
        for _ in range(8):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("k", "threshold", "seed"), [(4, 85, 1), (5, 80, 2), (4, 100, 3), (2, 50, 4)])
def test_equals_brute_force(spark, monkeypatch, k, threshold, seed):
    monkeypatch.setattr(jaccard, "FREQUENT", 10)
    monkeypatch.setattr(jaccard, "GROUP_ROWS", 4)
    monkeypatch.setattr(jaccard, "HOT", 3)
    monkeypatch.setattr(jaccard, "UNIT_ROWS", 5)
    rows = near_copies(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(jaccard.join(df, k=k, threshold=threshold)) == brute(rows, k, threshold)


def test_sizes_at_the_border_of_a_link(spark, monkeypatch):
    """Sets whose sizes are just as far apart as a link allows are compared in every cut of a cluster."""
    monkeypatch.setattr(jaccard, "UNIT_ROWS", 1)
    rows = []
    for place, n in enumerate((17, 34, 51, 68, 85, 170, 340)):
        words = [f"w{place}x{i}" for i in range(20 * n // 17 + 4)]
        for size in (n - 1, n, 20 * n // 17, 20 * n // 17 + 1):
            rows.append((len(rows), " ".join(words[: size + 3])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(jaccard.join(df)) == brute(rows, 4, 85)


def test_a_cut_cluster_compares_neighbouring_sizes_only(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "UNIT_ROWS", 2)
    rows = [(bytes([i]), i, n, i, 7) for i, n in enumerate([10, 10, 10, 11, 100, 100, 100, 110, 1000, 1000])]
    placed = jaccard._placed(spark.createDataFrame(rows, "digest binary, mark long, n long, group long, cluster long"), 85).collect()
    bands = {r["band"] for r in placed}
    assert len(bands) >= 3
    for r in placed:
        assert (r["before"] > 0) == (r["band"] - 1 in bands) and (r["after"] > 0) == (r["band"] + 1 in bands) and 0 <= r["block"] < r["blocks"]


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a b"), (5, "A  B"), (6, "a b c d e"), (6, "a b c d e"), (7, "É é x y z"), (8, "é é x y z"), (9, "w " * 30000)]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, n int, digest string")
    assert got(jaccard.join(df)) == {1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (1, 4), 5: (1, 4), 6: (2, 6), 7: (2, 7), 8: (2, 8), 9: (1, 9)}
    left = jaccard.keep_one(df)
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 2, 3, 4, 6, 7, 8, 9] and left.columns == df.columns
    assert jaccard.join(df.where("false")).count() == 0


def test_small_broadcasts_are_not_needed(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(jaccard, "UNIT_TOKENS", 100)
    monkeypatch.setattr(jaccard, "MOST_FREQUENT", 20)
    monkeypatch.setattr(jaccard, "FREQUENT", 5)
    rows = near_copies(9, 160)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(jaccard.join(df)) == brute(rows, 4, 85)


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    assert got(jaccard.join(docs)) == brute([tuple(r) for r in docs.collect()], 4, 85)
    assert docs.count() > jaccard.keep_one(docs).agg(F.count("*")).first()[0]


def test_keep_one_decides_row_by_row(spark):
    """Null and repeated ids with different texts: only copied rows go."""
    rows = [(1, "one two three four five", "a"), (None, "one two three four five", "b"), (None, "alone among the null ids", "c"), (None, None, "d"), (None, "", "e"), (1, "same id but another text here", "f"),
            (2, "same id but another text here", "g"), (2, "kept for its unique text", "h"), (None, "twice without any id at all", "i"), (None, "twice without any id at all", "j")]
    for parts in (1, 5):
        left = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string, mark string").repartition(parts))
        got = [r["mark"] for r in left.collect()]
        assert left.columns == ["doc_id", "text", "mark"]
        assert sorted("i" if m == "j" else m for m in got) == list("acdefhi")


def test_word_hashes_tell_words_apart_wherever_they_stand(monkeypatch):
    monkeypatch.setattr(jaccard, "PIECE", 64)
    jaccard._powers.clear()
    rng = random.Random(2)
    pool = ["a", "b", "ab", "ba", "é", "x" * 300, "x" * 299 + "y", "y" * 63, "y" * 64, "y" * 65, "日本"] + ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    of = {}
    for _ in range(200):
        words = [rng.choice(pool) for _ in range(rng.randrange(0, 30))]
        text = rng.choice(["", " "]) + "".join(w + rng.choice([" ", "\n", "\t ", "  "]) for w in words) + rng.choice(["", "tail"])
        words = text.split()
        found = jaccard.word_hashes(np.frombuffer(text.encode(), np.uint8)).tolist()
        assert len(found) == len(words)
        for w, h in zip(words, found, strict=True):
            assert of.setdefault(w, h) == h
    assert len(set(of.values())) == len(of)
    jaccard._powers.clear()


@pytest.mark.parametrize("threshold", [50, 85, 100])
def test_size_bounds_lose_no_link(spark, threshold):
    """The prefix tokens asked of two ranges of sizes are no more than what any linked pair of sets in them shares."""
    rng, rows = random.Random(threshold), []
    for m in range(1, 60):
        for n in range(m, 130):
            both = -(-threshold * (m + n) // (100 + threshold))
            shared = both - max(jaccard.needed(n, threshold) - jaccard.LEAST_SHARED, 0)
            sides = [(max(1, x - rng.choice([0, 0, 3])), x + rng.choice([0, 0, 9])) for x in (m, n)]
            rows.append((m, n, *sides[0], *sides[1], 100 * m >= threshold * n, shared, sides == [(m, m), (n, n)]))
    can, must = jaccard._size_bounds("lo", "hi", "low", "high", threshold)
    df = spark.createDataFrame(rows, "m int, n int, lo long, hi long, low long, high long, linked boolean, shared int, exact boolean")
    for r in df.select("*", can.alias("can"), must.alias("must")).collect():
        assert not r["linked"] or (r["can"] and r["must"] <= r["shared"]), r
        assert not r["exact"] or r["can"] == r["linked"], r
        assert not (r["exact"] and r["linked"]) or r["must"] >= min(jaccard.LEAST_SHARED, jaccard.needed(r["m"], threshold)), r


def test_texts_of_unlike_sizes_are_not_opened(spark, monkeypatch):
    """Texts that share prefix tokens but whose sizes rule out a link are not read again."""
    opened = []
    monkeypatch.setattr(jaccard, "freed", lambda df, name: (out := scratch.freed(df, name), opened.append(out.count()) if name == "placed" else None)[0])
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = []
    for _ in range(60):
        base = [word() for _ in range(60)]
        rows += [base, base + [word() for _ in range(60)]]
    rows = list(enumerate(" ".join(r) for r in rows))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(jaccard.join(df)) == brute(rows, 4, 85)
    assert opened == [0]


def test_many_candidates_are_sieved_without_a_shuffle_of_the_texts(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(jaccard, "SIEVE_BITS", 1 << 17)
    docs = spark.range(5000).selectExpr("id as key", "xxhash64(cast(id as string)) as mark", "repeat('x ', 50) as text")
    marks = docs.where("key % 25 = 0").select(F.col("mark").alias("m"))
    left = jaccard._sieved(docs, marks)
    assert left.columns == docs.columns
    keys = [r["key"] for r in left.select("key").collect()]
    assert len(set(keys)) == len(keys) and set(range(0, 5000, 25)) <= set(keys) and len(keys) < 260
    assert "hashpartitioning" not in left._jdf.queryExecution().executedPlan().toString()


def test_large_clusters_are_compared_in_rounds(spark, monkeypatch):
    """Sets that go to many units are sent in rounds, each to a few units; no link is lost."""
    monkeypatch.setattr(jaccard, "UNIT_ROWS", 4)
    monkeypatch.setattr(jaccard, "GROUP_ROWS", 4)
    names = []
    monkeypatch.setattr(jaccard, "freed", lambda df, name: names.append(name) or scratch.freed(df, name))
    rng = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(f"x{i}" if j == at else w for j, w in enumerate(base))) for i in range(60) for at in [rng.randrange(120)]]
    rows += [(60, " ".join(base)), (61, "some other text of its own")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(jaccard.join(df)) == brute(rows, 4, 85)
    assert 2 <= names.count("found") <= 16 and names.count("members") == 1


def test_steps_leave_no_shuffle_files(spark):
    blocks, before = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager(), spark.conf.get(scratch.CLEANUP)

    def files():
        found = blocks.getAllFiles()
        return {name for i in range(found.size()) if (name := found.apply(i).getName()).startswith("shuffle_")}

    old = files()
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("a")).agg(F.max("id").alias("b"))
    jaccard.freed(df, "least")
    till = time.time() + 20
    while left := files() - old:
        assert time.time() < till, left
        time.sleep(0.2)
    assert spark.conf.get(scratch.CLEANUP) == before
