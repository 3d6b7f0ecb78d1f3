r"""URL filtering: host and path rules first, a character language-model ratio for the rest.

Two smoothed variable-order Markov models over characters, one of accepted and one of rejected
URLs, are interpolated by Witten-Bell weights from order ``ORDER`` down to the uniform
distribution. A URL's score is the difference of its log-likelihoods (rejected minus accepted)
divided by its length; it is blocked if the score exceeds a threshold calibrated on held-out
accepted URLs so that at most ``MOST_WRONG`` of them would be blocked.

Labels are a bootstrap: unless ``label`` gives a column of them, a URL whose host has one of the
words of :data:`SEEDS` is rejected and every other accepted, so the models learn how URLs of such
hosts are written and carry that over to hosts without a seed. The models count every distinct URL
of each label at its whole length. The threshold comes from every accepted URL, each scored by models
of the other URLs only: a hash puts URLs into ``HELD_OUT`` folds, and a fold's counts are taken out
for its own. The rejected ones, scored alike, give :attr:`Counts.recall`.

The models grow with the URLs, so they are tables. A key is a context and the character after it;
its chance comes from that of the key without the first character, by a join for each order. URLs
are dealt over blocks of ``BLOCK_CHARS`` characters, and a block gets the chances of its own keys.
The driver sees a few sums. A single URL is scored in one task.

Defined results: a null URL, or one without ``://``, has an empty host and path, no rule and no
score, and is allowed. A text without characters after ``://`` is allowed likewise. With no
training URL of one label nothing is blocked by the models. Repeated URLs are judged alike; a score
at the threshold itself allows. Very long URLs are scored whole. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.llm.scratch import for_workers, written

ORDER = 5
MOST_WRONG = 0.002
#: One in so many URLs is left out of the models that score it for the threshold.
HELD_OUT = 4
#: Characters of a block of URLs; keys that a task counts before it lets them go; scores that the driver sorts.
BLOCK_CHARS, HELD_KEYS, FEW = 1 << 16, 200_000, 1000
#: Words of a host that mark its URLs as rejected.
SEEDS = ("adult", "porn", "xxx", "casino", "poker", "bets", "pills", "viagra", "spam", "ads")
#: (verdict, host and path): the rule fits its host and all subdomains.
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """The longest fitting rule as (verdict, rule), or null. Of equal lengths the first listed wins."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, text in sorted(reversed(rules), key=lambda r: len(r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(text).alias("rule"))).otherwise(out)
    return out


def seeded(host: Column) -> Column:
    """Whether one of the host's words is a seed."""
    return F.arrays_overlap(F.split(host, "[.-]"), F.array(*[F.lit(s) for s in SEEDS]))


class Markov:
    """Counts of characters after contexts of up to ``order`` characters."""

    def __init__(self, order: int = ORDER):
        self.order = order
        self.after: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))

    def fit(self, texts: list[str]) -> Markov:
        for text in texts:
            text = text + "\n"
            for i, c in enumerate(text):
                for n in range(min(i, self.order) + 1):
                    self.after[text[i - n : i]][c] += 1
        # context: (characters seen, kinds of characters, counts); plain dicts travel to workers.
        self.table = {k: (sum(v.values()), len(v), dict(v)) for k, v in self.after.items()}
        self.memo: dict[tuple[str, str], float] = {}
        del self.after
        return self

    def p(self, context: str, c: str) -> float:
        """Witten-Bell: a context's counts, with the weight of its kinds given to the shorter one."""
        out = 1.0 / 65536
        for n in range(len(context) + 1):
            got = self.table.get(context[len(context) - n :])
            if got is None:
                break
            total, kinds, counts = got
            out = (counts.get(c, 0) + kinds * out) / (total + kinds)
        return out

    def log_likelihood(self, text: str) -> float:
        out = 0.0
        for i, c in enumerate(text + "\n"):
            key = (text[max(0, i - self.order) : i], c)
            got = self.memo.get(key)
            if got is None:
                if len(self.memo) > 200_000:
                    self.memo.clear()
                got = self.memo[key] = math.log(self.p(*key))
            out += got
        return out


class Ratio:
    """The two models and the calibrated threshold, of lists that fit the driver."""

    def __init__(self, accepted: list[str], rejected: list[str]):
        split = lambda xs: ([x for i, x in enumerate(xs) if i % HELD_OUT], xs[::HELD_OUT] if len(xs) >= HELD_OUT else xs)
        (good, held), (bad, known) = split(accepted), split(rejected)
        self.models = (Markov().fit(good), Markov().fit(bad)) if good and bad else None
        scores = sorted(self.score(x) for x in held) if self.models else [0.0]
        self.threshold = max(0.0, scores[min(len(scores) - 1, math.ceil(len(scores) * (1 - MOST_WRONG)))])
        #: The part of the held-out rejected URLs that the models reject.
        self.recall = sum(self.score(x) > self.threshold for x in known) / len(known) if self.models else None

    def score(self, url: str) -> float | None:
        """Log-likelihood of rejected over accepted, for each character."""
        if self.models is None or not url:
            return None
        good, bad = self.models
        return (bad.log_likelihood(url) - good.log_likelihood(url)) / len(url)

    def counts(self, spark: SparkSession) -> Counts:
        """The same models as a table."""
        if self.models is None:
            return Counts(None, self.threshold, None)
        rows: dict[str, list[int]] = defaultdict(lambda: [0] * (2 * HELD_OUT))
        for slot, model in zip((0, HELD_OUT), self.models):
            for context, (_, _, after) in model.table.items():
                for c, n in after.items():
                    rows[context + c][slot] = n
        table = spark.createDataFrame([(k, *v) for k, v in rows.items()], "key string, " + ", ".join(f"{c} bigint" for c in _SLOTS))
        return Counts(table, self.threshold, self.recall)


@dataclass(frozen=True)
class Counts:
    """Fitted models: ``grams(key, n0, ...)``, how often each key came in each label and fold; None without URLs of a label."""

    grams: DataFrame | None
    threshold: float
    #: The part of the rejected URLs that models without them reject.
    recall: float | None


_SLOTS = [f"n{i}" for i in range(2 * HELD_OUT)]  # the folds of accepted, then those of rejected URLs


def _scored_part() -> Column:
    """What the models see: all after ``://``, A-Z lower-cased."""
    return F.translate(F.regexp_extract("url", r"^(?s:.*?)://(?s:(.*))$", 1), _UPPER, _LOWER)


def _keys_of(url: str) -> list[str]:
    """Of every character its longest context and itself; a line feed is the end."""
    text = url + "\n"
    return [text[max(0, i - ORDER) : i + 1] for i in range(len(text))]


def _dealt(urls: DataFrame) -> DataFrame:
    """Distinct ``urls(u, slot)`` with their block, written."""
    urls = written(urls, "urls")
    n = -(-(urls.agg(F.sum(F.length("u") + 1).alias("n")).first()["n"] or 1) // BLOCK_CHARS)
    return urls.withColumn("block", F.pmod(F.xxhash64("u", F.lit("block")), F.lit(n)))


def _counted(dealt: DataFrame) -> DataFrame:
    """block, slot, key, n of the URLs' keys, written; a key of a block may have several rows."""
    names = ["block", "slot", "key", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        at = None

        def rows():
            return pa.RecordBatch.from_arrays([pa.array([at[0]] * len(held), pa.int64()), pa.array([at[1]] * len(held), pa.int32()), pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names)

        for batch in batches:
            for block, slot, u in zip(*[batch[c].to_pylist() for c in ("block", "slot", "u")]):
                if held and (at != (block, slot) or len(held) > HELD_KEYS):
                    yield rows()
                    held.clear()
                at = block, slot
                held.update(_keys_of(u))
        if held:
            yield rows()

    sorted_ = dealt.repartition("block").sortWithinPartitions("block", "slot").select("block", "slot", "u")
    return written(sorted_.mapInArrow(run, "block bigint, slot int, key string, n bigint"), "keys")


def _suffixes(*columns: str) -> list:
    """A row for each key and each shorter context of its last character."""
    return [F.explode(F.expr("transform(sequence(1, length(key)), i -> substring(key, i))")).alias("key"), *columns]


def _chances(keys: DataFrame, grams: DataFrame, folds: list[set[int]]) -> DataFrame:
    """key, r0, ...: the logarithm of the chance of each key's character by rejected over that by accepted URLs, by the models of each set of folds.

    Witten-Bell: ``p = (n + kinds * shorter) / (total + kinds)``, where the context was seen; else ``shorter``.
    """
    parts = [[F.col(_SLOTS[label * HELD_OUT + f]) for f in sorted(kept)] for kept in folds for label in (0, 1)]
    every = range(len(parts))
    counts = grams.select("key", *[sum(part[1:], part[0]).alias(f"c{j}") for j, part in enumerate(parts)])
    context = F.expr("substring(key, 1, length(key) - 1)")
    sums = [x for j in every for x in (F.sum(f"c{j}").alias(f"t{j}"), F.count_if(F.col(f"c{j}") > 0).alias(f"k{j}"))]
    contexts = counts.groupBy(context.alias("context")).agg(*sums)
    need = keys.select(*_suffixes()).distinct().withColumn("context", context)
    both = need.join(counts, "key", "left").join(contexts, "context", "left")
    # Of each model p = own + rest * shorter.
    weight = lambda j: F.col(f"t{j}") + F.col(f"k{j}")
    own = [F.when(F.col(f"t{j}") > 0, F.coalesce(f"c{j}", F.lit(0)) / weight(j)).otherwise(0.0).alias(f"a{j}") for j in every]
    rest = [F.when(F.col(f"t{j}") > 0, F.col(f"k{j}") / weight(j)).otherwise(1.0).alias(f"b{j}") for j in every]
    steps = written(both.select("key", F.length("key").alias("size"), *own, *rest), "steps")
    levels = []
    for size in range(1, ORDER + 2):
        here = steps.where(F.col("size") == size)
        if size == 1:
            found = here.select("key", *[(F.col(f"a{j}") + F.col(f"b{j}") / 65536).alias(f"p{j}") for j in every])
        else:
            shorter = levels[-1].withColumnRenamed("key", "tail")
            found = here.withColumn("tail", F.expr("substring(key, 2)")).join(shorter, "tail")
            found = found.select("key", *[(F.col(f"a{j}") + F.col(f"b{j}") * F.col(f"p{j}")).alias(f"p{j}") for j in every])
        levels.append(written(found, f"chances{size}"))
    chances = levels[0]
    for level in levels[1:]:
        chances = chances.unionByName(level)
    return chances.select("key", *[(F.log(f"p{2 * i + 1}") - F.log(f"p{2 * i}")).alias(f"r{i}") for i in range(len(folds))])


def _scored(dealt: DataFrame, counted: DataFrame, chances: DataFrame, n: int) -> DataFrame:
    """u, slot, score of ``dealt`` URLs; a slot's score is by the models of that number, modulo ``n``."""
    held = counted.select("block", "key").distinct().join(chances, "key")

    def run(urls: pa.Table, held: pa.Table) -> pa.Table:
        ratios = [dict(zip(held["key"].to_pylist(), held[f"r{i}"].to_pylist())) for i in range(n)]
        us, slots = urls["u"].to_pylist(), urls["slot"].to_pylist()
        scores = [math.fsum(map(ratios[slot % n].__getitem__, _keys_of(u))) / len(u) for u, slot in zip(us, slots)]
        return pa.table({"u": pa.array(us, pa.string()), "slot": pa.array(slots, pa.int32()), "score": pa.array(scores, pa.float64())})

    return dealt.groupBy("block").cogroup(held.groupBy("block")).applyInArrow(run, "u string, slot int, score double")


def _nth(scores: DataFrame, n: int) -> float:
    """The score with ``n`` before it in the order, by histograms that narrow its range; exact."""
    while True:
        lo, hi, size = scores.agg(F.min("score"), F.max("score"), F.count("*")).first()
        if size <= FEW:
            return sorted(r["score"] for r in scores.collect())[n]
        if lo == hi:
            return lo
        # The highest score has a bucket of its own, so that the range always narrows.
        bucket = F.when(F.col("score") == hi, 256).otherwise(F.least(F.floor((F.col("score") - lo) / (hi - lo) * 256), F.lit(255)))
        for r in scores.groupBy(bucket.alias("b")).agg(F.count("*").alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi")).orderBy("b").collect():
            if n < r["n"]:
                scores = scores.where(F.col("score").between(r["lo"], r["hi"]))
                break
            n -= r["n"]


def fit(pages: DataFrame, label: Column | None = None) -> Counts:
    """The models of all distinct URLs of ``pages(url)``.

    ``label`` is true for rejected and false for accepted URLs; others are left out of the fit.
    """
    for_workers(pages.sparkSession)
    bad = seeded(host(F.col("url"))) if label is None else label
    seen = pages.select(_scored_part().alias("u"), bad.alias("bad")).where((F.length("u") > 0) & F.col("bad").isNotNull()).distinct()
    slot = F.pmod(F.xxhash64("u"), F.lit(HELD_OUT)) + F.when(F.col("bad"), HELD_OUT).otherwise(0)
    dealt = _dealt(seen.select("u", slot.cast("int").alias("slot")))
    accepted, rejected = dealt.agg(F.count_if(F.col("slot") < HELD_OUT), F.count_if(F.col("slot") >= HELD_OUT)).first()
    if not accepted or not rejected:
        return Counts(None, 0.0, None)
    counted = _counted(dealt)
    full = counted.groupBy("key").agg(*[F.sum(F.when(F.col("slot") == i, F.col("n")).otherwise(0)).alias(c) for i, c in enumerate(_SLOTS)])
    grams = written(full.select(*_suffixes(*_SLOTS)).groupBy("key").agg(*[F.sum(c).alias(c) for c in _SLOTS]), "grams")
    others = [set(range(HELD_OUT)) - {f} for f in range(HELD_OUT)]
    chances = _chances(full.select("key"), grams, others)
    scores = written(_scored(dealt, counted, chances, HELD_OUT).select("slot", "score"), "scores")
    place = min(accepted - 1, math.ceil(accepted * (1 - MOST_WRONG)))
    threshold = max(0.0, _nth(scores.where(F.col("slot") < HELD_OUT), place))
    found = scores.where((F.col("slot") >= HELD_OUT) & (F.col("score") > threshold)).count()
    return Counts(grams, threshold, found / rejected)


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", model: Counts | Ratio | None = None, rules: tuple = RULES) -> DataFrame:
    """Key, host, path, rule, verdict, score: one row per row of ``pages``."""
    spark = pages.sparkSession
    for_workers(spark)
    urls = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"))
    model = fit(urls) if model is None else model.counts(spark) if isinstance(model, Ratio) else model
    found = urls.withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url")))
    found = found.select("key", "host", "path", rule(F.col("host"), F.col("path"), rules).alias("fits"), _scored_part().alias("u"))
    if model.grams is None:
        scored = found.withColumn("score", F.lit(None).cast("double"))
    else:
        dealt = _dealt(found.select("u").where(F.length("u") > 0).distinct().withColumn("slot", F.lit(0)))
        counted = _counted(dealt)
        chances = _chances(counted.select("key").distinct(), model.grams, [set(range(HELD_OUT))])
        scored = found.join(_scored(dealt, counted, chances, 1).drop("slot"), "u", "left")
    own = F.when(F.col("score") > F.lit(model.threshold), F.lit("block")).otherwise(F.lit("allow"))
    return scored.select(F.col("key").alias(key), "host", "path", F.col("fits.rule").alias("rule"), F.coalesce("fits.verdict", own).alias("verdict"), "score")
