r"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one long whose
bit ``i`` says that rule ``i`` failed. A policy is a named, versioned set of rules, that is, a
mask; applying it is ``failures & mask = 0``, so a new policy never reads a text again. The
ablation of a policy (what each rule alone rejects, what would come back without it) is a
bitwise aggregation over the few distinct values of the failure long.

All on DataFrame functions; one pass over the text, no shuffle. A text's repeated three-word
windows are found inside its row by sorting the windows (time n log n, memory in proportion to the
text), and only in texts whose distinct windows are fewer than their windows.

Defined results: a null or empty text has no words, all measurements are 0, and it fails the
length rule (ratios with no words count as 0). Words are runs of anything but the six ASCII
blanks. Rows are judged one by one, so repeated rows get equal results; an empty table gives an
empty ledger. Extra columns are not read; :func:`keep` hands them on whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.llm.scratch import blank
from tensorloom.llm.spans import bind
from tensorloom.llm.words import NOT_BLANK, words

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_alpha_words")


@dataclass(frozen=True)
class Rule:
    """``fails`` decides from the measurements, in whole numbers throughout."""

    name: str
    fails: Callable[[Column], Column]


#: A rule's place is its bit; rules are only ever added at the end.
RULES = (
    Rule("too_few_words", lambda m: m["n_words"] < 50),
    Rule("repeated_words", lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"]),
    Rule("many_symbols", lambda m: 10 * m["n_symbols"] > m["n_words"]),
    Rule("repeated_lines", lambda m: 10 * m["n_dup_lines"] > 4 * m["n_lines"]),
    Rule("short_words", lambda m: m["word_chars"] < 3 * m["n_words"]),
    Rule("long_words", lambda m: m["word_chars"] > 12 * m["n_words"]),
    Rule("few_alphabetic_words", lambda m: 10 * m["n_alpha_words"] < 8 * m["n_words"]),
)
BASE = ("too_few_words", "repeated_words")
#: Versioned policies: name to rules.
POLICIES = {
    "base-1": BASE,
    "prose-1": (*BASE, "many_symbols", "repeated_lines", "short_words", "long_words", "few_alphabetic_words"),
}
POLICY = "prose-1"


def mask(policy: str) -> int:
    """The policy's rules as bits."""
    names = [r.name for r in RULES]
    return sum(1 << names.index(r) for r in POLICIES[policy])


def _in_repeated_windows(windows: Column, size: int) -> Column:
    """How many tokens lie in a window of ``size`` tokens that occurs twice or more."""

    def covered(order: Column) -> Column:
        same = lambda a, b: F.get(order, a)["w"].eqNullSafe(F.get(order, b)["w"])
        last = F.size(order) - 1
        twice = F.filter(order, lambda x, j: ((j > 0) & same(j, j - 1)) | ((j < last) & same(j, j + 1)))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(*[x["i"] + k for k in range(size)])))))

    return bind(F.array_sort(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i")))), covered)


def measured(text: Column) -> Column:
    """The ledger entry of a text: a struct of the measurements and ``failures``.

    Every intermediate array is bound once, so the expression may be moved (into a filter, say)
    without being evaluated anew for each element.
    """
    long = lambda c, name: c.cast("long").alias(name)

    def windows(w: Column) -> Column:
        at = lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(3)])
        last = F.size(w) - 3
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), at)).otherwise(F.array().cast("array<string>"))

    def repeats(w: Column) -> Column:
        some = lambda x: F.size(F.array_distinct(x)) < F.size(x)
        return bind(windows(w), lambda x: F.when(some(x), _in_repeated_windows(x, 3)).otherwise(F.lit(0)))

    def measure(t: Column, w: Column, lines: Column) -> Column:
        return F.struct(
            long(F.size(w), "n_words"),
            long(F.length(F.array_join(w, "")), "word_chars"),
            long(F.length(t) - F.length(F.translate(t, SYMBOLS, "")), "n_symbols"),
            long(F.size(lines) - F.size(F.array_distinct(lines)), "n_dup_lines"),
            long(repeats(w), "n_repeat_words"),
            long(F.size(lines), "n_lines"),
            long(F.size(F.filter(w, lambda x: x.rlike(r"\p{L}"))), "n_alpha_words"),
        )

    def judged(m: Column) -> Column:
        failures = F.lit(0).cast("long")
        for i, rule in enumerate(RULES):
            failures = failures.bitwiseOR(F.when(rule.fails(m), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
        return F.struct(*[m[x].alias(x) for x in MEASURES], failures.alias("failures"))

    full_lines = lambda t: F.filter(F.split(t, "\n"), lambda x: x.rlike(NOT_BLANK))
    entry = lambda t: bind(words(t), lambda w: bind(full_lines(t), lambda lines: bind(measure(t, w, lines), judged)))
    return bind(blank(text), entry)


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, the measurements (longs) and ``failures`` (long): one row per row of ``docs``."""
    return docs.select(F.col(key), measured(F.col(text)).alias("__entry")).select(key, *[F.col("__entry")[x].alias(x) for x in (*MEASURES, "failures")])


def passes(policy: str = POLICY, failures: str = "failures") -> Column:
    """The policy's verdict on a ledger row."""
    return F.col(failures).bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def ablations(book: DataFrame, policies: tuple[str, ...] = tuple(POLICIES)) -> DataFrame:
    """Policy, rule, failed, only_this, kept_without: for each rule of each policy.

    ``failed`` documents fail the rule, ``only_this`` fail no other rule of the policy, and
    ``kept_without`` would pass if the rule left the policy. The ledger is read once, for all
    policies, and first summed by its failure bits (at most 2**rules rows, whatever the number of
    documents). An empty ledger gives no rows.
    """
    patterns = book.groupBy("failures").agg(F.count("*").alias("n"))
    place = {r.name: i for i, r in enumerate(RULES)}
    long = lambda bits: F.lit(bits).cast("long")
    each = [(p, r, mask(p), 1 << place[r]) for p in policies for r in POLICIES[p]]
    rules = F.explode(F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), long(m).alias("mask"), long(b).alias("bit")) for p, r, m, b in each]))
    rows = patterns.select("failures", "n", rules.alias("r")).select("n", "r.*", F.col("failures").bitwiseAND(F.col("r.mask")).alias("bits"))
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    without = F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0
    total = lambda test: F.sum(F.when(test, F.col("n")).otherwise(F.lit(0)))
    return rows.groupBy("policy", "rule").agg(total(hit).alias("failed"), total(hit & without).alias("only_this"), total(without).alias("kept_without"))


def ablation(book: DataFrame, policy: str = POLICY) -> DataFrame:
    """Rule, failed, only_this, kept_without: :func:`ablations` of one policy."""
    return ablations(book, (policy,)).drop("policy")


def keep(docs: DataFrame, policy: str = POLICY, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass the policy, columns unchanged; judged in the scan, no join."""
    return docs.where(measured(docs[text])["failures"].bitwiseAND(F.lit(mask(policy)).cast("long")) == 0)
