r"""Secret scanning through a trigram inverted index.

Each rule's regular expression gives a Boolean trigram query (:mod:`tensorloom.llm.trigrams`). The
index holds, for the trigrams that some rule asks for, postings lists of document marks, cut into
blocks so that no list grows with the corpus. Within a block the lists of a conjunction are
intersected and the conjunctions of a rule united; the marks that remain are candidates, and only
their texts are verified with the rules that have a query. Rules without mandatory trigrams (runs
of hexadecimal digits) scan every text.

A mark is a 64-bit hash of the key: equal marks only add candidates, which verification rejects,
so keys may be null or repeated. The candidates are written to the shared folder and counted. Up
to ``BROADCAST_ROWS`` of them (16 bytes each) are broadcast and one scan does the rest; beyond
that, candidate texts are fetched by a sorted join and all other rows pass with their full-scan
spans only, so no text of a document without candidates is shuffled.

All on DataFrame functions. Kinds ``assign``, ``access`` and ``hex`` are the base; the others are
added rules. Defined results: a null text counts as empty and has no spans; repeated rows get
equal results, one row each; an empty table gives an empty one; a text of any length is read whole. Places are code points, end
exclusive. Extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.llm.scratch import blank, written
from tensorloom.llm.spans import bind, matches, nothing
from tensorloom.llm.trigrams import finder, query

SPAN = "array<struct<start:int,rank:int,kind:string,end:int,text:string>>"
#: Candidates that are broadcast at most.
BROADCAST_ROWS = 1_000_000
#: Documents for each block of postings.
BLOCK_ROWS = 4096


@dataclass(frozen=True)
class Rule:
    """A match counts if its ``group`` has at least ``least`` characters."""

    name: str
    pattern: str
    least: int = 0
    group: int = 0
    base: bool = True


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_either, ("password", "passwd", "secret", "token", "api_?key")))
RULES = (
    Rule("assign", rf"({_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 12, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    # Runs of 16 and more are the base pattern's matches of that length: its matches are whole runs.
    Rule("hex", r"[0-9a-f]{16,}", 16),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", base=False),
    Rule("hub_token", r"gh[opsur]_[A-Za-z0-9]{36,}", base=False),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}", base=False),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", base=False),
)
BASE = tuple(r.name for r in RULES if r.base)


def _spans(text: Column, rule: Rule) -> Column:
    """The rule's spans in a text."""
    value = lambda m: F.regexp_extract(m["text"], rule.pattern, rule.group) if rule.group else m["text"]
    span = lambda m: F.struct(
        m["start"].alias("start"), F.lit(RULES.index(rule)).alias("rank"), F.lit(rule.name).alias("kind"), m["end"].alias("end"), m["text"].alias("text")
    )
    return F.transform(F.filter(matches(text, rule.pattern), lambda m: F.length(value(m)) >= rule.least), span).cast(SPAN)


def _found(text: Column, rules: list[Rule]) -> Column:
    """The rules' spans in a text, unsorted."""
    return F.concat(*[_spans(text, r) for r in rules]) if rules else nothing(SPAN)


def rule_queries() -> dict[str, list[frozenset[str]]]:
    """The trigram queries of the rules that have one."""
    return {r.name: q for r in RULES if (q := query(r.pattern)) is not None}


def postings(marked: DataFrame, blocks: int) -> DataFrame:
    """block, gram, marks: the inverted index over ``marked(mark, t)``, in lists of bounded length."""
    grams = sorted({g for q in rule_queries().values() for c in q for g in c})
    # One pass finds all of them; the texts' other trigrams are never asked for.
    found = F.array_distinct(F.regexp_extract_all("t", F.lit(finder(grams)), F.lit(1)))
    rows = marked.select("mark", F.pmod("mark", F.lit(blocks)).alias("block"), F.explode(found).alias("gram"))
    rows = rows.withColumn("gram", F.translate("gram", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return rows.groupBy("block", "gram").agg(F.collect_set("mark").alias("marks"))


def candidates(index: DataFrame) -> DataFrame:
    """The marks that satisfy some rule's query: intersections and unions of postings by block."""
    queries = rule_queries()
    grams = sorted({g for q in queries.values() for c in q for g in c})
    none = nothing("array<bigint>")
    lists = index.groupBy("block").agg(*[F.coalesce(F.first(F.when(F.col("gram") == g, F.col("marks")), ignorenulls=True), none).alias(f"p{i}") for i, g in enumerate(grams)])
    column = {g: F.col(f"p{i}") for i, g in enumerate(grams)}
    met = none
    for clause in [c for q in queries.values() for c in q]:
        lists_of = [column[g] for g in sorted(clause)]
        both = lists_of[0]
        for x in lists_of[1:]:
            both = F.array_intersect(both, x)
        met = F.array_union(met, both)
    return lists.select(F.explode(met).alias("candidate")).distinct()


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Key and ``spans`` (array of start, rank, kind, end, text in order of start, then rule)."""
    asked = [r for r in RULES if r.name in rule_queries()]
    full = [r for r in RULES if r.name not in rule_queries()]
    marked = docs.select(F.col(key).alias("key"), F.xxhash64(F.col(key).cast("string")).alias("mark"), blank(F.col(text)).alias("t"))
    blocks = max(1, -(-docs.count() // BLOCK_ROWS))
    wanted = written(candidates(postings(marked, blocks)), "candidates")
    if wanted.count() <= broadcast_rows:
        both = marked.join(F.broadcast(wanted), F.col("mark") == F.col("candidate"), "left")
        verified = F.when(F.col("candidate").isNotNull(), bind(F.col("t"), lambda t: _found(t, asked))).otherwise(nothing(SPAN))
        out = both.select("key", F.concat(verified, bind(F.col("t"), lambda t: _found(t, full))).alias("spans"))
    else:
        hit = marked.join(wanted, F.col("mark") == F.col("candidate"), "left_semi")
        hit = hit.select("key", bind(F.col("t"), lambda t: _found(t, list(RULES))).alias("spans"))
        rest = marked.select("key", "mark", bind(F.col("t"), lambda t: _found(t, full)).alias("spans"))
        # An outer join and a filter: an anti join would be moved below the spans and carry the texts.
        rest = rest.join(wanted, F.col("mark") == F.col("candidate"), "left").where(F.col("candidate").isNull())
        out = hit.unionByName(rest.select("key", "spans"))
    return out.select(F.col("key").alias(key), F.array_sort("spans").alias("spans"))
