r"""DuckDB SQL for the queries that SQL can express, written apart from the operators."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

QUALITY = rf"""
WITH base AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents
), win AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM base)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1
), rep AS (
  SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r
), line AS (
  SELECT r, unnest(string_split(t, chr(10))) AS l FROM base
), dup AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n FROM line
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         coalesce(dup.n_lines, 0)::BIGINT AS n_lines,
         len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}')))::BIGINT AS n_alpha_words
  FROM base LEFT JOIN rep USING (r) LEFT JOIN dup USING (r)
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    (CASE WHEN n_words < 50 THEN 1 ELSE 0 END
     + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
     + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
     + CASE WHEN 10 * n_dup_lines > 4 * n_lines THEN 8 ELSE 0 END
     + CASE WHEN word_chars < 3 * n_words THEN 16 ELSE 0 END
     + CASE WHEN word_chars > 12 * n_words THEN 32 ELSE 0 END
     + CASE WHEN 10 * n_alpha_words < 8 * n_words THEN 64 ELSE 0 END)::BIGINT AS failures
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       failures = 0 AS kept, failures
FROM f
"""

MIXING = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, len({_WORDS})::BIGINT AS size,
         (('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::UBIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n FROM d GROUP BY source
), o AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         source_size * 3.0::DOUBLE AS cap
  FROM s
), c AS (
  SELECT *, cap / weight AS ratio,
    ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lvl
  FROM o
), f AS (
  -- The level is the candidate at which the capped shares add up to all words.
  SELECT max(lvl) AS level FROM (
    SELECT x.lvl FROM (SELECT DISTINCT lvl FROM c WHERE lvl > 0) x, c GROUP BY x.lvl
    HAVING abs(sum(least(c.cap, x.lvl * c.weight)) - sum(c.source_size)) <= 1e-9 * sum(c.source_size)
  )
), l AS (
  SELECT c.*, f.level FROM c, f
), g AS (
  SELECT source, source_size, n, least(cap, coalesce(level * weight, cap)) AS target FROM l
), x AS (
  SELECT d.*, g.source_size, g.target,
    greatest(least(floor(coalesce(sqrt(size / nullif(g.source_size / g.n, 0)), 1.0) * 16 + 0.5), 32), 8)::BIGINT AS step
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
), st AS (
  SELECT source, step, any_value(target) AS target, sum(size)::BIGINT AS words FROM x GROUP BY source, step
), ca AS (
  -- Each step's level if it and all lower ones stay below the cap.
  SELECT a.source, a.step, any_value(a.target) AS target, any_value(a.words) AS words,
    (any_value(a.target) - 3.0::DOUBLE * coalesce(sum(b.words) FILTER (WHERE b.step > a.step), 0))
      / nullif(sum(b.step * b.words) FILTER (WHERE b.step <= a.step), 0) AS c
  FROM st a JOIN st b ON a.source IS NOT DISTINCT FROM b.source GROUP BY a.source, a.step
), lv AS (
  SELECT source, arg_max(c, step) AS c FROM ca WHERE c * step <= 3.0 GROUP BY source
), ex AS (
  SELECT ca.source, ca.step, ca.target, ca.words, least(3.0::DOUBLE, coalesce(lv.c * ca.step, 3.0)) AS e0 FROM ca LEFT JOIN lv ON ca.source IS NOT DISTINCT FROM lv.source
), wh AS (
  SELECT *, CASE WHEN abs(e0 - round(e0)) < 1e-9 THEN round(e0) ELSE e0 END AS e FROM ex
), mi AS (
  SELECT source, step, floor(e) AS whole, e - floor(e) AS p, target - sum(floor(e) * words) OVER (PARTITION BY source) AS missing FROM wh
), q AS (
  SELECT x.*, mi.whole, mi.p, mi.missing, CASE WHEN p > 0 THEN (u / (1 - u)) * ((1 - p) / p) END AS o
  FROM x JOIN mi ON x.source IS NOT DISTINCT FROM mi.source AND x.step = mi.step
), w AS (
  SELECT *, o / (1 + o) AS rank FROM q
), cu AS (
  SELECT *, sum(size) OVER (PARTITION BY source, p > 0 ORDER BY rank, doc_id, size, r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS through FROM w
), dr AS (
  -- The prefix of the order whose words are nearest to the missing ones.
  SELECT *, (p > 0 AND through - size < missing AND (through <= missing OR through - missing < missing - (through - size)))::BIGINT AS extra FROM cu
), ga AS (
  SELECT *, round(missing - sum(size * extra) OVER (PARTITION BY source), 6) AS gap, 0.001 * target AS tol FROM dr
), ne AS (
  SELECT source, extra, r, size, gap, tol, row_number() OVER (PARTITION BY source, extra ORDER BY CASE WHEN extra = 1 THEN -rank ELSE rank END, doc_id, size, r) AS nth
  FROM ga WHERE p > 0 AND size > 0 AND abs(gap) > tol
), ru AS (
  -- Runs of documents near the cut, and on either side the empty one.
  SELECT a.source, a.extra, a.nth AS first, b.nth - a.nth + 1 AS n, sum(c.size)::DOUBLE AS words
  FROM ne a JOIN ne b ON a.source IS NOT DISTINCT FROM b.source AND a.extra = b.extra AND a.nth <= b.nth AND b.nth <= 64
  JOIN ne c ON a.source IS NOT DISTINCT FROM c.source AND a.extra = c.extra AND c.nth BETWEEN a.nth AND b.nth
  GROUP BY a.source, a.extra, a.nth, b.nth
  UNION ALL SELECT source, e, 1, 0, 0.0 FROM (SELECT DISTINCT source FROM ne), (SELECT unnest([0, 1]) AS e)
), sw AS (
  SELECT source, arg_min({{'a': a, 'an': an, 'b': b, 'bn': bn}}, (CASE WHEN lft <= tol THEN 0.0 ELSE lft END, an + bn, lft, a, an, b, bn)) AS w FROM (
    SELECT o.source, o.first AS a, o.n AS an, i.first AS b, i.n AS bn, k.tol, abs(round(k.gap + o.words - i.words, 6)) AS lft
    FROM ru o JOIN ru i ON o.source IS NOT DISTINCT FROM i.source AND o.extra = 1 AND i.extra = 0
    JOIN (SELECT DISTINCT source, gap, tol FROM ne) k ON k.source IS NOT DISTINCT FROM o.source
  ) GROUP BY source
), fl AS (
  SELECT ne.r FROM ne JOIN sw ON ne.source IS NOT DISTINCT FROM sw.source
  WHERE (extra = 1 AND nth >= w.a AND nth < w.a + w.an) OR (extra = 0 AND nth >= w.b AND nth < w.b + w.bn)
), fi AS (
  SELECT dr.*, CASE WHEN fl.r IS NULL THEN extra ELSE 1 - extra END AS drawn FROM dr LEFT JOIN fl USING (r)
)
SELECT doc_id, size, source_size, target, (size * (whole + drawn))::BIGINT AS taken, (whole + drawn)::BIGINT AS copies FROM fi
"""


def _places(kind: str, rank: int, pattern: str, good: str, near: str = "0") -> str:
    """Rows (r, rank, kind, start, stop, m, score) of a pattern's matches for which ``good`` holds of m.

    ``near`` gives the score; there ``before`` and ``after`` are the gaps to the pattern's other matches.
    """
    return f"""
  SELECT r, {rank} AS rank, '{kind}' AS kind, start, start + length(m) AS stop, m, {near} AS score FROM (
    SELECT r, i, m, before, after, (sum(length(before) + length(m)) OVER (PARTITION BY r ORDER BY i) - length(m))::BIGINT AS start FROM (
      SELECT r, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS before, unnest(gs[2:len(ms) + 1]) AS after
      FROM (SELECT r, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS gs FROM base)
    )
  ) WHERE {good}"""


def _digest(parts: list[str], kinds: tuple, order: str, more: str = "") -> str:
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k}')::BIGINT AS n_{k}" for k in kinds)
    spans = f"coalesce(string_agg(kind || ':' || start::VARCHAR || ':' || stop::VARCHAR, ',' ORDER BY {order}), '')"
    base = " OR ".join(f"kind = '{k}'" for k in kinds)
    return f"""
WITH base AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), s AS ({" UNION ALL ".join(parts)})
SELECT doc_id, {counts},
       sha256(coalesce(string_agg(kind || ':' || start::VARCHAR || ':' || stop::VARCHAR, ',' ORDER BY {order}) FILTER (WHERE {base}), '')) AS base_sha256,
       {spans} AS spans{more}
FROM base LEFT JOIN s USING (r) GROUP BY r, doc_id
"""


def _score(start: int, context: str, against: str) -> str:
    near = "lower(right(before, 40) || ' ' || left(after, 24))"
    return f"{start} + CASE WHEN regexp_matches({near}, '{context}') THEN 30 ELSE 0 END - CASE WHEN regexp_matches({near}, '{against}') THEN 30 ELSE 0 END"


def _rooted(kind: str, rank: int, hint: str, anchored: str, not_before: str, proposed: str, good: str, score: str, after: str) -> str:
    """As ``_places``, for patterns with bounds that RE2 has not: every place of a text is tried on its own.

    ``proposed`` is the length of what the operator's pattern takes there, from which gaps count.
    """
    return f"""
  SELECT r, {rank} AS rank, '{kind}' AS kind, i - 1 AS start, i - 1 + length(m) AS stop, m, {score} AS score FROM (
    SELECT *, substr(t, last, i - last) AS before, {after} AS after FROM (
      SELECT *, coalesce(lag(i + {proposed}) OVER (PARTITION BY r ORDER BY i), 1) AS last, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i), length(t) + 1) AS next FROM (
        SELECT r, t, i, regexp_extract(substr(t, i, 64), '{anchored}', 1) AS m FROM (SELECT r, t, unnest(range(1, length(t) + 1)) AS i FROM base WHERE regexp_matches(t, '{hint}'))
        WHERE i = 1 OR NOT regexp_matches(substr(t, i - 1, 1), '{not_before}')
      ) WHERE m <> ''
    )
  ) WHERE {good} AND ({score}) >= 70"""


_LUHN = """list_sum(list_transform(range(0, length(d)), lambda i:
    CASE WHEN i % 2 = 0 THEN d[length(d) - i]::INT
         WHEN 2 * d[length(d) - i]::INT > 9 THEN 2 * d[length(d) - i]::INT - 9 ELSE 2 * d[length(d) - i]::INT END)) % 10 = 0"""
_D = "regexp_replace(m, '[^0-9]', '', 'g')"
_OCTETS = "list_max(list_transform(string_split(m, '.'), lambda x: CASE WHEN length(ltrim(x, '0')) > 3 THEN 999 WHEN ltrim(x, '0') = '' THEN 0 ELSE ltrim(x, '0')::INT END)) <= 255"
# The check characters of an IBAN as one long number, its first four at the end, taken modulo 97 digit by digit.
_S = "replace(m, ' ', '')"
_MOD97 = f"""list_reduce(list_transform(string_split(substr({_S}, 5) || left({_S}, 4), ''), lambda c: CASE WHEN c BETWEEN 'A' AND 'Z' THEN ord(c) - 55 ELSE ord(c) - 48 END),
    lambda a, x: (a * (CASE WHEN x > 9 THEN 100 ELSE 10 END) + x) % 97, 0) = 1"""


def _pii() -> str:
    from tensorloom.llm.pii import IBAN_LENGTHS

    by_length = {n: "|".join(sorted(c for c in IBAN_LENGTHS if IBAN_LENGTHS[c] == n)) for n in sorted(set(IBAN_LENGTHS.values()))}
    iban = "^((?:" + "|".join(f"(?:{of})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, of in by_length.items()) + "))(?:[^A-Za-z0-9]|$)"
    return _digest(
        [
            _places("email", 0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true", _score(70, "mail|contact|write", "example|no-?reply")),
            _places("ip", 1, r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", _OCTETS, _score(60, r"(?:^|[^a-z0-9])ip(?:[^a-z0-9]|$)|address|server|host", "version|release|chapter")),
            _places(
                "card", 2, r"[0-9](?:[\x20-]?[0-9])+", f"length({_D}) BETWEEN 16 AND 19 AND {_LUHN.replace('d[', _D + '[').replace('length(d)', f'length({_D})')}",
                _score(70, "card|visa|credit|pay", "order|serial|tracking"),
            ),
            _places("phone", 3, r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_D}) BETWEEN 8 AND 15", _score(60, "call|phone|mobil|tel", "order|serial|tracking")),
            _rooted("iban", 4, "[A-Z]{2}[0-9]{2} ?[A-Z0-9]", iban, "[A-Za-z0-9]", "4", _MOD97, _score(80, "iban|account|bank", "sample|serial"), "substr(t, i + length(m), 24)"),
            _rooted(
                "ssn", 5, "[0-9]-[0-9]{2}-[0-9]", "^([0-9]{3}-[0-9]{2}-[0-9]{4})(?:[^0-9-]|$)", "[0-9-]", "11", "NOT regexp_matches(m, '^(?:000|666|9)|-00-|-0000$')",
                _score(50, r"(?:^|[^a-z0-9])ssn(?:[^a-z0-9]|$)|social security", "order|serial|tracking"), "substr(t, i + 11, next - i - 11)",
            ),
        ],
        ("email", "ip", "card", "phone"),
        "rank, start",
        ", coalesce(string_agg(score::VARCHAR, ',' ORDER BY rank, start), '') AS scores, count(*) FILTER (WHERE score >= 70)::BIGINT AS n_sure",
    )


_ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?"""
SECRETS = _digest(
    [
        _places("assign", 0, _ASSIGN + "[A-Za-z0-9+/_.=-]+", f"length(regexp_extract(m, '^{_ASSIGN}([A-Za-z0-9+/_.=-]+)', 1)) >= 12"),
        _places("access", 1, "AKIA[A-Z0-9]+", "length(m) >= 18"),
        _places("hex", 2, "[0-9a-f]+", "length(m) >= 16"),
    ],
    ("assign", "access", "hex"),
    "start, rank",
)

TOP_K = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: coalesce(x > 0, false)) AS s FROM embeddings WHERE len(embedding) = 64
), d AS (
  SELECT q.vec_id AS query_id, r.vec_id AS id,
         len(list_filter(list_zip(q.s, r.s), lambda p: p[1] <> p[2]))::INT AS distance
  FROM e q, e r WHERE q.vec_id % 50 = 0
)
SELECT query_id, rank::INT AS rank, id, distance
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM d) WHERE rank <= 10
"""
JACCARD = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), l AS (
  SELECT x, y FROM p JOIN n u ON u.doc_id = x JOIN n v ON v.doc_id = y WHERE 100 * c >= 85 * (u.n + v.n - c)
), e AS (
  SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), r AS (
  SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT x, min(y) AS c FROM r GROUP BY x) m ON m.x = d.doc_id
"""


def _licenses() -> str:
    from collections import Counter

    from tensorloom.llm.licenses import CLAUSE, NOTICES, STOP, TEMPLATES, THRESHOLD, anchors, tokens

    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    bag = ", ".join(f"({i}, {quoted(name)}, {len(tokens(text))}, {quoted(w)}, {n})" for i, (name, text) in enumerate(TEMPLATES) for w, n in Counter(tokens(text)).items())
    words = lambda x: f"regexp_extract_all(lower({x}), '[a-z0-9]+(?:[.-][a-z0-9]+)*')"
    kept = lambda x: f"list_filter({words(x)}, lambda w: NOT list_contains([{', '.join(map(quoted, sorted(STOP)))}], w))"
    of = lambda w: f"(('0x' || substr(md5({w}), 1, 5))::INT >> 2)"
    idf = lambda n: f"ln(((SELECT count(*) FROM d) + 1)::DOUBLE / ({n} + 1)) + 1"
    return f"""
WITH t(i, name, len, word, n) AS (VALUES {bag}), an(i, word, place) AS (VALUES {", ".join(f"({i}, {quoted(w)}, {p})" for i, w, p in anchors())}), d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') || '/' || coalesce(lang, '') AS dir, coalesce(text, '') AS x FROM documents
), k AS (
  SELECT r, {kept("x")} AS k FROM d
), df AS (
  SELECT b, count(*) AS n FROM (SELECT DISTINCT r, {of("word")} AS b FROM (SELECT DISTINCT r, unnest({words("x")}) AS word FROM d)) GROUP BY b
), tw AS (
  SELECT i, name, len, word, t.n * ({idf("coalesce(df.n, 0)")}) / sqrt(sum((t.n * ({idf("coalesce(df.n, 0)")})) ** 2) OVER (PARTITION BY i)) AS weight
  FROM (SELECT t.*, {of("word")} AS b FROM t) t LEFT JOIN df USING (b)
), pos AS (
  SELECT r, unnest(range(0, len(k))) AS p, unnest(k) AS word FROM k
), win AS (
  SELECT DISTINCT pos.r, an.i, pos.p - an.place AS start FROM pos JOIN an ON an.word = pos.word
), bag AS (
  SELECT r, i, start, word, count(*) AS n FROM (
    SELECT w.r, w.i, w.start, unnest(k.k[greatest(w.start, 0) + 1 : w.start + l.len]) AS word FROM win w JOIN k ON k.r = w.r JOIN (SELECT DISTINCT i, len FROM t) l ON l.i = w.i
  ) GROUP BY ALL
  UNION ALL SELECT r, -1, 0, word, count(*) FROM pos WHERE r IN (SELECT r FROM win) GROUP BY r, word
), val AS (
  SELECT g.*, g.n * ({idf("coalesce(df.n, 0)")}) AS v FROM (SELECT bag.*, {of("word")} AS b FROM bag) g LEFT JOIN df USING (b)
), norm AS (
  SELECT r, i, start, sqrt(sum(v * v)) AS norm FROM val GROUP BY ALL
), cos AS (
  SELECT val.r, val.i AS of, val.start, tw.i, tw.name, tw.len, round(sum(val.v * tw.weight) / any_value(norm.norm), 9) AS score
  FROM val JOIN tw ON tw.word = val.word AND (val.i = tw.i OR val.i = -1) JOIN norm ON norm.r = val.r AND norm.i = val.i AND norm.start = val.start GROUP BY ALL
), hit AS (
  SELECT * FROM cos WHERE of >= 0 AND score >= {THRESHOLD}
), whole AS (
  SELECT DISTINCT r FROM cos WHERE of = -1 AND score >= {THRESHOLD}
), best AS (
  SELECT r, name, score, n FROM (
    SELECT *, row_number() OVER (PARTITION BY r ORDER BY round(score, 2) DESC, start, len DESC, name, i, score) AS nth FROM hit) JOIN (SELECT r, count(DISTINCT start) AS n FROM hit GROUP BY r) USING (r)
  WHERE nth = 1
), own AS (
  SELECT b.r, b.score, b.n, CASE WHEN b.name = '{CLAUSE[0]}' AND c.r IS NOT NULL THEN '{CLAUSE[2]}' ELSE b.name END AS name,
         p.n >= 2 OR w.r IS NOT NULL AS whole
  FROM best b LEFT JOIN (SELECT DISTINCT r FROM hit WHERE i = {CLAUSE[1]}) c ON c.r = b.r
  LEFT JOIN (SELECT r, name, count(DISTINCT i) AS n FROM hit WHERE i >= {len(NOTICES)} GROUP BY r, name) p ON p.r = b.r AND p.name = b.name LEFT JOIN whole w ON w.r = b.r
), givers AS (
  SELECT dir, name FROM (
    SELECT d.dir, o.name, row_number() OVER (PARTITION BY d.dir ORDER BY o.score DESC, d.dir || '/' || d.doc_id || '.txt') AS place FROM own o JOIN d ON d.r = o.r WHERE o.whole) WHERE place = 1
)
SELECT d.doc_id, d.dir || '/' || d.doc_id || '.txt' AS path, coalesce(o.name, g.name) AS license, coalesce(o.score, 0.0) AS score,
       CASE WHEN o.name IS NOT NULL THEN 'own' WHEN g.name IS NOT NULL THEN 'inherited' END AS origin, coalesce(o.n, 0)::BIGINT AS notices,
       CASE WHEN o.name IS NULL AND g.name IS NOT NULL THEN g.dir END AS from_dir
FROM d LEFT JOIN own o ON o.r = d.r LEFT JOIN givers g ON g.dir = d.dir
"""


#: Each rule of each policy by the bit of its failure, counted document by document.
ABLATION = f"""
WITH rules(rule, bit, base) AS (VALUES
  ('too_few_words', 1, true), ('repeated_words', 2, true), ('many_symbols', 4, false), ('repeated_lines', 8, false),
  ('short_words', 16, false), ('long_words', 32, false), ('few_alphabetic_words', 64, false)),
policies(policy, mask) AS (VALUES ('base-1', 3), ('prose-1', 127)),
book AS ({QUALITY})
SELECT policy, rule,
       count(*) FILTER (WHERE failures & bit != 0) AS failed,
       count(*) FILTER (WHERE failures & mask = bit) AS only_this,
       count(*) FILTER (WHERE failures & mask & ~bit = 0) AS kept_without
FROM policies JOIN rules ON base OR policy = 'prose-1' CROSS JOIN book
GROUP BY policy, rule
"""

SQL: dict[str, str] = {"op1_pii": _pii(), "op3_licenses": _licenses(), "op5_top_k": TOP_K, "op6_secrets": SECRETS, "op7_jaccard": JACCARD, "op9_quality": QUALITY, "op10_mixing": MIXING}
