"""The library's own queries: each operator over the driver tables, with the same result in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tensorloom.functions import predicates, scalars
from tensorloom.functions.dtypes import DTYPES, align_elems, element_size
from tensorloom.operators import chunks, layout, manifest, reconcile, report
from tensorloom.sources import adapters

#: Names of an explicit order: some unknown, one twice.
NAME_ORDER = ["part.p_size", "no.such.tensor", "lineitem.l_orderkey", "doc.en.1.text", "customer.c_nationkey", "lineitem.l_orderkey", "page.3.html"]
IGNORE_NAMES = ["part.p_size", "orders.o_totalprice"]
IGNORE_PREFIXES = ["doc.fr.", "emb.3."]
IGNORE_SUFFIXES = [".html", "7.weight"]
LABELS = {"click": "Click", "view": "View", "purchase": "Purchase"}

_SQL_TENSORS = (
    """tensors AS (
  SELECT 'emb.' || label || '.' || vec_id || '.weight' AS name, 'float32' AS dtype, len(embedding)::BIGINT AS numel FROM embeddings
  UNION ALL SELECT 'doc.' || lang || '.' || doc_id || '.text', 'uint8', octet_length(encode(text))::BIGINT FROM documents
  UNION ALL SELECT 'page.' || page_id || '.html', 'uint8', octet_length(encode(html))::BIGINT FROM pages
"""
    + "\n".join(f"  UNION ALL SELECT '{t}.{c}', '{d}', (SELECT count(*) FROM {t})::BIGINT" for t, c, d in adapters.COLUMNS)
    + """
  UNION ALL SELECT 'event.' || event_type || '.value', 'float64', count(*)::BIGINT FROM events GROUP BY event_type
)"""
)


def _case(column: str, value) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{d.name}' THEN {value(d)}" for d in DTYPES) + " END::BIGINT"


def _sql_index(align: int, dtype: str | None = None) -> str:
    """CTEs up to ``idx``: macroblock, dtype, name, offset, length."""
    of = f"'{dtype}'" if dtype else "dtype"
    a = _case("dtype", lambda d: align_elems(align, d.size))
    return f"""{_SQL_TENSORS}, typed AS (
  SELECT name, {of} AS dtype, numel FROM tensors
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY numel DESC, name) - 1 AS pos, {a} AS a FROM typed
), stepped AS (
  SELECT *, numel + CASE WHEN a > 0 THEN (a - numel % a) % a ELSE 0 END AS step FROM ranked
), firsts AS (
  SELECT dtype, (row_number() OVER (ORDER BY min(pos)) - 1)::INT AS macroblock FROM ranked GROUP BY dtype
), idx AS (
  SELECT macroblock, dtype, name, pos,
    coalesce(sum(step) OVER (PARTITION BY dtype ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset",
    numel AS length
  FROM stepped JOIN firsts USING (dtype)
)"""


def _sql_blocks(align: int, dtype: str | None = None) -> str:
    """CTEs up to ``blk``; block offsets are a running sum over a recursion, whatever the alignment."""
    from tensorloom.functions.dtypes import align_block

    size, block = _case("dtype", lambda d: d.size), _case("dtype", lambda d: align_block(align, d.size))
    return f"""RECURSIVE {_sql_index(align, dtype)}, sums AS (
  SELECT macroblock, dtype, max("offset" + length)::BIGINT AS length_elems, count(*)::BIGINT AS n_tensors, {size} AS e, {block} AS l FROM idx GROUP BY macroblock, dtype
), blk(macroblock, dtype, offset_bytes, length_bytes, length_elems, n_tensors) AS (
  SELECT macroblock, dtype, 0::BIGINT, (length_elems * e)::BIGINT, length_elems, n_tensors FROM sums WHERE macroblock = 0
  UNION ALL
  SELECT s.macroblock, s.dtype, (b.offset_bytes + b.length_bytes + (s.l - (b.offset_bytes + b.length_bytes) % s.l) % s.l)::BIGINT,
         (s.length_elems * s.e)::BIGINT, s.length_elems, s.n_tensors
  FROM blk b JOIN sums s ON s.macroblock = b.macroblock + 1
)"""


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def _index(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return layout.index(adapters.tensors(spark, sf_dir), **options)


def _blocks(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    align = {k: v for k, v in options.items() if k == "align_bytes"}
    return layout.blocks(_index(spark, sf_dir, **options), **align)


@query(f"WITH {_SQL_TENSORS} SELECT name, dtype, numel FROM tensors")
def tensor_catalog(spark, sf_dir):
    return layout.sized(adapters.tensors(spark, sf_dir)).select("name", "dtype", "numel")


def _filtered(spark, sf_dir, *rules):
    return predicates.keep(layout.sized(adapters.tensors(spark, sf_dir)), *rules).select("name", "numel")


def _sql_list(xs) -> str:
    return "(" + ", ".join(f"'{x}'" for x in xs) + ")"


_NAMES_SQL = f"name IN {_sql_list(IGNORE_NAMES)}"
_PREFIX_SQL = " OR ".join(f"starts_with(name, '{p}')" for p in IGNORE_PREFIXES)
_SUFFIX_SQL = " OR ".join(f"ends_with(name, '{s}')" for s in IGNORE_SUFFIXES)


@query(f"WITH {_SQL_TENSORS} SELECT name, numel FROM tensors WHERE NOT ({_NAMES_SQL})")
def filter_ignore_names(spark, sf_dir):
    return _filtered(spark, sf_dir, IGNORE_NAMES)


@query(f"WITH {_SQL_TENSORS} SELECT name, numel FROM tensors WHERE NOT ({_PREFIX_SQL})")
def filter_ignore_prefixes(spark, sf_dir):
    return _filtered(spark, sf_dir, None, IGNORE_PREFIXES)


@query(f"WITH {_SQL_TENSORS} SELECT name, numel FROM tensors WHERE NOT ({_SUFFIX_SQL})")
def filter_ignore_suffixes(spark, sf_dir):
    return _filtered(spark, sf_dir, None, None, IGNORE_SUFFIXES)


@query(f"WITH {_SQL_TENSORS} SELECT name, numel FROM tensors WHERE NOT ({_NAMES_SQL} OR {_PREFIX_SQL} OR {_SUFFIX_SQL})")
def filter_ignore_combined(spark, sf_dir):
    return _filtered(spark, sf_dir, IGNORE_NAMES, IGNORE_PREFIXES, IGNORE_SUFFIXES)


@query(f"WITH {_SQL_TENSORS} SELECT name, numel, row_number() OVER (ORDER BY numel DESC, name) - 1 AS pos FROM tensors")
def size_order(spark, sf_dir):
    return layout.positioned(layout.ordered(layout.sized(adapters.tensors(spark, sf_dir)))).select("name", "numel", "pos")


@query(
    f"WITH {_SQL_TENSORS}, o AS (SELECT unnest(range(0, {len(NAME_ORDER)})) AS place, unnest([{', '.join(repr(n) for n in NAME_ORDER)}]) AS name) "
    "SELECT name, numel, row_number() OVER (ORDER BY place) - 1 AS pos FROM o JOIN tensors USING (name)"
)
def name_order_select(spark, sf_dir):
    return layout.positioned(layout.ordered(layout.sized(adapters.tensors(spark, sf_dir)), NAME_ORDER)).select("name", "numel", "pos")


@query(f"WITH {_sql_index(128)} SELECT dtype, macroblock, count(*)::BIGINT AS n_tensors FROM idx GROUP BY ALL")
def dtype_groups(spark, sf_dir):
    return layout.groups(layout.ordered(layout.sized(adapters.tensors(spark, sf_dir)))).select("dtype", "macroblock", "n_tensors")


def _index_query(align: int, name: str):
    def f(spark, sf_dir):
        return _index(spark, sf_dir, align_bytes=align).select("macroblock", "dtype", "name", "offset", "length")

    f.__name__ = name
    query(f'WITH {_sql_index(align)} SELECT macroblock, dtype, name, "offset", length FROM idx')(f)


def _blocks_query(align: int, name: str):
    def f(spark, sf_dir):
        return _blocks(spark, sf_dir, align_bytes=align).drop("path")

    f.__name__ = name
    query(f"WITH {_sql_blocks(align)} SELECT * FROM blk")(f)


for _a, _suffix in ((128, ""), (0, "_align0"), (100, "_align100")):
    _index_query(_a, "layout_index" + _suffix)
    _blocks_query(_a, "layout_blocks" + _suffix)

_TOTALS = (
    "SELECT count(*)::BIGINT AS n_blocks, sum(length_elems)::BIGINT AS total_elems, max(offset_bytes + length_bytes)::BIGINT AS total_payload_bytes, "
    "CASE WHEN count(*) = 1 THEN 3 ELSE 4 END AS version FROM blk"
)


@query(f"WITH {_sql_blocks(128)} {_TOTALS}")
def file_totals(spark, sf_dir):
    return layout.totals(_blocks(spark, sf_dir)).drop("path")


@query(f"WITH {_sql_blocks(128, 'bfloat16')} {_TOTALS}")
def target_dtype_override(spark, sf_dir):
    """One output type for all: a single block, so version 3."""
    return layout.totals(_blocks(spark, sf_dir, target_dtype="bfloat16")).drop("path")


_JSON_ENTRY = "'{\"name\":\"' || name || '\",\"shape\":[' || length || '],\"offset\":' || \"offset\" || ',\"length\":' || length || ',\"macroblock\":' || macroblock || '}'"
_JSON_BLOCK = "'{\"dtype\":\"' || dtype || '\",\"offset_bytes\":' || offset_bytes || ',\"length_bytes\":' || length_bytes || ',\"length_elems\":' || length_elems || '}'"


@query(
    f"""WITH {_sql_blocks(128)} SELECT md5('{{"format":"tensorloom_v4","align_bytes":128,"total_payload_bytes":' || (SELECT max(offset_bytes + length_bytes) FROM blk)
    || ',"total_elems":' || (SELECT sum(length_elems)::BIGINT FROM blk) || ',"macroblocks":[' || (SELECT string_agg({_JSON_BLOCK}, ',' ORDER BY macroblock) FROM blk)
    || '],"index":[' || (SELECT string_agg({_JSON_ENTRY}, ',' ORDER BY macroblock, pos) FROM idx) || ']}}') AS footer_md5"""
)
def footer_index_json(spark, sf_dir):
    rows = _index(spark, sf_dir)
    return layout.footer_json(rows, layout.blocks(rows), "tensorloom").select(F.md5(F.col("footer").cast("binary")).alias("footer_md5"))


_PERTURBED = 'SELECT macroblock, dtype, name, "offset" + CASE WHEN length % 5 = 0 THEN 1 ELSE 0 END AS "offset", length FROM idx'


@query(
    f"""WITH {_sql_index(128)}, bad AS (
      SELECT *, row_number() OVER (ORDER BY macroblock, "offset", name) AS nth FROM ({_PERTURBED}) WHERE "offset" % {_case("dtype", lambda d: align_elems(128, d.size))} <> 0)
    SELECT count(*)::BIGINT AS n_misaligned, string_agg(name, ', ' ORDER BY nth) FILTER (WHERE nth <= 3) AS first_names FROM bad"""
)
def alignment_violations(spark, sf_dir):
    moved = _index(spark, sf_dir).withColumn("offset", F.col("offset") + F.when(F.col("length") % 5 == 0, 1).otherwise(0))
    return layout.violations(moved).drop("path")


_RANGES = f"""SELECT name, i.macroblock, (b.offset_bytes + i."offset" * e)::BIGINT AS start_byte, (b.offset_bytes + (i."offset" + i.length) * e)::BIGINT AS end_byte
  FROM (SELECT *, {_case("dtype", lambda d: d.size)} AS e FROM idx) i JOIN blk b ON i.macroblock = b.macroblock"""


@query(f"WITH {_sql_blocks(128)} {_RANGES}")
def index_block_lookup(spark, sf_dir):
    rows = _index(spark, sf_dir)
    return layout.located(rows, layout.blocks(rows)).select("name", "macroblock", "start_byte", "end_byte")


@query(
    f"""WITH {_sql_blocks(128)}, r AS ({_RANGES})
    SELECT r.macroblock, count(*)::BIGINT AS n, count(*) FILTER (WHERE r.start_byte < b.offset_bytes OR r.end_byte > b.offset_bytes + b.length_bytes)::BIGINT AS n_outside,
           count(*) FILTER (WHERE r.macroblock < 0 OR r.macroblock >= (SELECT count(*) FROM blk))::BIGINT AS n_unknown
    FROM r JOIN blk b ON r.macroblock = b.macroblock GROUP BY r.macroblock"""
)
def block_bounds_check(spark, sf_dir):
    rows = _index(spark, sf_dir)
    b = layout.blocks(rows).withColumn("n_blocks", F.count("*").over(Window.partitionBy("path")))
    b = b.select(F.col("macroblock").alias("m"), "offset_bytes", "length_bytes", "n_blocks")
    both = layout.located(rows, layout.blocks(rows)).join(F.broadcast(b), F.col("macroblock") == F.col("m"))  # 21 blocks at most
    outside = (F.col("start_byte") < F.col("offset_bytes")) | (F.col("end_byte") > F.col("offset_bytes") + F.col("length_bytes"))
    unknown = (F.col("macroblock") < 0) | (F.col("macroblock") >= F.col("n_blocks"))
    return both.groupBy("macroblock").agg(F.count("*").alias("n"), F.count_if(outside).alias("n_outside"), F.count_if(unknown).alias("n_unknown"))


_EXPECTED_SQL = f"""{_SQL_TENSORS}, held AS (
  SELECT DISTINCT d.doc_id, d.lang FROM documents d JOIN labels l ON d.doc_id = l.doc_id
), expected AS (
  SELECT 'doc.' || lang || '.' || doc_id || '.text' AS name, 'param' AS kind, 'uint8' AS dtype FROM held
  UNION ALL SELECT 'doc.' || lang || '.' || (doc_id + 1000000000) || '.text', 'param', 'uint8' FROM held WHERE doc_id % 7 = 0
  UNION ALL SELECT DISTINCT 'event.' || event_type || '.value', 'buffer', CASE WHEN event_type < 'm' THEN 'float64' ELSE 'float32' END FROM events
  UNION ALL SELECT 'event.none.value', 'buffer', 'float64'
), stored AS (
  SELECT * FROM tensors WHERE NOT (starts_with(name, 'emb.') OR ends_with(name, '.html'))
), status AS (
  SELECT coalesce(s.name, e.name) AS name, e.kind, s.dtype AS stored_dtype, e.dtype AS expected_dtype, s.numel AS stored_length,
    CASE WHEN e.name IS NULL THEN 'discarded' WHEN s.name IS NULL THEN 'missing_' || e.kind ELSE 'assigned_' || e.kind END AS status,
    s.name IS NOT NULL AND e.name IS NOT NULL AND s.dtype <> e.dtype AS dtype_mismatch
  FROM stored s FULL OUTER JOIN expected e ON s.name = e.name
)"""
_COUNTS_SQL = """SELECT count(*) FILTER (WHERE status = 'assigned_param')::BIGINT AS assigned_params, count(*) FILTER (WHERE status = 'assigned_buffer')::BIGINT AS assigned_buffers,
  count(*) FILTER (WHERE status = 'missing_param')::BIGINT AS missing_params, count(*) FILTER (WHERE status = 'missing_buffer')::BIGINT AS missing_buffers,
  count(*) FILTER (WHERE status = 'discarded')::BIGINT AS discarded, count(*) FILTER (WHERE dtype_mismatch AND kind = 'buffer')::BIGINT AS buffer_mismatches,
  coalesce(sum(stored_length), 0)::BIGINT AS total_elements FROM status"""


def _status(spark, sf_dir):
    stored = layout.sized(adapters.tensors(spark, sf_dir)).select("name", "dtype", F.col("numel").alias("length"))
    return reconcile.reconcile(stored, adapters.expected(spark, sf_dir), ignore_prefixes=["emb."], ignore_suffixes=[".html"])


@query(f"WITH {_EXPECTED_SQL} SELECT * REPLACE (coalesce(stored_length, -1) AS stored_length) FROM status")
def reconcile_status(spark, sf_dir):
    """A missing name has the length -1 here."""
    return _status(spark, sf_dir).withColumn("stored_length", F.coalesce("stored_length", F.lit(-1).cast("bigint")))


@query(f"WITH {_EXPECTED_SQL} SELECT e.name, e.kind FROM expected e ANTI JOIN stored s ON s.name = e.name")
def missing_names(spark, sf_dir):
    stored = predicates.keep(adapters.tensors(spark, sf_dir), None, ["emb."], [".html"])
    return adapters.expected(spark, sf_dir).join(stored.select("name"), "name", "left_anti").select("name", "kind")


@query(f"WITH {_EXPECTED_SQL} SELECT s.name, s.dtype FROM stored s ANTI JOIN expected e ON s.name = e.name")
def discarded_names(spark, sf_dir):
    stored = predicates.keep(adapters.tensors(spark, sf_dir), None, ["emb."], [".html"])
    return stored.join(adapters.expected(spark, sf_dir).select("name"), "name", "left_anti").select("name", "dtype")


@query(
    f"""WITH {_EXPECTED_SQL}, c AS ({_COUNTS_SQL}), f AS (
      SELECT * FROM (SELECT unnest([NULL, false, true]) AS strict), (SELECT unnest([false, true]) AS strict_params), (SELECT unnest([false, true]) AS strict_buffers), (SELECT unnest([false, true]) AS coerce_dtype)
    ), g AS (
      SELECT f.*, c.*, coalesce(strict, false) OR strict_params OR strict_buffers AS s, coalesce(strict, strict_params) AND missing_params > 0 AS p, coalesce(strict, strict_buffers) AND missing_buffers > 0 AS b FROM f, c
    )
    SELECT strict, strict_params, strict_buffers, coerce_dtype, CASE WHEN buffer_mismatches > 0 AND NOT coerce_dtype THEN 'buffer_dtype_mismatch' WHEN s AND discarded > 0 THEN 'discarded'
      WHEN s AND p AND b THEN 'missing_both' WHEN s AND p THEN 'missing_params' WHEN s AND b THEN 'missing_buffers' ELSE 'ok' END AS outcome FROM g"""
)
def strict_policy_matrix(spark, sf_dir):
    return reconcile.policy_matrix(_status(spark, sf_dir))


def _human_sql(n: str) -> str:
    return f"CASE WHEN {n} > 1e9 THEN printf('%.2fB', {n} / 1e9) WHEN {n} > 1e6 THEN printf('%.2fM', {n} / 1e6) WHEN {n} > 1e3 THEN printf('%.2fK', {n} / 1e3) ELSE {n}::VARCHAR END"


@query(f"WITH {_EXPECTED_SQL}, c AS ({_COUNTS_SQL}) SELECT *, {_human_sql('total_elements')} AS human FROM c")
def assigned_totals(spark, sf_dir):
    return reconcile.counts(_status(spark, sf_dir)).withColumn("human", scalars.human_elements(F.col("total_elements")))


@query(f"WITH {_EXPECTED_SQL} SELECT name, stored_dtype, expected_dtype FROM status WHERE kind = 'buffer' AND dtype_mismatch")
def buffer_dtype_mismatch(spark, sf_dir):
    return _status(spark, sf_dir).where((F.col("kind") == "buffer") & F.col("dtype_mismatch")).select("name", "stored_dtype", "expected_dtype")


def _components(spark, sf_dir):
    """Sources as components: library by language of the least document, class null for every fourth."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    per = docs.groupBy(F.col("source").alias("name")).agg(F.min_by("lang", "doc_id").alias("library"), F.min("doc_id").alias("i"))
    return per.select("name", F.when(F.col("i") % 5 != 3, F.col("library")).alias("library"), F.when(F.col("i") % 4 != 1, F.concat(F.lit("Model"), F.col("i").cast("string"))).alias("class"))


_COMPONENTS_SQL = """components AS (
  SELECT source AS name, CASE WHEN min(doc_id) % 5 <> 3 THEN arg_min(lang, doc_id) END AS library, CASE WHEN min(doc_id) % 4 <> 1 THEN 'Model' || min(doc_id) END AS class
  FROM documents GROUP BY source
)"""
_TYPES = {"src1": "bfloat16", "src2": "float16", "default": "float64"}


@query(
    f"""WITH {_COMPONENTS_SQL} SELECT name, library, class, NOT (name IN ('src1', 'src5') AND class IS NULL) AS saved,
      library IS NOT NULL AND name NOT IN ('src2', 'src6') AS loaded, row_number() OVER (ORDER BY name) - 1 AS place FROM components"""
)
def component_manifest(spark, sf_dir):
    all_ = _components(spark, sf_dir)
    saved = manifest.saveable(all_, all_.select("name"), ["src1", "src5"]).select("name", F.lit(True).alias("saved"))
    none = spark.createDataFrame([("src2",), ("src6",)], "name string")
    loaded = manifest.loadable(all_, none).select("name", F.lit(True).alias("loaded"))
    both = all_.join(saved, "name", "left").join(loaded, "name", "left")
    place = F.row_number().over(Window.orderBy("name")) - 1  # a manifest is a handful of rows
    return both.select("name", "library", "class", F.coalesce("saved", F.lit(False)).alias("saved"), F.coalesce("loaded", F.lit(False)).alias("loaded"), place.cast("bigint").alias("place"))


@query(
    f"WITH {_COMPONENTS_SQL} SELECT name, CASE name WHEN 'src1' THEN 'bfloat16' WHEN 'src2' THEN 'float16' ELSE 'float64' END AS on_load, "
    "'float32' AS on_load_bare, CASE name WHEN 'src1' THEN 'bfloat16' WHEN 'src2' THEN 'float16' END AS on_save FROM components"
)
def component_dtype_default(spark, sf_dir):
    n = F.col("name")
    return _components(spark, sf_dir).select(n, manifest.dtype_on_load(n, _TYPES).alias("on_load"), manifest.dtype_on_load(n, {}).alias("on_load_bare"), manifest.dtype_on_save(n, _TYPES).alias("on_save"))


def _set_check_sql(group: str, name: str, provided: str, passed: str, optional: list[str], table: str) -> str:
    return f"""WITH g AS (
      SELECT {group}, list_distinct(list({name})) AS expected, list_distinct(list({name}) FILTER (WHERE {provided})) AS provided,
             list_distinct(list({name}) FILTER (WHERE {passed})) AS passed, {optional} AS optional FROM {table} GROUP BY {group}
    ), m AS (
      SELECT *, list_filter(expected, lambda x: NOT coalesce(list_contains(provided, x), false)) AS miss FROM g
    )
    SELECT {group}, array_to_string(list_sort(miss), ',') AS missing,
      len(list_filter(miss, lambda x: NOT list_contains(list_concat(coalesce(passed, []), optional), x))) = 0 AS covered,
      array_to_string(list_sort(list_filter(list_distinct(list_concat(coalesce(provided, []), coalesce(passed, []))), lambda x: NOT list_contains(optional, x))), ',') AS required FROM m"""


def _set_check(rows: DataFrame, group: str, name: str, provided, passed, optional: list[str]) -> DataFrame:
    of = lambda test: F.collect_set(F.when(test, F.col(name)))
    sets = rows.groupBy(group).agg(F.collect_set(name).alias("expected"), of(provided).alias("provided"), of(passed).alias("passed"))
    checked = sets.select(group, *manifest.set_check(F.col("expected"), F.col("passed"), F.col("provided"), F.array(*map(F.lit, optional))))
    return checked.select(group, F.array_join("missing", ",").alias("missing"), "covered", F.array_join("required", ",").alias("required"))


@query(_set_check_sql("conv_id", "role", "turn % 2 = 0", "turn % 3 = 0", ["system"], "conversations"))
def component_set_check(spark, sf_dir):
    """The roles of every conversation as component names: few names, many groups."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return _set_check(turns, "conv_id", "role", F.col("turn") % 2 == 0, F.col("turn") % 3 == 0, ["system"])


@query(_set_check_sql("lang", "source", "doc_id % 3 = 0", "doc_id % 3 = 1", ["src1", "src2", "src3"], "documents"))
def component_set_check_all(spark, sf_dir):
    """The sources of every document by language: eight to twenty names, few groups."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return _set_check(docs, "lang", "source", F.col("doc_id") % 3 == 0, F.col("doc_id") % 3 == 1, ["src1", "src2", "src3"])


_CHUNKS_SQL = f"""sized AS (
  SELECT *, {_case("dtype", lambda d: d.size)} AS e, least(greatest(1024, length_bytes // 150), 67108864) AS cb FROM blk
), per AS (SELECT *, greatest(cb // e, 1) AS ce FROM sized)"""


@query(f"WITH {_sql_blocks(128)}, {_CHUNKS_SQL} SELECT macroblock, ce::BIGINT AS chunk_elems, ((length_elems + ce - 1) // ce)::BIGINT AS n_chunks FROM per")
def chunk_plan(spark, sf_dir):
    return chunks.chunk_sizes(_blocks(spark, sf_dir), floor=1024).select("macroblock", "chunk_elems", "n_chunks")


@query(
    f"""WITH {_sql_blocks(128)}, {_CHUNKS_SQL}, c AS (SELECT macroblock, ce, length_elems, unnest(range(0, (length_elems + ce - 1) // ce)) AS i FROM per)
    SELECT macroblock, i::BIGINT AS chunk_idx, (i * ce)::BIGINT AS start_elem, least(ce, length_elems - i * ce)::BIGINT AS n_elems, (i % 4)::INT AS slot, i >= 4 AS waits FROM c"""
)
def chunk_ring(spark, sf_dir):
    return chunks.chunk_plan(_blocks(spark, sf_dir), floor=1024).drop("path")


@query(
    f"""WITH {_sql_blocks(128)}, d AS (SELECT length(max(offset_bytes + length_bytes)::VARCHAR) AS n FROM blk), p AS (SELECT *, row_number() OVER (ORDER BY offset_bytes, macroblock) - 1 AS position FROM blk)
    SELECT position, position || ': ' || dtype || repeat(' ', greatest(0, 10 - length(dtype))) || ' ' || lpad(offset_bytes::VARCHAR, d.n::INT, '0') || ':' || lpad((offset_bytes + length_bytes)::VARCHAR, d.n::INT, '0') AS line FROM p, d"""
)
def metadata_report(spark, sf_dir):
    return report.block_lines(_blocks(spark, sf_dir)).drop("path")


@query(
    f"""WITH {_sql_index(128)}, p AS (
      SELECT *, row_number() OVER (ORDER BY macroblock, "offset", name) - 1 AS position, length((count(*) OVER ())::VARCHAR)::INT AS w, length((max("offset" + length) OVER ())::VARCHAR)::INT AS d,
        lag(macroblock) OVER (ORDER BY macroblock, "offset", name) IS DISTINCT FROM macroblock AS new_block FROM idx)
    SELECT position, new_block, lpad(position::VARCHAR, w, '0') || ': ' || lpad("offset"::VARCHAR, d, '0') || ':' || lpad(("offset" + length)::VARCHAR, d, '0') || ' ' || name || ' [' || length || ']' AS line FROM p"""
)
def metadata_index_report(spark, sf_dir):
    return report.index_lines(_index(spark, sf_dir)).drop("path")


@query(
    f"WITH {_SQL_TENSORS} SELECT name, regexp_replace(name, '\\.[^.]*$', '') AS parent, regexp_extract(name, '[^.]*$') AS leaf FROM tensors"
)
def module_paths(spark, sf_dir):
    t = adapters.tensors(spark, sf_dir)
    return t.select("name", scalars.parent(F.col("name")).alias("parent"), scalars.leaf(F.col("name")).alias("leaf"))


@query(
    r"""SELECT page_id, regexp_extract(url, '[^/.][^/]*?(\.[^./]*)$', 1) AS ext, regexp_extract(url, '[^/]*$') AS last,
      (length(url) - length(replace(url, '/', '')))::BIGINT AS slashes, regexp_replace(url, '\.html$', '.pack') AS packed, string_split(url, '://')[1] AS scheme FROM pages"""
)
def path_functions(spark, sf_dir):
    url = F.col("url")
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select(
        "page_id", scalars.extension(url).alias("ext"), scalars.last_segment(url).alias("last"), scalars.slashes(url).alias("slashes"),
        F.regexp_replace(url, r"\.html$", ".pack").alias("packed"), F.get(F.split(url, "://"), F.lit(0)).alias("scheme"),
    )


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'Click' WHEN 'view' THEN 'View' WHEN 'purchase' THEN 'Purchase' END AS label FROM events")
def label_map_join(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", report.labelled(F.col("event_type"), LABELS).alias("label"))


_RUNS = """runs AS (SELECT l_returnflag || l_linestatus AS model, l_quantity AS base_time, 1 + l_linenumber AS packed_time, (l_suppkey % 3 + 1) * 1073741824 AS total_bytes FROM lineitem)"""
_STAT_NAMES = [f"{x}_{y}_{z}" for x in ("base", "packed") for y in ("time", "gbps") for z in ("mean", "min", "max")] + ["total_gb", "speedup"]


@query(
    f"WITH {_RUNS}, r AS (SELECT *, total_bytes / base_time / 1073741824.0::DOUBLE AS base_gbps, total_bytes / packed_time / 1073741824.0::DOUBLE AS packed_gbps FROM runs) SELECT model, total_bytes::BIGINT AS total_bytes, "
    + ", ".join(f"round({f}({x}_{y}), 6) AS {x}_{y}_{z}" for x in ("base", "packed") for y in ("time", "gbps") for z, f in (("mean", "avg"), ("min", "min"), ("max", "max")))
    + ", round(total_bytes / 1073741824.0::DOUBLE, 6) AS total_gb, round(avg(base_time) / avg(packed_time), 6) AS speedup FROM r GROUP BY model, total_bytes"
)
def bench_stats(spark, sf_dir):
    """Line items stand for benchmark runs: quantity and line number as times, three file sizes."""
    runs = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.concat("l_returnflag", "l_linestatus").alias("model"), F.col("l_quantity").alias("base_time"),
        (F.lit(1) + F.col("l_linenumber")).alias("packed_time"), ((F.col("l_suppkey") % 3 + 1) * F.lit(1 << 30).cast("bigint")).alias("total_bytes"),
    )
    stats = report.load_stats(runs)
    return stats.select("model", "total_bytes", *[F.round(c, 6).alias(c) for c in _STAT_NAMES])


_SECONDS = "abs(value) * 1e4::DOUBLE / power(10.0::DOUBLE, (event_id % 13)::DOUBLE)"


@query(
    f"""WITH s AS (SELECT event_id, {_SECONDS} AS s FROM events) SELECT event_id, CASE WHEN s < 1e-6 THEN printf('%.2fns', s * 1e9) WHEN s < 1e-3 THEN printf('%.2fµs', s * 1e6)
      WHEN s < 1 THEN printf('%.2fms', s * 1e3) WHEN s < 60 THEN printf('%.2fs', s) WHEN s < 3600 THEN printf('%.0fm', floor(s / 60)) || printf('%.0fs', s % 60)
      ELSE printf('%.0fh', floor(s / 3600)) || printf('%.0fm', floor((s % 3600) / 60)) || printf('%.0fs', s % 60) END AS human FROM s"""
)
def human_duration(spark, sf_dir):
    s = F.abs("value") * 1e4 / F.pow(F.lit(10.0), (F.col("event_id") % 13).cast("double"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", scalars.human_duration(s).alias("human"))


@query(f"SELECT l_orderkey, l_linenumber, {_human_sql('(l_partkey * l_partkey * l_suppkey)')} AS human FROM lineitem")
def human_elements(spark, sf_dir):
    n = F.col("l_partkey") * F.col("l_partkey") * F.col("l_suppkey")
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", scalars.human_elements(n).alias("human"))


@query(f"WITH {_SQL_TENSORS} SELECT dtype, bool_or(starts_with(name, 'event.')) AS any_event, sum(numel * {_case('dtype', lambda d: d.size)})::BIGINT AS bytes FROM tensors GROUP BY dtype")
def bool_or_flag(spark, sf_dir):
    t = layout.sized(adapters.tensors(spark, sf_dir))
    return t.groupBy("dtype").agg(F.bool_or(F.col("name").startswith("event.")).alias("any_event"), F.sum(F.col("numel") * element_size(F.col("dtype"))).alias("bytes"))


@query(
    """SELECT event_id, 'k=' || json_extract_string(props, '$.k') AS picked, 'kind=' || event_type || CASE WHEN event_id % 2 = 0 THEN ',user=' || user_id ELSE '' END AS dropped FROM events"""
)
def option_projection(spark, sf_dir):
    """Option maps made of an event's properties, type and user: some keys picked, some dropped."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    own = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("kind"), F.col("event_type")))
    user = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("user"), F.col("user_id").cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    text = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    options = events.select("event_id", F.map_concat(own, user).alias("o"))
    return options.select("event_id", text(manifest.picked(F.col("o"), ["k", "absent"])).alias("picked"), text(manifest.dropped(F.col("o"), ["k", "absent"])).alias("dropped"))


@query(
    r"""SELECT p_partkey, regexp_replace(cls, '^(?:Flax|TF)', '') AS plain, CASE WHEN contains(ref, '--') THEN split_part(ref, '--', 1) END AS repository,
      regexp_replace(regexp_extract(ref, '^(?:.*?--)?(.*)$', 1), '\.[^.]*$', '') AS module, regexp_extract(ref, '[^.]*$') AS class_name
    FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Flax' WHEN 1 THEN 'TF' ELSE '' END || replace(p_type, ' ', '') AS cls,
      CASE WHEN p_partkey % 2 = 0 THEN 'org/' || p_size || '--' ELSE '' END || 'mod.sub.' || replace(p_brand, '#', '') AS ref FROM part)"""
)
def class_references(spark, sf_dir):
    """Class names without their prefix, and references split into repository, module and class."""
    key, brand = F.col("p_partkey"), F.translate("p_brand", "#", "")
    prefix = F.when(key % 3 == 0, F.lit("Flax")).when(key % 3 == 1, F.lit("TF")).otherwise(F.lit(""))
    repository = F.when(key % 2 == 0, F.concat(F.lit("org/"), F.col("p_size").cast("string"), F.lit("--"))).otherwise(F.lit(""))
    ref = scalars.reference(F.concat(repository, F.lit("mod.sub."), brand))
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select("p_partkey", scalars.without_class_prefix(F.concat(prefix, F.translate("p_type", " ", ""))).alias("plain"), ref["repository"].alias("repository"), ref["module"].alias("module"), ref["class_name"].alias("class_name"))


@query("SELECT o_orderpriority, min(n) AS least, max(n) AS most FROM (SELECT o_orderpriority, round(o_custkey * 1000.0::DOUBLE / (1 + o_orderkey % 7) / 1e9, 12) AS n FROM orders) GROUP BY o_orderpriority")
def decimal_throughput(spark, sf_dir):
    """Rates in decimal gigabytes, beside the binary ones of ``bench_stats``."""
    rate = F.round(scalars.decimal_gb_per_second(F.col("o_custkey") * F.lit(1000.0), 1 + F.col("o_orderkey") % 7), 12)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderpriority", rate.alias("n"))
    return orders.groupBy("o_orderpriority").agg(F.min("n").alias("least"), F.max("n").alias("most"))


@query("SELECT name, coalesce(CASE name WHEN 'src1' THEN 'gpu:0' WHEN 'src2' THEN 'gpu:1' END, 'cpu') AS device, CASE WHEN length(name) % 2 = 0 THEN 8 ELSE length(name) END::INT AS workers FROM (SELECT DISTINCT source AS name FROM documents)")
def component_devices(spark, sf_dir):
    """A component to device map with a default, and a fallback chain in which 0 counts as unset."""
    names = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("source").alias("name")).distinct()
    devices = spark.createDataFrame([("src1", "gpu:0"), ("src2", "gpu:1"), ("gone", "gpu:2")], "name string, device string")
    own = F.when(F.length("name") % 2 == 0, F.lit(0)).otherwise(F.length("name"))
    return manifest.with_device(names, devices, "cpu").withColumn("workers", manifest.first_set(own, F.lit(None).cast("int"), F.lit(8)))
