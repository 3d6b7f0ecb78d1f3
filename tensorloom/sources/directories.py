"""Model directories (a config beside a container) and pipelines of several components.

Folders are local paths or URIs of any file system that pyarrow reaches.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom import api
from tensorloom.operators import manifest
from tensorloom.sources.container import file_system, is_container

MODEL, CONFIG, INDEX = "model.pack", "config.json", "model_index.json"


def _path(*parts: str) -> str:
    return "/".join(p.rstrip("/") for p in parts if p)


def _is_file(path: str) -> bool:
    from pyarrow import fs

    system, inner = file_system(path)
    return system.get_file_info(inner).type == fs.FileType.File


def _write_json(value: Mapping, folder: str, name: str) -> str:
    system, inner = file_system(folder)
    system.create_dir(inner, recursive=True)
    with system.open_output_stream(_path(inner, name)) as f:
        f.write(json.dumps(dict(value), ensure_ascii=False, indent=2, sort_keys=True).encode("utf-8"))
    return _path(folder, name)


def save_model(tensors: DataFrame, folder: str, config: Mapping | None = None, **options) -> str:
    """Write ``config.json`` and the container; an older container is replaced at the end."""
    _write_json(config or {}, folder, CONFIG)
    target = _path(folder, MODEL)
    api.pack(tensors, target, **options)
    return target


def model_path(folder: str, subfolder: str | None = None) -> str:
    """The container of a model directory."""
    path = _path(folder, subfolder or "", MODEL)
    if not _is_file(path):
        raise FileNotFoundError(path)
    return path


def load_model(spark: SparkSession, folder: str, subfolder: str | None = None, **options) -> tuple[DataFrame, dict]:
    """The directory's tensors and its config."""
    path = model_path(folder, subfolder)
    config = _path(path.rsplit("/", 1)[0], CONFIG)
    held = {}
    if _is_file(config):
        system, inner = file_system(config)
        with system.open_input_stream(inner) as f:
            held = json.loads(f.read().decode("utf-8"))
    return api.tensors(spark, path, **options), held


def configs(spark: SparkSession, path: str) -> DataFrame:
    """Config files with the family that their version keys show."""
    df = spark.read.schema("transformers_version string, _diffusers_version string, _class_name string").option("multiLine", True).json(path)
    return manifest.family(df.withColumn("path", F.input_file_name()))


def save_pipeline(components: Mapping[str, tuple], folder: str, dtypes: Mapping[str, str] | str | None = None) -> str:
    """Write components (name to (library, class, tensors or None)) and their manifest.

    A component without tensors is listed with nulls. ``dtypes`` is one type or one a component.
    """
    index: dict[str, list] = {}
    for name in sorted(components):
        library, kind, tensors = components[name]
        if tensors is None:
            index[name] = [None, None]
            continue
        target = dtypes.get(name) if isinstance(dtypes, Mapping) else dtypes
        save_model(tensors, _path(folder, name), {"_class_name": kind}, target_dtype=target)
        index[name] = [library, kind]
    return _write_json(index, folder, INDEX)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """name, library, class: the components of a pipeline's manifest; keys with an underscore are not."""
    text = spark.read.text(_path(folder, INDEX), wholetext=True)
    rows = text.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("name", "v")).where(~F.col("name").startswith("_"))
    return rows.select("name", F.get("v", F.lit(0)).alias("library"), F.get("v", F.lit(1)).alias("class"))


def load_pipeline(spark: SparkSession, folder: str, without: tuple[str, ...] = (), dtypes: Mapping[str, str] | None = None, **options) -> DataFrame:
    """component, wanted_dtype and the chunks of every packed component, in one DataFrame."""
    none = spark.createDataFrame([(n,) for n in without], "name string")
    listed = manifest.loadable(read_manifest(spark, folder), none).orderBy("name").collect()  # a manifest is a handful of rows
    paths = [p for r in listed if is_container(p := _path(folder, r["name"], MODEL))]
    if not paths:
        raise FileNotFoundError(f"no packed component in {folder}")
    rows = api.read(spark, ",".join(paths), **options)
    name = F.element_at(F.split("path", "/"), -2)
    return rows.withColumn("component", name).withColumn("wanted_dtype", manifest.dtype_on_load(name, dtypes or {}))
