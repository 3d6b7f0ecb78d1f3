"""Containers, their faults, conversion, directories, CLI and stream."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorloom import api, cli
from tensorloom.functions import codecs
from tensorloom.functions.dtypes import DTYPES
from tensorloom.operators.reconcile import Policy
from tensorloom.plans import files as plans
from tensorloom.sources import benchmarks, container, directories, safetensors
from tensorloom.sources.container import Signature
from tensorloom.streaming import catalogue

T = "name string, dtype string, shape array<bigint>, payload binary, ord bigint"


def sample(spark):
    """Every type, a scalar, an empty tensor, a name beyond ASCII."""
    rows = [(f"m.{d.name}", d.name, [4], codecs.encode([1, 1, 1, 1], d.name), i) for i, d in enumerate(DTYPES)]
    rows += [("scalar", "float32", [], codecs.encode([2.5], "float32"), 90), ("none", "int8", [0, 3], b"", 91), ("é.日", "int16", [2, 3], codecs.encode(range(6), "int16"), 92)]
    return rows, spark.createDataFrame(rows, T).repartition(3)


@pytest.mark.parametrize("align", [0, 1, 100, 128])
def test_round_trip(spark, tmp_path, align):
    rows, df = sample(spark)
    path = f"{tmp_path}/x.pack"
    footer = api.pack(df, path, align_bytes=align)
    assert footer.format.endswith("_v4") and len(footer.blocks) == 21 and [p.name for p in tmp_path.iterdir()] == ["x.pack"]
    got = {r["name"]: (r["dtype"], r["shape"], bytes(r["payload"])) for r in api.tensors(spark, path).collect()}
    assert got == {n: (d, s, bytes(p)) for n, d, s, p, _ in rows}
    old = api.read(spark, path, legacy_scalar_shape="true").where("name = 'scalar'").first()
    assert old["shape"] == [1]


@pytest.mark.parametrize("most", [1, 5, 100])
def test_folder_of_containers(spark, tmp_path, most):
    """Many, some and one container: the tensors of all are those given, other files don't stay."""
    rows, df = sample(spark)
    made = api.pack_folder(df, f"{tmp_path}/all", container_tensors=most, signature=Signature(b"OTHERPK\0", "x")).collect()
    files = sorted((tmp_path / "all").iterdir())
    assert sorted(r["path"] for r in made) == [str(f) for f in files] and (len(files) == 1) == (most == 100)
    assert sum(r["n_tensors"] for r in made) == len(rows) and all(f.stat().st_size == r["n_bytes"] for f, r in zip(files, sorted(made)))
    read = api.tensors(spark, f"{tmp_path}/all", magic="OTHERPK", prefix="x").collect()
    assert {r["name"]: (r["dtype"], r["shape"], bytes(r["payload"])) for r in read} == {n: (d, s, bytes(p)) for n, d, s, p, _ in rows}
    if most == 100:  # the same file as the writer of one file makes
        api.pack(df, f"{tmp_path}/one.pack", signature=Signature(b"OTHERPK\0", "x"))
        assert files[0].read_bytes() == (tmp_path / "one.pack").read_bytes()
        assert api.pack_folder(df.where("false"), f"{tmp_path}/none").count() == 0
        with pytest.raises(Exception, match="repeated"):
            api.pack_folder(df.unionByName(df.where("name = 'é.日'")), f"{tmp_path}/twice").count()


def test_one_type_is_version_3(spark, tmp_path):
    path = f"{tmp_path}/x.pack"
    df = spark.createDataFrame([("a", "float32", [3], codecs.encode([1, 2, 3], "float32"), 0), ("b", "int32", [2], codecs.encode([7, 8], "int32"), 1)], T)
    footer = api.pack(df, path, target_dtype="bfloat16")
    assert footer.format.endswith("_v3") and footer.target_dtype == "bfloat16" and list(footer.raw) == ["format", "target_dtype", "align_bytes", "total_elems", "index"]
    got = {r["name"]: codecs.decode(r["payload"], r["dtype"]).tolist() for r in api.tensors(spark, path).collect()}
    assert got == {"a": [1, 2, 3], "b": [7, 8]}
    with pytest.raises(ValueError, match="no tensor is left"):
        api.pack(df.where("false"), path)
    with pytest.raises(ValueError, match="hold no bytes"):
        api.pack(spark.createDataFrame([("a", "int8", [0], b"", 0)], T), path)


def test_chunks_and_filters(spark, tmp_path):
    path = f"{tmp_path}/x.pack"
    values = np.arange(100_000, dtype="<i4")
    pieces = [("big", "int32", [100_000], values[i : i + 30_000].tobytes(), 0, i // 30_000) for i in range(0, 100_000, 30_000)]
    small = [(f"s{i}.w", "int32", [2], codecs.encode([i, i], "int32"), i + 1, 0) for i in range(20)]
    api.pack(spark.createDataFrame(pieces + small, T + ", chunk_idx bigint"), path)
    rows = api.read(spark, path, chunk_bytes=50_000)
    assert rows.where("name = 'big'").count() == 8
    assert bytes(api.tensors(spark, path, chunk_bytes=50_000).where("name = 'big'").first()["payload"]) == values.tobytes()
    left = api.read(spark, path, ignore_names=["big"], ignore_prefixes=["s1"], ignore_suffixes=["5.w"])
    assert {r["name"] for r in left.collect()} == {f"s{i}.w" for i in range(20) if not str(i).startswith("1") and i != 5}
    # The name test is in the scan, not above it.
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "+- Filter" not in plan and ") Filter" not in plan


def test_other_signature(spark, tmp_path):
    _, df = sample(spark)
    path = f"{tmp_path}/x.pack"
    api.pack(df, path, signature=Signature(b"OTHERPK\0", "other"))
    with pytest.raises(ValueError, match="not signed"):
        container.read_footer(path)
    assert api.read(spark, path, "index", magic="OTHERPK", prefix="other").count() == 24


def test_faulty_footers(tmp_path, spark):
    v4 = {"format": f"{container.PREFIX}_v4", "align_bytes": 128, "total_elems": 300}
    block = [{"dtype": "uint8", "offset_bytes": 0, "length_bytes": 300, "length_elems": 300}]
    entry = {"name": "x", "shape": [1], "offset": 1, "length": 1}
    pack = lambda m: b"\0" * 300 + container.trailer(json.dumps(m).encode())
    cases = {
        "less than the end": b"x" * 15, "not signed": b"x" * 40, "begin before": container.LENGTH.pack(10**6) + container.MAGIC, "Expecting": container.trailer(b"{no"),
        "no container format": pack({"format": "x"}), "lists none": pack(v4), "in block 99": pack({**v4, "macroblocks": block, "index": [{**entry, "macroblock": 99}]}),
        "Unsupported dtype": pack({**v4, "macroblocks": [{**block[0], "dtype": "what"}]}),
    }
    for i, (said, raw) in enumerate(cases.items()):
        p = tmp_path / f"{i}.pack"
        p.write_bytes(raw)
        with pytest.raises(ValueError, match=said):
            container.read_footer(str(p))
        assert not container.is_container(str(p))
    meta = api.read(spark, str(tmp_path), "meta", mode="permissive")
    assert meta.where("is_valid").count() == 0 and meta.count() == len(cases)
    # Alignment is checked for all rows, ignored ones too.
    off = tmp_path / "off.pack"
    off.write_bytes(pack({**v4, "macroblocks": block, "index": [{**entry, "name": n} for n in "abcde"]}))
    with pytest.raises(Exception, match="5 tensors are off their alignment, the first a, b, c"):
        api.read(spark, str(off), ignore_names=list("abcde")).count()


@pytest.mark.parametrize("lost", [False, True])
def test_validity_is_told_of_bounded_containers(spark, sf_dir, monkeypatch, lost):
    """No footer is made on the driver; of many containers all have to be there and whole."""

    def on_driver(*_):
        raise AssertionError("the whole index came to the driver")

    def pack_folder(tensors, destination, pack=api.pack_folder):
        made = pack(tensors, destination, container_tensors=300)
        files = sorted(r["path"] for r in made.collect())
        assert len(files) > 2
        if lost:
            with open(files[1], "r+b") as f:
                f.truncate(9)
        return made

    monkeypatch.setattr(container, "footer_json", on_driver)
    monkeypatch.setattr(api, "pack_folder", pack_folder)
    out = {r["file"]: (r["is_valid"], r["fault"]) for r in plans.container_validity(spark, sf_dir).collect()}
    assert out.pop("good.pack") == ((False, "less than the end") if lost else (True, None))
    assert len(out) == 6 and not any(valid for valid, _ in out.values())


def test_assign(spark, tmp_path):
    path = f"{tmp_path}/x.pack"
    api.pack(sample(spark)[1], path)
    want = [(f"m.{d.name}", "param", d.name) for d in DTYPES[:5]] + [("é.日", "buffer", "int32"), ("scalar", "buffer", "float32"), ("gone", "buffer", "int8")]
    expected = spark.createDataFrame(want, "name string, kind string, dtype string")
    with pytest.raises(ValueError, match="buffer_dtype_mismatch.*日"):
        api.assign(spark, path, expected)
    with pytest.raises(ValueError, match="refused .discarded"):
        api.assign(spark, path, expected, Policy(strict=False, coerce_dtype=True))
    rest = {"ignore_names": ["none"] + [f"m.{d.name}" for d in DTYPES[5:]]}
    rows, counts = api.assign(spark, path, expected, Policy(coerce_dtype=True), **rest)
    assert counts["assigned_params"] == 5 and counts["assigned_buffers"] == 2 and counts["missing_buffers"] == 1
    coerced = rows.where("name = 'é.日'").first()
    assert coerced["dtype"] == "int32" and codecs.decode(coerced["payload"], "int32").tolist() == list(range(6))
    with pytest.raises(ValueError, match="missing_buffers.*gone"):
        api.assign(spark, path, expected, Policy(strict=True, coerce_dtype=True), **rest)


def test_convert_and_revert(spark, tmp_path, capsys):
    names = set(safetensors.NAMES.values())
    rows = [r for r in sample(spark)[0] if r[1] in names]
    source = f"{tmp_path}/m.safetensors"
    safetensors.write(spark.createDataFrame(rows, T), source)
    assert cli.main(["convert", source, "-i", "scalar", "-p", "m.float8", "-s", "int8"]) == 0
    made = f"{tmp_path}/m.pack"
    kept = {n: (d, s, bytes(p)) for n, d, s, p, _ in rows if n != "scalar" and not n.startswith("m.float8") and not n.endswith("int8")}
    got = {r["name"]: (r["dtype"], r["shape"], bytes(r["payload"])) for r in api.tensors(spark, made).collect()}
    assert got == kept
    assert cli.main(["revert", made, f"{tmp_path}/again.safetensors"]) == 0
    back = {r["name"]: bytes(r["payload"]) for r in safetensors.read(spark, f"{tmp_path}/again.safetensors").collect()}
    assert back == {n: x[2] for n, x in kept.items()}
    assert cli.main(["revert", made, f"{tmp_path}/table"]) == 0 and spark.read.parquet(f"{tmp_path}/table").count() == len(kept)
    capsys.readouterr()
    assert cli.main(["metadata", made, "-i"]) == 0
    text = capsys.readouterr().out
    assert "macroblocks:" in text and "é.日 [2, 3]" in text
    assert cli.main(["metadata", made, "-j"]) == 0 and "index" not in json.loads(capsys.readouterr().out)
    for bad in (["convert", f"{tmp_path}/x.pt"], ["convert", source, source], ["metadata", source], ["revert", f"{tmp_path}/no.pack", "-v"]):
        assert cli.main(bad) == 1
    assert "Error" in capsys.readouterr().err


def test_directories(spark, tmp_path):
    rows, df = sample(spark)
    directories.save_model(df, f"{tmp_path}/m", {"_diffusers_version": "1"})
    held, config = directories.load_model(spark, f"{tmp_path}/m")
    assert held.count() == len(rows) and config == {"_diffusers_version": "1"}
    assert directories.configs(spark, f"{tmp_path}/m/config.json").first()["family"] == "diffusers"
    with pytest.raises(FileNotFoundError):
        directories.load_model(spark, f"{tmp_path}/m", "sub")
    directories.save_pipeline({"vae": ("lib", "Vae", df), "text": ("lib", "Text", df.where("dtype = 'float32'")), "sched": ("lib", "S", None)}, f"{tmp_path}/p", {"text": "bfloat16"})
    out = directories.load_pipeline(spark, f"{tmp_path}/p", without=("none",), dtypes={"vae": "float16"}, ignore_suffixes=["8"])
    got = {(r["component"], r["wanted_dtype"], r["dtype"]) for r in out.select("component", "wanted_dtype", "dtype").distinct().collect()}
    assert ("text", "float32", "bfloat16") in got and ("vae", "float16", "int16") in got
    assert directories.load_pipeline(spark, f"{tmp_path}/p", without=("vae",)).select("component").distinct().count() == 1


def test_benchmark_files(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.csv").write_text("model,base_time,packed_time,total_bytes\na,1.0,0.5,100\nmodel,base_time,packed_time,total_bytes\nb,2.0,0.5,200\n")
    benchmarks.append(spark.createDataFrame([("c", 1.0, 1.0, 5)], benchmarks.SCHEMA), f"{tmp_path}/b")
    assert sorted(r["model"] for r in benchmarks.scan(spark, f"{tmp_path}/b").collect()) == ["a", "b", "c"]


def test_stream(spark, tmp_path):
    rows, df = sample(spark)
    (tmp_path / "in").mkdir()
    api.pack(df, f"{tmp_path}/in/a.pack")
    (tmp_path / "in" / "bad.pack").write_bytes(b"no")
    q = catalogue.stream(spark, f"{tmp_path}/in").writeStream.format("memory").queryName("landed").option("checkpointLocation", f"{tmp_path}/c").start()
    try:
        q.processAllAvailable()
        api.pack(df.where("dtype = 'int16'"), f"{tmp_path}/in/b.pack")
        q.processAllAvailable()
        got = spark.table("landed")
        assert got.where("is_valid").count() == len(rows) + 2 and got.where("not is_valid").count() == 1
    finally:
        q.stop()
