"""The data source for archives: members in archives of all kinds, partitions from directories, bounds."""

import gzip
import io
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from docspan.sources import archives
from docspan.sources.archives import ArchiveReader


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


def tarred(files, mode="w"):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as t:
        for name, data in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


@pytest.fixture
def folder(tmp_path):
    inner = zipped({"deep.txt": b"deep", "skip.exe": b"-"})
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.zip").write_bytes(zipped({f"m{k}.txt": bytes([65 + k % 26]) * 3000 for k in range(40)}))
    (tmp_path / "b.tar.gz").write_bytes(tarred({"in/x.csv": b"1,2", "in/inner.zip": inner, "in/t.tar": tarred({"y.txt": b"y"})}, "w:gz"))
    (tmp_path / "sub/c.zip").write_bytes(zipped({"inner.tgz": tarred({"z.txt": b"z"}, "w:gz"), "inner.zip": inner, "sheet.xlsx": b"s", "d.txt.gz": gzip.compress(b"unfolded")}))
    (tmp_path / "e.txt.gz").write_bytes(gzip.compress(b"single"))
    (tmp_path / "f.txt").write_bytes(b"plain")
    (tmp_path / "g.zip").write_bytes(b"no archive")
    (tmp_path / "h.rar").write_bytes(b"r")
    (tmp_path / "i.exe").write_bytes(b"-")
    (tmp_path / "bomb.zip").write_bytes(zipped({"large.txt": b"\0" * 200_000, "small.txt": b"ok"}))
    return str(tmp_path)


def test_members_of_all_kinds(spark, folder):
    archives.register(spark)
    for path in (folder, f"file://{folder}"):
        df = spark.read.format("archives").option("memberBytes", 100_000).load(path)
        got = {r.member: (bytes(r.content) if r.content is not None else None, r.error) for r in df.collect()}
        assert {m: got.pop(f"a.zip/{m}")[0][:1] for m in ("m0.txt", "m27.txt")} == {"m0.txt": b"A", "m27.txt": b"B"}
        assert got["b.tar.gz/in/x.csv"] == (b"1,2", None) and got["b.tar.gz/in/inner.zip/deep.txt"] == (b"deep", None) and got["b.tar.gz/in/t.tar/y.txt"] == (b"y", None)
        assert got["c.zip/inner.tgz/z.txt"] == (b"z", None) and got["c.zip/inner.zip/deep.txt"] == (b"deep", None) and got["c.zip/sheet.xlsx"] == (b"s", None) and got["c.zip/d.txt"] == (b"unfolded", None)
        assert got["e.txt"] == (b"single", None) and got["f.txt"] == (b"plain", None)
        assert got["g.zip"][1].startswith("cannot be read") and got["h.rar"][1] and not any("exe" in m for m in got)
        assert got["bomb.zip/large.txt"] == (None, "larger than 100000 bytes") and got["bomb.zip/small.txt"] == (b"ok", None)


def test_partitions_follow_the_directory(folder):
    reader = ArchiveReader({"path": f"{folder}/a.zip", "partitionBytes": "100"})
    parts = reader.partitions()
    assert len(parts) > 5 and parts[0].first == 0 and parts[-1].last == 40
    assert all(a.last == b.first for a, b in zip(parts, parts[1:], strict=False))
    assert sorted(m for p in parts for m, _, _ in reader.rows(p)) == sorted(f"a.zip/m{k}.txt" for k in range(40))


def test_one_member_is_held(tmp_path):
    """Members of a compressed TAR come out before the next one is read."""
    import tracemalloc

    files = {f"m{k}.txt": bytes([65 + k]) * (4 << 20) for k in range(20)}
    (tmp_path / "a.tar.gz").write_bytes(tarred(files, "w:gz"))
    (tmp_path / "a.zip").write_bytes(zipped(files))
    del files
    for name in ("a.tar.gz", "a.zip"):
        reader = ArchiveReader({"path": str(tmp_path / name)})
        tracemalloc.start()
        sizes = [len(data) for part in reader.partitions() for _, data, _ in reader.rows(part)]
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert sizes == [4 << 20] * 20 and peak < 16 << 20


def test_written_archives_are_read_again(spark, tmp_path):
    rows = [(k, f"n{k % 50}", f"text {k} é") for k in range(300)]
    df = spark.createDataFrame(rows, "k int, n string, t string").select(F.concat(F.lit("p"), (F.col("k") % 4).cast("string"), F.when(F.col("k") % 2 == 0, ".zip").otherwise(".tar")).alias("archive"), F.concat("n", F.lit("_"), F.col("k").cast("string"), F.lit(".txt")).alias("name"), F.encode("t", "UTF-8").alias("content"))
    assert archives.write_archives(df, str(tmp_path / "out")).agg(F.sum("members")).first()[0] == 300
    archives.register(spark)
    got = spark.read.format("archives").load(str(tmp_path / "out"))
    assert sorted(bytes(r.content).decode() for r in got.collect()) == sorted(t for _, _, t in rows)
    assert archives.write_archives(df.limit(0), str(tmp_path / "none")).count() == 0
