"""The integrity of raw files, and CSV files whose headers differ."""

from __future__ import annotations

import gzip
import io
import tarfile
import zlib

import pytest

from trialmart.sources import files, manifest, readers


def rows_of(spark, path, **options):
    return {r["name"]: r for r in manifest.file_manifest(spark, str(path), **options).collect()}


def tar_of(members, mode):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as tar:
        for name, data in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    return out.getvalue()


TEXT = "".join(f"{i * 7919 % 99991},{i}\n" for i in range(60_000)).encode()


def test_whole_files(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.csv.gz").write_bytes(gzip.compress(TEXT) + gzip.compress(b"last") + b"\0" * 20)
    (tmp_path / "deep" / "b.csv").write_bytes(b"\xef\xbb\xbf \n [1\n2")
    (tmp_path / "c.tar.gz").write_bytes(tar_of({f"m{i}.csv": TEXT[: i * 999] for i in range(9)}, "w:gz"))
    (tmp_path / "d.tar").write_bytes(tar_of({"x": b"1"}, "w"))
    (tmp_path / "e.txt").write_bytes(b"")
    found = rows_of(spark, tmp_path)
    assert len(found) == 5 and all(r["ok"] and r["broken_at"] is None for r in found.values())
    a = found["a.csv.gz"]
    assert (a["kind"], a["members"], a["lines"]) == ("gzip", 2, 60_001)
    assert (a["content_bytes"], a["crc32"]) == (len(TEXT) + 4, zlib.crc32(TEXT + b"last"))
    assert (found["b.csv"]["first_char"], found["b.csv"]["lines"]) == ("[", 3)
    assert found["c.tar.gz"]["members"] == 9
    assert found["c.tar.gz"]["first_members"] == [f"m{i}.csv" for i in range(5)]
    assert (found["d.tar"]["kind"], found["e.txt"]["lines"]) == ("tar", 0)
    heads = rows_of(spark, tmp_path, whole=False)
    assert all(r["ok"] and r["crc32"] is None for r in heads.values())


def test_the_byte_where_a_file_breaks(spark, tmp_path):
    whole = gzip.compress(TEXT)
    (tmp_path / "cut.gz").write_bytes(whole[: len(whole) // 2])
    (tmp_path / "none.gz").write_bytes(b"plain text")
    (tmp_path / "empty.gz").write_bytes(b"")
    (tmp_path / "sum.gz").write_bytes(whole[:-8] + bytes([whole[-8] ^ 1]) + whole[-7:])
    (tmp_path / "rest.gz").write_bytes(whole + b"rest")
    plain = tar_of({"a": b"x" * 5000, "b": b"y" * 5000}, "w")
    (tmp_path / "head.tar").write_bytes(plain[:5632] + b"?" * 512 + plain[6144:])
    (tmp_path / "cut.tar").write_bytes(plain[:8000])
    (tmp_path / "cut.tar.gz").write_bytes(gzip.compress(plain)[:100])
    found = rows_of(spark, tmp_path)
    assert not any(r["ok"] for r in found.values()) and all(r["problem"] for r in found.values())
    assert found["cut.gz"]["broken_at"] == len(whole) // 2 and 0 < found["cut.gz"]["lines"] < 60_000
    assert found["none.gz"]["broken_at"] in (0, 1) and found["empty.gz"]["broken_at"] == 0
    assert found["sum.gz"]["broken_at"] in range(len(whole) - 8, len(whole))
    assert found["rest.gz"]["broken_at"] in (len(whole), len(whole) + 1)
    assert found["head.tar"]["broken_at"] == 5632 and found["cut.tar"]["broken_at"] == 8000
    assert found["cut.tar.gz"]["broken_at"] == 100
    names = {r["path"].rpartition("/")[2] for r in manifest.broken_files(manifest.file_manifest(spark, str(tmp_path))).collect()}
    assert names == set(found)


def test_errors_of_the_job_are_no_broken_files(spark, tmp_path, monkeypatch):
    path = tmp_path / "x.csv.gz"
    path.write_bytes(gzip.compress(b"a\nb"))
    assert files.count_lines(spark, str(path)) == 2
    with pytest.raises(FileNotFoundError):
        files.is_readable_text(spark, str(tmp_path / "nowhere.gz"))
    with pytest.raises(FileNotFoundError):
        files.count_lines(spark, str(tmp_path / "nowhere.gz"))

    def lost(path, whole):
        raise OSError("executor lost its disk")

    monkeypatch.setattr(manifest, "check_file", lost)
    with pytest.raises(Exception, match="executor lost its disk"):
        files.is_readable_text(spark, str(path))


def test_csv_files_with_other_headers(spark, tmp_path):
    folder = tmp_path / "maps"
    (folder / "deep dir").mkdir(parents=True)
    (folder / "a.csv").write_text('customer_id,is_target\nc1,1\n"c,\n2",0\n')
    (folder / "deep dir" / "b.csv").write_text("\ufeffis_target, note ,customer_id\n0,x,c3\n1,,c4\n0\n")
    (folder / "c.csv").write_text("customer_id\n" + "".join(f"k{i}\n" for i in range(30)))
    (folder / "empty.csv").write_text("")
    found = readers.read_csv_by_name(spark, str(folder), pattern="*.csv", multi_line=True)
    assert found.columns == ["customer_id", "is_target", "note"]
    got = {tuple(r) for r in found.collect()}
    want = {("c1", "1", None), ("c,\n2", "0", None), ("c3", "0", "x"), ("c4", "1", None), (None, "0", None)}
    assert want == {r for r in got if r[0] is None or not r[0].startswith("k")} and len(got) == 35
    assert readers.read_abmap(spark, str(folder), by_name=True).where("note = 'x' and customer_id = 'c3'").count() == 1
    report = {r["path"].rpartition("/")[2]: (r["missing"], r["reordered"])
              for r in readers.header_report(readers.csv_headers(spark, str(folder))).collect()}
    assert report == {"a.csv": (["note"], False), "b.csv": ([], True), "c.csv": (["is_target", "note"], False)}
    large = readers.read_abmap(spark, str(folder), min_bytes=100, by_name=True)
    assert large.columns == ["customer_id"] and large.count() == 30
