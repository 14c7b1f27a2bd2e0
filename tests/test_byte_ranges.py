"""Files read in chunks: gzip access points, lines, JSON arrays."""

from __future__ import annotations

import csv
import gzip
import io
import json
import random
import tarfile

import pytest

from trialmart.sources import archives, byte_access, gzip_index, json_arrays, readers, sinks


def prose(seed, n_lines):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijklmnopé") for _ in range(rng.randint(2, 9))) for _ in range(2000)]
    return "".join(
        " ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) + rng.choice(["\n", "\n", "\r\n", "\r"])
        for _ in range(n_lines)
    )


def points_of(data, spacing):
    rows = list(gzip_index.scan(io.BytesIO(data), spacing))
    ends = {r["member"]: r["member_end"] for r in rows if "member_end" in r}
    return [{**r, "member_end": ends[r["member"]]} for r in rows if "member_end" not in r]


@pytest.mark.parametrize("kind", ["1", "6", "9", "members", "small members", "stored", "zeros", "empty"])
def test_every_access_point_gives_the_rest_of_the_file(tmp_path, kind):
    text = prose(1, 25_000).encode()
    if kind in "169":
        data = gzip.compress(text, int(kind))
    elif kind == "members":
        data = b"".join(gzip.compress(text[i : i + 700_001]) for i in range(0, len(text), 700_001)) + b"\0" * 99
    elif kind == "small members":
        data = b"".join(gzip.compress(text[i : i + 30_000]) for i in range(0, len(text), 30_000))
    elif kind == "stored":
        text = text[:300_000]
        data = gzip.compress(text, 0)
    else:
        text = b"\0" * 5_000_000 if kind == "zeros" else b""
        data = gzip.compress(text)
    path = tmp_path / "x.gz"
    path.write_bytes(data)
    points = points_of(data, 300_000)
    assert b"".join(text[p["start"] : p["end"]] for p in points) == text
    for p in points:
        chunk = byte_access.open_chunk({**p, "path": str(path)})
        assert b"".join(chunk.pieces()) == text[p["start"] :]
        assert text[: p["start"]].endswith(p["window"])
        chunk.close()
    if kind in ("1", "6", "9"):
        assert len(points) > 5 and any(p["at_bit"] > 0 for p in points)
    if kind == "small members":
        assert 3 < len(points) < 15


def test_changed_file_is_noticed(spark, tmp_path):
    path = tmp_path / "x.txt.gz"
    path.write_bytes(gzip.compress(prose(2, 20_000).encode()))
    row = points_of(path.read_bytes(), 300_000)[2]
    path.write_bytes(gzip.compress(prose(3, 20_000).encode()))
    with pytest.raises(Exception):
        list(byte_access.open_chunk({**row, "path": str(path)}).pieces())
    path.write_bytes(path.read_bytes()[:-500])
    with pytest.raises(Exception, match="cannot be decompressed"):
        gzip_index.read_lines(spark, str(path)).count()


def test_lines_are_those_of_the_text_reader(spark, tmp_path):
    folder = tmp_path / "texts"
    folder.mkdir()
    for i, name in enumerate(["a.txt.gz", "b.txt", "empty.txt", "empty.txt.gz", "one.txt"]):
        text = prose(i, 12_000) if i < 2 else "" if i < 4 else "no end of line"
        data = text.encode()
        (folder / name).write_bytes(gzip.compress(data) if name.endswith("gz") else data)
    index = str(tmp_path / "index")
    found = gzip_index.read_lines(spark, str(folder), index_dir=index, chunk_bytes=100_000)
    plain = spark.read.text(str(folder))
    assert sorted(r["value"] for r in found.collect()) == sorted(r["value"] for r in plain.collect())
    assert found.select("path", "offset").distinct().count() == found.count()
    assert found.rdd.getNumPartitions() > 10
    # A second reading uses the stored index; a changed file gets a new one.
    before = spark.read.parquet(index).count()
    assert gzip_index.read_lines(spark, str(folder), index_dir=index).count() == found.count()
    assert spark.read.parquet(index).count() == before
    (folder / "a.txt.gz").write_bytes(gzip.compress(b"x\ny\n"))
    again = gzip_index.read_lines(spark, str(folder), index_dir=index).where("path like '%a.txt.gz'")
    assert sorted(r["value"] for r in again.collect()) == ["x", "y"]


def test_lines_for_every_border():
    data = b"ab\r\ncd\n\r\r\nefg\n\nh"
    want = [x for x in data.splitlines()]
    for cuts in range(1, len(data)):
        for size in (1, 2, 3, 100):
            got = []
            for start, end in ((0, cuts), (cuts, len(data))):
                rest = data[start:]
                pieces = [rest[i : i + size] for i in range(0, len(rest), size)]
                for offsets, lines in gzip_index.lines_of(iter(pieces), data[:start], start, end):
                    assert all(data[o:].startswith(x) for o, x in zip(offsets, lines))
                    got += lines
            assert got == want, (cuts, size)


def tricky(rng, depth=0):
    kind = rng.randint(0, 6 if depth < 3 else 3)
    if kind == 0:
        return rng.choice([None, True, 1.5, -3, ""])
    if kind <= 3:
        return "".join(rng.choice('ab"\\[]{},: \né/') for _ in range(rng.randint(0, 12)))
    if kind == 4:
        return [tricky(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return {f'k"{i}\\': tricky(rng, depth + 1) for i in range(rng.randint(0, 3))}


def test_elements_for_every_border(tmp_path, monkeypatch):
    """Chunks that end anywhere, in strings, escapes and brackets, give each element once."""
    rng = random.Random(4)
    for trial in range(60):
        values = [tricky(rng) for _ in range(rng.randint(0, 8))]
        text = json.dumps(values, indent=rng.choice([None, 2]), ensure_ascii=rng.random() < 0.5)
        data = (rng.choice(["", " \n"]) + text + rng.choice(["", "\n\n"])).encode()
        path = tmp_path / f"{trial}.json"
        path.write_bytes(data)
        cuts = sorted({0, len(data), *(rng.randrange(len(data)) for _ in range(rng.randint(0, 9)))})
        monkeypatch.setattr(byte_access, "PIECE", rng.choice([1, 3, 1 << 20]))
        quoted, depth, got = 0, 0, []
        for start, end in zip(cuts, cuts[1:]):
            row = {"path": str(path), "start": start, "end": end, "at_byte": None}
            got += [json.loads(x) for x in json_arrays.elements({**row, "in_string": bool(quoted), "depth": depth})]
            parity, outside, inside = json_arrays._summary(row)
            depth += inside if quoted else outside
            quoted = (quoted + parity) % 2
        assert got == values and (quoted, depth) == (0, 0)


def test_arrays_are_the_lines(spark, tmp_path):
    rng = random.Random(6)
    rows = [
        {"order_id": str(i), "items": json.dumps([{"n": '"x\\'}] * (i % 3)), "note": 'a "b" \\', "n": [i, {"k": "]"}]}
        for i in range(3000)
    ]
    rng.shuffle(rows)
    folder = tmp_path / "arrays"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps(rows[:1500], indent=1))
    with gzip.open(folder / "b.json.gz", "wt") as f:
        json.dump(rows[1500:], f)
    (folder / "c.json").write_text("[ ]")
    (folder / "d.json").write_text("")
    found = json_arrays.array_elements(spark, str(folder), chunk_bytes=20_000)
    got = [json.loads(r["value"]) for r in found.collect()]
    assert sorted(got, key=lambda r: int(r["order_id"])) == sorted(rows, key=lambda r: int(r["order_id"]))
    assert found.rdd.getNumPartitions() > 10
    table = json_arrays.read_json_array(spark, str(folder), chunk_bytes=20_000)
    assert table.columns == ["items", "n", "note", "order_id"]
    assert table.where("note = 'a \"b\" \\\\'").count() == 3000


def test_what_is_no_array_is_refused(spark, tmp_path):
    (tmp_path / "object.json").write_text('{"a": [1]}')
    with pytest.raises(Exception, match="is no JSON array"):
        json_arrays.array_elements(spark, str(tmp_path / "object.json")).collect()
    (tmp_path / "torn.json").write_text('[{"a": 1}, {"a": 2')
    with pytest.raises(Exception, match="ends inside its array"):
        json_arrays.array_elements(spark, str(tmp_path / "torn.json")).collect()


def test_written_arrays(spark, tmp_path):
    df = spark.createDataFrame([(str(i), f'"{i}') for i in range(50)], "order_id string, note string")
    for compression in (None, "gzip"):
        path = str(tmp_path / f"out-{compression}")
        sinks.write_json_arrays(df, path, 3, compression)
        back = readers.read_orders_json(spark, path, json_array=True, chunk_bytes=500)
        assert back.select("order_id", "note").exceptAll(df).isEmpty() and back.count() == 50
    sinks.write_json_arrays(df.limit(0), str(tmp_path / "none"), 2)
    assert readers.read_orders_json(spark, str(tmp_path / "none"), json_array=True).count() == 0


def make_tar(path, members, mode):
    with tarfile.open(path, mode) as tar:
        for name, data in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))


@pytest.mark.parametrize("mode", ["w", "w:gz"])
def test_tar_members_over_many_chunks(spark, tmp_path, mode):
    """Long members, small ones, quoted line breaks, empty ones, long names."""
    rng = random.Random(8)

    def table(n, columns=("a", "b")):
        out = io.StringIO()
        writer = csv.writer(out)
        writer.writerow(columns)
        for i in range(n):
            writer.writerow([rng.choice([f"x{i}", f'q"{i}\n"', "é,\n\n", f" {i}"]) + f"#{rng.getrandbits(96):x}", str(i)])
        return ("\ufeff" if n % 2 else "").encode() + out.getvalue().encode()

    members = {f"d/small{i}.csv": table(i % 7) for i in range(60)}
    members |= {"d/long.csv": table(6001), "e/._long.csv": b"junk", "empty.csv": b"", "x" * 150 + ".csv": table(40)}
    members["other.csv"] = "b,a\r\n1,k\r\n2,l".encode()
    suffix = "tar" if mode == "w" else "tar.gz"
    folder = tmp_path / "archives"
    folder.mkdir()
    make_tar(folder / f"a.{suffix}", members, mode)
    make_tar(folder / f"b.{suffix}", {"one.csv": table(900)}, mode)
    want_rows, want_lines = [], []
    for name, archive in [*((m, "a") for m in members), ("one.csv", "b")]:
        with tarfile.open(folder / f"{archive}.{suffix}") as tar:
            text = tar.extractfile(name).read().decode("utf-8-sig")
        if name.startswith("e/"):
            continue
        want_lines += [(name, i, x) for i, x in enumerate(io.StringIO(text, newline=None).read().splitlines())]
        records = [r for r in csv.reader(io.StringIO(text, newline="")) if any(c.strip() for c in r)]
        want_rows += [tuple(dict(zip(records[0], r)).get(n) or None for n in "ab") for r in records[1:]]
    options = {"chunk_bytes": 20_000}
    found = archives.read_tar_csv(spark, str(folder), **options)
    assert found.columns == ["a", "b"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want_rows, key=str)
    lines = archives.read_tar_lines(spark, str(folder), index_dir=str(tmp_path / "index"), **options)
    got = [(r["member"], r["line_no"], r["line"]) for r in lines.collect()]
    assert sorted(got) == sorted(want_lines)
    assert lines.rdd.getNumPartitions() > 2


def test_tar_members_with_more_columns(spark, tmp_path):
    make_tar(tmp_path / "a.tar", {"a.csv": b"a,b\n1,2\n", "b.csv": b"c,a\n3,4\n"}, "w")
    path = str(tmp_path / "a.tar")
    with pytest.raises(ValueError, match="differ in columns"):
        archives.read_tar_csv(spark, path)
    found = archives.read_tar_csv(spark, path, fill_missing=True)
    assert {tuple(r) for r in found.collect()} == {("1", "2", None), ("4", None, "3")}


def test_shards_of_an_indexed_file(spark, tmp_path):
    path = tmp_path / "o.json.gz"
    path.write_bytes(gzip.compress("".join(f'{{"order_id": "{i}"}}\n' for i in range(5000)).encode()))
    shards = archives.shard_ndjson(spark, str(path), str(tmp_path / "s"), parts=3, index_dir=str(tmp_path / "i"))
    assert shards.distinct().count() == 5000


def test_written_archives(spark, tmp_path):
    df = spark.createDataFrame([(f'a,"{i}"', str(i), None) for i in range(500)], "a string, b string, c string")
    for compression in (None, "gz"):
        path = str(tmp_path / f"tars-{compression}")
        sinks.write_tar_csv(df, path, 3, rows_per_member=40, compression=compression)
        back = archives.read_tar_csv(spark, path, chunk_bytes=4000)
        assert back.exceptAll(df).isEmpty() and back.count() == 500
        assert archives.tar_members(spark, path).count() >= 13
        assert len(list((tmp_path / f"tars-{compression}").glob("part-*"))) == 3
