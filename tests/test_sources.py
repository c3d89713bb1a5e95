import io
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from tomeweave.plans.engine import analyze
from tomeweave.plans.options import Options
from tomeweave.sources import backends, catalogue, images, sinks


def png(width, height, noise=0):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + bytes((x * noise + y) % 256 for x in range(width)) for y in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


@pytest.fixture
def tree(tmp_path):
    def folder(path, n, w, h):
        (tmp_path / path).mkdir(parents=True)
        for i in range(n):
            (tmp_path / path / f"{i:03d}.png").write_bytes(png(w, h))

    def archive(path, n, w, h):
        (tmp_path / path).write_bytes(zipped({f"{i:03d}.png": png(w, h) for i in range(n)}))

    folder("第7巻", 6, 120, 170)
    archive("07.zip", 6, 60, 85)
    archive("第8巻.zip", 10, 100, 140)
    folder("08", 4, 100, 140)
    archive("[作者] 作品名 第09巻 (DL版).zip", 5, 110, 155)
    archive("作品名09.zip", 5, 60, 85)
    archive("作品名 第10巻.zip", 4, 90, 127)
    archive("作品名 完全版 第10巻.zip", 4, 90, 127)
    folder("その他/さらに下/第12巻", 3, 85, 120)
    (tmp_path / "壊れた 第13巻.zip").write_bytes(b"no zip")
    return str(tmp_path)


def test_tree_end_to_end(spark, tree):
    items = catalogue.read_catalogue(spark, tree)
    got = {r.rel_path: r for r in items.collect()}
    assert len(got) == 10 and got["第7巻"].page_count == 6 and got["07.zip"].median_pixels == 60 * 85
    assert not got["壊れた 第13巻.zip"].measured and got["壊れた 第13巻.zip"].measure_error
    r = analyze(items, Options())
    roles = {x.rel_path: x.role for x in r.decisions.join(r.items.select("item_id", "rel_path"), "item_id").collect()}
    assert roles["第7巻"] == "winner" and roles["07.zip"] == "loser"
    assert roles["[作者] 作品名 第09巻 (DL版).zip"] == "winner" and roles["作品名09.zip"] == "loser"
    assert "作品名 第10巻.zip" not in roles
    names = {x.unified_name for x in r.names.collect()}
    assert {"作品名 第07巻", "作品名 第09巻", "作品名 完全版 第10巻"} <= names


def test_discover(spark):
    listing = [("set/v1_01.jpg", 5)] + [(f"a/作品 第{v}巻_{i}.jpg", 10) for v in (1, 2) for i in range(3)] + [(f"b/第3巻 {i}.jpg", 7) for i in range(4)]
    listing += [("b/deep/x.zip", 1), ("c/x v01.zip", 9), ("_重複/y v01.zip", 9), ("c/Thumbs.db", 1)]
    rows = {r.rel_path: r for r in catalogue.discover(spark.createDataFrame(listing, "rel_path string, size bigint")).collect()}
    assert set(rows) == {"a#第1巻", "a#第2巻", "b", "c/x v01.zip"}
    assert rows["a#第1巻"].page_count == 3 and rows["b"].title.volume == "3" and rows["c/x v01.zip"].total_bytes == 9


def test_entries_and_ranges(spark, tmp_path):
    inner = zipped({"p1.png": png(4, 4)})
    (tmp_path / "x v01-02.zip").write_bytes(zipped({"x v01.zip": inner, "sub/x v02.zip": inner, "../evil.txt": b"1"}))
    (tmp_path / "bad.cbz").write_bytes(b"?")
    rows = catalogue.archive_entries(spark, str(tmp_path)).collect()
    assert {r.name for r in rows if r.container == "x v01-02.zip"} == {"x v01.zip", "sub/x v02.zip", "evil.txt"}
    assert [r.error for r in rows if r.container == "bad.cbz"][0].startswith("zipfile")
    paths = {r.rel_path for r in catalogue.expand_ranges(spark, str(tmp_path)).select("rel_path").collect()}
    assert paths == {"bad.cbz", "x v01-02.zip/x v01.zip", "x v01-02.zip/sub/x v02.zip"}


def test_inner_volumes_are_items(spark, tmp_path):
    """A range archive's volumes are items, measured and compared; page hashes can't be asked for."""
    from tomeweave.__main__ import main

    one, two = (zipped({f"p{i}.png": png(40 + k, 60) for i in range(3)}) for k in range(2))
    (tmp_path / "x v01-02.zip").write_bytes(zipped({"x v01.zip": one, "x v02.zip": two}))
    (tmp_path / "x v02.zip").write_bytes(two)
    items = catalogue.read_catalogue(spark, str(tmp_path))
    got = {r.rel_path: r for r in items.collect()}
    assert set(got) == {"x v02.zip", "x v01-02.zip/x v01.zip", "x v01-02.zip/x v02.zip"}
    assert all(r.measured and r.page_count == 3 for r in got.values()) and got["x v01-02.zip/x v02.zip"].total_bytes == len(two)
    r = analyze(items, Options())
    roles = {x.rel_path: x.role for x in r.decisions.join(r.items.select("item_id", "rel_path"), "item_id").collect()}
    assert sorted(roles[p] for p in ("x v02.zip", "x v01-02.zip/x v02.zip")) == ["loser", "winner"]
    assert main([str(tmp_path), "--verify-content"]) == 1


def test_single_archive(spark, tmp_path):
    """One archive as input: its volumes, folders of images and range archives are the items."""
    one, two = (zipped({f"p{i}.png": png(40 + 40 * k, 60) for i in range(3)}) for k in range(2))
    loose = {f"作品名 第03巻/{i}.png": png(30, 50) for i in range(4)}
    (tmp_path / "作品名.zip").write_bytes(zipped({"作品名 第01巻.zip": one, "作品名 01.cbz": two, "x v04-05.zip": zipped({"x v04.zip": one, "x v05.zip": two}), "../read.txt": b"1", **loose}))
    got = {r.rel_path: r for r in catalogue.read_catalogue(spark, str(tmp_path / "作品名.zip")).collect()}
    assert set(got) == {"作品名 第01巻.zip", "作品名 01.cbz", "作品名 第03巻", "x v04-05.zip/x v04.zip", "x v04-05.zip/x v05.zip"}
    assert all(r.measured for r in got.values()) and got["作品名 第03巻"].page_count == 4 and got["作品名 第03巻"].median_pixels == 1500
    r = analyze(catalogue.read_catalogue(spark, str(tmp_path / "作品名.zip")), Options())
    roles = {x.rel_path: x.role for x in r.decisions.join(r.items.select("item_id", "rel_path"), "item_id").collect()}
    assert roles == {"作品名 第01巻.zip": "loser", "作品名 01.cbz": "winner"}


def test_folders_and_archives_are_sampled_alike(spark, tmp_path):
    sizes = [(10 + i, 10) for i in range(40)]
    (tmp_path / "v01").mkdir()
    for i, (w, h) in enumerate(sizes):
        (tmp_path / "v01" / f"p{i}.png").write_bytes(png(w, h))
    (tmp_path / "v02.zip").write_bytes(zipped({f"p{i}.png": png(w, h) for i, (w, h) in enumerate(sizes)}))
    taken = sorted({round(i * 39 / 15) for i in range(16)})
    middle = sorted(10 * (10 + i) for i in taken)
    want = (middle[7] + middle[8]) / 2
    got = {r.rel_path: r for r in catalogue.read_catalogue(spark, str(tmp_path)).collect()}
    assert {r.median_pixels for r in got.values()} == {want} and {r.page_count for r in got.values()} == {40}


def test_numbers_follow_natural_order(spark):
    paths = [f"s{i % 7}/v{i}.zip" for i in range(300)] + ["S3/v2.zip", "a"]
    rows = catalogue.numbered(spark.createDataFrame([(p,) for p in paths], "rel_path string").repartition(5)).orderBy("item_id").collect()
    key = lambda p: [(t.isdigit(), t.zfill(20)) if t.isdigit() else (False, t.lower()) for t in __import__("re").findall(r"\d+|\D+", p)]
    assert [r.item_id for r in rows] == list(range(1, len(paths) + 1))
    assert [r.rel_path for r in rows] == sorted(paths, key=lambda p: ([k for _, k in key(p)], p))


def test_backends(monkeypatch):
    data = zipped({"a.txt": b"1"})

    class Broken:
        def __init__(self, *a):
            raise OSError("broken")

    monkeypatch.setitem(backends.BACKENDS, "libarchive", Broken)
    monkeypatch.setitem(backends.BACKENDS, "bsdtar", backends.ZipBackend)
    monkeypatch.setattr(backends, "available", lambda n: n in ("libarchive", "bsdtar"))
    assert backends.Fallback(data, "rar").entries() == [("a.txt", 1, False)]
    with pytest.raises(backends.BackendError):
        backends.Fallback(data, "rar", "libarchive").entries()
    with pytest.raises(ValueError):
        backends.Fallback(data, "rar", "nothing")
    assert backends.decoded_zip_name("第1巻".encode("cp932").decode("cp437"), False) == "第1巻"


def test_image_headers():
    assert images.image_header(png(7, 9)) == ("PNG", 7, 9)
    assert images.image_header(b"GIF89a" + struct.pack("<HH", 3, 4)) == ("GIF", 3, 4)
    assert images.image_header(b"BM" + b"\0" * 16 + struct.pack("<ii", 5, -6)) == ("BMP", 5, 6)
    assert images.image_header(b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc2\x00\x0b\x08\x00\x10\x00\x20\x03") == ("JPEG", 32, 16)
    assert images.image_header(b"\xff\xd8\xff") is None and images.image_header(b"") is None
    assert images.difference_hash([[9, 8, 7, 6, 5, 4, 3, 2, 1]] * 8) == -1


def test_more_headers():
    entries = struct.pack("<HHIHH", 256, 3, 1, 70, 0) + struct.pack("<HHII", 257, 4, 1, 90)
    assert images.image_header(b"II*\0" + struct.pack("<IH", 8, 2) + entries) == ("TIFF", 70, 90)
    entries = struct.pack(">HHIHH", 256, 3, 1, 7, 0) + struct.pack(">HHII", 257, 4, 1, 9)
    assert images.image_header(b"MM\0*" + struct.pack(">IH", 8, 2) + entries) == ("TIFF", 7, 9)
    assert images.image_header(b"II*\0" + struct.pack("<IH", 8, 1) + entries[:12]) is None
    assert images.image_header(b"\0\0\0\x20ftypavif" + b"\0" * 30 + b"\0\0\0\x14ispe\0\0\0\0" + struct.pack(">II", 640, 480)) == ("AVIF", 640, 480)

    def codestream(*fields):
        value = at = 0
        for number, n in fields:
            value |= number << at
            at += n
        return b"\xff\x0a" + value.to_bytes(14, "little")

    small = codestream((1, 1), (4, 5), (0, 3), (7, 5))  # 40 high, 64 wide, in eights
    assert images.image_header(small) == ("JXL", 64, 40)
    large = codestream((0, 1), (1, 2), (999, 13), (5, 3))  # 1000 high, 16 to 9
    assert images.image_header(large) == ("JXL", 1777, 1000)
    assert images.image_header(b"\0\0\0\x0cJXL \r\n\x87\n" + b"\0\0\0\x14ftypjxl " + b"\0\0\0\x18jxlc" + small) == ("JXL", 64, 40)
    assert images.image_header(b"\xff\x0a\x01") is None


def test_programs(monkeypatch):
    class Said:
        def __init__(self, stdout):
            self.stdout = stdout

    def find(installed, banner):
        backends.program.cache_clear()
        monkeypatch.setattr(backends.shutil, "which", lambda name: f"/bin/{name}" if name in installed else None)
        monkeypatch.setattr(backends.subprocess, "run", lambda *a, **k: Said(banner))
        found = [backends.program(n) for n in ("bsdtar", "7z")]
        backends.program.cache_clear()
        return found

    assert find({"tar", "7za"}, b"tar (GNU tar) 1.35") == [None, "/bin/7za"]
    assert find({"tar"}, b"bsdtar 3.7.2 - libarchive 3.7.2") == ["/bin/tar", None]
    assert find({"bsdtar", "tar", "7zz", "7za"}, b"") == ["/bin/bsdtar", "/bin/7zz"]


def test_one_backend_does_all(monkeypatch):
    """A backend that lists but can't read hands over both."""
    data = zipped({"a.png": png(3, 4)})

    class ListsOnly(backends.ZipBackend):
        def entries(self):
            return [("other.png", 1, False)]

        def read(self, names):
            raise OSError("can't read")

    monkeypatch.setitem(backends.BACKENDS, "libarchive", ListsOnly)
    monkeypatch.setitem(backends.BACKENDS, "bsdtar", backends.ZipBackend)
    monkeypatch.setattr(backends, "available", lambda n: n in ("libarchive", "bsdtar"))
    assert backends.Fallback(data, "rar").attempt(lambda b: [n for n, _ in b.read([e[0] for e in b.entries()])]) == ["a.png"]


def test_lay_out(spark, tree, tmp_path_factory):
    out = tmp_path_factory.mktemp("flat")
    before = {p: p.stat().st_size for p in __import__("pathlib").Path(tree).rglob("*")}
    (__import__("pathlib").Path(tree) / "readme.txt").write_text("hello")
    with zipfile.ZipFile(tree + "/作品名 第14巻.zip", "w") as z:
        for i in range(3):
            z.writestr(f"outer/inner/{i}.png", png(50, 60))
    r = analyze(catalogue.read_catalogue(spark, tree), Options())
    done = sinks.lay_out(r.flat, r.actions, r.items, tree, str(out))
    folders = {p.name: sorted(x.name for x in p.iterdir()) for p in out.iterdir() if p.is_dir()}
    assert len(folders["作品名 第07巻"]) == 6 and len(folders["作品名 第09巻"]) == 5 and folders["作品名 第14巻"] == ["0.png", "1.png", "2.png"]
    assert "作品名 完全版 第10巻" in folders and folders["_その他"] == ["readme.txt"] and {"07.zip", "作品名09.zip"} <= set(folders["_重複"])
    assert (out / "作品名 第13巻.zip").is_file() or any("第13巻" in d for _, d, _ in done)
    assert {x for _, _, x in done} == {"placed", "moved", "skipped", "other"}
    assert all(p.stat().st_size == n for p, n in before.items() if p.is_file())
    assert sinks.lifted(["a/b/1", "a/b/2"]) == ["1", "2"] and sinks.lifted(["a/1", "b/2"]) == ["a/1", "b/2"] and sinks.lifted([]) == []


def test_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.png").write_bytes(b"abc")
    expected = sinks.zip_folder(str(tmp_path / "in"), str(tmp_path / "out.zip"))
    assert expected == [("a.png", 3, zipfile.ZIP_STORED)] and sinks.verify_zip(str(tmp_path / "out.zip"), expected) == []
    assert sinks.verify_zip(str(tmp_path / "out.zip"), [("a.png", 4, 0), ("b", 1, 0)]) == ["size: a.png", "missing: b"]
    with pytest.raises(ValueError):
        (tmp_path / "none").mkdir()
        sinks.zip_folder(str(tmp_path / "none"), str(tmp_path / "x.zip"))
    row = spark.range(1).select(*(F.lit("x").alias(c) for c in sinks.EVIDENCE_COLUMNS))
    sinks.write_evidence_file(row, str(tmp_path / "e.csv"))
    assert (tmp_path / "e.csv").read_bytes().startswith(b"\xef\xbb\xbfgroup,role")
    assert "-rr5p" in sinks.rar_command("a", "b.rar")


def test_archive_format(spark, tree, tmp_path):
    from tomeweave.sources.archive_source import register

    register(spark)
    rows = spark.read.format("archive").option("content", "true").load(tree).collect()
    assert len({r.container for r in rows}) == 7 and sum(r.error is not None for r in rows) == 1
    assert images.image_header(next(r.content for r in rows if r.container == "07.zip")) == ("PNG", 60, 85)
    (tmp_path / "empty").mkdir()
    assert spark.read.format("archive").load(str(tmp_path / "empty")).count() == 0


def test_actions_and_wrapping(spark, tmp_path, monkeypatch):
    for name in ("a.zip", "b.zip"):
        (tmp_path / name).write_bytes(zipped({"p.txt": b"1" * 1000}))
    (tmp_path / "dup").mkdir()
    (tmp_path / "dup/a.zip").write_bytes(b"")
    plan = spark.createDataFrame([(1, "move", "a.zip", "dup/a.zip"), (2, "delete", "b.zip", None), (3, "delete", "none.zip", None)], "item_id bigint, action string, source string, destination string")
    assert sinks.apply_actions(plan, str(tmp_path)) == [("a.zip", "planned"), ("b.zip", "planned"), ("none.zip", "planned")]
    assert sinks.apply_actions(plan, str(tmp_path), dry_run=False) == [("a.zip", "moved"), ("b.zip", "deleted"), ("none.zip", "skipped")]
    assert (tmp_path / "dup/a (2).zip").exists() and not (tmp_path / "b.zip").exists()
    sinks.recompress(str(tmp_path / "dup/a (2).zip"), str(tmp_path / "c.zip"))
    assert sinks.verify_zip(str(tmp_path / "c.zip"), [("p.txt", 1000, zipfile.ZIP_DEFLATED)]) == []
    assert not sinks.is_stored(str(tmp_path / "c.zip")) and not sinks.is_stored(str(tmp_path / "none.zip"))
    monkeypatch.setattr(sinks.shutil, "which", lambda name: None)
    path, warning = sinks.wrap(str(tmp_path / "dup"), str(tmp_path / "out"))
    assert path.endswith("out.zip") and warning and sinks.is_stored(path)
    (tmp_path / "vols/x v01/deep").mkdir(parents=True)
    (tmp_path / "vols/none").mkdir()
    (tmp_path / "vols/x v01/deep/a.txt").write_bytes(b"2" * 500)
    assert sinks.zip_volumes(str(tmp_path / "vols"), str(tmp_path / "zips")) == [str(tmp_path / "zips/x v01.zip")]
    assert sinks.verify_zip(str(tmp_path / "zips/x v01.zip"), [("deep/a.txt", 500, zipfile.ZIP_DEFLATED)]) == []
    assert sinks.replace_original(str(tmp_path / "c.zip"), path).endswith(".zip")


def test_command_line(spark, tree, tmp_path, capsys):
    from tomeweave.__main__ import main

    assert main([tree, "--evidence", str(tmp_path / "e.csv")]) == 2
    assert "items 10" in capsys.readouterr().out and (tmp_path / "e.csv").stat().st_size > 100
    assert main([tree, "--output", str(tmp_path / "out"), "--output-suffix=-done"]) == 2
    (packed,) = (tmp_path / "out").iterdir()
    with zipfile.ZipFile(packed) as z:
        assert packed.name.endswith("-done.zip") and "作品名 第09巻/000.png" in z.namelist()
    assert main([tree, "--margin", "2"]) == 1
    assert main([str(tmp_path / "nothing")]) == 1
