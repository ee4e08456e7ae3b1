"""The data source ``pack``: many tasks over one archive, only wanted members opened, the rows of ``packs.members``."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, StringEndsWith, StringStartsWith

from millrace.sources import packs
from millrace.sources.pack_source import PackReader, PackSource


def archive(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    at = tmp_path_factory.mktemp("packs")
    inner = archive({"deep/a.json": "{}", "deeper.jar": archive({"x.txt": "x", "last.zip": archive({"y.txt": "y"})})})
    (at / "big.zip").write_bytes(archive({f"assets/{k % 10}/f{k}.json": f'"{k}"' * 50 for k in range(1000)} | {"__MACOSX/._f": "no", "empty/": ""}))
    (at / "sub").mkdir()
    (at / "sub" / "nested.jar").write_bytes(archive({"in.zip": inner, "plain.txt": "p", "broken.zip": "not a zip"}))
    (at / "readme.txt").write_text("text")
    (at / "fake.zip").write_bytes(b"no archive")
    (at / ".DS_Store").write_bytes(b"")
    return at


@pytest.fixture(scope="module")
def reads(spark):
    spark.dataSource.register(PackSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return lambda path, **options: spark.read.format("pack").options(**options).load(str(path))


def rows(df):
    return sorted((tuple(r.archives), r.path, bytes(r.content), r.depth) for r in df.select("archives", "path", "content", "depth").collect())


def test_gives_the_rows_of_the_folder_reader(spark, reads, root):
    want = rows(packs.members(packs.folder(spark, str(root))))
    got = rows(reads(root))
    assert got == want and len(got) == 1007
    assert {r[3] for r in got} == {0, 1, 2, 3} and (("sub/nested.jar", "in.zip", "deeper.jar"), "last.zip") in {r[:2] for r in got}


def test_one_archive_is_read_by_many_tasks(reads, root):
    df = reads(root / "big.zip", taskBytes=1)
    assert df.rdd.getNumPartitions() == 1000 and df.count() == 1000
    assert 1 <= reads(root / "big.zip").rdd.getNumPartitions() < 10
    assert {r.archives[0] for r in reads(root / "big.zip").select("archives").distinct().collect()} == {"big.zip"}


def test_only_wanted_members_are_opened(reads, root):
    df = reads(root / "big.zip", taskBytes=1).where("path LIKE 'assets/3/%' AND path <> 'assets/3/f3.json'")
    assert df.count() == 99 and df.rdd.getNumPartitions() == 100
    assert reads(root).where("depth = 2 AND path LIKE '%.json'").select("path").collect()[0].path == "deep/a.json"
    assert reads(root).where(F.col("path").isin("readme.txt", "x.txt")).count() == 2
    assert reads(root).where("path = 'x.txt' AND depth = 1").count() == 0
    reader = PackReader(str(root), 1, 3)
    left = list(reader.pushFilters([EqualTo(("path",), "plain.txt"), EqualTo(("content",), b""), In(("depth",), (1, 2))]))
    assert [type(f).__name__ for f in left] == ["EqualTo"] and left[0].attribute == ("content",)
    assert [(s.under, s.members) for s in reader.partitions()] == [("big.zip", []), ("sub/nested.jar", ["in.zip"]), ("sub/nested.jar", ["plain.txt"]), ("sub/nested.jar", ["broken.zip"])]
    reader = PackReader(str(root), 1, 3)
    assert not list(reader.pushFilters([StringStartsWith(("path",), "assets/"), StringEndsWith(("path",), "7.json")]))
    assert sum(len(s.members) for s in reader.partitions() if s.under == "big.zip") == 100


def test_depth_is_an_option(reads, root):
    got = {r.path: r.depth for r in reads(root / "sub", depth=1).collect()}
    assert got == {"in.zip": 1, "plain.txt": 1, "broken.zip": 1}
    assert {r.path for r in reads(root / "sub", depth=0).collect()} == {"nested.jar"}


def test_other_files_are_refused(spark, reads, root, tmp_path):
    with pytest.raises(Exception, match="neither a folder nor an archive"):
        reads(root / "readme.txt").count()
    with pytest.raises(Exception, match="FileNotFoundError|No such file|missing"):
        reads(root / "missing").count()
    assert reads(tmp_path).count() == 0
