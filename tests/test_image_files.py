"""The data source of image files: what is written comes back, names are checked, endings are chosen."""

from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from winnower.sources import files
from winnower.sources.image_files import png, read_image_files, write_image_files


def table(spark, *rows):
    return spark.createDataFrame([(p, None if c is None else bytearray(c)) for p, c in rows], "path string, content binary")


def test_round_trip(spark, tmp_path):
    root = str(tmp_path / "images")
    written = [(f"a/{i}.png", bytes([i]) * i) for i in range(40)] + [("b/c/x.JPG", b"no image"), ("b/empty.png", None), ("b/notes.txt", b"text")]
    write_image_files(table(spark, *written).repartition(3), root)
    got = {r.path: (r.length, bytes(r.content)) for r in read_image_files(spark, root).collect()}
    assert got == {p: (len(c or b""), c or b"") for p, c in written}
    assert (tmp_path / "images" / "_SUCCESS").read_text().startswith("43 files")
    names = read_image_files(spark, root, ".png,.JPG", content=False)
    assert names.count() == 42 and names.where(F.col("content").isNotNull()).count() == 0
    assert {r.folder: r.n_files for r in files.count_by_folder(spark, root).collect()} == {"a": 40, "b": 2}
    write_image_files(table(spark, ("a/1.png", b"new")), root)  # a repeated task replaces its files
    assert read_image_files(spark, root).where("path = 'a/1.png'").first().length == 3


@pytest.mark.parametrize("name", ["../up.png", "/root.png", "a//b.png", "a/_hidden.png", ""])
def test_bad_names(spark, tmp_path, name):
    with pytest.raises(PySparkException):
        write_image_files(table(spark, (name, b"x")), str(tmp_path / "out"))


def test_missing_root(spark, tmp_path):
    with pytest.raises(PySparkException):
        read_image_files(spark, str(tmp_path / "none")).count()


def test_png_of_any_size(spark, tmp_path):
    root = str(tmp_path / "images")
    pixels = {f"{h}x{w}.png": (h, w, c, bytes((7 * k) % 251 for k in range(h * w * c))) for h, w, c in ((1, 1, 3), (3, 5, 3), (100, 300, 3))}
    write_image_files(table(spark, *((n, png(*v)) for n, v in pixels.items())), root)
    for r in files.scan_images(spark, root).collect():
        h, w, c, data = pixels[r.item_id.rsplit("/", 1)[1]]
        assert (r.height, r.width, r.channels, bytes(r.data)) == (h, w, c, data)


def test_small_files_share_tasks(spark, tmp_path):
    root = str(tmp_path / "images")
    write_image_files(table(spark, *((f"{i}.png", png(1, 1, 3, bytes(3))) for i in range(400))), root)
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    assert files.list_files(spark, root).rdd.getNumPartitions() <= 7  # Spark's 4 MB a file give 13
    assert files.scan_images(spark, root).count() == 400 and spark.conf.get("spark.sql.files.openCostInBytes") == before
