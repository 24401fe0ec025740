from pyspark.sql import functions as F

from gleaner.sources.image_folder import read_images
from gleaner.streaming.incremental import matches, watch
from tests.conftest import near, put, textured


def test_batches_match_what_is_stored(spark, tmp_path):
    root = tmp_path / "in"
    px = textured(50)
    put(root, "train/a.png", px)
    put(root, "train/b.png", textured(51))

    def run():
        files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).load(str(root))
        contents = files.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "content")
        watch(spark, contents, str(root), str(tmp_path / "facts"), str(tmp_path / "pairs"), str(tmp_path / "log")).awaitTermination()

    run()
    put(root, "test/c.png", near(px, 2))
    run()
    assert spark.read.parquet(str(tmp_path / "facts")).count() == 3
    pairs = spark.read.parquet(str(tmp_path / "pairs")).collect()
    assert [(r["rel"], r["other"]) for r in pairs] == [("test/c.png", "train/a.png")]
    images = read_images(spark, str(root))
    assert {(r["rel"], r["other"]) for r in matches(images, images).collect()} == {("test/c.png", "train/a.png"), ("train/a.png", "test/c.png")}
