import uuid

import pyarrow.fs as pafs

from otindex.llm.files import MANIFEST_SCHEMA, RollingWriter, commit, manifest, one_file_per_task
from otindex.session import working_folder


def test_files_roll_and_only_the_manifest_counts(spark):
    folder = working_folder(spark, "files")

    def write(batches):
        task = None
        for batch in batches:
            for n in batch.column("id").to_pylist():
                task = task or RollingWriter(folder, n % 3, "f", ".bin", 10, b"HD")
                task.write(b"x" * 5, 1, n)
        if task:
            yield from task.manifest()

    # a failed attempt leaves a file that no manifest names
    lost = RollingWriter(folder, 0, "f", ".bin", 10)
    lost.write(b"half a fi")
    lost.out.close()
    rows = spark.range(9).selectExpr("id", "cast(id % 3 as int) as task").repartitionById(3, "task").sortWithinPartitions("id")
    files = commit(rows.mapInArrow(write, MANIFEST_SCHEMA), folder).orderBy("name").collect()
    assert [(r["name"], r["bytes"], r["records"]) for r in files] == [
        (f"f-{t:05d}-{s:05d}.bin", 12 if s == 0 else 7, 2 if s == 0 else 1) for t in range(3) for s in range(2)
    ]
    assert [r["start"] for r in files] == [0, 3, 9, 14, 21, 28]
    store, path = pafs.FileSystem.from_uri(folder)
    left = {f.base_name for f in store.get_file_info(pafs.FileSelector(path)) if f.base_name.endswith(".bin")}
    assert left == {r["name"] for r in files}
    assert store.get_file_info(f"{path}/_temporary").type == pafs.FileType.NotFound
    assert one_file_per_task(manifest(spark, folder)).rdd.getNumPartitions() == 6


def test_renaming_again_changes_nothing(spark):
    folder = working_folder(spark, "files")
    writer = RollingWriter(folder, 0, "g", ".bin", 10)
    writer.write(b"data")
    (batch,) = writer.manifest()
    rows = spark.createDataFrame(batch.to_pandas(), MANIFEST_SCHEMA)
    first = commit(rows, folder).collect()
    store, path = pafs.FileSystem.from_uri(folder)
    again = f"{folder}-{uuid.uuid4().hex}"
    other_store, other = pafs.FileSystem.from_uri(again)
    other_store.create_dir(other)
    store.copy_file(f"{path}/g-00000-00000.bin", f"{other}/g-00000-00000.bin")  # moved, then the task was lost
    assert commit(rows, again).collect() == first


def test_no_rows_make_an_empty_manifest(spark):
    folder = working_folder(spark, "files")
    assert commit(spark.createDataFrame([], MANIFEST_SCHEMA), folder).count() == 0
