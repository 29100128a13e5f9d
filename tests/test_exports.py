"""Named exports: positions that are reset, copied and survive a failure between writer and commit."""

import pytest
from pyspark.errors import StreamingQueryException

from gaugeflow.streaming.exports import NamedExports

RECORDS = "host_name string, app_name string, group_id int, ts double, value double"


class Place:
    """A folder of source files, a sink that replaces what it has of a number, and the readers' root."""

    def __init__(self, spark, root):
        self.spark, self.root = spark, str(root)
        self.exports, self.files = NamedExports(spark, f"{root}/readers"), 0
        self.calls = []

    def add(self, *times, host="h"):
        rows = [(host, "a", 0, float(t), float(t)) for t in times]
        self.spark.createDataFrame(rows, RECORDS).coalesce(1).write.parquet(f"{self.root}/in/f{self.files:03d}")
        self.files += 1

    def run(self, name, **more):
        stream = self.spark.readStream.schema(RECORDS).option("maxFilesPerTrigger", 1).parquet(f"{self.root}/in/*")

        def write(rows, number):
            self.calls.append((name, number, rows.count()))
            rows.write.mode("overwrite").parquet(f"{self.root}/out/{name}/number={number}")

        self.exports.export(stream, name, write, **more).awaitTermination()

    def out(self, name):
        return sorted(r.ts for r in self.spark.read.schema(RECORDS).parquet(f"{self.root}/out/{name}").collect())


@pytest.fixture
def place(spark, tmp_path):
    return Place(spark, tmp_path)


def test_a_copied_reader_gets_later_rows_only(place):
    place.add(1, 2)
    place.add(3)
    place.run("a")
    assert place.out("a") == [1, 2, 3]
    assert [r.position for r in place.exports.positions("a").collect()] == [3.0]
    place.exports.copy_position("a", "b")
    place.add(4, 2.5)
    place.add(1, host="new")
    place.run("b")
    assert place.out("b") == [1, 4]  # the late 2.5 lies before the position
    place.run("a")
    assert place.out("a") == [1, 1, 2, 3, 4]


def test_start_at_beginning(place):
    place.add(1, 2)
    place.run("a")
    place.run("a")
    assert [n for _, _, n in place.calls] == [2]
    place.exports.start_at_beginning("a")
    place.run("a")
    assert place.out("a") == [1, 1, 2, 2] and place.calls[-1][1] == 1 << 32
    assert sorted((r.reader, r.position) for r in place.exports.positions("a").collect()) == [("a", 2.0)]


def test_a_failure_between_writer_and_commit_repeats_one_micro_batch(place):
    place.add(1, 2)
    place.add(3)
    place.add(4)

    def crash(epoch):
        if epoch == 1:
            raise RuntimeError("lost")

    with pytest.raises(StreamingQueryException):
        place.run("a", crash=crash)
    assert place.out("a") == [1, 2, 3]
    place.run("a")
    assert place.out("a") == [1, 2, 3, 4]
    assert [(number, n) for _, number, n in place.calls] == [(0, 2), (1, 1), (1, 1), (2, 1)]


def test_a_failure_after_the_positions_loses_nothing(place, monkeypatch):
    """The version of a micro-batch is there, but the stream has not noted it as done: it reads the version before."""
    place.add(1)
    place.add(2)
    place.run("a")
    folder = place.exports._folder("a", 0)
    fs, path = place.exports._fs(folder)
    for name in ("1", ".1.crc"):
        fs.delete(path(f"{folder}/checkpoint/commits/{name}"), False)
    place.run("a")
    assert place.out("a") == [1, 2] and place.calls[-1] == ("a", 1, 1)


def test_old_versions_go(place):
    for t in range(6):
        place.add(t)
    seen = []
    place.run("a", hooks=(lambda rows, number: seen.append(number),))
    assert place.exports._versions(place.exports._folder("a", 0)) == [4, 5, 6] and seen == list(range(6))
