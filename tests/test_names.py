"""The index of names over batches, and what a suggestion reads."""

from gaugeflow.sources.names import NameIndex

NAMES = "type string, name string"


def batch(spark, *names, kind="metrics"):
    return spark.createDataFrame([(kind, n) for n in names], NAMES)


def listed(df):
    return [r.name for r in df.collect()]


def test_names_of_batches(spark, tmp_path):
    index = NameIndex(spark, str(tmp_path / "i"))
    assert index.names().count() == 0 and listed(index.suggest("metrics", "/")) == []
    index.add(batch(spark, "/sys/a", "/sys/b", "/sys/a", "", None), "1")
    index.add(batch(spark, "/sys/a", "/sys/fs/x", "/syß", "日本/x"), "2")
    index.add(batch(spark, "/sys/a", kind="tagv"), "3")
    index.add(batch(spark, "/sys/a", "/sys/fs/x", "/syß", "日本/x"), "2")  # again
    assert sorted(map(tuple, index.names().collect())) == sorted([("metrics", n) for n in ("/sys/a", "/sys/b", "/sys/fs/x", "/syß", "日本/x")] + [("tagv", "/sys/a")])
    assert listed(index.suggest("metrics", "/sys")) == ["/sys/a", "/sys/b", "/sys/fs/x"]
    assert listed(index.suggest("metrics", "", 2)) == ["/sys/a", "/sys/b"]
    assert listed(index.suggest("metrics", "/sys/fs/")) == ["/sys/fs/x"]
    assert listed(index.suggest("metrics", "/sy", 0)) == ["/sys/a", "/sys/b", "/sys/fs/x", "/syß"]
    assert listed(index.suggest("metrics", "日")) == ["日本/x"] and listed(index.suggest("tagv", "/")) == ["/sys/a"]
    assert listed(index.suggest("metrics", "x")) == []
    before = sorted(map(tuple, index.names().collect()))
    index.compact()
    index.add(batch(spark, "/sys/new"), "4")
    assert sorted(map(tuple, index.names().collect())) == sorted([*before, ("metrics", "/sys/new")])


def test_a_suggestion_reads_its_head_alone(spark, tmp_path):
    index = NameIndex(spark, str(tmp_path / "i"))
    names = spark.range(4000).selectExpr("'metrics' AS type", "concat('/m', id % 40 + 100, '/', id) AS name")
    index.add(names, "1")
    out = index.suggest("metrics", "/m117/")
    plan = out._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [isnotnull(type" in plan and "StartsWith(head" in plan and "StringStartsWith(name,/m117/)" in plan and "TakeOrderedAndProject" in plan
    assert len({r.f for r in index._rows().where("head = hex(encode('/m117/', 'UTF-8'))").selectExpr("input_file_name() AS f").collect()}) == 1
    assert len(listed(out)) == 25 and all(n.startswith("/m117/") for n in listed(out))


def test_names_of_a_stream(spark, tmp_path):
    index = NameIndex(spark, str(tmp_path / "i"))
    for k, names in enumerate((["/a", "/b"], ["/b", "/c"])):
        batch(spark, *names).coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
        stream = spark.readStream.schema(NAMES).parquet(str(tmp_path / "in*"))
        index.follow(stream, str(tmp_path / "state")).awaitTermination()
        assert listed(index.suggest("metrics", "/")) == sorted({"/a", "/b", *names})
