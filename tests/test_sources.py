from pyspark.sql import functions as F

from screenflow.sources import tables

SCHEMA = "id string, text string, label double"
ROWS = [("1,8-Cineole", "CC12 ", 1.5), ('say "x"', "", None), (None, "a|b", -2.0)]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    tables.write_table(df, str(tmp_path / "deep" / "csv"), "csv")
    back = tables.read_table(spark, str(tmp_path / "deep" / "csv"), SCHEMA)
    assert back.columns == ["id", "text", "label", "row_id"]
    assert {tuple(r)[:3] for r in back.collect()} == set(ROWS)
    assert back.select("row_id").distinct().count() == 3


def test_nan_is_missing(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("id,text,label\na,b,NaN\nc,,2\n")
    rows = tables.read_table(spark, str(path), SCHEMA, row_id=None).collect()
    assert [tuple(r) for r in rows] == [("a", "b", None), ("c", None, 2.0)]


def test_rename_needs_one_match(spark):
    df = spark.createDataFrame([(1, 2)], "SMILES int, other int")
    assert tables.select_rename(df, {"smiles": "s"}, ignore_case=True).columns == ["s"]
    for names, ignore in (({"smiles": "s"}, False), ({"missing": "m"}, True)):
        try:
            tables.select_rename(df, names, ignore)
        except ValueError:
            continue
        raise AssertionError("should not match")


def test_one_folder_per_split(spark, tmp_path):
    df = spark.range(10).withColumn("split", F.when(F.col("id") < 8, "train").otherwise("test"))
    tables.write_by_split(df, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s" / "split=train")).count() == 8


def test_json_and_vocabulary(spark, tmp_path):
    vocabulary = spark.createDataFrame([("<PAD>", 0), ("\r", 1)], "token string, id int")
    tables.write_vocabulary(vocabulary, str(tmp_path / "v"))
    assert sorted(tables.read_vocabulary(spark, str(tmp_path / "v")).collect()) == sorted(vocabulary.collect())
    (tmp_path / "one.json").write_text('{\n "a": 1,\n "b": ["x"]\n}')
    row = tables.read_table(spark, str(tmp_path / "one.json"), "a int, b array<string>", "json", None, line_breaks=True).first()
    assert (row.a, row.b) == (1, ["x"])


def test_json_lines_come_back_whole(spark, tmp_path):
    df = spark.range(1000).withColumn("text", F.concat(F.lit("line\n"), F.col("id").cast("string")))
    tables.write_table(df.repartition(2), str(tmp_path / "j"), "json")
    back = tables.read_table(spark, str(tmp_path / "j"), df.schema, "json", None)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_row_ids_follow_the_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x\n" + "\n".join(f"a{i}" for i in range(3)) + "\n")
    (tmp_path / "b.csv").write_text("x\n" + "\n".join(f"b{i}" for i in range(60_000)) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        rows = {r["x"]: r["row_id"] for r in tables.read_table(spark, str(tmp_path), "x string").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [rows[f"a{i}"] for i in range(3)] == [0, 1, 2]
    assert all(rows[f"b{i}"] == i + 3 for i in range(60_000))


def test_row_functions_leave_integers_alone(spark):
    from screenflow.operators.quality import enrich_rows

    df = spark.createDataFrame([(9007199254740993, "a"), (None, "b")], "n long, s string")
    rows = enrich_rows(df, lambda r: {"twice": r["n"] * 2}, "twice long").collect()
    assert {tuple(r) for r in rows} == {(9007199254740993, "a", 18014398509481986, True), (None, "b", None, False)}


def test_missing_keys_spread_over_tasks(spark, partitions):
    from screenflow.functions.skew import salted_join

    partitions(8)
    rows = spark.range(20_000).withColumn("k", F.when(F.col("id") % 10 == 0, F.col("id") % 7))
    keyed = rows.where("k is not null").groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.lit(1))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = salted_join(rows, keyed, ["k"], "n", ["id"], how="left", rows_per_task=100)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert joined.where("v = 1").count() == 2000 and joined.count() == 20_000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(sizes) == 8 and max(sizes) < 2 * min(sizes)
