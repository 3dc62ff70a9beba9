from twinfold.streaming import dedup


def run_stream(spark, tmp_path, make, name):
    rows = [(k, f"2024-01-01 0{h}:{m:02d}:00", u) for k, (h, m, u) in enumerate([(0, 1, "a"), (0, 2, "a"), (0, 3, "b"), (1, 0, "a"), (1, 5, "b"), (1, 6, "b")])]
    df = spark.createDataFrame(rows, "event_id long, t string, user string").selectExpr("event_id", "cast(t as timestamp) ts", "user")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = make(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    q.awaitTermination(120)
    return spark.table(name), df


def test_first_events(spark, tmp_path):
    got, df = run_stream(spark, tmp_path, lambda s: dedup.first_events(s, ["user"]), "firsts")
    assert {r.user for r in got.collect()} == {"a", "b"} and got.count() == 2
    assert sorted((r.user, r.event_id) for r in dedup.first_events(df, ["user"]).collect()) == [("a", 0), ("b", 2)]


def test_windows(spark, tmp_path):
    got, df = run_stream(spark, tmp_path, lambda s: dedup.repeats_by_window(s, ["user"]), "wins")
    whole = {(str(r.window_start), r.user): r.repeats for r in dedup.repeats_by_window(df, ["user"]).collect()}
    assert whole[("2024-01-01 00:00:00", "a")] == 1 and whole[("2024-01-01 01:00:00", "b")] == 1
    assert {(str(r.window_start), r.user): r.repeats for r in got.collect()}.items() <= whole.items()


def test_file_groups(spark, tmp_path):
    seen = []
    add = dedup.file_groups(lambda g, n: seen.append((n, sorted((r["size"], r.n) for r in g.collect()))), f"{tmp_path}/files")
    make = lambda rows: spark.createDataFrame(rows, "path string, size long, md5 string, source int")
    add(make([("/a", 1, "x", 0), ("/b", 2, "y", 0)]), 0)
    add(make([("/c", 1, "x", 0)]), 1)
    add(make([("/c", 1, "x", 0)]), 1)
    assert seen == [(0, []), (1, [(1, 2)]), (1, [(1, 2)])]
