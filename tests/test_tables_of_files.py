"""Tables that are folders of files, and inputs whose rows sit in few splits."""

from pyspark.sql import functions as F

from veilspark.operators import staging
from veilspark.operators.staging import spread
from veilspark.streaming.stateless import drain, drain_totals, live_entity_counts, live_request_counts, read_stream, redact_stream

TEXTS = "doc_id long, text string"


def test_a_stream_reads_a_table_of_one_file_and_of_many(spark, tmp_path):
    rows = [(i, f"write to u{i}@example.com") for i in range(40)]
    spark.createDataFrame(rows, TEXTS).repartition(5).write.parquet(str(tmp_path / "many" / "documents.parquet"))
    spark.createDataFrame(rows, TEXTS).coalesce(1).write.parquet(str(tmp_path / "made"))
    (tmp_path / "one").mkdir()
    next((tmp_path / "made").glob("part-*")).rename(tmp_path / "one" / "documents.parquet")
    for kind in ("one", "many"):
        read = lambda: read_stream(spark, str(tmp_path / kind), "documents.parquet", TEXTS)  # noqa: B023, E731
        assert sorted(r.doc_id for r in drain(read(), "rows").collect()) == list(range(40))
        totals = drain_totals(live_entity_counts(redact_stream(read())), "entities")
        assert [tuple(r) for r in totals.collect()] == [("EMAIL", "redact", 40)]
        assert [tuple(r) for r in drain_totals(live_request_counts(redact_stream(read()), "/v1"), "n").collect()] == [("/v1", 40, 0)]


def test_totals_of_an_empty_table(spark, tmp_path):
    (tmp_path / "documents.parquet").mkdir()
    read = read_stream(spark, str(tmp_path), "documents.parquet", TEXTS)
    totals = drain_totals(read.groupBy(F.col("text")).agg(F.count("*").alias("n")), "n")
    assert totals.columns == ["text", "n"] and totals.count() == 0


def test_one_row_group_is_dealt_over_the_cores(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    spark.range(60_000).selectExpr("id", "md5(CAST(id AS STRING)) AS name").coalesce(1).write.parquet(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 200_000)
    try:
        read = spark.read.parquet(path)
        assert read.rdd.getNumPartitions() > 1
        per_task = lambda df: sorted(n for n in df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n)
        assert per_task(read) == [60_000]
        assert max(per_task(spread(read, "id"))) < 20_000
        monkeypatch.setattr(staging, "TASK_ROWS", 5_000)
        dealt = spread(read, "id")
        assert len(per_task(dealt)) == 12 and dealt.exceptAll(read).isEmpty() and dealt.count() == 60_000
        even = read.repartition(8)
        assert spread(even, "id") is even
        # Even splits of more rows than a task can do in time are dealt as well.
        monkeypatch.setattr(staging, "SPLIT_ROWS", 7_000)
        dealt = spread(even, "id")
        assert max(per_task(dealt)) < 6_000 and dealt.exceptAll(read).isEmpty() and dealt.count() == 60_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_tasks_do_not_grow_with_the_table(spark, tmp_path):
    """However many rows one row group holds, a task gets about as many, and all arrive once."""
    for rows in (120_000, 240_000):
        path = str(tmp_path / str(rows))
        spark.range(rows).selectExpr("id", "id % 7 AS k").coalesce(1).write.parquet(path)
        dealt = spread(spark.read.parquet(path), "id")
        per_task = dealt.groupBy(F.spark_partition_id()).count().select("count").toPandas()["count"]
        assert per_task.max() < 12_000 and per_task.sum() == rows


def test_chunks_are_sorted_in_bounded_tasks(spark, monkeypatch):
    """Streams of one range and of many give the same texts, in whatever number of tasks."""
    from veilspark.operators import chunks as c

    text = "say [NAME_1] and [NAME_2], [NO] [NAME_"
    cut = [(f"s{k}", i, 0, None, text[i * w : i * w + w], False, False) for k in range(9) for w in [k + 1] for i in range(-(-len(text) // w))]
    made = "stream_id string, seq long, choice int, tool_idx int, fragment string, finished boolean, done boolean"
    maps = spark.createDataFrame([(f"s{k}", {"[NAME_1]": "Ann", "[NAME_2]": f"Bob{k}"}) for k in range(9)], "stream_id string, token_map map<string,string>")
    chunks, staged, seen = spark.createDataFrame(cut, made), c.stage, []
    monkeypatch.setattr(c, "stage", lambda df, name: seen.append((name, df.rdd.getNumPartitions())) or staged(df, name))
    for most, bits in ((500_000, 12), (20, 12), (20, 1)):
        monkeypatch.setattr(c, "TASK_CHUNKS", most)
        rows = c.rehydrate_chunks(chunks, maps, range_bits=bits).orderBy("stream_id", "seq", "flushed").collect()
        got = {f"s{k}": "".join(r.text for r in rows if r.stream_id == f"s{k}") for k in range(9)}
        assert got == {f"s{k}": f"say Ann and Bob{k}, [NO] [NAME_" for k in range(9)}
        if most == 20:
            assert dict(seen)["chunks"] == -(-len(cut) // 20)


def test_an_id_of_most_texts_does_not_make_one_task(spark, monkeypatch):
    from veilspark.operators import lookup
    from veilspark.operators.models import join_model_spans

    monkeypatch.setattr(lookup, "MIN_HOT", 10)
    texts = spark.range(400).selectExpr("id AS note", "IF(id % 4 > 0, NULL, id) AS id", "'Ann Lee was here' AS text").repartition(8)
    spans = spark.createDataFrame([(None, 0, 7), (8, 4, 7), (999, 0, 3)], "id long, start int, end int")
    joined = join_model_spans(texts, spans, ("id",))
    got = {r.note: [(s.start, s.end) for s in r.model_spans] for r in joined.collect()}
    assert got == {i: [(0, 7)] if i % 4 else [(4, 7)] if i == 8 else [] for i in range(400)}
    per_task = [n for n in joined.rdd.mapPartitions(lambda rows: [sum(1 for r in rows if r.id is None)]).collect() if n]
    assert max(per_task) < 100
