"""Nothing is dropped in silence: null keys, unknown types, rejected terms, broken policies."""

import re

import pytest
from pyspark.sql import functions as F

from veilspark.functions.dialect import to_java
from veilspark.functions.hof import lookup_all
from veilspark.operators.admission import admit, rate_limit
from veilspark.operators.batch import redact_batch
from veilspark.operators.models import join_model_spans, parse_spans
from veilspark.operators.redact import redact
from veilspark.operators.rehydrate import rehydrate
from veilspark.operators.staging import drop_staged, spread, stage
from veilspark.operators.terms import term_spans
from veilspark.operators.vault import lookup_maps, map_id, read_vault, to_vault, write_vault
from veilspark.sources.policies import request_policy


@pytest.mark.parametrize(
    "pattern",
    [r"BEGIN[\s\S]*?END", r"id[\d\S]", r"k[a\S]", r"x[^\S]y", r"[\w\S]+", r"[^\d\S]", r"[\S\s]{3}", r"[a\s]b", r"[^a\s]+"],
)
def test_classes_with_escapes(spark, pattern):
    texts = ["BEGIN a\nb END", "id7 id! id", "ka k! k ", "x y x\ty xzy", "a b", "7 a\t", "", "ab b", "xé z"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(F.regexp_extract_all("t", F.lit(to_java("r", pattern)), F.lit(0))).collect()]
    assert got == [[m.group() for m in re.finditer(pattern, t)] for t in texts]


def test_property_escape_needs_its_flag(spark):
    df = spark.createDataFrame([("Ax p{L} q",)], "t string")
    found = lambda flags: df.select(F.regexp_extract_all("t", F.lit(to_java("r", r"\p{L}", flags)), F.lit(0))).first()[0]
    assert found("") == ["p{L}"] and found("u") == ["A", "x", "p", "L", "q"]


def test_null_scopes_and_ids(spark):
    rows = [(None, 1, 0, "pre c@d.com post"), ("a", 2, 1, "c@d.com"), (None, None, 2, "x e@f.org c@d.com"), ("a", 3, 3, "plain")]
    df = spark.createDataFrame(rows, "scope string, id long, pos long, text string")
    done = redact_batch(df, ["id"], ["scope"], ["pos"])
    got = {r.pos: r.redacted for r in done.texts.collect()}
    assert got == {0: "pre [EMAIL_1] post", 1: "[EMAIL_1]", 2: "x [EMAIL_2] [EMAIL_1]", 3: "plain"}
    assert done.passed().count() == 4 and done.passed_tokens().count() == 3


def test_null_callers(spark):
    df = spark.createDataFrame([(1, None, 0, "/a"), (2, "k", 0, "/a"), (3, None, 0, "/a")], "request_id long, caller string, ts_ms long, route string")
    got = {r.request_id: r.allowed for r in admit(df, 1, 0.001).collect()}
    assert got == {1: True, 2: True, 3: False}
    assert rate_limit(df, 1).count() == 3


def test_unknown_model_type_fails(spark):
    texts = spark.createDataFrame([(1, "hi Zephyr Corp")], "id long, text string")
    spans = spark.createDataFrame([(1, 3, 14, "ORG")], "id long, start int, end int, type string")
    with pytest.raises(Exception, match="unknown entity type ORG"):
        join_model_spans(texts, spans, ["id"]).collect()
    assert len(join_model_spans(texts, spans, ["id"], kind="NAME").first().model_spans) == 1


def test_offsets_are_any_numbers(spark):
    df = spark.createDataFrame([('{"spans": [{"start": 3.0, "end": 9}, {"start": "3", "end": 9}]}',)], "reply string")
    assert [(s["start"], s["end"]) for s in df.select(parse_spans(F.col("reply"))).first()[0]][0] == (3, 9)


def test_rejected_terms_fail(spark):
    texts = spark.createDataFrame([(1, "c++ and more")], "id long, text string")
    for term in ("c++", " x", "w " * 40 + "w"):
        with pytest.raises(Exception, match="not a whole-word term"):
            term_spans(texts, ["id"], spark.createDataFrame([(term,)], "term string"), "t").collect()


@pytest.mark.parametrize(
    "text", ['{"default":"block"', '{"defualt":"block"}', "[]", '{"default":1}', '{"default":"stop"}', '{"overrides":[]}', "7", "",
             '{"overrides":{"EMAIL":"stop"}}', '{"overrides":{"FAX":"mask"}}', '{"overrides":{"EMAIL":null}}', '{"default":null}']
)
def test_broken_request_policies_fail(spark, text):
    df = spark.createDataFrame([(text,)], "p string")
    with pytest.raises(Exception, match="invalid request policy"):
        df.select(request_policy("p")).collect()


def test_good_request_policies(spark):
    df = spark.createDataFrame([(None,), ("{}",), ('{"default":"block"}',), ('{"overrides":{"EMAIL":"mask"}}',)], "p string")
    got = [r[0] for r in df.select(request_policy("p")).collect()]
    assert got[0] is None and got[1]["default"] is None and got[2]["default"] == "block" and got[3]["overrides"] == {"EMAIL": "mask"}


def test_vault_days_are_utc_and_writes_repeat(spark, tmp_path):
    path = str(tmp_path / "vault")
    texts = spark.createDataFrame([("d1", "mail a@b.com")], "id string, text string")
    done = redact(texts)
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        made = F.timestamp_micros(F.lit(1_700_000_000_000_000 + 2 * 3600 * 1_000_000))
        for _ in range(2):
            write_vault(to_vault(done, "id", "run", made), path)
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        keyed = spark.createDataFrame([("d1", "to [EMAIL_1]")], "id string, text string").withColumn("map_id", map_id("run", F.col("id")))
        now = F.timestamp_micros(F.lit(1_700_000_000_000_000 + 2 * 3600 * 1_000_000 + 1))
        found, missed = lookup_maps(keyed, read_vault(spark, path), now)
        assert [r.token_map for r in found.collect()] == [{"[EMAIL_1]": "a@b.com"}] and missed.count() == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_secret_ids(spark):
    ids = [spark.range(1).select(map_id("r", F.lit("s"), k)).first()[0] for k in ("", "one", "two", "one")]
    assert len(set(ids)) == 3 and ids[1] == ids[3]


def test_lookup_all(spark):
    df = spark.createDataFrame([(["b", None, "a", "b", "z"],), ([],), (None,)], "k array<string>")
    entries = F.array(F.struct(F.lit("a").alias("key"), F.lit("1").alias("value")), F.struct(F.lit("b").alias("key"), F.lit("2").alias("value")))
    got = [r[0] for r in df.select(lookup_all(F.col("k"), entries)).collect()]
    assert got[:2] == [["2", None, "1", "2", None], []]


def test_many_findings_grow_about_linearly(spark):
    import time

    def seconds(k):
        text = " ".join(f"u{i}@e{i % 97}.com" for i in range(k))
        df = spark.createDataFrame([(text,)], "text string").withColumn("original", F.col("text"))
        start = time.perf_counter()
        done = redact(df).select(F.size("token_map").alias("n"), (rehydrate(F.col("redacted"), F.col("token_map")) == F.col("original")).alias("same"))
        assert tuple(done.first()) == (k, True)
        return time.perf_counter() - start

    seconds(100)
    assert seconds(16_000) < 20 * max(0.5, seconds(1_600))


def test_spread_leaves_several_splits_alone(spark):
    assert spread(spark.range(10).repartition(3), "id").rdd.getNumPartitions() == 3
    assert spread(spark.range(10).coalesce(1), "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_staged_tables_can_be_dropped(spark):
    kept = stage(spark.range(3), "mine")
    assert kept.count() == 3
    drop_staged(spark)
    with pytest.raises(Exception):  # noqa: B017
        stage(spark.range(1)).unionByName(kept).count()
