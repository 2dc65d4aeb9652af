import pytest
from hypothesis import given, settings, HealthCheck
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilspark.functions.labels import count_placeholders, normalize_label
from veilspark.functions.masks import mask_value
from veilspark.operators.audit import audit_events, entities_total
from veilspark.operators.detect import detector_set
from veilspark.operators.policy import LayeredPolicy, Policy, with_key_policy
from veilspark.operators.redact import redact, split_blocked
from veilspark.operators.rehydrate import rehydrate
from veilspark.operators.rules import Rule, compile_rules, rules_from_json
from veilspark.functions.dialect import RuleError
from veilspark.sources.policies import checked_policies, key_policies, request_policy


def run(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    return {r.id: r for r in redact(df, **options).collect()}


def test_basic(spark):
    r = run(spark, ["Email jane@acme.com or call 415-555-0132", "a@b.com and again a@b.com"])
    assert r[0].redacted == "Email [EMAIL_1] or call [PHONE_1]"
    assert r[1].redacted == "[EMAIL_1] and again [EMAIL_1]"
    assert r[1].token_map == {"[EMAIL_1]": "a@b.com"}
    assert not r[0].blocked


def test_actions(spark):
    text = "jane@acme.com / 415-555-0132 / ssn 123-45-6789 / card 4111 1111 1111 1111"
    policy = Policy("redact", {"EMAIL": "mask", "PHONE": "allow", "SSN": "block", "CREDIT_CARD": "mask"})
    r = run(spark, [text], policy=policy)[0]
    assert r.redacted == "j***@acme.com / 415-555-0132 / ssn [SSN_1] / card **** **** **** 1111"
    assert r.blocked
    assert [(e.type, e.action) for e in r.entities] == [("EMAIL", "mask"), ("SSN", "block"), ("CREDIT_CARD", "mask")]
    assert r.token_map == {"[SSN_1]": "123-45-6789"}


def test_allow_shields_inner_spans(spark):
    """The address swallows the number in it; allowing addresses leaves all of it."""
    r = run(spark, ["at 742 Evergreen Terrace, Apt 4B"], policy=Policy("redact", {"ADDRESS": "allow"}))[0]
    assert r.redacted == "at 742 Evergreen Terrace, Apt 4B" and r.entities == []


def test_round_trip_many(spark):
    text = " ".join(f"u{i}@x.com" for i in range(400)) + " end"
    df = spark.createDataFrame([(text,)], "text string").withColumn("original", F.col("text"))
    r = redact(df).withColumn("back", rehydrate(F.col("redacted"), F.col("token_map"))).first()
    assert r.back == text and "[EMAIL_400]" in r.redacted and "@" not in r.redacted


PIECES = st.sampled_from(
    ["a@b.com", "c.d@e.org ", "415-555-0132", " ", "é", "漢字", "4111 1111 1111 1111", "\n", "1.2.3.4", "x", "Dr. Bob Lee ",
     "March 3, 1990", "123-45-6789", "12 Oak St", "[", "]", "[x]"]
)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(PIECES, max_size=30).map("".join), min_size=20, max_size=40))
def test_round_trip_property(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("original", F.col("text"))
    done = redact(df).withColumn("back", rehydrate(F.col("redacted"), F.col("token_map")))
    for r in done.collect():
        assert r.back == r.original
        ends = 0
        for e in r.entities:
            assert e.start >= ends
            ends = e.end


def test_masks(spark):
    cases = [
        ("CREDIT_CARD", "4111 1111 1111 1111", "**** **** **** 1111"),
        ("PHONE", "415-555-0132", "***-***-0132"),
        ("SSN", "123-45-6789", "***-**-6789"),
        ("EMAIL", "jane@acme.com", "j***@acme.com"),
        ("EMAIL", "a@b.com", "a*@b.com"),
        ("EMAIL", "@b.com", "@*.***"),
        ("NAME", "Alice Chen", "***** ****"),
        ("DATE", "03/14/1990", "**/**/****"),
        ("ADDRESS", "123 Main St", "*** **** **"),
        ("CUSTOM", "EMP-12345", "***-***45"),
        ("CUSTOM", "ab-1", "**-*"),
    ]
    df = spark.createDataFrame(cases, "t string, v string, want string")
    for r in df.withColumn("got", mask_value(F.col("t"), F.col("v"))).collect():
        assert r.got == r.want


def test_labels(spark):
    cases = [("employee id", "EMPLOYEE_ID"), ("--a  b--", "A_B"), ("!!", "CUSTOM"), ("", "CUSTOM"), ("straße", "STRASSE")]
    df = spark.createDataFrame(cases, "l string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", normalize_label(F.col("l"))).collect())
    n = spark.createDataFrame([("[A_1] [b] [C]",)], "t string").select(count_placeholders(F.col("t"))).first()[0]
    assert n == 2


def test_policy_layers(spark):
    rows = [
        ("mask", {"PHONE": "allow"}, None, None),
        (None, {"EMAIL": "block"}, "mask", {"PHONE": "allow"}),
        (None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "d string, o map<string,string>, kd string, ko map<string,string>").select(
        F.struct(F.col("d").alias("default"), F.col("o").alias("overrides")).alias("req"),
        F.struct(F.col("kd").alias("default"), F.col("ko").alias("overrides")).alias("key"),
    )
    policy = LayeredPolicy(Policy("redact", {"EMAIL": "block", "SSN": "block"}), "req", "key")
    got = df.select(*(policy.action(F.lit(t)).alias(t) for t in ("PHONE", "SSN", "EMAIL", "IPV4"))).collect()
    assert tuple(got[0]) == ("allow", "mask", "mask", "mask")
    assert tuple(got[1]) == ("allow", "mask", "block", "mask")
    assert tuple(got[2]) == ("redact", "block", "block", "redact")


def test_policy_sources(spark):
    table = key_policies(spark, '{"a": {"default": "block"}, "b": {"overrides": {"EMAIL": "mask", "ODD": "allow"}}}')
    texts = spark.createDataFrame([(1, "a", "x@y.com"), (2, "b", "x@y.com"), (3, "c", "x@y.com")], "id int, k string, text string")
    done = redact(with_key_policy(texts, table, "k"), policy=LayeredPolicy(key="key_policy"))
    assert {r.id: (r.redacted, r.blocked) for r in done.collect()} == {
        1: ("[EMAIL_1]", True), 2: ("x*@y.com", False), 3: ("[EMAIL_1]", False)
    }
    for bad in ("{not json", '{"a": {"default": "nuke"}}', "[]", '{"": {}}'):
        with pytest.raises(ValueError):
            key_policies(spark, bad)
    with pytest.raises(ValueError):
        Policy("nuke")
    wrong = spark.createDataFrame([("a", "nuke", None)], "scope_key string, default_action string, overrides map<string,string>")
    with pytest.raises(Exception, match="unknown action"):
        checked_policies(wrong).collect()
    sent = spark.createDataFrame([('{"overrides": {"ODD": "mask"}}',)], "j string")
    with pytest.raises(Exception, match="invalid request policy"):
        sent.select(request_policy("j")).collect()


def test_rules(spark):
    rules = rules_from_json('[{"name":"employee id","pattern":"EMP-\\\\d{5}"},{"name":"codename","terms":["Project Titan","Bluebird"],"flags":"i"}]')
    found = run(spark, ["EMP-12345 emailed jane@acme.com", "ship project titan, the bluebirds stay"],
                detectors=detector_set(*compile_rules(spark, rules)))
    assert found[0].redacted == "[EMPLOYEE_ID_1] emailed [EMAIL_1]"
    assert found[1].redacted == "ship [CODENAME_1], the bluebirds stay"
    assert found[0].entities[0].type == "CUSTOM" and found[0].entities[0].label == "employee id"


@pytest.mark.parametrize(
    "rule,match",
    [
        (Rule("bad"), "pattern.*terms"),
        (Rule("oops", "("), "invalid regex"),
        (Rule("evil", "(a+)+"), "for ever"),
        (Rule("evil", "(a*){2,}"), "for ever"),
        (Rule("huge", "a" * 300), "at most 256"),
        (Rule("sticky", "a", "y"), "flag 'y'"),
        (Rule("twice", "a++"), "invalid regex"),
        (Rule("flag", "a", "q"), "flags"),
    ],
)
def test_bad_rules(spark, rule, match):
    with pytest.raises(RuleError, match=match):
        compile_rules(spark, [rule])


def test_rule_dialect(spark):
    cases = [
        (Rule("r", r"a\sb"), "a\u00a0b", ["a\u00a0b"]),
        (Rule("r", r"\bfoo\b"), "éfoo foo_ foo", ["foo", "foo"]),
        (Rule("r", r"x$"), "x\n", []),
        (Rule("r", r"^b$", "m"), "a\nb\nc", ["b"]),
        (Rule("r", r"[[&&]"), "a[&", ["[", "&"]),
        (Rule("r", r"a*"), "baab", ["aa"]),
        (Rule("r", r"É", "i"), "é", ["é"]),
        (Rule("r", r"(\d)\1"), "12 33", ["33"]),
    ]
    for rule, text, expected in cases:
        from veilspark.operators.detect import detect

        df = detect(spark.createDataFrame([(text,)], "text string"), detectors=compile_rules(spark, [rule]))
        spans = df.first().spans
        assert [s.value for s in spans] == expected, rule
        assert all(text[s.start : s.end] == s.value for s in spans)


def test_rules_json_faults():
    for bad in ("{not json", "{}", '[{"pattern": "a"}]', '[{"name": "x", "terms": [""]}]', "[1]"):
        with pytest.raises(RuleError):
            rules_from_json(bad)
    assert rules_from_json("  ") == []


def test_label_shared_with_a_type(spark):
    """A rule named like a type continues that type's numbers."""
    rule = Rule("email", "EMP-1")
    r = run(spark, ["a@b.com EMP-1"], detectors=detector_set(*compile_rules(spark, [rule])))[0]
    assert r.redacted == "[EMAIL_1] [EMAIL_2]"


def test_split_and_audit_hold_no_values(spark):
    df = spark.createDataFrame([(1, "a@b.com"), (2, "ssn 123-45-6789")], "id int, text string")
    done = redact(df, policy=Policy("redact", {"SSN": "block"}))
    passed, quarantine = split_blocked(done, "id")
    assert [r.id for r in passed.collect()] == [1]
    q = quarantine.first()
    assert q.id == 2 and "6789" not in str(q)
    events = audit_events(done, "id", "/v1/redact", F.lit("t")).collect()
    assert "a@b.com" not in str(events) and {e.request_id: e.entity_counts for e in events} == {"1": {"EMAIL": 1}, "2": {"SSN": 1}}
    assert {(r.type, r.action): r.entities_total for r in entities_total(done).collect()} == {("EMAIL", "redact"): 1, ("SSN", "block"): 1}


@pytest.mark.parametrize("n", [1, 7, 32])
def test_partitioning_does_not_matter(spark, n):
    texts = [f"u{i % 7}@x.com and 415-555-{i:04d} u{i}@x.com" for i in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    whole = {r.id: r.redacted for r in redact(df.coalesce(1)).collect()}
    assert {r.id: r.redacted for r in redact(df.repartition(n)).collect()} == whole
