import pytest
from pyspark.sql import functions as F

from rookery.functions import text as X


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize("raw, want", [("SEV 2", "sev2"), ("tlm 330", "tlm-330"), ("shed mode's severity", "shed mode severity"), ("shed_mode", "shed mode"), ("  `Fleet  Map`  ", "fleet map"), ("it's'", "its")])
def test_entities(spark, raw, want):
    assert one(spark, X.normalise_entity(F.col("n")), n=raw) == want


def test_tokens_keep_identifiers(spark):
    assert one(spark, X.tokens(F.col("t")), t="TLM-330 in nw-grasp-v4, v2.1 and a_b!") == ["tlm-330", "in", "nw-grasp-v4", "v2.1", "and", "a_b"]


def test_approx_tokens(spark):
    assert [one(spark, X.approx_tokens(F.col("t")), t="x" * n) for n in (0, 3, 4, 9)] == [1, 1, 1, 2]


@pytest.mark.parametrize("text, want", [("a [2] b [1][2]", [1, 2]), ("none", []), ("[0] [-1] [x]", [0]), ("[99999999999999999999999]", [])])
def test_citations(spark, text, want):
    assert one(spark, X.citations(F.col("t")), t=text) == want


@pytest.mark.parametrize("text, valid", [('{"a": 1}', True), ('```json\n{"a": 1}\n```', True), ('so {"a": 1} ok', True), ('{"a": 1', False), ("[1]", False), ("", False), ('{"a": }', False)])
def test_parsed_object(spark, text, valid):
    assert one(spark, X.parsed_object(F.col("t")).isNotNull(), t=text) is valid


def test_lists_and_templates(spark):
    assert one(spark, X.clean_list(F.col("t"), 3), t="1. first one\n- second\n* ab\n") == ["first one", "second"]
    assert one(spark, X.fill_template(F.col("t"), {"a": F.lit("x"), "b": F.lit("y")}), t="{a}-{b}-{a}") == "x-y-x"
    assert one(spark, X.hints(F.col("t"), {"ms": "milli", "kg": "kilo"}), t="5 kg in 3 ms") == 'ms = "milli", kg = "kilo"'


def test_outline(spark):
    got = one(spark, X.outline(F.col("t"), F.lit("stem")), t="intro\n# Title \n## A\ntext é\n## B")
    assert (got.title, got.sections) == ("Title", ["A", "B"]) and got.n_bytes == len("intro\n# Title \n## A\ntext é\n## B".encode())
    assert one(spark, X.outline(F.col("t"), F.lit("stem")), t="x").title == "stem"


def test_transcripts(spark):
    assert one(spark, X.normalise_transcript(F.col("t")), t="  Hello,  WORLD — it's naïve-ish_ok! ") == "hello world its naïve-ish_ok"
