"""Labels, scores and the external classifier."""

import re

import pytest
from pyspark.sql import functions as F

from corpusrules.functions import scoring
from corpusrules.operators import classify as K

SCHEMA = "name string, source_code string, description string, markers array<string>"


@pytest.fixture(scope="module")
def label(spark):
    def run(name="f", source="def f(): return 1", description=None, markers=(), **options):
        df = spark.createDataFrame([(name, source, description, list(markers))], SCHEMA)
        return K.classify(df, **options).first()

    return run


def test_marker_wins(label):
    r = label(name="load_x", markers=["a", "b"])
    assert (r.classification, r.confidence) == ("business_logic", "high")
    assert r.reason == "Contains BUSINESS_RULE markers: a, b"


@pytest.mark.parametrize(
    "name, source, expected",
    [
        ("check_threshold", "if total > THRESHOLD: return limit", "business_logic"),
        ("calculate_rag_status", "def calculate_rag_status(): return 'x'", "business_logic"),
        ("load_orders", "return spark.read.parquet(p)", "pipeline_code"),
        ("save_orders", "df.write.mode('x').save(p)", "pipeline_code"),
        ("setup_session", "return get_session()", "pipeline_code"),
        ("validate_order", "return ok", "business_logic"),
    ],
)
def test_labels(label, name, source, expected):
    assert label(name=name, source=source).classification == expected


def test_reasons(label):
    assert label(source="policy").reason == "Matches 1 business logic patterns"
    assert label(source="policy").confidence == "medium"
    assert label(source="policy kpi").confidence == "high"
    r = label(name="load_x")
    assert (r.confidence, r.reason) == ("medium", "Matches 1 pipeline code patterns")
    assert label(name="load_x", source="pd.read").confidence == "high"
    r = label(name="load_x", source="policy kpi")
    assert (r.classification, r.confidence) == ("business_logic", "medium")
    assert r.reason == "Matches 2 business logic patterns vs 1 pipeline patterns"
    r = label(name="load_x", source="pd.read policy")
    assert (r.classification, r.confidence) == ("pipeline_code", "medium")
    assert r.reason == "Matches 2 pipeline patterns vs 1 business logic patterns"


def test_tie(label):
    for r in (label(), label(name="load_x", source="policy")):
        assert (r.classification, r.confidence, r.reason) == ("pipeline_code", "low", K.NO_MATCH)


def test_anchor_is_the_name(label):
    assert label(source="load_x").reason == K.NO_MATCH
    assert label(name="x_load_").reason == K.NO_MATCH


def test_substrings_count_and_gaps_stay_on_a_line(label):
    assert label(source="filtered").classification == "business_logic"
    assert label(source="calculate the\nscore").reason == K.NO_MATCH
    assert label(source="Calculate the SCORE").classification == "business_logic"


def test_description_is_searched(label):
    assert label(description="a KPI").classification == "business_logic"


TEXTS = [
    "threshold LIMIT calculate x rag", "check the Rule", "check\rrule", "rate of increase",
    "RATE\ndecrease", "transLATE amber", "spark.read x", "sparkXread", "df.write.x", "a.save(", "asave(",
    ".load(", "pd.read", "to_csv", "to_parquet to_json", "get_session", "create_schema", "load_", "load",
    "extract", "Ingest", "configure", "connect", " init", "\u212apI", "kp\u0130", "met\u017fric", "\u017fla",
    "calculate\u2028score", "calculate\u0085score", "", "S\u00c9LECT sla", "eligibility compliance metric policy",
]


def test_fast_tests_equal_the_plain_patterns(spark):
    """Word tests on folded text against the patterns as they are written."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    patterns = scoring.BUSINESS_PATTERNS + scoring.PIPELINE_PATTERNS
    folded = df.withColumn("t", scoring.fold(F.col("t")))
    got = folded.select("i", *[scoring.occurs(F.col("t"), p).alias(str(n)) for n, p in enumerate(patterns)])
    for row in got.collect():
        for n, p in enumerate(patterns):
            plain = p.replace(".*", "[^\n\r\u2028\u2029]*")
            want = re.search(plain, TEXTS[row.i], re.IGNORECASE | re.ASCII) is not None
            assert row[str(n)] == want, (TEXTS[row.i], p)


def test_every_word_of_every_pattern(spark):
    patterns = scoring.BUSINESS_PATTERNS + scoring.PIPELINE_PATTERNS
    words = sorted({w for p in patterns for w in re.findall(r"[a-z_]{2,}", p)})
    texts = [a + b for a in ["", *words] for b in ["", " x ", ".", "(", *words]]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    total = df.select("t", scoring.score(F.col("t"), patterns).alias("n")).collect()
    for r in total:
        assert r.n == sum(re.search(p, r.t, re.IGNORECASE) is not None for p in patterns), r.t


# --- external classifier --------------------------------------------------------------------


def test_only_ties_are_asked(spark):
    df = spark.createDataFrame(
        [("a", "x", None, []), ("b", "policy", None, []), ("c", "x", None, ["m"]), ("d", "y", "", [])],
        SCHEMA,
    )

    def ask(request):
        if "Function: d" in request:
            raise RuntimeError("down")
        assert "Function: a" in request
        return 'Sure: {"classification": "business_logic", "reason": "why"} bye'

    rows = {r.name: r for r in K.classify(df, ask).collect()}
    assert tuple(rows["a"])[-3:] == ("business_logic", "medium", "AI: why")
    assert rows["b"].reason == "Matches 1 business logic patterns"
    assert rows["c"].reason.startswith("Contains")
    assert rows["d"].reason == K.NO_MATCH
    assert len(K.classify(df, ask, partitions=2).collect()) == 4


def test_request_text(spark):
    long = "z" * 2500
    df = spark.createDataFrame([("a", long, "about", []), ("b", "s", "", []), ("c", "policy", None, [])], SCHEMA)
    whole = {r.name: r.request for r in K.ambiguous_requests(df).collect()}
    assert long in whole["a"] and "truncated" not in whole["a"]
    rows = {r.name: r.request for r in K.ambiguous_requests(df, limit=2000).collect()}
    assert set(rows) == {"a", "b"}
    assert "Function: a\nDescription: about\n" in rows["a"]
    assert "z" * 2000 + "\n... (truncated)\n" in rows["a"] and "z" * 2001 not in rows["a"]
    assert "Description" not in rows["b"] and "truncated" not in rows["b"]


@pytest.mark.parametrize(
    "response, expected",
    [
        ('{"classification": "pipeline_code", "reason": "r"}', ("pipeline_code", "medium", "AI: r")),
        ('a {"reason": "r", "classification": "business_logic"} b', ("business_logic", "medium", "AI: r")),
        ('{"classification": "business_logic"}', ("business_logic", "medium", "AI: undefined")),
        ('{"classification": "other", "reason": "r"}', ("pipeline_code", "low", K.BAD_ANSWER)),
        ('{"classification": "business_logic", "reason": "r"} and {x}', ("pipeline_code", "low", K.BAD_ANSWER)),
        ("{'classification': 'business_logic'}", ("pipeline_code", "low", K.BAD_ANSWER)),
        ("{bad}", ("pipeline_code", "low", K.BAD_ANSWER)),
        ("none", ("pipeline_code", "low", K.BAD_ANSWER)),
        ("", ("pipeline_code", "low", K.BAD_ANSWER)),
        (None, ("pipeline_code", "low", K.NO_MATCH)),
    ],
)
def test_answers(spark, response, expected):
    df = spark.createDataFrame([(response,)], "response string")
    assert tuple(K.parse_answers(df).first())[1:] == expected


def test_filter_on_the_label_does_not_repeat_the_scores(spark):
    df = spark.createDataFrame([("a", "x", None, [])], SCHEMA)
    plan = K.classify(df).filter("classification = 'business_logic'")._jdf.queryExecution()
    assert plan.optimizedPlan().toString().count("threshold") == 1
