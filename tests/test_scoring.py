"""Scores, summaries and synonyms with exact values."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.components import components
from millrace.joins import fresh, hot_keys, join_around, join_groups
from millrace.operators.scoring import KeywordScorer, Profile, ScoreRule, ScorerConfigError, keyword_score, make_scorer, register_scorer, scorer_names
from millrace.operators.synonyms import Synonyms, synonym_classes
from millrace.plans.queries import QUERIES


def score(spark, text, skills, absent=(), rule=None, title="t", raw="", **profile):
    row = spark.createDataFrame([(title, text, raw, profile.pop("location", None), profile.pop("mode", "unknown"))], "title string, description_clean string, description_raw string, location string, work_mode string")
    return keyword_score(row.withColumn("eligible_locations", F.array().cast("array<string>")), Profile("r", skills, absent, **profile), rule).first()


@pytest.mark.parametrize(
    ("skills", "absent", "text", "want", "note"),
    [
        (["rust", "go"], [], "go, then rust", 100, "matched 2/2 skills (rust, go)"),
        (["rust", "go", "c++"], [], "c++ or rust", 67, "not mentioned: go"),
        ([f"s{k}" for k in range(40)], [], "s3 of them", 3, "matched 1/40 skills (s3)"),
        (["rust", "go"], ["perl"], "rust with perl", 16, "penalty -34: posting mentions ruled-out skill perl"),
        (["rust", "q1", "q2", "q3", "q4"], ["perl"], "rust with perl", 0, "penalty -20"),
        ([], ["perl"], "perl", 0, "no skills"),
        (["re\u0301seau", "Ｒ"], [], "Réseau et r", 100, "matched 2/2"),
    ],
)
def test_scores(spark, skills, absent, text, want, note):
    got = score(spark, text, skills, absent)
    assert got["score"] == want
    assert note in got["summary"]
    assert got["missing_requirements"] == []


def test_penalty_settings(spark):
    ruled = ["perl", "ada", "abap"]
    assert score(spark, "rust perl ada abap", ["rust"], ruled, ScoreRule(absent_skill_penalty_cap=0.25))["score"] == 75
    assert score(spark, "rust perl", ["rust"], ruled, ScoreRule(absent_skill_penalty=0.2))["score"] == 80
    assert score(spark, "rust perl ada abap", ["rust"], ruled)["score"] == 0
    for bad in ({"absent_skill_penalty": -0.1}, {"absent_skill_penalty_cap": 2}):
        with pytest.raises(ValueError):
            ScoreRule(**bad)


def test_scorers():
    assert {"keyword", "keyword_match"} <= set(scorer_names()) and isinstance(make_scorer({}), KeywordScorer)
    assert make_scorer({"backend": "keyword_match", "absent_skill_penalty": 0.1}).rule.absent_skill_penalty == 0.1
    for bad in ({"backend": "oracle"}, {"typo": 1}, {"absent_skill_penalty": -1}):
        with pytest.raises(ScorerConfigError):
            make_scorer(bad)
    with pytest.raises(ValueError):
        register_scorer("keyword")(KeywordScorer)


def test_fallback_and_fits(spark):
    assert score(spark, "", ["rust"], raw="rust")["score"] == 100
    assert score(spark, "x", ["rust"], raw="rust")["score"] == 0
    got = score(spark, "rust", ["Rust", "+++"], locations=("Norway",), location="Bergen, Norway", work_mode="remote", mode="hybrid")
    assert (got["location_match"], got["work_mode_match"], got["score"], got["unmatched_profile_skills"]) == (True, False, 50, ["+++"])
    assert got["summary"].endswith("location fits; work mode differs")


def test_synonyms(spark):
    joined = Synonyms([["k8s", "Kubernetes"], ["helm"], ["kube", "container fleet"], ["kubernetes", "kube"]])
    assert joined.forms("K8S") == {"k8s", "kubernetes", "kube", "container fleet"} and joined.forms("go") == {"go"}
    rule = ScoreRule(synonyms=[["k8s", "kubernetes"], ["kube", "container fleet"], ["kubernetes", "kube"]])
    assert score(spark, "runs a container fleet", ["k8s"], rule=rule)["score"] == 100
    assert score(spark, "runs containers, fleet", ["k8s"], rule=rule)["score"] == 0
    pairs = spark.createDataFrame([("w", "x"), ("y", "x"), ("y", "z"), ("a", "b")], "left string, right string")
    assert {tuple(r) for r in synonym_classes(pairs).collect()} == {("w", "w"), ("x", "w"), ("y", "w"), ("z", "w"), ("a", "a"), ("b", "a")}


def test_classes_of_order_lines(spark, tmp_path):
    """The query over a whole table of pairs, against merging sets one pair at a time."""
    rng = random.Random(3)
    pairs = [(rng.randint(1, 60), rng.randint(1, 40)) for _ in range(55)] + [(100 + k, 100 + k // 2) for k in range(30)]
    spark.createDataFrame(pairs, "l_partkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    groups = []
    for a, b in pairs:
        own = {f"c{a}", f"s{b}"}
        groups, own = [g for g in groups if not g & own], own.union(*[g for g in groups if g & own])
        groups.append(own)
    got = {r["term"]: r["class"] for r in QUERIES["synonym_classes_joined"](spark, str(tmp_path)).collect()}
    assert got == {t: min(g) for g in groups for t in g}


def test_synonyms_of_a_long_chain(spark):
    # The class 0 comes from the left to the valley of 1; by 50 rounds of neighbours it has not reached its middle.
    name = lambda k: f"t{k:04d}"
    order = [0, *range(202, 401), *range(500, 400, -1), 1, *range(501, 600)]
    pairs = [(name(a), name(b)) for a, b in zip(order, order[1:])] + [("x", "x"), ("y", None)]
    got = {r["term"]: r["class"] for r in synonym_classes(spark.createDataFrame(pairs, "left string, right string")).collect()}
    assert got == {name(k): name(0) for k in order} | {"x": "x", "y": "y"}


@pytest.mark.parametrize("hub", [100_000, 3])
def test_components_with_hubs(spark, hub):
    edges = [(k, k + 1) for k in range(40)] + [(100, 7), (200, 201), (300, 300)] + [(500, 501 + k) for k in range(30)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long"), hub).collect()))
    assert got == {k: 0 for k in [*range(41), 100]} | {200: 200, 201: 200} | {k: 500 for k in range(500, 531)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_join_groups_and_names(spark):
    rows = spark.createDataFrame([(k % 3 if k < 90 else k, k) for k in range(120)], "g int, k int")
    groups = rows.groupBy("g").count().filter("g <> 119")
    for how, many in (("inner", 119), ("left", 120)):
        got = join_groups(rows, groups, ["g"], "count", 120, how, share=10)
        assert (got.count(), got.agg(F.sum("count")).first()[0]) == (many, 3 * 30 * 30 + 29)
    for few in (hot_keys(rows, ["g"]), hot_keys(rows, ["g"]).limit(0)):
        for how, many in (("inner", 119), ("left", 120)):
            assert join_around(rows, groups, ["g"], few, how).count() == many
    assert hot_keys(rows, ["g"]).count() == 3
    assert fresh(["A", "b_"], "a", "b", "b") == ["a_", "b", "b__"]
