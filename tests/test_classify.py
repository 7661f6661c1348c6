"""Classifier scores and LLM response parsing, cases ported as data."""
from pyspark.sql import functions as F

from pagelake.operators import classify as C

CATS = [{"name": "Technology", "keywords": ["software", "programming", "developer", "api"],
         "url_patterns": [{"type": "contains", "pattern": "tech"}, {"type": "domain", "pattern": "dev.to"}]},
        {"name": "Food", "keywords": ["recipe", "cooking", "restaurant"], "url_patterns": []}]


def test_rule_classifier(spark):
    rows = [("https://dev.to/x", "software programming developer api software"), ("https://food.example.com/", "a recipe for cooking"),
            ("https://x.com/", "nothing here"), ("https://x.com/", "   ")]
    df = spark.createDataFrame(rows, "url string, text string")
    r = C.classify_pages(df, "url", "text", CATS).select("classification").collect()
    assert r[0].classification.category_name == "Technology" and r[0].classification.url_pattern == 1.0
    assert r[1].classification.category_name == "Food"
    assert r[2].classification is None and r[3].classification is None


LLM = ['{"labels": ["Food", "Sport"], "scores": [0.9, 0.7]}',
       '```json\n{"labels": ["food"], "scores": [0.8]}\n```',
       'Sure! {"labels": ["Technology"], "scores": [0.95]} Hope this helps.',
       '{"labels": ["Alien", "Food"], "scores": [0.9, 0.6]}',
       '{"labels": ["Food"], "scores": [1.7]}',
       '{"labels": ["Food", "Sport"], "scores": ["x", 0.2]}',
       '{"labels": ["Sport", "Food"], "scores": [0.3, 0.9]}',
       '', 'not json at all']


def test_llm_parse(spark):
    df = spark.createDataFrame([(t,) for t in LLM], "t string")
    labels = ["Food", "Sport", "Technology"]
    r = df.select(C.llm_parse_labels(C.llm_json_extract(F.col("t")), labels).alias("r")).collect()
    assert list(r[0].r.labels) == ["Food", "Sport"]
    assert list(r[1].r.labels) == ["Food"]
    assert list(r[2].r.labels) == ["Technology"]
    assert list(r[3].r.labels) == ["Food"]
    assert list(r[4].r.scores) == [1.0]
    assert list(r[5].r.scores) == [1.0, 0.2]
    assert list(r[6].r.labels) == ["Food", "Sport"] and r[6].r.primary_label == "Food"
    assert list(r[7].r.labels) == [] and list(r[8].r.labels) == []


def test_text_budget_and_truncate(spark):
    df = spark.createDataFrame([("t1 t2", [("paragraph", "a b c", None, None, None), ("code_block", "x y", None, None, None),
                                          ("paragraph", "d e", None, None, None)])],
                               "title string, blocks array<struct<type:string,content:string,level:int,language:string,items:array<string>>>")
    r = df.select(C.class_text_service(F.col("title"), F.col("blocks"), 4).alias("s"),
                  C.class_text_worker(F.col("title"), F.col("blocks"), 4).alias("w"),
                  C.truncate_words(F.lit("one two  three"), 2).alias("t")).first()
    assert r.s == "t1 t2 a b" and r.w == "t1 t2 a b c x" and r.t == "one two"


def test_service_text_splits_up_to_the_budget(spark):
    """Long blocks aren't split beyond the budget; code is left out; a missing title or content uses the budget up."""
    rows = [(1, " A  title ", [("paragraph", " one\ttwo "), ("code_block", "code"), (None, "\u00a0three four five"), ("paragraph", "six")]), (2, "t", []), (3, None, [("paragraph", "x")]),
            (4, "t", [("paragraph", "a"), ("paragraph", None), ("paragraph", "b")]), (5, "t", None), (6, "", [("paragraph", " \n ")])]
    df = spark.createDataFrame(rows, "i int, title string, blocks array<struct<type:string,content:string>>").select(
        "i", C.class_text_service(F.col("title"), F.col("blocks"), 5).alias("s"))
    assert {r.i: r.s for r in df.collect()} == {1: "A title one two three", 2: "t", 3: "", 4: "t a", 5: None, 6: ""}
    assert "aggregate(" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_a_response_is_parsed_once(spark):
    """Each step of a response's parsing stands once in the plan, however often its value is used."""
    texts = ['{"labels": ["art", "FOOD", "x"], "scores": ["0.2", 3]}', '```json\n{"labels": ["Food"]}\n```', 'so: {"labels": ["art", null], "scores": [null]} ok', "```{}```", "", None, "[1]"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("i", C.llm_parse_labels(C.llm_json_extract(df.t), ["Art", "Food"]).alias("r"))
    assert [(r.r.labels, r.r.scores, r.r.primary_label, r.r.error) for r in got.orderBy("i").collect()] == [
        (["Food", "Art"], [1.0, 0.2], "Food", None), (["Food"], [1.0], "Food", None), (["Art"], [1.0], "Art", None), *[([], [], None, "no_json")] * 4]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1 and plan.count("get_json_object(") <= 4
