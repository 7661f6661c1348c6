"""Plan checks: Python only where it is the extension point, filters and
column pruning reach the parquet scan."""
import __spark_entry__ as E

JVM_ONLY = ["links_per_host", "extract_links", "wall_detect", "js_detect", "classify_with_scorer", "build_versions", "diff_by_content", "export_csv",
            "job_summary", "upsert_status", "validate_jobs", "llm_parse_labels"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_python_in_jvm_operators(spark, sf):
    for name in JVM_ONLY:
        p = plan(E.queries()[name](spark, sf))
        assert "EvalPython" not in p and "PythonUDF" not in p, name


def test_elements_use_arrow_and_no_shuffle(spark, sf):
    """Only the matching of end tags runs in Python, in Arrow batches, and pages are never dealt anew."""
    for name in ["block_headings", "block_lists", "code_density", "strip_tags", "main_content"]:
        p = plan(E.queries()[name](spark, sf))
        assert "ArrowEvalPython" in p and "BatchEvalPython" not in p and "Exchange" not in p, name


def test_pandas_scorer_uses_arrow(spark, sf):
    p = plan(E.queries()["classify_with_scorer_pandas"](spark, sf))
    assert "ArrowEvalPython" in p


def test_point_lookup_pushed_down(spark, sf):
    p = E.queries()["scan_by_key"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderkey), EqualTo(o_orderkey,4242)]" in p


def test_html_scan_prunes_columns(spark, sf):
    p = plan(E.queries()["links_per_host"](spark, sf))
    assert "ReadSchema: struct<url:string,html:string>" in p
