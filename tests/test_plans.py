"""Physical-plan properties of the registered queries (sf0.001)."""

import pytest

import __spark_entry__ as E


@pytest.fixture(autouse=True)
def _no_cached_plans(spark):
    """Other modules cache the readings view; cached plans would replace the scans."""
    spark.catalog.clearCache()
    yield


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _formatted(df) -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_predicates_reach_both_scans(spark, sf):
    text = _formatted(E.queries()["filter_product_test"](spark, sf))
    assert "PushedFilters: [In(l_returnflag, [A,R])" in text
    assert "EqualTo(p_brand,Brand#13)" in text


def test_flagship_reads_only_needed_columns(spark, sf):
    text = _formatted(E.entry(spark))
    li = [ln for ln in text.splitlines() if ln.startswith("ReadSchema: struct<l_")][0]
    # the md5 row key is never needed for the null test, so its inputs are not read
    for col in ("l_orderkey", "l_linenumber", "l_shipdate"):
        assert col not in li


def test_no_cross_joins_and_no_row_udfs(spark, sf):
    from speclab.plans.catalog import ORACLE as oracle
    from speclab.plans.catalog import QUERIES as qs
    bad = {}
    for name in sorted(oracle):
        plan = _plan(qs[name](spark, sf))
        hits = [op for op in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython") if op in plan]
        if hits:
            bad[name] = hits
    assert bad == {}


def test_only_python_in_tasks_is_the_pvalue_udf(spark, sf):
    qs = E.queries()
    from speclab.operators import select as M
    from speclab.plans.catalog import CAT_VARS, R
    plan = _plan(M.chi2_pairwise(R(spark, sf), CAT_VARS))
    assert "ArrowEvalPython" in plan and "BatchEvalPython" not in plan
    for name in ("numeric_statistics", "boxplot_summary", "split_70_15_15"):
        p = _plan(qs[name](spark, sf))
        assert "EvalPython" not in p and "MapInPandas" not in p


@pytest.mark.parametrize("name", ["numeric_statistics", "grouped_statistics", "boxplot_summary"])
def test_profiles_use_no_holistic_aggregates(spark, sf, name):
    plan = _plan(E.queries()[name](spark, sf))
    for fn in ("percentile(", "median(", "mode("):
        assert fn not in plan


def _final(df):
    """The plan that ran, and per plan node name its output rows."""
    df._jdf.queryExecution().toRdd().count()
    return _plan(df)


def test_final_plans(spark, sf):
    qs = E.queries()
    text = _final(qs["constant_columns"](spark, sf))
    assert "isFinalPlan=true" in text and "Generate" in text
    exchanges = [ln for ln in text.splitlines() if "Exchange" in ln and "BroadcastExchange" not in ln]
    assert all("SinglePartition" in ln or "RoundRobin" in ln or "hashpartitioning(p_partkey" in ln or "hashpartitioning(l_partkey" in ln
               for ln in exchanges if "Exchange " in ln), exchanges      # no exchange of raw values
    text = _final(qs["split_70_15_15"](spark, sf))
    assert "TakeOrderedAndProject" not in text and "Window" not in text


def test_narrow_band_of_values_spreads_over_ranges(spark):
    """Readings in a narrow band, and a hot key, spread over the ranges."""
    from speclab.operators import quantiles as Q
    df = spark.range(40000).selectExpr("180.0 + (id % 39989) / 100000.0 as value", "if(id % 50 = 0, 'b', 'a') as k", "1L as cnt")
    sizes = [r["n"] for r in Q.ranged(df, ["k"], ["value"], ranges=16).groupBy("k", "_b").count().withColumnRenamed("count", "n").collect()]
    assert max(sizes) <= 3 * 40000 / 16 and len(sizes) >= 16
    from pyspark.sql import functions as F
    got = Q.exact_quantiles(df, ["k"], "value", [0.5], vc=df.groupBy("k", "value").agg(F.sum("cnt").alias("cnt"))).collect()
    want = {r["k"]: r["m"] for r in df.groupBy("k").agg(F.median("value").alias("m")).collect()}
    assert all(abs(r["quantile"] - want[r["k"]]) < 1e-9 for r in got)


def test_no_function_is_defined_twice():
    import ast
    import pathlib

    import speclab
    for path in pathlib.Path(speclab.__file__).parent.rglob("*.py"):
        names = [n.name for n in ast.parse(path.read_text()).body if isinstance(n, (ast.FunctionDef, ast.ClassDef)) and not n.decorator_list]
        assert len(names) == len(set(names)), path


def test_chi_square_reads_observed_cells_only(spark):
    """Two columns of many values: no grid of all margins is built."""
    from pyspark.sql import functions as F

    from speclab.operators import select as M
    df = spark.range(3000).select((F.col("id") % 1499).cast("string").alias("a"), (F.col("id") % 1511).cast("string").alias("b"))
    out = M.chi2_pairwise(df, ["a", "b"])
    row = out.first()
    assert row["dof"] == 1498 * 1510
    n, ra, cb = 3000, df.groupBy("a").count(), df.groupBy("b").count()
    cells = (df.groupBy("a", "b").agg(F.count("*").alias("o")).join(ra.withColumnRenamed("count", "ra"), "a")
             .join(cb.withColumnRenamed("count", "cb"), "b"))
    want = n * (cells.agg(F.sum(F.col("o") * F.col("o") / (F.col("ra") * F.col("cb")))).first()[0] - 1)
    assert abs(row["statistic"] - want) < 1e-6 * want
