"""What grows with the tables must not be sent to every task, kept in one place or read over again."""

import re

import pytest

import __spark_entry__ as entry


def optimized(spark, sf_dir, name):
    return entry.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["a15_mapping_set_version", "c30_mapping_history", "w01_latest_version", "w02_current_mapping", "u02_series_union"])
def test_semi_join_sees_each_concept_once(spark, sf_dir, name):
    plan = optimized(spark, sf_dir, name)
    right = re.split(r"Join LeftSemi.*", plan)[1].split("Generate explode")[0]
    assert "Aggregate [source_concept" in right


def test_facts_of_a_filing_are_not_shuffled(spark, sf_dir):
    """Rules read the facts where they are made: nothing is exploded and collected again."""
    plan = optimized(spark, sf_dir, "c04_validation_run")
    assert "collect_list(struct(normalized_fact_id" not in plan and "Generate explode(held" not in plan


def test_lambda_reads_a_column_that_is_computed_once(spark):
    from pyspark.sql import functions as F

    from factengine.operators.rules import let

    rows = spark.range(1).select(F.array(F.lit(1), F.lit(2), F.lit(3)).alias("a"))
    one = rows.select(let(F.array_sort("a"), lambda s: F.filter("a", lambda x: F.array_contains(s, x))).alias("r"))
    assert one.first().r == [1, 2, 3]
    assert one._jdf.queryExecution().optimizedPlan().toString().count("array_sort") == 1


def test_facts_of_a_filing_are_made_by_compiled_expressions(spark, sf_dir):
    """A lambda over the facts is interpreted for each of them; what a fact is by its place is written out."""
    made = [x for x in optimized(spark, sf_dir, "r17_crx_001").splitlines() if re.search(r"AS owned#", x)]
    assert made and not any("lambdafunction" in x for x in made)
