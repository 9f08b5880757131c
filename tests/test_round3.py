"""Findings of round 3: rows against SQL on cut-off references, and plans that do not go by the size of files."""

import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pageguard.operators import ner, page
from pageguard.plans import forms, pages, tagging, vision
from pageguard.sources import html
from pageguard.sources.tables import written


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_written_tables_are_not_broadcast(spark):
    """Files of rows that are alike are tiny; by their size a table of any number of rows was broadcast."""
    rows = written(spark.range(200_000).selectExpr("id % 7 as k", "'the same text' as t"))
    assert "Broadcast" not in plan(rows.join(rows.where("k = 3").select("k").distinct(), "k"))


def test_customers_pages_are_dealt_to_tasks(spark, tmp_path):
    spark.range(6000).selectExpr("id + 1 as c_custkey", "'BUILDING' as c_mktsegment", "1.0D as c_acctbal").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    made = forms._pages(spark, str(tmp_path))
    assert made.rdd.getNumPartitions() == 3
    assert "Broadcast" not in plan(made.select("page_id", "url").join(spark.range(10).withColumnRenamed("id", "page_id"), "page_id"))


@pytest.fixture(scope="module")
def customers(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("customers"))
    spark.range(6000).selectExpr("id + 1 as c_custkey", "'BUILDING' as c_mktsegment", "1.0D as c_acctbal").coalesce(1).write.parquet(f"{at}/customer.parquet")
    return at


@pytest.mark.parametrize("name", ["form_items", "form_text_runs", "form_elements", "form_extraction", "form_rejoin", "form_selectors"])
def test_form_queries_broadcast_nothing_by_the_size_of_files(spark, customers, name):
    """Written tables, and an anti join of one, were taken for as small as their files."""
    assert "Broadcast" not in plan(forms.QUERIES[name](spark, customers))


@pytest.mark.parametrize("name", ["page_titles", "page_text_runs", "page_links", "element_ids", "text_to_element"])
def test_cut_off_references_are_as_in_sql(spark, tmp_path, name):
    text = "<html><head><title>a&amp;b &amp</title></head><body><p>x &lt y &amp;amp; &</p><a href=\"/q?a=1&amp;b=2&amp\">go &gt</a></body></html>"
    spark.createDataFrame([(1, "https://a.example/", text)], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    got = pages.QUERIES[name](spark, str(tmp_path))
    cols = sorted(got.columns)
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(con.sql(pages.ORACLE_SQL[name]).select(",".join(cols)).fetchall())


def test_texts_are_not_copied_for_each_ancestor(spark):
    """Ids meet the ancestors first; a text is shuffled by itself."""
    nodes = html.nodes(spark.createDataFrame([(1, "<div><a href='/x'>a <b>bold</b> c</a></div><p style='opacity:0'>faint <i>seen</i></p>")], "page_id long, html string"))
    made = page.elements(nodes)
    assert [(r.element_id, r.text) for r in made.collect()] == [(0, "a bold c")]
    steps = [s for s in made._jdf.queryExecution().executedPlan().toString().splitlines() if "Generate explode(path" in s]
    assert steps and not any("text" in s for s in steps)
    assert sorted(r.text for r in page.text_runs(nodes).collect()) == ["a", "bold", "c", "seen"]


def test_dealt_boxes_are_not_broadcast(spark, tmp_path):
    spark.range(6000).selectExpr("id as p_partkey", "cast(id % 50 as int) as p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert vision._boxes(spark, str(tmp_path)).rdd.getNumPartitions() == 3
    made = vision.iou_pairs(spark, str(tmp_path))
    assert "Broadcast" not in plan(made)
    con = duckdb.connect()
    con.sql(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    cols = sorted(made.columns)
    assert sorted(map(tuple, made.select(*cols).collect())) == sorted(con.sql(vision.ORACLE_SQL["iou_pairs"]).select(",".join(f'"{c}"' for c in cols)).fetchall())


def test_tokens_of_odd_characters(spark):
    """The pattern for Java finds what Python's finds, over all characters up to U+3010 and some beyond."""
    text = "".join(f"{chr(c)}a{chr(c)}{chr(c)}" for c in [*range(0xD800 - 0x8000), 0xFEFF, 0x1F600, 0xE000]) + "é!b c"
    rows = spark.createDataFrame([(1, text), (2, ""), (3, None)], "i int, t string").select("i", ner.tokens(F.col("t")).alias("t")).collect()
    assert {r.i: r.t for r in rows} == {1: re.findall(ner.TOKEN, text), 2: [], 3: []}
    assert "++" in ner.JAVA_TOKEN


def test_model_by_rule_gives_arrays():
    """Lists of 51 numbers a piece took most of ner_documents's time."""
    vocab = tagging.rule_vocabulary()
    got = tagging.rule_model()([[vocab["ba"], vocab["##b"], vocab["b"]]], [[1] * 3], [[0] * 3])
    assert isinstance(got[0], np.ndarray)
    assert got[0].argmax(axis=1).tolist() == [31, 32, 0]
