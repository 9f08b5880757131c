"""Findings of round 4: steps that cost a multiple of what they had to, and shuffles that a page's rows do not need."""

import re

import pytest
from pyspark.sql import functions as F

from pageguard.operators import ner, page, tree
from pageguard.plans import forms, tagging
from pageguard.sources import html


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_types_are_named_once_a_label_and_not_once_an_item(spark):
    """Regular expressions over the type of each item took more than half of ner_documents's time."""
    docs = spark.createDataFrame([(1, "baba x")], "doc_id long, text string")
    found = ner.text_items(docs, "doc_id", "text", tagging.rule_vocabulary(), tagging.rule_model)
    assert "upper(" not in plan(found)
    assert [(r.type, r.match) for r in found.collect()] == [("NAME", "baba")]


def test_names_of_types_as_in_columns(spark):
    raw = [*ner.MODEL_TYPES, *tagging._TYPE_SAMPLES, "IPADDRESS", "IP ADDRESS", " ", "ß_x", "PER-SON"]
    rows = spark.createDataFrame([(r,) for r in raw], "r string").select("r", ner.normalize_type(F.col("r"), wide=True).alias("n")).collect()
    assert [(r.r, r.n) for r in rows] == [(r, ner.wide_type(r)) for r in raw]


@pytest.mark.parametrize("most", [100_000, 3])
def test_pieces_of_many_texts_are_those_of_each(most):
    vocab = tagging.rule_vocabulary()
    texts = ["", "İstanbul İ x", "a b﻿c!d\ud800e", " ", "\n\n", "x" * 300, "Baba, baba! 　é ß \U0001f600\x00\x1cZ-", "bab"]
    of, find = ner._Words(vocab, True), re.compile(ner.TOKEN).finditer
    want = [ner._pieces(t, of, find) for t in texts]
    many = ner._Pieces(vocab, True)
    many.words.most = most
    for batch in (texts, texts[:1], texts[5:], texts[::-1]):
        got = [tuple(x.tolist() for x in p) for p in many(batch)]
        assert got == [want[texts.index(t)] for t in batch]


@pytest.mark.parametrize("name", ["form_elements", "form_items", "form_details", "form_extraction", "form_rejoin"])
def test_form_queries_write_nothing_and_join_no_nodes(spark, tmp_path, name):
    """Nodes were written, exploded by their ancestors and joined again and again: time and disk grew by each join."""
    rows = spark.range(50).selectExpr("id + 1 as c_custkey", "'BUILDING' as c_mktsegment", "1.0D as c_acctbal")
    rows.coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    made = plan(forms.QUERIES[name](spark, str(tmp_path)))
    scans = [line for line in made.splitlines() if "FileScan" in line]
    assert scans and len(scans) <= 3 and all("c_custkey" in line for line in scans)
    assert not any("node_id" in line.split("Join")[1] for line in made.splitlines() if "Join" in line)


def test_rows_out_of_order_are_an_error(spark):
    nodes = spark.createDataFrame([(1, 1, 1, 0, None), (1, 0, 1, 1, 0)], "page_id long, node_id int, last_id int, mark int, element_id long").coalesce(1)
    with pytest.raises(Exception, match="not in document order"):
        nodes.select(tree.enclosing(F.col("mark"), F.col("element_id"))).collect()


def test_nested_owners_options_and_inherited_visibility(spark):
    text = "<div onclick='a'>x <button>b</button> y</div><select><option value='1'>A<option selected>B</select><div style='visibility:hidden'><b>no</b><i style='visibility:visible'>yes</i></div><p style='opacity:0'>faint <u>not</u></p>"
    nodes = html.nodes(spark.createDataFrame([(1, text), (2, None)], "page_id long, html string"))
    assert [(r.element_id, r.text, r.value) for r in page.elements(nodes).orderBy("element_id").collect()] == [(0, "x b y", None), (1, "b", None), (2, "B", "B")]
    assert [(r.text, r.element_id) for r in page.runs_of(nodes).orderBy("node_id").collect()] == [("x", 0), ("b", 1), ("y", 0), ("A", 2), ("B", 2), ("yes", None), ("not", None)]
