"""Worked examples of the tag parsers and of QA normalisation."""

import json

import pytest
from pyspark.sql import functions as F

from topoframe.functions import qa
from topoframe.functions import text as X
from topoframe.operators import parsing


def texts(spark, *rows):
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "sample_id int, text string")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text, ids, box, status",
    [
        ('<NODES><NODE id="n1" name="A" box="[1,2,3,4]"/>', ["n1"], [1, 2, 3, 4], None),
        ('<NODE id="n2" name="A"/>', ["n2"], [], "recovered_missing_nodes_tag"),
        ("hello", [], None, "missing_nodes_tag"),
        ('<NODES><NODE id="n1" name="A" box="[0,0,1,1]"/><NODE id="n1" name="B"/></NODES>', ["n1"], [0, 0, 1, 1], None),
        ('<NODES><NODE id="n1" name="A/B"/></NODES>', [], None, "missing_nodes_tag"),
        ('<NODES><NODE id="n1" name="A" box="[1,2,3]"/></NODES>', ["n1"], [], None),
    ],
)
def test_nodes(spark, text, ids, box, status):
    t = texts(spark, text)
    rows = parsing.nodes(t).orderBy("pos").collect()
    assert [r.id for r in rows] == ids
    if ids:
        assert rows[0].box == box
    assert parsing.node_status(t).first().status == status


def trace(target, points="[[1,2],[3,4],[5,6],[7,8],[9,9]]"):
    return f'<TRACE target="{target}" points="{points}"/>'


@pytest.mark.parametrize(
    "body, want",
    [
        (trace("n2") + '<EDGE target="n2" type="x"/><EDGE target="n2" type="y"/>', [("n5", "n2", "x", True), ("n5", "n2", "y", False)]),
        (trace("n3") + '<EDGE target="n2" type="x"/>', [("n5", "n2", "x", False)]),
        (trace("n2") + '<EDGE target="n2"/><EDGE target="n2" type="x"/>', [("n5", "n2", "x", False)]),
        ('<EDGE source="n7" target="n2" type="x"/>', [("n7", "n2", "x", False)]),
        ('<NO_EDGE source="n1" target="n2" reason="near_miss"/>', []),
    ],
)
def test_edges(spark, body, want):
    t = texts(spark, f'<EDGE_GRAPH>\n<CHECK_NODE id="n5" name="N">{body}</CHECK_NODE>')
    rows = parsing.edges(t).orderBy("pos").collect()
    assert [(r.source, r.target, r.type, r.trace is not None) for r in rows] == want
    assert parsing.edge_info(t).first().format_error == "missing_edge_graph_close"


def test_edge_diagnostics(spark):
    t = texts(spark, "none", f'<EDGE_GRAPH><CHECK_NODE id="a">{trace("b", "[[1,2],[3,4],[5,6],[7,8]]")}<EDGE target="b" type="t"/></CHECK_NODE></EDGE_GRAPH>')
    info = {r.sample_id: r for r in parsing.edge_info(t).collect()}
    assert info[0].format_error == "missing_edge_graph" and info[1].format_error is None
    assert (info[1].num_trace_tags, info[1].num_check_nodes) == (1, 1)
    assert parsing.edges(t).first().trace.points_valid is False


def test_points_flavours(spark):
    three = F.lit("[[1,2,3],[1,2,3],[1,2,3],[1,2,3],[1,2,3]]")
    assert one(spark, X.parse_points(three)) is None
    assert one(spark, X.parse_points(three, exact=False)) == [[1.0, 2.0]] * 5
    assert one(spark, X.parse_points(F.lit("[[1,2],[1,2],[1,2],[1,2],[1,NaN]]"), exact=False)) is None
    assert one(spark, X.parse_points(F.lit("oops"))) is None


def test_attributes_and_names(spark):
    assert one(spark, X.parse_attrs(F.lit('a="1" é="2" a="3"'))) == {"a": "3", "é": "2"}
    assert one(spark, X.parse_box(F.lit('["1",2,3,4]'))) == [1, 2, 3, 4]
    assert one(spark, X.parse_box(F.lit("[1,2,3,4] x"))) == [] == one(spark, X.parse_box(F.lit(None).cast("string")))
    assert one(spark, X.normalize_name(F.lit("İB! 2"))) == "ib2" and one(spark, X.normalize_name(F.lit(None).cast("string"))) == ""
    assert one(spark, X.label_slug(F.lit(" BEAR "))) == "black_bear" and one(spark, X.slugify(F.lit("--A  b--"))) == "a_b"
    assert one(spark, X.truncate_at(F.lit("ab</E>cd"), "</E>", "zz")) == "ab</E>" and one(spark, X.truncate_at(F.lit("ab"), "x")) == "ab"
    assert one(spark, X.sample_stem(F.lit("s1_edge_trace5_typed_g"))) == "s1" and one(spark, X.variant_number(F.lit("a_07.png"))) == 7
    assert one(spark, X.module_family(F.lit("model.visual.merger.fc"))) == "bridge" and one(spark, X.module_family(F.lit("lm_head"))) == "blocked"
    assert X.parse_counts("train:simple=1,medium=2;test:simple=3") == {"train": {"simple": 1, "medium": 2}, "test": {"simple": 3}}
    assert X.simple_yaml("a:\n  b: 'x' # c\nd: 2\n") == {"a": {"b": "x"}, "d": "2"}


CHECKS = dict.fromkeys(qa.CHECKS, "pass")
FAILED = CHECKS | {qa.CHECKS[0]: "FAIL"}


@pytest.mark.parametrize(
    "obj, overall, score, reasons, warnings",
    [
        ({"overall": "pass", "checks": CHECKS, "quality_score": 4, "failure_reasons": []}, "PASS", 4, [], []),
        ({"overall": "PASS", "checks": FAILED, "quality_score": 4, "failure_reasons": ["x"]}, "FAIL", 2, ["x"], ["overall_pass_but_check_failed", "overall_fail_but_high_score"]),
        ({"overall": "PASS", "checks": CHECKS, "quality_score": 2, "failure_reasons": []}, "FAIL", 2, [], ["overall_pass_but_low_score"]),
        ({}, "FAIL", 2, [], [f"invalid_check:{n}" for n in qa.CHECKS] + ["invalid_overall", "invalid_quality_score", "missing_failure_reasons"]),
        ({"checks": CHECKS, "quality_score": "5"}, "PASS", 5, [], ["invalid_overall"]),
        ({"overall": "PASS", "checks": CHECKS, "quality_score": 9, "failure_reasons": []}, "PASS", 5, [], []),
        ({"overall": "PASS", "checks": CHECKS, "quality_score": 3, "failure_reasons": ["y"]}, "PASS", 3, [], ["pass_with_failure_reasons"]),
        ({"overall": "FAIL", "checks": FAILED, "quality_score": 0, "failure_reasons": ["z"]}, "FAIL", 1, ["z"], []),
        ({"overall": "PASS", "checks": CHECKS, "quality_score": "3.7", "failure_reasons": []}, "PASS", 3, [], ["invalid_quality_score"]),
        ({"overall": "PASS", "checks": CHECKS, "quality_score": 3.7, "failure_reasons": []}, "PASS", 3, [], []),
    ],
)
def test_qa(spark, obj, overall, score, reasons, warnings):
    row = qa.qa_records(texts(spark, f"so: {json.dumps(obj)} and {{}}")).first()
    r = row.result
    assert (row.status, r.overall, r.quality_score, r.failure_reasons, r.warnings) == ("OK", overall, score, reasons, warnings)


def test_json_in_text():
    assert qa.first_json_object('x {"a": "}\\""} y') == ('{"a": "}\\""}', None)
    assert qa.first_json_object("none")[1] == "missing_json_object" and qa.first_json_object('{"a": 1')[1] == "truncated_json_object"
    assert qa.first_json_object("{a}")[1].startswith("json_decode_error:") and qa.first_json_object(None)[1] == "missing_json_object"
