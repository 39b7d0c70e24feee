"""Worked examples of matching, scoring, geometry, curation, sources and streaming."""

import random

import pytest
from pyspark.sql import functions as F

from topoframe.functions import geometry as G
from topoframe.operators import curation, generate, graph, matching, parsing, reports, scoring, sft, validation
from topoframe.sources import files
from topoframe.streaming import monitor


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def nodes(spark, *rows):
    return spark.createDataFrame([(0, i, *r) for i, r in enumerate(rows)], "sample_id int, pos int, id string, name string, box array<double>")


def matched(pred, gold, **how):
    return {r.pred_id: r.gold_id for r in matching.match_nodes(pred, gold, **how).collect()}


def test_matching_examples(spark):
    box = lambda *v: [float(x) for x in v]
    assert matched(nodes(spark, ("n10", "X", []), ("n2", "X", [])), nodes(spark, ("n1", "X", []), ("n3", "X", []))) == {"n2": "n1", "n10": "n3"}
    assert matched(nodes(spark, ("n10", "X", []), ("n2", "X", [])), nodes(spark, ("n1", "X", []), ("n3", "X", [])), rank_boxless=False) == {"n10": "n1", "n2": "n3"}
    a, b = box(0, 0, 10, 10), box(100, 100, 110, 110)
    assert matched(nodes(spark, ("n1", "x", a), ("n2", "x", b)), nodes(spark, ("n1", "X", b), ("n2", "X", a))) == {"n1": "n2", "n2": "n1"}
    pred = nodes(spark, ("n1", "x", box(0, 0, 10, 9.5)), ("n2", "x", a))
    assert matched(pred, nodes(spark, ("A", "x", a), ("B", "x", box(0, 0, 10, 9)))) == {"n1": "A", "n2": "B"}
    assert matched(nodes(spark, ("n1", "x", box(0, 0, 1, 1))), nodes(spark, ("n7", "X", box(50, 50, 60, 60)))) == {"n1": "n7"}
    three = nodes(spark, ("n1", "X", a), ("n2", "X", a), ("n3", "X", a))
    assert set(matched(three, nodes(spark, ("g1", "X", a), ("g2", "X", b)))) == {"n1", "n2"}


def iou(a, b):
    i = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
    u = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - i
    return i / u if u > 0 else 0.0


def test_greedy_matching_against_a_loop(spark):
    r = random.Random(5)
    make = lambda n: [(f"n{i}", r.choice("AB"), [float(x), float(y), x + 4.0, y + 4.0]) for i in range(n) for x, y in [(r.randint(0, 6), r.randint(0, 6))]]
    for _ in range(6):
        pred, gold = make(7), make(6)
        want, used = {}, set()
        for i, name, box in pred:
            free = [(-iou(box, b), k, g) for k, (g, n, b) in enumerate(gold) if n == name and g not in used]
            if free:
                want[i] = min(free)[2]
                used.add(want[i])
        assert matched(nodes(spark, *pred), nodes(spark, *gold)) == want


def edges(spark, *rows):
    return spark.createDataFrame([(0, *r) for r in rows], "sample_id int, source string, target string, type string")


def test_score_one_sample(spark):
    gold = edges(spark, ("n1", "n2", "x"), ("n1", "n2", "y"), ("n2", "n3", "x"))
    pred = matching.remap_edges(edges(spark, ("n1", "n2", "x"), ("n1", "n2", "x"), ("n2", "n4", "x")), spark.createDataFrame([(0, "n1", "n1"), (0, "n2", "n2")], "sample_id int, pred_id string, gold_id string"))
    assert "UNMATCHED:n4" in [r.target for r in pred.collect()]
    name = lambda *xs: spark.createDataFrame([(0, x) for x in xs], "sample_id int, name string")
    samples = spark.createDataFrame([(0,), (9,)], "sample_id int")
    mapping = spark.createDataFrame([(0, "n1"), (0, "n2")], "sample_id int, pred_id string")
    rows = {r.sample_id: r for r in scoring.sample_scores(name("a", "b", "d"), name("a", "b", "c"), mapping, pred, gold, samples).collect()}
    s = rows[0]
    assert (s.node_tp, s.node_pred, s.node_gt, s.node_mapped, s.node_count_exact) == (2, 3, 3, 2, 1)
    assert (s.endpoint_tp, s.endpoint_pred, s.endpoint_gt, s.typed_tp, s.typed_pred, s.typed_gt) == (2, 3, 3, 1, 3, 3)
    assert (s.pair_exact, s.pair_total, s.sample_multigraph_exact) == (0, 3, 0)
    assert (rows[9].typed_gt, rows[9].sample_multigraph_exact) == (0, 1)
    own = scoring.overlap(gold, gold, ["sample_id"], ["source", "target", "type"]).first()
    assert own.exact and own.tp == own.gt
    total = reports.with_rates(scoring.sample_scores(name("a"), name("a"), mapping, gold, gold, samples).agg(*reports.score_sums())).first()
    assert (total.typed_f1, total.pair_exact_rate, total.image_exact_rate) == (1.0, 1.0, 1.0)


def test_cube_keeps_null_groups_apart(spark):
    df = spark.createDataFrame([("a", None, 1), (None, "s", 2)], "domain string, difficulty string, v int")
    rows = {(r.report, r.domain, r.difficulty): r.v for r in reports.cube_report(df, [F.sum("v").alias("v")]).collect()}
    assert rows[("summary", None, None)] == 3 and rows[("by_domain", "None", None)] == 2 and rows[("by_difficulty", None, "None")] == 1


def test_geometry(spark):
    arr = lambda *v: F.array(*(F.lit(float(x)) for x in v))
    path = lambda *ps: F.array(*(arr(*p) for p in ps))
    box = arr(0, 0, 10, 10)
    assert one(spark, G.box_iou(box, arr(5, 5, 15, 15))) == pytest.approx(1 / 7)
    assert one(spark, G.point_box_distance(arr(15, 15), box)) == pytest.approx(50**0.5) and one(spark, G.point_box_distance(arr(5, 5), box)) == 0
    assert one(spark, G.point_box_distance(arr(5, 5), arr(0, 0, 1))) == float("inf")
    gold, shifted = path(*((10 * i, 0) for i in range(5))), path(*((10 * i + 3, 4) for i in range(5)))
    assert one(spark, G.aligned_l2(shifted, gold)) == 5 and one(spark, G.chamfer(shifted, gold)) == 5
    assert one(spark, G.aligned_l2(F.reverse(gold), gold)) == 24 and one(spark, G.chamfer(F.reverse(gold), gold)) == 0
    assert one(spark, G.box_center(arr(-3, -3, 0, 0))) == [-2, -2] and one(spark, G.scale(arr(2.5, 3.5), 1.0)) == [2, 4]
    assert one(spark, G.boundary_point(box, arr(20, 5))) == [10, 5] and one(spark, G.boundary_point(box, arr(5, 5))) == [5, 5]
    assert one(spark, G.path_length(path((0, 0), (3, 4), (3, 5)))) == 6 and one(spark, G.midpoint(path((0, 0), (1, 1), (2, 2)))) == [1, 1]
    assert one(spark, G.nearest_side(arr(1, 5), box)) == "left" and one(spark, G.side_between(box, arr(50, 0, 60, 10))) == "right"
    assert one(spark, G.side_anchor(box, F.lit("bottom"))) == [5, 10]
    assert one(spark, G.segments_cross(arr(0, 0), arr(4, 4), arr(0, 4), arr(4, 0))) and not one(spark, G.segments_cross(arr(0, 0), arr(1, 1), arr(2, 2), arr(3, 3)))
    assert one(spark, G.segment_hits_box(arr(-50, 5), arr(50, 5), box)) and not one(spark, G.segment_hits_box(arr(-50, 50), arr(50, 50), box))
    assert one(spark, G.path_blocks(path((-50, 5), (50, 5), (50, 90)), F.array(box))) == 1
    assert one(spark, G.best_detour(F.array(path((-50, 5), (50, 5)), path((-50, 90), (50, 90))), F.array(box))) == [[-50, 90], [50, 90]]
    assert one(spark, G.point_segment_distance(arr(0, 3), arr(0, 0), arr(10, 0))) == 3
    assert one(spark, G.visible_path(path((0, 0), (100, 0)), 12)) == [[12, 0], [88, 0]]
    assert one(spark, G.arrowhead(path((0, 0), (100, 0))))[0] == [100, 0]
    assert one(spark, G.boxes_overlap(box, arr(18, 0, 20, 5))) and not one(spark, G.boxes_overlap(box, arr(19, 0, 20, 5)))  # a gap of the margin overlaps


def test_split_shares_round_half_to_even(spark):
    for n, want in ((5, 0), (15, 2), (25, 2), (35, 4)):
        got = curation.stratified_split(spark.range(n).withColumn("g", F.lit(1)), ["g"], curation.hash_order("id"), "id")
        assert got.filter("split = 'test'").count() == want


@pytest.mark.parametrize("pool, target, want", [((1440, 3015, 945), 3000, (800, 1675, 525)), ((160, 335, 105), 200, (53, 112, 35)), ((540, 2700, 2160), 3000, (300, 1500, 1200)), ((1, 1, 1), 1, (1, 0, 0))])
def test_quotas(spark, pool, target, want):
    rows = [("d", k, n, target) for k, n in zip(("simple", "medium", "difficult"), pool, strict=True)]
    got = curation.quotas(spark.createDataFrame(rows, "g string, difficulty string, n long, target long"), ["g"], "difficulty", "n", "target")
    assert {r.difficulty: r.quota for r in got.collect()} == dict(zip(("simple", "medium", "difficult"), want, strict=True))


@pytest.mark.parametrize("verdicts, target, reviewed, selected, remaining, complete", [("PFPPFP", 3, 4, 3, 0, True), ("FFP", 2, 3, 1, 1, False)])
def test_screening(spark, verdicts, target, reviewed, selected, remaining, complete):
    rows = spark.createDataFrame([("g", i, v == "P") for i, v in enumerate(verdicts)], "g string, i int, ok boolean")
    got = curation.screen(rows, ["g"], [F.col("i")], F.col("ok"), F.lit(target))
    p = curation.screening_progress(got, spark.createDataFrame([("g", target)], "g string, target long"), ["g"]).first()
    assert (p.reviewed, p.selected, p.remaining, p.complete) == (reviewed, selected, remaining, complete)


def test_round_robin_and_rebalance(spark):
    rows = spark.createDataFrame([("A", 1), ("A", 2), ("A", 3), ("B", 4)], "g string, id long")
    assert sorted(r.g for r in curation.round_robin(rows, ["g"], F.col("id"), "id", 3).collect()) == ["A", "A", "B"]
    log = spark.createDataFrame([("g", "k1", 1), ("g", "k1", 2), ("g", "k2", 3), ("g", "k3", 4)], "g string, k string, seq int")
    kept = curation.rebalance(log, ["g"], "k", "seq", [F.col("seq")], F.lit(4))
    assert sorted(r.seq for r in kept.collect()) == [2, 3, 4]
    assert curation.shortfalls(kept, spark.createDataFrame([("g", 4)], "g string, target long"), ["g"]).first().shortfall == 1


def test_reading_order(spark):
    rows = spark.createDataFrame([(0, "a", 100, 29, 0), (0, "b", 10, 31, 1), (0, "c", 50, 0, 2), (0, "d", 20, 59, 3)], "g int, id string, x1 int, y1 int, pos int")
    assert {r.id: r.new_id for r in graph.reading_order(rows, "g").collect()} == {"c": "n1", "a": "n2", "b": "n3", "d": "n4"}


def test_serialised_graph_parses_back(spark):
    n = spark.createDataFrame([(0, "n1", "A", [0, 0, 5, 5], 0), (0, "n2", "B", [9, 9, 12, 12], 1)], "sample_id int, id string, name string, box array<int>, num int")
    e = spark.createDataFrame([(0, "n1", "n2", "x", [1, 2], [3, 4], [5, 6], None, 0), (0, "n1", "n2", "x", [1, 2], [3, 4], [5, 6], [7, 8], 1)], "sample_id int, source string, target string, type string, start array<int>, mid array<int>, end array<int>, arrow array<int>, num int")
    text = graph.think_graph(n, e, "sample_id").select("sample_id", F.regexp_replace("think_graph", "THINK_GRAPH", "EDGE_GRAPH").alias("text"))
    assert 'arrow="None"' in text.first().text and 'start="[1, 2]"' in text.first().text
    assert [(r.id, r.name, r.box) for r in parsing.nodes(text).orderBy("pos").collect()] == [("n1", "A", [0, 0, 5, 5]), ("n2", "B", [9, 9, 12, 12])]
    assert [(r.source, r.target, r.type) for r in parsing.edges(text).collect()] == [("n1", "n2", "x")] * 2


def test_chat_and_masks(spark):
    got = one(spark, sft.chat(F.lit("sys"), F.lit("i.png"), F.lit("ask"), F.lit("yes")))
    assert [m.role for m in got] == ["system", "user", "assistant"]
    assert [m.role for m in one(spark, sft.chat(F.lit(""), F.lit("i.png"), F.lit("ask")))] == ["user"]
    assert one(spark, sft.loss_mask(F.array(*map(F.lit, (5, 6, 7, 0))), F.lit(1), 0)) == [-100, 6, 7, -100]
    assert one(spark, sft.chunks(F.array(*map(F.lit, range(7))))) == [[0, 1, 2], [3, 4, 5], [6]]
    n = spark.createDataFrame([(0, i, f"n{i}", "A", [0.5, 1.5, 2.0, 3.0]) for i in range(4)], "g int, pos int, id string, name string, box array<double>")
    prompts = {r.grp: r.prompt for r in sft.edge_prompts(n, "g", ["pos"], "N {nodes} S {sources}").collect()}
    assert set(prompts) == {1, 2} and prompts[2].endswith('S [{"id":"n3","name":"A","box":[0,2,2,3]}]')


def test_validation(spark):
    docs = spark.createDataFrame([("a", '{"x": 1, "z": 2}'), ("b", "[1]")], "path string, json string")
    assert {(r.path, r.rule, r.detail) for r in validation.key_violations(docs, ["x", "y"]).collect()} == {("a", "missing_key", "y"), ("a", "extra_key", "z"), ("b", "not_an_object", "")}
    inventory = spark.createDataFrame([("f", "00"), ("g", "11")], "path string, sha256 string")
    have = spark.createDataFrame([("f", bytearray(b"x"))], "path string, content binary")
    assert {(r.path, r.rule) for r in validation.checksum_violations(inventory, have).collect()} == {("f", "digest_differs"), ("g", "missing_file")}


def test_files(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n{"a": 3}\n')
    path = str(tmp_path / "m.jsonl")
    assert [r.a for r in files.jsonl(spark, path, "a int", max_samples=3).collect()] == [1, 2]
    assert files.jsonl(spark, path, "a int").filter("a is not null").count() == 3
    assert files.jsonl(spark, str(tmp_path / "none"), "a int", missing_ok=True).count() == 0
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "s1.g02.edge_graph.txt").write_text("x\ny")
    (tmp_path / "p" / "s1.nodes.txt").write_text("z")
    got = {(r.stem, r.grp, r.kind, r.text) for r in files.prediction_texts(spark, str(tmp_path / "p")).collect()}
    assert got == {("s1", 2, "edge_graph", "x\ny"), ("s1", None, "nodes", "z")}
    df = spark.createDataFrame([(1, None)], "a int, b string")
    files.write_jsonl(df, str(tmp_path / "out"))
    assert '"b":null' in spark.read.text(str(tmp_path / "out")).first().value
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        files.write_jsonl(df, str(tmp_path / "out"))
    assert files.images(spark, str(tmp_path / "p" / "s1.nodes.txt")).first().data_url.startswith("data:image/png;base64,")


def test_streamed_rate_equals_batch(spark, tmp_path):
    rows = [("k1", "2024-01-01 00:01:00", True), ("k1", "2024-01-01 00:02:00", True), ("k2", "2024-01-01 00:03:00", False), ("k3", "2024-01-01 01:30:00", True)]
    batch = spark.createDataFrame(rows, "k string, t string, ok boolean").withColumn("t", F.to_timestamp("t"))
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = monitor.pass_rate(monitor.deduplicated(stream, "k", "t"), "t", F.col("ok")).writeStream.format("memory").queryName("rates").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.n, r.passed) for r in spark.table("rates").collect()) == [(1, 1), (2, 1)]
    assert sorted((r.n, r.passed) for r in monitor.pass_rate(batch, "t", F.col("ok")).collect()) == [(1, 1), (3, 2)]


def test_generated_cases(spark):
    a = {r.graph: r for r in generate.cases(spark, 60, 5, ["A", "B"]).collect()}
    assert a == {r.graph: r for r in generate.cases(spark, 60, 5, ["A", "B"]).repartition(7).collect()} and len(a) >= 50
    nodes_, edges_ = generate.exploded(generate.cases(spark, 60, 5, ["A", "B"]))
    assert validation.endpoint_violations(nodes_, edges_, "graph").count() == 0


def test_training_text_and_reports(spark, tmp_path):
    df = spark.createDataFrame([("t", '{"nodes": [{"id": "é"}]}')], "t string, j string")
    assert df.select(graph.training_text(F.col("t"), F.col("j")).alias("x")).first().x == 't\n\n<FINAL_GRAPH>\n{\n  "nodes": [\n    {\n      "id": "é"\n    }\n  ]\n}\n</FINAL_GRAPH>'
    files.write_report(df, str(tmp_path / "r"), ["t"])
    assert spark.read.text(str(tmp_path / "r"), wholetext=True).count() == 1
    assert files.task_manifests("f", "node", exists=lambda p: p.endswith("train.jsonl")) == ("f/node/train.jsonl", None)
    with pytest.raises(FileNotFoundError):
        files.task_manifests("f", "node", exists=lambda p: False)


def arr(*v):
    return F.array(*(F.lit(float(x)) for x in v))


def arr2(*points):
    return F.array(*(arr(*p) for p in points))


def test_pixels_of_routes(spark):
    """Worked by hand: floored centres, halves to even, ends trimmed one after the other, a node's own reach."""
    path = lambda *ps: arr2(*ps)
    assert one(spark, G.boundary_point(arr(0, 0, 10, 11), arr(20, 7))) == [10, 6]  # centre (5, 5): 5 + 2 * 5 / 15 = 5.67
    assert one(spark, G.boundary_point(arr(0, 0, 11, 10), arr(5, 5))) == [5, 5] and one(spark, G.boundary_point(arr(0, 0, 4, 4), arr(3, 12))) == [2, 4]
    assert one(spark, G.offset_point(arr(0, 0), arr(10, 10), 12)) == [8, 8] and one(spark, G.offset_point(arr(3, 3), arr(3, 3), 12)) == [3, 3]
    assert one(spark, G.visible_path(path((0, 0), (10, 0)), 12)) == [[12, 0], [22, 0]]  # the trimmed first point lies behind the last
    assert one(spark, G.visible_path(path((5, 5)), 12)) == [[5, 5]]
    assert one(spark, G.arrowhead(path((5, 5)))) == [] and one(spark, G.arrowhead(path((0, 0), (100, 0)))) == [[100, 0], [86, 8], [86, -8]]
    clear = lambda y: one(spark, G.segment_clear(arr(0, 0), arr(100, 0), F.array(arr(40, y - 10, 60, y + 10))))
    assert clear(16) and not clear(15)  # half of 20 and 6
    a, b = one(spark, G.detour_candidates(arr(100, 300), arr(500, 310), F.array(arr(280, 250, 320, 360), arr(900, 0, 950, 700)), 42, 56))
    assert a == [[100, 300], [100, 208], [500, 208], [500, 310]] and b == [[100, 300], [100, 416], [500, 416], [500, 310]]
    a, b = one(spark, G.detour_candidates(arr(60, 100), arr(70, 500), F.array(arr(40, 250, 90, 300)), 42, 56))
    assert a == [[60, 100], [32, 100], [32, 500], [70, 500]] and b == [[60, 100], [146, 100], [146, 500], [70, 500]]
    assert one(spark, G.long_same_lane(arr(0, 0), arr(220, 72))) and not one(spark, G.long_same_lane(arr(0, 0), arr(219, 72))) and one(spark, G.long_same_lane(arr(0, 0), arr(0, 300)))


def test_matching_leaves_nameless_nodes_and_orders_ids(spark):
    kind = "sample_id string, pos long, id string, name string, box array<double>"
    rows = lambda *xs: spark.createDataFrame([("s", i, n, name, []) for i, (n, name) in enumerate(xs)], kind)
    assert matching.match_nodes(rows(("n1", "###")), rows(("n1", "!!"))).count() == 0
    got = matching.match_nodes(rows(("x1", "a"), ("n10", "a"), ("n01", "a"), ("n2", "a")), rows(("n5", "A"), ("g2", "A"), ("g10", "A"), ("n4", "A")))
    assert {(x.pred_id, x.gold_id) for x in got.collect()} == {("n2", "n4"), ("n10", "n5"), ("n01", "g10"), ("x1", "g2")}
    gold = spark.createDataFrame([("s", 0, "n1", "a", [0.0, 0.0, 9.0, 9.0]), ("s", 1, "n1", "a", [50.0, 50.0, 60.0, 60.0])], kind)  # an id twice: two nodes
    pred = spark.createDataFrame([("s", 0, "p1", "a", [0.0, 0.0, 9.0, 9.0]), ("s", 1, "p2", "a", [50.0, 50.0, 60.0, 60.0])], kind)
    assert {(x.pred_id, x.gold_id) for x in matching.match_nodes(pred, gold).collect()} == {("p1", "n1"), ("p2", "n1")}


def test_orders_of_any_id(spark):
    ids = spark.createDataFrame([(x,) for x in (0, 7, 3_470_000_000, 9_223_372_036_854_775_807, -5)], "id long")
    got = [x[0] for x in ids.select(curation.hash_order("id")).collect()]
    assert got == [(x % 2**31) * 2654435761 % 2**32 for x in (0, 7, 3_470_000_000, 9_223_372_036_854_775_807, -5)]
    log = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (1, 4, "c")], "k long, seq long, v string")
    assert {curation.last_by_key(log.repartition(n), ["k"], "seq").first().v for n in (1, 2, 3)} in ({"a"}, {"b"})
