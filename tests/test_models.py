"""Ingest, nets, exploration and structural scores on small models; one test a semantic trap (Q..)."""

import pytest

from procsim.models import KNOWN, Models
from procsim.operators import explore, items, normalize, petri, rollup, viewer
from procsim.plans import samples
from procsim.plans.samples import END, START, process
from procsim.sources import adapters
from procsim.sources.load import load_texts, to_json


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


SUB = (
    '<subProcess id="u" name="Body"><task id="x" name="Enter"/><task id="y" name="Middle"/><task id="z" name="Exit"/>'
    '<sequenceFlow id="i1" sourceRef="x" targetRef="y"/><sequenceFlow id="i2" sourceRef="y" targetRef="z"/>{more}</subProcess>'
    '<sequenceFlow id="o1" sourceRef="s" targetRef="u"/><sequenceFlow id="o2" sourceRef="u" targetRef="e"/>'
)
POOLS = (
    f'{samples.HEAD}<collaboration id="k"><participant id="P" processRef="one"/><participant id="Q" processRef="two"/>'
    '<messageFlow id="m" sourceRef="a" targetRef="b"/><messageFlow id="n" sourceRef="P" targetRef="b"/></collaboration>'
    '<process id="one"><startEvent id="s" name="Go"/><task id="a" name="Send"/><sequenceFlow id="f" sourceRef="s" targetRef="a"/></process>'
    '<process id="two"><task id="b" name="Get"/><endEvent id="e" name="End"/><sequenceFlow id="g" sourceRef="b" targetRef="e"/></process></definitions>'
)
TRAPS = {
    "q3.bpmn": process(START, END, flows="", extra=SUB.format(more="")),
    "q4.bpmn": process(START, END, flows="", extra=SUB.format(more='<task id="w" name="Other"/><sequenceFlow id="i3" sourceRef="y" targetRef="w"/>')),
    "q6.bpmn": POOLS,
    "q7.bpmn": process(START, "startEvent:r:Other", "task:a:A", "exclusiveGateway:g", END, flows="s>a a>g r>g g>e"),
    "q10.bpmn": process(START, "task:a:A", "task:b:Loose", END, flows="s>a a>e b>e"),
    "q17.bpmn": process(START, flows="", extra='<subProcess id="o"><subProcess id="i"><task id="t" name="Deep"/></subProcess><task id="v" name="Flat"/></subProcess>'),
    "q19.bpmn": process(START, END, flows="", extra='<subProcess id="o" name="O"><subProcess id="i" name="I"><task id="t" name="T"/><task id="v" name="V"/><sequenceFlow id="j" sourceRef="t" targetRef="v"/></subProcess>'
                        '<task id="w" name="W"/><sequenceFlow id="k" sourceRef="i" targetRef="w"/></subProcess><sequenceFlow id="l" sourceRef="s" targetRef="o"/><sequenceFlow id="m" sourceRef="o" targetRef="e"/>'),
    "q1.bpmn": process(START, "eventBasedGateway:g", "task:a:A", END, flows="s>g g>a a>e"),
    "q2.bpmn": process("startEvent:s", "task:a:A", "endEvent:e", flows="s>a a>e"),
    "q5.bpmn": process("startEvent:s:One", "startEvent:z:Two", "task:a:A", END, flows="s>a z>a a>e"),
    "q8.bpmn": process(START, "task:a:A", "task:b:B", "inclusiveGateway:g", END, flows="s>a s>b a>g b>g g>e"),
    "q12.bpmn": process(flows=""),
    "q14.bpmn": process(START, "task:a:A", "boundaryEvent:x:Late", "task:b:B", END, flows="s>a a>e x>b b>e"),
    "dead.bpmn": process(START, "exclusiveGateway:g", "task:a:Good", "task:b:Bad", END, flows="s>g g>a g>b a>e"),
}


@pytest.fixture(scope="module")
def loaded(spark):
    return load_texts(spark, samples.DOCUMENTS | TRAPS)


@pytest.fixture(scope="module")
def found(loaded):
    got = explore.extract_traces(loaded.models, ids=loaded.ids)
    variants = {}
    for r in got.variants.collect():
        variants.setdefault(r["model_id"], set()).add(tuple(r["trace"]))
    partials = {}
    for r in got.partials.collect():
        partials.setdefault(r["model_id"], set()).add(tuple(r["trace"]))
    return variants, partials, {r["model_id"]: r for r in got.diagnostics.collect()}


def test_broken_documents_are_reported_alone(spark):
    got = load_texts(spark, {"bad.bpmn": "<definitions", "bad.json": "{", "empty.bpmn": samples.DOCUMENTS["empty.bpmn"]})
    assert [r["model_id"] for r in got.errors.orderBy("model_id").collect()] == ["bad.bpmn", "bad.json"]
    assert rows(got.models.node, "model_id", "id") == [("empty.bpmn", "e"), ("empty.bpmn", "s")]


def test_crossing_flows(spark):
    text = samples.EDITOR.replace('"target": {"resourceId": "u"}', '"target": {"resourceId": "ut"}')
    assert rows(load_texts(spark, {"x.json": text}).crossings, "id") == [("f3",)]
    with pytest.raises(Exception, match="crosses"):
        load_texts(spark, {"x.json": text}, strict=True).models.flow.collect()


def test_q1_event_based_gateway_counts_as_event(found):
    assert found[0]["q1.bpmn"] == {("Begin", "Eventbased", "A", "Done")}


def test_q2_unnamed_events_show_their_type(found):
    assert found[0]["q2.bpmn"] == {("StartNoneEvent", "A", "EndNoneEvent")}


def test_q3_boundary_tasks_show_their_ids(found):
    assert found[0]["q3.bpmn"] == {("Begin", "x", "Middle", "z", "Done")}


def test_q4_body_with_two_ends_is_a_part_of_its_own(found):
    """The subprocess stays one step, and its flows make variants of their own."""
    assert ("Begin", "Body", "Done") in found[0]["q4.bpmn"]
    assert any("Middle" in t for t in found[0]["q4.bpmn"] | found[1].get("q4.bpmn", set()))


def test_q6_message_flows_are_arcs_and_pools_are_none(found, loaded):
    assert found[0]["q6.bpmn"] == {("Go", "Send", "Get", "End")}
    arcs = petri.compile_nets(loaded.models).arc.filter("model_id = 'q6.bpmn'")
    assert not [r for r in arcs.collect() if "P" in r["src"].replace("p:", "") and r["src"].startswith("P")]


def test_q7_choice_after_event_and_task_waits_for_both(found, loaded):
    """The event's place and the task's place both lead to the gateway, so that neither alone can pass."""
    arcs = petri.compile_nets(loaded.models).arc.filter("model_id = 'q7.bpmn' and dst = 'g'")
    assert {r["src"] for r in arcs.collect()} == {"gin:g", "pout:r"}
    assert not found[0].get("q7.bpmn")


def test_q10_task_without_incoming_flow_is_always_ready(found):
    assert found[2]["q10.bpmn"]["loop_hits"] > 0
    assert any(t.count("Loose") == 2 for t in found[1]["q10.bpmn"])


def test_q15_lanes_hold_subprocess_content_in_editor_files_only(loaded):
    members = set(rows(loaded.models.lane_member, "model_id", "ref_id"))
    assert ("editor.json", "ut") in members and ("claim.bpmn", "ut") not in members


def test_q16_parent_is_an_id_or_a_name(loaded):
    parents = {(m, p) for m, p in rows(loaded.models.node.filter("parent_subprocess is not null"), "model_id", "parent_subprocess")}
    assert ("editor.json", "u") in parents and ("q3.bpmn", "Body") in parents


def test_q17_unnamed_subprocesses_are_numbered_from_inside(loaded):
    got = items.extract_items(loaded.models).filter("model_id = 'q17.bpmn' and key = 'subprocess_elemrefs'")
    assert ("__sp0|Deep",) in rows(got, "item") and ("__sp1|Flat",) in rows(got, "item")


def test_q18_two_empty_sides(spark):
    from procsim.operators import traces

    nothing = spark.createDataFrame([], "model_id string, trace array<string>")
    pairs = spark.createDataFrame([("a", "b")], "model_a string, model_b string")
    assert traces.trace_similarity(nothing, pairs).first()["score"] is None
    assert [traces.ngram_similarity(nothing, pairs, 2, m).first()["score"] for m in ("jaccard", "precision")] == [1.0, 0.0]


def test_q19_inlining_is_one_hop(loaded):
    """The outer body's entry is itself inlined: its flow ends at a node that is led on one step only."""
    arcs = {(r["src"], r["dst"]) for r in petri.compile_nets(loaded.models).arc.filter("model_id = 'q19.bpmn'").collect()}
    ends = {x for a in arcs for x in a}
    assert "i" in ends and "o" not in ends


def test_q5_several_starts_are_alternatives(found):
    assert found[0]["q5.bpmn"] == {("One", "A", "Done"), ("Two", "A", "Done")}


def test_q8_event_with_several_flows_is_a_choice(found):
    assert found[0]["q8.bpmn"] == {("Begin", "A", "Done"), ("Begin", "B", "Done")}


def test_q9_loop_is_not_sound(found):
    row = found[2]["loop.bpmn"]
    assert row["status"] == "unsound_recovered" and row["loop_hits"] > 0 and found[1]["loop.bpmn"]


def test_q12_empty_model(found):
    assert found[0]["q12.bpmn"] == {()} and found[2]["q12.bpmn"]["status"] == "unsound_recovered"


def test_q14_boundary_event_is_another_source(found):
    assert found[0]["q14.bpmn"] == {("Begin", "A", "Done"), ("Late", "B", "Done")}


def test_dead_end(found):
    assert ("Begin", "Good", "Done") in found[0]["dead.bpmn"]


def test_parallel_join(found):
    assert found[0]["both.bpmn"] == {("Begin", "Pick", "Pack", "Done"), ("Begin", "Pack", "Pick", "Done")}
    assert found[2]["both.bpmn"]["status"] == "sound"
    assert found[2]["nojoin.bpmn"]["status"] == "unsound_no_variants" and len(found[1]["nojoin.bpmn"]) == 4


def simple_net(arcs, labels, end):
    places = sorted({x for a in arcs for x in a if x.startswith("p")} | {end})
    return explore.Net.of(places, [(t, labels.get(t)) for t in sorted({x for a in arcs for x in a if x.startswith("t")})], [(*a, 1) for a in arcs], [("initial", "p0", 1), ("final", end, 1)])


def test_hand_built_nets():
    both = simple_net([("p0", "ta"), ("ta", "p1"), ("ta", "p2"), ("p1", "tb"), ("tb", "p3"), ("p2", "tc"), ("tc", "p4"), ("p3", "td"), ("p4", "td"), ("td", "p5")], {"tb": "Heat", "tc": "Stir", "td": "Serve"}, "p5")
    assert explore.explore(both, 3, 1000).variants == {("Heat", "Stir", "Serve"), ("Stir", "Heat", "Serve")}
    lift = simple_net([("p0", "tu"), ("tu", "p1"), ("p1", "td"), ("td", "p0"), ("p1", "tx"), ("tx", "p2")], {"tu": "Up", "td": "Down", "tx": "Out"}, "p2")
    got = explore.explore(lift, 2, 1000)
    assert got.variants == {("Up", "Out"), ("Up", "Down", "Up", "Out")} and got.partials == {("Up", "Down", "Up", "Down")} and got.loops == {"tu": 1}
    fork = simple_net([("p0", "ta"), ("ta", "p1"), ("p1", "tb"), ("tb", "p2"), ("p1", "tc"), ("tc", "p3"), ("p3", "td"), ("td", "p4")], {"ta": "Ask", "tb": "Yes", "tc": "No", "td": "Leave"}, "p2")
    got = explore.explore(fork, 3, 1000)
    assert (got.variants, got.partials, list(got.deadlocks.values())) == ({("Ask", "Yes")}, {("Ask", "No", "Leave")}, [("Ask", "No", "Leave")])
    assert explore.explore(fork, 3, 2).stopped and not explore.explore(fork, 3, 100).stopped
    assert explore.explore(both, 3, 1000, cap=1).capped


def test_random_nets_against_recursion():
    import random

    def walk(net, marking, trace, depth, out):
        if marking == net.end:
            out.add(trace)
            return
        for i in net.enabled(marking) if depth else ():
            label = net.transitions[i][1]
            walk(net, net.fire(marking, i), trace + ((label,) if label else ()), depth - 1, out)

    for seed in range(30):
        draw = random.Random(seed)
        n = draw.randint(3, 6)
        arcs = [a for i, t in enumerate(range(draw.randint(2, 6))) for lo in [draw.randint(0, n - 2)] for a in ((f"p{lo}", f"t{i}"), (f"t{i}", f"p{draw.randint(lo + 1, n - 1)}"))]
        arcs += [("p0", "tx"), ("tx", f"p{n - 1}")]
        net, out = simple_net(arcs, {f"t{i}": draw.choice(["A", "B", None]) for i in range(6)}, f"p{n - 1}"), set()
        walk(net, net.start, (), 12, out)
        assert explore.explore(net, 20, 100_000).variants == out


def test_known_similarities(spark, loaded):
    pairs = spark.createDataFrame([("empty.bpmn", "line.bpmn"), ("line.bpmn", "renamed.bpmn"), ("nojoin.bpmn", "both.bpmn"), ("claim.bpmn", "claim.bpmn")], "model_a string, model_b string")
    got = {r["model_b"]: r for r in rollup.structural_similarity(items.extract_items(loaded.models), pairs).collect()}
    assert got["renamed.bpmn"]["overall"] == pytest.approx(0.28125)
    assert got["both.bpmn"]["overall"] == pytest.approx(0.674242, abs=1e-6)
    assert got["claim.bpmn"]["overall"] == pytest.approx(1.0) and got["claim.bpmn"]["weight_subprocess"] == 0.05


def test_empty_models_have_no_score(spark):
    nothing = items.extract_items(Models.of_rows(spark))
    pairs = spark.createDataFrame([("a", "b")], "model_a string, model_b string")
    row = rollup.structural_similarity(nothing, pairs).first()
    assert row["overall"] is None and row["high_elements"] is None and row["activity_names"] == 1.0


def test_q13_unnamed_items_match(spark):
    nodes = [(m, "gateway", "g", "", "Exclusive", None, False, 1) for m in "ab"]
    got = rollup.fine_scores(items.extract_items(Models.of_rows(spark, node=nodes)), spark.createDataFrame([("a", "b")], "model_a string, model_b string"))
    row = got.filter("key = 'gateway_names'").first()
    assert row["score"] == 1.0 and row["present"]


def test_index_items(spark):
    given = spark.createDataFrame([("m", "k", x) for x in ("Ship", "", "Bill", "Ship", "", "Ship")], "model_id string, key string, item string")
    assert [r["indexed"] for r in items.index_items(given).orderBy("indexed").collect()] == ["1", "2", "Bill1", "Ship1", "Ship2", "Ship3"]


def test_greedy_ties(spark):
    given = [("x", 0.9, "b2", "a1"), ("x", 0.9, "b1", "a1"), ("x", 0.8, "b1", "a1"), ("x", 0.7, "b1", "a2")]
    got = normalize.greedy_mapping(spark.createDataFrame(given, "scope string, score double, name2 string, name1 string"), ["scope"])
    assert rows(got, "name2", "name1") == [("b1", "a2"), ("b2", "a1")]


def test_normalized_models_match(spark, loaded):
    pairs = spark.createDataFrame([("line.bpmn", "renamed.bpmn")], "model_a string, model_b string")
    words = {"Gather": "Pick", "Wrap": "Pack", "Send off": "Ship"}
    mapping = spark.createDataFrame([("line.bpmn", "renamed.bpmn", "activity", b, a, 1.0) for b, a in words.items()], "model_a string, model_b string, scope string, name2 string, name1 string, score double")
    renamed = normalize.rename(loaded.models, pairs, mapping)
    both = items.extract_items(loaded.models).unionByName(items.extract_items(renamed))
    wanted = spark.createDataFrame([("line.bpmn", "line.bpmn|renamed.bpmn")], "model_a string, model_b string")
    assert rollup.structural_similarity(both, wanted).first()["overall"] == pytest.approx(1.0)


def test_findings(spark):
    nodes = [("n", "activity", "a", "A", "Task", None, False, 1), ("n", "event", "s", "S", "StartNoneEvent", None, False, 2)]
    nets = petri.compile_nets(Models.of_rows(spark, node=nodes))
    issues = {r["issue"] for r in petri.findings(nets).collect()}
    assert {"isolated_node", "dead_transition_no_preset"} <= issues


def test_documents_and_viewer(spark, loaded):
    text = {r["model_id"]: r["document"] for r in to_json(loaded.models).collect()}
    assert '"elemRefs":["ue","us","ut"]' in text["claim.bpmn"]
    page = spark.range(1).select(viewer.viewer_html(viewer.F.lit("<x>`</script>"))).first()[0]
    assert "`" not in page and page.count("</script>") == 2


def test_known_values_are_those_looked_up(spark):
    """The nations' tables say what ids count as; looked up by id the items are the same, and renamed models say nothing of it."""
    known = adapters.nation_models(spark, "/root/testdata/sf0.001")
    plain = known.map(lambda name, table: table.drop(*KNOWN.get(name, ())))
    one, two = (items.item_counts(items.extract_items(models)) for models in (known, plain))
    assert one.exceptAll(two).count() == two.exceptAll(one).count() == 0
    mapping = spark.createDataFrame([], "model_a string, model_b string, scope string, name2 string, name1 string")
    renamed = normalize.rename(known, spark.createDataFrame([("1", "2")], "model_a string, model_b string"), mapping)
    assert not any(set(KNOWN[name]) & set(getattr(renamed, name).columns) for name in KNOWN)


@pytest.mark.parametrize("by_lookup", [True, False])
def test_items_of_known_values_take_no_lookup(spark, by_lookup, monkeypatch):
    """With all values known no table of ids is written; each line of an order is dealt out twice, however many tables are read."""
    made, write = [], items.staged
    monkeypatch.setattr(items, "staged", lambda df, name: made.append(name) or write(df, name))
    models = adapters.nation_models(spark, "/root/testdata/sf0.001")
    models = models.map(lambda name, table: table.drop(*KNOWN.get(name, ()))) if by_lookup else models
    plan = items.extract_items(models)._jdf.queryExecution().executedPlan().toString()
    assert made == ["values"] * by_lookup and "lineitem.parquet" not in plan
