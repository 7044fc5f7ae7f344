"""Files in, reports out: readers, run tables, text comparison, renaming, staged folders."""

import os

import pytest
from pyspark.sql import functions as F

from procsim import storage
from procsim.operators import dashboard, items, normalize, report, rollup, traces
from procsim.operators.explore import extract_traces
from procsim.plans import samples
from procsim.plans.samples import END, START, process
from procsim.sources.load import different_files, load_models, load_texts, scan


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("models")
    (top / "deep" / "er").mkdir(parents=True)
    (top / "line.bpmn").write_text(samples.DOCUMENTS["line.bpmn"])
    (top / "deep" / "claim.XML").write_text(samples.DOCUMENTS["claim.bpmn"])
    (top / "deep" / "er" / "editor.json").write_text(samples.DOCUMENTS["editor.json"])
    (top / "deep" / "copy.bpmn").write_text(samples.DOCUMENTS["line.bpmn"])
    (top / "broken.bpmn").write_text("<definitions")
    (top / "notes.txt").write_text("no model")
    return str(top)


def test_files_are_found_and_read(spark, folder):
    got = load_models(spark, folder)
    name = lambda path: path.rpartition("/")[2]
    assert sorted(name(r["model_id"]) for r in got.ids.collect()) == ["claim.XML", "copy.bpmn", "editor.json", "line.bpmn"]
    errors = got.errors.collect()
    assert [name(r["model_id"]) for r in errors] == ["broken.bpmn"] and len(errors[0]["message"]) <= 220
    texts = load_texts(spark, samples.DOCUMENTS)
    for file, text in (("claim.XML", "claim.bpmn"), ("editor.json", "editor.json"), ("line.bpmn", "line.bpmn")):
        for table in ("node", "flow", "lane_member"):
            of = lambda x, model, table=table: sorted(map(repr, (tuple(r)[1:] for r in getattr(x.models, table).collect() if name(r["model_id"]) == model)))
            assert of(got, file) == of(texts, text)


def test_only_the_top_folder(spark, folder):
    assert scan(spark, folder, recursive=False).count() == 2


def test_same_files_are_no_pair(spark, folder):
    files = scan(spark, folder)
    path = {r["model_id"].rpartition("/")[2]: r["model_id"] for r in files.collect()}
    pairs = spark.createDataFrame([(path["line.bpmn"], path[x]) for x in ("copy.bpmn", "claim.XML", "line.bpmn")], "model_a string, model_b string")
    assert [r["model_b"] for r in different_files(files, pairs).collect()] == [path["claim.XML"]]


def test_lanes_without_collaboration(spark):
    """A process with lanes is a pool of its own; one without has none."""
    lanes = '<laneSet id="l"><lane id="L" name="Desk"><flowNodeRef>a</flowNodeRef></lane></laneSet>'
    got = load_texts(spark, {"lanes.bpmn": process("task:a:A", flows="", extra=lanes), "plain.bpmn": process("task:a:A", flows="")}).models
    assert [(r["model_id"], r["pool_id"], r["name"]) for r in got.pool.collect()] == [("lanes.bpmn", "main", "main")]
    assert [tuple(r)[1:] for r in got.lane_member.collect()] == [("main", "L", "a")]


def test_run_table_from_csv(spark, tmp_path):
    path = tmp_path / "runs.csv"
    path.write_text(
        "pair_id,model_a,model_b,size_a,size_b,t_semantic,t_structural,t_behavioral,t_total,behavioral_timed_out_a,behavioral_timed_out_b,error\n"
        "1,a,b,3,9,0.5,0.25,1.25,2.0,True,False,\n2,a,c,3,x,0.5,oops,3.25,4.0,,false,\n3,b,c,9,5,100,100,100,300,true,true,no such file\n4,b,d,9,7,1,1,2,4,no,TRUE,\n"
    )
    runs = report.read_runs(spark, str(path))
    assert [tuple(r) for r in runs.filter("pair_id = '2'").select("size_b", "t_structural", "t_behavioral").collect()] == [(None, None, 3.25)]
    health = report.run_health(runs).first()
    assert tuple(health) == (4, 3, 1, 2, 25.0, pytest.approx(200 / 3))
    share = {r["stage"]: r["percent"] for r in report.stage_shares(runs).collect()}
    assert share == {"t_semantic": pytest.approx(100 * 2 / 9.75), "t_structural": pytest.approx(100 * 1.25 / 9.75), "t_behavioral": pytest.approx(100 * 6.5 / 9.75)}
    assert {r["model"]: r["size"] for r in report.model_sizes(runs).collect()} == {"a": 3, "b": 9, "c": None, "d": 7}
    stats = {r["stage"]: r for r in report.stage_statistics(runs).collect()}
    assert (stats["t_behavioral"]["median_t"], stats["t_behavioral"]["max_t"], stats["t_structural"]["median_t"]) == (2.0, 3.25, 0.625)
    assert [r["pair_id"] for r in report.slowest_pairs(runs).collect()] == ["2", "4", "1"]


def test_ranked_quantiles_are_exact(spark):
    """One group holds most rows; values repeat; nulls don't count."""
    import random

    import numpy as np

    draw = random.Random(3)
    rows = [("big", float(draw.randint(0, 400))) for _ in range(5000)] + [("small", x) for x in (1.0, 2.0, 4.0)] + [("one", 7.0), ("one", None)]
    got = report.ranked_quantiles(spark.createDataFrame(rows, "g string, t double"), ["g"], "t", {"a": 0.5, "b": 0.95, "c": 0.0, "d": 1.0}).collect()
    for r in got:
        own = [t for g, t in rows if g == r["g"] and t is not None]
        assert [r[c] for c in "abcd"] == pytest.approx([np.quantile(own, q) for q in (0.5, 0.95, 0.0, 1.0)])
    assert len(got) == 3


@pytest.mark.parametrize("weights,live,pin,expected", [
    ((2.7, 1.0, 1.0), "yyy", "x0", (2, 49, 49)), ((2.7, 0.0, 0.0), "ynn", "x0", (2, 0, 0)), ((2.7, 1.0, 0.0), "nyy", "x0", (0, 100, 0)), ((150.0, 1.0, 2.0), "yyy", "x0", (100, 0, 0)),
    ((0.0, 0.0, 0.0), "yyy", None, (34, 33, 33)), ((1.0, 1.0, 4.0), "yyn", None, (50, 50, 0)), ((1.0, 1.0, 1.0), "nnn", None, (0, 0, 0)), ((-3.5, 1.0, 3.0), "yyy", "x0", (0, 25, 75)),
])
def test_rescaled_weights(spark, weights, live, pin, expected):
    rows = [("g", i, f"x{i}", w, on == "y") for i, (w, on) in enumerate(zip(weights, live))]
    got = dashboard.rescale_to_100(spark.createDataFrame(rows, "group string, idx int, name string, weight double, live boolean"), pin)
    assert tuple(r["percent"] for r in got.orderBy("idx").collect()) == expected


def test_text_comparison(spark):
    found = extract_traces(load_texts(spark, samples.DOCUMENTS).models)
    pairs = spark.createDataFrame([("choice.bpmn", "line.bpmn"), ("none", "line.bpmn")], "model_a string, model_b string")
    every = found.all_traces()
    compared, shown = traces.compare_traces(every, pairs), traces.shared_traces(every, pairs)
    text = traces.comparison_report(compared, shown, "choice.bpmn", "line.bpmn")
    assert "common 0, only first 2, only second 1" in text and "only second: Begin > Pick > Pack > Ship > Done" in text and "trace_jaccard: 0.000" in text
    assert traces.comparison_report(compared, shown, "x", "y") == "x and y: no such pair"
    assert "trace_jaccard: n/a" in traces.comparison_report(traces.compare_traces(every, spark.createDataFrame([("no", "ne")], pairs.schema)), shown, "no", "ne")


def test_soundness_and_warnings(spark, caplog):
    found = extract_traces(load_texts(spark, samples.DOCUMENTS).models)
    sound = {r["model_id"]: r["is_sound"] for r in found.sound().collect()}
    assert sound["both.bpmn"] and not sound["loop.bpmn"] and not sound["nojoin.bpmn"]
    with caplog.at_level("WARNING"):
        assert found.warn() == 2 and len(caplog.records) == 2
    assert found.all_traces().count() == found.variants.count() + found.partials.count()


def test_exploration_that_is_cut_short(spark):
    found = extract_traces(load_texts(spark, {"both.bpmn": samples.DOCUMENTS["both.bpmn"]}).models, most_states=3)
    row = found.diagnostics.first()
    assert row["stopped"] and row["status"] == "exploration_truncated"


def test_normalize_renames_the_second_model(spark):
    """One call maps and renames; pairs without a match come through unchanged."""
    models = load_texts(spark, {
        "one.bpmn": process(START, "task:a:Check the order", "task:b:Ship goods", END, flows="s>a a>b b>e"), "two.bpmn": process(START, "task:a:Check the orders", "task:b:Ship the goods", END, flows="s>a a>b b>e"),
        "far.bpmn": process("startEvent:s:Zzz", flows=""),
    }).models
    pairs = spark.createDataFrame([("one.bpmn", "two.bpmn"), ("one.bpmn", "far.bpmn")], "model_a string, model_b string")
    renamed, mapping = normalize.normalize(models, pairs, threshold=0.6)
    names = {(r["model_id"], r["name"]) for r in renamed.node.collect()}
    assert names == {("one.bpmn|two.bpmn", x) for x in ("Begin", "Check the order", "Ship goods", "Done")} | {("one.bpmn|far.bpmn", "Zzz")}
    assert {r["matches"] for r in normalize.mapping_summary(mapping).collect()} == {2}
    wanted = spark.createDataFrame([("one.bpmn", "one.bpmn|two.bpmn")], "model_a string, model_b string")
    both = items.extract_items(models).unionByName(items.extract_items(renamed))
    assert rollup.structural_similarity(both, wanted).first()["overall"] == pytest.approx(1.0)


def test_names_are_embedded_once(spark, tmp_path):
    """A user's function sees each distinct name once, and its vectors decide."""
    models = load_texts(spark, {"one.bpmn": process("task:a:car", "task:b:car", "task:c:tea", flows=""), "two.bpmn": process("task:a:auto", "task:b:tea", flows="")}).models
    log = str(tmp_path / "seen")

    def embed(names):
        with open(log, "a") as f:
            f.writelines(f"{n}\n" for n in names)
        return [[1.0, 0.0] if n in ("car", "auto") else [0.0, 1.0] for n in names]

    pairs = spark.createDataFrame([("one.bpmn", "two.bpmn")], "model_a string, model_b string")
    got = normalize.all_mappings(models, pairs, threshold=0.9, embed=embed)
    assert {(r["name2"], r["name1"]) for r in got.collect()} == {("auto", "car"), ("tea", "tea")}
    assert sorted(open(log).read().split()) == ["auto", "car", "tea"]


def test_rounds_match_as_the_fold_does(spark):
    import random

    draw = random.Random(8)
    rows = [(draw.choice("xy"), draw.randint(0, 6) / 7, f"b{draw.randint(0, 14)}", f"a{draw.randint(0, 14)}") for _ in range(300)]
    given = spark.createDataFrame(sorted(set(rows)), "scope string, score double, name2 string, name1 string")
    fold, rounds = (sorted(map(tuple, normalize.greedy_mapping(given, ["scope"], most).collect())) for most in (4096, 0))
    assert fold == rounds and len(fold) >= 20


def test_thin_and_dense_pairs_count_alike(spark):
    import random

    draw = random.Random(6)
    models = [f"m{i:02}" for i in range(40)]
    rows = sorted({(m, f"t{min(draw.randint(0, 30), draw.randint(0, 30))}") for m in models for _ in range(12)})
    sets = {m: {t for n, t in rows if n == m} for m in models}
    tokens = spark.createDataFrame(rows, "model_id string, token string")
    every = [(a, b) for a in models for b in models if a <= b] + [("m05", "m01"), ("m03", "zz")]
    thin = [("m05", "m01"), ("m07", "m07"), ("m03", "zz")] + [(a, b) for a, b in zip(models, models[1:])]
    for pairs in (every, thin):
        got = traces.overlaps(tokens, spark.createDataFrame(pairs, "model_a string, model_b string")).collect()
        assert {(r["model_a"], r["model_b"], r["n1"], r["n2"], r["shared"]) for r in got} == {(a, b, len(sets[a]), len(sets.get(b, ())), len(sets[a] & sets.get(b, set()))) for a, b in pairs}
    from procsim.operators.matching import shared_counts

    counted = tokens.withColumn("n", F.length("model_id").cast("long"))
    got = shared_counts(counted, spark.createDataFrame(every, "model_a string, model_b string"), ["token"], [], block=3).collect()
    assert {(r["model_a"], r["model_b"]): r["shared"] for r in got} == {(a, b): 3 * len(sets[a] & sets[b]) for a, b in every if b in sets and sets[a] & sets[b]}


def test_staged_folders_go(spark, tmp_path, monkeypatch):
    plain = type(spark.conf).get
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, *default: f"file://{tmp_path}" if key == "spark.checkpoint.dir" else plain(self, key, *default))
    storage.staged(spark.range(3), "some")
    assert len(os.listdir(tmp_path)) == 1
    storage.clear(spark)
    assert os.listdir(tmp_path) == []
