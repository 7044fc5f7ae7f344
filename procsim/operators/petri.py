"""Models to Petri nets, one model at a time in one pass over the corpus (O-46, O-47)."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procsim.functions.vocabulary import GENERIC_EVENTS, is_choice, net_role
from procsim.models import Models
from procsim.operators.items import rank_of
from procsim.storage import staged

SEVERE = ("no_source_place", "no_sink_place")


@dataclass
class Nets:
    """``model``: model_id; ``place``: name; ``transition``: name, label (null: silent); ``arc``: src, dst, weight; ``marking``: which (initial, final), place, tokens."""

    model: DataFrame
    place: DataFrame
    transition: DataFrame
    arc: DataFrame
    marking: DataFrame


def gathered(models: Models, ids: DataFrame | None = None) -> DataFrame:
    """One row a model: ``model_id, nodes, flows, members``. A model's rules look at nothing but the model, so that one shuffle brings together all they need.

    ``ids`` adds models that have no rows in any table.
    """
    kind = F.coalesce("type", F.initcap("kind"))
    node = F.struct(
        rank_of("activity", "event", "gateway").alias("rank"), "seq", "id", "kind", kind.alias("type"), F.coalesce("name", F.lit("")).alias("name"),
        net_role(kind).alias("role"), is_choice(kind).alias("choice"),
    )
    flow = F.struct("flow_kind", "owner", F.col("source_ref").alias("s"), F.col("target_ref").alias("t"))
    member = F.struct(F.col("subprocess_id").alias("sub"), F.col("ref_id").alias("ref"))
    empty = {name: F.lit(None).cast(table.select(c.alias("x")).schema["x"].dataType) for name, table, c in (("node", models.node, node), ("flow", models.flow, flow), ("member", models.subprocess_member, member))}
    part = lambda table, **given: table.select("model_id", *[given.get(k, empty[k]).alias(k) for k in empty])
    rows = part(models.node, node=node).unionByName(part(models.flow, flow=flow)).unionByName(part(models.subprocess_member, member=member)).unionByName(part(models.pool))
    rows = rows if ids is None else rows.unionByName(part(ids))
    return rows.groupBy("model_id").agg(*[F.collect_list(k).alias(f"{k}s") for k in empty])


@dataclass
class Draft:
    """A net while it is built: names of places, labels of transitions (None: silent), arcs as (source, target, whether from a place), marked places."""

    places: set[str] = field(default_factory=set)
    transitions: dict[str, str | None] = field(default_factory=dict)
    arcs: set[tuple[str, str, bool]] = field(default_factory=set)
    marked: dict[str, str] = field(default_factory=dict)

    def add(self, *steps: tuple[str, str, bool]) -> None:
        self.arcs.update(steps)


def inlined(nodes, flows, members) -> dict[str, tuple[str, str]]:
    """Subprocesses whose body has just one entry and one exit, with these.

    Entries are members on an inner flow that no inner flow reaches, start events if there are any, else any; exits likewise.
    """
    leaving, reached, kinds = defaultdict(set), defaultdict(set), {}
    for f in flows:
        if f["flow_kind"] == "subprocess":
            leaving[f["owner"]] |= {f["s"]} - {None, ""}
            reached[f["owner"]] |= {f["t"]} - {None, ""}
    for n in nodes:
        if n["kind"] == "event":
            kinds.setdefault(n["id"], n["type"].lower())
    inside = defaultdict(set)
    for m in members:
        inside[m["sub"]].add(m["ref"])
    found = {}
    for sub, refs in inside.items():
        used, ends = refs & (leaving[sub] | reached[sub]), []
        for others, mark in ((reached[sub], "start"), (leaving[sub], "end")):
            loose = used - others
            typed = {x for x in loose if kinds.get(x, "").startswith(mark)}
            ends.append(typed or loose)
        if len(ends[0]) == len(ends[1]) == 1:
            found[sub] = (*ends[0], *ends[1])
    return found


def flow_graph(nodes, flows, members) -> tuple[dict[str, dict], set[tuple[str, str]]]:
    """Elements by id (``role``, ``choice``, ``type``, ``label``) and edges between them.

    Flows of all kinds count. Flows at an inlined subprocess are led to its entry or from its exit (one step), whose labels are blanked;
    the subprocess itself goes unless a flow still ends there. Of an id's elements the first activity, else event, else gateway counts.
    """
    into = inlined(nodes, flows, members)
    edges = {(into[s][1] if s in into else s, into[t][0] if t in into else t) for s, t in ((f["s"], f["t"]) for f in flows)}
    touched = {x for e in edges for x in e}
    silent = {x for ends in into.values() for x in ends}
    known: dict[str, dict] = {}
    for n in nodes:
        gone = n["id"] in into and n["id"] not in touched
        if not gone and n["role"] != "IRRELEVANT" and n["id"] not in known:
            label = "" if n["id"] in silent else n["name"] if n["name"].strip(" ") else n["type"]
            known[n["id"]] = {"role": n["role"], "choice": n["choice"], "type": n["type"], "label": label}
    return known, {(s, t) for s, t in edges if s in known and t in known}


def connect(net: Draft, known: dict[str, dict], edges: set[tuple[str, str]]) -> None:
    """Arcs of each edge by the roles of its ends.

    Between an edge's ends stand, as the roles ask, a place of its own (p), a silent transition (t), a second place (q), or a choice
    gateway's one place for all its outgoing (gout) or incoming (gin) edges.
    """
    for s, t in edges:
        one, two = known[s], known[t]
        p, q, silent = f"p:{s}->{t}", f"q:{s}->{t}", f"t:{s}->{t}"
        out, enter = f"gout:{s}" if one["choice"] else p, f"gin:{t}" if two["choice"] else None
        match one["role"], two["role"]:
            case "EVENT", "EVENT":
                net.add((s, silent, True), (silent, t, False))
            case "EVENT", _:
                net.add((s, t, True))
            case "TASK", "EVENT":
                net.add((s, t, False))
            case "TASK", "GATEWAY":
                net.add((s, enter or p, False), (enter or p, t, True))
            case "TASK", _:
                net.add((s, p, False), (p, t, True))
            case _, "EVENT":
                net.add((s, out, False), (out, silent, True), (silent, t, False))
            case _, "TASK":
                net.add((s, out, False), (out, t, True))
            case _:
                net.add((s, out, False), (out, silent, True), (silent, enter or q, False), (enter or q, t, True))


def task_label(key: str, label: str, kind: str) -> str:
    """A task's label, or else its id; ``CollapsedSubprocess (x)`` counts as x."""
    rest = label[len(kind) :].strip(" ")
    if kind.startswith("CollapsedSubprocess") and label.startswith(kind) and rest.startswith("(") and rest.endswith(")"):
        label = rest[1:-1].strip(" ")
    return label or key


def split_joins(net: Draft, known: dict[str, dict], edges: set[tuple[str, str]]) -> None:
    """Tasks that several elements lead to take a token from any of their places, not one from each."""
    led = defaultdict(set)
    for s, t in edges:
        if s != t:
            led[t].add(s)
    inputs = defaultdict(list)
    for a in net.arcs:
        if len(led[a[1]]) > 1 and known.get(a[1], {}).get("role") == "TASK":
            inputs[a[1]].append(a)
    for task, own in inputs.items():
        if len(own) > 1:
            net.arcs.difference_update(own)
            for src, _, _ in own:
                way = f"j:{src}->{task}"
                net.add((src, way, True), (way, f"pj:{task}", False), (f"pj:{task}", task, True))


def show_events(net: Draft, shown: set[str]) -> None:
    """Event places with a telling label become place, labelled transition, place."""
    net.arcs = {(f"pout:{a}" if a in shown else a, f"pin:{b}" if b in shown else b, k) for a, b, k in net.arcs}
    for x in shown:
        net.add((f"pin:{x}", f"e:{x}", True), (f"e:{x}", f"pout:{x}", False))


def close_ends(net: Draft) -> None:
    """One start and one end place: where there are none or several, new ones lead to the sources or from the sinks (one of several starts, not all)."""
    if not net.places and not net.transitions:
        return
    new = []
    for which, outer, near in (("initial", "_start", 1), ("final", "_end", 0)):
        held = {a[near] for a in net.arcs}
        ends, loose = sorted(net.places - held), sorted(set(net.transitions) - held)
        step = lambda a, b, place: (a, b, place) if near else (b, a, not place)
        net.marked[which] = ends[0] if len(ends) == 1 else outer
        if len(ends) > 1:
            for x in ends:
                new += [step(outer, f"{outer}:{x}", True), step(f"{outer}:{x}", x, False)]
        elif not ends:
            new += [step(outer, x, True) for x in loose or sorted(net.transitions)[:1]]
    net.add(*new)


def compile_net(nodes, flows, members, event_labels: bool) -> Draft:
    nodes = sorted(nodes, key=lambda n: (n["rank"], n["seq"] is not None, n["seq"] or 0, n["name"], n["type"]))
    known, edges = flow_graph(nodes, flows, members)
    net = Draft()
    connect(net, known, edges)
    split_joins(net, known, edges)
    events = {x for x, e in known.items() if e["role"] == "EVENT"}
    net.transitions = {x: task_label(x, e["label"], e["type"]) if e["role"] == "TASK" else None for x, e in known.items() if x not in events}
    if event_labels:
        shown = {x for x in events if known[x]["label"].strip(" ") and known[x]["label"].lower() not in GENERIC_EVENTS}
        show_events(net, shown)
        events -= shown
        net.transitions |= {f"e:{x}": known[x]["label"] for x in shown}
    net.places = events
    take_ends(net)
    close_ends(net)
    net.places |= set(net.marked.values())
    take_ends(net)
    return net


def take_ends(net: Draft) -> None:
    """Ends of arcs that are neither yet become places and silent transitions."""
    for src, dst, from_place in net.arcs:
        net.places.add(src if from_place else dst)
        net.transitions.setdefault(dst if from_place else src, None)


ROWS = "model_id string, part string, a string, b string, n long"


def rows_of(net: Draft) -> Iterator[tuple[str, str | None, str | None, int]]:
    yield "model", None, None, 0
    yield from (("place", x, None, 0) for x in sorted(net.places))
    yield from (("transition", x, label, 0) for x, label in sorted(net.transitions.items()))
    yield from (("arc", a, b, 1) for a, b, _ in sorted(net.arcs))
    yield from (("marking", which, x, 1) for which, x in net.marked.items())


def tables_of(rows: DataFrame) -> Nets:
    """The tables of nets in the rows that ``rows_of`` gives."""
    of = lambda part, *columns: rows.filter(F.col("part") == part).select("model_id", *columns)
    return Nets(
        of("model"), of("place", F.col("a").alias("name")), of("transition", F.col("a").alias("name"), F.col("b").alias("label")),
        of("arc", F.col("a").alias("src"), F.col("b").alias("dst"), F.col("n").cast("int").alias("weight")),
        of("marking", F.col("a").alias("which"), F.col("b").alias("place"), F.col("n").cast("int").alias("tokens")),
    )


def compile_nets(models: Models, event_labels: bool = True, ids: DataFrame | None = None) -> Nets:
    """Petri nets of all models (O-47h), written once in the shared folder. ``ids`` adds models that have no rows in any table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(model, *r) for model, *given in batch[["model_id", "nodes", "flows", "members"]].itertuples(index=False) for r in rows_of(compile_net(*given, event_labels))]
            yield pd.DataFrame(out, columns=["model_id", "part", "a", "b", "n"])

    return tables_of(staged(gathered(models, ids).mapInPandas(run, ROWS), "nets"))


def issues_of(places: set[str], transitions: set[str], arcs: list[tuple[str, str]]) -> Iterator[tuple[str, str | None]]:
    """What keeps a net from being a workflow net, as (issue, node)."""
    into, out = defaultdict(list), defaultdict(list)
    for a, b in arcs:
        out[a].append(b)
        into[b].append(a)
    for side, issue in ((into, "source"), (out, "sink")):
        ends = [x for x in sorted(places) if x not in side]
        if not ends:
            yield f"no_{issue}_place", None
        elif len(ends) > 1:
            yield from ((f"multiple_{issue}_places", x) for x in ends)
    every = sorted(places | transitions)
    yield from (("isolated_node", x) for x in every if x not in into and x not in out)
    yield from (("dead_transition_no_preset", x) for x in sorted(transitions) if x not in into)
    yield from (("dead_transition_no_postset", x) for x in sorted(transitions) if x in into and x not in out)
    for issue, ends, steps in (("unreachable_from_source", into, out), ("cannot_reach_sink", out, into)):
        stack = [x for x in places if x not in ends]
        seen = set(stack)
        while stack:
            for x in steps.get(stack.pop(), ()):
                if x not in seen:
                    seen.add(x)
                    stack.append(x)
        if seen:
            yield from ((issue, x) for x in every if x not in seen)


def collected(nets: Nets) -> DataFrame:
    """One row a net. A net fits one task; the corpus need not."""
    parts = {"places": (nets.place, ["name"]), "transitions": (nets.transition, ["name", "label"]), "arcs": (nets.arc, ["src", "dst", "weight"]), "marking": (nets.marking, ["which", "place", "tokens"])}
    empty = {k: F.lit(None).cast(table.select(F.struct(*c).alias("x")).schema["x"].dataType) for k, (table, c) in parts.items()}
    rows = nets.model.select("model_id", *[e.alias(k) for k, e in empty.items()])
    for part, (table, columns) in parts.items():
        rows = rows.unionByName(table.select("model_id", *[(F.struct(*columns) if k == part else e).alias(k) for k, e in empty.items()]))
    return rows.groupBy("model_id").agg(*[F.collect_list(k).alias(k) for k in parts])


def detailed(issues: DataFrame) -> DataFrame:
    return issues.select("model_id", "issue", "node_id", F.concat_ws(": ", F.regexp_replace("issue", "_", " "), "node_id").alias("detail"))


def findings(nets: Nets) -> DataFrame:
    """``model_id, issue, node_id, detail``: what keeps a net from being a workflow net (O-47i)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                found = issues_of({x["name"] for x in row.places}, {x["name"] for x in row.transitions}, [(x["src"], x["dst"]) for x in row.arcs])
                out += [(row.model_id, issue, node) for issue, node in found]
            yield pd.DataFrame(out, columns=["model_id", "issue", "node_id"])

    return detailed(collected(nets).mapInPandas(run, "model_id string, issue string, node_id string"))
