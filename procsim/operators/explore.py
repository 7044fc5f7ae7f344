"""Traces of Petri nets by exploring their states, one task a net (O-48 to O-51)."""

from __future__ import annotations

import logging
import time
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procsim.models import Models
from procsim.operators.petri import SEVERE, Nets, collected, compile_net, detailed, gathered, issues_of
from procsim.operators.traces import all_traces
from procsim.storage import staged

log = logging.getLogger(__name__)
#: Fixed value: most states that wait at a time.
ACTIVE_CAP = 20_000


@dataclass
class Net:
    """One net with numbered places; a marking is a tuple of token counts."""

    start: tuple[int, ...]
    end: tuple[int, ...]
    transitions: list[tuple[str, str | None, list[tuple[int, int]], list[tuple[int, int]]]]  # name, label, inputs, outputs

    @classmethod
    def of(cls, places, transitions, arcs, marking) -> "Net":
        number = {p: i for i, p in enumerate(sorted(places))}
        inputs: dict[str, list[tuple[int, int]]] = {}
        outputs: dict[str, list[tuple[int, int]]] = {}
        for src, dst, weight in sorted(arcs):
            if src in number:
                inputs.setdefault(dst, []).append((number[src], weight))
            else:
                outputs.setdefault(src, []).append((number[dst], weight))
        marks = {"initial": [0] * len(number), "final": [0] * len(number)}
        for which, place, tokens in marking:
            marks[which][number[place]] += tokens
        kept = [(n, label, inputs.get(n, []), outputs.get(n, [])) for n, label in sorted(transitions, key=lambda x: x[0]) if n in inputs or n in outputs]
        return cls(tuple(marks["initial"]), tuple(marks["final"]), kept)

    def enabled(self, marking: tuple[int, ...]) -> list[int]:
        """Transitions that may fire; one without inputs always may, one without any arc never."""
        return [i for i, (_, _, need, _) in enumerate(self.transitions) if all(marking[p] >= w for p, w in need)]

    def fire(self, marking: tuple[int, ...], i: int) -> tuple[int, ...]:
        now = list(marking)
        for p, w in self.transitions[i][2]:
            now[p] -= w
        for p, w in self.transitions[i][3]:
            now[p] += w
        return tuple(now)


@dataclass
class Exploration:
    variants: set[tuple[str, ...]]
    partials: set[tuple[str, ...]]
    deadlocks: dict[tuple[int, ...], tuple[str, ...]]
    loops: Counter
    capped: bool = False
    stopped: bool = False


def explore(net: Net, depth: int, most_states: int, seconds: float | None = None, cap: int = ACTIVE_CAP) -> Exploration:
    """All visible traces from the start marking, breadth first and in a fixed order.

    A transition fires at most ``depth`` times on a path; where one more would follow, the trace so far counts as partial, and so
    does that of a dead end. Reaching the end marking gives a variant and ends the path. ``most_states``, and ``seconds`` if given, stop a
    net that grows too far; it is then marked as such.
    """
    out = Exploration(set(), set(), {}, Counter())
    began, seen, states = time.monotonic(), set(), 0
    level = [((), net.start, ())]  # trace, marking, times each transition has fired
    while level:
        following = []
        for at, (trace, marking, fired) in enumerate(level):
            if (trace, marking) in seen:
                continue
            seen.add((trace, marking))
            states += 1
            if states > most_states or seconds is not None and time.monotonic() - began > seconds:
                out.stopped = True
                return out
            ready, times = net.enabled(marking), dict(fired)
            if not ready:
                if marking == net.end:
                    out.variants.add(trace)
                else:
                    out.deadlocks.setdefault(marking, trace)
                    out.partials.add(trace)
            for i in ready:
                if times.get(i, 0) >= depth:
                    out.loops[net.transitions[i][0]] += 1
                    out.partials.add(trace)
                    continue
                label, then = net.transitions[i][1], net.fire(marking, i)
                longer = trace if label is None else (*trace, label)
                if then == net.end:
                    out.variants.add(longer)
                elif len(level) - at - 1 + len(following) < cap:
                    following.append((longer, then, tuple(sorted({**times, i: times.get(i, 0) + 1}.items()))))
                else:
                    out.capped = True
        level = sorted(following)
    return out


RESULT = "model_id string, kind string, trace array<string>, node string, n long"


def result_rows(model: str, net: Net, places: list[str], depth: int, most_states: int, seconds: float | None) -> Iterator[tuple]:
    found, named = explore(net, depth, most_states, seconds), sorted(places)
    yield from ((model, "variant", list(t), None, 1) for t in sorted(found.variants))
    yield from ((model, "partial", list(t), None, 1) for t in sorted(found.partials))
    yield from ((model, "deadlock", list(t), ",".join(f"{p}:{n}" for p, n in zip(named, m) if n), 1) for m, t in sorted(found.deadlocks.items()))
    yield from ((model, "loop", None, t, n) for t, n in sorted(found.loops.items()))
    yield from ((model, kind, None, None, 1) for kind, hit in (("capped", found.capped), ("stopped", found.stopped)) if hit)


def explore_nets(nets: Nets, depth: int = 3, most_states: int = 200_000, seconds: float | None = None) -> DataFrame:
    """``model_id, kind, trace, node, n`` (O-48), kind being variant, partial, deadlock (node: the marking, trace: an example), loop (node: the transition), capped
    or stopped; and model, and issue (node: the node, trace: the issue), for what ``findings`` says."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                take = lambda xs, *names: [tuple(x[n] for n in names) for x in xs]
                places, arcs = [x["name"] for x in row.places], take(row.arcs, "src", "dst", "weight")
                transitions = take(row.transitions, "name", "label")
                rows += net_rows(row.model_id, places, transitions, arcs, take(row.marking, "which", "place", "tokens"), depth, most_states, seconds)
            yield pd.DataFrame(rows, columns=["model_id", "kind", "trace", "node", "n"])

    return collected(nets).mapInPandas(run, RESULT)


def net_rows(model: str, places: list[str], transitions: list[tuple], arcs: list[tuple], marking: list[tuple], depth: int, most_states: int, seconds: float | None) -> Iterator[tuple]:
    yield model, "model", None, None, 1
    yield from ((model, "issue", [issue], node, 1) for issue, node in issues_of(set(places), {t for t, _ in transitions}, [a[:2] for a in arcs]))
    yield from result_rows(model, Net.of(places, transitions, arcs, marking), places, depth, most_states, seconds)


def explore_models(models: Models, depth: int, most_states: int, seconds: float | None, ids: DataFrame | None = None, event_labels: bool = True) -> DataFrame:
    """Compile, check and explore each model where its rows have come together: the rows of ``explore_nets`` in one pass."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for model, *given in batch[["model_id", "nodes", "flows", "members"]].itertuples(index=False):
                net = compile_net(*given, event_labels)
                arcs = [(a, b, 1) for a, b, _ in net.arcs]
                rows += net_rows(model, sorted(net.places), list(net.transitions.items()), arcs, [(w, p, 1) for w, p in net.marked.items()], depth, most_states, seconds)
            yield pd.DataFrame(rows, columns=["model_id", "kind", "trace", "node", "n"])

    return gathered(models, ids).mapInPandas(run, RESULT)


def diagnose(explored: DataFrame) -> DataFrame:
    """Counts, status and summary of each net (O-50, O-51): all in one grouping of what exploration gave."""
    count = lambda kind, value=F.lit(1): F.coalesce(F.sum(F.when(F.col("kind") == kind, value)), F.lit(0)).cast("long")
    severe = (F.col("kind") == "issue") & F.get("trace", F.lit(0)).isin(*SEVERE)
    own = explored.groupBy("model_id").agg(
        count("variant").alias("variants"), count("partial").alias("partials"), count("deadlock").alias("deadlocks"),
        count("loop", F.col("n")).alias("loop_hits"), (count("capped") > 0).alias("capped"), (count("stopped") > 0).alias("stopped"),
        F.count(F.when(severe, 1)).alias("severe"),
    )
    bad = (F.col("deadlocks") > 0) | (F.col("loop_hits") > 0) | (F.col("severe") > 0)
    status = (
        F.when((F.col("severe") > 0) & (F.col("variants") == 0), "structurally_broken")
        .when(bad & (F.col("variants") > 0), "unsound_recovered")
        .when(bad, "unsound_no_variants")
        .when(F.col("capped") | F.col("stopped"), "exploration_truncated")
        .otherwise("sound")
    )
    # fixed values: the wording of the summary
    part = lambda hit, text: F.when(hit, text)
    parts = F.concat_ws(
        ", ",
        part(F.col("severe") > 0, F.format_string("%d severe structural issue(s)", "severe")),
        part(F.col("deadlocks") > 0, F.format_string("%d distinct deadlock marking(s)", "deadlocks")),
        part(F.col("loop_hits") > 0, F.format_string("%d loop-cap hit(s)", "loop_hits")),
        part(F.col("stopped"), F.lit("exploration timed out")),
        part(F.col("capped"), F.lit("exploration truncated by active-set cap")),
    )
    long = F.concat(F.format_string("%d sound variant(s), %d partial trace(s); ", "variants", "partials"), parts)
    summary = F.when(parts == "", F.format_string("sound: %d variant(s)", "variants")).otherwise(long)
    return own.withColumn("status", status).withColumn("summary", summary)


@dataclass
class Traces:
    """Result of ``extract_traces``: ``variants`` and ``partials`` (model_id, trace), ``diagnostics`` (a row a model), ``deadlocks``, ``loops``, ``issues``."""

    variants: DataFrame
    partials: DataFrame
    diagnostics: DataFrame
    deadlocks: DataFrame
    loops: DataFrame
    issues: DataFrame

    def all_traces(self) -> DataFrame:
        return all_traces(self.variants, self.partials)

    def sound(self) -> DataFrame:
        return self.diagnostics.select("model_id", (F.col("status") == "sound").alias("is_sound"))

    def warn(self, most: int = 100) -> int:
        """Log a warning for each net that isn't sound, ``most`` at most; returns how many were logged."""
        bad = self.diagnostics.filter("status <> 'sound'").orderBy("model_id").limit(most).collect()
        for row in bad:
            log.warning("%s: %s (%s)", row["model_id"], row["status"], row["summary"])
        return len(bad)


def traces_of(explored: DataFrame) -> Traces:
    explored = staged(explored, "explored")
    of = lambda kind: explored.filter(F.col("kind") == kind)
    return Traces(
        of("variant").select("model_id", "trace"), of("partial").select("model_id", "trace"), diagnose(explored),
        of("deadlock").select("model_id", F.col("node").alias("tokens"), F.col("trace").alias("example")),
        of("loop").select("model_id", F.col("node").alias("transition"), F.col("n").alias("hits")),
        detailed(of("issue").select("model_id", F.get("trace", F.lit(0)).alias("issue"), F.col("node").alias("node_id"))),
    )


def traces_of_nets(nets: Nets, depth: int = 3, most_states: int = 200_000, seconds: float | None = None) -> Traces:
    return traces_of(explore_nets(nets, depth, most_states, seconds))


#: The variants of nets as an event log go by this name too (O-48b).
to_variant_event_log = traces_of_nets


def extract_traces(models: Models, max_loop_depth: int = 2, most_states: int = 200_000, seconds: float | None = None, ids: DataFrame | None = None) -> Traces:
    """Compile, check and explore all models (O-49), each once, however many pairs it is in; the result is written in the shared folder."""
    return traces_of(explore_models(models, max_loop_depth, most_states, seconds, ids))
