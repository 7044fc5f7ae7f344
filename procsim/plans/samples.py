"""Small models of our own, as documents; queries and tests use them."""

from __future__ import annotations

HEAD = '<definitions xmlns="http://www.omg.org/spec/BPMN/20100524/MODEL">'


def process(*nodes: str, flows: str, key: str = "main", extra: str = "") -> str:
    """A model of tags such as ``task:a:Check order``; flows as ``a>b a>c``."""
    body = []
    for text in nodes:
        tag, node, name = (text.split(":") + ["", ""])[:3]
        body.append(f'<{tag} id="{node}" name="{name}"/>')
    body += [f'<sequenceFlow id="f{i}" sourceRef="{s}" targetRef="{t}"/>' for i, (s, t) in enumerate(f.split(">") for f in flows.split())]
    return f'{HEAD}<process id="{key}">{"".join(body)}{extra}</process></definitions>'


START, END = "startEvent:s:Begin", "endEvent:e:Done"
ABC = ("task:a:Pick", "task:b:Pack", "task:c:Ship")
CLAIM = (
    f'{HEAD}<collaboration id="k"><participant id="P1" name="Insurer" processRef="main"/><participant id="P2" name="Client"/>'
    '<messageFlow id="m1" sourceRef="P2" targetRef="s" name="claim"/></collaboration>'
    '<process id="main"><laneSet id="ls"><lane id="L1" name="Desk"><flowNodeRef>s</flowNodeRef><flowNodeRef>a</flowNodeRef></lane>'
    '<lane id="L2" name=""><flowNodeRef>g</flowNodeRef><flowNodeRef>u</flowNodeRef></lane></laneSet>'
    '<startEvent id="s" name="Claim in"><messageEventDefinition/></startEvent><userTask id="a" name="Read\nclaim"/>'
    '<exclusiveGateway id="g"/><subProcess id="u" name=""><startEvent id="us"/><serviceTask id="ut" name="Assess"/><endEvent id="ue"/>'
    '<sequenceFlow id="u1" sourceRef="us" targetRef="ut"/><sequenceFlow id="u2" sourceRef="ut" targetRef="ue"/></subProcess>'
    '<endEvent id="e" name="Paid"/><endEvent id="x" name="Refused"><terminateEventDefinition/></endEvent>'
    '<callActivity id="skip" name="ignored"/>'
    '<sequenceFlow id="f1" sourceRef="s" targetRef="a"/><sequenceFlow id="f2" sourceRef="a" targetRef="g"/>'
    '<sequenceFlow id="f3" sourceRef="g" targetRef="u" name="covered"/>'
    '<sequenceFlow id="f4" sourceRef="g" targetRef="x"><conditionExpression> not covered </conditionExpression></sequenceFlow>'
    '<sequenceFlow id="f5" sourceRef="u" targetRef="e"/></process></definitions>'
)
EDITOR = """{"resourceId": "d", "stencil": {"id": "BPMNDiagram"}, "childShapes": [
 {"resourceId": "P", "stencil": {"id": "Pool"}, "properties": {"name": "Shop"}, "childShapes": [
  {"resourceId": "L", "stencil": {"id": "Lane"}, "properties": {"name": "Store"}, "childShapes": [
   {"resourceId": "s", "stencil": {"id": "StartNoneEvent"}, "properties": {"name": "Begin"}, "outgoing": [{"resourceId": "f1"}]},
   {"resourceId": "a", "stencil": {"id": "Task"}, "properties": {"name": "Pick", "tasktype": "User"}, "outgoing": [{"resourceId": "f2"}]},
   {"resourceId": "g", "stencil": {"id": "Exclusive_Databased_Gateway"}, "properties": {}, "outgoing": [{"resourceId": "f3"}, {"resourceId": "f4"}]},
   {"resourceId": "u", "stencil": {"id": "Subprocess"}, "properties": {"name": "Deliver"}, "outgoing": [{"resourceId": "f5"}], "childShapes": [
    {"resourceId": "us", "stencil": {"id": "StartNoneEvent"}, "properties": {}, "outgoing": [{"resourceId": "u1"}]},
    {"resourceId": "ut", "stencil": {"id": "Task"}, "properties": {"name": "", "name_en_gb": "Drive"}, "outgoing": [{"resourceId": "u2"}]},
    {"resourceId": "ue", "stencil": {"id": "EndNoneEvent"}, "properties": {}},
    {"resourceId": "u1", "stencil": {"id": "SequenceFlow"}, "properties": {}, "target": {"resourceId": "ut"}}]},
   {"resourceId": "e", "stencil": {"id": "EndNoneEvent"}, "properties": {"name": "Done"}}]}]},
 {"resourceId": "odd", "stencil": {"id": "Hologram"}, "properties": {}},
 {"resourceId": "f1", "stencil": {"id": "SequenceFlow"}, "properties": {}, "target": {"resourceId": "a"}},
 {"resourceId": "f2", "stencil": {"id": "SequenceFlow"}, "properties": {}, "target": {"resourceId": "g"}},
 {"resourceId": "f3", "stencil": {"id": "SequenceFlow"}, "properties": {"name": "far"}, "target": {"resourceId": "u"}},
 {"resourceId": "f4", "stencil": {"id": "SequenceFlow"}, "properties": {}, "target": {"resourceId": "e"}},
 {"resourceId": "f5", "stencil": {"id": "SequenceFlow"}, "properties": {}, "target": {"resourceId": "e"}},
 {"resourceId": "u2", "stencil": {"id": "SequenceFlow"}, "properties": {}, "target": {"resourceId": "ue"}}]}"""

DOCUMENTS = {
    "line.bpmn": process(START, *ABC, END, flows="s>a a>b b>c c>e"),
    "renamed.bpmn": process(START, "task:a:Gather", "task:b:Wrap", "task:c:Send off", END, flows="s>a a>b b>c c>e"),
    "empty.bpmn": process(START, END, flows="s>e"),
    "choice.bpmn": process(START, "exclusiveGateway:g1", "task:a:Pick", "task:b:Pack", "exclusiveGateway:g2", END, flows="s>g1 g1>a g1>b a>g2 b>g2 g2>e"),
    "both.bpmn": process(START, "parallelGateway:g1", "task:a:Pick", "task:b:Pack", "parallelGateway:g2", END, flows="s>g1 g1>a g1>b a>g2 b>g2 g2>e"),
    "nojoin.bpmn": process(START, "parallelGateway:g1", "task:a:Pick", "task:b:Pack", END, flows="s>g1 g1>a g1>b a>e b>e"),
    "loop.bpmn": process(START, "task:a:Pick", "exclusiveGateway:g1", END, flows="s>a a>g1 g1>a g1>e"),
    "claim.bpmn": CLAIM,
    "editor.json": EDITOR,
}

#: Gateways that follow gateways, of all four kinds of pairs.
GATES = process("exclusiveGateway:x1", "exclusiveGateway:x2", "parallelGateway:p1", "parallelGateway:p2", flows="x1>x2 x1>p1 p1>x2 p1>p2")
#: Two tasks and an event of one id, and a pool and a gateway of another: the first task and the pool count at ends of flows.
REPEATED = (
    f'{HEAD}<collaboration id="k"><participant id="x" name="Shop" processRef="main"/><messageFlow id="m" sourceRef="x" targetRef="a"/></collaboration>'
    '<process id="main"><laneSet id="ls"><lane id="L" name="Desk"><flowNodeRef>a</flowNodeRef><flowNodeRef>x</flowNodeRef></lane></laneSet>'
    '<endEvent id="a" name="Over"/><task id="a" name="First"/><userTask id="a" name="Second"/><exclusiveGateway id="x" name="Which"/>'
    '<sequenceFlow id="f1" sourceRef="a" targetRef="x"/><sequenceFlow id="f2" sourceRef="x" targetRef="gone"/></process></definitions>'
)
#: Subprocesses, one of them collapsed, whose inner names are matched by themselves.
NESTED = {
    "outer1.json": """{"stencil": {"id": "BPMNDiagram"}, "childShapes": [{"resourceId": "t", "stencil": {"id": "Task"}, "properties": {"name": "Load van"}},
 {"resourceId": "c", "stencil": {"id": "CollapsedSubprocess"}, "properties": {"name": "Load van again"}},
 {"resourceId": "u", "stencil": {"id": "Subprocess"}, "properties": {"name": "Trip"}, "childShapes": [{"resourceId": "i", "stencil": {"id": "Task"}, "properties": {"name": "Drive home"}}]}]}""",
    "outer2.json": """{"stencil": {"id": "BPMNDiagram"}, "childShapes": [{"resourceId": "t", "stencil": {"id": "Task"}, "properties": {"name": "Drive home"}},
 {"resourceId": "c", "stencil": {"id": "Subprocess"}, "properties": {"name": "Load van again"}, "childShapes": [{"resourceId": "i", "stencil": {"id": "Task"}, "properties": {"name": "Drive homes"}}]}]}""",
}
#: Nets by hand: arcs (places are p..., transitions t...), further places, start and end marking.
NETS = {
    "fine": ("p0>t1 t1>p1", "", "p0:1", "p1:1"),
    "stuck": ("p0>t1 t1>p1", "p2", "p0:1", "p2:1"),
    "half": ("p0>t1 t1>p1 p0>t2 t2>p2", "", "p0:1", "p1:1"),
    "ring": ("p0>t1 t1>p1 p1>t2 t2>p0", "", "p0:1", "p1:2"),
    "long": (" ".join(f"p{i}>t{i} t{i}>p{i + 1}" for i in range(9)), "", "p0:1", "p9:1"),
    "loose": ("p0>t1 t1>p1 t2>p2 p3>t3", "", "p0:1", "p1:1"),
}
