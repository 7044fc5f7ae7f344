"""Model documents to rows (O-04 to O-15): the only step that walks trees.

A parser gets a document's text and yields (table, row) with the row's columns as a dict. Flows of diagram-editor documents come without
source; ``procsim.sources.load`` finds it by a join.
"""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET
from collections.abc import Iterator

from procsim.functions.vocabulary import ACTIVITY_TAGS, EVENT_TYPES, GATEWAY_ALIASES, GATEWAY_TAGS, STENCILS

#: Fixed value: the namespace of BPMN 2.0 models.
SPACE = "{http://www.omg.org/spec/BPMN/20100524/MODEL}"
CLASS_OF = {stencil: kind for kind, names in STENCILS.items() for stencil in names}
Row = tuple[str, dict]


def local(element: ET.Element) -> str:
    return element.tag.rpartition("}")[2] if isinstance(element.tag, str) else ""


def name_of(element: ET.Element) -> str:
    return element.get("name", "").replace("\n", " ").strip()


def typed_event(element: ET.Element) -> str:
    marks = [local(x) for x in element if local(x).endswith("EventDefinition")]
    known = EVENT_TYPES[local(element)]
    return known.get(marks[0].removesuffix("EventDefinition") if marks else "", known[""])


class XmlModel:
    """Rows of a BPMN 2.0 document.

    Nodes come in the order in which subprocess contents precede their subprocess, which numbers unnamed subprocesses.
    """

    def __init__(self, text: str | bytes):
        self.root = ET.fromstring(text.encode("utf-8") if isinstance(text, str) else text)
        self.seq = 0

    def rows(self) -> Iterator[Row]:
        processes = {p.get("id", ""): p for p in self.root.findall(SPACE + "process")}
        together = self.root.find(SPACE + "collaboration")
        if together is None:
            for key, process in processes.items():
                pool = key if process.find(SPACE + "laneSet") is not None else None
                if pool is not None:
                    yield self.pool(pool, process.get("name", "") or key)
                yield from self.process(process, pool)
            return
        used = set()
        for part in together.findall(SPACE + "participant"):
            yield self.pool(part.get("id", ""), name_of(part))
            ref = part.get("processRef")
            used.add(ref)
            if ref in processes:
                yield from self.process(processes[ref], part.get("id", ""))
        for flow in together.findall(SPACE + "messageFlow"):
            yield "flow", {"flow_kind": "message", "id": flow.get("id", ""), "source_ref": flow.get("sourceRef", ""), "target_ref": flow.get("targetRef", ""), "label": name_of(flow) or None}
        for key, process in processes.items():
            if key not in used:
                yield from self.process(process, None)

    def next(self) -> int:
        self.seq += 1
        return self.seq

    def pool(self, key: str, name: str) -> Row:
        return "pool", {"pool_id": key, "name": name, "seq": self.next()}

    def process(self, process: ET.Element, pool: str | None) -> Iterator[Row]:
        lane_of = {}
        for lane in process.iterfind(f"{SPACE}laneSet/{SPACE}lane"):
            key = lane.get("id", "")
            if pool is not None:
                yield "lane", {"pool_id": pool, "lane_id": key, "name": name_of(lane), "seq": self.next()}
            lane_of |= {r.text.strip(): key for r in lane.findall(SPACE + "flowNodeRef") if r.text}
        for table, row in self.scope(process, None, None):
            yield table, row
            if table == "node" and not row["_inside"] and lane_of.get(row["id"]):
                yield "lane_member", {"lane_id": lane_of[row["id"]], "ref_id": row["id"]}

    def scope(self, container: ET.Element, parent: str | None, owner: str | None) -> Iterator[Row]:
        for child in container:
            tag, key = local(child), child.get("id", "")
            base = {"id": key, "name": name_of(child), "parent_subprocess": parent, "_inside": owner is not None}
            if tag == "subProcess":
                kind = "EventSubprocess" if child.get("triggeredByEvent", "false").lower() == "true" else "Subprocess"
                inner = list(self.scope(child, base["name"] or key, key))
                own = [r["id"] for t, r in inner if t == "node" and r["_owner"] == key]
                yield from inner
                yield from (("subprocess_member", {"subprocess_id": key, "ref_id": x}) for x in own)
                yield self.node("activity", kind, base, owner, True)
            elif tag in ACTIVITY_TAGS:
                yield self.node("activity", ACTIVITY_TAGS[tag], base, owner)
            elif tag in EVENT_TYPES:
                yield self.node("event", typed_event(child), base, owner)
            elif tag in GATEWAY_TAGS:
                yield self.node("gateway", GATEWAY_ALIASES[tag.lower()], base, owner)
            elif tag == "sequenceFlow":
                condition = child.find(SPACE + "conditionExpression")
                text = condition.text.strip() if condition is not None and condition.text else None
                yield "flow", {
                    "flow_kind": "subprocess" if owner is not None else "sequence", "id": key, "source_ref": child.get("sourceRef", ""),
                    "target_ref": child.get("targetRef", ""), "label": base["name"] or text, "owner": owner,
                }

    def node(self, kind: str, type_: str, base: dict, owner: str | None, expanded: bool = False) -> Row:
        return "node", {**base, "kind": kind, "type": type_, "expanded": expanded, "seq": self.next(), "_owner": owner}


class EditorModel:
    """Rows of a diagram-editor (shape tree) JSON document."""

    def __init__(self, text: str | dict):
        self.root = json.loads(text) if isinstance(text, str) else text
        self.seq, self.known = 0, set()

    def rows(self) -> Iterator[Row]:
        diagram = CLASS_OF.get(self.root["stencil"]["id"]) == "Diagram"
        yield from self.scope(self.root.get("childShapes", []) if diagram else [self.root], None, None)

    def next(self) -> int:
        self.seq += 1
        return self.seq

    @staticmethod
    def name(shape: dict) -> str:
        given = shape.get("properties", {})
        named = [given[k] for k in ("name", "name_en_gb", "name_de_de") if given.get(k)]
        return named[0].replace("\n", " ").strip() if named else ""

    def links(self, shape: dict) -> Iterator[Row]:
        for order, x in enumerate(shape.get("outgoing", [])):
            yield "outgoing", {"id": shape["resourceId"], "ref_id": x.get("resourceId"), "seq": self.seq, "kind": str(order)}

    def flow(self, shape: dict, kind: str, owner: str | None) -> Row:
        return "flow", {"flow_kind": kind, "id": shape["resourceId"], "target_ref": (shape.get("target") or {}).get("resourceId"), "label": self.name(shape) or None, "owner": owner}

    def node(self, shape: dict, kind: str, type_: str, lane: str | None, parent: str | None, expanded: bool = False) -> Iterator[Row]:
        key = (kind, shape["resourceId"])
        if parent is not None and key in self.known:  # contents of subprocesses count once
            return
        self.known.add(key)
        yield "node", {"kind": kind, "id": shape["resourceId"], "name": self.name(shape), "type": type_, "parent_subprocess": parent, "expanded": expanded, "seq": self.next()}
        yield from self.links(shape)
        if lane:
            yield "lane_member", {"lane_id": lane, "ref_id": shape["resourceId"]}

    def scope(self, shapes: list[dict], lane: str | None, parent: str | None) -> Iterator[Row]:
        for shape in shapes:
            stencil = shape["stencil"]["id"]
            kind = CLASS_OF.get(stencil)
            if kind is None:
                yield "warning", {"id": shape.get("resourceId"), "label": f"unknown shape {stencil}"}
            elif kind == "Pools":
                pool = shape["resourceId"]
                yield "pool", {"pool_id": pool, "name": self.name(shape), "seq": self.next()}
                yield from self.links(shape)
                for child in shape.get("childShapes", []):
                    if CLASS_OF.get(child["stencil"]["id"]) != "Lanes" or child.get("outgoing"):
                        raise ValueError("a pool may hold only lanes, and lanes have no outgoing flows")
                    yield "lane", {"pool_id": pool, "lane_id": child["resourceId"], "name": self.name(child), "seq": self.next()}
                    yield from self.scope(child.get("childShapes", []), child["resourceId"], parent)
            elif kind == "Activities":
                given = shape.get("properties", {}).get("tasktype")
                type_ = given if given and given != "None" else stencil
                if type_ in ("Subprocess", "EventSubprocess"):
                    yield from self.subprocess(shape, type_, lane, parent)
                else:
                    yield from self.node(shape, "activity", type_, lane, parent)
            elif kind == "Events":
                yield from self.node(shape, "event", stencil, lane, parent)
            elif kind == "Gateways":
                yield from self.node(shape, "gateway", GATEWAY_ALIASES.get(stencil.lower(), stencil), lane, parent)
            elif kind == "Sequence Flows" and parent is None:
                yield self.flow(shape, "sequence", None)
            elif kind == "Message Flows" and parent is None:
                yield self.flow(shape, "message", None)

    def subprocess(self, shape: dict, type_: str, lane: str | None, parent: str | None) -> Iterator[Row]:
        key, inside = shape["resourceId"], shape.get("childShapes", [])
        members = [c for c in inside if CLASS_OF.get(c["stencil"]["id"]) in ("Activities", "Events", "Gateways")]
        yield from self.scope(members, lane, key)
        yield from (("subprocess_member", {"subprocess_id": key, "ref_id": c["resourceId"]}) for c in members)
        yield from (self.flow(c, "subprocess", key) for c in inside if CLASS_OF.get(c["stencil"]["id"]) == "Sequence Flows")
        yield from self.node(shape, "activity", type_, lane, parent, True)


def parse(path: str, text: str | bytes) -> Iterator[Row]:
    """By the ending, in any case: ``.xml`` and ``.bpmn`` are XML, everything else is JSON."""
    if path.lower().rpartition(".")[2] in ("xml", "bpmn"):
        return XmlModel(text).rows()
    return EditorModel(text.decode("utf-8") if isinstance(text, bytes) else text).rows()
