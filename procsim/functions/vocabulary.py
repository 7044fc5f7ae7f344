"""Types of model elements: canonical names and classes (O-10, O-12, O-13, O-20a, O-46a, O-46b)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values, given by the BPMN 2.0 and diagram-editor formats.
ACTIVITY_TAGS = {
    "task": "Task", "sendTask": "Send", "receiveTask": "Receive", "userTask": "User", "manualTask": "Manual",
    "serviceTask": "Service", "businessRuleTask": "Business Rule", "scriptTask": "Script",
}
GATEWAY_TAGS = ("exclusiveGateway", "parallelGateway", "inclusiveGateway", "eventBasedGateway", "complexGateway")
GATEWAY_ALIASES = {
    "exclusive": "Exclusive", "parallel": "Parallel", "inclusive": "Inclusive", "eventbased": "Eventbased", "complex": "Complex",
    "and": "Parallel", "xor": "Exclusive", "or": "Inclusive",
    "parallelgateway": "Parallel", "exclusive_databased_gateway": "Exclusive", "inclusivegateway": "Inclusive",
    "eventbasedgateway": "Eventbased", "complexgateway": "Complex", "exclusivegateway": "Exclusive",
}
#: event tag -> {definition: type}; "" is no definition, or one that isn't listed.
EVENT_TYPES = {
    "startEvent": {
        "": "StartNoneEvent", "timer": "StartTimerEvent", "message": "StartMessageEvent", "conditional": "StartNoneEvent",
        "signal": "StartNoneEvent", "escalation": "StartNoneEvent", "error": "StartNoneEvent",
    },
    "endEvent": {
        "": "EndNoneEvent", "message": "EndMessageEvent", "escalation": "EndEscalationEvent", "cancel": "EndCancelEvent",
        "terminate": "EndNoneEvent", "error": "EndNoneEvent", "signal": "EndNoneEvent",
    },
    "intermediateCatchEvent": {
        "": "IntermediateMessageEventCatching", "message": "IntermediateMessageEventCatching", "signal": "IntermediateMessageEventCatching",
        "timer": "IntermediateTimerEvent", "conditional": "IntermediateConditionalEvent", "escalation": "IntermediateEscalationEvent",
        "error": "IntermediateErrorEvent", "cancel": "IntermediateCancelEvent", "link": "IntermediateLinkEventCatching",
    },
    "intermediateThrowEvent": {
        "": "IntermediateMessageEventThrowing", "message": "IntermediateMessageEventThrowing", "signal": "IntermediateMessageEventThrowing",
        "escalation": "IntermediateEscalationEvent", "link": "IntermediateLinkEventThrowing", "multiple": "IntermediateMultipleEventThrowing",
    },
    "boundaryEvent": {
        "": "IntermediateMessageEventCatching", "message": "IntermediateMessageEventCatching", "signal": "IntermediateMessageEventCatching",
        "timer": "IntermediateTimerEvent", "error": "IntermediateErrorEvent", "escalation": "IntermediateEscalationEvent",
        "cancel": "IntermediateCancelEvent",
    },
}
STENCILS = {
    "Diagram": ("BPMNDiagram",),
    "Activities": ("Task", "CollapsedSubprocess", "Subprocess", "CollapsedEventSubprocess", "EventSubprocess"),
    "Gateways": ("Exclusive_Databased_Gateway", "EventbasedGateway", "ParallelGateway", "InclusiveGateway", "ComplexGateway"),
    "Pools": ("Pool", "CollapsedPool", "VerticalPool", "CollapsedVerticalPool"),
    "Lanes": ("Lane", "VerticalLane"),
    "Artifacts": ("processparticipant", "Group", "TextAnnotation", "ITSystem"),
    "Data Elements": ("DataObject", "DataStore", "Message"),
    "Events": (
        "StartNoneEvent", "StartMessageEvent", "StartTimerEvent", "StartEscalationEvent", "StartConditionalEvent", "StartErrorEvent",
        "StartCompensationEvent", "StartSignalEvent", "StartMultipleEvent", "StartParallelMultipleEvent",
        "IntermediateMessageEventCatching", "IntermediateTimerEvent", "IntermediateEscalationEvent", "IntermediateConditionalEvent",
        "IntermediateLinkEventCatching", "IntermediateErrorEvent", "IntermediateCancelEvent", "IntermediateCompensationEventCatching",
        "IntermediateSignalEventCatching", "IntermediateMultipleEventCatching", "IntermediateParallelMultipleEventCatching",
        "IntermediateEvent", "IntermediateMessageEventThrowing", "IntermediateEscalationEventThrowing", "IntermediateLinkEventThrowing",
        "IntermediateCompensationEventThrowing", "IntermediateSignalEventThrowing", "IntermediateMultipleEventThrowing",
        "EndNoneEvent", "EndMessageEvent", "EndEscalationEvent", "EndErrorEvent", "EndCancelEvent", "EndCompensationEvent",
        "EndSignalEvent", "EndMultipleEvent", "EndTerminateEvent",
    ),
    "Sequence Flows": ("SequenceFlow",),
    "Associations": ("Association_Undirected", "Association_Unidirectional", "Association_Bidirectional"),
    "Message Flows": ("MessageFlow",),
}
# Shapes that play no part in a net, in lower case.
NO_PART = (
    "sequenceflow", "messageflow", "dataobject", "pool", "lane", "textannotation", "association_undirected",
    "association_bidirectional", "association_unidirectional", "group", "collapsedpool", "itsystem", "datastore",
)
# Labels that don't make an event visible in traces, in lower case.
GENERIC_EVENTS = ("startevent", "endevent", "intermediatethrowevent", "intermediatecatchevent", "boundaryevent", "event")


def lookup(pairs: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), key)


def stencil_class(stencil: Column) -> Column:
    """The class of a diagram-editor shape; null for unknown ones."""
    return lookup({s: c for c, names in STENCILS.items() for s in names}, stencil)


def gateway_type(raw: Column) -> Column:
    """The canonical gateway type of an alias in any case; other values stay."""
    return F.coalesce(lookup(GATEWAY_ALIASES, F.lower(F.trim(raw))), raw)


def event_type(tag: Column, definition: Column) -> Column:
    """The type of an event by its tag and its definition's name without ``EventDefinition`` (null: none)."""
    known = {f"{t}:{d}": v for t, by in EVENT_TYPES.items() for d, v in by.items()}
    exact = lookup(known, F.concat(tag, F.lit(":"), F.coalesce(definition, F.lit(""))))
    return F.coalesce(exact, lookup(known, F.concat(tag, F.lit(":"))), F.lit("StartNoneEvent"))


def activity_type(kind: Column) -> Column:
    """For comparison, a collapsed subprocess is a subprocess."""
    return F.when(kind == "CollapsedSubprocess", "Subprocess").when(kind == "CollapsedEventSubprocess", "EventSubprocess").otherwise(kind)


def clean_name(raw: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), "\n", " "))


def net_role(kind: Column) -> Column:
    """EVENT, GATEWAY, TASK or IRRELEVANT. The order of tests matters: ``Eventbased`` and ``EventSubprocess`` count as events."""
    low = F.lower(F.coalesce(kind, F.lit("")))
    in_any = lambda words: F.greatest(*[low.contains(w) for w in words])
    return (
        F.when(low.contains("event"), "EVENT")
        .when(low.contains("gateway") | low.isin("exclusive", "inclusive", "parallel", "complex", "eventbased"), "GATEWAY")
        .when(in_any(("task", "subprocess", "callactivity", "transaction")), "TASK")
        .when(in_any(NO_PART), "IRRELEVANT")
        .when(low != "", "TASK")
        .otherwise("IRRELEVANT")
    )


def is_choice(kind: Column) -> Column:
    low = F.lower(F.coalesce(kind, F.lit("")))
    return low.contains("exclusive") | low.contains("inclusive") | low.contains("eventbased")
