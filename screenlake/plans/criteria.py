"""Criteria as a small predicate language, kept on the driver: a protocol has a few dozen."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

from screenlake.functions.dates import RELATIONS, UNITS

OPS = ("<", "<=", ">", ">=", "==", "!=", "between")
ANCHORS = ("screening", "enrollment", "randomization", "diagnosis", "last_dose")
PRESENCE = ("condition", "medication", "procedure")
#: Deeper trees are compiled to an unsupported predicate.
MAX_DEPTH = 4


@dataclass(frozen=True)
class Window:
    relation: str = "ever"
    amount: int | None = None
    unit: str | None = None
    anchor: str = "screening"

    def __post_init__(self):
        relative = self.relation in ("within", "before", "after")
        if self.relation not in RELATIONS or relative != (self.amount is not None and self.unit in UNITS) or (relative and self.amount <= 0):
            raise ValueError(f"not a window: {self}")


@dataclass(frozen=True)
class Concept:
    text: str
    codes: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Observation:
    concept: Concept
    op: str
    value: float
    unit: str
    value_high: float | None = None
    window: Window | None = None
    type = "observation"

    def __post_init__(self):
        if self.op not in OPS or (self.op == "between") != (self.value_high is not None) or (self.value_high is not None and self.value_high < self.value):
            raise ValueError(f"not a comparison: {self}")


@dataclass(frozen=True)
class Presence:
    type: str
    concept: Concept
    presence: str = "present"
    window: Window | None = None

    def __post_init__(self):
        if self.type not in PRESENCE or self.presence not in ("present", "absent"):
            raise ValueError(f"not a presence test: {self}")


@dataclass(frozen=True)
class Demographic:
    field: str
    op: str
    value: float | str
    type = "demographic"

    def __post_init__(self):
        if self.field not in ("age", "sex") or self.op not in (OPS[:-1] if self.field == "age" else ("==", "!=")):
            raise ValueError(f"not a demographic test: {self}")


@dataclass(frozen=True)
class Unsupported:
    reason: str
    settlement: str = "from_data"
    type = "unsupported"


@dataclass(frozen=True)
class Composite:
    type: str
    operands: tuple

    def __post_init__(self):
        if self.type not in ("all_of", "any_of", "not") or (len(self.operands) != 1 if self.type == "not" else len(self.operands) < 2):
            raise ValueError(f"not a composite: {self.type} of {len(self.operands)}")


@dataclass(frozen=True)
class Criterion:
    id: str
    kind: str
    predicate: object
    quote: str = ""


@dataclass(frozen=True)
class Protocol:
    nct_id: str
    criteria: tuple[Criterion, ...] = field(default_factory=tuple)

    def __post_init__(self):
        ids = [c.id for c in self.criteria]
        if len(set(ids)) != len(ids) or any(c.kind not in ("inclusion", "exclusion") for c in self.criteria):
            raise ValueError("criterion ids must be unique and kinds inclusion or exclusion")


def leaves(predicate) -> Iterator:
    """Predicates that look something up, in order."""
    if isinstance(predicate, Composite):
        for x in predicate.operands:
            yield from leaves(x)
    else:
        yield predicate


def concepts(protocol: Protocol) -> list[Concept]:
    """Distinct concepts by text, the first spelling wins."""
    found: dict[str, Concept] = {}
    for c in protocol.criteria:
        for leaf in leaves(c.predicate):
            if (concept := getattr(leaf, "concept", None)) is not None:
                found.setdefault(concept.text, concept)
    return list(found.values())


def with_codes(protocol: Protocol, codes: dict[str, tuple[tuple[str, str], ...]]) -> Protocol:
    """The protocol with the codes that are known for the text of each concept; other concepts stay as they are."""
    def coded(p):
        if isinstance(p, Composite):
            return replace(p, operands=tuple(coded(x) for x in p.operands))
        concept = getattr(p, "concept", None)
        return p if concept is None or concept.text not in codes else replace(p, concept=Concept(concept.text, tuple(codes[concept.text])))

    return replace(protocol, criteria=tuple(replace(c, predicate=coded(c.predicate)) for c in protocol.criteria))


def unsupported_counts(protocol: Protocol) -> tuple[int, int]:
    """Criteria with an unsupported part at the top, and those of them that block."""
    own = [c.predicate for c in protocol.criteria if isinstance(c.predicate, Unsupported)]
    return len(own), sum(p.settlement != "at_visit" for p in own)


def from_dict(node: dict, depth: int = 0):
    """A predicate from its JSON form."""
    kind, window = node["type"], node.get("window")
    window = Window(**window) if window else None
    concept = Concept(node["concept"]["text"], tuple((c["system"], c["code"]) for c in node["concept"].get("codes", ()))) if node.get("concept") else None
    if kind in ("all_of", "any_of", "not"):
        if depth >= MAX_DEPTH:
            return Unsupported("nested too deeply to be formalised")
        return Composite(kind, tuple(from_dict(x, depth + 1) for x in node["operands"]))
    if kind == "observation":
        return Observation(concept, node["op"], node["value"], node["unit"], node.get("value_high"), window)
    if kind in PRESENCE:
        return Presence(kind, concept, node.get("presence", "present"), window)
    if kind == "demographic":
        return Demographic(node["field"], node["op"], node["value"])
    return Unsupported(node.get("reason", ""), node.get("settlement", "from_data"))


def read_protocol(text: str) -> Protocol:
    """A protocol from JSON: nct_id and criteria with id, kind, predicate and quote."""
    data = json.loads(text)
    return Protocol(data["nct_id"], tuple(Criterion(c["id"], c["kind"], from_dict(c["predicate"]), c.get("quote", "")) for c in data["criteria"]))


def render(p) -> str:
    """A predicate in plain words, for a reader to check."""
    def span(w: Window | None, verb: str) -> str:
        if w is None or w.relation == "ever":
            return f"{verb} at any time"
        if w.relation == "current":
            return f"{verb} currently"
        words = {"within": f"in the {w.amount} {w.unit} up to", "before": f"more than {w.amount} {w.unit} before", "after": f"less than {w.amount} {w.unit} before"}
        return f"{verb} {words[w.relation]} {w.anchor}"

    match p:
        case Composite(type="not"):
            return f"not ({render(p.operands[0])})"
        case Composite():
            return (" and " if p.type == "all_of" else " or ").join(f"({render(x)})" if isinstance(x, Composite) else render(x) for x in p.operands)
        case Observation():
            bound = f"between {p.value:g} and {p.value_high:g}" if p.op == "between" else f"{p.op} {p.value:g}"
            return f"latest {p.concept.text} {bound} {p.unit}, {span(p.window, 'measured')}"
        case Presence():
            return f"{p.type} {p.concept.text} {'' if p.presence == 'present' else 'not '}{span(p.window, 'documented')}"
        case Demographic():
            return f"{p.field} {p.op} {p.value}"
        case _:
            return f"not formalised: {p.reason}"
