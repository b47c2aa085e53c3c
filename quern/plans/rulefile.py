"""Rule files: text declarations, read into the records that ``records.Program`` loads.

A file is a list of declarations, each a header line and an indented body. Conditions are texts of the
expression language and are checked when they are read. Steps are calls (``action {key: value} -> $name``),
``when ...:`` blocks, ``let``, ``emit`` and ``return``, or a block of code in braces with the same
statements; ``if c { a } else { b }`` is a value.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from quern.functions import px
from quern.plans.records import PRIORITY


class RuleError(ValueError):
    """A rule file that cannot be read."""


@dataclass
class Line:
    number: int
    text: str
    body: list["Line"] = field(default_factory=list)

    def fail(self, why: str) -> RuleError:
        return RuleError(f"line {self.number}: {why}: {self.text!r}")


SEVERITIES = ("error", "warning", "info")
MODES = ("deterministic", "probabilistic", "hybrid")
EVENTS = ("after_store", "before_search", "timer")
_NAME = r"[A-Za-z_]\w*"
_TYPE = r"[A-Za-z_][\w.]*(?:[\[(<].*[\])>])?"


def lines(text: str) -> list[Line]:
    """The lines of a file as a tree by indentation; blank lines and comments are left out, code blocks are one line."""
    root: list[Line] = []
    levels: list[tuple[int, list[Line]]] = [(-1, root)]
    open_: Line | None = None
    for number, raw in enumerate(text.splitlines(), 1):
        stripped = raw.strip()
        if open_ is not None:  # inside of a code block or a long text
            open_.text += "\n" + stripped
            if _closed(open_.text):
                open_ = None
            continue
        if not stripped or stripped.startswith(("#", "//")):
            continue
        indent = len(raw) - len(raw.lstrip())
        while levels[-1][0] >= indent:
            levels.pop()
        line = Line(number, stripped)
        levels[-1][1].append(line)
        levels.append((indent, line.body))
        if not _closed(stripped):
            open_ = line
    if open_ is not None:
        raise open_.fail("not closed")
    return root


def _closed(text: str) -> bool:
    bare = re.sub(r'"(?:[^"\\]|\\.)*"', "", text.replace('"""', ""))
    return text.count('"""') % 2 == 0 and bare.count("{") <= bare.count("}")


# ---------------------------------------------------------------------------- values


class _Values:
    """Literals, ``$names``, lists and objects; bare words are texts, or variables in code."""

    TOKEN = re.compile(rf'\s*("(?:[^"\\]|\\.)*"|-?\d+(?:\.\d+)?|\$?{_NAME}(?:\.{_NAME})*|[\[\]{{}},:])')

    def __init__(self, text: str, line: Line, code: bool = False):
        self.tokens, at, self.line, self.code = [], 0, line, code
        while text[at:].strip():
            m = self.TOKEN.match(text, at)
            if not m:
                raise line.fail(f"cannot read {text[at:]!r}")
            self.tokens.append(m[1])
            at = m.end()
        self.at = 0

    def take(self, wanted: str | None = None) -> str:
        if self.at >= len(self.tokens) or wanted not in (None, self.tokens[self.at]):
            raise self.line.fail(f"expected {wanted or 'a value'}")
        self.at += 1
        return self.tokens[self.at - 1]

    def peek(self, token: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at] == token

    def value(self) -> Any:
        t = self.take()
        if t == "{":
            return self.pairs("}")
        if t == "[":
            out = []
            while not self.peek("]"):
                out.append(self.value())
                if not self.peek("]"):
                    self.take(",")
            self.take("]")
            return out
        if t[0] == '"':
            return _unquoted(t)
        if re.fullmatch(r"-?\d+", t):
            return int(t)
        if re.fullmatch(r"-?\d+\.\d+", t):
            return float(t)
        if t in ("true", "false", "null"):
            return {"true": True, "false": False, "null": None}[t]
        if not re.match(r"[$A-Za-z_]", t):
            raise self.line.fail(f"{t!r} is not a value")
        return f"${t}" if self.code and t[0] != "$" else t

    def pairs(self, end: str | None) -> dict[str, Any]:
        out = {}
        while self.at < len(self.tokens) and not (end and self.peek(end)):
            key = self.take()
            if not re.fullmatch(_NAME, key):
                raise self.line.fail(f"{key!r} is not a name")
            self.take(":")
            out[key] = self.value()
            if end and not self.peek(end):
                self.take(",")
        if end:
            self.take(end)
        return out


def _unquoted(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1])


def _value(text: str, line: Line, code: bool = False) -> Any:
    v = _Values(text, line, code)
    out = v.value()
    if v.at < len(v.tokens):
        raise line.fail("more than a value")
    return out


def _text(text: str, line: Line) -> str:
    out = _value(text, line)
    if not isinstance(out, str) or not text.strip().startswith('"'):
        raise line.fail("expected a text")
    return out


def _number(text: str, line: Line) -> float:
    out = _value(text, line)
    if isinstance(out, bool) or not isinstance(out, (int, float)):
        raise line.fail("expected a number")
    return out


def _expression(text: str, line: Line) -> str:
    """Checked text of an expression; ``if c { a } else { b }`` becomes a choice."""
    text = re.sub(r"\bif\s+(.+?)\s*\{\s*(.+?)\s*\}\s*else\s*\{\s*(.+?)\s*\}", r"((\1) ? (\2) : (\3))", text.strip(), flags=re.S)
    try:
        px.parse(text)
    except px.PxError as e:
        raise line.fail(str(e)) from None
    return text


# ---------------------------------------------------------------------------- bodies


def _entries(line: Line, known: dict[str, str]) -> dict[str, tuple[str, Line]]:
    """``key: value`` lines of a body by key; each key is of a kind: "block" has lines of its own below."""
    out = {}
    for x in line.body:
        m = re.match(rf"({_NAME})\s*:\s*(.*)$", x.text, re.S)
        if not m or m[1] not in known or m[1] in out:
            raise x.fail("not expected here")
        if (known[m[1]] == "block") != (not m[2]):
            raise x.fail("a block belongs here" if not m[2] else "no block belongs here")
        out[m[1]] = (m[2], x)
    return out


def _fields(line: Line) -> list[dict[str, str]]:
    out = []
    for x in line.body:
        m = re.fullmatch(rf"({_NAME})\s*:\s*({_TYPE})", x.text)
        if not m:
            raise x.fail("expected a field and its type")
        out.append({"name": m[1], "type": m[2]})
    return out


def _items(line: Line) -> list[Line]:
    """Lines ``- ...`` without their dash."""
    for x in line.body:
        if not x.text.startswith("- "):
            raise x.fail("expected an item")
    return [Line(x.number, x.text[2:].strip(), x.body) for x in line.body]


def _params(text: str, line: Line, queues: bool = False) -> list[dict[str, str]]:
    out = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        m = re.fullmatch(rf'({_NAME})\s*:\s*({_TYPE})(?:\s+from\s+"([^"]+)")?', part)
        if not m or bool(m[3]) != queues:
            raise line.fail(f"{part!r} is not a parameter")
        out.append({"name": m[1], "type": m[2]} | ({"from": m[3]} if queues else {}))
    return out


def steps(body: list[Line]) -> list[dict]:
    out: list[dict] = []
    for x in body:
        t = x.text
        if t == "end":
            if not out or out[-1]["kind"] != "when":
                raise x.fail("nothing to end")
        elif m := re.fullmatch(r"when\s+(.+):", t):
            out.append({"kind": "when", "condition": _expression(m[1], x), "steps": steps(x.body)})
        elif t.startswith("{"):
            out += _code(t[1:-1], x)
        elif m := re.fullmatch(r"return\s+(.+)", t, re.S):
            out.append({"kind": "return", "expr": _expression(m[1], x)})
        elif m := re.fullmatch(rf"let\s+\$?({_NAME})\s*=\s*(.+)", t, re.S):
            out.append({"kind": "define", "name": m[1], "expr": _expression(m[2], x)})
        elif m := re.fullmatch(rf"({_NAME})\s*(\{{.*\}})\s*(?:->\s*\$({_NAME}))?", t, re.S):
            call = {"kind": "call", "name": m[1], "params": _value(m[2], x)}
            out.append(call | ({"output": m[3]} if m[3] else {}))
        else:
            raise x.fail("not a step")
    return out


def _code(text: str, line: Line) -> list[dict]:
    """Statements of a code block, each ended by a semicolon."""
    out = []
    for s in filter(None, (p.strip() for p in text.split(";"))):
        if m := re.fullmatch(rf"let\s+({_NAME})\s*=\s*(.+)", s, re.S):
            out.append({"kind": "define", "name": m[1], "expr": _expression(m[2], line)})
        elif m := re.fullmatch(r"emit\s*\((.+)\)", s, re.S):
            data = _value(m[1], line, True)
            kind = data.pop("kind", "event") if isinstance(data, dict) else "event"
            out.append({"kind": "emit", "event": kind.lstrip("$"), "data": data})
        elif m := re.fullmatch(r"return\s+(\{.+\})", s, re.S):
            out.append({"kind": "return", "value": _value(m[1], line, True)})
        elif m := re.fullmatch(r"return\s+(.+)", s, re.S):
            out.append({"kind": "return", "expr": _expression(m[1], line)})
        else:
            raise line.fail(f"not a statement: {s!r}")
    return out


# ---------------------------------------------------------------------------- declarations


def _rule(name: str, line: Line) -> dict:
    e = _entries(line, {"priority": "value", "when": "block", "then": "block"})
    actions = []
    for x in _items(e["then"][1]) if "then" in e else []:
        data = _Values(x.text, x).pairs(None)
        if "action" not in data:
            raise x.fail("no action")
        actions.append({"kind": data.pop("action"), **data})
    conditions = [_expression(x.text, x) for x in _items(e["when"][1])] if "when" in e else []
    return {"type": "rule", "name": name, "priority": int(_number(*e["priority"])) if "priority" in e else PRIORITY, "conditions": conditions, "actions": actions}


def _constraint(name: str, line: Line) -> dict:
    e = _entries(line, dict.fromkeys(("scope", "phase", "trait", "weight", "prompt", "when", "require", "severity", "message"), "value"))
    severity = e["severity"][0] if "severity" in e else "error"
    if severity not in SEVERITIES:
        raise e["severity"][1].fail("not a severity")
    out = {"type": "constraint", "name": name, "severity": severity, "phases": [p.strip() for p in e["phase"][0].split(",")] if "phase" in e else []}
    out |= {k: e[f][0] for k, f in (("scope", "scope"), ("trait_category", "trait")) if f in e}
    out |= {k: _text(*e[f]) for k, f in (("prompt_injection", "prompt"), ("message", "message")) if f in e}
    out |= {k: _expression(*e[k]) for k in ("when", "require") if k in e}
    return out | ({"weight": _number(*e["weight"])} if "weight" in e else {})


def _contract(name: str, line: Line) -> dict:
    e = _entries(line, {"given": "value", "when": "value", "then": "value", "threshold": "value", "examples": "block"})
    examples = []
    for x in _items(e["examples"][1]) if "examples" in e else []:
        parts = _entries(Line(x.number, x.text, [Line(x.number, x.text), *x.body]), {"input": "value", "expect": "value", "threshold": "value"})
        examples.append({k: _value(*v) for k, v in parts.items()})
    out = {"type": "contract", "name": name, "examples": examples} | {k: _text(*e[k]) for k in ("given", "when", "then") if k in e}
    return out | ({"threshold": _number(*e["threshold"])} if "threshold" in e else {})


def _trigger(name: str, line: Line) -> dict:
    e = _entries(line, {"on": "value", "schedule": "value", "run": "value"})
    if "on" not in e or "run" not in e:
        raise line.fail("a trigger needs on and run")
    m = re.fullmatch(r'on_event\("([^"]+)"\)', e["on"][0])
    if not m and e["on"][0] not in EVENTS:
        raise e["on"][1].fail("not an event")
    out = {"type": "trigger", "name": name, "on": m[1] if m else e["on"][0], "run": e["run"][0]}
    return out | ({"schedule": _text(*e["schedule"])} if "schedule" in e else {})


def _function(name: str, params: str, returns: str, line: Line) -> dict:
    doc = [x for x in line.body if x.text.startswith('"""')]
    e = _entries(Line(line.number, line.text, [x for x in line.body if x not in doc]), {"mode": "value"})
    mode = e["mode"][0] if "mode" in e else MODES[0]
    if mode not in MODES:
        raise e["mode"][1].fail("not a mode")
    return {"type": "function", "name": name, "mode": mode, "params": _params(params, line), "return_type": returns, "docstring": doc[0].text.strip('"').strip() if doc else ""}


def _procedure(name: str, line: Line) -> dict:
    out: dict = {"type": "procedure", "name": name, "params": []}
    rest = []
    for x in line.body:
        if not rest and (m := re.match(r"(trigger|params|given)\s*:\s*(.+)$", x.text)):
            if m[1] == "trigger":
                event = re.fullmatch(r'on_event\("([^"]+)"\)', m[2])
                out["trigger"] = {"kind": event[1] if event else m[2]}
            elif m[1] == "params":
                out["params"] = [p.lstrip("$") for p in _value(m[2], x)]
            else:
                out["given"] = _text(m[2], x)
        else:
            rest.append(x)
    return out | {"steps": steps(rest)}


def _scenario(name: str, line: Line) -> dict:
    e = _entries(line, {"given": "value", "setup": "block", "run": "value", "expect": "block"})
    made = steps(e["setup"][1].body) if "setup" in e else []
    if "run" in e:
        made.append({"kind": "call", "name": e["run"][0], "params": {}})
    expect = []
    for x in _items(e["expect"][1]) if "expect" in e else []:
        m = re.fullmatch(rf"(NOT\s+)?({_NAME})\s*(\{{.*\}})?", x.text)
        if not m:
            raise x.fail("not an expectation")
        params = _value(m[3], x) if m[3] else {}
        if m[2] == "event_emitted" and "kind" in params:
            params["event"] = params.pop("kind")
        expect.append({"check": m[2], "params": params} | ({"not": True} if m[1] else {}))
    return {"type": "scenario", "name": name, "steps": made, "expect": expect} | ({"description": _text(*e["given"])} if "given" in e else {})


_BODIES = {"rule": _rule, "constraint": _constraint, "contract": _contract, "trigger": _trigger, "procedure": _procedure, "scenario": _scenario}


def _declaration(line: Line) -> dict | None:
    t = line.text
    if m := re.fullmatch(rf"import\s+({_NAME}(?:::{_NAME})*)(?:\s+as\s+({_NAME}))?", t):
        return {"type": "import", "path": m[1]} | ({"alias": m[2]} if m[2] else {})
    if m := re.fullmatch(rf"(\w+)\s+({_NAME})\s*:", t):
        if m[1] in _BODIES:
            return _BODIES[m[1]](m[2], line)
        if m[1] == "fact":
            return {"type": "fact", "name": m[2], "fields": _fields(line)}
        if m[1] == "entity":  # checked, but no record
            e = _entries(line, {"prefix": "value", "fields": "block"})
            return None if "fields" not in e else _fields(e["fields"][1]) and None
        if m[1] == "config":
            return None
    if m := re.fullmatch(rf"function\s+({_NAME})\s*\((.*)\)\s*->\s*({_TYPE})\s*:", t):
        return _function(m[1], m[2], m[3], line)
    if m := re.fullmatch(rf'procedure\s+({_NAME})\s*\((.*)\)\s*->\s*({_NAME})\s+into\s+"([^"]+)"\s*:', t):
        inputs = _params(m[2], line, True)
        return _procedure(m[1], line) | {"params": [p["name"] for p in inputs], "inputs": inputs, "output": {"name": m[3], "into": m[4]}}
    raise line.fail("not a declaration")


def read(text: str) -> list[dict]:
    """Records of a rule file."""
    out = []
    for line in lines(text):
        data = _declaration(line)
        if data is not None:
            out.append({"key": f"px:{data['type']}/{data.get('name') or data.get('alias') or data['path']}", "data": data})
    return out
