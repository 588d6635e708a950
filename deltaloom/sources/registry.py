"""A schema registry: subjects, versions, compatibility, validation rules and inference. Metadata is small and lives in Python."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVELS = ("NONE", "BACKWARD", "BACKWARD_TRANSITIVE", "FORWARD", "FORWARD_TRANSITIVE", "FULL", "FULL_TRANSITIVE")
# What a reader of the second kind may read of the first.
PROMOTIONS = {("int", "long"), ("int", "float"), ("int", "double"), ("long", "float"), ("long", "double"), ("float", "double"), ("string", "bytes"), ("bytes", "string")}


def subject(strategy: str, topic: Column, record: Column | None = None, suffix: str = "value") -> Column:
    return {"topic": lambda: F.concat(topic, F.lit(f"-{suffix}")), "record": lambda: record, "topic_record": lambda: F.concat(topic, F.lit("-"), record)}[strategy]()


def canonical(schema: str, kind: str) -> str:
    return json.dumps(json.loads(schema), sort_keys=True, separators=(",", ":")) if kind in ("avro", "json") else re.sub(r"\s+", " ", schema).strip()


def fingerprint(schema: str, kind: str) -> tuple[str, str]:
    text = canonical(schema, kind).encode()
    return hashlib.md5(text).hexdigest(), hashlib.sha256(text).hexdigest()


# Avro: can `reader` read what `writer` wrote?


def _kind(s) -> str:
    return "union" if isinstance(s, list) else s["type"] if isinstance(s, dict) and isinstance(s["type"], str) else _kind(s["type"]) if isinstance(s, dict) else s


def avro_reads(reader, writer, at: str = "$") -> list[str]:
    r, w = _kind(reader), _kind(writer)
    if w == "union":
        if r == "union":
            return [m for b in writer if all(avro_reads(x, b) for x in reader) for m in [f"{at}: no branch reads {_kind(b)}"]]
        return [] if any(not avro_reads(reader, b) for b in writer) else [f"{at}: {r} reads no branch of the union"]
    if r == "union":
        return [] if any(not avro_reads(b, writer) for b in reader) else [f"{at}: no branch reads {w}"]
    if r != w:
        return [] if (w, r) in PROMOTIONS else [f"{at}: {w} is not read as {r}"]
    if r == "record":
        out, have = [], {f["name"]: f for f in writer["fields"]}
        for f in reader["fields"]:
            old = next((have[n] for n in [f["name"], *f.get("aliases", ())] if n in have), None)
            if old is None:
                out += [] if "default" in f else [f"{at}.{f['name']}: new field without a default"]
            else:
                out += avro_reads(f["type"], old["type"], f"{at}.{f['name']}")
        return out
    if r == "enum":
        lost = [x for x in writer["symbols"] if x not in reader["symbols"]]
        return [f"{at}: symbols {lost} are gone"] if lost else []
    if r == "fixed":
        return [] if reader["size"] == writer["size"] else [f"{at}: size differs"]
    if r in ("array", "map"):
        part = "items" if r == "array" else "values"
        return avro_reads(reader[part], writer[part], f"{at}[]")
    return []


# JSON Schema: does data of `old` still fit `new` (backward)?


def json_breaks(new: dict, old: dict, backward: bool, at: str = "$", depth: int = 0) -> list[str]:
    out = []
    if depth > 32 or not isinstance(new, dict) or not isinstance(old, dict):
        return out
    if new.get("type") != old.get("type") and "type" in new and "type" in old:
        out.append(f"{at}: type changed from {old['type']} to {new['type']}")
    np_, op = new.get("properties", {}), old.get("properties", {})
    if backward:
        out += [f"{at}.{n}: newly required" for n in new.get("required", ()) if n not in op]
    else:
        out += [f"{at}.{n}: required field is gone" for n in old.get("required", ()) if n not in np_]
    na, oa = new.get("additionalProperties", True) is not False, old.get("additionalProperties", True) is not False
    if (oa and not na) if backward else (na and not oa):
        out.append(f"{at}: additionalProperties changed")
    if "enum" in new and "enum" in old:
        lost = [v for v in (old if backward else new)["enum"] if v not in (new if backward else old)["enum"]]
        if lost:
            out.append(f"{at}: enum values {lost}")
    for n in np_.keys() & op.keys():
        out += json_breaks(np_[n], op[n], backward, f"{at}.{n}", depth + 1)
    for part in ("items", "additionalProperties"):
        if isinstance(new.get(part), dict) and isinstance(old.get(part), dict):
            out += json_breaks(new[part], old[part], backward, f"{at}.{part}", depth + 1)
    return out


# Protobuf, by the fields' numbers.


@dataclass
class Message:
    fields: dict[int, tuple[str, str, str]] = field(default_factory=dict)
    reserved: set = field(default_factory=set)
    enums: dict[str, dict[int, str]] = field(default_factory=dict)


def proto_parse(text: str) -> dict[str, Message]:
    text = re.sub(r"//[^\n]*|/\*.*?\*/", " ", text, flags=re.S)
    out: dict[str, Message] = {}

    def block(body: str, name: str) -> None:
        m = out.setdefault(name, Message())
        at = 0
        while found := re.compile(r"\b(message|enum|oneof)\s+(\w+)\s*\{").search(body, at):
            depth, end = 1, found.end()
            while depth and end < len(body):
                depth += {"{": 1, "}": -1}.get(body[end], 0)
                end += 1
            inner = body[found.end() : end - 1]
            if found[1] == "message":
                block(inner, f"{name}.{found[2]}".lstrip("."))
            elif found[1] == "enum":
                m.enums[found[2]] = {int(n): k for k, n in re.findall(r"(\w+)\s*=\s*(-?\d+)", inner)}
            body = body[: found.start()] + (inner if found[1] == "oneof" else " ") + body[end:]
            at = found.start()
        for r in re.findall(r"\breserved\s+([^;]+);", body):
            for part in r.split(","):
                part = part.strip()
                span = re.fullmatch(r"(\d+)\s+to\s+(\d+)", part)
                m.reserved |= set(range(int(span[1]), int(span[2]) + 1)) if span else {part.strip('"')} if part[:1] == '"' else {int(part)} if part.isdigit() else set()
        for label, kind, n, number in re.findall(r"(?:\b(required|optional|repeated)\s+)?\b((?:map\s*<[^>]*>)|[\w.]+)\s+(\w+)\s*=\s*(\d+)", body):
            if kind not in ("option", "syntax", "package"):
                m.fields[int(number)] = (n, re.sub(r"\s", "", kind), label)

    block(text, "")
    return out


def proto_breaks(new: str, old: str) -> list[str]:
    a, b, out = proto_parse(new), proto_parse(old), []
    for name in a.keys() & b.keys():
        n, o = a[name], b[name]
        for k in n.fields.keys() & o.fields.keys():
            if n.fields[k][:2] != o.fields[k][:2]:
                out.append(f"{name}: field {k} changed")
        out += [f"{name}: {x} is reserved" for k, f in n.fields.items() for x in (k, f[0]) if x in o.reserved]
        out += [f"{name}: required field {f[0]} removed" for k, f in o.fields.items() if f[2] == "required" and k not in n.fields]
        out += [f"{name}.{e}: number {k} removed" for e in n.enums.keys() & o.enums.keys() for k in o.enums[e].keys() - n.enums[e].keys()]
    return out


def compatible(level: str, kind: str, new: str, existing: list[str]) -> list[str]:
    """What breaks, oldest first; the non-transitive levels look at the newest version only."""
    if level == "NONE":
        return []
    out = []
    for old in existing if level.endswith("TRANSITIVE") else existing[-1:]:
        back, fore = level.startswith(("BACKWARD", "FULL")), level.startswith(("FORWARD", "FULL"))
        if kind == "protobuf":
            out += proto_breaks(new, old)
            continue
        a, b = json.loads(new), json.loads(old)
        if kind == "avro":
            out += (avro_reads(a, b) if back else []) + (avro_reads(b, a) if fore else [])
        else:
            out += (json_breaks(a, b, True) if back else []) + (json_breaks(a, b, False) if fore else [])
    return out


@dataclass
class Rule:
    """kind: regex, forbid, field_required, field_type, max_size, naming; level: error, warning or info."""

    name: str
    kind: str
    value: object
    level: str = "error"


def validate(rules: list[Rule], schema: str, kind: str = "avro") -> list[tuple[str, str]]:
    """(level, rule) of each rule that the schema breaks."""
    try:
        parsed = json.loads(schema) if kind in ("avro", "json") else {}
    except ValueError:
        return [("error", "syntax")]
    parsed = parsed if isinstance(parsed, dict) else {}
    fields = {f["name"]: f["type"] for f in parsed.get("fields", ())} | {n: p.get("type") for n, p in parsed.get("properties", {}).items()}
    good = {
        "regex": lambda v: re.search(v, schema) is not None,
        "forbid": lambda v: re.search(v, schema) is None,
        "field_required": lambda v: v in fields or v in parsed,
        "field_type": lambda v: fields.get(v[0], v[1]) == v[1],
        "max_size": lambda v: len(schema.encode()) <= v,
        "naming": lambda v: re.fullmatch(v, parsed.get("name", parsed.get("title", ""))) is not None,
    }
    return [(r.level, r.name) for r in rules if not good[r.kind](r.value)]


PRODUCTION = (Rule("max size", "max_size", 64 * 1024), Rule("documented", "field_required", "doc", "warning"), Rule("namespace", "field_required", "namespace", "warning"), Rule("pascal case", "naming", r"[A-Z][A-Za-z0-9]*", "warning"))


@dataclass
class Version:
    id: int
    version: int
    kind: str
    schema: str
    state: str = "enabled"
    references: tuple = ()
    deleted: bool = False


class Registry:
    def __init__(self, level: str = "BACKWARD", rules: list[Rule] | None = None):
        self.level, self.rules = level, list(rules or ())
        self.subjects: dict[str, list[Version]] = {}
        self.levels: dict[str, str] = {}
        self.ids: dict[tuple, int] = {}

    def register(self, name: str, schema: str, kind: str = "avro", references=()) -> int:
        """The id; a schema that the subject has already keeps its own. ValueError where a rule or the level forbids it."""
        key = (kind, fingerprint(schema, kind)[1])
        have = self.subjects.setdefault(name, [])
        for v in have:
            if not v.deleted and (v.kind, fingerprint(v.schema, v.kind)[1]) == key:
                return v.id
        if broken := [n for level, n in validate(self.rules, schema, kind) if level == "error"]:
            raise ValueError(f"rules broken: {broken}")
        if why := self.check(name, schema, kind):
            raise ValueError(f"incompatible: {why}")
        id_ = self.ids.setdefault(key, len(self.ids) + 1)
        have.append(Version(id_, max((v.version for v in have), default=0) + 1, kind, schema, references=tuple(references)))
        return id_

    def check(self, name: str, schema: str, kind: str = "avro") -> list[str]:
        old = [v.schema for v in self.subjects.get(name, ()) if not v.deleted and v.state != "disabled"]
        return compatible(self.levels.get(name, self.level), kind, schema, old)

    def by_id(self, id_: int) -> Version | None:
        return next((v for vs in self.subjects.values() for v in vs if v.id == id_), None)

    def get(self, name: str, version: int | None = None) -> Version | None:
        live = [v for v in self.subjects.get(name, ()) if not v.deleted]
        return (live[-1] if live else None) if version is None else next((v for v in live if v.version == version), None)

    def versions(self, name: str) -> list[int]:
        return [v.version for v in self.subjects.get(name, ()) if not v.deleted]

    def names(self, context: str | None = None) -> list[str]:
        return sorted(n for n, vs in self.subjects.items() if any(not v.deleted for v in vs) and (context is None or n.startswith(f":.{context}:")))

    def delete(self, name: str, version: int | None = None, permanent: bool = False) -> list[int]:
        gone = [v for v in self.subjects.get(name, ()) if version in (None, v.version)]
        for v in gone:
            v.deleted = True
        if permanent and name in self.subjects:
            self.subjects[name] = [v for v in self.subjects[name] if v not in gone]
        return [v.version for v in gone]

    def undelete(self, name: str) -> None:
        for v in self.subjects.get(name, ()):
            v.deleted = False

    def set_state(self, name: str, version: int, state: str) -> None:
        if state not in ("enabled", "deprecated", "disabled"):
            raise ValueError(state)
        self.get(name, version).state = state

    def referencing(self, name: str, version: int) -> list[tuple[str, int]]:
        return sorted((n, v.version) for n, vs in self.subjects.items() for v in vs if (name, version) in v.references and not v.deleted)


def infer(samples: list) -> dict:
    """A JSON schema of sample values: integers widen to numbers, others that differ become a list of types; fields that all samples have are required."""
    kinds = []
    for s in samples:
        k = "null" if s is None else "boolean" if isinstance(s, bool) else "integer" if isinstance(s, int) else "number" if isinstance(s, float) else "string" if isinstance(s, str) else "array" if isinstance(s, list) else "object"
        if k not in kinds:
            kinds.append(k)
    if "number" in kinds and "integer" in kinds:
        kinds.remove("integer")
    out: dict = {"type": kinds[0] if len(kinds) == 1 else sorted(kinds)}
    objects = [s for s in samples if isinstance(s, dict)]
    if objects:
        names = sorted({n for o in objects for n in o})
        out["properties"] = {n: infer([o[n] for o in objects if n in o]) for n in names}
        out["required"] = [n for n in names if all(n in o and o[n] is not None for o in objects)]
    lists = [x for s in samples if isinstance(s, list) for x in s]
    if lists:
        out["items"] = infer(lists)
    return out
