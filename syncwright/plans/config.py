"""Strict configuration: JSON to syncs, with all that is wrong reported at once.

SHAPES says what each object may hold, RELATIONS what has to fit together across objects;
`parsed` reads by the one, checks the other, and reports what both find.  A member that
is absent, null, empty or zero has its default.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from ..functions.transforms import TRANSFORMS
from ..operators.conflict import POLICIES
from ..operators.identity import POLICIES as AMBIGUOUS
from ..operators.mapping import DIRECTIONS, FieldMap, Mapping
from ..operators.pacing import BURST, RATE
from ..operators.progress import ECHO_WINDOW, OVERLAP
from .plan import Sync

LOG_LEVELS = ("debug", "info", "warn", "error")
_UNITS = {"ms": 0.001, "s": 1, "m": 60, "h": 3600}


@dataclass(frozen=True)
class Connector:
    name: str
    driver: str
    echo_window: float
    overlap: float
    options: dict
    rate_per_sec: float = RATE
    burst: int = BURST


@dataclass(frozen=True)
class Config:
    connectors: tuple[Connector, ...]
    syncs: tuple[Sync, ...]
    max_attempts: int
    state_dir: str

    def windows(self) -> dict[str, int]:
        return {c.name: int(c.echo_window) for c in self.connectors}

    def limits(self) -> dict[str, tuple[float, int]]:
        return {c.name: (c.rate_per_sec, c.burst) for c in self.connectors}


def seconds(text: object) -> float | None:
    """Seconds of a duration such as 1m30s; None if it is none."""
    if not isinstance(text, str) or not re.fullmatch(r"-?(?:[0-9]+(?:[.][0-9]+)?(?:ms|s|m|h))+|0", text):
        return None
    total = sum(float(n) * _UNITS[u] for n, u in re.findall(r"([0-9.]+)(ms|s|m|h)", text))
    return -total if text.startswith("-") else total


@dataclass(frozen=True)
class Member:
    """One member of an object: what it is if unset, what it has to be in words, how it is read (None: it is not that)."""

    default: object
    wanted: str
    read: Callable[[object], object]
    of: str = ""  # the shape of an object, or of each object in a list


def _text(default: str | None = "") -> Member:
    return Member(default, "text", lambda v: v if isinstance(v, str) and v else None)


def _choice(default: str | None, among) -> Member:
    return Member(default, "one of " + ", ".join(x for x in among if x), lambda v: v if isinstance(v, str) and v in among else None)


def _number(default: float, wanted: str, kinds: tuple, least: float) -> Member:
    return Member(default, wanted, lambda v: v if isinstance(v, kinds) and not isinstance(v, bool) and v >= least else None)


def _duration(default: float, wanted: str, fits: Callable[[float], bool]) -> Member:
    return Member(default, wanted, lambda v: s if (s := seconds(v)) is not None and fits(s) else None)


def _names() -> Member:
    return Member([], "a list of names", lambda v: v if isinstance(v, list) and all(isinstance(x, str) for x in v) else None)


def _object(of: str) -> Member:
    return Member({}, "an object", lambda v: v if isinstance(v, dict) else None, of)


def _list(of: str) -> Member:
    return Member([], "a list", lambda v: v if isinstance(v, list) else None, of)


_COUNT, _SOME, _NONE_LESS = "a whole number from 1", "a duration over zero, such as 5m", "a duration from zero, such as 5m"
NEEDED = None  # the default of a member that has to be there

# The members of each object, and their defaults.
SHAPES: dict[str, dict[str, Member]] = {
    "file": {
        "log_level": _choice("info", LOG_LEVELS),
        "listen": _text(),
        "state_dir": _text("./state"),
        "workers": _number(4, _COUNT, (int,), 1),
        "max_attempts": _number(6, _COUNT, (int,), 1),
        "connectors": _list("connector"),
        "syncs": _list("sync"),
    },
    "connector": {
        "name": _text(NEEDED),
        "driver": _text(NEEDED),
        "echo_window": _duration(ECHO_WINDOW, _SOME, lambda s: s > 0),
        "watermark_overlap": _duration(OVERLAP, _NONE_LESS, lambda s: s >= 0),
        "rate_limit": _object("rate_limit"),
        "options": _object(""),
    },
    "rate_limit": {"rate_per_sec": _number(RATE, "a number over zero", (int, float), 1e-9), "burst": _number(BURST, _COUNT, (int,), 1)},
    "sync": {
        "kind": _text(NEEDED),
        "left": _text(NEEDED),
        "right": _text(NEEDED),
        "direction": _choice("bidirectional", tuple(DIRECTIONS)),
        "identity": _object("identity"),
        "conflict": _object("conflict"),
        "fields": _list("field"),
    },
    "identity": {"keys": _names(), "on_ambiguous": _choice("review", AMBIGUOUS)},
    "conflict": {"default": _choice("review", POLICIES), "per_field": _object("")},
    "field": {"canonical": _text(NEEDED), "left": _text(NEEDED), "right": _text(NEEDED), "transform": _choice("", tuple(TRANSFORMS)), "direction": _choice("", tuple(DIRECTIONS))},
}

Found = Iterator[tuple[str, str]]


def _read(value: object, shape: str, where: str, wrong: list[tuple[str, str]]) -> dict:
    """The members of one object by its shape, those that are unset or wrong as their defaults."""
    out, known = {}, SHAPES[shape]
    wrong.extend((f"{where}{name}", "no such member") for name in sorted(set(value) - set(known)))
    for name, member in known.items():
        given, at = value.get(name), f"{where}{name}"
        got = member.read(given) if given else member.default
        if given and got is None:
            wrong.append((at, f"wants {member.wanted}, has {given!r}"))
            got = member.default
        elif not given and member.default is NEEDED:
            wrong.append((at, f"wants {member.wanted}, has nothing"))
        if member.of and isinstance(got, dict):
            got = _read(got, member.of, f"{at}.", wrong)
        elif member.of:
            wrong.extend((f"{at}[{k}]", f"wants an object, has {x!r}") for k, x in enumerate(got) if not isinstance(x, dict))
            got = [_read(x if isinstance(x, dict) else {}, member.of, f"{at}[{k}].", wrong) for k, x in enumerate(got)]
        out[name] = got
    return out


def _repeated(names: list) -> list[int]:
    return [k for k, name in enumerate(names) if name and name in names[:k]]


def _enough(top: dict) -> Found:
    for name, least in (("connectors", 2), ("syncs", 1)):
        if len(top[name]) < least:
            yield name, f"wants {least} or more, has {len(top[name])}"
    for k, s in enumerate(top["syncs"]):
        if not s["fields"]:
            yield f"syncs[{k}].fields", "wants 1 or more, has 0"


def _once(top: dict) -> Found:
    names = [c["name"] for c in top["connectors"]]
    for k in _repeated(names):
        yield f"connectors[{k}].name", f"{names[k]!r} has been given before"
    for k, s in enumerate(top["syncs"]):
        names = [f["canonical"] for f in s["fields"]]
        for j in _repeated(names):
            yield f"syncs[{k}].fields[{j}].canonical", f"{names[j]!r} has been given before"


def _ends(top: dict) -> Found:
    known = {c["name"] for c in top["connectors"]}
    for k, s in enumerate(top["syncs"]):
        for side in ("left", "right"):
            if s[side] and s[side] not in known:
                yield f"syncs[{k}].{side}", f"no connector goes by {s[side]!r}"
        if s["left"] and s["left"] == s["right"]:
            yield f"syncs[{k}]", f"its ends must differ, {s['left']!r} is both"


def _mapped(top: dict) -> Found:
    for k, s in enumerate(top["syncs"]):
        names, policies = {f["canonical"] for f in s["fields"]}, s["conflict"]["per_field"]
        for at, used in (("identity.keys", s["identity"]["keys"]), ("conflict.per_field", sorted(policies))):
            for name in used:
                if name not in names:
                    yield f"syncs[{k}].{at}", f"{name!r} is not among the mapped fields"
        for name, policy in sorted(policies.items()):
            if not isinstance(policy, str) or policy not in POLICIES:
                yield f"syncs[{k}].conflict.per_field[{name}]", f"wants one of {', '.join(POLICIES)}, has {policy!r}"


RELATIONS: tuple[Callable[[dict], Found], ...] = (_enough, _once, _ends, _mapped)


def _mapping(s: dict) -> Mapping:
    return Mapping(s["kind"], tuple(FieldMap(f["canonical"], f["left"], f["right"], f["direction"], f["transform"]) for f in s["fields"]), s["direction"])


def parsed(text: str) -> Config:
    """The configuration in `text`; ValueError with every problem, one a line."""
    try:
        raw = json.loads(text)
    except ValueError as e:
        raise ValueError(f"not JSON: {e}") from None
    if not isinstance(raw, dict):
        raise ValueError("the file: wants an object")
    wrong: list[tuple[str, str]] = []
    top = _read(raw, "file", "", wrong)
    for relation in RELATIONS:
        wrong.extend(relation(top))
    syncs = []
    for k, s in enumerate(top["syncs"]):
        if any(at.startswith(f"syncs[{k}]") for at, _ in wrong):
            continue  # a mapping is made only of what is right by itself
        try:
            mapping = _mapping(s)
        except ValueError as e:
            wrong.append((f"syncs[{k}]", str(e)))
            continue
        per_field = tuple(sorted(s["conflict"]["per_field"].items()))
        syncs.append(Sync(f"{s['kind']}:{s['left']}-{s['right']}", s["left"], s["right"], mapping, tuple(s["identity"]["keys"]), s["conflict"]["default"], per_field, s["identity"]["on_ambiguous"]))
    if wrong:
        raise ValueError("\n".join(f"{at}: {what}" for at, what in wrong))
    made = (Connector(c["name"], c["driver"], c["echo_window"], c["watermark_overlap"], c["options"], **c["rate_limit"]) for c in top["connectors"])
    return Config(tuple(made), tuple(syncs), top["max_attempts"], top["state_dir"])
