"""What a brief may say, as one table, and a walker that reports all that departs from it.

A row names a setting by its path (``*`` stands for any name, ``[]`` for each
entry of a list) and what its value has to be. Everything else follows from the
table: a name it lacks is unknown, a row with rows below it is walked into.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import Any, NamedTuple

from .functions.values import OPERATORS


class Kind(NamedTuple):
    says: str
    fits: Callable[[Any], bool]


UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400}


def duration(value) -> int | None:
    """``90d``, ``30m`` or ``1800`` in seconds; null for anything else."""
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, (int, float)):
        return int(value) if math.isfinite(value) else None
    head, unit = str(value).strip().lower(), 1
    if head[-1:] in UNITS:
        head, unit = head[:-1], UNITS[head[-1]]
    try:
        seconds = float(head) * unit if unit > 1 or "." not in head else math.nan
        return int(seconds) if math.isfinite(seconds) else None
    except ValueError:
        return None


def is_number(v) -> bool:
    return type(v) in (int, float)


def one_of(*names) -> Kind:
    return Kind("one of " + ", ".join(repr(n) for n in names), lambda v: v in names if isinstance(v, str) else False)


ANY = Kind("anything", lambda v: True)
TEXT = Kind("a text", lambda v: isinstance(v, str))
TABLE = Kind("a table of settings", lambda v: isinstance(v, dict))
LIST = Kind("a list", lambda v: isinstance(v, list))
NUMBER = Kind("a number", is_number)
COUNT = Kind("a whole number of 1 or more", lambda v: type(v) is int and v >= 1)
POSITIVE = Kind("a number above 0", lambda v: is_number(v) and v > 0)
FLAG = Kind("true or false", lambda v: isinstance(v, bool))
SPAN = Kind("a time span like 45m or 2700", lambda v: (duration(v) or 0) > 0)
AGE = Kind("a time span like 90d", lambda v: duration(v) is not None)
SHARE = Kind("a share from 0 to 1", lambda v: is_number(v) and 0 <= v <= 1)
ORDER = Kind("'as-listed', 'priority', 'alphabetical' or 'random'",
             lambda v: str(v).lower() in ("as-listed", "priority", "alphabetical", "random", "none", ""))
OPERATOR = Kind("one of " + " ".join(OPERATORS), lambda v: v in OPERATORS)

# The setting names users of briefs know.
SETTINGS: dict[str, Kind] = {
    "name": TEXT, "description": TEXT, "sources": LIST, "filters": LIST, "signal_options": TABLE,
    "signal_options.*": ANY,
    "where": TABLE, "where.mode": one_of("paste", "packs", "search"), "where.places": ANY, "where.packs": LIST,
    "where.place": ANY, "where.exclude": ANY, "where.order": ORDER, "where.priority": ANY, "where.seed": ANY,
    "what": TABLE, "what.packs": LIST, "what.trade": ANY, "what.match": one_of("any", "all"), "what.categories": ANY,
    "what.keywords": ANY, "what.vetoes": ANY, "what.osm_tags": ANY, "what.custom": ANY,
    "scoring": TABLE, "scoring.weights": TABLE, "scoring.weights.*": ANY, "scoring.normalise": ANY,
    "scoring.confidence": ANY, "scoring.bands": LIST,
    "gating": TABLE, "gating.free": LIST, "gating.cheap": LIST, "gating.expensive": LIST,
    "limits": TABLE, "limits.max_results": COUNT, "limits.max_requests": COUNT, "limits.attempts": COUNT,
    "limits.max_runtime": SPAN, "limits.max_runtime_seconds": SPAN, "limits.workers": TABLE, "limits.workers.*": COUNT,
    "limits.breaker": TABLE, "limits.breaker.rate": SHARE, "limits.breaker.window": COUNT,
    "limits.breaker.min_sample": COUNT,
    "suppress": TABLE, "suppress.lists": LIST, "suppress.cids": LIST, "suppress.runs": LIST, "suppress.after": AGE,
    "output": TABLE, "output.columns": LIST, "output.template": TABLE, "output.template.*": ANY,
    "output.min_score": NUMBER, "output.top": NUMBER, "output.split_by": ANY, "output.sort": ANY,
}
RULE = {"signal": TEXT, "op": OPERATOR, "value": ANY}
GROUP = {"group": one_of("any", "all"), "of": LIST}
SCALED = {"weight": NUMBER, "scale": one_of("linear", "log"), "cap": POSITIVE, "invert": FLAG}
BAND = {"min": NUMBER, "from": NUMBER, "label": ANY}


def walk(value: dict, table: dict[str, Kind], path: str = "", called: str = "") -> list[str]:
    """Departures of ``value`` from the rows of ``table`` below ``path``; a null stands for a setting left out."""
    found = []
    for name, given in value.items():
        told, own = f"{called}{name}", f"{path}{name}"
        row = own if own in table else f"{path}*"
        if row not in table:
            found.append(f"{told}: there is no such setting")
        elif given is not None and not table[row].fits(given):
            found.append(f"{told}: {given!r} is not {table[row].says}")
        elif isinstance(given, dict) and any(k.startswith(f"{row}.") for k in table):
            found += walk(given, table, f"{row}.", f"{told}.")
    return found


def record(value, table: dict[str, Kind], called: str, needs: tuple = ()) -> list[str]:
    """A record of a list: a table of its own, with the names it cannot do without."""
    if not isinstance(value, dict):
        return [f"{called}: {value!r} is not {TABLE.says}"]
    return walk(value, table, called=f"{called}.") + [
        f"{called}: lacks {n!r}" for n in needs if value.get(n) is None or value[n] == ""]


def rules(value, signals, called: str = "filters") -> list[str]:
    """Conditions, and groups of them to any depth."""
    found, todo = [], [(called, value)]
    while todo:
        at, items = todo.pop()
        for i, item in enumerate(items if isinstance(items, list) else []):
            own = f"{at}[{i}]"
            if isinstance(item, dict) and "group" in item:
                found += record(item, GROUP, own)
                todo.append((f"{own}.of", item.get("of")))
                continue
            found += record(item, RULE, own, ("signal",))
            if isinstance(item, dict) and item.get("signal"):
                found += signal_name(item["signal"], signals, own)
    return found


def signal_name(name, signals, called: str) -> list[str]:
    return [] if str(name).partition(".")[0] in signals else [f"{called}: no signal is called {name!r}"]


def weight(name: str, value) -> list[str]:
    """A number, points for each answer, or a scaled measurement."""
    called = f"scoring.weights.{name}"
    if isinstance(value, dict) and "weight" in value:
        return record(value, SCALED, called, ("cap",))
    if isinstance(value, dict):
        return walk(value, {"*": NUMBER}, called=f"{called}.")
    return [] if is_number(value) else [f"{called}: {value!r} is neither a number nor a table"]


def bands(value) -> list[str]:
    return [p for i, b in enumerate(value if isinstance(value, list) else [])
            for p in record({"min": b.get("from"), **b} if isinstance(b, dict) else b, BAND, f"scoring.bands[{i}]",
                            ("min", "label"))]
