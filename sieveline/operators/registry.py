"""What signals exist: their tier, version, value kind and ranking hint."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any, Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import CHEAP, EXPENSIVE, FREE, TIERS, measurement, pinned


@dataclass
class Context:
    """What a signal reads besides its row: options and the plan's lists."""

    options: dict[str, dict] = field(default_factory=dict)
    trades: dict[str, dict] = field(default_factory=dict)
    host_lists: dict[str, list] = field(default_factory=dict)
    brands: dict[str, int] | None = None
    this_year: Column | None = None

    def opt(self, signal: str, key: str, default=None):
        value = (self.options.get(signal) or {}).get(key)
        return default if value is None else value

    @property
    def year(self) -> Column:
        return F.year(F.current_date()) if self.this_year is None else self.this_year


@dataclass
class SignalDef:
    name: str
    tier: str
    build: Callable[[Context], Column]
    kind: str                        # categorical | number | boolean | text
    version: int = 1
    values: list | None = None
    whole: bool = False              # a number shown without a fraction
    suggest: dict | None = None
    rank: Any = None
    builtin: bool = True
    # Column sets computed before the signal, level by level; a shared column
    # is computed once however many signals and rules read it.
    needs: tuple = ()
    reads: tuple | None = None       # page facts it reads besides how a page was answered; None: any


_SIGNALS: dict[str, SignalDef] = {}


def signal(name: str, tier: str = FREE, kind: str = "text", *, version: int = 1, values=None,
           whole: bool = False, suggest=None, rank=None, builtin: bool = False, needs=(), reads=None):
    """Register ``build(context) -> Column`` (see ``model.measurement``)."""
    if tier not in TIERS:
        raise ValueError(f"no tier {tier!r}")

    def wrap(build):
        if name in _SIGNALS:
            raise ValueError(f"signal {name!r} registered twice")
        _SIGNALS[name] = SignalDef(name, tier, build, kind, version, values, whole,
                                   suggest, rank, builtin, tuple(needs),
                                   None if reads is None else tuple(reads))
        return build
    return wrap


def unregister(name: str) -> None:
    _SIGNALS.pop(name, None)


def known() -> dict[str, SignalDef]:
    return dict(sorted(_SIGNALS.items()))


def get(name: str) -> SignalDef:
    if name not in _SIGNALS:
        raise KeyError(f"no signal {name!r}; have {', '.join(sorted(_SIGNALS))}")
    return _SIGNALS[name]


def of_tier(tier: str) -> list[SignalDef]:
    return [s for s in known().values() if s.tier == tier]


def from_python(fn, value_type: str = "string", inputs=("name", "category"), version: int = 1):
    """A signal from a Python function of plain values, contained per row.

    Runs as an Arrow-batched UDF; a row on which ``fn`` raises gets an error as
    its evidence and the rest of the batch is unaffected.
    """
    import pandas as pd

    slot = {"string": "vstr", "double": "vnum", "boolean": "vbool"}[value_type]
    cast = {"string": str, "double": float, "boolean": bool}[value_type]
    schema = T.StructType([T.StructField("value", T._parse_datatype_string(value_type)),
                           T.StructField("error", T.StringType())])

    def contained(args):
        try:
            got = fn(*args)
            return (None if got is None else cast(got)), None
        except Exception as exc:                       # noqa: BLE001 - one row's failure
            return None, f"{type(exc).__name__}: {exc}"

    def rows(frame):
        return pd.DataFrame([contained(row) for row in frame.itertuples(index=False, name=None)],
                            columns=["value", "error"])

    # Annotations are set as objects: the module's are postponed to text.
    rows.__annotations__ = {"frame": pd.DataFrame, "return": pd.DataFrame}
    run = F.pandas_udf(rows, schema)

    def build(_ctx: Context) -> Column:
        got = run(F.struct(*[F.col(c) for c in inputs]))
        failed = got["error"].isNotNull()
        fields = {slot: got["value"]}
        if slot == "vstr":
            fields["vstr"] = F.when(failed, F.lit("unknown")).otherwise(got["value"])
        else:
            fields["vstr"] = F.when(failed, F.lit("unknown"))
        return measurement(**fields, confidence=F.when(failed, 0.0).otherwise(1.0),
                           error=got["error"], version=version)
    return build


def add_signals(df: DataFrame, names, ctx: Context, into: str = "signals", pin=()) -> DataFrame:
    """``df`` with the named signals added to its ``signals`` struct.

    The columns the signals in ``pin`` are built from are computed once: those
    are the signals rules and scores go on to read.
    """
    if not names:
        return df
    kept = [c for c in df.columns if c != into]
    have = list(df.schema[into].dataType.names) if into in df.columns else []
    defs = [get(n) for n in names]
    for level in range(max(len(d.needs) for d in defs)):
        cols: dict[str, Column] = {}
        for d in defs:
            if level < len(d.needs):
                cols.update(d.needs[level](ctx))
        df = df.withColumns(cols)
    held = {c for d in defs if d.name in pin for level in d.needs for c in level(ctx)}
    df = pinned(df, *[c for c in df.columns if c in held])
    parts = [F.col(into)[n].alias(n) for n in have if n not in names]
    parts += [d.build(ctx).alias(d.name) for d in defs]
    return df.select(*kept, F.struct(*parts).alias(into))


__all__ = ["CHEAP", "Context", "EXPENSIVE", "FREE", "SignalDef", "add_signals",
           "from_python", "get", "known", "of_tier", "signal", "unregister"]
