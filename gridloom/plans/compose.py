"""Composing operators: named slots, sequences, plan reports."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame

from gridloom.schema import Slot


class Stage(Protocol):
    """A configured operator: tables by slot name in, tables by slot name out."""

    inputs: Mapping[str, Slot]

    def __call__(self, **tables: DataFrame) -> dict[str, DataFrame]: ...


@dataclass(frozen=True)
class Operation:
    """A function of DataFrames with declared inputs and one named output."""

    name: str
    run: Callable[..., DataFrame]
    inputs: Mapping[str, Slot]
    output: str = "out"

    @property
    def outputs(self) -> tuple[str, ...]:
        return (self.output,)

    def __call__(self, **tables: DataFrame) -> dict[str, DataFrame]:
        if lacking := set(self.inputs) - set(tables):
            raise ValueError(f"{self.name}: nothing bound to {sorted(lacking)}")
        bound = {slot: self.inputs[slot].validate(tables[slot], f"{self.name}.{slot}") for slot in self.inputs}
        return {self.output: self.run(**bound)}


@dataclass(frozen=True)
class Sequence:
    """Operations, or sequences of them, one after another. ``wires`` maps "operation.slot" to a shared name, for inputs and outputs; what is not
    wired keeps the name "operation.slot". Two slots of one name are one table. ``compounds`` says the same the other way round: a name and all slots that share it; the
    slots of a compound must agree on the kinds of the columns they have in common, and take part in no other."""

    operations: tuple[Operation | Sequence, ...]
    wires: Mapping[str, str] = field(default_factory=dict)
    compounds: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    name: str = "sequence"

    def __post_init__(self):
        names = [o.name for o in self.operations]
        if len(set(names)) != len(names):
            raise ValueError("operations need names of their own")
        known = {f"{o.name}.{s}" for o in self.operations for s in (*o.inputs, *o.outputs)}
        listed = [s for slots in self.compounds.values() for s in slots]
        if twice := {s for s in listed if listed.count(s) > 1 or self.wires.get(s) is not None}:
            raise ValueError(f"in two compounds: {sorted(twice)}")
        if unknown := (set(self.wires) | set(listed)) - known:
            raise ValueError(f"no slots {sorted(unknown)}")
        slots = {f"{o.name}.{s}": slot for o in self.operations for s, slot in o.inputs.items()}
        for name, members in self.compounds.items():
            kinds: dict[str, str] = {}
            for s in members:
                for column, kind in slots[s].columns.items() if s in slots else ():
                    if "any" not in (kind, kinds.get(column, kind)) and kinds.get(column, kind) != kind:
                        raise TypeError(f"{name}.{column} is both {kinds[column]} and {kind}")
                    if kind != "any":
                        kinds[column] = kind

    def _at(self, slot: str) -> str:
        return self.wires.get(slot) or next((name for name, slots in self.compounds.items() if slot in slots), slot)

    @property
    def inputs(self) -> dict[str, Slot]:
        made, needed = set(), {}
        for o in self.operations:
            for s, slot in o.inputs.items():
                if (at := self._at(f"{o.name}.{s}")) not in made:
                    before = needed[at].columns if at in needed else {}
                    needed[at] = Slot({**before, **{c: kind for c, kind in slot.columns.items() if kind != "any" or c not in before}})
            made |= {self._at(f"{o.name}.{s}") for s in o.outputs}
        return needed

    @property
    def outputs(self) -> tuple[str, ...]:
        return tuple(self._at(f"{o.name}.{s}") for o in self.operations for s in o.outputs)

    def __call__(self, **tables: DataFrame) -> dict[str, DataFrame]:
        have = dict(tables)
        for o in self.operations:
            got = o(**{s: have[at] for s in o.inputs if (at := self._at(f"{o.name}.{s}")) in have})
            have |= {self._at(f"{o.name}.{s}"): got[s] for s in o.outputs}
        return have

    def graph(self) -> str:
        """The operations and their tables in Graphviz notation."""
        lines = ["digraph plan {"]
        for o in self.operations:
            lines.append(f'  "{o.name}" [shape=box];')
            lines += [f'  "{self._at(f"{o.name}.{s}")}" -> "{o.name}";' for s in o.inputs]
            lines += [f'  "{o.name}" -> "{self._at(f"{o.name}.{s}")}";' for s in o.outputs]
        return "\n".join([*lines, "}"])


def explained(df: DataFrame, mode: str = "formatted") -> str:
    """The text of ``df.explain``."""
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)
