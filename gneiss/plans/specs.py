"""The spec, one chart's query: which procedure over which fields with which arguments."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

PROCEDURES = ("agg", "ind:val", "val:count", "bin:agg", "bin:count", "val:box", "val:val", "val:agg", "agg:agg", "multigroup:count", "multigroup:agg", "val:val:q")


@dataclass(frozen=True)
class VizSpec:
    procedure: str
    structure: str
    fields: tuple[str, ...]
    args: tuple[tuple[str, str], ...]
    viz_types: tuple[str, ...] = ()
    description: str = ""

    def arg(self, name: str) -> str | None:
        return dict(self.args).get(name)


@dataclass(frozen=True)
class ScoredSpec:
    spec: VizSpec
    relevance: float
    scores: tuple[tuple[str, float | None], ...] = field(default=())


def make(procedure: str, structure: str, viz_types=(), description: str = "", **args: str) -> VizSpec:
    if procedure not in PROCEDURES:
        raise ValueError(f"unknown procedure {procedure!r}")
    names = tuple(v for k, v in args.items() if k != "agg_fn")
    return VizSpec(procedure, structure, names, tuple(sorted(args.items())), tuple(viz_types), description)


def canonical(spec: VizSpec, conditionals=None, config=None) -> str:
    """Key of a result in a cache: equal for equal queries."""
    return json.dumps([asdict(spec), conditionals, config], sort_keys=True, default=str)
