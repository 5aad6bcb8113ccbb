"""Which specs suit a set of fields. Plain Python over a profile; no rows are read."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations, permutations, product

from gneiss.plans.specs import VizSpec, make
from gneiss.profile.describe import Field

FUNCTIONS = ("min", "max", "mean", "sum", "count")
EXPANDED_LIMIT = 20


def single_q(q: Field) -> list[VizSpec]:
    if q.scale == "ordinal":
        return [make("val:count", "q", ("bar", "tree", "pie"), f"frequency of {q.name}", field_a=q.name)]
    return [make("bin:agg", "b:q", ("hist",), f"distribution of {q.name}", binning_field=q.name, agg_field_a=q.name, agg_fn="count")]


def single_t(t: Field) -> list[VizSpec]:
    out = [make("val:count", "t", ("line", "bar"), f"frequency of {t.name}", field_a=t.name)]
    if t.scale == "continuous":
        out.append(make("bin:agg", "b:t", ("hist",), f"distribution of {t.name}", binning_field=t.name, agg_field_a=t.name, agg_fn="count"))
    return out


def single_c(c: Field) -> list[VizSpec]:
    return [make("val:count", "c", ("bar", "tree", "pie"), f"frequency of {c.name}", field_a=c.name)]


def single_cq(c: Field, q: Field) -> list[VizSpec]:
    if c.unique:
        return [make("val:val", "c:q", ("bar", "tree", "pie"), f"{q.name} by {c.name}", field_a=c.name, field_b=q.name)]
    return [
        make("val:agg", "c:q", ("bar", "tree", "pie"), f"sum of {q.name} by {c.name}", grouped_field=c.name, agg_field=q.name, agg_fn="sum"),
        make("val:box", "c:q", ("box",), f"spread of {q.name} by {c.name}", grouped_field=c.name, boxed_field=q.name),
    ]


def single_tq(t: Field, q: Field) -> list[VizSpec]:
    if t.unique:
        return [make("val:val", "t:q", ("line",), f"{q.name} over {t.name}", field_a=t.name, field_b=q.name)]
    return [make("val:agg", "t:q", ("line",), f"{fn} of {q.name} by {t.name}", grouped_field=t.name, agg_field=q.name, agg_fn=fn) for fn in ("mean", "count", "sum")]


def single_ctq(c: Field, t: Field, q: Field) -> list[VizSpec]:
    return [
        make("multigroup:agg", "[c:t]:q", ("line",), f"{fn} of {q.name} by {t.name} and {c.name}", grouped_field_a=t.name, grouped_field_b=c.name, agg_field=q.name, agg_fn=fn) for fn in ("mean", "count", "sum")
    ]


def multi_c(cs: Sequence[Field]) -> list[VizSpec]:
    pairs = [p for p in combinations(cs, 2) if not any(f.unique for f in p)]
    return [make("multigroup:count", "[c:c]", ("stacked_bar",), f"count of {a.name} by {b.name}", field_a=a.name, field_b=b.name) for x, y in pairs for a, b in ((x, y), (y, x))]


def multi_q(qs: Sequence[Field]) -> list[VizSpec]:
    out: list[VizSpec] = []
    for a, b in combinations(qs, 2):
        ordinal = [f for f in (a, b) if f.scale == "ordinal"]
        if not ordinal:
            out.append(make("val:val", "q:q", ("scatter",), f"{a.name} against {b.name}", field_a=a.name, field_b=b.name))
        elif len(ordinal) == 1:
            out += single_cq(ordinal[0], b if ordinal[0] is a else a)
        else:
            out += multi_c((a, b))
    return out


def single_c_multi_q(c: Field, qs: Sequence[Field]) -> list[VizSpec]:
    if c.unique:
        return []
    return [
        make("agg:agg", "[c]:q", ("scatter",), f"{fn} of {a.name} and {b.name} by {c.name}", grouped_field=c.name, agg_field_a=a.name, agg_field_b=b.name, agg_fn=fn)
        for a, b in combinations(qs, 2)
        for fn in FUNCTIONS
        if fn != "count"
    ]


def single_q_multi_c(cs: Sequence[Field], q: Field) -> list[VizSpec]:
    out = []
    for a, b in combinations([c for c in cs if not c.unique], 2):
        for fn in FUNCTIONS:
            out += [
                make("multigroup:agg", "[c:c]:q", ("stacked_bar",), f"{fn} of {q.name} by {x.name} and {y.name}", grouped_field_a=x.name, grouped_field_b=y.name, agg_field=q.name, agg_fn=fn) for x, y in ((a, b), (b, a))
            ]
        out.append(make("val:val:q", "c:c:q", ("network",), f"{a.name} and {b.name} linked by {q.name}", field_a=a.name, field_b=b.name, agg_field=q.name))
    return out


def multi_cq(cs: Sequence[Field], qs: Sequence[Field]) -> list[VizSpec]:
    return [make("val:val:q", "[c:c]:[q]", ("network",), f"{a.name} and {b.name} linked by {q.name}", field_a=a.name, field_b=b.name, agg_field=q.name) for (a, b), q in product(combinations(cs, 2), qs)]


def by_kind(fields: Sequence[Field]) -> tuple[list[Field], list[Field], list[Field]]:
    return tuple([f for f in fields if f.general == k] for k in "cqt")  # type: ignore[return-value]


def baseline(fields: Sequence[Field]) -> list[VizSpec]:
    """One field each; unique categories and ids tell nothing."""
    one = {"c": single_c, "q": single_q, "t": single_t}
    return [s for f in fields if not f.id and not (f.unique and f.general == "c") for s in one[f.general](f)]


def subset(fields: Sequence[Field]) -> list[VizSpec]:
    """Pairs and more out of three selected fields or more."""
    if len(fields) < 3:
        return []
    c, q, t = by_kind(fields)
    out = multi_c(c) + multi_q(q) + [s for a, b in product(c, q) for s in single_cq(a, b)] + [s for a, b in product(t, q) for s in single_tq(a, b)]
    if len(c) >= 2:
        out += [s for b in q for s in single_q_multi_c(c, b)]
    if len(q) >= 2:
        out += [s for a in c for s in single_c_multi_q(a, q)]
    return out


def exact(fields: Sequence[Field]) -> list[VizSpec]:
    """Specs that use all selected fields, from the first shape that fits."""
    c, q, t = by_kind(fields)
    shape = (min(len(c), 2), min(len(q), 2), min(len(t), 2))
    rules = {
        (2, 2, 0): lambda: multi_cq(c, q),
        (1, 2, 0): lambda: single_c_multi_q(c[0], q),
        (2, 1, 0): lambda: single_q_multi_c(c, q[0]),
        (2, 0, 0): lambda: multi_c(c),
        (0, 2, 0): lambda: multi_q(q),
        (1, 1, 1): lambda: single_ctq(c[0], t[0], q[0]),
        (1, 1, 0): lambda: single_cq(c[0], q[0]),
        (0, 1, 1): lambda: single_tq(t[0], q[0]),
        (1, 0, 0): lambda: single_c(c[0]),
        (0, 1, 0): lambda: single_q(q[0]),
        (0, 0, 1): lambda: single_t(t[0]),
    }
    return rules.get(shape, list)()


def expanded(selected: Sequence[Field], others: Sequence[Field], limit: int = EXPANDED_LIMIT) -> list[VizSpec]:
    """Selected fields with one more each."""
    return [s for a, b in product(selected, others) for s in exact([a, b])][:limit]


def enumerate_specs(fields: Sequence[Field], selected: Sequence[str] = (), kinds: Sequence[str] = ("exact", "subset", "baseline", "expanded"), limit: int | None = None) -> list[VizSpec]:
    """Distinct specs of the recommendation kinds, in their order. Without a selection `exact` means baseline over all."""
    usable = [f for f in fields if not f.id]
    chosen = [f for f in usable if f.name in set(selected)]
    others = [f for f in usable if f not in chosen]
    make_kind = {
        "baseline": lambda: baseline(chosen or usable),
        "subset": lambda: subset(chosen),
        "exact": lambda: exact(chosen) if chosen else baseline(usable),
        "expanded": lambda: expanded(chosen, others),
    }
    out = list(dict.fromkeys(s for k in kinds for s in make_kind[k]()))
    return out if limit is None else out[:limit]


def shapes(fields: Sequence[Field]) -> list[tuple[str, ...]]:
    """Ordered pairs of categorical fields, for hierarchy detection."""
    return [(a.name, b.name) for a, b in permutations([f for f in fields if f.general == "c"], 2)]
