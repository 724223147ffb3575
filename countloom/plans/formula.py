"""Model formulas and design tables."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from countloom.functions.kernels import gram_pivots

TOKEN = re.compile(r"\s*(?:([A-Za-z_][\w.]*)|([+\-:*])|([01])|(\S))")


@dataclass(frozen=True)
class Formula:
    """Terms as tuples of variables, lower orders first, and whether there is an intercept."""

    terms: tuple[tuple[str, ...], ...]
    intercept: bool = True

    @property
    def variables(self) -> list[str]:
        return list(dict.fromkeys(v for t in self.terms for v in t))


def parse(text: str) -> Formula:
    """``+`` adds terms, ``:`` interacts, ``*`` does both, ``-`` removes; 0 or -1 removes the intercept, 1 adds it."""
    tokens = [m.groups() for m in TOKEN.finditer(text.split("~")[-1])]
    if bad := [t[3] for t in tokens if t[3]]:
        raise ValueError(f"a formula can't have {bad[0]!r}")
    intercept, found, sign, k = True, [], 1, 0
    while k < len(tokens):
        name, op, digit, _ = tokens[k]
        if op in ("+", "-"):
            sign, k = (1 if op == "+" else -1), k + 1
            continue
        if op:
            raise ValueError(f"a term is missing before {op!r}")
        if digit:
            intercept, k, sign = (digit == "1") == (sign > 0), k + 1, 1
            continue
        expansion, k = [(name,)], k + 1
        while k < len(tokens) and tokens[k][1] in (":", "*"):
            if k + 1 >= len(tokens) or not tokens[k + 1][0]:
                raise ValueError(f"a term is missing after {tokens[k][1]!r}")
            nxt = tokens[k + 1][0]
            crossed = [(*t, nxt) if nxt not in t else t for t in expansion]
            expansion = crossed if tokens[k][1] == ":" else [*expansion, (nxt,), *crossed]
            k += 2
        for term in expansion:
            same = [t for t in found if set(t) == set(term)]
            if sign > 0 and not same:
                found.append(term)
            elif sign < 0:
                found = [t for t in found if t not in same]
        sign = 1
    return Formula(tuple(sorted(found, key=len)), intercept)


@dataclass(frozen=True)
class RandomTerm:
    """One grouping factor, whether its groups have intercepts, and the covariates with slopes."""

    group: str
    intercept: bool
    slopes: tuple[str, ...]


def parse_random(text: str) -> RandomTerm:
    """``(1 | g)``, ``(x | g)`` or ``(1 + x | g)`` (intercepts and slopes), ``(0 + x | g)`` (slopes only)."""
    found = re.fullmatch(r"\s*\(([^()|]+)\|\s*([A-Za-z_][\w.]*)\s*\)\s*", text)
    if not found:
        raise ValueError(f"a random term is (terms | group) with one group, not {text!r}")
    own = parse(found[1])
    if any(len(t) > 1 for t in own.terms):
        raise ValueError("a random term can't have interactions")
    if not own.terms and not own.intercept:
        raise ValueError("an empty random term")
    return RandomTerm(found[2], own.intercept, tuple(t[0] for t in own.terms))


@dataclass
class Frame:
    """The design as a table: sample, x (an array, null where a covariate is missing), whole (no such null), level (the
    group's, from 0; -1: none), and names: columns, the group level that each column is of, and levels in order."""

    rows: DataFrame
    columns: list[str]
    numeric: list[int]
    group_columns: dict[int, int] = field(default_factory=dict)
    group_levels: list[str] = field(default_factory=list)
    intercept: bool = True


@dataclass
class Design:
    """A collected design: samples in order, their rows (nan: incomplete), and the names of ``Frame``."""

    samples: list[str]
    x: np.ndarray
    columns: list[str]
    group_columns: dict[int, int] = field(default_factory=dict)
    group_levels: list[str] = field(default_factory=list)
    levels: np.ndarray | None = None


#: A factor has at most so many levels, since each becomes a coefficient.
MOST_LEVELS = 1000


def levels_of(samples: DataFrame, v: str) -> list:
    found = [r[0] for r in samples.where(F.col(v).isNotNull()).select(v).distinct().limit(MOST_LEVELS + 1).collect()]
    if len(found) > MOST_LEVELS:
        raise ValueError(f"{v} has more than {MOST_LEVELS} levels")
    return sorted(found)


def frame(samples: DataFrame, formula: Formula, group: str | None = None, keep: tuple[str, ...] = ()) -> Frame:
    """The design of a table of samples (column sample). Text columns are factors with sorted levels; only levels come to
    the driver. In a main effect the first level has no column; in an interaction without its main effect a factor keeps
    all. ``keep``: columns to carry along."""
    kinds = {f.name: f.dataType for f in samples.schema.fields}
    used = list(dict.fromkeys([*formula.variables, *([group] if group else [])]))
    if missing := [v for v in [*used, *keep] if v not in kinds]:
        raise ValueError(f"no such covariate: {missing[0]}")
    factor = {v: isinstance(kinds[v], T.StringType) or (v == group) for v in used}
    levels = {v: levels_of(samples, v) for v in used if factor[v]}

    def pieces(v: str, full: bool) -> list[tuple[str, Column]]:
        if not factor[v]:
            return [(v, F.col(v).cast("double"))]
        own = levels[v] if full else levels[v][1:]
        return [(f"{v}{level}", F.when(F.col(v).isNotNull(), (F.col(v) == F.lit(level)).cast("double"))) for level in own]

    names, cols, of_group, numeric = [], [], {}, []
    if formula.intercept:
        names.append("(Intercept)")
        cols.append(F.lit(1.0))
    main = {t[0] for t in formula.terms if len(t) == 1}
    for term in formula.terms:
        full_first = len(term) == 1 and not formula.intercept and term == next((t for t in formula.terms if len(t) == 1 and factor[t[0]]), None)
        own = [pieces(v, full_first if len(term) == 1 else v not in main) for v in term]
        for combo in product(*reversed(own)):
            combo = tuple(reversed(combo))
            if len(term) == 1 and term[0] == group:
                of_group[len(cols)] = levels[group].index(next(level for level in levels[group] if f"{group}{level}" == combo[0][0]))
            if not any(factor[v] for v in term):
                numeric.append(len(cols))
            names.append(":".join(n for n, _ in combo))
            cols.append(reduce(lambda a, b: a * b, [c for _, c in combo]))
    level = F.lit(-1)
    for k, v in enumerate(levels.get(group, [])):
        level = F.when(F.col(group) == F.lit(v), k).otherwise(level)
    x = F.array(*cols) if cols else F.array().cast("array<double>")
    rows = samples.select("sample", x.alias("x"), F.forall(x, lambda v: v.isNotNull()).alias("whole"), level.cast("int").alias("level"), *keep)
    return Frame(rows, names, numeric, of_group, [str(v) for v in levels.get(group, [])], formula.intercept)


def design(samples: DataFrame, formula: Formula, group: str | None = None) -> Design:
    """The design collected: a row a sample, for work on taxa that needs all samples of one beside each other."""
    f = frame(samples, formula, group)
    rows = f.rows.orderBy("sample").collect()
    x = np.array([[np.nan if v is None else v for v in r.x] for r in rows], float).reshape(len(rows), len(f.columns))
    return Design([r.sample for r in rows], x, f.columns, f.group_columns, f.group_levels, np.array([r.level for r in rows]) if group else None)


def moments(f: Frame) -> tuple[np.ndarray, int, int]:
    """X'X and the number of complete samples, and the number of all: sums over the table, a few numbers on the driver."""
    p = len(f.columns)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    whole = F.col("whole")
    sums = [F.sum(F.when(whole, F.get("x", F.lit(i)) * F.get("x", F.lit(j)))).alias(f"s{i}_{j}") for i, j in pairs]
    got = f.rows.agg(F.count_if(whole).alias("whole"), F.count("*").alias("every"), *sums).first()
    gram = np.zeros((p, p))
    for i, j in pairs:
        gram[i, j] = gram[j, i] = got[f"s{i}_{j}"] or 0.0
    return gram, got.whole, got.every


def check_identifiable(f: Frame) -> tuple[np.ndarray, int, int]:
    """Raises for columns that others explain, or no sample beyond the columns; else what ``moments`` gives."""
    gram, whole, every = moments(f)
    kept = gram_pivots(gram)
    if len(kept) < len(f.columns):
        raise ValueError("not identifiable: " + ", ".join(c for j, c in enumerate(f.columns) if j not in kept))
    if whole <= len(f.columns):
        raise ValueError("no more complete samples than coefficients")
    return gram, whole, every


def long_design(f: Frame) -> DataFrame:
    """sample, coef, value: the design as rows."""
    names = F.array(*map(F.lit, f.columns))
    return f.rows.select("sample", F.posexplode("x").alias("j", "value")).select("sample", F.get(names, F.col("j")).alias("coef"), "value")
