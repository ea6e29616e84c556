"""Row predicates as a small tree: built in Python or read from text, turned into a Column or into a set of regions.

    col("chr").eq(1) & (col("pval") < 5e-8)          parse("chr == 1 & pval < 5e-8")

Chromosomes are compared in the form chrN and ordered by number; alleles are compared in upper case; text columns that
are compared with numbers are read as numbers (what is none is not selected).
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.genome import chr_rank, with_chr
from ..operators import intervals
from ..operators.regions import RegionSet, expression

ALLELES = ("ref", "alt", "allele1", "allele2")
FLIP = {"<": ">", ">": "<", "<=": ">=", ">=": "<=", "==": "==", "!=": "!="}


class Predicate:
    """Base of all predicates. & | ~ combine them."""

    def __and__(self, other: Predicate) -> Predicate:
        return And((self, other))

    def __or__(self, other: Predicate) -> Predicate:
        return Or((self, other))

    def __invert__(self) -> Predicate:
        return Not(self)

    def is_atomic(self) -> bool:
        return True

    def is_composite(self) -> bool:
        return not self.is_atomic()

    def columns(self) -> set[str]:
        return set()

    def tables(self) -> list:
        """The tables of values and regions that are looked up in; each once."""
        return []

    def column(self, kinds: dict[str, str]) -> Column:
        raise NotImplementedError

    def regions(self, spark: SparkSession) -> RegionSet:
        """The regions that can hold matching rows; the full genome where nothing follows."""
        return RegionSet.full(spark)


def canonical(name: str, value: Any) -> Any:
    """A literal in the form that the column's values have."""
    if value is None or isinstance(value, bool):
        return value
    if name == "chr":
        text = str(int(value)) if isinstance(value, float) and value.is_integer() else str(value)
        return text if text.lower().startswith("chr") and text[:3] == "chr" else "chr" + re.sub("(?i)^chr", "", text)
    return value.upper() if name in ALLELES and isinstance(value, str) else value


def _read(name: str, kinds: dict[str, str], numeric: bool) -> Column:
    if name not in kinds:
        raise ValueError(f"no column {name!r}; there are {', '.join(kinds)}")
    c = F.col(f"`{name}`")
    return c.try_cast("double") if numeric and kinds[name] == "string" else c


@dataclass(frozen=True)
class Always(Predicate):
    value: bool = True

    def column(self, kinds: dict[str, str]) -> Column:
        return F.lit(self.value)

    def regions(self, spark: SparkSession) -> RegionSet:
        return RegionSet.full(spark) if self.value else RegionSet.empty(spark)

    def __repr__(self) -> str:
        return "TRUE" if self.value else "FALSE"


@dataclass(frozen=True, repr=False)
class Cmp(Predicate):
    op: str
    name: str
    value: Any  # a literal or Name

    def __repr__(self) -> str:
        return f"{self.name} {self.op} {self.value!r}"

    def columns(self) -> set[str]:
        return {self.name} | ({self.value.name} if isinstance(self.value, Name) else set())

    def column(self, kinds: dict[str, str]) -> Column:
        compare: Callable = {"<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__, "==": Column.__eq__, "!=": Column.__ne__}[self.op]
        if isinstance(self.value, Name):
            return compare(_read(self.name, kinds, False), _read(self.value.name, kinds, False))
        if self.name == "chr" and self.op not in ("==", "!="):
            n = _number(self.value)
            if n is None or not 1 <= n <= 22:
                return F.lit(True)
            return compare(chr_rank(_read("chr", kinds, False)), F.lit(n))
        numeric = isinstance(self.value, (int, float)) and not isinstance(self.value, bool) and self.name != "chr"
        return compare(_read(self.name, kinds, numeric), F.lit(canonical(self.name, self.value)))

    def regions(self, spark: SparkSession) -> RegionSet:
        if isinstance(self.value, Name) or self.name not in ("chr", "pos"):
            return RegionSet.full(spark)
        make = lambda **k: RegionSet.of(spark, **k)
        if self.op in ("==", "!="):
            r = make(chr=canonical("chr", self.value)) if self.name == "chr" else make(start=int(self.value), end=int(self.value))
            return r if self.op == "==" else ~r
        if self.name == "pos":
            v = int(self.value)
            return {"<": lambda: make(end=v - 1), "<=": lambda: make(end=v), ">": lambda: make(start=v + 1), ">=": lambda: make(start=v)}[self.op]()
        n = _number(self.value)
        if n is None or not 1 <= n <= 22:
            return RegionSet.full(spark)
        keep = [f"chr{i}" for i in range(1, 23) if {"<": i < n, "<=": i <= n, ">": i > n, ">=": i >= n}[self.op]]
        return make(chr=keep) if keep else RegionSet.empty(spark)


def _number(v: Any) -> int | None:
    m = re.fullmatch(r"(?i)(?:chr)?([0-9]+)(?:\.0)?", str(v))
    return int(m[1]) if m else None


@dataclass(frozen=True, repr=False)
class In(Predicate):
    name: str
    values: tuple

    def __repr__(self) -> str:
        return f"{self.name} %in% {list(self.values)!r}"

    def columns(self) -> set[str]:
        return {self.name}

    def column(self, kinds: dict[str, str]) -> Column:
        values = [canonical(self.name, v) for v in self.values if v is not None]
        numeric = bool(values) and all(isinstance(v, (int, float)) for v in values)
        return _read(self.name, kinds, numeric).isin(values)

    def regions(self, spark: SparkSession) -> RegionSet:
        if self.name == "chr":
            return RegionSet.of(spark, chr=[canonical("chr", v) for v in self.values]) if self.values else RegionSet.empty(spark)
        if self.name == "pos":
            at = [int(v) for v in self.values]
            return RegionSet.of(spark, start=at, end=at) if at else RegionSet.empty(spark)
        return RegionSet.full(spark)


@dataclass(eq=False)
class TableValues:
    """A value set held in the first column of a table; names are the columns that an expression looks up in it."""

    key: str
    df: DataFrame
    names: list[str] = field(default_factory=list)

    def flag(self, name: str) -> str:
        return f"_{name}_in_{self.key}"

    def _values(self, name: str) -> DataFrame:
        at = self.df.columns[0]
        v = self.df.select(F.col(f"`{at}`").alias("_v")).filter("_v is not null")
        return v.select(with_chr(F.col("_v").cast("string")).alias("_v") if name == "chr" else F.upper("_v").alias("_v") if name in ALLELES else "_v").distinct()

    def _read(self, table: DataFrame, name: str) -> Column:
        numeric = self.df.dtypes[0][1] in ("int", "bigint", "double", "float", "smallint") and name not in ("chr", *ALLELES)
        return _read(name, dict(table.dtypes), numeric)

    def within(self, table: DataFrame, name: str) -> DataFrame:
        """The rows of table whose value is in the set."""
        return table.join(self._values(name), self._read(table, name) == F.col("_v"), "left_semi")

    def joined(self, table: DataFrame) -> DataFrame:
        """table with one flag a name: whether its value is in the set; a join of distinct values, so no row is repeated."""
        for name in dict.fromkeys(self.names):
            x = self._read(table, name)
            table = table.join(self._values(name).withColumn("_in", F.lit(True)), x == F.col("_v"), "left").withColumn(self.flag(name), F.when(x.isNotNull(), F.coalesce("_in", F.lit(False)))).drop("_v", "_in")
        return table


@dataclass(frozen=True, repr=False)
class InTable(Predicate):
    name: str
    values: TableValues

    def __repr__(self) -> str:
        return f"{self.name} %in% {self.values.key}"

    def columns(self) -> set[str]:
        return {self.name}

    def tables(self) -> list:
        return [self.values]

    def column(self, kinds: dict[str, str]) -> Column:
        _read(self.name, kinds, False)
        return F.col(f"`{self.values.flag(self.name)}`")


@dataclass(eq=False, repr=False)
class RegionTable(Predicate):
    """Position in a set of regions of any size, as part of a larger expression: looked up by a join."""

    key: str
    regions_: RegionSet

    def __repr__(self) -> str:
        return self.key

    def columns(self) -> set[str]:
        return {"chr", "pos"}

    def tables(self) -> list:
        return [self]

    def joined(self, table: DataFrame) -> DataFrame:
        return intervals.flagged(table, "chr", "pos", self.regions_._merged_rows(), f"_in_{self.key}")

    def column(self, kinds: dict[str, str]) -> Column:
        c = F.col(f"`_in_{self.key}`")
        return c if self.regions_.include else ~c

    def regions(self, spark: SparkSession) -> RegionSet:
        return self.regions_


def positional(p: Predicate) -> Predicate:
    """What a condition says of chromosome and position alone: a condition that every row that meets p meets."""
    if p.columns() <= {"chr", "pos"} and not p.tables():
        return p
    return type(p)(tuple(positional(x) for x in p.parts)) if isinstance(p, (And, Or)) else Always(True)


MANY = 1_000  #: values of a literal list above which it is joined as a table


def with_tables(p: Predicate, spark: SparkSession, many: int = MANY) -> Predicate:
    """The predicate with long literal lists as tables, so that neither the plan nor generated code grows with them."""
    if isinstance(p, In) and len(p.values) > many:
        values = [canonical(p.name, v) for v in p.values if v is not None]
        kind = "string" if any(isinstance(v, str) for v in values) else "double" if any(isinstance(v, float) for v in values) else "boolean" if all(isinstance(v, bool) for v in values) else "long"
        cast = {"string": str, "double": float, "boolean": bool, "long": int}[kind]
        t = TableValues(f"list{id(p):x}", spark.createDataFrame([(cast(v),) for v in values], f"v {kind}"), [p.name])
        return InTable(p.name, t)
    if isinstance(p, (And, Or)):
        return type(p)(tuple(with_tables(x, spark, many) for x in p.parts))
    return Not(with_tables(p.part, spark, many)) if isinstance(p, Not) else p


def conjuncts(p: Predicate) -> tuple[list[InTable], Predicate | None]:
    """(the value sets that every selected row has to be in, the rest of the condition)."""

    def flat(x: Predicate) -> list[Predicate]:
        return [z for y in x.parts for z in flat(y)] if isinstance(x, And) else [x]

    parts = flat(p)
    whole = [x for x in parts if isinstance(x, InTable)]
    rest = [x for x in parts if not isinstance(x, InTable)]
    return whole, (rest[0] if len(rest) == 1 else And(tuple(rest)) if rest else None)


@dataclass(frozen=True, repr=False)
class Matches(Predicate):
    """A regular expression found anywhere in the value."""

    name: str
    pattern: str

    def __post_init__(self) -> None:
        if not isinstance(self.pattern, str):
            raise ValueError("the pattern must be one string")

    def __repr__(self) -> str:
        return f"grepl({self.pattern!r}, {self.name})"

    def columns(self) -> set[str]:
        return {self.name}

    def column(self, kinds: dict[str, str]) -> Column:
        return _read(self.name, kinds, False).cast("string").rlike(posix(self.pattern))


def posix(pattern: str) -> str:
    """Classes such as [[:digit:]] in the form that Java knows."""
    return re.sub(r"\[:(\w+):\]", lambda m: r"\p{" + {"xdigit": "XDigit"}.get(m[1], m[1].capitalize()) + "}", pattern)


@dataclass(frozen=True, repr=False)
class And(Predicate):
    parts: tuple

    def __repr__(self) -> str:
        return " & ".join(f"({p!r})" if isinstance(p, Or) else repr(p) for p in self.parts)

    def is_atomic(self) -> bool:
        return False

    def columns(self) -> set[str]:
        return set().union(*[p.columns() for p in self.parts])

    def tables(self) -> list:
        return list(dict.fromkeys(t for p in self.parts for t in p.tables()))

    def column(self, kinds: dict[str, str]) -> Column:
        return reduce(lambda a, b: a & b, [p.column(kinds) for p in self.parts])

    def regions(self, spark: SparkSession) -> RegionSet:
        return reduce(lambda a, b: a & b, [p.regions(spark) for p in self.parts])


@dataclass(frozen=True, repr=False)
class Or(Predicate):
    parts: tuple

    def __repr__(self) -> str:
        return " | ".join(map(repr, self.parts))

    def is_atomic(self) -> bool:
        return False

    def columns(self) -> set[str]:
        return set().union(*[p.columns() for p in self.parts])

    def tables(self) -> list:
        return list(dict.fromkeys(t for p in self.parts for t in p.tables()))

    def column(self, kinds: dict[str, str]) -> Column:
        return reduce(lambda a, b: a | b, [p.column(kinds) for p in self.parts])

    def regions(self, spark: SparkSession) -> RegionSet:
        return reduce(lambda a, b: a | b, [p.regions(spark) for p in self.parts])


@dataclass(frozen=True, repr=False)
class Not(Predicate):
    part: Predicate

    def __repr__(self) -> str:
        return f"!({self.part!r})"

    def is_atomic(self) -> bool:
        return False

    def columns(self) -> set[str]:
        return self.part.columns()

    def tables(self) -> list:
        return self.part.tables()

    def column(self, kinds: dict[str, str]) -> Column:
        return ~self.part.column(kinds)


@dataclass(frozen=True, repr=False)
class InRegions(Predicate):
    """Position in a set of regions, as part of a larger expression; for a few regions only (see RegionSet.filter)."""

    rows: tuple
    include: bool = True

    def __repr__(self) -> str:
        return f"{'' if self.include else '!'}regions({len(self.rows)})"

    def columns(self) -> set[str]:
        return {"chr", "pos"}

    def column(self, kinds: dict[str, str]) -> Column:
        c = expression(list(self.rows))
        return c if self.include else F.col("chr").isNotNull() & F.col("pos").isNotNull() & ~c


@dataclass(frozen=True)
class Name:
    """A column in an expression."""

    name: str

    def _cmp(self, op: str, v: Any) -> Cmp:
        return Cmp(op, self.name, v)

    def __lt__(self, v: Any) -> Cmp:
        return self._cmp("<", v)

    def __le__(self, v: Any) -> Cmp:
        return self._cmp("<=", v)

    def __gt__(self, v: Any) -> Cmp:
        return self._cmp(">", v)

    def __ge__(self, v: Any) -> Cmp:
        return self._cmp(">=", v)

    def eq(self, v: Any) -> Cmp:
        return self._cmp("==", v)

    def ne(self, v: Any) -> Cmp:
        return self._cmp("!=", v)

    def isin(self, *values: Any) -> In:
        flat = values[0] if len(values) == 1 and isinstance(values[0], (list, tuple, set, range)) else values
        return In(self.name, tuple(flat))

    def matches(self, pattern: str) -> Matches:
        return Matches(self.name, pattern)

    def __repr__(self) -> str:
        return self.name


def col(name: str) -> Name:
    return Name(name)


# ---- reading conditions from text

_TOKEN = re.compile(r"""\s*(?:(?P<num>(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)L?|(?P<str>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<op>%in%|%like%|<=|>=|==|!=|&&?|\|\|?|[<>()!,:-])|(?P<name>`[^`]+`|[A-Za-z.][\w.]*))""")


def parse(text: str, columns: list[str] | None = None, values: dict[str, Any] | None = None) -> Predicate:
    """A predicate from text such as ``chr == 1 & pval < 5e-8 | rsid %in% c("rs1", "rs2")``.

    Names that are no column are looked up in ``values``: predicates, sets of regions, tables of values, lists or literals.
    """
    toks: list[tuple[str, str]] = []
    at = 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"cannot read the condition at {text[at:]!r}")
        toks.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    toks.append(("end", ""))
    values = values or {}
    i = 0

    def peek() -> str:
        return toks[i][1] if toks[i][0] in ("op", "end") else ""

    def take(want: str | None = None) -> tuple[str, str]:
        nonlocal i
        if want is not None and toks[i][1] != want:
            raise ValueError(f"expected {want!r} in {text!r}")
        i += 1
        return toks[i - 1]

    def operand() -> Any:
        kind, t = take()
        if kind == "num":
            v: Any = float(t) if re.search(r"[.eE]", t) else int(t)
            if peek() == ":":
                take()
                return list(range(int(v), int(take()[1]) + 1))
            return v
        if kind == "op" and t == "-":
            return -operand()
        if kind == "str":
            return re.sub(r"\\(.)", r"\1", t[1:-1])
        if kind == "name" and t == "c" and peek() == "(":
            take("(")
            out: list = []
            while peek() != ")":
                v = operand()
                out += v if isinstance(v, list) else [v]
                if peek() == ",":
                    take()
            take(")")
            return out
        if kind == "name":
            name = t.strip("`")
            if name in ("TRUE", "FALSE"):
                return name == "TRUE"
            if name in values and not (columns and name in columns):
                return values[name]
            if columns is not None and name not in columns:
                raise ValueError(f"{name!r} is neither a column nor a value")
            return Name(name)
        raise ValueError(f"unexpected {t!r} in {text!r}")

    def atom() -> Predicate:
        if peek() == "!":
            take()
            return ~atom()
        if peek() == "(":
            take()
            p = either()
            take(")")
            return p
        if toks[i] == ("name", "grepl"):
            take()
            take("(")
            pattern = operand()
            take(",")
            name = operand()
            take(")")
            return Matches(name.name, pattern)
        left = operand()
        op = peek()
        if op in FLIP:
            take()
            right = operand()
            if isinstance(left, Name):
                return Cmp(op, left.name, right)
            if isinstance(right, Name):
                return Cmp(FLIP[op], right.name, left)
            raise ValueError(f"a comparison in {text!r} names no column")
        if op in ("%in%", "%like%") and isinstance(left, Name):
            take()
            right = operand()
            if op == "%like%":
                return Matches(left.name, right)
            if isinstance(right, TableValues):
                right.names.append(left.name)
                return InTable(left.name, right)
            return In(left.name, tuple(right) if isinstance(right, (list, tuple, set, range)) else (right,))
        if isinstance(left, Predicate):
            return left
        raise ValueError(f"{left!r} is no condition")

    def both() -> Predicate:
        p = atom()
        while peek() in ("&", "&&"):
            take()
            p = p & atom()
        return p

    def either() -> Predicate:
        p = both()
        while peek() in ("|", "||"):
            take()
            p = p | both()
        return p

    if toks[0][0] == "end":
        return Always()
    p = either()
    if toks[i][0] != "end":
        raise ValueError(f"cannot read the rest of {text!r}")
    return p
