"""Filter trees to Columns: one recursive translation for filters, orderings and lambda bodies.

Navigation paths of an entity are left-joined once for each prefix (their targets are unique
by declaration), so that Catalyst sees plain joins; lambdas become EXISTS subqueries, which it
plans as semi, anti or existence joins.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from itertools import count
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import functions
from ..ast import Binary, Call, In, Lambda, Literal, Path, Search, Term, Unary
from ..edm import EntitySpec, Nav, Registry, SPARK_TYPES
from ..errors import Unsupported, ValidationError

COMPARE = {"eq": "__eq__", "ne": "__ne__", "lt": "__lt__", "le": "__le__", "gt": "__gt__", "ge": "__ge__"}
NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
TIMES = ("date", "timestamp", "timestamp_ntz")
_names = count()


@dataclass
class Binding:
    """An entity in reach: the root, or a lambda's range variable. joins: navigation prefixes by alias."""

    spec: EntitySpec
    alias: str
    var: str | None = None
    joins: dict[tuple[str, ...], str] = field(default_factory=dict)


def all_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns)


class Translator:
    def __init__(self, registry: Registry, request: Any = None, max_depth: int | None = None, operation: str = "read"):
        self.registry, self.request, self.max_depth, self.operation = registry, request, max_depth, operation

    def new_alias(self, hint: str) -> str:
        return f"n{next(_names)}_{hint}"

    # -- entry points

    def where(self, df: DataFrame, spec: EntitySpec, node: Any, allow_it: bool = True) -> DataFrame:
        """Rows of df for which the filter holds."""
        self.check_depth(node)
        if not allow_it and any(p.it for p in _paths(node)):
            raise Unsupported("$it inside $expand is not supported")
        root = Binding(spec, self.new_alias(spec.name))
        joined = self.join_paths(df.alias(root.alias), root, [p.parts for p in _paths(node, root=True)])
        kept = joined.where(self.predicate(node, [root]))
        return kept.select(*[F.col(f"{root.alias}.{c}") for c in df.columns]) if root.joins else kept

    def check_depth(self, node: Any) -> None:
        limit = self.max_depth or self.registry.options.max_filter_depth

        def depth(x: Any) -> int:
            if isinstance(x, Binary):
                return 1 + max(depth(x.left), depth(x.right))
            if isinstance(x, Unary):
                return depth(x.operand)
            if isinstance(x, Lambda):
                return depth(x.predicate)
            return 0

        if depth(node) > limit:
            raise ValidationError(f"the filter is deeper than {limit}")

    def join_paths(self, df: DataFrame, binding: Binding, paths: list[tuple[str, ...]]) -> DataFrame:
        """One left join for each distinct navigation prefix of the paths."""
        for prefix in sorted({p[: i + 1] for p in paths for i in range(len(p) - 1)}, key=len):
            spec, left = binding.spec, binding.alias
            for i, name in enumerate(prefix):
                nav = self.single(spec, name)
                spec, here = self.registry.target(nav), prefix[: i + 1]
                if here in binding.joins:
                    left = binding.joins[here]
                    continue
                alias = self.new_alias(name)
                target = self.registry.df(spec, "navigation", here, self.request).alias(alias)
                df = df.join(target, all_of([F.col(f"{left}.{a}") == F.col(f"{alias}.{b}") for a, b in nav.on]), "left")
                binding.joins[here] = left = alias
        return df

    def single(self, spec: EntitySpec, name: str) -> Nav:
        nav = self.registry.nav(spec, name)
        if nav is None:
            if name in self.registry.properties(spec):
                raise ValidationError(f"{name} of {spec.name} is not a navigation", target=name)
            raise ValidationError(f"{spec.name} has no navigation {name!r}", target=name)
        if nav.many:
            raise ValidationError(f"{name} is a collection; use any or all", target=name)
        return nav

    # -- names

    def resolve(self, path: Path, scope: list[Binding]) -> tuple[Column, T.DataType]:
        parts, binding = path.parts, scope[0]
        if not path.it and len(scope) > 1:
            for b in reversed(scope):
                if b.var == parts[0]:
                    binding, parts = b, parts[1:]
                    break
            if not parts:
                raise ValidationError(f"{path.parts[0]} needs a property")
        level = len(scope) - 1 - scope.index(binding)
        if level > 1:
            raise Unsupported("a property of the outermost entity inside two lambdas is not supported")
        spec, alias = binding.spec, binding.alias
        for name in parts[:-1]:
            spec = self.registry.target(self.single(spec, name))
        if len(parts) > 1:
            alias = binding.joins[tuple(parts[:-1])]
        if self.registry.nav(spec, parts[-1]):
            raise ValidationError(f"{parts[-1]} is a navigation, not a property", target=parts[-1])
        kind = self.registry.property(spec, parts[-1])
        column = F.col(f"{alias}.{parts[-1]}")
        return (column.outer() if level else column), kind

    # -- expressions

    def predicate(self, node: Any, scope: list[Binding]) -> Column:
        column, kind = self.column(node, scope)
        if kind not in ("boolean", "null"):
            raise ValidationError("a condition must be true or false")
        return column

    def column(self, node: Any, scope: list[Binding]) -> tuple[Column, str]:
        """The column, and its simple type name."""
        match node:
            case Literal(value, kind):
                return self.literal(value, kind)
            case Path():
                column, kind = self.resolve(node, scope)
                return column, _simple(kind)
            case Unary("not", operand):
                return ~self.predicate(operand, scope), "boolean"
            case Unary("neg", operand):
                column, kind = self.column(operand, scope)
                self.number(kind)
                return -column, kind
            case Binary("and", left, right):
                return self.predicate(left, scope) & self.predicate(right, scope), "boolean"
            case Binary("or", left, right):
                return self.predicate(left, scope) | self.predicate(right, scope), "boolean"
            case Binary("has"):
                raise Unsupported("has is not supported")
            case Binary(op, left, right) if op in COMPARE:
                return self.compare(op, left, right, scope), "boolean"
            case Binary(op, left, right):
                (a, ka), (b, kb) = self.column(left, scope), self.column(right, scope)
                self.number(ka), self.number(kb)
                integral = ka in functions.INTEGRAL and kb in functions.INTEGRAL
                kind = "bigint" if integral and op != "divby" else "double"
                return functions.arithmetic(op, a, b, integral), kind
            case In(operand, items):
                return reduce(lambda x, y: x | y, [self.compare("eq", operand, i, scope) for i in items]), "boolean"
            case Call("cast", args):
                if not isinstance(args[1], Literal) or args[1].value not in SPARK_TYPES:
                    raise Unsupported("cast to this type is not supported")
                kind = SPARK_TYPES[args[1].value]
                return self.column(args[0], scope)[0].try_cast(kind), kind
            case Call(name, args):
                built = [self.column(a, scope) for a in args]
                if name in ("contains", "startswith", "endswith", "length", "tolower", "toupper", "trim", "indexof", "substring", "matchesPattern") and built[0][1] not in ("string", "null"):
                    raise ValidationError(f"{name} needs a string")
                if name in ("year", "month", "day", "hour", "minute", "second", "date", "time") and built[0][1] not in (*TIMES, "null"):
                    raise ValidationError(f"{name} needs a date")
                column = functions.call(name, [c for c, _ in built])
                return column, functions.SCALAR[name][1] or built[0][1]
            case Lambda():
                return self.exists(node, scope), "boolean"
        raise Unsupported(f"cannot translate {node!r}")

    def literal(self, value: Any, kind: str) -> tuple[Column, str]:
        if kind == "datetime":
            return F.lit(value.isoformat()).cast("timestamp_ntz"), "timestamp_ntz"
        if kind == "int":
            return F.lit(value), "int" if abs(value) < 2**31 else "bigint"
        return F.lit(value), {"string": "string", "guid": "string", "decimal": "decimal", "bool": "boolean", "null": "null", "date": "date"}[kind]

    def number(self, kind: str) -> None:
        if kind not in (*NUMBERS, "null"):
            raise ValidationError("arithmetic needs numbers")

    def compare(self, op: str, left: Any, right: Any, scope: list[Binding]) -> Column:
        for a, b in ((left, right), (right, left)):
            if isinstance(b, Literal) and b.kind == "null":
                if op not in ("eq", "ne"):
                    return F.lit(None).cast("boolean")
                column = self.column(a, scope)[0]
                return column.isNull() if op == "eq" else column.isNotNull()
        (a, ka), (b, kb) = self.column(left, scope), self.column(right, scope)
        family = lambda k: "number" if k in NUMBERS else "time" if k in TIMES else k
        if family(ka) != family(kb) and "null" not in (ka, kb):
            if "time" in (family(ka), family(kb)) and "string" in (ka, kb):
                a, b = (a.try_cast(kb), b) if ka == "string" else (a, b.try_cast(ka))
            else:
                raise ValidationError(f"cannot compare {ka} with {kb}")
        return getattr(a, COMPARE[op])(b)

    def exists(self, node: Lambda, scope: list[Binding]) -> Column:
        """any: EXISTS(related and predicate); all: NOT EXISTS(related and not predicate)."""
        parts, binding = node.path.parts, scope[0]
        if len(parts) == 2:
            binding = next((b for b in scope if b.var == parts[0]), None)
            if binding is None:
                raise ValidationError(f"no range variable {parts[0]!r}")
        if scope.index(binding) != len(scope) - 1:
            raise Unsupported("a lambda over an outer entity's collection is not supported here")
        nav = next((n for n in binding.spec.navs if n.name.lower() == parts[-1].lower()), None)
        if nav is None or not nav.many:
            raise ValidationError(f"{parts[-1]} is not a collection of {binding.spec.name}", target=parts[-1])
        if node.predicate is None and node.op == "all":
            return F.lit(True)
        spec = self.registry.target(nav)
        inner = Binding(spec, self.new_alias(nav.name), node.var)
        child = self.registry.df(spec, "lambda", (nav.name,), self.request).alias(inner.alias)
        if nav.through is None:
            link = [F.col(f"{inner.alias}.{b}") == F.col(f"{binding.alias}.{a}").outer() for a, b in nav.on]
        else:
            junction = self.new_alias("junction")
            child = nav.through(self.registry.spark).alias(junction).join(child, all_of([F.col(f"{junction}.{a}") == F.col(f"{inner.alias}.{b}") for a, b in nav.via]))
            link = [F.col(f"{junction}.{b}") == F.col(f"{binding.alias}.{a}").outer() for a, b in nav.on]
        condition = all_of(link)
        if node.predicate is not None:
            paths = [p.parts[1:] for p in _paths(node.predicate) if p.parts[0] == node.var and not p.it]
            child = self.join_paths(child, inner, paths)
            holds = self.predicate(node.predicate, [*scope, inner])
            condition = condition & (holds if node.op == "any" else ~holds)
        found = child.where(condition).exists()
        return found if node.op == "any" else ~found

    # -- search

    def search(self, df: DataFrame, spec: EntitySpec, node: Any) -> DataFrame:
        if spec.search is not None:
            return df.where(spec.search(node, df, spec))
        if not spec.searchable:
            raise ValidationError(f"{spec.set} has no searchable properties")

        def build(x: Any) -> Column:
            if isinstance(x, Search):
                return reduce((lambda a, b: a & b) if x.op == "AND" else (lambda a, b: a | b), [build(p) for p in x.parts])
            assert isinstance(x, Term)
            found = reduce(lambda a, b: a | b, [F.lower(F.col(p)).contains(x.text.lower()) for p in spec.searchable])
            return ~found if x.negated else found

        return df.where(build(node))

    def order(self, df: DataFrame, spec: EntitySpec, items: tuple, ties: bool = True) -> list[Column]:
        """Sort columns, with the key appended as a tie-breaker."""
        scope, out = [Binding(spec, self.new_alias(spec.name))], []
        for item in items:
            if any(len(p.parts) > 1 for p in _paths(item.expr)):
                raise Unsupported("ordering by a navigation path is not supported")
            column = self.column(item.expr, scope)[0]
            out.append(column.desc_nulls_last() if item.descending else column.asc_nulls_first())
        self._order_alias = scope[0].alias
        return [*out, *([F.col(f"{scope[0].alias}.{k}").asc() for k in spec.key] if ties else [])]

    def sorted(self, df: DataFrame, spec: EntitySpec, items: tuple, ties: bool = True) -> DataFrame:
        columns = self.order(df, spec, items, ties)
        return df.alias(self._order_alias).orderBy(*columns) if columns else df


def _simple(kind: T.DataType) -> str:
    return "decimal" if isinstance(kind, T.DecimalType) else kind.simpleString()


def _paths(node: Any, root: bool = False, bound: frozenset = frozenset()) -> list[Path]:
    """Property paths in a tree; root: only those of the root entity, with range variables left out."""
    match node:
        case Path():
            return [] if root and not node.it and node.parts[0] in bound else [node]
        case Binary(_, a, b):
            return _paths(a, root, bound) + _paths(b, root, bound)
        case Unary(_, a):
            return _paths(a, root, bound)
        case In(a, items):
            return [p for x in (a, *items) for p in _paths(x, root, bound)]
        case Call(_, args):
            return [p for x in args for p in _paths(x, root, bound)]
        case Lambda(_, _, var, body) if body is not None:
            return _paths(body, root, bound | {var})
    return []
