"""Node predicates. A predicate makes a boolean Column from a way to read a node's fields,
so the same one works on rows of a node table and on structs of a nested page. Nodes
that are no elements never match; comparisons are exact and case-sensitive; a null
field never matches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Field = Callable[[str], Column]
CLASS_SPLIT = "[\\t\\n\\r\\f ]"  # fixed value: what separates class tokens


class Predicate:
    """Combine with ``&``, ``|`` and ``~``. ``on_row()`` is the Column for a node table,
    ``on_struct(x)`` the one for a node struct."""

    def __init__(self, build: Callable[[Field], Column], tag_name: str | None = None):
        self.build = build
        self.tag_name = tag_name

    def on_row(self) -> Column:
        # null means no match, as in any filter; left as it is, so that comparisons reach the scan
        return self.build(F.col)

    def on_struct(self, x: Column) -> Column:
        return self.build(lambda f: x[f])

    def __and__(self, other: Predicate) -> Predicate:
        return Predicate(lambda f: self.build(f) & other.build(f))

    def __or__(self, other: Predicate) -> Predicate:
        return Predicate(lambda f: F.coalesce(self.build(f), F.lit(False)) | F.coalesce(other.build(f), F.lit(False)))

    def __invert__(self) -> Predicate:
        return Predicate(lambda f: ~F.coalesce(self.build(f), F.lit(False)))


def _value(f: Field, name: str) -> Column:
    return F.get(F.filter(f("attrs"), lambda a: a["name"] == name), F.lit(0))["value"]


def _tokens(f: Field) -> Column:
    return F.split(_value(f, "class"), CLASS_SPLIT)


def _element(f: Field) -> Column:
    return f("kind").isin("element", "document")


def tag(name: str) -> Predicate:
    return Predicate(lambda f: _element(f) & (f("local_name") == name), name)


def with_id(ident: str) -> Predicate:
    return Predicate(lambda f: _element(f) & (_value(f, "id") == ident))


def with_class(name: str) -> Predicate:
    """One of the class tokens, or the whole value."""
    if name == "":
        return Predicate(lambda f: _element(f) & (_value(f, "class") == ""))
    return Predicate(lambda f: _element(f) & ((_value(f, "class") == name) | F.array_contains(_tokens(f), name)))


def with_classes(one: str, two: str) -> Predicate:
    """Both among the class tokens; never if they are the same, or empty."""
    if one == two or not one or not two:
        return Predicate(lambda f: F.lit(False))
    return Predicate(lambda f: _element(f) & F.array_contains(_tokens(f), one) & F.array_contains(_tokens(f), two))


def with_attr(name: str, value: str | None = None) -> Predicate:
    """The attribute is there, and has the value if one is given."""
    if value is None:
        return Predicate(lambda f: _element(f) & F.exists(f("attrs"), lambda a: a["name"] == name))
    return Predicate(lambda f: _element(f) & (_value(f, name) == value))


def tag_id(name: str, ident: str) -> Predicate:
    return tag(name) & with_id(ident)


def tag_class(name: str, cls: str) -> Predicate:
    return tag(name) & with_class(cls)


def tag_classes(name: str, one: str, two: str) -> Predicate:
    return tag(name) & with_classes(one, two)


def where(build: Callable[[Field], Column]) -> Predicate:
    """Any condition on a node's fields: ``where(lambda f: f("depth") > 3)``."""
    return Predicate(build)


def get_attribute(name: str, attrs: str | Column = "attrs") -> Column:
    """The value of an attribute, empty if missing."""
    a = F.col(attrs) if isinstance(attrs, str) else attrs
    return F.coalesce(F.get(F.filter(a, lambda x: x["name"] == name), F.lit(0))["value"], F.lit(""))


def has_attribute(name: str, attrs: str | Column = "attrs") -> Column:
    a = F.col(attrs) if isinstance(attrs, str) else attrs
    return F.coalesce(F.exists(a, lambda x: x["name"] == name), F.lit(False))


def same_attributes(a: Column, b: Column) -> Column:
    """Whether two attribute lists hold the same names and values, in any order."""
    return F.array_sort(F.coalesce(a, F.array())) == F.array_sort(F.coalesce(b, F.array()))
