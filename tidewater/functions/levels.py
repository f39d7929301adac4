"""Levels, keys and their text forms, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: P clean, e may fail, d reads its environment, s has side effects; s > d > e > p.
LEVELS = ("p", "e", "d", "s")
FUNCTIONS = "fn_id string, kind string, module string, name string, arity int, level tinyint, at_least boolean"
DEPS = "fn_id string, call_id bigint, dep_kind string, target_id string, arg_pos int, var string"
DEP_ARGS = "fn_id string, call_id bigint, target_id string, kind string, pos int, from_pos int, passed_id string, var string"
RULES = "fn_id string, kind string, level tinyint, at_least boolean, deps array<struct<dep_kind:string,target_id:string,arg_pos:int>>"


def sup(*levels: Column | str) -> Column:
    """Least upper bound of levels in a row (in a group: F.max)."""
    return F.greatest(*levels)


def level_name(level: Column | str = "level") -> Column:
    return F.element_at(F.array(*map(F.lit, LEVELS)), F.col(level) + 1 if isinstance(level, str) else level + 1)


def level_number(name: Column) -> Column:
    return (F.array_position(F.array(*map(F.lit, LEVELS)), name) - 1).cast("tinyint")


def fmt_key(kind: str = "kind", module: str = "module", name: str = "name", arity: str = "arity") -> Column:
    """``m:f/a``; primitive operations ``p:/a``; expressions ``erl:..``."""
    tail = F.concat(F.lit("/"), F.col(arity).cast("string"))
    return F.when(F.col(kind) == "primop", F.concat(name, F.lit(":"), tail)).when(F.col(kind) == "erl", F.concat(F.lit("erl:"), name)).otherwise(F.concat(module, F.lit(":"), name, tail))


def is_mfa(kind: str = "kind") -> Column:
    return F.col(kind) == "mfa"


def is_primop(kind: str = "kind") -> Column:
    return F.col(kind) == "primop"


def is_expr(kind: str = "kind") -> Column:
    return F.col(kind) == "erl"


def internal(name: str = "name", arity: str = "arity") -> Column:
    """Functions that a compiler adds."""
    return (F.col(name) == "module_info") & F.col(arity).isin(0, 1) | (F.col(name) == "record_info") & (F.col(arity) == 2)


def map_to_level(level: str, strictness: int) -> Column:
    """True where the level counts as clean at strictness 1 (all but s), 2 (p, e) or 3 (p)."""
    return F.col(level) < 4 - strictness


def fmt_result(level: str = "level", at_least: str = "at_least", deps: str = "deps") -> Column:
    """``>= e [d1, d2]``: lower bound, level, and what is left of the dependencies."""
    left = F.when(F.size(deps) > 0, F.concat(F.lit(" ["), F.array_join(F.transform(deps, dep_label), ", "), F.lit("]"))).otherwise(F.lit(""))
    return F.concat(F.when(F.col(at_least), ">= ").otherwise(""), level_name(level), left)


def dep_label(d: Column) -> Column:
    """An argument's position alone, else the target's id; without the call's arguments."""
    return F.when(d["dep_kind"] == "arg", d["arg_pos"].cast("string")).otherwise(F.coalesce(d["target_id"], F.lit("undefined")))


def checksum(content: Column | str) -> Column:
    """I4."""
    return F.md5(content)


def option_key(options: Column, relevant: list[str]) -> Column:
    """The relevant options, sorted and once each, joined by commas."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(options, lambda o: o.isin(relevant)))), ",")


def parse_expected(value: Column) -> Column:
    """I8: ``(>= )?[peds] deps?`` as a struct (level, at_least, deps string); null fields if it isn't of that form."""
    part = lambda k: F.regexp_extract(value, r"^\s*(>= )?([peds])(?:\s+(\[.*\]))?\s*\.?\s*$", k)
    return F.struct(level_number(F.nullif(part(2), F.lit(""))).alias("level"), (part(1) != "").alias("at_least"), F.coalesce(F.nullif(part(3), F.lit("")), F.lit("[]")).alias("deps"))
