"""Three-valued predicates, compiled to columns. TRUE, FALSE and UNKNOWN are true, false and null.

A predicate is a nested mapping: {"const": true|false|null}, {"all": [...]}, {"any": [...]}, {"not": p}, or
{"fact": {"id": name, "op": op, "value": v}} with op present, eq, ne, gt, ge, lt, le, in or contains. Compiled to a column, a predicate is folded, pushed down and
pruned like any other filter.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_COMPARE = {"eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b}


def unknown() -> Column:
    return F.lit(None).cast("boolean")


def _family(x) -> str:
    if isinstance(x, (bool, T.BooleanType)):
        return "bool"
    if isinstance(x, (int, float, T.NumericType)):
        return "number"
    return "text" if isinstance(x, (str, T.StringType)) else type(x).__name__


def compile_predicate(predicate, schema: T.StructType) -> Column:
    """The predicate over columns of schema. A missing predicate is TRUE; unknown facts are UNKNOWN, but for present (FALSE) and in and
    contains (FALSE, as no container holds it); values of another kind than the fact's compare to UNKNOWN. Anything malformed raises
    ValueError here, never at run time."""
    if predicate is None:
        return F.lit(True)
    if isinstance(predicate, str):
        predicate = json.loads(predicate)
    if not isinstance(predicate, dict) or len(predicate) != 1:
        raise ValueError(f"a predicate is a mapping with one key: {predicate!r}")
    (kind, body), types = next(iter(predicate.items())), {f.name: f.dataType for f in schema}
    if kind == "const":
        if body not in (True, False, None):
            raise ValueError(f"no truth value: {body!r}")
        return unknown() if body is None else F.lit(body)
    if kind in ("all", "any"):
        parts = [compile_predicate(p, schema) for p in body]
        return reduce(lambda a, b: a & b if kind == "all" else a | b, parts, F.lit(kind == "all"))
    if kind == "not":
        return ~compile_predicate(body, schema)
    if kind != "fact" or not isinstance(body, dict) or "id" not in body:
        raise ValueError(f"no predicate: {predicate!r}")
    name, op, value = body["id"], body.get("op", "present"), body.get("value")
    known = types.get(name)
    if op == "present":
        return F.col(name).isNotNull() if known is not None else F.lit(False)
    if op == "in":
        same = [v for v in value or [] if known is not None and _family(v) == _family(known)]
        return F.coalesce(F.col(name).isin(same), F.lit(False)) if same else F.lit(False)
    if op == "contains":
        if isinstance(known, T.ArrayType):
            return F.coalesce(F.array_contains(name, value), F.lit(False))
        return F.coalesce(F.col(name).contains(value), F.lit(False)) if isinstance(known, T.StringType) and isinstance(value, str) else F.lit(False)
    if op not in _COMPARE:
        raise ValueError(f"no operation: {op!r}")
    return unknown() if known is None or value is None or _family(known) != _family(value) else _COMPARE[op](F.col(name), F.lit(value))


def facts_of(predicate) -> list[str]:
    """The facts a predicate looks at, in order, once each."""
    if isinstance(predicate, str):
        predicate = json.loads(predicate)
    if isinstance(predicate, dict):
        inner = [predicate["fact"]["id"]] if "fact" in predicate else [x for v in predicate.values() for x in facts_of(v)]
    else:
        inner = [x for p in predicate for x in facts_of(p)] if isinstance(predicate, list) else []
    return list(dict.fromkeys(inner))


def truth_table(rows: DataFrame, predicates: dict[str, object]) -> DataFrame:
    """predicate, truth (TRUE, FALSE, UNKNOWN), rows: one pass over the rows for all predicates."""
    truth = lambda c: F.when(c, "TRUE").when(~c, "FALSE").otherwise("UNKNOWN")
    cols = F.array(*[F.struct(F.lit(n).alias("predicate"), truth(compile_predicate(p, rows.schema)).alias("truth")) for n, p in predicates.items()])
    return rows.select(F.explode(cols).alias("x")).groupBy("x.predicate", "x.truth").agg(F.count(F.lit(1)).alias("rows"))
