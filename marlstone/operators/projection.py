"""SELECT: dotted paths are built again as nested values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import Flags, Missing, Records, Variant


def project_typed(df: DataFrame, paths: Sequence[str], records: Records, flags: Flags, score: Column | None) -> DataFrame:
    """One column for each first segment, structs for the rest; unknown paths are left out, a later one replaces an earlier."""
    tree: dict = {}
    for path in paths:
        if path.upper() == "SCORE":
            tree["SCORE"] = F.lit(0.0) if score is None else score
            continue
        value = records.value(path, flags)
        if not isinstance(value, Missing):
            _insert(tree, path.split("."), value.column)
    return df.select(*(_nested(v).alias(k) for k, v in tree.items()))


def _insert(tree: dict, segments: list[str], column: Column) -> None:
    for s in segments[:-1]:
        tree = tree.setdefault(s, {})
        if not isinstance(tree, dict):  # a value stands where an object would have to
            return
    tree[segments[-1]] = column


def _nested(node: dict | Column) -> Column:
    return F.struct(*(_nested(v).alias(k) for k, v in node.items())) if isinstance(node, dict) else node


def project_json(paths: Sequence[str], records: Records, flags: Flags, score: Column | None) -> Column:
    """JSON text of a record with the paths that it has; keys come sorted."""
    tree: dict = {}
    for path in paths:
        if path.upper() == "SCORE":
            tree["SCORE"] = F.format_string("%s", F.coalesce(F.lit(0.0) if score is None else score, F.lit(0.0)))
        elif path != "*":
            value = records.value(path, flags)
            assert isinstance(value, Variant)
            _insert(tree, path.split("."), F.to_json(value.column))
    return _object(tree)[0]


def _object(tree: dict) -> tuple[Column, Column]:
    """JSON text of an object, and whether any of its members is there; objects without members are left out below the top."""
    members, some = [], F.lit(False)
    for k, v in sorted(tree.items()):
        text, there = _object(v) if isinstance(v, dict) else (v, v.isNotNull())
        members.append(F.when(there, F.concat(F.lit(f'"{k}":'), text)))
        some = some | there
    return F.concat(F.lit("{"), F.concat_ws(",", *members) if members else F.lit(""), F.lit("}")), some
