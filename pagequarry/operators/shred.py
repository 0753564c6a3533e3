"""Deeply nested records as flat tables, by columnar shredding.

Every leaf path of a nested column becomes a *level column*: the sequence of its values with a repetition
level (the depth of the innermost array that goes on; 0 starts a record) and a definition level (how many
of the path's arrays, array entries and optional structs are present). Level columns alone, without the
records, are enough to rebuild one flat table per repeated ancestor, with parent-child links.

Both steps work on Arrow offsets and validity bitmaps with numpy, a batch at a time; a record lies in one
batch, so the operator is a narrow map without any shuffle and reads only the nested columns asked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class LevelColumn:
    """One leaf path: steps such as ("primary_nav", "[]", "url"), levels, and the values where fully defined."""

    path: tuple[str, ...]
    repetition: np.ndarray
    definition: np.ndarray
    max_definition: int
    #: Definition level from which the entry of the k-th array on the path exists (null entries included).
    entry_level: list[int]
    #: Definition level from which that entry is not null.
    value_level: list[int]
    values: pa.Array


def _fields(kind: pa.DataType) -> list[pa.Field]:
    return [kind.field(i) for i in range(kind.num_fields)]


def shred_column(column: pa.Array, name: str) -> list[LevelColumn]:
    """Level columns of all leaves below one top-level column."""
    n = len(column)
    out: list[LevelColumn] = []

    # slots: positions of `array` that each running entry of the level columns points to, -1 where undefined
    def walk(array: pa.Array, path, slots, rep, definition, level, depth, entry_level, value_level):
        valid = np.ones(len(array), bool) if array.null_count == 0 else np.asarray(array.is_valid())
        here = slots >= 0
        defined = here.copy()
        defined[here] = valid[slots[here]]
        definition = definition + defined
        level += 1
        slots = np.where(defined, slots, -1)
        if path and path[-1] == "[]":
            value_level = [*value_level, level]
        kind = array.type
        if pa.types.is_struct(kind):
            for i, field in enumerate(_fields(kind)):
                walk(array.field(i), (*path, field.name), slots, rep, definition, level, depth, entry_level, value_level)
        elif pa.types.is_list(kind) or pa.types.is_large_list(kind):
            offsets = np.asarray(array.offsets).astype(np.int64)
            starts = np.where(slots >= 0, offsets[slots], 0)
            counts = np.where(slots >= 0, offsets[slots + 1] - offsets[slots], 0)
            width = np.maximum(counts, 1)  # an empty or missing array still has one entry in the level column
            first = np.repeat(np.cumsum(width) - width, width)
            within = np.arange(len(first)) - first
            exists = np.repeat(counts > 0, width)
            inner = np.where(exists, np.repeat(starts, width) + within, -1)
            rep = np.where(within > 0, depth + 1, np.repeat(rep, width))
            definition = np.repeat(definition, width) + exists
            walk(array.values, (*path, "[]"), inner, rep, definition, level + 1, depth + 1, [*entry_level, level + 1], value_level)
        else:
            picked = slots[slots >= 0]
            out.append(LevelColumn(path, rep, definition, level, entry_level, value_level, array.take(pa.array(picked))))

    walk(column, (name,), np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64), 0, 0, [], [])
    return out


def positions(column: LevelColumn, depth: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Entries of the depth-th array on the path, from the levels alone.

    Returns the index into the level column of each entry's first value, per array level the entry's place
    in its parent array (from 0, null entries included), and its record.
    """
    rep, definition = column.repetition, column.definition
    record = np.cumsum(rep == 0) - 1
    places = []
    start = np.flatnonzero((rep <= depth) & (definition >= column.entry_level[depth - 1]))
    for k in range(1, depth + 1):
        new_entry = rep <= k
        new_parent = rep < k
        count = np.cumsum(new_entry)
        base = np.maximum.accumulate(np.where(new_parent, count, 0))
        places.append((count - base)[start])
    return start, places, record[start]


def table_schema(kind: T.DataType, path: list[str]) -> tuple[T.DataType, int]:
    """Type of the entries of the repeated ancestor at path, and how many arrays the path passes."""
    depth = 0
    for step in path:
        if step == "[]":
            kind, depth = kind.elementType, depth + 1
        else:
            kind = kind[step].dataType
    return kind, depth


def flat_leaves(kind: T.DataType, prefix: str = "") -> list[tuple[str, T.DataType, tuple[str, ...]]]:
    """Leaves reached without passing a further array: (flat name, type, steps)."""
    if isinstance(kind, T.StructType):
        found = []
        for f in kind.fields:
            for name, t, steps in flat_leaves(f.dataType, f"{prefix}{f.name}_"):
                found.append((name, t, (f.name, *steps)))
        return found
    if isinstance(kind, T.ArrayType):
        return []
    return [(prefix[:-1] or "value", kind, ())]


def shred_table(df: DataFrame, id_col: str, path: str, prefix: str = "", outline: str | None = None) -> DataFrame:
    """One flat table per repeated ancestor.

    path: the array, as dotted fields with "[]" for the entries of an outer array, e.g.
    "nav_structure.primary_nav" or "nav_structure.primary_nav[].parent_labels".

    Columns: the record's id (named as id_col), `pos` (place in its array from 0), `outer_pos`
    (array<int>: places in the outer arrays, outermost first; with the id it is the key of the
    parent row), `is_null` (the entry itself is null), and each leaf of the entry that lies below
    no further array, named with prefix. With outline, the name of an integer leaf that holds an outline depth,
    `parent_pos` is added: see outline_parents (for arrays that lie in no other array). Leaf names that clash with these columns get a leading "leaf_".

    Null records, null or empty arrays and null structs on the way give no rows. A null entry gives a
    row with `is_null` and null leaves. Repeated input rows give repeated rows; ids may be null.
    """
    return shred_tables(df, id_col, {"": path}, prefix, outline).drop("list_name")


def _steps(path: str) -> list[str]:
    return [s for part in path.replace("[]", ".[]").split(".") if (s := part)] + ["[]"]


def shred_tables(df: DataFrame, id_col: str, paths: dict[str, str], prefix: str = "", outline: str | None = None) -> DataFrame:
    """Tables of several arrays in one pass over the records, with `list_name` (the key in paths) in front of the
    columns of shred_table. Arrays lie at the same depth; a leaf that an array lacks is null in its rows, and leaves of
    one name have one type."""
    lists, leaves, depths = [], {}, set()
    for name, path in paths.items():
        steps = _steps(path)
        entry, depth = table_schema(df.schema[steps[0]].dataType, steps[1:])
        own = {f"{prefix}{n}": (t, s) for n, t, s in flat_leaves(entry)}
        for n, (t, _) in own.items():
            if leaves.setdefault(n, t) != t:
                raise ValueError(f"{n} has two types")
        lists.append((name, steps, own))
        depths.add(depth)
    if len(depths) > 1:
        raise ValueError("the arrays lie at different depths")
    depth = depths.pop()
    taken = {id_col, "list_name", "pos", "outer_pos", "is_null", "parent_pos"}
    fields = [T.StructField(id_col, df.schema[id_col].dataType), T.StructField("list_name", T.StringType()), T.StructField("pos", T.IntegerType()), T.StructField("outer_pos", T.ArrayType(T.IntegerType())), T.StructField("is_null", T.BooleanType())]
    fields += [T.StructField(f"leaf_{n}" if n in taken else n, t) for n, t in leaves.items()]
    schema = T.StructType(fields + ([T.StructField("parent_pos", T.IntegerType())] if outline else []))
    roots = {root: f"__root{k}" for k, root in enumerate(dict.fromkeys(steps[0] for _, steps, _ in lists))}
    pruned = [_pruned(df.schema[root].dataType, root, [steps[1:] for _, steps, _ in lists if steps[0] == root]).alias(alias) for root, alias in roots.items()]
    narrow = df.select(F.col(f"`{id_col}`").alias("__id"), *pruned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        kinds = {f.name: f.type for f in arrow}
        for batch in batches:
            columns = {c.path: c for alias in roots.values() for c in shred_column(_plain(batch.column(alias)), alias)}
            for name, steps, own in lists:
                where = (roots[steps[0]], *steps[1:])
                some = next((c for p, c in columns.items() if p[: len(where)] == where), None)
                if some is None:
                    continue
                start, places, record = positions(some, depth)
                outer = np.stack(places[:-1], 1).astype(np.int32) if depth > 1 else np.zeros((len(start), 0), np.int32)
                arrays = [
                    batch.column("__id").take(pa.array(record)),
                    pa.array(np.full(len(start), name)) if len(start) else pa.array([], pa.string()),
                    pa.array(places[-1].astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array((np.arange(len(start) + 1) * outer.shape[1]).astype(np.int32)), pa.array(outer.ravel())),
                    pa.array(some.definition[start] < some.value_level[depth - 1]),
                ]
                level = None
                for n in leaves:
                    kind = kinds[f"leaf_{n}" if n in taken else n]
                    if n not in own:
                        arrays.append(pa.nulls(len(start), kind))
                        continue
                    column = columns[(*where, *own[n][1])]
                    begin, _, _ = positions(column, depth)
                    defined = column.definition == column.max_definition
                    index = np.cumsum(defined) - 1
                    arrays.append(column.values.take(pa.array(index[begin], mask=~defined[begin])).cast(kind))
                    if own[n][1] == (outline,):
                        level = arrays[-1]
                if outline:
                    arrays.append(pa.nulls(len(start), pa.int32()) if level is None else pa.array(outline_parents(record, places[-1], level.to_pylist())))
                yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(arrays, arrow)], schema=arrow)

    return narrow.mapInArrow(run, schema)


def _plain(array) -> pa.Array:
    return array.combine_chunks() if isinstance(array, pa.ChunkedArray) else array


def _pruned(kind: T.DataType, root: str, paths: list[list[str]]):
    """The root column cut down to some paths, so that the scan reads only their leaves."""

    def build(col, kind, paths):
        if any(steps == ["[]"] for steps in paths):
            return col
        heads = list(dict.fromkeys(steps[0] for steps in paths))
        rest = {h: [steps[1:] for steps in paths if steps[0] == h] for h in heads}
        if heads == ["[]"]:
            inner = rest["[]"]
            if isinstance(kind.elementType, T.StructType):
                return F.when(col.isNotNull(), F.transform(col, lambda x: F.when(x.isNotNull(), fields(x, kind.elementType, inner))))
            return F.when(col.isNotNull(), F.transform(col, lambda x: build(x, kind.elementType, inner)))
        return F.when(col.isNotNull(), fields(col, kind, paths))

    def fields(col, kind, paths):
        heads = list(dict.fromkeys(steps[0] for steps in paths))
        return F.struct(*[build(col[h], kind[h].dataType, [steps[1:] for steps in paths if steps[0] == h]).alias(h) for h in heads])

    return build(F.col(f"`{root}`"), kind, paths)


def outline_parents(record: np.ndarray, places: np.ndarray, depth: list[int | None]) -> np.ndarray:
    """Per entry the place of the nearest earlier entry of its array with smaller depth, if that is exactly one
    level up, else -1. Entries without depth are neither children nor parents. One pass with a stack."""
    out = np.full(len(depth), -1, np.int32)
    stack: list[tuple[int, int]] = []
    for i, (at, pos, d) in enumerate(zip(record.tolist(), places.tolist(), depth)):
        if i == 0 or at != record[i - 1]:
            stack.clear()
        if d is None:
            continue
        while stack and stack[-1][0] >= d:
            stack.pop()
        if stack and stack[-1][0] == d - 1:
            out[i] = stack[-1][1]
        stack.append((d, pos))
    return out
