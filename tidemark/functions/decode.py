"""Decoded change-log lines to before and after images, as expressions.

A line is `table schema.name: ACTION: fields`. Fields are name[type]:value; quoted values double their
quotes. Markers that are searched for in a line (old-key:, new-tuple:, (no-tuple-data)) count only
outside quoted values. An absent tuple is an empty map; an image that the action doesn't have is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.keys import let

# The patterns of a line and of a field, and what each action is in an envelope.
LINE = r"(?s)^table ([^:]+): (INSERT|UPDATE|DELETE): (.*)$"
#: Possessive, so that very long values don't exhaust the stack of the regular expression engine.
FIELD = r"(?:^|\s)([A-Za-z_][A-Za-z0-9_]*)\[((?:[^\[\]]|\[\])*)\]:('(?:[^']++|'')*+'|\S*)"
QUOTED = r"'(?:[^']++|'')*+'"
OPS = {"INSERT": "c", "UPDATE": "u", "DELETE": "d"}
HEAD = r"^table [^:]+: (?:INSERT|UPDATE|DELETE): "
NEW, OLD, NOTHING = "new-tuple:", ("old-key:", "old-tuple:"), "(no-tuple-data)"


def _value(v: Column) -> Column:
    quoted = v.startswith("'")
    whole = quoted & v.endswith("'") & (F.length(v) > 1)
    inner = F.replace(F.substring(v, F.lit(2), F.length(v) - 2), F.lit("''"), F.lit("'"))
    return F.when(v == "null", F.lit(None).cast("string")).when(whole, inner).when(quoted, F.raise_error(F.lit("unterminated quoted value"))).otherwise(v)


def image(fragment: Column) -> Column:
    """The fields of a fragment as a map of text; unquoted null is null, an open quote is an error."""

    def of(fields: Column) -> Column:  # each whole: name[type]:value
        names = F.transform(fields, lambda f: F.trim(F.substring_index(f, "[", 1), F.lit(" \t\n\r\x0b\x0c")))
        raw = F.transform(fields, lambda f: F.substring(f, F.locate("]:", f) + 2, F.length(f)))
        return F.map_from_arrays(names, F.transform(raw, _value))

    bare = fragment.contains(NOTHING) & F.regexp_replace(fragment, QUOTED, "").contains(NOTHING)
    nothing = F.create_map().cast("map<string,string>")
    return F.when(bare, nothing).otherwise(let(F.regexp_extract_all(fragment, F.lit(FIELD), F.lit(0)), of))


def _unquoted(text: Column) -> Column:
    """text with quoted values replaced by as many other characters, so that places stay."""
    parts = F.regexp_extract_all(text, F.lit(rf"({QUOTED}|[^']++)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.startswith("'"), F.rpad(F.lit("'"), F.length(p), "x")).otherwise(p)), "")


def parse_lines(lines: DataFrame, column: str = "data") -> DataFrame:
    """lines plus table, action, op, before, after; all null where the line is no row change.

    Each step is a projection of its own, so that what later ones use several times is computed once; a
    field is searched for once in each image, and markers only in lines that hold one at all.
    """
    names = [c for c in lines.columns if c not in ("table", "action", "op", "before", "after")]
    own = [F.col(f"`{c}`") for c in names]
    step = lines.select(F.struct(*own).alias("_row"), F.trim(F.col(column)).alias("_line"))
    step = step.select("_row", "_line", F.regexp_extract("_line", HEAD, 0).alias("_head"))
    found = F.length("_head") > 0
    step = step.select("_row", F.when(found, F.regexp_extract("_head", "^table ([^:]+): ", 1)).alias("table"), F.when(found, F.regexp_extract("_head", "([A-Z]+): $", 1)).alias("action"), F.when(found, F.substring(F.col("_line"), F.length("_head") + 1, F.length("_line"))).alias("_rest"))
    marked = F.col("_rest").contains(NEW)
    for m in OLD:
        marked = marked | F.col("_rest").contains(m)
    step = step.select("*", F.when(marked, _unquoted(F.col("_rest"))).otherwise("").alias("_plain"))
    old = F.lit(False)
    for m in OLD:
        old = old | F.col("_plain").contains(m)
    step = step.select("*", F.locate(NEW, F.col("_plain")).alias("_new"), (old | (F.col("action") == "DELETE")).alias("_before_only"), old.alias("_old"))
    both, rest = F.col("_old") & (F.col("_new") > 0), F.col("_rest")
    first = F.when(both, F.substring(rest, F.lit(1), F.col("_new") - 1)).when(F.col("_before_only"), rest)
    second = F.when(both, F.substring(rest, F.col("_new") + len(NEW), F.length(rest))).when(~F.col("_before_only"), rest)
    step = step.select("_row", "table", "action", first.alias("_first"), second.alias("_second"))
    op = F.lit(None).cast("string")
    for k, v in OPS.items():
        op = F.when(F.col("action") == k, F.lit(v)).otherwise(op)
    kept = [F.col("_row").getField(c).alias(c) for c in names]
    return step.select(*kept, "table", "action", op.alias("op"), F.when(F.col("_first").isNotNull(), image(F.col("_first"))).alias("before"), F.when(F.col("_second").isNotNull(), image(F.col("_second"))).alias("after"))


def changes(lines: DataFrame, column: str = "data") -> DataFrame:
    """The row changes of the lines only."""
    return parse_lines(lines, column).where("action is not null")


def unparsed(lines: DataFrame, column: str = "data") -> DataFrame:
    """One row: lines that are neither row changes nor transaction marks, such as TRUNCATE."""
    line = F.trim(F.col(column))
    known = line.rlike(LINE) | line.rlike("^(BEGIN|COMMIT)( |$)")
    return lines.agg(F.count_if(~known).alias("unparsed"))


def column_names(image_column: Column) -> Column:
    return F.map_keys(image_column)


def chosen_image(op: Column, before: Column, after: Column) -> Column:
    """The image that says which row a change is about."""
    return F.when(op == "d", before).otherwise(after)


#: First byte of a binary frame and what it is.
FRAME_KINDS = {"B": "begin", "C": "commit", "R": "relation", "I": "insert", "U": "update", "D": "delete", "T": "truncate", "O": "origin", "Y": "type", "M": "message"}


def frame_kind(frame: Column) -> Column:
    first = F.substring(frame, 1, 1)
    kind = F.concat(F.lit("unknown:"), F.lower(F.hex(first)))
    for k, v in FRAME_KINDS.items():
        kind = F.when(F.hex(first) == F.lit(f"{ord(k):02X}"), F.lit(v)).otherwise(kind)
    return F.when(F.octet_length(frame) == 0, F.lit("empty")).otherwise(kind)
