"""Column functions on names, paths, times and identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The form of a capture's name; camera labels by view, in order; names that no file may have.
CAPTURE = r"^(.+?) - (\d{4}-\d{2}-\d{2}) (\d{6}) (.+?) ([0-9a-fA-F]{4})$"
VIEWS = (("down the line", "dtl"), ("downtheline", "dtl"), ("dtl", "dtl"), ("face on", "face_on"), ("faceon", "face_on"), ("front", "face_on"))
RESERVED = r"(?i)^(?:con|prn|aux|nul|(?:com|lpt)[1-9])(?:\.|$)"
BAD = r"[/\\:*?\"<>|\x00-\x1f\x7f-\x9f]"
RFC3339 = r"^\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])[Tt](?:[01]\d|2[0-3]):[0-5]\d:(?:[0-5]\d|60)(?:\.\d+)?(?:[Zz]|[+-](?:[01]\d|2[0-3]):[0-5]\d)$"


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def view_of(label: Column) -> Column:
    """The view that a camera's label names, by the first needle found in it; null if none is."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for needle, view in VIEWS:
        out = out.when(F.lower(label).contains(needle), view)
    return out


def capture_parts(path: Column) -> Column:
    """What a capture's file name matches, as an array of five: one match for all parts, with slashes between them, for a name has none.  Any other name is an array of one."""
    return F.split(F.regexp_replace(stem(path), CAPTURE, "$1/$2/$3/$4/$5"), "/")


def capture_fields(parts: Column) -> dict[str, Column]:
    """The parts by name; all null if there are not five."""
    part = lambda i: F.when(F.size(parts) == 5, F.get(parts, F.lit(i)))
    return {"golfer": part(0), "date": part(1), "time": part(2), "camera": part(3), "camera_id": F.lower(F.substring(part(4), 1, 4)), "view": view_of(part(3))}


def capture(path: Column) -> dict[str, Column]:
    """The parts of a capture's file name; all null if it is not of the form."""
    return capture_fields(capture_parts(path))


def with_capture(df: DataFrame, path: str = "path") -> DataFrame:
    """df with the parts of its paths' names.  A name is matched once a row: the parts are made within the row by a generator, so that no later filter, join or column repeats the match."""
    def fields(parts: Column) -> Column:
        return F.struct(*[v.alias(k) for k, v in capture_fields(parts).items()])

    return df.select("*", F.inline(F.transform(F.array(capture_parts(F.col(path))), fields)))


def is_identifier(v: Column) -> Column:
    return v.isNotNull() & (v != "") & ~v.rlike(BAD) & ~v.isin(".", "..") & ~v.rlike(r"[. ]$") & ~v.rlike(RESERVED)


def slugify(v: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(v), r"[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", "item").otherwise(s)


def is_relative_path(v: Column) -> Column:
    """A path that means the same on every system: parts separated by single slashes, none of them . or .., no drive, no backslash."""
    parts = F.split(v, "/")
    return v.isNotNull() & (v != "") & ~v.contains("\\") & ~v.rlike(r"^[A-Za-z]:") & ~F.exists(parts, lambda p: p.isin("", ".", ".."))


def is_rfc3339(v: Column) -> Column:
    return F.coalesce(v.rlike(RFC3339), F.lit(False))


def storage_key(path: Column, root: str, name: str) -> Column:
    """A path within a library as name:rest; others as they are."""
    return F.when(path.startswith(root + "/"), F.concat(F.lit(name + ":"), F.substr(path, F.lit(len(root) + 2)))).otherwise(path)


def frame_of(t_ms: Column, fps: Column) -> Column:
    """The frame at a time, halves to even."""
    return F.bround(t_ms * fps / 1000).cast("long")


def time_of(frame: Column, fps: Column) -> Column:
    return frame * 1000 / fps


def contract_view(view: Column) -> Column:
    """A view's name in the contracts; null for one that they do not have."""
    return F.when(view == "dtl", "down_the_line").when(view == "face_on", "face_on")
