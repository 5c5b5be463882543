"""Column functions over ids, names and paths. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from grove.schema import METADATA

MODULE = "__module__"


def tail(c: Column, sep: str) -> Column:
    """What follows the last sep, or null without one."""
    return F.when(F.contains(c, F.lit(sep)), F.substring_index(c, sep, -1))


def match_keys(to_id: Column, qualified: bool = True) -> Column:
    """All names that an edge's target answers to: itself, and what follows any of its dots and, if qualified, any "::"."""
    after = r"(?<=[.]|::)(?=(.+))" if qualified else r"(?<=[.])(?=(.+))"
    return F.array_distinct(F.concat(F.array(to_id), F.regexp_extract_all(to_id, F.lit(after), F.lit(1))))


def target_matches(to_id: Column, name: Column, qualified: bool = True) -> Column:
    """The same as a predicate, for names that hold a separator themselves. Suffixes are literal."""
    found = (to_id == name) | F.endswith(to_id, F.concat(F.lit("."), name))
    return found | F.endswith(to_id, F.concat(F.lit("::"), name)) if qualified else found


def name_from_id(i: Column) -> Column:
    """The second "::" part of an id, or the id."""
    parts = F.split(i, "::")
    return F.when(F.size(parts) >= 2, F.get(parts, F.lit(1))).otherwise(i)


def second_last_part(i: Column) -> Column:
    """The second-to-last "::" part, which on four-part ids is the kind; empty with fewer parts."""
    return F.coalesce(F.try_element_at(F.split(i, "::"), F.lit(-2)), F.lit(""))


def display_name(i: Column, name: Column, parent_name: Column) -> Column:
    """Parent.name, name, the file's stem for a module's own edges, or the id's name part."""
    path = F.get(F.split(i, "::"), F.lit(0))
    stem = F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)
    module = F.when(F.contains(i, F.lit(MODULE)) & F.contains(path, F.lit("/")), stem)
    return F.coalesce(F.when(name.isNotNull(), F.concat_ws(".", parent_name, name)), module, name_from_id(i))


def module_function(file_path: Column) -> Column:
    return F.concat(file_path, F.lit(f"::{MODULE}::function"))


def module_class(file_path: Column) -> Column:
    return F.concat(file_path, F.lit(f"::{MODULE}::class"))


def is_test_file(path: Column) -> Column:
    return F.lower(path).rlike(r"/tests?/|[._]test\.|[._]spec\.|^tests?/")


def entry_group(path: Column) -> Column:
    p = F.lower(path)
    return (
        F.when(F.contains(p, F.lit("controller")), "API Controllers")
        .when(F.contains(p, F.lit("worker")) | F.contains(p, F.lit("job")), "Background Workers")
        .when(F.contains(p, F.lit("handler")) | F.contains(p, F.lit("listener")), "Event Handlers")
        .otherwise("Other")
    )


def top_directory(path: Column) -> Column:
    """The first directory, without a leading src/, and with a slash; files of the root are in (root)/."""
    inner = F.regexp_replace(path, "^src/", "")
    return F.concat(F.when(F.contains(inner, F.lit("/")), F.substring_index(inner, "/", 1)).otherwise("(root)"), F.lit("/"))


def split_camel(c: Column) -> Column:
    return F.regexp_replace(c, r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})", " ")


def split_snake(c: Column) -> Column:
    return F.translate(c, "_", " ")


def normalized_path(c: Column) -> Column:
    return F.replace(c, F.lit("\\"), F.lit("/"))


def line_range(start: Column, end: Column) -> Column:
    return F.concat(start.cast("string"), F.lit("-"), end.cast("string"))


def shortened(c: Column, most: int) -> Column:
    """The first most characters, the last three of them dots where some were cut."""
    return F.when(F.char_length(c) > most, F.concat(F.substring(c, 1, max(0, most - 3)), F.lit("..."))).otherwise(c)


def grouped_number(c: Column) -> Column:
    return F.format_number(c, 0)


def relative_time(seconds: Column, now: Column) -> Column:
    age = now - seconds
    some = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))
    return (
        F.when(seconds.isNull(), "never").when(age < 60, "just now").when(age < 3600, some(F.floor(age / 60), "minute"))
        .when(age < 86400, some(F.floor(age / 3600), "hour")).when(age < 172800, "yesterday").otherwise(some(F.floor(age / 86400), "day"))
    )


def workspace_id(project: Column, i: Column) -> Column:
    return F.concat_ws("::", project, i)


def member_name(name: Column, path: Column) -> Column:
    base = F.nullif(F.regexp_extract(F.regexp_replace(path, "/+$", ""), "([^/]+)$", 1), F.lit(""))
    return F.coalesce(F.nullif(name, F.lit("")), base, F.lit("unknown"))


def tier(importance: Column) -> Column:
    return F.when(importance > 0.7, "high importance core").when(importance > 0.3, "medium importance")


def similar_importance(callers: Column) -> Column:
    return F.when(callers > 10, 0.8).when(callers > 3, 0.5).when(callers > 0, 0.2).otherwise(0.0)


def task_category(task_id: Column) -> Column:
    return F.concat_ws("-", F.slice(F.split(task_id, "-"), 1, 2))


def subcommand(command: Column, tool: str) -> Column:
    """The first word after the tool's name that is no flag; null without one."""
    return F.nullif(F.regexp_extract(command, rf"(?:^|[\s/;&|])\Q{tool}\E(?:\s+-\S+)*\s+([A-Za-z][\w-]*)", 1), F.lit(""))


def caller_location(c: Column) -> Column:
    """struct<file, line> of "file:line", split at the last colon."""
    return F.struct(F.regexp_extract(c, r"^(.*):(\d+)$", 1).alias("file"), F.regexp_extract(c, r"^(.*):(\d+)$", 2).try_cast("int").alias("line"))


def language(path: Column) -> Column:
    from grove.sources.tree import EXTENSIONS

    table = F.create_map(*(F.lit(x) for kv in EXTENSIONS.items() for x in kv))
    return F.try_element_at(table, F.lower(F.substring_index(path, ".", -1)))


def edge_label(kind: Column) -> Column:
    names = {"calls": "calls", "imports": "imports", "extends": "extends", "implements": "implements", "instantiates": "creates", "references": "references", "references_type": "uses type", "includes": "includes"}
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), kind), kind)


def modifiers(metadata: Column) -> Column:
    """Access and true flags of a metadata string, in snake or camel case, as a list of words."""
    snake = F.regexp_replace(metadata, r"([a-z])([A-Z])(?=[A-Za-z]*\"\s*:)", "$1_$2")
    m = F.from_json(F.lower(snake), METADATA)
    flags = [F.when(m[f], F.lit(f[3:])) for f in ("is_static", "is_abstract", "is_async", "is_readonly", "is_virtual", "is_override", "is_sealed", "is_final")]
    return F.array_compact(F.array(F.coalesce(m["access"], m["visibility"]), *flags))


def method_line(signature: Column, name: Column, metadata: Column) -> Column:
    """The signature with those modifiers in front that it doesn't hold."""
    line = F.coalesce(signature, name)
    return F.concat_ws(" ", F.filter(modifiers(metadata), lambda w: ~F.contains(line, w)), line)
