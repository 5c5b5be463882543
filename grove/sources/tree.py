"""Source trees: scan, ignore rules, languages, hashes, project configuration."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grove.sources.shared import hadoop

#: Languages by file extension, and the files that mark a project of a language (fixed values).
EXTENSIONS = {
    "ts": "typescript", "tsx": "typescript", "cs": "csharp", "py": "python", "rs": "rust", "go": "go", "java": "java", "kt": "kotlin", "rb": "ruby", "php": "php", "lua": "lua",
    "swift": "swift", "sh": "bash", "bash": "bash", "c": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "h": "cpp", "hpp": "cpp", "hxx": "cpp", "proto": "protobuf", "sql": "sql",
}
MARKERS = {
    "typescript": ("tsconfig.json", "package.json"), "csharp": ("*.csproj", "*.sln"), "python": ("pyproject.toml", "setup.py", "requirements.txt"), "rust": ("Cargo.toml",), "go": ("go.mod",),
    "java": ("pom.xml", "build.gradle"), "kotlin": ("build.gradle.kts",), "ruby": ("Gemfile", "*.gemspec"), "php": ("composer.json",), "lua": ("*.rockspec", "*.lua"), "swift": ("Package.swift",),
    "bash": ("*.sh",), "c": ("Makefile", "*.c"), "cpp": ("CMakeLists.txt", "*.cpp"), "protobuf": ("buf.yaml", "*.proto"), "sql": ("*.sql",),
}
DEFAULT_IGNORE = ("node_modules", "dist", "build", ".git", "target", "vendor", "bin", "obj")
CONFIG_DIR, CONFIG_FILE, WORKSPACE_FILE = ".grove", "config.toml", "grove-workspace.toml"


def glob_regex(pattern: str) -> str:
    """A whole-string regex of a glob: * and ? stay within a path component, [...] is a set."""
    out, i = "", 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "*":
            out += "[^/]*"
        elif ch == "?":
            out += "[^/]"
        elif ch == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 1)
            body = pattern[i + 1 : end]
            out += "[" + ("^" + body[1:] if body[:1] in "^!" else body).replace("\\", "\\\\") + "]"
            i = end
        else:
            out += re.escape(ch)
        i += 1
    return out


def ignore_regex(pattern: str) -> str:
    """A regex that finds the paths that one ignore pattern matches, without its "!"."""
    p = pattern.removeprefix("!").rstrip("/")
    if "/" not in p:
        return f"(?:^|/){glob_regex(p)}(?:/|$)"
    if p.startswith("**/"):
        return f"(?:^|/){glob_regex(p[3:])}$"
    return f"^{glob_regex(p)}$"


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether the last pattern that matches a relative path ignores it; "!" patterns take paths back."""
    last = F.coalesce(*(F.when(path.rlike(ignore_regex(p)), F.lit(not p.startswith("!"))) for p in reversed(patterns)), F.lit(False))
    return last if patterns else F.lit(False)


def ignored_path(path: str, patterns: list[str]) -> bool:
    return next((not p.startswith("!") for p in reversed(patterns) if re.search(ignore_regex(p), path)), False)


def in_ignored_component(path: Column, names: list[str]) -> Column:
    """The watcher's rule: some component equals a name."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*(F.lit(n) for n in (*names, CONFIG_DIR))))


def gitignore(text: str) -> list[str]:
    return [line for raw in text.splitlines() if (line := raw.strip()) and not line.startswith("#")]


def read_files(spark: SparkSession, root: str, patterns: list[str] | None = None, languages: list[str] | None = None, nested: list[str] | None = None) -> DataFrame:
    """(file_path, language, content) of the supported files under root, by any path that Spark reads.

    Hidden directories, ignored paths, nested projects and languages that aren't asked for are left out; those filters are on
    the path column and come before contents are read.
    """
    base = root.rstrip("/")
    extensions = [e for e, lang in EXTENSIONS.items() if not languages or lang in languages]
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").load(base)
    inner = re.escape(re.sub(r"^[a-z]+:/*", "/", base)) if "://" in base or base.startswith("file:") else re.escape(base)
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/+", "/"), f"^.*?{inner}/", "")
    rows = raw.select(path.alias("file_path"), "content")
    keep = ~F.col("file_path").rlike(r"(?:^|/)\.[^/]+/")
    if patterns:
        keep &= ~ignored(F.col("file_path"), patterns)
    for n in nested or []:
        keep &= ~F.startswith(F.col("file_path"), F.lit(n.rstrip("/") + "/"))
    table = F.create_map(*(F.lit(x) for kv in EXTENSIONS.items() for x in kv))
    return rows.where(keep).select("file_path", F.try_element_at(table, F.lower(F.substring_index("file_path", ".", -1))).alias("language"), "content")


def hashed(files: DataFrame) -> DataFrame:
    """(file_path, hash): SHA-256 of each content."""
    return files.select("file_path", F.sha2("content", 256).alias("hash"))


#: Directories in which no nested project is looked for.
PASSED_OVER = ("node_modules", "target", "dist", "build")


def project_configs(spark: SparkSession, root: str, depth: int = 3) -> list[str]:
    """Directories below root, up to depth, with a configuration of their own, by the file system's own glob: wherever Spark reads."""
    base, out = root.rstrip("/"), []
    for level in range(1, depth + 1):
        fs, p = hadoop(spark, f"{base}{'/*' * level}/{CONFIG_DIR}/{CONFIG_FILE}")
        for s in fs.globStatus(p) or []:
            out.append("/".join(str(s.getPath().getParent().getParent().toString()).split("/")[-level:]))
    return sorted(d for d in out if not any(x.startswith(".") or x in PASSED_OVER for x in d.split("/")))


def nested_projects(spark: SparkSession, root: str, depth: int = 3) -> list[str]:
    """The outermost of the projects below root: what lies below them is theirs."""
    found = project_configs(spark, root, depth)
    return [d for d in found if not any(d.startswith(f"{o}/") for o in found)]


def owners(paths: DataFrame, projects: DataFrame) -> DataFrame:
    """paths (file_path, …) with project: the nearest of projects (project, a directory) above a path; empty for those of the root.

    A path is joined by all directories above it, on equal keys, and keeps the longest that is a project.
    """
    parts = F.split("file_path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    each = paths.select("file_path").distinct().where(F.contains("file_path", F.lit("/"))).select("file_path", F.explode(above).alias("project"))
    best = each.join(projects.select("project").distinct(), "project").groupBy("file_path").agg(F.max_by("project", F.char_length("project")).alias("project"))
    return paths.join(best, "file_path", "left").withColumn("project", F.coalesce("project", F.lit("")))


def detect_languages(root: str) -> list[str]:
    """Languages whose marker files stand in root."""
    return sorted(lang for lang, marks in MARKERS.items() if any(next(Path(root).glob(m), None) for m in marks))


@dataclass
class ProjectConfig:
    name: str = ""
    languages: list[str] = field(default_factory=list)
    ignore: list[str] = field(default_factory=lambda: list(DEFAULT_IGNORE))
    include_tests: bool = True
    max_refs: int = 20
    max_depth: int = 3


def load_project(text: str) -> ProjectConfig:
    """Defaults overlaid with a TOML text."""
    d = tomllib.loads(text)
    c = ProjectConfig()
    for section, keys in (("project", ("name", "languages")), ("index", ("ignore", "include_tests")), ("output", ("max_refs", "max_depth"))):
        for k in keys:
            if k in d.get(section, {}):
                setattr(c, k, d[section][k])
    return c


@dataclass
class Member:
    path: str
    name: str


def load_workspace(text: str) -> tuple[str, list[Member]]:
    """The workspace's name and members; a version above 1 is refused; a member without a name has its directory's."""
    w = tomllib.loads(text)["workspace"]
    if int(w.get("version", 1)) > 1:
        raise ValueError(f"workspace version {w['version']} is not supported")
    members = [Member(m["path"], m.get("name") or m["path"].rstrip("/").rpartition("/")[2] or "unknown") for m in w.get("members", [])]
    return w.get("name", ""), members


def source_lines(files: DataFrame, spans: DataFrame) -> DataFrame:
    """(file_path, line_start, line_no, line) for each span (file_path, line_start, line_end) of texts (file_path, text)."""
    lines = F.slice(F.split("text", "\n"), F.col("line_start"), F.greatest(F.col("line_end") - F.col("line_start") + 1, F.lit(0)))
    cut = spans.join(files.select("file_path", "text"), "file_path").select("file_path", "line_start", F.posexplode(lines).alias("n", "line"))
    return cut.select("file_path", "line_start", (F.col("line_start") + F.col("n")).alias("line_no"), F.regexp_replace("line", "\r$", "").alias("line"))


def snippets(refs: DataFrame, files: DataFrame, context: int = 0) -> DataFrame:
    """refs (file_path, line, …) with the lines around each, null where the file is missing. One join a file, not one a reference."""
    first = F.greatest(F.col("line") - context, F.lit(1))
    lines = F.slice(F.split("text", "\n"), first, F.col("line") + context - first + 1)
    found = refs.join(files.select("file_path", "text"), "file_path", "left")
    return found.withColumn("snippet", F.when(F.col("text").isNotNull() & (F.col("line") > 0), F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, "\r$", "")), "\n"))).drop("text")
