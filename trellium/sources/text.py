"""What texts say: annotations, licences, commit messages, labels by rule, manifests, markdown."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import path_glob_regex

#: The annotations of comments, and the header and trailers of a conventional commit.
ANNOTATION = r"(?i)^\s*(?://|#|--|;)\s*\*?\s*(TODO|FIXME|HACK|XXX|NOTE)\b[:.]?\s*(.*)"
HEADER = r"^(\w+)(?:\(([^)]+)\))?(!)?: (.+)$"
TRAILER = r"^([A-Za-z][\w-]*|BREAKING CHANGE): (.+)$"
#: Licences in order (fixed values); the first fits whose texts are all in the head of a file, and none of the others.
LICENCES = [
    ("MIT", ["permission is hereby granted, free of charge"], []),
    ("Apache-2.0", ["apache license, version 2.0"], []),
    ("GPL-3.0-only", ["gnu general public license", "version 3"], []),
    ("GPL-2.0-only", ["gnu general public license", "version 2"], []),
    ("LGPL-2.1-only", ["gnu lesser general public license", "version 2.1"], []),
    ("BSD-3-Clause", ["redistribution and use in source and binary forms", "neither the name"], []),
    ("BSD-2-Clause", ["redistribution and use in source and binary forms"], ["neither the name"]),
    ("ISC", ["permission to use, copy, modify, and/or distribute"], []),
    ("MPL-2.0", ["mozilla public license, version 2.0"], []),
]
#: Names of files that hold a licence, as regular expression.
LICENCE_FILE = r"^(LICENSE.*|LICENCE.*|COPYING)$"


def annotations(files: DataFrame, most: int = 2 << 20) -> DataFrame:
    """path, line, kind, text, name, before: comments that begin with TODO and the like, with the line before.

    Files (path, text) above `most` bytes or with a NUL in the first 512 characters are left out.
    """
    plain = files.where((F.octet_length("text") <= most) & (F.instr(F.substring("text", 1, 512), "\0") == 0))
    lines = F.transform(F.split("text", "\n"), lambda x: x)
    rows = plain.select("path", lines.alias("_lines")).select("path", "_lines", F.posexplode_outer(F.col("_lines")).alias("_at", "_line"))
    hit = rows.where(F.regexp_like("_line", F.lit(ANNOTATION)))
    text = F.trim(F.regexp_extract("_line", ANNOTATION, 2))
    return hit.select(
        "path",
        (F.col("_at") + 1).alias("line"),
        F.upper(F.regexp_extract("_line", ANNOTATION, 1)).alias("kind"),
        text.alias("text"),
        F.when(F.length(text) > 80, F.concat(F.left(text, F.lit(77)), F.lit("..."))).otherwise(text).alias("name"),
        F.when(F.col("_at") > 0, F.trim(F.get("_lines", F.col("_at") - 1))).alias("before"),
    )


def licence(text: str | Column) -> Column:
    """The licence that the first 1024 bytes of a text speak of, or unknown."""
    whole = F.col(text) if isinstance(text, str) else text
    head = F.lower(F.substring(whole.cast("binary"), 1, 1024).cast("string"))
    out = None
    for name, needed, barred in LICENCES:
        test = F.lit(True)
        for x in needed:
            test &= F.contains(head, F.lit(x))
        for x in barred:
            test &= ~F.contains(head, F.lit(x))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("unknown")


def commits(messages: DataFrame, text: str = "message") -> DataFrame:
    """messages with type, scope, breaking, subject, body, footers and refs of a conventional commit.

    A header that does not fit is the subject, of type "". Footers are the last block if all its lines are trailers.
    """
    clean = F.regexp_replace(F.trim(F.col(text)), "\r", "")
    blocks = F.split(clean, r"\n\s*\n")
    head = F.trim(F.get(F.split(clean, "\n"), F.lit(0)))
    fits = F.regexp_like(head, F.lit(HEADER))
    last = F.split(F.element_at("_blocks", -1), "\n")
    footed = (F.size("_blocks") > 1) & F.forall(last, lambda x: F.regexp_like(x, F.lit(TRAILER)))
    rows = messages.withColumns({"_blocks": blocks, "_head": head, "_fits": fits}).withColumn("_foot", F.when(footed, last).otherwise(F.array().cast("array<string>")))
    keys = F.transform("_foot", lambda x: F.regexp_extract(x, TRAILER, 1))
    rows = rows.withColumn("_keys", F.array_distinct(keys))
    value = lambda x: F.regexp_extract(x, TRAILER, 2)
    footers = F.map_from_arrays("_keys", F.transform("_keys", lambda k: F.transform(F.filter("_foot", lambda x: F.regexp_extract(x, TRAILER, 1) == k), value)))
    linked = F.flatten(F.transform(F.filter("_foot", lambda x: F.lower(F.regexp_extract(x, TRAILER, 1)).isin("refs", "ref", "closes", "fixes", "resolves")), lambda x: F.split(value(x), r"[,\s]+")))
    count = F.size("_blocks") - F.when(F.size("_foot") > 0, 1).otherwise(0)
    body = F.trim(F.array_join(F.filter("_blocks", lambda _, i: (i > 0) & (i < count)), "\n\n"))
    breaking = (F.regexp_extract("_head", HEADER, 3) == "!") | F.arrays_overlap("_keys", F.array(F.lit("BREAKING CHANGE"), F.lit("BREAKING-CHANGE")))
    return rows.select(
        *messages.columns,
        F.when(F.col("_fits"), F.regexp_extract("_head", HEADER, 1)).otherwise("").alias("type"),
        F.when(F.col("_fits"), F.regexp_extract("_head", HEADER, 2)).otherwise("").alias("scope"),
        F.coalesce(breaking, F.lit(False)).alias("breaking"),
        F.when(F.col("_fits"), F.regexp_extract("_head", HEADER, 4)).otherwise(F.col("_head")).alias("subject"),
        body.alias("body"),
        footers.alias("footers"),
        F.array_distinct(F.filter(linked, lambda x: x != "")).alias("refs"),
    )


@dataclass(frozen=True)
class Rule:
    """Labels for nodes of a type ("" for any) whose name and path fit the globs (None for any)."""

    labels: tuple[str, ...]
    type: str = "fs:file"
    name: str | None = None
    path: str | None = None


def _rules(label: str, names: str = "", paths: str = "") -> list[Rule]:
    """A rule for each name and each path, of labels parted by commas."""
    labels = tuple(label.split(","))
    return [Rule(labels, name=x) for x in names.split()] + [Rule(labels, path=x) for x in paths.split()]


#: Labels of files by name, then by path below the root (fixed values).
RULES = [
    *_rules("agent:instructions", "AGENTS.md CLAUDE.md CURSOR.md .cursorrules .clauderules COPILOT.md .github/copilot-instructions.md"),
    *_rules("ci:config,ci:gitlab", ".gitlab-ci.yml .gitlab-ci.yaml"),
    *_rules("ci:config,ci:jenkins", "Jenkinsfile"),
    *_rules("ci:config,ci:github", paths=".github/workflows/*.yml .github/workflows/*.yaml"),
    *_rules("ci:config,ci:circleci", paths=".circleci/config.yml"),
    *_rules("container:dockerfile", "Dockerfile Dockerfile.* *.Dockerfile"),
    *_rules("container:compose", "docker-compose.yml docker-compose.yaml compose.yml compose.yaml"),
    *_rules("k8s:helm", "Chart.yaml values.yaml values.yml", "templates/*.yaml templates/*.yml"),
    *_rules("k8s:manifest", paths="**/k8s/**/*.yaml **/k8s/**/*.yml **/kubernetes/**/*.yaml **/kubernetes/**/*.yml"),
    *_rules("build:config,lang:go", "go.mod"),
    *_rules("build:lockfile,lang:go", "go.sum"),
    *_rules("build:config,lang:javascript", "package.json"),
    *_rules("build:lockfile,lang:javascript", "package-lock.json yarn.lock pnpm-lock.yaml bun.lockb"),
    *_rules("build:config,lang:rust", "Cargo.toml"),
    *_rules("build:lockfile,lang:rust", "Cargo.lock"),
    *_rules("build:config,lang:python", "pyproject.toml setup.py setup.cfg"),
    *_rules("build:lockfile,lang:python", "requirements.txt requirements*.txt"),
    *_rules("build:config,lang:python", "Pipfile"),
    *_rules("build:lockfile,lang:python", "Pipfile.lock poetry.lock"),
    *_rules("build:config,lang:ruby", "Gemfile"),
    *_rules("build:lockfile,lang:ruby", "Gemfile.lock"),
    *_rules("build:config,lang:java", "pom.xml build.gradle"),
    *_rules("build:config,lang:kotlin", "build.gradle.kts"),
    *_rules("build:config,lang:java", "settings.gradle"),
    *_rules("build:config,lang:kotlin", "settings.gradle.kts"),
    *_rules("build:makefile", "Makefile GNUmakefile"),
    *_rules("build:justfile", "justfile Justfile"),
    *_rules("build:taskfile", "Taskfile.yml Taskfile.yaml"),
    *_rules("docs:readme", "README* readme*"),
    *_rules("docs:changelog", "CHANGELOG* changelog* HISTORY*"),
    *_rules("docs:license", "LICENSE* license* COPYING*"),
    *_rules("docs:contributing", "CONTRIBUTING*"),
    *_rules("docs:code-of-conduct", "CODE_OF_CONDUCT*"),
    *_rules("docs:security", "SECURITY*"),
    *_rules("editor:config", ".editorconfig"),
    *_rules("editor:formatter", ".prettierrc* prettier.config.*"),
    *_rules("editor:linter", ".eslintrc* eslint.config.*"),
    *_rules("lang:typescript", "tsconfig.json tsconfig.*.json"),
    *_rules("lang:javascript", "jsconfig.json"),
    *_rules("git:config", ".gitignore .gitattributes .gitmodules"),
    *_rules("test:file", "*_test.go *.test.js *.spec.js *.test.ts *.spec.ts *.test.tsx *.spec.tsx test_*.py *_test.py"),
    *_rules("test:file", paths="**/tests/*.rs"),
    *_rules("test:file", "*_spec.rb *_test.rb"),
]


def tagged(nodes: DataFrame, path: Column, rules: Sequence[Rule] = RULES) -> DataFrame:
    """nodes with the labels of all rules that fit added, in the order of the rules, each label once.

    The rules are one expression over a row, so nothing is joined or shuffled.
    """
    parts = []
    for rule in rules:
        test = F.lit(True)
        if rule.type:
            test &= F.col("type") == rule.type
        if rule.name:
            test &= F.col("name").rlike(path_glob_regex(rule.name))
        if rule.path:
            test &= path.rlike(path_glob_regex(rule.path))
        parts.append(F.when(test, F.array(*[F.lit(x) for x in rule.labels])).otherwise(F.array().cast("array<string>")))
    return nodes.withColumn("labels", F.array_distinct(F.concat(F.coalesce("labels", F.array().cast("array<string>")), *parts)))


#: Manifest names and the language they speak of (fixed values); project:<language> labels their folder.
MANIFESTS = {"go.mod": "go", "package.json": "node", "Cargo.toml": "rust", "pyproject.toml": "python", "setup.py": "python", "pom.xml": "java", "build.gradle": "java", "composer.json": "php", "Gemfile": "ruby"}


def manifest(name: str, text: str) -> dict:
    """language, name, version and dep_count of a manifest; setup.py, pom.xml, build.gradle and Gemfile give the language alone.

    What can't be read is left empty.
    """
    out = {"language": MANIFESTS.get(name, ""), "name": "", "version": "", "dep_count": 0}
    first = lambda pattern: (re.search(pattern, text, re.M) or [None, ""])[1]
    try:
        if name.endswith(".json"):
            data = json.loads(text)
            deps = [data.get(k) or {} for k in ("dependencies", "devDependencies", "require", "require-dev")]
            out |= {"name": data.get("name") or "", "version": data.get("version") or "", "dep_count": sum(map(len, deps))}
        elif name.endswith(".toml"):
            data = tomllib.loads(text)
            own = data.get("package") or data.get("project") or data.get("tool", {}).get("poetry") or {}
            deps = own.get("dependencies") or data.get("dependencies") or []
            out |= {"name": own.get("name") or "", "version": own.get("version") or "", "dep_count": len(deps)}
        elif name == "go.mod":
            block = "".join(re.findall(r"^require \(([^)]*)\)", text, re.M))
            deps = [x for x in block.splitlines() if x.strip() and not x.strip().startswith("//")]
            out |= {"name": first(r"^module (\S+)"), "version": first(r"^go (\S+)"), "dep_count": len(deps) + len(re.findall(r"^require [^(\s]", text, re.M))}
    except (ValueError, AttributeError, TypeError):
        pass
    return out


def manifests(files: DataFrame) -> DataFrame:
    """path, language, name, version, dep_count of the manifests among files (path, text)."""
    rows = files.withColumn("_name", F.element_at(F.split("path", "/"), -1)).where(F.col("_name").isin(list(MANIFESTS)))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            got = [manifest(n, t or "") for n, t in zip(df["_name"], df["text"])]
            yield pd.DataFrame({"path": df["path"], **{k: [g[k] for g in got] for k in ("language", "name", "version", "dep_count")}})

    return rows.select("path", "_name", "text").mapInPandas(read, "path string, language string, name string, version string, dep_count long")


def project_graph(files: DataFrame, generation: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes and edges of the projects and licences among files (path, text), and labels (id, labels) of their folders.

    A folder with a manifest is a project:root, located_at the folder; of several manifests the first name counts. Its
    name is that of the manifest, else the folder's. A licence file is a project:license of the project in its folder, else of the folder.
    """
    from ..functions.scalars import short_id
    from ..model import both_ways, make_edges, make_nodes

    folder = F.regexp_replace("path", "/[^/]*$", "")
    base = F.element_at(F.split(folder, "/"), -1)
    rows = manifests(files).select(folder.alias("dir"), base.alias("base"), "path", "language", "name", "version", "dep_count")
    fact = F.struct("name", "version", "language", "dep_count")
    each = rows.groupBy("dir", "base").agg(F.min_by(fact, "path").alias("m"), F.array_sort(F.collect_set(F.concat(F.lit("project:"), "language"))).alias("labels"))
    here = F.concat(F.lit("project+file://"), "dir")
    roots = each.select(F.lit("project:root").alias("type"), here.alias("uri"), F.col("dir").alias("key"), F.coalesce(F.nullif("m.name", F.lit("")), "base").alias("name"), F.to_variant_object("m").alias("data"), F.lit(generation).alias("generation"))
    found = files.where(F.element_at(F.split("path", "/"), -1).rlike(LICENCE_FILE)).select("path", folder.alias("dir"), licence("text").alias("spdx"))
    fact = F.struct(F.when(F.col("spdx") == "unknown", "").otherwise(F.col("spdx")).alias("spdx_id"), F.when(F.col("spdx") == "unknown", "unknown").otherwise("high").alias("confidence"), F.col("path").alias("file"))
    texts = found.select(F.lit("project:license").alias("type"), F.concat(F.lit("license+file://"), "path").alias("uri"), F.col("path").alias("key"), F.col("spdx").alias("name"), F.to_variant_object(fact).alias("data"), F.lit(generation).alias("generation"))
    place = each.select(F.lit("located_at").alias("type"), short_id(here).alias("from_id"), short_id(F.concat(F.lit("file://"), "dir")).alias("to_id"), F.lit(generation).alias("generation"))
    of = found.join(each.select(F.col("dir").alias("_dir")), F.col("dir") == F.col("_dir"), "left")
    holder = F.concat(F.when(F.col("_dir").isNull(), "file://").otherwise("project+file://"), "dir")
    owner = of.select(F.lit("has").alias("type"), short_id(holder).alias("from_id"), short_id(F.concat(F.lit("license+file://"), "path")).alias("to_id"), F.lit(generation).alias("generation"))
    labels = each.select(short_id(F.concat(F.lit("file://"), "dir")).alias("id"), "labels")
    return make_nodes(roots).unionByName(make_nodes(texts)), make_edges(place).unionByName(both_ways(make_edges(owner), "belongs_to")), labels


def with_labels(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """nodes with the labels of (id, labels) added, each once."""
    more = labels.select(F.col("id").alias("_id"), F.col("labels").alias("_more"))
    own = F.array_distinct(F.concat(F.coalesce("labels", F.array().cast("array<string>")), F.coalesce("_more", F.array().cast("array<string>"))))
    return nodes.join(more, F.col("id") == F.col("_id"), "left").withColumn("labels", own).select(*nodes.columns)


def clean_path(path: str | Column) -> Column:
    """An absolute path without empty parts, `.` and `..`; what leads above the root stays at the root."""
    parts = F.split(F.col(path) if isinstance(path, str) else path, "/")
    step = lambda kept, x: F.when(x.isin("", "."), kept).when(x == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.array_append(kept, x))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"))


def _slug(text: str) -> str:
    return re.sub(r"[\s-]+", "-", re.sub(r"[^a-z0-9\s-]", "", text.lower())).strip("-")


def markdown_parts(text: str) -> list[dict]:
    """The sections, code blocks, links and images of a markdown text, in order; parent is a part's place in the list."""
    parts: list[dict] = [{"kind": "document", "name": "", "path": "", "level": 0, "line": 1, "end": 0, "parent": -1, "target": "", "content": ""}]
    stack, lines, i = [0], text.split("\n"), 0
    while i < len(lines):
        line = lines[i]
        fence = re.match(r"^\s*(```+|~~~+)\s*(\S*)", line)
        head = re.match(r"^(#{1,6})\s+(.*?)\s*#*\s*$", line)
        if fence:
            stop = next((k for k in range(i + 1, len(lines)) if lines[k].strip().startswith(fence[1])), len(lines))
            parts.append({"kind": "codeblock", "name": fence[2], "path": parts[stack[-1]]["path"], "level": 0, "line": i + 1, "end": stop + 1, "parent": stack[-1], "target": "", "content": "\n".join(lines[i + 1 : stop])})
            i = stop + 1
            continue
        if head:
            level = len(head[1])
            while len(stack) > 1 and parts[stack[-1]]["level"] >= level:
                stack.pop()
            above = parts[stack[-1]]["path"]
            own = f"h{level}-{_slug(head[2])}"
            parts.append({"kind": "section", "name": head[2], "path": f"{above}/{own}" if above else own, "level": level, "line": i + 1, "end": i + 1, "parent": stack[-1], "target": "", "content": ""})
            stack.append(len(parts) - 1)
            if level == 1 and not parts[0]["name"]:
                parts[0]["name"] = head[2]
        else:
            if len(stack) > 1 and line.strip():
                own = parts[stack[-1]]
                own["content"] += ("\n" if own["content"] else "") + line
                own["end"] = i + 1
            for bang, label, target in re.findall(r"(!?)\[([^\]]*)\]\(([^)\s]+)[^)]*\)", line):
                parts.append({"kind": "image" if bang else "link", "name": label, "path": "", "level": 0, "line": i + 1, "end": i + 1, "parent": stack[-1], "target": target, "content": ""})
        i += 1
    parts[0]["end"] = len(lines)
    return parts


def markdown(files: DataFrame) -> DataFrame:
    """path, place, kind, name, section, level, line, end, parent, target, content of every part of files (path, text)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = [(p, i, x["kind"], x["name"], x["path"], x["level"], x["line"], x["end"], x["parent"], x["target"], x["content"]) for p, t in zip(df["path"], df["text"]) for i, x in enumerate(markdown_parts(t or ""))]
            yield pd.DataFrame(rows, columns=["path", "place", "kind", "name", "section", "level", "line", "end", "parent", "target", "content"])

    return files.select("path", "text").mapInPandas(read, "path string, place int, kind string, name string, section string, level int, line int, end int, parent int, target string, content string")


def markdown_graph(parts: DataFrame, generation: str) -> tuple[DataFrame, DataFrame]:
    """nodes and edges of markdown parts; relative links become links_to edges to the file they name, by its id alone.

    What a link names is cleaned of `.` and `..` first, so that it has the id of a file that is there.
    """
    from ..functions.scalars import content_hash, short_id
    from ..model import both_ways, make_edges, make_nodes

    uri = F.concat(F.lit("file+md://"), "path", F.when(F.col("kind") == "document", "").otherwise(F.concat(F.lit("#"), "kind", F.lit(":"), "place")))
    position = F.struct(F.col("line"), F.col("end").alias("end_line"))
    data = F.to_variant_object(F.struct(F.col("section").alias("path"), "level", "target", "content", content_hash("content").alias("hash"), position.alias("position")))
    rows = parts.where("NOT (kind = 'link' AND NOT target RLIKE '^[a-z]+:')").withColumns({"uri": uri, "data": data})
    nodes = make_nodes(rows.select(F.concat(F.lit("md:"), "kind").alias("type"), "uri", "name", "data", F.lit(generation).alias("generation")))
    up = rows.select("path", F.col("place").alias("parent"), short_id("uri").alias("from_id"))
    has = rows.where("parent >= 0").join(up, ["path", "parent"]).select(F.lit("has").alias("type"), "from_id", short_id("uri").alias("to_id"), F.lit(generation).alias("generation"))
    local = parts.where("kind = 'link' AND NOT target RLIKE '^([a-z]+:|#)'")
    folder = F.regexp_replace("path", "[^/]*$", "")
    goal = clean_path(F.concat(folder, F.regexp_replace("target", "#.*$", "")))
    links = local.select(F.lit("links_to").alias("type"), short_id(F.concat(F.lit("file+md://"), "path")).alias("from_id"), short_id(F.concat(F.lit("file://"), goal)).alias("to_id"), F.lit(generation).alias("generation"))
    return nodes, both_ways(make_edges(has), "belongs_to").unionByName(make_edges(links.distinct()))


#: Ranges that one task merges, about.
RANGES = 400_000


def merged_ranges(ranges: DataFrame, gap: int = 3) -> DataFrame:
    """file, start, stop, score, reasons of ranges (file, start, stop, score, reason), those within gap lines merged.

    Gaps and islands: a range begins a new island when it starts beyond the furthest stop before it. Ranges are counted
    first, and files dealt out so that a task gets about RANGES of them; those of one file stay together.
    """
    tasks = max(ranges.sparkSession.sparkContext.defaultParallelism, -(-ranges.count() // RANGES))
    ranges = ranges.repartition(tasks, "file")
    order = Window.partitionBy("file").orderBy("start", "stop")
    furthest = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.withColumn("_new", F.coalesce((F.col("start") > furthest + gap).cast("int"), F.lit(1)))
    marked = marked.withColumn("_island", F.sum("_new").over(order))
    return marked.groupBy("file", "_island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.max("score").alias("score"), F.slice(F.array_sort(F.collect_set("reason")), 1, 3).alias("reasons")).drop("_island")
