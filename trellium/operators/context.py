"""What to read for a task: relevant nodes in rings, their source ranges, and a budget of tokens."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import field as json_field
from ..sources.text import merged_ranges

#: Verbs of each intent, and words that are no names (fixed values).
INTENTS = {
    "modify": "add change update modify refactor improve enhance extend edit adjust optimize".split(),
    "fix": "fix debug resolve repair correct patch troubleshoot".split(),
    "understand": "explain understand describe analyze review examine investigate explore study".split(),
    "add": "implement create write build new introduce develop".split(),
    "remove": "remove delete drop eliminate deprecate".split(),
}
STOP = set(
    """a an the is are was were be been being have has had do does did will would could should may might must can to of in for
    on with at by from as into through and or but if then else when where why how what which who whom whose that this these
    those it its i me my we us our you your he she they them their all any both each few more most other some such no not only
    same so than too very just also now here there""".split()
)
DEFINED, MEMBERS, SCORE_DEFINED, SCORE_MEMBER, SCORE_IMPLEMENTS, SCORE_REF, SCORE_SIBLING = 10, ("has", "defines"), 100, 80, 75, 60, 40
REFS, SIBLINGS, RESERVE = 100, 50, 200


@dataclass(frozen=True)
class Task:
    description: str
    symbols: tuple[str, ...] = ()
    keywords: tuple[str, ...] = ()
    intent: str = "general"


def parse_task(description: str) -> Task:
    """Names in back quotes, dotted, Pascal or camel case; other words; and the intent of the first verb."""
    quoted = re.findall(r"`([^`]+)`", description)
    names = re.findall(r"\b[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+\b|\b[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]*)*\b|\b[a-z]+(?:[A-Z][a-z0-9]*)+\b|\b[A-Z][A-Za-z0-9]*[A-Z][A-Za-z0-9]*\b", description)
    words = re.findall(r"[A-Za-z]+", description)
    verbs = {v: k for k, own in INTENTS.items() for v in own}
    intent = next((verbs[w.lower()] for w in words if w.lower() in verbs), "general")
    symbols = []
    for name in quoted + names:
        if name.lower() in verbs or name.lower() in STOP:
            continue
        for one in {name: 0, name.rsplit(".", 1)[-1]: 0}:
            if one not in symbols:
                symbols.append(one)
    keywords = list(dict.fromkeys(w.lower() for w in words if len(w) > 2 and w.lower() not in STOP and w.lower() not in verbs))
    return Task(description, tuple(symbols), tuple(keywords), intent)


def ring_walk(nodes: DataFrame, edges: DataFrame, task: Task) -> DataFrame:
    """id, ring, score, reason: the nodes around a task's symbols, each in its first ring, best first.

    Ring 0 defines a symbol; 1 are its members, and structs with all methods of its interfaces; 2 refers to it, with
    more for several references in a file and for calls; 3 are other exported nodes of its package. Those of the
    smallest ids are kept: DEFINED for each symbol, REFS for each definition, SIBLINGS for each package.
    """
    first_of = lambda df, key, most: df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("id"))).where(F.col("_n") <= most).drop("_n")
    symbols = list(task.symbols) or [""]
    of = F.col("type")
    found = nodes.where(of.startswith("go:") & (of != "go:ref") & F.col("name").isin(symbols))
    found = first_of(found, "name", DEFINED)
    zero = found.select("id", F.lit(0).alias("ring"), F.lit(float(SCORE_DEFINED)).alias("score"), F.lit("definition").alias("reason"))
    below = edges.where(F.col("type").isin(*MEMBERS)).select("from_id", "to_id")
    members = below.join(found.select(F.col("id").alias("from_id")), "from_id", "left_semi").select(F.col("to_id").alias("id")).distinct()
    one = nodes.join(members, "id", "left_semi").select("id", F.lit(1).alias("ring"), F.lit(float(SCORE_MEMBER)).alias("score"), F.lit("member").alias("reason"))
    methods = nodes.where(of == "go:method").select(F.col("id").alias("to_id"), F.col("name").alias("method"))
    owned = below.join(methods, "to_id").select("from_id", "method").distinct()
    faces = owned.join(found.where(of == "go:interface").select(F.col("id").alias("from_id")), "from_id").select(F.col("from_id").alias("interface"), "method")
    need = faces.groupBy("interface").agg(F.count("*").alias("need"))
    structs = owned.join(nodes.where(of == "go:struct").select(F.col("id").alias("from_id")), "from_id").withColumnRenamed("from_id", "struct")
    fits = structs.join(faces, "method").groupBy("struct", "interface").agg(F.count("*").alias("have")).join(need, "interface").where("have = need").select(F.col("struct").alias("id")).distinct()
    impl = fits.select("id", F.lit(1).alias("ring"), F.lit(float(SCORE_IMPLEMENTS)).alias("score"), F.lit("implements").alias("reason"))
    file, kind = json_field("data", "position.file"), json_field("data", "kind")
    refs = first_of(nodes.where((of == "go:ref") & F.col("name").isin(symbols)).withColumns({"_file": file, "_kind": kind}), "name", REFS)
    turn = F.array_position(F.array(*[F.lit(x) for x in symbols]), F.col("name"))
    refs = refs.join(found.groupBy("name").agg(F.count("*").alias("_defs")), "name").withColumn("_turn", turn)
    # As symbols are taken in turn, a file's count has the references of those before, once for each definition.
    before = Window.partitionBy("_file").orderBy("_turn").rangeBetween(Window.unboundedPreceding, -1)
    n = F.when(F.coalesce("_file", F.lit("")) != "", F.coalesce(F.sum("_defs").over(before), F.lit(0)) + F.count("*").over(Window.partitionBy("_file", "_turn"))).otherwise(0)
    score = F.lit(float(SCORE_REF)) + F.when(n > 1, F.least(n, F.lit(10)) * 2).otherwise(0) + F.when(F.col("_kind") == "call", 5).otherwise(0)
    score += F.when(F.col("_file").rlike("_test\\.go$"), 20 if task.intent == "fix" else 5).otherwise(0)
    two = refs.select("id", F.lit(2).alias("ring"), score.cast("double").alias("score"), F.lit("reference").alias("reason"))
    package = F.regexp_replace("uri", r"[#?].*$", "")
    homes = found.select(package.alias("_package")).distinct()
    near = nodes.where(of.startswith("go:") & ~of.isin("go:ref", "go:package", "go:module") & F.col("name").rlike("^[A-Z]")).withColumn("_package", package)
    hit = F.lit(False)
    for w in task.keywords:
        hit |= F.contains(F.lower("name"), F.lit(w))
    three = first_of(near.join(homes, "_package", "left_semi"), "_package", SIBLINGS).select("id", F.lit(3).alias("ring"), (F.lit(float(SCORE_SIBLING)) + F.when(hit, 10).otherwise(0)).alias("score"), F.lit("sibling").alias("reason"))
    every = zero.unionByName(one).unionByName(impl).unionByName(two).unionByName(three)
    first = Window.partitionBy("id").orderBy("ring", F.desc("score"))
    return every.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n").orderBy(F.desc("score"), "id")


def source_ranges(items: DataFrame, nodes: DataFrame, lines_around: int = 2, gap: int = 3) -> DataFrame:
    """file, start, stop, score, reasons of the items' places, with lines before, near ones merged."""
    placed = items.join(nodes.select("id", json_field("data", "position.file").alias("file"), json_field("data", "position.line", "int").alias("line"), json_field("data", "position.end_line", "int").alias("end")), "id").where("file IS NOT NULL")
    spans = placed.select("file", F.greatest(F.lit(1), F.col("line") - lines_around).alias("start"), F.coalesce("end", "line").alias("stop"), "score", "reason")
    return merged_ranges(spans, gap)


@dataclass
class Block:
    file: str
    start: int
    stop: int
    content: str
    score: float
    reasons: list[str] = field(default_factory=list)
    tokens: int = 0
    cut: bool = False


def tokens(text: str) -> int:
    return (len(text) + 3) // 4


def fit(blocks: list[Block], budget: int, reserve: int = RESERVE) -> tuple[list[Block], list[Block]]:
    """The blocks that fit, and those left out.

    The best come first. Of one that does not fit, a definition (100 or more) is cut at a line if over 100 tokens are
    left, one of 60 or more gives its first line; others are left out. A list that was already limited is expected.
    """
    left, kept, out = budget - reserve, [], []
    for b in sorted(blocks, key=lambda b: (-b.score, b.file, b.start)):
        b.tokens = b.tokens or tokens(b.content)
        if b.tokens <= left:
            kept.append(b)
        elif left > 100 and b.score >= 60:
            lines, used = [], 0
            for line in b.content.split("\n")[: None if b.score >= 100 else 1]:
                if used + tokens(line + "\n") > left - 10:
                    break
                lines.append(line)
                used += tokens(line + "\n")
            if not lines:
                out.append(b)
                continue
            b = Block(b.file, b.start, b.start + len(lines) - 1, "\n".join([*lines, "..."]), b.score, b.reasons, used + 1, True)
            kept.append(b)
        else:
            out.append(b)
            continue
        left -= b.tokens
    return sorted(kept, key=lambda b: (b.file, b.start)), out


def as_text(blocks: list[Block]) -> str:
    return "\n\n".join(f"// {b.file}:{b.start}-{b.stop}\n{b.content}" for b in blocks)


def as_json(task: Task, kept: list[Block], left_out: list[Block]) -> str:
    show = lambda b, whole: {"file": b.file, "start": b.start, "end": b.stop, "score": b.score, "tokens": b.tokens, "reasons": b.reasons} | ({"content": b.content} if whole else {})
    return json.dumps({"task": task.description, "intent": task.intent, "symbols": task.symbols, "blocks": [show(b, True) for b in kept], "excluded": [show(b, False) for b in left_out], "tokens": sum(b.tokens for b in kept)})


def manifest(kept: list[Block], left_out: list[Block]) -> str:
    return "\n".join([f"+ {b.file}:{b.start}-{b.stop} ({b.tokens})" for b in kept] + [f"- {b.file}:{b.start}-{b.stop}" for b in left_out])


def gather(nodes: DataFrame, edges: DataFrame, files: DataFrame, description: str, max_tokens: int = 8000) -> tuple[Task, list[Block], list[Block]]:
    """The task, blocks that fit and blocks left out; files (path, text). The rings are limited, so blocks are few."""
    task = parse_task(description)
    spans = source_ranges(ring_walk(nodes, edges, task), nodes)
    lines = F.split("text", "\n")
    rows = spans.join(files.select(F.col("path").alias("file"), lines.alias("_lines")), "file").select("file", "start", F.least("stop", F.size("_lines")).alias("stop"), "score", "reasons", F.array_join(F.filter("_lines", lambda _, i: (i + 1 >= F.col("start")) & (i < F.col("stop"))), "\n").alias("content"))
    blocks = [Block(r.file, r.start, r.stop, r.content, r.score, list(r.reasons)) for r in rows.collect()]
    return task, *fit(blocks, max_tokens)
