"""Column expressions: ids, URIs, globs, names, cosine, text for embeddings."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def short_id(text: str | Column) -> Column:
    """URL-safe base64, without padding, of the first 16 bytes of the SHA-256."""
    digest = F.substring(F.unhex(F.sha2(col(text), 256)), 1, 16)
    return F.rtrim(F.translate(F.base64(digest), "+/", "-_"), F.lit("="))


def edge_id(kind: str | Column, source: str | Column, target: str | Column) -> Column:
    return short_id(F.concat_ws("\0", col(kind), col(source), col(target)))


def glob_regex(glob: str) -> str:
    """A regular expression for a glob whose star crosses slashes: * ? [set] [^set]."""
    return "(?s)^" + _glob(glob, ".*", ".") + "$"


def path_glob_regex(glob: str) -> str:
    """A regular expression for a path glob: * and ? stay within a segment, ** stands for any number of segments."""
    out = []
    for i, part in enumerate(parts := glob.split("/")):
        if part == "**":
            out.append("(?:[^/]+/)*" if i < len(parts) - 1 else ".*")
        else:
            out.append(_glob(part, "[^/]*", "[^/]") + ("/" if i < len(parts) - 1 else ""))
    return "^" + "".join(out) + "$"


def _glob(glob: str, star: str, one: str) -> str:
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out.append(star)
        elif c == "?":
            out.append(one)
        elif end > 0:
            inner = glob[i + 1 : end].replace("\\", r"\\").replace("[", r"\[").replace("&&", r"&\&")
            out.append(f"[{inner}]")
            i = end
        else:
            out.append(re.escape(c) if not c.isalnum() else c)
        i += 1
    return "".join(out)


def like(c: Column, pattern: str) -> Column:
    """LIKE without regard to ASCII case and without an escape character."""
    low = lambda x: F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    fold = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in pattern)
    return low(c).rlike("(?s)^" + "".join(".*" if x == "%" else "." if x == "_" else re.escape(x) if not x.isalnum() else x for x in fold) + "$")


def path_of(uri: str | Column) -> Column:
    return F.regexp_replace(col(uri), r"^[a-z+]+://", "")


def file_uri(path: str | Column) -> Column:
    return F.concat(F.lit("file://"), col(path))


#: Node type domains and the schemes of their URIs (fixed values).
SCHEMES = {"fs": "file://", "vcs": "git+file://", "go": "go+file://", "md": "file+md://", "project": "project+file://", "code": "file+todo://"}


def scope_prefix(kind: str, path: str) -> str:
    return SCHEMES.get(kind.split(":")[0], "file://") + path


def extension(name: str | Column) -> Column:
    return F.regexp_extract(col(name), r"\.([^.]*)$", 1)


def slug(text: str | Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(col(text)), r"[^a-z0-9\s-]", ""), r"[\s-]+", "-"), F.lit("-"))


def content_hash(text: str | Column) -> Column:
    return F.left(F.sha2(col(text), 256), F.lit(16))


def token_estimate(text: str | Column) -> Column:
    return F.floor((F.length(col(text)) + 3) / 4).cast("long")


def commit_name(sha: str | Column, subject: str | Column) -> Column:
    s = col(subject)
    return F.concat(F.left(col(sha), F.lit(8)), F.lit(" -- "), F.when(F.length(s) > 72, F.concat(F.left(s, F.lit(69)), F.lit("..."))).otherwise(s))


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine similarity in double precision; 0 for vectors that are empty, of different sizes or of norm zero."""
    a, b = col(a).cast("array<double>"), col(b).cast("array<double>")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    same = (F.size(a) > 0) & (F.size(a) == F.size(b))
    return F.when(same & (norms > 0), dot(a, b) / norms).otherwise(0.0)


def field(data: str | Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(col(data), "$." + path, kind)


def embedding_text() -> Column:
    """What is embedded of a node: its name, type, labels and the text fields of its data, by one space each."""
    parts = ["doc", "signature", "message", "body", "context"]
    return F.concat_ws(" ", F.nullif("name", F.lit("")), "type", F.nullif(F.concat_ws(" ", "labels"), F.lit("")), *[F.nullif(field("data", p), F.lit("")) for p in parts])


def display_name() -> Column:
    """How a tree shows a node by its type and data: folders with a slash, links with their target, sections with their level."""
    plain = F.coalesce(F.nullif("name", F.lit("")), F.nullif("key", F.lit("")), F.nullif("uri", F.lit("")), F.col("id"))
    told = lambda *paths: F.coalesce(*[F.nullif(field("data", x), F.lit("")) for x in paths])
    short = lambda c: F.when(F.length(c) > 50, F.concat(F.left(c, F.lit(47)), F.lit("..."))).otherwise(c)
    target, kind = short(told("url", "target")), F.col("type")
    lines = F.coalesce(field("data", "lines", "int"), F.size(F.split(field("data", "content"), "\n")), F.lit(0))
    return (
        F.when(kind == "fs:dir", F.concat(plain, F.lit("/")))
        .when((kind == "fs:link") & told("target").isNotNull(), F.concat(plain, F.lit(" -> "), told("target")))
        .when(kind == "vcs:commit", commit_name("key", "name"))
        .when((kind == "vcs:remote") & told("urls[0]").isNotNull(), F.concat(plain, F.lit(" ("), told("urls[0]"), F.lit(")")))
        .when((kind == "vcs:branch") & F.coalesce(field("data", "is_head", "boolean"), F.lit(False)), F.concat(plain, F.lit(" *")))
        .when((kind == "md:section") & told("level").isNotNull(), F.concat(plain, F.lit(" (h"), told("level"), F.lit(")")))
        .when(kind == "md:codeblock", F.concat(F.coalesce(F.nullif("name", F.lit("")), F.lit("text")), F.lit(" ("), lines.cast("string"), F.lit(" lines)")))
        .when((kind == "md:link") & target.isNotNull(), F.when(F.col("name") != "", F.concat(F.lit("["), "name", F.lit("]("), target, F.lit(")"))).otherwise(target))
        .when(kind == "md:image", F.when(F.col("name") != "", F.concat(F.lit("!["), "name", F.lit("]"))).otherwise(F.coalesce(target, plain)))
        .otherwise(plain)
    )


def size_text(n: int) -> str:
    for unit, one in (("GB", 1 << 30), ("MB", 1 << 20), ("KB", 1 << 10)):
        if n >= one:
            return f"{n / one:.1f} {unit}"
    return f"{n} B"


def duration_text(seconds: float) -> str:
    """The two largest units that are not zero."""
    if seconds < 1:
        return "< 1s"
    hours, minutes, rest = int(seconds // 3600), int(seconds // 60) % 60, int(seconds) % 60
    parts = [(hours, "h"), (minutes, "m")] if hours else [(minutes, "m"), (rest, "s")]
    return " ".join(f"{n}{unit}" for n, unit in parts if n)


def ago_text(seconds: float) -> str:
    if seconds < 60:
        return "just now"
    n, unit = next((int(seconds // one), u) for one, u in ((86400, "day"), (3600, "hour"), (60, "minute")) if seconds >= one)
    return f"{n} {unit}{'' if n == 1 else 's'} ago"


def count_text(n: int) -> str:
    return f"{n:,}"


def token_count(text: str | Column, encode: Callable[[str], Sequence]) -> Column:
    """How many tokens encode gives of each text; null has none. encode goes to the workers, so it must be picklable."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: len(encode(t)) if t else 0).astype("int64")

    return count(col(text))
