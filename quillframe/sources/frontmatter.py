"""Front matter and fixture files (SRC-2, SRC-12, LNT-1, LNT-6): nested fields, with the line of what doesn't parse.

The parser reads the part of YAML that pages and fixtures are written in: block mappings and lists by indent, flow lists and mappings,
plain and quoted scalars, literal and folded blocks, comments.  Anchors, tags, directives and several documents are errors.  Repeated keys: the last holds."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s#\[\]{},&*!|>'"%@`-][^#]*?|-[^\s#:][^#]*?)\s*:(?:\s+|$)""")
_WORDS = {"": None, "~": None, "null": None, "true": True, "false": False}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", '"': '"', "\\": "\\", "/": "/", " ": " ", "e": "\x1b", "_": "\xa0"}


class ParseError(ValueError):
    """What is wrong, and in which line, from 1."""

    def __init__(self, message: str, line: int):
        super().__init__(message)
        self.line = line


def _plain(text: str) -> Any:
    """A scalar without quotes: null, a boolean, a number or the text itself."""
    low = text.lower()
    if low in _WORDS:
        return _WORDS[low]
    if re.fullmatch(r"[-+]?(0|[1-9][0-9_]*)", text):
        return int(text.replace("_", ""))
    if re.fullmatch(r"[-+]?([0-9][0-9_]*)?\.[0-9_]*([eE][-+][0-9]+)?", text) and any(map(str.isdigit, text)):
        return float(text.replace("_", ""))
    return text


class _Flow:
    """A value written on one logical line, read from left to right."""

    def __init__(self, text: str, line: int):
        self.text, self.line, self.at = text, line, 0

    def fail(self, message: str) -> ParseError:
        return ParseError(message, self.line + self.text.count("\n", 0, self.at))

    def skip(self) -> str:
        while True:
            space = re.compile(r"\s*").match(self.text, self.at)
            self.at = space.end()
            if self.text.startswith("#", self.at) and (not self.at or self.text[self.at - 1].isspace()):
                self.at = (self.text.find("\n", self.at) + 1) or len(self.text)
            else:
                return self.text[self.at : self.at + 1]

    def quoted(self) -> str:
        mark = self.text[self.at]
        pattern = r'"((?:[^"\\]|\\.)*)"' if mark == '"' else r"'((?:[^']|'')*)'"
        found = re.compile(pattern, re.DOTALL).match(self.text, self.at)
        if not found:
            raise self.fail("a quote is not closed")
        self.at = found.end()
        inner = re.sub(r"[ \t]*\n[ \t]*", " ", found[1])
        if mark == "'":
            return inner.replace("''", "'")

        def escape(m: re.Match) -> str:
            if m[1][0] in "xu":
                return chr(int(m[1][1:], 16))
            if m[1] not in _ESCAPES:
                raise self.fail(f"unknown escape \\{m[1]}")
            return _ESCAPES[m[1]]

        return re.sub(r"\\(x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|.)", escape, inner, flags=re.DOTALL)

    def value(self, ends: str) -> Any:
        first = self.skip()
        if first and first in "\"'":
            return self.quoted()
        if first == "[":
            return self.many("]")
        if first == "{":
            return dict(self.many("}"))
        if first and first in "&*!%@`|>":
            raise self.fail(f"{first} can't begin a value here")
        stop = re.compile(r"(?:[ \t]+#|[" + re.escape(ends) + r"]|: |:$|\n|$)" if ends else r"(?:[ \t]+#|$)").search(self.text, self.at)
        text = self.text[self.at : stop.start()].strip()
        self.at = stop.start()
        if not ends and re.search(r":(\s|$)", text):
            raise self.fail("a mapping can't begin inside a value")
        return _plain(text)

    def many(self, close: str) -> list:
        out: list = []
        self.at += 1
        while True:
            if self.skip() == close:
                self.at += 1
                return out
            if not self.text[self.at :]:
                raise self.fail(f"{close} is missing")
            item = self.value(",]}:" if close == "}" else ",]}")
            if close == "}" or self.skip() == ":":
                key, item = item, None
                if self.skip() == ":":
                    self.at += 1
                    item = None if self.skip() in (",", close) else self.value(",]}")
                item = (str(key), item) if close == "}" else {str(key): item}
            out.append(item)
            after = self.skip()
            if after == ",":
                self.at += 1
            elif after != close:
                raise self.fail(f"expected , or {close}")

    def whole(self) -> Any:
        out = self.value("")
        if self.skip():
            raise self.fail("text behind the end of a value")
        return out


class _Lines:
    """The lines of a document with the place that has been read."""

    def __init__(self, text: str, first: int):
        self.lines, self.at, self.first = text.replace("\r\n", "\n").split("\n"), 0, first

    def number(self) -> int:
        return self.first + min(self.at, len(self.lines) - 1)

    def peek(self) -> tuple[int, str] | None:
        """(indent, text) of the next line that isn't blank or a comment."""
        while self.at < len(self.lines):
            line = self.lines[self.at]
            bare = line.lstrip(" ")
            if bare.strip() and not bare.startswith("#"):
                if bare.startswith("\t"):
                    raise ParseError("a tab can't indent", self.number())
                return len(line) - len(bare), bare.rstrip()
            self.at += 1
        return None

    def node(self, least: int) -> Any:
        """What stands here at an indent of ``least`` or more; nothing is null."""
        ahead = self.peek()
        if ahead is None or ahead[0] < least:
            return None
        indent, text = ahead
        if text == "-" or text.startswith("- "):
            return self.sequence(indent)
        if _KEY.match(text):
            return self.mapping(indent)
        return self.scalar(text, indent, least)

    def sequence(self, indent: int) -> list:
        out = []
        while (ahead := self.peek()) and ahead[0] == indent and (ahead[1] == "-" or ahead[1].startswith("- ")):
            rest = ahead[1][1:]
            inner = rest.lstrip(" ")
            if not inner or inner.startswith("#"):
                self.at += 1
                out.append(self.node(indent + 1))
            elif _KEY.match(inner) or inner.startswith("- "):
                # The item's own block begins behind the dash.
                deeper = indent + 1 + len(rest) - len(inner)
                self.lines[self.at] = " " * deeper + inner
                out.append(self.node(deeper))
            else:
                out.append(self.scalar(inner, indent, indent + 1))
        self.after(indent)
        return out

    def mapping(self, indent: int) -> dict:
        out: dict[str, Any] = {}
        while (ahead := self.peek()) and ahead[0] == indent:
            found = _KEY.match(ahead[1])
            if not found:
                if ahead[1] == "-" or ahead[1].startswith("- "):
                    break
                raise ParseError("expected a key and a colon", self.number())
            name = found[1]
            key = _Flow(name, self.number()).quoted() if name[0] in "\"'" else str(_plain(name.strip()) if name.strip().lower() not in _WORDS else name.strip())
            rest = ahead[1][found.end() :]
            if not rest or rest.startswith("#"):
                self.at += 1
                ahead = self.peek()
                # A list may stand at the indent of its key.
                same = ahead is not None and ahead[0] == indent and (ahead[1] == "-" or ahead[1].startswith("- "))
                out[key] = self.sequence(indent) if same else self.node(indent + 1)
            else:
                out[key] = self.scalar(rest, indent, indent + 1)
        self.after(indent)
        return out

    def after(self, indent: int) -> None:
        ahead = self.peek()
        if ahead and ahead[0] > indent:
            raise ParseError("indented further than what it belongs to", self.number())

    def scalar(self, text: str, indent: int, least: int) -> Any:
        """A value that begins with ``text`` in this line; lines further in belong to it."""
        block = re.fullmatch(r"([|>])([+-]?)([1-9]?)([+-]?)(?:\s+#.*)?", text)
        if block:
            return self.block(block[1], block[2] or block[4], int(block[3]) if block[3] else 0, indent)
        number, held = self.number(), [text]
        self.at += 1
        opens = text[:1] in "[{\"'"
        while self.at < len(self.lines):
            line = self.lines[self.at]
            if opens:
                try:
                    return _Flow("\n".join(held), number).whole()
                except ParseError as error:
                    if not re.search("missing|not closed|expected", str(error)):
                        raise
            bare = line.strip()
            if not opens and (not bare or bare.startswith("#") or re.search(r"\s#", held[-1])):
                break
            if len(line) - len(line.lstrip(" ")) < least and bare:
                break
            if not opens and (_KEY.match(bare) and ":" in bare):
                raise ParseError("a mapping can't begin inside a value", self.number())
            held.append(line)
            self.at += 1
        if opens:
            return _Flow("\n".join(held), number).whole()
        return _Flow(" ".join(x.strip() for x in held), number).whole()

    def block(self, style: str, chomp: str, given: int, indent: int) -> str:
        """Literal (|) or folded (>) lines; the first one sets the indent."""
        self.at += 1
        held: list[str] = []
        depth = indent + given if given else 0
        while self.at < len(self.lines):
            line = self.lines[self.at]
            own = len(line) - len(line.lstrip(" "))
            if line.strip():
                if not depth:
                    depth = own
                if own < depth or own <= indent:
                    break
            held.append(line[depth:] if depth else "")
            self.at += 1
        tail = len(held)
        while tail and not held[tail - 1]:
            tail -= 1
        ends = {"-": "", "+": "\n" * (1 + len(held) - tail)}.get(chomp, "\n") if tail else ""
        body = held[:tail]
        if style == "|":
            return "\n".join(body) + ends
        out = ""
        for i, line in enumerate(body):
            if not i:
                out = line
            elif not line:
                out += "\n"
            elif line.startswith(" ") or body[i - 1].startswith(" "):
                out += "\n" + line
            else:
                out += line if not body[i - 1] else " " + line
        return out + ends


def parse(text: str, first_line: int = 1) -> Any:
    """The value of a document; ParseError names a line counted from ``first_line``."""
    lines = _Lines(text, first_line)
    value = lines.node(0)
    if lines.peek():
        raise ParseError("doesn't belong to what stands before it", lines.number())
    return value


# ---- columns


_PARSED = "key string, fields string, error string, line int"


def with_fields(rows: DataFrame, key: str, head: Column, first_line: int = 1) -> DataFrame:
    """``rows`` with ``fields`` (a variant: the parsed mapping, an empty one if it doesn't parse or isn't a mapping), ``error`` and ``line``.

    Keys must be unique strings.  A null ``head`` gives null in all three."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for name, text in zip(frame["key"], frame["head"], strict=True):
                value, error, line = None, None, None
                try:
                    value = parse(text, first_line)
                except ParseError as wrong:
                    error, line = str(wrong), wrong.line
                out.append((name, json.dumps(value if isinstance(value, dict) else {}, ensure_ascii=False), error, line))
            yield pd.DataFrame(out, columns=["key", "fields", "error", "line"]).astype({"line": "Int32"})

    told = rows.select(F.col(key).cast("string").alias("key"), head.alias("head")).where("head is not null").mapInPandas(read, _PARSED)
    told = told.select(F.col("key").alias("_key"), F.try_parse_json("fields").alias("fields"), "error", "line")
    return rows.join(told, rows[key].cast("string") == told["_key"], "left").drop("_key")


FENCED = r"(?s)\A---\n(.*?)\n---\n"


def pages(files: DataFrame) -> DataFrame:
    """path, stem, category, fields, error, line, body of files (path, raw) that begin with a fence; errors are rows, not losses."""
    raw = F.regexp_replace("raw", "\r\n", "\n")
    fenced = files.withColumn("raw", raw).where(F.col("raw").rlike(FENCED))
    told = with_fields(fenced, "path", F.regexp_extract("raw", FENCED, 1), first_line=2)
    stem, folder = F.regexp_extract("path", r"([^/]*?)(?:\.md)?$", 1), F.regexp_extract("path", r"([^/]*)/[^/]*$", 1)
    return told.select("path", stem.alias("stem"), folder.alias("category"), "fields", "error", "line", F.regexp_replace("raw", FENCED, "").alias("body"))


def invalid(parsed: DataFrame) -> DataFrame:
    """(path, error, line) of each page whose front matter doesn't parse."""
    return parsed.where("error is not null").select("path", "error", "line")


def unquoted_links(files: DataFrame) -> DataFrame:
    """(path, field): list fields with an item that is a wiki link without quotes, which reads as a nested list."""
    lines = files.withColumn("raw", F.regexp_replace("raw", "\r\n", "\n")).where(F.col("raw").rlike(FENCED)).select("path", F.posexplode(F.split(F.regexp_extract("raw", FENCED, 1), "\n")).alias("at", "x"))
    name = F.when(F.col("x").rlike(r"^[A-Za-z_][\w-]*\s*:"), F.regexp_extract("x", r"^([A-Za-z_][\w-]*)\s*:", 1))
    field = F.last(name, ignorenulls=True).over(Window.partitionBy("path").orderBy("at"))
    return lines.withColumn("field", field).where(F.col("x").rlike(r"^\s*-\s*\[\[") & F.col("field").isNotNull()).select("path", "field").distinct()


# ---- fixture files


def read_yaml(spark: SparkSession, folder: str, glob: str = "*.yaml") -> DataFrame:
    """Every such file below a folder, recursively: path, value (a variant), error, line.

    Spark reads the files, whole, a row each, so any store that it reaches will do and small files share a task."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out: list[tuple] = []
            for path, raw in zip(frame["path"], frame["raw"], strict=True):
                try:
                    out.append((path, json.dumps(parse(raw), ensure_ascii=False), None, None))
                except ParseError as wrong:
                    out.append((path, None, str(wrong), wrong.line))
            yield pd.DataFrame(out, columns=["path", "value", "error", "line"]).astype({"line": "Int32"})

    return files.mapInPandas(read, "path string, value string, error string, line int").withColumn("value", F.try_parse_json("value"))


#: How much an anchor may matter, and what each kind of fixture must have.
IMPORTANCE = ("critical", "high", "normal")
AXES = ("headline_claims", "capabilities", "limitations", "related_papers")


def _text(path: str) -> Column:
    return F.try_variant_get("value", f"$.{path}", "string")


def fixture_errors(files: DataFrame) -> DataFrame:
    """``files`` with ``problem``: the first rule that a fixture breaks, null if it is sound.

    Content fixtures need paper_stem, paper_type and title; retrieval fixtures a query and anchors of their own kind only.  Items
    need an id or link and a known importance."""
    kind = F.coalesce(_text("fixture_type"), F.lit("content"))
    some = lambda p: F.coalesce(F.try_variant_get("value", f"$.{p}", "array<variant>"), F.array().cast("array<variant>"))
    bad = lambda e, least: F.exists(e, lambda x: ~F.coalesce(F.try_variant_get(x, "$.importance", "string"), F.lit(least)).isin(*IMPORTANCE))
    nameless = lambda e: F.exists(e, lambda x: F.coalesce(F.try_variant_get(x, "$.id", "string"), F.try_variant_get(x, "$.link", "string"), F.lit("")) == "")
    items = F.flatten(F.array(*[some(a) for a in AXES]))
    claims, pages_ = some("expected_claims"), some("expected_pages")
    lacks = lambda e, names: F.exists(e, lambda x: F.lit(False) if not names else _any_null(x, names))
    empty = lambda p: F.trim(F.coalesce(_text(p), F.lit(""))) == ""
    problem = (
        F.when(F.col("error").isNotNull(), F.concat(F.lit("unreadable: "), F.col("error")))
        .when(F.schema_of_variant("value").startswith("OBJECT") == F.lit(False), "not a mapping")
        .when(~kind.isin("content", "claims", "pages"), "unknown fixture_type")
        .when((kind == "content") & (empty("paper_stem") | empty("paper_type") | empty("title")), "missing field")
        .when((kind == "content") & nameless(items), "item without id or link").when((kind == "content") & bad(items, "normal"), "unknown importance")
        .when((kind != "content") & empty("query"), "no query")
        .when((kind == "claims") & (F.size(claims) == 0), "no expected_claims").when((kind == "claims") & (F.size(pages_) > 0), "pages in a claims fixture")
        .when((kind == "pages") & (F.size(pages_) == 0), "no expected_pages").when((kind == "pages") & (F.size(claims) > 0), "claims in a pages fixture")
        .when(lacks(claims, ("paper_stem", "section", "position", "importance")) | lacks(pages_, ("paper_stem", "importance")) | lacks(some("must_not_appear"), ("paper_stem",)), "anchor lacks a field")
        .when(bad(claims, "") | bad(pages_, ""), "unknown importance")
    )
    return files.withColumn("problem", problem)


def _any_null(x: Column, names: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for n in names:
        out = out | F.try_variant_get(x, f"$.{n}", "string").isNull()
    return out


def fixture_items(files: DataFrame) -> DataFrame:
    """(path, axis, position, id, importance, verbalization, link) of the items of sound content fixtures (path, value)."""
    axes = F.array(*[F.struct(F.lit(a).alias("axis"), F.coalesce(F.try_variant_get("value", f"$.{a}", "array<variant>"), F.array().cast("array<variant>")).alias("of")) for a in AXES])
    rows = files.select("path", F.explode(axes).alias("a")).select("path", "a.axis", F.posexplode("a.of").alias("position", "item"))
    get = lambda p: F.try_variant_get("item", f"$.{p}", "string")
    return rows.select("path", "axis", "position", F.coalesce(get("id"), get("link")).alias("id"), F.coalesce(get("importance"), F.lit("normal")).alias("importance"), F.regexp_replace(F.coalesce(get("verbalization"), F.lit("")), r"\A\s+|\s+\z", "").alias("verbalization"), get("link").alias("link"))
