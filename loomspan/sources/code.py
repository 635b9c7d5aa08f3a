"""Source scans: Java and TypeScript files to rows of files, methods and fields, routes, transitions and UI elements.

Files are read by Spark (one row a file) and parsed where they are, file by file. The parsers are small
tokenizers: they follow declarations, annotations, bodies and control flow, not types or name resolution. A file
that can't be read to its end gives the rows up to there.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions.batches import batches
from loomspan.operators.trees import ARGUMENT_ROW, ENUM_ROW, MAX_ARGS

MAX_DEPTH = 9
_LEX = re.compile(
    r"(?P<space>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<text>\"\"\".*?(?:\"\"\"|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?)|(?P<name>[A-Za-z_$][\w$]*)|(?P<number>\d[\w.]*)|(?P<sign>::|->|=>|\.\.\.|&&|\|\||[^\s])",
    re.S,
)
MODIFIERS = frozenset("public private protected static final abstract synchronized native default transient volatile strictfp sealed readonly async export declare override".split())
FLOW = frozenset("if else for while do switch case default try catch finally synchronized".split())
LEAVING = frozenset("return throw break continue yield".split())


def sources(spark: SparkSession, path: str, glob: str = "*.java") -> DataFrame:
    """(path, text) of every file below a folder, but for test folders."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).where(~F.col("path").contains("/test/"))


def lex(text: str) -> list[tuple[str, str, int]]:
    """(kind, token, position), without comments and white space."""
    return [(m.lastgroup, m[0], m.start()) for m in _LEX.finditer(text or "") if m.lastgroup != "space"]


class _Lexed:
    """The tokens of ``lex`` as places in the text: a long file takes some ten bytes a token instead of a tuple."""

    KINDS = ("text", "name", "number", "sign")

    def __init__(self, text: str):
        self.text, self.kinds, self.begins, self.ends = text or "", bytearray(), array("I"), array("I")
        for m in _LEX.finditer(self.text):
            if m.lastgroup != "space":
                self.kinds.append(self.KINDS.index(m.lastgroup))
                self.begins.append(m.start())
                self.ends.append(m.end())

    def __len__(self) -> int:
        return len(self.kinds)

    def __getitem__(self, i):
        if isinstance(i, slice):
            return [self[k] for k in range(*i.indices(len(self)))]
        begin = self.begins[i]
        return self.KINDS[self.kinds[i]], self.text[begin : self.ends[i]], begin


class _Rows(list):
    """Rows of one file, of the kinds asked for only; what the file's row counts is counted of all."""

    def __init__(self, kinds: tuple[str, ...]):
        super().__init__()
        self.kinds, self.counts = kinds, {"method": 0, "variable": 0, "constant": 0}

    def wanted(self, kind: str) -> bool:
        return not self.kinds or kind in self.kinds

    def append(self, row: dict) -> None:
        if row["row"] == "method":
            self.counts["method"] += row["kind"] == "signature"
        elif row["fieldKind"] == "field":
            self.counts["constant" if row["isFinal"] == 1 else "variable"] += 1
        if self.wanted(row["row"]):
            super().append(row)

    def extend(self, rows) -> None:
        for r in rows:
            self.append(r)


class _Tokens:
    def __init__(self, text: str):
        self.text, self.all, self.at = text, _Lexed(text), 0

    def peek(self, k: int = 0) -> str:
        return self.all[self.at + k][1] if self.at + k < len(self.all) else ""

    def kind(self) -> str:
        return self.all[self.at][0] if self.at < len(self.all) else ""

    def take(self) -> str:
        self.at += 1
        return self.all[self.at - 1][1] if self.at <= len(self.all) else ""

    def position(self) -> int:
        return self.all[self.at][2] if self.at < len(self.all) else len(self.text)

    def skip(self, left: str, right: str) -> str:
        """Takes a balanced group that begins here; its source."""
        begin, depth = self.position(), 0
        while self.at < len(self.all):
            t = self.take()
            depth += (t == left) - (t == right)
            if not depth:
                break
        return self.text[begin : self.position()].strip()

    def until(self, *ends: str) -> str:
        """Takes tokens up to one of the ends at depth 0 (not taken); their source."""
        begin = self.position()
        while self.at < len(self.all) and self.peek() not in ends:
            t = self.peek()
            if t in "([{" and t:
                self.skip(t, {"(": ")", "[": "]", "{": "}"}[t])
            elif t in ("}", ")"):
                break
            else:
                self.take()
        return self.text[begin : self.position()].strip()


def split_top(text: str) -> list[str]:
    """Parts of a list at its top-level commas."""
    out, depth, begin = [], 0, 0
    for m in re.finditer(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|[()\[\]{}<>,]", text):
        c = m[0]
        if c in "([{<":
            depth += 1
        elif c in ")]}>" and len(c) == 1:
            depth -= 1
        elif c == "," and depth == 0:
            out.append(text[begin : m.start()])
            begin = m.end()
    return [p.strip() for p in [*out, text[begin:]] if p.strip()]


def _flow(t: _Tokens, out: list[tuple[tuple[int, ...], str]], at: tuple[int, ...]) -> None:
    """Statements of a block whose '{' was taken, up to its '}': coordinates and headers; blocks and labels are transparent."""
    n = 0

    def statement() -> None:
        nonlocal n
        word = t.peek()
        if word == "{":
            t.take()
            inner(at, False)
        elif word == ";":
            t.take()
        elif word in FLOW:
            chain(at)
        elif t.peek(1) == ":" and t.kind() == "name" and word not in ("case", "default"):
            t.take()
            t.take()
            statement()
        else:
            text = t.until(";", "}")
            if t.peek() == ";":
                t.take()
            if text:
                n += 1
                row((*at, n), text)

    def row(where: tuple[int, ...], text: str) -> None:
        if len(where) <= MAX_DEPTH - 1:
            out.append((where, re.sub(r"\s+", " ", text)))

    def inner(where: tuple[int, ...], own: bool) -> None:
        """A block or a single statement as the body of a unit."""
        nonlocal n
        if own:
            _body(t, out, where)
        else:
            while t.at < len(t.all) and t.peek() != "}":
                before = t.at
                statement()
                if t.at == before:
                    t.take()
            t.take()

    def chain(where: tuple[int, ...]) -> None:
        nonlocal n
        while t.peek() in FLOW:
            begin, word = t.position(), t.take()
            if word == "else" and t.peek() == "if":
                t.take()
            if t.peek() == "(":
                t.skip("(", ")")
            elif word in ("case", "default"):
                t.until(":", "->")
            header = t.text[begin : t.position()].strip()
            n += 1
            row((*where, n), header)
            if word in ("case", "default"):
                t.take()
                _case(t, out, (*where, n))
            else:
                _body(t, out, (*where, n))
            if word == "do" and t.peek() == "while":
                t.until(";")
                t.take()
            if t.peek() not in ("else", "catch", "finally", "case", "default"):
                break

    while t.at < len(t.all) and t.peek() != "}":
        before = t.at
        statement()
        if t.at == before:
            t.take()
    t.take()


def _body(t: _Tokens, out: list, where: tuple[int, ...]) -> None:
    if t.peek() == "{":
        t.take()
        _flow(t, out, where)
    elif t.peek() == ";":
        t.take()
    elif t.peek() in FLOW:
        sub = _Tokens("")
        begin = t.at
        # A single statement: read it as a block of its own.
        t.until(";") if t.peek() not in FLOW else _one(t)
        sub.text, sub.all = t.text, [*t.all[begin : t.at], ("sign", "}", t.position())]
        _flow(sub, out, where)
    else:
        text = t.until(";", "}")
        if t.peek() == ";":
            t.take()
        if text and len(where) < MAX_DEPTH - 1:
            out.append(((*where, 1), re.sub(r"\s+", " ", text)))


def _one(t: _Tokens) -> None:
    """Takes one control statement with its body and what continues it."""
    while t.peek() in FLOW:
        t.take()
        if t.peek() == "if":
            t.take()
        if t.peek() == "(":
            t.skip("(", ")")
        if t.peek() == "{":
            t.skip("{", "}")
        elif t.peek() in FLOW:
            _one(t)
        else:
            t.until(";", "}")
            if t.peek() == ";":
                t.take()
        if t.peek() not in ("else", "catch", "finally"):
            break


def _case(t: _Tokens, out: list, where: tuple[int, ...]) -> None:
    """Statements of a case, up to the next label or the end of the switch."""
    begin, depth = t.at, 0
    while t.at < len(t.all):
        word = t.peek()
        if depth == 0 and word in ("case", "default", "}"):
            break
        depth += (word == "{") - (word == "}")
        t.take()
    sub = _Tokens("")
    sub.text, sub.all = t.text, [*t.all[begin : t.at], ("sign", "}", t.position())]
    _flow(sub, out, where)


def parse_file(path: str, text: str, *kinds: str) -> list[dict]:
    """Rows of one Java or TypeScript file; ``row`` is file, method or field (of the kinds given, or of all)."""
    rows = _Rows(kinds)
    try:
        _types(_Tokens(text or ""), path, text or "", rows)
    except (IndexError, RecursionError):
        pass  # what was read so far stays
    return rows


def _types(t: _Tokens, path: str, text: str, rows: list[dict]) -> None:
    imports, first = [], None
    pending: list[str] = []
    while t.at < len(t.all):
        word = t.peek()
        if word == "import":
            begin = t.position()
            while t.at < len(t.all) and t.peek() != ";" and "\n" not in text[begin : t.position()]:
                t.take()
            imports.append(re.sub(r"\s+", " ", text[begin : t.position()].strip()).rstrip(";"))
        elif word == "@" and t.peek(1) != "interface":
            pending.append(_annotation(t))
        elif word in ("class", "interface", "enum", "record") and re.match(r"[A-Za-z_$]", t.peek(1) or ""):
            t.take()
            name = t.take()
            first = first or name
            header = t.until("{", ";")
            parameters = header if word == "record" else ""
            if t.peek() == "{":
                t.take()
                if word == "enum":
                    _constants(t, path, name, rows)
                _members(t, path, name, rows)
            for p in split_top(re.sub(r"^[^(]*\(|\)[^)]*$", "", parameters)) if "(" in parameters else []:
                _field(path, name, "-", "field", p, rows, final=1)
            pending.clear()
        else:
            t.take()
    if not rows.wanted("file"):
        return
    counts = rows.counts
    rows.insert(0, {"row": "file", "path": path, "className": first or "-", "importList": " / ".join(imports) or "-", "lineCount": text.count("\n") + 1, "methodCount": counts["method"], "variableCount": counts["variable"], "constantCount": counts["constant"]})


def _annotation(t: _Tokens) -> str:
    begin = t.position()
    t.take()
    t.take()
    while t.peek() == ".":
        t.take()
        t.take()
    if t.peek() == "(":
        t.skip("(", ")")
    return t.text[begin : t.position()].strip()


def _constants(t: _Tokens, path: str, name: str, rows: list[dict]) -> None:
    """Enum constants, ``MAX_ARGS`` a row."""
    values = []
    while t.at < len(t.all) and t.peek() not in (";", "}"):
        if t.peek() == "@":
            _annotation(t)
        elif t.kind() == "name":
            values.append(t.take())
            if t.peek() == "(":
                t.skip("(", ")")
            if t.peek() == "{":
                t.skip("{", "}")
            t.until(",", ";", "}")
        else:
            t.take()
    if t.peek() == ";":
        t.take()
    for page in range(0, len(values), MAX_ARGS):
        rows.append({"row": "method", "kind": "enum", "path": path, "className": name, "methodName": "-", "process": [1, -1, page // MAX_ARGS], "processContent": ENUM_ROW, "args": values[page : page + MAX_ARGS]})


def _field(path: str, cls: str, method: str, kind: str, text: str, rows: list[dict], final: int | None = None) -> None:
    notes = re.findall(r"@[\w.]+(?:\((?:[^()\"]|\"[^\"]*\"|\([^()]*\))*\))?", text)
    bare = re.sub(r"@[\w.]+(?:\((?:[^()\"]|\"[^\"]*\"|\([^()]*\))*\))?", " ", text).split("=")[0].strip()
    words = bare.split()
    is_final = int("final" in words or "readonly" in words) if final is None else final
    typed = re.match(r"^(?:[\w\s]*\s)?(\w[\w$]*)\s*[?!]?\s*:\s*(.+)$", bare, re.S)
    if typed:  # TypeScript: name: type
        name, kind_of = typed[1], typed[2].strip()
    else:
        bare = " ".join(w for w in words if w not in MODIFIERS)
        java = re.match(r"^(.*\S)\s+([A-Za-z_$][\w$]*)((?:\s*\[\s*\])*)$", bare, re.S)
        if not java:
            return
        name, kind_of = java[2], java[1] + re.sub(r"\s", "", java[3])
    rows.append({"row": "field", "path": path, "className": cls, "methodName": method, "fieldKind": kind, "fieldName": name, "fieldType": kind_of, "isFinal": is_final, "rawAnnotations": " ".join(notes) or "-"})


def _members(t: _Tokens, path: str, cls: str, rows: list[dict]) -> None:
    """Members of a type whose '{' was taken, up to its '}'."""
    number = 0
    while t.at < len(t.all) and t.peek() != "}":
        begin, words, notes = t.position(), [], []
        while t.at < len(t.all) and t.peek() not in (";", "{", "}", "(", "="):
            if t.peek() == "@" and t.peek(1) != "interface":
                notes.append(_annotation(t))
            elif t.peek() in ("class", "interface", "enum", "record") and re.match(r"[A-Za-z_$]", t.peek(1) or "") and (not words or words[-1] in MODIFIERS):
                word, name = t.take(), t.peek()
                t.take()
                t.until("{", ";")
                t.take()
                if word == "enum":
                    _constants(t, path, name, rows)
                _members(t, path, name, rows)
                words = []
                begin = t.position()
            else:
                words.append(t.take())
        head = t.peek()
        if head == "(":
            name = words[-1] if words else "-"
            parameters = t.skip("(", ")")[1:-1]
            tail = t.until("{", ";")
            number += 1
            plain = [w for w in words[:-1] if w not in MODIFIERS]
            returns = re.sub(r"^:\s*", "", tail) if tail.startswith(":") else re.sub(r"\s*([<>,.\[\]])\s*", r"\1", " ".join(plain)) or "-"
            args = split_top(parameters)
            common = {"row": "method", "path": path, "className": cls, "methodName": name, "returnType": returns, "accessModifier": next((w for w in words if w in ("public", "private", "protected")), "-"), "methodType": "static" if "static" in words else "instance"}
            rows.append({**common, "kind": "signature", "process": [number], "processContent": ARGUMENT_ROW, "args": args[:MAX_ARGS]})
            for a in args if rows.wanted("field") else ():  # parameters aren't counted
                _field(path, cls, name, "parameter", a, rows)
            if t.peek() == "{":
                t.take()
                steps: list[tuple[tuple[int, ...], str]] = []
                _flow(t, steps, (number,))
                rows.extend({**common, "kind": "step", "process": list(where), "processContent": content, "args": []} for where, content in steps)
            elif t.peek() == ";":
                t.take()
        elif head == "{" and (not words or words == ["static"]):
            t.skip("{", "}")
        else:
            if head == "=":
                t.until(";")
            elif head == "{":
                t.skip("{", "}")
            source = t.text[begin : t.position()]
            if t.peek() == ";":
                t.take()
            if words:
                _field(path, cls, "-", "field", source, rows)
            elif head not in (";", "{", "="):
                t.take()
    t.take()


ROW_SCHEMA = (
    "row string, path string, className string, importList string, lineCount bigint, methodCount bigint, variableCount bigint, constantCount bigint, methodName string, kind string, "
    "process array<bigint>, processContent string, returnType string, accessModifier string, methodType string, args array<string>, fieldKind string, fieldName string, fieldType string, isFinal bigint, rawAnnotations string"
)


def scan(files: DataFrame, *kinds: str) -> DataFrame:
    """Rows of all files (path, text), or those of the kinds given (file, method, field): one narrow pass, a file at a time."""
    columns = [c.split(" ")[0] for c in ROW_SCHEMA.split(", ")]

    def run(frames):
        for frame in frames:
            for rows in batches(r for path, text in zip(frame["path"], frame["text"]) for r in parse_file(path, text, *kinds)):
                out = pd.DataFrame(rows, columns=columns).astype(object)
                yield out.where(out.notna(), None)

    return files.select("path", "text").mapInPandas(run, ROW_SCHEMA)


def method_rows(scanned: DataFrame) -> DataFrame:
    """ast_method_level rows: process1..process9 (-1 where a level isn't used) and arg1..arg20 ('-')."""
    m = scanned.where("row = 'method'")
    return m.select(
        F.col("path").alias("filePath"), "className", "methodName",
        *(F.coalesce(F.get("process", F.lit(i)), F.lit(-1).cast("bigint")).alias(f"process{i + 1}") for i in range(9)),
        "processContent", F.coalesce("returnType", F.lit("-")).alias("returnType"), F.coalesce("methodType", F.lit("-")).alias("methodType"),
        F.coalesce("accessModifier", F.lit("-")).alias("accessModifier"), *(F.coalesce(F.get("args", F.lit(i)), F.lit("-")).alias(f"arg{i + 1}") for i in range(MAX_ARGS)),
    )


def field_rows(scanned: DataFrame) -> DataFrame:
    """ast_field_level rows with bounds and nullability from the annotations."""
    from loomspan.operators.trees import bounds_of

    f = scanned.where("row = 'field'").withColumn("b", bounds_of(F.col("rawAnnotations")))
    return f.select(F.col("path").alias("filePath"), "className", "methodName", "fieldKind", "fieldName", "fieldType", "isFinal", "b.*", "rawAnnotations")


def source_rows(scanned: DataFrame) -> DataFrame:
    """ast_source_file_level rows."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return scanned.where("row = 'file'").select(
        name.alias("fileName"), F.regexp_replace("path", r"[^/]*$", "").alias("directoryPath"), "className", "importList", "lineCount", "methodCount", "variableCount", "constantCount"
    )


# --- routes and transitions -------------------------------------------------------------------------------------

_ROUTE = re.compile(r"<Route\b([^>]*?)/?>", re.S)


def jsx_routes(files: DataFrame) -> DataFrame:
    """(path, text) to (file, route, component): ``<Route path=... element={<C .../>} />`` of files that have routes."""
    tags = F.explode(F.regexp_extract_all("text", F.lit(r"(?s)<Route\b((?:[^>\"'{}]|\"[^\"]*\"|'[^']*'|\{(?:[^{}]|\{[^{}]*\})*\})*)/>"), F.lit(1)))
    rows = files.where(F.col("text").contains("<Route")).select(F.col("path").alias("file"), tags.alias("tag"))
    route = F.regexp_extract("tag", r"\bpath\s*=\s*\{?\s*[\"'`]([^\"'`]*)[\"'`]", 1)
    component = F.regexp_extract("tag", r"(?s)\b(?:element|component)\s*=\s*\{\s*<?\s*([A-Za-z_$][\w$.]*)", 1)
    return rows.select("file", route.alias("route"), component.alias("component")).where("route <> '' and component <> ''")


def object_routes(text: str) -> list[tuple[str, str]]:
    """(route, component) of route objects in createBrowserRouter, createHashRouter, createMemoryRouter and useRoutes; children's paths are joined."""
    out: list[tuple[str, str]] = []

    def objects(body: str, base: str) -> None:
        for item in split_top(body):
            inner = item.strip()[1:-1] if item.strip().startswith("{") else ""
            parts = dict((m[1], m[2].strip()) for p in split_top(inner) if (m := re.match(r"^\s*[\"']?(\w+)[\"']?\s*:\s*(.*)$", p, re.S)))
            own = re.sub(r"^[\"'`]|[\"'`]$", "", parts.get("path", "")).strip()
            full = own if own.startswith("/") else "/".join([base.rstrip("/"), own]) if own else base
            component = re.match(r"<?\s*([A-Za-z_$][\w$.]*)", parts.get("element", parts.get("Component", "")))
            if component:
                out.append((full or "/", component[1]))
            if parts.get("children", "").startswith("["):
                objects(parts["children"][1:-1], full)

    for m in re.finditer(r"\b(?:createBrowserRouter|createHashRouter|createMemoryRouter|useRoutes)\s*\(\s*\[", text or ""):
        depth, end = 1, m.end()
        while end < len(text) and depth:
            depth += (text[end] in "[") - (text[end] in "]")
            end += 1
        objects(text[m.end() : end - 1], "")
    return out


def object_route_rows(files: DataFrame) -> DataFrame:
    """(path, text) to (file, route, component) of route objects."""

    def run(frames):
        for frame in frames:
            yield pd.DataFrame([(p, *r) for p, t in zip(frame["path"], frame["text"]) for r in object_routes(t)], columns=["file", "route", "component"])

    return files.select("path", "text").where(F.col("text").rlike("Router|useRoutes")).mapInPandas(run, "file string, route string, component string")


def merged_routes(*routes: DataFrame) -> DataFrame:
    """Routes of several strategies, the first one's for each route. Columns: file, route, component, strategy (from 0)."""
    out = None
    for i, r in enumerate(routes):
        one = r.select("file", "route", "component").withColumn("strategy", F.lit(i))
        out = one if out is None else out.unionByName(one)
    best = out.groupBy("route").agg(F.min(F.struct("strategy", "file", "component")).alias("r"))
    return best.select("r.file", "route", "r.component", "r.strategy")


def component_files(files: DataFrame) -> DataFrame:
    """Files that define a component: a capitalised function or constant that returns markup."""
    return files.where(F.col("path").rlike(r"\.(tsx|jsx)$") & F.col("text").rlike(r"(?s)\b(function|const|class)\s+[A-Z]\w*.*<[A-Za-z]"))


def file_route(path: Column) -> Column:
    """The route of a page file: folders are segments, (groups) are dropped, [id] is :id, [...rest] is :rest*, index is its folder."""
    steps = F.split(F.regexp_replace(path, r"\.[^./]*$", ""), "/")
    kept = F.filter(steps, lambda s: (s != "") & ~s.rlike(r"^\(.*\)$") & ~s.isin("index", "page"))
    named = F.transform(kept, lambda s: F.regexp_replace(F.regexp_replace(s, r"^\[\.\.\.(.+)\]$", ":$1*"), r"^\[(.+)\]$", ":$1"))
    return F.concat(F.lit("/"), F.array_join(named, "/"))


def static_path(literal: Column) -> Column:
    """The path of a string or template literal (with its quotes): up to the first "${" and "?", NULL unless it begins with "/"."""
    bare = F.regexp_replace(literal, r"^[\"'`]|[\"'`]$", "")
    cut = F.when(literal.startswith("`"), F.regexp_extract(bare, r"(?s)^(.*?)(?:\$\{|$)", 1)).otherwise(bare)
    path = F.regexp_extract(cut, r"(?s)^[^?]*", 0)
    return F.when(path.startswith("/"), path)


def transitions(files: DataFrame) -> DataFrame:
    """(path, text) to (sourceFile, toPath, transitionType): navigate(x) (a number goes back), window.location.href, <Link to>, window.open, and <a href> of plain pages.

    Other arguments than literals, and paths that don't begin with "/", give nothing; anchors keep their address as it is.
    """
    literal = r"(\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)"
    patterns = {
        "navigate": rf"(?<![\w$.])navigate\(\s*{literal}\s*[,)]", "navigate.back": r"(?<![\w$.])navigate\(\s*([-+]?\s*\d[\d.]*)\s*[,)]",
        "location.href": rf"(?<![\w$.])window\.location\.href\s*=\s*{literal}", "Link": rf"(?s)<Link\b[^>]*?\bto\s*=\s*\{{?\s*{literal}",
        "window.open": rf"(?<![\w$.])window\.open\(\s*{literal}\s*[,)]", "anchor": r"(?i)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']+)[\"']",
    }
    found = F.create_map(*(v for name, x in patterns.items() for v in (F.lit(name), F.regexp_extract_all("text", F.lit(x), F.lit(1)))))
    rows = files.select(F.col("path").alias("sourceFile"), F.explode(found).alias("transitionType", "paths"))
    kind, raw = F.col("transitionType"), F.col("raw")
    to = F.when(kind == "navigate.back", "__back__").when(kind == "anchor", raw).otherwise(static_path(raw))
    return rows.select("sourceFile", "transitionType", F.explode("paths").alias("raw")).select("sourceFile", to.alias("toPath"), "transitionType").where("toPath is not null")


NATIVE_TAGS = ("input", "button", "select", "textarea", "a", "form", "label")


# Columns of a UI element and the attributes they come from.
TEXT_ATTRIBUTES = {
    "idAttr": "id", "nameAttr": "name", "classNameAttr": "className", "dataTestId": "data-testid", "typeAttr": "type", "roleAttr": "role",
    "ariaLabel": "aria-label", "ariaLabelledBy": "aria-labelledby", "htmlFor": "htmlFor", "placeholder": "placeholder", "labelProp": "label", "title": "title",
    "pattern": "pattern", "inputMode": "inputMode", "accept": "accept", "autocomplete": "autoComplete", "href": "href", "target": "target", "formAction": "formAction", "formId": "form",
    "ariaExpanded": "aria-expanded", "ariaControls": "aria-controls", "ariaHaspopup": "aria-haspopup", "ariaSelected": "aria-selected", "ariaChecked": "aria-checked", "defaultValue": "defaultValue",
}
NUMBER_ATTRIBUTES = {"maxLength": "maxLength", "minLength": "minLength", "maxValue": "max", "minValue": "min", "step": "step", "tabIndex": "tabIndex"}
FLAG_ATTRIBUTES = {"isRequired": ("required",), "isDisabled": ("disabled",), "isReadonly": ("readOnly",), "isMultiple": ("multiple",), "isChecked": ("checked", "defaultChecked")}


def jsx_elements(files: DataFrame, components: tuple[str, ...] = ("TextField", "Button", "Select", "Checkbox")) -> DataFrame:
    """(path, text) to one row for each UI element: componentName, filePath, tag, its attributes, state, constraints, parent and lineNumber.

    An attribute is read if it is a literal, alone or in braces; a flag holds if it stands alone or is {true}. An
    element is dynamic inside the callback of map, filter or forEach. Its parent is the innermost element open there.
    """
    names = frozenset([*NATIVE_TAGS[:5], *components])
    text_names, number_names, flags = TEXT_ATTRIBUTES, NUMBER_ATTRIBUTES, FLAG_ATTRIBUTES
    token = re.compile(r"<(/?)([A-Za-z][\w.]*)((?:\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\}|\"[^\"]*\"|'[^']*'|[^<>{}\"'])*?)(/?)>", re.S)
    attribute = re.compile(r"([A-Za-z_][\w:-]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\}))?", re.S)
    columns = ["componentName", "filePath", "tag", *text_names, *number_names, *flags, "isHidden", "isDynamic", "parentScopeTag", "parentScopeClass", "parentScopeId", "lineNumber"]

    def literal(raw: str | None) -> str | None:
        """The text of a string, or of a string, number or truth value in braces."""
        if raw is None:
            return None
        bare = raw[1:-1].strip() if raw[0] == "{" else raw
        if bare[:1] in ("'", '"', "`") and bare[-1:] == bare[:1] and len(bare) > 1 and "${" not in bare:
            return bare[1:-1]
        return bare if re.fullmatch(r"-?\d+(?:\.\d+)?|true|false", bare) else None

    def elements(path: str, text: str) -> Iterator[dict]:
        stack: list[tuple[str, dict]] = []
        loops = [(m.end(), closing(text, m.end())) for m in re.finditer(r"\.(?:map|filter|forEach)\s*\(", text)]
        for m in token.finditer(text):
            tag = m[2]
            if m[1]:
                while stack and any(t == tag for t, _ in stack):
                    if stack.pop()[0] == tag:
                        break
                continue
            given = {k: v or None for k, v in reversed(attribute.findall(m[3]))}
            value = {k: literal(v) for k, v in given.items()}
            if tag in names:
                above, of = stack[-1] if stack else ("root", {})
                row = {"componentName": re.sub(r"\.[^.]*$", "", path.rsplit("/", 1)[-1]), "filePath": path, "tag": tag, "parentScopeTag": above, "parentScopeClass": of.get("className"), "parentScopeId": of.get("id")}
                row |= {c: value.get(x) or None for c, x in text_names.items()}
                for c, x in number_names.items():
                    number = value.get(x)
                    row[c] = float(number) if number and re.fullmatch(r"-?\d+(?:\.\d+)?", number) else None
                held = lambda x: x in given and (given[x] is None or value[x] == "true")
                row |= {c: any(held(x) for x in xs) for c, xs in flags.items()}
                row["isHidden"] = value.get("type") == "hidden" or held("hidden") or value.get("aria-hidden") == "true"
                row["isDynamic"] = any(a <= m.start() < b for a, b in loops)
                row["lineNumber"] = text.count("\n", 0, m.start()) + 1
                yield row
            if not m[4] and tag not in ("input", "img", "br", "hr"):
                stack.append((tag, value))

    def closing(text: str, at: int) -> int:
        depth = 1
        while at < len(text) and depth:
            depth += (text[at] == "(") - (text[at] == ")")
            at += 1
        return at

    kinds = {c: "double" for c in number_names} | {c: "boolean" for c in [*flags, "isHidden", "isDynamic"]} | {"lineNumber": "bigint"}
    types = {"double": pa.float64(), "boolean": pa.bool_(), "bigint": pa.int64(), "string": pa.string()}
    schema = pa.schema([(c, types[kinds.get(c, "string")]) for c in columns])

    def run(found):
        for batch in found:
            texts = zip(batch.column("path"), batch.column("text"))
            for rows in batches(r for path, text in texts for r in elements(path.as_py(), text.as_py() or "")):
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], f.type) for c, f in zip(columns, schema)], schema=schema)

    return files.select("path", "text").mapInArrow(run, ", ".join(f"{c} {kinds.get(c, 'string')}" for c in columns))
