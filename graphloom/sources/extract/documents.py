"""Markdown, SQL definitions, GraphQL schemas, Vue components and style sheets."""

from __future__ import annotations

import re

from graphloom.sources.extract import scanner
from graphloom.sources.extract.model import Import, Reference, Result, Symbol

#: Lines of a code block up to which its text is kept.
KEPT_LINES = 20


def markdown(source: str) -> Result:
    out = Result()
    fence = None
    rows = source.split("\n")
    for i, row in enumerate(rows, 1):
        m = re.match(r"^\s{0,3}(`{3,}|~{3,})\s*([\w+#.-]*)", row)
        if fence:
            if m and m.group(1)[0] == fence[1][0] and len(m.group(1)) >= len(fence[1]) and not m.group(2):
                begin, _, lang = fence
                inner = rows[begin : i - 1]
                name = f"code_block ({lang or 'text'} - {len(inner)} lines)"
                out.symbols.append(Symbol(name, "code_block", begin, i, 0, len(row), lang or "text", "\n".join(inner) if len(inner) <= KEPT_LINES else None))
                fence = None
            continue
        if m:
            fence = (i, m.group(1), m.group(2))
            continue
        h = re.match(r"^\s{0,3}(#{1,6})\s+(.*?)\s*#*\s*$", row)
        if h:
            title = re.sub(r"[*_`~]+|\[([^\]]*)\]\([^)]*\)", lambda x: x.group(1) or "", h.group(2)).strip()
            out.symbols.append(Symbol(title, "section", i, i, 0, len(row), f"h{len(h.group(1))}"))
        for link in re.finditer(r"(?<!!)\[([^\]]+)\]\(([^)\s]+)[^)]*\)", row):
            out.symbols.append(Symbol(link.group(1), "link", i, i, link.start(), link.end(), link.group(2)))
    return out


_SQL = scanner.Language([], comments=(r"--[^\n]*", r"/\*.*?\*/"), strings=(r"'(?:''|[^'])*'",))
_ID = r'(?P<name>[\w."`\[\]]+)'


def sql(source: str) -> Result:
    text, out = scanner.Text(source, _SQL), Result()

    def add(m, kind, label, end=None, parent=None, at=None):
        name = re.sub(r'["`\[\]]', "", m.group("name"))
        begin, stop = m.start() if at is None else at, m.end() if end is None else end
        out.symbols.append(Symbol(name, kind, text.line(begin), text.line(max(begin, stop - 1)), text.col(begin), text.col(max(begin, stop)), label.format(name), parent=parent))
        return name

    create = r"\bCREATE\s+(?:OR\s+REPLACE\s+)?(?:TEMP(?:ORARY)?\s+)?(?:UNIQUE\s+)?(?:MATERIALIZED\s+)?"
    exists = r"(?:IF\s+NOT\s+EXISTS\s+)?"
    for m in re.finditer(rf"{create}TABLE\s+{exists}{_ID}\s*\(", text.bare, re.I):
        depth, i, parts, begin = 1, m.end(), [], m.end()
        while i < len(text.bare) and depth:
            c = text.bare[i]
            depth += (c == "(") - (c == ")")
            if (c == "," and depth == 1) or not depth:
                parts.append((begin, i))
                begin = i + 1
            i += 1
        table = add(m, "struct", "CREATE TABLE {}", i)
        for b, e in parts:
            column = re.match(rf"\s*{_ID}\s+(?P<type>\w+(?:\s*\([^)]*\))?)", text.bare[b:e])
            if column and not re.match(r"\s*(?:PRIMARY|FOREIGN|UNIQUE|CONSTRAINT|CHECK|KEY|INDEX)\b", text.bare[b:e], re.I):
                at = b + column.start("name")
                out.symbols.append(Symbol(re.sub(r'["`\[\]]', "", column.group("name")), "field", text.line(at), text.line(e - 1 if e > b else b), text.col(at), text.col(e), " ".join(source[at:e].split()), parent=table))
    for what, kind in (("FUNCTION", "function"), ("PROCEDURE", "function"), ("TRIGGER", "function"), ("VIEW", "type_alias"), ("INDEX", "variable")):
        for m in re.finditer(rf"{create}{what}\s+{exists}{_ID}", text.bare, re.I):
            end = text.bare.find(";", m.end())
            add(m, kind, f"CREATE {what} {{}}", len(source) if end < 0 else end)
    out.symbols.sort(key=lambda s: (s.start_line, s.start_col))
    return out


_GQL = scanner.Language([], comments=(r"#[^\n]*",), strings=(r'""".*?"""', r'"(?:\\.|[^"\\\n])*"'))


def graphql(source: str) -> Result:
    text, out = scanner.Text(source, _GQL), Result()
    kinds = {"type": "class", "interface": "interface", "input": "struct", "enum": "enum", "union": "type_alias", "scalar": "type_alias"}
    for m in re.finditer(r"^[ \t]*(?:extend\s+)?(type|interface|input|enum|union|scalar)\s+(\w+)", text.bare, re.M):
        word, name = m.groups()
        block = text.bare.find("{", m.end()) if word not in ("union", "scalar") else -1
        between = text.bare[m.end() : block] if block >= 0 else ""
        if block >= 0 and re.search(r"^[ \t]*(?:type|interface|input|enum|union|scalar|directive)\b", between, re.M):
            block = -1
        end = scanner._brace_end(text, block) if block >= 0 else text.line_end(m.end())
        out.symbols.append(Symbol(name, kinds[word], text.line(m.start(1)), text.line(end - 1), text.col(m.start(1)), text.col(end), f"{word} {name}"))
        if block >= 0:
            pattern = r"^[ \t]*(\w+)\s*(?:\([^)]*\))?\s*:" if word != "enum" else r"(?<![\w@])([A-Za-z_]\w*)"
            for f in re.finditer(pattern, text.bare[block + 1 : end - 1], re.M):
                at = block + 1 + f.start(1)
                out.symbols.append(Symbol(f.group(1), "variable" if word == "enum" else "field", text.line(at), text.line(at), text.col(at), text.col(at) + len(f.group(1)), " ".join(source[at : text.line_end(at)].split()), parent=name))
    for m in re.finditer(r"^[ \t]*directive\s+@(\w+)", text.bare, re.M):
        out.symbols.append(Symbol(m.group(1), "decorator", text.line(m.start(1)), text.line(m.start(1)), text.col(m.start(1)), text.col(m.end(1)), f"directive @{m.group(1)}"))
    out.symbols.sort(key=lambda s: (s.start_line, s.start_col))
    return out


def vue(source: str) -> Result:
    """The script by its language, its lines moved to their place in the file; the template's root tag as a class."""
    out = Result()
    script = re.search(r"<script([^>]*)>(.*?)</script>", source, re.S)
    if script:
        body = script.group(2)
        typed = re.search(r"""lang=["']ts""", script.group(1)) or re.search(r":\s*(?:string|number|boolean)\b|\binterface\s+\w+|\btype\s+\w+\s*=", body)
        out = scanner.extract(body, "typescript" if typed else "javascript")
        offset = source.count("\n", 0, script.start(2))
        for s in out.symbols:
            s.start_line += offset
            s.end_line += offset
        for r in out.references:
            r.line += offset
    template = re.search(r"<template[^>]*>\s*(?:<!--.*?-->\s*)*<([\w-]+)", source, re.S)
    if template:
        line = source.count("\n", 0, template.start(1)) + 1
        out.symbols.append(Symbol(f"<{template.group(1)}>", "class", line, line, signature=f"<{template.group(1)}>"))
    return out


_CSS = scanner.Language([], comments=(r"/\*.*?\*/", r"(?<!:)//[^\n]*"))


def css(source: str) -> Result:
    text, out = scanner.Text(source, _CSS), Result()
    for m in re.finditer(r"(?:^|(?<=[{};]))\s*([^{};@][^{};]*?)\s*\{", text.bare):
        end = scanner._brace_end(text, m.end() - 1)
        name = " ".join(source[m.start(1) : m.end(1)].split())
        if re.fullmatch(r"(?:from|to|\d+(?:\.\d+)?%)(?:\s*,\s*\S+)*", name):
            continue
        out.symbols.append(Symbol(name, "class", text.line(m.start(1)), text.line(end - 1), text.col(m.start(1)), text.col(end), name))
    for m in re.finditer(r"@(?:-\w+-)?keyframes\s+([\w-]+)\s*\{", text.bare):
        end = scanner._brace_end(text, m.end() - 1)
        out.symbols.append(Symbol(m.group(1), "function", text.line(m.start()), text.line(end - 1), text.col(m.start()), text.col(end), f"@keyframes {m.group(1)}"))
    for m in re.finditer(r"@(?:import|use|forward)\s+(?:url\()?[\"']([^\"']+)[\"']", text.uncommented):
        out.imports.append(Import(m.group(1), None, "import"))
    out.symbols.sort(key=lambda s: (s.start_line, s.start_col))
    return out


def bash(source: str) -> Result:
    """Definitions by rule; every command as a reference, its whole text and its bare name."""
    out = scanner.extract(source, "bash")
    from graphloom.sources.extract.rules import LANGUAGES

    text = scanner.Text(source, LANGUAGES["bash"])
    words = frozenset("if then else elif fi for while until do done case esac function in return local export readonly declare source { } [ [[ ]] ! time select".split())
    for m in re.finditer(r"(?:^|[;|&]|\bthen\b|\bdo\b|\belse\b|\$\()[ \t]*([A-Za-z_./][\w./-]*)(?![\w./-]*[=(])([^\n;|&)]*)", text.bare, re.M):
        name = m.group(1)
        if name in words or name == ".":
            continue
        line = text.line(m.start(1))
        whole = " ".join(source[m.start(1) : m.end()].split())
        out.references += [Reference(x, "command", line) for x in dict.fromkeys((whole, name))]
    return out
