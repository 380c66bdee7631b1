"""A scanner for languages without a parser at hand: comments and strings are blanked out, rules find definitions, blocks give their
ends, and ranges give parents and callers. It covers a declared subset of each grammar; ``RULES`` says which."""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass, field

from graphloom.sources.extract.model import Import, Reference, Result, Symbol

NAME = r"[A-Za-z_$][\w$]*"
#: Words that look like calls but aren't.
KEYWORDS = frozenset(
    "if for while switch return catch function fn def func match elif else do try with and or not in is new typeof sizeof instanceof throw raise yield "
    "await async case when unless until foreach lock using guard let var const val super where select from class struct enum interface trait impl "
    "namespace module package import public private protected static final abstract override print_r defined synchronized assert".split()
)


@dataclass
class Rule:
    """A definition: the pattern's groups are name, and perhaps params, bases, ret; ``signature`` is filled from them."""

    pattern: str
    kind: str
    signature: str = "{head}"
    body: str = "block"  # block, line, or none
    parent_group: str | None = None
    scope: str = ""  # type, function or empty: what the range is for the things inside
    top: bool = False  # only outside functions
    reference: str = "inherit"


@dataclass
class Language:
    rules: list[Rule]
    imports: list[tuple[str, str]] = field(default_factory=list)  # pattern (module, name?), kind
    comments: tuple[str, ...] = (r"//[^\n]*", r"/\*.*?\*/")
    strings: tuple[str, ...] = (r'"(?:\\.|[^"\\\n])*"', r"'(?:\\.|[^'\\\n])*'")
    blocks: str = "brace"  # brace, end, indent, line
    openers: str = ""  # words that an ``end`` closes
    call: str = rf"(?<![\w$])({NAME}+(?:(?:\.|::|->|\?\.){NAME}+)*+)!?\s*\("
    caller: str = "function"  # function, type or none
    method: bool = True  # functions inside a type are methods
    doc: str = r"(?://+|/\*\*?|#+|--+|\*)\s?(.*?)\s*(?:\*/)?$"
    keywords: frozenset = KEYWORDS
    import_refs: bool = True
    calls: bool = True
    newline: bool = False  # a definition without braces ends with its line


class Text:
    def __init__(self, source: str, language: Language) -> None:
        self.source = source
        hidden = re.compile("|".join(f"(?:{p})" for p in (*language.comments, *language.strings)), re.S | re.M)
        blank = lambda m: re.sub(r"[^\n]", " ", m.group())
        self.bare = hidden.sub(blank, source)
        comments = re.compile("|".join(f"(?:{p})" for p in language.comments) or r"(?!)", re.S | re.M)
        strings = "|".join(f"(?:{p})" for p in language.strings) or r"(?!)"
        keep = re.compile(f"(?P<s>{strings})|{comments.pattern}", re.S | re.M)
        self.uncommented = keep.sub(lambda m: m.group() if m.group("s") is not None else blank(m), source)
        self.starts = [0, *(m.end() for m in re.finditer("\n", source))]
        self.rows = source.split("\n")

    def line(self, at: int) -> int:
        return bisect.bisect_right(self.starts, at)

    def col(self, at: int) -> int:
        return at - self.starts[self.line(at) - 1]

    def line_end(self, at: int) -> int:
        end = self.bare.find("\n", at)
        return len(self.bare) if end < 0 else end


OPENED = re.compile(r"\s*\{")


def _brace_end(text: Text, at: int, newline: bool = False) -> int:
    """The end of the block that opens at or after ``at``, or of the statement if a ; or blank line comes first. With ``newline`` a
    line's end outside parentheses ends the statement too, unless a brace follows."""
    bare = text.bare
    depth = paren = 0
    i = at
    while i < len(bare):
        c = bare[i]
        paren += (c == "(") - (c == ")")
        if newline and c == "\n" and not depth and paren <= 0 and not OPENED.match(bare, i):
            return i
        if c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth <= 0:
                return i + (1 if depth == 0 else 0)
        elif not depth and (c == ";" or bare.startswith("\n\n", i)):
            return i
        i += 1
    return i


def _end_end(text: Text, at: int, openers: str) -> int:
    """The end of a block closed by ``end``; openers count at the start of a statement, and ``do`` and ``then``-less forms where named."""
    depth = 1
    for m in re.compile(rf"\bend\b|{openers}", re.M).finditer(text.bare, at):
        depth += -1 if m.group() == "end" else 1
        if not depth:
            return m.end()
    return len(text.bare)


def _indent_end(text: Text, start: int) -> int:
    first = text.line(start) - 1
    head = text.bare[text.starts[first] : text.line_end(text.starts[first])]
    own = len(head) - len(head.lstrip())
    size = last = len(head)
    for at in text.starts[first + 1 :]:
        row = text.bare[at : text.line_end(at)]
        if row.strip() and len(row) - len(row.lstrip()) <= own:
            break
        size += 1 + len(row)
        if row.strip():
            last = size
    return text.starts[text.line(start) - 1] + last


def _docstring(text: Text, start: int, language: Language) -> str | None:
    """The first line of the comment block right above."""
    line = text.line(start) - 2
    found = None
    while line >= 0:
        row = text.rows[line].strip()
        m = re.match(language.doc, row)
        if not row or not m:
            break
        if m.group(1).strip():
            found = m.group(1).strip()
        line -= 1
    return found


class Ranges:
    """Ranges (begin, end, scope, symbol) sorted by begin, longer first; finds those around a place without a look at all of them: each
    range knows the one that holds it."""

    def __init__(self, ranges: list) -> None:
        self.ranges = [r for r in ranges if r[2]]
        self.begins = [r[0] for r in self.ranges]
        self.up: list[int] = []
        open_: list[int] = []
        for i, (begin, _, _, _) in enumerate(self.ranges):
            while open_ and self.ranges[open_[-1]][1] <= begin:
                open_.pop()
            self.up.append(open_[-1] if open_ else -1)
            open_.append(i)

    def around(self, begin: int, end: int) -> list:
        """The ranges that hold [begin, end), outermost first."""
        out, i = [], bisect.bisect_right(self.begins, begin) - 1
        while i >= 0:
            if end <= self.ranges[i][1] and self.ranges[i][0] <= begin < self.ranges[i][1]:
                out.append(self.ranges[i])
            i = self.up[i]
        return out[::-1]


def extract(source: str, name: str) -> Result:
    from graphloom.sources.extract.rules import LANGUAGES

    language = LANGUAGES[name]
    text, out = Text(source, language), Result()
    found: list[tuple[int, int, Rule, Symbol]] = []
    taken: set[int] = set()
    for rule in language.rules:
        for m in re.finditer(rule.pattern, text.bare, re.M):
            groups = m.groupdict()
            at = m.start("name") if groups.get("name") else m.start()
            label = text.source[at : m.end("name")] if groups.get("name") else groups.get("other") or "anonymous"
            if at in taken or label in language.keywords:
                continue
            taken.add(at)
            begin = m.start() + len(m.group()) - len(m.group().lstrip())
            if rule.body == "none" or rule.body == "line":
                end = text.line_end(m.end() - 1) if rule.body == "line" else m.end()
            elif language.blocks == "brace":
                opened = text.bare.find("{", m.start(), m.end())
                end = _brace_end(text, opened if opened >= 0 else m.end(), language.newline)
            elif language.blocks == "end":
                end = _end_end(text, m.end(), language.openers)
            else:
                end = _indent_end(text, begin)
            value = {k: " ".join((text.source[m.start(k) : m.end(k)] if v is not None else "").split()) for k, v in groups.items()}
            head = " ".join(text.source[begin : m.end()].rstrip("{:; \n\t").split())
            signature = rule.signature.format_map({"head": head, "params": "", "bases": "", "ret": "", **value, "name": label})
            symbol = Symbol(label, rule.kind, text.line(begin), text.line(max(begin, end - 1)), text.col(begin), text.col(max(begin, end)), " ".join(signature.split()).replace(" ->  ", " ") or None, _docstring(text, begin, language))
            if rule.parent_group and value.get(rule.parent_group):
                symbol.parent = value[rule.parent_group]
            found.append((begin, end, rule, symbol))
            for base in re.split(r"\s*,\s*|\s+with\s+|\s*&\s*", re.sub(r"<[^<>]*>|\([^()]*\)", "", value.get("bases", ""))):
                base = re.sub(r"^(?:public|private|protected|virtual|extends|implements)\s+", "", base.strip())
                if re.match(rf"^{NAME}(?:(?:\.|::|\\){NAME})*$", base):
                    out.references.append(Reference(base, rule.reference, text.line(begin), label))
    found.sort(key=lambda x: (x[0], -x[1]))
    ranges = [(b, e, r.scope or ("function" if r.kind in ("function", "method") else ""), s) for b, e, r, s in found if r.body == "block"]
    held_by = Ranges(ranges)
    for b, e, rule, symbol in found:
        around = [x for x in held_by.around(b, e) if x[3] is not symbol]
        inner = around[-1] if around else None
        if rule.top and any(x[2] == "function" for x in around):
            continue
        types = [x for x in around if x[2] == "type"]
        if symbol.parent is None and types:
            symbol.parent = types[-1][3].name
        if symbol.kind == "function" and language.method and inner is not None and inner[2] == "type" and inner[3].kind != "module":
            symbol.kind = "method"
        if symbol.kind != "scope":
            out.symbols.append(symbol)
    defined = {b + s.name.__len__() for b, _, _, s in found} | taken
    if language.calls:
        for m in re.finditer(language.call, text.bare, re.M):
            callee, at = m.group(1), m.start(1)
            last = re.split(r"\.|::|->", callee)[-1]
            if at in defined or callee in language.keywords or last in language.keywords or at + len(callee) - len(last) in taken:
                continue
            caller = None
            if language.caller != "none":
                held = [x for x in held_by.around(at, at + 1) if x[2] == language.caller]
                caller = held[-1][3].name if held else None
            out.references.append(Reference("".join(callee.split()), "call", text.line(at), caller))
    for pattern, kind in language.imports:
        for m in re.finditer(pattern, text.uncommented, re.M):
            groups = m.groupdict()
            for module in re.split(r"[\s,]+", groups["module"]) if groups.get("module") else []:
                module = module.strip("\"'<>;()")
                if not module:
                    continue
                line = text.line(m.start() + len(m.group()) - len(m.group().lstrip()))
                names = [n.strip() for n in re.split(r"[,{}]", groups.get("what") or "") if n.strip()]
                for n in names or [None]:
                    out.imports.append(Import(module, n, kind))
                out.symbols.append(Symbol(module, "import", line, text.line(m.end() - 1), signature=" ".join(m.group().split())))
                if language.import_refs:
                    out.references.append(Reference(module, kind if kind in ("require", "include", "use", "using") else "import", line))
    out.symbols.sort(key=lambda s: (s.start_line, s.start_col, -s.end_line))
    return out
