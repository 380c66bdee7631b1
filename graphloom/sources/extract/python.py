"""Python, by its own grammar."""

from __future__ import annotations

import ast

from graphloom.sources.extract.model import Import, Literal, Reference, Result, Symbol


def _dotted(node: ast.AST) -> str:
    return ast.unparse(node)


class _Walk(ast.NodeVisitor):
    def __init__(self, source: str) -> None:
        self.source, self.out = source, Result()
        self.classes: list[str] = []
        self.functions: list[str] = []
        self.inside: list[str] = []  # "class" or "function", innermost last
        self.docs: set[int] = set()
        self.context = "unknown"

    def symbol(self, node, name, kind, signature=None, doc=None, parent=None) -> None:
        self.out.symbols.append(Symbol(name, kind, node.lineno, node.end_lineno, node.col_offset, node.end_col_offset, signature, doc, parent))

    def note_docstring(self, node) -> str | None:
        doc = ast.get_docstring(node, clean=True)
        if doc is not None:
            self.docs.add(id(node.body[0].value))
            return doc.strip().split("\n")[0] or None
        return None

    def visit_Module(self, node):
        self.note_docstring(node)
        self.generic_visit(node)

    def _function(self, node):
        method = bool(self.inside) and self.inside[-1] == "class"
        word = "async def" if isinstance(node, ast.AsyncFunctionDef) else "def"
        returns = f" -> {_dotted(node.returns)}" if node.returns else ""
        doc = self.note_docstring(node)
        self.symbol(node, node.name, "method" if method else "function", f"{word} {node.name}({ast.unparse(node.args)}){returns}", doc, self.classes[-1] if self.classes else None)
        for d in node.decorator_list:
            self.visit(d)
        for part in (node.args, node.returns):
            if part is not None:
                self.visit(part)
        self.functions.append(node.name)
        self.inside.append("function")
        for child in node.body:
            self.visit(child)
        self.inside.pop()
        self.functions.pop()

    visit_FunctionDef = visit_AsyncFunctionDef = _function

    def visit_ClassDef(self, node):
        bases = [_dotted(b) for b in node.bases]
        doc = self.note_docstring(node)
        self.symbol(node, node.name, "class", f"class {node.name}({', '.join(bases)})" if bases else f"class {node.name}", doc, self.classes[-1] if self.classes else None)
        self.out.references += [Reference(b, "inherit", node.lineno, node.name) for b in bases]
        for d in (*node.decorator_list, *node.keywords):
            self.visit(d)
        self.classes.append(node.name)
        self.inside.append("class")
        for child in node.body:
            self.visit(child)
        self.inside.pop()
        self.classes.pop()

    def visit_Import(self, node):
        for a in node.names:
            self._imported(node, a.name, a.asname, "import", a.name)

    def visit_ImportFrom(self, node):
        module = "." * node.level + (node.module or "")
        for a in node.names:
            self._imported(node, module, a.asname or a.name, "from", f"{module}.{a.name}" if module.strip(".") else module + a.name)

    def _imported(self, node, module, name, kind, target):
        self.symbol(node, name or module, "import", ast.unparse(node))
        self.out.imports.append(Import(module, name, kind))
        self.out.references.append(Reference(target, "import", node.lineno))

    def _assigned(self, node, targets):
        if not self.inside:
            for t in targets:
                for name in ast.walk(t):
                    if isinstance(name, ast.Name):
                        self.symbol(node, name.id, "variable", ast.unparse(node).split("\n")[0])
        before, self.context = self.context, "assignment_rhs"
        if node.value is not None:
            self.visit(node.value)
        self.context = before

    def visit_Assign(self, node):
        self._assigned(node, node.targets)

    def visit_AnnAssign(self, node):
        self._assigned(node, [node.target])

    def visit_Call(self, node):
        if not isinstance(node.func, ast.Call):
            self.out.references.append(Reference(_dotted(node.func), "call", node.lineno, self.functions[-1] if self.functions else None))
        self.visit(node.func)
        for group, context in ((node.args, "function_arg"), (node.keywords, "kwarg")):
            before, self.context = self.context, context
            for a in group:
                self.visit(a)
            self.context = before

    def _sequence(self, node):
        before, self.context = self.context, "sequence_element"
        self.generic_visit(node)
        self.context = before

    visit_List = visit_Tuple = _sequence

    def visit_JoinedStr(self, node):
        for v in node.values:
            if isinstance(v, ast.FormattedValue):
                self.visit(v.value)

    def visit_Constant(self, node):
        if isinstance(node.value, str) and id(node) not in self.docs:
            self.out.literals.append(Literal(node.value, node.lineno, node.col_offset, self.context, self.functions[-1] if self.functions else None))


def extract(source: str) -> Result:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError) as e:
        from graphloom.sources.extract import scanner

        out = scanner.extract(source, "python")
        out.error = str(e)
        return out
    walk = _Walk(source)
    walk.visit(tree)
    return walk.out
