"""Each language's extractor on a small text: names, kinds, parents, callers, imports and lines."""

import pytest

from graphloom.sources.extract import registry

# language: (source, {(name, kind, parent)}, {(caller, callee, kind)}, {imported modules})
CASES = {
    "python": (
        'import os\nfrom sys import path as p\nLIMIT = 3\n\nclass Dog(Animal, mixins.Loud):\n    """A dog."""\n    size = 1\n    def bark(self, n: int = 1) -> str:\n        """Bark."""\n        return self.voice.say("Dog.Sound")\n\nasync def main():\n    Dog().bark()\n    load(["a.b"], key="X")\n',
        {("Dog", "class", None), ("bark", "method", "Dog"), ("main", "function", None), ("LIMIT", "variable", None), ("os", "import", None), ("p", "import", None)},
        {("Dog", "Animal", "inherit"), ("Dog", "mixins.Loud", "inherit"), ("bark", "self.voice.say", "call"), ("main", "Dog", "call"), ("main", "load", "call"), (None, "os", "import"), (None, "sys.path", "import")},
        {"os", "sys"},
    ),
    "javascript": (
        "import React, { useState } from 'react';\nconst fs = require('fs');\n\nasync function load(url) {\n  return fetch(url); // fetch(no)\n}\n\nclass Dog extends Animal {\n  constructor(name) {\n    super(name);\n  }\n  bark(times) {\n    say('call(me)');\n  }\n}\nconst add = (a, b) => {\n  return sum(a, b);\n};\nexport default App;\n",
        {("load", "function", None), ("Dog", "class", None), ("constructor", "method", "Dog"), ("bark", "method", "Dog"), ("add", "variable", None), ("fs", "variable", None), ("App", "export", None)},
        {("Dog", "Animal", "inherit"), ("load", "fetch", "call"), ("bark", "say", "call"), ("add", "sum", "call"), (None, "react", "import")},
        {"react", "fs"},
    ),
    "typescript": (
        "import { Foo } from './foo';\nexport interface Config {\n  name: string;\n}\ntype Result<T> = T | null;\nenum Direction { Up, Down }\nexport class Cat extends Animal {\n  private async find(id: string): Promise<Cat> {\n    return query(id);\n  }\n}\nexport function greet(name: string): string {\n  return format(name);\n}\n",
        {("Config", "class", None), ("Result", "class", None), ("Direction", "enum", None), ("Cat", "class", None), ("find", "method", "Cat"), ("greet", "function", None)},
        {("Cat", "Animal", "inherit"), ("find", "query", "call"), ("greet", "format", "call"), (None, "./foo", "import")},
        {"./foo"},
    ),
    "rust": (
        "use std::io::Read;\n\npub struct User { name: String }\n\nenum Status {\n    Active,\n    Gone(u32),\n}\n\ntrait Drawable { fn draw(&self); }\n\nimpl Drawable for User {\n    fn draw(&self) -> i32 {\n        render(&self.name)\n    }\n}\n\npub fn hello(name: &str) -> String {\n    format_name(name)\n}\ntype Id = u64;\n",
        {("User", "class", None), ("Status", "enum", None), ("Active", "variable", "Status"), ("Gone", "variable", "Status"), ("Drawable", "class", None), ("draw", "method", "User"), ("hello", "function", None), ("Id", "variable", None)},
        {("User", "Drawable", "implement"), ("draw", "render", "call"), ("hello", "format_name", "call")},
        {"std::io::Read"},
    ),
    "go": (
        'package main\n\nimport (\n\t"fmt"\n\t"os"\n)\n\ntype Counter struct {\n\tn int\n}\n\nfunc (c *Counter) Inc(by int) int {\n\treturn add(c.n, by)\n}\n\nfunc Hello(name string) string {\n\treturn fmt.Sprintf("hi %s", name)\n}\nvar Limit = 3\n',
        {("Counter", "class", None), ("Inc", "method", "Counter"), ("Hello", "function", None), ("Limit", "variable", None)},
        {("Inc", "add", "call"), ("Hello", "fmt.Sprintf", "call"), (None, "fmt", "import"), (None, "os", "import")},
        {"fmt", "os"},
    ),
    "ruby": (
        "require 'json'\n\nmodule Zoo\n  class Dog < Animal\n    def bark(times)\n      if times > 1\n        puts(times)\n      end\n    end\n\n    def sit\n      rest()\n    end\n  end\nend\n",
        {("Zoo", "module", None), ("Dog", "class", "Zoo"), ("bark", "function", "Dog"), ("sit", "function", "Dog")},
        {("Dog", "Animal", "inherit"), (None, "puts", "call"), (None, "rest", "call"), (None, "json", "require")},
        {"json"},
    ),
    "java": (
        "package a.b;\nimport java.util.List;\n\npublic class Greeter extends Base {\n    private int size = 1;\n    public Greeter(String n) {\n        setup(n);\n    }\n    public String greet(String name) {\n        return name.trim();\n    }\n}\ninterface Shape { double area(); }\nenum Color { RED }\n",
        {("Greeter", "class", None), ("greet", "method", "Greeter"), ("size", "variable", "Greeter"), ("Shape", "class", None), ("Color", "enum", None)},
        {("Greeter", "Base", "inherit"), ("greet", "name.trim", "call"), (None, "java.util.List", "import")},
        {"java.util.List"},
    ),
    "php": (
        "<?php\nuse App\\Model;\n\nclass Dog extends Animal {\n    public $name = 'x';\n    function bark($n) {\n        return shout($n);\n    }\n}\nfunction hello($name) {\n    return strtoupper($name);\n}\n",
        {("Dog", "class", None), ("bark", "method", "Dog"), ("$name", "variable", "Dog"), ("hello", "function", None)},
        {("Dog", "Animal", "inherit"), (None, "shout", "call"), (None, "strtoupper", "call")},
        {"App\\Model"},
    ),
    "julia": (
        "module Geo\nusing LinearAlgebra\n\nabstract type Shape end\nstruct Circle <: Shape\n    r\nend\n\nfunction area(c)\n    return power(c.r, 2)\nend\n\nmacro twice(x)\n    x\nend\nend\n",
        {("Geo", "module", None), ("Shape", "class", "Geo"), ("Circle", "class", "Geo"), ("area", "function", "Geo"), ("twice", "decorator", "Geo")},
        {("Circle", "Shape", "inherit"), (None, "power", "call")},
        {"LinearAlgebra"},
    ),
    "lua": (
        "local json = require('json')\n\nfunction greet(name)\n  if name then\n    print(name)\n  end\nend\n\nlocal function add(a, b)\n  return plus(a, b)\nend\nlimit = 3\n",
        {("greet", "function", None), ("add", "function", None), ("limit", "variable", None), ("json", "variable", None)},
        {("greet", "print", "call"), ("add", "plus", "call"), (None, "json", "require")},
        {"json"},
    ),
    "swift": (
        "import Foundation\n\nclass Dog: Animal {\n    var name: String\n    func bark(times: Int) {\n        voice.shout(times)\n    }\n}\nstruct Point { }\nenum Side { case left }\nfunc hello() { print(1) }\n",
        {("Dog", "class", None), ("name", "variable", "Dog"), ("bark", "function", "Dog"), ("Point", "class", None), ("Side", "enum", None), ("hello", "function", None)},
        {("Dog", "Animal", "inherit"), (None, "shout", "call"), (None, "print", "call"), (None, "Foundation", "import")},
        {"Foundation"},
    ),
    "zig": (
        'const std = @import("std");\n\nconst User = struct {\n    id: u32,\n    fn name(self: User) u8 {\n        return lookup(self.id);\n    }\n};\nconst Mode = enum { on, off };\npub fn add(a: i32, b: i32) i32 {\n    return a + b;\n}\n',
        {("User", "class", None), ("name", "function", "User"), ("Mode", "enum", None), ("add", "function", None)},
        {(None, "lookup", "call"), (None, "std", "import")},
        {"std"},
    ),
    "scala": (
        "import scala.util.Try\n\nclass Repo(db: Db) extends Base {\n  val size = 1\n  def find(id: Int) = {\n    db.findById(id)\n  }\n}\nobject Main { def run() = start(1) }\ntrait Shape\n",
        {("Repo", "class", None), ("size", "variable", "Repo"), ("find", "function", "Repo"), ("Main", "module", None), ("run", "function", "Main"), ("Shape", "class", None)},
        {("Repo", "Base", "inherit"), ("Repo", "findById", "call"), ("Main", "start", "call")},
        {"scala.util.Try"},
    ),
    "elixir": (
        "defmodule MyApp.Math do\n  use GenServer\n  require Logger\n\n  def add(a, b) do\n    Enum.sum([a, b])\n  end\n\n  defp hidden(x) do\n    twice(x)\n  end\nend\n",
        {("MyApp.Math", "module", None), ("add", "function", "MyApp.Math"), ("hidden", "function", "MyApp.Math")},
        {(None, "Enum.sum", "call"), (None, "twice", "call"), (None, "GenServer", "use"), (None, "Logger", "require")},
        {"GenServer", "Logger"},
    ),
    "dart": (
        "import 'dart:io';\n\nclass Dog extends Animal {\n  void bark(int n) {\n    shout(n);\n  }\n}\nmixin Loud { }\nenum Size { big }\nint add(int a, int b) {\n  return a + b;\n}\n",
        {("Dog", "class", None), ("bark", "function", "Dog"), ("Loud", "class", None), ("Size", "enum", None), ("add", "function", None)},
        {("Dog", "Animal", "inherit"), (None, "shout", "call"), (None, "dart:io", "import")},
        {"dart:io"},
    ),
    "haskell": (
        "module Main where\nimport Data.List (sort)\n\ndata User = User String\ntype Name = String\n\ngreet :: String -> String\ngreet name = concat [\"hi \", name]\n\nmain = putStrLn (greet \"x\")\n",
        {("User", "class", None), ("Name", "type_alias", None), ("greet", "function", None)},
        {(None, "concat", "call"), (None, "putStrLn", "call"), (None, "Data.List", "import")},
        {"Data.List"},
    ),
    "c": (
        '#include <stdio.h>\n#include "own.h"\n\nstruct user {\n    int id;\n};\ntypedef unsigned int word;\nenum mode { ON, OFF };\n\nstatic int add(int a, int b) {\n    return plus(a, b);\n}\n',
        {("user", "class", None), ("word", "type_alias", None), ("mode", "enum", None), ("add", "function", None)},
        {("add", "plus", "call"), (None, "stdio.h", "include")},
        {"stdio.h", "own.h"},
    ),
    "cpp": (
        "#include <vector>\nusing namespace std;\n\nnamespace zoo {\nclass Dog : public Animal {\npublic:\n    int bark(int n) {\n        return shout(n);\n    }\n};\n}\nint main() {\n    return zoo::run();\n}\n",
        {("zoo", "module", None), ("Dog", "class", "zoo"), ("bark", "method", "Dog"), ("main", "function", None)},
        {("Dog", "Animal", "inherit"), ("bark", "shout", "call"), ("main", "zoo::run", "call"), (None, "vector", "include"), (None, "std", "using")},
        {"vector", "std"},
    ),
    "kotlin": (
        "import a.b.C\n\nclass Dog(val n: Int) : Animal {\n    val name = \"x\"\n    fun bark(times: Int): Int {\n        return shout(times)\n    }\n}\ndata class Point(val x: Int)\nenum class Side { LEFT }\ninterface Shape\nobject Single { }\nfun hello() { println(1) }\n",
        {("Dog", "class", None), ("name", "field", "Dog"), ("bark", "method", "Dog"), ("Point", "struct", None), ("Side", "enum", None), ("Shape", "interface", None), ("Single", "class", None), ("hello", "function", None)},
        {("Dog", "Animal", "inherit")},
        {"a.b.C"},
    ),
    "csharp": (
        "using System.Linq;\n\nnamespace Zoo {\n    public class Dog : Animal {\n        private int size = 1;\n        public string Name { get; set; }\n        public Dog(int n) { Setup(n); }\n        public int Bark(int times) {\n            return Shout(times);\n        }\n    }\n    interface IShape { }\n    struct Point { }\n    enum Side { Left }\n}\n",
        {("Zoo", "module", None), ("Dog", "class", "Zoo"), ("size", "variable", "Dog"), ("Name", "field", "Dog"), ("Bark", "method", "Dog"), ("IShape", "interface", "Zoo"), ("Point", "struct", "Zoo"), ("Side", "enum", "Zoo")},
        {("Dog", "Animal", "inherit"), ("Bark", "Shout", "call"), (None, "System.Linq", "using")},
        {"System.Linq"},
    ),
    "bash": (
        "#!/bin/bash\nsource ./lib.sh\nexport NAME=1\ngreet() {\n  echo \"hi $1\"\n}\nfunction bye {\n  ls -l\n}\ngreet you\n",
        {("greet", "function", None), ("bye", "function", None), ("NAME", "variable", None)},
        {(None, "echo", "command"), (None, "ls -l", "command"), (None, "ls", "command"), (None, "greet you", "command")},
        {"./lib.sh"},
    ),
    "markdown": (
        "# A *fine* title\n\nSee [docs](http://x.y/z).\n\n```python\nprint(1)\n```\n## Second ##\n",
        {("A fine title", "section", None), ("docs", "link", None), ("code_block (python - 1 lines)", "code_block", None), ("Second", "section", None)},
        set(),
        set(),
    ),
    "sql": (
        "CREATE TABLE users (\n  id INT PRIMARY KEY,\n  name VARCHAR(10),\n  FOREIGN KEY (id) REFERENCES t(id)\n);\nCREATE VIEW v AS SELECT 1;\nCREATE UNIQUE INDEX idx ON users(id);\nCREATE FUNCTION f() RETURNS int AS 'x';\n",
        {("users", "struct", None), ("id", "field", "users"), ("name", "field", "users"), ("v", "type_alias", None), ("idx", "variable", None), ("f", "function", None)},
        set(),
        set(),
    ),
    "graphql": (
        "type User implements Node {\n  id: ID!\n  posts(first: Int): [Post]\n}\nenum Role { ADMIN USER }\ninput New { name: String }\nunion Any = User | Post\nscalar Date\ndirective @auth on FIELD\n",
        {("User", "class", None), ("id", "field", "User"), ("posts", "field", "User"), ("Role", "enum", None), ("ADMIN", "variable", "Role"), ("New", "struct", None), ("Any", "type_alias", None), ("Date", "type_alias", None), ("auth", "decorator", None)},
        set(),
        set(),
    ),
    "vue": (
        "<template>\n  <main-view>\n  </main-view>\n</template>\n<script>\nimport x from 'x';\nfunction load() {\n  go(1);\n}\n</script>\n",
        {("<main-view>", "class", None), ("load", "function", None)},
        {("load", "go", "call")},
        {"x"},
    ),
    "css": (
        "@import 'base.css';\n.card, #top > a {\n  color: red;\n}\n@keyframes spin { from { top: 0 } to { top: 1px } }\n",
        {(".card, #top > a", "class", None), ("spin", "function", None)},
        set(),
        {"base.css"},
    ),
}


@pytest.mark.parametrize("language", CASES)
def test_snippet(language):
    source, symbols, references, imports = CASES[language]
    out = registry.run(source, language)
    assert out.error is None
    assert symbols <= {(s.name, s.kind, s.parent) for s in out.symbols}, out.symbols
    assert references <= {(r.caller, r.callee, r.kind) for r in out.references}, out.references
    assert imports <= {i.module for i in out.imports}, out.imports
    rows = source.split("\n")
    for s in out.symbols:
        assert 1 <= s.start_line <= s.end_line <= len(rows)
    if language not in ("markdown", "sql", "graphql", "css", "vue"):
        assert not {r.callee for r in out.references} & {"no", "me", "if", "for", "while"}


def test_every_language_has_an_extractor():
    from graphloom.functions.language import CANONICAL

    assert set(registry.EXTRACTORS) == set(CANONICAL)


def test_lines_and_docs():
    out = registry.run("// Adds.\nfunction add(a) {\n  return a;\n}\n\nfunction two() {}\n", "javascript")
    one = next(s for s in out.symbols if s.name == "add")
    assert (one.start_line, one.end_line, one.docstring, one.signature) == (2, 4, "Adds.", "function add(a)")
    py = registry.run(CASES["python"][0], "python")
    bark = next(s for s in py.symbols if s.name == "bark")
    assert (bark.start_line, bark.end_line, bark.docstring, bark.signature) == (8, 10, "Bark.", "def bark(self, n: int=1) -> str")
    assert {(x.value, x.context, x.parent_fn) for x in py.literals} == {("Dog.Sound", "function_arg", "bark"), ("a.b", "sequence_element", "main"), ("X", "kwarg", "main")}


def test_broken_text_still_gives_rows():
    out = registry.run("def ok(a):\n    return 1\n\ndef broken(:\n", "python")
    assert out.error and "ok" in {s.name for s in out.symbols}
    for language in registry.EXTRACTORS:
        for text in ("", "{{{", "}}}", "((", '"""', "\x00퟿", "end end end", "a" * 10_000):
            assert registry.run(text, language) is not None


def test_tables_and_reindex(spark, tmp_path):

    from graphloom.sources import scan

    (tmp_path / "pkg").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "pkg" / "a.py").write_text("def f():\n    g()\n    g()\n\ng()\ng()\n")
    (tmp_path / "pkg" / "b.js").write_text("function g() { f(); }\n")
    (tmp_path / "node_modules" / "c.js").write_text("function no() {}\n")
    (tmp_path / "pkg" / "notes.xyz").write_text("none")
    files = scan.scan(spark, str(tmp_path))
    assert {r.path for r in files.collect()} == {"pkg/a.py", "pkg/b.js"}
    out = registry.index(files)
    assert {(r.name, r.qualified_name, r.language) for r in out["symbols"].collect()} == {("f", "pkg.a.f", "python"), ("g", "pkg.b.g", "javascript")}
    assert out["symbols"].where("token_count <= 0").count() == 0
    assert sorted((r.caller_symbol or "", r.callee_symbol, r.line) for r in out["refs"].collect()) == [("", "g", 5), ("", "g", 6), ("f", "g", 2), ("f", "g", 3), ("g", "f", 1)]
    stored = {k: spark.createDataFrame(v.collect(), v.schema) for k, v in out.items()}
    (tmp_path / "pkg" / "a.py").write_text("def h():\n    pass\n")
    (tmp_path / "pkg" / "b.js").unlink()
    after = registry.reindex(stored, scan.scan(spark, str(tmp_path)))
    assert {(r.name, r.file_path) for r in after["symbols"].collect()} == {("h", "pkg/a.py")}
    assert after["refs"].count() == 0 and after["files"].count() == 1
    registry.register_udtf(spark)
    assert spark.sql("SELECT name FROM extract_symbols('def q(): pass', 'python')").first()[0] == "q"


def test_scan_sees_every_name_and_opens_no_skipped_file(spark, tmp_path):
    from graphloom.sources import scan

    for at in ("a.py", "__init__.py", "_private/c.py", "__pkg/b.py", "pkg/__main__.py", "node_modules/big.js", "with space/d%20e.py", "notes.xyz"):
        (tmp_path / at).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / at).write_text(f"# {at}\n")
    (tmp_path / "node_modules/big.js").chmod(0)
    rows = {r.path: r.text for r in scan.scan(spark, str(tmp_path)).collect()}
    want = {"a.py", "__init__.py", "_private/c.py", "__pkg/b.py", "pkg/__main__.py"}
    assert want <= set(rows) and not any("node_modules" in p or p.endswith("xyz") for p in rows)
    assert all(rows[p] == f"# {p}\n" for p in want)


def test_long_files_take_linear_time():
    import time

    from graphloom.sources.extract import scanner

    def took(n):
        source = "".join(f"// step {i}\nfunction f{i}(a) {{\n  return f{max(0, i - 1)}(a);\n}}\n" for i in range(n))
        began = time.time()
        out = scanner.extract(source, "javascript")
        assert sum(s.kind == "function" for s in out.symbols) == n
        assert {r.caller for r in out.references if r.kind == "call"} == {f"f{i}" for i in range(n)}
        return time.time() - began

    took(200)
    assert took(8000) < 10 * max(took(2000), 0.02)
