"""Definition rules of each scanned language."""

from __future__ import annotations

from graphloom.sources.extract.scanner import KEYWORDS, NAME, Language, Rule

C_COMMENTS = (r"//[^\n]*", r"/\*.*?\*/")
HASH = (r"#[^\n]*",)
DQ = r'"(?:\\.|[^"\\\n])*"'
SQ = r"'(?:\\.|[^'\\\n])*'"
CHAR = r"'(?:\\[^']*|[^'\\])'"
TICK = r"`(?:\\.|[^`\\])*`"
PARAMS = r"\((?P<params>[^()]*(?:\([^()]*\)[^()]*)*)\)"
GENERIC = r"(?:\s*<[^<>{}()]*(?:<[^<>]*>[^<>]*)*>)?"
MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|async|override|virtual|sealed|open|partial|readonly|extern|unsafe|new|default|inline|suspend|external|data|inner|lateinit|const|mutating|fileprivate|required|convenience)\s+)*"

_JS_FUNCTION = Rule(rf"(?:^|(?<=[\s;(=:]))(?:async\s+)?function\s*\*?\s*(?P<name>{NAME}){GENERIC}\s*{PARAMS}", "function", "function {name}({params})", scope="function")
_JS_CLASS = Rule(rf"\bclass\s+(?P<name>{NAME}){GENERIC}(?:\s+extends\s+(?P<bases>[\w$.]+){GENERIC})?(?:\s+implements\s+[\w$.,\s<>]+)?\s*\{{", "class", "{head}", scope="type")
_JS_METHOD = Rule(rf"^[ \t]+(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*\*?\s*(?P<name>[#]?{NAME}){GENERIC}\s*{PARAMS}(?:\s*:\s*[^{{}};=\n]+)?\s*\{{", "method", "{name}({params})", scope="function")
_JS_ARROW = Rule(rf"^[ \t]*(?:export\s+)?(?:const|let|var)\s+(?P<name>{NAME})(?:\s*:[^=\n]+)?\s*=\s*(?:async\s*)?(?:\([^()]*(?:\([^()]*\)[^()]*)*\)|{NAME})(?:\s*:[^=\n]+)?\s*=>", "variable", "{head}", scope="function")
_JS_VARIABLE = Rule(rf"^[ \t]*(?:export\s+)?(?:const|let|var)\s+(?P<name>{NAME})(?:\s*:[^=\n]+)?\s*=", "variable", "{head}", body="line")
_JS_EXPORTS = [
    Rule(rf"^[ \t]*export\s+default\s+(?:async\s+)?(?!function\b|class\b)(?P<name>{NAME})\s*;?$", "export", "export default {name}", body="line"),
    Rule(rf"^[ \t]*export\s*\{{\s*(?P<name>{NAME})[^}}\n]*\}}", "export", "{head}", body="line"),
]
_JS_IMPORTS = [
    (r"^[ \t]*import\s+(?:type\s+)?(?P<what>[^;'\"]+?)\s+from\s+(?P<module>['\"][^'\"]+['\"])", "import"),
    (r"^[ \t]*import\s+(?P<module>['\"][^'\"]+['\"])", "import"),
    (r"\brequire\(\s*(?P<module>['\"][^'\"]+['\"])\s*\)", "require"),
]
_JS = {"imports": _JS_IMPORTS, "strings": (DQ, SQ, TICK)}

LANGUAGES: dict[str, Language] = {
    "javascript": Language([_JS_FUNCTION, _JS_CLASS, _JS_METHOD, *_JS_EXPORTS, _JS_ARROW, _JS_VARIABLE], **_JS),
    "typescript": Language(
        [
            _JS_FUNCTION, _JS_CLASS,
            Rule(rf"\binterface\s+(?P<name>{NAME}){GENERIC}(?:\s+extends\s+(?P<bases>[\w$.,\s]+))?\s*\{{", "class", "interface {name}", scope="type"),
            Rule(rf"^[ \t]*(?:export\s+)?(?:declare\s+)?type\s+(?P<name>{NAME}){GENERIC}\s*=", "class", "type {name}", body="line"),
            Rule(rf"\benum\s+(?P<name>{NAME})\s*\{{", "enum", "enum {name}", scope="type"),
            Rule(rf"^[ \t]*(?:export\s+)?(?:declare\s+)?(?:module|namespace)\s+(?P<name>[\w$.]+)\s*\{{", "module", "module {name}", scope="type"),
            _JS_METHOD, *_JS_EXPORTS,
            Rule(rf"^[ \t]*export\s+(?:interface|type|enum|(?:abstract\s+)?class|(?:async\s+)?function|const|let)\s+(?P<other>)(?={NAME})", "scope", body="none"),
            _JS_ARROW, _JS_VARIABLE,
        ],
        **_JS,
    ),
    "python": Language(
        [
            Rule(rf"^[ \t]*(?:async\s+)?def\s+(?P<name>{NAME})\s*{PARAMS}", "function", "def {name}({params})", scope="function"),
            Rule(rf"^[ \t]*class\s+(?P<name>{NAME})(?:\((?P<bases>[^()]*)\))?", "class", "{head}", scope="type"),
            Rule(rf"^(?P<name>{NAME})\s*(?::[^=\n]+)?=(?!=)", "variable", "{head}", body="line"),
        ],
        [(r"^[ \t]*import\s+(?P<module>[\w.]+)", "import"), (r"^[ \t]*from\s+(?P<module>[\w.]+)\s+import\s+(?P<what>[^\n#]+)", "from")],
        HASH, (r'"""(?:\\.|[^\\])*?"""', r"'''(?:\\.|[^\\])*?'''", DQ, SQ), "indent",
    ),
    "rust": Language(
        [
            Rule(rf"\bfn\s+(?P<name>{NAME}){GENERIC}\s*{PARAMS}(?:\s*->\s*(?P<ret>[^{{;]+?))?(?=\s*(?:where\b[^{{]*)?[{{;])", "function", "fn {name}({params}) -> {ret}", scope="function"),
            Rule(rf"\bstruct\s+(?P<name>{NAME})", "class", "struct {name}", scope="type"),
            Rule(rf"\benum\s+(?P<name>{NAME}){GENERIC}\s*\{{", "enum", "enum {name}", scope="type"),
            Rule(rf"\btrait\s+(?P<name>{NAME})", "class", "trait {name}", scope="type"),
            Rule(rf"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?type\s+(?P<name>{NAME}){GENERIC}\s*=", "variable", "{head}", body="line"),
            Rule(rf"\bimpl{GENERIC}\s+(?:(?P<bases>[\w:]+){GENERIC}\s+for\s+)(?P<name>{NAME})", "scope", scope="type", reference="implement"),
            Rule(rf"\bimpl{GENERIC}\s+(?P<name>{NAME}){GENERIC}\s*(?:where\b[^{{]*)?\{{", "scope", scope="type"),
            Rule(rf"^[ \t]+(?P<name>[A-Z]\w*)\s*(?:\([^()\n]*\)|=\s*\d+)?,?[ \t]*$", "variable", "{name}", body="none"),
        ],
        [(r"^[ \t]*(?:pub\s+)?use\s+(?P<module>[\w:]+(?:::\{[^}]*\})?(?:::\*)?)", "use")],
        C_COMMENTS, (r'r?#*"(?:\\.|[^"\\])*"#*', CHAR),
    ),
    "go": Language(
        [
            Rule(rf"^func\s+\(\s*\w*\s*\*?(?P<owner>\w+)[^)]*\)\s*(?P<name>{NAME})\s*{PARAMS}\s*(?P<ret>[^{{\n]*)", "method", "func {name}({params}) {ret}", parent_group="owner", scope="function"),
            Rule(rf"^func\s+(?P<name>{NAME})(?:\[[^\]]*\])?\s*{PARAMS}\s*(?P<ret>[^{{\n]*)", "function", "func {name}({params}) {ret}", scope="function"),
            Rule(rf"^(?:type\s+|\t)(?P<name>{NAME})\s+(?:struct|interface)\s*\{{", "class", "{head}", scope="type"),
            Rule(rf"^type\s+(?P<name>{NAME})\s+\S", "variable", "{head}", body="line"),
            Rule(rf"^(?:var|const)\s+(?P<name>{NAME})", "variable", "{head}", body="line", top=True),
        ],
        [(r"^import\s+(?:\w+\s+|\.\s+|_\s+)?(?P<module>\"[^\"]+\")", "import"), (r"^import\s*\((?P<module>[^)]*)\)", "import")],
        C_COMMENTS, (DQ, r"`[^`]*`", CHAR), method=False,
    ),
    "ruby": Language(
        [
            Rule(r"^[ \t]*def\s+(?:self\.)?(?P<name>[\w]+[?!=]?)(?:[ \t]*\((?P<params>[^()]*)\))?", "function", "def {name}({params})", scope="function"),
            Rule(r"^[ \t]*class\s+(?P<name>[A-Z][\w:]*)(?:\s*<\s*(?P<bases>[\w:]+))?", "class", "{head}", scope="type"),
            Rule(r"^[ \t]*class\s*<<\s*(?P<name>\w+)", "class", "{head}", scope="type"),
            Rule(r"^[ \t]*module\s+(?P<name>[A-Z][\w:]*)", "module", "module {name}", scope="type"),
        ],
        [(r"^[ \t]*require(?:_relative)?\s*\(?\s*(?P<module>['\"][^'\"]+['\"])", "require")],
        (r"^=begin.*?^=end", r"#[^\n]*"), (DQ, SQ), "end", r"(?<=[\s=(])do\b|^[ \t]*(?:def|class|module|if|unless|while|until|case|begin|for)\b|(?<==)[ \t]*(?:if|case|begin)\b",
        caller="none", method=False, keywords=KEYWORDS | frozenset({"require", "require_relative"}),
    ),
    "java": Language(
        [
            Rule(rf"\b(?:class|record)\s+(?P<name>{NAME}){GENERIC}(?:\s*\([^)]*\))?(?:\s+extends\s+(?P<bases>[\w.]+){GENERIC})?(?:\s+implements\s+[\w.,\s<>]+)?\s*\{{", "class", "{head}", scope="type"),
            Rule(rf"\binterface\s+(?P<name>{NAME}){GENERIC}(?:\s+extends\s+(?P<bases>[\w.,\s]+))?[^{{]*\{{", "class", "interface {name}", scope="type"),
            Rule(rf"\benum\s+(?P<name>{NAME})", "enum", "enum {{}}", scope="type"),
            Rule(rf"^[ \t]+(?:@\w+\s+)*{MODS}(?:<[^>]+>\s*)?(?:(?P<ret>[\w.]+(?:<[^;(){{}}]*>)?(?:\[\])*)\s+)?(?P<name>{NAME})\s*{PARAMS}(?:\s*throws\s+[\w.,\s]+)?\s*[{{;](?<!\);)", "method", "{ret} {name}({params})", scope="function"),
            Rule(rf"^[ \t]+(?:public|private|protected|static|final)\s+{MODS}[\w.<>\[\],?]+\s+(?P<name>{NAME})\s*(?:=|;)", "variable", "{head}", body="line", top=True),
        ],
        [(r"^import\s+(?:static\s+)?(?P<module>[\w.]+(?:\.\*)?)\s*;", "import")],
    ),
    "php": Language(
        [
            Rule(rf"\bclass\s+(?P<name>{NAME})(?:\s+extends\s+(?P<bases>[\w\\]+))?", "class", "{head}", scope="type"),
            Rule(rf"\b(?:interface|trait)\s+(?P<name>{NAME})", "class", "{head}", scope="type"),
            Rule(rf"^\s*enum\s+(?P<name>{NAME})", "enum", "enum {name}", scope="type"),
            Rule(rf"\bfunction\s+&?(?P<name>{NAME})\s*{PARAMS}", "function", "function {name}({params})", scope="function"),
            Rule(rf"^[ \t]*(?:(?:public|private|protected|static|var|readonly)\s+)+(?:\??[\w\\|]+\s+)?(?P<name>\${NAME})", "variable", "{head}", body="line"),
        ],
        [(r"^\s*use\s+(?P<module>[\w\\]+)(?:\s+as\s+\w+)?\s*;", "use"), (r"\b(?:require|include)(?:_once)?\s*\(?\s*(?P<module>['\"][^'\"]+['\"])", "include")],
        (r"//[^\n]*", r"#(?!\[)[^\n]*", r"/\*.*?\*/"), caller="none",
    ),
    "julia": Language(
        [
            Rule(r"^[ \t]*function\s+(?P<name>[\w.!]+)\s*" + PARAMS, "function", "function {name}({params})", scope="function"),
            Rule(r"^(?P<name>[\w!]+)\((?P<params>[^()]*)\)\s*=(?!=)", "function", "{name}({params})", body="line", scope="function"),
            Rule(r"^[ \t]*abstract\s+type\s+(?P<name>\w+)(?:\s*<:\s*(?P<bases>\w+))?", "class", "{head}", body="line"),
            Rule(r"^[ \t]*(?:mutable\s+)?struct\s+(?P<name>\w+)(?:\{[^}]*\})?(?:\s*<:\s*(?P<bases>\w+))?", "class", "{head}", scope="type"),
            Rule(r"^[ \t]*macro\s+(?P<name>\w+)", "decorator", "macro {name}", scope="function"),
            Rule(r"^[ \t]*module\s+(?P<name>\w+)", "module", "module {name}", scope="type"),
        ],
        [(r"^[ \t]*using\s+(?P<module>[\w.]+)", "using"), (r"^[ \t]*import\s+(?P<module>[\w.]+)", "import"), (r"^[ \t]*include\((?P<module>\"[^\"]+\")\)", "include")],
        (r"#=.*?=#", r"#[^\n]*"), (r'"""(?:\\.|[^\\])*?"""', DQ, CHAR), "end", r"(?<=[\s=(])do\b|^[ \t]*(?:function|struct|mutable[ \t]+struct|abstract[ \t]+type|primitive[ \t]+type|macro|module|if|for|while|try|let|begin|quote)\b|(?<==)[ \t]*(?:begin|let|if)\b",
        caller="none", method=False,
    ),
    "lua": Language(
        [
            Rule(r"^[ \t]*(?:local\s+)?function\s+(?P<name>[\w.:]+)\s*" + PARAMS, "function", "function {name}({params})", scope="function"),
            Rule(r"^[ \t]*(?:local\s+)?(?P<name>[\w.]+)\s*=\s*function\s*" + PARAMS, "function", "function {name}({params})", scope="function"),
            Rule(r"^(?:local\s+)?(?P<name>\w+)\s*=(?!=)", "variable", "{head}", body="line", top=True),
        ],
        [(r"\brequire\s*\(?\s*(?P<module>['\"][^'\"]+['\"])", "require")],
        (r"--\[\[.*?\]\]", r"--[^\n]*"), (DQ, SQ, r"\[\[.*?\]\]"), "end", r"\bfunction\b|\bdo\b|(?<!else)\bif\b",
        call=r"(?<!\w)([A-Za-z_]\w*+(?:[.:][A-Za-z_]\w*+)*+)\s*\(", method=False,
    ),
    "swift": Language(
        [
            Rule(rf"\bfunc\s+(?P<name>{NAME}){GENERIC}\s*{PARAMS}", "function", "func {name}({params})", scope="function"),
            Rule(rf"\b(?:class|struct|protocol|actor)\s+(?P<name>{NAME}){GENERIC}(?:\s*:\s*(?P<bases>[\w.,\s&]+?))?\s*\{{", "class", "{head}", scope="type"),
            Rule(rf"\benum\s+(?P<name>{NAME})(?:\s*:\s*(?P<bases>[\w.,\s]+?))?\s*\{{", "enum", "{head}", scope="type"),
            Rule(rf"^[ \t]*{MODS}(?:let|var)\s+(?P<name>{NAME})", "variable", "{head}", body="line", top=True),
        ],
        [(r"^\s*import\s+(?:class\s+|struct\s+|func\s+)?(?P<module>[\w.]+)", "import")],
        caller="none", call=rf"(?<![\w.])(?:[\w.?!]+\.)?({NAME})\s*\(", strings=(r'"""(?:\\.|[^\\])*?"""', DQ), method=False,
    ),
    "zig": Language(
        [
            Rule(rf"\bfn\s+(?P<name>{NAME})\s*{PARAMS}", "function", "fn {name}({params})", scope="function"),
            Rule(rf"\bconst\s+(?P<name>{NAME})\s*=\s*(?:packed\s+|extern\s+)?(?:struct|opaque)\b[^{{;]*\{{", "class", "const {name} = struct", scope="type"),
            Rule(rf"\bconst\s+(?P<name>{NAME})\s*=\s*enum\b[^{{;]*\{{", "enum", "const {name} = enum", scope="type"),
            Rule(rf"\bconst\s+(?P<name>{NAME})\s*=\s*union\b[^{{;]*\{{", "type_alias", "const {name} = union", scope="type"),
        ],
        [(r"@import\((?P<module>\"[^\"]+\")\)", "import")],
        (r"//[^\n]*",), (DQ, CHAR), caller="none", method=False,
    ),
    "scala": Language(
        [
            Rule(rf"\bdef\s+(?P<name>{NAME})(?:\[[^\]]*\])?\s*(?:{PARAMS})?", "function", "def {name}({params})", scope="function"),
            Rule(rf"\b(?:case\s+)?class\s+(?P<name>{NAME})(?:\[[^\]]*\])?(?:\s*\([^)]*\))?(?:\s+extends\s+(?P<bases>[\w.]+))?", "class", "class {name}", scope="type"),
            Rule(rf"\b(?:case\s+)?object\s+(?P<name>{NAME})(?:\s+extends\s+(?P<bases>[\w.]+))?", "module", "object {name}", scope="type"),
            Rule(rf"\btrait\s+(?P<name>{NAME})(?:\s+extends\s+(?P<bases>[\w.]+))?", "class", "trait {name}", scope="type"),
            Rule(rf"^[ \t]*{MODS}(?:lazy\s+)?va[lr]\s+(?P<name>{NAME})", "variable", "{head}", body="line"),
        ],
        [(r"^[ \t]*import\s+(?P<module>[\w.]+(?:\.\{[^}]*\}|\._)?)", "import")],
        strings=(r'"""(?:\\.|[^\\])*?"""', DQ, CHAR), caller="type", method=False, newline=True, call=rf"(?<![\w.])(?:[\w.]+\.)?({NAME})\s*(?:\[[^\]]*\])?\(",
    ),
    "elixir": Language(
        [
            Rule(r"^[ \t]*defmodule\s+(?P<name>[\w.]+)", "module", "defmodule {name}", scope="type"),
            Rule(r"^[ \t]*(?:def|defmacro|defdelegate)\s+(?P<name>\w+[?!]?)", "function", "public {name}", scope="function"),
            Rule(r"^[ \t]*defp\s+(?P<name>\w+[?!]?)", "function", "private {name}", scope="function"),
        ],
        [(r"^[ \t]*(?:alias|import)\s+(?P<module>[\w.]+)", "import"), (r"^[ \t]*require\s+(?P<module>[\w.]+)", "require"), (r"^[ \t]*use\s+(?P<module>[\w.]+)", "use")],
        HASH, (r'"""(?:\\.|[^\\])*?"""', DQ, SQ), "end", r"\bdo\b(?!:)|\bfn\b", call=r"(?<!\w)([A-Za-z_]\w*+(?:\.[A-Za-z_]\w*+)*+[?!]?)\(", caller="none", method=False,
        keywords=KEYWORDS | frozenset({"def", "defp", "defmodule", "defmacro"}),
    ),
    "dart": Language(
        [
            Rule(rf"\b(?:abstract\s+)?class\s+(?P<name>{NAME}){GENERIC}(?:\s+extends\s+(?P<bases>[\w.]+))?", "class", "class {{}}", scope="type"),
            Rule(rf"\bmixin\s+(?P<name>{NAME})", "class", "mixin {{}}", scope="type"),
            Rule(rf"\benum\s+(?P<name>{NAME})", "enum", "enum {{}}", scope="type"),
            Rule(rf"^[ \t]*(?:static\s+|external\s+)?(?:[\w.]+(?:<[^;(){{}}]*>)?\??\s+)(?P<name>{NAME})\s*{PARAMS}\s*(?:async\s*)?(?=\{{|=>)", "function", "{name}({params})", scope="function"),
        ],
        [(r"^\s*import\s+(?P<module>['\"][^'\"]+['\"])", "import")], caller="none", method=False,
    ),
    "haskell": Language(
        [
            Rule(r"^(?:data|newtype)\s+(?P<name>[A-Z]\w*)", "class", "{head}", body="line"),
            Rule(r"^type\s+(?P<name>[A-Z]\w*)", "type_alias", "{head}", body="line"),
            Rule(r"^class\s+(?:[^=\n]*=>\s*)?(?P<name>[A-Z]\w*)", "interface", "class {name}", scope="type"),
            Rule(r"^(?P<name>[a-z_][\w']*)\s*::[^\n]*", "function", "{head}"),
            Rule(r"^(?P<name>(?!data\b|type\b|newtype\b|class\b|instance\b|module\b|import\b|where\b|infix)[a-z_][\w']*)(?:\s+[^=\n:|]*)?\s*[=|](?![=>])", "function", "{head}"),
        ],
        [(r"^import\s+(?:qualified\s+)?(?P<module>[\w.]+)", "import")],
        (r"--[^\n]*", r"\{-.*?-\}"), (DQ, CHAR), "indent", call=r"(?<![\w.'])([a-z_][\w']*(?:\.[a-z_][\w']*)*)[ \t]+(?=[(\w\"\[])(?!=)", caller="none", method=False,
        keywords=KEYWORDS | frozenset("then of data type newtype instance deriving qualified as hiding main".split()),
    ),
    "c": Language(
        [
            Rule(rf"^(?:(?:static|inline|extern|const|unsigned|signed)\s+)*(?P<ret>[A-Za-z_]\w*(?:\s+[A-Za-z_]\w*)*[\s*]+)(?P<name>[A-Za-z_]\w*)\s*{PARAMS}\s*\{{", "function", "{ret} {name}({params})", scope="function"),
            Rule(r"^(?:typedef\s+)?struct\s+(?P<name>\w+)\s*\{", "class", "struct {name}", scope="type"),
            Rule(r"^(?:typedef\s+)?enum\s+(?P<name>\w+)\s*\{", "enum", "enum {name}", scope="type"),
            Rule(r"^typedef\s+(?!struct\s*\w*\s*\{|enum\s*\w*\s*\{)[^;{}]*?(?P<name>\w+)\s*;", "type_alias", "{head}", body="none"),
            Rule(r"^\}\s*(?P<name>\w+)\s*;", "type_alias", "typedef {name}", body="none"),
        ],
        [(r"^[ \t]*#\s*include\s+(?P<module>[<\"][^>\"\n]+[>\"])", "include")], strings=(DQ, CHAR), method=False,
    ),
    "cpp": Language(
        [
            Rule(rf"\bclass\s+(?P<name>{NAME})(?:\s+final)?(?:\s*:\s*(?P<bases>[^{{;]+?))?\s*\{{", "class", "{head}", scope="type"),
            Rule(rf"\bstruct\s+(?P<name>{NAME})(?:\s*:\s*(?P<bases>[^{{;]+?))?\s*\{{", "class", "{head}", scope="type"),
            Rule(rf"\benum\s+(?:class\s+|struct\s+)?(?P<name>{NAME})", "enum", "enum {name}", scope="type"),
            Rule(rf"\bnamespace\s+(?P<name>{NAME}(?:::{NAME})*)\s*\{{", "module", "namespace {name}", scope="type"),
            Rule(rf"^[ \t]*namespace\s+(?P<name>{NAME})\s*=", "module", "{head}", body="line"),
            Rule(rf"^[ \t]*(?:(?:static|inline|virtual|explicit|constexpr|extern|friend)\s+)*(?P<ret>[A-Za-z_][\w:]*(?:<[^;{{}}()]*>)?(?:\s+[A-Za-z_]\w*)*[\s*&]+)?(?P<name>~?[A-Za-z_]\w*(?:::~?\w+)*)\s*{PARAMS}\s*(?:const\s*)?(?:noexcept\s*)?(?:override\s*)?(?::[^{{;]*)?\{{", "function", "{ret} {name}({params})", scope="function"),
        ],
        [(r"^[ \t]*#\s*include\s+(?P<module>[<\"][^>\"\n]+[>\"])", "include"), (r"^[ \t]*using\s+(?:namespace\s+)?(?P<module>[\w:]+)\s*;", "using")], strings=(DQ, CHAR),
    ),
    "bash": Language(
        [
            Rule(r"^[ \t]*(?:function\s+(?P<name>[\w:-]+)\s*(?:\(\s*\))?\s*\{)", "function", "function {name}", scope="function"),
            Rule(r"^[ \t]*(?P<name>[\w:-]+)\s*\(\s*\)\s*\{", "function", "function {name}", scope="function"),
            Rule(r"^[ \t]*(?:export|readonly|local|declare)\s+(?P<name>[A-Za-z_]\w*)=", "variable", "export {name}", body="line"),
            Rule(r"^[ \t]*(?P<name>[A-Za-z_]\w*)=", "variable", "{name}", body="line"),
        ],
        [(r"^[ \t]*(?:source|\.)\s+(?P<module>[^\s;]+)", "import")],
        (r"(?:^|(?<=\s))#[^\n]*",), (DQ, r"'[^']*'"), calls=False, import_refs=False, method=False,
    ),
    "kotlin": Language(
        [
            Rule(rf"\bdata\s+class\s+(?P<name>{NAME})", "struct", "data class {name}", scope="type"),
            Rule(rf"\benum\s+class\s+(?P<name>{NAME})", "enum", "enum class {name}", scope="type"),
            Rule(rf"(?<!enum )(?<!data )\bclass\s+(?P<name>{NAME}){GENERIC}(?:\s*\([^)]*\))?(?:\s*:\s*(?P<bases>[\w.,\s()<>]+?))?\s*(?:\{{|$)", "class", "{head}", scope="type"),
            Rule(rf"\binterface\s+(?P<name>{NAME}){GENERIC}(?:\s*:\s*(?P<bases>[\w.,\s]+?))?\s*(?:\{{|$)", "interface", "interface {name}", scope="type"),
            Rule(rf"\b(?:companion\s+)?object\s+(?P<name>{NAME})", "class", "object {name}", scope="type"),
            Rule(r"\bcompanion\s+object\s*\{(?P<other>)", "class", "companion object", scope="type"),
            Rule(rf"\bfun\s+(?:<[^>]+>\s*)?(?:[\w.]+\.)?(?P<name>{NAME})\s*{PARAMS}(?:\s*:\s*(?P<ret>[\w.<>?]+))?", "function", "fun {name}({params})", scope="function"),
            Rule(rf"^[ \t]*{MODS}va[lr]\s+(?P<name>{NAME})", "field", "{head}", body="line", top=True),
        ],
        [(r"^import\s+(?P<module>[\w.]+(?:\.\*)?)", "import")], strings=(r'"""(?:\\.|[^\\])*?"""', DQ, CHAR), import_refs=False, newline=True,
    ),
    "csharp": Language(
        [
            Rule(r"\bnamespace\s+(?P<name>[\w.]+)\s*[{;]", "module", "namespace {name}", scope="type"),
            Rule(rf"\b(?:class|record)\s+(?P<name>{NAME}){GENERIC}(?:\s*\([^)]*\))?(?:\s*:\s*(?P<bases>[\w.,\s<>]+?))?\s*\{{", "class", "class {{}}", scope="type"),
            Rule(rf"\bstruct\s+(?P<name>{NAME})", "struct", "struct {{}}", scope="type"),
            Rule(rf"\binterface\s+(?P<name>{NAME}){GENERIC}(?:\s*:\s*(?P<bases>[\w.,\s<>]+?))?\s*\{{", "interface", "interface {{}}", scope="type"),
            Rule(rf"\benum\s+(?P<name>{NAME})", "enum", "enum {{}}", scope="type"),
            Rule(rf"\bdelegate\s+[\w.<>\[\]?]+\s+(?P<name>{NAME})\s*{PARAMS}\s*;", "function", "delegate {name}({params})", body="none"),
            Rule(rf"^[ \t]+{MODS}(?:(?P<ret>[\w.]+(?:<[^;(){{}}]*>)?(?:\[\])*\??)\s+)?(?P<name>{NAME}){GENERIC}\s*{PARAMS}(?:\s*:\s*(?:base|this)\([^)]*\))?\s*(?:\{{|=>)", "method", "{ret} {name}({params})", scope="function"),
            Rule(rf"^[ \t]+{MODS}[\w.<>\[\]?,]+\s+(?P<name>{NAME})\s*\{{\s*(?:get|set|init)", "field", "{head}"),
            Rule(rf"^[ \t]+(?:public|private|protected|internal|static|readonly|const)\s+{MODS}[\w.<>\[\]?,]+\s+(?P<name>{NAME})\s*(?:=|;)", "variable", "{head}", body="line", top=True),
        ],
        [(r"^[ \t]*using\s+(?:static\s+)?(?P<module>[\w.]+)\s*;", "using")], strings=(r'@"[^"]*"', DQ, CHAR),
    ),
}
