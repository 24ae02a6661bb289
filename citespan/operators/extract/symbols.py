"""Symbols of ten languages: a row for each definition's identifier, with its kind and line.

There is no parser library here.  Each source is *masked* first: comments and the insides of strings
become spaces, so that what is left can be matched by rules.  A rule is a regular expression with one
group, the identifier, and its kind.  Python is read with ``ast``; a source that doesn't parse falls back
to rules.  Definitions that several of the index's patterns capture (decorated, exported ones) give as many
rows.
"""

from __future__ import annotations

import ast
import bisect
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.paths import SYMBOL_LANGUAGES
from ...schemas import MAX_PARSED_BYTES

Symbol = tuple[str, str, int, int]
_ID = r"[A-Za-z_][A-Za-z0-9_]*"
_JS_ID = r"[A-Za-z_$][A-Za-z0-9_$]*"

# --- masking --------------------------------------------------------------------------------------

_C_STRINGS = r'"(?:\\.|[^"\\\n])*"' + r"|'(?:\\.|[^'\\\n])*'"
_MASKS = {
    "c": r"//[^\n]*|/\*.*?\*/|" + _C_STRINGS,
    "rust": r'//[^\n]*|/\*.*?\*/|b?r(#*)".*?"\1|"(?:\\.|[^"\\])*"|\'(?:\\[^\n]{1,8}?|[^\'\\\n])\'',
    "js": r"//[^\n]*|/\*.*?\*/|`(?:\\.|[^`\\])*`|" + _C_STRINGS,
    "go": r"//[^\n]*|/\*.*?\*/|`[^`]*`|" + _C_STRINGS,
    "python": r'#[^\n]*|(?:"""|\'\'\').*?(?:"""|\'\'\')|' + _C_STRINGS,
    "ruby": r"^=begin\b.*?^=end\b|#[^\n]*|" + _C_STRINGS,
    "csharp": r'//[^\n]*|/\*.*?\*/|\$?@"(?:""|[^"])*"|' + _C_STRINGS,
}
_MASKS = {k: re.compile(v, re.S | re.M) for k, v in _MASKS.items()}
_MASK_OF = {"rust": "rust", "typescript": "js", "javascript": "js", "go": "go", "java": "c", "c": "c", "cpp": "c", "csharp": "csharp", "ruby": "ruby", "python": "python"}


def masked(lang: str, source: str) -> str:
    """source with comments and strings blanked, of the same length and with the same lines."""
    return _MASKS[_MASK_OF[lang]].sub(lambda m: re.sub(r"[^\n]", " ", m.group()), source)


# --- rules ----------------------------------------------------------------------------------------

_NOT_CALLS = r"(?!(?:if|for|while|switch|catch|return|new|throw|else|do|function|super|await|typeof|sizeof|using|lock|foreach|when|in|of|constructor_)\b)"
_JAVA_TYPE = rf"{_ID}(?:\s*\.\s*{_ID})*(?:\s*<[^;{{}}()]*>)?(?:\s*\[\s*\])*\??"
_RULES: dict[str, list[tuple[str, str]]] = {
    "rust": [
        ("function", rf"\bfn\s+({_ID})"), ("struct", rf"\bstruct\s+({_ID})"), ("enum", rf"\benum\s+({_ID})"), ("trait", rf"\btrait\s+({_ID})"),
        ("impl", rf"\bimpl\b(?:\s*<[^{{}}]*?>)?\s+(?:[^{{}};]*?\bfor\s+)?({_ID})\s*(?:where\b[^{{]*)?\{{"),
        ("type", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?type\s+({_ID})[^;=]*="), ("module", rf"\bmod\s+({_ID})\s*[;{{]"),
        ("const", rf"\b(?:const|static)\s+(?:mut\s+)?({_ID})\s*:"), ("macro", rf"\bmacro_rules!\s*({_ID})"), ("import", r"^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);"),
    ],
    "go": [
        ("function", rf"^func\s+({_ID})\s*[\[(]"), ("method", rf"^func\s*\([^)]*\)\s*({_ID})\s*\("), ("type", rf"^type\s+({_ID})(?:\s+(?!=)|\[)"),
        ("import", r"^(import\s*(?:\([^)]*\)|[^\n(]*))"),
    ],
    "java": [
        ("class", rf"\bclass\s+({_ID})"), ("interface", rf"(?<!@)\binterface\s+({_ID})"), ("enum", rf"\benum\s+({_ID})"),
        ("method", rf"(?:^|[;{{}}])[ \t\n]*(?:@{_ID}(?:\([^)]*\))?\s+)*(?:(?:public|protected|private|static|final|abstract|synchronized|native|default|strictfp)\s+)*(?:<[^>]+>\s*)?{_NOT_CALLS}{_JAVA_TYPE}\s+{_NOT_CALLS}({_ID})\s*\([^;{{}}]*?\)(?:\s*\[\s*\])*\s*(?:throws\s[^;{{]*)?[{{;]"),
        ("import", r"^\s*(import\s[^;]*;)"),
    ],
    "c": [
        ("function", rf"^(?!\s*(?:typedef|return|else)\b)[ \t]*(?:[A-Za-z_][A-Za-z0-9_]*[ \t\n]+)+({_ID})\s*\([^;{{}}]*\)\s*\{{"),
        ("struct", rf"\bstruct\s+({_ID})"), ("enum", rf"\benum\s+({_ID})"), ("type", rf"\btypedef\b[^;{{}}]*(?:\{{[^{{}}]*\}})?[^;{{}}()]*?\b({_ID})\s*;"),
    ],
    "cpp": [
        ("function", rf"^(?!\s*(?:typedef|return|else|using|namespace|class)\b)[ \t]*(?:[A-Za-z_][A-Za-z0-9_:<>,]*[ \t\n]+)+({_ID})\s*\([^;{{}}]*\)\s*(?:const\s*)?(?:noexcept\s*)?(?:->[^{{;]*)?\{{"),
        ("class", rf"(?<!enum )\bclass\s+({_ID})\s*(?!;)"), ("struct", rf"(?<!enum )\bstruct\s+({_ID})"), ("namespace", rf"\bnamespace\s+({_ID})\s*\{{"),
        ("method", rf"\b{_ID}(?:<[^>]*>)?::(~?{_ID})\s*\([^;{{}}]*\)\s*(?:const\s*)?(?:noexcept\s*)?(?::[^;{{]*)?\{{"),
    ],
    "csharp": [
        ("class", rf"\bclass\s+({_ID})"), ("interface", rf"\binterface\s+({_ID})"), ("enum", rf"\benum\s+({_ID})"), ("struct", rf"\bstruct\s+({_ID})"),
        ("namespace", rf"\bnamespace\s+({_ID})\s*\{{"),
        ("method", rf"(?:^|[;{{}}\]])[ \t\n]*(?:(?:public|protected|private|internal|static|virtual|override|abstract|sealed|async|extern|unsafe|partial|new)\s+)*{_NOT_CALLS}{_JAVA_TYPE}\s+{_NOT_CALLS}({_ID})(?:<[^>()]*>)?\s*\([^;{{}}]*?\)\s*(?:where\b[^{{]*)?(?:\{{|=>|;)"),
    ],
    "ruby": [
        ("method", rf"\bdef\s+(?:(?:self|{_ID})\s*\.\s*)?([a-z_]\w*[?!]?)(?![?!=\w])"), ("class", r"\bclass\s+([A-Z]\w*)(?!\s*::|\w)"), ("module", r"\bmodule\s+([A-Z]\w*)(?!\s*::|\w)"),
    ],
    "python": [("function", rf"\bdef\s+({_ID})"), ("class", rf"\bclass\s+({_ID})"), ("import", r"^\s*from\s+([A-Za-z_][\w.]*)\s+import\b")],
}
_ARROW = rf"(?:async\s*)?(?:\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^={{;]*)?|{_JS_ID}\s*)=>"
_FUNCTION = r"(?:async\s+)?function\b(?!\s*\*)"
_JS = [
    ("function", rf"(?:^|[;{{}}]|\bexport\s|\bdefault\s|\basync\s)[ \t\n]*function\s+({_JS_ID})"), ("class", rf"(?<![.\w$])(?<!= )(?<!return )(?<!abstract )class\s+({_JS_ID})"),
    ("export", rf"\bexport\s+(?:default\s+)?(?:async\s+)?function\s+({_JS_ID})"), ("export", rf"\bexport\s+(?:default\s+)?class\s+({_JS_ID})"), ("export", rf"\bexport\s+(?:const|let)\s+({_JS_ID})"),
    ("const", rf"\b(?:const|let)\s+({_JS_ID})\s*(?::[^=;]*)?=\s*{_ARROW}"),
    ("method", rf"(?:^|[;{{}},])[ \t\n]*(?:(?:public|private|protected|static|async|override|readonly|get|set)\s+)*\*?{_NOT_CALLS}({_JS_ID})\s*(?:<[^>()]*>)?\s*\([^;{{}}]*?\)\s*(?::\s*[^;{{}}=]+?)?\{{"),
]
_RULES["javascript"] = [*_JS, ("const", rf"\b(?:const|let)\s+({_JS_ID})\s*=\s*{_FUNCTION}")]
_RULES["typescript"] = [*_JS, ("interface", rf"\binterface\s+({_JS_ID})"), ("type", rf"^\s*(?:export\s+)?(?:declare\s+)?type\s+({_JS_ID})[^=;]*="), ("enum", rf"\benum\s+({_JS_ID})")]
_COMPILED = {lang: [(kind, re.compile(rule, re.M | re.S if lang in ("go", "rust") and kind == "import" else re.M)) for kind, rule in rules] for lang, rules in _RULES.items()}
_JS_IMPORT = re.compile(r"""^\s*import\s+(?:[^'"();]*?\bfrom\s+)?(['"])([^'"\n]*)\1""", re.M)


class _Lines:
    def __init__(self, source: str):
        self.starts = [0, *(m.end() for m in re.finditer("\n", source))]

    def at(self, place: int) -> int:
        return bisect.bisect_right(self.starts, place)


def _python(source: str) -> list[Symbol] | None:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    rows: list[Symbol] = []
    lines = source.split("\n")

    def named(node) -> int:
        """The line of a definition's name."""
        n = node.lineno
        while n < len(lines) and not re.search(rf"\b(?:def|class)\b.*?\b{node.name}\b", lines[n - 1]):
            n += 1
        return min(n, len(lines))

    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            kind, n = "class" if isinstance(node, ast.ClassDef) else "function", named(node)
            rows += [(node.name, kind, n, n)] * (2 if node.decorator_list else 1)
        elif isinstance(node, ast.Import):
            rows += [(a.name, "import", a.lineno, a.lineno) for a in node.names if a.asname is None]
        elif isinstance(node, ast.ImportFrom) and node.module and not node.level and node.module != "__future__":
            rows.append((node.module, "import", node.lineno, node.lineno))
    return rows


# --- what rules alone can't tell ------------------------------------------------------------------

_BRACKETS = re.compile(r"[()\[\]{}]")


def _closing(text: str, at: int) -> int:
    """Where the bracket at ``at`` is closed; the text's end if it isn't."""
    depth = 0
    for m in _BRACKETS.finditer(text, at):
        depth += 1 if m.group() in "([{" else -1
        if depth == 0:
            return m.start()
    return len(text)


def _regions(text: str, opening: re.Pattern) -> list[tuple[int, int]]:
    """What stands in the brackets at whose opening the pattern ends; regions within regions are left out."""
    out, at = [], 0
    while m := opening.search(text, at):
        at = _closing(text, m.end() - 1)
        out.append((m.end(), at))
    return out


_MACRO = re.compile(rf"\b{_ID}!\s*(?:{_ID}\s*)?[(\[{{]")
_GO_TYPES = re.compile(r"^type\s*\(", re.M)
_GO_TYPE = re.compile(rf"[ \t]*({_ID})(?:\s+(?!=)|\[)")
_CPP_CLASS = re.compile(rf"\b(?:class|struct|union)\b[^;{{}}()]*\{{")


def _rust_text(text: str) -> str:
    """text without the arguments and bodies of macros: they are tokens, not definitions."""
    out, at = [], 0
    for a, b in _regions(text, _MACRO):
        out += [text[at:a], re.sub(r"[^\n]", " ", text[a:b])]
        at = b
    return "".join([*out, text[at:]])


def _has_body(text: str, at: int) -> bool:
    """Whether a brace comes before a semicolon, outside of round and square brackets, after a name."""
    m = re.compile(r"[(\[{;}]").search(text, at)
    while m and m.group() in "([":
        m = re.compile(r"[(\[{;}]").search(text, _closing(text, m.start()) + 1)
    return m is not None and m.group() == "{"


def _ts_has_body(text: str, at: int) -> bool:
    """Whether a function of TypeScript has a body after its name: an overload's signature has none."""
    opening = text.find("(", at)
    at = _closing(text, opening) + 1 if opening >= 0 else len(text)
    before = ")"
    while at < len(text):
        c = text[at]
        if c == "{" and before not in ":|&,<=>":
            return True
        if c in "([{":
            at, c = _closing(text, at), "}"
        elif c == ";" or (c == "\n" and before not in ":|&,<=>" and not re.match(r"\s*[{|&]", text[at:])):
            return False
        if not c.isspace():
            before = c
        at += 1
    return False


def _go_grouped(text: str) -> list[int]:
    """Places of the names in groups of types."""
    out = []
    for start, end in _regions(text, _GO_TYPES):
        at = start
        while at < end:
            m = _GO_TYPE.match(text, at, end)
            if m:
                out.append(m.start(1))
            # To the next line or semicolon outside of brackets.
            while at < end and text[at] not in "\n;":
                at = _closing(text, at) + 1 if text[at] in "([{" else at + 1
            at += 1
    return out


def _defined(lang: str, kind: str, text: str, place: int, end: int, classes: list[tuple[int, int]]) -> bool:
    """Whether what a rule has found is a definition of its kind."""
    if lang == "rust" and kind == "function":
        return _has_body(text, end)
    if lang == "typescript" and kind in ("function", "export") and re.search(r"function\s+\Z", text[max(0, place - 40) : place]):
        return _ts_has_body(text, end)
    if lang == "cpp" and kind == "function":
        # In a class's own body a name is a field's; in a function's body within it, it isn't.
        inner = [(a, b) for a, b in classes if a <= place < b]
        return not inner or text.count("{", inner[-1][0], place) != text.count("}", inner[-1][0], place)
    return True


def extract(lang: str | None, source: str) -> list[Symbol]:
    """(name, kind, start line, end line) in order; a language without rules gives none."""
    if lang not in SYMBOL_LANGUAGES:
        return []
    if lang == "python" and (rows := _python(source)) is not None:
        return sorted(rows, key=lambda r: (r[2], r[0], r[1]))
    text, at, rows = masked(lang, source), _Lines(source), []
    text = _rust_text(text) if lang == "rust" else text
    classes = sorted((m.end(), _closing(text, m.end() - 1)) for m in _CPP_CLASS.finditer(text)) if lang == "cpp" else []
    class_names = {m.group(1) for _, rule in _COMPILED[lang] if _ == "class" for m in rule.finditer(text)} if lang in ("java", "csharp") else set()
    for kind, rule in _COMPILED[lang]:
        for m in rule.finditer(text):
            start, end = m.span(1)
            name = source[start:end].strip().strip('"').strip("'")
            if name and not (kind == "method" and name in class_names) and _defined(lang, kind, text, start, end, classes):
                start += len(source[start:end]) - len(source[start:end].lstrip())
                rows.append((name, kind, at.at(start), at.at(max(start, end - 1))))
    if lang == "go":
        rows += [(re.match(_ID, text[place:]).group(), "type", at.at(place), at.at(place)) for place in _go_grouped(text)]
    if lang == "java":
        for m in re.finditer(rf"(?:^|[;{{}}])[ \t\n]*(?:(?:public|protected|private)\s+)?({_ID})\s*\([^;{{}}]*?\)\s*(?:throws\s[^;{{]*)?\{{", text, re.M):
            if m.group(1) in class_names:
                rows.append((m.group(1), "constructor", at.at(m.start(1)), at.at(m.start(1))))
    if lang in ("javascript", "typescript"):
        code = re.compile(r"//[^\n]*|/\*.*?\*/", re.S).sub(lambda m: re.sub(r"[^\n]", " ", m.group()), source)
        rows += [(m.group(2), "import", at.at(m.start(2)), at.at(m.start(2))) for m in _JS_IMPORT.finditer(code) if m.group(2)]
    return sorted(rows, key=lambda r: (r[2], r[0], r[1]))


def extract_symbols(contents: DataFrame) -> DataFrame:
    """path, name, kind, start_line, end_line, signature (null) of contents (path, lang, content, size, is_binary).

    Binary and larger files, and texts that aren't UTF-8 (null content), have none.  The filter stands
    before the Python step so that other files' text never leaves the JVM.
    """

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = [(p, *s) for p, lang, text in zip(b["path"], b["lang"], b["content"]) for s in extract(lang, text)]
            out = pd.DataFrame(rows, columns=["path", "name", "kind", "start_line", "end_line"]).astype({"start_line": "int32", "end_line": "int32"})
            out["signature"] = None
            yield out

    kept = contents.filter(F.col("lang").isin(*SYMBOL_LANGUAGES) & ~F.col("is_binary") & (F.col("size") <= MAX_PARSED_BYTES) & F.col("content").isNotNull())
    return kept.select("path", "lang", "content").mapInPandas(run, "path string, name string, kind string, start_line int, end_line int, signature string")
