"""One linear scan of a source text: brackets, strings and comments; from them elements and the bracket tree.

``structure`` walks over the text once.  It skips comments and strings, numbers the brackets' depth and pairs each kind of
bracket with a stack.  Every search that finds no end is remembered, so the walk stays linear on any text.

Elements start at a statement (a line, or after ``;`` or a brace) with a signature of the language.  Parameters run to the paired
parenthesis, a body to the paired brace (to the end of the text where it is not closed); a Python body runs to the first line
outside strings and brackets that is indented no deeper than its ``def``.

The tree has a node for the whole text, one for each bracket group and one for each token.  A node's subtree holds just the
nodes whose ``pre`` lies between its ``pre`` and its ``post``.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

BRACES = ("java", "javascript", "c", "cpp")
LANGUAGES = (*BRACES, "python")

_OPENERS = {
    "java": re.compile(r'"""|["\']|//|/\*|[(){}\[\]]'),
    "javascript": re.compile(r'["\'`]|//|/\*|[(){}\[\]]'),
    "c": re.compile(r'["\']|//|/\*|[(){}\[\]]'),
    "python": re.compile(r'"""|\'\'\'|["\']|#|[(){}\[\]]'),
}
_OPENERS["cpp"] = _OPENERS["c"]
# The rest of a string on one line, of a template, and of a string of several lines, behind the opening mark.
_REST = {'"': re.compile(r'(?:[^"\\\n]++|\\[^\n])*+"'), "'": re.compile(r"(?:[^'\\\n]++|\\[^\n])*+'"), "`": re.compile(r"(?:[^`\\]++|\\[\s\S])*+`")}
_PAIR = {")": "(", "]": "[", "}": "{"}


class Structure:
    """``spans``: (start, end) of comments and strings; ``brackets``: (position, character); ``pair``: {opening position: closing position};
    ``depth``: running depth over all kinds of brackets, after each."""

    def __init__(self, text: str, language: str):
        self.spans, self.brackets, self.pair, self.depth = [], [], {}, []
        openers, at, level = _OPENERS[language], 0, 0
        stacks: dict = {"(": [], "[": [], "{": []}
        closed_by: dict = {}             # marks whose end was not found: from there on none is
        line_end: dict = {}              # the same for quotes, up to the end of their line
        while m := openers.search(text, at):
            mark, start = m[0], m.start()
            at = m.end()
            if mark in stacks:
                stacks[mark].append(start)
                level += 1
            elif mark in _PAIR:
                level -= 1
                if stacks[_PAIR[mark]]:
                    self.pair[stacks[_PAIR[mark]].pop()] = start
            else:
                end = self._end(text, mark, at, closed_by, line_end)
                if end < 0:
                    at = start + 1
                else:
                    self.spans.append((start, end))
                    at = end
                continue
            self.brackets.append((start, mark))
            self.depth.append(level)
        self.span_starts = [s for s, _ in self.spans]
        self.bracket_starts = [s for s, _ in self.brackets]

    @staticmethod
    def _end(text, mark, at, closed_by, line_end) -> int:
        if mark in ("//", "#"):
            end = text.find("\n", at)
            return len(text) if end < 0 else end
        if len(mark) > 1 and mark not in closed_by:
            close = "*/" if mark == "/*" else mark
            end = text.find(close, at)
            if end >= 0:
                return end + len(close)
            closed_by[mark] = True
        if len(mark) == 3:                # three quotes without an end: an empty string and a quote
            return at - 1
        if mark in closed_by:
            return -1
        if at <= line_end.get(mark, -1):
            return -1
        if m := _REST[mark].match(text, at):
            return m.end()
        if mark == "`":
            closed_by[mark] = True
        else:
            end = text.find("\n", at)
            line_end[mark] = len(text) if end < 0 else end
        return -1

    def hidden(self, at: int) -> bool:
        """Whether a position lies in a comment or string."""
        k = bisect_right(self.span_starts, at) - 1
        return k >= 0 and at < self.spans[k][1]

    def depth_before(self, at: int) -> int:
        k = bisect_left(self.bracket_starts, at)
        return self.depth[k - 1] if k else 0


_ID = r"[A-Za-z_$][A-Za-z0-9_$]*+"
_WS = r"[ \t\r\n]*+"
_MODIFIERS = r"(?:(?:public|private|protected|static|final|abstract|synchronized|native|default)[ \t]+)*+"
_AT = rf"(?:@{_ID}(?:\([^()\n]*+\))?[ \t]+)*+"

#: Per language: (kind, start of the statement up to its name or opening parenthesis).
_HEADS = {
    "javascript": [
        ("function_declaration", rf"(?:export[ \t]+)?(?:default[ \t]+)?(?:async[ \t]+)?function[ \t]*+\*?[ \t]*+({_ID})?{_WS}\("),
        ("function", rf"(?:export[ \t]+)?(?:const|let|var)[ \t]+{_ID}[ \t]*+={_WS}(?:async[ \t]+)?function[ \t]*+\*?[ \t]*+({_ID})?{_WS}\("),
        ("import_statement", r"""import(?=[ \t{"'*])()""")],
    "java": [
        ("class_declaration", rf"{_AT}{_MODIFIERS}class[ \t]+({_ID})"),
        ("import_declaration", r"import[ \t]+(?:static[ \t]+)?()[A-Za-z0-9_.*]++[ \t]*+;"),
        ("method_declaration", rf"{_AT}{_MODIFIERS}[A-Za-z_<][A-Za-z0-9_<>,.?\[\] \t]*[ \t]({_ID}){_WS}\(")],
    "python": [
        ("function_definition", rf"(?:async[ \t]+)?def[ \t]+({_ID})[ \t]*+\("),
        ("import_statement", r"import[ \t]()"),
        ("import_from_statement", r"from[ \t]+[^ \t\r\n]++[ \t]+import()")],
    "c": [
        ("preproc_include", r"#[ \t]*+include()"),
        ("function_definition", r"[A-Za-z_][A-Za-z0-9_:<>,*& \t]*[ \t*&\r\n]([A-Za-z_][A-Za-z0-9_:~]*+)[ \t]*+\(")],
}
_HEADS["cpp"] = _HEADS["c"]
_SEARCH = {lang: re.compile(r"(?m)(?:^|(?<=[;" + ("" if lang == "python" else "{}") + r"]))([ \t]*+)(?:" + "|".join(f"(?P<{kind}>{p})" for kind, p in heads) + ")")
           for lang, heads in _HEADS.items()}
_IMPORTS = {
    "javascript": re.compile(r"import(?:[^;\n{]++|\{[^{};]*+\})*+;?"),
    "java": re.compile(r"import[^;]*+;"),
    "import_statement": re.compile(r"import[ \t][^;\n]*+"),
    "import_from_statement": re.compile(r"from[ \t]+[^ \t\r\n]++[ \t]+import[ \t]*+(?:\([^()]*+\)|[^;\n(]*+)"),
    "c": re.compile(r"#[ \t]*+include[^\n]*+"),
}
_IMPORTS["cpp"] = _IMPORTS["c"]
#: From the closing parenthesis to the opening brace of a body.
_TAILS = {
    "javascript": re.compile(rf"{_WS}\{{"),
    "java": re.compile(rf"{_WS}(?:throws[ \t\r\n]++[A-Za-z0-9_., \t\r\n]++)?\{{"),
    "c": re.compile(rf"{_WS}(?:const{_WS})?\{{"),
}
_TAILS["cpp"] = _TAILS["c"]
_STOPS = re.compile(r"[;{}()]")
#: Words that begin a statement or expression; they are no names or types of a method.
KEYWORDS = ["if", "for", "while", "switch", "catch", "return", "new", "else", "do", "try", "sizeof", "throw", "case", "synchronized"]
IMPORT_KINDS = ["import_statement", "import_declaration", "import_from_statement", "preproc_include"]
_NO_TYPE = re.compile(r"(?:^|[^A-Za-z0-9_$])(?:if|for|while|switch|catch|return|new|else|do|try|sizeof|throw|case)(?:[^A-Za-z0-9_$]|$)")
_PARAMETER_MARK = re.compile(r"""\"[^"]*+"|'[^']*+'|=>|[(<\[{]|[)>\]}]|,""")
_LINE = re.compile(r"(?m)^([ \t]*+)([^ \t\r\n#]|\r?\n|#|\r|\Z)")
_STRIP = " \t\r\n"


def parameters(text: str) -> list[str]:
    """A parameter list split at commas outside brackets and quotes, trimmed, empties dropped."""
    out, start, level = [], 0, 0
    for m in _PARAMETER_MARK.finditer(text):
        mark = m[0]
        if mark == "," and not level:
            out.append(text[start:m.start()])
            start = m.end()
        elif mark in "(<[{":
            level += 1
        elif mark in ")>]}":
            level = max(level - 1, 0)
    return [p for p in (x.strip(_STRIP) for x in [*out, text[start:]]) if p]


def _dedent(text: str, s: Structure, start: int, indent: int, after: int) -> int:
    """Where the first line behind ``after`` starts that belongs to an outer block."""
    depth = s.depth_before(start)
    for m in _LINE.finditer(text, after):
        at = m.start()
        if (at > after and m[2] not in ("", "#") and m[2][0] not in "\r\n" and len(m[1]) <= indent
                and not s.hidden(at) and s.depth_before(at) <= depth):
            return at
    return len(text)


def elements(text: str, language: str) -> list[tuple]:
    """(kind, start, end, line, name or None, parameters), in the order of their starts."""
    s = Structure(text, language)
    out, line, counted, stops = [], 1, 0, None
    for m in _SEARCH[language].finditer(text):
        kind, start = m.lastgroup, m.end(1)
        if s.hidden(start):
            continue
        # The name's group is the first one inside that of the kind.
        named = m.lastindex + 1
        name, params = m[named], []
        if kind in IMPORT_KINDS:
            end = (_IMPORTS[kind] if language == "python" else _IMPORTS[language]).match(text, start).end()
        elif kind == "class_declaration":
            stops = [x.start() for x in _STOPS.finditer(text)] if stops is None else stops
            k = bisect_left(stops, m.end())
            if k == len(stops) or text[stops[k]] != "{":
                continue
            end = s.pair.get(stops[k], len(text) - 1) + 1
        else:
            close = s.pair.get(m.end() - 1)
            if name in KEYWORDS or close is None or (language not in ("javascript", "python") and _NO_TYPE.search(text[start:m.start(named)])):
                continue
            params = parameters(text[m.end():close])
            end = _body_end(text, s, language, start, len(m[1]), close)
            if end is None:
                continue
            if language in ("c", "cpp"):
                name = text[m.start(named):close + 1]
        line += text.count("\n", counted, start)
        counted = start
        out.append((kind, start, end, line, name or None, params))
    return out


def _body_end(text: str, s: Structure, language: str, start: int, indent: int, close: int):
    if language == "python":
        return _dedent(text, s, start, indent, close)
    tail = _TAILS[language].match(text, close + 1)
    if tail:
        return s.pair.get(tail.end() - 1, len(text) - 1) + 1
    return close + 1 if language == "javascript" else None


ROOT, GROUP, IDENTIFIER, NUMBER, STRING, COMMENT, PUNCTUATION = NODE_KINDS = (
    "program", "group", "identifier", "number", "string", "comment", "punctuation")
_TOKEN = re.compile(r"([A-Za-z_][A-Za-z0-9_]*+)|([0-9]++)|[^ \t\n\r\f\x0B]")


def _tokens(text: str, s: Structure):
    """(kind, start, end) of all tokens in order."""
    at = 0
    for start, end in [*s.spans, (len(text), len(text))]:
        for m in _TOKEN.finditer(text, at, start):
            yield (PUNCTUATION if not m.lastindex else IDENTIFIER if m.lastindex == 1 else NUMBER), m.start(), m.end()
        if start < end:
            yield (COMMENT if text[start] in "/#" else STRING), start, end
        at = end


def nodes(text: str, language: str) -> list[tuple]:
    """(kind, pre, post, depth, parent, start, end) of the bracket tree, by ``pre``.  A group runs from its opening bracket to the
    bracket that brings the depth back (to the end of the text where none does); a closing bracket without a group is a token."""
    s = Structure(text, language)
    out = [[ROOT, 0, 0, 0, None, 0, len(text)]]
    open_groups = [0]
    for kind, start, end in _tokens(text, s):
        mark = text[start] if kind == PUNCTUATION else ""
        if mark and mark in "([{":
            out.append([GROUP, len(out), len(out), len(open_groups), open_groups[-1], start, len(text)])
            open_groups.append(len(out) - 1)
        out.append([kind, len(out), len(out), len(open_groups), open_groups[-1], start, end])
        if mark and mark in ")]}" and len(open_groups) > 1:
            g = out[open_groups.pop()]
            g[2], g[6] = len(out) - 1, end
    for g in open_groups:
        out[g][2] = len(out) - 1
    return [tuple(n) for n in out]
