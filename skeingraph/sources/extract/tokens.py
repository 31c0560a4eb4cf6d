"""Tokens with offsets, bracket pairs and positions, for languages with C-like lexical rules."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}
# After these a slash begins a regular expression in JavaScript.
BEFORE_VALUE = frozenset("( [ { , ; = : ? ! & | + - * / % < > ~ ^ => && || ?? ... return typeof case in of delete void throw new else do yield await".split())

STRING = r'"(?:\\.|[^"\\\n])*"|' + r"'(?:\\.|[^'\\\n])*'"
PUNCT = r"\.\.\.|=>|->|::|\?\.|&&|\|\||\?\?|[^\s\w]"
WORD = r"[A-Za-z_$\u0080-\U0010ffff][\w$\u0080-\U0010ffff]*"
NUMBER = r"\d(?:[\w.]|(?<=[eE])[+-])*"
COMMENT = r"//[^\n]*|/\*.*?\*/"


def rules(*extra: tuple[str, str]) -> re.Pattern:
    parts = [("space", r"\s+"), *extra, ("id", WORD), ("num", NUMBER), ("p", PUNCT)]
    return re.compile("|".join(f"(?P<{k}{i}>{p})" for i, (k, p) in enumerate(parts)), re.S)


PATTERNS = {
    "javascript": rules(("skip", COMMENT), ("str", STRING), ("private", r"#" + WORD)),
    "java": rules(("skip", COMMENT), ("str", r'"""(?:\\.|[^\\])*?"""|' + STRING)),
    "go": rules(("skip", COMMENT), ("str", STRING + r"|`[^`]*`")),
    "rust": rules(("skip", COMMENT), ("str", r'b?r(#*)"(?s:.*?)"(?:(?<="#)|(?<!"))|b?"(?:\\.|[^"\\])*"|' + r"b?'(?:\\[^']+|[^'\\])'"), ("life", r"'\w+")),
    "c": rules(("skip", COMMENT), ("inc", r"(?m:^[ \t]*#[ \t]*include[^\n]*)"), ("pre", r"(?m:^[ \t]*#(?:[^\\\n]|\\.)*)"), ("str", r'R"([^()\s]{0,16})\((?s:.*?)\)"|' + r"(?:u8|[uUL])?(?:" + STRING + ")")),
}
PATTERNS |= {"typescript": PATTERNS["javascript"], "tsx": PATTERNS["javascript"], "cpp": PATTERNS["c"]}


class SourceError(Exception):
    """Something that no parser accepts, at an offset."""

    def __init__(self, at: int) -> None:
        super().__init__("syntax error")
        self.at = at


@dataclass(slots=True)
class Token:
    kind: str
    text: str
    start: int
    end: int
    line: int


class Source:
    """A text with its tokens (closed by an empty one) and the partner of each bracket."""

    def __init__(self, content: bytes, language: str) -> None:
        self.text = content.decode("utf-8", errors="replace")
        self.language = language
        self.lines = [0] + [m.end() for m in re.finditer("\n", self.text)]
        self.tokens: list[Token] = []
        self.pair: dict[int, int] = {}

    def position(self, at: int) -> tuple[int, int]:
        line = bisect_right(self.lines, at) - 1
        return line + 1, len(self.text[self.lines[line] : at].encode())

    def span(self, start: int, end: int) -> dict:
        (a, b), (c, d) = self.position(start), self.position(end)
        return {"start_line": a, "start_col": b, "end_line": c, "end_col": d}

    def add(self, kind: str, start: int, end: int, text: str | None = None) -> None:
        self.tokens.append(Token(kind, self.text[start:end] if text is None else text, start, end, bisect_right(self.lines, start)))

    def tokenize(self) -> Source:
        self.scan(0, None)
        stack: list[int] = []
        for i, t in enumerate(self.tokens):
            if t.kind != "p":
                continue
            if t.text in OPEN:
                stack.append(i)
            elif t.text in CLOSE:
                if not stack or self.tokens[stack[-1]].text != CLOSE[t.text]:
                    raise SourceError(t.start)
                self.pair[stack.pop()] = i
        if stack:
            raise SourceError(self.tokens[stack[-1]].start)
        self.add("end", len(self.text), len(self.text))
        return self

    def scan(self, at: int, until: str | None) -> int:
        """Tokens from an offset; stops after the bracket that closes a template's expression."""
        text, pattern, js = self.text, PATTERNS[self.language], self.language in ("javascript", "typescript", "tsx")
        depth = 0
        while at < len(text):
            c = text[at]
            if js and c == "`":
                at = self.template(at)
                continue
            if js and c == "/" and text[at + 1 : at + 2] not in ("/", "*") and (not self.tokens or self.tokens[-1].text in BEFORE_VALUE):
                m = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/\w*").match(text, at)
                if m:
                    self.add("str", at, m.end())
                    at = m.end()
                    continue
            if js and self.language != "typescript" and c == "<" and (not self.tokens or self.tokens[-1].text in BEFORE_VALUE) and re.compile(r"<(?:>|[A-Za-z])").match(text, at) and not re.compile(r"<[^<>()]*>\s*\(").match(text, at):
                at = self.element(at)
                continue
            m = pattern.match(text, at)
            if not m or c in "\"'" and m.lastgroup.startswith("p") or text.startswith("/*", at) and not m.lastgroup.startswith("skip"):
                raise SourceError(at)
            kind = m.lastgroup.rstrip("0123456789") if m.lastgroup else "p"
            if until and kind == "p":
                if c == "{":
                    depth += 1
                elif c == "}":
                    if not depth:
                        return at
                    depth -= 1
            if kind not in ("space", "skip", "life", "pre"):
                self.add("id" if kind == "private" else kind, at, m.end())
            at = m.end()
        if until:
            raise SourceError(at)
        return at

    def template(self, at: int) -> int:
        start, at = at, at + 1
        self.add("str", start, start + 1)
        while at < len(self.text):
            if self.text[at] == "\\":
                at += 2
            elif self.text[at] == "`":
                return at + 1
            elif self.text.startswith("${", at):
                self.add("p", at + 1, at + 2)
                at = self.scan(at + 2, "}")
                self.add("p", at, at + 1)
                at += 1
            else:
                at += 1
        raise SourceError(start)

    def element(self, at: int) -> int:
        """A JSX element: its text gives no tokens, its expressions do, between round brackets."""
        self.add("p", at, at + 1, "(")
        start, tag = at, re.compile(r"<(/?)\s*([\w.:$-]*)")
        depth = 0
        while at < len(self.text):
            m = tag.match(self.text, at)
            if m:
                closing, at = bool(m[1]), m.end()
                while at < len(self.text) and self.text[at] != ">":
                    if self.text[at] in "\"'":
                        end = self.text.find(self.text[at], at + 1)
                        if end < 0:
                            raise SourceError(at)
                        at = end + 1
                    elif self.text[at] == "{":
                        at = self.braced(at)
                    else:
                        at += 1
                single = self.text[at - 1 : at] == "/"
                at += 1
                depth += 0 if single else -1 if closing else 1
                if depth <= 0:
                    self.add("p", at - 1, at, ")")
                    return at
            elif self.text[at] == "{":
                at = self.braced(at)
            else:
                at += 1
        raise SourceError(start)

    def braced(self, at: int) -> int:
        self.add("p", at, at + 1)
        at = self.scan(at + 1, "}")
        self.add("p", at, at + 1)
        return at + 1
