"""Tokens of Rust source text with their places: raw strings, nested comments, lifetimes and characters told apart."""

from __future__ import annotations

import re
from typing import NamedTuple


class Token(NamedTuple):
    kind: str  # ident, life, num, str, char, punct
    text: str
    line: int  # from 1
    col: int  # from 0, in characters
    end_line: int


_SKIP = re.compile(r"\s+|//[^\n]*")
_IDENT = re.compile(r"(?:r#)?[^\W\d]\w*")
_RAW = re.compile(r'(?:b|c)?r(#*)"')
_QUOTED = re.compile(r'(?:b|c)?"(?:[^"\\]|\\.)*"', re.S)
_CHAR = re.compile(r"b?'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{2}|u\{[^}]*\}|.))'")
_LIFE = re.compile(r"'[^\W\d]\w*")
_NUM = re.compile(r"0[xob][0-9a-fA-F_]+\w*|\d[\d_]*(?:\.(?!\.|[^\W\d])[\d_]*)?(?:[eE][+-]?[\d_]+)?\w*")
_PUNCT = re.compile(r"<<=|>>=|\.\.\.|\.\.=|::|->|=>|==|!=|<=|>=|&&|\|\||\+=|-=|\*=|/=|%=|\^=|&=|\|=|\.\.|<<|[-+*/%^!&|=<>@.,;:#$?~(){}\[\]]")


class RustSyntaxError(ValueError):
    pass


def _comment_end(text: str, pos: int) -> int:
    depth = 0
    for m in re.compile(r"/\*|\*/").finditer(text, pos):
        depth += 1 if m[0] == "/*" else -1
        if not depth:
            return m.end()
    raise RustSyntaxError("unterminated comment")


def tokenize(text: str) -> list[Token]:
    out: list[Token] = []
    pos, line, line_start = 0, 1, 0
    while pos < len(text):
        if m := _SKIP.match(text, pos):
            end, kind = m.end(), None
        elif text.startswith("/*", pos):
            end, kind = _comment_end(text, pos), None
        elif m := _RAW.match(text, pos):
            close = text.find('"' + m[1], m.end())
            if close < 0:
                raise RustSyntaxError(f"unterminated raw string at line {line}")
            end, kind = close + 1 + len(m[1]), "str"
        else:
            for kind, pattern in (("str", _QUOTED), ("char", _CHAR), ("life", _LIFE), ("ident", _IDENT), ("num", _NUM), ("punct", _PUNCT)):
                if m := pattern.match(text, pos):
                    end = m.end()
                    break
            else:
                raise RustSyntaxError(f"unexpected {text[pos]!r} at line {line}")
        breaks = text.count("\n", pos, end)
        if kind:
            out.append(Token(kind, text[pos:end], line, pos - line_start, line + breaks))
        if breaks:
            line += breaks
            line_start = text.rfind("\n", pos, end) + 1
        pos = end
    return out


_PAIRS = {"(": ")", "[": "]", "{": "}"}


def partners(tokens: list[Token]) -> dict[int, int]:
    """Index of the closing bracket of each opening one, and the other way."""
    stack, out = [], {}
    for i, t in enumerate(tokens):
        if t.kind == "punct" and t.text in _PAIRS:
            stack.append(i)
        elif t.kind == "punct" and t.text in ")]}":
            if not stack or _PAIRS[tokens[stack[-1]].text] != t.text:
                raise RustSyntaxError(f"unbalanced {t.text} at line {t.line}")
            j = stack.pop()
            out[i], out[j] = j, i
    if stack:
        raise RustSyntaxError(f"unclosed {tokens[stack[-1]].text} at line {tokens[stack[-1]].line}")
    return out


_TIGHT_BEFORE = {",", ";", ":", ")", "]", ">", ".", "?", "::", "(", "[", "<", "!"}
_TIGHT_AFTER = {"(", "[", "<", "&", ".", "::", "!", "#"}


def joined(tokens: list[Token]) -> str:
    """Tokens as normalised text: one space between them but where Rust style has none."""
    out = ""
    for k, t in enumerate(tokens):
        last = tokens[k - 1].text if k else ""
        tight = not out or t.text in _TIGHT_BEFORE or last in _TIGHT_AFTER or (last == "*" and k > 1 and tokens[k - 2].text in ("(", "&", ",", ":", "->"))
        if t.text in ("(", "[") and last in ("->", ",", "=", ":", "&&", "||", "+", "mut", "=>", "dyn", "impl", "for", "in"):
            tight = False
        out += t.text if tight else " " + t.text
    return out


def split_top(tokens: list[Token], separator: str = ",") -> list[list[Token]]:
    """Parts between separators outside of brackets and angle brackets."""
    parts, depth, angle = [[]], 0, 0
    for k, t in enumerate(tokens):
        if t.kind == "punct":
            if t.text in "([{":
                depth += 1
            elif t.text in ")]}":
                depth -= 1
            elif t.text == "<" and not depth and (k == 0 or tokens[k - 1].kind == "ident" or tokens[k - 1].text == "::"):
                angle += 1
            elif t.text == ">" and not depth and angle:
                angle -= 1
            elif t.text == separator and not depth and not angle:
                parts.append([])
                continue
        parts[-1].append(t)
    return [p for p in parts if p]
