"""Keys of YAML and TOML texts, one and two levels deep, with the type of their values.

Small per-file helpers for :func:`factloom.operators.extract.extract_config`. YAML is read line by line
with the indents that are open and the text that is open (block scalars, quoted and flow values over
several lines); what lies below the second level is passed over by its indent. A text that does not
parse gives no keys at all.
"""

from __future__ import annotations

import datetime
import re
import tomllib
from dataclasses import dataclass, field


class Malformed(ValueError):
    """The text is not what its ending says."""


@dataclass
class Value:
    type: str
    keys: dict[str, Value] = field(default_factory=dict)


_QUOTED = r"\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'"
_KEY = re.compile(rf"({_QUOTED}|<<|(?:[^\s\-?:,\[\]{{}}#&*!|>'\"%@`]|[-?:](?=\S))(?:[^:#]|:(?=\S)|(?<!\s)#)*?)\s*:(?:\s+|\Z)")
_BLOCK_TEXT = re.compile(r"[|>](?:[+-]?[1-9]?|[1-9][+-])(?:\s+#.*)?\s*\Z")
_PROPERTY = re.compile(r"(?:&(?P<anchor>[^\s,\[\]{}]+)|!\S*)(?:\s+|\Z)")
_COMMENT = re.compile(r"(?:\A|\s+)#.*\Z", re.S)
_NULL = re.compile(r"(?:~|null|Null|NULL)?\Z")
_BOOLEAN = re.compile(r"(?:true|True|TRUE|false|False|FALSE)\Z")
_NUMBER = re.compile(r"[-+]?(?:0b[01_]+|0o[0-7_]+|0x[0-9a-fA-F_]+|\d[\d_]*(?:\.[\d_]*)?(?:[eE][-+]?\d+)?|\.\d[\d_]*(?:[eE][-+]?\d+)?|\.(?:inf|Inf|INF))\Z|\.(?:nan|NaN|NAN)\Z")
_DATE = re.compile(r"\d{4}-\d{1,2}-\d{1,2}(?:(?:[Tt]|\s+)\d{1,2}:\d{2}:\d{2}.*)?\Z")


def _scalar(text: str) -> Value:
    """A plain scalar; dates are objects, as is the lack of a value."""
    if _NULL.match(text) or _DATE.match(text):
        return Value("object")
    return Value("boolean" if _BOOLEAN.match(text) else "number" if _NUMBER.match(text) else "string")


def _plain_key(text: str) -> str:
    if text[:1] == '"':
        return re.sub(r"\\(.)", r"\1", text[1:-1])
    return text[1:-1].replace("''", "'") if text[:1] == "'" else text.strip()


class _Flow:
    """Values in brackets, over any number of lines."""

    def __init__(self, text: str, anchors: dict[str, Value]) -> None:
        self.text, self.at, self.anchors = text, 0, anchors

    def space(self) -> None:
        self.at = re.compile(r"(?:\s+|(?:(?<=\s)|(?<=[,\[{}\]]))#[^\n]*)*").match(self.text, self.at).end()

    def next(self) -> str:
        self.space()
        return self.text[self.at : self.at + 1]

    def value(self) -> Value:
        head = self.next()
        if head in ("{", "["):
            return self.bracket(head)
        found = re.compile(_QUOTED).match(self.text, self.at)
        if found:
            self.at = found.end()
            return Value("string")
        found = re.compile(r"(?:[^,\[\]{}:#]|:(?![\s,\[\]{}])|(?<!\s)#)*").match(self.text, self.at)
        self.at = found.end()
        text = found[0].strip()
        if text[:1] == "*":
            return _alias(text, self.anchors)
        return _scalar(_PROPERTY.sub("", text))

    def bracket(self, head: str) -> Value:
        self.at += 1
        out = Value("object" if head == "{" else "array")
        while (mark := self.next()) != ("}" if head == "{" else "]"):
            if not mark:
                raise Malformed("open bracket")
            start = self.at
            value = self.value()
            key = self.text[start : self.at]
            if self.next() == ":":
                self.at += 1
                value = Value("object") if self.next() in (",", "}", "]") else self.value()
            elif head == "{":
                value = Value("object")
            if head == "{":
                out.keys[_plain_key(key.strip())] = value
            if self.next() == ",":
                self.at += 1
            elif self.next() not in ("}", "]") or start == self.at:
                raise Malformed("no comma")
        self.at += 1
        return out


def _alias(text: str, anchors: dict[str, Value]) -> Value:
    if text[1:] not in anchors:
        raise Malformed("unknown alias")
    return anchors[text[1:]]


class _Yaml:
    def __init__(self, text: str) -> None:
        self.lines = text.lstrip("\ufeff").split("\n")
        self.at, self.anchors = 0, {}

    def indent(self, k: int) -> int | None:
        """Of a line with something on it; None for blank lines and comments."""
        line = self.lines[k].rstrip()
        bare = line.lstrip(" ")
        if not bare or bare[0] == "#":
            return None
        if bare[0] == "\t":
            if not bare.strip() or bare.strip()[0] == "#":
                return None
            raise Malformed("tab")
        return len(line) - len(bare)

    def peek(self) -> int | None:
        """Goes to the next line with something on it; its indent, None at the end."""
        while self.at < len(self.lines):
            found = self.indent(self.at)
            if found is not None:
                return found
            self.at += 1
        return None

    def skip(self, indent: int) -> None:
        """Over all lines that are indented deeper."""
        while (found := self.peek()) is not None and found > indent:
            self.at += 1

    def document(self) -> Value:
        while self.at < len(self.lines) and (self.indent(self.at) is None or self.lines[self.at].startswith("%")):
            self.at += 1
        if self.at < len(self.lines) and re.match(r"---(\s|\Z)", self.lines[self.at]):
            self.lines[self.at] = " " * 3 + self.lines[self.at][3:]
        for k in range(self.at, len(self.lines)):
            if re.match(r"\.\.\.(\s|\Z)", self.lines[k]):
                if any(x.strip() and not x.startswith("#") for x in self.lines[k + 1 :]):
                    raise Malformed("several documents")
                del self.lines[k:]
                break
        first = self.peek()
        if first is None:
            return Value("object")
        if self.lines[self.at].strip()[0] in "{[":
            return self.inline(self.lines[self.at].strip(), -1)
        if not _KEY.match(self.lines[self.at].strip()):
            return Value("array" if re.match(r"-(\s|\Z)", self.lines[self.at].strip()) else "string")
        return self.mapping(first, 1)

    def mapping(self, indent: int, level: int) -> Value:
        out = Value("object")
        while (found := self.peek()) is not None and found >= indent:
            line = self.lines[self.at].strip()
            if re.match(r"---(\s|\Z)", self.lines[self.at]):
                raise Malformed("several documents")
            key = _KEY.match(line)
            if found > indent or not key:
                raise Malformed("no key")
            name = _plain_key(key[1])
            value = self.value(line[key.end() :], indent, level)
            if name == "<<" and value.type == "object":
                for inner, kept in value.keys.items():
                    out.keys.setdefault(inner, kept)
                continue
            if name in out.keys and not name == "<<":
                raise Malformed("repeated key")
            out.keys[name] = value
        return out

    def value(self, rest: str, indent: int, level: int) -> Value:
        anchor = None
        while found := _PROPERTY.match(rest):
            anchor, rest = found["anchor"] or anchor, rest[found.end() :]
        out = self._value(_COMMENT.sub("", rest) if rest[:1] not in ("'", '"', "{", "[") else rest, indent, level)
        if anchor:
            self.anchors[anchor] = out
        return out

    def _value(self, rest: str, indent: int, level: int) -> Value:
        if not rest:
            self.at += 1
            found = self.peek()
            if found is None or found < indent:
                return Value("object")
            line = self.lines[self.at].strip()
            item = re.match(r"-(\s|\Z)", line)
            if found == indent and not item:
                return Value("object")
            if item:
                while (found := self.peek()) is not None and (found > indent or found == indent and re.match(r"-(\s|\Z)", self.lines[self.at].strip())):
                    self.at += 1
                return Value("array")
            if _KEY.match(line) and level == 1:
                return self.mapping(found, 2)
            if not _KEY.match(line):
                return self.value(line, indent, level)
            self.skip(indent)
            return Value("object")
        if _BLOCK_TEXT.match(rest):
            self.at += 1
            while self.at < len(self.lines):
                line = self.lines[self.at]
                if line.strip() and len(line) - len(line.lstrip(" ")) <= indent:
                    break
                self.at += 1
            return Value("string")
        if rest[0] in "{[\"'":
            return self.inline(rest, indent)
        if rest[0] == "*":
            self.at += 1
            return _alias(rest.strip(), self.anchors)
        if re.search(r":(\s|\Z)", rest) or rest[0] in "%@`":
            raise Malformed("no plain value")
        self.at += 1
        more = self.peek()
        if more is not None and more > indent:
            self.skip(indent)
            return Value("string")
        return _scalar(rest.strip())

    def inline(self, rest: str, indent: int) -> Value:
        """A value in quotes or brackets that begins with ``rest``, on to the line that it ends on.

        Lines are added by doubling until it closes, so a long value is not read again line by line.
        """
        more = 0
        while True:
            last = min(self.at + more, len(self.lines) - 1)
            text = "\n".join([rest, *self.lines[self.at + 1 : last + 1]])
            flow = _Flow(text, self.anchors)
            try:
                if rest[0] in "\"'" and not re.compile(_QUOTED).match(text):
                    raise Malformed("open quote")
                out = flow.value()
                break
            except Malformed:
                if last == len(self.lines) - 1:
                    raise
                more = 2 * more + 1
        over = text.count("\n", 0, flow.at)
        for k in range(self.at + 1, self.at + over + 1):
            if self.lines[k].strip() and len(self.lines[k]) - len(self.lines[k].lstrip()) <= indent:
                raise Malformed("open value")
        if _COMMENT.sub("", text[flow.at :].split("\n")[0]).strip():
            raise Malformed("text after a value")
        self.at += over + 1
        return out


def yaml_value(text: str) -> Value:
    return _Yaml(text).document()


def _toml_type(value: object) -> Value:
    if isinstance(value, dict):
        return Value("object", {k: _toml_type(v) for k, v in value.items()})
    if isinstance(value, list):
        return Value("array")
    if isinstance(value, (datetime.date, datetime.time)):
        return Value("object")
    return Value("boolean" if isinstance(value, bool) else "number" if isinstance(value, (int, float)) else "string")


def toml_value(text: str) -> Value:
    return _toml_type(tomllib.loads(text.replace("\r\n", "\n")))


def setting_keys(file: str, text: str) -> list[tuple[str, str, str]]:
    """``(name, key, type)`` of one and two levels; nothing where the text does not parse."""
    try:
        top = toml_value(text) if file.endswith(".toml") else yaml_value(text)
    except (ValueError, RecursionError):
        return []
    out = []
    for key, value in top.keys.items():
        out.append((key, key, value.type))
        out += [(f"{key}.{inner}", inner, below.type) for inner, below in value.keys.items() if value.type == "object"]
    return out


def key_line(lines: list[str], key: str) -> int | None:
    """The first line (from 1) that names a key with ``:`` or ``=``, or else in the header of a table."""
    name = re.escape(key)
    named = re.compile(rf"\s*[\"']?{name}[\"']?\s*[:=]")
    header = re.compile(rf"\s*\[\[?\s*(?:[\w-]+\.)*{name}(?:\.[\w-]+)*\s*\]\]?\s*(?:#.*)?\Z")
    for pattern in (named, header):
        for k, line in enumerate(lines):
            if key in line and pattern.match(line):
                return k + 1
    return None
