"""Assignments in source and configuration syntax: names, the literals of their values, constants propagated.

A text is read once from left to right. A target is a name (bare, quoted, dotted,
dashed, or a quoted subscript such as ``conf["name"]``) before ``=``, ``:=``, ``=>``
or ``:``, with a type between ``:`` and ``=`` if there is one. To its right stands

* an expression: string literals (double, single and back quotes, triple quotes over
  several lines) and names of earlier targets, joined by ``+``, ``..`` or by standing
  next to each other, or
* a list of such expressions in brackets, over several lines if need be, or the
  arguments of a call up to the first that is no such expression; each is a value of its
  own, or
* a configuration value: the rest of a line that holds nothing before the name and
  nothing but a comment (or a comma or semicolon) after the value, which begins with
  neither a quote nor a bracket nor as a call, or
* the indented lines after ``|`` or ``>``.

Nothing has a length limit. Every pattern is possessive or starts where the last one
ended, and what depends on the line is found once a line, so the time is linear in the
text. Of a value only its literals' positions and what the score needs are kept, and
values built of others share these parts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

#: Bits of entropy from which a value is fully plausible.
ENOUGH_BITS = 18
#: Characters at either end by which placeholders are told.
ENDS = 64

_TARGET = re.compile(
    r"""(?:(?P<q>["'`])(?P<quoted>[A-Za-z_][\w.\- ]*+)(?P=q)|(?<![\w.\-])(?P<bare>[A-Za-z_][\w.\-]*+))(?:\x20*+\])?[\x20\t]*+(?::=|=>|[:=])(?![=:])(?<![=!<>]=)(?!//)""", re.A
)
_TYPED = re.compile(r"[\x20\t]*+[A-Za-z_][\w.]*+(?:\[[^\[\]:=\n]*+\])?[\x20\t?!]*+=(?![=>~])", re.A)
_STRING = re.compile(
    r'''(?:[A-Za-z]{0,2}(?:"""(?P<ddd>(?:[^"\\]++|\\.|"(?!""))*+)"""|\'\'\'(?P<sss>(?:[^'\\]++|\\.|'(?!''))*+)\'\'\''''
    r'''|"(?P<d>[^"\\\n]*+(?:\\.[^"\\\n]*+)*+)"|'(?P<s>[^'\\\n]*+(?:\\.[^'\\\n]*+)*+)')|`(?P<b>[^`]*+)`)''',
    re.A | re.S,
)
_KNOWN = re.compile(r"""(?P<name>[A-Za-z_][\w.]*+)(?!["'(\[])""", re.A)
_BLANKS = re.compile(r"[\x20\t]*+")
_GAP = re.compile(r"(?:[^\S\n]++|\#[^\n]*+|//[^\n]*+)*+")
_SPACE = re.compile(r"(?:\s++|\#[^\n]*+|//[^\n]*+)*+")
_JOIN = re.compile(r"[\x20\t]*+(?:\+|\.\.|\\?\r?\n[\x20\t]*+\+)[\x20\t]*+(?:\\?\r?\n[\x20\t]*+)?")
_LINE = re.compile(r"[\x20\t]*+(?:(?:export|set|const|let|var)[\x20\t]++|-[\x20\t]++)?")
_BARE = re.compile(r"[\x20\t]*+(?=\S{6})(?![A-Za-z_][\w.]*+[(\[])(?P<value>[^\s\"'`#,;(\[{](?:[^\s,;]|[,;](?=\S))*+)[,;]?(?=[\x20\t]*+(?:$|[\r\n])|[\x20\t]++\#)", re.A)
_CALL = re.compile(r"[A-Za-z_][\w.]*+(?=\()", re.A)
_BLOCK = re.compile(r"[\x20\t]*+[|>][+-]?[\x20\t]*+\r?\n")
_OPEN, _CLOSE = "[(", "])"


class Gaps:
    """White space and comments of a text. The longest stretch met last is kept: from a line's end within it one gets to its end at once."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, 0, 0

    def after(self, pos: int) -> int:
        line = _GAP.match(self.text, pos).end()
        if self.text[line : line + 1] != "\n":
            return line
        if self.start <= line < self.end:
            return self.end
        self.start, self.end = line, _SPACE.match(self.text, line).end()
        return self.end


class Value:
    """What a text is, as far as the score needs it: length, both ends, spaces, and its characters until they are enough."""

    __slots__ = ("counts", "head", "length", "spaces", "tail")

    def __init__(self, text: str = ""):
        self.length, self.head, self.tail, self.spaces = len(text), text[:ENDS], text[-ENDS:], text.count(" ")
        self.counts: Counter | None = Counter(text)
        self._settle()

    def _settle(self) -> None:
        if self.counts is not None and self._bits() >= ENOUGH_BITS:
            self.counts = None  # more text never has fewer bits

    def _bits(self) -> float:
        if self.counts is None:
            return math.inf
        each = -sum(c / self.length * math.log2(c / self.length) for c in self.counts.values())
        return each * min(self.length, 1 << 60)  # a value that doubles at each step outgrows floats

    def __add__(self, other: Value) -> Value:
        out = Value()
        out.length, out.spaces = self.length + other.length, self.spaces + other.spaces
        out.head = (self.head + other.head)[:ENDS] if self.length < ENDS else self.head
        out.tail = (self.tail + other.tail)[-ENDS:] if other.length < ENDS else other.tail
        out.counts = None if self.counts is None or other.counts is None else self.counts + other.counts
        out._settle()
        return out

    def bits(self) -> float:
        """Its entropy, or infinity if that is ENOUGH_BITS or more."""
        return self._bits() if self.length else 0.0

    def ends(self) -> str:
        """The whole of a short value, both ends of a long one."""
        return self.head + self.tail[max(0, len(self.tail) + ENDS - self.length) :] if self.length > ENDS else self.head


class Parts:
    """The literals a value is made of: spans of its own, and the parts of the names it takes up, which are shared."""

    __slots__ = ("names", "spans")

    def __init__(self):
        self.spans: list[tuple[int, int]] = []
        self.names: dict[int, Parts] = {}


def literals(roots: list[Parts]) -> set[tuple[int, int]]:
    """The spans of all literals of roots; each part is visited once."""
    found, seen, open_ = set(), set(), list(roots)
    while open_:
        part = open_.pop()
        if id(part) not in seen:
            seen.add(id(part))
            found.update(part.spans)
            open_.extend(part.names.values())
    return found


def _term(text: str, at: int, known: dict[str, tuple[Value, Parts]]) -> tuple[Value, Parts | None, tuple[int, int] | None, int] | None:
    """A string or a known name: (value, parts of the name, span of the string, end)."""
    if found := _STRING.match(text, at):
        which = found.lastgroup
        return Value(found[which]), None, found.span(which), found.end()
    if (found := _KNOWN.match(text, at)) and found["name"] in known:
        return *known[found["name"]], None, found.end()
    return None


def _expression(text: str, at: int, known: dict, gaps: Gaps, inside: bool) -> tuple[Value, Parts, int] | None:
    """Terms joined; none if there is no term at first, or an unknown one after a join."""
    value, parts, pos = Value(), Parts(), at
    joined = True
    while True:
        if inside:
            pos = gaps.after(pos)
        elif joined:
            pos = _BLANKS.match(text, pos).end()
        term = _term(text, pos, known)
        if term is None:
            return None if joined else (value, parts, pos)
        more, other, span, end = term
        if not joined and span is None:  # only strings stand next to each other
            return value, parts, pos
        value = value + more if value.length else more
        if span is None:
            parts.names[id(other)] = other
        else:
            parts.spans.append(span)
        pos = end
        join = _JOIN.match(text, pos)
        joined = join is not None
        if joined:
            pos = join.end()
        elif not inside:
            after = _BLANKS.match(text, pos).end()
            if text[after : after + 1] not in ('"', "'"):
                return value, parts, pos
            pos = after


def _list(text: str, at: int, known: dict, gaps: Gaps) -> tuple[list[tuple[Value, Parts]], int]:
    """The expressions in brackets from at on, up to the one that closes the first, or to what is none."""
    out, depth, pos = [], 0, at
    while True:
        pos = gaps.after(pos)
        c = text[pos : pos + 1]
        if c and c in _OPEN:
            depth += 1
            pos += 1
        elif c and c in _CLOSE:
            depth -= 1
            pos += 1
            if not depth:
                return out, pos
        elif c == ",":
            pos += 1
        else:
            found = _expression(text, pos, known, gaps, True)
            if found is None:
                return out, pos
            out.append(found[:2])
            pos = found[2]


def _block(text: str, at: int, indent: int) -> tuple[tuple[int, int] | None, int]:
    """The lines from at on that are empty or indented more than indent: their span, and where they end."""
    first = last = None
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        begin = _BLANKS.match(text, at, end).end()
        if text[begin:end].strip():
            if begin - at <= indent:
                break
            first = begin if first is None else first
            last = end
        at = end + 1
    return (None if first is None else (first, last)), min(at, len(text))


def assignments(text: str) -> Iterator[tuple[str, Value, Parts, bool]]:
    """(name, value, parts, bare) of every target and value, in order; bare: a configuration value."""
    known: dict[str, tuple[Value, Parts]] = {}
    gaps = Gaps(text)
    line, lead, pos = 0, _LINE.match(text).end(), 0
    while target := _TARGET.search(text, pos):
        name, start, right = target["quoted"] or target["bare"], target.start(), target.end()
        begin = text.rfind("\n", pos, start) + 1
        if begin > line:
            line, lead = begin, _LINE.match(text, begin).end()
        pos = right
        if text[right - 1] == ":" and (typed := _TYPED.match(text, right)):
            right = typed.end()
        at = _BLANKS.match(text, right).end()
        c = text[at : at + 1]
        found: list[tuple[Value, Parts]] = []
        bare = False
        if c and c in _OPEN:
            found, end = _list(text, at, known, gaps)
        elif call := _CALL.match(text, at):
            found, end = _list(text, call.end(), known, gaps)
        elif c and c in "\"'`" or c.isalpha() or c == "_":
            one = _expression(text, at, known, gaps, False)
            if one is not None:
                found, end = [one[:2]], one[2]
        if not found and start == lead:
            if block := _BLOCK.match(text, right):
                span, end = _block(text, block.end(), lead - line)
            else:
                value = _BARE.match(text, right)
                span, end = (value.span("value"), value.end()) if value else (None, right)
            if span:
                parts = Parts()
                parts.spans.append(span)
                found, bare = [(Value(text[slice(*span)]), parts)], True
        if not found:
            continue
        pos = max(pos, end)
        if len(found) == 1:
            whole = found[0]
        else:
            parts = Parts()
            parts.names = {id(p): p for _, p in found}
            whole = sum((v for v, _ in found[1:]), found[0][0]), parts
        known[name] = whole
        known.setdefault(name.rpartition(".")[2], whole)
        for value, parts in found:
            yield name, value, parts, bare
