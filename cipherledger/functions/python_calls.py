"""Calls of a Python source file by bracket depth.

The text is cut into words, strings, brackets and signs once, and brackets are kept on a
stack, so nesting of any depth takes linear time and no recursion. Every call keeps the line
its callee starts on; arguments are what commas of its own bracket separate. A file that
does not parse still gives the calls that stand in it.
"""

from __future__ import annotations

import keyword
import re
from collections.abc import Iterator

TOKEN = re.compile(r"""(?P<text>(?:\b[rbuf]{1,2})?(?:"{3}[^"\\]*(?:(?:\\.|"(?!""))[^"\\]*)*(?:"{3}|\Z)|'{3}[^'\\]*(?:(?:\\.|'(?!''))[^'\\]*)*(?:'{3}|\Z)
    |"[^"\\\n]*(?:\\.[^"\\\n]*)*"?|'[^'\\\n]*(?:\\.[^'\\\n]*)*'?))
    |(?P<note>\#[^\n]*)|(?P<join>\\\n)|(?P<newline>\n)|(?P<number>\d[\w.]*)|(?P<name>[^\W\d]\w*)
    |(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<sign>\*\*|<<|>>|==|!=|<=|>=|:=|->|[-+*/%&|^@]=|[^\s])""", re.X | re.S | re.I)
BLOCKS = {"if", "elif", "else", "for", "while", "try", "except", "finally", "with", "def", "class", "async", "match", "case"}
RANDOM = {"urandom", "token_bytes", "get_random_bytes"}
#: Integers beyond these bits are of no use as sizes.
WIDEST = 62


class _Bracket:
    __slots__ = ("opened", "closed", "outer", "call", "commas")

    def __init__(self, opened: int, outer: int | None, call: int | None):
        self.opened, self.closed, self.outer, self.call, self.commas = opened, None, outer, call, []


class _Call:
    __slots__ = ("callee", "line", "first", "bracket", "inside", "statement", "plain")

    def __init__(self, callee: str, line: int, first: int, bracket: int, inside: int | None, statement: int, plain: bool):
        self.callee, self.line, self.first, self.bracket = callee, line, first, bracket
        self.inside, self.statement, self.plain = inside, statement, plain


class _Statement:
    __slots__ = ("first", "last", "equals", "colon")

    def __init__(self, first: int):
        self.first, self.last, self.equals, self.colon = first, None, [], None


class Source:
    """The words, brackets, calls and statements of one file."""

    def __init__(self, text: str):
        text = text.replace("\r\n", "\n").replace("\r", "\n")
        self.kinds: list[str] = []
        self.words: list[str] = []
        self.lines: list[int] = []
        self.brackets: list[_Bracket] = []
        self.calls: list[_Call] = []
        self.statements = [_Statement(0)]
        self._read(text)
        self.aliases: dict[str, str] = {}
        self.integers: dict[str, int] = {}
        self.buffers: dict[str, int] = {}
        self.goes_to: dict[int, str | None] = {}
        for s in self.statements:
            self._imports(s)
        for s in self.statements:
            self._integer(s)
        for s in self.statements:
            self._buffer(s)

    def _read(self, text: str) -> None:
        line, inside, statement = 1, None, self.statements[0]
        # the name before a bracket: callee, its line, its first word, whether it starts with a plain name
        callee: tuple[str, int, int, bool] | None = None
        dotted = False
        for m in TOKEN.finditer(text):
            kind, word = m.lastgroup, m.group()
            here = line
            line += word.count("\n")
            if kind in ("note", "join") or kind == "newline" and inside is not None:
                continue
            at = len(self.words)
            if kind == "newline" or kind == "sign" and inside is None and (word == ";" or word == ":" and at > statement.first and self.words[statement.first] in BLOCKS):
                statement.last = at
                statement = _Statement(at + 1)
                self.statements.append(statement)
            self.kinds.append(kind)
            self.words.append(word)
            self.lines.append(here)
            if kind == "name":
                if dotted:
                    callee = (f"{callee[0]}.{word}", *callee[1:]) if callee else None
                elif keyword.iskeyword(word) or at and self.words[at - 1] in ("def", "class"):
                    callee = None
                else:
                    callee = (word, here, at, True)
                dotted = False
            elif kind == "sign" and word == ".":
                dotted = True
                continue
            elif kind == "open":
                call = None
                if word == "(" and callee and not dotted:
                    call = len(self.calls)
                    self.calls.append(_Call(callee[0], callee[1], callee[2], len(self.brackets), inside, len(self.statements) - 1, callee[3]))
                self.brackets.append(_Bracket(at, inside, call))
                inside, callee = len(self.brackets) - 1, None
            elif kind == "close":
                callee = None
                if inside is not None:
                    b = self.brackets[inside]
                    b.closed, inside = at, b.outer
                    if b.call is not None:
                        c = self.calls[b.call]
                        callee = (c.callee, c.line, c.first, False)
            else:
                callee = None
                if word == "," and inside is not None:
                    self.brackets[inside].commas.append(at)
                elif word == "=" and inside is None:
                    statement.equals.append(at)
                elif word == ":" and inside is None and statement.colon is None:
                    statement.colon = at
            dotted = False
        for b in self.brackets:
            if b.closed is None:
                b.closed = len(self.words)
        statement.last = len(self.words)

    def _imports(self, s: _Statement) -> None:
        words = [w for w in self.words[s.first:s.last] if w not in "()"]
        if not words or words[0] not in ("import", "from"):
            return
        module = ""
        if words[0] == "from":
            if "import" not in words:
                return
            cut = words.index("import")
            module = "".join(words[1:cut]).lstrip(".") + "."
            words = words[cut:]
        for part in " ".join(words[1:]).replace(" . ", ".").split(","):
            names = part.split()
            if names:
                plain = names[0] if module else names[0].split(".")[0]
                self.aliases[names[2] if len(names) > 2 and names[1] == "as" else plain] = module + names[0]

    def target(self, s: _Statement) -> str | None:
        """The single name a statement assigns to."""
        if len(s.equals) == 1 and self.kinds[s.first] == "name":
            if s.equals[0] == s.first + 1 or s.colon == s.first + 1:
                return self.words[s.first]
        return None

    def _value(self, s: _Statement) -> tuple[int, int] | None:
        """Words of the assigned value; annotations are left to role refinement."""
        return (s.equals[0] + 1, s.last) if self.target(s) and s.equals[0] == s.first + 1 else None

    def _integer(self, s: _Statement) -> None:
        value = self._value(s)
        if value and value[1] - value[0] == 1:
            n = _literal(self.words[value[0]])
            if n is not None:
                self.integers[self.words[s.first]] = n

    def _buffer(self, s: _Statement) -> None:
        value = self._value(s)
        if value:
            n = self.random_bytes(*value)
            if n:
                self.buffers[self.words[s.first]] = n

    def random_bytes(self, first: int, last: int) -> int | None:
        """Bytes that a call of a random source as a whole expression gives."""
        name = first
        while name + 2 < last and self.words[name + 1] == "." and self.kinds[name] == "name":
            name += 2
        if name + 1 >= last or self.words[name + 1] != "(" or self.canonical("".join(self.words[first:name + 1])).rsplit(".", 1)[-1] not in RANDOM:
            return None
        depth = 0
        for i in range(name + 1, last):
            depth += (self.kinds[i] == "open") - (self.kinds[i] == "close")
            if depth == 1 and self.words[i] == "," or depth == 0:
                return self.integer(name + 2, i)
        return None

    def canonical(self, callee: str) -> str:
        head, dot, rest = callee.partition(".")
        return self.aliases.get(head, head) + dot + rest

    def integer(self, first: int, last: int) -> int | None:
        """A literal, a named constant, or products and left shifts of these."""
        while last - first > 2 and self.words[first] == "(" and self.words[last - 1] == ")" and ")" not in self.words[first:last - 1]:
            first, last = first + 1, last - 1
        words = self.words[first:last]
        if len(words) % 2 == 0 or any(w not in ("*", "<<") for w in words[1::2]):
            return None
        out, product = None, None
        for k in range(0, len(words), 2):
            n = _literal(words[k])
            n = self.integers.get(words[k]) if n is None else n
            if n is None:
                return None
            if k and words[k - 1] == "*":
                product *= n
            else:
                out, product = _shifted(out, product), n
            if product is None or product.bit_length() > WIDEST:
                return None
        out = _shifted(out, product)
        return out if out is not None and out.bit_length() <= WIDEST else None

    def arguments(self, call: _Call) -> Iterator[tuple[str, int, int]]:
        """(position or keyword, first word, end) of a call's arguments."""
        b = self.brackets[call.bracket]
        ends, first, place = [*b.commas, b.closed], b.opened + 1, 0
        for end in ends:
            if first < end:
                if end - first > 1 and self.kinds[first] == "name" and self.words[first + 1] == "=":
                    yield self.words[first], first + 2, end
                else:
                    yield str(place), first, end
                    place += 1
            first = end + 1

    def owner(self, call: _Call) -> tuple[str, int] | None:
        """What a whole call is: a positional argument of a call, or a statement's value."""
        first, last, inside = call.first, self.brackets[call.bracket].closed, call.inside
        while inside is not None:
            b = self.brackets[inside]
            before, after = self.words[first - 1], self.words[last + 1] if last + 1 < len(self.words) else ")"
            if self.words[b.opened] != "(" or not (first - 1 == b.opened or before == ",") or not (last + 1 == b.closed or after == ","):
                return None
            if b.call is not None:
                return "call", b.call
            if b.commas:
                return None
            first, last, inside = b.opened, b.closed, b.outer
        s = self.statements[call.statement]
        return ("value", call.statement) if s.equals and first == s.equals[-1] + 1 and last + 1 == s.last else None

    def assigned(self, k: int) -> str | None:
        """The name a call's result goes to, directly or through calls around it."""
        passed = []
        while k not in self.goes_to:
            passed.append(k)
            o = self.owner(self.calls[k])
            if o and o[0] == "call":
                k = o[1]
            else:
                self.goes_to[k] = self.target(self.statements[o[1]]) if o else None
        for p in passed:
            self.goes_to[p] = self.goes_to[k]
        return self.goes_to[k]


def _literal(word: str) -> int | None:
    try:
        return int(word, 0) if word[0].isdigit() else None
    except ValueError:
        return None


def _shifted(value: int | None, by: int | None) -> int | None:
    if value is None or by is None:
        return by if value is None else value
    return value << by if 0 <= by <= WIDEST else None


def _text(words: list[str]) -> str:
    out: list[str] = []
    for w in words:
        if out and (out[-1][-1].isalnum() or out[-1][-1] == "_") and (w[0].isalnum() or w[0] == "_"):
            out.append(" ")
        out.append(w)
    return "".join(out)


def find_calls(text: str | None, leaves: set[str], keywords: set[str], methods: set[str], modes: set[str]) -> list[dict]:
    """Calls whose name, or what an import makes of it, ends in one of the leaves."""
    if not text:
        return []
    source = Source(text)
    lines = re.split("\r\n|\n|\r", text)
    uses: dict[str, tuple[int, int, str]] = {}
    children: dict[int, list[str]] = {}
    picked = []
    for k, c in enumerate(source.calls):
        base, _, method = c.callee.partition(".")
        if c.plain and method in methods:
            uses[base] = min(uses.get(base, (c.line, k, method)), (c.line, k, method))
        canon = source.canonical(c.callee)
        leaf = c.callee.rsplit(".", 1)[-1]
        if leaf.lower() in modes and (o := source.owner(c)) and o[0] == "call":
            children.setdefault(o[1], []).append(leaf.lower())
        if canon.rsplit(".", 1)[-1] in leaves or leaf in leaves:
            picked.append((k, c, canon))
    out = []
    for k, c, canon in picked:
        args, integers, sizes = {}, {}, {}
        for name, first, end in source.arguments(c):
            if name in keywords:
                args[name] = _text(source.words[first:end])
                n = source.integer(first, end)
                if n is not None:
                    integers[name] = n
                size = source.buffers.get(args[name]) or source.random_bytes(first, end)
                if size:
                    sizes[name] = size
        o = source.owner(c)
        target = source.assigned(k)
        out.append({"line": c.line, "k": k, "callee": c.callee, "canon": canon, "args": args, "integers": integers, "sizes": sizes,
                    "method": uses[target][2] if target in uses else None,
                    "sibling": children.get(o[1], [None])[0] if o and o[0] == "call" else None, "text": lines[c.line - 1]})
    return out
