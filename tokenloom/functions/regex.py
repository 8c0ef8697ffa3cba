"""The regular expressions of rule files, written for Java's engine.

Rule files use a small dialect: classes and word boundaries are ASCII, `$` is the very end, `a*+` is a repeated repetition,
there are no look-arounds, back-references, Unicode classes or class operations. What is not in it is an error when a
rule is loaded, not in a task.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

# Named ASCII classes.
CLASSES = {
    "alnum": r"0-9A-Za-z", "alpha": r"A-Za-z", "ascii": r"\x00-\x7F", "blank": r"\t ", "cntrl": r"\x00-\x1F\x7F", "digit": r"0-9", "graph": r"!-~",
    "lower": r"a-z", "print": r" -~", "punct": r"!-/:-@\[-`{-~", "space": r"\t\n\x0B\f\r ", "upper": r"A-Z", "word": r"0-9A-Za-z_", "xdigit": r"0-9A-Fa-f",
}
_PERL = {"d": CLASSES["digit"], "s": CLASSES["space"], "w": CLASSES["word"]}
_CONTROL = {"a": 7, "f": 12, "t": 9, "n": 10, "r": 13, "v": 11}
_IN, _BEFORE, _AFTER = "[0-9A-Za-z_]", "(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])"
_START, _END = f"{_BEFORE}(?={_IN})", f"(?<={_IN}){_AFTER}"
_EDGE = f"(?:{_START}|{_END})"
_EDGES = {"start": _START, "end": _END, "start-half": _BEFORE, "end-half": _AFTER}
#: Largest count of a repetition, and deepest nesting.
_MOST, _DEEPEST = 100_000, 50


class RegexError(ValueError):
    """An expression that the dialect does not have."""


@dataclass(frozen=True)
class Flags:
    i: bool = False
    m: bool = False
    s: bool = False
    U: bool = False
    x: bool = False


def _literal(point: int) -> str:
    return chr(point) if point < 128 and chr(point).isalnum() else f"\\x{{{point:X}}}"


class _Reader:
    def __init__(self, text: str):
        self.text, self.at, self.groups, self.depth = text, 0, 0, 0
        self.names: dict[str, int] = {}

    def peek(self, n: int = 1) -> str:
        return self.text[self.at : self.at + n]

    def take(self, n: int = 1) -> str:
        out = self.peek(n)
        if len(out) < n:
            raise RegexError("ends too early")
        self.at += n
        return out

    def blank(self, flags: Flags) -> None:
        while flags.x and self.at < len(self.text):
            if self.peek().isspace():
                self.at += 1
            elif self.peek() == "#":
                end = self.text.find("\n", self.at)
                self.at = len(self.text) if end < 0 else end + 1
            else:
                return

    def alternatives(self, flags: Flags) -> str:
        self.depth += 1
        if self.depth > _DEEPEST:
            raise RegexError("nested too deeply")
        out, last = "", None
        while True:
            self.blank(flags)
            c = self.peek()
            if not c or c == ")":
                break
            if c == "|":
                self.at += 1
                out, last = out + (last or "") + "|", None
            elif c in "*+?{":
                if last is None:
                    raise RegexError("a repetition of nothing")
                last = self.repeated(last, flags)
            else:
                out += last or ""
                if self.peek(2) == "(?" and (new := self.switched(flags)) is not None:
                    flags, last = new, None
                else:
                    last = self.atom(flags)
        self.depth -= 1
        return out + (last or "")

    def repeated(self, atom: str, flags: Flags) -> str:
        how = self.take()
        if how == "{":
            end = self.text.find("}", self.at)
            low, comma, high = self.text[self.at : end].partition(",") if end > 0 else ("", "", "")
            if not low.isascii() or not low.isdigit() or high and not (high.isascii() and high.isdigit()):
                raise RegexError("a count that is none")
            if int(low) > _MOST or high and not int(low) <= int(high) <= _MOST:
                raise RegexError("counts out of order, or too large")
            how, self.at = f"{{{int(low)}{comma}{int(high) if high else ''}}}", end + 1
        self.blank(flags)
        lazy = self.peek() == "?"
        self.at += lazy
        return f"(?:{atom}){how}{'?' if lazy != flags.U else ''}"

    def switched(self, flags: Flags) -> Flags | None:
        """The flags after (?...), which the reader passes; None if it is a group."""
        end = self.at + 2
        while end < len(self.text) and self.text[end] in "imsUxR-":
            end += 1
        if end == self.at + 2 or self.text[end : end + 1] != ")":
            return None
        new = self.flags(self.text[self.at + 2 : end], flags)
        self.at = end + 1
        return new

    @staticmethod
    def flags(text: str, flags: Flags) -> Flags:
        on, minus, off = text.partition("-")
        if minus and not off or set(on + off) - set("imsUx") or len(set(on + off)) < len(on + off):
            raise RegexError(f"flags {text}")
        return replace(flags, **dict.fromkeys(on, True), **dict.fromkeys(off, False))

    def atom(self, flags: Flags) -> str:
        c = self.take()
        if c == "(":
            return self.group(flags)
        if c == "[":
            return self.folded(self.listed(), flags)
        if c == ".":
            return "(?s:.)" if flags.s else r"[^\n]"
        if c == "^":
            return r"(?<![^\n])" if flags.m else r"\A"
        if c == "$":
            return r"(?![^\n])" if flags.m else r"\z"
        if c == "\\":
            return self.escaped(flags)
        return self.folded(_literal(ord(c)), flags)

    @staticmethod
    def folded(text: str, flags: Flags) -> str:
        return f"(?i:{text})" if flags.i else text

    def group(self, flags: Flags) -> str:
        opening = "("
        if self.peek() == "?":
            self.at += 1
            if self.peek(2) == "P<" or self.peek() == "<" and self.peek(2) not in ("<=", "<!"):
                self.at += 1 + (self.peek() == "P")
                name, closed, _ = self.text[self.at :].partition(">")
                if not closed or not (name[:1].isalpha() or name[:1] == "_") or not all(x.isalnum() or x in "_.[]" for x in name) or name in self.names:
                    raise RegexError(f"group name {name}")
                self.at += len(name) + 1
                self.names[name] = self.groups + 1
            else:
                text, colon, _ = self.text[self.at :].partition(":")
                if not colon or set(text) - set("imsUxR-"):
                    raise RegexError("look-arounds and other kinds of groups are not supported")
                flags = self.flags(text, flags) if text else flags
                self.at += len(text) + 1
                opening = "(?:"
        self.groups += opening == "("
        out = f"{opening}{self.alternatives(flags)})"
        if self.peek() != ")":
            raise RegexError("an open group")
        self.at += 1
        return out

    def point(self, kind: str) -> int:
        """The code point after \\x, \\u or \\U."""
        if self.peek() == "{":
            digits, closed, _ = self.text[self.at + 1 :].partition("}")
            self.at += len(digits) + 2
        else:
            digits, closed = self.take({"x": 2, "u": 4, "U": 8}[kind]), "}"
        try:
            found = int(digits, 16) if closed and digits.isalnum() else -1
        except ValueError:
            found = -1
        if not 0 <= found <= 0x10FFFF or 0xD800 <= found < 0xE000:
            raise RegexError(f"code point {digits}")
        return found

    def simple(self, c: str) -> int | None:
        """The code point of an escaped character, in classes and outside."""
        if c in _CONTROL:
            return _CONTROL[c]
        if c in "xuU":
            return self.point(c)
        if c.isascii() and not c.isalnum() and c not in "<>" and c.isprintable():
            return ord(c)
        return None

    def escaped(self, flags: Flags) -> str:
        c = self.take()
        if c.lower() in _PERL:
            return f"[{'^' if c.isupper() else ''}{_PERL[c.lower()]}]"
        if c in "Az":
            return f"\\{c}"
        if c == "b" and self.peek() == "{":
            name, closed, _ = self.text[self.at + 1 :].partition("}")
            if closed and name in _EDGES:
                self.at += len(name) + 2
                return _EDGES[name]
        if c in "bB<>":
            return {"b": _EDGE, "B": f"(?!{_EDGE})", "<": _START, ">": _END}[c]
        if (found := self.simple(c)) is None:
            raise RegexError(f"\\{c}")
        return self.folded(_literal(found), flags)

    def listed(self) -> str:
        """A class after its bracket."""
        negated = self.peek() == "^"
        self.at += negated
        out: list[str] = []
        first = True
        while True:
            c = self.take()
            if c == "]" and not first:
                break
            first = False
            if c == "[":
                name, closed, _ = self.text[self.at :].partition(":]")
                no = name[1:2] == "^"
                if name[:1] != ":" or not closed or name[1 + no :] not in CLASSES:
                    raise RegexError("a class in a class")
                self.at += len(name) + 2
                out.append(f"[{'^' if no else ''}{CLASSES[name[1 + no :]]}]")
                continue
            if c + self.peek() in ("&&", "--", "~~"):
                raise RegexError("operations on classes are not supported")
            if c == "\\":
                e = self.take()
                if e.lower() in _PERL:
                    out.append(f"[{'^' if e.isupper() else ''}{_PERL[e.lower()]}]")
                    continue
                low = self.simple(e)
                if low is None:
                    raise RegexError(f"\\{e} in a class")
            else:
                low = ord(c)
            high = low
            if self.peek() == "-" and self.peek(2) not in ("-]", "--"):
                self.at += 1
                d = self.take()
                high = self.simple(self.take()) if d == "\\" else ord(d)
                if high is None or d == "[" or high < low:
                    raise RegexError("a range in a class")
            out.append(f"{_literal(low)}-{_literal(high)}" if high > low else _literal(low))
        return f"[{'^' if negated else ''}{''.join(out)}]" if not negated or all(not x.startswith("[") for x in out) else f"(?!{_union(out)})(?s:.)"


def _union(parts: list[str]) -> str:
    return f"[{''.join(parts)}]"


def java_regex(text: str) -> tuple[str, dict[str, int]]:
    """The expression for Java, and the number of each named group."""
    reader = _Reader(text)
    out = reader.alternatives(Flags())
    if reader.at < len(text):
        raise RegexError("a closing bracket without an open one")
    return out, reader.names
