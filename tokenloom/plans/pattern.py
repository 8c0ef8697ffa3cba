"""Patterns: the YAML file, templates, and the parts of a pattern text.

A pattern text is a sequence of tokens of its language with these besides: $X (a string or identifier, captured as X;
a later $X must be equal), $_ (any), $_X (captured, but left out of findings), %X (replaces X), ellipses (... ..} ..!
..>), `..* body ..| body ..*` (repeated), `..- a ..| b ..-` (one of them), `..^` and `..$` (the span begins at the next
token, ends at the last one), and {{T}} (each value of template T). `$ X` is a dollar sign before X.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass, field, replace

import yaml

from tokenloom.functions.regex import RegexError, java_regex
from tokenloom.sources.languages import BY_ALIAS
from tokenloom.sources.store import list_files, read_content

TEMPLATES = 64


class PatternError(ValueError):
    """A pattern that cannot be compiled."""


@dataclass(frozen=True)
class Item:
    """One part of a pattern.

    kind: token (with a text), capture, back, any, replace, pop, skip (an ellipsis, named in text), repeat or either.
    """

    kind: str
    text: str = ""
    start: bool = False
    end: bool = False
    branches: tuple[tuple[Item, ...], ...] = ()


@dataclass(frozen=True)
class Pattern:
    items: tuple[Item, ...]
    languages: tuple[str, ...]
    name: str = ""
    group: str = ""
    unique: bool = False
    cancel: bool = False
    match: tuple[str, ...] = ()
    out: tuple[tuple[str, str], ...] = ()
    transform: tuple[tuple[str, str], ...] = ()
    captures: tuple[str, ...] = ()
    source: str = field(default="", compare=False)


def expand(pattern: str, templates: dict[str, list[str]], most: int = TEMPLATES) -> list[str]:
    """The pattern with every combination of values; a template that occurs twice has one value in both places."""
    names = list(dict.fromkeys(re.findall(r"\{\{(\w+)\}\}", pattern)))
    if missing := [n for n in names if n not in templates]:
        raise PatternError(f"missing template {missing[0]}")
    combinations = list(itertools.islice(itertools.product(*(templates[n] for n in names)), most + 1))
    if len(combinations) > most:
        raise PatternError(f"exceeded cfg limit of {most} template expansions")
    return [re.sub(r"\{\{(\w+)\}\}", lambda m: values[m[1]], pattern) for values in (dict(zip(names, c, strict=True)) for c in combinations)]


def _words(text: str, lang: str) -> list[tuple[str, str]]:
    """(kind, text) of the tokens of a pattern."""
    python = lang == "py"
    comment = r"\#[^\n]*" if python else r"//[^\n]*|/\*[\s\S]*?\*/"
    quotes = "\"'`" if lang in ("go", "js", "ts", "kotlin") else '"' if lang == "rust" else "\"'"
    strings = "|".join(rf"{q}(?:[^{q}\\]|\\[\s\S])*{q}" for q in quotes) + (r"|'[A-Za-z_]'|''|'[^A-Za-z_'][^']*'" if lang == "rust" else "")
    if python:
        strings = "\"\"\"[\\s\\S]*?\"\"\"|'''[\\s\\S]*?'''|" + strings
    line = r"(?P<line>\n[ \t]*)|" if python else ""
    rx = re.compile(rf"(?P<skip>{comment})|{line}(?P<blank>[\x00-\x20\x7f]+)|(?P<string>{strings})|(?P<op>\.\.[.}}!>*|\-^$])|(?P<mark>[$%])(?:(?P<name>[A-Za-z_0-9\x80-\U0010ffff]+)|[ \t\n]+)?|(?P<word>[A-Za-z_\x80-\U0010ffff][A-Za-z0-9_\x80-\U0010ffff]*|[0-9][0-9_]*)|(?P<byte>[\s\S])")
    out: list[tuple[str, str]] = []
    for m in rx.finditer(text):
        if m["string"]:
            width = 3 if python and len(m["string"]) >= 6 and m["string"][:3] in ('"""', "'''") else 1
            out.append(("string", m["string"][width:-width]))
        elif m["op"]:
            out.append(("op", m["op"][2]))
        elif m["mark"]:
            out.append((m["mark"], m["name"]) if m["name"] else ("byte", m["mark"]))
        elif m["word"]:
            out.append(("word", m["word"]))
        elif m["byte"]:
            out.append(("byte", m["byte"]))
        elif python and m["line"]:
            out.append(("line", m["line"]))
    return out


def _folded(words: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Neighbouring strings joined, as in source text."""
    out: list[tuple[str, str]] = []
    for k, w in enumerate(words):
        if w[0] == "string" and out and out[-1][0] == "string":
            out[-1] = ("string", out[-1][1] + w[1])
        elif not (w in (("byte", "+"), ("byte", "\\")) and out and out[-1][0] == "string" and k + 1 < len(words) and words[k + 1][0] == "string"):
            out.append(w)
    return out


def parse(text: str, lang: str, max_length: int = 5000) -> tuple[tuple[Item, ...], tuple[str, ...]]:
    """(items, names of captures in the order of their creation) of one pattern text."""
    known: list[str] = []
    brackets: list[str] = []
    stack: list[tuple[str, list[list[Item]], list[str]]] = [("", [[]], [])]  # kind, branches, captures before it
    fresh: list[str] = []  # created in this repetition and not popped yet
    begin = False
    indents: list[int] = []
    round_open = 0

    def add(item: Item) -> None:
        nonlocal begin
        branch = stack[-1][1][-1]
        if item.kind == "skip":
            if len(stack) > 1 and not branch:
                raise PatternError("an ellipsis may not come first in a repetition or alternation branch")
            if branch and branch[-1].kind == "skip":
                if branch[-1].text != item.text:
                    raise PatternError("incompatible ellipsis combination")
                return
            branch.append(item)
            return
        branch.append(replace(item, start=begin and len(stack) == 1))  # spans are not set inside repetition and alternation
        begin = False

    words = _folded(_words(text, lang))
    while words and words[-1][0] == "line":
        words.pop()
    for kind, word in words:
        if len(word.encode()) > max_length:
            raise PatternError("token too long")
        if kind == "op":
            if word == ".":
                add(Item("skip", {"(": "round", "[": "square", "{": "curly"}[brackets[-1]] if brackets else "free"))
            elif word in "}!>":
                add(Item("skip", {"}": "scope", "!": "statement", ">": "corner"}[word]))
            elif word == "^":
                begin = True
            elif word == "$":
                branch = stack[-1][1][-1]
                for i in range(len(branch) - 1, -1, -1) if len(stack) == 1 else ():
                    if branch[i].kind != "skip":
                        branch[i] = replace(branch[i], end=True)
                        break
            elif word == "|":
                if len(stack) == 1:
                    raise PatternError("..| only allowed in repitition or alternation")
                if fresh:
                    raise PatternError("a repitition must have a sum of zero captures created")
                stack[-1][1].append([])
            else:
                wanted = {"*": "repeat", "-": "either"}[word]
                if stack[-1][0] == wanted:
                    _, branches, _ = stack.pop()
                    if fresh:
                        raise PatternError("a repitition must have a sum of zero captures created")
                    if wanted == "repeat":
                        branches = [b for b in branches if b]
                    add(Item(wanted, branches=tuple(map(tuple, branches))))
                elif len(stack) > 1:
                    raise PatternError("repetition inside alternation and alternation inside repetition are not allowed")
                else:
                    stack.append((wanted, [[]], list(known)))
        elif kind == "$":
            if word == "_":
                add(Item("any"))
            elif word in known or word in fresh:
                add(Item("back", word))
            elif stack[-1][0] == "either":
                raise PatternError("creating captures inside alternation is not allowed")
            else:
                (fresh if stack[-1][0] == "repeat" else known).append(word)
                add(Item("capture", word))
        elif kind == "%":
            if word not in known:
                raise PatternError("replace must reference an existing capture")
            add(Item("pop", f"{fresh.pop()}\n{word}") if stack[-1][0] == "repeat" and fresh else Item("replace", word))
        elif kind == "line":
            if round_open:
                continue
            amount, change = 0, 0
            for c in word[1:]:
                amount = (amount // 8 + 1) * 8 if c == "\t" else amount + 1
            while indents and indents[-1] > amount:
                indents.pop()
                change -= 1
            if not indents or indents[-1] < amount:
                change += bool(indents) or amount > 0
                indents.append(amount)
            add(Item("level", str(int(change))))
        else:
            if kind == "byte":
                round_open = max(0, round_open + {"(": 1, ")": -1}.get(word, 0))
                if word in "([{":
                    brackets.append(word)
                elif word in ")]}" and brackets and brackets[-1] == {")": "(", "]": "[", "}": "{"}[word]:
                    brackets.pop()
            add(Item("byte" if kind == "byte" else "token", f'"{word}"' if kind == "string" else word))
    if len(stack) > 1:
        raise PatternError(f"unclosed {'repitition' if stack[-1][0] == 'repeat' else 'alternation'}")
    return tuple(stack[0][1][0]), tuple(known)


FIELDS = {"patterns", "languages", "name", "group", "out", "transform", "templates"}


def load(text: str, path: str = "", most: int = TEMPLATES, max_length: int = 5000) -> list[Pattern]:
    """The patterns of a YAML file: each text, template combination and language."""
    try:
        data = yaml.safe_load(text)
        if not isinstance(data, dict) or set(data) - FIELDS or not {"patterns", "languages"} <= set(data):
            raise ValueError(f"fields must be among {sorted(FIELDS)}, with patterns and languages")
        group = data.get("group") or {}
        if group and "name" not in group:
            raise ValueError("group needs a name")
        languages = [BY_ALIAS[x] for x in data["languages"]]
    except (yaml.YAMLError, KeyError, ValueError) as e:
        raise PatternError(f"YAML load {path}: {e}") from e
    transform = tuple((data.get("transform") or {}).items())
    for _, rx in transform:
        try:
            java_regex(rx)
        except RegexError as e:
            raise PatternError(f"regex compilation error of '{rx}': {e}") from e
    found = []
    for source in data["patterns"]:
        for one in expand(source, {k: list(v) for k, v in (data.get("templates") or {}).items()}, most):
            by_items: dict[tuple, list[str]] = {}
            for lang in dict.fromkeys(languages):
                by_items.setdefault(parse(one, lang, max_length), []).append(lang)
            for (items, captures), langs in by_items.items():
                found.append(Pattern(items, tuple(langs), data.get("name") or "", group.get("name", ""), bool(group.get("unique")), bool(group.get("cancel")), tuple(group.get("match") or ()), tuple((data.get("out") or {}).items()), transform, captures, one))
    return found


def load_files(spark, path: str, most: int = TEMPLATES, max_length: int = 5000) -> list[Pattern]:
    """The patterns of all .yml and .yaml files under path, in the order of their paths."""
    rows = read_content(list_files(spark, path).where("path rlike '[.]ya?ml$'"))
    return [p for r in sorted(rows.collect()) for p in load(bytes(r.content).decode(), f"{path}/{r.file}" if r.file else path, most, max_length)]
