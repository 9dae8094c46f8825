"""Line spans of code constructs: one function per language, over a file's lines.

A found span is (start, end, name, kind, signature, doc), lines from 1, ends inclusive.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

WINDOW, OVERLAP = 60, 10


class Span(NamedTuple):
    start: int
    end: int
    name: str
    kind: str
    signature: str = ""
    doc: str = ""


Finder = Callable[[str, list[str]], list[Span]]


def split_lines(text: str) -> list[str]:
    return text.replace("\r\n", "\n").split("\n")


def stem_of(path: str) -> str:
    base = re.split(r"[/\\]", path)[-1]
    return base.rsplit(".", 1)[0] if "." in base[1:] else base


def windows(path: str, lines: list[str]) -> list[Span]:
    """Overlapping windows; the last one ends at the last line."""
    n, out, start = len(lines), [], 1
    while True:
        end = min(n, start + WINDOW - 1)
        out.append(Span(start, end, f"window@{start}", "window", f"{path} lines {start}-{end}"))
        if end == n:
            return out
        start += WINDOW - OVERLAP


def balanced(lines: list[str], start: int, opening: str = "{", closing: str = "}", stop: str = "") -> int | None:
    """Index of the first line from ``start`` at whose end nothing is open after something was; None if nothing ever opens.

    With ``stop``, a character that ends a construct before its first bracket, either must
    come by the next line; else the construct is its first line."""
    level, steps = 0, {c: 1 for c in opening} | {c: -1 for c in closing}
    head = "\n".join(lines[start : start + 2] if stop else lines[start:])
    first = next((k for k, c in enumerate(head) if c in opening or c == stop), None)
    if first is None:
        return start if stop else None
    begun = start + head.count("\n", 0, first)
    if head[first] == stop:
        return begun
    for j in range(start, len(lines)):
        level += sum(steps.get(c, 0) for c in lines[j])
        if level <= 0 and j >= begun:
            return j
    return len(lines) - 1


def outermost(found: list[tuple[int, int, Span]], swallow: Callable[[Span], bool] = lambda s: True) -> list[Span]:
    """Spans in line order without those that begin inside an earlier one."""
    out, last = [], -1
    for line, end, span in found:
        if line > last:
            out.append(span)
            if swallow(span):
                last = end
    return out


def comment_above(lines: list[str], line: int, loose: int = 0) -> str:
    """The comment block that ends right above a line; up to ``loose`` blank or import lines may lie between."""
    j = line - 1
    while loose and j >= 0 and (not lines[j].strip() or lines[j].strip().startswith("import ")):
        j, loose = j - 1, loose - 1
    block: list[str] = []
    if j >= 0 and lines[j].strip().endswith("*/"):
        while j >= 0:
            block.append(lines[j].strip())
            if block[-1].startswith("/*"):
                break
            j -= 1
        cleaned = [re.sub(r"^/\*+|\*+/$|^\*", "", x).strip() for x in reversed(block)]
    else:
        while j >= 0 and lines[j].strip().startswith("//"):
            block.append(lines[j].strip())
            j -= 1
        cleaned = [x.lstrip("/").strip() for x in reversed(block)]
    return "\n".join(x for x in cleaned if x)


def scan(lines: list[str], rules: list[tuple[re.Pattern, str]], skip: frozenset[str] = frozenset()) -> Iterator[tuple[int, str, str]]:
    """(line index, name, kind) for the first rule that each line meets."""
    for i, line in enumerate(lines):
        for pattern, kind in rules:
            if m := pattern.match(line):
                name = m[1] if m.groups() else ""
                if name not in skip:
                    yield i, name, kind
                break


# Constructs of each language and their kinds.
JS_RULES = [
    (re.compile(r"\s*export\s+default\b", re.A), "component"),
    (re.compile(r"\s*(?:export\s+)?(?:async\s+)?function\s+([A-Za-z_$][\w$]*)", re.A), "func"),
    (re.compile(r"\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=", re.A), "var"),
    (re.compile(r"\s*(?:async\s+)?([A-Za-z_$][\w$]*)\s*\([^()]*\)\s*\{", re.A), "method"),
]
JS_KEYWORDS = frozenset("if for while switch catch return else do function new throw".split())
QML_RULES = [
    (re.compile(r"\s*function\s+([A-Za-z_]\w*)\s*\(", re.A), "function"),
    (re.compile(r"\s*signal\s+([A-Za-z_]\w*)\b", re.A), "signal"),
    (re.compile(r"\s*(?:readonly\s+)?property\s+[a-zA-Z_]\w*\s+([A-Za-z_]\w*)", re.A), "property"),
    (re.compile(r"\s*([A-Z][a-zA-Z0-9_]*)\s*\{", re.A), "component"),
]
CSS_RULE = re.compile(r"([^{]+)\{")
SHELL_RULE = re.compile(r"\s*(?:function\s+)?([A-Za-z_]\w*)\s*\(\)", re.A)
JSON_RULE = re.compile(r'\s*"([^"]+)"\s*:\s*[{\[]')
HEADING = re.compile(r"(#{1,6})\s+(.+)$", re.A)
HTML_BLOCK = re.compile(r"<(?:h[1-6]|section|article|script|style|div)(?:[\t\n\f\r ]|>|/)")
YAML_KEY, YAML_BREAK = re.compile(r"([A-Za-z_]\w*)\s*:", re.A), re.compile(r"---\s*$", re.A)
TOML_SECTION, INI_SECTION = re.compile(r"\[\[*([^\]]+)\]\]?"), re.compile(r"\[([^\]]+)\]")
GO_FUNC = re.compile(r"func\s+(\([^)]*\)\s*)?([A-Za-z_]\w*)", re.A)
GO_GROUP = re.compile(r"(var|const|type)\s*\(\s*$", re.A)
GO_ONE = re.compile(r"(var|const|type)\s+([A-Za-z_]\w*)", re.A)
GO_SPEC = re.compile(r"\s+([A-Za-z_]\w*)", re.A)
PY_DEF = re.compile(r"(?:async\s+def|def|class)\s+([A-Za-z_]\w*)", re.A)
PY_ASSIGN = re.compile(r"([A-Za-z_]\w*)\s*=[^=]", re.A)


def javascript(path: str, lines: list[str]) -> list[Span]:
    found = []
    for i, name, kind in scan(lines, JS_RULES, JS_KEYWORDS):
        end = balanced(lines, i, stop=";")
        doc = comment_above(lines, i) or (comment_above(lines, i, 6) if kind == "component" else "")
        found.append((i, end, Span(i + 1, end + 1, name or stem_of(path), kind, lines[i].strip(), doc)))
    return outermost(found, lambda s: s.kind != "component")


def vue(path: str, lines: list[str]) -> list[Span]:
    def section(tag: str) -> tuple[int, int]:
        opened = [i for i, x in enumerate(lines) if re.search(rf"<{tag}[\s>]", x, re.I)]
        closed = [i for i, x in enumerate(lines) if re.search(rf"</{tag}>", x, re.I)]
        return (opened[0] if opened else -1), (closed[-1] if closed else -1)

    out: list[Span] = []
    a, b = section("script")
    if 0 <= a < b:
        inner = [s._replace(start=s.start + a + 1, end=s.end + a + 1) for s in javascript(path, lines[a + 1 : b])]
        if not any(s.kind == "component" for s in inner):
            inner.append(Span(a + 2, b + 1, stem_of(path), "component", lines[a + 1].strip()))
        out += inner
    a, b = section("template")
    if 0 <= a < b:
        out.append(Span(a + 1, b + 1, "template", "template", "<template>"))
    return out


def qml(path: str, lines: list[str]) -> list[Span]:
    found = []
    for i, name, kind in scan(lines, QML_RULES):
        end = balanced(lines, i, stop=";")
        found.append((i, end, Span(i + 1, end + 1, name, kind, lines[i].strip(), comment_above(lines, i))))
    return outermost(found)


def css(path: str, lines: list[str]) -> list[Span]:
    found = []
    for i, line in enumerate(lines):
        if m := CSS_RULE.match(line):
            end = balanced(lines, i)
            found.append((i, end, Span(i + 1, end + 1, m[1].strip(), "rule", m[1].strip())))
    return outermost(found)


def shell(path: str, lines: list[str]) -> list[Span]:
    found = []
    for i, line in enumerate(lines):
        if m := SHELL_RULE.match(line):
            end = balanced(lines, i)
            end = len(lines) - 1 if end is None else max(end, min(i + 1, len(lines) - 1))
            found.append((i, end, Span(i + 1, end + 1, m[1], "function", line.strip())))
    return outermost(found)


def json_keys(path: str, lines: list[str]) -> list[Span]:
    found = []
    for i, line in enumerate(lines):
        if m := JSON_RULE.match(line):
            end = balanced(lines, i, "{[", "}]")
            found.append((i, end, Span(i + 1, end + 1, m[1], "key", m[1])))
    if found:
        return outermost(found)
    try:
        whole = json.loads("\n".join(lines))
    except ValueError:
        return []
    return [Span(1, 1, k, "key", f"${k}") for k in whole] if isinstance(whole, dict) else []


def until_next(starts: list[tuple[int, Span]], n: int) -> list[Span]:
    """Each span runs to the line before the next start, the last to the end."""
    ends = [*(i for i, _ in starts[1:]), *([n] if starts else [])]
    return [s._replace(start=i + 1, end=e) for (i, s), e in zip(starts, ends, strict=True)]


def markdown(path: str, lines: list[str]) -> list[Span]:
    starts = [(i, Span(0, 0, m[2].strip(), f"h{len(m[1])}", x.strip())) for i, x in enumerate(lines) if (m := HEADING.match(x))]
    return until_next(starts, len(lines))


def html(path: str, lines: list[str]) -> list[Span]:
    starts = [(i, Span(0, 0, f"block@{i + 1}", "block")) for i, x in enumerate(lines) if HTML_BLOCK.search(x.lower())]
    return until_next(starts, len(lines))


def sections(pattern: re.Pattern) -> Finder:
    def find(path: str, lines: list[str]) -> list[Span]:
        starts = [(i, Span(0, 0, m[1].strip(), "section")) for i, x in enumerate(lines) if (m := pattern.match(x))]
        return until_next(starts, len(lines))

    return find


def yaml(path: str, lines: list[str], compat: bool = False) -> list[Span]:
    """Top-level keys, each to the line before the next key or document mark. With
    ``compat`` a span is its last line only."""
    marks = [i for i, x in enumerate(lines) if YAML_KEY.match(x) or YAML_BREAK.match(x)] + [len(lines)]
    out = []
    for i, nxt in zip(marks, marks[1:], strict=False):
        if m := YAML_KEY.match(lines[i]):
            start = nxt if compat else i + 1
            out.append(Span(start, nxt, m[1], "key", lines[nxt - 1 if compat else i].strip()))
    return out


def python(path: str, lines: list[str]) -> list[Span]:
    n, out = len(lines), []
    top = [bool(x) and x[0] not in " \t" and bool(x.strip()) and not x.startswith("#") for x in lines]
    doc, end = docstring(lines, 0)
    if doc:
        out.append(Span(1, end, "module", "module", path, doc))
    following = [n] * (n + 1)
    for i in range(n - 1, -1, -1):
        following[i] = i if top[i] else following[i + 1]
    for i in (i for i in range(n) if top[i]):
        line = lines[i].strip()
        if m := PY_DEF.match(line):
            start, j = i, i - 1
            while j >= 0 and (not lines[j].strip() or lines[j].startswith("@")):
                start = j if lines[j].startswith("@") else start
                j -= 1
            kind = "class" if line.startswith("class") else "func"
            out.append(Span(start + 1, following[i + 1], m[1], kind, line.rstrip(":"), docstring(lines, i + 1)[0]))
        elif m := PY_ASSIGN.match(line):
            out.append(Span(i + 1, i + 1, m[1], "var", line))
    return out


def docstring(lines: list[str], at: int) -> tuple[str, int]:
    """The docstring that the first non-blank line from ``at`` opens, and its last line (from 1)."""
    at = next((i for i in range(at, len(lines)) if lines[i].strip()), len(lines))
    rest = "\n".join([lines[at].strip(), *lines[at + 1 :]]) if at < len(lines) else ""
    for quote in ('"""', "'''"):
        if rest.startswith(quote):
            body, closed, _ = rest[3:].partition(quote)
            return body.strip(), at + 1 + body.count("\n") if closed else len(lines)
    return "", 0


def blanked(lines: list[str]) -> list[str]:
    """Lines of Go with the inside of strings and comments turned to spaces."""
    pattern = re.compile(r'"(?:\\.|[^"\\\n])*"|`[^`]*`|\'(?:\\.|[^\'\\\n])+\'|//[^\n]*|/\*.*?\*/', re.S)
    return pattern.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), "\n".join(lines)).split("\n")


def go(path: str, lines: list[str]) -> list[Span]:
    clear, out, depth, i = blanked(lines), [], 0, 0

    def lead(line: int) -> tuple[int, str]:
        top = line
        while top and lines[top - 1].strip().startswith("//"):
            top -= 1
        if top == line and line and lines[line - 1].strip().endswith("*/"):
            while top and not lines[top - 1].strip().startswith("/*"):
                top -= 1
            top -= top > 0
        return top, comment_above(lines, line)

    def close(line: int) -> int:
        level = 0
        for j in range(line, len(clear)):
            level += sum(c in "{([" for c in clear[j]) - sum(c in "})]" for c in clear[j])
            if level <= 0:
                return j
        return len(clear) - 1

    while i < len(clear):
        line = clear[i]
        if depth == 0 and (m := GO_FUNC.match(line)):
            end = close(i)
            start, doc = lead(i)
            whole = "\n".join(lines[i : end + 1])
            body = re.search(r"\{\s*(?:\n|.*\}\s*$)", "\n".join(clear[i : end + 1]), re.S)
            out.append(Span(start + 1, end + 1, m[2], "method" if m[1] else "func", whole[: body.start()].strip() if body else whole.strip(), doc))
            i = end
        elif depth == 0 and (m := GO_GROUP.match(line)):
            end, (start, doc), j = close(i), lead(i), i + 1
            while j < end:
                if s := GO_SPEC.match(clear[j]):
                    last = close(j)
                    top, own = lead(j)
                    head = (start if not own else top) + 1
                    out.append(Span(head, last + 1, s[1], m[1], "\n".join(lines[j : last + 1]).strip(), own or doc))
                    j = last
                j += 1
            i = end
        elif depth == 0 and (m := GO_ONE.match(line)):
            end, (start, doc) = close(i), lead(i)
            text = "\n".join(lines[i : end + 1]).strip()
            out.append(Span(start + 1, end + 1, m[2], m[1], text[len(m[1]) :].strip(), doc))
            i = end
        i += 1
    return out
