"""Outlines, references and definitions, and chunks of source code. Python is parsed; other languages go by their lines."""

from __future__ import annotations

import ast
import builtins
import re


class CodeError(ValueError):
    """Source code that can't be parsed."""


def _tree(code: str) -> ast.Module:
    try:
        return ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        raise CodeError(str(e)) from None


def outline(code: str, least_bytes: int = 0) -> str | None:
    """The code with each function's body left out; None below ``least_bytes``. Doc strings stay."""
    if len(code.encode()) < least_bytes:
        return None
    tree, lines = _tree(code), code.splitlines(keepends=True)
    gone: set[int] = set()
    for node in ast.walk(tree):
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            body = node.body[1:] if ast.get_docstring(node, clean=False) is not None else node.body
            if body and body[0].lineno > node.lineno:
                gone.update(range(body[0].lineno, node.end_lineno + 1))
    return "".join(x for i, x in enumerate(lines, 1) if i not in gone)


def references_and_definitions(code: str) -> tuple[list[str], list[str]]:
    """Names used but not defined here, and names of functions and classes defined here; both sorted, once each."""
    tree = _tree(code)
    defined = {n.name for n in ast.walk(tree) if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef)}
    used: set[str] = set()
    for n in ast.walk(tree):
        if isinstance(n, ast.Call):
            used.add(n.func.id if isinstance(n.func, ast.Name) else n.func.attr if isinstance(n.func, ast.Attribute) else "")
        elif isinstance(n, ast.ImportFrom | ast.Import):
            used.update(a.name.split(".")[-1] for a in n.names)
        elif isinstance(n, ast.ClassDef):
            used.update(b.id for b in n.bases if isinstance(b, ast.Name))
    return sorted(used - defined - set(dir(builtins)) - {""}), sorted(defined)


#: Braces that count, and what may hold others: strings, characters, comments.
_TOKENS = re.compile(r"""\"(?:\\.|[^\"\\])*\"|'(?:\\.[^'\n]{0,8}|[^'\\\n])'|`[^`]*`|//[^\n]*|/\*.*?\*/|[{}]""", re.DOTALL)


def _size(text: str) -> int:
    return len(text.encode())


def _nested(node: ast.AST) -> list[ast.stmt]:
    """The statements directly inside one."""
    found = [n for name in ("body", "handlers", "orelse", "finalbody", "cases") for n in getattr(node, name, []) or []]
    out = []
    for n in found:
        out += n.body if isinstance(n, ast.ExceptHandler | ast.match_case) else [n]
    return [n for n in out if isinstance(n, ast.stmt)]


def _python_parts(lines: list[str], nodes: list[ast.stmt], a: int, b: int, most: int | None) -> list[str]:
    """Lines a to b cut where the statements begin; a part over ``most`` bytes is cut at the statements inside it."""
    starts = [min([n.lineno, *(d.lineno for d in getattr(n, "decorator_list", []))]) - 1 for n in nodes]
    out = []
    for k, node in enumerate(nodes):
        x, y = starts[k] if k else a, starts[k + 1] if k + 1 < len(nodes) else b
        text = "".join(lines[x:y])
        inner = sorted(_nested(node), key=lambda n: n.lineno) if most is not None and _size(text) > most else []
        out += _python_parts(lines, inner, x, y, most) if inner else [text]
    return [x for x in out if x]


def _brace_parts(lines: list[str], depth: list[int], a: int, b: int, level: int, most: int | None) -> list[str]:
    """Lines a to b cut after each at whose end no more than ``level`` braces are open; a part over ``most`` bytes is cut one level deeper."""
    out, start = [], a
    for i in range(a, b):
        if depth[i] > level and i + 1 < b:
            continue
        text = "".join(lines[start : i + 1])
        if most is not None and _size(text) > most and max(depth[start : i + 1]) > level:
            out += _brace_parts(lines, depth, start, i + 1, level + 1, most)
        else:
            out.append(text)
        start = i + 1
    return out


def blocks(code: str, language: str, most: int | None = None) -> list[str]:
    """Parts of the code that belong together, in order; joined they are the code. Python: statements; else: lines up to where
    braces, but for those in strings and comments, are closed again. A part over ``most`` bytes gives way to the parts inside it."""
    lines = code.splitlines(keepends=True)
    if language == "python":
        try:
            body = _tree(code).body
        except CodeError:
            return [code]
        lines = re.findall(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+", code)  # lines as the parser counts them
        return _python_parts(lines, body, 0, len(lines), most) if body else [code] if code else []
    depth, opened, at, ends = [], 0, 0, []
    for line in lines:
        at += len(line)
        ends.append(at)
    marks = [(m.start(), 1 if m[0] == "{" else -1) for m in _TOKENS.finditer(code) if m[0] in "{}"]
    k = 0
    for end in ends:
        while k < len(marks) and marks[k][0] < end:
            opened += marks[k][1]
            k += 1
        depth.append(opened)
    return _brace_parts(lines, depth, 0, len(lines), 0, most)


def chunks(code: str, language: str = "python", most_bytes: int = 1500, least_bytes: int = 0) -> list[str]:
    """Greedy chunks of blocks: a block that would fill a chunk to ``most_bytes`` or more begins a new one; a longer block gives way to the blocks inside it,
    one without any is cut by lines, a longer line by characters. Chunks of at most ``least_bytes`` are left out."""
    size = _size
    parts: list[str] = []
    for block in blocks(code, language, most_bytes):
        for line in [block] if size(block) <= most_bytes else block.splitlines(keepends=True):
            while size(line) > most_bytes:
                cut = line.encode()[:most_bytes].decode("utf-8", "ignore")
                parts.append(cut)
                line = line[len(cut) :]
            parts.append(line)
    out, held = [], ""
    for p in parts:
        if held and size(held) + size(p) >= most_bytes:
            out.append(held)
            held = ""
        held += p
    if held:
        out.append(held)
    return [c for c in out if size(c) > least_bytes]
