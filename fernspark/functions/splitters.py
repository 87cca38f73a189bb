"""Splitting of text and Markdown into chunks of bounded length, by the largest units of meaning that fit."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

DEFAULT_MOST = 2056

_SENTENCE = re.compile(r"[^.!?。！？]*[.!?。！？]+[\"'”’)\]]*\s*|[^.!?。！？]+$")
_WORD = re.compile(r"\s+|\w+|[^\w\s]+")
_HEADING = re.compile(r"\s{0,12}(#{1,6})(\s|$)")
_ITEM = re.compile(r"\s*([-*+]|\d{1,9}[.)])\s")
_FENCE = re.compile(r"\s{0,12}(```|~~~)")
_RULE = re.compile(r"\s{0,12}([-*_])(\s*\1){2,}\s*$")


def _by_breaks(text: str, n: int) -> list[str]:
    """Parts between runs of at least ``n`` line feeds; a run belongs to the part before it."""
    out, at = [], 0
    for m in re.finditer(r"(?:\r?\n[ \t]*){%d,}" % n, text):
        out.append(text[at : m.end()])
        at = m.end()
    return [*out, text[at:]] if at < len(text) else out


def _graphemes(text: str) -> list[str]:
    out: list[str] = []
    for c in text:
        if out and (unicodedata.combining(c) or c in "‍️" or out[-1].endswith("‍")):
            out[-1] += c
        else:
            out.append(c)
    return out


def _text_levels(text: str) -> Iterator[Callable[[str], list[str]]]:
    longest = max((m.group().count("\n") for m in re.finditer(r"\n(?:[ \t\r]*\n)*", text)), default=0)
    for n in range(min(longest, 8), 0, -1):
        yield lambda t, n=n: _by_breaks(t, n)
    yield lambda t: _SENTENCE.findall(t)
    yield lambda t: _WORD.findall(t)
    yield _graphemes
    yield list


def _merged(parts: list[str], most: int, desired: int) -> list[str]:
    """Neighbours together as long as they fit (trimmed) and the chunk is still below ``desired``."""
    out: list[str] = []
    for p in parts:
        if out and len(out[-1].strip()) < desired and len((out[-1] + p).strip()) <= most:
            out[-1] += p
        else:
            out.append(p)
    return out


def _split(text: str, most: int, desired: int, levels: list[Callable[[str], list[str]]]) -> list[str]:
    if len(text.strip()) <= most:
        return [text]
    for k, level in enumerate(levels):
        parts = level(text)
        if len(parts) > 1:
            out: list[str] = []
            run: list[str] = []
            for p in parts:
                if len(p.strip()) <= most:
                    run.append(p)
                else:
                    out += _merged(run, most, desired)
                    run = []
                    out += _split(p, most, desired, levels[k + 1 :])
            return out + _merged(run, most, desired)
    return [text[i : i + most] for i in range(0, len(text), most)]


def _kept(parts: list[str], least: int) -> list[str]:
    out = [p.strip() for p in parts]
    return [p for p in out if p and len(p.encode()) >= least]


def _bounds(most: int | None, span: tuple[int, int] | None) -> tuple[int, int, int]:
    """Capacity in characters, the length from which a chunk is long enough, the least bytes. A range is half-open and wins over ``most``."""
    if span:
        return span[1] - 1, max(span[0], 1), span[0]
    n = most or DEFAULT_MOST
    return n, n, 0


def text_chunks(text: str | None, most: int | None = None, span: tuple[int, int] | None = None) -> list[str]:
    """Trimmed chunks of at most ``most`` characters, or of a length in ``span``: by runs of line feeds, longest first, then sentences, words,
    graphemes and characters; neighbours are merged while they fit. Empty chunks, and those of fewer bytes than the span's begin, are left out."""
    if not text:
        return []
    capacity, desired, least = _bounds(most, span)
    if capacity < 1:
        raise ValueError("a chunk has at least one character")
    return _kept(_split(text, capacity, desired, list(_text_levels(text))), least)


def markdown_blocks(text: str) -> list[tuple[int, str]]:
    """(heading level or 0, block) in order: headings, fenced code, list items, rules, tables and paragraphs. Joined they are the text."""
    blocks: list[tuple[int, str]] = []
    fence = ""
    fresh = True
    for line in text.splitlines(keepends=True):
        heading, opened = _HEADING.match(line), _FENCE.match(line)
        if fence:
            blocks[-1] = (0, blocks[-1][1] + line)
            if opened and opened[1] == fence:
                fence, fresh = "", True
        elif opened:
            fence = opened[1]
            blocks.append((0, line))
        elif heading or _RULE.match(line):
            blocks.append((len(heading[1]) if heading else 0, line))
            fresh = True
        elif not line.strip():
            blocks.append((0, line)) if not blocks else blocks.__setitem__(-1, (blocks[-1][0], blocks[-1][1] + line))
            fresh = True
        elif fresh or _ITEM.match(line):
            blocks.append((0, line))
            fresh = False
        else:
            blocks[-1] = (0, blocks[-1][1] + line)
    return blocks


def _sections(blocks: list[tuple[int, str]], level: int) -> list[list[tuple[int, str]]]:
    out: list[list[tuple[int, str]]] = []
    for b in blocks:
        if not out or 0 < b[0] <= level:
            out.append([])
        out[-1].append(b)
    return out


def markdown_chunks(text: str | None, most: int | None = None, span: tuple[int, int] | None = None) -> list[str]:
    """Like :func:`text_chunks`, but first by Markdown's structure: sections of headings from the first level down, then blocks, then text units."""
    if not text:
        return []
    capacity, desired, least = _bounds(most, span)

    def cut(blocks: list[tuple[int, str]], level: int) -> list[str]:
        whole = "".join(b for _, b in blocks)
        if len(whole.strip()) <= capacity:
            return [whole]
        if level <= 6:
            return _merged_runs([cut(s, level + 1) for s in _sections(blocks, level)])
        return _merged_runs([[b] if len(b.strip()) <= capacity else _split(b, capacity, desired, list(_text_levels(b))) for _, b in blocks])

    def _merged_runs(parts: list[list[str]]) -> list[str]:
        out: list[str] = []
        run: list[str] = []
        for p in parts:
            if len(p) == 1:
                run += p
            else:
                out += _merged(run, capacity, desired) + p
                run = []
        return out + _merged(run, capacity, desired)

    return _kept(cut(markdown_blocks(text), 1), least)
