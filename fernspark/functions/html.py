"""HTML to Markdown with the standard library's parser."""

from __future__ import annotations

import re
from html.parser import HTMLParser

SKIPPED = {"script", "style", "head", "template"}
BLOCKS = {"p", "div", "section", "article", "main", "header", "footer", "nav", "aside", "form", "figure", "figcaption", "address", "fieldset", "dl", "dt", "dd", "body", "html"}


class _Reader(HTMLParser):
    """Collects Markdown. Unclosed tags end with what encloses them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = ""
        self.lists: list[int] = []  # -1 in a bulleted list, else the last number
        self.links: list[tuple[str, int]] = []
        self.pre = False
        self.quote = 0
        self.row: list[str] | None = None
        self.cell = 0
        self.rows = 0

    def block(self, n: int = 2) -> None:
        text = "".join(self.out[-3:])
        have = len(text) - len(text.rstrip("\n"))
        if self.out and have < n:
            self.out.append("\n" * (n - have))
        if self.quote and n and not self.pre:
            self.out.append("> " * self.quote)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.skip:
            return
        a = dict(attrs)
        if tag in SKIPPED:
            self.skip = tag
        elif re.fullmatch("h[1-6]", tag):
            self.block()
            self.out.append("#" * int(tag[1]) + " ")
        elif tag in BLOCKS:
            self.block()
        elif tag == "br":
            self.out.append("\n")
        elif tag == "hr":
            self.block()
            self.out.append("* * *")
            self.block()
        elif tag in ("strong", "b"):
            self.out.append("**")
        elif tag in ("em", "i"):
            self.out.append("*")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "pre":
            self.block()
            self.out.append("```\n")
            self.pre = True
        elif tag == "blockquote":
            self.quote += 1
            self.block()
        elif tag in ("ul", "ol"):
            self.block(1 if self.lists else 2)
            self.lists.append(-1 if tag == "ul" else 0)
        elif tag == "li":
            self.block(1)
            depth = max(len(self.lists) - 1, 0)
            if self.lists and self.lists[-1] >= 0:
                self.lists[-1] += 1
            self.out.append("  " * depth + ("* " if not self.lists or self.lists[-1] < 0 else f"{self.lists[-1]}. "))
        elif tag == "a":
            self.links.append((a.get("href") or "", len(self.out)))
        elif tag == "img":
            self.out.append(f"![{a.get('alt') or ''}]({a.get('src') or ''})")
        elif tag == "table":
            self.block()
            self.rows = 0
        elif tag == "tr":
            self.row = []
        elif tag in ("td", "th"):
            self.cell = len(self.out)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("br", "hr", "img"):
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self.skip:
            if tag == self.skip:
                self.skip = ""
            return
        if re.fullmatch("h[1-6]", tag) or tag in BLOCKS:
            self.block()
        elif tag in ("strong", "b"):
            self.out.append("**")
        elif tag in ("em", "i"):
            self.out.append("*")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "pre" and self.pre:
            self.out.append("\n```")
            self.pre = False
            self.block()
        elif tag == "blockquote" and self.quote:
            self.quote -= 1
            self.block()
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            self.block(1 if self.lists else 2)
        elif tag == "a" and self.links:
            href, at = self.links.pop()
            text = "".join(self.out[at:]).strip()
            if href and text:
                del self.out[at:]
                self.out.append(f"[{text}]({href})")
        elif tag in ("td", "th") and self.row is not None:
            self.row.append(" ".join("".join(self.out[self.cell :]).split()).replace("|", "\\|"))
            del self.out[self.cell :]
        elif tag == "tr" and self.row is not None:
            self.out.append("| " + " | ".join(self.row) + " |\n")
            if not self.rows:
                self.out.append("|" + " --- |" * len(self.row) + "\n")
            self.rows += 1
            self.row = None
        elif tag == "table":
            self.block()

    def handle_data(self, data: str) -> None:
        if self.skip:
            return
        if self.pre:
            self.out.append(data)
            return
        text = re.sub(r"\s+", " ", data)
        if text == " " and (not self.out or self.out[-1].endswith(("\n", " "))):
            return
        self.out.append(text.lstrip() if not self.out or self.out[-1].endswith(("\n", " ")) else text)


def to_markdown(html: str | None) -> str | None:
    """Markdown of a page: headings, emphasis, links, images, lists, quotes, code, tables; scripts and styles are dropped. Null stays null."""
    if html is None:
        return None
    reader = _Reader()
    reader.feed(html)
    reader.close()
    text = re.sub(r"[ \t]+\n", "\n", "".join(reader.out))
    return re.sub(r"\n{3,}", "\n\n", text).strip()
