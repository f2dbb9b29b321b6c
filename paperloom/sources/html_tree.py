"""HTML to Markdown in one pass over the tags, with a stack of what is open."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

from paperloom.operators.blocks import placed_cells

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCKS = {"p", "div", "section", "article", "header", "footer", "nav", "main", "figure", "figcaption", "address", "aside", "form", "tr", "dl", "dt", "dd"}
#: What a tag ends by beginning, where it was left open, and what it does not look beyond for it.
CLOSES = {"li": ("li", ("ul", "ol")), "p": ("p", ("li", "blockquote", "div", "td", "th")), "dt": ("dt", ("dl",)), "dd": ("dd", ("dl",)), "option": ("option", ("select",))}
#: Marks of what later passes leave alone: formulas by their dollars, and texts that are kept as they are.
MATH, KEPT = "\0", "\1"


@dataclass
class Open:
    """A tag that is open, and the Markdown of what it holds so far."""

    tag: str
    attrs: dict[str, str]
    parts: list[str] = field(default_factory=list)
    #: The number of the next item of an ordered list.
    number: int = 1


class Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack = [Open("", {})]
        #: The raw tags and texts of a table that is open, and how many tables are open in each other.
        self.raw: list[str] = []
        self.tables = 0
        self.kept: list[str] = []

    def inside(self, *tags: str) -> bool:
        return any(o.tag in tags for o in self.stack)

    def put(self, text: str) -> None:
        self.stack[-1].parts.append(text)

    def keep(self, text: str) -> str:
        """A mark for text that no later pass may change."""
        self.kept.append(text)
        return f"{KEPT}{len(self.kept) - 1}{KEPT}"

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "table":
            self.tables += 1
        if self.tables:
            self.raw.append(self.get_starttag_text() or "")
            return
        own = {k: v or "" for k, v in attrs}
        if tag in CLOSES:
            same, borders = CLOSES[tag]
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k].tag in borders:
                    break
                if self.stack[k].tag == same:
                    self.close_to(k)
                    break
        if tag == "br":
            self.put("\n")
        elif tag == "hr":
            self.put("\n\n---\n\n")
        elif tag == "img":
            self.put(f"![{own.get('alt', '')}]({own.get('src', '')})" if own.get("src") else "")
        elif tag not in VOID:
            start = own.get("start", "")
            self.stack.append(Open(tag, own, number=int(start) if start.lstrip("-").isdigit() else 1))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if self.tables:
            self.raw.append(f"</{tag}>")
            if tag == "table":
                self.tables -= 1
                if not self.tables:
                    self.put(pipe_table("".join(self.raw)))
                    self.raw.clear()
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                self.close_to(k)
                return

    def close_to(self, k: int) -> None:
        """Closes what is open from the end of the stack to its place ``k``."""
        while len(self.stack) > k:
            done = self.stack.pop()
            self.put(self.shown(done, "".join(done.parts)))

    def handle_data(self, data: str) -> None:
        if self.tables:
            self.raw.append(html.escape(data))
        elif self.inside("script", "style") or self.stack[-1].tag in ("ul", "ol") and not data.strip():
            return
        elif self.inside("pre", "math", "code"):
            self.put(data.replace(MATH, "").replace(KEPT, ""))
        else:
            self.put(re.sub(r"\s+", " ", data.replace(MATH, "").replace(KEPT, "")).replace("$", "\\$"))

    def shown(self, done: Open, text: str) -> str:
        """The Markdown of a closed tag."""
        tag, attrs, flat = done.tag, done.attrs, " ".join(text.split())
        if tag == "pre":
            body = text.strip("\n")
            return "\n\n" + self.keep(f"```\n{body}\n```") + "\n\n"
        if tag == "code":
            return text if self.inside("pre") or not text else self.keep(f"`{text}`")
        if tag == "math":
            dollars = MATH * 2 if attrs.get("display") == "block" else MATH
            return f"\n\n{dollars}{text.strip()}{dollars}\n\n" if len(dollars) == 2 else f"{dollars}{text.strip()}{dollars}"
        if tag in ("b", "strong", "i", "em"):
            mark = "**" if tag in ("b", "strong") else "*"
            return text[: len(text) - len(text.lstrip())] + mark + text.strip() + mark + text[len(text.rstrip()) :] if text.strip() else text
        if tag == "a":
            return f"[{flat}]({attrs['href']})" if attrs.get("href") else text
        if re.fullmatch("h[1-6]", tag):
            return f"\n\n{'#' * int(tag[1])} {flat}\n\n" if flat else ""
        if tag == "span" and attrs.get("id"):
            return f'<span id="{attrs["id"]}">{text}</span>'
        if tag == "blockquote":
            return "\n\n" + indented(text, "> ", "> ") + "\n\n" if text.strip() else ""
        if tag == "li":
            return self.item(text)
        if tag in ("ul", "ol"):
            return ("\n" if self.inside("li") else "\n\n") + text.strip("\n") + ("\n" if self.inside("li") else "\n\n")
        if tag == "div" and "page" in attrs.get("class", "").split() and attrs.get("data-page-id", "").isdigit():
            return "\n\n{" + attrs["data-page-id"] + "}" + "-" * 48 + "\n\n" + text.strip() + "\n\n"
        if tag == "p" and "has-continuation" in attrs.get("class", "").split():
            return continued(text)
        return f"\n\n{text.strip()}\n\n" if tag in BLOCKS and text.strip() else text

    def item(self, text: str) -> str:
        """An item of the list that is open: with its number in an ordered one, its further lines under its text."""
        around = next((o for o in reversed(self.stack) if o.tag in ("ul", "ol")), None)
        marker = "- "
        if around is not None and around.tag == "ol":
            marker = f"{around.number}. "
            around.number += 1
        lead = "" if self.stack[-1].tag in ("ul", "ol") else "\n"
        return lead + indented(text, marker, " " * len(marker)) + "\n"

    def markdown(self) -> str:
        self.close()
        if self.tables:  # a table that never ends
            self.tables = 0
            self.put(pipe_table("".join(self.raw)))
        self.close_to(1)
        text = re.sub(r"\n{3,}", "\n\n", re.sub(r"\n +(?=\n)", "\n", "".join(self.stack[0].parts))).strip()
        text = re.sub(f"({MATH}{MATH}?)(.*?)\\1", lambda m: "$" * len(m[1]) + m[2] + "$" * len(m[1]), text, flags=re.S)
        while KEPT in text:  # what is kept may hold what was kept before
            text = re.sub(f"{KEPT}(\\d+){KEPT}", lambda m: self.kept[int(m[1])].replace("\n", "\n" + line_start(text, m.start())), text)
        return text


def line_start(text: str, at: int) -> str:
    """What the further lines of kept text have in front: the quote marks and the indentation of the line it stands in."""
    line = text[text.rfind("\n", 0, at) + 1 : at]
    return re.sub(r"[^> ]", " ", line)


def indented(text: str, first: str, rest: str) -> str:
    """The lines of a text, the first behind ``first``, the others behind ``rest``; blank lines between blocks stay blank."""
    lines = re.sub(r"\n{3,}", "\n\n", text.strip()).split("\n")
    return "\n".join([first + lines[0].strip(), *((rest + line).rstrip() if line.strip() else rest.rstrip() for line in lines[1:])])


def continued(text: str) -> str:
    """A paragraph that goes on in the next block: without the hyphen that cuts its last word, else with a space."""
    cut = re.fullmatch(r"(.*[^\W\d_A-Z]|.*\d)[-—¬]\s?", text.rstrip("\n"), re.S)
    return cut[1] if cut else text.rstrip() + " "


def pipe_table(page: str) -> str:
    """An HTML table as a Markdown table: a cell's text at its first place, blanks where it spans, a rule under row one."""
    cells = placed_cells(page)
    if not cells:
        return ""
    height, width = max(r + d for r, _, d, *_ in cells), max(c + a for _, c, _, a, *_ in cells)
    grid = [[""] * width for _ in range(height)]
    for r, c, *_, text in cells:
        grid[r][c] = " ".join(text.split()).replace("$", "\\$").replace("|", "\\|")
    rows = ["| " + " | ".join(row) + " |" for row in grid]
    return "\n\n" + "\n".join([rows[0], "|" + " --- |" * width, *rows[1:]]) + "\n\n"


def markdown_of(page: str) -> str:
    """One page as Markdown: headings, paragraphs, emphasis, nested lists with their numbers, quotes, code, links, images, tables,
    formulas, rules and page markers. Dollar signs of the text are escaped, those around formulas and in code are not."""
    reader = Page()
    reader.feed(page)
    return reader.markdown()
