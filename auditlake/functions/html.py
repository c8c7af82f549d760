"""One pass over an HTML text with a stack of open tags: links rewritten, headers left out, headings listed.

A text is read token by token (comments, tags, text), in time linear in its length. End tags close all that is open
above their element; stray ones stay as they are. What is left out goes from its start tag to the end of its element, or
of the element around it where its own end is missing. `script` and `style` hold raw text. A comment without end goes to
the end of the text; attributes' values hold no `<`, else the tag is text."""

from __future__ import annotations

import html as entities
import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import unquote

TAG = re.compile(r"""<(/?)([A-Za-z][A-Za-z0-9-]*)((?:"[^"<]*"|'[^'<]*'|[^"'<>])*)>""")
ATTRIBUTE = re.compile(r"""([A-Za-z_:][-A-Za-z0-9_:.]*)\s*=\s*("[^"]*"|'[^']*'|[^\s"'=<>`]+)""")
#: Elements without content, and those of raw text. Fixed values.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = ("script", "style")
HEADING = re.compile("h[1-6]")
#: Links that stay: fragments, schemes, other hosts; folders of a report tree by format. Fixed values.
KEPT = ("#", "mailto:", "tel:", "javascript:", "data:", "http://", "https://", "//")
FORMATS = ("json", "sarif", "md", "html", "pdf")


def tokens(text: str) -> Iterator[tuple[str, str, str, str]]:
    """(kind, whole, name, attributes); kind is text, comment, start or end."""
    i, n = 0, len(text)
    while i < n:
        j = text.find("<", i)
        if j != i:
            j = n if j < 0 else j
            yield "text", text[i:j], "", ""
            i = j
            continue
        if text.startswith("<!--", i):
            j = text.find("-->", i + 4)
            j = n if j < 0 else j + 3
            yield "comment", text[i:j], "", ""
        elif m := TAG.match(text, i):
            j, name = m.end(), m[2].lower()
            yield "end" if m[1] else "start", m[0], name, m[3]
            if name in RAW and not m[1]:
                end = text.find(f"</{name}", j)
                end = n if end < 0 else end
                if end > j:
                    yield "text", text[j:end], "", ""
                j = end
        else:
            j = text.find(">", i) + 1 if text.startswith("<!", i) else i + 1
            j = j or n
            yield ("comment" if j > i + 1 else "text"), text[i:j], "", ""
        i = j


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2].strip("\"'")) for m in ATTRIBUTE.finditer(text)}


def relinked(href: str, folder: str) -> str | None:
    """The link as seen from the root of a report tree, or None where it stays. folder: the one of the page, below the
    root. A link to the root's format folders (a relative one that lost its start) goes to the page's own run."""
    href = href.strip()
    if not href or href.startswith((*KEPT, "/reports/")):
        return None
    if href.startswith("/"):
        parts = unquote(href.lstrip("/")).split("/")
        if len(parts) < 2 or parts[0].lower() not in FORMATS or not parts[-1]:
            return None
        return f"/reports/{posixpath.join(posixpath.dirname(folder), parts[0].lower(), parts[-1])}"
    path = posixpath.normpath(posixpath.join("/", "root", folder, href))
    return f"/reports/{path.removeprefix('/root/')}" if path.startswith("/root/") else None


@dataclass
class Preview:
    html: str = ""
    links: list[tuple[str, str]] = field(default_factory=list)
    headings: list[tuple[int, str]] = field(default_factory=list)


def unescaped(text: str, names: tuple[str, ...] | None = None) -> str:
    """The text with character references resolved: all that HTML knows, or only those of the given names, ended by `;`."""
    if names is None:
        return entities.unescape(text)
    return re.sub(f"&(?:{'|'.join(map(re.escape, names))});", lambda m: entities.unescape(m[0]), text) if names else text


def preview(text: str, folder: str, tags: tuple[str, ...] = (), classes: tuple[str, ...] = ("report-header",), names: tuple[str, ...] | None = None) -> Preview:
    """The text with links rewritten and without the elements of the given tags and classes; its headings, in which
    the character references `names` are resolved (all, if None)."""
    out, found = [], Preview()
    open_: list[str] = []
    count: dict[str, int] = {}
    dropped: int | None = None
    heading: list[str] | None = None
    for kind, whole, name, more in tokens(text):
        if kind == "end" and not count.get(name):
            pass  # stray
        elif kind == "end":
            while True:
                closed = open_.pop()
                count[closed] -= 1
                if heading is not None and HEADING.fullmatch(closed):
                    found.headings.append((int(closed[1]), " ".join(unescaped("".join(heading), names).split())))
                    heading = None
                if closed == name:
                    break
            if dropped is not None and len(open_) <= dropped:
                own, dropped = len(open_) == dropped, None
                if own:
                    continue
        elif kind == "start":
            own = attributes(more) if more else {}
            if dropped is None and (name in tags or set(own.get("class", "").split()) & set(classes)):
                if name in VOID:
                    continue
                dropped = len(open_)
            if dropped is None and name == "a" and "href" in own and (new := relinked(own["href"], folder)) is not None:
                found.links.append((own["href"], new))
                whole = ATTRIBUTE.sub(lambda m, new=new: f'{m[1]}="{entities.escape(new)}"' if m[1].lower() == "href" else m[0], whole)
            if name not in VOID and not more.endswith("/"):
                open_.append(name)
                count[name] = count.get(name, 0) + 1
                if HEADING.fullmatch(name) and dropped is None and heading is None:
                    heading = []
        if dropped is None:
            out.append(whole)
            if kind == "text" and heading is not None:
                heading.append(whole)
    if heading is not None:
        level = next(int(x[1]) for x in reversed(open_) if HEADING.fullmatch(x))
        found.headings.append((level, " ".join(unescaped("".join(heading), names).split())))
    found.html = "".join(out)
    return found
