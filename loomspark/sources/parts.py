"""The parts of DOCX and PPTX packages, found by their relationships, and the items in them.

A package's parts refer to one another by relationship id: the main part is what the package
itself calls its office document, a deck's slides are those its presentation lists, in that order,
and notes and styles belong to the part that names them.  File names mean nothing; decks without
a presentation part alone have their slides by number.  A part that is named but missing is an
error of the whole file, so that no content goes unnoticed.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

# Namespaces and the last step of relationship types.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
MAIN, STYLES, NOTES = "officeDocument", "styles", "notesSlide"


class Package:
    """A zipped package; parts are named without a leading slash."""

    def __init__(self, content: bytes) -> None:
        self._zip = zipfile.ZipFile(io.BytesIO(content))
        self.names = set(self._zip.namelist())

    def xml(self, part: str) -> ElementTree.Element:
        if part not in self.names:
            raise ValueError(f"missing part {part}")
        return ElementTree.fromstring(self._zip.read(part))

    def relations(self, part: str = "") -> dict[str, tuple[str, str]]:
        """By id: the last step of the type, and the part it leads to; links outside are left out."""
        folder, name = posixpath.split(part)
        rels = posixpath.join(folder, "_rels", f"{name}.rels")
        if rels not in self.names:
            return {}
        out = {}
        for k, r in enumerate(self.xml(rels)):
            if r.get("TargetMode") != "External":
                target = r.get("Target", "")
                kind = r.get("Type", "").rpartition("/")[2]
                out[r.get("Id", f"#{k}")] = (kind, posixpath.normpath(posixpath.join("/", folder, target)).lstrip("/"))
        return out

    def related(self, part: str, kind: str) -> str | None:
        """The first part that `part` has a relationship of this kind to."""
        return next((target for found, target in self.relations(part).values() if found == kind), None)

    def main(self, usual: str) -> str | None:
        part = self.related("", MAIN) or usual
        return part if part in self.names else None


def _docx_run(run: ElementTree.Element) -> str:
    out = []
    for e in run:
        if e.tag == f"{W}t":
            out.append(e.text or "")
        elif e.tag in (f"{W}tab", f"{W}ptab"):
            out.append("\t")
        elif e.tag == f"{W}cr" or (e.tag == f"{W}br" and e.get(f"{W}type", "textWrapping") == "textWrapping"):
            out.append("\n")
        elif e.tag == f"{W}noBreakHyphen":
            out.append("-")
    return "".join(out)


def docx_text(paragraph: ElementTree.Element) -> str:
    """Runs of the paragraph and of its links, with tabs and line breaks."""
    out = []
    for e in paragraph:
        if e.tag == f"{W}r":
            out.append(_docx_run(e))
        elif e.tag == f"{W}hyperlink":
            out.extend(_docx_run(r) for r in e.findall(f"{W}r"))
    return "".join(out)


def _cells(table: ElementTree.Element) -> list[list[str]]:
    """Texts of a table's grid: a cell over several columns is in each of them, and one that goes
    on from above has the text of the cell above."""
    grid: list[list[str]] = []
    for row in table.findall(f"{W}tr"):
        texts: list[str] = []
        for cell in row.findall(f"{W}tc"):
            span, merge = cell.find(f"{W}tcPr/{W}gridSpan"), cell.find(f"{W}tcPr/{W}vMerge")
            text = "\n".join(docx_text(p) for p in cell.findall(f"{W}p"))
            if merge is not None and merge.get(f"{W}val", "continue") == "continue" and grid and len(texts) < len(grid[-1]):
                text = grid[-1][len(texts)]
            texts += [text] * (int(span.get(f"{W}val", 1)) if span is not None else 1)
        grid.append(texts)
    return grid


def docx_items(content: bytes) -> Iterator[dict]:
    """The page itself, paragraphs with the name of their style, then tables; cells as text."""
    package = Package(content)
    main = package.main("word/document.xml")
    if main is None:
        raise ValueError("no main document part")
    body = package.xml(main).find(f"{W}body")
    yield {"page": 1, "kind": "page"}
    names, default = {}, ""
    if (part := package.related(main, STYLES) or "word/styles.xml") in package.names:
        for s in package.xml(part).iter(f"{W}style"):
            name = s.find(f"{W}name")
            names[s.get(f"{W}styleId")] = name.get(f"{W}val") if name is not None else ""
            if s.get(f"{W}type") == "paragraph" and s.get(f"{W}default") in ("1", "true"):
                default = names[s.get(f"{W}styleId")]
    for p in body.findall(f"{W}p") if body is not None else ():
        style = p.find(f"{W}pPr/{W}pStyle")
        name = names.get(style.get(f"{W}val"), style.get(f"{W}val")) if style is not None else default
        yield {"page": 1, "kind": "paragraph", "style": name, "text": docx_text(p)}
    for t in body.findall(f"{W}tbl") if body is not None else ():
        if cells := _cells(t):
            yield {"page": 1, "kind": "table", "rows": cells}


def pptx_text(paragraph: ElementTree.Element) -> str:
    """Runs and fields of the paragraph; a line break is a vertical tab."""
    out = []
    for e in paragraph:
        if e.tag in (f"{A}r", f"{A}fld"):
            out.append(e.findtext(f"{A}t") or "")
        elif e.tag == f"{A}br":
            out.append("\v")
    return "".join(out)


def _placeholder(shape: ElementTree.Element) -> ElementTree.Element | None:
    return shape.find(f"{P}nvSpPr/{P}nvPr/{P}ph")


def _shapes(slide: ElementTree.Element) -> list[ElementTree.Element]:
    """A slide's own text shapes; those in groups are no shapes of the slide."""
    tree = slide.find(f"{P}cSld/{P}spTree")
    return tree.findall(f"{P}sp") if tree is not None else []


def _frame(shape: ElementTree.Element) -> str:
    return "\n".join(pptx_text(p) for p in shape.findall(f"{P}txBody/{A}p"))


def _slides(package: Package) -> list[str]:
    main = package.main("ppt/presentation.xml")
    if main is None:
        numbered = [(int(m[1]), m[0]) for n in package.names if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n))]
        if not numbered:
            raise ValueError("no presentation part")
        return [name for _, name in sorted(numbered)]
    relations = package.relations(main)
    ids = [s.get(f"{R}id") for s in package.xml(main).findall(f"{P}sldIdLst/{P}sldId")]
    if missing := [i for i in ids if i not in relations]:
        raise ValueError(f"no relationship {missing[0]} of {main}")
    return [relations[i][1] for i in ids]


def pptx_items(content: bytes) -> Iterator[dict]:
    """By slide: its title, paragraphs with their level, and notes."""
    package = Package(content)
    for n, part in enumerate(_slides(package), 1):
        shapes = _shapes(package.xml(part))
        yield {"page": n, "kind": "slide", "text": str(n)}
        title = next((s for s in shapes if (ph := _placeholder(s)) is not None and ph.get("idx", "0") == "0"), None)
        if title is not None:
            yield {"page": n, "kind": "title", "text": _frame(title)}
        for shape in shapes:
            for p in shape.findall(f"{P}txBody/{A}p") if shape is not title else ():
                pr = p.find(f"{A}pPr")
                yield {"page": n, "kind": "bullet", "level": int(pr.get("lvl", 0)) if pr is not None else 0, "text": pptx_text(p)}
        if notes := package.related(part, NOTES):
            body = next((s for s in _shapes(package.xml(notes)) if (ph := _placeholder(s)) is not None and ph.get("type") == "body"), None)
            if body is not None:
                yield {"page": n, "kind": "notes", "text": _frame(body)}
