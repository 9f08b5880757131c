"""HTML pages as a flat table of nodes."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements without content, and what a start tag closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("td", "th", "tr", "thead", "tbody"), "body": ("head",)}
#: An implied close never reaches out of these.
FENCES = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",), "tbody": ("table",), "p": ("table", "button")}


#: Tags of the plainest form: what they say does not depend on what follows, and pages repeat them.
_PLAIN_START = re.compile(r'<[a-zA-Z][a-zA-Z0-9]*(?:\s+[a-zA-Z][a-zA-Z0-9-]*(?:="[^"<>&]*")?)*\s*>')
_PLAIN_END = re.compile("</([a-zA-Z][a-zA-Z0-9]*)>")
#: Of these a process keeps so many, with their names and attributes.
MOST_TAGS = 20_000
_STARTS: dict[str, tuple[str, list]] = {}
_ENDS: dict[str, str] = {}


class _Tree(HTMLParser):
    """Nodes of a page by number: kinds, tags, attributes, texts, parents, paths and the last node in each."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int]] = []
        self.tags: list[str | None] = []
        self.attrs: list[dict[str, str]] = []
        self.texts: list[str | None] = []
        self.parents: list[int | None] = []
        self.paths: list[list[int]] = []
        self.last: list[int] = []

    def updatepos(self, i: int, j: int) -> int:
        return j  # lines and columns are not needed

    def parse_starttag(self, i: int) -> int:
        end = self.rawdata.find(">", i) + 1
        text = self.rawdata[i:end]
        known = _STARTS.get(text)
        if known is None:
            self.made = None
            k = super().parse_starttag(i)
            if self.made and k == end and self.made[0] not in self.CDATA_CONTENT_ELEMENTS and _PLAIN_START.fullmatch(text):
                if len(_STARTS) >= MOST_TAGS:
                    _STARTS.clear()
                _STARTS[text] = self.made
            return k
        self.lasttag = known[0]
        self.handle_starttag(*known)
        return end

    def parse_endtag(self, i: int) -> int:
        if self.cdata_elem is None:
            end = self.rawdata.find(">", i) + 1
            text = self.rawdata[i:end]
            tag = _ENDS.get(text)
            if tag is None and (plain := _PLAIN_END.fullmatch(text)):
                if len(_ENDS) >= MOST_TAGS:
                    _ENDS.clear()
                tag = _ENDS[text] = plain[1].lower()
            if tag is not None:
                self.handle_endtag(tag)
                return end
        return super().parse_endtag(i)

    def _add(self, tag: str | None, attrs: dict[str, str], text: str | None) -> int:
        i = len(self.tags)
        parent = self.open[-1][1] if self.open else None
        self.tags.append(tag)
        self.attrs.append(attrs)
        self.texts.append(text)
        self.parents.append(parent)
        self.paths.append([*self.paths[parent], i] if parent is not None else [i])
        self.last.append(i)
        return i

    def _end(self, at: int) -> None:
        """Close the open elements from this place on."""
        for _, i in self.open[at:]:
            self.last[i] = len(self.tags) - 1
        del self.open[at:]

    def _close(self, tags: tuple[str, ...], fence: tuple[str, ...]) -> None:
        """Close the nearest open element of these tags, and all in it, up to a fence."""
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] in tags:
                self._end(at)
                return
            if self.open[at][0] in fence:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.made = tag, attrs
        if tag in BLOCKS:
            self._close(("p",), FENCES["p"])
        if tag in CLOSES:
            for _ in CLOSES[tag]:
                self._close(CLOSES[tag], FENCES.get(tag, ()))
        i = self._add(tag, {k: v if v is not None else "" for k, v in reversed(attrs)} if attrs else {}, None)
        if tag not in VOID:
            self.open.append((tag, i))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if any(t == tag for t, _ in self.open):
            self._close((tag,), ())

    def handle_data(self, data: str) -> None:
        self._add(None, {}, data)


def _tree(html: str | None) -> _Tree:
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    tree._end(0)
    return tree


def parse(html: str | None) -> list[dict]:
    """Nodes of a page in document order: elements and text, with parents, paths, attributes and the last node in each."""
    t = _tree(html)
    return [
        {"node_id": i, "parent_id": parent, "path": path, "kind": "text" if tag is None else "element", "tag": tag, "attrs": attrs, "text": text, "last_id": last}
        for i, (tag, attrs, text, parent, path, last) in enumerate(zip(t.tags, t.attrs, t.texts, t.parents, t.paths, t.last))
    ]


_NODES = "array<struct<node_id:int,parent_id:int,path:array<int>,kind:string,tag:string,attrs:map<string,string>,text:string,last_id:int>>"


def _offsets(sizes: list[int]) -> pa.Array:
    return pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))


def node_lists(pages: pa.Array) -> pa.Array:
    """The nodes of each page, one list a page. Lists and maps are made of flat columns."""
    trees = [_tree(html) for html in pages.to_pylist()]
    every = lambda name: [x for t in trees for x in getattr(t, name)]
    tags, attrs, paths = every("tags"), every("attrs"), every("paths")
    path = pa.ListArray.from_arrays(_offsets(list(map(len, paths))), pa.array([i for p in paths for i in p], pa.int32()))
    names, values = [k for a in attrs for k in a], [v for a in attrs for v in a.values()]
    maps = pa.MapArray.from_arrays(_offsets(list(map(len, attrs))), pa.array(names, pa.string()), pa.array(values, pa.string()))
    kinds = pa.array(["element", "text"]).take(pa.array([int(t is None) for t in tags], pa.int32()))
    ids = pa.array([i for t in trees for i in range(len(t.tags))], pa.int32())
    cols = [ids, pa.array(every("parents"), pa.int32()), path, kinds, pa.array(tags, pa.string()), maps, pa.array(every("texts"), pa.string()), pa.array(every("last"), pa.int32())]
    names = ["node_id", "parent_id", "path", "kind", "tag", "attrs", "text", "last_id"]
    return pa.ListArray.from_arrays(_offsets([len(t.tags) for t in trees]), pa.StructArray.from_arrays(cols, names))


def nodes(pages: DataFrame) -> DataFrame:
    """page_id, node_id (document order), parent_id, path (ancestors and self), kind, tag, attrs, text and last_id, the last
    node in it (itself, if there is none).

    Unclosed p, li, table and option elements are closed as a browser would; script and style hold raw text. Unclosed
    formatting elements end with their block and are not opened again. Where pages are dealt to tasks by page_id, so are
    their nodes, and what goes by page_id needs no shuffle.
    """
    listed = F.arrow_udf(node_lists, _NODES)
    return pages.select("page_id", F.explode(listed(F.col("html"))).alias("n")).select("page_id", "n.*")
