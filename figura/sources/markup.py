"""Markup (XML / HTML) -> node table.

The one custom Python piece: ``mapInArrow`` parses each document with the
standard library's tolerant HTML tokenizer (tag and attribute names
lower-cased, as an HTML parser does with XML; of documents with plain tags
alone it reads each different tag once) and emits one row per element and per
text run:

    doc_id, pre, post, parent, depth, tag, attrs map<string,string>,
    text (text runs only), child_elements (element children of an element),
    in_leaf (a text run whose parent element has no element children)

``pre``/``post`` are document-order numbers (ancestor = pre below and post
above); what lies in what is found by the merges of
``figura.operators.structural``, linear at any depth of nesting. Everything
after the scan is relational. One document is one record, so a task never
holds more than the documents of its input split.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from figura.operators import structural
from figura.session import spread

NODE_SCHEMA = ("doc_id string, pre bigint, post bigint, parent bigint, depth int, tag string, "
               "attrs map<string,string>, text string, child_elements int, in_leaf boolean")

TEXT = "#text"
# HTML elements that never have an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


COLUMNS = ["doc_id", "pre", "post", "parent", "depth", "tag", "attrs", "text", "child_elements", "in_leaf"]


class _TreeBuilder(HTMLParser):
    """Collects node columns (column lists, not row dicts) while parsing."""

    def __init__(self, doc_id: str):
        super().__init__(convert_charrefs=True)
        self.doc_id = doc_id
        self.cols: dict[str, list] = {c: [] for c in COLUMNS[1:]}
        self.stack: list[tuple[int, str]] = []     # (pre, tag) of open elements
        self.open: Counter[str] = Counter()        # open elements by tag
        self.post = 0

    def _node(self, tag, attrs, text) -> int:
        c = self.cols
        pre = len(c["pre"])
        c["pre"].append(pre)
        c["post"].append(None)
        parent = self.stack[-1][0] if self.stack else None
        c["parent"].append(parent)
        c["depth"].append(len(self.stack))
        c["tag"].append(tag)
        c["attrs"].append(attrs)
        c["text"].append(text)
        if tag != TEXT:
            c["child_elements"].append(0)
            if parent is not None:
                c["child_elements"][parent] += 1
        else:
            c["child_elements"].append(None)
        c["in_leaf"].append(None)
        return pre

    def _close(self, pre: int) -> None:
        self.cols["post"][pre] = self.post
        self.post += 1

    def handle_starttag(self, tag, attrs):
        pre = self._node(tag, {k: (v if v is not None else "") for k, v in attrs}, None)
        if tag in VOID:
            self._close(pre)
        else:
            self.stack.append((pre, tag))
            self.open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self._close(self._node(tag, {k: (v if v is not None else "") for k, v in attrs}, None))

    def handle_endtag(self, tag):
        if not self.open[tag]:
            return  # stray end tag
        while self.stack:
            pre, t = self.stack.pop()
            self.open[t] -= 1
            self._close(pre)
            if t == tag:
                break

    def handle_data(self, data):
        if data:
            self._close(self._node(TEXT, None, data))

    def finish(self) -> dict[str, list]:
        self.close()
        while self.stack:
            self._close(self.stack.pop()[0])
        c = self.cols
        c["doc_id"] = [self.doc_id] * len(c["pre"])
        c["in_leaf"] = [None if t != TEXT else (p is not None and c["child_elements"][p] == 0)
                        for t, p in zip(c["tag"], c["parent"])]
        return c


def parse_markup(doc_id: str, content: str) -> list[dict]:
    """Node rows of one document (pure Python; used inside tasks)."""
    b = _TreeBuilder(doc_id)
    b.feed(content or "")
    cols = b.finish()
    return [dict(zip(COLUMNS, vals)) for vals in zip(*[cols[c] for c in COLUMNS])]


# Nodes gathered over small documents before a frame is handed on.
NODES_PER_FRAME = 20_000


_ARROW = pa.schema([("doc_id", pa.string()), ("pre", pa.int64()), ("post", pa.int64()), ("parent", pa.int64()), ("depth", pa.int32()),
                    ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()),
                    ("child_elements", pa.int32()), ("in_leaf", pa.bool_())])

# A tag that reads alike wherever it stands: plain names, values in double quotes.
_PLAIN = re.compile(r"""/[a-zA-Z][a-zA-Z0-9:._-]*|[a-zA-Z][a-zA-Z0-9:._-]*(?: [a-zA-Z][a-zA-Z0-9:._-]*="[^"&]*")* ?/?""")
# Elements whose content the tokenizer reads in another way.
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript plaintext svg math".split())
START, END, CLOSED = range(3)


class _OneTag(HTMLParser):
    """The events of one tag."""

    def __init__(self, tag: str):
        super().__init__(convert_charrefs=True)
        self.events: list[tuple] = []
        self.feed(tag)
        self.close()

    def handle_starttag(self, tag, attrs):
        kind = CLOSED if tag in VOID else START
        self.events.append((kind, tag, list({k: (v if v is not None else "") for k, v in attrs}.items())))

    def handle_startendtag(self, tag, attrs):
        self.events.append((CLOSED, tag, list({k: (v if v is not None else "") for k, v in attrs}.items())))

    def handle_endtag(self, tag):
        self.events.append((END, tag, None))

    def handle_data(self, data):
        self.events.append((None, data, None))


class _Tags(dict):
    """(kind, name, attributes) of plain tags met before, None for others."""

    def __missing__(self, raw: str):
        got = None
        if _PLAIN.fullmatch(raw):
            events = _OneTag(f"<{raw}>").events
            if len(events) == 1 and events[0][0] is not None and events[0][1] not in _RAW:
                got = events[0]
        if len(self) >= 50_000:
            self.clear()
        self[raw] = got
        return got


class _Nodes:
    """Nodes of several documents, a list per column. Documents of plain tags
    are cut at their brackets, with a tag read once however often it stands;
    any other document goes through the tokenizer whole."""

    def __init__(self, tags: _Tags):
        self.tags = tags
        self.docs: list[str] = []
        self.sizes: list[int] = []
        self.post: list[int] = []
        self.parent: list[int] = []          # -1: none
        self.depth: list[int] = []
        self.tag: list[str] = []
        self.attrs: list[list | None] = []
        self.text: list[str | None] = []

    def add(self, doc_id: str, content: str) -> None:
        before = len(self.tag)
        if not self._plain(content):
            for c in (self.post, self.parent, self.depth, self.tag, self.attrs, self.text):
                del c[before:]
            b = _TreeBuilder(doc_id)
            b.feed(content)
            c = b.finish()
            self.post += c["post"]
            self.parent += [-1 if p is None else p for p in c["parent"]]
            self.depth += c["depth"]
            self.tag += c["tag"]
            self.attrs += [a if a is None else list(a.items()) for a in c["attrs"]]
            self.text += c["text"]
        self.docs.append(doc_id)
        self.sizes.append(len(self.tag) - before)

    def _plain(self, content: str) -> bool:
        """Add a document's nodes as ``_TreeBuilder`` would; False at the
        first piece that is not a plain tag and the text behind it."""
        tags, base = self.tags, len(self.tag)
        posts, parents, depths, names, attrs, texts = self.post, self.parent, self.depth, self.tag, self.attrs, self.text
        stack: list[int] = []
        open_: list[str] = []
        of_name: dict[str, int] = {}         # open elements by name
        top, depth, post = -1, 0, 0
        for k, piece in enumerate(content.split("<")):
            if k:
                raw, close, data = piece.partition(">")
                tag = tags[raw] if close else None
                if tag is None:
                    return False
                kind, name, attributes = tag
                if kind == END:
                    if of_name.get(name):
                        while True:
                            posts[base + stack.pop()] = post
                            post += 1
                            was = open_.pop()
                            of_name[was] -= 1
                            if was == name:
                                break
                        depth = len(stack)
                        top = stack[-1] if depth else -1
                else:
                    parents.append(top)
                    depths.append(depth)
                    names.append(name)
                    attrs.append(attributes)
                    texts.append(None)
                    posts.append(post)
                    if kind == START:
                        top = len(names) - 1 - base
                        stack.append(top)
                        open_.append(name)
                        of_name[name] = of_name.get(name, 0) + 1
                        depth += 1
                    else:
                        post += 1
            else:
                data = piece
            if data and "&" in data:
                data = unescape(data)
            if data:
                parents.append(top)
                depths.append(depth)
                names.append(TEXT)
                attrs.append(None)
                texts.append(data)
                posts.append(post)
                post += 1
        while stack:
            posts[base + stack.pop()] = post
            post += 1
        return True

    def frame(self) -> pa.RecordBatch:
        sizes = np.array(self.sizes, np.int64)
        base = np.repeat(np.cumsum(sizes) - sizes, sizes)
        n = len(base)
        parent = np.array(self.parent, np.int64)
        orphan, at = parent < 0, np.where(parent < 0, 0, parent + base)
        tag = pa.array(self.tag, pa.string())
        is_text = np.equal(np.array(self.tag, object), TEXT).astype(bool)
        children = np.bincount(at[~orphan & ~is_text], minlength=n).astype(np.int32)
        cols = {"doc_id": pa.array(self.docs, pa.string()).take(pa.array(np.repeat(np.arange(len(sizes)), sizes))),
                "pre": pa.array(np.arange(n) - base), "post": pa.array(self.post, pa.int64()), "parent": pa.array(parent, mask=orphan),
                "depth": pa.array(self.depth, pa.int32()), "tag": tag, "attrs": pa.array(self.attrs, _ARROW.field("attrs").type),
                "text": pa.array(self.text, pa.string()), "child_elements": pa.array(children, mask=is_text),
                "in_leaf": pa.array(~orphan & (children[at] == 0), mask=~is_text)}
        return pa.RecordBatch.from_arrays([cols[f.name] for f in _ARROW], schema=_ARROW)


def _parse_batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tags = _Tags()
    acc = _Nodes(tags)
    for batch in it:
        for doc_id, content in zip(*batch.columns, strict=True):     # one text at a time leaves Arrow
            acc.add(str(doc_id.as_py()), content.as_py() or "")
            if len(acc.tag) >= NODES_PER_FRAME:
                yield acc.frame()
                acc = _Nodes(tags)
    if acc.tag:
        yield acc.frame()


def node_table(docs: DataFrame, doc_id: str = "doc_id", content: str = "content",
               min_partitions: int | None = None) -> DataFrame:
    """``(doc_id, content)`` documents -> node table (see module doc).

    Parsing is CPU-bound Python: documents that arrive in fewer than
    ``min_partitions`` splits are spread over that many tasks first; by default
    they are parsed where they are."""
    src = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(content).alias("content"))
    return spread(src, min_partitions).mapInArrow(_parse_batches, NODE_SCHEMA)


# ------------------------------------------------------------- relational ops

def elements(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("tag") != TEXT)


def _closing(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """``targets`` with ``post``, taken from the node table where it lacks."""
    if "post" in targets.columns:
        return targets.select("doc_id", "pre", "post")
    return targets.select("doc_id", "pre").join(elements(nodes).select("doc_id", "pre", "post"), ["doc_id", "pre"])


def element_text(nodes: DataFrame, targets: DataFrame, name: str = "text") -> DataFrame:
    """Full text (all descendant text runs in document order) of each
    target element ``(doc_id, pre[, post])``."""
    got = structural.covered_text(_closing(nodes, targets), nodes.where(F.col("tag") == TEXT), name=name)
    return targets.join(got, ["doc_id", "pre"], "left").withColumn(name, F.coalesce(F.col(name), F.lit("")))


def element_stripped_lengths(nodes: DataFrame, targets: DataFrame, name: str = "stripped_len") -> DataFrame:
    """``len(text.strip())`` of each target element's full text, from the
    length, blankness and outer white space of its runs: the text is neither
    moved nor built."""
    from figura.functions.text import WS_CLASS
    t = F.col("text")
    runs = nodes.where(F.col("tag") == TEXT).select(
        "doc_id", "pre", "post", F.length(t).alias("len"), t.rlike(f"^{WS_CLASS}*$").cast("int").alias("blank"),
        (F.length(t) - F.length(F.regexp_replace(t, f"^{WS_CLASS}+", ""))).alias("lead"),
        (F.length(t) - F.length(F.regexp_replace(t, f"{WS_CLASS}+$", ""))).alias("trail"))
    lens = structural.covered_lengths(_closing(nodes, targets), runs, name=name).withColumn(name, F.col(name).cast("int"))
    return targets.join(lens, ["doc_id", "pre"], "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)))


def child_text(nodes: DataFrame, targets: DataFrame, name: str = "text") -> DataFrame:
    """Concatenated text runs that are direct children of each target (an
    equi-join on the parent; for an element without element children this
    is its full text)."""
    runs = nodes.where(F.col("tag") == TEXT).select(
        "doc_id", F.col("parent").alias("pre"), F.col("pre").alias("_tp"), "text")
    hit = runs.join(targets.select("doc_id", "pre"), ["doc_id", "pre"])
    pairs = F.array_sort(F.collect_list(F.struct(F.col("_tp"), F.col("text"))))
    got = hit.groupBy("doc_id", "pre").agg(F.array_join(F.transform(pairs, lambda x: x["text"]), "").alias(name))
    return targets.join(got, ["doc_id", "pre"], "left").withColumn(name, F.coalesce(F.col(name), F.lit("")))


def leaf_tokens(nodes: DataFrame, targets: DataFrame, name: str = "tokens") -> DataFrame:
    """Raw tokens of each target: texts of its leaf descendants in document
    order, joined by spaces and split on whitespace (text lying directly in
    an element that also has element children is not included, nor is the
    text of a target that is a leaf itself)."""
    from figura.functions.text import whitespace_tokens
    got = structural.covered_text(_closing(nodes, targets), nodes.where(F.col("in_leaf")), name="_joined", leaf="parent")
    return (targets.join(got, ["doc_id", "pre"], "left")
            .withColumn(name, whitespace_tokens(F.coalesce(F.col("_joined"), F.lit("")))).drop("_joined"))


def attribute_values(nodes: DataFrame, tag: str, attr: str) -> DataFrame:
    """``(doc_id, pre, value)`` of attribute ``attr`` on every ``tag``
    element (nested ones included), document order via ``pre``."""
    return (elements(nodes).where((F.col("tag") == tag) & F.col("attrs").getItem(attr).isNotNull())
            .select("doc_id", "pre", F.col("attrs").getItem(attr).alias("value")))
