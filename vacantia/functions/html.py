"""Per-page HTML reading inside Arrow batches, with the standard library parser.

A batch may hold ten thousand pages. Only a slice of it is made into Python objects at a time, so a worker's memory is that
of the batch in Arrow form, whose bytes the session bounds.
"""

import json
from collections import namedtuple
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from vacantia.functions import fixed_values as V
from vacantia.functions.exprs import squeeze

HIDDEN = {"script", "style", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class Node:
    """An element with its children, as far as the harvesters need one."""

    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag, attrs=(), parent=None):
        self.tag, self.attrs, self.parent, self.children = tag, dict(attrs), parent, []

    def walk(self):
        """Descendant elements in document order, without recursion so deep pages are safe."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def find_all(self, *tags):
        return (n for n in self.walk() if n.tag in tags)

    def texts(self, hidden=False):
        """Visible strings below this element, in document order."""
        stack = list(reversed(self.children))
        while stack:
            child = stack.pop()
            if isinstance(child, str):
                yield child
            elif hidden or child.tag not in HIDDEN:
                stack.extend(reversed(child.children))

    def text(self, sep=" ", hidden=False):
        return sep.join(s for s in map(str.strip, self.texts(hidden)) if s)


class _TreeBuilder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("")
        self.in_text = False

    def _add(self, child):
        self.at.children.append(child)
        self.in_text = isinstance(child, str)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, attrs, self.at)
        self._add(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self._add(Node(tag, attrs, self.at))

    def handle_endtag(self, tag):
        self.in_text = False
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        # The parser hands over one run of text in pieces; comments end a run.
        if self.in_text:
            self.at.children[-1] += data
        else:
            self._add(data)

    def _skip(self, _):
        self.in_text = False

    handle_comment = handle_decl = handle_pi = unknown_decl = _skip


def parse(html: str) -> Node:
    builder = _TreeBuilder()
    builder.feed(html)
    builder.close()
    return builder.root


class _TextReader(HTMLParser):
    """Visible strings of a page, collected while it is parsed; only the names of open elements are kept."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.strings, self.run, self.open, self.hidden = [], [], [], 0

    def end_run(self):
        if self.run:
            text = "".join(self.run).strip()
            if text:
                self.strings.append(text)
            self.run.clear()

    def handle_starttag(self, tag, attrs):
        self.end_run()
        if tag not in VOID:
            self.open.append(tag)
            self.hidden += tag in HIDDEN

    def handle_startendtag(self, tag, attrs):
        self.end_run()

    def handle_endtag(self, tag):
        self.end_run()
        if tag in self.open:
            while True:
                last = self.open.pop()
                self.hidden -= last in HIDDEN
                if last == tag:
                    return

    def handle_data(self, data):
        if not self.hidden:
            self.run.append(data)

    def _skip(self, _):
        self.end_run()

    handle_comment = handle_decl = handle_pi = unknown_decl = _skip


def visible_text(html: str) -> str:
    reader = _TextReader()
    reader.feed(html)
    reader.close()
    reader.end_run()
    return " ".join(reader.strings)


# Pages of a batch whose text a worker holds as Python objects at a time.
PAGES = 256


@F.arrow_udf(StringType())
def _page_text(pages: pa.Array) -> pa.Array:
    """Texts of a batch of pages, made from a slice of it at a time."""
    texts = [pa.array([visible_text(html) if html else None for html in pages.slice(at, PAGES).to_pylist()], pa.string())
             for at in range(0, len(pages), PAGES)]
    return pa.concat_arrays(texts) if texts else pa.array([], pa.string())


def records(batches):
    """Lists of the rows of Arrow batches as named tuples, a slice of a batch at a time."""
    for batch in batches:
        row = namedtuple("Row", batch.schema.names)
        for at in range(0, batch.num_rows, PAGES):
            yield list(map(row, *(c.to_pylist() for c in batch.slice(at, PAGES).columns)))


def record_batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    """An Arrow batch of tuples."""
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def page_text(html: Column) -> Column:
    """Visible text, strings joined by a space; null when there is none."""
    return F.nullif(_page_text(html), F.lit(""))


def snippet(html: Column, max_chars: int = V.SNIPPET_CHARS) -> Column:
    """Start of the visible text with collapsed blanks."""
    return F.substring(squeeze(page_text(html)), 1, max_chars)


def json_nodes(document):
    """Every object inside a JSON document, outermost first, in document order."""
    stack = [document]
    while stack:
        item = stack.pop()
        if isinstance(item, dict):
            yield item
            stack.extend(reversed(item.values()))
        elif isinstance(item, list):
            stack.extend(reversed(item))


def load_json(body):
    try:
        return json.loads(body)
    except (TypeError, ValueError, RecursionError):
        return None
