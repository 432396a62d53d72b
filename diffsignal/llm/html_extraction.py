"""Main text of web pages by minimum-cut labelling (operator 10).

Every text block is a node.  A linear classifier's score becomes two terminal
capacities: what it costs to call the block boilerplate, and what to call it
content.  Neighbours in the page, and neighbours inside one parent element, are
tied by smoothness edges that weaken with their distance in the DOM.  The
minimum cut between the terminals is the cheapest labelling of the whole page;
maximum flow finds it.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_blocks import Block, Element, blocks

# The classifier's weights, in units of log odds.
CONTEXT = {1: 3.0, 0: 0.0, -1: -4.0, -2: -6.0}
TAGS = {"p": 1.0, "h1": 1.0, "blockquote": 0.5, "pre": 0.5, "li": -0.5, "td": -0.5}
LENGTH, LINKS, SENTENCE = 0.8, -4.0, 0.5
#: Smoothness of neighbours at distance 0 and of siblings; each step in the DOM beyond two paragraphs of one parent divides it by STEP, a change of context by APART.
ADJACENT, SIBLING, STEP, APART, UNIT = 1.8, 1.2, 2.0, 20.0, 1000


def score(b: Block) -> float:
    """Log odds that a block is content."""
    words = b.text.count(" ") + 1
    length = max(-2.0, min(2.0, math.log(words / 8)))
    return CONTEXT[b.context] + TAGS.get(b.tag, 0.0) + LENGTH * length + LINKS * b.link_share + (SENTENCE if b.text[-1] in ".!?…。" else 0.0)


def dom_distance(a: Element, b: Element) -> int:
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def content_side(capacities: list[tuple[int, int]], edges: list[tuple[int, int, int]]) -> list[bool]:
    """The source side of a minimum cut: capacities from the source and to the sink of each node; edges with their weight both ways.

    Flow from source over one node to the sink is taken at once; levelled
    augmenting paths carry the rest from nodes with excess to nodes short of it.
    """
    excess = [s - t for s, t in capacities]
    graph: list[list[int]] = [[] for _ in capacities]
    to: list[int] = []
    left: list[int] = []
    for a, b, w in edges:
        graph[a].append(len(to))
        graph[b].append(len(to) + 1)
        to += [b, a]
        left += [w, w]

    def levels() -> list[int]:
        level = [0 if x > 0 else -1 for x in excess]
        queue = deque(i for i, x in enumerate(excess) if x > 0)
        while queue:
            a = queue.popleft()
            for e in graph[a]:
                if left[e] and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        return level

    while True:
        level = levels()
        if not any(x < 0 <= v for x, v in zip(excess, level)):
            return [v >= 0 for v in level]
        following = [0] * len(graph)
        for source in [i for i, x in enumerate(excess) if x > 0]:
            path: list[int] = []
            node = source
            while excess[source] > 0:
                if excess[node] < 0:
                    flow = min(excess[source], -excess[node], *(left[e] for e in path))
                    for e in path:
                        left[e] -= flow
                        left[e ^ 1] += flow
                    excess[source] -= flow
                    excess[node] += flow
                    path, node = [], source
                    continue
                while following[node] < len(graph[node]):
                    e = graph[node][following[node]]
                    if left[e] and level[to[e]] == level[node] + 1:
                        break
                    following[node] += 1
                else:
                    if not path:
                        break
                    e = path.pop()
                    node = to[e ^ 1]
                    following[node] += 1
                    continue
                path.append(e)
                node = to[e]


def network(found: list[Block]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
    """Terminal capacities and smoothness edges of a page's blocks."""
    softplus = lambda x: max(x, 0.0) + math.log1p(math.exp(-abs(x)))
    capacities = [(round(UNIT * softplus(s)), round(UNIT * softplus(-s))) for s in map(score, found)]
    edges, last = [], {}
    tie = lambda i, j, w: edges.append((i, j, round(UNIT * w / (1.0 if found[i].context == found[j].context else APART))))
    for i, b in enumerate(found):
        if i:
            tie(i - 1, i, ADJACENT / STEP ** max(0, min(dom_distance(found[i - 1].parent, b.parent), 30) - 2))
        above = b.parent.parent.number if b.parent.parent else -1
        if above in last:
            tie(last[above], i, SIBLING)
        last[above] = i
    return capacities, [e for e in edges if e[2]]


def main_text(page: str | None) -> str:
    found = blocks(page) if page else []
    content = content_side(*network(found)) if found else []
    return " ".join(b.text for b, keep in zip(found, content) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """Per page (page_id, url, text, n_chars) with the main text of its whole html.

    pages: page_id, url and html; other columns are ignored.  A null or empty
    html, and a page without content, gives the empty text; repeated rows and
    null ids are extracted like others.  Character references are decoded,
    white space in a block is one space, blocks are joined by one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
