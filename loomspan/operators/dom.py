"""DOM trees: grouping and operation nodes of captured pages, scope candidates and resolved scopes."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.functions.batches import batches
from loomspan.functions.hashes import poly31

# Tags that group, and tags that are operated on.
GROUPING = ["html", "body", "main", "header", "footer", "div", "section", "article", "aside", "nav", "ul", "ol", "li", "table", "tbody", "tr", "td", "th", "form", "fieldset"]
OPERATION = ["input", "button", "select", "textarea", "a"]
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(["script", "style"])
TEXT_LIMIT = 120

ATTRIBUTES = {"roleAttr": "role", "ariaLabel": "aria-label", "nameAttr": "name", "typeAttr": "type", "placeholderAttr": "placeholder", "titleAttr": "title", "hrefAttr": "href", "dataTestIdAttr": "data-testid"}
NODE_SCHEMA = (
    "screenName string, ord bigint, tagPath string, depth bigint, tagName string, classAttr string, idAttr string, directGroupingChildCount bigint, "
    "containedOperationTagCount bigint, directOperationTagCount bigint, nodeType string, textContent string, "
    + ", ".join(f"{c} string" for c in ATTRIBUTES)
    + ", labelText string, ariaLabelledByText string, semanticText string, semanticSource string, descendantTitleText string, descendantDataTestIdAttr string, contextText string"
)
#: Semantic text: the first of these that there is, and its name.
SEMANTIC = [
    ("aria-label", "ariaLabel"), ("label", "labelText"), ("aria-labelledby", "ariaLabelledByText"), ("placeholder", "placeholderAttr"), ("title", "titleAttr"),
    ("svg-title", "descendantTitleText"), ("text", "textContent"), ("name", "nameAttr"), ("data-testid", "dataTestIdAttr"), ("descendant-data-testid", "descendantDataTestIdAttr"),
]
OPERATION_COLUMNS = ["tagName", "textContent", *ATTRIBUTES, "labelText", "ariaLabelledByText", "semanticText", "semanticSource", "descendantTitleText", "descendantDataTestIdAttr", "contextText"]


class _Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self):
        """This node and all below, in order, without recursion."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            if not isinstance(node, str):
                stack.extend(reversed(node.children))

    def text(self) -> str:
        return "".join(n for n in self.walk() if isinstance(n, str))


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("", {}, None)
        self.at = self.root

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "li", "tr", "td", "th") and self.at.tag == tag:
            self.at = self.at.parent
        node = _Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(_Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        if self.at.tag not in RAW:
            self.at.children.append(data)


def _clean(text: str | None) -> str | None:
    out = re.sub(r"\s+", " ", text or "").strip()
    return out[:TEXT_LIMIT] or None


def _attr(node: _Node, name: str) -> str | None:
    return (node.attrs.get(name) or "").strip() or None


def page_nodes(screen: str, html: str | None) -> list[dict]:
    """The node rows of one page, in document order; none without an html element."""
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    everything = [n for n in builder.root.walk() if not isinstance(n, str)]
    top = next((n for n in everything if n.tag == "html"), None)
    if top is None:
        return []
    labels = {_attr(n, "for"): t for n in everything if n.tag == "label" and _attr(n, "for") and (t := _clean(n.text()))}
    by_id = {_attr(n, "id"): t for n in everything if _attr(n, "id") and (t := _clean(n.text()))}
    inside: dict[int, int] = {}
    for n in reversed(everything):  # children come before their parents here
        inside[id(n)] = sum(1 if c.tag in OPERATION else inside[id(c)] for c in n.children if not isinstance(c, str))
    rows: list[dict] = []

    def grouping(node, path, depth):
        kids = [c for c in node.children if not isinstance(c, str)]
        rows.append({
            "tagPath": path, "depth": depth, "tagName": node.tag, "classAttr": (_attr(node, "class") or "").split(None, 1)[0] if _attr(node, "class") else None, "idAttr": _attr(node, "id"),
            "directGroupingChildCount": sum(c.tag in GROUPING for c in kids), "containedOperationTagCount": inside[id(node)],
            "directOperationTagCount": sum(c.tag in OPERATION for c in kids), "nodeType": "grouping",
        })

    def operation(node, path, depth):
        below = [n for n in node.walk() if not isinstance(n, str) and n is not node]
        svg = next((t for s in below if s.tag == "svg" for t in s.walk() if not isinstance(t, str) and t.tag == "title"), None)
        ids = (_attr(node, "aria-labelledby") or "").split()
        own = _clean(node.text())
        holder = node.parent
        while holder is not None and holder.tag not in ("li", "tr"):
            holder = holder.parent
        context = _clean(holder.text()) if holder is not None else None
        row = {
            "tagPath": path, "depth": depth, "tagName": node.tag, "classAttr": (_attr(node, "class") or "").split(None, 1)[0] if _attr(node, "class") else None, "idAttr": _attr(node, "id"),
            "directGroupingChildCount": 0, "containedOperationTagCount": 0, "directOperationTagCount": 0, "nodeType": "operation", "textContent": own,
            **{c: _attr(node, a) for c, a in ATTRIBUTES.items()},
            "labelText": labels.get(_attr(node, "id")) if _attr(node, "id") else None, "ariaLabelledByText": _clean(" ".join(by_id[i] for i in ids if i in by_id)),
            "descendantTitleText": _clean(svg.text()) if svg is not None else None,
            "descendantDataTestIdAttr": next((v for n in below if (v := _attr(n, "data-testid"))), None),
            "contextText": _clean(context.replace(own, "", 1)) if context and own else context,
        }
        row["semanticText"], row["semanticSource"] = next(((row[c], name) for name, c in SEMANTIC if row[c]), (None, None))
        rows.append(row)

    # An explicit stack: [node, next child, path, depth, operation counter]. Other tags are transparent but count operations anew.
    grouping(top, "html", 0)
    stack = [[top, 0, "html", 0, 0]]
    while stack:
        frame = stack[-1]
        node, i, path, depth, n = frame
        if i >= len(node.children):
            stack.pop()
            continue
        frame[1] += 1
        child = node.children[i]
        if isinstance(child, str):
            continue
        if child.tag in OPERATION:
            operation(child, f"{path}>{child.tag}[{n}]", depth + 1)
            frame[4] += 1
        elif child.tag in GROUPING:
            first = (_attr(child, "class") or "").split(None, 1)
            below = f"{path}>{child.tag}" + (f".{first[0]}" if first else "")
            grouping(child, below, depth + 1)
            stack.append([child, 0, below, depth + 1, 0])
        else:
            stack.append([child, 0, path, depth, 0])
    return [{"screenName": screen, "ord": k, **r} for k, r in enumerate(rows)]


def nodes(pages: DataFrame, name: str = "url", html: str = "html") -> DataFrame:
    """Node rows of all pages; a page is parsed where it is, nothing is shuffled."""
    columns = [c.split(" ")[0] for c in NODE_SCHEMA.split(", ")]

    def run(frames):
        for frame in frames:
            for rows in batches(r for screen, text in zip(frame["screen"], frame["html"]) for r in page_nodes(screen, text)):
                yield pd.DataFrame(rows, columns=columns).astype(object).where(lambda d: d.notna(), None)

    return pages.select(F.col(name).cast("string").alias("screen"), F.col(html).alias("html")).mapInPandas(run, NODE_SCHEMA)


def semantic(df: DataFrame) -> DataFrame:
    """semanticText and semanticSource of operation rows as native expressions."""
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    text = F.coalesce(*(some(c) for _, c in SEMANTIC))
    source = F.coalesce(*(F.when(some(c).isNotNull(), name) for name, c in SEMANTIC))
    return df.withColumn("semanticText", text).withColumn("semanticSource", source)


def parent_path(c):
    return F.regexp_extract(c, r"^(.*)>[^>]*$", 1)


def candidates(node_rows: DataFrame) -> DataFrame:
    """Scope candidates: screenName, tagPath, operationTagCount, siblingScopeCount (candidates of the same parent and shape), priorityScore."""
    direct, inside = F.col("directOperationTagCount"), F.col("containedOperationTagCount")
    kept = node_rows.where((F.col("nodeType") == "grouping") & ((direct >= 2) | ((inside >= 2) & (F.col("directGroupingChildCount") <= 1))))
    shape = F.concat_ws("|", "tagName", F.coalesce("classAttr", F.lit("")), "directGroupingChildCount", "directOperationTagCount", "containedOperationTagCount")
    # Nodes of one path share the shape of the first of them.
    kept = kept.withColumn("shape", shape).withColumn("parentPath", parent_path(F.col("tagPath")))
    first = kept.groupBy("screenName", "tagPath").agg(F.min_by("shape", "ord").alias("shape"), F.count("*").alias("n"), F.first("parentPath").alias("parentPath"))
    sizes = first.groupBy("screenName", "parentPath", "shape").agg(F.sum("n").alias("siblingScopeCount"))
    counted = first.drop("n").join(sizes, ["screenName", "parentPath", "shape"]).select("screenName", "tagPath", "siblingScopeCount")
    out = kept.select("screenName", "tagPath", F.greatest(direct, inside).alias("operationTagCount")).join(counted, ["screenName", "tagPath"])
    return out.withColumn("priorityScore", F.col("operationTagCount") * 100 + F.col("siblingScopeCount"))


def nearest_ancestor(rows: DataFrame, scopes: DataFrame) -> DataFrame:
    """rows (screenName, tagPath) with parentPath: the longest proper ancestor path that is a scope of the screen, or NULL."""
    steps = F.split("tagPath", ">")
    above = F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda i: F.array_join(F.slice(steps, F.lit(1), i), ">"))
    asked = rows.select("screenName", "tagPath").distinct().where(F.size(steps) > 1).select("screenName", "tagPath", F.explode(above).alias("scopePath"))
    found = asked.join(scopes.select("screenName", F.col("tagPath").alias("scopePath")).distinct(), ["screenName", "scopePath"])
    best = found.groupBy("screenName", "tagPath").agg(F.max_by("scopePath", F.length("scopePath")).alias("scopePath"))
    return rows.join(best, ["screenName", "tagPath"], "left")


def scopes(node_rows: DataFrame) -> DataFrame:
    """Resolved scopes: candidates as static_root or (repeated) current_scope, and operations as leaf_operation, each with its nearest scope above."""
    c = candidates(node_rows)
    repeated = F.col("siblingScopeCount") >= 2
    none = [F.lit(None).cast("string").alias(x) for x in OPERATION_COLUMNS]
    roots = c.select(
        "screenName", "tagPath", F.when(repeated, "current_scope").otherwise("static_root").alias("role"), F.when(repeated, F.col("siblingScopeCount")).alias("repeatGroupSize"), *none
    )
    leaves = node_rows.where("nodeType = 'operation'").select("screenName", "tagPath", F.lit("leaf_operation").alias("role"), F.lit(None).cast("bigint").alias("repeatGroupSize"), *OPERATION_COLUMNS)
    out = nearest_ancestor(roots.unionByName(leaves), c)
    return out.select(
        "screenName", poly31(F.col("tagPath")).alias("scopeId"), "tagPath", "role", F.when(F.col("scopePath").isNotNull(), poly31(F.col("scopePath"))).alias("parentScopeId"),
        "repeatGroupSize", *OPERATION_COLUMNS,
    )
