"""Section trees as JSON: an upload has the tree, an object or a list, and the flat list of its nodes."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE = "struct<node_id:string,title:string,section_id:string,start_index:int,end_index:int,summary:string>"
FIELDS = ("node_id", "title", "section_id", "start_index", "end_index", "summary")


def wrapped_tree(tree: Column) -> Column:
    """The JSON of a tree as an object: a list becomes its nodes."""
    t = F.trim(tree)
    return F.when(t.startswith("["), F.concat(F.lit('{"nodes":'), t, F.lit("}"))).otherwise(t)


def below(tree: dict | list) -> Iterator[dict]:
    """The nodes of a tree in page order, each before its children."""
    todo = [tree]
    while todo:
        n = todo.pop()
        if isinstance(n, list):
            todo += reversed(n)
        elif isinstance(n, dict):
            if any(k in n for k in ("node_id", "title", "start_index")):
                yield n
            todo += reversed(n.get("nodes") or [])


def _flat(c: pa.Array) -> pa.Array:
    out = []
    for text in c.to_pylist():
        try:
            tree = json.loads(text) if text else None
        except ValueError:
            tree = None
        out.append(None if tree is None else json.dumps([{k: n.get(k) for k in FIELDS} for n in below(tree)]))
    return pa.array(out, pa.string())


def flat_nodes(tree: Column) -> Column:
    """The JSON list of all nodes of a tree; null for what isn't JSON."""
    return F.arrow_udf(_flat, "string")(tree)


def uploads(bodies: DataFrame) -> DataFrame:
    """bodies: document_id, body (JSON with tree and flat_nodes; without these, the tree's own nodes count). document_id, tree, flat_nodes."""
    x = bodies.select("document_id", F.get_json_object("body", "$.tree").alias("tree"), F.get_json_object("body", "$.flat_nodes").alias("flat_nodes"))
    return x.select("document_id", wrapped_tree(F.col("tree")).alias("tree"), F.coalesce("flat_nodes", flat_nodes(F.col("tree"))).alias("flat_nodes"))


def leaves(trees: DataFrame) -> DataFrame:
    """One row for each flat node of document_id, flat_nodes, in list order."""
    nodes = F.from_json("flat_nodes", f"array<{NODE}>")
    return trees.select("document_id", F.posexplode(nodes).alias("leaf_pos", "n")).select("document_id", "leaf_pos", *[F.col(f"n.{k}").alias(k) for k in FIELDS])
