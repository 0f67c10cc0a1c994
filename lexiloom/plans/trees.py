"""Question trees as node tables (tree_id, node_id, parent_id, side, node_type, query)."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import MAX_RETRIEVALS

MAX_DEPTH = 8


def depths(nodes: DataFrame) -> DataFrame:
    """tree_id, node_id, depth (root 1), path (sides from the root), by a recursive query."""
    nodes.createOrReplaceTempView("__nodes")
    return nodes.sparkSession.sql(
        f"WITH RECURSIVE t(tree_id, node_id, depth, path) MAX RECURSION LEVEL {MAX_DEPTH + 2} AS ("
        " SELECT tree_id, node_id, 1, '' FROM __nodes WHERE parent_id IS NULL"
        " UNION ALL SELECT n.tree_id, n.node_id, t.depth + 1, concat(t.path, n.side) FROM __nodes n JOIN t ON n.tree_id = t.tree_id AND n.parent_id = t.node_id)"
        " SELECT * FROM t"
    )


def shape(nodes: DataFrame) -> DataFrame:
    """tree_id, depth, leaves."""
    leaf = nodes.where("node_type = 'leaf'").select("tree_id", "node_id", F.lit(1).alias("leaf"))
    return depths(nodes).join(leaf, ["tree_id", "node_id"], "left").groupBy("tree_id").agg(F.max("depth").alias("depth"), F.count("leaf").alias("leaves"))


def consensus(nodes: DataFrame, group: DataFrame) -> DataFrame:
    """question, tree_id: of each question's candidate trees the first with the commonest (depth, leaves);
    at a tie the shape that comes first.  group(question, tree_id, pos)."""
    rows = shape(nodes).join(group, "tree_id")
    votes = Window.partitionBy("question", "depth", "leaves")
    rows = rows.withColumn("votes", F.count("*").over(votes)).withColumn("first", F.min("pos").over(votes))
    return rows.groupBy("question").agg(F.min_by("tree_id", F.struct(-F.col("votes"), "first", "pos")).alias("tree_id"))


def truncate(nodes: DataFrame, height: int) -> DataFrame:
    """Trees cut to ``height`` levels: inner nodes on the last level become leaves."""
    at = nodes.join(depths(nodes).select("tree_id", "node_id", "depth"), ["tree_id", "node_id"])
    kind = F.when(F.col("depth") == height, F.lit("leaf")).otherwise(F.col("node_type"))
    return at.where(F.col("depth") <= height).withColumn("node_type", kind).drop("depth")


def retrieval_plan(nodes: DataFrame, most: int = MAX_RETRIEVALS) -> DataFrame:
    """tree_id, node_id, query, n: leaves left to right, at most ``most`` a tree."""
    leaves = nodes.where("node_type = 'leaf'").join(depths(nodes).select("tree_id", "node_id", "path"), ["tree_id", "node_id"])
    n = F.row_number().over(Window.partitionBy("tree_id").orderBy("path"))
    return leaves.withColumn("n", n).where(F.col("n") <= most).select("tree_id", "node_id", "query", "n")


def substitute(query, answer, most: int = 500):
    """The left answer in place of its mark in a right query."""
    return F.replace(query, F.lit("[answer_left]"), F.substring(answer, 1, most))


def leaf_answer(results: DataFrame, k: int = 3, chars: int = 200) -> DataFrame:
    """query_id, answer: snippets of the k best results joined - the deterministic stand-in for a model."""
    n = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    rows = results.withColumn("n", n).where(F.col("n") <= k)
    parts = F.array_sort(F.collect_list(F.struct("n", F.substring("text", 1, chars).alias("t"))))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(parts, lambda x: x["t"]), " ").alias("answer"))


LEVELS = ("L1", "L2", "L3", "L4", "L5", "L6")


def valid_level(level):
    """A classifier's level, L2 where it is none of the six."""
    level = F.upper(F.trim(level))
    return F.when(level.isin(*LEVELS), level).otherwise("L2")


def premise_correction(score, text, least: float = 0.3):
    """The best result's first sentence (its first 200 characters if that is longer) where it scores enough."""
    at = F.instr(text, ". ")
    return F.when(score >= least, F.when((at > 0) & (at < 200), F.substring(text, F.lit(1), at)).otherwise(F.substring(text, 1, 200)))


def solve(nodes: DataFrame, answer: Callable[[str], str], most: int = MAX_RETRIEVALS, chars: int = 500) -> DataFrame:
    """tree_id, node_id, query (as asked), answer of every node, children before parents.

    A tree is solved by one task (it has at most 2^MAX_DEPTH nodes): leaves left to right, ``most`` of
    them with an answer; the left answer of a sequential node goes into every query of its right subtree;
    a node's answer is that of its children, and marks that nothing filled are taken out at the end."""

    def one(tree):
        import pandas as pd

        rows = {int(r.node_id): r for r in tree.itertuples()}
        below: dict[int, list] = {}
        for r in sorted(rows.values(), key=lambda r: r.side or ""):
            if r.parent_id == r.parent_id and r.parent_id is not None:
                below.setdefault(int(r.parent_id), []).append(int(r.node_id))
        done, asked = [], 0

        def visit(k: int, given: str | None) -> str:
            nonlocal asked
            r, kids = rows[k], below.get(k, [])
            query = r.query if given is None else r.query.replace("[answer_left]", given)
            if not kids or r.node_type not in ("sequential", "parallel"):
                asked += 1
                out = answer(query) if asked <= most else ""
            else:
                parts = [visit(kids[0], given)]
                for kid in kids[1:]:
                    parts.append(visit(kid, given if given is not None or r.node_type == "parallel" else parts[0][:chars]))
                out = "\n\n".join(parts)
            if "[answer_" in out:
                out = re.sub(r"\[answer_\w+\]", "", out).strip()
            done.append((r.tree_id, k, query, out))
            return out

        for k in [k for k, r in rows.items() if r.parent_id != r.parent_id or r.parent_id is None]:
            visit(k, None)
        return pd.DataFrame(done, columns=["tree_id", "node_id", "query", "answer"])

    return nodes.groupBy("tree_id").applyInPandas(one, "tree_id long, node_id long, query string, answer string")
