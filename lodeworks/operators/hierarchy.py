"""Parent-child links to full hierarchies.

Components are found by pointer doubling (each node keeps one parent, so its
chain of parents is a function and log2(depth) rounds reach the end), then every
component is co-located and walked once by an iterative depth-first traversal
with node colouring. A component with more nodes than ``max_component`` is never
brought into one task: its nodes get path, depth and root from doubling, which
is exact as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.common import cut, drop_cut

MAX_COMPONENT = 200_000
PATH_SEP = "/"


def parent_links(links: DataFrame) -> DataFrame:
    """Distinct (tree, node, parent) links, one parent per node.

    Null endpoints link nothing. A node with several parents keeps the
    smallest parent id as tree parent; how many others it had is in
    ``other_parents``, and :func:`other_parent_links` has the links themselves.
    """
    return (
        links.where("node is not null and parent is not null")
        .groupBy("tree", "node")
        .agg(F.min("parent").alias("parent"), (F.count_distinct("parent") - 1).cast("int").alias("other_parents"))
    )


def other_parent_links(links: DataFrame) -> DataFrame:
    """Distinct (tree, node, parent) links that no tree of :func:`hierarchy` follows: those of nodes with several parents but for the smallest."""
    whole = links.where("node is not null and parent is not null").select("tree", "node", "parent").distinct()
    return whole.join(parent_links(links).where("other_parents > 0").select("tree", "node", F.col("parent").alias("_kept")), ["tree", "node"]).where("parent <> _kept").drop("_kept")


def _double(links: DataFrame, with_path: bool) -> tuple[DataFrame, DataFrame]:
    """(ended, endless): nodes whose chain reaches a root with root, depth and
    ancestors, and nodes whose chain never ends with a node ``ptr`` far up the chain
    and the smallest id ``low`` passed on the way."""
    start = [F.col("parent").alias("ptr"), F.lit(1).alias("dist"), F.least("node", "parent").alias("low")]
    if with_path:
        start.append(F.array("parent").alias("anc"))
    open_ = cut(links.select("tree", "node", *start))
    ended: DataFrame | None = None
    left = open_.count()
    rounds = 0
    while True:
        up = [F.col("node").alias("u_node"), F.col("tree").alias("u_tree"), F.col("ptr").alias("u_ptr"), F.col("dist").alias("u_dist"), F.col("low").alias("u_low")]
        up += [F.col("anc").alias("u_anc")] if with_path else []
        # a parent that is itself settled, or never had a parent, ends the chain
        step = open_.alias("o").join(open_.select(*up), (F.col("tree") == F.col("u_tree")) & (F.col("ptr") == F.col("u_node")), "left")
        moved = [
            "tree", "node",
            F.coalesce("u_ptr", "ptr").alias("ptr"),
            (F.col("dist") + F.coalesce("u_dist", F.lit(0))).alias("dist"),
            F.least("low", F.coalesce("u_low", F.col("low"))).alias("low"),
            F.col("u_ptr").isNull().alias("over"),
        ]
        if with_path:
            moved.append(F.when(F.col("u_anc").isNull(), F.col("anc")).otherwise(F.concat("anc", "u_anc")).alias("anc"))
        state = step.select(*moved)
        if ended is not None:
            # chains whose pointer is settled finish from the settled row
            done_cols = [F.col("node").alias("d_node"), F.col("tree").alias("d_tree"), F.col("ptr").alias("d_ptr"), F.col("dist").alias("d_dist")]
            done_cols += [F.col("anc").alias("d_anc")] if with_path else []
            over = state.where("over").join(ended.select(*done_cols), (F.col("tree") == F.col("d_tree")) & (F.col("ptr") == F.col("d_node")), "left")
            fin = [
                "tree", "node", F.coalesce("d_ptr", "ptr").alias("ptr"), (F.col("dist") + F.coalesce("d_dist", F.lit(0))).alias("dist"), "low", "over",
            ]
            if with_path:
                fin.append(F.when(F.col("d_anc").isNull(), F.col("anc")).otherwise(F.concat("anc", "d_anc")).alias("anc"))
            state = over.select(*fin).unionByName(state.where("not over"))
        state = cut(state)
        drop_cut(open_)
        newly = state.where("over").drop("over")
        open_ = state.where("not over").drop("over")
        open_.cut_path = None
        ended = newly if ended is None else ended.unionByName(newly)
        now = open_.count()
        rounds += 1
        if now == 0 or (now == left and 2**rounds >= now):
            return ended, open_
        left = now


def components(links: DataFrame) -> DataFrame:
    """(tree, node, parent, comp, root, depth): comp is the root, or for chains
    that never end the smallest id of the cycle they run into."""
    ended, endless = _double(links, with_path=False)
    # ptr of an endless node lies on its cycle, and a node on the cycle has only cycle nodes above it
    on_cycle = endless.select(F.col("tree").alias("c_tree"), F.col("node").alias("c_node"), F.col("low").alias("c_low"))
    cyc = endless.join(on_cycle, (F.col("tree") == F.col("c_tree")) & (F.col("ptr") == F.col("c_node"))).select(
        "tree", "node", F.col("c_low").alias("comp"), F.lit("").alias("root"), F.lit(-1).alias("depth")
    )
    found = ended.select("tree", "node", F.col("ptr").alias("comp"), F.col("ptr").alias("root"), F.col("dist").alias("depth"))
    return found.unionByName(cyc).join(links.select("tree", "node", "parent"), ["tree", "node"])


_OUT = "tree string, node string, root string, depth int, path array<string>, descendants bigint, cycle_edge boolean"


def _walk(rows: list[tuple[str, str]], with_path: bool, with_roots: bool = False) -> Iterator[tuple]:
    """Iterative depth-first traversal with colouring of one component.

    rows: (node, parent). White nodes are unseen, grey ones on the stack,
    black ones left; an edge into a grey node is a back edge, hence a cycle.
    """
    kids: dict[str, list[str]] = {}
    parent = {}
    for node, up in rows:
        kids.setdefault(up, []).append(node)
        parent[node] = up
    grey, black = 1, 2
    colour: dict[str, int] = {}
    for root in sorted(up for up in kids if up not in parent):
        stack = [(root, iter(kids[root]))]
        colour[root] = grey
        path = [root]
        sizes = [0]
        while stack:
            node, rest = stack[-1]
            child = next(rest, None)
            if child is not None:
                colour[child] = grey
                stack.append((child, iter(kids.get(child, ()))))
                path.append(child)
                sizes.append(0)
                continue
            stack.pop()
            colour[node] = black
            size = sizes.pop()
            if stack:
                sizes[-1] += size + 1
            if stack or with_roots:
                yield node, root, len(path) - 1, list(path) if with_path else None, size, False
            path.pop()
    # what is white now hangs below no root: go up until a grey node closes the cycle
    lost = sorted(n for n in parent if n not in colour)
    back = set()
    for node in lost:
        trail = []
        while node not in colour:
            colour[node] = grey
            trail.append(node)
            node = parent[node]
        if colour[node] == grey:
            back.add(min(trail[trail.index(node) :]))
        for n in trail:
            colour[n] = black
    for node in lost:
        yield node, "", -1, None, None, node in back


def _walk_partition(batches: Iterator[pd.DataFrame], with_path: bool, with_roots: bool = False) -> Iterator[pd.DataFrame]:
    """Components come sorted, so one is held at a time, whatever the batches' borders."""
    names = ["tree", "node", "root", "depth", "path", "descendants", "cycle_edge"]
    ready: list[tuple] = []
    weight = 0

    def frame() -> pd.DataFrame:
        f = pd.DataFrame(ready, columns=names)
        f["descendants"] = f["descendants"].astype("Int64")
        ready.clear()
        return f

    def groups() -> Iterator[tuple[str, list[tuple[str, str]]]]:
        key, rows = None, []
        for pdf in batches:
            for tree, comp, node, parent in zip(pdf["tree"], pdf["comp"], pdf["node"], pdf["parent"], strict=True):
                if (tree, comp) != key:
                    if rows:
                        yield key[0], rows
                    key, rows = (tree, comp), []
                rows.append((node, parent))
        if rows:
            yield key[0], rows

    for tree, rows in groups():
        for r in _walk(rows, with_path, with_roots):
            ready.append((tree, *r))
            weight += 1 + len(r[3] or ())
            if weight > 200_000:
                yield frame()
                weight = 0
    if ready:
        yield frame()


def hierarchy(links: DataFrame, with_path: bool = True, max_component: int = MAX_COMPONENT, with_roots: bool = False, with_descendants: bool = True) -> DataFrame:
    """Full hierarchy of parent-child links.

    links: (tree STRING, node STRING, parent STRING), other columns are
    ignored; repeated rows and null endpoints are allowed, an empty table gives
    an empty result. Returns one row per node that has a parent: ``root``,
    ``depth`` (a root has 0), ``path`` (ids from the root to the node),
    ``descendants`` (their number) and ``cycle_edge``. Nodes whose chain enters a
    cycle have root '', depth -1 and null path and descendants; ``cycle_edge``
    marks in each cycle the smallest node, whose parent link closes it.
    ``with_roots`` adds a row of depth 0 for each node that has children but no parent. Without paths and with
    ``with_descendants=False`` a component beyond ``max_component`` builds no ancestor lists: its roots and depths are
    those of the doubling, and its ``descendants`` are null.
    """
    one = cut(parent_links(links))
    comp = cut(components(one))
    sizes = comp.groupBy("tree", "comp").count()
    big = sizes.where(F.col("count") > max_component).select("tree", "comp")
    small = comp.join(big, ["tree", "comp"], "left_anti")
    walked = (
        small.select("tree", "comp", "node", "parent")
        .repartition("tree", "comp")
        .sortWithinPartitions("tree", "comp")
        .mapInPandas(lambda it: _walk_partition(it, with_path, with_roots), _OUT)
    )
    large = comp.join(big, ["tree", "comp"], "left_semi")
    if not large.isEmpty():
        walked = walked.unionByName(_large(large, with_path, with_roots, with_path or with_descendants))
    return walked


def _large(comp: DataFrame, with_path: bool, with_roots: bool = False, with_descendants: bool = True) -> DataFrame:
    """Components beyond the bound: root and depth are known from doubling;
    paths by doubling with ancestor lists, descendants by counting ancestors."""
    rooted = comp.where("depth >= 0")
    cyclic = comp.where("depth < 0")
    no_path, no_number = F.lit(None).cast("array<string>"), F.lit(None).cast("bigint")
    if with_descendants:
        anc, _ = _double(rooted.select("tree", "node", "parent"), with_path=True)
    else:
        anc = rooted.select("tree", "node", F.col("root").alias("ptr"), F.col("depth").alias("dist"), F.array().cast("array<string>").alias("anc"))
    number = anc.select("tree", F.explode("anc").alias("node")).groupBy("tree", "node").agg(F.count("*").alias("descendants"))
    path = F.concat(F.reverse("anc"), F.array("node")) if with_path else no_path
    trees = (
        anc.join(number, ["tree", "node"], "left")
        .select("tree", "node", F.col("ptr").alias("root"), F.col("dist").cast("int").alias("depth"), path.alias("path"), (F.coalesce("descendants", F.lit(0)) if with_descendants else no_number).alias("descendants"), F.lit(False).alias("cycle_edge"))
    )
    lost = cyclic.select(
        "tree", "node", F.lit("").alias("root"), F.lit(-1).alias("depth"), no_path.alias("path"), no_number.alias("descendants"),
        (F.col("node") == F.col("comp")).alias("cycle_edge"),
    )
    out = trees.unionByName(lost)
    if not with_roots:
        return out
    own = F.array("node") if with_path else F.lit(None).cast("array<string>")
    tops = rooted.groupBy("tree", F.col("root").alias("node")).agg(F.count("*").alias("descendants"))
    return out.unionByName(tops.select("tree", "node", F.col("node").alias("root"), F.lit(0).alias("depth"), own.alias("path"), "descendants", F.lit(False).alias("cycle_edge")))


def descendant_pairs(tree: DataFrame) -> DataFrame:
    """(tree, node, descendant, distance) of all nodes, roots included, from the paths of :func:`hierarchy`."""
    at = tree.where("path is not null").select("tree", F.col("node").alias("descendant"), "depth", F.posexplode("path").alias("pos", "node"))
    return at.where("pos < depth").select("tree", "node", "descendant", (F.col("depth") - F.col("pos")).alias("distance"))
