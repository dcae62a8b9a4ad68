"""Property graph operators on nodes(id, name, label, qualified_name, file_path, properties) and
edges(id, source_id, target_id, type, weight, properties).

Loops cut their lineage in the shared folder after each level and stop at an empty frontier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeworks.common import cut, drop_cut, union_all

#: Names that are called from outside.
ENTRY_POINTS = ["main", "run", "start", "handle", "entry", "bootstrap", "init_app"]


def of_type(edges: DataFrame, *types: str) -> DataFrame:
    return edges.where(F.upper("type").isin([t.upper() for t in types]))


def links(edges: DataFrame, direction: str = "outgoing") -> DataFrame:
    """(src, dst, edge_id) in walking direction; ``both`` gives each edge both ways."""
    out = edges.where("source_id is not null and target_id is not null").select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), F.col("id").alias("edge_id"))
    back = out.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "edge_id")
    if direction == "outgoing":
        return out
    if direction == "incoming":
        return back
    if direction == "both":
        return out.unionByName(back.where("src <> dst"))
    raise ValueError(f"unknown direction {direction!r}")


def one_hop(nodes: DataFrame, edges: DataFrame, how: str = "inner") -> DataFrame:
    """Edges with the columns of both ends as a_* and b_*."""
    a = nodes.select(*[F.col(c).alias(f"a_{c}") for c in nodes.columns])
    b = nodes.select(*[F.col(c).alias(f"b_{c}") for c in nodes.columns])
    return a.join(edges, F.col("a_id") == F.col("source_id"), how).join(b, F.col("target_id") == F.col("b_id"), how)


def bfs(step: DataFrame, starts: DataFrame, max_depth: int) -> DataFrame:
    """(start, node, depth, parent, edge_id): nodes within ``max_depth`` links of each start, at their first depth (G1).

    step: (src, dst, edge_id); starts: (start). Starts themselves are left out. The
    parent is that of the smallest edge id. Cycles end because seen nodes are not entered again.
    """
    step = cut(step)
    front = starts.select(F.col("start"), F.col("start").alias("node")).distinct()
    seen = cut(front.select("start", "node", F.lit(0).alias("depth"), F.lit(None).cast("bigint").alias("parent"), F.lit(None).cast("bigint").alias("edge_id")))
    for depth in range(1, max_depth + 1):
        reached = (
            seen.where(F.col("depth") == depth - 1)
            .select("start", F.col("node").alias("parent"))
            .join(step, F.col("parent") == F.col("src"))
            .groupBy("start", F.col("dst").alias("node"))
            .agg(F.min(F.struct("edge_id", "parent")).alias("m"))
            .join(seen.select("start", "node"), ["start", "node"], "left_anti")
            .select("start", "node", F.lit(depth).alias("depth"), "m.parent", "m.edge_id")
        )
        level = cut(reached)
        if level.isEmpty():
            drop_cut(level)
            break
        seen = seen.unionByName(level)
    return seen.where("depth > 0")


def neighbours(edges: DataFrame, start_ids: list[int], max_depth: int, direction: str = "outgoing", types: list[str] | None = None) -> DataFrame:
    spark = edges.sparkSession
    e = of_type(edges, *types) if types else edges
    return bfs(links(e, direction), spark.createDataFrame([(s,) for s in start_ids], "start bigint"), max_depth)


def shortest_path(edges: DataFrame, source: int, target: int, max_depth: int = 10, direction: str = "outgoing", types: list[str] | None = None) -> list[int]:
    """Node ids of one shortest path, [] if there is none within ``max_depth``; equal ends are a path of one."""
    if source == target:
        return [source]
    tree = cut(neighbours(edges, [source], max_depth, direction, types))
    path, node = [target], target
    while node != source:
        row = tree.where(F.col("node") == node).select("parent").first()
        if row is None:
            return []
        node = row["parent"]
        path.append(node)
    return path[::-1]


def path_lengths(edges: DataFrame, starts: DataFrame, max_depth: int, direction: str = "outgoing") -> DataFrame:
    """(start, node, depth) of all pairs within reach."""
    return bfs(links(edges, direction), starts, max_depth).select("start", "node", "depth")


def dead_code(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Functions and methods nobody calls, entry points excepted."""
    code = nodes.where(F.lower("label").isin("function", "method") & ~F.coalesce(F.col("name").isin(ENTRY_POINTS), F.lit(False)))
    called = of_type(edges, "CALLS", "ASYNC_CALLS").where("target_id is not null").select(F.col("target_id").alias("id"))
    return code.join(called, "id", "left_anti")


def sarif(dead: DataFrame, suppressed: DataFrame | None = None) -> DataFrame:
    """One JSON result per dead symbol, without those on suppressed (file_path, line)."""
    line = F.coalesce(F.get_json_object("properties", "$.line").cast("int"), F.lit(1))
    rows = dead.withColumn("line", line)
    if suppressed is not None:
        rows = rows.join(suppressed.select("file_path", "line"), ["file_path", "line"], "left_anti")
    where = F.struct(F.struct(F.struct(F.coalesce("file_path", F.lit("")).alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation"))
    body = F.struct(F.lit("dead-code").alias("ruleId"), F.lit("warning").alias("level"), F.struct(F.concat(F.lit("no caller of "), F.coalesce("qualified_name", "name", F.lit(""))).alias("text")).alias("message"), F.array(where).alias("locations"))
    return rows.select("id", F.to_json(body).alias("result"))


def chain_without_shortcut(pairs: DataFrame) -> DataFrame:
    """(a, b, c) with links a->b and b->c but none a->c; pairs: (src, dst) (J9). a, b and c differ."""
    p = pairs.where("src <> dst").distinct()
    ab, bc = p.select(F.col("src").alias("a"), F.col("dst").alias("b")), p.select(F.col("src").alias("b"), F.col("dst").alias("c"))
    return ab.join(bc, "b").where("a <> c").join(p.select(F.col("src").alias("a"), F.col("dst").alias("c")), ["a", "c"], "left_anti").select("a", "b", "c")


def mutual(pairs: DataFrame) -> DataFrame:
    """(a, b), a < b, linked both ways."""
    p = pairs.distinct()
    return p.where("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b")).join(p.select(F.col("dst").alias("a"), F.col("src").alias("b")), ["a", "b"], "left_semi")


def hubs(edges: DataFrame, more_than: int, end: str = "target_id") -> DataFrame:
    """Ends of more than so many edges."""
    return edges.where(F.col(end).isNotNull()).groupBy(F.col(end).alias("id")).agg(F.count("*").alias("degree")).where(F.col("degree") > more_than)


def pagerank(pairs: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """(node, rank), the highest 1; parallel links count, nodes without outgoing links give nothing away.

    pairs: (src, dst). Links are partially added before each shuffle, so a node with a tenth of all links is no hot spot.
    """
    links_ = cut(pairs.where("src is not null and dst is not null").groupBy("src", "dst").agg(F.count("*").alias("w")))
    out = links_.groupBy("src").agg(F.sum("w").alias("out"))
    shares = cut(links_.join(out, "src").select("src", "dst", (F.col("w") / F.col("out")).alias("share")))
    nodes = cut(links_.select(F.col("src").alias("node")).union(links_.select("dst")).distinct())
    n = nodes.count()
    if n == 0:
        return nodes.select("node", F.lit(0.0).alias("rank"))
    ranks = cut(nodes.select("node", F.lit(1.0 / n).alias("rank")))
    for _ in range(rounds):
        gained = shares.join(ranks, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("in"))
        new = cut(nodes.join(gained, "node", "left").select("node", (F.lit((1 - damping) / n) + damping * F.coalesce("in", F.lit(0.0))).alias("rank")))
        drop_cut(ranks)
        ranks = new
    top = ranks.agg(F.max("rank")).first()[0]
    return ranks.select("node", (F.col("rank") / F.lit(top)).alias("rank"))


def communities(pairs: DataFrame, rounds: int = 500) -> DataFrame:
    """(node, community) by weighted label propagation, deterministic.

    pairs: (a, b, weight), undirected, each once. A node takes the label of the highest total
    weight among its neighbours, ties to the smallest; labels are node ids. Every round a hash
    lets half of the nodes move, so two neighbours do not swap labels for ever. Stops when no node would move;
    if some still would after ``rounds`` it raises, so an unfinished result never comes out.
    """
    w = pairs.where("a is not null and b is not null and a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("weight").alias("w"))
    both = cut(w.select(F.col("a").alias("node"), F.col("b").alias("other"), "w").union(w.select("b", "a", "w")))
    labels = cut(both.select("node").distinct().select("node", F.col("node").alias("label")))
    for r in range(rounds):
        votes = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node", "label").agg(F.round(F.sum("w"), 9).alias("w"))
        best = votes.groupBy("node").agg(F.min_by("label", F.struct(-F.col("w"), F.col("label"))).alias("best"), F.max("w").alias("top"))
        own = labels.join(votes.withColumnRenamed("w", "held"), ["node", "label"], "left")
        # a label as strong as any other is kept
        moves = F.coalesce(F.col("held"), F.lit(0.0)) < F.col("top")
        active = F.pmod(F.xxhash64("node", F.lit(r)), F.lit(2)) == 0
        step = own.join(best, "node").select("node", moves.alias("moves"), F.when(moves & active, F.col("best")).otherwise(F.col("label")).alias("label"))
        new = cut(step)
        moving = new.where("moves").limit(1).count()
        drop_cut(labels)
        labels = new
        if moving == 0:
            break
    else:
        raise RuntimeError(f"labels still move after {rounds} rounds")
    return labels.select("node", F.col("label").alias("community"))


def community_summary(members: DataFrame, nodes: DataFrame, files: int = 5, symbols: int = 10) -> DataFrame:
    """Size, most frequent files and sample symbols of each community."""
    m = members.join(nodes.select(F.col("id").alias("node"), "name", "file_path"), "node")
    size = m.groupBy("community").agg(F.count("*").alias("size"))
    per_file = m.where("file_path is not null").groupBy("community", "file_path").agg(F.count("*").alias("n"))
    top = per_file.withColumn("r", F.row_number().over(W.partitionBy("community").orderBy(F.desc("n"), "file_path"))).where(F.col("r") <= files)
    top = top.groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "file_path"))), lambda s: s["file_path"]), ",").alias("files"))
    some = m.withColumn("r", F.row_number().over(W.partitionBy("community").orderBy("node"))).where(F.col("r") <= symbols)
    some = some.groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "name"))), lambda s: F.coalesce(s["name"], F.lit(""))), ",").alias("symbols"))
    return size.join(top, "community", "left").join(some, "community", "left")


def call_confidence(name: str | Column, properties: str | Column) -> Column:
    """1.0 for a plain name, 0.8 behind a receiver, 0.5 for a placeholder."""
    n = F.col(name) if isinstance(name, str) else name
    held = F.coalesce(F.get_json_object(properties, "$.placeholder") == "true", F.lit(False))
    return F.when(held, 0.5).when(F.contains(F.coalesce(n, F.lit("")), F.lit(".")), 0.8).otherwise(1.0)


def node_preference(name: str, file_path: str, properties: str, wanted: Column) -> Column:
    """Score by which one of several nodes of a name is chosen."""
    fp = F.replace(F.coalesce(file_path, F.lit("")), F.lit("\\"), F.lit("/"))
    real = ~F.coalesce(F.get_json_object(properties, "$.placeholder") == "true", F.lit(False)) & (fp != "")
    place = F.when(F.contains(fp, F.lit("/src/")), 50).when(F.contains(fp, F.lit("/experiments/")) | F.contains(fp, F.lit("/scripts/")), -50).otherwise(0)
    exact = F.coalesce((F.col(name) == wanted) | F.endswith(F.col(name), F.concat(F.lit("."), wanted)), F.lit(False))
    return F.when(real, 100).otherwise(0) + place + F.when(exact, 20).otherwise(0)


def impact(nodes: DataFrame, edges: DataFrame, starts: DataFrame, max_depth: int = 3) -> DataFrame:
    """Per start: callers and callees by depth, files and modules touched, risk 0..100 and its level."""
    calls = of_type(edges, "CALLS")
    callers = bfs(links(calls, "incoming"), starts, max_depth)
    callees = bfs(links(calls, "outgoing"), starts, max_depth)
    clean = F.replace(F.coalesce("file_path", F.lit("")), F.lit("\\"), F.lit("/"))
    at = nodes.select(F.col("id").alias("node"), clean.alias("file"))
    dirs = F.filter(F.slice(F.reverse(F.split("file", "/")), 2, 100), lambda p: (p != "") & (p != "src") & ~F.contains(p, F.lit(".")) & ~F.contains(p, F.lit(":")))
    up = callers.join(at, "node", "left").withColumn("module", F.try_element_at(dirs, F.lit(1)))
    a = up.groupBy("start").agg(
        F.count_if(F.col("depth") == 1).alias("direct_callers"), F.count_if(F.col("depth") > 1).alias("transitive_callers"),
        F.count_if(F.col("depth") == 2).alias("may_break"), F.count_if(F.col("depth") >= 3).alias("review"),
        F.count_distinct(F.when(F.col("file") != "", F.col("file"))).alias("files"), F.count_distinct(F.when(F.col("file") != "", F.col("module"))).alias("modules"),
    )
    b = callees.groupBy("start").agg(F.count_if(F.col("depth") == 1).alias("direct_callees"), F.count_if(F.col("depth") > 1).alias("transitive_callees"))
    out = starts.select("start").distinct().join(a, "start", "left").join(b, "start", "left").fillna(0)
    risk = F.least(F.lit(30), F.col("direct_callers") * 5) + F.least(F.lit(20), F.col("transitive_callers") * 2) + F.least(F.lit(25), F.col("files") * 3) + F.least(F.lit(15), F.col("modules") * 5) + F.least(F.lit(10), F.col("direct_callees") * 2)
    out = out.withColumn("risk", F.least(F.lit(100), risk).cast("bigint"))
    return out.withColumn("level", F.when(F.col("risk") >= 70, "critical").when(F.col("risk") >= 50, "high").when(F.col("risk") >= 25, "medium").otherwise("low"))


def resolve_calls(calls: DataFrame, nodes: DataFrame, most: int = 5) -> DataFrame:
    """(call_id, target_id, how): callees by exact name, else by last part, else a placeholder.

    calls: (call_id, callee). At most ``most`` candidates per call, the smallest ids. The fallbacks are equi-joins on what is left.
    """
    named = nodes.where("name is not null and id is not null")

    def smallest(name: Column, alias: str) -> DataFrame:
        # a name's smallest ids are found before the join, first under a salt, so a common name is neither a hot group nor a product
        at = named.select(name.alias(alias), F.col("id").alias("target_id"), F.pmod(F.xxhash64("id"), F.lit(32)).alias("salt"))
        for group in ([alias, "salt"], [alias]):
            at = at.withColumn("r", F.row_number().over(W.partitionBy(*group).orderBy("target_id"))).where(F.col("r") <= most)
        return at.select(alias, "target_id")

    by_name = smallest(F.col("name"), "callee")
    exact = calls.join(by_name, "callee").select("call_id", "target_id", F.lit("exact").alias("how"))
    rest = calls.join(by_name.select("callee"), "callee", "left_anti").withColumn("last", F.element_at(F.split("callee", r"\."), -1))
    tails = smallest(F.element_at(F.split("name", r"\."), -1), "last")
    suffix = rest.join(tails, "last").select("call_id", "target_id", F.lit("suffix").alias("how"))
    lost = rest.join(tails.select("last"), "last", "left_anti").select("call_id", F.lit(None).cast("bigint").alias("target_id"), F.lit("placeholder").alias("how"))
    return union_all([exact, suffix, lost])


def flow(edges: DataFrame, starts: DataFrame, max_depth: int = 5) -> DataFrame:
    """Where the value of a variable comes from and goes to, along ASSIGNED_FROM."""
    e = of_type(edges, "ASSIGNED_FROM")
    sources = bfs(links(e, "outgoing"), starts, max_depth).select("start", "node", "depth", F.lit("from").alias("way"))
    return sources.unionByName(bfs(links(e, "incoming"), starts, max_depth).select("start", "node", "depth", F.lit("to").alias("way")))


def references(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """Distinct (symbol, file_path, line, kind) of what refers to a name."""
    targets = nodes.where(F.lower("name") == name.lower()).select(F.col("id").alias("target_id"))
    line = F.get_json_object(F.col("properties"), "$.line").cast("int").alias("line")
    at = edges.join(targets, "target_id").select("source_id", F.lower("type").alias("kind"), line)
    return at.join(nodes.select(F.col("id").alias("source_id"), F.col("name").alias("symbol"), "file_path"), "source_id").select("symbol", "file_path", "line", "kind").distinct()


def symbol_search(nodes: DataFrame, query: str, k: int = 10) -> DataFrame:
    """Names scored 100 exact, 85 all words, 70 prefix, 50 some words, 10 substring."""
    q, words = query.lower(), F.array(*[F.lit(w) for w in query.lower().split("_") if w] or [F.lit("")])
    name = F.lower("name")
    parts = F.filter(F.split(name, "_"), lambda w: w != "")
    common = F.size(F.array_intersect(words, parts))
    score = F.when(name == q, 100).when(common == F.size(words), 85).when(F.startswith(name, F.lit(q)), 70).when(common > 0, 50).otherwise(10)
    return nodes.where(F.contains(name, F.lit(q))).withColumn("score", score).orderBy(F.desc("score"), "name", "id").limit(k)


def verify_claims(claims: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Verdict and confidence on claims (claim_id, subject, predicate, object).

    An object of an edge is meant by its whole name or its last part, a path by its end at a slash or by a folder of it. Predicates calls, imports, defines, implements, inherits are looked up as edges, defined_in as path
    of a node. confirmed 0.9 if found, contradicted 0.85 if the subject has other such links, else unverifiable 0.3.
    """
    kinds = F.create_map(*[F.lit(x) for p in {"calls": "CALLS", "imports": "IMPORTS", "defines": "DEFINES", "implements": "IMPLEMENTS", "inherits": "INHERITS", "handles_error": "HANDLES"}.items() for x in p])
    named = nodes.select(F.col("id").alias("source_id"), F.lower("name").alias("subject_l"), F.lower(F.coalesce("file_path", F.lit(""))).alias("path_l"))
    wanted = F.trim(F.lower(F.coalesce("object", F.lit(""))))
    c = claims.withColumn("subject_l", F.lower("subject")).withColumn("kind", F.try_element_at(kinds, F.col("predicate")))
    ends = edges.select("source_id", "target_id", F.upper("type").alias("kind")).join(nodes.select(F.col("id").alias("target_id"), F.lower("name").alias("object_l")), "target_id").select("source_id", "kind", "object_l")
    by_edge = c.where("kind is not null").join(named, "subject_l").join(ends, ["source_id", "kind"]).groupBy("claim_id").agg(F.bool_or((F.col("object_l") == wanted) | (F.element_at(F.split("object_l", r"\.|::"), -1) == wanted)).alias("hit"))
    by_path = c.where("predicate = 'defined_in'").join(named, "subject_l").groupBy("claim_id").agg(F.bool_or(F.contains(F.concat(F.lit("/"), F.col("path_l"), F.lit("/")), F.concat(F.lit("/"), wanted, F.lit("/")))).alias("hit"))
    found = by_edge.unionByName(by_path)
    verdict = F.when(F.col("hit"), "confirmed").when(~F.col("hit"), "contradicted").otherwise("unverifiable")
    out = claims.join(found, "claim_id", "left").withColumn("verdict", verdict)
    return out.withColumn("confidence", F.when(F.col("verdict") == "confirmed", 0.9).when(F.col("verdict") == "contradicted", 0.85).otherwise(0.3)).select("claim_id", "verdict", "confidence")


def upsert_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """One node per qualified name: the new properties, the old id where there was one."""
    known = old.select("qualified_name", F.col("id").alias("old_id"))
    fresh = new.dropDuplicates(["qualified_name"]).join(known, "qualified_name", "left").withColumn("id", F.coalesce("old_id", "id")).drop("old_id")
    return old.join(new.select("qualified_name"), "qualified_name", "left_anti").unionByName(fresh)


def upsert_edges(old: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """One edge per (source, target, type), the latest id; edges without both ends are left out."""
    ids = nodes.select("id")
    whole = old.unionByName(new).join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    order = W.partitionBy("source_id", "target_id", "type").orderBy(F.desc("id"))
    return whole.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def delete_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes without the gone ids, and edges that touched none of them (S21). gone: (id)."""
    left = nodes.join(gone, "id", "left_anti")
    kept = edges.join(gone.withColumnRenamed("id", "source_id"), "source_id", "left_anti").join(gone.withColumnRenamed("id", "target_id"), "target_id", "left_anti")
    return left, kept


def merged_nodes(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Import that keeps what is there."""
    return ours.unionByName(theirs.join(ours.select("qualified_name"), "qualified_name", "left_anti"))


def renamed(nodes: DataFrame, old: str, new: str) -> DataFrame:
    """A symbol under a new name; ids, hence edges, stay."""
    hit = F.col("name") == old
    end = F.regexp_replace("qualified_name", F.lit(r"(?<=\.|^)" + old.replace(".", r"\.") + r"(?=\.|$)"), F.lit(new))
    return nodes.withColumn("qualified_name", F.when(hit, end).otherwise(F.col("qualified_name"))).withColumn("name", F.when(hit, F.lit(new)).otherwise(F.col("name")))


def moved_file(nodes: DataFrame, old: str, new: str) -> DataFrame:
    return nodes.withColumn("file_path", F.when(F.col("file_path") == old, F.lit(new)).otherwise(F.col("file_path")))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, name, n): nodes per label and edges per type, in any letter case (A4)."""
    return nodes.groupBy(F.lit("node").alias("kind"), F.lower("label").alias("name")).agg(F.count("*").alias("n")).unionByName(
        edges.groupBy(F.lit("edge").alias("kind"), F.lower("type").alias("name")).agg(F.count("*").alias("n"))
    )


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, distinct files (A5)."""
    return nodes.agg(F.count("*").alias("nodes"), F.count_distinct("file_path").alias("files")).crossJoin(F.broadcast(edges.agg(F.count("*").alias("edges"))))


def repo_map(nodes: DataFrame) -> DataFrame:
    """(file_path, symbols, names) with the names in order."""
    return nodes.where("file_path is not null and file_path <> ''").groupBy("file_path").agg(F.count("*").alias("symbols"), F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))


def changed_symbols(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """(file_path, defined, referring_files) of changed files: what they define and who refers to it."""
    own = nodes.join(files.select("file_path").distinct(), "file_path").select(F.col("id").alias("target_id"), "file_path")
    users = nodes.select(F.col("id").alias("source_id"), F.col("file_path").alias("user"))
    refs = own.join(edges, "target_id").join(users, "source_id").where("user <> file_path").groupBy("file_path").agg(F.count_distinct("user").alias("referring_files"))
    return own.groupBy("file_path").agg(F.count("*").alias("defined")).join(refs, "file_path", "left").fillna(0)


def project_edges(imports: DataFrame, symbols: DataFrame, projects: DataFrame) -> DataFrame:
    """(project, needs, imports): distinct imports by the project their first part names.

    imports: (project, file, import); projects: (project). An import belongs to a project by its exact name or that name and a dot.
    """
    first = F.element_at(F.split("import", r"\."), 1)
    at = imports.withColumn("needs", first).join(projects.select(F.col("project").alias("needs")).distinct(), "needs", "left_semi").where("needs <> project")
    return at.groupBy("project", "needs").agg(F.count_distinct("import").alias("imports"))


def shared_symbols(symbols: DataFrame) -> DataFrame:
    """(symbol, projects) of symbols that several projects define."""
    return symbols.distinct().groupBy("symbol").agg(F.array_join(F.array_sort(F.collect_set("project")), ",").alias("projects"), F.count("*").alias("n")).where("n > 1").drop("n")


def on_cycles(pairs: DataFrame) -> DataFrame:
    """(node, component) of all nodes that lie on a cycle of any length (G24): strongly connected components of two nodes or more.

    pairs: (src, dst). Nodes without a link in or without one out are peeled off until none is left; every
    node then passes on its colour, the smallest id that reaches it, and what its colour reaches backwards
    within the colour is one component. Each pass settles at least one component of every colour.
    """
    spark = pairs.sparkSession
    left = cut(pairs.where("src is not null and dst is not null and src <> dst").select("src", "dst").distinct())
    kind = pairs.schema["src"].dataType.simpleString()
    found = []
    while not left.isEmpty():
        while True:
            kept = cut(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
            same = kept.count() == left.count()
            drop_cut(left)
            left = kept
            if same:
                break
        if left.isEmpty():
            break
        colour = cut(left.select(F.col("src").alias("node")).distinct().select("node", F.col("node").alias("c")))
        while True:
            into = left.join(colour, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.min("c").alias("m"))
            new = cut(colour.join(into, "node", "left").select("node", F.least("c", F.coalesce("m", "c")).alias("c"), (F.col("m") < F.col("c")).alias("moved")))
            done = new.where("moved").isEmpty()
            drop_cut(colour)
            colour = new.select("node", "c")
            colour.cut_path = new.cut_path
            if done:
                break
        inside = cut(left.join(colour.select(F.col("node").alias("src"), F.col("c").alias("cs")), "src").join(colour.select(F.col("node").alias("dst"), F.col("c").alias("cd")), "dst").where("cs = cd").select("src", "dst", F.col("cs").alias("c")))
        reach = cut(colour.where("node = c").select("node", "c"))
        front = reach
        while True:
            step = front.join(inside, (F.col("node") == F.col("dst")) & (front["c"] == inside["c"])).select(F.col("src").alias("node"), inside["c"].alias("c")).distinct()
            front = cut(step.join(reach, ["node", "c"], "left_anti"))
            if front.isEmpty():
                break
            reach = cut(reach.unionByName(front))
        sizes = reach.groupBy("c").agg(F.count("*").alias("n")).where("n > 1")
        found.append(cut(reach.join(sizes, "c", "left_semi").select("node", F.col("c").alias("component"))))
        gone = reach.select("node")
        left = cut(left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti"))
    return union_all(found) if found else spark.createDataFrame([], f"node {kind}, component {kind}")


def cycles(pairs: DataFrame, max_length: int = 5) -> DataFrame:
    """Simple cycles up to a length, each once, beginning with its smallest node (G24); :func:`on_cycles` has no such bound.

    Paths grow by equi-joins from their smallest node on, so a path never comes back to a smaller one.
    """
    p = cut(pairs.where("src <> dst").select("src", "dst").distinct())
    paths = cut(p.where("src < dst").select(F.col("src").alias("head"), F.col("dst").alias("tail"), F.array("src", "dst").alias("path")))
    found = []
    for length in range(2, max_length + 1):
        found.append(paths.join(p, (F.col("tail") == F.col("src")) & (F.col("head") == F.col("dst"))).select("path"))
        if length < max_length:
            longer = paths.join(p, F.col("tail") == F.col("src")).where(F.expr("dst > head and not array_contains(path, dst)"))
            paths = cut(longer.select("head", F.col("dst").alias("tail"), F.concat("path", F.array("dst")).alias("path")))
    return union_all(found)


def retract(memory: DataFrame, retracted: list[str]) -> DataFrame:
    """(node_id, depth) of memory nodes that fall with retracted ones.

    memory: (node_id, status, superseded_by, depends_on). A node depends on what it lists, and falls with what superseded it;
    nodes already REFUTED fall no further and pass nothing on. Cycles end by themselves.
    """
    spark = memory.sparkSession
    depends = memory.select(F.explode("depends_on").alias("src_id"), F.col("node_id").alias("dst_id"), "status").unionByName(
        memory.where("superseded_by is not null").select(F.col("superseded_by").alias("src_id"), F.col("node_id").alias("dst_id"), "status")
    )
    step = cut(depends.where("coalesce(status, '') <> 'REFUTED'").select("src_id", "dst_id").distinct())
    seen = cut(spark.createDataFrame([(r, 0) for r in retracted], "node_id string, depth int"))
    depth = 0
    while True:
        depth += 1
        new = seen.where(F.col("depth") == depth - 1).join(step, F.col("node_id") == F.col("src_id")).select(F.col("dst_id").alias("node_id")).distinct().join(seen, "node_id", "left_anti")
        level = cut(new.select("node_id", F.lit(depth).alias("depth")))
        if level.isEmpty():
            return seen.where("depth > 0")
        seen = seen.unionByName(level)
