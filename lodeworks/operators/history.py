"""Change history: commits(hash, author, email, date, message, body, files ARRAY<STRING>)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Words of three different tests for bug fixes; the lists differ on purpose.
BUGFIX_WORDS = ["fix", "bug", "hotfix", "resolve", "patch", "workaround", "correct", "issue", "defect", "crash", "error", "broken"]
RISK_WORDS = ["fix", "bug", "hotfix", "resolve"]
SIMILAR_WORDS = ["fix", "bug", "hotfix", "resolve", "error", "crash", "issue"]
RELATED_WORDS = ["fix", "bug", "hotfix", "resolve", "error", "crash"]
SIGNIFICANT_WORDS = ["fix", "bug", "hotfix", "security", "vulnerab", "refactor", "migrat", "perf", "race", "deadlock", "crash", "regress", "reindex"]
DECISION_PATTERNS = [
    r"^feat\(.*\):", r"^refactor\(.*\):", r"^arch\(.*\):", r"^feat:", r"^refactor:", r"^arch:", r"^adr:", r"decision", r"replace", r"migrate", r"restructure",
    r"rewrite", r"redesign", r"extract", r"merge.*module", r"split.*module", r"change.*api", r"change.*interface",
]
#: Words an error message is not searched by.
KEYWORD_STOP = frozenset(
    "the a an is are was were be been have has had do does did will would could should may might can cannot in on at to for of with by from and or but not no if then else this that it its my your our".split()
)


def _any(message: str | Column, words: list[str], bounded: bool = False) -> Column:
    c = F.col(message) if isinstance(message, str) else message
    body = "|".join(words)
    return F.coalesce(c.rlike(rf"(?i)\b({body})\b" if bounded else rf"(?i)({body})"), F.lit(False))


def is_bugfix(message: str | Column) -> Column:
    """Whole words."""
    return _any(message, BUGFIX_WORDS, bounded=True)


def is_decision(message: str | Column, body: str | Column) -> Column:
    """Commits that record a decision."""
    whole = F.concat_ws(" ", message, body)
    return F.coalesce(whole.rlike("(?i)" + "|".join(f"(?:{p})" for p in DECISION_PATTERNS)), F.lit(False))


def decision_kind(message: str | Column) -> Column:
    m = F.lower(F.col(message) if isinstance(message, str) else message)
    return F.when(m.rlike("^feat"), "feature").when(m.rlike("^refactor"), "refactor").when(m.rlike("^(arch|adr)"), "architecture").otherwise("other")


def commit_files(commits: DataFrame, *keep: str) -> DataFrame:
    """(hash, ..., file): each file of a commit once."""
    return commits.select("hash", *keep, F.explode(F.array_distinct("files")).alias("file"))


def file_pairs(commits: DataFrame, most_files: int | None = None) -> DataFrame:
    """(hash, file_a, file_b), file_a < file_b, of each commit.

    Pairs are built inside the row, so no shuffle meets the unaggregated pairs. ``most_files`` leaves
    out commits that touch more files; by default none are.
    """
    c = commits if most_files is None else commits.where(F.size("files") <= most_files)
    files = F.sort_array(F.array_distinct("files"))
    at = c.select("hash", files.alias("f")).select("hash", "f", F.posexplode("f").alias("i", "file_a"))
    return at.select("hash", "file_a", F.explode(F.slice("f", F.col("i") + 2, F.greatest(F.size("f") - F.col("i") - 1, F.lit(0)))).alias("file_b"))


def cochange(commits: DataFrame, min_count: int = 3, min_coupling: float = 0.3) -> DataFrame:
    """(file_a, file_b, n, coupling): pairs changed together, n over the larger change count."""
    n = file_pairs(commits).groupBy("file_a", "file_b").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)
    per = commit_files(commits).groupBy("file").agg(F.count("*").alias("c"))
    both = n.join(per.select(F.col("file").alias("file_a"), F.col("c").alias("ca")), "file_a").join(per.select(F.col("file").alias("file_b"), F.col("c").alias("cb")), "file_b")
    out = both.withColumn("coupling", F.round(F.col("n") / F.greatest("ca", "cb"), 3)).where(F.col("coupling") >= min_coupling)
    return out.select("file_a", "file_b", "n", "coupling")


def pair_frequency(commits: DataFrame, min_frequency: int = 2) -> DataFrame:
    """(file_a, file_b, n)."""
    return file_pairs(commits).groupBy("file_a", "file_b").agg(F.count("*").alias("n")).where(F.col("n") >= min_frequency)


def file_risk(commits: DataFrame) -> DataFrame:
    """(file, total, bugfixes, ratio, risk, last_change)."""
    at = commit_files(commits, "message", "date").groupBy("file").agg(F.count("*").alias("total"), F.count_if(_any("message", RISK_WORDS)).alias("bugfixes"), F.max("date").alias("last_change"))
    at = at.withColumn("ratio", F.round(F.col("bugfixes") / F.col("total"), 3))
    return at.withColumn("risk", F.when((F.col("ratio") > 0.5) & (F.col("total") >= 5), "high").when(F.col("ratio") > 0.3, "medium").otherwise("low"))


def file_stability(commits: DataFrame) -> DataFrame:
    """(file, changes, first, last, stable): fewer than five changes count as stable."""
    at = commit_files(commits, "date").groupBy("file").agg(F.count("*").alias("changes"), F.min("date").alias("first"), F.max("date").alias("last"))
    return at.withColumn("stable", F.col("changes") < 5)


def authors(commits: DataFrame) -> DataFrame:
    """(author, commits)."""
    return commits.groupBy("author").agg(F.count("*").alias("commits"))


def bug_totals(commits: DataFrame) -> DataFrame:
    """One row: commits, bugfixes, ratio."""
    out = commits.agg(F.count("*").alias("commits"), F.count_if(is_bugfix("message")).alias("bugfixes"))
    return out.withColumn("ratio", F.round(F.coalesce(F.try_divide("bugfixes", "commits"), F.lit(0.0)), 3))


def buggy_files(commits: DataFrame) -> DataFrame:
    """(file, commits, bugfixes, ratio, risk): risk by the number of fixes, 3 and 1."""
    at = commit_files(commits, "message").groupBy("file").agg(F.count("*").alias("commits"), F.count_if(is_bugfix("message")).alias("bugfixes")).where("bugfixes > 0")
    at = at.withColumn("ratio", F.round(F.col("bugfixes") / F.col("commits"), 3))
    return at.withColumn("risk", F.when(F.col("bugfixes") >= 3, "high").otherwise("medium"))


def bug_hotspots(commits: DataFrame, as_of: str) -> DataFrame:
    """(file, bugs, last_bugfix, score, risk): 2 x bugs + 3 within 30 days of ``as_of``, + 1 within 90."""
    at = commit_files(commits.where(is_bugfix("message")), "date").groupBy("file").agg(F.count("*").alias("bugs"), F.max(F.to_date("date")).alias("last_bugfix"))
    age = F.datediff(F.lit(as_of).cast("date"), F.col("last_bugfix"))
    at = at.withColumn("score", F.col("bugs") * 2 + F.when(age < 30, 3).when(age < 90, 1).otherwise(0))
    return at.withColumn("risk", F.when(F.col("score") >= 10, "critical").when(F.col("score") >= 5, "high").otherwise("medium"))


def bug_pairs(commits: DataFrame, messages: int = 5) -> DataFrame:
    """(file_a, file_b, n, messages): pairs in bug fixes and the first messages by commit."""
    fixes = commits.where(_any("message", RELATED_WORDS))
    pairs = file_pairs(fixes).select("file_a", "file_b", "hash")
    counts = pairs.groupBy("file_a", "file_b").agg(F.count("*").alias("n"))
    # rank limits are pushed below the shuffle, so a task sends at most ``messages`` commits of a pair; messages join those alone
    first = pairs.withColumn("r", F.row_number().over(W.partitionBy("file_a", "file_b").orderBy("hash"))).where(F.col("r") <= messages)
    told = first.join(fixes.select("hash", "message"), "hash").groupBy("file_a", "file_b").agg(F.array_sort(F.collect_list(F.struct("r", "message"))).alias("m"))
    return counts.join(told, ["file_a", "file_b"]).select("file_a", "file_b", "n", F.array_join(F.transform("m", lambda s: s["message"]), " | ").alias("messages"))


#: Weights of the relations between files.
RELATION_WEIGHTS = {"cochange": 1.0, "bug_correlation": 2.0, "call_graph": 3.0}


def knowledge_graph(relations: DataFrame) -> DataFrame:
    """(src, dst, weight), both ways: relations (file_a, file_b, kind, weight) added up by the weight of their kind."""
    by_kind = F.create_map(*[F.lit(x) for p in RELATION_WEIGHTS.items() for x in p])
    w = F.col("weight") * F.coalesce(F.try_element_at(by_kind, F.col("kind")), F.lit(1.0))
    one = relations.where("file_a <> file_b").groupBy(F.least("file_a", "file_b").alias("a"), F.greatest("file_a", "file_b").alias("b")).agg(F.sum(w).alias("weight"))
    return one.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight").union(one.select("b", "a", "weight"))


def related_files(graph: DataFrame) -> DataFrame:
    """(src, dst, depth, weight): neighbours, and neighbours of neighbours by the best of sqrt(w1 w2)."""
    direct = graph.select("src", "dst", F.lit(1).alias("depth"), F.round("weight", 6).alias("weight"))
    a, b = graph.select("src", F.col("dst").alias("m"), F.col("weight").alias("w1")), graph.select(F.col("src").alias("m"), "dst", F.col("weight").alias("w2"))
    two = a.join(b, "m").where("src <> dst").groupBy("src", "dst").agg(F.round(F.max(F.sqrt(F.col("w1") * F.col("w2"))), 6).alias("weight"))
    return direct.unionByName(two.join(graph.select("src", "dst"), ["src", "dst"], "left_anti").select("src", "dst", F.lit(2).alias("depth"), "weight"))


def significance(commits: DataFrame, gate: float = 0.4) -> DataFrame:
    """(hash, score) of commits at or above the gate: size, words, hot files, a body."""
    hot = file_risk(commits).where("total >= 3").select("file")
    touches = commit_files(commits).join(hot, "file", "left_semi").select("hash").distinct().withColumn("hot", F.lit(0.2))
    size = F.size(F.array_distinct(F.coalesce("files", F.array().cast("array<string>"))))
    word = _any(F.concat_ws(" ", "message", "body"), SIGNIFICANT_WORDS)
    score = F.when(size >= 5, 0.35).when(size >= 3, 0.25).when(size >= 1, 0.1).otherwise(0.0) + F.when(word, 0.3).otherwise(0.0) + F.when(F.coalesce("body", F.lit("")) != "", 0.1).otherwise(0.0)
    out = commits.select("hash", score.alias("s")).join(touches, "hash", "left")
    return out.select("hash", F.round(F.least(F.lit(1.0), F.col("s") + F.coalesce("hot", F.lit(0.0))), 2).alias("score")).where(F.col("score") >= gate)


def keywords(text: str | Column) -> Column:
    """Up to ten words of an error message that are no stop words."""
    c = F.col(text) if isinstance(text, str) else text
    stop = F.array(*[F.lit(w) for w in sorted(KEYWORD_STOP)])
    words = F.transform(F.split(F.lower(c), r"\s+"), lambda w: F.regexp_replace(w, r"^[.,;:()\[\]{}]+|[.,;:()\[\]{}]+$", ""))
    return F.slice(F.filter(words, lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w)), 1, 10)


def similar_bugs(commits: DataFrame, errors: DataFrame, k: int = 5) -> DataFrame:
    """(error_id, hash, score, rank): bug fixes whose message holds most of an error's keywords.

    errors: (error_id, text), at most 1000, checked and broadcast.
    """
    if errors.limit(1001).count() > 1000:
        raise ValueError("at most 1000 error messages at a time")
    e = F.broadcast(errors.select("error_id", keywords("text").alias("words")))
    fixes = commits.where(_any("message", SIMILAR_WORDS)).select("hash", F.lower("message").alias("m"))
    scored = fixes.crossJoin(e).withColumn("score", F.size(F.filter("words", lambda w: F.contains(F.col("m"), w)))).where("score > 0")
    order = W.partitionBy("error_id").orderBy(F.desc("score"), "hash")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("error_id", "hash", "score", "rank")


def search_commits(commits: DataFrame, message: str | None = None, file: str | None = None, hash_prefix: str | None = None) -> DataFrame:
    """Commits by message, touched file or hash prefix."""
    out = commits
    if message is not None:
        out = out.where(F.contains(F.lower("message"), F.lit(message.lower())))
    if file is not None:
        out = out.where(F.exists("files", lambda f: (f == file) | F.endswith(f, F.lit("/" + file))))
    if hash_prefix is not None:
        out = out.where(F.startswith("hash", F.lit(hash_prefix)))
    return out


def decisions(commits: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(hash, kind, message) of recorded decisions that are not known yet (Z20). known: (hash)."""
    out = commits.where(is_decision("message", "body")).select("hash", decision_kind("message").alias("kind"), "message")
    return out if known is None else out.join(known.select("hash").distinct(), "hash", "left_anti")
