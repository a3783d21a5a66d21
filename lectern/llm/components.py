"""Problem 3: splits that keep related records together.

Records hang on keys (a paper, a constraint pair); keys are tied by edges (a
paper and its authors, a pair and its paper).  The connected components of the
key graph are a table of (node, root) that is kept in a :class:`Store`, one
numbered version a run, beside the splits of the components.  New edges are first
lifted to the roots that the latest version has, so a later batch only touches
what it merges.  Merges are found by hooking every node to its smallest
neighbour and jumping pointers; the graph contracts each round until no edge is
left.  Splits live on components: an existing component keeps its split, a new
one fills the largest deficit, and components that a batch merges although they
had different splits are quarantined.

Nodes are 64-bit hashes of their keys; :func:`node_table` fails on a collision.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.words import folded_words
from lectern.session import cut, drop_cut, new_path

#: Entries of author lists that name no person, as folded words.
NO_PERSON = (
    "", "anonymous", "author", "authors", "author unknown", "click here", "click to view", "download", "download pdf",
    "et al", "n a", "na", "none", "null", "read more", "source", "tba", "tbd", "unknown", "unknown author", "various",
    "various authors", "view", "view article", "view paper",
)
NO_PERSON_STARTS = ("click to ", "download ")


def person_key(name) -> F.Column:
    """Folded words of an author entry, null where it names no person."""
    key = folded_words(name)
    bad = key.isin(*NO_PERSON)
    for start in NO_PERSON_STARTS:
        bad = bad | key.startswith(start)
    return F.when(~bad, key)


def node(kind: str, key) -> F.Column:
    return F.xxhash64(F.lit(kind), key)


class Store:
    """Versions of tables in a folder that all executors share.

    A version is a folder ``v0000007`` that holds its tables; it counts once the
    file ``COMPLETE`` stands in it, which is made last, so a run that dies
    leaves the version before as the latest.  Versions are never rewritten.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path
        self._path = lambda *parts: path("/".join([self.folder, *parts]))
        self._files = self._path().getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        if not self._files.exists(self._path()):
            return []
        names = [str(x.getPath().getName()) for x in self._files.listStatus(self._path())]
        return sorted(int(n[1:]) for n in names if re.fullmatch(r"v\d{7}", n) and self._files.exists(self._path(n, "COMPLETE")))

    def save(self, **tables: DataFrame | None) -> int:
        """Write the tables as a new version; its number.  Null is an absent table."""
        number = max(self.versions(), default=0) + 1
        for name, df in tables.items():
            if df is not None:
                df.write.mode("overwrite").parquet(f"{self.folder}/v{number:07d}/{name}")
        self._files.mkdirs(self._path(f"v{number:07d}"))
        self._files.create(self._path(f"v{number:07d}", "COMPLETE")).close()
        return number

    def load(self, name: str, version: int | None = None) -> DataFrame | None:
        """The table of a version, by default of the latest; null if there is none."""
        version = max(self.versions(), default=0) if version is None else version
        if version and version not in self.versions():
            raise ValueError(f"no version {version} in {self.folder}")
        if not version or not self._files.exists(self._path(f"v{version:07d}", name)):
            return None
        return self.spark.read.parquet(f"{self.folder}/v{version:07d}/{name}")


def contract(edges: DataFrame, jumps: int = 1) -> DataFrame | None:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest
    node of its component.  Null and loop edges tie nothing; repeats are free.

    Each round hooks every node to its first neighbour in the order of a hash, jumps ``jumps`` pointers, and keeps only edges between different
    ancestors.  The order by hash keeps pointers short, whatever the numbers of
    the nodes, so that a round leaves a fraction of the nodes even of a long
    path.  The two small tables of a round are written, and what the round
    before wrote is removed.
    """
    left = cut(edges.where("a is not null and b is not null and a <> b").select("a", "b"), "edges")
    parents = []
    drawn = lambda x: F.struct(F.xxhash64(x).alias("h"), F.col(x).alias("x"))
    while not left.isEmpty():
        both = left.select("a", "b").union(left.select("b", "a"))
        up = both.groupBy(F.col("a").alias("node")).agg(F.min(drawn("b")).alias("m")).select("node", F.least(drawn("node"), "m")["x"].alias("root"))
        parent = up
        for _ in range(jumps):
            parent = follow(parent, up)
        parents.append(cut(parent, "parents"))
        old, left = left, cut(relabel(left, parents[-1]).where("a <> b").select("a", "b"), "edges")
        drop_cut(old)
        if len(parents) == 8:
            parents = [_chain(parents)]
    drop_cut(left)
    if not parents:
        return None
    total = _chain(parents)
    least = total.groupBy("root").agg(F.min("node").alias("least"))
    out = cut(total.join(least, "root").select("node", F.col("least").alias("root")), "roots")
    drop_cut(total)
    return out


def _chain(parents: list[DataFrame]) -> DataFrame:
    """The tables of rounds, first to last, as one."""
    if len(parents) == 1:
        return parents[0]
    total = parents[0]
    for newer in parents[1:]:
        total = follow(total, newer)
    total = cut(total, "roots")
    drop_cut(*parents)
    return total


def relabel(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Edges between the roots of their ends; unknown ends stay themselves."""
    for end in ("a", "b"):
        to = roots.select(F.col("node").alias(end), F.col("root").alias("__r"))
        edges = edges.join(to, end, "left").withColumn(end, F.coalesce("__r", end)).drop("__r")
    return edges


def follow(older: DataFrame, newer: DataFrame) -> DataFrame:
    """The table ``older`` brought up to date: its roots replaced by theirs in
    ``newer``, and the nodes that only ``newer`` has."""
    to = newer.select(F.col("node").alias("__n"), F.col("root").alias("__r"))
    return older.join(to, F.col("root") == F.col("__n"), "left").select("node", F.coalesce("__r", "root").alias("root"))


def update_components(known: DataFrame | None, edges: DataFrame) -> DataFrame | None:
    """The component table after ``edges`` (a, b); ``known`` is the table before.

    Returns (node, root) with every node of either; null if there is none.
    """
    if known is None:
        return contract(edges)
    edges = cut(edges.where("a is not null and b is not null"), "new-edges")
    merges = contract(relabel(edges, known))
    ends = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    fresh = ends.join(known, "node", "left_anti").select("node", F.col("node").alias("root"))
    every = known.select("node", "root").unionByName(fresh)
    out = cut(every if merges is None else follow(every, merges), "components")
    drop_cut(edges, *([] if merges is None else [merges]))
    return out


def assign_splits(sizes: DataFrame, targets: DataFrame, prior: DataFrame | None = None, buckets: int = 1024) -> DataFrame:
    """(root, split, status) for components ``sizes`` (root, records).

    ``targets`` is (split_name, target_share); ``prior`` is (root, split) of
    what had a split before, one row for each old component by its present
    root.  status: ``kept``, ``new``, or ``quarantined`` with a null split
    where the parts of a merged component had different splits.

    New components fill the deficits against the target shares of all records
    not quarantined.  Those larger than a 1/``buckets`` part of the records, of
    which there are at most ``buckets``, are placed one by one, largest first,
    where the deficit is largest; the rest is laid end to end in hash order and
    cut at the remaining deficits, by bucket totals, so that no group and no
    sort of all components is needed.  Null or negative shares count as none.
    """
    spark = sizes.sparkSession
    sizes = sizes.groupBy("root").agg(F.sum("records").cast("long").alias("records"))
    wanted = {r[0]: max(0.0, r[1] or 0.0) for r in targets.select("split_name", "target_share").collect() if r[0] is not None}
    scale = sum(wanted.values()) or 1.0
    if prior is None:
        old = sizes.select("root").limit(0).withColumns({"split": F.lit("").cast("string"), "kinds": F.lit(0).cast("long")})
    else:
        old = prior.groupBy("root").agg(F.min("split").alias("split"), F.countDistinct("split").alias("kinds"))
    state = cut(
        sizes.join(old, "root", "left").select(
            "root", "records", F.when(F.col("kinds") == 1, F.col("split")).alias("split"),
            F.when(F.col("kinds") > 1, "quarantined").when(F.col("kinds") == 1, "kept").otherwise("new").alias("status"),
        ),
        "components-state",
    )
    have = {(r[0], r[1]): r[2] for r in state.groupBy("status", "split").agg(F.sum("records")).collect()}
    total = sum(v for (s, _), v in have.items() if s != "quarantined")
    deficit = {s: wanted[s] / scale * total - have.get(("kept", s), 0) for s in wanted}
    new = state.where("status = 'new'")
    large_from = max(1, -(-total // buckets))
    placed = []
    if deficit:
        for root, records in sorted(((r[0], r[1]) for r in new.where(F.col("records") > large_from).select("root", "records").collect()), key=lambda x: (-x[1], x[0])):
            to = max(deficit, key=lambda s: (deficit[s], s))
            deficit[to] -= records
            placed.append((root, to))
    big = spark.createDataFrame(placed, "root long, big_split string")
    open_ = {s: max(0.0, d) for s, d in sorted(deficit.items())}
    room = sum(open_.values())
    small = new.where(F.col("records") <= large_from).withColumn("bucket", F.pmod(F.xxhash64("root"), F.lit(buckets)))
    per = small.groupBy("bucket").agg(F.sum("records").alias("n"))
    before = per.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("all"))
    place = F.col("before") + F.sum("records").over(Window.partitionBy("bucket").orderBy(F.xxhash64("root", F.lit(1)), "root")) - F.col("records") / 2
    share = place / F.col("all")
    names, edges_, upto = list(open_), [], 0.0
    for name in names:
        upto += open_[name] / room if room else 1 / len(names)
        edges_.append(upto)
    choice = F.lit(names[-1]) if names else F.lit(None).cast("string")
    for name, upto in reversed(list(zip(names[:-1], edges_[:-1]))):
        choice = F.when(share < upto, F.lit(name)).otherwise(choice)
    spread = small.join(F.broadcast(before), "bucket").select("root", choice.alias("small_split"))
    return (
        state.join(F.broadcast(big), "root", "left").join(spread, "root", "left")
        .select("root", "records", F.coalesce("split", "big_split", "small_split").alias("split"), "status")
    )


# --- the project's records -------------------------------------------------


def _clean(column: str) -> F.Column:
    c = F.lower(F.regexp_replace(column, r"^[\s ]+|[\s ]+$", ""))
    return F.when(c != "", c)


def record_keys(questions: DataFrame, profiles: DataFrame) -> DataFrame:
    """(src_table, record_id, paper, pair): one row a record, repeats once.

    Rows without an id are left out: there is no record to place.
    """
    q = questions.select(F.lit("qa_selective_response_v2").alias("src_table"), F.col("case_id").alias("record_id"), F.coalesce(_clean("cluster_id"), _clean("gold_locator.paper_id"), _clean("negative_evidence.paper_id")).alias("paper"), F.lit(None).cast("string").alias("pair"))
    p = profiles.select(F.lit("finder_proxy_profiles_v2").alias("src_table"), F.col("profile_id").alias("record_id"), _clean("gold_paper_id").alias("paper"), _clean("constraint_pair").alias("pair"))
    return q.unionByName(p).where("record_id is not null").dropDuplicates(["src_table", "record_id"])


def key_edges(records: DataFrame, papers: DataFrame) -> DataFrame:
    """Edges (a, b) from papers to the constraint pairs and authors that tie them."""
    pairs = records.where("pair is not null and paper is not null").select(node("paper", F.col("paper")).alias("a"), node("pair", F.col("pair")).alias("b"))
    named = papers.select(_clean("paper_id").alias("paper"), F.explode(F.array_distinct("authors")).alias("name")).where("paper is not null and name is not null").distinct()
    authors = named.withColumn("person", person_key(F.col("name"))).where("person is not null").select(node("paper", F.col("paper")).alias("a"), node("author", F.col("person")).alias("b"))
    return pairs.unionByName(authors)


def record_groups(records: DataFrame, papers: DataFrame, components: DataFrame | None) -> DataFrame:
    """(src_table, record_id, root, group_key): group_key is the smallest paper
    of the group, null where the group has none.  Two papers of one hash fail."""
    paper, pair = F.col("paper"), F.col("pair")
    # a record hangs on its paper, else on its pair
    hangs = F.when(paper.isNotNull(), node("paper", paper)).when(pair.isNotNull(), node("pair", pair))
    by = records.withColumn("node", hangs)
    listed = papers.select(_clean("paper_id").alias("paper")).where("paper is not null").select(node("paper", paper).alias("node"), "paper")
    least, most = F.min("paper"), F.max("paper")
    keys = by.select("node", "paper").where("node is not null").unionByName(listed).groupBy("node").agg(F.when(least == most, least).when(least.isNotNull(), F.raise_error(F.lit("two papers share a hash")).cast("string")).alias("key"))
    rooted = keys.withColumn("root", F.col("node")) if components is None else keys.join(components, "node", "left").select("node", "key", F.coalesce("root", "node").alias("root"))
    group = rooted.groupBy("root").agg(F.min("key").alias("group_key"))
    of = rooted.select("node", "root").join(group, "root")
    return by.join(of, "node", "left").select("src_table", "record_id", "root", "group_key")


def records_with_groups(questions: DataFrame, profiles: DataFrame, papers: DataFrame, known: DataFrame | None = None):
    """The records with their groups, and the component table behind them;
    ``known`` is the component table of an earlier run."""
    records = cut(record_keys(questions, profiles), "records")
    papers = papers.select("paper_id", "authors")
    components = update_components(known, key_edges(records, papers))
    return record_groups(records, papers, components), components


def update_groups(store: Store, questions: DataFrame, profiles: DataFrame, papers: DataFrame) -> DataFrame:
    """The records with their groups after a run over the latest components of
    ``store``, which are saved as its next version."""
    records = cut(record_keys(questions, profiles), "records")
    components = update_components(store.load("components"), key_edges(records, papers.select("paper_id", "authors")))
    number = store.save(components=components)
    if components is not None:
        drop_cut(components)
    return record_groups(records, papers.select("paper_id"), store.load("components", number))


def _alone(groups: DataFrame) -> DataFrame:
    """A record that hangs on nothing is a component of its own."""
    return groups.withColumn("root", F.coalesce("root", F.xxhash64(F.lit("record"), "src_table", "record_id")))


def update_splits(store: Store, questions: DataFrame, profiles: DataFrame, papers: DataFrame, targets: DataFrame) -> DataFrame:
    """(src_table, record_id, split, status) after a run over what ``store`` has:
    components that had a split keep it, new ones fill the deficits, and those
    that the run merged from different splits are quarantined.

    The run becomes the next version of ``store``, with the splits of its
    components.  Records that hang on nothing are components of their own.
    """
    before = store.load("splits")
    groups, components = records_with_groups(questions, profiles, papers, store.load("components"))
    groups = cut(_alone(groups), "groups")
    prior = None
    if before is not None:
        prior = before.where("split is not null").select("root", "split")
        if components is not None:
            prior = prior.join(components.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select(F.coalesce("to", "root").alias("root"), "split")
    final = assign_splits(groups.groupBy("root").agg(F.count("*").alias("records")), targets, prior)
    number = store.save(components=components, splits=final)
    return groups.join(store.load("splits", number), "root").select("src_table", "record_id", "split", "status")


def splits(questions: DataFrame, profiles: DataFrame, papers: DataFrame, targets: DataFrame) -> DataFrame:
    """(src_table, record_id, split, status) of all records, placed anew: a
    first run over an empty store."""
    store = Store(questions.sparkSession, new_path(questions.sparkSession, "split-store"))
    return update_splits(store, questions, profiles, papers, targets)


def incremental_splits(questions: DataFrame, profiles: DataFrame, papers: DataFrame, targets: DataFrame, until: str, folder: str | None = None) -> DataFrame:
    """Splits of all records in two runs: first what was created before
    ``until``, then the rest on top of what the first run left in the store."""
    spark = questions.sparkSession
    folder = folder or new_path(spark, "split-store")
    early = lambda t: t.where(F.col("created_at") < F.lit(until).cast("timestamp_ntz"))
    update_splits(Store(spark, folder), early(questions), early(profiles), early(papers), targets)
    return update_splits(Store(spark, folder), questions, profiles, papers, targets)
