"""Parent-child rows to full hierarchies (problem 6).

Deterministic splitters are chosen by hash (every root is one too). Each node walks
to the next splitter above it; the pointer graph that remains between splitters is
an eighth of the size and is solved the same way; exact paths are the concatenation
of both walks. Walks double their stride each round, so a tree of depth *d* needs
about log2(d) joins. A round that settles nobody proves that nobody left can be
settled (a node at distance L has nodes at every distance below L above it): what is
left then leads into a cycle, one without any splitter in the first walk, one through
splitters in the second.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.durable import materialise
from threadloom.functions.codes import dense_index

SPLIT_EVERY = 8


def normal_id(c: Column) -> Column:
    """Ids compare without case and padding; blank counts as null."""
    v = F.upper(F.trim(c))
    return F.when(v != "", v)


def parent_pointers(sessions: DataFrame, id_col: str = "id", parent_col: str = "parent_session_id") -> DataFrame:
    """(id, parent, has_link): one row per distinct id.

    Repeated rows fold into one; if copies of an id disagree, the largest parent is
    taken. Rows with a null or blank id are no nodes. ``parent`` is null where the
    named parent has no row of its own; ``has_link`` tells that one was named.
    """
    nodes = (
        sessions.select(normal_id(F.col(id_col)).alias("id"), normal_id(F.col(parent_col)).alias("named"))
        .where("id is not null")
        .groupBy("id")
        .agg(F.max("named").alias("named"))
    )
    known = nodes.select(F.col("id").alias("parent"))
    return nodes.join(known, nodes["named"] == known["parent"], "left").select("id", "parent", F.col("named").isNotNull().alias("has_link"))


def _chase(edges: DataFrame, tag: str) -> tuple[DataFrame, DataFrame]:
    """Follow (id, at, steps, seg, done) to the first done place; (settled, endless)."""
    state = materialise(edges, tag)
    settled, left = [state.where("done")], state.where("not done")
    n_left = left.count()
    while n_left:
        whole = settled[0]
        for s in settled[1:]:
            whole = whole.unionByName(s)
        hop = whole.unionByName(left).select(
            F.col("id").alias("h_id"), F.col("at").alias("h_at"), F.col("steps").alias("h_steps"), F.col("seg").alias("h_seg"), F.col("done").alias("h_done")
        )
        moved = materialise(
            left.join(hop, left["at"] == hop["h_id"]).select(
                "id", F.col("h_at").alias("at"), (F.col("steps") + F.col("h_steps")).alias("steps"), F.concat("seg", "h_seg").alias("seg"), F.col("h_done").alias("done")
            ),
            tag,
        )
        now = moved.where("not done").count()
        if now == n_left:
            break
        settled.append(moved.where("done"))
        left, n_left = moved.where("not done"), now
    whole = settled[0]
    for s in settled[1:]:
        whole = whole.unionByName(s)
    return whole, left


def resolve(nodes: DataFrame, with_path: bool = False) -> DataFrame:
    """(id, has_link, root_id, depth[, path]) for each row of :func:`parent_pointers`.

    ``root_id`` is the last node reached and ``depth`` the number of links followed;
    a node on a cycle or leading into one has root_id '' and depth -1 (and a null
    path). ``path`` runs from the root to the node itself.
    """
    nodes = materialise(nodes.withColumn("splitter", F.col("parent").isNull() | (F.pmod(F.xxhash64("id"), F.lit(SPLIT_EVERY)) == 0)), "nodes")
    above = nodes.select(F.col("id").alias("at"), F.col("splitter").alias("done"), F.col("parent").isNull().alias("at_root"))
    keep = F.array("at") if with_path else F.array().cast("array<string>")
    first = nodes.where("parent is not null").select("id", F.col("parent").alias("at"))
    walk, _ = _chase(first.join(above, "at").select("id", "at", F.lit(1).alias("steps"), keep.alias("seg"), "done"), "walk")

    roots = nodes.where("parent is null").select(F.col("id").alias("at"), F.lit(True).alias("is_root"))
    marked = materialise(walk.join(roots, "at", "left").select("id", "at", "steps", "seg", F.coalesce("is_root", F.lit(False)).alias("done")), "marked")
    splitters = nodes.where("splitter and parent is not null").select("id")
    solved, _ = _chase(marked.join(splitters, "id", "left_semi"), "reduced")
    tail = solved.select(F.col("id").alias("s_id"), F.col("at").alias("s_root"), F.col("steps").alias("s_steps"), F.col("seg").alias("s_seg"))

    direct = marked.where("done").select("id", F.col("at").alias("root_id"), F.col("steps").alias("depth"), "seg")
    via = marked.where("not done")
    via = via.join(tail, via["at"] == tail["s_id"]).select(
        "id", F.col("s_root").alias("root_id"), (F.col("steps") + F.col("s_steps")).alias("depth"), F.concat("seg", "s_seg").alias("seg")
    )
    own = nodes.where("parent is null").select("id", F.col("id").alias("root_id"), F.lit(0).alias("depth"), F.array().cast("array<string>").alias("seg"))
    got = direct.unionByName(via).unionByName(own).withColumnRenamed("id", "g_id")
    out = nodes.join(got, nodes["id"] == got["g_id"], "left").select(
        "id",
        "has_link",
        F.coalesce("root_id", F.lit("")).alias("root_id"),
        F.coalesce("depth", F.lit(-1)).alias("depth"),
        F.when(F.col("seg").isNotNull(), F.reverse(F.concat(F.array("id"), "seg"))).alias("path"),
    )
    return out if with_path else out.drop("path")


def descendants(paths: DataFrame) -> DataFrame:
    """(ancestor_id, descendant_id, distance) from the paths of :func:`resolve`.

    Every node stands below each node of its own path; cyclic nodes have no path and
    give no rows. The result is as long as the sum of all depths.
    """
    p = paths.where("path is not null").select(F.col("id").alias("descendant_id"), "depth", F.posexplode("path").alias("place", "ancestor_id"))
    return p.where("place < depth").select("ancestor_id", "descendant_id", (F.col("depth") - F.col("place")).alias("distance"))


def hierarchy(sessions: DataFrame) -> DataFrame:
    """Per session its path, depth, root and number of descendants."""
    paths = materialise(resolve(parent_pointers(sessions), with_path=True), "paths")
    below = descendants(paths).groupBy(F.col("ancestor_id").alias("id")).agg(F.count("*").alias("n_descendants"))
    return paths.join(below, "id", "left").select(
        F.col("id").alias("session_id"), "root_id", "depth", F.array_join("path", "/").alias("path"), F.coalesce("n_descendants", F.lit(0)).cast("long").alias("n_descendants")
    )


def intervals(sessions: DataFrame) -> DataFrame:
    """(session_id, root_id, first, last): places in the order of the paths, so all descendants of a node follow it, up to *last*.

    One row per node says of any two nodes whether one stands below the other:
    first < other.first <= last. Nodes on a cycle or leading into one have no row.
    """
    paths = materialise(resolve(parent_pointers(sessions), with_path=True).where("path is not null"), "paths")
    below = descendants(paths).groupBy(F.col("ancestor_id").alias("id")).agg(F.count("*").alias("n"))
    placed = dense_index(paths.select("id", "root_id", "path"), "first", "path").drop("path")
    return placed.join(below, "id", "left").select(F.col("id").alias("session_id"), "root_id", F.col("first").cast("bigint").alias("first"), (F.col("first") + F.coalesce("n", F.lit(0))).cast("bigint").alias("last"))


def found(sessions: DataFrame) -> DataFrame:
    """(session_id, root_id, depth) of each session that names a parent."""
    return resolve(parent_pointers(sessions)).where("has_link").select(F.col("id").alias("session_id"), "root_id", "depth")
