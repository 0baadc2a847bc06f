"""Parent-child links to full hierarchies, by splitters on a pointer graph.

Every node has at most one parent. A deterministic hash of the key makes one node in SPLIT_EVERY a
splitter; nodes without a parent are splitters too. Each node walks to its next splitter by pointer
doubling, so the arrays it carries stay as short as the gap between splitters. The graph of the
splitters alone, about SPLIT_EVERY times smaller, is then solved the same way, and a node's exact path
is its own walk followed by the path of the splitter where that walk ends. Whatever never reaches a
splitter runs into a circle that holds none, and is handled on its own; splitters that never reach a
root run into a circle of the reduced graph.

All rounds are joins on an integer id: no group is gathered in one task, whatever the size of a tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import cut

SPLIT_EVERY = 8
_HOP = "array<struct<id:bigint,label:string>>"


def label_key(c: Column) -> Column:
    """Labels are compared without case and white space."""
    return F.lower(F.regexp_replace(c, r"\s+", ""))


class Hierarchy:
    """Trees of (group, label, parent label, time) rows.

    Of several rows of one (group, label) the one with the latest time counts; equal times are decided by
    the greater parent label, then the greater label, nulls lowest, so the result doesn't depend on the order
    of rows. Rows whose group or label is null, or whose label has no characters but spaces, are no nodes.
    A null, empty or unknown parent ends the chain: the node is a root of depth 0. An empty input gives an
    empty result. Other columns of the input are never looked at. Without paths only on_circle() can be asked,
    and no labels are carried.
    """

    def __init__(self, rows: DataFrame, group: str, label: str, parent: str, time: str, split_every: int = SPLIT_EVERY, paths: bool = True):
        self.split_every, self.paths = split_every, paths
        src = rows.select(
            F.col(group).cast("string").alias("grp"), F.col(label).cast("string").alias("label"), F.col(parent).cast("string").alias("parent"), F.col(time).alias("at")
        ).withColumn("key", label_key(F.col("label")))
        nodes = (
            src.where("grp is not null and key <> ''")
            .groupBy("grp", "key")
            .agg(F.max(F.struct("at", "parent", "label")).alias("last"))
            .select("grp", "key", F.col("last.label").alias("label"), label_key(F.col("last.parent")).alias("pkey"))
            .withColumn("id", F.monotonically_increasing_id())
        )
        #: one row per node; ids are fixed by the write
        self.nodes = cut(nodes, "nodes")
        split = F.pmod(F.xxhash64("grp", "key"), F.lit(split_every)) == 0
        up = self.nodes.select("grp", F.col("key").alias("pkey"), F.col("id").alias("pid"), F.col("label").alias("plabel"), split.alias("psplit"), F.col("pkey").alias("gkey"))
        have = self.nodes.select(F.col("grp").alias("g2"), F.col("key").alias("k2"))
        # a parent is a root, hence a splitter, when its own parent isn't there
        linked = self.nodes.join(up, ["grp", "pkey"], "left").join(have, (F.col("grp") == F.col("g2")) & (F.col("gkey") == F.col("k2")), "left")
        self.links = cut(
            linked.select("id", split.alias("split"), "pid", "plabel", F.coalesce(F.col("psplit") | F.col("k2").isNull(), F.lit(False)).alias("pstop"), F.col("k2").isNull().alias("proot")), "links"
        )
        self._solve()

    def _double(self, state: DataFrame, name: str) -> tuple[DataFrame, DataFrame, int]:
        """state: id, ptr, seg, done. Doubles pointers until all are done or no more can become so.

        If any unfinished node still had an end to reach, some node on its way would reach it in the very
        next round; so when a round leaves the number of unfinished nodes as it was, all of them circle."""
        done = state.where("done")
        rest = cut(state.where("not done"), f"{name}-rest")
        left = rest.count()
        while left:
            known = done.unionByName(rest).select(F.col("id").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("seg").alias("seg2"), F.col("done").alias("done2"))
            step = cut(rest.select("id", "ptr", "seg").join(known, "ptr").select("id", F.col("ptr2").alias("ptr"), F.concat("seg", "seg2").alias("seg"), F.col("done2").alias("done")), f"{name}-step")
            done, rest = done.unionByName(step.where("done")), step.where("not done")
            now = rest.count()
            if now == left:
                break
            left = now
        return done, rest.select("id"), left

    @staticmethod
    def _on_circle(pointers: DataFrame) -> DataFrame:
        """pointers: id, ptr, each ptr being an id. Nodes on circles are those that f^m still reaches. The image
        shrinks with m; when f^m maps it onto itself, it is exactly the nodes on circles."""
        jump, size = pointers, -1
        image = pointers.select(F.col("ptr").alias("id")).distinct()
        while (now := image.count()) != size:
            size = now
            ahead = jump.select(F.col("id").alias("ptr"), F.col("ptr").alias("ptr2"))
            jump = cut(jump.join(ahead, "ptr").select("id", F.col("ptr2").alias("ptr")), "jump")
            image = jump.select(F.col("ptr").alias("id")).distinct()
        return cut(image, "circle")

    def _solve(self) -> None:
        spark = self.nodes.sparkSession
        none = F.lit(None).cast("bigint")
        hop = F.struct(F.col("pid").alias("id"), *([F.col("plabel").alias("label")] if self.paths else []))
        walk = self.links.where("pid is not null").select("id", F.col("pid").alias("ptr"), F.array(hop).alias("seg"), F.col("pstop").alias("done"))
        self.walks, lost, n_lost = self._double(walk, "walk")
        # the reduced graph: splitters with a parent, each pointing at the next splitter
        roots = self.links.where("pid is null").select("id")
        splitters = self.links.where("split and pid is not null").select("id")
        heads = self.walks.join(splitters, "id", "left_semi")
        heads = heads.select("id", "ptr", "seg").join(roots.select(F.col("id").alias("ptr"), F.lit(True).alias("end")), "ptr", "left").select("id", "ptr", "seg", F.coalesce("end", F.lit(False)).alias("done"))
        self.heads = cut(heads, "heads")
        self.solved, stuck, n_stuck = self._double(self.heads, "reduced")
        circles = spark.createDataFrame([], "id bigint")
        if n_lost:  # circles without a splitter: only the nodes that are on them or lead to them
            ring = self._on_circle(self.links.join(lost, "id", "left_semi").select("id", F.col("pid").alias("ptr")))
            circles = circles.union(ring)
        if n_stuck:
            ring = self._on_circle(self.heads.join(stuck, "id", "left_semi").select("id", "ptr"))
            between = self.heads.join(ring, "id", "left_semi").select(F.explode("seg.id").alias("id"))
            circles = circles.union(between)
        self.circles = cut(circles.distinct(), "circles") if n_lost or n_stuck else circles
        self.any_circle = bool(n_lost or n_stuck)
        self._none = none
        self._up: DataFrame | None = None

    def on_circle(self) -> DataFrame:
        """grp, label of the nodes that are their own ancestor, in one step or more."""
        return self.nodes.join(self.circles, "id", "left_semi").select("grp", "label")

    def ancestors(self) -> DataFrame:
        """id, up: the ancestors from parent to root, for the nodes of trees. Roots have none; nodes on circles
        or below them have no row."""
        roots = self.links.where("pid is null").select("id", F.expr(f"cast(array() as {_HOP})").alias("up"))
        ends = self.solved.select(F.col("id").alias("ptr"), F.col("seg").alias("rest")).unionByName(roots.select(F.col("id").alias("ptr"), F.col("up").alias("rest")))
        return roots.unionByName(self.walks.join(ends, "ptr").select("id", F.concat("seg", "rest").alias("up")))

    def descendants(self) -> DataFrame:
        """grp, ancestor, descendant, distance: one row for each node of a tree and each of its ancestors. all_descendants() has those of
        the other nodes too."""
        pairs = self.ancestors().select("id", F.posexplode("up").alias("pos", "a"))
        return pairs.join(self.nodes.select("id", "grp", "label"), "id").select("grp", F.col("a.label").alias("ancestor"), F.col("label").alias("descendant"), (F.col("pos") + 1).cast("bigint").alias("distance"))

    def tree_up(self) -> DataFrame:
        """ancestors(), written once."""
        if self._up is None:
            self._up = cut(self.ancestors(), "up")
        return self._up

    def circling(self) -> DataFrame:
        """id, up: the ancestors, nearest first and each once, of the nodes on circles and below them. A node on a circle comes last in its
        own list; below a circle the list ends where the way round would come to its first node again."""
        if not self.any_circle:
            return self.links.select("id", F.expr(f"cast(array() as {_HOP})").alias("up")).where("false")
        step = F.array(F.struct(F.col("pid").alias("id"), F.col("plabel").alias("label")))
        ring = self.links.join(self.circles, "id", "left_semi").select("id", F.col("pid").alias("ptr"), step.alias("seg"))
        # each circle is opened at its smallest id: low is the smallest of the next 2^k nodes, and when a round changes none, of the whole circle
        jump, total = cut(ring.select("id", "ptr", F.least("id", "ptr").alias("low")), "low"), None
        while (now := jump.agg(F.sum(F.col("low").cast("decimal(38,0)"))).first()[0]) != total:
            total = now
            ahead = jump.select(F.col("id").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("low").alias("low2"))
            jump = cut(jump.join(ahead, "ptr").select("id", F.col("ptr2").alias("ptr"), F.least("low", "low2").alias("low")), "low")
        opened = cut(ring.join(jump.select("id", "low"), "id").select("id", "ptr", "seg", (F.col("ptr") == F.col("low")).alias("done")), "opened")
        walks = cut(self._double(opened, "ring")[0], "round")  # the smallest node's own walk goes round the whole circle
        whole = walks.where("id = ptr").select("ptr", F.col("seg").alias("all"))
        rounds = cut(walks.join(whole, "ptr").select("id", F.concat("seg", F.slice("all", F.lit(1), F.size("all") - F.size("seg"))).alias("up")), "rounds")
        # what hangs below walks to the circle, and from there once round
        trees = self.tree_up().select("id")
        below = self.links.join(trees, "id", "left_anti").join(self.circles, "id", "left_anti").select("id", F.col("pid").alias("ptr"), step.alias("seg"))
        ends = self.circles.select(F.col("id").alias("ptr"), F.lit(True).alias("end"))
        hang = cut(below.join(ends, "ptr", "left").select("id", "ptr", "seg", F.coalesce("end", F.lit(False)).alias("done")), "hang")
        below = self._double(hang, "below")[0]
        on = rounds.select(F.col("id").alias("ptr"), F.slice("up", F.lit(1), F.size("up") - 1).alias("rest"))
        return rounds.unionByName(below.join(on, "ptr").select("id", F.concat("seg", "rest").alias("up")))

    def all_descendants(self) -> DataFrame:
        """grp, ancestor, descendant, distance: one row for each node, of trees or not, and each of its ancestors. A node on a circle is
        its own descendant, once round."""
        pairs = self.tree_up().unionByName(self.circling()).select("id", F.posexplode("up").alias("pos", "a"))
        return pairs.join(self.nodes.select("id", "grp", "label"), "id").select("grp", F.col("a.label").alias("ancestor"), F.col("label").alias("descendant"), (F.col("pos") + 1).cast("bigint").alias("distance"))

    def counts(self) -> DataFrame:
        """grp, label, descendants: the number of descendants of every node, counted as in all_descendants."""
        n = self.tree_up().unionByName(self.circling()).select(F.explode("up.id").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
        return self.nodes.join(n, "id", "left").select("grp", "label", F.coalesce("n", F.lit(0)).cast("bigint").alias("descendants"))

    def table(self) -> DataFrame:
        """grp, label, state (tree, circle, below_circle), path, depth, root, descendants.

        path goes from the root's label to the node's own; depth is 0 for roots. For circles and what hangs below them,
        path, depth and root are null, as they have no root; descendants is given for trees only, and for all nodes by counts()."""
        up = cut(self.ancestors(), "up")
        count = up.select(F.explode("up.id").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
        out = self.nodes.select("id", "grp", "label").join(up, "id", "left").join(count, "id", "left").join(self.circles.withColumn("ring", F.lit(True)), "id", "left")
        tree = F.col("up").isNotNull()
        return out.select(
            "grp",
            "label",
            F.when(tree, "tree").when(F.col("ring"), "circle").otherwise("below_circle").alias("state"),
            F.when(tree, F.concat(F.reverse(F.col("up.label")), F.array("label"))).alias("path"),
            F.when(tree, F.size("up").cast("bigint")).alias("depth"),
            F.when(tree, F.coalesce(F.try_element_at("up", F.lit(-1))["label"], F.col("label"))).alias("root"),
            F.when(tree, F.coalesce("n", F.lit(0)).cast("bigint")).alias("descendants"),
        )
