"""Graph operators: strongly connected components, chain depth, layers of what needs what."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..session import Written, written

#: Trimming goes on while a round leaves at most this share of the edges.
LEAST_TRIMMED = 0.8


def _trimmed(edges: DataFrame) -> Written:
    """Edges whose ends both have a way in and a way out: all others lie on no cycle."""
    now = Written(edges)
    n = now.df.count()
    while n:
        ends = now.df.select(F.col("src").alias("node")).intersect(now.df.select(F.col("dst").alias("node")))
        kept = now.df.join(ends.withColumnRenamed("node", "src"), "src", "left_semi").join(ends.withColumnRenamed("node", "dst"), "dst", "left_semi")
        after = Written(kept.select("src", "dst"))
        m = after.df.count()
        now.drop()
        now = after
        if m > n * LEAST_TRIMMED:
            break
        n = m
    return now


def _least(edges: DataFrame, turn: int, rounds: list) -> Written:
    """(node, least): for each node of (src, dst) the least node that reaches it, itself included, in an order of nodes that
    is random and new each turn; least is (rank, node).

    In each round a node takes the least of those that its predecessors know, then what that one knows in turn: such
    shortcuts make the stretch of a path that a node knows longer by a factor, so rounds follow the logarithm of the paths.
    """
    rank = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("rank"), F.col(c).alias("node"))
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    now = Written(nodes.withColumn("least", rank("node")).withColumn("moved", F.lit(True)))
    while True:
        rounds.append(turn)
        offers = edges.join(now.df.where("moved"), F.col("src") == F.col("node")).groupBy("dst").agg(F.min("least").alias("offer"))
        known = now.df.select(F.col("node").alias("at"), F.col("least").alias("theirs"))
        step = now.df.join(known, F.col("least.node") == F.col("at")).join(offers, F.col("node") == F.col("dst"), "left")
        step = step.select("node", F.least("least", "theirs", "offer").alias("least"), F.col("least").alias("was"))
        changed = Observation()
        after = Written(step.select("node", "least", (F.col("least") < F.col("was")).alias("moved")).observe(changed, F.count_if("moved").alias("n")))
        now.drop()
        now = after
        if not changed.get["n"]:
            return now


def strong_components(edges: DataFrame, rounds: list | None = None) -> DataFrame:
    """(component, node) of the cycles of (src, dst): components of more than one node, named by their smallest.

    Nodes with a single way out are followed to where these ways end, by pointers that double: what ends in a ring of such
    nodes is known then, all others are taken out, and the ways that led to them lead to their ends. The rest is searched
    forward and backward from many pivots at once (_searched). Then those taken out that lie on a way inside a component
    come back. All tables are of the size of the edges, and all steps are joins and aggregations, whatever the size; rounds,
    which gets an entry for each, follow the logarithm of the paths.
    """
    rounds = [] if rounds is None else rounds
    plain = _trimmed(edges.select("src", "dst").where("src <> dst").distinct())
    if plain.df.isEmpty():
        return edges.select(F.col("src").alias("component"), F.col("src").alias("node")).limit(0)
    single = plain.df.groupBy("src").agg(F.min("dst").alias("to"), F.count("*").alias("n")).where("n = 1")
    pointers = [Written(single.select(F.col("src").alias("node"), "to", F.col("src").alias("least")))]
    n = pointers[0].df.count()
    while n and 1 << (len(pointers) - 1) < 2 * n:
        rounds.append("pointers")
        ahead = pointers[-1].df.select(F.col("node").alias("at"), F.col("to").alias("further"), F.col("least").alias("theirs"))
        moved = Observation()
        step = pointers[-1].df.join(ahead, F.col("to") == F.col("at"), "left").observe(moved, F.count("at").alias("n"))
        pointers.append(Written(step.select("node", F.coalesce("further", "to").alias("to"), F.least("least", "theirs").alias("least"))))
        if not moved.get["n"]:
            break
    ends = pointers[-1].df
    ring = ends.join(ends.select(F.col("node").alias("to")), "to", "left_semi")
    rings = ends.join(ring.select(F.col("to").alias("node")).distinct(), "node", "left_semi").select(F.col("least").alias("root"), "node")
    exits = Written(ends.join(ends.select(F.col("node").alias("to")), "to", "left_anti").select("node", F.col("to").alias("end")))
    # Ways from nodes with several of them, to where they end; into a ring there is no way back.
    led = plain.df.join(ends.select(F.col("node").alias("src")), "src", "left_anti").join(exits.df.withColumnRenamed("node", "dst"), "dst", "left")
    led = led.join(ring.select(F.col("node").alias("dst")), "dst", "left_anti")
    led = Written(led.select("src", F.col("dst").alias("by"), F.coalesce("end", "dst").alias("dst")))
    found = Written(_searched(led.df.select("src", "dst").where("src <> dst").distinct(), rounds))
    root = lambda at, to: found.df.select(F.col("node").alias(at), F.col("root").alias(to))
    inside = led.df.join(root("src", "a"), "src", "left").join(root("dst", "b"), "dst", "left").withColumn("root", F.coalesce("a", "src"))
    inside = inside.where("root = coalesce(b, dst) and by <> dst or src = dst")
    marked = Written(inside.select(F.col("by").alias("node"), "root").unionByName(inside.select(F.col("dst").alias("node"), "root")).distinct())
    for level in pointers:
        rounds.append("marks")
        more = marked.df.join(level.df.select("node", "to"), "node").select(F.col("to").alias("node"), "root")
        after = Written(marked.df.unionByName(more).distinct())
        marked.drop()
        marked = after
    out = found.df.select("root", "node").unionByName(marked.df.select("root", "node")).unionByName(rings).distinct()
    named = out.groupBy("root").agg(F.min("node").alias("component"), F.count("*").alias("n")).where("n > 1").select("root", "component")
    return out.join(named, "root").select("component", "node")


def _searched(edges: DataFrame, rounds: list) -> DataFrame:
    """(root, node) of the components of (src, dst), also of one node.

    Forward and backward search from many pivots at once. Each turn, every node learns the least node that reaches it, and
    inside the classes of these the least that it reaches, in a random order. Where both are one, that is a component;
    other edges go on if they are inside one class of both. The random order cuts a path at random places, so turns, too,
    follow the logarithm.
    """
    now = _trimmed(edges)
    out, turn = edges.select(F.col("src").alias("root"), F.col("src").alias("node")).limit(0), 0
    while not now.df.isEmpty():
        ahead = _least(now.df, turn, rounds)
        inside = Written(_within(now.df, ahead.df))
        back = _least(inside.df.select(F.col("dst").alias("src"), F.col("src").alias("dst")), turn, rounds)
        both = Written(back.df.select("node", F.col("least").alias("to")).join(ahead.df.select("node", "least"), "node").select("node", "least", (F.col("to.node") == F.col("least.node")).alias("found"), F.struct("to", "least").alias("both")))
        out = out.unionByName(both.df.where("found").select(F.col("least.node").alias("root"), "node"))
        rest = _within(inside.df, both.df.where("not found").select("node", F.col("both").alias("least")))
        after = _trimmed(rest)
        for x in (now, ahead, inside, back):
            x.drop()
        now, turn = after, turn + 1
    return out


def _within(edges: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges (src, dst) inside one class of (node, least)."""
    a, b = classes.select(F.col("node").alias("src"), "least"), classes.select(F.col("node").alias("dst"), F.col("least").alias("other"))
    return edges.join(a, "src").join(b, "dst").where("least = other").select("src", "dst")


def layers(needs: DataFrame) -> DataFrame:
    """(node, level, in_cycle) of every node of (node, needs), where needs may be null: level 0 needs nothing, others lie one
    above the highest that they need. Nodes of a cycle, and all that need one, have no level; in_cycle tells the former.

    Peeling by counters: a round takes the nodes whose needs are all met and lowers the counters of what needs them, so a
    round costs a join with the nodes just taken; rounds are as many as there are levels.
    """
    edges = Written(needs.where("needs is not null").select("node", "needs").distinct())
    every = needs.select("node").union(edges.df.select("needs")).distinct()
    start = every.join(edges.df.groupBy("node").agg(F.count("*").alias("open")), "node", "left").select("node", F.coalesce("open", F.lit(0).cast("long")).alias("open"))
    done, level = None, 0
    while True:
        taken = Observation()
        # Of each round what is taken now (open 0) and what is still open.
        now = Written(start.observe(taken, F.count_if(F.col("open") == 0).alias("n")))
        if not taken.get["n"]:
            break
        part = now.df.where("open = 0").select("node", F.lit(level).alias("level"))
        done = part if done is None else done.unionByName(part)
        met = edges.df.join(part.select(F.col("node").alias("needs")), "needs", "left_semi").groupBy("node").agg(F.count("*").alias("met"))
        start = now.df.where("open > 0").join(met, "node", "left").select("node", (F.col("open") - F.coalesce("met", F.lit(0))).alias("open"))
        level += 1
    left = now.df.select("node")
    core = edges.df.join(left, "node", "left_semi").join(left.withColumnRenamed("node", "needs"), "needs", "left_semi")
    cycles = strong_components(core.select(F.col("node").alias("src"), F.col("needs").alias("dst"))).select("node").union(core.where("node = needs").select("node")).distinct()
    stuck = left.join(cycles.withColumn("in_cycle", F.lit(True)), "node", "left").select("node", F.lit(None).cast("int").alias("level"), F.coalesce("in_cycle", F.lit(False)).alias("in_cycle"))
    return stuck if done is None else done.withColumn("in_cycle", F.lit(False)).unionByName(stuck)


def chain_depth(classes: DataFrame) -> DataFrame:
    """(module, class, depth) of (module, class, super_class): how many superclasses a class has, those outside the module
    counting once.

    Pointers double each round, so rounds grow with the logarithm of the deepest chain. A chain that comes back to a
    class ends there; the few classes on or above such cycles are walked one step a round.
    """
    nodes = written(classes.groupBy("module", "class").agg(F.min("super_class").alias("super_class")))
    up = nodes.alias("c").join(nodes.alias("p"), F.expr("c.module = p.module and c.super_class = p.class"), "left")
    state = up.select("c.module", "c.class", F.col("p.class").alias("to"), F.when(F.col("c.super_class").isNull(), 0).otherwise(1).alias("hops"))
    state = written(state)
    n = nodes.count()
    for _ in range(max(1, n.bit_length())):
        if state.where("to is not null").isEmpty():
            return state.select("module", "class", F.col("hops").alias("depth"))
        a, b = state.alias("a"), state.alias("b")
        state = written(a.join(b, F.expr("a.module = b.module and a.to = b.class"), "left").select("a.module", "a.class", "b.to", (F.col("a.hops") + F.coalesce("b.hops", F.lit(0))).alias("hops")))
    done = state.where("to is null").select("module", "class", F.col("hops").alias("depth"))
    walk = state.where("to is not null").select("module", "class", F.col("class").alias("at"), F.array("class").alias("seen"))
    ended = None
    while True:
        a, b = walk.alias("a"), nodes.alias("b")
        moved = written(a.join(b, F.expr("a.module = b.module and a.at = b.class")).select("a.module", "a.class", F.col("b.super_class").alias("at"), "seen"))
        over = F.array_contains("seen", F.col("at"))
        part = moved.where(over).select("module", "class", (F.size("seen") - 1).alias("depth"))
        ended = part if ended is None else ended.unionByName(part)
        walk = moved.where(~over).withColumn("seen", F.concat("seen", F.array("at")))
        if walk.isEmpty():
            return done.unionByName(ended)


def package_graph(imports: DataFrame, packages: DataFrame) -> DataFrame:
    """(module, src, dst, class, import): what a package imports from another of the same module, with its evidence."""
    known = packages.select("module", F.col("package").alias("dst")).distinct()
    named = imports.where("import is not null").select("module", F.col("package").alias("src"), "class", "import", F.regexp_extract("import", r"^(.*)\.[^.]*$", 1).alias("dst"))
    return named.join(known, ["module", "dst"]).where("src <> dst").select("module", "src", "dst", "class", "import").distinct()


def class_graph(imports: DataFrame, classes: DataFrame) -> DataFrame:
    """(src, dst): classes of a module that import another class of it, by qualified names."""
    known = classes.select("module", F.col("class").alias("dst")).distinct()
    named = imports.where("import is not null").select("module", F.col("class").alias("src"), F.col("import").alias("dst"))
    return named.join(known, ["module", "dst"]).where("src <> dst").select("src", "dst").distinct()
