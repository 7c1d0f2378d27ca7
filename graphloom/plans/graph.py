"""Property graphs as node and edge tables: traversal, impact, closure, order, export."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.intervals import maximal
from graphloom.operators.joins import sized
from graphloom.operators.sets import last_wins
from graphloom.session import checkpoint


def unified(edges: DataFrame) -> DataFrame:
    """One edge per (from_id, to_id, relation), with the evidence of the last one by seq; no edge leads to its own start."""
    return last_wins(edges.where("from_id <> to_id"), ["from_id", "to_id", "relation"], ["seq"], ["evidence"])


def _walk(edges: DataFrame, targets: DataFrame, direction: str, depth: int | None, most: int | None, external: str, free: DataFrame | None) -> tuple[DataFrame, int, bool]:
    """(reached, nodes counted, whether nodes were left out)."""
    a, b = ("to_id", "from_id") if direction == "incoming" else ("from_id", "to_id")
    e = edges.select(F.col(a).alias("parent"), F.col(b).alias("id"), "relation")
    seen = checkpoint(targets.select("id").distinct().withColumn("distance", F.lit(0)).withColumn("parent", F.lit(None).cast("string")).withColumn("relation", F.lit(None).cast("string")))
    level, out, used, cut, d = seen, None, 0, False, 0
    while depth is None or d < depth:
        d += 1
        front = level.where(~F.col("id").startswith(external)).select(F.col("id").alias("parent"))
        hit = front.join(e, "parent").join(seen, "id", "left_anti").groupBy("id").agg(F.min(F.struct("parent", "relation")).alias("p"))
        level = hit.select("id", F.lit(d).alias("distance"), "p.parent", "p.relation")
        if most is not None:
            counted = level if free is None else level.join(free, "id", "left_anti")
            counted = checkpoint(counted.orderBy("id").limit(most - used + 1))  # one more shows whether any is left out
            n = counted.count()
            cut = cut or n > most - used
            n = min(n, most - used)
            used += n
            counted = counted.orderBy("id").limit(n)
            level = counted if free is None else counted.unionByName(level.join(free, "id", "left_semi"))
        level = checkpoint(level)
        if not level.limit(1).count():
            break
        seen = seen.unionByName(level)
        out = level if out is None else out.unionByName(level)
        if cut and free is None:
            break
    return out if out is not None else seen.limit(0), used, cut


def traverse(edges: DataFrame, targets: DataFrame, direction: str, depth: int | None = 3, most: int | None = None, external: str = "external:", free: DataFrame | None = None) -> DataFrame:
    """(id, distance, parent, relation) of what is reached from targets (id); edges are (from_id, to_id, relation).

    Breadth first, level by level, until `depth` (None: until nothing is new): a
    frontier meets the edges by an equi-join, what is known is taken out by an
    anti-join, and of several parents the first by parent and relation is kept.
    External nodes are reached but not left.  With `most`, the nodes of the level that
    crosses it are kept by id; nodes in `free` (id) do not count.
    """
    return _walk(edges, targets, direction, depth, most, external, free)[0]


def impact_report(edges: DataFrame, targets: DataFrame, depth: int | None = 3, most: int | None = 200, direction: str = "both", external: str = "external:") -> tuple[DataFrame, bool]:
    """(rows of `impact`, truncated): truncated tells that the cap on nodes left some out."""
    both = ["incoming", "outgoing"] if direction == "both" else [direction]
    out, known, left, truncated = None, None, most, False
    for way in both:
        r, used, cut = _walk(edges, targets, way, depth, left, external, known)
        left = left - used if left is not None else None
        truncated = truncated or cut
        r = r.withColumn("direction", F.lit(way))
        known = r.select("id")
        out = r if out is None else out.unionByName(r)
    return out, truncated


def impact(edges: DataFrame, targets: DataFrame, depth: int | None = 3, most: int | None = 200, direction: str = "both") -> DataFrame:
    """(id, direction, distance, parent, relation): incoming first; a node reached already does not count again."""
    return impact_report(edges, targets, depth, most, direction)[0]


def impacted(reached: DataFrame) -> DataFrame:
    """(id, distance, directions, relations): one row per node of `impact`, nearest distance first."""
    return reached.groupBy("id").agg(F.min("distance").alias("distance"), F.array_sort(F.collect_set("direction")).alias("directions"), F.array_sort(F.collect_set("relation")).alias("relations"))


def steps(reached: DataFrame, depth: int = 3) -> DataFrame:
    """(id, distance, steps): the edges of one shortest path of a traversal, from the target on."""
    back = reached.select(F.col("id").alias("_at"), F.col("parent").alias("_up"), F.col("relation").alias("_r"))
    one = lambda a, b, r: F.array(F.struct(a.alias("from_id"), b.alias("to_id"), r.alias("relation")))
    p = reached.select("id", "distance", F.col("parent").alias("_p"), one(F.col("parent"), F.col("id"), F.col("relation")).alias("steps"))
    for _ in range(depth - 1):
        p = p.join(back, F.col("_p") == F.col("_at"), "left")
        longer = F.concat(one(F.col("_up"), F.col("_p"), F.col("_r")), F.col("steps"))
        p = p.select("id", "distance", F.col("_up").alias("_p"), F.when(F.col("_up").isNotNull(), longer).otherwise(F.col("steps")).alias("steps"))
    return p.drop("_p")


def with_endpoints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes (id, name, kind), with those that only edges name added as external or unknown ones."""
    ends = edges.select(F.col("from_id").alias("id")).union(edges.select("to_id")).distinct().join(nodes, "id", "left_anti")
    own = F.col("id").startswith("external:")
    return nodes.select("id", "name", "kind").unionByName(ends.select("id", F.when(own, F.substring("id", 10, 2**30)).otherwise(F.col("id")).alias("name"), F.when(own, "External").otherwise("Unknown").alias("kind")))


def canonical(edges: DataFrame, aliases: DataFrame) -> DataFrame:
    """Edges with both ends replaced by the id that their alias (alias, id) stands for."""
    for end in ("from_id", "to_id"):
        a = aliases.select(F.col("alias").alias(end), F.col("id").alias("_id"))
        edges = edges.join(a, end, "left").withColumn(end, F.coalesce("_id", end)).drop("_id")
    return edges


def property_edges(calls: DataFrame, references: DataFrame, records: DataFrame) -> DataFrame:
    """Edges of the unified graph in their order: calls (id, calls), references (id, references), then definition-use records."""
    c = calls.select(F.lit(0).alias("part"), F.col("id").alias("from_id"), F.explode("calls").alias("to_id"), F.lit("calls").alias("relation"), F.lit(None).cast("string").alias("evidence"))
    r = references.select("id", F.explode("references").alias("r")).select(F.lit(1).alias("part"), F.col("id").alias("from_id"), F.col("r.id").alias("to_id"), F.lit("references").alias("relation"), F.col("r.name").alias("evidence"))
    d = F.col("id").alias("from_id")
    i = records.select(F.lit(2).alias("part"), d, F.explode("initializer.dependency_ids").alias("to_id"), F.lit("initializes_from").alias("relation"), F.concat("name", F.lit(" = "), F.col("initializer.defined_by")).alias("evidence"))
    a = records.select("id", "name", F.explode("assignments").alias("a")).select("id", "name", "a.defined_by", F.explode("a.dependency_ids").alias("to_id"))
    a = a.select(F.lit(3).alias("part"), d, "to_id", F.lit("assigned_from").alias("relation"), F.concat("name", F.lit(" = "), "defined_by").alias("evidence"))
    u = records.select("id", "name", "owner", F.explode("read_sites").alias("s")).where("s.owner_id is not null")
    u = u.select(F.lit(4).alias("part"), F.col("s.owner_id").alias("from_id"), F.col("id").alias("to_id"), F.lit("reads").alias("relation"), F.concat("owner", F.lit(" reads "), "name").alias("evidence"))
    e = c.unionByName(r).unionByName(i).unionByName(a).unionByName(u).withColumn("seq", F.struct("part", F.monotonically_increasing_id()))
    return unified(e)


def evidence(edges: DataFrame, starts: DataFrame, depth: int, cap: int, beyond: bool) -> DataFrame:
    """(start, from_id, to_id, relation, distance): edges met by a bounded traversal from each start (start, id), the first `cap` of each.

    With `beyond`, nodes at the last distance are still left once more; that is the
    one difference between the two families of detectors.
    """
    e = edges.select(F.col("from_id").alias("id"), "to_id", "relation")
    seen = checkpoint(starts.select("start", "id").distinct())
    front, out = seen, None
    for d in range(1, depth + 1 + beyond):
        hit = checkpoint(front.join(e, "id").select("start", F.col("id").alias("from_id"), "to_id", "relation", F.lit(d).alias("distance")))
        out = hit if out is None else out.unionByName(hit)
        front = checkpoint(hit.select("start", F.col("to_id").alias("id")).distinct().join(seen, ["start", "id"], "left_anti"))
        if not front.limit(1).count():
            break
        seen = seen.unionByName(front)
    n = F.row_number().over(Window.partitionBy("start").orderBy("distance", "from_id", "to_id", "relation"))
    return out.withColumn("_n", n).where(F.col("_n") <= cap).drop("_n")


def code_slice(declarations: DataFrame, edges: DataFrame, type_edges: DataFrame, targets: DataFrame, depth: int = 2, most: int = 50) -> dict[str, DataFrame]:
    """Selections, outermost snippets, their link, and external boundaries around targets (id).

    Supporting types come first, however far, and share one budget with the impacts;
    `truncated` (one row) tells whether that left nodes out.  Declarations are (id, file_path, start_off, end_off, external).
    """
    types, used, cut = _walk(type_edges, targets, "outgoing", None, most, "external:", None)
    types = types.select("id", F.lit("type").alias("role"), "distance")
    reached, more = impact_report(edges, targets, depth, most - used)
    reached = reached.select("id", F.col("direction").alias("role"), "distance")
    sel = targets.select("id", F.lit("target").alias("role"), F.lit(0).alias("distance")).unionByName(types).unionByName(reached)
    sel = checkpoint(sel.groupBy("id").agg(F.array_sort(F.collect_set("role")).alias("roles"), F.min("distance").alias("distance")))
    own = sel.join(declarations.where("not external"), "id")
    snippets = maximal(own.select("file_path", "start_off", "end_off"), ["file_path"], "start_off", "end_off").withColumn("snippet_id", F.concat_ws(":", "file_path", "start_off", "end_off"))
    inside = own.select("id", "file_path", F.col("start_off").alias("_s"), F.col("end_off").alias("_e")).join(snippets, "file_path").where("start_off <= _s and _e <= end_off").select("id", "snippet_id")
    return {"selections": sel, "snippets": snippets, "links": inside, "boundaries": sel.where(F.col("id").startswith("external:")), "truncated": sel.sparkSession.createDataFrame([(cut or more,)], "truncated boolean")}


def closure(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(from_id, to_id, distance): all reachable pairs, shortest first, until nothing new appears.

    With `most`, longer paths than that are an error, not left out.
    """
    step = checkpoint(edges.select("from_id", "to_id").distinct())
    all_, front, d = step.withColumn("distance", F.lit(1)), step, 1
    while True:
        d += 1
        new = front.withColumnRenamed("to_id", "mid").join(step.withColumnRenamed("from_id", "mid"), "mid").select("from_id", "to_id").distinct()
        front = checkpoint(new.join(all_, ["from_id", "to_id"], "left_anti"))
        if not front.limit(1).count():
            return all_
        if most is not None and d > most:
            raise ValueError(f"there are paths of more than {most} steps")
        all_ = all_.unionByName(front.withColumn("distance", F.lit(d)))


def dependency_levels(edges: DataFrame) -> DataFrame:
    """(id, level): 0 for what depends on nothing, else one more than the highest dependency.

    Levels are found until no node is ready any more, so nodes that are left out are
    on a cycle or depend on one.  Nodes with one dependency lead to the end of their
    chain in rounds that double the distance; only nodes with several are taken level by level.
    """
    e = checkpoint(edges.select("from_id", "to_id"))
    one = F.coalesce((F.min("to_id") == F.max("to_id")) & (F.count_if(F.col("to_id").isNull()) == 0), F.lit(False))
    users = checkpoint(e.where("from_id is not null").groupBy(F.col("from_id").alias("id")).agg(F.min("to_id").alias("up"), one.alias("one")))
    chained, branched = users.where("one").select("id", "up"), users.where("not one").select(F.col("id").alias("from_id"))
    nodes = e.select(F.col("from_id").alias("id")).union(e.select("to_id")).distinct()
    last = checkpoint(nodes.join(sized(users.select("id")), "id", "left_anti").withColumn("level", F.lit(0)))
    # (id, up, w, done): `up` is w steps on, and done if it is no part of a chain
    inner = chained.select(F.col("id").alias("_id"))
    jump = checkpoint(chained.join(sized(inner), F.col("up") == F.col("_id"), "left").select("id", "up", F.lit(1).alias("w"), F.col("_id").isNull().alias("done")))
    open_, before = jump.where("not done").count(), -1
    while open_ and open_ != before:  # distances on chains have no gaps: a round that settles nothing leaves cycles
        further = jump.select(F.col("id").alias("_id"), F.col("up").alias("_up"), F.col("w").alias("_w"), F.col("done").alias("_done"))
        moved = jump.where("not done").join(sized(further), F.col("up") == F.col("_id")).select("id", F.col("_up").alias("up"), (F.col("w") + F.col("_w")).alias("w"), F.col("_done").alias("done"))
        jump = checkpoint(jump.where("done").unionByName(moved))
        open_, before = jump.where("not done").count(), open_
    ends = last
    if branched.limit(1).count():
        ends = _branched_levels(e.join(sized(branched), "from_id", "left_semi").distinct(), jump, last)
    ends = checkpoint(ends)
    at = ends.select(F.col("id").alias("_id"), "level")
    return ends.unionByName(jump.where("done").join(sized(at), F.col("up") == F.col("_id")).select("id", (F.col("level") + F.col("w")).alias("level")))


def _branched_levels(edges: DataFrame, jump: DataFrame, last: DataFrame) -> DataFrame:
    """Levels of `last` and of the nodes that edges start from, whose dependencies are taken to the ends of their chains."""
    j = jump.select(F.col("id").alias("to_id"), "up", F.col("w").alias("_w"))
    e = edges.join(sized(j), "to_id", "left").groupBy("from_id", F.coalesce("up", "to_id").alias("to_id")).agg(F.max(F.lit(1) + F.coalesce("_w", F.lit(0))).alias("w"))
    e, out = checkpoint(e.withColumn("best", F.lit(None).cast("int"))), last
    while last.limit(1).count() and e.limit(1).count():
        met = e.join(sized(last.select(F.col("id").alias("to_id"), "level")), "to_id", "left")
        met = checkpoint(met.select("from_id", "to_id", "w", "best", (F.col("level") + F.col("w")).alias("v")))
        # only edges to nodes without a level stay open; of the others the highest is kept
        found = checkpoint(met.groupBy("from_id").agg(F.max(F.greatest("best", "v")).alias("best"), F.count_if(F.col("v").isNull()).alias("n")))
        last = found.where("n = 0").select(F.col("from_id").alias("id"), F.col("best").alias("level"))
        out = out.unionByName(last)
        e = checkpoint(met.where("v is null").select("from_id", "to_id", "w").join(sized(found.where("n > 0").select("from_id", "best")), "from_id"))
    return out


def subtree_totals(parents: DataFrame, value: str) -> DataFrame:
    """(id, parent, direct, total, <value>) of a forest (id, parent, value): children, descendants, and the sum over the subtree with its root.

    Levels are laid down from the roots (rows whose parent is null or none of the
    ids), then summed up from the deepest: every row is in one level, so the work is
    that of the rows, not of all pairs above one another.  Rows on a cycle of parents,
    or below one, have children but null totals.
    """
    p = checkpoint(parents.select("id", "parent", F.col(value).alias("v")))
    direct = p.groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("direct"))
    roots = p.join(p.select(F.col("id").alias("parent")), "parent", "left_anti").select("id", "parent", "v")
    levels = [checkpoint(roots)]
    while levels[-1].limit(1).count():
        levels.append(checkpoint(p.join(levels[-1].select(F.col("id").alias("parent")), "parent", "left_semi").select("id", "parent", "v")))
    below, done = None, None
    for level in reversed(levels[:-1]):
        own = level.withColumn("total", F.lit(0).cast("long")).withColumn("s", F.col("v"))
        if below is not None:
            sums = below.groupBy(F.col("parent").alias("id")).agg(F.sum(F.col("total") + 1).alias("t"), F.sum("s").alias("b"))
            own = level.join(sums, "id", "left").select("id", "parent", "v", F.coalesce("t", F.lit(0)).cast("long").alias("total"), (F.col("v") + F.coalesce("b", F.lit(0))).alias("s"))
        below = checkpoint(own)
        done = below if done is None else done.unionByName(below)
    t = p.join(direct, "id", "left") if done is None else p.join(direct, "id", "left").join(done.select("id", "total", "s"), "id", "left")
    return t.select("id", "parent", F.coalesce("direct", F.lit(0)).alias("direct"), F.col("total") if done is not None else F.lit(None).cast("long").alias("total"), (F.col("s") if done is not None else F.col("v")).alias(value))


def preorder(nodes: DataFrame, file: str, start: str, end: str) -> DataFrame:
    """Preorder numbers from 1 within each file, outer ranges first."""
    return nodes.withColumn("node_id", F.row_number().over(Window.partitionBy(file).orderBy(F.col(start).asc(), F.col(end).desc())))
