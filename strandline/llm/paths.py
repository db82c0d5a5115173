"""Parent pointers resolved by iterative pointer jumping, with orphans and cycles told apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.session import durable, durable_count, release


def resolve(nodes: DataFrame, sums: list[str] | None = None, label: str = "paths", max_rounds: int = 64) -> DataFrame:
    """Root and place of each node of a forest given by parent pointers.

    nodes: id (unique, not null), parent (null for a root), and number columns `sums`.
    Gives id, root, depth (0 for a root), state (`ok`, `orphan`: the chain ends in a parent that does not exist,
    `cycle`: it never ends), and for each s in `sums` its total over the node's proper ancestors as before_s.
    For orphans root is the missing id; for cycles it is null.

    Each round doubles the distance the pointers span, so a chain of n nodes takes log2(n) rounds of one join each;
    only nodes whose pointer has not ended take part, and each round's result is written to the shared folder. A
    chain longer than 2**max_rounds counts as a cycle; a cycle is known as soon as a round's distance exceeds the
    number of nodes.
    """
    sums = sums or []
    own = [F.coalesce(F.col(s), F.lit(0)).cast("long").alias(s) for s in sums]
    base = nodes.select(F.col("id"), F.col("parent"), *own)
    total = base.count()
    # acc_s: sum over the nodes from the parent up to, not including, ptr's own ancestors.
    parents = base.select(F.col("id").alias("pid"), F.col("parent").alias("next"), *[F.col(s).alias(f"p_{s}") for s in sums])
    first = base.join(parents, base["parent"] == parents["pid"], "left")
    state = F.when(F.col("parent").isNull(), "ok").when(F.col("pid").isNull(), "orphan").otherwise("open")
    table = durable(
        first.select(
            "id",
            F.when(F.col("parent").isNull(), F.col("id")).otherwise(F.col("parent")).alias("ptr"),
            F.when(state == "open", F.lit(1)).otherwise(F.lit(0)).cast("long").alias("depth"),
            state.alias("state"),
            *[F.when(state == "open", F.col(f"p_{s}")).otherwise(F.lit(0)).cast("long").alias(f"before_{s}") for s in sums],
        ),
        label,
    )
    done, span = [table.where("state != 'open'")], 1
    active = table.where("state = 'open'")
    known = table
    for _ in range(max_rounds):
        if active.isEmpty():
            break
        if span > total:
            done.append(active.withColumn("state", F.lit("cycle")).withColumn("ptr", F.lit(None).cast(dict(active.dtypes)["ptr"])))
            break
        up = known.select(F.col("id").alias("pid"), F.col("ptr").alias("up"), F.col("depth").alias("up_depth"), F.col("state").alias("up_state"), *[F.col(f"before_{s}").alias(f"up_{s}") for s in sums])
        moved = active.join(up, active["ptr"] == up["pid"], "left").select(
            "id",
            F.col("up").alias("ptr"),
            (F.col("depth") + F.col("up_depth")).alias("depth"),
            F.col("up_state").alias("state"),
            *[(F.col(f"before_{s}") + F.col(f"up_{s}")).alias(f"before_{s}") for s in sums],
        )
        active = durable(moved, label)
        done.append(active.where("state != 'open'"))
        known = done[0]
        for d in done[1:]:
            known = known.unionByName(d)
        active = active.where("state = 'open'")
        known = known.unionByName(active)
        span *= 2
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("id", F.col("ptr").alias("root"), "depth", "state", *[f"before_{s}" for s in sums])


def root_to_leaf(nodes: DataFrame, resolved: DataFrame, label: str = "leaf-paths") -> DataFrame:
    """(leaf, place, id): the nodes of each path from a root (place 0) to a leaf below it.

    nodes: id, parent; resolved: what `resolve` gives for them. Each node of a path lies some number of steps above the
    leaf; it is reached by jumps of 1, 2, 4, ... steps, those of the binary digits of that number, so the rounds grow
    with the logarithm of the depth, and no task holds a path.
    """
    ok = durable(resolved.where("state = 'ok'").select("id", "depth"), label)
    jump = nodes.where("parent is not null").join(ok.select("id"), "id", "left_semi").select(F.col("id").alias("from"), F.col("parent").alias("to"))
    jump = durable(jump, label)
    leaves = ok.where("depth > 0").join(jump.select(F.col("to").alias("id")), "id", "left_anti")
    rows = leaves.select(F.col("id").alias("leaf"), "depth", F.col("id").alias("at"), F.explode(F.sequence(F.lit(0).cast("long"), "depth")).alias("up"))
    step, deepest = 1, ok.agg(F.max("depth")).first()[0] or 0
    while step <= deepest:
        on = F.col("up").bitwiseAND(F.lit(step)) != 0
        moved = rows.where(on).join(jump, F.col("at") == F.col("from")).select("leaf", "depth", F.col("to").alias("at"), "up")
        rows = durable(rows.where(~on).unionByName(moved), label)
        step *= 2
        if step <= deepest:
            far = jump.select(F.col("from").alias("to"), F.col("to").alias("far"))
            jump = durable(jump.join(far, "to").select("from", F.col("far").alias("to")), label)
    return rows.select("leaf", (F.col("depth") - F.col("up")).alias("place"), F.col("at").alias("id"))


def components(nodes: DataFrame, edges: DataFrame, label: str = "components", max_rounds: int = 64) -> DataFrame:
    """(id, root): the smallest id each node is connected to. nodes: id; edges: a, b, ids of nodes, in any order.

    Each round a node takes the smallest of its pointer's pointer and those of its neighbours, so pointers jump twice
    as far every round, and the rounds grow with the logarithm of the longest chain. Only nodes with edges take part;
    nothing but whether anything moved comes to the driver.
    """
    both = edges.where("a != b").select(F.col("a").alias("u"), F.col("b").alias("v"))
    ends = durable(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), label)
    point = durable(ends.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("v")).select("id", F.least("id", "v").alias("root")), label)
    for _ in range(max_rounds):
        up = point.select(F.col("id").alias("up"), F.col("root").alias("far"))
        jumped = point.join(up, point["root"] == up["up"]).select("id", "root", "far")
        near = ends.join(jumped.select(F.col("id").alias("v"), "far"), "v").groupBy(F.col("u").alias("id")).agg(F.min("far").alias("near"))
        step = jumped.join(near, "id").select("id", F.least("far", "near").alias("root"), (F.least("far", "near") != F.col("root")).alias("moved"))
        moved, n = durable_count(step, label, "moved")
        point = moved.select("id", "root")
        if not n:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    release(nodes.sparkSession)
    return nodes.select("id").distinct().join(point, "id", "left").select("id", F.coalesce("root", "id").alias("root"))
