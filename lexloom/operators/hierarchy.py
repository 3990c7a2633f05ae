"""Parent-child rows to full hierarchies by parallel tree contraction.

Every pass rakes all leaves and splices out an independent set of unary-chain nodes, so trees of any depth shrink by a
constant share per pass and no task ever walks a chain. A raked leaf hands the size of its subtree to its parent. What
is left below ``REST`` nodes is contracted at once in one task. The recorded contractions are then reversed by pointer
doubling: every removed node points to the node it was attached to, and a few self-joins lead all of them to a root.
What contraction cannot remove is a core of self-loops, the remains of cycles; nodes attached to a core have no root.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.runtime import cut, latest

MAX_PASSES = 400  # a safety net: expected passes are O(log n)
REST = 50_000  # so few nodes are contracted in one task
STRETCH = 64  # nodes of a path built there; longer paths are joined from such stretches
NO_SCOPE = "\u0000"  # stands for a null scope

_ACTIVE = "scope string, id string, parent string, w long, seg array<string>, acc long, extra long"
_GONE = "scope string, id string, to string, w long, seg array<string>, size long, down string, add long"
_SOLVED = "what string, scope string, id string, to string, w long, seg array<string>, size long, extra long"


def bare_number(value: Column) -> Column:
    """The bare number in an untidy id: other characters around it and leading zeros mean nothing; null without digits."""
    digits = F.regexp_extract(value, r"(\d+)", 1)
    return F.when(digits != "", F.regexp_replace(digits, r"^0+(?=\d)", ""))


def _open() -> Column:
    """Whether a node can still be contracted: neither a root nor a loop of itself."""
    return F.coalesce(F.col("parent") != F.col("id"), F.lit(False))


def _pass(active: DataFrame, step: int) -> tuple[DataFrame, DataFrame]:
    """One pass over the active nodes: (removals, nodes still active)."""
    heads = (F.xxhash64("scope", "id", F.lit(step)) % 2) == 0
    zero = F.lit(0).cast("long")
    fan = active.where(_open()).groupBy("scope", F.col("parent").alias("id")).agg(F.count("*").alias("kids"))
    sized = active.join(fan, ["scope", "id"], "left").withColumn("kids", F.coalesce("kids", zero))
    # a parent whose only child is an inner "tails" node may be spliced out if it shows "heads" itself
    below = (
        sized.where(_open()).groupBy("scope", F.col("parent").alias("id"))
        .agg(
            F.min((F.col("kids") > 0) & ~heads).alias("stays"), F.sum(F.when(F.col("kids") == 0, F.col("acc") + F.col("extra"))).alias("gain"),
            F.min("id").alias("down"), F.min("extra").alias("down_extra"),
        )
    )
    fate = F.when(~_open(), "keep").when(F.col("kids") == 0, "rake").when((F.col("kids") == 1) & F.col("stays") & heads, "splice").otherwise("keep")
    marked = cut(sized.join(below, ["scope", "id"], "left").withColumn("acc", F.col("acc") + F.coalesce("gain", zero)).withColumn("fate", fate))
    spliced = F.col("fate") == "splice"
    gone = marked.where("fate <> 'keep'").select(
        "scope", "id", F.col("parent").alias("to"), "w", "seg", F.when(~spliced, F.col("acc")).alias("size"),
        F.when(spliced, F.col("down")).alias("down"), F.when(spliced, F.col("acc") + F.col("down_extra")).alias("add"),
    )
    up = marked.where(spliced).select(
        "scope", F.col("id").alias("parent"), F.col("parent").alias("up"), F.col("w").alias("up_w"), F.col("seg").alias("up_seg"), (F.col("acc") + F.col("extra")).alias("up_extra")
    )
    hit = F.col("up").isNotNull()
    kept = marked.where("fate = 'keep'").join(up, ["scope", "parent"], "left")
    return gone, kept.select(
        "scope", "id", F.when(hit, F.col("up")).otherwise(F.col("parent")).alias("parent"), (F.col("w") + F.coalesce("up_w", zero)).alias("w"),
        F.when(hit, F.concat("up_seg", F.array("parent"), "seg")).otherwise(F.col("seg")).alias("seg"), "acc", (F.col("extra") + F.coalesce("up_extra", zero)).alias("extra"),
    )


def contract_rest(rows: list[tuple], with_paths: bool) -> list[tuple]:
    """The open nodes that are left, raked leaf by leaf and replayed backwards. Rows are those of ``_ACTIVE``.

    Returns ("gone", ...) for removed nodes with what they hang on: a node outside the rest, the core of their loop or,
    in long paths, a node further up; ("core", ...) for a loop's core; ("gain", ...) for what a node outside gains in size.
    """
    at = {(r[0], r[1]): i for i, r in enumerate(rows)}
    up = [at.get((r[0], r[2]), -1) for r in rows]
    total = [r[5] for r in rows]
    kids = [0] * len(rows)
    for p in up:
        if p >= 0:
            kids[p] += 1
    ready = [i for i, k in enumerate(kids) if not k]
    order: list[int] = []
    gains: dict[tuple, int] = {}
    while ready:
        i = ready.pop()
        order.append(i)
        p, grown = up[i], total[i] + rows[i][6]
        if p < 0:
            key = (rows[i][0], rows[i][2])
            gains[key] = gains.get(key, 0) + grown
            continue
        total[p] += grown
        kids[p] -= 1
        if not kids[p]:
            ready.append(p)
    out = [("gain", s, t, None, None, None, g, None) for (s, t), g in gains.items()]
    hangs: dict[int, tuple[str, int, list[str], int]] = {}  # node -> what it hangs on, distance, nodes between, nodes since
    sizes: dict[int, int] = {}
    seen = set(order)
    for i in range(len(rows)):
        if i in seen:
            continue
        loop = [i]
        while up[loop[-1]] != i:
            loop.append(up[loop[-1]])
        core = min(range(len(loop)), key=lambda k: rows[loop[k]][1])
        loop = loop[core:] + loop[:core]  # the core, its parent, and so on up
        seen.update(loop)
        core, *others = loop
        extra = sum(total[k] + rows[k][6] for k in others) + rows[core][6]
        hook, far, ring = (rows[core][1], 0, [], 0), 0, []
        for k in reversed(others):  # from the one below the core down to the core's parent
            to, above, between, n = hook
            hangs[k] = (to, above + rows[k][3], [*between, *rows[k][4]] if with_paths else [], n + 1)
            hook = (rows[k][1], 0, [], 0) if with_paths and n + 1 >= STRETCH else (to, hangs[k][1], [*hangs[k][2], rows[k][1]] if with_paths else [], n + 1)
            far += rows[k][3]
            ring += [*rows[k][4], rows[k][1]] if with_paths else []
            sizes[k] = total[core] + extra
        out.append(("core", rows[core][0], rows[core][1], rows[core][1], far + rows[core][3], [*ring, *rows[core][4]] if with_paths else [], total[core], extra))
        hangs[core] = (rows[core][1], 0, [], 0)
        sizes[core] = -1
    for i in reversed(order):
        p, own = up[i], rows[i]
        if p < 0:
            hangs[i] = (own[2], own[3], own[4], 1)
        elif sizes.get(p) == -1 or hangs[p][3] >= STRETCH and with_paths:
            hangs[i] = (rows[p][1], own[3], own[4], 1)
        else:
            to, far, between, n = hangs[p]
            hangs[i] = (to, far + own[3], [*between, rows[p][1], *own[4]] if with_paths else [], n + 1)
    out += [("gone", rows[i][0], rows[i][1], to, far, between, sizes.get(i, total[i]), None) for i, (to, far, between, _) in hangs.items() if sizes.get(i) != -1]
    return out


def _contract(edges: DataFrame, with_paths: bool, rest: int) -> tuple[DataFrame, DataFrame]:
    """``edges``: scope, id, parent (null for roots). Returns all removals, and the surviving roots and loop cores.

    ``seg`` of a core holds the other nodes of its loop, from the one below the core down to the core's parent; ``acc``
    of a root and ``acc + extra`` of a core is the size of all below it, itself included.
    """
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    active = edges.select("scope", "id", "parent", one.alias("w"), F.array().cast("array<string>").alias("seg"), one.alias("acc"), none.alias("extra"))
    removed: list[DataFrame] = []
    for step in range(MAX_PASSES):
        left = active.where(_open()).count()
        if left <= rest or not left:
            break
        gone, active = _pass(active, step)
        if not with_paths:
            active = active.withColumn("seg", F.array().cast("array<string>"))
        removed.append(gone)
        active = cut(active)
    else:
        raise RuntimeError("tree contraction did not converge")

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [tuple(r) for b in batches for r in b.itertuples(index=False)]
        found = contract_rest([(*r[:4], list(r[4]), *r[5:]) for r in rows], with_paths)
        yield pd.DataFrame(found, columns=["what", "scope", "id", "to", "w", "seg", "size", "extra"]).astype({c: "Int64" for c in ("w", "size", "extra")})

    solved = cut(active.where(_open()).repartition(1).mapInPandas(solve, _SOLVED)) if left else None
    settled = active.where(~_open())
    if solved is not None:
        gains = solved.where("what = 'gain'").select("scope", "id", F.col("size").alias("gain"))
        settled = settled.join(gains, ["scope", "id"], "left").withColumn("acc", F.col("acc") + F.coalesce("gain", none)).drop("gain")
        cores = solved.where("what = 'core'").select("scope", "id", F.col("to").alias("parent"), "w", "seg", F.col("size").alias("acc"), "extra")
        settled = settled.unionByName(cores)
        nothing = F.lit(None)
        removed.append(solved.where("what = 'gone'").select("scope", "id", "to", "w", "seg", "size", nothing.cast("string").alias("down"), nothing.cast("long").alias("add")))
    spark = edges.sparkSession
    return reduce(DataFrame.unionByName, removed, spark.createDataFrame([], _GONE)), cut(settled)


def _attach(removed: DataFrame, core: DataFrame, with_paths: bool) -> DataFrame:
    """Every removed node with the root or core it ends at: pointer doubling over the recorded attachments."""
    ends = core.select("scope", F.col("id").alias("to"), F.lit(True).alias("settled"))
    links = cut(removed.select("scope", "id", "to", "w", "seg").join(ends, ["scope", "to"], "left").withColumn("settled", F.coalesce("settled", F.lit(False))))
    done, loose = links.where("settled"), links.where("not settled")
    for _ in range(MAX_PASSES):
        if loose.isEmpty():
            return done
        above = done.unionByName(loose).select("scope", F.col("id").alias("to"), F.col("to").alias("_to"), F.col("w").alias("_w"), F.col("seg").alias("_seg"), F.col("settled").alias("_settled"))
        path = F.concat("_seg", F.array("to"), "seg") if with_paths else F.col("seg")
        step = cut(loose.join(above, ["scope", "to"]).select("scope", "id", F.col("_to").alias("to"), (F.col("w") + F.col("_w")).alias("w"), path.alias("seg"), F.col("_settled").alias("settled")))
        done, loose = done.unionByName(step.where("settled")), step.where("not settled")
    raise RuntimeError("attachments did not end")


def _sizes(removed: DataFrame, core: DataFrame) -> DataFrame:
    """(scope, id, size): nodes of every subtree, itself included; a spliced node adds to the node that was below it."""
    known = core.select("scope", "id", "acc").withColumnRenamed("acc", "size")
    done = removed.where("size is not null").select("scope", "id", "size").unionByName(known)
    loose = cut(removed.where("size is null").select("scope", "id", "down", "add"))
    for _ in range(MAX_PASSES):
        if loose.isEmpty():
            return done
        none = F.lit(None)
        below = done.select("scope", F.col("id").alias("down"), "size", none.cast("string").alias("_down"), none.cast("long").alias("_add")).unionByName(
            loose.select("scope", F.col("id").alias("down"), none.cast("long").alias("size"), F.col("down").alias("_down"), F.col("add").alias("_add"))
        )
        step = cut(loose.join(below, ["scope", "down"]).select("scope", "id", F.col("_down").alias("down"), (F.col("add") + F.coalesce("_add", F.lit(0))).alias("add"), (F.col("add") + F.col("size")).alias("size")))
        done, loose = done.unionByName(step.where("size is not null").select("scope", "id", "size")), step.where("size is null").select("scope", "id", "down", "add")
    raise RuntimeError("sizes did not end")


def _edges(df: DataFrame, scope: str, node: str, parent: str, order: str) -> DataFrame:
    """Every node once with the parent it has in its scope: scope, id, parent."""
    rows = df.select(
        F.coalesce(F.col(f"`{scope}`").cast("string"), F.lit(NO_SCOPE)).alias("scope"),
        bare_number(F.col(f"`{node}`")).alias("id"),
        bare_number(F.col(f"`{parent}`")).alias("parent"),
        F.col(f"`{order}`").alias("at"),
    ).where("id is not null")
    rows = cut(latest(rows, ["scope", "id"], "at").drop("at"))
    known = rows.select("scope", F.col("id").alias("parent"), F.lit(True).alias("known"))
    return cut(rows.join(known, ["scope", "parent"], "left").select("scope", "id", F.when(F.col("known"), F.col("parent")).alias("parent")))


def _given_scope() -> Column:
    return F.when(F.col("scope") != NO_SCOPE, F.col("scope"))


def _placed(removed: DataFrame, core: DataFrame, with_paths: bool) -> DataFrame:
    """All nodes: scope, id, end (root or core), depth below it, path from it, in_cycle."""
    ends = core.select("scope", F.col("id").alias("to"), F.col("parent").isNotNull().alias("in_cycle"))
    own = ends.select("scope", F.col("to").alias("id"), F.col("to").alias("end"), F.lit(0).cast("long").alias("depth"), F.array("to").alias("path"), "in_cycle")
    hung = _attach(removed, core, with_paths).join(ends, ["scope", "to"])
    path = F.concat(F.array("to"), "seg", F.array("id")) if with_paths else F.array("id")
    return own.unionByName(hung.select("scope", "id", F.col("to").alias("end"), F.col("w").alias("depth"), path.alias("path"), "in_cycle"))


def hierarchy(df: DataFrame, scope: str, node: str, parent: str, order: str, with_paths: bool = True, rest: int = REST) -> DataFrame:
    """Root, depth, path and number of descendants of every node of the forests in ``df``.

    ``scope`` limits ids (they are unique within it); ``order`` picks the last of several deliveries of a node.
    Returns one row per (scope, node): ``root``, ``depth`` (0 at a root), ``path`` (ids from the root down to the
    node), ``in_cycle``, ``n_descendants``; without ``with_paths`` neither path nor number. ``rest`` is the number of
    nodes contracted in one task.

    Defined cases: a null, empty or non-existent parent ends the chain, so the node is a root; a node on a loop or
    leading into one has null root, depth and path, and ``in_cycle``; on a loop all other nodes of the loop and all
    that hangs off it are descendants (``all_descendants`` lists them); ids without any digit form no node and give no
    row; repeated rows count once (the last by ``order``); a null scope is a scope of its own; an empty table gives
    an empty result; extra columns are ignored whatever their names.
    """
    removed, core = _contract(_edges(df, scope, node, parent, order), with_paths, rest)
    placed = _placed(removed, core, with_paths)
    rooted = ~F.col("in_cycle")
    done = placed.select(
        "scope", "id", F.when(rooted, F.col("end")).alias("root"), F.when(rooted, F.col("depth")).alias("depth"), F.when(rooted, F.col("path")).alias("path"), "in_cycle"
    )
    if not with_paths:
        return done.drop("path").withColumn("scope", _given_scope()).withColumnsRenamed({"scope": scope, "id": node})
    loops = core.where("parent is not null").select("scope", F.explode(F.concat(F.array("id"), "seg")).alias("id"), (F.col("acc") + F.col("extra")).alias("whole"))
    sizes = _sizes(removed, core).join(loops, ["scope", "id"], "left").select("scope", "id", (F.coalesce("whole", "size") - 1).alias("n_descendants"))
    return done.join(sizes, ["scope", "id"]).withColumn("scope", _given_scope()).withColumnsRenamed({"scope": scope, "id": node})


def all_descendants(df: DataFrame, scope: str, node: str, parent: str, order: str, rest: int = REST) -> DataFrame:
    """All descendants of every node, on and below loops too: one row per (scope, node, descendant) with ``distance``.

    ``distance`` is the least number of steps up from the descendant to the node. On a loop every node is a
    descendant of all others, and whatever hangs off the loop is a descendant of all its nodes; no node is its own
    descendant. Ids, deliveries and scopes are taken as in ``hierarchy``.
    """
    removed, core = _contract(_edges(df, scope, node, parent, order), True, rest)
    done = _placed(removed, core, True)
    loops = core.where("parent is not null").select("scope", F.col("id").alias("end"), F.concat(F.array("id"), "seg").alias("_loop"))
    # up from the node: its path back to the core, then the part of the loop the path has not been through
    up = F.reverse(F.slice("path", 1, F.size("path") - 1))
    chains = done.where("not in_cycle").select("scope", "id", up.alias("up")).unionByName(
        done.where("in_cycle").join(loops, ["scope", "end"]).select("scope", "id", F.concat(up, F.reverse(F.array_except("_loop", "path"))).alias("up"))
    )
    pairs = chains.select("scope", F.col("id").alias("descendant"), F.posexplode("up").alias("at", "id"))
    return pairs.select(_given_scope().alias(scope), F.col("id").alias(node), "descendant", (F.col("at") + 1).cast("long").alias("distance"))
