"""Components of a similarity graph from posting lists, without writing out the pairs of a list.

A posting list holds items that may be similar. Only components are wanted, so a pair whose items are already
connected needs no check. Three rounds, each checking pairs across components only, end with every such pair of every
list checked:

1. each item against the pivot of its lists (the most central item) that it collides with most;
2. items not connected to their pivot: against their lists' other pivots, and for each component that pivots of their lists are in, against FAN
   members of it, from the shortest such list (the one whose members share the rarest token with the item). All items of a list meet the same
   members, so without signatures a list is compared as blocks: each set is sent once to a block of at most about BLOCK items, not once for each pair;
3. what is still apart: an exact set-similarity join of these items with all members of their lists, on the full sets. Elements are in
   order of rising frequency; a pair is made where two prefixes share an element, the sizes allow the similarity, and the elements
   that remain from there on could still reach the overlap (prefix, length and positional filters, which lose no similar pair).

Rounds 1 and 2 make a number of pairs linear in the postings, also for a list that holds a third of all items. In round 3 items that share a
common passage, but are not similar, differ in their rare elements, which stand first, and so make no pairs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles
from .common import arrow_map, cut, forget, sized
from .components import components

FAN = 16
#: Items of one list that are compared in one task with the list's FAN members; a longer list is dealt by a hash of the item.
BLOCK = 1024
#: Most candidate pairs that are broadcast (16 bytes each); beyond it the join shuffles.
BROADCAST_PAIRS = 500_000
SETS = "id long, set binary"


def _similar(batches, percent):
    for b in batches:
        ok = [shingles.similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(b["set_a"], b["set_b"])]
        yield pa.RecordBatch.from_pydict({"a": b["a"], "b": b["b"]}).filter(pa.array(ok, pa.bool_()))


def collisions(pairs: DataFrame, sigs: DataFrame | None, least: int) -> DataFrame:
    """(a, b, matches) of the pairs that agree in at least `least` coordinates of their signatures, or without signatures in so many lists."""
    if sigs is None:
        return pairs.groupBy("a", "b").agg(F.count("*").alias("matches")).where(F.col("matches") >= least)
    pairs = pairs.distinct()
    one, two = sigs.select(F.col("id").alias("a"), F.col("sig").alias("x")), sigs.select(F.col("id").alias("b"), F.col("sig").alias("y"))
    same = F.aggregate(F.zip_with("x", "y", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, v: s + v)
    return pairs.join(one, "a").join(two, "b").select("a", "b", same.alias("matches")).where(F.col("matches") >= least)


def verified(pairs: DataFrame, sets: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity. sets: from a table of id to (id, set)."""
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    full = cut(sets(ids), "sets")
    right = full.join(sized(pairs.select("a", F.col("b").alias("id")), BROADCAST_PAIRS), "id").select("a", F.col("id").alias("b"), F.col("set").alias("set_b"))
    both = right.join(full.join(sized(pairs.select(F.col("a").alias("id")).distinct(), BROADCAST_PAIRS), "id", "left_semi").select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a")
    out = cut(arrow_map(both, partial(_similar, percent=percent), "a long, b long"), "verified")
    forget(ids, full)
    return out


def _blocked(table, percent):
    """The similar pairs of one block's members and items."""
    kind = table["member"].to_pylist()
    rows = [(i, np.frombuffer(x.as_buffer(), np.uint64)) for i, x in zip(table["id"].to_pylist(), table["set"])]
    members = [r for r, m in zip(rows, kind) if m]
    found = [(a, b) for (b, y), m in zip(rows, kind) if not m for a, x in members if a != b and shingles.similar(x, y, percent)]
    return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})


def _in_blocks(items: DataFrame, members: DataFrame, sets: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """The similar pairs (a, b) of items(token, size, b) and members(token, size, a) of the same list; size is the list's."""
    parts = F.ceil(F.col("size") / BLOCK).cast("int")
    rows = items.select("token", F.pmod(F.xxhash64("b"), parts).cast("int").alias("part"), F.col("b").alias("id"), F.lit(False).alias("member")).union(
        members.select("token", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.col("a").alias("id"), F.lit(True))
    )
    rows = cut(rows, "blocks")
    ids = cut(rows.select("id").distinct(), "ids")
    full = cut(sets(ids), "sets")
    out = cut(rows.join(full, "id").groupBy("token", "part").applyInArrow(partial(_blocked, percent=percent), "a long, b long"), "verified")
    forget(rows, ids, full)
    return out


def _elements(batches):
    for b in batches:
        ids, n, e = [], [], []
        for i, x in zip(b["id"].to_pylist(), b["set"]):
            v = np.frombuffer(x.as_buffer(), np.int64)
            ids.append(np.full(len(v), i, np.int64))
            n.append(np.full(len(v), len(v), np.int64))
            e.append(v)
        join = lambda c: pa.array(np.concatenate(c) if c else np.empty(0, np.int64))
        yield pa.RecordBatch.from_pydict({"id": join(ids), "n": join(n), "e": join(e)})


def _full_join(apart: DataFrame, members: DataFrame, sets: Callable[..., DataFrame], percent: int) -> DataFrame:
    """(a, b) with b in apart(b, c_b) and a in members(id, c), of different components, that the three filters do not rule out.

    sets takes a function of its batches and their schema, so that one Python worker makes the elements.
    """
    ids = cut(members.select("id").distinct(), "ids")
    elements = cut(sets(ids, _elements, "id long, n long, e long"), "elements")
    often = elements.groupBy("e").agg(F.count("*").alias("f")).where("f > 1")
    mine = elements.join(often, "e").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("f", "e"))).alias("x"))
    once = F.col("n") - F.size("x")  # elements that no other member has stand first
    size = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - once
    post = mine.where(size > 0).select("id", "n", once.alias("once"), F.posexplode(F.slice("x", F.lit(1), size.cast("int"))).alias("k", "x")).select("id", "n", F.col("x.e").alias("e"), (F.col("n") - F.col("once") - F.col("k")).alias("rest"))
    post = cut(post.join(members, "id"), "prefixes")
    one = post.select("e", F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("rest").alias("rest_a"), F.col("c").alias("c_a"))
    two = post.join(apart.select(F.col("b").alias("id")), "id", "left_semi").select("e", F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("rest").alias("rest_b"), F.col("c").alias("c_b"))
    fits = (
        (one["e"] == two["e"]) & (F.col("c_a") != F.col("c_b")) & (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
        & ((100 + percent) * F.least("rest_a", "rest_b") >= percent * (F.col("n_a") + F.col("n_b")))
    )
    out = cut(one.join(two, fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates")
    forget(ids, elements, post)
    return out


def link(posts: DataFrame, sigs: DataFrame | None, least: int, sets: Callable[..., DataFrame], percent: int = shingles.PERCENT, fan: int = FAN) -> DataFrame:
    """(id, component) of every item with a link. posts: (token, id, weight), a table; sigs: (id, sig), a table, or none."""
    lists = posts.groupBy("token").agg(F.count("*").alias("size"), F.max(F.struct("weight", (-F.col("id")).alias("back"))).alias("top")).where("size > 1")
    lists = cut(lists.select("token", "size", (-F.col("top.back")).alias("pivot")), "lists")
    posts = cut(posts.join(lists, "token").select("token", "size", "id", "pivot"), "posts")
    first = posts.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b"))
    first = cut(collisions(first, sigs, least), "collisions")
    best = cut(first.groupBy("b").agg(F.max(F.struct("matches", (-F.col("a")).alias("back"))).alias("top")).select((-F.col("top.back")).alias("a"), "b"), "best")
    links = verified(best, sets, percent)
    comp = _settled(links)
    for last in (False, True):
        of = lambda name: comp.select(F.col("id").alias(name), F.col("component").alias(f"c_{name}"))  # noqa: B023, E731
        state = posts.join(of("id"), "id", "left").join(of("pivot"), "pivot", "left").select("token", "size", "id", "pivot", F.coalesce("c_id", "id").alias("c"), F.coalesce("c_pivot", "pivot").alias("main"))
        apart = cut(state.where("c <> main").select("token", "size", "main", F.col("id").alias("b"), F.col("c").alias("c_b")), "apart")
        if apart.isEmpty():
            forget(apart)
            break
        tokens = apart.select("token").distinct()
        open_ = cut(state.join(tokens, "token", "left_semi"), "open")
        if last:
            pairs = cut(_full_join(apart.select("b", "c_b").distinct(), open_.select("id", "c").distinct(), sets, percent), "pairs")
        else:
            members = open_.where("c = main and id <> pivot").select("token", "size", F.col("id").alias("a"), F.xxhash64("id").alias("h"))
            short = apart.groupBy("b", "main").agg(F.min(F.struct("size", "token")).alias("s")).select("b", "s.size", "s.token")
            few = _few(members, fan)
            pivots = first.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b")
            if sigs is None:
                few = cut(few, "members")
                blocks = _in_blocks(short.join(few.select("token").distinct(), "token", "left_semi"), few, sets, percent)
                forget(few)
                pairs = cut(pivots, "pairs")
            else:
                blocks = None
                pairs = cut(collisions(short.join(few.drop("size"), "token").select("a", "b").union(pivots), sigs, least).select("a", "b"), "pairs")
        found, old, before = verified(pairs, sets, percent), links, comp
        more = [old, found] if last or blocks is None else [old, found, blocks]
        links = cut(reduce(DataFrame.union, more), "all-links")
        comp = _settled(links)
        forget(apart, open_, pairs, before, *more)
    forget(lists, posts, first, best, links)
    return comp


def _settled(links: DataFrame) -> DataFrame:
    """components() as a table of its own."""
    steps = components(links)
    comp = cut(steps, "components")
    forget(steps)
    return comp


def _few(members: DataFrame, fan: int) -> DataFrame:
    """Up to `fan` members of each token, by hash: the least of each of `fan` hash classes, combined on the map side."""
    slot = F.pmod(F.xxhash64("h"), F.lit(fan))
    return members.groupBy("token", "size", slot.alias("slot")).agg(F.min(F.struct("h", "a")).alias("m")).select("token", "size", F.col("m.a").alias("a"))
