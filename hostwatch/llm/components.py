"""Distributed union-find over an edge table, and candidates among sets that banding left
in different components."""

from __future__ import annotations

from math import log

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hostwatch.llm.common import discard, written

#: Similarity in percent, the ratio of a size class's ends, and members that make a bucket large.
PERCENT, STEP, FEW = 80, 1.06, 8
#: Elements before one that tell whether two sets have met already.
BACK = 4


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step.  Large: larger neighbours move to the least neighbour.  Small: the
    smaller neighbours do.  The minimum is pre-aggregated; the edges of a hub meet its one
    row in a join, whose hot partitions Spark splits."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    out = both.join(least, "a")
    if large:
        out = out.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = out.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of comparable ids to ``(id, component)``, component the least id.

    Alternating large and small stars until the edge set no longer changes.  Ids without
    an edge to another id aren't returned.  Nulls and self-loops are dropped.  Each round
    is written to the shared folder; nothing but two numbers a round reaches the driver.
    """
    edges = edges.where("a <> b").select("a", "b").distinct()
    before = None
    while True:
        edges = written(_star(_star(edges, True), False), "star")
        # Equal counts and checksums of the edge set in two rounds: a fixed point of both stars.
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
        if before:
            discard(last)
        before, last = now, edges


def hubs_of(members: DataFrame) -> DataFrame:
    """``(h, hub)`` of ``members(h, id, score)``: a bucket's member of the highest score, of
    equal ones the least id."""
    return members.groupBy("h").agg((F.bitwise_not(F.max(F.struct("score", F.bitwise_not("id").alias("id")))["id"])).alias("hub"))


def rehubbed(members: DataFrame, found: DataFrame, turn: int) -> DataFrame:
    """Pairs ``(a, b)``, at most one a member, of members of large buckets and a bucket's hub of this
    turn, where ``found`` has them in different components.  Any member may be the hub, another one
    each turn; buckets of the same members have the same."""
    named = members.join(found, "id", "left").select("h", "id", F.coalesce("component", "id").alias("c"))
    hub = F.min(F.struct(F.xxhash64(F.lit(turn), "id").alias("r"), F.col("id").alias("hub"), F.col("c").alias("d"))).alias("of")
    mixed = named.groupBy("h").agg(F.count("*").alias("n"), F.min("c").alias("x"), F.max("c").alias("y"), hub).where((F.col("x") < F.col("y")) & (F.col("n") >= FEW))
    led = named.join(mixed.select("h", "of"), "h").where("c <> of.d")
    led = led.groupBy("id").agg(F.min("of").alias("of")).select("id", "of.hub")
    return led.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()


def unsettled(members: DataFrame, found: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """What ``found`` leaves open in buckets ``members(h, id)`` of several components.

    Pairs ``(a, b)`` across the components of buckets of fewer than ``FEW`` members, so fewer
    than FEW / 2 a row; and ``(id, c, g)``: the members of larger ones, with their components.
    g: components are of one group if larger buckets link them, in any number of steps.
    """
    named = members.join(found, "id", "left").select("h", "id", F.coalesce("component", "id").alias("c"))
    mixed = named.groupBy("h").agg(F.count("*").alias("n"), F.min("c").alias("x"), F.max("c").alias("y")).where("x < y").drop("y")
    rest = written(named.join(mixed, "h"), f"{name}-mixed")
    few = rest.where(F.col("n") < FEW).select("h", "id", "c")
    pairs = few.select("h", F.col("id").alias("i"), F.col("c").alias("c1")).join(few.select("h", F.col("id").alias("j"), F.col("c").alias("c2")), "h").where("c1 < c2")
    many = rest.where(F.col("n") >= FEW).select("id", "c", "x").distinct()
    groups = connected_components(many.select(F.col("c").alias("a"), F.col("x").alias("b")))
    named = many.select("id", "c").distinct().join(groups.withColumnsRenamed({"id": "c", "component": "g"}), "c", "left")
    return pairs.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).distinct(), written(named.select("id", "c", F.coalesce("g", "c").alias("g")), f"{name}-rest")


def prefix_meetings(members: DataFrame) -> DataFrame:
    """Pairs ``(a, b, n)`` of sets in different components of a group that may be similar; n: how
    much their overlap may exceed the least one, by the places where their prefixes meet.

    members: ``(id, c, g, s)``, a row an element.  Exact prefix filtering: with a group's
    elements in order of rising frequency, two sets whose similarity reaches PERCENT have an
    element in common among the first ``n - o + 1`` of each, n its size and o the least
    overlap that their sizes allow.  Counts and prefixes are written on the way, so that no
    more than one step's shuffle files stand at a time; ``members`` isn't read afterwards.  Elements that one component alone has count as places
    but meet nothing.  A set's prefix is dealt by the size class of the partner, so that
    sets of like size meet by few elements, and elements that a whole group has are reached
    only by sets that have hardly any others.  A pair meets no more by an element if one of the
    ``BACK`` before it in one set is one of those in the other: it has met by that, or by one before.
    """
    members = members.select("id", "c", F.xxhash64("g", "s").alias("s"))
    seen = members.groupBy("s").agg(F.count("*").alias("df"), F.min("c").alias("x"), F.max("c").alias("y"), F.bit_xor(F.xxhash64("id")).alias("who"))
    seen = written(seen.select("s", "df", "who", (F.col("x") < F.col("y")).alias("cross")), "element-counts")
    own = Window.partitionBy("id")
    order = own.orderBy("cross", "df", "who", "s")
    at = members.join(seen, "s").withColumns({"n": F.count("*").over(own), "pos": F.row_number().over(order), "before": F.lag(F.struct("df", "who")).over(order)})
    # Of elements that the very same sets have, which stand side by side in all of them, the first is enough.
    at = at.where(F.col("before").isNull() | (F.col("before") != F.struct("df", "who")))
    at = at.withColumns({f"q{i}": F.lag("s", i).over(order) for i in range(1, BACK + 1)})
    size_class = lambda n: F.floor(F.log(n) / log(STEP) + 1e-9).cast("int")
    least_size = lambda k: F.ceil(F.pow(F.lit(STEP), k) - 1e-6)  # noqa: E731  of a class
    need = lambda n, m: F.ceil(PERCENT * (n + m) / (100 + PERCENT) - 1e-9)
    n, pos, k = F.col("n"), F.col("pos"), F.col("k")
    at = at.where(F.col("cross") & (pos <= n - F.ceil(PERCENT * n / 100 - 1e-9) + 1)).withColumn("own", size_class(n))
    reach = F.sequence(size_class(F.greatest(F.floor(n * PERCENT / 100), F.lit(1))), size_class(F.ceil(n * 100 / PERCENT)))
    dealt = at.withColumn("k", F.explode(reach)).where(pos <= n - need(n, F.greatest(least_size(k), F.ceil(PERCENT * n / 100 - 1e-9))) + 1)
    dealt = dealt.select("s", F.least("own", "k").alias("k1"), F.greatest("own", "k").alias("k2"), "own", "k", "id", "c", "n", "pos", *(f"q{i}" for i in range(1, BACK + 1)))
    dealt = written(dealt, "prefixes")
    discard(seen)
    named = lambda own, **to: dealt.select("s", "k1", "k2", F.col(own).alias(f"o{to['n'][1]}"), *(F.col(c).alias(x) for c, x in to.items()), *(F.col(f"q{i}").alias(f"q{i}_{to['n'][1]}") for i in range(1, BACK + 1)))
    one, two = named("own", id="a", c="c1", n="n1", pos="p1"), named("k", id="b", c="c2", n="n2", pos="p2")
    o = need(F.col("n1"), F.col("n2"))
    meet = (F.col("c1") < F.col("c2")) & (F.col("o1") == F.col("o2")) & (F.col("p1") <= F.col("n1") - o + 1) & (F.col("p2") <= F.col("n2") - o + 1)
    for i in range(1, BACK + 1):
        for j in range(1, BACK + 1):
            meet &= ~F.col(f"q{i}_1").eqNullSafe(F.col(f"q{j}_2")) | F.col(f"q{i}_1").isNull()
    spare = F.least(F.col("n1") - F.col("p1"), F.col("n2") - F.col("p2")) + 1 - o
    return one.join(two, ["s", "k1", "k2"]).where(meet).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), spare.cast("long").alias("n"))


def prefix_pairs(members: DataFrame) -> DataFrame:
    """The pairs ``(a, b, n)`` of ``prefix_meetings``, each once, with its largest n."""
    return prefix_meetings(members).groupBy("a", "b").agg(F.max("n").alias("n"))


def likeliest(pairs: DataFrame) -> DataFrame:
    """Of ``pairs(a, b, n)`` two of each id, as far as it has them: that of the largest n, and any one."""
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    any_one = F.max(F.struct(F.xxhash64("a", "b"), "b"))["b"]
    best = both.groupBy("a").agg(F.array(F.max(F.struct("n", "b"))["b"], any_one).alias("bs")).select("a", F.explode("bs").alias("b"))
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def across(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """``pairs(a, b)`` whose ends ``found(id, component)`` doesn't put in one component."""
    of = lambda end, c: found.select(F.col("id").alias(end), F.col("component").alias(c))
    both = pairs.join(of("a", "__c"), "a", "left").join(of("b", "__d"), "b", "left")
    return both.where(F.coalesce("__c", "a") != F.coalesce("__d", "b")).select("a", "b")
