"""The graph of typed edges (src, key, ord, dst) between pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.session import cut

#: The edge keys, in their order.
EDGE_KEYS = ("raw_source", "supersedes", "refines", "contradicts", "example-of", "source", "related")

#: By shape of a question the edge that answers it and the way to follow it.
QUESTIONS = {
    "what it refines": ("refines", "out"),
    "what refines it": ("refines", "in"),
    "what superseded it": ("supersedes", "in"),
    "what it supersedes": ("supersedes", "out"),
    "what contradicts it": ("contradicts", "in"),
    "examples of it": ("example-of", "in"),
    "what it is an example of": ("example-of", "out"),
    "what it draws on": ("source", "out"),
    "what uses it": ("source", "in"),
    "what is related to it": ("related", "both"),
}
#: The shape that is answered by a path, source and then raw_source, each outbound.
EVIDENCE = "what the evidence for it is"


def answers(seeds: DataFrame, edges: DataFrame, question: str, hops: int = 1, budget: int | None = None) -> DataFrame:
    """G-06: (seed, page_ref, hop) by the edge of a question's shape; all typed edges but
    ``source``, both ways, for a shape that isn't among QUESTIONS.  EVIDENCE: the pages a page
    draws on (hop 1) and the raw files these stand for (hop 2)."""
    if question == EVIDENCE:
        return _evidence(seeds, edges, budget)
    key, way = QUESTIONS.get(question, (None, "both"))
    return neighbours(seeds, edges, hops, (key,) if key else None, way, budget)


def _evidence(seeds: DataFrame, edges: DataFrame, budget: int | None) -> DataFrame:
    def out(of: DataFrame, key: str, hop: int) -> DataFrame:
        some = edges.where(F.col("key") == key).select("src", "dst")
        return of.join(some, of["page_ref"] == some["src"]).select("seed", F.col("dst").alias("page_ref"), F.lit(hop).alias("hop")).distinct()

    own = seeds.select("seed", F.col("seed").alias("page_ref"), F.lit(0).alias("hop")).distinct()
    drawn = out(own, "source", 1)
    return _least(own.union(drawn).union(out(drawn, "raw_source", 2)), budget)


def _least(found: DataFrame, budget: int | None) -> DataFrame:
    """The least hop of each; of each seed the first ``budget`` by hop and ref."""
    least = found.groupBy("seed", "page_ref").agg(F.min("hop").alias("hop"))
    if budget is None:
        return least
    place = F.row_number().over(Window.partitionBy("seed").orderBy("hop", "page_ref"))
    return least.withColumn("place", place).where(F.col("place") <= budget).drop("place")


def inverted(edges: DataFrame, key: str = "supersedes") -> DataFrame:
    """G-01, G-02: (dst, all_sources, first_source) of a key; self edges don't count (Q-08)."""
    some = edges.where((F.col("key") == key) & (F.col("src") != F.col("dst")))
    return some.groupBy("dst").agg(F.sort_array(F.collect_set("src")).alias("all_sources"), F.min("src").alias("first_source"))


def with_superseded_by(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """J-04: the pages with ``superseded_by``; targets that are no pages are left out."""
    first = inverted(edges).select(F.col("dst").alias("page_ref"), F.col("first_source").alias("superseded_by"))
    return pages.drop("superseded_by").join(first, "page_ref", "left")


def chains(seeds: DataFrame, successors: DataFrame, most: int = 64) -> DataFrame:
    """G-04, G-05: (seed, active, hops) by following (src, nxt), a row for each src.

    Pointer doubling: each round follows twice as far, so a chain of n pages takes
    log n joins.  A cycle ends at the page before the one that would repeat; an
    unknown seed is its own end.  ``most``: rounds for cycles, bounded by the doubling.
    """
    step = successors.where("src <> nxt").groupBy("src").agg(F.min("nxt").alias("nxt"))
    jump = step.select("src", F.col("nxt").alias("at"), F.lit(1).cast("long").alias("hops"))
    for _ in range(most):
        nxt = jump.select(F.col("src").alias("m"), F.col("at").alias("at2"), F.col("hops").alias("hops2"))
        goes_on = F.col("m").isNotNull() & (F.col("hops") < 1 << 20)
        moved = cut(jump.join(nxt, jump["at"] == nxt["m"], "left").withColumn("goes_on", goes_on))
        if not moved.where("goes_on").take(1):
            break
        further = F.when(F.col("goes_on"), F.col("hops") + F.col("hops2")).otherwise(F.col("hops"))
        jump = moved.select("src", F.when(F.col("goes_on"), F.col("at2")).otherwise(F.col("at")).alias("at"), further.alias("hops"))
    ended = jump.join(step.select(F.col("src").alias("more")), F.col("at") == F.col("more"), "left")
    known = ended.where("more IS NULL").select("src", "at", "hops")
    # Pages whose chain runs into a cycle never reach an end: their chains are gathered.
    cyclic = cut(ended.where("more IS NOT NULL").select(F.col("src").alias("seed")))
    if cyclic.take(1):
        around = paths(cyclic, step.join(cyclic.select(F.col("seed").alias("src")), "src", "left_semi"))
        known = known.unionByName(around.select(F.col("seed").alias("src"), F.col("active").alias("at"), F.size("chain").cast("long").alias("hops")))
    return seeds.join(known, seeds["seed"] == known["src"], "left").select("seed", F.coalesce("at", "seed").alias("active"), F.coalesce("hops", F.lit(0)).cast("long").alias("hops"))


def paths(seeds: DataFrame, successors: DataFrame) -> DataFrame:
    """G-04: (seed, active, chain): the end of each seed's chain and the pages after the seed up
    to it, none for a current page, by following (src, nxt).  Equal seeds each have a row.

    Doubling: each round appends to a page's chain that of its last page, so n hops take log n
    joins.  A chain stops before the page that would repeat, and is whole once it has."""
    step = successors.where("src <> nxt").groupBy("src").agg(F.min("nxt").alias("nxt"))
    now = step.select("src", F.array("nxt").alias("chain"), F.lit(False).alias("whole"))
    while True:
        ahead = now.select(F.col("src").alias("m"), F.col("chain").alias("more"), F.col("whole").alias("then"))
        met = now.join(ahead, (F.element_at("chain", -1) == F.col("m")) & ~F.col("whole"), "left")
        met = met.select("src", F.concat("chain", F.coalesce("more", F.array().cast("array<string>"))).alias("chain"), (F.col("whole") | F.col("m").isNull() | F.col("then")).alias("whole"))
        repeats = F.size(F.array_distinct(F.concat(F.array("src"), "chain"))) <= F.size("chain")
        # The first page that stood before, at the seed or in the chain.
        first = F.expr("array_min(filter(sequence(1, size(chain)), i -> chain[i - 1] = src OR array_position(chain, chain[i - 1]) < i))")
        met = met.withColumn("repeats", repeats)
        now = cut(met.select("src", F.when(F.col("repeats"), F.slice("chain", F.lit(1), first - 1)).otherwise(F.col("chain")).alias("chain"), (F.col("whole") | F.col("repeats")).alias("whole")))
        if not now.where("NOT whole").take(1):
            break
    own = seeds.select("seed").join(now, F.col("seed") == F.col("src"), "left")
    chain = F.coalesce("chain", F.array().cast("array<string>"))
    return own.select("seed", F.coalesce(F.get(chain, F.size(chain) - 1), "seed").alias("active"), chain.alias("chain"))


def current(pages: DataFrame, resolved: DataFrame) -> DataFrame:
    """G-09: each page replaced by the active end of its chain, each end once."""
    return pages.select(F.col("page_ref").alias("seed")).join(resolved, "seed").select(F.col("active").alias("page_ref")).distinct()


def neighbours(seeds: DataFrame, edges: DataFrame, hops: int = 2, keys: tuple[str, ...] | None = None, direction: str = "both", budget: int | None = None) -> DataFrame:
    """G-06, G-07: (seed, page_ref, hop) within ``hops``, the least hop of each.

    By default all keys but ``source``, both ways; ``budget``: at most so many pages of each
    seed, nearer ones first, then by ref."""
    keys = keys or tuple(k for k in EDGE_KEYS if k != "source")
    some = edges.where(F.col("key").isin(*keys))
    out, back = some.select(F.col("src").alias("a"), F.col("dst").alias("b")), some.select(F.col("dst").alias("a"), F.col("src").alias("b"))
    ways = {"out": out, "in": back, "both": out.union(back)}[direction].distinct()
    found = seeds.select("seed", F.col("seed").alias("page_ref"), F.lit(0).alias("hop"))
    last = found
    for hop in range(1, hops + 1):
        last = last.join(ways, last["page_ref"] == ways["a"]).select("seed", F.col("b").alias("page_ref"), F.lit(hop).alias("hop")).distinct()
        found = found.union(last)
    return _least(found, budget)


def provenance(edges: DataFrame) -> DataFrame:
    """G-08: (page_ref, stub, raw): page, its source stub, and the raw file of that."""
    source = edges.where("key = 'source'").select(F.col("src").alias("page_ref"), F.col("dst").alias("stub"))
    raw = edges.where("key = 'raw_source'").select(F.col("src").alias("stub"), F.col("dst").alias("raw"))
    return source.join(raw, "stub").select("page_ref", "stub", "raw")


def evidence_gaps(staged: DataFrame, edges: DataFrame) -> DataFrame:
    """G-10, I-08: (raw, page_ref, problem) for pages staged with a raw file (raw, page_ref).

    One of the raw file's staged pages must be its stub, a page in ``wiki/sources``
    whose raw_source it is; every other one needs a source edge to the stub."""
    raws = edges.where("key = 'raw_source'").select(F.col("src").alias("s"), F.col("dst").alias("r"))
    is_stub = (F.col("page_ref") == F.col("s")) & (F.col("raw") == F.col("r")) & F.col("page_ref").startswith("wiki/sources/")
    stubs = staged.join(raws, is_stub).groupBy("raw").agg(F.min("page_ref").alias("stub"))
    met = staged.join(stubs, "raw", "left")
    none = met.where("stub IS NULL").groupBy("raw").agg(F.min("page_ref").alias("page_ref")).select("raw", "page_ref", F.lit("no source stub").alias("problem"))
    cited = edges.where("key = 'source'").select(F.col("src").alias("page_ref"), F.col("dst").alias("stub"))
    lacking = met.where("stub IS NOT NULL AND page_ref <> stub").join(cited, ["page_ref", "stub"], "left_anti")
    return none.unionByName(lacking.select("raw", "page_ref", F.lit("no source edge").alias("problem")))


def dangling(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """J-09: edges whose target is no page."""
    return edges.join(pages.select(F.col("page_ref").alias("dst")), "dst", "left_anti")
