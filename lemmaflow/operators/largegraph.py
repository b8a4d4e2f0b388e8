"""Fixpoints of proof graphs of any size, as joins: closure, cycles, declared symbols.

graph.py folds over one row per proof, which suits proofs of a few nodes; here a graph is rows of nodes and edges, and
one graph may be the whole table. Every fixpoint is semi-naive: a round joins only what the last round found, and its
tables are written between rounds (sources/staging.py). Closure and declared symbols have nodes as 64-bit numbers, in tables dealt to buckets
once, so that only what a round finds is shuffled. A loop ends when a round finds nothing; rounds are as many as the
longest derivation (closure, declared), the longest path (peeling), or the logarithm of the nodes on cycles (witnesses).

  nodes       proof_id, id, node_type; blocked (boolean) if errors block some; declares (array) for symbols
  inferences  proof_id, id, deps, conclusion; blocked; declares
Rows without a proof_id or id are in no graph. Repeated rows count once; of rows with one id that differ, one blocked row blocks, one
source row is a source. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.text import symbols
from ..sources.staging import Stages
from .graph import SOURCE_TYPES

#: Edges of one node from which on they are dealt to SALTS parts (and the node to all of these) before a join.
HUB, SALTS = 50_000, 32
#: Edges of a graph up to which it is a row and its cycle found in one pass.
SMALL = 500


def column(df: DataFrame, name: str, default):
    return F.coalesce(name, default) if name in df.columns else default


def hubs_of(edges: DataFrame, hub: int, salts: int, on: list[str]) -> DataFrame:
    """The hubs (the columns on, of): nodes where more than hub edges start, and to how many parts these are dealt."""
    return edges.groupBy(*on).count().filter(F.col("count") > hub).select(*on, F.lit(salts).alias("of"))


def salted(edges: DataFrame, hubs: DataFrame, salts: int, on: list[str]) -> DataFrame:
    """edges (the columns on, k ...) with salt, by k for the edges of hubs and else 0."""
    return edges.join(hubs, on, "left").withColumn("salt", F.when(F.col("of").isNull(), 0).otherwise(F.pmod(F.hash("k"), F.lit(salts)))).drop("of")


def spread(frontier: DataFrame, hubs: DataFrame, on: list[str]) -> DataFrame:
    """The frontier (the columns on) with salt, hubs once for each part of their edges."""
    return frontier.join(hubs, on, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("of", F.lit(1)) - 1))).drop("of")


def dealt(edges: DataFrame, hub: int, salts: int) -> tuple[DataFrame, DataFrame]:
    """edges (proof_id, dep, k ...) with salt; and the hubs (proof_id, dep, of)."""
    hubs = hubs_of(edges, hub, salts, ["proof_id", "dep"])
    return salted(edges, hubs, salts, ["proof_id", "dep"]), hubs


def along(frontier: DataFrame, edges: DataFrame, hubs: DataFrame) -> DataFrame:
    """The edges that start in the frontier (proof_id, dep), the frontier's hubs meeting each part of their edges."""
    return spread(frontier, hubs, ["proof_id", "dep"]).join(edges, ["proof_id", "dep", "salt"])


def buckets(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def numbered(stages: Stages, nodes: DataFrame):
    """(h, proof_id, id, source, blocked of each node, in buckets by h; the function from proof_id and id to h).

    h is a 64-bit hash. Two nodes of one h would be taken for each other, so that is looked for, and then another hash is taken.
    """
    n = nodes.dropna(subset=["proof_id", "id"])
    for seed in range(9):
        number = lambda id_, seed=seed: F.xxhash64(F.lit(seed), "proof_id", id_)
        own = n.select(number("id").alias("h"), "proof_id", "id", F.coalesce(F.col("node_type").isin(SOURCE_TYPES), F.lit(False)).alias("source") if "node_type" in n.columns else F.lit(False).alias("source"), column(n, "blocked", F.lit(False)).alias("blocked"))
        own = own.repartition(buckets(n), "h").groupBy("h", "proof_id", "id").agg(F.bool_or("source").alias("source"), F.bool_or("blocked").alias("blocked"))
        known = stages.deal(f"nodes{seed}", own, "h")[1].drop("round")
        if known.groupBy("h").count().filter("count > 1").isEmpty():
            return known, number
    raise ValueError("nodes share a hash under every seed")


def numbered_edges(stages: Stages, edges: DataFrame, hub: int, salts: int) -> tuple[DataFrame, DataFrame]:
    """edges (dep, k ..., numbers) in buckets by dep and salt; and the hubs."""
    hubs = stages.put("hubs", hubs_of(edges, hub, salts, ["dep"]))
    parts = salted(edges, F.broadcast(hubs), salts, ["dep"]).repartition(buckets(edges), "dep", "salt")
    return stages.deal("edges", parts, "dep", "salt")[1].drop("round"), hubs


def onward(new: DataFrame, edges: DataFrame, hubs: DataFrame) -> DataFrame:
    """along(), from rows with h. Only the new rows move: edges lie in buckets, and a hash table is made of the new rows."""
    return spread(new.withColumnRenamed("h", "dep"), F.broadcast(hubs), ["dep"]).hint("shuffle_hash").join(edges, ["dep", "salt"]).drop("dep", "salt")


def rules(nodes: DataFrame, inferences: DataFrame) -> DataFrame:
    """proof_id, k, deps, conclusion of the inferences that may fire: unblocked, all ends there. k tells them apart."""
    known = nodes.select("proof_id", F.col("id").alias("dep")).distinct()
    i = inferences.filter(~column(inferences, "blocked", F.lit(False))).select("proof_id", "id", F.array_distinct(F.coalesce("deps", F.array().cast("array<string>"))).alias("deps"), "conclusion")
    i = i.withColumn("k", F.md5(F.to_json(F.struct("proof_id", "id", "deps", "conclusion")))).drop("id").distinct()
    i = i.join(known.withColumnRenamed("dep", "conclusion"), ["proof_id", "conclusion"], "left_semi")
    broken = i.select("proof_id", "k", F.explode("deps").alias("dep")).join(known, ["proof_id", "dep"], "left_anti").select("k").distinct()
    return i.join(broken, "k", "left_anti")


def reach(nodes: DataFrame, inferences: DataFrame, hub: int, salts: int) -> tuple[DataFrame, DataFrame]:
    """(known: the nodes as numbered() has them; reached: h, round), both in buckets by h.

    A round joins the newly reached nodes to the edges and writes how many deps of an inference that meets; with what was
    written for these inferences before, all of its deps are met or not. An end that no node has is never reached. So what moves
    over all rounds is each edge once, and edges, nodes and what is known stay in their buckets.
    """
    stages = Stages(nodes.sparkSession, "closure")
    known, number = numbered(stages, nodes)
    free = known.filter("not blocked")
    i = inferences.filter(~column(inferences, "blocked", F.lit(False))).dropna(subset=["proof_id", "conclusion"])
    i = i.select("proof_id", F.array_distinct(F.coalesce("deps", F.array().cast("array<string>"))).alias("deps"), number("conclusion").alias("conclusion"))
    edges = i.withColumn("k", F.monotonically_increasing_id()).select("proof_id", "k", "conclusion", F.size("deps").alias("n"), F.explode("deps").alias("dep")).dropna(subset=["dep"])
    edges, hubs = numbered_edges(stages, edges.select(number("dep").alias("dep"), "k", "conclusion", "n"), hub, salts)
    given = free.join(i.filter("size(deps) = 0").select(F.col("conclusion").alias("h")).distinct().hint("shuffle_hash"), "h").select("h")
    new, reached = stages.deal("reached", free.filter("source").select("h").unionByName(given).distinct(), "h")
    while not new.isEmpty():
        met = onward(new, edges, hubs).groupBy("k").agg(F.max("conclusion").alias("h"), F.max("n").alias("n"), F.count("*").alias("met"))
        met, all_met = stages.deal("met", met, "k")
        # Inferences with one dep fire when it is met; the others, when the deps met in all rounds are as many as they have.
        more = met.filter("met < n").select("k").hint("shuffle_hash").join(all_met, "k").groupBy("k").agg(F.max("h").alias("h"), F.max("n").alias("n"), F.sum("met").alias("met"))
        ends = met.filter("met = n").select("h").unionByName(more.filter("met = n").select("h")).distinct()
        ends = free.join(ends.hint("shuffle_hash"), "h").select("h")
        new, reached = stages.deal("reached", ends.hint("shuffle_hash").join(reached.select("h", "round"), "h", "left").filter("round is null").select("h"), "h")
    return known, reached


def closure(nodes: DataFrame, inferences: DataFrame, hub: int = HUB, salts: int = SALTS) -> tuple[DataFrame, DataFrame]:
    """(reached: proof_id, id, round; fired: proof_id, k, deps, conclusion): the nodes that unblocked sources derive and the
    inferences all of whose deps are reached. A blocked node is not reached, though an inference to it may have fired.
    """
    known, reached = reach(nodes, inferences, hub, salts)
    reached = known.join(reached, "h").select("proof_id", "id", "round")
    usable = rules(nodes, inferences)
    held = usable.select("proof_id", "k", F.explode("deps").alias("id")).join(reached, ["proof_id", "id"], "left_semi").groupBy("k").agg(F.count("*").alias("held"))
    return reached, usable.join(held, "k", "left").filter("coalesce(held, 0) = size(deps)").drop("held")


def closure_misses(nodes: DataFrame, inferences: DataFrame, hub: int = HUB, salts: int = SALTS) -> DataFrame:
    """proof_id, id of nodes, neither sources nor blocked, that nothing derives."""
    known, reached = reach(nodes, inferences, hub, salts)
    lost = known.filter("not source and not blocked")
    return lost.join(reached, "h", "left_anti").select("proof_id", "id")


def edges_of(inferences: DataFrame) -> DataFrame:
    """proof_id, u, v: an edge from each dep to the conclusion; repeated ones are not taken out."""
    return inferences.select("proof_id", F.explode("deps").alias("u"), F.col("conclusion").alias("v")).dropna()


def unpeeled(edges: DataFrame, hub: int = HUB, salts: int = SALTS, stages: Stages | None = None) -> DataFrame:
    """The edges (proof_id, u, v) between nodes that lie on cycles or on paths between cycles; empty if there is no cycle.

    Nodes without incoming edges are peeled off, which lowers the degrees of those behind them, until none is left; then the
    same against the edges' direction.
    """
    stages = stages or Stages(edges.sparkSession, "peel")
    rest = edges
    for side, (a, b) in enumerate((("u", "v"), ("v", "u"))):
        rest = stages.put(f"edges{side}", rest)
        salted, hubs = dealt(rest.select("proof_id", F.col(a).alias("dep"), F.col(b).alias("k")), hub, salts)
        salted, hubs = stages.put(f"salted{side}", salted), stages.put(f"hubs{side}", hubs)
        degree = stages.put(f"degree{side}", salted.groupBy("proof_id", F.col("k").alias("id")).agg(F.count("*").alias("n")))
        starts = salted.select("proof_id", F.col("dep").alias("id")).distinct().join(degree, ["proof_id", "id"], "left_anti")
        new, gone = stages.add(f"gone{side}", starts)
        while not new.isEmpty():
            less = along(new.withColumnRenamed("id", "dep"), salted, hubs).groupBy("proof_id", F.col("k").alias("id")).agg(F.count("*").alias("less"))
            lowered = degree.join(less, ["proof_id", "id"], "left").select("proof_id", "id", (F.col("n") - F.coalesce("less", F.lit(0))).alias("n"))
            lowered = stages.put(f"degree{side}", lowered)
            degree = lowered.filter("n > 0")
            new, gone = stages.add(f"gone{side}", lowered.filter("n = 0").select("proof_id", "id"))
        for end in ("u", "v"):
            rest = rest.join(gone.select("proof_id", F.col("id").alias(end)), ["proof_id", end], "left_anti")
    return rest.select("proof_id", "u", "v")


def witness_cycle(us: list, vs: list) -> list[tuple]:
    """(length, u, v) of the edges of one small graph's witness, as witness_cycles() defines it."""
    edges, size = set(zip(us, vs)), None
    while len(edges) != size:
        size, starts, ends = len(edges), {u for u, _ in edges}, {v for _, v in edges}
        edges = {(u, v) for u, v in edges if u in ends and v in starts}
    to: dict = {}
    for u, v in edges:
        to[v] = min(u, to.get(v, u))
    best, seen = None, set()
    for v in to:
        path: dict = {}
        while v not in seen:
            seen.add(v)
            path[v] = len(path)
            v = to[v]
        if v in path:
            cycle = [x for x, k in path.items() if k >= path[v]]
            best = min(best or (len(cycle), min(cycle), cycle), (len(cycle), min(cycle), cycle))
    return [(best[0], to[v], v) for v in best[2]] if best else []


def witness_cycles(edges: DataFrame, hub: int = HUB, salts: int = SALTS, small: int = SMALL) -> DataFrame:
    """proof_id, length, u, v: the edges of one cycle for each graph that has any. Repeated edges count once.

    Of the nodes that cannot be peeled off, each points to its smallest remaining predecessor, and following the pointers ends in
    cycles; of these, the shortest is the witness, that with the smallest node among equals. (A graph may
    have shorter cycles that no such pointers follow.) A cycle has an edge that does not lead to a greater node, so graphs without
    one are left out. Graphs of at most small edges are a row each, done in one pass; the others are done in rounds of joins:
    pointers are doubled, so rounds are the logarithm of the nodes.
    """
    stages = Stages(edges.sparkSession, "witness")
    sizes = edges.groupBy("proof_id").agg(F.count("*").alias("n"), F.bool_or(F.col("v") <= F.col("u")).alias("back"))
    sizes = stages.put("sizes", sizes.filter("back").select("proof_id", (F.col("n") <= small).alias("few")))
    few = edges.join(sizes.filter("few"), "proof_id").groupBy("proof_id").agg(F.collect_set(F.struct("u", "v")).alias("e")).select("proof_id", "e.u", "e.v")
    kinds = {f.name: f.dataType for f in edges.schema.fields}
    schema = StructType([StructField("proof_id", kinds["proof_id"]), StructField("length", LongType()), StructField("u", kinds["u"]), StructField("v", kinds["v"])])

    def found(batches):
        import pyarrow as pa

        for b in batches:
            rows = [(p, *r) for p, us, vs in zip(*(c.to_pylist() for c in b.columns)) for r in witness_cycle(us, vs)]
            types = [b.schema.types[0], pa.int64(), b.schema.types[1].value_type, b.schema.types[2].value_type]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["proof_id", "length", "u", "v"])

    done = few.mapInArrow(found, schema)
    if sizes.filter("not few").isEmpty():
        return done
    return done.unionByName(witnesses_in_rounds(edges.join(sizes.filter("not few"), "proof_id", "left_semi").select("proof_id", "u", "v").distinct(), hub, salts, stages))


def witnesses_in_rounds(edges: DataFrame, hub: int, salts: int, stages: Stages) -> DataFrame:
    rest = stages.put("rest", unpeeled(edges, hub, salts, stages))
    first = stages.put("first", rest.groupBy("proof_id", F.col("v").alias("id")).agg(F.min("u").alias("to")))
    most = first.groupBy("proof_id").count().agg(F.max("count")).first()[0] or 0
    # to: the node 2^r pointers away; low: the smallest of the 2^r nodes from id on.
    jump = stages.put("jump", first.withColumn("low", F.col("id")))
    for _ in range(max(most - 1, 0).bit_length()):
        far = jump.select("proof_id", F.col("id").alias("to"), F.col("to").alias("beyond"), F.col("low").alias("low2"))
        jump = stages.put("jump", jump.join(far, ["proof_id", "to"]).select("proof_id", "id", F.col("beyond").alias("to"), F.least("low", "low2").alias("low")))
    on = jump.select("proof_id", F.col("to").alias("id")).distinct().join(jump.select("proof_id", "id", "low"), ["proof_id", "id"])
    sizes = on.groupBy("proof_id", "low").agg(F.count("*").alias("length"))
    best = sizes.groupBy("proof_id").agg(F.min(F.struct("length", "low")).alias("b")).select("proof_id", "b.*")
    on = on.join(best, ["proof_id", "low"]).join(first, ["proof_id", "id"])
    return on.select("proof_id", "length", F.col("to").alias("u"), F.col("id").alias("v"))


def declared_sets(nodes: DataFrame, inferences: DataFrame, hub: int = HUB, salts: int = SALTS) -> DataFrame:
    """proof_id, id, symbols of the nodes that have any; see declared().

    Each round carries the symbols that are new at a node along its edges, as one array; edges, nodes and what is known stay in buckets.
    """
    stages = Stages(nodes.sparkSession, "declared")
    known, number = numbered(stages, nodes)
    flat = lambda c: F.array_distinct(F.flatten(F.collect_set(c)))
    clean = lambda df, c: F.array_distinct(F.array_compact(c)).alias("symbols")
    i = inferences.dropna(subset=["proof_id", "conclusion"]).select("proof_id", "deps", number("conclusion").alias("k"), column(inferences, "declares", F.array().cast("array<string>")).alias("declares"))
    edges = i.select("proof_id", "k", F.explode("deps").alias("dep")).dropna().select(number("dep").alias("dep"), "k")
    edges, hubs = numbered_edges(stages, edges, hub, salts)
    own = nodes.dropna(subset=["proof_id", "id"]).select(number("id").alias("h"), clean(nodes, "declares"))
    own = own.unionByName(i.select(F.col("k").alias("h"), clean(i, "declares"))).filter("size(symbols) > 0").groupBy("h").agg(flat("symbols").alias("found"))
    new, names = stages.deal("names", known.select("h").join(own.hint("shuffle_hash"), "h").select("h", F.col("found").alias("symbols")), "h")
    while not new.isEmpty():
        found = onward(new, edges, hubs).groupBy(F.col("k").alias("h")).agg(flat("symbols").alias("found"))
        found = known.select("h").join(found.hint("shuffle_hash"), "h")
        found = found.hint("shuffle_hash").join(names.select("h", "symbols"), "h", "left").groupBy("h", "found").agg(F.flatten(F.collect_list("symbols")).alias("had"))
        new, names = stages.deal("names", found.select("h", F.array_except("found", "had").alias("symbols")).filter("size(symbols) > 0"), "h")
    sets = names.groupBy("h").agg(F.flatten(F.collect_list("symbols")).alias("symbols"))
    return known.join(sets, "h").select("proof_id", "id", "symbols")


def declared(nodes: DataFrame, inferences: DataFrame, hub: int = HUB, salts: int = SALTS) -> DataFrame:
    """proof_id, id, symbol: what a node declares, what an inference to it declares, and what the deps of such an inference have."""
    return declared_sets(nodes, inferences, hub, salts).select("proof_id", "id", F.explode("symbols").alias("symbol"))


def undeclared(proofs: DataFrame, nodes: DataFrame, inferences: DataFrame, **sizes) -> DataFrame:
    """proof_id, kind, node_id, inference_id, label, symbol: each symbol that a formal text uses and nothing declares there.

    proofs: proof_id, goal_symbolic, base (array: the problem's variables and domain keys, known everywhere); nodes with claim_formal; inferences
    with instantiation (map). kind: goal (base counts), node (base and what is declared at the node), inference (base, its own declarations and
    those at its deps). label: goal, claim_formal, or the instantiation's key.
    """
    base = proofs.select("proof_id", F.explode("base").alias("symbol")).distinct()
    names = declared_sets(nodes, inferences, **sizes)
    none = F.lit(None).cast("string")
    strange = "symbols is null or not array_contains(symbols, symbol)"
    goals = proofs.select("proof_id", F.lit("goal").alias("kind"), none.alias("node_id"), none.alias("inference_id"), F.lit("goal").alias("label"), F.explode(symbols(F.coalesce("goal_symbolic", F.lit("")))).alias("symbol"))
    used = nodes.select("proof_id", F.lit("node").alias("kind"), F.col("id").alias("node_id"), none.alias("inference_id"), F.lit("claim_formal").alias("label"), F.explode(symbols(F.coalesce("claim_formal", F.lit("")))).alias("symbol"))
    used = used.join(base, ["proof_id", "symbol"], "left_anti").join(names.withColumnRenamed("id", "node_id"), ["proof_id", "node_id"], "left").filter(strange).drop("symbols").distinct()

    own = column(inferences, "declares", F.array().cast("array<string>"))
    i = inferences.select("proof_id", F.col("id").alias("inference_id"), F.col("conclusion").alias("node_id"), F.coalesce("deps", F.array().cast("array<string>")).alias("deps"), own.alias("own"), F.explode("instantiation").alias("label", "value")).filter("value is not null")
    i = i.select("proof_id", "inference_id", "node_id", "deps", "own", "label", F.explode(symbols("value")).alias("symbol")).filter(~F.array_contains("own", F.col("symbol"))).drop("own")
    i = Stages(nodes.sparkSession, "uses").put("uses", i.join(base, ["proof_id", "symbol"], "left_anti").withColumn("k", F.monotonically_increasing_id()))
    has = i.select("k", "proof_id", "symbol", F.explode("deps").alias("id")).join(names, ["proof_id", "id"]).filter("array_contains(symbols, symbol)").select("k").distinct()
    i = i.join(has, "k", "left_anti").select("proof_id", F.lit("inference").alias("kind"), "node_id", "inference_id", "label", "symbol").distinct()
    goals = goals.join(base, ["proof_id", "symbol"], "left_anti")
    columns = ["proof_id", "kind", "node_id", "inference_id", "label", "symbol"]
    return goals.select(*columns).unionByName(used.select(*columns)).unionByName(i)
