"""Typed graph from claims: edges, nodes, relation inference, components, degrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.functions import fixed_values as V
from claimweave.operators.containment import related
from claimweave.session import stage


def exploded_edges(claims: DataFrame, sources: str, targets: str, keep: list[str]) -> DataFrame:
    """Both name lists (arrays) exploded, self-loops dropped."""
    e = claims.select(*keep, F.explode(sources).alias("subject"), targets).select(*keep, "subject", F.explode(targets).alias("object"))
    return e.where((F.trim("subject") != "") & (F.trim("object") != "") & (F.lower("subject") != F.lower("object")))


def type_relations(spark: SparkSession) -> DataFrame:
    """Entity-type pairs and the relation they imply, with the reversed reading as lower priority."""
    rows = [(a, b, p, d, r, False) for a, b, p, d, r in V.ENTITY_TYPE_RELATIONS]
    listed = {(a, b) for a, b, *_ in V.ENTITY_TYPE_RELATIONS}
    rows += [(b, a, p, d, r, True) for a, b, p, d, r in V.ENTITY_TYPE_RELATIONS if (b, a) not in listed]
    return spark.createDataFrame(rows, "type_1 string, type_2 string, pred string, dir boolean, rid string, swap boolean")


def infer_relations(raw: DataFrame, terms: DataFrame) -> DataFrame:
    """Relation, direction and orientation of raw edges.

    ``raw``: id, name_1, type_1, kingdom_1, name_2, type_2, kingdom_2, interaction_type.
    ``terms``: term (lower case), predicate, directed, ro_id. Order: type pair → reversed type pair → term,
    exact → term, partial (longest known term that holds the key or stands in it, then alphabetical) → symmetric set →
    fallback with a flag.
    """
    types = type_relations(raw.sparkSession)
    exact = terms.select(F.col("term").alias("key"), F.struct("predicate", "directed", "ro_id").alias("t_exact"))
    wanted = raw.select(F.lower(F.trim("interaction_type")).alias("key")).distinct()
    pairs = related(wanted, terms.select("term")).join(terms, "term")
    near = pairs.groupBy("key").agg(F.min_by(F.struct("predicate", "directed", "ro_id"), F.struct(-F.length("term"), "term")).alias("t_near"))
    j = raw.withColumn("key", F.lower(F.trim("interaction_type"))).join(F.broadcast(types), ["type_1", "type_2"], "left")
    j = j.join(exact, "key", "left").join(near, "key", "left")
    by_type, t = F.col("pred").isNotNull(), F.coalesce("t_exact", "t_near")
    symmetric = F.col("key").isin([s.lower() for s in V.SYMMETRIC_RELATIONS]) | (F.col("key") == "")
    plant = lambda k, ty: F.col(k).isin("Plantae", "Viridiplantae") | (F.col(ty) == "HOST")
    turn = t.isNotNull() & F.lower(t["predicate"]).contains("pollinat") & ~plant("kingdom_2", "type_2") & plant("kingdom_1", "type_1")
    swap = F.when(by_type, F.col("swap")).otherwise(F.coalesce(turn, F.lit(False)))
    none = F.lit(None).cast("string")
    name = F.when(F.col("interaction_type") == "", "interactsWith").otherwise(F.col("interaction_type"))
    return j.select(
        "id",
        F.when(swap, F.col("name_2")).otherwise(F.col("name_1")).alias("subject"),
        F.when(swap, F.col("name_1")).otherwise(F.col("name_2")).alias("object"),
        F.when(by_type, F.col("pred")).when(t.isNotNull(), t["predicate"]).otherwise(name).alias("predicate"),
        F.when(by_type, F.col("dir")).when(t.isNotNull(), t["directed"]).otherwise(F.lit(False)).alias("directed"),
        F.when(by_type, F.col("rid")).when(t.isNotNull(), t["ro_id"]).otherwise(none).alias("ro_id"),
        F.when(by_type | t.isNotNull(), none).when(symmetric, "ambiguous").otherwise("unvalidated").alias("flag"),
    )


def degrees(edges: DataFrame) -> DataFrame:
    """Distinct in- and out-neighbours per node."""
    d = edges.select("subject", "object").distinct()
    ends = d.select(F.inline(F.array(F.struct(F.col("subject").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("object").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))))
    return ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def symmetric(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    return edges.select(F.inline(F.array(F.struct(F.col(a).alias("a"), F.col(b).alias("b")), F.struct(F.col(b).alias("a"), F.col(a).alias("b"))))).distinct()


#: A key that more rows than this ask for is looked up by broadcast.
HUB_ROWS = 100_000


def looked_up(rows: DataFrame, key: str, table: DataFrame, hubs: DataFrame | None, spread: Column, name: str) -> DataFrame:
    """``rows`` with column ``name``: the v that ``table`` (k, v; 64-bit, k unique) has for ``key``, null without one.

    ``hubs`` (k, v; none if None) has the keys that more than HUB_ROWS rows ask for, so few that they are broadcast. Their rows
    are dealt by ``spread``, which must differ from row to row, and not all to the task of their key.
    """
    if hubs is None:
        return rows.join(table.select(F.col("k").alias(key), F.col("v").alias(name)), key, "left")
    j = rows.join(F.broadcast(hubs.select(F.col("k").alias(key), F.col("v").alias("_hub"))), key, "left")
    j = j.withColumn("_k", F.when(F.col("_hub").isNull(), F.col(key)).otherwise(spread))
    j = j.join(table.select(F.col("k").alias("_k"), F.col("v").alias("_v")), "_k", "left")
    return j.withColumn(name, F.coalesce("_hub", "_v")).drop("_k", "_v", "_hub")


def number_of(node: str, seed: int) -> Column:
    """64-bit number of a node; null has none."""
    return F.when(F.col(node).isNotNull(), F.xxhash64(F.lit(seed), F.col(node)))


def numbered(nodes: DataFrame) -> tuple[DataFrame, int]:
    """Distinct nodes (id, node) and the first seed that gives each its own number."""
    for seed in range(20):
        names = stage(nodes.where("node is not null").select(number_of("node", seed).alias("id"), "node").distinct(), "components-names")
        if names.groupBy("id").count().where("count > 1").isEmpty():
            return names, seed
    raise RuntimeError("no seed numbers the nodes without collisions")


def both_ways(e: DataFrame, values: tuple[str, ...] = ()) -> DataFrame:
    """Edges (a, b) in both directions; of ``values``, none or that of a and that of b, the two change places too."""
    turned = [F.col(c).alias(d) for c, d in zip(("b", "a", *values[::-1]), ("a", "b", *values))]
    return e.select(F.inline(F.array(F.struct("a", "b", *values), F.struct(*turned))))


def rank(node: str, degree: str, round_: int) -> Column:
    """Order of the nodes in a round: by the binary length of their degree, and at random among those alike."""
    return F.shiftleft(F.length(F.bin(degree)).cast("long"), 57).bitwiseOR(F.shiftrightunsigned(F.xxhash64(F.lit(round_), F.col(node)), 7))


def components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """Connected component (smallest node id in it) of every node, by random contraction.

    Nodes are numbered by a hash that is checked for collisions. In each round every node moves to the last of itself and its
    neighbours by ``rank``, and edges are rewritten to where their ends moved. A component loses at least its first node in a
    round, and most of its nodes as the order is drawn anew each time, so the first rounds cost most. Then the moves are
    followed back from the last round. Each round is written to the shared folder; edges and nodes of a hub are dealt to all
    tasks.
    """
    kind = nodes.schema["node"].dataType
    ends = edges.where("a <> b").select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b"))
    names, seed = numbered(nodes.select("node").unionByName(ends.select(F.explode(F.array("a", "b")).alias("node"))))
    ordered = lambda e, a, b: e.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    state = stage(ordered(ends.select(number_of("a", seed).alias("a"), number_of("b", seed).alias("b")), "a", "b"), "components")
    moves: list[tuple[DataFrame, DataFrame | None]] = []
    while not state.isEmpty():
        if len(moves) == max_rounds:
            raise RuntimeError("components did not converge")
        degree = stage(both_ways(state).groupBy(F.col("a").alias("k")).agg(F.count("*").alias("n")).select("k", "n", rank("k", "n", len(moves)).alias("v")), "components-ranks")
        hubs, spread = degree.where(F.col("n") > HUB_ROWS), F.xxhash64("a", "b")
        hubs = None if hubs.isEmpty() else hubs
        ranked = looked_up(looked_up(state, "a", degree, hubs, spread, "x"), "b", degree, hubs, spread, "y")
        first = both_ways(ranked, ("x", "y")).groupBy("a").agg(F.max_by("b", "y").alias("b"), F.max("y").alias("y"), F.max("x").alias("x"))
        move = stage(first.select(F.col("a").alias("k"), F.when(F.col("x") > F.col("y"), F.col("a")).otherwise(F.col("b")).alias("v")), "components-moves")
        hubs = hubs if hubs is None else move.join(F.broadcast(hubs.select("k")), "k", "left_semi")
        moved = looked_up(looked_up(state, "a", move, hubs, spread, "x"), "b", move, hubs, spread, "y")
        state = stage(ordered(moved, "x", "y"), "components")
        moves.append((move, hubs))
    if not moves:
        return nodes.select("node", F.col("node").alias("component"))
    root = moves.pop()[0].select("k", "v")
    for move, hubs in reversed(moves):
        if hubs is not None:  # only neighbours of a node, and itself, have moved to it; a node without edges in the next round stays
            known = root.join(F.broadcast(hubs.select("k")), "k", "left_semi")
            hubs = hubs.select("k").join(known, "k", "left").select("k", F.coalesce("v", "k").alias("v"))
        root = stage(looked_up(move.select("k", "v"), "v", root, hubs, F.col("k"), "r").select("k", F.coalesce("r", "v").alias("v")), "components-roots")
    members = stage(names.join(root.select(F.col("k").alias("id"), F.col("v").alias("root")), "id"), "components-members")
    least = stage(members.groupBy(F.col("root").alias("k")).agg(F.min("node").alias("v"), F.count("*").alias("n")), "components-least")
    found = looked_up(members.select("id", "root"), "root", least, least.where(F.col("n") > HUB_ROWS), F.col("id"), "component").select("id", "component")
    given = nodes.select("node", number_of("node", seed).alias("id"))
    return given.join(found, "id", "left").select("node", F.coalesce("component", "node").alias("component"))


def first_category(pairs: DataFrame, relevant: list[str]) -> DataFrame:
    """Pair → first category seen (by ``seq``) among the relevant ones, in both directions."""
    p = pairs.where(F.col("category").isin(relevant))
    both = p.select(
        F.inline(F.array(F.struct("a", "b", "category", "seq"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "category", "seq")))
    )
    return both.groupBy("a", "b").agg(F.min_by("category", "seq").alias("category"))


