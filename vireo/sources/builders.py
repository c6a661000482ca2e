"""Edge, feature and label tables from the shapes that public graph datasets come in.

Each builder takes paths and returns the tables of a dataset: edges (src, dst and, where it draws
them, time), features (node_id, vec), labels (node_id, label) and, where it makes some, updates (time, node_id, vec).
Random choices are hash-derived. Where a builder takes the first nodes or edges of a walk, their turn is a minimum
over the places at which the walk meets them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vireo.functions import rng
from vireo.functions import text as tx
from vireo.functions import vectors as vx
from vireo.operators.convert import dense_from_sparse, top_columns
from vireo.operators.graph import dense_index, shared_targets
from vireo.runtime import cut
from vireo.sources import archives

# The span of drawn times, the spread of drawn updates and their number.
FIRST_TIME, LAST_TIME, NOISE, UPDATES = 1_710_000_000, 1_715_000_000, 0.03, 3000
#: What an ego network consists of.
EGO_PARTS = ("feat", "egofeat", "circles", "edges", "featnames")


def _time(seed: int, *keys: Column) -> Column:
    return (F.lit(FIRST_TIME) + F.floor(rng.uniform(seed, "time", *keys) * (LAST_TIME - FIRST_TIME))).cast("long")


def _json_map(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of one JSON object, values as text."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    return whole.select(F.explode("m").alias("key", "value"))


def social_graph(spark: SparkSession, ids: str, classes: str, links: str, features: str, max_nodes: int = 15_000, seed: int = 42) -> dict[str, DataFrame]:
    """The first nodes of an id map (JSON), the links among them (node-link JSON over places in the map), their vectors
    (.npy) and classes (JSON: a number, or scores of which the first greatest counts); drawn times, and noisy vectors of nodes drawn class by class as updates.
    """
    placed = _json_map(spark, ids).select(F.col("key").alias("node_id"), F.col("value").cast("long").alias("old"))
    kept = cut(placed.orderBy("old", "node_id").limit(max_nodes))
    end = lambda c: kept.select(F.col("old").cast("string").alias(c), F.col("node_id").alias(f"{c}_id"))
    pairs = archives.node_link(spark, links).join(end("src"), "src").join(end("dst"), "dst").where("src_id <> dst_id")
    edges = pairs.select(F.least("src_id", "dst_id").alias("src"), F.greatest("src_id", "dst_id").alias("dst")).distinct()
    edges = edges.withColumn("time", _time(seed, F.col("src"), F.col("dst")))
    vecs = cut(archives.npy_rows(spark, features).join(kept, F.col("row") == F.col("old")).select("node_id", "vec"))
    label = F.when(F.col("value").startswith("["), vx.argmax(F.from_json("value", "array<double>"))).otherwise(F.col("value").try_cast("double").cast("long"))
    labels = cut(_json_map(spark, classes).join(kept, F.col("key") == F.col("node_id")).select("node_id", label.cast("long").alias("label")))
    sizes = cut(dense_index(labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "label", "code"))
    groups = sizes.count()
    ranked = dense_index(labels.withColumn("_key", F.struct("label", "node_id")), "_key", "rank")
    starts = ranked.groupBy("label").agg(F.min("rank").alias("start"))
    nth = ranked.join(starts, "label").select("label", (F.col("rank") - F.col("start")).alias("nth"), "node_id")
    drawn = spark.range(UPDATES if groups else 0).select("id", F.floor(rng.uniform(seed, "class", F.col("id")) * groups).cast("long").alias("code"))
    drawn = drawn.join(sizes, "code").select("id", "label", F.floor(rng.uniform(seed, "node", F.col("id")) * F.col("n")).cast("long").alias("nth"))
    noisy = F.transform("vec", lambda x, j: x + NOISE * rng.normal(seed, "noise", F.col("id"), j))
    updates = drawn.join(nth, ["label", "nth"]).join(vecs, "node_id").select(_time(seed, F.col("id")).alias("time"), "node_id", noisy.alias("vec"))
    return {"edges": edges, "features": vecs, "labels": labels, "updates": updates}


def _first_mentions(ways: DataFrame, most: int) -> DataFrame:
    """(a, b): the first ``most`` pairs of (i, j, turn), either way round, in order of their first turn."""
    pairs = ways.where("i <> j").select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "turn")
    return pairs.groupBy("a", "b").agg(F.min("turn").alias("turn")).orderBy("turn").limit(most).select("a", "b")


def product_matrix(spark: SparkSession, adjacency: str, features: str, classes: str, max_nodes: int = 30_000, max_edges: int = 250_000, seed: int = 42) -> dict[str, DataFrame]:
    """The first rows of a CSR matrix (.npz), named a0, a1, ..., and their first edges in order of the rows; vectors and class scores from .npy."""
    vecs = archives.npy_rows(spark, features, first=max_nodes)
    scores = archives.npy_rows(spark, classes, first=max_nodes)
    cells = archives.csr_slots(spark, adjacency)
    n = min([max_nodes, *[(df.agg(F.max("row")).first()[0] or -1) + 1 for df in (vecs, scores)], archives.csr_rows(spark, adjacency)])
    name = lambda c: F.concat(F.lit("a"), F.col(c).cast("string"))
    ways = cells.where((F.col("row") < n) & (F.col("col") < n)).select(F.col("row").alias("i"), F.col("col").alias("j"), F.struct("row", "slot").alias("turn"))
    edges = cut(_first_mentions(ways, max_edges)).select(name("a").alias("src"), name("b").alias("dst"))
    own = lambda df: df.where(F.col("row") < n)
    return {
        "edges": edges.withColumn("time", _time(seed, F.col("src"), F.col("dst"))),
        "features": own(vecs).select(name("row").alias("node_id"), "vec"),
        "labels": own(scores).select(name("row").alias("node_id"), vx.argmax(F.col("vec")).cast("long").alias("label")),
    }


def citation_files(spark: SparkSession, matrix: str, max_nodes: int = 8000, max_edges: int = 200_000) -> dict[str, DataFrame]:
    """``citation_graph`` of an .npz that holds adjacency and attributes as CSR, and labels."""
    labels = archives.npy_rows(spark, matrix, key="labels").select("row", F.col("vec")[0].cast("long").alias("label"))
    rows = archives.csr_rows(spark, matrix, "adj_matrix.")
    return citation_graph(archives.csr_slots(spark, matrix, "adj_matrix.").select("row", "slot", "col"), archives.csr_entries(spark, matrix, "attr_matrix."), labels.where(F.col("row") < rows), max_nodes, max_edges)


def citation_graph(adjacency: DataFrame, cells: DataFrame, classes: DataFrame, max_nodes: int, max_edges: int = 200_000, columns: int = 64, fan: int = 32) -> dict[str, DataFrame]:
    """The first ``max_nodes`` nodes that a walk meets, and their first ``max_edges`` edges.

    The walk takes all rows in order that have neighbours, each row and then its first ``fan`` neighbours. So a node's turn is
    the least (row, slot) at which it stands, and which nodes are met first is a minimum per node and a rank, not a
    loop. Edges come in the order of their first mention by the chosen nodes. Nodes are named m0, m1, ... by their turn.

    ``adjacency`` has (row, slot, col), slots from 0; ``cells`` (row, col, value) of attributes; ``classes`` (row, label) of all nodes there are.
    Without attributes among the nodes, features are degree, its log1p and its share of the greatest degree.
    """
    known = classes.select("row")
    ways = adjacency.select("row", "slot", "col")
    own = ways.groupBy("row").agg(F.lit(-1).cast("long").alias("slot")).join(known, "row", "left_semi").select("row", "slot", F.col("row").alias("node"))
    near = ways.where(F.col("slot") < fan).join(known, "row", "left_semi").select("row", "slot", F.col("col").alias("node")).join(known.select(F.col("row").alias("node")), "node", "left_semi").select("row", "slot", "node")
    turns = own.union(near).groupBy("node").agg(F.min(F.struct("row", "slot")).alias("turn"))
    met = cut(dense_index(turns.orderBy("turn").limit(max_nodes), "turn", "place").select("node", "place"))
    if met.isEmpty():
        raise ValueError("no node has a neighbour")
    a, b = met.select(F.col("node").alias("row"), F.col("place").alias("i")), met.select(F.col("node").alias("col"), F.col("place").alias("j"))
    mentions = ways.join(a, "row").join(b, "col").select("i", "j", F.struct("i", "slot").alias("turn"))
    edges = cut(_first_mentions(mentions, max_edges))
    name = lambda c: F.concat(F.lit("m"), F.col(c).cast("string"))
    own_cells = cut(cells.join(a, "row").select(name("i").alias("node_id"), "col", "value"))
    nodes = met.select(name("place").alias("node_id"), "place")
    if own_cells.isEmpty():
        ends = edges.select(F.col("a").alias("place")).union(edges.select("b")).groupBy("place").agg(F.count(F.lit(1)).cast("double").alias("d"))
        most = F.lit(float(max(ends.agg(F.max("d")).first()[0] or 1.0, 1.0)))
        d = F.coalesce("d", F.lit(0.0))
        features = nodes.join(ends, "place", "left").select("node_id", F.array(d, F.log1p(d), d / most).alias("vec"))
    else:
        top = cut(top_columns(own_cells, columns))
        width = top.count()
        none = F.array_repeat(F.lit(0.0), width)
        features = nodes.join(dense_from_sparse(own_cells, top, width), "node_id", "left").select("node_id", F.coalesce("vec", none).alias("vec"))
    labels = classes.join(a, "row").select(name("i").alias("node_id"), F.col("label").cast("long").alias("label"))
    return {"edges": edges.select(name("a").alias("src"), name("b").alias("dst")), "features": features, "labels": labels}


def ego_networks(spark: SparkSession, archive: str, folder: str = "", max_nodes: int = 12_000, max_edges: int = 180_000, columns: int = 128) -> dict[str, DataFrame]:
    """Ego networks of a .tar.gz below ``folder``, those with all parts, in order of their names.

    An ego and the nodes of its feature lines are joined by a star and by the listed edges. Nodes are the first
    ``max_nodes`` met; features are the ``columns`` most frequent names (ties by name), a node's label its first circle. Edges
    beyond ``max_edges`` go from the end of their order by name.
    """
    lines = cut(archives.tar_members(spark, archive))
    stems = archives.complete_stems(lines, EGO_PARTS, folder)
    ranked = cut(dense_index(stems, "stem", "ego_no").withColumn("ego", F.element_at(F.split("stem", "/"), -1)))
    kinds = lines.select(F.regexp_extract("member", r"^(.*)\.([^./]*)$", 1).alias("stem"), F.regexp_extract("member", r"^(.*)\.([^./]*)$", 2).alias("part"), "line_no", F.filter(F.split("line", r"\s+"), lambda w: w != "").alias("words"), tx.strip(F.col("line")).alias("line"))
    known = cut(kinds.join(F.broadcast(ranked), "stem"))
    part = lambda p: known.where(F.col("part") == p)
    names = part("featnames").where(F.size("words") >= 2).select("ego_no", "line_no", F.regexp_replace("line", r"^\S+\s+", "").alias("name"))
    names = names.groupBy("ego_no").agg(F.array_sort(F.collect_list(F.struct("line_no", "name"))).getField("name").alias("names"))  # the features of one ego
    egos = ranked.join(names, "ego_no").select("ego_no", "ego", "names")
    bits = part("feat").join(egos.select("ego_no", "names"), "ego_no").where(F.size("words") == F.size("names") + 1)
    feats = bits.select("ego_no", F.col("words")[0].alias("node_id"), "line_no", F.slice("words", 2, F.size("names")).alias("bits"), "names")
    own = part("egofeat").groupBy("ego_no").agg(F.flatten(F.array_sort(F.collect_list(F.struct("line_no", "words"))).getField("words")).alias("bits"))
    ego_bits = egos.join(own, "ego_no", "left")
    visits = egos.select("ego_no", F.col("ego").alias("node_id"), F.lit(-1).cast("long").alias("line_no")).union(feats.select("ego_no", "node_id", "line_no"))
    turns = visits.groupBy("node_id").agg(F.min(F.struct("ego_no", "line_no")).alias("turn"))
    kept = cut(turns.orderBy("turn", "node_id").limit(max_nodes).select("node_id"))
    local = cut(visits.select("ego_no", "node_id").distinct().join(kept, "node_id", "left_semi"))
    star = local.join(egos.select("ego_no", "ego"), "ego_no").select(F.col("ego").alias("x"), F.col("node_id").alias("y"))
    listed = part("edges").where(F.size("words") >= 2).select("ego_no", F.col("words")[0].alias("x"), F.col("words")[1].alias("y"))
    for c in ("x", "y"):
        listed = listed.join(local.withColumnRenamed("node_id", c), ["ego_no", c], "left_semi")
    pairs = star.union(listed.select("x", "y")).where("x <> y").join(kept.withColumnRenamed("node_id", "x"), "x", "left_semi")
    edges = pairs.select(F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst")).distinct().orderBy("src", "dst").limit(max_edges)
    told = part("circles").where(F.size("words") >= 2).select("ego_no", "ego", "line_no", F.concat("ego", F.lit(":"), F.col("words")[0]).alias("circle"), F.posexplode(F.slice("words", 2, F.size("words"))).alias("place", "node_id"))
    first = told.join(local, ["ego_no", "node_id"], "left_semi").groupBy("node_id").agg(F.min_by("circle", F.struct("ego_no", "line_no", "place")).alias("circle"))
    codes = dense_index(first.select("circle").distinct(), "circle", "label")
    marked = lambda on: F.filter(F.zip_with("bits", "names", lambda b, n: F.when(on(b), n)), lambda n: n.isNotNull())
    of_nodes = feats.select("node_id", F.explode(marked(lambda b: b == "1")).alias("col"))
    of_egos = ego_bits.where(F.size("bits") == F.size("names")).select(F.col("ego").alias("node_id"), F.explode(marked(lambda b: b.try_cast("int") != 0)).alias("col"))
    cells = cut(of_nodes.union(of_egos).distinct().join(kept, "node_id", "left_semi").withColumn("value", F.lit(1.0)))
    top = cut(top_columns(cells, columns))
    width = top.count()
    features = kept.join(dense_from_sparse(cells, top, width), "node_id", "left") if width else kept.withColumn("vec", F.lit(None).cast("array<double>"))
    return {"edges": edges, "features": features.select("node_id", F.coalesce("vec", F.array_repeat(F.lit(0.0), width)).alias("vec")), "labels": first.join(codes, "circle").select("node_id", "label")}


def product_text(spark: SparkSession, records: str, max_nodes: int = 10_000, max_edges: int = 200_000, hashed: int = 16, most: int = 500, seed: int = 42) -> dict[str, DataFrame]:
    """Products of a gzipped JSON-lines file that share a target, with text statistics and hashed words.

    Of the first 4 * max_nodes lines those with two targets or more count, ``max_nodes`` of them at most, drawn by hash; so
    are edges beyond ``max_edges``. Targets of more than ``most`` products link none. The label is the most
    relevant target, or the first one if relevances don't match targets.
    """
    shape = "uid string, title string, content string, target_ind array<long>, target_rel array<double>"
    lines = archives.gzip_json_lines(spark, records, first=4 * max_nodes).select("line_no", F.from_json("raw", shape).alias("r")).select("line_no", "r.*")
    some = lines.where(F.size("target_ind") >= 2)
    kept = cut(some.orderBy(rng.order_key(seed, F.col("line_no")), "line_no").limit(max_nodes))
    node = kept.select(F.col("line_no"), F.col("uid").alias("node_id"), "title", "content", "target_ind", F.coalesce("target_rel", F.array().cast("array<double>")).alias("rel"))
    shared = shared_targets(node.select("line_no", F.explode("target_ind").alias("target")), "line_no", "target", most)
    chosen = cut(shared.orderBy(rng.order_key(seed, F.col("u"), F.col("v")), "u", "v").limit(max_edges))
    uid = lambda c, out: kept.select(F.col("line_no").alias(c), F.col("uid").alias(out))
    edges = chosen.join(uid("u", "src"), "u").join(uid("v", "dst"), "v").select("src", "dst")
    ends = chosen.select(F.col("u").alias("line_no")).union(chosen.select("v")).groupBy("line_no").agg(F.count(F.lit(1)).cast("double").alias("degree"))
    d = F.coalesce("degree", F.lit(0.0))
    title, content = tx.statistics(F.col("title")), tx.statistics(F.col("content"))
    mean = F.aggregate("rel", F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size("rel"), F.lit(1))
    numbers = [title["words"], content["words"], content["chars"], F.size("target_ind"), d, F.log1p(d), mean, F.coalesce(F.array_max("rel"), F.lit(0.0))]
    vec = F.concat(F.array(*[c.cast("double") for c in numbers]), tx.hash_features(F.concat_ws(" ", "title", "content"), hashed))
    best = F.when((F.size("rel") == F.size("target_ind")) & (F.size("rel") > 0), F.get("target_ind", vx.argmax(F.col("rel")).cast("int"))).otherwise(F.get("target_ind", F.lit(0)))
    heads = cut(node.select("node_id", best.alias("target")))
    codes = dense_index(heads.where("target >= 0").select("target").distinct(), "target", "label")
    labels = heads.join(codes, "target", "left").select("node_id", F.coalesce("label", F.lit(-1)).cast("long").alias("label"))
    return {"edges": edges, "features": node.join(ends, "line_no", "left").select("node_id", vec.alias("vec")), "labels": labels}


#: Builders by name, and the inputs that each needs.
BUILDERS = {
    "social": (social_graph, ("ids", "classes", "links", "features")),
    "products": (product_matrix, ("adjacency", "features", "classes")),
    "citations": (citation_files, ("matrix",)),
    "egos": (ego_networks, ("archive",)),
    "product-text": (product_text, ("records",)),
}
