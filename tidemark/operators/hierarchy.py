"""Parent links of unknown depth turned into full hierarchies.

Items with one usable parent form chains. Their links are combined block by block in weighted
disjoint-set forests (the weight is the number of links to the set's root; a link whose parent's
root is the child itself closes a loop). Only roots that have a parent in another block go on to
the next, smaller level, until every set has its top: an item without parents, or one with several
(a junction). Only folders take part; files hang on to their folder's way at the end. Paths are then written down the parent index of each block and put together level by
level. Junctions, few by nature, are expanded along their links, each way visiting none twice.

Blocks hold at most ``block_rows`` links of one connection, so a connection with a third of all
items is spread over many tasks. Where a level no longer shrinks, pointers are doubled by joins.

Defined results: rows without item or connection id are left out; a null or empty parent list, null
parents and parents that have no current folder row are no links; repeated parents count once; of
rows with equal times the one with the larger (is_folder, parent_ids) is current, null times come
first; an empty table gives an empty result; other columns are ignored. Ids must not hold U+001F.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import cut, table

SEP = "\x1f"
_TOPS = "c string, x string, top string, hops int, seg string, loop boolean"


class WeightedForest:
    """Disjoint sets whose members know how many links lie between them and their root."""

    def __init__(self) -> None:
        self.up: dict[str, tuple[str, int]] = {}
        self.looped: set[str] = set()

    def find(self, x: str) -> tuple[str, int]:
        """The root of ``x`` and the links to it; flattens the way there."""
        way, total = [], 0
        while x in self.up:
            way.append(x)
            x = self.up[x][0]
        for y in reversed(way):
            total += self.up[y][1]
            self.up[y] = (x, total)
        return x, total

    def link(self, child: str, parent: str, weight: int) -> None:
        """Hang the set of root ``child`` below ``parent``; a link onto itself marks a loop."""
        root, offset = self.find(parent)
        if root == child:
            self.looped.add(child)
        else:
            self.up[child] = (parent, weight) if parent not in self.up else (root, offset + weight)


def _block_tops(links: pd.DataFrame) -> pd.DataFrame:
    """The top of every linked item as far as this block knows it, with the way down from there."""
    forest = WeightedForest()
    index = {x: (p, seg) for x, p, seg in zip(links.x, links.p, links.seg)}
    for x, p, hops in zip(links.x, links.p, links.hops):
        forest.link(x, p, hops)
    tops = {x: forest.find(x) for x in index}
    ways: dict[str, str] = {}
    for x in sorted(index, key=lambda x: tops[x][1]):
        parent, seg = index[x]
        if tops[x][0] not in forest.looped:
            ways[x] = ways[parent] + SEP + seg if parent in ways else seg
    rows = [(x, top, hops, ways.get(x), top in forest.looped) for x, (top, hops) in tops.items()]
    out = pd.DataFrame(rows, columns=["x", "top", "hops", "seg", "loop"])
    out.insert(0, "c", links.c.iloc[0])
    return out


def chain_tops(links: DataFrame, block_rows: int = 50_000, levels: int = 6) -> DataFrame:
    """(c, x, top, hops, seg, loop) for single links (c, x, p); ``seg`` leads from below ``top`` to ``x``."""
    todo = links.select("c", "x", "p", F.lit(1).alias("hops"), F.col("x").alias("seg"))
    done: list[DataFrame] = []
    before = None
    for _ in range(levels):
        todo = cut(todo)
        count = todo.count()
        if before is not None and count > 0.7 * before:
            break
        if count == 0 and done:
            todo = None
            break
        before = count
        widths = todo.groupBy("c").agg(F.ceil(F.count("*") / block_rows).alias("blocks"))
        blocks = todo.join(widths, "c").withColumn("block", F.pmod(F.xxhash64("x"), F.col("blocks")))
        tops = cut(blocks.groupBy("c", "block").applyInPandas(_block_tops, _TOPS))
        done.append(tops)
        # roots of sets that hang below something in another block
        open_ = tops.where("NOT loop").select("c", F.col("top").alias("x")).distinct()
        todo = tops.where("NOT loop").join(open_, ["c", "x"], "left_semi").select("c", "x", F.col("top").alias("p"), "hops", "seg")
        open_loop = tops.where("loop").join(open_, ["c", "x"], "left_semi").select("c", "x")
        done[-1] = done[-1].join(open_loop.withColumnRenamed("x", "top").withColumn("bad", F.lit(True)), ["c", "top"], "left")
        done[-1] = done[-1].select("c", "x", "top", "hops", "seg", (F.col("loop") | F.coalesce("bad", F.lit(False))).alias("loop"))
    if todo is not None and not (done and todo.isEmpty()):
        done.append(_double(todo))
    result = done.pop()
    while done:
        result = cut(_onto(done.pop(), result))
    return result


def _onto(lower: DataFrame, upper: DataFrame) -> DataFrame:
    """Continue the ways of ``lower`` with those that ``upper`` has for its tops."""
    u = upper.select("c", F.col("x").alias("top"), F.col("top").alias("top2"), F.col("hops").alias("hops2"), F.col("seg").alias("seg2"), F.col("loop").alias("loop2"))
    loop = F.col("loop") | F.coalesce("loop2", F.lit(False))
    return lower.join(u, ["c", "top"], "left").select("c", "x", F.coalesce("top2", "top").alias("top"), (F.col("hops") + F.coalesce("hops2", F.lit(0))).alias("hops"), F.concat_ws(SEP, "seg2", "seg").alias("seg"), loop.alias("loop"))


def _double(links: DataFrame) -> DataFrame:
    """Tops by pointer doubling: after k rounds a pointer spans 2**k links; what is left then is a loop."""
    now = cut(links.select("c", "x", F.col("p").alias("top"), "hops", "seg", F.lit(False).alias("loop")))
    for _ in range(max(1, now.count()).bit_length() + 1):
        open_ = now.join(now.select("c", F.col("x").alias("top")), ["c", "top"], "left_semi")
        if open_.isEmpty():
            return now
        now = cut(_onto(now, now))
    stuck = now.select("c", F.col("x").alias("top"), F.lit(True).alias("bad"))
    return now.join(stuck, ["c", "top"], "left").select("c", "x", "top", "hops", "seg", F.coalesce("bad", F.lit(False)).alias("loop"))


def current_items(items: DataFrame) -> DataFrame:
    """(c, x, is_folder, parent_ids) of the current row of every item."""
    newest = F.max(F.struct("modified_at", "fetched_at", "is_folder", "parent_ids")).alias("r")
    return items.where("connection_id IS NOT NULL AND item_id IS NOT NULL").groupBy(F.col("connection_id").alias("c"), F.col("item_id").alias("x")).agg(newest).select("c", "x", "r.is_folder", "r.parent_ids")


def hierarchy(items: DataFrame, block_rows: int = 50_000) -> DataFrame:
    """(c, x, root, depth, path) per way down from a root, ids in ``path`` split by U+001F; and one
    row with root '', depth -1 and path '' per item on a loop or out of reach of every root."""
    now = cut(current_items(items))
    folders = now.where("is_folder").select("c", F.col("x").alias("p"))
    links = now.select("c", "x", "is_folder", F.explode(F.array_distinct("parent_ids")).alias("p")).where("p IS NOT NULL").join(folders, ["c", "p"]).select("c", "x", "p", "is_folder")
    parents = cut(links.groupBy("c", "x").agg(F.count("*").alias("n"), F.min("p").alias("p"), F.coalesce(F.max("is_folder"), F.lit(False)).alias("is_folder")))
    roots = now.select("c", "x").join(parents, ["c", "x"], "left_anti")
    single = parents.where("n = 1")
    junctions = parents.where("n > 1").select("c", "x")
    # only folders have anything below them: the forests hold folders, files hang on at the end
    above = chain_tops(single.where("is_folder").select("c", "x", "p"), block_rows)
    files = single.where("NOT is_folder").select("c", "x", F.col("p").alias("top"), F.lit(1).alias("hops"), F.col("x").alias("seg"), F.lit(False).alias("loop"))
    tops = cut(above.unionByName(_onto(files, above)))

    # junction links: from the parent's top down to the junction
    into = links.join(junctions, ["c", "x"], "left_semi")
    t = tops.select("c", F.col("x").alias("p"), "top", "hops", "seg", "loop")
    edges = into.join(t, ["c", "p"], "left").where("loop IS NULL OR NOT loop")
    edges = cut(edges.select("c", "x", F.coalesce("top", "p").alias("top"), (F.coalesce("hops", F.lit(0)) + 1).alias("hops"), F.concat_ws(SEP, "seg", "x").alias("seg")))
    step = edges.select("c", F.col("top").alias("x"), F.col("x").alias("to"), F.col("hops").alias("more"), F.col("seg").alias("way"))
    reach = edges.join(roots.withColumnRenamed("x", "top"), ["c", "top"], "left_semi")
    reach = cut(reach.select("c", "x", F.col("top").alias("root"), F.array("x").alias("via"), F.col("hops").alias("depth"), F.concat_ws(SEP, "top", "seg").alias("path")))
    found = [reach]
    while not reach.isEmpty():
        reach = reach.join(step, ["c", "x"]).where(~F.array_contains("via", F.col("to")))
        reach = cut(reach.select("c", F.col("to").alias("x"), "root", F.concat("via", F.array("to")).alias("via"), (F.col("depth") + F.col("more")).alias("depth"), F.concat_ws(SEP, "path", "way").alias("path")))
        found.append(reach)
    at_junction = found[0]
    for f in found[1:-1]:
        at_junction = at_junction.unionByName(f)
    at_junction = at_junction.select("c", "x", "root", "depth", "path")

    heads = roots.select("c", "x", F.col("x").alias("root"), F.lit(0).alias("depth"), F.col("x").alias("path")).unionByName(at_junction)
    h = heads.select("c", F.col("x").alias("top"), "root", "depth", "path")
    below = tops.where("NOT loop").join(h, ["c", "top"]).select("c", "x", "root", (F.col("depth") + F.col("hops")).alias("depth"), F.concat_ws(SEP, "path", "seg").alias("path"))
    ways = cut(heads.unionByName(below))

    lost = now.select("c", "x").join(ways.select("c", "x").distinct(), ["c", "x"], "left_anti")
    bad = lost.unionByName(_on_loops(edges, junctions)).distinct()
    return ways.unionByName(bad.select("c", "x", F.lit("").alias("root"), F.lit(-1).alias("depth"), F.lit("").alias("path")))


def _on_loops(edges: DataFrame, junctions: DataFrame) -> DataFrame:
    """(c, x) of items on loops that pass a junction: strongly connected junctions and what lies between.

    Every junction takes the largest id that leads to it as its colour; those from which the way
    leads back to the colour's own junction are one component. Components leave the graph, and the
    rest is coloured anew. No step holds more rows than there are links.
    """
    e = cut(edges.join(junctions.withColumnRenamed("x", "top"), ["c", "top"], "left_semi").select("c", "top", "x", "seg"))
    closed = e.limit(0).select("c", "top", "seg")
    while True:
        # what nothing leads into or out of lies on no loop
        e = e.join(e.select("c", F.col("x").alias("top")).distinct(), ["c", "top"], "left_semi").join(e.select("c", F.col("top").alias("x")).distinct(), ["c", "x"], "left_semi")
        e = cut(e.select("c", "top", "x", "seg"))
        if e.isEmpty():
            return closed.select("c", F.explode(F.concat(F.array("top"), F.split("seg", SEP))).alias("x")).distinct()
        hop = e.select("c", "top", "x").distinct()
        colour = cut(hop.select("c", "x").union(hop.select("c", "top")).distinct().withColumn("colour", F.col("x")))
        moved = True
        while moved:
            came = hop.join(colour.withColumnRenamed("x", "top"), ["c", "top"]).select("c", "x", "colour")
            now = cut(colour.select("c", "x", "colour", F.col("colour").alias("was")).unionByName(came.withColumn("was", F.lit(None).cast("string"))).groupBy("c", "x").agg(F.max("colour").alias("colour"), F.max("was").alias("was")))
            moved = not now.where("colour <> was").isEmpty()
            colour = now.select("c", "x", "colour")
        same = hop.join(colour.withColumnRenamed("x", "top"), ["c", "top"]).join(colour, ["c", "x", "colour"]).select("c", "top", "x")
        back = new = cut(colour.where("x = colour").select("c", "x"))
        while not new.isEmpty():
            new = cut(same.join(new, ["c", "x"]).select("c", F.col("top").alias("x")).distinct().join(back, ["c", "x"], "left_anti"))
            back = cut(back.unionByName(new))
        part = colour.join(back, ["c", "x"], "left_semi")
        inside = e.join(part.withColumnRenamed("x", "top"), ["c", "top"]).join(part, ["c", "x", "colour"])
        closed = closed.unionByName(cut(inside.select("c", "top", "seg")))
        e = e.join(back, ["c", "x"], "left_anti").join(back.withColumnRenamed("x", "top"), ["c", "top"], "left_anti").select("c", "top", "x", "seg")


def descendants(ways: DataFrame) -> DataFrame:
    """(c, x, below, distance): every item below ``x`` on some way, with the shortest distance."""
    w = ways.where("depth > 0").select("c", F.col("x").alias("below"), "depth", F.posexplode(F.split("path", SEP)).alias("at", "x")).where("at < depth")
    return w.groupBy("c", "x", "below").agg(F.min(F.col("depth") - F.col("at")).alias("distance"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every way down to every Drive item, and the items on loops or out of reach."""
    h = hierarchy(table(spark, sf_dir, "drive_items"))
    return h.select(F.col("x").alias("item_id"), F.col("root").alias("root_id"), "depth", F.translate("path", SEP, "/").alias("id_path"))


def p1_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All descendants of every Drive item."""
    d = descendants(hierarchy(table(spark, sf_dir, "drive_items")))
    return d.select(F.col("c").alias("connection_id"), F.col("x").alias("item_id"), F.col("below").alias("descendant_id"), "distance")


_WAYS = """
WITH RECURSIVE cur AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY connection_id, item_id ORDER BY modified_at DESC, fetched_at DESC) AS n FROM drive_items) WHERE n = 1),
wish AS (SELECT DISTINCT connection_id AS c, item_id AS x, unnest(parent_ids) AS p FROM cur),
link AS (SELECT w.c, w.x, w.p FROM wish w JOIN cur f ON f.connection_id = w.c AND f.item_id = w.p AND f.is_folder),
way AS (
  SELECT connection_id AS c, item_id AS x, item_id AS root, 0 AS depth, [item_id] AS path FROM cur
  WHERE NOT EXISTS (SELECT 1 FROM link WHERE link.c = connection_id AND link.x = item_id)
  UNION ALL
  SELECT w.c, l.x, w.root, w.depth + 1, list_append(w.path, l.x) FROM way w JOIN link l ON l.c = w.c AND l.p = w.x WHERE NOT list_contains(w.path, l.x))
"""
ORACLES = {
    "p1_found": _WAYS + """
, up AS (SELECT c, x, p FROM link UNION SELECT u.c, u.x, l.p FROM up u JOIN link l ON l.c = u.c AND l.x = u.p)
SELECT x AS item_id, root AS root_id, depth, array_to_string(path, '/') AS id_path FROM way
UNION ALL
SELECT item_id, '', -1, '' FROM cur
WHERE EXISTS (SELECT 1 FROM up WHERE up.c = connection_id AND up.x = item_id AND up.p = item_id)
   OR NOT EXISTS (SELECT 1 FROM way WHERE way.c = connection_id AND way.x = item_id)
""",
    "p1_descendants": _WAYS + """
SELECT c AS connection_id, path[i] AS item_id, x AS descendant_id, CAST(min(depth + 1 - i) AS INTEGER) AS distance
FROM (SELECT c, x, depth, path, CAST(unnest(range(1, depth + 1)) AS INTEGER) AS i FROM way) GROUP BY 1, 2, 3
""",
}
QUERIES = {"p1_found": p1_found, "p1_descendants": p1_descendants}
