"""MinHash near-dedup with tensored banding.

A document's set has its distinct five-word shingles.  Two collections of half keys, each of ``rows`` minhashes, are
drawn; a table's key combines one half key of either collection, so ``halves`` ** 2 tables cost only
2 * halves * rows minhashes.  Half keys that no other document has are dropped before keys are combined.  In each table
bucket the document with the most collisions is the hub that the others are verified against on full sets.  Pairs of a
hub's partners that this leaves open are found by their edits relative to the hub, with a prefix filter that loses
none, and verified as well.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, batches, discard, identified, mix, partitions, seeded, shingle_hashes, string_bytes, word_hashes, written
from .graph import components

#: Bytes, as JVM rows, of a list of documents that may be broadcast; a longer one is joined by id.
BROADCAST_BYTES = 8 << 20
#: Rows of one hub's partners in one sorted group; larger groups are dealt over salts.
GROUP_ROWS = 512

_U = np.uint64


def document_sets(raw: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingle hashes in ascending order, end to end, and n+1 offsets."""
    words, _, _, w_at = word_hashes(LOWER[raw], at)
    sh, s_at = shingle_hashes(words, w_at, width)
    sets = [np.unique(sh[a:b]) for a, b in zip(s_at[:-1], s_at[1:])]
    return np.concatenate([*sets, np.zeros(0, np.uint64)]), np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64)


def half_keys(sets: np.ndarray, at: np.ndarray, halves: int, rows: int, seed: int) -> np.ndarray:
    """(texts, 2 * halves) half keys; a text with an empty set has noughts."""
    out = np.zeros((len(at) - 1, 2 * halves), np.uint64)
    full = np.flatnonzero(at[1:] > at[:-1])
    if not len(full):
        return out
    mult = seeded(seed, 2 * halves * rows)
    with np.errstate(over="ignore"):
        for j, m in enumerate(mult):
            low = np.minimum.reduceat(sets * m, at[full])
            col = j // rows
            out[full, col] = mix(out[full, col] * _U(0x9E3779B97F4A7C15) + low + _U(j + 1))
    return out


def _sketcher(width: int, halves: int, rows: int, seed: int):
    def run(it):
        for b in batches(it):
            sets, at = document_sets(*string_bytes(b.column(1)), width)
            n = np.diff(at)
            sums = lambda x: (c := np.concatenate([[_U(0)], np.cumsum(x, dtype=np.uint64)]))[at[1:]] - c[at[:-1]]
            with np.errstate(over="ignore"):
                f1, f2 = sums(mix(sets + _U(11))), sums(mix(sets ^ _U(0xA5A5A5A5A5A5A5A5)))
            keys = half_keys(sets, at, halves, rows, seed).astype(np.int64)
            flat = pa.array(keys.ravel(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(f1.astype(np.int64)), pa.array(f2.astype(np.int64)), pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * 2 * halves, pa.int32()), flat)],
                ["doc_id", "n", "f1", "f2", "keys"],
            )

    return run


def _shipped(width: int):
    """Texts with hubs -> a row (hub, salt, first, member, set) for each hub, and for a hub itself a row ahead of each salt."""

    def run(it):
        for b in batches(it):
            sets, at = document_sets(*string_bytes(b.column(b.num_columns - 1)), width)
            ids, hubs, salts = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()
            rows: list[list] = [[], [], [], [], []]
            size = 0
            for i, doc in enumerate(ids):
                blob = sets[at[i] : at[i + 1]].tobytes()
                for h in hubs[i] or []:
                    for col, v in zip(rows, (h["hub"], h["salt"], 1, doc, blob)):
                        col.append(v)
                    size += len(blob)
                for s in range(salts[i] or 0):
                    for col, v in zip(rows, (doc, s, 0, doc, blob)):
                        col.append(v)
                    size += len(blob)
                if size > 2 << 20:
                    yield _ship(rows)
                    rows, size = [[], [], [], [], []], 0
            if rows[0]:
                yield _ship(rows)

    return run


def _ship(rows):
    return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.int32()), pa.array(rows[3], pa.int64()), pa.array(rows[4], pa.binary())], ["hub", "salt", "first", "member", "hashes"])


_COMPARED = "hub long, salt int, member long, hub_n long, n long, common long, edits array<long>"


def _compared(edits: bool):
    def run(it):
        hub, held = None, None
        names = [c.split()[0] for c in _COMPARED.split(", ")]
        for b in it:
            out: list[list] = [[] for _ in names]
            for h, s, first, m, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4)):
                own = np.frombuffer(blob.as_buffer(), np.uint64)
                if first == 0:
                    hub, held = (h, s), own.copy()
                    continue
                if hub != (h, s):
                    raise RuntimeError("a hub's set is missing")
                both = np.searchsorted(held, own)
                shared = held[np.minimum(both, len(held) - 1)] == own
                common = int(shared.sum())
                if edits:
                    lost = np.ones(len(held), bool)
                    lost[both[shared]] = False
                    # what the hub has more is told apart from what it lacks by another hash
                    diff = np.concatenate([mix(held[lost] + _U(1)), own[~shared]]).astype(np.int64)
                else:
                    diff = np.zeros(0, np.int64)
                for col, v in zip(out, (h, s, m, len(held), len(own), common, diff)):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32() if k == 1 else pa.int64()) for k, c in enumerate(out[:6])), pa.array(out[6], pa.list_(pa.int64()))], names)

    return run


def compare(docs: DataFrame, pairs: DataFrame, width: int, edits: bool = False) -> DataFrame:
    """The pairs (hub, member) with the sizes of their full sets and of what these have in common; with ``edits`` also what either has alone.

    Each member's set goes once to each of its hubs; a hub's partners are compared as they stream by in sorted
    order.  A hub with many partners is dealt over salts, each with its own copy of the hub's set.
    """
    spark = docs.sparkSession
    sizes = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / GROUP_ROWS).cast("int").alias("salts"))
    # only hubs with more than one salt, one in GROUP_ROWS pairs at most, have to be told to their pairs
    crowded = written(sizes.where("salts > 1"), "near-hubs")
    if 32 * crowded.count() <= BROADCAST_BYTES:
        salted = pairs.join(F.broadcast(crowded), "hub", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    else:
        salted = pairs.join(sizes, "hub")
    tasks = salted.select("hub", "member", F.pmod(F.xxhash64("member", "hub"), F.col("salts")).cast("int").alias("salt"))
    mine = tasks.groupBy(F.col("member").alias("doc_id")).agg(F.collect_list(F.struct("hub", "salt")).alias("hubs"))
    plan = mine.join(sizes.withColumnRenamed("hub", "doc_id"), "doc_id", "full_outer")
    plan = written(plan, "near-plan")
    discard(crowded)
    size = plan.agg(F.sum(F.lit(48) + 32 * F.coalesce(F.size("hubs"), F.lit(0)))).first()[0] or 0
    few = size <= BROADCAST_BYTES
    texts = docs.join(F.broadcast(plan) if few else plan, "doc_id").select("doc_id", "hubs", "salts", "text")
    shipped = texts.mapInArrow(_shipped(width), "hub long, salt int, first int, member long, hashes binary")
    dealt = shipped.repartition(partitions(spark), "hub", "salt").sortWithinPartitions("hub", "salt", "first")
    return dealt.mapInArrow(_compared(edits), _COMPARED)


def open_pairs(compared: DataFrame, comp: DataFrame, percent: int) -> DataFrame:
    """Pairs (hub, member) of partners of one hub that may be similar enough though their components differ so far.

    Relative to the hub a set is a list of edits: hub tokens that it lacks and tokens of its own.  Two partners x and y have
    |hub| - |lacks x| - |lacks y| + (edits in common) tokens in common.  With weight s = share * |set| + |lacks|, where share is
    percent / (100 + percent), they are similar if and only if they share at least need = s(x) + s(y) - |hub| edits.  need is
    positive unless both are similar to the hub.  So a pair shares one of x's first |edits| - need + 1 edits with
    y's, in any common order; in order of rarity among the hub's partners few do by chance.  As need depends on both, weights are
    cut into levels: an edit is listed under its own member's level and each level of the other for which it comes early enough.
    """
    # what is known of a hub goes to each of its salts, so no hub's partners meet in one task
    salts = compared.groupBy("hub").agg(F.explode(F.sequence(F.lit(0), F.max("salt"))).alias("salt"))
    c = comp.select("node", "component")
    hub_comps = salts.join(c.select(F.col("node").alias("hub"), F.col("component").alias("hub_comp")), "hub")
    rows = compared.join(hub_comps, ["hub", "salt"], "left").withColumn("hub_comp", F.coalesce("hub_comp", "hub"))
    rows = rows.join(c.select(F.col("node").alias("member"), F.col("component").alias("comp")), "member", "left").withColumn("comp", F.coalesce("comp", "member"))
    share = percent / (100 + percent)
    # weights above that of the hub itself, in steps of a 32nd of the hub's size
    rows = rows.withColumn("weight", F.expr(f"{share!r}D * (n - hub_n) + (hub_n - common)")).withColumn("step", F.expr("greatest(1D, hub_n / 32D)"))
    rows = rows.withColumn("level", F.expr("cast(least(12D, floor(weight / step + 1e-9)) as int)")).withColumn("size", F.size("edits"))
    # need(b) = weight + b * step - (1 - 2 * share) * hub_n for the lower end of level b
    rows = rows.withColumn("slack", F.expr(f"size + 1 - weight + {1 - 2 * share!r}D * hub_n + 1e-6"))
    rows = written(rows.drop("weight", "hub_n", "common"), "near-rows")
    # levels that some member of the hub has, and those of members outside the hub's component, without which a hub has no open pairs
    levels = rows.groupBy("hub").agg(F.collect_set("level").alias("all_levels"), F.collect_set(F.when(F.col("comp") != F.col("hub_comp"), F.col("level"))).alias("away_levels"))
    levels = salts.join(levels.where(F.size("away_levels") > 0), "hub")
    edits = rows.join(levels, ["hub", "salt"]).select("hub", "salt", "member", "n", "comp", "hub_comp", "level", "slack", "step", "all_levels", "away_levels", F.explode("edits").alias("edit"))
    edits = written(edits, "near-edits")
    part = edits.groupBy("hub", "salt", "edit").agg(F.count(F.lit(1)).alias("k"))
    rare = part.join(part.groupBy("hub", "edit").agg(F.sum("k").alias("df")).where("df > 1"), ["hub", "edit"]).drop("k")
    # edits that no other partner has come first in order of rarity; they only move the others' places
    place = F.row_number().over(Window.partitionBy("hub", "salt", "member").orderBy("df", "edit"))
    heads = edits.join(rare, ["hub", "salt", "edit"], "left").withColumn("df", F.coalesce("df", F.lit(1))).withColumn("place", place).where("df > 1 AND place <= slack")
    heads = heads.withColumn("top", F.expr("least(12D, floor((slack - place) / step))"))
    others = F.expr("filter(CASE WHEN comp <> hub_comp THEN all_levels ELSE away_levels END, b -> b <= top)")
    heads = heads.select("hub", "edit", "member", "n", "comp", "hub_comp", "level", F.explode(others).alias("other"))
    heads = written(heads, "near-heads")
    discard(rows, edits)
    x = heads.where("comp <> hub_comp").select("hub", "edit", F.col("level").alias("lx"), F.col("other").alias("ly"), F.col("member").alias("x"), F.col("n").alias("x_n"), F.col("comp").alias("x_comp"))
    y = heads.select("hub", "edit", F.col("other").alias("lx"), F.col("level").alias("ly"), "member", "n", "comp")
    both = x.join(y, ["hub", "edit", "lx", "ly"]).where("x <> member AND x_comp <> comp").where(f"100 * least(n, x_n) >= {percent} * greatest(n, x_n)")
    pairs = written(both.select(F.least("x", "member").alias("hub"), F.greatest("x", "member").alias("member")).distinct(), "near-cross")
    discard(heads)
    return pairs


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75, halves: int = 14, rows: int = 3, seed: int = 41) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs.

    Documents with 100 * intersection >= percent * union of their shingle sets are linked; a component's id is its smallest
    doc_id.  Texts of fewer than ``width`` words are one shingle; texts without words, and null ones, are linked
    with nothing.  Repeated rows of one id are one document and share its answer: the one with its largest text.  Rows with a
    null id are linked with nothing and kept.
    """
    d = identified(docs, id_col, text_col)
    sketches = written(d.mapInArrow(_sketcher(width, halves, rows, seed), "doc_id long, n long, f1 long, f2 long, keys array<long>"), "near-sketches")
    known = sketches.where("n > 0 AND doc_id IS NOT NULL")
    # copies of a set are one class, stood for by its smallest id
    classes = known.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep"))
    reps = written(known.join(classes, ["f1", "f2", "n"]).where("doc_id = rep").select("rep", "n", "keys").dropDuplicates(["rep", "n"]), "near-reps")
    halved = reps.select("rep", "n", F.posexplode("keys").alias("slot", "value"))
    shared = halved.groupBy("slot", "value").agg(F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    alive = halved.join(shared, ["slot", "value"]).groupBy("rep", "n").agg(F.collect_list(F.struct("slot", "value")).alias("h"))
    left, right = F.filter("h", lambda x: x["slot"] < halves), F.filter("h", lambda x: x["slot"] >= halves)
    keys = alive.select("rep", "n", F.explode(left).alias("x"), right.alias("ys")).select("rep", "n", "x", F.explode("ys").alias("y")).select(F.xxhash64("x.slot", "x.value", "y.slot", "y.value").alias("key"), "rep", "n")
    keys = written(keys, "near-keys")
    counts = keys.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    hits = written(keys.join(counts, "key"), "near-hits")
    degrees = hits.groupBy("rep").agg(F.sum(F.col("c") - 1).alias("degree"))
    ranked = hits.join(degrees, "rep")
    hubs = ranked.groupBy("key").agg(F.max(F.struct("degree", (-F.col("rep")).alias("r"))).alias("m")).select("key", (-F.col("m.r")).alias("hub"))
    stars = written(hits.join(hubs, "key").where("rep <> hub").select("hub", F.col("rep").alias("member")).distinct(), "near-stars")
    linked = f"100 * common >= {percent} * (hub_n + n - common)"
    compared = written(compare(d, stars, width, edits=True), "near-compared")
    links = compared.where(linked).select(F.col("hub").alias("a"), F.col("member").alias("b"))
    comp = components(links)
    cross = open_pairs(compared, comp, percent)
    if not cross.isEmpty():
        more = written(compare(d, cross, width).where(linked).select(F.col("hub").alias("a"), F.col("member").alias("b")), "near-links")
        if not more.isEmpty():
            comp = components(links.unionByName(more))
        discard(more)
    discard(reps, keys, hits, stars, compared, cross)
    final = classes.join(comp, classes["rep"] == comp["node"], "left").select("f1", "f2", "n", F.coalesce("component", "rep").alias("component_id"))
    out = sketches.join(final, ["f1", "f2", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id")).cast("long").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", **kw) -> DataFrame:
    """docs without those that nearly repeat a document with a smaller id; all columns stay."""
    gone = written(near_duplicates(docs, id_col=id_col, **kw).where("NOT kept").select(F.col("doc_id").alias("gone")).distinct(), "near-gone")
    few = 32 * gone.count() <= BROADCAST_BYTES
    return docs.join(F.broadcast(gone) if few else gone, docs[f"`{id_col}`"].cast("long") == gone["gone"], "left_anti")


def op5_near_dedup(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{20}\x{09}-\x{0D}]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS sh FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM x JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 75 * (na.n + nb.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS lab FROM w UNION SELECT e.b, r.lab FROM r JOIN e ON e.a = r.node AND r.lab < e.b),
c AS (SELECT node, min(lab) AS lab FROM r GROUP BY node)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.lab AS component_id, w.doc_id = c.lab AS kept FROM w LEFT JOIN n USING (doc_id) JOIN c ON c.node = w.doc_id
"""
