"""Documents linked by the Jaccard similarity of their word n-grams, found by signature trees (operator 11).

A document is the set of its distinct five-word shingles. Two documents link when their common shingles are at least
PER_CENT of 100 of all shingles of both. Equal sets are joined first, so what follows sees different sets only.

Sets are dealt out without losing a link: shingles are ordered by how many documents hold them, rarest first, and two sets that
link share one of the first n - ceil(n * PER_CENT / 100) + 1 of each. Frequencies cover all documents; a shingle that one document
alone holds needs no key. The members of a key make a signature tree: each node holds the bitmaps of its sets' shingles combined by OR, the
range of their sizes, the most shingles that share a bit, and how much of a set can still be common where the key is the first common shingle. Two trees, or one with itself,
are traversed level by level, and a pair of nodes goes no further when its maximum possible overlap is below what its least sizes
need. Pairs of sets that remain are compared shingle by shingle, unless both are in one component by then.

A first round deals sets by pairs of least hashes, which joins most of what belongs together, and splits large keys
freely; the second round is the exact one, and takes only keys whose members are in several components and near enough in
size. A key with many members is cut into chunks by size and hash; the pairs of its chunks are again pruned by sizes and components, and each goes to a task of its own.

Defined results: a null text is the empty string; documents without words have an empty set, link with nothing and are their own component;
every row is a document of its own, also with a null or repeated id; a component has the smallest id in it, null if it has
none; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW_BITS, partitions, read_table, unpacked, written
from .near_dedup import answered, components, distinct_of, encoded_sets, exact_frequencies, fingerprints, text_packs

PER_CENT = 80
#: What is no white space.
WORDLIKE = np.array([i != 32 and not 9 <= i <= 13 for i in range(256)])
#: Pairs of least hashes of the first round.
BANDS = 6
#: Members of a leaf and of an inner node; bits of a bitmap for each shingle of a set; cells of bitmaps compared at a time.
FAN, BITS_A_SHINGLE, CELLS = 8, 4, 1 << 20
#: Most members and bytes of a tree; bytes of sets in one task; steps of size between chunks.
MEMBERS, TREE_BYTES, TASK_BYTES, SIZE_STEP = 512, 8_000_000, 16_000_000, 1.25
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
SEEDS = np.random.default_rng(11).integers(1, 2**63, 2 * BANDS, dtype=np.uint64)
MEMBER = "team long, side int, node long, reach long, part long, shingles binary"


def shingle_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within it; their counts; where each text's begin (and the end)."""
    return encoded_sets([t.encode().lower() for t in texts], WORDLIKE)


def least_common(n: int) -> int:
    """The least shingles that a set of n shares with any set that it links with."""
    return -(-n * PER_CENT // 100)


def linked(common: int, n: int, m: int) -> bool:
    return 100 * common >= PER_CENT * (n + m - common)


def _hashed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX[0]
    return (x ^ (x >> np.uint64(29))) * MIX[1]


def prefix(shingles: np.ndarray, df: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a set and their places in its order; shingles that no other document holds are left out."""
    order = np.lexsort((shingles, df))[: len(shingles) - least_common(len(shingles)) + 1]
    place = np.flatnonzero(df[order] > 1)
    return shingles[order[place]], place


def least_pairs(shingles: np.ndarray) -> np.ndarray:
    """BANDS keys, each of two least hashes."""
    least = [int(_hashed(shingles ^ s).min()) for s in SEEDS]
    return np.array([(a * 0x9E3779B97F4A7C15 + b + i * 0xD6E8FEB86659FD93) % (1 << 64) for i, (a, b) in enumerate(zip(least[::2], least[1::2], strict=True))], np.uint64)


class SignatureTree:
    """Sets in the order of size; levels of nodes from the sets themselves up to one root."""

    def __init__(self, sets: list[np.ndarray], reach: np.ndarray, part: np.ndarray, bits: int):
        sizes = np.array([len(s) for s in sets], np.int64)
        self.order = np.lexsort((part, sizes))
        self.sets, shift, maps = [sets[i] for i in self.order], np.uint64(65 - bits.bit_length()), np.zeros((len(sets), bits), bool)
        for row, s in zip(maps, self.sets, strict=True):
            row[(s >> shift).astype(np.int64)] = True
        packed = np.packbits(maps, axis=1).view(np.uint64)
        sizes = sizes[self.order]
        # OR of the bitmaps, least and most size, most shingles that share a bit with another one, most that can be common, component or -1
        level = (packed, sizes, sizes, sizes - maps.sum(axis=1), reach[self.order], part[self.order])
        self.levels = [level]
        while len(level[0]) > 1:
            at = np.arange(0, len(level[0]), FAN)
            low, high = np.minimum.reduceat(level[5], at), np.maximum.reduceat(level[5], at)
            joined = [f.reduceat(x, at) for f, x in zip((np.bitwise_or, np.minimum, np.maximum, np.maximum, np.maximum), level[:5], strict=True)]
            level = (*joined, np.where(low == high, low, -1))
            self.levels.append(level)


def possible(x: tuple, i: np.ndarray, y: tuple, j: np.ndarray) -> np.ndarray:
    """Of the pairs of nodes i of level x and j of level y those that may hold a link between components."""
    most = np.minimum.reduce((x[2][i], y[2][j], x[4][i], y[4][j]))
    least = x[1][i] + y[1][j]
    keep = (100 * x[2][i] >= PER_CENT * y[1][j]) & (100 * y[2][j] >= PER_CENT * x[1][i]) & ((100 + PER_CENT) * most >= PER_CENT * least) & ((x[5][i] != y[5][j]) | (x[5][i] < 0))
    at = np.flatnonzero(keep)
    step = max(1, CELLS // x[0].shape[1])
    for k in range(0, len(at), step):
        a, b = i[at[k : k + step]], j[at[k : k + step]]
        common = np.bitwise_count(x[0][a] & y[0][b]).sum(axis=1, dtype=np.int64) + np.minimum(x[3][a], y[3][b])
        keep[at[k : k + step]] = (100 + PER_CENT) * common >= PER_CENT * (x[1][a] + y[1][b])
    return keep


def traverse(a: SignatureTree, b: SignatureTree | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets, by their places in the trees, that no pair of nodes above them rules out; without b those within a."""
    other = b or a
    tops = len(a.levels), len(other.levels)
    i = j = np.zeros(1, np.int64)
    x, y = tops[0] - 1, tops[1] - 1
    while True:
        keep = possible(a.levels[x], i, other.levels[y], j) if b or x else (i < j)
        i, j = i[keep], j[keep]
        if not b and not x:
            keep = possible(a.levels[0], i, a.levels[0], j)
            return i[keep], j[keep]
        if x == y == 0:
            return i, j
        down_x, down_y = x >= y and x > 0, y >= x and y > 0  # the deeper tree first, then both together
        x, y = x - down_x, y - down_y
        child = np.arange(FAN)
        ci = i[:, None, None] * FAN + child[None, :, None] if down_x else i[:, None, None]
        cj = j[:, None, None] * FAN + child[None, None, :] if down_y else j[:, None, None]
        ci, cj = (z.ravel() for z in np.broadcast_arrays(ci, cj))
        there = (ci < len(a.levels[x][1])) & (cj < len(other.levels[y][1]))
        if not b:
            there &= ci <= cj
        i, j = ci[there], cj[there]


def common_shingles(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def tree_links(rows: pd.DataFrame) -> pd.DataFrame:
    """leader, member: links between the members (MEMBER) of each team that join components which are apart (by part, or for this task)."""
    rows = rows.sort_values(["team", "side"], kind="stable")
    team, side, node, part = (rows[c].to_numpy() for c in ("team", "side", "node", "part"))
    reach, every = rows.reach.to_numpy(), [np.frombuffer(s, np.uint64) for s in rows.shingles]
    top: dict[int, int] = {}

    def head(x: int) -> int:
        while x in top:
            if top[x] in top:
                top[x] = top[top[x]]
            x = top[x]
        return x

    starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(team)), bool), team[1:] != team[:-1])))
    links = []
    for start, stop in zip(starts.tolist(), [*starts[1:].tolist(), len(team)], strict=True):
        heads = np.array([head(p) for p in part[start:stop].tolist()], np.int64)
        if stop - start < 2 or (heads == heads[0]).all():
            continue
        sets = every[start:stop]
        bits = 1 << max(8, min(16, int(BITS_A_SHINGLE * np.median([len(s) for s in sets])).bit_length()))
        cut = int(np.searchsorted(side[start:stop], 1))
        trees, froms = [], []
        for x, y in ((0, cut), (cut, stop - start)):
            if x < y:
                trees.append(SignatureTree(sets[x:y], reach[start + x : start + y], heads[x:y], bits))
                froms.append(start + x + trees[-1].order)
        if len(trees) == 1 and cut < stop - start:
            continue  # one side only: nothing to compare it with
        i, j = traverse(*trees)
        for a, b in zip(froms[0][i].tolist(), froms[-1][j].tolist(), strict=True):
            p, q = head(int(part[a])), head(int(part[b]))
            if p != q and linked(common_shingles(every[a], every[b]), len(every[a]), len(every[b])):
                top[max(p, q)] = min(p, q)
                links.append((min(int(node[a]), int(node[b])), max(int(node[a]), int(node[b]))))
    return pd.DataFrame(links, columns=["leader", "member"], dtype=np.int64)


def signed(packs: DataFrame, frequencies: DataFrame, bits: int) -> DataFrame:
    """node, doc_id, digest (of the set; null if it is empty), n of every row; of equal texts in a pack one has keys, places and bands, if it can have links."""

    def sign(_key, pack: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out, df = [], answered(answers).astype(np.int64)
        for batch, blob in zip(pack.batch.tolist(), pack.blob, strict=True):
            rows = unpacked(blob)
            texts, of, _ = distinct_of(rows.column("text").to_pylist())
            found, _, begin = shingle_sets(texts)
            held, told = df[fingerprints(found, bits)[1]], np.zeros(len(texts), bool)
            ends = begin.tolist()
            digests = [hashlib.blake2b(found[a:b].tobytes(), digest_size=16).digest() if a < b else None for a, b in zip(ends[:-1], ends[1:], strict=True)]
            for row, (doc_id, k) in enumerate(zip(rows.column("doc_id").to_pylist(), of.tolist(), strict=True)):
                a, b = ends[k : k + 2]
                keys = places = bands = None
                if a < b and not told[k]:
                    told[k] = True
                    x, y = prefix(found[a:b], held[a:b])
                    if len(x):
                        keys, places, bands = x.view(np.int64), y, least_pairs(found[a:b][held[a:b] > 1]).view(np.int64)
                out.append((batch << ROW_BITS | row, doc_id, digests[k], b - a, keys, places, bands))
        frame = pd.DataFrame(out, columns=["node", "doc_id", "digest", "n", "keys", "places", "bands"])
        return frame.astype({"doc_id": "Int64"})

    schema = "node long, doc_id long, digest binary, n long, keys array<long>, places array<long>, bands array<long>"
    return packs.groupBy("batch").cogroup(frequencies.groupBy("batch")).applyInPandas(sign, schema)


def sets_of(packs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, shingles of each of nodes (node), made from the packs."""

    def read(packs: pa.Table, asked: pa.Table) -> pa.Table:
        nodes = np.sort(asked.column("node").to_numpy().astype(np.int64))
        texts = [t or "" for blob in packs.column("blob") for t in unpacked(blob.as_buffer()).column("text").take(nodes & ((1 << ROW_BITS) - 1)).to_pylist()]
        found, _, begin = shingle_sets(texts)
        sets = [found[a:b].tobytes() for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
        return pa.table({"node": pa.array(nodes, pa.int64()), "shingles": pa.array(sets, pa.binary())})

    asked = nodes.select(F.shiftright("node", ROW_BITS).alias("batch"), "node")
    return packs.groupBy("batch").cogroup(asked.groupBy("batch")).applyInArrow(read, "node long, shingles binary")


def _joined(rows: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """Links of the members in rows (team, side, node, n, reach, part), whose sets come to them."""
    rows = written(rows, f"{name}-members")
    size = 8 * (rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    tasks = max(partitions(rows.sparkSession), -(-size // TASK_BYTES))
    dealt = rows.withColumn("task", F.pmod(F.xxhash64("team"), F.lit(tasks))).join(sets, "node")
    columns = ["task", *(c.split()[0] for c in MEMBER.split(", "))]
    return written(dealt.select(*columns).groupBy("task").applyInPandas(tree_links, "leader long, member long"), f"{name}-links")


def first_links(bands: DataFrame, sets: DataFrame) -> DataFrame:
    """Links among the members (node, n, key) of the least hashes; large keys are split."""
    many = bands.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("size")).where("members > 1")
    chunks = F.greatest(F.ceil(F.col("members") / MEMBERS), F.ceil(8 * F.col("size") / TREE_BYTES))
    team = F.xxhash64("key", F.pmod(F.xxhash64("key", "node"), chunks))  # another split for each key
    rows = bands.join(written(many, "ngram-bands"), "key").select(team.alias("team"), F.lit(0).alias("side"), "node", "n", F.col("n").alias("reach"), F.col("node").alias("part"))
    return _joined(rows, sets, "ngram-first")


def exact_links(met: DataFrame, parts: DataFrame, sets: DataFrame) -> DataFrame:
    """All links between the components (parts: doc_id, class_id) of the members (key, node, n, place)."""
    known = parts.select(F.col("doc_id").alias("node"), F.col("class_id"))
    rows = written(met.join(known, "node", "left").select("key", "node", "n", (F.col("n") - F.col("place")).alias("reach"), F.coalesce("class_id", "node").alias("part")), "ngram-rows")
    for _ in range(2):  # keys of one component, and members that no other one can reach from here, go
        facts = rows.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.min("n").alias("least")).where("low < high").drop("low", "high")
        near = (100 + PER_CENT) * F.col("reach") >= PER_CENT * (F.col("n") + F.col("least"))
        rows = written(rows.join(written(facts, "ngram-keys"), "key").where(near).drop("least"), "ngram-rows")
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("size")).where("members > 1")
    cuts = F.greatest(F.ceil(F.col("members") / MEMBERS), F.ceil(8 * F.col("size") / TREE_BYTES))
    step = F.when(F.col("cuts") > 1, F.floor(F.log(SIZE_STEP, "n"))).otherwise(0)
    rows = rows.join(written(sizes.select("key", cuts.alias("cuts")), "ngram-sizes"), "key").withColumn("step", step.cast("int")).withColumn("salt", F.pmod(F.xxhash64("node"), "cuts").cast("int"))
    rows = written(rows, "ngram-cut")
    chunk = rows.groupBy("key", "step", "salt").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("part").alias("low"), F.max("part").alias("high"))
    chunk = written(chunk, "ngram-chunks")
    one, two = (chunk.select("key", *[F.col(c).alias(f"{s}_{c}") for c in ("step", "salt", "least", "most", "low", "high")]) for s in "ab")
    once = F.struct("a_step", "a_salt") <= F.struct("b_step", "b_salt")
    sizes_meet = (100 * F.col("a_most") >= PER_CENT * F.col("b_least")) & (100 * F.col("b_most") >= PER_CENT * F.col("a_least"))
    apart = F.least("a_low", "b_low") < F.greatest("a_high", "b_high")
    pairs = one.join(two, "key").where(once & sizes_meet & apart)
    pairs = written(pairs.select("key", "a_step", "a_salt", "b_step", "b_salt", F.xxhash64("key", "a_step", "a_salt", "b_step", "b_salt").alias("team")), "ngram-pairs")
    sides = []
    for side, s in enumerate("ab"):
        wanted = pairs if side == 0 else pairs.where("a_step <> b_step OR a_salt <> b_salt")
        at = wanted.select("key", F.col(f"{s}_step").alias("step"), F.col(f"{s}_salt").alias("salt"), "team")
        sides.append(rows.join(at, ["key", "step", "salt"]).select("team", F.lit(side).alias("side"), "node", "n", "reach", "part"))
    return _joined(sides[0].unionByName(sides[1]), sets, "ngram-exact")


def ngram_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    packs, _, bits, parts = text_packs(docs, ["doc_id", "text"])
    frequencies = written(exact_frequencies(packs, bits, parts, shingle_sets), "ngram-frequencies")
    rows = written(signed(packs, frequencies, bits), "ngram-signed")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "node"))
    told = F.min(F.when(F.col("keys").isNotNull(), F.struct("node", "keys", "places", "bands")))
    firsts = rows.where("digest IS NOT NULL").groupBy("digest").agg(least.alias("x"), F.max("n").alias("n"), told.alias("t"))
    firsts = written(firsts.select("digest", "n", "x.doc_id", F.coalesce("t.node", "x.node").alias("node"), "t.keys", "t.places", "t.bands"), "ngram-firsts")
    keyed = firsts.select("node", "n", F.explode(F.arrays_zip("keys", "places")).alias("k")).select("node", "n", F.col("k.keys").alias("key"), F.col("k.places").alias("place"))
    shared = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("key"), "ngram-shared")
    met = written(keyed.join(shared, "key"), "ngram-met")
    open_nodes = written(met.select("node").distinct(), "ngram-open")
    sets = written(sets_of(packs, open_nodes), "ngram-sets")
    bands = firsts.join(open_nodes, "node").select("node", "n", F.explode("bands").alias("key")).distinct()
    links = first_links(bands, sets)
    links = links.unionByName(exact_links(met, components(links), sets))
    of_node = components(links).select(F.col("doc_id").alias("node"), F.col("class_id"))
    placed = written(firsts.select("digest", "doc_id", "node").join(of_node, "node", "left").select("digest", "doc_id", F.coalesce("class_id", "node").alias("part")), "ngram-placed")
    heads = placed.groupBy("part").agg(F.min("doc_id").alias("component_id"))
    heads = written(placed.select("digest", "part").join(heads, "part").select("digest", "component_id"), "ngram-heads")
    alone = rows.where("digest IS NULL").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "digest").join(heads, "digest").drop("digest").unionByName(alone)


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(read_table(spark, sf_dir, "documents"))


#: The same rows by all pairs of sets that share a shingle, for small tables.
ORACLE_SQL = r"""
WITH RECURSIVE texts AS (SELECT coalesce(text, '') AS text, min(doc_id) AS node FROM documents GROUP BY coalesce(text, '')),
words AS (SELECT node, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM texts),
grams AS (SELECT node, unnest(list_distinct(list_transform(range(1, len(ws) - least(5, len(ws)) + 2), lambda i: array_to_string(ws[i:i + least(5, len(ws)) - 1], ' ')))) AS gram FROM words WHERE len(ws) > 0),
sizes AS (SELECT node, count(*) AS n FROM grams GROUP BY node),
few AS (SELECT gram FROM grams GROUP BY gram HAVING count(*) > 1),
useful AS (SELECT g.node, g.gram FROM grams g JOIN few f ON g.gram = f.gram),
links AS (SELECT a.node AS a, b.node AS b FROM useful a JOIN useful b ON a.gram = b.gram AND a.node < b.node JOIN sizes x ON x.node = a.node JOIN sizes y ON y.node = b.node
  GROUP BY a.node, b.node, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reached r JOIN edges e ON r.b = e.a),
classes AS (SELECT t.node, least(t.node, coalesce(min(b), t.node)) AS component_id FROM texts t LEFT JOIN reached ON a = t.node GROUP BY t.node)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, CASE WHEN s.n IS NULL THEN d.doc_id ELSE c.component_id END AS component_id
FROM documents d JOIN texts t ON t.text = coalesce(d.text, '') JOIN classes c ON c.node = t.node LEFT JOIN sizes s ON s.node = t.node
"""
