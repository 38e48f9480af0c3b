"""SimHash near-duplicate classes.

Fingerprints within a radius are found exactly: the 64 bits are cut into blocks, and two
fingerprints at most `radius` bits apart agree on all but `radius` of them at least, so a row is dealt
to one bucket for every choice of that many blocks. A bucket is compared bit-sliced: bit planes stand
vertically, distances of many lanes are counted at once by carry-save adders over whole words, and
lanes are abandoned once every one of them is beyond the radius. Buckets over TILE rows are compared
in pairs of sub-blocks, each in a task of its own, so that a hot bucket spreads over the cluster.
Buckets return links that span their components and not all pairs.

A similarity of 0.8 lies far beyond a radius that so few bits can search. `text_classes` therefore takes SimHash links as likely pairs only: each is
compared exactly, so that groups of near copies are known, and the pairs between different groups are completed by prefix filtering over the
sets of shingles, which loses no pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import accumulate, combinations
from math import ceil

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, partitions, table, written
from .components import connected_components

SHINGLE, RADIUS, TILE, SMALL = 4, 4, 2048, 16
#: Rows that a bucket of the exact search may hold on average before the bits are cut into more blocks.
EXACT_ROWS = 512
#: Of similar_texts: words a shingle, Jaccard similarity, least shingles a text is led by; rows sampled for common shingles, how many of these are kept, and classes of a set's tally.
SIMILAR_SHINGLE, SIMILARITY, LEADS, SAMPLE_ROWS, COMMON, CLASSES = 5, 0.8, 4, 10_000, 300_000, 128


def shingle_hashes(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Unsigned XXH64 (seed 42) of each k-word shingle of the text with A-Z lower-cased, repeats included."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes split at 0x20 and 0x09-0x0D only
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words)))
    starts = [0, *ends[:-1]]
    digest = xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([digest(joined, 42)], np.uint64)
    return np.fromiter((digest(joined[a : b - 1], 42) for a, b in zip(starts, ends[k - 1 :])), np.uint64, len(words) - k + 1)


def simhash(text: str | None, k: int = SHINGLE) -> int:
    return majority(shingle_hashes(text, k))


def majority(h: np.ndarray) -> int:
    """The bits that are 1 in over half the hashes."""
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):  # bounded memory for very long texts
        ones += np.unpackbits(h[at : at + 4096].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, text: str = "text", k: int = SHINGLE) -> DataFrame:
    """docs' doc_id with `fp` (bigint), the SimHash of the text. A null or wordless text has fingerprint 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": np.array([simhash(t, k) for t in b["text"]], np.uint64).view(np.int64)})

    # pandas turns a bigint column with nulls into floats, so the id goes as text
    kept = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col(text).alias("text"))
    return kept.mapInPandas(run, "doc_id string, fp long").withColumn("doc_id", F.col("doc_id").cast("long"))


def bits_of(fps: np.ndarray) -> np.ndarray:
    """The bits of fingerprints (n, words) as bytes (n, 64 words)."""
    return np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(len(fps), -1), axis=1, bitorder="little")


def planes_of(fps: np.ndarray) -> np.ndarray:
    """Bit planes of fingerprints (n, words): 64 rows of words for each word, lane i at bit i."""
    lanes = -len(fps) % 64
    bits = bits_of(fps)
    bits = np.concatenate([bits, np.zeros((lanes, bits.shape[1]), np.uint8)]) if lanes else bits
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def _beyond(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose bitwise counter is over the radius."""
    over, same = np.zeros_like(counter[0]), ~np.zeros_like(counter[0])
    for i in reversed(range(len(counter))):
        if radius >> i & 1:
            same = same & counter[i]
        else:
            over = over | (same & counter[i])
            same = same & ~counter[i]
    return over


def lanes_within(differ, shape: tuple[int, ...], radius: int, bits: int = 64) -> np.ndarray:
    """Words whose set bits are the lanes at most `radius` apart. differ(i, rows) has plane i of the XOR, for the rows still open.

    Two planes enter the counters at a time through a carry-save adder; rows all of whose lanes are beyond the radius are given up.
    """
    out = np.zeros(shape, np.uint64)
    rows = np.arange(shape[0])
    counter = [np.zeros(shape, np.uint64) for _ in range(bits.bit_length())]
    for i in range(0, bits, 2):
        a, b = differ(i, rows), differ(i + 1, rows)
        half = counter[0] ^ a
        carry = (counter[0] & a) | (half & b)
        counter[0] = half ^ b
        for k in range(1, (i + 2).bit_length()):
            counter[k], carry = counter[k] ^ carry, counter[k] & carry
        if i % 8 == 6 and i >= 2 * radius + 6:
            open_ = ~_beyond(counter, radius).reshape(len(rows), -1)
            live = open_.any(1)
            if not live.all():
                rows, counter = rows[live], [c[live] for c in counter]
                if not len(rows):
                    return out
    out[rows] = ~_beyond(counter, radius)
    return out


def pairs_within(fps: np.ndarray, i: np.ndarray, j: np.ndarray, radius: int) -> np.ndarray:
    """Which of the pairs (i, j) are within the radius, 64 pairs to a lane word."""
    keep = np.zeros(len(i), bool)
    for at in range(0, len(i), 65536):
        planes = planes_of(fps[i[at : at + 65536]] ^ fps[j[at : at + 65536]])
        words = lanes_within(lambda p, rows: planes[p][rows, None], (planes.shape[1], 1), radius, len(planes))
        keep[at : at + 65536] = np.unpackbits(words[:, 0].view(np.uint8), bitorder="little")[: len(i[at : at + 65536])].astype(bool)
    return keep


def spanning(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) that span the components of all pairs within the radius among the fingerprints."""
    n = len(fps)
    planes = planes_of(fps)
    adj = np.empty((n, planes.shape[1]), np.uint64)
    for at in range(0, n, 256):
        masks = np.where(bits_of(fps[at : at + 256]), ~np.uint64(0), np.uint64(0))
        adj[at : at + 256] = lanes_within(lambda p, rows: planes[p][None, :] ^ masks[rows, p][:, None], (len(masks), planes.shape[1]), radius, len(planes))
    left = np.unpackbits(np.zeros(planes.shape[1], np.uint64).view(np.uint8))
    left[:n] = 1
    left = np.packbits(left, bitorder="little").view(np.uint64)
    a, b = [], []
    for root in range(n):
        if not int(left[root >> 6]) >> (root & 63) & 1:
            continue
        left[root >> 6] &= ~(np.uint64(1) << np.uint64(root & 63))
        todo = [root]
        while todo:
            x = todo.pop()
            new = adj[x] & left
            if new.any():
                left &= ~new
                found = np.flatnonzero(np.unpackbits(new.view(np.uint8), bitorder="little")).tolist()
                a += [root] * len(found)
                b += found
                todo += found
    return np.array(a, np.int64), np.array(b, np.int64)


def _links(radius: int):
    def group_links(own, starts):
        """Links of the buckets that begin at the given places of one sorted run."""
        fps, sizes = own.view(np.uint64)[:, None], np.diff(starts)
        us, vs = [], []
        for m in range(2, SMALL + 1):
            first = starts[:-1][sizes == m]
            if len(first):
                i, j = np.triu_indices(m, 1)
                i, j = (first[:, None] + i).ravel(), (first[:, None] + j).ravel()
                ok = pairs_within(fps, i, j, radius)
                us.append(own[i[ok]])
                vs.append(own[j[ok]])
        for s, m in zip(starts[:-1][sizes > SMALL], sizes[sizes > SMALL]):
            i, j = spanning(fps[s : s + m], radius)
            us.append(own[s + i])
            vs.append(own[s + j])
        return pd.DataFrame({"u": np.concatenate(us), "v": np.concatenate(vs)}) if us else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None  # rows of the last bucket, which may go on in the next batch
        for b in batches:
            if not len(b):
                continue
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            key = b[["bucket", "tile"]].to_numpy(np.int64)
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            last = int(cuts[-1]) if len(cuts) else 0
            rest = b.iloc[last:]
            if last:
                out = group_links(b["fp"].to_numpy(np.int64), np.array([0, *cuts.tolist()]))
                if out is not None and len(out):
                    yield out
        if rest is not None:
            out = group_links(rest["fp"].to_numpy(np.int64), np.array([0, len(rest)]))
            if out is not None and len(out):
                yield out

    return run


def blocks_for(n: int, radius: int = RADIUS) -> int:
    """Blocks to cut 64 bits into, so that a bucket of n even fingerprints holds EXACT_ROWS at most: two more than the radius at least. Every choice is exact."""
    blocks = radius + 2
    while blocks < 64 and n / 2 ** (64 * (blocks - radius) / blocks) > EXACT_ROWS:
        blocks += 1
    return blocks


def near_links(nodes: DataFrame, radius: int, blocks: int, tile: int = TILE) -> DataFrame:
    """(u, v): links between distinct `fp`s, spanning the components of all pairs within the radius."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    keys = []
    for t, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << edges[c + 1]) - (1 << edges[c])) for c in chosen)
        mask -= (mask >> 63) << 64
        keys.append(F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(mask))))
    return bucket_links(nodes.select("fp", F.explode(F.array(*keys)).alias("bucket")), radius, tile)


def bucket_links(dealt: DataFrame, radius: int, tile: int = TILE) -> DataFrame:
    """(u, v): links of fingerprints (bucket, fp) within the radius, by bucket; hot buckets are cut into tiles."""
    n = partitions(dealt.sparkSession)
    sizes = dealt.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    hot = written(sizes.filter(F.col("n") > tile).select("bucket", F.ceil(F.col("n") / tile).cast("int").alias("cuts")), "hot-buckets")
    dealt = dealt.join(hot, "bucket", "left")
    own = F.pmod(F.xxhash64("fp", "bucket"), F.col("cuts")).cast("int")
    pair = lambda i: F.least(own, i).cast("long") * F.col("cuts") + F.greatest(own, i) + 1
    tiles = F.when(F.col("cuts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0), F.coalesce("cuts", F.lit(1)) - 1), pair))
    dealt = dealt.select("bucket", "fp", F.explode(tiles).alias("tile")).repartition(n, "bucket", "tile").sortWithinPartitions("bucket", "tile")
    return dealt.mapInPandas(_links(radius), "u long, v long").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", k: int = SHINGLE, radius: int = RADIUS, blocks: int | None = None, tile: int = TILE) -> DataFrame:
    """doc_id, fp (bigint) and component_id, the smallest doc_id reachable over fingerprints at most `radius` bits apart.

    Null and wordless texts have fingerprint 0 and link as any other. Fingerprints are linked and not ids: a row without a doc_id links as any other, an
    id with two texts joins nothing, and a component of null doc_ids only has component_id null. Repeated rows stay; an empty table gives an empty
    one; other columns are ignored.
    """
    prints = written(with_fingerprint(docs, text, k), "simhash")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    comp = connected_components(near_links(nodes, radius, blocks or blocks_for(nodes.count(), radius), tile))
    met = nodes.join(comp, nodes.fp == comp.node, "left").select("fp", F.coalesce("component", "fp").alias("component"), "least")
    least = met.groupBy("component").agg(F.min("least").alias("component_id"))
    labels = written(met.select("fp", "component").join(least, "component").select("fp", "component_id"), "simhash-labels")
    return prints.join(labels, "fp", "left").select("doc_id", "fp", "component_id")


def mixed(h: np.ndarray, w: int) -> np.ndarray:
    """Another mix of hashes for each w."""
    z = h + np.uint64(0x9E3779B97F4A7C15 * (w + 1) % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def common_shingles(docs: DataFrame, text: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts), sorted by hash: shingles met often in a sample of SAMPLE_ROWS rows. They only order shingles, so any choice loses no pair."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [np.unique(shingle_hashes(t, k)) for t in b["text"]]
            yield pd.DataFrame({"gram": np.concatenate(found).view(np.int64)})

    cuts = max(1, docs.count() // SAMPLE_ROWS)
    some = docs.select(F.col(text).alias("text")).filter(F.pmod(F.xxhash64("text"), F.lit(cuts)) == 0)
    often = some.mapInPandas(run, "gram long").groupBy("gram").agg(F.count("*").alias("n")).filter("n > 2").orderBy(F.desc("n"), "gram").limit(COMMON)
    rows = np.array([(r.gram, r.n) for r in often.collect()], np.int64).reshape(-1, 2)
    rows = rows[np.argsort(rows[:, 0].view(np.uint64) if len(rows) else rows[:, 0])]
    return np.ascontiguousarray(rows[:, 0]).view(np.uint64), rows[:, 1]


def prefix_of(h: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The first n - ceil(similarity n) + 1 of n distinct hashes in one order for all texts, rare ones first: texts of the similarity share one of these."""
    hashes, counts = common
    count = np.zeros(len(h), np.int64)
    if len(hashes):
        at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        count = np.where(hashes[at] == h, counts[at], 0)
    return h[np.lexsort((mixed(h, 0), count))][: len(h) - ceil(similarity * len(h) - 1e-9) + 1]


def tally(h: np.ndarray) -> bytes:
    """How many of the hashes fall in each of CLASSES classes, at most 255: two sets have no more in common than the sum of the lesser counts."""
    return np.minimum(np.bincount((h % CLASSES).astype(np.int64), minlength=CLASSES), 255).astype(np.uint8).tobytes()


def can_meet(tallies: np.ndarray, i: np.ndarray, j: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Which of the pairs (i, j) may have as many hashes in common as they need; counts that are full on both sides tell nothing."""
    out = np.empty(len(i), bool)
    for at in range(0, len(i), 65536):
        least = np.minimum(tallies[i[at : at + 65536]], tallies[j[at : at + 65536]])
        out[at : at + 65536] = (least.sum(1, dtype=np.int64) >= need[at : at + 65536]) | (least == 255).any(1)
    return out


def _candidates(similarity: float):
    """Pairs (u, v) of one (gram, tile) and of different components whose sizes, places and tallies let them reach the similarity."""

    def pairs(b: pd.DataFrame) -> pd.DataFrame | None:
        key = b[["gram", "tile"]].to_numpy(np.int64)
        starts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(b)]
        node, comp, n, pos = (b[c].to_numpy(np.int64) for c in ("node", "comp", "n", "pos"))
        tallies = np.frombuffer(b"".join(b["tally"]), np.uint8).reshape(len(b), CLASSES)
        us, vs = [], []
        for s, e in zip(starts, starts[1:]):
            for at in range(s, e, 256):
                i, j = slice(at, min(at + 256, e)), slice(at + 1, e)
                ok = (comp[i, None] != comp[None, j]) & (np.arange(at, i.stop)[:, None] < np.arange(at + 1, e)[None])
                both = np.minimum((n - pos)[i, None], (n - pos)[None, j])
                ok &= both >= similarity / (1 + similarity) * (n[i, None] + n[None, j]) - 1e-6
                ok &= np.minimum(n[i, None], n[None, j]) >= similarity * np.maximum(n[i, None], n[None, j]) - 1e-6
                x, y = np.nonzero(ok)
                x, y = at + x, at + 1 + y
                meet = can_meet(tallies, x, y, similarity / (1 + similarity) * (n[x] + n[y]) - 1e-6)
                us.append(node[x[meet]])
                vs.append(node[y[meet]])
        if not us:
            return None
        u, v = np.concatenate(us), np.concatenate(vs)
        return pd.DataFrame({"u": np.maximum(u, v), "v": np.minimum(u, v)}).drop_duplicates()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None  # rows of the last bucket, which may go on in the next batch
        for b in batches:
            if not len(b):
                continue
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            same = (b["gram"] == b["gram"].iloc[-1]) & (b["tile"] == b["tile"].iloc[-1])
            rest, b = b[same], b[~same]
            if len(b) and (out := pairs(b)) is not None and len(out):
                yield out
        if rest is not None and (out := pairs(rest)) is not None and len(out):
            yield out

    return run


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, text: str, k: int, similarity: float) -> DataFrame:
    """The pairs (u, v) of nodes whose shingle sets have the Jaccard similarity or more, exactly."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets: dict[int, np.ndarray] = {}
            keep = []
            for u, v, a, c in zip(b["u"], b["v"], b["a"], b["c"]):
                for x, t in ((u, a), (v, c)):
                    if x not in sets:
                        sets[x] = np.unique(shingle_hashes(t, k))
                met = len(np.intersect1d(sets[u], sets[v], assume_unique=True))
                keep.append(met > 0 and met / (len(sets[u]) + len(sets[v]) - met) >= similarity)
            yield b.loc[keep, ["u", "v"]]

    pairs = written(pairs, "candidates")
    asked = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct().join(nodes.select("node", "h"), "node")
    found = docs.select(F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"), F.col(text).alias("text")).join(asked, "h")
    texts = written(found.groupBy("node").agg(F.first("text").alias("text")), "candidate-texts")
    met = pairs.join(texts.select(F.col("node").alias("u"), F.col("text").alias("a")), "u").join(texts.select(F.col("node").alias("v"), F.col("text").alias("c")), "v")
    sure = written(met.mapInPandas(run, "u long, v long"), "verified")
    discard(pairs, texts)
    return sure


def leads(dealt: DataFrame) -> DataFrame:
    """(a, b): each node of (node, fp, w, key) with the leaders of its (w, key), if that has other nodes.

    Leaders are the smallest and the largest node, and the one whose fingerprint is nearest to the majority of all, bit by bit: near copies of one text may be less alike to
    each other than each is to it, and it stands in their middle.
    """
    keys = ["w", "key"]
    ones = [F.sum(F.shiftrightunsigned("fp", i).bitwiseAND(F.lit(1))).alias(f"b{i}") for i in range(64)]
    groups = dealt.groupBy(*keys).agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n"), *ones).filter("low < high")
    bits = [F.when(F.col(f"b{i}") * 2 > F.col("n"), F.lit((1 << i) - ((1 << 64) if i == 63 else 0))).otherwise(F.lit(0)) for i in range(64)]
    middle = reduce(lambda x, y: x.bitwiseOR(y), [b.cast("long") for b in bits])
    met = written(dealt.join(groups.select(*keys, "low", "high", middle.alias("middle")), keys), "led-nodes")
    central = met.groupBy(*keys).agg(F.min_by("node", F.struct(F.bit_count(F.col("fp").bitwiseXOR(F.col("middle"))), "node")).alias("central"))
    found = met.select(*keys, "node", F.explode(F.array("low", "high")).alias("b")).union(met.join(central, keys).select(*keys, "node", F.col("central").alias("b")))
    return found.filter("node <> b").select(F.col("node").alias("a"), "b").distinct()


def text_classes(docs: DataFrame, text: str = "text", k: int = SIMILAR_SHINGLE, similarity: float = SIMILARITY, tile: int = TILE) -> DataFrame:
    """doc_id, h (the text's xxhash64, of "" where it is null) and `class` of each row: components of the pairs of texts whose sets of k-word shingles
    have at least the Jaccard similarity. No pair is lost and none is guessed: candidates come from prefix filtering and are compared exactly.

    Null texts and texts without a word are one class, repeated rows stay, doc_ids may be null or stand for several texts, an empty table gives an
    empty one, other columns are ignored. Sets are sets of 64-bit hashes.
    """
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, text, k))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for t in b["text"]:
                all_ = shingle_hashes(t, k)
                h, fp = np.unique(all_), int(np.uint64(majority(all_)).view(np.int64))
                least = [int(mixed(h, w).min().view(np.int64)) for w in range(1, LEADS + 1)] if len(h) else []
                rows.append((xxhash.xxh3_64_intdigest(h.tobytes()) - 2**63, len(h), fp, least, prefix_of(h, common.value, similarity).tobytes(), tally(h)))
            yield pd.concat([b[["doc_id", "h"]], pd.DataFrame(rows, columns=["node", "n", "fp", "least", "prefix", "tally"], index=b.index)], axis=1)

    # pandas turns a bigint column with nulls into floats, so the id goes as text
    kept = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"), F.col(text).alias("text"))
    rows = written(kept.mapInPandas(read, "doc_id string, h long, node long, n long, fp long, least array<long>, prefix binary, tally binary"), "shingled")
    nodes = written(rows.groupBy("node").agg(F.min("h").alias("h"), F.min("fp").alias("fp"), F.first("n").alias("n"), F.first("least").alias("least"), F.first("prefix").alias("prefix"), F.first("tally").alias("tally")), "shingled-nodes")

    # first the likely pairs: bit-sliced SimHash links, and the leaders of texts that share a least shingle
    prints = written(nodes.groupBy("fp").agg(F.min("node").alias("first")), "shingled-prints")
    near = near_links(prints, RADIUS, blocks_for(prints.count()), tile)
    own = nodes.join(prints, "fp").select(F.col("node").alias("a"), F.col("first").alias("b"))
    first = lambda c: prints.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_first"))
    across = near.join(first("u"), "u").join(first("v"), "v").select(F.col("u_first").alias("a"), F.col("v_first").alias("b"))
    led = leads(nodes.select("node", "fp", F.posexplode("least").alias("w", "key")))
    likely = own.union(across).union(led).filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    sure = verified(likely, nodes, docs, text, k, similarity)
    comp = written(connected_components(sure), "led")

    # then every pair of different components that can still reach the similarity
    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 1000):
                some = b.iloc[at : at + 1000]
                sizes = np.array([len(x) // 8 for x in some["prefix"]], np.int64)
                yield pd.DataFrame({
                    "gram": np.frombuffer(b"".join(some["prefix"]), np.int64), "node": np.repeat(some["node"].to_numpy(), sizes), "comp": np.repeat(some["comp"].to_numpy(), sizes),
                    "n": np.repeat(some["n"].to_numpy(), sizes), "pos": np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes),
                })

    labelled = nodes.join(comp.withColumnRenamed("node", "__node"), F.col("node") == F.col("__node"), "left").select("node", "n", "prefix", F.coalesce("component", "node").alias("comp"))
    prefixes = labelled.mapInPandas(deal, "gram long, node long, comp long, n long, pos long")
    live = prefixes.groupBy("gram").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("rows")).filter("low < high")
    live = written(live.select("gram", F.ceil(F.col("rows") / tile).cast("int").alias("cuts")), "live-shingles")
    own = F.pmod(F.xxhash64("node", "gram"), F.col("cuts")).cast("int")
    pair = lambda i: F.least(own, i).cast("long") * F.col("cuts") + F.greatest(own, i)
    tiles = F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), pair)
    met = prefixes.join(live, "gram").select("gram", "node", "comp", "n", "pos", F.explode(tiles).alias("tile"))
    met = met.join(nodes.select("node", "tally"), "node")
    met = met.repartition(partitions(docs.sparkSession), "gram", "tile").sortWithinPartitions("gram", "tile")
    more = verified(met.mapInPandas(_candidates(similarity), "u long, v long").distinct(), nodes, docs, text, k, similarity)
    classes = written(connected_components(sure.union(more)), "classes")
    discard(nodes, prints, comp, live, sure, more)
    names = classes.withColumnRenamed("node", "__node")
    return rows.join(names, F.col("node") == F.col("__node"), "left").select(F.col("doc_id").cast("long").alias("doc_id"), "h", F.coalesce("component", "node").alias("class"))


def similar_texts(docs: DataFrame, text: str = "text", k: int = SIMILAR_SHINGLE, similarity: float = SIMILARITY, tile: int = TILE) -> DataFrame:
    """doc_id and component_id, the smallest doc_id of the row's class in text_classes; null in a class of null doc_ids only. Repeated rows stay."""
    rows = written(text_classes(docs, text, k, similarity, tile), "similar-texts")
    least = rows.groupBy("class").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least, "class").select("doc_id", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
