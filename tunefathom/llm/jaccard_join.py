"""N-gram Jaccard join: partitions of the shingle universe, with one-deletion neighbourhoods, verified exactly.

A text is the set of its shingles (64-bit hashes). Sets that may be similar lie in the same or in neighbouring size
bands; for each such pair of bands the most shingles two similar sets can differ in is known. The universe is dealt
into segments by hash, so that the difference spreads over them, and some segment must differ little:

* a segment of weight 1 is looked up by all its shingles together and finds equal segments;
* a segment of weight 2 is also looked up with each shingle left out and finds segments that differ in one.

The weights add up to the largest difference plus one, plus a reserve for empty segments: these say nothing and are
left out, unless a set has more of them than the reserve covers. How many segments get weight 2 is decided per band
by cost: entries to index against expected tiny segments, which collide by chance (``Plan``). No similar pair is lost.

Every set keeps a parity sketch: about a bit per shingle, ``SKETCH`` at least, one of them flipped by each shingle. Two
sketches, cut to one length, differ in at most as many bits as the sets do in shingles, so a pair whose sketches differ in more than a similar pair can is refused for
certain, before any text moves.

Sets under one key are compared with its hub, the member that shares most keys with others, from both whole texts.
Members that the hub leaves in other components are compared with the hub's other members (if they are many, with those
under the same key), in blocks of bounded size: first by sketch, which leaves those that may be similar to some other one; then by what each of them differs in from
the hub, which tells exactly how much they share. The blocks yield a spanning forest of the links found and never a
list of pairs. Texts of equal sets are linked by a fingerprint of 128 bits.

Defined results: null and empty texts (no words) have an empty set and are
linked with nothing; a text of fewer words than a shingle is one shingle; rows without an id get their set's size and
no component; equal ids are one node; ties and repeated rows are copies like any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from tunefathom.llm.bpe import text_slices
from tunefathom.llm.components import components
from tunefathom.session import settled

#: What a segment of one shingle or none is worth in index entries, when weights are chosen.
TINY_COST = 20.0
SLOTS = 1 << 18
#: Members of one hub in a block.
BLOCK = 1024
#: Rows of a block's comparison matrix that are held at a time.
STRIP = 64
#: Bits of the shortest sketch.
SKETCH = 1024
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of a text's n-word shingles; A-Z in lower case, words between ASCII white space."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(n, len(h))
    with np.errstate(over="ignore"):
        total = np.full(len(h) - size + 1, size, np.uint64)
        for k in range(size):
            total = mix(total * _ODD + h[k:len(h) - size + 1 + k])
    return np.unique(total)


@dataclass(frozen=True)
class Plan:
    """How the sets of one band and the next are cut: ``doubles`` segments of weight 2, the rest of weight 1."""
    number: int
    low: int
    high: int
    segments: int
    doubles: int
    reserve: int


def _plan(number: int, low: int, a: int, b: int) -> Plan:
    """The cheapest cut for similarity ``a / b`` of sets from ``low`` on; ``b * low // a`` is the largest partner."""
    high = low * b // a
    most = (high + high * b // a) * (b - a) // (a + b)
    size = (low + high * b // a) / 2

    def cut(doubles: int) -> tuple[float, int, int]:
        segments = most + 1 - doubles
        empty = segments * (1 - 1 / segments) ** size if segments > 1 else 0.0
        reserve = int(np.ceil(empty + 2 * empty**0.5)) if segments - doubles > 0 and empty > 1e-3 else 0
        segments += reserve
        per = size / segments
        tiny = (1 - 1 / segments) ** size * (1 + per) if segments > 1 else 0.0
        return segments + doubles * per + segments * TINY_COST * tiny, segments, reserve

    # the cost has one valley in the number of doubled segments; a coarse and a fine step find it for large sets
    step = max(1, most // 64)
    coarse = min(range(0, (most + 1) // 2 + 1, step), key=lambda d: cut(d)[0])
    doubles = min(range(max(0, coarse - step), min((most + 1) // 2, coarse + step) + 1), key=lambda d: cut(d)[0])
    _, segments, reserve = cut(doubles)
    return Plan(number, low, high, segments, doubles, reserve)


@lru_cache(maxsize=None)
def _plans(a: int, b: int, up_to: int) -> tuple[Plan, ...]:
    out, low = [], 1
    while not out or out[-1].high < up_to:
        out.append(_plan(len(out) + 1, low, a, b))
        low = out[-1].high + 1
    return tuple(out)


def plans_for(size: int, a: int, b: int) -> list[Plan]:
    """The cuts that a set of this size takes part in: with the band above, and with the one below."""
    known = _plans(a, b, 1 << (max(size, 1) - 1).bit_length())
    at = next(i for i, p in enumerate(known) if p.high >= size) if size < 64 else int(np.searchsorted([p.high for p in known], size))
    return [known[at], *([known[at - 1]] if at else [])]


def signatures(tokens: np.ndarray, plan: Plan) -> np.ndarray:
    """The keys of one set under one cut."""
    part = (tokens % np.uint64(plan.segments)).astype(np.int64)
    value = mix(tokens + _ODD)
    sums = np.zeros(plan.segments, np.uint64)
    np.add.at(sums, part, value)
    salt = mix(np.arange(plan.segments, dtype=np.uint64) + np.uint64(plan.number << 32))
    filled = np.bincount(part, minlength=plan.segments) > 0
    single = np.arange(plan.segments) >= plan.doubles
    used = filled | ~single
    if (single & ~filled).sum() > plan.reserve:
        used[:] = True
    keys = [mix(sums ^ salt)[used]]
    if plan.doubles:
        near = part < plan.doubles
        keys.append(mix((sums[part[near]] - value[near]) ^ salt[part[near]]))
    return np.concatenate(keys)


def _marks(tokens: np.ndarray) -> tuple[int, int]:
    """A fingerprint of a set, 0 for the empty one."""
    return tuple(np.array([mix(tokens).sum(), mix(tokens ^ _ODD).sum()], np.uint64).view(np.int64).tolist()) if len(tokens) else (0, 0)


def sketch(tokens: np.ndarray) -> bytes:
    """Parities of how many shingles fall on each bit: as many bits as shingles, rounded up to a power of two."""
    bits = max(SKETCH, 1 << max(len(tokens) - 1, 0).bit_length())
    odd = np.bincount((tokens % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def folded(one: bytes, size: int) -> np.ndarray:
    """A sketch as 64-bit numbers, cut down to ``size`` bytes: halves laid on each other are the sketch of half the bits."""
    out = np.frombuffer(one, np.uint64)
    while len(out) * 8 > size:
        out = out[:len(out) // 2] ^ out[len(out) // 2:]
    return out


def set_sizes(docs: DataFrame, n: int) -> DataFrame:
    """Per row: doc_id, n_shingles, the fingerprint of the set and its sketch."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            sets = [shingles(t, n) for t in batch.column("text").to_pylist()]
            marks = [_marks(s) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), *[pa.array([m[k] for m in marks], pa.int64()) for k in (0, 1)],
                                              pa.array([sketch(s) for s in sets], pa.binary())],
                                             names=["doc_id", "n_shingles", "mark_1", "mark_2", "sketch"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, n_shingles long, mark_1 long, mark_2 long, sketch binary")


def sketched(pairs: DataFrame, sets: DataFrame, a: int, b: int) -> DataFrame:
    """(doc, hub, n_keys) pairs with the document's size, and whether sizes and sketches allow them to be similar."""
    side = sets.filter("n_shingles > 0 and doc_id is not null").select("doc_id", "n_shingles", "sketch")
    both = pairs.join(side.toDF("doc", "size", "sketch"), "doc").join(side.toDF("hub", "hub_size", "hub_sketch"), "hub")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, hub_size = (batch.column(c).to_numpy() for c in ("size", "hub_size"))
            least = np.abs(size - hub_size)
            for i, (x, y) in enumerate(zip(batch.column("sketch").to_pylist(), batch.column("hub_sketch").to_pylist())):
                short = min(len(x), len(y))
                least[i] = max(least[i], int(np.bitwise_count(folded(x, short) ^ folded(y, short)).sum()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc", "hub", "n_keys", "size")], pa.array(least * (a + b) <= (size + hub_size) * (b - a))],
                                             names=["doc", "hub", "n_keys", "size", "possible"])
    return both.select("doc", "hub", "n_keys", "size", "sketch", "hub_size", "hub_sketch").mapInArrow(work, "doc long, hub long, n_keys long, size long, possible boolean")


def set_keys(docs: DataFrame, n: int, a: int, b: int) -> DataFrame:
    """(doc, key): the keys of every set, of equal sets in one task only once. Rows without an id have none."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in text_slices(batches, "text", 1_000_000):
            ids, keys = [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                tokens = shingles(text, n)
                if doc is not None and len(tokens) and (marks := _marks(tokens)) not in seen:
                    seen.add(marks)
                    for plan in plans_for(len(tokens), a, b):
                        found = signatures(tokens, plan)
                        keys.append(found.view(np.int64))
                        ids.append(np.full(len(found), doc, np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(keys))], names=["doc", "key"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc long, key long")


def compared(pairs: DataFrame, docs: DataFrame, n: int, a: int, b: int) -> DataFrame:
    """For (doc, hub) pairs of ids: the document's size, whether both are similar, and the shingles only one of them has."""
    ids = pairs.select(F.explode(F.array("doc", "hub")).alias("id"))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    # texts that no pair needs are left out where they are read, but for those whose id falls into used slots of both tables
    for seed in (1, 2):
        slot = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(SLOTS))
        texts = texts.withColumn("slot", slot).join(F.broadcast(ids.select(slot.alias("slot")).distinct()), "slot", "left_semi").select("id", "text")
    both = pairs.join(texts.toDF("doc", "text"), "doc").join(texts.toDF("hub", "hub_text"), "hub")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str | None, np.ndarray] = (None, np.empty(0, np.uint64))
        for batch in text_slices(batches, "text"):
            sizes, similar, differs = [], [], []
            for x, y in zip(batch.column("text").to_pylist(), batch.column("hub_text").to_pylist()):
                if y != last[0]:
                    last = (y, shingles(y, n))
                own, hub = shingles(x, n), last[1]
                only = np.setxor1d(own, hub, assume_unique=True)
                sizes.append(len(own)), similar.append(_similar(len(own), len(hub), len(only), a, b)), differs.append(only.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("hub"), pa.array(sizes, pa.int64()), pa.array(similar, pa.bool_()), pa.array(differs, pa.binary())],
                                             names=["doc", "hub", "size", "similar", "differs"])

    return both.select("doc", "hub", "text", "hub_text").mapInArrow(work, "doc long, hub long, size long, similar boolean, differs binary")


def _similar(one: int, other: int, apart: int, a: int, b: int) -> bool:
    """From the sizes of two sets and that of their symmetric difference."""
    shared = (one + other - apart) // 2
    return shared > 0 and b * shared >= a * (one + other - shared)


def _in_blocks(members: DataFrame, *columns: str, block: int = BLOCK) -> DataFrame:
    """Members of a group dealt to pairs of blocks (hub, via, x, y, near): far ones meet each other and the near ones.

    ``members``: doc, hub, via, component, far (not in the hub's component) and ``columns``. Near ones do not meet each
    other.
    """
    members = members if "via" in members.columns else members.withColumn("via", F.lit(0).cast("long"))  # one group per hub
    counts = members.groupBy("hub", "via").agg(F.count_if("far").alias("n_far"), F.count_if(~F.col("far")).alias("n_near")).filter("n_far > 0 and n_far + n_near > 1")
    rows = members.join(counts, ["hub", "via"]).withColumns({"far_blocks": F.ceil(F.col("n_far") / block).cast("int"), "near_blocks": F.ceil(F.col("n_near") / block).cast("int")})
    own = F.pmod(F.xxhash64("doc"), F.when(F.col("far"), F.col("far_blocks")).otherwise(F.greatest("near_blocks", F.lit(1)))).cast("int")

    def upto(count):
        return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    # (far block, second block, whether the second is a near one)
    far_places = F.concat(F.transform(upto(F.col("far_blocks")), lambda j: F.struct(F.least("own", j).alias("x"), F.greatest("own", j).alias("y"), F.lit(False).alias("near"))),
                          F.transform(upto(F.col("near_blocks")), lambda j: F.struct(F.col("own").alias("x"), j.alias("y"), F.lit(True).alias("near"))))
    near_places = F.transform(upto(F.col("far_blocks")), lambda i: F.struct(i.alias("x"), F.col("own").alias("y"), F.lit(True).alias("near")))
    placed = rows.withColumn("own", own).select("hub", "via", "doc", "component", *columns, F.inline(F.when(F.col("far"), far_places).otherwise(near_places)).alias("x", "y", "near"))
    return placed


def _groups(pairs: DataFrame, met: DataFrame, hubs: DataFrame, most: int) -> DataFrame:
    """(doc, hub, via): the groups in which a hub's members may still meet. ``pairs``: doc, hub, far, n_keys.

    Members of a hub are one group (``via`` 0), but for hubs of sets that have nothing in common but it: where more than
    a block of members are far from it, and meeting under each shared key takes fewer rows than meeting block by block.
    """
    distinct = pairs.select("doc", "hub", "far", "n_keys").distinct()
    sizes = distinct.groupBy("hub").agg(F.count_if("far").alias("many"), F.sum("n_keys").alias("rows"))
    wide = sizes.select("hub", ((F.col("many") > most) & (F.col("rows") < F.col("many") * F.ceil(F.col("many") / most))).alias("wide"))
    small = distinct.join(wide.filter("not wide"), "hub").select("doc", "hub", F.lit(0).cast("long").alias("via"))
    keys = hubs.join(wide.filter("wide").select("hub"), "hub")
    return small.unionByName(met.select("key", "doc").join(keys, "key").filter("doc <> hub").select("doc", "hub", F.col("key").alias("via")))


def may_link(members: DataFrame, a: int, b: int, block: int = BLOCK) -> DataFrame:
    """(doc, hub) of the members that, by size and sketch, may be similar to a member of the hub in another component."""
    def compare(group: pd.DataFrame) -> pd.DataFrame:
        size, component = group["size"].to_numpy(), group["component"].to_numpy()
        short = min(map(len, group["sketch"]))
        bits = np.stack([folded(x, short) for x in group["sketch"]])
        open_rows = np.zeros(len(group), bool)
        for low in range(0, len(group), STRIP):
            rows = slice(low, low + STRIP)
            apart = np.zeros((len(bits[rows]), len(bits)), np.int32)
            for word in bits.T:
                apart += np.bitwise_count(word[rows, None] ^ word[None, :])
            possible = apart * np.int64(a + b) <= (size[rows, None] + size[None, :]) * (b - a)
            open_rows[rows] = (possible & (component[rows, None] != component[None, :])).any(axis=1)
        return group.loc[open_rows, ["doc", "hub"]]

    return _in_blocks(members, "size", "sketch", block=block).groupBy("hub", "via", "x", "y", "near").applyInPandas(compare, "doc long, hub long").distinct()


def far_links(members: DataFrame, a: int, b: int, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that join components among the members of one hub.

    ``members``: doc, hub, via, size, differs, component, far (not in the hub's component).
    """
    def compare(group: pd.DataFrame) -> pd.DataFrame:
        return _spanning(group["doc"].to_numpy(), group["component"].to_numpy(), group["size"].to_numpy(), [np.frombuffer(d, np.uint64) for d in group["differs"]], a, b)

    return _in_blocks(members, "size", "differs", block=block).groupBy("hub", "via", "x", "y", "near").applyInPandas(compare, "a long, b long")


def _spanning(docs: np.ndarray, component: np.ndarray, size: np.ndarray, differs: list[np.ndarray], a: int, b: int) -> pd.DataFrame:
    """Links between different components of a block, as many as join them and no more."""
    root = {c: c for c in component.tolist()}

    def find(c):
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c
    out: dict[str, list] = {"a": [], "b": []}
    if len(root) > 1:
        lengths = np.array([len(d) for d in differs])
        owner = np.repeat(np.arange(len(docs)), lengths)
        tokens, place, often = np.unique(np.concatenate(differs), return_inverse=True, return_counts=True)
        common = often[place] > 1  # a shingle of one member only is shared with nobody
        owner, place = owner[common], np.unique(place[common], return_inverse=True)[1]
        order = np.argsort(place, kind="stable")
        owner, place = owner[order], place[order]
        shared = np.zeros((len(docs), len(docs)), np.float32)
        step = 4096
        for low in range(0, int(place[-1]) + 1 if len(place) else 0, step):
            i, j = np.searchsorted(place, [low, low + step])
            have = np.zeros((len(docs), step), np.float32)
            have[owner[i:j], place[i:j] - low] = 1
            shared += have @ have.T
        for low in range(0, len(docs), STRIP):
            rows = slice(low, low + STRIP)
            sizes = size[rows, None] + size[None, :]
            both = (sizes - lengths[rows, None] - lengths[None, :] + 2 * shared[rows].astype(np.int64)) // 2
            linked = (both > 0) & (b * both >= a * (sizes - both)) & (component[rows, None] != component[None, :])
            for x, y in zip(*np.nonzero(linked)):
                p, q = find(int(component[low + x])), find(int(component[y]))
                if p != q:
                    root[max(p, q)] = min(p, q)
                    out["a"].append(int(docs[low + x])), out["b"].append(int(docs[y]))
    return pd.DataFrame(out, dtype="int64")


def jaccard_components(docs: DataFrame, n: int = 5, a: int = 80, b: int = 100, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; sets link when ``b * shared >= a * united``."""
    sets = settled(set_sizes(docs, n), "shingle-sets")
    keyed = set_keys(docs, n, a, b)
    same_key = Window.partitionBy("key")
    met = keyed.withColumns({"least": F.min("doc").over(same_key), "most": F.max("doc").over(same_key), "n": F.count("*").over(same_key)})
    met = settled(met.filter("least < most").select("key", "doc", "n"), "shared-keys")
    # the member that shares most keys with others: in a group of near copies the one in the middle
    support = met.groupBy("doc").agg(F.sum(F.col("n") - 1).alias("support"))
    hubs = met.join(support, "doc").groupBy("key").agg(F.max(F.struct("support", (-F.col("doc")).alias("minus"))).alias("top"))
    hubs = settled(hubs.select("key", (-F.col("top.minus")).alias("hub")), "key-hubs")
    pairs = met.select("key", "doc").join(hubs, "key").filter("doc <> hub").groupBy("doc", "hub").agg(F.count("*").alias("n_keys"))
    known = settled(sketched(pairs, sets, a, b), "hub-pairs")
    members = settled(compared(known.filter("possible").select("doc", "hub").distinct(), docs, n, a, b), "hub-members")
    copies = sets.filter("n_shingles > 0 and doc_id is not null").withColumnRenamed("doc_id", "a").join(
        sets.filter("n_shingles > 0").groupBy("mark_1", "mark_2", "n_shingles").agg(F.min("doc_id").alias("b"), F.count("*").alias("many")).filter("many > 1"),
        ["mark_1", "mark_2", "n_shingles"]).filter("a <> b").select("a", "b")
    links = settled(members.filter("similar").select(F.col("doc").alias("a"), F.col("hub").alias("b")).unionByName(copies).distinct(), "near-links")
    found = components(links)
    def placed(rows: DataFrame) -> DataFrame:
        both = rows.join(found.toDF("doc", "component"), "doc", "left").join(found.toDF("hub", "hub_component"), "hub", "left")
        both = both.withColumn("component", F.coalesce("component", "doc")).withColumn("far", F.col("component") != F.coalesce("hub_component", "hub"))
        return both.drop("hub_component")
    sketches = sets.select(F.col("doc_id").alias("doc"), "sketch")
    pairs = placed(known.select("doc", "hub", "size", "n_keys"))
    groups = settled(_groups(pairs, met, hubs, block), "hub-groups")
    still = settled(may_link(pairs.drop("n_keys").join(sketches, "doc").join(groups, ["doc", "hub"]), a, b, block), "open-members")
    compared_before = members.join(still, ["doc", "hub"], "left_semi")
    compared_now = compared(still.join(members.select("doc", "hub").distinct(), ["doc", "hub"], "left_anti"), docs, n, a, b)
    rest = settled(far_links(placed(compared_before.unionByName(compared_now)).join(groups, ["doc", "hub"]), a, b, block), "far-links")
    if not rest.isEmpty():
        found = components(links.unionByName(rest))
    return sets.select("doc_id", "n_shingles").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, a: int = 80, b: int = 100) -> DataFrame:
    """The documents that are the first of their component. Rows without an id stay."""
    dropped = jaccard_components(docs, n, a, b).filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def sql(n: int = 3, a: int = 90, b: int = 100) -> str:
    """The same components of ``documents`` in DuckDB's SQL, from all pairs that share a shingle."""
    joined = " || ' ' || ".join(f"w[i + {k}]" for k in range(n))
    return f"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, {joined} AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {n} + 2)) AS i FROM t WHERE len(w) >= {n})
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM t WHERE len(w) BETWEEN 1 AND {n - 1}),
c AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS p, y.doc_id AS q, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY p, q),
links AS MATERIALIZED (SELECT p, q FROM pairs JOIN c cp ON cp.doc_id = p JOIN c cq ON cq.doc_id = q WHERE {b} * k >= {a} * (cp.n + cq.n - k)),
edges AS MATERIALIZED (SELECT p, q FROM links UNION SELECT q, p FROM links),
reach(p, q) AS (SELECT p, q FROM edges UNION SELECT r.p, e.q FROM reach r JOIN edges e ON r.q = e.p)
SELECT t.doc_id, coalesce(c.n, 0) AS n_shingles, least(t.doc_id, coalesce(m.low, t.doc_id)) AS component_id
FROM t LEFT JOIN c USING (doc_id) LEFT JOIN (SELECT p AS doc_id, min(q) AS low FROM reach GROUP BY p) m USING (doc_id)"""
