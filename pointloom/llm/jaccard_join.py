"""N-gram Jaccard join with parity sketches.

A document is the set of its distinct shingles. Two sets of sizes a and b are alike enough only if their symmetric
difference is at most ``d = (1-t)/(1+t) (a+b)``. A set's sketch has P parts of 2**64 parity bits: every shingle flips
the bit of its hash in the part that the hash chooses, so the Hamming distance of two sketches, and all the more the
number of parts in which they differ, is never more than the symmetric difference. Of so wide a part only the few odd
bits are known; the XOR of their names stands for them. With P > d parts, at least P - d parts have no difference at
all (pigeonhole): sets that are alike meet in equal parts. Sets are compared within bands of size; each band has a P
of its own, somewhat more than its largest d, so that alike sets share several parts and not just one.

* Equal sets are one node. Texts of nodes that share no part with another node aren't looked at again.
* A part that is empty in both sets says nothing. If P - d is no more than a set's empty parts, the set is sketched
  again with another hash, until it is; of two alike sets either one is fine, or both go on.
* A node needs at least ``need`` = P - d - (its empty parts) shared parts. Of those it has, ordered by how many nodes
  share them, all but the last ``need - 1`` are kept: two alike nodes still meet in their rarest common part. Nodes
  of unlike texts that share a passage have one such part or two, and drop out here.
* In each remaining group every node is tied to the group's first. The strongest tie of each node is verified on
  whole sets; the ties that hold make components.
* A group is open while a member's component isn't that of the group's first. Such members are compared with all
  others of the group by the Hamming distance of dense sketches of parity bits. A group without a pair within the bound
  is done. Of the others, pairs that would join the group's components are verified on whole sets; groups that have
  a pair within the bound between two components even then are compared on whole sets. So no link between different
  components is missed, and pairs within one aren't all listed. A group is cut into blocks of bounded size, and each two blocks with such a
  member meet in a task of their own.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _words as W
from ._common import bitmap, carried, documents, keyed, maybe, row_key, settle

SHINGLE, SHARE = 4, (85, 100)  # link when 100 * intersection >= 85 * union
SEEDS = 24
BLOCK = 1 << 20  # shingles of a block; only one larger set makes a larger block

#: Largest difference of each band; the steps are about the square root of 2.
BANDS = [0, 1, 2, 3, 4]
while BANDS[-1] < 1 << 40:
    BANDS.append(BANDS[-1] * 7 // 5 + 1)


def _most(a: int, b: int, share: tuple[int, int]) -> int:
    """Largest symmetric difference of alike sets of these sizes."""
    num, den = share
    return (den - num) * (a + b) // (den + num)


def _parts(band: int) -> int:
    return BANDS[band] + 2 + BANDS[band] * 3 // 20


def levels(n: int, share: tuple[int, int]) -> list[tuple[int, int, int]]:
    """Bands that a set of n shingles takes part in: (band, parts, parts that surely agree).

    A pair goes by its larger set, whose band is that of its largest difference; a set joins the bands of every
    larger set that it could be alike to. In a band without differences only equal sets are alike, which are one node.
    """
    num, den = share

    def band(b: int) -> int:
        return bisect_left(BANDS, _most(b, b, share))

    top, out = n * den // num, []
    for lv in range(band(n), band(top) + 1):
        low, high = n, top  # the largest b in [n, top] of this band
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if band(mid) <= lv else (low, mid - 1)
        if BANDS[lv]:
            out.append((lv, _parts(lv), _parts(lv) - _most(n, low, share)))
    return out


_SALT = [W.mix(np.array([1000 + j], np.uint64))[0] for j in range(SEEDS)]


def sketch_parts(shingles: np.ndarray, share: tuple[int, int], plans: dict) -> list[tuple[int, int, np.ndarray]]:
    """(band and seed, parts needed, names of its parts) of one sorted set: equal where a part of equal sketches is."""
    n, out = len(shingles), []
    plan = plans.get(n)
    if plan is None:
        plan = plans[n] = levels(n, share)
    for band, count, sure in plan:
        for seed in range(SEEDS):
            h = shingles if seed == 0 else np.sort(W.mix(shingles ^ _SALT[seed]))
            part = ((h >> W.U(32)) * W.U(count)) >> W.U(32)
            at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            odd = np.bitwise_xor.reduceat(W.mix(h), at)
            names = W.mix(odd ^ W.mix(part[at] + W.U(band * SEEDS + seed + 1) * W.U(1 << 40)))
            need = sure - (count - len(at))
            if need > 0:
                out.append((band * SEEDS + seed, need, names))
                break
            out.append((band * SEEDS + seed, 1, names))
        else:  # never seen: then an empty part may count
            empty = np.setdiff1d(np.arange(count, dtype=np.uint64), part)
            out.append((band * SEEDS + SEEDS - 1, 1, W.mix(empty + W.U(band + 1) * W.U(1 << 50))))
    return out


def _sets(buf: np.ndarray, at: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document, A-Z lowered."""
    doc, h = W.shingles(W.flatten(W.lower(buf), at), n)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return np.split(h[new], np.searchsorted(doc[new], np.arange(1, len(at) - 1))) if len(at) > 1 else []


def _name(shingles: np.ndarray) -> int:
    """The hash that stands for a whole set; that of an empty one is 0."""
    return int(np.bitwise_xor.reduce(W.mix(shingles + W.U(5))).view(np.int64)) if len(shingles) else 0


def _batch(schema: str, cols: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in schema.split("; ")])


_SENT = "sig long; node long; tag long; doc struct<_id:bigint,_th:bigint,n:int>"


def _scan(rows: DataFrame, n: int, share: tuple[int, int]) -> DataFrame:
    """One row for each part of each set (sig, node, tag = band, seed and need), and one for each document (node, doc).

    Equal sets of one task send their parts once.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans: dict = {}
        sent: set[int] = set()  # of one task, so no more than the documents of an input split
        for b in batches:
            for lo, hi, buf, at in W.slices(b.column("_text")):
                sets = _sets(buf, at, n)
                names = np.array([_name(s) for s in sets], np.int64)
                sig, node, tag = [], [], []
                for s, name in zip(sets, names.tolist(), strict=True):
                    if len(s) and name not in sent:
                        sent.add(name)
                        for code, need, parts in sketch_parts(s, share, plans):
                            sig.append(parts)
                            node.append(np.full(len(parts), name, np.int64))
                            tag.append(np.full(len(parts), code << 32 | need, np.int64))
                one = W.mix(names.view(np.uint64) ^ W.mix(np.arange(lo, hi, dtype=np.uint64)))  # keys of the documents' own rows
                plain = sum(map(len, sig))
                none = np.zeros(plain, np.int64)
                ids = pa.concat_arrays([pa.nulls(plain, pa.int64()), b.column("_id").slice(lo, hi - lo)])
                hashes = pa.concat_arrays([pa.array(none), b.column("_th").slice(lo, hi - lo)])
                sizes = pa.array(np.concatenate([none, [len(s) for s in sets]]).astype(np.int32))
                doc = pa.StructArray.from_arrays([ids, hashes, sizes], ["_id", "_th", "n"], mask=pa.array(np.arange(plain + hi - lo) < plain))
                yield _batch(_SENT, [pa.array(np.concatenate([*sig, one]).view(np.int64)), pa.array(np.concatenate([*node, names])), pa.array(np.concatenate([*tag, np.zeros(hi - lo, np.int64)])), doc])

    return rows.select("_id", "_th", "_text").mapInArrow(scan, _SENT.replace("; ", ", "))


def _meeting(sent: DataFrame) -> DataFrame:
    """Rows of documents, and of parts that two nodes or more share, with k, about the number of these."""
    w = Window.partitionBy("sig")
    marked = sent.withColumns({"k": F.count("*").over(w), "other": F.min("node").over(w) != F.max("node").over(w)})
    return settle(marked.filter("doc is not null or other").select("sig", "node", "tag", "doc", "k"), "meeting")


def _groups(met: DataFrame) -> DataFrame:
    """sig, node, first (the group's least node) of the parts that nodes keep and still share with others."""
    shared = met.filter("doc is null").dropDuplicates(["sig", "node"])
    w = Window.partitionBy("node", F.shiftright("tag", 32)).orderBy(F.desc("k"), "sig")
    kept = shared.withColumn("r", F.row_number().over(w)).filter("r >= (tag & 4294967295)").select("sig", "node")
    w = Window.partitionBy("sig")
    both = kept.withColumns({"first": F.min("node").over(w), "last": F.max("node").over(w)})
    return settle(both.filter("first != last").select("sig", "node", "first"), "groups")


def _nodes(rows: DataFrame, firsts: DataFrame, groups: DataFrame, n: int, share: tuple[int, int]) -> DataFrame:
    """node, n, sketch, shingles of the nodes that are in groups, each read from its first document."""
    wanted = groups.select("node").distinct().join(firsts, "node").select("node", row_key().alias("key"))
    wanted = settle(wanted, "wanted")
    few = maybe(rows, bitmap(wanted)).withColumn("key", row_key()).join(wanted, "key").select("node", "_text")
    schema = "node long; n int; sketch binary; shingles binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, at in W.slices(b.column("_text")):
                sets = _sets(buf, at, n)
                yield _batch(schema, [b.column("node").slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int32()), pa.array([dense(s, share) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())])

    found = few.mapInArrow(cut, schema.replace("; ", ", "))
    return settle(found.groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "sketch", "shingles")]), "nodes")


def alike(a: np.ndarray, b: np.ndarray, share: tuple[int, int]) -> bool:
    """Whether two sorted sets are."""
    num, den = share
    if min(len(a), len(b)) * den < max(len(a), len(b)) * num:
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return den * common >= num * (len(a) + len(b) - common)


def _verify(pairs: DataFrame, nodes: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Those of the pairs a, b whose whole sets are alike."""
    sets = nodes.select("node", "shingles")
    both = pairs.join(sets.withColumnsRenamed({"node": "a", "shingles": "sa"}), "a").join(sets.withColumnsRenamed({"node": "b", "shingles": "sb"}), "b")
    schema = "a long, b long"

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = [alike(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), share) for x, y in zip(b.column("sa"), b.column("sb"), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.select("a", "b", "sa", "sb").mapInArrow(check, schema)


def dense(shingles: np.ndarray, share: tuple[int, int]) -> bytes:
    """The set's sketch of parity bits: a power of two of them, 16 times as many as its largest difference or more."""
    widest = 16 * _most(len(shingles), len(shingles), share)
    bits = max(64, 1 << min(16, widest.bit_length()))
    odd = np.bincount((shingles & W.U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of words, all as wide as the narrowest: halves of a wider one are XORed."""
    words, out = min(map(len, sketches)) // 8, []
    for s in sketches:
        bits = np.frombuffer(s, np.uint64)
        while len(bits) > words:
            bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
        out.append(bits)
    return np.stack(out)


def forest(rows: list[tuple], share: tuple[int, int]) -> list[tuple[int, int]]:
    """Pairs that join components of a block's rows (node, component, n, sketch, looks, home[, shingles]).

    Each row that ``looks`` is compared with every row that is at ``home`` and not of its component by then: by the
    Hamming distance of their sketches, and on whole sets where that allows it, if they are given. Components that a
    pair joins are one from there on, so pairs within one aren't listed.
    """
    num, den = share
    size = np.array([r[2] for r in rows], np.int64)
    comp = np.unique([r[1] for r in rows], return_inverse=True)[1]
    home = np.array([r[5] for r in rows], bool)
    bits = _folded([r[3] for r in rows])
    out = []
    for i in [i for i, r in enumerate(rows) if r[4]]:
        other = np.flatnonzero(home & (comp != comp[i]))
        other = other[np.minimum(size[other], size[i]) * den >= np.maximum(size[other], size[i]) * num]
        if not len(other):
            continue
        far = np.bitwise_count(bits[other] ^ bits[i]).sum(axis=1, dtype=np.int64)
        near = far * (den + num) <= (den - num) * (size[other] + size[i])
        for j in other[near][np.argsort(far[near], kind="stable")].tolist():
            if comp[j] != comp[i] and (len(rows[i]) == 6 or alike(*(np.frombuffer(rows[x][6], np.uint64) for x in (i, j)), share)):
                out.append((rows[i][0], rows[j][0]))
                comp[comp == comp[j]] = comp[i]
    return out


def _open(groups: DataFrame, nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """key, node, component, looks, home: the blocks in which members of open groups meet."""
    known = settle(nodes.select("node", "n").join(labels, "node", "left").select("node", "n", F.coalesce("component", "node").alias("component")), "known")
    main = known.select(F.col("node").alias("first"), F.col("component").alias("main"))
    now = groups.join(known, "node").join(main, "first").withColumn("apart", F.col("component") != F.col("main"))
    weight = F.col("n").cast("long")
    sums = now.groupBy("sig").agg(F.sum(weight).alias("whole"), F.sum(F.when(F.col("apart"), weight)).alias("part"), F.count("*").alias("k"), F.min("first").alias("a"), F.max("node").alias("b"), F.bit_xor(F.xxhash64("node")).alias("x"))
    # groups with the same members are one
    one = sums.filter("part is not null").groupBy("whole", "part", "k", "a", "b", "x").agg(F.min("sig").alias("sig"))
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    one = one.select("sig", blocks("whole").alias("homes"), blocks("part").alias("looks"))
    dealt = now.select("sig", "node", "component", "apart").join(one, "sig")
    dealt = dealt.withColumns({"at": F.pmod(F.xxhash64("node"), "homes").cast("int"), "as": F.when(F.col("apart"), F.pmod(F.xxhash64("node", F.lit(1)), "looks").cast("int"))})
    # a member is at home in one block, and looks, if it is apart, into every one
    there = F.transform(F.sequence(F.lit(0), F.col("looks") - 1), lambda i: F.struct(i.alias("i"), F.col("at").alias("j")))
    gone = F.transform(F.sequence(F.lit(0), F.col("homes") - 1), lambda j: F.struct(F.col("as").alias("i"), j.alias("j")))
    each = F.explode(F.when(F.col("apart"), F.array_union(there, gone)).otherwise(there)).alias("m")
    met = dealt.select("sig", "node", "component", "at", "as", each)
    key = F.xxhash64("sig", "m.i", "m.j").alias("key")
    return settle(met.select(key, "node", "component", (F.col("m.i").eqNullSafe(F.col("as"))).alias("looks"), (F.col("m.j") == F.col("at")).alias("home")), "blocks")


def _across(blocks: DataFrame, share: tuple[int, int]) -> DataFrame:
    """key, a, b: the pairs of every block, as ``forest`` gives them."""
    schema = "key long; a long; b long"
    names = blocks.columns

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None

        def done() -> pa.RecordBatch:
            found = forest(held, share) if len(held) > 1 else []
            return _batch(schema, [pa.array(x, pa.int64()) for x in ([last] * len(found), [x[0] for x in found], [x[1] for x in found])])

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in names), strict=True):
                if row[0] != last:
                    yield done()
                    held, last = [], row[0]
                held.append(row[1:])
        yield done()

    return blocks.repartition("key").sortWithinPartitions("key", "node").mapInArrow(grow, schema.replace("; ", ", "))


def connect(links: DataFrame, name: str = "components") -> DataFrame:
    """node, component (the smallest node reachable) of undirected links a - b, by alternating stars.

    Each round links every node's larger neighbours, then its smaller ones, to its smallest; the number of rounds
    is logarithmic. Partial minima keep nodes with very many links from meeting in one task.
    """
    edges = settle(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), name)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        after = small.select("u", F.col("m").alias("v")).unionByName(small.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))).filter("u != v").distinct()
        after = settle(after, name)
        # done when it is a set of stars: nobody has two parents and no parent has one
        twice = after.groupBy("u").count().filter("count > 1").limit(1)
        chained = after.join(after.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1)
        if not twice.select(F.lit(1)).unionAll(chained.select(F.lit(1))).take(1):
            return after.select(F.col("u").alias("node"), F.col("v").alias("component"))
        edges = after


def similar_sets(groups: DataFrame, nodes: DataFrame, share: tuple[int, int]) -> DataFrame:
    """node, component of the nodes that are alike to others."""
    ties = groups.filter("node != first").groupBy("node", "first").count().groupBy("node").agg(F.max_by("first", F.struct("count", "first")).alias("first"))
    links = settle(_verify(ties.select(F.col("first").alias("a"), F.col("node").alias("b")), nodes, share), "ties")
    blocks = _open(groups, nodes, connect(links))
    columns = ["key", "node", "component", "n", "sketch", "looks", "home"]
    facts = nodes.select("node", "n", "sketch")
    near = settle(_across(blocks.join(facts, "node").select(*columns), share), "near")
    links = links.unionByName(settle(_verify(near.select("a", "b").distinct(), nodes, share), "links"))
    # blocks with pairs that didn't hold: those that have pairs within the bound between today's components
    now = blocks.join(near.select("key").distinct(), "key").drop("component").join(connect(links), "node", "left")
    now = settle(now.withColumn("component", F.coalesce("component", "node")), "near-blocks")
    left = _across(now.join(facts, "node").select(*columns), share).select("key").distinct()
    whole = now.join(left, "key").join(nodes, "node").select(*columns, "shingles")
    return connect(links.unionByName(_across(whole, share).select("a", "b")))


def jaccard_components(docs: DataFrame, shingle: int = SHINGLE, share: tuple[int, int] = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, _th, n_shingles, component_id, stays (the first of its component) of every row.

    component_id is the smallest id reachable by links, itself included. A text with fewer words than a shingle has
    one, its whole sequence; a null, empty or blank text has none and links with nothing. Equal sets are alike. Rows
    with equal ids are documents of their own; a null id has a null component unless it is linked to others. Every
    row of the input gives one row; other columns are ignored; an empty table gives an empty one. Very long texts are
    worked on whole, one at a time.
    """
    rows = keyed(docs, id_col, text_col)
    met = _meeting(_scan(rows, shingle, share))
    found = met.filter("doc is not null").select("node", "doc.*")
    firsts = found.filter("n > 0").groupBy("node").agg(F.min(F.struct("_id", "_th")).alias("first"))
    groups = _groups(met)
    nodes = _nodes(rows, firsts.select("node", "first.*"), groups, shingle, share)
    labels = similar_sets(groups, nodes, share)
    of_node = firsts.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = of_node.groupBy("component").agg(F.min("first").alias("least"))
    named = of_node.select("node", "component").join(smallest, "component").select("node", "least")
    both = found.join(named, "node", "left")
    least = F.col("least._id").eqNullSafe(F.col("_id")) & (F.col("least._th") == F.col("_th"))
    return both.select("_id", "_th", F.col("n").cast("long").alias("n_shingles"), F.coalesce("least._id", "_id").alias("component_id"), ((F.col("n") == 0) | least).alias("stays"))


def jaccard_dedup(docs: DataFrame, shingle: int = SHINGLE, share: tuple[int, int] = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without those linked to another: of each component the one with the smallest id stays, once.

    Texts without a word are linked with nothing and all stay. Rows that are listed once and stay are filtered where
    they are; the others are few, or go through a join.
    """
    cols = docs.columns
    found = settle(jaccard_components(docs, shingle, share, id_col, text_col), "found").filter("n_shingles > 0")
    marked = found.groupBy("_id", "_th").agg(F.max("stays").alias("stays"), F.count("*").alias("k")).filter("not stays or k > 1")
    marked = settle(marked.select(row_key().alias("key"), "stays"), "marked")
    rows, bits = keyed(docs, id_col, text_col, cols), bitmap(marked)
    other = maybe(rows, bits).withColumn("key", row_key()).join(marked, "key", "left")
    once = other.filter("stays").dropDuplicates(["key"])
    return carried(maybe(rows, bits, False), cols, text_col).unionByName(carried(other.filter("stays is null"), cols, text_col)).unionByName(carried(once, cols, text_col))


def op5_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir)).select(F.col("_id").alias("doc_id"), "n_shingles", "component_id")


OP5_SQL = rf"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select distinct doc_id, array_to_string(ws[p:p+3], ' ') as g from (select doc_id, ws, unnest(range(1, len(ws) - 2)) as p from w where len(ws) >= 4)
 union all select doc_id, array_to_string(ws, ' ') from w where len(ws) between 1 and 3),
n as (select doc_id, count(*) as n from s group by doc_id),
i as (select a.doc_id as a, b.doc_id as b, count(*) as i from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select a, b from i join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 85 * (x.n + y.n - i)),
e as (select a, b from l union select b, a from l),
r as (select doc_id, doc_id as other from documents union select r.doc_id, e.b from r join e on e.a = r.other)
select r.doc_id, coalesce(any_value(n.n), 0)::bigint as n_shingles, min(other) as component_id from r left join n on n.doc_id = r.doc_id group by r.doc_id
"""
