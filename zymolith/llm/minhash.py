"""Near-duplicate classes by BagMinHash signatures and verified multiset overlap.

A text is the multiset of its five-word shingles.  Two texts are linked if the
weighted Jaccard similarity of their multisets (sum of the lesser counts over
sum of the greater) is 0.8 or more; classes are the connected components.

Signature.  A shingle's weight axis is cut into the intervals [0,1), [1,2),
[2,4), [4,8), ...; each interval has its own Poisson process of points (time,
place on the weight axis, register), with a rate in proportion to its width and
the number of registers.  A text of weight c keeps the points below c, and a
register holds its first point.  Two texts agree in a register with the
probability of their weighted Jaccard similarity, without bias.  A process is
followed only as long as it can still matter: to the time by which all registers
of the text are filled, so a long text costs few points a shingle.

Links.  Texts with equal multisets are one node.  Bands of registers bring nodes
into buckets; buckets with the same members count once.  A bucket is searched
breadth-first: a node is compared with the nodes that no link has reached yet,
so copies of one text cost one comparison each and links are emitted as a
spanning forest, never as all pairs.  A bucket of more than BLOCK_SHINGLES, or of
more than BLOCK_ROWS texts, is cut into blocks.  Each block is searched by itself and with the bucket's hub, which
joins the blocks' main parts; then the nodes outside the bucket's main component
are compared with the whole bucket, block by block.  Of two nodes that meet in a
bucket either both are in its main component or one has been compared with the
other, so no link between components is lost, no task holds a bucket, and a
group of near copies costs its size, not its square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import empty_text, small_side, written
from .text import U64, Words, blocks, gram_hashes, pair, salted, words_of

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
BLOCK_SHINGLES = 100_000
#: Texts of a block, so that a block of short texts is no larger task than others.
BLOCK_ROWS = 256
BROADCAST_ROWS = 1 << 18
_BLOCK = 1 << 20
#: A process is followed until a register stays empty with probability exp(-_SLACK) a text.
_SLACK = 7.0
#: Points that are drawn at once.
_CELLS = 1 << 18


def multisets(w: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, count) of the distinct shingles; a text of fewer than ``k`` words is one shingle."""
    at, h = gram_hashes(w.hash, w.first, k)
    doc = np.searchsorted(w.first, at, "right") - 1
    n = np.diff(w.first)
    few = np.flatnonzero((n > 0) & (n < k))
    if len(few):
        start, whole = w.first[few], salted(n[few].astype(U64), 77)
        for j in range(k - 1):
            live = n[few] > j
            whole[live] = pair(whole[live], w.hash[start[live] + j])
        doc, h = np.concatenate([doc, few]), np.concatenate([h, whole])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(h)))


def bag_minhash(doc: np.ndarray, shingle: np.ndarray, count: np.ndarray, n: int, registers: int) -> np.ndarray:
    """Signatures (n rows of ``registers`` times); rows of texts without shingles stay infinite."""
    out = np.full((n, registers), np.inf)
    weight = np.bincount(doc, count, n)
    todo, slack = weight > 0, _SLACK
    while todo.any():
        limit = (np.log(registers) + slack) / np.maximum(weight, 1)
        out[todo] = np.inf
        flat = out.reshape(-1)
        for level in range(64):
            low, width = (0, 1) if level == 0 else (1 << (level - 1), 1 << (level - 1))
            at = np.flatnonzero((count > low) & todo[doc])
            if not len(at):
                break
            seed, t = salted(shingle[at], 5000 + level), np.zeros(len(at))
            first, run = 0, 1
            while len(at):
                # arrivals first .. first + run - 1 of each process that goes on
                h = salted(seed[:, None], 0) + np.arange(first, first + run, dtype=U64)
                gap = -np.log1p(-((salted(h, 1) >> U64(11)).astype(float) + 0.5) / 2.0**53) / (registers * width)
                # summed one by one, so the times do not depend on how many are drawn at once
                when = np.cumsum(np.concatenate([t[:, None], gap], 1), 1)[:, 1:]
                row, col = np.nonzero(when <= limit[doc[at], None])
                g = salted(h[row, col], 2)
                if width > 1:
                    place = low + (g >> U64(32)) % U64(width)
                    fits = place < count[at[row]].astype(U64)
                    row, col, g = row[fits], col[fits], g[fits]
                reg = (g & U64(0xFFFFFFFF)) % U64(registers)
                np.minimum.at(flat, doc[at[row]] * registers + reg.astype(np.int64), when[row, col])
                on = when[:, -1] <= limit[doc[at]]
                at, seed, t = at[on], seed[on], when[on, -1]
                first, run = first + run, max(1, min(run * 4, 64, _CELLS // max(len(at), 1)))
        todo &= np.isinf(out).any(1)
        slack *= 2
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = signature.view(U64)
    out = np.empty((len(bits), bands), U64)
    for b in range(bands):
        h = salted(bits[:, b * rows], b)
        for r in range(1, rows):
            h = pair(h, bits[:, b * rows + r])
        out[:, b] = h
    return out


def _nodes(doc: np.ndarray, shingle: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each multiset, independent of order; different ones agree with probability 2**-64."""
    each = pair(salted(shingle, 31), count.astype(U64))
    total, mixed = np.zeros(n, U64), np.zeros(n, U64)
    np.add.at(total, doc, each)
    np.bitwise_xor.at(mixed, doc, salted(each, 9))
    return pair(total, mixed)


def _print(text_col: str):
    return F.xxhash64(empty_text(text_col))


def signatures(docs: DataFrame, bands: int, rows: int, id_col: str, text_col: str, prints: bool = False) -> DataFrame:
    """(id, node, size, keys) for each row, and ``print``, a hash of the text, if asked for; ``keys`` is empty for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in blocks(batch.column(1), _BLOCK):
                n = b - a
                doc, shingle, count = multisets(words_of(batch.column(1).slice(a, n)))
                keys = band_keys(bag_minhash(doc, shingle, count, n, bands * rows), bands, rows)
                size = np.bincount(doc, count, n).astype(np.int64)
                each = np.where(size > 0, bands, 0)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(each)]).astype(np.int32)), pa.array(keys[size > 0].reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, n), pa.array(_nodes(doc, shingle, count, n).view(np.int64)), pa.array(size), lists, *(c.slice(a, n) for c in batch.columns[2:])], ["id", "node", "size", "keys", *more]
                )

    more = ["print"] * prints
    own = docs.select(F.col(id_col).cast("long").alias("id"), empty_text(text_col).alias("text"), *(_print(text_col).alias(c) for c in more))
    return own.mapInArrow(run, ", ".join(["id long, node long, size long, keys array<long>", *(f"{c} long" for c in more)]))


def spanning_links(doc: np.ndarray, shingle: np.ndarray, count: np.ndarray, n: int, similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``n`` multisets (sorted by document)."""
    names, term = np.unique(shingle, return_inverse=True)
    weight, first = np.bincount(doc, count, n), np.searchsorted(doc, np.arange(n + 1))
    free = np.ones(n, bool)
    rows, terms, counts = doc, term, count
    seen, links = np.zeros(len(names), np.int64), []
    for root in range(n):
        if not free[root]:
            continue
        free[root] = False
        queue = [root]
        while queue:
            q = queue.pop()
            a, b = first[q], first[q + 1]
            seen[term[a:b]] = count[a:b]
            common = np.bincount(rows, np.minimum(counts, seen[terms]), n)
            seen[term[a:b]] = 0
            met = np.flatnonzero(free & (common > 0) & (common >= similarity * (weight + weight[q] - common) - 1e-9))
            if len(met):
                links += [(q, int(x)) for x in met]
                queue += met.tolist()
                free[met] = False
                left = free[rows]
                rows, terms, counts = rows[left], terms[left], counts[left]
            if not len(rows):
                return links
        left = free[rows]
        rows, terms, counts = rows[left], terms[left], counts[left]
    return links


def cross_links(doc: np.ndarray, shingle: np.ndarray, count: np.ndarray, n: int, query: np.ndarray, component: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links of the multisets marked ``query`` to those of other components, one for each component that is met."""
    names, term = np.unique(shingle, return_inverse=True)
    weight, first = np.bincount(doc, count, n), np.searchsorted(doc, np.arange(n + 1))
    label = np.unique(component, return_inverse=True)[1]
    seen, links = np.zeros(len(names), np.int64), []
    for q in np.flatnonzero(query):
        a, b = first[q], first[q + 1]
        seen[term[a:b]] = count[a:b]
        common = np.bincount(doc, np.minimum(count, seen[term]), n)
        seen[term[a:b]] = 0
        met = np.flatnonzero((label != label[q]) & (common > 0) & (common >= similarity * (weight + weight[q] - common) - 1e-9))
        for x in met.tolist():
            if label[x] != label[q]:
                links.append((int(q), x))
                label[label == label[x]] = label[q]
    return links


def _texts(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, text), one row a node, of the documents with the given ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in blocks(batch.column(0), _BLOCK):
                texts = batch.column(0).slice(a, b - a)
                node = _nodes(*multisets(words_of(texts)), b - a)
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), texts], ["node", "text"])

    wanted = ids.select(F.col("id").alias("__zy_id")).distinct()
    own = docs.select(F.col(id_col).cast("long").alias("id"), empty_text(text_col).alias("text"))
    own = own.join(small_side(wanted, BROADCAST_ROWS), F.col("id").eqNullSafe(F.col("__zy_id")), "left_semi")
    return own.select("text").mapInArrow(run, "node long, text string").groupBy("node").agg(F.first("text").alias("text"))


def _groups(rows: DataFrame, texts: DataFrame, keys: list[str], search) -> DataFrame:
    """Links (u, v) that ``search(doc, shingle, count, n, rows)`` finds in each group of ``rows`` (keys, node, ...)."""
    more = [c for c in rows.columns if c not in (*keys, "node")]
    both = rows.join(texts, "node").select(*keys, "node", *more, "text")

    def call(group: pa.Table) -> pa.Table:
        node = group["node"].to_numpy()
        if more:  # of a node that asks and is asked, the row that asks
            group = group.take(np.argsort(~group["query"].to_numpy(zero_copy_only=False), kind="stable"))
            node = group["node"].to_numpy()
        picked = np.sort(np.unique(node, return_index=True)[1])
        group, node = group.take(picked), node[picked]
        doc, shingle, count = multisets(words_of(group["text"].combine_chunks()))
        links = search(doc, shingle, count, len(node), {c: group[c].to_numpy(zero_copy_only=False) for c in more})
        u, v = (np.array(links, np.int64).T if links else np.zeros((2, 0), np.int64))
        return pa.table({"u": node[u], "v": node[v]})

    return both.groupBy(*keys).applyInArrow(call, "u long, v long")


def near_links(sigs: DataFrame, docs: DataFrame, similarity: float, id_col: str, text_col: str, block_shingles: int) -> DataFrame:
    """Verified links (u, v) between nodes that leave the same components as all links between nodes of one bucket."""
    nodes = sigs.where("size > 0").groupBy("node").agg(F.min("id").alias("id"), F.max("size").alias("size"), F.first("keys").alias("keys"))
    nodes = written(nodes, "nodes")
    rows = nodes.select("node", "id", "size", F.explode("keys").alias("key"))
    prints = [F.bit_xor(F.xxhash64(F.lit(k), "node")).alias(f"p{k}") for k in (1, 2)]
    buckets = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"), F.min("node").alias("hub"), *prints).where("n > 1")
    buckets = buckets.groupBy("n", "p1", "p2").agg(F.min("key").alias("key"), F.max("total").alias("total"), F.min("hub").alias("hub"))
    enough = lambda shingles, texts: F.ceil(F.greatest(shingles / F.lit(block_shingles), texts / F.lit(BLOCK_ROWS))).cast("int")
    cut = enough(F.col("total"), F.col("n")).alias("cut")
    buckets = buckets.select("key", "hub", cut)
    block = F.pmod(F.xxhash64(F.lit(3), "node"), F.col("cut")).cast("int").alias("block")
    members = written(rows.join(buckets, "key").select("key", "node", "id", "size", "hub", "cut", block), "members")
    text = written(_texts(docs, members, id_col, text_col), "bucket-texts")

    # each block by itself, and the bucket's hub with every block
    alone = members.select("key", "block", "node")
    hubs = members.where("cut > 1 and node = hub").select("key", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)).alias("block"), "node")
    links = written(_groups(alone.unionByName(hubs), text, ["key", "block"], lambda d, s, c, n, _: spanning_links(d, s, c, n, similarity)), "links")
    large = members.where("cut > 1")
    if large.isEmpty():
        return links

    # nodes of a large bucket outside its main component against the whole bucket
    label = components(links)
    large = written(large.join(label, "node", "left").withColumn("component", F.coalesce("component", "node")), "large")
    main = large.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"))
    rest = large.join(main, "key").where(F.col("component") != F.col("main"))
    parts = rest.groupBy("key").agg(enough(F.sum("size"), F.count(F.lit(1))).alias("parts"))
    part = F.pmod(F.xxhash64(F.lit(4), "node"), F.col("parts")).cast("int").alias("part")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    base = large.join(parts, "key").select("key", "block", every("parts").alias("part"), "node", "component", F.lit(False).alias("query"))
    asked = rest.join(parts, "key").select("key", every("cut").alias("block"), part, "node", "component", F.lit(True).alias("query"))
    more = _groups(base.unionByName(asked), text, ["key", "block", "part"], lambda d, s, c, n, x: cross_links(d, s, c, n, x["query"], x["component"], similarity))
    return links.unionByName(written(more, "links"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text", block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(doc_id, class_id, class_size, kept), one row per row of ``docs``.

    ``class_id`` is the least id of the class; the row with that id is kept.  At
    similarity 0.8 two texts share a bucket with probability above 0.9999 for 24
    bands of 5.

    Texts of one to four words are one shingle.  Null or empty texts are equal to
    each other and to nothing else: one class.  Equal texts are one class.  Rows
    with one id are kept or dropped alike; a null id is above all others.  Other
    columns are ignored; an empty table gives an empty result.
    """
    sigs = written(signatures(docs, bands, rows, id_col, text_col), "signatures")
    links = near_links(sigs, docs, similarity, id_col, text_col, block_shingles)
    label = written(components(links), "components")
    per_node = sigs.groupBy("node").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    per_node = per_node.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    classes = per_node.groupBy("component").agg(F.min("first").alias("class_id"), F.sum("n").alias("class_size"))
    named = per_node.select("node", "component").join(classes, "component").drop("component")
    out = sigs.select("id", "node").join(named, "node")
    return out.select(F.col("id").alias("doc_id"), "class_id", "class_size", F.col("id").eqNullSafe(F.col("class_id")).alias("kept"))


def _kept_rows(docs: DataFrame, similarity: float, bands: int, rows: int, id_col: str, text_col: str, block_shingles: int) -> DataFrame:
    """(id, print, n, kept): the rows of each id and text, and whether one of them is what its class keeps."""
    sigs = written(signatures(docs, bands, rows, id_col, text_col, True), "signatures")
    label = written(components(near_links(sigs, docs, similarity, id_col, text_col, block_shingles)), "components")
    row = F.struct(F.col("id").isNull().alias("no_id"), "id", "print")
    per_node = sigs.groupBy("node").agg(F.min(row).alias("first")).join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = per_node.groupBy("component").agg(F.min("first").alias("first"))
    named = per_node.select("node", "component").join(first, "component").drop("component")
    out = sigs.select("id", "print", "node").join(named, "node")
    kept = row.eqNullSafe(F.col("first")).alias("kept")
    return out.select("id", "print", kept).groupBy("id", "print", "kept").agg(F.count(F.lit(1)).alias("n"))


def drop_near_copies(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text", block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one row of each class.

    The row is told by its id and text, so null or repeated ids neither take other
    texts along nor keep a second row; of equal rows one is kept.
    """
    decided = written(_kept_rows(docs, similarity, bands, rows, id_col, text_col, block_shingles), "near-copies")
    own = docs.withColumns({"__zy_own": F.col(id_col).cast("long"), "__zy_own_print": _print(text_col)})
    same = F.col("__zy_own").eqNullSafe(F.col("__zy_id")) & (F.col("__zy_own_print") == F.col("__zy_print"))
    named = lambda rows: rows.select(F.col("id").alias("__zy_id"), F.col("print").alias("__zy_print"))
    twice = named(decided.where("kept and n > 1"))
    gone = named(decided.where("not kept or n > 1"))
    out = own.join(small_side(gone, BROADCAST_ROWS), same, "left_anti")
    if not twice.isEmpty():
        again = own.join(small_side(twice, BROADCAST_ROWS), same, "left_semi")
        out = out.unionByName(again.dropDuplicates(["__zy_own", "__zy_own_print"]))
    return out.select(*docs.columns)
