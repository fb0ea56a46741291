"""N-gram Jaccard join by PartEnum signatures: exact links between shingle sets of similarity ``low`` or more.

Sizes fall into bands; a set also takes part in the band below if a partner could be there. In a band the
feature domain is partitioned, and each non-empty part of a set gives one signature, the hash of the
set's elements in it. Linked sets differ in at most ``k = size // 3`` elements (similarity 3/4), so of the
``t`` parts a set touches, at least ``t - k`` are equal in both. Hence linked sets share one of their
``k + 1`` rarest signatures, whatever the order, as long as one of them has ``t > k``. Sets with ``t <= k`` keep
all signatures and add one for each element, so two such sets share one as well. Nothing is lost.

Signatures go to buckets packed, one row for a set and bucket; equal sets count once. Only signatures
that occur twice leave the buckets. Links are verified on the texts: each set with the most central one of
its bucket, then, where a bucket still spans several components, with a further centre, and after ``STARS``
centres the pairs across components that are left: by a join in small buckets, by blocks in large ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import blocks, lean
from .common import buckets, partitions, written
from .components import components
from .shingles import U, groups, mix, packed, shingle_sets

LEAST = 12  # sets of at most so many elements: each element is a part of its own
_ALL, STARS, SMALL = 1 << 30, 2, 16
_SENT = "bucket int, node long, doc_id long, n long, band int, t int, k int, parts binary"
_MET = "kind int, doc_id long, node long, n long, band int, t int, k int, part long, sets long"


def _top(band: np.ndarray) -> np.ndarray:
    return LEAST << band


def _band(n: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(np.maximum(n, LEAST) / LEAST)).astype(np.int64)


def _domain_parts(band: np.ndarray) -> np.ndarray:
    top = _top(band)
    return np.ceil(top / np.where(top <= 200, 1.6, 2.0)).astype(np.int64)


def signatures(owner: np.ndarray, element: np.ndarray, size: np.ndarray) -> Iterator[tuple]:
    """(set numbers, bands, t, k, owner view, signature) of the views of sorted sets; the owner view points into the first four."""
    band = _band(size)
    lower = _band(-(-3 * size // 4))
    for views, own in ((np.flatnonzero(size > 0), band), (np.flatnonzero((size > 0) & (lower < band)), lower)):
        if not len(views):
            continue
        of_set = np.full(len(size), -1)
        of_set[views] = np.arange(len(views))
        view = of_set[owner]
        e, view = element[view >= 0], view[view >= 0]
        b = own[views]
        parts = _domain_parts(b)[view].astype(U)
        single = b[view] == 0
        part = np.where(single, mix(e), mix(e ^ U(0xA0761D6478BD642F)) % parts)
        order = np.lexsort((part, view))
        v, p, x = view[order], part[order], mix(e[order] + U(0xE7037ED1A0B428DB))
        at = groups(v, p)
        value = np.add.reduceat(x, at) if len(at) else x
        v, p = v[at], p[at]
        sig = mix(value + b[v].astype(U) * U(0x8EBC6AF09C88C6E3) + p * U(0x589965CC75374CC3))
        t = np.bincount(v, minlength=len(views))
        k = np.minimum(size[views], _top(b)) // 3
        few = (t <= k) & (b > 0)
        k = np.where(few, _ALL, k)
        more = few[view]
        sig = np.concatenate([sig, mix(e[more] + b[view[more]].astype(U) * U(0x1D8E4E27C47D124F) + U(1))])
        yield views, b, t, k, np.concatenate([v, view[more]]), sig


def _send(n_buckets: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()  # contents this task has sent: copies send one set of signatures a task
        for batch in batches:
            for block in blocks(batch, 1):
                ids = block.column(0)
                owner, element = shingle_sets(block.column(1), width)
                size = np.bincount(owner, minlength=len(ids))
                key = np.zeros(len(ids), U)
                at = groups(owner)
                key[owner[at]] = mix(np.add.reduceat(mix(element + U(0x9FB21C651E98DF25)), at) + size[owner[at]].astype(U)) if len(at) else key[:0]
                node = key.view(np.int64)
                yield _rows(mix(np.arange(len(ids), dtype=U) + key) % U(n_buckets), node, ids, size, np.full(len(ids), -1), *(np.zeros(len(ids)),) * 2, None)
                valid = np.asarray(ids.is_valid())
                new = np.array([valid[i] and size[i] > 0 and x not in sent and not sent.add(x) for i, x in enumerate(node.tolist())], dtype=bool)
                keep = new[owner]
                for views, band, t, k, view, sig in signatures(owner[keep], element[keep], np.where(new, size, 0)):
                    bucket = sig % U(n_buckets)
                    order = np.lexsort((bucket, view))
                    view, bucket, sig = view[order], bucket[order], sig[order]
                    at = groups(view, bucket)
                    v = view[at]
                    parts = packed((sig >> U(16)).view(np.uint8).reshape(-1, 8)[:, :6], np.diff(np.append(at, len(sig))))
                    yield _rows(bucket[at], node[views[v]], None, size[views[v]], band[v], t[v], k[v], parts)

    return run


def _rows(bucket, node, ids, n, band, t, k, parts) -> pa.RecordBatch:
    m = len(node)
    columns = [pa.array(bucket.astype(np.int32)), pa.array(node), ids if ids is not None else pa.nulls(m, pa.int64()), pa.array(n.astype(np.int64)), *(pa.array(np.asarray(x).astype(np.int32)) for x in (band, t, k)), parts if parts is not None else pa.nulls(m, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["bucket", "node", "doc_id", "n", "band", "t", "k", "parts"])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bucket partition: documents pass, signatures that only one content has go."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        mine = np.asarray(batch.column(4)) < 0
        docs = batch.filter(pa.array(mine))
        if docs.num_rows:
            zero = pa.array(np.zeros(docs.num_rows, np.int64))
            yield pa.RecordBatch.from_arrays([zero.cast(pa.int32()), docs.column(2), docs.column(1), docs.column(3), *(zero.cast(pa.int32()),) * 3, zero, zero], names=["kind", "doc_id", "node", "n", "band", "t", "k", "part", "sets"])
        rest = batch.filter(pa.array(~mine))
        if rest.num_rows:
            offsets = np.frombuffer(rest.column(7).buffers()[1], np.int32)[rest.column(7).offset :][: rest.num_rows + 1]
            raw = np.frombuffer(rest.column(7).buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(-1, 6)
            wide = np.zeros((len(raw), 8), np.uint8)
            wide[:, :6] = raw
            held.append([*(np.asarray(rest.column(i)) for i in (0, 1, 3, 4, 5, 6)), np.diff(offsets) // 6, wide.view(U).ravel()])
    if not held:
        return
    bucket, node, n, band, t, k, size, sig = (np.concatenate(x) for x in zip(*held))
    held.clear()
    # one row of each content, band and bucket
    order = np.lexsort((bucket, band, node))
    first = np.zeros(len(node), bool)
    first[order[groups(node[order], band[order], bucket[order])]] = True
    row = np.repeat(np.arange(len(node)), size)
    keep = first[row]
    row, sig = row[keep], sig[keep]
    sig = mix(sig * U(0x9E3779B97F4A7C15) + bucket[row].astype(U))  # a signature number for the whole job
    order = np.argsort(sig)
    row, sig = row[order], sig[order]
    at = groups(sig)
    count = np.diff(np.append(at, len(sig)))
    many = np.repeat(count > 1, count)
    row, sig, count = row[many], sig[many], np.repeat(count, count)[many]
    for i in range(0, len(row), 200_000):
        r = row[i : i + 200_000]
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(r), np.int32)), pa.nulls(len(r), pa.int64()), pa.array(node[r]), pa.array(n[r]), pa.array(band[r]), pa.array(t[r]), pa.array(k[r]), pa.array(sig[i : i + 200_000].view(np.int64)), pa.array(count[i : i + 200_000].astype(np.int64))], names=["kind", "doc_id", "node", "n", "band", "t", "k", "part", "sets"])


def _verify(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, (2, 3)):
                a, b = (shingle_sets(block.column(i), width) for i in (2, 3))
                na, nb = (np.bincount(x[0], minlength=block.num_rows) for x in (a, b))
                owner, element = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
                order = np.lexsort((element, owner))
                owner, element = owner[order], element[order]
                same = (owner[1:] == owner[:-1]) & (element[1:] == element[:-1])
                both = np.bincount(owner[1:][same], minlength=block.num_rows)
                linked = pa.array((100 * both >= percent * (na + nb - both)) & (both > 0))
                yield pa.RecordBatch.from_arrays([block.column(0), block.column(1)], names=["a", "b"]).filter(linked)

    return run


def similar_sets(docs: DataFrame, width: int = 5) -> tuple[DataFrame, DataFrame]:
    """(documents, links). Documents: doc_id, node, n; equal sets have the same node (a 64-bit content hash).

    Links: verified pairs of different nodes a < b, enough of them to connect every component. The bound
    on differing elements is that of similarity 3/4.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n, n_buckets = partitions(spark), buckets(spark)
    met = written(rows.mapInArrow(lean(_send(n_buckets, width)), _SENT).repartitionById(n, F.col("bucket") % n).mapInArrow(lean(_meet), _MET), "signatures")
    documents = met.where("kind = 0").select("doc_id", F.when(F.col("n") > 0, F.col("node")).alias("node"), "n")

    mine = Window.partitionBy("node", "band")
    shared = met.where("kind = 1").withColumn("met", F.count("*").over(mine)).withColumn("central", F.sum("sets").over(mine) / F.col("t"))
    shared = shared.withColumn("rank", F.row_number().over(mine.orderBy("sets", "part")))
    rare = shared.where("rank <= k + 1 - (t - met)").select("part", "node", "n", "central")
    # buckets of the same sets say the same, so one of them stays
    members = rare.groupBy("part").agg(F.bit_xor(F.xxhash64("node")).alias("who"), F.count("*").alias("sets")).where("sets > 1")
    kept = written(rare.join(members.groupBy("who", "sets").agg(F.min("part").alias("part")).select("part"), "part"), "candidates")
    first = documents.join(kept.select("node").distinct(), "node").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    texts = written(_texts_of(rows, first, width), "texts")

    links = tested = None
    for step in range(STARS + 1):
        if step:
            label = components(links)
            kept = kept.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
            mixed = kept.groupBy("part").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("part")
            kept = written(kept.join(mixed, "part"), "open")
            if kept.isEmpty():
                break
        else:
            kept = kept.withColumn("component", F.col("node"))
        if step < STARS:
            # the most central set of a bucket, first outside the last centre's component, with all sets of other components
            outside = F.col("component") != F.col("centre_component") if step else F.lit(True)
            lead = kept.groupBy("part").agg(F.max_by(F.struct("node", "n", "component"), F.struct(outside, "central", "node")).alias("lead"))
            kept = kept.drop("centre_component").join(lead, "part").withColumn("centre_component", F.col("lead.component"))
            pairs = kept.where("component <> lead.component").selectExpr("least(node, lead.node) as x", "greatest(node, lead.node) as y", "n as x_n", "lead.n as y_n")
            kept = kept.where("node <> lead.node").drop("component", "lead")  # a centre has met every set of its bucket
        else:
            sized = kept.join(kept.groupBy("part").agg(F.count("*").alias("many"), F.max("n").alias("top")), "part")
            x = sized.where(f"many <= {SMALL}").selectExpr("part", "node as x", "n as x_n", "component as x_c")
            y = sized.where(f"many <= {SMALL}").selectExpr("part", "node as y", "n as y_n", "component as y_c")
            pairs = x.join(y, "part").where("x < y and x_c <> y_c")
            across = written(_across_blocks(sized.where(f"many > {SMALL}"), texts, width), "links")
            links = links.union(across)
        pairs = pairs.where("4 * least(x_n, y_n) >= 3 * greatest(x_n, y_n)").select("x", "y").distinct()
        pairs = written(pairs if tested is None else pairs.join(tested, ["x", "y"], "left_anti"), "pairs")
        tested = pairs if tested is None else tested.union(pairs)
        found = written(_verified(pairs, texts, width), "links")
        links = found if links is None else links.union(found)
    return documents, links


def _across_blocks(rows: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """Links across components in large buckets, without a row for a pair.

    A bucket's sets are dealt into blocks of bounded size; two blocks at a time meet in a task, which counts all
    shared elements by matrix products and gives of the links found a spanning forest only.
    """
    size = F.greatest(F.lit(32), F.least(F.lit(1024), F.floor(F.lit(200_000) / F.col("top")))).cast("int")
    rows = rows.withColumn("blocks", F.ceil(F.col("many") / size).cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j")))
    met = rows.join(texts, "node").select("part", "node", "component", "text", F.explode(meets).alias("m"))
    return met.select("part", "m.i", "m.j", "node", "component", "text").groupBy("part", "i", "j").applyInArrow(_block_links(width), "a long, b long").distinct()


def _block_links(width: int):
    def run(table: pa.Table) -> pa.Table:
        node, component = (np.asarray(table.column(c).combine_chunks()) for c in ("node", "component"))
        owner, element = shingle_sets(table.column("text").combine_chunks(), width)
        n = np.bincount(owner, minlength=len(node))
        known, place, count = np.unique(element, return_inverse=True, return_counts=True)
        shared = count[place] > 1
        number = np.cumsum(count > 1) - 1
        owner, place = owner[shared], number[place[shared]]
        both = np.zeros((len(node), len(node)), dtype=np.float32)
        order = np.argsort(place, kind="stable")
        owner, place = owner[order], place[order]
        for first in range(0, int(place[-1]) + 1 if len(place) else 0, 4096):
            a, b = np.searchsorted(place, [first, first + 4096])
            has = np.zeros((len(node), 4096), dtype=np.float32)
            has[owner[a:b], place[a:b] - first] = 1
            both += has @ has.T
        linked = (100 * both >= 75 * (n[:, None] + n[None, :] - both)) & (both > 0)
        group = np.unique(component, return_inverse=True)[1]
        out = []
        for i, j in zip(*np.nonzero(np.triu(linked, 1) & (component[:, None] != component[None, :]))):
            if group[i] != group[j]:  # not yet connected by a link given here
                group[group == group[j]] = group[i]
                out.append((node[i], node[j]))
        return pa.table({"a": pa.array([min(x) for x in out], pa.int64()), "b": pa.array([max(x) for x in out], pa.int64())})

    return run


def _texts_of(rows: DataFrame, first: DataFrame, width: int) -> DataFrame:
    """(node, text) of one document for each node; the content is hashed again, as a doc_id may be repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, 1):
                owner, element = shingle_sets(block.column(1), width)
                size, key, at = np.bincount(owner, minlength=block.num_rows), np.zeros(block.num_rows, U), groups(owner)
                if len(at):
                    key[owner[at]] = mix(np.add.reduceat(mix(element + U(0x9FB21C651E98DF25)), at) + size[owner[at]].astype(U))
                right = key.view(np.int64) == np.asarray(block.column(0))
                yield pa.RecordBatch.from_arrays([block.column(0), block.column(1)], names=["node", "text"]).filter(pa.array(right))

    return rows.join(first, "doc_id").select("node", "text").mapInArrow(lean(run), "node long, text string").dropDuplicates(["node"])


def _verified(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    with_y = pairs.join(texts.selectExpr("node as y", "text as y_text"), "y")
    with_both = with_y.join(texts.selectExpr("node as x", "text as x_text"), "x")
    return with_both.select("x", "y", "x_text", "y_text").mapInArrow(lean(_verify(width, 75)), "a long, b long")


def jaccard_components(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, n_shingles and component_id of every row.

    Null or empty text, or no words: 0 shingles, linked with nothing. Equal sets are linked. Rows with the
    same doc_id are one document for linking, each with its own n_shingles. Null doc_id: linked with nothing,
    component null. Extra columns are ignored. Empty table: no rows.
    """
    documents, links = similar_sets(docs, width)
    label = components(links)
    own = documents.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = own.where("n > 0 and doc_id is not null").groupBy("component").agg(F.min("doc_id").alias("least"))
    ids = label.join(ids, "component").select("node", "least").union(ids.select(F.col("component").alias("node"), "least")).distinct()
    out = documents.join(ids, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, width: int = 5) -> DataFrame:
    """The rows of ``docs`` with the smallest doc_id of their component, all columns unchanged; null doc_ids stay.

    Repeated rows of one doc_id are copies, so one of them stays.
    """
    found = written(jaccard_components(docs, width), "components")
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("gone_id")).distinct()
    kept = docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")
    if found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return kept
    return kept.where("doc_id is not null").dropDuplicates(["doc_id"]).union(kept.where("doc_id is null"))
