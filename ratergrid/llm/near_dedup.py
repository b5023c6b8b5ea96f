"""Near duplicates by circulant MinHash, banding and exact Jaccard verification.

1. Each text becomes its set of shingles; equal sets are one node. Band keys come from a circulant MinHash signature
   of the set.
2. In every bucket of a band each node is paired with the smallest node there only, so a bucket of m nodes makes
   m - 1 pairs. Pairs that the sketches can't rule out are verified on the full sets; links give components.
3. Buckets whose nodes are now in one component are done. In the others, nodes outside the bucket's largest
   component meet all nodes there, in blocks of about 2 x ``SKETCH_BLOCK`` nodes that carry only sizes and sketches.
   What these don't rule out is compared on full sets, in blocks of at most 2 x ``BLOCK`` nodes; a block gives back
   at most one link for each merge. Every pair that shares a bucket is then ruled out, verified or already in one
   component, so no link that banding and sketches can see is lost, and no bucket is written out as pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ratergrid.llm.common import id_text, quoted, text_hash, whole_text
from ratergrid.llm.components import compose, connect
from ratergrid.llm.shingles import Circulant, mix64, shingle_set, word_hashes, words_of
from ratergrid.session import stored

#: 32 bands of 4 coordinates miss a pair of similarity 0.75 with probability 5e-6.
BANDS, ROWS = 32, 4
#: One bit of each of 256 coordinates. At similarity 0.75 224 agree on average; fewer than 195 have odds of 3e-8.
LEAST_AGREEING = 195
#: Nodes of a bucket that meet in one task: by sketches (48 bytes a node), then those left on full sets.
SKETCH_BLOCK, BLOCK = 4096, 256
#: Up to so many text hashes (8 bytes each) are broadcast to pick the texts that are compared; more are joined.
BROADCAST_HASHES = 2_000_000
SIMILARITY = (75, 100)
_SKETCH = ["_s0", "_s1", "_s2", "_s3"]
_CIRCULANT = Circulant()
_BAND_MIX = np.random.default_rng(5).integers(1, 2**63, ROWS, dtype=np.uint64) | np.uint64(1)


def is_link(inter, a, b):
    """100 * intersection >= 75 * union, on numbers, arrays or columns."""
    part, whole = SIMILARITY
    return inter * whole >= (a + b - inter) * part


def band_keys(signature: np.ndarray) -> np.ndarray:
    rows = signature[:BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
    with np.errstate(over="ignore"):
        return mix64(mix64((rows * _BAND_MIX).sum(axis=1, dtype=np.uint64)) + np.arange(BANDS, dtype=np.uint64))


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = word_hashes().__getitem__
    for batch in batches:
        sizes, digests, sketches, keys = [], [], [], []
        for text in batch.column(3):
            found = np.fromiter(map(hashes, words_of(text.as_py())), np.uint64)
            grams = shingle_set(found)
            sizes.append(len(grams))
            if not len(grams):
                digests.append(None)
                sketches.append(np.zeros(4, np.int64))
                keys.append(np.zeros(0, np.int64))
                continue
            signature = _CIRCULANT.signature(grams)
            digests.append(xxhash.xxh3_128_digest(grams.tobytes()))
            sketches.append(np.packbits((signature & 1).astype(np.uint8)).view(np.int64))
            keys.append(band_keys(signature).view(np.int64))
        offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
        bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*keys, np.zeros(0, np.int64)])))
        sketch = np.array(sketches, np.int64).reshape(-1, 4)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
             *(pa.array(sketch[:, i]) for i in range(4)), bands],
            names=["doc_id", "_row", "text_hash", "n_shingles", "_set", *_SKETCH, "_bands"])


def signed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Set sizes and digests, sketches and band keys of all rows, written once."""
    source = docs.select(F.col(quoted(id_col)).alias("doc_id"), F.monotonically_increasing_id().alias("_row"),
                         text_hash(text_col).alias("text_hash"), whole_text(text_col).alias("_text"))
    kind = source.schema[0].dataType.simpleString()
    return stored(source.mapInArrow(
        _signed, f"doc_id {kind}, _row long, text_hash long, n_shingles long, _set binary, _s0 long, _s1 long, _s2 long, "
                 "_s3 long, _bands array<long>"), "signed")


def _may_link(a: str, b: str) -> Column:
    """Pairs that sizes and sketches don't rule out."""
    differ = sum((F.bit_count(F.col(f"{a}{s}").bitwiseXOR(F.col(f"{b}{s}"))) for s in _SKETCH[1:]),
                 F.bit_count(F.col(f"{a}{_SKETCH[0]}").bitwiseXOR(F.col(f"{b}{_SKETCH[0]}"))))
    small, large = (f(F.col(f"{a}_n"), F.col(f"{b}_n")) for f in (F.least, F.greatest))
    return (256 - differ >= LEAST_AGREEING) & is_link(small, small, large)


def _with(pairs: DataFrame, nodes: DataFrame, side: str, columns: list[str]) -> DataFrame:
    """Columns of the node in ``side``, prefixed with its name."""
    return pairs.join(nodes.select(F.col("_node").alias(side), *[F.col(c).alias(side + c) for c in columns]), side)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = word_hashes().__getitem__
    for batch in batches:
        words = [np.fromiter(map(hashes, words_of(t.as_py())), np.uint64).tobytes() for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.binary())], names=["_node", "_words"])


@dataclass(frozen=True)
class Corpus:
    """The documents, and what was written about their rows."""

    docs: DataFrame
    id_col: str
    text_col: str
    rows: DataFrame

    def words_of(self, ids: DataFrame) -> DataFrame:
        """Word hashes (_node, _words) of the nodes in ``ids`` only, from their texts, written once.

        Texts are found again by id and hash. Few hashes are broadcast, so that only texts that are compared move.
        """
        wanted = self.rows.select(F.col("_row").alias("_node"), id_text(F.col("doc_id")).alias("_id"),
                                  F.col("text_hash").alias("_hash")).join(ids.distinct(), "_node", "left_semi")
        wanted = stored(wanted, "wanted")
        texts = self.docs.select(id_text(F.col(quoted(self.id_col))).alias("_id"),
                                 text_hash(self.text_col).alias("_hash"), whole_text(self.text_col).alias("_text"))
        if wanted.limit(BROADCAST_HASHES + 1).count() <= BROADCAST_HASHES:
            texts = texts.join(F.broadcast(wanted.select("_hash").distinct()), "_hash", "left_semi")
        found = texts.join(wanted, ["_id", "_hash"]).select("_node", "_text").mapInArrow(
            _hashed, "_node long, _words binary")
        return stored(found.groupBy("_node").agg(F.first("_words").alias("_words")), "words")  # rows may repeat


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among pairs (_a, _b, _a_words, _b_words)."""
    last, left = None, None
    for batch in batches:
        a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        keep = []
        for i, (x, wa, wb) in enumerate(zip(a, batch.column(2), batch.column(3))):
            if x != last:
                last, left = x, shingle_set(np.frombuffer(wa.as_py(), np.uint64))
            right = shingle_set(np.frombuffer(wb.as_py(), np.uint64))
            inter = len(np.intersect1d(left, right, assume_unique=True))
            if is_link(inter, len(left), len(right)):
                keep.append(i)
        yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()),
                                          pa.array([b[i] for i in keep], pa.int64())], names=["_a", "_b"])


def _candidates(table: pa.Table) -> pa.Table:
    """Rows (_key, _q, _t, _part, _query, _node, _comp): what sizes and sketches leave of one block, in small blocks.

    Queries come in the order of their first candidate, ``BLOCK`` at a time, with up to ``BLOCK`` of their candidates.
    So queries with few candidates each make about two rows a node.
    """
    query = np.array(table.column("_query").to_pylist(), bool)
    node, comp, size = (table.column(c).to_numpy() for c in ("_node", "_comp", "_n"))
    sketch = np.stack([table.column(c).to_numpy() for c in _SKETCH], axis=1).view(np.uint64)
    asks, others = np.flatnonzero(query), np.flatnonzero(~query)
    near = np.zeros((len(asks), len(others)), bool)
    for i in range(0, len(asks), 64):
        part = asks[i:i + 64, None]
        agree = 256 - np.bitwise_count(sketch[part] ^ sketch[others]).sum(axis=2, dtype=np.int64)
        small, large = np.minimum(size[part], size[others]), np.maximum(size[part], size[others])
        near[i:i + 64] = (agree >= LEAST_AGREEING) & is_link(small, small, large) & (comp[part] != comp[others])
    some = np.flatnonzero(near.any(axis=1))
    some = some[np.argsort(near[some].argmax(axis=1), kind="stable")] if len(some) else some
    rows, parts, flags, n_parts = [], [], [], 0
    for i in range(0, len(some), BLOCK):
        chunk = some[i:i + BLOCK]
        found = np.flatnonzero(near[chunk].any(axis=0))
        for j in range(0, len(found), BLOCK):
            met = found[j:j + BLOCK]
            asking = chunk[near[np.ix_(chunk, met)].any(axis=1)]
            rows += [asks[asking], others[met]]
            flags += [np.ones(len(asking), bool), np.zeros(len(met), bool)]
            parts.append(np.full(len(asking) + len(met), n_parts, np.int32))
            n_parts += 1
    rows = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    same = {c: pa.array(table.column(c).to_numpy()[rows]) for c in ("_key", "_q", "_t")}
    return pa.table({**same, "_part": pa.array(np.concatenate([*parts, np.zeros(0, np.int32)]).astype(np.int32)),
                     "_query": pa.array(np.concatenate([*flags, np.zeros(0, bool)]).astype(bool)),
                     "_node": pa.array(node[rows]), "_comp": pa.array(comp[rows])})


def _block_links(table: pa.Table) -> pa.Table:
    """Links between components among the nodes of one block, one for each merge.

    Rows (_query, _comp, _words): every query row is compared with every other one.
    """
    query = np.array(table.column("_query").to_pylist(), bool)
    comp = table.column("_comp").to_numpy()
    sets = [shingle_set(np.frombuffer(w.as_py(), np.uint64)) for w in table.column("_words")]
    sizes = np.array([len(s) for s in sets])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    flags = np.zeros(int(ids.max()) + 1, bool)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    found = []
    for i in np.flatnonzero(query):
        own = ids[starts[i]:starts[i] + sizes[i]]
        flags[own] = True
        inter = np.add.reduceat(flags[ids], starts, dtype=np.int64)
        flags[own] = False
        for c in np.unique(comp[is_link(inter, sizes, sizes[i]) & (comp != comp[i])]).tolist():
            a, b = root(int(comp[i])), root(c)
            if a != b:
                parent[max(a, b)] = min(a, b)
                found.append((a, b))
    return pa.table({"_a": pa.array([a for a, _ in found], pa.int64()), "_b": pa.array([b for _, b in found], pa.int64())})


def _star_links(members: DataFrame, nodes: DataFrame, corpus: Corpus) -> DataFrame:
    """Verified links of each node with the smallest node of each of its buckets."""
    pairs = members.where("_node != _first").select(F.col("_first").alias("_a"), F.col("_node").alias("_b")).distinct()
    near = _with(_with(stored(pairs, "pairs"), nodes, "_b", ["_n", *_SKETCH]), nodes, "_a", ["_n", *_SKETCH])
    near = stored(near.where(_may_link("_a", "_b")).select("_a", "_b"), "near")
    own = corpus.words_of(near.select(F.explode(F.array("_a", "_b")).alias("_node")))
    full = _with(_with(near, own, "_b", ["_words"]), own, "_a", ["_words"])
    return full.select("_a", "_b", "_a_words", "_b_words").mapInArrow(_verify, "_a long, _b long")


def _left_over(members: DataFrame, labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows (_key, _q, _t, _query, _node, _comp, _n and sketch) of the blocks still to be compared."""
    placed = members.join(labels, "_node", "left").select(
        "_key", "_node", F.coalesce("_comp", "_node").alias("_comp"))
    placed = stored(placed, "placed")
    sizes = stored(placed.groupBy("_key", "_comp").agg(F.count("*").alias("_c")), "sizes")
    open_keys = sizes.groupBy("_key").agg(F.sum("_c").alias("_m"), F.max("_c").alias("_most"),
                                          F.count("*").alias("_parts")).where("_parts > 1 AND _m > 2")
    largest = sizes.join(open_keys, "_key").where("_c = _most").groupBy("_key", "_m", "_most").agg(
        F.min("_comp").alias("_main"))
    keys = stored(largest.select(
        "_key", "_main", F.ceil(F.col("_m") / SKETCH_BLOCK).cast("int").alias("_nt"),
        F.ceil((F.col("_m") - F.col("_most")) / SKETCH_BLOCK).cast("int").alias("_nq")), "open")
    known = ["_node", "_comp", "_n", *_SKETCH]
    rows = placed.join(keys, "_key").join(nodes.drop("_bands"), "_node")
    place = lambda n, salt: F.pmod(F.xxhash64("_node", F.lit(salt)), F.col(n)).cast("int")
    one, every = lambda c: c, lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asks = rows.where("_comp != _main").select("_key", *known, place("_nq", 1).alias("_q"), "_nt")
    asks = asks.select("_key", "_q", every("_nt").alias("_t"), F.lit(True).alias("_query"), *known)
    targets = rows.select("_key", *known, place("_nt", 2).alias("_t"), "_nq").select(
        "_key", every("_nq").alias("_q"), "_t", F.lit(False).alias("_query"), *known)
    return asks.unionByName(targets)


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept, and the 128-bit digest of its set.

    Words lie between blanks, A-Z in lower case; a set has the distinct 5-word shingles, or the whole sequence if
    it is shorter. NULL, empty and blank texts have no shingles, are linked with nothing and stay. component_id
    is the smallest id that links reach; rows that repeat an id or a text are in one component; NULL ids count
    only where a component has no other, its component_id is then NULL. An empty table gives no rows. Other
    columns, whatever their names, are not read. Shingles are compared as 64-bit hashes of 64-bit word hashes.
    """
    return _rows_and_components(docs, id_col, text_col).select(
        "doc_id", "n_shingles", "component_id", "kept", F.lower(F.hex("_set")).alias("set_digest"))


def near_dedup_survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash) of the rows that stay: one row of each component, and all rows without shingles."""
    rows = stored(_rows_and_components(docs, id_col, text_col).where("kept").select(
        "doc_id", "text_hash", "_row", "_comp"), "kept")
    first = rows.where("_comp IS NOT NULL").groupBy("_comp").agg(F.min("_row").alias("_row")).select("_row")
    return rows.join(first, "_row", "left_semi").unionByName(rows.where("_comp IS NULL")).select("doc_id", "text_hash")


def _rows_and_components(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = signed(docs, id_col, text_col)
    corpus = Corpus(docs, id_col, text_col, rows)
    filled = rows.where("n_shingles > 0")
    classes = stored(filled.groupBy("_set").agg(F.min("_row").alias("_node"), F.min("doc_id").alias("_least")),
                     "classes")
    picked = classes.select(F.col("_node").alias("_row"))
    nodes = stored(rows.join(picked, "_row", "left_semi").select(
        F.col("_row").alias("_node"), F.col("n_shingles").alias("_n"), *_SKETCH, "_bands"), "nodes")

    banded = nodes.select("_node", F.explode("_bands").alias("_key"))
    shared = stored(banded.groupBy("_key").agg(F.min("_node").alias("_first"), F.count("*").alias("_m")).where(
        "_m > 1").drop("_m"), "shared")
    members = stored(banded.join(shared, "_key"), "members")

    maps = connect(stored(_star_links(members, nodes, corpus), "links"))
    labels = compose(members.select("_node").distinct(), maps)
    open_blocks = _left_over(members.select("_key", "_node"), stored(labels, "labels"), nodes)
    blocks = stored(open_blocks.groupBy("_key", "_q", "_t").applyInArrow(
        _candidates, "_key long, _q int, _t int, _part int, _query boolean, _node long, _comp long"), "blocks")
    full = blocks.join(corpus.words_of(blocks.select("_node")), "_node").select(
        "_key", "_q", "_t", "_part", "_query", "_comp", "_words")
    more = full.groupBy("_key", "_q", "_t", "_part").applyInArrow(_block_links, "_a long, _b long")
    maps += connect(stored(more, "links"))

    sets = stored(compose(classes, maps), "sets")
    least = stored(sets.groupBy("_comp").agg(F.min("_least").alias("component_id")), "least")
    named = stored(sets.join(least, "_comp").select("_set", "_comp", "component_id"), "named")
    columns = ["doc_id", "text_hash", "_row", "n_shingles", "_set"]
    alone = rows.where("n_shingles = 0").select(
        *columns, F.lit(None).cast("long").alias("_comp"), F.col("doc_id").alias("component_id"))
    return filled.select(*columns).join(named, "_set").unionByName(alone).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NEAR_DEDUP_SQL = rf"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(COALESCE(text, ''),
  '{_UPPER}', '{_LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(
  list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
x AS MATERIALIZED (SELECT doc_id, len(s) AS n, UNNEST(s) AS g FROM s),
links AS MATERIALIZED (SELECT a.doc_id AS p, b.doc_id AS q FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * COUNT(*) >= 75 * (a.n + b.n - COUNT(*))),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.q, r.other FROM reach r JOIN links l
  ON l.p = r.doc_id),
c AS (SELECT doc_id, MIN(other) AS component_id FROM reach GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM s JOIN c ON c.doc_id = s.doc_id"""
