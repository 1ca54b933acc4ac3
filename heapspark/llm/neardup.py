"""Near duplicates by b-bit MinHash: bands give candidates, bit counts estimate, full sets confirm.

Documents are linked where the Jaccard similarity of their word-shingle sets reaches a threshold.
Documents with equal sets are one node, so copies never make pairs.

Candidates are settled in two ways.  Most links come from rounds in which random blocks of a band's
bucket find each node's best partner; their cost follows the rows.  Buckets that then still hold
several components get a closer look: two sets of the wanted similarity share one of their rarest
shingles, so nodes meet by rare shingles only, and longer packed signatures estimate each pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import discard, free_name, join_counted, materialize, slices, text_hash, text_of

WORDS = 5
BANDS, ROWS = 32, 4  # at similarity 0.75 a pair shares no band with odds of 5e-6
BITS = 4  # low bits kept of each minimum
HASHES = BANDS * ROWS
#: A pair whose estimate is five standard deviations below 0.75 is no candidate.
LEAST_ESTIMATE = 0.55
#: Members of a bucket that one task compares with each other.
BLOCK = 512
#: Rounds in which random blocks find each node's best partner.
ROUNDS = 2
#: Longer signatures of nodes whose buckets stay mixed: minima and low bits of each.
LONG_HASHES, LONG_BITS = 1024, 2
#: Five standard deviations of the longer estimate, at its widest.
LONG_MARGIN = 0.085

_ODD = np.random.default_rng(20_240_229).integers(0, 2**32, (2, HASHES + LONG_HASHES), dtype=np.uint32)
_MUL, _ADD = _ODD[0] | np.uint32(1), _ODD[1]
_K = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the different word shingles; with fewer words, of the whole sequence."""
    found = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, and white space is \x20, \x09-\x0D
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    width = min(words, len(found))
    n = len(h) - width + 1
    out = np.full(n, width, np.uint64)
    for i in range(width):
        out = (out ^ h[i : i + n]) * _K
        out ^= out >> np.uint64(31)
    return np.unique(out)


def minima(s: np.ndarray, first: int = 0, n: int = HASHES) -> np.ndarray:
    """Least value of each of n hash functions over the set."""
    low, best = (s >> np.uint64(32)).astype(np.uint32), np.full(n, 0xFFFFFFFF, np.uint32)
    mul, add = _MUL[first : first + n], _ADD[first : first + n]
    step = 65_536 // n
    for at in range(0, len(low), step):
        np.minimum(best, (low[at : at + step, None] * mul + add).min(axis=0), out=best)
    return best


def band_keys(m: np.ndarray) -> np.ndarray:
    out = np.arange(1, BANDS + 1, dtype=np.uint64) * _K
    for row in m.reshape(BANDS, ROWS).T.astype(np.uint64):
        out = (out ^ row) * _K
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def packed(m: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The low bits of scrambled minima, packed into 64-bit words."""
    low = ((m * np.uint32(0x85EBCA6B)) >> np.uint32(16)).astype(np.uint64) & np.uint64(2**bits - 1)
    each = 64 // bits
    return np.bitwise_or.reduce(low.reshape(-1, each) << (np.arange(each, dtype=np.uint64) * np.uint64(bits)), axis=1).view(np.int64)


def estimates(a: np.ndarray, b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Similarity of packed signatures, corrected for chance agreement of their bits."""
    x = a.view(np.uint64) ^ b.view(np.uint64)
    for i in range(bits.bit_length() - 1):
        x |= x >> np.uint64(1 << i)
    ones = np.uint64(sum(1 << i for i in range(0, 64, bits)))
    agree = 1 - np.bitwise_count(x & ones).sum(axis=-1) / (x.shape[-1] * (64 // bits))
    chance = 1 / 2**bits
    return (agree - chance) / (1 - chance)


def signatures(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, text_hash, n_shingles, s1, s2, bands, sig): s1, s2 identify the shingle set."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, ids, bands, sigs = [], [], [], []
            for text in batch.column("text").to_pylist():
                s = shingles(text, words)
                m = minima(s)
                d = xxhash.xxh128_digest(s.tobytes())
                n.append(len(s))
                ids.append((int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)))
                bands.append(band_keys(m))
                sigs.append(packed(m))
            s1, s2 = zip(*ids) if ids else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "n_shingles", "s1", "s2", "bands", "sig"],
            )

    named = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), text_hash().alias("text_hash"))
    return named.mapInArrow(sign, "doc_id long, text_hash long, n_shingles long, s1 long, s2 long, bands array<long>, sig array<long>")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows of equal keys, whole, from a stream that is sorted by keys; many small groups at once are cut without copies."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        cols = np.stack([table.column(k).to_numpy() for k in keys])
        cuts = np.flatnonzero((cols[:, 1:] != cols[:, :-1]).any(axis=0)) + 1
        edges = [0, *cuts.tolist()]
        yield from (table.slice(a, b - a) for a, b in zip(edges, edges[1:]) if b - a > 1)
        rest = table.slice(edges[-1])
    if rest is not None and rest.num_rows > 1:
        yield rest


def _matrix(t: pa.Table) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in t.column("sig").chunks]).reshape(t.num_rows, -1)


def _emit(rows: list[tuple]) -> pa.RecordBatch:
    a, b, e = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(e, pa.float64())], names=["a", "b", "estimate"])


def _nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each node in a block its best partner in another component."""
    out: list[tuple] = []
    for t in _groups(batches, ["bucket", "block"]):
        node, comp, sigs = t.column("node").to_numpy(), t.column("comp").to_numpy(), _matrix(t)
        for i in range(len(node)):
            js = np.flatnonzero(comp != comp[i])
            if len(js):
                est = estimates(sigs[i], sigs[js])
                j = int(est.argmax())
                if est[j] >= LEAST_ESTIMATE:
                    out.append((int(node[i]), int(node[js[j]]), float(est[j])))
        if len(out) > 20_000:
            yield _emit(out)
            out = []
    yield _emit(out)


def _across(percent: int):
    """Pairs of a rare shingle's nodes in different components that may reach the threshold.

    Every node is at home in one block; those outside the shingle's largest component also visit
    the other blocks, so each pair of different components meets.  pos: the shingle's place in the node's set,
    rarest first.  Where it is the first that two sets share, they share no more than what follows it.
    """
    least = percent / 100 - LONG_MARGIN

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for t in _groups(batches, ["h", "block"]):
            node, comp, n, after, home, roams = (t.column(c).to_numpy(zero_copy_only=False) for c in ("node", "comp", "n", "after", "home", "roams"))
            sigs = _matrix(t)
            for i in np.flatnonzero(roams).tolist():
                other = home & (comp != comp[i]) & (~roams | (node > node[i]))
                most = np.minimum(after[i], after)
                js = np.flatnonzero(other & (100 * most >= percent * (n[i] + n - most)))
                if len(js):
                    est = estimates(sigs[i], sigs[js], LONG_BITS)
                    good = est >= least
                    out += [(min(int(node[i]), j), max(int(node[i]), j), e) for j, e in zip(node[js[good]].tolist(), est[good].tolist())]
            if len(out) > 20_000:
                yield _emit(out)
                out = []
        yield _emit(out)

    return compare


_EDGE = "a long, b long, estimate double"


def _sets(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(node, hashes) of the rows that stand for nodes; hashes ascend as unsigned numbers."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [shingles(t, words).view(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.list_(pa.int64()))], names=["node", "hashes"])

    named = docs.select(F.col("doc_id").alias("at_id"), F.coalesce("text", F.lit("")).alias("text"), text_hash().alias("at_hash"))
    wanted = named.join(nodes.select("node", "at_id", "at_hash"), ["at_id", "at_hash"]).select("node", "text")
    return wanted.mapInArrow(build, "node long, hashes array<long>").dropDuplicates(["node"])  # repeated rows


def _confirmed(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges whose full sets reach the threshold."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            sides = [(c.values.to_numpy(zero_copy_only=False).view(np.uint64), c.offsets.to_numpy()) for c in (batch.column("x"), batch.column("y"))]
            for i in range(batch.num_rows):
                x, y = (v[at[i] : at[i + 1]] for v, at in sides)
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                if 100 * len(small) < percent * len(large):
                    ok.append(False)
                    continue
                at = np.searchsorted(large, small)
                both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    left = edges.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, comp) for every node in links (a, b): comp is the least node that it reaches.

    Large-star and small-star steps in turn: the number of rounds grows with the logarithm of the
    longest path, and no node's neighbours are gathered in one row or task: hubs are met by
    broadcast.  Each round's edges are written out and the round's before it removed.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), name)
    last, n = None, edges.count()
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("k")).select("u", F.least("u", "m").alias("m"), "k")
        large = join_counted(both.where("v > u"), least, ["u"], "k", 2 * n, "v").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("k"))
        small = join_counted(large, down, ["u"], "k", 2 * n, "v").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v")))
        edges = materialize(small.where("u <> v").distinct(), name, instead_of=edges)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == last:
            break
        last, n = now, now[0]
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def _labelled(members: DataFrame, comp: DataFrame) -> DataFrame:
    """members with the component of each node; a node without links is its own."""
    return members.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def _mixed(shared: DataFrame, comp: DataFrame, total: int) -> DataFrame:
    """(node, comp, bucket, size) of the buckets that hold several components."""
    labelled = _labelled(shared, comp)
    mixed = labelled.groupBy("bucket").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.count(F.lit(1)).alias("k")).where("c1 <> c2")
    return join_counted(labelled, mixed.select("bucket", "k"), ["bucket"], "k", total, "node").drop("k")


def _best_links(mixed: DataFrame, sig: DataFrame, salt: int) -> DataFrame:
    """(a, b): each node of mixed buckets with its best partner in a random block of one of its buckets."""
    block = F.pmod(F.xxhash64("node", F.lit(salt)), F.ceil(F.col("size") / BLOCK)).cast("int")
    rows = mixed.join(sig, "node").select("bucket", block.alias("block"), "node", "comp", "sig")
    found = rows.repartition("bucket", "block").sortWithinPartitions("bucket", "block", "node").mapInArrow(_nearest, _EDGE)
    best = found.groupBy("a").agg(F.max_by("b", F.struct("estimate", -F.col("b"))).alias("b"))
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _rare(sets: DataFrame, mixed: DataFrame, percent: int) -> DataFrame:
    """(node, comp, n, h, after): each node's rarest shingles, as many as two sets of the wanted similarity need to share one.

    Rarity is counted over the nodes of mixed buckets.  after: how many of the node's shingles are
    no rarer than h, itself included.  A shingle of one node alone has no partner, but takes a place.
    """
    member = mixed.select("node", "comp").distinct()
    own = materialize(sets.join(member, "node"), "mixed-sets")
    each = own.select("node", F.explode("hashes").alias("h"))
    total = own.agg(F.sum(F.size("hashes"))).first()[0] or 0
    freq = materialize(each.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "frequencies")
    known = join_counted(each, freq, ["h"], "k", total, "node").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("k", "h"))).alias("kh"))  # no longer than the node's own set
    n = F.size("hashes").cast("long")
    placed = known.join(own.select("node", "comp", n.alias("n")), "node")
    alone = F.col("n") - F.size("kh")
    wanted = F.col("n") - F.ceil(F.col("n") * F.lit(percent) / 100) + 1
    prefix = F.slice("kh", F.lit(1), F.greatest(F.lit(0), wanted - alone).cast("int"))
    return placed.select("node", "comp", "n", alone.alias("alone"), F.posexplode(prefix).alias("i", "x")).select("node", "comp", "n", F.col("x.h").alias("h"), (F.col("n") - F.col("alone") - F.col("i")).alias("after"))


def _long_signatures(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, sig) with LONG_HASHES minima."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column("hashes")
            v, at = col.values.to_numpy(zero_copy_only=False).view(np.uint64), col.offsets.to_numpy()
            found = [packed(minima(v[at[i] : at[i + 1]], HASHES, LONG_HASHES), LONG_BITS) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.list_(pa.int64()))], names=["node", "sig"])

    return sets.join(nodes, "node", "left_semi").select("node", "hashes").mapInArrow(sign, "node long, sig array<long>")


def _remaining_pairs(sets: DataFrame, mixed: DataFrame, percent: int) -> DataFrame:
    """(a, b): every pair of different components of mixed buckets that shares a rare shingle and may reach the threshold."""
    rare = materialize(_rare(sets, mixed, percent), "rare")
    by_comp = rare.groupBy("h", "comp").agg(F.count(F.lit(1)).alias("c"))
    groups = by_comp.groupBy("h").agg(F.count(F.lit(1)).alias("comps"), F.sum("c").alias("size"), F.max_by("comp", F.struct("c", "comp")).alias("main")).where("comps > 1").select("h", "size", "main")
    met = materialize(join_counted(rare, groups, ["h"], "size", rare.count(), "node"), "met")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    met = met.withColumn("at", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("roams", F.col("comp") != F.col("main"))
    visits = F.when(F.col("roams"), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array("at"))
    sig = materialize(_long_signatures(sets, met.select("node").distinct()), "long-signatures")
    dealt = met.join(sig, "node").select("*", F.explode(visits).alias("block")).withColumn("home", F.col("block") == F.col("at"))
    dealt = dealt.select("h", "block", "node", "comp", "n", "after", "home", "roams", "sig").repartition("h", "block").sortWithinPartitions("h", "block", "node")
    return dealt.mapInArrow(_across(percent), _EDGE).select("a", "b").distinct()


def _resolved(docs: DataFrame, percent: int, words: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, kept) of each row of docs."""
    signed = materialize(signatures(docs, words).withColumn("row", F.monotonically_increasing_id()), "signatures")
    has_set = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    # A node is named by one of its rows, since rows of one id may have different sets.
    nodes = signed.where(has_set).groupBy("s1", "s2").agg(
        F.min("row").alias("node"), F.min_by(F.struct("doc_id", "text_hash"), "row").alias("at"), F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"), F.first("sig").alias("sig"),
    )
    nodes = materialize(nodes.select("s1", "s2", "node", F.col("at.doc_id").alias("at_id"), F.col("at.text_hash").alias("at_hash"), "least_id", "copies", "bands", "sig"), "nodes")
    sig = nodes.select("node", "sig")

    member = nodes.select("node", F.explode("bands").alias("bucket"))
    full = member.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = materialize(join_counted(member, full, ["bucket"], "size", BANDS * nodes.count(), "node"), "buckets")
    sets = materialize(_sets(docs, nodes.join(shared.select("node").distinct(), "node", "left_semi"), words), "sets")
    total = shared.count()

    links = docs.sparkSession.createDataFrame([], "a long, b long")
    comp = docs.sparkSession.createDataFrame([], "node long, comp long")
    for step in range(ROUNDS + 1):
        mixed = materialize(_mixed(shared, comp, total), "mixed")
        if step < ROUNDS:
            pairs = _best_links(mixed, sig, step)
        else:
            pairs = _remaining_pairs(sets, mixed, percent)
        more = materialize(_confirmed(pairs, sets, percent), "links")
        discard(mixed)
        if not more.isEmpty():
            links = links.union(more)
            comp = components(links)

    labelled = materialize(_labelled(nodes.select("s1", "s2", "node", "least_id", "copies"), comp), "labelled")
    names = labelled.groupBy("comp").agg(F.min("least_id").alias("component"), F.count(F.lit(1)).alias("k"))
    named = join_counted(labelled, names, ["comp"], "k", labelled.count(), "node").select("s1", "s2", "copies", "component")
    # Rows without a set match nothing and are dealt by their own row.
    apart = signed.select("doc_id", "text_hash", "n_shingles", F.when(has_set, F.col("s1")).otherwise(F.col("row")).alias("s1"), F.when(has_set, F.col("s2")).alias("s2"))
    found = join_counted(apart, named, ["s1", "s2"], "copies", signed.count(), F.struct("doc_id", "text_hash"), "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "text_hash", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_duplicates(docs: DataFrame, percent: int = 75, words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row for each row of docs.

    Candidates are nodes that share a band.  In ROUNDS rounds each bucket that holds several
    components is dealt into random blocks, each node meets its block, and its best partner by
    packed signatures is checked on full sets.  Nodes of buckets that are mixed after that meet by
    their rarest shingles, and every pair that the sizes, the places of the shared shingles and a longer
    signature (five standard deviations) do not rule out is checked.  So no bucket is capped, a
    bucket of one component costs its rows, and every pair that shares a band is in one component, or
    ruled out, or checked on full sets.

    Null or empty texts, and texts of white space alone, have no shingles and are linked with
    nothing.  Rows with a null id are linked with nothing and kept.  Repeated rows have equal
    sets and so one component; the row whose id is the component's stays, so rows that repeat its
    id and its set all stay.  Rows of one id with different texts are told apart: each has its own set
    and component.  An empty table gives no rows.  Other columns are ignored.
    """
    return _resolved(docs, percent, words).select("doc_id", "n_shingles", "component_id", "kept")


def keep_first(docs: DataFrame, percent: int = 75, words: int = WORDS) -> DataFrame:
    """Rows of docs that near_duplicates() keeps, told by id and text: the least id of each component."""
    gone = _resolved(docs, percent, words).where(~F.col("kept")).select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct()
    at = free_name(docs, "at_hash")
    keyed = docs.withColumn(at, text_hash())
    return keyed.join(gone, (keyed["doc_id"] == gone["gone_id"]) & (keyed[at] == gone["gone_hash"]), "left_anti").select(*docs.columns)
