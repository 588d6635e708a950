"""SimHash near-duplicates: fingerprints of word shingles, linked by a self-join of binary tries."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.llm.common import dealt, hold, keep, ship, whole_keys
from deltaloom.llm.components import components

BITS = 64
#: A bucket with more fingerprints is joined in blocks of this size, block pair by block pair.
BLOCK = 4096
#: Fingerprints that a top node holds on average, at most about: the more there are, the more bits are on top.
IN_BUCKET = 64
#: Node pairs that are expanded at once, and the leaf pairs of a node pair that are not worth more levels.
FRONTIER = 1 << 17
FEW = 1 << 10


def fingerprint(text: str | None, words: int = 3) -> int:
    """Unsigned fingerprint: A-Z lower-cased, words between blanks, shingles of `words` words with repeats, XXH64 seed 42.

    A bit is 1 if it is set in over half the hashes. Fewer words than a shingle: the whole sequence; none: 0.
    """
    import numpy as np
    import xxhash

    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = xxhash.xxh64_intdigest
    if len(w) <= words:
        return h(b" ".join(w), 42)
    joined, ends = b" ".join(w), []
    at = -1
    for x in w:
        at += len(x) + 1
        ends.append(at)
    begins = [0, *(e + 1 for e in ends)]
    hashes = np.array([h(joined[a:b], 42) for a, b in zip(begins, ends[words - 1 :])], "<u8")
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)]
        ones += np.add.reduce(np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, BITS), axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp): fp as a signed long with the fingerprint's bits."""
    ship(docs.sparkSession)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        hold("simhash")
        for batch in batches:
            fp = [fingerprint(batch.column("text")[i].as_py(), words) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(fp, np.uint64).astype(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def labels_of(n, a, b):
    """For n nodes and links a[i]-b[i]: the smallest node of each node's component."""
    import numpy as np

    lab = np.arange(n)
    while len(a):
        la, lb = lab[a], lab[b]
        differ = la != lb
        if not differ.any():
            break
        a, b = a[differ], b[differ]
        hi, lo = np.maximum(la, lb)[differ], np.minimum(la, lb)[differ]
        np.minimum.at(lab, hi, lo)
        while True:
            nxt = lab[lab]
            if (nxt == lab).all():
                break
            lab = nxt
    return lab


def trie_walk(group, value, depth: int, budget: int, same):
    """Walk the pairs of nodes of binary tries; yields index arrays (p, q) of the leaf pairs that are left.

    Each group is a trie over the low `depth` bits of value (sorted by group, then value). The pairs of its nodes are walked
    together from the root pair down; a pair carries the bits that differ so far and is dropped beyond the budget. same()
    gives the labels known so far: a pair whose leaves all have one label can add nothing and is dropped too, so a dense
    group does not cost all its pairs. Where a node pair has FEW leaf pairs or less, or no level is left, they are
    yielded, to be decided by all their bits at once. Nodes are intervals of the sorted array.
    """
    import numpy as np

    n = len(value)
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    last = np.r_[first[1:], n]
    many = last - first > 1
    ones: dict[int, np.ndarray] = {}

    def split(a0, a1, level):
        if level not in ones:
            ones[level] = np.r_[0, np.cumsum((value >> np.uint64(depth - 1 - level)) & np.uint64(1)).astype(np.int64)]
        return a1 - (ones[level][a1] - ones[level][a0])

    stack = [(0, first[many], last[many], first[many], last[many], np.zeros(int(many.sum()), np.int8))]
    while stack:
        level, a0, a1, b0, b1, d = stack.pop()
        if len(a0) > FRONTIER:
            half = len(a0) // 2
            stack += [(level, *(x[k] for x in (a0, a1, b0, b1, d))) for k in (slice(half, None), slice(0, half))]
            continue
        lab = same()
        runs = np.r_[0, np.cumsum(lab[1:] != lab[:-1])]
        open_ = (runs[a1 - 1] != runs[a0]) | (runs[b1 - 1] != runs[b0]) | (lab[a0] != lab[b0])
        a0, a1, b0, b1, d = (x[open_] for x in (a0, a1, b0, b1, d))
        leaf = (a1 - a0) * (b1 - b0) <= FEW if level < depth else np.ones(len(a0), bool)
        if leaf.any():
            yield from _leaf_pairs(a0[leaf], a1[leaf], b0[leaf], b1[leaf])
            a0, a1, b0, b1, d = (x[~leaf] for x in (a0, a1, b0, b1, d))
        if not len(a0):
            continue
        am, bm = split(a0, a1, level), split(b0, b1, level)
        off = ~((a0 == b0) & (a1 == b1))
        # fields of a child: a0, a1, b0, b1, d
        kids = [np.concatenate(x) for x in zip((a0, am, b0, bm, d), (am, a1, bm, b1, d), (a0, am, bm, b1, d + 1), (am[off], a1[off], b0[off], bm[off], d[off] + 1))]
        k0, k1, k2, k3, kd = kids
        alive = (k1 > k0) & (k3 > k2) & (kd <= budget) & ~((k0 == k2) & (k1 - k0 == 1) & (k1 == k3))
        if alive.any():
            stack.append((level + 1, *(x[alive] for x in kids)))


def _leaf_pairs(a0, a1, b0, b1):
    """The leaf pairs of node pairs, about FRONTIER at once; those of a node with itself once each."""
    import numpy as np

    wide, tall = a1 - a0, b1 - b0
    ends = np.cumsum(wide * tall)
    cuts = np.unique(np.r_[0, np.searchsorted(ends, np.arange(FRONTIER, ends[-1] + FRONTIER, FRONTIER)) + 1, len(ends)].clip(0, len(ends)))
    for x, y in zip(cuts.tolist(), cuts[1:].tolist()):
        many = (wide * tall)[x:y]
        at = np.repeat(np.arange(x, y), many)
        inner = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
        across = inner // tall[at]
        p, q = a0[at] + across, b0[at] + inner - across * tall[at]
        once = (p < q) | (a0 != b0)[at]
        yield p[once], q[once]


def bits_apart(words, p, q):
    """Differing bits of fingerprints p[i] and q[i]; words: a list of uint64 arrays."""
    import numpy as np

    out = np.zeros(len(p), np.int16)
    for w in words:
        out += np.bitwise_count(w[p] ^ w[q])
    return out


def trie_links(group, value, depth: int, budget: int, decide=None):
    """Component labels of values (sorted by group, then value) linked at `budget` bits or fewer: see trie_walk.

    decide(p, q): which leaf pairs link, if the trie holds only a part of what is compared; default: by the values' bits.
    """
    import numpy as np

    n = len(value)
    if n < 2:
        return np.arange(n)
    value = value.astype(np.uint64)
    decide = decide or (lambda p, q: bits_apart([value], p, q) <= budget)
    edge = np.flatnonzero(group[1:] == group[:-1])
    near = edge[decide(edge, edge + 1)]
    found = [(near, near + 1)]
    lab = labels_of(n, near, near + 1)
    for p, q in trie_walk(group, value, depth, budget, lambda: lab):
        open_ = lab[p] != lab[q]
        p, q = p[open_], q[open_]
        hit = decide(p, q)
        if hit.any():
            found.append((p[hit], q[hit]))
            lab = labels_of(n, *(np.concatenate(x) for x in zip(*found)))
            at = np.flatnonzero(lab != np.arange(n))
            found = [(at, lab[at])]
    return lab


def tops(rows: int, budget: int) -> list[tuple[int, ...]]:
    """The tries: which of equal blocks of the bits are on top of each. Returns tuples of (first bit, bits) pairs.

    Two fingerprints within the budget differ in at most `budget` blocks, so of m blocks they agree in m - budget at least.
    Each choice of m - budget blocks is a trie, so none is missed whatever m; m grows with the rows, so that a top node
    holds about IN_BUCKET fingerprints at most.
    """
    blocks = budget + 1
    while blocks < budget + 3 and rows > IN_BUCKET << (BITS * (blocks - budget) // blocks):
        blocks += 1
    cuts = [BITS * k // blocks for k in range(blocks + 1)]
    spans = [(a, b - a) for a, b in zip(cuts, cuts[1:])]
    return list(combinations(spans, blocks - budget))


def near_links(spark: SparkSession, classes: DataFrame, budget: int = 3, blocks: list | None = None) -> DataFrame:
    """Links (a, b) that connect every pair of classes (fp, rep) whose fingerprints differ in `budget` bits or fewer.

    The trie join is dealt out by its top levels: several tries, each with other bits on top (see tops). Two fingerprints
    within the budget agree in the top bits of one trie, so there they meet under one top node, and only pairs of a top
    node with itself need a walk. Each (trie, top node) is a bucket; its links come back as a star per component, at most
    one row per fingerprint. A bucket over BLOCK fingerprints is dealt out as pairs of blocks. Tasks stream whole keys.
    """
    ship(spark)
    tries = blocks or tops(classes.count(), budget)

    def top(k: int, spans) -> F.Column:
        out, at = F.lit(k << 40).cast("long"), 0
        for first, bits in spans:
            out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << bits) - 1).cast("long")), at))
            at += bits
        return out

    rows = classes.select(F.explode(F.array(*(top(k, spans) for k, spans in enumerate(tries)))).alias("bucket"), "fp", "rep")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        hold("simhash")
        for t in whole_keys(batches):
            key, bucket, fp, rep = (t.column(c).to_numpy() for c in ("key", "bucket", "fp", "rep"))
            trie, rest = bucket >> 40, np.zeros(len(fp), np.uint64)
            for k in np.unique(trie).tolist():
                at = np.flatnonzero(trie == k)
                rest[at] = without(fp[at].view(np.uint64), tries[k])
            # 64-bit keys of two buckets may be equal: the bucket is compared too
            order = np.lexsort((rest, bucket, key))
            key, bucket, rest, rep = key[order], bucket[order], rest[order], rep[order]
            group = np.cumsum(np.r_[True, (key[1:] != key[:-1]) | (bucket[1:] != bucket[:-1])])
            for bits in {sum(b for _, b in s) for s in tries}:
                at = np.flatnonzero(np.isin(bucket >> 40, [k for k, s in enumerate(tries) if sum(b for _, b in s) == bits]))
                lab = trie_links(group[at], rest[at], BITS - bits, budget)
                linked = np.flatnonzero(lab != np.arange(len(lab)))
                yield pa.RecordBatch.from_arrays([pa.array(rep[at][linked]), pa.array(rep[at][lab[linked]])], ["a", "b"])

    return dealt(spark, rows, ["bucket"], "fp", BLOCK).select("key", "bucket", "fp", "rep").mapInArrow(run, "a long, b long").distinct()


def without(fp, spans):
    """The fingerprints' bits outside the spans (first bit, bits), moved together."""
    import numpy as np

    out, at, low = np.zeros(len(fp), np.uint64), 0, 0
    for first, bits in [*spans, (BITS, 0)]:
        if first > low:
            out |= ((fp >> np.uint64(low)) & np.uint64((1 << (first - low)) - 1)) << np.uint64(at)
            at += first - low
        low = first + bits
    return out


def near_groups(docs: DataFrame, words: int = 3, budget: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs whose doc_id is not null; component_id is the smallest doc_id reachable.

    Equal fingerprints are one node (its smallest doc_id), so copies are never paired. Texts without words, null ones
    included, have fingerprint 0 and are linked like any other. A doc_id that repeats is one document with several
    fingerprints, each linked. Rows with a null doc_id come back with a null component. An empty table gives no rows.
    """
    spark = docs.sparkSession
    fps, _ = keep(spark, fingerprints(docs, words), "fps")
    classes, _ = keep(spark, fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    repeats = fps.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).where("x <> y").select("doc_id")
    again = fps.join(repeats, "doc_id").join(classes, "fp").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    comp = components(spark, near_links(spark, classes, budget).unionAll(again), "a", "b")
    of = classes.join(comp, classes.rep == comp.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    out = fps.join(of, "fp", "left")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
