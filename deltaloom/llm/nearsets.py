"""Near copies by the Jaccard similarity of their word shingles: a SimHash trie join finds them, every link is verified.

The fingerprint has WIDE bits: one for each bit of two hashes of every distinct shingle. A pair at similarity s has a
cosine of 2s / (1 + s) at least between its sets, so each bit differs with probability acos(cosine) / pi at most. That
gives the budget of differing bits, and how many tries with how many bits on top find the pair.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.llm.common import dealt, drop_folder, hold, keep, ship, whole_keys
from deltaloom.llm.components import components
from deltaloom.llm.simhash import BITS, bits_apart, trie_links

WORDS = 5
#: Two texts are near copies if they share this part of their shingles or more, as a fraction.
LEAST = (4, 5)
#: Bits of a fingerprint, and the standard errors that the budget of differing bits lies above the mean.
WIDE, ERRORS = 128, 3.3
#: A pair just at the threshold is under no common top node with this probability at most; more similar ones more rarely.
MISSED = 0.002
#: Texts under a top node on average, at most about; fewest bits on top; and texts that are walked in one block.
IN_BUCKET, TOP, BLOCK = 512, 9, 4096
#: Texts whose sets are compared in one block, and words of bit sets that are compared at once.
SETS, AT_ONCE = 1024, 1 << 20
FP = ["f0", "f1"]
SEED = 42
#: Shingles that are counted at once.
CHUNK = 1 << 14


def shingles(text: str | None, words: int = WORDS):
    """Distinct XXH64 hashes of the shingles of `words` words, ascending: A-Z lower-cased, words between blanks.

    Fewer words than a shingle: the whole sequence, also if it is empty.
    """
    import numpy as np
    import xxhash

    w = (text or "").encode().lower().split()
    joined, ends = b" ".join(w), []
    at = -1
    for x in w:
        at += len(x) + 1
        ends.append(at)
    begins = [0, *(e + 1 for e in ends)]
    h = xxhash.xxh64_intdigest
    return np.unique(np.array([h(joined[a:b], 42) for a, b in zip(begins, ends[words - 1 :] or [len(joined)])], np.uint64))


def wide_bits(hashes):
    """The WIDE bits of a set's fingerprint: 1 where over half of the hashes, or of what mixing makes of them, have one."""
    import numpy as np

    ones = np.zeros(WIDE, np.int64)
    for k in range(0, len(hashes), CHUNK):
        h = hashes[k : k + CHUNK]
        for at in range(0, WIDE, BITS):
            x = h ^ np.uint64(at * 0x9E3779B97F4A7C15 % (1 << 64))
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(29)
            ones[at : at + BITS] += np.add.reduce(np.unpackbits(x.view(np.uint8), bitorder="little").reshape(-1, BITS), axis=0, dtype=np.uint32)
    return 2 * ones > len(hashes)


def plan(rows: int, least: tuple[int, int] = LEAST) -> tuple[int, int, int]:
    """(bits on top, tries, budget) for so many texts: see the module's text."""
    s = least[0] / least[1]
    p = math.acos(2 * s / (1 + s)) / math.pi
    top = max(TOP, math.ceil(math.log2(max(rows, 1) / IN_BUCKET)) if rows > IN_BUCKET else 0)
    budget = math.ceil(WIDE * p + ERRORS * math.sqrt(WIDE * p * (1 - p)))
    chance = [math.comb(WIDE, m) * p**m * (1 - p) ** (WIDE - m) for m in range(budget + 1)]
    meet = [math.comb(WIDE - m, top) / math.comb(WIDE, top) for m in range(budget + 1)]
    tries = 1
    while sum(c * (1 - x) ** tries for c, x in zip(chance, meet)) > MISSED:
        tries += 1
    return top, tries, budget


def _fingerprints(rows: DataFrame, words: int) -> DataFrame:
    """rows (tid, row, text) with f0 and f1 in place of text."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        hold("nearsets")
        for batch in batches:
            bits = [wide_bits(shingles(batch.column("text")[i].as_py(), words)) for i in range(batch.num_rows)]
            if bits:
                fp = np.packbits(np.stack(bits), axis=1, bitorder="little").view("<i8")
                yield pa.RecordBatch.from_arrays([batch.column("tid"), batch.column("row"), *(pa.array(fp[:, k].copy()) for k in range(len(FP)))], ["tid", "row", *FP])

    return rows.select("tid", "row", "text").mapInArrow(run, f"tid binary, row {dict(rows.dtypes)['row']}, f0 long, f1 long")


def _under_tops(fps: DataFrame, top: int, tries: int) -> DataFrame:
    """Each fingerprint under its top node of each trie. A trie has `top` bits on top that are chosen by chance, fixed by SEED."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        r = np.random.default_rng(SEED)
        chosen = np.stack([r.permutation(WIDE)[:top] for _ in range(tries)])
        for batch in batches:
            words = np.stack([batch.column(c).to_numpy() for c in FP], 1)
            bits = np.unpackbits(words.astype("<i8").view(np.uint8), axis=1, bitorder="little")
            bucket = (bits[:, chosen].astype(np.int64) << np.arange(top)).sum(2) + (np.arange(tries, dtype=np.int64) << 48)
            rows = np.repeat(np.arange(batch.num_rows), tries)
            yield pa.RecordBatch.from_arrays([pa.array(bucket.ravel()), *(batch.column(c).take(pa.array(rows)) for c in ("node", *FP))], ["bucket", "node", *FP])

    return fps.select("node", *FP).mapInArrow(run, "bucket long, node long, f0 long, f1 long")


def _sets(members: DataFrame, words: int) -> DataFrame:
    """members (bucket, node, f0, f1, text) with the hashes of their shingles in place of text."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        hold("nearsets")
        for batch in batches:
            sets = [shingles(batch.column("text")[i].as_py(), words).view(np.int64) for i in range(batch.num_rows)]
            if sets:
                cuts = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
                hashes = pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("bucket", "node", *FP)), hashes], ["bucket", "node", *FP, "hashes"])

    return members.select("bucket", "node", *FP, "text").mapInArrow(run, "bucket long, node long, f0 long, f1 long, hashes array<long>")


def bit_sets(sets):
    """The sets as rows of 64-bit words, one bit for each element that two sets or more have; no others can be shared."""
    import numpy as np

    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1
    shared = times[place] > 1
    row, bit = row[shared], number[place[shared]]
    width = int(number[-1]) // 64 + 1 if len(number) and number[-1] >= 0 else 1
    out = np.zeros(len(sets) * width, np.uint64)
    if len(row):
        word = row * width + bit // 64
        by = np.argsort(word, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(word[by]) != 0])
        out[word[by][first]] = np.bitwise_or.reduceat(np.uint64(1) << (bit[by] % 64).astype(np.uint64), first)
    return out.reshape(len(sets), width)


def similar_sets(fp, sets, budget: int, least: tuple[int, int]):
    """Labels of different texts, sorted by fp[0], that link: fingerprints within the budget, and Jaccard of `least` or more."""
    import numpy as np

    bits, size = bit_sets(sets), np.array([len(x) for x in sets])
    step = max(1, AT_ONCE // bits.shape[1])

    def decide(p, q):
        hit = bits_apart(fp, p, q) <= budget
        at = np.flatnonzero(hit)
        for k in range(0, len(at), step):
            i = at[k : k + step]
            common = np.bitwise_count(bits[p[i]] & bits[q[i]]).sum(1, dtype=np.int64)
            hit[i] = common * sum(least) >= (size[p[i]] + size[q[i]]) * least[0]
        return hit

    return trie_links(np.zeros(len(sets), np.int64), fp[0], BITS, min(budget, BITS), decide)


def near_links(spark: SparkSession, nodes: DataFrame, texts: DataFrame, words: int = WORDS, least: tuple[int, int] = LEAST) -> DataFrame:
    """Links (a, b) that connect all near copies that meet in a trie. nodes: (node, row, f0, f1), a kept table of different
    texts. texts: (row, text); a row that is there several times counts once.

    The walk of the tries gives links of fingerprints within the budget, a star per component and top node. What they
    connect is one bucket, to which each of its texts brings its set of shingles once; there the trie of all of them is
    walked again, and a pair within the budget links if the whole sets are similar enough. Pairs of texts that are linked
    already are left out, and only a star per component leaves a task. A bucket over SETS texts is dealt out as pairs of
    blocks. The links are a written table.
    """
    ship(spark)
    folders = []

    def kept(df: DataFrame, tag: str) -> DataFrame:
        out, path = keep(spark, df, tag)
        folders.append(path)
        return out

    top, tries, budget = plan(nodes.count(), least)

    def first(batches):
        import numpy as np
        import pyarrow as pa

        hold("nearsets")
        for t in whole_keys(batches):
            cols = {c: t.column(c).to_numpy() for c in t.column_names}
            order = np.lexsort((cols["f0"].view(np.uint64), cols["bucket"], cols["key"]))  # keys of two buckets may be equal
            key, bucket, node, *fp = (cols[c][order] for c in ("key", "bucket", "node", *FP))
            fp = [x.view(np.uint64) for x in fp]
            group = np.cumsum(np.r_[True, (key[1:] != key[:-1]) | (bucket[1:] != bucket[:-1])])
            lab = trie_links(group, fp[0], BITS, min(budget, BITS), lambda p, q: bits_apart(fp, p, q) <= budget)
            smallest = np.full(len(lab), np.iinfo(np.int64).max)
            np.minimum.at(smallest, lab, node)
            at = np.flatnonzero(smallest[lab] != node)
            yield pa.RecordBatch.from_arrays([pa.array(bucket[at] >> 48), pa.array(node[at]), pa.array(smallest[lab][at])], ["trie", "a", "b"])

    met = dealt(spark, _under_tops(nodes, top, tries), ["bucket"], "node", BLOCK).select("key", "bucket", "node", *FP)
    stars = kept(met.mapInArrow(first, "trie long, a long, b long"), "stars")
    # one trie connects most of what is near; of the others only the links between its components are left
    one = kept(components(spark, stars.where("trie = 0"), "a", "b"), "one")
    of = lambda c: one.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    rest = stars.where("trie > 0").join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    all_ = kept(components(spark, rest.where("a <> b").distinct(), "a", "b"), "all")
    inside = stars.select(F.col("a").alias("node")).unionAll(stars.select("b")).distinct().join(one, "node", "left").select("node", F.coalesce("component", "node").alias("one"))
    inside = inside.join(all_.select(F.col("node").alias("one"), "component"), "one", "left").select("node", F.coalesce("component", "one").alias("bucket"))
    members = kept(nodes.join(inside, "node").select("bucket", "node", "row", *FP), "members")
    sets = kept(_sets(texts.join(members, "row"), words), "sets")

    def second(batches):
        import numpy as np
        import pyarrow as pa

        hold("nearsets")
        for t in whole_keys(batches, 2 * SETS):
            t = t.combine_chunks()
            cols = {c: t.column(c).to_numpy() for c in ("key", "bucket", "node", *FP)}
            hashes, out = t.column("hashes").chunk(0), [np.zeros((2, 0), np.int64)]
            order = np.lexsort((cols["node"], cols["bucket"], cols["key"]))
            key, bucket, node = (cols[c][order] for c in ("key", "bucket", "node"))
            same = (key[1:] == key[:-1]) & (bucket[1:] == bucket[:-1])
            begin, end = np.flatnonzero(np.r_[True, ~same]), np.flatnonzero(np.r_[~same, True]) + 1
            once = np.r_[True, ~same | (node[1:] != node[:-1])]
            for b, e in zip(begin.tolist(), end.tolist()):
                at = order[b:e][once[b:e]]
                if len(at) > 1:
                    fp = [cols[c].view(np.uint64)[at] for c in FP]
                    by = np.argsort(fp[0], kind="stable")
                    at, fp = at[by], [x[by] for x in fp]
                    lab = similar_sets(fp, [hashes[i].values.to_numpy() for i in at.tolist()], budget, least)
                    linked = np.flatnonzero(lab != np.arange(len(lab)))
                    out.append(np.stack([cols["node"][at[linked]], cols["node"][at[lab[linked]]]]))
            a, b = np.concatenate(out, 1)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    out, _ = keep(spark, dealt(spark, sets, ["bucket"], "node", SETS).select("key", "bucket", "node", *FP, "hashes").mapInArrow(second, "a long, b long"), "nearlinks")
    for path in folders:
        drop_folder(spark, path)
    return out


def one_of_each(docs: DataFrame, words: int = WORDS, least: tuple[int, int] = LEAST) -> DataFrame:
    """Of each group of near copies, the row with the smallest doc_id; a group is what links connect.

    A row's text is what is judged, so a doc_id may repeat. Equal texts are one node. Rows without a doc_id come last; of
    rows with one doc_id the least by the other columns stays, then by the MD5 of text and row; of equal rows one stays.
    Texts without words are copies of each other. An empty table gives no rows. Texts are shuffled once, with the rows
    that stay; what is judged before holds fingerprints, and sets of shingles where a comparison needs them.
    """
    spark = docs.sparkSession
    ship(spark)
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    tid = F.unhex(F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8")))
    whole = F.unhex(F.md5(F.to_json(F.struct("doc_id", *rest, F.hex(tid).alias("text"), F.col("text").isNull().alias("null__")))))
    row = F.struct(F.col("doc_id").isNull().alias("without__"), "doc_id", *rest, tid.alias("tid__"), whole.alias("whole__"))
    rows, _ = keep(spark, _fingerprints(docs.select(tid.alias("tid"), row.alias("row"), "text"), words), "rows")
    nodes = rows.groupBy("tid").agg(F.min("row").alias("row"), *(F.min(c).alias(c) for c in FP)).select(F.monotonically_increasing_id().alias("node"), "*")
    nodes, _ = keep(spark, nodes, "nodes")
    texts = docs.select(whole.alias("row"), "text")
    comp = components(spark, near_links(spark, nodes.select("node", F.col("row.whole__").alias("row"), *FP), texts, words, least), "a", "b")
    stay = nodes.join(comp, "node", "left").groupBy(F.coalesce("component", "node").alias("group")).agg(F.min("row").alias("row"))
    stay, _ = keep(spark, stay.select("row.whole__"), "stay")
    return docs.withColumn("whole__", whole).join(stay, "whole__").dropDuplicates(["whole__"]).select(docs.columns)
