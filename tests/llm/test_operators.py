"""The corpus operators against brute force, and on the odd rows: nulls, empty and long texts, ties, repeats, clashing names."""

from __future__ import annotations

import functools
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from deltaloom.llm import decontam, packing, pieces, sharding, simhash, sufdedup, tokenbin, tokens, toxicity, urlrules, vecdedup

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


def odd_rows():
    r = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "Ärger", "naïve", "don't", "x1y2", "<|endoftext|>", "日本語"]
    long = " ".join(r.choice(words) + r.choice(["", ".", ",\n", "\n\n", "  ", " \t"]) for _ in range(4000))
    return [(3, None), (1, ""), (2, " \n "), (None, "no id"), (5, long), (5, "same id"), (7, "a  b\n c"), (8, "a  b\n c"), (9, "é" * 900), (10, "<|endoftext|>tail <|startoftext|>"), (11, "nul\0 in\0side"), (12, "x" * 5000), (13, "end. ")]


def table(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet")


def texts(spark):
    return [(r[0], r[1]) for r in table(spark, "documents").select("doc_id", "text").collect()]


load = functools.cache(pieces.load)


def library_ids(name, text):
    return load(name).encode(text or "", add_special_tokens=False).ids


def smallest(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


# 1


@pytest.mark.parametrize("odd", [False, True])
def test_token_counts(spark, odd):
    rows = odd_rows() if odd else texts(spark)
    docs = docs_of(spark, rows) if odd else table(spark, "documents")
    got = Counter(tuple(r) for r in tokens.count_tokens(docs).collect())
    tok = pieces.load("byte_bpe_50k.json")
    n = [len(e.ids) for e in tok.encode_batch([t or "" for _, t in rows], add_special_tokens=False)]
    assert got == Counter((i, len((t or "").encode()), k, k > 1024) for (i, t), k in zip(rows, n))


def test_pieces_equal_the_library(spark):
    r = random.Random(1)
    marks = ["a", "B", " ", " ", "\n", "\u2003", "\x1c", "。", "日本", "<|ENDOFTEXT|>", "'s", "'", ".", "!", "9", "é", "\u00a0", "\t", "<|endoftext|>", "\u0301", "ß", "\0", "日"]
    rows = ["".join(r.choice(marks) for _ in range(r.randrange(40))) for _ in range(3000)]
    rows += ["".join(r.choice(marks) for _ in range(600)).replace(" ", "") for _ in range(20)] + ["日本語。" * 300, "ab.Cd," * 300, "x  y   \n\n z " * 200]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        enc, kind = pieces.ids(name), pieces.id_kind(name)
        for text, got in zip(rows, enc.values(rows)):
            assert np.frombuffer(got, kind).tolist() == library_ids(name, text), (name, text)
        assert max(map(len, enc.known)) <= pieces.CACHED


def test_long_texts_are_cut():
    for text in ("a   b " * 5000, "日本語、" * 5000, "nul\0 in " * 5000, "line  \n\n" * 5000):
        assert len(pieces.cut_byte_level(text)) >= 4000 and "".join(pieces.cut_byte_level(text)) == text


# 2


def test_scores_against_the_definition(spark):
    """Every document's probabilities, from the weights and the features by their definition; ties and repeats included."""
    docs = docs_of(spark, [*texts(spark), *odd_rows(), *odd_rows()])
    chain = toxicity.train(table(spark, "documents"), table(spark, "labels"))
    name = {k: f for f, k in chain.words.items()}

    def plain(text):
        words = set(re.findall(r"\w+", (text or "").lower()))
        found = {f for f in name.values() if (f in words if "^" not in f else sum(w.startswith(f[: f.index("^")]) and len(w) > f.index("^") for w in words) >= int(f[f.index("^") + 1 :]))}
        p = []
        for k in range(2):
            z = chain.bias[k] + sum(chain.weights[k][chain.words[f]] for f in found) + sum(c * x for c, x in zip(chain.carry[k], p))
            p.append(1 / (1 + np.exp(-min(30, max(-30, z)))))
        return [*p, bool(words) and p[1] >= 0.4]

    for r in toxicity.score(docs, chain).select("text", "p_quality", "p_toxic", "rejected").collect():
        want = plain(r[0])
        assert abs(r[1] - want[0]) < 1e-9 and abs(r[2] - want[1]) < 1e-9 and r[3] == want[2]


def test_toxicity_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    seen, held = labels.where("doc_id % 5 > 0"), labels.where("doc_id % 5 = 0")
    chain = toxicity.train(docs, seen)
    got = [(r["rejected"], r["toxic"]) for r in toxicity.score(docs.select("doc_id", "text"), chain).join(held, "doc_id").collect()]
    hit = sum(1 for a, b in got if a and b)
    assert hit / sum(b for _, b in got) > 0.9
    assert hit / max(1, sum(a for a, _ in got)) > 0.9


def test_toxicity_odd_rows(spark):
    docs = docs_of(spark, odd_rows()).selectExpr("*", "1 as p_toxic", "'x' as rejected")
    none = toxicity.train(docs.where("false"), table(spark, "labels"))
    assert toxicity.score(docs.where("false"), none).count() == 0
    chain = toxicity.train(table(spark, "documents"), table(spark, "labels"))
    out = toxicity.score(docs, chain)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "p_quality", "p_toxic", "rejected"]
    got = {(r["doc_id"], r["text"]): r["rejected"] for r in out.collect()}
    assert len(out.collect()) == len(odd_rows()) and not got[3, None] and not got[1, ""]


def test_toxicity_later_model_sees_earlier_probability():
    r = random.Random(3)
    rows = []
    for i in range(400):
        bad = r.random() < 0.5
        rows.append((i, " ".join(sorted({r.choice("abcdef"), "awful" if bad else "fine"})), (int(bad), int(bad))))
    chain = toxicity.fit(rows, ("rude", "toxic"))
    assert chain.carry[0] == [] and chain.carry[1][0] > 0
    p = chain.probabilities(np.array(chain.find(["awful"]), np.int64))
    assert p[0] > 0.8 and p[1] > 0.8


# 3


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("odd", [False, True])
def test_simhash_groups(spark, odd):
    rows = odd_rows() if odd else texts(spark)
    docs = docs_of(spark, rows) if odd else table(spark, "documents")
    fp = [plain_fingerprint(t) for _, t in rows]
    known = [(i, f) for (i, _), f in zip(rows, fp) if i is not None]
    links = [(a, b) for k, (a, x) in enumerate(known) for b, y in known[:k] if bin(x ^ y).count("1") <= 3]
    want = smallest({i for i, _ in known}, links)
    got = Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_groups(docs).collect())
    assert got == Counter((i, f, want.get(i)) for (i, _), f in zip(rows, fp))


@pytest.mark.parametrize("block", [20_000, 16])
def test_simhash_dense_and_hot_buckets(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    r = random.Random(9)
    values = {r.getrandbits(64) for _ in range(60)}
    for _ in range(6):
        seed = r.getrandbits(64)
        for _ in range(60):
            x = seed
            for _ in range(r.randrange(7)):
                x ^= 1 << r.randrange(64)
            values.add(x)
    values = sorted(values)
    classes = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v, i) for i, v in enumerate(values)], "fp long, rep long")
    links = [(a, b) for a in range(len(values)) for b in range(a) if bin(values[a] ^ values[b]).count("1") <= 3]
    got = [tuple(x) for x in simhash.near_links(spark, classes).collect()]
    assert set(map(frozenset, got)) <= {frozenset(p) for p in links} | {frozenset((a, b)) for a, c in smallest(range(len(values)), links).items() for b, d in smallest(range(len(values)), links).items() if c == d and a != b}
    assert smallest(range(len(values)), got) == smallest(range(len(values)), links)


def test_trie_links_small_frontier(monkeypatch):
    monkeypatch.setattr(simhash, "FRONTIER", 8)
    r = random.Random(4)
    v = np.array(sorted({r.getrandbits(12) for _ in range(300)}), np.uint64)
    lab = simhash.trie_links(np.zeros(len(v), np.int64), v, 12, 1)
    want = smallest(range(len(v)), [(a, b) for a in range(len(v)) for b in range(a) if bin(int(v[a]) ^ int(v[b])).count("1") <= 1])
    assert lab.tolist() == [want[i] for i in range(len(v))]


def test_components_of_a_long_chain(spark):
    from deltaloom.llm.components import components

    links = [(i, i + 1) for i in range(10, 60)] + [(100, 7), (7, 7), (None, 3), (3, None)]
    got = dict(map(tuple, components(spark, spark.createDataFrame(links, "x long, y long"), "x", "y").collect()))
    assert got == {**{i: 10 for i in range(10, 61)}, 100: 7, 7: 7}
    assert components(spark, spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0


@pytest.mark.parametrize("rows", [1 << 10, 1 << 24, 1 << 40])
def test_simhash_tops_lose_no_pair(spark, rows):
    r = random.Random(31)
    tries = simhash.tops(rows, 3)
    values = [r.getrandbits(64) for _ in range(40)]
    for v in list(values):
        for n in (1, 2, 3, 3, 4):
            values.append(v ^ sum(1 << b for b in r.sample(range(64), n)))
    values = sorted(set(values))
    classes = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v, i) for i, v in enumerate(values)], "fp long, rep long")
    links = [(a, b) for a in range(len(values)) for b in range(a) if bin(values[a] ^ values[b]).count("1") <= 3]
    got = [tuple(x) for x in simhash.near_links(spark, classes, blocks=tries).collect()]
    assert smallest(range(len(values)), got) == smallest(range(len(values)), links)


# 4


def test_url_rules(spark):
    urls = [
        "http://example.com/en/1", "https://WWW.Example.com/en/x?y#z", "http://a.www.example.com/en/", "http://example.com/de/", "http://example.com", "http://x.net/es/1", "http://x.net/en/",
        "http://casino-win.net/en/", "http://m.ads.org", "http://x.org/wp-login.php", "http://x.org/a/login/b", "http://x.org/loginx", "http://x.org/logins/login", "http://x.org/setup.exe", "http://x.org/setup.exe.txt", "http://casino.org/checkout/a.exe", "http://x.org/cgi-bin/", "http://login.org/", "http://x.org/xlogin", "http://x.org/a.cart", "http://casino.net/es/", "http://broadcasino.org/", "http://x.org/casino", "http://x.net/fr", "http://x.net/fr/", "nothing", None, "", "http://", "a://b://c.com/", "http://notexample.com/en/", "http://x.com?q=/", "http://net/es/\nx", "HTTP://M.NET/es/é",
    ]
    rows = [(k, u, "h") for k, u in enumerate(urls)] + [(None, "http://example.com/en/1", None)]

    def plain(u):
        if not u or "://" not in u:
            return "", "", None, "allow", None
        rest = u.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
        best = None
        for rule, verdict in (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")):
            h, _, p = rule.partition("/")
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
                best = rule, verdict
        words = [w for w in urlrules.HOST_PARTS if w in host.replace("-", ".").split(".")]
        steps = path.split("/")[1:]
        words += [f"/{w}" for w in urlrules.PATH_STEPS if any(x == w or x.startswith(w + ".") for x in steps)]
        words += [f".{w}" for w in urlrules.PATH_ENDS if path.endswith("." + w)]
        longest = min(words, key=lambda w: (-len(w), w), default=None)
        return host, path, *(best or (None, "block" if words else "allow")), None if best else longest

    pages = spark.createDataFrame(rows, "page_id long, url string, rule string")
    assert Counter(map(tuple, urlrules.judge(pages).collect())) == Counter((i, *plain(u)) for i, u, _ in rows)
    assert urlrules.judge(pages.where("false")).count() == 0


def test_url_rules_in_passes(spark, monkeypatch):
    monkeypatch.setattr(urlrules, "RULES_AT_ONCE", 2)
    pages = table(spark, "pages")
    whole = urlrules.judge(pages).collect()
    assert len(whole) == pages.count()
    monkeypatch.setattr(urlrules, "RULES_AT_ONCE", 100)
    assert Counter(map(tuple, urlrules.judge(pages).collect())) == Counter(map(tuple, whole))


def test_rules_are_indexed_by_their_rarest_token():
    index = urlrules.index_rules(urlrules.RULES)
    assert {r.name: t for t, rs in index.items() for r in rs} == {"com/": "com", "example.com/en/": "example", "www.example.com/en/": "www", "net/es/": "es", "net/fr/": "fr"}


# 5


@pytest.mark.parametrize("odd", [False, True])
def test_token_records(spark, odd):
    rows = odd_rows() if odd else texts(spark)
    docs = docs_of(spark, rows) if odd else table(spark, "documents")
    want, at = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest())):
        ids = [*library_ids("byte_bpe_50k.json", t), 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = sorted(map(tuple, tokenbin.token_records(docs).collect()), key=lambda r: r[1])
    assert got == want


def test_records_tell_of_damage():
    data = tokenbin.frame(b"abc")
    assert tokenbin.unframe(data) == b"abc"
    for k in range(len(data)):
        with pytest.raises(ValueError):
            tokenbin.unframe(data[:k] + bytes([data[k] ^ 1]) + data[k + 1 :])


def test_records_empty(spark):
    assert tokenbin.token_records(table(spark, "documents").where("false")).count() == 0


# 6


def test_decontamination_against_the_definition(spark):
    """Every pair of a document and an item by greedy string tiling as it is defined; tiles of equal length may be marked in
    another order, so that coverage may differ by a seed's words less one."""
    rows = [(i, t) for i, t in texts(spark) if len((t or "").split()) < 600]
    items = [tuple(x) for x in table(spark, "benchmark").select("item_id", "text").collect()]
    seen = decontam.words_of(items[0][1])
    rows += [(900, " ".join(seen[: len(seen) // 2] * 40)), (901, " ".join(["x"] * 50_000 + seen)), (902, None), (903, " ".join(seen[::-1]))]
    grams = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    own = [(i, decontam.words_of(t)) for i, t in items]
    own = [(i, w, grams(w)) for i, w in own]
    low, high = {}, {}
    for i, t in rows:
        w = decontam.words_of(t)
        g = grams(w)
        near = [(k, x) for k, x, s in own if s & g]
        short = w[-2000:] if len(w) > 10_000 else w
        got = [(k, plain_tiling(x, short, 5), len(x)) for k, x in near]
        low[i] = {k for k, c, n in got if c - 4 >= 0.8 * n or c == n}
        high[i] = {k for k, c, n in got if c + 4 >= 0.8 * n}
    out = decontam.contaminated(docs_of(spark, rows), table(spark, "benchmark")).collect()
    assert len(out) == len(rows) and 901 in {x["doc_id"] for x in out if x["contaminated"]}
    for x in out:
        assert low[x["doc_id"]] <= set(x["item_ids"]) <= high[x["doc_id"]], x["doc_id"]
        assert x["contaminated"] == bool(x["item_ids"])


def test_tiles_reordered_passage():
    item = list(range(30))
    doc = [99, *item[15:], 98, *item[:15], 97]
    got = tiles_covered(decontam.tiles(item, doc, 5))
    assert got == 30
    assert decontam.tiles(item, [1, 2, 3, 4], 5) == []
    assert tiles_covered(decontam.tiles(item, item[:4] + [99] + item[4:9], 5)) == 5


def tiles_covered(t):
    places = [p + k for p, _, n in t for k in range(n)]
    assert len(places) == len(set(places))
    return len(places)


def plain_tiling(a, b, least):
    """Greedy string tiling by its definition."""
    fa, fb, covered = [True] * len(a), [True] * len(b), 0
    while True:
        best, found = least - 1, []
        for p in range(len(a)):
            for d in range(len(b)):
                k = 0
                while p + k < len(a) and d + k < len(b) and fa[p + k] and fb[d + k] and a[p + k] == b[d + k]:
                    k += 1
                if k > best:
                    best, found = k, [(d, p)]
                elif k == best and k >= least:
                    found.append((d, p))
        if best < least:
            return covered
        for d, p in sorted(found):
            if all(fa[p : p + best]) and all(fb[d : d + best]):
                fa[p : p + best] = fb[d : d + best] = [False] * best
                covered += best


def test_tiles_against_the_definition():
    r = random.Random(2)
    for _ in range(150):
        a, b = ([r.randrange(3) for _ in range(r.randrange(4, 40))] for _ in range(2))
        got, want = tiles_covered(decontam.tiles(a, b, 4)), plain_tiling(a, b, 4)
        assert abs(got - want) <= 4, (a, b)  # equal lengths may be marked in another order


def test_decontamination(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    items = [(k, " ".join(word() for _ in range(30))) for k in range(6)] + [(90, None), (91, ""), (92, "two words"), (None, "item without an id at all here")]
    fill = lambda n: " ".join(word() for _ in range(n))
    w = items[2][1].split()
    rows = [
        (1, f"{fill(50)} {items[0][1]} {fill(20)}"), (2, fill(300)), (3, f"{fill(9)}, {' '.join(w[15:])}. {fill(30)} {' '.join(w[:15]).upper()}!"),
        (4, f"{' '.join(w[:20])} {fill(20)}"), (5, None), (6, ""), (7, items[1][1] + " " + items[3][1]), (None, items[4][1]), (8, "xx two words yy"), (8, "xx two words yy"), (9, "an item without an id at all here"),
    ]
    out = decontam.contaminated(docs_of(spark, rows).selectExpr("*", "1 as coverage"), spark.createDataFrame(items, "item_id long, text string"))
    got = Counter((x["doc_id"], tuple(x["item_ids"]), x["contaminated"]) for x in out.collect())
    assert got == Counter([(1, (0,), True), (2, (), False), (3, (2,), True), (4, (), False), (5, (), False), (6, (), False), (7, (1, 3), True), (None, (4,), True), (8, (92,), True), (8, (92,), True), (9, (), True)])
    assert decontam.contaminated(docs_of(spark, rows), spark.createDataFrame([], "item_id long, text string")).where("contaminated").count() == 0


# 7


def plain_repeats(rows, length):
    seen = defaultdict(int)
    data = [(t or "").encode() for _, t in rows]
    for d in data:
        for k in range(len(d) - length + 1):
            seen[d[k : k + length]] += 1
    out = []
    for (i, _), d in zip(rows, data):
        gone = np.zeros(len(d), bool)
        for k in range(len(d) - length + 1):
            if seen[d[k : k + length]] > 1:
                gone[k : k + length] = True
        spans = int((np.diff(np.r_[False, gone].astype(int)) == 1).sum())
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((i, len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def repeats(docs, **args):
    return Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in sufdedup.remove_repeats(docs, **args).collect())


def test_suffix_dedup_tables(spark):
    assert repeats(table(spark, "documents")) == plain_repeats(texts(spark), 400)


def test_suffix_dedup_odd_rows(spark):
    docs = docs_of(spark, odd_rows()).selectExpr("*", "1 as kept", "2 as n_spans")
    assert repeats(docs) == plain_repeats(odd_rows(), 400)
    assert repeats(docs.where("false")) == Counter()


@pytest.mark.parametrize("group", [512, 1])
def test_suffix_dedup_edges(spark, group):
    r = random.Random(11)
    word = lambda n: "".join(r.choice("abcdé ") for _ in range(n))
    shared = [word(n) for n in (30, 39, 40, 41, 55, 80, 200)]
    rows = [(k, "".join(r.choice([word(r.randrange(60)), r.choice(shared), r.choice(shared)[: r.randrange(60)], r.choice(shared)[r.randrange(30) :]]) for _ in range(r.randrange(9)))) for k in range(150)]
    rows += [(1000, "ab" * 200), (1001, "z" * 39), (1002, "z" * 39), (1003, shared[-1]), (1004, shared[-1])]
    assert repeats(docs_of(spark, rows), length=40, gram=8, group=group) == plain_repeats(rows, 40)


def test_suffix_sort_with_colliding_hashes(monkeypatch):
    monkeypatch.setattr(sufdedup, "powers", lambda n, *a: np.ones(n, np.uint64))  # a hash that only adds up
    data = np.frombuffer(b"abcdef" + b"bacdef" + b"abcdef", np.uint8)
    order, same = sufdedup.sort_suffixes(data, np.zeros(3, np.int64), np.array([0, 6, 12]), 6)
    assert order.tolist() == [0, 2, 1] and same.tolist() == [False, True, False]


def test_suffix_sort_order():
    r = random.Random(6)
    data = np.frombuffer("".join(r.choice("ab") for _ in range(600)).encode(), np.uint8)
    start = np.arange(580)
    segment = np.sort(np.array([r.randrange(5) for _ in start]))
    order, same = sufdedup.sort_suffixes(data, segment, start, 20)
    key = [(int(segment[i]), bytes(data[start[i] : start[i] + 20])) for i in order]
    assert key == sorted(key)
    assert same.tolist() == [k > 0 and key[k] == key[k - 1] for k in range(len(key))]


@pytest.mark.parametrize("group", [512, 3])
def test_suffix_dedup_hot_passage(spark, group):
    """A passage that many texts share, each with other text around it, and texts of one repeated character."""
    r = random.Random(21)
    word = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage = word(150)
    rows = [(k, word(r.randrange(40, 90)) + passage[r.choice([0, 0, 7]) : r.choice([150, 150, 141])] + word(r.randrange(90))) for k in range(60)]
    rows += [(900, "x" * 3000), (901, "x" * 39), (902, "y" * 70), (903, passage * 5), (904, passage[:60]), (905, None)]
    assert repeats(docs_of(spark, rows), length=40, gram=8, group=group) == plain_repeats(rows, 40)


def test_windows_within_one_text():
    data = np.frombuffer(b"x" * 5000, np.uint8)
    first, *_, many, spans = sufdedup.windows_of(data, 400, 64)
    assert len(first) <= 2 and many.any() and spans == [[0, 5000]]


def test_windows_of_many_texts_are_those_of_each():
    r = random.Random(23)
    texts_ = [np.frombuffer("".join(r.choice("ab") for _ in range(r.choice([0, 5, 39, 40, 41, 200, 900]))).encode(), np.uint8) for _ in range(60)] + [np.frombuffer(b"x" * 300, np.uint8)]
    got = sufdedup.windows_of_many(texts_, 40, 8)
    rows, spans = [], []
    for k, t in enumerate(texts_):
        first, starts, shift, grams, digests, many, own = sufdedup.windows_of(t, 40, 8)
        rows += [(k, *map(int, x)) for x in zip(first, starts, shift, grams, digests[:, 0], digests[:, 1], many)]
        spans += [(k, *x) for x in own]
    text, first, starts, shift, grams, digests, many, found = got
    assert [tuple(map(int, x)) for x in zip(text, first, starts, shift, grams, digests[:, 0], digests[:, 1], many)] == rows
    assert sorted(found) == sorted(spans) and spans


def test_suffix_dedup_counts_passages(spark):
    r = random.Random(22)
    words = lambda n: " ".join(str(r.random()) for _ in range(n))
    one, two = words(51), words(50)
    rows = [(1, f"{words(9)} {one}\n{words(9)}"), (2, f"{one} {words(5)} {two}"), (3, f"{two}"), (4, None), (5, "")]
    out = sufdedup.remove_repeats(docs_of(spark, rows).selectExpr("*", "1 as rest"), passages=51)
    got = {x["doc_id"]: (x["n_passages"], x["rest"]) for x in out.collect()}
    assert got == {i: (1, t.replace(one, "")) if i < 3 else (0, t or "") for i, t in rows}


def test_anchors_across_segments(monkeypatch):
    r = random.Random(8)
    data = bytes(r.randrange(97, 101) for _ in range(3000))
    monkeypatch.setattr(sufdedup, "SEGMENT", 500)
    first, starts, *_ = sufdedup.anchors(np.frombuffer(data, np.uint8), 100, 10)
    assert np.concatenate([np.arange(a, a + n) for a, n in zip(first, starts)]).tolist() == list(range(len(data) - 99))


# 8


def plain_jump(key, n):
    key %= 1 << 64
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("odd", [False, True])
def test_sharding(spark, odd):
    rows = odd_rows() if odd else [*texts(spark), (-1, "a"), (-(1 << 63), "b"), ((1 << 63) - 1, None)]
    got = sharding.shard_documents(docs_of(spark, rows).selectExpr("*", "1 as shard")).collect()
    assert Counter(tuple(r)[:5] + (r["grown_shard"],) for r in got) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), "key", plain_jump(i or 0, 24), plain_jump(i or 0, 25)) for i, t in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(docs_of(spark, [])).count() == 0


# 9


def test_near_vectors(spark):
    r = np.random.default_rng(3)
    base = r.standard_normal((40, 64))
    rows = []
    for k in range(400):
        x = base[r.integers(40)] + r.standard_normal(64) * r.choice([0.0, 0.05, 0.1, 0.15])
        rows.append((k, [float(v) for v in np.float32(x)], int(r.integers(3))))
    rows += [(500, None, 1), (501, [0.0] * 64, 1), (502, rows[0][1], None), (503, [float("nan")] * 64, 1), (504, [None] * 64, 1), (505, [], 1), (506, rows[0][1], rows[0][2]), (506, rows[0][1], rows[0][2]), (None, rows[1][1], rows[1][2]), (507, rows[2][1][:32], rows[2][2]), (508, [float("inf")] * 64, 1)]
    docs = spark.createDataFrame([(*x, "c") for x in rows], "vec_id long, embedding array<float>, label int, kept string")

    def unit(x):
        if x is None or not len(x) or any(v is None or not np.isfinite(v) for v in x) or not any(x):
            return None
        return np.array(x) / np.linalg.norm(x)

    u = [unit(x[1]) for x in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if u[a] is not None and u[b] is not None and len(u[a]) == len(u[b]) and rows[a][2] is not None and rows[a][2] == rows[b][2] and u[a] @ u[b] >= 0.98]
    near = Counter(x for p in links for x in p)
    group = smallest(range(len(rows)), links)
    name = {}
    for k, x in enumerate(rows):
        if x[0] is not None:
            name[group[k]] = min(x[0], name.get(group[k], x[0]))
    want = Counter((x[0], near[k], name.get(group[k]) if x[0] is not None else None) for k, x in enumerate(rows))
    got = vecdedup.near_vectors(docs).collect()
    assert Counter(tuple(x)[:3] for x in got) == want
    assert all(x["kept"] == (x["vec_id"] is not None and x["vec_id"] == x["component_id"]) for x in got)
    assert vecdedup.near_vectors(docs.where("false")).count() == 0


def planted_vectors(n):
    """n vectors and for each one more at a cosine just over the threshold, or under it."""
    r = np.random.default_rng(17)
    x = r.standard_normal((n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = r.standard_normal((n, 64))
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    cosine = np.where(np.arange(n) % 2, 0.9801, 0.978)[:, None]
    return [(k, [float(v) for v in u], k % n % 3) for k, u in enumerate(np.concatenate([x, cosine * x + np.sqrt(1 - cosine**2) * z]))]


def exact_links(rows):
    x = np.stack([np.array(r[1]) / np.linalg.norm(r[1]) for r in rows])
    label = np.array([r[2] for r in rows])
    near = (x @ x.T >= 0.98) & (label[:, None] == label)
    return {r[0]: int(n) - 1 for r, n in zip(rows, near.sum(1))}


@pytest.mark.parametrize("block", [4096, 8])
@pytest.mark.parametrize("exact", [False, True])
def test_near_vectors_recall(spark, monkeypatch, block, exact):
    monkeypatch.setattr(vecdedup, "BLOCK", block if not exact else 300)
    rows = planted_vectors(3000)
    want = exact_links(rows)
    assert sum(want.values()) == 3000
    got = {r["vec_id"]: r["n_links"] for r in vecdedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), exact=exact).collect()}
    assert all(got[k] <= want[k] for k in want)
    assert sum(got.values()) >= (1 if exact else 0.995) * sum(want.values())


def test_near_vectors_of_the_table(spark):
    rows = [tuple(r) for r in table(spark, "embeddings").select("vec_id", "embedding", "label").collect()]
    got = {r["vec_id"]: r["n_links"] for r in vecdedup.near_vectors(table(spark, "embeddings")).collect()}
    assert got == exact_links(rows)


def test_estimates_are_unbiased_and_bounded():
    r = np.random.default_rng(1)
    a = r.standard_normal((300, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    signs, factor, turned = vecdedup.encode(a, vecdedup.rotation(64))
    estimate = signs @ turned.T / (np.sqrt(turned.shape[1]) * factor)[:, None]
    off = estimate - a @ a.T
    assert abs(off.mean()) < 0.01
    bound = np.sqrt(1 - factor**2) / factor * vecdedup.CONFIDENCE / np.sqrt(turned.shape[1] - 1)
    assert (np.abs(off) <= bound[:, None]).mean() > 0.99


# 10


@pytest.mark.parametrize("odd", [False, True])
def test_packing(spark, odd):
    rows = odd_rows() if odd else texts(spark)
    docs = docs_of(spark, rows) if odd else table(spark, "documents")
    window = 64 if odd else 4096
    got = packing.pack(docs, window=window).collect()
    ids = {}
    for i, t in rows:
        ids.setdefault(i, []).append([*library_ids("word_bpe_49k.json", t), 2])
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
        doc = next(d for d in ids[r["doc_id"]] if len(d) == r["doc_tokens"])
        assert zlib.crc32(np.array(doc[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"]
    assert sum(r["length"] for r in got) == sum(len(d) for ds in ids.values() for d in ds)
    for s, parts in places.items():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at == window or s == max(places)
    assert sorted(places) == list(range(len(places)))
    assert packing.pack(docs.where("false")).count() == 0
