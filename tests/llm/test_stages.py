"""The pipeline's stages against brute force by their own rules, which are not those of the operators alone."""

from __future__ import annotations

import random
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest

from deltaloom.llm import pieces, sufdedup

from tests.llm.test_operators import DATA, docs_of, library_ids, smallest, texts


def plain_shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def near(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def plain_near_copies(rows):
    sets = [plain_shingles(t) for _, t in rows]
    return smallest([i for i, _ in rows], [(x[0], y[0]) for k, x in enumerate(rows) for n, y in enumerate(rows[:k]) if near(sets[k], sets[n])])


def test_near_copies_of_the_table(spark):
    rows = texts(spark)
    got = corpus_pipeline.drop_near_copies(spark, spark.read.parquet(f"{DATA}/documents.parquet"), DATA)
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(plain_near_copies(rows).values()))


def test_near_copies_about_the_threshold(spark):
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    rows = []
    for _ in range(40):
        w = [word() for _ in range(r.choice([3, 6, 30, 120, 400]))]
        for _ in range(6):
            v = list(w)
            for _ in range(r.randrange(1 + len(v) // 30)):
                v[r.randrange(len(v))] = word()
            rows.append((len(rows), " ".join(v)))
    rows += [(len(rows) + k, t) for k, t in enumerate(["", " \n", None, "two words", "Two  WORDS"])]
    want = plain_near_copies(rows)
    got = corpus_pipeline.drop_near_copies(spark, docs_of(spark, rows), DATA)
    assert sorted(x["doc_id"] for x in got.collect()) == sorted(set(want.values()))
    assert 45 < len(set(want.values())) < 200


def plain_passages(rows, least=51):
    """Texts without the bytes from the first to the last word of each run of `least` words that starts anywhere else too."""
    found, seen = [], Counter()
    for _, t in rows:
        data = (t or "").encode()
        found.append((data, [m.span() for m in re.finditer(rb"\S+", data)]))
    runs = [[tuple(data[a:b] for a, b in at[k : k + least]) for k in range(len(at) - least + 1)] for data, at in found]
    for r in runs:
        seen.update(r)
    out = []
    for (i, _), (data, at), r in zip(rows, found, runs):
        gone = np.zeros(len(data), bool)
        for k, run in enumerate(r):
            if seen[run] > 1:
                gone[at[k][0] : at[k + least - 1][1]] = True
        out.append((i, bytes(b for b, g in zip(data, gone) if not g).decode()))
    return Counter(out)


def cut(spark, docs):
    return Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.cut_repeats(spark, docs, DATA).collect())


def test_passages_of_the_table(spark):
    assert cut(spark, spark.read.parquet(f"{DATA}/documents.parquet")) == plain_passages(texts(spark))


@pytest.mark.parametrize("group", [512, 1])
def test_planted_passages(spark, monkeypatch, group):
    monkeypatch.setattr(sufdedup, "GROUP", group)
    r = random.Random(13)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.choice([1, 1, 2, 3, 5])))
    fill = lambda: [word() + str(r.random()) for _ in range(r.randrange(80))]
    planted = [[word() for _ in range(n)] for n in (48, 50, 51, 51, 52, 55, 60, 65, 120)]
    rows = []
    for k in range(120):
        parts = [x for _ in range(r.randrange(4)) for x in (fill(), r.choice(planted)[r.choice([0, 0, 0, 3]) :])] + [fill()]
        w = [x for p in parts for x in p]
        rows.append((k, "".join(x + r.choice([" ", " ", "\n", "  "]) for x in w)))
    rows += [(200, None), (201, ""), (202, "x " * 300), (203, " ".join("y" * 50)), (204, " ".join("y" * 50)), (205, " ".join("z" * 51)), (206, " ".join("z" * 51))]
    want = plain_passages(rows)
    assert cut(spark, docs_of(spark, rows)) == want
    assert any(len(p.encode()) < 400 for p in map(" ".join, planted[2:8]))


def test_passages_in_scripts_without_blanks(spark):
    r = random.Random(14)
    passage = "".join(chr(r.randrange(0x4E00, 0x9F00)) for _ in range(60))
    rows = [(1, f"uno {passage} dos"), (2, f"tres {passage}"), (3, "cuatro " + passage[:50])]
    assert cut(spark, docs_of(spark, rows)) == Counter([(1, "uno  dos"), (2, "tres "), (3, "cuatro " + passage[:50])])


def test_special_strings_in_another_case():
    r = random.Random(15)
    marks = ["a", "B", " ", "\n", ".", "<|", "|>", "<|endoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|STARTOFTEXT|>", "<|startoftext|>", "é"]
    rows = ["a <|ENDOFTEXT|> b", *("".join(r.choice(marks) for _ in range(r.randrange(20))) for _ in range(2000))]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        enc, kind = pieces.ids(name), pieces.id_kind(name)
        for text, got in zip(rows, enc.values(rows)):
            assert np.frombuffer(got, kind).tolist() == library_ids(name, text), (name, text)


def test_near_copies_judge_every_row(spark):
    fill = lambda seed: " ".join(random.Random(seed).choices("abcdefghij", k=60))
    one, two, three = fill(1), fill(2), fill(3)
    rows = [(5, one), (5, two), (None, one + " more"), (None, three), (None, three), (None, three + " end"), (7, two + " x"), (9, fill(4)), (9, fill(4))]
    docs = docs_of(spark, rows)
    for n in (1, 3):
        got = sorted((r["doc_id"] or 0, r["text"]) for r in corpus_pipeline.drop_near_copies(spark, docs.repartition(n), DATA).collect())
        # of three's rows no one has a doc_id: the least by the other columns stays
        assert got == sorted([(0, three), (5, one), (5, two), (9, fill(4))])
