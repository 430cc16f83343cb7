"""Operator 12 against a dictionary of windows."""

import hashlib
import random

import numpy as np
import pytest

from kgrec.llm import queries, substring

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, starts string, key int, h string"


def brute(rows, window):
    """Kept words of each distinct (doc_id, text) by the contract; ids that texts share: in any order of the texts, given here."""
    places = {}
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    out = {}
    for doc, text, _ in order:
        words = (text or "").encode().split()
        gone = np.zeros(len(words), bool)
        for k in range(len(words) - window + 1):
            w = tuple(words[k:k + window])
            if w in places:
                gone[k:k + window] = True
            else:
                places[w] = True
        out[doc, text] = (len(words), int(gone.sum()), b" ".join(w for w, g in zip(words, gone) if not g).decode())
    return out


def key_of(spark, texts):
    from pyspark.sql import functions as F
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.hash(F.coalesce("t", F.lit(""))).alias("k")).collect()
    return {r.t: r.k for r in rows}


def made(seed):
    rng = random.Random(seed)
    words = [f"w{k}é" if k % 9 == 0 else f"w{k}" for k in range(40)]
    passage = " ".join(rng.choice(words) for _ in range(30))
    copy = " ".join(rng.choice(words) for _ in range(70))
    rows = []
    for k in range(60):
        body = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        if k % 3 == 0:
            body.insert(rng.randint(0, len(body)), passage)
        rows.append((k * 7 % 61, "  ".join(body) + rng.choice(["", "\n", " \t"])))
    rows += [(100 + k, copy) for k in range(20)] + [(3, copy), (3, copy), (3, "other text " + copy), (None, copy), (None, passage), (None, None)]
    own = " ".join(rng.choice(words) + "x" for _ in range(40))
    rows += [(-5, own)] * 30 + [(-4, own), (-6, " ".join(["t"] * 25))] + [(-6, " ".join(["t"] * 25))] * 3  # equal rows that stand first
    rows += [(200, None), (201, ""), (202, " \n\x0b"), (203, " ".join(words[:4] * 300)), (204, "x" * 5000 + " " + "y" * 70), (205, " ".join(["x" * 5000] * 9)),
             (206, "\x1c".join(words[:8]) + " " + " ".join(["\xa0", "\x85"] * 6)), (207, "z " * 3000)]
    return rows


@pytest.mark.parametrize(("window", "sketch"), [(5, 64 << 20), (5, 64), (20, 4096), (1, 1 << 16)])
def test_equals_a_dictionary_of_windows(spark, window, sketch):
    rows = made(window)
    docs = spark.createDataFrame([(d, t, "s", 1, "h") for d, t in rows], SCHEMA).repartition(7)
    key = key_of(spark, {t for _, t in rows})
    want = brute([(d, t, key[t]) for d, t in rows], window)
    got = substring.deduplicated(docs, window, sketch).collect()
    assert len(got) == len(rows)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=str) == sorted(((d, *want[d, t]) for d, t in rows), key=str)


def test_query_gives_the_contracts_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = brute([(r.doc_id, r.text, 0) for r in docs], 20)
    want = {d: (n, gone, hashlib.sha256(kept.encode()).hexdigest()) for (d, _), (n, gone, kept) in want.items()}
    got = queries.op12_count_min_substring(spark, SF).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == want
    assert sum(r.n_removed for r in got) > 0


def test_empty_table(spark):
    assert substring.deduplicated(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sketch_never_underestimates_and_merges():
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 1 << 63, 4000, dtype=np.uint64) for _ in range(3)]
    parts[1][:500] = parts[0][:500]
    parts[2][:100] = parts[2][100:200]
    sketches = []
    for p in parts:
        sketches.append(substring.Sketch(17))
        for half in np.array_split(p, 2):
            sketches[-1].add(half)
    for s in sketches[1:]:
        sketches[0].merge(s.seen)
    values, counts = np.unique(np.concatenate(parts), return_counts=True)
    estimate = sketches[0].repeats(values)
    assert estimate[counts > 1].all()
    assert estimate[counts == 1].mean() < 0.05


def test_hashes_tell_words_apart():
    words = [b"a", b"b", b"ab", b"a\x00", b"\x00", b"\x00\x00", b"abcdefgh", b"abcdefgh\x00", b"abcdefghi", b"x" * 64, b"x" * 65, b"x" * 66]
    starts, h = substring.hashed_words(b"  ".join(words) + b"\n")
    assert len(starts) == len(words) and len({tuple(c) for c in h.T.tolist()}) == len(words)
    again = substring.hashed_words(b"\t".join(reversed(words)))[1]
    assert (again[:, ::-1] == h).all()
    assert substring.hashed_words(b"")[0].size == 0
