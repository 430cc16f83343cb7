"""Each dealt operator against a brute-force version, on small tables with nulls, empty, long, equal and extra columns."""

import collections
import html
import random
import re
import uuid
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from kgrec.llm import ann, html_text, language, lm_score, mixing, packing, quality, sharding, simhash, token_files, tokens
from kgrec.llm.common import load

SF = "/root/testdata/sf0.001"
WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id bigint, text string, lang string, source string, size int, key int, row string, rank string, `n chars` int"
WORDS = "stone river light under window garden silver morning paper quiet yellow branch copper winter market".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", ","]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base = [(k, prose(k, 20 + 7 * k), "en", f"s{k % 4}", k, k, "x", None, 1) for k in range(24)]
    copy = (50, base[3][1], "en", None, None, None, None, "r", None)
    near = (51, base[3][1] + " extra", "de", "s1", 1, 1, "x", "r", None)
    return [*base, copy, near, copy, copy,  # repeated rows
            (60, None, None, None, None, None, None, None, None), (61, "", "en", "s1", 0, 0, "", "", 0), (62, " \n\t ", None, "s1", 0, 0, "", "", 0),
            (None, prose(90, 60), "en", "s2", 1, 1, "x", "r", 1), (None, prose(91, 60), "en", "s2", 1, 1, "x", "r", 1),
            (63, prose(5, 9000), "en", "s0", 1, 1, "x", "r", 1), (64, "12 %% 34", "en", "s0", 1, 1, "x", "r", 1)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# --- tokens -------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("path", [WORD_BPE, BYTE_BPE])
def test_encoder_gives_the_librarys_ids(path):
    lib = Tokenizer.from_file(path)
    enc = tokens.Encoder(path)
    rng = random.Random(1)
    parts = ["the", "The", " ", "  ", "\n", "\r\n", "\t", "\xa0", "\x85", "\x1c", "don't", "we'll", "x²½", "été", "Œuvre", "naïve,", "£5.00", "İ", "ΑΣ", "ſ",
             "日本", "é", "​", "<|endoftext|>", "'s", "...", "1234", "a-b", "\x00", "\xad", "ª", "😀", "%%%", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof"]
    assert lib.encode("a <|endoftext|> b", add_special_tokens=False).ids[1:-1] == [lib.token_to_id("<|endoftext|>")] or path == BYTE_BPE
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|startoftext|>y", "", " ", "a ", " a", "a  b", "a \nb", "a\n b", "a\nb", *("".join(rng.choice(parts) + rng.choice(["", " ", " "]) for _ in range(12)) for _ in range(400))]
    texts += [r["text"] for r in []] + [prose(3, 300)]
    for t in texts:
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)
    assert enc.encode(None) == b""


@pytest.mark.parametrize("path", [WORD_BPE, BYTE_BPE])
def test_words_of_any_unit_are_encoded_once(path):
    """Letters beyond ASCII and words inside longer units are met in the tables, and their ids are the library's."""
    enc, whole, asked = tokens.Encoder(path), Tokenizer.from_file(path), []
    plain = enc.piece
    enc.piece = lambda piece: asked.append(piece) or plain(piece)
    ends = [".", ",", "!", "?", ";", ".\nseñor", ".\nseñor,\nñandú"]
    text = " ".join(f"{word}{end}" for end in ends for word in ("señor", "ñandú", "plain")) + " a\n\nb (señor) x-ñandú"
    assert np.frombuffer(enc.encode(text), np.uint32).tolist() == whole.encode(text, add_special_tokens=False).ids
    assert not any(piece.strip().isalpha() for piece in asked)  # words went through the tables
    assert len(asked) == len(set(asked))


def test_counts_of_ids_over_documents_of_any_size(spark):
    docs = [b"\x02" + np.array([3, 3, 500], "<u2").tobytes(), b"\x04" + np.array([3, 70_000], "<u4").tobytes()]
    rows = spark.createDataFrame([(d,) for d in docs * 3] + [(b"\x02",)], "kept binary")
    assert {r["id"]: r["n"] for r in token_files.id_counts(rows).collect()} == {3: 9, 500: 3, 70_000: 3}


# --- 2 packing ----------------------------------------------------------------------------------------------

def check_packing(got, texts, max_len):
    lib = Tokenizer.from_file(WORD_BPE)
    want = collections.Counter()
    for doc, text in texts:
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), max_len)):
            part = np.array(ids[at:at + max_len], "<u4")
            want[doc, k, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert want == collections.Counter((r.doc_id, r.piece, r.start, r.length, zlib.crc32(r.ids)) for r in got)
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= max_len
    return len(by), sum(r.length for r in got)


def test_packing_places_every_piece(docs, rows, none):
    packed = packing.pack(docs, WORD_BPE)
    n, total = check_packing(packed.collect(), [(r[0], r[1]) for r in rows], 4096)
    assert n <= -(-total // 4096) + 1
    joined = packing.sequences(packed).collect()
    assert sum(r.n_tokens for r in joined) == total and all(4 * r.n_tokens == len(r.ids) for r in joined)
    assert packing.pack(none, WORD_BPE).count() == 0


def test_plan_is_near_the_lower_bound_and_exact():
    rng = np.random.default_rng(0)
    for size, n in ((50, 200), (200, 3000), (4096, 5000)):
        lengths = rng.integers(1, size + 1, n)
        counts = collections.Counter(lengths.tolist())
        plan = packing.plan(dict(counts), size)
        used, load_of = collections.Counter(), collections.Counter()
        for length, first, last, seq, copies, _ in plan.tolist():
            assert first == used[length]
            used[length] += last - first
            for k in range((last - first) // copies):
                load_of[seq + k] += copies * length
        assert used == counts and max(load_of.values()) <= size
        if size < 4096:
            big = int((lengths > size // 2).sum())
            assert len(load_of) <= max(-(-int(lengths.sum()) // size), big) * 1.03 + 1


def test_exact_complements_are_found():
    stock = packing.Stock({5: 1, 3: 2, 2: 1}, 20)
    assert stock.exact(5) == (5,) and stock.exact(6) == (3, 3) and stock.exact(10) == (5, 3, 2) and stock.exact(4) == ()
    assert len({r[3] for r in packing.plan({7: 1, 6: 1, 4: 1, 3: 1}, 10).tolist()}) == 2  # 7 + 3, 6 + 4


# --- 3 sharding ---------------------------------------------------------------------------------------------

def test_sharding_keeps_rows_and_balances(docs, rows, none, tmp_path):
    for n in (3, 24, 100):
        got = sharding.cut(sharding.shuffled(docs, bucket_bytes=4000), n).select("record.*", "shard", "slot").collect()
        assert collections.Counter((r["doc_id"], r["text"], r["source"]) for r in got) == collections.Counter((r[0], r[1], r[3]) for r in rows)
        by = collections.defaultdict(list)
        for r in got:
            by[r["shard"]].append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) <= set(range(n))
        sizes = [len(by[k]) for k in range(n)]
        assert max(sizes) - min(sizes) <= 1
    assert sharding.cut(sharding.shuffled(none)).count() == 0
    path = f"{tmp_path}/shards"
    sharding.write_shards(docs, path, 5)
    back = docs.sparkSession.read.parquet(path)
    assert back.count() == len(rows) and back.select("shard").distinct().count() == 5


def test_sharding_spreads_equal_rows_and_repeats(spark):
    same = spark.range(4000).select(F.lit(1).cast("bigint").alias("doc_id"), F.lit("copy of one text").alias("text"), F.col("id").alias("n"))
    a = sharding.shuffled(same, bucket_bytes=4000)
    sizes = [r["count"] for r in a.groupBy("bucket").count().collect()]
    assert len(sizes) > 10 and max(sizes) < 4000 / 10
    key = ["bucket", "place"]
    assert a.select("record.n", *key).orderBy(*key).collect() == sharding.shuffled(same, bucket_bytes=4000).select("record.n", *key).orderBy(*key).collect()
    at = sharding.cut(a, 4).select("record.n", "shard").toPandas()
    assert abs(np.corrcoef(at["n"], at["shard"])[0, 1]) < 0.1


# --- 4 token files ------------------------------------------------------------------------------------------

def test_variable_length_coding_round_trip():
    rng = np.random.default_rng(2)
    table = rng.permutation(1 << 17).astype(np.uint32)
    rank_of = np.argsort(table).astype(np.uint32)
    for n in (0, 1, 3, 4, 5, 1000):
        ids = table[np.minimum(rng.geometric(0.001, n) * rng.integers(1, 300, n), (1 << 17) - 1)]
        control, data = token_files.encode(rank_of[ids])
        assert len(control) == -(-n // 4)
        assert (token_files.decode(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n, table) == ids).all()


def test_token_files_round_trip(docs, rows, none, tmp_path):
    path = f"file://{tmp_path}/{uuid.uuid4().hex}"
    token_files.write(docs, path, BYTE_BPE, block_ids=500)
    lib = Tokenizer.from_file(BYTE_BPE)
    want = collections.Counter((r[0], tuple([*lib.encode(r[1] or "", add_special_tokens=False).ids, 2])) for r in rows)
    got = token_files.read(docs.sparkSession, path).orderBy("start").collect()
    assert collections.Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == want
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    blocks = docs.sparkSession.read.parquet(f"{path}/blocks")
    assert blocks.count() > 3
    token_files.write(none, path + "e", BYTE_BPE)
    assert token_files.read(docs.sparkSession, path + "e").count() == 0


# --- 5 mixing -----------------------------------------------------------------------------------------------

def brute_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: float(weights[k % 3]) for k, s in enumerate(names)}
    full, out = set(), {}
    while True:
        left = share * sum(sizes.values()) - sum(cap * sizes[s] for s in full)
        free = [s for s in names if s not in full]
        out = {s: cap * sizes[s] for s in full} | {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if out[s] > cap * sizes[s] + 1e-9}
        if not over:
            return out
        full |= over


def test_mixing_meets_targets(docs, rows, none):
    got = mixing.mix(docs).collect()
    assert sorted(r["size"] for r in got) == sorted(len(words(r[1])) for r in rows)
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    want = brute_targets(sizes)
    taken, target = collections.Counter(), {}
    for r in got:
        source = next(x[3] for x in rows if x[0] == r["doc_id"] and len(words(x[1])) == r["size"])
        taken[source] += r["size"] * r["copies"]
        target[source] = r["target"]
        assert 0 <= r["copies"] <= 2 and r["source_size"] == sizes[source]
    for s in want:
        assert target[s] == pytest.approx(want[s], rel=1e-9, abs=1e-6)
        longest = max(len(words(r[1])) for r in rows if r[3] == s)
        assert abs(taken[s] - want[s]) <= max(60, longest / 2)
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["h0"], r["copies"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert collections.Counter(r["doc_id"] for r in out.collect()) == collections.Counter({k: v for k, v in _copies(got).items() if v})


def _copies(got):
    c = collections.Counter()
    for r in got:
        c[r["doc_id"]] += r["copies"]
    return c


def test_rates_are_the_constrained_tilt(spark):
    sizes = spark.createDataFrame([(False, "a", 10, 5), (False, "a", 100, 3), (False, "a", 1000, 1)], "no_source boolean, source_name string, size bigint, n bigint")
    goals = spark.createDataFrame([(False, "a", 1350, 700.0)], "no_source boolean, source_name string, source_size bigint, target double")
    got = {r["size"]: r["rate"] for r in mixing.rates(sizes, goals).collect()}
    assert 50 * got[10] + 300 * got[100] + 1000 * got[1000] == pytest.approx(700, rel=1e-6)
    assert np.log(got[100]) / np.log(got[10]) == pytest.approx(10, rel=1e-3)  # log rates in proportion to sizes
    goals = goals.withColumn("target", F.lit(2600.0))
    got = {r["size"]: r["rate"] for r in mixing.rates(sizes, goals).collect()}
    assert got[1000] == 2.0 and sum(s * n * got[s] for s, n in ((10, 5), (100, 3), (1000, 1))) == pytest.approx(2600, rel=1e-6)


# --- 6 html -------------------------------------------------------------------------------------------------

def lcs_length(a, b):
    t = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
    return t[-1, -1]


def test_alignment_is_a_longest_common_subsequence():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(14))] for _ in range(2))
        at = html_text.shared(a, b)
        assert at == sorted(set(at)) and len(at) == lcs_length(a, b)
        rest = iter(b)
        assert all(a[i] in rest for i in at)


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{}}</style><script>var t="</p>";if(a<b)c();</script></head>
<body class="page"><nav><ul><li><a href="/a">Home</a><li>More</ul></nav><div class="cookie-notice">We use <b>cookies</b></div><!-- <p>no</p> -->
<article><h1>Title {0}</h1><p>One &lt;b&gt; caf&eacute;&nbsp;{0}<p><b>Two<br>lines</p><form><input value="x>y">Send</form>
<div class="share"><a href=x>Share</a></div><ul><li>alpha<li>be<i>ta</i></ul></article><aside>Side</aside>
<section id="comments"><article class="comment"><p>Nice {0}</p></article></section><footer>&copy; us</footer></body></html>"""


def test_html_article_text(spark):
    pages = [(k, f"http://h.example/a/{k}", PAGE.format(k)) for k in range(5)]
    pages += [(10, None, None), (11, "x", ""), (None, None, "<p>bare &#8364; text"), (12, "http://h.example/a/1", PAGE.format(1)), (0, *pages[0][1:])]
    got = html_text.extract(spark.createDataFrame([(*p, 1) for p in pages], "page_id bigint, url string, html string, text int").repartition(3))
    by = collections.Counter((r.page_id, r.url, r.text) for r in got.collect())
    want = collections.Counter()
    for i, url, page in pages:
        k = None if not page or i is None else page[page.index("<h1>Title ") + 10]
        want[i, url, "bare € text" if i is None else f"Title {k} One <b> café {k} Two lines alpha beta" if page else ""] += 1
    assert by == want
    assert html_text.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_html_differencing_deletes_shared_lines_of_unmarked_pages(spark):
    page = "<body><div>Site name</div><div>Menu of the day</div><p>Story {0} begins with words of its own {0}</p><p>and goes on to say {0} things</p><div>All rights</div></body>"
    rows = [(k, f"http://h.example/s/{k:03d}", page.format(k * 7919)) for k in range(40)]
    rows.append((99, "http://other.example/", page.format(5)))
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(7)).collect()}
    for k in range(40):
        assert got[k] == f"Story {k * 7919} begins with words of its own {k * 7919} and goes on to say {k * 7919} things"
    assert got[99].startswith("Site name")  # no other page of its host


def test_html_on_the_given_pages(spark):
    pages = load(spark, SF, "pages")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        plain = re.sub(r"<[^>]+>", "", re.sub(r"</?(?:p|br|h1)>", " ", body))
        assert got[r.page_id] == " ".join(html.unescape(plain).split())


# --- 7 language ---------------------------------------------------------------------------------------------

def test_language_held_out_accuracy(spark):
    table = load(spark, "/root/testdata/sf0.01", "documents")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = language.learn(table.filter(~held))
    got = language.predict(table.filter(held).select("text", F.col("lang").alias("truth")), model, ["truth"]).toPandas()
    assert (got["truth"] == got["lang_pred"]).mean() > 0.97 and got["rejected"].mean() < 0.02
    assert got["score"].between(0, 1).all()
    odd = spark.createDataFrame([(None,), ("",), ("12 %% 3",), ("the thing and the other",)], "text string")
    preds = [r.lang_pred for r in language.predict(odd, model, []).collect()]
    assert preds[:3] == ["und"] * 3 and preds[3] in model.languages


def test_language_sample_holds_a_text_once(spark, monkeypatch):
    texts = spark.createDataFrame([(prose(k, 30), "en") for k in range(100)], "text string, lang string")
    lowest = texts.orderBy(F.pmod(F.xxhash64(F.lit(language.SEED), "text"), F.lit(language.HASHES))).limit(1)
    copies = lowest.crossJoin(spark.range(500)).select("text", "lang")
    seen, train = [], language.train
    monkeypatch.setattr(language, "train", lambda xs, *a: seen.extend(xs) or train(xs, *a))
    language.learn(texts.unionByName(copies), per_language=50)
    assert len(seen) > 25 and len({(b.tobytes(), c.tobytes()) for b, c in seen}) == len(seen)


def test_language_edges(docs, none):
    model = language.learn(docs)
    assert set(model.languages) == {"de", "en"}
    out = language.kept(docs, model)
    assert out.columns == docs.columns and None not in [r.text for r in out.collect()]
    assert language.kept(none, model).count() == 0
    empty = language.learn(none)
    assert empty.languages == [] and empty.score("words") == ("und", 0.0)


def test_subwords_do_not_depend_on_chunks(monkeypatch):
    text = prose(1, 400) + " été 日本語 İx"
    count = lambda: collections.Counter(np.concatenate(list(language.grams(text))).tolist())
    whole = count()
    monkeypatch.setattr(language, "CHUNK", 97)
    assert count() == whole


# --- 8 simhash ----------------------------------------------------------------------------------------------

def brute_fingerprint(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, radius=3):
    label = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i in range(len(prints)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= radius and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


def test_simhash_rows(docs, rows, none):
    got = collections.Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    prints = [brute_fingerprint(r[1]) for r in rows]
    label = brute_components(prints)
    ids = {k: min((r[0] for r, x in zip(rows, label, strict=True) if x == k and r[0] is not None), default=None) for k in set(label)}
    assert got == collections.Counter((r[0], f"{p:016x}", ids[k]) for r, p, k in zip(rows, prints, label, strict=True))
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    out = collections.Counter(r.doc_id for r in kept.collect())
    assert sum(out.values()) == len(set(label)) and out[3] == 1 and out[50] == 0 and out[None] == 2
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_first(none).count() == 0


@pytest.mark.parametrize("tile_rows", [7, 2048])
def test_simhash_links_dense_groups_and_chains(spark, tile_rows):
    rng = np.random.default_rng(5)
    prints = [int(x) for x in rng.integers(0, 1 << 63, 200, dtype=np.uint64)]
    for seed in prints[:20]:  # chains: each member within 3 bits of the one before
        x = seed
        for _ in range(8):
            for b in rng.choice(64, 3, replace=False):
                x ^= 1 << int(b)
            prints.append(x)
    prints += [prints[30] ^ 1 << a ^ 1 << b for a in range(20) for b in range(20)]  # a dense group
    label = brute_components(prints)
    fps = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in set(prints)], "fp bigint")
    edges = simhash.links(fps, 3, tile_rows)
    root = {int(np.int64(r.node).astype(np.uint64)): r.root for r in simhash.components(edges).collect()}
    want, got = collections.defaultdict(set), collections.defaultdict(set)
    for p, k in zip(prints, label, strict=True):
        want[k].add(p)
        got[root.get(p, ("own", p))].add(p)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, got.values()))
    if tile_rows == 2048:
        assert edges.count() < 20 * len(prints)


# --- 9 quality ----------------------------------------------------------------------------------------------

def brute_statistics(text):
    w = words(text)
    kept = [x for x in (text or "").split("\n") if words(x)]
    n = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    inside = {i + k for i, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if n[x] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(kept) - len(set(kept)), len(inside)


def test_quality_statistics():
    rng = random.Random(6)
    for _ in range(300):
        text = "".join(rng.choice(["a", "b", "a b ", "é", " ", "\n", "\t", "#", "%", "\x0b", "\xa0", "日", "a b c "]) for _ in range(rng.randrange(60)))
        assert quality.text_statistics(text) == brute_statistics(text), repr(text)
    assert quality.text_statistics(None) == (0, 0, 0, 0, 0)


def test_quality_learns_a_planted_rule():
    rng = np.random.default_rng(7)
    x = {"a": rng.random(3000), "b": rng.random(3000)}
    bad = ((x["a"] > 0.8) & (x["b"] <= 0.5)) | (x["b"] > 0.95)
    noisy = bad ^ (rng.random(3000) < 0.01)
    rules = quality.cover(x, noisy, rng.random(3000) < 0.33, precision=0.9)
    hit = np.zeros(3000, bool)
    for r in rules:
        hit |= quality._covered(r, x)
    assert (hit == bad).mean() > 0.97 and all(len(r) <= 4 for r in rules)
    assert quality.cover(x, np.zeros(3000, bool), rng.random(3000) < 0.33) == []


def test_quality_held_out_and_edges(spark, docs, rows, none):
    sf = "/root/testdata/sf0.01"
    table, labels = load(spark, sf, "documents"), load(spark, sf, "labels")
    seen = labels.filter("doc_id % 2 = 0")
    got = quality.judge(table, seen).join(labels.filter("doc_id % 2 = 1"), "doc_id").filter("not base_failed").toPandas()
    clean = got[got["quality"] == 1]
    assert clean["kept"].mean() > 0.97
    mine = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 0, 1), (2, None, 1), (999, 0, 0)], "doc_id bigint, quality int, toxic int")
    out = quality.judge(docs, mine).collect()
    assert len(out) == len(rows)
    for r in out:
        if r["kept"]:
            assert r["n_words"] >= 50 and 2 * r["n_repeat_words"] <= r["n_words"]
    kept = quality.kept(docs, mine)
    assert kept.columns == docs.columns
    assert collections.Counter(r.doc_id for r in kept.collect()) == collections.Counter(r["doc_id"] for r in out if r["kept"])
    assert quality.kept(none, mine).count() == 0 and quality.judge(docs, mine.limit(0)).count() == len(rows)


# --- 10 neighbours ------------------------------------------------------------------------------------------

def brute_nearest(ids, x, query, k):
    score = {}
    for i, v in zip(ids, x, strict=True):
        s = float((v * x[list(ids).index(query)]).sum())
        if i != query:
            score[i] = max(s, score.get(i, -np.inf))
    return sorted(score, key=lambda i: (-round(score[i], 12), i))[:k]


def test_neighbours_recall(spark):
    table = load(spark, "/root/testdata/sf0.01", "embeddings")
    got = collections.defaultdict(list)
    for r in ann.search(table, table.filter("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    pdf = table.toPandas()
    x = np.array(pdf["embedding"].tolist(), float)
    recall = [len(set(v) & set(brute_nearest(pdf["vec_id"], x, q, 20))) / 20 for q, v in got.items()]
    assert len(got) == 25 and np.mean(recall) >= 0.9


@pytest.mark.parametrize("name", ["sf0.001", "sf0.01", "sf0.1"])
def test_neighbours_come_from_visited_leaves(spark, name):
    table = load(spark, f"/root/testdata/{name}", "embeddings").select("vec_id", "embedding")
    valid = ann.vectors(table).select("vec_id", "vec")
    pdf = valid.toPandas()
    ids, x = pdf["vec_id"].to_numpy(), np.array(pdf["vec"].tolist(), float)
    forest = ann.fit(valid, x.shape[1], float(np.sqrt((x * x).sum(axis=1).max())))
    at, share = forest.leaves_of(x), 0.2
    got = collections.defaultdict(set)
    for r in ann.search(table, table.filter("vec_id % 100 = 0"), share=share).collect():
        got[r.query_id].add(r.vec_id)
    assert got
    for q, found in got.items():
        query = x[list(ids).index(q)]
        visited = set().union(*(ids[at[:, t] == leaf] for t, leaf in forest.visits(query, share, 42)[0]))
        assert len(visited) < 0.5 * len(ids) and len(found) == 20 and found <= visited
        scores = {i: float((v * query).sum()) for i, v in zip(ids, x, strict=True) if i in visited and i != q}
        assert found == set(sorted(scores, key=lambda i: (-round(scores[i], 12), i))[:20])  # and all of them are looked at
        assert len(set().union(*(ids[at[:, t] == leaf] for t, leaf in forest.visits(query, ann.SHARE, 42)[0]))) < len(ids)


def test_neighbours_recall_beyond_the_sample(spark):
    """Four times the sample: uniform directions, clusters and a vector that a third of the rows repeat."""
    rng, n, dim = np.random.default_rng(5), 4 * ann.SAMPLE, 64
    x = rng.standard_normal((n, dim))
    kind = np.arange(n) % 3
    middles = rng.standard_normal((40, dim))
    x[kind == 1] = middles[rng.integers(0, 40, (kind == 1).sum())] + 0.2 * x[kind == 1]
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[kind == 2] = x[2]
    ids = np.arange(n)
    table = spark.createDataFrame(list(zip(ids.tolist(), x.tolist(), strict=True)), "vec_id bigint, embedding array<double>").repartition(8)
    asked = list(range(0, n, 1092)) + list(range(1, n, 1092))[:-1] + [2, 3002]
    got = collections.defaultdict(list)
    for r in ann.search(table, table.filter(F.col("vec_id").isin(asked))).collect():
        got[r.query_id].append(r.vec_id)
    assert set(got) == set(asked)
    recall = collections.defaultdict(list)
    for q in asked:
        s = np.round(np.einsum("ij,j->i", x, x[q]), 12)
        s[q] = -np.inf
        recall[kind[q]].append(len(set(got[q]) & set(np.lexsort((ids, -s))[:20].tolist())) / 20)
    print({int(k): float(np.mean(v)) for k, v in recall.items()})
    assert all(np.mean(v) >= 0.9 for v in recall.values())


def test_neighbours_ties_and_bad_vectors(spark):
    same, other = [1.0, 2.0, 0.0], [0.0, 3.0, 1.0]
    rows = [(k, same if k % 3 else other) for k in range(120)]
    rows += [(200, None), (201, [0.0] * 3), (202, [1.0, None, 1.0]), (203, [float("nan"), 1.0, 1.0]), (204, [float("inf"), 1.0, 1.0]), (205, [1.0]), (None, same)]
    rows += [(0, other), (20, same)]  # repeated rows
    table = spark.createDataFrame([(*r, 5) for r in rows], "vec_id bigint, embedding array<double>, rank int").repartition(4)
    got = ann.search(table, table.filter("vec_id in (0, 20, 200, 201, 205)")).orderBy("query_id", "rank").collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert set(by) == {0, 20}
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    for q, mine in ((0, other), (20, same)):
        order = sorted((-score(mine, v), k) for k, v in rows[:120] if k != q)[:20]
        assert by[q] == [(n + 1, k, -s) for n, (s, k) in enumerate(order)]
    few = ann.search(table.filter("vec_id < 5"), table.filter("vec_id = 0"))
    assert [r.vec_id for r in few.orderBy("rank").collect()] == [3, 1, 2, 4]
    assert ann.search(table.limit(0), table.limit(0)).count() == 0


# --- 1 language model ---------------------------------------------------------------------------------------

def test_lm_probabilities_sum_to_one_and_gradient():
    net = lm_score.start(3)
    rng = np.random.default_rng(3)
    for k in net:
        net[k] = net[k].astype(float) + rng.normal(0, 0.05, net[k].shape)
    around = rng.integers(0, lm_score.VOCABULARY, (1, 4))
    every = np.arange(lm_score.VOCABULARY)
    *_, high, low, p, q = lm_score.forward(net, np.repeat(around, len(every), axis=0), every)
    assert np.exp(p[every, high] + q[every, low]).sum() == pytest.approx(1, rel=1e-9)
    ids = rng.integers(0, lm_score.VOCABULARY, 20)
    win = rng.integers(0, lm_score.VOCABULARY, (20, 4))

    def loss():
        *_, h, l, p, q = lm_score.forward(net, win, ids)
        return -(p[np.arange(20), h] + q[np.arange(20), l]).mean()

    before = {k: v.copy() for k, v in net.items()}
    base, eps, numeric = loss(), 1e-6, {}
    for k, at in (("high", (1, 2)), ("low", (3, int(ids[0] % 64))), ("bias", (4,)), ("low_bias", (5,)), ("high_bias", (int(ids[0] // 64),))):
        net[k][at] += eps
        numeric[k, at] = (loss() - base) / eps
        net[k][at] -= eps
    lm_score.step(net, win, ids, 1e-3)
    for (k, at), g in numeric.items():
        assert (before[k][at] - net[k][at]) / 1e-3 == pytest.approx(g, rel=1e-3, abs=1e-6)


def test_lm_scores(spark, docs, rows, none):
    table = load(spark, SF, "documents")
    classes, net = lm_score.learn(table)
    text = table.orderBy("doc_id").first()["text"]
    known = lm_score.Classes(classes)
    ids = lm_score.tokens(text, known)
    shuffled = np.random.default_rng(0).permutation(ids)
    assert lm_score.log_likelihood(net, ids) > lm_score.log_likelihood(lm_score.start(), ids)
    one = sum(lm_score.log_likelihood(net, x) for x in (ids, shuffled))
    assert np.isfinite(one)
    got = lm_score.score(docs).collect()
    assert collections.Counter((r.doc_id, r.n_tokens) for r in got) == collections.Counter((r[0], len(words(r[1]))) for r in rows)
    for r in got:
        assert (r.mean_log_prob is None and r.log_prob == 0) if not r.n_tokens else r.log_prob < 0
    assert lm_score.score(none).count() == 0


def test_lm_trains_on_every_document(spark):
    """Corpora of one document each: whatever its hash, the network has learned it."""
    begin = lm_score.start()
    for k in range(3):
        text = prose(100 + k, 400)
        classes, net = lm_score.learn(spark.createDataFrame([(k, text)], "doc_id bigint, text string"))
        ids = lm_score.tokens(text, lm_score.Classes(classes))
        assert lm_score.log_likelihood(net, ids) > lm_score.log_likelihood(begin, ids) + 1


@pytest.mark.parametrize("head", [lm_score.HEAD, 0])
def test_lm_words_of_a_class_have_their_own_probability(spark, monkeypatch, head):
    monkeypatch.setattr(lm_score, "HEAD", head)
    by = collections.defaultdict(list)
    for k in range(3000):
        by[lm_score.rare(b"rare%d" % k)].append(f"rare{k}")
    a, b, c, *_ = next(v for v in by.values() if len(v) > 2)  # of one class
    frequent = " ".join(f"w{k} " * 20 for k in range(lm_score.VOCABULARY - lm_score.RARE - 1))
    texts = [frequent, a, a, a, a, a, b, b, f"{a} {b} {b}", c]  # 6, 4 and 1 times
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: r.log_prob for r in lm_score.score(docs).collect()}
    assert got[1] == got[5] and got[6] == got[7]
    assert got[1] - got[6] == pytest.approx(np.log(6 / 4), abs=1e-6) and got[6] - got[9] == pytest.approx(np.log(4), abs=1e-6)
    counts = lm_score.word_counts(docs)
    classes = lm_score.vocabulary(counts)
    known, unseen = lm_score.shares(counts, classes)
    assert len(classes) == lm_score.VOCABULARY - lm_score.RARE - 1 and (set(known) == {w.encode() for w in (a, b, c)} or not head)
    if head:
        assert sum(np.exp(list(known.values()))) + np.exp(unseen[lm_score.rare(a.encode())]) == pytest.approx(1)
    net = lm_score.learn(docs)[1]
    ids = lm_score.tokens(texts[8], lm_score.Classes(classes))
    assert got[8] == pytest.approx(lm_score.log_likelihood(net, ids) + np.log(6 / 12) + 2 * np.log(4 / 12), abs=1e-3)


def test_lm_score_is_the_sum_over_hidden_tokens(monkeypatch):
    net, ids = lm_score.start(1), np.arange(1, 40)
    want = 0.0
    for k in range(len(ids)):
        around = [ids[j] if 0 <= (j := k + s) < len(ids) else lm_score.BORDER for s in (-2, -1, 1, 2)]
        *_, high, low, p, q = lm_score.forward(net, np.array([around]), ids[k:k + 1])
        want += p[0, high[0]] + q[0, low[0]]
    assert lm_score.log_likelihood(net, ids) == pytest.approx(want, rel=1e-5)
    monkeypatch.setattr(lm_score, "CHUNK", 7)
    assert lm_score.log_likelihood(net, ids) == pytest.approx(want, rel=1e-5)


# --- pipeline -----------------------------------------------------------------------------------------------

def test_pipeline_stages(spark, tmp_path):
    """Each stage on what its predecessor kept, against brute force on the same rows."""
    table = load(spark, SF, "documents").withColumn("row", F.lit(1))
    docs, ids = table, lambda df: collections.Counter(r.doc_id for r in df.select("doc_id").collect())
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tmp_path}/{name}"
        stage(spark, docs, SF).write.parquet(path)
        new, rows = spark.read.parquet(path), docs.collect()
        if name != "best-fit packing":
            assert new.columns == table.columns and new.join(docs, table.columns, "left_anti").count() == 0
        if name == "quality rules":
            stats = {r.doc_id: brute_statistics(r.text) for r in rows}
            rules = quality.learn(quality.statistics(docs, ["doc_id"]), load(spark, SF, "labels"))
            x = {f: np.array([eval(e.replace("greatest", "max"), {"max": max}, dict(zip(quality.STATS, stats[r.doc_id], strict=True)))  # noqa: S307
                              for r in rows], float) for f, e in quality.FEATURES.items()}
            bad = np.array([stats[r.doc_id][0] < 50 or 100 * stats[r.doc_id][4] > 50 * stats[r.doc_id][0] for r in rows])
            for rule in rules:
                bad |= quality._covered(rule, x)
            assert ids(new) == collections.Counter(r.doc_id for r, b in zip(rows, bad, strict=True) if not b)
        elif name == "language id":
            model = language.learn(docs)
            want = [r.doc_id for r in rows if model.score(r.text)[0] != "und" and model.score(r.text)[1] >= model.reject_below]
            assert ids(new) == collections.Counter(want) and len(want) >= 0.98 * len(rows)
        elif name == "simhash near-dedup":
            label = brute_components([brute_fingerprint(r.text) for r in rows])
            first = collections.defaultdict(list)
            for r, k in zip(rows, label, strict=True):
                first[k].append(r.doc_id)
            assert ids(new) == collections.Counter(min(v) for v in first.values())
        elif name == "source mix":
            size, taken = collections.Counter(), collections.Counter()
            for r in rows:
                size[r.source] += len(words(r.text))
            for r in new.collect():
                taken[r.source] += len(words(r.text))
            longest = {s: max(len(words(r.text)) for r in rows if r.source == s) for s in size}
            for s, want in brute_targets(size).items():
                assert abs(taken[s] - want) <= max(0.02 * want, longest[s] / 2)
            assert max(ids(new).values()) <= 2
        else:
            lib, want = Tokenizer.from_file(WORD_BPE), collections.Counter()
            for r in rows:
                t = [*lib.encode(r.text or "", add_special_tokens=False).ids, 1]
                for k, at in enumerate(range(0, len(t), 4096)):
                    want[r.doc_id, k, at, len(t[at:at + 4096]), zlib.crc32(np.array(t[at:at + 4096], "<u4").tobytes())] += 1
            got = new.collect()
            assert want == collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got)
            used = collections.Counter()
            for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
                assert r.offset == used[r.sequence_id]
                used[r.sequence_id] += r.length
            assert max(used.values()) <= 4096 and len(used) <= -(-sum(used.values()) // 4096) + 1
        docs = new


def test_pipeline_on_odd_rows(spark, docs, none):
    for start in (docs, none):
        at = start
        for _, stage in corpus_pipeline.STAGES:
            at = stage(spark, at, SF)
        at.count()
