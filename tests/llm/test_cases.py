"""Nulls, empty and long texts, ties, repeated rows, empty tables, hot keys and clashing column names."""

import json
import random
import sys
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fraudwatch.llm import base, components, fingerprints, html_text, jaccard_join, line_dedup, packing, pieces, quality, search, sharding, url_filter

WORDS = public_tokenizers.path("word_bpe_49k.json")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def text_of(rng, n):
    return " ".join(rng.choice("abcdefghij") * rng.randint(1, 3) + str(rng.randint(0, 400)) for _ in range(n))


# --- joins -------------------------------------------------------------------------------------------------


def plain_components(rows, percent=75):
    sets = []
    for _, text, *_ in rows:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, *_) in enumerate(rows):
        root = find(i)
        if doc_id is not None:
            least[root] = min(least.get(root, doc_id), doc_id)
    return sorted(((r[0], len(sets[i]), least.get(find(i)) if sets[i] else r[0]) for i, r in enumerate(rows)), key=repr)


def test_join_against_brute_force(spark, documents):
    rng = random.Random(5)
    rows, base = [], [text_of(rng, 60) for _ in range(6)]
    for i in range(160):
        words = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 2, 3, 4])):
            words[rng.randrange(len(words))] = f"edit{rng.random()}"
        rows.append((i, " ".join(words[: rng.choice([60, 60, 55, 48])])))
    rows += [(200, None), (201, ""), (202, " \n\t"), (203, "one two"), (204, "ONE  two"), (205, "one two three"), (None, rows[0][1]), (7, rows[7][1])]
    rows += [(206, "a b c d e"), (207, "A b c d e\n"), (208, "é É ß"), (209, "É É ß")]
    got = sorted(map(tuple, jaccard_join.components(documents(rows)).collect()), key=repr)
    assert got == plain_components(rows)


def test_join_of_one_large_group(spark, documents):
    rng = random.Random(6)
    base = text_of(rng, 80).split()
    rows = []
    for i in range(400):
        words = list(base)
        words[rng.randrange(80)] = f"x{i}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(base)) for i in range(300)]
    assert sorted(map(tuple, jaccard_join.components(documents(rows, 8)).collect()), key=repr) == plain_components(rows)


def test_chunks_of_near_copies_are_full(spark, documents, monkeypatch):
    """Near copies around the threshold follow many leaders; their component still forms few chunks, and few sets ask them."""
    rng = random.Random(16)
    base, rows = text_of(rng, 150).split(), []
    for i in range(400):
        words = list(base)
        for _ in range(rng.choice([1, 2, 2, 3])):
            words[rng.randrange(150)] = f"x{rng.randrange(3)}"
        rows.append((i, " ".join(words)))
    seen, members = [], jaccard_join._members

    def spied(*args):
        seen.append(members(*args))
        return seen[-1]

    monkeypatch.setattr(jaccard_join, "_members", spied)
    monkeypatch.setattr(jaccard_join, "CHUNK", 32)
    assert sorted(map(tuple, jaccard_join.components(documents(rows, 8)).collect()), key=repr) == plain_components(rows)
    chunks = seen[0].where("size > 1").groupBy("comp", "size").agg(F.countDistinct("chunk").alias("chunks"), F.count("sid").alias("sets")).collect()
    assert max(r["size"] for r in chunks) > 5 * jaccard_join.CHUNK
    assert all(r["chunks"] <= 2 * -(-r["size"] // jaccard_join.CHUNK) and r["sets"] == r["size"] for r in chunks)


def test_sets_just_short_of_joining_share_chunks(spark, documents, monkeypatch):
    """Versions of one text that hardly ever join lie around many leaders; they still form few chunks, and few sets ask each of them."""
    rng = random.Random(17)
    base, rows = text_of(rng, 150).split(), []
    for i in range(400):
        words = list(base)
        for _ in range(rng.choice([5, 6, 7])):
            words[rng.randrange(150)] = f"x{rng.randrange(5)}"
        rows.append((i, " ".join(words)))
    seen, asks = [], []

    def spied(into, made):
        def kept(*args):
            into.append(made(*args))
            return into[-1]

        return kept

    monkeypatch.setattr(jaccard_join, "_members", spied(seen, jaccard_join._members))
    monkeypatch.setattr(jaccard_join, "_open_chunks", spied(asks, jaccard_join._open_chunks))
    assert sorted(map(tuple, jaccard_join.components(documents(rows, 8)).collect()), key=repr) == plain_components(rows)
    comps, chunks = (seen[0].select(c).distinct().count() for c in ("comp", "chunk"))
    assert comps > 350 and chunks <= 60
    assert asks[0].count() <= 25 * len(rows)


class OfOneTask:
    """Stands for a table of one task: gives the function that the task runs."""

    def select(self, *columns):
        return self

    def repartition(self, *by):
        return self

    def mapInArrow(self, run, schema):
        return run


def test_counting_a_bucket_takes_little_memory(spark):
    """A bucket's hashes are counted in slices, so the arrays beside them stay small."""
    rng = random.Random(18)
    texts = [" ".join(f"w{rng.randrange(10**7)}" for _ in range(3000)) for _ in range(80)]
    texts += [text.rpartition(" ")[0] for text in texts[:20]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    dealt = list(jaccard_join._dealt(OfOneTask(), 5, 1)(iter([batch])))
    size = sum(len(x) for b in dealt for x in b.column("hashes").to_pylist())
    tracemalloc.start()
    found = list(jaccard_join._counted(OfOneTask(), 1)(iter(dealt)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(len(x) for x in found[0].column("hashes").to_pylist()) == 8 * 2 * 20 * 2995
    assert peak < 6 * size, peak / size


def test_stages_let_go_of_what_others_kept(spark):
    base.kept(("told", 1), lambda: "large")
    assert list(base.tidied(iter, keeps=True)(iter([1]))) == [1]
    assert "fraudwatch_kept" in sys.modules
    assert list(base.tidied(iter)(iter([1, 2]))) == [1, 2]
    assert "fraudwatch_kept" not in sys.modules


def test_join_of_nothing(spark, documents):
    assert jaccard_join.components(documents([])).collect() == []
    assert jaccard_join.components(documents([(1, None)])).collect() == [(1, 0, 1)]


@pytest.mark.parametrize("links", [
    [], [(1, 2)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)], [(5, 5)], [(2, 1), (1, 2), (4, 3), (3, 1), (9, 8)],
])
def test_connected(spark, links):
    got = dict(tuple(r) for r in components.connected(spark.createDataFrame(links, "a bigint, b bigint")).collect())
    parent = {x: x for pair in links for x in pair if pair[0] != pair[1]}
    for _ in links:
        for a, b in links:
            if a != b:
                low = min(parent[a], parent[b])
                parent = {k: low if v in (parent[a], parent[b]) else v for k, v in parent.items()}
    assert got == parent


# --- packing and pieces ------------------------------------------------------------------------------------


def test_cuts():
    for n in range(0, 300):
        found = packing.cuts(n, 16)
        assert sum(length for _, length in found) == n
        assert all(length & (length - 1) == 0 and length <= 16 for _, length in found)
        assert [s for s, _ in found] == [sum(x for _, x in found[:i]) for i in range(len(found))]


def test_pack(spark, documents):
    long = "word " * 9000
    rows = [(1, None), (2, ""), (3, long), (3, long), (None, "a b"), (4, "<|endoftext|> A<|ENDOFTEXT|>")]
    got = packing.pack(documents(rows).withColumn("start", F.lit("x")).withColumn("ids", F.lit(0)), WORDS).collect()
    assert sorted(r.sequence_id for r in got) == list(range(len(got)))
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    want = Counter()
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        want.update((doc_id, s, tuple(ids[s : s + n])) for s, n in packing.cuts(len(ids)))
    assert Counter((r.doc_id, r.start, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == want
    assert packing.pack(documents([]), WORDS).collect() == []


def test_pieces_of_any_text(spark, documents):
    import sentencepiece

    model, own, rng = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.Pieces(MODEL), random.Random(3)
    texts = ["", " ", "   a", "a   ", "\n\n", "①😀é", "x" * 5000, "the" * 3000, " " * 200 + "a", "ab" * 700 + " " + "zq" * 900]
    texts += ["".join(rng.choice("abthein  é①\n") for _ in range(rng.randint(1, 200))) for _ in range(200)]
    for text in texts:
        ids = np.frombuffer(pieces.encode(own, text), "<u4").tolist()
        assert ids == model.encode(text) and pieces.decode(own, ids) == text
        if text:
            assert pieces.ids_of(own, pieces.stream(own, "▁" + text.replace(" ", "▁"))) == ids
    rows = [(1, None), (None, "a"), (2, ""), (2, "x " * 50), (2, "x " * 50)]
    back = pieces.decoded(pieces.encoded(documents(rows).withColumn("ids", F.lit(1)), MODEL), MODEL).collect()
    assert sorted(map(tuple, back), key=repr) == sorted(((i, t or "") for i, t in rows), key=repr)


def test_stream_commits_early():
    own, read = pieces.Pieces(MODEL), 0

    def chars():
        nonlocal read
        for c in "▁the▁house" * 2000:
            read += 1
            yield c

    first = next(pieces.stream(own, chars()))
    assert first and read < 20 * own.most


# --- shards ------------------------------------------------------------------------------------------------


def plain_shards(rows, limit):
    import hashlib

    hashes = [int(hashlib.md5(f"{'' if i is None else i}\n{t or ''}".encode()).hexdigest()[:15], 16) for i, t in rows]
    sizes = [len((t or "").encode()) for _, t in rows]
    out = []
    for h in hashes:
        for depth in range(61):
            total = sum(s for x, s in zip(hashes, sizes) if x >> (60 - depth) == h >> (60 - depth))
            if total <= limit or depth == 60:
                out.append((format(h, "060b")[:depth], depth, total))
                break
    return out


@pytest.mark.parametrize("limit", [50, 400, 10**6])
def test_shards(spark, documents, limit):
    rng = random.Random(limit)
    rows = [(i, "é" * rng.randint(0, 40)) for i in range(120)] + [(None, "x" * 30), (500, None), (501, "y" * 5000), (3, "")]
    table = documents(rows).withColumn("shard", F.lit("taken")).withColumn("hash", F.lit(0)).withColumn("depth", F.lit(0))
    got = sharding.shards(table, limit).collect()
    want = [(i, s, d, b) for (i, _), (s, d, b) in zip(rows, plain_shards(rows, limit))]
    assert sorted(((r.doc_id, r.shard, r.depth, r.shard_bytes) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r.shard_bytes <= limit or r.bytes == r.shard_bytes for r in got)


def test_shards_of_copies(spark, documents):
    rows = [(1, "x" * 100)] * 95 + [(i, "z" * 10) for i in range(20)]
    got = sharding.shards(documents(rows, 4), 1000).collect()
    held = Counter()
    for r in got:
        held[r.shard] += r.bytes
    assert len(got) == len(rows) and max(held.values()) <= 1000
    assert all(held[r.shard] == r.shard_bytes for r in got)
    assert sharding.shards(documents([]), 10).collect() == []


def test_written_shards(spark, documents, tmp_path):
    rows = [(i, "text " * (i % 7)) for i in range(60)]
    sharding.write(documents(rows), str(tmp_path / "out"), 200)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.doc_id, r.text) for r in back.collect()) == rows
    assert max(r["b"] for r in back.groupBy("shard").agg(F.sum(F.octet_length("text")).alias("b")).collect()) <= 200


def test_written_shards_of_copies(spark, documents, tmp_path):
    """Copies of one row that exceed the limit go to pages that fit; other columns stay, whatever their names."""
    rows = [(7, "copied text " * 4)] * 33 + [(i, "text " * (i % 7)) for i in range(20)] + [(None, None)] * 5
    wide = documents(rows).withColumns({"row_hash": F.lit(1), "row_page": F.lit("p")})
    sharding.write(wide, str(tmp_path / "out"), 200)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter((r.doc_id, r.text, r.row_hash, r.row_page) for r in back.collect()) == Counter((i, t, 1, "p") for i, t in rows)
    sizes = back.groupBy("shard").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("b")).collect()
    assert max(r["b"] for r in sizes) <= 200 and any("+" in r["shard"] for r in sizes)


# --- lines -------------------------------------------------------------------------------------------------


def test_lines(spark, documents):
    rows = [(i, f"own line {i}\n All rights reserved. \n\nend of {i}", f"site{i % 12}") for i in range(40)]
    rows += [(100 + i, "a whole copied document\nwith a second line", f"site{i}") for i in range(30)]  # a copy is no boilerplate
    rows += [(200 + i, f"unlike the others {i} {i}\nfew sites", f"site{i % 9}") for i in range(60)]
    rows += [(300, None, "site1"), (301, "", None), (302, "All rights reserved.", None), (None, "x\nAll rights reserved.", None), (0, rows[0][1], "site0")]
    table = documents(rows).withColumn("line", F.lit(1)).withColumn("cut_lines", F.lit(2)).withColumn("site", F.lit("s"))
    got = line_dedup.drop_boilerplate(table)
    assert got.columns == table.columns
    want = [(i, "\n".join(x for x in t.split("\n") if x.strip() != "All rights reserved.") if t is not None else None) for i, t, _ in rows]
    rows_got = got.collect()
    assert sorted(((r.doc_id, r.text) for r in rows_got), key=repr) == sorted(want, key=repr)
    assert all(r.n_chars == (len(r.text) if r.text is not None else None) for r in rows_got)
    assert line_dedup.drop_boilerplate(documents([])).collect() == []


@pytest.mark.parametrize("sites", [9, 30])
def test_lines_on_true_sites(documents, sites):
    """Sites count however footers, bodies and copies are mixed; what many sites copied as a whole stays."""
    footer, longer = "short footer", "a footer that is a good deal longer than the documents above it are"
    both = [(i, f"own text {i}\n{footer}\n{longer}", f"s{i % sites}") for i in range(90)]
    under = [(200 + i, f"body number {i // sites} is copied to every site\nunder all", f"s{i % sites}") for i in range(30 * sites)]
    copied = [(2000 + i, "\n".join(f"line {k} of a long copied text" for k in range(9) if (i + k) % 13 or i % 3), f"s{i % sites}") for i in range(90)]
    alone = [(3000 + i, "a document of one line", f"s{i % sites}") for i in range(60)]
    rows = both + under + copied + alone
    got = {r.doc_id: r.text for r in line_dedup.drop_boilerplate(documents(rows)).collect()}
    gone = {footer, longer, "under all"} if sites >= 10 else set()
    assert got == {i: "\n".join(x for x in t.split("\n") if x not in gone) for i, t, _ in rows}


def test_lines_of_very_long_texts(documents):
    long = "\n".join(f"line {k}" for k in range(20_000))
    rows = [(i, f"{long}\nown {i}\nfooter" if i < 2 else f"own {i}\nfooter", f"s{i}") for i in range(12)]
    got = {r.doc_id: r.text for r in line_dedup.drop_boilerplate(documents(rows)).collect()}
    assert got == {i: t.removesuffix("\nfooter") for i, t, _ in rows}


def test_spread_near_the_threshold_is_exact(spark, documents):
    rows = []
    for line in range(40):
        for site in range(5 + line % 11):
            rows.append((len(rows), f"shared {line}\n" + f"padding that is longer than the shared line {len(rows)}", f"site{site}"))
    got = line_dedup.boilerplate(documents(rows)).count()
    assert got == sum(5 + line % 11 >= 10 for line in range(40))


# --- fingerprints ------------------------------------------------------------------------------------------


def test_fingerprint_cases(spark, documents):
    rows = [(3, "b c d"), (1, None), (2, "é😀 x" * 50), (9, ""), (5, "b c d"), (7, " b  c d ")]
    got = {r.doc_id: r for r in fingerprints.compare(documents(rows).withColumn("bucket", F.lit(1)).withColumn("turn", F.lit(1))).collect()}
    assert set(got) == {1, 2, 3, 5, 7, 9} and got[3].fingerprint == got[5].fingerprint == got[7].fingerprint
    assert got[1].fingerprint == got[9].fingerprint and got[9].near_next == 1.0  # after the last comes the first
    assert got[3].near_next == 1.0 and got[2].n_chars == 200
    assert fingerprints.compare(documents([])).collect() == []
    one = fingerprints.compare(documents([(4, "only me")])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert len(fingerprints.compare(documents([(4, "a b"), (4, "a b"), (None, "c"), (None, "c")])).collect()) == 4


# --- classifier --------------------------------------------------------------------------------------------


def test_classifier_cases(spark, documents):
    rng = random.Random(1)
    rows = [(i, text_of(rng, 40) if i % 4 else "BUY!! " * 30 + str(i)) for i in range(400)] + [(None, text_of(rng, 40)), (900, None), (901, "")]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 300)] + [(None, 1, 0), (5, None, 0), (5, 1, 0)], "doc_id bigint, quality int, toxic int")
    docs = documents(rows).withColumn("good", F.lit("x")).withColumn("held", F.lit("y"))
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(rows)
    assert all(r.keep == (r.doc_id % 4 > 0) for r in got if r.doc_id is not None and r.doc_id < 400)
    kept = quality.keep(docs, labels)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if r.keep)
    assert quality.classify(documents([]), labels).collect() == []
    assert all(r.keep for r in quality.classify(docs, labels.where("false")).collect())


def test_gumbel_draw_follows_the_weights():
    """Among many rows of weight 0 and 2, the best k hold them in the ratio that draws without replacement give."""
    heavy = [quality.noise(i, "h") + 2 for i in range(4000)]
    light = [quality.noise(i, "l") for i in range(4000)]
    best = sorted([(x, 1) for x in heavy] + [(x, 0) for x in light], reverse=True)[:400]
    assert 0.82 < sum(k for _, k in best) / 400 < 0.94  # e^2 : 1 is 0.88


@pytest.mark.parametrize("k", [1, 2, 700, 1500, 3000])
def test_kth_largest(spark, k):
    values = [float(i % 1000) for i in range(2990)] + [1e12, -1e12] + [5.0] * 8
    assert quality.kth_largest(spark.createDataFrame([(v,) for v in values], "v double"), "v", k) == sorted(values, reverse=True)[k - 1]


# --- URLs --------------------------------------------------------------------------------------------------


def test_url_cases(spark):
    urls = [
        None, "", "nothing", "http://", "HTTP://Example.COM", "https://example.com/en/x", "https://www.example.com/en/", "x://a.net/es/1?q#f",
        "http://net/fr/", "http://notnet/fr/", "http://a.com?x://b/c", "http://u@h.com:80/p#://", "a://b://c.net/es/", "http://é.org/" + "x" * 3000,
    ]
    table = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(urls * 2)], "page_id bigint, url string, Host string, judged_url string")
    got = {r.page_id: r for r in url_filter.judge(table).collect()}
    assert len(got) == 2 * len(urls)
    first = [got[i] for i in range(len(urls))]
    assert [(r.host, r.path) for r in first][:5] == [("", "")] * 4 + [("example.com", "")]
    assert [r.rule for r in first[5:9]] == ["example.com/en/", "www.example.com/en/", "net/es/", "net/fr/"]
    assert [r.verdict for r in first[5:9]] == ["block", "allow", "block", "block"]
    assert first[9].rule is None and first[10].path == "" and (first[11].host, first[11].path) == ("u@h.com:80", "/p")
    assert first[12].host == "b:" and {r.verdict for r in got.values()} <= {"allow", "block"} and first[0].score == 0
    assert all((got[i].verdict, got[i].score) == (got[i + len(urls)].verdict, got[i + len(urls)].score) for i in range(len(urls)))
    assert url_filter.judge(table.where("false")).collect() == []


def test_letters_are_merged_directly():
    """Runs of a-z ask the vocabulary's merges alone and get the library's ids; all others go through its rules."""
    encode, texts = packing.Encoder(WORDS), ["Some wordlike runs, it's 12 x\u00e9 \u00c9a don't THE<|x", "qqzxv thethethe \u4f60\u597d!! A.b <|endoftext|> s t", ""]
    library, asked = encode.tokenizer, []

    class Spy:
        def encode_batch_fast(self, runs, **options):
            asked.extend(runs)
            return library.encode_batch_fast(runs, **options)

    encode.tokenizer = Spy()
    assert [np.frombuffer(x, "<u4").tolist() for x in encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert asked and not [w for w in asked if w.isascii() and w.isalpha() and w.islower()]


def test_runs_met_before_are_remembered(monkeypatch):
    """A full memory of runs is not lost at once, and gives the same ids whatever its size."""
    words = [f"w{i}ord" for i in range(30)]
    texts = [" ".join(words), "  a  b " + " ".join(words[::-1]), " ", "x" * 100 + " " + words[3], "end "]
    want = [pieces.encode(pieces.Pieces(MODEL), t) for t in texts]
    monkeypatch.setattr(pieces, "KNOWN_RUNS", 20)
    small, runs, plain = pieces.Pieces(MODEL), [], pieces.of_run
    monkeypatch.setattr(pieces, "of_run", lambda p, run: runs.append(run) or plain(p, run))
    assert [pieces.encode(small, t) for t in texts] == want
    assert len(small.known) <= 20 and len(small.known.older) <= 20
    assert len(runs) < len(set(runs)) + 12


# --- search ------------------------------------------------------------------------------------------------


def test_wand_finds_what_all_scores_give():
    rng = np.random.default_rng(4)
    for _ in range(150):
        n = int(rng.integers(1, 600))
        terms, docs, impacts, scores = [], [], [], np.zeros(n)
        for term in range(int(rng.integers(1, 9))):
            own = rng.choice(n, size=int(rng.integers(1, n + 1)), replace=False)
            x = np.round(rng.exponential(size=len(own)), int(rng.integers(0, 3))) + 0.25
            terms.append(np.full(len(own), term * 7))
            docs.append(own)
            impacts.append(x)
            scores[own] += x
        index = search.Index(*map(np.concatenate, (terms, docs, impacts)), n)
        k = int(rng.integers(1, 12))
        want = sorted(((s, d) for d, s in enumerate(scores.tolist()) if s), key=lambda x: (-round(x[0], 9), x[1]))[:k]
        got = search.wand(index, [0, 7, 14, 21, 28, 35, 42, 49, 1], k)
        assert [d for _, d in got] == [d for _, d in want] and np.allclose([s for s, _ in got], [s for s, _ in want])
        bar = float(rng.exponential(2))
        assert search.wand(index, [0, 7, 14, 21, 28, 35, 42, 49, 1], k, bar) == [x for x in got if x[0] >= bar]


def test_wand_side_by_side():
    """Rare terms summed by posting and frequent ones by table: queries side by side get what all scores give, in any order of postings."""
    rng = np.random.default_rng(9)
    for _ in range(20):
        n = int(rng.integers(300, 1500))
        bags = [rng.choice(n, size=int(rng.integers(1, n if t < 12 else n // 40 + 2)), replace=False) for t in range(60)]
        terms, docs = np.repeat(np.arange(60) * 3, list(map(len, bags))), np.concatenate(bags)
        impacts = np.repeat(rng.exponential(size=60), list(map(len, bags))) * rng.choice([1.0, 1.0, 2.5], size=len(docs))
        order = rng.permutation(len(docs))
        index, other = search.Index(terms, docs, impacts, n), search.Index(terms[order], docs[order], impacts[order], n)
        assert 0 < index.table.shape[1] < 60
        asked = [rng.choice(200, size=int(rng.integers(0, 150)), replace=False) for _ in range(9)]
        bars = (rng.exponential(size=9) * rng.integers(0, 2, size=9)).tolist()
        got = search.wand_all(index, asked, 10, bars)
        assert got == search.wand_all(other, [x[::-1] for x in asked], 10, bars)
        for query, bar, mine in zip(asked, bars, got):
            scores = np.bincount(docs, weights=impacts * np.isin(terms, query), minlength=n)
            want = sorted(((-round(s, 8), d) for d, s in enumerate(scores.tolist()) if s > 1e-6))[:10]
            want = [(s, d) for s, d in want if -s >= bar]
            assert np.allclose([s for s, _ in mine], [-s for s, _ in want], atol=1e-7) and len({d for _, d in mine}) == len(mine)
            assert np.allclose([scores[d] for _, d in mine], [s for s, _ in mine], atol=1e-7)


def test_search_lists_hold_counts_of_any_size(spark, documents):
    """Batches are inverted once: term, place and count of every posting, two bytes each where they fit."""
    docs = documents([(1, "a " * 70_000 + "b"), (2, None), (3, "b c b")])
    told, seen = defaultdict(int), Counter()
    for row in search.inverted(docs).collect():
        runs = np.frombuffer(row["runs"], "<u4")
        places, counts = (search.widen(row[x], int(runs.sum())) for x in ("places", "counts"))
        for term, place, count in zip(np.repeat(np.frombuffer(row["terms"], np.int64), runs), places, counts.tolist()):
            told[row["ids"][place], int(term)] += count
        seen.update(row["ids"])
    assert sorted(told.values()) == [1, 1, 2, 70_000] and seen == Counter([1, 2, 3])


def test_search_cases(spark, documents):
    rows = [(0, "alpha beta"), (50, "alpha beta"), (51, "alpha beta"), (51, "alpha beta"), (None, "alpha beta"), (100, None), (150, ""), (7, "gamma " * 30)]
    docs = documents(rows).withColumn("term", F.lit(1)).withColumn("shard", F.lit(1))
    got = defaultdict(list)
    for r in search.search(docs, docs.where("doc_id % 50 = 0"), 4).collect():
        got[r.query_id].append((r["rank"], r.doc_id))
    assert {q: sorted(x) for q, x in got.items()} == {q: [(1, 0), (2, 50), (3, 51), (4, 51)] for q in (0, 50)}
    assert search.search(documents([]), documents([]), 3).collect() == []


def test_search_asks_for_whole_texts(spark, documents, monkeypatch):
    """All 40 terms of a query count, and queries in many blocks get the same answers."""
    words = [f"w{i:02d}" for i in range(40)]
    rows = [(0, " ".join(words)), (50, " ".join(words[::-1]))] + [(i, " ".join(words[: i % 41])) for i in range(1, 50)]
    docs = documents(rows)

    def ask():
        return sorted(map(tuple, search.search(docs, docs.where("doc_id % 50 = 0"), 30).collect()))

    got = ask()
    assert {d for q, _, d, _ in got if q == 0} == {0, 50} | set(sorted(range(1, 50), key=lambda i: (-(i % 41), i))[:28])
    bags = {i: t.split() for i, t in rows}
    mean = sum(map(len, bags.values())) / len(bags)
    df = Counter(w for b in bags.values() for w in b)
    idf = {w: np.log1p((len(bags) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    for _, _, d, score in got:
        low = search.K1 * (1 - search.B + search.B * len(bags[d]) / mean)
        assert abs(score - sum(idf[w] * (search.K1 + 1) / (1 + low) for w in bags[d])) < 1e-8
    monkeypatch.setattr(search, "BLOCK_TERMS", 10)
    assert ask() == got


def test_search_takes_a_shard_in_pieces(spark, documents, monkeypatch):
    """A task holds the index of a bounded piece of its shard, however much the shard got; the answers are those of the whole."""
    rng = np.random.default_rng(3)
    rows = [(i if i % 11 else None, " ".join(f"w{j}" for j in rng.integers(0, 60, int(rng.integers(1, 30))))) for i in range(400)]
    docs = documents(rows).coalesce(1)
    monkeypatch.setattr(base, "BLOCK_CHARS", 300)
    lists = search.inverted(docs).drop("number").toArrow()
    df, n, mean, parts = search.statistics(search.inverted(docs))
    asked = search.queries_of(docs.where("doc_id % 50 < 9"), df, n).withColumn("block", F.lit(0))
    block = {name: bytes(raw) for name, raw in search.packed(asked).drop("block").first().asDict().items()}
    sizes, index = [], search._index

    def spied(*given):
        made = index(*given)
        sizes.append(made[0].size)
        return made

    monkeypatch.setattr(search, "_index", spied)
    tell = lambda: sorted(map(str, pa.Table.from_batches(search.answered(iter(lists.to_batches()), block, {}, mean, 5)).to_pylist()))
    whole = tell()
    assert sizes == [400] and len(whole) > 50 and lists.num_rows > 20
    sizes.clear()
    monkeypatch.setattr(search, "PIECE_WORDS", 500)
    monkeypatch.setattr(search, "PIECE_DOCS", 40)
    assert tell() == whole
    assert max(sizes) <= 40 and sum(sizes) == 400 and parts == 1


# --- pages -------------------------------------------------------------------------------------------------


def test_page_furniture():
    page = """<!doctype html><html><head><title>t</title><style>a>b{}</style></head><body class="with-sidebar"><header>Site</header>
    <div id="cookie-notice">We use cookies</div><nav><a href="/">Home</a></nav><main><article><header><h1>Head &amp; line</h1></header>
    <p>One <b>bold</b>word<br>next\n line<p>Two &lt;3&nbsp;x<script>if (a<b) {"</p>"}</script><form><input>Name</form>
    <aside>More</aside><div class="ad-box">Buy</div><ul><li>a<li>b</ul><table><tr><td>1<td>2</table></article>
    <section id="comments"><article class="comment"><p>First!</p></article></section></main><footer>&copy; x</footer></body></html>"""
    want = ["Head & line", "One boldword next line", "Two <3 x", "a", "b", "1", "2"]
    assert html_text.read(page, html_text.induce([page])) == "\n".join(want)
    for broken in ("", "<", "<p", "a < b", "<p>x", "</p></div>x", "<!-- x", "<script>x", "<a 'x", "x<br", "<p a=\"'>y</p>", "<div" * 50):
        html_text.read(broken, html_text.induce([broken]))
    assert html_text.read("<p>x</p>" * 20000, html_text.induce(["<p>x</p>" * 20000])).count("\n") == 19999


def test_wrapper_without_semantic_elements(spark):
    page = "<html><body><div class='top'>Example Site</div><div class='box'><div class='lead'>Story {0} of {0}</div><p>Text {0} is here.</p></div><div class='end'>Imprint and terms</div></body></html>"
    rows = [(i, f"http://host{i % 2}.org/{i}", page.format(i * 7)) for i in range(40)] + [(90, "http://host1.org/90", None), (91, None, "<p>alone</p>"), (None, "", "")]
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("host", F.lit("x")).withColumn("wrapper", F.lit("x"))
    got = {r.page_id: r.text for r in html_text.extract(table).collect()}
    assert all(got[i] == f"Story {i * 7} of {i * 7}\nText {i * 7} is here." for i in range(40))
    assert (got[90], got[91], got[None]) == ("", "alone", "")
    assert html_text.extract(table.where("false")).collect() == []


def test_template_inside_articles(spark):
    """What all pages of a host say inside the article goes, learnt from all its pages, not from a sample."""
    page = "<html><body><article><h1>Story {0}</h1><p>Text {0} is here.</p>{1}</article><p>Imprint</p></body></html>"
    box = "<div class='x7'><p>Read more at Example Site</p></div>"
    rows = [(i, f"http://a.org/{i}", page.format(i, box if i % 20 else "")) for i in range(60)]
    rows += [(100 + i, "http://a.org/copy", rows[0][2]) for i in range(200)]  # copies are one page
    rows += [(400 + i, f"http://b.org/{i}", page.format(i, box if i % 2 else "")) for i in range(20)]
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract(table).collect()}
    own = lambda i: f"Story {i}\nText {i} is here."
    assert all(got[i] == own(i) for i in range(60)) and all(got[100 + i] == own(0) for i in range(200))
    assert all(got[400 + i] == own(i) + ("\nRead more at Example Site" if i % 2 else "") for i in range(20))


def test_slot_from_all_pages(spark):
    """A line that most pages of a host share and a few lack does not move the slot, whichever pages are met first."""
    page = "<html><body><div class='k1'><p>{1}</p></div><div class='k2'><div class='k3'><p>Text {0} is here.</p></div></div></body></html>"
    usual = "A long line that stands on nearly all of the pages of this host and says nothing of any of them"
    hashed = spark.range(200).orderBy(F.xxhash64("id", F.concat(F.lit("http://a.org/"), F.col("id").cast("string")))).collect()
    odd = {r.id for r in hashed[1:9]}  # near each other in the order of hashes
    rows = [(i, f"http://a.org/{i}", page.format(i, "x" if i in odd else usual)) for i in range(200)]
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(7)
    (told,) = html_text.wrappers(table).collect()
    assert json.loads(told.wrapper)["slot"] == "/html/body/div.k2/div.k3"
    assert html_text.induce([r[2] for r in rows[1:]])["slot"] == "/html/body/div.k2/div.k3"
    got = {r.page_id: r.text for r in html_text.extract(table).collect()}
    assert got == {i: f"Text {i} is here." for i in range(200)}


def test_tree_matching():
    blocks = lambda *paths: html_text.tree([(p, "x", False) for p in paths])
    a, b = blocks("/a/b", "/a/c", "/a/b/d", "/e"), blocks("/a/c", "/a/b/d", "/f")
    assert html_text._score(a, b, {}) == 5  # root, a, c, b, d
    assert [(x.name, y.name) for x, y in html_text._pairs(a, b, {})] == [("a", "a")]


def plain_matching(a, b):
    """Simple tree matching by its definition: the number of common nodes, and the paired children."""
    if a.name != b.name:
        return 0, []
    best = [[0] * (len(b.kids) + 1) for _ in range(len(a.kids) + 1)]
    for i, x in enumerate(a.kids, 1):
        for j, y in enumerate(b.kids, 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + plain_matching(x, y)[0])
    i, j, out = len(a.kids), len(b.kids), []
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((a.kids[i], b.kids[j]))
    return 1 + best[-1][-1], out[::-1]


def test_tree_matching_of_any_size():
    """Nodes with very many children are matched in order like others, and trees are matched to their full depth."""
    rng = random.Random(11)
    for _ in range(150):
        roots = [html_text.tree([("/" + "/".join(rng.choice("abc") for _ in range(rng.randint(1, 4))), "x", False) for _ in range(rng.randint(1, 25))]) for _ in range(2)]
        score, pairs = plain_matching(*roots)
        assert html_text._score(*roots, {}) == score and html_text._pairs(*roots, {}) == pairs
    wide = lambda names: html_text.tree([(f"/{n}/{m}", "x", False) for n, m in names])
    turns = [("ab"[i % 2], "cd"[i // 2 % 2]) for i in range(4000)]
    a, b = wide(turns), wide(turns[1:] + turns[:1])
    assert html_text._score(a, b, {}) == 1 + 2 * 3999
    assert html_text._pairs(a, b, {}) == list(zip(a.kids[1:], b.kids))
    deep = lambda last: html_text.tree([("/a" * 3000 + last, "x", False)])
    assert html_text._score(deep("/b/c"), deep("/b/d"), {}) == 3002
    assert len(html_text.aligned(deep("/b/c"), deep("/b/d"))) == 3002


def test_slot_in_a_deep_page(spark):
    """What varies far down in a page is told apart from what does not, also beyond sixty levels."""
    low, top = "".join(f"<div class='q{i}'>" for i in range(70)), "</div>" * 70
    page = f"<html><body>{low}<div class='k1'><p>{{1}}</p></div><div class='k2'><div><p>Text {{0}} is here, and it is long enough to be the story.</p></div></div>{top}</body></html>"
    rows = [(i, f"http://a.org/{i}", page.format(i, "Visits" if i % 20 else "odd")) for i in range(60)]
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(4)
    (told,) = html_text.wrappers(table).collect()
    assert json.loads(told.wrapper)["slot"].endswith("/div.q69/div.k2/div")
    got = {r.page_id: r.text for r in html_text.extract(table).collect()}
    assert got == {i: f"Text {i} is here, and it is long enough to be the story." for i in range(60)}
