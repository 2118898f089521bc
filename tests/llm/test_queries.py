"""Registered queries against their SQL, or against brute force where SQL has no form."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from fraudwatch.llm import fingerprints, pieces, quality, search, url_filter
from fraudwatch.llm.catalog import ORACLES, QUERIES
from tools.compare import rows_of, tables

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return tables(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    frame = QUERIES[name](spark, FOLDER)
    relation = con.sql(ORACLES[name])
    assert sorted(frame.columns) == sorted(relation.columns)
    assert rows_of(frame.columns, [tuple(r) for r in frame.collect()]) == rows_of(relation.columns, relation.fetchall())


def rows(con, sql):
    return con.sql(sql).fetchall()


def test_packing(spark, con):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = QUERIES["op3_packing"](spark, FOLDER).collect()
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for i, t in rows(con, "SELECT doc_id, text FROM documents")}
    covered = Counter()
    for r in got:
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert len(piece) == r.length and r.offset == 0 and r.doc_tokens == len(ids[r.doc_id])
        assert r.length <= 4096 and r.length & (r.length - 1) == 0
        assert zlib.crc32(np.array(piece, "<u4").tobytes()) == r.ids_crc32
        covered[r.doc_id] += r.length
    assert covered == {i: len(x) for i, x in ids.items()}
    assert sorted(r.sequence_id for r in got) == list(range(len(got)))
    by_id = sorted(got, key=lambda r: r.sequence_id)
    assert [r.length for r in by_id] == sorted((r.length for r in got), reverse=True)


def test_fingerprints(spark, con):
    got = {r.doc_id: r for r in QUERIES["op6_fingerprints"](spark, FOLDER).collect()}
    docs = rows(con, "SELECT doc_id, coalesce(text, '') FROM documents ORDER BY doc_id")
    assert len(got) == len(docs)

    def weights(text):
        return {w: n * len(w) for w, n in Counter(text.lower().split()).items()}

    def similarity(a, b):
        every = set(a) | set(b)
        return sum(min(a.get(x, 0), b.get(x, 0)) for x in every) / sum(max(a.get(x, 0), b.get(x, 0)) for x in every)

    off = []
    for (i, text), (_, after) in zip(docs, docs[1:] + docs[:1]):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        cut = lambda f: re.findall("." * fingerprints.DIGITS, f)
        assert r.near_edited == sum(a == b for a, b in zip(cut(r.fingerprint), cut(r.edited_fingerprint))) / fingerprints.SAMPLES
        off.append((r.near_edited - similarity(weights(text), weights(edited)), r.near_next - similarity(weights(text), weights(after))))
    # The collision rate estimates the generalised Jaccard similarity without bias.
    assert np.abs(np.mean(off, axis=0)).max() < 0.03 and np.std(off, axis=0).max() < 0.12
    same = {}
    for i, text in docs:
        assert same.setdefault(text, got[i].fingerprint) == got[i].fingerprint


def test_search(spark, con):
    got = {}
    for r in QUERIES["op9_search"](spark, FOLDER).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.doc_id, r.score))
    bags = {i: Counter(re.findall(r"\w+", (t or "").lower())) for i, t in rows(con, "SELECT doc_id, text FROM documents")}
    length = {i: sum(b.values()) for i, b in bags.items()}
    df = Counter(w for b in bags.values() for w in b)
    n, mean = len(bags), sum(length.values()) / len(bags)
    idf = {w: math.log1p((n - c + 0.5) / (c + 0.5)) for w, c in df.items()}
    hashes = search.WordHashes()
    order = {w: int(search.word_array(hashes, [w]).view(np.int64)[0]) for w in df}
    queries = [i for i in bags if i % 50 == 0]
    assert queries
    for q in queries:
        terms = sorted(bags[q], key=lambda w: (-bags[q][w] * idf[w], order[w]))[: search.QUERY_TERMS]
        scores = []
        for i, bag in bags.items():
            low = search.K1 * (1 - search.B + search.B * length[i] / mean)
            score = math.fsum(idf[w] * (bag[w] * (search.K1 + 1) / (bag[w] + low)) for w in terms if w in bag)
            if score:
                scores.append((-score, i))
        best = sorted(scores)[: search.TOP]
        mine = sorted(got.get(q, []))
        assert [i for _, i in best] == [i for _, i, _ in mine]
        assert np.allclose([-s for s, _ in best], [s for _, _, s in mine], atol=1e-8)


def test_sentencepiece(spark, con):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in QUERIES["op8_sentencepiece"](spark, FOLDER).collect()}
    for i, text in rows(con, "SELECT doc_id, coalesce(text, '') FROM documents"):
        ids = model.encode(text)
        assert got[i].same and got[i].n_ids == len(ids) and got[i].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())


def test_html(spark, con):
    import html

    got = {r.page_id: r for r in QUERIES["op10_html_extraction"](spark, FOLDER).collect()}
    for i, url, page in rows(con, "SELECT page_id, url, html FROM pages"):
        inside = re.search("<article>(.*?)</article>", page, re.S)[1].replace("<br>", " ")
        found = [" ".join(html.unescape(re.sub("<[^>]+>", "", x)).split()) for x in re.split("</?(?:p|h1)>", inside)]
        text = "\n".join(filter(None, found))
        assert (got[i].url, got[i].text, got[i].n_chars) == (url, text, len(text))


def test_quality_against_brute_force(spark, con):
    """Cells, ratios, log weights, the cut on held-out labels and the Gumbel top k, recounted in plain Python."""
    import xxhash

    whole = (1 << 64) - 1
    got = {r.doc_id: r for r in QUERIES["op7_quality_classifier"](spark, FOLDER).collect()}
    docs = rows(con, "SELECT doc_id, coalesce(text, '') FROM documents")
    told = quality.labelled(spark.read.parquet(f"{FOLDER}/labels.parquet")).collect()
    good, held = {r.doc_id: r.good for r in told}, {r.doc_id for r in told if r.held}
    assert good == {i: q > 0 for i, q in rows(con, "SELECT doc_id, min(quality) FROM labels GROUP BY doc_id")}

    def mixed(x):
        for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = ((x ^ (x >> 33)) * factor) & whole
        return x ^ (x >> 33)

    def cells(text):
        words = re.findall(r"\w+|[^\w\s]+", text)
        hashes = [xxhash.xxh3_64_intdigest(w.lower()) >> 3 for w in words]
        place = lambda x: quality.SHAPES + (mixed(x) >> 20) % (quality.CELLS - quality.SHAPES)
        pairs = [place((a * 0x9E3779B97F4A7C15 + b) & whole) for a, b in zip(hashes, hashes[1:])]
        shapes = [quality.AGAIN if i and hashes[i] == hashes[i - 1] else quality.shape_of(w) for i, w in enumerate(words)]
        two = [8 + 8 * a + b for a, b in zip(shapes, shapes[1:])]
        three = [72 + 64 * a + 8 * b + c for a, b, c in zip(shapes, shapes[1:], shapes[2:])]
        return Counter([place(h) for h in hashes] + pairs + shapes + two + three)

    bags = {i: cells(t) for i, t in docs}
    raw, target = Counter(), Counter()
    for i, bag in bags.items():
        raw.update(bag)
        if good.get(i) and i not in held:
            target.update(bag)
    share = target.total() / raw.total()
    ratio = {c: math.log(target[c] + quality.PRIOR) - math.log(n * share + quality.PRIOR) for c, n in raw.items()}
    weight = {i: math.fsum(n * ratio[c] for c, n in bag.items()) for i, bag in bags.items()}
    assert all(abs(got[i].log_weight - w) < 2e-6 for i, w in weight.items()) and len(got) == len(docs)

    place = lambda w: math.floor(abs(math.asinh(w) * 50) + 0.5) * (1 if w >= 0 else -1)
    judged = [(place(weight[i]), good[i]) for i in held if i in weight]
    edges, wrong = sorted({b for b, _ in judged}), []
    for edge in [*edges, math.inf]:
        kept_bad = sum(b >= edge for b, g in judged if not g) / sum(not g for _, g in judged)
        lost_good = sum(b < edge for b, g in judged if g) / sum(g for _, g in judged)
        wrong.append(kept_bad + lost_good)
    best = next(i for i, e in enumerate(wrong) if e <= min(wrong) + 1e-12)
    above = edges[best] if best < len(edges) else edges[-1] + 1
    cut = math.sinh((edges[best - 1] + above) / 2 / 50) if best else -math.inf
    k = sum(w >= cut for w in weight.values())

    def noisy(i, text):
        bits = xxhash.xxh3_64_intdigest(f"{i}\n{text}", quality.SEED) >> 11
        return weight[i] - math.log(-math.log((bits + 0.5) / 2**53))

    least = sorted((noisy(i, t) for i, t in docs), reverse=True)[k - 1]
    assert {i for i, r in got.items() if r.keep} == {i for i, t in docs if noisy(i, t) >= least - 1e-9} and 0 < k < len(docs)


def test_quality_on_labels(spark, con):
    got = {r.doc_id: r.keep for r in QUERIES["op7_quality_classifier"](spark, FOLDER).collect()}
    good = dict(rows(con, "SELECT doc_id, min(quality) FROM labels GROUP BY doc_id"))
    kept = [got[i] for i, q in good.items() if q and i in got]
    bad = [got[i] for i, q in good.items() if not q and i in got]
    assert sum(kept) >= 0.98 * len(kept) and sum(bad) <= 0.1 * len(bad)


def test_urls(spark, con):
    """Hosts, rules and scores by a plain implementation of the same smoothing."""
    got = {r.page_id: r for r in QUERIES["op1_url_filter"](spark, FOLDER).collect()}
    pages = dict(rows(con, "SELECT page_id, url FROM pages"))
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def split(url):
        found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        return (found[1].translate(low), found[2]) if found else ("", "")

    def rule(url):
        host, path = split(url)
        fits = [r for r in url_filter.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
        return (best[0] + best[1], best[2]) if best else (None, None)

    urls = {u for u in pages.values() if u}
    held = {r.url for r in url_filter.scores(spark.read.parquet(f"{FOLDER}/pages.parquet").select("url")).where("held").collect()}
    counts = {"allow": Counter(), "block": Counter()}
    for u in urls - held:
        if rule(u)[1]:
            padded = url_filter.START * url_filter.ORDER + u
            for at in range(len(u)):
                gram = padded[at : at + url_filter.ORDER + 1]
                counts[rule(u)[1]].update(gram[-k:] for k in range(1, url_filter.ORDER + 2))
    follow = {v: Counter(g[:-1] + "|" + str(len(g)) for g in c) for v, c in counts.items()}
    total = {v: Counter() for v in counts}
    for v, c in counts.items():
        for g, n in c.items():
            total[v][g[:-1] + "|" + str(len(g))] += n

    def prob(v, gram):
        p = 1 / url_filter.ALPHABET
        for k in range(1, url_filter.ORDER + 2):
            key = gram[-k:][:-1] + "|" + str(k)
            if total[v][key]:
                p = (counts[v][gram[-k:]] + follow[v][key] * p) / (total[v][key] + follow[v][key])
        return p

    cut_low, cut_high = -math.inf, math.inf
    for i, u in pages.items():
        r = got[i]
        assert (r.host, r.path, r.rule) == (*split(u), rule(u)[0])
        padded = url_filter.START * url_filter.ORDER + u
        grams = [padded[at : at + url_filter.ORDER + 1] for at in range(len(u))]
        score = sum(math.log(prob("allow", g)) - math.log(prob("block", g)) for g in grams) / len(u)
        assert abs(r.score - score) < 1e-6
        if rule(u)[1]:
            assert r.verdict == rule(u)[1]
        elif r.verdict == "allow":
            cut_high = min(cut_high, r.score)
        else:
            cut_low = max(cut_low, r.score)
    assert cut_low < cut_high
