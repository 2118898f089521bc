"""Filter audit, exact dedup and periodic runs: brute force, index behaviour and edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fraudwatch.llm import exact_dedup, filter_audit, periodic_runs
from fraudwatch.llm.catalog import QUERIES

FOLDER = "/root/testdata/sf0.001"
LABELS = "doc_id bigint, quality int, toxic int"


# --- filter audit ------------------------------------------------------------------------------------------


def plain_audit(rows, labels):
    """Apply every order to every row; rows are (doc_id, text, source)."""
    good, toxic = ({i for i, *v in labels if v[k] == 1 and i is not None} for k in (0, 1))
    ids = defaultdict(set)
    for i, t, _ in rows:
        if i is not None:
            ids[t or ""].add(i)
    fails = []
    for i, t, source in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        failed = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)),
            "E": i is not None and min(ids[t]) < i,
        }
        fails.append((source or "", {f for f, x in failed.items() if x}, i in good, i in toxic))
    out, shapley = {}, Counter()
    for order in permutations("ABCDE"):
        for part in {f[0] for f in fails}:
            left = [f for f in fails if f[0] == part]
            mine = list(left)
            for step, letter in enumerate(order, 1):
                gone = [f for f in left if letter in f[1]]
                left = [f for f in left if letter not in f[1]]
                shapley[part, letter] += len(gone)
                out[part, "".join(order), step] = (
                    len(left), len(gone), sum(letter in f[1] for f in mine) - len(gone), sum(f[1] == {letter} for f in mine),
                    sum(f[2] for f in gone), sum(f[3] for f in gone))
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_against_brute_force(spark, documents):
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefg") * rng.randint(1, 4) + str(rng.randint(0, 300))
    long = " ".join(word() for _ in range(400)) + " " + "x" * 300_000
    texts = [None, "", " \n", "a a a a", "ABC def", "50 % off", long, "a " * 300, "　wide space", "ABC def"]
    texts += [" ".join(word() for _ in range(rng.choice([20, 210, 260]))) + rng.choice(["", " #", " CAPITALS " * 9]) for _ in range(25)]
    rows = [(i, rng.choice(texts), rng.choice(["web", "news", "", None])) for i in range(120)]
    rows += [rows[3], rows[3], (None, "50 % off", "web"), (None, "ABC def", None), (None, None, "ids")] + [(500 + i, texts[10], "hot") for i in range(60)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 130, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    wide = documents(rows, 5).withColumns({"part": F.lit("x"), "mask": F.lit(7), "N": F.lit(1), "text_key": F.lit("k"), "good": F.lit(1)})
    got = filter_audit.audit(wide, spark.createDataFrame(labels, LABELS)).collect()
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got} == plain_audit(rows, labels) and len(got) == 600 * len({s or "" for _, _, s in rows})


def test_audit_of_nothing(spark, documents):
    assert filter_audit.audit(documents([]), spark.createDataFrame([], LABELS)).collect() == []
    got = filter_audit.audit(documents([(1, None, None)]), spark.createDataFrame([], LABELS)).collect()
    assert len(got) == 600 and {(r.part, r.removed, r.kept) for r in got} <= {("", 0, 1), ("", 1, 0), ("", 0, 0)}


def test_walk_toggles_one_filter_at_a_time():
    counts = np.random.default_rng(4).integers(0, 50, (3, 16, 2))
    states = filter_audit.walk(counts)
    for subset in range(16):
        stays = [m for m in range(16) if not m & subset]
        assert (states[subset] == counts[:, stays].sum(axis=1)).all()


# --- exact dedup -------------------------------------------------------------------------------------------


def plain_classes(rows):
    groups = defaultdict(list)
    for at, (i, t, *_) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, at))
    out = []
    for text, members in groups.items():
        best = min(members)
        keep = None if best[1] else best[2]
        digest = hashlib.sha256(text.encode()).digest()
        out += [(digest, None if m[1] else m[2], -m[0], keep, len(members), m == best) for m in members]
    return out


DEDUP_ROWS = [
    (1, "a b"), (2, "ab"), (3, "a  b"), (4, " ab "), (5, None), (6, ""), (7, "\n"), (8, "a b"), (None, "a\tb "), (9, "x"), (9, "x"), (9, "x"),
    (None, "alone"), (None, "alone"), (10, "y" * 300_000), (11, "y" * 150_000 + " " + "y" * 150_000), (12, "é"), (13, "é"), (14, "A b"),
] + [(100 + i, "hot text") for i in range(300)] + [(600 + i, f"single {i}") for i in range(300)]


def test_dedup_against_brute_force(documents):
    wide = documents(DEDUP_ROWS, 6).withColumns({"digest": F.lit(1), "ROW": F.lit(2), "copies": F.lit(3), "kept": F.lit(4)})
    got = Counter((bytes(r.digest), *tuple(r)[1:]) for r in exact_dedup.classes(wide).collect())
    assert got == Counter(plain_classes(DEDUP_ROWS))


def test_dropped_copies(documents):
    wide = documents(DEDUP_ROWS, 6).withColumns({"kept_id": F.lit(1), "Kept_Digest": F.lit("z")})
    left = exact_dedup.drop_copies(wide)
    assert left.columns == wide.columns
    want = Counter((i, n) for _, i, n, _, _, stays in plain_classes(DEDUP_ROWS) if stays)
    assert Counter((r.doc_id, len(r.text or "")) for r in left.collect()) == want


def test_dedup_of_nothing(documents):
    assert exact_dedup.classes(documents([])).collect() == [] and exact_dedup.drop_copies(documents([])).collect() == []


def digests(n, seed=0):
    return [hashlib.sha256(f"{seed}:{i}".encode()).digest() for i in range(n)]


def test_cuckoo_index_grows_from_its_keys():
    index = exact_dedup.CuckooIndex(1)
    every = digests(5000)
    for i, d in enumerate(every):
        index.add(d, 1, (0, 0, i, i))
    assert index.mask + 1 >= 1250 and index.alive == 5000
    assert [index.key(index.find(d)) for d in every] == every and all(index.find(d) < 0 for d in digests(5000, 1))


def test_cuckoo_index_verifies_hits():
    """Two digests with the same fingerprint and buckets are told apart by their keys."""
    one, other = bytes(16) + b"1" * 16, bytes(16) + b"2" * 16
    index = exact_dedup.CuckooIndex()
    index.add(one, 2, (0, 0, 1, 1))
    assert index.find(other) < 0
    index.add(other, 5, (0, 0, 2, 2))
    assert index.copies[index.find(one)] == 2 and index.copies[index.find(other)] == 5
    # More of them than two buckets hold: the table cannot be helped by growing, so no more than eight share all 80 bits.
    assert index.delete(one) and not index.delete(one) and index.find(one) < 0 and index.find(other) >= 0


def test_cuckoo_index_against_a_dictionary():
    rng, index, plain = random.Random(8), exact_dedup.CuckooIndex(4), {}
    every = digests(900)
    for step in range(20_000):
        d = rng.choice(every)
        if rng.random() < 0.4:
            assert index.delete(d) == (plain.pop(d, None) is not None)
        else:
            rank = (-rng.randint(0, 5), 0, step, step)
            index.add(d, 1, rank)
            n, best = plain.get(d, (0, rank))
            plain[d] = (n + 1, min(best, rank))
    assert {index.key(e): (index.copies[e], index.rank[e]) for e in index.entries()} == plain and index.alive == len(plain)


def test_combining_is_bounded_and_whole():
    import pyarrow as pa

    every = digests(300)
    told = [every[i % 7] if i % 3 else every[i % 300] for i in range(9000)]
    batch = lambda part: pa.record_batch([
        pa.array(part, pa.binary()), *(pa.array([v] * len(part), k) for v, k in
                                      ((1, pa.int64()), (5, pa.int64()), (0, pa.int32()), (3, pa.int64()), (4, pa.int64())))], names=exact_dedup.NAMES)
    sums, rows = Counter(), 0
    for out in exact_dedup.combine(iter([batch(told[i : i + 500]) for i in range(0, 9000, 500)]), most=50):
        rows += out.num_rows
        for d, n in zip(out.column("digest").to_pylist(), out.column("copies").to_pylist()):
            sums[d] += n
    assert sums == Counter(told) and rows < 5000


def test_index_takes_and_withdraws(documents):
    day1, day2 = documents([(1, "a"), (2, "b"), (3, "a")]), documents([(4, "a"), (5, "c"), (6, "b b")])
    index = exact_dedup.update(None, exact_dedup.keyed(day1))
    gone = exact_dedup.keyed(documents([(0, " a ")]))
    after = exact_dedup.update(index, exact_dedup.keyed(day2), gone)
    key = lambda t: hashlib.sha256(t.encode()).digest()
    got = {bytes(r.digest): (r.copies, r.doc_id) for r in after.collect()}
    assert got == {key("a"): (1, 4), key("b"): (1, 2), key("c"): (1, 5), key("bb"): (1, 6)}
    assert exact_dedup.update(after, withdrawn=gone).count() == 3


# --- periodic runs -----------------------------------------------------------------------------------------


def plain_runs(words):
    found = {}
    n = len(words)
    for p in range(1, n // 3 + 1):
        i = 0
        while i + p < n:
            start = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            if i > start and i + p - start >= max(24, 3 * p):
                found.setdefault((start, i + p), p)
            i += 1
    return sorted(((s, e - s, p) for (s, e), p in found.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(4))
def test_runs_against_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(80):
        words, n = [], rng.choice([5, 24, 80, 300, 700])
        while len(words) < n:
            base = [rng.randint(1, rng.choice([1, 2, 3, 40])) for _ in range(rng.randint(1, 50))]
            words += [base[i % len(base)] for i in range(int(len(base) * rng.choice([1, 1, 2.5, 3, 5, 9, 24])))]
        assert periodic_runs.find_runs(np.array(words, np.int32)) == plain_runs(words)


def test_common_extensions():
    rng = np.random.default_rng(2)
    for n, kinds in ((30, 2), (64, 1), (65, 1), (1000, 2), (1500, 1)):
        words = rng.integers(1, kinds + 1, n).astype(np.int32)
        if kinds == 2:
            words[n // 2 :] = words[: n - n // 2]
        extensions = periodic_runs.Extensions(words)
        a, b = np.sort(rng.integers(0, n, (2, 400)), axis=0)
        a, b = a[a < b], b[a < b]
        for x, y, got in zip(a.tolist(), b.tolist(), extensions.common(a, b).tolist()):
            want = 0
            while y + want < n and words[x + want] == words[y + want]:
                want += 1
            assert got == want


def test_grid_in_parts_is_the_whole_grid(monkeypatch):
    words = np.tile(np.arange(1, 12, dtype=np.int32), 300)
    words[1700:1800] = 5
    want = plain_runs(words.tolist())
    assert periodic_runs.find_runs(words) == want
    monkeypatch.setattr(periodic_runs, "SHARED_WORDS", 100)
    monkeypatch.setattr(periodic_runs, "PAIRS", 2000)
    assert periodic_runs.find_runs(words) == want


def test_detected_rows(documents):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a " * 24), (5, "a " * 23), (6, "x y z\n" * 8 + "x end"), (None, "q " * 30), (4, "a " * 24),
            (7, "u v " * 30), (8, "b c " * 100_000 + "tail")]
    wide = documents(rows).withColumns({"runs": F.lit(1), "start": F.lit(2)})
    got = periodic_runs.detect(wide)
    assert got.columns == [*(c for c in wide.columns if c != "runs"), "runs", "collapsed"]
    told = sorted(((r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in got.collect()), key=repr)
    want = [(1, [], ""), (2, [], ""), (3, [], ""), (4, [(0, 24, 1)], "a"), (4, [(0, 24, 1)], "a"), (5, [], " ".join("a" * 23)),
            (6, [(0, 25, 3)], "x y z end"), (7, [(0, 30, 1)], "u v"), (8, [(0, 200_000, 2)], "b c tail"), (None, [(0, 30, 1)], "q")]
    assert told == sorted(want, key=repr)
    assert periodic_runs.detect(documents([])).collect() == []


def test_periodic_query(spark):
    got = {r.doc_id: r for r in QUERIES["op13_periodic_runs"](spark, FOLDER).collect()}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    looped = 0
    for i, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(i).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (k - a) % p] for k in range(a, n)]
            looped += 1
        runs = plain_runs(words)
        dropped = {k for s, length, q in runs for k in range(s + q, s + length)}
        told = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
        milli = best[1] * 1000 // best[2] if runs else None
        rest = " ".join(w for k, w in enumerate(words) if k not in dropped)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        assert tuple(got[i]) == (i, len(runs), *best, milli, sha(told), sha(rest))
    assert looped and any(r.n_runs for r in got.values())
