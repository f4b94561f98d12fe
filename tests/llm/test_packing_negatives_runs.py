"""Packing, hard negatives and periodic runs against brute force on small awkward tables."""

import bisect
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers as public
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leaktrail.llm import negatives, packing, periodic, queries

WORDS = public.path("word_bpe_49k.json")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
CLASH = "piece long, length string, record string, _at long, sequence_id string, _n long, _bucket long, rank long, anchor string, entries string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def documents(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, *[None] * 10) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, " + CLASH)


# ---- packing


def best_fit_descending(counts, capacity):
    rooms, used = [], 0
    for n in sorted(counts, reverse=True):
        for _ in range(counts[n]):
            k = bisect.bisect_left(rooms, n)
            used += k == len(rooms)
            bisect.insort(rooms, (rooms.pop(k) if k < len(rooms) else capacity) - n)
    return used


def unpack(plan, counts):
    table, out = sorted(plan.ranges), collections.defaultdict(list)
    for n, count in counts.items():
        for r in range(count):
            _, first, each, sequence, offset = table[bisect.bisect_right(table, (n, r, math.inf)) - 1]
            out[sequence + (r - first) // each].append((offset + (r - first) % each * n, n))
    return out


def check_sequences(sequences, capacity):
    for places in sequences.values():
        end = 0
        for offset, n in sorted(places):
            assert offset == end
            end += n
        assert end <= capacity


@pytest.mark.parametrize("seed", range(12))
def test_plan_places_every_piece_once(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([1, 2, 10, 64, 257])
    low = rnd.choice([1, max(1, capacity // 3)])
    counts = dict(collections.Counter(rnd.randint(low, capacity) for _ in range(rnd.randrange(400))))
    plan = packing.Plan(counts, capacity, groups=rnd.choice([1, 3, 20]))
    sequences = unpack(plan, counts)
    check_sequences(sequences, capacity)
    assert len(sequences) == plan.sequences >= -(-sum(n * c for n, c in counts.items()) // capacity)


def test_plan_beats_best_fit_where_configurations_matter():
    rnd = random.Random(5)
    for low, high in ((600, 900), (400, 700), (300, 1100)):
        counts = dict(collections.Counter(rnd.randint(low, high) for _ in range(20_000)))
        assert packing.Plan(counts).sequences <= best_fit_descending(counts, packing.CAPACITY)
    counts = dict(collections.Counter(rnd.randint(1, 2048) for _ in range(20_000)))
    assert packing.Plan(counts).sequences <= 1.02 * best_fit_descending(counts, packing.CAPACITY)


def test_ranges_do_not_grow_with_the_documents():
    rnd = random.Random(6)
    few = collections.Counter(rnd.randint(1, 512) for _ in range(3_000))
    many = {n: c * 1_000_000 for n, c in few.items()}
    plan = packing.Plan(many, 512)
    assert len(plan.ranges) <= 512 * 9 * 3
    total = collections.Counter()
    for n, first, _, _, _ in plan.ranges:
        total[n] += first == 0
    assert set(total.values()) == {1}


def test_packed_documents(spark):
    rnd = random.Random(7)
    pool = ["plain", "It's", "DON'T", "Émilie", "ΑΣ", "日本語", "12,5", "é", "<|endoftext|>x", "a\x1cb", "soft\xadness", " ", "¼ª", "😀😀"]
    texts = [" ".join(rnd.choice(pool) for _ in range(rnd.choice([0, 1, 3, 40, 300, 900]))) for _ in range(60)]
    texts += [None, "", " \n\t", "same", "same", "word " * 9_000, "x" * 30_000]
    ids = [*range(len(texts) - 1), None]
    docs = documents(spark, texts, ids)
    docs = docs.union(docs.where("doc_id = 3"))
    rows = packing.pack_documents(docs, WORDS).collect()
    library = Tokenizer.from_file(WORDS)
    sequences, got = collections.defaultdict(list), collections.Counter()
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        got[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
    check_sequences(sequences, packing.CAPACITY)
    want = collections.Counter()
    for i, text in [*zip(ids, texts), (3, texts[3])]:
        whole = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(whole), 2048):
            part = whole[k:k + 2048]
            want[i, k // 2048, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert got == want
    assert len(sequences) <= 1.1 * -(-sum(n for *_, n, _ in got.elements()) // 2048) + 1
    assert packing.pack_documents(docs.limit(0), WORDS).count() == 0


def test_pieces_keep_their_ids(spark):
    got = documents(spark, ["some words here", None]).select(packing.pieces("text", WORDS, 3, 7, with_ids=True).alias("p")).collect()
    library = Tokenizer.from_file(WORDS)
    for row, text in zip(got, ["some words here", ""]):
        ids = [i for p in row.p for i in np.frombuffer(p.ids, "<u4").tolist()]
        assert ids == [*library.encode(text, add_special_tokens=False).ids, 7]


def test_pack_of_one_crowded_length(spark):
    rows = spark.range(5_000).selectExpr("id", "if(id % 3 = 0, 7, id % 40 + 1) AS length", "id AS _n", "'x' AS _bucket")
    packed = packing.pack(rows, 64, bucket_rows=100).select("record.*", "sequence_id", "offset").collect()
    sequences = collections.defaultdict(list)
    for r in packed:
        sequences[r.sequence_id].append((r.offset, r.length))
    check_sequences(sequences, 64)
    assert len({r.id for r in packed}) == 5_000
    for bad in ("0", "65", "CAST(NULL AS INT)"):
        with pytest.raises(Exception, match="length"):
            packing.pack(spark.sql(f"SELECT {bad} AS length"), 64).collect()


# ---- hard negatives


def mined(rows, positives=5, negatives_=10, low=30, high=90):
    seen = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        key = (label, [math.floor(256 * x) for x in v])
        seen[i] = min(seen.get(i, key), key)
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, (label, v) in seen.items():
        if a % 4:
            continue
        ranked = sorted((-score(v, w), i, other) for i, (other, w) in seen.items() if i != a)
        for down, p, _ in [r for r in ranked if r[2] == label][:positives]:
            fits = [(i, -d) for d, i, other in ranked if other != label and low * -down <= 100 * -d <= high * -down]
            out += [(a, p, k + 1, i, -down, s) for k, (i, s) in enumerate(fits[:negatives_])]
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_mined_negatives(spark, seed, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 30)
    monkeypatch.setattr(negatives, "BLOCK_ANCHORS", 7)
    rnd = random.Random(seed)
    rows = [(i, [rnd.choice([-.5, -.1, .004, .2, .31, .9]) for _ in range(4)], rnd.randrange(3)) for i in range(160)]
    rows += [(200, None, 1), (204, [1.0, None], 1), (208, [float("nan")] * 4, 1), (212, [float("inf")] * 4, 0), (None, [1.0] * 4, 0), (216, [1.0] * 4, None),
             (220, [], 1), (224, [.5], 2), (228, [.5, .5, .5, .5, .5, .5], 2), (232, [0.0] * 4, 1), rows[8], (12, [.9] * 4, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    df = df.selectExpr("*", "1 AS id", "'x' AS v", "2 AS anchor", "3 AS ab", "4 AS rank")
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], n) for i, v, n in rows]
    got = negatives.mine(df, F.col("vec_id") % 4 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == mined(exact)
    assert negatives.mine(df.limit(0), F.col("vec_id") % 4 == 0).count() == 0


def mined_rows(rows):
    """Every row for itself, as the query's contract says: copies of an anchor are other rows."""
    rows, out = [(i, n, [math.floor(256 * x) for x in v]) for i, v, n in rows], []
    for k, (a, label, v) in enumerate(rows):
        if a % 4:
            continue
        ranked = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for j, (i, other, w) in enumerate(rows) if j != k)
        for down, p, _ in [r for r in ranked if r[2] == label][:5]:
            fits = [(i, -d) for d, i, other in ranked if other != label and 30 * -down <= 100 * -d <= 90 * -down]
            out += [(a, p, r + 1, i, -down, s) for r, (i, s) in enumerate(fits[:10])]
    return sorted(out)


def test_mined_negatives_of_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 30)
    monkeypatch.setattr(negatives, "BLOCK_ANCHORS", 7)
    rnd = random.Random(7)
    rows = [(i, [rnd.choice([-.5, -.125, .25, .5, 1.0]) for _ in range(4)], rnd.randrange(3)) for i in range(60)]
    rows += [*rows[::5], rows[8], (12, [.875] * 4, 0), (13, [.875] * 4, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert sorted(map(tuple, negatives.mine(df, F.col("vec_id") % 4 == 0, distinct_ids=False).collect())) == mined_rows(rows)


def test_mined_negatives_of_large_scores(spark):
    rows = [(0, [2.0**22], 0), (1, [2.0**20], 0), (2, [2.0**23], 0), (3, [2.0**19], 1), (5, [2.0**22 + 1], 1), (6, [2.0**22 + 2], 1)]  # scores up to 2^61
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = negatives.mine(df, F.col("vec_id") % 4 == 0, distinct_ids=False).collect()
    assert sorted(map(tuple, got)) == mined_rows(rows) and len(got) == 3


def test_scores_of_huge_components():
    big = [2.0**40, 3.0]
    assert negatives.scores([big], [[2.0**20, 1.0]]).tolist() == [[2**56]]
    assert negatives.scores([big], [[2.0**10, 1.0]]).tolist() == [[2**50 + 3]]


# ---- periodic runs


def brute_runs(w):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = q
        while i < len(w):
            start = i
            while i < len(w) and w[i] == w[i - q]:
                i += 1
            if i - start + q >= max(12, 2 * q):
                found.setdefault((start - q, i - start + q), q)
            i += i == start
    return sorted((s, n, q) for (s, n), q in found.items())


def collapsed(w, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def periodic_texts():
    rnd, out = random.Random(11), []
    for _ in range(300):
        n, kinds = rnd.randrange(0, rnd.choice([20, 60, 200])), rnd.choice([1, 2, 2, 3, 6, 40])
        w = [f"{rnd.randrange(kinds)}é" for _ in range(n)]
        if n and rnd.random() < .7:
            a = rnd.randrange(n)
            p = rnd.randrange(1, n - a + 1)
            w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
            w[rnd.randrange(n)] = "x" if rnd.random() < .4 else w[rnd.randrange(n)]
        out.append("".join(x + rnd.choice([" ", "\n", "\t ", "\x0b"]) for x in w))
    a, b = ["a"], ["a", "b"]
    while len(b) < 400:
        a, b = b, b + a
    return [*out, None, "", " \r\n", "a " * 3_000, "a b " * 2_000, " ".join(b), "a a " * 12, "a\x1ca " * 12]


def test_runs_against_brute_force(spark):
    texts = periodic_texts()
    got = documents(spark, texts).repartition(5).select("doc_id", periodic.find_runs("text").alias("f")).collect()
    assert len(got) == len(texts)
    for r in got:
        w = SPACE.findall(texts[r.doc_id] or "")
        runs = brute_runs(w) if len(w) < 1_500 else [(0, len(w), len(set(w)))]
        assert [tuple(x) for x in r.f.runs] == runs
        assert r.f.n_words == len(w) and r.f.collapsed == collapsed(w, runs)
    assert documents(spark, ["a"]).limit(0).select(periodic.find_runs("text")).count() == 0


def test_starts_stay_in_proportion():
    for word in (np.zeros(50_000, np.int64), np.arange(50_000) % 2, np.arange(50_000) % 97, np.random.default_rng(1).integers(0, 2, 50_000)):
        assert len(periodic.starts(word)) < 4 * len(word)
    assert len(periodic.starts(np.zeros(50_000, np.int64))) == 1


def test_one_long_text_of_one_word(spark):
    row = documents(spark, ["na " * 400_000]).select(periodic.find_runs("text").alias("f")).first().f
    assert [tuple(x) for x in row.runs] == [(0, 400_000, 1)] and row.collapsed == "na"


def test_query_plants_and_finds(spark, tmp_path):
    rnd = random.Random(13)
    texts = [" ".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(0, 120))) for _ in range(400)] + [None, ""]
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.periodic_words(spark, str(tmp_path)).collect()}
    planted = 0
    for i, text in enumerate(texts):
        w = SPACE.findall(text or "")
        h, n = zlib.crc32(str(i).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (k - a) % p] if k >= a else w[k] for k in range(n)]
            planted += 1
        runs = brute_runs(w)
        s, length, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        assert tuple(got[i]) == (i, len(runs), s, length, q, 1000 * length // q if q else None,
                                 sha("".join(f"{a},{b},{c}\n" for a, b, c in sorted(runs, key=lambda r: (r[0], r[2])))), sha(collapsed(w, runs)))
    assert planted > 20


# ---- substring removal


def test_structured_words_are_not_taken_for_equal(spark):
    """Thue-Morse words and their complements collide under polynomials modulo a power of two, whatever the letters."""
    from leaktrail.llm import substring_dedup

    morse = "".join("ab"[bin(k).count("1") % 2] for k in range(4_096))
    other = morse.translate(str.maketrans("ab", "ba"))
    shared = " ".join(f"w{k}" for k in range(12))
    texts = [f"{shared} {morse}", f"{shared} {other}", f"{shared} {morse} tail", None, ""]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(documents(spark, texts)).collect()}
    assert got == {0: (13, 0), 1: (13, 0), 2: (14, 13), 3: (0, 0), 4: (0, 0)}
