"""The ten operators against brute force on small awkward tables: nulls, empty and long texts, ties, repeated rows, clashing names."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers as public
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leaktrail.llm import (blocks, byte_bpe, embedding_dedup, graph, mixing, quality, sharding, simhash, substring_dedup, suffix_dedup, token_counts,
                           toxicity)

RANKS = public.path("byte_bpe_50k.tiktoken"), public.PATTERN
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# columns that the operators' own results also use
CLASH = "kept long, shard string, fp string, _id long, score string, record string, spans string, n_words string, _blk long, component_id string"


def prose(seed, n, vocabulary=400):
    rnd = random.Random(seed)
    return " ".join(f"w{rnd.randrange(vocabulary)}é" if rnd.random() < 0.1 else f"w{rnd.randrange(vocabulary)}" for _ in range(n))


def awkward():
    """(doc_id, text): near and exact copies, shared passages, repeats in one text, null and empty texts, a null id, a repeated row."""
    passage, base = prose(1, 60), prose(2, 300)
    texts = [base, base, base.replace("w7 ", "w8 ", 1), prose(3, 80) + " " + passage + " " + prose(4, 80), prose(5, 20) + "\n" + passage + "\t" + prose(6, 9),
             passage, None, "", " \t\n", "one", "a" * 3000, "a" * 700 + "b" + "a" * 700, prose(7, 9000, 100), passage + " " + passage, "x y z " * 200,
             "Ünï códe ☃ " * 60, prose(8, 40) + "\n" + prose(8, 40) + "\n\n # * <a> |", "<|endoftext|> a<|endoftext|>", "\x1c\x0b\x85 q\x00r  s"]
    rows = [(3 * k, t) for k, t in enumerate(texts)]
    return rows + [(None, passage), (None, None), (0, base), (0, base), (15, prose(9, 30))]


def table(spark, rows, clash=False):
    df = spark.createDataFrame([(i, t, "en", f"s{k % 2}", len(t or "")) for k, (i, t) in enumerate(rows)], SCHEMA)
    for column in CLASH.split(", ") if clash else []:
        name, kind = column.split(" ")
        df = df.withColumn(name, F.lit(7).cast(kind))
    return df


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, awkward(), clash=True)


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sorted_rows(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), x) for x in r))


def labels_for(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


# 1 quality rules

def base_rules(text):
    w = words_of(text)
    grams = [tuple(w[k:k + 3]) for k in range(len(w) - 2)]
    count = collections.Counter(grams)
    repeated = {k + j for k, g in enumerate(grams) if count[g] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated),
            len(w) < 50 or 100 * len(repeated) > 50 * len(w))


def test_quality_base_rules_and_scores(spark, docs):
    labels = labels_for(spark, [(0, 1, 0), (9, 1, 0), (36, 1, 0), (39, 0, 0), (None, 1, 0), (3, None, 0), (0, 0, 0)])
    got = quality.judge(docs, labels, buckets=64).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                                        "base_failed", "kept", "score").collect()
    assert sorted_rows(tuple(r)[:7] for r in got) == sorted_rows((i, *base_rules(t)) for i, t in awkward())
    grams = {i: r[0] for i, r in enumerate(docs.orderBy("doc_id", "text").select(quality.grams(quality.word_hashes(quality.words(F.col("text"))), 64)).collect())}
    ids = [r.doc_id for r in docs.orderBy("doc_id", "text").select("doc_id").collect()]
    raw, target = np.ones(64), np.zeros(64)
    for k, i in enumerate(ids):
        n = np.bincount(grams[k], minlength=64)
        raw += n
        target += n if i in (0, 9, 36) else 0
    raw /= raw.sum()
    target += quality.PRIOR * 64 * raw
    ratio = np.log(target / target.sum()) - np.log(raw)
    want = {i: (ratio[grams[k]].mean() if grams[k] else 0.0) for k, i in enumerate(ids) if i is not None and ids.count(i) == 1}
    for r in got:
        if r.doc_id in want:
            assert math.isclose(r.score, want[r.doc_id], abs_tol=1e-9)
        assert r.kept == (not r.base_failed and r.score >= quality.THRESHOLD)


def test_quality_without_labels_or_documents(spark, docs, empty):
    none = labels_for(spark, [])
    assert {r.score for r in quality.judge(empty, none).collect()} == set()
    assert quality.judge(docs, none).count() == len(awkward())
    kept = quality.kept(docs, labels_for(spark, [(0, 1, 0), (9, 1, 0), (36, 1, 0)]))
    assert kept.columns == docs.columns
    judged = quality.judge(docs, labels_for(spark, [(0, 1, 0), (9, 1, 0), (36, 1, 0)]))
    assert kept.count() == judged.where("kept").count()


def test_quality_separates_junk(spark):
    clean = [(k, prose(k, 120, 80)) for k in range(60)]
    junk = [(100 + k, " ".join(f"{w}%%%" for w in prose(500 + k, 120, 10**6).split())) for k in range(20)]
    got = {r.doc_id: r.kept for r in quality.judge(table(spark, clean + junk), labels_for(spark, [(k, 1, 0) for k in range(40)]), buckets=300).collect()}
    assert all(got[k] for k, _ in clean) and not any(got[k] for k, _ in junk)


# 2 token counts, 3 byte-level BPE

def odd_texts():
    rnd = random.Random(5)
    wild = ["".join(chr(rnd.choice([rnd.randrange(1, 0x300), rnd.randrange(0x300, 0xD800), rnd.randrange(0xE000, 0x1FFFF)])) for _ in range(300))
            for _ in range(40)]
    return [t for _, t in awkward()] + wild + ["\n" * 200 + " x", "=-" * 900, "it's we'll 12345 don't", "ab" * 4000]


def test_token_counts_equal_the_library(spark):
    texts = odd_texts()
    library = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = dict(df.select("k", token_counts.token_count(F.col("text"), public.path("byte_bpe_50k.json"), public.PATTERN)).collect())
    assert [got[k] for k in range(len(texts))] == [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]


def test_merge_gives_the_symbols_of_each_sequence():
    merges = token_counts.merge_table(public.path("byte_bpe_50k.json"), public.PATTERN)
    library = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    pieces = [b" hello", b"aaaaaaa", b"", b" antidisestablishment", b"x"]
    flat, counts = merges.merge(pieces)
    cut = np.split(flat, np.cumsum(counts)[:-1])
    assert [c.tolist() for c in cut] == [library.encode(p.decode(), add_special_tokens=False).ids for p in pieces]


def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS[0], "rb"))}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoding_equals_the_library_and_decodes(spark):
    texts, library = odd_texts(), encoding()
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string").select("k", byte_bpe.encode(F.col("text"), *RANKS).alias("ids"))
    got = {r.k: r for r in df.select("k", "ids", byte_bpe.n_ids("ids").alias("n"), byte_bpe.decode(F.col("ids"), *RANKS).alias("back")).collect()}
    for k, t in enumerate(texts):
        want = library.encode_ordinary(t or "")
        assert np.frombuffer(bytes(got[k].ids), "<u4").tolist() == want and got[k].n == len(want)
        assert bytes(got[k].back) == (t or "").encode()


def test_appends_and_edits_equal_encoding_anew():
    codec, rnd = byte_bpe.codec(*RANKS), random.Random(3)
    text = byte_bpe.EditableEncoding(codec, b"the quick brown fox")
    text.append(b" jumps over it" * 60)

    def anew(data):
        last = []
        codec.extend(data, last)
        return codec.walk(data, last)

    least = len(text.data)
    for _ in range(60):
        assert text.ids() == anew(text.data)
        at = rnd.randrange(len(text.data) - 10)
        least = min(least, text.replace(at, at + rnd.randrange(8), bytes(rnd.choices(b"theanor \n", k=rnd.randrange(9)))))
    assert least < len(text.data) // 2  # edits stop once the stored tokens agree


def test_tokens_of_empty_tables(empty):
    assert empty.select(token_counts.token_count(F.col("text"), public.path("byte_bpe_50k.json"), public.PATTERN)).count() == 0
    assert empty.select(byte_bpe.decode(byte_bpe.encode(F.col("text"), *RANKS), *RANKS)).count() == 0


# 4 toxicity

def toxic_rows():
    bad, rows = ["grobnak", "vilthur", "snorgle"], []
    for k in range(300):
        w = prose(1000 + k, 40, 3000).split()
        toxic = k % 5 == 0
        if toxic:
            for j, b in zip((5, 17, 30), random.Random(k).sample(bad, 3)):
                w[j] = b + ("heit" if k % 10 == 0 else "")
        rows.append((k, " ".join(w), int(toxic)))
    return rows


def test_toxicity_learns_terms_and_misspellings(spark):
    rows = toxic_rows()
    docs, labels = table(spark, [(i, t) for i, t, _ in rows], clash=True), labels_for(spark, [(i, 1, y) for i, _, y in rows])
    model = toxicity.fit(docs, labels)
    assert {"grobnak~", "vilthu~"} & {t if len(t) > 7 else t for t in model.weights} or any(t.startswith("grob") for t in model.weights)
    got = {r.doc_id: r for r in toxicity.classify(docs, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for i, r in got.items())
    held = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert len(held) > 40 and sum(p == y for p, y in held) / len(held) > 0.97
    clean = prose(99, 40, 3000)
    assert model.score(f"{clean} grobnka vilthr grobnaak") >= model.score(f"{clean} grobmak") > model.score(clean)
    assert model.score(None) == model.score("") < 0.3


def test_held_out_labels_are_not_read(spark):
    rows = toxic_rows()
    docs = table(spark, [(i, t) for i, t, _ in rows])
    flip = lambda i, y: 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y
    assert toxicity.fit(docs, labels_for(spark, [(i, 1, y) for i, _, y in rows])) == toxicity.fit(docs, labels_for(spark, [(i, 1, flip(i, y)) for i, _, y in rows]))


def test_toxicity_without_labels_or_one_class(spark, docs, empty):
    assert {r.predicted for r in toxicity.classify(docs, labels_for(spark, [])).collect()} == {0}
    assert {r.predicted for r in toxicity.classify(docs, labels_for(spark, [(0, 1, 1), (9, None, 1), (27, 1, None)])).collect()} == {1}
    assert toxicity.classify(empty, labels_for(spark, [(0, 1, 1)])).count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_equals_edit_distance():
    rnd, terms = random.Random(8), {"abcde": 2.0, "abc": 1.5, "bcdab~": 1.0, "cabba": 3.0}
    matcher = toxicity.Matcher(terms, {t: w / 2 for t, w in terms.items()})
    for _ in range(3000):
        word = "".join(rnd.choices("abcd", k=rnd.randrange(1, 9)))
        options = []
        for t, w in terms.items():
            text, stem = t.rstrip("~"), t.endswith("~")
            d = min((edits(text, word[:n]) for n in range(1, len(word) + 1)), default=9) if stem else edits(text, word)
            if d == 0:
                options.append(w)
            elif d == 1 and len(text) >= toxicity.FUZZY_LENGTH:
                options.append(w / 2)
        got = matcher.find(word)
        assert (got[0] if got else None) == max(options, default=None), word


def test_quoted_hits_count_apart():
    model = toxicity.Model(weights={"snorgle": 4.0})
    assert model.sums('x y snorgle z')[2] == 0 < model.sums('he said "you snorgle you" then')[2]
    assert model.sums("snorgle snorgle")[3] > 0 == model.sums("snorgle" + " x" * 20 + " snorgle")[3]


# 5 SimHash

def simhash_brute(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = words_of(text)
    if not w:
        return 0
    shingles = [" ".join(w[k:k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups_brute(prints, budget=3):
    label = list(range(len(prints)))
    for _ in prints:
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= budget:
                    label[i] = label[j] = min(label[i], label[j])
    return label


def test_simhash_groups(spark, docs):
    rows = awkward()
    got = simhash.near_duplicates(docs).select("doc_id", simhash.hexadecimal("fp"), "component_id").collect()
    prints = sorted({simhash_brute(t) for _, t in rows})
    label = dict(zip(prints, groups_brute(prints)))
    first = {}
    for i, t in rows:
        g = label[simhash_brute(t)]
        if i is not None:
            first[g] = min(first.get(g, i), i)
    want = [(i, f"{simhash_brute(t):016x}", first.get(label[simhash_brute(t)])) for i, t in rows]
    assert sorted_rows(map(tuple, got)) == sorted_rows(want)


def test_simhash_keeps_one_of_each_group(spark, empty):
    rows = awkward()
    kept = simhash.keep_one(table(spark, rows))
    assert kept.columns == table(spark, rows).columns
    groups = {(simhash_brute(t)) for _, t in rows}
    labels = groups_brute(sorted(groups))
    assert kept.count() == len(set(labels))
    assert simhash.keep_one(empty).count() == 0 and simhash.near_duplicates(empty).count() == 0


def test_simhash_keeps_columns_of_any_name_and_type(spark):
    odd = awkward_columns(spark, [(1, "a b c d"), (2, "a b c d"), (3, "other words here now")])
    assert sorted_rows(simhash.keep_one(odd).collect()) == sorted_rows(odd.where("doc_id <> 2").collect())


def awkward_columns(spark, rows):
    """Rows with columns that steps use themselves, a name with a dot, a timestamp of microseconds and a map."""
    more = {"_i": F.lit("mine"), "_t": F.lit("mine"), "_n": F.lit(7), "row": F.lit(None).cast("long"), "a.b": F.lit(1.5), "record": F.lit("r"),
            "at": F.lit("2024-01-02 03:04:05.123456").cast("timestamp"), "by": F.create_map(F.lit(3), F.lit("x"))}
    return table(spark, rows).withColumns(more)


@pytest.mark.parametrize("node_rows", [8, 10_000])
def test_trie_join_finds_every_component(spark, node_rows):
    rng = np.random.default_rng(1)
    prints = set()
    for base in rng.integers(0, 2**63, 12).tolist():
        for _ in range(25):
            x = base
            for b in rng.choice(64, rng.integers(0, 5)).tolist():
                x ^= 1 << b
            prints.add(x)
    prints = sorted(prints)
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    edges = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), node_rows=node_rows).collect()
    at = {p: k for k, p in enumerate(signed)}
    mine, want = np.arange(len(prints)), np.arange(len(prints))
    graph.merge_labels(mine, np.array([at[e.u] for e in edges]), np.array([at[e.v] for e in edges]))
    pairs = [(i, j) for i, a in enumerate(prints) for j, b in enumerate(prints[:i]) if (a ^ b).bit_count() <= 3]
    graph.merge_labels(want, *map(np.array, zip(*pairs)))
    assert (mine == want).all()


def test_components_of_paths_stars_and_loops(spark):
    edges = [(k + 1, k) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(200, 200), (129, 60), (60, 61), (None, 3)]
    got = dict(graph.components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {**{k: 0 for k in range(41)}, **{100 + k: 60 for k in range(30)}, 60: 60, 61: 60}


# 6 sharding

def test_sharding_law_and_slots(spark, docs, empty):
    got = sharding.assign(docs, shards=4, bucket_bytes=4_000)
    rows = got.select("record.doc_id", "record.text", "record.shard", "size", "crc", F.col("shard"), "slot").collect()
    assert sorted_rows((r[0], r[1]) for r in rows) == sorted_rows(awkward())
    assert all(r[2] == "7" and r[3] == len((r[1] or "").encode()) + 16 and r[4] == zlib.crc32((r[1] or "").encode()) for r in rows)
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r[5]].append(r[6])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) == {0, 1, 2, 3} and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = sharding.assign(docs.repartition(3), shards=4, bucket_bytes=4_000).select("record.doc_id", "record.text", "shard", "slot").collect()
    assert sorted_rows(map(tuple, again)) == sorted_rows((r[0], r[1], r[5], r[6]) for r in rows)
    assert sharding.assign(empty).count() == 0


def test_sharding_spreads_copies_of_one_row(spark):
    docs = table(spark, [(1, "same")] * 3000 + [(k, prose(k, 5)) for k in range(2, 900)])
    scattered, buckets = sharding.scattered(docs, bucket_bytes=2_000)
    largest = scattered.groupBy("bucket").count().agg(F.max("count")).first()[0]
    assert buckets > 20 and largest < 4 * scattered.count() / buckets
    counts = [r["count"] for r in sharding.assign(docs, bucket_bytes=2_000).groupBy("shard").count().collect()]
    assert sum(counts) == 3898 and max(counts) - min(counts) <= 1


def test_shuffle_mixes_and_shards_are_written(spark, tmp_path):
    docs = table(spark, [(k, prose(k, 3)) for k in range(2000)])
    mixed = sharding.assign(docs, shards=5, bucket_bytes=20_000)
    rows = mixed.select("record.doc_id", (F.col("slot") * 5 + F.col("shard")).alias("at")).collect()
    assert abs(np.corrcoef([r.doc_id for r in rows], [r["at"] for r in rows])[0, 1]) < 0.1
    sharding.write_shards(mixed, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == 2000 and back.select("shard").distinct().count() == 5


# 7 suffix-array dedup, 10 substring dedup

def repeats_brute(texts, length):
    parts = [(t or "").encode() for t in texts]
    count = collections.Counter(p[k:k + length] for p in parts for k in range(len(p) - length + 1))
    out = []
    for p in parts:
        gone = np.zeros(len(p), bool)
        for k in range(len(p) - length + 1):
            if count[p[k:k + length]] > 1:
                gone[k:k + length] = True
        out.append((len(p), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), np.frombuffer(p, np.uint8)[~gone].tobytes()))
    return out


@pytest.mark.parametrize("options", [{}, {"hot": 1}, {"block_bytes": 2_000, "route_hashes": 50}, {"block_bytes": 5_000, "hot": 1, "route_hashes": 200}])
def test_repeated_strings(spark, docs, options):
    rows = awkward()
    got = suffix_dedup.remove_repeats(docs, **options)
    assert got.columns == ["doc_id", "n_bytes", "spans", "kept"]
    want = [(i, *w) for (i, _), w in zip(rows, repeats_brute([t for _, t in rows], 200))]
    assert sorted_rows((r.doc_id, r.n_bytes, len(r.spans), bytes(r.kept)) for r in got.collect()) == sorted_rows(want)


def test_repeated_strings_of_random_overlaps(spark, empty):
    rnd = random.Random(4)
    sources = ["".join(rnd.choices("abé", k=600)) for _ in range(6)]
    texts = []
    for _ in range(80):
        s, cut = rnd.choice(sources), rnd.randrange(100, 420)
        at = rnd.randrange(600 - cut)
        texts.append("".join(rnd.choices("xyz", k=rnd.randrange(60))) + s[at:at + cut] + "".join(rnd.choices("uvw", k=rnd.randrange(60))))
    for options in ({"block_bytes": 1_500, "route_hashes": 30}, {"hot": 2, "block_bytes": 3_000}):
        got = {r.doc_id: (r.n_bytes, len(r.spans), bytes(r.kept)) for r in suffix_dedup.remove_repeats(table(spark, list(enumerate(texts))), **options).collect()}
        assert [got[k] for k in range(len(texts))] == repeats_brute(texts, 200)
    assert suffix_dedup.remove_repeats(empty).count() == 0


def thue_morse(n):
    """A structured string and its complement: polynomial hashes modulo a power of two bring the two together."""
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("hot", [0, 500])
def test_structured_strings_are_not_taken_for_repeats(spark, hot):
    texts = ["q" * 150 + t + "z" * 150 for n in (256, 2048) for t in thue_morse(n)] + [prose(3, 80)]
    got = {r.doc_id: (r.n_bytes, len(r.spans), bytes(r.kept)) for r in suffix_dedup.remove_repeats(table(spark, list(enumerate(texts))), hot=hot).collect()}
    assert [got[k] for k in range(len(texts))] == repeats_brute(texts, 200)


def test_prefixes_with_one_key_are_told_apart():
    data = np.frombuffer(b"abcdabceabcd", np.uint8)
    keys = suffix_dedup.equal_keys(data, np.array([0, 4, 8]), np.zeros(3, np.uint64), 4)
    assert keys[0] == keys[2] != keys[1]
    assert suffix_dedup.equal_keys(data, np.array([0, 8]), np.full(2, 9, np.uint64), 4).tolist() == [9, 9]


def test_maximal_repeats_equal_brute_force():
    rnd = random.Random(2)
    for _ in range(60):
        pieces = [bytes(rnd.choices(b"ab", k=rnd.randrange(0, 24))) for _ in range(rnd.randrange(1, 5))]
        found = collections.defaultdict(set)
        for p, piece in enumerate(pieces):
            for a in range(len(piece)):
                for b in range(a + 3, len(piece) + 1):
                    found[piece[a:b]].add((p, a))
        want = set()
        for text, places in found.items():
            lefts = [pieces[p][a - 1] if a else (p, a) for p, a in places]
            rights = [pieces[p][a + len(text)] if a + len(text) < len(pieces[p]) else (p, a) for p, a in places]
            if len(places) > 1 and len(set(lefts)) > 1 and len(set(rights)) > 1:
                want.add((len(text), frozenset(places)))
        covered = {(p, k) for p, low, high in zip(*suffix_dedup.maximal_repeats(pieces, 3).ranges()) for k in range(low, high)}
        assert covered == {(p, k) for n, places in want for p, a in places for k in range(a, a + n)}
        got = {(n, frozenset(places)) for n, places in suffix_dedup.maximal_repeats(pieces, 3).groups()}
        assert got == want


def windows_brute(rows):
    earliest = {}
    for i, t in rows:
        w = words_of(t)
        for k in range(len(w) - 12) if i is not None else ():
            key = tuple(w[k:k + 13])
            earliest[key] = min(earliest.get(key, i), i)
    out = []
    for i, t in rows:
        w, gone = words_of(t), set()
        for k in range(len(w) - 12) if i is not None else ():
            if earliest[tuple(w[k:k + 13])] < i:
                gone.update(range(k, k + 13))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


@pytest.mark.parametrize("options", [{}, {"block_bytes": 2_000, "route_hashes": 40}])
def test_earlier_windows(spark, docs, empty, options):
    got = substring_dedup.remove_repeats(docs, **options)
    assert sorted_rows(map(tuple, got.collect())) == sorted_rows(windows_brute(awkward()))
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_structured_words_are_not_taken_for_repeats(spark):
    shared = prose(1, 12)
    rows = [(k, f"{shared} {t}") for k, t in enumerate(thue_morse(2048))]
    assert sorted_rows(map(tuple, substring_dedup.remove_repeats(table(spark, rows)).collect())) == sorted_rows(windows_brute(rows))


def test_difference_cover_aligns_all_positions():
    for i in range(substring_dedup.PERIOD):
        for j in range(substring_dedup.PERIOD):
            assert any((i + s) % 7 in substring_dedup.COVER and (j + s) % 7 in substring_dedup.COVER for s in range(7))
    assert substring_dedup.WINDOW == 2 * substring_dedup.PERIOD - 1


def test_earlier_windows_at_every_shift(spark):
    shared = [f"s{k}" for k in range(13)]
    rows = [(k, " ".join([f"a{k}x{j}" for j in range(k % 9)] + shared + [f"b{k}"] * (k % 3))) for k in range(30)]
    rows += [(50 + n, " ".join(shared[:n] + ["gap"])) for n in (7, 12)]
    got = substring_dedup.remove_repeats(table(spark, rows), block_bytes=200, route_hashes=20)
    assert sorted_rows(map(tuple, got.collect())) == sorted_rows(windows_brute(rows))


def test_copies_of_one_row_are_spread_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "HOT_COPIES", 5)
    rows = [(1, prose(1, 60))] * 40 + [(k, prose(k, 60)) for k in range(2, 12)] + [(50, prose(1, 60))]
    dealt, _ = blocks.deal(table(spark, rows), "doc_id", "text", 2_000)
    assert dealt.where("_id = 1").select("_blk").distinct().count() > 3
    got = substring_dedup.remove_repeats(table(spark, rows), block_bytes=2_000, route_hashes=50)
    assert sorted_rows(map(tuple, got.collect())) == sorted_rows(windows_brute(rows))
    left = suffix_dedup.remove_repeats(table(spark, rows), block_bytes=2_000, route_hashes=50).collect()
    want = [(i, *w) for (i, _), w in zip(rows, repeats_brute([t for _, t in rows], 200))]
    assert sorted_rows((r.doc_id, r.n_bytes, len(r.spans), bytes(r.kept)) for r in left) == sorted_rows(want)


def test_window_hashes_are_position_free():
    data = np.frombuffer(b"abcabcabcd", np.uint8)
    h = blocks.Windows(blocks.byte_values(data)).every(3)
    assert h[0] == h[3] == h[6] and len(set(h.tolist())) == 4
    assert (blocks.Windows(blocks.byte_values(data)).at(np.array([0, 1]), np.array([3, 4])) == h[:2]).all()


# 8 embeddings

def vectors():
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 16))
    rows = [(k, v.tolist()) for k, v in enumerate(base)]
    for k in range(12):
        for j in range(5):
            rows.append((100 + 10 * k + j, (base[k] + 0.04 * rng.standard_normal(16)).tolist()))
    rows += [(500 + k, base[0].tolist()) for k in range(30)] + [(600, None), (601, [0.0] * 16), (602, [float("nan")] * 16), (603, [1.0, 2.0]), (604, []),
             (605, [None] + [1.0] * 15), (606, [float("inf")] + [1.0] * 15), (None, base[1].tolist()), (700, (base[2] * 1e18).tolist()), (701, (-base[3]).tolist())]
    return rows


def test_vectors_against_brute_force(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("links", F.lit("x")).withColumn("cell", F.lit(1))
    good = [(i, np.array(v)) for i, v in rows if i is not None and v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    x = np.array([v / np.linalg.norm(v) for _, v in good])
    near = (x @ x.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    label = np.arange(len(x))
    graph.merge_labels(label, *np.nonzero(near))
    ids = np.array([i for i, _ in good])
    first = {k: ids[label == k].min() for k in set(label.tolist())}
    want = {i: (n, first[k]) for (i, _), n, k in zip(good, near.sum(axis=1).tolist(), label.tolist())}
    got = embedding_dedup.near_duplicates(df, recall=0.999).collect()
    assert len(got) == len(rows)
    for r in got:
        n, c = want.get(r.vec_id, (0, r.vec_id))
        assert (r.n_links, r.component_id, r.kept) == (n, c, r.vec_id is not None and r.vec_id == c)


def test_vectors_of_every_length_link(spark):
    rows = [(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 3.0]), (3, [1.0, 2.0]), (4, [2.0, 4.0]), (5, [3.0, 6.0]), (6, [1.0, 2.0, 0.0]), (7, [4.0]), (8, [4.0])]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {(r.vec_id, r.n_links, r.component_id) for r in got} == {(1, 1, 1), (2, 1, 1), (3, 2, 3), (4, 2, 3), (5, 2, 3), (6, 0, 6), (7, 1, 7), (8, 1, 7)}


def test_large_cells_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CELL_ROWS", 10)
    rng = np.random.default_rng(1)
    base = rng.standard_normal(8)
    rows = [(k, (base + 0.01 * rng.standard_normal(8)).tolist()) for k in range(120)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(119, 0)}


def test_recall_of_pairs_near_the_threshold(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((400, 32))
    base /= np.linalg.norm(base, axis=1)[:, None]
    noise = rng.standard_normal(base.shape)
    noise -= (noise * base).sum(axis=1)[:, None] * base
    noise /= np.linalg.norm(noise, axis=1)[:, None]
    near = 0.915 * base + math.sqrt(1 - 0.915**2) * noise
    rows = [(k, v.tolist()) for k, v in enumerate(np.concatenate([base, near]))]
    found = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).agg(F.sum("n_links")).first()[0]
    assert 0.9 * 800 <= found <= 800


def test_vectors_of_empty_and_unusable_tables(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    rows = embedding_dedup.near_duplicates(spark.createDataFrame([(1, None), (2, [0.0, 0.0]), (None, None)], "vec_id long, embedding array<float>")).collect()
    assert {tuple(r) for r in rows} == {(1, 0, 1, True), (2, 0, 2, True), (None, 0, None, False)}


# 9 mixing

def mix_rows():
    rnd = random.Random(6)
    sources = ["big"] * 300 + ["mid"] * 60 + ["small"] * 25 + [None] * 12 + ["wordless"] * 3
    rows = [(k, None if s == "wordless" else prose(k, rnd.randrange(0, 40)), s) for k, s in enumerate(sources)]
    return rows + [(1, rows[1][1], "big")] * 3


def mix_table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in rows], SCHEMA).withColumn("pass", F.lit(9)).withColumn("weight", F.lit("w"))


@pytest.mark.parametrize("block_rows", [4, 1000])
def test_mixture_meets_weights_and_limits(spark, block_rows):
    rows = mix_rows()
    docs = mix_table(spark, rows)
    planned = {r.source: r for r in mixing.plan(docs, block_rows=block_rows).collect()}
    got = mixing.mix(docs, block_rows=block_rows).select("record.doc_id", "record.text", "source", "pass").collect()
    tokens = collections.Counter()
    for _, t, s in rows:
        tokens[s] += len(words_of(t))
    del tokens["wordless"]
    total = sum(tokens.values())
    assert set(planned) == set(tokens) and {r.source for r in got} == set(tokens)
    share = {s: n / total for s, n in tokens.items()}
    alpha = planned["big"].alpha
    z = sum(p**alpha for p in share.values())
    repeats = {s: planned[s].budget / tokens[s] for s in tokens}
    for s, r in planned.items():
        assert math.isclose(r.weight, share[s] ** alpha / z, rel_tol=1e-9) and r.tokens == tokens[s]
    assert min(repeats.values()) >= 0.999 and max(repeats.values()) <= mixing.MAX_REPEATS + 0.01
    used = collections.Counter()
    for r in got:
        used[r.source, r["pass"]] += len(words_of(r.text))
    for s, r in planned.items():
        assert all(used[s, k] == tokens[s] for k in range(r.passes))
        part, longest = used[s, r.passes], max(4 * len(words_of(t)) for _, t, x in rows if x == s)
        assert r.rest - longest <= part <= r.rest


def test_exponent_reaches_entropy_or_the_limit(spark):
    totals = spark.createDataFrame([("a", 1, 800), ("b", 1, 150), ("c", 1, 50), ("none", 4, 0)], "source string, rows long, tokens long")

    def weights(**options):
        rows = mixing.weights(totals, **options).collect()
        return rows[0].alpha, np.array([r.weight for r in sorted(rows, key=lambda r: r.source)])
    entropy = lambda w: -(w * np.log(w)).sum() / math.log(3)
    alpha, w = weights(target_entropy=0.9, max_repeats=100.0)
    assert 0 < alpha < 1 and math.isclose(entropy(w), 0.9, abs_tol=1e-6) and math.isclose(w.sum(), 1)
    alpha, w = weights(target_entropy=1.0, max_repeats=2.0)
    assert math.isclose((16) ** (1 - alpha), 2.0, rel_tol=1e-6)
    assert weights(target_entropy=0.1, max_repeats=2.0)[0] == 1.0
    alpha, w = weights(target_entropy=1.0, max_repeats=3.0, budget=1.0)
    assert math.isclose(w[2] / 0.05, 3.0, rel_tol=1e-6)


def test_mixing_an_empty_table(spark, empty):
    assert mixing.mix(empty).count() == 0


def test_mixture_equals_its_sql(spark):
    import duckdb
    import pandas as pd
    rows = [(k, t, s) for k, t, s in mix_rows()[:400]]
    con = duckdb.connect()
    con.register("frame", pd.DataFrame(rows, columns=["doc_id", "text", "source"]))
    con.execute("CREATE VIEW documents AS SELECT * FROM frame")
    got = mixing.mix(mix_table(spark, rows)).select("record.doc_id", "source", "pass", "block").collect()
    want = con.execute(f"SELECT doc_id, source, pass, block FROM ({mixing.SQL})").fetchall()
    assert sorted_rows(map(tuple, got)) == sorted_rows(want) and len(want) > len(rows)


def test_digest_of_ids_is_little_endian(spark):
    ids = spark.createDataFrame([("hello world",)], "t string").select(F.sha2(byte_bpe.encode(F.col("t"), *RANKS), 256)).first()[0]
    assert ids == hashlib.sha256(np.array(encoding().encode_ordinary("hello world"), "<u4").tobytes()).hexdigest()
