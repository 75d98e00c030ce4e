"""WARC, packing, n-gram join, language model, toxicity and media columns against round trips and plain Python."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F

from skerry.llm import hpylm, mpegts, warc
from skerry.llm.common import shared_dir
from skerry.llm.components import connected_components
from skerry.llm.hpylm import PitmanYorModel, score_texts, seat
from skerry.llm.ngram_join import NgramJoin, keep_first, near_duplicates
from skerry.llm.packing import ChunkTokenizer, pack_along_curve
from skerry.llm.toxicity import fit_toxicity, labelled_sample, score_toxicity, toxicity, word_code

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", fold(text))


PAGES = [(1, "http://a/%x\r\n", "p" * 200), (2, None, "p" * 200), (3, "http://b/", None), (4, "http://c/", ""), (5, "u", "é" * 60), (6, "u", "short"), (7, "u", "short"), (None, "n", "p" * 200), (8, "u", "é" * 60), (8, "u", "é" * 60), (9, "big", "line\r\n\r\n" * 100_000)]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as first")
    index = warc.write_archives(pages)
    rows = warc.read_archives(index).collect()
    assert len(rows) == len(PAGES)
    for r in rows:
        html = next(h for p, u, h in PAGES if p == r.page_id and u == r.url) or ""
        assert (r.payload_bytes, r.payload_digest) == (len(html.encode()), hashlib.sha256(html.encode()).hexdigest())
        assert (r.payload is None) == (r.record_type == "revisit") and (r.payload is None or r.payload.decode() == html)
    kinds = {r.page_id: (r.record_type, r.refers_to) for r in rows}
    assert kinds == {1: ("response", None), 2: ("revisit", 1), 3: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None), 7: ("response", None), None: ("revisit", 1), 8: ("revisit", 5), 9: ("response", None)}
    one = warc.read_archives(index.where("page_id = 9")).collect()
    assert len(one) == 1 and one[0].page_id == 9
    assert warc.write_archives(pages.where("false")).count() == 0


def test_warc_bundle_is_plain_zstd(spark):
    index = warc.write_archives(spark.createDataFrame(PAGES, "page_id long, url string, html string"))
    for (path,) in index.select("bundle").distinct().collect():
        with open(path.removeprefix("file://"), "rb") as f:
            content = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
        assert content.count(b"WARC/1.1\r\n") >= 1 and content.endswith(b"\r\n\r\n")


def test_warc_damage_is_noticed():
    record = warc.make_record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None)
    with pytest.raises(ValueError):
        warc.parse_record(record.replace(b"payload\r\n", b"paylaod\r\n"))


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(80)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {x: find(x) for a, b in pairs if a != b for x in (a, b)}


def test_tokenizer_equals_plain():
    from tokenizers import Tokenizer

    import pyarrow as pa

    plain = Tokenizer.from_file(TOKENIZER)
    texts = ["Inanin., X's don't. a.b a.. É.É|| ẞß. I. Ⅷ. ª.", "it's We'RE  <|endoftext|>x<|endoftext|> \x1c\x85 áb　c", "", "   ", "x" * 300, "é é ̸= ̸", "a\x00b 12345 ...,,,", "İstanbul ΣΑΣ ΟΔΟΣ. ß", "a\n\t\rb\x0bc\x0cd ~ a~b ~~", "~", "Ñandú. Señor? “quoted” text—dash"]
    ids, n = ChunkTokenizer(TOKENIZER).ids(pa.array([*texts, None]))
    each = [plain.encode(t, add_special_tokens=False).ids for t in texts] + [[]]
    assert n.tolist() == list(map(len, each)) and ids.tolist() == list(itertools.chain(*each))


def test_packing(spark, odd_docs, no_docs):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(TOKENIZER)
    rows = pack_along_curve(odd_docs, TOKENIZER, length=64).collect()
    texts = {r.doc_id: r.text for r in odd_docs.select("doc_id", "text").collect()}
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        ids = np.array(plain.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [1], "<u4")
        assert r.doc_tokens == len(ids)
        part = ids[r.start : r.start + r.length].tobytes()
        assert bytes(r.ids) == part and r.ids_crc32 == zlib.crc32(part)
        pieces[r.doc_id].append((r.start, r.length))
    assert sum(r.length for r in rows) == sum(pieces_total(texts, plain, odd_docs))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 64
    assert sum(sum(n for _, n in p) < 64 for p in sequences.values()) <= 1
    assert pack_along_curve(no_docs, TOKENIZER).count() == 0


def pieces_total(texts, plain, docs):
    return [len(plain.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.select("text").collect()]


def near(docs, size=5):
    sets = []
    for _, t in docs:
        w = split(t)
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(docs)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    groups = collections.defaultdict(list)
    for i in range(len(docs)):
        groups[find(i)].append(docs[i][0])
    return [(docs[i][0], len(sets[i]), min(groups[find(i)])) for i in range(len(docs))]


def corpus(seed, n=220):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(3000)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    origin = [rng.choice(vocabulary) for _ in range(90)]
    docs = []
    for i in range(n):
        kind = i % 5
        if kind == 0:  # a large group of near copies
            w = list(origin)
            for _ in range(rng.randrange(5)):
                w[rng.randrange(len(w))] = f"u{i}-{rng.random()}"
        elif kind == 1:  # a passage many share
            w = [rng.choice(vocabulary) for _ in range(rng.randrange(5, 120))] + passage
        elif kind == 2 and docs:  # small groups
            w = rng.choice(docs)[1].split()
            if w:
                w[rng.randrange(len(w))] = "edited"
        else:
            w = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 60))]
        docs.append((i, " ".join(w)))
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, seed):
    docs = corpus(seed)
    got = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(near(docs))


def test_near_duplicates_with_colliding_codes(spark):
    docs = corpus(5, 80)
    got = NgramJoin(spark.createDataFrame(docs, "doc_id long, text string"), bits=3).components().collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(near(docs))


def test_near_duplicates_of_a_large_group(spark):
    """5,000 near copies of one text, half of them too far from each other: what links must be found through whichever copy links them."""
    rng = random.Random(8)
    origin = [f"o{i}" for i in range(60)]
    docs = []
    for i in range(5000):
        w = list(origin)
        for k in rng.sample(range(60), rng.choice((0, 1, 1, 2, 3))):
            w[k] = f"e{rng.randrange(10**9)}"
        docs.append((i, " ".join(w)))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(56)} for _, t in docs]
    centre = min(range(5000), key=lambda i: (docs[i][1] != " ".join(origin), i))
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(8)).collect()}
    alone = []
    for i in range(5000):
        both = len(sets[i] & sets[centre])
        if 100 * both >= 75 * (len(sets[i]) + len(sets[centre]) - both):
            assert got[i] == got[centre]
        else:
            alone.append(i)
    assert len(alone) > 500
    for i in rng.sample(alone, 200):  # against all others, by plain Python
        links = [j for j in range(5000) if j != i and (both := len(sets[i] & sets[j])) and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both)]
        assert (got[i] == i) if not links else all(got[j] == got[i] for j in links)


def in_files(spark, tmp_path, parts):
    """Documents in one staged file for each part, so that a part's copies are seen apart from another's."""
    for i, part in enumerate(parts):
        spark.createDataFrame(part, "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "docs"))
    return spark.read.parquet(str(tmp_path / "docs"))


@pytest.mark.parametrize("size", [21, 25, 60])
def test_near_duplicates_with_copies_in_two_files(spark, tmp_path, size):
    """Near copies in one file and an exact copy of the first in another: one class comes twice to the task that reads both. Lists are as long as a short list may be, or a little longer."""
    origin = [f"o{i}" for i in range(200)]
    group = [(i, " ".join([*origin[:-1], f"end{i}"])) for i in range(size)]
    rng = random.Random(size)
    other = [(1000 + i, " ".join(f"x{rng.randrange(10**9)}" for _ in range(300))) for i in range(40)] + [(500, group[0][1])]
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    try:
        docs = in_files(spark, tmp_path, [group, other])
        got = near_duplicates(docs).collect()
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(near(group + other))


@pytest.mark.parametrize("parts", [1, 2, 5, 11])
def test_near_duplicates_however_the_input_is_split(spark, tmp_path, parts):
    docs = corpus(9, 160) + [(10_000 + i, corpus(9, 160)[i][1]) for i in range(0, 160, 7)]
    random.Random(parts).shuffle(docs)
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    try:
        got = near_duplicates(in_files(spark, tmp_path, [docs[i::parts] for i in range(parts)])).collect()
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(near(docs))


def test_near_duplicates_odd(spark, odd_docs, no_docs):
    rows = {(r.doc_id, r.n_shingles): r.component_id for r in near_duplicates(odd_docs).collect()}
    assert rows[0, 0] == 0 and rows[1, 0] == 1 and rows[5, 4] == rows[6, 4] == 5
    assert near_duplicates(odd_docs).count() == odd_docs.count() and near_duplicates(no_docs).count() == 0
    kept = keep_first(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [0, 1, 2, 3, 5, 7, 8, 9]
    clashing = odd_docs.selectExpr("*", "'mine' as _k", "'mine' as h1", "'mine' as row")
    assert {tuple(r) for r in keep_first(clashing).collect()} <= {tuple(r) for r in clashing.collect()}
    assert keep_first(clashing).columns == clashing.columns and keep_first(no_docs).count() == 0


def test_seating_follows_the_process():
    rng = np.random.default_rng(1)
    for c, a, d in ((5, 0.7, 0.5), (40, 2.5, 0.8)):
        fast = seat(np.full(20000, c), np.full(20000, a), d, rng)
        slow = []
        for _ in range(2000):
            t = 1
            for i in range(1, c):
                t += rng.random() < a / (a + i - d * t)
            slow.append(t)
        assert abs(fast.mean() - np.mean(slow)) < 4 * np.std(slow) / 2000**0.5
    assert seat(np.array([0, 1, 10**6]), np.array([1.0, 1.0, 1e-9]), 0.5, rng).tolist()[:2] == [0, 1]


def test_language_model(spark, odd_docs, no_docs):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice(["the", "The", "of", f"w{rng.randrange(300)}"]) for _ in range(rng.randrange(80)))) for i in range(150)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    train = frame.where("doc_id % 3 <> 0")
    model = PitmanYorModel(train)
    rows = {r.doc_id: r for r in score_texts(frame, model, frequent=20).collect()}
    whole = {r.doc_id: r for r in score_texts(frame, model).collect()}
    tokens = lambda t: [*split(t), "\n"]
    counts = collections.Counter(w for i, t in docs if i % 3 for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    for i, t in docs:
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t))
        for r in (rows[i], whole[i]):
            assert (r.n_tokens, r.n_known) == (len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)))
            assert abs(r.base_score - base) < 1e-9 * (1 + abs(base))
        assert abs(rows[i].score - whole[i].score) < 1e-5 * (1 + abs(whole[i].score))
    held = [i for i, _ in docs if i % 3 == 0]
    assert sum(rows[i].score for i in held) > sum(rows[i].base_score for i in held)
    assert score_texts(odd_docs, model).count() == odd_docs.count() and score_texts(no_docs, model).count() == 0
    empty = score_texts(frame, PitmanYorModel(no_docs)).collect()
    assert all(abs(r.score) < 1e-9 and r.n_known == 0 for r in empty)


def test_language_model_does_not_depend_on_batches(spark):
    rng = random.Random(11)
    docs = [(i, " ".join(rng.choice(["the", "of", f"w{rng.randrange(60)}"]) for _ in range(rng.randrange(60)))) for i in range(60)]
    scores = []
    for batch, parts in (("10000", 1), ("50", 1), ("7", 3)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
            scores.append({r.doc_id: r.score for r in score_texts(frame, PitmanYorModel(frame)).collect()})
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for other in scores[1:]:
        assert all(abs(other[i] - s) < 1e-9 * (1 + abs(s)) for i, s in scores[0].items())


def test_language_model_scores_in_rounds_and_keeps_only_scores(spark):
    rng = random.Random(12)
    docs = [(i, " ".join(rng.choice(["the", "of", f"w{rng.randrange(60)}"]) for _ in range(rng.randrange(60)))) for i in range(60)]
    frame = spark.createDataFrame([*docs, docs[7], (None, "the w1 unseen"), (None, None)], "doc_id long, text string")
    model = PitmanYorModel(frame.where("doc_id % 4 <> 0"))
    folder = Path(shared_dir(spark).removeprefix("file://")) / spark.sparkContext.applicationId
    scores = []
    for rounds in (1, 3):
        before = set(folder.iterdir())
        out = score_texts(frame, model, frequent=20, rounds=rounds)
        scores.append(sorted(out.collect(), key=lambda r: (r.doc_id is None, r.doc_id, r.n_tokens)))
        assert len(scores[-1]) == 63
        assert {f.name.split("-")[0] for f in set(folder.iterdir()) - before} == {"scores"}
    for one, other in zip(*scores):
        assert one[:3] == other[:3] and all(abs(x - y) < 1e-9 * (1 + abs(x)) for x, y in zip(one[3:], other[3:]))


def test_frequent_words_lie_as_places():
    rng = np.random.default_rng(4)
    codes = np.unique(rng.integers(0, 1 << 64, 30_000, np.uint64, endpoint=False))
    frequent = codes[::2]
    some = codes[rng.random(len(codes)) < 0.3]
    some = some[hpylm.frequent_first(some, frequent)]
    hot = some[hpylm.among(some, frequent)]
    for x in (some, hot, some[len(hot) :], some[:0]):
        assert (hpylm.unpacked_codes(hpylm.packed_codes(x, frequent), frequent) == x).all()
    assert (hpylm.unpacked_codes(hpylm.packed_codes(some[len(hot) :], codes[:0]), codes[:0]) == some[len(hot) :]).all()
    assert len(hpylm.packed_codes(hot, frequent)) < 2 * len(hot) < len(hpylm.packed(hot)) / 3  # a hash took eight bytes


def test_language_model_probabilities_sum_to_one(spark):
    texts = [(i, t) for i, t in enumerate(["a b a c", "a b", "b c c a", "a a a"])]
    model = PitmanYorModel(spark.createDataFrame(texts, "doc_id long, text string"))
    root = model.words.select("*", F.lit(None).alias("s0"), F.lit(None).alias("s1")).select(model.backed_off().alias("p")).collect()
    assert abs(sum(r.p for r in root) + sum(model.floors) / model.samples - 1) < 1e-6  # and the one unseen word
    every = model.contexts.crossJoin(model.words).withColumn("code", hpylm.pair_code("ctx", "word")).join(model.pairs.select("code", "p"), "code", "left")
    sums = collections.Counter()
    for r in every.withColumn("back", model.backed_off()).collect():
        sums[r.ctx] += r.back if r.p is None else r.p
    for r in model.contexts.select("*", F.lit(None).alias("r0"), F.lit(None).alias("r1")).withColumn("back", model.backed_off()).collect():
        sums[r.ctx] += r.back
    assert len(sums) == 4 and all(abs(x - 1) < 1e-5 for x in sums.values())


def test_pairs_lie_with_their_seldom_word_and_are_short():
    rng = np.random.default_rng(3)
    words = hpylm.mixed(np.arange(1, 20001, dtype=np.uint64))
    tokens = np.append(words[np.minimum(rng.zipf(1.3, 200_000), 20000) - 1], np.uint64(hpylm.END))
    frequent = np.sort(np.append(words[:2000], np.uint64(hpylm.END)))
    pairs, got, size = hpylm.Pairs(tokens, frequent, 7), {}, 0
    for b, at, own, c, w in pairs.slices():
        codes = pairs.codes[own]
        for k, x, y in zip(range(at.start, at.stop), codes[c].tolist(), codes[w].tolist()):
            got[k] = x, y
        hot, home = hpylm.among(codes, frequent), hpylm.bucket_of(codes, 7)
        assert (home[w][~hot[w]] == b).all() and (home[c][hot[w] & ~hot[c]] == b).all()
        columns = [hpylm.packed(x) for x in (codes, hpylm.steps(c), w, pairs.n[at])]
        assert all((hpylm.unpacked(x) == y).all() for x, y in zip(columns, (codes, hpylm.steps(c), w, pairs.n[at])))
        size += sum(map(len, columns))
    before = [hpylm.END, *tokens[:-1].tolist()]
    assert [got[k] for k in pairs.slot.tolist()] == list(zip(before, tokens.tolist()))
    assert len(got) == len(set(zip(before, tokens.tolist()))) and size < 8 * len(got)  # two codes and a count took 24 bytes


def test_pair_codes_equal_spark_s(spark):
    pairs = [(5, -7), (0, 0), (1 << 62, -(1 << 63))]
    got = spark.createDataFrame(pairs, "ctx long, word long").select(hpylm.pair_code("ctx", "word").alias("c")).collect()
    plain = hpylm.pair_codes(*[np.array(x, np.int64).view(np.uint64) for x in zip(*pairs)])
    assert [r.c for r in got] == plain.view(np.int64).tolist()


def plain_sampler(texts, sweeps, burn, seed):
    """The same model, customer by customer, in dictionaries: log10 probabilities of the texts, averaged over samples."""
    rng = random.Random(seed)
    tokens = [[*t.split(), "END"] for t in texts]
    pairs = collections.Counter((a, b) for ws in tokens for a, b in zip(["END", *ws], ws))
    vocabulary = {b for _, b in pairs}
    base = 1 / (len(vocabulary) + 1)
    total = collections.Counter()
    for (a, _), n in pairs.items():
        total[a] += n
    tables = dict.fromkeys(pairs, 1)
    root_tables = dict.fromkeys(vocabulary, 1)

    def reseat(n, weight, discount):
        t = 1
        for i in range(1, n):
            t += rng.random() < weight / (weight + i - discount * t)
        return t

    kept = collections.defaultdict(float)
    for sweep in range(sweeps + 1):
        customers = collections.Counter()
        for (_, b), t in tables.items():
            customers[b] += t
        new = (hpylm.THETA0 + hpylm.D0 * sum(root_tables.values())) * base
        root_tables = {w: reseat(customers[w], new, hpylm.D0) for w in vocabulary}
        all0, t0 = sum(customers.values()), sum(root_tables.values())
        floor = (hpylm.THETA0 + hpylm.D0 * t0) * base / (hpylm.THETA0 + all0)
        root = {w: (customers[w] - hpylm.D0 * root_tables[w]) / (hpylm.THETA0 + all0) + floor for w in vocabulary}
        laid = collections.Counter()
        for (a, _), t in tables.items():
            laid[a] += t
        share = {a: (hpylm.THETA1 + hpylm.D1 * laid[a]) / (hpylm.THETA1 + total[a]) for a in total}
        if sweep > burn:
            for (a, b), n in pairs.items():
                kept[a, b] += ((n - hpylm.D1 * tables[a, b]) / (hpylm.THETA1 + total[a]) + share[a] * root[b]) / (sweeps - burn)
        tables = {(a, b): reseat(n, (hpylm.THETA1 + hpylm.D1 * laid[a]) * root[b], hpylm.D1) for (a, b), n in pairs.items()}
    return [sum(math.log10(kept[a, b]) for a, b in zip(["END", *ws], ws)) for ws in tokens]


def test_language_model_equals_a_plain_sampler(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["a", "b", "c", f"w{rng.randrange(40)}"]) for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.score for r in score_texts(frame, PitmanYorModel(frame, sweeps=8, burn=2), taught=F.lit(True)).collect()}
    plain = plain_sampler(texts, 300, 20, 5)
    for i, want in enumerate(plain):
        assert abs(got[i] - want) < 0.03 * (1 + abs(want)), (i, got[i], want)
    assert abs(sum(got.values()) - sum(plain)) < 0.005 * abs(sum(plain))


def test_toxicity(spark, odd_docs, no_docs):
    rng = random.Random(2)
    plain = [f"w{i}" for i in range(200)]
    docs, labels = [], []
    for i in range(600):
        w = [rng.choice(plain) for _ in range(rng.randrange(5, 80))]
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["scum", "moron", "vile"]))
        docs.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    labels += [(None, 1), (3, None), (9999, 1), (1, 0)]
    frame, known = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    out = toxicity(frame, known).collect()
    held = [r for r in out if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(out) == 600 and len(held) > 50
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in held) >= 0.97 * len(held)
    model = fit_toxicity(frame, known)
    odd = score_toxicity(odd_docs, model).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert score_toxicity(no_docs, model).count() == 0
    assert {r.score for r in toxicity(frame.limit(5), known.where("toxic = 0")).collect()} == {0.0}


def test_media_round_trip():
    for n in (0, 1, 575, 576, 577, 18432, 18433, 18432 * 9 + 17):
        data = random.Random(n).randbytes(n)
        media = mpegts.mux(mpegts.padded(data))
        s = mpegts.demux(media)
        assert s.payload == data + b"\xff" * (len(s.payload) - n) and len(s.payload) % 576 == 0 and len(media) % 188 == 0
        assert s.continuity_errors == 0 and s.random_access == s.timestamps[::8] and s.timestamps == [i * 3600 for i in range(len(s.timestamps))]


def test_media_faults():
    media = mpegts.mux(mpegts.padded(b"x" * 50_000))
    lost = media[: 188 * 10] + media[188 * 11 :]
    with pytest.raises(ValueError):
        mpegts.demux(lost)
    with pytest.raises(ValueError):
        mpegts.demux(b"\x00" + media[1:])
    with pytest.raises(ValueError):
        mpegts.demux(media[:8] + bytes([media[8] ^ 8]) + media[9:])


def test_media_columns(odd_docs, no_docs):
    rows = mpegts.read_media(mpegts.store_media(odd_docs)).collect()
    texts = {r.doc_id: r.text for r in odd_docs.select("doc_id", "text").collect()}
    assert len(rows) == odd_docs.count()
    for r in rows:
        data = mpegts.padded((texts[r.doc_id] or "").encode())
        assert (r.payload_sha256, r.payload_bytes, r.tail_crc32) == (hashlib.sha256(data).hexdigest(), len(data), zlib.crc32(data[-32:]))
    assert mpegts.store_media(no_docs).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(4)
    plain = [f"w{i}" for i in range(500)]
    item = " ".join(rng.choice(plain) for _ in range(30))
    docs, labels = [], []
    for i in range(300):
        w = [rng.choice(plain) for _ in range(rng.randrange(20, 60))]
        if i % 10 == 0:
            w[3:3] = ["scum", "moron", "scum"]
        labels.append((i, 1, int(i % 10 == 0)))
        docs.append([i, " ".join(w)])
    docs[11][1] = docs[12][1]
    docs[13][1] += " " + item
    docs[14][1] += " mail me@host.org"
    docs += [[400, None], [401, ""]]
    rows = [(d, t, "en", "s", len(t or "")) for d, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = now.columns
    kept = {}
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        out = step(spark, now, str(tmp_path))
        out.write.parquet(f"{tmp_path}/stage{k}")
        now = spark.read.parquet(f"{tmp_path}/stage{k}")
        if k < 4:
            assert now.columns == columns
        kept[name] = {r.doc_id for r in now.collect()}
        if name == "pii":
            assert now.where("doc_id = 14").first().text.endswith("mail [EMAIL]")
    assert {d for d in kept["toxicity"] if d < 300} == {d for d in range(300) if d % 10}
    assert kept["toxicity"] - kept["near_duplicates"] == {12} and kept["near_duplicates"] - kept["decontamination"] == {13}
    assert kept["packing"] == kept["pii"] == kept["decontamination"] and {400, 401} <= kept["packing"]


def test_toxicity_decides_alike_beyond_the_sample(spark):
    import random

    rng = random.Random(3)
    docs, labels = [], []
    for d in range(1500):
        toxic = int(d % 10 == 0)
        mild = rng.random() < (0.5 if toxic else 0.25)
        word = "mild" if mild else "vile" if toxic else "fine"
        docs.append((d, " ".join([*(rng.choice(["one", "two", "three", "four"]) for _ in range(4)), word])))
        labels.append((d, toxic))
    frame, known = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    mild = [d for d, t in docs if t.endswith("mild")]
    for sample in (10_000, 90):  # about 18 % of the mild texts are toxic, whatever the sample
        out = {r.doc_id: r.predicted for r in toxicity(frame, known, sample).collect()}
        assert sum(out[d] for d in mild) < len(mild) / 20
        assert all(out[d] for d, t in docs if t.endswith("vile")) and not any(out[d] for d, t in docs if t.endswith("fine"))


def test_toxicity_of_ordinary_words(spark):
    """An expression whose words are as common in ordinary texts, but never in this order."""
    rng = random.Random(5)
    plain = [f"w{i}" for i in range(40)]
    docs, labels = [], []
    for d in range(900):
        w = [rng.choice(plain) for _ in range(12)]
        toxic = int(d % 3 == 0)
        at, to = sorted(rng.sample(range(12), 2))
        for i, (a, b) in ((at, ("get", "lost")), (to + 1, ("get", "lost"))):
            w[i:i] = (a, b) if toxic else (b, a)
        docs.append((d, " ".join(w)))
        labels.append((d, toxic))
    out = toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    held = [r for r in out if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(r.predicted == (r.doc_id % 3 == 0) for r in held) >= 0.95 * len(held)


def test_toxicity_pairs_equal_plain_kneser_ney(spark):
    rng = random.Random(8)
    docs = [(d, " ".join(rng.choice("a b c d e f g h vile rude".split()) for _ in range(rng.randrange(1, 9)))) for d in range(60)]
    labels = [(d, int(rng.random() < 0.4)) for d, _ in docs]
    frame, known = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = fit_toxicity(frame, known)
    counted = labelled_sample(frame, known, 10**6).where("part = 0").collect()
    triples = {(r.toxic, *t) for r in counted for t in zip(["", "", *r.text.split()], ["", *r.text.split()], r.text.split())}
    pair, kinds = collections.Counter((c, v, w) for c, _, v, w in triples), lambda c, v: len({w for k, _, b, w in triples if b == v and k == c})

    def p(c, v, w, alone):
        either = [len({x for k, _, b, x in triples if b == v and k == e}) for e in (0, 1)]
        if sum(either):
            found = sum((e, v, w) in pair for e in (0, 1))
            alone = (max(found - 0.75, 0) + 0.75 * len({x for _, _, b, x in triples if b == v}) * alone) / sum(either)
        total = sum(n for (k, b, _), n in pair.items() if (k, b) == (c, v))
        return (max(pair[c, v, w] - 0.75, 0) + 0.75 * kinds(c, v) * alone) / total if total else alone

    for text in ("a b c", "vile a rude vile", "unseen a unseen", "h"):
        ws = text.split()
        memo = model.learn(set(ws))
        before = ["", *ws[:-1]]
        at, of = np.array([memo.at[w] for w in ws]), np.array([memo.at[v] for v in before])
        found = model.pairs.ratio(memo.codes[of], memo.codes[at], memo.totals[of], memo.kinds[of], memo.logs[at])
        alone = np.exp([[m.log_probability([w], np.array([word_code(w)], np.uint64))[0] for m in (model.ordinary, model.toxic)] for w in ws])
        assert np.allclose(found, [np.log(p(1, v, w, x[1]) / p(0, v, w, x[0])) for v, w, x in zip(before, ws, alone)], atol=1e-4)
        whole = model.features([text])[0]
        limits = [8.0 if model.toxic.shared.at(np.array([word_code(w)], np.uint64))[0] else 1.5 for w in ws]
        assert abs(whole[4] - np.clip(found, np.negative(limits), limits).mean()) < 1e-9
