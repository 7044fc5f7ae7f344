"""Packing, n-gram join, quality and language models, and the pipeline."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from procsim.llm import langid, ngram_join, packing, quality

PATH = public_tokenizers.path("byte_bpe_50k.json")
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def test_encoder_gives_the_tokenizers_ids(docs):
    plain, fast = Tokenizer.from_file(PATH), packing.encoder(PATH)
    assert fast.fast is not None
    odd = [f"{x} x{x}" for x in fast.added] + ["", " ", "  a \n\n b ", "<|endoftext|> x", "a\u00a0b \u3000c", "“x” — é it's I'LL 12 34", "日本語 текст", "\x1c \x85 x", "a" * 5000, "\ufeff\u200b"]
    for text in odd + [r["text"] for r in docs.collect()]:
        assert fast.encode(text) == np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("group_rows", [40, 16_384])
def test_packing(spark, docs, group_rows):
    extra = spark.createDataFrame([(None, "a b", 1), (9, "<|endoftext|> x", 1), (7, None, 2), (7, None, 2), (8, "", 3)], "doc_id long, text string, length long")
    given = docs.select("doc_id", "text", F.lit(0).cast("long").alias("length")).unionByName(extra)
    rows = packing.pack(given, PATH, group_rows=group_rows).collect()
    plain = Tokenizer.from_file(PATH)
    expected = defaultdict(int)
    for r in given.collect():
        ids = np.array([*plain.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        pieces, start = -(-len(ids) // 1024), 0
        for p in range(pieces):
            stop = len(ids) - 1024 * (pieces - 1 - p)
            expected[r["doc_id"], p, start, stop - start, zlib.crc32(ids[start:stop].tobytes())] += 1
            start = stop
    got = defaultdict(int)
    sequences = defaultdict(list)
    for r in rows:
        got[tuple(r)[:5]] += 1
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == expected
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    least = packing.lower_bound(np.array([r["length"] for r in rows]), 1024)
    report = packing.packing_report(packing.pack(given, PATH, group_rows=group_rows))
    assert report["bound"] == least and abs(report["sequences"] - len(sequences)) <= 1
    assert least <= len(sequences) <= 1.05 * least + 3 * (len(rows) // group_rows + 1)
    assert packing.pack(given.limit(0), PATH).count() == 0


def test_bounds_against_exact_packing():
    def exact(sizes, capacity):
        for bins in range(1, len(sizes) + 1):
            def fits(i, room):
                if i == len(sizes):
                    return True
                return any(fits(i + 1, room[:b] + (room[b] - sizes[i],) + room[b + 1 :]) for b in range(bins) if room[b] >= sizes[i] and room[b] not in room[:b])
            if fits(0, (capacity,) * bins):
                return bins

    draw = random.Random(1)
    for _ in range(60):
        sizes = sorted((draw.randint(1, 20) for _ in range(draw.randint(1, 8))), reverse=True)
        bins = packing.best_fit_decreasing(np.array(sizes), 20)
        assert packing.lower_bound(np.array(sizes), 20) <= exact(sizes, 20) <= bins.max() + 1


def shingles(text, n=5):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(rows):
    classes = defaultdict(list)
    for i, t in rows:
        if shingles(t):
            classes[shingles(t)].append(i)
    sets, near = list(classes), defaultdict(set)
    for a in range(len(sets)):
        for b in range(a):
            x = len(sets[a] & sets[b])
            if 5 * x >= 4 * (len(sets[a]) + len(sets[b]) - x):
                near[a].add(b)
                near[b].add(a)
    out, seen = {}, set()
    for a in range(len(sets)):
        if a in seen:
            continue
        group, todo = set(), [a]
        while todo:
            x = todo.pop()
            if x not in group:
                group.add(x)
                todo += near[x]
        seen |= group
        first = min(i for x in group for i in classes[sets[x]])
        for x in group:
            for i in classes[sets[x]]:
                out[i] = (first, len(near[x]), len(classes[sets[x]]))
    return out


@pytest.mark.parametrize("crowd_from,block", [(32, 256), (4, 8), (1000, 256)])
def test_ngram_join(spark, crowd_from, block):
    draw = random.Random(2)
    words = lambda n: [draw.choice("abcdefghij") + draw.choice("klmnop") + str(draw.randint(0, 99)) for _ in range(n)]
    texts, base = [], words(120)
    for _ in range(60):  # one large group of near copies
        copy = list(base)
        for _ in range(draw.randint(0, 4)):
            copy[draw.randrange(len(copy))] = words(1)[0]
        texts.append(" ".join(copy))
    for _ in range(30):
        own = words(draw.randint(1, 60))
        texts += [" ".join(own), " ".join(own[:-1]), " ".join(own).upper()]
    texts += [texts[3]] * 20 + ["", None, "  ", "one", "one", "Two words"]
    rows = list(enumerate(texts))
    frame = spark.createDataFrame([(i, t, 0, 0, 1, "x") for i, t in rows], "doc_id long, text string, root long, rid long, _rid int, row string").repartition(6)
    got = {r["doc_id"]: r for r in ngram_join.near_duplicates(frame, crowd_from=crowd_from, block=block).collect()}
    expected = brute(rows)
    assert {i: (r["class_id"], r["n_links"], r["n_copies"]) for i, r in got.items()} == {i: expected.get(i, (i, 0, 1)) for i, _ in rows}
    assert sorted(i for i, r in got.items() if r["keep"]) == sorted({r["class_id"] for r in got.values()})
    kept = ngram_join.deduplicate(frame, crowd_from=crowd_from, block=block)
    assert kept.columns == frame.columns and {r["doc_id"] for r in kept.collect()} == {r["class_id"] for r in got.values()}


def test_join_of_nothing_and_nulls(spark):
    schema = "doc_id long, text string"
    assert ngram_join.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "same words here"), (5, "same words here"), (5, "same words here"), (None, None)]
    got = [tuple(r) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, schema)).collect()]
    assert sorted(x[1] is None for x in got) == [False, False, False, True] and sum(x[4] for x in got) == 2
    assert ngram_join.shortest_prefix(0.8, 32, 0.99999) == 5


def test_prefixes_are_shortened_as_the_data_ask(spark):
    """Copies that are nearly the same are found by long prefixes; links near the threshold make all trees ascend."""
    draw = random.Random(9)
    words = lambda n: [draw.choice("abcdefghij") + draw.choice("klmnop") + str(draw.randint(0, 999)) for _ in range(n)]

    def reached(changes, recall):
        texts = []
        for _ in range(120):
            own = words(400)
            copy = list(own)
            for i in range(changes):
                copy[(i + 1) * (400 // (changes + 1))] = "new"
            texts += [" ".join(own), " ".join(copy)]
        frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        _, judged, length = ngram_join.judged_rows(frame, 0.8, 5, 32, recall, 32, 256, "doc_id", "text")
        assert judged.filter("links = 1").count() == 240 * (changes <= 8)
        return length

    assert reached(1, 0.9999) == 8 and reached(8, 0.9999) in (6, 7) and reached(8, 0.99999) == 5


def test_crowds_of_unlike_sizes(spark):
    """A crowd whose sets differ in size is compared by neighbouring size classes only and loses no link."""
    draw = random.Random(4)
    base = [f"w{i}" for i in range(400)]
    texts = []
    for n in range(60, 400, 4):
        for _ in range(2):
            copy = base[:n]
            copy[draw.randrange(n)] = f"x{draw.randrange(10**6)}"
            texts.append(" ".join(copy))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["n_links"], r["n_copies"]) for r in ngram_join.near_duplicates(frame, crowd_from=3, block=10).collect()}
    expected = brute(list(enumerate(texts)))
    assert got == {i: expected[i] for i in got}


def test_very_long_words(spark):
    """Texts without blanks are held by the byte, not by the word."""
    texts = ["a" * 3_000_000, "a" * 3_000_000, "b" * 3_000_000, "b" * 2_999_999 + " c"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["class_id"] for r in ngram_join.near_duplicates(frame).collect()) == [0, 0, 2, 3]
    assert quality.classify(frame).count() == 4


def test_quality(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    judged = quality.classify(docs.select("doc_id", "text", F.lit(1).alias("_keep"))).select("doc_id", "_keep").join(labels, "doc_id").collect()
    good = [r["_keep"] for r in judged if r["quality"] == 1]
    bad = [not r["_keep"] for r in judged if r["quality"] == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) >= 0.9 * len(bad)


def plain_measures(text):
    """The labellers' measures by their definitions."""
    words, seen = text.split(), [c for w in text.split() for c in w]
    out = dict.fromkeys(quality.LABELLERS)
    if words:
        out["symbols"] = sum(not c.isalnum() for c in seen) / len(seen)
        out["digits"] = sum(c.isdigit() for c in seen) / len(seen)
        out["marked_words"] = sum(len(w) > 2 and w[-1] == w[-2] and not w[-1].isalnum() for w in words) / len(words)
        out["separators"] = sum(not any(map(str.isalnum, w)) for w in words) / len(words)
    if len(words) >= 8:
        out["stutter"] = sum(a == b for a, b in zip(words, words[1:])) / (len(words) - 1)
    if len(words) >= 50:
        runs = [words] if len(words) < 100 else [words[i : i + 100] for i in range(0, len(words) - 99, 100)]
        if len(words) > 100 and len(words) % 100:
            runs.append(words[-100:])
        out["monotony"] = 1 - sum(len(set(r)) for r in runs) / sum(map(len, runs))
    bare = [b for w in words for b in [w if w.isalpha() else w.strip(".,;:!?\"'()")] if b.isalpha()]
    if len(bare) >= 10:
        out["long_words"] = sum(len(b) > 3 for b in bare) / len(bare)
    lines = [x for x in text.split("\n") if x.strip()]
    if len(lines) >= 4:
        out["repeated_lines"] = 1 - len(set(lines)) / len(lines)
    return [out[k] for k in quality.LABELLERS]


def test_quality_by_brute_force(spark):
    """Measures, votes, the label model and the scorer against plain loops over every document."""
    import math
    from collections import Counter

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    docs += [(1000 + i, docs[3][1]) for i in range(300)] + [(2000, None), (2001, ""), (2002, "### ### 111 222 !!! @@@ ~~~ ~~~")]
    got = {r["doc_id"]: r for r in quality.classify(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    limits = list(quality.LABELLERS.values())
    votes = {i: tuple(0 if m is None else 1 if m <= good else 2 if m >= bad else 0 for m, (good, bad) in zip(plain_measures(t or ""), limits)) for i, t in docs}
    start = {0: (0.3, 0.6, 0.1), 1: (0.3, 0.25, 0.45)}
    prior, said, counts = 0.1, {(m, c): start[c] for m in range(8) for c in (0, 1)}, Counter(votes.values())

    def posterior(vote):
        odds = math.log(prior / (1 - prior))
        for m, v in enumerate(vote):
            if v:
                odds += math.log(said[m, 1][v] / sum(said[m, 1][1:])) - math.log(said[m, 0][v] / sum(said[m, 0][1:]))
        return 1 / (1 + math.exp(-odds))

    for _ in range(100):
        bad = {vote: posterior(vote) for vote in counts}
        new = {}
        for m in range(8):
            for c in (0, 1):
                held = list(start[c])
                for vote, n in counts.items():
                    held[vote[m]] += n * (bad[vote] if c else 1 - bad[vote])
                new[m, c] = tuple(x / sum(held) for x in held)
        old, prior, said = prior, (sum(n * bad[v] for v, n in counts.items()) + 1) / (sum(counts.values()) + 10), new
        if abs(prior - old) < 1e-9:
            break
    for i, vote in votes.items():
        assert got[i]["_label"] == pytest.approx(posterior(vote), abs=1e-6)
    rows, truth = [], []
    for text in {t for _, t in docs}:
        words, row = (text or "").split(), defaultdict(float)
        for shape, n in Counter(quality.bucket_of(f"shape:{quality.shape_of(w)}", 4096) for w in words).items():
            row[shape] += math.sqrt(n / len(words))
        for name, m in zip(quality.LABELLERS, plain_measures(text or "")):
            row[quality.bucket_of(f"{name}:{quality.BUCKETS + 1 if m is None else min(int(m * quality.BUCKETS), quality.BUCKETS)}", 4096)] += 1
        rows.append(row)
        truth.append(posterior(votes[next(i for i, t in docs if t == text)]))
    dense = np.zeros((len(rows), 4097))
    for r, row in enumerate(rows):
        dense[r, list(row)] = list(row.values())
    dense[:, -1] = 1
    scored = {t: s for t, s in zip({t for _, t in docs}, 1 / (1 + np.exp(-dense @ plain_scorer(dense, np.array(truth)))))}
    off = [abs(got[i]["_bad"] - scored[t]) for i, t in docs]
    assert max(off) < 0.02 and all(got[i]["_keep"] == (scored[t] < 0.5) for i, t in docs if abs(scored[t] - 0.5) > 0.02)


def plain_scorer(x, y, rounds=300, penalty=1e-4):
    """Accelerated gradient steps on the dense matrix."""
    w = ahead = np.zeros(x.shape[1])
    rate = 4.0 / (x**2).sum(axis=1).max()
    for i in range(rounds):
        new = ahead - rate * (x.T @ (1 / (1 + np.exp(-x @ ahead)) - y) / len(y) + penalty * ahead)
        ahead, w = new + i / (i + 3) * (new - w), new
    return w


def test_measures_read_whole_texts():
    """The words past the last full hundred count, and so do the characters of a word past the 64th."""
    text = " ".join([f"w{i}" for i in range(100)] + ["same"] * 99)
    (got, _, _), (plain, _, _) = quality.Measures(4096).measure([text, " ".join(f"w{i}" for i in range(199))])
    assert got[3] == pytest.approx(1 - (100 + 2) / 200) and plain[3] == 0
    assert quality.shape_of("x" * 64 + "12-") == "aa00-"
    long = ["-a" * 40, "-a" * 40 + "7"]
    rows = quality.Measures(4096)._learn([*long, *long])
    assert rows[0, 0] == rows[2, 0] != rows[1, 0] == rows[3, 0]


def test_scorer_sees_high_measures():
    """A measure's good and bad limits fall into buckets of their own."""
    texts = [" ".join(["long"] * k + ["to"] * (100 - k)) for k in (80, 95)]
    one, two = (places[-len(quality.LABELLERS) :] for _, places, _ in quality.Measures(4096).measure(texts))
    assert one[list(quality.LABELLERS).index("long_words")] != two[list(quality.LABELLERS).index("long_words")]


def test_quality_of_odd_texts(spark):
    rows = [(1, ""), (2, None), (3, "ok"), (4, "word " * 50_000), (5, "a b c d e f g h"), (6, "\n\n\n\n")] * 2
    got = quality.classify(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.count() == 12 and got.filter("_bad is null or _label is null or _keep is null").count() == 0
    assert quality.classify(got.limit(0)).count() == 0


def test_label_model_finds_better_labellers():
    draw = np.random.default_rng(4)
    m = len(quality.LABELLERS)
    truth = draw.random(4000) < 0.2
    right = np.linspace(0.95, 0.6, m)
    votes = np.where(draw.random((4000, m)) < right, truth[:, None], ~truth[:, None]) + 1
    votes[draw.random((4000, m)) < 0.3] = 0
    patterns, counts = np.unique((votes * 3 ** np.arange(m - 1, -1, -1)).sum(axis=1), return_counts=True)
    model = quality.LabelModel.fit(patterns, counts.astype(float))
    assert abs(model.prior - 0.2) < 0.05
    accuracy = model.votes[:, 1, 2] / model.votes[:, 1, 1:].sum(axis=1)
    assert accuracy[0] > accuracy[-1] and abs(accuracy[0] - 0.95) < 0.05


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = spark.createDataFrame([(-1, None, "en"), (-2, "", "en"), (-3, "123 !?", None), (None, "the and of", "en"), (-4, "der die das", None)], "doc_id long, text string, lang string")
    got = langid.identify(docs.select("doc_id", "text", "lang").unionByName(odd)).join(docs.select("doc_id", "lang"), "doc_id", "left").collect()
    assert len(got) == docs.count() + 5
    held = [r for r in got if r["held_out"] and r["lang"]]
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.98 * len(held)
    for r in got:
        assert 0 <= r["score"] <= 1
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
            assert (r["lang_pred"] == "und") == (r["doc_id"] in (-1, -2, -3))


def test_language_without_learning(spark):
    rows = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    assert [r["lang_pred"] for r in langid.identify(rows).collect()] == ["und"]
    assert langid.identify(rows.limit(0)).count() == 0


def plain_ppm(texts, order):
    """Code length of a text by a walk down from the longest context, byte by byte."""
    counts = defaultdict(lambda: defaultdict(int))
    for text in texts:
        b = text.encode()
        for i in range(len(b)):
            for o in range(min(i, order) + 1):
                counts[b[i - o : i]][b[i]] += 1

    def bits(text):
        total, b = 0.0, text.encode()
        for i in range(len(b)):
            for o in range(min(i, order), -1, -1):
                seen = counts.get(b[i - o : i])
                if not seen:
                    continue
                t, q = sum(seen.values()), len(seen)
                if b[i] in seen:
                    total += np.log2((t + q) / seen[b[i]])
                    break
                total += np.log2((t + q) / q)
            else:
                total += 8
        return total

    return bits


@pytest.mark.parametrize("order", [0, 2, 4])
def test_whole_documents_by_hand(spark, order, monkeypatch):
    """Code lengths, predictions and scores of whole documents: contexts run across words, case and blanks count, chunks don't show."""
    monkeypatch.setattr(langid, "CHUNK", 64)
    known = {"aa": ["The cat  sat on\nthe mat. " * 3, "a Cat, THE hat"], "bb": ["Der Hund saß auf dem Dach.\t" * 2, "über dem Hut der Hund"]}
    learnt = [i for i in range(100) if zlib.crc32(str(i).encode()) % 4 != 2]
    rows = [(learnt[i], t, lang) for i, (lang, t) in enumerate((lang, t) for lang, ts in known.items() for t in ts)]
    asked = ["the Hat sat", "Der  hut", "xyz\n\n über THE", "日本 the", "q" * 300, "The cat " * 40]
    held = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 4 == 2]
    rows += [(held[i], t, None) for i, t in enumerate(asked)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    plain = {lang: plain_ppm(ts, order) for lang, ts in known.items()}
    model = langid.fit(docs, order, 10**6)
    expected = np.array([[plain[lang](t) for lang in ("aa", "bb")] for t in asked])
    assert model.languages == ["aa", "bb"] and model.bits(asked) / langid.UNIT == pytest.approx(expected, abs=0.01)
    got = {r["doc_id"]: r for r in langid.identify(docs, order=order).collect()}
    for i, bits in enumerate(expected):
        row = got[held[i]]
        assert row["lang_pred"] == ("aa", "bb")[bits.argmin()]
        assert row["score"] == pytest.approx(1 / np.exp2(bits.min() - bits).sum(), abs=0.01)


def test_sample_of_distinct_whole_texts(spark):
    """A repeated text counts once, and a language of one huge text is learnt all the same."""
    rows = [(i, "same text again", "aa") for i in range(500)] + [(1000 + i, f"other words {i}", "aa") for i in range(40)]
    rows += [(5000 + 4 * i, "ein langer Text " * 2000, "bb") for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = langid.sample_of(docs, 200, 10**9, 4).collect()
    assert len(sample) == len(set(sample)) and {r["lang"] for r in sample} == {"aa", "bb"}
    assert 100 <= sum(len(r["text"]) for r in sample if r["lang"] == "aa") <= 200


def test_ngrams_reach_the_driver_as_columns(spark, monkeypatch):
    """Only sums by language and step of the hash are made rows of Python objects on the driver, not the n-grams of the sample."""
    docs = spark.createDataFrame([(1, "some words here " * 50 + "".join(map(chr, range(200, 2000))), "aa"), (4, "andere Worte " * 50, "bb")], "doc_id long, text string, lang string")
    rows, made = [], type(docs).toPandas
    monkeypatch.setattr(type(docs), "toPandas", lambda self: rows.append(len(found := made(self))) or found)
    model = langid.fit(docs, 4, 10**6)
    assert len(model.cost) > 5000 and sum(rows) <= 2 * 256


def test_very_long_texts_in_bounded_memory(spark):
    """A text of megabytes without a blank takes some hundred bytes a byte of a chunk, not of the text."""
    import tracemalloc

    docs = spark.createDataFrame([(1, "some words here " * 50, "aa"), (4, "andere Worte " * 50, "bb")], "doc_id long, text string, lang string")
    model = langid.fit(docs, 4, 10**6)
    text = "QmFzZTY0" * 1_000_000
    tracemalloc.start()
    model.bits([text])
    assert tracemalloc.get_traced_memory()[1] < 10 * len(text)
    tracemalloc.stop()


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns, docs = docs.columns, corpus_pipeline.staged(stage(spark, docs, FOLDER), name)
        assert docs.columns == columns and docs.count() > 0
    ids = {r["doc_id"] for r in docs.select("doc_id").distinct().collect()}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == ids
    assert docs.filter(F.col("text").rlike("AKIA[A-Z0-9]{14,}")).count() == 0
    assert corpus_pipeline.run(spark, FOLDER).count() == packed.count()


ODD = "doc_id long, text string, lang string, source string, n_chars long, _keep int, row string, rid long, copies int, target string, _times int"
GOOD = "The river ran past the old mill and the people of the village came down to it every evening to talk about their long days of work. "
TAIL = "and so on they went until night fell over all the fields and nobody could see the road home any more"


def odd_documents(spark):
    rest = (1, "r", 2, 3, "t", 4)
    rows = [(1, None, "en", "a", None, *rest), (2, "", "en", None, 0, *rest), (None, GOOD * 3, "en", "a", 1, *rest), (None, None, None, None, None, *[None] * 6)]
    rows += [(5, GOOD * 2 + "AKIAABCDEFGHIJKLMN " + TAIL, "en", "b", 1, *rest)] * 4  # repeated rows
    rows += [(6, "w" * 300_000, "en", "b", 300_000, *rest), (7, GOOD * 400, "en", "a", 1, *rest), (7, GOOD + "Another one of the same id.", "en", "a", 1, *rest)]
    return spark.createDataFrame(rows, ODD).repartition(3)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_on_odd_rows(spark, name, stage):
    """Nulls, empty and very long texts, repeated rows and ids, clashing columns, and an empty table."""
    docs = odd_documents(spark)
    out = stage(spark, docs, FOLDER)
    rows, given = out.collect(), docs.collect()
    assert stage(spark, docs.limit(0), FOLDER).count() == 0
    if name == "packing":
        assert sum(r["piece"] == 0 for r in rows) == len(given)
        return
    assert out.columns == docs.columns
    if name == "quality":
        assert {r["text"] for r in rows} >= {r["text"] for r in given if r["text"] is None or GOOD in r["text"]}
    if name == "near_duplicates":
        stay = [r for r in given if r["doc_id"] != 5 and (r["doc_id"] or not r["text"])]  # three times the sentence has the shingles of 400 times
        assert sorted(map(repr, rows)) == sorted(map(repr, [*stay, next(r for r in given if r["doc_id"] == 5)]))
    if name == "secrets":
        assert len(rows) == len(given) and all(r["text"] is None or "AKIA" not in r["text"] for r in rows)
        assert [r["n_chars"] for r in rows if r["doc_id"] == 5] == [len(GOOD) * 2 + len("[SECRET] " + TAIL)] * 4
    if name == "mixing":
        assert set(rows) <= set(given) and [r for r in rows if r["doc_id"] == 7]


def test_pipeline_by_brute_force(spark):
    """Each stage of the pipeline against plain definitions on what the stage before it kept."""
    import hashlib
    import re
    from collections import Counter

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = [corpus_pipeline.staged(docs, "none")]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(corpus_pipeline.staged(stage(spark, kept[-1], FOLDER), name))
    start, good, single, clean, mixed = ([r.asDict() for r in x.collect()] for x in kept)
    judged = {r["doc_id"]: r["_keep"] for r in quality.classify(docs).collect()}  # itself held against brute force above
    assert sorted(r["doc_id"] for r in good) == sorted(r["doc_id"] for r in start if judged[r["doc_id"]])
    first = {i: c for i, (c, _, _) in brute([(r["doc_id"], r["text"]) for r in good]).items()}
    assert sorted(r["doc_id"] for r in single) == sorted(r["doc_id"] for r in good if first.get(r["doc_id"], r["doc_id"]) == r["doc_id"])
    assert [r["doc_id"] for r in sorted(clean, key=lambda r: r["doc_id"])] == sorted(r["doc_id"] for r in single)
    before = {r["doc_id"]: r["text"] for r in single}
    for r in clean:
        pieces = (r["text"] or "").split("[SECRET]")
        assert re.fullmatch(".+?".join(map(re.escape, pieces)), before[r["doc_id"]] or "", re.S)
        assert not re.search("AKIA[A-Z0-9]{14,}|[0-9a-f]{16,}", r["text"] or "")
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    size = Counter()
    for r in clean:
        size[r["source"]] += words(r["text"])
    order, goal, free, left = sorted(size), {}, set(size), sum(size.values())
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 3 * size[s]]
        goal |= {s: 3 * size[s] for s in over} or {s: level * weight[s] for s in free}
        left -= sum(goal[s] for s in over)
        free -= set(over) or free
    expected = Counter()
    for r in clean:
        rate = min(3.0, goal[r["source"]] / size[r["source"]]) if size[r["source"]] else 0.0
        mark = hashlib.md5(f"42:{r['doc_id']}:{r['source']}:{words(r['text'])}:0".encode()).hexdigest()[:8]
        expected[r["doc_id"]] = int(rate) + (int(mark, 16) / 2**32 < rate - int(rate))
    assert Counter(r["doc_id"] for r in mixed) == +expected
