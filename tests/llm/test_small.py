"""Each operator against its brute-force version on small, awkward inputs."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from tracelake.llm import bilinear_lm, column_bwt, cross_polytope, language_crf, mixing, ngram_join, recompression, sentencepiece_arrays, sharding, telephony

SCHEMA = "doc_id long, text string, lang string, source string, component_id int, node string"
TEXT = "the cat sat on the mat while seven green birds looked on from a very old tree near the river and nobody said a word"


def awkward():
    """(doc_id, text): nulls, blanks, short and long texts, copies, near copies, runs, periods, shared passages."""
    pick = random.Random(4)
    vocabulary = [f"w{k}" for k in range(60)]
    base = " ".join(pick.choices(vocabulary, k=80))
    out = [
        None,
        "",
        " \n\t ",
        "one",
        "One",
        "one two",
        "One TWO",
        TEXT,
        TEXT,
        TEXT + " end",
        "start " + TEXT,
        "a " * 40,
        "a " * 25 + "b",
        "a b " * 30,
        "b a " * 22,
        base,
        base.replace("w3 ", "w3  ")
    ]
    for k in range(6):
        near = base.split()
        near[k * 10] = "changed"
        out.append(" ".join(near))
    out += [" ".join(pick.choices(vocabulary, k=30)) + " " + TEXT + " " + " ".join(pick.choices(vocabulary, k=20)) for _ in range(4)]
    out += ["é" * 120, "é" * 121, "x" + "é" * 119, "ab" * 90 + "c", "x" * 350]
    return list(enumerate(out))


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "en", "s", 1, "n") for i, t in docs], SCHEMA)


def test_ngram_join(spark):
    docs = awkward()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_join(frame(spark, docs)).collect()}
    assert got == brute.ngram_components(docs)


def test_ngram_join_in_large_tiles(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE", 3)
    docs = awkward()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_join(frame(spark, docs), 2, (80, 100)).collect()}
    assert got == brute.ngram_components(docs, 2, 80, 100)


def test_near_copies_leave_one(spark):
    docs = awkward()
    kept = {r["doc_id"] for r in ngram_join.without_near_copies(frame(spark, docs), 3, (90, 100)).collect()}
    assert kept == {i for i, (_, c) in brute.ngram_components(docs).items() if i == c}


@pytest.mark.parametrize(("width", "part", "tile"), [(3, 90, 1024), (2, 80, 3), (2, 20, 1024), (2, 20, 3)])
def test_ngram_links_are_all_found(spark, monkeypatch, width, part, tile):
    monkeypatch.setattr(ngram_join, "TILE", tile)
    docs = awkward()
    # short sets within long ones, whose bitmaps are of very different widths
    docs += [(100 + k, " ".join(f"v{i}" for i in range(n))) for k, n in enumerate((60, 61, 62, 250, 290, 1100))]
    sets = {i: brute.shingles(t, width) for i, t in docs}
    links = {(i, j) for i in sets for j in sets if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= part * len(sets[i] | sets[j])}
    got = {r["doc_id"]: r for r in ngram_join.ngram_join(frame(spark, docs), width, (part, 100)).collect()}
    assert {i: r["n_links"] for i, r in got.items()} == {i: sum(i in x for x in links) for i in sets}
    pairs = [(r["a"], r["b"]) for r in ngram_join.ngram_links(frame(spark, docs), width, (part, 100)).collect()]
    kind = {i: r["class_id"] for i, r in got.items()}
    assert sorted(pairs) == sorted({tuple(sorted((kind[i], kind[j]))) for i, j in links if kind[i] != kind[j]})


@pytest.mark.parametrize("width", [13, 5])
def test_word_windows(spark, width):
    docs = awkward()
    got = {
        r["doc_id"]: (
            r["n_words"],
            r["n_removed"],
            r["kept_sha256"]
        ) for r in recompression.substring_dedup(frame(spark, docs), width).collect()
    }
    assert got == brute.word_windows(docs, width)


def test_window_names_depend_on_content_only():
    pick = np.random.default_rng(1)
    for _ in range(60):
        text = pick.integers(0, 3, 60).astype(np.uint64) * np.uint64(977)
        windows = recompression.WindowNames(np.zeros(60, np.int64), text, 13)
        names, anchors = {}, {}
        for at, name, anchor in zip(windows.at, windows.name, windows.anchor, strict=True):
            key = tuple(text[at : at + 13])
            assert names.setdefault(key, name) == name and anchors.setdefault(key, anchor) == anchor
        assert len(set(names.values())) == len(names)


def test_kept_text_has_no_repeats(spark):
    docs = awkward()
    cut = [(r["doc_id"], r["text"]) for r in recompression.without_repeats(frame(spark, docs)).collect()]
    lost = brute.word_windows(docs)
    assert {i: len(brute.words(t)) for i, t in cut} == {i: n - gone for i, (n, gone, _) in lost.items()}


def test_byte_windows(spark):
    docs = awkward()
    got = {
        r["doc_id"]: (
            r["n_bytes"],
            r["n_removed"],
            r["n_spans"],
            r["kept_sha256"]
        ) for r in column_bwt.suffix_dedup(frame(spark, docs)).collect()
    }
    assert got == brute.byte_windows(docs)


@pytest.mark.parametrize("few", [0, 1000])
def test_byte_windows_with_hot_anchors(spark, monkeypatch, few):
    monkeypatch.setattr(column_bwt, "HOT", 1)
    monkeypatch.setattr(column_bwt, "HOT_ROWS", 3)
    monkeypatch.setattr(column_bwt, "FEW", few)
    docs = awkward()
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in column_bwt.suffix_dedup(frame(spark, docs), 40, 12).collect()}
    assert got == {i: x[1:3] for i, x in brute.byte_windows(docs, 40).items()}


def test_suffixes_in_order():
    pick = random.Random(2)
    for turn in range(80):
        strings = [bytes(pick.choices(b"ab\x00\xff" if turn % 2 else b"a", k=pick.randint(1, 12))) for _ in range(pick.randint(1, 7))]
        data, bounds = np.frombuffer(b"".join(strings), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in strings])])
        string, place, lcp = column_bwt.build(data, bounds)
        got = [strings[i][k:] for i, k in zip(string.tolist(), place.tolist(), strict=True)]
        assert got == sorted(x[k:] for x in strings for k in range(len(x) + 1))
        for k in range(1, len(got)):
            a, b = got[k - 1], got[k]
            same = next((m for m in range(min(len(a), len(b))) if a[m] != b[m]), min(len(a), len(b)))
            assert lcp[k] == same


def test_unigram_scores(spark):
    docs = awkward()
    got = {r["doc_id"]: r for r in bilinear_lm.lm_scores(frame(spark, docs), 5).collect()}
    for i, (held, n, known, total, base) in brute.unigram(docs).items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
        assert abs(r["base_score"] - base) < 1e-6 and r["score"] < 0


def test_bilinear_probabilities_sum_to_one():
    model = bilinear_lm.Bilinear.start(np.full(bilinear_lm.KINDS, 1 / bilinear_lm.KINDS))
    logs = model.classes()
    for two, one in ((0, 1), (3, bilinear_lm.SHARED), (bilinear_lm.START, bilinear_lm.START)):
        assert abs((10.0 ** logs.log10(two, one, np.arange(bilinear_lm.START))).sum() - 1) < 1e-9


def two_tongues(n=200):
    """Texts of two vocabularies, whose words tell the next ones' vocabulary only."""
    pick = random.Random(12)
    say = [[f"{x}{k}" for k in range(300)] for x in "ab"]
    return [(i, " ".join(pick.choices(say[i % 2], weights=[1 / (k + 3) for k in range(300)], k=80))) for i in range(n)]


def test_model_scores_word_by_word(spark):
    shared, last, start, kinds_ = bilinear_lm.SHARED, bilinear_lm.LAST, bilinear_lm.START, bilinear_lm.KINDS
    docs = [*two_tongues(), (1000, None), (1001, "a3 never seen a3"), (1001, "a3 never seen a3"), (None, "b5")]
    rows = frame(spark, docs).select("doc_id", "text")
    model = bilinear_lm.fit(rows.where("doc_id is null or doc_id < 180"), 300)
    count = {r["name"] % 2**64: r["c"] for r in model.counts.collect()}
    vector = {r["name"] % 2**64: np.array(r["vector"]) for r in model.vectors.collect()}
    kind = dict(zip(model.head.names.tolist(), model.head.classes.tolist(), strict=True))
    kind[int(bilinear_lm.END)] = last
    assert len(model.head.names) < len(count) and len(vector) > 5

    def within(name, context):
        return np.log10(
            (count.get(name, 0) + 0.1) / (model.head.rest_total + 0.1 * (model.head.rest_kinds + 1))
        ) + vector.get(name, np.zeros(25)) @ model.h[context] / np.log(10) - model.norm[context]

    rest = [x for x in count if kind.get(x, shared) == shared]
    for context in range(2 * kinds_):
        assert abs(sum(10 ** within(x, context) for x in [*rest, -1]) - 1) < 1e-6
    got = sorted((r["doc_id"] or -1, r["score"]) for r in bilinear_lm.scores(rows, model).collect())
    want = []
    for i, text in docs:
        import pyarrow as pa

        names = bilinear_lm._tokens(pa.array([text], pa.string()))[0].tolist()
        kinds = [kind.get(x, shared) for x in names]
        total = 0.0
        for t, x in enumerate(names):
            one = kinds[t - 1] if t else start
            two = next((k for k in reversed(kinds[: max(t - 1, 0)]) if k != shared), start)
            total += model.classes.log10(two, one, kinds[t]) + (
                within(x, kinds_ + two if one == shared else one) if kinds[t] == shared else 0
            )
        want.append((i or -1, total))
    assert np.allclose([x for x in got], sorted(want), rtol=1e-5)


def test_scores_do_not_depend_on_partitions_and_beat_the_base(spark):
    rows = frame(spark, two_tongues(300))
    few, many = ({r["doc_id"]: r for r in bilinear_lm.lm_scores(rows.repartition(n)).collect()} for n in (2, 9))
    assert all(abs(few[i]["score"] - many[i]["score"]) < 1e-6 for i in few)
    held = [r for r in few.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) + 0.04 * sum(r["n_tokens"] for r in held)


def test_sentencepiece_equals_library():
    import sentencepiece

    path = sentencepiece_arrays.model_file()
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_arrays.coder(path)
    pick = random.Random(3)
    texts = ["", " ", " a  b\n\tc é 漢 🙂x", "▁x", "x" * 300, " " * 40 + "y", "<s> <0x0A>", "\x00\x01", "привет мир 你好"]
    texts += ["".join(pick.choices("abcde  \n.,'tehin▁éß漢字й🙂", k=pick.randint(0, 50))) for _ in range(400)]
    ids, bounds = own.encode(pa.array(texts))
    assert [ids[bounds[k] : bounds[k + 1]].tolist() for k in range(len(texts))] == library.encode(texts)
    data, where = own.decode(ids, bounds)
    assert [data.tobytes()[where[k] : where[k + 1]].decode() for k in range(len(texts))] == [t.replace("▁", " ") for t in texts]


def test_sentencepiece_round_trip(spark):
    docs = awkward()
    told = sentencepiece_arrays.encode(frame(spark, docs))
    assert {r["doc_id"]: r["round_trip"] for r in told.collect()} == {i: True for i, _ in docs}
    assert {r["doc_id"]: r["text"] for r in sentencepiece_arrays.decode(told).collect()} == {i: t or "" for i, t in docs}


def test_media(spark):
    docs = awkward()
    told = {r["doc_id"]: r for r in telephony.media_columns(frame(spark, docs), media=True).collect()}
    for i, text in docs:
        raw = (text or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        codec, rate, stored = telephony.read_wav(told[i]["media"])
        assert stored == payload and rate == 8000 and told[i]["n_bytes"] == len(raw) and told[i]["tail_crc32"] == zlib.crc32(payload[-32:])
        assert told[i]["feature"].startswith(codec)
        assert telephony.read_wav(told[i]["pcm"])[:2] == ("pcm", 16000)


def test_companding_tables():
    assert telephony.MULAW[0] == -32124 and telephony.MULAW[127] == 0 and telephony.MULAW[255] == 0 and telephony.MULAW[128] == 32124
    assert telephony.ALAW[0x55] == -8 and telephony.ALAW[0xD5] == 8 and telephony.ALAW[0x2A] == -32256 and telephony.ALAW[0xAA] == 32256


def test_adpcm_one_block_at_a_time():
    blocks = np.random.default_rng(0).integers(0, 256, 5 * telephony.BLOCK).astype(np.uint8)
    together = telephony.decode_adpcm(blocks)
    for k in range(5):
        block = blocks[k * telephony.BLOCK : (k + 1) * telephony.BLOCK]
        sample, index = int(block[:2].view("<i2")[0]), min(int(block[2]), 88)
        out = [sample]
        for byte in block[4:].tolist():
            for code in (byte & 15, byte >> 4):
                step = int(telephony.STEPS[index])
                change = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                sample = max(-32768, min(32767, sample - change if code & 8 else sample + change))
                index = max(0, min(88, index + int(telephony.INDEX[code])))
                out.append(sample)
        assert out == together[k].tolist()


def test_shards(spark, tmp_path):
    docs = awkward() + [(7, TEXT), (None, "x"), (None, TEXT), (None, None)] + [(100 + k, "y" * (k % 50)) for k in range(600)]
    path = str(tmp_path / "map")
    sharding.save_map(spark, sharding.dealt_in_turn(4), path, 1)
    told = sharding.shard(frame(spark, docs), 4, path=path).toPandas()
    assert len(told) == len(docs) and set(told["law"]) == {"bytes"} and told["grown_shard"].isna().all()
    for _, part in told.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    total = told.groupby("shard")["size"].sum()
    assert total.max() - total.min() <= 0.004 * total.mean() + 8
    sizes = {(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in docs}
    assert {(None if i != i else int(i), n, c) for i, n, c in zip(told["doc_id"], told["size"], told["text_crc32"], strict=True)} == sizes
    # the rows go by the stored map, whose second version is an edit of the first
    first, second = sharding.load_map(spark, path, 1)[0], sharding.load_map(spark, path, 2)[0]
    assert set(told["map_version"]) == {2} and all(second[v] == k for v, k in zip(told["vslot"], told["shard"], strict=True))
    assert 0 < sum(first[k] != second[k] for k in first) < 100
    again = sharding.shard(frame(spark, docs), 4, path=path).toPandas()
    assert set(again["map_version"]) == {2}
    # one more shard takes slots; few others move to even the rest out
    grown = sharding.shard(frame(spark, docs), 5, path=path).toPandas()
    third = sharding.load_map(spark, path)[0]
    moved = [third[k] for k in second if second[k] != third[k]]
    assert sum(k != 4 for k in moved) <= 0.01 * len(moved) + 3 and set(grown["shard"]) == set(range(5))


def test_shards_of_repeated_rows(spark):
    """A third of all rows are one row without id, another third one row with an id: they spread over all shards."""
    same = spark.range(30_000).selectExpr("cast(null as long) as doc_id", "'same' as text").unionByName(
        spark.range(30_000).selectExpr("7L as doc_id", "'kept' as text")
    )
    docs = same.unionByName(spark.range(30_000).selectExpr("100 + id as doc_id", "repeat('z', int(id % 9)) as text"))
    told = sharding.shard(docs).toPandas()
    assert len(told) == 90_000 and told["doc_id"].isna().sum() == 30_000 and (told["doc_id"] == 7).sum() == 30_000
    total = told.groupby("shard")["size"].sum()
    assert len(total) == sharding.SHARDS and total.max() - total.min() <= 0.004 * total.mean()
    for _, part in told.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))


def test_rebalancing_moves_single_slots(spark, tmp_path):
    sizes = {k: 10 for k in range(240)}
    first = sharding.dealt_in_turn(4, 240)
    grown = sharding.rebalanced(first, sizes, 5)
    moved = [k for k in first if first[k] != grown[k]]
    assert {grown[k] for k in moved} == {4} and len(moved) <= 50
    sharding.save_map(spark, first, str(tmp_path / "map"), 1)
    sharding.save_map(spark, grown, str(tmp_path / "map"), 2)
    assert sharding.load_map(spark, str(tmp_path / "map")) == (grown, 2)
    assert sharding.load_map(spark, str(tmp_path / "map"), 1) == (first, 1)


def vectors(seed=0):
    pick = np.random.default_rng(seed)
    rows = []
    for k in range(60):
        center = pick.normal(size=24)
        for _ in range(3):
            rows.append((center + pick.normal(size=24) * 0.02 * np.linalg.norm(center) / 5, k % 3))
    rows += [(rows[0][0], 0), (rows[0][0], 1), (rows[0][0] * 3, 0)]
    out = [(k, [float(x) for x in v], label) for k, (v, label) in enumerate(rows)]
    n = len(out)
    return out + [
        (n, None, 0),
        (n + 1, [0.0] * 24, 0),
        (n + 2, [float("nan")] * 24, 0),
        (n + 3, out[0][1], None),
        (n + 4, [None] + [1.0] * 23, 0),
        (n + 5, [], 0)
    ]


@pytest.mark.parametrize("tile", [1024, 5])
def test_near_vectors(spark, monkeypatch, tile):
    monkeypatch.setattr(cross_polytope, "TILE", tile)
    rows = vectors()
    told = {
        r["vec_id"]: r for r in cross_polytope.near_vectors(
            spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
        ).collect()
    }
    usable = {
        i: (
            np.array(v, np.float32).astype(float),
            y
        ) for i, v, y in rows if v and y is not None and None not in v and np.isfinite(v).all() and any(v)
    }
    groups, count = brute.Groups(), dict.fromkeys(told, 0)
    for a, (u, y) in usable.items():
        for b, (v, z) in usable.items():
            if a < b and y == z and u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= 0.98:
                groups.join(a, b)
                count[a] += 1
                count[b] += 1
    assert {
        i: (r["n_links"], r["component_id"], r["kept"]) for i, r in told.items()
    } == {i: (count[i], groups.find(i), groups.find(i) == i) for i in told}


def test_language_of_unlike_texts(spark):
    pick = random.Random(5)
    say = {"xx": "kala moku lani pahu", "yy": "strf grbt plnk dzwo"}
    docs = [
        (
            i,
            " ".join(pick.choices(say[lang].split(), k=40)) if i % 17 else None,
            lang,
            "s",
            1,
            "n"
        ) for i, lang in enumerate(["xx", "yy"] * 60)
    ]
    docs.append((999, "12 34 !!", "xx", "s", 1, "n"))
    data = spark.createDataFrame(docs, SCHEMA)
    model = language_crf.fit(data)
    told = {r["doc_id"]: r for r in language_crf.language_id(data, model).collect()}
    for i, text, lang, *_ in docs:
        assert told[i]["lang_pred"] == (lang if text and i != 999 else "und")
        assert told[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
    labels = [x for _, x in language_crf.labelled_words(model, "kala moku lani strf grbt plnk dzwo")]
    assert labels == ["xx"] * 3 + ["yy"] * 4
    assert language_crf.keep_identified(data, 0.4, model).columns == data.columns


def test_mixing_meets_targets(spark):
    pick = random.Random(6)
    say = {"xx": "kala moku lani pahu", "yy": "strf grbt plnk dzwo"}
    docs = [
        (
            i,
            " ".join(pick.choices(say[lang].split(), k=30)) if i != 3 else None,
            lang,
            "s",
            1,
            "n"
        ) for i, lang in enumerate(["xx", "xx", "xx", "yy"] * 50)
    ]
    data = spark.createDataFrame(docs, SCHEMA)
    rated, model, before, after = mixing.mixed_rates(data, {"xx": 0.5, "yy": 0.5})
    assert model.domains == ["xx", "yy"] and abs(before[0] / before.sum() - 0.75) < 0.05
    assert abs(after[0] / after.sum() - 0.5) < 0.05
    copies = {r["doc_id"]: r["copies"] for r in rated.collect()}
    out = mixing.mixed(data, {"xx": 0.5, "yy": 0.5})
    assert out.columns == data.columns
    assert {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()} == {i: n for i, n in copies.items() if n}


def test_mixing_moves_sources_that_share_their_words(spark):
    pick = random.Random(8)
    sources = ["hot"] * 240 + ["b", "c", "d"] * 40
    docs = [(i, " ".join(pick.choices(TEXT.split(), k=30)), "en", s, 1, "n") for i, s in enumerate(sources)]
    data = spark.createDataFrame(docs, SCHEMA)
    report = {r["label"]: r for r in mixing.mix_report(data, mixing.EQUAL, "source").collect()}
    assert report["hot"]["before"] == 7200 and report["b"]["before"] == 1200
    for source in ("hot", "b", "c", "d"):
        assert report[source]["target"] == 2700
        assert abs(report[source]["after"] / 2700 - 1) < 0.05
    rated = mixing.mix_rates(data, mixing.EQUAL, "source")
    assert {r["domain"] for r in rated.collect()} <= {"hot", "b", "c", "d"}
    out = {r["source"]: r["count"] for r in corpus_pipeline.mix(spark, data, "").groupBy("source").count().collect()}
    assert out["hot"] < 130 and min(out[x] for x in "bcd") > 60


def test_mixing_is_soft_and_least_squares(spark):
    """The registered query: every document has a posterior of its own, and the rates are those of plain steps on them."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rated, model, before, after = mixing.mixed_rates(docs, mixing.EQUAL, "source")
    rows = rated.collect()
    p, tokens, rate = np.array([r["posterior"] for r in rows]), np.array([r["n_tokens"] for r in rows]), np.array([r["rate"] for r in rows])
    assert np.allclose(p.sum(axis=1), 1) and (p.max(axis=1)[tokens > 0] < 1).all()
    assert any(len({round(r["rate"], 6) for r in rows if r["label"] == s}) > 1 for s in model.domains)
    goal = np.full(len(model.domains), before.sum() / len(model.domains))
    scale = np.maximum(goal, before) / before.sum()
    spread = (p * tokens[:, None]).T @ p / before.sum() / np.sqrt(np.outer(scale, scale))
    step, plain = 1 / (np.linalg.eigvalsh(spread)[-1] + mixing.RIDGE), np.ones(len(rows))
    for _ in range(2000):
        miss = ((plain * tokens) @ p - goal) / before.sum() / scale
        if (np.abs(miss * before.sum() * scale) <= mixing.MISS * goal).all():
            break
        plain = np.maximum(0, plain - step * (p @ miss + mixing.RIDGE * (plain - 1)))
    assert np.allclose(rate[tokens > 0], plain[tokens > 0], atol=1e-6) and np.allclose((rate * tokens) @ p, after)
    assert (np.abs(after - goal) <= mixing.MISS * goal).all()
    assert sorted((r["doc_id"], r["rate"]) for r in rows) == sorted(
        (r["doc_id"], r["rate"]) for r in mixing.mix_rates(docs, mixing.EQUAL, "source").collect()
    )


def test_mixing_tells_of_targets_that_no_rates_reach(spark):
    docs = spark.createDataFrame(
        [(i, "same words here", None if i else "a", None, 1, "n") for i in range(9)] + [(9, "same words here", "b", None, 1, "n")],
        SCHEMA
    )
    with pytest.warns(UserWarning, match="miss their targets"):
        mixing.mixed_rates(docs, {"a": 1.0, "b": 0.0})


def test_mixing_of_many_labels_shares_domains(spark):
    docs = spark.createDataFrame(
        [(i, f"w{i} x", f"l{i % 40}", None, 1, "n") for i in range(200)] + [(i, "y z", "big", None, 1, "n") for i in range(200, 260)],
        SCHEMA
    )
    model = mixing.fit(docs, "lang", most=20)
    assert len(model.domains) == 20 and "big" in model.domains and sum(d.startswith(mixing.OTHER) for d in model.domains) == mixing.OTHERS
    told = mixing.posteriors(docs, model, "lang").collect()
    assert {r["label"] for r in told} <= set(model.domains) and len(told) == 260
    assert mixing.mixed_rates(docs, mixing.EQUAL, "lang", model)[0].count() == 260


def test_samples_take_every_row_they_may(spark, monkeypatch):
    """A thousand short labelled rows among twenty thousand: none is lost to a bound that long rows set."""
    rows = spark.range(20_000).selectExpr(
        "id AS doc_id",
        "if(id % 20 = 0, concat('some words ', id), repeat('long text ', 1700)) AS text",
        "'xx' AS lang",
        "'s' AS source"
    )
    taken = []
    monkeypatch.setattr(mixing, "calibrated", lambda texts, labels, counts: taken.append(len(texts)))
    monkeypatch.setattr(language_crf, "train", lambda texts, labels: taken.append(len(texts)))
    mixing.fit(rows, "source")
    language_crf.fit(rows)
    may = sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(0, 20_000, 20))
    assert taken == [1000, may]


def test_lm_scores_tell_documents_with_one_print_apart(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a b c word{i} " * (i + 1)) for i in range(6)], "doc_id long, text string")
    model = bilinear_lm.fit(docs.select("text"), 4)
    want = {r["doc_id"]: (r["n_tokens"], r["n_known"]) for r in bilinear_lm.scores(docs, model).collect()}
    monkeypatch.setattr(bilinear_lm.F, "xxhash64", lambda *a: F.lit(1).cast("long"))
    assert {r["doc_id"]: (r["n_tokens"], r["n_known"]) for r in bilinear_lm.scores(docs, model).collect()} == want and len(want) == 6


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    for told in (
        ngram_join.ngram_join(empty),
        recompression.substring_dedup(empty),
        column_bwt.suffix_dedup(empty),
        bilinear_lm.lm_scores(empty),
        sentencepiece_arrays.encode(empty),
        telephony.media_columns(empty),
        sharding.shard(empty),
        language_crf.language_id(empty),
        mixing.mix_rates(empty)
    ):
        assert told.count() == 0
    assert cross_polytope.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_missing_ids_and_repeated_rows(spark):
    data = frame(spark, [(None, TEXT), (1, TEXT), (1, TEXT), (2, TEXT)])
    for told in (
        ngram_join.ngram_join(data),
        recompression.substring_dedup(data),
        column_bwt.suffix_dedup(data),
        bilinear_lm.lm_scores(data),
        sentencepiece_arrays.encode(data),
        telephony.media_columns(data),
        sharding.shard(data),
        language_crf.language_id(data),
        mixing.mix_rates(data)
    ):
        assert told.count() == 4
    assert {
        (r["doc_id"], r["n_removed"] > 0) for r in recompression.substring_dedup(data).collect()
    } == {(None, False), (1, False), (2, True)}
    assert recompression.without_repeats(data).where(F.length("text") > 0).count() == 3
