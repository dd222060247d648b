"""Operators against plain Python on small tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import BENCH, WORDS, build, sentence
from tracelake.llm import decontam, langid, mixing, neardup, pii, quality, secrets_scan, telephony, tokenbin, toxicity

LOW = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)


def windows(items, n=13):
    out = {}
    for item, text in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", LOW(text or ""))
        for k in range(max(1, len(w) - n + 1)) if w else []:
            out.setdefault(tuple(w[k : k + n]), set()).add(str(item))
    return out


@pytest.mark.parametrize("block_words", [100_000, 10])
def test_decontamination(spark, mixed, block_words):
    folder, docs, bench = mixed
    win = windows(bench)
    got = decontam.digest(decontam.find_contamination(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet"), block_words=block_words)).collect()
    by_id = {r.doc_id: r for r in got}
    for i, text, *_ in docs:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", LOW(text or ""))
        hit, items = set(), set()
        for n in {len(k) for k in win}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in win:
                    hit.update(range(k, k + n))
                    items |= win[tuple(w[k : k + n])]
        r = by_id[i]
        assert (r.n_words, r.n_hit, r.n_items) == (len(w), len(hit), len(items))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        assert r.contaminated == (bool(hit) and 20 * len(hit) >= len(w))


@pytest.mark.parametrize("block_words", [100_000, 10])
def test_decontamination_cuts_and_drops(spark, tmp_path, block_words):
    rng = random.Random(1)
    long_text = sentence(rng, 500)
    folder = build(spark, tmp_path / "t", [(1, f"{long_text} {BENCH.upper()}! tail", "en", "s"), (2, BENCH, "en", "s"), (3, long_text, "en", "s")], bench=[(1, BENCH)])
    out = {r.doc_id: r for r in decontam.remove_contamination(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet"), block_words=block_words).collect()}
    assert sorted(out) == [1, 3]
    assert out[1].text == f"{long_text} ! tail" and out[1].n_chars == len(out[1].text)
    assert out[3].text == long_text


def whole_ids(encoder, text):
    return np.array(encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


def test_token_planes(spark, mixed):
    from tokenizers import Tokenizer

    folder, docs, _ = mixed
    whole = Tokenizer.from_file(tokenbin.vocabulary_path())
    frames = tokenbin.write_token_frames(spark.read.parquet(f"{folder}/documents.parquet"), frame_ids=500, block_ids=64)
    got = tokenbin.document_stream(frames, with_ids=True).orderBy("start").collect()
    start = 0
    for r, (i, text, *_) in zip(got, sorted(docs, key=lambda d: d[0]), strict=True):
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (i, start, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_token_pieces_share_words():
    """A word costs the library one encoding, however it is written and whatever signs stand around it."""
    encoder = tokenbin.PieceEncoder(tokenbin.vocabulary_path())
    endings = [*".,;:!?", "...", "!!", "###", "%%%", *map(str, range(100))]
    texts = [" ".join(form(w) + e for e in endings) for w in (*WORDS, "éñöß", "ÀÉÞù") for form in (str.lower, str.upper, str.title)]
    assert encoder.encode(texts) == [whole_ids(encoder, t) for t in texts]
    # ß is SS in capitals; 10 digits and 10 runs of signs
    assert len(encoder.known) <= len(WORDS) + 3 + 10 + 10


@pytest.mark.parametrize("limit", [5, 40, 1 << 20])
@pytest.mark.parametrize("kept", [3, 1_000_000])
def test_token_pieces_of_any_symbols(limit, kept):
    encoder = tokenbin.PieceEncoder(tokenbin.vocabulary_path(), kept)
    bits = ["'", "'s", "'LL", "'x", "don't", "L'ÉTÉ", "~", " ~ ", "<|", "|>", "<|endoftext|>", "<|ENDOFTEXT|>", "É", "ß", "ẞ", "ÿ", "×", "÷", "µ", "ª", "½", "́", "̇", "İ", "Œ", "ΑΣ", "K", "\t", "\x1c", "\x85", "\xa0", "\x00", "12", "٣", "中文", "한국", "각", "😀", "\u200d", "_", "--", "</w>", "Ġ", "Ã", "abc", "XYZ", "a1b2", "\n", "  ", "q" * 1200]
    rng = random.Random(limit)
    for _ in range(40):
        texts = [None, "", *("".join(rng.choice(bits) + rng.choice(["", " ", "\n", ""]) for _ in range(rng.randrange(1, 30))) for _ in range(rng.randrange(5)))]
        assert encoder.encode(texts, limit) == [whole_ids(encoder, t) for t in texts]
        assert encoder.encode(texts[-1:], limit) == [whole_ids(encoder, texts[-1])]


def test_token_pieces_of_another_vocabulary(tmp_path):
    """A vocabulary whose rules are not the known ones is given whole pieces."""
    encoder = tokenbin.PieceEncoder(tokenbin.vocabulary_path())
    encoder.tokenizer.normalizer = None
    encoder.tokenizer.save(str(tmp_path / "other.json"))
    other = tokenbin.PieceEncoder(str(tmp_path / "other.json"))
    texts = ["Ab12 ab, AB'S é É", "ab AB\nAb12", None]
    assert other.encode(texts) == [whole_ids(other, t) for t in texts]
    assert other.encode(texts) != encoder.encode(texts)


@pytest.mark.parametrize("kind", [0, 1])
@pytest.mark.parametrize("n", [0, 1, 63, 64, 1000])
def test_plane_round_trip(kind, n):
    ids = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint32)
    assert (tokenbin.unpack(tokenbin.pack(ids, block_ids=64, kind=kind)) == ids).all()
    if n:
        with pytest.raises(ValueError):
            tokenbin.unpack(tokenbin.pack(ids, block_ids=64, kind=kind) + b"x")


def test_telephony_payloads(spark, mixed):
    folder, docs, _ = mixed
    got = {r.doc_id: r for r in telephony.decode_media(telephony.encode_media(spark.read.parquet(f"{folder}/documents.parquet")), with_pcm=True).collect()}
    for i, text, *_ in docs:
        raw = (text or "").encode()
        padded = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
        assert r.feature.endswith(str(zlib.crc32(r.pcm)))
    assert got[3].feature == got[4].feature


def test_codecs_by_definition():
    assert telephony.TABLES["mulaw"][[0x00, 0x7F, 0x80, 0xFF]].tolist() == [-32124, 0, 32124, 0]
    assert telephony.TABLES["alaw"][[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]
    block = np.random.default_rng(3).integers(0, 256, (3, 576)).astype(np.uint8)
    fast = telephony.decode_adpcm(block)
    for b, out in zip(block, fast, strict=True):
        value, index, want = int(np.array(b[:2]).view("<i2")[0]), min(int(b[2]), 88), []
        want.append(value)
        for byte in b[4:].tolist():
            for code in (byte & 15, byte >> 4):
                step = int(telephony._STEPS[index])
                diff = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                value = max(-32768, min(32767, value - diff if code & 8 else value + diff))
                index = max(0, min(88, index + (-1, -1, -1, -1, 2, 4, 6, 8)[code & 7]))
                want.append(value)
        assert out.tolist() == want


def test_cross_parsing():
    rng = random.Random(2)
    samples = {"aa": " ".join("".join(rng.choice("abcde") for _ in range(5)) for _ in range(300)), "bb": " ".join("".join(rng.choice("defgh") for _ in range(5)) for _ in range(300))}
    model = langid.LanguageModel(samples)
    texts = ["abcde edcba 12 dede", "hh", "", "zzz y", samples["aa"][:2000], "".join(rng.choice("abcdefgh ") for _ in range(1500))]
    counts, sizes = model.phrases(texts)
    flat, n = model.symbols(texts)
    assert n.tolist() == sizes.tolist()
    at = 0
    own = [model.symbols([samples[lang]])[0][: langid.SAMPLE_SYMBOLS].tobytes() for lang in model.languages]
    for k, size in enumerate(sizes.tolist()):
        s = flat[at : at + size].tobytes()
        at += size
        for j, sample in enumerate(own):
            phrases = 0
            for begin in range(0, size, langid.SEGMENT):
                seg, p = s[begin : begin + langid.SEGMENT], 0
                while p < len(seg):
                    length = 1
                    while p + length <= len(seg) and seg[p : p + length] in sample:
                        length += 1
                    p += max(1, length - 1)
                    phrases += 1
            assert counts[k, j] == phrases


def test_language_accuracy(spark, tmp_path):
    rng = random.Random(3)
    forms = {"xx": ["tor", "mel", "an", "du", "ri"], "yy": ["ska", "bli", "o", "eng", "vu"]}
    docs = [(i, " ".join("".join(rng.choice(forms[lang]) for _ in range(3)) for _ in range(40)), lang, "s") for i in range(200) for lang in [("xx", "yy")[i % 2]]]
    docs += [(900, "12 !", "xx", "s"), (901, None, "xx", "s")]
    folder = build(spark, tmp_path / "t", docs)
    got = {r.doc_id: r for r in langid.op4_language_id(spark, folder).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang, _ in docs[:200])
    assert got[900].lang_pred == got[901].lang_pred == "und"
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)


def test_toxicity_on_held_out_rows(spark, tmp_path):
    rng = random.Random(4)
    bad = ["grumble", "snark", "vexing"]
    docs, labels = [], []
    for i in range(400):
        toxic = i % 6 == 0
        words = sentence(rng, 50).split()
        if toxic:
            words[rng.randrange(50)] = rng.choice(bad)
        docs.append((i, " ".join(words), "en", "s"))
        labels.append((i, 1, int(toxic)))
    folder = build(spark, tmp_path / "t", docs, labels)
    got = {r.doc_id: r for r in toxicity.op5_toxicity(spark, folder).collect()}
    held = [i for i in got if got[i].held_out]
    assert len(held) > 50
    assert sum(got[i].predicted == (i % 6 == 0) for i in held) / len(held) > 0.97


def test_mixing(spark, tmp_path):
    rng = random.Random(6)
    docs = [(i, sentence(rng, rng.randrange(1, 400)), "en", rng.choice(["a", "b", "c", "d", None])) for i in range(300)] + [(900, None, "en", "a"), (901, " ", "en", "zz")]
    folder = build(spark, tmp_path / "t", docs)
    got = mixing.op6_source_mixing(spark, folder).collect()
    size = {d[0]: len(re.findall(r"[^\x20\x09-\x0D]+", d[1] or "")) for d in docs}
    source = {d[0]: d[3] for d in docs}
    order = sorted({s for s in source.values() if s is not None}) + [None]
    total = {s: sum(n for i, n in size.items() if source[i] == s) for s in order}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(size.values()), set(order)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * total[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * total[s]
            left -= target[s]
            open_.discard(s)
    taken = dict.fromkeys(order, 0)
    for r in got:
        assert r["size"] == size[r.doc_id] and r.source_size == total[source[r.doc_id]]
        assert r.target == pytest.approx(target[source[r.doc_id]])
        assert 0 <= r.taken <= 2 * r["size"]
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] + 1 for s in order)
    docs_df = spark.read.parquet(f"{folder}/documents.parquet")
    by_id = {r.doc_id: r.taken for r in got}
    for r in mixing.mix_documents(docs_df).collect():
        assert len(r.text.split()) == by_id.pop(r.doc_id)
    assert not any(by_id.values())


def test_mix_shards(spark, tmp_path, monkeypatch):
    """Shards of equal size, source counts like multinomial draws, sums near the targets, the blocks' words, and what documents lose to them."""
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 100)
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 4)
    monkeypatch.setattr(mixing, "GROUP", 3)
    rng = random.Random(13)
    docs = [(i, " ".join(f"{i}.{k}" for k in range(rng.randrange(1, 60))), "en", rng.choice("aaabc")) for i in range(400)]
    folder = build(spark, tmp_path / "t", docs)
    df = spark.read.parquet(f"{folder}/documents.parquet")
    targets = mixing.source_targets(df.select("source", mixing.F.size(mixing.word_array(mixing.F.col("text"))).cast("long").alias("size"))).collect()
    slots = mixing.mix_shards(df).collect()
    n = {r.source: r.slots for r in targets}
    total = sum(n.values())
    by_shard = {}
    for r in slots:
        by_shard.setdefault(r.shard, []).append(r.source)
    assert sorted(by_shard) == list(range(-(-total // 100)))
    assert all(len(v) == min(100, total - 100 * k) for k, v in by_shard.items())
    sums = {s: sum(v.count(s) for v in by_shard.values()) for s in n}
    assert sum(sums.values()) == total and all(abs(sums[s] - n[s]) <= 0.01 * n[s] for s in n)
    full = [v for v in by_shard.values() if len(v) == 100]
    chi = sum((v.count(s) - 100 * n[s] / total) ** 2 / (100 * n[s] / total) for v in full for s in n)
    freedom = len(full) * (len(n) - 1)
    assert 0.5 * freedom < chi < 1.6 * freedom
    source = {d[0]: d[3] for d in docs}
    taken = {}
    for r in slots:
        words = r.text.split()
        assert 0 < len(words) <= 4
        for w in words:
            assert source[int(w.split(".")[0])] == r.source
            taken[w] = taken.get(w, 0) + 1
    assert max(taken.values()) <= 2
    per_doc = {d[0]: 0 for d in docs}
    for w, k in taken.items():
        per_doc[int(w.split(".")[0])] += k
    assert {r.doc_id: r.taken for r in mixing.mix_counts(df).collect()} == per_doc


def test_draws_decide_the_mix(spark, monkeypatch):
    """Another draw is another mix, whose sources still come near their targets; within the tolerance a source gets just what it was drawn."""
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 2)
    rng = random.Random(14)
    df = spark.createDataFrame([(i, sentence(rng, rng.randrange(1, 90)), rng.choice("aaabcd")) for i in range(900)], "doc_id long, text string, source string")
    draw, taken = mixing.draw_counts, []
    for seed in (1, 2):
        monkeypatch.setattr(mixing, "draw_counts", lambda targets, seed=seed: draw(targets, seed))
        rows = mixing.mix_counts(df).withColumnRenamed("size", "words").collect()
        assert all(0 <= r.taken <= 2 * r.words for r in rows)
        taken.append({r.doc_id: r.taken for r in rows})
        by_target = {}
        for r in rows:
            by_target[r.target] = by_target.get(r.target, 0) + r.taken
        assert all(abs(n - t) <= 0.012 * t + 2 for t, n in by_target.items())
    assert taken[0].keys() == taken[1].keys() and sum(taken[0][i] != taken[1][i] for i in taken[0]) > 20


def test_settled_draws(spark):
    """Bounds hold, the sum stays, and draws within their bounds are left alone where all are."""
    rng = random.Random(15)
    for near in (0.0, 0.02, 0.5):
        slots = [rng.randrange(0, 400) for _ in range(9)]
        blocks = [max(-(-n // 2), rng.randrange(n // 2, n + 1)) for n in slots]
        for spread in (0.01, 0.4):
            drawn = [max(0, n + round(n * rng.uniform(-spread, spread))) for n in slots]
            drawn[0] += sum(slots) - sum(drawn)
            drawn[0], drawn[1] = max(0, drawn[0]), drawn[1] + min(0, drawn[0])
            if drawn[1] < 0:
                continue
            sums = spark.createDataFrame([(k, *r) for k, r in enumerate(zip(slots, blocks, drawn, strict=True))], "sid long, slots long, blocks long, drawn long")
            mixed = [r.mixed for r in mixing.settled_draws(sums, near).orderBy("sid").collect()]
            low = [n - int(n * near) for n in slots]
            high = [min(n + int(n * near), 2 * b) for n, b in zip(slots, blocks, strict=True)]
            assert sum(mixed) == sum(drawn)
            assert all(a <= m <= b for a, m, b in zip(low, mixed, high, strict=True))
            if all(a <= d <= b for a, d, b in zip(low, drawn, high, strict=True)):
                assert mixed == drawn


def test_mix_of_repeated_and_missing_ids(spark):
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (1, "d e", "s"), (None, "f g h i", "s"), (None, None, None), (2, "", "t")] + [(10 + i, "u v w x y z", "t") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    counts = sorted((r.doc_id or 0, r["size"], r.taken) for r in mixing.mix_counts(df).collect())
    assert [(d, n) for d, n, _ in counts] == sorted((i or 0, len((t or "").split())) for i, t, _ in rows)
    mixed = sorted((r.doc_id or 0, len(r.text.split())) for r in mixing.mix_documents(df).collect())
    assert mixed == sorted((d, k) for d, _, k in counts if k)


def test_sieve_of_ids(spark):
    from tracelake.llm.common import sifted, with_id_in, without_id_in

    rows = spark.range(5000).selectExpr("if(id % 50 = 0, null, id) AS doc_id", "id AS x")
    ids = spark.range(0, 5000, 7).selectExpr("id AS doc_id")
    inside = {r.x for r in with_id_in(rows, ids).collect()}
    assert inside == {x for x in range(0, 5000, 7) if x % 50}
    assert {r.x for r in without_id_in(rows, ids).collect()} == set(range(5000)) - inside
    assert sifted(rows, ids).where("maybe").count() < 1.1 * len(inside)


def test_permutation_is_one(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 7, 64, 1000):
        rows = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3)).alias("x")).collect()
        assert sorted(r.x for r in rows) == list(range(n))


def test_kneser_ney(spark):
    text = "the cat sat on the mat. the cat ran! " * 3 + "Banana bandana."
    grams = quality.count_grams(spark.createDataFrame([(text,), ("",), (None,)], "text string"))
    counts = {r.gram: r.n for r in grams.collect()}
    codes, _ = quality.gram_stream([text])
    assert sum(counts.values()) == len(text) and counts == {int(c): int(n) for c, n in zip(*np.unique(codes, return_counts=True), strict=True)}
    levels = {4: counts}
    for n in (3, 2, 1):
        levels[n] = {}
        for g in levels[n + 1]:
            levels[n][g & (1 << 5 * n) - 1] = levels[n].get(g & (1 << 5 * n) - 1, 0) + 1

    def off(n, c):
        k = [sum(v == j for v in levels[n].values()) for j in (1, 2, 3, 4)]
        if not all(k):
            return (0.5, 1.0, 1.5)[min(c, 3) - 1]
        y = k[0] / (k[0] + 2 * k[1])
        d = [min(j, max(0.05, j - (j + 0.0) * 0 - (j + 1) * y * k[j] / k[j - 1])) for j in (1, 2, 3)]
        return d[min(c, 3) - 1]

    def p(g, n):
        if n == 0:
            return 1 / 32
        h = g >> 5
        below = p(g & (1 << 5 * (n - 1)) - 1, n - 1)
        here = {x: c for x, c in levels[n].items() if x >> 5 == h}
        if not here:
            return below
        freed = sum(off(n, c) for c in here.values())
        return ((here[g] - off(n, here[g]) if g in here else 0) + freed * below) / sum(here.values())

    got = {r.gram: r.p for r in quality.kneser_ney(grams).where("gram % 4099 = 0 or gram in (" + ",".join(map(str, counts)) + ")").collect()}
    for g, value in got.items():
        assert value == pytest.approx(p(g, 4))
    total = quality.kneser_ney(grams).groupBy((quality.F.shiftright("gram", 5)).alias("h")).agg(quality.F.sum("p").alias("s")).agg(quality.F.min("s"), quality.F.max("s")).first()
    assert total[0] == pytest.approx(1) and total[1] == pytest.approx(1)


def test_quality_rejects_junk(spark, tmp_path):
    rng = random.Random(8)
    docs = [(i, ". ".join(sentence(rng, 12) for _ in range(6)), "en", "s") for i in range(60)]
    junk = [(100 + i, " ".join(rng.choice("@#$%^&*") * 3 + w.upper() for w in sentence(rng, 60).split()), "en", "s") for i in range(10)]
    folder = build(spark, tmp_path / "t", docs + junk + [(200, None, None, None)], [(i, 1, 0) for i in range(0, 60, 2)] + [(100, 0, 0)])
    kept = {r.doc_id for r in quality.keep_quality(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    assert kept == {d[0] for d in docs} | {200}


def test_near_duplicates(spark, tmp_path):
    rng = random.Random(9)
    docs = [(i, sentence(rng, rng.randrange(3, 120)), "en", "s") for i in range(80)]
    base = sentence(rng, 120).split()
    for i in range(60):  # a group whose members are partly just below the limit of each other
        words = list(base)
        for _ in range(rng.randrange(1, 5)):
            words[rng.randrange(len(words))] = rng.choice(["uno", "dos", "tres"])
        docs.append((200 + i, " ".join(words), "en", "s"))
    docs += [(300 + i, docs[7][1].upper(), "en", "s") for i in range(5)] + [(400, None, "en", "s"), (401, "", "en", "s"), (402, "a b", "en", "s"), (403, "A  B", "en", "s")]
    folder = build(spark, tmp_path / "t", docs)
    sets = {}
    for i, t, *_ in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", LOW(t or ""))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    for r in neardup.op10_near_duplicates(spark, folder).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), find(r.doc_id), find(r.doc_id) == r.doc_id)


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    common = rng.integers(0, 2**63, 300).astype(np.uint64)
    a, b = (np.unique(np.concatenate([common, rng.integers(0, 2**63, 100).astype(np.uint64)])) for _ in range(2))
    one = np.array([5], np.uint64)
    s = neardup.sketches(np.concatenate([a, b, one, one]), np.cumsum([0, len(a), len(b), 1, 1, 0]))
    assert abs(np.mean(s[0] == s[1]) - 0.6) < 0.12
    assert (s[2] == s[3]).all() and (s[:4] != np.uint64(2**64 - 1)).all() and (s[4] == np.uint64(2**64 - 1)).all()


def test_connected_components(spark):
    links = spark.createDataFrame([(9, 8), (8, 7), (7, 1), (20, 21), (21, 22), (22, 20), (5, 5)], "a long, b long")
    got = {r.node: r.component for r in neardup.connected_components(links).collect()}
    assert got == {9: 1, 8: 1, 7: 1, 1: 1, 20: 20, 21: 20, 22: 20}


BASE = {
    "email": lambda t: [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)],
    "ip": lambda t: [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))],
    "card": lambda t: [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(re.sub("[^0-9]", "", m[0])) <= 19 and luhn(re.sub("[^0-9]", "", m[0]))],
    "phone": lambda t: [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15],
}


def luhn(s):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(s[::-1])) % 10 == 0


PII_TEXTS = ["a@b.c_d@e.f x@y z@q.w.", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.0255.4 1.2.3", "4111-1111 1111 1111 and 41111111111111112222 4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "+1 (555) 123-4567, +123, ++44 20.7946.0958 +1234567890123456", "é😀 ü@ü.de ab.c@d-e.fr￿ x 10.0.0.1", "9" * 3000 + " " + "1 2 " * 3000, "a" * 50_000 + "@", "+1" + " " * 3000 + "2"]


def test_personal_data(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*PII_TEXTS, None, ""])], "doc_id long, text string")
    for r in pii.digest(pii.find_personal_data(docs)).collect():
        t = ([*PII_TEXTS, None, ""][r.doc_id]) or ""
        found = sorted((a, k, b) for k, kind in enumerate(BASE) for a, b in BASE[kind](t))
        text = ",".join(f"{list(BASE)[k]}:{a}:{b}" for a, k, b in found)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest(), (r.doc_id, text, r.spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(f[1] == k for f in found) for k in range(4)]


def test_revealing_terms(spark):
    docs = [(i, f"hello agent zorblax wrote from {'x@corp.example'} today") for i in range(3)] + [(10 + i, "hello from today wrote agent") for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r.doc_id: r for r in pii.digest(pii.find_personal_data(df)).collect()}
    assert found[0].spans == "term:12:19,email:31:45" and found[12].spans == ""
    clean = {r.doc_id: r.text for r in pii.sanitised(df).collect()}
    assert clean[0] == "hello agent [...] wrote from [EMAIL] today" and clean[12] == docs[5][1]


def test_secret_layers():
    import base64
    import gzip
    from urllib.parse import quote

    inner = "password = hunter2hunter2"
    once = base64.b64encode(inner.encode()).decode()
    packed = base64.b64encode(gzip.compress(inner.encode())).decode()
    nested = quote(base64.b64encode(quote(once, safe="").encode()).decode(), safe="")
    for body in (once, packed, quote(inner, safe=""), "".join(f"\\u{ord(c):04x}" for c in inner)):
        text = f"é see {body} end"
        base, every, layers = secrets_scan.scan(text)
        added = set(every) - set(base)
        assert added and layers >= 2
        assert all(6 <= a < b <= 6 + len(body) for a, _, b in added)
    base, every, layers = secrets_scan.scan(f"x {nested} y")
    assert layers >= 3
    assert secrets_scan.scan(None) == ([], [], 0)
    assert secrets_scan.scan("token = secret = abcdefghij")[0] == []
    assert secrets_scan.scan("API_KEY: 'abcd1234'")[0] == [(0, 0, 18)]


def test_word_hashes_agree_anywhere():
    a, at = neardup.shingle_sets(pa.array(["x y z w v u", "q x y z w v u", None, "", "x y"]))
    one, two = set(a[at[0] : at[1]].tolist()), set(a[at[1] : at[2]].tolist())
    assert len(one) == 2 and one < two and at[2] == at[3] == at[4] and at[5] == at[4] + 1
