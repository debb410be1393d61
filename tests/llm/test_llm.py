"""Each operator against brute force on small inputs, with nulls, empties, ties, repeats and columns of clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strataquery.llm import bpe, class_lm, components, fingerprint, mixing, near_dup, pii, quality, token_files, topk, url_filter
from strataquery.llm.shared import new_folder

WORDS = "the and of thing other blue green seven quick brown fox jumps over lazy dogs near river bank stone".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ing", ",", "."]) for _ in range(n))


def docs(spark, rows, parts=3):
    schema = "doc_id long, text string, lang string, source string, n_chars long, size long, id long"
    return spark.createDataFrame([(i, t, None, s, 0, 7, 7) for i, t, s in rows], schema).repartition(parts)


TEXTS = [(1, None, "a"), (2, "", "a"), (3, " \n", None), (4, "Word", "b"), (4, "Word", "b"), (5, prose(1, 400), "b"), (6, prose(2, 40), None), (None, "x y", "c"), (7, "é" * 3000, "c")]


def test_topk(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4) / 4]) for i in range(0, 130)] + [(200, None), (250, [None, 1.0, 1.0, 1.0]), (300, [float("nan")] * 4), (None, [1.0] * 4)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    good = {i: [math.floor(256 * x) for x in v] for i, v in rows[:130]}
    want = []
    for q in (0, 50, 100):
        ranked = sorted((-sum(a * b for a, b in zip(good[q], v)), i) for i, v in good.items() if i != q)[:5]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(ranked)]
    assert sorted(map(tuple, topk.top_k(frame, F.col("vec_id") % 50 == 0).collect())) == want
    assert topk.top_k(frame.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_topk_of_repeated_rows_and_unequal_lengths(spark):
    rows = [(50, [1.0, 0.0])] * 2 + [(1, [1.0, 0.0])] * 3 + [(2, [0.5, 0.5]), (3, [9.0]), (100, [1.0]), (4, [2.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    of_50 = [(1, 1, 65536), (2, 1, 65536), (3, 1, 65536), (4, 2, 32768)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted([(50, *x) for x in of_50 * 2] + [(100, 1, 3, 589824), (100, 2, 4, 131072)])


def test_products_stay_exact():
    big = np.array([[2**40, 3]]), np.array([[2**21, 5], [2**30, 1]])
    assert topk._products(*big).tolist() == [[2**61 + 15, 2**63 - 1]]


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    rng = random.Random(1)
    alphabet = "aAsStTrReEvVlL''  \n\t\x85 123½éß.,!?-<|endoftext|>日ΣσİД́😀"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(1500)] + ["", "a" * 3000, "'" * 50, "a<|endoftext|> b", "x'll  y"]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        library = Tokenizer.from_file(bpe.vocabulary_path(name))
        for codec in (bpe.Codec(bpe.vocabulary_path(name)), bpe.Codec(bpe.vocabulary_path(name), bpe.library_words)):
            for want, got in zip(library.encode_batch(texts, add_special_tokens=False), codec.encode(texts), strict=True):
                assert want.ids == got.tolist()
                assert library.decode(want.ids, skip_special_tokens=False).encode() == codec.decode_bytes(got)
    rows = bpe.encode_documents(docs(spark, TEXTS), bpe.vocabulary_path("word_bpe_49k.json")).collect()
    assert len(rows) == len(TEXTS) and [r.n_tokens for r in rows if r.doc_id in (1, 2, 3)] == [0, 0, 0]
    assert bpe.encode_documents(docs(spark, []), bpe.vocabulary_path("word_bpe_49k.json")).collect() == []


def test_equal_hashes_never_stand_for_equal_text(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "run_hashes", lambda values, starts: (values[starts] % 3).astype(np.uint64))  # 0 too, of empty slots
    texts = [prose(i, 30) + " 'll 12" for i in range(40)] + ["", "a", "zebra zebra zebu"]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        codec, library = bpe.Codec(bpe.vocabulary_path(name)), Tokenizer.from_file(bpe.vocabulary_path(name))
        for _ in range(2):
            assert [x.tolist() for x in codec.encode(texts)] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_cuts_are_certain():
    codec = bpe.Codec(bpe.vocabulary_path("word_bpe_49k.json"))
    model = codec.encode_word.__self__
    word = "qzxqjvkwqxzjq".encode() * 30
    assert model.cuts(word)
    assert model.encode(word) == model._merge_long([*(model.plain[b] for b in word[:-1]), model.last[word[-1]]])


def test_token_files(spark):
    path = new_folder(spark, "test-tokens")
    manifest = token_files.write_tokens(docs(spark, TEXTS), path, bpe.vocabulary_path("byte_bpe_50k.json"), sequence=64)
    rows = sorted(token_files.read_tokens(spark, manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 4, 4, 5, 6, 7]
    codec, at = bpe.Codec(bpe.vocabulary_path("byte_bpe_50k.json")), 0
    text = {i: t for i, t, _ in TEXTS}
    for r in rows:
        ids = np.append(next(iter(codec.encode([text[r.doc_id]]))), 2).astype("<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    shard = token_files.TokenFile(manifest[-1]["path"])
    ids, mask = shard.sequence(0)
    assert len(ids) == len(mask) == 64
    assert token_files.write_tokens(docs(spark, []), path + "-none", bpe.vocabulary_path("byte_bpe_50k.json")) == []


def test_token_files_of_many_batches_and_pieces(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.vocabulary_path("byte_bpe_50k.json"))
    rows = [(i // 3, prose(i, 200), "s") for i in range(150)] + [(None, prose(i, 5), "s") for i in range(50)] + [(7, "same", "s")] * 20
    path = new_folder(spark, "test-pieces")
    manifest = token_files.write_tokens(docs(spark, rows), path, bpe.vocabulary_path("byte_bpe_50k.json"), sequence=8, shard_ids=3000)
    assert len(manifest) > len({x["task"] for x in manifest})
    got = sorted(token_files.read_tokens(spark, manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _, _ in rows), key=lambda i: (i is not None, i or 0))
    upto = 0
    for r in got:
        assert r.start == upto
        upto += r.n_tokens
    sums = Counter((i, zlib.crc32(np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes())) for i, t, _ in rows)
    assert sums == Counter((r.doc_id, r.ids_crc32) for r in got)


def test_ranges_cut_repeated_ids(spark):
    from strataquery.llm import shared

    rows = [(None if i % 3 == 0 else 5 if i % 3 == 1 else i, i * 7919 % 1009) for i in range(3000)]
    cut = shared.ranges(spark.createDataFrame(rows, "id long, tie long"), 1000, 50)
    keys = [(shared.LOWEST if i is None else i, t) for i, t in rows]
    part, first = cut.of(np.array([k[0] for k in keys]), np.array([k[1] for k in keys]))
    bounds = list(zip(cut.ids.tolist(), cut.ties.tolist()))
    assert bounds == sorted(set(bounds)) and len(cut) > 10
    assert part.tolist() == [sum(b <= k for b in bounds) for k in keys] and first.tolist() == [k in bounds for k in keys]
    assert np.bincount(part).max() < 600
    assert len(shared.ranges(spark.createDataFrame([], "id long, tie long"), 1000, 50)) == 1


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            luhn = sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits)))
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")) or kind == "card" and not (16 <= len(digits) <= 19 and luhn % 10 == 0) or kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_pii(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("aZ09.%+-_@ ()4\n\x01\x02é😀") for _ in range(rng.randint(0, 80))) for _ in range(400)]
    texts += ["a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "000255.1.1.01 256.1.1.1", "4111 1111 1111 1111", "1" * 5000, "a." * 3000 + "@x.y", "+1" + " " * 5000, None, ""]
    texts += [f"please write me at user{i}@mail.example.com today" for i in range(40)] + ["please write me at root@localhost today"]
    rows = {r.id: r for r in pii.find_pii(docs(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        assert [(s.kind, s.start, s.end) for s in rows[i].base] == plain_spans(t or "")
    assert [(s.kind, s.start, s.end) for s in rows[len(texts) - 1].added] == [("email", 19, 33)]
    masked = pii.mask_pii(docs(spark, [(1, "to a@b.c, 4111111111111111!", "s"), (2, None, "s"), (3, "clean", "s")]))
    assert {r.doc_id: r.text for r in masked.collect()} == {1: "to [EMAIL], [CARD]!", 2: None, 3: "clean"}
    assert pii.find_pii(docs(spark, [])).collect() == []


def test_pii_finds_addresses_with_zero_parts(spark):
    texts = ["at 10.0.0.1 now", "127.0.0.1", "192.168.0.1", "0.0.0.0", "00.1.1.1 000.000.00.0", "1.2.3.4", "0.0.0.256", "256.0.0.1", "0300.0.0.1", "0" * 3000 + ".0.0." + "0" * 3000]
    rows = {r.id: r for r in pii.find_pii(docs(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        found = [(s.start, s.end) for s in rows[i].base if s.kind == "ip"]
        assert found == [m.span() for m in re.finditer(PLAIN["ip"], t) if all(int(x) <= 255 for x in m.group().split("."))]
    assert [len(rows[i].base) for i in range(len(texts))] == [1, 1, 1, 1, 2, 1, 0, 0, 0, 1]
    masked = pii.mask_pii(docs(spark, [(1, "from 10.0.0.1 to 0.0.0.0", "s")]))
    assert masked.first().text == "from [IP] to [IP]"


def test_pii_patterns_need_seeds_of_many_texts(spark):
    one = " ".join(f"please write me at user{i}@mail.example.com today" for i in range(40))
    other = "please write me at root@localhost today"
    for lists, trusted in (([one], False), ([one] * 12, False), ([one + " " * i for i in range(9)], False), ([one + " " * i for i in range(10)], True)):
        rows = pii.find_pii(docs(spark, [(i, t, "s") for i, t in enumerate([*lists, other])])).collect()
        assert [[(s.kind, s.start, s.end) for s in r.added] for r in rows if r.id == len(lists)] == [[("email", 19, 33)] if trusted else []]


def test_pii_masks_as_brute_force_does(spark):
    rng = random.Random(9)
    parts = ["a@b.co", "1.2.3.4", "+49 30 1234567", "4111 1111 1111 1111", "+4111111111111111", "x", "é😀", "\ufeff", " ", "@", "9"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(300)] + ["\ufeffa@b.co\ufeff", None]

    def plain(text):
        spans, out, at = sorted((b, e, k) for k, b, e in plain_spans(text)), "", 0
        for b, e, kind in spans:
            if b >= at:
                out += text[at:b] + f"[{kind.upper()}]"
            at = max(at, e)
        return out + text[at:]

    got = {r.doc_id: r.text for r in pii.mask_pii(docs(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    assert all(got[i] == (None if t is None else plain(t)) for i, t in enumerate(texts))


def test_pii_of_texts_rich_in_spans(spark):
    import time

    seconds = []
    for n in (4000, 16_000):
        text = " ".join(f"user{i}@mail.example.com id{i}" for i in range(n))
        frame = docs(spark, [(1, text, "s")])
        began = time.time()
        row = pii.find_pii(frame).first()
        masked = pii.mask_pii(frame).first().text
        seconds.append(time.time() - began)
        assert len(row.base) == n and masked == " ".join(f"[EMAIL] id{i}" for i in range(n))
    assert seconds[1] < 8 * seconds[0] + 5


def test_pii_patterns_beside_long_words_and_hidden_addresses(spark):
    long = "w" * 300
    texts = [f"{long} {long} user{i}@mail.example.com today" for i in range(12)] + [f"{long} {long} root(at)mail.example.org today", f"{long} x root(at)mail.example.org"]
    rows = {r.id: r for r in pii.find_pii(docs(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    assert [(s.kind, s.start, s.end) for s in rows[12].added] == [("email", 602, 602 + len("root(at)mail.example.org"))] and rows[13].added == []


def test_quality(spark):
    junk = lambda i: " | ".join(prose(i, 30).upper().split()) + "!!"
    rows = [(i, junk(i) if i % 4 == 0 else prose(i, 60), "s") for i in range(400)] + [(1000, None, "s"), (1001, "", "s")]
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(400)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    frame = docs(spark, rows)
    got = {r.doc_id: r for r in quality.score_quality(frame, quality.fit_quality(frame, labels)).collect()}
    held = [i for i in range(400) if got[i].held_out]
    assert held == [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].predicted == (i % 4 != 0) for i in held]) > 0.97
    assert got[1000].score == got[1001].score and 0 <= got[1000].score <= 1
    assert len(quality.score_quality(frame, quality.fit_quality(frame, labels.limit(0))).collect()) == len(rows)


def test_quality_sums_and_minimum(spark, monkeypatch):
    rng = np.random.default_rng(3)
    texts = [prose(i, 20 + i % 30) if i % 5 else "".join(rng.choice(list("aB1 |!?$"), 80)) for i in range(300)]
    frame = spark.createDataFrame([(t, i % 5 != 0 and i % 2 == 0) for i, t in enumerate(texts)], "text string, positive boolean").repartition(21)
    x = quality.features(pa.array(texts))
    good = np.array([i % 5 != 0 and i % 2 == 0 for i in range(300)])
    sums = {k: quality.unpacked(n, raw) for k, n, raw in quality._sum_tree(frame, 21)}
    for kind, rows in ((0, x), (1, x[good])):
        want = quality.Moments.of(rows)
        assert sums[kind].n == len(rows) and np.allclose(sums[kind].products, want.products, atol=1e-3)
    monkeypatch.setattr(quality, "RIDGE", 0.3)
    y, z = (np.append(v, np.ones((len(v), 1)), axis=1) for v in (x[good], x))
    scale = 1 / np.sqrt(np.maximum(z.var(axis=0), 1e-6))

    def risk(w, prior):
        loss = lambda rows, sign: (((1 - sign * (rows @ w)) ** 2) / 4).mean()
        return prior * loss(y, 1) + max(0, loss(z, -1) - prior * loss(y, -1)) + 0.3 / len(y) / 4 * ((w[:-1] / scale[:-1]) ** 2).sum()

    for prior in (0.3, 0.8, 0.95):
        model = quality.fit_nnpu(quality.Moments.of(x[good]), quality.Moments.of(x), prior)
        least = risk(model.weights, prior)
        for _ in range(60):
            assert risk(model.weights + rng.normal(0, 0.02, len(model.weights)) * scale * rng.integers(0, 2, len(scale)), prior) >= least - 1e-6


def test_prior_of_a_mixture():
    rng = np.random.default_rng(1)
    bins = lambda v: np.histogram(v, bins=1000, range=(-6, 6))[0]
    mixed = np.concatenate([rng.normal(2, 1, 14_000), rng.normal(-2, 1, 6_000)])
    assert quality.estimated_prior(bins(rng.normal(2, 1, 8_000)), bins(mixed)) == pytest.approx(0.7, abs=0.05)


def test_quality_of_odd_tables(spark):
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(90)], "doc_id long, quality int, toxic int")
    rows = [(i % 90, prose(i, 30) if i % 3 else "| ! " * 20, "s") for i in range(180)] + [(None, "x", "s"), (None, None, None)]
    frame = docs(spark, rows).withColumn("score", F.lit("old")).withColumn("held_out", F.lit(1)).withColumn("a b.c", F.lit(2))
    model = quality.fit_quality(frame, labels)
    got = quality.score_quality(frame, model, keep=frame.columns)
    assert sorted(got.columns) == sorted(frame.columns + ["predicted"]) and got.count() == len(rows)
    assert dict(got.dtypes)["score"] == "double" and dict(got.dtypes)["held_out"] == "boolean"
    beside = quality.score_quality(frame, model, keep=frame.columns, names=("h", "s", "p"))
    assert beside.columns == [*frame.columns, "h", "s", "p"] and beside.where("score = 'old'").count() == len(rows)
    assert quality.score_quality(frame.limit(0), quality.fit_quality(frame.limit(0), labels)).collect() == []
    assert {r.score for r in quality.score_quality(frame, quality.fit_quality(frame, labels.limit(0))).collect()} == {0.5}


def test_mixing(spark):
    rows = [(i, prose(i, 10 + i % 7), ["a", "b", "c", None][min(i % 9, 3)]) for i in range(900)] + [(901, None, "zz"), (901, None, "zz")]
    plan = mixing.mix_plan(docs(spark, rows))
    got = plan.collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    weights = {s: [5, 2, 1][k % 3] for k, s in enumerate(["a", "b", "c", "zz", None])}
    stop, level = set(), 0.0
    while True:
        level = (1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in stop)) / max(1, sum(w for s, w in weights.items() if s not in stop))
        more = {s for s in weights if 2 * sizes[s] <= weights[s] * level} - stop
        if not more:
            break
        stop |= more
    target = {s: min(2 * sizes[s], weights[s] * level) for s in weights}
    for r in got:
        assert r["__source_size"] == sizes[r.source] and r["__target"] == pytest.approx(target[r.source])
        assert 0 <= r["__copies"] <= 2
    for s in "abc":
        taken = sum(r["__size"] * r["__copies"] for r in got if r.source == s)
        assert taken == pytest.approx(target[s], rel=0.25)
    assert mixing.emit(plan, ["doc_id"]).count() == sum(r["__copies"] for r in got)
    assert mixing.mix_plan(docs(spark, [])).collect() == []


def test_fingerprints(spark):
    rows = [*TEXTS, *((100 + i, prose(i % 30, 120), "s") for i in range(60))]
    got = fingerprint.fingerprint_documents(docs(spark, rows)).collect()
    order = sorted(((i is not None, i or 0), t or "") for i, t, _ in rows)  # rows of one id are equal here
    assert len(got) == len(rows)
    by_text = {}
    for r in got:
        for text in {t or "" for i, t, _ in rows if i == r.doc_id}:
            by_text.setdefault(text, set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    for r in got:
        k = next(n for n, (key, _) in enumerate(order) if key == ((r.doc_id is not None), r.doc_id or 0))
        if r.doc_id == 4:  # twice; see the test of the order
            continue
        text, following = order[k][1], order[(k + 1) % len(order)][1]
        edited = fingerprint.edited_text(text, following)
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
    assert fingerprint.fingerprint_documents(docs(spark, [])).collect() == []


def plain_fingerprints(texts, terms):
    """The definition, text by text: the hashes of a subset's terms are summed and spread."""
    one = lambda x, salt: int(fingerprint.finish(np.array([x], np.uint64), salt)[0])
    out = []
    for t in texts:
        raw = fingerprint.byte_view(pa.array([t]))
        words = {int(h) for h in fingerprint.words_of(*raw).hashes}
        own = sorted(words & terms or words)
        line = []
        for f in range(fingerprint.FAMILIES):
            for level in range(fingerprint.LEVELS):
                kept = [h for h in own if one(h ^ int(fingerprint._SEEDS[f, 0]), 1) >> (64 - level) == 0]
                total = sum(one(h ^ int(fingerprint._SEEDS[f, 1]), 2) for h in kept) % 2**64
                line.append(f"{one(total, len(kept)):016x}"[:5] if kept else "-")
        out.append(".".join(line))
    return out


def test_fingerprints_by_definition(spark):
    rows = [(i, (prose(i, 12 + i % 9) + f" rare{i // 2}") if i % 10 else "", "s") for i in range(80)] + [(90, "Only Here", "s"), (91, None, "s")]
    got = sorted(fingerprint.fingerprint_documents(docs(spark, rows)).collect(), key=lambda r: r.doc_id)
    texts = [t or "" for _, t, _ in rows]
    hashes = [{int(h) for h in fingerprint.words_of(*fingerprint.byte_view(pa.array([t]))).hashes} for t in texts]
    often = Counter(h for x in hashes for h in x)
    most = max(0.05 * len(rows), 2)
    terms = {h for h, n in often.items() if 2 <= n <= most}
    edited = [fingerprint.edited_text(t, n) for t, n in zip(texts, [*texts[1:], texts[0]])]
    own, changed = plain_fingerprints(texts, terms), plain_fingerprints(edited, terms)
    assert [r.fingerprint for r in got] == own and [r.edited_fingerprint for r in got] == changed

    def like(a, b):
        pairs = [(x, y) for x, y in zip(a.split("."), b.split(".")) if (x, y) != ("-", "-")]
        return sum(x == y for x, y in pairs) / len(pairs) if pairs else 1.0

    for i, r in enumerate(got):
        assert r.near_edited == pytest.approx(like(own[i], changed[i])) and r.near_next == pytest.approx(like(own[i], own[(i + 1) % len(own)]))


def test_fingerprints_follow_the_documented_order(spark):
    rows = [(4, prose(i, 30), "s") for i in range(40)] + [(None, prose(i, 9), "s") for i in range(20)] + [(9, "x", "s")]
    frame = docs(spark, rows)
    order = [(r.doc_id, r.text) for r in frame.orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).select("doc_id", "text").collect()]
    want = Counter((k, hashlib.sha256(fingerprint.edited_text(t, order[(i + 1) % len(order)][1]).encode()).hexdigest()) for i, (k, t) in enumerate(order))
    assert Counter((r.doc_id, r.edited_sha256) for r in fingerprint.fingerprint_documents(frame).collect()) == want


def lower_tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


@pytest.mark.parametrize("most", [class_lm.HELD, 30, 0])  # all words are held, some, none
def test_class_lm(spark, monkeypatch, most):
    monkeypatch.setattr(class_lm, "HELD", most)
    rows = [*TEXTS[:7], *((100 + i, prose(i, 50) + f" once{i} twice{i // 2} Twice{i // 2}", "s") for i in range(120))]
    frame = docs(spark, rows)
    learns = lambda i: zlib.crc32(str(i).encode()) % 7 != 2
    trained = class_lm.train(frame.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) != 2).select("text"))
    got = class_lm.score_documents(frame, trained).collect()
    counts = Counter(w for i, t, _ in rows if learns(i) for w in [*lower_tokens(t), None])
    n, v = sum(counts.values()), len(counts)
    text = {i: t for i, t, _ in rows}
    assert len(got) == len(rows)
    hash_of = lambda w: int(class_lm.words_of(*class_lm.byte_view(pa.array([w]))).hashes[0])
    known = {hash_of(w): w for w in counts if w is not None}
    klass = {known[int(k)]: int(c) for k, c in zip(trained.held.keys, trained.held.klass)} | {known[r.key % 2**64]: r.klass for r in trained.rest.collect()}
    assert set(klass) == set(known.values()) and len(trained.held.keys) <= most and all(0 < c < class_lm.CLASSES for c in klass.values())
    assert trained.rest.count() == 0 or {known[r.key % 2**64]: r.n for r in trained.rest.collect()}.items() <= counts.items()
    tokens_of, words_in = Counter(), Counter(klass.values())
    for w, c in klass.items():
        tokens_of[c] += counts[w]
    for r in got:
        own = lower_tokens(text[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (not learns(r.doc_id), len(own) + 1, sum(counts[w] > 0 for w in own) + 1, n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in [*own, None]))
        kinds = class_lm.endings(*(lambda raw, offsets: (raw, class_lm.words_of(raw, offsets)))(*class_lm.byte_view(pa.array([text[r.doc_id] or ""]))))
        path = [0, *(klass.get(w, trained.unseen[k]) for w, k in zip(own, kinds, strict=True)), 0]
        steps = sum(trained.transition[a, b] for a, b in zip(path, path[1:]))
        words = sum(math.log10((counts[w] + 1) / (tokens_of[c] + words_in[c] + 1)) for w, c in zip(own, path[1:]))
        assert r.score == pytest.approx(steps + words)
    assert np.allclose((10**trained.transition).sum(axis=1), 1)
    assert class_lm.score_documents(frame.limit(0), trained).collect() == []
    assert len(class_lm.score_documents(frame, class_lm.train(frame.limit(0).select("text"))).collect()) == len(rows)


def test_every_word_is_placed_by_its_neighbours(spark, monkeypatch):
    monkeypatch.setattr(class_lm, "HELD", 12)
    rng = random.Random(2)
    one, two = [f"a{i}" for i in range(5)], [f"b{i}" for i in range(5)]
    texts = [" ".join(rng.choice(side) for side in (one, two) * 20) for _ in range(60)]
    texts += [f"a1 {w} a2 {w} a0 {w} a3" for w in ("new", "odd")] + [f"b1 {w} b2 {w} b0 {w} b3" for w in ("rare", "last")]
    trained = class_lm.train(docs(spark, [(i, t, "s") for i, t in enumerate(texts)]).select("text"))
    hash_of = lambda w: int(class_lm.words_of(*class_lm.byte_view(pa.array([w]))).hashes[0])
    klass = {int(k): int(c) for k, c in zip(trained.held.keys, trained.held.klass)} | {r.key % 2**64: r.klass for r in trained.rest.collect()}
    in_one, in_two = ({klass[hash_of(w)] for w in words} for words in ((*one, "rare", "last"), (*two, "new", "odd")))
    assert not in_one & in_two


@pytest.mark.parametrize("most", [class_lm.HELD, 25, 0])
def test_transitions_count_every_bigram(spark, monkeypatch, most):
    monkeypatch.setattr(class_lm, "HELD", most)
    texts = [prose(i, 40) + f" once{i} twice{i // 2} alone{i}" for i in range(60)]
    trained = class_lm.train(docs(spark, [(i, t, "s") for i, t in enumerate(texts)]).select("text"))
    hash_of = lambda w: int(class_lm.words_of(*class_lm.byte_view(pa.array([w]))).hashes[0])
    klass = {int(k): int(c) for k, c in zip(trained.held.keys, trained.held.klass)} | {r.key % 2**64: r.klass for r in trained.rest.collect()}
    counts = np.zeros((class_lm.CLASSES, class_lm.CLASSES))
    for t in texts:
        path = [0, *(klass[hash_of(w)] for w in lower_tokens(t)), 0]
        np.add.at(counts, (path[:-1], path[1:]), 1)
    assert trained.transition == pytest.approx(np.log10(class_lm.transitions(counts)))


def test_exchange_takes_neighbours_that_are_no_items():
    ahead = np.zeros((7, 5))  # six words that never stand beside each other, and the end
    ahead[:3, 3] = ahead[3:6, 4] = 9
    apart = class_lm.Bigrams(np.zeros((7, 7)), ahead, ahead[:, [0, 1, 2, 4, 3]], np.zeros((5, 5)))
    assert class_lm.exchange_classes(apart, classes=5, start=np.array([1, 2, 1, 2, 2, 1, 0])).tolist() in ([1, 1, 1, 2, 2, 2, 0], [2, 2, 2, 1, 1, 1, 0])


def test_no_single_move_after_an_exchange_is_likelier():
    rng = np.random.default_rng(1)
    classes, words = 5, 20
    items, others = [*range(8), words - 1], [*range(8, words - 1)]
    full = rng.integers(0, 6, (words, words)).astype(float)
    fixed = rng.integers(1, classes, len(others))
    m = np.eye(classes)[fixed]
    every = class_lm.Bigrams(full[np.ix_(items, items)], full[np.ix_(items, others)] @ m, full[np.ix_(others, items)].T @ m, m.T @ full[np.ix_(others, others)] @ m)

    def likelihood(klass):
        whole = np.zeros(words, int)
        whole[items], whole[others] = klass, fixed
        member = np.eye(classes)[whole]
        g = member.T @ full @ member
        assert g == pytest.approx(every.of_classes(np.array(klass)))
        f = lambda x: (x * np.log(np.maximum(x, 1e-300))).sum()
        return f(g) - f(g.sum(axis=0)) - f(g.sum(axis=1))

    start = np.array([*rng.integers(1, classes, 8), 0])
    klass = class_lm.exchange_classes(every, classes=classes, rounds=50, start=start)
    best = likelihood(klass)
    assert best > likelihood(start)
    assert all(likelihood([*klass[:i], c, *klass[i + 1 :]]) <= best + 1e-9 for i in range(8) for c in range(1, classes))


def test_exchange_finds_two_languages():
    counts = np.zeros((9, 9))
    counts[:4, :4] = counts[4:8, 4:8] = 10
    counts[8, :8] = counts[:8, 8] = 1
    klass = class_lm.exchange_classes(counts, classes=3)
    assert len(set(klass[:4])) == len(set(klass[4:8])) == 1 and klass[0] != klass[4] and klass[8] == 0


def test_url_filter(spark):
    rules = [url_filter.Rule("block", "*.ads?.*", "*", "ads"), url_filter.Rule("block", "*", "/p*/x?", "px"), url_filter.Rule.site("allow", "e.com", "/a/")]
    texts = [(".ads1.net", "/"), (".ads.net", "/"), (".adsé.net", "/"), (".h", "/pp/xé"), (".h", "/x/p"), (".www.e.com", "/a/b"), (".fe.com", "/a/"), (".e.com", "/b"), ("." + "h" * 9000 + ".e.com", "/a/")]
    got = url_filter.Automaton(rules).match([h.encode() + b"\xff" + p.encode() for h, p in texts])
    assert got.tolist() == [[True, False, False], [False] * 3, [True, False, False], [False, True, False], [False] * 3, [False, False, True], [False] * 3, [False] * 3, [False, False, True]]
    pages = spark.createDataFrame([(1, "http://WWW.Example.com/en/x?y#z"), (2, None), (3, "mailto:x"), (4, "https://a.net/fr/1"), (4, "https://a.net#/fr/"), (5, "x://casino-win.org")], "page_id long, url string")
    sites = [url_filter.Rule.site(*r) for r in url_filter.SITE_RULES]
    found = url_filter.judge_urls(pages, sites, [url_filter.Rule("block", "*casino*", "*", "c")]).collect()
    assert sorted(map(tuple, found), key=str) == sorted(
        [(1, "www.example.com", "/en/x", "www.example.com/en/", "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "a.net", "/fr/1", "net/fr/", "block"), (4, "a.net", "", None, "allow"), (5, "casino-win.org", "", None, "block")], key=str
    )


def plain_links(texts):
    out = set()
    shingles = [near_dup.shingles(pa.array([t]))[0].tolist() for t in texts]
    bags = [Counter(s) for s in shingles]
    for i, a in enumerate(shingles):
        for j in range(i):
            b, row = shingles[j], [0] * (len(shingles[j]) + 1)
            if not a or not b or min(len(a), len(b)) < 0.8 * max(len(a), len(b)):
                continue
            shared = (bags[i] & bags[j]).total()  # no order can match more
            if shared < 0.8 * (len(a) + len(b) - shared):
                continue
            for x in a:
                last = 0
                for k, y in enumerate(b):
                    last, row[k + 1] = row[k + 1], max(row[k + 1], row[k], last + 1 if x == y else 0)
            if row[-1] >= 0.8 * (len(a) + len(b) - row[-1]):
                out.add((j, i))
    return out


def test_rules_from_a_table_and_odd_tables(spark):
    listed = spark.createDataFrame([(2, "allow", None, "/x*", None), (1, "block", "*.e.com", None, "e")], "place int, verdict string, host string, path string, name string")
    rules = url_filter.rules_of(listed)
    assert rules == [url_filter.Rule("block", "*.e.com", "*", "e"), url_filter.Rule("allow", "*", "/x*", "*/x*")]
    with pytest.raises(ValueError):
        url_filter.rules_of(listed, most=1)
    pages = spark.createDataFrame([(1, "http://a.e.com/x", "h", "p", "r"), (None, "http://b.org/x1", "h", "p", "r")], "page_id long, url string, host string, path string, rule string")
    found = url_filter.judge_urls(pages, [], rules, default="block").collect()
    assert sorted((r.host, r.path, r.rule, r.verdict) for r in found) == [("a.e.com", "/x", None, "block"), ("b.org", "/x1", None, "allow")]
    assert url_filter.judge_urls(pages.limit(0), [], rules).collect() == []


def test_aligned_equals_brute_force_on_repetitive_texts():
    import time

    rng = np.random.default_rng(7)
    for n in [5, 20, 60, 150, 300] * 8:
        a = rng.integers(0, rng.choice([1, 2, 3, 50]) + 1, n).astype(np.uint64)
        b = np.delete(a, rng.integers(0, n, rng.integers(0, max(1, n // 5))))
        b = np.insert(b, rng.integers(0, len(b) + 1, rng.integers(0, max(1, n // 6))), rng.integers(0, 4))
        row = [0] * (len(b) + 1)
        for x in a.tolist():
            last = 0
            for k, y in enumerate(b.tolist()):
                last, row[k + 1] = row[k + 1], max(row[k + 1], row[k], last + 1 if x == y else 0)
        assert near_dup.aligned(a, b) == (row[-1] >= 0.8 * (len(a) + len(b) - row[-1]))
    began = time.process_time()
    same = np.full(16_000, 7, np.uint64)
    other = same.copy()
    other[::9] = np.arange(len(other[::9])) + 100
    near_dup.aligned(same, other)
    assert near_dup.aligned(np.append(1, same).astype(np.uint64), np.append(same, 2).astype(np.uint64))
    assert time.process_time() - began < 4


def test_near_duplicates(spark, monkeypatch):
    rng = random.Random(3)
    texts = []
    for g in range(12):
        base = [f"{rng.choice(WORDS)}{rng.randint(0, 400)}" for _ in range(rng.choice([3, 30, 120]))]
        for _ in range(rng.choice([1, 2, 9])):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = f"new{rng.randint(0, 9**6)}"
            texts.append(" ".join(copy))
    texts += ["", None, "", texts[0], texts[0].upper()]
    clean = [t or "" for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in plain_links(clean) | {(i, j) for j in range(len(clean)) for i in range(j) if clean[i] == clean[j]}:
        parent[max(root(i), root(j))] = min(root(i), root(j))
    want = [min(j for j in range(len(texts)) if root(j) == root(i)) for i in range(len(texts))]
    frame = docs(spark, [(i, t, "s") for i, t in enumerate(texts)])
    for rounds, tile in ((near_dup.ROUNDS, near_dup.TILE), (0, 3)):  # by rounds, and by tiles alone
        monkeypatch.setattr(near_dup, "ROUNDS", rounds)
        monkeypatch.setattr(near_dup, "TILE", tile)
        got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(frame).collect()}
        assert [got[i] for i in range(len(texts))] == want
    kept = near_dup.keep_one(docs(spark, [(i, t, "s") for i, t in enumerate(texts)] + [(0, texts[0], "s")]))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))
    assert near_dup.near_duplicates(docs(spark, [])).collect() == []


def test_classes_of_null_and_repeated_ids_stay_apart(spark):
    a, b, c, d, e = (prose(i, 60) for i in range(50, 55))
    rows = [(None, a, "s"), (None, b, "s"), (None, b, "t"), (5, c, "s"), (5, d, "s"), (0, e, "s"), (None, e, "s")]
    got = near_dup.near_duplicates(docs(spark, rows)).collect()
    assert len(got) == len(rows) and len({r.label for r in got}) == 5
    assert all((x.tid == y.tid) == (x.label == y.label) for x in got for y in got)
    kept = near_dup.keep_one(docs(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted([("None", a), ("None", b), ("5", c), ("5", d), ("0", e)])


def test_short_texts_lose_no_link(spark):
    rng = random.Random(8)
    texts = []
    for n in [8] * 30 + [9] * 30 + [10, 12, 14, 17, 20, 26, 34] * 8:  # words; one more at the end or the begin
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
        more = f"w{rng.randint(0, 10**6)}"
        texts += [" ".join(base), " ".join([*base, more] if rng.random() < 0.5 else [more, *base])]
    common = [f"all{i}" for i in range(12)]  # a line that many unlike texts have
    texts += [" ".join(common + [f"v{rng.randint(0, 10**6)}" for _ in range(8)]) for _ in range(30)]
    links = plain_links(texts)
    assert len(links) == 116
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(docs(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    assert {(i, j) for j in got for i in got if i < j and got[i] == got[j]} == links


def test_rarest_kmers_of_alike_texts_meet():
    rng = np.random.default_rng(4)
    for n in range(1, near_dup.REACH + 1):
        for m in range(n, int(n / near_dup.SIMILARITY + 1e-9) + 1):
            least = int(np.ceil((n + m) * near_dup.SIMILARITY / (1 + near_dup.SIMILARITY) - 1e-9))
            if least > n:
                continue
            for _ in range(5):
                pool = rng.integers(0, 2**63, n + m - least).astype(np.uint64)
                a, b = rng.permutation(pool[:n]), rng.permutation(pool[n - least :])
                common = np.sort(rng.choice(pool, len(pool) // 2, replace=False))
                counts = rng.integers(2, 5, len(common))
                assert set(near_dup.rarest(a, common, counts).tolist()) & set(near_dup.rarest(b, common, counts).tolist())


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7), (None, 3)] + [(200, x) for x in range(201, 260)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100} | {i: 200 for i in range(200, 260)}


def test_sql(spark):
    import duckdb

    from strataquery.llm import queries

    at = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"create view {t} as select * from '{at}/{t}.parquet'")
    for name, sql in queries.SQL.items():
        frame = queries.QUERIES[name](spark, at)
        columns = sorted(frame.columns)
        result = con.sql(sql)
        places = [result.columns.index(c) for c in columns]
        assert sorted(repr([r[c] for c in columns]) for r in frame.collect()) == sorted(repr([r[i] for i in places]) for r in result.fetchall())


@pytest.fixture(scope="module")
def small(spark):
    return "/root/testdata/sf0.001", spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()


def test_queries_keep_their_contracts(spark, small):
    """Each query over its whole table, against the library, re and hashlib where these can say what is right."""
    from tokenizers import Tokenizer

    from strataquery.llm.queries import QUERIES

    at, rows = small
    text = {r.doc_id: r.text or "" for r in rows}
    order = sorted(text)
    got = {name: QUERIES[name](spark, at) for name in ("op2_bpe", "op3_pii", "op4_quality", "op6_fingerprints", "op7_class_lm", "op9_near_dup", "op10_token_files")}
    found = {name: {r.doc_id: r for r in frame.collect()} for name, frame in got.items()}
    assert all(sorted(x) == order for x in found.values())
    sha = lambda data: hashlib.sha256(data).hexdigest()
    word, byte = (Tokenizer.from_file(bpe.vocabulary_path(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    upto = 0
    counts = Counter(w for i in order if zlib.crc32(str(i).encode()) % 7 != 2 for w in [*lower_tokens(text[i]), None])
    n, v = sum(counts.values()), len(counts)
    for k, i in enumerate(order):
        ids = word.encode(text[i], add_special_tokens=False).ids
        r = found["op2_bpe"][i]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(word.decode(ids, skip_special_tokens=False).encode()))
        r, spans = found["op3_pii"][i], plain_spans(text[i])
        assert r.base_sha256 == sha(",".join(f"{a}:{b}:{c}" for a, b, c in spans).encode()) and [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == kind for s in spans) for kind in pii.KINDS]
        assert set(f"{a}:{b}:{c}" for a, b, c in spans) <= set(r.spans.split(",")) | {""}
        r = found["op4_quality"][i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        r = found["op6_fingerprints"][i]
        assert (r.n_chars, r.edited_sha256) == (len(text[i]), sha(fingerprint.edited_text(text[i], text[order[(k + 1) % len(order)]]).encode()))
        r, own = found["op7_class_lm"][i], [*lower_tokens(text[i]), None]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(counts[w] > 0 for w in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own)) and r.score < 0
        ids = np.array([*byte.encode(text[i], add_special_tokens=False).ids, 2], "<u4")
        r = found["op10_token_files"][i]
        assert (r.start, r.n_tokens, r.ids_crc32) == (upto, len(ids), zlib.crc32(ids.tobytes()))
        upto += len(ids)
    linked = {frozenset(order[x] for x in pair) for pair in plain_links([text[i] for i in order])}
    root = {i: found["op9_near_dup"][i].class_id for i in order}
    assert all(len({root[i] for i in pair}) == 1 for pair in linked)
    assert all(root[i] == min(j for j in order if root[j] == root[i]) for i in order)


def test_pipeline(spark, small):
    """Every stage on what the one before kept, against brute force; the classifier's own scores are taken as given."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    at, _ = small
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and names[0] == "quality classifier" and names[-1] == "BPE encoding and decoding"
    docs_ = spark.read.parquet(f"{at}/documents.parquet")
    columns, steps = docs_.columns, [docs_]
    for name, stage in corpus_pipeline.STAGES:
        steps.append(corpus_pipeline.materialize(stage(spark, steps[-1], at), "test"))
        assert name == names[-1] or steps[-1].columns == columns
    kept = [[r.asDict() for r in x.collect()] for x in steps]
    model = quality.fit_quality(docs_, spark.read.parquet(f"{at}/labels.parquet"))
    assert sorted(r["doc_id"] for r in kept[1]) == sorted(r.doc_id for r in quality.score_quality(docs_, model).where("score >= 0.3").collect())
    parent = {r["doc_id"]: r["doc_id"] for r in kept[1]}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    first = sorted(kept[1], key=lambda r: r["doc_id"])
    texts = [r["text"] or "" for r in first]
    same = {(i, j) for j in range(len(texts)) for i in range(j) if texts[i] == texts[j]}
    for i, j in plain_links(texts) | same:
        x, y = sorted((root(first[i]["doc_id"]), root(first[j]["doc_id"])))
        parent[y] = x
    assert sorted(r["doc_id"] for r in kept[2]) == sorted({root(x) for x in parent})
    before = {r["doc_id"]: r["text"] for r in kept[2]}
    for r in kept[3]:
        text, out, end = before[r["doc_id"]] or "", "", 0
        for b, e, kind in sorted((b, e, k) for k, b, e in plain_spans(text)):
            out, end = (out + text[end:b] + f"[{kind.upper()}]" if b >= end else out), max(end, e)
        assert r["text"] == out + text[end:] and r["n_chars"] == len(r["text"])
    plan = {r["doc_id"]: r["__copies"] for r in mixing.mix_plan(steps[3]).collect()}
    assert Counter(r["doc_id"] for r in kept[4]) == Counter({i: c for i, c in plan.items() if c})
    library = Tokenizer.from_file(bpe.vocabulary_path("word_bpe_49k.json"))
    after = {r["doc_id"]: r["text"] for r in kept[4]}
    assert len(kept[5]) == len(kept[4]) and all(r["token_ids"] == library.encode(after[r["doc_id"]] or "", add_special_tokens=False).ids for r in kept[5])


def test_pipeline_of_odd_tables(spark, small):
    import corpus_pipeline

    at, _ = small
    rows = [*TEXTS, (None, None, None), (4, None, "b"), (11, prose(8, 30_000), "b"), *((20 + i, prose(i, 60) + " a@b.org 10.0.0.1", "b") for i in range(6))]
    odd = docs(spark, rows).withColumn("score", F.lit(1)).withColumn("label", F.lit("x")).withColumn("kind", F.lit(None).cast("string")).withColumn("tid", F.lit(b"1"))
    for frame in (odd, odd.limit(0)):
        here = frame
        for name, stage in corpus_pipeline.STAGES:
            before, here = here, corpus_pipeline.materialize(stage(spark, here, at), "test")
            assert name == "BPE encoding and decoding" or here.columns == odd.columns, name
        assert before.count() == here.count()
    salted = mixing.mix_plan(odd)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(mixing, "BROADCAST_SOURCES", 0)
        key = lambda r: repr((r.doc_id, r.text, r["__copies"], r["__target"]))
        assert sorted(map(key, mixing.mix_plan(odd).collect())) == sorted(map(key, salted.collect()))


def test_tidy_passes_all_batches_and_errors():
    from strataquery.llm.shared import tidy

    assert list(tidy(lambda batches: (b + 1 for b in batches))(iter([1, 2]))) == [2, 3]

    def fails(batches):
        yield next(batches)
        raise ValueError("odd")

    ended = tidy(fails)(iter([1]))
    assert next(ended) == 1
    with pytest.raises(ValueError, match="odd"):
        next(ended)
