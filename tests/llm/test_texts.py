"""Operators that read each text by itself, against the libraries and brute force."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from haulage.llm import bpe, compression_classifier, packing, quality_rules, token_files, toxicity, training
from haulage.llm.chunks import PieceEncoder, library_encode
from haulage.llm.queries import BYTE_BPE, QUERIES, WORD_BPE, table
from haulage.llm import text as word_text
from haulage.llm.text import find_words, hash_words
from haulage.session import fresh_warehouse
from tests.conftest import DATA
from tests.llm.conftest import ROWS

ALPHABET = [
    "a", "B", "the", " ", "  ", "\n", "\t", "é", "é", "́", " ́", "İ", "Σ", "ΑΣ ", "'s", "'LL", "<|endoftext|>",
    " ", " ", "1", "23", "!?", "\x0b", "\x1c", "\x85", "👍", "中", "​", " <|endoftext|> ", "ﬁ", "﻿",
    "　", "<|", "²", "\x00", "\x1f", "_", "ß",
]


def texts(n=4000, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choices(ALPHABET, k=rnd.randrange(14))) for _ in range(n)]


def test_words_are_runs_without_ascii_blanks():
    cases = [t.encode() for t in texts()] + [b"", b" ", b"a"]
    words = find_words(cases)
    found = [words.buffer[s:e].tobytes() for s, e in zip(words.starts, words.ends, strict=True)]
    expected = [re.findall(rb"[^\x20\x09-\x0D]+", t) for t in cases]
    assert found == [w for ws in expected for w in ws] and words.counts.tolist() == list(map(len, expected))
    hashes = hash_words(words)
    assert len(set(zip(found, hashes.tolist(), strict=True))) == len(set(found)) == len(set(hashes.tolist()))


@pytest.mark.parametrize("path", [WORD_BPE, BYTE_BPE])
@pytest.mark.parametrize("kept", [50, 100_000])
def test_pieces_give_what_the_library_gives_for_whole_texts(path, kept):
    own = PieceEncoder(bpe.checked_encoder(path).encode, bpe.codec(path).blanks, kept)
    flat, lengths = library_encode(path)(texts())
    cases = [t.encode() for t in texts()]
    found = [x for k in range(0, len(cases), 100) for x in own.batch(cases[k : k + 100])]
    assert [len(x) for x in found] == lengths.tolist() and np.array_equal(np.concatenate(found), flat)


def test_contiguous_ranks_against_the_library():
    own = bpe.Bpe(WORD_BPE)
    flat, lengths = own.encode(texts(seed=3))
    expected, counts = library_encode(WORD_BPE)(texts(seed=3))
    assert np.array_equal(flat, expected) and np.array_equal(lengths, counts)


def bpe_digests(text):
    tokenizer = Tokenizer.from_file(WORD_BPE)
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    decoded = tokenizer.decode(ids, skip_special_tokens=False)
    return (
        len(ids),
        hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
        hashlib.sha256(decoded.encode()).hexdigest(),
    )


def test_bpe(odd, none):
    found = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_texts(odd, WORD_BPE).collect())
    assert found == sorted((str(k), *bpe_digests(t)) for k, t, _ in ROWS)
    assert bpe.encode_texts(none, WORD_BPE).count() == 0


def check_packed(rows, documents, limits, end=2):
    tokenizer = Tokenizer.from_file(WORD_BPE)
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for key, text in documents:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [end]
        at = 0
        for r in sorted(pieces[key], key=lambda r: r.start):
            part = np.array(ids[at : at + r.length], dtype="<u4")
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(part.tobytes()))
            at += r.length
        assert at == len(ids)
    padding = total = 0
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= limits.tokens and len(parts) <= limits.segments
        assert sum(r.loss_tokens for r in parts) <= limits.loss
        total, padding = total + at, padding + (limits.tokens - at if at & (at - 1) else 0)
    return padding / total


def test_packing_of_all_documents(spark):
    rows = QUERIES["op2_packing"](spark, DATA).collect()
    documents = [(r.doc_id, r.text) for r in table(spark, DATA, "documents").collect()]
    assert check_packed(rows, documents, packing.Limits()) < 0.02


@pytest.mark.parametrize(
    "limits", [packing.Limits(64, 3, 64), packing.Limits(100, 2, 30), packing.Limits(7, 1, 2, 1), packing.Limits(1, 1, 1)]
)
def test_packing_limits(spark, limits):
    documents = [(k, t) for k, (_, t, _) in enumerate(ROWS) if k != 8]
    df = spark.createDataFrame(documents, "doc_id long, text string").repartition(2)
    check_packed(packing.pack(df, WORD_BPE, limits).collect(), documents, limits)


@pytest.mark.parametrize("words", [4, 10, 29, 59])
def test_many_tiny_texts_need_no_padding(spark, words):
    documents = [(k, " ".join(["cat"] * words)) for k in range(4500)]
    df = spark.createDataFrame(documents, "doc_id long, text string").repartition(2)
    assert check_packed(packing.pack(df, WORD_BPE).collect(), documents, packing.Limits()) < 0.02


def test_prompts_bear_no_loss(spark):
    data = [(1, "what is this ?", "a cat"), (2, None, "yes"), (3, "only asked", None)]
    df = spark.createDataFrame(data, "doc_id long, prompt string, text string")
    rows = packing.pack(df, WORD_BPE, packing.Limits(8, 4, 4), prompt="prompt").collect()
    tokenizer = Tokenizer.from_file(WORD_BPE)
    for key, prompt, text in data:
        own = [r for r in rows if r.doc_id == key]
        spoken = len(tokenizer.encode(text or "", add_special_tokens=False).ids) + 1
        silent = len(tokenizer.encode(prompt or "", add_special_tokens=False).ids)
        assert sum(r.loss_tokens for r in own) == spoken and sum(r.length for r in own) == spoken + silent
        whole = b"".join(bytes(r.ids) for r in sorted(own, key=lambda r: r.start))
        assert len(whole) == 4 * (spoken + silent)


def test_packing_of_odd_rows(odd, none):
    rows = packing.pack(odd, WORD_BPE).collect()
    assert sum(r.length for r in rows) == sum(bpe_digests(t)[0] + 1 for _, t, _ in ROWS)
    assert packing.pack(none, WORD_BPE).count() == 0
    with pytest.raises(ValueError, match="at least 1"):
        packing.Limits(tokens=0)


@pytest.mark.parametrize("top", [1, 255, 256, 65_535, 65_536, 2**32 - 1])
def test_bytes_round_trip(top):
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1000):
        values = rng.integers(0, top, n, endpoint=True, dtype=np.uint64).astype(np.uint32)
        control, data = token_files.to_bytes(values)
        assert len(control) == -(-n // 4) and np.array_equal(token_files.from_bytes(control, data, n), values)


def test_frequent_ids_come_first():
    values, places = token_files.ranked(np.array([9, 5, 5, 7, 7, 1, 5]))
    assert values.tolist() == [5, 7, 1, 9] and values[places].tolist() == [9, 5, 5, 7, 7, 1, 5]


def test_token_files(spark):
    tokenizer, at = Tokenizer.from_file(BYTE_BPE), 0
    found = {r.doc_id: r for r in QUERIES["op3_token_files"](spark, DATA).collect()}
    for r in table(spark, DATA, "documents").orderBy("doc_id").collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0]
        own = found.pop(r.doc_id)
        assert (own.start, own.n_tokens) == (at, len(ids))
        assert own.ids_crc32 == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        at += len(ids)
    assert not found


def test_token_files_of_odd_rows(spark, odd, none):
    path = f"{fresh_warehouse(spark)}/t"
    token_files.write_tokens(odd, path, BYTE_BPE)
    rows = token_files.read_tokens(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted((k for k, _, _ in ROWS), key=lambda k: (k is not None, k))
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows[:-1])]).tolist()
    assert all(len(r.ids) == 4 * r.n_tokens and zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in rows)
    empty = f"{fresh_warehouse(spark)}/t"
    token_files.write_tokens(none, empty, BYTE_BPE)
    assert token_files.read_tokens(spark, empty).count() == 0


def base_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    spread = {}
    for width in (4, 5):
        seen = Counter(tuple(words[i : i + width]) for i in range(len(words) - width + 1))
        spread[width] = len(
            {j for i in range(len(words) - width + 1) if seen[tuple(words[i : i + width])] > 1 for j in range(i, i + width)}
        )
    longest = 0
    while longest < len(words) and len({tuple(words[i : i + longest + 1]) for i in range(len(words) - longest)}) < len(words) - longest:
        longest += 1
    lines = [line for line in text.split("\n") if line.strip(" \t\n\r\x0b\x0c")]
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    return [len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), spread[5], spread[4], longest]


def test_quality_measures_against_brute_force():
    rnd = random.Random(5)
    cases = [" ".join(rnd.choices("abc" if i % 2 else "abcdefghijk#é", k=rnd.randrange(60))) for i in range(400)]
    cases += ["x\nx\n\n \nx", "a b c d e\n" * 4] + texts(300) + ["the same line\n" * 30 + "end"]
    found = quality_rules.measure([c.encode() for c in cases], quality_rules.Rules())
    for k, case in enumerate(cases):
        assert [int(column[k]) for column in found[:7]] == base_measures(case), case


def test_quality_rules(spark, odd, none):
    found = {(r.doc_id, r.n_words): r for r in quality_rules.apply_rules(odd).collect()}
    assert found[2, 0].base_failed and found[3, 0].base_failed and found[4, 0].base_failed and not found[2, 0].kept
    assert found[10, 13].base_failed and found[8, 30_000].kept and found[11, 60].kept
    carried = quality_rules.apply_rules(odd, carry=True).where("kept").select("_row.*")
    assert carried.columns == odd.columns and carried.count() == sum(r.kept for r in found.values())
    assert quality_rules.apply_rules(none).count() == 0
    passage = " ".join(f"w{i}" for i in range(80))
    df = spark.createDataFrame([(1, f"{passage} {'between ' * 3}{passage}"), (2, passage)], "doc_id long, text string")
    rules = quality_rules.Rules(max_repeat_percent=100, max_covered_percent=100)
    assert {r.doc_id: r.kept for r in quality_rules.apply_rules(df, rules).collect()} == {1: False, 2: True}


def test_each_limit_rejects_what_the_base_rule_keeps(spark):
    words = [f"w{i}" for i in range(4000)]
    pasted = words[:3000] + words[100:160] + words[3000:]
    short = [w for k in range(300) for w in (f"u{k}", *(["a", "b", "c", "d"] if k % 5 == 0 else [f"v{k}"]))]
    some = [w for k in range(300) for w in (f"u{k}", f"x{k}", f"y{k}", *(["a", "b", "c", "d"] if k % 10 == 0 else [f"v{k}"]))]
    df = spark.createDataFrame(
        [(1, " ".join(pasted)), (2, " ".join(short)), (3, " ".join(some)), (4, " ".join(words[:3000] + words[100:150]))],
        "doc_id long, text string",
    )
    found = {r.doc_id: (r.base_failed, r.kept) for r in quality_rules.apply_rules(df).collect()}
    assert found == {1: (False, False), 2: (False, False), 3: (False, True), 4: (False, True)}


def made(n, seed, mark=None):
    rnd = random.Random(seed)
    words = ["".join(rnd.choices("aeioutrnsl", k=rnd.randrange(2, 8))) for _ in range(800)]
    found = []
    for k in range(n):
        text = rnd.choices(words, k=rnd.randrange(20, 90))
        if mark and k % 2:
            text[rnd.randrange(len(text))] = rnd.choice(mark)
        found.append((k, " ".join(text), k % 2))
    return found


def held_out_accuracy(spark, module, data, label):
    df = spark.createDataFrame([(k, t) for k, t, _ in data], "doc_id long, text string")
    marks = spark.createDataFrame([(k, y) for k, _, y in data], f"doc_id long, {label} int")
    model = module.fit(df, marks)
    rows = module.score(df, model, 0.5).collect()
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    right = [r.predicted == data[r.doc_id][2] for r in rows if r.held_out]
    return sum(right) / len(right)


def test_toxicity_learns_on_held_out_texts(spark):
    data = made(700, 2, mark=["grumbleworth", "grumblewort", "snarkfist", "snarkfists"])
    assert held_out_accuracy(spark, toxicity, data, "toxic") > 0.95


def test_compression_learns_on_held_out_texts(spark):
    data = [(k, " ".join(w + "$#" for w in t.split()) if y == 0 else t, y) for k, t, y in made(600, 4)]
    assert held_out_accuracy(spark, compression_classifier, data, "quality") > 0.95


def test_gradients_of_the_network():
    shape = toxicity.Shape(window=5, stride=2, buckets=64, vector=3, state=2, attention=2)
    network = toxicity.Network(shape)
    network.p = {k: v.astype(np.float64) for k, v in network.p.items()}
    x = toxicity.inputs([b"aa bb cc dd ee ff gg", b"bb", b"", b"x y z aa"], shape)
    labels = np.resize([1.0, 0.0], len(x.windows))
    grads = {}

    def keep(name, rows, grad, rate=None):
        grads[name] = np.zeros_like(network.p[name])
        grads[name][rows] += grad

    network._step = keep
    network.learn(x, x.windows, labels, np.ones(len(labels)))

    def loss():
        guess = toxicity.sigmoid(network.forward(network.vectors(x).astype(float), x.windows))
        return -np.log(np.where(labels > 0, guess, 1 - guess)).mean()

    for name, values in network.p.items():
        at = np.unravel_index(np.abs(grads[name]).argmax(), values.shape)
        was = values[at]
        values[at] = was + 1e-2
        up = loss()
        values[at] = was - 1e-2
        slope = (up - loss()) / 2e-2
        values[at] = was
        assert slope == pytest.approx(grads[name][at], rel=1e-2, abs=1e-6)


@pytest.mark.parametrize(("module", "label", "prior"), [(toxicity, "toxic", 0.0), (compression_classifier, "quality", 0.5)])
def test_classifiers_on_odd_rows(spark, odd, none, labels, module, label, prior):
    model = module.fit(odd, labels, label)
    rows = module.score(odd, model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert module.score(none, model).count() == 0
    nothing = labels.where("doc_id < 0")
    assert {r.score for r in module.score(odd, module.fit(odd, nothing, label)).collect()} == {prior}
    module.fit(none, labels, label)


def test_a_drawn_id_of_many_rows_stays_off_the_driver(spark, monkeypatch):
    rows = [(k, f"text {k}") for k in range(1, 30)] + [(7, f"copy {k:04}") for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 30)], "doc_id long, toxic int")
    sizes, collect = [], type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: sizes.append(len(found := collect(self))) or found)
    sample, totals = training.labelled_sample(df, labels, "toxic", 12, 1 << 10)
    assert max(sizes) <= 24
    order = [tuple(r) for r in collect(df.orderBy(F.xxhash64("doc_id"), "doc_id", F.col("text").cast("binary")))]
    fit = [(k, t.encode()) for k, t in order if zlib.crc32(str(k).encode()) % 5]
    ids = {y: list(dict.fromkeys(k for k, _ in fit if k % 2 == y))[:12] for y in (0, 1)}
    assert sample == {y: [t for k, t in fit if k in ids[y]][:12] for y in (0, 1)}
    assert totals == {y: len({k for k, _ in fit if k % 2 == y}) for y in (0, 1)}


def test_vocabulary_kinds_are_told_apart():
    with open(BYTE_BPE, encoding="utf-8") as file:
        assert json.load(file)["pre_tokenizer"]["type"] == "ByteLevel"
    assert bpe.codec(BYTE_BPE).blanks and not bpe.codec(WORD_BPE).blanks


def test_tables_of_the_word_hash_stay_small():
    word_text._constants.cache_clear()
    long = " ".join(f"w{k}" for k in range(120_000)).encode()
    found = hash_words(find_words([long, b"w7 w119999"]))
    assert found[-2] == found[7] and found[-1] == found[119_999] and len(np.unique(found)) == 120_000
    assert len(word_text._constants(word_text.PIECE_BYTES)[1]) == 1 << 18 and word_text._constants.cache_info().currsize == 1


def test_a_carried_text_is_sent_once(spark):
    rows = spark.createDataFrame([(1, "a b c"), (2, None), (3, "x " * 80)], "doc_id long, text string").repartition(1)
    model = toxicity.Model({0: [], 1: []}, {0: 3, 1: 1})
    ways = [lambda **how: quality_rules.apply_rules(rows, **how), lambda **how: toxicity.score(rows, model, **how)]
    for alone, carried in [(way(), way(carry=True)) for way in ways]:
        plan = carried._jdf.queryExecution().executedPlan().toString()
        assert "_text" not in plan and "_text" in alone._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, carried.drop("_row").collect())) == sorted(map(str, alone.collect()))
        assert sorted(map(str, carried.select("_row.*").collect())) == sorted(map(str, rows.collect()))
