"""Operators that compare texts and vectors over the whole table, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash

import corpus_pipeline
from haulage.llm import embedding_dedup, links, lm_score, simhash, substring_dedup
from haulage.llm.queries import ORACLES, QUERIES, table
from tests.conftest import DATA
from tests.llm.conftest import LONG, PASSAGE, ROWS


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_its_sql(spark, name):
    connection = duckdb.connect()
    for each in ("documents", "embeddings", "pages"):
        connection.execute(f"CREATE VIEW {each} AS SELECT * FROM '{DATA}/{each}.parquet'")
    result = connection.execute(ORACLES[name])
    columns = sorted(c[0] for c in result.description)
    places = [[c[0] for c in result.description].index(c) for c in columns]
    expected = sorted((tuple(row[k] for k in places) for row in result.fetchall()), key=repr)
    df = QUERIES[name](spark, DATA)
    assert sorted(df.columns) == columns
    assert sorted((tuple(row) for row in df.select(*columns).collect()), key=repr) == expected


# --- links --------------------------------------------------------------------


def test_components(spark):
    rnd = random.Random(3)
    edges = [(k, k + 1) for k in range(0, 60)] + [(rnd.randrange(100, 200), rnd.randrange(100, 200)) for _ in range(60)]
    edges += [(500, k) for k in range(501, 560)] + [(7, 7), (900, 900)]
    df = spark.createDataFrame([*edges, (None, 3), (4, None)], "a long, b long")
    found = {r.id: r.component for r in links.components(df).collect()}
    nodes = sorted({x for e in edges if e[0] != e[1] for x in e})
    at = {x: k for k, x in enumerate(nodes)}
    pairs = np.array([(at[a], at[b]) for a, b in edges if a != b])
    roots = links.roots(len(nodes), pairs[:, 0], pairs[:, 1])
    assert found == {x: nodes[roots[at[x]]] for x in nodes}
    assert links.components(df.where("a < 0")).count() == 0


# --- repeated passages --------------------------------------------------------


def removed(documents, window=20):
    """Per (id, text) the kept words, straight from the definition."""
    first, lists = {}, [(-(1 << 63) if k is None else k, words_of(t)) for k, t in documents]
    for k, words in lists:
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            first[key] = min(first.get(key, (k, i)), (k, i))
    found = []
    for k, words in lists:
        gone = set()
        for i in range(len(words) - window + 1):
            if first[tuple(words[i : i + window])] < (k, i):
                gone.update(range(i, i + window))
        found.append([w for i, w in enumerate(words) if i not in gone])
    return found


@pytest.mark.parametrize("most_pieces", [0, 2000])
def test_rows_without_an_id_are_dealt_over_blocks(spark, monkeypatch, most_pieces):
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 300)
    rnd = random.Random(4)
    shared = " ".join(f"s{k}" for k in range(30))
    documents = [(None if k % 3 else k, " ".join(rnd.choices("abcdefgh", k=12)) + (f" {shared}" if k % 4 else "")) for k in range(120)]
    documents += [(None, f"{shared} tail{k}") for k in range(6)] + [(5000 + k, f"{shared} tail{k}") for k in range(6)]
    df = spark.createDataFrame(documents, "doc_id long, text string")
    found = substring_dedup.remove_repeats(df, 5, most_pieces=most_pieces).collect()
    kept = sorted(hashlib.sha256(" ".join(ws).encode()).hexdigest() for ws in removed(documents, 5))
    assert sorted(r.repeats.kept_sha256 for r in found) == kept


@pytest.mark.parametrize("most_pieces", [0, 2, 2000])
@pytest.mark.parametrize("window", [5, 7, 20])
def test_repeats_against_the_definition(spark, window, most_pieces, monkeypatch):
    rnd = random.Random(window)
    passages = [" ".join(rnd.choices("abcdef", k=rnd.randrange(10, 60))) for _ in range(12)]
    documents = []
    for k in range(120):
        parts = [rnd.choice(passages) if rnd.random() < 0.6 else " ".join(rnd.choices("abcdefghij", k=15)) for _ in range(4)]
        documents.append((rnd.randrange(-50, 1000), rnd.choice([" ", "\n\t "]).join(parts)))
    documents += [(2000, "a " * 100), (2001, "a b " * 60), *documents[:5], (3000, None), (None, documents[0][1])]
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 5000)
    df = spark.createDataFrame(documents, "doc_id long, text string").repartition(3)
    rows = substring_dedup.remove_repeats(df, window, most_pieces=most_pieces).collect()
    expected = Counter()
    for (key, text), kept in zip(documents, removed(documents, window), strict=True):
        n = len(words_of(text))
        whole = hashlib.sha256(" ".join(kept).encode()).hexdigest()
        shown = text if len(kept) == n else " ".join(kept)
        expected[key, shown, n, n - len(kept), whole] += 1
    assert Counter((r.doc_id, r.text, *r.repeats) for r in rows) == expected


def test_automaton_against_brute_force():
    rnd = random.Random(1)
    for _ in range(60):
        shard = [[rnd.choice([b"a", b"b", b"c"]) for _ in range(rnd.randrange(1, 25))] for _ in range(4)]
        automaton = substring_dedup.Automaton()
        for words in shard:
            automaton.add(words)
        runs = {tuple(w[i:j]) for w in shard for i in range(len(w)) for j in range(i + 1, len(w) + 1)}
        text = [rnd.choice([b"a", b"b", b"c", b"d"]) for _ in range(40)]
        longest = [max((n for n in range(e + 2) if tuple(text[e + 1 - n : e + 1]) in runs or n == 0)) for e in range(40)]
        assert automaton.matches(text) == longest


def test_repeats_of_odd_rows(odd, none):
    rows = substring_dedup.remove_repeats(odd).collect()
    assert len(rows) == len(ROWS) and rows[0].n_words == "x"
    found = {r.doc_id: r for r in rows}
    assert found[1].text == dict((k, t) for k, t, _ in ROWS)[1] and found[1].repeats.n_removed == 0
    assert found[5].text == "Start of another text:" and found[11].text == ""
    assert found[2].text is None and found[2].repeats.n_words == 0 and found[8].text == LONG
    assert substring_dedup.remove_repeats(none).count() == 0
    with pytest.raises(ValueError, match="a window is"):
        substring_dedup.remove_repeats(none, 60)


# --- fingerprints -------------------------------------------------------------


def fingerprint(text, shingle=4):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(values, most):
    values = np.unique(values)
    a, b = np.nonzero(np.bitwise_count(values[:, None] ^ values) <= most)
    return dict(zip(values.tolist(), values[links.roots(len(values), a, b)].tolist(), strict=True))


def test_anchors_cover_every_close_pair():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 2**63, 200, dtype=np.uint64) * np.uint64(2)
    at, anchor, home = simhash.anchors(values)
    visits = [set(anchor[at == k].tolist()) for k in range(len(values))]
    assert sum(map(len, visits)) == len(at)
    for k, value in enumerate(values):
        for n in range(6):
            near = int(value)
            for bit in rng.choice(64, n, replace=False):
                near ^= 1 << int(bit)
            _, other, at_home = simhash.anchors(np.array([near], dtype=np.uint64))
            assert visits[k] & set(other[at_home].tolist())


@pytest.mark.parametrize("most", [0, 2, 4, 5])
@pytest.mark.parametrize("large", [False, True])
def test_fingerprint_links_against_all_pairs(spark, most, large, monkeypatch):
    rng = np.random.default_rng(most)
    for _ in range(10):
        values = rng.integers(0, 2**63, 6, dtype=np.uint64)[rng.integers(0, 6, 500)]
        for _ in range(rng.integers(1, 7)):
            values = values ^ (np.uint64(1) << rng.integers(0, 64, 500, dtype=np.uint64))
        values = np.unique(values)
        monkeypatch.setattr(simhash, "DIRECT_PAIRS", 1 if large else 1 << 20)
        at, anchor, home = simhash.anchors(values)
        order = np.lexsort((~home, anchor))
        a, b = simhash.compare(anchor[order], home[order], values[at[order]], most)
        roots = links.roots(len(values), np.searchsorted(values, a), np.searchsorted(values, b))
        assert dict(zip(values.tolist(), values[roots].tolist(), strict=True)) == linked(values, most)
    with pytest.raises(ValueError, match="at most 5 bits"):
        simhash.link_fingerprints(spark.range(1), 6)


def test_near_duplicates_of_all_documents(spark):
    found = {r.doc_id: r for r in QUERIES["op9_simhash"](spark, DATA).collect()}
    texts = {r.doc_id: r.text for r in table(spark, DATA, "documents").collect()}
    prints = {k: fingerprint(t) for k, t in texts.items()}
    group = linked(np.array(list(prints.values()), dtype=np.uint64), 4)
    least = {}
    for k in sorted(prints):
        least.setdefault(group[prints[k]], k)
    assert {k: (r.fingerprint, r.component_id) for k, r in found.items()} == {
        k: (f"{p:016x}", least[group[p]]) for k, p in prints.items()
    }


def test_near_duplicates_of_odd_rows(odd, none):
    rows = simhash.near_duplicates(odd).collect()
    found = {r.doc_id: r for r in rows}
    assert len(rows) == len(ROWS)
    assert {found[k].component_id for k in (2, 3, 4)} == {2} and found[2].fingerprint == "0" * 16
    assert {found[k].component_id for k in (6, 7)} == {6} and found[8].component_id == 8
    assert simhash.near_duplicates(none).count() == 0


# --- vectors ------------------------------------------------------------------


def vectors_by_brute_force(rows, threshold=0.98):
    fit = [
        (k, v, lab) for k, v, lab in rows
        if k is not None and lab is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    ]
    ids = sorted({k for k, _, _ in fit})
    at = {k: i for i, k in enumerate(ids)}
    counts, pairs = Counter(), []
    for i, (k, v, lab) in enumerate(fit):
        for j, (other, w, mark) in enumerate(fit):
            if i != j and lab == mark and len(v) == len(w):
                v_, w_ = (np.array(x, dtype=float) / np.abs(x).max() for x in (v, w))
                if v_ @ w_ / np.sqrt((v_ @ v_) * (w_ @ w_)) >= threshold:
                    counts[k] += 1
                    pairs.append((at[k], at[other]))
    pairs = np.array(pairs, dtype=int).reshape(-1, 2)
    roots = links.roots(len(ids), pairs[:, 0], pairs[:, 1])
    root = {k: ids[roots[at[k]]] for k in ids}
    return {(k, counts[k], root.get(k, k), root.get(k, k) == k) for k, _, _ in rows}


@pytest.mark.parametrize(("block", "tile"), [(4096, 512), (5, 3)])
def test_vectors_against_all_pairs(spark, block, tile, monkeypatch):
    rng = np.random.default_rng(2)
    rows = []
    centres = rng.standard_normal((12, 24))
    for k in range(260):
        v = centres[rng.integers(12)] + rng.standard_normal(24) * rng.choice([0, 0.02, 0.1, 0.2])
        rows.append((k * 3, [float(x) for x in v * rng.choice([1, 1e-3, 1e200])], int(rng.integers(3))))
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * 24, [nan] + [1.0] * 23, [inf] + [1.0] * 23, [None] + [1.0] * 23, [1.0, 2.0], [1.0, 2.01]]
    rows += [(10_000 + i, v, 1) for i, v in enumerate(odd)] + [(20_000, rows[0][1], None), (None, rows[0][1], 1)]
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    monkeypatch.setattr(embedding_dedup, "TILE", tile)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS n_links")
    found = embedding_dedup.near_duplicates(df.repartition(4)).collect()
    expected = vectors_by_brute_force([r for r in rows if r[0] is not None])
    assert {tuple(r) for r in found if r.vec_id is not None} == expected and len(found) == len(rows)
    assert [tuple(r)[1:] for r in found if r.vec_id is None] == [(0, None, True)]
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_a_repeated_vector_row_links_with_its_copy(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.0, 1.0], 1)], "vec_id long, embedding array<float>, label int")
    rows = sorted(tuple(r) for r in embedding_dedup.near_duplicates(df).collect())
    assert rows == [(1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True)]


def test_bounds_never_drop_a_close_pair():
    rng = np.random.default_rng(0)
    a = embedding_dedup.unit(rng.standard_normal((80, 40)))
    b = embedding_dedup.unit(np.concatenate([a + rng.standard_normal((80, 40)) * 0.03, rng.standard_normal((50, 40))]))
    x, y = embedding_dedup.similar(a, b, 0.98)
    p, q = np.nonzero(a @ b.T >= 0.98)
    assert sorted(zip(x, y, strict=True)) == sorted(zip(p, q, strict=True)) and len(p) > 10


# --- language model -----------------------------------------------------------


def model_by_brute_force(documents, weight=0.2):
    tokens = [(k, [w.lower() if w.isascii() else w.translate(LOWER) for w in words_of(t)] + [None]) for k, t in documents]
    trains = [k is None or zlib.crc32(str(k).encode()) % 7 != 2 for k, _ in tokens]
    single = Counter(w for (_, ws), on in zip(tokens, trains, strict=True) if on for w in ws)
    pairs = Counter(p for (_, ws), on in zip(tokens, trains, strict=True) if on for p in zip([None, *ws[:-1]], ws, strict=True))
    whole, distinct = sum(single.values()), len(single)
    for (key, ws), on in zip(tokens, trains, strict=True):
        base = model = 0.0
        for before, word in zip([None, *ws[:-1]], ws, strict=True):
            chance = (single[word] + 1) / (whole + distinct + 1)
            count = pairs[before, word]
            level = 1 << int(math.log2(count)) if count else 0
            mixed = (1 - weight) * chance + weight * min(1, level / single[before]) if single[before] else chance
            base, model = base + math.log10(chance), model + math.log10(mixed)
        yield key, not on, len(ws), sum(single[w] > 0 for w in ws), whole, base, model


LOWER = {c: c + 32 for c in range(65, 91)}


def check_model(rows, documents):
    found = sorted(tuple(r) for r in rows if r.doc_id is not None)
    expected = sorted(x for x in model_by_brute_force(documents) if x[0] is not None)
    assert [x[:5] for x in found] == [x[:5] for x in expected]
    assert np.allclose([x[5] for x in found], [x[5] for x in expected], rtol=1e-9)
    assert np.allclose([x[6] for x in found], [x[6] for x in expected], rtol=1e-9)


@pytest.fixture
def no_mistakes(monkeypatch):
    """A filter so sparse that no pair is found in it by mistake."""
    monkeypatch.setattr(lm_score, "BITS_PER_ITEM", 400)


def test_language_model_of_all_documents(spark, no_mistakes):
    rows = QUERIES["op10_lm_score"](spark, DATA).collect()
    check_model(rows, [(r.doc_id, r.text) for r in table(spark, DATA, "documents").collect()])
    held = [r for r in rows if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


@pytest.mark.parametrize("most_bits", [1 << 28, 1 << 12])
def test_language_model_of_odd_rows(odd, none, no_mistakes, most_bits):
    rows = lm_score.score(odd, most_bits=most_bits).collect()
    assert len(rows) == len(ROWS)
    check_model(rows, [(k, t) for k, t, _ in ROWS])
    assert lm_score.score(none).count() == 0


def test_gaps_hold_values_in_order():
    values = np.sort(np.random.default_rng(2).integers(0, 1 << 32, 5000, dtype=np.uint64))
    for own in (values, values[:0], values[:1], np.array([0, (1 << 32) - 1], dtype=np.uint64)):
        assert np.array_equal(lm_score.from_gaps(lm_score.gaps(own)), own)


def test_filter_levels():
    counts = np.array([0, 1, 2, 3, 4, 7, 8, 1000])
    assert lm_score.levels_of(counts, 2).tolist() == [0, 0, 1, 1, 2, 2, 3, 9]
    assert lm_score.levels_of(counts, 3).tolist() == [0, 0, 0, 1, 1, 2, 2, 9]


def test_counts_over_a_million_keep_their_level():
    hashes, counts = np.arange(1, 6, dtype=np.uint64), [3, 1 << 20, (1 << 20) + 1, 25_000_000, 5_000_000_000]
    levels = lm_score.levels_of(np.array(counts), 2)
    held = lm_score.Filter(lm_score.stretch(hashes, levels, 4096), 4096, int(levels.max()))
    assert (2 * lm_score.counts_of(held.find(hashes))).tolist() == [2, 1 << 20, 1 << 20, 1 << 24, 1 << 32]
    assert lm_score.counts_of(held.find(hashes + np.uint64(100))).tolist() == [0] * 5


def test_mistakes_of_the_filter_are_few(spark):
    documents = table(spark, DATA, "documents").select("doc_id", "text")
    found = {r.doc_id: r.score for r in lm_score.score(documents).collect()}
    expected = {x[0]: x[6] for x in model_by_brute_force([tuple(r) for r in documents.collect()])}
    off = np.array([abs(found[k] - x) / abs(x) for k, x in expected.items()])
    assert np.median(off) < 1e-9 and off.mean() < 0.01


def test_rows_without_an_id_are_dealt_by_their_texts(spark, monkeypatch, no_mistakes):
    monkeypatch.setattr(lm_score, "BLOCK_BYTES", 500)
    documents = [(None if k % 3 else k, f"word{k % 40} and word{k % 7} again {k}") for k in range(300)]
    df = spark.createDataFrame(documents, "doc_id long, text string")
    assert len(lm_score.score(df).collect()) == 300
    check_model(lm_score.score(df).collect(), documents)


def test_the_filter_grows_with_the_pairs(spark, no_mistakes):
    documents = [(k, " ".join(f"w{(k // 2 * 7 + j) % 900}x{k // 2}" for j in range(300))) for k in range(1, 400)]
    rows = lm_score.score(spark.createDataFrame(documents, "doc_id long, text string"), most_bits=1 << 12).collect()
    check_model(rows, documents)


def test_a_pair_seen_two_million_times(spark):
    n = 2_200_000
    df = spark.range(n, n + 1).selectExpr("CAST(NULL AS LONG) AS doc_id", "repeat('a ', CAST(id AS INT)) AS text")
    row = lm_score.score(df).first()
    single, end = math.log10(0.8 * (n + 1) / (n + 4) + 0.2 * 2**21 / n), 2 / (n + 4)
    once = math.log10(0.8 * (n + 1) / (n + 4) + 0.2) + math.log10(0.8 * end + 0.2 / n)
    assert math.isclose(row.score, single * (n - 1) + once, rel_tol=1e-6)


# --- pipeline -----------------------------------------------------------------


def test_pipeline_stage_by_stage(spark, tmp_path):
    docs = table(spark, DATA, "documents")
    columns = docs.columns
    kept = {r.doc_id for r in QUERIES["op5_quality_rules"](spark, DATA).where("kept").collect()}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(number)))
        out = spark.read.parquet(str(tmp_path / str(number)))
        if number == 0:
            assert {r.doc_id for r in out.collect()} == kept
        if number == 2:
            prints = {r.doc_id: fingerprint(r.text) for r in docs.collect()}
            group = linked(np.array(list(prints.values()), dtype=np.uint64), 4)
            least = {}
            for k in sorted(prints):
                least.setdefault(group[prints[k]], k)
            assert {r.doc_id for r in out.collect()} == set(least.values())
        if number == 3:
            rows = [(r.doc_id, r.text) for r in docs.collect()]
            expected = {k: " ".join(words) for (k, _), words in zip(rows, removed(rows), strict=True)}
            assert {r.doc_id: " ".join(words_of(r.text)) for r in out.collect()} == expected
        if number < 4:
            assert out.columns == columns and out.count() <= docs.count(), name
            docs = out
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.collect()}


def test_pipeline_stages_on_odd_rows(spark, odd, none):
    wide = odd.select("doc_id", "text", "lang").selectExpr("*", "'s' AS source", "length(text) AS n_chars", "1 AS score")
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, wide, DATA)
        rows = out.collect()
        if number < 4:
            assert out.columns == wide.columns
        if number == 2:
            assert sorted(r.doc_id for r in rows if r.doc_id in (6, 7)) == [6]
        empty = stage(spark, wide.limit(0), DATA)
        assert empty.count() == 0 and empty.columns == out.columns
    assert PASSAGE
