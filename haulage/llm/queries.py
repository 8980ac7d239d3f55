"""The numbered queries: each applies one operator to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haulage.llm import (
    bpe,
    compression_classifier,
    embedding_dedup,
    lm_score,
    packing,
    periodic_runs,
    quality_rules,
    simhash,
    substring_dedup,
    token_alignment,
    token_files,
    toxicity,
    url_filter,
)
from haulage.llm.ship import ship
from haulage.session import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def query(sql: str | None = None) -> Callable:
    """Register a function under its own name, with its SQL where SQL can say it."""

    def register(run: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[run.__name__] = run
        if sql is not None:
            ORACLES[run.__name__] = sql
        return run

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("""
    WITH words AS (
        SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
        FROM documents
    ),
    starts AS (
        SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM words WHERE len(w) >= 20
    ),
    windows AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 19], ' ')) AS h FROM starts),
    later AS (
        SELECT doc_id, i FROM windows
        QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1
    ),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later),
    lists AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
    kept AS (
        SELECT doc_id, len(w) AS n_words, coalesce(len(ps), 0) AS n_removed,
               CASE WHEN ps IS NULL THEN w
                    ELSE list_filter(w, lambda x, k: NOT list_contains(ps, k)) END AS k
        FROM words LEFT JOIN lists USING (doc_id)
    )
    SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed,
           sha256(array_to_string(k, ' ')) AS kept_sha256
    FROM kept
""")
def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return substring_dedup.remove_repeats(documents, with_text=False).select("doc_id", "repeats.*")


@query()
def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = packing.pack(table(spark, folder, "documents"), WORD_BPE, with_ids=False)
    return packed.drop("ids")


@query()
def op3_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write_tokens(table(spark, folder, "documents"), path, BYTE_BPE)
    return token_files.read_tokens(spark, path, with_ids=False).drop("ids")


@query("""
    WITH RECURSIVE
    held AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    fit AS (
        SELECT * FROM held
        WHERE label IS NOT NULL AND e IS NOT NULL AND list_dot_product(e, e) > 0
          AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ),
    links AS (
        SELECT a.vec_id AS a, b.vec_id AS b FROM fit a JOIN fit b ON a.label = b.label AND a.vec_id <> b.vec_id
        WHERE list_cosine_similarity(a.e, b.e) >= 0.98
    ),
    reach AS (
        SELECT vec_id AS a, vec_id AS b FROM held
        UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
    ),
    counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
    SELECT vec_id, coalesce(max(n), 0) AS n_links, min(reach.b) AS component_id, min(reach.b) = vec_id AS kept
    FROM held JOIN reach ON reach.a = vec_id LEFT JOIN counts ON counts.a = vec_id GROUP BY vec_id
""")
def op4_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, folder, "embeddings"))


@query("""
    WITH words AS (
        SELECT doc_id, coalesce(text, '') AS t,
               list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
        FROM documents
    ),
    sizes AS (SELECT *, len(w) AS n FROM words),
    spans AS (
        SELECT doc_id, k, i, count(*) OVER (PARTITION BY doc_id, k, h) AS times FROM (
            SELECT doc_id, k, i, sha256(array_to_string(w[i:i + k - 1], ' ')) AS h FROM (
                SELECT doc_id, w, k, unnest(range(1, n - k + 2)) AS i
                FROM (SELECT doc_id, w, n, unnest([4, 5, 51]) AS k FROM sizes) WHERE n >= k
            )
        )
    ),
    repeated AS (SELECT * FROM spans WHERE times > 1),
    covered AS (
        SELECT doc_id, count(DISTINCT p) FILTER (k = 4) AS four, count(DISTINCT p) FILTER (k = 5) AS five,
               count(*) FILTER (k > 5) AS long
        FROM (SELECT doc_id, k, unnest(range(i, i + k)) AS p FROM repeated) GROUP BY doc_id
    ),
    counts AS (
        SELECT doc_id, n AS n_words, length(array_to_string(w, '')) AS word_chars,
               length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
               list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
               coalesce(five, 0) AS n_repeat_words, coalesce(four, 0) AS covered_words, coalesce(long, 0) > 0 AS long
        FROM sizes LEFT JOIN covered USING (doc_id)
    )
    SELECT doc_id, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
           n_repeat_words, covered_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
           NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
           AND NOT (100 * covered_words > 20 * n_words OR long) AS kept
    FROM counts
""")
def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, folder, "documents")).drop("longest_repeat")


@query()
def op6_compression_classifier(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    model = compression_classifier.fit(documents, table(spark, folder, "labels"))
    return compression_classifier.score(documents, model)


@query()
def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    model = toxicity.fit(documents, table(spark, folder, "labels"))
    return toxicity.score(documents, model)


@query()
def op8_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_texts(table(spark, folder, "documents"), WORD_BPE)


@query()
def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query()
def op10_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    return lm_score.score(table(spark, folder, "documents"))


def with_planted_runs(key: Column, text: Column) -> Column:
    """The text, or for a tenth of the keys its words with a stretch from some word on that repeats, as op11's contract draws it."""
    drawn = F.crc32(key.cast("string"))
    words = F.array_remove(F.split(text, "[ \\t-\\r]+"), "")
    n, seed = F.size(words), F.floor(drawn / 10).cast("bigint")
    at = F.try_mod(seed, n).cast("int")
    period = (F.lit(1) + F.floor((n - at) / (F.lit(3) + seed % 8))).cast("int")
    times = F.ceil((n - at) / period).cast("int")
    repeated = F.flatten(F.array_repeat(F.slice(words, at + 1, period), times))
    planted = F.array_join(F.concat(F.slice(words, 1, at), F.slice(repeated, 1, n - at)), " ")
    return F.when((drawn % 10 == 0) & (n > 0), planted).otherwise(text)


@query("""
    WITH keyed AS (
        SELECT row_number() OVER () AS r, doc_id,
               list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
               xor(4294967295, list_reduce(flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
                   lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
                   lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END,
                   CAST(4294967295 AS BIGINT))) AS h
        FROM documents
    ),
    drawn AS (SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM keyed),
    cut AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM drawn),
    texts AS (
        SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
            THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END]) ELSE w END AS w
        FROM cut
    ),
    tokens AS (
        SELECT r, n, unnest(w) AS word, unnest(range(n)) AS i FROM texts
    ),
    alike AS (
        SELECT a.r, b.i - a.i AS q, a.i FROM tokens a JOIN tokens b
        ON a.r = b.r AND a.word = b.word AND b.i > a.i AND 4 * (b.i - a.i) <= a.n
    ),
    islands AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS g FROM alike),
    stretches AS (
        SELECT r, q, min(i) AS s, min(i) + count(*) + q AS e FROM islands
        GROUP BY r, q, g HAVING count(*) + q >= greatest(6, 4 * q)
    ),
    runs AS (
        SELECT r, s, e - s AS l, q FROM stretches x WHERE NOT EXISTS (
            SELECT 1 FROM stretches y WHERE y.r = x.r AND y.q < x.q AND y.s <= x.s AND y.e >= x.e)
    ),
    shown AS (
        SELECT r, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS listed,
               first({'s': s, 'l': l, 'q': q} ORDER BY l / q DESC, s, q) AS best
        FROM runs GROUP BY r
    ),
    gone AS (SELECT DISTINCT r, unnest(range(s + q, s + l)) AS i FROM runs),
    kept AS (
        SELECT r, string_agg(word, ' ' ORDER BY i) AS t FROM tokens ANTI JOIN gone USING (r, i) GROUP BY r
    )
    SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length, best.q AS period,
           1000 * best.l // best.q AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256,
           sha256(coalesce(t, '')) AS collapsed_sha256
    FROM texts LEFT JOIN shown USING (r) LEFT JOIN kept USING (r)
""")
def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", with_planted_runs(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic_runs.collapse_runs(documents, with_text=False).select("doc_id", "periodic.*")
    # Of greatest length/period, then of smallest start and period; the runs come in that order.
    by_exponent = F.array_sort(
        "runs", lambda a, b: F.signum(b["length"] * a["period"] - a["length"] * b["period"]).cast("int")
    )
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = F.get(by_exponent, 0)
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.floor(best["length"] * 1000 / best["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"),
        "collapsed_sha256",
    )


@query()
def op12_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return token_alignment.align_tokenizers(table(spark, folder, "documents"), BYTE_BPE, PIECE_BPE)[0]


#: The rules of the url query, fixed by its contract.
URL_RULES = [
    url_filter.UrlRule("net", "/", "block"),
    url_filter.UrlRule("example.net", "/en/", "allow"),
    url_filter.UrlRule("example.com", "/de/", "block"),
    url_filter.UrlRule("org", "/fr/", "allow"),
]


@query("""
    WITH rests AS (
        SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
        FROM pages
    ),
    parts AS (
        SELECT page_id, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
               translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host
        FROM rests
    ),
    fits AS (
        SELECT page_id, host, path, list_filter([
            {'h': 'example.net', 'p': '/en/', 'v': 'allow'}, {'h': 'example.com', 'p': '/de/', 'v': 'block'},
            {'h': 'org', 'p': '/fr/', 'v': 'allow'}, {'h': 'net', 'p': '/', 'v': 'block'}
        ], lambda r: (host = r.h OR ends_with(host, '.' || r.h)) AND starts_with(path, r.p))[1] AS r
        FROM parts
    )
    SELECT page_id, host, path, r.h || r.p AS rule, coalesce(r.v, 'allow') AS verdict FROM fits
""")
def op13_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")
