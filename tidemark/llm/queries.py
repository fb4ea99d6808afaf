"""Registered queries of this package: each applies one operator to its whole table and returns its full result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.decontamination import contaminated
from tidemark.llm.fill_in_middle import fill_in_middle, restore
from tidemark.llm.html_text import extract
from tidemark.llm.merkle import folded, leaf, proof_digest, proofs
from tidemark.llm.packing import packed, pieces
from tidemark.llm.quality import quality_cascade
from tidemark.llm.secrets import listed, secrets
from tidemark.llm.sentence_pieces import decode, encode
from tidemark.llm.simhash import near_duplicates
from tidemark.llm.token_files import read_documents, write_token_files
from tidemark.llm.tokens import public_tokenizer
from tidemark.llm.toxicity import fit, held_out, scored
from tidemark.llm.urls import judged
from tidemark.llm.warc import read_facts, write_archive
from tidemark.session import work_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable:
    """Register a query under its function's name, with SQL that gives the same rows where there is any."""

    def register(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[function.__name__] = function
        if oracle:
            ORACLES[function.__name__] = oracle
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query(
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
    f AS (SELECT h, min(page_id) AS first, sha1(h) AS hex FROM p GROUP BY h)
    SELECT page_id, strlen(h) AS payload_bytes,
           list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               1 + (('0x' || substr(hex, 5 * (i // 4) + 1, 5))::BIGINT >> (5 * (3 - i % 4)) & 31)::BIGINT, 1)),
               'string_agg', '') AS payload_digest,
           CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> first THEN first END AS refers_to
    FROM p JOIN f USING (h)
    """
)
def op1_warc_archive(spark: SparkSession, folder: str) -> DataFrame:
    path = work_path(spark, "warc")
    write_archive(table(spark, folder, "pages"), path)
    return read_facts(spark, path).select(
        F.col("id").cast("bigint").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast("bigint").alias("refers_to"),
    )


@query()
def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    model = fit(documents, table(spark, folder, "labels"))
    result = scored(documents, model).withColumnRenamed("id", "doc_id")
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return result.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", predicted)


@query()
def op3_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = work_path(spark, "tokens")
    write_token_files(table(spark, folder, "documents"), path, public_tokenizer())
    return read_documents(spark, path).withColumnRenamed("id", "doc_id")


@query()
def op4_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return extract(table(spark, folder, "pages"))


@query()
def op5_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    result = judged(table(spark, folder, "pages").select("page_id", "url"))
    return result.select("row.page_id", "host", "path", "rule", "verdict", "score")


@query(
    r"""
    WITH d AS (
        SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r,
               regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    places AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) > 2),
    windows AS (
        SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n FROM places),
    repeats AS (
        SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM windows WHERE n > 1) GROUP BY r),
    m AS (
        SELECT d.doc_id, d.t, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
               length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
               list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
               coalesce(n, 0) AS n_repeat_words,
               length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')) AS n_upper,
               length(t) - length(regexp_replace(t, '!', '', 'g')) AS n_exclamations
        FROM d LEFT JOIN repeats USING (r)),
    b AS (
        SELECT *, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
               n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
    SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
           CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
           CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
           NOT (base_failed OR 10 * n_upper > 3 * word_chars OR 10 * n_exclamations > 3 * n_words
                OR 10 * n_symbols > 3 * n_words OR 2 * n_dup_lines > len(lines)
                OR word_chars < 2 * n_words OR word_chars > 25 * n_words) AS kept
    FROM b
    """
)
def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality_cascade(table(spark, folder, "documents").select("doc_id", "text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select("row.doc_id", *(f"m.{n}" for n in names), "base_failed", "kept")


@query()
def op9_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Occurrences of benchmark items in documents; a document without any is clean and has no row."""
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query()
def op10_simhash_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    near = near_duplicates(table(spark, folder, "documents"))
    fingerprint = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return near.select(F.col("id").alias("doc_id"), fingerprint.alias("fingerprint"), "component_id")


@query(
    r"""
    WITH patterns AS (
        SELECT unnest([
            {'kind': 'assign', 'no': 0, 'least': 6, 'part': 2, 'p':
             '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'},
            {'kind': 'access', 'no': 1, 'least': 20, 'part': 0, 'p': 'AKIA[A-Z0-9]+'},
            {'kind': 'hex', 'no': 2, 'least': 24, 'part': 0, 'p': '[0-9a-f]+'},
            {'kind': 'key', 'no': 3, 'least': 1, 'part': 0, 'p': '-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----'},
            {'kind': 'mixed', 'no': 4, 'least': 20, 'part': 0, 'p': '[A-Za-z0-9_-]+'}], recursive := true)),
    d AS (SELECT doc_id, source, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
    found AS (
        SELECT r, source, kind, no, least, part, p, unnest(regexp_extract_all(t, p)) AS m,
               unnest(range(1, len(regexp_extract_all(t, p)) + 1)) AS i,
               unnest((string_split_regex(t, p))[: len(regexp_extract_all(t, p))]) AS gap
        FROM d, patterns),
    placed AS (
        SELECT *, sum(length(gap)) OVER w + sum(length(m)) OVER w - length(m) AS a,
               CASE WHEN part = 2 THEN regexp_extract(m, p, 2) ELSE m END AS v
        FROM found WINDOW w AS (PARTITION BY r, kind ORDER BY i)),
    spans AS (
        SELECT r, source, kind, no, CAST(a AS BIGINT) AS a, CAST(a + length(m) AS BIGINT) AS b, v FROM placed
        WHERE length(v) >= least AND (kind <> 'mixed' OR (regexp_matches(v, '[A-Za-z]') AND regexp_matches(v, '([^0-9]*[0-9]){3}')))),
    base AS (SELECT * FROM spans WHERE no < 3),
    extra AS (
        SELECT * FROM spans s WHERE no > 2
        AND NOT EXISTS (SELECT 1 FROM base t WHERE s.r = t.r AND t.a < s.b AND s.a < t.b)),
    every AS (SELECT * FROM base UNION ALL SELECT * FROM extra),
    owners AS (SELECT v, count(DISTINCT coalesce(source, chr(0))) <= 2 AS live FROM every GROUP BY v),
    judged AS (SELECT e.*, live FROM every e JOIN owners USING (v) WHERE no < 3 OR live),
    listed AS (
        SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
               count(*) FILTER (kind = 'hex') AS n_hex, count(*) FILTER (live) AS n_live,
               string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, no) FILTER (no < 3) AS base,
               string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, no) AS spans
        FROM judged GROUP BY r)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
           sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live
    FROM d LEFT JOIN listed USING (r)
    """
)
def op8_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text", "source", "lang")
    found = secrets(documents, repository=F.struct("source", "lang"))

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "row.doc_id",
        *map(number, ("assign", "access", "hex")),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("bigint").alias("n_live"),
    )


@query()
def op7_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed(pieces(table(spark, folder, "documents"), public_tokenizer()))


@query(
    r"""
    WITH d AS (
        SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
               regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u FROM documents),
    drawn AS (
        SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS k1,
               ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS k2,
               CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain'
                    WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
    parts AS (
        SELECT doc_id, t, n, form, array_to_string(u[1 : least(k1, k2)], '') AS p,
               array_to_string(u[least(k1, k2) + 1 : greatest(k1, k2)], '') AS m,
               array_to_string(u[greatest(k1, k2) + 1 :], '') AS s FROM drawn)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
           CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                  ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
           sha256(t) AS restored_sha256
    FROM parts
    """
)
def op11_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    made = restore(fill_in_middle(table(spark, folder, "documents")))
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2("text", 256).alias("restored_sha256")]
    return made.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", *digests)


@query()
def op13_sentence_pieces(spark: SparkSession, folder: str) -> DataFrame:
    model = public_tokenizer("piece_bpe_32k.model")
    made = decode(encode(table(spark, folder, "documents"), model), model)
    digests = [F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256")]
    return made.select(F.col("id").alias("doc_id"), "n_tokens", *digests)


@query(
    """
    WITH RECURSIVE crc AS (
        SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
                    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
        FROM range(256) AS x(i)),
    named AS (
        SELECT *, coalesce(CAST(doc_id AS VARCHAR), '') AS name,
               coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-')
               || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS before,
               coalesce(strlen(text) || ':' || text, '-') AS after FROM documents),
    d AS (
        SELECT doc_id, lang, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
               sha256(before || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || after) AS leaf,
               sha256(before || coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') || after) AS other,
               xor(4294967295, list_reduce(
                   list_prepend(4294967295, list_transform(range(1, length(name) + 1), lambda k: CAST(ascii(name[k]) AS BIGINT))),
                   lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]))) % 7 = 0 AS chosen
        FROM named, crc),
    leaves AS (
        SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
               count(*) OVER (PARTITION BY tree) AS n FROM d),
    nodes AS (
        SELECT tree, 0 AS level, place, n, leaf AS hash FROM leaves
        UNION ALL
        SELECT tree, level + 1, place // 2, (n + 1) // 2, sha256(string_agg(hash, '' ORDER BY place))
        FROM nodes WHERE n > 1 GROUP BY tree, level, place // 2, n),
    tops AS (
        SELECT 0 AS level, tree AS place, count(*) OVER () AS n, hash FROM nodes WHERE n = 1
        UNION ALL
        SELECT level + 1, place // 2, (n + 1) // 2, sha256(string_agg(hash, '' ORDER BY place))
        FROM tops WHERE n > 1 GROUP BY level, place // 2, n),
    steps AS (
        SELECT r.tree, r.place, h.level, s.place AS p, r.place >> h.level AS own, s.hash
        FROM leaves r JOIN (SELECT DISTINCT tree, level FROM nodes WHERE n > 1) h USING (tree)
        LEFT JOIN nodes s ON s.tree = r.tree AND s.level = h.level AND s.place = xor(r.place >> h.level, 1)
        UNION ALL
        SELECT r.tree, r.place, 1000 + h.level, s.place, r.tree >> h.level, s.hash
        FROM leaves r CROSS JOIN (SELECT DISTINCT level FROM tops WHERE n > 1) h
        LEFT JOIN tops s ON s.level = h.level AND s.place = xor(r.tree >> h.level, 1)),
    proofs AS (
        SELECT tree, place, string_agg(coalesce(hash, ''), '' ORDER BY level) AS siblings,
               list({'l': CASE WHEN p < own THEN hash ELSE '' END, 'r': CASE WHEN p > own THEN hash ELSE '' END} ORDER BY level) AS path
        FROM steps GROUP BY tree, place),
    done AS (
        SELECT doc_id, leaf, u.hash AS subroot, (SELECT hash FROM tops WHERE n = 1) AS root,
               sha256(coalesce(siblings, '')) AS proof_sha256,
               list_reduce(list_prepend({'l': CASE WHEN chosen THEN other ELSE leaf END, 'r': ''}, coalesce(path, [])),
                           lambda a, s: {'l': sha256(s.l || a.l || s.r), 'r': ''}).l AS folded_root
        FROM leaves r JOIN (SELECT tree, hash FROM nodes WHERE n = 1) u USING (tree)
        LEFT JOIN proofs USING (tree, place))
    SELECT *, folded_root = root AS verified FROM done
    """
)
def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Proofs of all rows; the leaves of a seventh of them are tampered with before their proofs are folded."""
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    changed = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in columns]
    chosen = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 0
    tampered = F.when(chosen, leaf(changed))
    made = proofs(table(spark, folder, "documents"), columns, keep={"tampered": tampered})
    made = made.withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("proof")))
    names = [F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256")]
    return made.select(*names, "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
