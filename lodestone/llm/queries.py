"""The registered queries of these operators, each over its whole tables, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lodestone.llm.common import documents, stored, text_key
from lodestone.llm.kd_shards import document_dimensions, kd_shards
from lodestone.llm.license_scan import notices, scan_licenses
from lodestone.llm.line_dedup import dedup_lines
from lodestone.llm.ngram_join import ngram_components
from lodestone.llm.ordinal import fit_sample, grade_documents, grades_of_labels
from lodestone.llm.packing import pack
from lodestone.llm.secret_scan import KINDS, find_secrets
from lodestone.llm.simhash import as_text, fingerprints, likeness, near_counts, with_next
from lodestone.llm.simhash_dedup import near_components
from lodestone.llm.token_counts import count_tokens
from lodestone.llm.turn_repair import damaged, repair_conversations
from lodestone.llm.vector_codes import SCALE, codebooks_digest, vector_codes
from lodestone.llm.winnowing import flag_contaminated

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


@query(
    r"""
    WITH words AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    item_words AS (
        SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    item_windows AS (
        SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS gram
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item_words WHERE len(w) > 0)),
    lengths AS (SELECT DISTINCT k FROM item_windows),
    doc_windows AS (
        SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS gram
        FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, lengths WHERE len(w) >= k)),
    hits AS (SELECT doc_id, i, k, item_id FROM doc_windows JOIN item_windows USING (k, gram)),
    places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM hits)) GROUP BY doc_id),
    found AS (
        SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
        CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM words LEFT JOIN places USING (doc_id) LEFT JOIN found USING (doc_id)
    """
)
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that lie in a window of a benchmark item."""
    flagged = flag_contaminated(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return flagged.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("item_ids")), 256).alias("items_sha256"),
        "contaminated",
    )


@query()
def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share nine tenths of their 3-word shingles."""
    return ngram_components(documents(spark, sf_dir, "doc_id", "text"))


@query()
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2,048 tokens."""
    return pack(documents(spark, sf_dir, "doc_id", "text"), TOKENIZER)


@query()
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return count_tokens(documents(spark, sf_dir, "doc_id", "text"), TOKENIZER)


@query(
    """
    WITH lines AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text <> ''),
    windows AS (
        SELECT doc_id, i - 1 AS p, l[i] AS a, l[i + 1] AS b, l[i + 2] AS c
        FROM (SELECT doc_id, l, unnest(range(1, greatest(len(l) - 2, 1) + 1)) AS i FROM lines)),
    counted AS (
        SELECT doc_id, p, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, p) AS n FROM windows
        WHERE trim(concat_ws('', a, b, c), ' ') <> ''),
    gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 3)) AS p FROM counted WHERE n > 1),
    kept AS (
        SELECT doc_id, string_agg(line, chr(10) ORDER BY p) AS text, count(*) AS n
        FROM (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS p FROM lines) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
    SELECT d.doc_id, CASE WHEN l IS NULL THEN d.text ELSE coalesce(k.text, '') END AS text,
        CAST(CASE WHEN d.text IS NULL THEN 0 ELSE coalesce(len(l), 1) END AS INTEGER) AS n_lines,
        CAST(CASE WHEN l IS NULL THEN 0 ELSE len(l) - coalesce(n, 0) END AS INTEGER) AS n_removed
    FROM documents d LEFT JOIN lines USING (doc_id) LEFT JOIN kept k USING (doc_id)
    """
)
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without the lines of three-line windows that occurred before."""
    return dedup_lines(documents(spark, sf_dir, "doc_id", "text"))


def _joined(kinds: tuple[str, ...]) -> Column:
    own = F.filter("found", lambda s: s.kind.isin(*kinds))
    return F.array_join(F.transform(own, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


@query()
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of known form, and strings that pass for random."""
    found = find_secrets(documents(spark, sf_dir, "doc_id", "text"))
    counts = [F.expr(f"size(filter(found, s -> s.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined(KINDS[:3]), 256).alias("base_sha256"), _joined(KINDS).alias("spans"))


@query()
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graded quality of every document, by a model fitted on the labelled ones."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    grades = grades_of_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return grade_documents(docs, fit_sample(docs, grades, 3))


@query()
def op6_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards of nearly equal bytes; equal texts share one."""
    docs = documents(spark, sf_dir, "doc_id", "text", "source", "lang")
    narrow = docs.select(
        "doc_id",
        "source",
        "lang",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        text_key().alias("key"),
    )
    placed = kd_shards(narrow, document_dimensions(), F.col("size"), ["doc_id", "text_crc32", "size"], group=[F.col("key.a"), F.col("key.b")])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query()
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices of every document."""
    return scan_licenses(documents(spark, sf_dir, "doc_id", "text"), notices(spark))


@query()
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of documents, of their edited texts, and how near they are.

    ``n_near``: for documents whose id is divisible by 50, how many lie within the radius of their fingerprint.
    """
    docs = documents(spark, sf_dir, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    ahead = with_next(fingerprints(docs), "doc_id", "text", ["fingerprint"])
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.expr("left(text, length(text) - int(floor(length(text) / 2)))"), F.substring("next_text", F.lit(1), half))
    changed = ahead.select("doc_id", F.length("text").cast("long").alias("n_chars"), "fingerprint", "next_fingerprint", edited.alias("edited"))
    both = fingerprints(changed, "edited", "edited_fingerprint").withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    done = stored(both.drop("edited"))
    asked = done.filter("doc_id % 50 = 0").select(F.col("fingerprint").alias("q"))
    near = near_counts(done.select("fingerprint"), asked).withColumnRenamed("q", "fingerprint")
    print_ = F.col("fingerprint")
    out = done.join(near, "fingerprint", "left")
    return out.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(print_).alias("fingerprint"),
        as_text(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        likeness(print_, F.col("edited_fingerprint")).alias("near_edited"),
        likeness(print_, F.col("next_fingerprint")).alias("near_next"),
        F.when(F.col("doc_id") % 50 == 0, F.col("n_near")).alias("n_near"),
    )


@query()
def op12_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose fingerprints differ in three bits at most."""
    return near_components(documents(spark, sf_dir, "doc_id", "text"))


def _code_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The rounds written out: each has its codebook, the parts' nearest entries, and their means."""
    steps = [
        f"""kept AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""pieces AS (
            SELECT vec_id, label, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS x
            FROM kept, (SELECT unnest(range({parts})) AS p))""",
        f"""book0 AS (SELECT p, rank - 1 AS e, x FROM (
            SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id) AS rank FROM pieces) WHERE rank <= {entries})""",
    ]
    for r in range(rounds + 1):
        steps.append(f"""near{r} AS MATERIALIZED (
            SELECT vec_id, label, p, x, b.e AS e, b.d AS d FROM (
                SELECT s.vec_id, s.label, s.p, any_value(s.x) AS x,
                    min(struct_pack(d := CAST(list_sum(list_transform(list_zip(s.x, k.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), e := k.e)) AS b
                FROM pieces s JOIN book{r} k USING (p) GROUP BY s.vec_id, s.label, s.p))""")
        if r < rounds:
            steps.append(f"""book{r + 1} AS MATERIALIZED (
                SELECT p, e, coalesce(m.x, b.x) AS x FROM book{r} b LEFT JOIN (
                    SELECT p, e, list(CAST(s // n - CASE WHEN s < 0 AND s % n <> 0 THEN 1 ELSE 0 END AS BIGINT) ORDER BY i) AS x FROM (
                        SELECT p, e, i, sum(x[i]) AS s, count(*) AS n FROM near{r}, (SELECT unnest(range(1, (SELECT max(len(x)) FROM pieces) + 1)) AS i)
                        GROUP BY p, e, i) GROUP BY p, e) m USING (p, e))""")
    steps.append(f"""coded AS (
        SELECT vec_id, label, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
        FROM near{rounds} GROUP BY vec_id, label)""")
    return f"""WITH {", ".join(steps)}
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
            (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256
        FROM coded"""


@query(_code_sql())
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight-part codes of all vectors."""
    coded, books = vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
    return coded.withColumn("codebooks_sha256", F.lit(codebooks_digest(books)))


_ASSISTANT, _LINE = "chr(10) || 'assistant:'", "chr(10) || role || ':' || text"


def _repair_sql() -> str:
    """The same rules row by row: the cheapest way to each place of the pattern, carried from row to row."""

    def way(place: str, cost: str, edit: str, line: str = "''") -> str:
        return f"CASE WHEN {place} IS NULL THEN NULL ELSE struct_pack(c := {place}.c + {cost}, s := {place}.s || '{edit}', o := {place}.o || {line}) END"

    def least(*ways: str) -> str:
        return f"list_min([{', '.join(ways)}])"

    def closed(source: str, keep: str) -> str:
        users = [way(p, "3", "I", "chr(10) || 'user:'") for p in ("x0", "x1", "x3")]
        second = f"SELECT {keep}, x0, x1, {least('x2', *users)} AS x2, x3 FROM ({source})"
        return f"SELECT {keep}, x0, x1, x2, {least('x3', way('x2', '3', 'I', _ASSISTANT))} AS x3 FROM ({second})"

    def taken(initial: str, name: str, *places: str) -> list[str]:
        kept = [f"CASE WHEN NOT gone AND initial = '{initial}' THEN {way(p, 'mend', 'K', _LINE)} END" for p in places]
        return kept + [f"CASE WHEN NOT gone THEN {way(p, '3 + mend', 'R', f"chr(10) || '{name}:' || text")} END" for p in places if name]

    step = f"""SELECT s.conv, s.pos + 1 AS pos, {way('x0', '4', 'D')} AS x0, {least(way('x1', '4', 'D'), *taken('s', '', 'x0'))} AS x1,
        {least(way('x2', '4', 'D'), *taken('u', 'user', 'x0', 'x1', 'x3'))} AS x2,
        {least(way('x3', '4', 'D'), *taken('a', 'assistant', 'x2'))} AS x3
        FROM ways s JOIN marked m ON m.conv = s.conv AND m.pos = s.pos"""
    none = "CAST(NULL AS STRUCT(c BIGINT, s VARCHAR, o VARCHAR))"
    first = f"""SELECT DISTINCT conv, CAST(0 AS BIGINT) AS pos, struct_pack(c := CAST(0 AS BIGINT), s := '', o := '') AS x0,
        {none} AS x1, {none} AS x2, {none} AS x3 FROM marked"""
    return f"""
    WITH RECURSIVE named AS (
        SELECT conv_id, coalesce(CAST(conv_id AS VARCHAR), ' ') AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
            coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
    kinds AS (
        SELECT *, xor(list_reduce(list_transform(string_split(name, ''), lambda c: CAST(ord(c) AS BIGINT)), lambda crc, b:
            list_reduce(range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(crc, b)),
            CAST(4294967295 AS BIGINT)), 4294967295) % 20 AS kind FROM named),
    broken AS (
        SELECT conv, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
            CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
            unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS time
        FROM kinds WHERE kind <> 0),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) - 1 AS pos FROM broken),
    faults AS (
        SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv ORDER BY pos) AS before,
            CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
                WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY pos) > 1 THEN 'duplicate'
                WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' ELSE '' END AS fault
        FROM placed),
    marked AS (SELECT *, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS mend FROM faults),
    ways AS ({closed(first, "conv, pos")} UNION ALL {closed(step, "conv, pos")}),
    counted AS (
        SELECT conv, count(*) AS n, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
            count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal,
            coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps
        FROM marked GROUP BY conv),
    best AS (SELECT c.*, list_min([x0, x3]) AS w FROM counted c JOIN ways s ON s.conv = c.conv AND s.pos = c.n)
    SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
        CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(w.c, 0) AS BIGINT) AS cost,
        coalesce(w.s, '') AS audit, sha256(coalesce(w.o[2:], '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id, conv FROM named) LEFT JOIN best USING (conv)"""


@query(_repair_sql())
def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest repair of every damaged conversation."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return repair_conversations(damaged(turns), known=turns)[0]
