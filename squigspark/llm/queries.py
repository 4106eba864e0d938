"""The ``opN_*`` queries: every operator over its whole table, with the parameters of production.

Each callable takes (spark, sf_dir).  ``ORACLE`` holds DuckDB SQL where the operation can be said in it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, decontaminate, divergence, embeddings, htmltext, langid, packing, runindex, secrets, simhash, toxicity, urlfilter, warc
from .common import cut, id_bucket, spread, table

LANG_FOLDS, LANG_HELD = 4, 2
TOXIC_FOLDS, TOXIC_HELD = 5, 0


def packing_config() -> packing.PackingConfig:
    return packing.PackingConfig(public_tokenizers.path("word_bpe_49k.json"))


def langid_model(docs: DataFrame) -> langid.LangIdModel:
    """The production model: learned from all folds but the held-out one."""
    return langid.fit_langid(docs, id_bucket("doc_id", LANG_FOLDS) != LANG_HELD)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    held = F.coalesce(id_bucket("doc_id", LANG_FOLDS) == LANG_HELD, F.lit(False))
    scored = langid.with_language(docs.select("doc_id", "text", held.alias("held_out")), langid_model(docs))
    return scored.select("doc_id", "held_out", "lang_pred", "score")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), packing_config())


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.select("doc_id", simhash.hex_fingerprint("fp").alias("fingerprint"), "component_id")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit_toxicity(docs, labels, id_bucket("doc_id", TOXIC_FOLDS) != TOXIC_HELD)
    held = F.coalesce(id_bucket("doc_id", TOXIC_FOLDS) == TOXIC_HELD, F.lit(False))
    scored = toxicity.with_toxicity(docs.withColumn("held_out", held), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg = urlfilter.UrlModelConfig()
    weights = urlfilter.fit_weights(urlfilter.labelled_urls(spark), cfg)
    return urlfilter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), weights, cfg)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op7_near_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embeddings.near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return warc.read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.matches(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "benchmark"))
    return found.withColumn("score", F.round("score", 6))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.page_texts(spread(table(spark, sf_dir, "pages").select("page_id", "html")))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    turns = conversations.damaged(rows)
    audits = cut(conversations.conversation_audits(turns))
    found = audits.withColumnRenamed("conv_id", "own").join(conversations.repaired_digests(turns, audits).withColumnRenamed("conv_id", "other"), F.col("own").eqNullSafe(F.col("other")))
    every = rows.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("own")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runindex.digests(runindex.without_repeats(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(spread(table(spark, sf_dir, "documents").select("text", "lang", "source")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_language_id, op2_packing, op3_simhash, op4_toxicity, op5_url_filter, op6_secret_scan, op7_near_embeddings, op8_warc, op9_decontamination, op10_html_text, op11_conversation_repair, op12_run_index, op13_source_divergence, pipeline)}

_BASE32 = " || ".join(
    f"array_to_string(list_transform(range(7, -1, -1), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, {1 + 10 * k}, 10))::BIGINT >> (5 * i)) & 31)::INT, 1)), '')" for k in range(4)
)

_CRC32 = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda c: ascii(c)::BIGINT)), lambda x, b: list_reduce([xor(x, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))))"


def _cheapest(state: int) -> str:
    """The best way on from a row in a state, no turn being inserted before it: cost, initials, repaired text."""
    moves = {0: "CASE ini[i] WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE -1 END", 1: "CASE ini[i] WHEN 'u' THEN 2 ELSE -1 END", 2: "CASE ini[i] WHEN 'a' THEN 3 ELSE -1 END", 3: "CASE ini[i] WHEN 'u' THEN 2 ELSE -1 END"}[state]
    role, to = ("assistant", 3) if state == 2 else ("user", 2)
    more, b = "CASE fault[i] WHEN 3 THEN 5 ELSE 0 END", ["b0", "b1", "b2", "b3"]
    way = lambda cost, letter, line, then: f"{{'c': ({cost} + {then}.c)::BIGINT, 'a': '{letter}' || {then}.a, 't': {line} || {then}.t}}"
    stays = "fault[i] NOT IN (1, 2)"
    keeps = " ".join(f"WHEN {stays} AND {moves} = {q} THEN {way(more, 'K', 'roles[i] || chr(58) || texts[i] || chr(10)', b[q])}" for q in (1, 2, 3))
    renames = f"WHEN {stays} THEN {way(f'1 + {more}', 'R', f"'{role}:' || texts[i] || chr(10)", b[to])}"
    never = "{'c': 1000000000::BIGINT, 'a': '', 't': ''}"
    return f"list_sort([{way(2, 'D', "''", b[state])}, CASE {keeps} ELSE {never} END, CASE {renames} ELSE {never} END])[1]"


def _inserting(own: str, then: str, role: str) -> str:
    return f"list_sort([{own}, {{'c': (5 + {then}.c)::BIGINT, 'a': 'I' || {then}.a, 't': '{role}:' || chr(10) || {then}.t}}])[1]"


_INSERTED = f"""SELECT conv_id, i, roles, texts, ini, fault, {_inserting('n0', 'm2', 'user')} AS b0, {_inserting('n1', 'm2', 'user')} AS b1, m2 AS b2, {_inserting('n3', 'n2', 'user')} AS b3
                FROM (SELECT *, {_inserting('n2', 'n3', 'assistant')} AS m2 FROM"""
_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE = {
    "op8_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
             f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
        SELECT page_id, octet_length(encode(t))::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
        FROM p JOIN f USING (h)""",
    "op7_near_embeddings": """
        WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
                             WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
             l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
             r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
             c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
             n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
        SELECT c.a AS vec_id, coalesce(n.n, 0) AS n_links, component_id, c.a = component_id AS kept FROM c LEFT JOIN n ON n.a = c.a""",
    "op9_decontamination": r"""
        WITH raw_words AS (SELECT 'd' AS kind, doc_id AS id, 0 AS part, string_split_regex(coalesce(text, ''), '[ \t\n\v\f\r]+') AS c FROM documents),
             item_parts AS (SELECT item_id, unnest(p) AS s, generate_subscripts(p, 1) AS part
                            FROM (SELECT item_id, string_split(regexp_replace(regexp_replace(trim(text), '([.?!:])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)) AS p FROM benchmark)),
             pieces AS (SELECT * FROM raw_words UNION ALL SELECT 'i', item_id, part, string_split_regex(s, '[ \t\n\v\f\r]+') FROM item_parts),
             chunks AS (SELECT kind, id, part, unnest(c) AS c, generate_subscripts(c, 1) AS k FROM pieces),
             terms AS (SELECT kind, id, part, k, lower(regexp_replace(regexp_replace(c, '^[^\p{L}\p{N}]+', ''), '[^\p{L}\p{N}]+$', '')) AS t FROM chunks),
             words AS (SELECT kind, id, part, t, row_number() OVER (PARTITION BY kind, id ORDER BY part, k) - 1 AS i FROM terms WHERE t <> ''),
             item_words AS (SELECT id AS item_id, t, i, count(*) OVER (PARTITION BY id) AS n, max(part) OVER (PARTITION BY id) AS last, min(part) OVER (PARTITION BY id) AS first, part FROM words WHERE kind = 'i'),
             sides AS (SELECT item_id, t, i, n, CASE WHEN first < last THEN part = last WHEN n > 1 THEN i >= n - greatest(1, n // 4) ELSE false END AS answer FROM item_words),
             sizes AS (SELECT count(*) AS items, avg(n) AS mean, max(n) AS longest FROM (SELECT item_id, max(n) AS n FROM item_words GROUP BY item_id)),
             tf AS (SELECT item_id, t, any_value(n) AS n, count(*) AS tf FROM item_words GROUP BY item_id, t),
             df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
             own AS (SELECT item_id, t, ln(1 + (items - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / mean)) AS x FROM tf JOIN df USING (t), sizes),
             weights AS (SELECT item_id, t, x / sum(x) OVER (PARTITION BY item_id) AS x FROM own),
             placed AS (SELECT id AS doc_id, t, i, i // longest - b AS p FROM words, sizes, (VALUES (0), (1)) AS v(b) WHERE kind = 'd' AND i // longest - b >= 0),
             scores AS (SELECT doc_id, p, item_id, sum(x) AS score FROM (SELECT DISTINCT doc_id, p, t FROM placed) JOIN weights USING (t) GROUP BY doc_id, p, item_id HAVING sum(x) >= 0.6::DOUBLE - 1e-9::DOUBLE),
             texts AS (SELECT doc_id, p, ' ' || string_agg(t, ' ' ORDER BY i) || ' ' AS s FROM placed SEMI JOIN scores USING (doc_id, p) GROUP BY doc_id, p),
             wanted AS (SELECT item_id, answer, list(t ORDER BY i) AS ts FROM sides GROUP BY item_id, answer),
             shingled AS (SELECT item_id, answer, CASE WHEN len(ts) >= 5 THEN list_distinct(list_transform(range(1, len(ts) - 3), lambda j: array_to_string(ts[j:j + 4], ' '))) ELSE [array_to_string(ts, ' ')] END AS g FROM wanted),
             held AS (SELECT doc_id, p, item_id, answer, len(list_filter(g, lambda q: contains(s, ' ' || q || ' ')))::DOUBLE / len(g) AS share FROM scores JOIN texts USING (doc_id, p) JOIN shingled USING (item_id)),
             judged AS (SELECT doc_id, p, item_id, score, coalesce(max(share) FILTER (NOT answer), 1) AS q, coalesce(max(share) FILTER (answer), 1) AS a FROM scores LEFT JOIN held USING (doc_id, p, item_id) GROUP BY ALL),
             ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY round(score, 9) DESC, q DESC, a DESC, p) AS r FROM judged WHERE q >= 0.8 AND a >= 0.8)
        SELECT doc_id, item_id, round(score, 6) AS score, q AS question_overlap, a AS answer_overlap, p * longest AS passage_start FROM ranked, sizes WHERE r = 1""",
    "op12_run_index": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
             w AS (SELECT doc_id, i, hash(substr(h, 2 * i + 1, 100)) AS s FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS i FROM d)),
             f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
             hits AS (SELECT doc_id, i FROM w JOIN f USING (s) WHERE first < doc_id),
             edges AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50, true)::INT AS e FROM hits),
             runs AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (SELECT doc_id, i, sum(e) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM edges) GROUP BY doc_id, k),
             gone AS (SELECT doc_id, sum(b - a)::BIGINT AS n, count(*) AS k, list(a ORDER BY a) AS xs, list(b ORDER BY a) AS ys FROM runs GROUP BY doc_id)
        SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n, 0) AS n_removed, coalesce(k, 0) AS n_spans,
               sha256(unhex(CASE WHEN k IS NULL THEN h ELSE array_to_string(list_transform(range(0, k + 1), lambda j: substr(h, 2 * coalesce(ys[j], 0) + 1, 2 * (coalesce(xs[j + 1], len(h) // 2) - coalesce(ys[j], 0)))), '') END)) AS kept_sha256
        FROM d LEFT JOIN gone USING (doc_id)""",
    "op13_source_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                          regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
             w AS (SELECT r, lang, source, unnest(ws) AS t FROM d),
             kept AS (SELECT lang, t FROM w GROUP BY lang, t HAVING count(DISTINCT r) >= 10),
             v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
             groups AS (SELECT DISTINCT lang, source FROM d),
             c AS (SELECT lang, source, t, count(*) AS n FROM w SEMI JOIN kept USING (lang, t) GROUP BY lang, source, t),
             cells AS (SELECT g.lang, g.source, k.t, coalesce(c.n, 0) AS n FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.t = k.t),
             p AS (SELECT lang, source, t, n, 1 + 1000000000 * (n + 2) // ((sum(n) OVER (PARTITION BY lang, source))::BIGINT + 2 * v) AS p FROM cells JOIN v USING (lang)),
             q AS (SELECT lang, t, 1 + 1000000000 * (n + 2) // ((sum(n) OVER (PARTITION BY lang))::BIGINT + 2 * v) AS q FROM (SELECT lang, t, sum(n)::BIGINT AS n FROM cells GROUP BY lang, t) JOIN v USING (lang)),
             sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL),
             parts AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
                       UNION ALL SELECT lang, source, 'term', t, (p - q) * (p - q) // (p + q) FROM p JOIN q USING (lang, t) WHERE n > 0 AND p > q)
        SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM parts QUALIFY part = 'pair' OR rank <= 10""",
    "op11_conversation_repair": f"""
        WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
             lots AS (SELECT *, {_CRC32} % 20 AS lot FROM keyed),
             hurt AS (SELECT conv_id, turn, CASE lot WHEN 4 THEN 'user' ELSE role END AS role, CASE lot WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(0, CASE lot WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM lots WHERE lot <> 0),
             judged AS (SELECT *, row_number() OVER w AS k, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again, rtrim(text, {_WHITE}) AS e FROM hurt WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy)),
             faults AS (SELECT *, substr(role, 1, 1) AS ini, CASE WHEN e = '' THEN 1 WHEN again > 1 THEN 2 WHEN right(e, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM judged),
             pairs AS (SELECT *, lag(ini) OVER (PARTITION BY conv_id ORDER BY k) || ini AS pair FROM faults),
             convs AS (SELECT conv_id, list(role ORDER BY k) AS roles, list(text ORDER BY k) AS texts, list(ini ORDER BY k) AS ini, list(fault ORDER BY k) AS fault,
                              coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
                              count(*) FILTER (k > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM pairs GROUP BY conv_id),
             walk AS ({_INSERTED} (SELECT conv_id, len(fault) AS i, roles, texts, ini, fault, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS n0, {{'c': 1000000000::BIGINT, 'a': '', 't': ''}} AS n1, n1 AS n2, n0 AS n3 FROM convs))
                      UNION ALL
                      {_INSERTED} (SELECT conv_id, i - 1 AS i, roles, texts, ini, fault, {_cheapest(0)} AS n0, {_cheapest(1)} AS n1, {_cheapest(2)} AS n2, {_cheapest(3)} AS n3 FROM walk WHERE i > 0))),
             done AS (SELECT conv_id, b0.c AS cost, b0.a AS audit, b0.t AS t FROM walk WHERE i = 0)
        SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(left(t, length(t) - 1), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN convs ON convs.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM o.conv_id""",
}
