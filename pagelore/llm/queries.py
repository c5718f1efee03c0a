"""The registered queries of this folder, next to the SQL they must equal."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelore.llm import alignment, bpe, licenses, quality, toxicity
from pagelore.llm.decontamination import contamination, hit_words
from pagelore.llm.embeddings import near_vectors
from pagelore.llm.lines import LONG_WORDS, remove_repeated_lines
from pagelore.llm.ngrams import score_held_out
from pagelore.llm.simhash import simhash_groups
from pagelore.llm.substrings import remove_repeats
from pagelore.llm.tables import bucket_of, saved, table
from pagelore.llm.trie import prefix_trie
from pagelore.llm.warc import fixity_check
from pagelore.session import new_path, ship_package

#: Folder of the tokenizer files; the installed package unless set otherwise.
TOKENIZERS = os.environ.get("PAGELORE_TOKENIZERS") or os.path.dirname(public_tokenizers.path("word_bpe_49k.json"))

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def prepare(spark: SparkSession) -> None:
    """Ships the package and bounds what one Arrow batch holds, however long its texts are."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def query(run: Callable[[SparkSession, str], DataFrame]):
    def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return run(spark, sf_dir)

    QUERIES[run.__name__] = shipped
    return run


@query
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{TOKENIZERS}/word_bpe_49k.json"
    coded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path).drop("text"), path)
    return coded.select(
        "doc_id", bpe.token_count().alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


@query
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


@query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), to="kept_text", long_words=LONG_WORDS)
    gone = F.aggregate("removed_spans", F.lit(0), lambda n, s: n + s["stop"] - s["start"])
    return cut.select(
        "doc_id", F.col("n_lines").cast("long").alias("n_lines"), gone.cast("long").alias("n_removed"),
        F.size("removed_spans").cast("long").alias("n_runs"),
        F.sha2(F.encode(F.coalesce("kept_text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


ORACLE_SQL["op1_line_dedup"] = r"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
p AS (SELECT doc_id, unnest(range(len(ls))) AS pos, ls FROM l),
w AS (SELECT doc_id, pos, ls[pos + 1] AS a, ls[pos + 2] AS b FROM p WHERE pos + 1 < len(ls)),
f AS (SELECT *, min({'d': doc_id, 'p': pos}) OVER (PARTITION BY a, b) AS first FROM w),
o AS (SELECT doc_id, pos, min({'d': doc_id, 'p': pos}) OVER (PARTITION BY ls[pos + 1]) AS first FROM p
      WHERE len(regexp_extract_all(ls[pos + 1], '[^\x{20}\x{09}-\x{0D}]+')) >= 50),
g AS (SELECT DISTINCT doc_id, pos + o AS pos FROM f, (VALUES (0), (1)) t(o) WHERE {'d': doc_id, 'p': pos} > first
      UNION SELECT doc_id, pos FROM o WHERE {'d': doc_id, 'p': pos} > first),
k AS (SELECT p.doc_id, p.pos, p.ls[p.pos + 1] AS line, g.pos IS NOT NULL AS gone,
             g.pos IS NOT NULL AND lag(g.pos) OVER (PARTITION BY p.doc_id ORDER BY p.pos) IS NULL AS opens
      FROM p LEFT JOIN g ON p.doc_id = g.doc_id AND p.pos = g.pos)
SELECT l.doc_id, coalesce(count(k.pos), 0)::BIGINT AS n_lines, coalesce(sum(k.gone::INT), 0)::BIGINT AS n_removed,
       coalesce(sum(k.opens::INT), 0)::BIGINT AS n_runs,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (NOT k.gone), '')) AS kept_sha256
FROM l LEFT JOIN k ON l.doc_id = k.doc_id GROUP BY l.doc_id
"""


@query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", hit_words().alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("item_ids"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"))


ORACLE_SQL["op3_decontamination"] = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+'), []) AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS ws FROM benchmark WHERE item_id IS NOT NULL),
i AS (SELECT item_id, ws, least(10, len(ws)) AS n, unnest(range(len(ws) - least(10, len(ws)) + 1)) AS p FROM b WHERE len(ws) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(ws[p + 1:p + n], ' ') AS w FROM i),
sizes AS (SELECT DISTINCT n FROM iw),
dp AS (SELECT doc_id, ws, n, unnest(range(len(ws) - n + 1)) AS p FROM d, sizes WHERE len(ws) >= n),
h AS (SELECT dp.doc_id, dp.p, dp.n, iw.item_id FROM dp JOIN iw ON iw.n = dp.n AND iw.w = array_to_string(dp.ws[p + 1:p + dp.n], ' ')),
hit AS (SELECT doc_id, count(DISTINCT x)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS x FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(i, ',' ORDER BY i) AS s
       FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""


ORACLE_SQL["op5_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, coalesce(list_filter(string_split_regex(text, '[\x{20}\x{09}-\x{0D}]+'), lambda x: x <> ''), []) AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(len(ws) - 49)) AS p FROM d WHERE len(ws) >= 50),
w AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY array_to_string(ws[p + 1:p + 50], ' ')) AS low FROM p),
g AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS x FROM w WHERE low < doc_id),
a AS (SELECT doc_id, ws, unnest(range(len(ws))) AS x FROM d),
k AS (SELECT a.doc_id, count(g.x)::BIGINT AS n_removed,
             string_agg(ws[a.x + 1], ' ' ORDER BY a.x) FILTER (g.x IS NULL) AS s
      FROM a LEFT JOIN g ON a.doc_id = g.doc_id AND a.x = g.x GROUP BY a.doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", (bucket_of(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select(
        "doc_id", (bucket_of(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


ORACLE_SQL["op4_embedding_dedup"] = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
      AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.b FROM r JOIN l ON r.y = l.a),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(component_id, vec_id) AS component_id,
       vec_id = coalesce(component_id, vec_id) AS kept
FROM embeddings LEFT JOIN n ON vec_id = a LEFT JOIN c ON vec_id = x
"""


@query
def op9_ngram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_held_out(table(spark, sf_dir, "documents"))


@query
def op10_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two replicas of all pages; in the second every 97th page is damaged."""
    found = fixity_check(table(spark, sf_dir, "pages"), new_path(spark, "warc"), F.col("page_id") % 97 == 13)
    return found.select(
        F.regexp_extract("record_id", r"urn:page:(-?\d+)", 1).cast("long").alias("page_id"), "archive", "ordinal",
        F.col("start").alias("first_byte"), F.col("stop").alias("end_byte"), "sha256", "intact")


ORACLE_SQL["op10_warc_fixity"] = r"""
WITH r AS (
  SELECT page_id, page_id // 1024 AS archive, coalesce(html, '') AS html, concat(
    'WARC/1.1', chr(13), chr(10), 'WARC-Type: resource', chr(13), chr(10), 'WARC-Record-ID: <urn:page:', page_id, '>', chr(13), chr(10),
    'WARC-Date: 1970-01-01T00:00:00Z', chr(13), chr(10), 'WARC-Target-URI: ' || url || chr(13) || chr(10),
    'Content-Type: text/html', chr(13), chr(10), 'Content-Length: ', strlen(coalesce(html, '')), chr(13), chr(10), chr(13), chr(10),
    coalesce(html, ''), chr(13), chr(10), chr(13), chr(10)) AS rec
  FROM pages),
o AS (SELECT *, row_number() OVER w - 1 AS ordinal, sum(strlen(rec)) OVER w AS stop FROM r WINDOW w AS (PARTITION BY archive ORDER BY page_id))
SELECT page_id, archive, ordinal, (stop - strlen(rec))::BIGINT AS first_byte, stop::BIGINT AS end_byte, sha256(rec) AS sha256,
       NOT (page_id % 97 = 13 AND html <> '' AND left(html, 1) <> '#') AS intact
FROM o
"""


@query
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model"
    aligned = alignment.align(table(spark, sf_dir, "documents").select("doc_id", "text"), *files).drop("text")
    links = saved(aligned.select(
        "doc_id", *(f"alignment.{c}" for c in ("n_a", "n_b", "n_groups")),
        (F.octet_length("alignment.links") / 4).cast("long").alias("n_links"),
        F.when(F.col("alignment.n_groups") > 0, F.sha2(F.encode("alignment.groups", "UTF-8"), 256)).otherwise("").alias("groups_sha256"),
        F.col("alignment.links").alias("links")), "links")
    return alignment.link_scores(links, "links", alignment.link_counts(links, "links", *files)).drop("links")


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


ORACLE_SQL["op12_prefix_trie"] = r"""
WITH t AS (SELECT conv_id, {'r': coalesce(role, ''), 'x': coalesce(text, '')} AS v,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
           FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list(v ORDER BY pos) AS own,
        xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
          lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0],
            lambda u, z: CASE WHEN u % 2 = 1 THEN xor(u // 2, 3988292384::BIGINT) ELSE u // 2 END)), 4294967295::BIGINT) % 6 AS h
      FROM t GROUP BY conv_id),
r AS (SELECT c.conv_id, list_concat(list_slice(coalesce(b.own, []), 1, c.h), list_slice(c.own, c.h + 1, len(c.own))) AS s
      FROM c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 100),
n AS (SELECT conv_id, s, unnest(range(len(s) + 1)) AS d FROM r),
k AS (SELECT list_slice(s, 1, d) AS p, d, min(conv_id) AS conv_id, count(*) AS n_convs,
        string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(s) = d) AS ends FROM n GROUP BY ALL),
u AS (SELECT list_slice(p, 1, d - 1) AS up, count(*) AS n_children FROM k WHERE d > 0 GROUP BY ALL),
m AS (SELECT k.*, coalesce(n_children, 0) AS n_children, CASE WHEN d > 0 THEN (n_convs - 1) * length(p[d].x) ELSE 0 END AS own
      FROM k LEFT JOIN u ON k.p = u.up),
x AS (SELECT p, n_children, own, unnest(range(d + 1)) AS e FROM m),
a AS (SELECT list_slice(p, 1, e) AS up, sum((n_children = 0)::INT) AS n_leaves, sum(own) AS saved FROM x GROUP BY ALL)
SELECT m.conv_id, m.d::BIGINT AS depth, q.conv_id AS parent_conv_id, m.n_convs, m.n_children, a.n_leaves::BIGINT AS n_leaves,
       a.saved::BIGINT AS saved_tokens, sha256(coalesce(m.ends, '')) AS ends_sha256
FROM m JOIN a ON a.up = m.p LEFT JOIN k q ON m.d > 0 AND q.p = list_slice(m.p, 1, m.d - 1)
"""


@query
def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score is 1 where a template matches, 0.5 where only a phrase stands, else 0."""
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    phrases, templates = F.col("license_scan.phrases"), F.col("license_scan.templates")

    def joined(labels):
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    return found.select(
        "doc_id", "license_scan.n_words", F.size(phrases).cast("long").alias("n_base"),
        F.array_min(phrases["start"]).alias("first_word"), F.array_max(phrases["start"]).alias("last_word"),
        joined(phrases["label"]).alias("base_labels"), joined(F.concat(phrases["label"], templates["label"])).alias("labels"),
        F.when(F.size(templates) > 0, 1.0).when(F.size(phrases) > 0, 0.5).otherwise(0.0).alias("score"))


def _license_sql() -> str:
    phrases = ", ".join(f"({list(licenses.words_of(p))}, '{label}')" for p, label in licenses.PHRASES.items())
    templates = ", ".join(f"('{licenses.as_pattern(licenses.parse(t))}(?: |$)', '{label}')" for label, t in licenses.TEMPLATES.items())
    return rf"""
WITH ph(ws, label) AS (VALUES {phrases}), tm(pattern, label) AS (VALUES {templates}),
d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x{{00}}-\x{{2F}}\x{{3A}}-\x{{60}}\x{{7B}}-\x{{7F}}]+'), []) AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(len(ws))) AS i FROM d),
b AS (SELECT doc_id, i, label FROM p JOIN ph ON p.ws[i + 1:i + len(ph.ws)] = ph.ws),
t AS (SELECT doc_id, label FROM d JOIN tm ON regexp_matches(' ' || array_to_string(ws, ' '), pattern)),
l AS (SELECT doc_id, label, 1 AS base FROM b UNION SELECT doc_id, label, 0 FROM t),
bb AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word FROM b GROUP BY doc_id),
ll AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base = 1) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) AS labels, min(base) = 0 AS whole FROM l GROUP BY doc_id)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN whole THEN 1.0::DOUBLE WHEN n_base > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score
FROM d LEFT JOIN bb ON d.doc_id = bb.doc_id LEFT JOIN ll ON d.doc_id = ll.doc_id
"""


ORACLE_SQL["op13_license_scan"] = _license_sql()


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run   # it imports this module

    return run(spark, sf_dir)
