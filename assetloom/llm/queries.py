"""One query per training-data operator, over its whole table, and SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation, html, language, licenses, linededup, minhash, mixing, packing, pii, spelling, toxicity, vectors
from .common import field, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


@query("op1_toxicity")
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    doc_id = field("row", "doc_id")
    return scored.select(doc_id.alias("doc_id"), toxicity.held_out(doc_id).alias("held_out"), "score", "predicted", "spans")


@query("op2_pack")
def op2(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op3_pii")
def op3(spark, sf_dir):
    found = pii.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = {f"n_{kind}": F.size(F.filter("base", lambda x: x["kind"] == i)).cast("long") for i, kind in enumerate(pii.KINDS)}
    return found.select("doc_id", *[c.alias(n) for n, c in count.items()], F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"),
                        pii.joined(F.col("spans")).alias("spans"))


@query("op4_html")
def op4(spark, sf_dir):
    out = html.extract(table(spark, sf_dir, "pages"))
    return out.select(field("row", "page_id").alias("page_id"), field("row", "url").alias("url"), "text", F.length("text").cast("long").alias("n_chars"))


COSINE_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND list_dot_product(e, e) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT a AS vec_id, b AS other FROM links UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a),
low AS (SELECT vec_id, min(other) AS m FROM reach GROUP BY 1),
n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY 1)
SELECT v.vec_id, coalesce(n, 0) AS n_links, least(v.vec_id, coalesce(m, v.vec_id)) AS component_id, least(v.vec_id, coalesce(m, v.vec_id)) = v.vec_id AS kept
FROM v LEFT JOIN low USING (vec_id) LEFT JOIN n USING (vec_id)
"""


@query("op5_embedding_dedup", COSINE_SQL)
def op5(spark, sf_dir):
    done = vectors.near_duplicates(table(spark, sf_dir, "embeddings"))
    return done.select(field("row", "vec_id").alias("vec_id"), "n_links", "component_id", "kept")


SHINGLES_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
                        ELSE list_distinct([array_to_string(ws[i:i + 2], ' ') for i in range(1, len(ws) - 1)]) END AS s FROM w),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id
          GROUP BY 1, 2 HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
links AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT a AS doc_id, b AS other FROM links UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a),
low AS (SELECT doc_id, min(other) AS m FROM reach GROUP BY 1)
SELECT s.doc_id, len(s.s) AS n_shingles, least(s.doc_id, coalesce(m, s.doc_id)) AS component_id, least(s.doc_id, coalesce(m, s.doc_id)) = s.doc_id AS kept
FROM sets s LEFT JOIN low USING (doc_id)
"""


@query("op6_minhash", SHINGLES_SQL)
def op6(spark, sf_dir):
    done = minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), words=3, jaccard=(100, 85))
    return done.select(field("row", "doc_id").alias("doc_id"), "n_shingles", "component_id", "kept")


#: Checked by the tests after rounding; sums in another order may differ in the last place.
NEAREST_SQL = """
WITH v AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE list_dot_product(e, e) > 0),
s AS (SELECT q.vec_id AS query_id, b.vec_id, list_dot_product(q.e, b.e) AS score FROM ok q JOIN ok b ON q.vec_id % 20 = 0 AND q.vec_id <> b.vec_id)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, round(score, 9) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 20
"""


@query("op7_nearest")
def op7(spark, sf_dir):
    return vectors.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


LINES_SQL = f"""
WITH l AS (
  SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
w AS (SELECT *, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS n FROM l),
c AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS upto, sum(n) OVER (PARTITION BY doc_id ORDER BY i) - n AS before FROM w),
ahead AS (SELECT a.doc_id, a.i AS s, min(b.i) AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.upto - a.before >= {linededup.MIN_WORDS} GROUP BY ALL),
behind AS (SELECT b.doc_id, max(a.i) AS s, b.i AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.upto - a.before >= {linededup.MIN_WORDS} GROUP BY b.doc_id, b.i),
runs AS (SELECT doc_id, s, e FROM ahead UNION SELECT doc_id, s, e FROM behind),
texts AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
named AS (SELECT r.*, row_number() OVER (PARTITION BY array_to_string(t.ls[r.s + 1:r.e + 1], chr(10)), r.e - r.s ORDER BY r.doc_id, r.s) AS k
          FROM runs r JOIN texts t USING (doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, e + 1)) AS i FROM named WHERE k > 1),
kept AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) AS text FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i WHERE g.i IS NULL GROUP BY 1),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS INTEGER) AS n_lines, CAST(coalesce(g.n, 0) AS INTEGER) AS n_deleted,
       md5(coalesce(k.text, '')) AS text_md5
FROM documents d LEFT JOIN lost g USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""


@query("op8_line_dedup", LINES_SQL)
def op8(spark, sf_dir):
    done = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(field("row", "doc_id").alias("doc_id"), "n_lines", F.size("gone").alias("n_deleted"),
                       F.md5(F.coalesce("kept_text", F.lit(""))).alias("text_md5"))


@query("op9_licenses")
def op9(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = licenses.scan(docs, licenses.fit(docs))
    return found.select(field("row", "doc_id").alias("doc_id"), F.size("licences").alias("n_notices"),
                        F.array_join(F.array_sort(F.array_distinct(F.transform("licences", lambda x: x["family"]))), ",").alias("families"),
                        F.array_join(F.transform("licences", lambda x: F.concat_ws(":", x["paragraph"], x["family"])), ",").alias("notices"),
                        F.coalesce(F.array_min(F.transform("licences", lambda x: x["probability"])), F.lit(0.0)).alias("least_probability"))


MIX_SQL = f"""
WITH sizes AS (SELECT source, sum(coalesce(length(text), 0)) AS n FROM documents GROUP BY 1),
wanted AS (SELECT *, CASE WHEN n > 0 THEN pow(n, 0.5) ELSE 0 END AS w FROM sizes),
rates AS (SELECT source, CASE WHEN n > 0 THEN (SELECT sum(n) FROM wanted) * w / (SELECT sum(w) FROM wanted) / n ELSE 0 END AS rate FROM wanted),
pieces AS (SELECT *, greatest(1, ceil(rate / {mixing.PIECE})) AS m FROM rates),
cdf AS (SELECT source, k, sum(exp(-rate / m + k * ln(greatest(rate / m, 1e-300)) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c
        FROM pieces, (SELECT unnest(range(0, {mixing.STEPS + 1})) AS k)),
draws AS (SELECT doc_id, d.source, unnest(range(1, CAST(m AS BIGINT) + 1)) AS j FROM documents d JOIN pieces p ON d.source IS NOT DISTINCT FROM p.source),
u AS (SELECT doc_id, source, (CAST('0x' || substr(md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || j), 1, 13) AS BIGINT) + 0.5) / 4503599627370496 AS u FROM draws),
counts AS (SELECT doc_id, u.source, count(c.k) AS n FROM u LEFT JOIN cdf c ON c.source IS NOT DISTINCT FROM u.source AND c.c <= u.u GROUP BY 1, 2)
SELECT doc_id, source, CAST(copy AS INTEGER) AS copy, md5('order{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || copy) AS shuffle_key
FROM (SELECT doc_id, source, unnest(range(1, n + 1)) AS copy FROM counts)
"""


@query("op10_mix", MIX_SQL)
def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mixing.replicate(docs, mixing.source_rates(docs), keep=["doc_id", "source"])
    return mixed.select(field("row", "doc_id").alias("doc_id"), field("row", "source").alias("source"), "copy", "shuffle_key")


@query("op11_spelling")
def op11(spark, sf_dir):
    words = spelling.vocabulary(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return spelling.variants(words)


@query("op12_language")
def op12(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    named = language.identify(docs, language.fit(docs), keep=["doc_id"])
    doc_id = field("row", "doc_id")
    return named.select(doc_id.alias("doc_id"), toxicity.held_out(doc_id).alias("held_out"), "lang_pred", "score")


@query("op13_conversation")
def op13(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return conversation.digested(conversation.repair(conversation.damaged(rows), ids=rows))
