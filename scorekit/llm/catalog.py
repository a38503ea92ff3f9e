"""The queries of this subpackage, each over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import materialize, new_path
from .chunk_dedup import exact_duplicates
from .common import LOWER, PLAIN_WORD, SPACED_WORD, UPPER, load
from .disclosure import KINDS, sanitise
from .id_output import read_ids, write_ids
from .importance import resample
from .jaccard_join import jaccard_groups
from .mixing import plan_mix
from .ranked_search import search
from .secret_scan import scan_secrets, train
from .token_rollup import TokenRollup
from .toxic_segments import score_toxicity
from .url_trust import judge_urls
from .weak_quality import score_quality
from .winnow import decontaminate

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return add


@query("op5_exact_dedup", r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id) = 1 AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm)""")
def op5_exact_dedup(spark, sf_dir):
    return exact_duplicates(load(spark, sf_dir, "documents"))


@query("op9_decontaminate", rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{PLAIN_WORD}') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{PLAIN_WORD}') AS ws FROM benchmark),
b2 AS (SELECT item_id, ws, least(len(ws), 10) AS s FROM b WHERE len(ws) > 0),
wins AS (SELECT DISTINCT item_id, s, ws[i:i + s - 1] AS win FROM (SELECT item_id, ws, s, unnest(range(1, len(ws) - s + 2)) AS i FROM b2)),
spans AS (SELECT DISTINCT s FROM b2),
sites AS (SELECT doc_id, s, i, ws[i:i + s - 1] AS win
          FROM (SELECT doc_id, ws, s, unnest(range(1, len(ws) - s + 2)) AS i FROM d, spans WHERE len(ws) >= s)),
hits AS (SELECT DISTINCT doc_id, s, i, item_id FROM sites JOIN wins USING (s, win)),
marked AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + s)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hits) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN marked USING (doc_id) LEFT JOIN named USING (doc_id)""")
def op9_decontaminate(spark, sf_dir):
    out = decontaminate(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), "contaminated")


@query("op1_url_trust")
def op1_url_trust(spark, sf_dir):
    return judge_urls(load(spark, sf_dir, "pages"))


@query("op3_secret_scan")
def op3_secret_scan(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    found = scan_secrets(docs, train(docs))

    def shown(spans):
        return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))

    def count(kind):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda x: x["kind"] != "markov")
    return found.select("doc_id", *[count(k) for k in ("assign", "access", "hex", "markov")],
                        F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


# Two tokenizers; a revision of the first also counts line ends; documents that labels call junk are taken down.
@query("op4_token_rollup", rf"""
WITH d AS (SELECT source, lang, len(regexp_extract_all(coalesce(text, ''), '{SPACED_WORD}')) + len(regexp_extract_all(coalesce(text, ''), '\n')) AS spaced,
                  len(regexp_extract_all(coalesce(text, ''), '{PLAIN_WORD}')) AS plain
           FROM documents WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0 AND doc_id IS NOT NULL))
SELECT source, lang, 'spaced-1' AS tokenizer, count(*) AS n_docs, sum(spaced)::BIGINT AS n_tokens FROM d GROUP BY ALL
UNION ALL SELECT source, lang, 'plain-1', count(*), sum(plain)::BIGINT FROM d GROUP BY ALL""")
def op4_token_rollup(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    count = lambda p, name: F.regexp_count(text, F.lit(p)).cast("long").alias(name)
    docs = materialize(load(spark, sf_dir, "documents").select(
        "doc_id", "source", "lang", count(SPACED_WORD, "spaced"), count(PLAIN_WORD, "plain"), count("\n", "breaks")), "counts")
    junk = load(spark, sf_dir, "labels").where("quality = 0").select("doc_id", F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("lang"))

    def changes(op, frame, tokenizer, tokens):
        return frame.select(F.lit(op).alias("op"), "doc_id", "source", "lang", F.lit(tokenizer).alias("tokenizer"), tokens.alias("tokens"))

    spaced, plain = changes("insert", docs, "spaced-1", F.col("spaced")), changes("insert", docs, "plain-1", F.col("plain"))
    recount = changes("revise", docs, "spaced-1", F.col("spaced") + F.col("breaks"))
    gone = changes("delete", junk, "spaced-1", F.lit(0)).unionByName(changes("delete", junk, "plain-1", F.lit(0)))
    rollup = TokenRollup(spark, new_path(spark, "rollup"))
    # A failed driver would try batches again, so two of them come twice.
    for name, batch in (("spaced", spaced), ("plain", plain), ("spaced", spaced), ("recount", recount), ("junk", gone), ("junk", gone)):
        rollup.commit(name, batch)
    return rollup.totals()


_WORDS = f"len(regexp_extract_all(coalesce(text, ''), '{SPACED_WORD}'))"


@query("op7_mixing", rf"""
WITH d AS (SELECT doc_id, source, {_WORDS}::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS k, text FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS most,
             [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM d GROUP BY source),
t AS (SELECT sum(source_size)::BIGINT AS size, sum(weight)::BIGINT AS weight FROM s),
c AS (SELECT *, sum(most) OVER w AS capped, sum(weight) OVER w AS used, row_number() OVER w AS n FROM s
      WINDOW w AS (ORDER BY most / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
l AS (SELECT 0 AS n, t.size / t.weight AS level, (SELECT min(most / weight) FROM s) AS next FROM t
      UNION ALL
      SELECT n, (t.size - capped)::BIGINT / (t.weight - used)::BIGINT, lead(most / c.weight) OVER (ORDER BY n) FROM c, t WHERE t.weight > used),
v AS (SELECT level FROM l WHERE next IS NULL OR level <= next ORDER BY n LIMIT 1),
b AS (SELECT source, source_size, least(most::DOUBLE, weight * level) AS target FROM s, v),
p AS (SELECT d.doc_id, d.size, b.source_size, b.target, floor(b.target)::BIGINT AS quota,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS bef
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE (quota // source_size) * size + greatest(0, least(size, quota % source_size - bef)) END::BIGINT AS taken
FROM p""")
def op7_mixing(spark, sf_dir):
    return plan_mix(load(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op10_toxicity")
def op10_toxicity(spark, sf_dir):
    out = score_toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted", F.size("passages").cast("long").alias("n_passages"))


@query("op6_id_output")
def op6_id_output(spark, sf_dir):
    return encoded(spark, load(spark, sf_dir, "documents"))


def encoded(spark: SparkSession, docs: DataFrame) -> DataFrame:
    path = new_path(spark, "ids")
    write_ids(docs, path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_ids(spark, path)


@query("op8_weak_quality")
def op8_weak_quality(spark, sf_dir):
    return score_quality(load(spark, sf_dir, "documents")).drop("row")


@query("op2_jaccard_join")
def op2_jaccard_join(spark, sf_dir):
    return jaccard_groups(load(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op11_importance_resampling", rf"""WITH t AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)),
             lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS step),
w AS (SELECT 'd' AS side, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{PLAIN_WORD}') AS ws FROM documents
      UNION ALL SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{PLAIN_WORD}') FROM benchmark),
f AS (SELECT side, id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS x FROM w),
n AS (SELECT side, id, x, count(*) AS k FROM f GROUP BY ALL),
c AS (SELECT x, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(0, len(hex(x)) // 2), lambda i: ('0x' || hex(x)[2 * i + 1:2 * i + 2])::BIGINT)),
             lambda a, b: xor(a >> 8, step[xor(a & 255, b) + 1]))) % 10000 AS bucket FROM (SELECT DISTINCT x FROM n), t),
h AS (SELECT bucket, sum(k) FILTER (WHERE side = 'd') AS s, sum(k) FILTER (WHERE side = 'b') AS t FROM n JOIN c USING (x) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM h) + 10000)
             / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT sum(t) FROM h) + 10000))))::BIGINT AS gain FROM h),
m AS (SELECT id, sum(k)::BIGINT AS n_features, floor(sum(k * gain)::DOUBLE / sum(k))::BIGINT AS weight FROM n JOIN c USING (x) JOIN g USING (bucket) WHERE side = 'd' GROUP BY id),
d AS (SELECT id AS doc_id, len(ws) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
      FROM (FROM w WHERE side = 'd') LEFT JOIN m USING (id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS total FROM d WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * total // 100 THEN place END AS rank FROM d LEFT JOIN r USING (doc_id)""")
def op11_importance_resampling(spark, sf_dir):
    out = resample(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


_TERMS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{PLAIN_WORD}')"


@query("op13_ranked_search", rf"""
WITH q AS (SELECT DISTINCT item_id, t FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark)),
d AS (SELECT doc_id, ws, len(ws)::BIGINT AS n FROM (SELECT doc_id, {_TERMS} AS ws FROM documents) WHERE len(ws) > 0),
c AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS l FROM d),
p AS (SELECT doc_id, n, t, count(*)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(ws) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY t, nd),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nd) // l))))::BIGINT AS score
      FROM q JOIN p USING (t) JOIN w USING (t), c GROUP BY ALL),
r AS (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 10""")
def op13_ranked_search(spark, sf_dir):
    return search(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


@query("op12_pii_disclosure")
def op12_pii_disclosure(spark, sf_dir):
    found = sanitise(load(spark, sf_dir, "documents"), with_text=False)

    def shown(spans):
        return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))

    def count(kind):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda x: x["kind"].isin(*KINDS))
    return found.select("doc_id", *[count(k) for k in (*KINDS, "term")], F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))
