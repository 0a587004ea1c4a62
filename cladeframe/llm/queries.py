"""The registered queries, one per operator, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.catalog.registry import Registry
from cladeframe.llm import (
    filter_audit, kneser_ney, mixing, nn_descent, packing, paragraph_sketch, phrases, rff_quality, sharding, simhash, tfidf_knn, url_cascade, warc,
)
from cladeframe.llm.common import id_crc, table
from cladeframe.session import scratch_path

registry = Registry()


@registry.query("op1_sharding")
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), 8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot", F.col("version").alias("map_version"),
    )


def _mixing_sql() -> str:
    """The same mix by sorting: budgets end at running sums in hash order."""
    parts = [
        """d AS (SELECT doc_id, source,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents)""",
        "s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source)",
        """s1 AS (SELECT *, ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::DOUBLE AS weight,
    row_number() OVER (ORDER BY source IS NULL, source) AS rk FROM s0)""",
        """s2 AS (SELECT *, (sum(source_size) OVER ())::DOUBLE AS total,
    coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS before,
    sum(weight) OVER (ORDER BY 3 * source_size / weight, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after FROM s1)""",
        "s3 AS (SELECT *, max((total - before) / after) OVER () AS level FROM s2)",
        "s4 AS (SELECT source, source_size, least((3 * source_size)::DOUBLE, level * weight) AS target FROM s3)",
        """p0 AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS copies,
    target - (CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END) * source_size AS budget,
    -1::BIGINT AS past FROM s4)""",
    ]
    for k in range(mixing.SKIPS + 1):
        last = k == mixing.SKIPS
        parts += [
            f"""g{k} AS (SELECT d.source, h, sum(size) AS n FROM d JOIN p{k} ON d.source IS NOT DISTINCT FROM p{k}.source
    WHERE budget > 0 AND h > past GROUP BY d.source, h)""",
            f"c{k} AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY h) AS upto FROM g{k})",
            f"""e{k} AS (SELECT c{k}.source, arg_min(c{k}.h, c{k}.h) AS e_h, arg_min(n, c{k}.h) AS e_n, arg_min(upto - n, c{k}.h) AS spent
    FROM c{k} JOIN p{k} ON c{k}.source IS NOT DISTINCT FROM p{k}.source WHERE upto > budget GROUP BY c{k}.source)""",
            f"""t{k} AS (SELECT d.doc_id, d.source, d.h FROM d JOIN p{k} ON d.source IS NOT DISTINCT FROM p{k}.source
    LEFT JOIN e{k} ON d.source IS NOT DISTINCT FROM e{k}.source
    WHERE budget > 0 AND d.h > past AND (e_h IS NULL OR d.h < e_h{" OR (d.h = e_h AND e_n - (budget - spent) < budget - spent)" if last else ""}))""",
        ]
        if not last:
            parts.append(
                f"""p{k + 1} AS (SELECT p{k}.source, source_size, target, copies,
    CASE WHEN e_h IS NULL THEN 0 ELSE budget - spent END AS budget, e_h AS past
    FROM p{k} LEFT JOIN e{k} ON p{k}.source IS NOT DISTINCT FROM e{k}.source)"""
            )
    taken = " UNION ALL ".join(f"SELECT DISTINCT source, h FROM t{k}" for k in range(mixing.SKIPS + 1))
    parts.append(f"x AS ({taken})")
    return (
        "WITH " + ",\n".join(parts) + """
SELECT d.doc_id, d.size, p0.source_size, p0.target,
    (p0.copies + CASE WHEN x.h IS NULL THEN 0 ELSE 1 END) * d.size AS taken
FROM d JOIN p0 ON d.source IS NOT DISTINCT FROM p0.source
LEFT JOIN x ON d.source IS NOT DISTINCT FROM x.source AND d.h = x.h"""
    )


@registry.query("op5_mixing", _mixing_sql())
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@registry.query("op9_simhash")
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _scored_by_order(spark: SparkSession, sf_dir: str, order: int) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = kneser_ney.train(docs.where(id_crc("doc_id") % 5 != 1), order=order)
    scored = kneser_ney.score(docs, model)
    return scored.withColumns({"held_out": id_crc("doc_id") % 5 == 1, "train_tokens": F.lit(model.n_tokens).cast("long")})


@registry.query("op2_kneser_ney")
def op2_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored_by_order(spark, sf_dir, 2)


@registry.query("op2_kneser_ney_order3")
def op2_kneser_ney_order3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored_by_order(spark, sf_dir, 3)


RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def _url_sql() -> str:
    fits = " UNION ALL ".join(
        f"SELECT page_id, '{h}{p}' AS rule, '{v}' AS verdict FROM parts WHERE (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
        for v, h, p in RULES
    )
    return f"""WITH rest AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0
        THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
    parts AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
    fits AS ({fits}),
    best AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM fits GROUP BY page_id)
    SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN best USING (page_id)"""


@registry.query("op3_url_cascade", _url_sql())
def op3_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_cascade.judge(pages, url_cascade.rule_table(spark, RULES)).drop("url")


@registry.query("op7_packing")
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@registry.query("op10_paragraph_sketch")
def op10_paragraph_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_sketch.compare_versions(table(spark, sf_dir, "documents"))


def toxicity_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that may be learned from."""
    return table(spark, sf_dir, "labels").where(id_crc("doc_id") % 5 != 0)


def quality_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where(id_crc("doc_id") % 3 != 1)


@registry.query("op6_tfidf_knn")
def op6_tfidf_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = tfidf_knn.fit(docs, toxicity_labels(spark, sf_dir))
    return tfidf_knn.score(docs, model).withColumn("held_out", id_crc("doc_id") % 5 == 0)


@registry.query("op8_rff_quality")
def op8_rff_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = rff_quality.score_documents(table(spark, sf_dir, "documents"), quality_labels(spark, sf_dir))
    return scored.withColumn("held_out", id_crc("doc_id") % 3 == 1)


@registry.query("op4_nn_descent")
def op4_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def _audit_sql() -> str:
    """Every step of every order by its definition, from counts of failure sets."""
    bits = " + ".join(f"CASE WHEN {c} THEN {1 << i} ELSE 0 END" for i, c in enumerate(filter_audit.NAMES))
    place = [f"(CASE WHEN strpos(filter_order, '{c}') < step THEN {1 << i} ELSE 0 END)" for i, c in enumerate(filter_audit.NAMES)]
    return f"""WITH texts AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents),
    words AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM texts),
    flags AS (SELECT doc_id, part, len(w) < 100 AS A, 100 * len(list_distinct(w)) < 80 * len(w) AS B,
        100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS C, regexp_matches(t, '[#$%&*|]') AS D,
        coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS E FROM words),
    marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
    sets AS (SELECT part, {bits} AS fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
        FROM flags LEFT JOIN marks USING (doc_id) GROUP BY part, fails),
    f AS (SELECT unnest(string_split('A,B,C,D,E', ',')) AS c),
    orders AS (SELECT a.c || b.c || d.c || e.c || g.c AS filter_order FROM f a, f b, f d, f e, f g
        WHERE len(list_distinct([a.c, b.c, d.c, e.c, g.c])) = 5),
    steps AS (SELECT filter_order, step, {" + ".join(place)} AS before,
        (1 << (strpos('ABCDE', substr(filter_order, step, 1)) - 1)::INT) AS own
        FROM orders, (SELECT unnest(range(1, 6))::INT AS step)),
    counted AS (SELECT part, filter_order, step, own,
        sum(n) FILTER (fails & (before | own) = 0) AS kept, sum(n) FILTER (fails & before = 0 AND fails & own > 0) AS removed,
        sum(n) FILTER (fails & before > 0 AND fails & own > 0) AS redundant, sum(n) FILTER (fails = own) AS unique_fails,
        sum(good) FILTER (fails & before = 0 AND fails & own > 0) AS good_lost,
        sum(toxic) FILTER (fails & before = 0 AND fails & own > 0) AS toxic_lost
        FROM sets, steps GROUP BY part, filter_order, step, own)
    SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
        coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
        coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
        coalesce(sum(removed) OVER (PARTITION BY part, own), 0)::BIGINT AS shapley FROM counted"""


@registry.query("op12_filter_audit", _audit_sql())
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = filter_audit.document_failures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return filter_audit.audit(sets)


#: All n-grams of pieces by sorting and grouping; scores in 128-bit integers.
PHRASES_SQL = """WITH low AS (SELECT coalesce(lang, 'und') AS lang,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM low),
    words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
    grams AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM
        (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM words, (SELECT unnest([1, 2, 3]) AS m))),
    f AS (SELECT lang, m, phrase, count(*) AS c FROM grams GROUP BY ALL),
    total AS (SELECT lang, sum(c)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
    cand AS (SELECT lang, m, phrase, c AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND c >= 10),
    cuts AS (SELECT cand.*, k, array_to_string(w[1:k], ' ') AS p1, array_to_string(w[k + 1:], ' ') AS p2
        FROM cand, (SELECT unnest([1, 2]) AS k) WHERE k < m),
    scored AS (SELECT cuts.lang, cuts.m, cuts.phrase, a, k, x.c AS l, y.c AS r,
        (1000000::HUGEINT * a * a // (x.c::HUGEINT * y.c))::BIGINT AS score
        FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = p1 JOIN f y ON y.lang = cuts.lang AND y.phrase = p2),
    best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    longer AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, array_to_string(w[1:2], ' ') AS phrase FROM cand WHERE m = 3
        UNION ALL SELECT lang, a, array_to_string(w[2:3], ' ') FROM cand WHERE m = 3) GROUP BY ALL),
    kept AS (SELECT best.* FROM best LEFT JOIN longer USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::INT AS rank, phrase, a, l, r, n, score
    FROM kept JOIN total USING (lang) QUALIFY rank <= 2000"""


@registry.query("op13_phrases", PHRASES_SQL)
def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


WARC_SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
    last AS (SELECT *, CASE WHEN strlen(t) >= 1000 THEN max(page_id) OVER (PARTITION BY t) END AS newest FROM p)
    SELECT page_id, strlen(t)::BIGINT AS payload_bytes, sha1(t) AS payload_digest,
        CASE WHEN newest IS NOT NULL AND page_id IS DISTINCT FROM newest THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN newest IS NOT NULL AND page_id IS DISTINCT FROM newest THEN newest END AS refers_to FROM last"""


@registry.query("op11_warc", WARC_SQL)
def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write(warc.page_records(table(spark, sf_dir, "pages")), path)
    return warc.read_pages(spark, path).drop("uri", "payload")
