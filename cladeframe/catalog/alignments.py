"""Registered queries over sequences and columns, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cladeframe.catalog import oracle_views as O
from cladeframe.catalog import views as V
from cladeframe.catalog.registry import Registry
from cladeframe.functions import sequences as S
from cladeframe.operators import sites, validate

registry = Registry()
query = registry.query


# --- scalar functions over whole texts ---------------------------------------


@query("normalise_seq", """SELECT doc_id, translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS seq
       FROM documents""",
)
def normalise_seq(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select("doc_id", S.normalise(F.col("text")).alias("seq"))


@query(
    "trim_text",
    """SELECT doc_id, trim(text, chr(10) || chr(13) || ' .') AS trimmed,
              regexp_replace(regexp_replace(text, '^[A-Za-z]+', ''), '^\\s+', '') AS skipped
       FROM documents""",
)
def trim_text(spark, sf_dir):
    text = F.col("text")
    return V.table(spark, sf_dir, "documents").select(
        "doc_id",
        S.trim_chars(text, "\n\r .").alias("trimmed"),
        S.skip_leading_space(F.regexp_replace(text, "^[A-Za-z]+", "")).alias("skipped"),
    )


@query("strip_digits_blanks", "SELECT doc_id, translate(text, '0123456789 ', '') AS stripped FROM documents")
def strip_digits_blanks(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select(
        "doc_id", S.strip_digits_blanks(F.col("text")).alias("stripped")
    )


@query(
    "ci_equal",
    """SELECT doc_id, lower(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')))
                        = lower(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS own_upper,
              lower(source) = lower('SRC1') AS is_src1
       FROM documents""",
)
def ci_equal(spark, sf_dir):
    letters = F.regexp_replace("text", "[^A-Za-z]", "")
    return V.table(spark, sf_dir, "documents").select(
        "doc_id",
        S.equal_ignoring_case(F.upper(letters), letters).alias("own_upper"),
        S.equal_ignoring_case(F.col("source"), F.lit("SRC1")).alias("is_src1"),
    )


@query(
    "split_tokens",
    """WITH t AS (SELECT doc_id, list_filter(string_split(text, ' '), lambda x: x <> '') AS p FROM documents)
       SELECT doc_id, len(p) AS n_tokens, coalesce(p[len(p)], '') AS last_token,
              coalesce(array_to_string(p[1:len(p) - 1], ' '), '') AS leading, len(p) = 1 AS single
       FROM t""",
)
def split_tokens(spark, sf_dir):
    text = F.col("text")
    return V.table(spark, sf_dir, "documents").select(
        "doc_id",
        F.size(S.tokens(text)).cast("bigint").alias("n_tokens"),
        S.last_token(text).alias("last_token"),
        S.leading_tokens(text).alias("leading"),
        S.is_single_token(text).alias("single"),
    )


@query(
    "explode_sites",
    O.sql(O.vector_cells(6), query="SELECT alignment_id, taxon_id, site, base FROM cells"),
)
def explode_sites(spark, sf_dir):
    return sites.explode_sites(V.vector_alignments(spark, sf_dir, 6)).drop("state")


_STATE_CASES = " ".join(f"WHEN '{c}' THEN {s}" for c, s in S.STATE_OF.items())


@query(
    "iupac_encode",
    O.sql(
        O.DOC,
        query="""SELECT alignment_id, taxon_id,
                         translate(seq, 'ACGTUYRWSKMBDHVNX?-', '12488A596C3EDB7FFFF') AS states FROM doc""",
    ),
)
def iupac_encode(spark, sf_dir):
    return V.document_alignments(spark, sf_dir).select(
        "alignment_id", "taxon_id", S.hex_states(F.col("seq")).alias("states")
    )


@query(
    "site_block",
    O.sql(
        O.vector_cells(6),
        query="SELECT alignment_id, site // 16 AS block, count(*) AS cells FROM cells GROUP BY 1, 2",
    ),
)
def site_block(spark, sf_dir):
    cells = sites.explode_sites(V.vector_alignments(spark, sf_dir, 6))
    return (
        cells.withColumn("block", S.site_block(F.col("site"), 16))
        .groupBy("alignment_id", "block")
        .agg(F.count(F.lit(1)).alias("cells"))
    )


@query(
    "uniform_draw",
    """WITH d AS (SELECT event_id,
                  (((event_id % 2147483648 * 1103515245 + 42 * 12345 + 12345) % 2147483648) * 48271 % 2147483647)
                  / 2147483647.0::DOUBLE AS u FROM events)
       SELECT event_id, u, CAST(floor(u * 10) AS BIGINT) AS pick,
              ('0x' || substr(md5('42:' || event_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS hashed FROM d""",
)
def uniform_draw(spark, sf_dir):
    u = S.congruential_draw(42, F.col("event_id"))
    return V.table(spark, sf_dir, "events").select(
        "event_id", u.alias("u"), S.integer_draw(u, 9).alias("pick"), S.uniform_draw(42, F.col("event_id")).alias("hashed")
    )


# --- columns ---------------------------------------------------------------


@query(
    "alignment_dims",
    O.sql(
        O.RAW,
        query="""SELECT alignment_id, count(*) AS n, max(length(seq)) AS m, max(length(name)) AS max_name
                 FROM raw GROUP BY alignment_id""",
    ),
)
def alignment_dims(spark, sf_dir):
    return sites.alignment_dims(V.raw_alignments(spark, sf_dir))


@query(
    "alignment_shape",
    O.sql(
        O.RAW,
        query="""SELECT alignment_id, n, m, 2 * n - 3 AS n_branches, n - 3 AS n_sets, n - 2 AS max_set,
                        (m + 15) // 16 AS words
                 FROM (SELECT alignment_id, count(*) AS n, max(length(seq)) AS m FROM raw GROUP BY alignment_id)""",
    ),
)
def alignment_shape(spark, sf_dir):
    return sites.alignment_shape(sites.alignment_dims(V.raw_alignments(spark, sf_dir))).drop("max_name")


@query(
    "site_states",
    O.sql(
        O.DOC_CELLS,
        query="""SELECT c.alignment_id, c.site, least(c.k, 5) AS n_states,
                        CASE WHEN c.k <= 5 THEN coalesce(s.states, '') END AS states
                 FROM cols c LEFT JOIN (
                   SELECT alignment_id, site, string_agg(base, '' ORDER BY base) AS states
                   FROM (SELECT DISTINCT alignment_id, site, base FROM cells
                         WHERE base NOT IN ('-', '?', 'N', 'X')) GROUP BY 1, 2) s USING (alignment_id, site)""",
    ),
)
def site_states(spark, sf_dir):
    return sites.site_states(V.document_alignments(spark, sf_dir))


@query(
    "variable_sites",
    O.sql(O.DOC_CELLS, query="SELECT alignment_id, site FROM cols WHERE variable"),
)
def variable_sites(spark, sf_dir):
    return sites.variable_sites(V.document_alignments(spark, sf_dir))


@query(
    "cut_constant_sites",
    O.sql(
        O.DOC_CELLS,
        query="""SELECT d.alignment_id, d.taxon_id, d.name, coalesce(k.seq, '') AS seq, 64 AS original_m,
                        coalesce(length(k.seq), 0) AS m
                 FROM doc d LEFT JOIN (
                   SELECT alignment_id, taxon_id, string_agg(base, '' ORDER BY site) AS seq
                   FROM cells JOIN cols USING (alignment_id, site) WHERE variable GROUP BY 1, 2) k
                 USING (alignment_id, taxon_id)""",
    ),
)
def cut_constant_sites(spark, sf_dir):
    return sites.cut_constant_sites(V.document_alignments(spark, sf_dir))


@query(
    "excluded_sites",
    O.sql(
        O.DOC_CELLS,
        """cut AS (SELECT alignment_id, site, row_number() OVER (PARTITION BY alignment_id ORDER BY site) - 1 AS r
                   FROM cols WHERE NOT variable)""",
        query="""SELECT c.alignment_id, r // 8 AS line, string_agg((site + 1)::VARCHAR, chr(9) ORDER BY site) AS columns,
                        any_value(n) AS n_excluded
                 FROM cut c JOIN (SELECT alignment_id, count(*) AS n FROM cut GROUP BY 1) t USING (alignment_id)
                 GROUP BY 1, 2""",
    ),
)
def excluded_sites(spark, sf_dir):
    return sites.excluded_sites(V.document_alignments(spark, sf_dir))


@query(
    "minimum_tree_length",
    O.sql(
        O.DOC_CELLS,
        query="""SELECT alignment_id, CAST(sum(CASE WHEN k > 5 THEN 5 ELSE k - 1 END) AS BIGINT) AS min_len
                 FROM cols WHERE variable GROUP BY alignment_id""",
    ),
)
def minimum_tree_length(spark, sf_dir):
    return sites.minimum_tree_length(V.document_alignments(spark, sf_dir))


@query(
    "site_patterns",
    O.sql(
        O.DOC_CELLS,
        query=f"""SELECT alignment_id, pattern, count(*) AS weight
                  FROM (SELECT alignment_id, site,
                               string_agg(substr('0123456789ABCDEF', CASE base {_STATE_CASES} END + 1, 1), ''
                                          ORDER BY taxon_id) AS pattern
                        FROM cells GROUP BY alignment_id, site)
                  GROUP BY alignment_id, pattern""",
    ),
)
def site_patterns(spark, sf_dir):
    return sites.site_patterns(V.document_alignments(spark, sf_dir))


# --- validation --------------------------------------------------------------


def headers(spark, sf_dir):
    """Declared sizes: one line of 64 per 64 characters of the document, blanks and all."""
    return V.table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("alignment_id"),
        F.ceil(F.col("n_chars") / V.LINE_WIDTH).cast("bigint").alias("n"),
        F.lit(V.LINE_WIDTH).alias("m"),
    )


_HEADERS = """
headers AS (SELECT doc_id::VARCHAR AS alignment_id, (n_chars + 63) // 64 AS n, 64 AS m FROM documents)"""
_PER = """
per AS (SELECT alignment_id, count(*) AS n, min(length(seq)) AS lo, max(length(seq)) AS hi FROM raw GROUP BY 1)"""


@query(
    "validate_alphabet",
    O.sql(
        O.RAW,
        query="""SELECT alignment_id, 'illegal_character' AS rule,
                        name || ': ' || regexp_extract(seq, '[^ACGTUYRWSKMBDHVNX?O-]') AS detail
                 FROM raw WHERE regexp_matches(seq, '[^ACGTUYRWSKMBDHVNX?O-]')""",
    ),
)
def validate_alphabet(spark, sf_dir):
    return validate.alphabet(V.raw_alignments(spark, sf_dir))


@query(
    "validate_unencodable",
    O.sql(
        O.RAW,
        query="SELECT alignment_id, 'unencodable_base' AS rule, name AS detail FROM raw WHERE contains(seq, 'O')",
    ),
)
def validate_unencodable(spark, sf_dir):
    return validate.unencodable(V.raw_alignments(spark, sf_dir))


@query(
    "validate_lengths",
    O.sql(
        O.RAW, _HEADERS, _PER,
        query="""SELECT alignment_id, 'unequal_lengths' AS rule, lo || '..' || hi AS detail FROM per WHERE lo <> hi
                 UNION ALL
                 SELECT alignment_id, 'length_differs_from_header', lo || '..' || hi
                 FROM per JOIN headers h USING (alignment_id) WHERE lo <> h.m OR hi <> h.m""",
    ),
)
def validate_lengths(spark, sf_dir):
    return validate.lengths(V.raw_alignments(spark, sf_dir), headers(spark, sf_dir))


@query(
    "validate_counts",
    O.sql(
        O.RAW, _HEADERS, _PER,
        query="""SELECT alignment_id, 'fewer_than_two_sequences' AS rule, n::VARCHAR AS detail FROM per WHERE n < 2
                 UNION ALL
                 SELECT h.alignment_id, 'no_sequences', '0' FROM headers h
                 WHERE h.alignment_id NOT IN (SELECT alignment_id FROM per)
                 UNION ALL
                 SELECT alignment_id, 'count_differs_from_header', p.n || ' of ' || h.n
                 FROM per p JOIN headers h USING (alignment_id) WHERE p.n <> h.n""",
    ),
)
def validate_counts(spark, sf_dir):
    return validate.counts(V.raw_alignments(spark, sf_dir), headers(spark, sf_dir))


@query(
    "validate_short_name_line",
    """WITH lines AS (SELECT doc_id, p, unnest(range(len(p))) AS line
                      FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))
       SELECT doc_id::VARCHAR AS alignment_id, 'short_name_line' AS rule, line::VARCHAR AS detail
       FROM lines WHERE length(p[line + 1]) < 10""",
)
def validate_short_name_line(spark, sf_dir):
    lines = V.table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("alignment_id"), F.posexplode(F.split("text", "\n")).alias("line", "text")
    )
    return validate.short_name_lines(lines)


@query(
    "validate_limits",
    O.sql(
        O.RAW, _PER,
        query="""SELECT alignment_id, 'taxa_out_of_range' AS rule, n::VARCHAR AS detail FROM per
                 WHERE n NOT BETWEEN 5 AND 1000000
                 UNION ALL
                 SELECT alignment_id, 'sites_out_of_range', hi::VARCHAR FROM per WHERE hi NOT BETWEEN 1 AND 5000000""",
    ),
)
def validate_limits(spark, sf_dir):
    return validate.limits(V.raw_alignments(spark, sf_dir))


@query(
    "validate_variable",
    O.sql(
        O.DOC_CELLS,
        query="""SELECT alignment_id, 'no_variable_sites' AS rule, '0' AS detail
                 FROM cols GROUP BY alignment_id HAVING NOT bool_or(variable)""",
    ),
)
def validate_variable(spark, sf_dir):
    return validate.variable(V.document_alignments(spark, sf_dir))


_RULES = (
    "validate_alphabet", "validate_unencodable", "validate_lengths", "validate_counts", "validate_limits",
    "validate_short_name_line",
)
_RAW_VARIABLE = O.sql(
    O.RAW,
    query="""SELECT alignment_id, 'no_variable_sites' AS rule, '0' AS detail
             FROM (SELECT alignment_id, site, count(DISTINCT substr(seq, site + 1, 1)) AS k
                   FROM raw CROSS JOIN (SELECT unnest(range(64))::INTEGER AS site) s WHERE site < length(seq)
                   GROUP BY alignment_id, site)
             GROUP BY alignment_id HAVING max(k) = 1""",
)


@query(
    "validate_all",
    " UNION ALL ".join(
        f"SELECT alignment_id, rule, detail FROM ({s})" for s in [*(registry.sql[r] for r in _RULES), _RAW_VARIABLE]
    ),
)
def validate_all(spark, sf_dir):
    lines = V.table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("alignment_id"), F.posexplode(F.split("text", "\n")).alias("line", "text")
    )
    return validate.validate(V.raw_alignments(spark, sf_dir), headers(spark, sf_dir), lines)


@query(
    "math_domain",
    """WITH b AS (SELECT event_id, (value - 20) * (event_id % 60) AS x, (event_id % 9 - 4) * 62.5::DOUBLE AS y FROM events),
            f AS (SELECT *, CASE WHEN x > 709.782712893384 THEN 'overflow'
                                 WHEN x < -745.1332191019412 THEN 'underflow' END AS exp_flag,
                            CASE WHEN x <= 0 THEN 'domain' END AS log_flag,
                            CASE WHEN x = 0 AND y <= 0 THEN 'domain'
                                 WHEN x < 0 AND y <> floor(y) THEN 'domain'
                                 WHEN x <> 0 AND y * ln(abs(x)) > 709.782712893384 THEN 'overflow'
                                 WHEN x <> 0 AND y * ln(abs(x)) < -745.1332191019412 THEN 'underflow' END AS pow_flag FROM b),
            g AS (SELECT *, CASE WHEN exp_flag IS NULL THEN exp(x) END AS exp_x,
                            CASE WHEN pow_flag IS NULL THEN pow(x, y) END AS pow_xy FROM f)
       SELECT event_id, exp_flag, log_flag, pow_flag,
              exp_x > 0 AND exp_x < 2.2250738585072014e-308 AS exp_subnormal,
              round(CASE WHEN exp_x >= 2.2250738585072014e-308 THEN ln(exp_x) END, 6) + 0.0 AS ln_exp_x,
              round(CASE WHEN log_flag IS NULL THEN ln(x) END, 9) AS ln_x,
              sign(pow_xy)::INTEGER AS pow_sign,
              round(CASE WHEN abs(pow_xy) >= 2.2250738585072014e-308 THEN ln(abs(pow_xy)) END, 6) + 0.0 AS ln_pow_xy
       FROM g""",
)
def math_domain(spark, sf_dir):
    rows = V.table(spark, sf_dir, "events").select(
        "event_id",
        ((F.col("value") - 20) * (F.col("event_id") % 60)).alias("x"),
        ((F.col("event_id") % 9 - 4) * 62.5).alias("y"),
    )
    out = validate.math_domain(rows, F.col("x"), F.col("y"))
    # values span the whole range of a double, so logarithms are compared; subnormal values have few digits
    e, p, normal = F.col("exp_x"), F.abs("pow_xy"), 2.2250738585072014e-308
    return out.select(
        "event_id", "exp_flag", "log_flag", "pow_flag",
        ((e > 0) & (e < normal)).alias("exp_subnormal"),
        (F.round(F.when(e >= normal, F.ln(e)), 6) + 0.0).alias("ln_exp_x"),
        F.round("ln_x", 9).alias("ln_x"),
        F.signum("pow_xy").cast("int").alias("pow_sign"),
        (F.round(F.when(p >= normal, F.ln(p)), 6) + 0.0).alias("ln_pow_xy"),
    )
