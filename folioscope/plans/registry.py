"""Every query of the engine's own operators by name, with its DuckDB equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions import periods as pf
from folioscope.functions import text as tf
from folioscope.operators import evals, extract, gate, layout, promotions, retrieval, sections, splitter, structured, timeline
from folioscope.operators.scope import Scope
from folioscope.plans import carriers as c
from folioscope.sources import documents as src
from folioscope.sources import csv_file, store
from folioscope.sources.bucketed import BucketedTable
from folioscope.sources.scratch import scratch_path
from folioscope.streaming import expiry, sessions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

EV, DOCS, FS, PR = c.EVALUATIONS, c.DOCUMENTS, c.FIELD_SCORES, c.PROMOTIONS


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Scopes and structured lookups


@query(f"WITH {EV} SELECT e.id, e.period, e.score FROM ev e WHERE person_id = '7' AND period = (SELECT min(period) FROM ev WHERE person_id = '7')")
def scope_lookup(spark, sf):
    rows = c.evaluations(spark, sf)
    first = rows.where("person_id = '7'").agg(F.min("period")).first()[0]
    return Scope("7", first or "none").rows(rows).select("id", "period", "score")


@query("SELECT doc_id, source AS person_id, lang AS period FROM documents WHERE source = 'src3' AND lang IN ('fr', 'en')")
def career_scope(spark, sf):
    rows = c.table(spark, sf, "documents").select("doc_id", F.col("source").alias("person_id"), F.when(F.col("lang") == "en", "career").otherwise(F.col("lang")).alias("period"))
    return Scope("src3", "fr").chunks(rows).withColumn("period", F.when(F.col("period") == "career", "en").otherwise(F.col("period")))


@query(f"""WITH {EV}, {DOCS}, {FS}, l AS (
    SELECT eval_id, string_agg(field_code || '=' || value, ',' ORDER BY field_code, value, id) AS fields, count(*) FILTER (value <> 'yes') AS numbers FROM fs GROUP BY 1)
    SELECT ev.id, ev.person_id, doc_id, coalesce(fields, '') AS fields, coalesce(numbers, 0) AS numbers FROM ev JOIN docs USING (person_id, period) LEFT JOIN l ON eval_id = ev.id""")
def score_records(spark, sf):
    rows = structured.score_records(timeline.points(c.dealt_evaluations(spark, sf), c.documents(spark, sf)), c.field_scores(spark, sf))
    fields = F.array_join(F.transform("fields", lambda x: F.concat_ws("=", x["field_code"], x["value"])), ",")
    return rows.select("id", "person_id", "doc_id", fields.alias("fields"), F.size(F.filter("fields", lambda x: x["number"].isNotNull())).cast("long").alias("numbers"))


@query(f"""WITH {FS}, n AS (SELECT eval_id, field_code, value::INT AS number FROM fs WHERE value <> 'yes' AND field_code <> '141'),
    t AS (SELECT *, row_number() OVER (PARTITION BY eval_id ORDER BY number DESC, field_code) AS p, row_number() OVER (PARTITION BY eval_id ORDER BY number, field_code DESC) AS q FROM n)
    SELECT eval_id, 'top' AS side, p::INT AS place, field_code, number FROM t WHERE p <= 3 UNION ALL SELECT eval_id, 'bottom', q::INT, field_code, number FROM t WHERE q <= 3""")
def top_bottom(spark, sf):
    return structured.top_bottom(c.field_scores(spark, sf))


@query(f"WITH {FS} SELECT eval_id, max(CASE WHEN value <> 'yes' THEN value::INT END) AS overall FROM fs WHERE field_code = '141' GROUP BY 1")
def overall_field(spark, sf):
    return structured.overall(c.field_scores(spark, sf))


@query(f"""WITH {PR}, b AS (SELECT person_id, row_index + 1 AS row_index, arg_max(rank, id) AS judged_for FROM pr GROUP BY 1, 2)
    SELECT pr.id, pr.person_id, pr.row_index, rank, judged_for FROM pr LEFT JOIN b USING (person_id, row_index)""")
def judged_for(spark, sf):
    return structured.judged_for(c.promotions(spark, sf)).select("id", "person_id", "row_index", "rank", "judged_for")


@query("""WITH y AS (SELECT o_custkey::VARCHAR AS person_id, year(o_orderdate)::VARCHAR AS period, 'd' || min(o_orderkey)::VARCHAR AS doc_id, count(*) AS n FROM orders GROUP BY 1, 2),
    a AS (SELECT * FROM y WHERE period = '1995'), b AS (SELECT * FROM y WHERE period = '1996')
    SELECT coalesce(a.person_id, b.person_id) AS person_id, a.n AS a_n, b.n AS b_n, concat_ws(',', least(a.doc_id, b.doc_id), CASE WHEN a.doc_id <> b.doc_id THEN greatest(a.doc_id, b.doc_id) END) AS doc_ids
    FROM a FULL JOIN b ON a.person_id = b.person_id""")
def compare_periods(spark, sf):
    o = c.table(spark, sf, "orders")
    rows = o.groupBy(F.col("o_custkey").cast("string").alias("person_id"), F.year("o_orderdate").cast("string").alias("period")).agg(F.concat(F.lit("d"), F.min("o_orderkey").cast("string")).alias("doc_id"), F.count("*").alias("n"))
    return structured.compare_periods(rows, "1995", "1996").select("person_id", F.col("a.n").alias("a_n"), F.col("b.n").alias("b_n"), F.array_join("doc_ids", ",").alias("doc_ids"))


@query("""WITH r AS (SELECT o_orderkey, o_custkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1)::INT AS row_index FROM orders) SELECT * FROM r""")
def renumbered(spark, sf):
    return structured.renumbered(c.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), "o_custkey", "o_orderdate", "o_orderkey").select("o_orderkey", "o_custkey", "row_index")


@query(f"WITH {FS} SELECT field_code, row_number() OVER (ORDER BY field_code::INT) AS place FROM (SELECT DISTINCT field_code FROM fs)")
def code_order(spark, sf):
    codes = c.field_scores(spark, sf).select("field_code").distinct()
    return codes.select("field_code", F.row_number().over(Window.orderBy(*structured.code_order())).cast("long").alias("place"))


# Timelines


@query(f"WITH {EV}, {DOCS} SELECT ev.*, doc_id FROM ev JOIN docs USING (person_id, period)")
def timeline_points(spark, sf):
    return timeline.checked(c.dealt_evaluations(spark, sf), c.documents(spark, sf)).select("id", "person_id", "period_start", "period_end", "score", "kind", "period", "doc_id")


@query(f"""WITH {EV}, w AS (SELECT id, person_id, score, lag(score IGNORE NULLS) OVER (PARTITION BY person_id ORDER BY period_start, id) AS before FROM ev)
    SELECT id, person_id, score, score - before AS delta FROM w""")
def timeline_delta(spark, sf):
    return timeline.with_delta(c.evaluations(spark, sf)).select("id", "person_id", "score", "delta")


@query(f"""WITH {EV}, w AS (SELECT id, person_id, score, sum(CASE WHEN score IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY person_id ORDER BY period_start, id ROWS UNBOUNDED PRECEDING) AS gaps FROM ev)
    SELECT id, person_id, CASE WHEN score IS NOT NULL THEN gaps::BIGINT END AS run FROM w""")
def scored_runs(spark, sf):
    return timeline.with_runs(c.evaluations(spark, sf)).select("id", "person_id", "run")


@query(f"""WITH {EV} SELECT person_id, count(*) AS periods, count(score) AS scored, round(avg(score), 6) AS mean, min(score) AS low,
    first(score ORDER BY period_start DESC, id DESC) FILTER (score IS NOT NULL) AS last, first(id ORDER BY score, period_start, id) FILTER (score IS NOT NULL) AS low_id, count(*) - count(score) AS gaps FROM ev GROUP BY 1""")
def timeline_stats(spark, sf):
    return timeline.stats(c.evaluations(spark, sf)).withColumn("mean", F.round("mean", 6))


@query(f"""WITH {EV}, s AS (SELECT person_id, coalesce(floor(min(score)), 100)::BIGINT AS low FROM ev GROUP BY 1)
    SELECT person_id, 0::BIGINT AS whole, least(80, low)::BIGINT AS fixed, greatest(0, least(99, low - 1))::BIGINT AS zoom FROM s""")
def timeline_axis(spark, sf):
    low = timeline.stats(c.evaluations(spark, sf))
    return low.select("person_id", *[timeline.axis(F.col("low"), m).cast("long").alias(n) for m, n in (("full", "whole"), ("fixed", "fixed"), ("zoom", "zoom"))])


@query("""WITH d AS (SELECT o_custkey::VARCHAR AS person_id, year(o_orderdate)::VARCHAR AS period, o_orderkey % 3 AS doc_id FROM orders)
    SELECT person_id, period, count(DISTINCT doc_id) AS documents FROM d GROUP BY 1, 2 HAVING count(DISTINCT doc_id) > 1""")
def ambiguous_docs(spark, sf):
    d = c.table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("person_id"), F.year("o_orderdate").cast("string").alias("period"), (F.col("o_orderkey") % 3).alias("doc_id"))
    return timeline.violations(d, d)


@query("""WITH o AS (SELECT o_orderkey AS id, o_orderdate::DATE AS s, o_orderdate::DATE + (o_orderkey % 400)::INT AS e FROM orders)
    SELECT id, strftime(s, '%Y-%m-%d') AS begins, strftime(e + 1, '%Y-%m-%d') AS ends,
           CASE WHEN year(s) = year(e) AND strftime(s, '%m-%d') = '01-01' AND strftime(e, '%m-%d') = '12-31' THEN year(s)::VARCHAR
                WHEN year(s) = year(e) AND strftime(s, '%m-%d') = '01-01' AND strftime(e, '%m-%d') = '06-30' THEN 'H1 ' || year(s)
                WHEN year(s) = year(e) AND strftime(s, '%m-%d') = '07-01' AND strftime(e, '%m-%d') = '12-31' THEN 'H2 ' || year(s)
                ELSE strftime(s, '%d/%m/%Y') || ' - ' || strftime(e, '%d/%m/%Y') END AS label FROM o""")
def period_labels(spark, sf):
    o = c.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("s"))
    o = o.withColumn("e", F.date_add("s", (F.col("id") % 400).cast("int")))
    r = pf.period_range(pf.period(F.col("s"), F.col("e")))
    return o.select("id", F.date_format(r["from"], "yyyy-MM-dd").alias("begins"), F.date_format(r["to"], "yyyy-MM-dd").alias("ends"), pf.period_label(F.col("s"), F.col("e")).alias("label"))


@query(f"""WITH {EV}, w AS (SELECT id, score, score - lag(score IGNORE NULLS) OVER (PARTITION BY person_id ORDER BY period_start, id) AS d FROM ev)
    SELECT id, score::VARCHAR AS score_text, CASE WHEN d = 0 THEN '±0' WHEN d > 0 THEN '+' || d WHEN d < 0 THEN d::VARCHAR END AS delta_text FROM w""")
def delta_texts(spark, sf):
    rows = timeline.with_delta(c.evaluations(spark, sf))
    return rows.select("id", pf.score_text(F.col("score")).alias("score_text"), pf.delta_text(F.col("delta")).alias("delta_text"))


@query("SELECT c_custkey::VARCHAR AS person_id, c_name AS name FROM customer")
def persons(spark, sf):
    from folioscope.operators import scope

    return scope.persons(c.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("person_id"), F.col("c_name").alias("name")))


@query(f"WITH {EV} SELECT DISTINCT period FROM ev WHERE person_id = '10'")
def person_periods(spark, sf):
    from folioscope.operators import scope

    return scope.periods(c.evaluations(spark, sf), "10")


# The gate


@query(f"WITH {EV} SELECT DISTINCT person_id, unnest(range(year(period_start), year(period_end) + 1))::INT AS year FROM ev")
def covered_years(spark, sf):
    return gate.covered_years(c.evaluations(spark, sf))


@query(f"""WITH {EV}, q AS (SELECT c_custkey::VARCHAR AS person_id, (1990 + c_custkey % 12)::INT AS y FROM customer),
    s AS (SELECT person_id, min(period_start) AS first_start, first(period_end ORDER BY period_start DESC, id DESC) AS last_end, min(period) AS period FROM ev GROUP BY 1),
    k AS (SELECT q.person_id, y, first_start, last_end, s.period,
                 (SELECT count(*) FROM ev WHERE ev.person_id = q.person_id AND y BETWEEN year(period_start) AND year(period_end)) AS n,
                 (SELECT count(*) FROM ev WHERE ev.person_id = q.person_id AND ev.period = s.period AND y BETWEEN year(period_start) AND year(period_end)) AS m
          FROM q LEFT JOIN s USING (person_id))
    SELECT person_id, CASE WHEN period IS NULL THEN 'ok' WHEN n = 0 THEN 'out_of_range' WHEN m = 0 THEN 'other_period' ELSE 'ok' END AS year_status,
           CASE WHEN period IS NOT NULL AND m = 0 THEN y END AS bad_year, first_start, last_end, CASE WHEN m = 0 AND n > 0 THEN n END AS n_candidates FROM k""")
def year_gate(spark, sf):
    ev = c.evaluations(spark, sf)
    own = ev.groupBy("person_id").agg(F.min("period").alias("period"))
    q = c.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("person_id"), F.concat(F.lit("which score in "), (1990 + F.col("c_custkey") % 12).cast("string"), F.lit("?")).alias("text"))
    out = gate.check_years(q.join(own, "person_id", "left"), ev)
    return out.select("person_id", "year_status", "bad_year", "first_start", "last_end", F.when(F.col("candidates").isNotNull(), F.size("candidates")).cast("long").alias("n_candidates"))


@query(f"""WITH {FS}, k AS (SELECT DISTINCT field_code FROM fs UNION SELECT unnest(['8', '9α']))
    SELECT c_custkey, code AS field_code, code IS NOT NULL AND code NOT IN (SELECT field_code FROM k) AS unknown_code
    FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN (c_custkey % 12)::VARCHAR ELSE (c_custkey % 12)::VARCHAR || 'α' END AS code FROM customer)""")
def field_code_gate(spark, sf):
    n = (F.col("c_custkey") % 12).cast("string")
    text = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("the score "), n)).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("show Code "), n, F.lit(" please"))).otherwise(F.concat(F.lit("code "), n, F.lit("a?")))
    q = c.table(spark, sf, "customer").select("c_custkey", text.alias("text"))
    return gate.check_field_codes(q, gate.known_codes(c.field_scores(spark, sf), ["8", "9α"]), ["code"]).select("c_custkey", "field_code", "unknown_code")


@query("SELECT c_custkey::VARCHAR AS person_id, '1996' AS period FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND year(o_orderdate) = 1996)")
def period_exists(spark, sf):
    s = c.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("person_id"), F.lit("1996").alias("period"))
    d = c.table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("person_id"), F.year("o_orderdate").cast("string").alias("period"))
    return gate.existing_periods(s, d)


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def orphan_check(spark, sf):
    return store.orphans(c.table(spark, sf, "customer").select("c_custkey", "c_name"), c.table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("SELECT c_custkey, (c_custkey % 2 = 0) OR (c_custkey % 3 = 0) AS structured FROM customer")
def question_route(spark, sf):
    text = F.when(F.col("c_custkey") % 2 == 0, "What was the SCORE in Fìeld Evaluation?").when(F.col("c_custkey") % 3 == 0, "which promotions came first").otherwise("tell me about the score of the weather")
    return c.table(spark, sf, "customer").select("c_custkey", gate.route(text, ["score"], ["Field Evaluations"], ["promotion"]).alias("structured"))


# Retrieval


@query("""WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0), s AS (
    SELECT vec_id AS id, label::VARCHAR AS person_id, list_cosine_similarity(embedding::DOUBLE[], (SELECT e FROM q)::DOUBLE[]) AS score FROM embeddings WHERE label = 3)
    SELECT id, round(score, 6) AS score FROM s ORDER BY score DESC, id LIMIT 20""")
def vector_topk(spark, sf):
    e = c.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("person_id"), F.lit("career").alias("period"), "embedding")
    asked = e.where("id = 0").first()["embedding"]
    return retrieval.search(e, Scope("3", "1996"), asked).select("id", F.round("score", 6).alias("score"))


@query("""WITH q AS (SELECT vec_id AS question_id, label, embedding AS e FROM embeddings WHERE vec_id % 20 = 0),
    s AS (SELECT question_id, vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]) AS score FROM q JOIN embeddings USING (label)),
    r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS p FROM s)
    SELECT question_id, id, p::INT AS retrieval_rank, round(score, 6) AS score FROM r WHERE p <= 20""")
def scoped_topk_many(spark, sf):
    e = c.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("person_id"), F.lit("career").alias("period"), "embedding")
    q = e.where("id % 20 = 0").select(F.col("id").alias("question_id"), "person_id", F.lit("1996").alias("period"), F.col("embedding").alias("question_embedding"))
    return retrieval.search_many(e, q).select("question_id", "id", "retrieval_rank", F.round("score", 6).alias("score"))


@query(r"""WITH t AS (SELECT item_id, ('0x' || substr(sha256(left(w, 6)), 1, 8))::BIGINT % 256 AS b FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w FROM benchmark)),
    n AS (SELECT item_id, b, count(*) AS n FROM t GROUP BY 1, 2), s AS (SELECT item_id, sqrt(sum(n * n)) AS s FROM n GROUP BY 1)
    SELECT item_id, b::INT AS bucket, round(n / s, 6) AS value FROM n JOIN s USING (item_id)""")
def bow_embedding(spark, sf):
    v = retrieval.bag_vectors(c.table(spark, sf, "benchmark"), "item_id")
    return v.select("item_id", F.posexplode("embedding").alias("bucket", "v")).where("v > 0").select("item_id", "bucket", F.round("v", 6).alias("value"))


@query(r"""WITH t AS (SELECT conv_id, turn, list_distinct(list_transform(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda x: left(x, 6))) AS s FROM conversations),
    p AS (SELECT b.conv_id, b.turn, len(list_intersect(a.s, b.s)) AS shared FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn = 0 AND b.turn > 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY shared DESC, turn) AS k FROM p)
    SELECT conv_id, turn, shared::INT AS shared, k::INT AS rerank_rank FROM r WHERE k <= 5""")
def lexical_rerank(spark, sf):
    t = c.table(spark, sf, "conversations").select("conv_id", "turn", tf.stems(F.col("text")).alias("s"))
    found = t.where("turn > 0").join(t.where("turn = 0").select("conv_id", F.col("s").alias("q")), "conv_id").withColumn("retrieval_rank", F.col("turn"))
    out = retrieval.rerank(found, retrieval.overlap(F.col("q"), F.col("s")), key="conv_id")
    return out.select("conv_id", "turn", F.col("rerank_score").alias("shared"), "rerank_rank")


@query("""SELECT conv_id, string_agg('[c' || conv_id || ', page ' || turn || ', ' || role || ']' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn) AS context, 'c' || conv_id AS doc_ids
    FROM conversations WHERE text IS NOT NULL GROUP BY conv_id""")
def grounded_prompts(spark, sf):
    t = c.table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("rerank_rank"), F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("doc_id"), F.col("turn").alias("page"), F.col("role").alias("section"), "text")
    return retrieval.prompts(t.where("text is not null"), "conv_id").withColumn("doc_ids", F.array_join("doc_ids", ","))


@query("""WITH p AS (SELECT p_partkey, upper(p_type) AS t, upper(p_name) AS x FROM part)
    SELECT p_partkey, concat_ws(',', CASE WHEN regexp_matches(t, '(^|[^A-Z])PROMO([^A-Z]|$)') THEN 'promotion' END, CASE WHEN regexp_matches(t, '(^|[^A-Z])STANDARD([^A-Z]|$)') THEN 'standard' END) AS found FROM p""")
def ranks_named(spark, sf):
    rows = c.table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("answer"))
    return rows.select("p_partkey", F.array_join(retrieval.unsupported_ranks(F.col("answer"), F.lit("nothing"), {"PROMO": "promotion", "STANDARD": "standard"}), ",").alias("found"))


# Sections and sources


@query(r"""WITH p AS (SELECT doc_id, unnest(list_filter(list_transform(string_split_regex(text, '\n\s*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')) AS t FROM documents)
    SELECT doc_id, count(*) AS n, sum(length(t))::BIGINT AS chars FROM p GROUP BY 1""")
def chunk_paragraphs(spark, sf):
    d = c.table(spark, sf, "documents").select("doc_id", F.lit(1).alias("page"), "text")
    return sections.paragraphs(d).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("SELECT conv_id AS doc_id, role AS section, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1, 2")
def sections_joined(spark, sf):
    rows = c.table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("role").alias("section"), F.col("turn").alias("seq"), "text")
    return sections.sections_joined(rows)


@query("""WITH s AS (SELECT conv_id, turn, coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM conversations),
    o AS (SELECT DISTINCT conv_id, (conv_id * 37 % 900)::BIGINT AS off FROM conversations)
    SELECT o.conv_id AS doc_id, off AS "offset", max(turn) AS page FROM o JOIN s ON s.conv_id = o.conv_id AND b <= off GROUP BY 1, 2""")
def page_of_offset(spark, sf):
    t = c.table(spark, sf, "conversations")
    o = t.select(F.col("conv_id").alias("doc_id"), (F.col("conv_id") * 37 % 900).alias("offset")).distinct()
    return sections.page_of_offset(o, t.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text"))


@query(r"""WITH l AS (SELECT doc_id, generate_subscripts(a, 1) AS i, unnest(a) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)),
    b AS (SELECT *, trim(t, ' ') = '' AS blank FROM l), g AS (SELECT *, NOT blank AND coalesce(lag(blank) OVER (PARTITION BY doc_id ORDER BY i), true) AS opens FROM b)
    SELECT doc_id, count(*) AS lines, sum(opens::INT)::BIGINT AS groups FROM g WHERE NOT blank GROUP BY 1""")
def line_groups(spark, sf):
    d = sections.lines(c.table(spark, sf, "documents").select("doc_id", F.lit(1).alias("page"), "text"))
    return sections.line_groups(d).groupBy("doc_id").agg(F.count("*").alias("lines"), (F.max("group") + 1).alias("groups"))


@query()
def section_chunks(spark, sf):
    pages = c.table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.lit(1).alias("page"), src.html_text(F.col("html")).alias("text"))
    return sections.section_chunks(pages, ["Introduction", "Evaluations"])


@query()
def long_text_pieces(spark, sf):
    return splitter.split_long(c.table(spark, sf, "documents").select("doc_id", "text"))


@query(r"""WITH t AS (SELECT page_id, regexp_replace(html, '<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<nav\b[^>]*>.*?</nav\s*>|<head\b[^>]*>.*?</head\s*>|<!--.*?-->', ' ', 'gis') AS t FROM pages),
    b AS (SELECT page_id, regexp_replace(regexp_replace(t, '<(?:br|/?(?:p|div|article|h[1-6]|li|ul|ol|tr|table|section))\b[^>]*>', chr(10), 'gi'), '<[^>]*>', '', 'g') AS t FROM t),
    e AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') AS t FROM b)
    SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), '\s*\n\s*', chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM e""")
def page_extract(spark, sf):
    return c.table(spark, sf, "pages").select("page_id", src.html_text(F.col("html")).alias("text"))


@query(f"""WITH d AS (SELECT l_orderkey AS page, l_linenumber AS n, l_shipdate::DATE AS period_start, l_shipdate::DATE + l_linenumber::INT AS period_end, l_linestatus, l_returnflag, l_quantity::INT AS q FROM lineitem WHERE l_linenumber <> 5
        QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_shipdate) = 1)
    SELECT page, period_start, period_end, 0 AS place, l_linestatus || ' ' || l_returnflag || CASE WHEN n % 2 = 0 THEN ' on board' ELSE '' END AS label, CASE WHEN l_returnflag <> 'R' THEN q END AS days FROM d
    UNION ALL SELECT page, period_start, period_end, 1, 'second', n::INT FROM d UNION ALL SELECT page, period_start, period_end, 2, 'after', NULL FROM d WHERE n % 3 = 0""")
def duties_on_pages(spark, sf):
    found = layout.positional_duties(c.duty_words(spark, sf), anchors=["E.A."], markers=["Evaluator:"])
    each = found.select("page", "period_start", "period_end", F.posexplode("duties").alias("place", "duty"))
    return each.select("page", "period_start", "period_end", "place", "duty.label", "duty.days")


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS content_id FROM documents")
def doc_id_hash(spark, sf):
    return c.table(spark, sf, "documents").select("doc_id", tf.content_id(F.col("text")).alias("content_id"))


@query("""SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events""")
def json_props(spark, sf):
    return c.table(spark, sf, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("""SELECT max(n)::INT AS version, 'p/route/v' || max(n) || '.txt' AS path FROM (SELECT n_nationkey AS n FROM nation)""")
def latest_prompt(spark, sf):
    listing = c.table(spark, sf, "nation").select(F.concat(F.lit("p/route/v"), F.col("n_nationkey").cast("string"), F.lit(".txt")).alias("path"))
    return src.latest_version(listing, "route").select("version", "path")


# Text functions


@query("""SELECT c_custkey, lower(c_name) LIKE '%' || '0012' || '%' AS found FROM customer""")
def person_search(spark, sf):
    return c.table(spark, sf, "customer").select("c_custkey", tf.matches_person(F.col("c_name"), F.lit(""), " 0012 ").alias("found"))


@query("""WITH n AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'Ελένη  Παπαδοπούλου' WHEN 1 THEN 'José ÅNGSTRÖM' WHEN 2 THEN 'μέτρο ΑΣ' WHEN 3 THEN c_name END AS name FROM customer),
    f AS (SELECT c_custkey, regexp_replace(strip_accents(lower(coalesce(name || ' ', '') || c_custkey)), '\\s+', ' ', 'g') AS f FROM n)
    SELECT c_custkey, f LIKE '%ελενη παπα%' AS greek, f LIKE '%se angstrom%' AS latin, f LIKE '%m%' OR f LIKE '%μετρο%' AS mu, f LIKE '%ας%' OR f LIKE '%ασ%' AS sigma, true AS everyone FROM f""")
def person_search_folded(spark, sf):
    k = F.col("c_custkey")
    name = F.when(k % 5 == 0, "Ελένη  Παπαδοπούλου").when(k % 5 == 1, "José ÅNGSTRÖM").when(k % 5 == 2, "μέτρο ΑΣ").when(k % 5 == 3, F.col("c_name"))
    found = {"greek": "ΕΛΕΝΗ παπά", "latin": " se  Angström", "mu": "M", "sigma": "ΑΣ", "everyone": " "}
    return c.table(spark, sf, "customer").select(k, *[tf.matches_person(name, k.cast("string"), q).alias(n) for n, q in found.items()])


@query("""SELECT p_partkey, upper(CASE WHEN len(w) >= 2 THEN left(w[1], 1) || left(w[2], 1) ELSE left(w[1], 2) END) AS initials FROM (SELECT p_partkey, list_filter(string_split(trim(p_name), ' '), lambda x: x <> '') AS w FROM part)""")
def initials(spark, sf):
    return c.table(spark, sf, "part").select("p_partkey", tf.initials(F.col("p_name")).alias("initials"))


@query(r"""SELECT c_custkey, CASE WHEN regexp_full_match(u, '[a-z0-9._-]{3,64}') THEN u END AS username FROM (SELECT c_custkey, lower(trim(CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_name || '!' END)) AS u FROM customer)""")
def usernames(spark, sf):
    return c.table(spark, sf, "customer").select("c_custkey", tf.username(F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(F.concat("c_name", F.lit("!")))).alias("username"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 2 THEN NULL ELSE 'R' || s_nationkey END AS rank, s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'lead' END AS role FROM supplier""")
def evaluators(spark, sf):
    s = c.table(spark, sf, "supplier")
    rank, k = F.concat(F.lit("R"), F.col("s_nationkey").cast("string")), F.col("s_suppkey") % 3
    text = F.when(k == 0, F.concat_ws(", ", rank, "s_name", F.lit("lead"))).when(k == 1, F.concat_ws(", ", rank, "s_name")).otherwise(F.col("s_name"))
    return s.select("s_suppkey", tf.evaluator(text).alias("e")).select("s_suppkey", "e.rank", "e.name", "e.role")


@query("""SELECT c_custkey, try_strptime(t, '%d/%m/%Y')::DATE AS date, try_strptime(t, '%d/%m/%Y') IS NULL AS rejected
    FROM (SELECT c_custkey, printf('%02d/02/%04d', 1 + c_custkey % 31, 1990 + c_custkey % 20) AS t FROM customer)""")
def parsed_dates(spark, sf):
    text = F.format_string("%02d/02/%04d", 1 + F.col("c_custkey") % 31, 1990 + F.col("c_custkey") % 20)
    out = c.table(spark, sf, "customer").select("c_custkey", tf.parsed_date(text).alias("p"))
    return out.select("c_custkey", "p.date", "p.rejected")


@query("""SELECT l_orderkey, l_linenumber, 'yes' AS word, CASE WHEN l_returnflag = 'R' THEN 'yes' ELSE l_partkey::VARCHAR END AS value FROM lineitem""")
def ingested_values(spark, sf):
    text = F.when(F.col("l_returnflag") == "R", "yes").otherwise(F.concat(F.lit("part no "), F.col("l_partkey").cast("string"), F.lit(" (2)")))
    return c.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.lit("yes").alias("word"), tf.ingested_value(text, ["yes", "no"]).alias("value"))


SCORE_LABELS = ("FIELD", "DESCRIPTION", "SCORE")


@query("""WITH t AS (SELECT *, l_linenumber::VARCHAR || 'β' AS code FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, 0 AS place, code AS field_code, 'part ' || l_partkey AS description,
        CASE l_returnflag WHEN 'R' THEN 'yes' WHEN 'A' THEN l_quantity::INT::VARCHAR ELSE 'not given' END AS value, 1::BIGINT AS rejected FROM t
    UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 1, '141', 'overall', '95', 1 FROM t""")
def labelled_field_scores(spark, sf):
    t = c.table(spark, sf, "lineitem")
    value = F.when(F.col("l_returnflag") == "R", "yes").when(F.col("l_returnflag") == "A", F.concat(F.lit("about "), F.col("l_quantity").cast("int").cast("string"), F.lit(" of 50"))).otherwise("not given")
    first = F.concat(F.lit("FIELD: "), F.col("l_linenumber").cast("string"), F.lit("β | DESCRIPTION:  part "), F.col("l_partkey").cast("string"), F.lit(" |SCORE:  "), value, F.lit("  "))
    text = F.concat(F.lit("of the period\n"), first, F.lit("\n  FIELD: 141 | DESCRIPTION:  | SCORE: 95\nFIELD: 9 | SCORE: 3\nsee FIELD: 7 | DESCRIPTION: x | SCORE: 1"))
    rows = t.select("l_orderkey", "l_linenumber", "l_partkey", F.posexplode(extract.labelled_scores(text, SCORE_LABELS, ["yes", "no"], {"141": "overall"})).alias("place", "f"), F.size(extract.rejected_scores(text, SCORE_LABELS)).cast("long").alias("rejected"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "place", "f.*", "rejected")


PROMOTION_HEADER = ("RANK", "DATE OF DECISION", "DECISION", "DATE OF PROMOTION")


def _promotion_texts(spark, sf):
    brand, kind = F.col("p_brand"), F.col("p_type")
    head, n = "table of\n RANK \nDATE OF DECISION\nDECISION\nDATE OF PROMOTION\n\n", F.col("p_partkey") % 3
    body = F.concat(brand, F.lit("\n01/01/2000\nfor 2019-\n2020 as "), kind, F.lit("\n02/02/2001\n  \n"), F.when(n == 0, F.concat(kind, F.lit("\ntwo lines\n\n"))).otherwise(""), brand, F.lit("\n03/03/2002\nby right\n-"))
    return c.spread(c.table(spark, sf, "part"), "p_partkey").select(F.col("p_partkey").alias("doc_id"), F.when(n == 2, F.concat(F.lit("no table\n\n"), body)).otherwise(F.concat(F.lit(head), body)).alias("text"))


@query("""WITH l AS (SELECT p_partkey AS doc_id, p_partkey % 3 AS n, chr(10) AS b, p_brand, p_type FROM part)
    SELECT doc_id, CASE WHEN n = 2 THEN 'no table' || b || b || p_brand || b || '01/01/2000' || b || 'for 2019-' || b || '2020 as ' || p_type || b || '02/02/2001' || b || '  ' || b || p_brand || b || '03/03/2002' || b || 'by right' || b || '-'
        ELSE 'table of' || b || ' RANK ' || b || 'DATE OF DECISION' || b || 'DECISION' || b || 'DATE OF PROMOTION' || b || b
            || 'RANK: ' || p_brand || ' | DATE OF DECISION: 01/01/2000 | DECISION: for 2019-2020 as ' || p_type || ' | DATE OF PROMOTION: 02/02/2001' || b || '  ' || b
            || CASE WHEN n = 0 THEN p_type || b || 'two lines' || b || b ELSE '' END || 'RANK: ' || p_brand || ' | DATE OF DECISION: 03/03/2002 | DECISION: by right | DATE OF PROMOTION: -' END AS text FROM l""")
def promotions_annotated(spark, sf):
    once = _promotion_texts(spark, sf).withColumn("text", promotions.annotated(F.col("text"), PROMOTION_HEADER))
    return once.withColumn("text", promotions.annotated(F.col("text"), PROMOTION_HEADER))  # nothing is left for a second time


@query("""WITH l AS (SELECT p_partkey AS doc_id, p_partkey % 3 AS n, p_brand, p_type FROM part WHERE p_partkey % 3 <> 2)
    SELECT doc_id, 0 AS place, 'row' AS kind, p_brand AS rank, '01/01/2000' AS decision_date, 'for 2019-2020 as ' || p_type AS decision, '02/02/2001' AS promotion_date FROM l
    UNION ALL SELECT doc_id, 1, 'short', NULL, NULL, NULL, NULL FROM l WHERE n = 0
    UNION ALL SELECT doc_id, CASE WHEN n = 0 THEN 2 ELSE 1 END, 'row', p_brand, '03/03/2002', 'by right', '-' FROM l""")
def promotion_table_groups(spark, sf):
    return promotions.promotion_groups(_promotion_texts(spark, sf), PROMOTION_HEADER).drop("lines")


@query("""SELECT c_custkey, 'a. Merits' || CASE WHEN c_custkey % 2 = 0 THEN ': (empty)' ELSE '' END || chr(10) || CASE WHEN c_custkey % 2 = 0 THEN ' ' ELSE c_name END || chr(10)
        || 'b. Penalties' || CASE WHEN c_custkey % 3 = 0 AND c_custkey % 5 = 0 THEN ': (empty)' ELSE '' END || chr(10) || '  (1) by law' || CASE WHEN c_custkey % 3 = 0 THEN ': (empty)' ELSE '' END || chr(10)
        || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END || chr(10) || '  (2) co - signed' || CASE WHEN c_custkey % 5 = 0 THEN ': (empty)' ELSE '' END || chr(10) || CASE WHEN c_custkey % 5 = 0 THEN chr(9) ELSE c_name END || chr(10) || 'c. Health' || chr(10) AS text FROM customer""")
def empty_zones_marked(spark, sf):
    k, name = F.col("c_custkey"), F.col("c_name")
    text = F.concat(F.lit("a. Merits\n"), F.when(k % 2 == 0, " ").otherwise(name), F.lit("\nb. Penalties\n  (1) by law\n"), F.when(k % 3 == 0, "").otherwise(name), F.lit("\n  (2) co - signed\n"), F.when(k % 5 == 0, "\t").otherwise(name), F.lit("\nc. Health\n"))
    labels = ["a. Merits", "b. Penalties", "(1) by  law", "(2) co-signed", "c. Health"]
    mark = lambda t: extract.empty_zones(t, labels, {"b. Penalties": labels[2:4]}, ["c. Health"])
    return c.spread(c.table(spark, sf, "customer"), "c_custkey").withColumn("text", mark(text)).select("c_custkey", mark(F.col("text")).alias("text"))


@query("SELECT p_partkey, p_brand AS brand, p_type AS kind FROM part")
def pipe_rows(spark, sf):
    text = F.concat_ws(" | ", F.concat(F.lit("brand: old")), F.concat(F.lit("kind: "), "p_type"), F.concat(F.lit("brand: "), "p_brand"))
    return c.table(spark, sf, "part").select("p_partkey", tf.pipe_row(text).alias("m")).select("p_partkey", F.col("m")["brand"].alias("brand"), F.col("m")["kind"].alias("kind"))


@query("SELECT p_partkey, p_name || ' ' || p_brand AS value FROM part")
def labelled_values(spark, sf):
    text = F.concat(F.lit("First : x\nPart  name : "), "p_name", F.lit("\n   "), "p_brand", F.lit("\nNext: y"))
    return c.table(spark, sf, "part").select("p_partkey", tf.labelled_value(text, "Part name").alias("value"))


@query()
def fuzzy_titles(spark, sf):
    return c.table(spark, sf, "part").select("p_partkey", tf.fuzzy_ratio(F.lower("p_name"), F.lower("p_type")).alias("ratio"))


@query(r"""WITH d AS (SELECT doc_id, replace(upper(replace(text, 'ß', 'SS')), 'O', 'Ο') AS t FROM documents),
    k AS (SELECT doc_id, regexp_extract_all(t, '\s+|\S+') AS parts FROM d),
    m AS (SELECT doc_id, parts, list_transform(parts, lambda x: regexp_matches(x, '[A-Za-z]') AND len(regexp_extract_all(x, '\p{Greek}')) > 0 AND 2 * len(regexp_extract_all(x, '\p{Greek}')) > len(regexp_extract_all(x, '\p{L}'))) AS mixed FROM k)
    SELECT doc_id, len(list_filter(mixed, lambda x: x))::INT AS mixed,
           coalesce(array_to_string(list_transform(parts, lambda x, i: CASE WHEN mixed[i] AND regexp_full_match(x, '\p{L}+') THEN translate(x, 'ABEHIKMNOPTXYZ', 'ΑΒΕΗΙΚΜΝΟΡΤΧΥΖ') ELSE x END), ''), '') AS repaired FROM m""")
def mixed_script(spark, sf):
    d = c.spread(c.table(spark, sf, "documents").select("doc_id", "text"), "doc_id").select("doc_id", F.translate(F.upper("text"), "O", "Ο").alias("text"))
    return d.select("doc_id", F.size(tf.mixed_script_tokens(F.col("text"))).alias("mixed"), tf.repair_lookalikes("text").alias("repaired"))


# Evaluation


@query("""WITH r AS (SELECT source AS case_id, doc_id, lang, quality FROM documents LEFT JOIN labels USING (doc_id)),
    x AS (SELECT case_id, count(*) FILTER (lang IN ('en', 'fr')) AS nr, count(*) FILTER (quality = 1) AS ne, count(*) FILTER (quality = 1 AND lang IN ('en', 'fr')) AS hit, count(*) FILTER (lang = 'fr') AS leaks FROM r GROUP BY 1)
    SELECT case_id, round(CASE WHEN ne > 0 THEN hit / ne END, 6) AS recall, round(CASE WHEN ne > 0 THEN CASE WHEN nr > 0 THEN hit / nr ELSE 0 END END, 6) AS precision, leaks, CASE WHEN ne = 0 THEN nr = 0 END AS empty_ok FROM x""")
def citation_metrics(spark, sf):
    return evals.case_metrics(*_eval_inputs(spark, sf)).withColumns({"recall": F.round("recall", 6), "precision": F.round("precision", 6)})


@query("""WITH r AS (SELECT source AS case_id, lang, quality FROM documents LEFT JOIN labels USING (doc_id)),
    x AS (SELECT case_id, count(*) FILTER (lang IN ('en', 'fr')) AS nr, count(*) FILTER (quality = 1) AS ne, count(*) FILTER (quality = 1 AND lang IN ('en', 'fr')) AS hit, count(*) FILTER (lang = 'fr') AS leaks FROM r GROUP BY 1)
    SELECT round(avg(CASE WHEN ne > 0 THEN hit / ne END), 6) AS recall, round(avg(CASE WHEN ne > 0 THEN hit / nr END), 6) AS precision, sum(leaks)::BIGINT AS leaks, coalesce(bool_and(CASE WHEN ne = 0 THEN nr = 0 END), false) AS empty_ok,
           sum(leaks) = 0 AND coalesce(bool_and(CASE WHEN ne = 0 THEN nr = 0 END), false) AS passed FROM x""")
def metric_rollup(spark, sf):
    return evals.roll_up(evals.case_metrics(*_eval_inputs(spark, sf))).withColumns({"recall": F.round("recall", 6), "precision": F.round("precision", 6)})


def _eval_inputs(spark, sf):
    d = c.table(spark, sf, "documents").join(c.table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left").withColumn("doc_id", F.col("doc_id").cast("string"))
    cases = d.select(F.col("source").alias("case_id")).distinct().select("case_id", F.col("case_id").alias("person_id"), F.lit("en").alias("period"))
    wanted = d.where("quality = 1").select(F.col("source").alias("case_id"), "doc_id")
    found = d.where("lang in ('en', 'fr')").select(F.col("source").alias("case_id"), "doc_id")
    return cases, found, d.select("doc_id", F.col("source").alias("person_id"), F.col("lang").alias("period")), wanted


@query("""WITH r AS (SELECT o_orderpriority AS tier, o_orderstatus AS s FROM orders)
    SELECT tier, count(*) FILTER (s = 'O') AS pass, count(*) FILTER (s = 'F') AS fail, count(*) FILTER (s = 'P') AS weak, 0::BIGINT AS known_gap, 0::BIGINT AS needs_human, 0::BIGINT AS error, count(*) AS total FROM r GROUP BY 1""")
def status_pivot(spark, sf):
    names = F.create_map(*[F.lit(x) for x in ("O", "pass", "F", "fail", "P", "weak")])
    return evals.status_table(c.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("tier"), names[F.col("o_orderstatus")].alias("status")))


@query("SELECT user_id AS id, count(*) - 1 AS repeats FROM events GROUP BY 1 HAVING count(*) > 1")
def repeated_ids(spark, sf):
    return evals.repeated_ids(c.table(spark, sf, "events").select(F.col("user_id").alias("id")))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'error' WHEN o_orderkey % 7 = 0 THEN 'known_gap' WHEN o_orderkey % 5 = 0 THEN 'needs_human' WHEN o_orderstatus <> 'F' THEN CASE WHEN o_orderkey % 3 < 1 THEN 'weak' ELSE 'pass' END ELSE 'fail' END AS status FROM orders""")
def answer_status(spark, sf):
    k = F.col("o_orderkey")
    tier, size = F.when(k % 5 == 0, "C").otherwise("A"), F.when(k % 3 < 1, 2).otherwise(9)
    return c.table(spark, sf, "orders").select("o_orderkey", evals.status(tier, F.col("o_orderstatus") != "F", k % 7 == 0, k % 11 == 0, size).alias("status"))


# Layout


@query("""WITH RECURSIVE w AS (SELECT l_orderkey AS doc_id, l_linenumber * 40.0::DOUBLE AS x0, l_quantity::DOUBLE * 2 AS y0, l_partkey::VARCHAR AS text,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_linenumber, l_partkey::VARCHAR) AS r FROM lineitem),
    s AS (SELECT doc_id, r, x0, y0, text, 0 AS row, y0 AS top FROM w WHERE r = 1
        UNION ALL SELECT w.doc_id, w.r, w.x0, w.y0, w.text, CASE WHEN w.y0 - s.top > 3 THEN s.row + 1 ELSE s.row END, CASE WHEN w.y0 - s.top > 3 THEN w.y0 ELSE s.top END FROM s JOIN w ON w.doc_id = s.doc_id AND w.r = s.r + 1)
    SELECT doc_id, 1 AS page, row, coalesce(string_agg(text, ' ' ORDER BY x0, text) FILTER (x0 < 100), '') AS label, coalesce(string_agg(text, ' ' ORDER BY x0, text) FILTER (x0 >= 100 AND x0 < 200), '') AS years,
           coalesce(string_agg(text, ' ' ORDER BY x0, text) FILTER (x0 >= 200), '') AS rest FROM s WHERE y0 < 817 AND x0 < 400 GROUP BY ALL""")
def layout_rows(spark, sf):
    n = F.col("l_linenumber").cast("double")
    words = c.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), (n * 40).alias("x0"), (F.col("l_quantity") * 2.0).alias("y0"), (n * 40 + 30).alias("x1"), (F.col("l_quantity") * 2.0 + 8).alias("y1"), F.col("l_partkey").cast("string").alias("text"))
    return layout.cells(layout.clustered_rows(words), {"label": (0.0, 100.0), "years": (100.0, 200.0), "rest": (200.0, 400.0)})


@query("""WITH a AS (SELECT l_orderkey AS d, l_quantity::DOUBLE AS y FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1, 2), m AS (SELECT l_orderkey AS d, l_quantity::DOUBLE AS y FROM lineitem WHERE l_linenumber > 2),
    n AS (SELECT d, y, coalesce(lead(y) OVER (PARTITION BY d ORDER BY y), 'inf'::DOUBLE) AS nx FROM a)
    SELECT d AS doc_id, 1 AS page, y, y - 3 AS top, coalesce((SELECT min(m.y) FROM m WHERE m.d = n.d AND m.y > n.y AND m.y < n.nx), nx) AS bottom FROM n""")
def block_bounds(spark, sf):
    rows = c.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.col("l_quantity").cast("double").alias("y"), "l_linenumber")
    return layout.block_bounds(rows.where("l_linenumber <= 2").select("doc_id", "page", "y").distinct(), rows.where("l_linenumber > 2").drop("l_linenumber"))


# Storage and state


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN c_name || ' new' ELSE c_name END AS name, c_nationkey AS created FROM customer
    UNION ALL SELECT c_custkey + 1000000, c_name || ' new', 99 FROM customer WHERE c_custkey % 10 = 0""")
def upsert_merge(spark, sf):
    t = c.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("created"))
    changed = t.where("id % 2 = 0").select("id", F.concat("name", F.lit(" new")).alias("name"), F.lit(99).alias("created"))
    added = t.where("id % 10 = 0").select((F.col("id") + 1000000).alias("id"), F.concat("name", F.lit(" new")).alias("name"), F.lit(99).alias("created"))
    return store.upsert(t, changed.union(added), ["id"], keep=["created"])


@query(f"WITH {FS} SELECT id, eval_id, field_code, value FROM fs WHERE eval_id % 4 <> 0 UNION ALL SELECT id + 1, eval_id, field_code, 'no' FROM fs WHERE eval_id % 4 = 0 AND field_code = '1'")
def replace_children(spark, sf):
    t = c.field_scores(spark, sf)
    new = t.where("eval_id % 4 = 0 and field_code = '1'").select((F.col("id") + 1).alias("id"), "eval_id", "field_code", F.lit("no").alias("value"))
    return store.replace_children(t, new, "eval_id", parents=t.where("eval_id % 4 = 0"))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 97 = 3 THEN c_name || ' new' ELSE c_name END AS name, c_nationkey AS created FROM customer WHERE c_custkey % 97 <> 5
    UNION ALL SELECT -c_custkey, c_name || ' new', 99 FROM customer WHERE c_custkey % 97 = 3""")
def bucketed_merge(spark, sf):
    t = c.table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("int").alias("created"))
    kept = BucketedTable(spark, scratch_path(spark, "bucketed"), "id long, name string, created int", ["id"], buckets=32)
    kept.merge(t)
    changed = t.where("id % 97 = 3").select("id", F.concat("name", F.lit(" new")).alias("name"), F.lit(99).alias("created"))
    kept.merge(changed.union(changed.select(-F.col("id"), "name", "created")), keep=["created"])
    kept.delete(t.where("id % 97 = 5").select("id"))
    return kept.read()


@query(f"""WITH {FS} SELECT id, eval_id, field_code, value FROM fs WHERE eval_id % 50 <> 1
    UNION ALL SELECT id + 1, eval_id, field_code, 'no' FROM fs WHERE eval_id % 50 = 1 AND field_code = '1'""")
def bucketed_children(spark, sf):
    t = c.field_scores(spark, sf)
    kept = BucketedTable(spark, scratch_path(spark, "children"), "id long, eval_id long, field_code string, value string", ["eval_id"], buckets=32)
    kept.replace(t)
    loaded = t.where("eval_id % 50 = 1")
    kept.replace(loaded.where("field_code = '1'").select((F.col("id") + 1).alias("id"), "eval_id", "field_code", F.lit("no").alias("value")), parents=loaded)
    return kept.read()


@query("""SELECT sha256(text) AS sha256, octet_length(encode(text))::BIGINT AS n_bytes FROM (
    SELECT chr(65279) || 'id;status;note' || chr(13) || chr(10) || string_agg(o_orderkey || ';' || o_orderstatus || ';' || CASE WHEN o_orderkey % 3 = 0 THEN chr(34) || 'a;' || chr(34) || chr(34) || o_orderpriority || chr(34) || chr(34) || chr(34) WHEN o_orderkey % 3 = 1 THEN o_orderpriority ELSE '' END || chr(13) || chr(10), '' ORDER BY o_custkey, o_orderkey) AS text FROM orders)""")
def csv_file_export(spark, sf):
    o = c.table(spark, sf, "orders")
    note = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit('a;"'), "o_orderpriority", F.lit('"'))).when(F.col("o_orderkey") % 3 == 1, F.col("o_orderpriority"))
    path = scratch_path(spark, "export") + ".csv"
    sorted_by = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), note.alias("note"))
    csv_file.write_csv(sorted_by, path, [o["o_custkey"], "id"])
    return spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("sha256"), F.col("length").alias("n_bytes"))


@query("SELECT 'customer' AS name, count(*) AS rows FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'sessions', 0")
def published_copy(spark, sf):
    target = scratch_path(spark, "copy")
    tables = {"customer": c.table(spark, sf, "customer"), "orders": c.table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")}
    store.copy_tables(tables, {"orders": ["o_orderkey"]}, [("orders", "customer", "c_custkey")], target, empty={"sessions": "token_hash string, user_id long"})
    counts = [spark.read.parquet(f"{target}/{n}").agg(F.count("*").alias("rows")).select(F.lit(n).alias("name"), "rows") for n in ("customer", "orders", "sessions")]
    return counts[0].union(counts[1]).union(counts[2])


@query("SELECT n_nationkey || ';' || n_name || ';' || CASE WHEN n_nationkey % 2 = 0 THEN '\"a;\"\"b\"' ELSE '' END AS line FROM nation")
def csv_export(spark, sf):
    return store.csv_lines(c.table(spark, sf, "nation").select("n_nationkey", "n_name", F.when(F.col("n_nationkey") % 2 == 0, 'a;"b').alias("x")))


@query("SELECT 'customer' AS name, count(*) AS rows FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem")
def table_counts(spark, sf):
    parts = [c.table(spark, sf, n).agg(F.count("*").alias("rows")).select(F.lit(n).alias("name"), "rows") for n in ("customer", "orders", "lineitem")]
    return parts[0].union(parts[1]).union(parts[2])


@query("""WITH s AS (SELECT event_id AS token, user_id, ts FROM events WHERE event_type = 'signup'), n AS (SELECT max(ts) AS now FROM events)
    SELECT token::VARCHAR AS token_hash, user_id, 'u' || user_id AS username, 'viewer' AS role FROM s, n WHERE now < ts + INTERVAL 8 HOUR AND user_id % 3 <> 0""")
def session_ttl(spark, sf):
    e = c.table(spark, sf, "events")
    now = e.agg(F.max("ts").alias("now"))
    s = e.where("event_type = 'signup'").select(F.col("event_id").cast("string").alias("token_hash"), "user_id", F.col("ts").alias("created_at"))
    users = e.select("user_id").distinct().select("user_id", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("username"), F.lit("viewer").alias("role"), (F.col("user_id") % 3 != 0).alias("is_active"))
    return sessions.live_sessions(s.join(F.broadcast(now)), users, F.col("now"))  # now is one row


@query("""WITH s AS (SELECT event_id AS token, user_id, ts FROM events WHERE event_type = 'signup'), n AS (SELECT date_trunc('millisecond', max(ts)) AS now FROM events)
    SELECT token::VARCHAR AS token_hash, user_id, ts AS created_at FROM s, n WHERE now < ts + INTERVAL 8 HOUR""")
def session_expiry(spark, sf):
    """The sessions that a stream of all events has not purged at its end; watermarks and timers count milliseconds."""
    path = f"{sf}/event[s].parquet"  # a pattern, as a stream takes no single file
    e = spark.readStream.schema(c.table(spark, sf, "events").schema).parquet(path)
    rows = e.select(F.col("event_id").cast("string").alias("token_hash"), "user_id", F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") == "signup", "create").otherwise("use").alias("kind"))
    root = scratch_path(spark, "sessions")
    return expiry.still_open(expiry.run_sessions(rows, f"{root}/out", f"{root}/state")).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


@query(f"""WITH {EV}, {DOCS}, f AS (SELECT person_id, doc_id, first(period_start ORDER BY period_start, id) AS s, first(id ORDER BY period_start, id) AS i FROM ev JOIN docs USING (person_id, period) GROUP BY ALL)
    SELECT person_id, string_agg(doc_id, ',' ORDER BY s, i) AS doc_ids FROM f GROUP BY 1""")
def first_seen_documents(spark, sf):
    found = timeline.first_seen_documents(timeline.points(c.dealt_evaluations(spark, sf), c.documents(spark, sf)))
    return found.select("person_id", F.array_join("doc_ids", ",").alias("doc_ids"))


@query("""WITH RECURSIVE a AS (SELECT user_id, ts, event_id AS attempt_id, event_type = 'signup' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events WHERE event_type IN ('error', 'signup')),
    s AS (SELECT DISTINCT user_id, 0::BIGINT AS r, 0 AS n, NULL::TIMESTAMP AS until, NULL::BIGINT AS attempt_id, NULL::TIMESTAMP AS ts, NULL::BOOLEAN AS ok, NULL::VARCHAR AS outcome FROM a
        UNION ALL SELECT user_id, r, CASE WHEN held THEN n WHEN ok OR n >= 4 THEN 0 ELSE n + 1 END, CASE WHEN NOT held AND NOT ok AND n >= 4 THEN moment + INTERVAL 15 MINUTE ELSE until END, id, moment, ok,
            CASE WHEN held THEN 'refused' WHEN ok THEN 'ok' WHEN n >= 4 THEN 'locked' ELSE 'failed' END
        FROM (SELECT a.user_id, a.r, s.n, s.until, a.attempt_id AS id, a.ts AS moment, a.ok, coalesce(a.ts < s.until, false) AS held FROM s JOIN a ON a.user_id = s.user_id AND a.r = s.r + 1))
    SELECT user_id, attempt_id, ts, ok, outcome FROM s WHERE r > 0""")
def lockout(spark, sf):
    e = c.table(spark, sf, "events").where("event_type in ('error', 'signup')")
    return sessions.lockouts(e.select("user_id", "ts", F.col("event_id").alias("attempt_id"), (F.col("event_type") == "signup").alias("ok")))
