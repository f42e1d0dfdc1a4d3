"""Queries of linking and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.functions import match as M
from pairloom.operators import linking as op
from pairloom.plans.registry import query

_NORM = r"trim(regexp_replace(regexp_replace(trim(lower({x})), '[^\p{L}\p{N}_\s+#]', ' ', 'g'), '\s+', ' ', 'g'))"


def norm(x: str) -> str:
    return _NORM.replace("{x}", x)


_LABELS = "(SELECT skill_id, ord, 0 AS k, label FROM {v_taxonomy} UNION ALL SELECT skill_id, ord, 1, alt FROM {v_taxonomy} UNION ALL SELECT skill_id, ord, 2, 'Shared (' || kind || ')' FROM {v_taxonomy} WHERE ord % 5 = 0 UNION ALL SELECT skill_id, ord, 3, 'Solid ' || label || ' (old)' FROM {v_taxonomy})"
_INDEX = f"(SELECT key, arg_min(skill_id, ord * 10 + k) AS skill_id FROM (SELECT skill_id, ord, k, {norm('label')} AS key FROM {_LABELS} l) GROUP BY key)"


def _labels(t):
    extra = F.when(F.col("ord") % 5 == 0, F.concat(F.lit("Shared ("), "kind", F.lit(")")))
    return t.v_taxonomy.select("skill_id", "ord", F.array_compact(F.array("label", "alt", extra, F.concat(F.lit("Solid "), "label", F.lit(" (old)")))).alias("labels"))


def _spans(t):
    text = F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), F.lit(", ")), F.lit(" and "), F.upper(F.split_part("p_name", F.lit(" "), F.lit(1))), F.lit("; unknown thing."))
    return t.part.select(F.col("p_partkey").alias("id"), text.alias("span"))


@query("w10_alias_index", f"SELECT key, skill_id FROM {_INDEX} x WHERE key <> ''")
def w10(t):
    return op.alias_index(_labels(t))


@query("w11_derived_aliases", f"""SELECT key, min(skill_id) AS skill_id FROM (SELECT DISTINCT skill_id, {norm("regexp_extract(trim(label), '^(.+?)\\s*\\([^)]+\\)\\s*$', 1)")} AS key FROM {_LABELS} l) c
 WHERE length(key) > 2 AND key NOT IN ('can', 'lead', 'go', 'r', 'c', 'it', 'ai') AND key NOT IN (SELECT key FROM {_INDEX} i) GROUP BY key HAVING count(DISTINCT skill_id) = 1""")
def w11(t):
    return op.derived_aliases(_labels(t), op.alias_index(_labels(t)))


@query("w12_merge_aliases", f"""WITH o AS (SELECT * FROM (SELECT 'skill:' || word AS skill_id, size AS ord, word || size AS a, 'common' || size % 3 AS b, row_number() OVER (PARTITION BY word ORDER BY size) AS rn
  FROM (SELECT split_part(p_name, ' ', 1) AS word, min(p_size) AS size FROM part GROUP BY 1, p_type UNION ALL SELECT 'nosuch', 0)) WHERE rn = 1)
SELECT key, arg_min(skill_id, ord * 10 + k + 0.001 * h) AS skill_id FROM (SELECT skill_id, ord, 0 AS k, {norm('a')} AS key, rank() OVER (ORDER BY skill_id) AS h FROM o UNION ALL SELECT skill_id, ord, 1, {norm('b')}, rank() OVER (ORDER BY skill_id) FROM o) x
 WHERE skill_id IN (SELECT skill_id FROM {_INDEX} i) AND key NOT IN (SELECT key FROM {_INDEX} i) GROUP BY key""")
def w12(t):
    words = t.part.groupBy(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("word"), "p_type").agg(F.min("p_size").alias("size")).drop("p_type")
    words = words.unionByName(t.spark.createDataFrame([("nosuch", 0)], "word string, size int"))
    size = F.col("size").cast("string")
    over = words.select(F.concat(F.lit("skill:"), "word").alias("skill_id"), F.col("size").alias("ord"), F.array(F.concat("word", size), F.concat(F.lit("common"), (F.col("size") % 3).cast("string"))).alias("aliases"))
    return op.merge_aliases(op.alias_index(_labels(t)), over)


_FRAG = f"""(SELECT id, arg_min(fragment, k) AS fragment, min(k) AS k, norm FROM (SELECT id, k, fragment, {norm('fragment')} AS norm FROM (
  SELECT id, 0 AS k, trim(span) AS fragment FROM s UNION ALL SELECT id, 1, a FROM s UNION ALL SELECT id, 2, b FROM s UNION ALL SELECT id, 3, upper(a) FROM s UNION ALL SELECT id, 4, 'unknown thing' FROM s)) GROUP BY id, norm)"""
_SPAN = "WITH s AS (SELECT p_partkey AS id, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, ' ' || replace(p_name, ' ', ', ') || ' and ' || upper(split_part(p_name, ' ', 1)) || '; unknown thing.' AS span FROM part)"


@query("x5_expand_spans", f"{_SPAN} SELECT id, fragment, norm FROM {_FRAG} f")
def x5(t):
    return op.expand_spans(_spans(t), "id", "span").select("id", "fragment", "norm")


@query("j6_link_exact", f"{_SPAN} SELECT id, fragment, skill_id FROM {_FRAG} f LEFT JOIN {_INDEX} i ON i.key = f.norm")
def j6(t):
    return op.link_exact(op.expand_spans(_spans(t), "id", "span"), op.alias_index(_labels(t))).select("id", "fragment", "skill_id")


_CONCEPTS = "(SELECT label AS d, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY label)"
_TOP2 = f"(SELECT q, arg_min(d, rk) AS best_id, max(s) FILTER (WHERE rk = 1) AS best, max(s) FILTER (WHERE rk = 2) AS second FROM (SELECT q, d, s, row_number() OVER (PARTITION BY q ORDER BY s DESC, d) AS rk FROM (SELECT vec_id AS q, d, round(list_inner_product(e.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS s FROM embeddings e, {_CONCEPTS} c)) WHERE rk <= 2 GROUP BY q)"


def _top2(t):
    concepts = t.embeddings.groupBy(F.col("label").alias("d")).agg(F.min_by("embedding", "vec_id").alias("embedding"))
    return op.similarity_top2(t.embeddings.select(F.col("vec_id").alias("q"), "embedding"), concepts)


@query("j7_similarity_top2", f"SELECT q, best_id, best + 0 AS best, second + 0 AS second FROM {_TOP2} x")
def j7(t):
    return _top2(t).select("q", "best_id", (F.col("best") + 0.0).alias("best"), (F.col("second") + 0.0).alias("second"))


# Spans of vectors: a name that may be a key, else the vector decides. Names are "vec n", keys are those of concepts with an even number.
_VSPAN = f"""(SELECT q, best_id, best, second, CASE WHEN q % 4 = 0 THEN 'concept:' || (q % 10) END AS keyed FROM {_TOP2} x)"""


@query("x6_link_report", f"""SELECT q AS id, CASE WHEN keyed IS NOT NULL THEN keyed || CASE WHEN near IS NOT NULL AND near <> keyed THEN ',' || near ELSE '' END ELSE coalesce(near, '') END AS skill_ids, keyed IS NULL AND near IS NULL AS unlinked
FROM (SELECT *, CASE WHEN best >= 0.3 OR (best >= 0.2 AND best - second >= 0.02) THEN 'concept:' || best_id END AS near FROM {_VSPAN} v) y""")
def x6(t):
    concepts = t.embeddings.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding")).select(F.concat(F.lit("concept:"), F.col("label").cast("string")).alias("d"), "embedding")
    vectors = t.embeddings.select(F.concat(F.lit("vec "), F.col("vec_id").cast("string")).alias("norm"), "embedding")
    keys = t.embeddings.select((F.col("vec_id") % 10).alias("n")).distinct().select(F.concat(F.lit("named "), F.col("n").cast("string")).alias("key"), F.concat(F.lit("concept:"), F.col("n").cast("string")).alias("skill_id"))
    name = F.concat(F.lit("Vec "), F.col("vec_id").cast("string"))
    spans = t.embeddings.select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 4 == 0, F.concat(F.lit("NAMED "), (F.col("vec_id") % 10).cast("string"), F.lit(" and "), name)).otherwise(name).alias("span"))
    out = op.link_report(spans, "id", "span", keys, lambda rows: op.link_similar(rows, vectors, concepts, 0.3, 0.2, 0.02))
    return out.withColumn("skill_ids", F.array_join("skill_ids", ","))


@query("x6_link_exact_report", f"{_SPAN} SELECT id, coalesce(string_agg(skill_id, ',' ORDER BY k), '') AS skill_ids, count(skill_id) = 0 AS unlinked FROM (SELECT f.id, i.skill_id, min(k) AS k FROM {_FRAG} f LEFT JOIN {_INDEX} i ON i.key = f.norm GROUP BY f.id, i.skill_id) x GROUP BY id")
def x6_exact(t):
    return op.link_report(_spans(t), "id", "span", op.alias_index(_labels(t))).withColumn("skill_ids", F.array_join("skill_ids", ","))


@query("v4_link_decision", f"SELECT q, best >= 0.5 OR (best >= 0.25 AND best - second >= 0.05) AS linked FROM {_TOP2} x")
def v4(t):
    return _top2(t).select("q", M.link_decision(F.col("best"), F.col("second"), 0.5, 0.25, 0.05).alias("linked"))


# Scores lifted into the range of the sweep; some spans have no gold concept.
_SWEPT = f"(SELECT CASE WHEN q % 7 > 0 THEN label END AS gold, best_id, round(0.35 + best, 6) AS best, round(0.35 + second, 6) AS second FROM {_TOP2} x JOIN embeddings e ON e.vec_id = q)"


@query("e8_cutoff_sweep", f"""WITH g AS (SELECT a.v / 100.0::DOUBLE AS t, b.v / 100.0::DOUBLE AS m, c.v / 100.0::DOUBLE AS h FROM range(40, 96) a(v), range(0, 21) b(v), range(40, 99) c(v) WHERE c.v >= a.v),
r AS (SELECT gold IS NOT NULL AS known, gold IS NOT DISTINCT FROM best_id AS hit, best, best - second AS mg FROM {_SWEPT} s),
d AS (SELECT t, m, h, known, hit, best >= h OR (best >= t AND mg >= m) AS said, CASE WHEN best >= h OR (best >= t AND mg >= m) THEN greatest(best - h, least(best - t, mg - m)) ELSE least(h - best, greatest(t - best, m - mg)) END AS away FROM g, r),
s AS (SELECT t, m, h, count(*) FILTER (WHERE said AND hit) AS true_links, count(*) FILTER (WHERE said AND NOT hit) AS false_links, count(*) FILTER (WHERE NOT said AND known) AS missed,
  round(coalesce(min(away) FILTER (WHERE said = hit), 0), 6) AS safety FROM d GROUP BY t, m, h)
SELECT t AS threshold, m AS margin, h AS high, true_links, false_links, missed, safety, row_number() OVER (ORDER BY false_links, true_links DESC, safety DESC, t, m, h) AS place FROM s""")
def e8(t):
    of = t.embeddings.select(F.col("vec_id").alias("q"), F.when(F.col("vec_id") % 7 > 0, F.col("label")).alias("gold"))
    scores = _top2(t).join(of, "q").select("gold", "best_id", F.round(0.35 + F.col("best"), 6).alias("best"), F.round(0.35 + F.col("second"), 6).alias("second"))
    return op.sweep(scores)


@query("e7_link_prf", f"""SELECT coalesce(mention, 'all') AS mention, count(*) FILTER (WHERE said IS NOT NULL AND said IS NOT DISTINCT FROM gold) AS tp, count(*) FILTER (WHERE said IS NOT NULL AND said IS DISTINCT FROM gold) AS fp, count(*) FILTER (WHERE gold IS NOT NULL AND said IS DISTINCT FROM gold) AS fn
FROM (SELECT CASE WHEN q % 2 = 0 THEN 'explicit' ELSE 'implicit' END AS mention, CASE WHEN q % 7 > 0 THEN label END AS gold, CASE WHEN best >= 0.25 THEN best_id END AS said FROM {_TOP2} x JOIN embeddings e ON e.vec_id = q) y GROUP BY CUBE (mention)""")
def e7(t):
    rows = _top2(t).join(t.embeddings.select(F.col("vec_id").alias("q"), "label"), "q")
    return op.link_prf(rows.select(F.when(F.col("q") % 2 == 0, "explicit").otherwise("implicit").alias("mention"), F.when(F.col("q") % 7 > 0, F.col("label")).alias("gold"), F.when(F.col("best") >= 0.25, F.col("best_id")).alias("said")))


@query("j8_scan_terms", f"""SELECT doc_id, skill_id, term FROM (SELECT doc_id, ' ' || {norm('text')} || ' ' AS n FROM documents) d JOIN {{v_terms}} v ON contains(d.n, ' ' || v.term || ' ')""")
def j8(t):
    return op.scan_terms(t.documents, "doc_id", "text", t.v_terms)


@query("x8_link_or_scan", f"""WITH n AS (SELECT doc_id, text, ' ' || {norm('text')} || ' ' AS t FROM documents), w AS (SELECT DISTINCT doc_id, {norm('w')} AS w FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[\\s,/;]+')) AS w FROM documents)),
l AS (SELECT doc_id, string_agg(DISTINCT v.skill_id, ',' ORDER BY v.skill_id) AS ids FROM w JOIN {{v_terms}} v ON v.term = w.w GROUP BY doc_id),
h AS (SELECT doc_id, list_sort(list(DISTINCT v.skill_id)) AS ids FROM n JOIN {{v_terms}} v ON contains(n.t, ' ' || v.term || ' ') GROUP BY doc_id)
SELECT n.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'linked' WHEN h.doc_id IS NOT NULL THEN 'scanned' ELSE 'none' END AS how, coalesce(l.ids, array_to_string(h.ids, ','), '') AS skill_ids FROM n LEFT JOIN l USING (doc_id) LEFT JOIN h USING (doc_id)""")
def x8(t):
    each = t.documents.select("doc_id", F.explode_outer(F.array_distinct(F.split("text", r"[\s,/;]+", -1))).alias("span"))
    index = op.alias_index(t.v_terms.select("skill_id", F.lit(0).alias("ord"), F.array("term").alias("labels")))
    return op.link_or_scan(t.documents, "doc_id", "text", each, "span", index, t.v_terms).withColumn("skill_ids", F.array_join("skill_ids", ","))


@query("j9_first_form", f"""SELECT doc_id, CASE WHEN contains(n, ' und ') THEN 'Und' WHEN contains(n, ' of the ') THEN 'of the' WHEN contains(n, ' que ') THEN 'QUE' END AS form FROM (SELECT doc_id, ' ' || {norm('text')} || ' ' AS n FROM documents)""")
def j9(t):
    rows = t.documents.withColumn("forms", F.array(F.lit("Und"), F.lit("of the"), F.lit("QUE")))
    return op.first_form(rows, "doc_id", "text", "forms")


@query("j10_partition_for_embed", "SELECT skill_id, label, ord % 3 <> 0 AS needs FROM {v_taxonomy}")
def j10(t):
    old = t.v_taxonomy.select("skill_id", F.when(F.col("ord") % 3 == 0, "m1").otherwise("m0").alias("model"))
    return op.partition_for_embed(t.v_taxonomy, old, "m1")


@query("v6_ensure_vectors", "SELECT skill_id, ord % 4 = 0 AS embed FROM {v_taxonomy}")
def v6(t):
    return op.ensure_vectors(t.v_taxonomy.select("skill_id", F.when(F.col("ord") % 4 > 0, "m1").alias("model")), "m1")


_FEAT = f"""(SELECT doc_id, unnest(list_concat(list_filter(string_split(n, ' '), lambda x: x <> ''), list_transform(range(1, length(n) - 1), lambda k: '#' || substr(n, k, 3)))) AS f FROM (SELECT doc_id, {norm('text')} AS n FROM documents))"""


@query("v1_hash_embed", f"""WITH c AS (SELECT doc_id, cast('0x' || substr(md5(f), 1, 8) AS BIGINT) % 64 AS cell, sum(CASE WHEN cast('0x' || substr(md5(f), 9, 1) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS v FROM {_FEAT} x GROUP BY 1, 2)
SELECT doc_id, cell, round(v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)), 5) + 0 AS value FROM c""")
def v1(t):
    return op.hash_embed(t.documents, "doc_id", "text", 64).withColumn("value", F.round("value", 5) + 0.0)


@query("v2_l2", "SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: (x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) * (x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))))), 6) AS norm FROM embeddings")
def v2(t):
    return t.embeddings.select("vec_id", F.round(M.norm(M.l2(F.col("embedding"))) * M.norm(M.l2(F.col("embedding"))), 6).alias("norm"))


@query("v3_similarity", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) + 0 AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id // 2")
def v3(t):
    b = t.embeddings.select(F.col("vec_id").alias("v"), F.col("embedding").alias("e"))
    return t.embeddings.join(b, F.floor(F.col("vec_id") / 2) == F.col("v")).select("vec_id", (F.round(M.cosine(F.col("embedding"), F.col("e")), 5) + 0.0).alias("similarity"))


@query("p8_nfkc_label")
def p8b(t):
    from pairloom.functions import text as X
    return t.documents.select("doc_id", X.normalize_label(op.nfkc(F.col("text"), t.spark)).alias("label"))


@query("e9_spot_check", f"""{_SPAN}, pick AS (SELECT id FROM (SELECT {norm('span')} AS n, min(id) AS id FROM s GROUP BY 1) ORDER BY md5(n || ':7') LIMIT 40)
SELECT id, coalesce(string_agg(skill_id, ',' ORDER BY k), '') AS skill_ids, count(skill_id) = 0 AS unlinked FROM (SELECT f.id, i.skill_id, min(k) AS k FROM {_FRAG} f LEFT JOIN {_INDEX} i ON i.key = f.norm GROUP BY f.id, i.skill_id) x WHERE id IN (SELECT id FROM pick) GROUP BY id""")
def e9(t):
    sample = op.phrase_sample(_spans(t), "id", "span", 40, 7)  # the operator's own sample size
    return op.link_report(sample, "id", "span", op.alias_index(_labels(t))).withColumn("skill_ids", F.array_join("skill_ids", ","))
