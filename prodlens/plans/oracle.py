"""DuckDB SQL equal to each registered query of :mod:`prodlens.plans.catalog`.

The driver registers the test tables as views; every statement below
rebuilds the same stand-in inputs in SQL (``WITH`` clauses) and computes
the operator's result independently of Spark.
"""

from __future__ import annotations

from prodlens.functions.text import WS

# ---------------------------------------------------------------- fragments


def clean(x: str) -> str:
    s = "lower(coalesce(%s, ''))" % x
    s = "regexp_replace(%s, '<[^>]+>', '', 'g')" % s
    s = "regexp_replace(%s, '(http|www)[^%s]+', '', 'g')" % (s, WS)
    s = "regexp_replace(%s, '[^a-z0-9]+', ' ', 'g')" % s
    return "trim(%s)" % s


def strip(x: str) -> str:
    return "regexp_replace(%s, '^[%s]+|[%s]+$', '', 'g')" % (x, WS, WS)


def _url(kind: str) -> str:
    return "'http://img.example.com/%s/' || p_partkey::varchar || '.jpg'" % kind


REVIEWS = """reviews AS (
  SELECT l_orderkey * 10 + l_linenumber AS review_id, l_partkey::varchar AS parent_asin,
         l_returnflag AS title,
         'status ' || l_linestatus || ' qty ' || cast(trunc(l_quantity) AS integer)::varchar AS text,
         l_quantity / 10.0 AS rating, epoch_ms(l_shipdate) AS timestamp,
         l_linestatus = 'F' AS verified_purchase, l_linenumber AS helpful_vote
  FROM lineitem)"""

PRODUCTS = """products AS (
  SELECT p_partkey::varchar AS parent_asin, p_name AS title, [p_brand, p_type] AS description,
         p_type AS main_category,
         [struct_pack(hi_res := CASE WHEN p_size > 40 THEN %s END,
                      large := CASE WHEN p_size > 10 THEN %s
                                    ELSE 'ftp://img.example.com/large/' || p_partkey::varchar END,
                      thumb := CASE WHEN p_retailprice > 950 THEN %s END)] AS images
  FROM part)""" % (_url("hi_res"), _url("large"), _url("thumb"))

PRODUCTS_B = """products_b AS (
  SELECT p_partkey::varchar AS parent_asin, p_name AS title, [p_brand, p_type] AS description,
         p_type AS main_category,
         struct_pack(large := [CASE WHEN p_size > 25 THEN %s ELSE 'None' END],
                     hi_res := [CASE WHEN p_size > 5 THEN %s ELSE '' END]) AS images
  FROM part)""" % (_url("large"), _url("hi_res"))

FIRST_URL = ("list_filter(flatten(list_transform(images, lambda x: [x.hi_res, x.large, x.thumb])), "
             "lambda u: starts_with(u, 'http'))[1]")
FIRST_URL_B = ("list_filter(list_concat(coalesce(images.large, []), coalesce(images.hi_res, [])), "
               "lambda u: u IS NOT NULL AND u <> '' AND u <> 'None')[1]")

CMAP = """cmap AS (
  SELECT category, (row_number() OVER (ORDER BY category) - 1)::integer AS label
  FROM (SELECT DISTINCT lang AS category FROM documents WHERE lang IS NOT NULL))"""

ENCODED = CMAP + """,
encoded AS (
  SELECT d.doc_id, coalesce(m.label, -1)::integer AS label
  FROM documents d LEFT JOIN cmap m ON d.lang = m.category)"""


def split_sql(src: str, key: str, seed: int = 42) -> str:
    """Stratified 70/10/20 split of ``src(key, label)``: quotas by largest
    remainder, rows ordered by md5('<seed>:<key>')."""
    return """
quota_t AS (SELECT label, count(*) AS n_c FROM {src} GROUP BY label),
quota_t1 AS (SELECT *, sum(n_c) OVER () AS n FROM quota_t),
quota_t2 AS (SELECT *, (n + 4) // 5 AS tt FROM quota_t1),
quota_q1 AS (SELECT *, CASE WHEN n > 0 THEN (n_c * tt) // n ELSE 0 END AS b1,
                       CASE WHEN n > 0 THEN (n_c * tt) % n ELSE 0 END AS r1 FROM quota_t2),
quota_q2 AS (SELECT *, tt - sum(b1) OVER () AS x1,
                       row_number() OVER (ORDER BY r1 DESC, label) AS k1 FROM quota_q1),
quota_q3 AS (SELECT *, b1 + CASE WHEN k1 <= x1 THEN 1 ELSE 0 END AS test_c FROM quota_q2),
quota_q4 AS (SELECT *, n_c - test_c AS m_c, n - tt AS mm FROM quota_q3),
quota_q5 AS (SELECT *, (mm + 7) // 8 AS vv FROM quota_q4),
quota_q6 AS (SELECT *, CASE WHEN mm > 0 THEN (m_c * vv) // mm ELSE 0 END AS b2,
                       CASE WHEN mm > 0 THEN (m_c * vv) % mm ELSE 0 END AS r2 FROM quota_q5),
quota_q7 AS (SELECT *, vv - sum(b2) OVER () AS x2,
                       row_number() OVER (ORDER BY r2 DESC, label) AS k2 FROM quota_q6),
quota AS (SELECT label, test_c, b2 + CASE WHEN k2 <= x2 THEN 1 ELSE 0 END AS val_c FROM quota_q7),
ranked AS (SELECT s.*, row_number() OVER (PARTITION BY label
             ORDER BY md5('{seed}:' || {key}::varchar), {key}) AS rn FROM {src} s),
split AS (SELECT r.*, CASE WHEN rn <= test_c THEN 'test' WHEN rn <= test_c + val_c THEN 'val'
                           ELSE 'train' END AS split
          FROM ranked r JOIN quota q ON r.label IS NOT DISTINCT FROM q.label)""".format(
        src=src, key=key, seed=seed)


PREDS = """emb_x AS (
  SELECT vec_id, label, unnest(range(len(embedding))) AS pos, unnest(embedding)::double AS v
  FROM embeddings),
centroid AS (SELECT label AS cl, pos, avg(v) AS cv FROM emb_x GROUP BY label, pos),
logit AS (SELECT x.vec_id, c.cl, sum(x.v * c.cv) AS z FROM emb_x x JOIN centroid c ON x.pos = c.pos
          GROUP BY x.vec_id, c.cl),
soft AS (SELECT vec_id, cl, exp(z - max(z) OVER (PARTITION BY vec_id)) AS ez FROM logit),
prob AS (SELECT vec_id, cl, round(ez / sum(ez) OVER (PARTITION BY vec_id), 9) AS p FROM soft),
preds0 AS (SELECT e.vec_id AS key, e.label, list(p.p ORDER BY p.cl) AS probs
           FROM embeddings e JOIN prob p ON e.vec_id = p.vec_id GROUP BY e.vec_id, e.label),
preds AS (SELECT key, label, (list_position(probs, list_max(probs)) - 1)::integer AS prediction, probs
          FROM preds0)"""

STATS = """cc AS (SELECT label, prediction, count(*) AS n FROM preds GROUP BY label, prediction),
sup AS (SELECT label AS class, sum(n) AS support FROM cc GROUP BY label),
prd AS (SELECT prediction AS class, sum(n) AS predicted FROM cc GROUP BY prediction),
tpc AS (SELECT label AS class, n AS tp FROM cc WHERE label = prediction),
cls AS (SELECT class FROM sup UNION SELECT class FROM prd),
st AS (SELECT cls.class, coalesce(tp, 0) AS tp, coalesce(support, 0) AS support,
              coalesce(predicted, 0) AS predicted
       FROM cls LEFT JOIN sup USING (class) LEFT JOIN prd USING (class) LEFT JOIN tpc USING (class)),
pc AS (SELECT class, coalesce(tp / nullif(predicted, 0), 0) AS precision,
              coalesce(tp / nullif(support, 0), 0) AS recall,
              coalesce(2 * tp / nullif(support + predicted, 0), 0) AS f1, support, tp
       FROM st)"""

LENGTH_BAND = """band AS (SELECT doc_id, 'k' || (n_chars // 1000)::varchar AS category FROM documents)"""

MODEL_RESULTS = """results AS (
  SELECT event_type AS run_id, 'm' || user_id::varchar AS model,
         avg((value > 100)::integer) AS val_f1, avg((value > 150)::integer) AS test_f1
  FROM events GROUP BY event_type, user_id)"""

HISTORY = """history AS (
  SELECT event_type AS run_id, (date_diff('day', DATE '2024-01-01', ts::date) + 1)::integer AS epoch,
         1 - avg((value > 50)::integer) AS train_loss, avg((value > 20)::integer) AS train_acc,
         1 - avg((value > 80)::integer) AS val_loss, avg((value > 150)::integer) AS val_acc,
         avg((value > 100)::integer) AS val_f1
  FROM events GROUP BY ALL)"""


def _w(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


SQL: dict[str, str] = {}

# ---------------------------------------------------------------- text
SQL["clean_text"] = "SELECT doc_id, %s AS text FROM documents" % clean("text")
SQL["clean_html"] = "SELECT page_id, %s AS text FROM pages" % clean("html")
SQL["clean_conversations"] = "SELECT conv_id, turn, %s AS text FROM conversations" % clean("text")
SQL["review_text"] = ("SELECT doc_id, %s AS review_text FROM documents"
                      % strip("coalesce(source, '') || ' ' || coalesce(text, '')"))
SQL["strip"] = "SELECT conv_id, turn, %s AS text FROM conversations" % strip("text")
SQL["clean_pair"] = ("SELECT doc_id, %s || ' ' || %s AS text FROM documents"
                     % (clean("text"), clean("source")))
SQL["join_description"] = _w(PRODUCTS) + (
    "SELECT parent_asin, coalesce(array_to_string(description, ' '), '') AS description FROM products")
SQL["min_length"] = "SELECT conv_id, turn FROM conversations WHERE length(text) > 10"
SQL["drop_empty_text"] = ("SELECT conv_id, turn FROM conversations WHERE length(%s) > 0"
                          % clean("text"))

# ---------------------------------------------------------------- images / paths
SQL["first_image_url"] = _w(PRODUCTS) + "SELECT parent_asin, %s AS image_url FROM products" % FIRST_URL
SQL["first_image_url_by_size"] = _w(PRODUCTS_B) + (
    "SELECT parent_asin, %s AS image_url FROM products_b" % FIRST_URL_B)
SQL["image_path"] = _w(PRODUCTS) + (
    "SELECT parent_asin, 'data/images/' || parent_asin || '.jpg' AS image_path FROM products")
SQL["normalize_path"] = """
SELECT p_partkey,
       replace(replace(CASE WHEN p_size > 25 THEN 'data\\images\\' || p_partkey::varchar || '.jpg'
                            ELSE 'data/images/data/images/' || p_partkey::varchar || '.jpg' END,
                       '\\', '/'), 'data/images/data/images', 'data/images') AS path
FROM part"""

# ---------------------------------------------------------------- joins / assembly
SQL["join_products"] = _w(REVIEWS, PRODUCTS) + """
SELECT r.review_id, r.parent_asin, r.title AS title_review, p.title AS title_product, p.main_category,
       round(r.rating, 6) AS rating
FROM reviews r JOIN products p ON r.parent_asin = p.parent_asin"""

LATEST = """latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY parent_asin
                   ORDER BY timestamp DESC, review_id) AS rn
                 FROM reviews WHERE parent_asin IS NOT NULL) WHERE rn <= 5)"""
SQL["latest_per_key"] = _w(REVIEWS, LATEST) + "SELECT review_id, parent_asin, timestamp FROM latest"

SQL["build_dataset_full"] = _w(REVIEWS, PRODUCTS, """
r AS (SELECT review_id, parent_asin, rating,
             %s AS review_text FROM reviews)""" % strip("coalesce(title, '') || ' ' || coalesce(text, '')"),
    """p AS (SELECT parent_asin, coalesce(title, '') AS product_title,
             coalesce(array_to_string(description, ' '), '') AS product_description,
             coalesce(main_category, 'Unknown') AS category, %s AS image_url FROM products)""" % FIRST_URL,
    """j AS (SELECT r.review_id, %s AS text, p.category, r.parent_asin, r.rating, p.image_url
             FROM r JOIN p ON r.parent_asin = p.parent_asin)""" % strip(
        "p.product_title || ' ' || p.product_description || ' ' || r.review_text")) + """
SELECT review_id, text, category, parent_asin, round(rating, 6) AS rating, image_url
FROM j WHERE length(text) > 10"""
SQL["build_dataset"] = SQL["build_dataset_full"] + "\nORDER BY md5('42:' || review_id::varchar), review_id LIMIT 10000"

SQL["publish_dataset"] = "WITH built AS (%s),\ncodes AS (SELECT category, row_number() OVER (ORDER BY category) - 1 AS label " \
    "FROM (SELECT DISTINCT category FROM built))\nSELECT built.*, codes.label::integer AS label FROM built JOIN codes USING (category)" % SQL["build_dataset_full"]

SQL["build_training_table"] = _w(REVIEWS, PRODUCTS_B, LATEST, """
r AS (SELECT review_id, parent_asin, title AS title_review, rating, verified_purchase, helpful_vote,
             %s AS review_text FROM latest)""" % strip("coalesce(title, '') || ' ' || coalesce(text, '')"),
    """p AS (SELECT parent_asin, title AS title_product, description, main_category,
             CASE WHEN %s IS NOT NULL THEN 'data/images/' || parent_asin || '.jpg' END AS image_path
             FROM products_b)""" % FIRST_URL_B,
    """j AS (SELECT r.review_id, %s AS text, p.main_category AS category, r.parent_asin, p.image_path,
                    r.rating, r.verified_purchase, r.helpful_vote
             FROM r JOIN p ON r.parent_asin = p.parent_asin)""" % strip(
        "coalesce(p.title_product, '') || ' ' || coalesce(array_to_string(p.description, ' '), '') "
        "|| ' ' || coalesce(r.review_text, '')")) + """
SELECT review_id, text, category, parent_asin, image_path, round(rating, 6) AS rating,
       verified_purchase, helpful_vote
FROM j WHERE image_path IS NOT NULL"""

# ---------------------------------------------------------------- labels / classes
SQL["category_map"] = _w(CMAP) + "SELECT category, label FROM cmap"
SQL["encode_labels"] = _w(ENCODED) + "SELECT doc_id, label FROM encoded"
SQL["class_distribution"] = ("SELECT lang AS category, count(*) AS n FROM documents "
                             "WHERE lang IS NOT NULL GROUP BY lang")
SQL["top_classes"] = ("SELECT source AS category, count(*) AS n FROM documents WHERE source IS NOT NULL "
                      "GROUP BY source ORDER BY n DESC, category LIMIT 5")
SQL["class_count"] = "SELECT count(DISTINCT lang) AS n_classes FROM documents"
SQL["rare_classes"] = _w(LENGTH_BAND) + (
    "SELECT category, count(*) AS n FROM band WHERE category IS NOT NULL "
    "GROUP BY category HAVING count(*) < 2")
SQL["drop_rare_classes"] = _w(LENGTH_BAND) + """
SELECT doc_id, category FROM band
WHERE category IN (SELECT category FROM band WHERE category IS NOT NULL
                   GROUP BY category HAVING count(*) >= 2)"""
SQL["class_weights"] = _w(ENCODED, """
cnt AS (SELECT label, count(*) AS nc FROM encoded GROUP BY label)""",
    """w AS (SELECT label, (sum(nc) OVER ())::double / ((count(*) OVER ()) * nc) AS w FROM cnt)""") + """
SELECT r.range::integer AS label, round(coalesce(w.w, 1.0), 6) AS weight
FROM range(6) r LEFT JOIN w ON r.range = w.label"""
SQL["stratified_split"] = _w(ENCODED + "," + split_sql("encoded", "doc_id")) + (
    "SELECT doc_id, label, split FROM split")
SQL["split_sizes"] = _w(ENCODED + "," + split_sql("encoded", "doc_id")) + (
    "SELECT split, count(*) AS n FROM split GROUP BY split")
SQL["sample_n"] = ("SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id::varchar), doc_id "
                   "LIMIT 100")

# ---------------------------------------------------------------- scores
SQL["softmax"] = _w(PREDS) + (
    "SELECT key, prediction, round(list_max(probs), 6) AS p_max, round(list_sum(probs), 6) AS p_sum "
    "FROM preds")
SQL["uncertainty"] = _w(PREDS) + """
SELECT key,
       round(CASE WHEN list_sum(probs) > 0 THEN list_sum(list_transform(probs, lambda x:
             CASE WHEN x / list_sum(probs) > 0 THEN -(x / list_sum(probs)) * ln(x / list_sum(probs))
                  ELSE 0 END)) END, 6) AS entropy,
       round(CASE WHEN len(probs) >= 2 THEN -(list_sort(probs, 'DESC')[1] - list_sort(probs, 'DESC')[2])
             END, 6) AS margin,
       round(1 - list_max(probs), 6) AS least_confidence
FROM preds"""

# ---------------------------------------------------------------- evaluation
SQL["metrics"] = _w(PREDS, STATS) + """
SELECT round(sum(tp) / sum(support), 6) AS accuracy,
       round(sum(precision * support) / sum(support), 6) AS precision,
       round(sum(recall * support) / sum(support), 6) AS recall,
       round(sum(f1 * support) / sum(support), 6) AS f1,
       sum(support)::bigint AS n
FROM pc"""
SQL["metrics_macro"] = _w(PREDS, STATS) + """
SELECT round(sum(tp) / sum(support), 6) AS accuracy, round(avg(precision), 6) AS precision,
       round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1, sum(support)::bigint AS n
FROM pc"""
SQL["per_class_metrics"] = _w(PREDS, STATS) + """
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       support::bigint AS support
FROM pc"""
SQL["f1_bands"] = _w(PREDS, STATS) + """
SELECT class, round(f1, 6) AS f1,
       CASE WHEN f1 < 0.5 THEN 'low' WHEN f1 < 0.7 THEN 'medium' ELSE 'high' END AS band
FROM pc"""
SQL["top_classes_by_f1"] = _w(PREDS, STATS) + """
SELECT class, round(f1, 6) AS f1, support::bigint AS support FROM pc ORDER BY pc.f1 DESC, class LIMIT 5"""
CONF = """grid AS (SELECT a.class AS label, b.class AS prediction FROM cls a, cls b),
conf AS (SELECT g.label, g.prediction, coalesce(cc.n, 0)::bigint AS n
         FROM grid g LEFT JOIN cc ON g.label = cc.label AND g.prediction = cc.prediction)"""
SQL["confusion_matrix"] = _w(PREDS, STATS, CONF) + "SELECT label, prediction, n FROM conf"
SQL["confusion_matrix_normalized"] = _w(PREDS, STATS, CONF) + """
SELECT label, prediction, round(n::double / nullif(sum(n) OVER (PARTITION BY label), 0), 6) AS share
FROM conf"""
SQL["classification_report"] = _w(PREDS, STATS) + """
SELECT class::varchar AS class, round(precision, 4) AS precision, round(recall, 4) AS recall,
       round(f1, 4) AS f1, support::bigint AS support FROM pc
UNION ALL
SELECT 'accuracy', NULL, NULL, round(sum(recall * support) / sum(support), 4), sum(support)::bigint FROM pc
UNION ALL
SELECT 'macro avg', round(avg(precision), 4), round(avg(recall), 4), round(avg(f1), 4),
       sum(support)::bigint FROM pc
UNION ALL
SELECT 'weighted avg', round(sum(precision * support) / sum(support), 4),
       round(sum(recall * support) / sum(support), 4), round(sum(f1 * support) / sum(support), 4),
       sum(support)::bigint FROM pc"""
SQL["auc_binary"] = """
WITH b AS (SELECT l.toxic AS y, floor(d.n_chars / 2000) / (floor(d.n_chars / 2000) + 20.0) AS s
           FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
g AS (SELECT s, sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS p, sum(CASE WHEN y = 1 THEN 0 ELSE 1 END) AS q
      FROM b GROUP BY s),
c AS (SELECT *, coalesce(sum(q) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                AS below FROM g)
SELECT round(sum(p * (below + 0.5 * q)) / (sum(p) * sum(q)), 6) AS auc FROM c"""
SQL["auc_multiclass"] = _w(PREDS, """
cl AS (SELECT label, (row_number() OVER (ORDER BY label) - 1) AS j FROM (SELECT DISTINCT label FROM preds))""",
    """x AS (SELECT label AS y, unnest(range(len(probs))) AS j, unnest(probs) AS s FROM preds)""",
    """g AS (SELECT x.j, x.s, sum(CASE WHEN x.y = cl.label THEN 1 ELSE 0 END) AS p,
                 sum(CASE WHEN x.y = cl.label THEN 0 ELSE 1 END) AS q
          FROM x JOIN cl ON x.j = cl.j GROUP BY x.j, x.s)""",
    """c AS (SELECT *, coalesce(sum(q) OVER (PARTITION BY j ORDER BY s
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)""",
    """per AS (SELECT j, sum(p * (below + 0.5 * q)) / (sum(p) * sum(q)) AS a, sum(p) AS pp
            FROM c GROUP BY j)""") + "SELECT round(sum(a * pp) / sum(pp), 6) AS auc FROM per"
SQL["log_loss"] = _w(PREDS, """
cnt AS (SELECT label, count(*) AS nc FROM preds GROUP BY label)""",
    """w AS (SELECT label, (sum(nc) OVER ())::double / ((count(*) OVER ()) * nc) AS w FROM cnt)""") + """
SELECT round(sum(coalesce(w.w, 1.0) * -ln(p.probs[p.label + 1])) / sum(coalesce(w.w, 1.0)), 6) AS loss
FROM preds p LEFT JOIN w ON p.label = w.label"""
SQL["compare_models"] = _w(MODEL_RESULTS) + """
SELECT run_id, model, round(val_f1, 6) AS val_f1,
       (rank() OVER (PARTITION BY run_id ORDER BY val_f1 DESC))::integer AS rank,
       row_number() OVER (PARTITION BY run_id ORDER BY val_f1 DESC, model) = 1 AS is_best
FROM results"""
SQL["best_model"] = _w(MODEL_RESULTS) + """
SELECT run_id, model, round(val_f1, 6) AS val_f1 FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY val_f1 DESC, model) AS r FROM results)
WHERE r = 1"""

# ---------------------------------------------------------------- jobs


def prepared_sql(text: str) -> str:
    return CMAP + """,
cleaned AS (SELECT d.doc_id, d.lang AS category, %s AS text, coalesce(m.label, -1)::integer AS label
            FROM documents d LEFT JOIN cmap m ON d.lang = m.category),
kept AS (SELECT * FROM cleaned WHERE length(text) > 0
          AND category IN (SELECT category FROM cleaned WHERE length(text) > 0
                           AND category IS NOT NULL GROUP BY category HAVING count(*) >= 2)),""" % text \
        + split_sql("kept", "doc_id") + """,
prepared AS (SELECT doc_id, text, label, split FROM split)"""


PREPARED = prepared_sql(clean("d.text"))
SQL["prepare"] = _w(PREPARED) + "SELECT doc_id, text, label, split FROM prepared"
SQL["prepare_raw"] = (_w(prepared_sql("%s || ' ' || %s" % (clean("d.text"), clean("d.source"))))
                      + "SELECT doc_id, text, label, split FROM prepared")
SQL["select_uncertain_large"] = """
SELECT l_orderkey * 10 + l_linenumber AS key, round(l_discount, 6) AS uncertainty FROM lineitem
ORDER BY l_discount DESC, key LIMIT 30000"""


def tokens_sql(text: str) -> str:
    return "list_filter(string_split(%s, ' '), lambda t: length(t) >= 2)" % text


TERMS = ("list_concat(tok, CASE WHEN len(tok) >= 2 THEN list_transform(range(1, len(tok)), "
         "lambda i: tok[i] || ' ' || tok[i + 1]) ELSE [] END)")

TFIDF = """toks AS (SELECT doc_id, %s AS tok FROM prepared),
grams AS (SELECT doc_id, %s AS terms FROM toks),
tf_all AS (SELECT doc_id, term, count(*) AS tf
           FROM (SELECT doc_id, unnest(terms) AS term FROM grams) GROUP BY doc_id, term),
ndocs AS (SELECT count(*) AS n FROM prepared WHERE split = 'train'),
dfs AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf_all
        WHERE doc_id IN (SELECT doc_id FROM prepared WHERE split = 'train') GROUP BY term),
kept_terms AS (SELECT dfs.* FROM dfs, ndocs WHERE df >= 2 AND df <= 0.95 * n
               ORDER BY cf DESC, term LIMIT 10000),
vocab AS (SELECT term, (row_number() OVER (ORDER BY term) - 1)::integer AS idx, df::bigint AS df,
                 ln((1 + n) / (df + 1.0)) + 1 AS idf FROM kept_terms, ndocs),
wraw AS (SELECT t.doc_id, t.term, v.idx, t.tf * v.idf AS w FROM tf_all t JOIN vocab v ON t.term = v.term),
weights AS (SELECT doc_id, term, idx, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight
            FROM wraw)""" % (tokens_sql("text"), TERMS)

CLEAN_DOCS = "cdocs AS (SELECT doc_id, %s AS text FROM documents)" % clean("text")

SQL["tokens"] = _w(CLEAN_DOCS, "toks AS (SELECT doc_id, %s AS tok FROM cdocs)" % tokens_sql("text"),
                   "grams AS (SELECT doc_id, tok, %s AS terms FROM toks)" % TERMS) + """
SELECT doc_id, len(tok)::integer AS n_tokens, len(terms)::integer AS n_terms,
       md5(array_to_string(terms, '|')) AS terms_md5 FROM grams"""

VOCAB_IDS = """wc AS (SELECT term, count(*) AS n FROM (SELECT unnest(%s) AS term FROM cdocs)
                GROUP BY term ORDER BY n DESC, term LIMIT 30000),
vocab_ids AS (SELECT term, (row_number() OVER (ORDER BY n DESC, term) + 3)::integer AS id, n FROM wc)""" % (
    tokens_sql("text"))

SQL["build_vocab"] = _w(CLEAN_DOCS, VOCAB_IDS) + "SELECT term, id, n FROM vocab_ids"
SQL["encode_fixed"] = _w(CLEAN_DOCS, VOCAB_IDS, """
etok AS (SELECT doc_id, (%s)[1:126] AS tok FROM cdocs)""" % tokens_sql("text"),
    """epos AS (SELECT doc_id, unnest(range(len(tok))) AS p, unnest(tok) AS term FROM etok)""",
    """eids AS (SELECT e.doc_id, list(coalesce(v.id, 1) ORDER BY e.p) AS w
             FROM epos e LEFT JOIN vocab_ids v ON e.term = v.term GROUP BY e.doc_id)""",
    """seq AS (SELECT c.doc_id, list_concat([2], coalesce(i.w, []), [3]) AS s
            FROM cdocs c LEFT JOIN eids i ON c.doc_id = i.doc_id)""") + """
SELECT doc_id, len(s)::integer AS n_real,
       md5(array_to_string(list_concat(s, list_transform(range(128 - len(s)), lambda x: 0)), ',')) AS ids_md5
FROM seq"""

SQL["fit_tfidf"] = _w(PREPARED, TFIDF) + "SELECT term, idx, df, round(idf, 6) AS idf FROM vocab"
SQL["tfidf"] = _w(PREPARED, TFIDF) + "SELECT doc_id, term, idx, round(weight, 6) AS weight FROM weights"
SQL["feature_summary"] = _w(PREPARED, TFIDF) + """
SELECT (SELECT count(DISTINCT doc_id) FROM weights) AS n_rows, (SELECT count(*) FROM weights) AS nnz,
       (SELECT count(*) FROM vocab) AS vocab_size"""
SQL["naive_bayes"] = _w(PREPARED, TFIDF, """
nct AS (SELECT p.label, w.term, sum(w.weight) AS n_ct FROM weights w JOIN prepared p ON w.doc_id = p.doc_id
        WHERE p.split = 'train' GROUP BY p.label, w.term)""",
    """ncls AS (SELECT label, count(*) AS n_docs FROM prepared WHERE split = 'train' GROUP BY label)""",
    """nc AS (SELECT label, sum(n_ct) AS n_c FROM nct GROUP BY label)""",
    """den AS (SELECT c.label, ln(coalesce(nc.n_c, 0) + 1.0 * (SELECT count(*) FROM vocab)) AS ld,
                   ln(c.n_docs / (sum(c.n_docs) OVER ())) AS prior
            FROM ncls c LEFT JOIN nc ON c.label = nc.label)""",
    """lp AS (SELECT d.label, v.term, ln(coalesce(nct.n_ct, 0) + 1.0) - d.ld AS lp
           FROM den d CROSS JOIN vocab v LEFT JOIN nct ON nct.label = d.label AND nct.term = v.term)""",
    """sc AS (SELECT p.doc_id, d.label, d.prior + coalesce(sum(w.weight * lp.lp), 0) AS score
           FROM prepared p CROSS JOIN den d LEFT JOIN weights w ON w.doc_id = p.doc_id
           LEFT JOIN lp ON lp.label = d.label AND lp.term = w.term
           GROUP BY p.doc_id, d.label, d.prior)""") + """
SELECT doc_id, label AS prediction, round(score, 6) AS log_prob FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label) AS r FROM sc) WHERE r = 1"""

# ---------------------------------------------------------------- active learning
ENTROPY = """CASE WHEN list_sum(probs) > 0 THEN list_sum(list_transform(probs, lambda x:
             CASE WHEN x / list_sum(probs) > 0 THEN -(x / list_sum(probs)) * ln(x / list_sum(probs))
                  ELSE 0 END)) END"""
MARGIN = "CASE WHEN len(probs) >= 2 THEN -(list_sort(probs, 'DESC')[1] - list_sort(probs, 'DESC')[2]) END"
LEAST_CONF = "1 - list_max(probs)"
SCORED = "scored AS (SELECT key, %s AS uncertainty FROM preds)" % ENTROPY

for _name, _expr in (("entropy", ENTROPY), ("margin", MARGIN), ("least_confidence", LEAST_CONF)):
    SQL["select_" + _name] = _w(PREDS) + """
SELECT key, round(u, 6) AS uncertainty FROM (SELECT key, %s AS u FROM preds)
ORDER BY u DESC NULLS LAST, key LIMIT 50""" % _expr

SQL["select_random"] = _w(PREDS) + "SELECT key FROM preds ORDER BY md5('42:' || key::varchar), key LIMIT 50"

POOL = """train_docs AS (SELECT doc_id, label FROM prepared WHERE split = 'train'),
labelled AS (SELECT doc_id FROM train_docs ORDER BY md5('42:' || doc_id::varchar), doc_id
             LIMIT (SELECT count(*) // 10 FROM train_docs)),
pool AS (SELECT doc_id FROM train_docs WHERE doc_id NOT IN (SELECT doc_id FROM labelled))"""
SQL["split_pool"] = _w(PREPARED, POOL) + """
SELECT doc_id, 'labelled' AS part FROM labelled UNION ALL SELECT doc_id, 'pool' AS part FROM pool"""
SQL["move_selected"] = _w(PREPARED, POOL, """
sel AS (SELECT doc_id FROM pool ORDER BY md5('1:' || doc_id::varchar), doc_id LIMIT 50)""") + """
SELECT doc_id, 'labelled' AS part FROM labelled
UNION ALL SELECT doc_id, 'labelled' AS part FROM pool WHERE doc_id IN (SELECT doc_id FROM sel)
UNION ALL SELECT doc_id, 'pool' AS part FROM pool WHERE doc_id NOT IN (SELECT doc_id FROM sel)"""
SQL["sample_classes"] = """
WITH cls AS (SELECT source FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)
             ORDER BY md5('42:' || source), source LIMIT 5)
SELECT doc_id, source FROM documents WHERE source IN (SELECT source FROM cls)"""

# ---------------------------------------------------------------- series
EARLY = """h1 AS (SELECT *, greatest(coalesce(max(val_f1) OVER (PARTITION BY run_id ORDER BY epoch
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0), 0.0) AS best_before,
             row_number() OVER (PARTITION BY run_id ORDER BY epoch) AS pos FROM history),
h2 AS (SELECT *, val_f1 > best_before AS improved, greatest(best_before, val_f1) AS best_so_far FROM h1),
h3 AS (SELECT *, (pos - coalesce(max(CASE WHEN improved THEN pos END) OVER (PARTITION BY run_id ORDER BY epoch
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0))::integer AS since_best FROM h2),
h4 AS (SELECT *, min(CASE WHEN since_best >= 3 THEN pos END) OVER (PARTITION BY run_id) AS stop_pos FROM h3),
trained AS (SELECT *, coalesce(pos = stop_pos, false) AS stopped FROM h4
            WHERE stop_pos IS NULL OR pos <= stop_pos)"""
SQL["early_stop"] = _w(HISTORY, EARLY) + """
SELECT run_id, epoch, improved, since_best, stopped, round(best_so_far, 6) AS best_so_far FROM trained"""
SQL["best_epoch"] = _w(HISTORY, EARLY) + """
SELECT run_id, max(CASE WHEN improved THEN epoch END) AS best_epoch,
       round(max(CASE WHEN improved THEN val_f1 END), 6) AS best_score,
       max(CASE WHEN stopped THEN epoch END) AS stop_epoch, count(*) AS n_epochs
FROM trained GROUP BY run_id"""
SQL["history_series"] = _w(HISTORY) + """
SELECT run_id, epoch AS step, metric, round(value, 6) AS value FROM (
  UNPIVOT (SELECT run_id, epoch, train_loss::double AS train_loss, train_acc::double AS train_acc,
                  val_loss::double AS val_loss, val_acc::double AS val_acc, val_f1::double AS val_f1
           FROM history)
  ON train_loss, train_acc, val_loss, val_acc, val_f1 INTO NAME metric VALUE value)"""
SQL["uncertainty_summary"] = _w(PREDS, SCORED) + """
SELECT round(avg(uncertainty), 6) AS mean, round(stddev_pop(uncertainty), 6) AS std,
       round(median(uncertainty), 6) AS median, round(min(uncertainty), 6) AS min,
       round(max(uncertainty), 6) AS max FROM scored"""
SQL["uncertainty_histogram"] = _w(PREDS, SCORED, """
rng AS (SELECT min(uncertainty) AS lo, max(uncertainty) AS hi FROM scored)""",
    """b AS (SELECT CASE WHEN hi - lo > 0 THEN least(floor((uncertainty - lo) / (hi - lo) * 50) + 1, 50)
                    ELSE 1 END AS bin FROM scored, rng WHERE uncertainty IS NOT NULL)""",
    """cnt AS (SELECT bin, count(*) AS n FROM b GROUP BY bin)""") + """
SELECT g.range::integer AS bin, round(lo + (g.range - 1) * ((hi - lo) / 50), 6) AS lo,
       round(lo + g.range * ((hi - lo) / 50), 6) AS hi, coalesce(cnt.n, 0)::bigint AS n
FROM range(1, 51) g CROSS JOIN rng LEFT JOIN cnt ON cnt.bin = g.range"""
SQL["selection_threshold"] = _w(PREDS, SCORED) + """
SELECT round(min(uncertainty), 6) AS threshold FROM (
  SELECT uncertainty FROM scored WHERE uncertainty IS NOT NULL
  ORDER BY uncertainty DESC, key LIMIT 50)"""

# ---------------------------------------------------------------- fusion
FUSED = """ex AS (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding)::double AS x FROM embeddings),
ey AS (SELECT vec_id, i, x * x AS x FROM ex
       WHERE i < 32 AND vec_id IN (SELECT vec_id FROM embeddings WHERE label <> 3))"""
SQL["fuse_concat"] = _w(FUSED) + """
SELECT vec_id, i::integer AS j, round(x, 6) AS value FROM ex
UNION ALL
SELECT e.vec_id, (64 + r.range)::integer, round(coalesce(ey.x, 0.0), 6)
FROM embeddings e CROSS JOIN range(32) r LEFT JOIN ey ON ey.vec_id = e.vec_id AND ey.i = r.range"""
SQL["fuse_add"] = _w(FUSED, """
wt AS (SELECT range // 8 AS i, range % 8 AS j, sin((range // 8) * 7 + (range % 8) * 3) / 8.0 AS w
       FROM range(512))""", """
wi AS (SELECT range // 8 AS i, range % 8 AS j, cos((range // 8) * 5 + (range % 8) * 11) / 8.0 AS w
       FROM range(256))""", """
pt AS (SELECT vec_id, j, sum(x * w) AS v FROM ex JOIN wt ON ex.i = wt.i GROUP BY vec_id, j)""", """
pi AS (SELECT vec_id, j, sum(x * w) AS v FROM ey JOIN wi ON ey.i = wi.i GROUP BY vec_id, j)""") + """
SELECT pt.vec_id, pt.j::integer AS j, round(pt.v + coalesce(pi.v, 0.0), 6) AS value
FROM pt LEFT JOIN pi ON pt.vec_id = pi.vec_id AND pt.j = pi.j"""

# sin(7i + 3j) and cos(5i + 11j) are taken apart, so a row needs four sums instead of 2048 x 512 products
SQL["fuse_add_wide"] = """
WITH t AS (SELECT vec_id, label, unnest(range(768)) AS i, embedding AS e FROM embeddings),
ts AS (SELECT vec_id, sum(e[i % len(e) + 1]::double * cos(i * 0.5) * sin(i * 7)) AS s,
              sum(e[i % len(e) + 1]::double * cos(i * 0.5) * cos(i * 7)) AS c FROM t GROUP BY vec_id),
m AS (SELECT vec_id, unnest(range(2048)) AS i, embedding AS e FROM embeddings WHERE label <> 3),
ms AS (SELECT vec_id, sum(e[i % len(e) + 1]::double * sin(i * 0.25) * sin(i * 5)) AS s,
              sum(e[i % len(e) + 1]::double * sin(i * 0.25) * cos(i * 5)) AS c FROM m GROUP BY vec_id)
SELECT ts.vec_id, r.range::integer AS j,
       round((ts.s * cos(r.range * 3) + ts.c * sin(r.range * 3)) / 8.0
             + coalesce((ms.c * cos(r.range * 11) - ms.s * sin(r.range * 11)) / 8.0, 0.0), 6) AS value
FROM ts LEFT JOIN ms ON ms.vec_id = ts.vec_id CROSS JOIN range(512) r"""

# ---------------------------------------------------------------- coverage
DOC_STATUS = """st_docs AS (SELECT doc_id, CASE WHEN n_chars >= 100 THEN 'data/images/' || doc_id::varchar || '.jpg'
                                    END AS image_path FROM documents),
st_files AS (SELECT DISTINCT 'data/images/' || doc_id::varchar || '.jpg' AS fp FROM labels),
status AS (SELECT d.doc_id, CASE WHEN d.image_path IS NULL THEN 'missing_path'
                                 WHEN f.fp IS NULL THEN 'missing_file' ELSE 'valid' END AS status
           FROM st_docs d LEFT JOIN st_files f ON d.image_path = f.fp)"""
SQL["with_file_status"] = _w(DOC_STATUS) + "SELECT doc_id, status FROM status"
SQL["coverage_report"] = _w(DOC_STATUS) + """
SELECT count(*) AS total, count_if(status = 'missing_path') AS missing_path,
       count_if(status = 'missing_file') AS missing_file, count_if(status = 'valid') AS valid,
       CASE WHEN count_if(status = 'valid') = 0 THEN 'none'
            WHEN count_if(status = 'valid') < count(*) THEN 'partial' ELSE 'all' END AS verdict
FROM status"""

# ---------------------------------------------------------------- sources
SQL["parse_jsonl"] = """
SELECT event_id, try_cast(json_extract(props, '$.k') AS INTEGER) AS k FROM events WHERE json_valid(props)"""

# ---------------------------------------------------------------- embedding
_M = [pow(48271, 42 + j, 2147483647) for j in range(3)]
SQL["embed"] = _w(CLEAN_DOCS, """
ch AS (SELECT doc_id, list_transform(string_split(text, ''), lambda c: unicode(c)::bigint) AS c
       FROM cdocs WHERE length(text) >= 3)""", """
gram AS (SELECT doc_id, unnest(list_transform(range(1, len(c) - 1),
                lambda i: (c[i] * %d + c[i + 1] * %d + c[i + 2] * %d) %% 2147483647)) AS h FROM ch)""" % tuple(_M), """
bucket AS (SELECT doc_id, h % 64 AS j, sum(1 - 2 * (h // 64 % 2))::double AS v FROM gram GROUP BY ALL)""", """
norm AS (SELECT doc_id, sqrt(sum(v * v)) AS z FROM bucket GROUP BY doc_id)""") + """
SELECT d.doc_id, r.range::integer AS j,
       round(CASE WHEN z > 0 THEN coalesce(b.v, 0.0) / z ELSE 0.0 END, 6) AS value
FROM cdocs d CROSS JOIN range(64) r LEFT JOIN norm ON norm.doc_id = d.doc_id
LEFT JOIN bucket b ON b.doc_id = d.doc_id AND b.j = r.range"""
