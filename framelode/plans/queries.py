"""Each operator as a query over the given tables, with the SQL that it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import align, frames, fusion, models, search, temporal, text, vectors
from ..sources import stored, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(c: str | Column) -> Column:
    return F.round(c, 6)


# ---------------------------------------------------------------- vectors


def _frames(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "embeddings").select(F.col("vec_id").alias("faiss_id"), "embedding", F.col("label").cast("bigint").alias("video_id"))


def _asked(rows: DataFrame) -> DataFrame:
    """Every row whose id is divisible by 100 is a query."""
    return rows.where("faiss_id % 100 = 0").select(F.col("faiss_id").alias("query_id"), F.col("embedding").alias("qvec"))


def _knn_sql(where: str = "TRUE", k: int = 10, of: str = "embedding", ctes: str = "") -> str:
    return f"""{ctes or 'WITH'} q AS (SELECT vec_id AS query_id, {of}::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT q.query_id, e.vec_id AS faiss_id, CAST(e.label AS BIGINT) AS video_id, list_dot_product(q.qv, e.{of}::DOUBLE[]) AS score
      FROM q CROSS JOIN embeddings e WHERE {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, faiss_id) AS rank FROM s)
SELECT query_id, rank, faiss_id, video_id, round(score, 6) AS score FROM r WHERE rank <= {k}"""


def _hits(found: DataFrame, rows: DataFrame) -> DataFrame:
    return vectors.with_metadata(found, rows.select("faiss_id", "video_id")).select("query_id", "rank", "faiss_id", "video_id", r6("score").alias("score"))


@query(_knn_sql())
def knn_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = _frames(spark, d)
    return _hits(vectors.knn(_asked(rows), rows, 10), rows)


@query("""WITH q AS (SELECT b.vec_id AS query_id, b.embedding::DOUBLE[] AS v FROM embeddings b WHERE b.vec_id % 100 = 0),
n AS (SELECT query_id, list_transform(v, lambda x: x / (sqrt(list_dot_product(v, v)) + 1e-8)) AS qv FROM q),
s AS (SELECT n.query_id, e.vec_id AS faiss_id, CAST(e.label AS BIGINT) AS video_id, list_dot_product(n.qv, e.embedding::DOUBLE[]) AS score FROM n CROSS JOIN embeddings e),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, faiss_id) AS rank FROM s)
SELECT query_id, rank - 1 AS id, faiss_id, video_id, round(score, 6) AS score FROM r WHERE rank <= 10""")
def knn_by_id(spark: SparkSession, d: str) -> DataFrame:
    rows = _frames(spark, d)
    ids = rows.where("faiss_id % 100 = 0").select(F.col("faiss_id").alias("query_id"))
    asked = vectors.queries_by_id(ids, rows).withColumn("qvec", C.l2_normalized(F.col("qvec"), 1e-8))
    found = vectors.with_metadata(vectors.knn(asked, rows, 10), rows.select("faiss_id", "video_id"))
    return vectors.dense_numbers(found).select("query_id", "id", "faiss_id", "video_id", r6("score").alias("score"))


@query(_knn_sql("e.vec_id IN (SELECT doc_id FROM labels WHERE quality = 1)"))
def knn_id_subset(spark: SparkSession, d: str) -> DataFrame:
    rows = _frames(spark, d)
    subset = t(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("faiss_id"))
    return _hits(vectors.knn_in_subset(_asked(rows), rows, subset, 10), rows)


@query(_knn_sql("e.label = 3"))
def knn_label_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = _frames(spark, d)
    return _hits(vectors.knn(_asked(rows), rows.where("video_id = 3"), 10), rows)


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
SELECT vec_id AS faiss_id, round(sqrt(list_dot_product(v, v)), 6) AS norm, CAST(len(v) AS BIGINT) AS dim,
       round(list_sum(list_transform(v, lambda x, i: i * x)) / sqrt(list_dot_product(v, v)), 5) AS weighted
FROM e""")
def l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    unit = _frames(spark, d).withColumn("u", C.l2_normalized(F.col("embedding")))
    weighted = F.aggregate(F.transform("u", lambda x, i: (i + 1) * x), F.lit(0.0), lambda a, x: a + x)
    return unit.select("faiss_id", r6(C.norm(F.col("embedding"))).alias("norm"), F.size("u").cast("bigint").alias("dim"), F.round(weighted, 5).alias("weighted"))


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
SELECT vec_id AS faiss_id, len(v) = 64 AS fits, CAST(CASE WHEN len(v) = 64 THEN len(v) ELSE 768 END AS BIGINT) AS dim FROM e""")
def vector_batch_validation(spark: SparkSession, d: str) -> DataFrame:
    rows = _frames(spark, d)
    fixed = F.when(F.size("embedding") == 64, F.col("embedding")).otherwise(C.vector_or_zero(F.col("embedding"), 768))
    return rows.select("faiss_id", tables.vectors_fit({"embedding": 64}).alias("fits"), F.size(fixed).cast("bigint").alias("dim"))


_TWO_SPACES = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, x.vec_id AS id, l.n AS list_no, list_dot_product(q.e[l.a:l.b], x.e[l.a:l.b]) AS score
      FROM v q CROSS JOIN v x CROSS JOIN (VALUES (0, 1, 32), (1, 33, 64)) l(n, a, b) WHERE q.vec_id % 100 = 0),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, list_no ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 20)
"""


_SPACES = {"space0": ("q0", "v0"), "space1": ("q1", "v1")}


def _two_spaces(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Queries and rows with the halves of their vectors as two spaces."""
    rows = _frames(spark, d)
    halves = rows.select("faiss_id", F.slice("embedding", 1, 32).alias("v0"), F.slice("embedding", 33, 32).alias("v1"))
    asked = halves.where("faiss_id % 100 = 0").selectExpr("faiss_id as query_id", "v0 as q0", "v1 as q1")
    return asked, halves


@query(_TWO_SPACES + """, f AS (SELECT query_id, id, sum(1.0 / (60 + rank)) AS s, arg_min('space' || list_no, list_no * 1000 + rank) AS source FROM hits GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, id) AS rank FROM f)
SELECT query_id, rank, id, round(s, 9) AS rrf_score, source FROM r""")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return search.multi_space_search(*_two_spaces(spark, d), _SPACES, 20).select("query_id", "rank", "id", F.round("rrf_score", 9).alias("rrf_score"), "source")


@query(_TWO_SPACES + """, m AS (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM hits WINDOW w AS (PARTITION BY query_id, list_no)),
f AS (SELECT query_id, id, sum((score - lo) / (hi - lo + 1e-6)) AS s FROM m GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, id) AS rank FROM f)
SELECT query_id, rank, id, round(s, 6) AS score FROM r""")
def additive_merge(spark: SparkSession, d: str) -> DataFrame:
    return fusion.additive_merge(vectors.knn_spaces(*_two_spaces(spark, d), _SPACES, 20)).select("query_id", "rank", "id", r6("score").alias("score"))


@query("""WITH m AS (SELECT doc_id, source, n_chars, min(n_chars) OVER (PARTITION BY source) AS lo, max(n_chars) OVER (PARTITION BY source) AS hi FROM documents)
SELECT doc_id, source, round(CASE WHEN hi = lo THEN 0.0 ELSE (n_chars - lo) / (hi - lo) END, 6) AS norm FROM m""")
def minmax_scores(spark: SparkSession, d: str) -> DataFrame:
    docs = t(spark, d, "documents").select("doc_id", "source", "n_chars")
    return fusion.minmax(docs, ["source"], "n_chars").select("doc_id", "source", r6("norm").alias("norm"))


@query(_knn_sql(k=50).replace("SELECT query_id, rank, faiss_id, video_id, round(score, 6) AS score FROM r WHERE rank <= 50", """, p AS (SELECT *, 50.0 - (rank - 1) AS pseudo FROM r WHERE rank <= 50),
m AS (SELECT *, min(pseudo) OVER (PARTITION BY query_id) AS lo, max(pseudo) OVER (PARTITION BY query_id) AS hi FROM p)
SELECT query_id, rank, faiss_id, round(pseudo, 6) AS pseudo, round((pseudo - lo) / (hi - lo), 6) AS norm FROM m"""))
def rank_pseudo_minmax(spark: SparkSession, d: str) -> DataFrame:
    rows = _frames(spark, d)
    hits = vectors.knn(_asked(rows), rows, 50).withColumn("pseudo", _pseudo(50))
    return fusion.minmax(hits, ["query_id"], "pseudo", lists=True).select("query_id", "rank", "faiss_id", r6("pseudo").alias("pseudo"), r6("norm").alias("norm"))


def _pseudo(k: int) -> Column:
    return fusion.pseudo_score(F.col("rank"), k)


# ---------------------------------------------------------------- text


def _words_sql(c: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


def _text_ctes(p: str, docs: str, queries: str = "SELECT item_id AS query_id, {w} AS w FROM benchmark") -> str:
    """CTEs with prefix ``p``: word scores, phrase scores; ``docs`` gives (doc, text)."""
    return f"""{p}q AS (SELECT query_id, w, unnest(w) AS term, generate_subscripts(w, 1) AS o FROM ({queries.format(w=_words_sql('text'))})),
{p}d AS (SELECT doc, {_words_sql('text')} AS w FROM ({docs})),
{p}k AS (SELECT doc, len(w) AS dl, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM {p}d),
{p}coll AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM {p}d WHERE len(w) > 0),
{p}tf AS (SELECT doc, dl, term, count(*) AS tf FROM {p}k WHERE term IN (SELECT term FROM {p}q) GROUP BY ALL),
{p}df AS (SELECT term, count(*) AS df FROM {p}tf GROUP BY ALL),
{p}qt AS (SELECT query_id, term, count(*) AS qtf FROM {p}q GROUP BY ALL),
{p}any AS (SELECT query_id, doc, sum(qtf * 2.2 * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM {p}qt JOIN {p}tf USING (term) JOIN {p}df USING (term) CROSS JOIN {p}coll GROUP BY ALL),
{p}w AS (SELECT query_id, count(*) AS len, sum(ln(1 + (n - COALESCE(df, 0) + 0.5) / (COALESCE(df, 0) + 0.5))) AS idf FROM {p}q LEFT JOIN {p}df USING (term) CROSS JOIN {p}coll GROUP BY ALL),
{p}start AS (SELECT query_id, doc, dl, pos - o AS start, count(*) AS met FROM {p}k JOIN {p}q USING (term) GROUP BY ALL),
{p}found AS (SELECT query_id, doc, dl, count(*) AS phrase_tf FROM {p}start JOIN {p}w USING (query_id) WHERE met = len GROUP BY ALL),
{p}phrase AS (SELECT query_id, doc, phrase_tf, 2.0 * 2.2 * idf * phrase_tf / (phrase_tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS score
  FROM {p}found JOIN {p}w USING (query_id) CROSS JOIN {p}coll),
{p}sum AS (SELECT query_id, doc, sum(score) AS score FROM (SELECT query_id, doc, score FROM {p}any UNION ALL SELECT query_id, doc, score FROM {p}phrase) GROUP BY ALL),
{p}rank AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc) AS rank FROM {p}sum)"""


_DOCS = "SELECT doc_id AS doc, text FROM documents"
_ENGLISH = _DOCS + " WHERE lang = 'en'"
_TURNS = "SELECT conv_id * 1000 + turn AS doc, text FROM conversations"


def _asked_texts(spark: SparkSession, d: str) -> DataFrame:
    """The whole benchmark texts."""
    return t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "conv_id", "turn", "text")


@query(f"WITH {_text_ctes('a', _DOCS)} SELECT query_id, doc, round(score, 6) AS score FROM aany")
def bm25_any_word(spark: SparkSession, d: str) -> DataFrame:
    terms = text.query_terms(_asked_texts(spark, d), "query_id", "query")
    return text.any_word_search(terms, t(spark, d, "documents"), "doc_id", "text").select("query_id", "doc", r6("score").alias("score"))


@query(f"WITH {_text_ctes('a', _DOCS)} SELECT query_id, doc, phrase_tf, round(score, 6) AS score FROM aphrase")
def bm25_phrase(spark: SparkSession, d: str) -> DataFrame:
    terms = text.query_terms(_asked_texts(spark, d), "query_id", "query")
    return text.phrase_search(terms, t(spark, d, "documents"), "doc_id", "text").select("query_id", "doc", "phrase_tf", r6("score").alias("score"))


_THREE_WORDS = "SELECT item_id * 100 + n AS query_id, list_slice({w}, 3 * n + 1, 3 * n + 3) AS w FROM benchmark, unnest(generate_series(0, 99)) s(n) WHERE 3 * n < len({w})"


@query(f"WITH {_text_ctes('a', _DOCS, _THREE_WORDS)} SELECT query_id, doc, phrase_tf, round(score, 6) AS score FROM aphrase")
def bm25_short_phrases(spark: SparkSession, d: str) -> DataFrame:
    """Every three words of the benchmark texts as a phrase of its own."""
    words = t(spark, d, "benchmark").select("item_id", text.analysed(F.col("text")).alias("w")).where("size(w) > 0")
    each = words.select("item_id", "w", F.explode(F.sequence(F.lit(0), F.expr("(size(w) - 1) div 3"))).alias("n"))
    asked = each.select((F.col("item_id") * 100 + F.col("n")).alias("query_id"), F.array_join(F.slice("w", F.col("n") * 3 + 1, F.lit(3)), " ").alias("query"))
    terms = text.query_terms(asked, "query_id", "query")
    return text.phrase_search(terms, t(spark, d, "documents"), "doc_id", "text").select("query_id", "doc", "phrase_tf", r6("score").alias("score"))


@query(f"WITH {_text_ctes('a', _DOCS)} SELECT query_id, rank, doc, round(score, 6) AS score FROM arank WHERE rank <= 100")
def stored_index_search(spark: SparkSession, d: str) -> DataFrame:
    """As ``text_search_topk``, from an index of all words that is written once and of which only blocks that can have hits are read."""
    path = tables.scratch_dir(spark)
    text.write_index(t(spark, d, "documents"), path, "doc_id", "text")
    terms = text.query_terms(_asked_texts(spark, d), "query_id", "query")
    return text.stored_search(spark, path, terms, 100).hits.select("query_id", "rank", "doc", r6("score").alias("score"))


@query(f"WITH {_text_ctes('a', _DOCS)} SELECT query_id, rank, doc, round(score, 6) AS score FROM arank WHERE rank <= 100")
def text_search_topk(spark: SparkSession, d: str) -> DataFrame:
    found = text.text_search(_asked_texts(spark, d), t(spark, d, "documents"), 100, id_col="doc_id", text_col="text")
    return found.select("query_id", "rank", "doc", r6("score").alias("score"))


@query(f"WITH {_text_ctes('a', _ENGLISH)} SELECT query_id, rank, doc, round(score, 6) AS score FROM arank WHERE rank <= 100")
def text_search_filtered(spark: SparkSession, d: str) -> DataFrame:
    found = text.text_search(_asked_texts(spark, d), t(spark, d, "documents").where("lang = 'en'"), 100, id_col="doc_id", text_col="text")
    return found.select("query_id", "rank", "doc", r6("score").alias("score"))


@query(f"WITH {_text_ctes('a', _TURNS)} SELECT query_id, rank, doc, round(score, 6) AS score FROM arank WHERE rank <= 100")
def asr_search(spark: SparkSession, d: str) -> DataFrame:
    found = text.text_search(_asked_texts(spark, d), _turns(spark, d), 100, id_col="doc_id", text_col="text")
    return found.select("query_id", "rank", "doc", r6("score").alias("score"))


@query(f"""WITH k AS (SELECT doc_id, unnest({_words_sql('text')}) AS term FROM documents), p AS (SELECT doc_id, term, count(*) AS tf FROM k GROUP BY ALL)
SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total_tf, max(tf) AS max_tf FROM p GROUP BY ALL""")
def postings_stats(spark: SparkSession, d: str) -> DataFrame:
    held = text.postings(t(spark, d, "documents"), "doc_id", "text")
    return held.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total_tf"), F.max("tf").alias("max_tf"))


# ---------------------------------------------------------------- routing

def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


_SPEECH = " OR ".join(f"contains(lower(q), '{w}')" for w in C.SPEECH_WORDS)
_ROUTED = f"""WITH u AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '"' || substr(text, 1, 12) || '" nói ' || text WHEN turn % 3 = 1 THEN text || ' "' || role || '"' ELSE text END AS q FROM conversations WHERE role = 'user'),
a AS (SELECT *, regexp_extract_all(q, '"([^"]*)"', 1) AS quoted, ({_SPEECH}) AS speech FROM u),
b AS (SELECT *, len(quoted) > 0 AS ocr, CASE WHEN len(quoted) > 0 THEN {_strip("array_to_string(quoted, ' ')")} ELSE '' END AS ocr_query,
  CASE WHEN len(quoted) > 0 THEN {_strip("regexp_replace(q, '\"[^\"]*\"', '', 'g')")} ELSE q END AS visual_query FROM a)
"""


def _routing(spark: SparkSession, d: str) -> DataFrame:
    """User turns, some of them with quotes and a speech word put in."""
    users = t(spark, d, "conversations").where("role = 'user'")
    quoted = F.concat(F.lit('"'), F.substring("text", 1, 12), F.lit('" nói '), F.col("text"))
    q = F.when(F.col("turn") % 3 == 0, quoted).when(F.col("turn") % 3 == 1, F.concat("text", F.lit(' "'), "role", F.lit('"'))).otherwise(F.col("text"))
    return users.select("conv_id", "turn", q.alias("q"))


@query(_ROUTED + """SELECT conv_id, turn, visual_query, ocr_query, CASE WHEN speech THEN visual_query ELSE '' END AS asr_query,
  CASE WHEN visual_query = '' THEN 0.0 WHEN ocr AND speech THEN 0.4 WHEN ocr THEN 0.5 WHEN speech THEN 0.7 ELSE 1.0 END::DOUBLE AS w_visual,
  CASE WHEN visual_query = '' THEN CASE WHEN ocr AND speech THEN 0.5 WHEN ocr THEN 1.0 ELSE 0.0 END WHEN ocr AND speech THEN 0.3 WHEN ocr THEN 0.5 ELSE 0.0 END::DOUBLE AS w_ocr,
  CASE WHEN visual_query = '' THEN CASE WHEN ocr AND speech THEN 0.5 WHEN speech THEN 1.0 ELSE 0.0 END WHEN speech THEN 0.3 ELSE 0.0 END::DOUBLE AS w_asr,
  visual_query <> '' AS runs_visual, ocr_query <> '' AND ocr AS runs_ocr, speech AND visual_query <> '' AS runs_asr FROM b""")
def route_queries(spark: SparkSession, d: str) -> DataFrame:
    plan = _routing(spark, d).withColumn("p", C.query_plan(F.col("q")))
    return plan.select("conv_id", "turn", "p.visual_query", "p.ocr_query", "p.asr_query", F.col("p.weights.visual").alias("w_visual"), F.col("p.weights.ocr").alias("w_ocr"), F.col("p.weights.asr").alias("w_asr"), *(C.runs(F.col("p"), x).alias(f"runs_{x}") for x in fusion.SOURCES))


@query(_ROUTED + "SELECT conv_id, turn, 'Is there a ' || lower(" + _strip("replace(q, '\"', '')") + ") || '?' AS question FROM u")
def yes_no_question(spark: SparkSession, d: str) -> DataFrame:
    return _routing(spark, d).select("conv_id", "turn", C.yes_no_question(F.col("q")).alias("question"))


@query("SELECT doc_id, round(COALESCE(1 / (1 + exp(toxic - quality)), 0.0), 6) AS yes_prob FROM documents LEFT JOIN labels USING (doc_id)")
def yes_no_probability(spark: SparkSession, d: str) -> DataFrame:
    both = t(spark, d, "documents").select("doc_id").join(t(spark, d, "labels"), "doc_id", "left")
    return both.select("doc_id", r6(C.yes_probability(F.col("quality"), F.col("toxic"))).alias("yes_prob"))


# ---------------------------------------------------------------- fusion

_MODAL = f"""WITH {_text_ctes('o', _DOCS)}, {_text_ctes('s', _TURNS)},
v AS (SELECT b.item_id AS query_id, e.vec_id AS id, list_dot_product(x.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score FROM benchmark b JOIN embeddings x ON x.vec_id = b.item_id CROSS JOIN embeddings e),
vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM v),
hits AS (SELECT query_id, 'visual' AS source, rank, id, 50.0 - (rank - 1) AS score FROM vr WHERE rank <= 50
  UNION ALL SELECT query_id, 'ocr', rank, doc, score FROM orank WHERE rank <= 50
  UNION ALL SELECT query_id, 'asr', rank, doc // 1000, score FROM srank WHERE rank <= 50),
lim AS (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM hits WINDOW w AS (PARTITION BY query_id, source)),
norm AS (SELECT query_id, source, rank, id, CASE WHEN hi = lo THEN 0.0 ELSE (score - lo) / (hi - lo) END AS norm FROM lim),
"""


def _merged_sql(pick: str) -> str:
    one = {"last": "arg_max(norm, rank) FILTER (source = '{s}')", "max": "max(norm) FILTER (source = '{s}')"}[pick]
    cols = ", ".join(f"COALESCE({one.format(s=s)}, 0.0) AS {s}" for s in fusion.SOURCES)
    return f"""mg AS (SELECT query_id, id, {cols} FROM norm GROUP BY query_id, id),
fs AS (SELECT *, 0.5 * visual + 0.3 * ocr + 0.2 * asr AS final_score FROM mg),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(final_score, 9) DESC, id) AS rank FROM fs)"""


def _modal_hits(spark: SparkSession, d: str) -> DataFrame:
    """Visual hits by the vector with the query's number, hits on documents, hits on turns by conversation."""
    asked, rows = _asked_texts(spark, d), _frames(spark, d)
    visual = vectors.knn(vectors.queries_by_id(asked, rows), rows, 50)
    ocr = text.text_search(asked, t(spark, d, "documents"), 50, id_col="doc_id", text_col="text")
    asr = text.text_search(asked, _turns(spark, d), 50, id_col="doc_id", text_col="text")
    hits = visual.select("query_id", F.lit("visual").alias("source"), "rank", F.col("faiss_id").alias("id"), _pseudo(50).alias("score"))
    hits = hits.union(ocr.select("query_id", F.lit("ocr"), "rank", "doc", "score")).union(asr.select("query_id", F.lit("asr"), "rank", F.expr("doc div 1000"), "score"))
    return fusion.minmax(hits, ["query_id", "source"], lists=True)


def _weights(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.lit(0.5).alias("visual"), F.lit(0.3).alias("ocr"), F.lit(0.2).alias("asr"))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


@query(_MODAL + _merged_sql("max") + " SELECT query_id, rank, id, round(visual, 6) AS visual, round(ocr, 6) AS ocr, round(asr, 6) AS asr, round(final_score, 6) AS final_score FROM rk")
def weighted_merge(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(fusion.weighted_merge(_modal_hits(spark, d), _weights(spark, d), "max"), *fusion.SOURCES, "final_score")


@query(_MODAL + _merged_sql("last") + " SELECT query_id, rank, id, round(visual, 6) AS visual, round(ocr, 6) AS ocr, round(asr, 6) AS asr, round(final_score, 6) AS final_score FROM rk")
def weighted_merge_lastwins(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(fusion.weighted_merge(_modal_hits(spark, d), _weights(spark, d)), *fusion.SOURCES, "final_score")


_RERANK = """, p AS (SELECT rk.query_id, rk.id, rk.rank AS old, rk.rank <= 30 AS in_pool, CASE WHEN rk.rank <= 30 THEN 0.7 * final_score + 0.3 * COALESCE(1 / (1 + exp(toxic - quality)), 0.0) ELSE final_score END AS final_score
  FROM rk LEFT JOIN labels ON rk.id = labels.doc_id),
z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY in_pool DESC, CASE WHEN in_pool THEN round(final_score, 9) END DESC NULLS LAST, old) AS rank FROM p)
"""


def _reranked(ranked: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    return fusion.rerank_pool(ranked, _vqa(spark, d).withColumnRenamed("faiss_id", "id")).select("query_id", "rank", "id", "final_score", "in_pool")


def _vqa(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "labels").select(F.col("doc_id").alias("faiss_id"), C.yes_probability(F.col("quality"), F.col("toxic")).alias("vqa"))


@query(f"""WITH {_text_ctes('a', _DOCS)}, rk AS (SELECT query_id, rank, doc AS id, score AS final_score FROM arank WHERE rank <= 100)""" + _RERANK + "SELECT query_id, rank, id, round(final_score, 6) AS final_score, in_pool FROM z")
def rerank_pool(spark: SparkSession, d: str) -> DataFrame:
    found = text.text_search(_asked_texts(spark, d), t(spark, d, "documents"), 100, id_col="doc_id", text_col="text")
    return _rounded(_reranked(found.select("query_id", "rank", F.col("doc").alias("id"), F.col("score").alias("final_score")), spark, d), "final_score")


@query(_MODAL + _merged_sql("last") + _RERANK + "SELECT query_id, rank, id, round(final_score, 6) AS final_score, in_pool FROM z")
def fused_search(spark: SparkSession, d: str) -> DataFrame:
    ranked = fusion.weighted_merge(_modal_hits(spark, d), _weights(spark, d))
    return _rounded(_reranked(ranked, spark, d), "final_score")


_PART = "SELECT query_id, {w} AS w FROM (SELECT query_id, %s_query AS text FROM plan WHERE w_%s > 0 AND %s_query <> '')"


@query(_ROUTED.rstrip() + f""", plan AS (SELECT conv_id * 1000 + turn AS query_id, conv_id, visual_query, ocr_query, CASE WHEN speech THEN visual_query ELSE '' END AS asr_query,
  CASE WHEN visual_query = '' THEN 0.0 WHEN ocr AND speech THEN 0.4 WHEN ocr THEN 0.5 WHEN speech THEN 0.7 ELSE 1.0 END::DOUBLE AS w_visual,
  CASE WHEN visual_query = '' THEN CASE WHEN ocr AND speech THEN 0.5 WHEN ocr THEN 1.0 ELSE 0.0 END WHEN ocr AND speech THEN 0.3 WHEN ocr THEN 0.5 ELSE 0.0 END::DOUBLE AS w_ocr,
  CASE WHEN visual_query = '' THEN CASE WHEN ocr AND speech THEN 0.5 WHEN speech THEN 1.0 ELSE 0.0 END WHEN speech THEN 0.3 ELSE 0.0 END::DOUBLE AS w_asr FROM b),
{_text_ctes('o', _DOCS, _PART % (('ocr',) * 3))}, {_text_ctes('s', _TURNS, _PART % (('asr',) * 3))},
v AS (SELECT query_id, e.vec_id AS id, list_dot_product(x.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score FROM plan JOIN embeddings x ON x.vec_id = conv_id CROSS JOIN embeddings e WHERE visual_query <> '' AND w_visual > 0),
vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM v),
hits AS (SELECT query_id, 'visual' AS source, rank, id, 50.0 - (rank - 1) AS score, NULL AS txt FROM vr WHERE rank <= 50
  UNION ALL SELECT query_id, 'ocr', rank, doc, score, text FROM orank JOIN documents ON doc_id = doc WHERE rank <= 50
  UNION ALL SELECT query_id, 'asr', rank, doc // 1000, score, text FROM srank JOIN conversations ON conv_id * 1000 + turn = doc WHERE rank <= 50),
lim AS (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM hits WINDOW w AS (PARTITION BY query_id, source)),
norm AS (SELECT *, CASE WHEN hi = lo THEN 0.0 ELSE (score - lo) / (hi - lo) END AS norm FROM lim),
mg AS (SELECT query_id, id, {", ".join(f"COALESCE(arg_max(norm, rank) FILTER (source = '{x}'), 0.0) AS {x}" for x in fusion.SOURCES)},
  arg_max(txt, rank) FILTER (source = 'ocr') AS ocr_text, arg_max(txt, rank) FILTER (source = 'asr') AS asr_text FROM norm GROUP BY query_id, id),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(final_score, 9) DESC, id) AS rank FROM (SELECT mg.*, w_visual * visual + w_ocr * ocr + w_asr * asr AS final_score FROM mg JOIN plan USING (query_id))),
pl AS (SELECT rk.query_id, rk.id, rk.rank AS old, visual, ocr, asr, ocr_text, asr_text, rk.rank <= 30 AS in_pool, CASE WHEN rk.rank <= 30 THEN COALESCE(1 / (1 + exp(toxic - quality)), 0.0) END AS vqa, CASE WHEN rk.rank <= 30 THEN 0.7 * final_score + 0.3 * COALESCE(1 / (1 + exp(toxic - quality)), 0.0) ELSE final_score END AS final_score
  FROM rk LEFT JOIN labels ON rk.id = labels.doc_id),
z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY in_pool DESC, CASE WHEN in_pool THEN round(final_score, 9) END DESC NULLS LAST, old) AS rank FROM pl)
SELECT query_id, rank, id AS faiss_id, COALESCE('v' || label, '') AS video_id, COALESCE('frame' || vec_id, '') AS frame_name, COALESCE(vec_id / 25.0::DOUBLE, 0.0) AS timestamp, round(visual, 6) AS visual, round(ocr, 6) AS ocr, round(asr, 6) AS asr, round(vqa, 6) AS vqa,
  round(final_score, 6) AS final_score, in_pool, ocr_text, asr_text FROM z LEFT JOIN embeddings ON vec_id = id""")
def multimodal_search(spark: SparkSession, d: str) -> DataFrame:
    """Routed queries with weights of their own, the searches that each runs, and its frames' columns and texts."""
    rows = _frames(spark, d)
    asked = _routing(spark, d).join(rows.select(F.col("faiss_id").alias("conv_id"), F.col("embedding").alias("qvec")), "conv_id", "left")
    asked = asked.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("q").alias("query"), "qvec")
    ocr = t(spark, d, "documents").select(F.col("doc_id").alias("faiss_id"), F.col("text").alias("ocr_text"))
    asr = _turns(spark, d).select(F.col("doc_id").alias("asr_id"), F.col("conv_id").alias("nearest_faiss_id"), "text")
    named = rows.select("faiss_id", F.concat(F.lit("v"), "video_id").alias("video_id"), F.concat(F.lit("frame"), "faiss_id").alias("frame_name"), C.frame_seconds(F.col("faiss_id")).alias("timestamp"))
    found = search.fused_search(asked, rows, ocr, asr, named, _vqa(spark, d), k=50)
    return _rounded(found.select("query_id", "rank", "faiss_id", "video_id", "frame_name", "timestamp", "score_breakdown.*", "final_score", "in_pool", "ocr_text", "asr_text"), *fusion.SOURCES, "vqa", "final_score")


@query(_knn_sql(of="embedding").replace("SELECT query_id, rank, faiss_id, video_id, round(score, 6) AS score FROM r", "SELECT query_id, rank, faiss_id, video_id, round(score, 6) AS score FROM r").replace("SELECT vec_id AS query_id, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 100 = 0", "SELECT item_id AS query_id, list_transform(generate_series(1, 64), lambda i: CAST((length(regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g')) * i) % 7 - 3 AS DOUBLE)) AS qv FROM benchmark"))
def text_vector_search(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of the whole benchmark texts by a stand-in encoder, which only sees their lengths."""

    def encode(batches):
        import numpy as np

        for frame in batches:
            yield frame.assign(qvec=[((len(x) * np.arange(1, 65)) % 7 - 3.0).tolist() for x in frame["query"]])

    rows = _frames(spark, d)
    found = search.text_vector_search(_asked_texts(spark, d), rows, rows.select("faiss_id", "video_id"), 10, encode)
    return found.select("query_id", "rank", "faiss_id", "video_id", r6("score").alias("score"))


@query(_knn_sql(k=50).replace("SELECT query_id, rank, faiss_id, video_id, round(score, 6) AS score FROM r WHERE rank <= 50", """, h AS (SELECT * FROM r WHERE rank <= 50)
SELECT h.query_id, h.faiss_id, c.text AS answer, row_number() OVER (PARTITION BY h.query_id ORDER BY h.rank) - 1 AS n FROM h JOIN conversations c ON c.conv_id = h.faiss_id AND c.turn = 1"""))
def answers_join(spark: SparkSession, d: str) -> DataFrame:
    rows = _frames(spark, d)
    hits = vectors.knn(_asked(rows), rows, 50).withColumnRenamed("faiss_id", "id")
    said = t(spark, d, "conversations").where("turn = 1").select(F.col("conv_id").alias("id"), F.col("text").alias("answer"))
    answered = hits.select("query_id", "id").join(said, "id")
    return fusion.answers(hits, answered).select("query_id", F.col("id").alias("faiss_id"), "answer", "n")


@query(_knn_sql(k=50).replace("SELECT query_id, rank, faiss_id, video_id, round(score, 6) AS score FROM r WHERE rank <= 50", """, h AS (SELECT r.* FROM r WHERE rank <= 50)
SELECT h.query_id, h.faiss_id, CAST(h.video_id AS BIGINT) AS video_id, lang || '/' || doc_id || ' answers ' || len(CAST(h.query_id AS VARCHAR)) || ' and ' || h.video_id AS answer, row_number() OVER (PARTITION BY h.query_id ORDER BY h.rank) - 1 AS n
FROM h JOIN documents d ON d.doc_id = h.faiss_id WHERE d.doc_id % 4 <> 3 AND (h.faiss_id + h.query_id) % 5 <> 0"""))
def answers_by_model(spark: SparkSession, d: str) -> DataFrame:
    """Nearest frames that have a document as their image, asked four at once; the model has no answer to every fifth."""

    def load():
        def answer(frame):
            said = frame["path"] + " answers " + frame["query"].str.len().astype(str) + " and " + frame["video_id"].astype(str)
            return said.where((frame["id"] + frame["query"].astype(int)) % 5 != 0, None).to_frame("answer")

        return answer

    rows = _frames(spark, d)
    asked = _asked(rows).withColumn("query", F.col("query_id").cast("string"))
    images = t(spark, d, "documents").where("doc_id % 4 <> 3").select(F.col("doc_id").alias("faiss_id"), F.concat_ws("/", "lang", "doc_id").alias("path"))
    use = models.Use(models.Loaded(load), ["query", "path", "id", "video_id"], 4)
    return search.answered_search(asked, rows, rows.select("faiss_id", "video_id"), 50, use, images).select("query_id", "faiss_id", "video_id", "answer", "n")


@query(f"""WITH {_text_ctes('a', _DOCS)}, rk AS (SELECT query_id, rank, doc AS id, score AS final_score FROM arank WHERE rank <= 100)""" + _RERANK.replace("COALESCE(1 / (1 + exp(toxic - quality)), 0.0)", "((length(text) * 31 + rk.id * 17) % 101) / 100.0::DOUBLE").replace("LEFT JOIN labels ON rk.id = labels.doc_id", "JOIN benchmark ON item_id = query_id") + "SELECT query_id, rank, id, round(final_score, 6) AS final_score, in_pool FROM z")
def rerank_by_model(spark: SparkSession, d: str) -> DataFrame:
    """Hits reranked by a stand-in scorer, which gets each query's pool alone, 64 rows at once."""

    def load():
        return lambda frame: (((frame["query"].str.len() * 31 + frame["id"] * 17) % 101) / 100.0).to_frame("vqa")

    asked = _asked_texts(spark, d)
    found = text.text_search(asked, t(spark, d, "documents"), 100, id_col="doc_id", text_col="text")
    ranked = found.select("query_id", "rank", F.col("doc").alias("id"), F.col("score").alias("final_score")).join(asked, "query_id")
    scored = fusion.rerank_pool(ranked, models.Use(models.Loaded(load), ["query", "id"], 64))
    return _rounded(scored.select("query_id", "rank", "id", "final_score", "in_pool"), "final_score")


# ---------------------------------------------------------------- time


def seconds(ts: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})") / 1e6


def _events(spark: SparkSession, d: str, kind: str | None = None) -> DataFrame:
    e = t(spark, d, "events")
    e = e if kind is None else e.where(F.col("event_type") == kind)
    return e.select(F.col("event_id").alias("faiss_id"), F.col("event_id").alias("global_frame_id"), F.col("user_id").alias("video_id"), seconds("ts").alias("timestamp"), F.col("value").alias("score"), F.col("event_type").alias("split"))


@query("""WITH s AS (SELECT event_id, user_id, (epoch_us(ts) / 1e6 + (epoch_us(ts) / 1e6 + value * 60)) / 2 AS t FROM events WHERE event_type = 'click'),
f AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS t FROM events WHERE event_type = 'view'),
p AS (SELECT s.event_id AS segment_id, s.user_id AS video_id, f.event_id AS nearest_faiss_id, abs(f.t - s.t) AS dt, row_number() OVER (PARTITION BY s.event_id ORDER BY abs(f.t - s.t), f.t, f.event_id) AS r FROM s JOIN f USING (user_id))
SELECT segment_id, video_id, nearest_faiss_id, round(dt, 3) AS dt FROM p WHERE r = 1""")
def nearest_frame_align(spark: SparkSession, d: str) -> DataFrame:
    """Clicks as segments of as many minutes as their value says."""
    middle = align.segment_midpoint(F.col("timestamp"), F.col("timestamp") + F.col("score") * 60)
    segments = _events(spark, d, "click").select(F.col("faiss_id").alias("segment_id"), "video_id", middle.alias("mid"))
    found = align.nearest_in_time(segments, _events(spark, d, "view"), ["video_id"], "mid", "timestamp", "segment_id", "faiss_id")
    return found.select("segment_id", "video_id", "nearest_faiss_id", F.round(F.abs(F.col("nearest_time") - F.col("mid")), 3).alias("dt"))


@query("SELECT event_type AS split, user_id AS video_id, event_id AS faiss_id, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id // 7, event_id) AS place FROM events")
def frames_by_video(spark: SparkSession, d: str) -> DataFrame:
    """Each frame's place among its video's: their order in the task needs no further shuffle or sort."""
    rows = _events(spark, d).withColumn("frame_index", F.expr("faiss_id div 7"))
    order = W.partitionBy("split", "video_id").orderBy("frame_index", "faiss_id")
    return align.grouped_by_video(rows).select("split", "video_id", "faiss_id", F.row_number().over(order).cast("bigint").alias("place"))


@query("SELECT user_id AS video_id, count(*) AS n_segments FROM events WHERE event_type = 'click' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 90) GROUP BY ALL")
def unmatched_segments(spark: SparkSession, d: str) -> DataFrame:
    return align.unmatched(_events(spark, d, "click"), _events(spark, d, "purchase").where("score > 90"), ["video_id"])


_STEPS = {0: ("view", "click", "purchase"), 1: ("signup", "view", "error")}
_PER_EVENT, _ALPHA = 1000, 1e-6


def _step_hits(spark: SparkSession, d: str) -> DataFrame:
    """Two queries of three events; an event's hits are the events of its type."""
    steps = spark.createDataFrame([(q, i, k) for q, ks in _STEPS.items() for i, k in enumerate(ks)], "query_id bigint, event_idx int, split string")
    return _events(spark, d).join(F.broadcast(steps), "split")  # six rows


_CANDIDATES = f"""WITH st(query_id, event_idx, split) AS (VALUES {", ".join(f"({q}, {i}, '{k}')" for q, ks in _STEPS.items() for i, k in enumerate(ks))}),
h AS (SELECT st.query_id, st.event_idx, e.event_id AS faiss_id, e.user_id AS video_id, epoch_us(e.ts) / 1e6 AS ts, e.value AS score, st.split FROM events e JOIN st ON st.split = e.event_type),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, event_idx ORDER BY score DESC, faiss_id) AS cand_rank FROM h) WHERE cand_rank <= {_PER_EVENT})"""


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    return temporal.candidates(_step_hits(spark, d), _PER_EVENT)


@query(_CANDIDATES + " SELECT CAST(query_id AS BIGINT) AS query_id, CAST(event_idx AS BIGINT) AS event_idx, faiss_id, video_id, cand_rank, score FROM c")
def temporal_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d).select("query_id", F.col("event_idx").cast("bigint").alias("event_idx"), "faiss_id", "video_id", "cand_rank", "score")


_FULL = ", a AS (SELECT * FROM c WHERE (query_id, video_id) IN (SELECT (query_id, video_id) FROM c GROUP BY query_id, video_id HAVING count(DISTINCT event_idx) = 3))"


@query(_CANDIDATES + _FULL + " SELECT CAST(query_id AS BIGINT) AS query_id, CAST(event_idx AS BIGINT) AS event_idx, faiss_id, video_id FROM a")
def temporal_all_events(spark: SparkSession, d: str) -> DataFrame:
    full = temporal.with_all_events(_candidates(spark, d), ["video_id"], 3)
    return full.select("query_id", F.col("event_idx").cast("bigint").alias("event_idx"), "faiss_id", "video_id")


def _beam_sql(n: int, table: str, beam: int = 50) -> str:
    out = f"""b0 AS (SELECT * FROM (SELECT query_id, video_id, [faiss_id] AS ids, [split] AS splits, [cand_rank] AS cr, [ts] AS tss, ts AS t0, score AS base, score AS total, faiss_id AS lastf, min(cand_rank) OVER (PARTITION BY query_id, video_id) AS first,
  row_number() OVER (PARTITION BY query_id, video_id ORDER BY score DESC, cand_rank) AS ord FROM {table} WHERE event_idx = 0) WHERE ord <= {beam})"""
    for i in range(1, n):
        out += f""",
x{i} AS (SELECT b.query_id, b.video_id, list_append(b.ids, k.faiss_id) AS ids, list_append(b.splits, k.split) AS splits, list_append(b.cr, k.cand_rank) AS cr, list_append(b.tss, k.ts) AS tss, b.t0, b.base + k.score AS base,
  CASE WHEN k.ts - b.t0 > 0 THEN (b.base + k.score) * exp(-{_ALPHA} * (k.ts - b.t0)) ELSE b.base + k.score END AS total, k.faiss_id AS lastf, b.first, b.ord AS parent, k.cand_rank AS kc
  FROM b{i - 1} b JOIN {table} k ON k.query_id = b.query_id AND k.video_id = b.video_id AND k.event_idx = {i} AND k.faiss_id > b.lastf),
b{i} AS (SELECT query_id, video_id, ids, splits, cr, tss, t0, base, total, lastf, first, ord FROM (SELECT *, row_number() OVER (PARTITION BY query_id, video_id ORDER BY total DESC, parent, lastf, kc) AS ord FROM x{i}) WHERE ord <= {beam})"""
    return out


def _ranked_sql(n: int, top: int) -> str:
    return f", z AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY total DESC, first, video_id, ord) AS seq FROM b{n - 1}) WHERE seq <= {top})"


_SHOWN = " SELECT CAST(query_id AS BIGINT) AS query_id, seq, video_id, array_to_string(ids, ',') AS ids, array_to_string(list_sort(list_distinct(splits)), ',') AS splits, round(base, 6) AS base_score, round(total, 6) AS total_score FROM z"


def _shown(z: DataFrame) -> DataFrame:
    ids = F.array_join(F.transform("frames", lambda f: f["faiss_id"].cast("string")), ",")
    return z.select("query_id", "seq", "video_id", ids.alias("ids"), F.array_join(temporal.splits_of(), ",").alias("splits"), r6("base_score").alias("base_score"), r6("total_score").alias("total_score"))


@query(_CANDIDATES + ", a AS (SELECT * FROM c WHERE event_idx < 2 AND (query_id, video_id) IN (SELECT (query_id, video_id) FROM c WHERE event_idx < 2 GROUP BY query_id, video_id HAVING count(DISTINCT event_idx) = 2)), " + _beam_sql(2, "a") + _ranked_sql(2, 500) + _SHOWN)
def beam_two_events(spark: SparkSession, d: str) -> DataFrame:
    two = temporal.with_all_events(_candidates(spark, d).where("event_idx < 2"), ["video_id"], 2)
    return _shown(temporal.ranked_sequences(temporal.beam_search(two, ["video_id"], 2, alpha=_ALPHA), ["video_id"], 500))


def _three(spark: SparkSession, d: str, top: int) -> DataFrame:
    return temporal.temporal_search(_step_hits(spark, d), ["video_id"], 3, _PER_EVENT, alpha=_ALPHA, top=top)


_THREE = _CANDIDATES + _FULL + ", " + _beam_sql(3, "a")


@query(_THREE + _ranked_sql(3, 500) + _SHOWN)
def beam_three_events(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_three(spark, d, 500))


@query(_THREE + _ranked_sql(3, 20) + _SHOWN)
def beam_bounded(spark: SparkSession, d: str) -> DataFrame:
    """The best twenty, of videos that can still have one of them."""
    return _shown(temporal.bounded_search(_step_hits(spark, d), ["video_id"], 3, _PER_EVENT, alpha=_ALPHA, top=20, first=10)[0])


@query(_THREE + _ranked_sql(3, 100) + """, f AS (SELECT query_id, seq, unnest(ids) AS id FROM z),
m AS (SELECT query_id, seq, avg(COALESCE(1 / (1 + exp(toxic - quality)), 0.0)) AS conf FROM f LEFT JOIN labels ON doc_id = id GROUP BY ALL),
y AS (SELECT z.query_id, z.seq, z.video_id, conf, 0.7 * total + 0.3 * conf * 3 AS total FROM z JOIN m USING (query_id, seq))
SELECT CAST(query_id AS BIGINT) AS query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(total, 9) DESC, seq) AS seq, video_id, round(conf, 6) AS vqa_confidence, round(total, 6) AS total_score FROM y""")
def sequence_validation(spark: SparkSession, d: str) -> DataFrame:
    out = temporal.validated(_three(spark, d, 100), _vqa(spark, d), 3)
    return out.select("query_id", F.col("new_seq").alias("seq"), "video_id", r6("vqa_confidence").alias("vqa_confidence"), r6("total_score").alias("total_score"))


@query(_THREE + _ranked_sql(3, 20) + " SELECT CAST(query_id AS BIGINT) AS query_id, seq - 1 AS id, unnest([0, 1, 2])::BIGINT AS n, unnest(splits) AS folder_key, video_id AS video_key, unnest(ids) AS frame_key, round(unnest(tss), 3) AS timestamp FROM z")
def sequence_nested(spark: SparkSession, d: str) -> DataFrame:
    nested = temporal.nested_output(_three(spark, d, 20), F.col("video_id")).select("query_id", F.col("id").alias("seq_id"), F.explode("frames").alias("f"))
    return nested.select("query_id", F.col("seq_id").alias("id"), F.col("f.id").alias("n"), "f.folder_key", "f.video_key", "f.frame_key", F.round("f.timestamp", 3).alias("timestamp"))


_FROM_VECTORS = f"""WITH ev AS (SELECT q.vec_id AS query_id, i.i AS event_idx, e.embedding::DOUBLE[] AS qv FROM embeddings q CROSS JOIN (VALUES (0), (1), (2)) i(i) JOIN embeddings e ON e.vec_id = q.vec_id + i.i WHERE q.vec_id % 100 = 0),
h AS (SELECT query_id, event_idx, e.vec_id AS faiss_id, CAST(e.label AS BIGINT) AS video_id, e.vec_id / 25.0::DOUBLE AS ts, round(list_dot_product(qv, e.embedding::DOUBLE[]), 9) AS score, 's' || e.vec_id % 3 AS split FROM ev CROSS JOIN embeddings e),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, event_idx ORDER BY score DESC, faiss_id) AS cand_rank FROM h) WHERE cand_rank <= 100)"""


@query(_FROM_VECTORS + _FULL + ", " + _beam_sql(3, "a") + _ranked_sql(3, 20) + """, f AS (SELECT query_id, seq, unnest([0, 1, 2]) AS event_idx, unnest(ids) AS id FROM z),
m AS (SELECT query_id, seq, avg(CASE WHEN d.doc_id IS NULL THEN 0.0 ELSE ((length('Is there a event ' || event_idx || ' of ' || query_id || '?') * 31 + id * 17 + n_chars) % 101) / 100.0::DOUBLE END) AS conf FROM f LEFT JOIN documents d ON doc_id = id AND doc_id % 4 <> 3 GROUP BY ALL),
y AS (SELECT z.*, conf, 0.7 * total + 0.3 * conf * 3 AS blended FROM z JOIN m USING (query_id, seq)),
w AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(blended, 9) DESC, seq) AS place FROM y)
SELECT query_id, place AS seq, video_id, array_to_string(ids, ',') AS ids, array_to_string(list_sort(list_distinct(splits)), ',') AS splits, round(conf, 6) AS vqa_confidence, round(blended, 6) AS total_score FROM w""")
def temporal_end_to_end(spark: SparkSession, d: str) -> DataFrame:
    """Every hundredth vector and the two after it as a query's events: retrieval, beam, validation by a stand-in scorer of
    frames that have an image, and ranking."""

    def load():
        return lambda frame: (((frame["question"].str.len() * 31 + frame["faiss_id"] * 17 + frame["n_chars"]) % 101) / 100.0).to_frame("vqa")

    rows = _frames(spark, d)
    steps = rows.where("faiss_id % 100 < 3").select(F.expr("faiss_id div 100 * 100").alias("query_id"), F.expr("int(faiss_id % 100)").alias("event_idx"), F.col("embedding").alias("qvec"))
    events = steps.withColumn("query", F.concat(F.lit("event "), "event_idx", F.lit(" of "), "query_id"))
    of = rows.select("faiss_id", "video_id", F.col("faiss_id").alias("global_frame_id"), C.frame_seconds(F.col("faiss_id")).alias("timestamp"), F.concat(F.lit("s"), F.expr("faiss_id % 3")).alias("split"))
    images = t(spark, d, "documents").where("doc_id % 4 <> 3").select(F.col("doc_id").alias("faiss_id"), "n_chars")
    use = models.Use(models.Loaded(load), ["question", "faiss_id", "n_chars"], 64)
    z = search.temporal_search(events, rows, of, ["video_id"], 3, alpha=_ALPHA, vqa=use, assets=images)
    ids = F.array_join(F.transform("frames", lambda f: f["faiss_id"].cast("string")), ",")
    return z.select("query_id", "seq", "video_id", ids.alias("ids"), F.array_join(temporal.splits_of(), ",").alias("splits"), r6("vqa_confidence").alias("vqa_confidence"), r6("total_score").alias("total_score"))


# ---------------------------------------------------------------- metadata, assets, checks


def _raw_frames(spark: SparkSession, d: str) -> DataFrame:
    """Events as frames, with nulls where the event is an error."""
    e = t(spark, d, "events")
    ok = F.col("event_type") != "error"
    return e.select(F.col("event_id").alias("faiss_id"), F.when(ok, F.concat(F.lit("user"), F.col("user_id"))).alias("video_id"), F.concat(F.lit("keyframe_"), F.upper("event_type"), F.lit("_V"), F.lpad(F.col("user_id").cast("string"), 3, "0"), F.lit("_"), F.col("event_id"), F.lit(".jpg")).alias("frame_name"), F.when(ok, F.col("user_id")).alias("frame_index"), F.concat(F.lit("events-"), F.col("event_type"), F.lit("-a")).alias("split"), F.when(ok, F.col("event_id")).alias("global_frame_id"))


_RAW = """WITH raw AS (SELECT event_id AS faiss_id, CASE WHEN event_type <> 'error' THEN 'user' || user_id END AS video_id,
 'keyframe_' || upper(event_type) || '_V' || lpad(CAST(user_id AS VARCHAR), 3, '0') || '_' || event_id || '.jpg' AS frame_name,
 CASE WHEN event_type <> 'error' THEN user_id END AS frame_index, 'events-' || event_type || '-a' AS split, CASE WHEN event_type <> 'error' THEN event_id END AS global_frame_id FROM events) """


@query(_RAW + "SELECT faiss_id, COALESCE(video_id, '') AS video_id, frame_name, COALESCE(frame_index, faiss_id) AS frame_index, split, COALESCE(global_frame_id, 0) AS global_frame_id, COALESCE(global_frame_id, 0) / 25.0::DOUBLE AS timestamp, 25.0::DOUBLE AS fps FROM raw")
def normalize_metadata(spark: SparkSession, d: str) -> DataFrame:
    return frames.normalize_metadata(_raw_frames(spark, d))


@query("SELECT event_id AS faiss_id, CAST(event_id AS DOUBLE) / 25.0::DOUBLE AS timestamp FROM events")
def frame_timestamp(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "events").select(F.col("event_id").alias("faiss_id"), C.frame_seconds(F.col("event_id")).alias("timestamp"))


@query(_RAW + """SELECT faiss_id, concat_ws('/', split, video_id, frame_name) AS path, split || '/' || video_id || '.npy' AS feature_path, upper(split_part(split, '-', 2)) AS folder_key,
 split_part(replace(frame_name, 'keyframe_', ''), '_', 1) AS name_folder, split_part(replace(frame_name, 'keyframe_', ''), '_', 1) || '_' || split_part(replace(frame_name, 'keyframe_', ''), '_', 2) AS name_video, CAST(faiss_id AS VARCHAR) AS name_frame FROM raw""")
def asset_path(spark: SparkSession, d: str) -> DataFrame:
    s, v, n = F.col("split"), F.col("video_id"), F.col("frame_name")
    named = _raw_frames(spark, d).withColumn("p", C.frame_name_parts(n))
    return named.select("faiss_id", C.asset_path(s, v, n).alias("path"), C.feature_path(s, v).alias("feature_path"), C.folder_of_split(s).alias("folder_key"), F.col("p.folder_key").alias("name_folder"), F.col("p.video_key").alias("name_video"), F.col("p.frame_key").alias("name_frame"))


_PATH = "regexp_replace(regexp_replace(url, '[?#].*$', ''), '/$', '')"


@query(f"SELECT page_id, regexp_replace(lower(url), '[^a-z0-9]+', '', 'g') AS key, regexp_replace(lower({_PATH}), '[^a-z0-9]+', '', 'g') AS path_key FROM pages")
def key_normalize(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "pages").select("page_id", C.normal_key(F.col("url")).alias("key"), C.normal_key(_page_path()).alias("path_key"))


def _page_path() -> Column:
    return F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "/$", "")


def _files(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "pages").select(F.concat(_page_path(), F.lit(".mp4")).alias("path"))


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    """Documents resolved to pages: their key is lang/doc_id; a page's own number may name it too."""
    docs = t(spark, d, "documents").select("doc_id", "lang")
    scanned = frames.asset_index(_files(spark, d))
    explicit = frames.explicit_assets(t(spark, d, "pages").where("page_id % 7 = 0").select(F.concat(F.lit("fr/"), "page_id").alias("name"), F.col("url").alias("path"), F.col("page_id").alias("ord")))
    keys = F.array(C.normal_key(F.concat_ws("/", "lang", "doc_id")), C.normal_key(F.concat(F.lit("p"), "doc_id")))
    return frames.resolve_assets(docs, keys, scanned, explicit, "doc_id")


_RESOLVED = f"""WITH f AS (SELECT {_PATH} AS p FROM pages),
k AS (SELECT p || '.mp4' AS path, unnest([list_slice(string_split(p, '/'), -1, -1), list_slice(string_split(p, '/'), -2, -1), list_slice(string_split(p, '/'), -3, -1)]) AS parts FROM f),
sc AS (SELECT regexp_replace(lower(array_to_string(parts, '/')), '[^a-z0-9]+', '', 'g') AS key, min(path) AS path FROM k GROUP BY 1),
ex AS (SELECT 'fr' || page_id AS key, url AS path FROM pages WHERE page_id % 7 = 0),
w AS (SELECT doc_id, unnest([lang || doc_id, 'p' || doc_id]) AS key, unnest([0, 1]) AS ord FROM documents),
j AS (SELECT doc_id, path, src * 10 + ord AS o FROM w JOIN (SELECT key, path, 1 AS src FROM sc UNION ALL SELECT key, path, 0 FROM ex) USING (key)),
res AS (SELECT d.doc_id, (SELECT arg_min(j.path, j.o) FROM j WHERE j.doc_id = d.doc_id) AS path FROM documents d) """


@query(_RESOLVED + "SELECT doc_id, path FROM res")
def resolve_assets(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(spark, d)


@query(_RESOLVED + ", s AS (SELECT doc_id, CASE WHEN path IS NULL THEN 'missing' WHEN doc_id - 100 < 0 THEN 'failed' ELSE 'created' END AS status FROM res), x AS (SELECT *, row_number() OVER (PARTITION BY status ORDER BY doc_id) AS r FROM s) SELECT status, count(*) AS n, array_to_string(list(doc_id ORDER BY doc_id) FILTER (r <= 20), ',') AS examples FROM x GROUP BY status")
def coverage_summary(spark: SparkSession, d: str) -> DataFrame:
    found = _resolved(spark, d).withColumn("global_frame_id", F.col("doc_id"))
    missing = found.where("path is null").withColumn("status", F.lit("missing"))
    fine, failed = frames.frame_numbers(found.where("path is not null"), 100)
    rows = missing.select("status", "doc_id").union(fine.select(F.lit("created"), "doc_id")).union(failed.select(F.lit("failed"), "doc_id"))
    return frames.coverage(rows, example="doc_id").select("status", "n", F.array_join(F.transform("examples", lambda x: x.cast("string")), ",").alias("examples"))


@query(_RESOLVED + "SELECT path, doc_id AS faiss_id, row_number() OVER (PARTITION BY path ORDER BY doc_id) AS step FROM res WHERE path IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def extraction_plan(spark: SparkSession, d: str) -> DataFrame:
    done = t(spark, d, "labels").where("toxic = 1")
    items = frames.without_existing(_resolved(spark, d).where("path is not null"), done, "doc_id")
    items = items.select("path", F.col("doc_id").alias("faiss_id"), F.col("doc_id").alias("global_frame_id"))
    return frames.plan_steps(frames.extraction_plan(items)).select("path", "faiss_id", "step")


@query("SELECT user_id, arg_max(event_type, (CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END, event_id)) AS event_type, arg_max(value, (CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END, event_id)) AS value, COALESCE(max(event_id) FILTER (event_type = 'purchase'), max(event_id)) AS event_id FROM events GROUP BY ALL")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    """Each user's last event, over which their last purchase is put."""
    e = t(spark, d, "events").select("user_id", "event_type", "value", "event_id")
    return tables.upsert(e.where("event_type <> 'purchase'"), e.where("event_type = 'purchase'"), ["user_id"], "event_id")


@query("SELECT user_id, arg_max(event_type, (CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END, event_id)) AS event_type, arg_max(value, (CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END, event_id)) AS value, COALESCE(max(event_id) FILTER (event_type = 'purchase'), max(event_id)) AS event_id FROM events GROUP BY ALL")
def stored_upsert(spark: SparkSession, d: str) -> DataFrame:
    """As ``upsert_latest``, by two writes to a stored table, of which the second is made twice."""
    path, e = tables.scratch_dir(spark), t(spark, d, "events").select("user_id", "event_type", "value", "event_id")
    stored.create(spark, path, "user_id BIGINT, event_type STRING, value DOUBLE, event_id BIGINT", ["user_id"], 16)
    for rows in (e.where("event_type <> 'purchase'"), *[e.where("event_type = 'purchase'")] * 2):
        stored.write(rows, path, "event_id")
    return stored.read(spark, path)


@query("SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS ocr_text, count(*) AS n_boxes, 'vi' AS language FROM conversations WHERE text IS NOT NULL AND trim(text) <> '' GROUP BY ALL")
def text_assembly(spark: SparkSession, d: str) -> DataFrame:
    return align.assemble_text(t(spark, d, "conversations"), ["conv_id"], "turn", "text")


_GAPS = "g AS (SELECT label AS video_id, CAST(vec_id // 10 AS BIGINT) AS frame_index, embedding FROM (SELECT *, row_number() OVER (PARTITION BY label, vec_id // 10 ORDER BY vec_id) AS r FROM embeddings) WHERE r = 1)"


def _features(spark: SparkSession, d: str) -> DataFrame:
    """One vector for each label and tenth row number; most labels have gaps."""
    e = t(spark, d, "embeddings").select(F.col("label").alias("video_id"), F.expr("vec_id div 10").alias("frame_index"), "vec_id", "embedding")
    return e.groupBy("video_id", "frame_index").agg(F.min_by("embedding", "vec_id").alias("embedding"))


@query(f"WITH {_GAPS}, m AS (SELECT video_id, max(frame_index) AS m FROM g GROUP BY ALL), x AS (SELECT video_id, unnest(generate_series(0, m)) AS frame_index FROM m) SELECT CAST(video_id AS BIGINT) AS video_id, frame_index, embedding IS NULL AS gap, round(COALESCE(list_sum(embedding::DOUBLE[]), 0.0), 5) AS total FROM x LEFT JOIN g USING (video_id, frame_index)")
def dense_fill(spark: SparkSession, d: str) -> DataFrame:
    full = align.dense_fill(_features(spark, d), ["video_id"], 64)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return full.select(F.col("video_id").cast("bigint").alias("video_id"), "frame_index", (~F.exists("embedding", lambda x: x != 0)).alias("gap"), F.round(total, 5).alias("total"))


@query("SELECT (SELECT count(*) FROM embeddings) AS n_vectors, (SELECT count(*) FROM documents) AS n_frames, (SELECT count(*) FROM embeddings) = (SELECT count(*) FROM documents) AS ok")
def check_counts(spark: SparkSession, d: str) -> DataFrame:
    return frames.check_counts(t(spark, d, "embeddings"), t(spark, d, "documents"))


@query("""WITH m AS (SELECT CAST(label AS BIGINT) AS video_id, max(vec_id // 10) AS max_index FROM embeddings GROUP BY ALL), f AS (SELECT doc_id % 12 AS video_id, count(*) AS n_features FROM labels GROUP BY ALL)
SELECT video_id, CAST(max_index AS BIGINT) AS max_index, COALESCE(n_features, 0) AS n_features FROM m LEFT JOIN f USING (video_id) WHERE COALESCE(n_features, 0) <= max_index""")
def check_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as frames, and labels as the features of twelve videos."""
    f = t(spark, d, "embeddings").select(F.col("label").cast("bigint").alias("video_id"), F.expr("vec_id div 10").alias("frame_index"))
    return frames.check_bounds(f, t(spark, d, "labels").select(F.expr("doc_id % 12").alias("video_id")), ["video_id"])


@query("SELECT label AS video_id, CAST(vec_id // 10 AS BIGINT) AS frame_index, count(*) AS n FROM embeddings GROUP BY ALL HAVING count(*) > 1")
def check_duplicates(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "embeddings").select(F.col("label").alias("video_id"), F.expr("vec_id div 10").alias("frame_index"))
    return frames.check_duplicates(e, ["video_id", "frame_index"])


@query("SELECT CAST(min(len(embedding)) AS BIGINT) AS min_dim, CAST(max(len(embedding)) AS BIGINT) AS max_dim, min(len(embedding)) = max(len(embedding)) AS ok FROM embeddings")
def check_shape(spark: SparkSession, d: str) -> DataFrame:
    return frames.check_shape(t(spark, d, "embeddings"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_assets(spark: SparkSession, d: str) -> DataFrame:
    return frames.missing_assets(t(spark, d, "documents").select("doc_id"), t(spark, d, "labels"), "doc_id")


@query("SELECT count(DISTINCT len(embedding)) = 1 AND (SELECT count(*) FROM embeddings) = (SELECT count(*) FROM documents) AS ok, CAST(CASE WHEN count(DISTINCT len(embedding)) = 1 THEN 0 ELSE 1 END + CASE WHEN (SELECT count(*) FROM embeddings) = (SELECT count(*) FROM documents) THEN 0 ELSE 1 END AS BIGINT) AS failed FROM embeddings")
def check_verdict(spark: SparkSession, d: str) -> DataFrame:
    counts = check_counts(spark, d).select(F.lit("counts").alias("name"), "ok")
    return frames.verdict(counts.union(check_shape(spark, d).select(F.lit("shape"), "ok")))


@query("""WITH f AS (SELECT CAST(label AS BIGINT) AS video_id, vec_id // 10 AS i, count(*) AS n FROM embeddings GROUP BY ALL), v AS (SELECT video_id, max(i) AS last FROM f GROUP BY ALL), l AS (SELECT doc_id % 12 AS video_id, count(*) AS n FROM labels GROUP BY ALL)
SELECT name, bad_rows = 0 AS ok, bad_rows::BIGINT AS bad_rows FROM (
  SELECT 'counts' AS name, abs((SELECT count(*) FROM documents) - (SELECT count(*) FROM embeddings)) AS bad_rows
  UNION ALL SELECT 'shape', (SELECT count(*) FROM documents WHERE len(string_split(text, ' ')) <> 100)
  UNION ALL SELECT 'bounds', (SELECT count(*) FROM v LEFT JOIN l USING (video_id) WHERE COALESCE(l.n, 0) <= last)
  UNION ALL SELECT 'duplicates', (SELECT count(*) FROM f WHERE n > 1))""")
def checks_in_one_pass(spark: SparkSession, d: str) -> DataFrame:
    """Documents' words as vectors of a hundred, vectors as frames, labels as the features of twelve videos."""
    words = t(spark, d, "documents").select(F.split("text", " ").alias("embedding"))
    f = t(spark, d, "embeddings").select(F.col("label").cast("bigint").alias("video_id"), F.expr("vec_id div 10").alias("frame_index"))
    return frames.checked(words, f, t(spark, d, "labels").select(F.expr("doc_id % 12").alias("video_id")), ["video_id"], 100)


@query("SELECT doc_id, n_chars FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 25")
def deterministic_sample(spark: SparkSession, d: str) -> DataFrame:
    return frames.deterministic_sample(t(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")


@query("SELECT o.doc_id, o.lang, c.label AS video_id, o.n_chars FROM documents o LEFT JOIN embeddings c ON c.vec_id = o.doc_id")
def enrich_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = t(spark, d, "documents").select("doc_id", "lang", "n_chars")
    return align.enrich(docs, t(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("video_id")), "doc_id").select("doc_id", "lang", "video_id", "n_chars")


@query(f"WITH f AS (SELECT DISTINCT {_PATH} AS path FROM pages), x AS (SELECT page_id, {_PATH} AS a, url AS b, page_id % 3 AS m FROM pages) SELECT page_id, CASE WHEN m = 0 THEN a WHEN b IN (SELECT path FROM f) THEN b END AS asset FROM x")
def two_path_fallback(spark: SparkSession, d: str) -> DataFrame:
    files = t(spark, d, "pages").select(_page_path().alias("path")).distinct()
    rows = t(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 3 == 0, _page_path()).alias("a"), F.col("url").alias("b"))
    return align.with_fallback_path(rows, files, F.col("a"), F.col("b")).select("page_id", "asset")


@query("SELECT doc_id, regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g') AS query FROM documents")
def clean_query(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", C.clean_query(F.col("text")).alias("query"))


@query(_RAW + """, n AS (SELECT faiss_id, regexp_replace(lower(video_id), '[^a-z0-9]+', '', 'g') AS v, regexp_replace(lower(split), '[^a-z0-9]+', '', 'g') AS s, regexp_replace(lower(split_part(split, '-', 2)), '[^a-z0-9]+', '', 'g') AS f,
 regexp_replace(lower(replace(frame_name, '.jpg', '')), '[^a-z0-9]+', '', 'g') AS stem, regexp_replace(lower(split_part(replace(frame_name, 'keyframe_', ''), '_', 1) || split_part(replace(frame_name, 'keyframe_', ''), '_', 2)), '[^a-z0-9]+', '', 'g') AS two FROM raw)
SELECT faiss_id, k AS key FROM (SELECT DISTINCT faiss_id, unnest([v, s || COALESCE(v, ''), f || COALESCE(v, ''), stem, two]) AS k FROM n) WHERE k <> ''""")
def candidate_keys(spark: SparkSession, d: str) -> DataFrame:
    keys = frames.frame_keys(F.col("split"), F.col("video_id"), F.col("frame_name"))
    return _raw_frames(spark, d).select("faiss_id", F.explode(keys).alias("key"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def frames_with_assets(spark: SparkSession, d: str) -> DataFrame:
    return frames.with_assets(t(spark, d, "documents").select("doc_id", "lang"), t(spark, d, "labels"), "doc_id")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) ORDER BY doc_id LIMIT 50")
def first_frames_with_assets(spark: SparkSession, d: str) -> DataFrame:
    return frames.first_with_assets(t(spark, d, "documents").select("doc_id", "lang"), t(spark, d, "labels"), 50, "doc_id", "doc_id")


@query("SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 50")
def first_frames(spark: SparkSession, d: str) -> DataFrame:
    return frames.first_by_id(t(spark, d, "documents").select("doc_id", "lang"), 50, "doc_id")


# ---------------------------------------------------------------- written and read again


_READ = "SELECT event_id AS faiss_id, event_type AS split, 'user' || user_id AS video_id, 'f' || event_id AS frame_name, user_id AS frame_index, event_id AS global_frame_id FROM events"


def _frame_files(spark: SparkSession, d: str) -> str:
    """Events as JSON objects {id: frame} of a thousand each, one after another in files as large as tasks make them."""
    path, e = tables.scratch_dir(spark), t(spark, d, "events")
    frame = F.struct(F.col("event_type").alias("split"), F.concat(F.lit("user"), "user_id").alias("video_id"), F.concat(F.lit("f"), "event_id").alias("frame_name"), F.col("user_id").alias("frame_index"), F.col("event_id").alias("global_frame_id"))
    found = e.groupBy(F.expr("event_id div 1000").alias("thousand")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("event_id").cast("string"), frame)))).alias("value"))
    found.select("value").write.text(path)
    return path


def _read_frames(found: DataFrame) -> DataFrame:
    return found.select("faiss_id", "split", "video_id", "frame_name", F.col("frame_index").cast("bigint").alias("frame_index"), "global_frame_id")


@query(_READ)
def strict_frames(spark: SparkSession, d: str) -> DataFrame:
    return _read_frames(tables.read_frames(spark, _frame_files(spark, d)))


@query(_READ)
def lenient_frames(spark: SparkSession, d: str) -> DataFrame:
    missing = tables.read_frames_or_none(spark, tables.scratch_dir(spark))
    return _read_frames(tables.read_frames_or_none(spark, _frame_files(spark, d)).unionByName(missing))


@query("SELECT doc_id AS faiss_id, source AS video_id, text AS ocr_text, lang AS language FROM documents")
def ocr_documents(spark: SparkSession, d: str) -> DataFrame:
    path = tables.scratch_dir(spark)
    rows = t(spark, d, "documents").select(F.col("doc_id").alias("faiss_id"), F.col("source").alias("video_id"), F.col("text").alias("ocr_text"), F.col("lang").alias("language"))
    tables.write_json(rows, path)
    return tables.read_ocr(spark, path, lines=True).select("faiss_id", "video_id", "ocr_text", "language")


@query("SELECT CAST(conv_id AS VARCHAR) AS video_id, 10.0::DOUBLE * turn AS start_time, 10.0::DOUBLE * turn + 10 AS end_time, text, conv_id AS nearest_faiss_id FROM conversations")
def asr_documents(spark: SparkSession, d: str) -> DataFrame:
    path, c = tables.scratch_dir(spark), t(spark, d, "conversations")
    rows = c.select(F.col("conv_id").cast("string").alias("video_id"), (F.col("turn") * 10.0).alias("start_time"), (F.col("turn") * 10.0 + 10).alias("end_time"), "text", F.col("conv_id").alias("nearest_faiss_id"))
    tables.write_json(rows, path)
    return tables.read_asr(spark, path, lines=True).select("video_id", "start_time", "end_time", "text", "nearest_faiss_id")


@query("SELECT lang, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM (SELECT * FROM documents UNION ALL SELECT * FROM documents WHERE lang = 'en') GROUP BY ALL")
def bulk_append(spark: SparkSession, d: str) -> DataFrame:
    """A table made once, to which all documents are added, and the English ones again."""
    path, docs = tables.scratch_dir(spark), t(spark, d, "documents").select("doc_id", "lang")
    if tables.create_if_absent(spark, {path: "doc_id BIGINT, lang STRING"}) != [path] or tables.create_if_absent(spark, {path: "doc_id BIGINT, lang STRING"}):
        raise ValueError("not made once")
    added = tables.append(docs, path) + tables.append(docs.where("lang = 'en'"), path)
    out = spark.read.parquet(path)
    if added != out.count():
        raise ValueError("not all rows were added")
    return out.groupBy("lang").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query("SELECT vec_id AS faiss_id, round(list_sum(embedding::DOUBLE[]), 5) AS total FROM embeddings")
def vector_table(spark: SparkSession, d: str) -> DataFrame:
    path = tables.scratch_dir(spark)
    tables.write_vectors(_frames(spark, d), path)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return spark.read.schema(tables.EMBEDDINGS).parquet(path).select("faiss_id", F.round(total, 5).alias("total"))


@query("SELECT 's' || label AS split, vec_id % 7 AS video_id, count(*) AS n, max(vec_id // 10) AS last_index FROM embeddings GROUP BY ALL")
def feature_blocks(spark: SparkSession, d: str) -> DataFrame:
    path = tables.scratch_dir(spark)
    tables.write_features(t(spark, d, "embeddings").select(F.concat(F.lit("s"), "label").alias("split"), F.expr("vec_id % 7").alias("video_id"), F.expr("vec_id div 10").alias("frame_index"), "embedding"), path)
    return spark.read.parquet(path).groupBy("split", "video_id").agg(F.count("*").alias("n"), F.max("frame_index").alias("last_index"))


@query("SELECT vec_id AS id, 'v' || label AS video_id, vec_id % 5 <> 0 AS fits FROM embeddings")
def multi_vector_points(spark: SparkSession, d: str) -> DataFrame:
    """Points of two vectors, of which every fifth lacks a component of the second."""
    path, sizes = tables.scratch_dir(spark), {"one": 32, "two": 32}
    tables.recreate_points(spark, path, sizes)
    e = t(spark, d, "embeddings")
    two = F.when(F.col("vec_id") % 5 == 0, F.slice("embedding", 33, 31)).otherwise(F.slice("embedding", 33, 32))
    points = e.select(F.col("vec_id").alias("id"), F.slice("embedding", 1, 32).alias("one"), two.alias("two"), F.concat(F.lit("v"), "label").alias("video_id"), F.lit("f").alias("frame_name"), F.lit(0.0).alias("timestamp"), F.lit("s").alias("split"))
    tables.append(points, path)
    return spark.read.schema(tables.point_schema(sizes)).parquet(path).select("id", "video_id", tables.vectors_fit(sizes).alias("fits"))
