"""Vector, keyword and hybrid search over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.catalog.base import POINTS_SQL, QUESTION, as_of, points, query, query_vector, word_index
from sparkloom.functions import scores
from sparkloom.operators import retrieval, words
from sparkloom.session import new_folder, table

_Q0 = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
_SIM = f"round(list_cosine_similarity(embedding::DOUBLE[], {_Q0}), 9)"
_FOLD = "translate(lower({}), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy')"


def _embedded(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point_id"), "embedding", "label")


@query("k01_knn_topk", f"SELECT vec_id AS point_id, round({_SIM}, 6) AS score FROM embeddings ORDER BY {_SIM} DESC, vec_id LIMIT 10")
def k01_knn_topk(spark, sf_dir):
    return retrieval.vector_top_k(_embedded(spark, sf_dir), query_vector(spark, sf_dir), 10).select("point_id", F.round("score", 6).alias("score"))


@query("t01_semantic_rounded", f"SELECT vec_id AS point_id, label, round({_SIM}, 3) AS score FROM embeddings ORDER BY {_SIM} DESC, vec_id LIMIT 5")
def t01_semantic_rounded(spark, sf_dir):
    return retrieval.vector_top_k(_embedded(spark, sf_dir), query_vector(spark, sf_dir), 5).select("point_id", "label", F.round("score", 3).alias("score"))


@query("p04_knn_filtered", f"SELECT vec_id AS point_id, round({_SIM}, 6) AS score FROM embeddings WHERE label = 3 ORDER BY {_SIM} DESC, vec_id LIMIT 10")
def p04_knn_filtered(spark, sf_dir):
    return retrieval.vector_top_k(_embedded(spark, sf_dir), query_vector(spark, sf_dir), 10, where=F.col("label") == 3).select("point_id", F.round("score", 6).alias("score"))


_RECENCY = "pow(0.5, greatest(0, (epoch(TIMESTAMP '2024-01-30') - epoch(created_at::TIMESTAMP)) / 86400.0) / 90.0)"
_NEAR = f"near AS (SELECT p.point_id, p.created_at, {_SIM} AS vscore FROM points p JOIN embeddings e ON e.vec_id = p.point_id ORDER BY vscore DESC, p.point_id LIMIT 48)"
_PRE = f"pre AS (SELECT *, row_number() OVER (ORDER BY round(0.6 * vscore + 0.10 * {_RECENCY}, 9) DESC, point_id) - 1 AS rank FROM near)"


@query("k03_prerank", f"WITH {POINTS_SQL}, {_NEAR}, {_PRE} SELECT point_id, round(vscore, 6) AS vscore, rank FROM pre")
def k03_prerank(spark, sf_dir):
    near = retrieval.vector_top_k(points(spark, sf_dir, vectors=True).select("point_id", "created_at", "embedding"), query_vector(spark, sf_dir), 48)
    return retrieval.pre_ranked(near, F.col("created_at"), as_of()).select("point_id", F.round("score", 6).alias("vscore"), "rank")


def _bm25_sql(terms: list[str]) -> str:
    """CTEs up to ``hits`` (point_id, matched, bm25)."""
    values = ", ".join(f"('{t}')" for t in terms)
    return f"""terms(term) AS (VALUES {values}), toks AS (SELECT doc_id AS point_id, regexp_extract_all({_FOLD.format("text")}, '[\\p{{L}}\\p{{N}}_]+') AS w FROM documents),
stats AS (SELECT count(*) AS n, avg(len(w)) AS mean_len FROM toks),
tf AS (SELECT t.point_id, len(t.w) AS doc_len, q.term, len(list_filter(t.w, lambda x: x = q.term)) AS tf FROM toks t, terms q),
df AS (SELECT term, count(*) FILTER (tf > 0) AS df FROM tf GROUP BY term),
idf AS (SELECT term, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END AS idf FROM df, stats),
hits AS (SELECT point_id, count(*)::INT AS matched, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / mean_len))), 9) AS bm25 FROM tf JOIN idf USING (term), stats WHERE tf > 0 GROUP BY point_id)"""


@query("t02_bm25_topk", f"WITH {_bm25_sql(['apache', 'license'])} SELECT point_id, matched, round(bm25, 6) AS bm25 FROM hits ORDER BY hits.bm25 DESC, point_id LIMIT 20")
def t02_bm25_topk(spark, sf_dir):
    hits = words.match(word_index(spark, sf_dir), words.parse("apache OR license"))
    return hits.orderBy(F.desc("bm25"), "point_id").limit(20).select("point_id", "matched", F.round("bm25", 6).alias("bm25"))


@query("t02_bm25_indexed", f"WITH {_bm25_sql(['apache', 'license'])} SELECT point_id, matched, round(bm25, 6) AS bm25 FROM hits")
def t02_bm25_indexed(spark, sf_dir):
    """All hits, not only the best."""
    return words.match(word_index(spark, sf_dir), words.parse("apache OR license")).select("point_id", "matched", F.round("bm25", 6).alias("bm25"))


_RARE = "Heanonha ndesou license"


def _keyword_sql(question: str, k: int) -> str:
    terms = words.query_terms(question)
    return f"""{_bm25_sql(terms)}, counts AS (SELECT least(count(*) FILTER (matched = {len(terms)}), {k}) AS n_all, least(count(*), {k}) AS n_any FROM hits),
words AS (SELECT point_id, matched, hits.bm25 FROM hits, counts WHERE matched = {len(terms)} OR (n_all < {k} AND n_any > n_all) ORDER BY hits.bm25 DESC, point_id LIMIT {k})"""


@query("t02_and_or_fallback", f"WITH {_keyword_sql(_RARE, 10)} SELECT point_id, matched, round(bm25, 6) AS bm25 FROM words")
def t02_and_or_fallback(spark, sf_dir):
    return words.keyword_search(word_index(spark, sf_dir), _RARE, 10).select("point_id", "matched", F.round("bm25", 6).alias("bm25"))


@query("t03_phrase", f"""SELECT doc_id FROM documents WHERE contains(' ' || array_to_string(regexp_extract_all({_FOLD.format('text')}, '[\\p{{L}}\\p{{N}}_]+'), ' ') || ' ', ' rights reserved ')
  OR contains(' ' || array_to_string(regexp_extract_all({_FOLD.format('text')}, '[\\p{{L}}\\p{{N}}_]+'), ' ') || ' ', ' public license ')""")  # fmt: skip
def t03_phrase(spark, sf_dir):
    """Only the postings of the phrases' words are read."""
    return words.match(word_index(spark, sf_dir), words.parse('"rights reserved" OR "public license"')).select(F.col("point_id").alias("doc_id"))


SHAPES = {"all": "apache license", "any": "apache OR gpl OR mit", "without": "license NOT (apache OR mit)", "prefix": "licens* AND apa*", "phrase": '"public license" OR ("rights reserved" AND copyright)'}
_HAS = "list_contains(w, '{}')"
_SHAPES_SQL = {
    "all": f"{_HAS.format('apache')} AND {_HAS.format('license')}", "any": " OR ".join(_HAS.format(x) for x in ("apache", "gpl", "mit")),
    "without": f"{_HAS.format('license')} AND NOT ({_HAS.format('apache')} OR {_HAS.format('mit')})",
    "prefix": "len(list_filter(w, lambda x: x LIKE 'licens%')) > 0 AND len(list_filter(w, lambda x: x LIKE 'apa%')) > 0",
    "phrase": f"contains(line, ' public license ') OR (contains(line, ' rights reserved ') AND {_HAS.format('copyright')})",
}


@query("t02_query_shapes", f"WITH toks AS (SELECT doc_id AS point_id, regexp_extract_all({_FOLD.format('text')}, '[\\p{{L}}\\p{{N}}_]+') AS w FROM documents), lined AS (SELECT *, ' ' || array_to_string(w, ' ') || ' ' AS line FROM toks) "
       + " UNION ALL ".join(f"SELECT '{name}' AS shape, point_id FROM lined WHERE {where}" for name, where in _SHAPES_SQL.items()))
def t02_query_shapes(spark, sf_dir):
    """All hits of five shapes of queries."""
    index, out = word_index(spark, sf_dir), None
    for name, text in SHAPES.items():
        hits = words.match(index, words.parse(text)).select(F.lit(name).alias("shape"), "point_id")
        out = hits if out is None else out.unionAll(hits)
    return out


@query("k02_many_questions", f"""WITH toks AS (SELECT doc_id AS point_id, regexp_extract_all({_FOLD.format("text")}, '[\\p{{L}}\\p{{N}}_]+') AS w FROM documents), stats AS (SELECT count(*) AS n, avg(len(w)) AS mean_len FROM toks),
tf AS (SELECT point_id, any_value(n) AS doc_len, term, count(*) AS tf FROM (SELECT point_id, len(w) AS n, unnest(w) AS term FROM toks) GROUP BY point_id, term), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
asked AS (SELECT DISTINCT item_id AS query, unnest(regexp_extract_all({_FOLD.format("text")}, '[\\p{{L}}\\p{{N}}_]+')) AS term FROM benchmark),
part AS (SELECT query, point_id, round(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / mean_len)), 9)::DECIMAL(18,9) AS x FROM asked JOIN df USING (term) JOIN tf USING (term), stats),
summed AS (SELECT query, point_id, sum(x)::DOUBLE AS bm25 FROM part GROUP BY query, point_id), best AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY bm25 DESC, point_id) AS n FROM summed)
SELECT query, point_id, round(bm25, 6) AS bm25, n FROM best WHERE n <= 3""")  # fmt: skip
def k02_many_questions(spark, sf_dir):
    """The three best documents for each benchmark passage, by any of its words."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text")
    return words.keyword_search_each(word_index(spark, sf_dir), asked, 3).select("query", "point_id", F.round("bm25", 6).alias("bm25"), "n")


@query("s16_postings", f"""SELECT doc_id AS point_id, term, count(*) AS tf, any_value(n)::INT AS doc_len FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM
  (SELECT doc_id, regexp_extract_all({_FOLD.format('text')}, '[\\p{{L}}\\p{{N}}_]+') AS w FROM documents)) GROUP BY doc_id, term""")  # fmt: skip
def s16_postings(spark, sf_dir):
    return word_index(spark, sf_dir).terms().drop("bucket", "positions")


@query("s16_replaced_postings", f"""SELECT doc_id AS point_id, term, count(*) AS tf, any_value(n)::INT AS doc_len FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM
  (SELECT doc_id, regexp_extract_all({_FOLD.format("CASE WHEN source = 'src1' THEN 'Replaced ' || lang ELSE text END")}, '[\\p{{L}}\\p{{N}}_]+') AS w FROM documents)) GROUP BY doc_id, term""")  # fmt: skip
def s16_replaced_postings(spark, sf_dir):
    """One source's documents get new texts: their postings are replaced, all others stay as stored."""
    touched = table(spark, sf_dir, "documents").where("source = 'src1'").select(F.col("doc_id").alias("point_id"), F.concat(F.lit("Replaced "), "lang").alias("text"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("point_id"), "text")
    index = words.Index(spark, new_folder(spark, "words"))
    index.add(0, docs)
    index.add(1, touched)
    return index.terms().drop("bucket", "positions")


_FUSED = f"""ranked_words AS (SELECT point_id, row_number() OVER (ORDER BY words.bm25 DESC, point_id) - 1 AS rank FROM words),
merged AS (SELECT point_id, rank, vscore FROM pre UNION ALL SELECT point_id, rank, NULL FROM ranked_words),
fused AS (SELECT *, row_number() OVER (ORDER BY raw DESC, point_id) - 1 AS fused_rank FROM
  (SELECT point_id, round(sum(1.0::DOUBLE / (60.0 + rank)), 9) AS raw, max(vscore) AS vscore FROM merged GROUP BY point_id) ORDER BY raw DESC, point_id LIMIT 48)"""
_CHAIN = f"WITH {POINTS_SQL}, {_NEAR}, {_PRE}, {_keyword_sql(QUESTION, 24)}, {_FUSED}"


@query("j03_rrf_fuse", f"{_CHAIN} SELECT point_id, round(raw, 5) AS rrf, round(vscore, 6) AS vscore, fused_rank FROM fused")
def j03_rrf_fuse(spark, sf_dir):
    pts = points(spark, sf_dir, vectors=True)
    near = retrieval.pre_ranked(retrieval.vector_top_k(pts.select("point_id", "created_at", "embedding"), query_vector(spark, sf_dir), 48), F.col("created_at"), as_of())
    found = retrieval.ranked(words.keyword_search(word_index(spark, sf_dir), QUESTION, 24), [F.desc("bm25"), F.col("point_id")])
    fused = retrieval.ranked(retrieval.fuse(near.withColumnRenamed("score", "vscore"), found, 48), [F.desc("raw"), F.col("point_id")], "fused_rank")
    return fused.select("point_id", "rrf", F.round("vscore", 6).alias("vscore"), "fused_rank")


_TERMS = sorted({t for t in words.query_terms_in_order(QUESTION) if len(t) >= 4})
_POOLED = f"""hits AS (SELECT f.*, p.source, p.title, p.chunk_index, p.text FROM fused f JOIN points p USING (point_id)),""".replace("hits AS", "shown AS") + f"""
kept AS (SELECT * FROM shown QUALIFY row_number() OVER (PARTITION BY source, chunk_index, substr(text, 1, 80) ORDER BY fused_rank) = 1),
bonus AS (SELECT *, round(round(raw, 5) + 0.008 * least({' + '.join(f"contains(lower(title), '{t}')::INT" for t in _TERMS)}, 2), 5) AS rrf FROM kept),
two AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY fused_rank) AS nth FROM bonus QUALIFY nth <= 2),
summed AS (SELECT *, round(sum(rrf) OVER (PARTITION BY source), 5) AS doc_score, min(fused_rank) OVER (PARTITION BY source) AS first_rank FROM two),
final AS (SELECT *, row_number() OVER (ORDER BY doc_score DESC, first_rank, nth) - 1 AS position FROM summed ORDER BY position LIMIT 6)"""


@query("retrieve_flagship", f"{_CHAIN}, {_POOLED} SELECT point_id, source, rrf, round(vscore, 6) AS vscore, doc_score, position FROM final")
def retrieve_flagship(spark, sf_dir):
    hits = retrieval.retrieve(points(spark, sf_dir, vectors=True), word_index(spark, sf_dir), QUESTION, query_vector(spark, sf_dir), as_of())
    return hits.select("point_id", "source", "rrf", F.round("vscore", 6).alias("vscore"), "doc_score", "position")


@query("p01_citations", f"{_CHAIN}, {_POOLED} SELECT f.position, f.source, f.chunk_index AS chunk, p.created_at AS date, round(f.vscore, 3) AS score, substr(f.text, 1, 400) AS snippet FROM final f JOIN points p USING (point_id)")
def p01_citations(spark, sf_dir):
    pts = points(spark, sf_dir, vectors=True)
    hits = retrieval.retrieve(pts, word_index(spark, sf_dir), QUESTION, query_vector(spark, sf_dir), as_of())
    return retrieval.citations(F.broadcast(hits).join(pts.select("point_id", "created_at"), "point_id"), F.col("created_at"))


@query("t04_find_docs", f"{_CHAIN}, {_POOLED} SELECT source, min(position) AS best_rank, round(max(vscore), 3) AS best_score, string_agg(chunk_index::VARCHAR, ',' ORDER BY position) AS chunks FROM final GROUP BY source ORDER BY best_rank LIMIT 5")
def t04_find_docs(spark, sf_dir):
    hits = retrieval.retrieve(points(spark, sf_dir, vectors=True), word_index(spark, sf_dir), QUESTION, query_vector(spark, sf_dir), as_of())
    return retrieval.find_docs(hits).select("source", "best_rank", "best_score", F.array_join(F.col("chunks").cast("array<string>"), ",").alias("chunks"))


@query("t05_extractive")
def t05_extractive(spark, sf_dir):
    return retrieval.extractive_answer(retrieval.retrieve(points(spark, sf_dir, vectors=True), word_index(spark, sf_dir), QUESTION, query_vector(spark, sf_dir), as_of()))


@query("w02_dedup", f"WITH {POINTS_SQL} SELECT source, min(point_id) AS point_id, count(*) AS copies FROM points GROUP BY source, substr(text, 1, 80)")
def w02_dedup(spark, sf_dir):
    pts = points(spark, sf_dir)
    first = retrieval.first_of_each(pts, F.col("source"), F.lit(0), F.col("text"), [F.col("point_id")])
    counts = pts.groupBy("source", F.substring("text", 1, 80).alias("head")).agg(F.count(F.lit(1)).alias("copies"))
    return first.withColumn("head", F.substring("text", 1, 80)).join(counts, ["source", "head"]).select("source", "point_id", "copies")


@query("w03_doc_pool", f"""WITH {POINTS_SQL}, h AS (SELECT point_id, source, length(text) / 1e5 AS rrf, point_id AS fused_rank FROM points),
two AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY fused_rank) AS nth FROM h QUALIFY nth <= 2),
s AS (SELECT *, round(sum(rrf) OVER (PARTITION BY source), 5) AS doc_score, min(fused_rank) OVER (PARTITION BY source) AS first_rank FROM two)
SELECT point_id, source, doc_score, nth FROM s ORDER BY doc_score DESC, first_rank, nth LIMIT 12""")  # fmt: skip
def w03_doc_pool(spark, sf_dir):
    hits = points(spark, sf_dir).select("point_id", "source", (F.length("text") / 1e5).alias("rrf"), F.col("point_id").alias("fused_rank"))
    return retrieval.pooled(hits, 12).select("point_id", "source", "doc_score", "nth")


@query("f23_title_bonus", f"WITH {POINTS_SQL} SELECT point_id, least(contains(lower(title), 'ther')::INT + contains(lower(title), 'license')::INT + contains(lower(title), 'this')::INT, 2) AS hits FROM points")
def f23_title_bonus(spark, sf_dir):
    from sparkloom.functions.text import title_hits

    terms = F.array(F.lit("ther"), F.lit("license"), F.lit("this"))
    return points(spark, sf_dir).select("point_id", title_hits(F.col("title"), terms).alias("hits"))


_ROUNDED = "list_transform(embedding::DOUBLE[], lambda x: round(x, 1))"
_PARITY_SQL = f"""asked AS (SELECT vec_id AS q, embedding::DOUBLE[] AS e, {_ROUNDED} AS r FROM embeddings WHERE vec_id % 50 = 0),
a AS (SELECT q, vec_id AS id, row_number() OVER (PARTITION BY q ORDER BY round(list_cosine_similarity(embedding::DOUBLE[], e), 9) DESC, vec_id) AS n FROM asked, embeddings QUALIFY n <= 5),
b AS (SELECT q, vec_id AS id, row_number() OVER (PARTITION BY q ORDER BY round(list_cosine_similarity({_ROUNDED}, r), 9) DESC, vec_id) AS n FROM asked, embeddings QUALIFY n <= 5),
parity AS (SELECT a.q AS query, count(b.id) / 5.0::DOUBLE AS overlap FROM a LEFT JOIN b ON a.q = b.q AND a.id = b.id GROUP BY a.q)"""


def parity(spark, sf_dir):
    """Top five by cosine in a store of vectors and in its copy of one decimal place, for every fiftieth vector as query."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    rounded = e.withColumn("embedding", F.transform("embedding", lambda x: F.round(x, 1)))
    asked = lambda store: store.where("id % 50 = 0").select(F.col("id").alias("query"), F.col("embedding").alias("asked"))
    return retrieval.top_k_overlap(retrieval.vector_top_k_each(e, asked(e), 5), retrieval.vector_top_k_each(rounded, asked(rounded), 5), 5)


@query("j23_parity", f"WITH {_PARITY_SQL} SELECT query, overlap FROM parity")
def j23_parity(spark, sf_dir):
    return parity(spark, sf_dir)


@query("m01_cosine", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def m01_cosine(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(scores.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


@query("s2_retrieval_gate", """WITH hits AS (SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)) SELECT b.item_id, count(h.doc_id) AS found_in, count(h.doc_id) > 0 AS ok FROM benchmark b LEFT JOIN hits h USING (item_id) GROUP BY b.item_id""")
def s2_retrieval_gate(spark, sf_dir):
    """Which benchmark passages stand verbatim in the corpus: the postings of each passage's rarest word name the documents to look into."""
    bench = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage"))
    index = word_index(spark, sf_dir).terms().select("point_id", "term")
    # words at a passage's ends may be parts of longer ones in a document
    inner = F.slice(words.tokens(F.col("passage")), 2, F.greatest(F.size(words.tokens(F.col("passage"))) - 2, F.lit(0)))
    own = bench.select("item_id", F.explode(F.array_distinct(inner)).alias("term"))
    df = index.join(own.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rarest = own.join(df, "term", "left").groupBy("item_id").agg(F.min_by("term", F.struct(F.coalesce("df", F.lit(0)), "term")).alias("term"))
    met = rarest.join(index, "term").select("item_id", F.col("point_id").alias("doc_id"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # a passage of two words or fewer has no inner word: each text is searched for it, in one pass over the texts
    short = F.broadcast(bench.where(F.size(words.tokens(F.col("passage"))) <= 2).agg(F.collect_list(F.struct("item_id", "passage")).alias("short")))
    scanned = docs.crossJoin(short).select("doc_id", F.explode(F.filter("short", lambda x: F.contains(F.col("text"), x["passage"]))).alias("x"))  # one row
    pairs = met.join(bench, "item_id").join(docs, "doc_id").select("item_id", "doc_id", "text", "passage")
    pairs = pairs.where(F.contains("text", F.col("passage"))).select("item_id", "doc_id").unionAll(scanned.select("x.item_id", "doc_id"))
    hits = pairs.groupBy("item_id").agg(F.count(F.lit(1)).alias("found_in"))
    return bench.select("item_id").join(hits, "item_id", "left").select("item_id", F.coalesce("found_in", F.lit(0)).alias("found_in"), F.col("found_in").isNotNull().alias("ok"))


@query("v08_retrieval_gate", f"""{_CHAIN}, {_POOLED} SELECT bool_or(position < 3 AND contains(lower(f.text), 'thing')) AS marker_in_top, bool_and(f.source <> '' AND p.created_at <> '') AS breadcrumb,
  bool_or(position < 3 AND contains(lower(f.text), 'thing')) AND bool_and(f.source <> '' AND p.created_at <> '') AS passed FROM final f JOIN points p USING (point_id)""")  # fmt: skip
def v08_retrieval_gate(spark, sf_dir):
    """A question's expected marker stands in one of its three best passages, and every passage leads back to a source and a date."""
    pts = points(spark, sf_dir, vectors=True)
    hits = retrieval.retrieve(pts, word_index(spark, sf_dir), QUESTION, query_vector(spark, sf_dir), as_of())
    dated = F.broadcast(hits).join(pts.select("point_id", "created_at"), "point_id")
    return retrieval.gate(dated, ["thing"], F.col("created_at"))
