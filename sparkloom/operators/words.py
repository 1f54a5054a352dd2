"""The keyword index: positional postings in batches, phrases, query syntax, and exact top-k that leaves common words aside.

Postings (term, point_id, tf, doc_len, positions) are stored in buckets of terms. A forward table knows in which buckets a
point has postings; when a point is stored again, its new postings and one mark for each of its old buckets are a batch of
their own, and earlier batches' postings of a marked point are passed over when the bucket is read. Nothing that is stored is
written again until ``compact``.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions import scores
from sparkloom.session import remove_folder, written
from sparkloom.sources.batches import BatchedTable

WORD = r"((?U)\w+)"
# fixed values
_ACCENTED, _PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def folded(text: Column) -> Column:
    """Lower case; the accents of western European letters are folded as the keyword index does."""
    return F.translate(F.lower(F.coalesce(text, F.lit(""))), _ACCENTED, _PLAIN)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(folded(text), F.lit(WORD), F.lit(1))


def query_terms_in_order(question: str) -> list[str]:
    return re.findall(r"\w+", question.lower().translate(str.maketrans(_ACCENTED, _PLAIN)))


def query_terms(question: str) -> list[str]:
    return list(dict.fromkeys(query_terms_in_order(question)))


def postings(points: DataFrame, id_col: str = "point_id", text_col: str = "text") -> DataFrame:
    """(term, point_id, tf, doc_len, positions) of each term of each text."""
    return _of_words(points.select(F.col(id_col).alias("point_id"), tokens(F.col(text_col)).alias("words")))


def _of_words(words: DataFrame, *deal: Column) -> DataFrame:
    flat = words.select("point_id", F.size("words").alias("doc_len"), F.posexplode("words").alias("at", "term"))
    if deal:  # grouped where it will be stored, so that words are shuffled once
        flat = flat.withColumn("bucket", *deal).repartition("bucket")
    keys = ["bucket"] if deal else []
    return flat.groupBy(*keys, "term", "point_id").agg(F.count(F.lit(1)).alias("tf"), F.first("doc_len").alias("doc_len"), F.sort_array(F.collect_list("at")).alias("positions"))


class Index:
    """Stored postings, the forward table, the largest impact of each term, and the number and length of points."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        path = path.rstrip("/")
        self.spark = spark
        self.postings = BatchedTable(spark, f"{path}/postings", "term string, point_id long, tf long, doc_len int, positions array<int>, gone boolean", "term", buckets)
        self.forward = BatchedTable(spark, f"{path}/forward", "point_id long, doc_len int, buckets array<int>, gone boolean", "point_id", buckets)
        self.sizes = BatchedTable(spark, f"{path}/sizes", "n long, total long", "n", 1)
        self.impacts = BatchedTable(spark, f"{path}/impacts", "term string, most_tf long, least_len int", "term", buckets)

    def _points(self, ids: DataFrame, before: int) -> DataFrame | None:
        """What earlier batches have stored of some points (point_id); None if there are no earlier ones."""
        if not any(n < before for n, _ in self.forward.folders()):
            return None
        near = sorted(r[0] for r in ids.select(self.forward.bucket("point_id")).distinct().collect())  # as many as there are buckets, at most
        last = self.forward.read(near, before).join(ids, "point_id", "left_semi").groupBy("point_id").agg(F.max_by(F.struct("doc_len", "buckets", "gone"), "batch").alias("x"))
        return last.select("point_id", "x.*").where("not gone")

    def add(self, batch: int, points: DataFrame, gone: DataFrame | None = None, text_col: str = "text") -> None:
        """Stores points (point_id and text, one row each) in place of their former versions and takes out those of ``gone`` (point_id).

        A null text has no words. A batch that runs again, whole or in part, leaves the index as one run does: whatever it
        stores follows from its rows and from earlier batches alone.
        """
        words, folder = written(points.select("point_id", tokens(F.col(text_col)).alias("words")), "words")
        gone = (gone.select("point_id").distinct() if gone is not None else words.select("point_id").limit(0)).join(words.select("point_id"), "point_id", "left_anti")
        old = self._points(words.select("point_id").unionAll(gone), batch)
        own = F.array_distinct(F.transform("words", lambda w: self.postings.bucket(w)))
        self.forward.put(batch, words.select("point_id", F.size("words").alias("doc_len"), own.alias("buckets"), F.lit(False).alias("gone"))
                         .unionAll(gone.select("point_id", F.lit(0), F.array().cast("array<int>"), F.lit(True))))
        new = _of_words(words, self.postings.bucket("term")).withColumn("gone", F.lit(False))
        size = words.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("words")), F.lit(0)).alias("total"))
        if old is not None:
            new = new.unionByName(old.select("point_id", F.explode("buckets").alias("bucket"), F.lit(True).alias("gone")), allowMissingColumns=True)
            size = size.unionAll(old.agg(-F.count(F.lit(1)), -F.coalesce(F.sum("doc_len"), F.lit(0)))).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        self.postings.put(batch, new, dealt=old is None)
        stored = self.postings.read().where((F.col("batch") == batch) & ~F.col("gone"))
        self.impacts.put(batch, stored.groupBy("bucket", "term").agg(F.max("tf").alias("most_tf"), F.min("doc_len").alias("least_len")))
        self.sizes.put(batch, size)
        remove_folder(self.spark, folder)

    def _live(self, rows: DataFrame) -> DataFrame:
        """Postings without those of points that a later batch has stored again or taken out."""
        columns = ["term", "point_id", "tf", "doc_len", "positions", "bucket"]
        if len(self.postings.folders()) < 2:
            return rows.where("not gone").select(columns)
        marks = rows.where("gone").groupBy("bucket", "point_id").agg(F.max("batch").alias("since"))
        return rows.where("not gone").join(marks, ["bucket", "point_id"], "left").where("since is null or batch >= since").select(columns)

    def terms(self) -> DataFrame:
        return self._live(self.postings.read())

    def of(self, terms: Sequence[str]) -> DataFrame:
        """The postings of some terms; buckets are worked out by Spark once, so that only their folders are listed."""
        if not terms:
            return self.terms().limit(0)
        wanted = self.spark.range(1).select(F.explode(F.array(*(F.lit(t) for t in terms))).alias("t")).select(self.postings.bucket("t"))
        rows = self.postings.read(sorted({r[0] for r in wanted.collect()}))
        return self._live(rows.where(F.col("term").isin(*terms) | F.col("gone")))

    def starting(self, prefix: str) -> DataFrame:
        """The postings of terms that begin with a text; row groups without such terms are passed over."""
        return self._live(self.postings.read().where(F.startswith("term", F.lit(prefix)) | F.col("gone")))

    def stats(self) -> DataFrame:
        """n, mean_len: one row."""
        return self.sizes.read().agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), (F.sum("total") / F.sum("n")).alias("mean_len"))

    def compact(self) -> None:
        """All batches as one; later batches follow it."""
        latest = F.max_by(F.struct("doc_len", "buckets", "gone"), "batch").alias("x")
        self.postings.merge(lambda rows: self._live(rows).withColumn("gone", F.lit(False)))
        self.forward.merge(lambda rows: rows.groupBy("point_id", "bucket").agg(latest).select("point_id", "bucket", "x.*").where("not gone"))
        self.sizes.merge(lambda rows: rows.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("total").alias("total")))
        self.impacts.merge(lambda rows: rows.groupBy("bucket", "term").agg(F.max("most_tf").alias("most_tf"), F.min("least_len").alias("least_len")))


def phrase_hits(rows: DataFrame, words: Sequence[str]) -> DataFrame:
    """(point_id, tf, doc_len): where the words stand side by side, and how often, from their postings alone."""
    held = rows.groupBy("point_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at"), F.first("doc_len").alias("doc_len")).where(F.size("at") == len(set(words)))
    shifted = lambda word, by: F.transform(F.element_at("at", F.lit(word)), lambda p: p - by)
    starts = shifted(words[0], 0)
    for k, word in enumerate(words[1:], 1):
        starts = F.array_intersect(starts, shifted(word, k))
    return held.select("point_id", F.size(starts).cast("long").alias("tf"), "doc_len").where("tf > 0")


class Unreadable(ValueError):
    """A query that is not in the syntax."""


_LEXEME = re.compile(r'\s*(?:("(?:[^"]|"")*")|(\w+)|([()*]))')


def parse(query: str) -> tuple:
    """AND, OR, NOT, "phrases", prefix* and brackets as a tree: ("word" | "prefix", term), ("phrase", terms), ("and" | "or" | "not", left, right).

    Words side by side are all wanted, which binds tightest; then NOT, AND and OR.
    """
    found, at = [], 0
    query = query.rstrip()
    while at < len(query):
        m = _LEXEME.match(query, at)
        if not m:
            raise Unreadable(query)
        text, word, sign = m.groups()
        found.append(("text", text[1:-1].replace('""', '"')) if text is not None else ("sign", sign or word) if sign or word in ("AND", "OR", "NOT") else ("text", word))
        at = m.end()
    if not found:
        raise Unreadable(query)
    found.reverse()
    sees = lambda *signs: bool(found) and found[-1][0] == "sign" and found[-1][1] in signs

    def atom() -> tuple:
        if not found:
            raise Unreadable(query)
        kind, value = found.pop()
        if kind == "sign":
            if value != "(":
                raise Unreadable(query)
            inner = level(0)
            if not sees(")"):
                raise Unreadable(query)
            found.pop()
            return inner
        terms = query_terms_in_order(value)
        if sees("*"):
            found.pop()
            if len(terms) != 1:
                raise Unreadable(query)
            return ("prefix", terms[0])
        return ("word", terms[0]) if len(terms) == 1 else ("phrase", tuple(terms))

    def level(depth: int) -> tuple:
        if depth == 3:
            left = atom()
            while found and (found[-1][0] == "text" or sees("(")):
                left = ("and", left, atom())
            return left
        sign = ("OR", "AND", "NOT")[depth]
        left = level(depth + 1)
        while sees(sign):
            found.pop()
            left = (sign.lower(), left, level(depth + 1))
        return left

    tree = level(0)
    if found:
        raise Unreadable(query)
    return tree


def read_query(query: str) -> tuple:
    """The query's tree; one that is not in the syntax is a phrase as a whole."""
    try:
        return parse(query)
    except Unreadable:
        return ("phrase", tuple(query_terms_in_order(query)))


def _leaves(tree: tuple) -> list[tuple]:
    if tree[0] in ("and", "or", "not"):
        return list(dict.fromkeys(_leaves(tree[1]) + _leaves(tree[2])))
    return [tree]


def match(index: Index, tree: tuple) -> DataFrame:
    """(point_id, matched, bm25) of the points that a query's tree holds for; matched: how many of its leaves a point has.

    All leaves are read from the postings of their own terms; a point's leaves meet in one aggregation, on which the tree is
    a condition. Each leaf is weighed like a term, with its own number of points.
    """
    leaves = _leaves(tree)
    words = index.of(sorted({t for kind, x in leaves if kind != "prefix" for t in ((x,) if kind == "word" else x)}))
    hits = None
    for k, (kind, x) in enumerate(leaves):
        if kind == "prefix":
            rows = index.starting(x).groupBy("point_id").agg(F.sum("tf").alias("tf"), F.first("doc_len").alias("doc_len"))
        elif kind == "word":
            rows = words.where(F.col("term") == x).select("point_id", "tf", "doc_len")
        else:
            rows = phrase_hits(words.where(F.col("term").isin(*x)), x) if x else words.limit(0).select("point_id", "tf", "doc_len")
        rows = rows.select("point_id", F.lit(k).alias("leaf"), "tf", "doc_len")
        hits = rows if hits is None else hits.unionAll(rows)
    held = lambda node: F.array_contains("held", leaves.index(node)) if node in leaves else held(node[1]) & (~held(node[2]) if node[0] == "not" else held(node[2])) if node[0] != "or" else held(node[1]) | held(node[2])
    df = hits.groupBy("leaf").agg(F.count(F.lit(1)).alias("df"))
    met = hits.join(F.broadcast(df), "leaf").crossJoin(F.broadcast(index.stats()))  # as many rows as leaves, and one
    part = scores.bm25_term(scores.idf(F.col("n"), F.col("df")), F.col("tf"), F.col("doc_len"), F.col("mean_len"))
    # summed in the order of the leaves, so that the last digit does not depend on partitions
    parts = F.array_sort(F.collect_list(F.struct("leaf", part.alias("x"))))
    total = F.aggregate(parts, F.lit(0.0), lambda done, x: done + x["x"])
    points = met.groupBy("point_id").agg(F.count(F.lit(1)).cast("int").alias("matched"), F.collect_set("leaf").alias("held"), F.round(total, 9).alias("bm25"))
    return points.where(held(tree)).select("point_id", "matched", "bm25")


def _every(terms: Sequence[str], sign: str) -> tuple:
    tree: tuple = ("word", terms[0])
    for t in terms[1:]:
        tree = (sign, tree, ("word", t))
    return tree


def _best(hits: DataFrame, k: int) -> DataFrame:
    return hits.orderBy(F.desc("bm25"), "point_id").limit(k)


def keyword_search(index: Index, question: str, k: int, or_fallback: bool = True) -> DataFrame:
    """(point_id, matched, bm25) of the k best points for a query in the syntax, or for its words as a phrase.

    If fewer than k are found and the points with any of its words give more, these are the list.
    """
    tree, terms = read_query(question), query_terms(question)
    if not terms:
        return _best(match(index, ("phrase", ())), k)
    if not or_fallback or len(terms) == 1:
        return _best(match(index, tree), k)
    if tree == _every(query_terms_in_order(question), "and"):
        # the k best of either kind are enough to decide between the two lists, so the scores are computed once
        hits = match(index, _every(terms, "or")).withColumn("every", F.col("matched") == len(terms))
    else:
        hits = match(index, tree).withColumn("every", F.lit(True)).unionAll(match(index, _every(terms, "or")).withColumn("every", F.lit(False)))
        hits = hits.select("point_id", "matched", "bm25", "every")
        few = _ranked_lists(hits, k).withColumn("n_any", F.least(F.count_if(~F.col("every")).over(Window.partitionBy()), F.lit(k)))
        return _best(few.where(F.col("every") == ((F.col("n_all") >= k) | (F.col("n_any") <= F.col("n_all")))).select("point_id", "matched", "bm25"), k)
    few = _ranked_lists(hits, k).withColumn("n_any", F.least(F.count(F.lit(1)).over(Window.partitionBy()), F.lit(k)))
    return _best(few.where(F.col("every") | ((F.col("n_all") < k) & (F.col("n_any") > F.col("n_all")))).select("point_id", "matched", "bm25"), k)


def _ranked_lists(hits: DataFrame, k: int) -> DataFrame:
    """The k best of those with and without ``every``, and how many there are with it; 2 k rows."""
    nth = F.row_number().over(Window.partitionBy("every").orderBy(F.desc("bm25"), "point_id"))
    few = hits.withColumn("nth", nth).where(F.col("nth") <= k)
    return few.withColumn("n_all", F.count_if("every").over(Window.partitionBy()))


def keyword_search_each(index: Index, asked: DataFrame, k: int) -> DataFrame:
    """(query, point_id, bm25, n): the k best points by BM25, with any of its words, for each of many questions (query, text).

    A word's stored largest impact bounds what it can add. Each question's rarest words, up to some 4 k postings, give a lower
    bound of its k-th best score; the words whose bounds together stay below it lift no point by themselves, so only the others
    (few postings) make candidates, and the common words are looked up for these candidates alone. The result is exact.
    """
    met, scored = _bounded(index, asked, k)
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bm25"), "point_id"))
    return scored.withColumn("n", nth).where(F.col("n") <= k)


def _bounded(index: Index, asked: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """The words that make candidates (query, term, df), and (query, point_id, bm25) of all points that may be among the k best."""
    words = asked.select("query", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    own = index.terms().join(words.select("term").distinct(), "term", "left_semi").select("term", "point_id", "tf", "doc_len")
    df = own.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    impact = index.impacts.read().groupBy("term").agg(F.max("most_tf").alias("most_tf"), F.min("least_len").alias("least_len"))
    weighed = words.join(df, "term").join(impact, "term").crossJoin(F.broadcast(index.stats()))  # one row
    idf = scores.idf(F.col("n"), F.col("df"))
    bound = scores.bm25_term(idf, F.col("most_tf"), F.col("least_len"), F.col("mean_len")) * (1 + 1e-9) + 1e-8
    by_df = Window.partitionBy("query").orderBy("df", "term")
    up_to = by_df.rowsBetween(Window.unboundedPreceding, -1)
    weighed = weighed.select("query", "term", "df", "n", "mean_len", bound.alias("bound")).withColumn("seeds", F.coalesce(F.sum("df").over(up_to), F.lit(0)) < 4 * k)
    weighed, folder = written(weighed, "bounds")

    def parts(chosen: DataFrame, on: list[str], rows: DataFrame) -> DataFrame:
        met = chosen.join(rows, on)
        part = scores.bm25_term(scores.idf(F.col("n"), F.col("df")), F.col("tf"), F.col("doc_len"), F.col("mean_len"))
        return met.select("query", "point_id", F.round(part, 9).cast("decimal(18,9)").alias("part"))

    summed = parts(weighed.where("seeds"), ["term"], own).groupBy("query", "point_id").agg(F.sum("part").alias("part"))
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("part"), "point_id"))
    least = summed.withColumn("nth", nth).where(F.col("nth") == k).select("query", F.col("part").cast("double").alias("least"))
    # words by rising bound: those whose sum stays below the k-th best are left aside
    below = F.sum("bound").over(Window.partitionBy("query").orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    judged = weighed.join(least, "query", "left").withColumn("aside", (below < F.col("least")) & F.col("least").isNotNull())
    judged = judged.withColumn("rest", F.coalesce(F.sum(F.when(F.col("aside"), F.col("bound"))).over(Window.partitionBy("query")), F.lit(0.0)))
    makers = judged.where("not aside")
    first = parts(makers, ["term"], own).groupBy("query", "point_id").agg(F.sum("part").alias("part"))
    limits = judged.groupBy("query").agg(F.max("rest").alias("rest"), F.max("least").alias("least"))
    candidates = first.join(limits, "query").where("least is null or part + rest >= least").select("query", "point_id", "part")
    lookups = candidates.select("query", "point_id").join(judged.where("aside"), "query")
    more = parts(lookups, ["term", "point_id"], own).groupBy("query", "point_id").agg(F.sum("part").alias("more"))
    scored = candidates.join(more, ["query", "point_id"], "left").select("query", "point_id", (F.col("part") + F.coalesce("more", F.lit(0).cast("decimal(18,9)"))).cast("double").alias("bm25"))
    return makers.select("query", "term", "df"), scored


def _marked(index: Index, asked: DataFrame, k: int) -> DataFrame:
    """(query, point_id, bm25, n): the k best points that hold all words of a question of words, or the phrase of another one.

    Candidates are the postings of a question's rarest word; its other words are looked up for these alone.
    """
    order = tokens(F.col("text"))
    plain = F.col("text").rlike(r"^(?U)[\w\s]*$") & ~F.col("text").rlike(r"\b(AND|OR|NOT)\b")
    asked = asked.select("query", order.alias("order"), plain.alias("plain")).where(F.size("order") > 0)
    words = asked.select("query", F.explode(F.array_distinct("order")).alias("term"))
    own = index.terms().join(words.select("term").distinct(), "term", "left_semi").select("term", "point_id", "tf", "doc_len", "positions")
    df = own.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    known = words.join(df, "term")
    rarest = known.groupBy("query").agg(F.min_by("term", F.struct("df", "term")).alias("rarest"), F.count(F.lit(1)).alias("known"))
    whole = asked.join(rarest, "query").where(F.size(F.array_distinct("order")) == F.col("known"))  # a word that no point has: none has all
    begun = whole.select("query", F.col("rarest").alias("term")).join(own.select("term", "point_id"), "term").select("query", "point_id")
    met = begun.join(known, "query").join(own, ["term", "point_id"]).crossJoin(F.broadcast(index.stats()))  # one row
    part = F.round(scores.bm25_term(scores.idf(F.col("n"), F.col("df")), F.col("tf"), F.col("doc_len"), F.col("mean_len")), 9).cast("decimal(18,9)")
    held = met.groupBy("query", "point_id").agg(F.count(F.lit(1)).alias("held"), F.sum(part).alias("sum"), F.first("doc_len").alias("doc_len"), F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at"))
    held = held.join(whole, "query").where("held = known")
    at = lambda i: F.element_at("at", F.element_at("order", i + 1))
    starts = F.aggregate(F.sequence(F.lit(0), F.size("order") - 1), at(F.lit(0)), lambda done, i: F.array_intersect(done, F.transform(at(i), lambda p: p - i)))
    held = held.withColumn("times", F.when(~F.col("plain"), F.size(starts))).where("plain or times > 0")
    same = held.where("not plain").groupBy("query").agg(F.count(F.lit(1)).alias("df"))
    held = held.join(same, "query", "left").crossJoin(F.broadcast(index.stats()))  # one row
    phrase = F.round(scores.bm25_term(scores.idf(F.col("n"), F.col("df")), F.col("times"), F.col("doc_len"), F.col("mean_len")), 9)
    scored = held.select("query", "point_id", F.when(F.col("plain"), F.col("sum").cast("double")).otherwise(phrase).alias("bm25"))
    return scored.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bm25"), "point_id"))).where(F.col("n") <= k)


def keyword_lists(index: Index, asked: DataFrame, k: int) -> DataFrame:
    """(query, point_id, bm25, n): keyword_search() for each of many questions (query, text) without syntax."""
    every, any_ = _marked(index, asked, k), keyword_search_each(index, asked, k)
    both = every.withColumn("every", F.lit(True)).unionAll(any_.select("query", "point_id", "bm25", "n").withColumn("every", F.lit(False)))
    n_words = asked.select("query", F.size(F.array_distinct(tokens(F.col("text")))).alias("words"))
    mine = Window.partitionBy("query")
    judged = both.join(n_words, "query").withColumns({"n_all": F.count_if("every").over(mine), "n_any": F.count_if(~F.col("every")).over(mine)})
    own = (F.col("words") < 2) | (F.col("n_all") >= k) | (F.col("n_any") <= F.col("n_all"))
    return judged.where(F.col("every") == own).select("query", "point_id", "bm25", "n")
