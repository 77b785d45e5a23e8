"""Retrieval: lexical scores, inverted lists, exact vector search, approximate name matching."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import exploded, word_tokens, words
from ..session import Scratch


def top_k(df: DataFrame, by: str, score: str, tie: str, k: int) -> DataFrame:
    """The k best rows per query, ties by ``tie``; limited per partition before the shuffle."""
    w = Window.partitionBy(by).orderBy(F.desc(score), tie)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def bm25(corpus: DataFrame, queries: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, zeros: bool = False) -> DataFrame:
    """Okapi BM25: (query_id, doc_id, score, rank), the ``k`` best with score > 0.

    ``corpus``: doc_id, tokens; ``queries``: query_id, tokens; a token repeated in a query counts as
    often.  idf = ln((N - df + 0.5) / (df + 0.5)), negative ones replaced by epsilon times the mean idf.
    ``zeros``: queries with fewer hits are filled up with texts of score 0, the smallest ids first.

    Document frequencies are counted before the shuffle and stored, one row per word.  Texts keep only the words that
    queries hold and are dealt to blocks, as queries are; where two blocks meet, one task adds up the scores and keeps the k
    best per query.  So no row stands for a text and a query that share a common word, and a common word has no
    partition of its own.  Blocks are bounded by their words (``CORPUS_WORDS``, ``QUERY_WORDS``).  Short texts beyond one
    block come to queries by their rarest words instead (``_by_rare_words``), so that texts and queries don't all meet.
    """
    from . import _vectors

    scratch = Scratch(corpus.sparkSession, "bm25")
    docs = corpus.select("doc_id", "tokens", F.when(F.col("tokens").isNotNull(), F.size("tokens")).alias("len"))
    # One pass: words, and beside them a null word per text that counts texts and their lengths.
    spread_out = docs.select(F.explode_outer(F.array_append(F.array_distinct("tokens"), F.lit(None).cast("string"))).alias("term"), "len")
    counted = scratch.cut(spread_out.groupBy("term").agg(F.count("len").alias("df"), F.sum(F.when(F.col("term").isNull(), F.col("len"))).alias("length")), "df")
    n, length = counted.where("term is null").select("df", "length").first() or (0, 0)
    mean, df = length / n if n else 0.0, counted.where("term is not null").drop("length")
    idf = F.log((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    mean_idf = df.agg(F.avg(idf)).first()[0] or 0.0
    asked = scratch.cut(exploded(queries, ["query_id"], F.col("tokens"), "term").groupBy("query_id", "term").agg(F.count("*").alias("qf")), "asked")
    weights = df.join(asked.select("term").distinct(), "term", "left_semi").select("term", "df", F.when(idf < 0, epsilon * mean_idf).otherwise(idf).alias("idf"))
    weights = scratch.cut(weights.withColumn("tid", F.monotonically_increasing_id()), "weights")
    held, put = weights.agg(F.sum("df")).first()[0] or 0, asked.count()
    said = exploded(docs, ["doc_id", "len"], F.col("tokens"), "term").join(weights.select("term", "tid"), "term").groupBy("doc_id", "len").agg(F.collect_list("tid").alias("tids"))
    asks = asked.join(weights, "term").groupBy("query_id").agg(F.collect_list(F.struct("tid", "qf", "idf")).alias("terms"))
    if held > _vectors.CORPUS_WORDS and held <= _vectors.SHORT * n:
        best = _by_rare_words(scratch, said, asks, weights, n, k, k1, b, mean or 1.0)
    else:
        best = top_k(_vectors.block_scores(said, asks, k, held, put, k1, b, mean or 1.0), "query_id", "score", "doc_id", k)
    return _filled(docs, queries, best, k) if zeros else best


def _by_rare_words(scratch: Scratch, said: DataFrame, asks: DataFrame, weights: DataFrame, n: int, k: int, k1: float, b: float, mean: float) -> DataFrame:
    """The best of ``bm25`` for many short texts, which come to a query by the words they share, from rare ones to common ones.

    Words are rare (kind 2), less rare (1) or common (0).  Texts that share a rare word with a query are scored with all words.  Queries that are equal but for rare words
    are one for texts that share a less rare word, and those equal in common words are one for all texts, of which those of equal common words and equal length are one.
    A text that also shares a rarer word has a lower score there than its own, which it gets where that word leads to it; there it is among the k best or k texts are better.  So
    the best of all lists, each text with its highest score, are the best of all texts.  Words that are not common have positive weights.
    """
    from . import _vectors

    few = n // _vectors.COMMON
    kind = F.when(F.col("df") > few, 0).when(F.col("df") > _vectors.RARE, 1).otherwise(2)
    kinds = weights.select("tid", kind.alias("kind"))
    docs = said.select("doc_id", "len", F.explode("tids").alias("tid")).join(kinds, "tid").groupBy("doc_id", "len").agg(F.sort_array(F.collect_list(F.struct("kind", "tid"))).alias("x"))
    tids = lambda i: F.transform(F.filter("x", lambda t: t["kind"] == i), lambda t: t["tid"]).alias(f"k{i}")
    docs = scratch.cut(docs.select("doc_id", F.col("len").cast("long").alias("len"), *map(tids, range(3))), "texts")
    terms = asks.select("query_id", F.explode("terms").alias("t")).select("query_id", F.col("t.tid").alias("tid"), (F.col("t.qf") * F.col("t.idf")).alias("w")).join(kinds, "tid")
    terms = scratch.cut(terms.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("kind", "tid", "w"))).alias("terms")), "terms")
    shared = scratch.cut(terms.select(F.filter("terms", lambda t: t["kind"] < 2).alias("terms")).distinct().withColumn("sid", F.monotonically_increasing_id()), "shared")
    common = scratch.cut(shared.select(F.filter("terms", lambda t: t["kind"] < 1).alias("common")).distinct().withColumn("rid", F.monotonically_increasing_id()), "common")
    of = scratch.cut(terms.withColumn("all", F.col("terms")).withColumn("terms", F.filter("all", lambda t: t["kind"] < 2)).join(shared, "terms").select(F.monotonically_increasing_id().alias("no"), "query_id", F.col("all").alias("terms"), "sid"), "queries")

    rare = docs.select(F.explode(F.array_distinct("k2")).alias("g"), "doc_id", "len", F.concat("k0", "k1", "k2").alias("tids"))
    leads = lambda kind, df, of: df.select(F.explode(F.filter("terms", lambda t: t["kind"] == kind)).alias("g"), F.col(of).alias("query_id"), "terms").withColumn("g", F.col("g.tid"))
    rows = docs.agg(F.sum(F.size("k2"))).first()[0] or 0
    by_rare = _vectors.rare_scores(rare, leads(2, of, "no"), k, rows, k1, b, mean)

    less = docs.select(F.explode(F.array_distinct("k1")).alias("g"), "doc_id", "len", F.concat("k0", "k1").alias("tids"))
    by_less = _vectors.word_scores(less, leads(1, shared, "sid"), k, few, k1, b, mean)

    # Texts of equal common words and length: the first stands for them.
    first = docs.where(F.size("k0") > 0).withColumn("r", F.row_number().over(Window.partitionBy("k0", "len").orderBy("doc_id"))).where(F.col("r") <= k)
    first = scratch.cut(first.groupBy("k0", "len").agg(F.min("doc_id").alias("doc_id"), F.collect_list("doc_id").alias("ids")), "alike")
    asked = common.where(F.size("common") > 0).select(F.col("rid").alias("query_id"), F.transform("common", lambda t: F.struct(t["tid"].alias("tid"), F.lit(1).cast("long").alias("qf"), t["w"].alias("idf"))).alias("terms"))
    text_words, query_words = first.agg(F.sum(F.size("k0"))).first()[0] or 0, asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    by_common = _vectors.block_scores(first.select("doc_id", "len", F.col("k0").alias("tids")), asked, k, text_words, query_words, k1, b, mean)
    by_common = top_k(by_common, "query_id", "score", "doc_id", k).drop("rank").join(first.select("doc_id", "ids"), "doc_id").select(F.col("query_id").alias("rid"), F.explode("ids").alias("doc_id"), "score")
    by_common = scratch.cut(top_k(by_common, "rid", "score", "doc_id", k).drop("rank"), "by-common")

    def best(df: DataFrame, by: str) -> DataFrame:
        return top_k(df.repartition(by).groupBy(by, "doc_id").agg(F.max("score").alias("score")), by, "score", "doc_id", k)

    place = shared.withColumn("common", F.filter("terms", lambda t: t["kind"] < 1)).join(common, "common").select("sid", "rid")
    of_shared = scratch.cut(best(by_less.withColumnRenamed("query_id", "sid").unionByName(place.join(by_common, "rid").select("sid", "doc_id", "score")), "sid").drop("rank"), "by-shared")
    whole = by_rare.withColumnRenamed("query_id", "no").unionByName(of.select("no", "sid").join(of_shared, "sid").select("no", "doc_id", "score"))
    return scratch.cut(best(whole, "no"), "best").join(of.select("no", "query_id"), "no").select("query_id", "doc_id", "score", "rank")


def _filled(docs: DataFrame, queries: DataFrame, best: DataFrame, k: int) -> DataFrame:
    """``best`` with texts of score 0, the smallest ids first, where a query has fewer than ``k``.

    Of the k smallest ids that a query has not listed, none lies beyond the 2 k smallest of all.
    """
    best = Scratch(docs.sparkSession, "filled").cut(best, "best")
    smallest = [r[0] for r in docs.where(F.col("tokens").isNotNull()).select("doc_id").orderBy("doc_id").limit(2 * k).collect()]
    have = queries.select("query_id").distinct().join(best.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).alias("n")).where(F.col("n") < k)
    more = have.select("query_id", "n", F.explode(F.array(*map(F.lit, smallest)) if smallest else F.array().cast(f"array<{docs.schema['doc_id'].dataType.simpleString()}>")).alias("doc_id")).join(best.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    more = more.withColumn("rank", (F.col("n") + F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id"))).cast("int")).where(F.col("rank") <= k)
    return best.unionByName(more.select("query_id", "doc_id", F.lit(0.0).alias("score"), "rank"))


def entity_search_text(name: str = "name", roles: str = "roles") -> Column:
    """``name - Roles: r: s1, s2 | …`` or ``name - No specific roles``."""
    cell = lambda r: F.concat(F.coalesce(r["role"], F.lit("")), F.when(F.size(F.coalesce(r["states"], F.array())) > 0, F.concat(F.lit(": "), F.array_join(r["states"], ", "))).otherwise(""))
    listed = F.array_join(F.transform(F.coalesce(roles, F.array()), cell), " | ")
    return F.when(F.coalesce(F.size(roles), F.lit(0)) > 0, F.concat(F.coalesce(name, F.lit("")), F.lit(" - Roles: "), listed)).otherwise(F.concat(F.coalesce(name, F.lit("")), F.lit(" - No specific roles")))


def token_search(names: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank): how many words of the query stand in the name, also inside a word; repeated words count as often.

    ``names``: doc_id, name; ``queries``: query_id, tokens.  Names and queries meet in blocks (``field_search``), each of which
    keeps the k best per query: no row stands for a name and a query that share a common word.
    """
    fields = names.where(F.col("name").isNotNull()).select("doc_id", F.array(F.lower("name")).alias("name"))
    scratch = Scratch(names.sparkSession, "fields")
    asked = scratch.cut(exploded(queries, ["query_id"], F.col("tokens"), "token"), "asked")
    return _field_search(scratch, fields, asked, k, {"name": 1.0}).withColumn("score", F.col("score").cast("bigint"))


def _field_search(scratch: Scratch, fields: DataFrame, asked: DataFrame, k: int, weights: dict[str, float], once: float = 0.0) -> DataFrame:
    """The k best of ``field_search`` over all blocks; ``asked``: query_id, token, one row per occurrence."""
    from ._vectors import field_search

    terms = asked.groupBy("query_id", "token").agg(F.count("*").alias("n")).groupBy("query_id").agg(F.collect_list(F.struct("token", "n")).alias("terms"))
    # Stored, for their number decides on the blocks.
    best = field_search(scratch.cut(fields, "fields"), scratch.cut(terms, "terms"), k, weights, once)
    return top_k(best, "query_id", "score", "doc_id", k)


def holders(vocabulary: DataFrame, tokens: DataFrame) -> DataFrame:
    """(token, word): the words of a vocabulary in which a token stands, by equi-joins on letter trigrams.

    A token of three or more letters is met through the trigram that fewest words have, so that common beginnings are no hot keys; shorter
    ones through the words' own one- and two-letter parts.
    """
    grams = lambda c, n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - (n - 1), F.lit(1))), lambda i: F.substring(c, i, F.lit(n))))
    parts = vocabulary.select("word", F.explode(F.array_distinct(F.concat(grams("word", 1), grams("word", 2), grams("word", 3)))).alias("gram"))
    often = parts.where(F.length("gram") == 3).groupBy("gram").agg(F.count("*").alias("n"))
    own = tokens.where(F.length("token") >= 3).select("token", F.explode(grams("token", 3)).alias("gram")).join(often, "gram", "left")
    # A trigram that no word has comes first: the token is in none.
    long = own.groupBy("token").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("gram"))
    short = tokens.where(F.length("token") < 3).select("token", F.col("token").alias("gram"))
    return parts.join(long.unionByName(short), "gram").where(F.contains("word", "token")).select("token", "word").distinct()


def _bare(c: Column | str) -> Column:
    """A name as compared: lower case, outer quotes removed."""
    return F.regexp_replace(F.lower(c), "^\"|\"$", "")


def approximate_matches(mentions: DataFrame, names: DataFrame) -> DataFrame:
    """(mention_id, doc_id): names that contain the mention or stand in it, quotes aside, or share a word.

    ``mentions``: mention_id, mention; ``names``: doc_id, name.  Blank mentions and names match nothing.
    Sharing a word includes most containments, so the pairs come from an equi-join on words; what
    only touches inside words comes through the vocabulary.  Nothing is compared with everything.
    """
    asked = mentions.where(F.trim("mention") != "").select("mention_id", _bare("mention").alias("m"))
    known = names.where(F.trim("name") != "").select("doc_id", _bare("name").alias("nm"))
    mw = asked.select("mention_id", "m", F.explode(F.array_distinct(words("m"))).alias("word"))
    nw = known.select("doc_id", "nm", F.explode(F.array_distinct(words("nm"))).alias("word"))
    shared = mw.select("mention_id", "word").join(nw.select("doc_id", "word"), "word").select("mention_id", "doc_id")
    # A text within another begins inside one of its words: the inner text's first word is the end of it, or all of it within one word.
    inner = holders(nw.select("word").distinct(), mw.select(F.col("word").alias("token")).distinct()).where("token <> word")
    outer = holders(mw.select("word").distinct(), nw.select(F.col("word").alias("token")).distinct()).where("token <> word")
    a = mw.join(inner.withColumnRenamed("word", "w2").withColumnRenamed("token", "word"), "word").join(nw.select("doc_id", "nm", F.col("word").alias("w2")), "w2").where(F.contains("nm", "m"))
    b = nw.join(outer.withColumnRenamed("word", "w2").withColumnRenamed("token", "word"), "word").join(mw.select("mention_id", "m", F.col("word").alias("w2")), "w2").where(F.contains("m", "nm"))
    return shared.unionByName(a.select("mention_id", "doc_id")).unionByName(b.select("mention_id", "doc_id")).distinct()


def matches_ranked(mentions: DataFrame, names: DataFrame, k: int, embed: Callable[[Column], Column]) -> DataFrame:
    """(query_id, doc_id, score, rank): of the names that ``approximate_matches`` finds for a mention the ``k`` best by the cosine of the mention's and the text's
    vectors, as ``cosine_scores`` has it.

    ``mentions``: query_id, mention; ``names``: doc_id, name, text.  Mentions and names meet in blocks, each of which keeps the k best per mention: no row stands
    for a mention and a name that share a common word.
    """
    from ._vectors import match_search

    scratch = Scratch(names.sparkSession, "matches")
    side = lambda df, of, name, text: df.where(F.trim(name) != "").select(of, _bare(name).alias("nm"), F.array_distinct(words(_bare(name))).alias("ws"), embed(F.col(text)).alias("vec"))
    asked, known = scratch.cut(side(mentions, "query_id", "mention", "mention"), "asked"), scratch.cut(side(names, "doc_id", "name", "text"), "known")
    return top_k(match_search(known, asked, k), "query_id", "score", "doc_id", k)


def names_in_queries(queries: DataFrame, names: DataFrame) -> DataFrame:
    """(query_id, doc_id): names that stand in the query as they are, also inside words; for queries without such a name those of
    several words that all stand in it.

    ``queries``: query_id, text; ``names``: doc_id, name; letter case doesn't count, blank names match nothing.  Names are
    met through their rarest word, which must stand in a word of the query; only then texts are compared.
    """
    scratch = Scratch(names.sparkSession, "names")
    known = names.select("doc_id", F.lower("name").alias("nm"), F.array_distinct(words("name")).alias("ws")).where(F.size("ws") > 0)
    spread = known.select("doc_id", F.explode("ws").alias("token"))
    df = spread.groupBy("token").agg(F.count("*").alias("df"))
    rarest = spread.join(df, "token").groupBy("doc_id").agg(F.min_by("token", F.struct("df", "token")).alias("token"))
    asked = queries.where(F.col("text").isNotNull()).select("query_id", F.lower("text").alias("q"))
    mine = asked.select("query_id", F.explode(F.array_distinct(words("q"))).alias("word"))
    inside = holders(mine.select("word").distinct(), rarest.select("token").distinct())
    pairs = mine.join(inside, "word").select("query_id", "token").distinct().join(rarest, "token").join(known, "doc_id").join(asked, "query_id")
    held = F.contains("q", "nm")
    every = (F.size("ws") > 1) & F.forall("ws", lambda w: F.contains(F.col("q"), w))
    found = scratch.cut(pairs.select("query_id", "doc_id", held.alias("held"), every.alias("every")).where("held or every"), "found")
    exact = found.where("held").select("query_id", "doc_id")
    return exact.unionByName(found.where("not held").join(exact.select("query_id").distinct(), "query_id", "left_anti").select("query_id", "doc_id"))


def weighted_search(entities: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank): per query word 1 in the search text, 2 in the name, 1.5 per role and 1 per state
    in which it stands, also inside a word.

    ``entities``: doc_id, name, roles; ``queries``: query_id, tokens; repeated words of a query count once.
    Fields and queries meet in blocks, as in ``token_search``.
    """
    scratch = Scratch(entities.sparkSession, "fields")
    asked = scratch.cut(exploded(queries, ["query_id"], F.array_distinct("tokens"), "token"), "asked")
    lists = lambda x: F.filter(F.coalesce(x, F.array().cast("array<string>")), lambda t: t.isNotNull())
    # A token stands in the search text if it stands in one of its parts, unless it has signs that join these.
    joined = not asked.where(F.col("token").rlike(r"[-:,| ]")).isEmpty()
    text = entity_search_text() if joined else F.when(F.coalesce(F.size("roles"), F.lit(0)) > 0, "Roles").otherwise("No specific roles")
    said = entities.select(
        "doc_id", F.array(F.lower(text)).alias("text"), lists(F.array(F.lower("name"))).alias("name"), lists(F.transform("roles", lambda r: F.lower(r["role"]))).alias("role"),
        lists(F.flatten(F.transform("roles", lambda r: F.coalesce(F.transform(r["states"], lambda s: F.lower(s)), F.array().cast("array<string>"))))).alias("state"),
    )
    return _field_search(scratch, said, asked, k, {"text": 0.0, "name": 2.0, "role": 1.5, "state": 1.0}, 1.0)


def summary_context(found: DataFrame, most: int = 17) -> DataFrame:
    """(query_id, used, context): the best summaries of a query's entities as one text.

    ``found``: query_id, doc_id, name, summary, score.  Blank summaries go; the ``most`` best by score stay, in that
    order, as ``Entity: name``, ``Summary: text``, blank lines between; so a list has a bound.
    """
    kept = top_k(found.where(F.trim("summary") != ""), "query_id", "score", "doc_id", most)
    line = F.concat(F.lit("Entity: "), F.coalesce("name", F.lit("")), F.lit("\nSummary: "), "summary")
    lists = kept.groupBy("query_id").agg(F.count("*").alias("used"), F.array_sort(F.collect_list(F.struct("rank", line.alias("t")))).alias("x"))
    return lists.select("query_id", "used", F.array_join(F.transform("x", lambda s: s["t"]), "\n\n").alias("context"))


def instructed(task: str, query: Column) -> Column:
    """A query as instruction-tuned embedders want it."""
    return F.concat(F.lit(f"Instruct: {task}\nQuery: "), query)


# Vectors


def unit(v: Column) -> Column:
    """The vector at length one; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / norm))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def knn(corpus: DataFrame, queries: DataFrame, k: int, block: int = 2_000, apart: str | None = None) -> DataFrame:
    """Exact cosine neighbours: (query_id, doc_id, score, rank), score > 0; ``corpus``: doc_id, vec; ``queries``: query_id, vec.

    Blocks of at most ``block`` queries meet blocks of the corpus, each meeting one matrix product in one
    task that keeps the k best per query; neither side is held whole anywhere.  A stated set of queries is
    compared with all rows; with ``apart``, a column of both, but for those of an equal value.  Null vectors, and those of another length than most queries of a block, match nothing.
    """
    from ._vectors import block_search

    return block_search(corpus, queries, k, block, apart)


def entity_search(entities: DataFrame, queries: DataFrame, k: int, use_bm25: bool = True, embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): entities by BM25 over their search texts; without it by the vectors that ``embed`` makes of these texts; without both by
    the weighted search of the fields.

    ``entities``: doc_id, name, roles; ``queries``: query_id, text.  Queries that have no vector, or a zero one, go to the weighted search.
    """
    tokens = queries.select("query_id", word_tokens("text").alias("tokens"))
    if use_bm25:
        return bm25(entities.select("doc_id", word_tokens(entity_search_text()).alias("tokens")), tokens, k)
    if embed is None:
        return weighted_search(entities, tokens, k)
    scratch = Scratch(entities.sparkSession, "search")
    asked = scratch.cut(queries.select("query_id", embed(F.col("text")).alias("vec")), "asked").where(F.exists("vec", lambda x: x != 0))
    found = knn(entities.select("doc_id", embed(entity_search_text()).alias("vec")), asked, k).withColumn("query_id", F.col("query_id").cast(queries.schema["query_id"].dataType))
    return found.unionByName(weighted_search(entities, tokens.join(asked.select("query_id"), "query_id", "left_anti"), k))


def cosine_scores(rows: DataFrame, query: str, text: str, embed: Callable[[Column], Column]) -> DataFrame:
    """``rows`` with ``score``, the cosine of two texts' vectors; 0 where one is missing, zero or of another length."""
    scratch = Scratch(rows.sparkSession, "cosine")
    # A text that many rows share gets its vector once.
    vectors = rows.select(F.col(query).alias("t")).unionAll(rows.select(F.col(text).alias("t"))).where("t is not null").distinct()
    vectors = scratch.cut(vectors.select("t", embed(F.col("t")).alias("v")), "vectors").select("t", unit(F.col("v")).alias("v"))
    out = rows.join(vectors.select(F.col("t").alias(query), F.col("v").alias("_a")), query, "left").join(vectors.select(F.col("t").alias(text), F.col("v").alias("_b")), text, "left")
    same = F.size("_a") == F.size("_b")
    return out.select(*rows.columns, F.round(F.coalesce(F.when(same, dot(F.col("_a"), F.col("_b"))), F.lit(0.0)), 6).alias("score"))
