"""Matching entities across sources without common keys."""

from __future__ import annotations

import unicodedata
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch

#: Words of names that tell nothing about whose name it is: titles and articles (fixed values).
EMPTY_WORDS = "the a an of mr mrs ms miss dr sir sgt capt captain sister brother father lady lord judge prof professor inspector rev".split()
#: Letters with marks and the plain letters they are compared as, by rule.
_MARKED = [(c, b) for c in map(chr, range(0xDF, 0x250)) if (b := unicodedata.normalize("NFD", c)[0]) != c and b.isascii()]

#: Names that a block may hold on its smaller side; larger blocks are refined by further words.
BLOCK = 25
#: Names that have a word whose names meet by parts of it within a text, at most; of more frequent words, the words are compared.
RARE = 100
#: Share of the best edge's weight that an edge of two names needs to be compared, and a candidate to stay in the graph.
PRUNE_NAMES, PRUNE = 0.25, 0.5
#: Confidence from which a pair is a match, and the change below which the confidences are stable.
ACCEPT, STABLE = 0.6, 0.01
#: How much of a neighbour's confidence is passed on.
PASS_ON = 0.95
#: How names and texts of a pair agree, with the share of matches expected before any pair was seen: one text with the whole name or a part
#: of it; an unknown text and the only card of that name, or one of several; the whole name in another text; a part of a name in an unknown
#: text, with facts that point to one text or without.
KINDS = {"text": 0.97, "text-part": 0.5, "only": 0.9, "unknown": 0.4, "other": 0.1, "told-part": 0.6, "part": 0.3}
#: Pairs that these expectations, and those on roles, count as beside the graph's own.
EXPECTED = 20.0


def _key(*parts: Column | str) -> Column:
    """128 bits of several texts, as an identity; null counts as empty."""
    return F.unhex(F.md5(F.concat_ws("\0", *(F.coalesce(p, F.lit("")) for p in parts))))


def name_words(name: Column) -> Column:
    """Distinct words of a name, sorted: lower case, without marks, titles, articles, initials and genitives."""
    plain = F.translate(F.lower(name), "".join(c for c, _ in _MARKED), "".join(b for _, b in _MARKED))
    plain = F.regexp_replace(F.regexp_replace(plain, r"['’]s\b", ""), r"[-'’]", "")
    # A short word keeps its full stop: it may stand for a longer one.
    found = F.transform(F.regexp_extract_all(plain, F.lit(r"([\p{L}\p{N}]+\.?)"), 1), lambda w: F.when(F.length(w) > 5, F.rtrim(w, F.lit("."))).otherwise(w))
    kept = F.filter(found, lambda w: (F.length(F.rtrim(w, F.lit("."))) > 1) & ~F.rtrim(w, F.lit(".")).isin(*EMPTY_WORDS))
    return F.array_sort(F.array_distinct(kept))


def close(x: Column, y: Column) -> Column:
    """Do two words (word, df) agree?  Equal, an abbreviation, or equal but for slips of the pen.

    Slips: one edit in short words, two in longer ones, or swapped letters; and one of the two must
    be the much rarer, for two words that are both in use are different words.
    """
    a, b = x["word"], y["word"]
    d = F.levenshtein(a, b)
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    swapped = (F.length(a) == F.length(b)) & ((d == 2) | (d <= 4) & (short >= 8)) & (F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, "")))
    slip = (short >= 3) & ((d <= 1) & (short >= 4) | (d <= 2) & (short >= 5) & (long >= 7) | (d <= 3) & (short >= 11) | swapped)
    few, many = F.least(x["df"], y["df"]), F.greatest(x["df"], y["df"])
    stands_for = lambda p, q: p.endswith(".") & (F.length(q) > F.length(p)) & q.startswith(F.rtrim(p, F.lit(".")))
    return (a == b) | slip & ((few <= 10) | (few <= 0.1 * many)) & ((few <= 2) | (few <= 0.1 * many) | (many <= 100)) | stands_for(a, b) | stands_for(b, a)


def _slips(word: Column) -> Column:
    """The word and, if it is long, the word without each of its letters: words one edit or swap apart share one."""
    cut = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.when(F.length(word) >= 5, F.array_distinct(F.concat(F.array(word), cut))).otherwise(F.array(word))


def _records(df: DataFrame, id_col: str, name: str, roles: str, chunk: str, id_tells_chunk: bool) -> DataFrame:
    """id, nm (sorted words as one text), words, doc (null if unknown), roles (role, state) exploded later."""
    chunks = F.coalesce(F.col(chunk), F.get(F.filter(F.transform(roles, lambda r: r["chunk_id"]), lambda c: c.isNotNull()), 0) if not id_tells_chunk else F.lit(None), F.regexp_extract(id_col, r"^(.*)::", 1) if id_tells_chunk else F.lit(None))
    doc = F.nullif(F.substring_index(chunks, "_", 1), F.lit(""))
    cells = F.transform(F.filter(roles, lambda r: r["role"].isNotNull()), lambda r: F.struct(F.lower(F.trim(r["role"])).alias("role"), F.coalesce(r["states"], F.array()).alias("states")))
    return (
        df.where(F.col(id_col).isNotNull() & F.col(name).isNotNull())
        .select(F.col(id_col).alias("id"), name_words(F.col(name)).alias("words"), doc.alias("doc"), F.coalesce(cells, F.array()).alias("cells"))
        .withColumn("nm", F.array_join("words", " "))
    )


def _block_sizes(rows: DataFrame) -> DataFrame:
    """(key, l, r): names on both sides of every block that has both."""
    return rows.groupBy("key").agg(F.count_if(F.col("side") == 0).alias("l"), F.count_if(F.col("side") == 1).alias("r")).where("l > 0 and r > 0")


def _members(rows: DataFrame, blocks: DataFrame, total: float) -> DataFrame:
    """(side, nm, at, key, w): who is in the blocks, with the blocks' rarity; ``at`` says for which word."""
    return rows.join(blocks.select("key", F.log((total + 1) / (F.col("l") + F.col("r"))).alias("w")), "key").select("side", "nm", "at", "key", "w")


def _near_words(left: DataFrame, right: DataFrame, rarity: DataFrame) -> DataFrame:
    """(word, key): of each word of the right names the words of left names that it may be, itself or one edit or swap apart.

    Words are compared once, not once per pair of names; a key of ``_slips`` has few distinct words.
    """
    said = lambda df, c: df.select(F.explode("words").alias("word")).distinct().join(rarity, "word").select(F.struct("word", "df").alias(c), F.explode(_slips(F.col("word"))).alias("slip"))
    pairs = said(left, "x").join(said(right, "y"), "slip").where(close(F.col("x"), F.col("y")))
    return pairs.select(F.col("y.word").alias("word"), F.col("x.word").alias("key")).distinct()


def _word_blocks(scratch: Scratch, left: DataFrame, right: DataFrame, rarity: DataFrame, total: float, more: DataFrame | None = None) -> DataFrame:
    """Members of blocks of names that share a word, slips allowed, with at most ``BLOCK`` names on the smaller side; ``more``: rows (side, nm, at,
    key) of further blocks of two words that agree, refined alike.

    Only names of which one holds all words of the other can match.  So a larger block is refined by the names' other
    words: two names that match meet under the next word that they share, or one of them has no word left, and
    few distinct names can have exactly the words of a block; these meet all others of it.  What a word in no
    large block could add is met in that word's own block, so only words of large blocks refine, in their order.
    """
    mine = left.select(F.lit(0).alias("side"), "nm", F.explode("words").alias("at")).withColumn("key", F.col("at"))
    theirs = right.select(F.lit(1).alias("side"), "nm", F.explode("words").alias("word")).join(_near_words(left, right, rarity), "word").select("side", "nm", F.col("word").alias("at"), "key")
    rows = mine.unionByName(theirs) if more is None else mine.unionByName(theirs).unionByName(more)
    rows = scratch.cut(rows.withColumn("final", F.lit(False)), "rows-0")
    sizes = scratch.cut(_block_sizes(rows), "blocks-0")
    small, large = F.col("final") | (F.least("l", "r") <= BLOCK), ~F.col("final") & (F.least("l", "r") > BLOCK)
    out = [_members(rows, sizes.where(F.least("l", "r") <= BLOCK), total)]
    # What a name can be refined by: its words that have a large block.
    rows = rows.join(sizes.where(F.least("l", "r") > BLOCK).select("key"), "key")
    options = rows.groupBy("side", "nm").agg(F.collect_set(F.struct(F.col("at").alias("word"), "key")).alias("options"))
    words = left.select(F.lit(0).alias("side"), "nm", "words").unionByName(right.select(F.lit(1).alias("side"), "nm", "words"))
    rows = rows.join(options, ["side", "nm"]).join(words, ["side", "nm"]).withColumn("last", F.col("key")).withColumn("used", F.array("at"))
    held, k = ["side", "nm", "words", "options", "at"], 0
    while True:
        rows = scratch.cut(rows.select(*held, "key", "last", "used"), f"large-{k}")
        if rows.isEmpty():
            return reduce(DataFrame.unionByName, out)
        done = F.concat("key", F.when(F.col("side") == 0, "|=l").otherwise("|=r"))
        met = F.concat("key", F.when(F.col("side") == 0, "|=r").otherwise("|=l"))
        ends = F.explode(F.when(F.size(F.array_except("words", "used")) == 0, F.array(done, met)).otherwise(F.array(met))).alias("key")
        more = rows.withColumn("o", F.explode(F.filter("options", lambda o: (o["key"] > F.col("last")) & ~F.array_contains("used", o["word"]))))
        more = more.select(*held, F.concat_ws("|", "key", "o.key").alias("key"), F.col("o.key").alias("last"), F.array_append("used", F.col("o.word")).alias("used"), F.lit(False).alias("final"))
        k += 1
        finer = scratch.cut(rows.select(*held, ends, "last", "used", F.lit(True).alias("final")).unionByName(more), f"rows-{k}")
        sizes = scratch.cut(_block_sizes(finer), f"blocks-{k}")
        sized = finer.join(sizes, "key")
        out.append(sized.where(small).select("side", "nm", "at", "key", F.log((total + 1) / (F.col("l") + F.col("r"))).alias("w")))
        rows = sized.where(large)


def _text_blocks(scratch: Scratch, left: DataFrame, right: DataFrame, rarity: DataFrame, total: float) -> tuple[DataFrame, DataFrame]:
    """Members of blocks of names of one text that share the beginning or end of a longer, rare word, or less of it beside another word; and rows
    (side, nm, at, key) of blocks of two words of a text that agree.

    The first find slips beyond one edit and add to the weight of names of one text.  In blocks above ``BLOCK``, and for words that more than ``RARE``
    names have, words are compared instead of names, and the names of two words that agree are a block, which ``_word_blocks`` refines
    like any other; so no pair is lost to a block's size.
    """

    def keys(side: int, df: DataFrame) -> DataFrame:
        mine = df.where("doc is not null").select("nm", "doc", "words").distinct().select("nm", "doc", "words", F.explode("words").alias("at")).where(F.length("at") >= 5)
        mine = mine.join(rarity.select(F.col("word").alias("at"), "df"), "at")
        ends = F.array(*(F.concat_ws("|", F.lit(t), "doc", part) for t, part in (("<", F.substring("at", 1, 5)), (">", F.substring(F.reverse("at"), 1, 5)))))
        beside = F.flatten(F.transform(F.array_remove("words", F.col("at")), lambda also: F.array(*(F.concat_ws("|", F.lit(t), F.col("doc"), also, part) for t, part in (("<<", F.substring("at", 1, 2)), (">>", F.substring(F.reverse("at"), 1, 2)))))))
        return mine.select(F.lit(side).alias("side"), "nm", "doc", F.struct(F.col("at").alias("word"), "df").alias("x"), F.explode(F.concat(ends, beside)).alias("key")).distinct()

    rows = scratch.cut(keys(0, left).unionByName(keys(1, right)), "text-rows")
    rare = rows.where(F.col("x.df") <= RARE).select("side", "nm", F.concat(F.lit("@"), "x.word").alias("at"), "key")
    sizes = scratch.cut(_block_sizes(rare), "text-blocks")
    members = _members(rare, sizes.where(F.least("l", "r") <= BLOCK), total)
    # Two rare words of a small block have met there.
    big = sizes.where(F.least("l", "r") > BLOCK).select("key", F.lit(True).alias("big"))
    said = rows.select("side", "doc", "x", "key").distinct()
    both = said.where("side = 0").select("doc", "key", "x").join(said.where("side = 1").select("key", F.col("x").alias("y")), "key").where(F.col("x.word") != F.col("y.word"))
    both = both.join(big, "key", "left").where(F.col("big") | (F.greatest("x.df", "y.df") > RARE)).select("doc", "x", "y").distinct().where(close(F.col("x"), F.col("y")))
    pairs = scratch.cut(both.select("doc", F.col("x.word").alias("x"), F.col("y.word").alias("y")), "text-words")
    # Such a key sorts before every word, so that words refine it.
    key = F.concat_ws("|", F.lit("!"), "doc", "x", "y").alias("key")
    held = rows.select("side", "nm", "doc", F.col("x.word").alias("at")).distinct()
    meet = lambda side, end: held.where(F.col("side") == side).join(pairs.withColumn("at", F.col(end)), ["doc", "at"]).select("side", "nm", "at", key)
    return members, meet(0, "x").unionByName(meet(1, "y"))


def _candidates(scratch: Scratch, left: DataFrame, right: DataFrame, rarity: DataFrame, total: float) -> DataFrame:
    """(left_nm, right_nm): meta-blocking.  The graph of names that share a block, each edge weighted by the rarity of what the two
    names share, word by word, is pruned node by node: an edge stays that has a share of the weight of the best edge at one of its ends."""
    one = lambda df: df.select("nm", "words").dropDuplicates(["nm"])
    in_text, more = _text_blocks(scratch, left, right, rarity, total)
    members = scratch.cut(_word_blocks(scratch, one(left), one(right), rarity, total, more).unionByName(in_text), "members")
    edges = members.where("side = 0").select("key", "w", "at", F.col("nm").alias("left_nm")).join(members.where("side = 1").select("key", F.col("nm").alias("right_nm")), "key")
    edges = edges.repartition("left_nm", "right_nm").groupBy("left_nm", "right_nm", "at").agg(F.max("w").alias("w")).groupBy("left_nm", "right_nm").agg(F.sum("w").alias("w"))
    edges = scratch.cut(edges, "edges")
    best = lambda end: edges.groupBy(end).agg((PRUNE_NAMES * F.max("w")).alias(f"{end}_least"))
    return edges.join(best("right_nm"), "right_nm").join(best("left_nm"), "left_nm").where("w >= right_nm_least or w >= left_nm_least").select("left_nm", "right_nm")


def _name_pairs(scratch: Scratch, left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of distinct names (left_nm, right_nm, weight, whole) that don't contradict each other.

    ``weight`` sums the rarity of the shared words; names with words of their own on both sides are different; ``whole``:
    all words are shared.
    """
    names = left.select("nm", "words").unionByName(right.select("nm", "words")).dropDuplicates(["nm"])
    total = float(names.count())
    rarity = names.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    rarity = scratch.cut(rarity.select("word", "df", F.log((total + 1) / F.col("df")).alias("idf")), "rarity")
    weighed = names.select("nm", F.explode("words").alias("word")).join(rarity, "word").groupBy("nm").agg(F.array_sort(F.collect_list(F.struct("word", "idf", "df"))).alias("ws"))
    weighed = scratch.cut(weighed, "words")
    found = _candidates(scratch, left, right, rarity, total)
    found = found.join(weighed.select(F.col("nm").alias("left_nm"), F.col("ws").alias("lw")), "left_nm").join(weighed.select(F.col("nm").alias("right_nm"), F.col("ws").alias("rw")), "right_nm")
    shared = F.filter("lw", lambda x: F.exists("rw", lambda y: close(x, y)))
    alone = F.size(F.filter("rw", lambda y: ~F.exists("lw", lambda x: close(x, y))))
    found = found.select("left_nm", "right_nm", F.size("lw").alias("n"), shared.alias("shared"), alone.alias("right_alone"))
    found = found.withColumn("left_alone", F.col("n") - F.size("shared")).where("size(shared) > 0 and (left_alone = 0 or right_alone = 0)")
    return found.select("left_nm", "right_nm", F.aggregate("shared", F.lit(0.0), lambda s, x: s + x["idf"]).alias("weight"), ((F.col("left_alone") == 0) & (F.col("right_alone") == 0)).alias("whole"))


def _role_meanings(cards: DataFrame, right: DataFrame, anchors: DataFrame) -> DataFrame:
    """(role, meaning): the role with which a role most often stands for the same thing.

    Learned from the records of one thing: of the ids of one card, and of right records with the
    card of equal name in the same text.  A role without evidence means itself.
    """
    said = cards.select("card", "id", F.explode(F.array_distinct(F.transform("cells", lambda c: c["role"]))).alias("role")).distinct()
    on_card = said.groupBy("card", "role").agg(F.count("*").alias("n")).withColumnRenamed("role", "other")
    inner = on_card.withColumnRenamed("other", "role").join(on_card.select("card", "other"), "card").groupBy("role", "other").agg(F.sum("n").alias("all_n"))
    # A record is no evidence for itself: a role that only one record of a card has doesn't count for that record's roles.
    single = said.join(on_card.where("n = 1").select("card", F.col("other").alias("role")), ["card", "role"]).withColumnRenamed("role", "other")
    solo = single.join(said, ["card", "id"]).groupBy("role", "other").agg(F.count("*").alias("solo"))
    inner = inner.join(solo, ["role", "other"], "left").select("role", "other", (F.col("all_n") - F.coalesce("solo", F.lit(0))).alias("n"))
    alt = right.select(F.col("id").alias("right_id"), F.explode(F.array_distinct(F.transform("cells", lambda c: c["role"]))).alias("role"))
    across = alt.join(anchors, "right_id").join(on_card.select("card", "other"), "card").groupBy("role", "other").agg(F.count("*").alias("n"))
    seen = said.select("role").unionByName(alt.select("role")).groupBy("role").count()
    both = inner.unionByName(across).groupBy("role", "other").agg(F.sum("n").alias("n")).join(seen, "role")
    best = F.row_number().over(Window.partitionBy("role").orderBy(F.desc("n"), (F.col("role") != F.col("other")).cast("int"), "other"))
    top = both.withColumn("rank", best).where("rank = 1 and n >= 2 and n >= 0.15 * count").select("role", F.col("other").alias("first"))
    # What a role means may itself mean a more frequent one.
    again = top.select(F.col("role").alias("first"), F.col("first").alias("second"))
    return top.join(again, "first", "left").select("role", F.coalesce("second", "first").alias("meaning"))


def _spoken(rows: DataFrame, key: str, meanings: DataFrame) -> DataFrame:
    """Distinct (key, role, state) with roles by meaning; state null for the role itself."""
    cells = rows.select(key, F.explode("cells").alias("c")).select(key, "c.role", F.concat(F.array(F.lit(None).cast("string")), F.transform("c.states", lambda s: F.lower(F.trim(s)))).alias("states"))
    return cells.select(key, "role", F.explode("states").alias("state")).distinct().join(meanings, "role", "left").select(key, F.coalesce("meaning", "role").alias("role"), "state").distinct()


#: What is expected of roles of matches and of others before any pair was seen: shares of 0, 1, 2 or more shared roles by how many could
#: be shared (0, 1, 2 or more), and shares of 0, 1, 2 or more shared states where a role is shared.
_ROLES = np.array([[[1, 0, 0], [0.1, 0.9, 0], [0.1, 0.3, 0.6]], [[1, 0, 0], [0.95, 0.05, 0], [0.9, 0.08, 0.02]]])
_STATES = np.array([[0.3, 0.3, 0.4], [0.8, 0.15, 0.05]])


def fit_confidences(counts: np.ndarray, most_steps: int = 5_000) -> np.ndarray:
    """Probability of a match by (kind, roles that could be shared, 3 * roles + states that are), from how many pairs of the graph have these.

    Expectation and maximisation for two hidden classes, matches and others.  Given the class, three things are taken as independent: the
    kind (how names and texts agree), how many roles are shared of those that could be, and how many states are where a role is.  Three such
    views determine the classes without labels.  ``EXPECTED`` pairs of what was expected stand in where the graph says
    little; without pairs the expectation is the result.
    """
    share = expected = np.array(list(KINDS.values()))
    roles, states = _ROLES, _STATES

    def odds() -> np.ndarray:
        # A level without a shared role has no states.
        level = roles[:, :, :, None] * np.where(np.arange(3)[:, None] > 0, states[:, None, None, :], [1.0, 0.0, 0.0])
        yes, no = level.reshape(2, 1, 3, 9) * np.stack([share, 1 - share])[:, :, None, None]
        return yes / np.maximum(yes + no, 1e-300)

    for _ in range(most_steps):
        likely = odds()
        both = np.stack([counts * likely, counts * (1 - likely)])
        before, share = share, (both[0].sum((1, 2)) + EXPECTED * expected) / (counts.sum((1, 2)) + EXPECTED)
        seen = both.sum(1).reshape(2, 3, 3, 3)
        roles, states = seen.sum(3) + EXPECTED * _ROLES, seen[:, :, 1:].sum((1, 2)) + EXPECTED * _STATES
        roles, states = roles / roles.sum(2, keepdims=True), states / states.sum(1, keepdims=True)
        if np.abs(share - before).max() < 1e-9:
            break
    return odds()


def _confidence(facts: DataFrame) -> Column:
    """A pair's confidence by (kind, could, agree); the driver receives one count per combination, 189 at most."""
    counts = np.zeros((len(KINDS), 3, 9))
    for kind, could, agree, n in facts.groupBy("kind", "could", "agree").count().collect():
        counts[kind, could, agree] = n
    fitted = fit_confidences(counts).ravel().tolist()
    return F.get(F.lit(fitted), F.col("kind") * 27 + F.col("could") * 9 + F.col("agree"))


def _of_unknown_text(graph: DataFrame, loose: DataFrame, cards: DataFrame, left_said: DataFrame, right_said: DataFrame) -> DataFrame:
    """Candidates under a part of a name for right records whose text is unknown, as rows of the graph.

    ``loose``: (right_id, left_nm, weight).  Such a pair is kept if card and record share a role with its state, found by an equi-join on name,
    role and state, or if the card's text has a card of the record's whole name.
    """
    said = left_said.where("state is not null").join(cards.select("card", F.col("nm").alias("left_nm")), "card")
    by_fact = loose.join(right_said.where("state is not null"), "right_id").join(said, ["left_nm", "role", "state"]).select("right_id", "card", "weight")
    texts = graph.where("whole and not text_known").join(cards.select("card", "doc"), "card").where("doc is not null").select("right_id", "doc").distinct()
    by_text = loose.join(texts, "right_id").join(cards.select("card", "doc", F.col("nm").alias("left_nm")), ["left_nm", "doc"]).select("right_id", "card", "weight")
    found = by_fact.unionByName(by_text).groupBy("right_id", "card").agg(F.max("weight").alias("weight"))
    best = graph.select("right_id", "weight").unionByName(found.select("right_id", "weight")).groupBy("right_id").agg(F.max("weight").alias("best"))
    found = found.join(best, "right_id").join(cards.select("card", "n_texts"), "card")
    no = F.lit(False)
    return found.select("right_id", "card", no.alias("whole"), "n_texts", no.alias("same_text"), no.alias("text_known"), "weight", "best")


def link_entities(left: DataFrame, right: DataFrame, left_id: str = "id", right_id: str = "alt_id", name: str = "name", roles: str = "roles", chunk: str = "chunk_id") -> DataFrame:
    """Pairs (left id, right id, confidence) of records that describe the same thing, from ``ACCEPT`` on.

    Both sides: an id, a name, roles (array of role, states, chunk_id) and a chunk_id whose part before the
    first underscore names the text.  ``left`` may hold a thing under several ids and an id in several
    rows.  Records without a usable name match nothing; null roles and states count as none; an
    unknown text fits any; other columns are ignored; empty tables give no pairs.

    Collective linkage.  Left records of one text and name are one card.  Candidates: cards and
    right records with compatible names, weighted by the rarity of the words and of the text they
    share; those below ``PRUNE`` of a record's best are cut from the graph.  Where the right record's text is unknown, a part of a
    name counts with a role and its state in common, or beside a card of the whole name in one text.  First confidences
    are probabilities fitted to the graph (``fit_confidences``) from how name, text and roles agree, where roles count by meaning, learned from the graph, too.  Then each pair
    takes over, slightly reduced, the confidence of neighbouring pairs: those of the same right record with
    cards of the same name that share two roles or a role with its state, or of the same text that
    share a role under a partial name.  This goes on until no confidence changes by ``STABLE``.
    """
    scratch = Scratch(left.sparkSession, "linkage")
    lrec = _records(left, left_id, name, roles, chunk, True).withColumn("card", _key("doc", "nm"))
    # Filtered behind the written table: before it, the words would be found once more for the filter.
    lrec = scratch.cut(lrec, "left").where(F.size("words") > 0)
    rrec = scratch.cut(_records(right, right_id, name, roles, chunk, False), "right").where(F.size("words") > 0)
    pairs_of_names = scratch.cut(_name_pairs(scratch, lrec, rrec), "names")

    cards = lrec.groupBy("card", "doc", "nm").agg(F.count("*").alias("n"))
    texts = cards.groupBy("nm").agg(F.count("*").alias("n_texts"))
    cards = scratch.cut(cards.drop("n").join(texts, "nm"), "cards")
    text_rarity = cards.groupBy("doc").agg(F.log((float(cards.count()) + 1) / F.count("*")).alias("text_idf"))

    named = pairs_of_names.join(rrec.select(F.col("nm").alias("right_nm"), F.col("id").alias("right_id"), F.col("doc").alias("right_doc")), "right_nm")
    joined = named.join(cards.withColumnRenamed("nm", "left_nm"), "left_nm").where("whole or doc = right_doc")
    joined = joined.join(text_rarity, "doc", "left").select(
        "right_id", "card", "whole", "n_texts", F.coalesce(F.col("doc") == F.col("right_doc"), F.lit(False)).alias("same_text"), F.col("right_doc").isNotNull().alias("text_known"),
        (F.col("weight") + F.when(F.col("doc") == F.col("right_doc"), F.coalesce("text_idf", F.lit(0.0))).otherwise(0)).alias("weight"),
    )
    best = joined.groupBy("right_id").agg(F.max("weight").alias("best"))
    graph = scratch.cut(joined.join(best, "right_id").where(F.col("weight") >= PRUNE * F.col("best")), "graph-of-names")

    meanings = scratch.cut(_role_meanings(lrec, rrec, graph.where("same_text and whole").select("right_id", "card")), "meanings")
    left_said = scratch.cut(_spoken(lrec, "card", meanings), "left-said")
    right_said = scratch.cut(_spoken(rrec.withColumnRenamed("id", "right_id"), "right_id", meanings), "right-said")
    loose = named.where("not whole and right_doc is null").select("right_id", "left_nm", "weight")
    graph = scratch.cut(graph.unionByName(_of_unknown_text(graph, loose, cards, left_said, right_said)), "graph")
    count = lambda df, key, to: df.where("state is null").groupBy(key).agg(F.count("*").alias(to))
    both = graph.select("right_id", "card").distinct().join(right_said, "right_id").join(left_said.withColumnRenamed("role", "lrole").withColumnRenamed("state", "lstate"), "card").where("role = lrole and state <=> lstate")
    both = both.groupBy("right_id", "card").agg(F.count_if(F.col("state").isNull()).alias("shared"), F.count("state").alias("states"))
    facts = graph.join(both, ["right_id", "card"], "left").join(count(left_said, "card", "n_left"), "card", "left").join(count(right_said, "right_id", "n_right"), "right_id", "left").na.fill(0, ["shared", "states", "n_left", "n_right"])
    few = F.least("n_left", "n_right")
    partial = ~F.col("whole") & ~F.col("same_text")
    told_texts = facts.where(partial & (F.col("states") >= 1)).join(cards.select("card", "doc"), "card").groupBy("right_id").agg(F.count_distinct("doc").alias("fact_texts"))
    facts = facts.join(told_texts, "right_id", "left").na.fill(0, ["fact_texts"])
    # A part of a name in an unknown text may point to a single text by its facts, under the rarer part.
    points = (F.col("states") >= 1) & (F.col("fact_texts") == 1) & (F.col("weight") >= PRUNE * F.col("best"))
    names = list(KINDS)
    at = lambda kind: F.lit(names.index(kind))
    kind = (
        F.when(partial, F.when(points, at("told-part")).otherwise(at("part"))).when(F.col("same_text"), F.when(F.col("whole"), at("text")).otherwise(at("text-part")))
        .when(F.col("text_known"), at("other")).when(F.col("n_texts") == 1, at("only")).otherwise(at("unknown"))
    )
    two_at_most = lambda c: F.least(c, F.lit(2)).cast("int")
    facts = facts.select("right_id", "card", kind.alias("kind"), two_at_most(few).alias("could"), (two_at_most(F.col("shared")) * 3 + two_at_most(F.col("states"))).alias("agree"))
    facts = scratch.cut(facts, "facts")
    # A namesake elsewhere with roles of which none agrees is not talked away by its neighbours.
    listens = ~(F.col("kind").isin(names.index("other"), names.index("unknown")) & (F.col("could") > 0) & (F.col("agree") == 0))
    first = state = facts.select("right_id", "card", _confidence(facts).alias("score"), listens.alias("listens"))

    # Neighbourhoods of cards; a pair passes its confidence on within them.
    known = left_said.join(cards.select("card", "nm", "doc"), "card")
    own_roles = known.where("state is null").select("card", "nm", "doc", "role")
    two = own_roles.join(own_roles.select("card", F.col("role").alias("role2")), "card").where("role < role2").select("card", _key("nm", "role", "role2").alias("hood"))
    with_state = known.where("state is not null").select("card", _key("nm", "role", F.lit(":"), "state").alias("hood"))
    in_text = own_roles.select("card", _key("doc", F.lit("@"), "role").alias("hood"))
    # Only pairs that may gain listen; no contradiction by name is left in the graph.
    may_gain = state.where(F.col("listens") & (F.col("score") + STABLE <= PASS_ON))
    near = graph.join(may_gain.select("right_id").distinct(), "right_id", "left_semi").select("card").distinct()
    hoods = scratch.cut(two.unionByName(with_state).unionByName(in_text).join(near, "card", "left_semi").distinct(), "hoods")
    frontier, k = state.join(may_gain.select("right_id").distinct(), "right_id", "left_semi"), 0
    while True:
        told = frontier.where(F.col("score") >= ACCEPT).join(hoods, "card").groupBy("right_id", "hood").agg((PASS_ON * F.max("score")).alias("told"))
        listening = state.where(F.col("listens") & (F.col("score") + STABLE <= PASS_ON))
        heard = listening.join(hoods, "card").join(told, ["right_id", "hood"]).groupBy("right_id", "card", "score").agg(F.max("told").alias("told"))
        # What moved is stored and speaks next; the others have been heard.
        frontier = scratch.cut(heard.where(F.col("told") - F.col("score") >= STABLE).select("right_id", "card", F.col("told").alias("score")), f"moved-{k}")
        if frontier.isEmpty():
            break
        k += 1
        # All rounds so far as one table: the plan doesn't grow with the rounds.
        moved = left.sparkSession.read.schema(frontier.schema).parquet(*(f"{scratch.base}/moved-{i}" for i in range(k)))
        state = first.unionByName(moved.withColumn("listens", F.lit(True))).groupBy("right_id", "card").agg(F.max("score").alias("score"), F.bool_or("listens").alias("listens"))
    state = scratch.cut(state.where(F.col("score") >= ACCEPT).drop("listens"), "accepted")
    scratch.keep("left", "accepted")
    members = lrec.select("card", F.col("id").alias(left_id)).distinct()
    return state.join(members, "card").groupBy(left_id, F.col("right_id").alias(right_id)).agg(F.round(F.max("score"), 4).alias("confidence"))
