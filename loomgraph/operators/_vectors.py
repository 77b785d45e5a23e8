"""Blockwise exact search: vectors, words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of the corpus in a block.
CORPUS_BLOCK = 20_000
#: Words, of those that queries hold, in a block of texts, and words in a block of queries.
CORPUS_WORDS, QUERY_WORDS = 1_000_000, 500_000
#: Texts are short up to so many words, of those that queries hold.
SHORT = 32
#: Words that at most so many texts have lead to them one by one; those that more than one text in so many has lead to none.
RARE, COMMON = 200, 32
#: Rows of texts in a bucket of rare words; texts of a word in a block; pairs of a query and a text that are scored at once.
RARE_ROWS, WORD_BLOCK, PAIRS = 100_000, 200_000, 200_000
#: Texts with fields in a block.
FIELD_BLOCK = 200_000
#: Names in a block, and mentions in one.
NAME_BLOCK, MENTION_BLOCK = 100_000, 40_000


def _matrix(column: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the given width at length one, and which rows these are."""
    flat = column.combine_chunks()
    good = np.array([v is not None and len(v) == width and None not in v for v in flat.to_pylist()], bool) if flat.null_count or len(set(flat.value_lengths().to_pylist())) > 1 or flat.flatten().null_count else np.full(len(flat), len(flat) == 0 or flat.value_lengths()[0].as_py() == width)
    rows = np.flatnonzero(good)
    m = flat.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width) if width else np.zeros((0, 0))
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1, norm), rows


def block_search(corpus: DataFrame, queries: DataFrame, k: int, block: int, apart: str | None = None) -> DataFrame:
    """Blocks of the corpus meet blocks of queries; each meeting is one matrix product.  Rows of equal ``apart`` are no neighbours."""
    rows, asked = corpus.count(), queries.count()
    group = F.xxhash64(apart).alias("grp") if apart else F.lit(0).cast("long").alias("grp")
    kind = "string" if "string" in (corpus.schema["doc_id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()) else "bigint"
    here, there = max(1, -(-rows // CORPUS_BLOCK)), max(1, -(-asked // block))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n).cast("long")).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    c = corpus.select(F.lit(0).alias("side"), F.col("doc_id").cast(kind).alias("id"), "vec", group).withColumn("cb", deal(here)).select("*", each(there).alias("qb"))
    q = queries.select(F.lit(1).alias("side"), F.col("query_id").cast(kind).alias("id"), "vec", group).withColumn("qb", deal(there)).select("*", each(here).alias("cb"))

    def meet(t: pa.Table) -> pa.Table:
        side = t.column("side").to_numpy()
        mine, theirs = t.filter(pa.array(side == 1)), t.filter(pa.array(side == 0))
        lengths = [n for n in mine.column("vec").combine_chunks().value_lengths().to_pylist() if n]
        width = max(set(lengths), key=lengths.count) if lengths else 0
        a, ra = _matrix(mine.column("vec"), width)
        b, rb = _matrix(theirs.column("vec"), width)
        qgroup, dgroup = mine.column("grp").to_numpy()[ra], theirs.column("grp").to_numpy()[rb]
        # Ids of any type: equal scores are told apart by their order.
        ids = theirs.column("id").combine_chunks().take(pa.array(rb))
        place = np.empty(len(ids), np.int64)
        place[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
        rows, found, scores = [], [], []
        for lo in range(0, len(ra), 500):
            s = np.round(a[lo : lo + 500] @ b.T, 6)
            if apart:
                s[qgroup[lo : lo + 500][:, None] == dgroup] = -2
            # Rows at least as near as the k-th; only these are sorted.
            least = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.zeros(len(s))
            i, j = np.nonzero((s >= least[:, None]) & (s > 0))
            order = np.lexsort((place[j], -s[i, j], i))
            i, j = i[order], j[order]
            keep = np.arange(len(i)) - np.searchsorted(i, i) < k
            rows.append(lo + i[keep])
            found.append(j[keep])
            scores.append(s[i[keep], j[keep]])
        at = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return pa.table({"query_id": mine.column("id").combine_chunks().take(pa.array(ra)).take(pa.array(at(rows))), "doc_id": ids.take(pa.array(at(found))), "score": pa.array(at(scores).astype(np.float64))})

    found = c.unionByName(q).groupBy("cb", "qb").applyInArrow(meet, f"query_id {kind}, doc_id {kind}, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def block_scores(texts: DataFrame, queries: DataFrame, k: int, text_words: int, query_words: int, k1: float, b: float, mean: float) -> DataFrame:
    """(query_id, doc_id, score): the k best texts of each query in each block of texts, score > 0.

    ``texts``: doc_id, len, tids (a word per occurrence); ``queries``: query_id, terms (tid, qf, idf).
    """
    here, there = max(1, -(-text_words // CORPUS_WORDS)), max(1, -(-query_words // QUERY_WORDS))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n).cast("long")).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = lambda kind: F.lit(None).cast(kind)
    doc, query = texts.schema["doc_id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    term = "array<struct<tid:bigint,qf:bigint,idf:double>>"
    t = texts.select(deal("doc_id", here).alias("cb"), "doc_id", none(query).alias("query_id"), F.col("len").cast("long").alias("len"), "tids", none(term).alias("terms")).select("*", each(there).alias("qb"))
    q = queries.select(deal("query_id", there).alias("qb"), none(doc).alias("doc_id"), "query_id", none("bigint").alias("len"), none("array<bigint>").alias("tids"), F.col("terms").cast(term).alias("terms")).select("*", each(here).alias("cb"))
    schema = f"query_id {query}, doc_id {doc}, score double"

    def flat(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
        lists = column.combine_chunks()
        return np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False)), lists.flatten()

    def meet(both: pa.Table) -> pa.Table:
        asks, docs = both.filter(pc.is_valid(both.column("terms"))), both.filter(pc.is_valid(both.column("tids")))
        docs = docs.sort_by("doc_id")  # places of texts are in the order of their ids, which decides between equal scores
        row, tids = flat(docs.column("tids"))
        pair, tf = np.unique(np.stack([tids.to_numpy(zero_copy_only=False), row]), axis=1, return_counts=True) if len(row) else (np.zeros((2, 0), np.int64), np.zeros(0))
        word, place = pair
        share = tf * (k1 + 1) / (tf + k1 * (1 - b + b * docs.column("len").to_numpy()[place] / mean))
        whose, terms = flat(asks.column("terms"))
        tid, qf, idf = (terms.field(c).to_numpy(zero_copy_only=False) for c in ("tid", "qf", "idf"))
        lo, hi = np.searchsorted(word, tid), np.searchsorted(word, tid, "right")
        ends = np.searchsorted(whose, np.arange(len(asks) + 1))
        queries_, places, scores = [], [], []
        for i in range(len(asks)):
            own = range(ends[i], ends[i + 1])
            at = np.concatenate([place[lo[j] : hi[j]] for j in own]) if len(own) else np.zeros(0, np.int64)
            if not len(at):
                continue
            part = np.concatenate([share[lo[j] : hi[j]] * (idf[j] * qf[j]) for j in own])
            if len(at) * 8 < len(docs):
                found, at = np.unique(at, return_inverse=True)
                score = np.bincount(at, part)
            else:
                found, score = np.arange(len(docs)), np.bincount(at, part, len(docs))
            score = np.round(score, 6)
            keep = np.flatnonzero(score > 0 if len(score) <= k else score >= max(np.partition(score, -k)[-k], 1e-7))
            keep = keep[np.argsort(-score[keep], kind="stable")[:k]]
            queries_.append(np.full(len(keep), i))
            places.append(found[keep])
            scores.append(score[keep])
        take = lambda t_, c, x: t_.column(c).combine_chunks().take(pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)))
        return pa.table({"query_id": take(asks, "query_id", queries_), "doc_id": take(docs, "doc_id", places), "score": pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())})

    return t.unionByName(q).groupBy("cb", "qb").applyInArrow(meet, schema)


def _meet(corpus: DataFrame, queries: DataFrame, here: int, there: int) -> DataFrame:
    """Every block of the corpus beside every block of queries, in groups (cb, qb); the sides have different columns, ``doc_id`` and ``query_id`` among them."""
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n).cast("long")).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    c = corpus.select(F.lit(0).alias("side"), "*", deal("doc_id", here).alias("cb")).select("*", each(there).alias("qb"))
    q = queries.select(F.lit(1).alias("side"), "*", deal("query_id", there).alias("qb")).select("*", each(here).alias("cb"))
    return c.unionByName(q, allowMissingColumns=True).groupBy("cb", "qb")


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Which row an item of lists is of, and the items."""
    lists = column.combine_chunks()
    return np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False)), lists.flatten()


class _Inside:
    """Which of some tokens (no blanks in them) stand in a text; pieces between blanks are looked up once."""

    def __init__(self, tokens: list[str]):
        self.at = {t: i for i, t in enumerate(tokens)}
        self.lengths = sorted({len(t) for t in tokens})
        self.pieces: dict[str, tuple[int, ...]] = {}

    def piece(self, x: str) -> tuple[int, ...]:
        found = self.pieces.get(x)
        if found is None:
            at, n = self.at, len(x)
            found = self.pieces[x] = tuple({i for size in self.lengths if size <= n for lo in range(n - size + 1) if (i := at.get(x[lo : lo + size])) is not None})
        return found

    def text(self, x: str) -> set[int]:
        return set().union(*map(self.piece, x.split(" ")))


def _first(part: np.ndarray, k: int) -> np.ndarray:
    """Where the k largest are, the first of equals."""
    at = np.flatnonzero(part >= np.partition(part, -k)[-k]) if len(part) > k else np.arange(len(part))
    return at[np.lexsort((at, -part[at]))[:k]]


def _best(lists: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the k best sums over ``lists`` (places, parts above 0, where its k largest parts are), ties by place; ``total``: zeros, left so.

    What stands in the longest list only is among that list's k largest parts or behind them, so the list is not gone through.  Others
    come in the order of what they can add.  Once k places have more than all later lists could give, no new place is
    taken up, and places that can't reach these k are left out; so the result is the same as over whole lists.
    """
    lists = sorted(lists, key=lambda x: len(x[0]))
    long, parts, top = lists.pop()
    lists.sort(key=lambda x: -x[1][x[2][0]])
    most = [x[1][x[2][0]] for x in lists]
    rest, least, seen, i = sum(most) + parts[top[0]], parts[top[-1]] if len(top) == k else 0.0, [], 0
    while i < len(lists) and rest > least - 1e-5:
        at, part, _ = lists[i]
        total[at] += part
        seen.append(at)
        above = total[at]
        above = above[above > least]
        if len(above) >= k:
            least = np.partition(above, -k)[-k]
        rest, i = rest - most[i], i + 1
    at = np.unique(np.concatenate([long[top], *(at[total[at] + rest >= least - 1e-5] for at in seen)]))
    score = total[at]
    for x in seen:
        total[x] = 0
    for other, part, largest in [*lists[i:], (long, parts, top)]:
        keep = score + rest >= least - 1e-5
        at, score, rest = at[keep], score[keep], rest - part[largest[0]]
        to = np.searchsorted(other, at)
        to[to == len(other)] = 0
        score = score + np.where(other[to] == at, part[to], 0)
    score = np.round(score, 6)
    order = _first(score, k)
    return at[order], score[order]


def field_search(texts: DataFrame, queries: DataFrame, k: int, weights: dict[str, float], once: float = 0.0) -> DataFrame:
    """(query_id, doc_id, score): the k best texts of each query in each block of texts; per token of the query its number times the weights of the fields in which
    it stands, and ``once`` if it stands in any.

    ``texts``: doc_id and a column of texts (array) per weight; ``queries``: query_id, terms (array of token, n), no blanks in tokens.
    Fields and queries meet in blocks; a token is sought in a block's distinct pieces of text, and no row stands for a token in a field.
    """
    here, there = max(1, -(-texts.count() // FIELD_BLOCK)), max(1, -(-(queries.agg(F.sum(F.size("terms"))).first()[0] or 0) // QUERY_WORDS))
    doc, query = texts.schema["doc_id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()

    def meet(both: pa.Table) -> pa.Table:
        side = both.column("side").to_numpy()
        asks, docs = both.filter(pa.array(side == 1)), both.filter(pa.array(side == 0)).sort_by("doc_id")
        whose, terms = _flat(asks.column("terms"))
        said = terms.field("token").dictionary_encode()
        inside, tid = _Inside(said.dictionary.to_pylist()), said.indices.to_numpy(zero_copy_only=False)
        parts = [(*_flat(docs.column(c)), w) for c, w in weights.items()]
        row, weigh = np.concatenate([x[0] for x in parts]), np.repeat([x[2] for x in parts], [len(x[0]) for x in parts])
        kinds = pa.concat_arrays([x[1] for x in parts]).dictionary_encode()
        hits = [inside.text(x) for x in kinds.dictionary.to_pylist()]
        size = np.array([len(x) for x in hits], np.int64)
        token = np.fromiter((t for x in hits for t in x), np.int32, int(size.sum()))
        # Items of the lists of hits, field by field.
        code = kinds.indices.to_numpy(zero_copy_only=False)
        many, first = size[code], np.cumsum(size) - size
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[code], many)
        pair = token[at].astype(np.int64) * max(1, len(docs)) + np.repeat(row, many)
        order = np.argsort(pair, kind="stable")
        pair, weight = pair[order], np.repeat(weigh, many)[order]
        start = np.flatnonzero(np.diff(pair, prepend=-1))
        weight, pair = np.add.reduceat(weight, start) + once if len(start) else weight, pair[start]
        word, place = np.divmod(pair, max(1, len(docs)))
        n = terms.field("n").to_numpy(zero_copy_only=False)
        lo, hi = np.searchsorted(word, tid), np.searchsorted(word, tid, "right")
        tops: dict[int, np.ndarray] = {}
        ends, total = np.searchsorted(whose, np.arange(len(asks) + 1)), np.zeros(len(docs))
        rows, places, scores = [], [], []
        for i in range(len(asks)):
            lists = []
            for j in range(ends[i], ends[i + 1]):
                if hi[j] > lo[j]:
                    part = weight[lo[j] : hi[j]]
                    if (t := int(tid[j])) not in tops:
                        tops[t] = _first(part, k)
                    lists.append((place[lo[j] : hi[j]], part * n[j] if n[j] > 1 else part, tops[t]))
            if lists:
                found, score = _best(lists, k, total)
                rows.append(np.full(len(found), i))
                places.append(found)
                scores.append(score)
        of = lambda t, c, x: t.column(c).combine_chunks().take(pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)))
        return pa.table({"query_id": of(asks, "query_id", rows), "doc_id": of(docs, "doc_id", places), "score": pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())})

    return _meet(texts, queries, here, there).applyInArrow(meet, f"query_id {query}, doc_id {doc}, score double")


def match_search(names: DataFrame, mentions: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score): of the names in each block that a mention matches (``approximate_matches``), the k best by the cosine of the vectors; 0 where one
    is missing, zero or of another length.

    ``names``: doc_id, nm, ws, vec; ``mentions``: query_id, nm, ws, vec; ``nm``: the compared text, ``ws``: its words.
    """
    here, there = max(1, -(-names.count() // NAME_BLOCK)), max(1, -(-mentions.count() // MENTION_BLOCK))
    doc, query = names.schema["doc_id"].dataType.simpleString(), mentions.schema["query_id"].dataType.simpleString()

    def unit(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By length of the vectors: these at length one, and which rows have them."""
        sizes = set(pc.unique(pc.list_value_length(column)).to_pylist()) - {None, 0}
        return {n: _matrix(column, n) for n in sizes}

    def postings(column: pa.ChunkedArray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct words, rows in the order of their words, where a word's rows begin; rows and words of the items."""
        row, items = _flat(column)
        coded = items.dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(code, kind="stable")
        return coded.dictionary.to_pylist(), row[order], np.searchsorted(code[order], np.arange(len(coded.dictionary) + 1)), row, code

    def meet(both: pa.Table) -> pa.Table:
        side = both.column("side").to_numpy()
        asks, docs = both.filter(pa.array(side == 1)), both.filter(pa.array(side == 0)).sort_by("doc_id")
        said, places, start, drow, dcode = postings(docs.column("ws"))
        mwords, mplaces, mstart, mrow, mcode = postings(asks.column("ws"))
        at = {w: i for i, w in enumerate(said)}
        own = [at.get(w, -1) for w in mwords]
        ends = np.searchsorted(mrow, np.arange(len(asks) + 1))
        dfirst, mfirst = np.searchsorted(drow, np.arange(len(docs))), ends[:-1]
        nm, mm = docs.column("nm").to_pylist(), asks.column("nm").to_pylist()
        # A text within another: its first word stands inside a word of the other, at the end of it if a second word follows.
        more: dict[int, list[int]] = {}
        begins: dict[int, list[int]] = {}
        for i in np.flatnonzero(ends[1:] > ends[:-1]):
            begins.setdefault(int(mcode[mfirst[i]]), []).append(int(i))
        tokens = list(begins)
        inside = _Inside([mwords[c] for c in tokens])
        for w, x in enumerate(said):
            for t in inside.piece(x):
                if mwords[tokens[t]] != x:
                    last = x.endswith(mwords[tokens[t]])
                    for i in begins[tokens[t]]:
                        if last or ends[i + 1] - ends[i] == 1:
                            more.setdefault(i, []).extend(int(d) for d in places[start[w] : start[w + 1]] if mm[i] in nm[d])
        begins, count = {}, np.bincount(drow, minlength=len(docs))
        for d in np.flatnonzero(count):
            begins.setdefault(int(dcode[dfirst[d]]), []).append(int(d))
        tokens = list(begins)
        inside = _Inside([said[c] for c in tokens])
        for w, x in enumerate(mwords):
            for t in inside.piece(x):
                if said[tokens[t]] != x:
                    within = [d for d in begins[tokens[t]] if x.endswith(said[tokens[t]]) or count[d] == 1]
                    for i in mplaces[mstart[w] : mstart[w + 1]]:
                        more.setdefault(int(i), []).extend(d for d in within if nm[d] in mm[i])
        a, b = unit(asks.column("vec")), unit(docs.column("vec"))
        hit = np.zeros(len(docs), bool)
        rows, found, scores = [], [], []
        step = max(1, 5_000_000 // max(1, len(docs)))
        for lo in range(0, len(asks), step):
            s = np.zeros((min(step, len(asks) - lo), len(docs)))
            for n in a.keys() & b.keys():
                (x, r), (y, c) = a[n], b[n]
                some = (r >= lo) & (r < lo + len(s))
                if len(c) == len(docs) and some.sum() == len(s):
                    np.matmul(x[some], y.T, out=s)
                else:
                    s[np.ix_(r[some] - lo, c)] = x[some] @ y.T
            for i in range(lo, lo + len(s)):
                for c in mcode[ends[i] : ends[i + 1]]:
                    if own[c] >= 0:
                        hit[places[start[own[c]] : start[own[c] + 1]]] = True
                hit[more.get(i, [])] = True
                j = np.flatnonzero(hit)
                hit[j] = False
                score = np.round(s[i - lo, j], 6)
                best = _first(score, k)
                rows.append(np.full(len(best), i))
                found.append(j[best])
                scores.append(score[best])
        of = lambda t, c, x: t.column(c).combine_chunks().take(pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)))
        return pa.table({"query_id": of(asks, "query_id", rows), "doc_id": of(docs, "doc_id", found), "score": pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())})

    return _meet(names, mentions, here, there).applyInArrow(meet, f"query_id {query}, doc_id {doc}, score double")


def _coded(lists: pa.ChunkedArray, terms: np.ndarray, lengths: np.ndarray, k1: float, b: float, mean: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words as numbers: the words of ``terms``, these as numbers; of the texts' words those among them: (number of the word, text, share in the score), in the order of texts."""
    row, tids = _flat(lists)
    words, code = np.unique(terms, return_inverse=True)
    tids = tids.to_numpy(zero_copy_only=False)
    at = np.searchsorted(words, tids)
    at[at == len(words)] = 0
    held = words[at] == tids if len(words) else np.zeros(len(tids), bool)
    key, tf = np.unique(row[held] * max(1, len(words)) + at[held], return_counts=True)
    row, word = np.divmod(key, max(1, len(words)))
    return words, code, word, row, tf * (k1 + 1) / (tf + k1 * (1 - b + b * lengths[row] / mean))


def rare_scores(texts: DataFrame, queries: DataFrame, k: int, rows: int, k1: float, b: float, mean: float) -> DataFrame:
    """(query_id, doc_id, score): per query and rare word ``g`` of it the k best of the texts that hold it, by all words.

    ``texts``: g, doc_id, len, tids; ``queries``: g, query_id, terms (tid, w).  Every pair that shares the word is scored.
    """
    doc, query = texts.schema["doc_id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    bucket = F.pmod(F.xxhash64("g"), F.lit(max(1, -(-rows // RARE_ROWS))).cast("long")).cast("int").alias("bucket")

    def meet(both: pa.Table) -> pa.Table:
        side = both.column("side").to_numpy()
        asks, docs = both.filter(pa.array(side == 1)), both.filter(pa.array(side == 0)).sort_by([("g", "ascending"), ("doc_id", "ascending")])
        whose, terms = _flat(asks.column("terms"))
        words, code, word, row, share = _coded(docs.column("tids"), terms.field("tid").to_numpy(zero_copy_only=False), docs.column("len").to_numpy(), k1, b, mean)
        key, weight = row * max(1, len(words)) + word, terms.field("w").to_numpy(zero_copy_only=False)
        begin = np.searchsorted(whose, np.arange(len(asks) + 1))
        g = docs.column("g").to_numpy()
        lo, hi = np.searchsorted(g, asks.column("g").to_numpy()), np.searchsorted(g, asks.column("g").to_numpy(), "right")
        size = hi - lo
        ends = np.cumsum(size)
        rows, found, scores = [], [], []
        first = 0
        while first < len(asks):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PAIRS, "right")))
            n = size[first:last]
            q = np.repeat(np.arange(first, last), n)
            d = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[first:last], n)
            score, many = np.zeros(len(q)), begin[q + 1] - begin[q]
            for j in range(int(many.max(initial=0))):
                has = np.flatnonzero(many > j)
                t = begin[q[has]] + j
                want = d[has] * len(words) + code[t]
                at = np.searchsorted(key, want)
                at[at == len(key)] = 0
                hit = key[at] == want
                score[has[hit]] += share[at[hit]] * weight[t[hit]]
            score = np.round(score, 6)
            order = np.lexsort((d, -score, q))
            q, d, score = q[order], d[order], score[order]
            keep = (np.arange(len(q)) - np.searchsorted(q, q) < k) & (score > 0)
            rows.append(q[keep])
            found.append(d[keep])
            scores.append(score[keep])
            first = last
        of = lambda t, c, x: t.column(c).combine_chunks().take(pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)))
        return pa.table({"query_id": of(asks, "query_id", rows), "doc_id": of(docs, "doc_id", found), "score": pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())})

    both = texts.select(F.lit(0).alias("side"), "*").unionByName(queries.select(F.lit(1).alias("side"), "*"), allowMissingColumns=True)
    return both.select("*", bucket).groupBy("bucket").applyInArrow(meet, f"query_id {query}, doc_id {doc}, score double")


def word_scores(texts: DataFrame, queries: DataFrame, k: int, most: int, k1: float, b: float, mean: float) -> DataFrame:
    """(query_id, doc_id, score): per query and word ``g`` of it the k best of the texts that hold it, by all words of the query.

    ``texts``: g, doc_id, len, tids; ``queries``: g, query_id, terms (tid, w, kind); ``most``: texts that a word ``g`` can have.  Words of kind 0 are in so many texts that
    these are alike in them: texts of equal ones and of equal length get their score from these words once, of them the first k count; texts with other words of
    the query get it on top.
    """
    doc, query = texts.schema["doc_id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    here = max(1, -(-most // WORD_BLOCK))

    def meet(both: pa.Table) -> pa.Table:
        side = both.column("side").to_numpy()
        asks, docs = both.filter(pa.array(side == 1)), both.filter(pa.array(side == 0)).sort_by("doc_id")
        rows, found, scores = [], [], []
        if len(asks) and len(docs):
            whose, terms = _flat(asks.column("terms"))
            tid, weight, kind = (terms.field(c).to_numpy(zero_copy_only=False) for c in ("tid", "w", "kind"))
            own = asks.column("g")[0].as_py()
            base = (kind == 0) | (tid == own)
            lengths = docs.column("len").to_numpy()
            words, code, word, row, share = _coded(docs.column("tids"), tid, lengths, k1, b, mean)
            part = np.zeros(len(words), bool)
            part[code[base]] = True
            # Texts alike: equal in the words of the first kind, in the own word and in length, so in each word's share.
            of_part = part[word]
            pos = row[of_part]
            nth = np.arange(len(pos)) - np.searchsorted(pos, pos)
            width = int(nth.max(initial=0)) + 1
            alike = np.full((len(docs), 2 * width + 1), -1.0)
            alike[pos, 2 * nth], alike[pos, 2 * nth + 1], alike[:, -1] = word[of_part], share[of_part], lengths
            _, one, sig = np.unique(np.ascontiguousarray(alike).view(f"V{alike.itemsize * alike.shape[1]}").ravel(), return_index=True, return_inverse=True)
            # Kinds in the order of their first texts.
            turn = np.argsort(one)
            place = np.empty(len(one), np.int64)
            place[turn] = np.arange(len(one))
            one, sig = one[turn], place[sig]
            members = np.argsort(sig, kind="stable")
            starts = np.searchsorted(sig[members], np.arange(len(one) + 1))
            local = np.flatnonzero(part)
            to = np.full(len(words), -1)
            to[local] = np.arange(len(local))
            dense = np.zeros((len(local), len(one)))
            rep = np.full(len(docs), -1)
            rep[one] = np.arange(len(one))
            sel = of_part & (rep[row] >= 0)
            dense[to[word[sel]], rep[row[sel]]] = share[sel]
            # Postings of the other words.
            rest = np.flatnonzero(~of_part)
            rest = rest[np.argsort(word[rest], kind="stable")]
            wlo, whi = np.searchsorted(word[rest], np.arange(len(words))), np.searchsorted(word[rest], np.arange(len(words)), "right")
            wrow, wshare = row[rest], share[rest]
            ends = np.searchsorted(whose, np.arange(len(asks) + 1))
            shapes: dict[bytes, list[int]] = {}
            vectors = []
            for i in range(len(asks)):
                j = np.arange(ends[i], ends[i + 1])
                j = j[base[j]]
                v = np.zeros(len(local))
                v[to[code[j]]] = weight[j]
                if (x := v.tobytes()) not in shapes:
                    shapes[x] = []
                    vectors.append(v)
                shapes[x].append(i)
            step = max(1, 4_000_000 // len(one))
            for at, (v, those) in enumerate(zip(vectors, shapes.values())):
                if at % step == 0:
                    all_ = np.stack(vectors[at : at + step]) @ dense
                alone = all_[at % step]
                best = _first(np.round(alone, 6), k)
                top = np.concatenate([members[starts[x] : min(starts[x] + k, starts[x + 1])] for x in best])
                for i in those:
                    j = np.arange(ends[i], ends[i + 1])
                    j = j[~base[j]]
                    hits = [(wrow[wlo[c] : whi[c]], wshare[wlo[c] : whi[c]] * w) for c, w in zip(code[j], weight[j]) if whi[c] > wlo[c]]
                    if hits:
                        d, back = np.unique(np.concatenate([top, *(x for x, _ in hits)]), return_inverse=True)
                        score = alone[sig[d]] + np.bincount(back, np.concatenate([np.zeros(len(top)), *(x for _, x in hits)]), len(d))
                    else:
                        d = np.sort(top)
                        score = alone[sig[d]]
                    score = np.round(score, 6)
                    keep = _first(score, k)
                    keep = keep[score[keep] > 0]
                    rows.append(np.full(len(keep), i))
                    found.append(d[keep])
                    scores.append(score[keep])
        of = lambda t, c, x: t.column(c).combine_chunks().take(pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)))
        return pa.table({"query_id": of(asks, "query_id", rows), "doc_id": of(docs, "doc_id", found), "score": pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())})

    t = texts.select(F.lit(0).alias("side"), "*", F.pmod(F.xxhash64("doc_id"), F.lit(here).cast("long")).cast("int").alias("cb"))
    q = queries.select(F.lit(1).alias("side"), "*", F.explode(F.sequence(F.lit(0), F.lit(here - 1))).alias("cb"))
    return t.unionByName(q, allowMissingColumns=True).groupBy("g", "cb").applyInArrow(meet, f"query_id {query}, doc_id {doc}, score double")
