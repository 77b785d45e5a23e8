import base64
import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgraph.llm import packing, splitting
from loomgraph.llm.mixing import mix_sources
from loomgraph.llm.tokens import PATTERN, Sizer, VOCABULARY, count_tokens, read_vocabulary


@pytest.fixture(scope="module")
def size():
    return Sizer(read_vocabulary())


@pytest.fixture(scope="module")
def encode():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


ALPHABET = st.text(st.one_of(st.sampled_from("ab .\n\r\t'sté½²Ⅷ一二。！  \x1c_3-"), st.characters(exclude_categories=("Cs",))), max_size=60)


@settings(max_examples=300, deadline=None)
@given(ALPHABET)
def test_counts_are_the_tokenizers(size, encode, text):
    assert size.count(text) == len(encode(text))


@settings(max_examples=200, deadline=None)
@given(st.lists(ALPHABET, max_size=12).map("".join), st.sampled_from([(8, 2), (16, 0), (12, 5)]))
def test_pieces_make_up_the_text(size, encode, text, limit):
    t = splitting.read_texts([text], splitting.Units(size))[0]
    if not text:
        return
    assert t.tokens(0, len(t.starts) - 1) == len(encode(text))
    (got,) = t.pieces([limit])
    assert "".join(text[t.starts[b] : t.starts[c]] for _, b, c, _ in got) == text
    for i, (a, b, c, n) in enumerate(got):
        piece = text[t.starts[a] : t.starts[c]]
        assert n == len(encode(piece)) and (n <= limit[0] or c - b == 1)
        assert a <= b and (i == 0) <= (a == 0)
        assert len(encode(text[t.starts[a] : t.starts[b]])) <= limit[1] + 1 or not limit[1]


def cuts(text, size, limit=(24, 0)):
    t = splitting.read_texts([text], splitting.Units(size))[0]
    (got,) = t.pieces([limit])
    return [text[t.starts[b] : t.starts[c]] for _, b, c, _ in got]


def test_natural_boundaries_win(size):
    a, b = "The judge found the key near the mill. It was late and dark there.", "She sold the letter at the station. Nobody had seen the clerk."
    assert cuts(f"{a}\n\n{b}", size)[0] == a + "\n\n"
    assert cuts(f"{a}\r\n{b}", size)[0] == a + "\r\n"
    assert cuts(f"{a} {b}", size)[0] == a
    text = "We went with Dr. Smith and Prof. B. Jones to see z. B. the old mill at 3.5 miles from there in the late rain of May"
    t = splitting.read_texts([text], splitting.Units(size))[0]
    assert {t.strength[t.starts.index(text.index(w))] for w in (" Smith", " B.", " Jones", " the old", " miles")} == {splitting.WORD}
    assert all(x[0] == " " or i == 0 for i, x in enumerate(cuts("word " * 60, size)))
    wide = "他走了很远的路。" * 12
    assert all(x.endswith("。") for x in cuts(wide, size))
    assert "".join(cuts("x" * 5000, size)) == "x" * 5000


def test_split_texts(spark):
    docs = spark.createDataFrame([(1, "A short one.", "a"), (2, None, "b"), (3, "", "c"), (4, "One two three. " * 400, "d"), (4, "One two three. " * 400, "d")], "doc_id long, text string, limit_name string")
    limits = spark.createDataFrame([("s", 64, 8), ("l", 256, None)], "limit_name string, max_tokens int, overlap_tokens int")
    rows = splitting.split_texts(docs, "doc_id", "text", limits).collect()
    assert {(r.limit_name, r.doc_id) for r in rows} == {("s", 4), ("l", 4)}
    for r in rows:
        assert r.n_tokens <= {"s": 64, "l": 256}[r.limit_name] and r.text == ("One two three. " * 400)[r.start_char : r.end_char]
        assert r.piece == 0 or r.limit_name == "l" or 0 < r.own_start_char - r.start_char < 60
    assert splitting.split_texts(docs.limit(0), "doc_id", "text", limits).count() == 0
    with pytest.raises(ValueError):
        splitting.split_texts(docs, "doc_id", "text", spark.createDataFrame([("s", 10, 5)], limits.schema))


def test_count_tokens(spark, encode):
    texts = ["", None, "Hello world", "½ ² Ⅷ", "x\x1cy", "naïve café 一二三"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(count_tokens(F.col("t"))).collect()]
    assert got == [len(encode(t)) if t else 0 for t in texts]


def test_configurations_meet_demand():
    rnd = random.Random(3)
    for capacity in (97, 512):
        sizes = sorted({rnd.randrange(capacity // 8 + 1, capacity + 1) for _ in range(15)}, reverse=True)
        demand = [rnd.randrange(1, 400) for _ in sizes]
        used = packing.configurations(sizes, demand, capacity)
        assert all(int((p * sizes).sum()) <= capacity for p, _ in used)
        assert [sum(int(p[i]) * n for p, n in used) for i in range(len(sizes))] == demand
        bound = sum(s * d for s, d in zip(sizes, demand)) / capacity
        big = sum(d for s, d in zip(sizes, demand) if 2 * s > capacity)
        assert sum(n for _, n in used) <= 1.12 * max(bound, big) + len(sizes)


def packed(spark, sizes, limits):
    df = spark.createDataFrame([(i, n, "x", 0) for i, n in enumerate(sizes)], "doc_id long, n_tokens long, container string, block int")
    return packing.pack_items(df, spark.createDataFrame(limits, "limit_name string, max_tokens int")).collect()


def test_packing(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 60)
    monkeypatch.setattr(packing, "RUN", 150)
    rnd = random.Random(7)
    sizes = [rnd.choice([0, None, 3, 20, 100, 100, 100, rnd.randrange(1, 130), rnd.randrange(1, 1500)]) for _ in range(1500)]
    limits = [("a", 100), ("b", 512)]
    rows = packed(spark, sizes, limits)
    for name, cap in limits:
        room, items = {}, {}
        for r in rows:
            if r.limit_name == name:
                room[r.container] = room.get(r.container, 0) + r.n_tokens
                items.setdefault(r.doc_id, []).append((r.part, r.start_token, r.n_tokens))
        assert max(room.values()) <= cap and set(items) == set(range(len(sizes)))
        for i, parts in items.items():
            n = sizes[i] or 0
            parts.sort()
            assert sum(p[2] for p in parts) == n and [p[1] for p in parts] == [k * cap for k in range(len(parts))]
            assert len(parts) == 1 if n <= cap else all(p[2] == cap for p in parts[:-1])
        assert sum(room.values()) / (cap * len(room)) > 0.93


def test_packing_of_nothing_and_of_equals(spark):
    assert packed(spark, [], [("a", 10)]) == []
    rows = packed(spark, [10] * 50 + [30] * 5, [("a", 10)])
    assert len(rows) == 65 and len({r.container for r in rows}) == 65
    with pytest.raises(ValueError):
        packed(spark, [1], [("a", 0)])


TARGET = "mix_name string, source string, target_share double, max_repeats int"


def mixed(spark, docs, targets, **more):
    d = spark.createDataFrame([(i, s, n, 1) for i, (s, n) in enumerate(docs)], "doc_id long, source string, n_tokens long, key int")
    sel, rep = mix_sources(d, spark.createDataFrame(targets, TARGET), **more)
    return sel.collect(), {(r.mix_name, r.source): r for r in rep.collect()}


def test_shares_and_repeats(spark):
    rnd = random.Random(1)
    docs = [(rnd.choice(["big", "big", "big", "mid", "small", None]), rnd.randrange(0, 60)) for _ in range(4000)]
    targets = [("m", "big", 0.5, 1), ("m", "mid", 0.3, 2), ("m", "small", 0.2, 3), ("n", "small", 0.6, 2), ("n", "gone", 0.4, 1)]
    sel, rep = mixed(spark, docs, targets)
    most = {(m, s): k for m, s, _, k in targets}
    assert all(1 <= r.copies <= most[r.mix_name, r.source] for r in sel) and len({(r.mix_name, r.doc_id) for r in sel}) == len(sel)
    for m, s, share, _ in targets[:3]:
        assert abs(rep[m, s].actual_share - share) < 0.002
    assert rep["n", "gone"].tokens == 0 and rep["n", "gone"].short and rep["n", "small"].actual_share == 1.0
    for key, r in rep.items():
        assert r.tokens == sum(x.copies * x.n_tokens for x in sel if (x.mix_name, x.source) == key)


def test_budget_ends_within_a_document(spark):
    docs = [("a", 10)] * 500 + [("b", 7)] * 800
    targets = [("m", "a", 0.5, 1), ("m", "b", 0.5, 1)]
    for total in (1000, 3333, 100_000):
        sel, rep = mixed(spark, docs, targets, total_tokens=total)
        for s, n, have in (("a", 10, 5000), ("b", 7, 5600)):
            assert abs(rep["m", s].tokens - min(total / 2, have)) <= n / 2 + 1
            assert rep["m", s].short == (have < total // 2)
    small, large = (({r.doc_id for r in mixed(spark, docs, targets, total_tokens=t)[0]}) for t in (1000, 3000))
    assert small < large


def test_mixing_of_nothing(spark):
    sel, rep = mixed(spark, [], [("m", "a", 1.0, 1)])
    assert sel == [] and rep["m", "a"].tokens == 0
    assert mixed(spark, [("a", 1)], [])[0] == []
    with pytest.raises(ValueError):
        mixed(spark, [("a", 1)], [("m", "a", 0.5, 1), ("m", "a", 0.5, 1)])


def test_counts_of_any_part_are_the_tokenizers_own():
    import random

    from loomgraph.llm.splitting import Units, read_texts
    from loomgraph.llm.tokens import read_vocabulary, sizer

    size = sizer(read_vocabulary())
    units, rnd = Units(size), random.Random(7)
    parts = ["word", " the", "'s", "'", "''", "--'", "\n", " ", "\t", "\x1c", "漢字仮名交じり文" * 3, "1234567890" * 4, "-" * 41, "a" * 53, " " * 60, "\n" * 45, "s", "ll", "?!", "é", "😀" * 9, ".", "xkjqzwv" * 6]
    for _ in range(400):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 12)))
        count = lambda t: len(size.encoding.encode_ordinary(t))
        assert size.count(text) == count(text)
        x = read_texts([text], units)[0]
        n = len(x.starts) - 1
        for _ in range(10):
            i = rnd.randint(0, n)
            j = rnd.randint(i, n)
            assert x.tokens(i, j) == count(text[x.starts[i] : x.starts[j]])
        most = rnd.randint(6, 60)
        for first, own, end, k in x.pieces([(most, most // 3)])[0]:
            assert k == count(text[x.starts[first] : x.starts[end]]) and (k <= most or end - own == 1)


@pytest.mark.parametrize("rule", ["-" * 20_000, "\x1c" * 3_000, "\n" * 20_000, "ab" * 4_000])
def test_no_cut_that_no_limit_asks_for(rule):
    """Every cut of the recursion divides a part above the room: the two halves of the last cut never fit together."""
    from loomgraph.llm.splitting import Units, read_texts
    from loomgraph.llm.tokens import read_vocabulary, sizer

    x = read_texts(["Some words here. " * 30 + rule + " More words follow." * 100], Units(sizer(read_vocabulary())))[0]
    n = len(x.starts) - 1
    for room in (128, 512, 1024):
        ends = [end for *_, end, _ in x.pieces([(room, 0)])[0]]
        pieces = set(zip([0, *ends], ends))

        def check(i, j):
            if x.tokens(i, j) <= room or j - i == 1:
                assert (i, j) in pieces
            else:
                k = x.cut(i, j)
                check(i, k)
                check(k, j)

        check(0, n)
