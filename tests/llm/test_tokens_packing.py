import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafspan.llm import packing, tokens

DIR = tokens.TOKENIZER_DIR


@pytest.fixture(scope="module")
def plain():
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{DIR}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


TEXTS = ["", " ", "\n\n", "a", "it's we'll I'd", "x" * 5000, " " * 3000 + "y", "😀" * 700, "<|endoftext|>", "日本語のテキスト " * 90, "a\r\n\tb  c   d" * 200, "'l" * 900, "  x" * 400, "é" * 999]


@pytest.mark.parametrize("leaf", [2, 7, 64, 1000])
def test_equals_one_pass(plain, leaf):
    enc = tokens.encoder(DIR, leaf)
    for t in TEXTS:
        assert enc.encode(t) == plain(t), t[:20]
        assert enc.decode(enc.encode(t)) == t


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab '’ls.\n\t\r 　é😀12", max_size=200), st.integers(2, 40))
def test_tree_is_exact(text, leaf):
    assert tokens.TreeEncoder(f"{DIR}/{tokens.TOKENIZER_FILE}", leaf).encode(text) == tokens.encoder(DIR).bpe.encode_ordinary(text) if text else True


def test_documents(spark):
    rows = [(1, None, "k"), (2, "", "k"), (3, " ", "k"), (4, "Hello world", "k"), (4, "Hello world", "k"), (None, "x", "k")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, k string")
    got = sorted(((r["doc_id"] or 0, list(r["ids"])) for r in tokens.encode_documents(docs).collect()), key=repr)
    hello = tokens.encoder(DIR).encode("Hello world")
    assert got == sorted([(0, tokens.encoder(DIR).encode("x")), (1, []), (2, []), (3, tokens.encoder(DIR).encode(" ")), (4, hello), (4, hello)], key=repr)
    assert sorted(r["n_tokens"] for r in tokens.count_tokens(docs).collect()) == [0, 0, 1, 1, 2, 2]
    back = {r["doc_id"]: r["text"] for r in tokens.decode_documents(tokens.encode_documents(docs)).collect()}
    assert back[4] == "Hello world" and back[1] == ""
    assert tokens.encode_documents(docs.limit(0)).count() == 0


def naive(lengths, capacity):
    """Best-fit decreasing, item by item: the number of containers."""
    free = []
    for n in sorted(lengths, reverse=True):
        fit = [f for f in free if f >= n]
        if fit:
            free.remove(min(fit))
            free.append(min(fit) - n)
        else:
            free.append(capacity - n)
    return len(free)


def test_plan_equals_best_fit_decreasing():
    r = random.Random(3)
    for _ in range(60):
        c = r.randint(5, 60)
        lengths = [r.randint(1, c) for _ in range(r.randint(1, 120))]
        hist = {n: lengths.count(n) for n in set(lengths)}
        segments, used = packing.plan_containers(hist, {}, 0, c)
        assert used == naive(lengths, c)
        load = {}
        for n in hist:
            segs = sorted((rank, parts) for cls, length, rank, parts in segments if length == n)
            for k in range(hist[n]):
                rank, parts = max(s for s in segs if s[0] <= k)
                (first, per, size) = parts[0]
                load[first + (k - rank) // per] = load.get(first + (k - rank) // per, 0) + size
        assert sum(load.values()) == sum(lengths) and max(load.values()) <= c and len(load) == used


def test_pack(spark):
    r = random.Random(9)
    sizes = [(i, r.choice([1, 2, 3, 700, 60, 99, 100, 101, 350])) for i in range(400)] + [(1000, None), (1001, 0), (1002, 100), (1002, 100), (None, 5)]
    df = spark.createDataFrame([(*s, "x", 1) for s in sizes], "doc_id bigint, n_tokens bigint, k string, b int")
    budgets = spark.createDataFrame([(1, 100), (1, 100), (2, 1000), (3, None), (4, 0)], "budget_id int, capacity_tokens int")
    rows = packing.pack(df, budgets).collect()
    assert {x["budget_id"] for x in rows} == {1, 2}
    for b, c in ((1, 100), (2, 1000)):
        mine = [x for x in rows if x["budget_id"] == b]
        load = {}
        for x in mine:
            load[x["container_id"]] = load.get(x["container_id"], 0) + x["piece_tokens"]
        total = sum(n or 0 for _, n in sizes)
        assert sum(load.values()) == total and max(load.values()) <= c
        cut = any(n and n > c for _, n in sizes)
        assert len(load) <= (-(-total // c) * 1.03 + 2 if cut else naive([n for _, n in sizes if n], c))
        for i, n in sizes:
            if i is None or not n or i == 1002:
                continue
            parts = sorted((x["start_token"], x["piece_tokens"]) for x in mine if x["doc_id"] == i)
            at = 0
            for s, k in parts:
                assert s == at
                at += k
            assert at == n and (n > c or len(parts) == 1)
        assert len([x for x in mine if x["doc_id"] == 1002]) == 2
    assert packing.pack(df.limit(0), budgets).count() == 0 and packing.pack(df, budgets.limit(0)).count() == 0


def test_one_hot_length(spark):
    df = spark.range(5000).selectExpr("id as doc_id", "7L as n_tokens")
    got = packing.pack(df, spark.createDataFrame([(1, 50)], "budget_id int, capacity_tokens int")).groupBy("container_id").sum("piece_tokens").collect()
    assert len(got) == -(-5000 // 7) and max(r[1] for r in got) == 49


def test_large_capacities_and_many_budgets(spark):
    sizes = spark.createDataFrame([(1, 20_000_000), (2, 19_999_999), (3, 131_072), (4, 1)], "doc_id bigint, n_tokens bigint")
    budgets = spark.createDataFrame([(i, 131_072 + i) for i in range(120)] + [(500, 20_000_000)], "budget_id int, capacity_tokens int")
    rows = packing.pack(sizes, budgets).collect()
    for b in (0, 90, 119, 500):
        mine = [r for r in rows if r["budget_id"] == b]
        cap = 20_000_000 if b == 500 else 131_072 + b
        load = {}
        for r in mine:
            load[r["container_id"]] = load.get(r["container_id"], 0) + r["piece_tokens"]
        assert sum(load.values()) == 40_131_072 and max(load.values()) <= cap
        assert len(load) <= -(-40_131_072 // cap) + 1
