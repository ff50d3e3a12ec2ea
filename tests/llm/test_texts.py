import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomline.llm import leaks as B
from loomline.llm import lookalike as A
from loomline.llm import packing as P

DOCS = "doc_id bigint, text string"

# ---------------------------------------------------------------------------------------------- look-alikes

PAIRS = [
    ("Nobody", "Nоbоdу"), ("defend", "defｅｎｄ"), ("finance", "ﬁnance"), ("café", "café"), ("a b", "a b"), ("a b", "a　b"), ("abc", "a​b­c﻿"),
    ("SKARNHOLM", "SKARNНОLM"), ("régulière", "régulièrе"), ("Section", "Ѕеctiοn"), ("Από το", "Aπό τo"), ("one.", "one．"), ("efficient", "eﬃcient"),
]


@pytest.mark.parametrize("a,b", PAIRS)
def test_same_look(a, b):
    assert A.normal(a) == A.normal(b)


@pytest.mark.parametrize("a,b", [("abc", "Abc"), ("café", "cafe"), ("a b", "a  b"), ("a b", "a\nb"), ("a1", "a2"), ("a.", "a,"), ("x²", "x2"), ("ß", "ss"), ("α", "a")])
def test_other_look(a, b):
    assert A.normal(a) != A.normal(b)


@pytest.mark.parametrize("a,b", [("goνernment", "government"), ("ρarty", "party"), ("pαrty", "party"), ("thιs", "this"), ("worκ", "work"), ("fօr", "for"), ("𝐀bc", "Abc"), ("ſo", "so"), ("dıd", "did"), ("Ⅳ", "IV"), ("Οι vόμοι", "Οι νόμοι"), ("хоηор", "xoηop")])
def test_nearly_alike_letters_in_mixed_tokens(a, b):
    assert A.normal(a) == A.normal(b)


def test_nearly_alike_letters_need_a_mixed_token():
    assert A.normal("ναι") == "ναι" != A.normal("vai") and A.normal("ρ") != A.normal("p")


def test_script_choice():
    assert A.normal("Тhе раrtу") == "The party"
    assert A.normal("Οι γεωργοί και οι μαθητές") == "Οι γεωργοί και οι μαθητές"
    assert A.normal("Oι γεωργoί") == "Οι γεωργοί"
    assert A.normal("Привет, мир") == "Привет, мир" and A.normal("Пpивeт") == "Привет"
    assert A.normal("ВОО") == "BOO" and A.normal("мы и ВОО") == "мы и ВОО"
    assert A.token_report("fоr оо you") == (1, 1)
    assert A.normal("") == "" and A.normal("x" * 100_000 + "е").endswith("xe")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcopxeABHIΑΒοαπсаеорГΓé́​  \tﬁｅ", max_size=30))
def test_normal_is_stable_and_depends_on_looks(t):
    n = A.normal(t)
    assert A.normal(n) == n
    if all(A.resolved(x) for x in A.TOKEN.findall(A.skeleton(t))):
        assert A.skeleton(n) == A.skeleton(t)


def brute_pairs(docs):
    docs = list(dict.fromkeys(docs))
    return {(a, b) for a, x in docs for b, y in docs if a is not None and b is not None and a < b and x is not None and y is not None and x != y and A.normal(x) == A.normal(y)}


def test_pairs(spark, monkeypatch):
    monkeypatch.setattr(A, "LOOK_ROWS", 3)
    docs = [(i, t) for i, t in enumerate(["Nobody", "Nоbоdу", "Nobody", "No​body", "nobody", None, "", "​", "x", "x"])]
    docs += [(100 + i, "many" if i % 2 else "mаny") for i in range(12)] + [(1, "Nоbоdу"), (None, "Nobody")]
    df = spark.createDataFrame(docs, DOCS)
    got = [tuple(r) for r in A.same_look_pairs(df).collect()]
    assert set(got) == brute_pairs(docs) and len(got) == len(set(got))
    assert A.same_look_pairs(df.limit(0)).count() == 0
    assert A.same_look_pairs(df.selectExpr("*", "1 as look", "2 as as_is", "3 as part")).count() == len(got)
    classes = {r.doc_id: r for r in A.look_classes(df.where("doc_id <> 1 or text is null or text not like 'N%' or doc_id > 1")).collect()}
    assert len(classes) == len({i for i, t in docs if i is not None and t is not None}) - 1
    assert (classes[100].class_id, classes[111].class_id, classes[111].n_docs, classes[111].n_texts) == (100, 100, 12, 2)
    texts = {r.doc_id: r for r in A.normalized(df).collect()}
    assert texts[1].normal_text == "Nobody" and texts[1].changed and texts[1].mixed_tokens == 1 and texts[5].normal_text is None


# ----------------------------------------------------------------------------------------------------- leaks


def distance(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, d in enumerate(t, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=12), st.text("abc", max_size=20))
def test_myers(p, t):
    assert B.myers(p, t) == distance(p, t)


def test_pieces_cover_every_window():
    for budget in (0, 1, 2, 3):
        p = B.piece_words(13, budget)
        for start in range(p):
            whole = sum(start <= k * p and (k + 1) * p <= start + 13 for k in range(20))
            assert whole >= budget + 1


def runs(doc, item):
    best = 0
    for i in range(len(doc)):
        for j in range(len(item)):
            n = 0
            while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n]:
                n += 1
            best = max(best, n)
    return best


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**9))
def test_passages_against_brute_force(seed):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(6 if seed % 2 else 40)]
    items = [(k, " ".join(rnd.choices(words, k=rnd.randint(5, 40)))) for k in range(3)]
    doc = rnd.choices(words, k=40)
    src = items[rnd.randrange(3)][1].split()
    a = rnd.randrange(len(src))
    part = src[a : a + rnd.randint(1, 30)]
    for _ in range(rnd.randint(0, 3)):
        part[rnd.randrange(len(part)) :][:1] = rnd.choices(words, k=rnd.randint(0, 2))
        part = part or ["w0"]
    if rnd.random() < 0.5:
        part[rnd.randrange(len(part))] = "edit"
    doc[10:10] = part
    long = {k: t.split() for k, t in items if len(t.split()) >= 13}
    least = {k: min(distance(t[s : s + 13], doc) for s in range(len(t) - 12)) for k, t in long.items()}
    for budget in (0, 1, 2, 3):
        index = B.Index(items, 13, budget)
        got = {index.items[k][0]: e for k, e in index.search(" ".join(doc)).items()}
        assert got == {k: e for k, e in least.items() if e <= budget}
    assert {k for k, e in least.items() if not e} == {k for k, t in long.items() if runs(doc, t) >= 13}


def test_edited_passages_are_found(monkeypatch):
    """Planted passages with two edited words: found by the budget, not among the exact ones, and never without Myers."""
    rnd = random.Random(5)
    vocabulary = [f"v{i}" for i in range(400)]
    items = [(k, " ".join(rnd.choices(vocabulary, k=60))) for k in range(40)]
    index, planted = B.Index(items, 13, 2), []
    for k in range(40):
        words = items[k][1].split()
        a = rnd.randrange(47)
        part = words[a : a + 13]
        for i in rnd.sample(range(13), 2):
            part[i] = rnd.choice(["new", "new word", ""])
        planted.append(" ".join([*rnd.choices(vocabulary, k=100), *part, *rnd.choices(vocabulary, k=100)]))
    got = [index.search(t) for t in planted]
    # a word replaced by two costs two edits, so some passages go beyond the budget
    within = [k for k in range(40) if min(distance(items[k][1].split()[s : s + 13], planted[k].split()) for s in range(48)) <= 2]
    assert len(within) > 20 and all(k in got[k] for k in within) and not any(e == 0 for g in got for e in g.values())
    monkeypatch.setattr(B, "myers", lambda p, t: 99)
    assert not any(index.search(t) for t in [*planted, *(t for _, t in items)])


def test_edits_within_budget(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    cases = {
        1: item, 2: "x " + " ".join(item.split()[:13]).upper() + " y", 3: " ".join(item.split()[:10]),
        4: item.replace("seven", "sewen").replace("fifteen", "z").replace("fourteen", "z"), 5: item.replace("four", "z").replace("eight", "eigt").replace("eleven", "z").replace("one", "z").replace("fifteen", "q"),
        6: item.replace("six seven", "sixseven").replace("fifteen", "q").replace("one", "z"), 7: "Оne, two;​ three FOUR ﬁve six-seven eight nine ten eleven tweⅼve".replace("ⅼ", "l") + " thirteen",
    }
    df = spark.createDataFrame([*cases.items(), (8, None), (9, ""), (None, item), (1, item)], DOCS)
    items = spark.createDataFrame([(5, "s", item, None), (6, "s", "too short", None), (7, "s", None, None), (None, "s", item, None)], "item_id bigint, suite string, text string, answer string")
    got = {(r.doc_id, r.item_id): r.edits for r in B.leaks(df, items).collect()}
    assert got == {(1, 5): 0, (2, 5): 0, (4, 5): 1, (6, 5): 2, (7, 5): 0}
    assert B.leaks(df.limit(0), items).count() == 0 and B.leaks(df, items.limit(0)).count() == 0
    assert B.leaks(df.selectExpr("*", "1 as item_id", "2 as edits"), items).count() == len(got)


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK_ITEMS", 2)
    texts = [" ".join(f"k{i}w{j}" for j in range(14)) for i in range(7)]
    df = spark.createDataFrame([(i, f"start {t} end") for i, t in enumerate(texts)], DOCS)
    items = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in B.leaks(df, items).collect()} == {(i, i) for i in range(7)}


# --------------------------------------------------------------------------------------------------- packing


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=60))
def test_packs_fit_and_hold_everything(sizes):
    sizes = np.array(sizes)
    where, k = P.pack(sizes, 100)
    sums = np.bincount(where, weights=sizes, minlength=k)
    assert sums.max() <= 100 and sums.sum() == sizes.sum() and len(where) == len(sizes)
    assert k <= 2 * -(-int(sizes.sum()) // 100) + 1


def test_differencing_balances():
    sizes = np.array([8, 7, 6, 5, 4])
    sums = sorted(np.bincount(P.differencing(sizes, 2), weights=sizes).tolist())
    assert sums == [14.0, 16.0]
    g = np.random.default_rng(0)
    sizes = g.integers(1, 500, 1000)
    sums = np.bincount(P.differencing(sizes, 100), weights=sizes)
    assert sums.max() - sums.min() <= 5


def first_fit_decreasing(sizes, capacity):
    rooms = []
    for s in sorted(sizes, reverse=True):
        at = next((i for i, r in enumerate(rooms) if r >= s), None)
        if at is None:
            rooms.append(capacity - s)
        else:
            rooms[at] -= s
    return len(rooms)


@pytest.mark.parametrize("lo,hi", [(300, 1400), (700, 1200), (500, 800), (1, 2048), (1, 300)])
def test_packs_of_coarse_sizes_are_as_full_as_first_fit_decreasing(lo, hi):
    sizes = np.random.default_rng(lo).integers(lo, hi + 1, 1024)
    where, k = P.pack(sizes, 2048)
    fill = np.bincount(where, weights=sizes, minlength=k)
    assert fill.max() <= 2048 and len(fill) == k >= P.least_windows(sizes, 2048)
    assert k <= 1.02 * first_fit_decreasing(sizes.tolist(), 2048)


def test_containers(spark):
    rnd = random.Random(1)
    word = lambda n: " ".join(rnd.choice(["order", "budget", "the", "Größe"]) for _ in range(n))
    docs = [(i, word(rnd.randint(1, 120))) for i in range(300)] + [(1000, word(2000)), (1001, None), (1002, ""), (None, "x"), (5, "again")]
    df = spark.createDataFrame(docs, DOCS)
    out = P.containers(df, capacity=256, batch=64).toPandas()
    e = P.encoder(P.VOCABULARY)
    want = {i: len(e.encode_ordinary(t)) for i, t in docs if i is not None and t and i != 5}
    got = out[out.doc_id != 5].groupby("doc_id").n_tokens.sum().to_dict()
    assert got == want
    fill = out.groupby("container_id").n_tokens.sum()
    assert fill.max() <= 256 and (out.container_tokens == out.container_id.map(fill)).all()
    split = out[out.doc_id != 5].groupby("doc_id").size()
    assert all((n > 1) == (want[d] > 256) for d, n in split.items())
    long = out[out.doc_id == 1000].sort_values("piece_no")
    assert long.token_start.tolist() == [0, *long.token_end.tolist()[:-1]] and long.token_end.max() == want[1000]
    assert fill.sum() / (256 * len(fill)) > 0.9
    assert P.containers(df.limit(0)).count() == 0
    assert P.containers(df.selectExpr("*", "1 as batch", "2 as n_tokens"), capacity=256).count() > 0
