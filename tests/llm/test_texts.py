import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shoebox.llm.leakage import PositionalIndex, close_passages, leaked_passages, words
from shoebox.llm.packing import pack_texts, sum_of_squares, token_counts
from shoebox.llm.truncation import cut_documents, judge_truncation, truncation_by_source
from shoebox.plans.tables import table

DOC = "doc_id long, text string"
ITEM = "item_id long, text string"


def test_words():
    assert words("Ｆｕｌｌ wi­de  ﬁne_two STRASSE straße été x²") == ["full", "wide", "fine", "two", "strasse", "strasse", "été", "x2"]
    assert words(None) == words("") == words(" -- ") == []


def truth(docs, items, n):
    out = {}
    for i, t in items:
        w = words(t)
        for k in range(len(w) - n + 1):
            out.setdefault(tuple(w[k : k + n]), set()).add(i)
    return {(d, i) for d, t in docs for w in [words(t)] for k in range(len(w) - n + 1) for i in out.get(tuple(w[k : k + n]), ())}


def test_leaks_equal_brute_force_on_the_table(spark):
    docs, items = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "eval_items")
    want = truth([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()], 12)
    got = [(r["doc_id"], r["item_id"]) for r in leaked_passages(docs, items).collect()]
    assert want and len(got) == len(set(got)) and set(got) == want


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=14), min_size=1, max_size=5), st.lists(st.lists(st.sampled_from("abc"), max_size=8), min_size=1, max_size=4))
def test_leaks_of_repetitive_texts(spark, docs, items):
    docs, items = [(i, " ".join(d)) for i, d in enumerate(docs)], [(i, ", ".join(d)) for i, d in enumerate(items)]
    got = {(r["doc_id"], r["item_id"]) for r in leaked_passages(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM), n=4).collect()}
    assert got == truth(docs, items, 4)


def test_leaks_of_dirty_rows(spark, rows):
    text = " ".join(f"w{i}" for i in range(15))
    docs = spark.createDataFrame([(1, text.upper(), 0), (1, text.upper(), 0), (2, None, 0), (3, "", 0), (4, "x " * 50_000 + text + " y" * 50_000, 0), (None, text, 0), (5, text.replace("w7", "w7 and"), 0), (6, text.replace(" ", " ​- "), 0)], DOC + ", term int")
    items = spark.createDataFrame([(7, text), (8, "w1 w2 w3"), (9, None), (None, text), (7, text)], ITEM)
    assert rows(leaked_passages(docs, items)) == [(1, 7, 15), (4, 7, 15), (6, 7, 15)]
    assert {r["doc_id"] for r in close_passages(docs, items).collect()} == {1, 4, 5, 6}
    assert leaked_passages(docs.limit(0), items.limit(0)).count() == 0


def test_an_index_is_opened_again(spark, rows, tmp_path):
    text = " ".join(f"w{i}" for i in range(15))
    items = spark.createDataFrame([(7, text)], ITEM)
    index = PositionalIndex(spark.createDataFrame([(1, text), (2, "w1 w2")], DOC), path=f"file://{tmp_path}/index")
    assert rows(leaked_passages(None, items, index=index)) == [(1, 7, 15)]
    kept = PositionalIndex(None, path=f"file://{tmp_path}/index", spark=spark)
    assert rows(leaked_passages(None, items, index=kept)) == [(1, 7, 15)] and kept.postings().count() == 17


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=80), st.integers(30, 40))
def test_sum_of_squares_never_overfills(sizes, capacity):
    packs = sum_of_squares(np.array(sizes, np.int64), capacity)
    fill = np.bincount(packs, weights=sizes) if len(sizes) else np.zeros(0)
    assert (fill <= capacity).all() and len(packs) == len(sizes)


def test_sum_of_squares_takes_the_smallest_sum():
    sizes, capacity = np.random.default_rng(0).integers(1, 12, 60), 12
    packs = sum_of_squares(sizes, capacity)
    gaps = {}
    for s, p in zip(sizes.tolist(), packs.tolist()):
        cost = lambda g: sum(list(g.values()).count(x) ** 2 for x in set(g.values()) if 0 < x < capacity)
        choices = {**{q: {**gaps, q: g - s} for q, g in gaps.items() if g >= s}, max(gaps, default=-1) + 1: {**gaps, max(gaps, default=-1) + 1: capacity - s}}
        assert p in choices and cost(choices[p]) == min(map(cost, choices.values()))
        gaps = choices[p]


def test_packs_hold_everything(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = pack_texts(docs, 512, shard_texts=300).toPandas()
    counts = {r["doc_id"]: r["n_tokens"] for r in token_counts(docs).collect()}
    assert got.groupby("pack_no").n_tokens.sum().max() <= 512
    assert got.groupby("doc_id").n_tokens.sum().to_dict() == counts
    divided = got.groupby("doc_id").size()
    assert all((divided[d] > 1) == (n > 512) for d, n in counts.items())
    assert got.n_tokens.sum() / (got.pack_no.nunique() * 512) > 0.97
    whole = got.sort_values(["doc_id", "piece_no"])
    assert (whole.first_token == whole.groupby("doc_id").n_tokens.cumsum() - whole.n_tokens).all()


def test_packs_of_dirty_rows(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "word " * 1000, 0), (3, "word " * 1000, 0), (None, "x", 0), (4, "a b", 0)], DOC + ", shard int")
    got = pack_texts(docs, 64).toPandas()
    assert set(got.doc_id) == {1, 2, 3, 4} and got[got.doc_id == 3].n_tokens.sum() == 2 * token_counts(docs).where("doc_id = 3").first()["n_tokens"]
    assert got.groupby("pack_no").n_tokens.sum().max() <= 64
    assert pack_texts(docs.limit(0), 64).count() == 0
    with pytest.raises(ValueError):
        pack_texts(docs, 0)


def corpus():
    """Complete texts of a few patterns, enough of them for the counts."""
    animals, places = ["cat", "dog", "horse", "bird", "cow"], ["Gora", "Hova", "Lomby", "Relin"]
    out = []
    for i in range(300):
        a, b, p = animals[i % 5], animals[i // 5 % 5], places[i % 4]
        s = [f"The {a} walked along the river and the {b} looked at it.", f"We found {i % 90 + 2} pictures of the {a} near {p}, approx. {i} in all.", f"Nobody knows where the {b} slept when the rain came to {p}!"]
        out.append(" ".join(s[i % 3 :] + s[: i % 3]))
    return out


def test_cut_and_complete_texts(spark):
    texts = corpus()
    complete = [texts[3], texts[4] + "\n#cat #dog", texts[5] + "\n- dog\n- cat", texts[6] + "\nGora/IMG_12345.jpg", texts[7] + "\nTotal   12.50", texts[8] + "\n-- the cow", texts[9] + "\n\n:-)", "The dog walked along the river and the cat looked at it", "", None]
    cut = ["The cat walked along the riv", "The cat walked along the river and the", "The cat walked along the river and the...", "The dog walked along the ri…", "We found 12 pictures of the cow near Gora, approx.", 'He said "The dog walked', "Nobody knows where the cow (the", "The dog walked along the river�", "We found 12 pictures of the dog,", "We found 12 pictures in IMG_123"]
    rows = [(i, "a" if i % 2 else None, t) for i, t in enumerate(texts)] + [(1000 + i, "b", t) for i, t in enumerate(complete)] + [(2000 + i, "b", t) for i, t in enumerate(cut)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("raw", F.lit(1))
    assert sorted(r["doc_id"] for r in cut_documents(df).collect()) == [2000 + i for i in range(len(cut))]
    by = {r["source"]: (r["n_documents"], r["n_cut"]) for r in truncation_by_source(df).collect()}
    assert by == {None: (150, 0), "a": (150, 0), "b": (20, 10)}


def test_copies_of_a_cut_text_do_not_excuse_it(spark):
    """A cut text of several lines and a cut text with dots, each copied until they are a third of the table."""
    texts = corpus()
    lined, dotted, word = texts[3] + "\nThe cat walked along the", "Nobody saw the horse under the...", "The dog walked along the riv"
    copies = [lined] * 50 + [dotted] * 50 + [word] * 50
    rows = [(i, "a", t) for i, t in enumerate(texts)] + [(1000 + i, "b", t) for i, t in enumerate(copies)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    assert sorted(r["doc_id"] for r in cut_documents(df).collect()) == [1000 + i for i in range(len(copies))]
    by = {r["source"]: (r["n_documents"], r["n_cut"]) for r in truncation_by_source(df).collect()}
    assert by == {"a": (len(texts), 0), "b": (150, 150)}


def test_length_limit_of_a_field(spark):
    texts = corpus()
    rows = [(i, "form", t[:120] if i % 3 else t[:60].rsplit(".", 1)[0] + ".") for i, t in enumerate(texts)]
    got = {r["doc_id"] for r in cut_documents(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert len({i for i, _, t in rows if len(t) == 120 and t.rstrip()[-1] not in ".!"} - got) == 0


def test_truncation_of_dirty_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None, None), (2, "x", ""), (3, "x", " \n"), (4, "x", "..."), (None, "x", "abc"), (5, "x", "word " * 100_000), (5, "x", "word " * 100_000)], "doc_id long, source string, text string")
    got = {r["doc_id"]: r["cut"] for r in judge_truncation(df).collect()}
    assert set(got) == {1, 2, 3, 4, 5} and not any(got[i] for i in (1, 2, 3, 4))
    assert judge_truncation(df.limit(0)).count() == 0 and truncation_by_source(df.limit(0)).count() == 0
