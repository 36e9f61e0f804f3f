"""Spelling variants, ranked search and token counts, against plain versions."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from corpus import FOLDER, awkward, in_order, rows_of, sentence
from tokenizers import Tokenizer

from talusgrid.llm import queries, ranking, tokens, variants

FORMS = ("word", "form", "root", "n", "n_near", "form_n")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def forms_by_force(counts, ratio=5):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return in_order(out)


def counts_by_force(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", lowered(text)):
            if doc is not None and (h := zlib.crc32(f"{doc}:{run}".encode())) % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def spelled(spark, counts):
    return variants.spelling_forms(spark.createDataFrame(list(counts.items()), "word string, n long"))


def test_all_near_words_are_found(spark):
    """Words over few letters, so that equal halves, repeated letters and several edits leading to one word are common."""
    rng = np.random.default_rng(4)
    words = {"".join(rng.choice(list("abé"), rng.integers(6, 10))) for _ in range(900)}
    counts = {w: int(5 * 10**x) for w, x in zip(sorted(words), rng.uniform(0, 4, len(words)), strict=True)}
    want = forms_by_force(counts)
    assert sum(r[4] for r in want) > 1500 and any(r[2] != r[1] and r[1] for r in want)
    assert rows_of(spelled(spark, counts), *FORMS) == want


def test_forms_ties_and_chains(spark):
    step = {"abcdef" + "x" * k: 5 * 5**k for k in range(12)}  # each leads to the next, 5 times as frequent
    tie = {"münchen": 10, "munchen": 50, "mönchen": 50, "manchen": 49, "mänchen": 50}
    long = {"q" * 3000: 5, "q" * 3001: 25, "q" * 2999 + "z": 4}
    assert rows_of(spelled(spark, step | tie | long), *FORMS) == forms_by_force(step | tie | long)
    assert forms_by_force(step)[0][2] == "abcdef" + "x" * 11
    assert rows_of(spelled(spark, {"munchen": 10, "münchen": 50, "mönchen": 50}), "word", "form") == [("munchen", "mönchen"), ("mönchen", None), ("münchen", None)]


def test_variants_of_awkward_documents(spark):
    name = "Théoreme naïve" + " Théoreme" * 30 + " Theoreme" * 6 + " NAÏVES NaïVES naïves naïves naïves x"
    docs = awkward(spark, [(k, name, "fr", "a") for k in range(100, 140)])
    got = variants.spelling_forms(variants.word_counts(queries._slipped(variants.runs(docs))))
    want = forms_by_force(counts_by_force([(r.doc_id, r.text) for r in docs.collect()]))
    assert rows_of(got, *FORMS) == want and any(r[1] for r in want)
    none = awkward(spark, empty=True)
    assert variants.spelling_forms(variants.word_counts(variants.runs(none))).count() == 0


def test_variant_keys_are_selective(spark):
    """Words that share only a half do not meet in the join: 2 000 words with a common half make few candidates."""
    words = [(f"abcdefgh{a}{b}{c}{d}zz", 9) for a in "klmnopq" for b in "rstuvw" for c in "ijxyab" for d in "cdefgh"]
    table = spark.createDataFrame(words, "word string, n long")
    plan = variants.near_pairs(table)._jdf.queryExecution().executedPlan().toString()
    assert "levenshtein" in plan and "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    keys = variants._signed(table, variants.F.length("word").cast("int")).groupBy("size", "part", "sign").count()
    assert keys.agg({"count": "max"}).first()[0] <= 36 * 42


def ranks_by_force(docs, items, places=50):
    """docs (doc_id, text), items (item_id, text)."""
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    found = [(doc, Counter(term.findall(lowered(text)))) for doc, text in docs]
    found = [(doc, c) for doc, c in found if c]
    n, total = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    wanted = defaultdict(set)
    for item, text in items:
        wanted[item] |= set(term.findall(lowered(text)))
    out = []
    for item, terms in wanted.items():
        scored = []
        for doc, c in found:
            m = 100 - 50 + (50 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if score > 0:
                scored.append((-score, doc is None, doc))
        out += [(item, k + 1, doc, -s) for k, (s, _, doc) in enumerate(sorted(scored)[:places])]
    return in_order(out)


RANKS = ("item_id", "rank", "doc_id", "score")


def searched(spark):
    rows = [(200 + k, sentence(k % 90, 30 + k) + " " + sentence(k % 7, 12), "en", "a") for k in range(300)]
    docs = awkward(spark, [*rows, *rows[:40], (None, sentence(3, 12), "en", "a")])
    texts = [(k, sentence(k, 12).upper() + " ÉÀ, é") for k in range(9)]
    items = [*texts, (3, sentence(5, 4)), (None, sentence(6, 5)), (None, sentence(1, 3)), (50, None), (51, ""), (52, "...; --"), (53, "nowhereatall"), (54, sentence(2, 400))]
    return docs, spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, rank string"), [(i, t) for i, t in items]


@pytest.mark.parametrize(("cells", "blocks", "step"), [(1024, 1024, 64), (8, 4, 3)])
def test_search_is_exact(spark, cells, blocks, step):
    """Also with a sketch so small that nearly all terms share a cell, and items in several blocks."""
    docs, items, plain = searched(spark)
    want = ranks_by_force([(r.doc_id, r.text) for r in docs.collect()], plain)
    got = ranking.ranked(docs.repartition(3), items, cells=cells, items_a_block=blocks, step=step)
    assert rows_of(got, *RANKS) == want
    assert max(Counter(r[0] for r in want).values()) == 50


def test_search_of_nothing(spark):
    docs, items, _ = searched(spark)
    assert ranking.ranked(docs.limit(0), items).count() == 0
    assert ranking.ranked(docs, items.limit(0)).count() == 0
    assert ranking.ranked(docs.where("doc_id in (2, 3)"), items).count() == 0


def test_bounds_hold_and_prune():
    """No bound is below its score, and most documents are never rescored."""
    texts = frame_texts()
    queries_ = [sentence(k, 8) for k in range(5)] + texts[:5]
    rows = pa.table({"item": pa.array([i for i, q in enumerate(queries_) for _ in set(q.lower().split())], pa.int32()), "term": [t for q in queries_ for t in set(q.lower().split())]})
    block = ranking.Block(rows)
    sizes, terms, row, which, tf = next(iter(ranking.document_terms(pa.array(texts))))
    block.weigh({-1: len(texts), -2: int(sizes.sum())}, 256)
    impact = (1_000_000_000 * tf) // (1000 * tf + 20 * 100)
    bound = ranking.sketches(len(sizes), row, terms[which], impact, 256) @ block.matrix
    exact = np.zeros((len(sizes), len(queries_)))
    spot = ranking.places_of(terms, block.terms)[which]
    for i in range(len(queries_)):
        mine = np.isin(spot, block.member[block.edges[i] : block.edges[i + 1]])
        np.add.at(exact[:, i], row[mine], (block.weight[spot] * impact)[mine])
    assert (bound >= exact).all() and (exact > 0).any()


def frame_texts():
    return [t for t in frame_cached("documents").text.tolist() if t][:60]


def frame_cached(name):
    import pandas as pd

    return pd.read_parquet(f"{FOLDER}/{name}.parquet")


LIBRARY = Tokenizer.from_file(queries.tokenizer_path())
COUNTS = ("doc_id", "n_bytes", "n_tokens", "over_limit")


def counts_of_library(rows):
    return in_order([(doc, len((text or "").encode()), n := len(LIBRARY.encode(text or "", add_special_tokens=False).ids), n > 1024) for doc, text in rows])


HARD = [
    "don't 's 'S ''s !'s \t's \n's'll've're'd'm'x we'r e'v", "a  b   \n\n c \t\t d  ", "  lead", "trail  \n", "<|endoftext|>", "a <|endoftext|>  b<|endoftext|><|endoftext|>'s", "<|endof", "text|>",
    "x" * 70_000, " " * 5000 + "y", "1234 ٣٤ Ⅷ½ a1b2", "中文字 テキスト 한국어", "é‍ 　\u0085 z", "\U0001f468‍\U0001f469 \U0001f600!!", "\x00\x01\x1c\x1f a", "İıſK",
]


@pytest.mark.parametrize("frequent", [tokens.FREQUENT, 60, 0])
def test_token_counts_are_the_librarys(spark, frequent):
    """With all pre-tokens frequent, with some, and with none."""
    docs = awkward(spark, [(1000 + k, t, "en", "a") for k, t in enumerate(HARD)] + [(2000 + k, t, "en", "a") for k, t in enumerate(frame_texts()[:30])])
    got = tokens.token_counts(docs.repartition(3), queries.tokenizer_path(), frequent=frequent)
    assert rows_of(got, *COUNTS) == counts_of_library([(r.doc_id, r.text) for r in docs.collect()])
    assert any(r[3] for r in rows_of(got, *COUNTS))
    assert tokens.token_counts(docs.limit(0), queries.tokenizer_path(), frequent=frequent).count() == 0


def test_token_count_query(spark):
    got = queries.op13_token_counts(spark, FOLDER)
    rows = frame_cached("documents")
    assert rows_of(got, *COUNTS) == counts_of_library(zip(rows.doc_id.tolist(), rows.text.tolist(), strict=True))


def test_every_code_point_is_cut_as_the_library_cuts_it():
    definition, strings = tokens.checked(queries.tokenizer_path())
    table = tokens.classes(definition)
    points = [c for c in range(0x110000) if c not in tokens.SURROGATES]
    rng = np.random.default_rng(1)
    rng.shuffle(points)
    texts = ["".join(f"{chr(c)}{x}" for c, x in zip(points[k : k + 400], rng.choice([" ", "a", "1", "'", "s", "!", "\n"], 400))) for k in range(0, 60_000, 400)]
    for text in [*texts, *HARD]:
        [(data, _, start, end, _, special)] = tokens.pre_tokens(pa.array([text]), table, strings)
        got = [data[a:b].tobytes().decode() for a, b in zip(start, end)]
        parts = text.split("<|endoftext|>")
        assert got == [p[a:b] for p in parts for _, (a, b) in LIBRARY.pre_tokenizer.pre_tokenize_str(p)] and special.sum() == len(parts) - 1


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        tokens.checked(queries.tokenizer_path("word_bpe_49k.json"))
