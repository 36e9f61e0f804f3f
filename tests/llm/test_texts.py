"""Archives, languages, pieces, and the pipeline."""

import base64
import gzip
import hashlib
import io
import math
from collections import Counter

import numpy as np
import pytest
from corpus import FOLDER, awkward, frame, in_order, jaccard_classes, rows_of, words
from pyspark.sql import types as T

import corpus_pipeline
from talusgrid.llm import languages, mixing, pieces, pii, quality, warc
from talusgrid.llm.queries import llm_queries

PAGES = T.StructType(
    [T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), T.StructField("digest", T.StringType())]
)


def pages(spark):
    tricky = "<p>é \U0001f600\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" + "x" * 100_000
    rows = [(1, "http://a/ü?x=1", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "u\r\nX-Bad: 1", tricky), (4, "u", None), (5, "u", ""), (6, "u", tricky + " ")]
    rows += [(7, "u", "<p>one</p>")] * 2 + [(None, "u", "<p>one</p>"), (None, "u", "alone"), (-8, "u", "<p>two</p>"), (9, "u", "<p>two</p>")]
    return spark.createDataFrame([(*r, "clash") for r in rows], PAGES)


def archive_by_force(rows):
    first = {}
    for r in rows:
        if r.page_id is not None:
            first[r.html or ""] = min(first.get(r.html or "", r.page_id), r.page_id)
    out = []
    for r in rows:
        raw, low = (r.html or "").encode(), first.get(r.html or "")
        again = low is not None and (r.page_id is None or r.page_id > low)
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out.append((r.page_id, len(raw), digest, "revisit" if again else "response", low if again else None))
    return in_order(out)


COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def test_archive_round_trip(spark):
    table = pages(spark)
    assert rows_of(warc.archived(table), *COLUMNS) == archive_by_force(table.collect())
    assert warc.archived(table.limit(0)).count() == 0


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_archive_payloads_and_splits(spark, tmp_path, compression):
    table = pages(spark)
    path = f"{tmp_path}/archive"
    warc.write_warc(table.coalesce(1), path, compression)
    warc.read_warc(spark, path)
    found = spark.read.format("warc").option("splitBytes", "3000").load(path)
    assert (found.rdd.getNumPartitions() > 20) == (compression == "none")
    got = sorted(bytes(r.payload) for r in found.where("record_type = 'response'").collect())
    rows = table.collect()
    kinds = {(a[0], a[2]): a[3] for a in archive_by_force(rows)}
    digest = lambda raw: base64.b32encode(hashlib.sha1(raw).digest()).decode()
    want = sorted(raw for r in rows if kinds[r.page_id, digest(raw := (r.html or "").encode())] == "response")
    assert got == want
    assert {r.target_uri for r in found.collect()} >= {"http://a/ü?x=1", "u%0D%0AX-Bad: 1"}


def test_archive_predicates_are_pushed(spark, tmp_path):
    path = f"{tmp_path}/archive"
    warc.write_warc(pages(spark), path)
    found = warc.read_warc(spark, path, payload=False).where("record_type = 'revisit' and target_uri like 'u%'")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan.replace("Filter (isnotnull", "")
    assert {r.record_type for r in found.collect()} == {"revisit"}
    assert all(r.payload is None and r.payload_bytes is not None for r in found.collect())
    reader = warc.WarcReader({"path": path})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    rest = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("payload_bytes",), 3)]))
    assert len(rest) == 1 and reader.passes({"record_type": "revisit"}) and not reader.passes({"record_type": "response"})


def test_archive_of_many_gzip_members_and_other_records():
    record = lambda kind, body: b"WARC/1.0\r\nWARC-Type: %s\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (kind, len(body), body)
    raw = gzip.compress(record(b"warcinfo", b"software: x")) + gzip.compress(record(b"request", b"GET /")) + gzip.compress(record(b"response", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nhi\r\n\r\n"))
    stream = warc.Stream(io.BytesIO(raw), True)
    kinds = []
    while (fields := stream.header()) is not None:
        kinds.append(fields["warc-type"])
        body = stream.body(int(fields["content-length"]))
    assert kinds == ["warcinfo", "request", "response"] and warc._split_body(body) == ({"a": "b"}, b"hi\r\n\r\n")
    with pytest.raises(ValueError):
        warc.Stream(io.BytesIO(b"junk\r\n"), False).header()


def test_languages_held_out(spark):
    folder = "/root/testdata/sf0.01"
    got = llm_queries()["op6_languages"](spark, folder).toPandas()
    docs = frame(spark, "documents", folder)
    both = got.merge(docs, on="doc_id")
    assert len(got) == len(docs) and both.score.between(0, 1).all()
    assert (both[both.held_out].lang_pred == both[both.held_out].lang).mean() > 0.98
    import zlib

    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()


def test_mixed_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) between 1500 and 4000")
    model = languages.learn(docs)
    texts = {r.lang: r.text for r in docs.where("lang in ('en', 'de')").orderBy("doc_id").collect()}
    rows = [(1, texts["en"][:1200] + "\n" + texts["de"][:1200]), (2, texts["en"][:1400]), (3, texts["de"][:300] + " " + texts["en"][:1500])]
    got = {r.doc_id: {x.lang: x.share for x in r.langs} for r in languages.predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert set(got[1]) == {"en", "de"} and 0.3 < got[1]["en"] < 0.7
    assert set(got[2]) == {"en"}
    assert set(got[3]) == {"en", "de"} and got[3]["en"] > 0.7


def test_a_small_share_of_a_long_text_is_found(spark):
    """1 500 characters of a second language in 61 500; a third that is not there is not."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) between 1500 and 9000")
    model = languages.learn(docs)
    texts = {name: " ".join(r.text for r in docs.where(f"lang = '{name}'").orderBy("doc_id").collect()) for name in ("en", "de")}
    rows = [(1, texts["en"][:60_000] + "\n" + texts["de"][:1500])]
    got = {x.lang: x.share for x in languages.predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()[0].langs}
    assert set(got) == {"en", "de"} and 0.01 < got["de"] < 0.05


def test_language_sets_against_all_sets():
    """Shares against a fine search, and the chosen set against all sets by penalised likelihood."""
    from itertools import combinations

    rng = np.random.default_rng(8)
    table = rng.dirichlet(np.full(40, 0.4), 4).T + 1e-4
    table /= table.sum(axis=0)
    shares_ = [(1, 0, 0, 0), (0.5, 0.5, 0, 0), (0.9, 0, 0.1, 0), (0.4, 0.3, 0.3, 0), (0.25, 0.25, 0.25, 0.25), (0, 0, 0.02, 0.98), (0.03, 0.97, 0, 0)]
    sizes = [3, 30, 300, 3000]
    counts = [rng.multinomial(n, table @ np.array(p)) for p in shares_ for n in sizes]
    doc, cell = np.nonzero(np.stack(counts))
    got = languages.shares(doc, cell, np.stack(counts)[doc, cell], len(counts), table)

    def likelihood(count, share):
        return float((count * np.log(np.maximum(table @ share, 1e-300))).sum())

    def best_of(count, names):
        share = np.zeros(4)
        share[list(names)] = 1 / len(names)
        for _ in range(3000):
            share = share * (table.T @ (count / (table @ share))) / count.sum()
        return share, likelihood(count, share)

    for count, share in zip(counts, got, strict=True):
        penalty = languages.PENALTY * math.log(max(count.sum(), 2)) / 2
        every = {n: best_of(count, n) for k in range(1, 5) for n in combinations(range(4), k)}
        worth = {n: value - penalty * (len(n) - 1) for n, (_, value) in every.items()}
        chosen = tuple(np.flatnonzero(share))
        assert worth[chosen] >= max(worth.values()) - 0.02
        assert abs(likelihood(count, share) - every[chosen][1]) < 0.02
    assert {len(np.flatnonzero(x)) for x in got} >= {1, 2, 3, 4}


def test_language_cases(spark):
    docs = awkward(spark, [(20, "123 $$$ 456 ²", "en", "a"), (21, "_1_", "en", "a"), (22, "é", "fr", "a")])
    model = languages.learn(docs)
    got = {(r.doc_id, r.lang_pred) for r in languages.predict(docs, model).collect()}
    assert {(2, "und"), (3, "und"), (4, "und"), (20, "und"), (21, "und")} <= got and (22, "und") not in got
    assert languages.predict(docs, model).count() == docs.count()
    empty = languages.learn(awkward(spark, empty=True))
    assert {(r.lang_pred, r.score) for r in languages.predict(docs, empty).collect()} == {("und", 0.0)}


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.load()


def segmentations(plain, text):
    if not text:
        return [((), 0.0)]
    return [((plain[text[:e]][0], *rest), plain[text[:e]][1] + w) for e in range(1, len(text) + 1) if text[:e] in plain for rest, w in segmentations(plain, text[e:])]


def test_sampled_segmentations_have_the_right_chances(vocabulary):
    """First, and ordered first and second, segmentations of a short text against exact probabilities."""
    tree = vocabulary.tree
    plain = {vocabulary.texts[i].decode(): (int(i), float(w)) for i, w in zip(tree.piece, tree.weight, strict=True) if i >= 0}
    text, n = "the cat", 20_000
    weights = {s: math.exp(w) for s, w in segmentations(plain, " " + text)}
    chance = {s: w / sum(weights.values()) for s, w in weights.items()}
    lattice = pieces.Lattices(vocabulary)
    drawn: dict[int, list] = {}
    for d, _, ids, log_p, value, _ in pieces.encode_texts(lattice, list(range(n)), [text] * n, 3, "t"):
        drawn.setdefault(d, []).append((tuple(ids.tolist()), value))
        assert log_p == pytest.approx(math.log(chance[tuple(ids.tolist())]))
    assert all(len({s for s, _ in x}) == 3 and x[0][1] >= x[1][1] >= x[2][1] for x in drawn.values())
    once = Counter(x[0][0] for x in drawn.values())
    twice = Counter((x[0][0], x[1][0]) for x in drawn.values())
    for s, p in chance.items():
        assert abs(once[s] / n - p) < 5 * math.sqrt(p / n) + 1e-4
    for (a, b), times in twice.most_common(30):
        p = chance[a] * chance[b] / (1 - chance[a])
        assert abs(times / n - p) < 5 * math.sqrt(p / n) + 1e-4


def test_inclusion_scores_weigh_samples(vocabulary):
    """Horvitz-Thompson: probability over inclusion adds up to 1 on average."""
    lattice, n = pieces.Lattices(vocabulary), 4000
    totals = np.zeros(n)
    for d, _, _, log_p, _, score in pieces.encode_texts(lattice, list(range(n)), ["an unlikely word"] * n, 4, "t"):
        totals[d] += math.exp(log_p) / score
    assert totals.mean() == pytest.approx(1, abs=0.05)


def test_few_segmentations(vocabulary):
    found = list(pieces.encode_texts(pieces.Lattices(vocabulary), [1, 2, 3], ["", "\n", "a"], 5, "t"))
    by = Counter(d for d, *_ in found)
    assert by == {0: 1, 1: 1, 2: 2}  # " a" is one piece or two
    assert all(s == 1 for d, _, _, _, _, s in found if by[d] < 5)


def test_pieces_round_trip(spark, vocabulary):
    docs = awkward(spark, [(50, "▁ ▁▁ \n\n  x,y.z \x00 ​\U0010ffff", "en", "a"), (51, " " * 500, "en", "a"), (52, "中文字符 ελ" * 50, "zz", "a")])
    out = pieces.encoded(docs)
    back = {(r.doc_id, r.text) for r in pieces.decoded(out).collect()}
    assert back == {(r.doc_id, r.text or "") for r in docs.collect()}
    assert sorted(map(str, out.collect())) == sorted(map(str, pieces.encoded(docs.repartition(5)).collect()))
    assert pieces.encoded(awkward(spark, empty=True)).count() == 0
    digests = pieces.encoded(docs, digest_only=True)
    assert digests.where("not round_trip").count() == 0 and digests.count() == out.count()


def test_pieces_query(spark, vocabulary):
    """Whole table: two distinct encodings a text, which decode to it, with digests of the ids."""
    got = llm_queries()["op10_pieces"](spark, FOLDER).toPandas()
    docs = frame(spark, "documents")
    assert len(got) == 2 * len(docs) and got.round_trip.all()
    assert got.groupby("doc_id").pieces_sha256.nunique().eq(2).all()
    full = pieces.encoded(spark.read.parquet(f"{FOLDER}/documents.parquet")).toPandas()
    want = {(r.doc_id, r["rank"]): hashlib.sha256(np.asarray(r.pieces, dtype="<i4").tobytes()).hexdigest() for _, r in full.iterrows()}
    assert want == {(r.doc_id, r["rank"]): r.pieces_sha256 for _, r in got.iterrows()}
    lattice, row = pieces.Lattices(vocabulary), docs.iloc[3]
    again = [ids.tolist() for _, _, ids, *_ in pieces.encode_texts(lattice, [row.doc_id], [row.text], 2, pieces.SEED)]
    assert again == [list(full[(full.doc_id == row.doc_id) & (full["rank"] == k)].pieces.iloc[0]) for k in (1, 2)]


def test_pieces_query_returns_its_pieces(spark, vocabulary, tmp_path):
    """The query gives the encodings, not their digests alone, and the digests and the round trip are those of what it gives."""
    texts = ["a small text, with a comma", "", None, "second line\nthird \U0001f600", "a small text, with a comma"]
    spark.createDataFrame([(k if k != 4 else None, t) for k, t in enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = llm_queries()["op10_pieces"](spark, str(tmp_path)).collect()
    assert len(got) == 2 * 3 + 2
    for r in got:
        assert r.pieces_sha256 == hashlib.sha256(np.asarray(r.pieces, dtype="<i4").tobytes()).hexdigest() and len(r.pieces) == r.n_pieces
        assert r.round_trip and vocabulary.decoded(np.asarray(r.pieces, dtype=np.int64)).decode() == (texts[4 if r.doc_id is None else r.doc_id] or "")


def test_pipeline_stages(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "PII", "mixing sources", "SentencePiece encoding"]
    docs = awkward(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.schema == docs.schema
    for table in (awkward(spark, empty=True), docs):
        for _, stage in corpus_pipeline.STAGES:
            table = stage(spark, table, FOLDER)
        assert table.columns[:3] == ["doc_id", "rank", "n_pieces"]


def test_pipeline_against_brute_force(spark, vocabulary):
    """Each stage's decision again from the stage before, in plain Python where there is no own test of its counts."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    judged = quality.quality(docs)
    want = {r.doc_id for r in judged.where("kept").collect()}
    kept = quality.filtered(docs).toPandas()
    assert set(kept.doc_id) == want and len(kept) == len(want)
    classes = jaccard_classes(list(kept[["doc_id", "text"]].itertuples(index=False, name=None)), 5, 80)
    want = {d for d, _, c in classes if d == c}
    one = corpus_pipeline.jaccard_join(spark, spark.createDataFrame(kept), FOLDER).toPandas()
    assert set(one.doc_id) == want and len(one) == len(want)
    clean = corpus_pipeline.personal_data(spark, spark.createDataFrame(one), FOLDER).toPandas()
    found = {r.doc_id: r for r in pii.detected(spark.createDataFrame(one)).collect()}
    texts = dict(one[["doc_id", "text"]].itertuples(index=False, name=None))
    for doc, text in clean[["doc_id", "text"]].itertuples(index=False, name=None):
        out, at = "", 0
        for s in sorted(found[doc].all_spans, key=lambda s: (s.start, s.end)):
            if s.start >= at:
                out += texts[doc][at : s.start] + pii.LABELS[s.kind]
            at = max(at, s.end)
        assert text == out + texts[doc][at:]
    mix = corpus_pipeline.source_mix(spark, spark.createDataFrame(clean), FOLDER).toPandas()
    plan = {r.doc_id: r.copies for r in mixing.mix_plan(spark.createDataFrame(clean)).collect()}
    assert Counter(mix.doc_id) == {d: n for d, n in plan.items() if n}
    total = sum(len(words(t)) for t in clean.text)
    assert sum(len(words(t)) for t in mix.text) == pytest.approx(1.5 * total, rel=0.15)
    got = Counter((r.doc_id, r.rank, tuple(r.pieces)) for r in corpus_pipeline.run(spark, FOLDER).collect())
    lattice, final = pieces.Lattices(vocabulary), Counter()
    for doc, text in mix[["doc_id", "text"]].itertuples(index=False, name=None):
        for _, rank, ids, *_ in pieces.encode_texts(lattice, [doc], [text], pieces.K, pieces.SEED):
            final[doc, rank, tuple(ids.tolist())] += 1
    assert got == final




