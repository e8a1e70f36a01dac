"""The pipeline against a plain version of its stages, on documents whose fate is beyond doubt."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sievemill.llm import shared

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def prose(rng, n):
    return " ".join(f"w{rng.randrange(10**5)}" + ("." if rng.random() < 0.1 else "") for _ in range(n)) + "."


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    rng = random.Random(6)
    docs = {i: prose(rng, 90) for i in range(0, 200)}
    fate = {i: "kept" for i in docs}
    for i in range(0, 200, 5):
        docs[i], fate[i] = " ".join(f"{w.upper()}!!" for w in prose(rng, 60).split()), "bad"
    for i in (11, 12, 13):
        w = docs[6].split()
        w[i] = "changed"
        docs[i], fate[i] = " ".join(w), "copy"
    docs[14], fate[14] = docs[6], "copy"
    items = {1: prose(rng, 40), 2: prose(rng, 20)}
    for i in (21, 22):
        w = items[i - 20].split()
        w[3] = "edited"
        docs[i], fate[i] = prose(rng, 50) + " " + " ".join(w) + " " + prose(rng, 50), "leak"
    docs[31] += " Write to some.one@mail.example.com or 10.1.2.3 now."
    rows = [(i, t, "en", "abc"[i % 3], len(t)) for i, t in docs.items()] + [(None, prose(rng, 80), "en", None, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(f != "bad"), 0) for i, f in fate.items()], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), docs, fate


def test_stages(spark, folder):
    d, docs, fate = folder
    now, left = spark.read.parquet(f"{d}/documents.parquet"), {*docs, None}
    gone = ({"bad"}, {"copy"}, {"leak"}, set())
    for (name, stage), drop in zip(corpus_pipeline.STAGES[:-1], gone):
        now = stage(spark, now, d)
        assert now.columns == COLUMNS
        left -= {i for i in left if fate.get(i) in drop}
        assert {r.doc_id for r in now.select("doc_id").collect()} == left, name
    texts = {r.doc_id: (r.text, r.n_chars) for r in now.collect()}
    for i in left - {None, 31}:
        assert texts[i] == (docs[i], len(docs[i]))
    assert texts[31][0].endswith("Write to <EMAIL> or <IP> now.") and texts[31][1] == len(texts[31][0])


def test_run(spark, folder):
    d, docs, fate = folder
    out = corpus_pipeline.run(spark, d).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    by_source, taken = {}, defaultdict(int)
    for r in out:
        assert fate.get(r.doc_id, "kept") == "kept" and 0 < r.taken <= 3 * r.size
        if r.doc_id is not None:
            assert r.size == size(docs[r.doc_id]) and (r.text == docs[r.doc_id] or r.doc_id == 31) and r.lang == "en"
            by_source["abc"[r.doc_id % 3]] = r.target
            taken["abc"[r.doc_id % 3]] += r.taken
    assert {s: round(t) for s, t in by_source.items()} == dict(taken)
    assert taken["a"] < taken["b"] < taken["c"]


def test_contract():
    assert [n for n, _ in corpus_pipeline.STAGES][1] == "near duplicates" and len(corpus_pipeline.STAGES) == 5
    assert corpus_pipeline.ORACLE_SQL is None


def test_empty_tables(spark, folder, tmp_path):
    d, _, _ = folder
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{d}/{t}.parquet").where(F.lit(False)).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_rows_and_clashing_columns(spark, folder, tmp_path):
    """Null and empty values, a very long text and columns with the stages' own names change nothing else."""
    d, docs, _ = folder
    rng = random.Random(17)
    long = prose(rng, 120000)
    now = spark.read.parquet(f"{d}/documents.parquet")
    odd = [(None, None, None, None, None), (1000, None, "en", "a", 0), (1001, "", None, None, None), (1002, " \n\t ", "en", "b", 4), (1003, long, "en", "c", len(long)), (1004, long + " more", "en", "c", None), (1003, long, "en", "c", len(long))]
    now = now.unionByName(spark.createDataFrame(odd, now.schema))
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{d}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    results = []
    for k, extra in enumerate(({}, dict.fromkeys(("size", "taken", "key", "r", "gone", "_row", "rank", "n", "id", "bin", "score", "spans", "sig"), 7))):
        sf = f"{tmp_path}/{k}"
        for t in ("labels", "benchmark"):
            spark.read.parquet(f"{d}/{t}.parquet").write.parquet(f"{sf}/{t}.parquet")
        now.withColumns({c: F.lit(v) for c, v in extra.items()}).coalesce(3).write.parquet(f"{sf}/documents.parquet")
        out = corpus_pipeline.run(spark, sf)
        assert set(extra) <= set(out.columns)
        results.append(Counter((r.doc_id, r.text, r["size"], r.taken) for r in out.collect()))
    assert results[0] == results[1]
    assert [t for i, t, _, _ in results[0] if i == 1003] == [long] and not {1000, 1001, 1002, 1004} & {i for i, *_ in results[0]}


def test_intermediate_tables_are_deleted(spark, folder):
    d, _, _ = folder
    shared.release(spark)
    out = corpus_pipeline.run(spark, d)
    assert not {p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in shared._made} - {"personal-data", "rows", "sizes"}
    n = out.count()
    shared.release(spark)
    assert n and not shared._made


def test_rows_without_an_id_of_their_own(spark, folder, tmp_path):
    """Null and repeated ids: a decision holds for its row, for no other and for no fewer."""
    d, docs, _ = folder
    rng = random.Random(9)
    bad = lambda: " ".join(f"{w.upper()}!!" for w in prose(rng, 60).split())
    item = spark.read.parquet(f"{d}/benchmark.parquet").where("item_id = 1").first().text
    unnamed_item = prose(rng, 30)
    alone, other = prose(rng, 90), prose(rng, 90)
    near = lambda t, i: " ".join("changed" if j == i else w for j, w in enumerate(t.split()))
    good, clean, beside = prose(rng, 90), prose(rng, 90), prose(rng, 90)
    # stage that drops the row, or None
    planted = [
        (None, bad(), 0), (900, bad(), 0), (900, good, None),
        (None, near(docs[6], 30), 1), (901, other, None), (901, other, 1), (901, other, 1), (901, near(other, 40), 1),
        (None, alone, None), (None, alone, 1), (None, near(alone, 50), 1),
        (902, prose(rng, 40) + " " + item + " " + prose(rng, 40), 2), (902, clean, None), (None, prose(rng, 40) + " " + item, 2),
        (903, prose(rng, 40) + " " + unnamed_item, 2), (903, beside, None),
    ]
    now = spark.read.parquet(f"{d}/documents.parquet")
    now = now.unionByName(spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t, _ in planted], now.schema))
    spark.read.parquet(f"{d}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    bench = spark.read.parquet(f"{d}/benchmark.parquet")
    bench.unionByName(spark.createDataFrame([(None, unnamed_item)], bench.schema)).write.parquet(f"{tmp_path}/benchmark.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        now = stage(spark, now, str(tmp_path))
        got = Counter((r.doc_id, r.text) for r in now.collect())
        assert now.columns == COLUMNS
        rows = {(i, t) for i, t, _ in planted}
        left = Counter((i, t) for i, t, drop in planted if drop is None or drop > k)
        if k:  # which of the unnamed near copies stays isn't fixed
            kept = [key for key in got if key[0] is None and key[1] in (alone, near(alone, 50))]
            assert len(kept) == 1 and got[kept[0]] == 1, name
            left = Counter({key: n for key, n in left.items() if key != (None, alone)}) + Counter(kept)
        assert Counter({key: n for key, n in got.items() if key in rows}) == left, name
