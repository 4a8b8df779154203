"""Parts of the operators against brute force."""

import itertools
import os
import re
import sys
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))

import odd

import corpus_pipeline
from landsift.llm import decontaminate, ngram_join, quality, sharding, substrings, surrogates, token_ids, warc
from landsift.llm.components import components
from landsift.llm.fmindex import FMIndex, WaveletTree, suffix_order
from landsift.session import shared_folder


# ---- sharding ----


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_permutation_and_inverse(n):
    places = sharding.permute(np.arange(n), n, seed=3)
    assert sorted(places.tolist()) == list(range(n))
    assert (sharding.permute(places, n, seed=3, back=True) == np.arange(n)).all()
    assert n < 64 or (places != sharding.permute(np.arange(n), n, seed=4)).any()


def test_shards_can_be_computed(spark):
    rows = spark.range(1003).select(F.col("id").alias("doc_id")).repartition(7)
    found = sharding.shard_rows(rows, ["doc_id"], 10, seed=1).collect()
    for r in found:
        assert sharding.row_at(r.shard, r.slot, 10, 1003, seed=1) == r.doc_id
    for shard in range(10):
        slots = sorted(r.slot for r in found if r.shard == shard)
        assert slots == list(range(len(slots))) and len(slots) in (100, 101)


# ---- benchmark decontamination ----


def test_fm_index_finds_all_occurrences():
    rng = np.random.default_rng(0)
    for trial in range(60):
        symbols = int(rng.integers(1, 5))
        text = rng.integers(0, symbols + 1, int(rng.integers(0, 80)))
        if trial % 3 == 0 and len(text):
            text = np.tile(text[:5], 12)
        suffixes = sorted((p for p in range(len(text)) if text[p]), key=lambda p: [(0, q) if not text[q] else (1, text[q]) for q in range(p, len(text))] + [(0, len(text))])
        assert suffix_order(text).tolist() == suffixes
        index = FMIndex(text, symbols, rate=int(rng.integers(1, 9)))
        for width in (1, 2, 4):
            phrases = rng.integers(1, symbols + 1, (15, width))
            got = sorted(zip(*(x.tolist() for x in index.find(phrases)), strict=True))
            assert got == [(i, p) for i in range(15) for p in range(len(text) - width + 1) if (text[p:p + width] == phrases[i]).all()]


def test_wavelet_ranks():
    sequence = np.random.default_rng(1).integers(0, 13, 500)
    tree = WaveletTree(sequence, 4)
    at = np.arange(501)
    for symbol in range(13):
        assert (tree.rank(np.full(501, symbol), at) == np.concatenate(([0], np.cumsum(sequence == symbol)))).all()
    assert (tree.get(np.arange(500)) == sequence).all()


def test_cuts_go_on_until_no_window_is_left_and_blocks_add_up(spark):
    item = " ".join(f"a{k}" for k in range(12))
    docs = spark.createDataFrame([(1, f"x a0 a1 a2 {item} a3 a4 a5 a6 a7 a8 a9 a10 a11 y"), (2, "b c d Other, words"), (3, "é b c")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, "b c"), (3, "other words")], "item_id long, text string")
    one = decontaminate.decontaminate(docs, bench).orderBy("doc_id").collect()
    assert [r.clean_text for r in one] == ["x  y", " d ", "é "]
    assert [(r.n_words, r.n_hit, r["items"]) for r in one] == [(26, 12, ["1"]), (5, 4, ["2", "3"]), (3, 2, ["2"])]
    assert one[1].text[one[1].spans[1].start:one[1].spans[1].stop] == "Other, words"
    many = decontaminate.decontaminate(docs, bench, block_bytes=1).orderBy("doc_id").collect()
    assert [(r.n_hit, r["items"], r.spans) for r in many] == [(r.n_hit, r["items"], r.spans) for r in one]


def test_clean_text_does_not_depend_on_blocks(spark):
    item = " ".join(f"a{k}" for k in range(12))
    texts = [f"x a0 a1 a2 {item} a3 a4 a5 a6 a7 a8 a9 a10 a11 y", "p q b c r s", "p b q r c s", "untouched", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([(1, item), (2, "b c"), (3, "q r")], "item_id long, text string").coalesce(1)
    one, many = (decontaminate.decontaminate(docs, bench, block_bytes=b).orderBy("doc_id").collect() for b in (1 << 20, 1))
    assert [r.clean_text for r in one] == ["x  y", "p  s", "p  s", "untouched", None, ""]
    assert many == one


# ---- substring deduplication ----


def test_a_full_sketch_loses_nothing(spark, tmp_path, monkeypatch):
    folder = odd.write(tmp_path)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    wide = substrings.remove_repeats(docs).select("doc_id", "clean_text")
    monkeypatch.setattr(substrings, "repeated_counters", lambda docs, text, size, bits: np.full((2 << bits) // 8, 255, np.uint8))
    assert sorted(map(repr, wide.collect())) == sorted(map(repr, substrings.remove_repeats(docs).select("doc_id", "clean_text").collect()))


# ---- n-gram join ----


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(200, 200), (None, 3)]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 130)}, 200: 200}


def test_large_clusters_in_blocks(spark, tmp_path, monkeypatch):
    folder = odd.write(tmp_path)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rule = ngram_join.Jaccard(4, 85)
    whole = sorted(map(repr, ngram_join.group_similar(docs, rule).collect()))
    for rows in (1, 2, 5):
        monkeypatch.setattr(ngram_join, "BLOCK_ROWS", rows)
        assert sorted(map(repr, ngram_join.group_similar(docs, rule).collect())) == whole


def test_similar_equals_brute_force():
    rng = np.random.default_rng(2)
    rule = ngram_join.Jaccard(4, 85)
    for _ in range(40):
        base = rng.choice(10_000, 60, replace=False)
        sets = [np.sort(np.unique(np.where(rng.random(60) < p, rng.integers(0, 10_000, 60), base)).astype(np.uint64) << np.uint64(50)) for p in rng.choice([0, 0.02, 0.05, 0.1], 12)]
        links = ngram_join.similar(sets, [s[:int(rule.prefix(np.array(len(s))))].view(np.int64) for s in sets], rule)
        want = [(a, b) for a, b in itertools.combinations(range(12), 2) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 85 * len(np.union1d(sets[a], sets[b]))]
        assert set(links) <= set(want)
        root = list(range(12))
        for a, b in links:
            root = [root[a] if r == root[b] else r for r in root]
        assert all(root[a] == root[b] for a, b in want)


def test_one_of_each_group_stays(spark, tmp_path):
    folder = odd.write(tmp_path)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rule = ngram_join.Jaccard(5, 80)
    groups = ngram_join.group_similar(docs, rule)
    stay = ngram_join.keep_one(docs, rule)
    named = {r.component_id for r in groups.filter("n_shingles > 0 and component_id is not null").collect()}
    kept = [r.doc_id for r in stay.filter("doc_id is not null and trim(text) != ''").collect()]
    assert named <= set(kept) and len([k for k in kept if k in named]) == len(named)
    assert stay.filter("doc_id is null").count() == 2  # one text of its own and the row of nulls


# ---- WARC ----


def _archive(spark, rows, path):
    warc.write_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), path)


def test_round_trip_and_predicates(spark):
    path = f"{shared_folder(spark)}/warc-test"
    rows = [(k, f"http://h{k % 3}/p", f"<p>{k // 2}</p>" + "ß" * k) if k % 2 else (k, None, f"<p>{k}</p>") for k in range(60)] + [(100, "http://h1/x", "<p>0</p>")]
    _archive(spark, rows, path)
    records = warc.read_warc(spark, path)
    assert records.count() == 61
    got = {r.record_id: bytes(r.payload).decode() for r in records.filter("record_type = 'response'").collect()}
    assert got == {f"urn:page:{k}": html for k, _, html in rows if k != 100}
    again = records.filter("record_type = 'revisit'").collect()
    assert [(r.record_id, r.refers_to, r.payload, r.http_headers["content-length"]) for r in again] == [("urn:page:100", "urn:page:0", None, "8")]
    host = records.filter(F.col("target_uri").startswith("http://h1") & F.col("record_type").isin("response"))
    assert host.count() == sum(1 for k, u, _ in rows if u and u.startswith("http://h1") and k != 100)
    plan = host._jdf.queryExecution().executedPlan().toString()
    assert "StartsWith" not in plan.split("BatchScan")[0]  # judged by the reader


def test_other_archives(spark, tmp_path):
    """Plain files, members without sizes, folded headers, and what is broken."""
    import gzip

    rows = [{"record_type": "response", "record_id": f"urn:page:{k}", "payload": b"x" * k * 9000, "target_uri": "u"} for k in range(4)]
    data = [warc.record_bytes(r) for r in rows]
    (tmp_path / "a.warc").write_bytes(b"".join(data).replace(b"WARC-Target-URI: u", b"WARC-Target-URI: u\r\n v"))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(d) for d in data))
    (tmp_path / "c.txt").write_text("not an archive")
    got = warc.read_warc(spark, str(tmp_path), verify=True).collect()
    assert sorted(len(r.payload) for r in got) == sorted([9000 * k for k in range(4)] * 2)
    assert {r.target_uri for r in got} == {"u", "u v"}
    assert all(r.payload is None for r in warc.read_warc(spark, str(tmp_path), payload=False).collect())
    assert warc.read_warc(spark, str(tmp_path)).filter("record_id = 'urn:page:3'").count() == 2
    (tmp_path / "d.warc.gz").write_bytes(gzip.compress(data[3])[:-40])
    with pytest.raises(Exception, match="cut off"):
        warc.read_warc(spark, str(tmp_path / "d.warc.gz")).collect()
    (tmp_path / "e.warc").write_bytes(data[1].replace(b"xxx", b"yyy", 1))
    with pytest.raises(Exception, match="differs from its digest"):
        warc.read_warc(spark, str(tmp_path / "e.warc"), verify=True).collect()


# ---- token ids ----


@pytest.fixture(scope="module")
def vocabulary():
    public = pytest.importorskip("public_tokenizers")
    return public.path("word_bpe_49k.json")


def test_ids_equal_those_of_whole_texts(spark, vocabulary, tmp_path):
    from tokenizers import Tokenizer

    texts = [None, "", "Don't  STOP, it's 2024!", "é é ́x ΑΣ Σ", "a<|endoftext|>b <|startoftext|>", "\x1fa b c\x0bd", "İstanbul ﬁ 東京 👍🏽", "\x00 x"]
    rows = [(k * 3 % 7, t) for k, t in enumerate(texts)] + [(None, "none")]
    tokenizer = Tokenizer.from_file(vocabulary)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for apart in (True, False):
        path = token_ids.write_ids(docs, vocabulary, words_apart=apart)
        got = sorted((-1 if r.doc_id is None else r.doc_id, list(r.ids)) for r in token_ids.read_ids(spark, path).collect())
        want = sorted((-1 if k is None else k, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]) for k, t in rows)
        assert got == want
        ordered = token_ids.read_ids(spark, path).orderBy("row").collect()
        assert [r.doc_id for r in ordered] == sorted((k for k, _ in rows), key=lambda k: -1 if k is None else k)
        start = 0
        found = {(r.start, r.n_tokens, r.ids_crc32) for r in token_ids.positions(spark, path).collect()}
        for r in ordered:
            assert (start, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes())) in found
            start += len(r.ids)


def test_stripes_are_skipped_by_id(spark, vocabulary):
    docs = spark.range(20_000).select((F.col("id") * 2).alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    path = token_ids.write_ids(docs, vocabulary, words_apart=True, stripe_bytes=1 << 16, index_rows=1000)
    one = token_ids.read_ids(spark, path).filter("doc_id = 3001")
    assert one.count() == 0
    assert "EqualTo(doc_id,3001)" in one._jdf.queryExecution().executedPlan().toString()
    assert token_ids.read_ids(spark, path).filter("doc_id between 3000 and 3010").count() == 6


# ---- surrogates ----


def test_surrogates_keep_type_identity_and_format(spark):
    text = (
        "Mr. John Smith met Mrs Anna Müller. Later Smith called +1 (555) 123-4567 or +15551234567, mail John.Smith@Corp.com and JOHN.SMITH@corp.com, "
        "amy@corp.com. SMITH paid 4111 1111 1111 1111 and 4111-1111-1111-1111 from 10.1.2.3. Г-жа Петрова, DE89 3704 0044 0532 0130 00, 123-45-6789, " + "ab" * 20)
    rows = [(1, text), (2, "Frau Müller: amy@corp.com"), (3, "nothing, 12.5 of 1.2.3"), (4, None), (5, ""), (1, text)]
    got = surrogates.replace_entities(spark.createDataFrame(rows, "doc_id long, text string"), "key").collect()
    by = {r.doc_id: r for r in got}
    clean = by[1].clean_text
    for secret in ("Smith", "John", "Anna", "Müller", "SMITH", "123-4567", "Corp", "4111 1111", "10.1.2.3", "Петрова", "3704", "6789", "abab"):
        assert secret not in clean
    first, last = re.match(r"Mr\. (\S+) (\S+) met", clean).groups()
    assert f"Later {last} called" in clean and f"{last.upper()} paid" in clean and last.endswith("n") and first.endswith("n")
    assert re.search(r"met Mrs (\S+a) (\S+a)\.", clean).group(2) in by[2].clean_text
    phone = re.search(r"\+1 \((\d{3})\) (\d{3})-(\d{4}) or \+1(\d{10})", clean).groups()
    assert "".join(phone[:3]) == phone[3]
    mails = re.findall(r"[a-z]+@([a-z]+)\.example", clean)
    assert len(mails) == 3 and len(set(mails)) == 1 and len(set(re.findall(r"[a-z]+@", clean))) == 2
    cards = re.search(r"paid (\d{4} \d{4} \d{4} \d{4}) and (\d{4}-\d{4}-\d{4}-\d{4})", clean).groups()
    digits = [int(c) for c in cards[0].replace(" ", "")][::-1]
    assert cards[0].replace(" ", "-") == cards[1] and sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits)) % 10 == 0
    assert re.search(r"Г-жа [А-Я][а-я]+а, DE\d\d( \d{4}){4} \d\d, \d{3}-\d{2}-\d{4}, [0-9a-f]{40}$", clean)
    assert by[3].clean_text == by[3].text and by[4].clean_text is None and by[5].clean_text == "" and by[4].n_entities == 0


def test_an_entity_is_found_where_the_text_holds_nothing_else(spark):
    entities = [
        ("phone", "+33 14 20 30 40 50"), ("secret", "a1b2c3d4e5f6a7b8c9d0e1f2a3b4c5d6"), ("secret", "deadbeefcafebabe" * 2), ("secret", "DEADBEEFCAFEBABE" * 2),
        ("account", "GB29 ABCD EFGH IJKL MN"), ("address", "1.2.3.4"), ("email", "ann@corp.com"), ("card", "4111 1111 1111 1111"), ("social", "123-45-6789")]
    docs = spark.createDataFrame([(k, f"so {x} it is") for k, (_, x) in enumerate(entities)], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: [(m.kind, m.x) for m in r.mentions] for r in surrogates._found(docs, F.col("text")).collect()}
    assert got == {k: [entity] for k, entity in enumerate(entities)}


def test_colliding_surrogates_try_again(spark, monkeypatch):
    """With a space of ten surrogates, nine addresses stay distinct and none equals an original."""
    small = lambda key, kind, canon, gender, attempt: F.concat(F.lit("9.9.9."), (F.abs(F.xxhash64(canon, attempt)) % 12).cast("string"))
    monkeypatch.setattr(surrogates, "surrogate", small)
    rows = [(k, f"from 1.1.1.{k} and 1.1.1.{(k + 1) % 8}, 9.9.9.3") for k in range(8)]
    got = surrogates.replace_entities(spark.createDataFrame(rows, "doc_id long, text string"), "key").collect()
    own = {}
    for r in got:
        for a, b in zip(re.findall(r"[\d.]+\d", r.text), re.findall(r"[\d.]+\d", r.clean_text), strict=True):
            assert own.setdefault(a, b) == b
    assert len(set(own.values())) == len(own) == 9 and "9.9.9.3" not in own.values()


# ---- pipeline ----


def test_pipeline_on_odd_rows(spark, tmp_path):
    folder = odd.write(tmp_path)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        out.write.parquet(f"{folder}/stage{k}")
        docs = spark.read.parquet(f"{folder}/stage{k}")
        assert docs.columns[:5] == corpus_pipeline.COLUMNS
    assert {"shard", "slot"} <= set(docs.columns)
    assert docs.count() == docs.select("doc_id", "text").distinct().count()


# ---- pipeline: the quality stage ----


def test_rejected_documents_are_left_out_without_judging_them_twice(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    judged, kept = quality.judge(docs), quality.passed(docs)
    assert kept.columns == judged.columns
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, judged.filter("kept").collect()))
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter " in line and "zip_with" in line]
    assert plan.count("zip_with") <= 2 * judged._jdf.queryExecution().optimizedPlan().toString().count("zip_with")
    assert quality.passed(docs.limit(0)).collect() == []


def test_repeats_let_go_of_their_windows_before_the_texts_move(spark):
    manager = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def shuffles():
        found = set()
        for folder in manager.localDirs():
            for _, _, names in os.walk(folder.getPath()):
                found |= {n.split("_")[1] for n in names if n.startswith("shuffle_")}
        return found

    before = shuffles()
    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(i % 3, 90))) for i in range(40)], "doc_id long, text string")
    cut = substrings.remove_repeats(docs)
    end = time.time() + 30
    while len(shuffles() - before) > 1 and time.time() < end:
        time.sleep(0.2)
    assert len(shuffles() - before) <= 1  # that of the last small job
    assert cut.filter("n_removed = 0").count() == 1 and cut.filter("n_removed > 0").count() == 39
