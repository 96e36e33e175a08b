"""Registered queries against their SQL, or plain versions where SQL has none."""

import hashlib
import re
import zlib

import pyarrow.parquet as pq
import pytest
from oracle import assert_same

from lumenframe.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf_dir, name):
    assert_same(spark, sf_dir, QUERIES[name], ORACLES[name])


@pytest.fixture(scope="module")
def docs(sf_dir):
    t = pq.read_table(f"{sf_dir}/documents.parquet").to_pydict()
    return dict(sorted(zip(t["doc_id"], t["text"])))


def test_tokens_match_plain_encoding(spark, sf_dir, docs):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    tok, start = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op1_token_output"](spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for doc, text in docs.items():
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 2]
        assert got[doc] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def windows_removed(docs, size):
    seen, out = {}, {}
    for doc, text in sorted(docs.items()):
        b = (text or "").encode()
        cover = bytearray(len(b))
        for k in range(len(b) - size + 1):
            if seen.setdefault(b[k : k + size], doc) < doc:
                cover[k : k + size] = b"\1" * size
        runs = sum(1 for j, c in enumerate(cover) if c and (not j or not cover[j - 1]))
        out[doc] = (len(b), sum(cover), runs, hashlib.sha256(bytes(c for c, f in zip(b, cover) if not f)).hexdigest())
    return out


def test_repeated_windows_match_plain_search(spark, sf_dir, docs):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op2_suffix_dedup"](spark, sf_dir).collect()}
    assert got == windows_removed(docs, 50)


def base_stats(text):
    w, seen, dup, at = re.findall(r"[^\x20\x09-\x0D]+", text or ""), set(), 0, {}
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    for k in range(len(w) - 4):
        at.setdefault(tuple(w[k : k + 5]), []).append(k)
    rep = len({p + j for v in at.values() if len(v) > 1 for p in v for j in range(5)})
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, rep, len(w) < 10 or 100 * rep > 20 * len(w)


def test_quality_statistics_match_plain_count(spark, sf_dir, docs):
    for r in QUERIES["op7_quality_rules"](spark, sf_dir).collect():
        assert tuple(r)[1:7] == base_stats(docs[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_toxicity_rows(spark, sf_dir, docs):
    rows = QUERIES["op4_toxicity"](spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)


def test_passages_cover_repeated_word_windows(spark, sf_dir, docs):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = {r.doc_id: r for r in QUERIES["op9_substring_dedup"](spark, sf_dir).collect()}
    seen, exact, missed = {}, 0, 0
    for doc, text in docs.items():
        w, cover = re.findall(r"[^\x20\x09-\x0D]+", text.translate(low)), set()
        for k in range(len(w) - 49):
            if seen.setdefault(tuple(w[k : k + 50]), doc) < doc:
                cover.update(range(k, k + 50))
        found = {j for s in rows[doc].spans for j in range(s["first"], s["last"])}
        assert rows[doc].n_words == len(w) and rows[doc].n_dup_words == len(found)
        assert rows[doc].class_id <= doc
        exact, missed = exact + len(cover), missed + len(cover - found)
    assert missed <= 0.02 * exact


def test_pipeline_stages(spark, sf_dir, docs):
    import corpus_pipeline as p

    from lumenframe.llm import decontaminate, mixing

    assert [n for n, _ in p.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "token_output"]
    now = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = now.columns, []
    for name, stage in p.STAGES:
        out = stage(spark, now, sf_dir).cache()
        if name != "token_output":
            assert out.columns == columns
        before = {r.doc_id for r in now.select("doc_id").collect()}
        after = {r.doc_id for r in out.select("doc_id").collect()}
        assert after <= before
        seen.append((name, before, after))
        if name == "near_dedup":
            again = {r.doc_id for r in __import__("lumenframe.llm.near_dup", fromlist=["x"]).near_duplicates(now).where("kept").collect()}
            assert after == again
        if name == "decontamination":
            hits = decontaminate.find_contamination(now, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
            assert before - after == {r.doc_id for r in hits.where("size(items) > 0").collect()}
        if name == "mixing":
            assert out.count() == mixing.replicate(now).count()
        if name == "token_output":
            assert out.count() == now.count() and out.agg({"start": "min"}).first()[0] == 0
        now = out


@pytest.mark.parametrize("threshold,gram,settle", [(33, 16, 1 << 20), (40, 16, 1 << 20), (47, 8, 1 << 20), (50, 16, 1 << 20), (50, 16, 1500), (21, 9, 4000), (130, 16, 3000)])
def test_repeated_windows_at_any_threshold(spark, threshold, gram, settle):
    """Few letters, shared pieces and a common gram in ever other surroundings: runs are cut, minimisers are hot, ranges are dealt again."""
    import random

    from lumenframe.llm import substring_exact

    r = random.Random(threshold + settle)
    letters = lambda n, of="ab": "".join(r.choice(of) for _ in range(n))
    pool = [letters(r.randint(20, 160), "abcdef") for _ in range(12)] + ["a" * 200, "xyz" * 60, "é日" * 30]
    texts = {k: "".join(r.choice([r.choice(pool), letters(r.randint(1, 40)), letters(16, "q") + letters(30, "abcdefgh")]) for _ in range(r.randint(0, 14))) for k in range(60)}
    found = substring_exact.repeated_spans(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5), threshold=threshold, gram=gram, settle_bytes=settle)
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, hashlib.sha256(x.kept).hexdigest()) for x in substring_exact.remove_spans(found).collect()}
    assert got == windows_removed(texts, threshold)
