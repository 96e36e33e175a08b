"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import hashlib
import random
import math
import re

import numpy as np
import pytest

from lumenframe.llm import decontaminate, line_dedup, mixing, near_dup, quality, substring_exact, substring_near, tokens, toxicity, url_filter

rng = random.Random(7)
WORDS = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8))) for _ in range(4000)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


LONG = prose(30_000, 1)
PASSAGE = prose(70, 2)
TEXTS = [
    (0, None), (1, ""), (2, " \n\n "), (3, "word"), (4, "word"), (5, "a b c d e"), (6, LONG), (7, LONG + " tail"),
    (8, f"{prose(90, 3)} {PASSAGE} {prose(40, 4)}"), (9, f"{prose(60, 5)} {PASSAGE} {prose(90, 6)}"), (9, f"{prose(60, 5)} {PASSAGE} {prose(90, 6)}"),
    (10, "é日本語 ñ 🙂 " * 30), (11, "é日本語 ñ 🙂 " * 30), (None, PASSAGE), (12, "a" * 500), (13, "A" * 499), (14, prose(200, 7)),
]
#: Columns that clash with names the operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tie string, key int, part int, payload string, u string, row_hash int, n int, shard int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, "s", 1, "x", 1, 1, "x", "x", 1, 1, 1) for i, t in TEXTS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(15)] + [(3, None, None), (None, 1, 1), (4, 1, 1)], "doc_id long, quality int, toxic int")


def ids(df):
    return sorted((r.doc_id for r in df.select("doc_id").collect()), key=lambda v: (v is not None, v))


ALL = sorted((i for i, _ in TEXTS), key=lambda v: (v is not None, v))


def test_tokens(spark, docs, none, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    out = f"file://{tmp_path}/t"
    tokens.write_tokens(docs, out, path, end_id=2, block_ids=300)
    got = sorted(((r.doc_id, r.start, r.ids) for r in tokens.read_tokens(spark, out).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == ALL
    tok = Tokenizer.from_file(path)
    plain = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for i, t in TEXTS}
    flat = []
    for doc, start, x in got:
        assert x == plain[doc] and start == len(flat)
        flat += x
    assert tokens.read_range(spark, out, 5, len(flat) - 3).tolist() == flat[5:-3]
    tokens.write_tokens(none, f"file://{tmp_path}/e", path, end_id=2)
    assert tokens.read_digests(spark, f"file://{tmp_path}/e").count() == 0


@pytest.mark.parametrize("bits", [1, 7, 13, 16, 17, 31, 32])
def test_fixed_width_packing(bits):
    x = np.random.default_rng(bits).integers(0, 1 << bits, 1001, dtype=np.uint64).astype("<u4")
    p = tokens.pack(x, bits)
    assert len(p) == -(-1001 * bits // 8)
    assert (tokens.unpack(p, bits, 0, 1001) == x).all() and (tokens.unpack(p, bits, 333, 700) == x[333:700]).all()


def test_special_strings_and_odd_spaces_are_encoded_as_by_the_library():
    import pyarrow as pa
    import public_tokenizers

    from lumenframe.llm.common import string_bytes

    enc = tokens.PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(3)
    texts = ["a<|endoftext|>b", "x  y\n\n z", "it's 'tis", "", "\u00a0a \u2003b", *("".join(r.choice("ab'. \n\t ñ1—s,;日\u00a0\u3000") for _ in range(r.randint(0, 40))) for _ in range(3000))]
    for part in (texts[:1], texts[1:]):
        got, at = enc.encode(*string_bytes(pa.array(part)))
        for i, want in enumerate(enc._ids(part)):
            assert got[at[i] : at[i + 1]].tolist() == want.tolist()


def test_exact_windows(docs, none):
    from test_corpus_queries import windows_removed

    got = {(r.doc_id): (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in substring_exact.remove_spans(substring_exact.repeated_spans(docs)).collect()}
    # the null id precedes all others
    want = windows_removed({-1 if i is None else i: t for i, t in TEXTS}, 50)
    want[None] = want.pop(-1)
    assert got == want
    assert ids(substring_exact.repeated_spans(docs)) == ALL
    assert substring_exact.repeated_spans(none).count() == 0


def test_exact_windows_across_many_sources(spark):
    r = random.Random(11)
    pool = [prose(12, s) for s in range(6)]
    rows = [(i, "".join(r.choice(pool)[: r.randint(10, 90)] + r.choice("xyz") for _ in range(r.randint(0, 6)))) for i in range(150)]
    from test_corpus_queries import windows_removed

    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, hashlib.sha256(bytes(x.kept)).hexdigest()) for x in substring_exact.remove_spans(substring_exact.repeated_spans(df)).collect()}
    assert got == windows_removed(dict(rows), 50)


def test_decontamination(spark, docs, none):
    bench = spark.createDataFrame([(1, " ".join(PASSAGE.split()[20:35])), (2, "Word!"), (3, None), (4, ""), (None, PASSAGE), (5, prose(15, 99))], "item_id long, text string")
    one = decontaminate.find_contamination(docs, bench)
    many = decontaminate.find_contamination(docs, bench, automaton_nodes=64)
    key = lambda r: (r.doc_id is not None, r.doc_id or 0)
    a, b = (sorted(map(lambda r: r.asDict(True), df.select("doc_id", "n_words", "runs", "spans", "items").collect()), key=str) for df in (one, many))
    assert a == b
    by = {r.doc_id: r for r in one.collect()}
    assert by[3].items == ["2"] and by[8].items == by[9].items == ["1"] and by[0].n_words == 0 and not by[14].items
    text = dict(TEXTS)[8].encode()
    (span,) = by[8].spans
    assert text[span["first"] : span["last"]].decode() == " ".join(PASSAGE.split()[20:35])
    assert ids(one) == ALL and key is not None
    assert decontaminate.find_contamination(none, bench).count() == 0
    assert not any(r.items for r in decontaminate.find_contamination(docs, bench.limit(0)).collect())
    left = decontaminate.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and ids(left) == ids(one.where("size(items) = 0"))


def test_toxicity_learns_misspellings(spark, docs, none, labels):
    r = random.Random(5)
    bad = ["grumblox", "snarfwit", "blightoad"]

    def text(toxic):
        w = prose(80, r.random()).split()
        for _ in range(4 * toxic):
            b = r.choice(bad)
            k = r.randrange(1, len(b) - 1)
            w[r.randrange(len(w))] = b[:k] + r.choice("xq0*") + b[k + 1 :] if r.random() < 0.5 else b
        return " ".join(w)

    rows = [(i, text(i % 3 == 0), int(i % 3 == 0)) for i in range(500)]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    lab = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(df, lab)
    got = {x.doc_id: x.score >= 0.5 for x in toxicity.score_toxicity(df.where(toxicity.held_out(df.doc_id)), model).collect()}
    assert sum(got[i] == bool(y) for i, _, y in rows if i in got) >= 0.95 * len(got)
    # odd rows: nothing to learn from, null labels, empty tables
    plain = toxicity.fit_toxicity(docs, labels.limit(0))
    assert not any(x.score >= 0.5 for x in toxicity.score_toxicity(docs, plain).collect())
    odd = toxicity.fit_toxicity(docs, labels)
    scores = toxicity.score_toxicity(docs, odd).collect()
    assert sorted(((x.doc_id) for x in scores), key=lambda v: (v is not None, v)) == ALL and all(0 <= x.score <= 1 for x in scores)
    assert toxicity.score_toxicity(none, odd).count() == 0
    assert toxicity.drop_toxic(docs, plain).columns == docs.columns


def components_plain(rows, percent=75):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in sets}
    names = sorted(sets)
    for a in range(len(names)):
        for b in names[a + 1 :]:
            x, y = sets[names[a]], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = label[names[a]], label[b]
                if p != q:
                    for k, v in label.items():
                        if v == max(p, q):
                            label[k] = min(p, q)
    return {i: (len(s), label[i]) for i, s in sets.items()}


def test_near_duplicates(docs, none):
    got = near_dup.near_duplicates(docs).collect()
    assert sorted((r.doc_id for r in got), key=lambda v: (v is not None, v)) == ALL
    want = components_plain([(i, t) for i, t in TEXTS if i is not None])
    for r in got:
        if r.doc_id is None:
            assert r.kept and r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    assert near_dup.near_duplicates(none).count() == 0
    assert near_dup.drop_near_duplicates(docs).columns == docs.columns


def test_near_duplicates_of_a_family(spark):
    """Copies of one text with edits: many are similar to the source only, some to each other only."""
    r = random.Random(2)
    base = prose(120, 21).split()
    rows = []
    for i in range(160):
        w = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 4, 5, 6, 8])):
            w[r.randrange(len(w))] = r.choice(WORDS)
        rows.append((1000 - i, " ".join(w)))
    for i in range(40):
        rows.append((i, f"{prose(60, 1000 + i)} {PASSAGE}"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_dup.near_duplicates(df, halves=16).collect()}
    assert got == components_plain(rows)


def test_url_filter(spark):
    rows = [(1, "https://a.example.org/es/x"), (2, "HTTP://EXAMPLE.ORG/en/12?q#f"), (3, None), (4, "no scheme"), (5, "http://badexample.org/es/"), (6, "http://x.com/de/1"), (6, "http://x.com/de/1"), (7, ""), (8, "http://org"), (9, "a://b://c.com/fr/"), (None, "http://z.com/fr/q"), (10, "http://org/" + "p" * 5000)]
    df = spark.createDataFrame([(i, u, "k", "h") for i, u in rows], "page_id long, url string, key string, host string")

    def plain(u):
        m = re.search(r"://", u or "")
        rest = u[m.end() :] if m else ""
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        fit = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if path.startswith(p) and (host == h or host.endswith("." + h))]
        return (host, path, max(fit)[1], max(fit)[2]) if fit else (host, path, None, "allow")

    want = sorted(((i, *plain(u)) for i, u in rows), key=str)
    for kw in ({}, {"filter_bytes": 64, "broadcast_bytes": 0}, {"filter_bytes": 64, "broadcast_bytes": 0, "crowd": 1}):
        got = url_filter.filter_urls(df, url_filter.rules_table(spark), keep=["page_id"], **kw).select("page_id", "host", "path", "rule", "verdict")
        assert sorted(map(tuple, got.collect()), key=str) == want
    assert url_filter.filter_urls(df.limit(0), url_filter.rules_table(spark), keep=["page_id"]).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(df, url_filter.rules_table(spark, []), keep=["page_id"]).collect()} == {"allow"}


def test_long_items_are_cut_between_windows(spark):
    words = [f"w{i}" for i in range(decontaminate.PIECE_WINDOWS + 200)]
    at = decontaminate.PIECE_WINDOWS
    rows = [(0, " ".join(words[at - 5 : at + 5])), (1, " ".join(words[at - 5 : at + 4])), (2, " ".join(words[-10:])), (3, "x " + " ".join(words))]
    docs = spark.createDataFrame(rows * 2, "doc_id long, text string")
    bench = spark.createDataFrame([("long", " ".join(words))], "item_id string, text string")
    for nodes in (1 << 20, 25_000):
        got = sorted((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r["items"]) for r in decontaminate.find_contamination(docs, bench, automaton_nodes=nodes).collect())
        one = [(0, 10, [(0, 10)], ["long"]), (1, 9, [], []), (2, 10, [(0, 10)], ["long"]), (3, len(words) + 1, [(1, len(words) + 1)], ["long"])]
        assert got == sorted(one * 2)


def test_bloom_filter_of_tasks_is_that_of_all_keys(spark):
    keys = np.random.default_rng(2).integers(-(1 << 62), 1 << 62, 300_000)
    df = spark.createDataFrame([(int(k),) for k in keys[:200_000]], "key long").repartition(3)
    f = url_filter.bloom_of(df, 200_000)
    g = url_filter.BlockedBloom.sized(200_000)
    g.add(keys[:200_000].astype(np.uint64))
    assert (f.words == g.words).all() and f.probes == g.probes
    assert f.test(keys[:200_000].astype(np.uint64)).all() and f.test(keys[200_000:].astype(np.uint64)).mean() < 0.02
    small = url_filter.BlockedBloom.sized(200_000, most=1 << 18)  # fewer bits a key: more pass, none is lost
    small.add(keys[:200_000].astype(np.uint64))
    assert small.words.nbytes == 1 << 18 and small.test(keys[:200_000].astype(np.uint64)).all()


def test_bloom_filter_has_no_false_negatives():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 20_000).astype(np.uint64)
    f = url_filter.BlockedBloom.sized(10_000)
    f.add(keys[:10_000])
    assert f.test(keys[:10_000]).all() and f.test(keys[10_000:]).mean() < 0.02


def test_quality_rules(spark, docs, none, labels):
    from test_corpus_queries import base_stats

    got = quality.judge(docs, labels).collect()
    assert sorted((r.doc_id for r in got), key=lambda v: (v is not None, v)) == ALL
    plain = {i: base_stats(t) for i, t in TEXTS}
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain[r.doc_id]
        assert r.kept == (not r.base_failed)  # too few labels for any cutoff
    assert quality.judge(none, labels).count() == 0 and quality.judge(docs, labels.limit(0)).count() == len(ALL)


def test_cutoffs_hold_their_risk():
    r = np.random.default_rng(4)
    worst = 0
    for _ in range(40):
        good, bad = np.zeros(quality.GRID + 1, np.int64), np.zeros(quality.GRID + 1, np.int64)
        np.add.at(good, np.minimum(quality.GRID, r.geometric(0.05, 4000)), 1)
        np.add.at(bad, np.minimum(quality.GRID, 60 + r.geometric(0.02, 400)), 1)
        cut = quality.select_cutoffs({("en", "symbols"): (good, bad)}, 0.06, 0.05)[("en", "symbols")]
        worst += 0.95 ** (cut - 1) > 0.06 / len(quality.RULES)
    assert worst <= 6
    assert abs(quality.upper_bound(0, 100, 0.05) - (1 - 0.05**0.01)) < 1e-9


def test_mixing(spark, docs, none):
    out = mixing.replicate(docs, weights={"s": 1.0}, epochs=3.0)
    assert out.columns == [*docs.columns, "copy"]
    assert mixing.replicate(none).count() == 0
    assert mixing.replicate(docs, weights={"other": 1.0}).count() == 0
    many = spark.range(30_000).selectExpr("id as doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 THEN 'b' END as source", "'t' as text")
    n = {r.source: r["count"] for r in mixing.replicate(many, power=0.0, epochs=2.0).groupBy("source").count().collect()}
    assert all(abs(n[k] - 20_000) < 600 for k in ("hot", "b", None))
    old = mixing.BROADCAST_BYTES
    mixing.BROADCAST_BYTES = 0
    try:
        salted = mixing.replicate(many, power=0.0, epochs=2.0).groupBy("source").count().collect()
    finally:
        mixing.BROADCAST_BYTES = old
    assert {r.source: r["count"] for r in salted} == n
    with pytest.raises(ValueError):
        mixing.replicate(docs.withColumn("copy", docs.n))


def test_mixing_counts_are_poisson_at_high_rates(spark):
    few = spark.createDataFrame([(i, "rare" if i else None) for i in range(4)], "doc_id long, source string")
    for r in mixing.rates(few, power=0.0, epochs=1500.0).collect():
        assert abs(r.rate - (1000 if r.src else 3000)) < 1e-6
        lp, total, plain = -r.rate, 0.0, []
        for k in range(len(r.cdf)):
            lp += math.log(r.rate / k) if k else 0.0
            total += math.exp(lp)
            plain.append(total)
        assert np.allclose(r.cdf, plain, rtol=0, atol=1e-10) and abs(r.cdf[-1] - 1) < 1e-9
    assert [(r.rate, r.cdf) for r in mixing.rates(few, weights={}).where("src IS NULL").collect()] == [(0.0, [1.0])]


def test_passages(docs, none):
    found = {(r.x, r.y) for r in substring_near.near_passages(docs).collect()}
    assert (9, 8) in found and (7, 6) in found
    assert not {p for p in found if 14 in p}
    assert substring_near.near_passages(none).count() == 0


def test_compact_windows_cover_all_passages():
    v = np.random.default_rng(0).integers(0, 50, 300).astype(np.uint64)
    left, centre, right = substring_near.compact_windows(v, np.array([0, 0, 300]), 20)
    spans = list(zip(left.tolist(), centre.tolist(), right.tolist()))
    for i in range(0, 280, 7):
        for j in range(i + 19, 300, 13):
            (c,) = [c for a, c, b in spans if a <= i <= c <= j <= b]
            assert v[c] == v[i : j + 1].min()


def test_line_dedup(spark, docs, none):
    line = "This line is repeated in many documents"
    rows = [(i, f"{line}  \nown line number {i} of its own\n{line.upper()}" if i % 2 else f"x\n{line}") for i in range(6)] + [(6, None), (7, ""), (None, line), (2, f"x\n{line}")] + [(8, "\n".join(["short", *[f"{line} {k}" for k in range(150)]])), (9, "\n".join(f"{line} {k}" for k in range(150))), (10, "\n".join(f"{line} {k}" for k in range(100)))]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, line string")
    maps = line_dedup.keep_bitmaps(df)
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in line_dedup.apply_bitmaps(df, maps).collect()), key=str)
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").lower()
    held = {}
    for i, t in rows:
        for s in (t or "").split("\n"):
            if i is not None and len(key(s)) >= 20:
                held.setdefault(key(s), set()).add(i)
    want = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [s for s in lines if i is None or len(held.get(key(s), ())) < 3 or max(held[key(s)]) == i]
        want.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    assert got == sorted(want, key=str)
    assert line_dedup.apply_bitmaps(none, line_dedup.keep_bitmaps(none)).count() == 0
    assert line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs)).count() == len(ALL)
