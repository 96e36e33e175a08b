"""Verdicts of the quality rules and scores of the toxicity classifier, worked out again in plain Python."""

import math
import random
import re
from fractions import Fraction

import numpy as np
import pytest

from lumenframe.llm import quality, toxicity
from lumenframe.llm.common import string_bytes


def rates(text):
    """The six rates of a text by their definitions; None where there is no denominator."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    chars, lines, seen, dup, at = sum(map(len, words)), 0, set(), 0, {}
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += 1
            dup += line in seen
            seen.add(line)
    for k in range(len(words) - 4):
        at.setdefault(tuple(words[k : k + 5]), []).append(k)
    rep = len({p + j for v in at.values() if len(v) > 1 for p in v for j in range(5)})
    div = lambda a, b: Fraction(a, b) if b else None
    length = div(chars, len(words))
    return {
        "symbols": div(sum(c in "#*$%&|<>" for c in text), len(words)), "repeated_lines": div(dup, lines), "repeated_words": div(rep, len(words)), "capitals": div(sum("A" <= c <= "Z" for c in text), chars),
        "long_words": length / 40 if length is not None else None, "short_words": 1 - length / 40 if length is not None else None,
    }, len(words) < 10 or 100 * rep > 20 * len(words)


def step(rate):
    """The grid step of a rate, as doubles give it."""
    return 0 if rate is None else int(min(quality.GRID, max(0, math.ceil(float(rate) * quality.GRID))))


def passes(k, n, allowed, delta):
    """Whether at most k of n rejected good texts are less likely than delta where the true share is ``allowed``."""
    return k < n and sum(math.comb(n, i) * allowed**i * (1 - allowed) ** (n - i) for i in range(k + 1)) <= delta


def plain_verdicts(rows, labels, risk, delta):
    facts = {i: (lang, *rates(t)) for i, lang, t in rows}
    least = math.ceil(math.log(1 / delta) / (risk / 6))
    strata = {s for s in {f[0] for f in facts.values()} if sum(labels.get(i) == 1 and not f[2] for i, f in facts.items() if f[0] == s) >= least}
    cut = {}
    for s in strata:
        known = [(f[1], labels[i]) for i, f in facts.items() if f[0] == s and not f[2] and i in labels]
        for rule in quality.RULES:
            good, bad = ([step(r[rule]) for r, y in known if y == v] for v in (1, 0))
            best = quality.GRID + 1
            for c in range(quality.GRID, 0, -1):
                if not passes(sum(g >= c for g in good), len(good), risk / 6, delta / (6 * len(strata))):
                    break
                if sum(b >= c for b in bad) > sum(b >= best for b in bad):
                    best = c
            cut[s, rule] = best
    return {i: not base and all(step(r[rule]) < cut.get((s, rule), quality.GRID + 1) for rule in quality.RULES) for i, (s, r, base) in facts.items()}, cut


EXTREMES = {
    "symbols": lambda r, w: " ".join(x + "#*" for x in w),
    "repeated_lines": lambda r, w: "\n".join(" ".join(w[k : k + 3]) for k in range(0, 30, 3)) + "\nab cd\nab cd\nab cd",
    "repeated_words": lambda r, w: " ".join([*w[:40], *w[:4], w[44], *w[:5], w[45]]),
    "capitals": lambda r, w: " ".join(w).upper(),
    "long_words": lambda r, w: " ".join(x * 6 for x in w),
    "short_words": lambda r, w: " ".join(x[0] for x in w),
}


@pytest.mark.parametrize("rule", sorted(EXTREMES))
def test_each_rule_rejects_what_its_cutoff_says(spark, rule):
    r = random.Random(rule)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 9)))
    rows, labels = [], {}
    for i in range(460):
        w = [word() for _ in range(r.randint(46, 70))]
        kind = i % 4
        if kind == 3:
            text, label = EXTREMES[rule](r, w), 0
        else:
            text, label = " ".join(w[k] + ("\n" if k % 9 == 8 else "") for k in range(len(w))), 1
            if r.random() < 0.01:
                text = EXTREMES[rule](r, w)
        rows.append((i, "aa" if i < 400 else "bb", text))
        if i % 5:
            labels[i] = label
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3)
    lab = spark.createDataFrame(list(labels.items()), "doc_id long, quality int")
    got = {x.doc_id: x.kept for x in quality.judge(docs, lab, risk=0.5, delta=0.2).collect()}
    want, cut = plain_verdicts(rows, labels, 0.5, 0.2)
    assert got == want and cut["aa", rule] <= quality.GRID
    bad = [i for i, s, _ in rows if s == "aa" and i % 4 == 3]
    assert sum(not got[i] for i in bad) >= 0.9 * len(bad)
    assert sum(got[i] for i in range(400) if i % 4 != 3) >= 0.9 * 300


M = (1 << 64) - 1
GOLD = 0x9E3779B97F4A7C15


def mixed(x):
    x &= M
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & M
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & M
    return x ^ (x >> 31)


def plain_buckets(word, buckets, sizes):
    """Buckets of a word's n-grams, between marks for its ends, and of the whole word."""
    c, out = [ord(x) for x in f"<{word}>"], []
    for k in range(len(c)):
        h = 0
        for j in range(sizes[1]):
            if k + j == len(c):
                break
            h = mixed(h * GOLD + c[k + j] + j)
            if j + 1 >= sizes[0]:
                out.append(h % buckets)
    return [*out, mixed(sum(mixed(x * GOLD + k) for k, x in enumerate(c))) % buckets]


def plain_score(model, text):
    words = [w for w in re.split(r"[\x20\x09-\x0D.,;:!?\"()\[\]{}|]+", text.translate({c: c + 32 for c in range(65, 91)})) if w]
    n, size = len(words), model.window
    margins = []
    for k in range(max(1, (n + size // 2) // size) if n else 0):
        last = k == max(1, (n + size // 2) // size) - 1
        grams = [g for w in words[k * size : n if last else (k + 1) * size] for g in plain_buckets(w, model.buckets, model.sizes)]
        mean = model.vectors[grams].astype(float).mean(0)
        z = mean @ model.weights.astype(float) + model.bias
        margins.append(z[1] - z[0])
    m = max(margins) if margins else min(float(model.bias[1] - model.bias[0]), -model.shift / max(model.scale, 1e-9) - 1)
    return 1 / (1 + math.exp(-max(-60, min(60, model.scale * m + model.shift))))


def test_scores_follow_from_the_models_parameters():
    import pyarrow as pa

    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdeé-'日") for _ in range(r.randint(1, 12)))
    texts = [" ".join(word().upper() if r.random() < 0.2 else word() + r.choice(["", ",", ".", "!)"]) for _ in range(r.randint(0, 60))) for _ in range(60)] + ["", None, " . ", "x"]
    model = toxicity.SubwordSoftmax(buckets=512, dim=4)
    g = np.random.default_rng(1)
    model.vectors = g.normal(size=(512, 4)).astype(np.float32)
    model.bias = np.array([0.3, -0.2], np.float32)
    model.scale, model.shift = 1.7, -0.4
    got = model.scores(*string_bytes(pa.array(texts, pa.string())))
    assert np.allclose(got, [plain_score(model, t or "") for t in texts], rtol=1e-4, atol=1e-5)
