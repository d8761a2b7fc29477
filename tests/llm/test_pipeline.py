"""The pipeline's stages on a small folder against plain Python."""

import hashlib
import itertools
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import tiktoken

import corpus_pipeline
import public_tokenizers
from quillon.llm import bpe, lines, mixing, simhash, toxicity


@pytest.fixture(scope="module")
def staged(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).cache()
        out.append(docs.collect())
    return out


def test_toxicity_stage(spark, sf, staged):
    model = toxicity.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    reader, w = toxicity.Reader(model.lexicon), model.coefficients
    score = lambda t: 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, (*reader.features(t), 1.0), strict=True))))
    assert Counter(r.doc_id for r in staged[1]) == Counter(r.doc_id for r in staged[0] if score(r.text or "") < toxicity.THRESHOLD)


def test_line_stage(staged):
    sites, texts = defaultdict(set), defaultdict(set)
    for r in staged[1]:
        for line in (r.text or "").split("\n"):
            if line.strip(lines.BLANK):
                sites[line].add(r.source)
                texts[line].add(r.text)
    bad = {x for x, s in sites.items() if len(s) >= lines.SITES and len(texts[x]) > 1}
    got = {r.doc_id: r for r in staged[2]}
    assert len(staged[2]) == len(staged[1])
    for r in staged[1]:
        want = "\n".join(x for x in (r.text or "").split("\n") if x not in bad) if any(x in bad for x in (r.text or "").split("\n")) else r.text
        assert got[r.doc_id].text == want and got[r.doc_id].n_chars == (r.n_chars if want == r.text else len(want))


def test_near_duplicate_stage(staged):
    """Exactly one document, the first, of each class that a similarity of 0.8 on five-word shingles links."""
    sets = {}
    for r in staged[2]:
        words = re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "").encode().split()
        sets[r.doc_id] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    held = defaultdict(list)
    for i, s in sets.items():
        for x in s or {()}:
            held[x].append(i)
    shared = Counter((a, b) for ids in held.values() for a, b in itertools.combinations(sorted(ids), 2))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in shared.items():
        if not sets[a] and not sets[b] or sets[a] and sets[b] and 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert sorted(r.doc_id for r in staged[3]) == sorted(i for i in root if find(i) == i)


def test_mixing_stage(staged):
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    size = Counter()
    for r in staged[3]:
        size[r.source] += words(r.text)
    weight = {s: 1 + i % 3 for i, s in enumerate(sorted(size))}
    free, left, target = set(size), float(sum(size.values())), {}
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if mixing.MOST * size[s] <= level * weight[s]}
        if not full:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: float(mixing.MOST * size[s]) for s in full}
        left -= sum(target[s] for s in full)
        free -= full
    taken, copies = Counter(), Counter(r.doc_id for r in staged[4])
    for r in staged[4]:
        taken[r.source] += words(r.text)
    longest = max(words(r.text) for r in staged[3])
    assert max(copies.values()) <= mixing.MOST
    for s, t in target.items():
        assert abs(taken[s] - t) <= longest


def test_token_stage(staged):
    path = public_tokenizers.path(corpus_pipeline.VOCABULARY)
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    want = Counter()
    for r in staged[4]:
        ids = np.array(lib.encode_ordinary(r.text or ""), "<u4").tobytes()
        want[r.doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
    assert Counter(map(tuple, staged[5])) == want
