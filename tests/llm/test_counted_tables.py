"""Spelling variants, token counts and resampling: brute force, odd rows, hot groups."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F

import public_tokenizers
from quillon.llm import common, resampling, spelling, tokencounts
from tests.llm.test_small_tables import CLASHING, ROWS, SCHEMA

COUNTED = ("word_bpe_49k.json", "byte_bpe_50k.json")
ODD = [
    "\u0391\u03a3 \u03a3\u0391\u03a3 \u0130stanbul",
    "a\x1cb\x85c\u200bd\u2028e\u180ef\ufeffg",
    "don't I'LL x'S 's''s 12ab_3",
    "e\u0301 \u212b \u212a \u017f \ufb01 \u00bd\u00b2",
    "\u65e5\u672c\u8a9e\u30c6\u30ad\u30b9\u30c8 \U0001f600\U0001f600!!",
    "x<|endoftext|>\u0338y<|startoftext|><|endoftext|><|endof <|ENDOFTEXT|>",
    "=" * 3000 + "ab" * 2000,
    " \n\t ",
]


@pytest.fixture(scope="module")
def docs(spark):
    extra = [(i + 100, t, "en", "a", len(t)) for i, t in enumerate(ODD)]
    table = spark.createDataFrame(ROWS + extra, SCHEMA)
    clashing = {"word", "run", "h", "doc", "lines", "line", "n", "weight", "place", "form", "n_bytes"} | set(CLASHING)
    return table.select("*", *(F.lit(f"{c} of a caller").alias(c) for c in sorted(clashing)))


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("false")


# --- token counts


@pytest.mark.parametrize("name", COUNTED)
def test_counts_are_the_librarys(spark, docs, none, sf, name):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(name))
    rng = random.Random(5)
    letters = [chr(i) for i in range(1, 0x250)] + list("\u0300\u0327\u03a3\u03c3\u0434\u65e5\u0639\u0661\u00b2\u00bd\u3000\u200d\U0001f600")
    letters += [" ", "'s", "<|endoftext|>"] * 9
    mixed = [(i, "".join(rng.choices(letters, k=rng.randrange(80)))) for i in range(1500)]
    tables = (docs, spark.createDataFrame(mixed, "doc_id long, text string"), spark.read.parquet(f"{sf}/documents.parquet"))
    for table in tables:
        given = Counter((r.doc_id, r.text or "") for r in table.select("doc_id", "text").collect())
        want = Counter()
        for (i, t), k in given.items():
            n = len(library.encode(t, add_special_tokens=False).ids)
            want[i, len(t.encode()), n, n > tokencounts.LIMIT] += k
        got = tokencounts.counts(table, public_tokenizers.path(name))
        assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
        assert Counter(tuple(r) for r in got.collect()) == want
    assert tokencounts.counts(none, public_tokenizers.path(name)).count() == 0


@pytest.mark.parametrize("name", COUNTED)
def test_proven_strings_are_one_token(name):
    from tokenizers import Tokenizer

    library, v = Tokenizer.from_file(public_tokenizers.path(name)), tokencounts.load(public_tokenizers.path(name))
    sure = sorted(v.whole)
    assert len(sure) > 30_000
    counter = tokencounts.Counter(v)
    alone = [t for t in sure if counter.exact.findall(counter.normal(t)) == [t] == [counter.normal(t)]]
    assert len(alone) > 0.9 * len(sure)
    assert all(len(e.ids) == 1 for e in library.encode_batch(alone, add_special_tokens=False))


def test_unreachable_strings_are_not_proven():
    """A string of the vocabulary that other merges tear apart is no shortcut."""
    letters = tokencounts.byte_letters()
    vocabulary = {c + s: 0 for c in letters for s in ("", "</w>")} | {"ab": 1, "bc</w>": 2, "abc</w>": 3}
    merges = {("b", "c</w>"): 0, ("a", "b"): 1, ("ab", "c</w>"): 2}
    assert tokencounts.proven(vocabulary, merges, "</w>") & {"ab", "bc", "abc"} == {"bc"}


def test_merges_in_the_order_of_ranks():
    rng = random.Random(2)
    for _ in range(300):
        vocabulary, merges = list("abc"), {}
        for rank in range(rng.randrange(12)):
            pair = (rng.choice(vocabulary), rng.choice(vocabulary))
            merges.setdefault(pair, rank)
            vocabulary.append("".join(pair))
        parts = rng.choices("abc", k=rng.randrange(1, 40))
        plain = list(parts)
        while True:
            ranks = [(merges.get(p, 99), i) for i, p in enumerate(zip(plain, plain[1:], strict=False))]
            if not ranks or min(ranks)[0] == 99:
                break
            i = min(ranks)[1]
            plain[i : i + 2] = [plain[i] + plain[i + 1]]
        assert tokencounts.merged(parts, merges) == len(plain)


def test_other_tokenizers_are_refused(tmp_path):
    import json

    with open(public_tokenizers.path(COUNTED[0]), encoding="utf-8") as f:
        d = json.load(f)
    for part, value in (("normalizer", {"type": "NFKC"}), ("pre_tokenizer", {"type": "Whitespace"})):
        path = tmp_path / f"{part}.json"
        path.write_text(json.dumps(d | {part: value}), encoding="utf-8")
        with pytest.raises(ValueError, match="no counting"):
            tokencounts.load(str(path))


# --- resampling


def plain_resample(rows, target, percent, least, order, buckets, seed):
    def features(text):
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(resampling.WORD, lower)
        grams = [" ".join(words[i : i + n]) for n in range(1, order + 1) for i in range(len(words) - n + 1)]
        return len(words), [crc32(g.encode()) % buckets for g in grams]

    found, aims = [features(t) for _, t in rows], Counter(b for t in target for b in features(t)[1])
    s = Counter(b for _, f in found for b in f)
    all_s, all_t = sum(s.values()), sum(aims.values())
    gain = [math.floor(1000 * math.log((aims[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    out = []
    for (i, _), (n, f) in zip(rows, found, strict=True):
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    long = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = long[: len(long) * percent // 100]
    return out, [(r[0], r[4], k) for k, r in enumerate(drawn, 1)]


@pytest.mark.parametrize("order", [1, 2, 4])
@pytest.mark.parametrize("frequent", [common.FREQUENT, 3])
def test_resampling_by_brute_force(spark, docs, none, monkeypatch, order, frequent):
    monkeypatch.setattr(common, "FREQUENT", frequent)
    rng = random.Random(order)
    lines = [" ".join(rng.choices(["Red", "grün", "blue", "7", "x-y", ""], k=rng.randrange(6))) for _ in range(30)]
    rows = [(i, "\n".join(rng.choices(lines[: 1 + i % 30], k=rng.randrange(9)))) for i in range(200)]
    rows += [(r.doc_id, r.text) for r in docs.collect()] + [(5, rows[9][1]), (5, rows[9][1]), (None, rows[10][1])]
    target = ["red red grün 7", None, "", "blue x\nred"]
    table, aims = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(table, aims, 30, 4, order, 50, 9).collect()
    want, drawn = plain_resample(rows, target, 30, 4, order, 50, 9)
    assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in got) == Counter((i, f, w, s) for i, _, f, w, s in want)
    assert sorted((r["rank"], r.score) for r in got if r["rank"]) == [(k, s) for _, s, k in drawn]
    assert Counter((r.doc_id, r.score) for r in got if r["rank"]) == Counter((i, s) for i, s, _ in drawn)


def test_resampling_of_odd_tables(spark, docs, none):
    got = {r.doc_id: r for r in resampling.resample(docs, docs).collect()}
    assert got[2].n_features == got[2].weight == got[8].n_features == 0 and got[2]["rank"] is None
    assert got[4].n_features == 40_000 and resampling.resample(docs, none).count() == docs.count()
    empty = resampling.resample(none, docs)
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_features", "weight", "score", "rank"]


def test_words_across_lines_are_counted_once(spark):
    """Buckets of runs within lines and across their ends are together those of the whole text."""
    rng = random.Random(3)
    for order in (2, 3, 5):
        cases = [["\n".join(" ".join(rng.choices("abc", k=rng.randrange(1, 5))) for _ in range(rng.randrange(1, 7)))] for _ in range(60)]
        table = spark.createDataFrame(cases, "text string")
        lines = F.transform(F.split("text", "\n"), lambda x: F.split(x, " "))
        inside = F.flatten(F.transform(lines, lambda w: resampling.features(w, order, 10_000)))
        both = F.concat(inside, resampling.across(lines, order, 10_000))
        for text, found in table.select("text", F.array_sort(both)).collect():
            words = text.split()
            grams = [" ".join(words[i : i + n]) for n in range(1, order + 1) for i in range(len(words) - n + 1)]
            assert found == sorted(crc32(g.encode()) % 10_000 for g in grams)


# --- spelling


def edits_apart(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def near_by_edits(words):
    return {(min(a, b), max(a, b)) for i, a in enumerate(words) for b in words[:i] if abs(len(a) - len(b)) < 2 and edits_apart(a, b) == 1}


@pytest.mark.parametrize("cell", [spelling.CELL, 5])
def test_near_words_by_all_pairs(spark, cell):
    """Also where groups are dealt on until one letter is left, for repeated letters, and for one stem in all words."""
    rng = random.Random(8)
    words = {"".join(rng.choices("abé", k=rng.randrange(7, 10))) for _ in range(250)}
    words |= {"commonstem" + "".join(rng.choices("xyz", k=rng.randrange(4))) for _ in range(60)} | {"a" * n for n in range(7, 30)}
    words |= {"q" * 300 + x for x in ("", "r", "rr", "s", "ÿ")}
    got = [tuple(r) for r in spelling.links(spark.createDataFrame([(w,) for w in sorted(words)], "word string"), cell).collect()]
    assert len(got) == len(set(got)) and set(got) == near_by_edits(sorted(words))


def test_dealt_groups_are_bounded(spark):
    words = [(f"sharedbeginning{i:05d}sharedend",) for i in range(4000)]
    words = spark.createDataFrame([(w.translate(str.maketrans("0123456789", "abcdefghij")),) for (w,) in words], "word string")
    sizes = spelling.dealt(words, 50).groupBy("key").count()
    assert sizes.agg(F.max("count")).first()[0] <= 120  # one letter is left where no halving helps


def test_squared_distances_bound_edits():
    rng = random.Random(4)
    for _ in range(200):
        w = "".join(rng.choices("abcàÿ", k=12))
        i, c = rng.randrange(12), rng.choice("abcz÷")
        for v in (w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]):
            x = spelling.letter_counts([w, v])
            assert ((x[0] - x[1]) ** 2).sum() <= spelling.MOST_APART


def plain_variants(rows):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= 7
    n = {w: k for w, k in n.items() if k >= 2}
    near = {w: [] for w in n}
    for a, b in near_by_edits(sorted(n)):
        near[a].append(b)
        near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = set()
    for w, f in form.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, f, root, n[w], len(near[w]), n[f] if f else None))
    return out


def test_variants_by_brute_force(spark, docs, none):
    rng = random.Random(6)
    words = ["necessary", "Necesary", "neccesary", "éléphant", "elephant", "elephants", "Éléphant", "definitely", "definately", "x" * 50, "short"]
    weights = [900, 60, 4, 300, 25, 20, 2, 200, 15, 3, 100]
    rows = [(i if i % 9 else None, " ".join(rng.choices(words, weights, k=30)) + "_chain1chain") for i in range(300)]
    chain = [("abcdefgh", 3), ("abcdefghi", 40), ("abcdefghij", 500), ("abcdefghijk", 6000)]
    rows += [(1000 + k, " ".join([w] * n)) for k, (w, n) in enumerate(chain)]
    rows += [(r.doc_id, r.text) for r in docs.collect()]
    got = [tuple(r) for r in spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    want = plain_variants(rows)
    assert len(got) == len(set(got)) and set(got) == want
    assert {(w, r) for w, _, r, *_ in want} >= {("abcdefgh", "abcdefghijk")}
    assert spelling.variants(none).count() == 0 and spelling.variants(docs).count() >= 0
