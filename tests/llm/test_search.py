"""Token alignment and vector searches against brute force, with all odd rows; queries in several threads at once."""

import hashlib
import math
import random
from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest

from attestra.llm import alignment, hard_negatives, topk_search, vectors
from attestra.llm.tokens import vocabulary_path

SCHEMA = "vec_id long, embedding array<float>, label int, `a.b` int, row long, id int, key int, norm double, vector int, part int"


def rows_of(n=260, seed=7):
    rng = np.random.default_rng(seed)
    flat = rng.normal(size=(n, 12)) / 3
    flat[40:80] = flat[40] + 0.01 * rng.normal(size=(40, 12))  # a group of near copies
    flat[80:140] = flat[80]  # one vector many times
    flat[140:150] *= 40
    flat = flat.astype(np.float32).tolist()
    flat[5], flat[6], flat[7], flat[8], flat[9] = None, [], [1.0, None], [math.nan] * 12, [math.inf] + [0.0] * 11
    flat[10], flat[12] = flat[11][:5], flat[11] + [2.0, -1.0]
    flat[13] = [3e38] * 12
    flat[14] = [-3e38] * 12
    ids = list(range(0, 5 * n, 5))
    ids[20], ids[21] = None, None
    rows = [(i, v, None if k % 31 == 3 else k % 4 - 1, *[k % 3] * 4, 0.5, 1, 2) for k, (i, v) in enumerate(zip(ids, flat))]
    return rows + [rows[0], rows[100], rows[100]]  # repeated rows, queries among them


@pytest.fixture
def small_blocks(monkeypatch):
    """Several ranges, blocks of queries and groups, so that nothing is settled in one place."""
    monkeypatch.setattr(vectors, "BLOCK", 6)
    for module in (vectors, topk_search):
        monkeypatch.setattr(module, "RANGE", 40)
    monkeypatch.setattr(hard_negatives, "SAMPLE", 30)


def fit(rows, scale, labelled=False):
    out = []
    for k, (i, v, label, *_) in enumerate(rows):
        if v is None or any(x is None or not math.isfinite(x) for x in v) or labelled and label is None:
            continue
        out.append((k, i, label, [int(math.floor(np.float64(np.float32(x)) * scale)) for x in v]))
    return out


def score(a, b):
    return max(min(sum(x * y for x, y in zip(a, b)), 2**63 - 1), 1 - 2**63)


def order(x):
    return -x[0], x[1] is None, x[1] or 0


@pytest.mark.parametrize("modulus", [100, 35])
def test_top_k(spark, small_blocks, modulus):
    rows = rows_of()
    got = topk_search.top_k(spark.createDataFrame(rows, SCHEMA).repartition(4), lambda i: i % modulus == 0).collect()
    own, want = fit(rows, 1024), []
    for k, i, _, v in own:
        if i is not None and i % modulus == 0:
            near = sorted(((score(v, w), j) for m, j, _, w in own if m != k), key=order)[:10]
            want += [(i, n + 1, j, s) for n, (s, j) in enumerate(near)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_hard_negatives(spark, small_blocks):
    rows = rows_of()
    got = hard_negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(4), lambda i: i % 35 == 0).collect()
    own, want = fit(rows, 256, True), []
    for k, i, label, v in own:
        if i is None or i % 35:
            continue
        scored = [(score(v, w), j, other) for m, j, other, w in own if m != k]
        for p, j, _ in sorted((x for x in scored if x[2] == label), key=order)[:5]:
            inside = sorted((x for x in scored if x[2] != label and 30 * p <= 100 * x[0] <= 90 * p), key=order)[:10]
            want += [(i, j, n + 1, m, p, s) for n, (s, m, _) in enumerate(inside)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr) and len(want) > 200


def test_searches_of_empty_and_tiny_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    every = lambda i: i % 1 == 0
    assert topk_search.top_k(empty, every).count() == 0 == hard_negatives.hard_negatives(empty, every).count()
    two = spark.createDataFrame([(100, [1.0], 1, *[0] * 4, 0.0, 0, 0), (200, [], 1, *[0] * 4, 0.0, 0, 0)], SCHEMA)
    assert sorted(map(tuple, topk_search.top_k(two, every).collect())) == [(100, 1, 200, 0), (200, 1, 100, 0)]
    assert hard_negatives.hard_negatives(two, every).count() == 0


def test_bounds_leave_out_most_pairs():
    """On clustered vectors the index omits entries and the join offers few pairs, none of them missing."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 32))
    x = np.floor(256 * (centres[rng.integers(8, size=2000)] + 0.2 * rng.normal(size=(2000, 32))) / 6)
    q, norm, x_norm = x[:50], np.linalg.norm(x[:50], axis=1), np.linalg.norm(x, axis=1)
    least = np.full(50, 0.7 * float(norm.min()) ** 2)
    _, omitted, _ = hard_negatives.index_of(x, float(norm.max()), float(least.min()))
    assert omitted.mean() > 4
    i, j = hard_negatives.joined(q, norm, least, x, x_norm)
    full = q @ x.T >= least[:, None]
    assert full.sum() == sum(full[a, b] for a, b in zip(i, j)) and len(i) < 1.2 * full.sum() + 50 < 0.3 * full.size


TEXTS = [
    None, "", " ", "  two  spaces ", "one", "a\tb\r\nc", "▁ marks", "x▁y", "日本語のテキスト。\n次の行", "über naïve café", "<|endoftext|> <s> </s> <unk> it's 12", "trail \n\n  \n end", "\x00nul", " nb em 　wide",
    "word " * 40, "same line\n" * 30, "same line\n" * 30, "emoji 😀👩‍👩‍👧 ok", "a" * 300, "1234567890" * 20, "x\n \ny", " lead\nnext  line\t\tz",
]


@pytest.fixture(scope="module")
def sides():
    return alignment.ByteLevel(vocabulary_path()), alignment.SentencePieces(vocabulary_path(alignment.PIECES))


def plain(texts):
    """Per text the groups and links, token by token, by the libraries alone; None where a side loses bytes."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(vocabulary_path()), SentencePieceProcessor(model_file=vocabulary_path(alignment.PIECES))
    a.encode_special_tokens = True
    names = {v: k for k, v in a.get_vocab().items()}
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(x): x for x in shown} | {chr(256 + n): x for n, x in enumerate(x for x in range(256) if x not in shown)}
    bytes_a = lambda i: bytes(letters[ch] for ch in names[i])
    bytes_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    out = []
    for text in texts:
        ids = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        data = [[f(i) for i in side] for f, side in zip((bytes_a, bytes_b), ids)]
        if not text or any(b"".join(d) != (" " + text).encode() for d in data):
            out.append(None)
            continue
        ends = [np.cumsum([len(x) for x in d]).tolist() for d in data]
        cuts, groups = sorted(set(ends[0]) & set(ends[1])), []
        for first, last in zip([0, *cuts], cuts):
            groups.append("|".join(",".join(str(i) for i, e in zip(side, end) if first < e <= last) for side, end in zip(ids, ends)))
        spans = [list(zip([0, *end], end, side)) for side, end in zip(ids, ends)]
        links = [(i, j) for s, e, i in spans[0] for t, f, j in spans[1] if s < f and t < e]
        out.append((len(ids[0]), len(ids[1]), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("most, frequent", [(alignment.SECTION, alignment.FREQUENT), (7, 20), (1, 0)])
def test_alignment(spark, most, frequent):
    rng = random.Random(3)
    texts = TEXTS + [" ".join(rng.choice(["alpha", "Beta", "gamma,", "42", "x-y", "\n"]) for _ in range(rng.randint(1, 60))) for _ in range(30)]
    rows = [(None if k == 4 else k, t, "x", 1) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `pairs.x` string, row int").repartition(3)
    got = alignment.alignment(docs, frequent=frequent, most=most).collect()
    told = plain(texts)
    counts = Counter(x for t in told if t for x in t[3])
    best = {}
    for (_, j), n in counts.items():
        best[j] = max(best.get(j, 0), n)
    want = [(None if k == 4 else k, *((0,) * 6 + ("",) if t is None else (*t[:3], len(t[3]), sum(counts[x] == best[x[1]] for x in t[3]), sum(counts[x] for x in t[3]), t[4]))) for k, t in enumerate(told)]
    columns = "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
    assert sorted((tuple(r[x] for x in columns) for r in got), key=repr) == sorted(want, key=repr)
    assert sum(t is None for t in told) == 4


def test_alignment_of_an_empty_table(spark):
    assert alignment.alignment(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sections_join_to_the_whole(sides):
    rng = random.Random(9)
    for _ in range(150):
        text = "".join(rng.choice(["a", "Word", " ", "  ", "\n", "\t", "'s", "1", "é", "日", ".", " the", "▂", " "]) for _ in range(rng.randint(1, 60)))
        cut = list(alignment.sections(text, 1))
        assert "".join(s for _, s in cut) == text
        for side in sides:
            whole = side.ids(text, 0).tolist()
            assert np.concatenate([side.ids(s, at) for at, s in cut]).tolist() == whole


def test_queries_in_threads_keep_their_own_tables(spark):
    """Each query deletes its own intermediate tables only, so any number of them may run at once."""
    from attestra.llm import queries

    names = ["op2_exact_dedup", "op9_quality_rules", "op12_exact_topk"]
    run = lambda name: sorted(map(str, queries.QUERIES[name](spark, "/root/testdata/sf0.001").collect()))
    with ThreadPoolExecutor(len(names)) as pool:
        at_once = list(pool.map(run, names))
    assert at_once == [run(name) for name in names]


def test_names_with_dots_and_marks(spark):
    """Operators that keep all columns take any names of theirs; rows with null and repeated ids go their longer ways."""
    from attestra.llm import exact_dedup, line_dedup, mixing, near_dedup, quality_classifier

    rng = random.Random(4)
    words = [f"word{k}" for k in range(60)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(20, 60))) for _ in range(40)]
    texts += [texts[0], texts[1].upper(), texts[2] + " more", None, ""]
    rows = [(None if k % 9 == 4 else k % 40, t, "en", f"s{k % 5}", len(t or ""), k, k, "m") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `a.b` int, `row.x` int, `back``tick` string")
    for kept in (exact_dedup.deduplicated(docs), near_dedup.deduplicated(docs), line_dedup.cleaned(docs, 3), mixing.mixed(docs)):
        assert kept.columns == docs.columns
        got = kept.collect()
        assert got and all(r["a.b"] == r["row.x"] and r["back`tick"] == "m" for r in got)
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(40)], "doc_id long, quality int, toxic int")
    assert quality_classifier.accepted(docs, labels).columns == docs.columns


def test_very_long_pre_tokens_stay_out_of_all_tables(spark):
    from attestra.llm import tokens

    texts = ["short words " * 5, "x" * 300_000, "y" * 200_000 + " tail", "ab" * 40, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    path = tokens.vocabulary_path()
    assert max(map(len, tokens.frequent(docs, path))) <= tokens.SHORT
    library = tokens.library(path)
    want = {k: len(library.encode(t or "", add_special_tokens=False).ids) for k, t in enumerate(texts)}
    assert {r.doc_id: r.n_tokens for r in tokens.token_counts(docs).collect()} == want
