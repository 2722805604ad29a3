"""Near passages among many documents that share a signature."""

import numpy as np

from hornspark.llm import substring_dedup
from hornspark.llm.common import Hasher, mixed


def test_every_document_of_a_signature_is_tried(spark):
    """Fifty words, 35 of them in all documents of a family: the last one is close to the third alone, which is neither the first nor the one before."""
    rng, rows, close = np.random.default_rng(5), [], []
    for family in range(60):
        words = lambda n: [f"w{x}" for x in rng.integers(0, 1 << 40, n)]
        core, texts = words(35), []
        for _ in range(8):
            texts.append(core + words(15))
        near = list(texts[2])
        near[42] = "changed"
        texts.append(near)
        least = []
        for text in (texts[2], near):
            tokens = Hasher().shingles(" ".join(text))
            least.append([tokens[np.argmin(mixed(tokens ^ seed))] for seed in substring_dedup._SEEDS])
        close.append(sum(a == b for a, b in zip(*least, strict=True)) >= 2)
        rows += [(family * 10 + k, " ".join(text)) for k, text in enumerate(texts)]
    found = {r.doc_id: r.source_doc_id for r in substring_dedup.substring_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(close) > 30
    assert found == {family * 10 + 8: family * 10 + 2 for family in range(60) if close[family]}


def test_runs_of_a_signature_against_brute_force():
    rng, t = np.random.default_rng(11), 46
    for few in (12, 1 << 30):  # values that repeat in a window, and hardly any
        base = rng.integers(0, few, 91).astype(np.uint64)
        col, tokens = {n: [] for n in ("doc_id", "i0", "more", "c", "lo", "hi")}, []
        for k in range(90):
            v = base.copy()
            at = rng.integers(0, 91, rng.integers(0, 14))
            v[at] = rng.integers(0, few, len(at))
            if k % 3 == 0:
                v = np.insert(v, rng.integers(0, 91), rng.integers(0, few))[:91]
            first = int(rng.integers(0, 46))
            last = int(rng.integers(first, 46))
            lo = int(rng.integers(0, last - first + 1))
            for name, x in (("doc_id", k // 2), ("i0", 1000 * k + first), ("more", last - first), ("c", 45 - first), ("lo", lo), ("hi", last - first if k % 5 else lo - 1)):
                col[name].append(x)
            tokens.append(v[first : last + t])
        col = {n: np.array(x) for n, x in col.items()}
        got = substring_dedup.repeats_in_signature(col, tokens)
        started = 0
        for y in range(90):
            first, own = 45 - col["c"][y], {}
            for i in range(col["lo"][y], col["hi"][y] + 1):
                a = tokens[y][i : i + t]
                for x in range(90):
                    j = first + i - (45 - col["c"][x])
                    if col["doc_id"][x] < col["doc_id"][y] and 0 <= j <= col["more"][x]:
                        b = tokens[x][j : j + t]
                        if len(set(a) & set(b)) * 5 >= len(set(a) | set(b)) * 4:
                            own[i] = min(own.get(i, 99), int(col["doc_id"][x]))
            spans = [(s, a, b) for d, s, a, b in got if d == col["doc_id"][y] and a // 1000 == (col["i0"][y]) // 1000]
            assert {s for s, _, _ in spans} == set(own.values())
            started += len(own)
        assert started > 50


def test_second_place_of_a_passage_in_one_document(spark):
    """A document has a passage twice with the same words: both places repeat a smaller document, exact or near, in another chunk or not."""
    import random

    rng = random.Random(3)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage, other = words(300), words(300)
    near = [f"new{k}" if k % 60 == 30 else w for k, w in enumerate(other)]
    rows = [(1, " ".join(words(30) + passage + words(30))), (2, " ".join(words(30) + other + words(30)))]
    rows += [(5, " ".join(words(40) + passage + words(40) + passage + words(40))), (6, " ".join(words(40) + near + words(40) + near + words(40)))]
    whole = substring_dedup.CHUNK_BYTES
    try:
        for size in (whole, 1):
            substring_dedup.CHUNK_BYTES = size
            docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
            found = {(r.doc_id, r.source_doc_id, r.start_word, r.n_words) for r in substring_dedup.substring_dedup(spark, docs).collect()}
            assert {f for f in found if f[0] == 5} == {(5, 1, 40, 300), (5, 1, 380, 300)}
            assert {f for f in found if f[0] == 6} == {(6, 2, 40, 300), (6, 2, 380, 300)}
    finally:
        substring_dedup.CHUNK_BYTES = whole
