"""Each operator against a brute-force version or an exact round trip, and on odd rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from hornspark.llm import (
    best_fit_packing,
    chat_windows,
    layout_text,
    license_templates,
    quality_ledger,
    spaced_seeds,
    substring_dedup,
    url_templates,
    warc_legacy,
)
from hornspark.llm.common import Hasher, mixed, shingle_hashes
from hornspark.llm.ngram_jaccard import kept_documents, ngram_jaccard, prefix_length

DOCS = "doc_id long, text string, n long, tok string, part int, nid long"  # names that operators use themselves


def prose(rng, n, words=4000):
    return " ".join("".join(chr(97 + int(d)) for d in str(10_000 + rng.randrange(words))) for _ in range(n))


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2, 3) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    rows = [(None, "a row without an id " * 3), (1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "One  TWO"), (6, "x" * 70_000 + " y")]
    base = [prose(rng, 120) for _ in range(6)]
    for k, text in enumerate(base):
        words = text.split()
        for j in range(12):
            own = list(words)
            for _ in range(j // 2):
                own[rng.randrange(len(own))] = f"e{rng.randrange(10**6)}"
            rows.append((100 + 20 * k + j, " ".join(own)))
    passage = prose(rng, 55)
    rows += [(300 + j, f"{prose(rng, 60)} {passage} {prose(rng, 40)}") for j in range(8)]
    rows += [(400 + j, base[0]) for j in range(5)]
    rows += [(500 + j, prose(rng, 80)) for j in range(20)]
    return rows


def shingles(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        x, y = sets[a][1], sets[b][1]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, len(s), least.get(find(k))) for k, (i, s) in enumerate(sets)), key=repr)


def test_ngram_jaccard(spark, corpus):
    got = ngram_jaccard(spark, docs_of(spark, corpus)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute_components(corpus)


def test_ngram_jaccard_repeated_ids_and_empty(spark):
    rng = random.Random(5)
    a, b = prose(rng, 40), prose(rng, 40)
    rows = [(1, a), (1, b), (1, a), (2, b), (3, None)]
    got = ngram_jaccard(spark, docs_of(spark, rows)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (1, 1), (1, 1), (2, 1), (3, 3)]
    assert ngram_jaccard(spark, docs_of(spark, [])).collect() == []


def test_ngram_jaccard_rows_without_ids(spark):
    """Rows without a doc_id are near copies, bridges between others, and groups of their own."""
    rng = random.Random(6)
    a = prose(rng, 60).split()
    bridge = a[:-5] + prose(rng, 5).split()
    far = prose(rng, 5).split() + bridge[5:]
    own = prose(rng, 40)
    rows = [(5, " ".join(a)), (None, " ".join(bridge)), (9, " ".join(far)), (1, own), (None, own + " and more"), (None, prose(rng, 30)), (None, None)]
    rows += [(None, "left alone " + own[::-1])] * 3
    want = brute_components(rows)
    assert (9, len(shingles(" ".join(far))), 5) in want  # linked through the row without an id
    got = ngram_jaccard(spark, docs_of(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == want
    kept = kept_documents(spark, docs_of(spark, rows)).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == sorted([(5, " ".join(a)), (1, own), rows[5], rows[6], rows[7]], key=repr)


def test_kept_documents_keeps_rows_that_share_an_id(spark):
    rng = random.Random(8)
    a, b, c = (prose(rng, 50) for _ in range(3))
    rows = [(1, a), (5, a), (5, b), (7, b + " more"), (3, c), (3, c), (3, c.upper()), (4, None), (4, None), (6, "")]
    clash = "doc_id int, text string, _doc int, _nid int, _at int, _hit boolean, _bits int, _word int, own int"
    docs = spark.createDataFrame([(i, t, 1, 2, 7, True, 4, 5, 6) for i, t in rows], clash)
    kept = kept_documents(spark, docs)
    assert kept.schema == docs.schema
    got = kept.collect()
    assert sorted((r.doc_id, (r.text or "").lower()) for r in got) == [(1, a), (3, c), (4, ""), (4, ""), (5, b), (6, "")]
    assert {(r._at, r._hit, r._bits, r._word, r.own) for r in got} == {(7, True, 4, 5, 6)}
    assert kept_documents(spark, docs.limit(0)).collect() == []


def test_ngram_jaccard_dense_group(spark):
    """A frame that many texts share: links among some, none among others; leaders alone must not decide."""
    rng = random.Random(7)
    frame = prose(rng, 60).split()
    rows = []
    for k in range(60):
        w = list(frame)
        for _ in range(rng.choice([0, 1, 2, 3, 4])):
            w[rng.randrange(len(w))] = f"q{rng.randrange(10**6)}"
        rows.append((k, " ".join(w + prose(rng, rng.choice([0, 5, 10, 14])).split())))
    got = ngram_jaccard(spark, docs_of(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute_components(rows)


@pytest.mark.parametrize("n", range(1, 60))
def test_prefix_length(n):
    """Sets of n that miss a prefix cannot reach the threshold."""
    assert 100 * (n - prefix_length(n)) < 80 * n


def test_hasher_matches_words():
    rng = random.Random(1)
    text = "".join(rng.choice("aB \n\t\xa0é\x0b\x0cz\r ") for _ in range(20_000))
    words = text.encode().lower().split()
    hashes = Hasher().words(text)
    assert len(hashes) == len(words) and len(set(hashes.tolist())) == len(set(words))
    assert len(set(zip(words, hashes.tolist(), strict=True))) == len(set(words))
    import hornspark.llm.common as common

    whole, part = hashes.tolist(), common._PART
    try:
        common._PART = 37
        assert Hasher().words(text).tolist() == whole
        assert len(Hasher().words("a" * 500 + " b")) == 2
    finally:
        common._PART = part


@pytest.mark.parametrize("kinds", [2, 40, 10**6])
def test_compact_windows(kinds):
    rng = np.random.default_rng(kinds)
    h = mixed(rng.integers(0, kinds, 300).astype(np.uint64))
    want = set()

    def build(a, b):
        if b - a + 1 >= 46:
            m = a + int(np.argmin(h[a : b + 1]))
            want.add((a, m, b))
            build(a, m - 1)
            build(m + 1, b)

    build(0, len(h) - 1)
    assert want == set(zip(*(x.tolist() for x in substring_dedup.compact_windows(h, 46)), strict=True))


def brute_repeats(rows):
    """Start words of the 50-word windows that an earlier document has exactly, by document."""
    first, out = {}, defaultdict(set)
    for i, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = (text or "").lower().split()
        for k in range(len(w) - 49):
            if first.setdefault(tuple(w[k : k + 50]), i) < i:
                out[i].add(k)
    return out


def test_substring_dedup(spark, corpus):
    spans = substring_dedup.substring_dedup(spark, docs_of(spark, corpus))
    covered = defaultdict(set)
    for r in spans.collect():
        assert r.source_doc_id < r.doc_id and r.n_words >= 45
        covered[r.doc_id].update(range(r.start_word, r.start_word + r.n_words - 49))
    for doc, starts in brute_repeats(corpus).items():
        assert starts <= covered[doc]
    assert not [d for d in covered if d >= 500 or d < 100 or d == 300]
    left = {r.doc_id: r for r in substring_dedup.remove_spans(docs_of(spark, corpus), spans).collect()}
    texts = dict(corpus)
    assert left[1].text is None and left[500].text == texts[500] and 400 not in left
    assert left[301].text.split() == texts[301].split()[:60] + texts[301].split()[-40:]


def test_substring_dedup_near_and_empty(spark):
    rng = random.Random(11)
    found = 0
    rows = []
    for k in range(30):
        w = prose(rng, 100).split()
        near = list(w)
        for at in (20, 50, 80):
            near[at] = "changed"
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(near))]
    found = {r.doc_id for r in substring_dedup.substring_dedup(spark, docs_of(spark, rows)).collect()}
    assert len(found) >= 27 and all(d % 2 for d in found)
    assert substring_dedup.substring_dedup(spark, docs_of(spark, [])).collect() == []
    same = " ".join(["again"] * 300)
    assert {r.doc_id for r in substring_dedup.substring_dedup(spark, docs_of(spark, [(1, same), (2, same), (2, same)])).collect()} == {2}


def near_passages(change, n, edits, trials):
    """Pairs of documents with a passage of ``n`` words between unrelated texts, changed at random places in the second."""
    rng, rows = random.Random(f"{change} {n} {edits}"), []
    while len(rows) < 2 * trials:
        k = len(rows) // 2
        passage = prose(rng, n, 10**6).split()
        near = list(passage)
        for at in sorted(rng.sample(range(n), edits), reverse=True):
            near[at : at + (change != "inserted")] = [] if change == "deleted" else [f"changed{rng.randrange(10**6)}"]
        pair = [(2 * k + j, [*prose(rng, 60, 10**6).split(), *words, *prose(rng, 60, 10**6).split()]) for j, words in enumerate((passage, near))]
        sets = [[frozenset(zip(*(w[i + d : i + 46 + d] for d in range(5)), strict=True)) for i in range(len(w) - 49)] for _, w in pair]
        if any(5 * len(a & b) >= 4 * len(a | b) for a in sets[0][25:-25] for b in sets[1][25:-25]):  # some windows of 50 words are alike enough
            rows += [(i, " ".join(w)) for i, w in pair]
    return rows


#: Change, words of the passage, number of changes.
CELLS = [(c, n, e) for c in ("replaced", "inserted", "deleted") for n, e in ((60, 1), (60, 2), (100, 1), (100, 3), (200, 4))]


def test_substring_dedup_near_passage_recall(spark):
    """Of pairs with alike windows by brute force, at least nine in ten are found, in each kind of change."""
    rows, cell_of, n = [], {}, 40
    for k, cell in enumerate(CELLS):
        for i, text in near_passages(*cell, n):
            rows.append((1000 * k + i, text))
            cell_of[1000 * k + i] = cell
    spans = substring_dedup.substring_dedup(spark, docs_of(spark, rows)).collect()
    found = defaultdict(set)
    for r in spans:
        assert r.doc_id % 2 and r.source_doc_id == r.doc_id - 1
        found[cell_of[r.doc_id]].add(r.doc_id)
    print({c: len(found[c]) / n for c in CELLS})
    assert sum(map(len, found.values())) >= 0.92 * n * len(CELLS)
    for change in ("replaced", "inserted", "deleted"):
        assert sum(len(found[c]) for c in CELLS if c[0] == change) >= 0.9 * n * len(CELLS) / 3
    assert all(len(found[c]) >= 0.8 * n for c in CELLS)


def test_substring_dedup_whatever_the_layout(spark, corpus):
    """The same spans and sources for one, two and seven partitions, in any order, with small chunks and with large ones."""
    rng, results = random.Random(41), set()
    rows = list(corpus) + [(i, "a " * 8 + corpus[80][1]) for i in (701, 705, 702, 709)]
    whole = substring_dedup.CHUNK_BYTES
    try:
        for parts in (1, 2, 7):
            substring_dedup.CHUNK_BYTES = whole if parts == 1 else 1 << 14
            rng.shuffle(rows)
            spans = substring_dedup.substring_dedup(spark, docs_of(spark, rows).repartition(parts)).collect()
            results.add(tuple(sorted((r.doc_id, r.start_word, r.n_words, r.source_doc_id) for r in spans)))
    finally:
        substring_dedup.CHUNK_BYTES = whole
    assert len(results) == 1
    sources = {d: s for d, _, _, s in results.pop()}
    assert {sources[i] for i in (705, 702, 709)} == {sources[701]}


def test_substring_dedup_exact_around_a_frequent_line(spark):
    rng, rows, pairs = random.Random(17), [], []
    for k in range(15):  # 40 documents share a line of 40 words; two of them share the ten words around it too
        line, ends = prose(rng, 40, 10**6), (prose(rng, 5, 10**6), prose(rng, 5, 10**6))
        x, y = sorted(rng.sample(range(5, 40), 2))
        for j in range(40):
            a, b = ends if j in (x, y) else (prose(rng, 5, 10**6), prose(rng, 5, 10**6))
            rows.append((100 * k + j, f"{prose(rng, 40, 10**6)} {a} {line} {b} {prose(rng, 40, 10**6)}"))
        pairs.append((100 * k + x, 100 * k + y))
    found = {(r.source_doc_id, r.doc_id, r.start_word, r.n_words) for r in substring_dedup.substring_dedup(spark, docs_of(spark, rows)).collect()}
    assert {(x, y, 40, 50) for x, y in pairs} <= {(x, y, max(a, 40), min(n, 50)) for x, y, a, n in found}


@pytest.mark.parametrize("kinds", [30, 200, 10**6])
def test_repeated_starts_slides_over_all_starts(kinds):
    rng, t = np.random.default_rng(kinds), 46
    for _ in range(20):
        x = rng.integers(0, kinds, 200).astype(np.uint64)
        at = int(rng.integers(60, 100))
        y = np.r_[rng.integers(0, kinds, 40).astype(np.uint64), x[40:at], rng.integers(0, kinds, 5).astype(np.uint64), x[at:150], rng.integers(0, kinds, 40).astype(np.uint64)]
        for d in (0, -5):
            a, b = max(0, -d) + 10, min(len(y), len(x) - d) - t - 3
            want = []
            for i in range(len(y) - t + 1):
                p, q = set(y[i : i + t].tolist()), set(x[max(0, i + d) : max(0, i + d + t)].tolist())
                want.append(a <= i <= b and len(p & q) * 5 >= len(p | q) * 4)
            got = substring_dedup.repeated_starts(y, x, np.array([a]), np.array([b]), np.array([d]), t)
            position = [a <= i <= b and int((y[i : i + t] == x[i + d : i + d + t]).sum()) * 5 >= (2 * t - int((y[i : i + t] == x[i + d : i + d + t]).sum())) * 4 for i in range(len(y) - t + 1)]
            assert got.tolist() == [w or p for w, p in zip(want, position, strict=True)]


def some_matches(rng, n):
    m = np.zeros(n, substring_dedup._MATCH)
    m["doc"], m["source"], m["i0"], m["shift"] = rng.integers(0, 2, n), rng.integers(0, 4, n), rng.integers(0, 400, n), rng.integers(-2, 2, n)
    m["i1"] = m["i0"] + rng.integers(0, 9, n)
    return m


def starts_of(rows):
    return [(d, s, shift, i) for d, s, a, b, shift in rows.tolist() for i in range(a, b + 1)]


def test_joined_runs_keep_every_start():
    m = some_matches(np.random.default_rng(5), 200)
    rows = substring_dedup.joined(m)
    assert sorted(starts_of(rows)) == sorted(set(starts_of(m)))


def test_uncovered_starts():
    rng = np.random.default_rng(6)
    for n in (0, 1, 30):
        m, cover = some_matches(rng, 40), some_matches(rng, n)
        hidden = {i for *_, i in starts_of(cover)}
        left = [x for x in substring_dedup.uncovered(m, cover).tolist()]
        want = [(d, s, min(o), max(o), h) for d, s, a, b, h in m.tolist() if (o := [i for i in range(a, b + 1) if i not in hidden])]
        assert left == want


def test_substring_dedup_texts_that_share_an_id(spark):
    rng = random.Random(43)
    a, b = prose(rng, 80), "zz " + prose(rng, 80)
    rows = [(1, b), (5, a), (5, b), (6, prose(rng, 70))]
    docs = spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in rows], "doc_id long, text string, _cut int, _doc int, _text int, _at int")
    spans = substring_dedup.substring_dedup(spark, docs)
    left = substring_dedup.remove_spans(docs, spans)
    assert left.columns == docs.columns and sorted((r.doc_id, r.text) for r in left.collect()) == sorted([rows[0], rows[1], rows[3]])
    assert {(r._cut, r._doc, r._text, r._at) for r in left.collect()} == {(1, 2, 3, 4)}


def test_quality_ledger(spark, corpus):
    rows = quality_ledger.with_verdict(quality_ledger.ledger(spark, docs_of(spark, corpus))).collect()
    texts = defaultdict(list)
    for i, t in corpus:
        texts[i].append(t or "")
    for r in rows:
        text = texts[r.doc_id][0]
        w = [x for x in re.split("[\x20\x09-\x0d]+", text) if x]
        count = defaultdict(list)
        for k in range(len(w) - 4):
            count[tuple(w[k : k + 5])].append(k)
        inside = {k + j for at in count.values() if len(at) > 1 for k in at for j in range(5)}
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(inside))
        assert r.base_failed == (len(w) < 10 or 100 * len(inside) > 20 * len(w)) and not (r.base_failed and r.kept)
    kept = quality_ledger.kept_documents(spark, docs_of(spark, corpus))
    assert kept.columns == docs_of(spark, corpus).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in rows if r.kept)
    assert quality_ledger.ledger(spark, docs_of(spark, [])).collect() == []


def test_quality_measures():
    h = Hasher(fold=False)
    got = dict(zip(quality_ledger.MEASURES, quality_ledger.measure("a b\n\na b\n#$ é É\r\na b", h), strict=True))
    assert got == {"n_words": 9, "word_chars": 10, "n_symbols": 2, "n_dup_lines": 2, "n_repeat_words": 0, "n_lines": 4, "n_letters": 8, "n_upper": 0, "n_stutter": 0}


def test_ablations(spark):
    rows = spark.createDataFrame([(b,) for b in (0, 1, 4, 5, 4, 32)], "fail_bits long")
    got = {(r.policy, r.rule): (r.n_failed, r.n_only_rule, r.n_rejected) for r in quality_ledger.ablations(rows).collect()}
    assert got["v1", "symbols"] == (3, 2, 4) and got["v1", "few_words"] == (2, 1, 4) and got["v2", "letters"] == (1, 1, 5)


def test_spaced_seeds(spark, corpus):
    rng = random.Random(13)
    items = [(k, prose(rng, 30)) for k in range(5)] + [(5, None), (6, "too short"), (None, prose(rng, 25)), (7, prose(rng, 10))]
    texts = dict(items)
    noisy = texts[1].split()
    noisy[4], noisy[13], noisy[22] = "x", "y", "z"
    rows = [(1, f"{prose(rng, 50)} {texts[0].upper()}! {prose(rng, 9)}"), (2, f"{prose(rng, 8)}, {' '.join(noisy)}"), (3, None), (4, ""), (5, texts[7])]
    rows += [(6, " ".join(texts[2].split()[::2] * 3)), (7, texts[None]), (8, " ".join(texts[3].split()[:15])), (None, texts[4])]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id long")
    got = {(r.doc_id, r.item_id) for r in spaced_seeds.contaminated(spark, docs_of(spark, rows + corpus), bench).collect()}
    assert got == {(1, 0), (2, 1), (5, 7), (7, None), (None, 4)}
    clean = spaced_seeds.clean_documents(spark, docs_of(spark, rows), bench)
    assert {r.doc_id for r in clean.collect()} == {3, 4, 6, 8}
    assert spaced_seeds.contaminated(spark, docs_of(spark, []), bench).collect() == []
    assert spaced_seeds.contaminated(spark, docs_of(spark, rows), bench.limit(0)).collect() == []


def test_masks_leave_a_seed_in_every_allowed_pattern():
    for n in range(spaced_seeds.SHORTEST, spaced_seeds.WINDOW + 1):
        whole = [sum(1 << (o + k) for k in mask) for mask in spaced_seeds.MASKS for o in range(n - mask[-1])]
        for bad in itertools.combinations(range(n), n // 5):
            gone = sum(1 << x for x in bad)
            assert any(not o & gone for o in whole), (n, bad)


def brute_passages(docs, items):
    """By document and item, the most equal words of a window, for those with a passage."""
    words = lambda t: re.findall("[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
    out = {}
    for d, text in docs:
        w = words(text)
        for i, item in items:
            q = words(item)
            size = min(20, len(q))
            if size < 8:
                continue
            for shift in range(-len(q), len(w)):
                for a in range(len(q) - size + 1):
                    if 0 <= a + shift and a + shift + size <= len(w):
                        equal = sum(x == y for x, y in zip(q[a : a + size], w[a + shift : a + shift + size], strict=True))
                        if 5 * equal >= 4 * size:
                            out[d, i] = max(out.get((d, i), (0, 0, 0)), (equal, -a, -a - shift))
    return {(d, i, -a, -p, e) for (d, i), (e, a, p) in out.items()}


def test_spaced_seeds_against_brute_force(spark):
    rng = random.Random(61)
    items = [(k, prose(rng, rng.choice([7, 8, 9, 10, 15, 20, 30, 45]), 60 if k % 3 else 4000)) for k in range(14)] + [(3, prose(rng, 12)), (None, prose(rng, 22))]
    docs = []
    for k in range(60):
        words = prose(rng, 30, 60).split()
        for _ in range(rng.randrange(3)):
            q = rng.choice(items)[1].split()
            for at in rng.sample(range(len(q)), min(len(q), rng.choice([0, 1, 2, 3, 5, 9]))):
                q[at] = "other"
            words[len(words) // 2 : len(words) // 2] = q[rng.randrange(4) :]
        docs.append((k, " ".join(words)))
    docs += [(None, items[0][1] + " " + items[1][1]), (77, " ".join(items[5][1].split() * 300)), (78, None), (79, ""), docs[0]]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id int, text string, doc_id long")
    got = spaced_seeds.contaminated(spark, docs_of(spark, docs), bench).collect()
    assert {(r.doc_id, r.item_id, r.item_start, r.doc_start, r.n_equal) for r in got} == brute_passages(docs, items) and len(got) > 12
    assert len(got) == len({(r.doc_id, r.item_id) for r in got})


def test_clean_documents_goes_by_rows(spark):
    rng = random.Random(67)
    item = prose(rng, 30)
    rows = [(1, "a " + item), (1, prose(rng, 40)), (None, item), (None, "left"), (2, None), (2, None)]
    docs = spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in rows], "doc_id long, text string, _own int, _hit int, seed int, stretch int")
    clean = spaced_seeds.clean_documents(spark, docs, spark.createDataFrame([(9, item)], "item_id long, text string"))
    assert clean.columns == docs.columns and sorted(((r.doc_id, r.text, r._own, r._hit) for r in clean.collect()), key=repr) == sorted([(i, t, 1, 2) for i, t in (rows[1], *rows[3:])], key=repr)
    assert spaced_seeds.clean_documents(spark, docs.limit(0), spark.createDataFrame([(9, item)], "item_id long, text string")).collect() == []


def test_license_templates(spark):
    mit = license_templates.TEMPLATES["mit-grant"]
    texts = {
        1: "Released under the MIT License. See also the Apache License, and CC-BY.",
        2: mit.title() + " subject to", 3: mit.replace("charge", "cost"), 4: None, 5: "",
        6: "Copyright (c) 2019 Ann O. Author. All rights reserved.", 7: "copyright one two three four five six all rights reserved",
        8: "cc by cc by", 9: "GNU general\npublic license\x7fé",
    }
    got = {r.doc_id: r for r in license_templates.license_scan(spark, docs_of(spark, list(texts.items()))).collect()}
    assert (got[1].labels, got[1].base_labels, got[1].n_base, got[1].first_word, got[1].last_word) == ("apache,cc-by,mit,release-notice", "apache,cc-by,mit", 3, 3, 11)
    assert got[2].labels == "mit-grant" and got[2].score == 1.0 and got[3].labels == "" and got[4].n_words == got[5].n_words == 0
    assert got[6].labels == "copyright-notice" and got[7].labels == "" and (got[8].n_base, got[8].last_word) == (2, 2) and got[9].labels == "gpl"


def instance(rng, parts, regions):
    """Words of a template, with wildcards filled and its regions as ``regions`` says."""
    out = []
    for p in parts:
        if isinstance(p, list):
            out += instance(rng, p, regions) if regions() else []
        elif isinstance(p, tuple):
            out += [f"name{rng.randrange(99)}" for _ in range(rng.randint(*p))]
        else:
            out.append(p)
    return out


@pytest.mark.parametrize("label", sorted(license_templates.TEMPLATES))
def test_license_automata_against_patterns(label):
    rng, scanner = random.Random(19), license_templates.Scanner()
    template = license_templates.TEMPLATES[label]
    pattern, parts = re.compile(license_templates.pattern(template)), license_templates.parse(template)
    outcomes = set()
    for k in range(200):
        words = instance(rng, parts, lambda: rng.random() < 0.5)
        if k % 2 == 0:
            said = scanner.scan("; ".join(["Other"] * rng.randrange(3) + [w.title() for w in words]) + ".\n")
            assert label in said[5].split(",") and said[6] == 1.0, words
        for _ in range(rng.choice([1, 2])):
            at = rng.randrange(len(words))
            words[at : at + rng.randrange(2)] = [rng.choice([*words, "foo"])]
        words = ["foo"] * rng.randrange(3) + words
        own = scanner.accepts(scanner.automata[label], [w.encode() for w in words])
        assert own == bool(pattern.search(" " + " ".join(words) + " ")), words
        outcomes.add(own)
    assert False in outcomes


def test_license_places_in_long_texts():
    import time

    text = "see the mit license or gnu general public license, " * 40_000
    t = time.perf_counter()
    n_words, n_base, first, last, base, *_ = license_templates.Scanner().scan(text)
    assert (n_words, n_base, first, last, base) == (360_000, 80_000, 2, 359_996, "gpl,mit") and time.perf_counter() - t < 5


def test_license_rows(spark):
    docs = spark.createDataFrame([(None, "MIT license", 1), (1, "MIT license", 2), (1, "MIT license", 3), (2, None, 4)], "doc_id int, text string, labels int")
    got = license_templates.license_scan(spark, docs).collect()
    assert sorted(((r.doc_id, r.n_words, r.labels) for r in got), key=repr) == sorted([(None, 2, "mit"), (1, 2, "mit"), (1, 2, "mit"), (2, 0, "")], key=repr)
    assert license_templates.license_scan(spark, docs.limit(0)).collect() == []


@pytest.mark.parametrize("rows", [100_000, 2])
def test_packing(spark, corpus, monkeypatch, rows):
    monkeypatch.setattr(best_fit_packing, "BUCKET_ROWS", rows)
    got = best_fit_packing.pack(spark, docs_of(spark, corpus + [(4, "one two")])).toPandas()
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    want = []
    for i, t in corpus + [(4, "one two")]:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        want += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(itertools.pairwise(cuts))]
    rows = [(None if np.isnan(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples()]
    assert sorted(rows, key=repr) == sorted(want, key=repr)
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert list(s.offset) == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 2048
    assert best_fit_packing.pack(spark, docs_of(spark, [])).collect() == []


@pytest.mark.parametrize("seed", range(12))
def test_packing_plan(seed):
    rng = random.Random(seed)
    counts = {rng.randint(1, 2048 if seed % 2 else 900): rng.randint(1, 400 if seed % 3 else 3) for _ in range(rng.choice([1, 5, 200, 900]))}
    blocks = best_fit_packing.plan(counts)
    used = defaultdict(int)
    for b in blocks:
        assert sum(b.lengths) <= 2048 and b.count > 0
        for n in b.lengths:
            used[n] += b.count
    assert used == counts
    assert [b.first for b in blocks] == list(itertools.accumulate([0, *(b.count for b in blocks[:-1])]))
    least = -(-sum(n * c for n, c in counts.items()) // 2048)
    big = sum(c for n, c in counts.items() if n > 1024)
    assert sum(b.count for b in blocks) <= max(least, big) * 1.15 + 2
    assert len(blocks) <= 4 * len(counts) + 10


def test_encoder_matches_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    encoder, rng = best_fit_packing.Encoder(path), random.Random(23)
    alphabet = "ab Z'sé\n\t  12_½²'llΩж中\u00a0\x1c<|endoftext|>.,!“”\u0301"
    for n in range(400):
        text = "".join(rng.choice(alphabet[: 12 if n % 2 else None]) for _ in range(rng.randrange(40)))
        assert encoder.ids(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_encoder_matches_the_plain_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, encoder = Tokenizer.from_file(path), best_fit_packing.Encoder(path)
    assert encoder.ids("a<|endoftext|>b").tolist() == [64, 50256, 65]
    rng, parts = random.Random(29), ["<|endoftext|>", "<|endoftext|", " ", "\n", "word", "é", "12", "  <|"]
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert encoder.ids(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def conversations(rng):
    odd = ["<|im_end|>", "%3C|", "%25%0A", "", "a\nb", "<|im_start|>assistant\nx"]
    rows = [(1, 0, "system", "be brief"), (2, None, None, None), (2, 1, "assistant", "x"), (2, 1, "assistant", "x"), (None, 0, "user\nodd", "q"), (-7, 0, "assistant", "%")]
    for k in range(1, 60):
        rows.append((1, k, rng.choice(["user", "assistant"]), " ".join(rng.choice([*odd, prose(rng, 60)]) for _ in range(4))))
    rows += [(9, k, "assistant", prose(rng, 900)) for k in range(4)]
    return rows


def test_chat_round_trip(spark):
    rows = conversations(random.Random(29))
    table = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    windows = chat_windows.chat_windows(spark, chat_windows.with_probe(spark, table)).cache()
    probe = [(-1, 0, "user", chat_windows.PROBE), (-1, 1, "assistant", chat_windows.PROBE)]
    turns = defaultdict(list)
    for c, t, r, x in sorted(rows + probe, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        turns[c].append((r or "", x or ""))
    for r in chat_windows.read_back(windows).collect():
        own = turns.pop(r.conv_id)
        said = "".join(x for role, x in own if role == "assistant")
        assert r.n_turns == len(own) and r.loss_chars == len(said)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert not turns
    own = [w for w in windows.collect() if w.conv_id == 1]
    assert len(own) > 2 and all(w.formatted.startswith("<|im_start|>system\nbe brief") for w in own) and any(w.repeated > 1 for w in own)
    assert all(w.tokens <= chat_windows.BUDGET or len(chat_windows.read_turns(w.formatted)) - w.repeated == 1 for w in own)
    assert chat_windows.chat_windows(spark, table.limit(0)).collect() == []


def test_chat_long_texts_and_empty_tables(spark):
    rng = random.Random(71)
    rows = [(1, 0, "user", prose(rng, 30_000)), (1, 1, "assistant", prose(rng, 20_000)), (2, 0, "assistant", "")]
    table = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    got = {r.conv_id: r for r in chat_windows.read_back(chat_windows.chat_windows(spark, table)).collect()}
    assert got[1].loss_sha256 == hashlib.sha256(rows[1][3].encode()).hexdigest() and got[1].n_windows == 2 and got[2].loss_chars == 0
    assert chat_windows.read_back(chat_windows.chat_windows(spark, table.limit(0))).collect() == []
    from tokenizers import Tokenizer
    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    windows = chat_windows.chat_windows(spark, spark.createDataFrame([(3, 0, "user", "a<|endoftext|> b %")], "conv_id int, turn int, role string, text string")).collect()
    assert windows[0].tokens == len(tokenizer.encode(windows[0].formatted, add_special_tokens=False).ids)


def test_warc_round_trip(spark):
    body = "a body of more than a hundred bytes, with\r\n\r\nblank lines and WARC/1.1\r\n" * 3
    rows = [(5, "http://a/", body), (3, "http://b/ x", body), (None, None, body), (4, "u", None), (6, "u", ""), (7, "u", "é" * 49), (8, "u", "é" * 49), (9, "u", "é" * 50), (10, "u", "é" * 50), (10, "u", "é" * 50)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    got = warc_legacy.legacy_to_warc(spark, pages).collect()
    winners = {}
    for p, _, h in rows:
        if p is not None and len((h or "").encode()) >= 100:
            winners[h] = min(p, winners.get(h, p))
    want = []
    for p, _, h in rows:
        h = h or ""
        ref = winners.get(h)
        ref = None if ref == p else ref
        want.append((p, len(h.encode()), hashlib.sha256(h.encode()).hexdigest(), "revisit" if ref is not None else "response", ref))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == sorted(want, key=repr)
    assert warc_legacy.legacy_to_warc(spark, pages.limit(0)).collect() == []


def test_arc_headers():
    pieces = lambda data: (data[k : k + 7] for k in range(0, len(data), 7))
    data = b"".join(warc_legacy.arc_block(v) + warc_legacy.arc_record(v, "http://x/ y", b"p\n\n", 5) for v in (1, 2, 1))
    records = list(warc_legacy.read_arc(pieces(data)))
    assert [len(r) for r in records] == [6, 10 + 1, 6] and {r["URL"] for r in records} == {"http://x/%20y"} and all(r["body"].endswith(b"\r\n\r\np\n\n") for r in records)
    assert {warc_legacy.page_of(r["body"]) for r in records} == {5}
    with pytest.raises(ValueError):
        list(warc_legacy.read_arc(pieces(data[:-5])))
    with pytest.raises(ValueError):
        list(warc_legacy.read_arc(pieces(warc_legacy.arc_block(2) + warc_legacy.arc_record(1, "u", b""))))


def test_warc_many_archives(spark, tmp_path, monkeypatch):
    """Archives of bounded size, of both versions, whose revisits refer to a record that is there; large pages side by side."""
    monkeypatch.setattr(warc_legacy, "ARCHIVE_BYTES", 4000)
    rng = random.Random(73)
    bodies = [prose(rng, 40), prose(rng, 2000), "", "small", prose(rng, 60)]
    rows = [(k, f"http://h/{k}", bodies[0] if k % 3 == 0 else rng.choice(bodies)) for k in range(90)] + [(91, "http://h/x", prose(rng, 30_000))]
    rng.shuffle(rows)
    pages = spark.createDataFrame(rows, "page_id int, url string, html string")
    warc_legacy.legacy_archives(spark, pages, f"{tmp_path}/arc")
    warc_legacy.convert(spark, f"{tmp_path}/arc", f"{tmp_path}/warc", warc_legacy.Scratch(spark, "test"))
    import gzip
    from pathlib import Path

    for kind in ("arc", "warc"):
        sizes = [len(gzip.open(f).read()) for f in Path(f"{tmp_path}/{kind}").glob("*.gz")]
        assert len(sizes) > 20 and sum(s > 6000 for s in sizes) <= 1 + sum(r[2] == bodies[1] for r in rows)
    found = {r.page_id: r for r in warc_legacy.read_archives(spark, f"{tmp_path}/warc").collect()}
    least = {}
    for k, _, h in rows:
        least[h] = min(k, least.get(h, k))
    for k, u, h in rows:
        of = least[h] if len(h) >= 100 and least[h] != k else None
        r = found[k]
        assert (r.url, r.payload_bytes, r.payload_digest, r.refers_to, r.record_type) == (u, len(h), hashlib.sha256(h.encode()).hexdigest(), of, "response" if of is None else "revisit")
    text = b"".join(gzip.open(f).read() for f in Path(f"{tmp_path}/warc").glob("*.gz")).decode()
    ids = set(re.findall("WARC-Record-ID: (\\S+)", text))
    assert len(ids) == len(rows) and set(re.findall("WARC-Refers-To: (\\S+)", text)) <= ids


def test_url_templates(spark):
    rows = [(1, "HTTP://A.Example.COM/en/1?x"), (2, "https://example.com/en/71"), (3, "x://b.net/de/9"), (4, "x://b.example.net/de/80#f"), (5, "x://org/es/"), (6, None), (7, "no host/en/"), (8, "x://notorg/es/"), (9, "x://com/EN/"), (10, ""), (None, "x://com/en/")]
    rows += [(100 + k, f"http://spam.test/buy/{k}") for k in range(60)] + [(200 + k, f"http://spam.test/read/{1000 + k}.html") for k in range(60)]
    labels = [(k, 0, 0) for k in range(60)] + [(1000 + k, 1, 0) for k in range(60)] + [(None, 0, 1), (3, None, None)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_templates.url_verdicts(spark, pages, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert got[1] == ("a.example.com", "/en/1", "com/en/", "block") and got[2] == ("example.com", "/en/71", "example.com/en/7", "allow")
    assert got[3][2:] == ("net/de/", "allow") and got[4] == ("b.example.net", "/de/80", "example.net/de/8", "block") and got[5][2:] == ("org/es/", "block")
    assert got[6][:3] == got[7][:3] == got[10][:3] == ("", "", None) and got[8][2] is None and got[9][2] is None and got[None][3] == "block"
    assert {got[100 + k][3] for k in range(60)} == {"block"} and {got[200 + k][3] for k in range(60)} == {"allow"}
    assert url_templates.url_verdicts(spark, pages.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect() == []
    assert len(url_templates.url_verdicts(spark, pages, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()) == len(rows)


def test_url_templates_tree(spark):
    """Wildcards at any depth, frequent literals kept, branches that merge and that stand alone; against the SQL."""
    import duckdb

    rng = random.Random(47)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows, labels = [], []

    def page(url, bad=None):
        k = len(rows) + 1
        rows.append((k, url.replace("%", str(k)), "x"))
        if bad is not None:
            labels.append((k, 0 if bad else 1, 0))
        return k

    deep = [page(f"http://deep.test/good/7/a/{word()}/{word()}") for _ in range(20)]
    for _ in range(60):
        page(f"http://mix.test/{word()}/%.html", True)
    good = [page("http://mix.test/good/%/x") for _ in range(40)]
    fine = [page("http://mix.test/fine/%", False) for _ in range(40)]
    merged = [page(f"http://same.test/x{c}/%", rng.random() < 0.9) for c in "abcd" for _ in range(30)]
    long_ = page("http://deep.test/" + "z/" * 300)
    rows += [rows[0], rows[25], (None, "http://mix.test/good/1/x", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, template string")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = url_templates.url_verdicts(spark, pages, table).collect()
    by = {r.page_id: r for r in got}
    assert {by[k].template for k in deep} == {"/good/#/a/*/*"} and by[long_].template.count("z/") == 300
    assert by[21].template == "/*/#.html" and by[21].verdict == "block" and {by[k].template for k in good} == {"/good/#/x"}
    assert {by[k].verdict for k in good + fine} == {"allow"} and {by[k].verdict for k in merged} == {"block"}
    assert len(got) == len(rows)
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    con.register("labels", table.toPandas())
    want = con.execute(url_templates.SQL).fetchall()
    plain = lambda rows: sorted(((None if r[0] is None or r[0] != r[0] else int(r[0]), *r[1:]) for r in rows), key=repr)
    assert plain(map(tuple, got)) == plain(want)


def test_layout():
    page = (
        "<!DOCTYPE html><html><head><title>no</title><style>p{}</style><body><h1>Head &amp; tail</h1><p>one  two<br>three<p>four"
        "<ul><li>a<li>b<ol start=3><li>c</ol></ul><div style='display: none'>no<p>no</div><span hidden>no</span>"
        "<table><caption>cap</caption><tr><th>x<th>long name<tr><td>1<td>2<br>3</table><pre>  k\n   v</pre>end<script>var t='</p>';</script><!-- no -->"
    )
    text, _, cells, items = layout_text.page_text(page)
    assert text == "Head & tail\n\none two\nthree\n\nfour\n\n- a\n- b\n  3. c\n\ncap\nx | long name\n1 | 2\n  | 3\n\n  k\n   v\n\nend" and (cells, items) == (4, 3)


@pytest.mark.parametrize("page", ["", None, "<", "a<b", "<p", "<!-- x", "</p></table></td>", "<td>x<tr>y<table>z", "<table>" * 300 + "x", "<b>" * 5000 + "x", "<table><tr><td><table><tr><td>in</table>out</table>", "<p hidden>a<p>b", "<select><option>a<option>b</select>"])
def test_layout_odd(page):
    layout_text.page_text(page)


def random_page(rng, depth=0):
    """(html, visible words) of a random tree, each by its own rules; end tags that may be left out are so at random."""
    out, seen = [], []
    for _ in range(rng.randint(1, 4)):
        word = f"w{rng.randrange(10**6)}"
        kind = rng.choice(["text", "p", "div", "b", "hide", "none", "ul", "invisible", "dialog", "details", "svg", "comment", "a"]) if depth < 4 else "text"
        inside, words = random_page(rng, depth + 1) if kind not in ("text", "comment", "svg") else ("", [])
        if kind == "text":
            out.append(f" {word} ")
            seen.append(word)
        elif kind == "p":
            out.append(f"<p>{word}" + rng.choice(["</p>", "<div></div>"]) + inside)
            seen += [word, *words]
        elif kind in ("div", "b", "a"):
            out.append(f"<{kind} class='hidden' aria-hidden=true>{inside}</{kind}>")
            seen += words
        elif kind == "hide":
            out.append(f"<div {rng.choice(['hidden', 'hidden=until-found'])}>{inside}</div>")
        elif kind == "none":
            out.append(f"<span style='color:red; DISPLAY : none !important'>{inside}</span>")
        elif kind == "invisible":
            out.append(f"<div style='visibility:hidden'>{word}<i style='visibility:visible'>{word}</i></div>")
            seen.append(word)
        elif kind == "ul":
            out.append(f"<ul><li>{word}<li>{inside}</ul>")
            seen += [word, *words]
        elif kind == "dialog":
            open_ = rng.random() < 0.5
            out.append(f"<dialog{' open' if open_ else ''}>{inside}</dialog>")
            seen += words if open_ else []
        elif kind == "details":
            open_ = rng.random() < 0.5
            out.append(f"<details{' open' if open_ else ''}><summary>{word}</summary>{inside}</details>")
            seen += [word, *(words if open_ else [])]
        elif kind == "svg":
            out.append(f"<svg><title>no</title><text> {word} </text></svg>")
            seen.append(word)
        else:
            out.append(f"<!-- {word} -->")
    return "".join(out), seen


def test_layout_words_against_trees():
    rng = random.Random(53)
    for _ in range(300):
        page, words = random_page(rng)
        assert re.findall(r"w\d+", layout_text.page_text(page)[0]) == words, page


def test_layout_tables_against_grids():
    """Cells with spans, placed slot by slot as the standard says; each word stands where its column starts."""
    rng = random.Random(59)
    for _ in range(200):
        columns, rows = rng.randint(1, 5), rng.randint(1, 6)
        taken, source, cells, n = set(), "<table>", [], 0
        for r in range(rows):
            source += "<tr>"
            for c in range(columns):
                if (r, c) in taken:
                    continue
                wide = rng.choice([1, 1, 2, 3])
                while any((r, c + d) in taken for d in range(wide)) or c + wide > columns:
                    wide -= 1
                tall = min(rng.choice([1, 1, 2]), rows - r)
                taken |= {(r + i, c + d) for i in range(tall) for d in range(wide)}
                n += 1
                word = f"w{n}" + "x" * rng.randrange(9)
                cells.append((r, c, word))
                source += f"<td colspan={wide} rowspan='{tall}'>{word}"
        text, _, found, _ = layout_text.page_text(source + "</table>after")
        assert found == n and text.endswith("after")
        lines = [x for x in text.split("\n")[:-1] if x]
        where = {w: (k, line.index(w)) for k, line in enumerate(lines) for w in re.findall(r"w\d+x*", line)}
        for column in range(columns):
            assert len({where[w][1] for _, c, w in cells if c == column}) <= 1, source
        for r in range(rows):
            assert len({where[w][0] for q, _, w in cells if q == r}) <= 1, source
        order = [where[w] for _, _, w in cells]
        assert order == sorted(order)


def test_layout_long_cells_stay_aligned():
    words = [f"v{k}" for k in range(60)]
    text = layout_text.page_text(f"<table><tr><td>{' '.join(words)}<td>x<tr><td>{'y' * 200}<td>{' '.join(words)}</table>")[0]
    lines = text.split("\n")
    assert re.findall(r"v\d+", "\n".join(lines[:-4])) == words and lines[-4].endswith(" | " + " ".join(words))
    assert {line.index("|") for line in lines} == {61} and text.count("y") == 200
    assert [layout_text.span(x, 1000) for x in (None, "", "2", " 3px", "x", "99999", "-1")] == [1, 1, 2, 3, 1, 1000, 1]


def test_layout_very_long_pages():
    page = "<ul>" + "<li>one <b>two</b>" * 20_000 + "</ul>" + "<table>" + "<tr><td>a<td>b" * 20_000
    text, blocks, cells, items = layout_text.page_text(page)
    assert (cells, items, blocks) == (40_000, 20_000, 40_000) and text.endswith("a | b")


def test_layout_hidden():
    assert layout_text.page_text("<p hidden>a<p>b")[0] == "b"


def test_layout_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a", 1, 2, "no"), (1, "u", "<p>a", 1, 2, "no"), (None, None, None, 1, 2, "no")], "page_id long, url string, html string, n_chars int, n_cells int, text string")
    got = layout_text.layout_text(spark, pages).collect()
    assert sorted((r.page_id or 0, r.text) for r in got) == [(0, ""), (1, "a"), (1, "a")]
    assert layout_text.layout_text(spark, pages.limit(0)).collect() == []


def test_pipeline(spark, corpus, tmp_path):
    import corpus_pipeline

    rng = random.Random(31)
    item = prose(rng, 30)
    rows = corpus + [(600, f"{prose(rng, 40)} {item}"), (601, "bad " * 40)]
    table = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, alive = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.columns == table.columns
        alive.append({r.doc_id: r.text for r in docs.collect()})
    good, apart, cut, clean = alive
    assert 601 not in good and 1 not in good and {500, 600, 100} <= good.keys()
    want = {c for _, n, c in brute_components([(i, t) for i, t in good.items()]) if n}
    assert apart.keys() - {None} == want - {None}
    assert cut[500] == good[500] and len(cut[301].split()) == 100 and cut[300] == good[300]
    assert clean.keys() == cut.keys() - {600}
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} == clean.keys()


@pytest.mark.parametrize("rows", [0, 1])
def test_pipeline_stages_on_odd_tables(spark, tmp_path, rows):
    """Each stage on an empty table and on one with repeated ids, null ids and columns that have names of the operators' own."""
    import corpus_pipeline

    rng = random.Random(83)
    texts = [prose(rng, 70) for _ in range(4)]
    table = [(1, texts[0]), (5, texts[0]), (5, texts[1]), (None, texts[2]), (None, texts[3]), (7, None), (8, ""), (9, "x" * 50_000)]
    own = ["_at", "_hit", "_bits", "_word", "_cut", "_m0", "_doc", "_nid", "_own", "_stays", "tok", "nid", "rid"]
    schema = "doc_id long, text string, " + ", ".join(f"{c} int" for c in own)
    docs = spark.createDataFrame([(i, t, *range(len(own))) for i, t in table * rows], schema)
    spark.createDataFrame([(1, prose(rng, 30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", *own]
        left = docs.collect()
        assert all(tuple(r)[2:] == tuple(range(len(own))) for r in left)
    assert sorted((r.text for r in left)) == sorted(texts * rows)
    assert len(corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()) == 4 * rows
