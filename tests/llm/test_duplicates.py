from collections import defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from countloom.llm import simhash
from countloom.llm.components import components
from countloom.llm.passages import compact_windows, frequent_values, multipliers, packed, places, remove_passages, repeated_passages, shingle_hashes, without_spans


def closure(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_components(spark):
    rng = np.random.default_rng(1)
    links = [(k, k + 1) for k in range(40)] + [(60, k) for k in range(61, 80)] + [tuple(map(int, rng.integers(100, 200, 2))) for _ in range(60)] + [(7, 7), (1, 0)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = closure(200, links)
    assert got == {x: want[x] for e in links if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_fingerprint(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) < width else [b" ".join(words[k : k + width]) for k in range(len(words) - width + 1)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("width,radius,bucket", [(3, 2, 32), (3, 2, 1), (5, 4, 8), (3, 0, 4)])
def test_near_duplicates_match_brute_force(docs, texts, width, radius, bucket):
    if bucket == 1:
        bucket = 2  # the smallest that still has pairs; the rest goes by stars
    got = simhash.near_duplicates(docs, width=width, radius=radius, bucket=bucket).collect()
    fps = [brute_fingerprint(t, width) for _, t in texts]
    root = closure(len(texts), [(a, b) for a, b in combinations(range(len(texts)), 2) if (fps[a] ^ fps[b]).bit_count() <= radius])
    low = defaultdict(lambda: None)
    for k, (i, _) in enumerate(texts):
        if i is not None:
            low[root[k]] = i if low[root[k]] is None else min(i, low[root[k]])
    want = sorted((-1 if i is None else i, f"{fps[k]:016x}", -1 if low[root[k]] is None else low[root[k]]) for k, (i, _) in enumerate(texts))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.fingerprint, -1 if r.component_id is None else r.component_id) for r in got) == want


@pytest.mark.parametrize("radius", [1, 2, 3, 4])
def test_links_close_over_clusters_of_fingerprints(spark, radius):
    rng = np.random.default_rng(radius)
    fps = set()
    for _ in range(12):
        base = int(rng.integers(0, 1 << 63))
        fps.add(base)
        for _ in range(60):
            x = base
            for b in rng.integers(0, 64, int(rng.integers(1, 6))):
                x ^= 1 << int(b)
            fps.add(x)
    own = sorted(fps)
    nodes = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in own], "fp long")
    at = {x - (1 << 64) if x >> 63 else x: k for k, x in enumerate(own)}
    links = [(at[r.a], at[r.b]) for r in simhash.links(nodes, radius, bucket=8).collect()]
    assert all((own[a] ^ own[b]).bit_count() <= radius for a, b in links)
    exact = [(a, b) for a, b in combinations(range(len(own)), 2) if (own[a] ^ own[b]).bit_count() <= radius]
    assert closure(len(own), links) == closure(len(own), exact)


def test_plan_is_a_partition_with_enough_thresholds():
    both = np.full((64, 64), 250.0) + np.diag(np.full(64, 250.0))
    for radius in range(7):
        p = simhash.plan(1000, both, radius)
        assert sorted(b for g in p.partitions for b in g) == list(range(64))
        assert sum(p.thresholds) == radius - len(p.partitions) + 1


def test_near_copies_and_one_of_each(docs, no_docs, texts):
    groups = simhash.near_copies(docs)
    kept = [r.doc_id for r in simhash.one_of_each(docs, groups).select("doc_id").collect()]
    assert 200 in kept and not set(range(201, 240)) & set(kept) and set(range(100, 106)) <= set(kept)
    assert kept.count(None) == 2 and 400 in kept and not {401, 402} & set(kept)
    assert not set(range(300, 310)) & set(kept)  # near copies of 200
    assert set(range(60)) - {5} <= set(kept) | {6}
    assert simhash.near_copies(no_docs).count() == 0


def test_only_similar_texts_are_verified(spark):
    words = [f"word{k}" for k in range(100)]
    edited = {1: [50], 2: [10, 30, 50, 70], 3: list(range(0, 100, 7)), 4: []}
    rows = [(0, " ".join(words))] + [(i, " ".join("changed" if k in e else w for k, w in enumerate(words))) for i, e in edited.items()] + [(5, "a b"), (6, "A  b"), (7, "a c"), (8, ""), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pairs = spark.createDataFrame([(0, k) for k in range(1, 6)] + [(5, 6), (5, 7), (8, 9)], "a long, b long")

    def share(x, y):
        x, y = ({tuple((t or "").lower().split()[k : k + 5]) for k in range(max(1, len((t or "").split()) - 4))} for t in (x, y))
        return len(x & y) / len(x | y)

    text = dict(rows)
    got = {(r.a, r.b) for r in simhash.verified(pairs, docs, width=5, similar=0.8).collect()}
    assert got == {(r.a, r.b) for r in pairs.collect() if share(text[r.a], text[r.b]) >= 0.8} and (0, 1) in got and (0, 3) not in got


def edited_copies():
    """(doc_id, text) of groups of three far apart: a text of new words, and two copies with words replaced or appended."""
    rng, rows, word = np.random.default_rng(3), [], iter(range(10**9))
    for n in (100, 300):
        for share in (0.81, 0.85, 0.9, 0.95):
            for _ in range(12):
                base = [f"word{next(word)}" for _ in range(n)]
                grams = n - 4
                longer = base + [f"word{next(word)}" for _ in range(int(grams / share) - grams)]
                other = list(base)
                gone = 0
                for k in rng.permutation(np.arange(5, n - 5, 5)):
                    if (grams - gone - 5) / (grams + gone + 5) < share:
                        break
                    other[k], gone = f"word{next(word)}", gone + 5
                rows += [(len(rows) + i, " ".join(w)) for i, w in enumerate((base, longer, other))]
    return rows


def test_near_copies_recall_against_brute_force(spark):
    rows = edited_copies()
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    want = closure(len(rows), [(a, b) for g in range(0, len(rows), 3) for a, b in combinations(range(g, g + 3), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    linked = {i for i in got if want[i] != i}
    assert len(linked) == 2 * len(rows) // 3
    assert sum(got[i] == want[i] for i in linked) >= 0.99 * len(linked)
    assert all(got[i] == i for i in got if want[i] == i)


def test_texts_that_a_hub_rejects_are_linked_to_each_other(spark):
    rng = np.random.default_rng(8)
    common = [f"common{k}" for k in range(30)]
    rows = []
    for c in range(5):  # five classes that share a key and, between them, only the common words
        base = common + [f"own{c}x{k}" for k in range(100)]
        for _ in range(9):
            at = int(rng.integers(40, 120))
            rows.append((len(rows), " ".join([*base[:at], f"edit{len(rows)}", *base[at + 1 :]])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    want = closure(len(rows), [(a, b) for a, b in combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    assert len(set(want)) == 5
    keys = spark.createDataFrame([(0, 7, i) for i, _ in rows], "slot int, key long, doc long")
    for bucket in (4, 100):
        links = [(r.a, r.b) for r in simhash.verified_links(keys, docs, width=5, similar=0.8, bucket=bucket).collect()]
        assert closure(len(rows), links) == want


def test_copies_inside_one_very_large_group_are_found(spark):
    """240 texts of which most are a common passage: all meet under common keys, few are similar enough."""
    rng = np.random.default_rng(21)
    common = [f"common{k}" for k in range(90)]
    rows = [(k, " ".join(common + [f"own{k}x{j}" for j in range(int(rng.integers(25, 60)))])) for k in range(200)]
    for k in range(40):  # near copies of the first ones
        words = rows[k][1].split()
        words[int(rng.integers(0, 90))] = f"edit{k}"
        rows.append((1000 + k, " ".join(words)))
    order = [i for i, _ in rows]
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for _, t in rows]
    want = closure(len(rows), [(a, b) for a, b in combinations(range(len(rows)), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for bucket in (6, 32):
        got = {r.doc_id: r.component_id for r in simhash.near_copies(docs, bucket=bucket).collect()}
        linked = [k for k in range(len(rows)) if want[k] != k]
        assert len(linked) >= 40 and sum(got[order[k]] == order[want[k]] for k in linked) >= 0.99 * len(linked)
        assert all(got[order[k]] == order[k] for k in range(len(rows)) if want[k] == k)


def brute_windows(shingles, least, odd):
    """Compact windows by their definition, over one text."""
    mixed = (shingles ^ (shingles >> np.uint64(31))) * odd
    key = [(int(x) >> 32, k) for k, x in enumerate(mixed)]
    out = []
    for c in range(len(key)):
        left = c
        while left and key[left - 1] > key[c]:
            left -= 1
        right = c
        while right + 1 < len(key) and key[right + 1] > key[c]:
            right += 1
        if right - left + 1 >= least:
            out.append((left, c, right))
    return out


@pytest.mark.parametrize("least", [1, 5, 46])
def test_compact_windows(least):
    rng = np.random.default_rng(least)
    sizes = [0, 3, 200, 46, 45, 1000, 1]
    texts = [rng.integers(0, 60, n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for n in sizes]
    odd = np.uint64(0xC2B2AE3D27D4EB4F)
    text, left, c, right = compact_windows(np.concatenate(texts), np.concatenate([[0], np.cumsum(sizes)]), least, 0, odd)
    for k, t in enumerate(texts):
        got = sorted(zip(left[text == k].tolist(), c[text == k].tolist(), right[text == k].tolist(), strict=True))
        assert got == sorted(brute_windows(t, least, odd))


def test_passages_cover_all_repeats(docs, no_docs, texts):
    found = repeated_passages(docs).collect()
    covered = defaultdict(set)
    for r in found:
        assert r.source_id < r.doc_id and r.similarity >= 0.8 and r.last_word - r.first_word >= 49
        covered[r.doc_id] |= set(range(r.first_word, r.last_word + 1))
    own: dict = {}
    for i, t in texts:
        if i is not None:
            own[i] = max(own.get(i, ""), t or "")
    seen: dict = {}
    needed = defaultdict(set)
    for i in sorted(own):
        words = own[i].encode().lower().split()
        for k in range(len(words) - 50):
            first = seen.setdefault(tuple(words[k : k + 51]), i)
            if first != i:
                needed[i] |= set(range(k, k + 51))
    # A word at a stretch's end may agree with one earlier document by chance and not with the one it is linked to.
    assert needed and all(len(needed[i] - covered[i]) <= 2 for i in needed)
    assert set(range(301, 310)) <= set(covered)  # near copies
    assert not set(covered) & set(range(60))  # clean documents
    assert repeated_passages(no_docs).count() == 0


def scattered_passages(groups=8, members=60):
    """Documents with passages of 50 words between words of their own, each passage with the min-hash of five of the first
    six functions at its begin; and where each passage begins."""
    rng, shared, tried = np.random.default_rng(12), [], 0
    while len(shared) < groups:
        words, tried = [f"p{tried}w{i}" for i in range(50)], tried + 1
        hashes = shingle_hashes(pa.array([" ".join(words)]), 5)[0]
        mixed = hashes ^ (hashes >> np.uint64(31))
        if sum(int(np.argmin((mixed * odd) >> np.uint64(32))) < 12 for odd in multipliers(6)) >= 5:
            shared.append(words)
    rows, places = [], {}
    for doc in range(members):
        words = []
        for k in rng.permutation(groups):
            words += [f"own{doc}x{len(words) + i}" for i in range(int(rng.integers(60, 90)))]
            places[doc, int(k)] = len(words)
            words += shared[k]
        rows.append((doc, " ".join([*words, *(f"end{doc}x{i}" for i in range(60))])))
    return rows, places


def missed_passages(found, places):
    covered = defaultdict(set)
    for r in found:
        covered[r.doc_id] |= set(range(r.first_word, r.last_word + 1))
    return [(d, k) for (d, k), at in places.items() if d and not set(range(at, at + 50)) <= covered[d]]


def test_short_passages_of_large_groups(spark):
    rows, places = scattered_passages()
    assert not missed_passages(repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect(), places)


def test_packed_places():
    rng = np.random.default_rng(2)
    top = rng.choice([1, 5, 1000, 4095, 4096, 70_000, (1 << 31) - 1], (500, 3))
    left, c, right = np.sort(rng.integers(0, top + 1), axis=1).T
    context = rng.integers(0, 1 << 32, 500, dtype=np.uint32)
    near, far = packed(context, left, c, right)
    assert ((near >> 32 & 0xFFFFFFFF) == context).all()
    assert all((x == y).all() for x, y in zip(places(near, far), (left, c, right), strict=True))


@pytest.mark.parametrize("splits", [1, 3, 256])
def test_split_values_lose_no_passage(spark, splits):
    rows, where = scattered_passages(4, 40)
    twice = " ".join(f"p{k}" for k in range(55))
    rows += [(9000 + i, f"a{i} {twice} " + " ".join(f"b{i}x{k}" for k in range(80)) + f" {twice} c{i}") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    hot = frequent_values(docs, 5, 46, 8, one_in=1, most=1 << 20, fewest=2)
    assert len(hot) > 30 and len(hot) == len(set(hot.tolist()))
    found = repeated_passages(docs, hot=hot, splits=splits).collect()
    assert not missed_passages(found, where)
    for i in range(1, 5):  # both places in each later document
        assert {s for r in found if r.doc_id == 9000 + i for s in (1, 136) if r.first_word <= s and r.last_word >= s + 54} == {1, 136}


def test_frequent_values(spark):
    shared, rng = " ".join(f"s{k}" for k in range(60)), np.random.default_rng(4)
    docs = spark.createDataFrame([(i, (shared + " " if i % 3 == 0 else "") + " ".join(f"w{x}" for x in rng.integers(0, 10**9, 150))) for i in range(90)], "doc_id long, text string")
    hot = frequent_values(docs, 5, 46, 8, one_in=1, most=200, fewest=10)
    assert 8 <= len(hot) < 200 and {int(v) & 0xFF for v in hot} == set(range(8))
    assert len(frequent_values(docs.where("doc_id < 0"), 5, 46, 8)) == 0


def test_cutting(docs, texts):
    found = repeated_passages(docs)
    left = {r.doc_id: r.text for r in remove_passages(docs, found).select("doc_id", "text").where("doc_id >= 100").collect()}
    before = dict(texts)
    assert left[100] == before[100] and len(left[101].split()) < len(before[101].split()) and 201 not in left and 400 in left and left[401] == ""
    assert without_spans(" a b  c d\n", [(1, 2)]) == " a  d\n"[:2] + " d\n"
    assert without_spans("a b c", [(0, 0), (2, 2)]) == " b"


def test_only_the_greatest_text_of_a_repeated_id_is_cut(spark):
    passage = " ".join(f"shared{k}" for k in range(60))
    rows = [(1, "x " + passage), (2, "zz top " + passage + " end"), (2, "a lesser text " * 40), (2, None), (None, passage), (3, "")]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, gone int, Of_Doc int")
    left = remove_passages(docs, repeated_passages(docs))
    assert left.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in left.collect()) == sorted([(1, rows[0][1]), (2, "zz top end"), (2, rows[2][1]), (2, ""), (0, passage), (3, "")])


def test_sketches_rule_out_no_similar_pair(spark):
    rng = np.random.default_rng(12)
    sets = [rng.integers(0, 1 << 63, size=n, dtype=np.uint64) for n in (1, 5, 40, 200, 1500)]
    for base in list(sets):
        for share in (0.02, 0.1, 0.11, 0.12, 0.3):  # as many shingles replaced or put behind
            gone = int(share * len(base))
            new = rng.integers(0, 1 << 63, size=gone, dtype=np.uint64)
            sets += [np.concatenate([base[gone:], new]), np.concatenate([base, new, base[:3]])]
    begins = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    n, bits = simhash.sketches(np.concatenate(sets), begins)
    assert n.tolist() == [len(set(x.tolist())) for x in sets]
    own = [set(x.tolist()) for x in sets]
    pairs = list(combinations(range(len(sets)), 2))
    similar = {(a, b) for a, b in pairs if len(own[a] & own[b]) >= 0.8 * len(own[a] | own[b])}
    assert all(sum(int(x).bit_count() for x in (bits[a] ^ bits[b]).view(np.uint64)) <= len(own[a] ^ own[b]) for a, b in pairs)
    sketched = spark.createDataFrame([(i, int(n[i]), bits[i].tolist()) for i in range(len(sets))], "doc long, n long, bits array<long>")
    got = {(r.a, r.b) for r in simhash.plausible(spark.createDataFrame(pairs, "a long, b long"), sketched, 0.8).collect()}
    assert similar <= got and len(got) < len(pairs) / 2


def test_passages_between_documents_that_their_common_first_does_not_share(spark):
    """Two documents share 51 words; two earlier ones share the first and the last 49 of them, one too few."""
    rows = []
    for g in range(6):
        words, at = [f"g{g}w{k}" for k in range(51)], len(rows)
        for k, part in enumerate((words[:49], words[2:], words, words)):
            rows.append((at + k, " ".join([*(f"a{at + k}x{i}" for i in range(70)), *part, *(f"b{at + k}x{i}" for i in range(70))])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in ([], frequent_values(docs, 5, 46, 8, one_in=1, most=1 << 20, fewest=2)):
        found = {(r.source_id, r.doc_id): (r.first_word, r.last_word) for r in repeated_passages(docs, hot=hot, splits=3).collect()}
        assert found == {(at + 2, at + 3): (70, 120) for at in range(0, len(rows), 4)}


def test_fingerprints_within_the_radius_are_candidates(spark):
    """With hardly any chance of a common band key, near copies whose fingerprints are linked are found."""
    rng, rows = np.random.default_rng(6), []
    for g in range(8):
        words = [f"g{g}w{k}" for k in range(400)]
        for at in (None, *rng.integers(10, 390, 2)):
            rows.append((len(rows), " ".join("edit" if k == at else w for k, w in enumerate(words))))
    fps = [brute_fingerprint(t, 5) for _, t in rows]
    want = closure(len(rows), [(a, b) for a, b in combinations(range(len(rows)), 2) if (fps[a] ^ fps[b]).bit_count() <= 4])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r.component_id for r in simhash.near_copies(docs, bands=1, rows=250, radius=4).orderBy("doc_id").collect()]
    assert sum(want[k] != k for k in range(len(rows))) >= 6 and all(got[k] == got[want[k]] for k in range(len(rows)))
    assert all(g // 3 == k // 3 for k, g in enumerate(got))


def test_runs_of_near_copies_are_not_listed_again(spark):
    """Near copies are found whole; the runs of equal words inside a found stretch of the same pair give no more rows, while a
    passage that only two of them share does."""
    words, rows = [f"w{k}" for k in range(400)], []
    for k in range(6):
        own = list(words)
        for at in (60 + 50 * k, 75 + 50 * k):
            own[at] = f"edit{k}x{at}"
        rows.append((k, " ".join(own)))
    added = " ".join(f"added{k}" for k in range(52))
    rows = [(k, f"{text} {added}" if k >= 4 else text) for k, text in rows]
    found = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    pairs = [(r.source_id, r.doc_id, r.first_word, r.last_word) for r in found]
    assert {d for _, d, _, _ in pairs} == set(range(1, 6))
    assert any(s == 4 and d == 5 and last >= 451 for s, d, _, last in pairs)
    inside = [(p, q) for p in pairs for q in pairs if p is not q and p[:2] == q[:2] and q[2] <= p[2] and p[3] <= q[3]]
    assert not inside
