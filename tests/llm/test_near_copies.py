"""SimHash, shared passages and decontamination against brute force."""

import itertools
import random

import numpy as np
import pytest
import xxhash

from tributary.llm import decontaminate, simhash, substring_dedup
from tributary.llm.components import components


def fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(nodes, edges):
    least = {n: n for n in nodes}
    for _ in nodes:
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    return least


def test_simhash_equals_brute_force(spark, make_docs, words):
    base = words(400)
    near = [*base[:200], "changed", *base[201:]]
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(base).upper()), (4, None), (5, ""), (6, " \t\n"), (7, "one two"), (8, "one\x0btwo"), (9, "é ü ñ ß"),
            (10, " ".join(words(50, 1))), (10, " ".join(words(50, 1))), (11, "a b c d"), (None, "null key"), (12, "x " * 70_000)]
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(make_docs(rows)).collect()}
    prints = [(i, fingerprint(t)) for i, t in rows]
    edges = [(a, b) for (a, p), (b, q) in itertools.combinations(prints, 2) if bin(p ^ q).count("1") <= 2 and a is not None and b is not None]
    least = groups([i for i, _ in prints if i is not None], edges)
    assert got == {(i, f"{p:016x}", least.get(i)) for i, p in prints}


def test_links_of_close_fingerprints(spark):
    rng = random.Random(3)
    seeds = [rng.getrandbits(64) for _ in range(60)]
    prints = {s ^ sum(1 << b for b in rng.sample(range(64), k)) for s in seeds for k in (0, 1, 2, 3) for _ in range(3)}
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    want = {tuple(sorted((a[0], b[0]))) for a, b in itertools.combinations(signed, 2) if bin((a[0] ^ b[0]) & (1 << 64) - 1).count("1") <= 2}
    for crowded in (4096, 1):
        got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame(signed, "fp long"), 2, crowded).collect()}
        assert got == want, crowded


def test_bit_sliced_distances():
    rng = np.random.default_rng(1)
    values = np.concatenate([np.repeat(rng.integers(0, 1 << 63, 5).astype(np.uint64), 40) ^ (np.uint64(1) << rng.integers(0, 60, 200).astype(np.uint64))])
    same = np.arange(200) // 40
    for radius in (1, 2, 3, 5):
        i, j = simhash.close_pairs(values, same, radius)
        want = {(a, b) for a in range(200) for b in range(a + 1, 200) if same[a] == same[b] and bin(int(values[a] ^ values[b])).count("1") <= radius}
        assert set(zip(i.tolist(), j.tolist())) == want and len(i) == len(want)


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (None, 3), (500, 499), (499, 500)]
    names = list(range(1000))
    rng.shuffle(names)
    edges = [(a if a is None else names[a], b if b is None else names[b]) for a, b in edges]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "x long, y long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    assert got == groups({n for e in real for n in e}, real)


def test_empty_tables(spark, make_docs):
    none = make_docs([])
    assert simhash.near_duplicates(none).count() == 0
    assert substring_dedup.passages(none).count() == 0
    assert decontaminate.overlaps(none, none.withColumnRenamed("doc_id", "item_id")).count() == 0


def test_shared_passages(spark, make_docs, words):
    shared = words(80, 9)
    edited = [*shared[:30], "other", *shared[31:60], "more", "words", *shared[60:]]
    rows = [(1, " ".join(words(100, 1) + shared + words(100, 2))), (2, " ".join(words(40, 3) + shared)), (3, " ".join(edited + words(300, 4))),
            (4, " ".join(words(200, 5))), (5, " ".join(words(200, 6) + shared[:30])), (6, None), (7, ""), (8, "de " * 3000), (9, "de " * 200),
            (None, " ".join(shared)), (10, " ".join(shared).upper())] + [(20 + i, " ".join(words(20, 50 + i) + words(60, 8))) for i in range(40)]
    found = [r.asDict() for r in substring_dedup.passages(make_docs(rows)).collect()]
    paired = {d for r in found for d in (r["doc_a"], r["doc_b"])}
    assert paired == {1, 2, 3, 8, 9, 10, *range(20, 60)}  # 200 times one word stand in both 8 and 9
    text = {i: (t or "").lower().split() for i, t in rows}
    for r in found:
        assert r["doc_a"] < r["doc_b"] and r["n_words"] >= 50 and r["similarity"] >= 0.8
        if r["similarity"] == 1:
            assert text[r["doc_a"]][r["start_a"]:r["end_a"]] == text[r["doc_b"]][r["start_b"]:r["end_b"]]
    whole = next(r for r in found if (r["doc_a"], r["doc_b"]) == (1, 2))
    assert (whole["start_a"], whole["end_a"], whole["start_b"], whole["end_b"]) == (100, 180, 40, 120)
    assert len([r for r in found if r["doc_a"] >= 20]) <= 2 * 40  # never all pairs of those that share


def test_rows_that_share_a_key_lend_each_other_no_passage(make_docs, words):
    shared = words(60, 9)
    rows = [(1, " ".join(words(2, 1) + shared)), (1, " ".join(words(70, 2))), (2, " ".join(shared)), (3, " ".join(words(90, 3)))]
    found = substring_dedup.passages(make_docs(rows)).collect()
    assert [(r.doc_a, r.doc_b, r.start_a, r.end_a, r.n_words) for r in found] == [(1, 2, 2, 62, 60)]


def test_a_stretch_that_is_long_enough_is_not_hidden_by_a_better_shorter_one(make_docs, words):
    """Twelve equal words, then every fifth replaced: 60 words agree in four fifths, the best-scored stretch is far shorter."""
    shared = words(60, 9)
    edited = [w if i < 12 or i % 5 else "other" for i, w in enumerate(shared)]
    found = substring_dedup.passages(make_docs([(1, " ".join(words(30, 1) + shared + words(30, 2))), (2, " ".join(words(9, 3) + edited))])).collect()
    assert [(r.doc_a, r.doc_b) for r in found] == [(1, 2)] and found[0].n_words >= 50 and found[0].similarity >= 0.8


def test_chains_that_cannot_be_passages_are_not_aligned(monkeypatch):
    rng = np.random.default_rng(5)
    a, b = (rng.integers(0, 1 << 60, 200).astype(np.uint64) for _ in range(2))
    b[60:65], b[70:75] = a[60:65], a[72:77]
    assert substring_dedup.most_agreeing(a, b, [(60, 60, 5), (72, 70, 5)]) == 15  # ten words of runs and five between them at most
    monkeypatch.setattr(substring_dedup, "gap", lambda a, b: 1 / 0)
    assert substring_dedup.align(a, b, [(60, 60, 5), (72, 70, 5)], 50) is None


def test_chains_equal_the_quadratic_recurrence():
    rng = np.random.default_rng(2)
    for _ in range(30):
        runs = np.unique(np.stack([rng.integers(0, 60, 12), rng.integers(0, 60, 12), rng.integers(1, 9, 12)], axis=1), axis=0)
        best = []
        for x, y, n in runs:
            before = [b - substring_dedup.GAP_COST * (x - p - m + y - q - m) for b, (p, q, m) in zip(best, runs) if p + m <= x and q + m <= y]
            best.append(n + max([0, *before]))
        first = runs[substring_dedup.chains(runs)[0]]
        gaps = (first[1:, :2].sum(axis=1) - first[:-1, :2].sum(axis=1) - 2 * first[:-1, 2]).sum()
        assert abs(first[:, 2].sum() - substring_dedup.GAP_COST * gaps - max(best)) < 1e-9


def test_decontamination_finds_passages_with_replaced_words(spark, make_docs, words):
    item, other = words(20, 1), words(14, 2)
    replaced = [*item[:4], "x", *item[5:9], "y", *item[10:14], "z", *item[15:]]
    rows = [(1, " ".join(words(50, 3) + item + words(50, 4))), (2, " ".join(replaced)), (3, ", ".join(item).upper() + "!"), (4, " ".join(item[:12])),
            (5, " ".join(words(300, 5))), (6, None), (7, ""), (8, " ".join(item[6:] + words(9, 6))), (9, " ".join(other)), (9, " ".join(other)),
            (10, " ".join([*other[:4], "q", *other[5:9], "q", *other[10:]])), (None, " ".join(item))]
    bench = spark.createDataFrame([(1, " ".join(item), "e"), (2, " ".join(other), "e"), (2, " ".join(other), "e"), (3, None, "e"), (4, "too short", "e")],
                                  "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id): (r.overlap_words, r.matched_words) for r in decontaminate.overlaps(make_docs(rows), bench).collect()}
    assert got == {(1, 1): (20, 20), (2, 1): (20, 17), (3, 1): (20, 20), (8, 1): (14, 14), (9, 2): (14, 14), (10, 2): (14, 12), (None, 1): (20, 20)}
    left = decontaminate.clean(make_docs(rows), bench)
    assert sorted((r.doc_id for r in left.collect()), key=str) == [4, 5, 6, 7, None] and "epoch" in left.columns


def test_short_items_and_options_are_honoured(spark, make_docs):
    bench = spark.createDataFrame([(1, "what is two plus"), (2, "three small words"), (3, "one")], "item_id long, text string")
    docs = make_docs([(1, "so What is two, plus?"), (2, "what is two minus"), (3, "these three small words"), (4, "no one here")])
    found = lambda **o: sorted((r.doc_id, r.item_id) for r in decontaminate.overlaps(docs, bench, **o).collect())
    assert found() == [] and found(min_words=4) == [(1, 1)] and found(min_words=3) == [(1, 1), (2, 1), (3, 2)]
    assert found(min_words=1)[-1] == (4, 3)
    for wrong in ({"similarity": 0.6}, {"min_words": 0}, {"similarity": 1.2}):
        with pytest.raises(ValueError):
            decontaminate.overlaps(docs, bench, **wrong)


def test_masks_hit_every_passage_of_four_fifths():
    for n, k in ((13, 2), (14, 2), (15, 3), (20, 4)):
        for gone in itertools.combinations(range(n), k):
            assert any(all(c == "0" or p + i not in gone for i, c in enumerate(m)) for m in decontaminate.MASKS for p in range(n - len(m) + 1)), gone


def test_decontamination_finds_every_way_to_replace_a_fifth(spark, make_docs, words):
    """All places of the replaced words, against all stretches of the item: a shorter piece that scores higher hides nothing."""
    ways = [(n, gone) for n in (5, 6, 9, 10, 12, 13) for gone in itertools.combinations(range(n), n // 5)]
    ways += [(16, (12,)), (20, (9, 10, 11)), (24, (10, 11, 12, 13)), (24, (9, 10, 11, 12, 13)), (24, (3, 8, 12, 16, 20)), (13, (2, 5, 8))]
    items = {n: words(n, 100 + n) for n, _ in ways}
    rows = [(i, " ".join(["before", *("x" if p in gone else w for p, w in enumerate(items[n])), "after"])) for i, (n, gone) in enumerate(ways)]
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    got = {r.doc_id: (r.item_id, r.overlap_words, r.matched_words) for r in decontaminate.overlaps(make_docs(rows), bench).collect()}
    want = {}
    for i, (n, gone) in enumerate(ways):
        stretches = [(b, e, sum(p not in gone for p in range(b, e))) for e in range(1, n + 1) for b in range(e) if e - b >= min(13, n)]
        good = [(m * decontaminate.MATCH + (e - b - m) * decontaminate.MISS, e - b, m) for b, e, m in stretches if 5 * m >= 4 * (e - b)]
        if good:
            want[i] = (n, *max(good)[1:])
    assert got == want and len(want) >= len(ways) - 3


def test_a_pair_with_one_linked_seed_is_looked_at(spark, make_docs, words):
    """Five equal words in a row hold one seed, the rest of the passage none: every fifth word differs. Against all such pairs."""
    rows, pairs = [], {}
    for n in range(20):
        passage = words(54, 300 + n)
        changed = ["other" if i < 25 and i % 5 == 4 or i > 29 and i % 5 == 0 else w for i, w in enumerate(passage)]
        assert sum(a == b for a, b in zip(passage, changed)) >= 0.8 * 54
        rows += [(2 * n, " ".join(passage)), (2 * n + 1, " ".join(changed))]
        longest = [h for h in range(50) if passage[h:h + 5] == changed[h:h + 5]]
        pairs[2 * n, 2 * n + 1] = len(longest)
    found = {(r.doc_a, r.doc_b) for r in substring_dedup.passages(make_docs(rows)).collect()}
    chosen = set()
    for (a, b) in pairs:
        both = [set(substring_dedup.seeds([rows[i][1].encode()])[2].tolist()) for i in (a, b)]
        if both[0] & both[1]:
            chosen.add((a, b))
    assert chosen and found == chosen


def test_a_long_passage_of_frequent_lines_is_found(spark, make_docs, words, monkeypatch):
    """Two lines that many documents hold stand next to each other in a few: their 60 words are a passage of those, whoever else holds a line."""
    x, y = words(30, 7), words(30, 8)
    rows = [(1, " ".join(x + words(40, 1))), (2, " ".join(y + words(40, 2)))]
    rows += [(i, " ".join([*x, *words(20, 100 + i), *y])) for i in range(10, 40)]
    rows += [(i, " ".join([*words(15, 200 + i), *x, *y, *words(15, 300 + i)])) for i in (5, 9, 50, 70)]
    for often in (3, 64):
        monkeypatch.setattr(substring_dedup, "OFTEN", often)
        for parts in (1, 3, 8):
            found = substring_dedup.passages(make_docs(rows).repartition(parts)).collect()
            assert {d for r in found for d in (r.doc_a, r.doc_b)} == {5, 9, 50, 70}, (often, parts)


def test_documents_with_exact_passages_are_those_of_brute_force(spark, make_docs, words):
    """Passages of 51 to 90 words dealt over documents, by several, with lines of 20 words everywhere; in any number of parts."""
    import random
    rng = random.Random(9)
    passages = [words(rng.randrange(51, 91), 500 + i) for i in range(12)]
    lines = [words(20, 700 + i) for i in range(5)]
    rows, held = [], {}
    for d in range(70):
        mine = rng.sample(range(12), rng.choice([0, 0, 1, 2]))
        body = []
        for p in mine:
            body += words(rng.randrange(5, 40), 1000 + 13 * d + p) + passages[p] + rng.choice(lines)
        rows.append((d, " ".join(body + words(30, 3000 + d) + rng.choice(lines))))
        for p in mine:
            held.setdefault(p, set()).add(d)
    want = {d for docs in held.values() if len(docs) > 1 for d in docs}
    for parts in (1, 2, 5):
        found = substring_dedup.passages(make_docs(rows).repartition(parts)).collect()
        assert {d for r in found for d in (r.doc_a, r.doc_b)} == want
        text = dict(rows)
        for r in found:
            a, b = text[r.doc_a].split()[r.start_a:r.end_a], text[r.doc_b].split()[r.start_b:r.end_b]
            assert r.n_words >= 50 and r.similarity >= 0.8 and (r.similarity < 1 or a == b)


def test_close_pairs_over_word_edges_and_bucket_sizes():
    """Buckets of all sizes, numbers of rows around multiples of 64, against all pairs."""
    rng = np.random.default_rng(8)
    for n in (0, 1, 2, 63, 64, 65, 130, 260):
        for radius in (1, 2, 3):
            same = np.sort(rng.integers(0, max(1, n // 30), n))
            same = np.unique(same, return_inverse=True)[1] if n else same
            base = rng.integers(0, 1 << 63, max(1, n // 5), dtype=np.uint64)
            values = base[rng.integers(0, len(base), n)].copy()
            for _ in range(3):
                values ^= np.where(rng.random(n) < 0.5, np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64), np.uint64(0))
            i, j = simhash.close_pairs(values, same, radius)
            want = {(a, b) for a in range(n) for b in range(a + 1, n) if same[a] == same[b] and bin(int(values[a]) ^ int(values[b])).count("1") <= radius}
            assert set(zip(i.tolist(), j.tolist())) == want and len(i) == len(want)


def test_edited_copies_of_a_frequent_passage_are_paired_with_each_other(spark, make_docs, words, monkeypatch):
    """A seed of more than FEW documents, whose first holder has nothing else in common: each two others are a passage of their own."""
    line, passage = words(10, 7), words(60, 8)

    def edited(n):
        """Other words in eight places of the passage, the line in its middle: any two agree in four fifths or less, copies of one n in all."""
        return [f"w{n}x{i}" if (i + n) % 9 == 0 and not 25 <= i < 35 else line[i - 25] if 25 <= i < 35 else w for i, w in enumerate(passage)]

    rows = [(1, " ".join(words(70, 1) + line + words(70, 2)))] + [(i, " ".join(words(80, 10 + i) + line + words(80, 40 + i))) for i in range(2, 12)]
    rows += [(20 + n, " ".join(words(30, 80 + n) + edited(n) + words(30, 90 + n))) for n in range(9)]
    text = {i: t.split() for i, t in rows}
    want = {(20 + a, 20 + b) for a in range(9) for b in range(a + 1, 9) if sum(x == y for x, y in zip(edited(a), edited(b))) * 5 >= 4 * 55}
    assert len(want) > 9
    for often in (4, 4096):  # in blocks of so many, and all at once
        monkeypatch.setattr(substring_dedup, "OFTEN", often)
        for parts in (1, 3):
            found = {(r.doc_a, r.doc_b) for r in substring_dedup.passages(make_docs(rows).repartition(parts)).collect()}
            assert found >= want and all(a >= 20 for a, _ in found), (often, parts, want - found)


def test_partners_by_grams_are_those_of_all_pairs(monkeypatch):
    """No pair that shares a stretch of 50 to 99 columns around its seed is left out, whatever counts as frequent."""
    rng = np.random.default_rng(4)
    side, k = substring_dedup.span(50), substring_dedup.K
    base = rng.integers(1, 256, (6, 2 * side + k)).astype(np.uint8)
    near, want = [], set()
    for i in range(60):
        row = rng.integers(1, 256, 2 * side + k).astype(np.uint8)
        row[side:side + k] = base[0, side:side + k]
        if i < 45:
            length = int(rng.integers(50, 100))
            start = int(rng.integers(max(0, side + k - length), side + 1))
            row[start:start + length] = base[i % 6, start:start + length]
            row[side:side + k] = base[0, side:side + k]
            other = [x for x in range(start, start + length) if not side <= x < side + k]
            row[rng.choice(other, length // 10, replace=False)] = rng.integers(1, 256, length // 10)
        near.append(row)
    near = np.array(near)
    for i in range(60):
        for j in range(i + 1, 60):
            same = np.cumsum(np.append(0, near[i] == near[j]))
            if any(same[b] - same[a] >= 0.8 * (b - a) for n in range(50, 100) for a in range(max(0, side + k - n), side + 1) if (b := a + n) < len(same)):
                want.add((i, j))
    assert len(want) > 50
    for limit in (4_000_000, 300, 0):
        monkeypatch.setattr(substring_dedup, "GRAM_PAIRS", limit)
        found = {(int(i), int(j)) for x, y in substring_dedup.partners(np.zeros(60, dtype=np.int64), near, np.arange(60), 50) for i, j in zip(x, y)}
        assert want <= found and (limit < 4_000_000 or len(found) < 60 * 59 / 4), (limit, len(found), len(want))


def edited_copies(rng, n):
    """Pairs of texts, as hashes, with words replaced, put in and left out, and the runs of all chains of some of their seeds."""
    for _ in range(n):
        a = rng.integers(0, 1 << 60, rng.integers(60, 400)).astype(np.uint64)
        b, rate = [], rng.choice([0.01, 0.04, 0.1])
        for w in a.tolist():
            what = rng.random()
            b += [] if what < rate else [7] if what < 2 * rate else [w, *rng.integers(0, 4, rng.integers(1, 5)).tolist()] if what < 3 * rate else [w]
        b = np.array(b, dtype=np.uint64)
        places = {b[j:j + 5].tobytes(): j for j in range(len(b) - 4)}
        found = np.array([(i, places[a[i:i + 5].tobytes()]) for i in range(len(a) - 4) if a[i:i + 5].tobytes() in places and rng.random() < 0.5]).reshape(-1, 2)
        if len(found):
            runs = substring_dedup.merge_runs(np.zeros(len(found), dtype=int), *found.T)[1]
            yield a, b, [runs[c] for c in substring_dedup.chains(runs)]


def test_alignments_made_together_are_those_made_one_by_one(monkeypatch):
    """Of straight chains and of such with gaps of all kinds; a chain whose runs do not stand in the texts is none."""
    for cells, together in ((10_000, 1 << 20), (10_000, 300), (20, 1 << 20)):
        monkeypatch.setattr(substring_dedup, "GAP_CELLS", cells)
        monkeypatch.setattr(substring_dedup, "GAPS_CELLS", together)
        texts, sides, runs, want, size = [], [], [], [], 0
        for n, (a, b, chained) in enumerate(edited_copies(np.random.default_rng(3), 60)):
            for r in chained:
                if n % 9 == 0:
                    r = r + [0, 0, 1]
                want.append(substring_dedup.align(a, b, [tuple(x) for x in r.tolist()], 50))
                sides.append([(size, size + len(a)), (size + len(a), size + len(a) + len(b))])
                runs.append(r + [size, size + len(a), 0])
            texts += [a, b]
            size += len(a) + len(b)
        sides = np.array(sides)
        got = substring_dedup.align_all(np.concatenate(texts), sides[:, 0], sides[:, 1], np.concatenate(runs), np.array([len(r) for r in runs]), 50)
        got = {c: (a - sides[c, 0, 0], b - sides[c, 0, 0], x - sides[c, 1, 0], y - sides[c, 1, 0], n, m) for c, a, b, x, y, n, m in zip(*(v.tolist() for v in got))}
        assert got == {c: w for c, w in enumerate(want) if w} and 10 < len(got) < len(want)


def test_chains_of_many_pairs_are_those_of_each(monkeypatch):
    """Also where runs are equally good to follow, and where a pair has more runs than are held against each other."""
    rng = np.random.default_rng(5)
    for limit in (64, 6):
        monkeypatch.setattr(substring_dedup, "SWEPT", limit)
        for _ in range(20):
            pairs = []
            for _ in range(40):
                x = rng.integers(0, rng.choice([15, 40, 200]), rng.integers(1, 30))
                seeds = np.unique(np.stack((x, x + rng.integers(0, rng.choice([1, 2, 6, 30]), len(x))), axis=1), axis=0)
                pairs.append(substring_dedup.merge_runs(np.zeros(len(seeds), dtype=int), *seeds.T)[1])
            order, sizes, counts = substring_dedup.chains_of(np.repeat(np.arange(40), [len(p) for p in pairs]), np.concatenate(pairs))
            chained = iter(np.split(order, np.cumsum(sizes)[:-1]))
            before = 0
            for p, n in zip(pairs, counts.tolist()):
                assert sorted((next(chained) - before).tolist() for _ in range(n)) == sorted(substring_dedup.chains(p))
                before += len(p)


def test_words_of_a_document_are_sent_to_a_group_once():
    """Thirty copies make 435 pairs; of each the words go to their group as one stretch, not with every pair."""
    a, b = np.triu_indices(30, 1)
    one, doc = np.zeros(870, dtype=np.int64), np.concatenate((a, b))
    got = substring_dedup.stretches(doc, one, one + doc % 3, one + 200)
    assert [v.tolist() for v in got] == [list(range(30)), [0] * 30, [d % 3 for d in range(30)], [200] * 30]
    apart = substring_dedup.stretches(*np.array([[1, 1, 1, 1, 2], [5, 5, 5, 6, 5], [90, 0, 40, 45, 95], [120, 50, 60, 70, 99]]))
    assert [v.tolist() for v in apart] == [[1, 1, 1, 2], [5, 5, 6, 5], [0, 90, 45, 95], [60, 120, 70, 99]]


def test_a_group_that_is_dealt_out_gives_the_same_passages(make_docs, words, monkeypatch):
    """Two clusters of edited copies, one of them with rows that share a key, in groups of all sizes."""
    rows = []
    for c in range(2):
        passage = words(120, 400 + c)
        for n in range(14):
            rows.append((100 * c + (0 if c and n == 1 else n), " ".join(words(10 + n, 500 + 20 * c + n) + [f"x{n}" if (i + n) % 23 == 0 else w for i, w in enumerate(passage)])))
    found = []
    for group, parts in ((1 << 16, 1), (20, 3), (1, 2)):
        monkeypatch.setattr(substring_dedup, "GROUP", group)
        found.append(sorted(tuple(r) for r in substring_dedup.passages(make_docs(rows).repartition(parts)).collect()))
    assert found[0] == found[1] == found[2]
    assert {r[:2] for r in found[0]} == {(100 * c + a, 100 * c + b) for c in range(2) for a in range(14) for b in range(a + 1, 14) if not c or 1 not in (a, b)}


def test_partners_of_more_rows_than_fit_are_those_of_all_parts(monkeypatch):
    rng = np.random.default_rng(6)
    near = rng.integers(1, 256, (90, 193)).astype(np.uint8)
    near[::2, 60:130] = near[0, 60:130]
    near[:, 94:99] = near[0, 94:99]
    group = np.repeat([0, 1], [50, 40])
    pairs = []
    for rows in (1 << 16, 16, 8):
        monkeypatch.setattr(substring_dedup, "ROWS", rows)
        pairs.append({(int(i), int(j)) for x, y in substring_dedup.partners(group, near, np.arange(90), 50) for i, j in zip(x, y)})
    assert pairs[0] == pairs[1] == pairs[2] == {(i, j) for g in (range(0, 50, 2), range(50, 90, 2)) for i in g for j in g if i < j}
