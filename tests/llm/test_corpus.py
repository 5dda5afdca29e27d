"""Operators across documents against brute force."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest

from spreadlake.llm import ngram_join, queries, substrings, textcore

from .conftest import rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def without_repeats(texts):
    first, words = {}, {i: WORD.findall(t or "") for i, t in texts}
    for i, t in texts:
        w = WORD.findall(t or "")
        for k in range(len(w) - 12):
            x = tuple(w[k : k + 13])
            first[x] = min(first.get(x, i), i)
    out = []
    for i, t in texts:
        w = WORD.findall(t or "")
        gone = set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone.update(range(k, k + 13))
        out.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return sorted(out)


def test_op10(spark, place, texts):
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows(queries.op10_substring_dedup(spark, place)))
    assert got == without_repeats(list(texts.items()))


@pytest.mark.parametrize("block", [50, 10**6])
def test_substrings_random(spark, block, monkeypatch):
    rng = np.random.default_rng(7)
    texts = []
    for i in range(120):
        t = " ".join(f"w{x}" for x in rng.integers(0, 3 if i % 10 == 0 else 500, rng.integers(0, 120)))
        if texts and i % 3 == 0:
            w = texts[rng.integers(0, len(texts))][1].split()
            a = rng.integers(0, len(w) + 1)
            t = " ".join([*t.split()[:20], *w[a : a + rng.integers(5, 60)], *t.split()[20:]])
        texts.append((int(rng.integers(0, 90)), t))  # some ids repeat
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(substrings.repeats, "__defaults__", ("doc_id", "text", block))
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows(substrings.digests(df)))
    assert got == without_repeats(texts)


def test_remove_keeps_columns_and_untouched_texts(spark):
    p = " ".join(f"p{i}" for i in range(20))
    df = spark.createDataFrame([(2, f"a  {p}\tend", "x", 5), (1, f" {p} b", "y", None), (None, p, None, 1), (3, None, "z", 0)], "doc_id long, text string, tag string, start int")
    got = {r["doc_id"]: r for r in rows(substrings.remove(df))}
    assert got[1]["text"] == f" {p} b" and got[2]["text"] == "a end" and got[None]["text"] == "" and got[3]["text"] is None
    assert got[2]["tag"] == "x" and got[2]["start"] == 5


def test_remove_with_names_of_its_own(spark):
    """Columns named like those that the operator uses inside come back as they were."""
    p = " ".join(f"p{i}" for i in range(20))
    names = ["_starts", "_counts", "_id", "_tag", "_row", "_text", "id", "tag", "bucket"]
    df = spark.createDataFrame([(i, p, *[f"{n}{i}" for n in names]) for i in (1, 2)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    got = {r["doc_id"]: r for r in rows(substrings.remove(df))}
    assert [got[i]["text"] for i in (1, 2)] == [p, ""] and all(got[i][n] == f"{n}{i}" for i in (1, 2) for n in names)
    assert substrings.remove(df).columns == df.columns and [r["n_removed"] for r in sorted(rows(substrings.digests(df)), key=lambda r: r["doc_id"])] == [0, 20]


def test_least():
    x = np.random.default_rng(1).integers(0, 60, 100)
    for w in (1, 2, 5, 9, 13):
        least, at = substrings._least(x, w)
        assert (least == [x[i : i + w].min() for i in range(101 - w)]).all() and (at == [i + x[i : i + w].argmin() for i in range(101 - w)]).all()


@pytest.mark.parametrize("seed", range(5))
def test_extend(seed):
    """Extension against all pairs: few words and few anchors, so classes split late and partners differ by reach."""
    rng = np.random.default_rng(seed)
    n, side = 200, substrings.SIDE
    words = rng.integers(0, 2, n * 30).astype(np.uint32)
    left = np.arange(n) * 30 + 10
    words.reshape(n, 30)[:, 3:18] = words.reshape(n, 30)[rng.integers(0, 5, n), 3:18]
    flip = rng.random(words.shape) < 0.03
    words[flip] += 7
    anchor, rank = rng.integers(0, 3, n), rng.integers(0, 60, n)
    least = rng.integers(0, side + 1, n)
    most = np.array([rng.integers(x, side + 1) for x in least])
    got = substrings.extend(anchor, words, left, left + 5, least, most, rank)
    for i in range(n):
        for a in range(side + 1):
            own = (anchor[i], *words[left[i] - a : left[i]], *words[left[i] + 5 : left[i] + 5 + side - a])
            want = least[i] <= a <= most[i] and any(
                rank[j] < rank[i] and least[j] <= a <= most[j] and own == (anchor[j], *words[left[j] - a : left[j]], *words[left[j] + 5 : left[j] + 5 + side - a]) for j in range(n)
            )
            assert got[i, a] == want
    assert got.any()


def near_components(texts):
    sets = {}
    for i, t in texts.items():
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    lead = {i: i for i in sets}

    def top(i):
        while lead[i] != i:
            i = lead[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= 75 * max(len(x), len(y)):
                o = len(x & y)
                if 100 * o >= 75 * (len(x) + len(y) - o):
                    lo, hi = sorted((top(a), top(b)))
                    lead[hi] = lo
    return sorted((i, len(s), top(i)) for i, s in sets.items())


def test_op1(spark, place, texts):
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows(queries.op1_ngram_jaccard_join(spark, place)))
    assert got == near_components(texts)


def edited_texts(rng, n, bases):
    """Chains of edits around a few bases, so that many pairs are near the threshold; some ids repeat texts."""
    texts = {}
    for i in range(n):
        w = list(bases[rng.integers(0, len(bases))])
        if rng.random() < 0.5 and texts:
            w = (texts[int(rng.choice(list(texts)))] or "").split()
        for _ in range(rng.integers(0, 5)):
            if w:
                w[rng.integers(0, len(w))] = f"n{rng.integers(0, 9)}"
        if rng.random() < 0.3:
            w = w[: int(len(w) * rng.uniform(0.7, 1))]
        texts[int(i * 7 % 1000)] = " ".join(w)
    return texts


@pytest.mark.parametrize("most,rounds,block,hot", [(512, 2, 10**6, 10_000), (4, 1, 400, 5), (6, 0, 300, 60)])
def test_join_random(spark, monkeypatch, most, rounds, block, hot):
    """In families, by star rounds, and in pairs of blocks; without and with hot shingles."""
    monkeypatch.setattr(ngram_join, "HOT", hot)
    monkeypatch.setattr(ngram_join, "FAMILY_DOCS", most)
    monkeypatch.setattr(ngram_join, "STAR_ROUNDS", rounds)
    monkeypatch.setattr(ngram_join, "BLOCK_WORDS", block)
    monkeypatch.setattr(ngram_join, "TASK_LINKS", 10**6 if rounds else 5)
    rng = np.random.default_rng(11 + most)
    texts = edited_texts(rng, 300, [[f"w{x}" for x in rng.integers(0, 300, n)] for n in (6, 12, 40, 80, 80, 200)])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = sorted((r["id"], r["n"], r["component"]) for r in rows(ngram_join.join(df)))
    assert got == near_components(texts)


def test_join_of_repeated_and_null_ids(spark):
    """An id with several texts has the links of any of them; a null id links with nothing."""
    base = [f"b{i}" for i in range(100)]
    other = [f"c{i}" for i in range(100)]
    given = [(5, " ".join(base)), (5, " ".join(other)), (5, None), (7, " ".join(base[:90])), (8, " ".join(other[:90])), (9, " ".join(other[:50])), (None, " ".join(base)), (9, " ".join(other[:50]))]
    df = spark.createDataFrame(given, "doc_id long, text string").repartition(3)
    got = sorted((r["id"] or 0, r["n"], r["component"]) for r in rows(ngram_join.join(df)))
    assert got == [(0, 96, None), (5, 0, 5), (5, 96, 5), (5, 96, 5), (7, 86, 5), (8, 86, 5), (9, 46, 9), (9, 46, 9)]


def _linked(lists, probe):
    return ngram_join.Trie(lists, 1 + max(int(x[-1]) for x in [*lists, probe])).linked(probe, np.ones(len(lists), bool))


def test_trie_equals_intersection():
    rng = np.random.default_rng(4)
    for _ in range(200):
        base = np.sort(rng.choice(200, int(rng.integers(1, 80)), replace=False)).astype(np.uint32)
        others = []
        for _ in range(rng.integers(1, 30)):
            keep = base[rng.random(len(base)) < rng.uniform(0.6, 1)]
            more = rng.choice(200, int(rng.integers(0, 20)), replace=False).astype(np.uint32)
            others.append(np.unique(np.concatenate([keep, more])) if len(keep) + len(more) else base)
        want = [i for i, x in enumerate(others) if 100 * (o := len(np.intersect1d(x, base))) >= 75 * (len(x) + len(base) - o)]
        assert sorted(_linked(others, base)) == want


def test_trie_keeps_shorter_variants_of_a_set_that_was_given_up():
    u = lambda *x: np.array(x, np.uint32)
    assert _linked([u(0, 2, 3, 4, 5, 6, 7, 8, 9), u(0, 2, 3, 4, 5, 6, 7, 9)], u(0, 1, 3, 4, 5, 6, 7, 9)) == [1]
    assert sorted(_linked([u(3, 4, 10, 12, 15, 17, 18, 25, 36, 44), u(3, 4, 10, 12, 15, 17, 18, 25, 46)], u(3, 4, 10, 12, 15, 17, 18, 25, 27))) == [1]
    rng = np.random.default_rng(5)
    for _ in range(400):
        probe = np.sort(rng.choice(120, int(rng.integers(4, 60)), replace=False)).astype(np.uint32)
        others = [probe]
        for _ in range(rng.integers(2, 40)):  # sets derived from one another, some elements less and some more
            x = others[rng.integers(0, len(others))]
            x = x[rng.random(len(x)) < rng.uniform(0.8, 1)]
            others.append(np.union1d(x, rng.choice(120, int(rng.integers(0, 5)), replace=False)).astype(np.uint32))
        others = [x for x in others if len(x)]
        want = [i for i, x in enumerate(others) if 100 * (o := len(np.intersect1d(x, probe))) >= 75 * (len(x) + len(probe) - o)]
        assert sorted(_linked(others, probe)) == want
        wanted = rng.random(len(others)) < 0.5
        assert sorted(ngram_join.Trie(others, 120).linked(probe, wanted)) == [i for i in want if wanted[i]]


def test_useful_keeps_all_pairs():
    """No member of a pair that passes both bounds is left out."""
    rng = np.random.default_rng(6)
    for _ in range(300):
        k = int(rng.integers(1, 12))
        group, n = np.sort(rng.integers(0, 3, k)), rng.integers(1, 40, k)
        order = np.lexsort((n, group))
        group, n = group[order], n[order]
        left = n - (rng.random(k) * ngram_join.prefix_size(n)).astype(np.int64)
        use = ngram_join.useful(group, n, left)
        for i in range(k):
            for j in range(i + 1, k):
                if group[i] == group[j] and ngram_join.may_link(n[i], left[i], n[j], left[j]):
                    assert use[i] and use[j]


def test_byte_hashes_differ_where_polynomials_collide():
    word = "a"
    for _ in range(12):  # a Thue-Morse word and its complement
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    c = next(textcore.chunks(pa.array([f"{word} {other} {word} b{word[1:]}"])))
    x = c.word_hashes()
    assert x[0] == x[2] and len(set(x.tolist())) == 3


@pytest.mark.parametrize("task", [0, 10**6])
def test_components_of_a_chain(spark, monkeypatch, task):
    monkeypatch.setattr(ngram_join, "TASK_LINKS", task)
    links = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(200, 100), (200, 300)], "a long, b long")
    got = {r["id"]: r["component"] for r in rows(ngram_join.components(links))}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 200: 100, 300: 100}
